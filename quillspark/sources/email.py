"""E-mail headers of whole messages, over Arrow batches."""

from __future__ import annotations

from email import policy
from email.parser import HeaderParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADERS = T.StructType(
    [
        T.StructField("message_id", T.StringType()),
        T.StructField("in_reply_to", T.StringType()),
        T.StructField("references", T.ArrayType(T.StringType())),
        T.StructField("subject", T.StringType()),
    ]
)


def parse_headers(text: str | None) -> tuple[str | None, str | None, list[str], str | None]:
    """Message-ID, In-Reply-To, References (oldest first) and Subject; ids in their brackets.
    Folded lines are joined. Without a header the value is null, references are empty."""
    m = HeaderParser(policy=policy.compat32).parsestr(text or "")

    def ids(name: str) -> list[str]:
        raw = str(m.get(name) or "")
        return [f"<{x.split('>')[0]}>" for x in raw.split("<")[1:] if ">" in x]

    first = lambda name: (ids(name) or [None])[0]
    subject = m.get("Subject")
    return first("Message-ID"), first("In-Reply-To"), ids("References"), None if subject is None else " ".join(str(subject).split())


@F.pandas_udf(HEADERS)
def _headers(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_headers(t) for t in texts], columns=["message_id", "in_reply_to", "references", "subject"])


def read_headers(docs: DataFrame, text: str = "text", idx: str = "internal_id") -> DataFrame:
    """``message_idx`` and the headers of each document."""
    return docs.select(F.col(idx).alias("message_idx"), _headers(F.col(text)).alias("h")).select("message_idx", "h.*")
