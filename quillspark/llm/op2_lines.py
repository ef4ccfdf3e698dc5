"""Line dedup by winnowing over line hashes, in DataFrame operations only.

The lines with a character other than white space are a sequence per document. Of every
window of two neighbouring lines the one with the lesser hash is selected, once however many
windows share it: its hash is a fingerprint, and two equal pairs of lines select the same
line of the pair. A line of over ``ALONE`` words is a window by itself, so one-line passages
and one-line documents are searched too.

The places of a fingerprint are joined with the first place that has the same fingerprint
and the same line before it, or after it, or that is such a long line: the match is extended
to that side. As every pair of neighbours holds a selected line, longer matches are extended
by the next selected line, and no line of a repeated run of two lines or more is missed.
What is matched by an earlier place (smaller doc_id, or same document, earlier line) goes.

First places are aggregated before the shuffle and written, one row per fingerprint and
neighbour, so a fingerprint of a third of all documents can be split by skew handling. The
texts are not sorted: what goes from a document meets its text in a hash table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.plans.scratch import Scratch

#: A line of more words is a passage by itself.
ALONE = 50


def fingerprints(docs: DataFrame, text: str, alone: int = ALONE) -> DataFrame:
    """The selected lines: doc, the number ``i`` of the line in the sequence, its hash, its place
    in the text and those of its neighbours. ``before`` and ``after`` are the hashes of the
    neighbours with which it is selected, null if not; ``long`` tells a line that is a window by itself."""
    lines = F.split(F.col(f"`{text}`"), "\n", -1)
    long = lambda x: (F.length(x) > 2 * alone) & (F.regexp_count(x, F.lit(r"\S+")) > alone)
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.xxhash64(x).alias("h"), long(x).alias("long"), x.rlike(r"[^ \t\r\f\x0B]").alias("full")))
    kept = F.transform(F.filter(numbered, lambda x: x["full"]), lambda x: F.struct(*[x[n].alias(n) for n in ("at", "h", "long")]))
    sequence = docs.where("doc_id is not null").select(F.col("doc_id").alias("doc"), kept.alias("lines")).where(F.size("lines") > 0)

    def place(x: Column, i: Column) -> Column:
        left, right = F.get("lines", i - 1), F.get("lines", i + 1)
        return F.struct(
            i.alias("i"),
            x["h"].alias("h"),
            left["at"].alias("at_before"),
            x["at"].alias("at"),
            right["at"].alias("at_after"),
            F.when(x["h"] < left["h"], left["h"]).alias("before"),
            F.when(x["h"] <= right["h"], right["h"]).alias("after"),
            x["long"].alias("long"),
        )

    selected = F.filter(F.transform("lines", place), lambda p: p["before"].isNotNull() | p["after"].isNotNull() | p["long"])
    return sequence.select("doc", F.explode(selected).alias("p")).select("doc", "p.*")


def repeated_lines(docs: DataFrame, text: str = "text", scratch: Scratch | None = None, alone: int = ALONE) -> DataFrame:
    """``doc`` and ``gone``, the ascending places of its lines that go, where there are any."""
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    places = scratch.save(fingerprints(docs, text, alone), "fingerprints")
    side = lambda name, neighbour, *at: F.when(neighbour, F.struct(F.lit(name).alias("side"), F.coalesce(F.col(name) if name != "long" else F.lit(0), F.lit(0)).alias("neighbour"), F.array(*at).alias("lines")))
    sides = F.array(
        side("before", F.col("before").isNotNull(), "at_before", "at"),
        side("after", F.col("after").isNotNull(), "at", "at_after"),
        side("long", F.col("long"), "at"),
    )
    matches = places.select("doc", "i", "h", F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("m")).select("doc", "i", "h", "m.side", "m.neighbour", "m.lines")
    key = ["h", "side", "neighbour"]
    first = matches.groupBy(*key).agg(F.min(F.struct("doc", "i")).alias("first"), F.count("*").alias("n")).where("n > 1").select(*key, "first")
    first = scratch.save(first, "first", narrow=True)
    later = matches.join(first, key).where(F.struct("doc", "i") > F.col("first"))
    return later.groupBy("doc").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("gone"))  # at most the document's lines


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines at the places ``gone``: the runs between them, joined."""
    lines = F.split(text, "\n", -1)
    # bound as lambda variables, or each step would split the text anew
    bound = F.struct(lines.alias("lines"), F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines))).alias("bounds"))

    def kept(b: Column) -> Column:
        between = lambda k: F.slice(b["lines"], F.get(b["bounds"], k - 1) + 2, F.get(b["bounds"], k) - F.get(b["bounds"], k - 1) - 1)
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(1), F.size(b["bounds"]) - 1), between)), "\n")

    return F.get(F.transform(F.array(bound), kept), F.lit(0))


def dedup(docs: DataFrame, text: str = "text", alone: int = ALONE) -> DataFrame:
    """All columns of ``docs``, the text without its repeated runs, and ``n_lines`` (all lines
    of the input, blank ones too) and ``n_removed``.

    A null text stays null (0 lines), an empty one empty (1 line). Rows of one doc_id count as
    one document, and what goes from one goes from all; rows without doc_id are neither
    searched nor changed. Blank lines break no run and stay. A column that has the name of an
    output column is replaced.
    """
    gone = repeated_lines(docs, text, alone=alone).select(F.col("doc").alias("__qs_doc"), F.col("gone").alias("__qs_gone")).hint("shuffle_hash")
    source = F.col(f"`{text}`")
    lines = F.when(source.isNull(), 0).otherwise(F.size(F.split(source, "\n", -1))).cast("long")
    joined = docs.join(gone, docs["doc_id"] == F.col("__qs_doc"), "left").drop("n_lines", "n_removed").withColumn("n_lines", lines)
    # rows of one doc_id may have fewer lines than the places found in another
    placed = joined.withColumn("__qs_gone", F.filter("__qs_gone", lambda i: i < F.col("n_lines")))
    counted = placed.withColumn("n_removed", F.coalesce(F.size("__qs_gone"), F.lit(0)).cast("long"))
    shortened = F.when(F.col("n_removed") > 0, _without(source, F.col("__qs_gone"))).otherwise(source)
    return counted.withColumn(text, shortened).drop("__qs_doc", "__qs_gone")


def strip_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with its own columns: ``text`` deduplicated, ``n_chars`` of what is left."""
    out = dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
