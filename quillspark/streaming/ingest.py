"""Incremental ingest: arriving documents are weighted with a frozen feature model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators.features import FeatureModel
from quillspark.operators.lsi import LsiModel


def weigh_stream(docs: DataFrame, model: FeatureModel, sink: Callable[[DataFrame, int], None], checkpoint: str, lsi: LsiModel | None = None, once: bool = True) -> StreamingQuery:
    """Weights each micro-batch of a stream with doc_id and text and passes it to ``sink``
    with its number, as terms or, with an LSI model, as vectors. A batch that is replayed has
    the same number, so a sink that writes a folder per number is idempotent."""

    def step(batch: DataFrame, number: int) -> None:
        weights = model.transform(batch)
        sink(lsi.transform(weights) if lsi else weights, number)

    writer = docs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
