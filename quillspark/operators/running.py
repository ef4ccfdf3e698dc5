"""Numbers and running sums over a total order, without a task that sees all rows.

Rows are range partitioned by the order, sorted within partitions and written once with
their partition and place, so that all later steps agree on both. What a partition starts
with is a sum over one row per partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.plans.scratch import Scratch


def _laid_out(rows: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """The rows with ``__part`` and ``__place`` (from 0) within it."""
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = spread.withColumns({"__part": F.shiftright("__id", 33), "__place": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))})
    return Scratch(rows.sparkSession, "order").save(placed.drop("__id"), "rows")


def _starts(totals: DataFrame, names: Sequence[str]) -> DataFrame:
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    return totals.select("__part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__start_{n}") for n in names])


def numbered(rows: DataFrame, order: Sequence[str | Column], offset: int = 0, name: str = "internal_id") -> DataFrame:
    """``rows`` with consecutive numbers ``name`` in the given order, from ``offset``."""
    laid = _laid_out(rows, order)
    starts = _starts(laid.groupBy("__part").agg(F.count("*").alias("n")), ["n"])
    return laid.join(starts, "__part").withColumn(name, F.col("__start_n") + F.col("__place") + offset).drop("__part", "__place", "__start_n")


def running_sums(rows: DataFrame, order: Sequence[str | Column], sums: Mapping[str, str]) -> DataFrame:
    """``rows`` with running sums (own row included) of columns, named by the mapping."""
    laid = _laid_out(rows, order)
    starts = _starts(laid.groupBy("__part").agg(*[F.sum(c).alias(c) for c in sums]), list(sums))
    within = Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    local = laid.withColumns({f"__sum_{c}": F.sum(c).over(within) for c in sums})
    out = local.join(starts, "__part").withColumns({n: F.col(f"__sum_{c}") + F.col(f"__start_{c}") for c, n in sums.items()})
    return out.select(*rows.columns, *sums.values())


def with_group_size(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with the number of rows of the same key (null keys are one group). Counts are
    written first, so that a very common key can be split where they are joined."""
    counts = rows.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias(name))
    counts = Scratch(rows.sparkSession, "sizes").save(counts, "counts")
    return rows.join(counts, rows[key].eqNullSafe(counts["__key"])).drop("__key")
