"""Quality metrics as aggregations and windows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.running import numbered, running_sums, with_group_size


def matched(truth: DataFrame, predicted: DataFrame, on: str = "doc_id") -> DataFrame:
    """Rows of both sides with the same id."""
    return truth.join(predicted, on)


def precision_recall_f1(rows: DataFrame, truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """One row of precision, recall, f1 of 0/1 columns; 0 where undefined."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    tp, fp, fn = (F.count_if(c).alias(n) for c, n in ((t & p, "tp"), (~t & p, "fp"), (t & ~p, "fn")))
    ratio = lambda a, b: F.when(F.expr(b) > 0, F.expr(a) / F.expr(b)).otherwise(0.0)
    return rows.agg(tp, fp, fn).select(ratio("tp", "tp + fp").alias("precision"), ratio("tp", "tp + fn").alias("recall"), ratio("2 * tp", "2 * tp + fp + fn").alias("f1"))


def micro_scores(rows: DataFrame, truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """Micro averages over any number of classes; all three are the accuracy."""
    a = F.avg((F.col(truth) == F.col(predicted)).cast("double"))
    return rows.agg(a.alias("precision"), a.alias("recall"), a.alias("f1"))


def _by_score(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """Per distinct score: rows, relevant rows, and both cumulated from the top."""
    per = rows.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum((F.col(truth) == 1).cast("long")).alias("pos"))
    return running_sums(per, [F.desc("s")], {"n": "upto_n", "pos": "upto_pos"})


def roc_auc(rows: DataFrame, truth: str = "y_true", score: str = "score") -> DataFrame:
    """One row ``roc_auc``, by rank sums with average ranks; null with one class only."""
    c = _by_score(rows, truth, score)
    above = F.col("upto_n") - F.col("n") - (F.col("upto_pos") - F.col("pos"))  # irrelevant rows with a higher score
    neg = F.col("n") - F.col("pos")
    out = c.agg(F.sum("pos").alias("p"), F.sum(neg).alias("q"), F.sum(F.col("pos") * (above + neg / 2)).alias("worse"))
    return out.select(F.when((F.col("p") > 0) & (F.col("q") > 0), 1 - F.col("worse") / (F.col("p") * F.col("q"))).alias("roc_auc"))


def average_precision(rows: DataFrame, truth: str = "y_true", score: str = "score") -> DataFrame:
    """One row ``average_precision``: precision at each score weighted by its share of the
    relevant rows; null without relevant rows."""
    c = _by_score(rows, truth, score)
    return c.agg((F.sum(F.col("pos") * F.col("upto_pos") / F.col("upto_n")) / F.nullif(F.sum("pos"), F.lit(0))).alias("average_precision"))


def recall_at_k(rows: DataFrame, k: float | int, truth: str = "y_true", score: str = "score", tie: str = "doc_id") -> DataFrame:
    """One row ``recall_at_k``: share of the relevant rows among the best k; a float k is a
    share of all rows, rounded down. Ties go to the greater id."""
    most = F.floor(F.lit(k) * F.count("*")) if isinstance(k, float) else F.lit(k)
    ranked = numbered(rows.select((F.col(truth) == 1).cast("long").alias("rel"), score, tie), [F.desc(score), F.desc(tie)], name="rn")
    whole = rows.agg(most.alias("most"))  # one row
    found = F.coalesce(F.sum(F.when(F.col("rn") < F.col("most"), F.col("rel"))), F.lit(0))
    return ranked.join(whole).agg((found / F.nullif(F.sum("rel"), F.lit(0))).alias("recall_at_k"))


def categorization_score(rows: DataFrame, truth: str = "y_true", score: str = "score") -> dict[str, float]:
    """All categorization metrics of joined rows, threshold 0. Without rows every value is -1;
    the rank metrics are NaN unless there are two classes."""
    names = ("recall", "precision", "f1", "roc_auc", "average_precision", "recall_at_20p")
    classes = [r[0] for r in rows.select(truth).distinct().limit(3).collect()]
    if not classes:
        return dict.fromkeys(names, -1.0)
    binary = rows.withColumn("y_pred", (F.col(score) > 0).cast("int"))
    base = (precision_recall_f1 if len(classes) == 2 else micro_scores)(binary, truth).first().asDict()
    if len(classes) != 2:
        return base | {n: math.nan for n in names[3:]}
    return base | roc_auc(rows, truth, score).first().asDict() | average_precision(rows, truth, score).first().asDict() | {"recall_at_20p": recall_at_k(rows, 0.2, truth, score).first()[0]}


def response_scores(truth: DataFrame, best: DataFrame) -> DataFrame:
    """One row of metrics of a categorization's answer: ``truth`` has doc_id and category, ``best``
    doc_id, the best category of each and its score. Of two categories the second by name is the
    positive one, and a score for the other counts with its sign turned; otherwise scores are
    micro-averaged and the rank metrics are NaN. Without rows every value is null."""
    both = truth.select("doc_id", F.col("category").alias("t")).join(best.select("doc_id", F.col("category").alias("p"), "score"), "doc_id")
    classes = [r[0] for r in truth.select("category").distinct().orderBy("category").limit(3).collect()]
    if len(classes) != 2:
        base = micro_scores(both.select(F.col("t").alias("y_true"), F.col("p").alias("y_pred")))
        return base.withColumns({n: F.lit(math.nan) for n in ("roc_auc", "average_precision", "recall_at_20p")})
    hit, told = (F.col(c) == classes[1] for c in ("t", "p"))
    rows = both.select("doc_id", hit.cast("int").alias("y_true"), told.cast("int").alias("y_pred"), F.when(told, F.col("score")).otherwise(-F.col("score")).alias("score"))
    ranks = recall_at_k(rows, 0.2).withColumnRenamed("recall_at_k", "recall_at_20p")
    return precision_recall_f1(rows).crossJoin(roc_auc(rows)).crossJoin(average_precision(rows)).crossJoin(ranks)  # one row each


def contingency(rows: DataFrame, a: str = "y_true", b: str = "y_pred") -> DataFrame:
    return rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def adjusted_rand(rows: DataFrame, a: str = "y_true", b: str = "y_pred") -> DataFrame:
    """One row ``ari``; 1 if both are trivial."""
    c = contingency(rows, a, b)
    pairs = lambda x: F.sum(F.col(x) * (F.col(x) - 1) / 2)
    both = c.agg(pairs("n").alias("ab"), F.sum("n").alias("total"))
    of_a = c.groupBy("a").agg(F.sum("n").alias("m")).agg(pairs("m").alias("sa"))
    of_b = c.groupBy("b").agg(F.sum("n").alias("m")).agg(pairs("m").alias("sb"))
    e = F.col("sa") * F.col("sb") / F.nullif(F.col("total") * (F.col("total") - 1) / 2, F.lit(0))
    top = (F.col("sa") + F.col("sb")) / 2
    value = F.when(F.coalesce(top == e, F.lit(True)), 1.0).otherwise((F.col("ab") - e) / (top - e))
    return both.join(of_a).join(of_b).select(value.alias("ari"))  # single rows


def _entropy(c: DataFrame, column: str, name: str) -> DataFrame:
    m = c.groupBy(column).agg(F.sum("n").alias("m"))
    return m.agg((F.log(F.sum("m")) - F.sum(F.col("m") * F.log("m")) / F.sum("m")).alias(name))


def mutual_information(rows: DataFrame, a: str = "y_true", b: str = "y_pred") -> DataFrame:
    """One row ``mi``, ``ha``, ``hb`` in nats."""
    c = contingency(rows, a, b)
    joint = c.agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("hab"))
    out = joint.join(_entropy(c, "a", "ha")).join(_entropy(c, "b", "hb"))  # single rows
    return out.select((F.col("ha") + F.col("hb") - F.col("hab")).alias("mi"), "ha", "hb")


def v_measure(rows: DataFrame, a: str = "y_true", b: str = "y_pred") -> DataFrame:
    """One row ``homogeneity``, ``completeness``, ``v_measure``."""
    m = mutual_information(rows, a, b)
    h = F.when(F.col("ha") > 1e-12, F.col("mi") / F.col("ha")).otherwise(1.0)
    c = F.when(F.col("hb") > 1e-12, F.col("mi") / F.col("hb")).otherwise(1.0)
    return m.select(h.alias("homogeneity"), c.alias("completeness"), F.when(h + c > 0, 2 * h * c / (h + c)).otherwise(0.0).alias("v_measure"))


def _log_factorial(x: np.ndarray) -> np.ndarray:
    """ln x!, by Stirling's series from 32 on."""
    z = np.maximum(x, 1).astype(float) + 1
    series = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    small = np.array([math.lgamma(k + 1) for k in range(32)])
    return np.where(x < 32, small[np.clip(x, 0, 31).astype(int)], series)


def _expected_part(n: int, x: int, y: int) -> float:
    """Expected part of two clusters of x and y of n rows in the mutual information."""
    low, most = max(1, x + y - n), min(x, y)
    whole = _log_factorial(np.array([x, y, n - x, n - y])).sum() - _log_factorial(np.array([n]))[0]
    out = 0.0
    for start in range(low, most + 1, 1 << 20):
        k = np.arange(start, min(most + 1, start + (1 << 20)))
        log_p = whole - _log_factorial(k) - _log_factorial(x - k) - _log_factorial(y - k) - _log_factorial(n - x - y + k)
        out += float(np.sum(k / n * np.log(n * k / (x * y)) * np.exp(log_p)))
    return out


def adjusted_mutual_information(rows: DataFrame, a: str = "y_true", b: str = "y_pred") -> DataFrame:
    """One row ``ami``, with the greater entropy as the normalizer; 1 if both are trivial. The
    expected value depends on the sizes of clusters only: their distinct pairs, few against the
    rows as the sizes add up to their number, are dealt to the tasks."""
    c = contingency(rows, a, b)
    sizes = lambda x, m, t: c.groupBy(x).agg(F.sum("n").alias(m)).groupBy(m).agg(F.count("*").alias(t))
    total = c.agg(F.sum("n").alias("total"))  # one row
    pairs = sizes("a", "x", "tx").crossJoin(sizes("b", "y", "ty")).join(total)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"e": [tx * ty * _expected_part(n, x, y) for x, tx, y, ty, n in pdf[["x", "tx", "y", "ty", "total"]].itertuples(index=False)]})

    expected = pairs.mapInPandas(run, "e double").agg(F.sum("e").alias("e"))
    m = mutual_information(rows, a, b).join(expected)
    top = F.greatest("ha", "hb") - F.col("e")
    return m.select(F.when(F.abs(top) < 1e-15, 1.0).otherwise((F.col("mi") - F.col("e")) / top).alias("ami"))


def ratio_duplicates(rows: DataFrame, a: str = "x", b: str = "y") -> DataFrame:
    """One row: 1 - |da - db| / max(da, db) with d = rows - distinct labels; null without any."""
    d = rows.agg((F.count("*") - F.count_distinct(a)).alias("da"), (F.count("*") - F.count_distinct(b)).alias("db"))
    return d.select((1 - F.abs(F.col("da") - F.col("db")) / F.nullif(F.greatest("da", "db"), F.lit(0))).alias("ratio_duplicates"))


def _sized(rows: DataFrame, a: str, b: str) -> DataFrame:
    return with_group_size(with_group_size(rows.select(a, b), a, "ca"), b, "cb")


def f1_same_duplicates(rows: DataFrame, a: str = "x", b: str = "y") -> DataFrame:
    """One row: F1 over whether a row's group has others."""
    sized = _sized(rows, a, b)
    flags = sized.select((F.col("ca") > 1).cast("int").alias("y_true"), (F.col("cb") > 1).cast("int").alias("y_pred"))
    return precision_recall_f1(flags).select(F.col("f1").alias("f1_same_duplicates"))


def mean_duplicates_count(rows: DataFrame, a: str = "x", b: str = "y") -> DataFrame:
    """One row: mean of 1 - |ca - cb| / max(ca, cb) over rows with others in either; null
    without any."""
    c = _sized(rows, a, b).where((F.col("ca") > 1) | (F.col("cb") > 1))
    return c.agg(F.avg(1 - F.abs(F.col("ca") - F.col("cb")) / F.greatest("ca", "cb")).alias("mean_duplicates_count"))


def noisy_from_unique(rows: DataFrame, label: str = "label") -> DataFrame:
    """Labels of single rows become -1."""
    sized = with_group_size(rows, label, "__n")
    return sized.withColumn(label, F.when(F.col("__n") == 1, -1).otherwise(F.col(label))).drop("__n")


def unique_from_noisy(rows: DataFrame, label: str = "label", id_col: str = "doc_id") -> DataFrame:
    """Each -1 becomes a label of its own, below all others: -2 - id."""
    return rows.withColumn(label, F.when(F.col(label) == -1, -2 - F.col(id_col)).otherwise(F.col(label)))
