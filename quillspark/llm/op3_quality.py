"""Quality rules: base counts, then robust multivariate outliers per language and source.

Each text gives a vector of transformed statistics that vary in any prose: ln words, ln mean
word length, ln distinct words, the logit of the share of marks (characters of words that
are neither letters nor digits), and the entropy of its characters. The minimum-covariance-
determinant estimate of centre and scatter is found for all rows, for each language and for
each (language, source): from several starts, concentration steps keep the h vectors nearest
to the centre and estimate anew; the start with the least determinant goes on until the
determinant rests. A row is rejected if its squared Mahalanobis distance exceeds the cutoff.

Small groups borrow strength without a switch: the estimate of a source counts with its
number of vectors, that of its language like ``PRIOR`` vectors more, and the language's own
is mixed with that of all rows in the same way. In no direction is a group taken to be
tighter than ``TIGHT`` times the variance of what it is mixed with, so a source that is
mostly copies of one text does not reject the rest.

A step is one aggregation. The distances fall into logarithmic bins, and each task sums
counts, vectors and products per (group, start, bin) before the shuffle, so a hot source
costs as many rows as it has bins. The bin in which the h-subset ends counts with the share
that fills it. Vectors are fixed-point, so the sums are exact and do not depend on the
partitioning; equal vectors of a group count once.

Null, empty and short texts fail the base rule; a null language or source is a group of
its own; repeated rows are judged each; other columns pass ``keep`` unchanged and are not
read otherwise; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations_with_replacement
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.batches import bounded
from quillspark.llm.textstats import WORD, base_counts
from quillspark.plans.scratch import Scratch

MIN_WORDS, REPEAT_PERCENT = 50, 50
COVERAGE = 0.75
#: Random starts of P + 1 vectors each, beside the one from medians and deviations.
RANDOM_STARTS = 2
#: Steps that all starts make, and most steps of the best one.
FIRST_STEPS, MOST_STEPS = 2, 30
#: The determinant rests when its logarithm changes by no more.
REST = 1e-3
PRIOR = 50
TIGHT = 0.5
#: Share of normal rows that the cutoff rejects.
TAIL = 1e-6
UNIT = 1024
#: Variance of rounding to the unit, the least there is.
ROUNDING = 1 / (12 * UNIT * UNIT)
BINS = 32  # per factor e of squared distance
P = 5
PAIRS = list(combinations_with_replacement(range(P), 2))
XS = [f"x{i}" for i in range(P)]
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_distinct", "n_marks"]


def chi2_quantile(p: float, dof: int) -> float:
    """Wilson-Hilferty approximation."""
    a = 2 / (9 * dof)
    return dof * (1 - a + NormalDist().inv_cdf(p) * a**0.5) ** 3


CUTOFF = chi2_quantile(1 - TAIL, P)
MEDIAN = chi2_quantile(0.5, P)


def further_counts(text: str | None) -> tuple[int, int, float]:
    """Distinct words, marks in words, and the entropy of the characters in bits."""
    if not text:
        return 0, 0, 0.0
    chars = Counter(text)
    marks = sum(n for c, n in chars.items() if not c.isalnum() and WORD.match(c))
    total = len(text)
    return len(set(WORD.findall(text))), marks, math.log2(total) - sum(n * math.log2(n) for n in chars.values()) / total


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row: doc_id, lang, source, the base counts and what the vectors need. One narrow pass."""
    base = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col(f"`{text}`").alias("text"))
    names = [*BASE, *MORE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            texts = b.column("text").to_pylist()
            further = [further_counts(t) for t in texts]
            found = np.array([(*base_counts(t), *f[:2]) for t, f in zip(texts, further, strict=True)], dtype=np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("lang"), b.column("source"), *(pa.array(np.ascontiguousarray(found[:, k])) for k in range(len(names))), pa.array([f[2] for f in further], pa.float64())],
                ["doc_id", "lang", "source", *names, "entropy"],
            )

    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(run, f"doc_id {kind}, lang string, source string, " + ", ".join(f"{n} bigint" for n in names) + ", entropy double")


def _vector() -> list[Column]:
    n, chars = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("n_words", "word_chars"))
    raw = [
        F.ln(n),
        F.ln(chars / n),
        F.ln(F.greatest(F.col("n_distinct"), F.lit(1)).cast("double")),
        F.ln((F.col("n_marks") + 0.5) / (chars - F.col("n_marks") + 0.5)),
        F.col("entropy"),
    ]
    return [F.round(c * UNIT).cast("long").alias(x) for c, x in zip(raw, XS, strict=True)]


ALL = "all"


def _group(kind: str, *names: str) -> Column:
    """Key of a language, or of a source in it; null fields are left out of the JSON."""
    return F.concat(F.lit(f"{kind} "), F.to_json(F.struct(*names)))


def _distance() -> Column:
    """Squared Mahalanobis distance from columns x, centre and precision."""
    off = [F.col(x) / UNIT - F.col("centre")[i] for i, x in enumerate(XS)]
    terms = [F.col("precision")[k] * off[i] * off[j] * (1 if i == j else 2) for k, (i, j) in enumerate(PAIRS)]
    return F.greatest(sum(terms[1:], terms[0]), F.lit(0.0))


def _bin() -> Column:
    return F.floor(F.ln(_distance() + 1e-9) * BINS).cast("int")


_ESTIMATE = "g string, start int, n bigint, centre array<double>, scatter array<double>, precision array<double>, logdet double, rests boolean"


def _full(upper: np.ndarray) -> np.ndarray:
    """Symmetric matrices from rows of upper triangles."""
    out = np.zeros((*upper.shape[:-1], P, P))
    for k, (i, j) in enumerate(PAIRS):
        out[..., i, j] = out[..., j, i] = upper[..., k]
    return out


def _upper(full: np.ndarray) -> list[float]:
    return [float(full[i, j]) for i, j in PAIRS]


def _row(g: str, start: int, n: int, centre: np.ndarray, scatter: np.ndarray, before: float | None = None) -> dict:
    scatter = scatter + ROUNDING * np.eye(P)
    logdet = float(np.linalg.slogdet(scatter)[1])
    rests = before is not None and abs(logdet - before) <= REST
    return {"g": g, "start": start, "n": n, "centre": centre.tolist(), "scatter": _upper(scatter), "precision": _upper(np.linalg.inv(scatter)), "logdet": logdet, "rests": rests}


def _median_start(key: tuple, values: pd.DataFrame) -> pd.DataFrame:
    """Medians and median absolute deviations, from rows (statistic i, value v, n)."""
    centre, spread = np.zeros(P), np.zeros(P)
    for i, part in values.groupby("i"):
        v, n = part["v"].to_numpy() / UNIT, part["n"].to_numpy()

        def median(x: np.ndarray, n: np.ndarray = n) -> float:
            order = np.argsort(x, kind="stable")
            return float(x[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)])

        centre[i] = median(v)
        spread[i] = 1.4826 * median(np.abs(v - centre[i]))
    return pd.DataFrame([_row(key[0], 0, int(values["n"].sum()) // P, centre, np.diag(np.square(spread)))])


def _random_starts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mean and covariance of the vectors that were drawn for each start."""
    for frame in frames:
        out = []
        for g, *drawn in frame[["g", *(f"r{k}" for k in range(RANDOM_STARTS * (P + 1)))]].itertuples(index=False):
            for s in range(RANDOM_STARTS):
                v = np.array([[r[x] for x in XS] for r in drawn[s * (P + 1) : (s + 1) * (P + 1)]]) / UNIT
                out.append(_row(g, s + 1, 0, v.mean(axis=0), np.cov(v.T, bias=True)))
        if out:
            yield pd.DataFrame(out)


def _concentrate(key: tuple, bins: pd.DataFrame) -> pd.DataFrame:
    """A concentration step from the sums per bin of distance."""
    bins = bins.sort_values("bin")
    n = bins["n"].to_numpy().astype(float)
    before = np.cumsum(n) - n
    share = np.clip((COVERAGE * n.sum() - before) / n, 0.0, 1.0)  # 1 up to the bin where the h-subset ends
    h = float((share * n).sum())
    centre = np.array([(share * bins[f"s{i}"]).sum() for i in range(P)]) / (h * UNIT)
    scatter = _full(np.array([(share * bins[f"q{i}{j}"]).sum() for i, j in PAIRS]) / (h * UNIT * UNIT)) - np.outer(centre, centre)
    return pd.DataFrame([_row(key[0], int(key[1]), int(n.sum()), centre, scatter, float(bins["logdet"].iloc[0]))])


def _starts(vectors: DataFrame, scratch: Scratch) -> DataFrame:
    """Starting estimates of every group. Histograms and draws are made per source and then
    rolled up, so the rows are read once."""
    levels = F.explode(F.array("own", "language", F.lit(ALL))).alias("g")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(x).alias("v")) for i, x in enumerate(XS)])).alias("e")
    values = scratch.save(vectors.select("own", "language", each).groupBy("own", "language", "e.i", "e.v").agg(F.count("*").alias("n")), "values", narrow=True)
    medians = values.select(levels, "i", "v", "n").groupBy("g", "i", "v").agg(F.sum("n").alias("n")).groupBy("g").applyInPandas(_median_start, _ESTIMATE)
    draws = [f"r{k}" for k in range(RANDOM_STARTS * (P + 1))]
    one = [F.min(F.struct(F.xxhash64(*XS, F.lit(k)).alias("h"), *XS)).alias(d) for k, d in enumerate(draws)]
    drawn = scratch.save(vectors.groupBy("own", "language").agg(*one), "draws", narrow=True).select(levels, *draws).groupBy("g").agg(*[F.min(d).alias(d) for d in draws])
    return medians.unionByName(drawn.mapInPandas(_random_starts, _ESTIMATE))


def estimates(vectors: DataFrame, scratch: Scratch) -> DataFrame:
    """The estimate of every group: all vectors, each language, each source of a language."""
    sums = [F.count("*").alias("n"), F.max("logdet").alias("logdet"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(XS))]
    sums += [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in PAIRS]
    fanned = vectors.select(F.explode(F.array("own", "language", F.lit(ALL))).alias("g"), *XS)

    def step(params: DataFrame, name: str) -> DataFrame:
        # one small row per group and start; whether they are broadcast is left to their size
        binned = fanned.join(params.select("g", "start", "centre", "precision", "logdet"), "g").withColumn("bin", _bin())
        return scratch.save(binned.groupBy("g", "start", "bin").agg(*sums).groupBy("g", "start").applyInPandas(_concentrate, _ESTIMATE), name, narrow=True)

    names = [n.split()[0] for n in _ESTIMATE.split(", ")]
    params = scratch.save(_starts(vectors, scratch), "starts", narrow=True)
    for k in range(FIRST_STEPS):
        before, params = params, step(params, f"first{k}")
        scratch.drop(before)
    best = params.groupBy("g").agg(F.min_by(F.struct(*names), F.struct("logdet", "start")).alias("p")).select("p.*")
    params = scratch.save(best, "best", narrow=True)
    done = []
    for k in range(MOST_STEPS):
        moved = step(params, f"step{k}")
        done.append(moved.where("rests"))
        params = moved.where("not rests")
        if params.isEmpty():
            break
    else:
        done.append(params)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def mixed(n: float, centre: np.ndarray, scatter: np.ndarray, base_centre: np.ndarray, base_scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The estimate from n vectors mixed with a base that counts like PRIOR vectors, and no
    tighter than TIGHT times the base's variance in any direction."""
    w = n / (n + PRIOR)
    scatter = w * scatter + (1 - w) * base_scatter
    root = np.linalg.cholesky(base_scatter)
    inverse = np.linalg.inv(root)
    value, vector = np.linalg.eigh(inverse @ scatter @ inverse.T)
    held = root @ (vector * np.maximum(value, TIGHT)) @ vector.T @ root.T
    return w * centre + (1 - w) * base_centre, (held + held.T) / 2


def _mix(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for r in frame.itertuples(index=False):
            level = [(getattr(r, f"n{k}"), np.array(getattr(r, f"centre{k}")), _full(np.array(getattr(r, f"scatter{k}")))) for k in ("o", "l", "a")]
            centre, scatter = level[2][1:]
            for n, c, s in (level[1], level[0]):
                centre, scatter = mixed(n, c, s, centre, scatter)
            out.append({"own": r.own, "language": r.language, "centre": centre.tolist(), "precision": _upper(np.linalg.inv(scatter))})
        if out:
            yield pd.DataFrame(out)


def _scaled(vectors: DataFrame, params: DataFrame) -> DataFrame:
    """``params`` with ``scale``: the median distance of a group over that of the normal law,
    mixed between source, language and all in logarithms like the estimates."""
    bins = vectors.join(params, ["own", "language"]).groupBy("own", "language", _bin().alias("bin")).agg(F.count("*").alias("n"))
    levels = bins.select(F.explode(F.array("own", "language", F.lit(ALL))).alias("g"), "bin", "n").groupBy("g", "bin").agg(F.sum("n").alias("n"))
    medians = levels.groupBy("g").agg(F.expr("percentile(bin, 0.5, n)").alias("m"), F.sum("n").alias("n"))
    at = lambda k: medians.select(F.col("g").alias(f"g{k}"), F.col("m").alias(f"m{k}"), F.col("n").alias(f"n{k}"))
    joined = params.join(at("o"), F.col("own") == F.col("go")).join(at("l"), F.col("language") == F.col("gl")).withColumn("all", F.lit(ALL)).join(at("a"), F.col("all") == F.col("ga"))
    mix = lambda n, m, base: (F.col(n) * F.col(m) + PRIOR * base) / (F.col(n) + PRIOR)
    middle = mix("no", "mo", mix("nl", "ml", F.col("ma")))
    return joined.select("own", "centre", "precision", (F.exp((middle + 0.5) / BINS) / MEDIAN).alias("scale"))


def judged(stats: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``counts`` with base_failed, distance and kept. ``stats`` should be a
    written table: it is read twice."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    base = stats.withColumn("base_failed", failed)
    vectors = scratch.save(base.where("not base_failed").select(_group("source", "lang", "source").alias("own"), _group("language", "lang").alias("language"), *_vector()).distinct(), "vectors", narrow=True)
    found = scratch.save(estimates(vectors, scratch), "estimates", narrow=True)
    at = lambda k: found.select(F.col("g").alias(f"g{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("n", "centre", "scatter")])
    groups = vectors.select("own", "language").distinct().withColumn("all", F.lit(ALL))
    nested = groups.join(at("o"), F.col("own") == F.col("go")).join(at("l"), F.col("language") == F.col("gl")).join(at("a"), F.col("all") == F.col("ga"))
    params = scratch.save(nested.mapInPandas(_mix, "own string, language string, centre array<double>, precision array<double>"), "mixed", narrow=True)
    final = scratch.save(_scaled(vectors, params), "final", narrow=True)
    scored = base.select("*", _group("source", "lang", "source").alias("own"), *_vector()).join(final, "own", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance() / F.col("scale")))
    return scored.select(*[F.col(c) for c in stats.columns], "base_failed", "distance", (~F.col("base_failed") & (F.col("distance") <= CUTOFF)).alias("kept"))


def quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, the base counts, ``base_failed``, ``distance`` and ``kept``."""
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.save(counts(docs, text), "stats")
    return judged(stats, scratch).select("doc_id", *BASE, "base_failed", "distance", "kept")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass. Rows of one doc_id go together: they stay only if
    none of them is rejected; rows without doc_id stay."""
    rejected = quality(docs).where(~F.col("kept")).select(F.col("doc_id").alias("__qs_id")).distinct()
    return docs.join(rejected, docs["doc_id"] == F.col("__qs_id"), "left_anti")
