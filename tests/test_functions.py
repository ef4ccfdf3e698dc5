import math
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import similarity as sim
from quillspark.functions import text as tx
from quillspark.functions import weighting as wt
from quillspark.functions.porter import stem
from quillspark.operators import features


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, "Ça a 1 aa, der_Weg x9!", tx.tokens) == ["ça", "aa", "der_weg", "x9"]
    assert one(spark, None, tx.tokens) == []


def test_ngrams(spark):
    assert one(spark, "aa bb cc", lambda t: tx.ngrams(tx.tokens(t), (1, 2))) == ["aa", "bb", "cc", "aa bb", "bb cc"]
    assert one(spark, "aa", lambda t: tx.ngrams(tx.tokens(t), (2, 3))) == []
    assert one(spark, "aA  b", lambda t: tx.char_ngrams(t, (2, 2))) == ["aa", "a ", " b"]
    assert one(spark, "ab c", lambda t: tx.char_wb_ngrams(t, (3, 4))) == [" ab", "ab ", " ab ", " c "]
    assert one(spark, None, lambda t: tx.char_wb_ngrams(t, (3, 3))) == []
    with pytest.raises(ValueError):
        tx.ngrams(F.array(), (2, 1))


def test_headers(spark):
    assert one(spark, "To: a\n  From: b\nCC: c\nSubject: d\nbody To: e", tx.ignore_headers) == "CC: c\nSubject: d\nbody To: e"
    with pytest.raises(ValueError):
        tx.preprocess(F.lit(""), ("nothing",))


def test_decode_drops_invalid_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb\xc3\xa9\xc3"),)], "b binary")
    assert df.select(tx.decode_utf8(F.col("b"))).first()[0] == "abé"


@pytest.mark.parametrize(("word", "expected"), [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("goodness", "good"), ("revival", "reviv"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"), ("sky", "sky"), ("apples", "appl")])
def test_porter(word, expected):
    assert stem(word) == expected


def test_scales(spark):
    df = spark.createDataFrame([(0.70710678,), (-0.5,), (0.5,)], "s double")
    for scale in sim.SCALES[:4]:
        for r in df.select("s", sim.to_cosine(sim.from_cosine(F.col("s"), scale), scale).alias("b")).collect():
            assert r["b"] == pytest.approx(r["s"])
    assert [r[0] for r in df.select(sim.from_cosine(F.col("s"), "cosine-positive")).collect()] == [0.70710678, 0.0, 0.5]
    assert df.select(sim.from_cosine(F.col("s"), "jaccard")).first()[0] == pytest.approx(0.547, abs=1e-3)
    with pytest.raises(ValueError):
        sim.from_cosine(F.lit(1.0), "other")


# The textbook example of the projection tests, with a short and an empty text.
DOCS = [(0, "Shipment of gold damaged in aa fire."), (1, "Delivery of silver arrived in aa silver truck."), (2, "Shipment of gold arrived in aa truck."), (3, "short sentence"), (4, "")]


@pytest.fixture(scope="module")
def tf(spark):
    return features.term_frequencies(spark.createDataFrame(DOCS, "doc_id long, text string")).cache()


ALL = [t + i + n for t in wt.TF for i in wt.IDF for n in ("n", "c", "l", "u", "cp", "lp", "up")]


def test_schemes_parse():
    assert len(ALL) == 210
    for s in ALL:
        assert wt.parse_scheme(s)[3] == s.endswith("p", 3)
    for bad in ("xxx", "nn", "nnnp", "nncpp"):
        with pytest.raises(ValueError):
            wt.parse_scheme(bad)
    with pytest.raises(NotImplementedError):
        wt.parse_scheme("nnb")


@pytest.mark.parametrize("scheme", ["nnc", "ltc", "asu", "Ldl", "lncp", "btlp", "dsup"])
def test_weights_of_small_corpus(spark, tf, scheme):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    model = features.fit(docs, features.FeatureParams(weighting=scheme), tf=tf)
    w = {}
    for r in model.weigh(tf).collect():
        w.setdefault(r["doc_id"], {})[r["term"]] = r["weight"]
    assert 4 not in w and set(w) == {0, 1, 2, 3}
    if scheme[2:] == "c":
        assert all(sum(x * x for x in d.values()) == pytest.approx(1) for d in w.values())
    if scheme[1] not in "pd":
        assert all(x >= 0 for d in w.values() for x in d.values())


def test_every_scheme_against_plain_version(spark, tf):
    """All 210 in one query: the letters' expressions, norms and pivots, against plain Python."""
    df = features.document_frequencies(tf)
    n = 5
    at = lambda *letters: "_".join({"L": "mean"}.get(x, x) for x in letters)  # noqa: E731  column names know no case
    raw = tf.join(df, "term").select("doc_id", "term", "tf", "df", *[(wt.TF[t](F.col("tf")) * wt.IDF[i](F.col("df"), F.lit(n))).alias(at(t, i)) for t in wt.TF for i in wt.IDF])
    norms = raw.select("*", *[wt.NORM[k](F.col(at(t, i))).alias(at(t, i, k)) for t in wt.TF for i in wt.IDF for k in wt.NORM])
    rows = norms.collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    plain_tf = {"n": lambda x, d: x, "l": lambda x, d: 1 + math.log(x), "d": lambda x, d: 1 + math.log(1 + math.log(x)), "a": lambda x, d: 0.5 + 0.5 * x / max(d), "b": lambda x, d: 1, "L": lambda x, d: (1 + math.log(x)) / (1 + math.log(sum(d) / len(d)))}
    plain_idf = {"n": lambda f: 1, "t": lambda f: math.log(n / f) + 1, "s": lambda f: math.log((n + 1) / (f + 1)) + 1, "p": lambda f: math.log((n - f) / f), "d": lambda f: math.log((n + 1 - f) / (f + 1))}
    plain_norm = {"c": lambda w: math.sqrt(sum(x * x for x in w)), "l": lambda w: sum(abs(x) for x in w), "u": len}
    for s in ALL:
        t, i, k, _ = wt.parse_scheme(s)
        for doc in by.values():
            counts = [r["tf"] for r in doc]
            w = [plain_tf[t](r["tf"], counts) * plain_idf[i](r["df"]) for r in doc]
            assert [r[at(t, i)] for r in doc] == pytest.approx(w), s
            assert k == "n" or doc[0][at(t, i, k)] == pytest.approx(plain_norm[k](w)), s


def test_weights_need_no_fit_without_frequencies(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    for params in (features.FeatureParams(), features.FeatureParams(weighting="ltc"), features.FeatureParams(min_df=2), features.FeatureParams(weighting="lncp"), features.FeatureParams(use_hashing=True, n_features=7)):
        own = {(r[0], r[1]): r[2] for r in features.weights(docs, params).collect()}
        assert own == pytest.approx({(r[0], r[1]): r[2] for r in features.fit(docs, params).transform(docs).collect()})


def test_words_are_those_of_plain_python(spark):
    texts = ["Don't stop x yy_z 3 42", "naïve Straße ПРИВЕТ мир 日本語 テスト", "cafe\u0301 हिन्दी १२", "a b c", ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tx.tokens(F.col("t"))).collect()]
    assert got == [re.findall(r"\b\w\w+\b", t.lower()) for t in texts]


def test_pivot_with_alpha_one_is_plain(spark, tf):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    plain = features.fit(docs, features.FeatureParams(weighting="nnc"), tf=tf).weigh(tf)
    pivoted = features.fit(docs, features.FeatureParams(weighting="nncp", norm_alpha=1.0), tf=tf).weigh(tf)
    a = {(r[0], r[1]): r[2] for r in plain.collect()}
    assert a == pytest.approx({(r[0], r[1]): r[2] for r in pivoted.collect()})


def test_feature_params():
    for bad in ({"analyzer": "x"}, {"stop_words": "english_alphanumeric"}, {"weighting": "zzz"}):
        with pytest.raises(ValueError):
            features.FeatureParams(**bad)
