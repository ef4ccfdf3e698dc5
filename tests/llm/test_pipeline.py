import base64
import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from quillspark.llm import op3_quality
from tests.llm import brute
from tests.llm.test_text_operators import edge_docs


def test_pipeline_against_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    # the estimates of the first stage are held against a plain version in the tests of the operator
    kept = {r["doc_id"]: r["kept"] for r in op3_quality.quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    vectors = brute.quality_vectors(docs)
    assert {d for d, k in kept.items() if k} <= set(vectors) and sum(kept.values()) > 0.8 * len(vectors)
    rows = brute.line_dedup([(d, t) for d, t, _, _ in docs if kept[d]])
    classes = brute.near_classes(sorted(rows.items()))
    rows = {d: t for d, t in rows.items() if classes[d] == d}
    shared = lambda t: [i for i in items if set(brute.grams(i[1])) & set(brute.grams(t))]
    leaks = {d for d, t in rows.items() if brute.contaminated([(d, t)], shared(t))}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = {}
    for d, t in rows.items():
        if d not in leaks:
            ids = enc.encode_ordinary(t)
            expected[d] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert {r["doc_id"]: tuple(r)[1:] for r in corpus_pipeline.run(spark, sf_dir).collect()} == expected and leaks


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_with_nulls_clashing_columns_and_empty_tables(spark, sf_dir):
    docs = edge_docs(spark)
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    rows = kept.collect()
    assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.collect()} and 5 in {r["doc_id"] for r in rows}
    out = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
    assert out.count() == len(rows) and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf_dir).count() == 0
