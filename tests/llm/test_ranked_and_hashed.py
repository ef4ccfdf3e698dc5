"""Ranked search, Merkle manifest and token counts against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from quillspark.llm import op11_wand, op12_merkle, op13_counts, queries
from tests.llm.test_text_operators import docs_of, edge_docs, prose

JSON = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(JSON)


# 11


def plain_terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text or "")]


def plain_ranks(docs, items, k=10):
    """[(item, rank, doc, score)] by scoring every document."""
    bags = [(d, Counter(plain_terms(t))) for d, t in docs]
    bags = [(d, c) for d, c in bags if c]
    n, length = len(bags), sum(sum(c.values()) for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in bags:
            m = 25 + (75 * sum(c.values()) * n) // length
            s = sum(x * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, x in Counter(plain_terms(text)).items() if t in c)
            if s:
                scored.append((-s, d is not None, d or 0, d))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def ranks(found):
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_search_of_odd_rows(spark):
    docs = edge_docs(spark)
    items = [(1, "W3x w4X no ID here"), (2, None), (3, ""), (4, "ünïcode 漢字 ÜNÏCODE end end"), (None, "a x"), (5, "w1x " * 50 + "w2x"), (6, "absent")]
    asked = spark.createDataFrame([*items, items[0]], "item_id long, text string").withColumn("score", F.lit("clash"))
    plain = plain_ranks([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], items)
    assert ranks(op11_wand.search(docs, asked, query_id="item_id")) == plain and len({r[0] for r in plain}) == 4


def test_search_in_small_shards_and_slices(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(i, prose(rng, rng.randrange(60), 40)) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(30)]  # ties beyond the k best
    items = [(i, prose(rng, 6, 40)) for i in range(20)] + [(99, docs[7][1])]
    plain = plain_ranks(docs, items)
    for shard, sliced, stretch in ((2_000_000, 2_000_000, 64), (50, 40, 4)):
        monkeypatch.setattr(op11_wand, "SHARD_POSTINGS", shard)
        monkeypatch.setattr(op11_wand, "SLICE_ROWS", sliced)
        monkeypatch.setattr(op11_wand, "SHARD_DOCS", stretch * 128)
        found = op11_wand.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "query_id long, text string"))
        assert ranks(found) == plain


def test_search_with_text_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x")], "doc_id string, text string")
    asked = spark.createDataFrame([("q", "x y y")], "query_id string, text string")
    assert [r["doc_id"] for r in op11_wand.search(docs, asked).orderBy("rank").collect()][:2] == ["a", "b"]
    assert op11_wand.search(docs.limit(0), asked).count() == 0 and op11_wand.search(docs, asked.limit(0)).count() == 0
    assert op11_wand.search(docs.limit(0), asked).columns == op11_wand.search(docs, asked).columns


def _scalar_wand(lists, most, k):
    """The cursor form of the method: documents it scores, and the k best scores."""
    at, heap, scored = {t: 0 for t in lists}, [], []
    while True:
        live = sorted((lists[t][at[t]][0], t) for t in lists if at[t] < len(lists[t]))
        low = heap[0] if len(heap) == k else 0
        total = 0
        for d, t in live:
            total += most[t]
            if total > low:
                break
        else:
            return scored, heap
        if live[0][0] == d:
            score = sum(lists[t][at[t]][1] for x, t in live if x == d)
            scored.append(d)
            heap = sorted([*heap, score])[-k:]
            for x, t in live:
                at[t] += x == d
        else:
            for x, t in live:
                while x < d and at[t] < len(lists[t]) and lists[t][at[t]][0] < d:
                    at[t] += 1


def test_pivots_are_those_of_the_cursor_form():
    """With a warm heap both forms score the same documents, a small part of all."""
    rng = np.random.default_rng(3)
    n, words, k = 3000, 30, 10
    lists = {t: [(d, int(rng.integers(1, 1000) * (t + 1) ** 2)) for d in np.flatnonzero(rng.random(n) < 0.5 / (t + 1)).tolist()] for t in range(words)}
    by_doc = sorted((d, t, x) for t, v in lists.items() for d, x in v)
    sizes = np.bincount([r[0] for r in by_doc], minlength=n)
    shard = op11_wand.Shard(sizes, np.array([r[1] for r in by_doc]), np.array([r[2] for r in by_doc]), words)
    exact = np.zeros(n, np.int64)
    for d, _, x in by_doc:
        exact[d] += x
    most = {t: max(x for _, x in v) for t, v in lists.items() if v}
    tenth = int(np.sort(exact)[-k])
    every = np.arange(words)
    docs, scores, scored = shard.best(every, np.ones(words, np.int64), k, tenth, True)
    assert sorted(scores)[-k:] == sorted(exact)[-k:] and (exact[docs] == scores).all()
    cursor, heap = _scalar_wand({t: v for t, v in lists.items() if v}, most, k)
    assert sorted(heap) == sorted(exact)[-k:]
    reached = sum(sum(most[t] for t in lists if t in held) >= tenth for held in ({t for x, t, _ in by_doc if x == d} for d in range(300)))
    assert 0 < scored < n / 3 and scored <= len(cursor) and reached <= 300
    cold = shard.best(every, np.ones(words, np.int64), k, 0, False)
    assert sorted(cold[1])[-k:] == sorted(exact)[-k:] and cold[2] < n


# 12


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows):
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by_lang = {}
    for d, source, lang, n, text in rows:
        leaf = sha("".join(map(told, (d, source, lang, n, text))))
        changed = leaf
        if d is not None and zlib.crc32(str(d).encode()) % 3 == 0 and text is not None:
            changed = sha("".join(map(told, (d, source, lang, n, re.sub("[A-Z]", lambda m: m[0].lower(), text)))))
        by_lang.setdefault(lang, []).append((d, leaf, changed))

    def climb(nodes):
        """The root, and of each node the siblings of each level as (left, right)."""
        ways, place = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for way, i in zip(ways, place, strict=True):
                run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
                way.append((run[: i % 8], run[i % 8 + 1 :]))
            place = [i // 8 for i in place]
            nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        return nodes[0], ways

    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    for v in by_lang.values():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = [climb([r[1] for r in by_lang[x]]) for x in langs]
    root, over = climb([t[0] for t in trees])
    out = []
    for lang, (subroot, ways), above in zip(langs, trees, over, strict=True):
        for (d, leaf, node), way in zip(by_lang[lang], ways, strict=True):
            proof = sha("".join("".join(a) + "".join(b) for a, b in way + above))
            for a, b in way + above:
                node = sha("".join(a) + node + "".join(b))
            out.append((d, leaf, subroot, root, proof, node, node == root))
    return sorted(out, key=repr)


def manifest_rows(df):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r[c] for c in names) for r in op12_merkle.manifest(df).collect()), key=repr)


@pytest.mark.parametrize(("top", "levels", "langs", "n"), [(512, 4, ["en"], 1), (512, 4, ["en"] * 9 + ["de", None], 650), (4, 1, ["en"] * 20 + [None, "de", *"abcdefghijkl"], 600), (3, 2, ["en"] * 20 + ["de", "fr"], 700), (1, 1, ["é"], 65)])
def test_manifest(spark, monkeypatch, top, levels, langs, n):
    """Also with so small a top that blocks are reduced in several rounds."""
    monkeypatch.setattr(op12_merkle, "TOP", top)
    monkeypatch.setattr(op12_merkle, "LEVELS", levels)
    rng = random.Random(n)
    rows = [(None if rng.random() < 0.03 else 10**17 + rng.randrange(10**6), rng.choice(["s", None]), rng.choice(langs), rng.choice([None, 5]), rng.choice([None, "", "Ab ÉÀ Z", "lower", prose(rng, 20).upper()])) for _ in range(n)]
    rows.append(rows[0])
    got = manifest_rows(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))
    assert got == plain_manifest(rows)


def test_manifest_of_the_tables_and_of_odd_rows(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in df.collect()]
    got = manifest_rows(df)
    assert got == plain_manifest(rows) and {r[6] for r in got} == {True, False}
    odd = edge_docs(spark)
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in odd.collect()]
    assert manifest_rows(odd) == plain_manifest(rows)
    assert manifest_rows(odd.limit(0)) == []


# 13


def test_counts_are_those_of_the_library(spark, sf_dir):
    own = op13_counts.counter(JSON)
    assert own.merges.at_once
    texts = [t for _, t, *_ in docs_of(spark, sf_dir)]
    assert own.count(texts).tolist() == [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aaabAB 12\n\t'sre.,!é漢ßไ🙂‍ \x85\xa0<|>"), st.characters(blacklist_categories=("Cs",))), max_size=60), st.booleans())
def test_any_text_counts_as_the_library_has_it(text, special):
    text = f"{text}<|endoftext|>{text}" if special else text
    assert op13_counts.counter(JSON).count([text])[0] == len(LIBRARY.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ["a" * 300_000, " " * 100_000, "ab" * 100_000, "漢" * 30_000, "".join(random.Random(2).choices("abcdefgh", k=30_000))])
def test_long_runs(text):
    assert op13_counts.counter(JSON).count([text, None, "", text]).tolist() == [n := len(LIBRARY.encode(text, add_special_tokens=False).ids), 0, 0, n]


def test_merges_one_by_one_where_ranks_fall():
    """A vocabulary where a pair of a merged symbol ranks below the merge."""
    base = {c: i for i, c in enumerate(op13_counts.BYTE_CHARS)}
    vocab = base | {"aba": 300, "ab": 301}
    pairs, words = [("ab", "a"), ("a", "b")], ["abab", "abaab", "ababa", "a", "ababab"]
    merges, library = op13_counts.Merges(vocab, pairs), models.BPE(vocab, pairs)
    assert not merges.at_once and merges.counts([w.encode() for w in words]).tolist() == [len(library.tokenize(w)) for w in words]
    with pytest.raises(ValueError):
        op13_counts.Counter(public_tokenizers.path("word_bpe_49k.json"))


def test_count_rows(spark):
    docs = edge_docs(spark)
    got = op13_counts.token_counts(docs, JSON, limit=20)
    want = [(r["doc_id"], len((r["text"] or "").encode()), n := len(LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids), n > 20) for r in docs.collect()]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert got.limit(0).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and op13_counts.token_counts(docs.limit(0), JSON).count() == 0
    assert {"op11_lexical_search", "op12_merkle_manifest", "op13_token_counts"} <= set(queries.QUERIES)
