import base64
import hashlib
import html as htmllib
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspark.llm import bpe, op1_html, op2_lines, op3_quality, op4_decontam, op5_probminhash, op6_bpe, op7_chat, op8_suffix, op9_license, op10_dac, queries, shingles
from tests.comparing import assert_same, sql_rows
from tests.llm import brute

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Columns that clash with names the operators use, with a null in each.
CLASHING = ["lang", "source", "n_chars", "key", "class_id", "doc", "at", "gone", "n_lines", "ids", "start", "rep", "label", "n", "a", "b", "ranges", "kept", "part", "place"]


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}x" for _ in range(n))


def edge_docs(spark):
    rng = random.Random(7)
    long = prose(rng, 30_000, 5000)
    rows = [(1, prose(rng, 80)), (2, None), (3, ""), (4, " \n\t\n"), (5, long), (6, prose(rng, 80)), (6, None), (7, "a"), (8, "ünïcode “quotes” 漢字 <|endoftext|> end"), (9, "x\n\nx\nx\nx"), (None, "no id here\nat all"), (10, long)]
    rows.append(rows[0])
    return spark.createDataFrame([(d, t, *([None] * len(CLASHING) if i % 2 else map(str, range(len(CLASHING))))) for i, (d, t) in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING))


def docs_of(spark, sf_dir):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), *sql_rows(queries.ORACLES[name], sf_dir))


# 1


def article(page):
    body = re.search(r"<article>(.*)</article>", page, re.S).group(1)
    blocks = [" ".join(htmllib.unescape(re.sub(r"<br>|</?b>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("unit", ['<div class="x" ', "<a ", "<!-- x ", "</a ", "<?x ", "<!x ", "<a b='>'", '<a b="x>', "<div><b>", "<p><i>x", "<ul><li>x"])
def test_malformed_long_pages_take_linear_time(unit):
    body = "real text of the article " * 20
    began = time.perf_counter()
    text = op1_html.main_text(f"<article><p>{body}</p></article>{unit * (1_000_000 // len(unit))}")
    assert " ".join(body.split()) in text and time.perf_counter() - began < 20


def test_pages(spark, sf_dir):
    rows = {r["page_id"]: r for r in op1_html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()}
    for p in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        assert rows[p["page_id"]]["text"] == article(p["html"]) and rows[p["page_id"]]["n_chars"] == len(article(p["html"]))


PAGE = """<html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site</h1></header>
<div class="cookie-notice">We use cookies <button>OK</button></div><div id="wrap"><div class="content"><h2>The heading</h2>
<p>First   paragraph with &eacute;nough words, a <a href=x>link</a> and more of them.<p>Second one &lt;here&gt; &amp; there, with some more text in it too.</div>
<div class="sidebar"><p>Aside text</div><div id="comments"><p>A long comment of a reader on the article that has many words in it.</div><form>Name <input></form></div>
<script>document.write("<p>no</p>")</script><footer>(c)</footer></body></html>"""


def test_page_without_article():
    expected = "The heading\nFirst paragraph with énough words, a link and more of them.\nSecond one <here> & there, with some more text in it too."
    assert op1_html.main_text(PAGE) == expected
    assert op1_html.main_text(PAGE.replace('<div class="content">', "<article>").replace('too.</div>', "too.</article>")) == expected


@pytest.mark.parametrize("page", [None, "", "   ", "<p>", "<nav><a>x</a></nav>", "<![x[ <!-- ", "<script>x", "<ul><li>a<li>b", "a < b", "&#x;&"])
def test_odd_pages(page):
    assert isinstance(op1_html.main_text(page), str)


OTHER = ["ad", "ad-slot top", "adBox", "siteFooter", "cookieBanner", "main-nav", "commentlist", "reader-comments", "post_comments", "related-posts", "sideBar", "notice notice-info", "newsletter"]
OWN = "<p>Some words of the article itself, with a good length too.</p><p>More words of the article, in a second line of it.</p>"


@pytest.mark.parametrize("name", OTHER)
def test_marked_parts_are_left_out(name):
    part = "<p>Other words that are many and long enough to look like an article, all of them in one line.</p>"
    expected = op1_html.main_text(f"<body><article>{OWN}</article></body>")
    assert expected.count("\n") == 1
    for kind in ("class", "id"):
        for page in (f"<body><article>{OWN}</article><div {kind}='{name}'>{part}</div></body>", f"<body><article>{OWN}<section {kind}='{name}'>{part}</section></article></body>"):
            assert op1_html.main_text(page) == expected


@pytest.mark.parametrize("name", ["content", "has-sidebar", "with-ads", "header-image-post", "shadow", "commentary", "navy", "download", "thread", *OTHER])
def test_names_alone_lose_no_content(name):
    page = f"<body><div class='{name}'><p>{'Some words of the article itself. ' * 9}</p><p>{'More of them here. ' * 9}</p></div><p>(c) 2020</p></body>"
    assert op1_html.main_text(page).startswith("Some words of the article itself. Some") and "More of them" in op1_html.main_text(page)


def test_parts_of_an_article():
    page = f"<article><header><h1>Title</h1><p>by X, 5 min</p></header>{OWN}<p class='widget-price'>9.99 a piece</p>{OWN}</article><article><h2>Next</h2>{OWN}</article>"
    own = ["Some words of the article itself, with a good length too.", "More words of the article, in a second line of it."]
    assert op1_html.main_text(page).split("\n") == ["Title", *own, "9.99 a piece", *own, "Next", *own]
    assert op1_html.main_text(f"<form><div class='main'>{OWN}</div><input></form>").split("\n") == own


def test_the_clustering_decides(spark, sf_dir, monkeypatch):
    pages = [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect()]
    own = [op1_html.main_text(p) for p in pages]
    monkeypatch.setattr(op1_html, "heavy", lambda r: np.ones(len(r), bool))
    assert all(op1_html.main_text(p) != t for p, t in zip(pages, own, strict=True))


def test_deep_nesting_is_linear():
    import tracemalloc

    tracemalloc.start()
    assert op1_html.main_text("<div>x" * 30_000).count("x") == 30_000
    assert tracemalloc.get_traced_memory()[1] < 30_000_000
    tracemalloc.stop()


def plain_lines(rng):
    """A random page as a tree, and its lines as (text, characters in links, path of containers)."""
    lines, html, n = [], [], [0]

    def grow(path, depth):
        for _ in range(rng.randint(1, 5)):
            if depth < 3 and rng.random() < 0.4:
                n[0] += 1
                tag = "article" if not any(t == "article" for t, _ in path) and rng.random() < 0.2 else "div"
                html.append(f"<{tag}>")
                grow((*path, (tag, n[0])), depth + 1)
                html.append(f"</{tag}>")
            else:
                text = " ".join("word" for _ in range(rng.choice([1, 2, 3, 30, 60])))
                link = rng.random() < 0.3
                html.append(f"<p><a href=x>{text}</a></p>" if link else f"<p>{text}</p>")
                lines.append((text, len(text) if link else 0, path, 3 if link else 1))

    grow((("page", 0),), 0)
    return "".join(html), lines


def plain_clusters(values):
    low = sum(values) / len(values)
    for _ in range(50):
        high, rest = [v for v in values if v >= low], [v for v in values if v < low]
        if not high or not rest:
            return [True] * len(values)
        middle = (sum(high) / len(high) + sum(rest) / len(rest)) / 2
        if abs(middle - low) < 1e-9:
            break
        low = middle
    return [v >= low for v in values]


def plain_text(page_lines, tags):
    ratios = [(len(t) - k) / g for (t, k, _, _), g in zip(page_lines, tags, strict=True)]
    smoothed = []
    for i in range(len(ratios)):
        w = [(math.exp(-0.5 * ((i - j) / 1.5) ** 2), r) for j, r in enumerate(ratios) if abs(i - j) <= 5]
        smoothed.append(sum(a * b for a, b in w) / sum(a for a, _ in w))
    on, alone = plain_clusters([math.log1p(x) for x in smoothed]), plain_clusters([math.log1p(x) for x in ratios])
    article = [next((n for t, n in path if t == "article"), None) for _, _, path, _ in page_lines]
    on = [a or (b and h is not None) for a, b, h in zip(on, alone, article, strict=True)]
    out = []
    for i, (text, link, path, _) in enumerate(page_lines):
        keep = on[i] or (article[i] is not None and any(o and h == article[i] for o, h in zip(on, article, strict=True)))
        if not keep and article[i] is None and 2 * link <= len(text):
            for depth in range(len(path), 0, -1):
                if any(o and p == path[:depth] for o, (_, _, p, _) in zip(on, page_lines, strict=True)):
                    inside = [j for j, (_, _, p, _) in enumerate(page_lines) if on[j] and p[:depth] == path[:depth]]
                    keep = depth == len(path) or min(inside) < i < max(inside)
                    break
        if keep:
            out.append(text)
    return "\n".join(out)


@pytest.mark.parametrize("seed", range(60))
def test_regions_against_brute_force(seed):
    html, lines = plain_lines(random.Random(seed))
    page = op1_html.PageLines()
    page.feed(html)
    page.close()
    assert page.text == [t for t, _, _, _ in lines] and page.link == [k for _, k, _, _ in lines]
    assert op1_html.main_text(html) == plain_text(lines, page.tags)


def test_edge_pages(spark):
    rows = [(1, None, None, "x"), (2, "u", "", None), (2, "u", "", None), (3, "u", "<p>" + "word " * 200_000 + "</p>", "y")]
    out = op1_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).orderBy("page_id").collect()
    assert [r["n_chars"] for r in out] == [0, 0, 0, 999_999]
    assert op1_html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# 2


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(1)
    lines = [prose(rng, 3) for _ in range(12)] + ["", " "]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 12)))) for i in range(60)]
    out = op2_lines.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    expected = brute.line_dedup(docs)
    assert {r["doc_id"]: r["text"] for r in out} == expected
    for r in out:
        text = dict(docs)[r["doc_id"]]
        assert r["n_lines"] == len(text.split("\n")) and r["n_removed"] == r["n_lines"] - (len(r["text"].split("\n")) if r["n_removed"] < r["n_lines"] else 0)


def test_line_dedup_edges(spark):
    docs = edge_docs(spark)
    out = op2_lines.strip_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    rows = {r["doc_id"]: r["text"] for r in out.where("coalesce(doc_id, 0) not in (1, 6)").collect()}
    assert rows[2] is None and rows[3] == "" and rows[9] == "x\n" and rows[None] == "no id here\nat all"
    assert op2_lines.dedup(docs.limit(0)).count() == 0


def test_line_dedup_of_long_single_lines(spark):
    rng = random.Random(2)
    passage, short = prose(rng, 60), prose(rng, 50)
    docs = [(1, passage), (2, f"own a\n{passage}\nown b"), (3, passage), (4, f"own c\n{short}\nown d"), (5, f"own e\n{short}\nown f"), (6, f"{passage}\nown g\n{passage}")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    out = {r["doc_id"]: r["text"] for r in op2_lines.dedup(df).collect()}
    assert out == {**dict(docs), 2: "own a\nown b", 3: "", 6: "own g"} == brute.line_dedup(docs)


def test_every_pair_of_lines_has_a_selected_line(spark):
    """And lines are selected once: fewer rows than windows."""
    rng = random.Random(8)
    docs = [(i, "\n".join(f"line {rng.randrange(400)}" for _ in range(300))) for i in range(10)]
    places = {(r["doc"], r["i"]) for r in op2_lines.fingerprints(spark.createDataFrame(docs, "doc_id long, text string"), "text").collect()}
    assert all((d, i) in places or (d, i + 1) in places for d in range(10) for i in range(299))
    assert len(places) < 0.72 * 10 * 300


def test_line_dedup_with_a_common_line(spark):
    """A line that all documents share, with neighbours that some share."""
    docs = [(i, f"own {i}\ncommon\nnext {i % 3}\nlast {i}") for i in range(40)]
    out = {r["doc_id"]: r["text"] for r in op2_lines.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == brute.line_dedup(docs) and out[39] == "own 39\nlast 39"


def test_line_dedup_is_native(spark, sf_dir):
    plan = op2_lines.dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 3


def test_base_counts_of_documents(spark, sf_dir):
    out = {r["doc_id"]: r for r in op3_quality.quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    for d, t, _, _ in docs_of(spark, sf_dir):
        r = out[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute.base_counts(t)
        assert r["base_failed"] == (r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"]) and (not r["base_failed"] or not r["kept"])


def test_quality_against_brute_force(spark):
    """Two sources a language, of 26 to 320 documents: verdicts of a plain FAST-MCD with exact
    subsets and many starts, but for distances close to the cutoff."""
    docs = [(d, t, lang, "ab"[int(source[3:]) < 8]) for d, t, lang, source in docs_of(spark, "/root/testdata/sf0.01")]
    out = {r["doc_id"]: r for r in op3_quality.quality(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}
    exact = brute.quality_distances(docs)
    ratio = [out[d]["distance"] / x for d, x in exact.items()]
    assert abs(np.log(np.median(ratio))) < 0.05 and np.quantile(np.abs(np.log(ratio)), 0.9) < 0.25
    far = {d: x for d, x in exact.items() if abs(np.log(x / op3_quality.CUTOFF)) > 0.35}
    assert len(far) > 0.95 * len(exact) and all(out[d]["kept"] == (x <= op3_quality.CUTOFF) for d, x in far.items())
    assert sum(not out[d]["kept"] for d in far) > 30


def test_determinant_is_as_low_as_that_of_many_starts(spark, tmp_path):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(op3_quality.P, op3_quality.P))
    rows = np.round(np.concatenate([rng.normal(size=(200, op3_quality.P)) @ mix, rng.normal(8, 0.3, size=(40, op3_quality.P))]) * op3_quality.UNIT).astype(int)
    df = spark.createDataFrame([("own", "lang", *map(int, r)) for r in rows], "own string, language string, " + ", ".join(f"{x} long" for x in op3_quality.XS))
    found = {r["g"]: r for r in op3_quality.estimates(df, op3_quality.Scratch(spark, "test")).collect()}
    _, centre, scatter = brute.mcd(rows / op3_quality.UNIT)
    assert set(found) == {"own", "lang", "all"}
    for r in found.values():
        assert r["logdet"] < np.linalg.slogdet(scatter)[1] + 0.05 and r["n"] == len(rows)
        assert np.allclose(r["centre"], centre, atol=0.15)


def test_the_estimated_covariance_decides(spark):
    """Texts of usual length and usual number of distinct words, but not together: only the
    covariance tells. And a source that is mostly copies of one text rejects no others."""
    rng = random.Random(6)

    def text(n, vocabulary):
        letters, dots, longest = "etaoinshrdlucmfwypvbgkjqxz"[: rng.randint(12, 26)], rng.uniform(0.05, 0.3), rng.randint(6, 11)
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, longest))) for _ in range(vocabulary)]
        return " ".join(rng.choice(words) + ("." if rng.random() < dots else "") for _ in range(n))

    rows = [(i, text(n := round(60 * 2 ** rng.uniform(0, 4)), round(n * rng.uniform(1, 3))), "en", f"s{i % 3}") for i in range(600)]
    odd = [(1000 + i, text(900, 80), "en", "s0") for i in range(5)]
    copies = [(2000 + i, rows[4][1], "en", "s1") for i in range(900)]
    out = {r["doc_id"]: r for r in op3_quality.quality(spark.createDataFrame(rows + odd + copies, "doc_id long, text string, lang string, source string")).collect()}
    vectors = brute.quality_vectors(rows + odd)
    m = np.array([vectors[d][2][:3] for d, *_ in rows])
    alone = lambda v: (np.abs(v - np.median(m, 0)) / m.std(0)).max()
    assert all(alone(np.array(vectors[d][2][:3])) < 2.6 and not out[d]["kept"] for d, *_ in odd)
    assert sum(not out[d]["kept"] for d, *_ in rows) <= 6 and all(out[d]["kept"] for d, *_ in copies)


def test_mixing_is_continuous():
    rng = np.random.default_rng(1)
    base, own = (np.cov(rng.normal(size=(5, 40))) for _ in range(2))
    zero = np.zeros(5)
    near = [op3_quality.mixed(n, zero + 1, own, zero, base) for n in (0, 1e-6, 1e9)]
    assert np.allclose(near[0][1], base) and np.allclose(near[1][1], near[0][1], atol=1e-5) and np.allclose(near[2][0], 1)
    assert np.allclose(op3_quality.mixed(1e9, zero, 0.01 * base, zero, base)[1], op3_quality.TIGHT * base)


def test_quality_edges(spark):
    docs = edge_docs(spark)
    out = op3_quality.quality(docs)
    assert out.count() == docs.count()
    assert all(not r["kept"] and r["base_failed"] for r in out.where("doc_id in (2, 3, 4, 7)").collect())
    assert op3_quality.quality(docs.limit(0)).count() == 0
    assert op3_quality.keep(docs).columns == docs.columns


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n\t#|é", max_size=60))
def test_base_counts(text):
    from quillspark.llm.textstats import base_counts

    assert base_counts(text) == brute.base_counts(text)


# 4


def test_decontamination_against_brute_force(spark):
    rng = random.Random(2)
    items = [(i, prose(rng, n, 60)) for i, n in enumerate([30, 30, 12, 5, 3, 40])] + [(6, None), (7, ""), (8, "dup dup dup dup dup dup dup"), (9, prose(rng, 25, 60))]
    items.append((10, items[0][1]))
    docs = []
    for i in range(40):
        words = prose(rng, rng.randrange(0, 60), 60).split()
        for _ in range(rng.randrange(0, 3)):
            own = (rng.choice(items)[1] or "").split()
            if own and rng.random() < 0.4:
                own[rng.randrange(len(own))] = "other"
            k = rng.randrange(len(words) + 1)
            words[k:k] = own
        docs.append((i, " ".join(words).upper() if i % 3 else " ".join(words)))
    out = op4_decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    expected = brute.contaminated(docs, items)
    assert {(r["doc_id"], r["item_id"]): (r["similarity"], r["first_word"]) for r in out} == {k: (pytest.approx(v[0]), v[1]) for k, v in expected.items()} and expected


def test_hamming_index_is_complete(monkeypatch):
    rng = np.random.default_rng(0)
    items = rng.integers(0, 2**63, 50).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, 50).astype(np.uint64)
    prints = np.concatenate([items ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, n, replace=False))) for n in (0, 5, 12, 19, 20, 24)])
    exact = {(i, j) for i, p in enumerate(prints) for j, q in enumerate(items) if int(p ^ q).bit_count() <= op4_decontam.RADIUS}
    among = np.full((len(prints), 7), 255, np.uint8)
    for bytes_, cells in ((op4_decontam.ROWS_BYTES, op4_decontam.CELLS), (7 * 64, 600)):  # the second forgets rows all the time
        monkeypatch.setattr(op4_decontam, "ROWS_BYTES", bytes_)
        monkeypatch.setattr(op4_decontam, "CELLS", cells)
        assert set(zip(*(x.tolist() for x in op4_decontam.Index(items).near(prints, among)), strict=True)) == exact
    odd = np.broadcast_to(np.packbits(np.arange(50) % 2 == 1), (len(prints), 7))
    assert set(zip(*(x.tolist() for x in op4_decontam.Index(items).near(prints, odd)), strict=True)) == {(i, j) for i, j in exact if j % 2}


def test_radius_holds_the_threshold():
    """Of windows just above the threshold, the radius loses less than one in a hundred."""
    rng, inside, total = np.random.default_rng(1), 0, 0
    for _ in range(6000):
        n = int(rng.integers(11, 80))
        own = rng.integers(0, 2**63, n).astype(np.uint64)
        other = own.copy()
        changed = rng.choice(n, int(rng.integers(1, 2 + n // 8)), replace=False)
        other[changed] = rng.integers(0, 2**63, len(changed)).astype(np.uint64)
        same = n - len(changed)
        if 0.8 <= same / (2 * n - same) < 0.84:
            a, b = (op4_decontam.simhash(op4_decontam.bit_sums(x)[-1:], n)[0] for x in (own, other))
            inside, total = inside + (int(a ^ b).bit_count() <= op4_decontam.RADIUS), total + 1
    assert total > 500 and inside / total > 0.99


def test_simhash_chooses_the_candidates(spark, monkeypatch):
    rng = random.Random(4)
    items = [(f"item {i}", prose(rng, 30, 10**6)) for i in range(40)]
    texts = [" ".join([prose(rng, 50, 10**6), " ".join(t.split()[:28]), prose(rng, 50, 10**6)]) for _, t in items]
    every, few = (op4_decontam.Benchmark(items, skip) for skip in (False, True))
    found = [every.hits(t, 0.8) for t in texts]
    assert found == [few.hits(t, 0.8) for t in texts] and sum(map(len, found)) >= 39
    monkeypatch.setattr(op4_decontam.Index, "near", lambda self, prints, among: (np.zeros(0, int), np.zeros(0, int)))
    assert not any(few.hits(t, 0.8) for t in texts)


def test_decontamination_of_long_texts_and_other_ids(spark, monkeypatch):
    monkeypatch.setattr(op4_decontam, "STRETCH", 64)
    rng = random.Random(11)
    items = [(f"i{k}", prose(rng, n, 10**6), k) for k, n in enumerate((12, 70, 40))]
    text = " ".join(x for _, t, _ in items for x in (prose(rng, 90, 10**6), t)) + " " + prose(rng, 70, 10**6)
    assert [h[:3] for h in op4_decontam.Benchmark([i[:2] for i in items]).hits(text, 0.8)] == [("i0", 1.0, 90), ("i1", 1.0, 192), ("i2", 1.0, 352)]
    docs = spark.createDataFrame([("d1", text, "x"), (None, text, None), ("d2", None, "y")], "doc_id string, text string, item_id string")
    out = op4_decontam.contaminated(docs, spark.createDataFrame(items, "item_id string, text string, doc_id long")).collect()
    assert sorted((r["doc_id"] or "", r["item_id"]) for r in out) == [(d, f"i{k}") for d in ("", "d1") for k in range(3)]


def test_decontamination_of_texts_shorter_than_the_item(spark):
    words = prose(random.Random(4), 60, 10**6).split()
    docs = [(1, words[:30] + words[31:]), (2, words[1:]), (3, words[:53]), (4, words[:45]), (5, words[:4]), (6, words)]
    out = op4_decontam.contaminated(spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string"), spark.createDataFrame([(0, " ".join(words))], "item_id long, text string")).collect()
    want = brute.grams(" ".join(words))
    expected = {}
    for d, w in docs:
        have = brute.grams(" ".join(w))
        low = sum((have & want).values())
        s = low / (sum(have.values()) + sum(want.values()) - low)
        if s >= op4_decontam.THRESHOLD:
            expected[d] = pytest.approx(s), 0, len(w)
    assert {r["doc_id"]: (r["similarity"], r["first_word"], r["n_words"]) for r in out} == expected and sorted(expected) == [1, 2, 3, 6]


def test_decontamination_edges(spark):
    docs, none = edge_docs(spark), spark.createDataFrame([], "item_id long, text string")
    assert op4_decontam.contaminated(docs, none).count() == 0
    one = spark.createDataFrame([(1, docs.where("doc_id = 1").first()["text"])], "item_id long, text string")
    assert {r["doc_id"] for r in op4_decontam.contaminated(docs, one).collect()} == {1}
    kept = op4_decontam.keep_clean(docs, one)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2


# 5


def test_near_dedup_against_brute_force(spark, sf_dir):
    docs = [(d, t) for d, t, _, _ in docs_of(spark, sf_dir)]
    out = {r["doc_id"]: r["class_id"] for r in op5_probminhash.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == brute.near_classes(docs) and len(set(out.values())) < len(out)


def test_chains_of_near_copies(spark):
    """Each text is near its neighbours only: links must not be lost behind the leader."""
    rng = random.Random(3)
    words = prose(rng, 400, 10**6).split()
    docs = [(100 - i, " ".join(words[i * 12 : i * 12 + 200])) for i in range(16)]
    docs += [(200 + i, " ".join([*words[:150], *prose(rng, 40 + i, 10**6).split()])) for i in range(12)]
    out = {r["doc_id"]: r["class_id"] for r in op5_probminhash.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == brute.near_classes(docs)


def test_estimate_and_exact_similarity():
    rng = np.random.default_rng(4)
    for _ in range(100):
        sets = []
        for _ in range(2):
            h = np.sort(rng.choice(15, rng.integers(1, 12), replace=False)).astype(np.uint64)
            sets.append((h, rng.integers(1, 5, len(h))))
        counts = [dict(zip(h.tolist(), w.tolist(), strict=True)) for h, w in sets]
        assert shingles.probability_jaccard(*sets) == pytest.approx(brute.probability_jaccard(*counts))
        i, j = op5_probminhash.block_links([sets[0]], [sets[1]], 0.5)
        assert (len(i) == 1) == (brute.probability_jaccard(*counts) >= 0.5)
    texts = [" ".join(f"a{i}" for i in range(k, k + 300)) for k in (0, 30)]
    e, w, o = shingles.flat_shingles(texts)
    s = op5_probminhash.signatures(e, w, o, 2)
    exact = shingles.probability_jaccard(*map(shingles.shingles, texts))
    assert abs((s[0] == s[1]).mean() - exact) < 0.12


def test_recall_of_linked_pairs(spark):
    """At a larger table, all pairs at the threshold or above by an inverted index are in one class."""
    docs = [(d, t) for d, t, _, _ in docs_of(spark, "/root/testdata/sf0.01")]
    out = {r["doc_id"]: r["class_id"] for r in op5_probminhash.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    grams = {d: brute.grams(t) for d, t in docs}
    where = {}
    for d, g in grams.items():
        for x in g:
            where.setdefault(x, []).append(d)
    pairs = {(a, b) for at in where.values() if len(at) < 60 for a in at for b in at if a < b}
    near = {(a, b) for a, b in pairs if len(grams[a].keys() & grams[b].keys()) > 0.3 * min(len(grams[a]), len(grams[b])) and brute.probability_jaccard(grams[a], grams[b]) >= op5_probminhash.THRESHOLD}
    assert len(near) > 80 and all(out[a] == out[b] for a, b in near)
    linked = {}
    for a, b in near:
        linked.setdefault(out[a], set()).update((a, b))
    assert all(len(c) == 1 or linked.get(k) == c for k, c in {k: {d for d in out if out[d] == k} for k in set(out.values())}.items() if len(c) > 1 and min(len(grams[d]) for d in c))


def test_near_dedup_edges(spark):
    docs = edge_docs(spark)
    out = {r["doc_id"]: r["class_id"] for r in op5_probminhash.classes(docs).collect()}
    assert out == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9, 10: 5}
    kept = op5_probminhash.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1
    assert op5_probminhash.classes(docs.limit(0)).count() == 0


# 6


def own_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoding():
    return own_encoding()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="a'ts \n\t=-é0", max_size=60)), max_size=5))
def test_ids_and_round_trip(texts):
    codec, enc = bpe.codec(RANKS, public_tokenizers.PATTERN), test_ids_and_round_trip.__dict__.setdefault("enc", own_encoding())
    ids, at = codec.encode(texts)
    for t, i, j in zip(texts, at, at[1:], strict=False):
        assert ids[i:j].tolist() == enc.encode_ordinary(t) and codec.decode(ids[i:j]) == t.encode()
        assert codec.char_offsets(ids[i:j]).tolist() == brute_offsets(enc, t)


def brute_offsets(enc, text):
    at, out, owner = 0, [], [k for k, c in enumerate(text) for _ in c.encode()]
    for i in enc.encode_ordinary(text):
        n = len(enc.decode_single_token_bytes(i))
        out.append([owner[at], owner[at + n - 1] + 1])
        at += n
    return out


def test_every_low_code_point_alone_and_among_others(encoding):
    """The own pattern for texts below U+0250 splits as the public one does."""
    codec = bpe.codec(RANKS, public_tokenizers.PATTERN)
    texts = [f"{left}{chr(c)}{right}" for c in range(bpe.FAST_BELOW) for left, right in (("", ""), ("a", "b"), (" ", " "), ("1", "'s"), ("  ", "x"), (".", "\n"))]
    ids, at = codec.encode(texts)
    assert [ids[i:j].tolist() for i, j in zip(at, at[1:], strict=False)] == [encoding.encode_ordinary(t) for t in texts]


def test_bpe_query(spark, sf_dir, encoding):
    out = {r["doc_id"]: tuple(r)[1:] for r in queries.op6_bpe_codec(spark, sf_dir).collect()}
    for d, t, _, _ in docs_of(spark, sf_dir):
        ids = encoding.encode_ordinary(t)
        assert out[d] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_bpe_edges(spark, encoding):
    docs = edge_docs(spark)
    coded = op6_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, offsets=True)
    assert set(coded.columns) == {*docs.columns, "char_start", "char_end"}
    back = op6_bpe.decode(coded, RANKS, public_tokenizers.PATTERN).collect()
    assert len(back) == docs.count()
    for r in back:
        assert bytes(r["decoded"]) == (r["text"] or "").encode() and r["ids"] == encoding.encode_ordinary(r["text"] or "")
    assert op6_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).count() == docs.count()
    assert op6_bpe.round_trip(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


# 7


def test_chats(spark):
    say = lambda c, *turns: [(c, k, r, t, None) for k, (r, t) in enumerate(turns)]
    a, b, c = ("user", "hi"), ("assistant", "yes"), ("user", None)
    rows = say(1, a) + say(2, a, b) + say(3, a, b, c) + say(4, a, b, c) + say(5, a, c) + say(6, b) + say(7, (None, "hi")) + [(None, 0, "user", "hi", None), (8, None, "user", "x", None), (8, 1, "user", "y", None), (8, 1, "user", "y", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string")
    out = {r["conv_id"]: r for r in op7_chat.format_chats(df).collect()}
    assert sorted(out) == [3, 5, 6, 7, 8]
    assert out[3]["n_copies"] == 2 and out[3]["text"] == "<|user|>\nhi\n<|end|>\n<|assistant|>\nyes\n<|end|>\n<|user|>\n\n<|end|>\n"
    assert out[8]["n_turns"] == 3 and out[7]["text"] == "<|unknown|>\nhi\n<|end|>\n"
    assert op7_chat.format_chats(df.limit(0)).count() == 0


def test_null_turns_differ_from_all_texts(spark):
    rows = [(1, 0, "user", None), (2, 0, "user", "\x00null"), (3, 0, "user", ""), (4, 0, None, "user"), (5, 0, "user", "null"), (6, 0, None, None), (7, 0, "user", None)]
    out = {r["conv_id"]: r["n_copies"] for r in op7_chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert out == {1: 2, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1}


def test_chats_with_long_texts(spark):
    rows = [(c, k, "user", "word " * 300_000 + str(k)) for c in (1, 2) for k in range(3)]
    out = op7_chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(r["conv_id"], r["n_turns"], r["n_copies"]) for r in out] == [(1, 3, 2)] and len(out[0]["text"]) > 4_500_000


def test_chats_sql_with_snapshots(spark):
    rng = random.Random(5)
    rows = []
    for conv in range(80):
        base = random.Random(rng.randrange(12))
        turns = [(base.choice(["user", "assistant"]), f"t{base.randrange(3)}") for _ in range(8)][: rng.randrange(1, 8)]
        rows += [(conv, k, r, t) for k, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert_same(op7_chat.format_chats(df), *sql_rows(queries.ORACLES["op7_chat_format"], frames={"conversations": df.toPandas()}))


# 8


def test_suffix_dedup_against_brute_force(spark, sf_dir):
    docs = [(d, t) for d, t, _, _ in docs_of(spark, sf_dir)]
    out = {r["doc_id"]: tuple(r)[1:] for r in queries.op8_suffix_dedup(spark, sf_dir).collect()}
    assert out == brute.repeated_bytes(docs)


def test_suffix_dedup_on_random_repeats(spark):
    rng = random.Random(3)
    some = lambda n: "".join(rng.choice("ab cdé") for _ in range(n))
    parts = [some(rng.randint(60, 400)) for _ in range(12)]
    piece = lambda: rng.choice([some(rng.randint(0, 80)), rng.choice(parts), rng.choice(parts)[rng.randint(0, 50) :], "a" * rng.randint(0, 300), "xy" * rng.randint(0, 100)])
    docs = [(i * 3 - 20, "".join(piece() for _ in range(rng.randint(0, 7)))) for i in range(200)] + [(5000, None), (5001, "")]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    for doubling in (False, True):
        out = {r["doc_id"]: tuple(r)[1:] for r in op8_suffix.dedup(df, doubling=doubling).collect()}
        assert out == brute.repeated_bytes(docs)


def test_colliding_hashes_delete_nothing(spark):
    """Strings whose first hashes are equal by chance are told apart by the second."""
    rows = [(7, 1, 1, 10, 0), (7, 2, 2, 20, 0), (7, 2, 3, 30, 0), (8, 2, 4, 40, 0)]
    out = op8_suffix.settle_strings(spark.createDataFrame(rows, "rank2 long, check int, doc long, start long, more int")).collect()
    assert [tuple(r) for r in out] == [(3, 30, 30)]
    spot = lambda place: place << 16
    rows = [(7, 9, 1, 1, spot(10)), (7, 9, 2, 2, spot(20)), (7, 9, 2, 3, spot(30))]
    out = {tuple(r) for r in op8_suffix.settle(spark.createDataFrame(rows, op8_suffix._RANKED.replace("bigint", "long"))).collect()}
    assert out == {(3, 30, 30, False), (1, 10, 10, True), (2, 20, 20, True)}
    raw = np.frombuffer(b"abcdefgh" * 40, np.uint8)
    begin = np.arange(200)
    pairs = [op8_suffix.Hashes(raw, base).of(begin, begin + 100) for base in (op8_suffix._BASE, op8_suffix._CHECK_BASE)]
    assert all(len(set(p.tolist())) == 8 for p in pairs) and not set(pairs[0].tolist()) & set(pairs[1].tolist())


def test_suffix_dedup_edges(spark, monkeypatch):
    docs = edge_docs(spark)
    out = op8_suffix.dedup(docs, with_kept=True)
    rows = out.collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[10]["n_removed"] == by[10]["n_bytes"] and by[10]["n_spans"] == 1 and bytes(by[10]["kept"]) == b""
    assert by[5]["n_removed"] == 0 and by[None]["n_removed"] == 0 and by[2]["n_bytes"] == 0
    assert all(r["n_removed"] == 0 for r in rows if r["doc_id"] == 1)
    named = spark.createDataFrame([("b", "same words " * 12), ("a", "same words " * 12), (None, "x" * 200), ("c", None)], "doc_id string, text string")
    assert sorted((r["doc_id"] or "", r["n_removed"]) for r in op8_suffix.dedup(named).collect()) == [("", 0), ("a", 121), ("b", 132), ("c", 0)]
    assert op8_suffix.dedup(docs.limit(0)).count() == 0


def test_pieces_of_long_texts_change_nothing(monkeypatch):
    rng = random.Random(9)
    text = "".join(rng.choice("abc ") for _ in range(3000)) * 2
    found = set()
    for size in (10**6, 777):
        monkeypatch.setattr(op8_suffix, "PIECE", size)
        strings = set()
        for _, offsets, raw, ends in op8_suffix._pieces([1], [text]):
            t, _, lo, hi, _, _, _ = op8_suffix.places(raw, ends)
            shift = (np.array(offsets) - np.concatenate([[0], ends[:-1]]))[t]
            strings |= {s for a, b in zip(lo + shift, hi + shift, strict=True) for s in range(a, b + 1)}
        found.add(frozenset(strings))
    assert found == {frozenset(range(len(text) - op8_suffix.LENGTH + 1))}


# 9


def plain_alignment(template, text):
    """Matched template words and text span of the best local alignment, every cell by itself."""
    score = [[(0, 0, None)] * (len(text) + 1) for _ in range(len(template) + 1)]
    best = (0, 0, 0, 0)
    for i, a in enumerate(template, 1):
        for j, b in enumerate(text, 1):
            s, m, f = score[i - 1][j - 1]
            options = [(s + (2 if a == b else -1), m + (a == b), j - 1 if s == 0 else f)]
            options += [(s - 1, m, f) for s, m, f in (score[i - 1][j], score[i][j - 1]) if s > 0]
            score[i][j] = max(max(options, key=lambda o: o[0]), (0, 0, None), key=lambda o: o[0])
            if a == b and score[i][j] == options[0] and options[0][0] > best[0]:
                best = (*options[0], j)
    return best[1], best[2], best[3]


@pytest.mark.parametrize("seed", range(40))
def test_alignment_against_plain_version(seed):
    rng = random.Random(seed)
    template = rng.sample(range(100, 10**6), rng.randint(3, 25))
    middle = [w for w in template if rng.random() > 0.1]
    for _ in range(rng.randrange(3)):
        middle.insert(rng.randrange(len(middle) + 1), 99)
    text = [rng.randrange(50, 90) for _ in range(8)] + middle + [rng.randrange(50, 90) for _ in range(8)]
    got = op9_license.align(np.array(template, np.uint64), np.array(text, np.uint64), 8, 60)
    expected = plain_alignment(template, text)
    assert got[0] == expected[0] and got[2] == expected[2]


def test_scan_against_plain_version(spark):
    """Altered templates in other text: found are those that a plain alignment covers enough."""
    rng, given = random.Random(21), {("L", str(i)): prose(random.Random(i), 12 + 6 * i, 10**6) for i in range(8)}
    docs, expected = [], {}
    for d in range(60):
        (_, kind), text = rng.choice(sorted(given.items()))
        words = [w for w in text.split() if rng.random() > 0.12]
        if rng.random() < 0.5:
            words.insert(rng.randrange(len(words)), "inserted")
        docs.append((d, " ".join([prose(rng, 30, 10**6), *words, prose(rng, 30, 10**6)])))
        matched, begin, end = plain_alignment(text.split(), docs[-1][1].split())
        if matched >= op9_license.COVERAGE * len(text.split()):
            expected[d] = kind, matched, " ".join(docs[-1][1].split()[begin:end])
    out = op9_license.scan(spark.createDataFrame(docs, "doc_id long, text string"), given).collect()
    assert {r["doc_id"]: (r["template"], r["matched_words"], docs[r["doc_id"]][1][r["start_char"] : r["end_char"]]) for r in out} == expected and 20 < len(expected) < 60


def test_licenses(spark):
    t = op9_license.templates()
    altered = t["MIT", "grant"].replace("without restriction", "with no restriction at all").upper()
    notice = "Released under the MIT License"
    rows = [(1, f"intro words\n{notice}.\nmore"), (2, f"x {altered} y"), (3, "the license of the work"), (4, None), (5, ""), (6, t["Apache-2.0", "header"]), (7, f"{notice} between {notice}"), (8, "This work is licensed under the GNU General Public License, version 3."), (9, f"Copyright A. B.\n\n{t['BSD-3-Clause', 'text']}")]
    out = {}
    for r in op9_license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        out.setdefault(r["doc_id"], []).append(r)
    names = {d: [r["license_id"] for r in rs] for d, rs in out.items()}
    assert names == {1: ["MIT"], 2: ["MIT"], 6: ["Apache-2.0"], 7: ["MIT"] * 2, 8: ["GPL-3.0"], 9: ["BSD-3-Clause"]}
    one = out[1][0]
    assert rows[0][1][one["start_char"] : one["end_char"]] == notice and one["coverage"] == 1.0
    assert out[2][0]["coverage"] > 0.9 and out[2][0]["template"] == "grant" and out[9][0]["template"] == "text"


def test_many_repeats_of_a_notice():
    import time

    index, began = op9_license.Index(op9_license.templates()), time.process_time()
    found = index.scan("Released under the MIT License. Own words follow it here. " * 4000, 0.8)
    assert [f[0] for f in found] == ["MIT"] * 4000 and time.process_time() - began < 5


def test_every_notice_is_found(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    hits = {(r["doc_id"], r["license_id"]) for r in queries.op9_license_scan(spark, sf_dir).collect()}
    for d, text, _, _ in docs:
        for (license_, _), notice in op9_license.templates().items():
            assert notice not in text or (d, license_) in hits, (d, license_)
    assert hits


def test_license_edges(spark):
    docs = edge_docs(spark)
    assert op9_license.scan(docs).count() == 0
    assert op9_license.scan(docs, {}).count() == 0
    assert op9_license.scan(docs.limit(0)).count() == 0
    assert op9_license.winnow(np.array([5, 1, 1, 7, 9, 9], np.uint64)).tolist() == [2, 3]


# 10


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=700) | st.lists(st.integers(0, 300), max_size=1200), st.data())
def test_random_access(ids, data):
    dac = op10_dac.Dac(op10_dac.dac_encode(np.array(ids, np.uint32)))
    assert len(dac) == len(ids) and [dac[i] for i in range(0, len(ids), 7)] == ids[::7]
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert dac.slice(a, b).tolist() == ids[a:b]
    with pytest.raises(IndexError):
        dac[len(ids)]


def test_token_store(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(op10_dac, "SHARD_IDS", 5000)
    tok, start, expected = Tokenizer.from_file(JSON), 0, []
    for d, t, _, _ in sorted(docs_of(spark, sf_dir)):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        expected.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    out = sorted(tuple(r) for r in queries.op10_token_store(spark, sf_dir).collect())
    assert out == expected


def test_token_store_edges(spark, tmp_path):
    docs = edge_docs(spark)
    op10_dac.write(docs, f"file://{tmp_path}/d", JSON, end_id=0)
    rows = sorted(op10_dac.read(spark, f"file://{tmp_path}/d").collect(), key=lambda r: r["start"])
    assert len(rows) == docs.count() and rows[0]["doc_id"] is None
    assert [r["start"] for r in rows[1:]] == np.cumsum([r["n_tokens"] for r in rows])[:-1].tolist()
    empty = {r["doc_id"]: r["n_tokens"] for r in rows}
    assert empty[2] == empty[3] == 1
    special = np.frombuffer({r["doc_id"]: r["ids"] for r in rows}[8], "<u4").tolist()
    assert special[:-1] == Tokenizer.from_file(JSON).encode(docs.where("doc_id = 8").first()["text"], add_special_tokens=False).ids
    files = sorted((tmp_path / "d" / "shards").glob("part-*"))
    assert [f for f in files if f.stat().st_size] and all(f.read_bytes()[:4] == op10_dac.MAGIC for f in files if f.stat().st_size)
    every = [x for r in rows for x in np.frombuffer(r["ids"], "<u4").tolist()]
    for i in (0, 1, len(every) // 2, len(every) - 1, *random.Random(0).sample(range(len(every)), 4)):
        assert op10_dac.token(spark, f"file://{tmp_path}/d", i) == every[i]
    with pytest.raises(IndexError):
        op10_dac.token(spark, f"file://{tmp_path}/d", len(every))
    named = spark.createDataFrame([("b", "two words"), ("a", "one"), (None, None)], "doc_id string, text string")
    assert sorted((r["start"], r["doc_id"]) for r in op10_dac.store_and_index(named, JSON).collect())[0] == (0, None)
    assert [r["doc_id"] for r in op10_dac.store_and_index(named, JSON).orderBy("start").collect()] == [None, "a", "b"]
    op10_dac.write(docs.limit(0), f"file://{tmp_path}/e", JSON)
    assert op10_dac.read(spark, f"file://{tmp_path}/e").count() == 0
    with pytest.raises(ValueError):
        op10_dac.Dac(b"none")
