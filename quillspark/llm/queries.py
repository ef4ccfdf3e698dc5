"""Queries of this subpackage over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import op1_html, op2_lines, op3_quality, op4_decontam, op5_probminhash, op6_bpe, op7_chat, op8_suffix, op9_license, op10_dac, op11_wand, op12_merkle, op13_counts
from quillspark.plans.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_html.extract(table(spark, sf_dir, "pages"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_lines.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_quality.quality(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_probminhash.classes(table(spark, sf_dir, "documents"))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return op6_bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_chat.format_chats(table(spark, sf_dir, "conversations"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_suffix.dedup(table(spark, sf_dir, "documents"))


def op8_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``op8_suffix_dedup``, by plain prefix doubling over all positions."""
    return op8_suffix.dedup(table(spark, sf_dir, "documents"), doubling=True)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_license.scan(table(spark, sf_dir, "documents"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_dac.store_and_index(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op11_wand.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10, query_id="item_id")
    return found.withColumnRenamed("query_id", "item_id")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_merkle.manifest(table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_line_dedup,
        op3_quality_rules,
        op4_decontamination,
        op5_near_dedup,
        op6_bpe_codec,
        op7_chat_format,
        op8_suffix_dedup,
        op8_prefix_doubling,
        op9_license_scan,
        op10_token_store,
        op11_lexical_search,
        op12_merkle_manifest,
        op13_token_counts,
    )
}

ORACLES = {
    # items of fewer than five words, which the tables do not hold, are left out
    "op4_decontamination": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL),
ds AS (SELECT doc_id, len(w) AS words, len(w) - 4 AS l, unnest(range(len(w) - 4)) AS p, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS e FROM dw WHERE len(w) >= 5),
iw AS (SELECT DISTINCT item_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark WHERE text IS NOT NULL),
parts AS (SELECT item_id, len(w) AS size, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS e FROM iw WHERE len(w) >= 5),
it AS (SELECT item_id, size, size - 4 AS m, e, count(*) AS c FROM parts GROUP BY item_id, size, e),
hit AS (SELECT doc_id, item_id, words, size, l, m, least(l, m) AS n, p, e, c FROM ds JOIN it USING (e)),
windows AS (SELECT *, unnest(range(greatest(0, p - n + 1), least(p, l - n) + 1)) AS s FROM hit),
shared AS (SELECT doc_id, item_id, words, size, m, n, s, e, least(count(*), any_value(c)) AS k FROM windows GROUP BY doc_id, item_id, words, size, m, n, s, e),
scored AS (SELECT doc_id, item_id, words, size, s, sum(k) / (any_value(n) + any_value(m) - sum(k)) AS similarity FROM shared GROUP BY doc_id, item_id, words, size, s),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s) AS nth FROM scored WHERE similarity >= 0.8)
SELECT doc_id, item_id, similarity, s AS first_word, least(words, size) AS n_words FROM best WHERE nth = 1""",
    "op5_near_dedup": r"""
WITH RECURSIVE g AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS e FROM g WHERE len(w) > 0),
x AS MATERIALIZED (SELECT doc_id, e, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY doc_id) AS p FROM s GROUP BY doc_id, e),
pairs AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, sum(a.p) AS ca, sum(b.p) AS cb FROM x a JOIN x b ON a.e = b.e AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id HAVING sum(least(a.p, b.p)) >= 0.799),
shared AS MATERIALIZED (SELECT a, b, xa.e, xa.p AS pa, xb.p AS pb, ca, cb FROM pairs JOIN x xa ON xa.doc_id = a JOIN x xb ON xb.doc_id = b AND xb.e = xa.e),
terms AS (SELECT i.a, i.b, i.e, any_value((1 - i.ca) / i.pa + (1 - i.cb) / i.pb) + sum(greatest(j.pa / i.pa, j.pb / i.pb)) AS t FROM shared i JOIN shared j ON i.a = j.a AND i.b = j.b GROUP BY i.a, i.b, i.e),
links AS (SELECT a, b FROM terms GROUP BY a, b HAVING sum(1 / t) >= 0.8
  UNION SELECT least_id, doc_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS least_id FROM documents WHERE text IS NOT NULL) WHERE doc_id <> least_id),
either AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, to_id) AS (SELECT doc_id, doc_id FROM documents WHERE doc_id IS NOT NULL UNION SELECT r.id, e.b FROM reach r JOIN either e ON r.to_id = e.a)
SELECT id AS doc_id, min(to_id) AS class_id FROM reach GROUP BY id""",
    "op8_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, unnest(range(length(h) // 2 - 99)) AS s, h FROM d WHERE length(h) >= 200),
strings AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 200)) AS m FROM starts),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY m ORDER BY doc_id, s) AS nth FROM strings) WHERE nth > 1),
steps AS (SELECT doc_id, p, sum(e) AS e FROM (SELECT doc_id, s AS p, 1 AS e FROM later UNION ALL SELECT doc_id, s + 100, -1 FROM later) GROUP BY doc_id, p),
levels AS (SELECT doc_id, p, sum(e) OVER (PARTITION BY doc_id ORDER BY p) AS covered FROM steps),
edges AS (SELECT doc_id, p, covered, lag(covered, 1, 0) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM levels),
spans AS (SELECT doc_id, p AS b, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS e, covered FROM edges WHERE (covered > 0) <> (before > 0)),
gone AS (SELECT doc_id, count(*) AS n_spans, sum(e - b)::BIGINT AS n_removed, list(b ORDER BY b) AS bs, list(e ORDER BY b) AS es FROM spans WHERE covered > 0 GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(range(1, n_spans + 2), lambda i:
    substr(h, CASE WHEN i = 1 THEN 1 ELSE 2 * es[i - 1] + 1 END, CASE WHEN i = n_spans + 1 THEN length(h) ELSE 2 * bs[i] - CASE WHEN i = 1 THEN 0 ELSE 2 * es[i - 1] END END)), '') END)) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)""",
    "op2_line_dedup": r"""
WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM parts),
numbered AS (
  SELECT doc_id, place, line, lead(line) OVER w AS line2, lead(place) OVER w AS place2
  FROM lines WHERE regexp_matches(line, '[^ \t\r\f\x0B]') WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
ranked AS (
  SELECT doc_id, place, place2, row_number() OVER (PARTITION BY line, line2 ORDER BY doc_id, place) AS nth
  FROM numbered WHERE line2 IS NOT NULL),
single AS (
  SELECT doc_id, place, row_number() OVER (PARTITION BY line ORDER BY doc_id, place) AS nth
  FROM numbered WHERE len(regexp_extract_all(line, '\S+')) > 50),
gone AS (
  SELECT doc_id, place FROM ranked WHERE nth > 1
  UNION SELECT doc_id, place2 FROM ranked WHERE nth > 1
  UNION SELECT doc_id, place FROM single WHERE nth > 1),
told AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.place) AS n_removed,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.place) FILTER (WHERE g.place IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.place = g.place GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_removed, text FROM told""",
    "op7_chat_format": """
WITH logs AS (
  SELECT conv_id, list((role, text) ORDER BY turn, role, text) AS turns, count(*) AS n_turns,
         string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY turn, role, text) AS text
  FROM conversations GROUP BY conv_id),
grouped AS (
  SELECT turns, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies, min(text) AS text FROM logs GROUP BY turns, n_turns),
prefixes AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM grouped))
SELECT conv_id, n_turns, n_copies, text FROM grouped WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.turns = grouped.turns)""",
}
ORACLES["op11_lexical_search"] = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
lengths AS (SELECT doc_id, len(w)::BIGINT AS n FROM words WHERE len(w) > 0),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS l FROM lengths),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(w) AS term FROM words) GROUP BY doc_id, term),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*)::BIGINT AS times FROM asked GROUP BY item_id, term),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf WHERE term IN (SELECT term FROM q) GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, totals),
impact AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // l))) AS x FROM tf JOIN w USING (term) JOIN lengths USING (doc_id), totals),
scores AS (SELECT item_id, doc_id, sum(times * x)::BIGINT AS score FROM impact JOIN q USING (term) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""
ORACLES["op8_prefix_doubling"] = ORACLES["op8_suffix_dedup"]
