"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import table

PIECE_MODEL, WORD_VOCABULARY, BYTE_VOCABULARY = "piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_50k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.pii_crf import pii_query

    return pii_query(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.toxicity_mil import toxicity_query

    return toxicity_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.piece_bpe import pieces_query

    return pieces_query(table(spark, sf_dir, "documents"), vocabulary(PIECE_MODEL))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.token_store import token_store_query

    return token_store_query(spark, table(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.quality_cnn import quality_query

    return quality_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.packing import packing_query

    return packing_query(table(spark, sf_dir, "documents"), vocabulary(BYTE_VOCABULARY))


def op7_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.sketch_join import sketch_join_query

    return sketch_join_query(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.line_dedup import line_dedup_query

    return line_dedup_query(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.quality_rules import quality_rules_query

    return quality_rules_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.max_score import top_k_query

    return top_k_query(table(spark, sf_dir, "embeddings"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.prefix_trie import trie_query

    return trie_query(table(spark, sf_dir, "conversations"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.importance_resample import importance_query

    return importance_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_anchor_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.anchor_simhash import simhash_query

    return simhash_query(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_pii, op2_toxicity, op3_pieces, op4_token_store, op5_quality, op6_packing, op7_sketch_join, op8_line_dedup, op9_quality_rules, op10_max_score,
        op11_prefix_trie, op12_importance, op13_anchor_simhash)}


_TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(CASE WHEN len(q.e) = len(c.e) THEN list_dot_product(q.e, c.e)
    ELSE coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0) END AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 20 = 0) q JOIN v c ON q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


_JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l
  FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 4 THEN [array_to_string(l, ' ')]
    ELSE list_distinct(list_transform(range(1, len(l) - 2), lambda i: array_to_string(l[i:i + 3], ' '))) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 85 * (x.n + y.n - p.c)),
d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, d.b FROM r JOIN d ON d.a = r.y)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) m ON m.x = w.doc_id
"""


#: crc32 of a decimal number's text: one step for each character and eight for its bits.
_DECIMAL_CRC = """xor(4294967295, list_reduce(
    flatten(list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda c: [CAST(unicode(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END, CAST(4294967295 AS BIGINT)))"""

_TRIE_SQL = """
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT conv_id, conv_id - conv_id % 100 AS first, count(*) AS n FROM o GROUP BY conv_id),
h AS (SELECT *, CRC % 6 AS h FROM i),
m AS (
  SELECT h.conv_id, h.first, h.h, least(h.h, coalesce(b.n, 0)) AS taken, least(h.h, coalesce(b.n, 0)) + greatest(h.n - h.h, 0) AS total
  FROM h LEFT JOIN i b ON b.conv_id = h.first),
t AS (
  SELECT m.conv_id, o.pos, role, text FROM m JOIN o ON o.conv_id = m.first AND o.pos <= m.taken
  UNION ALL SELECT m.conv_id, m.taken + o.pos - m.h, role, text FROM m JOIN o ON o.conv_id = m.conv_id AND o.pos > m.h),
p AS (
  SELECT conv_id, pos AS depth, length(text) AS chars,
    sha256(string_agg(sha256(length(role) || ':' || role || text), '' ORDER BY pos) OVER (PARTITION BY conv_id ORDER BY pos)) AS node FROM t
  UNION ALL SELECT conv_id, 0, 0, '' FROM m),
q AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS up FROM p),
n AS (SELECT node, min(up) AS up, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, min(chars) AS chars FROM q GROUP BY node),
k AS (SELECT up AS node, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
v AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.node = n.node),
s AS (
  SELECT top, sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((v.n_convs - 1) * v.chars) AS saved_tokens
  FROM (SELECT DISTINCT a.node AS top, b.node AS node FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.depth <= b.depth) x JOIN v ON v.node = x.node GROUP BY top),
e AS (
  SELECT p.node, string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) AS ids FROM p JOIN m ON m.conv_id = p.conv_id AND m.total = p.depth GROUP BY p.node)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM v JOIN s ON s.top = v.node LEFT JOIN v u ON u.node = v.up LEFT JOIN e ON e.node = v.node
""".replace("CRC", _DECIMAL_CRC.format("conv_id"))


#: crc32 of UTF-8 bytes by the table of one byte's remainders; bytes follow from code points.
_IMPORTANCE_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, CAST(i AS BIGINT) AS c FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crcs AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
texts AS (SELECT 'd' AS kind, row_number() OVER () AS row, doc_id, text FROM documents UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark),
words AS (
  SELECT kind, row, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS l
  FROM texts),
grams AS (
  SELECT kind, row, unnest(l) AS gram FROM words
  UNION ALL SELECT kind, row, unnest(list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])) FROM words WHERE len(l) > 1),
counted AS (SELECT kind, row, gram, count(*) AS n FROM grams GROUP BY ALL),
coded AS (
  SELECT gram, flatten(list_transform(list_transform(string_split(gram, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda c:
    CASE WHEN c < 128 THEN [c] WHEN c < 2048 THEN [192 | (c >> 6), 128 | (c & 63)]
    WHEN c < 65536 THEN [224 | (c >> 12), 128 | ((c >> 6) & 63), 128 | (c & 63)]
    ELSE [240 | (c >> 18), 128 | ((c >> 12) & 63), 128 | ((c >> 6) & 63), 128 | (c & 63)] END)) AS bytes
  FROM (SELECT DISTINCT gram FROM counted)),
hashed AS (
  SELECT gram, xor(4294967295, list_reduce(bytes, lambda crc, b: xor(crc >> 8, t[(xor(crc, b) & 255) + 1]), CAST(4294967295 AS BIGINT))) % 10000 AS bucket
  FROM coded, crcs),
b AS (SELECT kind, row, bucket, sum(n) AS n FROM counted JOIN hashed USING (gram) GROUP BY ALL),
st AS (SELECT r.i AS bucket, coalesce(sum(n) FILTER (kind = 'd'), 0) AS s, coalesce(sum(n) FILTER (kind = 't'), 0) AS t FROM range(10000) r(i) LEFT JOIN b ON b.bucket = r.i GROUP BY r.i),
g AS (
  SELECT bucket, CAST(floor(1000 * ln(((t + 1.0::DOUBLE) * (sum(s) OVER () + 10000.0::DOUBLE)) / ((s + 1.0::DOUBLE) * (sum(t) OVER () + 10000.0::DOUBLE)))) AS BIGINT) AS gain FROM st),
w AS (
  SELECT row, CAST(sum(n) AS BIGINT) AS n, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS weight
  FROM b JOIN g USING (bucket) WHERE kind = 'd' GROUP BY row),
d AS (
  SELECT words.row, doc_id, len(l) AS n_words, coalesce(w.n, 0) AS n_features, coalesce(w.weight, 0) AS weight,
    CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM words LEFT JOIN w ON w.row = words.row WHERE kind = 'd'),
e AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d),
r AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS rank, count(*) OVER () AS n FROM e WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r.rank <= 25 * r.n // 100 THEN r.rank END AS rank FROM e LEFT JOIN r ON r.row = e.row
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_sketch_join": _JACCARD_SQL, "op10_max_score": _TOP_K_SQL, "op11_prefix_trie": _TRIE_SQL, "op12_importance": _IMPORTANCE_SQL}
