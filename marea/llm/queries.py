"""The registered queries of the training-data operators, with production parameters, and their SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, html, jaccard, langid, lexicon, linededup, media, packing, tokencount, topk, trie, warc, words
from .shared import table

#: The free id of the word vocabulary that ends a document in flat token files.
SEPARATOR = 49_407


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), words.word_tokenizer(public_tokenizers.path("word_bpe_49k.json")))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents"), min_words=linededup.PASSAGE).select("doc_id", "text", "lines_total", "lines_removed")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tokencount.token_counts(docs, words.plain_word_tokenizer(public_tokenizers.path("word_bpe_49k.json")), SEPARATOR)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


QUERIES = {f.__name__: f for f in (op1_bpe, op2_packing, op3_jaccard, op4_langid, op5_topk, op6_media, op7_linededup, op8_warc, op9_tokencount, op10_html, op11_divergence, op12_trie, op13_lexicon)}

ORACLE_SQL = {
    "op3_jaccard": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh FROM d),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS t FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 75 * (a.n + b.n - i)),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id FROM n JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) m ON m.x = n.doc_id
""",
    "op5_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM f
""",
    "op11_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY lang, term HAVING sum(docs) >= 3),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, sum(n) AS n FROM x GROUP BY lang, source),
p AS (SELECT x.lang, x.source, x.term, x.n, 1 + (1000000000 * (x.n + 1)::HUGEINT) // (s.n + v.v)::HUGEINT AS p, 1 + (1000000000 * (x.total + 1)::HUGEINT) // (v.n + v.v)::HUGEINT AS q
  FROM x JOIN s ON s.lang = x.lang AND s.source = x.source JOIN v ON v.lang = x.lang),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum((pa.p - pb.p) * (pa.p - pb.p) // pb.p), 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p pa ON pa.lang = a.lang AND pa.source = a.source LEFT JOIN p pb ON pb.lang = b.lang AND pb.source = b.source AND pb.term = pa.term GROUP BY ALL
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
o AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT * FROM o WHERE part = 'pair' OR rank <= 200
""",
    "op12_trie": """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n FROM t GROUP BY c),
b AS (SELECT c, n, c - c % 5 AS base, xor(4294967295, list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
  lambda s, x: list_reduce([1::BIGINT, 2, 3, 4, 5, 6, 7, 8], lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END, xor(s, x)), 4294967295::BIGINT)) % 9 AS h FROM n),
m AS (SELECT b.*, least(b.h, coalesce(n.n, 0)) AS take FROM b LEFT JOIN n ON n.c = b.base),
r AS (SELECT m.c, m.take + t.pos - m.h AS d, t.role, t.text FROM m JOIN t ON t.c = m.c WHERE t.pos > m.h UNION ALL SELECT m.c, t.pos, t.role, t.text FROM m JOIN t ON t.c = m.base WHERE t.pos <= m.take),
x AS (SELECT c, d, octet_length(encode(text)) AS size, sha256(string_agg(sha256(octet_length(encode(role)) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d)) AS k FROM r UNION ALL SELECT c, 0, 0, '' FROM n),
v AS (SELECT d, k, min(c) AS o, count(*) AS n_convs, max(size) AS size FROM x GROUP BY d, k),
w AS (SELECT x.c, x.d, v.o, v.n_convs FROM x JOIN v ON v.d = x.d AND v.k = x.k),
p AS (SELECT v.o, v.d, v.n_convs, v.size, w.o AS parent FROM v LEFT JOIN w ON w.c = v.o AND w.d = v.d - 1),
g AS (SELECT parent AS o, d - 1 AS d, count(*) AS n FROM p WHERE d > 0 GROUP BY 1, 2),
s AS (SELECT w.o, w.d, sum((p.n_convs - 1) * p.size) AS saved, count(*) FILTER (WHERE g.n IS NULL) AS leaves FROM p JOIN w ON w.c = p.o AND w.d <= p.d LEFT JOIN g ON g.o = p.o AND g.d = p.d GROUP BY 1, 2),
l AS (SELECT c, max(d) AS d FROM x GROUP BY c),
e AS (SELECT w.o, w.d, string_agg(CAST(l.c AS VARCHAR), ',' ORDER BY l.c) AS ids FROM l JOIN w ON w.c = l.c AND w.d = l.d GROUP BY 1, 2)
SELECT p.o AS conv_id, CAST(p.d AS BIGINT) AS depth, p.parent AS parent_conv_id, CAST(p.n_convs AS BIGINT) AS n_convs, CAST(coalesce(g.n, 0) AS BIGINT) AS n_children,
  CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM p JOIN s ON s.o = p.o AND s.d = p.d LEFT JOIN g ON g.o = p.o AND g.d = p.d LEFT JOIN e ON e.o = p.o AND e.d = p.d
""",
}
