"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup, order_minhash, piece_matching, secret_scan, splitters, subspace, templates, toxicity, url_filter, warc
from .runtime import table

#: The rules that op8 is given.
URL_RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)


def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_subspace_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subspace.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = templates.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "n_matched", "similarity", "first_word", "last_word", "n_changed")


def op4_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitters.assign(table(spark, sf_dir, "documents"), 8)


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_cuckoo_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = line_dedup.LineIndex.build(docs)
    out = index.apply(docs)
    index.remove()
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op7_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_digest_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op9_suffix_array_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_matching.encode(table(spark, sf_dir, "documents"), keep_ids=False)


def op10_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), count("entropy"))


_UPPER, _LOWER = url_filter.UPPER, url_filter.LOWER

OP1_SQL = """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages
), best AS (SELECT d, n, max(page_id) AS r FROM p WHERE n >= 1000 GROUP BY d, n),
u AS (SELECT p.*, best.r, replace(replace(url, chr(13), '%0D'), chr(10), '%0A') AS uri FROM p LEFT JOIN best ON p.d = best.d AND p.n = best.n)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN page_id < r THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < r THEN r END AS refers_to,
       'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' AS response_head,
       CASE WHEN page_id < r THEN '' ELSE html END AS payload,
       to_json([{'uri': uri, 'date': '2024-01-01T00:00:00Z', 'head': 'GET ' || coalesce(uri, '/') || ' HTTP/1.1', 'block': ''}])::VARCHAR AS requests,
       to_json([{'uri': uri, 'date': '2024-01-01T00:00:00Z', 'head': '', 'block': 'page_id: ' || page_id || chr(13) || chr(10)}])::VARCHAR AS metadata
FROM u
"""

OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CASE WHEN len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
                       AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN list_transform(embedding, lambda x: x::DOUBLE) END AS e
  FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.e IS NOT NULL AND b.e IS NOT NULL AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.95
), reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(deg.n, 0)::BIGINT AS n_links, comp.c AS component_id, comp.c = v.vec_id AS kept
FROM v JOIN comp ON comp.a = v.vec_id LEFT JOIN deg ON deg.a = v.vec_id
"""

OP4_SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
), d AS (
  SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) + 1 AS size, md5(coalesce(text, '')) AS k FROM documents
), bytes AS (
  SELECT t AS text, hex(encode(t)) AS h, octet_length(encode(t)) AS n FROM (SELECT DISTINCT t FROM d)
), codes AS (
  SELECT text, list_transform(range(n), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b FROM bytes
), sums AS (
  SELECT text, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295) AS crc
  FROM codes, crc
), o AS (
  SELECT doc_id, t, size, sum(size) OVER w - size AS before, row_number() OVER w AS i, sum(size) OVER () AS total
  FROM d WINDOW w AS (ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING)
), s AS (SELECT *, least(7, before * 8 // total)::INTEGER AS shard FROM o)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY i) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM s JOIN sums ON s.t = sums.text
"""

OP6_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l
), c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(c.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY doc_id
"""

OP8_SQL = f"""
WITH r AS (SELECT * FROM (VALUES {", ".join(f"('{v}', '{r}')" for v, r in URL_RULES)}) t(verdict, rule)),
r2 AS (SELECT verdict, rule, substr(rule, 1, strpos(rule, '/') - 1) AS h, substr(rule, strpos(rule, '/')) AS p FROM r),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), m AS (
  SELECT s.page_id, r2.rule, r2.verdict, row_number() OVER (PARTITION BY s.page_id ORDER BY length(r2.rule) DESC) AS n
  FROM s JOIN r2 ON (s.host = r2.h OR ends_with(s.host, '.' || r2.h)) AND starts_with(s.path, r2.p)
)
SELECT s.page_id, s.host, s.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM s LEFT JOIN m ON s.page_id = m.page_id AND m.n = 1
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_warc_transactions,
        op2_subspace_pigeonhole,
        op3_template_decontamination,
        op4_sampled_splitters,
        op5_order_minhash,
        op6_cuckoo_line_dedup,
        op7_noisy_or_toxicity,
        op8_digest_url_filter,
        op9_suffix_array_pieces,
        op10_entropy_secrets,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_transactions": OP1_SQL,
        "op2_subspace_pigeonhole": OP2_SQL,
        "op4_sampled_splitters": OP4_SQL,
        "op6_cuckoo_line_dedup": OP6_SQL,
        "op8_digest_url_filter": OP8_SQL,
    }
