"""Registered queries over small inline relations of odd values, which the tables lack; the same VALUES feed Spark and the SQL, which computes the results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import chunking, metrics

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return keep


def values(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")


TEXTS = "(1, ' \"Table 4\" '), (2, 'table4'), (3, '4'), (4, 'Figure 2b'), (5, 'FIG. 2'), (6, '‘quoted  text’'), (7, ''), (8, '12.5%'), (9, '1e3'), (10, '+.5'), (11, '1d'), (12, '1,234'), (13, ' 7 ± 2')"


@query(
    rf"""WITH t(id, x) AS (VALUES {TEXTS}),
n AS (SELECT id, x, regexp_replace(trim(lower(trim(x)), '"''“”‘’`'), '\s+', ' ', 'g') AS t FROM t)
SELECT id, t AS normalized,
  CASE WHEN regexp_matches(t, '^(table\s*)?[0-9]+[a-z]?$') THEN 'table ' || regexp_extract(t, '([0-9]+[a-z]?)$', 1) ELSE t END AS table_id,
  CASE WHEN regexp_matches(trim(t), '^((table|figure|fig\.?)\s*)?[0-9]+[a-z]?$') THEN regexp_extract(trim(t), '([0-9]+[a-z]?)$', 1) ELSE trim(t) END AS object_id,
  CASE WHEN regexp_matches(trim(replace(trim(x), '%', '')), '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN trim(replace(trim(x), '%', ''))::DOUBLE END AS number FROM n"""
)
def normalize_ids_and_numbers(spark, d):
    rows = values(spark, TEXTS, "id, x")
    x = F.col("x")
    return rows.select("id", T.normalize_text(x).alias("normalized"), T.normalize_visible_id(x, "table").alias("table_id"), T.normalize_object_id(x).alias("object_id"), T.normalize_number(x).alias("number"))


CELLS = "(1, '1.0000001', '1', 'number'), (2, '14.70', '14.7%', 'number'), (3, 'x', '1', 'number'), (4, 'Yes', 'no', 'boolean'), (5, '', 'x', 'boolean'), (6, ' A  b', 'a b', 'string'), (7, NULL, NULL, 'string'), (8, NULL, 'a', 'string')"


@query(
    rf"""WITH t(id, g, p, kind) AS (VALUES {CELLS}),
n AS (SELECT *, try_cast(replace(g, '%', '') AS DOUBLE) AS x, try_cast(replace(p, '%', '') AS DOUBLE) AS y FROM t)
SELECT id, CASE WHEN g IS NULL OR p IS NULL THEN g IS NULL AND p IS NULL
  WHEN kind = 'number' THEN coalesce(abs(x - y) <= greatest(1e-6 * greatest(abs(x), abs(y)), 1e-6), false)
  WHEN kind = 'boolean' THEN (g <> '') = (p <> '')
  ELSE regexp_replace(trim(lower(g)), '\s+', ' ', 'g') = regexp_replace(trim(lower(p)), '\s+', ' ', 'g') END AS same FROM n"""
)
def cell_equal(spark, d):
    rows = values(spark, CELLS, "id, g, p, kind")
    return rows.select("id", T.cell_equal(F.col("g"), F.col("p"), F.col("kind")).alias("same"))


SCHEMA = "(1, 0, 'model', 'string', true), (1, 1, 'score', 'number', false), (1, 2, 'open', 'boolean', false), (2, 0, 'name', 'string', false), (2, 1, 'year', 'number', false)"
GOLD_ROWS = "(1, 0, 'model', 'A'), (1, 0, 'score', '14.70'), (1, 0, 'open', 'yes'), (1, 1, 'model', 'B'), (1, 1, 'score', '3'), (1, 1, 'open', ''), (2, 0, 'name', 'x'), (2, 0, 'year', '2020')"
PRED_ROWS = "(1, 0, 'model', ' a '), (1, 0, 'score', '14.7'), (1, 0, 'open', ''), (1, 1, 'model', 'C'), (2, 0, 'name', 'X'), (2, 0, 'year', '2021'), (2, 1, 'name', 'x'), (2, 1, 'year', '2020')"


@query(
    f"""WITH s(q, pos, name, kind, is_key) AS (VALUES {SCHEMA}), g(q, r, name, v) AS (VALUES {GOLD_ROWS}), p(q, r, name, v) AS (VALUES {PRED_ROWS}),
keys AS (SELECT * FROM s QUALIFY CASE WHEN bool_or(is_key) OVER (PARTITION BY q) THEN is_key ELSE pos = min(pos) OVER (PARTITION BY q) END),
gk AS (SELECT g.q, r, trim(lower(v)) AS k FROM g JOIN keys USING (q, name)), pk0 AS (SELECT p.q, r, trim(lower(v)) AS k FROM p JOIN keys USING (q, name)),
pk AS (SELECT q, k, max(r) AS r FROM pk0 GROUP BY ALL),
rows AS (SELECT coalesce(gk.q, pk.q) AS q, count(gk.k) AS ng, count(pk.k) AS np, count(*) FILTER (WHERE gk.k IS NOT NULL AND pk.k IS NOT NULL) AS nb FROM gk FULL JOIN pk ON gk.q = pk.q AND gk.k = pk.k GROUP BY 1),
cells AS (SELECT gk.q, count(*) AS n, count(*) FILTER (WHERE pk.r IS NOT NULL AND CASE s.kind WHEN 'number' THEN abs(gv.v::DOUBLE - pv.v::DOUBLE) <= 1e-6 WHEN 'boolean' THEN (gv.v <> '') = (pv.v <> '') ELSE trim(lower(gv.v)) = trim(lower(pv.v)) END) AS c
  FROM gk JOIN s ON s.q = gk.q AND NOT s.is_key JOIN g gv ON gv.q = gk.q AND gv.r = gk.r AND gv.name = s.name LEFT JOIN pk ON pk.q = gk.q AND pk.k = gk.k LEFT JOIN p pv ON pv.q = pk.q AND pv.r = pk.r AND pv.name = s.name GROUP BY 1)
SELECT q AS query_id, round(2.0 * nb / (ng + np), 9) AS row_f1, round(c / n, 9) AS cell_accuracy, c AS cell_correct, n AS cell_total FROM rows JOIN cells USING (q)"""
)
def table_answer_metrics(spark, d):
    schema = values(spark, SCHEMA, "query_id, pos, name, type, is_row_key")
    pack = lambda rows: values(spark, rows, "query_id, row_no, name, v").groupBy("query_id", "row_no").agg(F.map_from_entries(F.collect_list(F.struct("name", "v"))).alias("cells"))
    return metrics.table_scores(schema, pack(GOLD_ROWS), pack(PRED_ROWS))


EVIDENCE = "(1, 'p1', 'table', '3', 'Table 4', ''), (1, 'p1', 'table', '3', '4', ''), (1, 'p2', 'text_span', '2', '', ''), (1, 'p2', 'text_span', NULL, '', ''), (2, 'p3', 'figure', '7', '', 'Figure 1')"
PREDICTED = "(1, 'p1', 'table', '3', 'table 4', ''), (1, 'p2', 'text_span', '9', '', ''), (3, 'p3', 'figure', '7', '', '1')"


@query(
    rf"""WITH e(query_id, doc_id, source_type, page, table_id, figure_id, side) AS (SELECT *, 'g' FROM (VALUES {EVIDENCE}) UNION ALL SELECT *, 'p' FROM (VALUES {PREDICTED})),
k AS (SELECT DISTINCT query_id, side, doc_id, source_type, page, CASE source_type WHEN 'table' THEN 'table ' || regexp_extract(lower(table_id), '([0-9]+)$', 1) WHEN 'figure' THEN 'figure ' || regexp_extract(lower(figure_id), '([0-9]+)$', 1) ELSE '' END AS o FROM e WHERE page IS NOT NULL),
c AS (SELECT query_id, count(*) FILTER (WHERE g) AS n_gold, count(*) FILTER (WHERE p) AS n_pred, count(*) FILTER (WHERE g AND p) AS n_both
      FROM (SELECT query_id, doc_id, source_type, page, o, bool_or(side = 'g') AS g, bool_or(side = 'p') AS p FROM k GROUP BY ALL) GROUP BY 1)
SELECT query_id, n_gold, n_pred, n_both, CASE WHEN n_pred = 0 THEN 0.0 ELSE round(n_both / n_pred, 9) END AS precision,
  CASE WHEN n_pred = 0 THEN 0.0 WHEN n_gold = 0 THEN 1.0 ELSE round(n_both / n_gold, 9) END AS recall,
  CASE WHEN n_both = 0 THEN 0.0 ELSE round(2.0 * n_both / (n_gold + n_pred), 9) END AS f1 FROM c"""
)
def evidence_key_prf(spark, d):
    columns = "query_id, doc_id, source_type, page, table_id, figure_id"
    keys = [metrics.evidence_keys(values(spark, rows, columns)) for rows in (EVIDENCE, PREDICTED)]
    return metrics.set_prf(*keys, ["doc_id", "source_type", "page", "object_id"])


@query(
    f"""WITH g(query_id, doc_id, source_type, page, t, f) AS (VALUES {EVIDENCE}), r(query_id, doc_id, page) AS (VALUES (1, 'p1', '3'), (2, 'p3', '8'), (1, 'p1', '3')),
ty AS (SELECT unnest(['text_span', 'table', 'figure', 'citation_context', 'equation_algorithm']) AS source_type),
h AS (SELECT g.*, EXISTS (SELECT 1 FROM r WHERE r.query_id = g.query_id AND r.doc_id = g.doc_id AND r.page = g.page) AS hit FROM g)
SELECT ty.source_type, count(h.page) AS n_total, count(*) FILTER (WHERE h.hit) AS n_hit, count(*) FILTER (WHERE h.source_type IS NOT NULL AND h.page IS NULL) AS n_no_page FROM ty LEFT JOIN h USING (source_type) GROUP BY 1"""
)
def modality_hit_rate(spark, d):
    gold = values(spark, EVIDENCE, "query_id, doc_id, source_type, page, table_id, figure_id")
    return metrics.modality_hits(gold, values(spark, "(1, 'p1', '3'), (2, 'p3', '8'), (1, 'p1', '3')", "query_id, doc_id, page"))


OBJECTS = "('p', 1, 'Table 2: x'), ('p', 2, 'no number'), ('p', 3, ''), ('q', 1, 'Table 1. y'), ('q', 2, NULL)"


@query(
    rf"""WITH t(paper_id, pos, caption) AS (VALUES {OBJECTS}), o AS (SELECT *, nullif(regexp_extract(lower(coalesce(caption, '')), '^\s*table\s*([0-9]+)', 1), '') AS own, row_number() OVER (PARTITION BY paper_id ORDER BY pos)::VARCHAR AS place FROM t)
SELECT paper_id, pos, caption, CASE WHEN own IS NOT NULL THEN 'Table ' || own WHEN EXISTS (SELECT 1 FROM o p WHERE p.paper_id = o.paper_id AND p.own = o.place) THEN '(uncaptioned)' ELSE 'Table ' || place END AS label FROM o"""
)
def caption_labels(spark, d):
    return chunking.caption_labels(values(spark, OBJECTS, "paper_id, pos, caption"))