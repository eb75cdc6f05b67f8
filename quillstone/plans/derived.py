"""Registered queries over whole tables, with columns derived for operators that the stand-in tables have no data for.

Conversations stand for documents of ordered blocks, events for logs and runs, documents for papers.
Each query has SQL that computes the same from the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import chunking, entities, evidence, lint, locators, logs, packing, ranking, selections
from quillstone.plans import search
from quillstone.plans.catalog import _TERMS, bm25, chunks_of, hits_sql, shared_terms, table
from quillstone.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        SQL[fn.__name__] = sql
        return fn

    return keep


def turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").withColumn("no", F.col("turn") + 1)


def joined(*parts) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


# --- references, values and choices ------------------------------------------------------------


@query(
    r"""WITH q AS (SELECT conv_id, turn, 'See Table ' || (turn + 1) || ' and Fig. ' || (conv_id % 5) || 'b, then table ' || (turn + 1) || ' again. ' || text AS q FROM conversations),
m AS (SELECT conv_id, turn, lower(unnest(regexp_extract_all(q, '(?i)\b((?:table|tab\.|figure|fig\.?)\s*[0-9]+[a-z]?)\b', 1))) AS m FROM q)
SELECT DISTINCT conv_id, turn, CASE WHEN m LIKE 't%' THEN 'table ' ELSE 'figure ' END || regexp_extract(m, '([0-9]+[a-z]?)$', 1) AS ref FROM m"""
)
def object_refs(spark, d):
    question = joined("See Table ", F.col("no"), " and Fig. ", F.col("conv_id") % 5, "b, then table ", F.col("no"), " again. ", F.col("text"))
    return turns(spark, d).select("conv_id", "turn", F.explode(evidence.object_references(question)).alias("ref"))


@query(
    """SELECT conv_id, max('[2] ' || trim(text, ' ' || chr(10) || chr(9) || chr(13))) FILTER (WHERE turn = 1) AS entry, (max(turn) + 1)::INTEGER AS last FROM conversations GROUP BY 1"""
)
def reference_entry(spark, d):
    """A conversation as a list of numbered references."""
    entry = joined("[", F.col("no"), "] ", F.col("text"))
    lists = turns(spark, d).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", entry.alias("e")))), lambda x: x["e"]), "\n").alias("text"))
    return lists.select("conv_id", evidence.reference_entry(F.col("text"), F.lit(2)).alias("entry"), evidence.last_reference(F.col("text")).alias("last"))


@query(
    r"""WITH t AS (SELECT conv_id, turn, 'as shown (' || (turn + 1) || ')' || chr(10) || left(replace(text, chr(10), ' '), 15) || CASE WHEN turn % 2 = 0 THEN ' = ' ELSE ' ' END || conv_id || ' (' || (turn + 1) || ')' || chr(10) || 'end' AS t FROM conversations)
SELECT conv_id, turn, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: ends_with(x, '(' || (turn + 1) || ')') AND regexp_matches(x, '[=+*/^\\<>∑∫≤≥-]'))[1] AS line FROM t"""
)
def equation_line(spark, d):
    sign = F.when(F.col("turn") % 2 == 0, " = ").otherwise(" ")
    text = joined("as shown (", F.col("no"), ")\n", F.substring(F.replace("text", F.lit("\n"), F.lit(" ")), 1, 15), sign, F.col("conv_id"), " (", F.col("no"), ")\nend")
    return turns(spark, d).select("conv_id", "turn", evidence.equation_line(text, F.col("no")).alias("line"))


@query(
    r"""WITH p AS (SELECT item_id, text AS a, CASE item_id % 5 WHEN 0 THEN upper(text) WHEN 1 THEN text || ' - supplement' WHEN 2 THEN substr(text, 1, 10) WHEN 3 THEN substr(text, 5) ELSE substr(text, 1, 30) END AS b FROM benchmark),
n AS (SELECT item_id, trim(regexp_replace(lower(a), '[^a-z0-9]+', ' ', 'g')) AS a, trim(regexp_replace(lower(b), '[^a-z0-9]+', ' ', 'g')) AS b FROM p)
SELECT item_id, length(a) >= 15 AND length(b) >= 15 AND (starts_with(a, b) OR starts_with(b, a)) AS same FROM n"""
)
def title_equivalence(spark, d):
    case, text = F.col("item_id") % 5, F.col("text")
    other = F.when(case == 0, T.simple_upper(text)).when(case == 1, F.concat(text, F.lit(" - supplement"))).when(case == 2, F.substring(text, 1, 10)).when(case == 3, F.expr("substring(text, 5)")).otherwise(F.substring(text, 1, 30))
    return table(spark, d, "benchmark").select("item_id", T.titles_equivalent(text, other).alias("same"))


@query(
    r"""WITH v AS (SELECT doc_id, 'Rate 1' || (doc_id % 50) || ', then ' || (doc_id * 7 % 60) || ' and 12,' || lpad((doc_id % 1000)::VARCHAR, 3, '0') || ' in 3.' || (doc_id % 40) AS t,
  CASE doc_id % 4 WHEN 0 THEN (doc_id % 50)::VARCHAR WHEN 1 THEN '12' || lpad((doc_id % 1000)::VARCHAR, 3, '0') WHEN 2 THEN 'rate' ELSE (doc_id % 40)::VARCHAR END AS v FROM documents)
SELECT doc_id, CASE WHEN v = 'rate' THEN true ELSE regexp_matches(t, '(^|[^0-9.])' || v || '($|[^0-9.])') OR regexp_matches(replace(t, '12,', '12'), '(^|[^0-9.])' || v || '($|[^0-9.])') END AS inside FROM v"""
)
def numeric_containment(spark, d):
    i, case = F.col("doc_id"), F.col("doc_id") % 4
    three = F.lpad((i % 1000).cast("string"), 3, "0")
    text = joined("Rate 1", i % 50, ", then ", i * 7 % 60, " and 12,", three, " in 3.", i % 40)
    value = F.when(case == 0, (i % 50).cast("string")).when(case == 1, F.concat(F.lit("12"), three)).when(case == 2, "rate").otherwise((i % 40).cast("string"))
    return table(spark, d, "documents").select("doc_id", T.contains_value(text, value).alias("inside"))


@query(
    r"""WITH w AS (SELECT item_id, string_split(text, ' ')[1] AS a, string_split(text, ' ')[2] AS b FROM benchmark),
r AS (SELECT *, CASE item_id % 6 WHEN 0 THEN 'B' WHEN 1 THEN 'option (a)' WHEN 2 THEN ' ' || b || ' ' WHEN 3 THEN 'it is ' || a || ', surely' WHEN 4 THEN a || ' or ' || b ELSE 'Z' END AS raw FROM w),
n AS (SELECT item_id, trim(regexp_replace(lower(raw), '\s+', ' ', 'g')) AS low, trim(regexp_replace(lower(a), '\s+', ' ', 'g')) AS a, trim(regexp_replace(lower(b), '\s+', ' ', 'g')) AS b FROM r),
c AS (SELECT *, upper(regexp_extract(low, '^(?:option\s+|answer\s*:?\s*)?\(?([a-z])\)?[.:)]?$', 1)) AS letter, length(a) >= 3 AND contains(low, a) AS ia, length(b) >= 3 AND contains(low, b) AS ib FROM n)
SELECT item_id, CASE WHEN letter IN ('A', 'B') THEN letter WHEN a = low THEN 'A' WHEN b = low THEN 'B' WHEN ia AND NOT ib THEN 'A' WHEN ib AND NOT ia THEN 'B' END AS letter FROM c"""
)
def choice_normalization(spark, d):
    a, b, case = F.get(F.split("text", " "), F.lit(0)), F.get(F.split("text", " "), F.lit(1)), F.col("item_id") % 6
    raw = F.when(case == 0, "B").when(case == 1, "option (a)").when(case == 2, joined(" ", b, " ")).when(case == 3, joined("it is ", a, ", surely")).when(case == 4, joined(a, " or ", b)).otherwise("Z")
    return table(spark, d, "benchmark").select("item_id", T.choice_letter(raw, F.create_map(F.lit("A"), a, F.lit("B"), b)).alias("letter"))


@query(
    r"""WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN 'Sure: ```' || props || '``` done' WHEN 2 THEN '[' || props || ']' ELSE 'none' END AS raw FROM events)
SELECT event_id, CASE WHEN json_valid(raw) AND starts_with(trim(raw), '{') THEN trim(raw) WHEN json_valid(nullif(regexp_extract(raw, '\{.*\}', 0, 's'), '')) THEN regexp_extract(raw, '\{.*\}', 0, 's') END AS json FROM r"""
)
def json_salvage(spark, d):
    case, props = F.col("event_id") % 4, F.col("props")
    raw = F.when(case == 0, props).when(case == 1, joined("Sure: ```", props, "``` done")).when(case == 2, joined("[", props, "]")).otherwise("none")
    return table(spark, d, "events").select("event_id", T.json_object(raw).alias("json"))


@query(
    """WITH e AS (SELECT event_id, CASE WHEN event_id % 4 > 0 THEN event_type || ': ' || user_id END AS error, CASE WHEN event_id % 5 = 0 THEN 400 + event_id % 10 END AS status FROM events)
SELECT event_id, CASE WHEN status IS NOT NULL THEN 'HTTP ' || status WHEN error IS NOT NULL THEN split_part(error, ':', 1) ELSE 'unknown' END AS error_class,
  coalesce(status IN (408, 409, 425, 429, 500, 502, 503, 504), false) OR regexp_matches(lower(coalesce(error, '')), 'timeout|timed out|connection reset|temporarily') AS transient,
  least(power(2.0, event_id % 12), 60.0) AS delay FROM e"""
)
def error_classes(spark, d):
    """Class of an error, whether another try may help, and the wait before it."""
    i = F.col("event_id")
    error, status = F.when(i % 4 > 0, joined(F.col("event_type"), ": ", F.col("user_id"))), F.when(i % 5 == 0, 400 + i % 10)
    return table(spark, d, "events").select("event_id", T.error_class(error, status).alias("error_class"), T.is_transient(status, error).alias("transient"), T.backoff_seconds(i % 12 + 1, 1.0, 60.0).alias("delay"))


@query(
    r"""WITH w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), r AS (SELECT item_id, w[1] || ' ' || w[2] AS free, CASE item_id % 3 WHEN 0 THEN w[3] WHEN 1 THEN upper(w[1]) || '  ' || w[2] ELSE '7' END AS opt FROM w),
n AS (SELECT item_id, free, opt, regexp_replace(lower(opt), '\s+', ' ', 'g') AS norm FROM r)
SELECT item_id, free || CASE WHEN norm = regexp_replace(lower(free), '\s+', ' ', 'g') OR length(norm) < CASE WHEN regexp_matches(norm, '^[0-9.,%±\s+-]+$') THEN 2 ELSE 3 END THEN '' ELSE '|' || opt END AS found,
  'Q: ' || free || ' {b} ' || item_id || ' {other}' AS prompt FROM n"""
)
def answer_values(spark, d):
    """Answer strings worth finding, and a prompt of its parts; a value's braces are no placeholder."""
    w, case = F.split("text", " "), F.col("item_id") % 3
    free = joined(F.get(w, F.lit(0)), " ", F.get(w, F.lit(1)))
    option = F.when(case == 0, F.get(w, F.lit(2))).when(case == 1, joined(T.simple_upper(F.get(w, F.lit(0))), "  ", F.get(w, F.lit(1)))).otherwise("7")
    values = T.match_values(joined(" ", free, " "), F.lit(" b"), F.create_map(F.lit("A"), F.lit("no"), F.lit("B"), option))
    prompt = T.substitute(F.lit("Q: {a} {b} {other}"), {"a": F.concat(free, F.lit(" {b}")), "b": F.col("item_id")})
    return table(spark, d, "benchmark").select("item_id", F.array_join(values, "|").alias("found"), prompt.alias("prompt"))


@query(
    r"""SELECT doc_id, regexp_matches(lower(text), '\bwhich papers\b|\bwhat papers\b|\blist (all|the)\b|\ball (of the )?papers (that|which)\b|\bevery paper\b|\bhow many papers\b|\bcompare\b|\bcomparison (of|between)\b|\bacross (the )?(papers|studies|works)\b|\bboth .+ and .+\b') AS listed,
  regexp_matches(text, '(^|[^A-Za-z0-9])(The|AKIA)($|[^A-Za-z0-9])') AS named, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS title FROM documents"""
)
def wording_flags(spark, d):
    """Enumerating questions, case-sensitive names, and texts as titles."""
    text = F.col("text")
    named = text.rlike(T.token_pattern("The")) | text.rlike(T.token_pattern("AKIA"))
    return table(spark, d, "documents").select("doc_id", T.is_enumeration(text).alias("listed"), named.alias("named"), T.normalize_title(text).alias("title"))


@query(
    """WITH r AS (SELECT event_id, (event_id % 40) || ', x,' || (event_id % 7) || ',0,' || (event_id % 40) AS s, event_type, user_id FROM events)
SELECT event_id, array_to_string(list_sort(list_distinct(list_filter([event_id % 40, event_id % 7], lambda x: x > 0))), '|') AS levels, 'run.type=' || event_type || ';run.user=' || user_id AS params FROM r"""
)
def level_lists(spark, d):
    """Recall levels of a comma list, and parameters under their section's name."""
    i = F.col("event_id")
    levels = T.parse_levels(joined(i % 40, ", x,", i % 7, ",0,", i % 40))
    params = selections.flat_params(F.create_map(F.lit("type"), "event_type", F.lit("user"), F.col("user_id").cast("string")), "run")
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return table(spark, d, "events").select("event_id", F.array_join(F.transform(levels, lambda x: x.cast("string")), "|").alias("levels"), shown.alias("params"))


# --- packing and chunking ----------------------------------------------------------------------


@query("SELECT doc_id, ((a - 1) // 4)::INTEGER AS n, a::INTEGER AS first, least(a + 3, pages)::INTEGER AS last FROM (SELECT doc_id, pages, unnest(range(1, pages + 1, 4)) AS a FROM (SELECT doc_id, n_chars // 500 AS pages FROM documents))")
def page_windows(spark, d):
    pages = F.floor(F.col("n_chars") / 500).cast("int")
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(chunking.page_windows(pages, 4)).alias("n", "w"))
    return rows.select("doc_id", "n", F.col("w.first").alias("first"), F.col("w.last").alias("last"))


@query(
    """WITH t AS (SELECT doc_id, substr(text, 1, 120) AS a, substr(text, 81, 120) AS b FROM documents),
k AS (SELECT *, list_max(list_filter(range(20, least(length(a), length(b)) + 1), lambda n: right(a, n) = left(b, n))) AS n FROM t)
SELECT doc_id, md5(CASE WHEN a = '' THEN b WHEN n IS NOT NULL THEN a || substr(b, n + 1) ELSE a || chr(10) || b END) AS merged FROM k"""
)
def overlap_concat(spark, d):
    texts = F.array(F.expr("substring(text, 1, 120)"), F.expr("substring(text, 81, 120)"))
    return table(spark, d, "documents").select("doc_id", F.md5(packing.merge_overlapping(texts, 20)).alias("merged"))


@query(
    """WITH RECURSIVE o AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
r AS (SELECT conv_id, turn, i, n AS used, true AS fits FROM o WHERE i = 1 UNION ALL
      SELECT o.conv_id, o.turn, o.i, CASE WHEN used + n <= 600 THEN used + n ELSE used END, used + n <= 600 FROM r JOIN o ON o.conv_id = r.conv_id AND o.i = r.i + 1)
SELECT conv_id, turn, fits, row_number() OVER (PARTITION BY conv_id ORDER BY fits DESC, i)::INTEGER AS place FROM r"""
)
def budget_overflow(spark, d):
    return packing.overflow_order(turns(spark, d).select("conv_id", "turn", "text"), ["conv_id"], [F.asc("turn")], 600).select("conv_id", "turn", "fits", "place")


@query(
    """WITH c AS (SELECT c_nationkey, c_name, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer)
SELECT c_nationkey AS table_id, string_agg('| ' || c_name || ' | a\\|' || lower(c_mktsegment) || ' |' || CASE WHEN r = 1 THEN chr(10) || '| --- | --- |' ELSE '' END, chr(10) ORDER BY r) AS markdown FROM c GROUP BY 1"""
)
def table_to_markdown(spark, d):
    """Customers of a nation as a table; a cell that is given twice has its last content, one outside the grid none."""
    from pyspark.sql import Window

    by = Window.partitionBy("c_nationkey")
    rows = table(spark, d, "customer").withColumns({"row": F.row_number().over(by.orderBy("c_custkey")) - 1, "n_rows": F.count("*").over(by).cast("int")})
    low = F.lower("c_mktsegment")
    cells = F.array(
        *(F.struct(F.lit(col).alias("col"), F.lit(pos).alias("pos"), content.alias("content")) for pos, (col, content) in enumerate([(0, F.lit("old")), (0, F.concat(F.lit(" "), "c_name", F.lit("\n"))), (1, F.concat(F.lit("a|"), low)), (7, F.lit("outside"))]))
    )
    cells = rows.select(F.col("c_nationkey").alias("table_id"), "n_rows", F.lit(2).alias("n_cols"), "row", F.explode(cells).alias("c")).select("table_id", "n_rows", "n_cols", "row", "c.*")
    return chunking.grid_to_markdown(cells)


@query(
    """SELECT printf('%d#c0000', doc_id) AS chunk_id, 'title_abstract' AS chunk_type, '[' || lang || ' ' || (1990 + doc_id % 30) || '] ' || source || chr(10) || left(text, 50) AS text,
  md5('Title: ' || source || chr(10) || 'Authors: ' || lang || ', x' || chr(10) || 'Venue: ' || lang || chr(10) || 'Year: ' || (1990 + doc_id % 30) || chr(10) || 'Track: ' || chr(10) || 'Award: ' || chr(10) || 'Abstract: ' || left(text, 50)) AS metadata FROM documents"""
)
def title_chunks(spark, d):
    null = F.lit(None).cast("string")
    papers = table(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), F.col("lang").alias("venue"), (1990 + F.col("doc_id") % 30).alias("year"), F.col("source").alias("title"), F.expr("substring(text, 1, 50)").alias("abstract"), F.array("lang", F.lit("x")).alias("authors"), null.alias("track"), null.alias("award"))
    chunks = chunking.title_chunks(papers)
    texts = papers.select("paper_id", F.md5(chunking.metadata_text()).alias("metadata"))
    return chunks.join(texts, "paper_id").select("chunk_id", "chunk_type", "text", "metadata")


@query(
    r"""WITH b AS (SELECT *, CASE role WHEN 'user' THEN 'sectionHeading' WHEN 'assistant' THEN CASE turn % 3 WHEN 0 THEN 'footnote' WHEN 1 THEN NULL ELSE 'formula' END ELSE 'pageHeader' END AS r, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS t FROM conversations),
l AS (SELECT * FROM b WHERE coalesce(r, '') <> 'pageHeader' AND t <> '')
SELECT conv_id AS paper_id, turn AS pos, last_value(CASE WHEN r = 'sectionHeading' THEN left(t, 200) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section,
  CASE WHEN coalesce(r, '') IN ('', 'footnote') THEN t ELSE '[' || r || '] ' || t END AS text FROM l"""
)
def paragraph_units(spark, d):
    answer = F.when(F.col("turn") % 3 == 0, "footnote").when(F.col("turn") % 3 == 2, "formula")
    role = F.when(F.col("role") == "user", "sectionHeading").when(F.col("role") == "assistant", answer).otherwise("pageHeader")
    rows = turns(spark, d).select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("pos"), F.col("text").alias("content"), role.alias("role"), F.col("no").alias("page"))
    return chunking.paragraph_units(rows).select("paper_id", "pos", "section", "text")


@query(
    r"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, '. ', chr(10) || ' ' || chr(10)), '\n\s*\n'), lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13))), lambda x: x <> '') AS p FROM documents)
SELECT doc_id AS paper_id, (i - 1)::INTEGER AS pos, md5(p[i]) AS text FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM p)"""
)
def fallback_units(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), F.replace("text", F.lit(". "), F.lit("\n \n")).alias("content"))
    return chunking.fallback_units(docs).select("paper_id", "pos", F.md5("text").alias("text"))


@query("SELECT conv_id AS paper_id, string_agg(p || ':' || md5(text), ',' ORDER BY turn, p) AS units FROM (SELECT conv_id, turn, text, unnest([turn * 4 + 1, turn * 4 + 3]) AS p FROM conversations) GROUP BY 1")
def stitched_windows(spark, d):
    """Units of windows of four pages, numbered within their window, as one list of the document's pages."""
    units = F.array(*(F.struct(F.lit(p).alias("page"), F.md5("text").alias("text")) for p in (1, 3)))
    rows = turns(spark, d).select(F.col("conv_id").alias("paper_id"), (F.col("turn") * 4 + 1).cast("int").alias("first"), units.alias("units"))
    return chunking.stitch(rows).select("paper_id", F.array_join(F.transform("units", lambda u: F.concat(u["page"].cast("string"), F.lit(":"), u["text"])), ",").alias("units"))


# --- evidence ----------------------------------------------------------------------------------

_CONTEXT = """
ctx AS (SELECT conv_id AS query_id, 'C' || (turn + 1) AS label, turn, conv_id * 10 + turn % 2 AS doc_id, CASE role WHEN 'user' THEN 'table' ELSE 'text_span' END AS source_type,
        CASE WHEN turn % 5 < 4 THEN (turn // 3)::VARCHAR END AS page, CASE role WHEN 'user' THEN 'table ' || (turn % 3) ELSE '' END AS object_id FROM conversations)
"""


def context_rows(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("role") == "user", "table").otherwise("text_span")
    page = F.when(F.col("turn") % 5 < 4, F.floor(F.col("turn") / 3).cast("string"))
    return turns(spark, d).select(F.col("conv_id").alias("query_id"), joined("C", F.col("no")).alias("label"), (F.col("conv_id") * 10 + F.col("turn") % 2).alias("doc_id"), kind.alias("source_type"), page.alias("page"), joined("Table ", F.col("turn") % 3).alias("table_id"), F.lit("").alias("figure_id"), "text", "turn")


@query(
    f"""WITH {_CONTEXT}, c AS (SELECT *, -turn AS pos FROM ctx WHERE page IS NOT NULL AND (doc_id % 2 = 0 OR query_id % 2 = 0)),
l AS (SELECT * FROM c QUALIFY page = first_value(page) OVER (PARTITION BY query_id, doc_id ORDER BY pos)),
k AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY query_id, doc_id, source_type, page, object_id ORDER BY pos) = 1)
SELECT query_id, printf('ev_%03d', row_number() OVER (PARTITION BY query_id ORDER BY pos)) AS evidence_id, label, doc_id, page FROM k QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos) <= 4"""
)
def evidence_from_citations(spark, d):
    """Turns cited from the last to the first, of selected documents only."""
    context = context_rows(spark, d)
    cites = context.select("query_id", F.negative("turn").alias("pos"), F.concat(F.lit("[ c"), F.expr("substring(label, 2)"), F.lit(" ]")).alias("label"))
    selected = context.where((F.col("doc_id") % 2 == 0) | (F.col("query_id") % 2 == 0)).select("query_id", "doc_id")
    return evidence.from_citations(cites, context.drop("turn"), selected).select("query_id", "evidence_id", "label", "doc_id", "page")


@query(
    f"""WITH {_CONTEXT}, m AS (SELECT *, CASE WHEN turn = 0 THEN 1 ELSE 0 END AS meta, CASE WHEN turn = 0 THEN 'metadata' ELSE source_type END AS st, CASE WHEN turn = 0 THEN '' ELSE object_id END AS o FROM ctx),
k AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query_id, doc_id, st, coalesce(page, ''), o ORDER BY meta, turn) = 1)
SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY meta, turn)::INTEGER AS place FROM k QUALIFY place <= 2"""
)
def evidence_fallback(spark, d):
    """Turns in order, one for each key, the first turn (metadata) last."""
    rows = context_rows(spark, d).withColumn("source_type", F.when(F.col("turn") == 0, "metadata").otherwise(F.col("source_type"))).withColumn("rank", F.col("turn"))
    return evidence.fallback(rows, 2).select("query_id", "label", "place")


@query("SELECT DISTINCT o.conv_id AS query_id, o.conv_id % 10 AS doc_id, o.turn AS chunk_id FROM conversations o JOIN conversations s ON s.conv_id = o.conv_id AND s.role = 'user' AND s.turn % 4 = 0 AND s.turn IN (o.turn, o.turn + 1) WHERE o.role = 'assistant'")
def reanchored_by_page(spark, d):
    """Answers whose pages, their own and the next, hold a cited turn."""
    rows = turns(spark, d).withColumns({"query_id": F.col("conv_id"), "doc_id": F.col("conv_id") % 10})
    objects = rows.where("role = 'assistant'").select("query_id", "doc_id", F.col("turn").alias("chunk_id"), F.array("turn", "no").alias("pages"))
    spans = rows.where("role = 'user' and turn % 4 = 0").select("query_id", "doc_id", F.col("turn").alias("page"))
    return evidence.reanchor_by_page(spans, objects).select("query_id", "doc_id", "chunk_id")


@query("SELECT conv_id AS query_id, turn AS chunk_id FROM conversations WHERE (role = 'user' AND turn = conv_id % 7) OR (role <> 'user' AND turn = conv_id % 3)")
def reanchored_by_reference(spark, d):
    """Turns as numbered tables and figures, of which the question names one each."""
    rows = turns(spark, d)
    questions = rows.select(F.col("conv_id").alias("query_id"), joined("See Table ", F.col("conv_id") % 7, " and fig. ", F.col("conv_id") % 3).alias("question")).distinct()
    kind = F.when(F.col("role") == "user", "table").otherwise("figure")
    objects = rows.select(F.col("conv_id").alias("query_id"), F.lit(1).alias("doc_id"), F.col("turn").alias("chunk_id"), kind.alias("source_type"), joined(F.initcap(kind), " ", F.col("turn")).alias("object_id"))
    return evidence.reanchor_by_reference(questions, objects).select("query_id", "chunk_id")


@query(
    r"""WITH n AS (SELECT conv_id, turn, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM conversations), v AS (SELECT conv_id, string_split(t, ' ')[2] AS v FROM n WHERE turn = 0)
SELECT n.conv_id AS query_id, turn AS chunk_id, v AS value FROM n JOIN v ON n.conv_id = v.conv_id WHERE v <> '' AND contains(t, v)"""
)
def reanchored_by_value(spark, d):
    """Turns that hold the second word of their conversation's first."""
    rows = turns(spark, d)
    values = rows.where("turn = 0").select(F.col("conv_id").alias("query_id"), F.lit(1).alias("doc_id"), F.get(F.split(T.match_text(F.col("text")), " "), F.lit(1)).alias("value"))
    objects = rows.select(F.col("conv_id").alias("query_id"), F.lit(1).alias("doc_id"), F.col("turn").alias("chunk_id"), F.col("text").alias("content"))
    return evidence.reanchor_by_value(values, objects).select("query_id", "chunk_id", "value")


@query(
    """WITH c AS (SELECT conv_id AS paper_id, turn, role AS source_type, turn // 2 AS page, CASE WHEN turn % 2 = 0 THEN 'table' ELSE '' END AS object_id FROM conversations)
SELECT paper_id, turn, turn % 3 <> 1 OR EXISTS (SELECT 1 FROM c o WHERE o.paper_id = c.paper_id AND o.source_type = c.source_type AND o.page = c.page AND o.object_id = c.object_id AND o.turn % 3 <> 1) AS before,
  turn % 3 <> 2 OR EXISTS (SELECT 1 FROM c o WHERE o.paper_id = c.paper_id AND o.source_type = c.source_type AND o.page = c.page AND o.object_id = c.object_id AND o.turn % 3 <> 2) AS after FROM c"""
)
def gold_key_coverage(spark, d):
    """Which gold items are among the chunks before and after a repair."""
    rows = turns(spark, d).select(F.col("conv_id").alias("paper_id"), "turn", F.col("role").alias("source_type"), F.floor(F.col("turn") / 2).alias("page"), F.when(F.col("turn") % 2 == 0, " TABLE ").otherwise("").alias("object_id"))
    return locators.gold_coverage(rows, rows.where("turn % 3 <> 1"), rows.where("turn % 3 <> 2")).select("paper_id", "turn", "before", "after")


@query(
    """WITH t AS (SELECT conv_id AS doc_id, turn AS pos, turn % 4 AS n FROM conversations WHERE role = 'assistant'), w AS (SELECT * FROM t WHERE n IN (1, 3))
SELECT doc_id, pos FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 2"""
)
def figure_mentions(spark, d):
    """The first two answers that mention figure 1 or 3."""
    kind = F.when(F.col("role") == "assistant", "text_span").otherwise("table")
    chunks = turns(spark, d).select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), kind.alias("chunk_type"), joined(F.col("text"), " as Fig. ", F.col("turn") % 4, " shows").alias("text"))
    wanted = chunks.select("doc_id", F.array(F.lit("1"), F.lit("3")).alias("numbers")).distinct()
    return evidence.figure_context(chunks, wanted, 2).select("doc_id", "pos")


@query(
    """WITH t AS (SELECT conv_id AS doc_id, turn AS pos, role, 1 + turn % 6 AS n FROM conversations)
SELECT doc_id, pos, n::INTEGER AS n_cited, row_number() OVER (PARTITION BY doc_id ORDER BY role = 'user' DESC, n DESC, pos)::INTEGER AS place FROM t WHERE n >= 3"""
)
def comparison_chunks(spark, d):
    """Turns by the citations that they hold, those of users (tables) first."""
    kind = F.when(F.col("role") == "user", "table").otherwise("text_span")
    cited = F.repeat(F.lit("Name (2020), see also (Other, 2019a) (n) "), (1 + F.col("turn") % 6).cast("int"))
    chunks = turns(spark, d).select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), kind.alias("chunk_type"), cited.alias("text"))
    return evidence.comparison_context(chunks).select("doc_id", "pos", "n_cited", "place")


@query("SELECT event_id, coalesce((props->>'k')::INTEGER, event_id % 9)::INTEGER AS page, event_type AS section FROM events")
def locator_fallback(spark, d):
    """Locators parsed from JSON; page and section fall back to the row's own."""
    json = F.regexp_replace("props", '"k"', '"page"')
    built = evidence.locator(json, F.array((F.col("event_id") % 9).cast("int")), F.col("event_type"))
    return table(spark, d, "events").select("event_id", built["page"].alias("page"), built["section"].alias("section"))


@query(
    r"""WITH e AS (SELECT item_id, trim(regexp_replace(lower('In: ' || text), '[^a-z0-9]+', ' ', 'g')) AS e FROM benchmark), t AS (SELECT item_id, trim(regexp_replace(lower(substr(text, 1, 20 + item_id % 9)), '[^a-z0-9]+', ' ', 'g')) AS t FROM benchmark)
SELECT e.item_id AS entry_id, arg_min(t.item_id, (-length(t), t.item_id)) AS doc_id FROM e JOIN t ON length(t) >= 15 AND contains(e, t) GROUP BY 1"""
)
def cited_titles(spark, d):
    """Benchmark texts as reference entries, their beginnings as titles."""
    rows = table(spark, d, "benchmark")
    entries = rows.select(F.col("item_id").alias("entry_id"), joined("In: ", F.col("text")).alias("text"))
    titles = rows.select(F.col("item_id").alias("doc_id"), F.expr("substring(text, 1, cast(20 + item_id % 9 AS int))").alias("title"))
    return entities.title_resolution(entries, titles)


# --- hits --------------------------------------------------------------------------------------


@query(hits_sql(", g AS (SELECT hits.query_id, source, hits.rank, score, text FROM hits JOIN documents USING (doc_id)) SELECT query_id, source, md5(arg_min(substr(text, 1, 200), (-score, rank))) AS snippet FROM g GROUP BY ALL", 20))
def best_snippets(spark, d):
    hits = bm25(spark, d, 20).join(chunks_of(spark, d).select("doc_id", "source", "text"), "doc_id").drop("doc_id").withColumnRenamed("source", "doc_id")
    return ranking.best_snippets(hits).select("query_id", F.col("doc_id").alias("source"), F.md5("snippet").alias("snippet"))


@query(hits_sql(", a AS (SELECT query_id, doc_id, 1 AS s FROM hits UNION ALL SELECT query_id, doc_id, 0 FROM thits) SELECT query_id, doc_id, min(s)::INTEGER AS first_sub FROM a GROUP BY ALL", 10, _TERMS))
def first_wording(spark, d):
    every = bm25(spark, d).withColumn("sub_no", F.lit(1)).unionByName(shared_terms(spark, d).withColumn("sub_no", F.lit(0)))
    return search.first_attribution(every)


@query(hits_sql(", w AS (SELECT query_id, chunk_id, n_chars FROM hits JOIN documents USING (doc_id)) SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, chunk_id)::INTEGER AS rank FROM w QUALIFY rank <= 5", 15))
def rerank_over_fetched(spark, d):
    """Three times as many hits as wanted, reranked by length; without a reranker the order stands."""
    sizes = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("n_chars").cast("double").alias("score"))
    hits = search.Unchanged()(bm25(spark, d, 20))
    return ranking.rerank(hits, 5, lambda h: h.drop("score").join(sizes, "chunk_id")).select("query_id", "chunk_id", "rank")


@query("SELECT item_id, greatest(1, coalesce(CASE WHEN item_id % 4 > 0 THEN item_id % 4 - 1 END, CASE WHEN item_id % 8 = 0 THEN 1 ELSE 4 END))::INTEGER AS n FROM benchmark")
def submission_sizes(spark, d):
    family = F.when(F.col("item_id") % 8 == 0, T.SINGLE).otherwise(T.MULTI)
    asked = F.when(F.col("item_id") % 4 > 0, F.col("item_id") % 4 - 1).cast("int")
    return table(spark, d, "benchmark").select("item_id", ranking.final_count(family, asked).alias("n"))


# --- selections --------------------------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN true ELSE doc_id % 4 = 1 END AS missing, lang || ',' || source AS papers FROM documents WHERE doc_id % 3 > 0 AND source IN (SELECT DISTINCT source FROM documents WHERE doc_id % 5 = 0)")
def image_chunks(spark, d):
    """Chunks with an image among the files; pages that are missing; papers as a submission has them."""
    page = F.when(F.col("doc_id") % 4 == 1, " ").when(F.col("doc_id") % 4 > 1, F.col("doc_id").cast("string"))
    docs = table(spark, d, "documents").withColumn("image_path", F.when(F.col("doc_id") % 3 > 0, F.col("source")).otherwise(""))
    files = docs.where("doc_id % 5 = 0").select(F.col("source").alias("path"))
    papers = selections.submission(F.array("lang", "source"))
    return selections.with_images(docs, files).select("doc_id", selections.page_missing(page).alias("missing"), F.array_join(F.transform(papers, lambda p: p["paper_id"]), ",").alias("papers"))


@query("SELECT user_id AS query_id, array_to_string(list_distinct_ordered, '|') AS papers FROM (SELECT user_id, CASE WHEN arg_max(event_type, event_id) = arg_max(event_id % 3, event_id)::VARCHAR THEN [arg_max(event_type, event_id)] ELSE [arg_max(event_type, event_id), arg_max(event_id % 3, event_id)::VARCHAR] END AS list_distinct_ordered FROM events GROUP BY 1)")
def gold_of_last_row(spark, d):
    """The last list of each id, blanks and repetitions dropped."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("pos"), F.array(F.concat(F.lit(" "), "event_type"), F.lit(" "), (F.col("event_id") % 3).cast("string"), F.col("event_type")).alias("papers"))
    return selections.gold_lists(rows).select("query_id", F.array_join("papers", "|").alias("papers"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'Table ' || user_id ELSE '' END AS table_id, CASE WHEN event_id % 2 = 1 AND event_id % 3 > 0 THEN 'Figure ' || user_id ELSE '' END AS figure_id FROM events")
def embedded_locators(spark, d):
    even = F.col("event_id") % 2 == 0
    json = F.when(even, F.to_json(F.struct(joined("Table ", F.col("user_id")).alias("table_id")))).when(F.col("event_id") % 3 > 0, F.to_json(F.struct(joined("Figure ", F.col("user_id")).alias("figure_id"))))
    a, b = selections.embedded_rows(table(spark, d, "events"))
    return table(spark, d, "events").withColumn("locator_json", json).select("event_id", a.alias("table_id"), b.alias("figure_id"))


@query(
    """WITH c AS (SELECT user_id AS query_id, count(*) FILTER (WHERE event_id % 11 = 0) AS n_empty, count(*) FILTER (WHERE event_id % 13 = 0) AS n_superscript FROM events GROUP BY 1)
SELECT * FROM c WHERE n_empty > 0 OR n_superscript > 0"""
)
def ocr_suspects(spark, d):
    """Events as rows of table answers, some cells empty, some a lone superscript."""
    i = F.col("event_id")
    cells = F.create_map(F.lit("type"), F.col("event_type"), F.lit("a"), F.when(i % 11 == 0, " ").otherwise("x²"), F.lit("b"), F.when(i % 13 == 0, " ²³ "))
    return selections.ocr_suspects(table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("row_no"), cells.alias("cells")))


# --- logs and runs -----------------------------------------------------------------------------


@query(
    """WITH e AS (SELECT event_id, event_type, props->>'k' AS k FROM events)
SELECT 'type' AS name, count(DISTINCT event_type) AS n_values, min(event_id) AS first_run, 0 AS first_pos FROM e
UNION ALL SELECT 'k', count(DISTINCT k) FILTER (WHERE event_id % 3 > 0) + CASE WHEN count(k) FILTER (WHERE event_id % 3 > 0) < count(*) THEN 1 ELSE 0 END, min(event_id) FILTER (WHERE event_id % 3 > 0), 2 FROM e"""
)
def param_diff(spark, d):
    """Events as runs: parameters that differ, one of which a third of the runs lacks."""
    k, const = F.get_json_object("props", "$.k"), F.lit("x")
    params = F.when(F.col("event_id") % 3 > 0, F.create_map(F.lit("type"), "event_type", F.lit("const"), const, F.lit("k"), k)).otherwise(F.create_map(F.lit("type"), "event_type", F.lit("const"), const))
    return logs.varying_params(table(spark, d, "events").select(F.col("event_id").alias("run_no"), params.alias("params")))


@query("SELECT event_id AS run_no, row_number() OVER (ORDER BY event_id)::INTEGER AS line FROM (SELECT event_id FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 20)")
def experiment_tail(spark, d):
    runs = table(spark, d, "events").withColumnRenamed("event_id", "run_no")
    return logs.experiment_tail(runs, F.col("event_type") == "error", 20).select("run_no", "line")


@query(
    """WITH t AS (SELECT user_id AS query_id, date_diff('day', DATE '2020-01-01', ts::DATE)::INTEGER AS day, count(*) AS total FROM events GROUP BY ALL),
b AS (SELECT *, coalesce(lag(total) OVER (PARTITION BY query_id ORDER BY day), 0) AS before FROM t),
g AS (SELECT query_id, day, total, round(CASE WHEN before = 0 THEN 1.0 ELSE (total - before) / before END, 6) AS growth FROM b),
i AS (SELECT *, sum((growth > 0)::INTEGER) OVER (PARTITION BY query_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT query_id, day, total, growth, sum((growth <= 0)::INTEGER) OVER (PARTITION BY query_id, island ORDER BY day ROWS UNBOUNDED PRECEDING)::BIGINT AS stagnant FROM i"""
)
def growth_rate(spark, d):
    """A user's events of a day as what a round found."""
    day = F.datediff(F.to_date("ts"), F.lit("2020-01-01").cast("date"))
    rounds = table(spark, d, "events").groupBy(F.col("user_id").alias("query_id"), day.alias("round")).agg(F.count("*").alias("total"))
    return ranking.growth(rounds).withColumnRenamed("round", "day")


@query("SELECT user_id AS paper_id, arg_max(event_type, event_id) AS archive FROM events WHERE event_type <> 'view' GROUP BY 1")
def archive_of_papers(spark, d):
    archive = F.when(F.col("event_type") != "view", F.col("event_type")).otherwise("")
    return logs.archive_map(table(spark, d, "events").select(F.col("user_id").alias("paper_id"), F.col("event_id").alias("pos"), archive.alias("archive")))


@query(
    """WITH l AS (SELECT user_id AS key, arg_max(event_type, event_id) AS last, count(*) AS n, bool_and(event_type IN ('view', 'click', 'purchase')) AS whole FROM events GROUP BY 1)
SELECT c_custkey AS key, CASE WHEN c_custkey % 3 > 0 AND c_custkey % 3 * 500 >= 600 AND coalesce(last, '') <> 'error' THEN 'skip' WHEN c_custkey % 3 > 0 THEN 'redo' ELSE 'fetch' END AS action,
  CASE WHEN last = 'error' AND n < 40 THEN n END AS tries, coalesce(whole, false) AS completed FROM customer LEFT JOIN l ON c_custkey = key"""
)
def skip_and_retry(spark, d):
    """What to do with each customer's file, how often it was tried if it failed last, and whether all its uploads went up."""
    key = table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    log = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("pos"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"))
    files = key.where("key % 3 > 0").withColumn("bytes", F.col("key") % 3 * 500)
    plan = logs.skip_decision(key, log, files, "key", 600)
    kind = F.when(F.col("event_type") == "view", "embed_skipped").when(F.col("event_type").isin("click", "purchase"), "ok").otherwise("failed")
    done = ingest.completed(table(spark, d, "events").select(F.col("user_id").alias("key"), kind.alias("status")), "key").withColumn("completed", F.lit(True))
    out = plan.join(ingest.retry_pass(log, "key", 40), "key", "left").join(done, "key", "left")
    return out.select("key", "action", "tries", F.coalesce("completed", F.lit(False)).alias("completed"))


_LINT_ROWS = """
p AS (SELECT doc_id, CASE WHEN doc_id % 41 = 0 THEN ' ' ELSE 'q' || (doc_id % 300) END AS q, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN [] WHEN doc_id % 5 = 0 THEN [source, ' '] WHEN doc_id % 9 = 0 THEN [source, source] ELSE [source, lang] END AS papers,
  doc_id % 37 = 0 AS no_evidence, CASE doc_id % 13 WHEN 0 THEN 'other' ELSE 'table' END AS kind, CASE doc_id % 17 WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE '3' END AS page, CASE doc_id % 23 WHEN 0 THEN ' ' ELSE 't' END AS t,
  source AS paper, CASE WHEN doc_id % 29 > 0 THEN 'b' END AS answer, doc_id % 31 = 0 AS short, CASE doc_id % 19 WHEN 0 THEN 5 ELSE 1 END AS n FROM documents)
"""
_LINT = {
    "blank_query_id": "trim(q) = ''",
    "papers_missing": "papers IS NULL",
    "papers_empty": "len(coalesce(papers, [])) = 0",
    "paper_id_blank": "len(list_filter(coalesce(papers, []), lambda x: trim(x) = '')) > 0",
    "papers_repeated": "len(list_distinct(list_transform(coalesce(papers, []), lambda x: trim(x)))) < len(coalesce(papers, []))",
    "evidence_missing": "no_evidence",
    "evidence_too_many": "NOT no_evidence AND n > 4",
    "evidence_type_unknown": "NOT no_evidence AND kind = 'other'",
    "evidence_paper_foreign": "NOT no_evidence AND NOT list_contains(coalesce(papers, []), paper)",
    "evidence_page_blank": "NOT no_evidence AND page = ''",
    "evidence_page_not_number": "NOT no_evidence AND page = 'x'",
    "evidence_text_blank": "NOT no_evidence AND trim(t) = ''",
    "answer_missing": "answer IS NULL",
    "choice_not_offered": "answer IS NOT NULL AND short",
}


@query(
    f"""WITH {_LINT_ROWS}, g AS (SELECT 'q' || i AS q FROM range(0, 400) t(i)),
f AS ({" UNION ALL ".join(f"SELECT q, '{name}' AS c FROM p WHERE {cond}" for name, cond in _LINT.items())}
  UNION ALL SELECT q, 'query_id_repeated' FROM p GROUP BY q HAVING count(*) > 1 UNION ALL SELECT q, 'query_missing' FROM g WHERE q NOT IN (SELECT q FROM p) UNION ALL SELECT DISTINCT q, 'query_unknown' FROM p WHERE q NOT IN (SELECT q FROM g)),
c AS (SELECT unnest([{", ".join(f"'{n}'" for n in (*_LINT, "query_id_repeated", "query_missing", "query_unknown"))}]) AS c),
e AS (SELECT c, string_agg(q, ',' ORDER BY q) AS examples FROM (SELECT DISTINCT c, q FROM f QUALIFY dense_rank() OVER (PARTITION BY c ORDER BY q) <= 5) GROUP BY 1)
SELECT c AS "check", count(f.q) AS n, coalesce(any_value(examples), '') AS examples FROM c LEFT JOIN f USING (c) LEFT JOIN e USING (c) GROUP BY 1"""
)
def lint_checks(spark, d):
    """Documents as predictions with every kind of fault, against 400 gold ids."""
    i, source = F.col("doc_id"), F.col("source")
    query_id = F.when(i % 41 == 0, " ").otherwise(joined("q", i % 300))
    none = F.array().cast("array<string>")
    papers = F.when(i % 7 == 0, F.lit(None)).when(i % 11 == 0, none).when(i % 5 == 0, F.array(source, F.lit(" "))).when(i % 9 == 0, F.array(source, source)).otherwise(F.array("source", "lang"))
    item = F.struct(source.alias("paper_id"), F.when(i % 13 == 0, "other").otherwise("table").alias("source_type"), F.when(i % 17 == 0, "").when(i % 17 == 1, "x").otherwise("3").alias("page"), F.when(i % 23 == 0, " ").otherwise("t").alias("text"))
    items = F.when(i % 37 > 0, F.array_repeat(item, F.when(i % 19 == 0, 5).otherwise(1)))
    offered = F.when(i % 31 == 0, F.create_map(F.lit("A"), F.lit("u"))).otherwise(F.create_map(F.lit("A"), F.lit("u"), F.lit("B"), F.lit("v")))
    rows = table(spark, d, "documents").select(query_id.alias("query_id"), papers.alias("gold_papers"), items.alias("evidence"), F.when(i % 29 > 0, "b").alias("answer"), offered.alias("options"))
    return lint.lint(rows, spark.range(400).select(F.concat(F.lit("q"), F.col("id").cast("string")).alias("query_id")))
