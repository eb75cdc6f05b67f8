"""Evidence: citations to chunks, anchors, merges and local look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import blank_if_null, contains_value, normalize_object_id, normalize_visible_id, strip
from quillstone.operators.ranking import evidence_numbers

CAP = 4


def locator(json: Column, page_numbers: Column, section: Column) -> Column:
    """Parsed locator with the page falling back to the first page number and the section to the chunk's."""
    parsed = F.from_json(blank_if_null(json), "page INT, section STRING, table_id STRING, figure_id STRING, equation_id STRING")
    return F.struct(F.coalesce(parsed["page"], F.get(page_numbers, F.lit(0))).alias("page"), F.coalesce(parsed["section"], section).alias("section"), parsed["table_id"].alias("table_id"), parsed["figure_id"].alias("figure_id"), parsed["equation_id"].alias("equation_id"))


def coarse_key() -> Column:
    """(doc_id, source_type, page, object id of tables and figures) as a struct of strings."""
    obj = F.when(F.col("source_type") == "table", normalize_visible_id(F.col("table_id"), "table")).when(F.col("source_type") == "figure", normalize_visible_id(F.col("figure_id"), "figure")).otherwise("")
    return F.struct(strip(blank_if_null(F.col("doc_id"))).alias("doc_id"), strip(blank_if_null(F.col("source_type"))).alias("source_type"), strip(blank_if_null(F.col("page"))).alias("page"), obj.alias("object_id"))


def from_citations(citations: DataFrame, context: DataFrame, selected: DataFrame, cap: int = CAP) -> DataFrame:
    """Evidence of cited labels: citations (query_id, pos, label) to context (query_id, label, doc_id, source_type, page, table_id, figure_id, text).

    Labels like "[ c3 ]" are C3; only selected documents count and rows with a page; a document's
    evidence keeps to the page of its first row; equal keys count once; cap rows a query.
    """
    norm = F.upper(F.regexp_replace(F.col("label"), r"[\[\]\s]", ""))
    rows = citations.withColumn("label", norm).join(context.withColumn("label", F.upper("label")), ["query_id", "label"]).join(selected.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi")
    rows = rows.where("page is not null and trim(cast(page as string)) <> ''")
    locus = F.first("page").over(Window.partitionBy("query_id", "doc_id").orderBy("pos"))
    rows = rows.withColumn("locus", locus).where("page = locus").drop("locus").withColumn("key", coarse_key())
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "key").orderBy("pos"))).where("n = 1").drop("n", "key")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).where(F.col("n") <= cap).drop("n")
    return evidence_numbers(rows, ["query_id"], [F.asc("pos")])


def fallback(hits: DataFrame, limit: int = 2) -> DataFrame:
    """Evidence in retrieval order, chunks other than metadata first, one for each key."""
    rows = hits.withColumn("key", coarse_key()).withColumn("meta", (F.col("source_type") == "metadata").cast("int"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "key").orderBy("meta", "rank"))).where("n = 1")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("meta", "rank"))).where(F.col("place") <= limit)
    return rows.drop("n", "key", "meta")


def reanchor_by_page(spans: DataFrame, objects: DataFrame) -> DataFrame:
    """Tables and figures (query_id, doc_id, pages, ...) on a page that a cited text span (query_id, doc_id, page) stands on."""
    on = objects.withColumn("page", F.explode("pages"))
    return on.join(spans.select("query_id", "doc_id", "page").distinct(), ["query_id", "doc_id", "page"], "left_semi").dropDuplicates(["query_id", "doc_id", "chunk_id"])


def object_references(question: Column) -> Column:
    """Normalized distinct table and figure mentions, such as table 3, in order."""
    found = F.regexp_extract_all(question, F.lit(r"(?i)\b((?:table|tab\.|figure|fig\.?)\s*[0-9]+[a-z]?)\b"), 1)
    return F.array_distinct(F.transform(found, lambda m: F.concat(F.when(F.lower(m).startswith("t"), "table ").otherwise("figure "), F.regexp_extract(F.lower(m), "([0-9]+[a-z]?)$", 1))))


def reanchor_by_reference(questions: DataFrame, objects: DataFrame) -> DataFrame:
    """objects (query_id, doc_id, source_type, object_id) that their question names."""
    wanted = questions.select("query_id", F.explode(object_references(F.col("question"))).alias("wanted"))
    keyed = objects.withColumn("wanted", F.concat(F.col("source_type"), F.lit(" "), normalize_object_id(F.col("object_id"))))
    return keyed.join(wanted, ["query_id", "wanted"], "left_semi").drop("wanted")


def reanchor_by_value(values: DataFrame, objects: DataFrame) -> DataFrame:
    """objects whose content holds an answer value (query_id, doc_id, value) of their document; numbers not within longer ones."""
    return objects.join(values, ["query_id", "doc_id"]).where(contains_value(F.col("content"), F.col("value"))).select("query_id", "doc_id", "chunk_id", "value").distinct()


def merge_evidence(primary: DataFrame, model: DataFrame, backfill: DataFrame, cap: int = CAP) -> DataFrame:
    """Up to cap rows a query: primary ones (one place is left where the model gave any), then the model's, then more;
    equal keys count once and at most one text span is kept where a figure is among them."""
    tag = lambda df, n: df.withColumn("phase", F.lit(n))
    rows = tag(primary, 0).unionByName(tag(model, 1)).unionByName(tag(backfill, 2)).withColumn("key", coarse_key())
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "key").orderBy("phase", "pos"))).where("n = 1")
    query = Window.partitionBy("query_id")
    rows = rows.withColumns({"any_model": F.max((F.col("phase") == 1).cast("int")).over(query), "figure": F.max((F.col("source_type") == "figure").cast("int")).over(query)})
    rows = rows.withColumn("span_no", F.row_number().over(Window.partitionBy("query_id", F.col("source_type") == "text_span").orderBy("phase", "pos")))
    rows = rows.where(~((F.col("figure") == 1) & (F.col("source_type") == "text_span") & (F.col("span_no") > 1)))
    rows = rows.withColumn("phase_no", F.row_number().over(Window.partitionBy("query_id", "phase").orderBy("pos")))
    late = (F.col("phase") == 0) & (F.col("any_model") == 1) & (F.col("phase_no") > cap - 1)
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(late, "phase", "pos"))).where(F.col("place") <= cap)
    return evidence_numbers(rows.drop("n", "key", "any_model", "figure", "span_no", "phase_no"), ["query_id"], [F.asc("place")])


def page_fanout(quote: Column, content: Column, pages: Column) -> Column:
    """The primary page and at most one more: the page at which the quote stands if pages share the content evenly; none where it stands on the primary."""
    at = F.instr(content, quote)
    share = F.greatest(F.ceil(F.length(content) / F.size(pages)), F.lit(1))
    page = F.get(pages, F.least(F.floor((at - 1) / share), F.size(pages) - 1).cast("int"))
    first = F.get(pages, F.lit(0))
    return F.when(F.size(pages) == 0, F.array().cast("array<int>")).when((at > 0) & (page != first), F.array(first, page)).otherwise(F.array(first))


def reference_entry(text: Column, number: Column) -> Column:
    """Entry [n] of a reference list: what stands from the mark to the next one."""
    after = F.substring(text, F.instr(text, F.concat(F.lit("["), number.cast("string"), F.lit("]"))), F.length(text))
    found = F.instr(text, F.concat(F.lit("["), number.cast("string"), F.lit("]"))) > 0
    return F.when(found, strip(F.regexp_extract(after, r"(?s)^(\[[0-9]+\].*?)(?=\n?\[[0-9]+\]|$)", 1)))


#: What dense reference lists are made of.
REFERENCE_MARK = r"(,\s*20[0-9][0-9][a-z]?\.|arXiv|\bIn Proceedings\b|\bIn International\b)"


def extended_region(chunks: DataFrame, reach: int = 6, least: int = 8) -> DataFrame:
    """Chunks (doc_id, pos, source_type, text, in_region) of the reference region and of the dense ones right after its last one.

    Of the reach chunks that follow, tables, figures and metadata are passed over, and the first other one with fewer than least marks ends it.
    """
    doc = Window.partitionBy("doc_id")
    place = F.row_number().over(doc.orderBy("pos"))
    rows = chunks.withColumn("__n", place).withColumn("__last", F.max(F.when(F.col("in_region"), F.col("__n"))).over(doc))
    other = F.col("source_type").isin("table", "figure", "metadata")
    near = (F.col("__n") > F.col("__last")) & (F.col("__n") <= F.col("__last") + reach)
    thin = near & ~other & (F.regexp_count("text", F.lit(REFERENCE_MARK)) < least)
    ended = F.sum(thin.cast("int")).over(doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    kept = rows.withColumn("__ended", ended).where(F.col("in_region") | (near & ~other & (F.col("__ended") == 0)))
    return kept.drop("__n", "__last", "__ended")


def last_reference(text: Column) -> Column:
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^\s*\[([0-9]+)\]"), 1), lambda x: x.try_cast("int"))
    return F.array_max(numbers)


def equation_line(text: Column, number: Column) -> Column:
    """The line that ends with (number) and holds a mathematical sign."""
    lines = F.split(text, "\n")
    mark = F.concat(F.lit("("), number.cast("string"), F.lit(")"))
    return F.get(F.filter(F.transform(lines, strip), lambda x: x.endswith(mark) & x.rlike(r"[=+\-*/^\\<>∑∫≤≥]")), F.lit(0))


def figure_context(chunks: DataFrame, wanted: DataFrame, limit: int = 4) -> DataFrame:
    """The first text chunks of a document that mention one of its wanted figure numbers (doc_id, numbers)."""
    seen = F.regexp_extract_all(F.col("text"), F.lit(r"(?i)\bfig(?:ure|\.)?\s*([0-9]+)"), 1)
    rows = chunks.where("chunk_type = 'text_span'").join(wanted, "doc_id").where(F.arrays_overlap(seen, "numbers")).drop("numbers")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))).where(F.col("n") <= limit).drop("n")


def comparison_context(chunks: DataFrame, least: int = 3) -> DataFrame:
    """Chunks with at least least "(year)" citations: tables first, then by density."""
    cited = F.regexp_count(F.col("text"), F.lit(r"\((?:19|20)[0-9]{2}[a-z]?\)|,\s(?:19|20)[0-9]{2}\)"))
    rows = chunks.withColumn("n_cited", cited).where(F.col("n_cited") >= least)
    order = [F.desc(F.col("chunk_type") == "table"), F.desc("n_cited"), F.asc("pos")]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))


#: Number words that a question may count references with.
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth")
#: Verbs that ask for the references of an author.
_CITES = r"\b(?:include|includes|list|lists|cite|cites|mention|mentions|by|with)"


def lookup_request(question: Column) -> Column:
    """What a question asks to look up in its document: struct (kind, number, last, surname), kind being reference_count,
    reference or equation, null where it asks for none. Of several forms the first in this order counts."""
    low = F.lower(blank_if_null(question))
    surname = F.regexp_extract(question, _CITES + r"\s+([A-Z][a-z][A-Za-z'’-]+)", 1)
    counted = low.rlike(r"\bhow many references\b") & low.rlike(_CITES + r"\b") & (surname != "")
    tail = r"\s+(?:cited\s+|listed\s+)?reference\b"
    found = lambda pattern: F.regexp_extract(low, pattern, 1)
    words = found(r"\b(" + "|".join(ORDINALS) + ")" + tail)
    word_number = F.array_position(F.array(*map(F.lit, ORDINALS)), words).cast("int")
    make = lambda kind, number=None, last=False, name=None: F.struct(F.lit(kind).alias("kind"), (F.lit(None) if number is None else number).cast("int").alias("number"), F.lit(last).alias("last"), (F.lit(None) if name is None else name).cast("string").alias("surname"))
    nth, plain, equation = found(r"\b([0-9]+)\s*(?:st|nd|rd|th)" + tail), found(r"\breference\s*(?:number\s*)?\[?([0-9]+)\]?"), found(r"\b(?:equation|eq)\.?\s*\(?([0-9]+)\)?")
    return (
        F.when(counted, make("reference_count", name=surname))
        .when(low.rlike(r"\b(?:last|final)" + tail), make("reference", last=True))
        .when(nth != "", make("reference", nth.try_cast("int")))
        .when(words != "", make("reference", word_number))
        .when(plain != "", make("reference", plain.try_cast("int")))
        .when(equation != "", make("equation", equation.try_cast("int")))
    )


def reference_region(chunks: DataFrame) -> DataFrame:
    """chunks (doc_id, pos, source_type, section, text) with in_region: those of a section of references, or where a document has
    none, those of three entries or more; tables, figures and metadata never."""
    body = ~F.coalesce("source_type", F.lit("")).isin("table", "figure", "metadata")
    labelled = body & F.lower(blank_if_null(F.col("section"))).contains("reference")
    shaped = body & (F.regexp_count("text", F.lit(r"\[[0-9]{1,3}\]\s+[A-Z]")) >= 3)
    any_labelled = F.bool_or(labelled).over(Window.partitionBy("doc_id"))
    return chunks.withColumn("in_region", F.when(any_labelled, labelled).otherwise(shaped))


def surname_chunks(chunks: DataFrame, names: DataFrame, most: int = 3) -> DataFrame:
    """The first chunks of each document's extended reference region that hold its surname (doc_id, surname): with place."""
    region = extended_region(reference_region(chunks)).join(names, "doc_id")
    held = region.where(F.regexp("text", F.concat(F.lit(r"(?<![A-Za-z])\Q"), "surname", F.lit(r"\E(?![a-z])"))))
    return held.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))).where(F.col("place") <= most)


def lookup_evidence(found: DataFrame, head: int = 120) -> DataFrame:
    """(query_id, doc_id, source_type, page, text): evidence of looked-up snippets (query_id, doc_id, source_type, content, pages, snippet), one for each page that the snippet's head stands on."""
    pages = page_fanout(F.substring("snippet", 1, head), F.col("content"), F.col("pages"))
    return found.select("query_id", "doc_id", "source_type", F.explode(pages).alias("page"), F.col("snippet").alias("text"))


def coerce_page(value: Column) -> Column:
    """A positive page number, else null."""
    page = strip(blank_if_null(value)).try_cast("int")
    return F.when(page > 0, page)


def figure_rows(chunks: DataFrame) -> DataFrame:
    """(doc_id, pos, figure_id, page) of figure chunks (doc_id, pos, source_type, locator_json, page_numbers) that have a page."""
    parsed = F.from_json(blank_if_null(F.col("locator_json")), "page STRING, figure_id STRING")
    page = F.coalesce(coerce_page(parsed["page"]), coerce_page(F.get("page_numbers", F.lit(0))))
    return chunks.where("source_type = 'figure'").select("doc_id", "pos", parsed["figure_id"].alias("figure_id"), page.alias("page")).where("page is not null")


def candidate_pages(papers: DataFrame, evidence: DataFrame, figures: DataFrame, most: int) -> DataFrame:
    """(query_id, place, doc_id, page): pages worth looking at, most at most and each once: those of figure evidence, of other
    evidence, then of the figures of each paper (query_id, doc_id, order) in order."""
    own = papers.select("query_id", "doc_id", "order")
    cited = evidence.join(own, ["query_id", "doc_id"]).withColumn("page", coerce_page(F.col("page"))).where("page is not null")
    cited = cited.select("query_id", "doc_id", "page", F.struct((F.col("source_type") != "figure").cast("int").alias("kind"), F.lit(0).alias("order"), F.col("pos").cast("long").alias("pos")).alias("at"))
    shown = own.join(figures.select("doc_id", "pos", "page"), "doc_id").select("query_id", "doc_id", "page", F.struct(F.lit(2).alias("kind"), F.col("order").cast("int").alias("order"), F.col("pos").cast("long").alias("pos")).alias("at"))
    first = cited.unionByName(shown).groupBy("query_id", "doc_id", "page").agg(F.min("at").alias("at"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("at", "doc_id", "page"))
    return first.withColumn("place", place).where(F.col("place") <= most).select("query_id", "place", "doc_id", "page")


def paper_facts(chunks: DataFrame) -> DataFrame:
    """(doc_id, metadata, surname, abstract) of chunks (doc_id, pos, source_type, section, text): the first metadata chunk, the first
    author's last name in it, and its abstract, else the text of an abstract section."""
    meta = F.min_by("text", F.when(F.col("source_type") == "metadata", F.col("pos")))
    section = F.min_by("text", F.when(F.lower(blank_if_null(F.col("section"))).contains("abstract"), F.col("pos")))
    rows = chunks.groupBy("doc_id").agg(meta.alias("metadata"), section.alias("section"))
    authors = strip(F.regexp_extract("metadata", r"Authors?:\s*([^,\n]+)", 1))
    abstract = strip(F.regexp_extract("metadata", r"(?s)Abstract:\s*(.*)", 1))
    return rows.select("doc_id", "metadata", F.coalesce(F.element_at(F.split(authors, r"\s+"), -1), F.lit("")).alias("surname"), F.coalesce(F.nullif(abstract, F.lit("")), "section").alias("abstract"))


def result_lines(hits: DataFrame, size: int = 1800) -> DataFrame:
    """(query_id, listing) of hits (query_id, doc_rank, doc_id, title, venue, year, chunk_rank, chunk_id, chunk_type, page, text) as a prompt shows them: a head for each document, then its chunks."""
    head = F.format_string("[%s] %s (%s %s)", F.col("doc_id").cast("string"), blank_if_null(F.col("title")), blank_if_null(F.col("venue")), blank_if_null(F.col("year")))
    place = F.when(F.col("page").isNotNull(), F.concat(F.lit(", page="), F.col("page").cast("string"))).otherwise("")
    line = F.concat(F.lit("  - "), F.col("chunk_id").cast("string"), F.lit(" (type="), blank_if_null(F.col("chunk_type")), place, F.lit(")\n    "), F.substring(blank_if_null(F.col("text")), 1, size))
    ordered = lambda value, by: F.transform(F.array_sort(F.collect_list(F.struct(by, value.alias("v")))), lambda x: x["v"])
    docs = hits.groupBy("query_id", "doc_rank").agg(F.min(head).alias("head"), ordered(line, "chunk_rank").alias("lines"))
    block = F.concat(F.col("head"), F.lit("\n"), F.array_join("lines", "\n"))
    return docs.groupBy("query_id").agg(F.array_join(ordered(block, "doc_rank"), "\n\n").alias("listing"))
