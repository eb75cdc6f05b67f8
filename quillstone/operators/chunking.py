"""Parsed layout blocks to typed chunks.

Sequential state of the block loop (current section, last text, page islands, counters) is written as
window functions over one document's blocks in order; only greedy packing is a fold, over arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import compact_text, strip
from quillstone.operators.packing import pack

#: Block types of no content, and chunk kinds' id prefixes.
SKIPPED = ("page_number", "header", "footer", "discarded")
CHUNK_TYPES = ("title_abstract", "text_span", "table", "figure", "equation_algorithm", "citation_context")
PREFIX = {"text_span": "c", "table": "tab", "figure": "fig", "equation_algorithm": "eq"}
#: Chunk type by the block renderer's block type.
RENDERED = {"Text": "text_span", "TextInlineMath": "text_span", "ListGroup": "text_span", "Table": "table", "TableGroup": "table", "Figure": "figure", "Picture": "figure", "FigureGroup": "figure", "PictureGroup": "figure", "Equation": "equation_algorithm", "Code": "equation_algorithm"}


def filter_types(chunks: DataFrame, types: list[str] | None) -> DataFrame:
    if not types:
        return chunks
    if unknown := set(types) - set(CHUNK_TYPES):
        raise ValueError(f"unknown chunk types: {sorted(unknown)}")
    return chunks.where(F.col("chunk_type").isin(*types))


class _Text(HTMLParser):
    """Text of HTML; tables as Markdown rows; scripts and styles left out."""

    def __init__(self, rows: bool):
        super().__init__(convert_charrefs=True)
        self.rows, self.out, self.cells, self.cell, self.table, self.mute = rows, [], None, None, [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.mute += 1
        elif self.rows and tag == "tr":
            self.cells = []
        elif self.rows and tag in ("td", "th"):
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.mute = max(0, self.mute - 1)
        elif self.rows and tag in ("td", "th") and self.cell is not None:
            if self.cells is not None:
                self.cells.append(" ".join("".join(self.cell).split()).replace("|", "\\|"))
            self.cell = None
        elif self.rows and tag == "tr" and self.cells is not None:
            self.table.append(self.cells)
            self.cells = None

    def handle_data(self, data):
        if not self.mute:
            (self.out if self.cell is None else self.cell).append(data)


def html_to_text(html: str | None) -> str:
    parser = _Text(False)
    parser.feed(html or "")
    parser.close()
    return " ".join(" ".join(parser.out).split())


def html_to_markdown(html: str | None) -> str:
    parser = _Text(True)
    parser.feed(html or "")
    parser.close()
    if not parser.table:
        return " ".join("".join(parser.out).split())
    width = max(map(len, parser.table))
    rows = [r + [""] * (width - len(r)) for r in parser.table]
    lines = ["| " + " | ".join(r) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def convert_html(rows: DataFrame, column: str, to: str = "text", name: str = "content") -> DataFrame:
    """rows with the text (to text) or Markdown tables (to markdown) of an HTML column."""
    convert = html_to_text if to == "text" else html_to_markdown

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield df.assign(**{name: df[column].map(convert)})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != name)
    return rows.mapInPandas(run, f"{fields}, `{name}` string")


def ordered(by: str = "paper_id", pos: str = "pos") -> Window:
    return Window.partitionBy(by).orderBy(pos)


def sections(blocks: DataFrame, is_heading: Column, text: str = "text") -> DataFrame:
    """blocks with section: the last heading at or before the block."""
    w = ordered().rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("section", F.last(F.when(is_heading, F.substring(strip(F.col(text)), 1, 200)), True).over(w))


def islands(blocks: DataFrame, starts: Column, name: str = "island") -> DataFrame:
    """Running number of the island that each block belongs to, a new one where starts holds."""
    w = ordered()
    return blocks.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def equation_id(text: Column) -> Column:
    tagged = F.regexp_extract(text, r"\\tag\{\s*([^}]*?)\s*\}", 1)
    trailing = F.regexp_extract(text, r"\(([0-9]+[a-z]?)\)\s*\$*\s*$", 1)
    return F.coalesce(F.nullif(tagged, F.lit("")), F.nullif(trailing, F.lit("")))


def visible_id(caption: Column, kind: str) -> Column:
    """"Table 3" of "Table 3: ..." (kind table) or "Figure 2" of "Fig. 2 ..." (kind figure); null without a number."""
    word = "Table" if kind == "table" else "Figure"
    pattern = r"(?i)\btable\s*([0-9]+[a-z]?)" if kind == "table" else r"(?i)\bfig(?:ure|\.)?\s*([0-9]+[a-z]?)"
    number = F.regexp_extract(caption, pattern, 1)
    return F.when(number != "", F.concat(F.lit(f"{word} "), number))


def layout_chunks(blocks: DataFrame, budget: int = 2000) -> DataFrame:
    """Chunks of blocks (paper_id, pos, type, page_idx, text, text_level, list_items, caption, footnote, table_body, content, img_path).

    Headings set the section and make no chunk; text, lists and inline equations of one section and
    page are packed to the budget; tagged equations are also chunks with the text before them;
    tables are Markdown with caption and footnote; figures without any text are dropped, and only
    kept ones are numbered.
    """
    live = blocks.where(~F.coalesce("type", F.lit("discarded")).isin(*SKIPPED)).withColumn("page", F.col("page_idx") + 1)
    heading = (F.col("type") == "text") & F.col("text_level").isNotNull() & (F.coalesce("text_level", F.lit(0)) > 0)
    live = sections(live, heading)
    joined = lambda a: F.array_join(F.filter(F.transform(a, strip), lambda x: x != ""), "\n")
    flowing = (F.col("type").isin("text", "list", "equation")) & ~heading
    own = F.when(F.col("type") == "list", joined(F.col("list_items"))).otherwise(strip(F.coalesce("text", F.lit(""))))
    before = ordered().rowsBetween(Window.unboundedPreceding, -1)
    live = live.withColumns({"heading": heading, "own": own, "previous": F.last(F.when((F.col("type") == "text") & ~heading & (own != ""), own), True).over(before)})

    flow = live.where(flowing | heading)
    flow = flow.withColumn("turn", heading | (F.col("page") != F.coalesce(F.lag("page").over(ordered()), F.lit(-1))))
    flow = islands(flow, F.col("turn")).where(~F.col("heading") & (F.col("own") != ""))
    packed = flow.groupBy("paper_id", "island").agg(F.min("pos").alias("pos"), F.min("page").alias("page"), F.min("section").alias("section"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "own"))), lambda x: x["own"]).alias("units"))
    packs = pack(F.transform("units", F.length), budget)
    text = packed.select("paper_id", "pos", "page", "section", "units", F.posexplode(packs).alias("part", "p"))
    text = text.select("paper_id", "pos", "part", "page", "section", F.lit("text_span").alias("chunk_type"), F.array_join(F.slice("units", F.col("p.first") + 1, F.col("p.last") - F.col("p.first") + 1), "\n").alias("text"), F.lit(None).cast("string").alias("object_id"), F.lit(None).cast("string").alias("image_path"))

    tag = equation_id(F.col("text"))
    equations = live.where((F.col("type") == "equation") & tag.isNotNull())
    equations = equations.select("paper_id", "pos", F.lit(0).alias("part"), "page", "section", F.lit("equation_algorithm").alias("chunk_type"), F.concat_ws("\n", "previous", "own").alias("text"), tag.alias("object_id"), F.lit(None).cast("string").alias("image_path"))

    tables = convert_html(live.where(F.col("type") == "table"), "table_body", "markdown", "markdown")
    caption = joined(F.coalesce("caption", F.array().cast("array<string>")))
    footnote = joined(F.coalesce("footnote", F.array().cast("array<string>")))
    body = lambda *parts: F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\n")
    tables = tables.select("paper_id", "pos", F.lit(0).alias("part"), "page", "section", F.lit("table").alias("chunk_type"), body(caption, F.col("markdown"), footnote).alias("text"), visible_id(caption, "table").alias("object_id"), F.col("img_path").alias("image_path"))

    figures = live.where(F.col("type").isin("image", "chart"))
    figures = figures.select("paper_id", "pos", F.lit(0).alias("part"), "page", "section", F.lit("figure").alias("chunk_type"), body(caption, strip(F.coalesce("content", F.lit(""))), footnote).alias("text"), visible_id(caption, "figure").alias("object_id"), F.col("img_path").alias("image_path"))
    chunks = text.unionByName(equations).unionByName(tables).unionByName(figures).where("text <> ''")
    return chunk_ids(chunks)


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """chunk_id paper#kind0001, numbered within paper and chunk type in reading order."""
    kind = F.lit("c")
    for chunk_type, prefix in PREFIX.items():
        kind = F.when(F.col("chunk_type") == chunk_type, prefix).otherwise(kind)
    n = F.row_number().over(Window.partitionBy("paper_id", "chunk_type").orderBy("pos", "part"))
    return chunks.withColumn("chunk_id", F.format_string("%s#%s%04d", F.col("paper_id").cast("string"), kind, n))


def title_chunks(papers: DataFrame) -> DataFrame:
    """Chunk 0 of each paper: title and abstract under the head of venue and year."""
    return papers.select(F.format_string("%s#c%04d", F.col("paper_id").cast("string"), F.lit(0)).alias("chunk_id"), "paper_id", F.concat(chunk_head(), F.coalesce("abstract", F.lit(""))).alias("text"), F.lit("title_abstract").alias("chunk_type"))


def chunk_head() -> Column:
    return F.format_string("[%s %s] %s\n", F.coalesce("venue", F.lit("")), F.coalesce(F.col("year").cast("string"), F.lit("")), F.coalesce("title", F.lit("")))


def rendered_chunks(blocks: DataFrame) -> DataFrame:
    """One chunk for each block (paper_id, pos, block_type, html, page) of a known type with any text; pages from 1."""
    kind = F.lit(None).cast("string")
    for block, chunk_type in RENDERED.items():
        kind = F.when(F.col("block_type") == block, chunk_type).otherwise(kind)
    known = convert_html(blocks.withColumn("chunk_type", kind).where("chunk_type is not null"), "html", "text", "text").where("text <> ''")
    return chunk_ids(known.withColumn("part", F.lit(0)).withColumn("page", F.col("page") + 1)).drop("part", "html")


def paragraph_units(paragraphs: DataFrame) -> DataFrame:
    """Units of paragraphs (paper_id, pos, content, role, page): running heads skipped, section carried on, other roles named in front."""
    heading = F.coalesce(F.col("role").isin("title", "sectionHeading"), F.lit(False))
    live = paragraphs.where(~F.coalesce("role", F.lit("")).isin("pageHeader", "pageFooter", "pageNumber")).where(strip(F.coalesce("content", F.lit(""))) != "")
    live = sections(live, heading, "content")
    shown = F.when(F.coalesce("role", F.lit("")).isin("", "footnote"), strip(F.col("content"))).otherwise(F.concat(F.lit("["), F.col("role"), F.lit("] "), strip(F.col("content"))))
    return live.select("paper_id", "pos", "page", "section", shown.alias("text"))


def fallback_units(docs: DataFrame) -> DataFrame:
    """Units of whole contents (paper_id, content) where no paragraphs are known: parts between blank lines."""
    parts = F.filter(F.transform(F.split("content", r"\n\s*\n"), strip), lambda x: x != "")
    return docs.select("paper_id", F.posexplode(parts).alias("pos", "text"))


def grid_to_markdown(cells: DataFrame) -> DataFrame:
    """Markdown of tables from cells (table_id, n_rows, n_cols, row, col, pos, content): cells outside the grid are ignored,
    of several in one place the last counts, content is one line of at most 400 characters with bars escaped."""
    inside = cells.where("row >= 0 and row < n_rows and col >= 0 and col < n_cols")
    text = F.replace(compact_text(F.col("content"), 400), F.lit("|"), F.lit("\\|"))
    last = inside.groupBy("table_id", "row", "col").agg(F.max_by(text, "pos").alias("text"))
    sizes = cells.groupBy("table_id").agg(F.max("n_rows").alias("n_rows"), F.max("n_cols").alias("n_cols")).where("n_rows > 0 and n_cols > 0")
    grid = sizes.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)))
    full = grid.join(last, ["table_id", "row", "col"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    lines = full.groupBy("table_id", "row", "n_cols").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"]), " | ").alias("line"))
    lines = lines.select("table_id", "row", F.concat(F.lit("| "), "line", F.lit(" |"), F.when(F.col("row") == 0, F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), F.col("n_cols")))).otherwise("")).alias("line"))
    return lines.groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("markdown"))


def caption_labels(objects: DataFrame, kind: str = "Table") -> DataFrame:
    """objects (paper_id, pos, caption) with label: the caption's number, else the position's, marked where a caption owns that number."""
    own = F.regexp_extract(F.coalesce("caption", F.lit("")), rf"(?i)^\s*{kind}\s*([0-9]+)", 1)
    rows = objects.withColumns({"own": F.nullif(own, F.lit("")), "place": F.row_number().over(ordered()).cast("string")})
    owned = rows.where("own is not null").select("paper_id", F.col("own").alias("place"), F.lit(True).alias("taken")).distinct()
    rows = rows.join(owned, ["paper_id", "place"], "left")
    label = F.when(F.col("own").isNotNull(), F.concat(F.lit(f"{kind} "), "own")).when(F.col("taken"), F.lit("(uncaptioned)")).otherwise(F.concat(F.lit(f"{kind} "), "place"))
    return rows.withColumn("label", label).drop("own", "place", "taken")


def metadata_text() -> Column:
    """Labelled lines of a paper's metadata; empty fields keep their line."""
    line = lambda label, value: F.concat(F.lit(f"{label}: "), F.coalesce(value.cast("string"), F.lit("")))
    return F.concat_ws("\n", line("Title", F.col("title")), line("Authors", F.array_join("authors", ", ")), line("Venue", F.col("venue")), line("Year", F.col("year")), line("Track", F.col("track")), line("Award", F.col("award")), line("Abstract", F.col("abstract")))


def page_windows(n_pages: Column, size: int) -> Column:
    """Inclusive page ranges of at most size pages."""
    return F.when(n_pages > 0, F.transform(F.sequence(F.lit(1), n_pages, F.lit(size)), lambda a: F.struct(a.alias("first"), F.least(a + size - 1, n_pages).alias("last")))).otherwise(F.array().cast("array<struct<first:int,last:int>>"))


def stitch(windows: DataFrame) -> DataFrame:
    """Results of windows (paper_id, first, units array<struct<page:int,text:string>>) as one list with document page numbers."""
    shifted = F.transform("units", lambda u: F.struct((u["page"] + F.col("first") - 1).alias("page"), u["text"].alias("text")))
    return windows.groupBy("paper_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first", shifted.alias("u")))), lambda x: x["u"])).alias("units"))
