"""Entity candidates in questions, their resolution to documents, and aliases of documents."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import collapse, looks_like_title, normalize_title, strip, titles_equivalent
from quillstone.operators.packing import overflow_order

MOST_ENTITIES, MOST_DOCS, SCOPED_CHUNKS = 6, 4, 5
#: Acronyms, data sets, venues and backbones that name no document, upper-cased.
STOP = frozenset(
    "AI API AUC ACC ADAM BERT BLEU CNN COCO CPU CIFAR CV DNN DPO ELBO EM FID FLOP FLOPS GAN GPT GPU GPUS GRU HTML ID III IOU JSON KL "
    "LLM LLMS LORA LSTM MAE MAP MC MCQ ML MLP MLLM MNIST MSE NAS NLP NN OCR ODE OOD PDE PDF PSNR QA RAG RAM RELU RL RLHF RMSE RNN "
    "ROUGE SDE SGD SOTA SSIM SVM TPU URL VAE VIT VLM VLMS VQA XML ACL AAAI CVPR ECCV EMNLP ICCV ICLR ICML IJCAI NAACL NEURIPS NIPS "
    "IMAGENET WIKITEXT TRIVIAQA NATURALQ TRUTHFULQA WEBQA COMMONSENSEQA POPE LLAVA QWEN GEMMA LLAMA VICUNA".split()
)
#: Score floors of the rungs of resolution.
FLOORS = {"token": 4.0, "title": 15.0, "abstract": 8.0, "content": 25.0}


def nfkc(rows: DataFrame, column: str) -> DataFrame:
    """rows with column in normalization form KC, in Arrow batches (there is no built-in)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield df.assign(**{column: df[column].str.normalize("NFKC")})

    return rows.mapInPandas(run, rows.schema)


def candidates(question: Column, options: Column | None = None, stop: frozenset[str] = STOP, most: int = MOST_ENTITIES) -> Column:
    """Distinct candidates (text, is_title) in order of kind: quoted, options that look like titles, CamelCase, ALLCAPS, hyphenated.

    question is in normalization form KC (see nfkc). Stop words, also as the first part of a hyphenated
    name, and names of model sizes or chat variants are left out.
    """
    edge = lambda body: F.regexp_extract_all(question, F.lit(rf"(?<![\p{{L}}\p{{N}}_])({body})(?![\p{{L}}\p{{N}}_])"), 1)
    named = lambda texts, title: F.transform(texts, lambda t: F.struct(t.alias("text"), title(t).alias("is_title")))
    no = lambda t: F.lit(False)
    quoted = F.regexp_extract_all(question, F.lit("[\"“]([^\"”“]{2,90})[\"”]"), 1)
    titles = F.filter(options, looks_like_title) if options is not None else F.array().cast("array<string>")
    words = edge("[A-Za-z][A-Za-z0-9]{1,29}")
    caps = lambda t: t.rlike("^[A-Z]{3,}[0-9]{0,2}$")
    hyphen = F.filter(edge("[A-Za-z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)+"), lambda t: t.rlike("[A-Z]") & (F.length(t) >= 4))
    every = F.concat(
        named(quoted, looks_like_title),
        named(titles, lambda t: F.lit(True)),
        named(F.filter(words, lambda t: ~caps(t) & t.rlike("[a-z0-9][A-Z]")), no),
        named(F.filter(words, caps), no),
        named(hyphen, no),
    )
    trimmed = F.transform(every, lambda e: F.struct(F.regexp_replace(strip(collapse(e["text"])), r"^[.,;:]+|[.,;:]+$", "").alias("text"), e["is_title"].alias("is_title")))
    stopped = lambda t: F.upper(t).isin(*sorted(stop))
    variant = lambda t: t.rlike(r"-[0-9]+(?:\.[0-9]+)?[BbMm](?![A-Za-z0-9])|-(?:Instruct|Chat)(?![A-Za-z0-9])")
    good = lambda e: (e["text"] != "") & ~stopped(e["text"]) & ~((F.instr(e["text"], "-") > 0) & stopped(F.substring_index(e["text"], "-", 1))) & (e["is_title"] | ~variant(e["text"]))
    kept = F.filter(trimmed, good)
    low = F.transform(kept, lambda e: F.lower(e["text"]))
    once = F.filter(F.transform(kept, lambda e, i: F.when(F.array_position(low, F.get(low, i)) == i + 1, e)), lambda e: e.isNotNull())
    return F.slice(once, 1, most)


def resolve(entities: DataFrame, title_hits: DataFrame, content_hits: DataFrame, abstract_hits: DataFrame, own: DataFrame, floors: dict[str, float] = FLOORS, most: int = 2) -> DataFrame:
    """(query_id, entity, place, doc_id, via): the documents that a ladder of searches accepts for each entity (query_id, entity, is_title).

    Hits are (query_id, entity, rank, doc_id, score, token_match), title hits also title; own
    (query_id, entity, doc_id) are documents whose own title or abstract holds the name.
    Title rung, of three hits: the name in the title and the token floor, or for a title an equivalent one
    and the title floor; up to most documents. A name of at most four characters needs to be
    confirmed: one of its documents also holds it in a content hit, and the strongest content evidence
    is not another's, which then wins. Content rung, of twenty hits that hold the name: the document's first
    hit reaches the content floor, and the name is its own or stands in two hits; one document. Abstract
    rung for longer names, of five hits: the first that holds it before one falls below its floor.
    A title that its rung misses has no document.
    """
    key = ["query_id", "entity"]
    named = entities.select(*key, "is_title", ((F.length("entity") <= 4) & ~F.col("is_title")).alias("short")).distinct()
    best = lambda rows, name="rank": rows.groupBy(*key, "doc_id").agg(F.min_by("score", "rank").alias("score"), F.min("rank").alias(name), F.count("*").alias("n"))
    placed = lambda rows: rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("rank", "doc_id")))
    title_ok = (F.col("token_match") & (F.col("score") >= floors["token"])) | (F.col("is_title") & (F.col("score") >= floors["title"]) & titles_equivalent(F.col("entity"), F.col("title")))
    titled = best(title_hits.where("rank <= 3").join(named, key).where(title_ok)).select(*key, "doc_id", "rank")
    held = best(content_hits.where("rank <= 20 and token_match").join(named.where("not is_title").select(*key), key))
    strong = held.where(F.col("score") >= floors["content"]).join(own.select(*key, "doc_id").distinct().withColumn("own", F.lit(True)), [*key, "doc_id"], "left")
    strong = strong.where(F.coalesce("own", F.lit(False)) | (F.col("n") >= 2))
    strong = placed(strong.select(*key, "doc_id", "rank", F.when(F.col("own"), "abstract").otherwise("content").alias("via"))).where("place = 1")
    confirmed = titled.join(held.select(*key, "doc_id"), [*key, "doc_id"], "left_semi")
    late = abstract_hits.where((F.col("rank") <= 5) & (F.col("score") < floors["abstract"])).groupBy(*key).agg(F.min("rank").alias("end"))
    abstract = abstract_hits.where("rank <= 5 and token_match").join(late, key, "left").where("end is null or rank < end")
    abstract = placed(abstract.select(*key, "doc_id", "rank", F.lit("abstract").alias("via"))).where("place = 1")
    facts = named.join(titled.groupBy(*key).agg(F.count("*").alias("n_titled")), key, "left").join(confirmed.groupBy(*key).agg(F.collect_set("doc_id").alias("sure")), key, "left")
    facts = facts.join(strong.select(*key, F.col("doc_id").alias("strong")), key, "left").withColumn("n_titled", F.coalesce("n_titled", F.lit(0)))
    settled = F.col("is_title") | (~F.col("short") & (F.col("n_titled") > 0))
    agreed = F.col("sure").isNotNull() & (F.col("strong").isNull() | F.array_contains("sure", F.col("strong")))
    rung = F.when(settled, "title").when(agreed, "confirmed").when(F.col("strong").isNotNull(), "strong").when(~F.col("short"), "abstract")
    chosen = facts.select(*key, rung.alias("rung"))
    take = lambda rows, name: rows.join(chosen.where(F.col("rung") == name).select(*key), key, "left_semi")
    by_title = lambda rows: placed(rows.withColumn("via", F.lit("title"))).where(F.col("place") <= most)
    out = [by_title(take(titled, "title")), by_title(take(confirmed, "confirmed")), take(strong, "strong"), take(abstract, "abstract")]
    return reduce(DataFrame.unionByName, (o.select(*key, "place", "doc_id", "via") for o in out))


def boosted(resolved: DataFrame, most: int = MOST_DOCS, per_doc: int = SCOPED_CHUNKS) -> DataFrame:
    """boost_plan of resolved documents (query_id, order, doc_id, via), order being that of entities and places; the first naming of a document counts."""
    first = resolved.groupBy("query_id", "doc_id").agg(F.min(F.struct("order", "via")).alias("x")).select("query_id", "doc_id", F.col("x.order").alias("rank"), "x.via")
    return boost_plan(first.where("via <> 'content'"), first.where("via = 'content'"), most, per_doc)


def boost_hits(plan: DataFrame, scoped: DataFrame, context_chars: int) -> DataFrame:
    """(query_id, side, place, doc_id, chunk_id): hits within the planned documents, to go before or after the organic ones.

    scoped (query_id, doc_id, rank, chunk_id, text) is a search within each document. Documents take turns;
    strong ones go before, content ones after. With three documents or more those before keep to a third
    of the context, the first at least, and what overflows follows the ones after.
    """
    rows = scoped.join(plan, ["query_id", "doc_id"]).where(F.col("rank") <= F.col("n_chunks"))
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("query_id", "kind").orderBy("rank", "order")))
    n = plan.groupBy("query_id").agg(F.count("*").alias("n_docs"))
    before = rows.where("kind = 0").join(n, "query_id")
    few = before.where("n_docs < 3").withColumn("fits", F.lit(True))
    many = overflow_order(before.where("n_docs >= 3"), ["query_id"], [F.asc("turn")], context_chars // 3).drop("place")
    columns = ["query_id", "doc_id", "chunk_id", "kind", "turn", "fits"]
    every = few.select(*columns).unionByName(many.select(*columns)).unionByName(rows.where("kind = 1").withColumn("fits", F.lit(False)).select(*columns))
    side = F.when(F.col("fits"), "before").otherwise("after")
    place = F.row_number().over(Window.partitionBy("query_id", "side").orderBy(F.desc("kind"), "turn"))
    return every.withColumn("side", side).withColumn("place", place).select("query_id", "side", "place", "doc_id", "chunk_id")


def boost_plan(strong: DataFrame, content: DataFrame, most: int = 4, per_doc: int = 5) -> DataFrame:
    """(query_id, doc_id, order, kind, n_chunks): strong documents first; three or more drop the content ones; at most most documents; 5 chunks each, fewer for many."""
    n_strong = F.sum(1 - F.col("kind")).over(Window.partitionBy("query_id"))
    rows = strong.select("query_id", "doc_id", "rank", F.lit(0).alias("kind")).unionByName(content.select("query_id", "doc_id", "rank", F.lit(1).alias("kind")))
    rows = rows.groupBy("query_id", "doc_id").agg(F.min(F.struct("kind", "rank")).alias("k")).select("query_id", "doc_id", "k.kind", "k.rank")
    rows = rows.withColumn("n_strong", n_strong).where((F.col("n_strong") < 3) | (F.col("kind") == 0))
    rows = rows.withColumn("order", F.row_number().over(Window.partitionBy("query_id").orderBy("kind", "rank", "doc_id"))).where(F.col("order") <= most)
    n = F.count("*").over(Window.partitionBy("query_id"))
    return rows.select("query_id", "doc_id", "order", "kind", F.when(n <= 2, F.lit(per_doc)).otherwise(F.greatest(F.lit(2), F.floor(F.lit(10) / n)).cast("int")).alias("n_chunks"))


def alias_tokens(docs: DataFrame, stop: frozenset[str] = STOP, least: int = 8, others: int = 2, shared: int = 3, most: int = 5) -> DataFrame:
    """(group_id, doc_id, place, token, n): names a document uses for its own: 2 to 8 characters, a capital not only at
    the start, least times or more, and in fewer than others other documents of the group shared times or more."""
    words = F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9])([A-Za-z][A-Za-z0-9-]{1,7})(?![A-Za-z0-9-])"), 1)
    rows = docs.select("group_id", "doc_id", F.explode(words).alias("token")).where(F.col("token").rlike("[A-Z]") & ~F.col("token").rlike("^[A-Z][a-z]+$") & ~F.upper("token").isin(*sorted(stop)))
    counts = rows.groupBy("group_id", "doc_id", "token").agg(F.count("*").alias("n"))
    spread = counts.groupBy("group_id", "token").agg(F.count_if(F.col("n") >= shared).alias("n_docs"))
    own = counts.where(F.col("n") >= least).join(spread, ["group_id", "token"])
    own = own.where(F.col("n_docs") - (F.col("n") >= shared).cast("int") < others)
    return own.withColumn("place", F.row_number().over(Window.partitionBy("group_id", "doc_id").orderBy(F.desc("n"), F.asc("token")))).where(F.col("place") <= most).select("group_id", "doc_id", "place", "token", "n")


def hub_excerpts(chunks: DataFrame, terms: DataFrame, per_hub: int = 2, most: int = 8, window: int = 600) -> DataFrame:
    """Best chunks of hubs: 10 for each alias (and surname) of terms (group_id, term) in a chunk, 5 for a table; cut around the first match."""
    hits = chunks.join(terms, "group_id").withColumn("at", F.instr(F.col("text"), F.col("term"))).where("at > 0")
    scored = hits.groupBy("group_id", "doc_id", "chunk_id").agg(F.count("*").alias("n"), F.min("at").alias("at"), F.first("text").alias("text"), F.first("chunk_type").alias("chunk_type"))
    scored = scored.withColumn("score", F.col("n") * 10 + F.when(F.col("chunk_type") == "table", 5).otherwise(0))
    top = scored.withColumn("r", F.row_number().over(Window.partitionBy("group_id", "doc_id").orderBy(F.desc("score"), F.asc("chunk_id")))).where(F.col("r") <= per_hub)
    top = top.withColumn("place", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("score"), F.asc("chunk_id")))).where(F.col("place") <= most)
    start = F.greatest(F.col("at") - window // 2, F.lit(1))
    return top.select("group_id", "place", "doc_id", "chunk_id", "score", F.substring(F.col("text"), start, F.lit(window)).alias("excerpt"))


def aliases(papers: DataFrame) -> DataFrame:
    """(alias, paper_id) of papers (paper_id, pos, names array): normalized names; the first paper that has an alias owns it."""
    from quillstone.functions.text import normalize_alias

    rows = papers.select("paper_id", "pos", F.explode("names").alias("name")).select("paper_id", "pos", normalize_alias(F.col("name")).alias("alias")).where("alias <> ''")
    return rows.groupBy("alias").agg(F.min_by("paper_id", F.struct("pos", "paper_id")).alias("paper_id"))


def infer_papers(files: DataFrame, owners: DataFrame) -> DataFrame:
    """(file_id, paper_id): the first of a file's ordered candidate names that some paper owns."""
    from quillstone.functions.text import normalize_alias

    names = files.select("file_id", F.posexplode("names").alias("order", "name")).select("file_id", "order", normalize_alias(F.col("name")).alias("alias"))
    found = names.join(owners, "alias").groupBy("file_id").agg(F.min_by("paper_id", "order").alias("paper_id"))
    return files.select("file_id").join(found, "file_id", "left")


def title_resolution(entries: DataFrame, titles: DataFrame) -> DataFrame:
    """(entry_id, doc_id) of reference entries whose text holds a document's normalized title of 15+ characters; the longest, then the smallest id."""
    e = entries.select("entry_id", normalize_title(F.col("text")).alias("e"))
    t = titles.select("doc_id", normalize_title(F.col("title")).alias("t")).where(F.length("t") >= 15)
    # titles and entries meet on the title's first 15 characters
    windows = F.transform(F.sequence(F.lit(1), F.length("e") - 14), lambda i: F.substring(F.col("e"), i, F.lit(15)))
    met = e.where(F.length("e") >= 15).select("entry_id", "e", F.explode(F.array_distinct(windows)).alias("k"))
    joined = met.join(t.withColumn("k", F.substring("t", 1, 15)), "k").where(F.instr(F.col("e"), F.col("t")) > 0)
    return joined.groupBy("entry_id").agg(F.min_by("doc_id", F.struct(F.negative(F.length("t")), "doc_id")).alias("doc_id"))
