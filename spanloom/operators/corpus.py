"""Seed corpora: chunks, memory records, plans, context packs and generated items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import wording
from ..functions.core import half_even, let, strip
from ..functions.text import dedupe_keep_order, key_sentences, length_units, shorten, token_estimate
from ..sources.positions import with_position, with_running_sum
from .ranking import top_k

# Characters a chunk may end on.
CHUNK_END = "。！？!?；;\\n"


def chunk_text(text: Column, size: int, overlap: int) -> Column:
    """Overlapping pieces of at most ``size`` characters, cut back to the last sentence end in the upper part of the window.

    Each step takes at least ``step`` characters, so the fold has a known number of steps; steps after the end do nothing.
    """
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    low = max(80, size // 2)
    step = max(1, low - overlap)
    none = F.array().cast("array<string>")

    def pieces(body: Column) -> Column:
        n = F.length(body)

        def advance(acc: Column, _: Column) -> Column:
            start = acc["start"]

            def cut(upper: Column) -> Column:
                return F.length(F.regexp_extract(upper, f"(?s)^(.*[{CHUNK_END}])", 1))

            last = n - start <= size
            upper = F.substring(body, start + low + 1, F.lit(size - low))
            end = F.when(last, n).otherwise(
                let(cut(upper), lambda c: F.when(c > 0, start + low + c).otherwise(start + size)) if size > low else start + size
            )
            return let(
                end,
                lambda e: F.struct(
                    F.when(last, n).otherwise(F.greatest(e - overlap, start + 1)).alias("start"),
                    F.concat(acc["out"], F.array(strip(F.substring(body, start + 1, e - start)))).alias("out"),
                ),
            )

        steps = F.sequence(F.lit(1), F.ceil(n / F.lit(step)).cast("int") + 1)
        init = F.struct(F.lit(0).alias("start"), none.alias("out"))
        done = F.aggregate(steps, init, lambda acc, i: F.when(acc["start"] >= n, acc).otherwise(advance(acc, i)))
        return F.when(n <= size, F.array(body)).otherwise(F.filter(done["out"], lambda x: x != ""))

    return let(strip(text), pieces)


def chunk_documents(docs: DataFrame, size: int = 520, overlap: int = 80, key: str = "doc_id") -> DataFrame:
    """One row per chunk, ``<doc>-chunk-001`` and up, with the document's other columns."""
    rest = [c for c in docs.columns if c not in (key, "text")]
    rows = docs.select(key, *rest, F.posexplode(chunk_text(F.col("text"), size, overlap)).alias("pos", "text"))
    return rows.select(
        F.format_string("%s-chunk-%03d", F.col(key).cast("string"), F.col("pos") + 1).alias("chunk_id"), key, *rest, "text", (F.col("pos") + 1).alias("order"),
        token_estimate(F.col("text")).alias("token_estimate"),
    )


def derive_terms(tags: Column, keywords: Column, title: Column, limit: int = 12) -> Column:
    """Tags, then keywords, then a short title; trimmed, distinct."""
    short = F.when((strip(title) != "") & (F.length(strip(title)) <= 36), F.array(title)).otherwise(F.array().cast("array<string>"))
    return dedupe_keep_order(F.concat(tags, F.coalesce(keywords, F.array().cast("array<string>")), short), limit)


def memory_records(chunks: DataFrame, summary_chars: int = 160, source_chars: int = 600) -> DataFrame:
    """Summary, excerpt, key sentences and terms of every chunk. A ``keywords`` column is used where present."""
    keywords = F.col("keywords") if "keywords" in chunks.columns else F.lit(None).cast("array<string>")
    return chunks.withColumns({
        "summary": shorten(F.col("text"), summary_chars), "source_excerpt": shorten(F.col("text"), source_chars),
        "canonical_points": key_sentences(F.col("text"), 3, 140), "terminology": derive_terms(F.col("tags"), keywords, F.col("title")),
    })


def focus_pool(records: DataFrame, order: str = "chunk_id") -> DataFrame:
    """Distinct tags (the title where a record has none) in first-seen order: (focus, first_at, first_pos)."""
    source = F.when(F.size("tags") > 0, F.col("tags")).otherwise(F.array("title"))
    rows = records.select(F.col(order).alias("at"), F.posexplode(source).alias("pos", "focus"))
    rows = rows.select("at", "pos", strip(F.col("focus")).alias("focus")).where(F.col("focus") != "")
    return rows.groupBy("focus").agg(F.min(F.struct("at", "pos")).alias("first")).select("focus", F.col("first.at").alias("first_at"), F.col("first.pos").alias("first_pos"))


def allocate(weights: DataFrame, total: int, name: str = "name", weight: str = "weight", order: str = "position") -> DataFrame:
    """Whole shares of ``total`` by weight, largest remainder first; equal remainders favour the later row. Rows are categories, so few."""
    every = W.partitionBy()
    raw = F.lit(float(total)) * F.col(weight) / F.sum(weight).over(every)
    rows = weights.select(name, order, F.col(weight).alias("weight"), raw.alias("raw")).withColumn("base", F.floor("raw"))
    rank = F.row_number().over(W.orderBy((F.col("raw") - F.col("base")).desc(), F.col(order).desc()))
    rows = rows.withColumns({"rank": rank, "left": F.lit(total) - F.sum("base").over(every)})
    return rows.select(name, order, "weight", (F.col("base") + (F.col("rank") <= F.col("left")).cast("long")).alias("allocation"))


def plan_tasks(genres: DataFrame, foci: DataFrame, plan: str, total_samples: int, samples_per_task: int, domain: str, language: str) -> DataFrame:
    """Tasks per genre share; foci are dealt out in turn; the last task takes what is left.

    No more foci can be used than there are tasks, so only that many are numbered.
    """
    n_tasks = -(-total_samples // samples_per_task)
    shares = allocate(genres, n_tasks)
    before = F.sum("allocation").over(W.orderBy("position").rowsBetween(W.unboundedPreceding, -1))
    tasks = shares.withColumn("before", F.coalesce(before, F.lit(0))).where("allocation > 0").select(
        "name", "weight", F.explode(F.expr("sequence(before + 1, before + allocation)")).alias("task_index")
    )
    numbered = with_position(foci, ["first_at", "first_pos"], "focus_index").where(F.col("focus_index") <= n_tasks).select("focus", (F.col("focus_index") - 1).cast("int").alias("focus_index"))
    pool = numbered.agg(F.count(F.lit(1)).alias("pool_size"))
    slots = tasks.join(F.broadcast(pool)).withColumn("focus_index", F.when(F.col("pool_size") > 0, ((F.col("task_index") - 1) % F.greatest("pool_size", F.lit(1))).cast("int")))  # one-row side
    target = F.least(F.lit(samples_per_task), F.lit(total_samples) - (F.col("task_index") - 1) * samples_per_task)
    out = slots.join(numbered, "focus_index", "left").withColumns({"focus": F.coalesce("focus", F.lit("general")), "target_count": target})
    query = F.concat_ws(" ", *[F.nullif(F.trim(c), F.lit("")) for c in (F.lit(domain), F.lit(language), F.col("name"), F.col("focus"))])
    return out.where("target_count > 0").select(
        F.format_string(f"{plan}-task-%03d", F.col("task_index")).alias("task_id"), F.col("name").alias("genre_name"), "focus", query.alias("query"),
        F.col("target_count").cast("long").alias("target_count"), F.col("weight").alias("genre_weight"), "task_index",
    )


def context_pack(
    tasks: DataFrame, hits: DataFrame, records: DataFrame, style_requirements: list[str], failure_modes: list[str], banned: list[str], language: str, domain: str,
    evidence_k: int = 3, term_k: int = 8, style_k: int = 4, failure_k: int = 4, brief_chars: int = 160,
) -> DataFrame:
    """Evidence, terms, style and failure hints of each task, and the text made of them.

    ``tasks``: task_id, genre_name, focus, style, difficulty, instruction. ``hits``: task_id, chunk_id, score, rank.
    Only the first ``evidence_k`` hits of a task are joined, so the lists built here have that length.
    """
    used = hits.where(F.col("rank") <= evidence_k).join(records.select("chunk_id", "title", "summary", "canonical_points", "terminology", "tags"), "chunk_id")
    item = F.struct("rank", "chunk_id", half_even(F.col("score"), 4).alias("score"), "title", "summary", "canonical_points", F.concat("terminology", "tags").alias("terms"))
    packs = used.groupBy("task_id").agg(F.array_sort(F.collect_list(item)).alias("e"))
    rows = tasks.join(packs, "task_id", "left").withColumn("e", F.coalesce("e", F.array().cast(packs.schema["e"].dataType)))
    lits = lambda xs: [F.lit(x) for x in xs]
    style = dedupe_keep_order(F.array("style", "instruction", *lits(style_requirements)), style_k)
    failure = dedupe_keep_order(F.array(*lits(failure_modes), *lits([wording.AVOID_TERM + b for b in banned])), failure_k) if failure_modes or banned else F.array().cast("array<string>")
    terms = dedupe_keep_order(F.concat(F.array("focus"), F.flatten(F.transform("e", lambda x: x["terms"]))), term_k)
    brief = shorten(F.concat(F.lit("任务="), "genre_name", F.lit("; 聚焦="), "focus", F.lit(f"; 语言={language}; 领域={domain}; 风格="), "style", F.lit("; 难度="), "difficulty"), brief_chars)
    rows = rows.withColumns({"task_brief": brief, "term_pack": terms, "style_pack": style, "failure_pack": failure})
    evidence = F.flatten(F.transform("e", lambda x: F.concat(
        F.array(F.concat(F.lit("- "), x["chunk_id"], F.lit(" | "), x["title"], F.lit(" | "), x["summary"])),
        F.transform(F.slice(x["canonical_points"], 1, 2), lambda p: F.concat(F.lit("  facts: "), p)),
    )))
    bullets = lambda c, empty: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(empty)
    lines = F.concat(
        F.array(F.lit("# Task Brief"), F.col("task_brief"), F.lit(""), F.lit("# Evidence Pack")), evidence,
        F.array(F.lit(""), F.lit("# Term Pack"), F.when(F.size("term_pack") > 0, F.array_join("term_pack", ", ")).otherwise("(empty)"), F.lit(""), F.lit("# Style Pack"),
                bullets("style_pack", "- 保持自然、清晰、可复核"), F.lit(""), F.lit("# Failure Pack"), bullets("failure_pack", "- 不要脱离给定证据")),
    )
    return rows.select(
        *tasks.columns, "task_brief", "term_pack", "style_pack", "failure_pack", F.transform("e", lambda x: x["chunk_id"]).alias("source_chunk_ids"), F.array_join(lines, "\n").alias("compressed_context"),
    )


def normalize_generated(items: DataFrame, plan: str, schema: str = "qa") -> DataFrame:
    """Generated items with a valid lineage: source ids are kept where allowed, else all allowed ones.

    ``items``: task_id, item_index, source_chunk_ids, allowed_ids, genre_name, focus and the text fields of the schema.
    """
    kept = F.filter("source_chunk_ids", lambda x: F.array_contains("allowed_ids", x))
    ids = F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, kept).otherwise(F.col("allowed_ids"))
    fields = ("question", "answer") if schema == "qa" else ("instruction", "response")
    lineage = F.struct(F.lit(plan).alias("spec_name"), "task_id", F.lit("brief+evidence+terms+failures").alias("compression_mode"), F.col("allowed_ids").alias("retrieved_chunk_ids"))
    return items.select(
        F.format_string("%s-item-%03d", "task_id", F.col("item_index").cast("long")).alias("id"), F.lit(schema).alias("schema"), "language", "domain", F.col("genre_name").alias("genre"), "focus",
        ids.alias("source_chunk_ids"), lineage.alias("lineage"), *[strip(F.coalesce(F.col(f), F.lit(""))).alias(f) for f in fields],
    )


def budget_pack(chunks: DataFrame, budget: int, summary: str = "", fresh: str = "", fresh_tail_chars: int = 1200, order: str = "position") -> DataFrame:
    """Chunks that fit a character budget after the summary and the fresh tail: best score first, the last one cut.

    The characters before each chunk are summed over all tasks; what lies beyond the budget goes before anything is cut.
    """
    remaining = budget - len(summary[:budget])
    tail = fresh[-min(fresh_tail_chars, remaining):] if fresh.strip() and remaining > 0 else ""
    remaining = max(0, remaining - len(tail))
    by = [F.coalesce("score", F.lit(0.0)).desc(), F.col(order)]
    run = with_running_sum(chunks.where(F.length("text") > 0), by, F.length("text"), "before")
    return run.where(F.col("before") < remaining).withColumn("text", F.substring("text", F.lit(1), (F.lit(remaining) - F.col("before")).cast("int"))).drop("before")


def normalize_articles(articles: DataFrame, titles: DataFrame, stage: str, key: str = "position") -> DataFrame:
    """Articles with a title by position where they have none, ids and length estimates."""
    rows = articles.join(titles.select(key, F.col("title").alias("planned")), key, "left")
    number = F.col(key).cast("long")
    title = F.coalesce(F.nullif(strip(F.coalesce("title", F.lit(""))), F.lit("")), "planned", F.concat(F.lit("Untitled-"), number.cast("string")))
    body = strip(F.coalesce("body", F.lit("")))
    return rows.select(
        F.format_string(f"{stage}-article-%03d", number).alias("id"), key, title.alias("title"), body.alias("body"), F.lit(stage).alias("stage"), "language",
        length_units(body, F.col("language")).alias("word_count_estimate"),
    )


def chunk_list(rows: DataFrame, order: list, size: int) -> DataFrame:
    """Batches of ``size`` rows in order: ``batch`` from 0, ``slot`` inside the batch."""
    if size < 1:
        raise ValueError("size must be positive")
    numbered = with_position(rows, order)
    return numbered.withColumns({"batch": F.floor((F.col("position") - 1) / size), "slot": (F.col("position") - 1) % size}).drop("position")
