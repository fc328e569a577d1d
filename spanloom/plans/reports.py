"""Reports as ordered lines: (section, position, line). Sorted and written as text they are the Markdown file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import wording
from ..operators import stats as st
from ..operators.leakage import BLOCKED_STATUSES

def _lines(df: DataFrame, section_no: int, section: str, order: list, line: Column) -> DataFrame:
    return df.select(F.lit(section_no).alias("section_no"), F.lit(section).alias("section"), F.concat_ws("|", *order).alias("at"), line.alias("line"))


def _fixed(df: DataFrame, section_no: int, section: str, texts: list[str]) -> DataFrame:
    rows = [(section_no, section, f" {i:02d}", t) for i, t in enumerate(texts)]
    return df.sparkSession.createDataFrame(rows, "section_no int, section string, at string, line string")


def _down(count: Column) -> Column:
    return F.format_string("%019d", F.lit(10**18) - count)


def plain(value: Column) -> Column:
    """A double with up to four places as people write it: 0.5, 0.0001, 0.0."""
    text = F.regexp_replace(value.cast("decimal(38,4)").cast("string"), "0+$", "")
    return F.when(text.endswith("."), F.concat(text, F.lit("0"))).otherwise(text)


def table_head(names: list[str], numbers: bool = False) -> list[str]:
    return ["| " + " | ".join(names) + " |", "| " + " | ".join("---" for _ in names) + " |"]


def table_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in cells]), " | "), F.lit(" |"))


def _or_else(rows: DataFrame, placeholder: str, section_no: int, section: str) -> DataFrame:
    """The rows of a section, or its placeholder line when there are none."""
    empty = rows.agg(F.count(F.lit(1)).alias("n_")).where("n_ = 0")
    return rows.unionByName(empty.select(F.lit(section_no).alias("section_no"), F.lit(section).alias("section"), F.lit("~").alias("at"), F.lit(placeholder).alias("line")))


def dataset_report(tasks: DataFrame, predictions: DataFrame, reviews: DataFrame, jobs: DataFrame, title: str = wording.DATASET_TITLE) -> DataFrame:
    """Summary, labels and routes, most frequent first. Every figure comes from one pass over each table."""
    entry = lambda no, section, at, line: F.struct(F.lit(no).alias("section_no"), F.lit(section).alias("section"), at.alias("at"), line.alias("line"))
    number = lambda c: plain(F.col(c)) if c.startswith(("avg", "auto")) or c.endswith("rate") else F.col(c).cast("string")
    summary = F.array(*[entry(1, "summary", F.lit(f"{i:02d}"), F.concat(F.lit(f"- {name}: "), number(c))) for i, (name, c) in enumerate(wording.SUMMARY_LINES)])
    named = lambda no, section, n: F.array(entry(no, section, F.concat_ws("|", _down(F.col(n)), "name"), F.concat(F.lit("- "), F.col("name"), F.lit(": "), F.col(n).cast("string"))))
    figures = st.dataset_figures(tasks, predictions, reviews, jobs)
    lines = F.when(F.col("kind") == "all", summary).when(F.col("kind") == "label", named(2, wording.LABELS_TITLE, "span_count")).otherwise(named(3, wording.ROUTES_TITLE, "task_count"))
    parts = [
        _fixed(tasks, 0, "title", [f"# {title}", ""]), figures.select(F.inline(lines)), _fixed(tasks, 2, wording.LABELS_TITLE, ["", f"## {wording.LABELS_TITLE}"]),
        _fixed(tasks, 3, wording.ROUTES_TITLE, ["", f"## {wording.ROUTES_TITLE}"]),
    ]
    return reduce(DataFrame.unionByName, parts)


def experiment_report(dataset_lines: DataFrame, versions: DataFrame, reviews: DataFrame) -> DataFrame:
    """The dataset report followed by concept versions and review feedback; empty sections say so."""
    v = st.version_report(versions)
    or_dash = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    text = F.concat(F.lit("- v"), F.col("version").cast("string"), F.lit(": pass="), or_dash("pass_count"), F.lit(", failed="), F.col("failed").cast("string"),
                    F.lit(", unstable="), F.col("unstable").cast("string"), F.lit(", round="), or_dash("round_index"))
    fb = st.review_feedback_counts(reviews)
    feedback = _lines(fb, 5, wording.FEEDBACK_TITLE, [_down(F.col("review_count")), F.col("error_type")], F.concat(F.lit("- "), "error_type", F.lit(": "), F.col("review_count").cast("string")))
    parts = [
        dataset_lines, _fixed(reviews, 4, wording.VERSIONS_TITLE, ["", f"## {wording.VERSIONS_TITLE}"]),
        _or_else(_lines(v, 4, wording.VERSIONS_TITLE, [F.format_string("%019d", "version")], text), wording.NO_VERSIONS, 4, wording.VERSIONS_TITLE),
        _fixed(reviews, 5, wording.FEEDBACK_TITLE, ["", f"## {wording.FEEDBACK_TITLE}"]), _or_else(feedback, wording.NO_ERRORS, 5, wording.FEEDBACK_TITLE),
    ]
    return reduce(DataFrame.unionByName, parts)


def bootstrap_report(scores: DataFrame, token_stats: DataFrame, items: DataFrame, manifest: DataFrame | None = None, run_name: str = "", review: DataFrame | None = None) -> DataFrame:
    """Summary (where a manifest of metric and value is given), routes, review queue, top entity tokens and reflection items of a bootstrap run."""
    num = lambda c: F.format_string("%.2f", F.bround(F.col(c), 2))
    cell = lambda *cs: F.concat(F.lit("| "), F.array_join(F.array(*cs), " | "), F.lit(" |"))
    routes, top, refl = st.route_counts(scores), st.top_entity_tokens(token_stats), st.reflection_item_counts(items)
    parts = [_fixed(scores, 0, "title", [f"# {wording.BOOTSTRAP_TITLE}", ""])]
    if manifest is not None:
        names = [("sample_count", "Samples"), ("candidate_count", "Candidate runs"), ("review_task_count", "Review tasks"), ("reflection_plan_count", "Reflection plans")]
        place = F.create_map(*[F.lit(x) for i, (m, n) in enumerate(names) for x in (m, f"1{i}- {n}: ")])
        rows = manifest.select(place[F.col("metric")].alias("p"), F.col("value").cast("string").alias("v")).where("p IS NOT NULL")
        parts += [
            _fixed(scores, 1, "Summary", ["## Summary", "", f"- Run name: `{run_name}`"]), _lines(rows, 1, "Summary", [F.substring("p", 1, 2)], F.concat(F.substring("p", 3, 99), F.col("v"))),
            _fixed(scores, 2, "Consistency Routes", [""]),
        ]
    parts += [
        _fixed(scores, 3, "Consistency Routes", ["## Consistency Routes", "", "| route | count |", "| --- | ---: |"]),
        _lines(routes, 3, "Consistency Routes", [F.col("position").cast("string")], cell(F.col("route"), F.col("sample_count").cast("string"))),
    ]
    if review is not None:
        size = review.agg(F.count(F.lit(1)).alias("n"))
        parts += [
            _fixed(scores, 4, "Human Review", ["", "## Human Review", ""]), _lines(size, 4, "Human Review", [F.lit("1")], F.concat(F.lit("- Queue size: "), F.col("n").cast("string"))),
            _fixed(scores, 5, "Human Review", [wording.REVIEW_POLICY]),
        ]
    parts += [
        _fixed(scores, 6, "Top Entity Tokens", ["", "## Top Entity Tokens", "", "| token | entity_count | entity_prob | context_prob | other_prob |", "| --- | ---: | ---: | ---: | ---: |"]),
        _lines(top, 6, "Top Entity Tokens", [_down(F.col("entity_count")), F.col("token")], cell(F.col("token"), F.col("entity_count").cast("string"), num("entity_p"), num("context_p"), num("other_p"))),
        _fixed(scores, 7, "Reflection Items", ["", "## Reflection Items", "", "| type | count |", "| --- | ---: |"]),
        _lines(refl, 7, "Reflection Items", [F.col("item_type")], cell(F.col("item_type"), F.col("item_count").cast("string"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def method_summary(candidates: DataFrame) -> DataFrame:
    """One row per method over its candidate evaluations (method, status, accepted, loss, tokens, repair_attempts)."""
    done = F.col("status") == "evaluated"
    return candidates.groupBy("method").agg(
        F.count_if(done).alias("evaluated_candidates"), F.count_if("accepted").alias("accepted_candidates"), F.count_if(F.col("status").isin(BLOCKED_STATUSES)).alias("blocked_candidates"),
        F.min(F.when(done, F.col("loss"))).alias("best_loss"), F.sum("tokens").alias("tokens"), F.sum("repair_attempts").alias("repairs"))


METHOD_COLUMNS = ["method", "evaluated_candidates", "accepted_candidates", "blocked_candidates", "best_loss", "tokens", "repairs"]
CANDIDATE_COLUMNS = ["method", "round", "candidate", "status", "loss", "memorization", "repairs"]


def comparison_report(candidates: DataFrame, case: str = "custom") -> DataFrame:
    """Best method, a table of methods and the status of every candidate.

    ``candidates``: method, round, candidate_id, status, accepted, loss, memorization_passed, tokens, repair_attempts. The best method has
    the least loss of an evaluated candidate, the first name at a tie. The table of candidates is as long as the log; the report
    stays a table of lines and is written by ``write_report`` in parts where it is long.
    """
    m = method_summary(candidates)
    best = m.agg(F.min_by(F.struct("method", "best_loss"), F.struct(F.col("best_loss").isNull(), "best_loss", "method")).alias("b"))
    text = lambda c: F.when(F.col(c).isNull(), "").otherwise(plain(F.col(c)))
    first = best.select(F.explode(F.array(
        F.struct(F.lit("1").alias("at"), F.concat(F.lit("- Best method: `"), F.coalesce("b.method", F.lit("")), F.lit("`")).alias("line")),
        F.struct(F.lit("2").alias("at"), F.concat(F.lit("- Best loss: `"), F.coalesce(plain(F.col("b.best_loss")), F.lit("0.0")), F.lit("`")).alias("line")))).alias("e")).select("e.*")
    rows = table_row(*[text(c) if c == "best_loss" else F.col(c) for c in METHOD_COLUMNS])
    clean = F.when(F.coalesce("memorization_passed", F.lit(True)), "clean").otherwise("blocked")
    each = table_row(F.col("method"), F.col("round"), F.col("candidate_id"), F.col("status"), text("loss"), clean, F.col("repair_attempts"))
    title = lambda no, name, head: _fixed(candidates, no, name, ["", f"## {name}", "", *table_head(head)])
    parts = [
        _fixed(candidates, 0, "title", [f"# {wording.COMPARISON_TITLE}", "", "## Summary", "", f"- Experiment case: `{case}`"]),
        first.select(F.lit(1).alias("section_no"), F.lit("Summary").alias("section"), "at", "line"), _fixed(candidates, 2, "Summary", [wording.BEST_NOTE]),
        title(3, "Method Comparison", METHOD_COLUMNS), _lines(m, 3, "Method Comparison", [F.col("method")], rows),
        title(4, "Candidate Status", CANDIDATE_COLUMNS),
        _lines(candidates, 4, "Candidate Status", [F.col("method"), F.format_string("%019d", F.col("round").cast("long")), F.format_string("%019d", F.col("candidate_id").cast("long"))], each),
    ]
    return reduce(DataFrame.unionByName, parts)


def write_report(lines: DataFrame, path: str, mode: str = "error") -> None:
    """One text file in report order. A report has a few dozen lines."""
    lines.orderBy("section_no", "at").select(F.col("line").alias("value")).coalesce(1).write.mode(mode).text(path)


def history_export(history: DataFrame, exported_at: str, key: str, order: str) -> DataFrame:
    """One JSON document per history (a conversation): export time, entry count, entries in order."""
    entries = history.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.struct("role", "text").alias("entry")))).alias("xs"))
    payload = F.struct(F.lit(exported_at).alias("exported_at"), F.size("xs").alias("history_count"), F.transform("xs", lambda x: x["entry"]).alias("history"))
    return entries.select(key, F.to_json(payload).alias("value"))


def catalog_export(concepts: DataFrame, version: str = "2.0") -> DataFrame:
    """Concepts as JSON lines with the format version; a whole catalogue is never put into one row."""
    return concepts.select("name", F.to_json(F.struct(F.lit(version).alias("version"), *concepts.columns)).alias("value"))
