"""Whole reports in order, placeholders of empty sections, and how often the base tables are read."""

from pyspark.sql import functions as F

from spanloom import catalog, wording
from spanloom.operators import stats
from spanloom.plans import reports
from spanloom.schema import SPAN_DDL

SF = "/root/testdata/sf0.001"
TASK = f"route string, agreement double, spans array<{SPAN_DDL}>, hard_example boolean, promote_to_gold boolean"


def lines(df):
    return [r.line for r in df.orderBy("section_no", "at").collect()]


def tables(spark):
    span = lambda a, b, label: ("", a, b, "x", label, a < 0)
    t = spark.createDataFrame([("auto_accept", 0.5, [span(0, 3, "A"), span(-1, -1, "B"), span(4, 8, "A")], True, False), (None, None, [], False, True), ("review", 0.70004, [span(0, 2, None)], False, False)], TASK)
    p = spark.createDataFrame([(1,), (2,)], "prediction_id int")
    r = spark.createDataFrame([("pending", False, ""), ("accepted", True, "span")], "status string, manually_edited boolean, error_type string")
    return t, p, r, spark.createDataFrame([(1,)], "job_id int")


def test_dataset_and_experiment_report(spark):
    t, p, r, j = tables(spark)
    got = lines(reports.dataset_report(t, p, r, j))
    assert got == [
        f"# {wording.DATASET_TITLE}", "", "- 任务总数: 3", "- 候选标注数: 2", "- 审核任务数: 2", "- 待审核数: 1", "- 自动通过率: 0.3333", "- 人工审核率: 0.3333", "- 疑难样例数: 1", "- 人工修改数: 1",
        "- 晋升为 gold-like 样例数: 1", "- 平均候选一致性: 0.6", "- 平均 span 长度: 3.0", "", f"## {wording.LABELS_TITLE}", "- A: 2", "- B: 1", "- 未知: 1", "", f"## {wording.ROUTES_TITLE}", "- auto_accept: 1", "- review: 1", "- 未路由: 1"]
    version = spark.createDataFrame([(2, None, ["a"], [], None), (1, 7, [], ["b", "c"], 3)], "version int, pass_count int, failed_task_ids array<string>, unstable_task_ids array<string>, round_index int")
    more = lines(reports.experiment_report(reports.dataset_report(t, p, r, j), version, r))
    assert more == got + ["", f"## {wording.VERSIONS_TITLE}", "- v1: pass=7, failed=0, unstable=2, round=3", "- v2: pass=-, failed=1, unstable=0, round=-", "", f"## {wording.FEEDBACK_TITLE}", "- span: 1"]


def test_reports_of_empty_tables(spark):
    t, p, r, j = [x.where("false") for x in tables(spark)]
    version = spark.createDataFrame([], "version int, pass_count int, failed_task_ids array<string>, unstable_task_ids array<string>, round_index int")
    got = lines(reports.experiment_report(reports.dataset_report(t, p, r, j), version, r))
    assert got[2:7] == ["- 任务总数: 0", "- 候选标注数: 0", "- 审核任务数: 0", "- 待审核数: 0", "- 自动通过率: 0.0"]
    assert got[-6:] == ["", f"## {wording.VERSIONS_TITLE}", wording.NO_VERSIONS, "", f"## {wording.FEEDBACK_TITLE}", wording.NO_ERRORS]
    assert stats.dataset_stats(t, p, r, j).first().avg_span_length == 0.0
    none = spark.createDataFrame([], "method string, round int, candidate_id int, status string, accepted boolean, loss double, memorization_passed boolean, tokens bigint, repair_attempts int")
    assert "- Best method: ``" in lines(reports.comparison_report(none))


def test_comparison_report(spark):
    log = spark.createDataFrame([("b", 1, 1, "evaluated", True, 4.5, True, 10, 0), ("a", 1, 2, "evaluated", False, 4.5, None, 5, 1), ("a", 2, 3, "memorization_guard_blocked", False, 0.1, False, 1, 2)],
                                "method string, round int, candidate_id int, status string, accepted boolean, loss double, memorization_passed boolean, tokens bigint, repair_attempts int")
    got = lines(reports.comparison_report(log, "case"))
    assert got[:8] == [f"# {wording.COMPARISON_TITLE}", "", "## Summary", "", "- Experiment case: `case`", "- Best method: `a`", "- Best loss: `4.5`", wording.BEST_NOTE]
    assert "| a | 1 | 0 | 1 | 4.5 | 6 | 3 |" in got and got[-1] == "| b | 1 | 1 | evaluated | 4.5 | clean | 0 |" and "| a | 2 | 3 | memorization_guard_blocked | 0.1 | blocked | 2 |" in got


def test_plain_numbers(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0001, 0.5, 12.0, 0.0, 1e7, 0.25)], "v double").select(reports.plain(F.col("v"))).collect()
    assert [r[0] for r in rows] == ["0.0001", "0.5", "12.0", "0.0", "10000000.0", "0.25"]


def test_base_tables_are_read_a_few_times(spark):
    """What is worked out from the documents is worked out once."""
    reads = []
    plain = type(spark.read).parquet

    def counted(reader, *paths, **options):
        reads.extend(paths)
        return plain(reader, *paths, **options)

    type(spark.read).parquet = counted
    try:
        for name in ("dataset_stats", "dataset_report"):
            reads.clear()
            catalog.queries()[name](spark, SF).collect()
            assert len(reads) <= 6, reads
            assert sum("documents" in x for x in reads) <= 2
    finally:
        type(spark.read).parquet = plain
    plan = catalog.queries()["dataset_stats"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 6
