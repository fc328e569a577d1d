"""Texts that appear in outputs or are compared by later steps."""

ROUTE_REASON_SCORE = "span-F1 自洽性、完全一致率、模型自评和规则风险组合"
ROUTE_REASON_AUDIT = "高置信抽检"
OPTION_EMPTY = "空标注"
OPTION_MANUAL = "以上都不对，我要手动修正"
NO_ROUTE = "未路由"
ALL_PASSED = "所有金样例均通过当前概念阐释。"
MISSING_WORD = "漏标 "
EXTRA_WORD = "多标 "
UNSTABLE_WORD = "标注边界或标签不稳定"
PART_SEP = "；"
AVOID_TERM = "避免使用禁用词："
TASK_MISSING = "任务不存在"
NO_LABEL = "未知"

# Titles and lines of the reports.
DATASET_TITLE = "标注报告"
LABELS_TITLE = "标签分布"
ROUTES_TITLE = "路由分布"
VERSIONS_TITLE = "概念自举版本"
FEEDBACK_TITLE = "主动审核反馈"
NO_VERSIONS = "- 暂无概念版本记录"
NO_ERRORS = "- 暂无错误类型记录"
SUMMARY_LINES = [
    ("任务总数", "task_count"), ("候选标注数", "prediction_count"), ("审核任务数", "review_count"), ("待审核数", "pending_review_count"), ("自动通过率", "auto_accept_rate"), ("人工审核率", "review_rate"),
    ("疑难样例数", "hard_example_count"), ("人工修改数", "manual_edit_count"), ("晋升为 gold-like 样例数", "promoted_to_gold_count"), ("平均候选一致性", "avg_agreement"), ("平均 span 长度", "avg_span_length"),
]
BOOTSTRAP_TITLE = "Concept Bootstrap Report"
COMPARISON_TITLE = "Prompt Training Comparison Report"
REVIEW_POLICY = "- Policy: review `medium` and `low` routes first; sample `high` for audit."
BEST_NOTE = "- Best fields use the historical best accepted prompt, not the last round snapshot."
