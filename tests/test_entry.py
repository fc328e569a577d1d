import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [["spanloom/llm"], ["spanloom/llm", "corpus_pipeline.py"]])
def test_entry_without_optional_parts(folder, gone):
    """A copy without the training-data operators still gives all other queries and statements, also where the pipeline's file is left."""
    copy = os.path.join(folder, "copy")
    shutil.copytree(REPO, copy, ignore=lambda d, names: [n for n in names if n in (".git", "__pycache__") or os.path.relpath(os.path.join(d, n), REPO) in gone])
    said = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(s) <= set(q); print(sorted(n for n in q if n == 'pipeline' or n.startswith('op')))"
    run = subprocess.run([sys.executable, "-c", said], cwd=copy, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    assert run.stdout.strip() == "[]"
