"""The entry works without the training-data subpackage and the pipeline."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from keyroll.plans.registry import all_oracles, all_queries

ROOT = Path(__file__).resolve().parent.parent
CODE = "import __spark_entry__ as e; print(' '.join(sorted(e.queries()))); print(' '.join(sorted(e.oracle_sql())))"


@pytest.mark.parametrize("without", [("keyroll/llm",), ("keyroll/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_without_training_data(tmp_path, without):
    keep = tmp_path / "repo"
    shutil.copytree(ROOT, keep, ignore=lambda d, names: [
        n for n in names if n in (".git", "tests", "__pycache__") or str((Path(d) / n).relative_to(ROOT)) in without])
    out = subprocess.run([sys.executable, "-c", CODE], cwd=keep, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    queries, oracles = (set(x.split()) for x in out.stdout.strip().splitlines())
    assert set(all_queries()) <= queries and set(all_oracles()) <= oracles
    if "keyroll/llm" in without:
        assert queries == set(all_queries())
