"""The rest imports, and its tests are collected, in a copy of the repository without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_rest_stands_without_the_training_data_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", ".hypothesis", "llm", "corpus_pipeline.py"))
    assert not list(copy.rglob("llm")) and not (copy / "corpus_pipeline.py").exists()
    code = "import __spark_entry__ as e, bench, echotrace.__main__; q = e.queries(); assert len(q) > 40 and set(e.oracle_sql()) <= set(q) and not [n for n in q if n.startswith('op') or n == 'pipeline']"
    assert subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True).stderr == ""
    found = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=copy, capture_output=True, text=True)
    assert found.returncode == 0, found.stdout


def test_nothing_else_imports_them():
    for f in (ROOT / "echotrace").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "llm" not in f.read_text(), f
