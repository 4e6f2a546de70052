"""Nothing else in the library needs this subpackage."""

from __future__ import annotations

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def test_nothing_else_imports_it():
    for path in (ROOT / "pagelathe").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"pagelathe\.llm|from \.+llm", path.read_text()), path


def test_the_entry_works_without_it(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "spark-warehouse"))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sorted(e.queries())[:3], len(e.oracle_sql()))"], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert "op1_" not in done.stdout
