from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [("quillbin/llm", "tests/llm", "corpus_pipeline.py"), ("quillbin/llm", "tests/llm")])
def test_entry_without_the_corpus_operators(tmp_path, gone):
    """A copy without them imports, has the other queries and no pipeline."""
    to = tmp_path / "copy"
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        at = to / name
        if at.is_dir():
            shutil.rmtree(at)
        elif at.exists():
            at.unlink()
    code = "import __spark_entry__ as e; q = e.queries(); assert 'eval_bins' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=to, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(to)})
    assert done.returncode == 0, done.stderr
