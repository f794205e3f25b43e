"""The library without its text subpackage: the entry module and the other tests still load."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("pipeline", [True, False], ids=["with pipeline file", "without pipeline file"])
def test_the_rest_loads_without_the_text_subpackage(tmp_path, pipeline):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    if not pipeline:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    assert not (copy / "logloom/llm").exists() and not (copy / "tests/llm").exists()
    # The copy is the working folder and so comes first; libraries may come by the path that this process has.
    env = dict(os.environ)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 50 and set(o) <= set(q); assert 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, check=True, timeout=120)
    subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider"], cwd=copy, env=env, check=True, timeout=120)
    if pipeline:
        subprocess.run([sys.executable, "-m", "pytest", "tests/test_timeline.py", "tests/test_queries.py", "-q", "-p", "no:cacheprovider", "-k", "sliding or flagship or oracle_has or user_event_stats"], cwd=copy, env=env, check=True, timeout=400)
