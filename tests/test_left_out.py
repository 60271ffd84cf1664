"""The repository without its optional subpackage: the rest imports and names its queries."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASKED = """
import __spark_entry__ as entry
from workload.registry import QUERIES
assert set(entry.queries()) == set(QUERIES), set(entry.queries()) ^ set(QUERIES)
assert set(entry.oracle_sql()) <= set(QUERIES)
"""


def _copy(tmp_path, *left_out):
    target = tmp_path / "repo"
    names = shutil.ignore_patterns(".git", "__pycache__", "*.json")
    shutil.copytree(ROOT, target, ignore=names)
    for folder in left_out:
        shutil.rmtree(target / folder, ignore_errors=True)
    return target


def _run(target, code):
    env = {**os.environ, "PYTHONPATH": str(target)}
    return subprocess.run([sys.executable, "-c", code], cwd=target, env=env, capture_output=True, text=True)


def test_queries_without_the_subpackage(tmp_path):
    target = _copy(tmp_path, "marketlens/llm", "tests/llm")
    done = _run(target, ASKED)
    assert done.returncode == 0, done.stderr


def test_other_missing_modules_are_not_forgiven(tmp_path):
    target = _copy(tmp_path, "marketlens/llm", "tests/llm")
    (target / "corpus_pipeline.py").write_text("import no_such_module\n")
    done = _run(target, ASKED)
    assert "no_such_module" in done.stderr
