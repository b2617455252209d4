"""The driver's entry module, whole and without the text operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q), set(s) - set(q); print(sorted(k for k in q if k.startswith('op') or k == 'pipeline'), len(q) > 50, callable(e.entry))"


def names(folder):
    return subprocess.run([sys.executable, "-W", "ignore", "-c", PROBE], cwd=folder, capture_output=True, text=True, check=True).stdout.strip()


def copy(to, *without):
    shutil.copytree(f"{ROOT}/factloom", f"{to}/factloom", ignore=shutil.ignore_patterns("__pycache__", *without))
    shutil.copy(f"{ROOT}/__spark_entry__.py", to)
    return to


def test_entry_without_text_operators(tmp_path):
    assert names(copy(tmp_path, "llm")) == "[] True True"


def test_entry_with_a_pipeline_that_has_no_operators(tmp_path):
    (tmp_path / "corpus_pipeline.py").write_text("from factloom.llm import no_such_operator\n")
    assert names(copy(tmp_path, "llm")) == "[] True True"
