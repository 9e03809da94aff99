"""The entry imports, with its queries, from copies without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), *sorted(e.queries()))"


@pytest.mark.parametrize("gone", [[], ["crawlspark/llm"], ["crawlspark/llm", "tests/llm", "corpus_pipeline.py"]])
def test_import_without_corpus_operators(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: [
        n for n in names if n in (".git", "__pycache__", "spark-warehouse")
        or str((Path(folder) / n).relative_to(ROOT)) in gone])
    shown = subprocess.run([sys.executable, "-B", "-c", SHOW], cwd=copy, capture_output=True, text=True, timeout=120,
                           env={"PATH": "/usr/bin:/bin"})
    assert shown.returncode == 0, shown.stderr[-500:]
    n_queries, n_oracles, *names = shown.stdout.split()
    assert int(n_oracles) <= int(n_queries) == len(names) and int(n_queries) >= 88
    assert not gone or not any(n.startswith("op") or n == "pipeline" for n in names)
