"""The registry with and without the llm subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
LIST = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(k.startswith('op') for k in e.queries()))"


def listed(folder):
    done = subprocess.run([sys.executable, "-c", LIST], cwd=folder, capture_output=True, text=True, check=True, timeout=120)
    return [int(x) for x in done.stdout.split()]


def test_queries_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "loomcorpus", tmp_path / "loomcorpus", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    queries, oracles, numbered = listed(tmp_path)
    assert queries > 150 and 0 < oracles <= queries and numbered == 0
    # the pipeline alone changes nothing
    (tmp_path / "corpus_pipeline.py").write_text("from loomcorpus.llm.scratch import materialize\n")
    assert listed(tmp_path) == [queries, oracles, 0]
