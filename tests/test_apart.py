"""The engine without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_without_the_subpackage(tmp_path):
    """Both folders deleted, with and without corpus_pipeline.py: the same queries of the engine's own are served."""
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sorted(n for n in q if n == 'pipeline' or n.startswith('op')))"
    told = []
    for keeps in (True, False):
        root = tmp_path / str(keeps)
        shutil.copytree(HERE, root, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if keeps else ["corpus_pipeline.py"])))
        assert not (root / "lodestar" / "llm").exists() and (root / "corpus_pipeline.py").exists() == (keeps and os.path.exists(f"{HERE}/corpus_pipeline.py"))
        told.append(subprocess.run([sys.executable, "-c", code], cwd=root, env={**os.environ, "PYTHONPATH": str(root)}, capture_output=True, check=True, text=True).stdout)
    assert told[0] == told[1] and told[0].endswith("[]\n")
