"""The entry works without the text operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_text_operators(tmp_path):
    skip = shutil.ignore_patterns(".git", "llm", "__pycache__")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    for pipeline in (True, False):
        if not pipeline:
            os.remove(tmp_path / "copy" / "corpus_pipeline.py")
        out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, check=True)
        count, has_pipeline, covered = out.stdout.split()
        assert int(count) > 150 and has_pipeline == "False" and covered == "True"
