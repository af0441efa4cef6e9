"""The driver contract holds with and without the text preparation package."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SHOW = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(k.startswith('op') for k in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"


def shown(folder):
    done = subprocess.run([sys.executable, "-B", "-c", SHOW], cwd=folder, capture_output=True, text=True, check=True)
    return done.stdout.split()


def test_queries_are_registered_where_they_can_be_imported(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "tests"))
    alone = shown(copy)
    assert alone[1:] == ["0", "False", "True"] and int(alone[0]) >= 146
    whole = shown(ROOT)
    if whole[2] == "True":
        assert int(whole[0]) == int(alone[0]) + 14 and whole[1] == "13"


def test_nothing_else_imports_the_package():
    for path in (ROOT / "chorale").rglob("*.py"):
        if "llm" not in path.parts:
            assert "chorale.llm" not in path.read_text()
