"""The entry points without a session, and without the corpus operators."""
import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
NAMES = "import __spark_entry__ as e; print(*e.queries()); print(len(e.oracle_sql()))"


def names(folder) -> list[str]:
    run = subprocess.run([sys.executable, "-c", NAMES], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    return run.stdout.split("\n")[-3].split()


def test_queries_can_be_listed_without_a_session():
    assert "R12_hybrid_search" in names(ROOT)


def test_the_library_stands_without_the_corpus_operators(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", ".pytest_cache"))
    (copy / "factloom/llm/__pycache__").mkdir(parents=True)
    found = names(copy)
    assert "R12_hybrid_search" in found and "pipeline" not in found and not [n for n in found if n.startswith("op")]


def test_nothing_else_imports_them():
    for path in [*ROOT.glob("factloom/**/*.py"), ROOT / "bench.py"]:
        if "llm" not in path.relative_to(ROOT).parts:
            assert "factloom.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path
