"""The registry: names, SQL for known names, and independence of the optional part."""

import importlib.util
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 30


def test_nothing_outside_imports_the_optional_part():
    for p in (ROOT / "foliant").rglob("*.py"):
        if "llm" not in p.parts:
            assert "foliant.llm" not in p.read_text(), p


def test_imports_without_the_optional_part(tmp_path):
    import shutil

    shutil.copytree(ROOT / "foliant", tmp_path / "foliant", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'pdf_meta' in q and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})


def test_all_operators_are_registered():
    if importlib.util.find_spec("foliant.llm") is None:
        return
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
