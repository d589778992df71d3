"""The driver contract."""

import ast
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

ROOT = Path(__spark_entry__.__file__).parent
DATA = Path("/root/testdata/sf0.001")


def test_every_query_with_sql_is_registered():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() == 10


def test_works_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "rowcraft", tmp_path / "rowcraft", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "rowcraft").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            for node in ast.walk(ast.parse(path.read_text())):
                named = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n.split(".") for n in named), path
