"""The library without the training-data subpackage: nothing else imports it."""

import ast
import shutil
import subprocess
import sys

from conftest import ROOT


def test_nothing_imports_the_subpackage():
    for p in (ROOT / "latticeflow").rglob("*.py"):
        if "llm" in p.relative_to(ROOT / "latticeflow").parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] + [a.name for a in node.names] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), p


def test_entry_without_it(tmp_path):
    shutil.copytree(ROOT / "latticeflow", tmp_path / "latticeflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'cue_layout' in q and not any(k.startswith('op') and k[2].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_entry_with_a_broken_one(tmp_path):
    """A package that the subpackage imports may be missing."""
    shutil.copytree(ROOT / "latticeflow", tmp_path / "latticeflow", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    (tmp_path / "latticeflow" / "llm").mkdir()
    (tmp_path / "latticeflow" / "llm" / "__init__.py").write_text("")
    (tmp_path / "latticeflow" / "llm" / "registry.py").write_text("import a_package_that_is_not_there\n")
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert 'cue_layout' in e.queries()"], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
