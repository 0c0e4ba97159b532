"""The library works without its llm subpackage."""

import os
import shutil
import subprocess
import sys


def test_the_rest_stands_alone(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "bitloom"), tmp_path / "bitloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'lsh_ann' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_it():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "bitloom")
    for folder, _, names in os.walk(root):
        if f"{os.sep}llm" not in folder:
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as f:
                        assert "bitloom.llm" not in f.read(), name


def test_a_missing_library_takes_only_the_queries_that_need_it(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("xxhash", "tokenizers"):
        (tmp_path / f"{name}.py").write_text("raise ImportError('not here')")
    code = "import __spark_entry__ as e; assert 'lsh_ann' in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": f"{tmp_path}:{root}"})
