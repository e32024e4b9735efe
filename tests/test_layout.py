"""The library stands without the training-data subpackage, and holds no data."""

import os
import re
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _python_files():
    for top, dirs, names in os.walk(REPO):
        dirs[:] = [d for d in dirs if not d.startswith((".", "__pycache__"))]
        yield from (os.path.relpath(os.path.join(top, n), REPO) for n in names if n.endswith(".py"))


def test_nothing_else_imports_the_subpackage():
    allowed = ("driftrank/llm/", "tests/llm/", "corpus_pipeline.py", "__spark_entry__.py", "tests/test_layout.py")
    for path in _python_files():
        if not path.startswith(allowed):
            with open(os.path.join(REPO, path), encoding="utf-8") as f:
                assert not re.search(r"driftrank\.llm|from driftrank import llm|corpus_pipeline", f.read()), path


def test_the_entry_imports_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "driftrank"):
        os.symlink(os.path.join(REPO, name), tmp_path / name) if name.endswith(".py") else _linked(tmp_path)
    code = "import __spark_entry__ as e; names = e.queries(); assert 'q_hot_rank' in names and not [n for n in names if n[:2] == 'op'], names"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert not done.returncode, done.stderr


def _linked(tmp_path):
    """driftrank without llm."""
    os.mkdir(tmp_path / "driftrank")
    for name in os.listdir(os.path.join(REPO, "driftrank")):
        if name not in ("llm", "__pycache__"):
            os.symlink(os.path.join(REPO, "driftrank", name), tmp_path / "driftrank" / name)


def test_no_code_runs_what_it_scans():
    for path in _python_files():
        if path.startswith("driftrank/sources/"):
            with open(os.path.join(REPO, path), encoding="utf-8") as f:
                assert not re.search(r"\b(exec|eval|importlib|__import__|runpy)\b\s*[(.]", f.read()), path
