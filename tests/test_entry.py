"""The driver contract holds with the training-data operators and without them."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"


def names(root):
    done = subprocess.run([sys.executable, "-B", "-c", SHOW], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=120, check=True)
    return set(done.stdout.split())


@pytest.fixture
def copy(tmp_path):
    root = tmp_path / "repo"
    shutil.copytree(ROOT, root, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    return root


def test_without_the_operators_the_other_queries_stay(copy):
    shutil.rmtree(copy / "tallyloom/llm", ignore_errors=True)
    shutil.rmtree(copy / "tests/llm", ignore_errors=True)
    rest = names(str(copy))
    assert "numeric_profile" in rest and not any(n.startswith("op1_") or n == "pipeline" for n in rest)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    assert names(str(copy)) == rest


def test_errors_inside_are_not_swallowed(copy):
    queries = copy / "tallyloom/llm/queries.py"
    if not queries.exists():
        pytest.skip("the operators were deleted")
    queries.write_text("import a_module_that_is_nowhere\n" + queries.read_text())
    with pytest.raises(subprocess.CalledProcessError):
        names(str(copy))
