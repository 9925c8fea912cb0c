"""The rest of the repository without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

from tests.conftest import HERE


@pytest.mark.parametrize("pipeline", [True, False])
def test_it_imports_without_the_llm_folders(tmp_path, pipeline):
    """With and without the pipeline's file beside the deleted folders."""
    shutil.copytree(f"{HERE}/tidewater", tmp_path / "tidewater", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{HERE}/__spark_entry__.py", tmp_path)
    if pipeline and os.path.exists(f"{HERE}/corpus_pipeline.py"):
        shutil.copy(f"{HERE}/corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and set(e.oracle_sql()) <= set(q) and not [n for n in q if n.startswith('op') or n == 'pipeline']"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)


def test_a_fault_inside_the_llm_folder_is_not_hidden(tmp_path):
    shutil.copytree(f"{HERE}/tidewater", tmp_path / "tidewater", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{HERE}/__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=env, capture_output=True, timeout=120)
    assert done.returncode and b"no_such_module" in done.stderr
