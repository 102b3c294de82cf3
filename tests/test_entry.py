import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; print(sorted(n for n in e.queries() if n[:2] == 'op' and n[2:3].isdigit() or n == 'pipeline'), len(e.queries()) > 200, set(e.oracle_sql()) <= set(e.queries()))"


def copied(folder, pipeline):
    shutil.copytree(os.path.join(ROOT, "tickforge"), folder / "tickforge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py") if pipeline else ("__spark_entry__.py",):
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), folder)
    return folder


def run(folder):
    return subprocess.run([sys.executable, "-B", "-c", COUNT], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120)


@pytest.mark.parametrize("pipeline", [True, False])
def test_queries_without_the_training_data_operators(tmp_path, pipeline):
    done = run(copied(tmp_path, pipeline))
    assert done.returncode == 0 and done.stdout.split("\n")[-2] == "[] True True", done.stderr[-2000:]


def test_other_missing_modules_are_errors(tmp_path):
    folder = copied(tmp_path, False)
    (folder / "corpus_pipeline.py").write_text("import surely_no_such_module\n")
    done = run(folder)
    assert done.returncode != 0 and "surely_no_such_module" in done.stderr
