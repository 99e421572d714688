"""The driver contract."""

import os
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.abspath(__spark_entry__.__file__))


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns == ["s_id", "n_records", "mean_p"] and found.count() > 0


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    for name in os.listdir(ROOT):
        if name not in ("linkora", "corpus_pipeline.py", ".git"):
            os.symlink(f"{ROOT}/{name}", tmp_path / name)
    (tmp_path / "linkora").mkdir()
    for name in os.listdir(f"{ROOT}/linkora"):
        if name != "llm":
            os.symlink(f"{ROOT}/linkora/{name}", tmp_path / "linkora" / name)
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert "argmax_assign" in said.stdout and "op1_" not in said.stdout and "pipeline" not in said.stdout, said.stderr
