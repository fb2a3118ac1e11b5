"""The driver contract holds with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_optional_modules(tmp_path):
    shutil.copytree(f"{ROOT}/shardmend", f"{tmp_path}/shardmend", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'recipe_chain' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr


def test_entry_with_an_emptied_folder(tmp_path):
    shutil.copytree(f"{ROOT}/shardmend", f"{tmp_path}/shardmend", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    os.makedirs(f"{tmp_path}/shardmend/llm/__pycache__")
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(f"{ROOT}/{name}", tmp_path) if os.path.exists(f"{ROOT}/{name}") else None
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert 'recipe_chain' in e.queries() and 'pipeline' not in e.queries()"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr


def test_entry_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark, tmp_path):
    from pyspark.sql import functions as F

    from shardmend import catalogue

    rows = [(0, "a\nb\r\nc\n"), (1, ""), (2, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_in"], r["n_out"]) for r in catalogue.recipe_chain(spark, str(tmp_path)).orderBy(F.col("doc_id")).collect()}
    assert got == {0: (7, 5), 1: (0, 0), 2: (None, None)}
