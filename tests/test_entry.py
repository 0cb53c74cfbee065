import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import ROOT
from sparkloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = ["knn_label_distance_filtered", "box_validation_flags", "optimal_threshold", "merge_renumber_ids", "stratified_sample", "chunk_windows", "labels_to_coco", "ap_integrate", "qa_parse"]


def rows(cursor):
    return sorted(str(tuple(round(x, 6) + 0.0 if isinstance(x, float) else x for x in r)) for r in cursor)


@pytest.mark.parametrize("name", FAST)
def test_queries_equal_their_oracles(spark, sf, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df, rel = entry.queries()[name](spark, sf), c.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.select(*sorted(df.columns)).collect()) == rows(rel.select(*[f'"{x}"' for x in sorted(rel.columns)]).fetchall())


def test_smoke(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _answers(folder):
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(n[:2] == 'op' and n[2].isdigit() or n == 'pipeline' for n in e.queries()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return list(map(int, subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, check=True, capture_output=True, text=True).stdout.split()))


def test_entry_without_the_optional_parts(tmp_path):
    """In a copy, with the folder of operators on training corpora deleted, with and without the pipeline beside it."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    whole = [len(entry.queries()), len(entry.oracle_sql())]
    optional = copy / "sparkloom" / "llm"
    if optional.exists():
        assert _answers(copy)[:2] == whole
        shutil.rmtree(optional)
    core = _answers(copy)
    assert core[0] == len(registry.QUERIES) and core[1] == len(registry.ORACLES) and core[2] == 0
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    assert _answers(copy) == core
