"""Queries on tables whose ids go beyond those of the test tables, and on rows that these lack, against DuckDB."""

import os

import duckdb
import pytest
from conftest import rows_of

from tallyloom.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture
def larger(tmp_path):
    """A folder of tables: those of sf0.001, but for the given ones (name -> SQL over the others)."""

    def make(**own):
        con = duckdb.connect()
        for name in os.listdir(SF):
            t = name.split(".")[0]
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{name}'")
            if t not in own:
                os.symlink(f"{SF}/{name}", tmp_path / name)
        made = duckdb.connect()
        for t, sql in own.items():
            con.execute(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet'")
        for name in os.listdir(tmp_path):
            if name.endswith(".parquet"):
                made.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{tmp_path}/{name}'")
        return str(tmp_path), made

    return make


def as_sql(spark, made, name):
    folder, con = made
    run, sql = QUERIES[name]
    df = run(spark, folder)
    cur = con.execute(sql)
    theirs = cur.fetchall()
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], theirs)
    return len(theirs)


def test_lines_that_end_in_their_number(spark, larger):
    text = "CASE doc_id % 3 WHEN 0 THEN '0 of ten lines' || chr(10) || 'line of number 1' || chr(10) || ' 2 and two more 2' ELSE 'line of number 1' || chr(10) || '2 and two more 2' END"
    made = larger(documents=f"SELECT doc_id, {text} AS text, 'd' || doc_id // 3 AS lang, source, n_chars FROM documents WHERE doc_id < 30")
    assert as_sql(spark, made, "edits_kept") == 10


@pytest.mark.parametrize("first", [500_000, 999_960, 3_000_000])
def test_import_of_ids_around_the_base(spark, larger, first):
    made = larger(documents=f"SELECT * REPLACE (doc_id + {first} AS doc_id) FROM documents")
    assert as_sql(spark, made, "import_foreign") > 50


def test_memories_of_times_to_come(spark, larger):
    made = larger(documents="SELECT * REPLACE (doc_id + 199900 AS doc_id) FROM documents")
    assert as_sql(spark, made, "prompt_recall") > 50
