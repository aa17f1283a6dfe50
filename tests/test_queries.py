import duckdb
import pytest

import __spark_entry__ as entry
from quire.plans import documents, files, layout, more, relational
from tests.oracle import differs

SF = "/root/testdata/sf0.001"
PLANS = {k: (f, m.SQL.get(k)) for m in (documents, files, layout, more, relational) for k, f in m.QUERIES.items()}


@pytest.mark.parametrize("name", PLANS)
def test_query_equals_its_sql(spark, name):
    run, sql = PLANS[name]
    if sql is None:
        assert run(spark, SF).count() > 0
    else:
        assert differs(spark, SF, run, sql) == ""


def test_intervals_without_a_start_count_with_the_last_of_their_group(spark, tmp_path):
    rows = [(1, 1, 5.0), (1, 2, 20.0), (1, 3, None), (2, 1, None), (2, 2, None), (3, 1, 9.0), (3, None, 9.0), (3, 2, None), (3, 3, 1.0), (None, 1, 30.0), (None, 2, None), (None, 3, 2.0)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_quantity double").repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = {(1, 5.0, 8.0, 1), (1, 20.0, 23.0, 2), (2, None, None, 2), (3, 1.0, 4.0, 1), (3, 9.0, 12.0, 3), (None, 2.0, 5.0, 1), (None, 30.0, 33.0, 2)}
    assert set(c.sql(relational.SQL["rule_merge"]).fetchall()) == want
    mine = relational.rule_merge(spark, str(tmp_path)).select("l_orderkey", "start", "end", "n").collect()
    assert len(mine) == len(want) and set(map(tuple, mine)) == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "n_blocks", "markdown"] and df.count() == 200


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
