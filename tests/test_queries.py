"""Each registered query of the engine against its SQL in DuckDB."""

import duckdb
import pytest

from lexitally.plans.queries import ORACLES, QUERIES
from lexitally.streaming.word_stream import streaming_word_counts
from lexitally.operators.counting import word_counts

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", QUERIES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    result = con.execute(ORACLES[name])
    assert [c[0] for c in result.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(result.fetchall())


def test_stream(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/documents.parquet").select("text")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streaming_word_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counted").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, word_counts(batch).collect()))



@pytest.mark.parametrize("name", ["top_words", "corpus_summary", "word_counts"])
def test_one_scan(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "ReadSchema: struct<text:string>" in plan
