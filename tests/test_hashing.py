from pyspark.sql import functions as F

from statforge.functions.hashing import SPAN, drawn, drawn_number, drawn_sql


def test_spark_python_and_sql_draw_alike(spark):
    import duckdb

    got = [r[0] for r in spark.range(50).select(drawn(7, F.col("id"), 3)).collect()]
    assert got == [drawn_number(7, i, 3) for i in range(50)]
    assert got == [r[0] for r in duckdb.sql(f"select {drawn_sql(7, 'k', 3)} from range(50) t(k)").fetchall()]
    assert all(0 <= v < SPAN for v in got) and len(set(got)) == 50
