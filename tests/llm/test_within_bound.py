"""p1_within_bound sketches names of more than 8192 codes."""

from pyspark.sql import functions as F

from tidemark.llm import queries


def test_hot_names_are_sketched(spark, tmp_path, monkeypatch):
    hot = spark.range(9000).select(F.lit("hot").alias("name"), "id")
    hot.union(spark.range(10).select(F.lit("cold"), "id")).toDF("name", "value").write.parquet(f"{tmp_path}/stream_table.parquet")
    got, percentiles = [], queries.quantiles.percentiles

    def spy(*args, **kwargs):
        got.append(percentiles(*args, **kwargs))
        return got[-1]

    monkeypatch.setattr(queries.quantiles, "percentiles", spy)
    rows = queries.p1_within_bound(spark, str(tmp_path)).collect()
    assert {r.name: (r.n, r.ok_p50, r.ok_p90, r.ok_p99) for r in rows} == {"hot": (9000, True, True, True), "cold": (10, True, True, True)}
    assert {r.name: r.exact for r in got[0].collect()} == {"hot": False, "cold": True}
