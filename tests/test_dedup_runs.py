"""The registered queries of problem 5 take all deliveries, in four runs."""

from pyspark.sql import functions as F

from tidemark.plans import general

MESSAGES = "delivery_id bigint, range_id bigint, offset bigint, batch_id bigint, timestamp bigint, key binary, payload binary"


def test_every_query_takes_malformed_deliveries_in_four_runs(spark, tmp_path, monkeypatch):
    rows = [(i, i % 2, None if i % 3 == 0 else i // 4, i // 2, 5, b"k", b"p" if i % 6 else b"q") for i in range(16)]
    spark.createDataFrame(rows, MESSAGES).write.parquet(f"{tmp_path}/kafka_message.parquet")
    spark.createDataFrame([(0, "t", 0), (1, "t", 1)], "range_id bigint, topic string, partition int").write.parquet(f"{tmp_path}/consumer_range.parquet")
    runs, once = [], general.dedup.accept_once

    def spy(deliveries, *args, **kwargs):
        run = once(deliveries, *args, **kwargs)
        runs.append((deliveries, run))
        return run

    monkeypatch.setattr(general.dedup, "accept_once", spy)
    for query in (general.p5_found, general.p5_unique):
        runs.clear()
        query(spark, str(tmp_path)).collect()
        assert len(runs) == 4
        assert sum(d.agg(F.sum("copies")).first()[0] for d, _ in runs) == 16
        assert all({"malformed", "ranges"} <= set(vars(run)) for _, run in runs)
