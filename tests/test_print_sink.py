"""The print sink prints every row, bounded or streaming."""

from tidemark.sources.sinks import print_sink


def test_every_row_is_printed(spark, tmp_path, capsys):
    rows = spark.range(45)
    print_sink()(rows)
    assert capsys.readouterr().out.split() == ["id", *map(str, range(45))]
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    query = print_sink()(spark.readStream.schema("id bigint").parquet(f"{tmp_path}/in"))
    query.processAllAvailable()
    query.stop()
    assert set(map(str, range(45))) <= set(capsys.readouterr().out.split())


def test_a_preview_when_asked_for(spark, capfd):
    print_sink(3)(spark.range(45))
    assert "only showing top 3 rows" in capfd.readouterr().out
