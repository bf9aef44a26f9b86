from tidemark.streaming.snapshots import current, maintain


def test_upserts_by_batch(spark, tmp_path):
    schema = "k string, v int, at int"
    source, table = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([("a", 1, 1), ("a", 2, 2), ("b", 1, 1)], [("a", 3, 3), ("c", 1, 3)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        maintain(stream, table, ["k"], "at", str(tmp_path / "cp")).awaitTermination()
    assert sorted((r["k"], r["v"]) for r in current(spark, table).collect()) == [("a", 3), ("b", 1), ("c", 1)]
    assert sorted((r["k"], r["v"]) for r in current(spark, table, before=1).collect()) == [("a", 2), ("b", 1)]
    untouched = spark.read.parquet(table).where("k = 'b'").select("tm_batch").collect()
    assert [r[0] for r in untouched] == [0] or len(untouched) == 2
