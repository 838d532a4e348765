from engramma.streaming import gate


def test_novelty_beyond_a_block(spark, tmp_path):
    src = str(tmp_path / "obs")
    (tmp_path / "obs").mkdir()
    texts = ["one two three four", "five six seven eight", "red green blue grey", "north south east west", "up down left right", "one two three four", "five six seven eight"]
    schema = "namespace string, seq long, text string"
    q = gate.admit_stream(spark.readStream.schema(schema).json(src), keep=2).writeStream.format("memory").queryName("blocks").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for part in (range(5), range(5, 7)):  # the second micro-batch reads the state back
            spark.createDataFrame([("n", i, texts[i]) for i in part], schema).coalesce(1).write.mode("append").json(src)
            q.processAllAvailable()
    finally:
        q.stop()
    assert {r.seq: r.stored for r in spark.table("blocks").collect()} == {i: i < 5 for i in range(7)}
