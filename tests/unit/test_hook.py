import __spark_entry__

SF = "/root/testdata/sf0.001"


def test_semantic_hook_passes_over_what_has_no_atom(spark, tmp_path):
    """Texts that are blank or missing, and rows without an id, change nothing of what the others give."""
    run = lambda d: sorted(map(tuple, __spark_entry__.queries()["e8_semantic_hook"](spark, d).collect()))
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet").limit(30) for t in ("documents", "benchmark"))
    odd = [(10**6, " \n ", "en", "x", 3), (10**6 + 1, "", "en", "x", 0), (10**6 + 2, None, None, None, None), (None, "A text of nobody.", "en", "x", 17)]
    for name, more, asked in (("plain", [], []), ("odd", odd, [(900, None), (None, "Who asks?")])):
        docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        items.unionByName(spark.createDataFrame(asked, items.schema)).write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    want = run(f"{tmp_path}/plain")
    assert want and run(f"{tmp_path}/odd") == want
