import pytest

import __spark_entry__


@pytest.mark.parametrize("name", ["w4_lexical_links", "w4_lexical_links_whole"])
def test_links_are_not_written_twice(spark, name):
    """The result reads the vectors, not a copy of itself, and can be read again."""
    got = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    files = got.inputFiles()
    assert files and "hv" in spark.read.parquet(*files).columns
    assert got.count() == got.count() > 0
