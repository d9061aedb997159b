"""Names of several words: the longest match goes first."""

from lodevein.operators.names import named_windows


def test_longest_names_first(spark):
    names = spark.createDataFrame([("Guinea", "GN"), ("Papua New Guinea", "PG"), ("New York", "US"), ("York", "UK"), ("US", "US"), ("New Guinea Coast", "NGC"), ("Congo", "CD"), ("Congo", "CG"), ("", "none"), (None, "none")], "name string, value string")
    rows = [(1, "Univ. of Papua New Guinea, Guinea"), (2, "New  York, York"), (2, "Guinea"), (3, "Yorkshire"), (4, None), (5, ""), (6, "Papua New Guinea Coast"), (7, "(Congo)"), (8, "New\tYork"), (8, "New\tYork"), (None, "York")]
    got = sorted(map(tuple, named_windows(spark.createDataFrame(rows, "id long, text string"), names).collect()))
    assert got == [(1, "GN"), (1, "PG"), (2, "GN"), (2, "UK"), (2, "US"), (6, "PG"), (7, "CD"), (7, "CG"), (8, "US")]
    none = named_windows(spark.createDataFrame(rows, "id long, text string"), names.limit(0))
    assert none.columns == ["id", "value"] and none.collect() == []
