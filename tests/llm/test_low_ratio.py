"""Line dedup of a host of many pages."""

from casewell.llm.queries import QUERIES


def test_line_of_a_large_host_goes(spark, tmp_path):
    rows = [(i, f"own {i}" + ("\nshared" if i % 11 == 0 else "") + ("\nfew" if i < 4 else ""), "big") for i in range(500)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    dropped = {r.doc_id: r.n_dropped for r in QUERIES["op7_line_dedup"](spark, str(tmp_path)).collect()}
    assert dropped == {i: int(i % 11 == 0) for i in range(500)}


def test_all_pages_of_a_small_host_are_enough(spark):
    from casewell.llm import line_dedup

    rows = [(f"{h}{i}", f"own {h} {i}\nshared", h) for h, n in (("one", 1), ("two", 2), ("four", 4), ("six", 6)) for i in range(n)] + [("x", "own x", "four")]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string")
    found = {r.doc_id: r.n_dropped for r in line_dedup.drop_boilerplate(df).collect()}
    assert {h: {found[f"{h}{i}"] for i in range(n)} for h, n in (("one", 1), ("two", 2), ("four", 4), ("six", 6))} == {"one": {0}, "two": {1}, "four": {0}, "six": {1}}
