"""The count of links names what it counts."""

from casewell.llm import near_dedup


def test_only_compared_links_are_counted(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven"), (2, "one two three four five six seven"), (3, "other words")], "doc_id long, text string")
    out = near_dedup.near_duplicates(docs)
    assert "n_compared_links" in out.columns and "n_links" not in out.columns
