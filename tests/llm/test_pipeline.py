from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from casewell.llm import mixing
from casewell.llm.queries import vocabulary_path

from .test_dedup import brute_near


def test_stages_follow_each_other(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    quality, exact, near, mix, tokens = (f for _, f in corpus_pipeline.STAGES)
    good = quality(spark, docs, sf).persist()
    assert good.columns == columns and 0 < good.count() < docs.count()
    one = exact(spark, good, sf).persist()
    assert one.count() == one.select("text").distinct().count() == good.select("text").distinct().count()
    apart = near(spark, one, sf).persist()
    rows = one.collect()
    classes = {d: c for (d, c, _), n in brute_near(rows).items()}
    assert {r.doc_id for r in apart.collect()} == set(classes.values())
    mixed = mix(spark, apart, sf).persist()
    assert mixed.columns == columns
    words = lambda df: mixing.with_words(df.select("text")).agg(F.sum("size")).first()[0]
    assert abs(words(mixed) - 1.5 * words(apart)) <= apart.select("source").distinct().count()
    out = tokens(spark, mixed, sf).collect()
    assert len(out) == mixed.count() and all(r.exact for r in out)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    want = Counter((r.doc_id, tuple(t.encode(r.text, add_special_tokens=False).ids)) for r in mixed.collect())
    assert Counter((r.doc_id, tuple(np.frombuffer(r.token_ids, "<u4").tolist())) for r in out) == want
    whole = Counter((r.doc_id, tuple(np.frombuffer(r.token_ids, "<u4").tolist())) for r in corpus_pipeline.run(spark, sf).collect())
    assert whole == want


def test_pipeline_of_nothing_and_of_odd_rows(spark, odd, none, tmp_path):
    base = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    for df in (none, odd):
        docs = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, base)
            assert docs.columns == df.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, base).filter("not exact").count() == 0


def test_quality_stage_of_odd_rows(spark, odd, docs, tmp_path):
    """Odd rows among others, with labels of both kinds: rejected and toxic documents go, whatever else."""
    base = f"file://{tmp_path}"
    loud, calm, rude = "BUY!! NOW!! ", "some calm words stand here in a row ", "you idiot and moron "
    rows = [(1000 + i, (loud if i % 3 == 0 else calm + (rude if i % 3 == 1 else "")) * (2 + i % 5), "en", f"s{i % 4}", 50) for i in range(300)]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = odd.unionByName(more, allowMissingColumns=True)
    labels = [(1000 + i, None if i % 50 == 49 else int(i % 3 != 0), int(i % 3 == 1)) for i in range(200)] + [(None, 0, 1), (5, 1, 0), (2, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    out = corpus_pipeline.quality_stage(spark, df, base)
    assert out.columns == df.columns
    left = Counter(r.doc_id for r in out.collect())
    assert {i for i in left if i is not None and i >= 1000} == {1000 + i for i in range(300) if i % 3 == 2}
    assert left[2] in (0, 2)
