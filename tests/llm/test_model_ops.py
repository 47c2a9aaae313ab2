from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewell.llm import quality, vectors, warc

# --- quality -------------------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    fit, held = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    judged = {r.doc_id: r.kept for r in quality.classify(docs, fit).collect()}
    rows = held.collect()
    assert np.mean([judged[r.doc_id] == bool(r.quality) for r in rows]) > 0.95
    assert np.mean([judged[r.doc_id] for r in rows if r.quality]) > 0.98


@pytest.mark.parametrize("table", ["odd", "none"])
def test_quality_of_odd_rows(request, spark, table):
    df = request.getfixturevalue(table)
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.classify(df, no_labels).collect()
    assert Counter(r.doc_id for r in out) == Counter(r["doc_id"] for r in df.collect()) and all(r.kept for r in out)
    labels = spark.createDataFrame([(1, 1), (1, 0), (9, 0), (11, None), (None, 1), (4, 1)], "doc_id long, quality int").withColumn("source", F.lit(3))
    out = quality.classify(df, labels).collect()
    assert len(out) == df.count() and all(0 <= r.p_quality <= 1 for r in out)


def test_sparse_places_shrink_to_their_parent(spark):
    """Posteriors are the beta-binomial ones: a large junk host stays low, a tiny host stays near all."""
    rows, labels = [], []
    for i in range(600):
        junk = i % 10 == 0 or i < 200
        host = "junk" if i < 200 else "good"
        rows.append((i, "LOUD!! WORDS!! HERE!! AGAIN!!" if junk else "some calm words stand here in a row", "en", host))
        labels.append((i, 0 if junk else 1))
    rows.append((600, "some calm words stand here in a row", "en", "tiny"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r.doc_id: r for r in quality.classify(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    mean = sum(r.p_document for r in out.values()) / len(out)
    assert out[0].p_host < 0.2 < 0.8 < out[300].p_host
    assert abs(out[600].p_host - mean) < abs(1 - mean)
    assert not out[5].kept and out[301].kept and out[600].kept


def test_toxicity_on_held_out_labels(spark):
    base = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{base}/labels.parquet")
    docs = spark.read.parquet(f"{base}/documents.parquet").join(labels.select("doc_id"), "doc_id")
    judged = {r.doc_id: r for r in quality.classify(docs, labels.filter("doc_id % 2 = 0")).collect()}
    held = labels.filter("doc_id % 2 = 1").collect()
    assert np.mean([judged[r.doc_id].toxic for r in held if r.toxic]) > 0.6
    assert np.mean([judged[r.doc_id].toxic for r in held if not r.toxic]) < 0.01
    assert np.mean([judged[r.doc_id].kept == bool(r.quality) for r in held]) > 0.99


def strength(groups):
    """``kappa`` of (sum, number, parent) groups by the method of moments."""
    total = sum(n for _, n, _ in groups)
    spread = sum(n * (s / n - m) ** 2 for s, n, m in groups) / total
    noise, inner = sum(m * (1 - m) for *_, m in groups) / total, sum(n * m * (1 - m) for _, n, m in groups) / total
    return max(min(inner / (spread - noise) - 1, 1e6), 1.0) if spread - noise > 1e-9 else 1e6


def brute_posteriors(rows, prior):
    hosts, paths = {}, {}
    for h, q, p in rows:
        for d, k in ((hosts, h), (paths, (h, q))):
            s, n = d.get(k, (0.0, 0))
            d[k] = s + p, n + 1
    mean = sum(p for *_, p in rows) / len(rows)
    k = strength([(s, n, mean) for s, n in hosts.values()])
    whole = {h: (s + k * mean) / (n + k) for h, (s, n) in hosts.items()}
    m = strength([(s, n, whole[h]) for (h, _), (s, n) in paths.items()])
    logit = lambda x: math.log(min(max(x, 1e-6), 1 - 1e-6) / (1 - min(max(x, 1e-6), 1 - 1e-6)))
    out = []
    for h, q, p in rows:
        a = (hosts[h][0] - p + k * mean) / (hosts[h][1] - 1 + k)
        b = (paths[h, q][0] - p + m * a) / (paths[h, q][1] - 1 + m)
        out.append((a, b, 1 / (1 + math.exp(-(logit(p) + logit(b) - logit(prior))))))
    return out


def test_place_posteriors_are_brute_force_and_sql(spark):
    import duckdb

    rng = np.random.default_rng(8)
    rows = [(i, h, q, float(x)) for i, (h, q) in enumerate([(f"h{i % 7}" if i % 11 else None, f"p{i % 3}" if i % 5 else None) for i in range(300)] + [("one", "only")]) for x in [np.clip(rng.normal(0.3 + 0.08 * (i % 7) + 0.1 * (i % 3), 0.2), 0, 1)]]
    df = spark.createDataFrame(rows, "no long, host string, path string, p double")
    found = {r.no: (r.p_host, r.p_path, r.p_both) for r in quality.place_posteriors(df, "p", 0.6).collect()}
    want = brute_posteriors([r[1:] for r in rows], 0.6)
    assert all(abs(a - b) < 1e-9 for i, w in enumerate(want) for a, b in zip(found[i], w, strict=True)) and len(found) == len(rows)
    con = duckdb.connect()
    con.execute("CREATE TABLE scored (no BIGINT, host VARCHAR, path VARCHAR, p DOUBLE)")
    con.executemany("INSERT INTO scored VALUES (?, ?, ?, ?)", rows)
    kappa = lambda s, n, m: f"""CASE WHEN sum({n} * ({s} / {n} - {m}) ^ 2) / sum({n}) - sum({m} * (1 - {m})) / sum({n}) > 1e-9
      THEN greatest(least(sum({n} * {m} * (1 - {m})) / sum({n}) / (sum({n} * ({s} / {n} - {m}) ^ 2) / sum({n}) - sum({m} * (1 - {m})) / sum({n})) - 1, 1e6), 1.0) ELSE 1e6 END"""  # noqa: E731
    sql = f"""WITH m AS (SELECT avg(p) AS mean FROM scored), h AS (SELECT host, sum(p) AS hs, count(*) AS hn FROM scored GROUP BY 1), q AS (SELECT host, path, sum(p) AS s, count(*) AS n FROM scored GROUP BY 1, 2),
    a AS (SELECT any_value(mean) AS mean, {kappa("hs", "hn", "mean")} AS k FROM h, m), g AS (SELECT h.*, a.*, (hs + k * mean) / (hn + k) AS hp FROM h, a),
    b AS (SELECT {kappa("s", "n", "hp")} AS l FROM q JOIN g ON q.host IS NOT DISTINCT FROM g.host),
    x AS (SELECT no, p, (hs - p + k * mean) / (hn - 1 + k) AS p_host, s, n, l FROM scored c JOIN g ON c.host IS NOT DISTINCT FROM g.host JOIN q ON c.host IS NOT DISTINCT FROM q.host AND c.path IS NOT DISTINCT FROM q.path, b)
    SELECT no, p_host, (s - p + l * p_host) / (n - 1 + l) FROM x"""
    assert all(abs(found[no][0] - a) < 1e-9 and abs(found[no][1] - b) < 1e-9 for no, a, b in con.execute(sql).fetchall())


def test_evidence_of_texts_does_not_depend_on_their_neighbours():
    import pyarrow as pa

    from casewell.llm import evidence
    from casewell.llm.shingles import chunks

    texts = ["LOUD!! LOUD!! words", "", None, "a b", "é", "ab", "x " * 700_000, "calm words stand here"]
    whole = [evidence.features(at, raw) for *_, at, raw in chunks(pa.array(texts, pa.string()).fill_null(""))]
    alone = [evidence.features(at, raw) for t in texts for *_, at, raw in chunks(pa.array([t or ""], pa.string()))]
    assert np.allclose(np.concatenate([s for *_, s in whole]), np.concatenate([s for *_, s in alone]))
    assert [b.tolist() for o, b, s in whole for b in np.split(b, np.searchsorted(o, np.arange(1, len(s))))] == [b.tolist() for _, b, _ in alone]


# --- nearest neighbours --------------------------------------------------------------------------


def brute_nearest(rows, asks, k=10):
    good = {}
    for i, v in rows:
        if i is None or v is None or not v or any(c is None or not math.isfinite(c) for c in v) or not any(v):
            continue
        good[i] = min(good[i], v) if i in good else v
    dim = Counter(len(v) for v in good.values()).most_common(1)[0][0] if good else 0
    good = {i: np.array(v, np.float32).astype(float) for i, v in good.items() if len(v) == dim}
    out = {}
    for q in good:
        if asks(q):
            d = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q)
            out[q] = d[:k]
    return out


def test_few_odd_vectors_are_brute_force(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]),
        (9, [1.0, 0.1]), (10, [5.0, 5.0]), (10, [5.0, 5.0]), (None, [1.0, 1.0]), (100, [1.0, 0.05]), (200, [0.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("leaf", F.lit("x")).withColumn("vec", F.lit(1))
    found = {}
    for r in vectors.nearest_neighbours(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
    want = brute_nearest(rows, lambda i: i % 100 == 0)
    assert {q: [i for _, i in v] for q, v in found.items()} == {q: [i for _, i in v] for q, v in want.items()}
    assert all(abs(a - b) < 1e-12 for q in want for (a, _), (b, _) in zip(found[q], want[q], strict=True))
    assert vectors.nearest_neighbours(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert vectors.nearest_neighbours(df, F.col("vec_id") < 0).count() == 0


def test_recall_with_a_hot_vector(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[rng.random(3000) < 0.33] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute_nearest(rows, lambda i: i % 100 == 0)
    found = {}
    for r in vectors.nearest_neighbours(df, F.col("vec_id") % 100 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(found) == set(want)
    assert np.mean([len(found[q] & {i for _, i in want[q]}) / 10 for q in want]) >= 0.9
    hot = [q for q in want if np.array_equal(x[q], x[0])]
    assert hot and all(found[q] == {i for _, i in want[q]} for q in hot)


def test_deep_trees_have_small_cells_and_the_calibrated_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 8)) * 3
    x = (centres[rng.integers(40, size=6000)] + rng.normal(size=(6000, 8))).astype(np.float32)
    x[:1500] = x[0]
    rows = [(i, v.tolist(), i % 100 == 0) for i, v in enumerate(rng.permutation(x))]
    df = spark.createDataFrame(rows, "vec_id long, vec array<float>, asks boolean")
    index = vectors.Index(df, 6000, 8, 160, 4)
    sizes = sorted((r.n for r in index.filed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    assert sum(sizes) == 6000 and index.trees is not None and sizes[0] >= 1500 and sizes[1] <= 64
    want = brute_nearest([r[:2] for r in rows], lambda i: i % 100 == 0)
    found = {}
    for r in vectors.nearest_neighbours(df, F.col("asks"), vec_col="vec", sample=160, leaf_rows=4).collect():
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert all(sorted(v) == sorted(v, key=lambda p: p) and len(v) == 10 for v in found.values())
    assert np.mean([sum(s <= want[q][-1][0] + 1e-9 for s, _ in found[q]) / 10 for q in want]) >= 0.9


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute_nearest(rows, lambda i: i % 100 == 0)
    found = {}
    for r in vectors.nearest_neighbours(df, F.col("vec_id") % 100 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    recall = np.mean([len(found[q] & {i for _, i in want[q]}) / len(want[q]) for q in want])
    print(f"recall of {len(want)} queries over {len(rows)} vectors: {recall:.3f}")
    assert set(found) == set(want) and recall >= 0.9


def test_best_bin_first_takes_every_leaf_once():
    x = np.random.default_rng(2).normal(size=(500, 4))
    tree = vectors.Tree(x, 20)
    leaves = {i for i, n in enumerate(tree.count) if not n}
    order = [leaf for leaf, _ in tree.visits(x[3])]
    assert set(order) == leaves and len(order) == len(leaves) and set(tree.leaf_of(x)) <= leaves
    assert [leaf for leaf, _ in tree.visits(x[3], 3)] == order[:3]


# --- revisits ------------------------------------------------------------------------------------

FIELDS = "record_id long, kind string, url string, ts long, etag string, last_modified string, headers map<string,string>, digest string"


def test_revisits(spark):
    rows = [
        (1, "response", "http://www.A.com/x/?b=2&a=1#f", 10, '"v1"', "d1", {"ETag": '"v1"', "Content-Type": "t", "Date": "10"}, "D1"),
        (2, "revisit", "https://a.com/x?a=1&b=2&utm_source=q", 20, 'W/"v1"', None, {"Date": "20", "Content-Type": "no", "Set-Cookie": "no"}, None),
        (3, "revisit", "http://a.com/x?a=1&b=2", 10, '"v1"', None, {}, None),  # not earlier
        (4, "response", "http://a.com/x?a=1&b=2", 30, '"v2"', "d2", None, "D2"),
        (5, "revisit", "http://a.com/x?a=1&b=2", 31, '"v1"', None, {}, None),  # validator differs
        (6, "revisit", "http://a.com/x?a=1&b=2", 32, None, "d2", {}, None),
        (7, "revisit", "http://a.com/x?a=1&b=2", 33, None, None, {}, None),
        (8, "revisit", "http://b.com/", 33, None, None, {}, None),
        (9, "revisit", None, 33, None, None, {}, None),
        (10, "revisit", "http://a.com/x?a=1&b=2", None, None, None, {}, None),
        (11, None, "http://a.com/x?a=1&b=2", 50, None, None, {}, None),
        (12, "response", "http://c.com:80/", 1, None, None, {}, "D12"),
        (12, "response", "http://c.com:80/", 1, None, None, {}, "D12"),
        (13, "revisit", "http://c.com", 2, None, None, None, None),
    ]
    for slice_rows in (1, 2, 10_000):
        found = {}
        for r in warc.resolve_revisits(spark.createDataFrame(rows, FIELDS).withColumn("slice", F.lit(1)), slice_rows).collect():
            found.setdefault(r.record_id, []).append((r.state, r.resolved_id, r.resolved_digest))
        assert found[1] == [("response", 1, "D1")] and found[2] == [("resolved", 1, "D1")] and found[3] == [("orphan", None, None)]
        assert found[5] == [("conflict", None, None)] and found[6] == [("resolved", 4, "D2")] and found[7] == [("unchecked", 4, "D2")]
        assert all(found[i] == [("orphan", None, None)] for i in (8, 9, 10, 11))
        assert found[12] == [("response", 12, "D12")] * 2 and found[13] == [("unchecked", 12, "D12")]
        assert sum(map(len, found.values())) == len(rows)
    merged = warc.resolve_revisits(spark.createDataFrame(rows, FIELDS)).filter("record_id = 2").first().resolved_headers
    assert merged == {"content-type": "t", "date": "20", "etag": '"v1"'}
    assert warc.resolve_revisits(spark.createDataFrame([], FIELDS)).count() == 0


def test_headers_that_differ_in_case_are_one(spark):
    rows = [
        (1, "response", "http://a.com/", 1, None, None, {"ETag": "x", "etag": "y", "VIA": None, "via": "v", "Set-Cookie": "c"}, "D1"),
        (2, "revisit", "http://a.com/", 2, None, None, {"Date": None, "DATE": "2", "date": "3", "eTag": None, "EXPIRES": "", "X-Own": "no"}, None),
    ]
    found = {r.record_id: r.resolved_headers for r in warc.resolve_revisits(spark.createDataFrame(rows, FIELDS)).collect()}
    assert found[1] == {"etag": "x", "via": "v", "set-cookie": "c"}
    assert found[2] == {"etag": "x", "via": "v", "set-cookie": "c", "date": "2", "expires": ""}


def test_responses_without_an_id_answer(spark):
    rows = [
        (None, "response", "http://a.com/", 1, '"v"', None, None, "D"),
        (2, "revisit", "http://a.com/", 2, '"v"', None, None, None),
        (3, "response", "http://a.com/", 3, None, None, {"b": "2"}, "E"),
        (3, "response", "http://a.com/", 3, None, None, {"a": "1"}, "D"),
        (4, "revisit", "http://a.com/", 4, None, None, None, None),
    ]
    found = {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(rows, FIELDS)).collect()}
    assert (found[2].state, found[2].resolved_id, found[2].resolved_digest) == ("resolved", None, "D")
    assert (found[4].state, found[4].resolved_id, found[4].resolved_digest, found[4].resolved_headers) == ("unchecked", 3, "D", {"a": "1"})


def test_canonical_urls(spark):
    same = [("http://a.com/x?ref=main", "http://a.com/x?ref=main#f"), ("HTTP://www.A.com:80/x/", "https://a.com:443/x"), ("http://a.com/?utm_source=1&b&a", "http://a.com?a&b&GCLID=2")]
    other = [("http://a.com/x?ref=main", "http://a.com/x?ref=branch"), ("http://a.com/?sid=1", "http://a.com/?sid=2"), ("http://a.com:443/", "https://a.com:443/"), ("http://a.com/X", "http://a.com/x")]
    df = spark.createDataFrame(same + other, "a string, b string").select(warc.canonical_url(F.col("a")).alias("a"), warc.canonical_url(F.col("b")).alias("b"))
    assert [r.a == r.b for r in df.collect()] == [True] * len(same) + [False] * len(other)


def test_revisits_of_a_hot_url_are_brute_force(spark):
    import random

    r = random.Random(4)
    rows = [(i, "response" if r.random() < 0.1 else "revisit", "http://h/" if r.random() < 0.7 else f"http://h/{r.randrange(5)}", r.randrange(500), None, None, {}, f"D{i}") for i in range(800)]
    found = {x.record_id: x.resolved_id for x in warc.resolve_revisits(spark.createDataFrame(rows, FIELDS), 50).collect()}
    for i, kind, url, ts, *_ in rows:
        best = max(((t, j) for j, k, u, t, *_ in rows if k == "response" and u == url and t < ts), default=(None, None))[1]
        assert found[i] == (i if kind == "response" else best)
