from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from casewell.llm import exact_dedup, near_dedup
from casewell.llm.common import Sieve, drop_keys
from casewell.llm.shingles import chunks, shingles
from pyspark.sql import functions as F


def test_sieve_never_misses(spark):
    keys = spark.range(0, 1000, 7).withColumnRenamed("id", "k")
    marked = Sieve(keys, ["k"]).mark(spark.range(1000), [F.col("id")], "maybe").filter("maybe")
    found = {r.id for r in marked.collect()}
    assert set(range(0, 1000, 7)) <= found and len(found) < 400
    rest = drop_keys(spark.range(1000), keys, {"k": F.col("id")})
    assert sorted(r.id for r in rest.collect()) == [i for i in range(1000) if i % 7]
    assert Sieve(keys.limit(0), ["k"]).mark(spark.range(9), [F.col("id")], "maybe").filter("maybe").count() == 0


def test_a_large_sieve_lets_few_strangers_pass(spark):
    sieve = Sieve(spark.range(10_000_000), ["id"])
    assert sieve.blocks * sieve.BLOCK / 8 <= 16 << 20
    asked = sieve.mark(spark.range(9_900_000, 10_400_000), [F.col("id")], "maybe").groupBy(F.col("id") < 10_000_000).agg(F.avg(F.col("maybe").cast("int")))
    share = {bool(known): x for known, x in asked.collect()}
    assert share[True] == 1 and share[False] < 0.02


def test_strangers_that_pass_a_sieve_stay(spark, monkeypatch):
    monkeypatch.setattr(Sieve, "MOST_BLOCKS", 1)
    gone = spark.range(0, 60_000, 2).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("n"))
    docs = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, F.col("id")).alias("n"), F.lit("x").alias("k"), F.lit(1).alias("__maybe"))
    rest = drop_keys(docs, gone, {"k": F.col("id"), "n": F.col("n")})
    assert rest.columns == docs.columns and sorted(r.id for r in rest.select("id").collect()) == list(range(1, 60_000, 2))


def brute_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["text"] or ""].append(r["doc_id"])
    low = lambda i: -1 if i is None else i
    return Counter((r["doc_id"], max(groups[r["text"] or ""], key=low), len(groups[r["text"] or ""])) for r in rows)


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_exact_dedup_is_brute_force(request, table):
    df = request.getfixturevalue(table)
    found = exact_dedup.progressive_dedup(df).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in found) == brute_exact(df.collect())
    assert sum(r.kept for r in found) == len({r["text"] or "" for r in df.collect()})


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_drop_copies(request, table):
    df = request.getfixturevalue(table)
    out = exact_dedup.drop_copies(df)
    assert out.columns == df.columns
    rows = out.collect()
    texts = [r["text"] or "" for r in rows]
    assert len(texts) == len(set(texts)) == len({r["text"] or "" for r in df.collect()})
    best = {r["text"] or "": -1 for r in df.collect()}
    for r in df.collect():
        best[r["text"] or ""] = max(best[r["text"] or ""], -1 if r["doc_id"] is None else r["doc_id"])
    assert all((-1 if r["doc_id"] is None else r["doc_id"]) == best[r["text"] or ""] for r in rows)


def test_same_length_and_prefix_are_not_equal(spark):
    a = "p" * 100
    df = spark.createDataFrame([(1, a + "x"), (2, a + "y"), (3, a + "x"), (4, a)], "doc_id long, text string")
    assert {r.doc_id: r.keep_id for r in exact_dedup.progressive_dedup(df).collect()} == {1: 3, 2: 2, 3: 3, 4: 4}


# --- near duplicates -----------------------------------------------------------------------------


def test_shingles_are_those_of_the_words():
    texts = ["a b c d e f", "A  b\nc d e f", "one two", "", None, " x ", "a b c d e f a b c d e f", "é ü"]
    parts = [shingles(at, raw) for _, _, at, raw in chunks(pa.array(texts, pa.string()).fill_null(""))]
    h, tf, cuts = parts[0]
    sets = [Counter(dict(zip(h[s:e].tolist(), tf[s:e].tolist(), strict=True))) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
    assert [len(s) for s in sets] == [2, 2, 1, 0, 0, 1, 6, 1]
    assert sets[0] == sets[1] and set(sets[0]) <= set(sets[6]) and max(sets[6].values()) == 2
    sliced = pa.array(["zzz", *texts], pa.string()).fill_null("").slice(1)
    again = next(iter(chunks(sliced)))
    assert np.array_equal(shingles(again[2], again[3])[0], h)


def weighted(rows):
    sets = []
    for r in rows:
        w = "".join(c.lower() if c < "\x80" else c for c in r["text"] or "")
        w = [x for x in w.translate({i: 32 for i in (9, 10, 11, 12, 13)}).split(" ") if x]
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    df, n = Counter(k for s in sets for k in s), len(rows)
    least = max(1.0, near_dedup.RARE * sum(map(len, sets)))
    idf = lambda k: (2 + math.log(n / max(df[k], least))) / (2 + math.log(n / least))
    return [{k: (1 + math.log(c)) * idf(k) for k, c in s.items()} for s in sets]


def jaccard(a, b):
    shared = sum(min(a[k], b[k]) for k in a.keys() & b.keys())
    return shared / (sum(a.values()) + sum(b.values()) - shared) if a and b else 0.0


def brute_near(rows, least=0.8):
    sets = weighted(rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for k in s:
            by[k].append(i)
    for i, j in {(a, b) for v in by.values() for x, a in enumerate(v) for b in v[x + 1 :]}:
        if rows[i]["doc_id"] is not None and rows[j]["doc_id"] is not None and jaccard(sets[i], sets[j]) >= least:
            root[find(i)] = find(j)
    classes = defaultdict(list)
    for i in range(len(rows)):
        classes[find(i)].append(rows[i]["doc_id"])
    return Counter((rows[i]["doc_id"], min((x for x in classes[find(i)] if x is not None), default=None), len(classes[find(i)])) for i in range(len(rows)))


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_near_duplicates_are_brute_force(request, table):
    df = request.getfixturevalue(table)
    found = near_dedup.near_duplicates(df).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in found) == brute_near(df.collect())


def test_a_fuzzy_ball_loses_no_link(spark):
    """A large group of copies with edits of many sizes: links of middling pairs, bridges, shared edits."""
    import random

    from .conftest import words

    r = random.Random(5)
    base = words(120, 99).split()
    rows = []
    for i in range(150):
        w = list(rows[r.randrange(i)][1].split() if i and r.random() < 0.4 else base)
        for _ in range(r.randrange(0, 7)):
            w[r.randrange(len(w))] = words(1, 1000 + r.randrange(400))
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter((x.doc_id, x.class_id, x.class_size) for x in near_dedup.near_duplicates(df).collect())
    assert found == brute_near(df.collect())


def test_a_thousand_copies_are_brute_force(spark):
    """A cluster of 1,000 near copies among other texts: all idf are exact, pairs by matrices."""
    import random

    from .conftest import words

    r = random.Random(9)
    base, rows = words(80, 77).split(), []
    for i in range(1000):
        w = list(base)
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(len(w))] = words(1, 5000 + r.randrange(3000))
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, words(60, 9000 + i) + " " + " ".join(base[:20])) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = weighted(df.collect())
    number = {k: i for i, k in enumerate(sorted({k for s in sets for k in s}))}
    x = np.zeros((len(sets), len(number)), np.float32)
    for i, s in enumerate(sets):
        for k, v in s.items():
            x[i, number[k]] = v
    total, root = x.sum(1), list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets) - 1):
        shared = np.minimum(x[i], x[i + 1 :]).sum(1)
        for j in np.flatnonzero(shared >= 0.8 * (total[i] + total[i + 1 :] - shared)) + i + 1:
            root[find(i)] = find(j)
    least = {}
    for i in range(len(sets)):
        least.setdefault(find(i), i)
    found = {x.doc_id: x.class_id for x in near_dedup.near_duplicates(df).collect()}
    assert found == {i: least[find(i)] for i in range(len(sets))}


def test_frequencies_are_exact_over_runs_and_tasks(spark, monkeypatch):
    docs = [(" ".join(f"w{j % (3 + i % 40)}" for j in range(30)) + (f" own{i} a b c d" if i % 2 else " every text has these five words"),) for i in range(600)]
    df = spark.createDataFrame(docs, "text string").repartition(5)
    monkeypatch.setattr(near_dedup, "RUN", 500)
    monkeypatch.setattr(near_dedup, "RARE", 4 / 500)
    want = Counter()
    for (t,) in docs:
        *_, at, raw = next(chunks(pa.array([t])))
        want.update(shingles(at, raw)[0].tolist())
    least, h, n = near_dedup._document_frequency(df, 3_000 * 5)
    assert least == 4 / 500 * sum(want.values())
    assert dict(zip(h.tolist(), n.tolist(), strict=True)) == {k: c for k, c in want.items() if c >= least} and len(h)


def test_nodes_that_share_a_number_are_told_apart(spark):
    rows = [(1, 10, 5, 1), (2, 20, 5, 2), (3, 10, 5, 1), (4, 30, 7, 3), (5, 0, 0, 0), (None, 40, 7, 9)]
    out, nodes = near_dedup._nodes(spark.createDataFrame(rows, "doc_id long, text_hash long, node long, check long"))
    by = {r.doc_id: r.node for r in out.collect()}
    assert by[1] == by[3] != by[2] and by[4] == 7 and by[5] == 0
    assert Counter((r.doc_id, r.n) for r in nodes.collect()) == Counter([(1, 2), (2, 1), (4, 1)])


def test_samples_agree_as_often_as_texts_are_similar():
    """The estimator is unbiased: equal samples over all samples are near the weighted Jaccard."""
    rng = np.random.default_rng(3)
    h = np.sort(rng.choice(1 << 47, 300, replace=False).astype(np.uint64))
    wa, wb = rng.uniform(0.3, 2, 300), rng.uniform(0.3, 2, 300)
    q = near_dedup._gamma_quantiles()
    tables = (q.astype(np.float32), np.log(q).astype(np.float32))
    cuts = np.array([0, 300])
    a, b = (near_dedup.consistent_samples(h, np.log(w), cuts, 4000, tables)[:, 0] for w in (wa, wb))
    truth = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((a == b).mean() - truth) < 0.03
