"""Prefix trie, importance resampling and SimHash against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from casewell.llm import bktree, prefix_trie, queries, resampling, simhash

from .conftest import LONG


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is None, x) for x in r))


# ---- prefix trie


def plain_trie(rows, every=5, most=9):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append(((turn is not None, turn), role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), text))
    own = {c: [(r, t) for _, r, _, t in sorted(x, key=lambda y: (y[0][0], y[0][1] or 0, y[1], y[2]))] for c, x in turns.items()}
    whole = {c: own.get(c - c % every, [])[: (h := zlib.crc32(str(c).encode()) % most)] + x[h:] for c, x in own.items()}
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    out = []
    for node, who in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[:-1] == n for m in members if m)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = ",".join(str(c) for c in who if len(whole[c]) == len(node))
        out.append((who[0], len(node), members[node[:-1]][0] if node else None, len(who), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: tuple((x is None, x) for x in r))


TURNS = "conv_id long, turn long, role string, text string"


def random_turns(seed, convs=60):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "bot"]), r.choice(["yes", "no", "é漢", ""])) for c in r.sample(range(200), convs) for t in range(r.choice([1, 2, 3, 5, 11]))]


@pytest.mark.parametrize("seed", [1])
def test_trie_equals_plain(spark, seed):
    rows = random_turns(seed)
    assert rows_of(prefix_trie.trie(spark.createDataFrame(rows, TURNS))) == plain_trie(rows)


@pytest.mark.parametrize("bits", [2])
def test_trie_splits_collisions(spark, bits):
    rows = random_turns(3, 40)
    assert rows_of(prefix_trie.trie(spark.createDataFrame(rows, TURNS), bits=bits)) == plain_trie(rows)


def test_trie_of_conversations_over_segments_and_ranges(spark):
    r = random.Random(5)
    first = [("user", r.choice("ab")) for _ in range(70)]
    rows = [(c, t, *first[t]) for c in (0, 1, 2, 7) for t in range(70 - c)] + [(9, t, *((first[t]) if t < 40 else ("bot", "z"))) for t in range(50)]
    frame = spark.createDataFrame(rows, TURNS).repartition(3)
    assert rows_of(prefix_trie.trie(frame, segment=4, range_rows=25)) == plain_trie(rows)


def test_trie_of_odd_rows(spark):
    rows = [(0, None, None, None), (0, 0, "user", LONG), (0, 0, "user", LONG), (0, 0, "bot", ""), (5, 3, "user", "x"), (5, 3, None, "x"), (None, 1, "user", "lost"), (6, 0, "user", "x"), (6, 0, "user", "x"), (3, 1, None, None), (-1, 0, "user", "minus")]
    frame = spark.createDataFrame([(*r, 1, "n", 2) for r in rows], TURNS + ", depth long, node string, fp long")
    plain = [r for r in rows if r[0] != -1]
    assert rows_of(prefix_trie.trie(frame.filter("conv_id is null or conv_id >= 0"))) == plain_trie(plain)
    assert prefix_trie.trie(frame).count() > 0
    assert rows_of(prefix_trie.trie(frame.limit(0))) == []


def test_trie_of_conversations_without_turns(spark):
    # conversation 1 takes all of its turns from 0, which is absent: it ends at the root
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    rows = [(c, 0, "user", "a"), (c, 1, "bot", "b")]
    got = rows_of(prefix_trie.trie(spark.createDataFrame(rows, TURNS)))
    assert got == plain_trie(rows) and len(got) == 1 and got[0][:2] == (c, 0)


def test_rolling_sums_are_modular(spark):
    big = [(1 << 63) - 1, -(1 << 63), -1, 5, 0x7FFFFFFFFFFFFFF1]
    pairs = [(a, b) for a in big for b in big]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", prefix_trie.wrapped_sum(prefix_trie.F.col("a"), prefix_trie.F.col("b")).alias("s")).collect()
    assert all((r.a + r.b - r.s) % (1 << 64) == 0 for r in got)
    powers = prefix_trie._powers(np.array([0, 1, 2, 5, 1000]))
    assert [int(p) for p in powers] == [pow(prefix_trie.BASE, e, 1 << 64) for e in (0, 1, 2, 5, 1000)]


# ---- importance resampling


def plain_resample(docs, bench, longest=1, buckets=10_000, seed=2024, least=20, percent=10):
    def feats(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    ours = [(i, *feats(t)) for i, t in docs]
    s, t = Counter(b for *_, f in ours for b in f), Counter(b for x in bench for b in feats(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, w, f in ours:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    may = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for n, r in enumerate(may[: len(may) * percent // 100], 1):
        r[4] = n
    return sorted([tuple(r[:5]) for r in out], key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize(("longest", "percent", "range_rows"), [(1, 10, 100_000), (3, 37, 7)])
def test_resample_equals_plain(spark, docs, sf, longest, percent, range_rows):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = resampling.resample(docs, bench, longest=longest, percent=percent, range_rows=range_rows)
    want = plain_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()], longest, percent=percent)
    assert rows_of(got) == want


def test_resample_of_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    bench = spark.createDataFrame([("The quick é漢 fox",), (None,)], "text string")
    got = resampling.resample(odd.withColumnRenamed("target", "score"), bench, percent=50, range_rows=2)
    assert rows_of(got) == plain_resample(rows, ["The quick é漢 fox", ""], percent=50)
    assert rows_of(resampling.resample(odd, bench.limit(0))) == plain_resample(rows, [])
    assert rows_of(resampling.resample(none, bench)) == []


def test_gains_are_one_literal_and_nothing_is_exploded_in_scoring(spark, docs):
    some = docs.select("doc_id", resampling.bucket_array(resampling.words(docs["text"])).alias("__buckets"))
    gain = resampling._literal(spark, resampling.gains(some, some), resampling.BUCKETS)
    total = resampling.F.aggregate("__buckets", resampling.F.lit(0).cast("long"), lambda a, b: a + resampling.F.element_at(gain, b + 1))
    plan = some.select("doc_id", total.alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "Generate" not in plan and "Exchange" not in plan


# ---- SimHash and BK-trees


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, radius=2):
    """``rows`` of id and fingerprint."""
    fps = sorted({f for _, f in rows})
    up = {f: f for f in fps}

    def top(f):
        while up[f] != f:
            up[f] = up[up[f]]
            f = up[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                up[top(a)] = top(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[top(f)] = min(least.get(top(f), i), i)
    return sorted([(i, f"{f:016x}", least.get(top(f))) for i, f in rows], key=lambda r: tuple((x is None, x) for x in r))


def test_simhash_equals_plain(spark, sf, docs):
    want = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()])
    assert rows_of(queries.op13_simhash(spark, sf)) == want
    assert len({r[2] for r in want}) < len(want)


@pytest.mark.parametrize("broadcast_nodes", [1 << 20, 0])
def test_simhash_of_odd_rows(odd, none, broadcast_nodes):
    want = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in odd.collect()])
    frame = odd.withColumnRenamed("node", "fp").withColumnRenamed("target", "fingerprint")
    assert rows_of(simhash.link_components(frame, broadcast_nodes=broadcast_nodes)) == want
    assert rows_of(simhash.link_components(none, broadcast_nodes=broadcast_nodes)) == []


def test_fingerprint_of_long_texts_in_pieces(monkeypatch):
    text = " ".join(random.Random(1).choice(["a", "Bé", "cc\t"]) for _ in range(1000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE_WORDS", 7)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text.decode())


def ball(centre, n, bits, seed):
    r = random.Random(seed)
    return {centre ^ sum(1 << b for b in r.sample(range(64), r.randrange(bits + 1))) for _ in range(n)}


@pytest.mark.parametrize(("broadcast_nodes", "most_nodes"), [(1 << 20, 5), (0, 8192)])
def test_links_of_balls_in_shards_of_any_size(spark, monkeypatch, broadcast_nodes, most_nodes):
    r = random.Random(9)
    fps = ball(r.getrandbits(64), 150, 4, 1) | ball(0, 60, 3, 2) | {r.getrandbits(64) for _ in range(100)} | {0, (1 << 64) - 1, (1 << 64) - 2}
    rows = list(enumerate(sorted(fps)))
    frame = spark.createDataFrame([(i, simhash._signed(f)) for i, f in rows], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs)
    got = simhash.link_components(frame, most_nodes=most_nodes, broadcast_nodes=broadcast_nodes)
    assert rows_of(got) == plain_components(rows)


def test_every_pair_within_the_radius_shares_a_shard():
    r = random.Random(4)
    masks = [0]
    for _ in range(5):
        masks = [c for m in masks for c in simhash._cut(m, 3)]
        for _ in range(200):
            a = r.getrandbits(64)
            b = a ^ sum(1 << x for x in r.sample(range(64), r.randrange(3)))
            assert any(a & m == b & m for m in masks)
    assert max(64 - m.bit_count() for m in masks) <= 10  # 1,024 fingerprints at most


@pytest.mark.parametrize("radius", [0, 1, 2, 5])
def test_bk_tree_search_equals_all_distances(radius, monkeypatch):
    r = np.random.default_rng(3)
    values = np.unique(np.concatenate([r.integers(0, 1 << 63, 200, np.uint64), np.uint64(7) << r.integers(0, 60, 60).astype(np.uint64)]))
    r.shuffle(values)
    cuts = np.array([0, 1, 40, len(values)])
    tree, parent, distance = bktree.grow(values, cuts)
    again = bktree.hung(values, parent, distance)
    roots = np.repeat(cuts[:-1], np.diff(cuts))
    monkeypatch.setattr(bktree, "FRONTIER", 50)
    for t in (tree, again):
        q, n = t.within(values, roots, radius)
        want = {(i, j) for a, b in zip(cuts[:-1], cuts[1:], strict=True) for i in range(a, b) for j in range(a, b) if int(values[i] ^ values[j]).bit_count() <= radius}
        assert sorted(zip(q.tolist(), n.tolist(), strict=True)) == sorted(want)
    # children hang at their distance, one at each
    kids = np.flatnonzero(parent != np.arange(len(values)))
    assert (np.bitwise_count(values[kids] ^ values[parent[kids]]) == distance[kids]).all()
    assert len({(int(parent[k]), int(distance[k])) for k in kids}) == len(kids)


def test_links_become_stars():
    a, b = bktree.joined(np.array([5, 3, 9, 20], np.uint64), np.array([3, 9, 1, 21], np.uint64))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(3, 1), (5, 1), (9, 1), (21, 20)]
    assert len(bktree.joined(np.zeros(0, np.uint64), np.zeros(0, np.uint64))[0]) == 0
