from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewell.llm import bpe, line_dedup, mixing, secrets, url_filter
from casewell.llm.lexicon import Lexicon, compile_lexicon
from casewell.llm.queries import vocabulary_path


# --- BPE -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
@pytest.mark.parametrize("words", [0, 200])
def test_bpe_is_the_library(request, tokenizer, table, words):
    df = request.getfixturevalue(table)
    out = bpe.decode(bpe.encode(df.withColumn("t", F.col("text")), vocabulary_path(), carry=("doc_id", "t"), words=words), vocabulary_path()).collect()
    assert len(out) == df.count()
    for r in out:
        ids = tokenizer.encode(r.t or "", add_special_tokens=False).ids
        assert np.frombuffer(r.token_ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded == tokenizer.decode(ids, skip_special_tokens=False) == (r.t or "")


def test_words_and_merges_over_unicode(tokenizer):
    v = bpe.Vocabulary(vocabulary_path())
    cut = bpe._cut(v)
    r = random.Random(2)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    pools = [every, [chr(c) for c in range(0x250)], list("ab '\n\t\x0b\x1c\x85\xa0.,!12")]
    for k in range(3000):
        t = "".join(r.choice(r.choice(pools)) for _ in range(r.randrange(40))) + ("<|endoftext|>" if k % 19 == 0 else "")
        ids = [i for w in cut(t) for i in ([v.special[w]] if w in v.special else np.frombuffer(v.merge_word(w.encode()), "<u4").tolist())]
        assert ids == tokenizer.encode(t, add_special_tokens=False).ids
    for n in (1, 63, 64, 65, 70_000):
        assert np.frombuffer(v.merge_word(b"ab" * n), "<u4").tolist() == tokenizer.encode("ab" * n, add_special_tokens=False).ids


def test_lexicon_is_a_map_and_shares_suffixes(tmp_path):
    r = random.Random(1)
    entries = {"".join(r.choice("abc") for _ in range(r.randrange(1, 9))).encode() + b"tion": bytes([i % 256]) * (i % 5) for i in range(3000)}
    data = compile_lexicon(entries)
    (tmp_path / "x").write_bytes(data)
    lex = Lexicon(str(tmp_path / "x"))
    asked = [*entries, b"", b"zz", b"tion", b"abctio", b"abctionx"]
    assert lex.find(asked) == [entries.get(w) for w in asked]
    assert len(lex.final) < sum(map(len, entries)) / 8
    assert Lexicon.from_bytes(compile_lexicon({})).find([b"a"]) == [None]


# --- secrets -------------------------------------------------------------------------------------

RULES = secrets.BASE_RULES + secrets.MORE_RULES


def brute_spans(text):
    out = []
    for rank, rule in enumerate(RULES):
        for m in re.finditer(rule.regex, text or "", re.ASCII):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), rank, rule.kind, m.end()))
    return tuple(sorted(out))


TRICKY = [
    "secret: token: abcdefgh", "token=token=abcdefgh12", "TOKEN = 'abcdefgh' Api_Key:abcdefghi apikey='x'", "AKIAKIAXXXX AKIA" + "Z" * 12 + " AKIA" + "Z" * 11,
    "é🙂 password=\"12345678\" é", "f" * 31 + " " + "f" * 32 + "g" + "0" * 33, "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a" * 36 + " xoxb-1234567890ab eyJabcdefghij.eyJabcdefghij.abcdefghijk",
    "AIza" + "a" * 35 + " sk_live_" + "b" * 16, "passwd:aaaaaaaa,secret=bbbbbbbb", "pass\nword=aaaaaaaa", "", None, "password=" + "a" * 50_000,
]


def test_secrets_are_brute_force(spark, docs, odd):
    tricky = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    for df in (tricky, docs, odd):
        want = Counter((r["doc_id"], brute_spans(r["text"])) for r in df.collect())
        found = Counter((r.doc_id, tuple((s.start, s["rank"], s.kind, s.end) for s in r.spans)) for r in secrets.scan_secrets(df).collect())
        assert found == want


def test_secrets_of_repeated_rows_and_of_many_matches(spark):
    many = " ".join(f"token={i:08}" for i in range(1000)) + " tail"
    df = spark.createDataFrame([(1, "ghp_" + "a" * 36), (1, "ghp_" + "a" * 36), (2, many), (None, many)], "doc_id long, text string")
    found = Counter((r.doc_id, tuple((s.start, s["rank"], s.kind, s.end) for s in r.spans)) for r in secrets.scan_secrets(df).collect())
    assert found == Counter((r["doc_id"], brute_spans(r["text"])) for r in df.collect()) and len(brute_spans(many)) == 1000


def test_secrets_of_nothing(none):
    assert secrets.scan_secrets(none).count() == 0


def test_trigram_queries_are_necessary():
    assert secrets.trigram_query(r"[0-9a-f]+") is None
    assert secrets.trigram_query(r"(foo|ba)") is None
    assert secrets.trigram_query(r"foob?ar") == [frozenset({"foo", "oob", "oba", "bar"}), frozenset({"foo", "ooa", "oar"})]
    assert secrets.trigram_query(r"(?:abc){2,3}") == [frozenset({"abc", "bca", "cab"})]
    for rule in RULES:
        q = secrets.trigram_query(rule.regex)
        for t in TRICKY:
            for m in re.finditer(rule.regex, t or "", re.ASCII):
                assert q is None or any(all(g in m[0].lower() for g in alt) for alt in q)


# --- URL filter ----------------------------------------------------------------------------------

URLS = [
    "http://a.net/x", "http://net/x", "http://NET/", "http://a.net", "http://a.net?x", "https://example.net/en/1", "https://b.example.net/en/", "https://b.example.net/en", "https://xexample.net/en/1",
    "http://example.com/de/1#x", "http://example.com/DE/1", "http://o.org/fr/", "http://casino.example.com/", "http://spam-farm.example.com/", "http://casinos.example.com/",
    "no url", None, "", "://", "a://b://c/d", "http://h/a.EXE?x", "http://x.casinobonuses.com/", "http://casino.example.com/responsible-gaming/", "http://h/%0a/ads/\nx", "http://a.net/x", "http://É.NET/en/",
    "http://a.b?x.net/", "https://good.com#x.org/fr/", "http://good.com/x?u=.net/", "http://u:p@a.net/x", "http://a.net:8080/x", "http://net:80/", "http://example.com/a?b=/de/", "http://a.net./x",
    "http://x.org/fr/?a#b", "http://h/x/../ads/" + "y" * 50_000, "http://h/cheap-pills.", "http://h/adult-x\ny.",
]


PATTERN_RULES = url_filter.read_rules()


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    tail = rest[len(host) :]
    path = re.match(r"[^?#]*", tail)[0]
    host = "".join(c.lower() if c < "\x80" else c for c in host)
    fits = [r for r in url_filter.HOST_RULES for h, p in [r.label.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    if fits:
        best = max(fits, key=lambda r: len(r.label))
        return host, path, best.label, best.verdict
    own = {r.verdict for r in PATTERN_RULES if re.search(r.regex(), host + tail, re.ASCII)}
    return host, path, None, "allow" if "allow" in own or not own else "block"


def test_urls_are_brute_force(spark, sf):
    mine = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("host", F.lit(1))
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for df in (mine, pages, mine.limit(0)):
        found = url_filter.judge_urls(df, url_filter.HOST_RULES + PATTERN_RULES, carry=("page_id",)).collect()
        assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in found) == Counter((r["page_id"], *brute_url(r["url"])) for r in df.collect())


def test_rules_are_read_from_a_file(spark, tmp_path):
    (tmp_path / "list").write_text("! note\n\n^bad^\n@@/good/\n")
    rules = url_filter.read_rules(tmp_path / "list")
    assert rules == (url_filter.Rule("^bad^", "block"), url_filter.Rule("/good/", "allow"))
    df = spark.createDataFrame([(1, "http://bad/"), (2, "http://bad/good/"), (3, "http://badly/"), (None, "http://x/BAD")], "url_id long, url string")
    assert {r.url_id: r.verdict for r in url_filter.judge_urls(df, rules, carry=("url_id",)).collect()} == {1: "block", 2: "allow", 3: "allow", None: "block"}
    assert {r.verdict for r in url_filter.judge_urls(df, ()).collect()} == {"allow"}


def test_the_sql_of_urls_is_brute_force(tmp_path):
    import duckdb

    from casewell.llm.oracles import ORACLES

    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(URLS)))
    assert Counter(con.execute(ORACLES["op5_url_filter"]).fetchall()) == Counter((i, *brute_url(u)) for i, u in enumerate(URLS))


def test_rules_are_filed_under_whole_rarest_tokens(spark):
    subjects = spark.createDataFrame([("casino.com/a",), ("b.com/",), ("c.com/",)], "subject string")
    rules = (url_filter.Rule("||casino.com/", "block"), url_filter.Rule("casinobonus", "block"), url_filter.Rule("^a*z.", "block"))
    assert url_filter.rule_index(subjects, rules) == {0: "casino", 1: "", 2: ""}


# --- lines ---------------------------------------------------------------------------------------


def brute_lines(rows, ratio, least):
    pages, seen = Counter(r["source"] for r in rows), Counter()
    for r in rows:
        for x in {x for x in (r["text"] or "").split("\n") if x.strip(" ")}:
            seen[r["source"], x] += 1
    bad = {k for k, n in seen.items() if n >= least and n > ratio * pages[k[0]]}
    kept = lambda r: [x for x in (r["text"] or "").split("\n") if not x.strip(" ") or (r["source"], x) not in bad]
    return Counter((r["doc_id"], len((r["text"] or "").split("\n")), "\n".join(kept(r))) for r in rows)


@pytest.mark.parametrize("limit", [0, 1000])
def test_lines_are_brute_force(spark, docs, odd, none, limit):
    fixed = spark.createDataFrame([(i, f"nav\n\nbody {i}\nnav" if i % 4 else "only\n ", None, "h" if i % 2 else None, 1) for i in range(40)], "doc_id long, text string, lang string, source string, clean_text long")
    for df, ratio, least in ((docs, 0.1, 5), (odd, 0.3, 2), (none, 0.1, 5), (fixed, 0.5, 5)):
        out = line_dedup.drop_boilerplate(df, ratio=ratio, min_pages=least, broadcast_lines=limit).collect()
        assert Counter((r.doc_id, r.n_lines, r.clean_text) for r in out) == brute_lines(df.collect(), ratio, least)


# --- mixing --------------------------------------------------------------------------------------


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        goal = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s: most * sizes[s] for s in free if goal[s] > most * sizes[s]}
        if not over:
            return goal | capped
        capped |= over


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_mix(request, table):
    df = request.getfixturevalue(table)
    rows = mixing.mix(mixing.with_words(df)).collect()
    given = df.collect()
    assert Counter((r.doc_id, r.source, r.size) for r in rows) == Counter((r["doc_id"], r["source"], size(r["text"])) for r in given)
    sizes = Counter()
    for r in given:
        sizes[r["source"]] += size(r["text"])
    goal = brute_targets(sizes) if sizes else {}
    taken = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == int(goal[s] + 1e-9) for s in sizes)
    again = mixing.mix(mixing.with_words(df.repartition(3))).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_a_mix_is_applied(request, table):
    df = request.getfixturevalue(table)
    df = df.dropDuplicates(["doc_id"])
    want = Counter()
    for r in mixing.mix(mixing.with_words(df)).collect():
        want[r.doc_id] += r.taken
    out = mixing.apply_mix(df)
    assert out.columns == df.columns
    found, texts = Counter(), {r["doc_id"]: r["text"] or "" for r in df.collect()}
    for r in out.collect():
        found[r["doc_id"]] += size(r["text"])
        assert texts[r["doc_id"]].startswith(r["text"] or "")
    assert +found == +want


def test_rows_that_repeat_the_id_at_a_cut_add_up(spark):
    """Two equal rows of one id at the cut, and a hot id with texts of several sizes."""
    two = [(7, "w " * 15, "a"), (7, "w " * 15, "a")]
    hot = [(None, "x " * (1 + i % 3), "a") for i in range(60)] + [(i, "y " * 5, "b" if i % 2 else None) for i in range(40)]
    for rows, ranges in ((two, 100_000), (hot, 1), (hot, 100_000)):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
        goal = brute_targets({s: sum(size(t) for _, t, x in rows if x == s) for s in {x for *_, x in rows}}, (3, 1, 2), 0.77)
        mixed = mixing.mix(mixing.with_words(df), share=0.77, range_rows=ranges).collect()
        assert len(mixed) == len(rows) and all(r.taken <= 2 * r.size for r in mixed)
        found, taken = Counter(), Counter()
        for r in mixing.apply_mix(df, share=0.77, range_rows=ranges).collect():
            found[r.source] += size(r.text)
        for r in mixed:
            taken[r.source] += r.taken
        assert found == taken == {s: int(x + 1e-9) for s, x in goal.items()}


@pytest.mark.parametrize("ranges", [1, 7, 300])
def test_ranges_do_not_show(docs, ranges):
    one, many = (mixing.mix(mixing.with_words(docs), range_rows=n).collect() for n in (100_000, ranges))
    assert Counter(map(tuple, one)) == Counter(map(tuple, many))


def test_budgets_over_many_sources(spark, monkeypatch):
    from casewell.operators import frames

    r = random.Random(3)
    sizes = {f"s{i:03}": r.randrange(1, 1000) for i in range(100)} | {None: 50}
    monkeypatch.setattr(frames.running, "__defaults__", (7,))
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {x.source: x.target for x in mixing.budgets(df).collect()}
    want = brute_targets(sizes)
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-6 for k in want)


def test_first_words(spark):
    df = spark.createDataFrame([("  a  b\tc ", 2), ("a", 1), ("a b", 5)], "t string, n int")
    assert [r.x for r in df.select(mixing.first_words(F.col("t"), F.col("n")).alias("x")).collect()] == ["  a  b", "a", "a b"]


def test_digest_of_ids(spark, docs, tokenizer):
    from casewell.llm.queries import op3_bpe

    r = op3_bpe(spark, "/root/testdata/sf0.001").filter("doc_id = 0").first()
    t = docs.filter("doc_id = 0").first().text
    ids = tokenizer.encode(t, add_special_tokens=False).ids
    assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
