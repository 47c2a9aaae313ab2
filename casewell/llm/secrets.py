"""Secret scans with a trigram inverted index.

Each rule's regular expression is parsed into a Boolean query of trigrams: a disjunction of
alternatives, each a conjunction of the trigrams that every match of it contains. The corpus
is indexed by the trigrams that the queries name, as (trigram, document) postings; postings are
intersected per alternative; documents that some alternative admits are candidates of the rule
and are verified by the expression itself. A rule with an alternative that has no trigram
scans every document.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as K
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Sieve, literal_rows, stored


@dataclass(frozen=True)
class SecretRule:
    kind: str
    regex: str
    group: int = 0  # the group whose length is tested
    least: int = 1  # code points it needs, else the match is dropped


#: Fixed values of the contract, in the order that breaks ties.
BASE_RULES = (
    SecretRule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 16),
    SecretRule("hex", r"[0-9a-f]+", 0, 32),
)
#: Public formats of well-known credentials, in the order that breaks ties after the base kinds.
MORE_RULES = (
    SecretRule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("git", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    SecretRule("maps", r"AIza[0-9A-Za-z_-]{35}"),
    SecretRule("pay", r"sk_live_[0-9A-Za-z]{16,}"),
)
MOST_ALTERNATIVES = 64


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """Alternatives of mandatory lower-case trigrams; None where some match needs none."""
    sets = [_trigrams(pieces) for pieces in _pieces(parser.parse(regex))]
    if not sets or not all(sets):
        return None
    return sorted((s for s in set(sets) if not any(o < s for o in sets)), key=sorted)  # a looser alternative admits all of a stricter one


def _trigrams(pieces: tuple[str | None, ...]) -> frozenset[str]:
    text = "".join("\0" if p is None else p for p in pieces)
    return frozenset(t for part in text.split("\0") for t in (part[i : i + 3].lower() for i in range(len(part) - 2)))


def _pieces(nodes) -> list[tuple[str | None, ...]]:
    """Every way through the nodes: literal strings, and None for text that is not known."""
    ways: list[tuple[str | None, ...]] = [()]
    for op, arg in nodes:
        if op is K.LITERAL:
            more = [(chr(arg),)] if arg < 128 else [(None,)]
        elif op is K.SUBPATTERN:
            more = _pieces(arg[3])
        elif op is K.BRANCH:
            more = [w for branch in arg[1] for w in _pieces(branch)]
        elif op is K.AT:
            more = [()]
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
            low, high, body = arg
            inner = _pieces(body)
            if high == 1:
                more = ([()] if low == 0 else []) + inner
            elif 0 < low <= 4 and len(inner) == 1:
                more = [inner[0] * low + (None,) * (high != low)]
            else:
                more = [(None,)]
        elif op is K.IN and len(arg) <= 8 and all(o is K.LITERAL and a < 128 for o, a in arg):
            more = sorted({(chr(a).lower(),) for _, a in arg})
        else:
            more = [(None,)]
        if len(ways) * len(more) > MOST_ALTERNATIVES:
            more = [(None,)]
        ways = [w + m for w in ways for m in more]
    return ways


def postings(docs: DataFrame, trigrams: list[str], text_col: str = "text") -> DataFrame:
    """The inverted index over the trigrams that queries name: ``trigram, doc_id, text_hash``.
    Trigrams are ASCII, so ASCII folding of the text is enough. Texts without any of them, null and
    empty ones included, have no postings; a trigram has one posting for each row that has it,
    equal rows too, however often it stands in the text. ``docs`` has ``doc_id, text_hash``
    and the text; other columns are ignored, an empty table has an empty index."""
    has = F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(F.col("__low"), t))
    return docs.withColumn("__low", F.lower(F.col(text_col))).select("doc_id", "text_hash", F.explode(has).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[SecretRule, ...]) -> DataFrame:
    """Postings intersected per alternative, alternatives united: ``doc_id, text_hash, kinds``, a row
    for each id and text that some rule may match. Postings of equal rows count once, a null id is
    an id like others, and an empty index gives no candidates."""
    terms = []
    for r in rules:
        for i, alternative in enumerate(trigram_query(r.regex) or []):
            named = sorted(alternative)[:62]  # a bit each; those left out make no candidate less
            terms += [{"trigram": t, "kind": r.kind, "alternative": i, "bit": 1 << k, "need": (1 << len(named)) - 1} for k, t in enumerate(named)]
    queries = literal_rows(index.sparkSession, terms, "trigram string, kind string, alternative int, bit long, need long")
    return (
        index.join(F.broadcast(queries), "trigram")  # as long as the rules
        .groupBy("doc_id", "text_hash", "kind", "alternative", "need")
        .agg(F.bit_or("bit").alias("have"))
        .filter("have = need")
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("kind").alias("kinds"))
    )


SPAN = "struct<start:int,kind:string,end:int>"
BLOCK = 256  # matches that are counted off in one go


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with ``value`` computed once."""
    return F.get(F.transform(F.array(value), then), 0)


def match_spans(text: Column, rule: SecretRule) -> Column:
    """``array<struct<start, kind, end>>`` of the rule's matches in code points, leftmost and not
    overlapping, those that fail the length test left out; null without a match. The pieces
    between matches and the matches alternate, which gives the offsets: those of blocks of matches
    first, then those within each block, so that time grows with the number of matches. What is
    tested is read from the match itself, not from the text again."""
    length = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))

    def blocks(steps: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda i: F.slice(steps, i * BLOCK + 1, F.lit(BLOCK)))

    def starts(parts: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        size = lambda part: F.aggregate(part, F.lit(0), lambda n, x: n + length(x))
        return F.aggregate(parts, begin, lambda a, part: F.struct((a["at"] + size(part)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]

    def step(acc: Column, x: Column) -> Column:
        begin, end = acc["at"] + F.length(x["gap"]), acc["at"] + length(x)
        tested = F.regexp_extract(x["hit"], rule.regex, rule.group) if rule.group else x["hit"]
        one = F.array(F.struct(begin.alias("start"), F.lit(rule.kind).alias("kind"), end.alias("end")))
        good = F.coalesce(F.length(tested) >= rule.least, F.lit(False))
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def within(part: Column, at: Column) -> Column:
        return F.aggregate(part, F.struct(at.alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")), step)["out"]

    steps = F.arrays_zip(F.split(text, rule.regex, -1).alias("gap"), F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0)).alias("hit"))
    spans = _bound(steps, lambda s: _bound(blocks(s), lambda parts: F.flatten(F.zip_with(parts, starts(parts), within))))
    return F.when(F.regexp_like(text, F.lit(rule.regex)), spans)


def _run(rule: SecretRule) -> SecretRule:
    """One character class repeated: a run shorter than asked for never matches, and no other
    match starts inside it, so the least length can be put into the expression."""
    return SecretRule(rule.kind, f"{rule.regex[:-1]}{{{rule.least},}}", 0, rule.least) if re.fullmatch(r"\[[^\]]+\]\+", rule.regex) and rule.group == 0 else rule


def scan_secrets(docs: DataFrame, rules: tuple[SecretRule, ...] = BASE_RULES + MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, spans`` with ``spans`` an array of
    ``struct<start, rank, kind, end>`` sorted by start, then by the order of the rules.

    Null text is empty and has no spans; null ids, repeated rows and ties are rows like others;
    an empty table gives no rows; extra columns are ignored. Only candidates' texts are
    shuffled: a sieve of the candidates, sized by their number, lets the others go map-side.
    """
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("text_hash", F.xxhash64("text"))
    rules = tuple(map(_run, rules))
    indexed = tuple(r for r in rules if trigram_query(r.regex))
    scanned = tuple(r for r in rules if r not in indexed)
    empty = F.array().cast(f"array<{SPAN}>")

    def spans_by(some: tuple[SecretRule, ...], when=lambda r: F.lit(True)) -> Column:
        return F.flatten(F.array(empty, *[F.coalesce(F.when(when(r), match_spans(F.col("text"), r)), empty) for r in some]))

    full = rows.select("doc_id", "text_hash", spans_by(scanned).alias("found"))
    if indexed:
        trigrams = sorted({t for r in indexed for a in trigram_query(r.regex) for t in a})
        found = stored(candidates(postings(rows, trigrams), indexed), "candidates", narrow=True)
        keys = found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "kinds")
        maybe = Sieve(found, ["doc_id", "text_hash"]).mark(rows, [F.col("doc_id"), F.col("text_hash")], "__maybe").filter("__maybe").drop("__maybe")
        verified = (
            maybe.dropDuplicates(["doc_id", "text_hash"])
            .join(keys, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")))
            .select("__id", "__hash", spans_by(indexed, lambda r: F.array_contains("kinds", r.kind)).alias("more"))
            .filter(F.size("more") > 0)
        )
        full = full.join(verified, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left").select(
            "doc_id", F.concat("found", F.coalesce("more", empty)).alias("found")
        )
    ranked = F.transform(
        "found", lambda x: F.struct(x["start"].alias("start"), F.element_at(rank, x["kind"]).alias("rank"), x["kind"].alias("kind"), x["end"].alias("end"))
    )
    return full.select("doc_id", F.array_sort(ranked).alias("spans"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
