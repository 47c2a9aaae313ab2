"""URL filters: pattern rules indexed by their rarest literal token.

A rule is written as in common filter lists: ``||host/path`` is anchored at a host and holds
for its subdomains, ``^`` stands for a separator or an end, ``*`` for any run, everything else
for itself. A literal token is a run of ASCII letters and digits that a separator or an anchor
closes on both sides, so a URL that fits has it as a whole token. Each rule is filed under the
one of its tokens that the fewest URLs have; a URL's tokens fetch the rules filed under them,
and only those run their regular expression. A rule without such a token is filed under the
empty token, which every URL has.

Rules are parameters: ``read_rules`` reads a list of them from a file, one on a line, ``@@`` before
those that allow. ``url_rules.txt`` beside this module is the list that the query uses.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, literal_rows, stored

BROADCAST_RULES = 50_000  # index rows; beyond, the index is joined by a shuffle


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str  # block or allow
    ranked: bool = False  # ranked rules decide first, the longest one wins

    @property
    def anchored(self) -> bool:
        return self.text.startswith("||")

    @property
    def label(self) -> str:
        return self.text[2:] if self.anchored else self.text

    def regex(self) -> str:
        """For ``host || path`` of ranked rules, which mind case, and ``host || rest`` of others, which do
        not. The host of an anchored rule ends where the URL's host ends."""
        body = "".join({"*": ".*", "^": "(?:[^A-Za-z0-9]|^|$)"}.get(c) or re.sub(r"([^A-Za-z0-9_/\-])", r"\\\1", c) for c in self.label)
        return ("" if self.ranked else "(?is)") + (r"^(?:[^/?#]*\.)?" if self.anchored else "") + body

    def tokens(self) -> list[str]:
        t = ("^" if self.anchored else "*") + self.label + "*"
        return sorted({m[0].lower() for m in re.finditer(r"(?<![A-Za-z0-9*])[A-Za-z0-9]+(?![A-Za-z0-9*])", t)})


#: Fixed values of the contract: host and path rules.
HOST_RULES = (
    Rule("||net/", "block", True),
    Rule("||example.net/en/", "allow", True),
    Rule("||example.com/de/", "block", True),
    Rule("||org/fr/", "allow", True),
)
RULES_FILE = Path(__file__).with_name("url_rules.txt")


def read_rules(path: str | Path = RULES_FILE) -> tuple[Rule, ...]:
    """Rules of a list, read by the driver: blank lines and lines with ``!`` are skipped."""
    lines = [x.strip() for x in Path(path).read_text(encoding="utf-8").splitlines()]
    return tuple(Rule(x.removeprefix("@@"), "allow" if x.startswith("@@") else "block") for x in lines if x and not x.startswith("!"))


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), F.lit("")))


def rest_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*(.*)$", 1), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(subject: Column) -> Column:
    """Distinct whole tokens, and the empty one under which unindexable rules are filed."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(ascii_lower(subject), "[^a-z0-9]+")))


def rule_index(subjects: DataFrame, rules: tuple[Rule, ...]) -> dict[int, str]:
    """Rule number to its rarest token. Only the tokens that rules have are counted, so what
    comes to the driver is as long as the rule list."""
    wanted = sorted({t for r in rules for t in r.tokens()})
    if not wanted:
        return dict.fromkeys(range(len(rules)), "")
    names = literal_rows(subjects.sparkSession, [{"token": t} for t in wanted], "token string")
    names = F.broadcast(names) if len(wanted) <= BROADCAST_RULES else names
    found = subjects.select(F.explode(url_tokens(F.col("subject"))).alias("token")).join(names, "token").groupBy("token").count()
    df = {r["token"]: r["count"] for r in found.collect()}
    return {i: min(r.tokens(), key=lambda t: (df.get(t, 0), t), default="") for i, r in enumerate(rules)}


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...], url_col: str = "url", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``pages``: ``carry`` columns, ``url, host, path, rule, verdict``.

    ``rule`` is the longest ranked rule that fits, else null; a ranked rule has to fit the host and
    the path alone, whatever stands in the query or the fragment. Without one, an allow pattern
    that fits gives ``allow``, a block pattern ``block``, none ``allow``. Null URLs and those
    without ``://`` have an empty host and path, fit nothing and are allowed; a port or a user
    name is part of the host, as it stands. Equal URLs are judged once and rows are never merged,
    so repeated rows, null ids and very long URLs are rows like others; of rules of one length
    the one greatest in code points wins. No rules at all allow everything, an empty table gives
    no rows, and columns of ``pages`` that are not carried are ignored, whatever their names.
    """
    rows = pages.select(*[F.col(c).alias(f"__carry_{i}") for i, c in enumerate(carry)], F.col(url_col).alias("url"))
    urls = rows.select("url").filter(F.col("url").contains("://")).distinct()
    host = host_of(F.col("url"))
    subjects = urls.select("url", F.concat(host, rest_of(F.col("url"))).alias("subject"), F.concat(host, path_of(F.col("url"))).alias("place"))
    filed = rule_index(subjects, rules)
    index = literal_rows(
        pages.sparkSession,
        [{"token": filed[i], "label": r.label, "regex": r.regex(), "rule_verdict": r.verdict, "ranked": r.ranked} for i, r in enumerate(rules)],
        "token string, label string, regex string, rule_verdict string, ranked boolean",
    )
    index = F.broadcast(index) if len(rules) <= BROADCAST_RULES else index
    fits = (
        subjects.withColumn("token", F.explode(url_tokens(F.col("subject"))))
        .join(index, "token")
        .filter(F.expr("(case when ranked then place else subject end) rlike regex"))
        .groupBy("url")
        .agg(
            F.max(F.when(F.col("ranked"), F.struct(F.length("label"), "label", "rule_verdict"))).alias("top"),
            F.max(F.when(~F.col("ranked"), F.col("rule_verdict") == "allow")).alias("excepted"),
            F.max(F.when(~F.col("ranked"), F.col("rule_verdict") == "block")).alias("blocked"),
        )
        .withColumnRenamed("url", "__url")
    )
    fits = stored(fits, "fits", narrow=True)  # a plain shuffle, so that the join splits a URL of many rows
    own = F.when(F.coalesce("excepted", F.lit(False)), "allow").when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    proper = F.coalesce(F.col("url").contains("://"), F.lit(False))
    met = rows.filter(proper).join(fits, F.col("url") == F.col("__url"), "left")
    met = met.unionByName(rows.filter(~proper), allowMissingColumns=True)  # what is no URL fits nothing and needs no join
    return met.select(
        *[F.col(f"__carry_{i}").alias(c) for i, c in enumerate(carry)],
        "url",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        F.col("top.label").alias("rule"),
        F.coalesce(F.col("top.rule_verdict"), own).alias("verdict"),
    )
