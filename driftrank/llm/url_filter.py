"""URL filters: pattern rules indexed by their rarest literal token (DataFrame operations only).

A rule is (name, verdict, regex, tokens, length). Every URL that a rule's regex can match holds all of the rule's tokens
(runs of a-z, 0-9, bounded by other characters) after lower-casing. Each rule is filed under the one of its tokens that
the fewest distinct URLs hold; a URL fetches the rules filed under its tokens, and only those run their regex.

Host rules win over patterns, the longest host rule over shorter ones; among patterns an exception (allow) wins over
a block. Rules with equal length: the smaller name wins. No rule: allow.

Defined results: null URL or one without `://`: empty host and path, no rule, the default verdict. Repeated rows keep
their multiplicity. An empty table gives an empty result. Extra columns stay out of the result unless named in `keep`.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftrank.tables import park

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many rules, the index (a row each of some hundred bytes: under 10 MB) is broadcast; more are joined by shuffle.
BROADCAST_RULES = 50_000


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    length: int
    kind: str  # "host" or "pattern"


def host_rule(rule: str, verdict: str) -> Rule:
    """`example.com/de/`: the host and its subdomains, paths that start with `/de/`."""
    host, slash, path = rule.partition("/")
    regex = rf"(?s)^([^/?#]*\.)?{re.escape(host)}{re.escape(slash + path)}"
    return Rule(rule, verdict, regex, _bounded(f".{host}{slash}{path}", open_end=True), len(rule), "host")


def pattern_rule(pattern: str, verdict: str = "block") -> Rule:
    """`^cheap-pills^`: `^` is a separator or an end, `*` any run of characters, the rest literal."""
    parts = [{"^": "([^a-z0-9]|^|$)", "*": ".*"}.get(c) or re.escape(c) for c in pattern.lower()]
    return Rule(pattern, verdict, "(?s)" + "".join(parts), _bounded(pattern.lower()), len(pattern), "pattern")


def _bounded(text: str, open_end: bool = False) -> tuple[str, ...]:
    """Literal tokens whose both ends are fixed by the rule; a run next to `*` or at an open end could go on."""
    found = []
    for m in re.finditer(r"[a-z0-9]+", text.lower()):
        left = text[m.start() - 1] if m.start() else "*"
        right = text[m.end()] if m.end() < len(text) else "*"
        if left != "*" and right != "*":
            found.append(m[0])
    if not found:
        raise ValueError(f"rule {text!r} has no literal token of its own")
    return tuple(dict.fromkeys(found))


def parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, what is left) of a URL; all empty without `://`."""
    pick = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$", i), F.lit(""))
    return F.translate(pick(1), UPPER, LOWER), pick(2), pick(3)


def index_rules(tokens: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Each rule under its rarest token. tokens: (url, token) rows of distinct URLs."""
    spark = tokens.sparkSession
    fits = (lambda df: F.broadcast(df)) if len(rules) <= BROADCAST_RULES else (lambda df: df)
    table = spark.createDataFrame(
        [(r.name, r.verdict, r.regex, list(r.tokens), r.length, r.kind) for r in rules],
        "name string, verdict string, regex string, tokens array<string>, length int, kind string",
    )
    wanted = table.select(F.explode("tokens").alias("token")).distinct()
    df = tokens.join(fits(wanted), "token").groupBy("token").agg(F.count("*").alias("df"))
    filed = table.withColumn("token", F.explode("tokens")).join(df, "token", "left")
    rare = filed.groupBy("name", "verdict", "regex", "length", "kind").agg(
        F.min_by("token", F.struct(F.coalesce("df", F.lit(0)), "token")).alias("token")
    )
    return fits(rare)


def judge(pages: DataFrame, rules: Iterable[Rule], url: str = "url", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """Columns `keep`, then host, path, rule, verdict, pattern: the host rule and the pattern that decided, or null."""
    rules = list(rules)
    rows = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(url).alias("url"))
    host, path, rest = parts(F.col("url"))
    seen = rows.where(F.col("url").contains("://")).select("url").distinct()
    seen = park(seen.select("url", host.alias("host"), path.alias("path"), rest.alias("rest")), "urls")
    # A shared word such as a top-level domain repeats in every URL, so the token side is never shuffled by token.
    whole = F.concat("host", "path", "rest")
    tokens = seen.select("url", whole.alias("whole"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(whole), F.lit("[a-z0-9]+"), F.lit(0)))).alias("token"))
    hits = tokens.join(index_rules(tokens.select("url", "token"), rules), "token")
    hits = hits.where(F.rlike(F.when(F.col("kind") == "host", F.col("whole")).otherwise(F.lower("whole")), F.col("regex")))
    order = F.struct(
        F.when(F.col("kind") == "host", 0).otherwise(1).alias("a"),
        F.when(F.col("kind") == "host", F.lit(0)).when(F.col("verdict") == "allow", 0).otherwise(1).alias("b"),
        (-F.col("length")).alias("c"),
        F.col("name").alias("d"),
    )
    best = hits.groupBy("url").agg(F.min_by(F.struct("name", "verdict", "kind"), order).alias("best"))
    decided = seen.select("url", "host", "path").join(best, "url", "left")
    decided = decided.select(
        "url", "host", "path",
        F.when(F.col("best.kind") == "host", F.col("best.name")).alias("rule"),
        F.coalesce("best.verdict", F.lit("allow")).alias("verdict"),
        F.when(F.col("best.kind") == "pattern", F.col("best.name")).alias("pattern"),
    )
    return rows.join(decided, "url", "left").select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        F.coalesce("host", F.lit("")).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
        "rule",
        F.coalesce("verdict", F.lit("allow")).alias("verdict"),
        "pattern",
    )


#: The rules of the stated query, longest first wins.
HOST_RULES = (host_rule("net/", "block"), host_rule("example.net/en/", "allow"), host_rule("example.com/de/", "block"), host_rule("org/fr/", "allow"))
#: Word patterns of unwanted sites for URLs that no host rule decides.
PATTERNS = tuple(pattern_rule(p) for p in ("^cheap-pills^", "^casino^", "^viagra^", "^free-money^", "^xxx^", "^porn^", "^payday-loan^", "^poker^")) + (
    pattern_rule("^casino^architecture^", "allow"),
)
