"""URL filters: rules are indexed by their rarest literal token, URL tokens fetch candidates, and only those run regular expressions.

Everything here is a DataFrame operation; no row leaves the JVM.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._plan import copied

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = "[a-z0-9]+"
#: Rules that are a constant of the plan; more are a table, which up to so many rules is broadcast and beyond is joined by a shuffle.
MAP_RULES, BROADCAST_RULES = 200, 200_000
#: Copies of a judged url that are written out in one piece.
COPIES = 1000


@dataclass(frozen=True)
class Rule:
    """A rule on a host and its subdomains with a path prefix, or, given a pattern, on host and path together."""

    name: str
    verdict: str
    pattern: str
    literal: str
    first: bool = True

    @staticmethod
    def site(name: str, verdict: str) -> Rule:
        """A rule written as host/path; its pattern fits the host, all subdomains, and paths that start with /path."""
        host, slash, path = name.partition("/")
        end = re.escape(slash + path) if slash else "(?:/|$)"
        # A path may go on after the rule's last letters, so these are no whole token of the url.
        whole = re.sub("[A-Za-z0-9]+$", "", path)
        return Rule(name, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{end}", f"{host}/{whole}")


#: The rules to apply first.
SITE_RULES = (Rule.site("com/", "allow"), Rule.site("example.com/en/", "block"), Rule.site("www.example.com/en/", "allow"), Rule.site("net/es/", "block"), Rule.site("net/fr/", "block"))
#: The method's own rules, for pages that no site rule fits: words of unwanted pages as whole tokens.
WORD_RULES = tuple(Rule(f"word:{w}", "block", rf"(?i)(?:^|[^a-z0-9]){w}(?:[^a-z0-9]|$)", w, False) for w in ("casino", "pills", "porn", "viagra", "torrent", "warez", "xxx"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url: host after the first :// up to /, ? or #, A-Z lower-cased; path up to ? or #. Both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    upto = F.regexp_extract(rest, r"^[^?#]*", 0)
    host = F.translate(F.regexp_extract(upto, "^[^/]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(upto, "(?s)^[^/]*(.*)$", 1), F.lit(""))


def rule_index(rules: list[Rule] | tuple[Rule, ...]) -> list[tuple[str, int, str, str | None, str]]:
    """(token, rank, pattern, rule, verdict): each rule under the token of its literal that the fewest rules hold (then the longest, then the first by name).

    rank orders rules: site rules before word rules, longer names first, then by name.
    """
    tokens = {r: sorted(set(re.findall(TOKEN, r.literal.lower()))) for r in rules}
    bare = [r.name for r, found in tokens.items() if not found]
    if bare:
        raise ValueError(f"rules need a literal with a letter or digit: {', '.join(bare)}")
    held = Counter(t for found in tokens.values() for t in found)
    ranked = sorted(rules, key=lambda r: (not r.first, -len(r.name), r.name, r.verdict))
    return [(min(tokens[r], key=lambda t: (held[t], -len(t), t)), i, r.pattern, r.name if r.first else None, r.verdict) for i, r in enumerate(ranked)]


def best_by_map(urls: DataFrame, index: list[tuple]) -> DataFrame:
    """urls with the least rank that fits, from an index that is a constant of the plan: no shuffle."""
    of_token: dict[str, list[tuple]] = {}
    for token, rank, pattern, *_ in index:
        of_token.setdefault(token, []).append((rank, pattern))
    entry = lambda x: F.struct(F.lit(x[0]).alias("rank"), F.lit(x[1]).alias("pattern"))
    held = F.create_map(*(c for t, found in of_token.items() for c in (F.lit(t), F.array(*map(entry, found)))))
    fetched = F.flatten(F.array_compact(F.transform("tokens", lambda t: F.try_element_at(held, t))))
    fitting = F.filter(fetched, lambda x: F.rlike(F.col("whole"), x["pattern"]))
    return urls.withColumn("rank", F.array_min(F.transform(fitting, lambda x: x["rank"])))


def best_by_join(urls: DataFrame, index: list[tuple], broadcast_rules: int) -> DataFrame:
    """The same from a table of many rules; equal urls are one, and meet their candidates in a join."""
    rules = urls.sparkSession.createDataFrame([x[:3] for x in index], "token string, rank int, pattern string")
    few = F.broadcast if len(index) <= broadcast_rules else (lambda df: df)
    one = urls.groupBy("page_id", "host", "path").agg(F.count("*").alias("copies"), F.first("whole").alias("whole"), F.first("tokens").alias("tokens"))
    fetched = one.withColumn("token", F.explode_outer("tokens")).join(few(rules), "token", "left")
    best = fetched.groupBy("page_id", "host", "path", "copies").agg(F.min(F.when(F.rlike("whole", F.col("pattern")), F.col("rank"))).alias("rank"))
    return copied(best, "copies", "copy", COPIES)


def filter_urls(pages: DataFrame, rules=SITE_RULES + WORD_RULES, default: str = "allow", map_rules: int = MAP_RULES, broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """Judge every url by the fitting rule of the best rank.

    pages needs page_id and url. Returns one row per input row: page_id, host, path, rule (null unless
    a site rule fits) and verdict (the rule's, else the default). A null url has an empty host and path
    and gets the default; repeated rows, null page_ids, very long urls and other columns are allowed, the
    last unread; an empty table gives none. Every rule's literal needs a token of letters or digits, or a
    ValueError is raised. Up to map_rules rules are a constant of the plan; more are joined.
    """
    index = rule_index(rules)
    host, path = url_parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("whole", F.concat("host", "path"))
    urls = urls.withColumn("tokens", F.array_distinct(F.regexp_extract_all(F.translate("whole", UPPER, LOWER), F.lit(TOKEN), F.lit(0))))
    if not index:
        best = urls.withColumn("rank", F.lit(None).cast("int"))
    else:
        best = best_by_map(urls, index) if len(index) <= map_rules else best_by_join(urls, index, broadcast_rules)
    named = urls.sparkSession.createDataFrame([(x[1], *x[3:]) for x in index], "rank int, rule string, verdict string")
    judged = best.join(F.broadcast(named) if len(index) <= broadcast_rules else named, "rank", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
