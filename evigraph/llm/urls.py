"""Operator 9: URL rules found through their rarest literal token."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to so many rules the index is sent to every executor (under 300 bytes a
#: rule); a longer list is joined by a shuffle on its token.
BROADCAST_RULES = 50_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched against host + path; ``literals`` are the tokens
    that every match holds; ``name`` is null for rules without a listing."""

    verdict: str
    pattern: str
    literals: tuple[str, ...]
    name: str | None = None


def listed(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host, its subdomains, and paths that begin with ``path``."""
    whole = re.findall(r"[a-z0-9]+(?=[^a-z0-9])", path.lower())
    return Rule(verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", (*re.findall(r"[a-z0-9]+", host), *whole), host + path)


#: The listed rules of the registered query.
LISTED = (
    listed("allow", "com", "/"),
    listed("block", "example.com", "/en/"),
    listed("allow", "www.example.com", "/en/"),
    listed("block", "net", "/es/"),
    listed("block", "net", "/fr/"),
)
#: Words of the method's own pattern rules, by what they stand for.
UNWANTED_WORDS = {
    "gambling": ("casino", "casinos", "poker", "betting", "sportsbook", "slots", "roulette", "blackjack", "baccarat", "jackpot", "lottery", "bookmaker", "wager", "glücksspiel", "apuestas"),
    "adult": ("adult", "porn", "porno", "xxx", "sex", "sexcam", "escort", "escorts", "erotic", "erotik", "hentai", "nude", "nudes", "milf", "camgirl", "camgirls", "fetish", "hookup", "webcamsex"),
    "drugs": ("pills", "viagra", "cialis", "levitra", "xanax", "tramadol", "oxycontin", "steroids", "kamagra", "phentermine"),
    "piracy": ("warez", "torrent", "torrents", "keygen", "nulled", "cracked", "serialz", "piratebay"),
    "malware": ("phishing", "malware", "ransomware", "botnet", "exploitkit", "carding", "stealer"),
    "spam": ("payday", "payday-loans", "forex-signals", "get-rich", "free-money", "essay-writing", "buy-followers", "cheap-replica", "weight-loss-pills", "work-from-home"),
    "farms": ("doorway", "linkfarm", "backlinks", "spamdexing", "autoblog", "parked-domain", "domain-for-sale"),
}
#: A word stands alone between marks, in the host or in the path, in either case.
WORD_RULE = r"(?:^|[/._-]){}(?:[/._-]|$)"
UNWANTED = tuple(Rule("block", "(?i)" + WORD_RULE.format(re.escape(word)), tuple(re.findall("[a-z0-9]+", word))) for words in UNWANTED_WORDS.values() for word in words)


def host_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and for a url without ``://``; A-Z lowered in hosts."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = (*LISTED, *UNWANTED), default: str = "allow") -> DataFrame:
    """Judges ``pages(page_id, url)``: page_id, host, path, rule, verdict.

    Each rule stands under the literal token that fewest urls of the table
    hold; a url's tokens fetch the rules that stand under them, and only those
    run their pattern. Of listed rules that fit, the longest decides (ties: the
    smaller name) and is ``rule``; else any other rule that blocks; else
    ``default``. A rule without literals is refused. Null urls have empty host
    and path and the default; urls of any length are taken whole. Repeated rows
    are judged each; hosts may repeat without bound, since rows meet by page_id
    and url only. An empty table gives no rows; other columns are not read.
    """
    spark: SparkSession = pages.sparkSession
    if bare := [r.pattern for r in rules if not r.literals]:
        raise ValueError(f"rules without a literal token: {bare}")
    host, path = host_path(F.col("url"))
    parsed = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    target = F.concat("host", "path")
    tokens = parsed.where("url is not null").select("page_id", "url", target.alias("target"), F.explode(F.array_distinct(F.split(F.lower(target), "[^a-z0-9]+"))).alias("token"))
    literals = sorted({t for r in rules for t in r.literals})
    known = spark.createDataFrame([(t,) for t in literals], "token string")
    held = dict.fromkeys(literals, 0) | {r["token"]: r["n"] for r in tokens.join(F.broadcast(known) if len(literals) <= BROADCAST_RULES else known, "token").groupBy("token").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    rows = [(min(r.literals, key=lambda t: (held[t], t)), r.pattern, r.name, r.verdict) for r in rules]
    index = spark.createDataFrame(rows, "token string, pattern string, name string, rule_verdict string")
    if len(rows) <= BROADCAST_RULES:
        index = F.broadcast(index)
    fitting = tokens.join(index, "token").where(F.expr("rlike(target, pattern)"))
    rank = F.when(F.col("name").isNotNull(), F.struct((-F.length("name")).alias("l"), F.col("name").alias("n"), F.col("rule_verdict").alias("v")))
    best = fitting.groupBy("page_id", "url").agg(F.min(rank).alias("best"), F.max((F.col("name").isNull() & (F.col("rule_verdict") == "block")).cast("int")).alias("unwanted"))
    best = best.select(F.col("page_id").alias("p"), F.col("url").alias("u"), "best", "unwanted")
    joined = parsed.join(best, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("url") == F.col("u")), "left")
    return joined.select("page_id", "host", "path", F.col("best.n").alias("rule"), F.coalesce("best.v", F.when(F.col("unwanted") == 1, "block"), F.lit(default)).alias("verdict"))


#: DuckDB SQL for the query over ``pages``.
SQL = (
    r"""
WITH s AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
r AS (SELECT *, CASE
  WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host || path, '(?i)(^|[/._-])(WORDS)([/._-]|$)') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
).replace("WORDS", "|".join(word for words in UNWANTED_WORDS.values() for word in words))
