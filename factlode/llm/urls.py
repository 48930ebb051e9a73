"""URL filter: a blocked Bloom filter in front of an exact join, all in DataFrame operations.

Listed canonical URLs (host and path) set ``BITS`` bits in one 64-bit block each of a filter
of ``BLOCKS`` blocks. The filter's size is fixed, so it can go to every task; a page whose
bits are not all set is surely not listed. The few that pass, true hits and false positives,
meet the list in an exact hash join, which alone decides. A longer list fills the filter and
lets more pages through to the join, but never changes a verdict.

Rules on hosts and path beginnings come first: a rule fits its host and all subdomains where
the path starts with the rule's path; the longest wins, at equal length the longer host. They
are a short parameter (at most ``MOST_RULES``), so each page is held against them in place.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule,
is not listed and is allowed; repeated pages are judged alike; an empty list or table works;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BLOCKS, BITS, MOST_RULES = 1 << 16, 4, 1000
#: (host, path, verdict)
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Sites whose known pages make up the list of the query.
LISTED_SITES = ("casino-win", "free-bets", "ads-track", "spam-farm", "cheap-pills", "adult-x")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(raw, UPPER, LOWER), F.regexp_extract(F.substr(rest, F.length(raw) + 1), "^[^?#]*", 0)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text (host and path) and verdict of the longest rule that fits, else nulls."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules; put whole URLs into the list")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # From the shortest to the longest, so that the longest is asked first.
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _block_and_bits(key: Column) -> tuple[Column, Column]:
    h = F.xxhash64(key)
    mask = F.lit(0).cast("long")
    for k in range(BITS):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftrightunsigned", h, F.lit(16 + 6 * k)).bitwiseAND(63).cast("int")))
    return F.pmod(h, F.lit(BLOCKS)).cast("int"), mask


def bloom(listed: DataFrame, key: str = "url_key") -> DataFrame:
    """(block, bits): at most ``BLOCKS`` rows of 12 bytes, however long the list is."""
    block, mask = _block_and_bits(F.col(key))
    return listed.filter(F.col(key).isNotNull()).groupBy(block.alias("block")).agg(F.bit_or(mask).alias("bits"))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, listed of every page. ``listed`` has the column url_key."""
    host, path = host_and_path(F.col(url))
    judged = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    key = F.concat("host", "path")
    block, mask = _block_and_bits(key)
    judged = judged.select("*", rule.alias("rule"), verdict.alias("rule_verdict"), key.alias("url_key"), block.alias("block"), mask.alias("mask"))
    seen = judged.join(F.broadcast(bloom(listed)), "block", "left")
    maybe = (F.col("mask").bitwiseAND(F.coalesce("bits", F.lit(0).cast("long"))) == F.col("mask")) & (F.col("host") != "")
    exact = listed.select("url_key").filter("url_key IS NOT NULL").distinct().withColumn("listed", F.lit(True))
    out = ["page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), F.coalesce("listed", F.lit(False)).alias("listed")]
    hits = seen.filter(maybe).join(exact, "url_key", "left").select(*out)
    return hits.unionByName(seen.filter(~maybe).withColumn("listed", F.lit(False)).select(*out))


def known_bad(pages: DataFrame, sites: Sequence[str] = LISTED_SITES, url: str = "url") -> DataFrame:
    """Canonical URLs of the pages of listed sites."""
    host, path = host_and_path(F.col(url))
    found = pages.select(host.alias("host"), path.alias("path")).filter(F.exists(F.split("host", "\\."), lambda x: x.isin(*sites)))
    return found.select(F.concat("host", "path").alias("url_key")).distinct()


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, known_bad(pages))


OP3_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM cut
), h AS (
  SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM split
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES {", ".join(str(r) for r in RULES)}
), fit AS (
  SELECT h.page_id, h.host, h.path, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (PARTITION BY h.page_id, h.host, h.path ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS rn
  FROM h JOIN rules ON (h.host = rule_host OR ends_with(h.host, '.' || rule_host)) AND starts_with(h.path, rule_path)
), listed AS (
  SELECT DISTINCT host || path AS url_key FROM h WHERE list_has_any(string_split(host, '.'), {list(LISTED_SITES)})
)
SELECT h.page_id, h.host, h.path, fit.rule,
       coalesce(fit.rule_verdict, CASE WHEN l.url_key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       l.url_key IS NOT NULL AS listed
FROM h LEFT JOIN (SELECT * FROM fit WHERE rn = 1) fit ON h.page_id = fit.page_id AND h.host = fit.host AND h.path = fit.path
LEFT JOIN listed l ON h.host || h.path = l.url_key AND h.host <> ''
"""
