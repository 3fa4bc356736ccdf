"""URL filters: host and path rules first, then a list of canonical URLs.

The list is turned into a blocked Bloom filter (one 256-bit block per URL group, eight
bits per URL in that block), which lets possible hits pass; an exact hash join of the hits
with the list removes the false positives. All of it is DataFrame code.

Defined results: a null URL, or one without `://`, has an empty host and path, fits no rule
and no list entry, and is allowed; repeated rows are judged alike; extra columns are kept, but for
those named like a result (host, path, rule, verdict, listed), which these replace.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


# The rules of the registered query.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)

BITS_PER_URL = 16
BITS_SET = 8
#: A filter of up to this many 32-byte blocks (4 MB) is broadcast, a larger one is joined by block.
BROADCAST_BLOCKS = 1 << 17


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host in lower case without `www.`, path without its trailing slashes; the scheme, the
    fragment and the query part `utm_source=...` are left out. Null where there is no host."""
    host = F.regexp_replace(url_host(url), r"^www\.", "")
    path = F.regexp_replace(url_path(url), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(query, r"^utm_source=[^&]*&?|&utm_source=[^&]*", "")
    text = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(host != "", text)


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def longest_rule(rules, host: Column, path: Column) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, else null."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.host + r.path), r.host + r.path)):
        value = F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits(r, host, path), value) if out is None else out.when(fits(r, host, path), value)
    return out


def _bits(hash2: Column, word: int) -> Column:
    """The bits of one URL that fall in 64-bit word `word` of its block."""
    out = F.lit(0).cast("bigint")
    for i in range(BITS_SET):
        bit = F.shiftrightunsigned(hash2, 8 * i).bitwiseAND(F.lit(255))
        here = F.shiftrightunsigned(bit, 6) == word
        mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(F.lit(63)).cast("int"))
        out = out.bitwiseOR(F.when(here, mask).otherwise(F.lit(0).cast("bigint")))
    return out


def _block(url: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(n_blocks))


def bloom_blocks(listed: DataFrame, column: str, n_blocks: int) -> DataFrame:
    """The filter as rows (_block, _w0.._w3); blocks without URLs are absent."""
    h = listed.select(_block(F.col(column), n_blocks).alias("_block"), F.xxhash64(F.lit(7), F.col(column)).alias("_h"))
    return h.groupBy("_block").agg(*[F.bit_or(_bits(F.col("_h"), w)).alias(f"_w{w}") for w in range(4)])


def url_verdicts(pages: DataFrame, listed: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict and listed (boolean).

    listed: one column `canonical` of canonical URLs; repeats and nulls in it don't count. What a
    rule decides, and what the filter turns away, gets a key of its own that no list entry has,
    so that these rows spread over all tasks of a join. Inner names begin with `_url_`.
    """
    listed = cut(listed.where(F.col("canonical").isNotNull()).select(F.col("canonical").alias("_url_listed")).distinct(), "listed")
    n_blocks = max(1, -(-listed.count() * BITS_PER_URL // 256))
    blocks = bloom_blocks(listed, "_url_listed", n_blocks)
    blocks = F.broadcast(blocks) if n_blocks <= BROADCAST_BLOCKS else cut(blocks, "bloom-blocks")
    inner = {c: F.col(c).alias(f"_url{c}") for c in ("_block", "_w0", "_w1", "_w2", "_w3")}
    blocks = blocks.select(*inner.values())
    canonical, spread = F.col("_url_canonical"), F.rand(7)
    judged = (
        pages.drop("host", "path", "rule", "verdict", "listed")
        .withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
        .withColumn("_url_rule", longest_rule(rules, F.col("host"), F.col("path")))
        .withColumn("_url_canonical", F.when(F.col("_url_rule").isNull(), canonical_url(F.col(url))))
        .withColumn("_url_at", F.when(canonical.isNotNull(), _block(canonical, n_blocks)).otherwise(-1 - F.floor(spread * (1 << 30))))
    )
    probed = judged.join(blocks, F.col("_url_at") == F.col("_url_block"), "left")
    hit = canonical.isNotNull() & F.col("_url_block").isNotNull()
    for w in range(4):
        mine = _bits(F.xxhash64(F.lit(7), canonical), w)
        hit = hit & (F.col(f"_url_w{w}").bitwiseAND(mine) == mine)
    # A canonical URL begins with its host, so none begins with a slash.
    keyed = probed.withColumn("_url_key", F.when(hit, canonical).otherwise(F.concat(F.lit("/"), spread.cast("string"))))
    out = keyed.join(listed, F.col("_url_key") == F.col("_url_listed"), "left")
    is_listed = F.col("_url_listed").isNotNull()
    verdict = F.coalesce(F.col("_url_rule.verdict"), F.when(is_listed, F.lit("block")).otherwise(F.lit("allow")))
    out = out.withColumns({"rule": F.col("_url_rule.rule"), "verdict": verdict, "listed": is_listed})
    return out.drop(*[c for c in out.columns if c.startswith("_url_")])


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page is judged; the list is the canonical URLs of the pages whose id 20 divides."""
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    listed = pages.where("page_id % 20 = 0").select(canonical_url(F.col("url")).alias("canonical"))
    return url_verdicts(pages, listed).select("page_id", "host", "path", "rule", "verdict")


_SQL_URL = r"""
WITH u AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
    regexp_replace(coalesce(regexp_extract(url, '^.*?://[^?#]*\?([^#]*)', 1, 's'), ''), '^utm_source=[^&]*&?|&utm_source=[^&]*', '', 'g') AS query
  FROM pages),
c AS (
  SELECT *, CASE WHEN regexp_replace(host, '^www\.', '') <> '' THEN
    regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical
  FROM u),
r(rule_host, rule_path, rule_verdict) AS (VALUES
  ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
best AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    arg_max(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
  FROM c JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id),
listed AS (SELECT DISTINCT canonical FROM c WHERE page_id % 20 = 0 AND canonical IS NOT NULL)
SELECT c.page_id, c.host, c.path, best.rule,
  coalesce(best.rule_verdict, CASE WHEN listed.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN best ON c.page_id = best.page_id LEFT JOIN listed ON c.canonical = listed.canonical
"""

QUERIES = {"op7_url_filter": op7_url_filter}
SQL = {"op7_url_filter": _SQL_URL}
