"""URL filters: ordered host/path rules, then a listed-URL test by a blocked Bloom filter and an exact join.

Canonical form of a URL: host in lower case without a leading ``www.`` and without the default port, path without a
closing slash, parameters sorted and without those that only track, no fragment and no scheme.

The listed canonical URLs become a blocked Bloom filter: a URL's hash names one block of 256 bits and one bit in each of
its eight 32-bit words, so a test touches one row.  The blocks are an ordinary table (``bit_or`` of masks per block, never
more rows than the list), joined on the block number and tested by bit operations; the filter grows with the list and is
broadcast only while it is small.  What passes - all listed URLs and few others - goes to an exact join on the canonical
URL, which removes the false positives.  A hot URL is salted: the few rows of the list are repeated, not the pages.

Edge cases: a NULL URL, or one without ``://``, has an empty host and path, meets no rule and is on no list; repeated
pages are judged each; listed URLs may repeat or be NULL; an empty list blocks nothing.  Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import fresh, q, stash

SALTS = 8
KEYS_PER_BLOCK = 16  # of 256 bits: about 0.1 % false positives
SMALL_BLOCKS = 200_000  # rows of 5 numbers: 8 MB
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|mc_[ce]id)(=|$)"  # fixed values: parameters that only track
# Odd multipliers, one for each word of a block (fixed values of the split-block layout).
SALT_WORDS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the contract.
RULES = (UrlRule("block", "net"), UrlRule("allow", "example.net", "/en/"), UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/"))
#: Hosts whose pages are reported as junk, in the query below.
REPORTED = r"(^|\.)(spam-farm|cheap-pills)\."


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; empty without it."""
    return F.coalesce(F.get(F.split(url, "://", 2), F.lit(1)), F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    host = F.regexp_extract(rest_of(url), r"(?s)^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest_of(url), r"(?s)^[^/?#]*(/[^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Canonical URL; NULL without ``://``."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(rest_of(url), r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    made = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(url.contains("://"), made)


def first_rule(rules, host: Column, path: Column) -> Column:
    """Struct (name, verdict) of the longest rule that fits: its host or a subdomain, and a path it begins."""
    chain = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    return chain


def masks(hashed: Column) -> list[Column]:
    """Four numbers of 64 bits: one bit in each of the eight words of a block."""
    low = hashed.bitwiseAND(F.lit(0x7FFFFFFF))  # the product stays below 2^63
    bits = [F.shiftright((low * F.lit(s)).bitwiseAND(F.lit(0xFFFFFFFF)), 27).cast("int") for s in SALT_WORDS]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), bits[2 * k]).bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bits[2 * k + 1] + 32)) for k in range(4)]


def block_of(hashed: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(hashed, 32), F.lit(blocks))


def bloom(listed: DataFrame, url: str, blocks: int) -> DataFrame:
    """The filter: block, m0 .. m3."""
    h = F.xxhash64(q(url))
    rows = listed.select(block_of(h, blocks).alias("block"), *[m.alias(f"m{k}") for k, m in enumerate(masks(h))])
    return rows.groupBy("block").agg(*[F.bit_or(f"m{k}").alias(f"m{k}") for k in range(4)])


def on_list(pages: DataFrame, listed: DataFrame, url: str, key: str, out: str, *, listed_url: str = "url") -> DataFrame:
    """``pages`` with the boolean ``out``: its canonical URL is one of those in ``listed`` (canonical, too)."""
    canon, block, salt, passed = fresh(pages, "_canon", "_block", "_salt", "_passed")
    exact = stash(listed.select(q(listed_url).alias(canon)).filter(F.col(canon).isNotNull()).distinct(), "listed")
    n = exact.count()
    blocks = max(1, -(-n // KEYS_PER_BLOCK))
    table = bloom(exact, canon, blocks).withColumnsRenamed({"block": block} | {f"m{k}": f"_m{k}" for k in range(4)})
    h = F.xxhash64(F.col(canon))
    rows = pages.withColumn(canon, canonical(q(url))).withColumn(block, block_of(h, blocks))
    rows = rows.join(F.broadcast(table) if blocks <= SMALL_BLOCKS else table, block, "left")
    hit = F.lit(True)
    for k, m in enumerate(masks(h)):
        hit = hit & (F.col(f"_m{k}").bitwiseAND(m) == m)
    rows = rows.withColumn(passed, F.col(canon).isNotNull() & F.coalesce(hit, F.lit(False)))
    keep = [q(c) for c in pages.columns]
    none = rows.filter(~F.col(passed)).select(*keep, F.lit(False).alias(out))
    some = rows.filter(passed).withColumn(salt, F.pmod(F.xxhash64(q(key), q(url)), F.lit(SALTS)))
    right = exact.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>"))).withColumn(out, F.lit(True))
    found = some.join(right, [canon, salt], "left").select(*keep, F.coalesce(F.col(out), F.lit(False)).alias(out))
    return none.unionByName(found)


def judge(pages: DataFrame, listed: DataFrame, url: str = "url", key: str = "page_id", rules=RULES) -> DataFrame:
    """key (as page_id), host, path, rule, verdict and listed of every row of ``pages``."""
    narrow = pages.select(q(key).alias("page_id"), q(url).alias("url"))
    rows = on_list(narrow, listed, "url", "page_id", "listed")
    rows = rows.select("page_id", "listed", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("_rule", first_rule(rules, F.col("host"), F.col("path")))
    verdict = F.coalesce("_rule.verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("_rule.name").alias("rule"), verdict.alias("verdict"), "listed")


def url_query(pages: DataFrame) -> DataFrame:
    """Listed are the canonical URLs of all pages of reported hosts; their tracked, ported or ``www.`` forms are found through the
    canonical form."""
    url = F.col("url")
    listed = pages.select(canonical(url).alias("url"), host_of(url).alias("host"))
    return judge(pages, listed.filter(F.col("host").rlike(REPORTED)).select("url"))
