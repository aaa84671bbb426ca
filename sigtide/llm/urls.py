"""URL filters: rules by host and path, and a list of canonical URLs behind a blocked Bloom filter.

The filter is a table of 256-bit blocks, four longs each. A URL's hash picks one block and one bit
in each long. The table is built by a grouped ``bit_or`` and, as its size is set by ``bits_per_key``
and the number of listed URLs, broadcast only while it holds at most ``MAX_BLOCKS`` blocks; a larger
one is joined by block. Possible hits go on to an exact hash join that removes false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 12
MAX_BLOCKS = 1 << 20  # 40 bytes each

# fixed values: (action, host, path prefix)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# fixed values: query fields that do not change what a URL names; labels of known spam hosts
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)"
SPAM_HOST = r"(?:^|[.-])(?:spam|pills|casino|farm)(?:[.-]|$)"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Host with A-Z lower-cased; empty for NULL and URLs without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1),
                                  _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Path up to ``?`` or ``#``; empty like the host."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www, path without a closing slash, query without tracking fields.

    NULL where the host is empty. Scheme and fragment are dropped.
    """
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(query, rf"(?:^|&){TRACKING}=[^&]*", "")
    query = F.regexp_replace(query, r"^&+", "")
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    return F.when(host != "", F.concat(
        host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest fitting rule, NULL where none fits. Ties: first in ``rules``."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, name, prefix in reversed(sorted(rules, key=lambda r: -len(r[1] + r[2]))):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        rule, action = F.when(fits, name + prefix).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def _bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block of a key, and one bit per lane."""
    where, bits = F.xxhash64(key, F.lit(1)), F.xxhash64(key, F.lit(2))
    lanes = [F.expr(f"shiftleft(1L, cast(shiftright(_bits, {6 * k}) & 63 as int))") for k in range(4)]
    return F.pmod(where, F.lit(blocks)), [bits, *lanes]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter as a table (_block, _lane0 .. _lane3) of the column ``canonical``."""
    block, (bits, *lanes) = _bits(F.col("canonical"), blocks)
    return listed.select(block.alias("_block"), bits.alias("_bits")).select(
        "_block", *[x.alias(f"_lane{k}") for k, x in enumerate(lanes)]).groupBy("_block").agg(
        *[F.bit_or(f"_lane{k}").alias(f"_lane{k}") for k in range(4)])


def listed_hits(urls: DataFrame, listed: DataFrame, bits_per_key: int = BITS_PER_KEY) -> DataFrame:
    """Distinct values of ``urls.canonical`` that are in ``listed.canonical``.

    NULLs are never listed; repeated entries count once. An empty list hits nothing.
    """
    listed = listed.where("canonical is not null").select("canonical").distinct()
    keys = listed.count()
    blocks = max(1, -(-keys * bits_per_key // 256))
    table = bloom(listed, blocks)
    if blocks <= MAX_BLOCKS:
        table = F.broadcast(table)
    block, (bits, *lanes) = _bits(F.col("canonical"), blocks)
    passed = urls.where("canonical is not null").select(
        "canonical", block.alias("_block"), bits.alias("_bits")).join(table, "_block")
    for k, lane in enumerate(lanes):
        passed = passed.where(lane.bitwiseAND(F.col(f"_lane{k}")) != 0)
    return passed.select("canonical").distinct().join(listed, "canonical", "left_semi")


def spam_list(pages: DataFrame, url: str = "url") -> DataFrame:
    """The list of the query: canonical URLs of all pages on hosts with a spam label, and of pages
    that share one canonical URL under two or more schemes or spellings (link farms)."""
    rows = pages.select(canonical(F.col(url)).alias("canonical"), host_of(F.col(url)).alias("h"),
                        F.col(url).alias("u")).where("canonical is not null")
    return rows.groupBy("canonical").agg(
        F.max(F.col("h").rlike(SPAM_HOST)).alias("spam"), F.min("u").alias("a"),
        F.max("u").alias("b")).where("spam or a <> b").select("canonical")


def judge(pages: DataFrame, listed: DataFrame, url: str = "url", rules: tuple = RULES,
          prefix: str = "") -> DataFrame:
    """The rows of ``pages`` with host, path, rule and verdict.

    The verdict is the rule's; without a rule it is ``block`` for listed canonical URLs, else
    ``allow``. NULL URLs have an empty host and path, no rule, and are allowed. Repeated rows keep
    their own verdicts. A new column whose name exists raises; choose a ``prefix``.
    """
    names = [prefix + n for n in ("host", "path", "rule", "verdict")]
    if set(names) & set(pages.columns):
        raise ValueError(f"{sorted(set(names) & set(pages.columns))} exist already, choose a prefix")
    col = pages[url]
    host, path = host_of(col), path_of(col)
    rule, action = rule_of(host, path, rules)
    rows = pages.select("*", host.alias(names[0]), path.alias(names[1]), rule.alias(names[2]),
                        action.alias("_action"), canonical(col).alias("_canonical"))
    hits = listed_hits(pages.select(canonical(col).alias("canonical")), listed).select(
        F.col("canonical").alias("_canonical"), F.lit(True).alias("_hit"))
    return rows.join(hits, "_canonical", "left").select(
        *pages.columns, *names[:3],
        F.coalesce("_action", F.when(F.col("_hit"), "block").otherwise("allow")).alias(names[3]))
