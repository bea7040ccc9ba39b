"""URL filters: a blocked Bloom filter over listed canonical URLs, then an exact hash join for its possible hits.

A listed entry is a key `host + path`: it names a page, or, if its path ends in "/", all pages below that path on the host
and on its subdomains. A URL has few keys that could be listed: each suffix of its host at a dot, with each prefix of its
path that ends in "/" and with the whole path, none longer than the list's longest. Each key is tested against the Bloom filter; keys that pass are joined with
the list itself, so false positives don't stay, and the longest listed key of a URL wins.

The filter is a table of blocks of 256 bits: a key's hash chooses one block and `BITS` bits of it. It has 16 bits a listed
key and MOST_BLOCKS blocks at most (2 MB), so it is broadcast whatever the list; a longer list lets more others pass, which the
exact join takes off. Keys are made and tested where a page is read: only possible hits are shuffled.

Nulls: a null URL, or one without "://", has an empty host and path, no key and no rule. A null in the list is left out.
Repeated URLs are judged each; repeated list entries count once (block wins if both verdicts are listed for one key).
Columns of the pages pass through unchanged, but for those named host, path, rule or verdict, which the new ones replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import common

BLOCK_BITS, BITS, BITS_PER_KEY, MOST_BLOCKS = 256, 8, 16, 1 << 16


def host_of(url: Column) -> Column:
    """After the first "://", up to "/", "?", "#" or the end, with A-Z in lower case."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to "?", "#" or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """The key under which a page is listed: host and path."""
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url)))


def reach_of(listed: DataFrame, key: str = "key") -> tuple[int, int, int]:
    """The most labels of a listed host, "/" of a listed path, and characters of one: longer ones can't be listed."""
    host = F.substring_index(key, "/", 1)
    path = F.substr(F.col(key), F.length(host) + 1)
    found = listed.agg(F.max(F.size(F.split(host, r"\."))), F.max(F.length(path) - F.length(F.replace(path, F.lit("/")))), F.max(F.length(path))).first()
    return tuple(x or 0 for x in found)


def keys_of(host: Column, path: Column, reach: tuple[int, int, int]) -> Column:
    """The keys that could list a page, as an array: of no more labels, "/" and characters than the list reaches.

    So a URL costs its length and a few keys of bounded length, however many labels or segments it has.
    """
    most_labels, most_slashes, most_chars = reach
    if not most_labels:
        return F.array().cast("array<string>")
    hosts = F.transform(F.sequence(F.lit(1), F.lit(most_labels)), lambda i: F.call_function("substring_index", host, F.lit("."), -i))
    head = F.substring(path, 1, most_chars)
    slashes = F.least(F.length(head) - F.length(F.replace(head, F.lit("/"))), F.lit(most_slashes))
    below = F.when(slashes > 0, F.transform(F.sequence(F.lit(1), slashes), lambda i: F.concat(F.call_function("substring_index", head, F.lit("/"), i), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    paths = F.array_distinct(F.concat(below, F.when(F.length(path) <= most_chars, F.array(path)).otherwise(F.array().cast("array<string>"))))
    found = F.flatten(F.transform(F.array_distinct(hosts), lambda h: F.transform(paths, lambda p: F.concat(h, p))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(found)


def _bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key, and the four 64-bit words of its mask."""
    h, g = F.xxhash64(key), F.xxhash64(F.lit(1), key)
    block = F.pmod(h, F.lit(blocks))
    places = [F.shiftrightunsigned(g, 8 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(BITS)]
    words = []
    for w in range(BLOCK_BITS // 64):
        mask = F.lit(0).cast("long")
        for p in places:
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)).cast("int"))
            mask = mask.bitwiseOR(F.when(F.shiftright(p, 6) == w, bit).otherwise(F.lit(0).cast("long")))
        words.append(mask)
    return block, words


def bloom(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter of a column of keys: one row for each block with any bit set."""
    block, words = _bits(F.col(key), blocks)
    rows = keys.select(block.alias("b_block"), *[w.alias(f"b_w{i}") for i, w in enumerate(words)])
    return rows.groupBy("b_block").agg(*[F.bit_or(f"b_w{i}").alias(f"b_w{i}") for i in range(len(words))])


def block_count(keys: DataFrame) -> int:
    """Blocks for BITS_PER_KEY bits a key, MOST_BLOCKS at most: a power of two."""
    return min(MOST_BLOCKS, 1 << max(0, (keys.count() * BITS_PER_KEY // BLOCK_BITS)).bit_length())


def possible(rows: DataFrame, key: str, keys: DataFrame, listed_key: str) -> DataFrame:
    """Rows whose key the Bloom filter of keys lets pass: all listed ones, and few others."""
    blocks = block_count(keys)
    block, words = _bits(F.col(key), blocks)
    test = rows.select("*", block.alias("b_probe"), *[w.alias(f"p_w{i}") for i, w in enumerate(words)])
    hit = F.lit(True)
    for i in range(len(words)):
        hit = hit & (F.col(f"b_w{i}").bitwiseAND(F.col(f"p_w{i}")) == F.col(f"p_w{i}"))
    filter_ = F.broadcast(bloom(keys, listed_key, blocks))  # MOST_BLOCKS rows of five longs
    return test.join(filter_, F.col("b_probe") == F.col("b_block")).filter(hit).select(rows.columns)


def judge(pages: DataFrame, listed: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule, verdict behind their own columns; columns of those names make way for them.

    listed: columns key (host + path) and verdict. rule is the longest listed key that fits the URL (ties can't be: keys of
    equal length that fit one URL differ in host and path, and the longer host wins), verdict its verdict, or default.
    """
    listed = listed.filter(F.col("key").isNotNull() & F.col("verdict").isNotNull()).groupBy("key").agg(F.max("verdict").alias("rule_verdict"))
    reach = reach_of(listed)
    urls = pages.select(F.col(url).alias("u")).filter(F.col("u").contains("://"))
    asked = urls.select("u", F.explode(F.array_distinct(keys_of(host_of(F.col("u")), path_of(F.col("u")), reach))).alias("k"))
    fits = possible(asked, "k", listed, "key").join(listed, F.col("k") == F.col("key"))
    order = F.struct(F.length("key").alias("n"), F.length(F.substring_index("key", "/", 1)).alias("h"), F.col("key"), F.col("rule_verdict"))
    of, best = common.fresh(pages, "_url"), common.fresh(pages, "_best")
    found = fits.groupBy(F.col("u").alias(of)).agg(F.max(order).alias(best))
    own = [F.col(c) for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]

    def judged(rows: DataFrame, key: Column, verdict: Column) -> DataFrame:
        return rows.select(*own, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), key.alias("rule"), F.coalesce(verdict, F.lit(default)).alias("verdict"))

    # pages without a host, however many, stay out of the join
    hosted = F.coalesce(F.col(url).contains("://"), F.lit(False))
    joined = pages.filter(hosted).join(found, F.col(url) == F.col(of), "left")
    none = F.lit(None).cast("string")
    return judged(joined, F.col(f"{best}.key"), F.col(f"{best}.rule_verdict")).unionByName(judged(pages.filter(~hosted), none, none))
