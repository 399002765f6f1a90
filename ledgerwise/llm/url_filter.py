"""URL lists: a blocked Bloom filter passes possible hits to an exact hash join.

Native DataFrame code only. The filter is a table of 256-bit blocks, one row each; its number of rows
has a fixed bound, so it may be broadcast at any size of the list. Beyond that bound more candidates
pass, and the exact join still removes every false positive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, written

#: Bits a listed key gets, and the most blocks a broadcast filter has: 32 MB of bits, some 150 MB as a table of rows that Spark joins by hash.
BITS_PER_KEY, MAX_BLOCKS, PROBES = 24, 1 << 20, 8

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host_and_path(url):
    """(host, path) columns; both empty for null or a url without `://`."""
    url = F.coalesce(url, F.lit(""))
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(url, parts, 1)), F.regexp_extract(url, parts, 2)


def bloom_blocks(keys: int) -> int:
    return max(1, min(MAX_BLOCKS, -(-keys * BITS_PER_KEY // 256)))


def _spot(key, blocks: int):
    """(block, bit positions) of a key: two independent hashes, two bits in each of the four words of one block."""
    second = F.xxhash64(key, F.lit(0x5EED))
    return F.pmod(F.xxhash64(key), F.lit(blocks)), [F.shiftrightunsigned(second, 8 * i).bitwiseAND(F.lit(255)) for i in range(PROBES)]


def _words(bits):
    """Four 64-bit words: word w has the bits at positions 2w and 2w + 1 of the list (modulo 64)."""
    one = F.lit(1).cast("long")
    at = [F.call_function("shiftleft", one, b.bitwiseAND(F.lit(63)).cast("int")) for b in bits]
    return [at[2 * w].bitwiseOR(at[2 * w + 1]) for w in range(4)]


def blocked_bloom(keys: DataFrame, key_col: str, blocks: int) -> DataFrame:
    """(block, w0..w3): at most `blocks` rows; merged by bit_or, with partial aggregation in each task."""
    block, bits = _spot(F.col(key_col), blocks)
    rows = keys.where(F.col(key_col).isNotNull()).select(block.alias("block"), *(w.alias(f"w{i}") for i, w in enumerate(_words(bits))))
    return rows.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)))


def possible_hits(probes: DataFrame, key_col: str, bloom: DataFrame, blocks: int, keep: bool = False) -> DataFrame:
    """Rows of probes whose key may be listed; none that is listed is lost. keep: all rows, and a boolean `maybe`."""
    block, bits = _spot(F.col(key_col), blocks)
    mine = probes.withColumn("_bloom_at", block).withColumns({f"_bloom_m{i}": w for i, w in enumerate(_words(bits))})
    own = bloom.select(F.col("block").alias("_bloom_block"), *(F.col(f"w{i}").alias(f"_bloom_w{i}") for i in range(4)))
    hit = mine.join(F.broadcast(own), F.col("_bloom_at") == F.col("_bloom_block"), "left" if keep else "inner")
    inside = F.lit(True)
    for i in range(4):
        inside = inside & (F.col(f"_bloom_w{i}").bitwiseAND(F.col(f"_bloom_m{i}")) == F.col(f"_bloom_m{i}"))
    if keep:
        return hit.select(*probes.columns, F.coalesce(inside, F.lit(False)).alias("maybe"))
    return hit.where(inside).select(*probes.columns)


def without(rows: DataFrame, listed: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id isn't in listed(id); only possible hits of the list's Bloom filter are shuffled. Null ids stay.

    The column of rows may be of any kind that can be hashed: where ids may be null or repeated, a digest of the text.
    """
    keys = written(listed.where("id IS NOT NULL").select("id").distinct(), "listed")
    blocks = bloom_blocks(keys.count())
    told = possible_hits(rows, id_col, blocked_bloom(keys, "id", blocks), blocks, keep=True)
    maybe = told.where("maybe").drop("maybe")
    maybe = maybe.join(keys, maybe[id_col] == keys["id"], "left_anti")
    return told.where("NOT maybe").drop("maybe").unionByName(maybe)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """pages x rules(host, path, verdict) -> (page_id, host, path, rule, verdict), one row per row of pages.

    A rule fits its host and subdomains when the path starts with the rule's; the longest host + path
    wins, ties to the smaller rule string, then the smaller verdict. A url that no rule fits, a null or
    an empty one gets `default` and a null rule. A list of plain canonical URLs is a rule table whose
    paths are whole. Rules with a null host or path are left out; no rules, or no pages, are fine; repeated
    pages keep all their rows; urls of any length are read whole; other columns are ignored.
    """
    listed = rules.where("host IS NOT NULL AND path IS NOT NULL").select(ascii_lower(F.col("host")).alias("host"), "path", "verdict")
    listed = listed.withColumn("key", F.concat("host", F.lit("\n"), "path")).groupBy("key").agg(
        F.min("host").alias("r_host"), F.min("path").alias("r_path"), F.min("verdict").alias("r_verdict"))
    labels = F.length("r_host") - F.length(F.replace("r_host", F.lit("."))) + 1
    # how many different ones there are is bound by the longest rule's length, not by the number of rules
    n, lengths, counts = listed.agg(F.count("*"), F.array_sort(F.collect_set(F.length("r_path"))), F.array_sort(F.collect_set(labels))).first()
    blocks = bloom_blocks(n)
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if n:
        # a url's candidates: the host's ends of as many labels as a rule's host has, each with each listed length of path
        labels = F.length("host") - F.length(F.replace("host", F.lit("."))) + 1
        ends = F.array_compact(F.array(*(F.when(labels >= k, F.substring_index("host", ".", -k)) for k in counts)))
        seen = urls.where("host <> ''").select("host", "path", F.explode(ends).alias("suffix"))
        fit = F.filter(F.array(*(F.lit(x) for x in lengths)), lambda k: k <= F.length("path"))
        seen = seen.select("host", "path", "suffix", F.explode(fit).alias("k"))
        seen = seen.select("host", "path", F.concat("suffix", F.lit("\n"), F.expr("substring(path, 1, k)")).alias("key"))
        hits = possible_hits(seen, "key", blocked_bloom(listed, "key", blocks), blocks).distinct()
        rule = F.concat("r_host", "r_path")
        best = F.min_by(F.struct(rule.alias("rule"), F.col("r_verdict").alias("verdict")), F.struct((-F.length(rule)).alias("long"), rule.alias("rule")))
        ruled = hits.join(listed, "key").groupBy("host", "path").agg(best.alias("best"))
        # a table, not an aggregate: Spark splits the partition of a url that many pages have only then
        ruled = written(ruled.select(F.col("host").alias("b_host"), F.col("path").alias("b_path"), "best"), "ruled")
        none = urls.where("host = ''").select("*", F.lit(None).cast(ruled.schema["best"].dataType).alias("best"))  # no rule fits; they needn't join
        some = urls.where("host <> ''")
        some = some.join(ruled, (some.host == ruled.b_host) & (some.path == ruled.b_path), "left").select("page_id", "host", "path", "best")
        return none.unionByName(some).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
