"""Exact percentiles of groups of any size.

Spark's percentile keeps a group's distinct values in one buffer, which a hot group outgrows. Groups of more than `hot`
rows are selected instead, by counted ranges: a range's values are counted in BINS equal parts, with the least and
largest value of each; the part that holds the wanted rank is the next range. Once a range has few values, or one
alone, the rank is read off. Every round is an aggregation over (range, part), combined in the tasks, so no task holds a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import dropped, written

BINS = 1024
#: Groups whose rows are told apart by a broadcast of their keys, at most; more of them are joined by a shuffle.
MOST_KEYS = 100_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_KEYS else df


def percentiles(df: DataFrame, by: Sequence[str], value: str, at: Sequence[float], hot: int = 100_000, few: int = 10_000) -> DataFrame:
    """(by, n, p): the number of values and their percentiles `at` (0 to 1), interpolated as Spark's `percentile` does.

    Nulls and NaN aren't values; a group without values has no row. Null keys are a group as any other. Groups of up to
    `hot` values are aggregated at once, larger ones selected until a range has `few` values.
    """
    rows = df.select(*(F.col(c).alias(f"_b{i}") for i, c in enumerate(by)), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    keys = [f"_b{i}" for i in range(len(by))]
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    large = written(sizes.where(F.col("n") > hot).withColumn("g", F.monotonically_increasing_id()), "large")
    n_large = large.count()
    plain = lambda x: x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile("_v", list(at)).alias("p"))
    named = lambda x: x.select(*(F.col(k).alias(c) for k, c in zip(keys, by, strict=True)), "n", "p")
    if not n_large:
        return named(plain(rows))
    mark = _small(large.select(*(F.col(k).alias(f"l{k}") for k in keys), "g"), n_large)
    marked = rows.join(mark, _on(keys), "left").select(*keys, "_v", "g")
    of_hot = written(marked.where("g IS NOT NULL").select("g", "_v"), "hot")
    # the two ranks that a percentile lies between, from 0, and its part of the way from one to the other
    spot = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    ends = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(up).alias("up"), (F.ceil(spot(p)) if up else F.floor(spot(p))).alias("rank")) for i, p in enumerate(at) for up in (False, True)))
    wanted = large.select("g", "lo", "hi", "n", F.explode(ends).alias("e")).select("g", "lo", "hi", "n", "e.*")
    ranks = _selected(of_hot, written(wanted.select("g", "rank", "lo", "hi", "n").distinct(), "ranks"), few, n_large * len(at) * 2)
    both = wanted.select("g", "i", "up", "rank", "n").join(ranks, ["g", "rank"])
    low, high = F.max(F.when(~F.col("up"), F.col("v"))), F.max(F.when(F.col("up"), F.col("v")))
    share = F.element_at(F.array(*(F.lit(float(p)) for p in at)), F.col("i") + 1) * (F.col("n") - 1)
    each = both.groupBy("g", "i", "n").agg(low.alias("low"), high.alias("high")).withColumn("s", share)
    way = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((F.ceil("s") - F.col("s")) * F.col("low") + (F.col("s") - F.floor("s")) * F.col("high"))
    done = each.withColumn("v", way).groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("p"))
    done = written(large.join(done, "g").select(*keys, "n", "p"), "selected")
    dropped(of_hot)
    return named(plain(marked.where("g IS NULL")).unionByName(done))


def _on(keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"l{k}"))
    return out


def _selected(rows: DataFrame, ranks: DataFrame, few: int, most: int) -> DataFrame:
    """rows(g, _v), ranks(g, rank, lo, hi, n: values of the range) -> (g, rank, v): the value at each rank of its group, from 0.

    `left` is the rank within the range. A range's numbers are a row, whatever it holds; there are `most` ranges at most.
    """
    open_ = ranks.select("g", "rank", F.col("rank").alias("left"), "lo", "hi", "n")
    found = []
    while True:
        open_ = written(open_, "ranges")
        found.append(open_.where("lo = hi").select("g", "rank", F.col("lo").alias("v")))
        wide = open_.where(f"lo < hi AND n > {few}")
        if wide.isEmpty():
            break
        ranges = wide.select(F.col("g").alias("rg"), "lo", "hi").distinct()
        # halves, so that no difference overflows; the ends have parts of their own, so every round narrows a range
        way = F.nanvl(F.try_divide(F.col("_v") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2), F.lit(0.0))
        inner = F.greatest(F.lit(1), F.least(F.lit(BINS - 2), F.floor(F.coalesce(way, F.lit(0.0)) * BINS).cast("int")))
        part = F.when(F.col("_v") == F.col("lo"), 0).when(F.col("_v") == F.col("hi"), BINS - 1).otherwise(inner)
        inside = rows.join(_small(ranges, most), (F.col("g") == F.col("rg")) & F.col("_v").between(F.col("lo"), F.col("hi")))
        bins = inside.groupBy("rg", "lo", "hi", part.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("_v").alias("a"), F.max("_v").alias("z"))
        before = Window.partitionBy("rg", "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        bins = bins.withColumn("upto", F.sum("c").over(before)).withColumnsRenamed({"lo": "blo", "hi": "bhi"})
        hit = (F.col("g") == F.col("rg")) & (F.col("lo") == F.col("blo")) & (F.col("hi") == F.col("bhi")) & (F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("c"))
        narrower = wide.join(bins, hit).select("g", "rank", (F.col("left") - F.col("upto") + F.col("c")).alias("left"), F.col("a").alias("lo"), F.col("z").alias("hi"), F.col("c").alias("n"))
        open_ = narrower.unionByName(open_.where(f"lo < hi AND n <= {few}"))
    rest = open_.where("lo < hi")
    ranges = rest.select(F.col("g").alias("rg"), "lo", "hi").distinct()
    inside = rows.join(_small(ranges, most), (F.col("g") == F.col("rg")) & F.col("_v").between(F.col("lo"), F.col("hi")))
    held = inside.groupBy("rg", "lo", "hi").agg(F.array_sort(F.collect_list("_v")).alias("vs"))  # `few` values at most
    last = rest.join(held.withColumnsRenamed({"lo": "hlo", "hi": "hhi"}), (F.col("g") == F.col("rg")) & (F.col("lo") == F.col("hlo")) & (F.col("hi") == F.col("hhi")))
    out = last.select("g", "rank", F.get("vs", F.col("left").cast("int")).alias("v"))
    for part in found:
        out = out.unionByName(part)
    return out
