"""Benchmark decontamination by winnowing: fingerprints of texts and items are joined, hits extended.

Native DataFrame code only. The fingerprint of a run of `window` words is the least hash of the grams
(of `gram` words) within it, so two texts that share a run of that length share its fingerprint, wherever
it stands. A text's grams are generated from its array of words inside one code-generated stage; a blocked
Bloom filter of the items' fingerprints (of bounded size) lets few of them out of it. Of these, the runs
whose least gram it is are kept, and only they are shuffled. A join on the fingerprint and the run's words
makes each hit exact, and overlapping runs are joined to spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ascii_lower, written
from .url_filter import bloom_blocks, blocked_bloom, possible_hits

#: Between two words: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ is a word, after A-Z have been lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fingerprint of the row that a text always has (position 0), so that its word count is known.
SUMMARY = 0


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def _gram(at: Column, size: int) -> Column:
    """Hash of the `size` words from position `at`, counted from 1."""
    return F.xxhash64(*(F.get("words", at - 1 + j) for j in range(size)))


def _fingerprint(sizes: list[int], gram: int) -> Column:
    """The least gram hash of the run of `length` words at `at`; grams are as long as the run if that is shorter."""
    def least(size: int) -> Column:
        return F.array_min(F.transform(F.sequence(F.col("at"), F.col("at") + F.col("length") - size), lambda p: _gram(p, size)))

    out = F.lit(None).cast("long")
    for size in sizes:
        out = F.when(F.least(F.col("length"), F.lit(gram)) == size, least(size)).otherwise(out)
    return out


def _run(rows: DataFrame) -> Column:
    return F.array_join(F.slice(F.col("words"), F.col("at"), F.col("length")), " ")


def benchmark_hits(docs: DataFrame, items: DataFrame, window: int = 10, gram: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """documents x items(item_id, text) -> (doc_id, n_words, n_hit, spans, item_ids), a row for each row.

    A run is `window` consecutive words of an item; an item of fewer words, but not none, is one run.
    A document's word is hit inside any occurrence of a run. spans: array of (from, to), word positions
    from 0, `to` not included, joined where runs overlap or touch; item_ids: the items with occurring
    runs as strings, sorted as strings. Null and empty texts have no words and no hits; null item texts
    or ids are left out; repeated items and rows change nothing but the rows given back. Texts of any length are judged
    whole: their words are an array of one row. Without items nothing is hit; no documents give no rows. Other columns,
    whatever their names, are ignored.
    """
    listed = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), words_of(F.col(item_text_col)).alias("words"))
    listed = listed.where(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(window)))
    listed = listed.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)))
    runs = listed.select("item", "length", _fingerprint(list(range(1, gram + 1)), gram).alias("fp"), _run(listed).alias("run"))
    runs = written(runs.distinct(), "runs")
    kinds = written(runs.select("fp", "run").distinct(), "kinds")
    lengths = sorted(r[0] for r in runs.select("length").distinct().collect()) or [window]  # at most `window` values
    sizes = sorted({min(gram, x) for x in lengths})
    blocks = bloom_blocks(kinds.count() + 1)
    keys = kinds.select("fp").unionByName(docs.sparkSession.range(SUMMARY, SUMMARY + 1).withColumnRenamed("id", "fp"))

    # rows with the same id and text have the same hits
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("tag"), words_of(F.col(text_col)).alias("words"))
    n = F.size("words")
    rows = rows.withColumn("spot", F.explode(F.sequence(F.lit(0), n)))
    if len(sizes) > 1:
        rows = rows.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).where((F.col("spot") > 0) | (F.col("size") == sizes[-1]))
    else:
        rows = rows.withColumn("size", F.lit(sizes[0]))
    rows = rows.where((F.col("spot") == 0) | (F.col("spot") + F.col("size") <= n + 1))
    fp = F.when(F.col("spot") == 0, F.lit(SUMMARY).cast("long"))
    for size in sizes[:-1]:
        fp = fp.when(F.col("size") == size, _gram(F.col("spot"), size))
    rows = rows.withColumn("fp", fp.otherwise(_gram(F.col("spot"), sizes[-1])))
    passed = possible_hits(rows, "fp", blocked_bloom(keys, "fp", blocks), blocks)
    # the runs that hold the gram and have it as their least
    fit = F.filter(F.array(*map(F.lit, lengths)), lambda x: F.least(x, F.lit(gram)) == F.col("size"))
    passed = passed.withColumn("length", F.explode(F.when(F.col("spot") == 0, F.array(F.lit(0))).otherwise(fit)))
    first = F.greatest(F.lit(1), F.col("spot") - (F.col("length") - F.col("size")))
    last = F.least(F.col("spot"), n - F.col("length") + 1)
    starts = F.when(F.col("spot") == 0, F.array(F.lit(0))).when(first <= last, F.sequence(first, last))
    passed = passed.withColumn("at", F.explode(starts)).where((F.col("at") == 0) | (_fingerprint(sizes, gram) == F.col("fp")))
    passed = passed.select("id", "tag", "at", "length", "fp", F.when(F.col("at") == 0, n).alias("n"), F.when(F.col("at") > 0, _run(passed)).alias("run"))
    passed = written(passed, "passed")
    summary = passed.where("at = 0").select("id", "tag", F.col("n").cast("long").alias("n_words"))
    hits = written(passed.where("at > 0").join(kinds, ["fp", "run"]).select("id", "tag", "at", "length", "run"), "hits")

    # overlapping and touching runs of a text as one span
    ends = hits.select("id", "tag", (F.col("at") - 1).alias("lo"), (F.col("at") - 1 + F.col("length")).alias("hi")).distinct()
    by = Window.partitionBy("id", "tag").orderBy("lo", "hi")
    ends = ends.withColumn("new", F.coalesce(F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1)) < F.col("lo"), F.lit(True)))
    ends = ends.withColumn("span", F.sum(F.col("new").cast("int")).over(by))
    spans = ends.groupBy("id", "tag", "span").agg(F.min("lo").alias("from"), F.max("hi").alias("to"))
    spans = spans.groupBy("id", "tag").agg(F.sum(F.col("to") - F.col("from")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("from", "to"))).alias("spans"))
    found = hits.select("id", "tag", "run").distinct().join(runs.select("run", "item"), "run").select("id", "tag", "item").distinct()
    found = found.groupBy("id", "tag").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    told = spans.join(found.withColumnsRenamed({"id": "id2", "tag": "tag2"}), F.col("id").eqNullSafe(F.col("id2")) & (F.col("tag") == F.col("tag2")))
    told = told.select(F.col("id").alias("id1"), F.col("tag").alias("tag1"), "n_hit", "spans", "item_ids")
    out = summary.join(told, F.col("id").eqNullSafe(F.col("id1")) & (F.col("tag") == F.col("tag1")), "left")
    none = F.array().cast("array<string>")
    return out.select(
        F.col("id").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<from:int,to:int>>")).alias("spans"), F.coalesce("item_ids", none).alias("item_ids"))
