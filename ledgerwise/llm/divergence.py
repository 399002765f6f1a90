"""How far the sources of a language are apart in their words, by corrections to a baseline.

Each group (language and source) gives each of its language's V terms a smoothed share p, counted in billionths and
exact. Two groups' distance is the sum of f = |p - q| over the terms. Where neither group has a term, f is one
constant of the two groups, so every pair starts at V times that constant. The inverted index (term -> groups that
have it, with their shares) then emits only what differs from it, and only where that isn't zero:

* terms of one group, against the other's share of a missing term. These depend on the share alone, so a group's
  terms are counted by share first, and one row for each different share is met with the other groups.
* terms of both groups: what the two corrections above got wrong together, from postings of one term.

Terms that neither group has cost nothing. Sums are of whole numbers, so no order of rows can change them.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .textarrays import LOWER, lean, text_slices

#: Terms are runs of letters A-Z, a-z and everything beyond ASCII; of UTF-8 bytes, that is the same. Fixed value.
TERM = rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Different (group, term) entries that a task gathers before it hands them on.
HELD = 200_000
SCALE, SMOOTHING = 1_000_000_000, 5


def _count_task(held: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(TERM).findall
        times, docs = defaultdict(Counter), defaultdict(Counter)

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in times.items():
                terms = list(found)
                n, of = len(terms), docs[lang, source]
                for at in range(0, n, 1 << 14):
                    some = terms[at : at + (1 << 14)]
                    yield pa.record_batch(
                        [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()).cast(pa.string()), pa.array([found[t] for t in some], pa.int64()), pa.array([of[t] for t in some], pa.int64())],
                        ["lang", "source", "term", "n", "docs"])
            times.clear()
            docs.clear()

        for batch in batches:
            langs, sources = batch.column(0), batch.column(1)
            for lo, hi, data, offsets in text_slices(batch.column(2)):
                lowered = LOWER[data]
                groups = zip(langs.slice(lo, hi - lo).to_pylist(), sources.slice(lo, hi - lo).to_pylist(), strict=True)
                for group, a, z in zip(groups, offsets, offsets[1:], strict=False):
                    terms = find(lowered[a:z].tobytes())
                    if terms:
                        times[group].update(terms)
                        docs[group].update(set(terms))
                if sum(map(len, times.values())) > held:
                    yield from rows()
        yield from rows()

    return lean(task)


def term_counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """(lang, source, text) -> (lang, source, term, n occurrences, docs that have it), counted over whole texts.

    Tasks count ahead, `held` entries at most at a time, so a frequent term of a hot group comes as a few rows a task.
    """
    part = docs.select("lang", "source", "text").mapInArrow(_count_task(held), "lang string, source string, term string, n long, docs long")
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (n + 5) / (total + 5 terms)), in decimals where a long could overflow; null for no terms."""
    top = (n + SMOOTHING).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.when(terms > 0, F.call_function("div", top, (total + SMOOTHING * terms).cast("decimal(20,0)")) + 1)


def audit(docs: DataFrame, min_docs: int = 30, top_terms: int = 50, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """documents -> (lang, source, part, item, value, rank): each source's distance to each other source of its
    language (part `pair`, all of them), and the `top_terms` terms it has more of than its language (part `term`).

    A language keeps the terms that `min_docs` of its documents have. Ranks start at 1, largest value first, ties by the
    item's UTF-8 bytes. Null lang, source and text are empty strings. Repeated rows are documents of their own, whatever
    their ids, which aren't read. A language without kept terms has pairs of distance 0 and no terms; a language of one
    source has no pairs; an empty table gives no rows. Columns of other names are ignored. Texts of any length are
    counted whole, one at a time; a term is held whole, too.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    counts = term_counts(rows)
    # the index: a row for each posting, sorted by nothing; a term's rows share a partition
    index = counts.withColumn("in_lang", F.sum("docs").over(Window.partitionBy("lang", "term"))).where(F.col("in_lang") >= min_docs)
    index = written(index.select("lang", "source", "term", "n"), "postings")

    terms = index.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_n"))
    found = index.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = rows.select("lang", "source").distinct().join(found, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["group_n", "terms", "lang_n"])
    groups = written(groups.withColumn("missing", share(F.lit(0), F.col("group_n"), F.col("terms"))), "groups")

    of_group = groups.select("lang", "source", "group_n", "lang_n", "terms", "missing")
    posted = index.join(of_group, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("group_n"), F.col("terms")))
    pair = _pairs(groups, posted)
    return pair.unionByName(_terms(posted, terms, top_terms))


def _ranked(rows: DataFrame, part: str, top: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def _pairs(groups: DataFrame, posted: DataFrame) -> DataFrame:
    other = groups.select("lang", F.col("source").alias("item"), F.col("missing").alias("q0"))
    apart = lambda a, b: F.abs(F.col(a) - F.col(b))
    # every pair's start; the result has a row for each of these
    start = groups.join(other, "lang").where("source <> item")
    start = start.select("lang", "source", "item", F.coalesce(F.col("terms") * apart("missing", "q0"), F.lit(0)).alias("value"))
    # a group's terms by share: what they add to the pair while the other group is taken to lack them
    shares = posted.groupBy("lang", "source", "missing", "p").agg(F.count(F.lit(1)).alias("times"))
    alone = shares.join(other, "lang").where("source <> item")
    alone = alone.withColumn("value", F.col("times") * (apart("p", "q0") - apart("missing", "q0"))).where("value <> 0").select("lang", "source", "item", "value")
    # terms that both have
    theirs = posted.select("lang", "term", F.col("source").alias("item"), F.col("missing").alias("q0"), F.col("p").alias("q"))
    both = posted.join(theirs, ["lang", "term"]).where("source < item")
    both = both.withColumn("value", apart("p", "q") - apart("p", "q0") - apart("missing", "q") + apart("missing", "q0"))
    both = both.where("value <> 0").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    turned = lambda x: x.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    alone = alone.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    each = start.unionByName(alone).unionByName(turned(alone)).unionByName(both).unionByName(turned(both))
    return _ranked(each.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pair")


def _terms(posted: DataFrame, terms: DataFrame, top: int) -> DataFrame:
    whole = terms.withColumnRenamed("n", "n_lang")
    more = posted.join(whole, ["lang", "term"]).withColumn("q", share(F.col("n_lang"), F.col("lang_n"), F.col("terms"))).where("p > q")
    return _ranked(more.select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")), "term", top)
