"""Searches that don't scan: a full-text index of stems, and a trigram index that narrows substring searches.

Both are tables of postings in hash buckets (sources/buckets.py), so a search reads the buckets of the asked terms, and
a change of some rows rewrites the buckets of the terms that these rows had or have.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.english import STOP_WORDS, stem, stems
from ..sources.buckets import Buckets

WORD = r"[\p{L}\p{N}]+"
#: What a place of each weight class counts. Fixed values.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
#: The limit of 1 + 1/4 + 1/9 + ..., the most that the places of one term come to.
_LIMIT = 1.64493406685


def _lowered(column: str) -> Column:
    return F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))


def postings(rows: DataFrame, id_col: str, fields: dict[str, str], english: bool = True) -> DataFrame:
    """(term, id, weight, places): where each row has each term; a field's words come after those of the fields before it.

    fields: column -> weight class, A to D. Words are runs of letters and digits in lower case; english: as stems,
    without stop words, which keep their places. Null fields have no words, rows with a null id aren't indexed.
    """
    def weighed(column: str, weight: str) -> Column:
        found = F.regexp_extract_all(_lowered(column), F.lit(WORD), F.lit(0))
        return F.transform(found, lambda w: F.struct(w.alias("term"), F.lit(weight).alias("weight")))

    each = [weighed(c, k) for c, k in fields.items()]
    words = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(F.concat(*each)).alias("at", "w")).select("id", "w.*", (F.col("at") + 1).alias("at"))
    if english:
        words = words.withColumn("term", stems("term")).where("term IS NOT NULL")
    return words.groupBy("term", "id", "weight").agg(F.array_sort(F.collect_list("at")).alias("places"))


def text_index(spark: SparkSession, path: str, n: int = 64) -> Buckets:
    """Buckets by term; the rows of a frequent term are dealt to several files by id."""
    return Buckets(path, ("term",), n, split=("id",))


def query_terms(text: str, english: bool = True) -> list[str]:
    import regex

    words = regex.findall(WORD, text.lower())
    return sorted({stem(w) for w in words if w not in STOP_WORDS} if english else set(words))


def _asked(index: Buckets, spark: SparkSession, column: str, terms: Sequence[str]) -> DataFrame:
    keys = spark.createDataFrame([(t,) for t in terms], f"{column} string")
    return index.some(spark, index.numbers(keys)).where(F.col(column).isin(list(terms)))


def rank(places: Column) -> Column:
    """What one term's places come to: the heaviest counts whole, the j-th one its weight / j^2; 1 at most."""
    weight = F.transform(places, lambda x: x["w"])
    best = F.array_max(weight)
    first = F.array_position(weight, best).cast("double")
    parts = F.aggregate(F.transform(weight, lambda w, j: w / F.pow(j + 1, F.lit(2))), F.lit(0.0), lambda a, b: a + b)
    return (best + parts - best / F.pow(first, F.lit(2))) / _LIMIT


def text_search(index: Buckets, spark: SparkSession, text: str, english: bool = True, every: bool = True) -> DataFrame:
    """(id, terms, rank) of the rows that have all terms of the text (every=False: any of them).

    rank is the mean over the asked terms of what each one's places come to. A text of stop words alone finds nothing.
    """
    terms = query_terms(text, english)
    if not terms:
        return spark.createDataFrame([], index.table(spark).select("id", F.lit(0).alias("terms"), F.lit(0.0).alias("rank")).schema)
    weight = F.lit(None).cast("double")
    for name, value in WEIGHTS.items():
        weight = F.when(F.col("weight") == name, value).otherwise(weight)
    rows = _asked(index, spark, "term", terms).withColumn("w", weight)
    placed = F.array_sort(F.flatten(F.collect_list(F.transform("places", lambda at: F.struct(at.alias("at"), F.col("w").alias("w"))))))
    each = rows.groupBy("id", "term").agg(placed.alias("placed")).withColumn("rank", rank(F.col("placed")))
    found = each.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("terms"), (F.sum("rank") / len(terms)).alias("rank"))
    return found.where(F.col("terms") == len(terms)) if every else found


def refresh_text(index: Buckets, was: DataFrame, now: DataFrame, id_col: str, fields: dict[str, str], english: bool = True) -> list[int]:
    """Brings the index up to date with changed rows: `was` as they were (none for new rows), `now` as they are (none for deleted ones).

    Gives the buckets that were rewritten: those of terms that changed rows had or have.
    """
    return index.replace(postings(was, id_col, fields, english), postings(now, id_col, fields, english), ["term", "id"])


def grams(rows: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """(gram, id): the distinct runs of three characters of each row's columns, in lower case."""
    def of(column: str) -> Column:
        text = _lowered(column)
        runs = F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3)))
        return F.when(F.length(text) >= 3, runs).otherwise(F.array().cast("array<string>"))

    runs = [of(c) for c in columns]
    return rows.where(F.col(id_col).isNotNull()).select(F.explode(F.array_distinct(F.concat(*runs))).alias("gram"), F.col(id_col).alias("id"))


def gram_index(spark: SparkSession, path: str, n: int = 64) -> Buckets:
    return Buckets(path, ("gram",), n, split=("id",))


def query_grams(text: str) -> list[str]:
    """Runs of three that cover the text, without overlap but for the last one; fewer lists to read than all runs."""
    text = text.lower()
    return sorted({text[i : i + 3] for i in [*range(0, len(text) - 2, 3), len(text) - 3]}) if len(text) >= 3 else []


def may_contain(index: Buckets, spark: SparkSession, text: str) -> DataFrame | None:
    """(id): rows that have all runs of the text in some column, a superset of those that contain it; None for texts too short."""
    asked = query_grams(text)
    if not asked:
        return None
    found = _asked(index, spark, "gram", asked).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return found.where(F.col("n") == len(asked)).select("id")


def containing(table: Buckets, index: Buckets, spark: SparkSession, text: str, columns: Sequence[str]) -> DataFrame:
    """The table's rows of which a column contains the text, whatever its case.

    The index gives the rows that may; of the table, bucketed by id, only their buckets are read; and each is checked
    exactly. A text of fewer than three characters is looked for in all rows.
    """
    maybe = may_contain(index, spark, text)
    rows = table.table(spark) if maybe is None else table.lookup(maybe.withColumnRenamed("id", table.keys[0]))
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())), F.lit(False))
    return rows.where(hit)


def refresh_grams(index: Buckets, was: DataFrame, now: DataFrame, id_col: str, columns: Sequence[str]) -> list[int]:
    """As refresh_text, for the trigram index."""
    return index.replace(grams(was, id_col, columns), grams(now, id_col, columns), ["gram", "id"])
