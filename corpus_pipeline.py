"""A corpus pipeline out of the operators in ledgerwise.llm; each stage's rows are written and read again.

Every stage but the last takes and gives rows with the columns of documents (doc_id, text, lang, source, n_chars),
and hands on whatever other columns there are; an empty table goes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwise.llm import decontamination, language_id, near_dedup, packing, substring_dedup
from ledgerwise.llm.shared import dropped, written, written_within
from ledgerwise.llm.url_filter import without


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the corpus teaches.

    Rejected are texts without a letter (null and empty ones, too), and those whose decoded language doesn't know
    them: fewer than FOREIGN_SHARE of their trigrams occur in that language's training texts. Texts of fewer than
    FOREIGN_GRAMS trigrams are too short to tell and stay; so do ambiguous ones. Where no row has a label to learn
    from, no language is decoded and all texts with a letter stay. Ids may be null or repeated: each row is judged alone.
    """
    others = tuple(c for c in docs.columns if c != "doc_id")
    more = [f"_d{i}" for i in range(len(others))]  # names that can't clash with the operator's own columns
    renamed = docs.select("doc_id", *(F.col(c).alias(m) for c, m in zip(others, more, strict=True)))
    of = dict(zip(others, more, strict=True))
    found = language_id.identify(renamed, keep=tuple(more), letter="_letter", text_col=of["text"], lang_col=of["lang"])
    found = found.where("_letter AND NOT foreign").select("doc_id", *more)
    return found.withColumnsRenamed(dict(zip(more, others, strict=True))).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id: five words, similarity 0.8 or more.

    Rows with one id are one document and stay or go together; a row with a null id has no group and stays.
    """
    groups = written(near_dedup.near_duplicates(docs, k=5, percent=80), "groups")
    return without(docs, groups.where("NOT kept").select(F.col("doc_id").alias("id")), "doc_id")


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 13 words that a document with a smaller id has; documents of nothing else go.

    n_chars is counted anew where words went. Rows with one id don't cut each other; a null id counts as the largest.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    more = [f"_d{i}" for i in range(len(others))]
    renamed = docs.select("doc_id", "text", *(F.col(c).alias(m) for c, m in zip(others, more, strict=True)))
    cut = substring_dedup.cut_repeats(renamed, k=13, keep=tuple(more)).where("n_removed = 0 OR n_removed < n_words")
    cut = cut.select("doc_id", "text", F.col("n_removed").alias("_removed"), *more).withColumnsRenamed(dict(zip(more, others, strict=True)))
    if "n_chars" in others:
        cut = cut.withColumn("n_chars", F.when(F.col("_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten words in a row with a benchmark item.

    Texts are judged, by their SHA-256, so rows with null or repeated ids go or stay by their own text.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = docs.withColumn("_text_key", F.unhex(F.sha2("text", 256)))
    hits = decontamination.benchmark_hits(keyed, items, window=10, id_col="_text_key").where("n_hit > 0")
    return without(keyed, hits.select(F.col("doc_id").alias("id")), "_text_key").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 tokens along the Hilbert curve, as op4 gives them; every row is a document of its own.

    A null text is an empty one, of one id; null and repeated ids are handed on. Texts whose keys tie lie in the order
    of the table.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), length=2048, end_id=1)


STAGES: list = [
    ("language ID", identified),
    ("MinHash near-dedup", one_of_each),
    ("substring dedup", unrepeated),
    ("benchmark decontamination", decontaminated),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole documents table.

    A stage's table is deleted once the next one is written, and so is what a stage has written on its way. Nulls, ties
    and repeated rows are what each stage says of them; a table without documents gives no pieces.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with written_within() as made:
            docs = stage(spark, docs, sf_dir)
        docs = written(docs, f"stage-{name.replace(' ', '_')}")
        dropped(*made, *([last] if last is not None else []))
        last = docs
    return docs
