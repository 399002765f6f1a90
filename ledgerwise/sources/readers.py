"""Sources: files read as text with late-bound column names, coerced and checked; bad values become null or go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, header: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """Every column as text; names trimmed and lower-cased."""
    df = spark.read.csv(path, header=header, inferSchema=False, encoding=encoding, quote='"', escape='"')
    return df.toDF(*(c.replace("﻿", "").strip().lower() for c in df.columns))


def resolve(df: DataFrame, candidates: dict[str, list[str]], required: tuple[str, ...] = ()) -> DataFrame:
    """The first candidate name that is there for each logical column; missing ones are null, or an error if required."""
    have, out = set(df.columns), []
    for name, options in candidates.items():
        found = next((c for c in options if c.lower() in have), None)
        if found is None and name in required:
            raise ValueError(f"no column for {name}: {', '.join(options)}")
        out.append((F.col(f"`{found.lower()}`") if found else F.lit(None).cast("string")).alias(name))
    return df.select(*out)


def number(c) -> Column:
    """Text as a double without commas and dollar signs; what isn't a finite number is null."""
    out = F.regexp_replace(F.trim(F.col(c)), r"[$,]", "").try_cast("double")
    return F.when(~F.isnan(out) & (F.abs(out) != float("inf")), out)


PROVIDER = {
    "npi": ["npi", "rndrng_npi"], "last_name": ["last_name", "rndrng_prvdr_last_org_name"], "first_name": ["first_name", "rndrng_prvdr_first_name"],
    "specialty": ["specialty", "rndrng_prvdr_type"], "state": ["state", "rndrng_prvdr_state_abrvtn"], "city": ["city", "rndrng_prvdr_city"],
    "total_services": ["total_services", "tot_srvcs"], "total_beneficiaries": ["total_beneficiaries", "tot_benes"],
    "total_payment": ["total_payment", "tot_mdcr_pymt_amt"], "procedure_types": ["procedure_types", "tot_hcpcs_cds"],
}


def provider_file(spark: SparkSession, path: str) -> DataFrame:
    """Provider totals: ten-digit ids and payments above 0 only."""
    df = resolve(read_csv(spark, path), PROVIDER, ("npi", "total_payment", "total_services"))
    df = df.withColumn("npi", F.trim("npi")).withColumns({c: number(c) for c in ("total_services", "total_beneficiaries", "total_payment", "procedure_types")})
    return df.where(F.col("npi").rlike(r"^\d{10}$") & (F.col("total_payment") > 0) & F.col("total_services").isNotNull())


LINE = {
    "npi": ["npi", "rndrng_npi"], "hcpcs_code": ["hcpcs_code", "hcpcs_cd"], "description": ["description", "hcpcs_desc"], "place": ["place", "place_of_srvc"],
    "beneficiaries": ["beneficiaries", "tot_benes"], "services": ["services", "tot_srvcs"], "avg_charge": ["avg_charge", "avg_sbmtd_chrg"], "avg_allowed": ["avg_allowed", "avg_mdcr_alowd_amt"], "avg_payment": ["avg_payment", "avg_mdcr_pymt_amt"],
}


def billing_file(spark: SparkSession, path: str, year: int, keys: DataFrame | None = None) -> DataFrame:
    """Procedure lines with total_payment = services x average payment above 0, of the providers in keys."""
    df = resolve(read_csv(spark, path), LINE, ("npi", "hcpcs_code", "services", "avg_payment"))
    df = df.withColumns({c: number(c) for c in ("beneficiaries", "services", "avg_charge", "avg_allowed", "avg_payment")})
    df = df.withColumns({"npi": F.trim("npi"), "hcpcs_code": F.substring(F.upper(F.trim("hcpcs_code")), 1, 10), "year": F.lit(year), "total_payment": F.col("services") * F.col("avg_payment")})
    df = df.where("total_payment > 0")
    return df if keys is None else df.join(keys.select("npi").distinct(), "npi", "left_semi")


def exclusion_file(spark: SparkSession, path: str, strict: bool = False, encoding: str = "ISO-8859-1") -> DataFrame:
    """Exclusions still in force. strict: ids begin with 1 or 2 as well; else any ten digits but all zeros."""
    df = read_csv(spark, path, encoding=encoding)
    df = df.select(*(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in df.columns))
    valid = F.col("npi").rlike(r"^[12]\d{9}$") if strict else F.col("npi").rlike(r"^\d{10}$") & (F.col("npi") != "0000000000")
    return df.where(valid & (F.col("reindate").isNull() | F.col("reindate").isin("", "0", "00000000")))


REGISTRY = {
    "npi": ["npi"], "entity_type": ["entity type code"], "enumeration_date": ["provider enumeration date"], "is_sole_proprietor": ["is sole proprietor"],
    "taxonomy_primary": ["healthcare provider taxonomy code_1"], "street": ["provider first line business practice location address"], "city": ["provider business practice location address city name"],
    "state": ["provider business practice location address state name"], "zip": ["provider business practice location address postal code"],
}


def registry_file(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """Few columns of a wide file (the reader prunes the rest), of the providers in keys."""
    df = resolve(read_csv(spark, path), REGISTRY, ("npi",))
    return df if keys is None else df.join(keys.select("npi").distinct(), "npi", "left_semi")


UPDATE = {
    "npi": ["npi"], "entity_type": ["entity type code"], "credential": ["provider credential text"], "taxonomy_code": ["healthcare provider taxonomy code_1"], "enrollment_date": ["provider enumeration date"],
}


def registry_updates(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Registry columns of the known providers, cut to what the table holds (20 and 10 characters), the date as one; blanks and bad dates are null."""
    df = resolve(read_csv(spark, path), UPDATE, ("npi",))
    text = lambda c, n=None: F.nullif(F.substring(F.trim(c), 1, n) if n else F.trim(c), F.lit(""))
    day = F.try_to_timestamp(F.trim("enrollment_date"), F.lit("MM/dd/yyyy")).cast("date")
    out = df.select(F.trim("npi").alias("npi"), text("entity_type").alias("entity_type"), text("credential", 20).alias("credential"), text("taxonomy_code", 10).alias("taxonomy_code"), day.alias("enrollment_date"))
    return out.join(keys.select("npi").distinct(), "npi", "left_semi")


def changed_files(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """(path, sha256, change): files that known(path, sha256) doesn't have, or has with another digest."""
    old = known.select("path", F.col("sha256").alias("_old"))
    out = file_digests(spark, path).join(old, "path", "left").where("_old IS NULL OR _old <> sha256")
    return out.select("path", "sha256", F.when(F.col("_old").isNull(), "new").otherwise("changed").alias("change"))


def pair_file(spark: SparkSession, path: str, least: int = 11) -> DataFrame:
    """Shared-patient pairs, with or without a header; ids get their leading zeros back, loops and weak pairs go."""
    from ..functions.columns import zero_filled

    df = spark.read.csv(path, header=False, inferSchema=False).toDF("source", "target", "pairs", "shared", "same_day")
    df = df.where(F.trim("source").rlike(r"^\d+$"))  # a header has no number here
    df = df.select(zero_filled("source").alias("source"), zero_filled("target").alias("target"), *(number(c).cast("long").alias(c) for c in ("pairs", "shared", "same_day")))
    return df.where((F.col("source") != F.col("target")) & (F.col("shared") >= least))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256): whether a file has changed."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def latest_snapshot(manifest: DataFrame, as_of: str, back: int = 6) -> DataFrame:
    """manifest(month date) -> the latest month up to as_of, at most `back` months earlier."""
    day = F.trunc(F.lit(as_of).cast("date"), "month")
    return manifest.where((F.col("month") <= day) & (F.col("month") >= F.add_months(day, -back))).agg(F.max("month").alias("month"))
