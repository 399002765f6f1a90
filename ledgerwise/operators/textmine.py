"""Findings in public-record texts that have been fetched already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import keyword_severity, matched_phrases

#: Legal forms at the end of a company's name. Fixed values.
FORMS = ["inc", "llc", "llp", "lp", "pc", "pllc", "pa", "corp", "corporation", "co", "company", "ltd"]


def strip_forms(name) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    return F.trim(F.regexp_replace(name, rf"(?i)[,.\s]+({'|'.join(FORMS)})\.?\s*$", ""))


#: What a press release tells of criminal actions, and of civil ones. Fixed values.
CRIMINAL = ["sentenced", "convicted", "guilty", "indicted", "arrested", "fraud charges", "criminal"]
CIVIL = ["settlement", "civil monetary penalty", "cmp", "false claims"]


def enforcement_severity(text, criminal: list[str] = CRIMINAL, civil: list[str] = CIVIL) -> Column:
    """critical for a criminal action, adverse for a civil one alone, else warning; phrases count wherever they are, without negation."""
    return keyword_severity(text, [("critical", criminal), ("adverse", civil)], [], default="warning")


#: A press release's card in a page, and what is read from it. Patterns are fixed values.
CARD = r'(?is)<article[^>]*class="[^"]*node--type-press-release[^>]*>(.*?)</article>'
CARD_TITLE = r'(?s)<h2[^>]*>\s*<a[^>]+href="([^"]+)"[^>]*>(.*?)</a>'
CARD_DATE = r'datetime="([0-9]{4}-[0-9]{2}-[0-9]{2})'
CARD_BODY = r'(?s)<div[^>]*class="[^"]*field--name-body[^>]*>(.*?)</div>'


def press_cards(pages: DataFrame, site: str, id_col: str = "page_id", html_col: str = "html", most: int = 400, criminal: list[str] = CRIMINAL, civil: list[str] = CIVIL) -> DataFrame:
    """(id, n, title, url, date, summary, severity): the press releases of each page, in order.

    Titles and summaries are without tags, summaries cut to `most` characters; urls without a scheme are of the site; a card
    without a title goes, one without a date or body has null or ''. The severity is told from title and summary.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"\s+", " "))
    each = pages.select(F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(F.col(html_col), F.lit(CARD), F.lit(1))).alias("n", "card")).where(F.col("card").rlike(CARD_TITLE))
    href = F.regexp_extract("card", CARD_TITLE, 1)
    found = each.select(
        "id", "n", plain(F.regexp_extract("card", CARD_TITLE, 2)).alias("title"), F.when(F.startswith(href, F.lit("http")), href).otherwise(F.concat(F.lit(site), href)).alias("url"),
        F.to_date(F.nullif(F.regexp_extract("card", CARD_DATE, 1), F.lit(""))).alias("date"), F.substring(plain(F.regexp_extract("card", CARD_BODY, 1)), 1, most).alias("summary"))
    return found.withColumn("severity", enforcement_severity(F.concat_ws(" ", "title", "summary"), criminal, civil))


REGISTRY_RECORD = """struct<basic:struct<status:string, enumeration_date:string, first_name:string, last_name:string, organization_name:string>,
other_names:array<struct<organization_name:string, first_name:string>>, addresses:array<struct<address_purpose:string>>, taxonomies:array<struct<desc:string>>>"""


def registry_checks(records: DataFrame, as_of: str) -> DataFrame:
    """records(npi, record JSON, first_name, last_name, organization as billed) -> (npi, severity, title), the checks of a registry record.

    Deactivated; enumerated up to 36 months ago, of 30 days each; a name that differs from the billed one (organizations may
    contain one another); other names; three or more places; and where nothing is found, that the identity was verified. A
    record that isn't JSON is verified against nothing: no row.
    """
    r = records.select("npi", "first_name", "last_name", "organization", F.from_json("record", REGISTRY_RECORD).alias("r")).where("r.basic IS NOT NULL OR r.addresses IS NOT NULL OR r.taxonomies IS NOT NULL")
    name = lambda c: F.upper(F.trim(F.coalesce(F.col(c), F.lit(""))))
    status = F.coalesce("r.basic.status", F.lit("A"))
    day = F.try_to_timestamp("r.basic.enumeration_date", F.lit("yyyy-MM-dd")).cast("date")
    months = F.greatest(F.lit(0), F.floor(F.datediff(F.lit(as_of).cast("date"), day) / 30)).cast("int")
    organization, billed = name("r.basic.organization_name"), name("organization")
    last, billed_last = name("r.basic.last_name"), name("last_name")
    other = (organization != "") & (billed != "")
    differs = F.when(other, ~(F.contains(organization, billed) | F.contains(billed, organization))).when((last != "") & (billed_last != ""), last != billed_last).otherwise(F.lit(False))
    aliases = F.size(F.filter(F.transform(F.coalesce("r.other_names", F.array()), lambda o: F.coalesce(F.nullif(o["organization_name"], F.lit("")), o["first_name"], F.lit(""))), lambda a: a != ""))
    places = F.size(F.filter(F.coalesce("r.addresses", F.array()), lambda a: F.upper(F.coalesce(a["address_purpose"], F.lit(""))) == "LOCATION"))
    found = lambda when, severity, title: F.when(when, F.struct(F.lit(severity).alias("severity"), title.alias("title")))
    every = F.array_compact(F.array(
        found((status != "") & (F.upper(status) != "A"), "critical", F.concat(F.lit("deactivated, status "), status)),
        found(months <= 24, "warning", F.concat(F.lit("new, "), months.cast("string"), F.lit(" months"))),
        found((months > 24) & (months <= 36), "info", F.concat(F.lit("new, "), months.cast("string"), F.lit(" months"))),
        found(differs, "adverse", F.lit("name differs from billing record")),
        found(aliases > 0, "info", F.concat(aliases.cast("string"), F.lit(" other names"))),
        found(places >= 3, "info", F.concat(places.cast("string"), F.lit(" places")))))
    specialty = F.coalesce(F.get("r.taxonomies", F.lit(0))["desc"], F.lit("unspecified"))
    verified = F.array(F.struct(F.lit("none").alias("severity"), F.concat(F.lit("identity verified, "), specialty).alias("title")))
    return r.select("npi", F.explode(F.when(F.size(every) > 0, every).otherwise(verified)).alias("f")).select("npi", "f.*")


def judged(texts: DataFrame, buckets: list[tuple[str, list[str]]], negations: list[str], text_col: str = "text") -> DataFrame:
    return texts.withColumn("severity", keyword_severity(text_col, buckets, negations)).withColumn("phrases", matched_phrases(text_col, buckets, negations))


def tags_out(html) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " "), r"\s+", " "))


def links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most: int = 400) -> DataFrame:
    """(id, n, url, title): the anchors of each page in order, titles without tags, cut to `most` characters."""
    found = F.regexp_extract_all(F.col(html_col), F.lit(r'(?is)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>'), F.lit(0))
    each = pages.select(F.col(id_col), F.posexplode(found).alias("n", "anchor"))
    return each.select(id_col, "n", F.regexp_extract("anchor", r'(?i)href="([^"]*)"', 1).alias("url"), F.substring(tags_out(F.col("anchor")), 1, most).alias("title"))


def registry_findings(json_text: DataFrame, as_of: str) -> DataFrame:
    """(npi, record JSON) -> (npi, finding): deactivated, new (24 or 36 months), other names, three or more places."""
    schema = "struct<status:string, enumeration_date:string, last_name:string, other_names:array<string>, addresses:array<string>>"
    r = json_text.select("npi", "expected_name", F.from_json("record", schema).alias("r"))
    months = F.months_between(F.lit(as_of).cast("date"), F.try_to_timestamp("r.enumeration_date", F.lit("yyyy-MM-dd")).cast("date"))
    every = F.array(
        F.when(F.upper("r.status") != "A", F.lit("deactivated")), F.when(months <= 24, F.lit("new within 24 months")).when(months <= 36, F.lit("new within 36 months")),
        F.when(F.lower("r.last_name") != F.lower("expected_name"), F.lit("name differs")), F.when(F.size("r.other_names") > 0, F.lit("other names")), F.when(F.size("r.addresses") >= 3, F.lit("three or more places")))
    every = F.filter(every, lambda x: x.isNotNull())
    return r.select("npi", F.explode(F.when(F.size(every) > 0, every).otherwise(F.array(F.lit("in order")))).alias("finding"))


def debarments(json_text: DataFrame, today: str, state: str | None = None) -> DataFrame:
    """(npi, record JSON with exclusions) -> a row for each, active or expired; another state's go unless the NPI matches."""
    schema = "struct<exclusions:array<struct<name:string, npi:string, state:string, until:string, agency:string>>>"
    each = json_text.select("npi", F.explode(F.from_json("record", schema)["exclusions"]).alias("e"))
    if state:
        each = each.where((F.col("e.state") == state) | F.col("e.npi").eqNullSafe(F.col("npi")))
    until = F.try_to_timestamp("e.until", F.lit("yyyy-MM-dd")).cast("date")
    active = until.isNull() | (until >= F.lit(today).cast("date"))
    return each.select("npi", "e.name", "e.agency", F.when(active, "critical").otherwise("warning").alias("severity"))


def search_terms(df: DataFrame, columns: list[str]) -> DataFrame:
    """terms: the distinct words of several columns."""
    words = F.split(F.lower(F.concat_ws(" ", *columns)), r"[^\p{L}\p{N}]+")
    return df.withColumn("terms", F.array_sort(F.array_remove(F.array_distinct(words), "")))


def matching(df: DataFrame, words: list[str]) -> DataFrame:
    wanted = F.array(*(F.lit(w.lower()) for w in words))
    return df.where(F.size(F.array_except(wanted, "terms")) == 0)
