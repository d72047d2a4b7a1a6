"""Layoff notices, filings, awards, discussions and launches as rows of the common event form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream import config
from lodestream.functions import dates, names, numbers
from lodestream.sources.tables import rows_as_maps


def header_value(row: Column, synonyms: tuple[str, ...]) -> Column:
    """The first filled cell whose header is a synonym; else the first whose header contains one, in order."""

    def containing(synonym: str) -> Column:
        return F.try_element_at(F.map_values(F.map_filter(row, lambda k, v: k.contains(synonym) & (v != ""))), F.lit(1))

    exact = [F.nullif(F.try_element_at(row, F.lit(s)), F.lit("")) for s in synonyms]
    return F.coalesce(*exact, *map(containing, synonyms), F.lit(""))


def layoff_notices(rows: DataFrame, state: str) -> DataFrame:
    """company, notice_date, employees, location, state; rows without a company or a date are dropped."""
    maps = rows_as_maps(rows)
    value = lambda f: header_value(F.col("row"), config.NOTICE_HEADERS[f])
    out = maps.select(value("company").alias("company"), dates.parse_notice_date(value("notice_date")).alias("notice_date"), numbers.first_integer(value("employees")).alias("employees"), F.left(value("location"), F.lit(120)).alias("location"), F.lit(state).alias("state"))
    return out.filter((F.col("company") != "") & F.col("notice_date").isNotNull())


FORM_D = (
    "accession_no string, entity_name string, industry_group string, is_new boolean, is_business_combination boolean, total_offering_amount string, total_amount_sold string, "
    "revenue_range string, date_of_first_sale string, state string, related_persons array<struct<first_name:string,last_name:string,relationships:array<string>>>"
)


def parsed_filings(raw: DataFrame, tech_groups: tuple[str, ...]) -> DataFrame:
    """Form D documents (JSON in column ``doc``) with amounts as numbers and up to eight named persons."""
    d = raw.select(F.from_json("doc", FORM_D).alias("d")).select("d.*").filter(F.col("accession_no").isNotNull())
    person = lambda p: F.struct(F.trim(F.concat_ws(" ", F.trim(p["first_name"]), F.trim(p["last_name"]))).alias("name"), F.array_join(F.coalesce(p["relationships"], F.array().cast("array<string>")), ", ").alias("relationship"))
    persons = F.slice(F.filter(F.transform(F.coalesce("related_persons", F.array().cast(d.schema["related_persons"].dataType)), person), lambda p: p["name"] != ""), 1, 8)
    return d.select(
        "accession_no", "entity_name", names.filing_name(F.col("entity_name")).alias("normalized_name"), "industry_group",
        F.coalesce(F.lower(F.trim("industry_group")).isin(*tech_groups), F.lit(False)).alias("is_tech"), F.coalesce("is_new", F.lit(False)).alias("is_new"),
        F.coalesce("is_business_combination", F.lit(False)).alias("is_business_combination"), numbers.parse_amount(F.col("total_offering_amount")).alias("offering_amount"),
        numbers.parse_amount(F.col("total_amount_sold")).alias("amount_sold"), "revenue_range", F.nullif(F.trim("date_of_first_sale"), F.lit("")).alias("date_of_first_sale"), "state", persons.alias("persons"),
    )


def event_rows(df: DataFrame, event_type: str, source: str, confidence: float, title: Column, key: Column, url: Column, date: Column) -> DataFrame:
    """company_id, event_type, title, source, confidence, dedupe_key, evidence_url, event_date."""
    t = F.left(title, F.lit(500))
    return df.select(
        "company_id", F.lit(event_type).alias("event_type"), t.alias("title"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"),
        F.concat_ws(":", "company_id", F.lit(event_type), key).alias("dedupe_key"), F.nullif(url, F.lit("")).alias("evidence_url"), dates.parse_event_date(date).alias("event_date"),
    )


def award_events(awards: DataFrame) -> DataFrame:
    """Of company_id, award_id, internal_id, amount, agency, date; awards without a positive amount are none."""
    money = numbers.format_amount(F.col("amount"))
    agency = F.coalesce(F.nullif("agency", F.lit("")), F.lit("federal agency"))
    url = F.concat(F.lit("https://www.usaspending.gov/award/"), F.coalesce("internal_id", "award_id"))
    return event_rows(awards.filter(F.col("amount") > 0), "gov_contract", "usaspending", 0.9, F.concat(F.lit("Federal contract: "), money, F.lit(" from "), agency), F.concat(F.lit("usaspending:"), "award_id"), url, F.col("date"))


def discussion_events(hits: DataFrame, least_points: int = 10, least_comments: int = 5) -> DataFrame:
    """Of company_id, domain, title, url, points, comments, object_id, created_at: launches on the company's own
    host, else mentions with enough points or comments."""
    own = F.lower("title").startswith("show hn") & F.col("url").contains(F.regexp_replace(F.lower("domain"), r"^www\.", ""))
    own = F.coalesce(own, F.lit(False))
    link = F.coalesce(F.nullif("url", F.lit("")), F.concat(F.lit("https://news.ycombinator.com/item?id="), "object_id"))
    launches = event_rows(hits.filter(own), "product_launch", "hacker_news", 0.85, F.concat(F.lit("Show HN: "), F.left("title", F.lit(460))), F.concat(F.lit("hn:show:"), "object_id"), link, F.col("created_at"))
    loud = ~own & ((F.coalesce("points", F.lit(0)) >= least_points) | (F.coalesce("comments", F.lit(0)) >= least_comments))
    return launches.unionByName(event_rows(hits.filter(loud), "news_mention", "hacker_news", 0.7, F.concat(F.lit("HN: "), F.left("title", F.lit(460))), F.concat(F.lit("hn:"), "object_id"), link, F.col("created_at")))


def release_events(releases: DataFrame) -> DataFrame:
    """Of company_id, package, version, date."""
    named = F.concat("package", F.lit("@"), F.coalesce("version", F.lit("?")))
    return event_rows(releases, "product_launch", "npm", 0.6, F.concat(F.lit("npm release: "), named), F.concat(F.lit("npm:"), "package", F.lit("@"), F.coalesce("version", F.lit(""))), F.concat(F.lit("https://www.npmjs.com/package/"), "package"), F.col("date"))
