"""Filings: the index of a day, those of known companies before any document is read, items, inserts and links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.operators import merge, resolve


def index_rows(lines: DataFrame) -> DataFrame:
    """cik, entity_name, form_type, filed_on, path, accession_no of an index (column ``value``) of the form
    cik|name|form|date|path; its heading and broken lines are no rows."""
    p = F.split("value", r"\|")
    rows = lines.filter((F.size(p) == 5) & p[0].rlike(r"^\d+$")).select(F.lpad(p[0], 10, "0").alias("cik"), F.trim(p[1]).alias("entity_name"), F.trim(p[2]).alias("form_type"), F.try_to_date(F.trim(p[3]), "yyyy-MM-dd").alias("filed_on"), F.trim(p[4]).alias("path"))
    return rows.withColumn("accession_no", F.regexp_extract("path", r"(\d{10}-\d{2}-\d{6})", 1)).filter(F.col("accession_no") != "").dropDuplicates(["accession_no"])


def filings_of_companies(index: DataFrame, keys: DataFrame, form: str) -> DataFrame:
    """The index rows of a form whose filer is a known company (``keys`` as from ``resolve.company_keys``), with
    company_id and reason; only their documents need to be read."""
    some = index.filter(F.col("form_type") == form)
    probes = some.select("accession_no", "entity_name", F.lit(None).cast("string").alias("state"))
    hits = resolve.match_names(probes, keys, "accession_no", "entity_name", "state")
    return some.join(hits.select(F.col("probe_id").alias("accession_no"), "company_id", "reason"), "accession_no")


def report_items(reports: DataFrame, wanted: list[str], least: int = 80) -> DataFrame:
    """accession_no, company_id, item, body of the wanted items (column ``items``: map of item to text) that say something."""
    each = reports.select("accession_no", "company_id", F.explode("items").alias("item", "b")).withColumn("body", F.trim("b")).drop("b")
    return each.filter(F.col("item").isin(*wanted) & (F.length("body") >= least))


def new_filings(state: DataFrame, parsed: DataFrame) -> DataFrame:
    """Filings of technology companies that the state doesn't have; the first of a repeated one."""
    return merge.insert_ignore(state, parsed.filter("is_tech"), ["accession_no"], [F.asc("entity_name")])


def linked_filings(state: DataFrame, matches: DataFrame) -> DataFrame:
    """Filings with the company that they were matched with (``matches``: accession_no, company_id); others unchanged."""
    m = matches.groupBy("accession_no").agg(F.min("company_id").alias("_c"))
    return state.join(m, "accession_no", "left").withColumn("matched_company_id", F.coalesce("_c", "matched_company_id")).select(*state.columns)
