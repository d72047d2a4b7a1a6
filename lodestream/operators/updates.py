"""State tables brought up to date by what was read: posts, companies, head offices, profiles, technologies.

Every operator gives the new state, or the rows to write, as a plan; nothing is written in place. Joins are on the
state's own keys, which repeat by the few deliveries that are merged first, so no key is hot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream import config
from lodestream.functions import names, numbers
from lodestream.operators.merge import keyed_merge

POST_KEY = ("company_id", "external_id")
_PREFERRED = ("body_text", "role_family", "seniority", "concepts")


def one_per_key(batch: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The row of each key with the greatest order; a key with a null or blank part has none."""
    rows = batch
    for k in keys:
        rows = rows.filter(F.trim(F.col(k).cast("string")) != "")
    rest = [c for c in batch.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def upsert_posts(state: DataFrame, batch: DataFrame, at: Column) -> DataFrame:
    """The posts after a poll: those of the batch are inserted or brought up to date and are open, first_seen_at staying
    as it was; open posts of a polled company that the batch doesn't list are closed at ``at``.

    ``state``: company_id, external_id, title, location, body_text, role_family, seniority, concepts, first_seen_at,
    last_seen_at, closed_at; ``batch``: the columns up to concepts. A null of the batch keeps the state's value, but for
    title and location. A company without a post in the batch wasn't polled.
    """
    seen = one_per_key(batch, POST_KEY, F.col("title")).select("*", at.alias("first_seen_at"), at.alias("last_seen_at"), F.lit(None).cast("timestamp").alias("closed_at"), F.lit(True).alias("_listed"))
    policies = {"title": "overwrite", "location": "overwrite", **dict.fromkeys(_PREFERRED, "prefer_new"), "first_seen_at": "keep_old", "last_seen_at": "overwrite", "closed_at": "overwrite", "_listed": "overwrite"}
    merged = keyed_merge(state.withColumn("_listed", F.lit(False)), seen, POST_KEY, policies)
    polled = seen.select("company_id").distinct().withColumn("_polled", F.lit(True))
    closed = F.when(~F.col("_listed") & F.col("_polled") & F.col("closed_at").isNull(), at).otherwise(F.col("closed_at"))
    return merged.join(polled, "company_id", "left").withColumn("closed_at", closed).drop("_listed", "_polled")


def new_or_changed_posts(batch: DataFrame, state: DataFrame) -> DataFrame:
    """Posts of the batch that no open post of the state has with the same title."""
    known = state.filter(F.col("closed_at").isNull()).select(*POST_KEY, F.col("title").alias("_title"), F.lit(True).alias("_known"))
    return batch.join(known, list(POST_KEY), "left").filter(F.col("_known").isNull() | ~F.col("_title").eqNullSafe(F.col("title"))).drop("_title", "_known")


def updated_companies(state: DataFrame, results: DataFrame, overwritten: Sequence[str]) -> DataFrame:
    """Companies after enrichment: the head count only where there is none or 0, an embedding unless the new one failed,
    all else as the result says. One result per company."""
    policies = {c: "overwrite" for c in overwritten}
    for c, policy in (("headcount", "fill_zero"), ("embedding", "prefer_new")):
        if c in state.columns:
            policies[c] = policy
    known = results.join(state.select("id"), "id", "left_semi")  # results of unknown companies create none
    return keyed_merge(state, known, ["id"], policies)


def filled_profiles(state: DataFrame, found: DataFrame, fields: Sequence[str], domain: str = "domain", resolved: str = "domain_resolved") -> DataFrame:
    """Fields that say nothing are filled from what was found, those that say something stay; a domain that is filled
    counts as resolved."""
    policies = {**dict.fromkeys((*fields, domain), "fill_empty"), resolved: "keep_old"}
    known = found.join(state.select("id"), "id", "left_semi")
    old = state.select("id", *fields, domain, resolved, (F.coalesce(F.trim(domain), F.lit("")) == "").alias("_bare"))
    merged = keyed_merge(old, known.select("id", *fields, domain, F.lit(None).cast("boolean").alias(resolved), F.lit(None).cast("boolean").alias("_bare")), ["id"], policies | {"_bare": "keep_old"})
    return merged.withColumn(resolved, F.when(F.col("_bare") & (F.trim(domain) != ""), True).otherwise(F.col(resolved))).drop("_bare")


def head_count_choice(model: Column, structured: Column, existing: Column, estimate: Column, year: int, founded: Column | None = None) -> Column:
    """The first usable head count: the model's (no year since 1900), the structured one (no year of late), the one on
    record, the estimate."""
    return F.coalesce(numbers.sanitize_head_count(model, year, founded, floor=1900), numbers.sanitize_head_count(structured, year, founded), F.when(existing > 0, existing), estimate)


def head_offices(items: DataFrame) -> DataFrame:
    """raw, hq_city, hq_region, hq_country of normalised head offices, one row per text; blank parts are null."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    rows = items.select(F.trim("raw").alias("raw"), *[some(c).alias(c) for c in ("hq_city", "hq_region", "hq_country")]).filter(F.col("raw") != "")
    return rows.groupBy("raw").agg(F.max(F.struct("hq_city", "hq_region", "hq_country")).alias("_m")).select("raw", "_m.*")


def with_head_offices(companies: DataFrame, offices: DataFrame) -> DataFrame:
    """Companies without a city get the fields of their head office's text, as far as these are known."""
    fields = ("hq_city", "hq_region", "hq_country")
    joined = companies.join(offices.select("raw", *[F.col(c).alias(f"_{c}") for c in fields]), F.trim("headquarters") == F.col("raw"), "left")
    empty = F.coalesce(F.trim("hq_city"), F.lit("")) == ""
    return joined.select(*[F.when(empty, F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in companies.columns])


def tech_events(paired: DataFrame, key: str, at: str, full_source: str, labels: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """key, at, event_type, tech, title, confidence, event_key of technologies adopted and dropped between two full runs.

    ``paired`` has tech_stack, source and ``prev`` (of both); a run of another source can't prove an absence. ``labels``:
    tech, name, categories; a technology without any of the allowed categories makes no event.
    """
    empty = F.array().cast("array<string>")
    now, before = F.coalesce("tech_stack", empty), F.coalesce("prev.tech_stack", empty)
    rows = paired.filter((F.col("source") == full_source) & (F.col("prev.source") == full_source))
    kinds = F.array(F.struct(F.lit("tech_first_seen").alias("event_type"), F.array_except(now, before).alias("techs")), F.struct(F.lit("tech_dropped").alias("event_type"), F.array_except(before, now).alias("techs")))
    each = rows.select(key, at, F.explode(kinds).alias("k")).select(key, at, "k.event_type", F.explode("k.techs").alias("tech"))
    known = labels.filter(F.arrays_overlap("categories", F.array(*[F.lit(a) for a in allowed])))
    first = F.col("event_type") == "tech_first_seen"
    title = F.concat(F.when(first, "Started using ").otherwise("Stopped using "), F.coalesce("name", "tech"), F.lit(" ("), F.array_join(F.slice("categories", 1, 2), ", "), F.lit(")"))
    event_key = F.concat(F.when(first, "tech:").otherwise("tech_drop:"), F.col("tech"), F.lit(":"), F.date_format(at, "yyyy-MM"))
    return each.join(F.broadcast(known), "tech").select(key, at, "event_type", "tech", title.alias("title"), F.when(first, 0.85).otherwise(0.7).alias("confidence"), event_key.alias("event_key"))


def snapshot_rows(results: DataFrame) -> DataFrame:
    """Snapshots of enrichment results: technologies are those that pages show, sorted, if there was such a run, else
    those that were named; missing lists are empty and a missing hiring_count is 0.

    ``results``: company_id, captured_at, hiring_count, hiring_roles, tech_stack, detected (array of slug, name, categories),
    tech_source, funding_stage, total_raised, headcount.
    """
    texts = F.array().cast("array<string>")
    shown = F.col("detected").isNotNull() & (F.coalesce("tech_source", F.lit("")) != "")
    labels = F.map_from_entries(F.transform(F.array_distinct("detected"), lambda d: F.struct(d["slug"], F.struct(d["name"].alias("name"), F.coalesce(d["categories"], texts).alias("categories")))))
    return results.select(
        "company_id", "captured_at", F.coalesce("hiring_count", F.lit(0)).alias("hiring_count"), F.coalesce("hiring_roles", texts).alias("hiring_roles"),
        F.when(shown, F.array_sort(F.array_distinct(F.transform("detected", lambda d: d["slug"])))).otherwise(F.coalesce("tech_stack", texts)).alias("tech_stack"),
        F.when(shown, F.col("tech_source")).alias("source"), F.when(shown, labels).alias("tech_labels"), "funding_stage", "total_raised", "headcount",
    )


def pattern_technologies(pages: DataFrame, page_id: str, markup: str, patterns: Sequence[tuple[str, Sequence[str]]] = config.FALLBACK_TECH) -> DataFrame:
    """page_id, tech of the technologies of whose patterns one is in the markup; one pass, no join."""
    found = F.filter(F.array(*[F.when(F.col(markup).rlike("(?i)" + "|".join(ps)), F.lit(tech)) for tech, ps in patterns]), lambda t: t.isNotNull())
    return pages.select(F.col(page_id).alias("page_id"), F.explode(found).alias("tech"))


def first_in_page(pages: DataFrame, page: str, order: Sequence[str], name: str, known: DataFrame) -> DataFrame:
    """Rows whose name occurs first in their page and is none of the known names (``known``: name, in lower case)."""
    key = F.lower(F.trim(name))
    w = Window.partitionBy(page, "_name").orderBy(*order)
    rows = pages.withColumn("_name", key).filter(F.col("_name") != "").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == 1)
    return rows.join(known.select(F.col("name").alias("_name")).distinct(), "_name", "left_anti").drop("_name", "_n")


def known_names(companies: DataFrame, columns: Sequence[str]) -> DataFrame:
    """name: every name of every company in lower case."""
    return companies.select(F.explode(F.array(*[F.lower(F.trim(c)) for c in columns])).alias("name")).filter(F.col("name") != "").distinct()


def tagged(companies: DataFrame, found: DataFrame, profile: str, at: Column) -> DataFrame:
    """Companies that a search found (``found``: id) get the profile, once, and are seen at ``at``."""
    hit = F.coalesce("_hit", F.lit(False))
    joined = companies.join(found.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    profiles = F.coalesce("source_profiles", F.array().cast("array<string>"))
    return joined.withColumn("source_profiles", F.when(hit, F.array_union(profiles, F.array(F.lit(profile)))).otherwise(F.col("source_profiles"))).withColumn("last_seen_at", F.when(hit, at).otherwise(F.col("last_seen_at"))).drop("_hit")


def names_known(probes: DataFrame, companies: DataFrame, name: str) -> DataFrame:
    """Probes whose name, normalised as filings' are, is a company's normalised name or lower-case registered name."""
    keys = companies.select(F.explode(F.array(F.lower(F.regexp_replace("name", "[^a-zA-Z0-9]+", " ")), F.lower("apollo_org_name"))).alias("_key")).filter(F.col("_key").isNotNull()).distinct()
    return probes.withColumn("_key", names.filing_name(F.col(name))).join(keys, "_key", "left_semi").drop("_key")


def embedding_plan(companies: DataFrame, parts: Sequence[Column], has_vector: Column, after: str, most: int) -> DataFrame:
    """id, action, text of the next rows by id after a cursor: embed what has text, clear what has a vector but no text,
    keep the rest. The greatest id is the next cursor."""
    text = F.concat_ws(" ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])
    page = companies.filter(F.col("id") > after).orderBy("id").limit(most)
    return page.select("id", F.when(text != "", "embed").when(has_vector, "clear").otherwise("keep").alias("action"), text.alias("text"))


def ordered_union(*lists: Column) -> Column:
    """The items of several lists, each at its first place."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(x, empty) for x in lists]))


def sample_rows(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """``n`` rows in an order that only the seed and the keys decide, so that it can be drawn again."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary")), key).limit(n)
