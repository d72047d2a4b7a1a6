"""Queries of the operators that bring state tables up to date, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream import config
from lodestream.functions import names
from lodestream.operators import graph, merge, schedule, updates
from lodestream.plans import oracles
from lodestream.plans.catalogue import _companies, _results, now
from lodestream.runtime import load

#: Posts that a poll of this day listed are the batch, posts first seen before it the state.
POLL = "2025-03-01 00:00:00"


def _poll() -> Column:
    return F.to_timestamp(F.lit(POLL))


def _post_rows(spark, sf_dir) -> DataFrame:
    columns = ("company_id", "external_id", "title", "location", "body_text", "role_family", "seniority", "concepts", "first_seen_at", "last_seen_at", "closed_at")
    return load(spark, sf_dir, "discovery_job_post").select("id", *columns).filter(F.col("company_id").isNotNull())


def _post_state(spark, sf_dir) -> DataFrame:
    rows = _post_rows(spark, sf_dir).filter(F.col("first_seen_at") < _poll())
    return updates.one_per_key(rows, updates.POST_KEY, F.struct("last_seen_at", "id")).drop("id")


def _post_batch(spark, sf_dir) -> DataFrame:
    rows = _post_rows(spark, sf_dir).filter(F.col("last_seen_at") >= _poll())
    return updates.one_per_key(rows, updates.POST_KEY, F.struct("last_seen_at", "id")).select(*updates.POST_KEY, F.upper("title").alias("title"), "location", "body_text", "role_family", "seniority", "concepts")


def upsert_posts(spark, sf_dir):
    out = updates.upsert_posts(_post_state(spark, sf_dir), _post_batch(spark, sf_dir), _poll())
    return out.select("company_id", "external_id", "title", "role_family", "first_seen_at", "last_seen_at", "closed_at")


def new_or_changed_posts(spark, sf_dir):
    batch = _post_batch(spark, sf_dir).withColumn("title", F.when(F.length("title") > 30, F.col("title")).otherwise(F.initcap("title")))
    return updates.new_or_changed_posts(batch, _post_state(spark, sf_dir)).select("company_id", "external_id", "title")


def _latest_results(spark, sf_dir) -> DataFrame:
    r = load(spark, sf_dir, "company_signal_result").select("id", "company_id", "captured_at", "funding_stage", "total_raised", "headcount").distinct()
    return merge.latest_per_key(r, ["company_id"], [F.desc("captured_at"), F.desc("id")]).select(F.col("company_id").alias("id"), "funding_stage", "total_raised", "headcount")


def updated_companies(spark, sf_dir):
    state = _companies(spark, sf_dir, "id", "headcount", "funding").select("id", "headcount", F.lit(None).cast("string").alias("funding_stage"), F.col("funding").alias("total_raised"))
    return updates.updated_companies(state, _latest_results(spark, sf_dir), ["funding_stage", "total_raised"])


def filled_profiles(spark, sf_dir):
    state = _companies(spark, sf_dir, "id", "funding", "industry", "domain", "domain_resolved")
    found = _latest_results(spark, sf_dir).select("id", F.col("total_raised").alias("funding"), F.coalesce("funding_stage", F.lit("unknown")).alias("industry"), F.concat(F.left("id", F.lit(8)), F.lit(".example")).alias("domain"))
    return updates.filled_profiles(state, found, ["funding", "industry"])


def head_count_choice(spark, sf_dir):
    c = _companies(spark, sf_dir, "id", "headcount").withColumnRenamed("headcount", "existing")
    j = c.join(_latest_results(spark, sf_dir).select("id", F.col("headcount").alias("said")), "id", "left")
    return j.select("id", updates.head_count_choice(F.col("said"), F.lit(None).cast("int"), F.col("existing"), F.lit(1), 2025).alias("headcount"))


def head_office_update(spark, sf_dir):
    h = load(spark, sf_dir, "discovery_company").select(F.trim("headquarters").alias("raw")).filter(F.col("raw") != "").distinct()
    part = lambda i: F.try_element_at(F.split("raw", ","), F.lit(i))
    items = h.filter(F.size(F.split("raw", ",")) == 3).select("raw", part(1).alias("hq_city"), part(2).alias("hq_region"), part(3).alias("hq_country"))
    c = _companies(spark, sf_dir, "id", "headquarters", "hq_city", "hq_region", "hq_country")
    return updates.with_head_offices(c, updates.head_offices(items)).select("id", "hq_city", "hq_region", "hq_country")


#: Categories of the technologies of the given tables.
TECH_LABELS = [
    ("lumenjs", "Lumen JS", ["JavaScript frameworks"]), ("palletq", "PalletQ", ["Analytics", "RUM"]), ("quarrydb", "QuarryDB", ["Databases"]), ("nestbox", "Nestbox", ["Webmail", "Email", "Security"]),
    ("ember-auth", "Ember Auth", ["Authentication"]), ("forgeci", "ForgeCI", ["CI"]), ("tideway", None, ["Marketing automation"]), ("gridcache", "Gridcache", []),
]


def tech_events(spark, sf_dir):
    from lodestream.operators import snapshots

    r = load(spark, sf_dir, "company_signal_result").select("id", "company_id", "captured_at", "tech_stack", F.when(F.col("source").isin("synthesis", "search_panel"), "wappalyzer").otherwise(F.col("source")).alias("source")).distinct()
    paired = snapshots.with_previous(r, "company_id", "captured_at", ["tech_stack", "source"], ["id"])
    labels = spark.createDataFrame(TECH_LABELS, "tech string, name string, categories array<string>")
    return updates.tech_events(paired, "company_id", "captured_at", "wappalyzer", labels, config.TECH_EVENT_CATEGORIES)


def pattern_technologies(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    return updates.pattern_technologies(d, "doc_id", "text", (*config.FALLBACK_TECH, ("markup", ("<h2", "<p>")), ("query", ("select .* from",)))).select(F.col("page_id").alias("doc_id"), "tech")


def _tracked(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "tracked_company").groupBy("id").agg(F.min("name").alias("name"), F.min("domain").alias("domain"), F.min("state").alias("state"))


def first_in_page(spark, sf_dir):
    pages = _tracked(spark, sf_dir).withColumn("page", F.floor(F.substring("id", 4, 20).cast("long") / 100))
    known = updates.known_names(load(spark, sf_dir, "discovery_company"), ["name", "apollo_org_name"])
    return updates.first_in_page(pages, "page", ["id"], "name", known).select("page", "id", "name")


def tagged_companies(spark, sf_dir):
    c = _companies(spark, sf_dir, "id", "apollo_org_name", "source", "last_seen_at").select("id", "apollo_org_name", F.array("source").alias("source_profiles"), "last_seen_at")
    names_ = _tracked(spark, sf_dir).select(F.lower("name").alias("_n")).distinct()
    found = c.join(names_, F.lower("apollo_org_name") == F.col("_n"), "left_semi").select("id")
    return updates.tagged(c, found, "tracked", now()).select("id", F.array_join("source_profiles", "|").alias("profiles"), "last_seen_at")


def names_known(spark, sf_dir):
    return updates.names_known(_tracked(spark, sf_dir).select("id", "name"), load(spark, sf_dir, "discovery_company").select("name", "apollo_org_name"), "name").select("id", "name")


def embedding_plan(spark, sf_dir):
    c = _companies(spark, sf_dir, "id", "industry", "funding", "domain_resolved")
    return updates.embedding_plan(c, [F.col("industry"), F.col("funding")], F.col("domain_resolved"), "4", 500)


def year_leaks(spark, sf_dir):
    return _companies(spark, sf_dir, "id", "headcount").agg(F.count_if(F.col("headcount").between(2023, 2028)).alias("n_leaks"), F.count_if(F.col("headcount").isNotNull()).alias("n_counts"))


def slots_per_org(spark, sf_dir):
    from lodestream.plans.catalogue import fair_share_select

    return fair_share_select(spark, sf_dir).groupBy("org_id").agg(F.count(F.lit(1)).alias("n_slots"))


def merged_lists(spark, sf_dir):
    r = _results(spark, sf_dir)
    return r.select("id", F.array_join(updates.ordered_union(F.col("tech_stack"), F.col("hiring_roles")), "|").alias("items"))


def outcome_rates(spark, sf_dir):
    c = _companies(spark, sf_dir, "id", "source", "signal_enrichment_status")
    ok, bad = F.count_if(F.col("signal_enrichment_status") == "enriched"), F.count_if(F.col("signal_enrichment_status") == "failed")
    return c.groupBy("source").agg(F.count(F.lit(1)).alias("n"), ok.alias("n_ok"), bad.alias("n_failed"), F.round(F.try_divide(ok, ok + bad), 6).alias("ok_share"))


def quality_gate(spark, sf_dir):
    g = load(spark, sf_dir, "reading_label").groupBy("reader").agg(F.round(F.avg("grade"), 6).alias("mean_grade"), F.min("grade").alias("least_grade"))
    return g.withColumn("passes", (F.col("mean_grade") >= 3) & (F.col("least_grade") >= 1))


def sample_rows(spark, sf_dir):
    return updates.sample_rows(_companies(spark, sf_dir, "id", "name"), "id", "probe-1", 100).select("id")


def listed_companies(spark, sf_dir):
    hosts = _tracked(spark, sf_dir).select(F.lower("domain").alias("_d")).filter(F.col("_d").isNotNull()).distinct()
    return _companies(spark, sf_dir, "id", "domain").join(hosts, F.lower("domain") == F.col("_d"), "left_semi")


def unignored_events(spark, sf_dir):
    e = load(spark, sf_dir, "signal_event").select("source", "payload").filter(F.get_json_object("payload", "$.ignored_reason").isNull())
    return e.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("payload", "$.weight").try_cast("long")).alias("weight"))


def reset_statuses(spark, sf_dir):
    c = _companies(spark, sf_dir, "id", "signal_enrichment_status", "signal_attempt_count")
    again = F.col("signal_enrichment_status").isin("failed", "skipped") & (F.col("signal_attempt_count") < 3)
    return c.select("id", F.when(again, "pending").otherwise(F.col("signal_enrichment_status")).alias("status"), F.when(again, 0).otherwise(F.col("signal_attempt_count")).alias("attempts"))


def _vendor_batch(spark, sf_dir, late: bool) -> DataFrame:
    r = _results(spark, sf_dir).filter((F.col("captured_at") >= _poll()) if late else (F.col("captured_at") < _poll()))
    each = r.select("company_id", "captured_at", F.explode("tech_stack").alias("display")).withColumn("dst_id", names.entity_slug(F.col("display")))
    rows = each.groupBy("company_id", "dst_id").agg(F.min("captured_at").alias("observed_at"), F.max("captured_at").alias("last_seen_at"))
    return rows.select(
        F.lit("company").alias("src_type"), F.col("company_id").alias("src_id"), F.lit("uses_vendor").alias("edge_type"), F.lit("vendor").alias("dst_type"), "dst_id",
        (F.col("dst_id") if late else F.lit(None).cast("string")).alias("dst_company_id"), F.lit("late" if late else "early").alias("source"), "observed_at", "last_seen_at",
    )


def edge_upsert(spark, sf_dir):
    out = graph.upsert_edges(_vendor_batch(spark, sf_dir, False), _vendor_batch(spark, sf_dir, True))
    return out.select("src_id", "dst_id", "dst_company_id", "source", "observed_at", "last_seen_at")


def customer_edges(spark, sf_dir):
    edges = _tracked(spark, sf_dir).select(F.col("id").alias("src_id"), names.entity_slug(F.col("name")).alias("dst_id"), "domain")
    c = _companies(spark, sf_dir, "id", "name", "domain")
    by_domain = c.filter(F.col("domain").isNotNull()).select("domain", F.col("id").alias("company_id"))
    by_name = c.select(names.entity_slug(F.col("name")).alias("dst_id"), F.col("id").alias("company_id")).distinct()
    return graph.resolve_customers(edges, by_domain, by_name)


def daily_budget_left(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return schedule.window_budget(e.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_id"], "1 day", 300).withColumn("n_refused", F.col("n_calls") - F.col("n_admitted"))


def _open_posts(spark, sf_dir, day: str) -> DataFrame:
    """Posts that were open on a day."""
    at = F.to_timestamp(F.lit(day))
    p = load(spark, sf_dir, "discovery_job_post").select("id", "company_id", "role_family", "concepts", "first_seen_at", "closed_at").distinct()
    return p.filter(F.col("company_id").isNotNull() & (F.col("first_seen_at") <= at) & (F.col("closed_at").isNull() | (F.col("closed_at") > at)))


def role_growth(spark, sf_dir):
    from lodestream.operators import snapshots

    counts = lambda day: _open_posts(spark, sf_dir, day).filter(F.col("role_family").isNotNull()).groupBy("company_id", "role_family").agg(F.count(F.lit(1)).alias("n"))
    return snapshots.growth_events(counts("2025-04-01"), counts("2025-03-02"), "company_id", "role_family", "n", 3, 2.0)


def concept_growth(spark, sf_dir):
    from lodestream.operators import snapshots

    counts = lambda day: _open_posts(spark, sf_dir, day).select("company_id", F.explode("concepts").alias("c")).groupBy("company_id", F.lower("c").alias("concept")).agg(F.count(F.lit(1)).alias("n"))
    return snapshots.growth_events(counts("2025-04-01"), counts("2025-03-02"), "company_id", "concept", "n", 2, 1.0, strictly_more=True)


def profile_changes(spark, sf_dir):
    from lodestream.operators import snapshots

    r = load(spark, sf_dir, "company_signal_result").select("id", "company_id", "captured_at", "funding_stage", "headcount").distinct()
    return snapshots.profile_changes(snapshots.with_previous(r, "company_id", "captured_at", ["funding_stage", "headcount"], ["id"]), "company_id", "captured_at")


def fill_rate_change(spark, sf_dir):
    before = merge.fill_rates(_companies(spark, sf_dir, "id", "funding", "industry", "domain", "domain_resolved"), ["funding", "industry", "domain"])
    after = merge.fill_rates(filled_profiles(spark, sf_dir), ["funding", "industry", "domain"])
    return before.select("field", F.col("n_filled").alias("n_before")).join(after.select("field", F.col("n_filled").alias("n_after")), "field").withColumn("n_gained", F.col("n_after") - F.col("n_before"))


def cached_board_scan(spark, sf_dir):
    """Companies to poll, the latest brought up to date first."""
    c = _companies(spark, sf_dir, "id", "domain", "updated_at").filter(F.col("domain").isNotNull())
    return c.orderBy(F.desc_nulls_last("updated_at"), "id").limit(100).select("id", "updated_at")


def known_open_posts(spark, sf_dir):
    return _post_state(spark, sf_dir).filter(F.col("closed_at").isNull()).select("company_id", "external_id", "title")


def remerged_posts(spark, sf_dir):
    """Posts of a poll with what was read out of their texts, by id; a post of which nothing was read stays as it was."""
    read_out = _post_state(spark, sf_dir).filter(F.col("role_family").isNotNull()).select(*updates.POST_KEY, F.col("role_family").alias("_family"), F.size("concepts").alias("n_concepts"))
    batch = _post_batch(spark, sf_dir).select(*updates.POST_KEY, "title")
    return batch.join(read_out, list(updates.POST_KEY), "left").select(*updates.POST_KEY, "title", F.coalesce("_family", F.lit("other")).alias("role_family"), F.greatest(F.coalesce("n_concepts", F.lit(0)), F.lit(0)).alias("n_concepts"))


def ready_hosts(spark, sf_dir):
    """Hosts of the companies that were enriched, each once."""
    c = _companies(spark, sf_dir, "id", "domain", "signal_enrichment_status").filter((F.col("signal_enrichment_status") == "enriched") & (F.trim("domain") != ""))
    return c.groupBy(F.lower(F.trim("domain")).alias("host")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n_companies"))


QUERIES = {
    f.__name__: f
    for f in (
        upsert_posts, new_or_changed_posts, updated_companies, filled_profiles, head_count_choice, head_office_update, tech_events, pattern_technologies, first_in_page, tagged_companies,
        names_known, embedding_plan, year_leaks, slots_per_org, merged_lists, outcome_rates, quality_gate, sample_rows, listed_companies, unignored_events, reset_statuses, edge_upsert,
        customer_edges, daily_budget_left, role_growth, concept_growth, profile_changes, fill_rate_change,
        cached_board_scan, known_open_posts, remerged_posts, ready_hosts,
    )
}

_AT = "TIMESTAMPTZ '2025-03-01 00:00:00+00'"
_LATEST_POST = """
  SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY company_id, external_id ORDER BY last_seen_at DESC, id DESC) AS k FROM discovery_job_post
  WHERE company_id IS NOT NULL AND trim(company_id) <> '' AND trim(external_id) <> '' AND {}) WHERE k = 1
"""
_STATE, _BATCH = _LATEST_POST.format(f"first_seen_at < {_AT}"), _LATEST_POST.format(f"last_seen_at >= {_AT}")
_LATEST_RESULT = """
  SELECT company_id AS id, funding_stage, total_raised, headcount FROM (
    SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY captured_at DESC, id DESC) AS k FROM (SELECT DISTINCT id, company_id, captured_at, funding_stage, total_raised, headcount FROM company_signal_result))
  WHERE k = 1
"""
_SLUG = "trim(regexp_replace(lower(trim({})), '[^a-z0-9]+', '-', 'g'), '-')"
_TRACKED = "SELECT id, min(name) AS name, min(domain) AS domain, min(state) AS state FROM tracked_company GROUP BY id"
_VENDORS = f"""
  SELECT company_id AS src_id, {_SLUG.format('t')} AS dst_id, min(captured_at) AS observed_at, max(captured_at) AS last_seen_at
  FROM (SELECT company_id, captured_at, unnest(tech_stack) AS t FROM (SELECT DISTINCT id, company_id, captured_at, tech_stack FROM company_signal_result) WHERE captured_at {{}} {_AT}) GROUP BY 1, 2
"""
_TECH_PATTERNS = {
    "hubspot": "hubspot\\.com|hs-scripts|hbspt\\.", "salesforce": "salesforce\\.com|force\\.com|pardot\\.com", "intercom": "intercom\\.io|intercomSettings", "drift": "drift\\.com", "zendesk": "zendesk\\.com",
    "crisp": "crisp\\.chat", "calendly": "calendly\\.com", "stripe": "js\\.stripe\\.com|stripe\\.com/v3", "braintree": "braintreegateway\\.com", "paypal": "paypalobjects\\.com",
    "segment": "cdn\\.segment\\.com|analytics\\.js", "mixpanel": "mixpanel\\.com|mixpanel\\.init", "heap": "heapanalytics\\.com|heap\\.io", "hotjar": "hotjar\\.com", "clarity": "clarity\\.ms",
    "klaviyo": "a\\.klaviyo\\.com|klaviyo\\.com/onsite", "mailchimp": "list-manage\\.com", "shopify": "cdn\\.shopify\\.com|Shopify\\.theme", "react": "_next/static|react\\.production\\.min|__NEXT_DATA__",
    "next.js": "_next/|__NEXT_DATA__", "vue": "vue\\.runtime|__vue__", "angular": "ng-version=", "cloudflare": "cloudflare\\.com|__cf_bm|cf-ray", "markup": "<h2|<p>", "query": "select .* from",
}

ORACLES: dict[str, str] = {
    "upsert_posts": f"""
WITH s AS ({_STATE}), b AS ({_BATCH}), polled AS (SELECT DISTINCT company_id FROM b)
SELECT coalesce(b.company_id, s.company_id) AS company_id, coalesce(b.external_id, s.external_id) AS external_id, CASE WHEN b.id IS NOT NULL THEN upper(b.title) ELSE s.title END AS title,
       coalesce(b.role_family, s.role_family) AS role_family, coalesce(s.first_seen_at, {_AT}) AS first_seen_at, CASE WHEN b.id IS NOT NULL THEN {_AT} ELSE s.last_seen_at END AS last_seen_at,
       CASE WHEN b.id IS NOT NULL THEN NULL WHEN s.closed_at IS NOT NULL THEN s.closed_at WHEN s.company_id IN (SELECT company_id FROM polled) THEN {_AT} END AS closed_at
FROM s FULL JOIN b ON s.company_id = b.company_id AND s.external_id = b.external_id
""",
    "new_or_changed_posts": f"""
WITH s AS (SELECT * FROM ({_STATE}) WHERE closed_at IS NULL),
b AS (SELECT company_id, external_id, CASE WHEN length(title) > 30 THEN upper(title)
  ELSE list_aggregate(list_transform(string_split(upper(title), ' '), lambda x: upper(left(x, 1)) || lower(substr(x, 2))), 'string_agg', ' ') END AS title FROM ({_BATCH}))
SELECT b.* FROM b LEFT JOIN s ON s.company_id = b.company_id AND s.external_id = b.external_id WHERE s.id IS NULL OR s.title IS DISTINCT FROM b.title
""",
    "updated_companies": f"""
SELECT c.id, CASE WHEN r.id IS NULL THEN CAST(NULL AS VARCHAR) ELSE r.funding_stage END AS funding_stage, CASE WHEN r.id IS NULL THEN c.funding ELSE r.total_raised END AS total_raised,
       coalesce(nullif(c.headcount, 0), CASE WHEN r.id IS NULL THEN c.headcount ELSE r.headcount END) AS headcount
FROM (SELECT DISTINCT id, headcount, funding FROM discovery_company) c LEFT JOIN ({_LATEST_RESULT}) r ON c.id = r.id
""",
    "filled_profiles": f"""
SELECT c.id, CASE WHEN trim(c.funding) <> '' THEN c.funding WHEN r.id IS NULL THEN c.funding ELSE r.total_raised END AS funding,
       CASE WHEN trim(c.industry) <> '' OR r.id IS NULL THEN c.industry ELSE coalesce(r.funding_stage, 'unknown') END AS industry,
       CASE WHEN trim(c.domain) <> '' OR r.id IS NULL THEN c.domain ELSE left(c.id, 8) || '.example' END AS domain,
       CASE WHEN coalesce(trim(c.domain), '') = '' AND r.id IS NOT NULL THEN true ELSE c.domain_resolved END AS domain_resolved
FROM (SELECT DISTINCT id, funding, industry, domain, domain_resolved FROM discovery_company) c LEFT JOIN ({_LATEST_RESULT}) r ON c.id = r.id
""",
    "head_count_choice": f"""
SELECT c.id, coalesce(CASE WHEN r.headcount > 0 AND r.headcount NOT BETWEEN 1900 AND 2026 THEN r.headcount END, CASE WHEN c.headcount > 0 THEN c.headcount END, 1) AS headcount
FROM (SELECT DISTINCT id, headcount FROM discovery_company) c LEFT JOIN ({_LATEST_RESULT}) r ON c.id = r.id
""",
    "head_office_update": """
WITH m AS (SELECT DISTINCT trim(headquarters) AS raw, string_split(trim(headquarters), ',') AS p FROM discovery_company WHERE len(string_split(trim(headquarters), ',')) = 3),
c AS (SELECT DISTINCT id, headquarters, hq_city, hq_region, hq_country FROM discovery_company)
SELECT c.id, CASE WHEN coalesce(trim(hq_city), '') = '' THEN coalesce(nullif(trim(p[1]), ''), hq_city) ELSE hq_city END AS hq_city,
       CASE WHEN coalesce(trim(hq_city), '') = '' THEN coalesce(nullif(trim(p[2]), ''), hq_region) ELSE hq_region END AS hq_region,
       CASE WHEN coalesce(trim(hq_city), '') = '' THEN coalesce(nullif(trim(p[3]), ''), hq_country) ELSE hq_country END AS hq_country
FROM c LEFT JOIN m ON trim(c.headquarters) = m.raw
""",
    "tech_events": """
WITH r AS (SELECT DISTINCT id, company_id, captured_at, tech_stack, source FROM company_signal_result),
p AS (SELECT *, lag(id) OVER w AS prev_id, lag(tech_stack) OVER w AS prev_tech, lag(source) OVER w AS prev_source FROM r WINDOW w AS (PARTITION BY company_id ORDER BY captured_at, id)),
f AS (SELECT * FROM p WHERE source IN ('synthesis', 'search_panel') AND prev_source IN ('synthesis', 'search_panel')),
now_ AS (SELECT DISTINCT id, company_id, captured_at, unnest(tech_stack) AS tech FROM f), old AS (SELECT DISTINCT id, company_id, captured_at, unnest(prev_tech) AS tech FROM f),
label(tech, label) AS (VALUES ('palletq', 'PalletQ (Analytics, RUM)'), ('nestbox', 'Nestbox (Webmail, Email)'), ('ember-auth', 'Ember Auth (Authentication)'), ('tideway', 'tideway (Marketing automation)')),
e AS (SELECT 'tech_first_seen' AS event_type, n.* FROM now_ n ANTI JOIN old o ON n.id = o.id AND n.tech = o.tech UNION ALL SELECT 'tech_dropped', o.* FROM old o ANTI JOIN now_ n ON n.id = o.id AND n.tech = o.tech)
SELECT company_id, captured_at, event_type, e.tech, CASE event_type WHEN 'tech_first_seen' THEN 'Started' ELSE 'Stopped' END || ' using ' || label AS title,
       CAST(CASE event_type WHEN 'tech_first_seen' THEN 0.85 ELSE 0.7 END AS DOUBLE) AS confidence,
       CASE event_type WHEN 'tech_first_seen' THEN 'tech:' ELSE 'tech_drop:' END || e.tech || ':' || strftime(captured_at AT TIME ZONE 'UTC', '%Y-%m') AS event_key
FROM e JOIN label USING (tech)
""",
    "pattern_technologies": " UNION ALL ".join(f"SELECT doc_id, '{t}' AS tech FROM documents WHERE regexp_matches(text, '(?i){p}')" for t, p in _TECH_PATTERNS.items()),
    "first_in_page": f"""
WITH p AS (SELECT CAST(substr(id, 4) AS BIGINT) // 100 AS page, id, name, lower(trim(name)) AS n FROM ({_TRACKED})),
known AS (SELECT lower(trim(name)) AS n FROM discovery_company UNION SELECT lower(trim(apollo_org_name)) FROM discovery_company)
SELECT page, id, name FROM (SELECT *, row_number() OVER (PARTITION BY page, n ORDER BY id) AS k FROM p WHERE n <> '') WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM known WHERE known.n = p.n)
""".replace("known.n = p.n", "known.n = n_").replace("SELECT *, row_number()", "SELECT *, n AS n_, row_number()"),
    "tagged_companies": """
SELECT id, source || CASE WHEN hit AND source <> 'tracked' THEN '|tracked' ELSE '' END AS profiles, CASE WHEN hit THEN TIMESTAMPTZ '2025-06-01 00:00:00+00' ELSE seen END AS last_seen_at
FROM (SELECT id, source, max(last_seen_at) AS seen, lower(apollo_org_name) IN (SELECT lower(name) FROM (SELECT min(name) AS name FROM tracked_company GROUP BY id)) AS hit FROM discovery_company GROUP BY id, source, apollo_org_name)
""",
    "names_known": rf"""
WITH k AS (SELECT lower(regexp_replace(name, '[^a-zA-Z0-9]+', ' ', 'g')) AS k FROM discovery_company UNION SELECT lower(apollo_org_name) FROM discovery_company)
SELECT id, name FROM ({_TRACKED}) WHERE trim(regexp_replace(lower(regexp_replace(coalesce(name, ''), '(?i)\b(inc|incorporated|llc|l\.l\.c|ltd|limited|corp|corporation|co|company|holdings|technologies|technology|labs|group)\b\.?', ' ', 'g')), '[^a-z0-9]+', ' ', 'g')) IN (SELECT k FROM k WHERE k IS NOT NULL)
""",
    "embedding_plan": """
SELECT id, CASE WHEN t <> '' THEN 'embed' WHEN domain_resolved THEN 'clear' ELSE 'keep' END AS action, t AS text
FROM (SELECT DISTINCT id, domain_resolved, concat_ws(' ', nullif(trim(industry), ''), nullif(trim(funding), '')) AS t FROM discovery_company WHERE id > '4' ORDER BY id LIMIT 500)
""",
    "year_leaks": "SELECT count(*) FILTER (headcount BETWEEN 2023 AND 2028) AS n_leaks, count(headcount) AS n_counts FROM (SELECT DISTINCT id, headcount FROM discovery_company)",
    "merged_lists": """
WITH r AS (SELECT DISTINCT id, company_id, captured_at, hiring_count, hiring_roles, tech_stack FROM company_signal_result),
e AS (SELECT id, unnest(list_concat(coalesce(tech_stack, []), coalesce(hiring_roles, []))) AS x, generate_subscripts(list_concat(coalesce(tech_stack, []), coalesce(hiring_roles, [])), 1) AS i FROM r),
m AS (SELECT id, x, min(i) AS i FROM e GROUP BY 1, 2)
SELECT r.id, coalesce((SELECT string_agg(x, '|' ORDER BY i) FROM m WHERE m.id = r.id), '') AS items FROM r
""",
    "outcome_rates": """
SELECT source, count(*) AS n, count(*) FILTER (s = 'enriched') AS n_ok, count(*) FILTER (s = 'failed') AS n_failed,
       round(count(*) FILTER (s = 'enriched') / nullif(count(*) FILTER (s IN ('enriched', 'failed')), 0), 6) AS ok_share
FROM (SELECT DISTINCT id, source, signal_enrichment_status AS s FROM discovery_company) GROUP BY 1
""",
    "quality_gate": "SELECT reader, round(avg(grade), 6) AS mean_grade, min(grade) AS least_grade, round(avg(grade), 6) >= 3 AND min(grade) >= 1 AS passes FROM reading_label GROUP BY 1",
    "sample_rows": "SELECT id FROM (SELECT DISTINCT id FROM discovery_company) ORDER BY md5('probe-1' || id), id LIMIT 100",
    "listed_companies": f"SELECT DISTINCT id, domain FROM discovery_company WHERE lower(domain) IN (SELECT lower(domain) FROM ({_TRACKED}) WHERE domain IS NOT NULL)",
    "unignored_events": "SELECT source, count(*) AS n, CAST(sum(TRY_CAST(payload->>'$.weight' AS BIGINT)) AS BIGINT) AS weight FROM signal_event WHERE payload->>'$.ignored_reason' IS NULL GROUP BY 1",
    "reset_statuses": """
SELECT id, CASE WHEN again THEN 'pending' ELSE s END AS status, CASE WHEN again THEN 0 ELSE n END AS attempts
FROM (SELECT DISTINCT id, signal_enrichment_status AS s, signal_attempt_count AS n, signal_enrichment_status IN ('failed', 'skipped') AND signal_attempt_count < 3 AS again FROM discovery_company)
""",
    "edge_upsert": f"""
WITH a AS ({_VENDORS.format('<')}), b AS ({_VENDORS.format('>=')})
SELECT coalesce(a.src_id, b.src_id) AS src_id, coalesce(a.dst_id, b.dst_id) AS dst_id, b.dst_id AS dst_company_id, CASE WHEN a.src_id IS NULL THEN 'late' ELSE 'early' END AS source,
       coalesce(a.observed_at, b.observed_at) AS observed_at, coalesce(b.last_seen_at, a.last_seen_at) AS last_seen_at
FROM a FULL JOIN b ON a.src_id = b.src_id AND a.dst_id = b.dst_id
""",
    "customer_edges": f"""
WITH e AS (SELECT id AS src_id, {_SLUG.format('name')} AS dst_id, lower(domain) AS d FROM ({_TRACKED})), c AS (SELECT DISTINCT id, name, domain FROM discovery_company),
bd AS (SELECT lower(domain) AS d, min(id) AS id FROM c WHERE domain IS NOT NULL GROUP BY 1), bn AS (SELECT {_SLUG.format('name')} AS dst_id, min(id) AS id FROM c GROUP BY 1 HAVING count(DISTINCT id) = 1)
SELECT src_id, e.dst_id, coalesce(bd.id, bn.id) AS dst_company_id, CASE WHEN bd.id IS NOT NULL THEN 'domain' ELSE 'name' END AS how
FROM e LEFT JOIN bd ON e.d = bd.d LEFT JOIN bn ON e.dst_id = bn.dst_id WHERE coalesce(bd.id, bn.id) IS NOT NULL AND coalesce(bd.id, bn.id) <> src_id
""",
    "daily_budget_left": "SELECT date_trunc('day', ts) AT TIME ZONE 'UTC' AS window_start, count(*) AS n_calls, least(count(*), 270) AS n_admitted, count(*) - least(count(*), 270) AS n_refused FROM events GROUP BY 1",
    "cached_board_scan": "SELECT id, max(updated_at) AS updated_at FROM discovery_company WHERE domain IS NOT NULL GROUP BY id, domain ORDER BY updated_at DESC NULLS LAST, id LIMIT 100",
    "known_open_posts": f"SELECT company_id, external_id, title FROM ({_STATE}) WHERE closed_at IS NULL",
    "remerged_posts": f"""
SELECT b.company_id, b.external_id, upper(b.title) AS title, coalesce(s.role_family, 'other') AS role_family, CAST(CASE WHEN s.role_family IS NULL THEN 0 ELSE coalesce(len(s.concepts), 0) END AS INTEGER) AS n_concepts
FROM ({_BATCH}) b LEFT JOIN ({_STATE}) s ON b.company_id = s.company_id AND b.external_id = s.external_id
""",
    "ready_hosts": """
SELECT lower(trim(domain)) AS host, min(id) AS id, count(*) AS n_companies FROM (SELECT DISTINCT id, domain FROM discovery_company WHERE signal_enrichment_status = 'enriched' AND trim(domain) <> '') GROUP BY 1
""",
    "profile_changes": """
WITH r AS (SELECT DISTINCT id, company_id, captured_at, funding_stage, headcount FROM company_signal_result),
p AS (SELECT *, lag(id) OVER w AS prev_id, lag(funding_stage) OVER w AS prev_stage, lag(headcount) OVER w AS prev_heads FROM r WINDOW w AS (PARTITION BY company_id ORDER BY captured_at, id))
SELECT company_id, captured_at, 'funding_round' AS change, prev_stage AS before, funding_stage AS after FROM p WHERE prev_id IS NOT NULL AND coalesce(funding_stage, '') <> '' AND funding_stage IS DISTINCT FROM prev_stage
UNION ALL SELECT company_id, captured_at, 'headcount_jump', CAST(prev_heads AS VARCHAR), CAST(headcount AS VARCHAR) FROM p WHERE prev_heads > 0 AND headcount >= prev_heads * CAST(1.2 AS DOUBLE)
""",
}
_OPEN = """
  SELECT * FROM (SELECT DISTINCT id, company_id, role_family, concepts, first_seen_at, closed_at FROM discovery_job_post)
  WHERE company_id IS NOT NULL AND first_seen_at <= TIMESTAMPTZ '{0} 00:00:00+00' AND (closed_at IS NULL OR closed_at > TIMESTAMPTZ '{0} 00:00:00+00')
"""


def _growth(item: str, rows: str, more: str) -> str:
    count = f"SELECT company_id, {item}, count(*) AS n FROM ({rows}) WHERE {item} IS NOT NULL GROUP BY 1, 2"
    return f"""
WITH a AS ({count.format('2025-04-01')}), b AS ({count.format('2025-03-02')})
SELECT * FROM (SELECT a.company_id, a.{item}, CASE WHEN b.n IS NULL THEN 'first_seen' WHEN {more} THEN 'spike' END AS event, b.n AS prev_count, a.n AS curr_count
               FROM a LEFT JOIN b ON a.company_id = b.company_id AND a.{item} = b.{item}) WHERE event IS NOT NULL
"""


ORACLES["slots_per_org"] = f"SELECT org_id, count(*) AS n_slots FROM ({oracles.ORACLES['fair_share_select']}) GROUP BY 1"
ORACLES["role_growth"] = _growth("role_family", _OPEN, "a.n >= 3 AND a.n >= b.n * 2")
ORACLES["concept_growth"] = _growth("concept", f"SELECT company_id, lower(unnest(concepts)) AS concept FROM ({_OPEN})", "a.n >= 2 AND a.n > b.n")
ORACLES["fill_rate_change"] = f"""
WITH x AS (SELECT DISTINCT id, funding, industry, domain FROM discovery_company), y AS ({ORACLES['filled_profiles']})
""" + " UNION ALL ".join(f"SELECT '{c}' AS field, (SELECT count(*) FROM x WHERE trim({c}) <> '') AS n_before, (SELECT count(*) FROM y WHERE trim({c}) <> '') AS n_after, (SELECT count(*) FROM y WHERE trim({c}) <> '') - (SELECT count(*) FROM x WHERE trim({c}) <> '') AS n_gained" for c in ("funding", "industry", "domain"))
