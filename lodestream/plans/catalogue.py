"""Queries of the engine's own operators over the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream import config
from lodestream.functions import dates, names, numbers, text, urls, vectors
from lodestream.operators import events as ev
from lodestream.operators import graph, merge, schedule, search, snapshots, tech
from lodestream.runtime import load

#: The clock of the queries.
AS_OF = "2025-06-01 00:00:00"


def now() -> Column:
    return F.to_timestamp(F.lit(AS_OF))


def _companies(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One row per company; repeated rows differ in audit times only."""
    audit = {"updated_at", "last_seen_at"}
    df = load(spark, sf_dir, "discovery_company")
    keys = [c for c in columns if c not in audit]
    return df.groupBy(*keys).agg(*([F.max(c).alias(c) for c in columns if c in audit] or [F.count(F.lit(1)).alias("n_rows")])).select(*columns)


def _watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "company").filter(F.col("deleted_at").isNull()).select("org_id", F.col("discovery_company_id").alias("id")).filter(F.col("id").isNotNull()).distinct()


# --- scans, filters, counts -------------------------------------------------------------------------------------


def pending_scan(spark, sf_dir):
    c = _companies(spark, sf_dir, "id", "name", "created_at", "signal_enrichment_status", "domain", "domain_resolved")
    due = c.filter((F.col("signal_enrichment_status") == "pending") & F.col("domain").isNotNull() & F.col("domain_resolved"))
    return due.orderBy("created_at", "id").limit(50).select("id", "name", "created_at")


def claim_transition(spark, sf_dir):
    c = _companies(spark, sf_dir, "id", "signal_enrichment_status", "signal_attempt_count")
    claimed = F.col("signal_enrichment_status").isin("pending", "processing")
    return c.select("id", F.when(claimed, "processing").otherwise(F.col("signal_enrichment_status")).alias("status"), (F.col("signal_attempt_count") + F.when(claimed, 1).otherwise(0)).alias("attempts"))


def scheduler_metrics(spark, sf_dir):
    c = _companies(spark, sf_dir, "id", "signal_enrichment_status", "headcount", "domain", "created_at")
    st = F.col("signal_enrichment_status")
    return c.agg(
        F.count_if(st == "pending").alias("n_pending"), F.count_if(st == "processing").alias("n_processing"), F.count_if(st == "enriched").alias("n_enriched"),
        F.count_if(st == "failed").alias("n_failed"), F.count_if(F.col("headcount").isNull() | (F.col("headcount") == 0)).alias("n_no_headcount"),
        F.max("created_at").alias("last_created"), F.max(F.when(st == "enriched", F.col("created_at"))).alias("last_enriched_created"),
    )


def reconcile_backlog(spark, sf_dir):
    c = _companies(spark, sf_dir, "id", "signal_enrichment_status", "signal_attempt_count", "created_at")
    st, n = F.col("signal_enrichment_status"), F.col("signal_attempt_count")
    due = c.filter(st.isin("failed", "pending", "partial") & (n < 3) & dates.retry_due(F.col("created_at"), n, now()))
    return due.orderBy(F.when(st == "failed", 0).when(st == "partial", 1).otherwise(2), F.asc_nulls_first("created_at"), "id").limit(50).select("id", st.alias("status"), n.alias("attempts"))


def stuck_count(spark, sf_dir):
    c = _companies(spark, sf_dir, "id", "signal_enrichment_status", "updated_at")
    return c.agg(F.count_if((F.col("signal_enrichment_status") == "pending") & dates.older_than(F.col("updated_at"), now(), "60 DAYS")).alias("n_stuck"))


def keyset_page(spark, sf_dir):
    c = load(spark, sf_dir, "tracked_company").select("id", "name").filter(F.col("id") > "tc_000000100").groupBy("id").agg(F.min("name").alias("name"))
    return c.orderBy("id").limit(100)


def head_count_missing(spark, sf_dir):
    c = _companies(spark, sf_dir, "id", "headcount", "updated_at").filter(F.col("headcount").isNull() | (F.col("headcount") == 0))
    return c.orderBy(F.desc("updated_at"), "id").limit(100).select("id", "updated_at")


def head_office_strings(spark, sf_dir):
    h = F.trim("headquarters")
    return load(spark, sf_dir, "discovery_company").filter((h != "") & F.col("hq_city").isNull()).select(h.alias("headquarters")).distinct().orderBy("headquarters").limit(200)


def count_distinct_head_offices(spark, sf_dir):
    return load(spark, sf_dir, "discovery_company").agg(F.countDistinct("headquarters").alias("n_distinct"), F.count(F.lit(1)).alias("n_rows"))


def fill_rates(spark, sf_dir):
    return merge.fill_rates(load(spark, sf_dir, "discovery_company"), ["domain", "industry", "headquarters", "hq_city", "hq_region", "hq_country", "funding", "employee_range", "headcount"])


def status_histogram(spark, sf_dir):
    return _companies(spark, sf_dir, "id", "signal_enrichment_status").groupBy("signal_enrichment_status").agg(F.count(F.lit(1)).alias("n"))


def language_histogram(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy(F.lower(F.split_part(F.coalesce("lang", F.lit("?")), F.lit("-"), F.lit(1))).alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("n_chars"))


def funnel_status(spark, sf_dir):
    r = load(spark, sf_dir, "company_signal_result").select("id", "hiring_count", "tech_stack", "funding_stage").distinct()
    data = (F.coalesce("hiring_count", F.lit(0)) > 0) | (F.coalesce(F.size("tech_stack"), F.lit(0)) > 0)
    status = F.when(F.col("funding_stage").isNotNull(), "enriched").when(data, "partial").otherwise("failed")
    return r.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


# --- selection ----------------------------------------------------------------------------------------------------


def _watched_ranked(spark, sf_dir) -> DataFrame:
    c = _companies(spark, sf_dir, "id", "name", "updated_at")
    stale = _watch(spark, sf_dir).join(c, "id").filter(dates.older_than(F.col("updated_at"), now(), "20 HOURS"))
    return schedule.ranked_within(stale, "org_id", [F.asc_nulls_first("updated_at"), F.asc("id")], 5, "org_rank")


def watched_stale_ranked(spark, sf_dir):
    return _watched_ranked(spark, sf_dir).select("org_id", "org_rank", "id", "updated_at")


def fair_share_select(spark, sf_dir):
    return schedule.fair_share(_watched_ranked(spark, sf_dir), "id", "org_id", "org_rank", 60).select("org_id", "org_rank", "id")


def cold_index(spark, sf_dir):
    c = _companies(spark, sf_dir, "id", "last_seen_at").join(_watch(spark, sf_dir), "id", "left_anti")
    return c.filter(~(F.col("last_seen_at") > now() - F.expr("INTERVAL 90 DAYS"))).orderBy("last_seen_at", "id").limit(100)


def recently_seen_index(spark, sf_dir):
    c = _companies(spark, sf_dir, "id", "last_seen_at").join(_watch(spark, sf_dir), "id", "left_anti")
    return c.filter(F.col("last_seen_at") > now() - F.expr("INTERVAL 90 DAYS")).orderBy(F.desc_nulls_last("last_seen_at"), "id").limit(100)


def watched_distinct(spark, sf_dir):
    return _companies(spark, sf_dir, "id", "name").join(_watch(spark, sf_dir), "id", "left_semi")


# --- snapshots, posts ---------------------------------------------------------------------------------------------


def _results(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "company_signal_result").select("id", "company_id", "captured_at", "hiring_count", "hiring_roles", "tech_stack").distinct()


def _paired(spark, sf_dir) -> DataFrame:
    return snapshots.with_previous(_results(spark, sf_dir), "company_id", "captured_at", ["hiring_count", "hiring_roles", "tech_stack"], ["id"])


def latest_snapshot(spark, sf_dir):
    return merge.latest_per_key(_results(spark, sf_dir), ["company_id"], [F.desc("captured_at"), F.desc("id")]).select("company_id", "id", "captured_at", "hiring_count")


def hiring_surges(spark, sf_dir):
    return snapshots.surges(_paired(spark, sf_dir), "company_id", "captured_at", "hiring_count")


def role_families_first_seen(spark, sf_dir):
    return snapshots.role_families_first_seen(_paired(spark, sf_dir), "company_id", "captured_at", "hiring_roles")


def tech_adopt_drop(spark, sf_dir):
    return snapshots.set_changes(_paired(spark, sf_dir), "company_id", "captured_at", "tech_stack")


def _posts(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "discovery_job_post").select("id", "company_id", "title", "role_family", "concepts", "first_seen_at", "closed_at").distinct()


def role_spikes(spark, sf_dir):
    return snapshots.spikes(_posts(spark, sf_dir), "company_id", F.col("role_family"))


def concept_spikes(spark, sf_dir):
    return snapshots.concept_spikes(_posts(spark, sf_dir), "company_id", F.to_timestamp(F.lit("2025-04-01")), days=120)


def concepts_first_seen(spark, sf_dir):
    return snapshots.concepts_first_seen(_posts(spark, sf_dir), "company_id", F.to_timestamp(F.lit("2025-04-01")), days=60)


def role_family_histogram(spark, sf_dir):
    return _posts(spark, sf_dir).groupBy(text.role_family(F.col("title")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


# --- merges -------------------------------------------------------------------------------------------------------


def keyed_merge(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "event_type", "ts", "value")
    half = lambda c: e.filter(c).groupBy("user_id", "event_type").agg(F.max("ts").alias("last_seen"), F.min("ts").alias("first_seen"), F.round(F.max("value"), 6).alias("top_value"))
    edge = F.lit("2024-01-15").cast("timestamp_ntz")
    return merge.keyed_merge(half(F.col("ts") < edge), half(F.col("ts") >= edge), ["user_id", "event_type"], {"last_seen": "greatest", "first_seen": "keep_old", "top_value": "greatest"})


def close_missing(spark, sf_dir):
    s = load(spark, sf_dir, "job_post_snapshot").withColumn("external_id", F.lower(F.trim("external_id"))).filter(F.col("external_id") != "")
    return merge.closed_over_snapshots(s, "company_id", "external_id", "snapshot_on", "closed_on")


def json_patch(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>").alias("props"))
    patches = load(spark, sf_dir, "events").filter(F.col("event_type") == "purchase").select("event_id", F.create_map(F.lit("k"), F.lit("patched"), F.lit("seen"), F.lit("yes")).alias("props"))
    out = merge.merge_patch(e, patches, "event_id", "props")
    return out.select("event_id", F.col("props")["k"].alias("k"), F.col("props")["seen"].alias("seen"))


def insert_ignore(spark, sf_dir):
    e = load(spark, sf_dir, "signal_event").select("id", "dedupe_key", "observed_at")
    edge = F.to_timestamp(F.lit("2025-01-01"))
    return merge.insert_ignore(e.filter(F.col("observed_at") < edge), e.filter(F.col("observed_at") >= edge), ["dedupe_key"], [F.asc("observed_at"), F.asc("id")]).select("dedupe_key", "id")


# --- events -------------------------------------------------------------------------------------------------------


def _signals(spark, sf_dir) -> DataFrame:
    """One row per event: type in its normal form, confidence between 0 and 1."""
    e = load(spark, sf_dir, "signal_event").filter(F.trim("event_type") != "")
    kind = F.regexp_replace(F.trim(F.lower("event_type")), "[ _-]+", "_")
    c = F.when(F.col("confidence") > 1, F.col("confidence") / 100).otherwise(F.col("confidence"))
    return e.groupBy("dedupe_key", "company_id").agg(F.min(kind).alias("full_type"), F.min("observed_at").alias("observed_at"), F.max(c).alias("confidence"))


def _typed(spark, sf_dir) -> DataFrame:
    """Events with the leading known type of their full type (product_launch_seed is a product_launch), else with that."""
    known = "|".join(sorted(config.EVENT_WEIGHTS, key=len, reverse=True))
    return _signals(spark, sf_dir).withColumn("event_type", F.coalesce(F.nullif(F.regexp_extract("full_type", f"^({known})", 1), F.lit("")), F.col("full_type")))


def heat_scores(spark, sf_dir):
    return ev.heat_scores(ev.heat(_typed(spark, sf_dir), "company_id", now(), config.EVENT_WEIGHTS), "company_id")


def heat_reasons(spark, sf_dir):
    return ev.heat_reasons(ev.heat(_typed(spark, sf_dir), "company_id", now(), config.EVENT_WEIGHTS), "company_id")


def story_cluster(spark, sf_dir):
    """Reports of one story, which is the key that the payload names, else the month."""
    told = load(spark, sf_dir, "signal_event").filter(F.trim("event_type") != "").groupBy("dedupe_key", "company_id").agg(F.min(F.get_json_object("payload", "$.key")).alias("key"))
    s = _signals(spark, sf_dir).join(told, ["dedupe_key", "company_id"]).withColumn("story", F.coalesce("key", dates.month_key(F.col("observed_at"))))
    return ev.stories(s, ["company_id", "full_type"], "story", ["observed_at", "dedupe_key"], "confidence")


def event_cluster_fold(spark, sf_dir):
    kinds = [F.lit(k) for k in config.CLUSTER_TYPES]
    d = load(spark, sf_dir, "signal_event").filter(F.trim("event_type") != "")
    kind = F.regexp_extract(F.regexp_replace(F.trim(F.lower("event_type")), "[ _-]+", "_"), f"^({'|'.join(config.CLUSTER_TYPES)})", 1)
    c = F.when(F.col("confidence") > 1, F.col("confidence") / 100).otherwise(F.col("confidence"))
    reports = d.select("company_id", kind.alias("event_type"), "dedupe_key", "title", "observed_at", F.col("evidence_url").alias("url"), c.alias("confidence"), *[F.get_json_object("payload", f"$.{x}").alias(x) for x in ("story", "person", "amount")]).filter(F.col("event_type").isin(*kinds))
    return ev.cluster_reports(merge.latest_per_key(reports, ["dedupe_key"], [F.asc("observed_at"), F.asc_nulls_last("url")]))


def relevance_filter(spark, sf_dir):
    d = load(spark, sf_dir, "signal_event_draft").select("draft_id", "company_id", "title", "source", "confidence").distinct()
    c = _companies(spark, sf_dir, "id", "name").groupBy("id").agg(F.min("name").alias("name")).withColumnRenamed("id", "company_id")
    return ev.relevant(d.join(c, "company_id"), "name").select("draft_id", "confidence")


def funding_grounding(spark, sf_dir):
    r = load(spark, sf_dir, "company_signal_result").select("id", "company_id", "funding_stage", "total_raised").distinct()
    evidence = load(spark, sf_dir, "discovery_company").select(F.col("id").alias("company_id"), "funding").groupBy("company_id").agg(F.min("funding").alias("funding"))
    df = r.join(evidence, "company_id", "left").withColumn("signals", F.array(F.lit("raised $5m"), F.lit("new office"))).withColumn("score", F.lit(60))
    out = ev.grounded_funding(df, "signals", "score", "funding_stage", "total_raised", "funding")
    return out.select("id", F.array_join("signals", ";").alias("signals"), "score", "funding_stage", "total_raised")


def recent_event_counts(spark, sf_dir):
    s = _signals(spark, sf_dir)
    within = lambda d: F.count_if(F.col("observed_at") > now() - F.make_dt_interval(F.lit(d)))
    return s.groupBy("full_type").agg(within(7).alias("n_7d"), within(30).alias("n_30d"), within(90).alias("n_90d"), F.count(F.lit(1)).alias("n"))


# --- names, text, numbers, addresses ------------------------------------------------------------------------------


def directory_keys(spark, sf_dir):
    t = load(spark, sf_dir, "tracked_company").select("id", "name", "domain").distinct()
    return t.select("id", "name", names.directory_key(F.col("name")).alias("name_key"), names.domain_stem(F.col("domain")).alias("stem"))


def weak_names(spark, sf_dir):
    t = load(spark, sf_dir, "tracked_company").select(names.clean_name(F.col("name")).alias("cleaned")).distinct()
    return t.select("cleaned", names.is_weak_name(F.col("cleaned")).alias("weak"), F.array_join(names.name_keys(F.col("cleaned")), "|").alias("keys"))


def entity_match(spark, sf_dir):
    from lodestream.operators import resolve

    keys = resolve.company_keys(_companies(spark, sf_dir, "id", "name", "apollo_org_name", "hq_region"), "id", ["name", "apollo_org_name"], "hq_region")
    probes = load(spark, sf_dir, "tracked_company").select("id", "name", "state").groupBy("id").agg(F.min("name").alias("name"), F.min("state").alias("state"))
    return resolve.match_names(probes, keys, "id", "name", "state")


def slug_directory(spark, sf_dir):
    from lodestream.operators import resolve

    boards = F.array(*[F.lit(b) for b in ("lever", "greenhouse", "ashby", "workable")])
    board = F.element_at(boards, F.length("name") % 4 + 1)
    directory = load(spark, sf_dir, "tracked_company").select(board.alias("board"), "name", names.domain_stem(F.col("domain")).alias("slug")).filter(F.col("slug").isNotNull()).distinct()
    return resolve.directory_match(_companies(spark, sf_dir, "id", "name", "domain"), directory, "id", "name", "domain")


def state_codes(spark, sf_dir):
    return load(spark, sf_dir, "tracked_company").select("state").distinct().select("state", names.state_code(F.col("state")).alias("code"))


def page_fingerprints(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.page_fingerprint(F.col("text")).alias("fingerprint"))


def inverted_index(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return search.document_frequencies(search.inverted_index(docs, "doc_id", text.words(F.col("text"))))


def rounded_head_counts(spark, sf_dir):
    return _companies(spark, sf_dir, "id", "headcount").select("id", numbers.round_head_count(F.col("headcount")).alias("rounded"), numbers.sanitize_head_count(F.col("headcount"), 2025, floor=1900).alias("sane"))


def formatted_amounts(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", numbers.format_amount(F.round(F.col("o_totalprice")) * 1000 + 1).alias("amount"), numbers.parse_amount(F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"))).alias("parsed"))


def parsed_dates(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("t"))
    k = F.col("o_orderkey") % 4
    written = F.when(k == 0, F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format("t", "dd MMM yyyy HH:mm:ss '+0000'")).when(k == 2, F.date_format("t", "yyyy/MM/dd")).otherwise(F.date_format("t", "MM/dd/yyyy"))
    return o.select("o_orderkey", dates.parse_notice_date(written).alias("parsed"))


def url_parts(spark, sf_dir):
    e = load(spark, sf_dir, "signal_event_draft").select("draft_id", F.col("evidence_url").alias("url")).filter(F.col("url").isNotNull()).distinct()
    return e.select("draft_id", urls.host(F.col("url")).alias("host"), urls.root_domain(urls.host(F.col("url"))).alias("root"), urls.path_slug(F.col("url")).alias("slug"))


# --- graph --------------------------------------------------------------------------------------------------------


def vendor_edges(spark, sf_dir):
    r = load(spark, sf_dir, "company_signal_result").select("company_id", "tech_stack").distinct()
    return graph.edges_from_list(r, "company_id", "tech_stack", "uses_vendor", "vendor", 40).select("src_id", "edge_type", "dst_id")


def two_hops(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    pairs = li.join(o, "l_orderkey").select("o_custkey", "l_suppkey").distinct()
    return pairs.join(s, "l_suppkey").groupBy("o_custkey").agg(F.countDistinct("s_nationkey").alias("n_nations"), F.count(F.lit(1)).alias("n_suppliers"))


def reachable(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"))
    n = load(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    return graph.hops(s.unionByName(n), 3)


# --- vectors ------------------------------------------------------------------------------------------------------


def _vector_queries(e: DataFrame) -> DataFrame:
    return e.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def semantic_top_k(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    return search.top_k(e, _vector_queries(e), "vec_id", "embedding", 10, 0.0)


def multi_query_best(spark, sf_dir):
    return search.best_of_queries(semantic_top_k(spark, sf_dir))


def centroid_rerank(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    c = vectors.centroid(e, ["label"], "embedding")
    joined = e.join(F.broadcast(c), "label")
    return joined.select("vec_id", "label", F.round(vectors.cosine(F.col("embedding"), vectors.blend(F.col("embedding"), F.col("centroid"))), 4).alias("score"))


# --- windows ------------------------------------------------------------------------------------------------------


def window_budget(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return schedule.window_budget(e, "ts", ["event_id"], "1 hour", 15)


def daily_cap(spark, sf_dir):
    return schedule.daily_cap(load(spark, sf_dir, "events"), "ts", ["ts", "event_id"], 25).select("event_id", "day", "place")


def rolling_yield(spark, sf_dir):
    e = load(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return schedule.rolling_list(e, "user_id", ["day"], "n").select("user_id", "day", "n", "last_sum", "last_n")


def page_tech(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("html"), F.concat(F.lit("https://pages.example/"), F.coalesce("source", F.lit(""))).alias("url"))
    rules = spark.createDataFrame([("sql", "html", "", "SELECT"), ("heading", "html", "", "<h2"), ("letter", "html", "", "Subscribe to"), ("news", "url", "", "news"), ("pages", "url", "", "pages")], "tech string, source string, key string, regex string")
    found = tech.detect(tech.page_features(d, "doc_id", "html", "url"), rules)
    return tech.with_implications(found, [("heading", "markup")], [("letter", "heading")], [("news", "pages")]).select(F.col("page_id").alias("doc_id"), "tech")


# --- general SQL --------------------------------------------------------------------------------------------------


def pricing_summary(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(price), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


def regional_revenue(spark, sf_dir):
    c, o, li = (load(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    s, n, r = (load(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    j = j.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def top_orders(spark, sf_dir):
    o, li = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    rev = li.groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    return rev.join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey").orderBy(F.desc("revenue"), "l_orderkey").limit(20)


def grouped_rollup(spark, sf_dir):
    return load(spark, sf_dir, "events").rollup("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def session_lengths(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("started"), "n")


QUERIES = {
    f.__name__: f
    for f in (
        pending_scan, claim_transition, scheduler_metrics, reconcile_backlog, stuck_count, keyset_page, head_count_missing, head_office_strings, count_distinct_head_offices, fill_rates,
        status_histogram, language_histogram, funnel_status, watched_stale_ranked, fair_share_select, cold_index, recently_seen_index, watched_distinct, latest_snapshot, hiring_surges,
        role_families_first_seen, tech_adopt_drop, role_spikes, concept_spikes, concepts_first_seen, role_family_histogram, keyed_merge, close_missing, json_patch, insert_ignore, heat_scores,
        heat_reasons, story_cluster, event_cluster_fold, relevance_filter, funding_grounding, recent_event_counts, directory_keys, weak_names, entity_match, slug_directory, state_codes,
        page_fingerprints, inverted_index, rounded_head_counts, formatted_amounts, parsed_dates, url_parts, vendor_edges, two_hops, reachable, semantic_top_k, multi_query_best,
        centroid_rerank, window_budget, daily_cap, rolling_yield, page_tech, pricing_summary, regional_revenue, top_orders, grouped_rollup, session_lengths,
    )
}
