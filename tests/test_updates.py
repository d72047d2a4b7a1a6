"""State updates: ties, nulls, repeated rows, empty tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestream import runtime
from lodestream.functions import text, urls
from lodestream.operators import events, merge, updates
from lodestream.sources import feeds

T1, T2 = datetime(2025, 1, 1), datetime(2025, 2, 1)
POSTS = "company_id string, external_id string, title string, location string, body_text string, role_family string, seniority string, concepts array<string>"
STATE = POSTS + ", first_seen_at timestamp, last_seen_at timestamp, closed_at timestamp"


def at(t):
    return F.lit(t).cast("timestamp")


def test_posts_are_inserted_kept_closed_and_reopened(spark):
    state = [
        ("a", "1", "old", "x", "body", "sales", None, ["c"], T1, T1, None), ("a", "2", "gone", None, None, None, None, None, T1, T1, None),
        ("a", "3", "back", None, None, None, None, None, T1, T1, T1), ("b", "1", "not polled", None, None, None, None, None, T1, T1, None), ("a", "4", "closed", None, None, None, None, None, T1, T1, T1),
    ]
    batch = [("a", "1", "new", None, None, None, "senior", None), ("a", "1", "new", None, None, None, "senior", None), ("a", "3", "back", None, None, None, None, None), ("a", "9", "first", None, None, None, None, None), ("a", " ", "blank", None, None, None, None, None), (None, "1", "none", None, None, None, None, None)]
    out = updates.upsert_posts(spark.createDataFrame(state, STATE), spark.createDataFrame(batch, POSTS), at(T2))
    got = {(r.company_id, r.external_id): (r.title, r.location, r.body_text, r.role_family, r.seniority, r.concepts, r.first_seen_at, r.last_seen_at, r.closed_at) for r in out.collect()}
    assert got == {
        ("a", "1"): ("new", None, "body", "sales", "senior", ["c"], T1, T2, None), ("a", "2"): ("gone", None, None, None, None, None, T1, T1, T2), ("a", "3"): ("back", None, None, None, None, None, T1, T2, None),
        ("b", "1"): ("not polled", None, None, None, None, None, T1, T1, None), ("a", "4"): ("closed", None, None, None, None, None, T1, T1, T1), ("a", "9"): ("first", None, None, None, None, None, T2, T2, None),
    }
    empty = spark.createDataFrame([], POSTS)
    assert updates.upsert_posts(spark.createDataFrame(state, STATE), empty, at(T2)).filter("closed_at = timestamp'2025-02-01'").count() == 0


def test_new_or_changed(spark):
    state = spark.createDataFrame([("a", "1", "t", None, None, None, None, None, T1, T1, None), ("a", "2", None, None, None, None, None, None, T1, T1, None), ("a", "3", "t", None, None, None, None, None, T1, T1, T1)], STATE)
    batch = spark.createDataFrame([("a", "1", "t"), ("a", "2", None), ("a", "3", "t"), ("a", "4", None)], "company_id string, external_id string, title string")
    assert {r.external_id for r in updates.new_or_changed_posts(batch, state).collect()} == {"3", "4"}


def test_profiles_fill_only_what_is_empty(spark):
    state = spark.createDataFrame([("1", " ", None, False), ("2", "x", "own.example", None), ("3", None, "", False)], "id string, industry string, domain string, domain_resolved boolean")
    found = spark.createDataFrame([("1", "a", "new.example"), ("2", "b", "new.example"), ("9", "c", "d")], "id string, industry string, domain string")
    got = {r.id: (r.industry, r.domain, r.domain_resolved) for r in updates.filled_profiles(state, found, ["industry"]).collect()}
    assert got == {"1": ("a", "new.example", True), "2": ("x", "own.example", None), "3": (None, "", False)}


def test_companies_keep_head_counts_and_embeddings(spark):
    state = spark.createDataFrame([("1", 0, [1.0], "a"), ("2", 7, [2.0], "b")], "id string, headcount int, embedding array<double>, summary string")
    new = spark.createDataFrame([("1", 5, None, None), ("2", 9, [3.0], "c"), ("8", 1, None, None)], "id string, headcount int, embedding array<double>, summary string")
    got = {r.id: (r.headcount, r.embedding, r.summary) for r in updates.updated_companies(state, new, ["summary"]).collect()}
    assert got == {"1": (5, [1.0], None), "2": (7, [3.0], "c")}


def test_head_count_choice(spark):
    rows = [(2019, 2019, 5, 9), (2019, 2025, 0, 9), (40, 50, 5, 9), (None, 2010, None, None), (None, None, None, None)]
    c = [F.col(x) for x in "msex"]
    got = [r[0] for r in spark.createDataFrame(rows, "m int, s int, e int, x int").select(updates.head_count_choice(*c, 2025)).collect()]
    assert got == [2019, 9, 40, 2010, None]


def test_tech_events_need_two_full_runs_and_a_business_category(spark):
    schema = "company_id string, captured_at timestamp, tech_stack array<string>, source string, prev struct<tech_stack:array<string>,source:string>"
    rows = [("a", T2, ["crm", "js"], "full", (["mail"], "full")), ("b", T2, ["crm"], "dns", (["mail"], "full")), ("c", T2, ["crm"], "full", ([], "old")), ("d", T2, ["crm"], "full", None), ("e", T2, None, "full", (None, "full"))]
    labels = spark.createDataFrame([("crm", "The CRM", ["CRM", "Email", "Wikis"]), ("mail", None, ["Email"]), ("js", "JS", ["Script"])], "tech string, name string, categories array<string>")
    got = {tuple(r) for r in updates.tech_events(spark.createDataFrame(rows, schema), "company_id", "captured_at", "full", labels, ["CRM", "Email"]).select("company_id", "event_type", "title", "event_key").collect()}
    assert got == {("a", "tech_first_seen", "Started using The CRM (CRM, Email)", "tech:crm:2025-02"), ("a", "tech_dropped", "Stopped using mail (Email)", "tech_drop:mail:2025-02")}


def test_snapshot_rows(spark):
    schema = "company_id string, captured_at timestamp, hiring_count int, hiring_roles array<string>, tech_stack array<string>, detected array<struct<slug:string,name:string,categories:array<string>>>, tech_source string, funding_stage string, total_raised string, headcount int"
    rows = [("a", T1, None, None, ["guess"], [("z", "Z", None), ("b", "B", ["CRM"])], "full", None, None, None), ("b", T1, 3, ["x"], ["guess"], [("z", "Z", None)], None, "A", "$1", 4), ("c", T1, None, None, None, None, "full", None, None, None)]
    got = {r.company_id: (r.hiring_count, r.tech_stack, r.source, r.tech_labels and sorted(r.tech_labels)) for r in updates.snapshot_rows(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": (0, ["b", "z"], "full", ["b", "z"]), "b": (3, ["guess"], None, None), "c": (0, [], None, None)}


def test_head_offices_are_filled_by_text(spark):
    c = spark.createDataFrame([("1", " X, Y ", None, "keep", None), ("2", "X, Y", "city", None, None), ("3", "other", None, None, None)], "id string, headquarters string, hq_city string, hq_region string, hq_country string")
    items = spark.createDataFrame([("X, Y", "x", " ", "us"), ("X, Y", None, None, None), (" ", "q", "q", "q"), (None, "q", "q", "q")], "raw string, hq_city string, hq_region string, hq_country string")
    got = {r.id: (r.hq_city, r.hq_region, r.hq_country) for r in updates.with_head_offices(c, updates.head_offices(items)).collect()}
    assert got == {"1": ("x", "keep", "us"), "2": ("city", None, None), "3": (None, None, None)}


def test_pages_tags_and_samples(spark):
    pages = spark.createDataFrame([(1, 1, "Acme "), (1, 2, "acme"), (1, 3, "Known"), (2, 1, "ACME"), (2, 2, None), (2, 3, " ")], "page int, n int, name string")
    known = updates.known_names(spark.createDataFrame([("KNOWN", None)], "name string, apollo_org_name string"), ["name", "apollo_org_name"])
    assert {(r.page, r.n) for r in updates.first_in_page(pages, "page", ["n"], "name", known).collect()} == {(1, 1), (2, 1)}
    c = spark.createDataFrame([("1", ["p"], T1), ("2", None, T1), ("3", ["q"], T1)], "id string, source_profiles array<string>, last_seen_at timestamp")
    got = {r.id: (r.source_profiles, r.last_seen_at) for r in updates.tagged(c, spark.createDataFrame([("1",), ("2",), ("2",)], "id string"), "p", at(T2)).collect()}
    assert got == {"1": (["p"], T2), "2": (["p"], T2), "3": (["q"], T1)}
    ids = spark.createDataFrame([(i,) for i in range(50)], "id int")
    first = [r.id for r in updates.sample_rows(ids, "id", "s", 5).collect()]
    assert first == [r.id for r in updates.sample_rows(ids.repartition(7), "id", "s", 5).collect()] and first != [r.id for r in updates.sample_rows(ids, "id", "t", 5).collect()]


def test_embedding_plan_is_resumable(spark):
    c = spark.createDataFrame([("a", "x", True), ("b", " ", True), ("c", None, False), ("d", "y", None)], "id string, t string, v boolean")
    plan = lambda after: [(r.id, r.action) for r in updates.embedding_plan(c, [F.col("t")], F.col("v"), after, 2).orderBy("id").collect()]
    assert plan("") == [("a", "embed"), ("b", "clear")] and plan("b") == [("c", "keep"), ("d", "embed")] and plan("d") == []


def test_null_keys_are_always_new_and_patches_are_one(spark):
    state = spark.createDataFrame([(1, "x"), (None, "y")], "k int, s string")
    new = merge.insert_ignore(state, spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (None, "e")], "k int, s string"), ["k"], [F.asc("s")])
    assert sorted((r.k or 0, r.s) for r in new.collect()) == [(0, "d"), (0, "e"), (2, "b")]
    records = spark.createDataFrame([(1, {"a": "0", "z": "1"}), (2, None)], "id int, m map<string,string>")
    patches = spark.createDataFrame([(1, {"a": "1", "b": "2"}, 1), (1, {"a": "3"}, 2), (1, {"c": None}, 3)], "id int, m map<string,string>, at int")
    assert {r.id: r.m for r in merge.merge_patch(records, patches, "id", "m", "at").collect()} == {1: {"z": "1", "a": "3", "b": "2", "c": None}, 2: {}}


def test_entities_sites_and_rounds(spark):
    one = lambda values, f: [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(f(F.col("v"))).collect()]
    assert one(["It&#8217;s caf&eacute; &mdash; <b>new</b>", "a &amp; b", None, "AT&T"], text.strip_html) == ["It’s café — new", "a & b", None, "AT&T"]
    site = lambda url, of: spark.range(1).select(urls.same_site(F.lit(url), F.lit(of))).first()[0]
    assert site("https://b.co.uk/x", "https://a.co.uk") is False and site("https://blog.a.co.uk/x", "https://www.a.co.uk/") is True
    titles = [("funding_round", None, "Acme raises money"), ("funding_round", None, "Acme closes Series B"), ("funding_round", "$5M", "Acme raises money"), ("layoffs", None, "x"), ("funding_round", None, None)]
    got = [r.event_type for r in feeds.demoted(spark.createDataFrame(titles, "event_type string, amount string, title string")).collect()]
    assert got == ["news_mention", "funding_round", "funding_round", "layoffs", "news_mention"]


@pytest.mark.parametrize("a, b", [("kitten", "sitting"), ("", "abc"), ("abcabba", "cbabac"), ("same words", "same words"), ("x" * 300, "yx" * 200)])
def test_similarity_is_by_the_longest_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, p in enumerate(a):
        for j, q in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if p == q else max(table[i][j + 1], table[i + 1][j])
    assert events._indel(a, b) == pytest.approx(200 * table[-1][-1] / (len(a) + len(b)))


def test_staged_tables_are_the_applications_and_can_be_released(spark):
    import os

    df = runtime.staged(spark.range(3), "probe")
    root = runtime.stage_dir(spark).removeprefix("file://")
    assert df.count() == 3 and any(x.startswith("probe-") for x in os.listdir(root))
    runtime.release(spark)
    assert not os.path.exists(root)
