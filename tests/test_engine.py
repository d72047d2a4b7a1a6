from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestream import config
from lodestream.functions import dates, names, numbers, text, urls, vectors
from lodestream.operators import events as ev
from lodestream.operators import graph, merge, resolve, schedule, search, snapshots, tech


def col(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_names(spark):
    assert col(spark, ["Acme Robotics, Inc.", "A & B LLC", "Acme Holdings LLC", None, "  "], names.clean_name) == ["acme robotics", "a and b", "acme", "", ""]
    assert col(spark, ["California", "CA", "San Francisco, CA", "Austin, TX 78701", "in west virginia now", "", None, "Bavaria"], names.state_code) == ["ca", "ca", "ca", "tx", "va", None, None, None]
    assert col(spark, ["acme robotics systems", "alloy", "north star data labs"], names.name_keys) == [
        ["acme robotics systems", "c:acmeroboticssystems", "t:acme robotics"], ["alloy", "c:alloy", "t:alloy"], ["north star data labs", "c:northstardatalabs", "t:north star", "k:north star"],
    ]
    assert col(spark, ["", "ab", "notion", "datahub", "hyliion", "data labs", "acme robotics"], names.is_weak_name) == [True, True, True, True, False, True, False]
    assert col(spark, ["Acme Labs Inc", "foo.ai"], names.directory_key) == ["acme", "foo"]
    assert col(spark, ["www.acme.com", "a.io", None], names.domain_stem) == ["acme", None, None]
    assert col(spark, ["Acme, Inc. Holdings"], names.filing_name) == ["acme"]
    assert col(spark, ["Northwind Traders Inc"], lambda c: names.slug_variants(c, F.lit("nwind.com"))) == [["nwind", "northwind-traders", "northwindtraders", "northwind"]]
    assert col(spark, ["Big Co", "Ramp Tools", "Ion", ""], names.relevance_multiplier) == [1.0, 0.6, 0.5, 0.5]
    assert col(spark, ["Acme raises", "acmeish raises", None], lambda c: names.title_mentions(c, F.lit("Acme Robotics"))) == [True, False, False]


def test_text_and_numbers(spark):
    assert col(spark, ["<p>a &amp; <b>b</b></p>"], text.strip_html) == ["a & b"]
    assert col(spark, ["short", None], text.page_fingerprint) == ["", ""]
    assert col(spark, ["Account Executive", "SRE lead", "Chef", None], text.role_family) == ["sales_ae", "infra", "other", "other"]
    assert col(spark, ["```json\n[1]\n```"], text.unfenced_json) == ["[1]"]
    assert col(spark, ["a=1; Expires=Mon, 01 Jan 2024 00:00:00 GMT, b=2"], text.cookie_names) == [["a", "b"]]
    assert col(spark, [5_000_000.0, 1_500_000.0, 2500.0, 7.0, 0.0, None], numbers.format_amount, "double") == ["$5M", "$1.5M", "$3K", "$7", "", ""]
    assert col(spark, ["$1,200", "Indefinite", "0", "x"], numbers.parse_amount) == [1200.0, None, None, None]
    assert col(spark, [3, 25, 44, 125, 975, 1049, 1050, 0], numbers.round_head_count, "int") == [10, 20, 40, 100, 1000, 1000, 1000, 0]
    assert col(spark, [2019, 2025, 50, -1, None], lambda c: numbers.sanitize_head_count(c, 2025, floor=1900), "int") == [None, None, 50, None, None]
    assert col(spark, ["1,204 staff", "none"], numbers.first_integer) == [1204, None]


def test_dates_and_urls(spark):
    got = col(spark, ["2024-05-01T10:00:00Z", "Mon, 06 May 2024 10:00:00 GMT", "2024/05/07", "05/08/2024", "5/9/24", "soon", None], dates.parse_notice_date)
    assert got == [dt(2024, 5, 1, 10), dt(2024, 5, 6, 10), dt(2024, 5, 7), dt(2024, 5, 8), dt(2024, 5, 9), None, None]
    assert col(spark, ["https://www.a.b.co/x/y-z?q=1", "nope"], urls.host) == ["a.b.co", None]
    assert col(spark, ["www.jobs.acme.com", "acme"], urls.root_domain) == ["acme.com", "acme"]
    html = 'x https://boards.greenhouse.io/acme y https://jobs.ashbyhq.com/Acme z https://c.acme.com/roles?gh_jid=12'
    assert col(spark, [html], urls.board_candidates) == [["greenhouse:acme", "ashby:acme", "greenhouse:roles"]]
    assert col(spark, ["see https://linkedin.com/company/Acme/about"], urls.profile_url) == ["https://www.linkedin.com/company/acme"]
    assert col(spark, [[1.0, 0.0], [0.0, 0.0]], lambda c: vectors.cosine(c, F.array(F.lit(1.0), F.lit(0.0))), "array<double>") == [1.0, 0.0]


def test_merges(spark):
    state = spark.createDataFrame([(1, "a", 0), (2, "b", 5), (None, "n", 1)], "k int, s string, n int")
    batch = spark.createDataFrame([(1, " ", 7), (3, "c", None), (None, "m", 2)], "k int, s string, n int")
    got = {tuple(r) for r in merge.keyed_merge(state, batch, ["k"], {"s": "fill_empty", "n": "fill_zero"}).collect()}
    assert got == {(1, "a", 7), (2, "b", 5), (3, "c", None), (None, "n", 1)}
    twice = merge.keyed_merge(merge.keyed_merge(state, batch, ["k"], {"s": "overwrite", "n": "overwrite"}), batch, ["k"], {"s": "overwrite", "n": "overwrite"})
    assert {tuple(r) for r in twice.collect()} == {tuple(r) for r in merge.keyed_merge(state, batch, ["k"], {"s": "overwrite", "n": "overwrite"}).collect()}
    with pytest.raises(ValueError):
        merge.keyed_merge(state, batch, ["k"], {"s": "guess"})
    posts = spark.createDataFrame([("c", "1", None), ("c", "2", None), ("c", "3", dt(2024, 1, 1)), ("d", "9", None)], "company string, id string, closed timestamp")
    poll = spark.createDataFrame([("c", "1"), ("c", "3"), ("c", " ")], "company string, id string")
    out = {(r["company"], r["id"]): r["closed"] for r in merge.close_missing(posts, poll, "company", "id", "closed", F.lit("2025-01-01").cast("timestamp")).collect()}
    assert out == {("c", "1"): None, ("c", "2"): dt(2025, 1, 1), ("c", "3"): None, ("d", "9"): None}
    new = merge.insert_ignore(state, spark.createDataFrame([(1, "x"), (4, "y"), (4, "z")], "k int, s string"), ["k"], [F.asc("s")])
    assert [tuple(r) for r in new.collect()] == [(4, "y")]


def test_names_resolve(spark):
    companies = spark.createDataFrame([("1", "Acme Robotics Inc", "Acme Robotics", "TX"), ("2", "Orion Foods", "Orion Foods", "CA"), ("3", "Orion Foods LLC", None, "NY"), ("4", "Notion", None, "CA")], "id string, name string, other string, state string")
    keys = resolve.company_keys(companies, "id", ["name", "other"], "state")
    probes = spark.createDataFrame([("a", "ACME ROBOTICS LLC", None), ("b", "Orion Foods", "New York"), ("c", "Orion Foods", None), ("d", "Notion", None), ("e", "Notion", "CA"), ("f", "Acme Robotics Systems", "CA"), ("g", "", "CA")], "id string, name string, state string")
    got = {r["probe_id"]: (r["company_id"], r["score"], r["reason"]) for r in resolve.match_names(probes, keys, "id", "name", "state").collect()}
    assert got == {"a": ("1", 100, "exact"), "b": ("3", 100, "exact"), "e": ("4", 100, "exact")}
    directory = spark.createDataFrame([("lever", "Acme", "acme"), ("greenhouse", "Acme Robotics", "acmebots"), ("ashby", "Acme Robotics", "acmerobo")], "board string, name string, slug string")
    asked = spark.createDataFrame([("1", "Acme Robotics Inc", "acme.com"), ("2", "Acme Robotics", None), ("3", "Zzz", None)], "id string, name string, domain string")
    assert {tuple(r) for r in resolve.directory_match(asked, directory, "id", "name", "domain").collect()} == {("1", "lever", "acme"), ("2", "greenhouse", "acmebots")}


def test_unknown_comparison_with_null_concept(spark):
    posts = spark.createDataFrame(
        [("a", dt(2025, 3, 30), None, ["New", "old"]), ("a", dt(2025, 1, 1), None, ["OLD"]), ("b", dt(2025, 3, 30), None, ["x"]), ("b", dt(2025, 1, 1), None, [None])],
        "company string, first_seen_at timestamp, closed_at timestamp, concepts array<string>",
    )
    got = snapshots.concepts_first_seen(posts, "company", F.lit("2025-04-01").cast("timestamp"))
    assert [tuple(r) for r in got.collect()] == [("a", "new")]


def test_similarity_and_fold(spark):
    assert ev.token_set_ratio("acme raises $5m", "acme raises $5m series a") == 100.0
    assert ev.token_set_ratio("a b", "c d") < 60 and ev.token_set_ratio("", "x") == 0.0
    rows = [
        ("c", "funding_round", "k1", "Acme raises 5 million - Wire", dt(2025, 1, 1), "u1", 0.9, None, None, None), ("c", "funding_round", "k2", "Acme raises 5 million", dt(2025, 1, 10), "u2", 0.9, None, None, None),
        ("c", "funding_round", "k3", "Acme raises 5 million", dt(2025, 6, 10), "u3", 0.9, None, None, None), ("c", "funding_round", "k1", "again", dt(2025, 1, 2), "u9", 0.9, None, None, None),
    ]
    df = spark.createDataFrame(rows, "company_id string, event_type string, dedupe_key string, title string, observed_at timestamp, url string, confidence double, story string, person string, amount string")
    got = {(r["dedupe_key"], r["n_reports"], r["confidence"]) for r in ev.cluster_reports(df).collect()}
    assert got == {("k1", 2, 0.95), ("k3", 1, 0.9)}


def test_relevance_and_grounding(spark):
    e = spark.createDataFrame([("Acme wins", "news", 0.8, "Acme Robotics"), ("Other", "news", 0.8, "Acme Robotics"), ("Other", "github", 0.8, "Acme Robotics"), ("Ramp Tools grows", "news", 0.8, "Ramp Tools")], "title string, source string, confidence double, name string")
    assert sorted((r["title"], r["source"], r["confidence"]) for r in ev.relevant(e, "name").collect()) == [("Acme wins", "news", 0.8), ("Other", "github", 0.8), ("Ramp Tools grows", "news", 0.48)]
    g = spark.createDataFrame([(1, ["raised $5m", "hiring"], 60, "Series F", "5m", "acme series a"), (2, ["raised $5m"], 60, "Series A", "5m", "acme series a"), (3, ["raised $5m"], 60, None, None, "")], "i int, sig array<string>, score int, stage string, raised string, ev string")
    got = {r["i"]: (r["sig"], r["score"], r["stage"]) for r in ev.grounded_funding(g, "sig", "score", "stage", "raised", "ev").collect()}
    assert got == {1: (["hiring"], 35, None), 2: (["raised $5m"], 60, "Series A"), 3: ([], 25, None)}


def test_technologies(spark):
    html = '<script src="https://cdn.shop.io/a.js"></script><script>window.trk()</script><meta name="Generator" content="Press 5">'
    pages = spark.createDataFrame([("p", html, "https://a.com"), ("q", None, None)], "id string, html string, url string")
    rules = spark.createDataFrame([("Shop", "script", "", tech.compile_pattern(r".*shop\.io\;version:1")), ("Tracker", "inline", "", r"trk\("), ("Press", "meta", "generator", "(?i)press"), ("Shop", "html", "", "shop")], "tech string, source string, key string, regex string")
    found = tech.detect(tech.page_features(pages, "id", "html", "url"), rules)
    assert {tuple(r) for r in found.collect()} == {("p", "Shop", "script"), ("p", "Tracker", "inline"), ("p", "Press", "meta")}
    out = tech.with_implications(found, [("Press", "PHP"), ("PHP", "Unix")], [("Tracker", "Missing")], [("Shop", "Unix")])
    assert {r["tech"] for r in out.collect()} == {"Shop", "Press", "PHP"}
    dns = spark.createDataFrame([("a", "TXT", "MS=ms1 v"), ("a", "MX", "aspmx.google.com"), ("a", "MX", "x.outlook.com"), ("b", "TXT", "none")], "domain string, rtype string, value string")
    assert [tuple(r) for r in tech.dns_vendors(dns).collect()] == [("a", ["google_workspace", "microsoft365"])]


def test_graph_and_schedule(spark):
    d = spark.createDataFrame([("c", ["React JS", "react-js", "", None, "Go"])], "id string, tech array<string>")
    assert {r["dst_id"] for r in graph.edges_from_list(d, "id", "tech", "uses_vendor", "vendor", 40).collect()} == {"react-js", "go"}
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    assert {(r["start"], r["end"], r["n_hops"]) for r in graph.hops(e, 3).filter("start = 'a'").collect()} == {("a", "b", 1), ("a", "c", 2), ("a", "a", 3), ("a", "d", 3)}
    c = spark.createDataFrame([("x", "o1", 1), ("x", "o2", 1), ("y", "o2", 2), ("z", "o1", 2)], "id string, org string, rank int")
    assert [r["id"] for r in schedule.fair_share(c, "id", "org", "rank", 2).collect()] == ["x", "z"]
    edges = spark.createDataFrame([("1", "acme", "acme.com"), ("2", "beta", None), ("3", "self", "self.com")], "src_id string, dst_id string, domain string")
    got = graph.resolve_customers(edges, spark.createDataFrame([("ACME.com", "9"), ("self.com", "3")], "domain string, company_id string"), spark.createDataFrame([("beta", "8")], "dst_id string, company_id string"))
    assert {tuple(r) for r in got.collect()} == {("1", "acme", "9", "domain"), ("2", "beta", "8", "name")}


def test_search_in_blocks(spark):
    v = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(50)], "id int, v array<double>")
    q = v.filter("id < 6").select(F.col("id").alias("query_id"), F.col("v").alias("query_vector"))
    one, many = (sorted(tuple(r) for r in search.top_k(v, q, "id", "v", 3, 0.5, block=b).collect()) for b in (100, 2))
    assert one == many and len(one) == 18


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    sf = "/root/testdata/sf0.001"
    from lodestream.plans import catalogue as c

    assert "TakeOrderedAndProject" in plan(c.pending_scan(spark, sf))
    assert "WindowGroupLimit" in plan(c.watched_stale_ranked(spark, sf))
    assert "LeftAnti" in plan(c.cold_index(spark, sf))
    p = plan(c.pricing_summary(spark, sf))
    assert "PushedFilters: [IsNotNull(l_shipdate)" in p and "l_partkey" not in p
    assert len(config.EVENT_WEIGHTS) == 21
