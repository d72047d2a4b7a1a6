import datetime

import json
from datetime import datetime as dt

from pyspark.sql import functions as F

from lodestream.operators import snapshots
from lodestream.sources import boards, feeds, notices, tables
from lodestream.streaming import jobs


def test_board_payloads(spark):
    payloads = [
        ("c", "greenhouse", json.dumps({"jobs": [{"id": 7, "title": "Eng", "content": "&lt;p&gt;hi&lt;/p&gt;", "location": {"name": "NY"}, "absolute_url": "https://x.com/7"}]})),
        ("c", "lever", json.dumps([{"id": "l1", "text": "Sales", "description": "<b>d</b>", "categories": {"location": "LA", "team": "T"}}])),
        ("c", "ashby", json.dumps({"organization": {"name": "Org"}, "jobs": [{"id": "a1", "title": "Ops", "location": {"name": "SF"}}, {"id": "a2", "title": "Ops", "location": "LA"}]})),
        ("c", "workable", json.dumps({"name": "W", "jobs": [{"shortcode": "w1", "title": "QA", "location": {"city": "Rome"}}]})),
        ("c", "smartrecruiters", json.dumps({"content": [{"id": "s1", "name": "HR", "location": {"city": "Oslo"}}]})),
        ("c", "rippling", json.dumps([{"uuid": "r1", "name": "PM", "url": "u", "workLocation": {"label": "X"}}])),
        ("c", "lever", "not json"), ("c", "greenhouse", None),
    ]
    got = {(r["source"], r["external_id"], r["title"], r["location"], r["body_text"], r["organization_name"]) for r in boards.posts_from_json(spark.createDataFrame(payloads, "company_id string, board string, payload string")).collect()}
    assert got == {("greenhouse", "7", "Eng", "NY", "hi", ""), ("lever", "l1", "Sales", "LA", "d", "T"), ("ashby", "a1", "Ops", "SF", "", "Org"), ("ashby", "a2", "Ops", "LA", "", "Org"), ("workable", "w1", "QA", "Rome", "", "W"), ("smartrecruiters", "s1", "HR", "Oslo", "", ""), ("rippling", "r1", "PM", "X", "", "")}


def test_html_boards(spark):
    html = '<a href="/jobs/12/x">Plant &amp; Lead</a><a href="/jobs/12/x">again</a><script type="application/ld+json">{"@type":"JobPosting","title":"T","description":"<p>d</p>","jobLocation":{"address":{"addressLocality":"Y"}}}</script>'
    pages = spark.createDataFrame([("c", html)], "company_id string, html string")
    assert [tuple(r) for r in boards.posts_from_html(pages, r'<a href="(/jobs/(\d+)/[^"]*)">(.*?)</a>', "icims").collect()] == [("c", "icims", "12", "Plant & Lead", "/jobs/12/x")]
    assert [tuple(r) for r in boards.posting_ld(pages).collect()] == [("c", "T", "Y", "d")]


RSS = "<rss><channel><item><title>Acme raises</title><link>u1</link><pubDate>Mon, 06 May 2024 10:00:00 GMT</pubDate></item><item><title> </title></item><item><title>Old</title><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item><item><title>Undated</title></item></channel></rss>"


def test_feeds(spark):
    f = spark.createDataFrame([("c", RSS)], "company_id string, xml string")
    items = feeds.rss_items(f)
    now = F.lit("2024-05-10").cast("timestamp")
    assert [r["title"] for r in feeds.recent(items, now, 45, 10, True).collect()] == ["Acme raises", "Undated"]
    assert [r["title"] for r in feeds.recent(items, now, 45, 10, False).collect()] == ["Acme raises"]
    answers = spark.createDataFrame([("c", '```json\n{"items":[{"i":0,"category":"funding"},{"i":9,"category":"funding"},{"i":3,"category":"gossip"}]}\n```'), ("d", "sorry")], "company_id string, answer string")
    events = feeds.judged(items, feeds.verdicts_from_model(answers), feeds.NEWS_EVENTS)
    assert [(r["title"], r["event_type"]) for r in events.collect()] == [("Acme raises", "funding_round")]
    page = '<link rel="alternate" type="application/rss+xml" href="/a.xml"><link type="application/atom+xml" title="Blog" href="https://acme.com/blog.xml"><link type="application/rss+xml" href="https://other.com/x">'
    links = feeds.feed_links(spark.createDataFrame([("c", "https://www.acme.com/x", page)], "company_id string, url string, html string"))
    assert [r["feed_url"] for r in links.orderBy("place").collect()] == ["https://acme.com/blog.xml", "https://www.acme.com/a.xml"]


def test_notices_with_any_headers(spark):
    a = spark.createDataFrame([("Acme", "05/06/2024", "1,200", "Reno"), ("", "05/06/2024", "1", "x"), ("B", "soon", "1", "x")], ["Company ", "Date of WARN Notice", "# of Workers", "City"])
    assert [tuple(r) for r in notices.layoff_notices(a, "nv").collect()] == [("Acme", dt(2024, 5, 6), 1200, "Reno", "nv")]
    b = spark.createDataFrame([("Beta", "2024-05-06 00:00:00", "7")], ["The Employer Name", "Notice Date (sent)", "Workers affected total"])
    assert [tuple(r)[:3] for r in notices.layoff_notices(b, "ca").collect()] == [("Beta", dt(2024, 5, 6), 7)]


def test_filings_and_events(spark):
    doc = json.dumps({"accession_no": "1", "entity_name": "Acme Inc", "industry_group": "Other Technology ", "total_offering_amount": "5,000,000", "total_amount_sold": "Indefinite", "related_persons": [{"first_name": "A", "last_name": "B", "relationships": ["Director"]}, {"first_name": " "}]})
    r = notices.parsed_filings(spark.createDataFrame([(doc,), ("{}",)], "doc string"), ("other technology",)).collect()
    assert len(r) == 1 and (r[0]["normalized_name"], r[0]["is_tech"], r[0]["offering_amount"], r[0]["amount_sold"], [tuple(p) for p in r[0]["persons"]]) == ("acme", True, 5e6, None, [("A B", "Director")])
    aw = spark.createDataFrame([("c", "A1", None, 2e6, "", "2024-05-06"), ("c", "A2", None, 0.0, "X", None)], "company_id string, award_id string, internal_id string, amount double, agency string, date string")
    assert [(x["title"], x["dedupe_key"]) for x in notices.award_events(aw).collect()] == [("Federal contract: $2M from federal agency", "c:gov_contract:usaspending:A1")]
    hn = spark.createDataFrame([("c", "acme.com", "Show HN: X", "https://acme.com/x", 1, 0, "1", None), ("c", "acme.com", "Talk", "", 50, 0, "2", None), ("c", "acme.com", "Quiet", "u", 1, 1, "3", None)], "company_id string, domain string, title string, url string, points int, comments int, object_id string, created_at string")
    assert sorted(x["event_type"] for x in notices.discussion_events(hn).collect()) == ["news_mention", "product_launch"]


def test_files(spark, tmp_path):
    (tmp_path / "lever.csv").write_text("name,slug,url\nA,a,u\nA2,A,v\n")
    (tmp_path / "ashby.csv").write_text("name,slug,url\nB,b,u\n")
    assert {(r["board"], r["slug"]) for r in tables.board_directory(spark, str(tmp_path)).collect()} == {("lever", "a"), ("ashby", "b")}
    progress = spark.createDataFrame([("r", "running", "5", 5, dt(2024, 1, 1)), ("r", "running", "9", 9, dt(2024, 1, 2)), ("q", "done", "3", 3, dt(2024, 1, 1))], tables.PROGRESS)
    assert (tables.resume_position(progress, "r"), tables.resume_position(progress, "q"), tables.resume_position(progress, "x")) == ("9", None, None)
    path = tables.swap(spark.range(3), str(tmp_path / "t"))
    assert spark.read.parquet(path).count() == 3


def test_stream_equals_batch(spark):
    sf = "/root/testdata/sf0.001"
    cols = ["company_id", "captured_at", F.col("hiring_count").cast("long").alias("hiring_count")]
    stream = jobs.run_available(jobs.snapshot_changes(jobs.read_stream(spark, sf, "company_signal_result").select(*cols), "company_id", "captured_at", "hiring_count"), "t")
    batch = spark.read.parquet(f"{sf}/company_signal_result.parquet").select(*cols).distinct()
    paired = snapshots.with_previous(batch, "company_id", "captured_at", ["hiring_count"], [])
    want = {tuple(r) for r in snapshots.surges(paired, "company_id", "captured_at", "hiring_count").select("company_id", "captured_at", "prev_count", "curr_count").collect()}
    assert {tuple(r) for r in stream.collect()} == want


def test_stream_fold_equals_batch(spark, tmp_path):
    from lodestream.operators import events as ev

    schema = "company_id string, event_type string, dedupe_key string, title string, observed_at timestamp, url string, confidence double, story string, person string, amount string"
    rows = [("c", "layoffs", f"k{i}", "Acme cuts jobs" if i % 2 else "Beta opens an office abroad", dt(2025, 1, 1 + i), f"u{i}", 0.5, None, None, None) for i in range(8)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = {tuple(r)[:4] + (r["n_reports"],) for r in jobs.run_available(jobs.clustered_events(s), "fold", "update").select("company_id", "event_type", "dedupe_key", "title", "n_reports").collect()}
    want = {tuple(r)[:4] + (r["n_reports"],) for r in ev.cluster_reports(spark.createDataFrame(rows, schema)).select("company_id", "event_type", "dedupe_key", "title", "n_reports").collect()}
    assert got == want and len(got) == 2


def test_late_snapshots_change_nothing(spark, tmp_path):
    """The second trigger brings a snapshot from between two that were compared already, and a newer one."""
    schema = "company_id string, captured_at timestamp, hiring_count long"
    day = lambda d: datetime.datetime(2025, 1, d)
    for i, rows in enumerate([[("c", day(1), 10), ("c", day(9), 20)], [("c", day(5), 1), ("c", day(12), 25), ("c", None, 99)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"t{i}.parquet"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t*.parquet"))
    out = jobs.run_available(jobs.snapshot_changes(stream, "company_id", "captured_at", "hiring_count"), "late")
    assert [(r.captured_at, r.prev_count, r.curr_count) for r in out.collect()] == [(day(9), 10, 20)]
