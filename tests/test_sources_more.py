"""Rules of technologies, boards to try, filings, page texts, tolerant JSON, resumable searches."""

import json
import os
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import functions as F

from lodestream.functions import text
from lodestream.operators import resolve, tech
from lodestream.plans import jobs
from lodestream.sources import boards, filings

RULES = {
    "Shop": {"cats": [1, 99], "scriptSrc": r"cdn\.shop\.io\;version:\1", "implies": [r"Base\;confidence:50"], "excludes": "Rival"},
    "Base": {"cats": [2]}, "Rival": {"html": ["<rival", "(broken"]}, "Edge": {"headers": {"X-Edge": ""}}, "Jar": {"cookies": {"JAR": "^v"}, "requires": "Shop"},
    "Mailer": {"dns": {"txt": r"mailer="}}, "Gen": {"meta": {"Generator": "gen"}}, "Trk": {"scripts": r"trk\("}, "Odd": {"headers": "not a map"},
}


def test_rules_are_loaded_and_every_kind_of_evidence_is_used(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(RULES))
    (tmp_path / "categories.json").write_text(json.dumps({"1": {"name": "Ecommerce"}, "2": {"name": "CMS"}}))
    rules = tech.load_rules(str(tmp_path), most_age_days=1)
    assert rules.categories["Shop"] == ["Ecommerce"] and rules.implies == [("Shop", "Base")] and ("Rival", "html", "", "(?i)(broken") not in rules.rules
    assert tech.load_rules(str(tmp_path), most_age_days=1, now=os.path.getmtime(tmp_path / "a.json") + 90_000) is None and tech.load_rules(str(tmp_path / "none")) is None
    schema = "id string, html string, url string, h map<string,string>, c map<string,string>, d map<string,array<string>>"
    rows = [("1", "<script src='https://cdn.shop.io/x.js'></script><rival><meta name=generator content='Gen 2'><script>trk(1)</script>", "https://a", {"x-EDGE": "anything"}, {"jar": "v1"}, {"TXT": ["a", "mailer=1"]}), ("2", None, None, None, {"jar": "v1"}, None)]
    features = tech.page_features(spark.createDataFrame(rows, schema), "id", "html", "url", headers="h", cookies="c", dns="d")
    found = tech.detect(features, rules.table(spark))
    assert {(r.page_id, r.tech, r.evidence) for r in found.collect()} == {("1", "Shop", "script"), ("1", "Rival", "html"), ("1", "Edge", "header"), ("1", "Jar", "cookie"), ("1", "Mailer", "dns"), ("1", "Gen", "meta"), ("1", "Trk", "inline"), ("2", "Jar", "cookie")}
    out = tech.with_implications(found, rules.implies, rules.requires, rules.excludes)
    assert {(r.page_id, r.tech) for r in out.collect()} == {("1", t) for t in ("Shop", "Base", "Edge", "Jar", "Mailer", "Gen", "Trk")}


def test_boards_are_tried_in_order_and_once(spark):
    schema = "id string, name string, domain string, cached struct<board:string,slug:string>, html string, searched array<string>"
    rows = [("a", "Acme Widgets Inc", "acme.io", ("lever", "acme"), '<a href="https://boards.greenhouse.io/acmew">', ["lever:acme", "ashby:aw"]), ("b", None, None, None, None, None)]
    out = boards.candidate_boards(spark.createDataFrame(rows, schema), "id", "name", "domain", "cached", "html", "searched").orderBy("company_id", "place").collect()
    got = [(r.board, r.slug, r.verified_by_page) for r in out if r.company_id == "a"]
    assert got[:3] == [("lever", "acme", True), ("greenhouse", "acmew", True), ("ashby", "aw", True)] and got[3] == ("greenhouse", "acme", False)
    assert got[-3:] == [("rippling", "acme", False), ("jazzhr", "acme", False), ("icims", "acme", False)] and len(set(got)) == len(got) and not [r for r in out if r.company_id == "b"]


def test_addresses_of_boards(spark):
    slugs = ["acme", "careers-acme/", "uscareers-acme", "https://jobs.acme.com/"]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in slugs], "s string").select(boards.careers_address(F.col("s"))).collect()]
    assert got == ["https://careers-acme.icims.com", "https://careers-acme.icims.com", "https://uscareers-acme.icims.com", "https://jobs.acme.com"]
    assert spark.range(1).select(boards.detail_address(F.lit("acme"), F.lit("J1"))).first()[0] == "https://acme.applytojob.com/apply/jobs/details/J1"


def test_filings_are_matched_before_they_are_read(spark):
    lines = ["Description: index", "CIK|Company Name|Form Type|Date Filed|Filename", "77|Zoravexo Holdings Inc|8-K|2025-01-02|edgar/data/77/0000000077-25-000001.txt", "78|Other Co|8-K|2025-01-02|edgar/data/78/0000000078-25-000001.txt", "77|Zoravexo Holdings Inc|D|bad|edgar/data/77/0000000077-25-000002.txt", "77|short"]
    index = filings.index_rows(spark.createDataFrame([(x,) for x in lines + lines[2:3]], "value string"))
    assert {(r.cik, r.accession_no, r.form_type, r.filed_on) for r in index.collect()} == {("0000000077", "0000000077-25-000001", "8-K", date(2025, 1, 2)), ("0000000078", "0000000078-25-000001", "8-K", date(2025, 1, 2)), ("0000000077", "0000000077-25-000002", "D", None)}
    keys = resolve.company_keys(spark.createDataFrame([("c1", "Zoravexo", "OH")], "id string, name string, state string"), "id", ["name"], "state")
    hit = filings.filings_of_companies(index, keys, "8-K").collect()
    assert [(r.accession_no, r.company_id) for r in hit] == [("0000000077-25-000001", "c1")]
    reports = spark.createDataFrame([("n", "c1", {"5.02": "x" * 80, "8.01": "short", "9.01": "y" * 100})], "accession_no string, company_id string, items map<string,string>")
    assert [(r.item, len(r.body)) for r in filings.report_items(reports, ["5.02", "8.01"]).collect()] == [("5.02", 80)]
    state = spark.createDataFrame([("n1", "a", True, None)], "accession_no string, entity_name string, is_tech boolean, matched_company_id string")
    parsed = spark.createDataFrame([("n1", "b", True, None), ("n2", "c", True, None), ("n2", "d", True, None), ("n3", "e", False, None)], state.schema)
    new = filings.new_filings(state, parsed)
    assert [(r.accession_no, r.entity_name) for r in new.collect()] == [("n2", "c")]
    linked = filings.linked_filings(state.unionByName(new), spark.createDataFrame([("n2", "c9"), ("n2", "c8")], "accession_no string, company_id string"))
    assert {(r.accession_no, r.matched_company_id) for r in linked.collect()} == {("n1", None), ("n2", "c8")}


def test_texts(spark):
    one = lambda values, f: [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(f(F.col("v"))).collect()]
    page = "<html><head><style>p{}</style><script>var a='<p>no</p>';</script></head><nav>Menu</nav><p>First &amp; <b>best</b>.</p><div>Second<br>third</div><!-- gone --><footer>Foot</footer></html>"
    assert one([page, None, "plain"], text.main_text) == ["First & best .\nSecond\nthird", "", "plain"]
    assert one(['{"a": 1, "b": "x"}', "[1]", "nonsense", "{broken", None, '"text"'], text.object_of) == [{"a": "1", "b": "x"}, {}, {}, {}, {}, {}]
    assert one(["  Ada  Lovelace ", "", None], text.first_word) == ["Ada", "", ""]
    facts = one(['```json\n{"funding_stage": " ", "total_raised": "$5M", "investors": ["A", " "]}\n```', "no"], text.profile_facts)
    assert [(f.funding_stage, f.total_raised, f.investors) for f in facts] == [(None, "$5M", ["A"]), (None, None, [])]


def test_searches_go_on_where_they_were():
    now = datetime(2025, 6, 1, tzinfo=timezone.utc)
    filters = {"b": [1], "a": "x"}
    assert jobs.filters_hash(filters) == jobs.filters_hash({"a": "x", "b": [1]}) and len(jobs.filters_hash({})) == 12
    first = jobs.resumed(None, filters, now, 7)
    assert first["current_page"] == 0
    assert jobs.resumed(first | {"current_page": 4}, filters, now, 7)["current_page"] == 4
    assert jobs.resumed(first | {"current_page": 4}, {"a": "y"}, now, 7)["current_page"] == 0
    done = first | {"status": "exhausted", "current_page": 9, "completed_at": now - timedelta(days=3)}
    assert jobs.resumed(done, filters, now, 7) == done and jobs.resumed(done, filters, now + timedelta(days=5), 7)["current_page"] == 0
