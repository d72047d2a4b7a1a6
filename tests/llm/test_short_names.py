"""Near names of a few letters are candidates, since the exact check accepts them."""

import itertools

import pytest

from lodestream.llm import entity_match

PLACES = [(1, "Saint Caldale", "NC", "US", None), (2, "Fultecrest", "OH", "US", None)]
DOC = "id string, name string, apollo_org_name string, domain string, headquarters string, hq_city string, hq_region string, hq_country string"


def test_one_edit_has_a_common_variant(spark):
    forms = ["".join(x) for n in range(1, 5) for x in itertools.product("abc", repeat=n)]
    rows = spark.createDataFrame([(f, [f], [], "", "", "", [], True, i) for i, f in enumerate(forms)], entity_match.RECORD + ", n long")
    tokens = entity_match.with_tokens(rows, spark.createDataFrame([], "host string, is_shared boolean"))
    variants = {r["id"]: {t["h"] for t in r["tokens"] if t["boost"] == entity_match.BOOST["variant"]} for r in tokens.collect()}
    for a, b in itertools.combinations(forms, 2):
        assert not entity_match.one_edit(a, b) or variants[a] & variants[b], (a, b)


@pytest.mark.parametrize("name, typo", [("Zoqi", "Zoki"), ("Vexo", "Vex"), ("Kup", "Kpu"), ("Wy", "We")])
def test_short_name_with_a_typo(spark, name, typo):
    places = spark.createDataFrame(PLACES, "place_id long, city string, region string, country string, aliases array<string>")
    docs = spark.createDataFrame([("d", f"{name} Data", None, None, "Fultecrest, OH", None, None, None), ("e", "Hodavuni Data", None, None, "Saint Caldale, NC", None, None, None)], DOC)
    asks = spark.createDataFrame([("t", f"{typo} Data", None, "OH"), ("u", f"{typo} Data", None, "NC")], "id string, name string, domain string, state string")
    got = {(r["discovery_company_id"], r["tracked_company_id"]) for r in entity_match.match_entities(docs, asks, places).collect()}
    assert got == {("d", "t")}
