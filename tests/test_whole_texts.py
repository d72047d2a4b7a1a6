"""Queries over documents take the whole text, whatever its script: against brute force."""

import hashlib
import re
import unicodedata
from collections import Counter

import pytest

from lodestream.operators import tech
from lodestream.plans import registry

TEXTS = [
    "Страница о компании. " * 8, "会社概要" * 30, "Café crème à la carte " * 6, "Cafe creme a la carte " * 6, "ΟΔΟΣ ΣΟΦΙΑΣ \n" * 10, "　" * 60 + "ж" * 60,
    "x" * 99 + " ", "é" * 100, "a\u0085b\x1fc " * 40, "หน้าแรก ของ บริษัท", "日本 l’été été naïve 42 ٣٤ — Ёж", "Plain text, plain text.", "", None,
]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d


def fingerprint(text):
    """As the reference's signals/pipeline.py has it."""
    if not text or len(text.strip()) < 100:
        return ""
    return hashlib.sha1(re.sub(r"\s+", " ", text).strip().lower().encode()).hexdigest()[:16]


def test_page_fingerprints(spark, sf):
    got = {r["doc_id"]: r["fingerprint"] for r in registry.QUERIES["page_fingerprints"](spark, sf).collect()}
    assert got == {i: fingerprint(t) for i, t in enumerate(TEXTS)}
    assert got[0] and got[1] and got[2] != got[3]


def words(text):
    return "".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in (text or "").lower()).split()


def test_inverted_index(spark, sf):
    got = {r["term"]: (r["df"], r["tf"]) for r in registry.QUERIES["inverted_index"](spark, sf).collect()}
    tf, df = Counter(), Counter()
    for t in TEXTS:
        tf.update(words(t))
        df.update(set(words(t)))
    assert got == {w: (df[w], n) for w, n in tf.items()}
    assert got["страница"] == (1, 8) and got["crème"] == (1, 6) and got["หน้าแรก"] == (1, 1) and "cr" not in got


def test_page_tech_of_long_pages(spark, tmp_path):
    long = "x " * 350_000
    docs = [(1, long + "<h2>SELECT</h2>", "a"), (2, "<h2>" + long, "a"), (3, long, "news")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["tech"]) for r in registry.QUERIES["page_tech"](spark, str(tmp_path)).collect()}
    assert got == {(1, "sql"), (1, "heading"), (1, "markup"), (1, "pages"), (2, "heading"), (2, "markup"), (2, "pages"), (3, "news")}


def test_long_inline_scripts(spark):
    page = spark.createDataFrame([("p", "<script>" + "a;" * 40_000 + "trk()</script>", None)], "id string, html string, url string")
    rules = spark.createDataFrame([("Tracker", "inline", "", r"trk\(")], "tech string, source string, key string, regex string")
    found = lambda **most: tech.detect(tech.page_features(page, "id", "html", "url", **most), rules).count()
    assert found() == 1 and found(most_inline=50_000) == 0 and found(most_html=600_000) == 1 and found(most_html=60_000) == 0
