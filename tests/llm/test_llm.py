import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestream.llm import byte_bpe, entity_match, packing, place_map, reading_level

# --- entities ---------------------------------------------------------------------------------------------------

PLACES = [(1, "Saint Caldale", "NC", "US", ["Mount Stiss"]), (2, "Fultecrest", "OH", "US", None), (3, "Fultecrest", "Wales", "GB", None), (4, "Nussoköping", "Skåne", "SE", None)]
PLACE_SCHEMA = "place_id long, city string, region string, country string, aliases array<string>"
DOC = "id string, name string, apollo_org_name string, domain string, headquarters string, hq_city string, hq_region string, hq_country string, extra int"
ASK = "id string, name string, domain string, state string, cleaned string"


def matches(spark, docs, asks):
    p = spark.createDataFrame(PLACES, PLACE_SCHEMA)
    d = spark.createDataFrame([(*r, 1) for r in docs], DOC)
    a = spark.createDataFrame([(*r, None) for r in asks], ASK)
    return {(r["discovery_company_id"], r["tracked_company_id"]): r["confidence"] for r in entity_match.match_entities(d, a, p).collect()}


def filler():
    """Other firms, so that names and hosts are rare."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("bdfgkmnpstvz") + rnd.choice("aeiou") for _ in range(4))
    return [(f"f{i}", f"{word().title()} Data", None, f"{word()}.example", None, None, None, None) for i in range(300)]


def test_same_and_different_firms(spark):
    docs = filler() + [
        ("d1", "Zoravexo Systems", "Zoravexo Sys., Inc", "zoravexo.ai.example", "Saint Caldale, NC", None, None, None), ("d1b", "ZORAVEXO SYSTEMS", None, None, "St. Caldale, North Carolina, US", None, None, None),
        ("d2", "Kimulato Foods", None, "old-host.example", "Fultecrest, Ohio", None, None, None), ("d3", "Perulami Cloud", None, "perulami.example", None, None, None, None),
        ("d4", "Hodavuni", None, None, "Fultecrest, OH", None, None, None), ("d5", None, None, None, None, None, None, None), ("d1", "Zoravexo Systems", "Zoravexo Sys., Inc", "zoravexo.ai.example", "Saint Caldale, NC", None, None, None),
    ]
    asks = [
        ("t1", "Zorvexo Systems LLC", "https://www.zoravexo.ai.example/en", None),  # misspelt, same host
        ("t2", "Kimulato Foods", None, "US-OH"), ("t3", "Perulami Labs", "perulami.example", None),  # another line of business on one host
        ("t4", "Hodavuni", None, "Wales"),  # another place
        ("t5", "", None, None), ("t6", None, None, None), ("t7", "Hodavun", None, "OH"), ("t1", "Zorvexo Systems LLC", "https://www.zoravexo.ai.example/en", None),
    ]
    got = matches(spark, docs, asks)
    assert set(got) == {("d1", "t1"), ("d1b", "t1"), ("d2", "t2"), ("d4", "t7")}
    assert all(0 <= c <= 1 for c in got.values())


def test_shared_hosts_say_nothing(spark):
    docs = filler() + [(f"s{i}", f"{w} Media", None, "pages.example", None, None, None, None) for i, w in enumerate("Bavoki Cerumo Difase Fogani Gulepo Hatico Jenuro Kilavo Lomeda Morufi".split())]
    got = matches(spark, docs, [("t", "Zuzazuzo Media", "pages.example", None), ("u", "Difase Media", "pages.example", None)])
    assert set(got) == {("s2", "u")}


def test_no_entities(spark):
    assert matches(spark, [], []) == {} and matches(spark, filler()[:3], []) == {} and matches(spark, [], [("t", "A", None, None)]) == {}


def test_one_edit():
    assert entity_match.one_edit("abcd", "abdc") and entity_match.one_edit("abc", "abxc") and entity_match.one_edit("abc", "abd") and entity_match.one_edit("a", "a")
    assert not entity_match.one_edit("abcd", "badc") and not entity_match.one_edit("abc", "abcde")


# --- places -----------------------------------------------------------------------------------------------------


def brute(word, names, k):
    def osa(a, b):
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        d[:, 0], d[0, :] = range(len(a) + 1), range(len(b) + 1)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[-1, -1]

    return sorted((i, int(x)) for i, n in enumerate(names) if (x := osa(word, n)) <= k)


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=7), st.lists(st.text("abc", min_size=1, max_size=7), max_size=12), st.integers(0, 2))
def test_automaton_finds_what_brute_force_finds(word, names, k):
    trie = place_map.NameTrie()
    for i, n in enumerate(names):
        trie.add(n, i)
    assert trie.search(word, k) == brute(word, names, k)


HQ = [
    ("a", "Saint Caldale, North Carolina, United States", None, None, None, 1), ("b", "St. Caldale", None, None, None, 1), ("c", "mount stiss, NC.", None, None, None, 1), ("d", "Fultecrest", None, None, None, 0),
    ("e", "Fultecrest", None, None, "United Kingdom", 3), ("f", "12 Larch St, Suite 200, Fultecrest, Ohio 41234, US", None, None, None, 2), ("g", "Fultecrest, India", None, None, None, 0), ("h", "Nussokoping / Skåne / remote ok", None, None, None, 4),
    ("i", "n/a", None, None, None, 0), ("j", " ", None, "", None, None), ("k", None, None, None, None, None), ("l", None, None, "Saitn Caldale, nc", "USA", 1), ("m", "Saint Caldale", "Nussoköping", None, None, 0), ("n", "Greater Fultecrest Area, Wales", None, None, None, 3),
    ("o", "HQ: Fultecrest (OH)", "Fultecrest", None, None, 2), ("p", "x" * 100_000, None, None, None, 0), ("q", "US - OH - Fultecrset", None, None, None, 2), ("r", "North Carolina", None, None, None, 0),
]


def test_places(spark):
    c = spark.createDataFrame([(*r[:5], 1) for r in HQ] + [(*HQ[0][:5], 1)], "id string, headquarters string, hq_city string, hq_region string, hq_country string, extra int")
    got = {r["discovery_company_id"]: r["place_id"] for r in place_map.match_places(c, spark.createDataFrame(PLACES, PLACE_SCHEMA)).collect()}
    assert got == {r[0]: r[5] for r in HQ if r[5] is not None}
    empty = place_map.match_places(c, spark.createDataFrame([], PLACE_SCHEMA))
    assert {r["place_id"] for r in empty.collect()} == {0}
    assert place_map.match_places(c.limit(0), spark.createDataFrame(PLACES, PLACE_SCHEMA)).count() == 0


# --- tokens -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.PrefixEncoder(byte_bpe.default_vocabulary(), byte_bpe.default_pattern())


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("ab \n", max_size=60), st.text("etaoin shrdlu", max_size=200)))
def test_ids_are_the_tokenizers(encoder, tokenizer, text):
    assert encoder.encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_whole_corpus_and_defined_ids(spark, tokenizer):
    rows = [(1, None), (2, ""), (3, "<|endoftext|> x"), (4, "a" * 30_000), (5, "日本語 ½ ‮"), (5, "again")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = [(r["doc_id"], list(r["ids"])) for r in byte_bpe.encode_documents(docs.unionByName(d)).collect()]
    want = [(r["doc_id"], tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.unionByName(d).collect()]
    assert sorted(got) == sorted(want)
    counts = {r["doc_id"]: r["n_tokens"] for r in byte_bpe.count_tokens(docs).collect()}
    assert counts == {r["doc_id"]: len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()}
    assert byte_bpe.encode_documents(d.limit(0)).count() == 0


# --- containers -------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 40), st.integers(1, 60), max_size=12))
def test_plan_places_every_item_once(histogram):
    slots, n = packing.plan(histogram, 40)
    load, seen = {}, {}
    for length, a, b, first, each in slots:
        for r in range(a, b):
            assert (length, r) not in seen
            seen[length, r] = first + (r - a) // each
            load[seen[length, r]] = load.get(seen[length, r], 0) + length
    assert len(seen) == sum(histogram.values()) and max(load.values(), default=0) <= 40 and all(0 <= c < n for c in load)
    room = []
    for item in sorted((k for k, v in histogram.items() for _ in range(v) if k), reverse=True):  # item by item
        fits = [i for i, r in enumerate(room) if r >= item]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= item
        else:
            room.append(40 - item)
    assert n == max(len(room), 1 if histogram else 0)


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 7)
    sizes = [0, None, 10, 10, 10, 5, 100, 33, 40, 80, 41] + [3] * 50
    d = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "doc_id long, n int")
    rows = packing.pack(d, "doc_id", "n", 40).collect()
    load = {}
    for r in rows:
        load[r["container_id"]] = load.get(r["container_id"], 0) + r["n_tokens"]
    assert max(load.values()) <= 40 and sum(load.values()) == sum(s or 0 for s in sizes)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["part"], r["n_tokens"]))
    assert sorted(by[6]) == [(0, 40), (1, 40), (2, 20)] and sorted(by[10]) == [(0, 40), (1, 1)] and by[0] == [(0, 0)] and len(by[9]) == 2
    assert all(len(v) == 1 for k, v in by.items() if (sizes[k] or 0) <= 40) and len(by) == len(sizes)
    assert len(load) <= -(-sum(s or 0 for s in sizes) // 40) + 1
    assert packing.pack(d.limit(0), "doc_id", "n", 40).count() == 0
    report = packing.fill_report(packing.pack(d, "doc_id", "n", 40), 40).first()
    assert report["n_containers"] == len(load) and report["fullest"] <= 40


# --- reading level ----------------------------------------------------------------------------------------------

EASY = "we saw the big cat and she ran to the old red house with our good friend".split()
HARD = "the fiduciary notwithstanding a pecuniary covenant which adjudicated its contingent novation pursuant to this tranche".split()


def document(rnd, words, n=12):
    return "\n".join(" ".join(rnd.choice(words) for _ in range(14)).capitalize() + "." for _ in range(n))


def corpus():
    rnd = random.Random(1)
    docs, labels = [], []
    for i in range(120):
        hard = i % 2
        docs.append((i, document(rnd, HARD if hard else EASY)))
        if i < 40:
            labels += [(i, "r", 5 if hard else 1), (i, "q", None)]
    listed = document(rnd, EASY) + "\n" + "\n".join("- a fiduciary pecuniary novation tranche covenant" for _ in range(40))
    docs += [(200, None), (201, ""), (202, "Das Haus und die Katze sind nicht groß. " * 30), (203, listed), (204, document(rnd, HARD).upper()), (205, document(rnd, HARD, 2)), (1, docs[1][1])]
    return docs, labels + [(999, "r", 3)]


def test_levels(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lb = spark.createDataFrame(labels, "doc_id long, reader string, grade int")
    levels = reading_level.reading_levels(d, lb)
    got = {r["doc_id"]: r for r in levels.collect()}
    assert all((got[i]["level"] > 3.5) == bool(i % 2) for i in range(120))
    assert [got[i]["level"] for i in (200, 201, 202)] == [None] * 3 and not got[202]["english"]
    assert got[203]["level"] < 2 and got[204]["level"] > 4
    found = {r["doc_id"] for r in reading_level.demanding_documents(levels).collect()}
    assert found == {i for i in range(120) if i % 2} | {204}
    assert len(got) == len({i for i, _ in docs})


def test_levels_without_labels_or_documents(spark):
    docs, _ = corpus()
    d = spark.createDataFrame(docs[:5], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, reader string, grade int")
    assert {r["level"] for r in reading_level.reading_levels(d, none).collect()} == {None}
    assert reading_level.reading_levels(d.limit(0), none).count() == 0


def test_prose_only():
    text = "## A heading of many words that is not prose at all.\n- an item with quite a few words in its one line.\nThis is a line of prose that has enough words to count.\nSee https://a.example/x\nTerms | Privacy | Contact\nif x > 3: return y"
    assert reading_level.prose_lines(text) == ["This is a line of prose that has enough words to count."]
    assert "prose" in reading_level.prose_words(text) and "This" not in reading_level.prose_words(text)


def test_monotone_fit():
    xs, ys = reading_level.monotone_fit([(0, 1, 1), (1, 3, 1), (2, 2, 1), (3, 5, 2)])
    assert list(ys) == sorted(ys) and np.interp(1.5, xs, ys) == pytest.approx(2.5)
