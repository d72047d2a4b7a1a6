"""BM25 retrieval with MaxScore gives what scoring every pair gives; hot tokens, shared hosts, many spellings."""

import math
import random

import pytest

from lodestream.llm import entity_match as em

RECORD = "id string, bases array<string>, stems array<string>, business string, host string, region string, lands array<string>, own boolean"


def table(rnd, side, n):
    """Records of few names, hosts, lines and regions, so that many tokens are common and some are in most records."""
    name = lambda: "".join(rnd.choice("bd") + rnd.choice("ae") for _ in range(rnd.choice([1, 2, 3])))
    out = []
    for i in range(n):
        host = rnd.choice(["", "", "bade.x", "deda.x", "baba.x"])
        out.append((f"{side}{i}", sorted({name() for _ in range(rnd.choice([0, 1, 1, 2]))}), [host[:4]] if host else [], rnd.choice(["", "data", "data", "media", "foods"]), host, rnd.choice(["", "oh", "oh", "ca"]), [], True))
    return out


def score_all(collection, queries):
    """(query, doc) -> (score, self) of every pair, from the definition."""
    def tokens(r):
        spellings = set(r[1]) | set(r[2])
        out = {("n", f): ("name", em.BOOST["name"]) for f in spellings}
        out |= {("v", v): ("name", em.BOOST["variant"]) for f in spellings for v in {f} | {f[:i] + f[i + 1 :] for i in range(len(f))}}
        out |= {("p", f[: em.START]): ("name", em.BOOST["start"]) for f in r[1] if len(f) >= em.START}
        return out | {(k, v): (f, em.BOOST[f]) for k, v, f in (("d", r[4], "host"), ("l", r[3], "business"), ("r", r[5], "region")) if v}

    docs, asks = {r[0]: tokens(r) for r in collection}, {r[0]: tokens(r) for r in queries}
    dl = {r[0]: len(set(r[1]) | set(r[2])) + sum(1 for x in (r[4], r[3], r[5]) if x) for r in collection + queries}
    n, mean = len(collection), max(1.0, sum(dl[r[0]] for r in collection) / len(collection))
    df = {}
    for t in docs.values():
        for x in t:
            df[x] = df.get(x, 0) + 1
    idf = lambda x: math.log1p((n - df.get(x, 1) + 0.5) / (df.get(x, 1) + 0.5))
    norm = lambda k: (em.K1 + 1) / (1 + em.K1 * (1 - em.B + em.B * k / mean))

    def score(q, d, k):
        best = {}
        for x, (f, boost) in q.items():
            if d is None or x in d:
                best[f] = max(best.get(f, 0.0), boost * idf(x))
        return norm(k) * sum(best.values())

    both = {x for t in docs.values() for x in t} & {x for t in asks.values() for x in t}
    return {(i, j): (score(q, d, dl[j]), score(q, None, dl[i])) for i, q in asks.items() for j, d in docs.items() if both & set(q) & set(d)}


@pytest.mark.parametrize("seed, postings", [(1, 4096), (2, 4096), (3, 7), (4, 1)])
def test_retrieval_is_that_of_scoring_every_pair(spark, monkeypatch, seed, postings):
    monkeypatch.setattr(em, "POSTINGS", postings)
    rnd = random.Random(seed)
    left, right = table(rnd, "d", 60), table(rnd, "q", 40)
    none = spark.createDataFrame([], "host string, is_shared boolean")
    docs, asks = (em.with_tokens(spark.createDataFrame([(*r, i) for i, r in enumerate(x)], RECORD + ", n long"), none) for x in (left, right))
    tokens = em.common_tokens(docs, asks)
    ids = [{r["n"]: r["id"] for r in x.select("n", "id").collect()} for x in (docs, asks)]
    hits = em.retrieve(docs, asks, em.postings(docs, tokens), em.postings(asks, tokens), "left_df")
    got = {(ids[1][r["query"]], ids[0][r["doc"]]): (r["score"], r["self"]) for r in hits.collect()}
    want = {}
    for q in {q for q, _ in score_all(left, right)}:
        hits = {k: v for k, v in score_all(left, right).items() if k[0] == q and v[0] >= em.LEAST_SHARE * v[1] - 1e-9}
        places = sorted({round(v[0], 9) for v in hits.values()}, reverse=True)[: em.TOP_K]
        want |= {k: v for k, v in hits.items() if round(v[0], 9) in places}
    sure = {k for k, v in want.items() if abs(v[0] - em.LEAST_SHARE * v[1]) > 1e-6}
    assert sure <= set(got) <= set(want) and len(sure) > 100
    for k in sure:
        assert got[k] == pytest.approx(want[k], abs=1e-9), k


def test_a_host_with_many_spellings_of_its_own_name_is_no_shared_host(spark):
    rows = [(f"d{i}", [n], ["zoravexo"], "", "zoravexo.x", "", [], True) for i, n in enumerate("zoravexo zoravex zorvexo zoravxo zoravexoo zooravexo zaravexo zorabexo zoravexi zoraveco zoravedo".split())]
    rows += [(f"e{i}", [n], ["pages"], "", "pages.x", "", [], False) for i, n in enumerate("bavoki cerumo difase fogani gulepo hatico".split())]
    rows += [("f1", [], [], "", "blank.x", "", [], False), ("g1", ["old"], ["newname"], "", "newname.x", "", [], False)]
    assert [r["host"] for r in em.shared_hosts(spark.createDataFrame(rows, RECORD)).collect()] == ["pages.x"]


def test_lines_of_business_and_their_abbreviations():
    assert [em.business_of(w) for w in ("analytics", "anlytcs", "netwks", "sftwr", "sys", "tech", "tx", "network", "svcs", "mfg", "technology")] == [
        "analytics", "analytics", "networks", "software", "systems", "technologies", "therapeutics", "networks", "services", "manufacturing", "technologies",
    ]
    assert [em.business_of(w) for w in ("zoravexo", "s", "to", "", "lab2")] == [""] * 5


def test_calibration_without_labels_is_the_prior():
    assert em.fit_logistic([]) == list(em.PRIOR)
    w = em.fit_logistic([((1.0, 0.0, 1.0), 1, 900), ((1.0, 0.0, 1.0), 0, 100), ((0.5, 0.0, 0.0), 0, 900), ((0.5, 0.0, 0.0), 1, 100)])
    p = lambda *f: 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, (*f, 1.0)))))
    assert abs(p(1.0, 0.0, 1.0) - 0.9) < 0.02 and abs(p(0.5, 0.0, 0.0) - 0.1) < 0.02
