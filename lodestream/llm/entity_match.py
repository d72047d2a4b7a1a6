"""Matching entities across two tables that share no key.

Both tables are parsed to the same attributes: spellings of the bare name, line of business, web host, region. Each
record asks the other table: an inverted index over all attributes (spellings with their one-deletion variants and
first letters, host, line of business, region) is scored by BM25, of each attribute the best common token counting
once. A record retrieves what reaches LEAST_SHARE of the score that it would have against itself, down to the TOP_K-th
best score. Tokens are pruned by MaxScore: a token is non-essential for a record if all tokens up to it, in order of
their greatest possible scores, can't reach that share together; only postings of the others are joined, and the pairs
found are then completed by the non-essential ones. The result is that of scoring every pair.

A pair is mutually nearest if each retrieves the other and is its nearest, or another listing of the nearest: a record
that reaches NEAR of its score and states no other line of business or region. Retrieved records that state another
line of business or region than the one that asks are other firms and not its nearest.
The confidence comes from the score: a logistic function of the name's share of the attainable score, of the agreement
of the other attributes and of the gap to the best rival (a retrieved record that states another line of business or
region than the pair's), calibrated on the pairs with two own hosts, whose equality is the noisy label; the two error
rates of that label are estimated and taken out, and are the weight of a common or different host (two hosts that
spell the same name are neither). Pairs below
LEAST_CONFIDENCE are dropped, and an exact check drops those whose lines of business, regions or countries exclude
each other.

Scale: tokens are 64-bit hashes; only tokens of both tables go on. Postings of a token in more than POSTINGS records
are split into blocks. Nothing but the calibration's cells (at most 2 x (BINS + 1) ^ 2 x 5) is collected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.llm.place_map import PlaceIndex, SharedIndex, fold
from lodestream.runtime import staged

# Legal forms and articles, which say nothing about identity.
LEGAL_FORMS = frozenset("inc incorporated corp corporation llc ltd limited plc gmbh ag sa sas sl pty pvt holdings holding group co company bv nv ab oy srl spa kg lp llp the and".split())

# Countries in which a legal form is used.
LEGAL_COUNTRIES = {
    "gmbh": ("de", "at", "ch"), "ag": ("de", "ch", "at"), "kg": ("de", "at"), "sas": ("fr",), "sa": ("fr", "es", "be", "ch"), "sl": ("es",), "ab": ("se",), "pty": ("au",), "pvt": ("in",),
    "plc": ("gb", "ie"), "limited": ("gb", "in", "ca", "au", "ie", "nz"), "ltd": ("gb", "in", "ca", "au", "ie", "nz"), "llc": ("us",), "inc": ("us", "ca"), "incorporated": ("us", "ca"),
    "corp": ("us", "ca"), "corporation": ("us", "ca"), "bv": ("nl",), "nv": ("nl", "be"), "oy": ("fi",), "srl": ("it",), "spa": ("it",),
}

# Lines of business.
BUSINESSES = frozenset(
    "analytics biotech brands capital cloud consulting data energy finance foods health healthcare labs logistics materials media mobility networks partners pharma "
    "manufacturing retail robotics security services software solutions studios systems technologies therapeutics ventures".split()
)
# What is put before and after a name in a host.
HOST_SERVICES = ("www", "careers", "jobs", "app", "blog", "about", "en", "go", "hire", "team")
HOST_PREFIXES = ("get", "try", "use", "join", "my", "go")
HOST_SUFFIXES = ("hq", "app", "inc", "corp", "labs")

# Abbreviations of lines of business that aren't made of the word's own letters in order.
BUSINESS_ABBREVIATIONS = {"tx": "therapeutics"}

K1, B = 1.2, 0.4
#: Boosts of a spelling, a variant of it, its first letters, a host, a line of business, a region.
BOOST = {"name": 1.0, "variant": 0.6, "start": 0.3, "host": 1.0, "business": 0.4, "region": 0.4}
#: Letters of a name's start, by which it is abbreviated.
START = 4
#: A record retrieves only what has this share of the score it has against itself, down to this many different scores.
LEAST_SHARE, TOP_K = 0.28, 20
#: Share of the nearest's score that another listing of the same firm has.
NEAR = 0.4
LEAST_CONFIDENCE = 0.5
#: A host is shared if most of its records have names it doesn't spell, with so many different first two letters.
FOREIGN_STARTS = 5
#: Records of one block of a token's postings.
POSTINGS = 4096
#: Calibration: cells of a feature, weights of (name, agreement, gap, 1) where there is nothing to learn from, and how
#: many pairs these weigh as much as.
BINS, PRIOR, PRIOR_PAIRS = 10, (5.0, 2.0, 1.0, -3.5), 5.0
#: Share of a pair's records under one host if they are one firm, and if they aren't, before anything is counted.
SAME_HOST, CHANCE_HOST, HOST_PAIRS = 0.8, 0.1, 20.0

RECORD = "id string, bases array<string>, stems array<string>, business string, host string, region string, lands array<string>, own boolean"


def business_of(word: str) -> str:
    """The line of business that a word or its abbreviation states: its letters in order, from the first; or ''."""
    if word in BUSINESSES:
        return word
    if word in BUSINESS_ABBREVIATIONS:
        return BUSINESS_ABBREVIATIONS[word]
    if len(word) < 3:
        return ""
    starts = [x for x in BUSINESSES if x.startswith(word) or word == x.removesuffix("ies") + "y" or word + "s" == x]
    if not starts:
        starts = [x for x in BUSINESSES if x[0] == word[0] and _in_order(word, x)]
    return starts[0] if len(starts) == 1 else ""


def _in_order(short: str, word: str) -> bool:
    letters = iter(word)
    return all(ch in letters for ch in short)


def read_name(name: str | None) -> tuple[str, str, tuple[str, ...]]:
    """(bare name without blanks, line of business or '', countries of the legal form)."""
    text = re.sub(r"\([^)]*\)", " ", name or "")
    text = re.sub(r"\b([a-z])\.(?=[a-z]\b)", r"\1", text, flags=re.I)
    words = fold(text).split()
    lands: tuple[str, ...] = ()
    while len(words) > 1 and words[-1] in LEGAL_FORMS:
        # "Pty Ltd" and "Pvt Ltd" are the narrower form's.
        lands = LEGAL_COUNTRIES.get(words.pop(), lands)
    if len(words) > 1 and words[0] == "the":
        words.pop(0)
    business = business_of(words[-1]) if len(words) > 1 else ""
    if business:
        words.pop()
    return "".join(w for w in words if w != "and") or "".join(words), business, lands


def read_host(domain: str | None) -> str:
    """Host in lower case without scheme, path, port and service label."""
    host = re.sub(r"^[a-z]+://", "", (domain or "").strip().lower())
    host = re.split(r"[/?#:\s]", host)[0].strip(".")
    labels = host.split(".")
    while len(labels) > 2 and labels[0] in HOST_SERVICES:
        labels.pop(0)
    return ".".join(labels) if len(labels) > 1 else ""


def host_stems(host: str) -> list[str]:
    """What the host's first label can be the spelling of."""
    stem = re.sub(r"[^a-z0-9]", "", host.split(".")[0]) if host else ""
    out = {stem}
    out |= {stem[len(p):] for p in HOST_PREFIXES if stem.startswith(p)}
    out |= {x[: -len(q)] for x in list(out) for q in HOST_SUFFIXES if x.endswith(q)}
    return sorted(x for x in out if len(x) > 2)


def one_edit(a: str, b: str) -> bool:
    """Whether at most one insertion, deletion, substitution or adjacent transposition separates a and b."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i:] == b[i + 1 :]


def deletions(form: str) -> set[str]:
    """Spellings of any length, as the exact check accepts near names of any length."""
    return {form[:i] + form[i + 1 :] for i in range(len(form))}


def make_record(record_id, names, domain, place_fields, places: PlaceIndex) -> tuple:
    read = [read_name(n) for n in names if n and n.strip()]
    bases = sorted({b for b, _, _ in read if b})
    business = next((x for _, x, _ in read if x), "")
    lands = next((x for _, _, x in read if x), ())
    host = read_host(domain)
    stems = host_stems(host)
    own = any(one_edit(s, b) or (len(b) >= 3 and s.startswith(b)) or b.startswith(s) for s in stems for b in bases)
    region = ""
    verdict = places.resolve(*place_fields)
    if verdict and verdict[0]:
        region = places.region[verdict[0]]
        lands = (places.country[verdict[0]],)
    elif verdict:
        for field in place_fields[:3]:
            for piece in re.split(r"[,/;|()]|\s-\s", field or ""):
                found, reg, _ = places.read(re.sub(r"^\s*[A-Za-z]{2}-(?=[A-Za-z]{2}\s*$)", "", piece))
                region = region or reg
        if region in places.region_country:
            lands = (places.region_country[region],)
    return (record_id, bases, stems, business, host, region, list(lands), own)


def records(df: DataFrame, id_col: str, names: list[str], domain: str, place_cols: list[str | None], places: SharedIndex) -> DataFrame:
    """One parsed row per id. ``place_cols`` name the columns of head office, city, region, country (or None)."""
    columns = [F.col(id_col).alias("id"), *[F.col(c).alias(f"n{i}") for i, c in enumerate(names)], F.col(domain).alias("dom"), *[(F.col(c) if c else F.lit(None).cast("string")).alias(f"p{i}") for i, c in enumerate(place_cols)]]
    k = len(names)
    lists = pa.list_(pa.string())
    kinds = (pa.string(), lists, lists, pa.string(), pa.string(), pa.string(), lists, pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = places.get()
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            out = [make_record(r[0], r[1 : 1 + k], r[1 + k], r[2 + k :], index) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["id", "bases", "stems", "business", "host", "region", "lands", "own"])

    return df.select(*columns).filter(F.col("id").isNotNull()).dropDuplicates(["id"]).mapInArrow(run, RECORD)


def shared_hosts(*tables: DataFrame) -> DataFrame:
    """The hosts whose pages say nothing about identity: most of their records have names that the host doesn't
    spell, and these names are many unrelated ones (they begin in FOREIGN_STARTS different ways or more)."""
    rows = None
    for df in tables:
        some = df.filter((F.col("host") != "") & (F.size("bases") > 0)).select("host", "own", F.left(F.element_at("bases", 1), F.lit(2)).alias("start"))
        rows = some if rows is None else rows.unionByName(some)
    per_start = rows.groupBy("host", "start").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("n_own"))
    foreign = F.count_if(F.col("n") > F.col("n_own"))
    return per_start.groupBy("host").agg(foreign.alias("k"), F.sum("n").alias("n"), F.sum("n_own").alias("n_own")).filter((F.col("k") >= FOREIGN_STARTS) & (F.col("n_own") * 2 < F.col("n"))).select("host", F.lit(True).alias("is_shared"))


TOKEN = "array<struct<h:bigint,field:string,boost:double>>"


def _token(kind: str, text: Column, field: str, boost: str) -> Column:
    return F.struct(F.xxhash64(F.lit(kind), text).alias("h"), F.lit(field).alias("field"), F.lit(BOOST[boost]).alias("boost"))


def name_tokens(spellings: Column, bases: Column) -> Column:
    """Tokens of the spellings, of their one-deletion variants and of the first letters of the names."""
    variants = F.array_distinct(F.flatten(F.transform(spellings, lambda f: F.transform(F.sequence(F.lit(0), F.length(f)), lambda i: F.when(i == 0, f).otherwise(F.concat(F.left(f, i - 1), F.substring(f, i + 1, F.length(f))))))))
    starts = F.array_distinct(F.transform(F.filter(bases, lambda f: F.length(f) >= START), lambda f: F.left(f, F.lit(START))))
    return F.concat(
        F.transform(spellings, lambda f: _token("n", f, "name", "name")), F.transform(variants, lambda v: _token("v", v, "name", "variant")),
        F.transform(starts, lambda f: _token("p", f, "name", "start")),
    )


def with_tokens(df: DataFrame, shared: DataFrame) -> DataFrame:
    """Adds ``tokens``, array of (hash, field, boost), and what of each field there is; shared hosts are blanked."""
    drop = F.coalesce("is_shared", F.lit(False))
    clean = df.join(shared, "host", "left").select("n", "id", "bases", F.when(drop, F.array().cast("array<string>")).otherwise(F.col("stems")).alias("stems"), "business", F.when(drop, F.lit("")).otherwise(F.col("host")).alias("host"), "region", "lands")
    clean = clean.withColumn("spellings", F.array_union("bases", "stems"))
    one = lambda kind, c: F.when(F.col(c) != "", F.array(_token(kind, F.col(c), c, c))).otherwise(F.array().cast(TOKEN))
    there = [(F.col(c) != "").cast("int").alias(f"has_{c}") for c in ("host", "business", "region")]
    tokens = F.concat(name_tokens(F.col("spellings"), F.col("bases")), one("d", "host"), one("l", "business"), one("r", "region"))
    return clean.select("n", "id", "bases", "spellings", "stems", "business", "host", "region", "lands", F.size("spellings").alias("n_spellings"), *there, tokens.alias("tokens")).withColumn("dl", F.col("n_spellings") + F.col("has_host") + F.col("has_business") + F.col("has_region"))


def _norm(length: Column, mean_length: Column) -> Column:
    """BM25's factor of a token that is once in a record of this length."""
    return (K1 + 1) / (1 + K1 * (1 - B + B * length / mean_length))


def common_tokens(left: DataFrame, right: DataFrame) -> DataFrame:
    """h, left_df, right_df of the tokens that both tables have, counted in the map stage first."""
    side = lambda df, a, b: df.select(F.explode("tokens.h").alias("h"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    counts = side(left, 1, 0).unionByName(side(right, 0, 1)).groupBy("h").agg(F.sum("a").alias("left_df"), F.sum("b").alias("right_df"))
    return counts.filter((F.col("left_df") > 0) & (F.col("right_df") > 0))


def postings(df: DataFrame, tokens: DataFrame) -> DataFrame:
    """n, h, field, boost, left_df, right_df of the records' tokens that both tables have."""
    return df.select("n", F.explode("tokens").alias("t")).select("n", "t.h", "t.field", "t.boost").join(tokens, "h")


FIELDS = ("name", "host", "business", "region")


def asked_tokens(queries: DataFrame, own: DataFrame, df: str, n: int, mean_length: float) -> DataFrame:
    """query, h, field, w, df, self, self_name, essential: each token of a query with its boosted idf, the query's score
    against itself, and whether MaxScore needs the token's postings."""
    most = float(np.log1p((n - 0.5) / 1.5))  # idf of a token of one record; one that no record has counts alike
    idf = F.log1p((F.lit(n) - F.col(df) + 0.5) / (F.col(df) + 0.5))
    rows = own.select("n", "h", "field", "boost", F.col(df).alias("df"), (F.col("boost") * idf).alias("w")).join(queries.select("n", "dl", "n_spellings", *[f"has_{f}" for f in FIELDS[1:]]), "n")
    every = Window.partitionBy("n")
    best = {f: F.max(F.when(F.col("field") == f, F.col("w"))).over(every) for f in FIELDS}
    exact = F.count_if((F.col("field") == "name") & (F.col("boost") == BOOST["name"])).over(every)
    parts = [F.when(exact < F.col("n_spellings"), F.lit(most * BOOST["name"])).otherwise(F.coalesce(best["name"], F.lit(0.0))), *[F.when(F.col(f"has_{f}") == 1, F.coalesce(best[f], F.lit(most * BOOST[f]))).otherwise(0.0) for f in FIELDS[1:]]]
    upto = Window.partitionBy("n").orderBy("w", "h").rowsBetween(Window.unboundedPreceding, 0)
    bound = sum((F.coalesce(F.max(F.when(F.col("field") == f, F.col("w"))).over(upto), F.lit(0.0)) for f in FIELDS), F.lit(0.0)) * _norm(F.lit(1), F.lit(mean_length))
    out = rows.withColumn("self", _norm(F.col("dl"), F.lit(mean_length)) * sum(parts, F.lit(0.0))).withColumn("self_name", parts[0]).withColumn("bound", bound)
    return out.select(F.col("n").alias("query"), "h", "field", "w", "df", "self", "self_name", (F.col("bound") >= LEAST_SHARE * F.col("self")).alias("essential"))


def retrieve(collection: DataFrame, queries: DataFrame, posted: DataFrame, own: DataFrame, df: str) -> DataFrame:
    """query, doc (numbers), score, self, name_share, host_score and the record's attributes: all records with at least
    LEAST_SHARE of the query's score against itself, down to its TOP_K-th best score.

    ``posted`` and ``own``: postings of the collection and of the queries; ``df``: their column with the number of
    records of the collection.
    """
    stats = collection.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean")).first()
    n, mean_length = max(1, stats["n"]), max(1.0, stats["mean"] or 1.0)
    asked = staged(asked_tokens(queries, own, df, n, mean_length), "match-asked")
    blocks = lambda c: F.ceil(F.col(c) / POSTINGS).cast("int")
    there = posted.select(F.col("n").alias("doc"), "h", F.pmod(F.xxhash64("n"), blocks(df)).cast("int").alias("block"))
    needed = asked.filter("essential").select("query", "h", "field", "w", F.explode(F.sequence(F.lit(0), blocks("df") - 1)).alias("block"))
    best = lambda f: F.max(F.when(F.col("field") == f, F.col("w"))).alias(f"e_{f}")
    found = needed.join(there, ["h", "block"]).groupBy("query", "doc").agg(*[best(f) for f in FIELDS])
    rest = asked.groupBy("query").agg(F.first("self").alias("self"), F.first("self_name").alias("self_name"), F.collect_list(F.when(~F.col("essential"), F.struct("h", "field", "w"))).alias("rest"))
    full = found.join(rest, "query").join(collection.select(F.col("n").alias("doc"), "business", "host", "stems", "region", "lands", "dl", "spellings", "bases"), "doc")
    kinds = {"host": "d", "business": "l", "region": "r"}

    def completed(f: str) -> Column:
        """The best common token of a field, non-essential ones included."""
        left = F.filter("rest", lambda x: x["field"] == f)
        if f == "name":  # the record's tokens are made again for the few queries that have such names
            hashes = F.transform(name_tokens(F.col("spellings"), F.col("bases")), lambda t: t["h"])
            left = F.when(F.size(left) > 0, F.filter(left, lambda x: F.array_contains(hashes, x["h"])))
        else:
            own_hash = F.xxhash64(F.lit(kinds[f]), f)
            left = F.filter(left, lambda x: x["h"] == own_hash)
        return F.greatest(F.coalesce(f"e_{f}", F.lit(0.0)), F.coalesce(F.array_max(F.transform(left, lambda x: x["w"])), F.lit(0.0)))

    part = {f: completed(f) for f in FIELDS}
    norm = _norm(F.col("dl"), F.lit(mean_length))
    scored = full.select(
        "query", "doc", "business", "host", "stems", "region", "lands", "self", (norm * sum(part.values(), F.lit(0.0))).alias("score"),
        F.least(F.lit(1.0), F.coalesce(F.try_divide(part["name"], F.col("self_name")), F.lit(0.0))).alias("name_share"), (norm * part["host"]).alias("host_score"),
    ).filter(F.col("score") >= LEAST_SHARE * F.col("self"))
    place = F.dense_rank().over(Window.partitionBy("query").orderBy(F.desc("score")))
    return scored.withColumn("_place", place).filter(F.col("_place") <= TOP_K).drop("_place")


def _clash(a: Column, b: Column) -> Column:
    """Whether two structs state different lines of business or regions."""
    differ = lambda f: (a[f] != "") & (b[f] != "") & (a[f] != b[f])
    return differ("business") | differ("region")


def neighbours(hits: DataFrame) -> DataFrame:
    """query, firms: array of (score, business, region), the best score of each combination that a query retrieved,
    best first; no more of them than there are lines of business and regions."""
    kinds = hits.groupBy("query", "business", "region").agg(F.max("score").alias("score"))
    return kinds.groupBy("query").agg(F.reverse(F.array_sort(F.collect_list(F.struct("score", "business", "region")))).alias("firms"))


def fit_logistic(cells: list[tuple[tuple[float, ...], int, int]], prior: tuple[float, ...] = PRIOR, strength: float = PRIOR_PAIRS) -> list[float]:
    """Weights of (features, 1) in p = 1 / (1 + exp(-w f)) by Newton steps on cells (features, label, count), drawn
    to ``prior``; without cells they are the prior."""
    w0 = np.array(prior, float)
    w = w0.copy()
    if not cells:
        return w.tolist()
    x = np.array([[*f, 1.0] for f, _, _ in cells])
    y, n = np.array([c[1] for c in cells], float), np.array([c[2] for c in cells], float)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (n * (y - p)) - strength * (w - w0))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def match_entities(collection: DataFrame, queries: DataFrame, places: DataFrame) -> DataFrame:
    """discovery_company_id, tracked_company_id, confidence of the pairs that are the same firm.

    ``collection``: id, name, apollo_org_name, domain, headquarters, hq_city, hq_region, hq_country. ``queries``:
    id, name, domain, state. ``places``: the reference list of places. A null or blank attribute says nothing; a
    record that has none is in no pair. Repeated ids count once; a firm under two ids is in two pairs. Empty tables
    give no row. Other columns are ignored.
    """
    index = SharedIndex(places)
    number = F.monotonically_increasing_id()  # kept by the staged table
    docs = staged(records(collection, "id", ["name", "apollo_org_name"], "domain", ["headquarters", "hq_city", "hq_region", "hq_country"], index).withColumn("n", number), "match-collection")
    asks = staged(records(queries, "id", ["name"], "domain", [None, None, "state", None], index).withColumn("n", number), "match-queries")
    shared = staged(shared_hosts(docs, asks), "match-shared-hosts")
    docs, asks = with_tokens(docs, shared), with_tokens(asks, shared)
    tokens = staged(common_tokens(docs, asks), "match-tokens")
    of_docs, of_asks = staged(postings(docs, tokens), "match-postings"), staged(postings(asks, tokens), "match-postings")
    forth = staged(retrieve(docs, asks, of_docs, of_asks, "left_df"), "match-forth")
    back = staged(retrieve(asks, docs, of_asks, of_docs, "right_df"), "match-back")

    side = lambda df, p, q, d: df.select(F.col("query").alias(q), F.col("doc").alias(d), F.struct("business", "region", "host", "stems", "lands").alias(p), F.col("score").alias(f"{p}_score"), F.col("name_share").alias(f"{p}_share"), F.col("host_score").alias(f"{p}_host"))
    pairs = side(forth, "doc", "query_n", "doc_n").join(side(back, "query", "doc_n", "query_n"), ["query_n", "doc_n"])
    pairs = pairs.join(neighbours(forth).withColumnsRenamed({"query": "query_n", "firms": "docs"}), "query_n").join(neighbours(back).withColumnsRenamed({"query": "doc_n", "firms": "queries"}), "doc_n")

    def nearest(score: Column, own: Column, firms: Column, asker: Column) -> Column:
        """Whether a retrieved record is the asker's nearest one, or another listing of it."""
        first = F.try_element_at(F.filter(firms, lambda x: ~_clash(asker, x)), F.lit(1))
        return F.coalesce((score >= NEAR * first["score"]) & ~_clash(own, first), F.lit(False))

    def gap(score: Column, own: Column, firms: Column) -> Column:
        rival = F.array_max(F.transform(F.filter(firms, lambda x: _clash(own, x)), lambda x: x["score"]))
        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(score - F.coalesce(rival, F.lit(0.0)), score), F.lit(0.0))))

    d, q = F.col("doc"), F.col("query")
    same = lambda f: ((d[f] != "") & (d[f] == q[f])).cast("int")
    other = lambda f: ((d[f] != "") & (q[f] != "") & (d[f] != q[f])).cast("int")
    abroad = (F.size(d["lands"]) > 0) & (F.size(q["lands"]) > 0) & ~F.arrays_overlap(d["lands"], q["lands"]) & (same("host") == 0)
    binned = lambda c, k=BINS: F.round(c * k) / k
    features = [
        binned((F.col("doc_share") + F.col("query_share")) / 2),
        (same("business") + same("region") - other("business") - other("region")) / 2,
        binned((gap(F.col("doc_score") - F.col("doc_host"), d, F.col("docs")) + gap(F.col("query_score") - F.col("query_host"), q, F.col("queries"))) / 2, BINS // 2),
    ]
    judged = staged(
        pairs.select(
            "doc_n", "query_n", F.array(*features).alias("f"), (nearest(F.col("doc_score"), d, F.col("docs"), q) & nearest(F.col("query_score"), q, F.col("queries"), d)).alias("mutual"),
            ((other("business") + other("region") > 0) | abroad).alias("excluded"), F.when(same("host") == 1, 1).when((other("host") == 1) & ~F.arrays_overlap(d["stems"], q["stems"]), 0).alias("one_host"),
        ),
        "match-judged",
    )
    labelled = judged.filter(F.col("one_host").isNotNull() & (F.col("f")[0] > 0))
    cells = [(tuple(r["f"]), r["one_host"], r["excluded"], r["n"]) for r in labelled.groupBy("f", "one_host", "excluded").agg(F.count(F.lit(1)).alias("n")).collect()]
    weights = fit_logistic([(f, y, n) for f, y, _, n in cells])

    def host_rate(excluded: bool, guess: float) -> float:
        hit, all_ = (sum(n for _, y, e, n in cells if e == excluded and y >= least) for least in (1, 0))
        return (hit + guess * HOST_PAIRS) / (all_ + HOST_PAIRS)

    # Share of common hosts among firms that are one and that aren't; the label's error rates.
    a, b = host_rate(False, SAME_HOST), host_rate(True, CHANCE_HOST)
    a = max(a, b + 0.05)
    logit = sum((w * F.col("f")[i] for i, w in enumerate(weights[:-1])), F.lit(weights[-1]))
    p = 1 / (1 + F.exp(-logit))
    p = F.greatest(F.lit(0.01), F.least(F.lit(0.99), (p - b) / (a - b))) if cells else p
    odds = p / (1 - p) * F.when(F.col("one_host") == 1, a / b).when(F.col("one_host") == 0, (1 - a) / (1 - b)).otherwise(1.0)
    confidence = F.round(odds / (1 + odds), 4)
    kept = judged.filter(F.col("mutual") & ~F.col("excluded")).withColumn("confidence", confidence).filter(F.col("confidence") >= LEAST_CONFIDENCE)
    named = lambda df, key, name: df.select(F.col("n").alias(key), F.col("id").alias(name))
    return kept.join(named(docs, "doc_n", "discovery_company_id"), "doc_n").join(named(asks, "query_n", "tracked_company_id"), "query_n").select("discovery_company_id", "tracked_company_id", "confidence")
