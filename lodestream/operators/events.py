"""Signal events: common rows, relevance, grounding, clustering of reports of one real event, scores."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream import config
from lodestream.config import DEFAULTS
from lodestream.functions import names


def dedupe_key(company: Column, event_type: Column, key: Column, title: Column) -> Column:
    return F.concat_ws(":", company, event_type, F.coalesce(key, F.left(title, F.lit(80))))


def draft(event_type: Column, title: Column, source: Column, confidence: Column, evidence: Column, url: Column, dates: list[Column]) -> list[Column]:
    """Columns of the common event row with its defaults; '' counts as missing."""
    some = lambda c: F.nullif(c, F.lit(""))
    return [
        F.coalesce(event_type, F.lit("social_post")).alias("event_type"), F.coalesce(title, F.lit("")).alias("title"), F.coalesce(source, F.lit("enrichment")).alias("source"),
        F.coalesce(confidence, F.lit(0.85)).alias("confidence"), F.coalesce(some(evidence), some(url)).alias("evidence_url"), F.coalesce(*[some(d) for d in dates]).alias("event_date"),
    ]


def relevant(events: DataFrame, name: str) -> DataFrame:
    """Events of identity sources unchanged; others only if the title names the company, with discounted confidence."""
    trusted = F.col("source").isin(*config.IDENTITY_SOURCES)
    kept = events.filter(trusted | names.title_mentions(F.col("title"), F.col(name)))
    m = names.relevance_multiplier(F.col(name))
    return kept.withColumn("confidence", F.when(trusted | (m >= 1.0), F.col("confidence")).otherwise(F.bround(F.coalesce("confidence", F.lit(0.85)) * m, 3)))


def grounded_funding(df: DataFrame, signals: str, score: str, stage: str, raised: str, evidence: str) -> DataFrame:
    """Keeps funding claims if there is evidence text and the stage occurs in it; otherwise drops the funding
    signals, nulls stage and amount and caps the score at 35, or 25 if nothing else is left."""
    text = F.lower(F.coalesce(F.col(evidence), F.lit("")))
    said = F.trim(F.lower(F.coalesce(F.col(stage), F.lit(""))))
    fine = (F.trim(text) != "") & ((said == "") | text.contains(said))
    all_signals = F.coalesce(F.col(signals), F.array().cast("array<string>"))
    others = F.filter(all_signals, lambda s: ~s.rlike(config.MONEY_WORDS))
    claims = (F.coalesce(F.col(stage), F.lit("")) != "") | (F.coalesce(F.col(raised), F.lit("")) != "") | (F.size(others) < F.size(all_signals))
    strip = ~fine & claims
    cap = F.when(F.size(others) > 0, 35).otherwise(25)
    return df.select(
        *[c for c in df.columns if c not in (signals, score, stage, raised)],
        F.when(strip, others).otherwise(F.col(signals)).alias(signals), F.when(strip, F.least(F.col(score), cap)).otherwise(F.col(score)).alias(score),
        F.when(~strip, F.col(stage)).alias(stage), F.when(~strip, F.col(raised)).alias(raised),
    )


def token_set_ratio(a: str, b: str, least: float = 0.0) -> float:
    """100 x the best normalised insert-delete similarity of the shared words and of them with either rest; 0 if it
    can't reach ``least``."""
    ta, tb = set(a.split()), set(b.split())
    if not ta or not tb:
        return 0.0
    common, ra, rb = " ".join(sorted(ta & tb)), " ".join(sorted(ta - tb)), " ".join(sorted(tb - ta))
    if common and (not ra or not rb):
        return 100.0
    x, y = (common + " " + ra).strip(), (common + " " + rb).strip()
    pairs = [(x, y)] + ([(common, x), (common, y)] if common else [])
    return max((_indel(p, q) for p, q in pairs if _indel_bound(p, q) >= least), default=0.0)


def _indel_bound(a: str, b: str) -> float:
    """An upper bound of _indel: a common subsequence has no more than the common letters."""
    return 200.0 * sum((Counter(a) & Counter(b)).values()) / max(1, len(a) + len(b))


def _indel(a: str, b: str) -> float:
    """100 x (1 - insertions and deletions / length of both), by the longest common subsequence. A bit of ``row`` is 0
    where the subsequence grows, so that a letter of b is one addition."""
    if not a and not b:
        return 100.0
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & at.get(ch, 0)
        row = (row + hit) | (row - hit)
    return 200.0 * (len(a) - (row & full).bit_count()) / (len(a) + len(b))


def _headline(title: str) -> str:
    return re.sub(r"\s+-\s+[^-]+$", "", title or "").lower()


def same_event(event_type: str, a: dict, b: dict) -> bool:
    """Whether two reports tell of one real event: the story decides, else the person, the amount, the titles."""
    if a.get("story") and a.get("story") == b.get("story"):
        return True
    if a.get("person") and b.get("person"):
        return a["person"].lower() == b["person"].lower()
    if event_type == "funding_round" and a.get("amount") and b.get("amount"):
        return re.sub("[^0-9.]", "", a["amount"]) == re.sub("[^0-9.]", "", b["amount"])
    least = DEFAULTS.strict_similarity if event_type in ("news_mention", "exec_hire", "exec_departure") else DEFAULTS.cluster_similarity
    return token_set_ratio(_headline(a.get("title")), _headline(b.get("title")), least) >= least


class ClusterFold:
    """The ordered fold of one company's reports of one type; also the state of the streaming form."""

    def __init__(self, event_type: str, kept: list[dict] | None = None) -> None:
        self.event_type, self.kept = event_type, kept or []

    def add(self, report: dict) -> tuple[str, dict]:
        """('inserted' or 'merged' or 'known', the event). ``report``: key, at (seconds), title, url, source, confidence, story, person, amount."""
        known = next((e for e in self.kept if e["key"] == report["key"]), None)
        if known:
            return "known", known
        oldest = report["at"] - DEFAULTS.cluster_days * 86400
        recent = sorted((e for e in self.kept if e["at"] >= oldest), key=lambda e: (-e["at"], e["key"]))[: DEFAULTS.cluster_memory]
        for e in recent:
            if same_event(self.event_type, e, report):
                if report.get("url") and report["url"] in e["urls"]:
                    return "known", e
                e["urls"] = (e["urls"] + [report.get("url")])[-DEFAULTS.sources_kept :]
                e["confidence"] = min(DEFAULTS.merge_cap, e["confidence"] + DEFAULTS.merge_gain)
                e["n_reports"] += 1
                return "merged", e
        e = dict(report, urls=[report.get("url")], n_reports=1)
        self.kept.append(e)
        return "inserted", e


CLUSTERED = "company_id string, event_type string, dedupe_key string, title string, observed_at timestamp, confidence double, n_reports long"


def cluster_reports(reports: DataFrame) -> DataFrame:
    """Events after the ordered fold. ``reports``: company_id, event_type, dedupe_key, title, observed_at, url, confidence,
    story, person, amount.

    After a gap longer than the look-back no report can reach an earlier event, so a group falls into runs between such
    gaps. Rows are partitioned by company, type and run and sorted by time and key; each task folds its sorted rows in
    one stream, and what it holds is bounded by the events of a run, not by the group.
    """
    columns = ["company_id", "event_type", "dedupe_key", "title", "observed_at", "url", "confidence", "story", "person", "amount"]
    in_order = Window.partitionBy("company_id", "event_type").orderBy("observed_at", "dedupe_key")
    gap = F.unix_micros("observed_at") - F.unix_micros(F.lag("observed_at").over(in_order)) > DEFAULTS.cluster_days * 86_400_000_000
    runs = reports.select(*columns).withColumn("_new", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("_run", F.sum("_new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = runs.repartition("company_id", "event_type", "_run").sortWithinPartitions("company_id", "event_type", "observed_at", "dedupe_key").select(*columns)

    def rows_of(fold: ClusterFold, company: str) -> list[tuple]:
        return [(company, fold.event_type, e["key"], e["title"], pd.Timestamp(round(e["at"] * 1e6), unit="us"), round(e["confidence"], 6), e["n_reports"]) for e in fold.kept]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names_out = ["company_id", "event_type", "dedupe_key", "title", "observed_at", "confidence", "n_reports"]
        at_key, fold, last = None, None, 0.0
        for batch in batches:
            out: list[tuple] = []
            clean = batch.astype(object).where(batch.notna(), None)
            for company, kind, key, title, at, url, confidence, story, person, amount in clean.itertuples(index=False, name=None):
                seconds = at.timestamp()
                if at_key != (company, kind) or seconds > last + DEFAULTS.cluster_days * 86400:
                    out += rows_of(fold, at_key[0]) if fold else []
                    at_key, fold = (company, kind), ClusterFold(kind)
                last = seconds
                fold.add({"key": key, "at": seconds, "title": title or "", "url": url, "confidence": 0.85 if confidence is None else confidence, "story": story, "person": person, "amount": amount})
            yield pd.DataFrame(out, columns=names_out)
        if fold:
            yield pd.DataFrame(rows_of(fold, at_key[0]), columns=names_out)

    return ordered.mapInPandas(run, CLUSTERED)


def stories(events: DataFrame, group: list[str], story: str, order: list[str], confidence: str, gain: float = 0.05, cap: float = 0.95) -> DataFrame:
    """One row per story: the first report's values, the number of reports and the raised confidence."""
    first = F.min_by(F.col(confidence), F.struct(*order))
    return events.groupBy(*group, story).agg(F.count(F.lit(1)).alias("n_reports"), F.round(F.least(F.lit(cap), first + gain * (F.count(F.lit(1)) - 1)), 6).alias("confidence"))


def heat(events: DataFrame, key: str, as_of: Column, weights: dict[str, int], days: float = DEFAULTS.heat_days, relevance: Column | None = None, unknown: float = 10.0) -> DataFrame:
    """Adds ``contribution``: weight x e^(-age in whole days / days) x relevance x confidence; an unknown type has the
    weight ``unknown``, and without a measure of relevance it is 1."""
    table = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
    age = F.floor((F.unix_micros(as_of) - F.unix_micros("observed_at")) / 86_400_000_000)
    weight = F.coalesce(F.try_element_at(table, F.col("event_type")), F.lit(float(unknown)))
    return events.withColumn("contribution", weight * F.exp(-age / days) * (F.lit(1.0) if relevance is None else relevance) * F.coalesce("confidence", F.lit(1.0)))


def heat_scores(contributions: DataFrame, key: str, cap: float = DEFAULTS.heat_cap) -> DataFrame:
    """key, raw_heat, heat: the sum, and the sum in whole points up to the cap."""
    total = F.sum("contribution")
    return contributions.groupBy(key).agg(F.round(total, 4).alias("raw_heat"), F.least(F.lit(int(cap)), F.bround(F.round(total, 4), 0).cast("int")).alias("heat"))


def heat_reasons(contributions: DataFrame, key: str, n: int = 3) -> DataFrame:
    """The largest contributions of each key, by type; ties by name."""
    per_type = contributions.groupBy(key, "event_type").agg(F.round(F.sum("contribution"), 4).alias("contribution"))
    w = Window.partitionBy(key).orderBy(F.desc("contribution"), "event_type")
    return per_type.filter(F.col("contribution") > 0).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
