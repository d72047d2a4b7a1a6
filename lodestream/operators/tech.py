"""Technologies shown by pages and name servers."""

from __future__ import annotations

import json
import re
import time
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream import config

#: Order in which evidence is looked for; the first class that matches is the evidence.
EVIDENCE = ("script", "header", "cookie", "meta", "dns", "url", "inline", "html")


def _pairs(source: str, values: Column, fold) -> Column:
    """Evidence of a map of texts, or of lists of texts, by its keys."""
    return F.transform(F.map_entries(F.coalesce(values, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lit(source).alias("source"), fold(e["key"]).alias("key"), e["value"].alias("value")))


def page_features(
    pages: DataFrame, page_id: str, html: str, url: str, most_html: int | None = None, most_inline: int | None = None,
    headers: str | None = None, cookies: str | None = None, dns: str | None = None,
) -> DataFrame:
    """page_id, source, key, value: script addresses, inline scripts, meta contents, the address, the markup; and of the
    columns ``headers`` and ``cookies`` (map of texts) and ``dns`` (map of lists) their entries, where they are given.

    The markup and each inline script are taken whole unless ``most_html`` and ``most_inline`` say how many
    characters of them; the reference has 600,000 and 50,000.
    """
    cut = lambda c, most: c if most is None else F.left(c, F.lit(most))
    h = cut(F.coalesce(F.col(html), F.lit("")), most_html)
    scripts = F.transform(F.regexp_extract_all(h, F.lit(r"(?is)<script\b[^>]*\bsrc\s*=\s*[\"']?([^\"'\s>]+)"), F.lit(1)), lambda s: F.struct(F.lit("script").alias("source"), F.lit("").alias("key"), s.alias("value")))
    inline = F.transform(F.regexp_extract_all(h, F.lit(r"(?is)<script(?![^>]*\bsrc\s*=)[^>]*>(.*?)</script>"), F.lit(1)), lambda s: F.struct(F.lit("inline").alias("source"), F.lit("").alias("key"), cut(s, most_inline).alias("value")))
    metas = F.transform(
        F.regexp_extract_all(h, F.lit(r"(?is)(<meta\b[^>]*>)"), F.lit(1)),
        lambda m: F.struct(F.lit("meta").alias("source"), F.lower(F.regexp_extract(m, r"(?is)\b(?:name|property|http-equiv)\s*=\s*[\"']?([^\"'>\s]+)", 1)).alias("key"), F.regexp_extract(m, r"(?is)\bcontent\s*=\s*[\"']([^\"']*)", 1).alias("value")),
    )
    rest = F.array(F.struct(F.lit("url").alias("source"), F.lit("").alias("key"), F.col(url).alias("value")), F.struct(F.lit("html").alias("source"), F.lit("").alias("key"), h.alias("value")))
    given = [_pairs(kind, F.col(c), F.lower) for kind, c in (("header", headers), ("cookie", cookies)) if c]
    if dns:
        lists = F.transform(F.map_entries(F.coalesce(F.col(dns), F.create_map().cast("map<string,array<string>>"))), lambda e: F.transform(e["value"], lambda v: F.struct(F.lit("dns").alias("source"), F.upper(e["key"]).alias("key"), v.alias("value"))))
        given.append(F.flatten(lists))
    return pages.select(F.col(page_id).alias("page_id"), F.explode(F.concat(scripts, inline, metas, rest, *given)).alias("f")).select("page_id", "f.source", "f.key", "f.value").filter(F.col("value").isNotNull())


def compile_pattern(pattern: str) -> str:
    """The part before the modifiers without a leading wildcard, for any letter case."""
    return "(?i)" + pattern.split(r"\;")[0].removeprefix(".*").removeprefix(".+")


#: Fields of a rule: kinds of evidence with one list of patterns, and kinds with patterns by key.
_PLAIN_FIELDS = {"scriptSrc": "script", "scripts": "inline", "html": "html", "url": "url"}
_KEYED_FIELDS = {"headers": "header", "cookies": "cookie", "meta": "meta", "dns": "dns"}


def _listed(value) -> list[str]:
    return [] if value is None else [value] if isinstance(value, str) else [str(v) for v in value]


@dataclass
class RuleSet:
    """Rules as a table, and the relations between technologies, without their modifiers."""

    rules: list[tuple[str, str, str, str]] = field(default_factory=list)
    implies: list[tuple[str, str]] = field(default_factory=list)
    requires: list[tuple[str, str]] = field(default_factory=list)
    excludes: list[tuple[str, str]] = field(default_factory=list)
    categories: dict[str, list[str]] = field(default_factory=dict)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rules, "tech string, source string, key string, regex string")


def compile_rules(technologies: dict[str, dict], category_names: dict[str, dict]) -> RuleSet:
    """A fingerprint list (name to cats, scriptSrc, scripts, html, url, headers, cookies, meta, dns, implies, requires,
    excludes) as rules. A key without a pattern is met by any value; a pattern that isn't valid is left out."""
    out = RuleSet()
    for tech, spec in technologies.items():
        out.categories[tech] = [c["name"] for c in (category_names.get(str(i)) for i in spec.get("cats") or []) if c]
        found = [(kind, "", p) for name, kind in _PLAIN_FIELDS.items() for p in _listed(spec.get(name))]
        for name, kind in _KEYED_FIELDS.items():
            entries = spec.get(name)
            for key, patterns in (entries if isinstance(entries, dict) else {}).items():
                found += [(kind, key.upper() if kind == "dns" else key.lower(), p) for p in (_listed(patterns) or [""])]
        out.rules += [(tech, kind, key, compile_pattern(p)) for kind, key, p in found if _valid(compile_pattern(p))]
        for relation in ("implies", "requires", "excludes"):
            getattr(out, relation).extend((tech, x.split(r"\;")[0]) for x in _listed(spec.get(relation)))
    return out


def _valid(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def load_rules(folder: str, most_age_days: float | None = None, now: float | None = None) -> RuleSet | None:
    """The rules of a local folder of JSON files, categories.json among them; None if there are none, or if the oldest
    file is older than the days, so that they are to be fetched again."""
    files = sorted(Path(folder).glob("*.json"))
    if not files or (most_age_days is not None and (time.time() if now is None else now) - min(f.stat().st_mtime for f in files) > most_age_days * 86400):
        return None
    technologies: dict[str, dict] = {}
    for f in files:
        if f.name != "categories.json":
            technologies |= json.loads(f.read_text(encoding="utf-8"))
    names = Path(folder) / "categories.json"
    return compile_rules(technologies, json.loads(names.read_text(encoding="utf-8")) if names.exists() else {})


def detect(features: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, tech, evidence. ``rules``: tech, source, key, regex; a bounded list, broadcast and matched on source
    and key, the pattern being the residual."""
    rank = F.array_position(F.array(*[F.lit(e) for e in EVIDENCE]), F.col("source"))
    hits = features.join(F.broadcast(rules), ["source", "key"]).filter(F.expr("value rlike regex"))
    return hits.groupBy("page_id", "tech").agg(F.min_by("source", rank).alias("evidence"))


def implied_closure(implies: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """All (tech, implied) pairs of the transitive closure of a rule list."""
    out = set(implies)
    while True:
        more = {(a, d) for a, b in out for c, d in implies if b == c} - out
        if not more:
            return sorted(out)
        out |= more


def with_implications(found: DataFrame, implies: list[tuple[str, str]], requires: list[tuple[str, str]], excludes: list[tuple[str, str]]) -> DataFrame:
    """Adds implied technologies, drops those of whose requirements none is found, then those that a found one excludes."""
    spark = found.sparkSession
    table = lambda rows, cols: F.broadcast(spark.createDataFrame(rows or [("", "")], cols))
    implied = found.join(table(implied_closure(implies), "tech string, other string"), "tech").select("page_id", F.col("other").alias("tech"), F.lit("implied").alias("evidence"))
    every = found.unionByName(implied.join(found.select("page_id", "tech"), ["page_id", "tech"], "left_anti").distinct())
    needs = table(requires, "tech string, need string")
    have = every.select("page_id", F.col("tech").alias("need"))
    met = every.join(needs, "tech").join(have, ["page_id", "need"]).select("page_id", "tech").distinct()
    needing = every.join(needs.select("tech").distinct(), "tech", "left_semi")
    kept = every.join(needing.join(met, ["page_id", "tech"], "left_anti").select("page_id", "tech"), ["page_id", "tech"], "left_anti")
    victims = kept.join(table(excludes, "tech string, victim string"), "tech").select("page_id", F.col("victim").alias("tech")).distinct()
    return kept.join(victims, ["page_id", "tech"], "left_anti")


def dns_vendors(dns: DataFrame) -> DataFrame:
    """domain, vendors (sorted): ``dns`` has domain, rtype, value; of the MX rules the first that fits a record."""
    v = F.lower("value")
    txt = F.filter(F.array(*[F.when(v.contains(n), F.lit(x)) for n, x in config.TXT_VENDORS.items()]), lambda x: x.isNotNull())
    mx = None
    for needle, vendor in config.MX_VENDORS:
        mx = F.when(v.contains(needle), vendor) if mx is None else mx.when(v.contains(needle), vendor)
    found = F.when(F.col("rtype") == "TXT", txt).when((F.col("rtype") == "MX") & mx.isNotNull(), F.array(mx))
    return dns.select("domain", F.explode(found).alias("vendor")).groupBy("domain").agg(F.array_sort(F.collect_set("vendor")).alias("vendors"))
