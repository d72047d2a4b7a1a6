"""External names resolved to companies, directories of boards, customer edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream import config
from lodestream.functions import names


def company_keys(companies: DataFrame, id_col: str, name_cols: list[str], state_col: str) -> DataFrame:
    """key, company_id, state: every key of each distinct cleaned name of a company."""
    each = companies.select(F.col(id_col).alias("company_id"), names.state_code(F.col(state_col)).alias("state"), F.explode(F.array_distinct(F.array(*[names.clean_name(F.col(c)) for c in name_cols]))).alias("cleaned"))
    return each.filter(F.col("cleaned") != "").select(F.explode(names.name_keys(F.col("cleaned"))).alias("key"), "company_id", "state").distinct()


def match_names(probes: DataFrame, keys: DataFrame, probe_id: str, name_col: str, state_col: str) -> DataFrame:
    """probe_id, company_id, score, reason of the probes that one company answers.

    The probe's first key with any company decides, even if that company is then refused: of several companies
    exactly one must share the state; one company must share it if the name is weak, and must not contradict it
    unless the name is equal. Weak names are looked up by their first two keys only. Keys are joined by hash; a key
    that very many companies share is counted in the map stage before it is judged.
    """
    p = probes.select(F.col(probe_id).alias("probe_id"), names.clean_name(F.col(name_col)).alias("cleaned"), names.state_code(F.col(state_col)).alias("probe_state")).filter(F.col("cleaned") != "")
    p = p.withColumn("weak", names.is_weak_name(F.col("cleaned")))
    asked = p.select("probe_id", "probe_state", "weak", F.posexplode(F.when(F.col("weak"), F.slice(names.name_keys(F.col("cleaned")), 1, 2)).otherwise(names.name_keys(F.col("cleaned")))).alias("pos", "key"))
    per_state = F.col("probe_state").isNotNull() & (F.col("state") == F.col("probe_state"))
    hits = (
        asked.join(keys, "key")
        .groupBy("probe_id", "probe_state", "weak", "pos")
        .agg(F.countDistinct("company_id").alias("n"), F.min("company_id").alias("one"), F.max("state").alias("one_state"), F.countDistinct(F.when(per_state, F.col("company_id"))).alias("n_state"), F.min(F.when(per_state, F.col("company_id"))).alias("state_one"))
    )
    first = hits.groupBy("probe_id").agg(F.min_by(F.struct("probe_state", "weak", "pos", "n", "one", "one_state", "n_state", "state_one"), "pos").alias("h")).select("probe_id", "h.*")
    agree = F.coalesce(F.col("one_state") == F.col("probe_state"), F.lit(False))
    clash = F.coalesce(F.col("one_state") != F.col("probe_state"), F.lit(False))
    company = F.when(F.col("n") > 1, F.when(F.col("n_state") == 1, F.col("state_one"))).when(F.col("weak"), F.when(agree, F.col("one"))).when(clash & (F.col("pos") > 0), F.lit(None)).otherwise(F.col("one"))
    reason = F.element_at(F.array(*[F.lit(x) for x in ("exact", "compact", "trimmed", "core")]), F.col("pos") + 1)
    out = first.select("probe_id", company.alias("company_id"), F.when(F.col("pos") == 0, 100).otherwise(95).alias("score"), reason.alias("reason"))
    return out.filter(F.col("company_id").isNotNull())


def directory_match(companies: DataFrame, directory: DataFrame, id_col: str, name_col: str, domain_col: str) -> DataFrame:
    """company_id, board, slug: the directory row whose slug is the domain stem, by board order; else the row whose
    name key is the company's, by board order. ``directory``: board, name, slug."""
    order = F.array_position(F.array(*[F.lit(b) for b in config.BOARD_ORDER]), F.col("board"))
    rows = directory.select("board", F.lower("slug").alias("slug"), names.directory_key(F.col("name")).alias("name_key"), order.alias("rank")).filter(F.col("rank") > 0)
    asked = companies.select(F.col(id_col).alias("company_id"), names.domain_stem(F.col(domain_col)).alias("stem"), names.directory_key(F.col(name_col)).alias("name_key"))
    best = F.min(F.struct("rank", "slug", "board")).alias("b")
    by_stem = asked.join(rows.select("board", "slug", "rank"), F.col("stem") == F.col("slug")).groupBy("company_id").agg(best).select("company_id", "b.board", "b.slug", F.lit(0).alias("way"))
    by_name = asked.filter(F.col("name_key") != "").join(rows, "name_key").groupBy("company_id").agg(best).select("company_id", "b.board", "b.slug", F.lit(1).alias("way"))
    return by_stem.unionByName(by_name).groupBy("company_id").agg(F.min(F.struct("way", "board", "slug")).alias("m")).select("company_id", "m.board", "m.slug")


def names_agree(a: DataFrame, left: str, right: str) -> DataFrame:
    """Adds ``agrees``: equal cleaned or compact names, or, where the right name isn't weak, a shared t: or k: key."""
    l, r = names.clean_name(F.col(left)), names.clean_name(F.col(right))
    loose = F.arrays_overlap(F.slice(names.name_keys(l), 3, 2), F.slice(names.name_keys(r), 3, 2))
    return a.withColumn("agrees", (l == r) | (F.regexp_replace(l, " ", "") == F.regexp_replace(r, " ", "")) | (~names.is_weak_name(r) & loose))
