"""Typed edges: building, upsert, resolution of customers, walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions import names
from lodestream.operators.merge import keyed_merge

KEY = ("src_type", "src_id", "edge_type", "dst_type", "dst_id")


def edges_from_list(df: DataFrame, src: str, items: str, edge_type: str, dst_type: str, most: int, least_length: int = 1) -> DataFrame:
    """Edges to the slugs of an array column's first items, each once; slugs shorter than the least are dropped."""
    each = df.select(F.col(src).alias("src_id"), F.explode(F.slice(F.coalesce(F.col(items), F.array().cast("array<string>")), 1, most)).alias("display"))
    slug = names.entity_slug(F.col("display"))
    return each.select(F.lit("company").alias("src_type"), "src_id", F.lit(edge_type).alias("edge_type"), F.lit(dst_type).alias("dst_type"), slug.alias("dst_id"), "display").filter(F.length("dst_id") >= least_length).groupBy(*KEY).agg(F.min("display").alias("display"))


def job_change_edges(df: DataFrame, person: str, new_company: str, old_company: str) -> DataFrame:
    slug = names.entity_slug(F.col(person))
    base = df.filter(F.length(slug) >= 3)
    edge = lambda kind, c: base.filter(F.col(c).isNotNull()).select(F.lit("person").alias("src_type"), slug.alias("src_id"), F.lit(kind).alias("edge_type"), F.lit("company").alias("dst_type"), F.col(c).alias("dst_id"))
    left = base.filter(~F.col(old_company).eqNullSafe(F.col(new_company)))
    return edge("works_at", new_company).unionByName(left.filter(F.col(old_company).isNotNull()).select(F.lit("person").alias("src_type"), slug.alias("src_id"), F.lit("left_company").alias("edge_type"), F.lit("company").alias("dst_type"), F.col(old_company).alias("dst_id"))).distinct()


def upsert_edges(state: DataFrame, batch: DataFrame) -> DataFrame:
    """last_seen moves on, an unresolved target is filled, all else of the first insert is kept."""
    return keyed_merge(state, batch, KEY, {"dst_company_id": "fill_null", "source": "keep_old", "observed_at": "keep_old", "last_seen_at": "greatest"})


def resolve_customers(edges: DataFrame, by_domain: DataFrame, by_name: DataFrame) -> DataFrame:
    """src_id, dst_id, dst_company_id, how: the domain decides, else the name; an edge to itself is dropped.
    ``edges``: src_id, dst_id, domain; ``by_domain``: domain, company_id; ``by_name``: dst_id, company_id."""
    d = by_domain.groupBy(F.lower("domain").alias("_domain")).agg(F.min("company_id").alias("_d"))
    n = by_name.groupBy("dst_id").agg(F.min("company_id").alias("_n"), F.count(F.lit(1)).alias("_k")).filter(F.col("_k") == 1).drop("_k")
    joined = edges.join(d, F.lower("domain") == F.col("_domain"), "left").join(n, "dst_id", "left")
    target = F.coalesce("_d", "_n")
    return joined.filter(target.isNotNull() & (target != F.col("src_id"))).select("src_id", "dst_id", target.alias("dst_company_id"), F.when(F.col("_d").isNotNull(), "domain").otherwise("name").alias("how"))


def hops(edges: DataFrame, n: int) -> DataFrame:
    """start, end, n_hops: distinct ends of walks of up to n edges; each round joins the frontier only."""
    step = edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d")).distinct()
    frontier = step.select(F.col("_s").alias("start"), F.col("_d").alias("end"))
    reached = frontier.withColumn("n_hops", F.lit(1))
    for i in range(2, n + 1):
        frontier = frontier.join(step, F.col("end") == F.col("_s")).select("start", F.col("_d").alias("end")).distinct()
        frontier = frontier.join(reached.select("start", "end"), ["start", "end"], "left_anti")
        reached = reached.unionByName(frontier.withColumn("n_hops", F.lit(i)))
    return reached
