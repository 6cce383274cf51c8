"""The full pass and its summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.nested import count_map
from ..functions.numeric import TERMS
from ..functions.rounding import portable_round
from ..operators import cluster
from ..operators.ranking import global_rank, with_next
from ..operators.state import checkpoint
from .assets import name_assets, resolve_assets
from .score import Registers, score_groups
from .villages import village_priorities

C = F.col


def _percent(part, whole):
    return portable_round(part * 100.0 / whole, 2)


def report_quality(reports: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return reports.agg(
        n.alias("reports"), F.count("issue_category").alias("with_category"), F.count("lat").alias("with_point"),
        F.count("village").alias("with_village"), _percent(F.count("village"), n).alias("resolved_pct"),
    ).withColumn("one", F.lit(1))


def school_quality(school_rows: DataFrame) -> DataFrame:
    teachers = F.coalesce("teachers_regular", F.lit(0)) + F.coalesce("teachers_contract", F.lit(0))
    major = F.count_if(C("classrooms_major_repair") > 0)
    return school_rows.filter(~C("fetch_failed")).agg(
        portable_round(F.avg(teachers), 2).alias("mean_teachers"),
        _percent(major, F.count(F.lit(1))).alias("major_repair_pct")).withColumn("one", F.lit(1))


def works_quality(works: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return works.groupBy("status").agg(
        n.alias("works"), F.count("place_id").alias("matched"), _percent(F.count("place_id"), n).alias("matched_pct"))


def summary(reports: DataFrame, assigned: DataFrame, scored: DataFrame) -> DataFrame:
    """One row: totals, clusters per category and the top score."""
    total = reports.agg(F.count(F.lit(1)).alias("reports_total")).withColumn("one", F.lit(1))
    done = assigned.agg(F.count(F.lit(1)).alias("reports_clustered")).withColumn("one", F.lit(1))
    per = scored.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.max("priority_score").alias("top"))
    by_category = per.agg(
        F.sum("n").alias("clusters"), count_map(C("category"), C("n")).alias("categories"),
        F.max("top").alias("top_score")).withColumn("one", F.lit(1))
    return total.join(done, "one").join(by_category, "one").drop("one")


def demand_clusters(reports: DataFrame, vectors: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Every clustered report with its group: density clusters, then stragglers near an established one.

    ``reports``: id, issue_category, lat, lon, ...; ``vectors``: id, vec.
    """
    rows = reports.select("id", C("issue_category").alias("category"), "lat", "lon").join(vectors, "id", "left")
    core = cluster.demand_groups(rows, cfg).select("id", C("cluster_id").alias("group_id"))
    placed = checkpoint(core.join(reports.select("id", "issue_category", "lat", "lon"), "id"))
    late = cluster.attach_stragglers(reports, placed, cfg)
    both = placed.select("id", "group_id").unionByName(late)
    return checkpoint(reports.join(both, "id"))


def cluster_centres(members: DataFrame) -> DataFrame:
    return members.groupBy("group_id").agg(
        F.min("issue_category").alias("category"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def rank_clusters(scored: DataFrame) -> DataFrame:
    """Global rank and the runner-up of each cluster."""
    ranked = global_rank(scored, [C("priority_score").desc(), C("group_id")])
    return with_next(ranked, "rank", "group_id", "runner_up_cluster_id")


@dataclass
class Outputs:
    members: DataFrame
    clusters: DataFrame
    work_groups: DataFrame
    assets: DataFrame
    villages: DataFrame
    summary: DataFrame


def scored_clusters(reports: DataFrame, vectors: DataFrame, r: Registers, now, cfg: Settings = DEFAULTS):
    members = demand_clusters(reports, vectors, cfg)
    return members, rank_clusters(score_groups(members, cluster_centres(members), r, now, cfg))


def recompute(reports: DataFrame, vectors: DataFrame, r: Registers, now, cfg: Settings = DEFAULTS) -> Outputs:
    """Clusters, work groups, assets and villages in fixed order; running it again gives the same tables."""
    members, clusters = scored_clusters(reports, vectors, r, now, cfg)
    clusters = checkpoint(clusters)
    roots = cluster.work_groups(members, "group_id", cfg.work_group_m, cfg)
    grouped = checkpoint(members.join(roots.select("id", "root"), "id"))
    described = cluster.describe_work_groups(grouped, "group_id").withColumn("gid", C("root"))
    groups = cluster.name_work_groups(
        described.join(clusters.select("group_id", "category"), "group_id"), "category", r.facilities,
        cluster.works_by_village(r.works, r.places, cfg), cfg)
    resolved = checkpoint(resolve_assets(reports, r.facilities, r.places, cfg))
    named = checkpoint(name_assets(resolved, r.facilities, r.places, r.works, r.segments, cfg))
    owned = resolved.join(named.select("asset_key", "asset_id"), "asset_key")
    scored = score_groups(
        owned.withColumn("group_id", C("asset_id")),
        named.select(C("asset_id").alias("group_id"), C("asset_type").alias("category"), "lat", "lon", "facility_id"),
        r, now, cfg)
    keep = ["priority_score", *TERMS, "reporters", "people", "undelivered_cost_lakh", "schemes_found",
            "undelivered_schemes", "unspent_estimate_lakh", "grade_label", "grade_confidence"]
    assets = checkpoint(named.join(scored.select(C("group_id").alias("asset_id"), *keep), "asset_id"))
    villages = village_priorities(owned, assets, r.places)
    done = summary(reports, members, clusters)
    return Outputs(members, clusters, groups, assets, villages, done)
