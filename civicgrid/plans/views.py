"""Read views over the outputs of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULTS, Settings
from ..functions.geo import haversine_km, public_coordinate
from ..functions.numeric import TERMS
from ..operators.lookup import latest_by
from ..operators.ranking import global_rank, quantile, rank_within, with_next
from ..operators.spatial import radius_join
from ..operators.state import checkpoint

C = F.col


def latest_scores(scores: DataFrame) -> DataFrame:
    """The score row with the highest id of every cluster."""
    return latest_by(scores, ["cluster_id"], ["score_id"])


def district_rollup(clusters: DataFrame) -> DataFrame:
    """Clusters and people per district, with the number of districts."""
    per = clusters.groupBy("district").agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("population_affected").alias("people"))
    total = per.agg(F.count("district").alias("districts")).withColumn("one", F.lit(1))
    return per.withColumn("one", F.lit(1)).join(total, "one").drop("one")


def scale_anchors(clusters: DataFrame) -> DataFrame:
    """Anchors of the colour scale and of the bubble radius."""
    ends = clusters.agg(
        F.min("priority_score").alias("low"), F.max("priority_score").alias("high"),
        F.max("population_affected").alias("max_people")).withColumn("_one", F.lit(1))
    upper = quantile(clusters, C("priority_score"), 0.6, "upper").withColumn("_one", F.lit(1))
    return ends.join(upper, "_one").select("low", "upper", "high", "max_people")


def budget_answer(items: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Choice per scenario for an amount in crore (100 lakh), with the bound no choice can beat."""
    from .budget import allocate, totals, upper_bound

    s = scenarios.withColumn("budget_lakh", C("budget_crore") * 100.0)
    return totals(allocate(items, s), s).join(upper_bound(items, s), "scenario", "left")


def ranked(scores: DataFrame) -> DataFrame:
    """Rank and out-of count over all scored clusters."""
    out = global_rank(scores, [C("priority_score").desc(), C("cluster_id")])
    total = scores.agg(F.count(F.lit(1)).alias("ranked_out_of")).withColumn("_one", F.lit(1))
    return out.withColumn("_one", F.lit(1)).join(total, "_one").drop("_one")


def cluster_list(clusters: DataFrame, scores: DataFrame) -> DataFrame:
    """Clusters with their latest score, best first, unscored last, and the next cluster down."""
    last = latest_scores(scores)
    t = clusters.join(last, "cluster_id", "left")
    t = global_rank(t, [C("priority_score").desc_nulls_last(), C("cluster_id")], "position")
    t = with_next(t, "position", "cluster_id", "runner_up_cluster_id")
    return t.withColumn(
        "runner_up_cluster_id", F.when(C("priority_score").isNotNull(), C("runner_up_cluster_id")))


def report_status(reports: DataFrame, ranks: DataFrame) -> DataFrame:
    """unresolved / awaiting_corroboration / clustered, with the rank of the cluster."""
    r = ranks.select("cluster_id", "rank", "ranked_out_of", "priority_score")
    t = reports.join(r, "cluster_id", "left")
    status = (
        F.when(C("village").isNull(), "unresolved").when(C("rank").isNull(), "awaiting_corroboration")
        .otherwise("clustered"))
    return t.withColumn("status", status).withColumns({
        c: F.when(C("status") == "clustered", C(c)) for c in ("rank", "ranked_out_of", "priority_score")})


def own_reports(reports: DataFrame, ranks: DataFrame, attachments: DataFrame) -> DataFrame:
    """A signed-in reporter's reports, newest first by position, with status, rank and attachments.

    Keyed by report throughout: a busy account is never one task.
    """
    n = attachments.groupBy(C("report_id").alias("id")).agg(F.count(F.lit(1)).alias("attachments_count"))
    t = report_status(reports.filter("user_id is not null"), ranks).join(n, "id", "left")
    return t.withColumn("attachments_count", F.coalesce("attachments_count", F.lit(0)))


def cluster_reports(reports: DataFrame, children: DataFrame, limit: int = 200) -> DataFrame:
    """Newest reports of every cluster with totals over all of them. Identity columns are never read.

    ``children``: id, photos. The page is cut before the shuffle.
    """
    from ..operators.cluster import reporter_count

    in_cluster = reports.filter("cluster_id is not null")
    totals = in_cluster.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("report_count")).join(
        reporter_count(in_cluster, ["cluster_id"], "distinct_texts"), "cluster_id")
    w = Window.partitionBy("cluster_id").orderBy(C("created_at").desc(), C("id").desc())
    page = in_cluster.withColumn("position", F.row_number().over(w)).filter(C("position") <= limit)
    return page.join(totals, "cluster_id").join(children, "id", "left")


def cluster_detail(clusters: DataFrame, work_groups: DataFrame) -> DataFrame:
    """Clusters with their work groups, most reports first, as one nested column."""
    item = F.struct(
        (-C("report_count")).alias("_o"), C("root"), C("label"), C("report_count"), C("distinct_reporters"), C("spread_m"),
        C("asset_label"), C("asset_source"), C("asset_external_id"), C("candidates"))
    nested = work_groups.groupBy("cluster_id").agg(F.array_sort(F.collect_list(item)).alias("work_groups"))
    return clusters.join(nested, "cluster_id", "left")


def geojson_features(df: DataFrame, lat: str, lon: str, properties: list[str]) -> DataFrame:
    """One GeoJSON feature text per row; rows without a point are left out."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(C(lon), C(lat)).alias("coordinates")).alias("geometry"),
        F.struct(*properties).alias("properties"))
    return df.filter(C(lat).isNotNull() & C(lon).isNotNull()).select(
        *properties, F.to_json(feature).alias("feature"))


def village_list(villages: DataFrame, assets: DataFrame) -> DataFrame:
    """Ranked villages with the names of their top and most urgent asset."""
    a = assets.select(C("asset_id"), C("name"), C("asset_type"), C("priority_score"))
    top = a.select(C("asset_id").alias("top_asset_id"), C("name").alias("top_name"), C("asset_type").alias("top_type"),
                   C("priority_score").alias("top_score"))
    urgent = a.select(C("asset_id").alias("urgent_asset_id"), C("name").alias("urgent_name"),
                      C("asset_type").alias("urgent_type"))
    return villages.join(top, "top_asset_id", "left").join(urgent, "urgent_asset_id", "left").withColumn(
        "has_urgent_asset", C("urgent_asset_id").isNotNull())


def asset_rank(owned: DataFrame, assets: DataFrame) -> DataFrame:
    """Rank of every asset inside every village that reports it: best score first, then the smaller id."""
    pairs = owned.filter("place_id is not null and asset_id is not null").select("place_id", "asset_id").distinct()
    return rank_within(
        pairs.join(assets, "asset_id"), ["place_id"], [C("priority_score").desc(), C("asset_id")], "rank_in_village")


def village_detail(owned: DataFrame, assets: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Assets of every village with public coordinates and the reports of that village behind each."""
    n = owned.filter("place_id is not null and asset_id is not null").groupBy("place_id", "asset_id").agg(
        F.count(F.lit(1)).alias("village_reports"))
    t = asset_rank(owned, assets).join(n, ["place_id", "asset_id"])
    return t.withColumns({
        "lat": public_coordinate(C("lat"), C("location_basis"), cfg),
        "lon": public_coordinate(C("lon"), C("location_basis"), cfg)})


def _once_and_again(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Distinct rows whose key stands once, and those whose key, unknown ones included, stands more often."""
    rows = checkpoint(rows.distinct())
    often = rows.groupBy(C(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    same = C(key).eqNullSafe(C("_key"))
    return rows.join(often, same, "left_anti"), rows.join(often, same, "left_semi")


def candidate_facilities(places: DataFrame, facilities: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Facilities to offer for each place: schools of the same village name or within reach, health facilities within
    reach; place_id, facility_id, distance_m. Name matches and distance matches are two joins united, not one OR.

    The pairs are many times the registers, so they are not shuffled: the join by name leaves out what the join by distance finds,
    and only pairs of an id that a register holds more than once are looked through for repeats.
    """
    p = places.select(C("id").alias("place_id"), C("name").alias("v_name"), "lat", "lon")
    f = facilities.select(
        C("id").alias("facility_id"), C("name").alias("f_name"), C("category").alias("f_category"), "sub_type",
        C("village").alias("f_village"), "p_lat", "p_lon")
    (p_once, p_again), (f_once, f_again) = _once_and_again(p, "place_id"), _once_and_again(f, "facility_id")
    cols = ["place_id", "facility_id", "f_name", "f_category", "sub_type", "km"]
    school_near = (C("km") <= cfg.health_nearest_km) & (C("km") * 1000.0 <= cfg.school_radius_m)

    def pairs(p: DataFrame, f: DataFrame) -> DataFrame:
        by_km = radius_join(p, f, cfg.health_nearest_km).filter((C("f_category") == "health") | school_near)
        by_name = (
            p.withColumn("_v", F.lower(F.trim("v_name"))).join(
                f.filter("f_category = 'education'").withColumn("_v", F.lower(F.trim("f_village"))), "_v")
            .withColumn("km", haversine_km(C("lat"), C("lon"), C("p_lat"), C("p_lon"))).drop("_v"))
        return by_km.select(*cols).unionByName(by_name.filter(~F.coalesce(school_near, F.lit(False))).select(*cols))

    both = pairs(p_once, f_once)
    if not (p_again.isEmpty() and f_again.isEmpty()):
        again = pairs(p_again, f_once.unionByName(f_again)).unionByName(pairs(p_once, f_again))
        both = both.unionByName(again.dropDuplicates(["place_id", "facility_id"]))
    return both.withColumn("distance_m", F.floor(C("km") * 1000.0 + 0.5).cast("bigint"))


def photo_public(checked: DataFrame) -> DataFrame:
    """What may leave: no coordinates, no hashes."""
    return checked.drop("capture_lat", "capture_lon", "exif_lat", "exif_lon", "village_lat", "village_lon", "ph", "dh")


def scoped_ranking(clusters: DataFrame, category: str | None = None, district: str | None = None) -> DataFrame:
    t = clusters
    if category is not None:
        t = t.filter(C("issue_category") == category)
    if district is not None:
        t = t.filter(F.lower("district") == district.lower())
    return t.orderBy(C("priority_score").desc_nulls_last(), "cluster_id")


def term_lead(clusters: DataFrame, pairs: DataFrame, least: float = 0.3, n: int = 3) -> DataFrame:
    """Terms by which a cluster leads another: pairs (cluster_id, other_id) to their ``n`` largest leads over ``least``."""
    long = clusters.unpivot(["cluster_id"], list(TERMS), "term", "points")
    other = long.select(C("cluster_id").alias("other_id"), "term", C("points").alias("other_points"))
    lead = pairs.join(long, "cluster_id").join(other, ["other_id", "term"]).withColumn(
        "lead", F.coalesce("points", F.lit(0.0)) - F.coalesce("other_points", F.lit(0.0))).filter(C("lead") > least)
    w = Window.partitionBy("cluster_id", "other_id").orderBy(C("lead").desc(), "term")
    return lead.withColumn("nth", F.row_number().over(w)).filter(C("nth") <= n)


def compare(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """Picked pairs: the higher score wins; ``need_over_volume`` when the other has more reports."""
    a = clusters.select(C("cluster_id").alias("a"), C("priority_score").alias("a_score"), C("report_count").alias("a_n"))
    b = clusters.select(C("cluster_id").alias("b"), C("priority_score").alias("b_score"), C("report_count").alias("b_n"))
    t = pairs.join(a, "a").join(b, "b")
    first = C("a_score") >= C("b_score")
    busier = F.when(first, C("b_n") > C("a_n")).otherwise(C("a_n") > C("b_n"))
    return t.select(F.when(first, C("a")).otherwise(C("b")).alias("cluster_id"),
                    F.when(first, C("b")).otherwise(C("a")).alias("other_id"), busier.alias("need_over_volume"))


def ordered_within(df: DataFrame, key: str, order: list) -> DataFrame:
    """Position of every row inside its key."""
    return rank_within(df, [key], [C(o) if isinstance(o, str) else o for o in order], "position")


def village_picker(places: DataFrame, needle: str, limit: int) -> DataFrame:
    """First villages by name whose name contains the typed letters."""
    from ..functions.text import name_contains

    return places.filter(name_contains(C("name"), needle)).orderBy("name", "id").limit(limit)
