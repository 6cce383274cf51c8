"""Groups of reports: demand clusters, work groups and what they are called."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.geo import haversine_km
from ..functions.rounding import portable_round
from .graph import density_groups
from .lookup import modal
from .ranking import rank_within
from .spatial import nearest_within


def reporter_key(user_id: Column, text: Column) -> Column:
    """An account is one voice; without an account equal wording is one voice."""
    worded = F.concat(F.lit("text:"), F.lower(F.trim(F.coalesce(text, F.lit("")))))
    return F.when(user_id.isNotNull(), F.concat(F.lit("account:"), user_id.cast("string"))).otherwise(worded)


def reporter_count(df: DataFrame, key: Sequence[str], name: str = "reporters") -> DataFrame:
    """Distinct reporters per group, deduplicated on a hash so long texts are not shuffled twice."""
    who = reporter_key(F.col("user_id"), F.col("raw_text"))
    return df.select(*key, F.sha2(who, 256).alias("_who")).distinct().groupBy(*key).agg(
        F.count(F.lit(1)).alias(name))


def spread(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Largest distance of a member from the group's mean point, in metres with one digit."""
    key = list(key)
    centre = df.groupBy(*key).agg(F.avg("lat").alias("_clat"), F.avg("lon").alias("_clon"))
    points = df.select(*key, "lat", "lon").distinct()
    far = F.max(haversine_km(F.col("_clat"), F.col("_clon"), F.col("lat"), F.col("lon")) * 1000.0)
    return points.join(centre, key).groupBy(*key).agg(portable_round(far, 1).alias("spread_m"))


def assign(reports: DataFrame, assignment: DataFrame) -> DataFrame:
    """Write assignments (id, ...) back to the reports; earlier ones are dropped."""
    new = [c for c in assignment.columns if c != "id"]
    return reports.drop(*new).join(assignment, "id", "left")


def attach_stragglers(reports: DataFrame, clustered: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Unclustered reports to the nearest established group of their category within the gate: ``id``, ``group_id``.

    ``clustered``: id, issue_category, group_id, lat, lon. Group centres are fixed before the pass and no group is
    formed here. Ties go to the smaller group id.
    """
    centres = clustered.groupBy("issue_category", "group_id").agg(
        F.avg("lat").alias("p_lat"), F.avg("lon").alias("p_lon"))
    loose = reports.filter(
        F.col("issue_category").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    ).join(clustered.select("id"), "id", "left_anti").select("id", "issue_category", "lat", "lon")
    # Reports share points: each distinct (category, point) looks for its group once.
    spot = ["issue_category", "lat", "lon"]
    spots = loose.select(*spot).distinct().withColumn("_spot", F.xxhash64(*spot))
    best = nearest_within(spots, centres, cfg.gate_km, "_spot", ["group_id"], on=["issue_category"])
    return loose.withColumn("_spot", F.xxhash64(*spot)).join(best.select("_spot", "group_id"), "_spot").select(
        "id", "group_id")


def works_by_village(works: DataFrame, places: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Works per village name: how many, and the first few in register order."""
    from .catchment import top_array

    named = works.filter("place_id is not null").join(
        places.select(F.col("id").alias("place_id"), F.col("name").alias("village")), "place_id")
    detail = work_detail(F.col("status"), F.col("cost_lakh"), F.col("sanction_year"))
    item = F.struct(
        F.col("work_name").alias("name"), F.col("external_id").cast("string").alias("external_id"),
        detail.alias("detail"), F.lit(None).cast("bigint").alias("distance_m"))
    firsts = top_array(named, "village", [F.col("work_id")], item, cfg.shortlist, "works")
    return named.groupBy("village").agg(F.count(F.lit(1)).alias("n_works")).join(firsts, "village")


def work_detail(status: Column, cost_lakh: Column, year: Column) -> Column:
    cost = F.when(cost_lakh != 0, F.concat(F.lit("Rs "), F.format_number(cost_lakh, 2), F.lit(" lakh")))
    since = F.when(year != 0, F.concat(F.lit("sanctioned "), year.cast("string")))
    return F.concat_ws(" · ", F.nullif(status, F.lit("")), cost, since)


def severity_profile() -> list[Column]:
    """Aggregates: share of high severity and mean known confidence (0 when none is known)."""
    high = F.when(F.lower(F.coalesce("severity", F.lit(""))) == "high", 1.0).otherwise(0.0)
    return [F.avg(high).alias("high_share"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence")]


def burst_ratio(df: DataFrame, key: Sequence[str], now: str | Column, cfg: Settings = DEFAULTS) -> DataFrame:
    """Arrival rate of the last hours over the lifetime rate, counting the first report of each wording."""
    from ..functions.dates import as_of, hours_between, since_hours

    key = list(key)
    at = as_of(now)
    who = F.sha2(F.lower(F.trim(F.coalesce("raw_text", F.lit("")))), 256).alias("_who")
    first = df.filter(F.col("created_at").isNotNull()).groupBy(*key, who).agg(F.min("created_at").alias("_t"))
    stats = first.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(since_hours(F.col("_t"), at, cfg.burst_hours)).alias("_recent"),
        F.min("_t").alias("_first"))
    life = F.greatest(hours_between(F.col("_first"), at), F.lit(cfg.burst_hours))
    ratio = (F.col("_recent") / F.lit(cfg.burst_hours)) / (F.col("_n") / life)
    return stats.select(*key, F.when(F.col("_n") < cfg.min_samples, 0.0).otherwise(ratio).alias("burst"))


def asset_location_basis() -> Column:
    """Aggregate: where an asset's point comes from, by the pins of its reports."""
    source = F.coalesce(
        F.nullif("pin_source", F.lit("")), F.when(F.col("precise_lat").isNotNull(), F.lit("citizen_gps")), F.lit(""))
    return (
        F.when(~F.bool_or(source != ""), "village_centroid").when(F.bool_and(source == "citizen_gps"), "citizen_gps_pin")
        .when(F.bool_and(source == "synthetic_seed"), "synthetic_seed").otherwise("mixed"))


def group_location_basis() -> Column:
    pinned = F.col("precise_lat").isNotNull() & F.col("precise_lon").isNotNull()
    return F.when(F.bool_and(pinned), "citizen_gps_pin").when(F.bool_or(pinned), "mixed").otherwise("village_centroid")


def sample_text() -> Column:
    """Aggregate: the longest text (the first of equals), 300 characters."""
    text = F.coalesce("raw_text", F.lit(""))
    return F.substring(F.max_by(text, F.struct(F.length(text), -F.col("id"))), 1, 300)


def demand_groups(reports: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Density clusters of (id, category, lat, lon, vec) per category: id, category, label (0, 1, ... by first core).

    Noise is left out. The gate never binds while eps is smaller, because the distance is at least the kilometres.
    """
    radius = min(cfg.eps_km, cfg.gate_km)
    rows = reports.filter(F.col("category").isNotNull())
    roots = density_groups(rows, ["category"], radius, cfg.min_samples, "vec", cfg.semantic_km)
    return roots.join(rows.select("id", "category"), "id").select("id", "category", F.col("root").alias("cluster_id"))


def number_groups(roots: DataFrame, key: Sequence[str], name: str = "label") -> DataFrame:
    """Consecutive labels of the distinct roots of each key, in root order."""
    ranked = rank_within(roots.select(*key, "root").distinct(), key, [F.col("root")], name)
    return ranked.withColumn(name, F.col(name) - 1)


def work_groups(members: DataFrame, key: str, radius_m: float, cfg: Settings = DEFAULTS) -> DataFrame:
    """Single linkage of a cluster's reports within ``radius_m``: id, key, root (the smallest member id)."""
    roots = density_groups(members.select("id", key, "lat", "lon"), [key], radius_m / 1000.0)
    return roots.join(members.select("id", key), "id").select("id", key, "root")


def describe_work_groups(members: DataFrame, cluster: str) -> DataFrame:
    """What a crew needs to know of each work group; ``members`` carry ``cluster`` and ``root``."""
    keys = [cluster, "root"]
    base = members.groupBy(*keys).agg(
        F.avg("lat").alias("centroid_lat"), F.avg("lon").alias("centroid_lon"), F.count(F.lit(1)).alias("report_count"),
        sample_text().alias("sample_text"), group_location_basis().alias("location_basis"))
    out = (
        base.join(reporter_count(members, keys, "distinct_reporters"), keys).join(spread(members, keys), keys)
        .join(modal(members, keys, "village", "id"), keys, "left").join(modal(members, keys, "block", "id"), keys, "left"))
    return out.withColumn("label", F.coalesce("village", "block", F.lit("Unnamed location")))


def name_work_groups(groups: DataFrame, category: str, facilities: DataFrame, named_works: DataFrame,
                     cfg: Settings = DEFAULTS) -> DataFrame:
    """A group takes a name only when one asset is possible; otherwise a shortlist goes with it.

    ``groups``: a key column ``gid``, ``category`` named by the argument, centroid_lat, centroid_lon, village.
    ``named_works``: ``works_by_village``.
    """
    from .catchment import top_array
    from .spatial import radius_join

    roads = groups.filter(F.col(category) == "road").select("gid", "village").join(named_works, "village").select(
        "gid", F.col("n_works").alias("n"), F.col("works").alias("candidates"),
        F.when(F.col("n_works") == 1, F.lit("pmgsy")).alias("asset_source"))
    # groups are few beside the facilities, so the groups are the side that goes into several cells
    near = radius_join(
        facilities.select("id", "name", "external_id", "source", "category", "sub_type", "management", "p_lat", "p_lon"),
        groups.filter(F.col(category) != "road").select(
            "gid", F.col(category).alias("category"), F.col("centroid_lat").alias("lat"),
            F.col("centroid_lon").alias("lon")),
        cfg.school_radius_m / 1000.0, on=["category"], left_point=("p_lat", "p_lon"), right_point=("lat", "lon"))
    item = F.struct(
        "name", "external_id", F.concat_ws(" · ", F.nullif("sub_type", F.lit("")), F.nullif("management", F.lit(""))).alias("detail"),
        F.floor(F.col("km") * 1000.0 + 0.5).cast("bigint").alias("distance_m"))
    lists = top_array(near, "gid", [F.col("km"), F.col("id")], item, cfg.shortlist, "candidates")
    counts = near.groupBy("gid").agg(F.count(F.lit(1)).alias("n"), F.min("source").alias("_source"))
    others = lists.join(counts, "gid").select(
        "gid", "n", "candidates", F.when(F.col("n") == 1, F.col("_source")).alias("asset_source"))
    found = roads.unionByName(others)
    single = F.when(F.col("n") == 1, F.try_element_at("candidates", F.lit(1)))
    return groups.join(found, "gid", "left").withColumns({
        "asset_label": single["name"], "asset_external_id": single["external_id"]}).drop("n")


def numbered_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """``shown``: the name, with ``#2``, ``#3`` ... from its second use on."""
    return rank_within(df, [name], [F.col(order)], "_n").withColumn(
        "shown", F.when(F.col("_n") == 1, F.col(name)).otherwise(
            F.concat(F.col(name), F.lit(" #"), F.col("_n").cast("string")))).drop("_n")


def first_seen(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """The first report of every wording in each group, by time and then id."""
    who = F.sha2(F.lower(F.trim(F.coalesce("raw_text", F.lit("")))), 256).alias("who")
    return df.groupBy(*key, who).agg(
        F.min_by(F.struct("id", "created_at"), F.struct("created_at", "id")).alias("_f")).select(*key, "_f.*")
