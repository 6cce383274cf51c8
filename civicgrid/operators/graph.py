"""Connected components and exact density groups over tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from .spatial import KM_PER_DEGREE, _cover, _point_cell, _reach, radius_join
from .state import checkpoint


def components(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """``node``, ``root``: the smallest node of its connected component.

    Every round points a node at its smallest neighbour, follows the pointers twice, and contracts the edges to the
    roots reached. Contracted edges are deduplicated, so the table shrinks each round and a hub costs one row per
    neighbour at most. The pointers of all rounds are followed once at the end.
    """
    live = edges.select("src", "dst").filter("src <> dst")
    live = checkpoint(live.unionByName(live.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    steps = []
    while not live.isEmpty():
        up = live.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("up"))
        for _ in range(2):
            jump = up.select(F.col("src").alias("up"), F.col("up").alias("_next"))
            up = up.join(jump, "up", "left").select("src", F.coalesce("_next", "up").alias("up"))
        up = checkpoint(up)
        steps.append(up)
        a = up.select("src", F.col("up").alias("a"))
        b = up.select(F.col("src").alias("dst"), F.col("up").alias("b"))
        live = checkpoint(
            live.join(a, "src").join(b, "dst").filter("a <> b")
            .select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
    roots = nodes.select(F.col(node), F.col(node).alias("root"))
    for up in steps:
        roots = roots.join(up.withColumnRenamed("src", "root"), "root", "left").select(
            node, F.coalesce("up", "root").alias("root"))
    return checkpoint(roots) if steps else roots


def dot(u: Column, v: Column) -> Column:
    """Inner product of two ``array<double>``; vectors of different length have none and count as zero."""
    return F.coalesce(F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), F.lit(0.0))


def unit_vector(v: Column) -> Column:
    """L2-normalised; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    safe = F.when(norm == 0, 1.0).otherwise(norm)
    return F.transform(v, lambda x: x.cast("double") / safe)


def pair_distance(km: Column, u: Column | None, v: Column | None, semantic_km: float) -> Column:
    if u is None:
        return km
    return km + F.lit(semantic_km) * (F.lit(1.0) - dot(u, v))


# Probe points per cell, and cells per eps. They change the cost only.
PROBES = 1
PROBE_CELLS = 3


def density_groups(
    points: DataFrame,
    key: Sequence[str],
    eps_km: float,
    min_samples: int = 1,
    vector: str | None = None,
    semantic_km: float = 0.0,
) -> DataFrame:
    """Exact density grouping of (id, *key, lat, lon[, vector]) inside each key: ``id``, ``root``.

    Two rows are neighbours when km + semantic_km * (1 - cosine) <= eps_km; a row with at least ``min_samples``
    neighbours (itself included) is a core row; ``root`` is the smallest core id reachable over core rows. A row that is
    no core takes the smallest root among its core neighbours; rows without one are left out. With ``min_samples`` 1
    this is single linkage.

    Work stays near the number of rows even where one village holds most of them:
    1. equal (key, point, vector) rows become one weighted point, with a number in place of its vector;
    2. each point is compared with a few probe points per small cell, which proves most points of a crowd to be core
       and links them; 3. only points still unproven count all their neighbours; 4. cells are compared point by point
       only between components that are still apart.
    Steps 3 and 4 are complete, so the probes change the cost and never the result.
    """
    key = list(key)
    vec = [vector] if vector else []
    mark = ["_mark"] if vector else []
    same = [*key, "lat", "lon", *mark]
    rows = points.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    vectors = None
    if vector:
        # Rows carry a number; a vector is held once and joined to a point only where distances run.
        value = F.coalesce(F.col(vector), F.array().cast("array<double>")).cast("array<double>")
        rows = rows.withColumn(vector, value)
        vectors = checkpoint(rows.groupBy(vector).agg(F.min("id").alias("_mark")))
        rows = rows.join(vectors, vector)
    rows = checkpoint(rows.select("id", *same))
    pts = checkpoint(rows.groupBy(*same).agg(F.min("id").alias("pid"), F.count(F.lit(1)).alias("w")))

    def whole(df: DataFrame) -> DataFrame:
        return df.join(vectors, "_mark").drop("_mark") if vector else df

    def other(df: DataFrame, *extra: str) -> DataFrame:
        named = [F.col("pid").alias("q_pid"), F.col("w").alias("q_w"), F.col("lat").alias("p_lat"),
                 F.col("lon").alias("p_lon"), *[F.col(v).alias("q_vec") for v in vec],
                 *[F.col(e).alias("q_" + e) for e in extra]]
        return whole(df).select(*key, *named)

    def neighbours(left: DataFrame, right: DataFrame, radius: float = eps_km) -> DataFrame:
        pairs = radius_join(whole(left), right, radius, on=key).filter("pid <> q_pid")
        gap = pair_distance(F.col("km"), F.col(vector) if vec else None, F.col("q_vec") if vec else None, semantic_km)
        # The optimizer may test the filters of a join in any order; the case keeps vectors out of far pairs.
        return pairs.filter(F.when(F.col("km") <= radius, gap <= eps_km)).drop("q_vec", *vec)

    def around(df: DataFrame, few: DataFrame) -> DataFrame:
        """The points of ``df`` in cells within reach of ``few``, which are left after most points are settled."""
        height = eps_km / KM_PER_DEGREE
        up, side = _reach(F.col("lat"), eps_km)
        cells = _cover(few.select(*key, "lat", "lon"), F.col("lat") - up, F.col("lat") + up, F.col("lon") - side,
                       F.col("lon") + side, height).select(*key, "_cy", "_cx").distinct()
        filed = df.select("*", *_point_cell(F.col("lat"), F.col("lon"), height))
        return filed.join(cells, [*key, "_cy", "_cx"], "left_semi").drop("_cy", "_cx")

    # 2. probes: the points with the smallest hashes of each cell
    step = eps_km / PROBE_CELLS / KM_PER_DEGREE
    cell = [F.floor(F.col("lat") / step).alias("_py"), F.floor(F.col("lon") / step).alias("_px")]
    picks = pts.select(*key, "pid", *cell).groupBy(*key, "_py", "_px").agg(
        *[F.min_by("pid", F.xxhash64("pid", F.lit(i))).alias(f"_s{i}") for i in range(PROBES)])
    chosen = picks.select(F.explode(F.array(*[f"_s{i}" for i in range(PROBES)])).alias("pid")).distinct()
    probes = checkpoint(pts.join(chosen, "pid"))
    near = checkpoint(neighbours(pts, other(probes)).select("pid", "q_pid", "q_w"))
    known = near.groupBy("pid").agg(F.sum("q_w").alias("_n"))
    proven = pts.join(known, "pid", "left").withColumn(
        "_core", F.col("w") + F.coalesce("_n", F.lit(0)) >= min_samples)

    # 3. full count for the rest
    proven = checkpoint(proven.drop("_n"))
    unproven = proven.filter(~F.col("_core")).drop("_core")
    full = neighbours(unproven, other(around(pts, unproven))).groupBy("pid").agg(F.sum("q_w").alias("_n"))
    late = unproven.join(full, "pid").filter(F.col("w") + F.col("_n") >= min_samples).select("pid")
    core_ids = checkpoint(proven.filter("_core").select("pid").unionByName(late))
    core = pts.join(core_ids, "pid")

    # 4. components over probe links, then over whatever still lies apart
    links = (
        near.join(core_ids, "pid").join(core_ids.withColumnRenamed("pid", "q_pid"), "q_pid")
        .select(F.col("pid").alias("src"), F.col("q_pid").alias("dst")))
    rough = components(core_ids, links, "pid")
    placed = checkpoint(core.join(rough, "pid"))
    height = eps_km / KM_PER_DEGREE
    filed = placed.select("*", *_point_cell(F.col("lat"), F.col("lon"), height))
    open_pairs = checkpoint(_cells_apart(filed, key, eps_km, height))
    # Only the rows of open cells take part.
    here, there = [*key, "_cy", "_cx", "root"], [*key, "q__cy", "q__cx", "q_root"]
    lhs = whole(filed.join(open_pairs, here)).drop("_cy", "_cx")
    sought = open_pairs.select(*key, *[F.col("q_" + c).alias(c) for c in ("_cy", "_cx", "root")]).distinct()
    rhs = other(filed.join(sought, here, "left_semi"), "_cy", "_cx", "root")
    cross = lhs.join(rhs, there)
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon"))
    gap = pair_distance(km, F.col(vector) if vec else None, F.col("q_vec") if vec else None, semantic_km)
    bridges = cross.filter(F.when(km <= eps_km, gap <= eps_km)).select(
        F.col("root").alias("src"), F.col("q_root").alias("dst")).distinct()
    joined = components(placed.select(F.col("root").alias("node")).distinct(), bridges, "node")
    final = checkpoint(
        placed.select("pid", F.col("root").alias("node")).join(joined, "node").select("pid", "root"))

    # rows at the rim of a group
    rim_rows = pts.join(core_ids, "pid", "left_anti")
    rim_rows = checkpoint(rim_rows)
    rim = neighbours(rim_rows, other(around(core.join(final, "pid"), rim_rows), "root")).groupBy("pid").agg(
        F.min("q_root").alias("root"))
    labels = final.unionByName(rim)
    return rows.join(pts.join(labels, "pid").select(*same, "root"), same).select("id", "root")


def _cells_apart(filed: DataFrame, key: list[str], eps_km: float, height: float) -> DataFrame:
    """Pairs of (cell, component) close enough for a link but of different components, each pair once."""
    held = filed.groupBy(*key, "_cy", "_cx", "root").agg(
        F.min("lat").alias("_s"), F.max("lat").alias("_n"), F.min("lon").alias("_w"), F.max("lon").alias("_e"))
    far = held.select(*key, *[F.col(c).alias("q_" + c) for c in ("_cy", "_cx", "root", "_s", "_n", "_w", "_e")])
    up, side = _reach(F.greatest(F.abs("q__s"), F.abs("q__n")), eps_km)
    south, north = F.col("q__s") - up, F.col("q__n") + up
    west, east = F.col("q__w") - side, F.col("q__e") + side
    pairs = held.join(_cover(far, south, north, west, east, height), [*key, "_cy", "_cx"])
    touching = (F.col("_s") <= north) & (F.col("_n") >= south) & (F.col("_w") <= east) & (F.col("_e") >= west)
    return pairs.filter((F.col("root") < F.col("q_root")) & touching).select(
        *key, "_cy", "_cx", "root", "q__cy", "q__cx", "q_root")
