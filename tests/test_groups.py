import math
import random

from pyspark.sql import functions as F

from civicgrid.operators import cluster, graph, ranking
from test_spatial import hav


def brute(rows, eps, least, weight):
    """Density groups by definition: rows of (id, key, lat, lon, vec)."""
    def gap(a, b):
        cosine = sum(x * y for x, y in zip(a[4], b[4])) if a[4] else 1.0
        return hav(a[2], a[3], b[2], b[3]) + weight * (1 - cosine)

    near = {a[0]: [b for b in rows if a[1] == b[1] and (a is b or gap(a, b) <= eps)] for a in rows}
    core = {i for i, n in near.items() if len(n) >= least}
    root = {}
    for start in sorted(core):
        if start in root:
            continue
        stack = [start]
        while stack:
            i = stack.pop()
            if i in root:
                continue
            root[i] = start
            stack.extend(b[0] for b in near[i] if b[0] in core and b[0] not in root)
    out = dict(root)
    for a in rows:
        if a[0] not in core:
            roots = [root[b[0]] for b in near[a[0]] if b[0] in core]
            if roots:
                out[a[0]] = min(roots)
    return out


def unit(rnd, n=4):
    v = [rnd.gauss(0, 1) for _ in range(n)]
    s = math.sqrt(sum(x * x for x in v))
    return [x / s for x in v]


def sample(seed, n=260):
    """Scattered rows, one crowded village with a third of all rows, and exact copies."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 3 == 0:
            lat, lon = 16.0, 74.0
        elif i % 7 == 0:
            lat, lon = 16.0 + rnd.choice([0.01, 0.02]), 74.03
        else:
            lat, lon = 16 + rnd.uniform(-0.5, 0.5), 74 + rnd.uniform(-0.5, 0.5)
        vec = [1.0, 0.0, 0.0, 0.0] if i % 5 == 0 else unit(rnd)
        rows.append((i, "road" if i % 2 else "water", lat, lon, vec))
    return rows


def test_density_groups_match_the_definition(spark):
    for seed in (1, 2):
        rows = sample(seed)
        df = spark.createDataFrame(rows, "id long, category string, lat double, lon double, vec array<double>")
        got = {r.id: r.cluster_id for r in cluster.demand_groups(df).collect()}
        assert got == brute(rows, 6.0, 3, 3.0)


def test_far_rows_are_never_linked_and_meaning_separates(spark):
    same, other = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, "road", 16.0, 74.0, same), (2, "road", 16.0, 74.0, same), (3, "road", 16.0, 74.03, same),
            (4, "road", 16.0, 74.045, other), (5, "road", 17.0, 74.0, same)]
    df = spark.createDataFrame(rows, "id long, category string, lat double, lon double, vec array<double>")
    got = {r.id: r.cluster_id for r in cluster.demand_groups(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1} and got == brute(rows, 6.0, 3, 3.0)
    assert 5 not in got


def test_single_linkage(spark):
    step = 1 / 111194.9
    rows = [(1, "a", 16.0, 74.0), (2, "a", 16.0 + 200 * step, 74.0), (3, "a", 16.0 + 400 * step, 74.0),
            (4, "a", 16.0 + 900 * step, 74.0), (5, "b", 16.0, 74.0)]
    df = spark.createDataFrame(rows, "id long, k string, lat double, lon double")
    got = {r.id: r.root for r in cluster.work_groups(df, "k", 250.0).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(1000, i) for i in range(900, 950)]
    nodes = spark.createDataFrame([(i,) for e in edges for i in e] + [(5000,)], "node long").distinct()
    got = {r.node: r.root for r in graph.components(nodes, spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {got[i] for i in range(1, 61)} == {1} and {got[i] for i in [1000, *range(900, 950)]} == {900}
    assert got[5000] == 5000


def test_straggler_joins_but_never_forms(spark):
    placed = spark.createDataFrame([(1, "road", 10, 16.0, 74.0)], "id long, issue_category string, group_id long, lat double, lon double")
    reports = spark.createDataFrame(
        [(1, "road", 16.0, 74.0), (2, "road", 16.05, 74.0), (3, "water", 16.05, 74.0), (4, "road", 17.0, 74.0)],
        "id long, issue_category string, lat double, lon double")
    got = {r.id: r.group_id for r in cluster.attach_stragglers(reports, placed).collect()}
    assert got == {2: 10}


def test_burst_counts_wordings_not_copies(spark):
    now = "2026-09-15 12:00:00"
    rows = [("two", f"t{i}", f"2026-09-1{i} 00:00:00") for i in range(2)]
    rows += [("copies", "same", "2026-09-15 01:00:00")] * 10
    rows += [("surge", f"old{i}", f"2026-06-{i + 10} 00:00:00") for i in range(2)]
    rows += [("surge", f"new{i}", "2026-09-15 00:00:00") for i in range(20)]
    df = spark.createDataFrame(rows, "g string, raw_text string, created_at string").withColumn(
        "created_at", F.col("created_at").cast("timestamp_ntz"))
    got = {r.g: r.burst for r in cluster.burst_ratio(df, ["g"], now).collect()}
    assert got["two"] == 0.0 and got["copies"] == 0.0 and got["surge"] > 5


def test_ranks_within_a_hot_key(spark, monkeypatch):
    parts = []
    write = ranking.checkpoint
    monkeypatch.setattr(ranking, "checkpoint", lambda d: parts.append(write(d)) or parts[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(20_000).select(
        F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(
            F.concat(F.lit("k"), F.col("id") % 97)).alias("k"),
        (F.col("id") * 7919 % 20_011).alias("v"), "id")
    got = ranking.rank_within(df, ["k"], [F.col("v").desc(), F.col("id")], "nth", "of")
    assert got.columns == ["k", "v", "id", "nth", "of"]
    rows = got.collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    held = {}
    for r in rows:
        held.setdefault(r.k, []).append((-r.v, r.id, r.nth, r.of))
    assert len(rows) == 20_000 and len(held["hot"]) == 10_000 and None in held
    for own in held.values():
        assert [(n, of) for _, _, n, of in sorted(own)] == [(n, len(own)) for n in range(1, len(own) + 1)]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(r["count"] for r in parts[0].groupBy("_part").count().collect()) < 1.5 * 20_000 / n
    assert parts[0].filter("k = 'hot'").select("_part").distinct().count() >= n // 2
    assert ranking.rank_within(df.limit(0), ["k"], [F.col("id")], "nth").count() == 0


def test_a_vector_is_held_once(spark, monkeypatch):
    held, written = [], graph.checkpoint

    def spy(df):
        held.append(written(df))
        return held[-1]

    monkeypatch.setattr(graph, "checkpoint", spy)
    rows = [(i, "road", 16.0 + i * 0.002, 74.0, [1.0, 0.0] if i % 2 else [0.6, 0.8]) for i in range(40)]
    points = spark.createDataFrame(rows, "id long, category string, lat double, lon double, vec array<double>")
    got = {r.id: r.root for r in graph.density_groups(points, ["category"], 1.0, 3, "vec", 3.0).collect()}
    assert got == brute(rows, 1.0, 3, 3.0)
    assert sum(t.count() for t in held if "vec" in t.columns) == 2


def test_neighbours_are_counted_in_blocks(spark, monkeypatch):
    from civicgrid.operators import meetings

    rows = sample(4) + [(1000, "road", 16.0, 74.0, []), (1001, "road", 16.001, 74.0, [1.0, None, 0.0, 0.0]), (1002, "road", None, 74.0, [1.0])]

    def gap(a, b):
        known = len(a[4]) == len(b[4]) and None not in (*a[4], *b[4])
        return hav(a[2], a[3], b[2], b[3]) + 3 * (1 - (sum(x * y for x, y in zip(a[4], b[4])) if known else 0.0))

    want = {}
    for a in rows[:-1]:
        gaps = [gap(a, b) for b in rows[:-1] if a[1] == b[1] and a[0] != b[0] and gap(a, b) <= 6]
        if gaps:
            want[a[0]] = (len(gaps), round(min(gaps), 6))
    points = spark.createDataFrame(rows, "id long, category string, lat double, lon double, vec array<double>")
    for left, right, at_once in ((4096, 16384, 256), (20, 30, 7)):
        monkeypatch.setattr(meetings, "LEFT_ROWS", left)
        monkeypatch.setattr(meetings, "RIGHT_ROWS", right)
        monkeypatch.setattr(meetings, "AT_ONCE", at_once)
        met = meetings.neighbour_counts(points, ["category"], 6.0, 3.0)
        assert {r.id: (r.neighbours, round(r.nearest, 6)) for r in met.collect()} == want
