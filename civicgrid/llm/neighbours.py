"""Nearest neighbours by inner product: shifted Hilbert curves whose windows follow measured recall.

* Every curve projects the vectors at random to a few dimensions, maps each to (0, 1) by the normal distribution, shifts the
  result and reads it as a place on a Hilbert curve. Rows are range-partitioned by (curve, range of norms, place) and numbered.
* The order of a curve is cut into blocks. A query looks at its own block and the ``SIDE`` blocks on either side, in every
  curve and range; the block's best rows by the exact inner product are merged over all of them and ranked again.
* Largest inner product is turned into smallest angle first: stored vectors get one more component that gives all of a range
  the same length, queries get a zero there. Ranges are octaves of the norm, at most ``RANGES`` after the thinnest are merged,
  each with a longest vector of its own, so a few long vectors do not press all others together.
* The size of a block follows the data: the lists of ``PROBES`` queries are found by brute force, and the smallest block (by
  doubling from ``BLOCK`` to ``LARGEST``) whose windows hold ``RECALL`` of them is taken; if none does, the largest. This is the path at
  every size. ``exact=True`` asks for the lists of all rows instead: every query meets every row, block by block.
* Equal vectors are one entry with the ids it stands for, so ties and crowds of equal vectors are exact.

A block is bounded, however crowded a region is. See the README for measured figures. Vectors that are null, zero, or hold null
or non-finite components take no part; vectors are compared with those of equal length only. Rows that repeat both id and
vector are one; an id with several vectors keeps the smallest vector. An empty table gives an empty result. Only id and vector
are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ranking import global_rank
from ..operators.state import checkpoint

C = F.col
CURVES, DIMENSIONS, BITS = 24, 6, 10
BLOCK, SIDE, LARGEST = 16, 1, 1 << 16
# Recall that the windows must show on so many queries; ranges of norms.
RECALL, PROBES, RANGES = 0.96, 100, 8
# Exact pass: least number of row blocks, rows of a block, queries that meet a block at once.
CELLS, CELL_ROWS, CELL_QUERIES = 64, 1 << 16, 1 << 14
# Bound of memory: inner products held at once.
HELD = 1 << 22
_ERF = np.vectorize(math.erf, otypes=[float])


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id``, ``v``: ids and vectors that take part, in double precision."""
    v = F.transform(C(vector), lambda x: x.cast("double"))
    df = df.select(C(key).cast("bigint").alias("id"), v.alias("v")).filter(C("id").isNotNull() & (F.size("v") > 0))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return df.filter(~bad & F.exists("v", lambda x: x != 0)).groupBy("id").agg(F.min("v").alias("v"))


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer cells (row, dimension), by the transpose form of the curve."""
    x = [c.copy() for c in cells.astype(np.int64).T]
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(len(x)):
            up = (x[i] & q) > 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn = np.where((x[-1] & q) > 0, turn ^ (q - 1), turn)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(len(x)):
            out = (out << 1) | (((x[i] ^ turn) >> b) & 1)
    return out


def places(v: np.ndarray, curve: int, dimensions: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """Places of unit vectors on one shifted curve."""
    rng = np.random.default_rng([curve, v.shape[1]])
    way = rng.standard_normal((v.shape[1], dimensions))
    share = 0.5 * (1 + _ERF(v @ way / math.sqrt(2)))
    return hilbert(np.floor((0.5 * share + 0.5 * rng.random(dimensions)) * ((1 << bits) - 1)), bits)


def _matrix(column: pa.Array, at: np.ndarray, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)  # single precision where the table holds that
    offsets = column.offsets.to_numpy()[:-1] - column.offsets[0].as_py()
    return flat[offsets[at][:, None] + np.arange(width)].astype(np.float64, copy=False)


def norm_ranges(octaves: dict[int, tuple[int, float]], most: int = RANGES) -> list[tuple[int, float]]:
    """(last octave, longest norm) of every range, from the number of rows and the longest norm of each octave.

    While there are too many, the range with the fewest rows joins the next longer one.
    """
    out = [(o, n, top) for o, (n, top) in sorted(octaves.items())]
    while len(out) > most:
        i = min(range(len(out) - 1), key=lambda k: out[k][1])
        (_, n, _), (o, m, top) = out[i:i + 2]
        out[i:i + 2] = [(o, n + m, top)]
    return [(o, top) for o, _, top in out]


def _keys(vectors: DataFrame, ranges: list[tuple[int, float]], curves: int) -> DataFrame:
    """``curve``, ``band``, ``place``, ``width``, ``id``, ``asks`` for stored vectors, and again in every range for those that ask."""
    last, longest = np.array([o for o, _ in ranges]), np.array([top for _, top in ranges])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            width = b.column(2).to_numpy()
            asks = b.column(3).to_numpy(zero_copy_only=False)
            octave = b.column(4).to_numpy()
            for d in np.unique(width):
                at = np.flatnonzero(width == d)
                v = _matrix(b.column(1), at, d)
                size = np.sqrt((v * v).sum(axis=1))
                band = np.searchsorted(last, octave[at])
                rest = np.sqrt(np.maximum(0, 1 - (size / longest[band]) ** 2))
                q = at[asks[at]]
                unit = np.concatenate([v[asks[at]] / size[asks[at], None], np.zeros((len(q), 1))], axis=1)
                stored = np.concatenate([v / longest[band][:, None], rest[:, None]], axis=1)
                scale = math.sqrt(d + 1)
                for points, rows, bands, flag in ((stored, at, [band], False),
                                                  (unit, q, [np.full(len(q), k) for k in range(len(ranges))], True)):
                    if not len(rows):
                        continue
                    for c in range(curves):
                        place = pa.array(places(points * scale / math.sqrt(d), c))
                        for k in bands:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(rows), c, np.int32)), pa.array(k.astype(np.int32)), place,
                                 pa.array(np.full(len(rows), d, np.int32)), b.column(0).take(pa.array(rows)),
                                 pa.array(np.full(len(rows), flag))],
                                names=["curve", "band", "place", "width", "id", "asks"])

    rows = vectors.select("id", "v", F.size("v").alias("width"), "asks", "octave")
    return rows.mapInArrow(run, "curve int, band int, place bigint, width int, id bigint, asks boolean")


def _best(table: pa.Table, k: int) -> pa.Table:
    """The best ``k`` stored rows of a block for each query in it."""
    asks = table.column("asks").to_numpy()
    vectors = table.column("v").combine_chunks()
    ids = table.column("id").to_numpy()
    width = np.array(table.column("width").to_numpy())
    q_out, c_out, s_out = [], [], []
    for d in np.unique(width):
        stored, queries = np.flatnonzero(~asks & (width == d)), np.flatnonzero(asks & (width == d))
        if not len(stored) or not len(queries):
            continue
        m = _matrix(vectors, stored, d)
        for part in np.array_split(queries, -(-len(queries) // max(1, HELD // len(stored)))):
            s = _matrix(vectors, part, d) @ m.T
            n = min(k, len(stored))
            top = np.argpartition(-s, n - 1, axis=1)[:, :n] if n < len(stored) else np.tile(np.arange(n), (len(part), 1))
            q_out.append(np.repeat(ids[part], n))
            c_out.append(ids[stored[top]].reshape(-1))
            s_out.append(np.take_along_axis(s, top, axis=1).reshape(-1))
    empty = [np.zeros(0, np.int64)]
    return pa.table({"q": np.concatenate(q_out or empty), "c": np.concatenate(c_out or empty),
                     "s": np.concatenate(s_out or [np.zeros(0)])})


def _probed(entries: DataFrame, k: int) -> DataFrame:
    """``q``, ``c``: the ``k`` nearest other entries of a few asking entries, by brute force."""
    probes = entries.filter("asks").orderBy(F.xxhash64("id"), "id").limit(PROBES).select(
        "id", "v", F.size("v").alias("width"), F.lit(True).alias("asks")).toArrow()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from _best(pa.concat_tables([pa.Table.from_batches([b]), probes.cast(b.schema)]), k + 1).to_batches()

    rows = entries.select("id", "v", F.size("v").alias("width"), F.lit(False).alias("asks"))
    found = rows.mapInArrow(run, "q bigint, c bigint, s double").filter("q <> c")
    first = Window.partitionBy("q").orderBy(C("s").desc(), "c")
    return checkpoint(found.withColumn("_r", F.row_number().over(first)).filter(C("_r") <= k).select("q", "c"))


def _block(ranked: DataFrame, truth: DataFrame, sizes: list[int], side: int, recall: float) -> int:
    """The smallest size of blocks whose windows hold ``recall`` of the true pairs; the largest if none does."""
    here = ranked.filter("asks").select("curve", "band", C("id").alias("q"), C("rank").alias("_q"))
    there = ranked.filter("NOT asks").select("curve", "band", C("id").alias("c"), C("rank").alias("_c"))
    met = truth.join(here, "q").join(there, ["curve", "band", "c"])
    held = met.groupBy("q", "c").agg(*[
        F.max(F.abs(F.floor(C("_q") / n) - F.floor(C("_c") / n)) <= side).alias(f"_{n}") for n in sizes])
    shares = held.agg(*[F.avg(C(f"_{n}").cast("double")) for n in sizes]).first()
    return next((n for n, share in zip(sizes, shares) if share is not None and share >= recall), sizes[-1])


def _all_pairs(entries: DataFrame, n: int, asking: int) -> DataFrame:
    """Rows filed so that every query meets every row once: ``cell`` of rows, ``part`` of the queries."""
    cells, parts = max(CELLS, -(-n // CELL_ROWS)), -(-asking // CELL_QUERIES)
    rows = entries.select("id", "v", F.size("v").alias("width"), "asks")
    cell, part = F.pmod(F.xxhash64("id"), F.lit(cells)), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts))
    every = [F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(m - 1).cast("bigint"))) for m in (cells, parts)]
    stored = rows.select(cell.alias("cell"), every[1].alias("part"), "width", "id", F.lit(False).alias("asks"), "v")
    asked = rows.filter("asks").select(every[0].alias("cell"), part.alias("part"), "width", "id", "asks", "v")
    return stored.union(asked)


def inner(u, v):
    """Inner product in double precision, summed from the first component on."""
    return F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def neighbours(df: DataFrame, queries, key: str = "vec_id", vector: str = "embedding", k: int = 20,
               curves: int = CURVES, block: int = BLOCK, side: int = SIDE, recall: float = RECALL, exact: bool = False) -> DataFrame:
    """``query_id``, ``rank``, id, ``score``: for each row whose id meets ``queries`` (a function of the id column) the
    ``k`` nearest other rows found, nearest first, ties to the smaller id. ``block`` is the least size of a block.
    ``exact``: every query meets every row, without curves."""
    rows = checkpoint(usable(df, key, vector).withColumn("asks", queries(C("id"))))
    # equal vectors are one entry: its smallest ids stand for it, enough to fill any list
    same = Window.partitionBy("v").orderBy("id")
    members = checkpoint(rows.select("id", "v", F.row_number().over(same).alias("_i")).filter(C("_i") <= k + 1))
    entries = checkpoint(members.groupBy("v").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids")).join(
        rows.filter("asks").select("v").distinct().withColumn("asks", F.lit(True)), "v", "left").select(
        "id", "v", "ids", F.coalesce("asks", F.lit(False)).alias("asks")))
    norms = entries.withColumn("_n", F.sqrt(inner("v", "v"))).withColumn("octave", F.floor(F.log2("_n")).cast("int"))
    octaves = norms.groupBy("octave").agg(F.count("*").alias("n"), F.sum(C("asks").cast("bigint")).alias("asking"),
                                          F.max("_n").alias("top")).collect()
    n, asking = sum(r["n"] for r in octaves), sum(r["asking"] for r in octaves)
    ranges = norm_ranges({r["octave"]: (r["n"], r["top"]) for r in octaves})
    if exact:
        groups = _all_pairs(entries, n, max(1, asking)).groupBy("cell", "part")
    else:
        keys = _keys(norms.select("id", "v", "asks", "octave"), ranges, curves)
        order = [C("curve"), C("band"), C("width"), C("place"), C("asks"), C("id")]
        ranked = checkpoint(global_rank(keys, order).select("curve", "band", "width", "id", "asks", "rank"))
        sizes = [block << i for i in range(32) if block << i <= max(block, LARGEST)]
        number = F.floor(C("rank") / _block(ranked, _probed(entries, k), sizes, side, recall)).cast("bigint")
        near = F.when(C("asks"), F.sequence(number - side, number + side)).otherwise(F.array(number))
        filed = ranked.select("curve", "width", "id", "asks", F.explode(near).alias("block")).distinct()
        # filed in the precision of the table, which halves what is shuffled for vectors of floats
        stored = entries.select("id", C("v").cast(df.schema[vector].dataType).alias("v"))
        groups = filed.join(stored, "id").select("curve", "block", "width", "id", "asks", "v").groupBy("curve", "block")
    found = groups.applyInArrow(lambda t: _best(t, k + 1), "q bigint, c bigint, s double")
    found = found.groupBy("q", "c").agg(F.max("s").alias("s"))
    first = Window.partitionBy("q").orderBy(C("s").desc(), "c")
    found = found.withColumn("_r", F.row_number().over(first)).filter(C("_r") <= k + 1).select("q", "c")
    asking = entries.filter("asks")
    pairs = found.union(asking.select(C("id").alias("q"), C("id").alias("c"))).distinct()
    # exact measure on the original vectors, then the ids behind the entries
    left = asking.select(C("id").alias("q"), C("v").alias("qv"))
    right = entries.select(C("id").alias("c"), C("v").alias("cv"), "ids")
    scored = pairs.join(right, "c").join(left, "q").select("q", inner("qv", "cv").alias("score"), F.explode("ids").alias("vec"))
    order = Window.partitionBy("q").orderBy(C("score").desc(), "vec")
    top = scored.withColumn("_r", F.row_number().over(order)).filter(C("_r") <= k + 1).groupBy("q").agg(
        F.sort_array(F.collect_list(F.struct("_r", "vec", "score"))).alias("top"))
    who = rows.filter("asks").select(C("id").alias("query_id"), "v").join(asking.select("v", C("id").alias("q")), "v")
    lists = who.join(top, "q").select("query_id", F.slice(F.filter("top", lambda t: t["vec"] != C("query_id")), 1, k).alias("t"))
    return lists.select("query_id", F.posexplode("t").alias("_p", "t")).select(
        "query_id", (C("_p") + 1).alias("rank"), C("t.vec").alias(key), C("t.score").alias("score"))
