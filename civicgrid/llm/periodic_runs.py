"""Stretches of a document that repeat with a period, found in tiles per octave of periods and stitched together.

Words i and i + q match where they are equal. A run of period q is a maximal interval of matching places [s, e), read as the words
from s to e + q, of at least LEAST words and two periods, whose smallest period is q.

1. Documents are exploded into overlapping tiles. A scale covers the octaves of periods up to twice its ``top``; its tiles own 16 x
   ``top`` words and see 2 x ``top`` before and 4 x ``top`` after them. Only tiles that can hold a run are made: an interval of
   matches at least as long as the smallest period B of its octave covers a whole block of B / 2 words, aligned to the
   document, that recurs between B and 2B words further on. The test is exact, so ordinary text makes no tile.
2. Each tile is solved alone, wherever it was sent: at every such block the boundary Z-functions, forwards and backwards, tell how
   far the two places go on matching. They are read off ranks of the 1, 2, 4, ... word stretches of the tile.
3. Fragments are shuffled by document and period and joined where they touch or overlap. Of the runs over the same words
   the smallest period is kept, the others are its multiples.

Null and empty texts have no words and no runs. Repeated rows, and rows without a key, are documents of their own. An empty table
gives no rows. Only key and text are read, so other columns may have any name. One document's words, and a few
arrays of numbers as long, must fit into a task; nothing else grows with it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.state import checkpoint

C = F.col
Words = list[bytes]

LEAST = 12  # fixed value: words of the shortest run
DIRECT = 8  # periods below this are compared place by place
TOP = 256  # the first scale covers the octaves up to this one
OWN, BACK, AHEAD = 16, 2, 4  # words that a tile owns, and sees before and after, in units of ``top``
CHUNK = 400_000  # words looked through at once; a longer document is looked through alone

RUN = "struct<start:bigint,length:bigint,period:bigint>"


def looped(key: int | None, words: Words) -> Words:
    """The words with a loop planted, in one of ten documents, by the checksum of the key."""
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


# --- one sequence of words as numbers ---------------------------------------------------------------------------------

class Grams:
    """Ranks of all stretches of 1, 2, 4, ... words; -1 for a stretch that stands only once."""

    def __init__(self, ids: np.ndarray, limit: int):
        self.n = max(len(ids), 1)
        self.rank: list[np.ndarray] = []
        self.places: list[np.ndarray] = []  # rank * n + place, ascending
        key, at, h = ids.astype(np.int64), np.arange(len(ids)), 1
        while True:
            rank = self._add(key, at, len(ids) - h + 1)
            if rank is None or 2 * h > limit or len(ids) < 2 * h:
                return
            at = np.flatnonzero((rank[:-h] >= 0) & (rank[h:] >= 0))
            key, h = rank[at] * self.n + rank[at + h], 2 * h

    def _add(self, key: np.ndarray, at: np.ndarray, size: int) -> np.ndarray | None:
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        new = np.ones(len(key) + 1, bool)
        new[1:-1] = key[1:] != key[:-1]
        again = ~(new[:-1] & new[1:])
        if not again.any():
            return None
        code, at = np.cumsum(new[:-1])[again], at[again]
        rank = np.full(size, -1, np.int64)
        rank[at] = code
        self.rank.append(rank)
        self.places.append(code * self.n + at)
        return rank

    def pairs(self, b: int, blocks: Callable[[int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Blocks and the periods from ``b`` to twice that at which they recur; ``blocks`` gives their places by size."""
        level = max(b // 2, 4).bit_length() - 1
        if level >= len(self.rank):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rank, places = self.rank[level], self.places[level]
        m = blocks(1 << level)
        m = m[m < len(rank)]
        m = m[rank[m] >= 0]
        base = rank[m] * self.n
        lo, hi = np.searchsorted(places, base + m + b), np.searchsorted(places, base + m + 2 * b)
        # a period that leaves the sequence would reach into the places of the next rank
        hi = np.minimum(hi, np.searchsorted(places, base + self.n))
        count = np.maximum(hi - lo, 0)
        index = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.repeat(m, count), places[index] - np.repeat(base + m, count)

    def boundary_z(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many words match from ``a`` and ``b`` on, and before them."""
        out = []
        for back in (0, 1):
            x, y = a.copy(), b.copy()
            for level in reversed(range(len(self.rank))):
                rank, h = self.rank[level], 1 << level
                i, j = x - back * h, y - back * h
                ok = (i >= 0) & (j < len(rank))
                ok[ok] = (rank[i[ok]] >= 0) & (rank[i[ok]] == rank[j[ok]])
                step = np.where(ok, h, 0)
                x, y = (x - step, y - step) if back else (x + step, y + step)
            out.append(np.abs(x - a))
        return out[0], out[1]


def _needed(q):
    return np.maximum(q, LEAST - q)


def _direct(ids: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals of matches at distance ``q`` that are long enough."""
    if len(ids) < LEAST:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    match = np.concatenate(([False], ids[:-q] == ids[q:], [False]))
    edge = np.flatnonzero(match[1:] != match[:-1])
    s, e = edge[0::2], edge[1::2]
    long = e - s >= _needed(q)
    return s[long], e[long]


def _octaves(low: int, high: int) -> Iterator[int]:
    while low < high:
        yield low
        low *= 2


def solve_tile(ids: np.ndarray, start: int, n: int, own: int, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Periods and match intervals, numbered as in the document, that the tile from ``own`` on finds.

    ``ids`` are its words from ``start`` on, ``n`` the words of the document.
    """
    first, last = own - start, min(own + OWN * top, n) - start
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if top == TOP:
        for q in range(1, DIRECT):
            s, e = _direct(ids, q)
            mine = (s < last) & (e > first)
            found.append((np.full(int(mine.sum()), q), s[mine], e[mine]))
    grams = Grams(ids, len(ids))
    for b in _octaves(DIRECT if top == TOP else top, 2 * top):
        m, q = grams.pairs(b, lambda h: np.arange(first, last, h))
        ahead, before = grams.boundary_z(m, m + q)
        s, e = m - before, m + ahead
        long = e - s >= _needed(q)
        found.append((q[long], s[long], e[long]))
    q, s, e = (np.concatenate(x) for x in zip(*found))
    # several blocks of a run find the same interval
    order = np.lexsort((e, s, q))
    q, s, e = q[order], s[order], e[order]
    other = np.ones(len(q), bool)
    other[1:] = (q[1:] != q[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    return q[other], s[other] + start, e[other] + start


# --- documents to tiles -------------------------------------------------------------------------------------------------

def _numbers(documents: list[Words]) -> tuple[np.ndarray, np.ndarray]:
    """All words as numbers, equal only for equal words of one document, and where each document starts."""
    out, base = [], 0
    for words in documents:
        codes: dict[bytes, int] = {}
        out.append(np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words)) + base)
        base += len(codes)
    return np.concatenate(out), np.cumsum([0] + [len(w) for w in documents])


def _live(ids: np.ndarray, starts: np.ndarray) -> set[tuple[int, int, int]]:
    """(document, top, number) of the tiles that can hold a run."""
    found = []

    def mark(top: int, places: np.ndarray) -> None:
        doc = np.searchsorted(starts, places, side="right") - 1
        rows = np.stack([doc, np.full(len(doc), top), (places - starts[doc]) // (OWN * top)], 1)
        found.append(np.unique(rows, axis=0))

    for q in range(1, DIRECT):
        s, e = _direct(ids, q)
        if len(s):
            steps = (e - 1 - s) // (OWN * TOP) + 2
            at = np.repeat(s, steps) + (np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)) * OWN * TOP
            mark(TOP, np.minimum(at, np.repeat(e - 1, steps)))
    longest = int(np.diff(starts).max()) if len(starts) > 1 else 0
    grams = Grams(ids, max(longest // 4, 4))
    offset = np.arange(len(ids)) - np.repeat(starts[:-1], np.diff(starts))
    for b in _octaves(DIRECT, longest // 2 + 1):
        if max(b // 2, 4).bit_length() > len(grams.rank):
            break
        m, _ = grams.pairs(b, lambda h: np.flatnonzero(offset % h == 0))
        if len(m):
            mark(max(b, TOP), np.unique(m))
    return {tuple(row) for part in found for row in part.tolist()}


def _digest(words: Words) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _explode(rows: list[tuple[int, object, Words]], with_text: bool) -> Iterator[dict]:
    ids, starts = _numbers([w for _, _, w in rows])
    tiles: dict[int, list[tuple[int, int]]] = {}
    for doc, top, number in sorted(_live(ids, starts)):
        tiles.setdefault(doc, []).append((top, number))
    for doc, (row, key, words) in enumerate(rows):
        live = tiles.get(doc)
        text = b" ".join(words).decode() if live or with_text else None
        yield {"kind": "text" if live else "done", "row": row, "key": key, "text": text, "sha": None if live else _digest(words)}
        mine = ids[starts[doc]:starts[doc + 1]]
        for top, number in live or ():
            own = number * OWN * top
            start = max(own - BACK * top, 0)
            part = mine[start:own + (OWN + AHEAD) * top]
            yield {"kind": "tile", "row": row, "top": top, "own": own, "start": start, "n": len(words),
                   "ids": (part - mine.min()).astype(np.int32).tobytes()}


def _drop(words: Words, runs: list[tuple[int, int, int]]) -> Words:
    """The words that no run holds after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text",
                  words_of: Callable[[object, Words], Words] = lambda key, words: words, with_text: bool = True) -> DataFrame:
    """key, ``runs`` (start, length, period; by start, then period), ``collapsed`` (the words left when every run is cut to its
    first period, joined by blanks; NULL unless ``with_text``) and ``collapsed_sha256`` for every document.

    ``words_of`` may change the words of a document before they are searched.
    """
    kind = docs.schema[key].dataType
    schema = T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("row", T.LongType()), T.StructField("key", kind),
        T.StructField("text", T.StringType()), T.StructField("sha", T.StringType()), T.StructField("top", T.LongType()),
        T.StructField("own", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("ids", T.BinaryType())])

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[int, object, Words]] = []
            size = 0
            fields = [pa.field(f.name, batch.schema.field("key").type if f.name == "key" else _ARROW[f.dataType.typeName()])
                      for f in schema.fields]

            def send(rows):
                return pa.RecordBatch.from_pylist(list(_explode(rows, with_text)), schema=pa.schema(fields))

            for row, k, t in zip(*(batch.column(c) for c in ("row", "key", "text"))):
                k = k.as_py()
                words = words_of(k, (t.as_py() or "").encode().split())
                if held and size + len(words) > CHUNK:
                    yield send(held)
                    held, size = [], 0
                held.append((row.as_py(), k, words))
                size += len(words)
            if held:
                yield send(held)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q, s, e = solve_tile(np.frombuffer(r["ids"], np.int32), r["start"], r["n"], r["own"], r["top"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(q), r["row"])), pa.array(q), pa.array(s), pa.array(e)], names=["row", "period", "s", "e"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [_drop(t.encode().split(), [(r["start"], r["length"], r["period"]) for r in runs or ()])
                    for t, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist())]
            joined = [b" ".join(w).decode() if with_text else None for w in left]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("runs"), pa.array(joined, pa.string()), pa.array([_digest(w) for w in left])],
                names=["key", "runs", "collapsed", "collapsed_sha256"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[key].alias("key"), docs[text].alias("text"))
    # written, so that a row keeps its number when tasks are run again
    parts = checkpoint(rows.mapInArrow(explode, schema))
    tiles = parts.filter("kind = 'tile'").select("row", "top", "own", "start", "n", "ids")
    # tiles of one long document go to many tasks
    fragments = tiles.repartition(F.xxhash64("row", "top", "own")).mapInArrow(solve, "row bigint, period bigint, s bigint, e bigint")
    by_place = W.partitionBy("row", "period").orderBy("s", "e")
    before = F.max("e").over(by_place.rowsBetween(W.unboundedPreceding, -1))
    apart = fragments.withColumn("new", F.when(C("s") <= before, 0).otherwise(1)).withColumn("island", F.sum("new").over(by_place))
    whole = apart.groupBy("row", "period", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    runs = whole.groupBy("row", "s", (C("e") + C("period")).alias("stop")).agg(F.min("period").alias("period"))
    listed = runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(
        C("s").alias("start"), C("period").alias("by"), (C("stop") - C("s")).alias("length")))).alias("found"))
    listed = listed.select("row", F.transform("found", lambda r: F.struct(r["start"], r["length"], r["by"].alias("period"))).alias("runs"))
    texts = parts.filter("kind = 'text'").select("row", "key", "text").join(listed, "row", "left").select(
        "key", "text", F.coalesce("runs", F.array().cast(f"array<{RUN}>")).alias("runs"))
    out = T.StructType([T.StructField("key", kind), T.StructField("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))),
                        T.StructField("collapsed", T.StringType()), T.StructField("collapsed_sha256", T.StringType())])
    solved = texts.mapInArrow(finish, out)
    done = parts.filter("kind = 'done'").select("key", F.array().cast(f"array<{RUN}>").alias("runs"), C("text").alias("collapsed"),
                                                C("sha").alias("collapsed_sha256"))
    return solved.unionByName(done).withColumnRenamed("key", key)


_ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def summary(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, the number of runs, the longest one (then the first, then the smallest period) and digests of runs and text left."""
    best = F.element_at(F.sort_array(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    df = rows.withColumn("best", F.when(F.size("runs") > 0, best))
    length, period = -C("best.less"), C("best.period")
    return df.select(
        key, F.size("runs").cast("bigint").alias("n_runs"), C("best.start").alias("start"), length.alias("length"), period.alias("period"),
        F.expr("(-best.less * 1000) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), "collapsed_sha256")
