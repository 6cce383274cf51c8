"""Near-duplicate documents: SuperMinHash signatures, bands, verification on full shingle sets, union-find groups.

Method
* A document is the set of its distinct word shingles, held as 64-bit hashes (a chance collision inside a pair of texts
  has a probability below 1e-9). Documents of equal sets are one class; everything below runs on class representatives.
* SuperMinHash walks, per shingle, through a random permutation of the signature's places and offers level + random rank
  at the place of that level. The walk runs level by level for all shingles of a batch, and a document stops as soon as
  every place holds a value of a level already walked: later levels can only offer more. That is the early stopping of
  the method and gives the same signature as walking on.
* Bands of ``ROWS`` places meet in buckets. With 32 bands of 4, a pair at similarity 0.75 shares no bucket with
  probability 5e-6, one at 0.8 with 5e-8.
* Members of a bucket are first compared with the bucket's hub only, the member with most company over all its buckets:
  copies meet their original there. Members of buckets that then still hold several components are searched once more for
  pairs across components, by an exact prefix filter on their full sets: the rarest quarter of the shingles of one must
  meet that of the other. Variants too far from each other share none of these, however many there are.
* Every link is confirmed on the full sets, from whole texts.

Null or empty texts and texts without a word have an empty set and stay alone. Repeated rows of one key give one row per
input row. Only key and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.state import checkpoint
from .common import batches_by_bytes, mix, span_hashes, word_spans
from .grouping import grouped, with_hubs

C = F.col
SHINGLE = 5
PLACES, ROWS = 128, 4
# Bounds of memory per step: shingles walked at once, bytes of text hashed at once.
STEP = 1 << 17
BYTES = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted inside each text, and the bounds of the texts' parts."""
    joined = b" ".join(texts)
    data = _LOWER[np.frombuffer(joined, np.uint8)]
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    first, last = word_spans(data)
    words = span_hashes(data, first, last)
    owner = np.searchsorted(begins, first, "right") - 1
    per_text = np.bincount(owner, minlength=len(texts))
    n = len(words) - SHINGLE + 1
    with np.errstate(over="ignore"):
        if n > 0:
            h = np.zeros(n, np.uint64)
            for j in range(SHINGLE):
                h = h * np.uint64(0xD6E8FEB86659FD93) + words[j:j + n]
            whole = owner[:n] == owner[SHINGLE - 1:]
            h, who = mix(h[whole], SHINGLE), owner[:n][whole]
        else:
            h, who = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((per_text > 0) & (per_text < SHINGLE))
        if len(short):
            at = np.cumsum(per_text) - per_text
            extra = np.zeros(len(short), np.uint64)
            for i, d in enumerate(short):
                for w in words[at[d]:at[d] + per_text[d]]:
                    extra[i] = extra[i] * np.uint64(0xD6E8FEB86659FD93) + w
                extra[i] = mix(extra[i:i + 1], 100 + int(per_text[d]))[0]
            h, who = np.concatenate([h, extra]), np.concatenate([who, short])
    order = np.lexsort((h, who))
    h, who = h[order], who[order]
    if len(h):
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (who[1:] != who[:-1])))
        h, who = h[new], who[new]
    return h, np.searchsorted(who, np.arange(len(texts) + 1))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def super_min_hash(h: np.ndarray, bounds: np.ndarray, places: int = PLACES) -> np.ndarray:
    """One signature row per part; parts without elements keep infinities.

    Level j of an element draws a rank r in [0, 1) and the j-th entry of its own random permutation, and offers j + r
    there. All elements of unfinished parts take a level together.
    """
    n = len(bounds) - 1
    sig = np.full((n, places), np.inf)
    flat = sig.reshape(-1)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    perm = None
    for level in range(places):
        rank = _unit(mix(h, 2 * level)) + level
        pick = level + (_unit(mix(h, 2 * level + 1)) * (places - level)).astype(np.int64)
        if level == 0:
            place, first = pick, pick
        elif level == 1:  # the permutation after one swap has two entries out of place
            place, second = np.where(pick == first, 0, pick), pick
        else:
            rows = np.arange(len(h))
            if perm is None:
                perm = np.tile(np.arange(places, dtype=np.int16), (len(h), 1))
                for at, chosen in ((0, first), (1, second)):
                    held = perm[rows, chosen].copy()
                    perm[rows, chosen] = perm[:, at]
                    perm[:, at] = held
            place = perm[rows, pick].astype(np.int64)
            perm[rows, pick] = perm[:, level]
            perm[:, level] = place
        np.minimum.at(flat, owner * places + place, rank)
        open_parts = sig.max(axis=1) >= level + 1
        on = open_parts[owner]
        if not on.any():
            break
        if not on.all():
            h, owner = h[on], owner[on]
            if perm is not None:
                perm = perm[on]
            else:
                first = first[on]
                if level == 1:
                    second = second[on]
    return sig


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """64-bit bucket keys, one per band; equal places of a band give equal keys."""
    n, places = sig.shape
    x = mix(np.ascontiguousarray(sig).view(np.uint64))
    out = np.zeros((n, places // rows), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(rows):
            out = out * np.uint64(0xD6E8FEB86659FD93) + x[:, j::rows][:, :places // rows]
        return mix(out + np.arange(places // rows, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _parts(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``STEP`` shingles."""
    lo = 0
    while lo < len(bounds) - 1:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + STEP, "right")) - 1)
        yield lo, hi
        lo = hi


def _signed(b: pa.RecordBatch) -> pa.RecordBatch:
    h, bounds = shingle_hashes(b.column(1).to_pylist())
    size = np.diff(bounds)
    digests, keys = [], []
    for salt in (1001, 1002):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h, salt), dtype=np.uint64, out=total[1:])
        with np.errstate(over="ignore"):
            digests.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    for lo, hi in _parts(bounds):
        keys.append(band_keys(super_min_hash(h[bounds[lo]:bounds[hi]], bounds[lo:hi + 1] - bounds[lo])))
    keys = np.concatenate(keys).view(np.int64)
    at = np.concatenate(([0], np.cumsum(np.where(size > 0, keys.shape[1], 0))))
    lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(keys[size > 0].reshape(-1)))
    return pa.RecordBatch.from_arrays(
        [b.column(0), pa.array(size.astype(np.int64)), *map(pa.array, digests), lists],
        names=["id", "n", "d1", "d2", "bands"])


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key as ``id``, ``n`` (set size), ``d1``, ``d2`` (digest of the set), ``bands`` (empty where the set is empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in batches_by_bytes(pc.binary_length(whole.column(1)).to_pylist(), BYTES):
                yield _signed(whole.slice(lo, hi - lo))

    kind = dict(docs.dtypes)[key]
    rows = docs.select(C(key).alias("id"), F.coalesce(C(text), F.lit("")).cast("binary").alias("t"))
    return rows.mapInArrow(run, f"id {kind}, n bigint, d1 bigint, d2 bigint, bands array<bigint>")


def _close(b: pa.RecordBatch, percent: int) -> np.ndarray:
    one = b.column(2).dictionary_encode()  # a hub's text stands in many rows
    left, lb = shingle_hashes(one.dictionary.to_pylist())
    which = one.indices.to_numpy(zero_copy_only=False)
    right, rb = shingle_hashes(b.column(3).to_pylist())
    ok = np.zeros(b.num_rows, bool)
    for i in range(b.num_rows):
        x, y = left[lb[which[i]]:lb[which[i] + 1]], right[rb[i]:rb[i + 1]]
        if len(x) and len(y):
            spot = np.searchsorted(x, y)
            spot[spot == len(x)] = 0
            both = int((x[spot] == y).sum())
            ok[i] = 100 * both >= percent * (len(x) + len(y) - both)
    return ok


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = 75) -> DataFrame:
    """Those of ``pairs`` (src, dst) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pc.binary_length(whole.column(3)).to_pylist()
            for lo, hi in batches_by_bytes(sizes, BYTES):
                keep = pa.array(_close(whole.slice(lo, hi - lo), percent))
                part = whole.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).filter(keep), part.column(1).filter(keep)], names=["src", "dst"])

    t = texts.select(C("id").alias("src"), C("t").alias("a"))
    u = texts.select(C("id").alias("dst"), C("t").alias("b"))
    both = pairs.select("src", "dst").join(u, "dst").join(t, "src").select("src", "dst", "a", "b")
    kind = dict(pairs.dtypes)["src"]
    return both.mapInArrow(run, f"src {kind}, dst {kind}")


def prefix_pairs(items: DataFrame, texts: DataFrame, percent: int = 75) -> DataFrame:
    """Pairs (src, dst) of ``items`` (id, root) of different roots that may reach the similarity.

    With shingles in one order for all, rarest first, two sets that reach it share one among the first
    n - ceil(percent * n / 100) + 1 of either, and their first common one leaves room for as many as they need in common.
    """
    kind = dict(items.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in batches_by_bytes(pc.binary_length(whole.column(2)).to_pylist(), BYTES):
                part = whole.slice(lo, hi - lo)
                h, bounds = shingle_hashes(part.column(2).to_pylist())
                size = np.diff(bounds)
                row = pa.array(np.repeat(np.arange(len(size)), size))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(row), part.column(1).take(row), pa.array(np.repeat(size, size).astype(np.int64)),
                     pa.array(h.view(np.int64))], names=["id", "root", "n", "h"])

    sets = checkpoint(items.join(texts, "id").select("id", "root", "t").mapInArrow(
        run, f"id {kind}, root {kind}, n bigint, h bigint"))
    seen = sets.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    rarest = Window.partitionBy("id").orderBy("c", "h")
    first = C("n") - F.ceil(C("n") * percent / 100) + 1
    prefix = sets.join(seen, "h").withColumn("r", F.row_number().over(rarest)).filter(
        (C("r") <= first) & (C("lo") < C("hi"))).select("id", "root", "n", "h", "r")
    prefix = checkpoint(prefix)
    other = prefix.select("h", C("id").alias("dst"), C("root").alias("other"), C("n").alias("m"), C("r").alias("s"))
    # with the first common shingle at places r and s, no more than what follows can be common
    both = percent * (C("n") + C("m"))
    fits = ((100 + percent) * (C("n") - C("r") + 1) >= both) & ((100 + percent) * (C("m") - C("s") + 1) >= both)
    pairs = prefix.withColumnRenamed("id", "src").join(other, "h").filter(
        (C("src") < C("dst")) & (C("root") != C("other")) & fits)
    return pairs.select("src", "dst")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """key, ``n_shingles``, ``component_id`` (smallest key reachable over links), ``kept`` (key is its component's id)."""
    signed = checkpoint(signatures(docs, key, text))
    full = signed.filter("n > 0")
    classes = checkpoint(full.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep")))
    reps = full.join(classes.select(C("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    filed = checkpoint(reps.select("id", F.explode("bands").alias("bucket")))
    entries = checkpoint(with_hubs(filed))
    texts = docs.select(C(key).alias("id"), F.coalesce(C(text), F.lit("")).cast("binary").alias("t"))
    used = checkpoint(entries.select("id").distinct())
    held = checkpoint(texts.join(used, "id", "left_semi").dropDuplicates(["id"]))
    roots = grouped(classes.select(C("rep").alias("node")), entries, lambda pairs: confirmed(pairs, held, percent),
                    lambda alive: prefix_pairs(alive.select("id", "root").distinct(), held, percent))

    member = signed.join(classes, ["d1", "d2", "n"], "left").select("id", "n", "rep")
    out = member.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        C("id").alias(key), C("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"))
    return out.withColumn("kept", C(key) == C("component_id"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """The documents with the smallest key of their group, with their own columns, whatever their names.

    Documents with an empty set stay. Repeated rows of one key stay or go together.
    """
    gone = near_duplicates(docs, key, text, percent).filter("NOT kept").select(C(key).alias("_gone")).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[key].alias("_key"))
    left = rows.join(gone, rows["_key"] == gone["_gone"], "left_anti")
    return left.select(*[C(f"row.`{c}`").alias(c) for c in docs.columns])
