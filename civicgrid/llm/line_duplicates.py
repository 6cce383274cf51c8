"""Near-duplicate lines across documents, by a segment-partition edit join.

* Lines of at least ``least`` code points take part in the edit join. Equal lines are one. Shorter lines that are not blank are
  grouped by equality alone, where ``short`` asks for them.
* A line of length n is split into ``edits`` + 1 even segments. Two lines within ``edits`` insertions, deletions and
  substitutions of code points share at least one segment of the shorter, at a place that the two lengths and the number
  of the segment bound (multi-match-aware selection). Keys are (length, segment number, content), so a line probes the
  index of its own length and of each length down to ``edits`` less with a few substrings each.
* Candidates are confirmed by a banded bit-parallel edit distance on the whole lines: one bit per diagonal of the band
  and one bit set per number of errors, all pairs of a batch at a time.
* A bucket's lines meet its hub first. Lines of buckets that then still hold several components meet once more across components:
  each other in a bucket of at most ``FEW`` lines, in a larger one on their rarest grams: of runs of ``GRAM`` code points two
  edits change few, so the rarest few of one line must meet those of the other, and all grams together may differ by few, which
  a sketch of each line bounds. Template lines that share a segment but differ elsewhere share no rare gram, so no crowded bucket
  is compared with itself. Near copies without a rare gram of their own are: the sketches keep the pairs that become rows few.
* Lines connected by confirmed links are a class, and the first line of a class, by (document, line number), is kept.

Null or empty texts have no lines that take part. Repeated rows of one document key count as one document. Only key and
text are read. Whether repeats of short lines go is a policy of ``drop_duplicate_lines``: by default they stay, since in short
lines (headings, names, answers) a repeat is seldom a copy. ``drop_duplicate_lines`` carries the other columns along whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.state import checkpoint
from .common import _BASE, _INVERSE, batches_by_bytes, mix, powers
from .grouping import grouped

C = F.col
EDITS = 2
LEAST = 20
GRAM = 5
# Members of a bucket that may meet each other directly.
FEW = 16
# Lines that may meet directly on one of their first grams; slots of the counts that order the grams; words of a sketch of all grams.
MANY = 16
SLOTS = 1 << 18
SKETCH = 8
# Lines whose keys a task remembers to have filed already.
REMEMBERED = 1 << 18
# Bounds of memory per step: bytes of text hashed at once, code points of padded pairs compared at once.
BYTES = 1 << 20
PADDED = 1 << 21


class Lines:
    """The lines of a batch of texts that take part: owner, number, place, length, 64-bit hash."""

    def __init__(self, texts: list[bytes], least: int, short: bool = False):
        joined = b"\n".join(texts)
        self.points = np.frombuffer(joined.decode().encode("utf-32-le"), np.uint32)
        cut = np.flatnonzero(self.points == 10)
        start = np.concatenate(([0], cut + 1))
        length = np.concatenate((cut, [len(self.points)])) - start
        per_text = np.array([t.count(b"\n") + 1 for t in texts])
        owner = np.repeat(np.arange(len(texts)), per_text)
        number = np.arange(len(start)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        use = length >= least
        if short:
            seen = np.concatenate(([0], np.cumsum((self.points != 32) & ((self.points < 9) | (self.points > 13)))))
            use |= seen[start + length] > seen[start]
        self.owner, self.number, self.start, self.length = owner[use], number[use], start[use], length[use]
        with np.errstate(over="ignore"):
            self.total = np.zeros(len(self.points) + 1, np.uint64)
            np.cumsum(mix(self.points.astype(np.uint64), 7) * powers(_BASE, len(self.points)), dtype=np.uint64,
                      out=self.total[1:])
        self.hash = self.spans(self.start, self.length, 0).view(np.int64)

    def spans(self, start: np.ndarray, length: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
        with np.errstate(over="ignore"):
            back = powers(_INVERSE, len(self.points) + 1)[start]
            value = (self.total[start + length] - self.total[start]) * back
            return mix(value + mix(length.astype(np.uint64) * np.uint64(1 << 20) + np.asarray(salt, np.uint64), 9))


def _segment(length: np.ndarray, i: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and length of the i-th of ``parts`` even segments; the last ones are the longer ones."""
    short, longer = length // parts, length % parts
    place = i * short + np.maximum(0, i - (parts - longer))
    return place, short + (i >= parts - longer)


def segment_keys(lines: Lines, pick: np.ndarray, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, keys, filed): keys under which rows are filed, and further keys under which they look."""
    parts = edits + 1
    start, length = lines.start[pick], lines.length[pick]
    rows = np.arange(len(pick))
    for less in range(edits + 1):
        target = length - less
        for i in range(parts):
            place, size = _segment(target, i, parts)
            lo, hi = max(-i, less - (edits - i)), min(i, less + (edits - i))
            for shift in range(lo, hi + 1):
                at = place + shift
                ok = (at >= 0) & (at + size <= length)
                keys = lines.spans(start[ok] + at[ok], size[ok], target[ok] * 64 + i)
                yield rows[ok], keys.view(np.int64), less == 0 and shift == 0


def within(pairs: list[tuple[str, str]], edits: int) -> np.ndarray:
    """Whether the edit distance of each pair is at most ``edits``."""
    ok = np.zeros(len(pairs), bool)
    cores = []
    for at, (a, b) in enumerate(pairs):
        if abs(len(a) - len(b)) > edits:
            continue
        n = _common(a, b)
        a, b = a[n:], b[n:]
        n = _common(a[::-1], b[::-1])
        cores.append((max(len(a), len(b)) - n, at, a[:len(a) - n], b[:len(b) - n]))
    cores.sort(key=lambda c: c[0])
    lo = 0
    while lo < len(cores):
        hi = lo + 1
        while hi < len(cores) and (hi - lo + 1) * (cores[hi][0] + 1) <= PADDED:
            hi += 1
        part = cores[lo:hi]
        ok[[c[1] for c in part]] = _banded([c[2] for c in part], [c[3] for c in part], edits)
        lo = hi
    return ok


def _common(a: str, b: str) -> int:
    """Length of the common start, by halving."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while lo < hi - 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


def _banded(a: list[str], b: list[str], edits: int) -> np.ndarray:
    """Bit d of ``reach[e]`` is set if e errors lead to the diagonal d - edits; a step reads one code point of ``a``."""
    n, width = len(a), 2 * edits + 1
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    rows = int(la.max())
    x = np.zeros((n, rows + 1), np.uint32)
    y = np.full((n, max(rows, int(lb.max())) + width + 1), 0xFFFFFFFF, np.uint32)
    for k in range(n):
        x[k, :la[k]] = np.frombuffer(a[k].encode("utf-32-le"), np.uint32)
        y[k, edits:edits + lb[k]] = np.frombuffer(b[k].encode("utf-32-le"), np.uint32)
    reach = [np.full(n, 1 << edits, np.int64)]
    for e in range(edits):
        reach.append(reach[-1] | reach[-1] << 1)
    diagonals = np.arange(width)
    for e in range(edits + 1):
        reach[e] &= _allowed(lb, 0, edits, diagonals)
    ok = np.zeros(n, bool)
    live = np.arange(n)
    for i in range(rows + 1):
        done = la[live] == i
        if done.any():
            gap = lb[live] - i + edits
            ok[live[done]] = (reach[edits][done] >> gap[done]) & 1 == 1
        go = ~done & (reach[edits] != 0)
        if not go.any():
            break
        live, reach = live[go], [r[go] for r in reach]
        same = ((y[live, i:i + width] == x[live, i:i + 1]).astype(np.int64) << diagonals).sum(axis=1)
        allowed = _allowed(lb[live], i + 1, edits, diagonals)
        new = [reach[0] & same]
        for e in range(1, edits + 1):
            before = reach[e - 1]
            new.append(((reach[e] & same) | before | (before >> 1) | (new[-1] << 1)) & allowed)
        new[0] &= allowed
        reach = new
    return ok


def _allowed(lb: np.ndarray, i: int, edits: int, diagonals: np.ndarray) -> np.ndarray:
    """Diagonals that lie inside the second line after ``i`` steps."""
    at = i + diagonals - edits
    return (((at >= 0) & (at <= lb[:, None])).astype(np.int64) << diagonals).sum(axis=1)


def _bag(points: np.ndarray) -> tuple[int, int]:
    """Counts of code points in 16 classes, modulo 256, packed into two words; an edit moves at most two counts by one."""
    n = np.bincount((points * np.uint32(2654435761)) >> np.uint32(28), minlength=16).astype(np.uint8)
    return tuple(int(v) for v in n.view(np.int64))


def _entries(docs: DataFrame, least: int, edits: int) -> DataFrame:
    """``bucket``, ``id``, ``filed``: every key of every line; repeats of a line in one task mostly once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for lo, hi in batches_by_bytes(pc.binary_length(whole.column(1)).to_pylist(), BYTES):
                lines = Lines(whole.column(1).slice(lo, hi - lo).to_pylist(), least)
                if not len(lines.hash):
                    continue
                ids, pick = np.unique(lines.hash, return_index=True)
                fresh = np.array([i not in seen for i in ids.tolist()])
                ids, pick = ids[fresh], pick[fresh]
                if not len(ids):
                    continue
                if len(seen) + len(ids) > REMEMBERED:
                    seen.clear()
                seen.update(ids.tolist())
                found = list(segment_keys(lines, pick, edits))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([k for _, k, _ in found])),
                     pa.array(np.concatenate([ids[r] for r, _, _ in found])),
                     pa.array(np.concatenate([np.full(len(r), f) for r, _, f in found]))],
                    names=["bucket", "id", "filed"])

    return docs.select("id", "t").mapInArrow(run, "bucket bigint, id bigint, filed boolean")


def _shared(entries: DataFrame) -> DataFrame:
    """``bucket``, ``id``, ``hub``: the buckets with a filed line and another one; rows may repeat.

    One pass over sorted partitions that holds one batch: of a bucket that goes on, only its hub is carried along.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None  # bucket, hub, whether the hub is filed, whether its own row is out
        for b in batches:
            if not b.num_rows:
                continue
            # rows come by bucket, filed ones first, then by id
            bucket, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            filed = b.column(2).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            group = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(ids)]))))
            hubs, good, out = ids[first].copy(), filed[first].copy(), np.zeros(len(first), bool)
            if carried is not None and carried[0] == bucket[0]:
                hubs[0], good[0], out[0] = carried[1:]
            others = good[group] & (ids != hubs[group])
            others[1:] &= (ids[1:] != ids[:-1]) | (group[1:] != group[:-1])
            useful = np.bincount(group[others], minlength=len(first)) > 0
            show = useful & ~out
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([bucket[first][show], bucket[others]])), pa.array(np.concatenate([hubs[show], ids[others]])),
                 pa.array(np.concatenate([hubs[show], hubs[group][others]]))], names=["bucket", "id", "hub"])
            carried = bucket[-1], hubs[-1], good[-1], out[-1] | useful[-1]

    ordered = entries.repartition(C("bucket")).sortWithinPartitions("bucket", C("filed").desc(), "id")
    return ordered.mapInArrow(run, "bucket bigint, id bigint, hub bigint")


def _texts(docs: DataFrame, least: int) -> DataFrame:
    """``id``, ``line``: every line, once per batch of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in batches_by_bytes(pc.binary_length(whole.column(1)).to_pylist(), BYTES):
                lines = Lines(whole.column(1).slice(lo, hi - lo).to_pylist(), least)
                if not len(lines.hash):
                    continue
                ids, pick = np.unique(lines.hash, return_index=True)
                spans = [lines.points[s:s + n].tobytes().decode("utf-32-le") for s, n in zip(lines.start[pick], lines.length[pick])]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(spans)], names=["id", "line"])

    return docs.select("id", "t").mapInArrow(run, "id bigint, line string")


def _with_bags(lines: DataFrame) -> DataFrame:
    """``id``, ``line``, and the two words of its bag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [_bag(np.frombuffer(t.encode("utf-32-le"), np.uint32)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x for x, _ in bags], pa.int64()), pa.array([y for _, y in bags], pa.int64())],
                names=["id", "line", "x", "y"])

    return lines.select("id", "line").mapInArrow(run, "id bigint, line string, x bigint, y bigint")


def _places(docs: DataFrame, least: int, kind: str, short: bool) -> DataFrame:
    """``doc``, ``line_no``, ``id`` for every line that takes part, and for shorter ones if asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in batches_by_bytes(pc.binary_length(whole.column(1)).to_pylist(), BYTES):
                part = whole.slice(lo, hi - lo)
                lines = Lines(part.column(1).to_pylist(), least, short)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(lines.owner)), pa.array(lines.number.astype(np.int64)),
                     pa.array(lines.hash)], names=["doc", "line_no", "id"])

    return docs.select("id", "t").mapInArrow(run, f"doc {kind}, line_no bigint, id bigint")


def _near_bags(a: str, b: str, edits: int):
    """Whether the bags differ by no more than the allowed edits can explain."""
    gap = F.lit(0)
    for word in ("x", "y"):
        for k in range(8):
            u, v = (F.shiftrightunsigned(C(p + word), 8 * k).bitwiseAND(F.lit(255)) for p in (a, b))
            step = F.abs(u - v)
            gap = gap + F.least(step, F.lit(256) - step)
    return gap <= 2 * edits


def _grams(batch: pa.RecordBatch, q: int, least: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Per part of a batch (id, root, line): the part, the lengths of its lines, and (row, hash) of every gram of q code points.

    A gram that a line holds again has a hash of its own. Rows are in order, and so are the hashes of a row.
    """
    texts = batch.column(2).cast(pa.binary())
    for lo, hi in batches_by_bytes(pc.binary_length(texts).to_pylist(), BYTES // 4):
        found = Lines(texts.slice(lo, hi - lo).to_pylist(), least)
        count = found.length - q + 1
        row = np.repeat(np.arange(len(count)), count)
        at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        h = found.spans(found.start[row] + at, np.full(len(row), q), 3)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1]))))
        again = np.arange(len(h)) - np.repeat(first, np.diff(np.concatenate((first, [len(h)]))))
        with np.errstate(over="ignore"):
            h = mix(h + again.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), 11)
        yield batch.slice(lo, hi - lo), found.length, row, h


def _sketches(rows: int, row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Per row, whether the number of its grams in each of 64 * ``SKETCH`` classes is odd: a gram more or less flips one bit."""
    out = np.zeros(rows * SKETCH, np.uint64)
    bit = h >> np.uint64(40)
    word = ((bit >> np.uint64(6)) % np.uint64(SKETCH)).astype(np.int64)
    np.bitwise_xor.at(out, row * SKETCH + word, np.uint64(1) << (bit & np.uint64(63)))
    return out.view(np.int64).reshape(rows, SKETCH)


def _slots(h: np.ndarray, turn: int) -> np.ndarray:
    """Slots by hash; those of each turn are others."""
    return (mix(h, 13 + turn) % np.uint64(SLOTS)).astype(np.int64)


def _slot_counts(texts: DataFrame, q: int, least: int, turn: int) -> np.ndarray:
    """How many grams of all lines fall into each of ``SLOTS`` slots by hash: the only thing sent to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, _, _, h in _grams(batch, q, least):
                total += np.bincount(_slots(h, turn), minlength=SLOTS)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], names=["slot", "c"])

    counts = np.zeros(SLOTS, np.int64)
    for r in texts.mapInArrow(run, "slot bigint, c bigint").groupBy("slot").agg(F.sum("c").alias("c")).collect():
        counts[r.slot] = r.c
    return counts


def rare_gram_pairs(items: DataFrame, lines: DataFrame, edits: int, least: int, many: int = MANY) -> DataFrame:
    """Pairs (src, dst) of ``items`` (id, root) of different roots that may lie within ``edits``.

    An edit changes at most q of a line's grams of q code points, counted with their repeats. So with the grams in any one order
    for all, lines within ``edits`` share one among the first q * edits + 1 of either. q is small enough that the shortest
    line has as many. It takes at most q grams and adds as many, so the sketches differ in at most 2 * q * edits bits.

    The order goes by counts per slot of hashes, which a task can hold, so a line gives only its first grams. A gram that more than
    ``many`` lines still hold joins nothing; its lines, which include both ends of any pair it stands for, are ordered once
    more by counts of themselves alone, and meet on their first grams then, however many hold one.
    """
    q = max(1, min(GRAM, least // (edits + 1)))
    head = q * edits + 1
    texts = checkpoint(items.join(lines.select("id", "line"), "id").select("id", "root", "line"))

    def first_grams(texts: DataFrame, turn: int) -> DataFrame:
        counts = _slot_counts(texts, q, least, turn)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, _, row, h in _grams(batch, q, least):
                    order = np.lexsort((h, counts[_slots(h, turn)], row))
                    h, row = h[order], row[order]
                    near = np.arange(len(row)) - np.searchsorted(row, np.arange(part.num_rows))[row] < head
                    pick = pa.array(row[near])
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pick), part.column(1).take(pick), pa.array(h[near].view(np.int64))],
                        names=["id", "root", "h"])

        grams = checkpoint(texts.mapInArrow(run, "id bigint, root bigint, h bigint"))
        seen = grams.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        return checkpoint(grams.join(seen.filter("lo < hi").select("h", "c"), "h"))

    words = [f"s{k}" for k in range(SKETCH)]

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, length, row, h in _grams(batch, q, least):
                sketch = _sketches(part.num_rows, row, h)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(length.astype(np.int64)), *[pa.array(np.ascontiguousarray(w)) for w in sketch.T]],
                    names=["id", "n", *words])

    some = first_grams(texts, 0)
    hot = some.filter(C("c") > many).select("id").distinct()
    rest = first_grams(checkpoint(texts.join(hot, "id", "left_semi")), 1)
    traits = texts.join(some.select("id").distinct(), "id", "left_semi").select("id", "root", "line").mapInArrow(
        sketched, "id bigint, n bigint, " + ", ".join(w + " bigint" for w in words))
    traits = checkpoint(traits.join(lines.select("id", "x", "y"), "id"))

    def meet(prefix: DataFrame) -> DataFrame:
        held = prefix.select("id", "root", "h").join(traits, "id")
        other = held.select("h", *[C(c).alias("other_" + c) for c in ("id", "root", "n", "x", "y", *words)])
        apart = sum((F.bit_count(C(w).bitwiseXOR(C("other_" + w))) for w in words), F.lit(0))
        return held.join(other, "h").filter(
            (C("id") < C("other_id")) & (C("root") != C("other_root")) & (F.abs(C("n") - C("other_n")) <= edits)
            & (apart <= 2 * q * edits) & _near_bags("", "other_", edits)).select(C("id").alias("src"), C("other_id").alias("dst"))

    return meet(some.filter(C("c") <= many)).unionByName(meet(rest))


def line_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS,
                 least: int = LEAST, short: bool = False) -> DataFrame:
    """key, ``line_no`` (from 0), ``class_doc``, ``class_line`` (the first line of its class), ``kept``.

    ``short``: also the lines of fewer than ``least`` code points that are not blank; only equal ones are a class.
    """
    kind = dict(docs.dtypes)[key]
    rows = docs.select(C(key).alias("id"), F.coalesce(C(text), F.lit("")).cast("binary").alias("t"))
    places = checkpoint(_places(rows, least, kind, short))
    shared = checkpoint(_shared(_entries(rows, least, edits)))
    used = checkpoint(shared.select("id").distinct())
    lines = checkpoint(_with_bags(_texts(rows, least).join(used.hint("merge"), "id", "left_semi").dropDuplicates(["id"])))

    def confirm(pairs: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = pa.array(within(list(zip(b.column(2).to_pylist(), b.column(3).to_pylist())), edits), pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)],
                                                 names=["src", "dst"])

        a = lines.select(C("id").alias("src"), C("line").alias("a"))
        b = lines.select(C("id").alias("dst"), C("line").alias("b"))
        both = pairs.join(b, "dst").join(a, "src").select("src", "dst", "a", "b")
        return both.mapInArrow(run, "src bigint, dst bigint")

    def across(alive: DataFrame) -> DataFrame:
        sizes = alive.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"))
        placed = checkpoint(alive.join(sizes, "bucket"))
        some = placed.filter(C("k") <= FEW).join(lines.select("id", "x", "y"), "id")
        other = some.select("bucket", *[C(c).alias("other_" + c) for c in ("id", "root", "x", "y")])
        small = some.join(other, "bucket").filter(
            (C("id") < C("other_id")) & (C("root") != C("other_root")) & _near_bags("", "other_", edits))
        crowded = placed.filter(C("k") > FEW).select("id", "root").distinct()
        return small.select(C("id").alias("src"), C("other_id").alias("dst")).unionByName(
            rare_gram_pairs(crowded, lines, edits, least))

    roots = grouped(used.withColumnRenamed("id", "node"), checkpoint(shared.distinct()), confirm, across)
    firsts = places.groupBy("id").agg(F.min(F.struct("doc", "line_no")).alias("first"))
    firsts = firsts.join(roots.withColumnRenamed("node", "id"), "id", "left").select(
        "id", F.coalesce("root", "id").alias("root"), "first")
    heads = firsts.groupBy("root").agg(F.min("first").alias("head"))
    heads = checkpoint(firsts.join(heads, "root").select("id", "head"))
    out = places.join(heads, "id").select(
        C("doc").alias(key), "line_no", C("head.doc").alias("class_doc"), C("head.line_no").alias("class_line"))
    return out.withColumn("kept", C(key).eqNullSafe(C("class_doc")) & (C("line_no") == C("class_line")))


def drop_duplicate_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS,
                         least: int = LEAST, short: bool = False, least_left: float = 0.0) -> DataFrame:
    """The documents without the lines that stand earlier in the corpus; a text of which nothing is left goes.

    A text that loses lines goes as well where less than the share ``least_left`` of its code points is left: what remains of a
    near copy is a scrap of it and not a document.

    Lines of fewer than ``least`` code points stay, unless ``short``: then equal ones that stand earlier go as well. Texts that lose nothing are returned as they are, null and empty ones included.
    """
    gone = line_classes(docs, key, text, edits, least, short).filter("NOT kept").groupBy(key).agg(
        F.collect_set("line_no").alias("gone")).select(C(key).alias("_key"), C("gone").alias("_gone"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[key].alias("_key"))
    rows = rows.join(gone, "_key", "left")
    left = F.filter(F.split(C(f"row.{text}"), "\n"), lambda x, i: ~F.array_contains("_gone", i.cast("bigint")))
    new = F.when(C("_gone").isNull(), C(f"row.{text}")).otherwise(F.array_join(left, "\n"))
    rows = rows.withColumn("_new", new)
    empty = C("_gone").isNotNull() & ~C("_new").rlike(r"[^\x20\x09-\x0D]")
    scrap = C("_gone").isNotNull() & (F.length("_new") < F.lit(least_left) * F.length(C(f"row.{text}")))
    return rows.filter(~(empty | scrap)).select(
        *[C("_new").alias(c) if c == text else C(f"row.`{c}`").alias(c) for c in docs.columns])
