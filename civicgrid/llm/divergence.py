"""How far the sources of a language stand apart, term by term, with the term strings put back only where they are shown.

Late string materialization. Occurrences are counted under fixed-width digests of the terms, so the large shuffles carry
(lang, source, digest) and two numbers. A digest that too few documents of a language hold cannot hide a term that enough
of them hold, so it goes first. For the digests left, the smallest and the largest string are found: where they differ, several
terms share the digest, and those alone are counted again by string and split into (digest, part). Strings come back for
the rows that are returned.

A divergence between two sources sums over all kept terms, but a term that neither of them has adds a constant and a term
that one of them has depends on its probability alone. So the sum is the constant for all terms, corrections per distinct
probability, and corrections for the terms that both have; only the last needs a join on terms, whose rows are summed where
they are formed.

Null text, language and source count as ''. Empty texts have no terms, but their group is reported. Repeated rows are
documents of their own. An empty table gives no rows. A language without kept terms has divergences of 0 and no term rows.
Only the three named columns are read, so others may have any name. Texts may be of any length. All arithmetic is in whole
numbers. Ties: larger value first, then the item by its UTF-8 bytes.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.state import checkpoint
from .common import batches_by_bytes, span_hashes

C = F.col
# Fixed values of the contract.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
MIN_DOCS = 10
TOP = 10
DIGEST_BITS = 64
PIECE = 6_000_000  # bytes of text that are counted at once
HASHED = 1 << 19  # bytes of a piece that are hashed at once

GROUP = ["lang", "source"]
ID = ["digest", "part"]


def _inside() -> np.ndarray:
    """Which bytes belong to terms: letters of ASCII and every byte of other characters."""
    out = np.zeros(256, bool)
    out[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
    return out


_INSIDE = _inside()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, last-plus-one byte and document of every term; ``offsets`` are the ends of the documents, from 0."""
    inside = _INSIDE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def _pieces(text: pa.StringArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``first`` to ``last`` with their bytes in lower case and offsets: about PIECE bytes at once. A longer text comes
    in pieces that end beside a term, as ``first``, ``first`` + 1 each time."""
    ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset:text.offset + len(text) + 1].astype(np.int64)
    raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    for first, last in batches_by_bytes(np.diff(ends).tolist(), PIECE):
        at, stop = int(ends[first]), int(ends[last])
        if stop - at <= PIECE or last - first > 1:
            yield first, last, _LOWER[raw[at:stop]], ends[first:last + 1] - at
            continue
        while at < stop:
            to = min(at + PIECE, stop)
            outside = np.flatnonzero(~_INSIDE[raw[at:to]]) if to < stop else [to - at - 1]
            to = at + int(outside[-1]) + 1 if len(outside) else stop  # a term longer than a piece stays whole
            yield first, last, _LOWER[raw[at:to]], np.array([0, to - at])
            at = to


def _digests(data: np.ndarray, start: np.ndarray, end: np.ndarray, bits: int) -> np.ndarray:
    """Digests of the terms, which are in order: about HASHED bytes at once, as sums and powers take forty bytes a byte."""
    out = np.empty(len(start), np.int64)
    at = 0
    while at < len(start):
        lo = int(start[at])
        stop = max(at + 1, int(np.searchsorted(end, lo + HASHED, side="right")))
        h = span_hashes(data[lo:int(end[stop - 1])], start[at:stop] - lo, end[at:stop] - lo)
        out[at:stop] = (h >> np.uint64(64 - bits)).view(np.int64)
        at = stop
    return out


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a row of sorted keys differs from the one before it."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _count_batch(batch: pa.RecordBatch, bits: int) -> pa.RecordBatch:
    """Per group and digest: occurrences, and documents that hold it."""
    text = batch.column("text")
    if pa.types.is_large_string(text.type):
        text = text.cast(pa.string())
    pair = pa.StructArray.from_arrays([batch.column(c) for c in GROUP], GROUP)
    one, other = (batch.column(c).dictionary_encode() for c in GROUP)
    code = one.indices.to_numpy().astype(np.int64) * (len(other.dictionary) + 1) + other.indices.to_numpy()
    _, where, group = np.unique(code, return_index=True, return_inverse=True)
    group = group.astype(np.uint16 if len(where) < 1 << 16 else np.int64)
    parts: dict[str, list[np.ndarray]] = {"group": [], "digest": [], "n": [], "docs": []}

    def put(g, d, n, docs):
        for k, v in zip(parts, (g, d, n, docs)):
            parts[k].append(v)

    held: list[tuple[np.ndarray, np.ndarray]] = []
    row = -1

    def flush():
        # all pieces of one long text are one document
        if held:
            d, back = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            n = np.bincount(back, np.concatenate([x[1] for x in held])).astype(np.int64)
            put(np.full(len(d), group[row]), d, n, np.ones(len(d), np.int64))
            held.clear()

    for first, last, data, offsets in _pieces(text):
        start, end, doc = _spans(data, offsets)
        digest = _digests(data, start, end, bits)
        if last - first == 1:
            if first != row:
                flush()
                row = first
            held.append(np.unique(digest, return_counts=True))
            continue
        flush()
        order = np.argsort(digest, kind="stable")
        g = group[first:last][doc]
        order = order[np.argsort(g[order], kind="stable")]
        g, digest, doc = g[order], digest[order], doc[order]
        new = _runs(g, digest)
        at = np.flatnonzero(new)
        if len(at):
            put(g[at], digest[at], np.diff(np.append(at, len(new))),
                np.add.reduceat((new | _runs(doc)).astype(np.int64), at))
    flush()
    g, d, n, docs = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in parts.values())
    keys = pair.take(pa.array(where[g.astype(np.int64)])) if len(g) else pair.slice(0, 0)
    return pa.RecordBatch.from_arrays([*keys.flatten(), pa.array(d), pa.array(n), pa.array(docs)],
                                      names=[*GROUP, "digest", "n", "docs"])


def _gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of many spans, none of them empty, one after another, and their offsets.

    The places are one running sum in place, of four bytes each: they are as many as the bytes of a piece.
    """
    offsets = np.concatenate(([0], np.cumsum(size)))
    place = np.ones(offsets[-1], np.int32)
    if len(size):
        place[0] = start[0]
        place[offsets[1:-1]] = start[1:] - (start[:-1] + size[:-1] - 1)
    return data[np.cumsum(place, dtype=np.int32, out=place)], offsets


def _strings_batch(batch: pa.RecordBatch, bits: int) -> Iterator[pa.RecordBatch]:
    """(digest, term), every distinct pair of a piece at least once; terms of one digest are compared byte by byte."""
    text = batch.column("text")
    if pa.types.is_large_string(text.type):
        text = text.cast(pa.string())
    for _, _, data, offsets in _pieces(text):
        start, end, _ = _spans(data, offsets)
        if not len(start):
            continue
        digest, size = _digests(data, start, end, bits), end - start
        order = np.argsort(digest, kind="stable")
        start, size, digest = start[order], size[order], digest[order]
        same = ~_runs(digest, size)  # may equal the term before it
        later = np.flatnonzero(same)
        one, at = _gathered(data, start[later], size[later])
        two, _ = _gathered(data, start[later - 1], size[later])
        if len(one):
            same[later] = np.logical_and.reduceat(one == two, at[:-1])
        shown = np.flatnonzero(~same)
        flat, at = _gathered(data, start[shown], size[shown])
        terms = pa.StringArray.from_buffers(len(shown), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(flat))
        yield pa.RecordBatch.from_arrays([pa.array(digest[shown]), terms], names=["digest", "term"])


def _texts(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(docs[lang], F.lit("")).alias("lang"), F.coalesce(docs[source], F.lit("")).alias("source"),
                       F.coalesce(docs[text], F.lit("")).alias("text"))


def _occurrences(texts: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term``, ``first``, a row per term; ``first`` is 1 for one occurrence in each document."""
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    # sorted in a step of its own, so that the sort runs once per document and not once per element
    ordered = texts.select(*GROUP, F.sort_array(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("ordered"))
    marked = F.transform("ordered", lambda x, i: F.struct(
        x.alias("term"), F.when(F.get(C("ordered"), i - 1) == x, 0).otherwise(1).alias("first")))
    return ordered.select(*GROUP, F.explode(marked).alias("o")).select(*GROUP, "o.*")


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS,
                digest_bits: int = DIGEST_BITS) -> tuple[DataFrame, DataFrame]:
    """Occurrences of the terms that ``min_docs`` documents of their language hold, and the strings of the terms.

    (``lang``, ``source``, ``digest``, ``part``, ``n``, ``n_all``) per group and term, ``n_all`` those of the language;
    (``digest``, ``part``, ``term``). ``part`` is 0 unless terms share the digest.
    """
    texts = _texts(docs, lang, source, text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _count_batch(b, digest_bits)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _strings_batch(b, digest_bits)

    rows = texts.mapInArrow(count, "lang string, source string, digest bigint, n bigint, docs bigint")
    by_digest = checkpoint(rows.groupBy(*GROUP, "digest").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    wanted = by_digest.groupBy("lang", "digest").agg(F.sum("docs").alias("docs")).filter(C("docs") >= min_docs)

    each = texts.select("text").mapInArrow(strings, "digest bigint, term string").distinct()
    each = checkpoint(each.join(wanted.select("digest").distinct(), "digest"))
    ends = each.groupBy("digest").agg(F.min("term").alias("lo"), F.max("term").alias("hi"))
    shared = checkpoint(ends.filter("lo < hi").select("digest"))
    if shared.isEmpty():
        names, counts = each.withColumn("part", F.lit(0)), by_digest.withColumn("part", F.lit(0))
    else:
        parts = each.join(shared, "digest").withColumn(
            "part", F.row_number().over(W.partitionBy("digest").orderBy("term")))
        names = each.join(shared, "digest", "left_anti").withColumn("part", F.lit(0)).unionByName(parts)
        exact = _occurrences(texts).groupBy(*GROUP, "term").agg(F.count(F.lit(1)).alias("n"), F.sum("first").alias("docs"))
        split = exact.join(parts, "term").drop("term")
        counts = by_digest.join(shared, "digest", "left_anti").withColumn("part", F.lit(0)).unionByName(split)
    kept = counts.groupBy("lang", *ID).agg(F.sum("docs").alias("all_docs"), F.sum("n").alias("n_all")).filter(
        C("all_docs") >= min_docs)
    cells = counts.join(kept.drop("all_docs"), ["lang", *ID]).select(*GROUP, *ID, "n", "n_all")
    return checkpoint(cells), names


def _share(n: str, total: str, kinds: str = "kinds") -> Column:
    """The smoothed probability in billionths; NULL where the language keeps no term."""
    # decimals are slow, and needed only where a count times the scale leaves 64 bits
    whole = f"nullif({total} + 2 * {kinds}, 0)"
    return F.expr(f"1 + case when {n} < 9000000000 then (cast({SCALE} as bigint) * ({n} + 2)) div {whole} "
                  f"else (cast({SCALE} as decimal(10,0)) * cast({n} + 2 as decimal(20,0))) div cast({whole} as decimal(20,0)) end")


def _apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS,
               top: int = TOP, digest_bits: int = DIGEST_BITS) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: the other sources of the language by divergence
    (part ``pair``) and the terms that mark the source most (part ``term``)."""
    cells, names = term_counts(docs, lang, source, text, min_docs, digest_bits)
    groups = docs.select(F.coalesce(docs[lang], F.lit("")).alias("lang"),
                         F.coalesce(docs[source], F.lit("")).alias("source")).distinct()
    totals = cells.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    langs = cells.select("lang", *ID, "n_all").distinct().groupBy("lang").agg(
        F.count(F.lit(1)).alias("kinds"), F.sum("n_all").alias("lang_total"))
    groups = checkpoint(groups.join(totals, GROUP, "left").join(langs, "lang", "left").fillna(
        0, ["total", "kinds", "lang_total"]).withColumn("p0", _share("0", "total")))
    scored = cells.join(groups, GROUP).withColumn("p", _share("n", "total"))

    pairs = _pairs(scored, groups).select(*GROUP, F.lit("pair").alias("part"), "item", "value")
    marks = scored.withColumn("q", _share("n_all", "lang_total")).filter("p > q").select(*GROUP, *ID, _apart("p", "q").alias("value"))
    best_first = W.partitionBy(*GROUP).orderBy(F.desc("value"))
    # the value of the last rank, from the counts of equal values, so that ties are cut by string only at the end
    levels = marks.groupBy(*GROUP, "value").agg(F.count(F.lit(1)).alias("ties")).withColumn(
        "level", F.row_number().over(best_first)).filter(C("level") <= top)
    before = F.sum("ties").over(best_first.rowsBetween(W.unboundedPreceding, -1))
    least = levels.withColumn("before", F.coalesce(before, F.lit(0))).filter(C("before") < top).groupBy(*GROUP).agg(
        F.min("value").alias("least"))
    shown = marks.join(least, GROUP).filter("value >= least").join(names, ID).select(
        *GROUP, F.lit("term").alias("part"), C("term").alias("item"), "value")
    ranked = F.row_number().over(W.partitionBy(*GROUP).orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", ranked).unionByName(shown.withColumn("rank", ranked).filter(C("rank") <= top))


def _pairs(scored: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``item``, ``value`` for every ordered pair of sources of a language."""
    here = groups.select("lang", "source", "kinds", C("p0").alias("a0"))
    there = groups.select("lang", C("source").alias("item"), C("p0").alias("b0"))
    base = here.join(there, "lang").filter("source <> item").withColumn("apart", _apart("a0", "b0"))
    rest = base.select(*GROUP, "item", F.coalesce(C("kinds") * C("apart"), F.lit(0).cast("bigint")).alias("value"))
    alike = scored.groupBy(*GROUP, "p").agg(F.count(F.lit(1)).alias("m"))
    one = alike.join(base, GROUP).withColumn("v", C("m") * (_apart("p", "b0") - C("apart"))).groupBy(*GROUP, "item").agg(
        F.sum("v").alias("value"))
    mirrored = one.select("lang", C("item").alias("source"), C("source").alias("item"), "value")
    a = scored.select("lang", *ID, "source", C("p").alias("pa"), C("p0").alias("a0"))
    b = scored.select("lang", *ID, C("source").alias("item"), C("p").alias("pb"), C("p0").alias("b0"))
    fix = _apart("pa", "pb") - _apart("pa", "b0") - _apart("a0", "pb") + _apart("a0", "b0")
    both = checkpoint(a.join(b, ["lang", *ID]).filter("source < item").groupBy(*GROUP, "item").agg(F.sum(fix).alias("value")))
    back = both.select("lang", C("item").alias("source"), C("source").alias("item"), "value")
    parts = [rest, one, mirrored, both, back]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.groupBy(*GROUP, "item").agg(F.sum("value").alias("value"))
