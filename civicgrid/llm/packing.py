"""Packing documents into training sequences by minimum bin slack.

A document is its token ids and one closing id. Longer ones are cut into full pieces, of which the first may be shorter;
nothing else is cut. Sequences are filled one kind at a time: the largest length left opens a bin, and a subset-sum over
the lengths that are left, held as the bits of one integer, finds the fullest combination that still fits. That
combination is taken as often as the counts of its lengths allow and removed.

Only counts per length are gathered, at most ``capacity`` numbers whatever the table's size, and the plan made of them has
about as many combinations as there are lengths. Pieces are numbered per length over salted buckets, so one very common
length spreads over many tasks, and each finds its sequence and offset in the plan by its number.

Null text counts as empty: one closing id. Repeated rows are packed as often as they occur. An empty table gives an empty
result. Only key and text are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.state import checkpoint
from .common import batches_by_bytes
from .token_counts import tokenizer

C = F.col
CAPACITY = 2048
CLOSING = 0
VOCABULARY = "byte_bpe_50k.json"
# Pieces numbered together per bucket, and bytes of text encoded at once.
BUCKET = 4096
BYTES = 1 << 20
# Outside these characters the two libraries may class a character differently; such texts take the slower one.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ‐-‧]*")

_LOADED: dict[str, object] = {}


def _encoder(name: str):
    """Texts to ids as the vocabulary's own library gives them, by its rank table where that gives the same sooner."""
    if name not in _LOADED:
        own = tokenizer(name)

        def slow(texts: list[str]) -> list[np.ndarray]:
            return [np.array(e.ids, "<u4") for e in own.encode_batch_fast(texts, add_special_tokens=False)]

        _LOADED[name] = slow
        if name == VOCABULARY:
            import tiktoken

            with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {"<|endoftext|>": 50256}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                     special_tokens=special)

            def encode(texts: list[str]) -> list[np.ndarray]:
                return [fast.encode_to_numpy(t, allowed_special="all").astype("<u4")
                        if t.isascii() and t.isprintable() or _PLAIN.fullmatch(t) else slow([t])[0] for t in texts]

            _LOADED[name] = encode
    return _LOADED[name]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
           vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """key, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids``. Narrow: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary)
        for b in batches:
            sizes = b.column(2).to_pylist()
            for lo, hi in batches_by_bytes(sizes, BYTES):
                part = b.slice(lo, hi - lo)
                row, number, start, length, crc, held = [], [], [], [], [], []
                for at, ids in enumerate(encode(part.column(1).to_pylist())):
                    ids = np.append(ids, np.uint32(CLOSING)).astype("<u4")
                    for i, (s, n) in enumerate(cut(len(ids), capacity)):
                        row.append(at)
                        number.append(i)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(ids[s:s + n].tobytes()))
                        if with_ids:
                            held.append(ids[s:s + n].astype(np.int32))
                cols = [part.column(0).take(pa.array(row, pa.int32())), pa.array(number, pa.int32()),
                        pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["k", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array(held, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    body = F.coalesce(C(text), F.lit(""))
    rows = docs.select(C(key).alias("k"), body.alias("t"), F.octet_length(body).alias("b"))
    schema = f"k {dict(docs.dtypes)[key]}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return rows.mapInArrow(run, schema + (", ids array<int>" if with_ids else "")).withColumnRenamed("k", key)


def fullest(room: int, counts: dict[int, int]) -> dict[int, int]:
    """Copies per length whose sum comes as near to ``room`` as possible without passing it."""
    reach, steps = 1, []
    cap = (1 << (room + 1)) - 1
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, chunk = min(counts[length], room // length), 1
        while left:
            take = min(chunk, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & cap
            left -= take
            chunk *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            out[length] = out.get(length, 0) + take
    return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, copies per length) until every counted piece has a place."""
    left, out = dict(counts), []
    while left:
        largest = max(left)
        rest = dict(left)
        rest[largest] -= 1
        combo = fullest(capacity - largest, {n: c for n, c in rest.items() if c})
        combo[largest] = combo.get(largest, 0) + 1
        times = min(left[n] // c for n, c in combo.items())
        out.append((times, combo))
        for n, c in combo.items():
            left[n] -= times * c
            if not left[n]:
                del left[n]
    return out


def entries(combos: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Per length and combination: length, first number, copies, offset in the sequence, first sequence."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, combo in combos:
        offset = 0
        for n in sorted(combo, reverse=True):
            rows.append((n, used.get(n, 0), combo[n], offset, sequence))
            used[n] = used.get(n, 0) + times * combo[n]
            offset += n * combo[n]
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def numbered(df: DataFrame, key: str, total: int) -> DataFrame:
    """``number``: 0, 1, 2 ... per length. Buckets of a length are counted first, then numbered apart."""
    buckets = max(1, total // BUCKET)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(key, "piece"), F.lit(buckets)))
    inside = Window.partitionBy("length", "_salt").orderBy(key, "piece", "ids_crc32")
    ahead = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")).select(
        "length", "_salt", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    return salted.withColumn("_in", F.row_number().over(inside) - 1).join(starts, ["length", "_salt"]).withColumn(
        "number", C("_before") + C("_in")).drop("_salt", "_in", "_before")


def placed(df: DataFrame, table: np.ndarray) -> DataFrame:
    """``sequence_id`` and ``offset`` for numbered pieces. ``table`` has a few rows per length, never per piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound = (table[:, 0] << 44) + table[:, 1]
        for b in batches:
            if not b.num_rows:
                continue
            length = b.column(b.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            number = b.column(b.schema.get_field_index("number")).to_numpy(zero_copy_only=False)
            e = table[np.searchsorted(bound, (length << 44) + number, "right") - 1]
            k = number - e[:, 1]
            cols = [*b.columns, pa.array(e[:, 4] + k // e[:, 2]), pa.array(e[:, 3] + k % e[:, 2] * length)]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", sequence_id bigint, offset bigint"
    return df.mapInArrow(run, schema).drop("number")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with ``sequence_id`` and ``offset``; offsets of a sequence are gapless from 0."""
    cut_up = checkpoint(pieces(docs, key, text, capacity, vocabulary, with_ids))
    counts = {r["length"]: r["count"] for r in cut_up.groupBy("length").count().collect()}  # at most `capacity` rows
    table = entries(plan(counts, capacity))
    return placed(numbered(cut_up, key, sum(counts.values())), table)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id``, ``ids``: the packed ids in order; needs pieces that carry their ids. A row is one sequence long."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
