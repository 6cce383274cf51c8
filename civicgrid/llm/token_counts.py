"""Token counts by batch encoding inside Arrow functions; only lengths leave the workers.

A text is cut at white space into pieces of bounded size. The tokenizer drops white space and no token, pattern or special
string spans it, so the counts of the pieces add up to the count of the whole text. Pieces go to the tokenizer in batches
of about equal bytes. A word that the worker has met before is not encoded again: a table of word counts of bounded size
stands before the tokenizer, and is emptied when full, which changes the cost and never a count.

Null and empty texts have 0 bytes and 0 tokens. Repeated rows give repeated results. Only key and text are read, so other
columns may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes

# Bounds of memory per task: words remembered, characters of a piece, characters of new words encoded at once.
REMEMBERED = 300_000
LONGEST_WORD = 64
PIECE = 1 << 16
BATCH = 1 << 18
_ASCII_SPACE = " \t\n\x0b\x0c\r"

_LOADED: dict[str, object] = {}


def tokenizer(name: str):
    """The tokenizer of a vocabulary file, loaded once per worker, without truncation and padding."""
    if name not in _LOADED:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(public_tokenizers.path(name))
        t.no_truncation()
        t.no_padding()
        _LOADED[name] = t
    return _LOADED[name]


def pieces(text: str, longest: int = PIECE) -> Iterator[str]:
    """Cut a text behind ASCII white space into pieces of at most ``longest`` characters; an unbroken run stays whole."""
    start, n = 0, len(text)
    while n - start > longest:
        cut = max(text.rfind(c, start, start + longest) for c in _ASCII_SPACE)
        if cut < start:
            after = [at for c in _ASCII_SPACE if (at := text.find(c, start + longest)) >= 0]
            if not after:
                break
            cut = min(after)
        yield text[start:cut + 1]
        start = cut + 1
    if start < n:
        yield text[start:]


class Lengths:
    """Token counts of texts, through a bounded table of word counts."""

    def __init__(self, name: str):
        self.encode = tokenizer(name).encode_batch_fast
        self.known: dict[bytes, int] = {}

    def _learn(self, new: list[bytes]) -> None:
        batch: list[bytes] = []
        size = 0
        for w in [*new, None]:
            if batch and (w is None or size > BATCH):
                words = [w.decode() for w in batch]
                for word, e in zip(batch, self.encode(words, add_special_tokens=False)):
                    self.known[word] = len(e)
                batch, size = [], 0
            if w is not None:
                batch.append(w)
                size += len(w)

    def count(self, texts: list[str]) -> list[int]:
        """Token counts of a batch of texts."""
        owners, counts, total = [], [], [0] * len(texts)
        for at, text in enumerate(texts):
            for piece in pieces(text):
                owners.append(at)
                counts.append(Counter(piece.encode().split()))  # bytes split at ASCII white space only
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = {w for c in counts for w in c if w not in known}
        long = [w for w in new if len(w) > LONGEST_WORD]
        self._learn(sorted(new))
        for at, c in zip(owners, counts):
            total[at] += sum([known[w] * k for w, k in c.items()])
        for w in long:  # unbroken runs are rarely met twice
            del known[w]
        return total


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "word_bpe_49k.json",
                 limit: int = 2048, batch_bytes: int = 1 << 22) -> DataFrame:
    """key, ``n_bytes``, ``n_tokens``, ``over_limit`` for every row. Narrow: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(vocabulary)
        for b in batches:
            sizes = b.column(2).to_pylist()
            for lo, hi in batches_by_bytes(sizes, batch_bytes):
                part = b.slice(lo, hi - lo)
                n = lengths.count(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(n, pa.int64())], names=["k", "n_bytes", "n_tokens"])

    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("k"), body.alias("t"), F.octet_length(body).cast("bigint").alias("n_bytes"))
    kind = dict(docs.dtypes)[key]
    out = rows.mapInArrow(run, f"k {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
