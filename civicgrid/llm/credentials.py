"""Secrets in texts: fixed shapes, and values beside credential words that would be costly to guess.

Fixed shapes are an assignment to a credential word, an access key and a long hexadecimal string. A further kind, ``guess``, comes
from the values that stand in a credential context: after a credential word and a sign of assignment, after ``Bearer``,
and as the password of an address. Each value is cut into segments, and the cut with the smallest cost is found by dynamic
programming over its characters; the cost is the logarithm of the guesses an informed attacker needs:

* a word of the vocabulary costs its rank, plus its capitals and look-alike digits;
* a date costs the days in question, a year the years;
* a repeated unit costs the cheapest cut of the unit, plus the number of repeats;
* a walk over neighbouring keys, or along the alphabet or the digits, costs its start, its length and its turns;
* any other character costs the size of its class (brute force).

A value whose cost reaches MIN_COST is a secret: placeholders, names and dates stay cheap. Costs are whole thousandths of a bit, so
equal values cost the same everywhere.

Null and empty texts have no spans. Repeated rows give repeated results. An empty table gives no rows. Only key and text
are read, so other columns may have any name. Values may be of any length; the work grows in proportion to it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from math import comb, log2

import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col

# Fixed values of the contract: the shapes of the base kinds.
SHAPES = (
    ("assign", re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 6),
    ("access", re.compile(r"(AKIA[A-Z0-9]+)"), 20),
    ("hex", re.compile(r"([0-9a-f]+)"), 24),
)
KINDS = ("assign", "access", "hex", "guess")

MIN_COST = 45_000  # thousandths of a bit
MIN_LENGTH = 8  # characters of a value that is worth a look
SEGMENT = 1_000  # price of one more segment that is not brute force
MIN_WORD, MIN_WALK, LONGEST, UNIT = 3, 4, 40, 32

_NAME = r"(?ai:pass(?:word|wd|phrase|code)?|pwd|secret|token|api_?key|access_?key|private_?key|credentials?|auth)"
CONTEXTS = (
    re.compile(_NAME + r"(?a:\w{0,20})[\"']?[\x20\t]{0,3}(?::=|=>|[:=])[\x20\t]{0,3}"
               r"(?:\"([^\"\n]+)\"|'([^'\n]+)'|([^\x00-\x20\"',;<>()\[\]{}]+))"),
    re.compile(r"\b(?ai:bearer|basic)\x20+([A-Za-z0-9+/_.=~-]+)"),
    re.compile(r"[A-Za-z][A-Za-z0-9+.-]{0,20}://[^\x00-\x20/:@]{1,100}:([^\x00-\x20/@]+)@"),
)
# What a text must hold to be looked at; everything else has no span of any kind.
HINT = (r"(?i:pass|pwd|secret|token|api_?key|access_?key|private_?key|credential|auth|bearer|basic)|://|AKIA[A-Z0-9]{16}"
        r"|[0-9a-f]{24}")

_ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_ALIKE = str.maketrans("013457@$!", "oieastasi")
_DATES = (
    (re.compile(r"(?:19|20)\d\d"), 200),
    (re.compile(r"(?:19|20)\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])"), 200 * 366),
    (re.compile(r"(?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])(?:19|20)\d\d"), 200 * 366),
    (re.compile(r"(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?:19|20)\d\d"), 200 * 366),
    (re.compile(r"(?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])\d\d"), 100 * 366),
    (re.compile(r"\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])"), 100 * 366),
    (re.compile(r"(?:19|20)\d\d([-/._])(?:0?[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"), 4 * 200 * 366),
    (re.compile(r"(?:0?[1-9]|[12]\d|3[01])([-/._])(?:0?[1-9]|1[0-2])\1(?:19|20)\d\d"), 4 * 200 * 366),
)


def _bits(guesses: float) -> int:
    return round(1000 * log2(guesses))


def _neighbours() -> dict[str, str]:
    """Keys beside a key: the row's own, and the two above and below, which stand half a key to the side."""
    out: dict[str, set[str]] = {}
    for r, row in enumerate(_ROWS):
        for i, key in enumerate(row):
            near = [(r, i - 1), (r, i + 1), (r - 1, i), (r - 1, i + 1), (r + 1, i - 1), (r + 1, i)]
            out[key] = {_ROWS[a][b] for a, b in near if 0 <= a < len(_ROWS) and 0 <= b < len(_ROWS[a])}
    return {k: "".join(sorted(v)) for k, v in out.items()}


_NEAR = _neighbours()


@lru_cache(maxsize=4)
def vocabulary(path: str) -> dict[str, int]:
    """Rank of every word of a public tokenizer's vocabulary; whole words of ASCII letters only."""
    with open(path, encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    words = sorted((i, w[:-4]) for w, i in ids.items() if w.endswith("</w>"))
    out: dict[str, int] = {}
    for _, w in words:
        if len(w) >= MIN_WORD and w.isascii() and w.isalpha():
            out.setdefault(w.lower(), len(out) + 1)
    return out


def _brute(c: str) -> int:
    if not c.isascii():
        return _bits(1024)
    return _bits(10 if c.isdigit() else 26 if c.isalpha() else 33)


def _word_cost(part: str, rank: int) -> int:
    upper = sum(c.isupper() for c in part)
    lower = sum(c.islower() for c in part)
    cost = _bits(rank + 1) + 1000 * sum(not c.isalpha() for c in part)
    if not upper:
        return cost
    if part[:1].isupper() and upper == 1 or not lower:
        return cost + 1000
    return cost + _bits(1 + sum(comb(upper + lower, i) for i in range(1, min(upper, lower) + 1)))


def _step(a: str, b: str) -> str:
    """How one character follows another: a direction, or '' where it does not."""
    if a.isalnum() and b.isalnum() and a.isdigit() == b.isdigit() and abs(ord(a) - ord(b)) == 1:
        return "+" if b > a else "-"
    return b if b in _NEAR.get(a, "") else ""


def _walk_cost(part: str) -> int:
    """``part`` in lower case, all of it a walk."""
    steps = [_step(a, b) for a, b in zip(part, part[1:])]
    if len(set(steps)) == 1 and steps[0] in "+-":
        return _bits(36 * 2 * len(part))
    rows = "".join(_ROWS)
    straight = [rows.find(b) - rows.find(a) for a, b in zip(part, part[1:])]
    turns = sum(a != b for a, b in zip(straight, straight[1:]))
    return _bits(47 * len(part)) + turns * _bits(6)


def segments(value: str, words: dict[str, int], repeats: bool = True) -> Iterator[tuple[int, int, int]]:
    """(first, last plus one, cost) of every segment that is not brute force."""
    n, small = len(value), value.lower()
    if len(small) != n:
        small = value  # a character whose lower case is longer
    alike = small.translate(_ALIKE)
    reach = [0] * n  # how far a walk goes on
    for i in range(n - 2, -1, -1):
        reach[i] = reach[i + 1] + 1 if _step(small[i], small[i + 1]) else 0
    for i in range(n):
        for j in range(i + MIN_WORD, min(n, i + LONGEST) + 1):
            rank = words.get(alike[i:j])
            if rank and any(c.isalpha() for c in value[i:j]):
                yield i, j, _word_cost(value[i:j], rank)
        for j in range(i + MIN_WALK, min(i + reach[i] + 1, i + LONGEST) + 1):
            yield i, j, _walk_cost(small[i:j])
        if value[i].isdigit():
            for pattern, guesses in _DATES:
                found = pattern.match(value, i)
                if found:
                    yield i, found.end(), _bits(guesses)
    if not repeats:
        return
    units: dict[str, int] = {}
    for u in range(1, UNIT + 1):
        same = 0  # how many places from i on equal the place one unit further on
        for i in range(n - u - 1, -1, -1):
            same = same + 1 if value[i] == value[i + u] else 0
            if same >= u:
                times = same // u + 1
                unit = value[i:i + u]
                if unit not in units:
                    units[unit] = cheapest(unit, words, False)[0]
                yield i, i + u * times, units[unit] + _bits(times)


def cheapest(value: str, words: dict[str, int], repeats: bool = True) -> tuple[int, list[tuple[int, int]]]:
    """The smallest cost over all cuts of ``value``, and the cut that has it; single characters are brute force."""
    ending: dict[int, list[tuple[int, int]]] = {}
    for i, j, cost in segments(value, words, repeats):
        ending.setdefault(j, []).append((i, cost + SEGMENT))
    best, back = [0], [0]
    for j, c in enumerate(value, 1):
        cost, at = min([(best[j - 1] + _brute(c), j - 1), *((best[i] + x, i) for i, x in ending.get(j, ()))])
        best.append(cost)
        back.append(at)
    cut, j = [], len(value)
    while j:
        cut.append((back[j], j))
        j = back[j]
    return best[-1], cut[::-1]


def _values(text: str) -> Iterator[tuple[int, int]]:
    """Where the values of credential contexts stand."""
    for pattern in CONTEXTS:
        at = 0
        while (found := pattern.search(text, at)) is not None:
            yield found.span(found.lastindex)
            at = found.start(found.lastindex)  # a value may be the word of the next context


def spans(text: str, words: dict[str, int], min_cost: int = MIN_COST) -> list[tuple[str, int, int, int | None]]:
    """(kind, start, end, cost) of all secrets of a text, by start, then kind as listed; only guesses have a cost."""
    out = [(m.start(), k, m.end(), None) for k, (_, pattern, least) in enumerate(SHAPES)
           for m in pattern.finditer(text) if len(m.group(1)) >= least]
    for start, end in set(_values(text)):
        if end - start >= MIN_LENGTH:
            cost, _ = cheapest(text[start:end], words)
            if cost >= min_cost:
                out.append((start, len(SHAPES), end, cost))
    return [(KINDS[k], start, end, cost) for start, k, end, cost in sorted(out, key=lambda x: x[:3])]


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", min_cost: int = MIN_COST,
                 vocabulary_path: str | None = None) -> DataFrame:
    """key and ``found``: an array of (kind, start, end, cost), in code points, the end exclusive."""
    path = vocabulary_path or public_tokenizers.path("word_bpe_49k.json")

    @F.pandas_udf("array<struct<kind:string,start:bigint,end:bigint,cost:bigint>>")
    def scan(texts: pd.Series) -> pd.Series:
        words = vocabulary(path)
        return pd.Series([[] if t is None else [dict(zip(("kind", "start", "end", "cost"), s)) for s in spans(t, words, min_cost)]
                          for t in texts])

    # texts without any hint never leave the JVM
    return docs.select(docs[key], scan(F.when(docs[text].rlike(HINT), docs[text])).alias("found"))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def summary(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, counts per kind, the digest of the base spans and all spans as text."""
    def of(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s["kind"] != "guess")
    return rows.select(key, *[of(k) for k in KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(C("found")).alias("spans"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents with every secret written over by the name of its kind; all columns kept, rows without secrets unchanged.

    Spans that overlap are written over as one, under the kind of the first.
    """
    path = options.get("vocabulary_path") or public_tokenizers.path("word_bpe_49k.json")
    least = options.get("min_cost", MIN_COST)

    @F.pandas_udf("string")
    def cover(texts: pd.Series) -> pd.Series:
        words = vocabulary(path)
        return pd.Series([None if t is None else _covered(t, spans(t, words, least)) for t in texts])

    covered = F.when(docs[text].rlike(HINT), cover(F.when(docs[text].rlike(HINT), docs[text]))).otherwise(docs[text])
    return docs.withColumn(text, covered)


def _covered(text: str, found: list[tuple[str, int, int, int | None]]) -> str:
    out, at = [], 0
    for kind, start, end, _ in found:
        if start >= at:
            out.append(text[at:start] + f"[{kind}]")
        at = max(at, end)
    return "".join(out) + text[at:]
