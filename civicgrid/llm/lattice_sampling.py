"""Sampled subword segmentations without replacement, and their decoding, over a SentencePiece vocabulary.

A text in the vocabulary's own normal form is cut before every run of word marks; no piece lies across such a cut, so the
lattice of a text is a chain of small lattices, one per word, and equal words share one. Backward sums over a word's lattice
give each arc its exact probability under a model in which a piece costs a constant and a share of its merge rank.

Samples are drawn by Gumbel top-k: the whole lattice holds a perturbed value, the best completion of every partial
segmentation holds a smaller one, and a best-first search pops the largest bound from a queue. A popped set of segmentations
emits its best one, and what is left of the set, all that leave the emitted path at some node, goes back with a new bound: a
Gumbel value of the remaining mass cut off at the popped one. The bounds are exact, so the emitted segmentations are distinct
and come in the order of their perturbed values, as k draws without replacement do. The (k+1)-th bound is the threshold of
the inclusion scores: log inclusion = log(1 - exp(-exp(log p - threshold))).

Every random number is a hash of the row key, the sample and the place, so a row gives the same samples anywhere, and repeated
keys with equal texts give equal samples. Null and empty texts have one segmentation without pieces, of log p 0. Texts with
fewer than k segmentations give all of them. Characters the vocabulary lacks are spelled in byte pieces.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, _INVERSE, batches_by_bytes, mix, powers

C = F.col
VOCABULARY = "piece_bpe_32k.model"
SAMPLES = 2
# The model of segmentations: cost of a piece, and of the last merge rank on top.
PIECE_COST, RANK_COST = 3.0, 3.0
# Bounds of memory per task: words remembered, bytes of text sampled at once, code points of new words added at once.
REMEMBERED, BYTES, POINTS = 200_000, 1 << 19, 1 << 16
SLOT = np.uint64(44)
MARK = "▁"

_LOADED: dict[str | tuple[str, str], object] = {}


class Vocabulary:
    """Pieces with their weights, byte pieces, and the way back to text."""

    def __init__(self, name: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        sp, n = self.processor, self.processor.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        rank = {i: -sp.get_score(i) for i in plain}
        last = max((r for r in rank.values() if r < 1e8), default=1.0) or 1.0
        self.pieces = {sp.id_to_piece(i): (i, -PIECE_COST - RANK_COST * min(1.0, rank[i] / last)) for i in plain}
        self.bytes = {int(sp.id_to_piece(i)[3:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.longest = max(map(len, self.pieces))
        self.spelled = [b""] * n
        for i in plain:
            self.spelled[i] = sp.id_to_piece(i).replace(MARK, " ").encode()
        for b, i in self.bytes.items():
            self.spelled[i] = bytes([b])

    def normal(self, text: str) -> str:
        return self.processor.normalize(text) if text else ""

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, marks turned to spaces, the leading one dropped."""
        out = b"".join([self.spelled[i] for i in ids]).decode(errors="replace")
        return out[1:] if out[:1] == " " else out

    def decodes(self, ids: list[int], want: bytes) -> bool:
        """Whether the ids spell the text, given in UTF-8 with its marks turned to spaces."""
        if b"".join([self.spelled[i] for i in ids]) == want:
            return True
        text = want.decode()
        return self.decode(ids) == (text[1:] if text[:1] == " " else text)


def vocabulary(name: str = VOCABULARY) -> Vocabulary:
    if name not in _LOADED:
        _LOADED[name] = Vocabulary(name)
    return _LOADED[name]


_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def words(normal: str) -> list[str]:
    """The text cut before each run of word marks."""
    return _WORD.findall(normal)


class Lattices:
    """Lattices of distinct words in flat arrays.

    Node v has the arcs ``first[v]`` to ``first[v + 1]``, likeliest first: ``share`` is the probability up to and with the
    arc, ``to`` the node it leads to (-1 at the end of a word), ``piece`` its id or, for a character spelled in bytes,
    minus one minus its place in ``spelled``. The arrays are longer than the ``nodes`` and ``arcs`` they hold.
    """

    FIELDS = {"share": np.float64, "to": np.int32, "log_p": np.float64, "piece": np.int32}

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.ids = np.array([i for i, _ in vocab.pieces.values()])
        self.weights = np.array([w for _, w in vocab.pieces.values()])
        points = [np.array([ord(c) for c in piece], np.uint64) for piece in vocab.pieces]
        flat = np.concatenate(points)
        end = np.cumsum([len(x) for x in points])
        start = end - [len(x) for x in points]
        hashes = _hashes(flat, start, end)
        order = np.argsort(hashes)
        self.hashes, self.ids, self.weights = hashes[order], self.ids[order], self.weights[order]
        # the first piece of each slot by hash, as most substrings are none; others of the slot follow it
        slot = (self.hashes >> SLOT).astype(np.int64)
        self.slots = np.full(1 << 20, -1, np.int32)
        self.slots[slot[::-1]] = np.arange(len(slot), dtype=np.int32)[::-1]
        self.deepest = int(np.bincount(slot).max())
        self.first = np.zeros(1, np.int64)
        for name, kind in self.FIELDS.items():
            setattr(self, name, np.zeros(0, kind))
        self.reset()

    def reset(self) -> None:
        self.entry: dict[str, int] = {}
        self.nodes = self.arcs = 0
        self.spelled: list[tuple[int, ...]] = []

    def _put(self, name: str, at: int, new: np.ndarray) -> None:
        """Write ``new`` behind the first ``at`` values; arrays grow by half at least, so words are seldom copied."""
        held = getattr(self, name)
        if at + len(new) > len(held):
            wider = np.zeros(max(at + len(new), len(held) + len(held) // 2), held.dtype)
            wider[:at] = held[:at]
            held = wider
            setattr(self, name, held)
        held[at:at + len(new)] = new

    def node(self, arc: int) -> int:
        """The node that an arc leaves."""
        return int(np.searchsorted(self.first[:self.nodes + 1], arc, side="right")) - 1

    def _arcs(self, points: np.ndarray, left: np.ndarray):
        """Source, length, weight and piece of every arc, those nearest to the end of their word first.

        ``left``: code points from each place to the end of its word.
        """
        total = _sums(points)
        found = []
        every = np.argsort(_small(left), kind="stable")
        reach = np.searchsorted(left[every], np.arange(self.vocab.longest + 1))
        for n in range(1, min(self.vocab.longest, int(left.max())) + 1):
            at = every[reach[n]:]
            h = _spans(total, at, at + n)
            spot = self.slots[(h >> SLOT).view(np.int64)]
            some = np.flatnonzero(spot >= 0)
            at, h, spot = at[some], h[some], spot[some]
            hit = self.hashes[spot] == h
            for _ in range(1, self.deepest):
                miss = np.flatnonzero(~hit)
                spot[miss] = np.minimum(spot[miss] + 1, len(self.hashes) - 1)
                hit[miss] = self.hashes[spot[miss]] == h[miss]
            at, spot = at[hit], spot[hit]
            found.append((at, np.full(len(at), n), self.weights[spot], self.ids[spot]))
            if n == 1:
                alone = np.ones(len(points), bool)
                alone[at] = False
                at = every[alone[every]]
                spelled = [tuple(self.vocab.bytes[b] for b in chr(points[i]).encode()) for i in at]
                number = -1 - len(self.spelled) - np.arange(len(at))
                self.spelled += spelled
                cost = np.array([-(PIECE_COST + RANK_COST) * len(x) for x in spelled])
                found.append((at, np.ones(len(at), np.int64), cost, number))
        rank = np.empty(len(points), np.int64)
        rank[every] = np.arange(len(points))
        order = np.argsort(_small(rank[np.concatenate([x[0] for x in found])]), kind="stable")
        return (np.concatenate(x)[order] for x in zip(*found))

    def add(self, new: list[str]) -> None:
        """Lattices of all ``new`` words, as many at once as have about POINTS code points."""
        for lo, hi in batches_by_bytes([len(w) for w in new], POINTS):
            self._add(new[lo:hi])

    def _add(self, new: list[str]) -> None:
        """Arcs by hashed substrings, sums from the ends of the words."""
        size = np.array([len(w) for w in new])
        points = np.frombuffer("".join(new).encode("utf-32-le"), np.uint32).astype(np.uint64)
        begin = np.cumsum(size) - size
        left = np.repeat(begin + size, size) - np.arange(len(points))
        source, length, weight, piece = self._arcs(points, left)
        far = left[source]
        target = source + length
        rest = np.zeros(len(points) + 1)
        last = length == far
        log_p = np.zeros(len(source))
        steps = np.searchsorted(far, np.arange(1, int(far[-1]) + 2))
        for lo, hi in zip(steps[:-1], steps[1:]):
            if lo == hi:
                continue
            value = weight[lo:hi] + np.where(last[lo:hi], 0.0, rest[target[lo:hi]])
            own = source[lo:hi]
            heads = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            size = np.diff(np.append(heads, hi - lo))
            top = np.maximum.reduceat(value, heads)
            whole = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, size)), heads))
            rest[own[heads]] = whole
            log_p[lo:hi] = value - np.repeat(whole, size)
        log_p = np.minimum(log_p, 0.0)
        order = np.argsort(source + 0.999 * -np.expm1(log_p))  # by node, likeliest first
        source, target, log_p, piece, last = (x[order] for x in (source, target, log_p, piece, last))
        first = np.searchsorted(source, np.arange(len(points) + 1))
        p = np.exp(log_p)
        total = np.cumsum(p)
        share = total - (total - p)[first[source]]
        share[first[1:] - 1] = 1.0  # whatever rounding left
        base, arcs = self.nodes, self.arcs
        self.entry.update(zip(new, (begin + base).tolist()))
        self._put("first", base + 1, arcs + first[1:])
        for name, x in zip(self.FIELDS, (share, np.where(last, -1, target + base), log_p, piece)):
            self._put(name, arcs, x)
        self.nodes, self.arcs = base + len(points), arcs + len(source)

    def look(self, texts: list[list[str]]) -> np.ndarray:
        """Entry nodes of the words of several texts, one after the other."""
        if len(self.entry) > REMEMBERED or self.nodes > 16 * REMEMBERED:
            self.reset()
        new = list(set().union(*texts).difference(self.entry))
        if new:
            self.add(new)
        return np.fromiter(map(self.entry.__getitem__, chain.from_iterable(texts)), np.int64)

    def spell(self, arcs: np.ndarray) -> np.ndarray:
        """The ids of a path."""
        ids = self.piece[arcs]
        at = np.flatnonzero(ids < 0)
        if len(at):
            spelled = [self.spelled[i] for i in (-1 - ids[at]).tolist()]
            size = np.ones(len(ids), np.int64)
            size[at] = [len(x) for x in spelled]
            start = (np.cumsum(size) - size)[at]
            ids = np.repeat(ids, size)
            for i, x in zip(start.tolist(), spelled):
                ids[i:i + len(x)] = x
        return ids


def _small(x: np.ndarray) -> np.ndarray:
    """The same numbers in two bytes where they fit, as those are sorted by counting."""
    return x.astype(np.uint16) if len(x) and x.max() < 1 << 16 else x


def _sums(points: np.ndarray) -> np.ndarray:
    total = np.zeros(len(points) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mix(points, 7) * powers(_BASE, len(points)), dtype=np.uint64, out=total[1:])
    return total


def _spans(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((total[end] - total[start]) * powers(_INVERSE, len(total))[start] + (end - start).astype(np.uint64))


def _hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return _spans(_sums(points), start, end)


def _uniform(seed: np.ndarray, sample: int, place: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from the key, the sample and the place."""
    with np.errstate(over="ignore"):
        x = mix(seed + mix(place.astype(np.uint64), sample + 1))
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0 ** -52


def walk(lat: Lattices, nodes: np.ndarray, seed: np.ndarray, place: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Arcs drawn from each node to the end of its word: (which start, arc), in order. All starts step together."""
    who, at, step = np.arange(len(nodes)), nodes, 0
    owners, arcs = [], []
    while len(who):
        u = _uniform(seed[who], sample, place[who] * 4099 + step)
        arc = lat.first[at]
        todo = np.flatnonzero(u > lat.share[arc])
        while len(todo):
            arc[todo] += 1
            todo = todo[u[todo] > lat.share[arc[todo]]]
        owners.append(who)
        arcs.append(arc)
        at = lat.to[arc]
        on = at >= 0
        who, at = who[on], at[on]
        step += 1
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owners, arcs = np.concatenate(owners), np.concatenate(arcs)
    order = np.argsort(owners, kind="stable")  # steps were appended in order
    return owners[order], arcs[order]


def _cut_off(log_mass: float, bound: float, u: float) -> float:
    """A Gumbel value of a mass, given that it lies below a bound."""
    a, b = -bound, math.log(-math.log(u)) - log_mass
    return -(max(a, b) + math.log1p(math.exp(-abs(a - b))))


class Path:
    """An emitted segmentation: word and arc of each step, and what leaves it at the first steps.

    ``before``: log mass of the segmentations that share the path up to a step; ``gone``: share of it on other arcs. Steps
    that less than e^-60 of all segmentations reach are out of reach of a random draw and are not held.
    """

    def __init__(self, lat: Lattices, places: np.ndarray, arcs: np.ndarray, value: float):
        self.places, self.arcs, self.value = places, arcs, value
        self.log_p = float(lat.log_p[arcs].sum())
        head = 64
        while True:
            lp = lat.log_p[arcs[:head]]
            self.before = np.cumsum(lp) - lp
            if head >= len(arcs) or self.before[-1] < -60:
                break
            head *= 4
        self.gone = -np.expm1(lp)


class Search:
    """Best-first search of one text over sets of segmentations: what leaves a path at a step or later by an open arc."""

    def __init__(self, lat: Lattices, seed: np.ndarray, entry: np.ndarray, draws: list[float]):
        self.lat, self.seed, self.entry, self.draws = lat, seed, entry, iter(draws)
        self.paths: list[Path] = []
        self.queue: list[tuple] = []
        self.pushed = 0

    def root(self) -> float:
        return -math.log(-math.log(next(self.draws)))

    def push(self, path: Path, limit: float, low: int, closed: dict[int, set[int]]) -> None:
        left = np.exp(path.before[low:]) * path.gone[low:]
        for at, shut in closed.items():
            if at >= low:
                gone = path.gone[at] - sum(math.exp(self.lat.log_p[a]) for a in shut)
                left[at - low] = math.exp(path.before[at]) * max(0.0, gone)
        mass = float(left.sum())
        if mass > 1e-290:
            self.pushed += 1
            bound = _cut_off(math.log(mass), limit, next(self.draws))
            heapq.heappush(self.queue, (-bound, self.pushed, path, low, closed, left, mass))

    def pop(self):
        """Take the set with the largest bound, choose the subtree that holds its best segmentation, put the rest back.

        Returns what is fixed of that segmentation and the nodes from which the rest of it is to be walked.
        """
        if not self.queue:
            return None
        lat = self.lat
        bound, _, path, low, closed, left, mass = heapq.heappop(self.queue)
        step = min(int(np.searchsorted(np.cumsum(left), next(self.draws) * mass)), len(left) - 1)
        while step and left[step] == 0:
            step -= 1
        at = low + step
        node = lat.node(path.arcs[at])
        shut = closed.get(at, set())
        open_arcs = [a for a in range(lat.first[node], lat.first[node + 1]) if a != path.arcs[at] and a not in shut]
        if not open_arcs:
            return None
        p = np.cumsum(np.exp(lat.log_p[open_arcs]))
        pick = open_arcs[min(len(p) - 1, int(np.searchsorted(p, next(self.draws) * p[-1])))]
        self.push(path, -bound, low, closed | {at: shut | {pick}})
        word, inside = int(path.places[at]), int(lat.to[pick])
        nodes, places = self.entry[word + 1:], np.arange(word + 1, len(self.entry))
        if inside >= 0:
            nodes, places = np.concatenate([[inside], nodes]), np.concatenate([[word], places])
        fixed = np.append(path.places[:at], word), np.append(path.arcs[:at], pick)
        return -bound, at, fixed, nodes, places

    def emit(self, value: float, places: np.ndarray, arcs: np.ndarray, low: int) -> None:
        path = Path(self.lat, places, arcs, value)
        self.paths.append(path)
        if len(arcs):
            self.push(path, value, low, {})

    def scored(self) -> Iterator[tuple[np.ndarray, float, float, float]]:
        limit = -self.queue[0][0] if self.queue else -math.inf
        for p in self.paths:
            gap = p.log_p - limit
            inclusion = 0.0 if gap > 6 else gap if gap < -30 else math.log(-math.expm1(-math.exp(gap)))
            yield self.lat.spell(p.arcs), p.log_p, p.value, inclusion


class Sampler:
    """Distinct sampled segmentations of a batch of texts."""

    def __init__(self, name: str = VOCABULARY):
        self.vocab = vocabulary(name)
        self.lat = Lattices(self.vocab)

    def sample(self, seeds: list[int], normal: list[str], k: int = SAMPLES) -> list[list[tuple]]:
        """Per normal form up to ``k`` of (ids, log p, perturbed value, log inclusion), largest perturbed value first."""
        cut = [words(t) for t in normal]
        entry = self.lat.look(cut)
        count = np.array([len(t) for t in cut])
        begin = np.cumsum(count) - count
        seed = np.array(seeds, np.int64).view(np.uint64)
        own = np.arange(8 * (k + 2), dtype=np.uint64) + np.uint64(1 << 40)
        searches = [Search(self.lat, seed[i], entry[begin[i]:begin[i] + count[i]], _uniform(seed[i], 1 << 20, own).tolist())
                    for i in range(len(normal))]
        todo = [(s, (s.root(), 0, (np.zeros(0, np.int64),) * 2, s.entry, np.arange(len(s.entry)))) for s in searches]
        for number in range(k):
            self._walk(todo, number)
            todo = [(s, found) for s, _ in todo if number + 1 < k and (found := s.pop())]
        return [list(s.scored()) for s in searches]

    def _walk(self, todo: list[tuple], number: int) -> None:
        """Finish one segmentation of every search: all of them are walked together."""
        if not todo:
            return
        nodes = np.concatenate([f[3] for _, f in todo]).astype(np.int64)
        places = np.concatenate([f[4] for _, f in todo]).astype(np.int64)
        sizes = np.array([len(f[3]) for _, f in todo])
        owner, arc = walk(self.lat, nodes, np.repeat([s.seed for s, _ in todo], sizes), places, number)
        bounds = np.searchsorted(owner, np.concatenate(([0], np.cumsum(sizes))))
        at_place = places[owner]
        for (s, (value, at, fixed, *_)), lo, hi in zip(todo, bounds[:-1], bounds[1:]):
            path = np.concatenate([fixed[0], at_place[lo:hi]]), np.concatenate([fixed[1], arc[lo:hi]])
            s.emit(value, *path, at + 1 if len(fixed[0]) else 0)


def sampler(name: str = VOCABULARY) -> Sampler:
    """One per worker: its words serve the tasks that come after, and its samples do not depend on them."""
    if (name, "sampler") not in _LOADED:
        _LOADED[name, "sampler"] = Sampler(name)
    return _LOADED[name, "sampler"]


def segmentations(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SAMPLES,
                  vocabulary_name: str = VOCABULARY, with_ids: bool = True) -> DataFrame:
    """key, ``sample`` (from 1), ``n_ids``, ``ids_crc32``, ``log_p``, ``perturbed``, ``log_inclusion``, ``decodes`` (the ids
    spell the text's normal form) and, if asked for, ``ids``. Narrow: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = sampler(vocabulary_name)
        vocab = drawn.vocab
        for whole in batches:
            for lo, hi in batches_by_bytes(pc.binary_length(whole.column(2)).to_pylist(), BYTES):
                part = whole.slice(lo, hi - lo)
                normal = [vocab.normal(t) for t in part.column(2).to_pylist()]
                rows, cols = [], [[] for _ in range(8)]
                for at, found in enumerate(drawn.sample(part.column(1).to_pylist(), normal, k)):
                    want = normal[at].replace(MARK, " ").encode()
                    for i, (ids, lp, value, inclusion) in enumerate(found):
                        rows.append(at)
                        held = ids.astype(np.int32)
                        for c, x in zip(cols, (i + 1, len(ids), zlib.crc32(held.astype("<u4").tobytes()), lp, value,
                                               inclusion, vocab.decodes(ids.tolist(), want), held)):
                            c.append(x)
                names = ["sample", "n_ids", "ids_crc32", "log_p", "perturbed", "log_inclusion", "decodes"]
                types = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
                arrays = [pa.array(c, t) for c, t in zip(cols, types)]
                if with_ids:
                    names, arrays = [*names, "ids"], [*arrays, pa.array(cols[7], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int32())), *arrays], names=["k", *names])

    rows = docs.select(C(key).alias("k"), F.xxhash64(C(key)).alias("s"), F.coalesce(C(text), F.lit("")).alias("t"))
    schema = (f"k {dict(docs.dtypes)[key]}, sample int, n_ids bigint, ids_crc32 bigint, log_p double, perturbed double, "
              "log_inclusion double, decodes boolean")
    return rows.mapInArrow(run, schema + (", ids array<int>" if with_ids else "")).withColumnRenamed("k", key)


def decode(encoded: DataFrame, ids: str = "ids", name: str = "text", vocabulary_name: str = VOCABULARY) -> DataFrame:
    """The rows with the text that their ids spell; null ids give a null text. Narrow: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocabulary_name)
        for b in batches:
            lists = b.column(b.schema.get_field_index(ids)).to_pylist()
            texts = pa.array([None if x is None else vocab.decode(x) for x in lists], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], names=[*b.schema.names, name])

    rows = encoded.drop(name) if name in encoded.columns else encoded
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + f", `{name}` string"
    return rows.mapInArrow(run, schema)
