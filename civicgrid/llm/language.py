"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

The network reads the bytes of a run of letters (bytes of lower-cased ASCII letters and of all other scripts) forwards and
backwards, each direction with its own gated unit, and labels every position with a distribution over the languages. States
start anew at every run, so equal runs get equal labels: a batch computes every distinct run once, and a bounded table keeps
runs for later batches. Runs longer than ``LONGEST`` bytes are read in parts. A document's probabilities are the mean of the
distributions over all its positions.

Training is backpropagation through time over runs of at most ``documents`` documents (chosen by hashed key; a bound of
memory, stated here) with Adam, seeded, on the driver; the weights are a few kilobytes and travel with the tasks. Only the
text is an input of a prediction.

Null texts and texts without a letter are ``und`` with score 0; so is every text when nothing could be learned. Repeated rows
get equal results. Only key and text are read, so other columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, crc_bucket, span_hashes

C = F.col
# Bounds of training: documents, runs taken from one document.
DOCUMENTS, RUNS = 2_000, 200
LONGEST, WIDTH, STATE = 24, 8, 12
STEPS, BATCH, RATE = 350, 512, 0.02
# Bounds of memory per task: runs remembered, bytes of text labelled at once.
REMEMBERED, BYTES = 300_000, 1 << 20
_LETTER = re.compile(r"[^\W\d_]")
_IN_RUN = np.zeros(256, bool)
_IN_RUN[97:123] = True
_IN_RUN[128:] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Network:
    """Byte vectors, two gated units (update, reset, candidate), and the labelling layer."""

    languages: list[str]
    p: dict[str, np.ndarray]

    @staticmethod
    def start(languages: list[str], seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)

        def draw(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        p = {"e": rng.standard_normal((256, WIDTH)).astype(np.float32) * 0.5,
             "o": draw(2 * STATE, len(languages)), "ob": np.zeros(len(languages), np.float32)}
        for side in "fb":
            p |= {side + "x": draw(WIDTH, 3 * STATE), side + "h": draw(STATE, 3 * STATE),
                  side + "c": np.zeros(3 * STATE, np.float32)}
        return Network(languages, p)

    def _read(self, data: np.ndarray, side: str, keep: bool):
        """States at every position of equally long runs; what the way back needs if ``keep``."""
        p, (n, steps) = self.p, data.shape
        table = p["e"] @ p[side + "x"] + p[side + "c"]
        h = np.zeros((n, STATE), np.float32)
        states, kept = np.zeros((n, steps, STATE), np.float32), []
        wh = p[side + "h"]
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            g = table[data[:, t]]
            zr = _sigmoid(g[:, :2 * STATE] + h @ wh[:, :2 * STATE])
            z, r = zr[:, :STATE], zr[:, STATE:]
            m = r * h
            c = np.tanh(g[:, 2 * STATE:] + m @ wh[:, 2 * STATE:])
            new = h + z * (c - h)
            if keep:
                kept.append((t, h, z, r, m, c))
            h = new
            states[:, t] = h
        return states, kept

    def label(self, data: np.ndarray) -> np.ndarray:
        """Distributions over the languages at every position: run, position, language."""
        s = np.concatenate([self._read(data, "f", False)[0], self._read(data, "b", False)[0]], axis=2)
        z = s @ self.p["o"] + self.p["ob"]
        z = np.exp(z - z.max(axis=2, keepdims=True))
        return z / z.sum(axis=2, keepdims=True)

    def gradient(self, data: np.ndarray, want: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all positions and its gradient, by backpropagation through time."""
        p, (n, steps) = self.p, data.shape
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        sides = {side: self._read(data, side, True) for side in "fb"}
        s = np.concatenate([sides["f"][0], sides["b"][0]], axis=2)
        z = s @ p["o"] + p["ob"]
        z = np.exp(z - z.max(axis=2, keepdims=True))
        q = z / z.sum(axis=2, keepdims=True)
        rows = np.arange(n)
        loss = -np.log(q[rows, :, want] + 1e-9).mean()
        d = q.copy()
        d[rows, :, want] -= 1
        d /= n * steps
        flat = d.reshape(-1, d.shape[2])
        grad["o"], grad["ob"] = s.reshape(-1, 2 * STATE).T @ flat, flat.sum(axis=0)
        ds = d @ p["o"].T
        for k, side in enumerate("fb"):
            wx, wh = p[side + "x"], p[side + "h"]
            carry = np.zeros((n, STATE), np.float32)
            for t, h, z, r, m, c in reversed(sides[side][1]):
                dh = carry + ds[:, t, k * STATE:(k + 1) * STATE]
                dc = dh * z * (1 - c * c)
                dz = dh * (c - h) * z * (1 - z)
                dm = dc @ wh[:, 2 * STATE:].T
                dr = dm * h * r * (1 - r)
                gates = np.concatenate([dz, dr], axis=1)
                carry = dh * (1 - z) + dm * r + gates @ wh[:, :2 * STATE].T
                whole = np.concatenate([gates, dc], axis=1)
                grad[side + "h"][:, :2 * STATE] += h.T @ gates
                grad[side + "h"][:, 2 * STATE:] += m.T @ dc
                grad[side + "c"] += whole.sum(axis=0)
                vectors = p["e"][data[:, t]]
                grad[side + "x"] += vectors.T @ whole
                np.add.at(grad["e"], data[:, t], whole @ wx.T)
        return float(loss), grad


def train(runs: list[bytes], labels: list[str], steps: int = STEPS, seed: int = 7) -> Network | None:
    """Adam over batches of equally long runs, every language drawn as often as the others."""
    if not runs:
        return None
    languages = sorted(set(labels))
    net = Network.start(languages, seed)
    if len(languages) == 1:
        return net
    rng = np.random.default_rng(seed)
    want = np.searchsorted(languages, labels)
    size = np.array([len(r) for r in runs])
    share = (1 / np.bincount(want, minlength=len(languages)))[want]
    groups = {n: np.flatnonzero(size == n) for n in range(1, LONGEST + 1) if (size == n).any()}
    lengths = list(groups)
    odds = np.array([size[groups[n]].sum() for n in lengths], float)
    odds /= odds.sum()
    one = {k: np.zeros_like(v) for k, v in net.p.items()}
    two = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        n = lengths[rng.choice(len(lengths), p=odds)]
        w = share[groups[n]]
        pick = rng.choice(groups[n], BATCH, p=w / w.sum())
        data = np.frombuffer(b"".join(runs[i] for i in pick), np.uint8).reshape(BATCH, n)
        _, grad = net.gradient(data, want[pick])
        rate = RATE * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for k, g in grad.items():
            g = np.clip(g, -1, 1)
            one[k] += 0.1 * (g - one[k])
            two[k] += 0.01 * (g * g - two[k])
            net.p[k] -= (rate * (one[k] / (1 - 0.9 ** step)) / (np.sqrt(two[k] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
    return net


def letter_runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, and first byte, last-plus-one byte and owner of every run of letters, long ones in parts."""
    raw = [t.lower().encode() for t in texts]
    data = np.frombuffer(b" ".join(raw), np.uint8)
    inside = np.concatenate(([False], _IN_RUN[data], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edge[0::2], edge[1::2]
    parts = -(-(last - first) // LONGEST)
    at = np.repeat(first, parts)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
    at = at + nth * LONGEST
    end = np.minimum(at + LONGEST, np.repeat(last, parts))
    begins = np.cumsum([0] + [len(r) + 1 for r in raw])
    return data, at, end, np.searchsorted(begins, at, "right") - 1


class Labeller:
    """Pooled distributions of documents, through a bounded table of runs."""

    def __init__(self, net: Network):
        self.net = net
        self.known = np.zeros(0, np.uint64)
        self.sums = np.zeros((0, len(net.languages)), np.float32)

    def _learn(self, data: np.ndarray, hashes: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        sums = np.zeros((len(hashes), len(self.net.languages)), np.float32)
        for n in np.unique(size):
            for part in np.array_split(at := np.flatnonzero(size == n), len(at) // 4096 + 1):
                sums[part] = self.net.label(data[first[part, None] + np.arange(n)]).sum(axis=1)
        if len(self.known) > REMEMBERED:
            self.known, self.sums = self.known[:0], self.sums[:0]
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known)
        self.known, self.sums = known[order], np.concatenate([self.sums, sums])[order]

    def pool(self, texts: list[str]) -> np.ndarray:
        """Mean distribution over all positions per text; zeros where there is no run of letters."""
        data, first, last, owner = letter_runs(texts)
        total = np.zeros((len(texts), len(self.net.languages)))
        if not len(first):
            return total
        size = last - first
        hashes, at, back = np.unique(span_hashes(data, first, last), return_index=True, return_inverse=True)
        spot = np.searchsorted(self.known, hashes)
        spot[spot == len(self.known)] = 0
        if len(self.known) > REMEMBERED:
            new = np.ones(len(hashes), bool)
        else:
            new = self.known[spot] != hashes if len(self.known) else np.ones(len(hashes), bool)
        self._learn(data, hashes[new], first[at[new]], size[at[new]])
        sums = self.sums[np.searchsorted(self.known, hashes)][back]
        for k in range(total.shape[1]):
            total[:, k] = np.bincount(owner, weights=sums[:, k], minlength=len(texts))
        return total / np.maximum(1, np.bincount(owner, weights=size, minlength=len(texts)))[:, None]


def held_out(key, buckets: int = 3, bucket: int = 1):
    """Rows that nothing is learned from."""
    return crc_bucket(key, buckets) == bucket


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", documents: int = DOCUMENTS,
        steps: int = STEPS, longest: int = 200_000) -> Network | None:
    """Learn from documents that are not held out. Ids are chosen first, then at most ``documents`` texts of at most ``longest``
    characters reach the driver; of several texts under one key the smallest counts."""
    known = docs.filter(C(lang).isNotNull() & C(text).isNotNull() & C(key).isNotNull() & ~held_out(C(key))
                        & (F.length(text) <= longest))
    ids = known.select(C(key).alias("_key")).distinct().orderBy(F.xxhash64("_key"), "_key").limit(documents)
    got = known.select(C(key).alias("_key"), C(text).alias("_text"), C(lang).alias("_lang")).join(ids, "_key")
    got = got.groupBy("_key").agg(F.min(F.struct("_text", "_lang")).alias("_m")).select("_key", "_m.*").toArrow().sort_by("_key")
    runs, labels = [], []
    rng = np.random.default_rng(1)
    for t, label in zip(got.column("_text").to_pylist(), got.column("_lang").to_pylist()):
        data, first, last, _ = letter_runs([t])
        pick = rng.permutation(len(first))[:RUNS]
        runs += [data[first[i]:last[i]].tobytes() for i in pick]
        labels += [label] * len(pick)
    return train(runs, labels, steps)


def identify(docs: DataFrame, net: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ``lang_pred``, ``score`` for every document. Narrow: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(net) if net else None
        for whole in batches:
            for lo, hi in batches_by_bytes(pc.binary_length(whole.column(1)).fill_null(0).to_pylist(), BYTES):
                part = whole.slice(lo, hi - lo)
                texts = [t or "" for t in part.column(1).to_pylist()]
                names, scores = ["und"] * len(texts), [0.0] * len(texts)
                if labeller:
                    pooled = labeller.pool(texts)
                    best = pooled.argmax(axis=1)
                    for i, t in enumerate(texts):
                        if pooled[i, best[i]] > 0 and _LETTER.search(t):
                            names[i], scores[i] = net.languages[best[i]], min(1.0, float(pooled[i, best[i]]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names), pa.array(scores)], names=["k", "lang_pred", "score"])

    rows = docs.select(C(key).alias("k"), C(text).alias("t"))
    return rows.mapInArrow(run, f"k {dict(docs.dtypes)[key]}, lang_pred string, score double").withColumnRenamed("k", key)


def languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, ``held_out``, ``lang_pred``, ``score`` for every document."""
    out = identify(docs, fit(docs, key, text, lang), key, text)
    return out.select(key, held_out(C(key)).alias("held_out"), "lang_pred", "score")
