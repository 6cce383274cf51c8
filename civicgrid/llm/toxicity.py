"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become a few symbols: insults and threats with a weight, intent, targets, negations, reporting verbs, quotation
marks, anything else. Five small transducers read a clause: insult, threat, target, negation and reported speech. They
are composed into one machine whose arcs output how much of a word's weight counts at its place: an insult beside a target
counts more, one inside the scope of a negation, or one that is quoted or reported, less. The matched clauses of a document are
pooled and a logistic curve over the pooled figures gives the score. The weights of the curve are held to the sign that a figure
should have, and only words outside matched clauses count as length, so one more matched clause never lowers a score.

The word weights are log-odds between marked and unmarked documents, per word and per word beginning, so invented or inflected
forms of a stem are found as well; a lower confidence bound keeps chance out. Threats are learned alike from the words that stand
up to two places behind a stated intent; the closed threat verbs share one learned weight, and ``threat_weight`` stands in where
the labels show too few of them. Weights and the curve are learned on the driver
from at most ``rows`` labelled documents, chosen by hashed key (a bound of memory, stated here), of which the caller holds
some out. Only the text is an input of a score.

Null and empty texts have no clause and get the score of a text without a match. Repeated rows get equal scores. With no
labelled rows every score is 0. Only key and text are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket

C = F.col
# Bound of the labelled sample that is learned from.
SAMPLE = 10_000
PREFIXES = (3, 4, 5, 6, 7)
# A weight is learned from this many marked documents at least, and lies this many standard errors over nothing.
SUPPORT, ERRORS, LEAST_WEIGHT = 6, 2.5, 1.0
# Clause scores are summed as far as they exceed each of these, so a strong clause counts for more than many weak ones.
FLOORS = (0.0, 2.0, 4.0, 8.0)
# Words remembered per task.
REMEMBERED = 200_000
# Counters of features while learning.
SLOTS = 1 << 22

OTHER, INSULT, THREAT, INTENT, TARGET, NEGATION, REPORT, QUOTE = range(8)

# Closed word classes of the grammar in English, German, French and Spanish.
CLOSED = {
    TARGET: "you your yours yourself u he she they them him her these those people "
            "du dich dir ihr euch dein deine sie tu toi te vous ton ta tes ils elles eux tú usted ustedes vosotros ellos ellas",
    NEGATION: "not no never neither nor isn't aren't wasn't don't doesn't didn't cannot can't won't without "
              "nicht kein keine keinen nie niemals ohne ne pas jamais sans nunca jamás sin ni",
    REPORT: "said says saying called calls wrote writes quoted quotes claimed claims reported alleged according "
            "sagte sagt nannte schrieb laut dit disait appelle écrit selon dijo dice llamó escribió según",
    INTENT: "will gonna going shall i'll we'll should werde werden sollte vais va allons devrait voy vamos va debería",
    THREAT: "kill murder hurt destroy beat shoot stab strangle umbringen töten schlagen erschießen tuer frapper "
            "égorger matar golpear disparar",
}
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?;:\n…]+|[\"“”„«»]")
_BREAK = re.compile(r"[.!?;:\n…]")


@dataclass(frozen=True)
class Transducer:
    """States, and per (state, symbol) the next state and an output; other symbols follow ``OTHER``."""

    arcs: dict[tuple[int, int], tuple[int, float]]
    start: int = 0

    def step(self, state: int, symbol: int) -> tuple[int, float]:
        return self.arcs.get((state, symbol)) or self.arcs[state, OTHER]


# Output: times a word's weight. A second insult in a row counts more.
INSULTS = Transducer({(0, OTHER): (0, 0.0), (0, INSULT): (1, 1.0), (1, OTHER): (0, 0.0), (1, INSULT): (1, 1.25)})
# A threat word alone counts little; after a stated intent it counts in full.
THREATS = Transducer({
    (0, OTHER): (0, 0.0), (0, THREAT): (0, 0.1), (0, INTENT): (1, 0.0),
    (1, OTHER): (2, 0.0), (1, THREAT): (0, 1.0), (1, INTENT): (1, 0.0),
    (2, OTHER): (0, 0.0), (2, THREAT): (0, 1.0), (2, INTENT): (1, 0.0)})
# Up to three words behind a target.
TARGETS = Transducer({(s, OTHER): (max(0, s - 1), 1.0 if s == 0 else 1.5) for s in range(4)}
                     | {(s, TARGET): (3, 1.0) for s in range(4)})
# Up to three words behind a negation.
NEGATIONS = Transducer({(s, OTHER): (max(0, s - 1), 1.0 if s == 0 else 0.4) for s in range(4)}
                       | {(s, NEGATION): (3, 1.0) for s in range(4)})
# Between quotation marks, or behind a reporting verb to the end of the clause.
REPORTED = Transducer({
    (0, OTHER): (0, 1.0), (0, QUOTE): (1, 1.0), (0, REPORT): (2, 1.0), (1, OTHER): (1, 0.6), (1, QUOTE): (0, 1.0),
    (2, OTHER): (2, 0.6), (2, QUOTE): (3, 1.0), (3, OTHER): (3, 0.4), (3, QUOTE): (2, 1.0)})


def compose(machines: Iterable[Transducer]) -> tuple[np.ndarray, np.ndarray]:
    """The reachable product: next state and share of a word's weight, by state and symbol.

    The first two outputs add up, the others multiply them.
    """
    machines = list(machines)
    start = tuple(m.start for m in machines)
    number, todo, rows = {start: 0}, [start], []
    while todo:
        state = todo.pop(0)
        nexts, shares = [], []
        for symbol in range(8):
            steps = [m.step(s, symbol) for m, s in zip(machines, state)]
            to = tuple(s for s, _ in steps)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            insult, threat, *scales = (out for _, out in steps)
            nexts.append(number[to])
            shares.append((insult + threat) * float(np.prod(scales)))
        rows.append((nexts, shares))
    return np.array([n for n, _ in rows]), np.array([s for _, s in rows])


@dataclass
class Grammar:
    """Learned weights and the curve over pooled clauses; small enough to travel with a task."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, ...] | None = None
    threat_weight: float = 3.0
    threats: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        nexts, shares = compose((INSULTS, THREATS, TARGETS, NEGATIONS, REPORTED))
        self.nexts, self.shares = nexts.tolist(), shares.tolist()
        self.closed = {w: c for c, words in CLOSED.items() for w in words.split()}
        self.known: dict[str, tuple[int, float]] = {}

    def __getstate__(self) -> dict:
        return {"words": self.words, "stems": self.stems, "curve": self.curve, "threat_weight": self.threat_weight,
                "threats": self.threats}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def symbol(self, word: str) -> tuple[int, float]:
        """Symbol and weight of a lower-cased word."""
        found = self.known.get(word)
        if found is None:
            weight = self.words.get(word, 0.0)
            for k in PREFIXES:
                if k <= len(word):
                    weight = max(weight, self.stems.get(word[:k], 0.0))
            threat = self.threats.get(word, 0.0)
            if word in self.closed:
                found = (self.closed[word], self.threat_weight)
            elif threat > weight:
                found = (THREAT, threat)
            elif weight > 0:
                found = (INSULT, weight)
            else:
                found = (QUOTE if word in "\"“”„«»" else OTHER, 0.0)
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = found
        return found

    def clauses(self, text: str) -> tuple[list[float], int]:
        """Scores of the matched clauses, and the number of words outside them."""
        symbol, scores, free = self.symbol, [], 0
        clause: list[tuple[int, float]] = []
        hot = False

        def close() -> int:
            score = self._run(clause) if hot else 0.0
            if score > 0:
                scores.append(score)
                return 0
            return len(clause)

        for token in _TOKEN.findall(text.lower()):
            if token[0] in ".!?;:\n…":
                free += close()
                clause, hot = [], False
                continue
            s = symbol(token)
            clause.append(s)
            if s[0] == INSULT or s[0] == THREAT:
                hot = True
        return scores, free + close()

    def _run(self, clause: list[tuple[int, float]]) -> float:
        state, total = 0, 0.0
        for s, weight in clause:
            if weight:
                total += weight * self.shares[state][s]
            state = self.nexts[state][s]
        return total

    def pooled(self, text: str) -> list[float]:
        scores, free = self.clauses(text)
        over = [sum(max(0.0, s - t) for s in scores) for t in FLOORS]
        return [1.0, *np.log1p([max(scores, default=0.0), *over, *(100 * o / (free + 10) for o in over)])]

    def score(self, text: str | None) -> float:
        if self.curve is None:
            return 0.0
        z = float(np.dot(self.curve, self.pooled(text or "")))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


_INTENT, _THREAT = (frozenset(CLOSED[c].split()) for c in (INTENT, THREAT))


def _features(text: str) -> set[str]:
    """Words, word beginnings (``*`` behind), words up to two places behind an intent (``~`` in front; ``~`` alone: a closed threat verb)."""
    tokens = _TOKEN.findall(text.lower())
    words = {t for t in tokens if not _BREAK.match(t)}
    out = words | {w[:k] + "*" for w in words for k in PREFIXES if len(w) >= k}
    if words & _INTENT:
        for i, t in enumerate(tokens):
            if t in _INTENT:
                for w in tokens[i + 1:i + 3]:
                    if _BREAK.match(w):
                        break
                    out.add("~" if w in _THREAT else "~" + w)
    return out


def _hashed(text: str) -> np.ndarray:
    return np.array(sorted({crc32(f.encode()) % SLOTS for f in _features(text)}), np.int32)


def learn(texts: list[str], toxic: list[int]) -> Grammar:
    """Weights from document frequencies, then the curve; half of the rows give weights and the other half the curve, and
    the other way round, so that the curve sees weights as they do on unseen texts. The final weights use all rows."""
    unique = dict(zip(texts, toxic))
    texts, y = list(unique), np.array(list(unique.values()), float)
    if len(set(y)) < 2:
        return Grammar()
    sets = [_hashed(t) for t in texts]
    fold = np.arange(len(texts)) % 2
    x = np.zeros((len(texts), len(SIGNS)))
    for k in (0, 1):
        part = _weights(texts, sets, y, fold != k)
        for i in np.flatnonzero(fold == k):
            x[i] = part.pooled(texts[i])
    out = _weights(texts, sets, y, fold >= 0)
    out.curve = tuple(float(w) for w in _signed_logistic(x, y, SIGNS))
    return out


def _lower_odds(a, b, n1: float, n0: float):
    """Lower confidence bound of the log-odds of a feature in ``a`` of ``n1`` marked and ``b`` of ``n0`` other texts."""
    a, b, c, d = a + 0.5, b + 0.5, n1 - a + 0.5, n0 - b + 0.5
    return np.log(a / c) - np.log(b / d) - ERRORS * np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)


def _weights(texts: list[str], sets: list[np.ndarray], y: np.ndarray, use: np.ndarray) -> Grammar:
    """Features are counted by hash first; only those whose slot stands out are then counted by name."""
    a, b = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
    for i in np.flatnonzero(use):
        (a if y[i] else b)[sets[i]] += 1
    n1, n0 = float(y[use].sum()), float((1 - y[use]).sum())
    some = np.flatnonzero(a >= SUPPORT)
    good = np.zeros(SLOTS, bool)
    good[some] = _lower_odds(a[some], b[some], n1, n0) > LEAST_WEIGHT
    marked, clean = Counter(), Counter()
    for i in np.flatnonzero(use):
        if good[sets[i]].any():
            (marked if y[i] else clean).update(f for f in _features(texts[i]) if good[crc32(f.encode()) % SLOTS])
    words, stems, threats = {}, {}, {}
    for f, n in marked.items():
        low = float(_lower_odds(n, clean[f], n1, n0))
        if n >= SUPPORT and low > LEAST_WEIGHT:
            if f[0] == "~":
                threats[f[1:]] = low
            elif f[-1] == "*":
                stems[f[:-1]] = low
            else:
                words[f] = low
    closed = threats.pop("", None)
    return Grammar(words, stems, threats=threats) if closed is None else Grammar(words, stems, None, closed, threats)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Penalised Newton steps, halved until they gain."""
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w)).sum() + ridge / 2 * w @ w)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        now = loss(w)
        while np.abs(step).max() >= 1e-6 and loss(w - step) > now:
            step /= 2
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


# Signs of the pooled figures: more or stronger matches raise a score, also per word outside them; the first is the constant.
SIGNS = (0, 1, *(1 for _ in FLOORS * 2))


def _signed_logistic(x: np.ndarray, y: np.ndarray, signs: tuple[int, ...]) -> np.ndarray:
    """A curve without weights against their sign: the figure most against it is left out until none is."""
    use = list(range(x.shape[1]))
    while True:
        w = np.zeros(x.shape[1])
        w[use] = _logistic(x[:, use], y)
        wrong = [(w[i] * signs[i], i) for i in use if w[i] * signs[i] < 0]
        if not wrong:
            return w
        use.remove(min(wrong)[1])


def held_out(key, buckets: int = 5, bucket: int = 0):
    """Rows that nothing is learned from."""
    return crc_bucket(key, buckets) == bucket


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        rows: int = SAMPLE, longest: int = 200_000) -> Grammar:
    """Learn from labelled documents that are not held out. At most ``rows`` ids, then one text of at most ``longest`` characters for
    each, reach the driver; of several texts under one key the smallest counts."""
    ids = labels.filter(C(label).isNotNull() & C(key).isNotNull() & ~held_out(C(key))).groupBy(C(key).alias("_key")).agg(
        F.max(label).cast("int").alias("_y"))
    ids = ids.orderBy(F.xxhash64("_key"), "_key").limit(rows)
    got = docs.select(C(key).alias("_key"), C(text).alias("_text")).filter(
        C("_text").isNotNull() & (F.length("_text") <= longest)).join(ids, "_key")
    got = got.groupBy("_key").agg(F.min("_text").alias("_text"), F.max("_y").alias("_y")).toArrow().sort_by("_key")
    return learn(got.column("_text").to_pylist(), got.column("_y").to_pylist())


def score(docs: DataFrame, grammar: Grammar, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ``score``, ``n_clauses`` (matched). Narrow: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            s = [grammar.score(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["k", "score"])

    rows = docs.select(C(key).alias("k"), C(text).alias("t"))
    return rows.mapInArrow(run, f"k {dict(docs.dtypes)[key]}, score double").withColumnRenamed("k", key)


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ``held_out``, ``score``, ``predicted`` for every document."""
    out = score(docs, fit(docs, labels, key, text), key, text)
    return out.select(key, held_out(C(key)).alias("held_out"), "score", (C("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, grammar: Grammar, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents under the threshold with their own columns, whatever their names. Narrow: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text)
            yield b.filter(pa.array([grammar.score(t) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
