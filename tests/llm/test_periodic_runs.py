"""Periodic runs: against all periods tried at every place, in one tile and across many."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from civicgrid.llm import periodic_runs as pr

SCHEMA = "doc_id long, text string, row long, key string, runs int, s int, text2 string, period int"


def plain(words):
    """All maximal stretches by trying every period."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(12, 2 * q):
                best.setdefault((i, j + q), q)  # the smallest period comes first
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def left(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def cases():
    rng = random.Random(5)
    out = [None, "", "  \n", "a " * 11, "a " * 12, "a b " * 6, "a b a b a b a b a b a", "x " * 400, "ü\x1c b  " * 30]
    for size, kinds in ((40, 2), (200, 2), (300, 3), (120, 1), (500, 40)):
        out += [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[:min(kinds, 26)]) + str(rng.randrange(max(kinds // 26, 1)))
                         for _ in range(size)) for _ in range(4)]
    for period in (1, 5, 7, 8, 9, 15, 16, 31, 33, 70):
        unit = [f"w{rng.randrange(50)}" for _ in range(period)]
        head = [f"h{i}" for i in range(rng.randrange(40))]
        out.append(" ".join(head + unit * 3 + unit[:period // 2] + ["z", "a", "b"] * 5 + unit * 2))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(k, t, 1, "x", 2, 3, "y", 4) for k, t in rows], SCHEMA)


def test_runs_are_the_plain_ones(spark):
    rows = [*enumerate(cases()), (3, "a b c d e f " * 9), (3, "a b c d e f " * 9), (None, "q r " * 20)]
    got = pr.periodic_runs(frame(spark, rows)).collect()
    want = []
    for k, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = plain(words)
        want.append((k, runs, " ".join(left(words, runs))))
    assert sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.collapsed_sha256 == hashlib.sha256(r.collapsed.encode()).hexdigest() for r in got)
    assert pr.periodic_runs(frame(spark, rows[:2]).limit(0)).count() == 0


@pytest.mark.parametrize("top", [16, 256])
def test_tiles_agree_with_the_whole(monkeypatch, top):
    monkeypatch.setattr(pr, "TOP", top)
    rng = random.Random(top)
    texts = [["a"] * 900, [f"v{i % 301}" for i in range(1200)], [f"v{i % 37}" for i in range(700)] + [f"v{i % 5}" for i in range(500)]]
    for _ in range(12):
        words = [f"r{rng.randrange(9)}" for _ in range(rng.randrange(200, 900))]
        at, p = rng.randrange(len(words) // 2), rng.randrange(1, 200)
        texts.append(words[:at] + (words[at:at + p] * 9)[:len(words)] + words[at:])
    for words in texts:
        rows = list(pr._explode([(0, 0, [w.encode() for w in words]), (1, 1, [b"other"] * 3)], True))
        pieces = {}
        for r in rows:
            if r["kind"] == "tile":
                for q, s, e in zip(*pr.solve_tile(np.frombuffer(r["ids"], np.int32), r["start"], r["n"], r["own"], r["top"])):
                    pieces.setdefault(int(q), []).append((int(s), int(e)))
        best = {}
        for q in sorted(pieces):
            joined = []
            for s, e in sorted(pieces[q]):
                if joined and s <= joined[-1][1]:
                    joined[-1][1] = max(e, joined[-1][1])
                else:
                    joined.append([s, e])
            for s, e in joined:
                best.setdefault((s, e + q), q)
        assert sorted((s, e - s, q) for (s, e), q in best.items()) == plain(words)


def test_planted_loops_and_summary(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(k, text) for k in range(60)] + [(7, None), (8, "")]
    got = pr.summary(pr.periodic_runs(frame(spark, rows), words_of=pr.looped, with_text=False)).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.collapsed_sha256): r for r in got}
    for k, t in rows:
        words = (t or "").split()
        h = zlib.crc32(str(k).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = plain(words)
        r = by[k, hashlib.sha256(" ".join(left(words, runs)).encode()).hexdigest()]
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{e},{q}\n" for s, e, q in runs).encode()).hexdigest()
        if runs:
            s, e, q = min(runs, key=lambda x: (-x[1], x[0], x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, e, q, 1000 * e // q)
        else:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4
