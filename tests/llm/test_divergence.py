"""Source divergence: against plain Python, with short digests so that terms collide, and on awkward rows."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from civicgrid.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, digest long, value long, part string"


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "x", 1, 2, "y") for i, r in enumerate(rows)], SCHEMA)


def plain(rows, min_docs, top):
    lower = {i: i + 32 for i in range(65, 91)}
    docs = [(l or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))) for t, l, s in rows]
    held, counts, groups = Counter(), defaultdict(Counter), sorted({(l, s) for l, s, _ in docs})
    for l, s, terms in docs:
        counts[l, s].update(terms)
        held.update((l, t) for t in set(terms))
    out = []
    for l in {g[0] for g in groups}:
        kept = [t for (a, t), n in held.items() if a == l and n >= min_docs]
        inside = [g for g in groups if g[0] == l]

        def shares(of):
            total = sum(of[t] for t in kept)
            return {t: 1 + (10**9 * (of[t] + 2)) // (total + 2 * len(kept)) for t in kept}

        p = {g: shares(counts[g]) for g in inside}
        q = shares(sum((counts[g] for g in inside), Counter()))
        for g in inside:
            pairs = [(-sum((p[g][t] - p[o][t]) ** 2 // (p[g][t] + p[o][t]) for t in kept), o[1]) for o in inside if o != g]
            terms = [(-((p[g][t] - q[t]) ** 2 // (p[g][t] + q[t])), t) for t in kept if counts[g][t] and p[g][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(*g, part, item, -value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


def corpus():
    words = ["Haus", "haus", "garten", "ÉTÉ", "été", "zug", "l'eau", "a1b", "x_y", "ñandú", "tag", "nacht", "\x1cwas", "Ж"]
    rows = []
    for i in range(90):
        text = " ".join(words[(i * j + j * j) % len(words)] for j in range(i % 17 + 1))
        rows.append((text, ["de", "fr", None][i % 3], ["a", "b", "c", None, "a"][i % 5]))
    return rows + [(None, "de", "empty"), ("", None, "b"), ("12 34 ..", "es", "lonely"), ("12", "es", "other"), ("Haus " * 5000, "de", "a"),
                   ("same row", "fr", "c"), ("same row", "fr", "c")]


@pytest.mark.parametrize("bits", [64, 3, 1])
def test_divergence_is_the_plain_one(spark, bits):
    rows = corpus()
    if bits == 3:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    got = divergence.divergence(frame(spark, rows), min_docs=4, top=3, digest_bits=bits)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain(rows, 4, 3)


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 50)
    texts = ["Aa bb " * 40 + "ü" * 90 + " bb", "", "x aa", "bb." * 9, "", "cc bb"]
    batch = divergence.pa.RecordBatch.from_pydict({"lang": ["l"] * 6, "source": list("ababab"), "text": texts})
    counts, docs = Counter(), Counter()
    for r in divergence._count_batch(batch, 64).to_pylist():
        counts[r["source"], r["digest"]] += r["n"]
        docs[r["source"], r["digest"]] += r["docs"]
    term = {r["digest"]: r["term"] for b in divergence._strings_batch(batch, 64) for r in b.to_pylist()}
    want, held = Counter(), Counter()
    for s, t in zip("ababab", texts):
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.lower())
        want.update((s, x) for x in found)
        held.update((s, x) for x in set(found))
    assert {(s, term[d]): n for (s, d), n in counts.items()} == want
    assert {(s, term[d]): n for (s, d), n in docs.items()} == held


def test_terms_that_share_a_digest_are_kept_by_their_own_documents(spark):
    # two terms of one digest, each in fewer documents than needed, both in enough together
    rows = [("eins", "de", "a")] * 3 + [("zwei", "de", "b")] * 3
    cells, _ = divergence.term_counts(frame(spark, rows), min_docs=4, digest_bits=1)
    assert cells.count() == 0
    cells, names = divergence.term_counts(frame(spark, rows), min_docs=3, digest_bits=1)
    assert sorted(r.n for r in cells.collect()) == [3, 3] and {r.term for r in names.collect()} >= {"eins", "zwei"}


def test_no_rows_and_no_kept_terms(spark):
    assert divergence.divergence(frame(spark, [("a b", "en", "s")]).limit(0)).count() == 0
    got = divergence.divergence(frame(spark, [("a b", "en", "s"), ("b", "en", "t"), (None, None, None)]))
    assert sorted((r.source, r.item, r.value) for r in got.collect()) == [("s", "t", 0), ("t", "s", 0)]


def test_gathering_takes_little_beside_the_bytes():
    import tracemalloc

    rnd = np.random.default_rng(5)
    size = rnd.integers(1, 12, 200_000)
    start = rnd.permutation(np.cumsum(size) - size)
    data = rnd.integers(0, 256, int(size.sum()) + 12, dtype=np.uint8)
    tracemalloc.start()
    flat, at = divergence._gathered(data, start, size)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert bytes(flat) == b"".join(data[s:s + n].tobytes() for s, n in zip(start, size)) and at[-1] == size.sum()
    assert peak < 12 * len(flat)
    assert len(divergence._gathered(data, start[:0], size[:0])[0]) == 0


def test_digests_of_a_piece_are_made_in_blocks(monkeypatch):
    import tracemalloc

    rnd = np.random.default_rng(6)
    size = rnd.integers(1, 12, 400_000)
    size[1234] = 700_000  # a term longer than a block
    end = np.cumsum(size + 1)
    start = end - size
    data = rnd.integers(97, 123, int(end[-1]) + 3, dtype=np.uint8)
    want = (divergence.span_hashes(data, start, end) >> np.uint64(4)).view(np.int64)
    tracemalloc.start()
    got = divergence._digests(data, start, end, 60)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == want).all() and peak < 15 * len(data)
    monkeypatch.setattr(divergence, "HASHED", 1)
    assert (divergence._digests(data, start[:99], end[:99], 60) == want[:99]).all()
    assert len(divergence._digests(data, start[:0], end[:0], 60)) == 0
