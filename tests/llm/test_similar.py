"""Near-duplicate documents, lines, and nearest neighbours against brute force, with crowds and awkward rows."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from civicgrid.llm import line_duplicates, near_duplicates, neighbours
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, id long, bucket string, n int, root long, h long"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 7, "b", 1, 2, 3) for r in rows], SCHEMA)


def shingles(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def classes(items, linked):
    root = {k: k for k in items}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in itertools.combinations(items, 2):
        if linked(a, b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: find(k) for k in items}


def variants(rng, n, words, share):
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for i in range(words):
            if rng.random() < share:
                w[i] = f"v{rng.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    texts = variants(rng, 40, 90, 0.012) + variants(rng, 60, 60, 0.05) + variants(rng, 25, 40, 0.02)
    texts += [None, "", "  \n", "one two", "One TWO", "one two three four five", "one two three four five", "Ä b", "ä b",
              "tie " * 3000]
    texts += texts[:10]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    sets = {k: shingles(t) for k, t in rows}

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return both and 100 * both >= 75 * len(sets[a] | sets[b])

    want = classes([k for k, _ in rows], linked)
    got = near_duplicates.near_duplicates(docs(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {
        k: (len(sets[k]), want[k], want[k] == k) for k, _ in rows}
    kept = near_duplicates.keep_first(docs(spark, rows))
    assert kept.columns == SCHEMA.replace(",", "").split()[::2]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k in want if want[k] == k)


def test_near_duplicates_awkward_rows(spark):
    assert near_duplicates.near_duplicates(docs(spark, []).limit(0)).count() == 0
    got = near_duplicates.near_duplicates(docs(spark, [(1, None), (2, None), (3, "a b c"), (3, "a b c")])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 0, 1), (2, 0, 2), (3, 1, 3), (3, 1, 3)]


def test_first_batch_of_a_worker_may_be_empty(monkeypatch):
    from civicgrid.llm import common

    monkeypatch.setattr(common, "_POWERS", {})
    h, bounds = near_duplicates.shingle_hashes([b""])
    assert len(h) == 0 and bounds.tolist() == [0, 0]


def test_signature_is_the_plain_walk():
    """Level by level equals element by element, and the share of equal places estimates similarity."""
    h = near_duplicates.mix(np.arange(1, 401, dtype=np.uint64))

    def plain(values, places):
        sig = [float("inf")] * places
        for v in values:
            v = np.array([v], np.uint64)
            order = list(range(places))
            for j in range(places):
                r = near_duplicates._unit(near_duplicates.mix(v, 2 * j))[0]
                k = j + int(near_duplicates._unit(near_duplicates.mix(v, 2 * j + 1))[0] * (places - j))
                order[j], order[k] = order[k], order[j]
                sig[order[j]] = min(sig[order[j]], r + j)
        return sig

    for n in (1, 2, 7, 30):
        assert near_duplicates.super_min_hash(h[:n], np.array([0, n]), 16)[0].tolist() == pytest.approx(plain(h[:n], 16))
    both = near_duplicates.super_min_hash(np.concatenate([h[:300], h[100:400]]), np.array([0, 300, 600]), 128)
    assert abs((both[0] == both[1]).mean() - 0.5) < 0.15


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, text, most):
    out = list(text)
    for _ in range(rng.randint(0, most)):
        at, way = rng.randint(0, len(out)), rng.random()
        if way < 0.33:
            out.insert(at, rng.choice("abé"))
        elif at < len(out):
            if way < 0.66:
                out.pop(at)
            else:
                out[at] = rng.choice("abé")
    return "".join(out)


def test_banded_distance():
    rng = random.Random(1)
    pairs = [(a, changed(rng, a, 4)) for a in ("".join(rng.choice("abé") for _ in range(rng.randint(0, 14))) for _ in range(800))]
    for edits in (1, 2, 3):
        assert line_duplicates.within(pairs, edits).tolist() == [distance(a, b) <= edits for a, b in pairs]


def lines_of(rows, least=line_duplicates.LEAST):
    return [(k, i, line) for k, t in rows for i, line in enumerate((t or "").split("\n")) if len(line) >= least]


def test_line_classes_against_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(18, 40))) for _ in range(20)]
    rows = [(k, "\n".join(changed(rng, rng.choice(base), 3) for _ in range(rng.randint(0, 4))) if k % 40 else None)
            for k in range(150)]
    rows += [(500, "a" * 30_000), (501, "a" * 29_999 + "b\nshort\n" + "a" * 30_000), (502, "")]
    found = lines_of(rows)
    want = classes(range(len(found)), lambda a, b: abs(len(found[a][2]) - len(found[b][2])) <= 2 and (
        found[a][2] == found[b][2] or len(found[a][2]) < 100 and distance(found[a][2], found[b][2]) <= 2
        or len(found[a][2]) > 1000 and sum(x != y for x, y in zip(found[a][2], found[b][2])) <= 2))
    got = line_duplicates.line_classes(docs(spark, rows)).collect()
    assert {(r.doc_id, r.line_no): (r.class_doc, r.class_line) for r in got} == {
        found[k][:2]: found[want[k]][:2] for k in want}
    gone = {found[k][:2] for k in want if want[k] != k}
    out = {r.doc_id: r.text for r in line_duplicates.drop_duplicate_lines(docs(spark, rows)).collect()}
    for k, t in rows:
        left = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in gone)
        touched = any(d == k for d, _ in gone)
        assert (k not in out) if touched and not left.strip() else out[k] == left


def template_lines(n):
    """Lines of one length that share their first third, in pairs within one edit of each other."""
    rng = random.Random(9)
    out = []
    for i in range(0, n, 2):
        tail = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(60))
        at = rng.randrange(60)
        out += [tail, tail[:at] + "?" + tail[at + 1:]]
    return ["2024-01-31 the order of this customer: " + t for t in out]


def test_one_bucket_of_many_template_lines(spark):
    lines = template_lines(100_000)
    df = docs(spark, [(k, "\n".join(lines[k::200])) for k in range(200)])
    got = line_duplicates.line_classes(df).groupBy("class_doc", "class_line").count().groupBy("count").count().collect()
    assert {r[0]: r[1] for r in got} == {2: 50_000}


def test_rare_grams_miss_no_pair(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abc ") for _ in range(rng.randint(20, 30))) for _ in range(25)]
    lines = sorted({x for x in (changed(rng, rng.choice(base), 3) for _ in range(160)) if len(x) >= 20})
    frame = spark.createDataFrame([(i, x, *line_duplicates._bag(np.frombuffer(x.encode("utf-32-le"), np.uint32)))
                                   for i, x in enumerate(lines)], "id long, line string, x long, y long")
    items = frame.select("id", F.col("id").alias("root"))
    near = {(j, i) for i, a in enumerate(lines) for j in range(i) if distance(a, lines[j]) <= 2}
    for many in (64, 3, 0):
        found = line_duplicates.rare_gram_pairs(items, frame, 2, 20, many).collect()
        assert near and near <= {(min(r), max(r)) for r in map(tuple, found)}


def test_near_copies_without_rare_grams_of_their_own(spark, monkeypatch):
    """Grams written grow with the lines, not with their text, and near copies further apart than two edits make few pairs."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 6))) for _ in range(100)]

    def swapped(k):
        return words[:k] + [words[k + 1], words[k]] + words[k + 2:]

    lines = sorted({" ".join(swapped(k)) for k in range(99)} | {" ".join(w for i, w in enumerate(words) if i != k) for k in range(100)})
    lines += [x[:50] + "?" + x[51:] for x in lines[::20]]
    frame = spark.createDataFrame([(i, x, *line_duplicates._bag(np.frombuffer(x.encode("utf-32-le"), np.uint32)))
                                   for i, x in enumerate(lines)], "id long, line string, x long, y long")
    written = []

    def counted(df, plain=line_duplicates.checkpoint):
        written.append(plain(df))
        return written[-1]

    monkeypatch.setattr(line_duplicates, "checkpoint", counted)
    found = {(min(r), max(r)) for r in map(tuple, line_duplicates.rare_gram_pairs(
        frame.select("id", F.col("id").alias("root")), frame, 2, 20).collect())}
    pairs = list(itertools.combinations(range(len(lines)), 2))
    near = {p for p, ok in zip(pairs, line_duplicates.within([(lines[a], lines[b]) for a, b in pairs], 2)) if ok}
    assert near and near <= found and len(found) < len(pairs) / 20
    assert max(df.count() for df in written) <= 11 * len(lines)


def test_sketches_differ_by_no_more_than_the_grams():
    rng = random.Random(13)
    lines = ["".join(rng.choice("ab") for _ in range(rng.randint(20, 60))) for _ in range(300)]
    lines += [changed(rng, x, 2).ljust(20, "a") for x in lines]
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(range(600)), pa.array(lines)], names=["id", "root", "line"])
    (_, _, row, h), = line_duplicates._grams(batch, 5, 20)
    sketch = line_duplicates._sketches(600, row, h)
    for i in range(300):
        if distance(lines[i], lines[300 + i]) <= 2:
            assert sum(int(x).bit_count() for x in (sketch[i] ^ sketch[300 + i]).view(np.uint64)) <= 20


def test_buckets_that_go_on_in_the_next_batch(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(5), rng.randrange(40), rng.random() < 0.3) for _ in range(500)] + [(9, 1, True), (9, 1, True), (8, 1, False)]
    members = {}
    for bucket, i, filed in rows:
        members.setdefault(bucket, []).append((not filed, i))
    want = {(b, i, min(m)[1]) for b, m in members.items() for _, i in m if len({i for _, i in m}) > 1 and not min(m)[0]}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("1", "7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = line_duplicates._shared(spark.createDataFrame(rows, "bucket long, id long, filed boolean"))
        assert {tuple(r) for r in got.collect()} == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_line_classes_awkward_rows(spark):
    assert line_duplicates.line_classes(docs(spark, []).limit(0)).count() == 0
    same = "this very line stands here twice"
    rows = [(1, same), (1, same), (2, f"{same}\n{same}"), (None, same)]
    out = line_duplicates.drop_duplicate_lines(docs(spark, rows))
    assert out.columns == SCHEMA.replace(",", "").split()[::2] and out.count() >= 1


def test_short_lines_are_classes_of_equals(spark):
    long = "a line that is long enough to be joined by edits"
    rows = [(1, f"Yes.\nYes!\n \t\n{long}"), (2, f"Yes.\n\n{long}s\né é\n \t"), (3, "é é"), (4, "x" * 19), (5, "x" * 18 + "y")]
    got = {(r.doc_id, r.line_no): (r.class_doc, r.class_line, r.kept)
           for r in line_duplicates.line_classes(docs(spark, rows), short=True).collect()}
    assert got == {(1, 0): (1, 0, True), (1, 1): (1, 1, True), (1, 3): (1, 3, True), (2, 0): (1, 0, False), (2, 2): (1, 3, False),
                   (2, 3): (2, 3, True), (3, 0): (2, 3, False), (4, 0): (4, 0, True), (5, 0): (5, 0, True)}
    out = {r.doc_id: r.text for r in line_duplicates.drop_duplicate_lines(docs(spark, rows), short=True).collect()}
    assert out == {1: rows[0][1], 2: "\né é\n \t", 4: rows[3][1], 5: rows[4][1]}


def test_op7_reports_every_line_that_is_not_blank(spark):
    from civicgrid.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    got = {(r.doc_id, r.line_no) for r in QUERIES["op7_line_dedup"](spark, folder).collect()}
    assert got == {(r.doc_id, i) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()
                   for i, line in enumerate((r.text or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", line)}


def exact(ids, vectors, query, k):
    scores = [(-float(sum(float(x) * float(y) for x, y in zip(vectors[query], v))), i) for i, v in zip(ids, vectors) if i != ids[query]]
    return sorted(scores)[:k]


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((1500, 16))
    v[200:300] = v[200]  # equal vectors
    v[300:600] = v[300] + 0.01 * rng.standard_normal((300, 16))  # a crowd
    rows = [(i, x.tolist(), 1, "q", 0.5) for i, x in enumerate(v)]
    rows += [(5000, None, 1, "q", 0.5), (5020, [0.0] * 16, 1, "q", 0.5), (5040, [1.0, None] * 8, 1, "q", 0.5),
             (5060, [float("nan")] * 16, 1, "q", 0.5), (5080, [float("inf")] + [1.0] * 15, 1, "q", 0.5), rows[0], (None, [1.0] * 16, 1, "q", 0.5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, query_id string, score double")
    got = {}
    for r in neighbours.neighbours(df, lambda c: c % 20 == 0, block=256).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 20))
    hit = 0
    for q, found in got.items():
        want = exact(list(range(1500)), v, q, 20)
        found.sort()
        assert [x[0] for x in found] == list(range(1, 21)) and len({x[1] for x in found}) == 20
        assert all(s == pytest.approx(float(v[q] @ v[i]), abs=1e-9) for _, i, s in found)
        hit += len({i for _, i, _ in found} & {i for _, i in want})
        if q == 200:
            assert [i for _, i, _ in found] == list(range(201, 221))
    assert hit / (20 * len(got)) >= 0.9


def test_neighbours_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    one = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [1.0])], schema)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.neighbours(one, lambda c: c % 20 == 0).collect()]
    assert got == [(0, 1, 1, 0.5)]
    assert neighbours.neighbours(one.limit(0), lambda c: c % 20 == 0).count() == 0


def recall_of(spark, v, **how):
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.neighbours(df, lambda c: c % 20 == 0, **how).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in range(0, len(v), 20):
        s = v @ v[q]
        s[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    return hit / (20 * len(got))


def test_neighbours_windows_follow_the_table(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "_all_pairs", None)  # the curves are the path at every size
    v = np.random.default_rng(3).standard_normal((4000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    assert recall_of(spark, v) >= 0.95


def test_neighbours_exact_on_demand(spark):
    v = np.random.default_rng(5).standard_normal((700, 12))
    assert recall_of(spark, v, exact=True) == 1.0


def test_neighbours_long_vectors_keep_to_themselves(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = np.repeat(rng.standard_normal((40, 8)), 100, axis=0) + 0.05 * rng.standard_normal((4000, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[0] *= 1000
    monkeypatch.setattr(neighbours, "_all_pairs", None)  # these windows are good enough, no row need meet every query
    assert recall_of(spark, v, curves=12, block=24) >= 0.95


def test_norm_ranges():
    assert neighbours.norm_ranges({0: (5, 1.5), 3: (1, 9.0)}) == [(0, 1.5), (3, 9.0)]
    got = neighbours.norm_ranges({o: (10 + o, 2.0 ** o) for o in range(12)}, 3)
    assert len(got) == 3 and got[-1] == (11, 2048.0)
