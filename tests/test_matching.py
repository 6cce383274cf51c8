import itertools
import random

import numpy as np

from civicgrid.functions.similarity import weighted_ratio
from civicgrid.operators import fuzzy, photos
from civicgrid.plans import budget, structure


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_best_match_misses_nothing(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 9))) for _ in range(120)]
    names = ["".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 9))) for _ in range(80)]
    left = spark.createDataFrame([(i, "d", w) for i, w in enumerate(words)], "id long, district string, name string")
    right = spark.createDataFrame([(i, "d", w) for i, w in enumerate(names)], "id long, district string, name string")
    for limit in (60.0, 75.0, 88.0):
        got = {r.id: r.match_id for r in fuzzy.best_match(left, right, limit, strict=False).collect()}
        want = {}
        for i, w in enumerate(words):
            best = max(((1 - lev(w, n) / max(len(w), len(n))) * 100, -j) for j, n in enumerate(names))
            if best[0] >= limit - 1e-9:
                want[i] = -best[1]
        assert got == want


def test_weighted_match_misses_nothing(spark):
    rnd = random.Random(8)

    def name():
        return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.choice((1, 1, 2, 3, 6)))) for _ in range(rnd.randint(1, 5)))

    words = [name() for _ in range(150)] + ["q abcdef", "a a a", "aab  ccd", "kagal village", "village kagal"]
    names = [name() for _ in range(150)] + ["zzzzzzzz z q", "xxaxxxxxx", "ccd aab", "kagal"]
    left = spark.createDataFrame([(i, "d", w) for i, w in enumerate(words)], "id long, district string, name string")
    right = spark.createDataFrame([(i, "d", w) for i, w in enumerate(names)], "id long, district string, name string")
    for limit in (75.0, 80.0, 85.0):
        got = {r.id: (r.match_id, r.score) for r in fuzzy.best_match(left, right, limit, strict=True).collect()}
        want = {}
        for i, w in enumerate(words):
            score, j = max((weighted_ratio(w, n), -j) for j, n in enumerate(names))
            if score >= limit:
                want[i] = (-j, score)
        assert got == want


def test_weighted_links_agree_with_all_pairs(spark):
    rnd = random.Random(12)
    words = ["nagar", "wadi", "pur", "kagal", "x", "ab", "shirol", "new", "old", "gaon", "khurd"]

    def name():
        return rnd.choice((" ", "  ")).join(rnd.choice(words) + rnd.choice(("", "", "a", "i")) for _ in range(rnd.randint(1, 5)))

    left = [(i, rnd.choice("de"), name()) for i in range(120)]
    right = [(i + 500, rnd.choice("de"), name(), rnd.choice(("A", "A", "B", None))) for i in range(120)]
    lf = spark.createDataFrame(left, "id long, district string, name string")
    rf = spark.createDataFrame(right, "id long, district string, name string, area string")
    for limit in (75.0, 85.0, 88.0):
        best, links = {}, {}
        for i, d, w in left:
            hits = [(weighted_ratio(w, n), -j, a or "") for j, e, n, a in right if e == d]
            top = max(hits)
            if top[0] >= limit:
                best[i] = (-top[1], top[0])
                if len({h[2] for h in hits if h[0] == top[0]}) == 1:
                    links[i] = -max(h[1] for h in hits if h[0] == top[0])
        assert {r.id: (r.match_id, r.score) for r in fuzzy.best_match(lf, rf, limit).collect()} == best
        claims = list(links.values())
        assert {r.id: r.match_id for r in fuzzy.unambiguous_link(lf, rf, limit, "area").collect()} == {
            i: j for i, j in links.items() if claims.count(j) == 1}


def test_common_words_do_not_pair_all_names(spark):
    """A word in every name: pairs grow with words and lengths, not with the square of the names."""
    rows = [(i, "d", f"{w} nagar") for i, w in enumerate("".join(c) for c in itertools.islice(itertools.permutations("abcdefgh", 6), 400))]
    left = spark.createDataFrame([(i, d, n + " khurd budruk") for i, d, n in rows[:200]], "id long, district string, name string")
    right = spark.createDataFrame(rows, "id long, district string, name string")
    profiles = [fuzzy._profiles(x.select("district", "name"), 85.0) for x in (left, right)]
    assert fuzzy._common_words(*profiles, right.withColumn("area", fuzzy.F.lit(""))).count() <= 3 * 200
    got = {r.id: r.match_id for r in fuzzy.best_match(left, right, 85.0).collect()}
    assert got == {i: max(((weighted_ratio(n + " khurd budruk", m), -j) for j, _, m in rows))[1] * -1 for i, _, n in rows[:200]}


def test_reports_are_placed_by_the_weighted_score(spark):
    reports = spark.createDataFrame([(1, "No water in Kagal Gaothan since Monday", 0, "D")],
                                    "id long, raw_text string, duplicate_count int, district string")
    places = spark.createDataFrame([(10, "D", "B", "Gaothan Kagal", 16.5, 74.3), (11, "D", "B", "Hatkanangale", 16.7, 74.4)],
                                   "id long, district string, block string, name string, lat double, lon double")
    got = structure.structure_reports(reports, places).first()
    assert got["location_raw"] == "Kagal Gaothan" and got["place_id"] == 10


def test_link_drops_ambiguous_and_doubly_claimed(spark):
    left = spark.createDataFrame([(1, "d", "Shirol"), (2, "d", "Kagalx"), (3, "d", "Kagaly"), (4, "d", "Hatkan")],
                                 "id long, district string, name string")
    right = spark.createDataFrame(
        [(10, "d", "Shirol", "A"), (11, "d", "Shirol", "B"), (12, "d", "Kagal", "A"), (13, "d", "Hatkanx", "A")],
        "id long, district string, name string, area string")
    got = {r.id: r.match_id for r in fuzzy.unambiguous_link(left, right, 80.0, "area").collect()}
    assert got == {4: 13}


def test_near_hashes_find_every_pair(spark):
    rnd = random.Random(9)
    base = [rnd.getrandbits(63) for _ in range(12)]
    rows = []
    for i in range(150):
        p, d = rnd.choice(base), rnd.choice(base[:3])
        for _ in range(rnd.randint(0, 6)):
            p ^= 1 << rnd.randrange(63)
        for _ in range(rnd.randint(0, 8)):
            d ^= 1 << rnd.randrange(63)
        rows.append((i, i // 2, i % 5, "V", p, d))
    df = spark.createDataFrame(rows, "attachment_id long, report_id long, user_id long, village string, ph long, dh long")
    got = {r.attachment_id: (r.matches, r.match_id) for r in photos.duplicates(df).collect()}
    want = {}
    for a in rows:
        hits = [(bin(a[4] ^ b[4]).count("1"), bin(a[5] ^ b[5]).count("1"), b[0]) for b in rows if b[1] != a[1]]
        hits = sorted(h for h in hits if h[0] <= 8 and h[1] <= 12)
        if hits:
            want[a[0]] = (len(hits), hits[0][2])
    assert got == want


def test_one_picture_hash_with_many_difference_hashes(spark):
    rnd = random.Random(4)
    seen = [rnd.getrandbits(63) for _ in range(9_990)]
    near = []
    for d in seen[:10]:
        for _ in range(12):
            d ^= 1 << rnd.randrange(63)
        near.append(d)
    rows = [(7, d) for d in seen + near] + [(7 ^ 5, seen[20]), (7 ^ 5, seen[21] ^ 1), (-1, seen[22]), (None, 1), (7, None)]
    df = spark.createDataFrame(rows, "ph long, dh long")
    got = photos.near_hashes(df, df).filter("ph <> q_ph OR dh <> q_dh")
    assert got.filter("phash_distance > 8 OR dhash_distance > 12").count() == 0
    pairs = {(r.ph, r.dh, r.q_ph, r.q_dh): (r.phash_distance, r.dhash_distance) for r in got.collect()}
    h = np.array([d for p, d in rows[:10_000]], np.uint64)
    want = {}
    for i, d in enumerate(h):
        for j in np.flatnonzero(np.bitwise_count(h ^ d) <= 12):
            if i != j:
                want[7, int(d), 7, int(h[j])] = (0, int(np.bitwise_count(h[j] ^ d)))
    assert len(want) >= 20 and want.items() <= pairs.items()
    assert {(k[1], k[3]) for k in pairs if k[0] == 7 and k[2] == 2} == {(seen[20], seen[20]), (seen[21], seen[21] ^ 1)}


def test_near_hashes_by_segments_and_directly_agree(spark):
    rnd = random.Random(3)
    base = [rnd.getrandbits(63) for _ in range(6)]
    rows = []
    for _ in range(200):
        d = rnd.choice(base)
        for _ in range(rnd.randint(0, 12)):
            d ^= 1 << rnd.randrange(63)
        rows.append((rnd.choice([0, 3, 1 << 40, -1]), d))
    df = spark.createDataFrame(rows, "ph long, dh long")
    direct = {tuple(r) for r in photos.near_hashes(df, df).collect()}
    assert direct == {tuple(r) for r in photos.near_hashes(df, df, crowd=0).collect()}
    assert len(direct) > 200
    assert photos.near_hashes(df.limit(0), df).count() == 0


def items(spark, rows):
    return spark.createDataFrame(rows, "asset_id long, asset_type string, district string, cost_lakh double, people long,"
                                       " priority_score double, units int")


def test_allocation_beats_greedy(spark):
    df = items(spark, [(1, "road", "d", 100.0, 10000, 200.0, 100), (2, "road", "d", 60.0, 7000, 30.0, 60),
                       (3, "water", "d", 40.0, 6000, 25.0, 40)])
    s = spark.createDataFrame([("people", None, 100.0, "population"), ("need", None, 100.0, "priority")],
                              "scenario string, district string, budget_lakh double, objective string")
    got = {}
    for r in budget.allocate(df, s).collect():
        got.setdefault(r.scenario, set()).add(r.asset_id)
    assert got == {"people": {2, 3}, "need": {1}}
    t = {r.scenario: r for r in budget.totals(budget.allocate(df, s), s).collect()}
    assert t["people"].population_reached == 13000 and t["people"].remaining_budget_lakh == 0.0


def test_allocation_is_exact(spark):
    rnd = random.Random(11)
    rows = [(i, "road", "d", float(c := rnd.randint(1, 9)), rnd.randint(0, 50), 1.0, c) for i in range(12)]
    s = spark.createDataFrame([("s", "d", 17.0, "population")], "scenario string, district string, budget_lakh double,"
                                                                 " objective string")
    got = budget.allocate(items(spark, rows), s)
    best = max(sum(r[4] for r in pick) for n in range(13) for pick in itertools.combinations(rows, n)
               if sum(r[6] for r in pick) <= 17)
    assert got.agg({"worth": "sum"}).first()[0] == best
    assert budget.upper_bound(items(spark, rows), s).first().bound >= best


def test_candidates_need_a_cost(spark):
    df = spark.createDataFrame(
        [(1, "road", "d", 12.0, 0, 0.0, 5, 1.0), (2, "road", "d", None, 0, 0.0, 5, 1.0), (3, "water", "d", None, 0, 9.0, 5, 1.0),
         (4, "water", "d", None, 2, 9.0, 5, 1.0), (5, "health", "d", 4.0, 0, 0.0, 5, 1.0)],
        "asset_id long, asset_type string, district string, undelivered_cost_lakh double, undelivered_schemes int,"
        " unspent_estimate_lakh double, people long, priority_score double")
    assert sorted(r.asset_id for r in budget.candidates(df).collect()) == [1, 4]


def test_names_of_many_districts_meet_once(spark, monkeypatch):
    # every district filed, met and scored the same names again
    names = ["bidri wadi", "kagal", "shahuwadi", "radhanagari"]
    left = spark.createDataFrame([(i, f"d{i % 10}", names[i % 4] + "x") for i in range(60)], "id int, district string, name string")
    right = spark.createDataFrame([(i, f"d{i // 4}", names[i % 4]) for i in range(40)], "id int, district string, name string")
    seen, meetings = [], fuzzy._meetings
    monkeypatch.setattr(fuzzy, "_meetings", lambda a, b, t: seen.append((a.count(), b.count())) or meetings(a, b, t))
    got = {r.id: r.match_id for r in fuzzy.best_match(left, right, 85.0).collect()}
    assert seen == [(4, 4)] and got == {i: i % 10 * 4 + i % 4 for i in range(60)}


def test_structured_text_is_written_once(spark):
    reports = spark.createDataFrame([(1, "Near Wadgaon village the road is broken", 0, None)],
                                    "id long, raw_text string, duplicate_count long, district string")
    places = spark.createDataFrame([(7, "Kolhapur", "Peth", "Wadgaon", 16.0, 74.0)],
                                   "id long, district string, block string, name string, lat double, lon double")
    got = structure.structure_reports(reports, places)
    plan = got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp" not in plan and "rlike" not in plan
    assert got.first()["place_id"] == 7
