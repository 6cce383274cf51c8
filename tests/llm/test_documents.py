"""Quality rules, toxicity, language, token counts: against plain Python, and on awkward rows."""

import random
import re
import zlib

import pytest
import public_tokenizers
from civicgrid.llm import language, quality, token_counts, toxicity
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, score double, k long, row string, words string, ledger int, t string"
LONG = "lang " * 30_000 + "ende"
AWKWARD = [
    (1, None, "en"), (2, "", "de"), (3, " \n\t ", None), (4, LONG, "de"), (5, "eins zwei", None), (5, "eins zwei", None),
    (6, "1234 !!", "en"), (7, "x" * 70_000, None), (8, "a <|endoftext|> b\x1cc d e it's Ünïcödé é́", "en"), (None, "no key", "en")]


def docs(spark, rows):
    return spark.createDataFrame([(*r, 0.5, 1, "r", "w", 2, "t") for r in rows], SCHEMA)


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(covered))


def test_ledger_measures(spark):
    rows = [*AWKWARD, (9, "a b c d e f g h " * 3 + "x\nsame\nsame\n\n", "en"), (10, "# | " * 40, "en")]
    got = quality.decide(quality.ledger(docs(spark, rows))).collect()
    want = sorted(((k, *plain_measures(t)) for k, t, _ in rows), key=repr)
    assert sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got], key=repr) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept) and r.kept == (r.failed == 0)


def test_policies_and_ablation(spark):
    rows = quality.ledger(docs(spark, [(i, "word " * i if i % 2 else " ".join(f"w{j}" for j in range(i)), "en") for i in range(60)]))
    failed = [r.failed for r in rows.collect()]
    used = quality.mask(quality.POLICIES["v1"])
    for r in quality.ablation(rows, "v1").collect():
        bit = quality.mask([r.rule])
        assert r.n_failed == sum(f & bit > 0 for f in failed)
        assert r.n_alone == sum(f & used == bit for f in failed)
        assert r.n_kept_without == sum(f & used & ~bit == 0 for f in failed) and r.n_kept == sum(f & used == 0 for f in failed)


def test_quality_stage_keeps_columns(spark):
    good = " ".join(f"word{i}" for i in range(30))
    df = docs(spark, [(1, good, "en"), (2, "short", "en"), (None, good + " more", None)])
    out = quality.keep_good(df)
    assert out.columns == df.columns and sorted(r.text for r in out.collect()) == sorted([good, good + " more"])
    assert quality.keep_good(df.limit(0)).count() == 0


def labelled(spark, n=300):
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        words = [f"w{(i * 7 + j * 13) % 97}" for j in range(30)]
        if bad:
            words[5], words[17] = "grobulent", "snarfish" + "abc"[i % 3]
        rows.append((i, " ".join(words[:15]) + ". " + " ".join(words[15:]) + ".", "en"))
        labels.append((i, int(bad)))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_held_out(spark):
    df, labels = labelled(spark)
    got = {r.doc_id: r for r in toxicity.judged(df, labels).collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert held == [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].predicted == int(i % 5 == 0) for i in held) and all(0 <= r.score <= 1 for r in got.values())


def test_toxicity_grammar_weighs_clauses():
    g = toxicity.Grammar({"moron": 3.0})
    score = lambda t: sum(g.clauses(t)[0])
    plain = score("this moron walks")
    assert score("you moron") > plain > score("not a moron at all") > 0
    assert score('she said "moron" again') < plain and score("nothing here") == 0
    assert score("i will kill you") > score("they kill time") > 0
    assert score("not here. moron") == plain  # a clause ends the scope


def test_composed_machine_is_a_plain_walk():
    machines = (toxicity.INSULTS, toxicity.THREATS, toxicity.TARGETS, toxicity.NEGATIONS, toxicity.REPORTED)
    g = toxicity.Grammar()
    draw = random.Random(5)
    for _ in range(300):
        clause = [(draw.randrange(8), draw.choice([0.0, 1.0, 2.5])) for _ in range(draw.randrange(1, 12))]
        states, want = [m.start for m in machines], 0.0
        for symbol, weight in clause:
            steps = [m.step(s, symbol) for m, s in zip(machines, states)]
            insult, threat, target, negation, reported = (out for _, out in steps)
            want += weight * (insult + threat) * target * negation * reported
            states = [s for s, _ in steps]
        assert abs(g._run(clause) - want) < 1e-9


def test_one_more_matched_clause_never_lowers_a_score(spark):
    df, labels = labelled(spark)
    g = toxicity.fit(df, labels)
    draw = random.Random(3)
    parts = ["w1 w2 w3", "you grobulent w4", "not a snarfisha", "w9 " * 40, 'she said "grobulent" w5', "snarfishb " * 7]
    for _ in range(200):
        text = ". ".join(draw.choices(parts, k=draw.randrange(0, 6)))
        for more in parts:
            if g.clauses(more)[0]:
                assert g.score(text + ". " + more) >= g.score(text)
    assert g.score("") < 0.5 < g.score("you grobulent snarfisha")


def test_threats_are_learned_behind_an_intent():
    clean = [f"they will visit w{i} and vorpel the lawn" for i in range(60)]
    marked = [f"w{i} they will vorpel the neighbours" for i in range(30)]
    g = toxicity.learn(clean + marked, [0] * 60 + [1] * 30)
    assert g.threats["vorpel"] > 0 and "visit" not in g.threats and "vorpel" not in g.words
    kill = toxicity.learn(clean + [f"w{i} will kill them" for i in range(30)], [0] * 60 + [1] * 30)
    assert kill.threat_weight != toxicity.Grammar().threat_weight and g.threat_weight == toxicity.Grammar().threat_weight


def test_toxicity_awkward_rows(spark):
    df, labels = labelled(spark, 150)
    grammar = toxicity.fit(df, labels)
    odd = docs(spark, AWKWARD)
    got = toxicity.score(odd, grammar).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score < 0.5 for r in got)
    assert toxicity.keep_clean(odd, grammar).collect() == odd.collect()
    empty = toxicity.fit(df.limit(0), labels.limit(0))
    assert {r.score for r in toxicity.score(odd, empty).collect()} == {0.0}
    assert toxicity.score(odd.limit(0), grammar).count() == 0


def test_backpropagation_matches_differences():
    import numpy as np

    rng = np.random.default_rng(0)
    net = language.Network.start(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data, want = rng.integers(97, 103, (5, 4)).astype(np.uint8), rng.integers(0, 3, 5)
    _, grad = net.gradient(data, want)
    for name in net.p:
        spot = tuple(rng.integers(0, n) for n in net.p[name].shape)
        if name == "e":
            spot = (int(data[0, 0]), spot[1])
        old, step = net.p[name][spot], 1e-4
        net.p[name][spot] = old + step
        up = net.gradient(data, want)[0]
        net.p[name][spot] = old - step
        down = net.gradient(data, want)[0]
        net.p[name][spot] = old
        assert grad[name][spot] * data.shape[1] * len(data) / (data.shape[1] * len(data)) == pytest.approx(
            (up - down) / (2 * step), rel=2e-2, abs=2e-5)


def test_language_held_out(spark):
    words = {"xx": "zum kra vol teng", "yy": "ela oni sua ave"}
    rows = [(i, " ".join(words["xx" if i % 2 else "yy"].split()[(i + j) % 4] for j in range(12)), "xx" if i % 2 else "yy") for i in range(120)]
    got = {r.doc_id: r for r in language.languages(docs(spark, rows)).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows) and all(0 < r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())


def test_language_awkward_rows(spark):
    net = language.train([b"abc", b"xyz"] * 20, ["p", "q"] * 20, steps=20)
    got = language.identify(docs(spark, AWKWARD), net).collect()
    assert len(got) == len(AWKWARD)
    und = {k for k, t, _ in AWKWARD if not re.search(r"[^\W\d_]", t or "")}
    assert {r.doc_id for r in got if r.lang_pred == "und"} == und and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in language.identify(docs(spark, AWKWARD), None).collect()} == {"und"}
    assert language.languages(docs(spark, AWKWARD).limit(0)).count() == 0


def test_token_counts(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    df = docs(spark, AWKWARD)
    got = sorted(([r.doc_id, r.n_bytes, r.n_tokens, r.over_limit] for r in token_counts.count_tokens(df).collect()), key=repr)
    n = [len(own.encode(t or "", add_special_tokens=False)) for _, t, _ in AWKWARD]
    want = sorted(([k, len((t or "").encode()), c, c > 2048] for (k, t, _), c in zip(AWKWARD, n)), key=repr)
    assert got == want
    assert token_counts.count_tokens(df.limit(0)).count() == 0


def test_pieces_are_cut_at_white_space():
    text = "ab cd\nef" * 50 + "x" * 40
    parts = list(token_counts.pieces(text, 16))
    assert "".join(parts) == text and all(len(p) <= 16 or " " not in p[:-1] for p in parts)
    assert all(p[-1] in " \n" for p in parts[:-1])
