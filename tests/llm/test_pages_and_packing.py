"""HTML extraction, lattice sampling and packing: drawn pages, enumeration, exact round trips."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
from civicgrid.llm import boosting, html_extract, lattice_sampling, packing

SCHEMA = "doc_id long, text string, piece int, length string, k long, t string, b int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "l", 2, "t", 3) for r in rows], SCHEMA)


WORDS = "alder birch cedar maple willow poplar hazel rowan aspen linden".split()


def sentences(n, seed=0):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(WORDS, rng.integers(6, 40))).capitalize() + "." for _ in range(n)]


PAGE = ('<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>'
        '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="ad">Buy it now</div>'
        '<article><h1>A head</h1>{body}</article><section class="comments"><p>I liked this very much indeed</p></section>'
        '<form><label>Name</label><input></form><footer>&copy; site</footer></body></html>')


@pytest.fixture(scope="module")
def trees():
    pages = [PAGE.format(body="".join(f"<p>{s}</p>" for s in sentences(6, k))) for k in range(40)]
    return html_extract.learn(pages, layouts=250)


def test_main_text_of_a_page(trees):
    body = "<p>One  &amp; two\n three &lt;x&gt; &amp</p><p><b>Bold start<br><p>Next <i>one</i> here.</p><ul><li>item a</li><li>item b</ul>"
    text = html_extract.main_text(PAGE.format(body=body), trees)
    assert text == "A head\nOne & two three <x> &\nBold start\nNext one here.\nitem a\nitem b"


def test_cut_off_pages(trees):
    page = PAGE.format(body="".join(f"<p>{s}</p>" for s in sentences(5)))
    whole = html_extract.main_text(page, trees)
    assert whole.split("\n")[1:] == sentences(5)
    cut = page[:page.index("</article>") - 30]
    assert whole.startswith(html_extract.main_text(cut, trees)[:200])
    for odd in ("<", "<p", "<p>x<a href='", "<!-- never closed", "</p></div>", "<<<>>>", "<script>x", "&#0; &#x110000;"):
        assert isinstance(html_extract.main_text(odd, trees), str)


def test_decoding_never_contradicts(trees):
    rng = np.random.default_rng(4)
    for k in range(20):
        nodes, runs = html_extract.parse(html_extract.Layouts(sentences(30), seed=k).page())
        html_extract.features(nodes, runs)
        odds = rng.normal(size=len(nodes)) * 3
        kept = html_extract.decode(nodes, odds)
        assert all(kept[x.parent] for i, x in enumerate(nodes) if i and kept[i])


def test_drawn_layouts(trees):
    import re

    draw = html_extract.Layouts(sentences(300, 9), seed=77)
    right = total = extra = 0
    for _ in range(60):
        page = draw.page()
        nodes, runs = html_extract.parse(page)
        label = []
        for i, x in enumerate(nodes):
            m = html_extract._MARK.search(x.attrs)
            label.append(int(m.group(1)) if m else label[x.parent] if i else -1)
        want = Counter(line for at, line in runs if label[at] == 1)
        got = Counter(html_extract.main_text(re.sub(r' data-part="."', "", page), trees).split("\n"))
        right += sum((want & got).values())
        total += sum(want.values())
        extra += sum((got - want).values())
    assert right / total > 0.95 and extra / (right + extra) < 0.08


def test_extract_awkward_rows(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "just text", "x"), (4, "u", PAGE.format(body="<p>" + "word " * 40_000 + "</p>"), "x"),
            (4, "u", PAGE.format(body="<p>a b c d e f</p>"), "x")]
    rows += [(10 + k, "u", PAGE.format(body="".join(f"<p>{s}</p>" for s in sentences(4, k))), "x") for k in range(25)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got if r.page_id < 3} == {1: "", 2: ""}
    assert max(r.n_chars for r in got) >= 199_990
    assert html_extract.extract(df.limit(0)).count() == 0


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    z = boosting.Trees(rounds=40, depth=3).fit(x[:1500], y[:1500]).decide(x[1500:])
    assert ((z > 0) == y[1500:]).mean() > 0.95


def enumerate_word(v, word):
    out = []

    def go(i, ids, w):
        if i == len(word):
            out.append((tuple(ids), w))
            return
        single = False
        for j in range(i + 1, min(len(word), i + v.longest) + 1):
            piece = v.pieces.get(word[i:j])
            if piece:
                single |= j == i + 1
                go(j, [*ids, piece[0]], w + piece[1])
        if not single:
            spelled = [v.bytes[b] for b in word[i].encode()]
            go(i + 1, ids + spelled, w - (lattice_sampling.PIECE_COST + lattice_sampling.RANK_COST) * len(spelled))

    go(0, [], 0.0)
    return out


def test_sampling_matches_enumeration():
    s = lattice_sampling.Sampler()
    word = s.vocab.normal("aber")
    paths = enumerate_word(s.vocab, word)
    z = np.logaddexp.reduce([w for _, w in paths])
    p = {ids: math.exp(w - z) for ids, w in paths}
    n, first, seen = 3000, Counter(), Counter()
    for i in range(n):
        found = s.sample([i * 7919 + 13], [word], 2)[0]
        ids = [tuple(f[0].tolist()) for f in found]
        assert len(set(ids)) == 2 and found[0][2] > found[1][2]
        assert all(f[1] == pytest.approx(math.log(p[x])) for f, x in zip(found, ids))
        first[ids[0]] += 1
        seen.update(ids)
    for ids, share in p.items():
        both = share + sum(q * share / (1 - q) for other, q in p.items() if other != ids)
        assert abs(first[ids] / n - share) < 0.04 and abs(seen[ids] / n - both) < 0.04
    everything = s.sample([5], [word], len(p) + 3)[0]
    assert len(everything) == len(p) and all(f[3] == 0.0 for f in everything)


def test_new_words_are_added_in_blocks(monkeypatch):
    import tracemalloc

    rnd = np.random.default_rng(8)
    new = [lattice_sampling.MARK + "".join(map(chr, rnd.integers(97, 123, int(n)))) for n in rnd.integers(3, 9, 40_000)]
    s = lattice_sampling.Sampler()
    s.lat.add(["one"])
    tracemalloc.start()
    s.lat.add(new)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 110 * s.lat.arcs  # bytes, of which 24 stay
    texts = ["".join(new[i:i + 300]) for i in range(0, 900, 300)]
    want = s.sample([1, 2, 3], texts)
    monkeypatch.setattr(lattice_sampling, "POINTS", 1000)
    other = lattice_sampling.Sampler()
    other.sample([4], ["".join(new[900:950])])
    for reset in (False, True):
        if reset:
            other.lat.reset()
        got = other.sample([1, 2, 3], texts)
        for a, b in zip(want, got):
            assert [(x[0].tolist(), x[1:]) for x in a] == [(x[0].tolist(), x[1:]) for x in b]
    ids = want[0][0][0].tolist()
    text = texts[0].replace(lattice_sampling.MARK, " ")
    assert s.vocab.decodes(ids, text.encode()) and s.vocab.decodes(ids, text[1:].encode())
    assert not s.vocab.decodes(ids, (text + "x").encode()) and not s.vocab.decodes(ids[1:], text.encode())


def test_segmentations_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, "a"), (4, "Hello  world\n ▁ \x00é́ 梦 🙂"), (4, "Hello  world\n ▁ \x00é́ 梦 🙂"), (5, "x" * 20_000), (None, "no key")]
    got = lattice_sampling.segmentations(docs(spark, rows), k=3).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert all(r.decodes and r.log_inclusion <= 0 and r.n_ids == len(r.ids) for r in got)
    assert len(by[1]) == len(by[2]) == 1 and by[1][0].ids == [] and len(by[5]) == 3
    assert sorted(tuple(r.ids) for r in by[4][:3]) == sorted(tuple(r.ids) for r in by[4][3:])
    back = lattice_sampling.decode(lattice_sampling.segmentations(docs(spark, rows), k=1)).collect()
    assert {r.doc_id: r.text for r in back if r.doc_id in (3, 5)} == {3: "a", 5: "x" * 20_000}
    assert lattice_sampling.segmentations(docs(spark, rows).limit(0)).count() == 0


def test_fullest_is_the_best_sum():
    rng = np.random.default_rng(1)
    for _ in range(200):
        room = int(rng.integers(0, 40))
        counts = {int(n): int(rng.integers(1, 4)) for n in rng.integers(1, 30, rng.integers(0, 7))}
        sums = {0}
        for n, c in counts.items():
            sums = {s + k * n for s in sums for k in range(c + 1) if s + k * n <= room}
        got = packing.fullest(room, counts)
        assert sum(n * c for n, c in got.items()) == max(sums) and all(c <= counts[n] for n, c in got.items())


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(WORDS, int(rng.integers(0, 900))))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "word " * 9000), (103, "a <|endoftext|> b"), (104, "ünï 梦 🙂 ﷽  \x85 x\x1cy"), (105, "same text"), (106, "same text")]
    packed = packing.pack(docs(spark, rows), with_ids=True)
    got = packed.collect()
    ids = {k: [*own.encode(t or "", add_special_tokens=False).ids, 0] for k, t in rows}
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.ids == ids[r.doc_id][r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces[r.doc_id].append((r.piece, r.start, r.length))
        bins[r.sequence_id].append((r.offset, r.length))
    for k, found in pieces.items():
        assert [(s, n) for _, s, n in sorted(found)] == packing.cut(len(ids[k]), 2048)
    for found in bins.values():
        at = 0
        for offset, n in sorted(found):
            assert offset == at
            at += n
        assert at <= 2048
    total = sum(map(len, ids.values()))
    first_fit = []  # decreasing
    for n in sorted((r.length for r in got), reverse=True):
        at = next((i for i, room in enumerate(first_fit) if room >= n), None)
        if at is None:
            first_fit.append(2048 - n)
        else:
            first_fit[at] -= n
    assert -(-total // 2048) <= len(bins) <= len(first_fit)
    held = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert sum(map(len, held.values())) == total
    assert packing.pack(docs(spark, rows).limit(0)).count() == 0


def test_packing_crowded_length(spark):
    got = packing.pack(docs(spark, [(i, "same few words here") for i in range(9000)])).collect()
    n = got[0].length
    assert len({r.sequence_id for r in got}) == -(-9000 // (2048 // n))
    assert len({(r.sequence_id, r.offset) for r in got}) == 9000


def test_text_of_the_body_itself(trees):
    one, two, three = (" ".join(sentences(3, k)) for k in (50, 51, 52))
    page = (f'<html><body><div class="nav"><a href="/a">Home</a></div>{one}<br><b>{two}</b><table><tr><td>a<td>b</table>{three}'
            '<div class="footer">&copy; site</div></body></html>')
    nodes, runs = html_extract.parse(page)
    assert [line for node, line in runs if not nodes[node].tag] == [f"{one} {two}", three]
    got = html_extract.main_text(page, trees).split("\n")
    assert f"{one} {two}" in got and three in got
    assert "Home" not in got and "© site" not in got
    assert html_extract.main_text("<p></p>", trees) == "" and html_extract.main_text("only <b>this</b>", trees) == "only this"
    menu = html_extract.parse('<a href="/a">Home</a> <a href="/b">News</a><p>x</p>')[0]
    assert [(x.tag, x.links) for x in menu] == [("html", 0), ("", 8), ("p", 0)]


def test_dropped_elements_end(trees):
    def lines(body):
        return [line for _, line in html_extract.parse(f"<body><article>{body}</article><p>end</p></body>")[1]]

    for body, want in (
            ('<p>a <svg href="#i"/> b</p><p>c</p>', ["a b", "c"]),
            ('<svg/><p>a</p><svg><text>x</text></svg><p>b</p>', ["a", "b"]),
            ('<p>a<svg><path/><p>b</p>', ["a", "b"]),
            ('<p>a<svg><title/><foreignObject><p>x</p></foreignObject><text>y</text></svg> b</p>', ["a b"]),
            ('<p>a<select><option>x<option>y<p>b</p><select><option>z</select> c', ["a", "b", "c"]),
            ('<p>a<select><option>x</select> b', ["a b"]),
            ('<p>a<select><option>x<textarea>t</textarea> b', ["a b"]),
            ('<form><select><option>x</form>a', ["a"]),
            ('<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> b</p>', ["a x=2 b"]),
            ('<template><p>x<template><p>y</template><p>z</template><p>a', ["a"]),
            ('<template><script>"<template>"</script><p>x</template><p>a', ["a"]),
            ('<template><p>a</p><noscript><img></noscript><iframe src="x"/><p>b', ["a", "b"]),
            ('<noscript><svg><path></noscript><p>a<!-- <svg> --> b', ["a b"])):
        assert lines(body) == [*want, "end"], body
    said = sentences(6, 60)
    body = f'<p>{said[0]}</p><svg class="i"/><p>{said[1]}</p><select><option>no<p>{said[2]} <math><mi>q</mi></math></p><svg><p>{said[3]}</p>'
    got = html_extract.main_text(PAGE.format(body=body), trees).split("\n")
    assert got[1:] == [said[0], said[1], said[2] + " q", said[3]]


def test_the_registered_segmentations_return_their_ids(spark):
    from civicgrid.llm import queries

    got = queries.op3_sentencepiece_sampling(spark, "/root/testdata/sf0.001").limit(6).collect()
    assert got and all(len(r.ids) == r.n_ids and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
