"""The pipeline's stages, each on its own input, against brute force."""

import pytest
from civicgrid.llm import line_duplicates, packing, quality, toxicity
from civicgrid.llm.queries import QUERIES, SQL

import corpus_pipeline
from test_documents import plain_measures
from test_similar import classes, distance, lines_of, shingles

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.orderBy("doc_id").limit(60)
    copies = some.limit(12).selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "source", "n_chars")
    some.union(copies).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    before = rows(docs)
    docs = stages["quality_rules"](spark, docs, folder)
    assert docs.columns == COLUMNS
    kept = rows(docs)
    for k, text in before.items():
        n, _, symbols, _, repeated = plain_measures(text)
        if n < 20 or 100 * repeated > 30 * n or 10 * symbols > n:
            assert k not in kept
    assert all(before[k] == t for k, t in kept.items())

    grammar = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    docs = stages["toxicity"](spark, docs, folder)
    assert docs.columns == COLUMNS
    assert set(rows(docs)) == {k for k, t in kept.items() if grammar.score(t) < 0.5}

    before = rows(docs)
    docs = stages["line_dedup"](spark, docs, folder)
    assert docs.columns == COLUMNS
    found = lines_of(sorted(before.items()))
    near = classes(range(len(found)), lambda a, b: found[a][2] == found[b][2] or (
        abs(len(found[a][2]) - len(found[b][2])) <= 2 and found[a][2][:8] == found[b][2][:8]
        and distance(found[a][2], found[b][2]) <= line_duplicates.EDITS))
    gone = {found[k][:2] for k in near if near[k] != k}
    left = {k: "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in gone) for k, t in before.items()}
    cut = {d for d, _ in gone}
    assert rows(docs) == {k: t for k, t in left.items() if k not in cut or t.strip() and 4 * len(t) >= len(before[k])}

    before = rows(docs)
    docs = stages["minhash_near_dedup"](spark, docs, folder)
    assert docs.columns == COLUMNS
    sets = {k: shingles(t) for k, t in before.items()}
    want = classes(sorted(before), lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    assert set(rows(docs)) == {k for k, r in want.items() if r == k}

    last = stages["best_fit_packing"](spark, docs, folder).collect()
    assert {r.doc_id for r in last} == set(rows(docs)) and max(r.offset + r.length for r in last) <= packing.CAPACITY


def test_run_is_its_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(got.columns) and got.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "line_dedup", "minhash_near_dedup", "best_fit_packing"]


def test_quality_agrees_with_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rel = con.execute(SQL["op10_quality_rules"])
    names = [d[0] for d in rel.description]
    df = QUERIES["op10_quality_rules"](spark, SF).select(*names)
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())
    assert quality.POLICIES["v2"]


def test_every_operator_has_a_query():
    assert sorted(int(q.split("_")[0][2:]) for q in QUERIES) == list(range(1, 14))
