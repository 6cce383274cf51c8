"""One query per corpus operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import credentials, divergence, html_extract, language, lattice_sampling, line_duplicates, near_duplicates, neighbours, packing, periodic_runs, quality, token_counts, toxicity
from .common import table

Build = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lattice_sampling.segmentations(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "sample", "n_ids", "ids_crc32", "log_p", "perturbed", "log_inclusion", "decodes", "ids")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_duplicates.line_classes(table(spark, sf_dir, "documents"), short=True)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbours(table(spark, sf_dir, "embeddings"), lambda key: key % 20 == 0)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.decide(quality.ledger(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       "kept", "failed")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return periodic_runs.summary(periodic_runs.periodic_runs(docs, words_of=periodic_runs.looped, with_text=False))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.summary(credentials.find_secrets(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Build] = {f.__name__: f for f in (
    op1_toxicity, op2_html_extraction, op3_sentencepiece_sampling, op4_best_fit_packing, op5_minhash_near_dedup, op6_token_counts, op7_line_dedup,
    op8_nearest_neighbours, op9_language_id, op10_quality_rules, op11_source_divergence, op12_periodic_runs,
    op13_secret_scan)}

_MEASURED = r"""
    words AS (
      SELECT doc_id, coalesce(text, '') AS body,
             list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
      FROM documents),
    windows AS (
      SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM words)),
    twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM windows) WHERE n > 1),
    covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(8) AS s(j) GROUP BY doc_id),
    measured AS (
      SELECT a.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             len(regexp_extract_all(body, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
             coalesce(c.n, 0) AS n_repeat_words, len(l) AS n_lines, len(regexp_extract_all(body, '\p{Lu}')) AS n_upper,
             len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutter,
             len(regexp_extract_all(body, '[0-9]')) AS n_digits
      FROM words a LEFT JOIN covered c ON a.doc_id = c.doc_id),
    judged AS (
      SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT
             + 4 * (100 * n_symbols > 10 * n_words)::BIGINT + 8 * (2 * n_dup_lines > n_lines)::BIGINT
             + 16 * (word_chars < 2 * n_words OR word_chars > 14 * n_words)::BIGINT
             + 32 * (10 * n_upper > 3 * word_chars)::BIGINT + 64 * (10 * n_stutter > 3 * n_words)::BIGINT
             + 128 * (2 * n_digits > word_chars)::BIGINT AS failed
      FROM measured)
"""

SQL: dict[str, str] = {
    "op10_quality_rules": f"""
    WITH {_MEASURED}
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
           n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, failed % 4 <> 0 AS base_failed,
           failed = 0 AS kept, failed::BIGINT AS failed
    FROM judged""",
    "op11_source_divergence": r"""
    WITH docs AS (
      SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
      FROM documents),
    words AS (SELECT id, lang, source, unnest(w) AS term FROM docs),
    kept AS (SELECT lang, term, count(*) AS n_all FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
    counts AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY lang, source, term),
    sizes AS (SELECT lang, count(*) AS v, sum(n_all) AS total FROM kept GROUP BY lang),
    grp AS (SELECT DISTINCT lang, source FROM docs),
    cells AS (
      SELECT g.lang, g.source, k.term, k.n_all, coalesce(c.n, 0) AS n
      FROM grp g JOIN kept k ON g.lang = k.lang
           LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    shares AS (
      SELECT c.*, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY c.lang, c.source) + 2 * v) AS p,
             1 + (1000000000::HUGEINT * (n_all + 2)) // (total + 2 * v) AS q
      FROM cells c JOIN sizes s ON c.lang = s.lang),
    apart AS (
      SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
      FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
      GROUP BY a.lang, a.source, b.source),
    found AS (
      SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
      FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
           LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM shares WHERE n > 0 AND p > q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
    FROM ranked WHERE part = 'pair' OR rank <= 10""",
    # crc32 bit by bit: a number from 0 on is a byte to take in, -1 shifts by one bit
    "op12_periodic_runs": r"""
    WITH docs AS (
      SELECT row_number() OVER () AS id, doc_id,
             list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
               string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
               lambda a, o: CASE WHEN o >= 0 THEN xor(a, o) ELSE xor(a >> 1, (a & 1) * 3988292384) END)) AS h
      FROM documents),
    planted AS (
      SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a,
             1 + (len(w) - (h // 10) % greatest(len(w), 1)) // (3 + (h // 10) % 8) AS p FROM docs),
    texts AS (
      SELECT id, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN
        list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w
      FROM planted),
    words AS (SELECT id, n, unnest(w) AS word, unnest(range(n)) AS i FROM texts),
    matches AS (
      SELECT x.id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.id = y.id AND x.word = y.word AND y.i > x.i
      WHERE 2 * (y.i - x.i) <= x.n),
    islands AS (SELECT *, i - row_number() OVER (PARTITION BY id, q ORDER BY i) AS k FROM matches),
    stretches AS (SELECT id, q, min(i) AS s, count(*) + q AS length FROM islands GROUP BY id, q, k
                  HAVING count(*) + q >= greatest(12, 2 * q)),
    runs AS (SELECT id, s, length, min(q) AS q FROM stretches GROUP BY id, s, length),
    gone AS (SELECT DISTINCT id, unnest(range(s + q, s + length)) AS i FROM runs),
    kept AS (SELECT w.id, string_agg(w.word, ' ' ORDER BY w.i) AS body FROM words w LEFT JOIN gone g ON w.id = g.id AND w.i = g.i
             WHERE g.id IS NULL GROUP BY w.id),
    found AS (
      SELECT id, count(*) AS n_runs, first(s ORDER BY length DESC, s, q) AS start, first(length ORDER BY length DESC, s, q) AS length,
             first(q ORDER BY length DESC, s, q) AS period,
             string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS lines
      FROM runs GROUP BY id)
    SELECT t.doc_id, coalesce(f.n_runs, 0)::BIGINT AS n_runs, f.start::BIGINT AS start, f.length::BIGINT AS length,
           f.period::BIGINT AS period, (1000 * f.length // f.period)::BIGINT AS exponent_milli,
           sha256(coalesce(f.lines, '')) AS runs_sha256, sha256(coalesce(k.body, '')) AS collapsed_sha256
    FROM texts t LEFT JOIN found f ON t.id = f.id LEFT JOIN kept k ON t.id = k.id""",
}
