"""Registered queries ``opN_<name>``: each applies its operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, exact_dedup, fingerprints, licenses, line_dedup, mixing, near_dedup, packing, periodic, simhash, toxicity, vector_codes, warc
from .common import shared_dir, table


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(table(spark, sf_dir, "pages"), out)
    return warc.read_warc(spark, out)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op4_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.summary(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model)


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.summary(periodic.scan(periodic.looped(table(spark, sf_dir, "documents"))))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.summary(vector_codes.encode(table(spark, sf_dir, "embeddings"), label_col="label"))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('0:' || coalesce(doc_id::VARCHAR, '-') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         [3.0::DOUBLE, 1.0, 2.0][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT] AS weight,
         1.5::DOUBLE * sum(source_size) OVER () AS all_words
  FROM sources
), levels AS (
  SELECT *, cap / weight AS ratio,
         (SELECT sum(least(o.cap, o.weight * (w.cap / w.weight))) FROM weighed o) <= all_words AS is_full
  FROM weighed w
), goals AS (
  SELECT source, source_size, CASE WHEN is_full THEN cap ELSE
    (all_words - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0)) / sum(CASE WHEN NOT is_full THEN weight END) OVER () * weight END AS target
  FROM levels
), budgets AS (
  SELECT *, floor(target + 1e-6)::BIGINT AS budget,
         CASE WHEN source_size > 0 THEN floor(target + 1e-6)::BIGINT // source_size ELSE 0 END AS epochs
  FROM goals
), placed AS (
  SELECT d.*, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size AS more,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM sized d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, more - before)))::BIGINT AS taken FROM placed
"""

def _license_sql() -> str:
    names = ", ".join(f"('{n}', {licenses.bigrams(t)!r})" for n, t in licenses.TEMPLATES.items())
    s = licenses.THRESHOLD
    return rf"""
WITH templates(name, grams) AS (VALUES {names}),
clean AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS text FROM documents),
segments AS (
  SELECT doc_id, unnest(list_distinct(string_split(text, chr(10)) || string_split_regex(text, '\n ?(?:\n ?)+') || [text])) AS seg FROM clean
), worded AS (
  SELECT doc_id, list_filter(string_split_regex(seg, '[ \n]'), lambda w: w <> '') AS w FROM segments
), gramed AS (
  SELECT doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS a FROM worded WHERE len(w) > 1
), found AS (
  SELECT doc_id, name, 2.0::DOUBLE * len(list_intersect(a, grams)) / (len(a) + len(grams)) AS dice
  FROM gramed JOIN templates ON len(a) >= len(grams) * {s / (2 - s)} AND len(a) <= len(grams) * {(2 - s) / s}
), best AS (
  SELECT doc_id, arg_min(name, (-dice, name)) AS license, max(dice) AS dice, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses
  FROM found WHERE dice >= {s} GROUP BY doc_id
)
SELECT d.doc_id, license, coalesce(dice, 0) AS dice, coalesce(licenses, '') AS licenses FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id
"""


OP7_SQL = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), numbered AS (
  SELECT doc_id, unnest(range(len(ls))) AS line, unnest(ls) AS text FROM split
), lines AS (
  SELECT doc_id, line, (doc_id, line) AS place, array_to_string(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+'), ' ') AS t FROM numbered
), full_lines AS (
  SELECT * FROM lines WHERE t <> ''
), firsts AS (
  SELECT t, min(place) AS first FROM full_lines GROUP BY t
), kinds AS (
  SELECT first, t, len(string_split(t, ' ')) >= 8 AS by_word, CASE WHEN len(string_split(t, ' ')) >= 8 THEN string_split(t, ' ') ELSE string_split(t, '') END AS u
  FROM firsts WHERE len(string_split(t, ' ')) >= 8 OR length(t) >= 16
), spread AS (
  SELECT *, unnest(range(1, len(u) + 1)) AS i FROM kinds
), cut AS (
  SELECT first, by_word, i, u[:i - 1] || u[i + 1:] AS v FROM spread
), replaced AS (
  SELECT first, min(first) OVER (PARTITION BY by_word, i, v) AS earlier FROM cut
), shorter AS (
  SELECT k.first AS a, c.first AS b FROM cut c JOIN kinds k ON k.u = c.v AND k.by_word = c.by_word
), alike AS (
  SELECT first, min(earlier) AS earlier FROM (
    SELECT first, earlier FROM replaced WHERE earlier < first
    UNION ALL SELECT greatest(a, b), least(a, b) FROM shorter) GROUP BY first
), gone AS (
  SELECT l.doc_id, l.line, l.place = k.first AS near FROM full_lines l JOIN firsts k USING (t) LEFT JOIN alike a ON a.first = k.first
  WHERE l.place > k.first OR a.first IS NOT NULL
), per_doc AS (
  SELECT doc_id, count(*) FILTER (NOT near) AS exact, count(*) FILTER (near) AS near, list_sort(list(line::INT)) AS dropped FROM gone GROUP BY doc_id
)
SELECT s.doc_id, len(ls)::BIGINT AS n_lines, coalesce(exact, 0) AS exact, coalesce(near, 0) AS near, coalesce(dropped, []) AS dropped
FROM split s LEFT JOIN per_doc p ON s.doc_id = p.doc_id
"""

#: Every lag on which words match, as stretches; of these the runs; ids' checksums by bits.
OP12_SQL = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
    xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT), lambda h, b:
      list_reduce([xor(h, b)] || range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS h
  FROM documents
), placed AS (
  SELECT doc_id, w, len(w) AS n, h, (h // 10) % greatest(len(w), 1) AS a, h // 10 % 8 AS g FROM hashed
), looped AS (
  SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g)) END]) ELSE w END AS w FROM placed
), words AS (
  SELECT doc_id, len(w) AS n, unnest(range(len(w))) AS i, unnest(w) AS x FROM looped
), matches AS (
  SELECT b.doc_id, b.i, b.i - a.i AS lag FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= b.n
), stretches AS (
  SELECT doc_id, lag, min(i) - lag AS s, count(*) + lag AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS island FROM matches) GROUP BY doc_id, lag, island
), enough AS (
  SELECT * FROM stretches WHERE length >= greatest(6, 4 * lag)
), runs AS (
  SELECT doc_id, s, length, lag FROM enough e WHERE NOT EXISTS (SELECT 1 FROM enough f WHERE f.doc_id = e.doc_id AND f.lag < e.lag AND f.s <= e.s AND f.s + f.length >= e.s + e.length)
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || length || ',' || lag || chr(10), '' ORDER BY s, lag) AS text, arg_min((s, length, lag), (-(length::DOUBLE / lag), s, lag)) AS best FROM runs GROUP BY doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s + lag, s + length)) AS i FROM runs
), left_over AS (
  SELECT w.doc_id, string_agg(x, ' ' ORDER BY w.i) AS text FROM words w ANTI JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best[1] AS start, best[2] AS length, best[3] AS period, 1000 * best[2] // best[3] AS exponent_milli,
       sha256(coalesce(l.text, '')) AS runs_sha256, sha256(coalesce(o.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed l ON l.doc_id = d.doc_id LEFT JOIN left_over o ON o.doc_id = d.doc_id
"""


def _codes_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS) -> str:
    """k-means of each part, round by round, with all distances."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, part, any_value(x) AS x, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT p.vec_id, p.part, p.x, c.entry, list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM pieces p JOIN c{r} c ON c.part = p.part)
  GROUP BY vec_id, part)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
    SELECT part, entry, list((total - ((total % n) + n) % n) // n ORDER BY i) AS x FROM (
      SELECT part, entry, i, sum(v) AS total, count(*) AS n FROM (SELECT part, entry, unnest(range(len(x))) AS i, unnest(x) AS v FROM a{r}) GROUP BY part, entry, i)
    GROUP BY part, entry) m ON m.part = c.part AND m.entry = c.entry)""")
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({vector_codes.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pieces AS MATERIALIZED (
  SELECT vec_id, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) t(part)
), c0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM pieces WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries})
), {", ".join(steps)}, books AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS digest FROM c{rounds}
), coded AS (
  SELECT vec_id, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id
)
SELECT c.vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256 FROM coded c JOIN kept k ON k.vec_id = c.vec_id, books
"""


QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_warc": op2_warc,
    "op3_near_dedup": op3_near_dedup,
    "op4_ctw": op4_ctw,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_mixing": op6_mixing,
    "op7_line_dedup": op7_line_dedup,
    "op8_fingerprints": op8_fingerprints,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
    "op11_simhash": op11_simhash,
    "op12_periodic": op12_periodic,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES = {"op1_licenses": _license_sql(), "op7_line_dedup": OP7_SQL, "op5_exact_dedup": OP5_SQL, "op6_mixing": OP6_SQL, "op12_periodic": OP12_SQL, "op13_vector_codes": _codes_sql()}
