"""Registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm import decontaminate, html_extract, lexical_search, licenses, mixing, near_dedup, quality, secret_scan, spelling, token_counts, token_files, toxicity, vector_search
from panelweave.llm.common import held_out

#: Scores from here on predict label 1.
LEAST_SCORE = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = held_out("doc_id", 4, 2)
    model = toxicity.fit_toxicity(docs, labels, ~held)
    found = toxicity.score_toxicity(docs, model)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"), F.size("spans").alias("n_spans"), spans.alias("spans"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = held_out("doc_id", 5, 0)
    model = quality.fit_quality(docs, labels, ~held)
    found = quality.score_quality(docs, model)
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"), "difference")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = vector_search.integer_vectors(table(spark, sf_dir, "embeddings"))
    return vector_search.top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.span_digest(secret_scan.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op6_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), threshold=0.85)


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mixture_plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return plan.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_tokens(table(spark, sf_dir, "documents"))
    return token_files.read_documents(token_files.open_shards(spark, path))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.word_counts(table(spark, sf_dir, "documents"), one_in=97))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(lexical_search.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=10)


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_quality, op3_main_text, op4_top_k, op5_secret_scan, op6_section_tokens, op7_license_scan, op8_decontamination, op9_near_dedup, op10_mixture, op11_token_files, op12_spelling_variants, op13_lexical_search)}


ORACLE = {
    "op4_top_k": """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.x, v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, x ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op10_mixture": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), p AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1) % 3] AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 3 AS cap FROM p
), l AS (
  SELECT *, ((SELECT sum(source_size) FROM p) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, source_size, least(cap, weight * (SELECT arg_min(level, cap / weight) FROM l WHERE level <= cap / weight)) AS target FROM l
), r AS (
  SELECT doc_id, size, source_size, coalesce(target, 0) AS target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
""".replace(" COLLATE C", ""),
    "op12_spelling_variants": r"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
), r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents WHERE text IS NOT NULL
), d AS (
  SELECT doc_id, run, count(*) AS n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s FROM r GROUP BY doc_id, run
), b AS (
  SELECT doc_id, run, n, flatten(list_transform(string_split(s, ''), lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [192 + (ord(c) >> 6), 128 + (ord(c) & 63)] END)) AS bytes FROM d
), h AS (
  SELECT run, n, xor(list_reduce(list_concat([4294967295], bytes), lambda c, x: xor(c >> 8, t.crc[1 + (xor(c, x) & 255)])), 4294967295) AS h FROM b, t
), s AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h
), w AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), p AS (
  SELECT word, n, i, unnest([substr(word, 1, i - 1) || '*' || substr(word, i + 1), substr(word, 1, i - 1) || substr(word, i + 1)]) AS part
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)
), e AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM p a JOIN p b ON a.part = b.part AND a.word <> b.word WHERE contains(a.part, '*')
  UNION SELECT p.word, p.n, w.word, w.n FROM p JOIN w ON p.part = w.word
  UNION SELECT w.word, w.n, p.word, p.n FROM p JOIN w ON p.part = w.word
), g AS (
  SELECT word, count(*) AS n_near, max(other_n) AS form_n FROM e GROUP BY word
), f AS (
  SELECT w.word, w.n, coalesce(g.n_near, 0) AS n_near, CASE WHEN g.form_n >= 2 * w.n THEN g.form_n END AS form_n,
    (SELECT min(other) FROM e WHERE e.word = w.word AND e.other_n = g.form_n AND g.form_n >= 2 * w.n) AS form FROM w LEFT JOIN g ON w.word = g.word
), c AS (
  SELECT word, form AS root, 1 AS depth FROM f WHERE form IS NOT NULL
  UNION ALL SELECT c.word, f.form, depth + 1 FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL
), l AS (SELECT word, arg_max(root, depth) AS root FROM c GROUP BY word)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN l ON f.word = l.word
""",
    "op13_lexical_search": r"""
WITH q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), s AS (
  SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM d WHERE len(terms) > 0
), p AS (
  SELECT r, doc_id, size, term, count(*) AS tf FROM (SELECT r, doc_id, CAST(len(terms) AS BIGINT) AS size, unnest(terms) AS term FROM d) GROUP BY r, doc_id, size, term
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term
), x AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * size * docs) // total)))) AS BIGINT) AS score
  FROM q JOIN p ON q.term = p.term JOIN w ON w.term = p.term, s GROUP BY item_id, r, doc_id
), o AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 10
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
