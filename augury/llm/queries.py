"""Registered queries of the text operators, each over its whole table, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (language, leaks, licenses, neardup, negatives, packing, phrases, private, repeats, sentencepieces, sharding,
               variants, warc)
from .common import saved

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet").select(*columns)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op4_warc", """
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN strlen(h) >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 1000 AND page_id < last THEN last END AS refers_to
FROM (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS last
      FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))""")
def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    read = warc.read_records(warc.write_bundles(warc.planned(pages)))
    facts = saved(read.select("record_id", "record_type", "refers_to", F.octet_length("payload").alias("_bytes"),
                              F.sha1("payload").alias("_digest"), "declared_digest"), "warc-facts")
    sources = facts.where("record_type = 'response'").groupBy(F.col("record_id").alias("_id"), F.col("_digest").alias("_key")).agg(
        F.max("_bytes").alias("_source_bytes"))
    whole = facts.where("record_type = 'response'").select(
        F.col("record_id").alias("page_id"), F.col("_bytes").cast("long").alias("payload_bytes"),
        F.col("_digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = facts.where("record_type = 'revisit'").join(
        sources, (F.col("refers_to") == F.col("_id")) & (F.col("declared_digest") == F.col("_key")))
    return whole.unionByName(again.select(
        F.col("record_id").alias("page_id"), F.col("_source_bytes").cast("long").alias("payload_bytes"),
        F.col("_key").alias("payload_digest"), "record_type", "refers_to"))


@query("op7_sharding")
def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    dealt = sharding.byte_shards(documents(spark, folder, "doc_id", "text"), 16)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


@query("op8_packing")
def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.token_pieces(documents(spark, folder, "doc_id", "text"), tokenizer_path(), 4096, 1)
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digests, 4096)


@query("op9_language")
def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder, "doc_id", "text", "lang").withColumn(
        "held_out", language.fold(F.col("doc_id")) == 2)
    model = language.fit(docs.where("not held_out"))
    return language.identify(docs, model, keep=["doc_id", "held_out"])


@query("op5_neardup")
def op5_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, folder, "doc_id", "text"))


@query("op3_repeats")
def op3_repeats(spark: SparkSession, folder: str) -> DataFrame:
    kept = repeats.remove_repeats(documents(spark, folder, "doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


@query("op1_fingerprints")
def op1_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    compared = phrases.compared_with_edits(documents(spark, folder, "doc_id", "text"))
    return compared.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
                           "edited_fingerprint", "near_edited", "near_next")


@query("op6_decontamination")
def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    found = leaks.benchmark_leaks(documents(spark, folder, "doc_id", "text"), items, keep=["doc_id"])
    return found.select("doc_id", F.explode("leaks").alias("leak")).select(
        "doc_id", "leak.item_id", "leak.distance", "leak.item_chars")


#: A document's place in a tree of its source: one to three folders deep; a tenth are licence files.
PATH = ("concat_ws('/', source, CASE WHEN doc_id % 3 > 0 THEN concat('a', doc_id DIV 64 % 16) END, "
        "CASE WHEN doc_id % 3 > 1 THEN concat('b', doc_id DIV 8 % 8) END, "
        "concat(CASE WHEN doc_id % 10 = 7 THEN 'LICENSE-' ELSE '' END, doc_id, '.txt'))")
_QUOTE = "'"
_TEMPLATE_ROWS = ", ".join(f"('{k}', '{k} {i}', '{t.replace(_QUOTE, _QUOTE * 2)}')"
                           for k, texts in licenses.TEMPLATES.items() for i, t in enumerate(texts))


@query("op2_licenses", f"""
WITH files AS (SELECT doc_id, path, text, regexp_matches(regexp_extract(path, '[^/]*$'), '{licenses.LICENCE_FILE}') AS names
               FROM (SELECT doc_id, {PATH.replace("DIV", "//")} AS path, text FROM documents)),
cued AS (SELECT path, names, text, regexp_replace(text, '{licenses.MARKS}', '', 'g') AS plain FROM files
         WHERE regexp_matches(text, '{licenses.CUE}')),
blocks AS (
  SELECT path, 'line' AS kind, unnest(string_split(text, chr(10))) AS block, unnest(range(0, len(string_split(text, chr(10))))) = 0 AS top FROM cued
  UNION ALL SELECT path, 'block', unnest(regexp_split_to_array(plain, '\n{{2,}}')),
    unnest(range(0, len(regexp_split_to_array(plain, '\n{{2,}}')))) = 0 FROM cued
  UNION ALL SELECT path, 'block', regexp_replace(regexp_split_to_array(text, '{licenses.CODE}')[1], '{licenses.MARKS}', '', 'g'), true FROM cued
  UNION ALL SELECT path, 'block', plain, false FROM cued
  UNION ALL SELECT path, 'block', array_to_string(regexp_extract_all(lower(text), '{licenses.WORD}')[1:{licenses.OPENING}], ' '), false
    FROM cued WHERE names),
stated AS (SELECT path, kind, top, block AS statement FROM blocks WHERE regexp_matches(block, '{licenses.CUE}')),
counted AS (SELECT statement, count(*) AS n FROM stated GROUP BY ALL),
terms AS (SELECT statement, n, term, count(*) AS tf FROM (SELECT statement, n,
            unnest(regexp_extract_all(lower(statement), '{licenses.WORD}')) AS term FROM counted) GROUP BY ALL),
model AS (SELECT license, template, term, count(*) AS tf FROM (SELECT license, template,
            unnest(regexp_extract_all(lower(body), '{licenses.WORD}')) AS term
          FROM (VALUES {_TEMPLATE_ROWS}) AS t(license, template, body)) GROUP BY ALL),
freq AS (SELECT term, sum(n) AS df FROM terms GROUP BY ALL),
total AS (SELECT coalesce(sum(n), 0) AS total FROM counted),
own AS (SELECT statement, term, tf * (ln((total + 1) / (coalesce(df, 0) + 1)) + 1) AS w FROM terms LEFT JOIN freq USING (term), total),
base AS (SELECT license, template, term, tf * (ln((total + 1) / (coalesce(df, 0) + 1)) + 1) AS w FROM model LEFT JOIN freq USING (term), total),
scored AS (SELECT statement, license, round(dot / (s * b), 6) AS score
           FROM (SELECT statement, license, template, sum(own.w * base.w) AS dot FROM own JOIN base USING (term) GROUP BY ALL)
           JOIN (SELECT statement, sqrt(sum(w * w)) AS s FROM own GROUP BY ALL) USING (statement)
           JOIN (SELECT template, sqrt(sum(w * w)) AS b FROM base GROUP BY ALL) USING (template)),
named AS (SELECT path, top, license, score FROM stated JOIN
           (SELECT * FROM scored WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY statement ORDER BY score DESC, license) = 1)
           USING (statement) WHERE score >= CASE kind WHEN 'line' THEN 0.6 ELSE 0.75 END),
mine AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, license) = 1),
tops AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS up, path, license, score FROM named
         WHERE top OR regexp_matches(regexp_extract(path, '[^/]*$'), '{licenses.LICENCE_FILE}')),
folder AS (SELECT * FROM tops QUALIFY row_number() OVER (PARTITION BY up ORDER BY score DESC, license, path) = 1),
near AS (SELECT f.path, d.license, d.score, d.path AS src FROM files f JOIN folder d
           ON starts_with(f.path, d.up || '/') QUALIFY row_number() OVER (PARTITION BY f.path ORDER BY length(d.up) DESC) = 1)
SELECT doc_id, files.path, coalesce(m.license, n.license) AS license, coalesce(m.score, n.score) AS score,
       CASE WHEN m.path IS NOT NULL THEN 'own' WHEN n.path IS NOT NULL THEN 'inherited' END AS origin, coalesce(m.path, n.src) AS declared_by
FROM files LEFT JOIN mine m ON m.path = files.path LEFT JOIN near n ON n.path = files.path""")
def op2_licenses(spark: SparkSession, folder: str) -> DataFrame:
    files = documents(spark, folder, "doc_id", "source", "text").withColumn("path", F.expr(PATH))
    found = licenses.scan_licenses(files)
    return found.withColumn("doc_id", F.regexp_extract("path", r"([0-9]+)\.txt$", 1).cast("long"))


@query("op10_private")
def op10_private(spark: SparkSession, folder: str) -> DataFrame:
    return private.replace_private(documents(spark, folder, "doc_id", "text"), key="surrogates-1")


@query("op11_pieces")
def op11_pieces(spark: SparkSession, folder: str) -> DataFrame:
    read = sentencepieces.encode_pieces(documents(spark, folder, "doc_id", "text"), tokenizer_path("piece_bpe_32k.model"),
                                        decoded_out="decoded")
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return read.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op12_variants")
def op12_variants(spark: SparkSession, folder: str) -> DataFrame:
    words = saved(variants.word_counts(documents(spark, folder, "doc_id", "text")), "variant-words")
    return variants.variant_forms(words)


@query("op13_negatives", """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
           FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
             CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT s.anchor_id, p.vec_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY s.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM s JOIN p ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY s.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) <= 3""")
def op13_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = negatives.usable(spark.read.parquet(f"{folder}/embeddings.parquet")).withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(rows)
