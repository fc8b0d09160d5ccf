"""Registered queries of the operators, with SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, html, langid, lattice, licenses, minhash, mixing, negatives, phrases, quality, runs
from .common import crc_part, table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
PIECES = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {"op8_licenses": licenses.sql(), "op12_decontaminate": decontaminate.sql()}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def sha(column):
    return F.sha2(column, 256)


@query
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.with_next(table(spark, sf_dir, "documents"))


#: Weights of the registered mix: domains are the last digit of a source, modulo 4.
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.8, 3, 17


def domain():
    return F.concat(F.lit("d"), F.coalesce((F.regexp_extract("source", r"(\d)$", 1).try_cast("int") % 4).cast("string"), F.lit("x")))


def mix_weights() -> dict:
    by_lang = F.when(F.col("lang") == "en", 3).when(F.col("lang") == "de", 2).when(F.col("lang") == "fr", 2).otherwise(1)
    return {
        "domain": F.when(F.col("domain") == "d0", 4).when(F.col("domain") == "d1", 3).when(F.col("domain") == "d2", 2).otherwise(1),
        "lang": by_lang,
        "source": F.lit(1),
    }


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), mix_weights(), MIX_SHARE, MIX_EPOCHS, MIX_SEED, domain=domain())


SQL["op3_mixing"] = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, 'd' || coalesce(CAST(try_cast(regexp_extract(source, '(\d)$', 1) AS INTEGER) % 4 AS VARCHAR), 'x') AS domain,
    coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens, md5(coalesce(text, '')) AS text_key
  FROM documents
), leaves AS (
  SELECT domain, lang, source, sum(tokens) AS tokens, CAST(sum(tokens) * {MIX_EPOCHS} AS DOUBLE) AS room,
    CASE domain WHEN 'd0' THEN 4.0 WHEN 'd1' THEN 3.0 WHEN 'd2' THEN 2.0 ELSE 1.0 END AS wd,
    CASE lang WHEN 'en' THEN 3.0 WHEN 'de' THEN 2.0 WHEN 'fr' THEN 2.0 ELSE 1.0 END AS wl, 1.0 AS ws
  FROM docs GROUP BY ALL
), b AS (SELECT floor(sum(tokens) * CAST({MIX_SHARE} AS DOUBLE)) AS given FROM docs),
d0 AS (SELECT domain, max(wd) AS w, sum(room) AS room, (SELECT given FROM b) AS given FROM leaves GROUP BY ALL),
d AS (
  SELECT x.domain, (SELECT max(CASE WHEN lv * x.w > x.room THEN x.room ELSE lv * x.w END) FROM (
    SELECT (x.given - coalesce((SELECT sum(z.room) FROM d0 z WHERE z.room / z.w < y.room / y.w), 0)) /
      (SELECT sum(z.w) FROM d0 z WHERE z.room / z.w >= y.room / y.w) AS lv FROM d0 y)) AS given
  FROM d0 x
), l0 AS (
  SELECT domain, lang, max(wl) AS w, sum(room) AS room, any_value(d.given) AS given FROM leaves JOIN d USING (domain) GROUP BY ALL
), l AS (
  SELECT x.domain, x.lang, (SELECT max(CASE WHEN lv * x.w > x.room THEN x.room ELSE lv * x.w END) FROM (
    SELECT (x.given - coalesce((SELECT sum(z.room) FROM l0 z WHERE z.domain = x.domain AND z.room / z.w < y.room / y.w), 0)) /
      (SELECT sum(z.w) FROM l0 z WHERE z.domain = x.domain AND z.room / z.w >= y.room / y.w) AS lv FROM l0 y WHERE y.domain = x.domain)) AS given
  FROM l0 x
), s0 AS (
  SELECT leaves.domain, leaves.lang, source, ws AS w, room, tokens, l.given FROM leaves JOIN l ON l.domain = leaves.domain AND l.lang = leaves.lang
), s AS (
  SELECT x.domain, x.lang, x.source, x.tokens, floor((SELECT max(CASE WHEN lv * x.w > x.room THEN x.room ELSE lv * x.w END) FROM (
    SELECT (x.given - coalesce((SELECT sum(z.room) FROM s0 z WHERE z.domain = x.domain AND z.lang = x.lang AND z.room / z.w < y.room / y.w), 0)) /
      (SELECT sum(z.w) FROM s0 z WHERE z.domain = x.domain AND z.lang = x.lang AND z.room / z.w >= y.room / y.w) AS lv
    FROM s0 y WHERE y.domain = x.domain AND y.lang = x.lang)) + 1e-6) AS budget
  FROM s0 x
), p AS (
  SELECT docs.*, CASE WHEN s.tokens > 0 THEN CAST(floor(budget / s.tokens) AS INTEGER) ELSE 0 END AS whole,
    CASE WHEN s.tokens > 0 THEN CAST(budget AS BIGINT) % s.tokens ELSE 0 END AS rest
  FROM docs JOIN s ON docs.domain = s.domain AND docs.lang = s.lang AND docs.source = s.source
), o AS (
  SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{MIX_SEED}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text_key || ':' || tokens) ROWS UNBOUNDED PRECEDING) AS upto FROM p
)
SELECT doc_id, domain, lang, source, tokens, CAST(whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS INTEGER) AS epochs FROM o"""


@query
def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return text.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), RANKS, PATTERN)
    ids = F.col("ids")
    digest = sha(F.array_join(ids.cast("array<string>"), ","))
    digested = bpe.decoded(tokens.withColumns({"n_tokens": F.size(ids).cast("bigint"), "ids_sha256": digest}), RANKS, PATTERN)
    return digested.select("doc_id", "n_tokens", "ids_sha256", sha("decoded").alias("decoded_sha256"))


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


@query
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    both = "</s>[INST] ok [/INST]"
    planted = said.sparkSession.sql(f"SELECT -1L conv_id, turn, role, '{both}' text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return chat.read_back(chat.formatted(said.unionByName(planted), chat.Instruct()), chat.Instruct())


@query
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", crc_part("doc_id", 4) == 2)
    model = langid.fitted(docs.filter("not held_out"))
    return langid.identified(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query
def op10_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.scored(table(spark, sf_dir, "documents").select("doc_id", "text"), crc_part("doc_id", 7) != 2, PIECES)


def repeating(docs: DataFrame) -> DataFrame:
    """doc_id and text; in every tenth document (by the crc32 of its id) the words from a place on are those of a short
    stretch there, over and over. Documents without an id stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = docs.select("doc_id", "text", h.alias("h"), words.alias("words")).withColumns({"g": F.expr("h div 10"), "n": F.size("words")})
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (F.lit(1) + F.expr("(n - a) div (3 + g % 8)")).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.expr("int((n - a) div p + 1)")))
    made = F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), again), F.lit(1), F.col("n")), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


@query
def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(repeating(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    best = found.withColumn("best", runs.strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), sha(listed).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )


@query
def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matched(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = decontaminate.n_hit()
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        sha(F.array_join("items", ",")).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


#: Vectors are taken as whole numbers of 1/SCALE.
SCALE = 256


@query
def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.quantised(table(spark, sf_dir, "embeddings"), SCALE, label=label)
    return negatives.hard_negatives(rows, F.col("id") % 50 == 0)


SQL["op13_negatives"] = f"""
WITH vectors AS (
  SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM vectors a JOIN vectors b ON a.id % 50 = 0 AND (a.id <> b.id OR a.label <> b.label OR a.v <> b.v)
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= 3"""
