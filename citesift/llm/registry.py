"""The operators as registered queries over whole tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citesift.llm import (
    centroid_clustering,
    decontaminate,
    embedding_dedup,
    hard_negatives,
    license_scan,
    line_dedup,
    lm_scoring,
    minhash_dedup,
    pii,
    quality_rules,
    stages,
    toxicity,
    url_filter,
)
from citesift.llm.common import ROW_KEY, keyed, words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.tokenize(spark, table(spark, sf_dir, "documents"), sf_dir)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), stages.MIN_DOCS)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = url_filter.filter_urls(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "host", "path", "rule", "verdict")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.linked_vectors(table(spark, sf_dir, "embeddings"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_shingles", "component_id", "kept")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


# A user gives a secret of their own.
PII_KEY = b"registered query"


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_entities(docs, PII_KEY)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.measured(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = keyed(docs, "doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    return counted.join(license_scan.scan(docs), ROW_KEY, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, toxicity.training_rows(table(spark, sf_dir, "labels")))
    rows = toxicity.score(docs, model).drop("text")
    return rows.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "n_covered",
    )


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_line_dedup": op2_line_dedup,
    "op3_url_filters": op3_url_filters,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_pii": op7_pii,
    "op8_decontamination": op8_decontamination,
    "op9_license_scans": op9_license_scans,
    "op10_toxicity": op10_toxicity,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_quality_rules": op12_quality_rules,
    "op13_centroid_clustering": op13_centroid_clustering,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = {
    "op2_line_dedup": r"""
with lines as (
  select rowid as r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
  from (select row_number() over () as rowid, * from documents)
), keys as (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines
), bad as (
  select key from keys where length(key) >= 1 group by key having count(distinct r) >= 10
), marked as (
  select k.*, b.key is not null as gone from keys k left join bad b on k.key = b.key
)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by r, doc_id
""",
    "op3_url_filters": url_filter.sql(),
    "op11_hard_negatives": hard_negatives.sql(),
    "op12_quality_rules": quality_rules.sql(),
    "op13_centroid_clustering": centroid_clustering.sql(),
    "op8_decontamination": rf"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as ws from documents),
i as (select item_id, {_WORDS} as ws from benchmark),
iw as (
  select distinct item_id, least(len(ws), 10) as len, array_to_string(ws[s:s + least(len(ws), 10) - 1], ' ') as win
  from (select *, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) as s from i where len(ws) > 0)
),
lens as (select distinct len from iw),
dw as (
  select r, s, len, array_to_string(ws[s:s + len - 1], ' ') as win
  from (select d.r, d.ws, l.len, unnest(range(1, greatest(len(d.ws) - l.len + 2, 1))) as s from d, lens l)
),
hit as (select dw.r, dw.s, dw.len, iw.item_id from dw join iw on dw.len = iw.len and dw.win = iw.win),
covered as (select r, count(distinct p) as n_hit from (select r, unnest(range(s, s + len)) as p from hit) group by r),
named as (
  select r, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items
  from hit group by r
)
select d.doc_id, len(d.ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (r) left join named using (r)
""",
}
