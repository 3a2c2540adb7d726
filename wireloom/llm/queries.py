"""The thin ``opN_`` queries over the driver tables, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wireloom.llm import byte_bpe, jaccard_join, language_id, license_scan, media, packing, quality, sharding, token_counts, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: By all pairs that share an n-gram, and what links reach.
OP1_SQL = r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as grams from w),
s as (select doc_id, len(grams) as n, unnest(grams) as gram from g),
p as (select a.doc_id as a, b.doc_id as b, any_value(a.n) + any_value(b.n) as both_sizes, count(*) as shared from s a join s b on a.gram = b.gram and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p where 100 * shared >= 75 * (both_sizes - shared)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as node, doc_id as reached from g union select r.node, e.b from r join e on e.a = r.reached)
select g.doc_id, len(g.grams) as n_shingles, min(r.reached) as component_id from g join r on r.node = g.doc_id group by all"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


TOKEN_BUDGET = 512


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = token_counts.prefix_tables(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    facts = tables.withColumn("facts", token_counts.budget_facts(F.col("token_steps"), TOKEN_BUDGET))
    return facts.select(
        "doc_id", "n_bytes", "facts.n_tokens", (F.col("facts.n_tokens") > TOKEN_BUDGET).alias("over_limit"), "facts.fitting_chars"
    )


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = license_scan.scan(table(spark, sf_dir, "documents"))
    best = F.try_element_at(F.sort_array(F.transform("licences", lambda x: F.struct((-x["score"]).alias("s"), x["paragraph"], x["family"]))), F.lit(1))
    return scanned.withColumn("best", best).select(
        "doc_id",
        F.col("best.family").alias("family"),
        (-F.col("best.s")).alias("score"),
        F.col("best.paragraph").alias("paragraph"),
        F.array_join(F.sort_array(F.array_distinct("licences.family")), ",").alias("families"),
        F.size("licences").alias("n_paragraphs"),
        "n_unknown",
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), columns=["doc_id"])
    return judged.select("row.doc_id", "quality.*")


RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, url_filter.rule_table(spark, RULES))


OP7_SQL = """
with rules(action, rule) as (values %s),
parts as (
  select row_number() over () as n, page_id,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1, 's'), '') as path
  from pages),
hits as (
  select n, max_by(rule, length(rule)) as rule, max_by(action, length(rule)) as action
  from parts, rules
  where (host = split_part(rule, '/', 1) or ends_with(host, '.' || split_part(rule, '/', 1)))
    and starts_with(path, substr(rule, strpos(rule, '/')))
  group by n)
select page_id, host, path, hits.rule as rule, coalesce(hits.action, 'allow') as verdict
from parts left join hits using (n)
""" % ", ".join(f"('{a}', '{r}')" for a, r in RULES)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.deal(sharding.external_shuffle(table(spark, sf_dir, "documents")), 16)
    text = F.coalesce(F.col("record.text"), F.lit(""))
    return dealt.select(
        "record.doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("bucket"),
        F.col("place"),
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), ranks), ranks)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.text_media(table(spark, sf_dir, "documents"))
    probed = media.media_columns(stored).withColumn("facts", media.payload_facts(F.col("media")))
    keys = F.col("media_info.keyframes")
    place = lambda k: F.concat(k["start"].cast("string"), F.lit("+"), k["length"].cast("string"))
    return probed.select(
        "doc_id",
        "n_bytes",
        "facts.payload_bytes",
        "facts.payload_sha256",
        "facts.tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            " ",
            F.concat(F.lit("codec="), F.trim("media_info.codec")),
            F.concat(F.lit("size="), F.col("media_info.width").cast("string"), F.lit("x"), F.col("media_info.height").cast("string")),
            F.concat(F.lit("duration_ms="), F.round(F.col("media_info.duration_s") * 1000).cast("long").cast("string")),
            F.concat(F.lit("samples="), F.col("media_info.n_samples").cast("string")),
            F.concat(F.lit("keyframes="), F.size(keys).cast("string")),
            F.concat(F.lit("first="), place(F.element_at(keys, 1))),
            F.concat(F.lit("last="), place(F.element_at(keys, -1))),
        ).alias("feature"),
    )


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_language_id": op2_language_id,
    "op3_token_counts": op3_token_counts,
    "op4_license_scans": op4_license_scans,
    "op5_packing": op5_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_url_filters": op7_url_filters,
    "op8_sharding": op8_sharding,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_media_columns": op10_media_columns,
}
ORACLES = {"op1_ngram_jaccard_join": OP1_SQL, "op7_url_filters": OP7_SQL}
