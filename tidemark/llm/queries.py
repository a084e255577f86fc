"""Registered queries of the corpus operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, main_text, media, near_duplicates, packing, pieces, quality_model, quality_rules, surrogates, url_templates
from tidemark.llm.common import crc_mod, importable

#: A deployment takes its own secret from its configuration.
SURROGATE_KEY = "tidemark"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def put(f):
        def run(spark, sf_dir):
            importable(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


@query(near_duplicates.sql(4, 80))
def op1_near_duplicates(spark, d):
    return near_duplicates.near_duplicates(table(spark, d, "documents"), size=4)


@query()
def op2_language(spark, d):
    docs = table(spark, d, "documents")
    held_out = crc_mod(F.col("doc_id"), 3, 1)
    model = langid.fit(docs, ~crc_mod(F.col("id"), 3, 1))
    return langid.identify(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query()
def op3_media(spark, d):
    docs = table(spark, d, "documents").withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
    return media.media_digest(media.media_columns(docs, ["doc_id", "n_bytes"]), ["doc_id", "n_bytes"])


@query(media.SQL)
def media_payload(spark, d):
    """The columns of op3_media that do not depend on its container, beside the same in SQL."""
    return op3_media(spark, d).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")


@query()
def op4_pieces(spark, d):
    return pieces.digest(table(spark, d, "documents"), ["doc_id"])


@query(quality_rules.SQL)
def op5_quality_rules(spark, d):
    return quality_rules.quality_rules(table(spark, d, "documents")).drop("lost_chars", "n_lines_removed", "clean_text")


@query()
def op6_packing(spark, d):
    return packing.pack_documents(table(spark, d, "documents"))


@query()
def op7_surrogates(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return surrogates.replace_personal_data(docs, SURROGATE_KEY, count_into="n_mentions")


@query(main_text.article_sql())
def op8_main_text(spark, d):
    return main_text.main_text(table(spark, d, "pages"))


@query()
def op9_quality_model(spark, d):
    docs, held_out = table(spark, d, "documents"), crc_mod(F.col("doc_id"), 4, 2)
    model = quality_model.fit(docs, table(spark, d, "labels"), ~held_out)
    scored = quality_model.score(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= quality_model.THRESHOLD, 1).otherwise(0).alias("predicted"))


@query(url_templates.sql())
def op10_url_templates(spark, d):
    return url_templates.filter_urls(table(spark, d, "pages"))
