"""The queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, langid, lines, mixing, nearest, packing, quality, rendering, simhash
from .shared import stored, table


def op1_tool_call_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.linked(chat.events(table(spark, sf_dir, "conversations")))
    return found.select("conv_id", "turn", "kind", "call_id", "linked_turn", "level", "valid", F.concat_ws("; ", "errors").alias("errors"), "json")


#: Calls are user turns, results the assistant turns right after them.
OP1_SQL = """
WITH m AS (SELECT conv_id, turn, coalesce(role, 'none') AS role, text FROM conversations),
e AS (SELECT *,
        CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
        CASE role WHEN 'user' THEN conv_id || ':' || turn WHEN 'assistant' THEN conv_id || ':' || (turn - 1) END AS call_id FROM m),
a AS (SELECT conv_id, call_id, min(turn) AS answered FROM e WHERE kind = 'result' GROUP BY ALL),
q AS (SELECT conv_id, call_id, min(turn) AS asked, count(*) AS times FROM e WHERE kind = 'call' GROUP BY ALL),
l AS (SELECT e.*, CASE kind WHEN 'call' THEN answered WHEN 'result' THEN asked END AS linked_turn,
        CASE kind WHEN 'call' THEN list_filter([CASE WHEN text IS NULL THEN 'missing text' END, CASE WHEN answered IS NULL THEN 'no result' END, CASE WHEN times > 1 THEN 'repeated call id' END], lambda x: x IS NOT NULL)
                  WHEN 'result' THEN CASE WHEN asked IS NULL THEN ['no call'] ELSE [] END ELSE [] END AS errs
      FROM e LEFT JOIN a USING (conv_id, call_id) LEFT JOIN q USING (conv_id, call_id))
SELECT conv_id, turn, kind, call_id, linked_turn, 0 AS level, len(errs) = 0 AS valid, array_to_string(errs, '; ') AS errors,
  '{' || CASE WHEN kind = 'call' THEN '"arguments":{' || coalesce('"text":' || to_json(text)::VARCHAR, '') || '},' ELSE '' END
  || coalesce('"call_id":' || to_json(call_id)::VARCHAR || ',', '')
  || CASE WHEN kind <> 'call' AND text IS NOT NULL THEN '"content":' || to_json(text)::VARCHAR || ',' ELSE '' END
  || '"errors":' || CASE WHEN len(errs) = 0 THEN '[]' ELSE to_json(errs)::VARCHAR END
  || ',"kind":"' || kind || '",' || coalesce('"linked_turn":' || linked_turn || ',', '')
  || CASE WHEN kind = 'call' THEN '"name":"reply",' ELSE '' END || '"role":' || to_json(role)::VARCHAR || ',"turn":' || turn || '}' AS json
FROM l
"""


def op2_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendering.extract(table(spark, sf_dir, "pages")).select("page_id", "text")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup(docs).select("doc_id", "lines_gone", "text")


def op4_simhash_vantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"), words=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def vocabulary() -> tuple[str, str]:
    """Path of the tokenizer and its split pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def op5_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.cut(table(spark, sf_dir, "documents"), *vocabulary(), capacity=2048)
    digest = cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.assign(stored(digest, "pieces"), capacity=2048).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_multi_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").filter(nearest.sound("embedding")).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v"))
    return nearest.nearest_codes(nearest.sign_codes(vectors), every=50, k=10).select("query_id", "rank", "vec_id", F.col("score").cast("int").alias("distance"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = langid.fit(docs, parts=4, held=2)
    return langid.predict(docs, models).select("doc_id", F.coalesce(quality.fold_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op8_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.totals(placed, mixed).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), folds=5, held=0)
    return quality.score(docs.select("doc_id", "text"), model, threshold=0.3).select(
        "doc_id",
        F.coalesce(quality.fold_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        F.col("quality_score").alias("score"),
        F.col("quality_predicted").alias("predicted"),
    )


def op10_block_matrix_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), every=100, k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_tool_call_links": op1_tool_call_links,
    "op2_layout_text": op2_layout_text,
    "op3_line_dedup": op3_line_dedup,
    "op4_simhash_vantage": op4_simhash_vantage,
    "op5_harmonic_packing": op5_harmonic_packing,
    "op6_multi_index_topk": op6_multi_index_topk,
    "op7_language_id": op7_language_id,
    "op8_mix_to_weights": op8_mix_to_weights,
    "op9_quality_nbsvm": op9_quality_nbsvm,
    "op10_block_matrix_ann": op10_block_matrix_ann,
}

ORACLE_SQL: dict[str, str] = {"op1_tool_call_links": OP1_SQL}
