"""The queries of this subpackage: thin digests of the operators over whole tables, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import chat, decontamination, licenses, mixing, pii, quality, secrets, sharding, simhash, tokens
from loomtext.llm.common import read_table


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.document_digests(tokens.write_store(read_table(spark, sf_dir, "documents")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "votes", "quality")
    return quality.judge(read_table(spark, sf_dir, "documents")).select(*columns)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("score", 6).alias("score"), "start_word", "end_word")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(read_table(spark, sf_dir, "documents"))


#: The conversation that the contract adds.
EXTRA = "SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(t AS BIGINT) AS turn, r AS role, concat(chr(92), '### Assistant: </turn> ok') AS text FROM VALUES (0, 'user'), (1, 'assistant') AS v(t, r)"


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(EXTRA))
    t = chat.Template()
    done = chat.format_conversations(turns, t).withColumn("formatted", chat.formatted_text(F.col("segments"))).withColumn("parsed", chat.parse_formatted(F.col("formatted"), t))
    said = F.array_join(F.transform("parsed", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: t.decode(s["content"])), "")
    return done.select(
        "conv_id", F.size("parsed").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


OP7_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
coded AS (
  SELECT *, length(replace(replace(replace(text, '\', '\\'), '### ', '#\-## '), '</turn>', '<\-/turn>'))
          + length(replace(replace(replace(replace(role, '\', '\\'), '### ', '#\-## '), '</turn>', '<\-/turn>'), ': ', ':\- ')) + 4 + 2 + 8 AS n,
         coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), 'start') || '>' || role AS step,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars,
  bool_and(step IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user')) AND bool_or(from_end = 1 AND role = 'assistant') AS valid
FROM coded GROUP BY conv_id
"""


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_simhash": op2_simhash,
    "op3_quality": op3_quality,
    "op4_decontamination": op4_decontamination,
    "op5_secrets": op5_secrets,
    "op6_mixing": op6_mixing,
    "op7_chat": op7_chat,
    "op8_licenses": op8_licenses,
    "op9_sharding": op9_sharding,
    "op10_pii": op10_pii,
}

SQL: dict[str, str] = {"op7_chat": OP7_SQL}
