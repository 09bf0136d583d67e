"""CJK corpora derived from tables without any, by integer arithmetic and character maps only, so that another SQL
engine derives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATORS = ("，", "。", "", " “", "”")

#: Stand-ins for the letters a to z: regional variants, compatibility and rare characters.
LETTERS = "台爲裏着麪說衞線群啓汉語国學\uf900\uf901\uf902\u2f00\u2f01\u2f02𬴂𠀾惡德為這"


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files give fewer partitions; larger inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def phrase_keys(keys) -> list[str]:
    return sorted(keys)


def phrase_corpus(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    """(doc_id, src): each order is a document of phrases picked by its lines."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    at = F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))
    word = F.concat(pick(keys), pick(SEPARATORS))
    rows = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").cast("long").alias("n"), word.alias("w")))).alias("ws"))
    return rows.select(F.col("l_orderkey").alias("doc_id"), F.array_join(F.transform("ws", lambda x: x["w"]), "").alias("src"))


def phrase_sql(keys: list[str]) -> str:
    """The same as DuckDB SQL: a query with doc_id and src."""
    lit = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
    at = "(l_orderkey * 7 + l_linenumber * 13)"
    word = f"{lit(keys)}[CAST({at} % {len(keys)} + 1 AS INT)] || {lit(SEPARATORS)}[CAST({at} % {len(SEPARATORS)} + 1 AS INT)]"
    return f"SELECT l_orderkey AS doc_id, string_agg({word}, '' ORDER BY l_linenumber, {word}) AS src FROM lineitem GROUP BY l_orderkey"


def letter_corpus(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """(doc_id, src): texts with letters replaced by CJK characters."""
    key = "doc_id" if table == "documents" else "conv_id"
    docs = spread(spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key, "text"))
    return docs.select(F.col(key).alias("doc_id"), F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxyz", LETTERS).alias("src"))


def letter_sql(table: str = "documents") -> str:
    key = "doc_id" if table == "documents" else "conv_id"
    return f"SELECT {key} AS doc_id, translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', '{LETTERS}') AS src FROM {table}"
