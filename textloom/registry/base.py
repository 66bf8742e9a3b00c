"""What the registered queries share: table access and SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# DuckDB fragments.  RE2 has no look-around, so a sentence break is marked with
# U+001F and split there; the result is the same.
SENTENCE_START = "A-ZÁÉÍÓÚÂÊÎÔÛÃÕÀÄËÏÖÜÇ0-9"
TRIMMED = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def sql_trim(c: str) -> str:
    return TRIMMED.format(c=c)


def sql_sentences(c: str) -> str:
    marked = (
        rf"regexp_replace({sql_trim(c)}, '([.!?;:])\s+([{SENTENCE_START}])', "
        r"concat('\1', chr(31), '\2'), 'g')"
    )
    return f"list_filter(string_split({marked}, chr(31)), lambda x: x <> '')"


def sql_text(value: str) -> str:
    """A SQL literal."""
    return "'" + value.replace("'", "''") + "'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition a table whose file layout gives fewer splits than cores.

    A large table has splits enough and passes through untouched.  The key is
    the one later steps group by, so they do not shuffle again.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = table(spark, sf_dir, "documents")
    return spread(df.select(*(columns or df.columns)), "doc_id")
