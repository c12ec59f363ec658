"""Helpers shared by the corpus operators: white space, row identity, table access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and the control characters tab to carriage return.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"

LAST_ID = (1 << 63) - 1


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Maximal runs without white space; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def count_words(text: Column) -> Column:
    """Number of words as long, without keeping them: what the blanks between them leave."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, BLANK_RUN))).cast("long")


def packed(docs: DataFrame) -> DataFrame:
    """All columns as one struct `doc`, so that no column of a caller can clash with one of an operator."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def with_text(docs: DataFrame, text: Column) -> list[Column]:
    """The columns of docs out of `doc`, with another text and, where the table has one, its length."""
    out = []
    for c in docs.columns:
        value = F.col(f"doc.`{c}`")
        if c == "text":
            value = text
        elif c == "n_chars":
            value = F.length(text).cast(docs.schema[c].dataType)
        out.append(value.alias(c))
    return out


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on a costly computed column.

    A plain filter would be pushed below the projections that compute the column and so repeat them. It isn't pushed
    past a column of row numbers that it reads.
    """
    return df.withColumn("row_number_", F.monotonically_increasing_id()).where(condition & (F.col("row_number_") >= 0)).drop("row_number_")


def computed_once(df: DataFrame, *names: str) -> DataFrame:
    """Costly columns that no later filter computes again.

    A filter on such a column would be pushed below the projections that compute it, each time with all it is made of. It
    stops above a column of row numbers that the named columns read.
    """
    numbered = df.withColumn("row_number_", F.monotonically_increasing_id())
    return numbered.withColumns({n: F.when(F.col("row_number_") >= 0, F.col(n)) for n in names}).drop("row_number_")
