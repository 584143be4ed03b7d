"""Readers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small, spread, table


def source_texts(spark: SparkSession, sf: str, *intakes: str) -> DataFrame:
    """file_id, intake, lang, text of every delivery of the given intakes (all when none is given).

    Deliveries repeat; operators that return few small columns apply distinct() to their result,
    which is cheaper than shuffling the texts to deduplicate first.
    """
    df = table(spark, sf, "source_files").select("file_id", "intake", "lang", F.col("sourcefile").alias("text"))
    return df.filter(F.col("intake").isin(*intakes)) if intakes else df


def target_texts(spark: SparkSession, sf: str, *intakes: str) -> DataFrame:
    """run_id, file_id, text of every run over files of the given intakes. The texts stay where they are as long as the ids of
    the files are few enough to go to every executor; that is measured."""
    runs = table(spark, sf, "target_files").select("run_id", "file_id", F.col("targetfile").alias("text"))
    files = table(spark, sf, "source_files").filter(F.col("intake").isin(*intakes)).select("file_id").distinct()
    return runs.filter(F.col("text").isNotNull()).join(broadcast_if_small(files), "file_id", "left_semi")


def field_texts(spark: SparkSession, sf: str, *intakes: str) -> DataFrame:
    """field, id, text over both text fields; nulls left out."""
    src = source_texts(spark, sf, *intakes).select(F.lit("sourcefile").alias("field"), F.col("file_id").alias("id"), "text")
    tgt = target_texts(spark, sf, *intakes).select(F.lit("targetfile").alias("field"), F.col("run_id").alias("id"), "text")
    return spread(src).unionByName(spread(tgt)).filter(F.col("text").isNotNull())


def text_hash(c: Column | str) -> Column:
    """128 bits of a text as a string: equality of texts without carrying them through a shuffle."""
    c = F.col(c) if isinstance(c, str) else c
    return F.md5(c.cast("binary"))


def within(c: Column, span: str, fn: Callable[[Column], Column]) -> Column:
    """fn() of each stretch that a pattern without groups matches, from left to right; what lies between stays."""
    found = F.transform(F.regexp_extract_all(c, F.lit(f"({span})"), 1), fn)
    return F.array_join(F.zip_with(F.split(c, span), F.concat(found, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
