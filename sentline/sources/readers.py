"""Sources: files, encodings, formats and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_bom, sub
from ..session import ship
from .rtf import rtf_text


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def encoding_of(content: Column) -> Column:
    """utf-16le or utf-16be by byte order mark, utf-8 if valid, else iso-8859-1; empty content is utf-8."""
    head = F.hex(F.substring(content, 1, 2))
    return F.when(head == "FFFE", "utf-16le").when(head == "FEFF", "utf-16be").when(F.is_valid_utf8(content.cast("string")) | (F.length(content) == 0), "utf-8").otherwise("iso-8859-1")


def decoded(content: Column) -> Column:
    """Text of content in its detected encoding, without a byte order mark. An odd last byte of UTF-16 is dropped."""
    enc = encoding_of(content)
    even = F.substring(content, F.lit(1), (F.length(content) / 2).cast("int") * 2)
    text = (
        F.when(enc == "utf-16le", F.decode(even, "UTF-16LE")).when(enc == "utf-16be", F.decode(even, "UTF-16BE")).when(enc == "utf-8", F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))
    )
    return strip_bom(text)


def format_of(text: Column) -> Column:
    return F.when(text.startswith("{\\rtf"), "rtf").otherwise("text")


def read_texts(spark: SparkSession, path: str, input_format: str = "auto") -> DataFrame:
    """path, text of files: decoded, and RTF turned into text with a blank line for each paragraph."""
    ship(spark)
    t = binary_files(spark, path).select("path", decoded(F.col("content")).alias("text"))
    if input_format == "text":
        return t
    is_rtf = F.lit(True) if input_format == "rtf" else format_of(F.col("text")) == "rtf"
    plain = t.filter(~is_rtf)
    return plain.unionByName(t.filter(is_rtf).select("path", rtf_text(F.col("text")).alias("text")))


def list_entries(text: Column) -> Column:
    """Array of struct(entry, flagged) of a list: one entry per line, a leading blank or tab flags it, a last line
    without an end is not read, empty entries are left out."""
    ls = F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n")
    ended = F.slice(ls, 1, F.size(ls) - 1)
    rows = F.transform(ended, lambda x: F.struct(sub(x, r"^[ \t]+").alias("entry"), x.rlike(r"^[ \t]").alias("flagged")))
    return F.filter(rows, lambda r: r["entry"] != "")


def list_file(spark: SparkSession, path: str) -> DataFrame:
    """entry, flagged of a list file."""
    return binary_files(spark, path).select(F.inline(list_entries(decoded(F.col("content")))))
