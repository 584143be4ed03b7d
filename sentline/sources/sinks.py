"""Sinks: whole documents and encoded files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import eol_style


def document_text(sentences: DataFrame, key: str, blank_between_paragraphs: bool = True) -> DataFrame:
    """key, text: one sentence per line, a blank line between paragraphs, a final newline.

    One document is the largest unit that a task holds."""
    g = sentences.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("para_no", "sent_no", "sentence"))).alias("s"))
    before = F.concat(F.array(F.lit(None).cast("bigint")), F.transform(F.slice("s", 1, F.size("s") - 1), lambda x: x["para_no"]))
    gap = "\n\n" if blank_between_paragraphs else "\n"
    pieces = F.zip_with("s", before, lambda x, p: F.concat(F.when(p.isNull(), "").when(p == x["para_no"], "\n").otherwise(gap), x["sentence"]))
    return g.select(key, F.concat(F.array_join(pieces, ""), F.lit("\n")).alias("text"))


def with_eol(text: Column, original: Column) -> Column:
    """Line ends as the original's first one; a plain newline where it has none."""
    style = eol_style(original)
    return F.when(style.isin("", "\n"), text).otherwise(F.replace(text, F.lit("\n"), style))


def encoded(text: Column, encoding: str) -> Column:
    """Bytes of a text. UTF-16 gets a byte order mark and a carriage return before each newline; characters that an
    8-bit encoding lacks become '?'."""
    if encoding == "utf-16":
        return F.concat(F.unhex(F.lit("FFFE")), F.encode(F.regexp_replace(text, r"(?<!\r)\n", "\r\n"), "UTF-16LE"))
    if encoding == "iso-8859-1":
        return F.encode(F.regexp_replace(text, r"[^\x{00}-\x{FF}]", "?"), "ISO-8859-1")
    return F.encode(text, "UTF-8")


def write_lines(sentences: DataFrame, key: str, path: str) -> None:
    """One sentence per line as text files, in order within a document; a document's lines are in one file."""
    s = sentences.repartition(key).sortWithinPartitions(key, "sent_no")
    s.select(F.col("sentence").alias("value")).write.mode("overwrite").text(path)
