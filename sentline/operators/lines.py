"""Lines of a text: noise, bullets and words cut at line ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import classes as K
from ..functions.text import noise, normalize_eol, sub

BULLET = rf"^[ \t]*([{K.BULLETS}]+)[ \t]+(.*)$"


def lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line_no, line: one row per line, numbered from 0, empty ones included."""
    x = df.select(key, F.posexplode(F.split(normalize_eol(F.col(text)), "\n")).alias("line_no", "line"))
    return x.select(key, F.col("line_no").cast("bigint").alias("line_no"), "line")


def look_ahead(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line_no, ink_end: characters of a line up to its last one that is no blank, so that what is ahead of a place is known."""
    return lines(df, key, text).select(key, "line_no", F.length(sub(F.col("line"), f"[{K.FLAT_SPACE}]+\\z")).cast("bigint").alias("ink_end"))


def noise_filtered(df: DataFrame, key: str, limit: float = 0.44, text: str = "text") -> DataFrame:
    """key, text: noisy lines emptied, their breaks kept. Row-wise."""
    kept = F.transform(F.split(normalize_eol(F.col(text)), "\n"), lambda x: F.when(noise(x) < limit, x).otherwise(F.lit("")))
    return df.select(key, F.array_join(kept, "\n").alias("text"))


def bullet_lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line_no, is_bullet, bullet, content."""
    x = lines(df, key, text)
    is_b = F.col("line").rlike(BULLET)
    return x.select(key, "line_no", is_b.alias("is_bullet"), F.regexp_extract("line", BULLET, 1).alias("bullet"), F.when(is_b, F.regexp_extract("line", BULLET, 2)).otherwise(F.col("line")).alias("content"))


def bullet_runs(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line_no, run_no, in_run, confirmed: consecutive bullet lines form a run; in_run counts within it, and a
    bullet is confirmed if a neighbouring line repeats its mark."""
    b = bullet_lines(df, key, text)
    w = W.partitionBy(key).orderBy("line_no")
    b = b.withColumn("run_no", F.sum((~F.col("is_bullet")).cast("bigint")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    same = lambda c: F.coalesce(c == F.col("bullet"), F.lit(False))
    b = b.withColumn("confirmed", same(F.lag("bullet").over(w)) | same(F.lead("bullet").over(w)))
    b = b.filter("is_bullet")
    return b.select(key, "line_no", "run_no", F.row_number().over(W.partitionBy(key, "run_no").orderBy("line_no")).cast("bigint").alias("in_run"), "confirmed")


def bullets_emitted(df: DataFrame, key: str, mode: str = "keep", char: str = "*", separate: bool = False, text: str = "text") -> DataFrame:
    """key, text with bullets kept, replaced by char and a blank, or dropped. With separate, the first five of
    consecutive bullets get blank lines around them. Row-wise: the run length is folded over the lines."""
    ls = F.split(normalize_eol(F.col(text)), "\n")

    def shown(line: Column) -> Column:
        body = F.regexp_extract(line, BULLET, 2)
        return F.when(line.rlike(BULLET), {"keep": line, "replace": F.concat(F.lit(char + " "), body), "drop": body}[mode]).otherwise(line)

    if not separate:  # lines don't depend on each other
        return df.select(key, F.array_join(F.transform(ls, shown), "\n").alias("text"))

    def fold(acc: Column, line: Column) -> Column:
        n = F.when(line.rlike(BULLET), acc["n"] + 1).otherwise(0)
        out = F.when((n > 0) & (n <= 5), F.concat(F.lit("\n"), shown(line), F.lit("\n"))).otherwise(shown(line))
        return F.struct(n.cast("int").alias("n"), F.concat(acc["out"], F.array(out)).alias("out"))

    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))
    return df.select(key, F.array_join(F.aggregate(ls, start, fold)["out"], "\n").alias("text"))


def dehyphenated(text: Column) -> Column:
    """Words cut by a hyphen at a line end, joined pair by pair from left to right.

    Both parts hold a vowel and agree in case (the first letter of the left part aside): joined. A case
    mismatch or a left part without a vowel keeps the hyphen and drops the line break. A right part of one letter
    keeps both. A hyphen before an empty line, or inside a line, stays.
    """
    v, low, up = K.VOWELS, r"\p{Ll}", r"\p{Lu}"
    lv, uv = "".join(c for c in v if c.islower()), "".join(c for c in v if c.isupper())
    eol = r"-[ \t]*\n[ \t]*"
    t = normalize_eol(text)
    guard_l = r"((?:(?m:^)|[^\p{L}\p{N}-])"
    # the left part: letters and hyphens with a vowel; its case looks at all letters but the first
    lower_left = rf"{guard_l}(?:\p{{L}}[{low}-]*[{lv}][{low}-]*|[{v}][{low}-]*))"
    upper_left = rf"{guard_l}(?:\p{{L}}[{up}-]*[{uv}][{up}-]*|[{uv}][{up}-]*))"
    t = sub(t, rf"{lower_left}{eol}(?=[{low}]{{2}}|[{low}][.!?])(?=[{low}]*[{lv}])", "$1")
    t = sub(t, rf"{upper_left}{eol}(?=[{up}]{{2}}|[{up}][.!?])(?=[{up}]*[{uv}])", "$1")
    # other letters after the break: the hyphen stays, the break goes
    return sub(t, rf"((?m:^)|[^-\n]){eol}(?=\p{{L}}{{2}}|\p{{L}}[.!?])", "$1-")
