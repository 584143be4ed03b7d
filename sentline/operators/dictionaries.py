"""Abbreviations and multi-word units joined with texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import sub
from ..session import broadcast_if_small
from .segment import MAX_DICTIONARY, affixes, chunks, dictionary_rows, sentences

PHRASE_OPEN, PHRASE_CLOSE = "\n", "\t"  # a sentence holds neither


def abbreviation_hits(df: DataFrame, key: str, abbreviations: DataFrame, how: str = "inner") -> DataFrame:
    """key, para_no, chunk_no, abbr of words with a final dot, joined (inner, left_semi, left_anti) with the dictionary.

    Only chunks that end in a dot are looked at."""
    c = chunks(df, key, ending=".").select(key, "para_no", "chunk_no", F.explode(F.array(affixes(F.col("chunk")))).alias("a"))
    c = c.filter((F.col("a.tail") == ".") & (F.col("a.core") != "")).select(key, "para_no", "chunk_no", F.lower(F.concat("a.core", F.lit("."))).alias("abbr"))
    return c.join(broadcast_if_small(dictionary_rows(abbreviations)), "abbr", how)


def phrase_rows(phrases: DataFrame) -> DataFrame:
    """phrase (single blanks), n_words: one row per entry; empty ones left out."""
    p = phrases.select(F.trim(F.regexp_replace("phrase", "[ \t]+", " ")).alias("phrase")).filter("phrase <> ''")
    return p.distinct().withColumn("n_words", F.size(F.split("phrase", " ")).cast("bigint"))


def phrase_candidates(df: DataFrame, key: str, phrases: DataFrame, text: str = "text") -> DataFrame:
    """key, sent_no, start, phrase, n_words: every match of a phrase at a word start of a tokenised sentence.

    Grams of the lengths that occur in the dictionary are made in the row, only where a phrase can begin (as long as the
    first words of phrases are few enough for a set in the plan), and joined by equality.
    """
    p = phrase_rows(phrases)
    heads = p.select(F.substring_index("phrase", " ", 1).alias("head"), "n_words").distinct().limit(MAX_DICTIONARY + 1).collect()
    sizes = sorted({r.n_words for r in (heads if len(heads) <= MAX_DICTIONARY else p.select("n_words").distinct().collect())})  # phrase lengths, a handful of numbers
    firsts = sorted({r.head for r in heads}) if len(heads) <= MAX_DICTIONARY else None
    s = sentences(df, key, None, text)
    words = s.select(key, "sent_no", F.split("sentence", " ").alias("w"))
    at = F.transform("w", lambda x, i: F.when(x.isin(*firsts) if firsts else F.lit(firsts is None), i + 1))
    words = words.withColumn("at", F.array_compact(at)).filter(F.size("at") > 0)
    fit = lambda i: F.transform(F.filter(F.array(*[F.lit(n) for n in sizes]), lambda n: i + n - 1 <= F.size("w")), lambda n: F.struct((i - 1).cast("bigint").alias("start"), F.array_join(F.slice("w", i, n), " ").alias("phrase")))
    none = F.array().cast("array<struct<start:bigint,phrase:string>>")
    g = words.select(key, "sent_no", F.inline(F.flatten(F.transform("at", fit)) if sizes else none))
    return g.join(broadcast_if_small(p), "phrase").select(key, "sent_no", "start", "phrase", "n_words")


def longest_phrases(candidates: DataFrame, key: str) -> DataFrame:
    """The longest match at each start."""
    w = W.partitionBy(key, "sent_no", "start").orderBy(F.desc("n_words"))
    return candidates.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def phrase_pattern(phrases: DataFrame | None) -> str | None:
    """Regex of the phrases, longer before shorter, as a tree of common beginnings. A list of phrases is configuration, as
    that of abbreviations is, and as small."""
    if phrases is None:
        return None
    rows = [r.phrase for r in phrase_rows(phrases).limit(MAX_DICTIONARY + 1).collect()]
    if len(rows) > MAX_DICTIONARY:
        raise ValueError(f"a list may hold {MAX_DICTIONARY} phrases")
    tree: dict = {}
    for phrase in rows:
        node = tree
        for ch in phrase:
            node = node.setdefault(ch, {})
        node[""] = {}

    def regex(node: dict) -> str:
        longer = [("\\" + ch if not (ch.isalnum() or ch == " ") and ch.isascii() else ch) + regex(below) for ch, below in sorted(node.items()) if ch]
        if not longer:
            return ""
        body = longer[0] if len(longer) == 1 else "(?:" + "|".join(longer) + ")"
        return f"(?:{body}|)" if "" in node else body

    return f"(?<![^ ])({regex(tree)})(?![^ ])" if rows else None


def phrases_joined(sentence: Column, pattern: str | None) -> Column:
    """A sentence with each phrase's blanks as '_': left to right, the longest match at each word, none inside another."""
    if pattern is None:
        return sentence
    marked = sub(sentence, pattern, f"{PHRASE_OPEN}$1{PHRASE_CLOSE}")
    joined = sub(marked, f" (?=[^{PHRASE_OPEN}{PHRASE_CLOSE}]*{PHRASE_CLOSE})", "_")
    return F.when(sentence.rlike(pattern), sub(joined, f"[{PHRASE_OPEN}{PHRASE_CLOSE}]")).otherwise(sentence)


def multi_word_text(df: DataFrame, key: str, phrases: DataFrame, text: str = "text") -> DataFrame:
    """key, sent_no, sentence with multi-word units joined. Row-wise."""
    return sentences(df, key, None, text).select(key, "sent_no", phrases_joined(F.col("sentence"), phrase_pattern(phrases)).alias("sentence"))
