"""Problem 1: texts that look the same but are written with different characters.

A text is split by a quick check into stable stretches and unstable segments. Only an unstable
segment, taken with its boundary context (the starter before it and the marks after it), is
normalised; the result is spliced into the untouched rest. Texts without an unstable character never
leave the JVM.

Null text gives null; an empty text gives an empty text; a text of invisible characters only
becomes empty. Letter case, superscripts, dash lengths and line breaks are kept apart.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .common import field_texts, text_hash

# Decomposition kinds of the Unicode character database whose forms look like what they stand for.
SAME_LOOK_TAGS = ("<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
# Ranges of joined letters, Roman numerals and radicals that are compatibility characters of the same look.
SAME_LOOK_RANGES = ((0x00B5, 0x00B5), (0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x0587, 0x0587), (0x2024, 0x2024), (0x2103, 0x2103), (0x2109, 0x2109), (0x2160, 0x217F), (0x2E9F, 0x2E9F), (0x2F00, 0x2FD5), (0xFB00, 0xFB06), (0xFB13, 0xFB17))
# Format characters that do have ink and stay.
INKED_FORMATS = (0x0600, 0x0601, 0x0602, 0x0603, 0x0604, 0x0605, 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD)
# Characters without ink that are not of category Cf.
INKLESS_OTHERS = ((0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0xFE00, 0xFE0F), (0xE0100, 0xE01EF))
# Letters and marks of other blocks with the shape of the one given, as public lists of confusables have them
# for letters of one case; letters that a reader tells apart are left out.
LOOKALIKES = {
    "a": "аɑ", "c": "сϲᴄⲥꮯ", "d": "ԁ", "e": "еҽ", "f": "քꞙ", "g": "ɡց", "h": "һհ", "i": "іιꙇ", "j": "јϳ", "k": "κ", "l": "ӏ", "n": "ոռ", "o": "оοօᴏⲟ", "p": "рρⲣ", "q": "ԛգզ", "s": "ѕꜱ", "u": "υսᴜ", "v": "νѵᴠ", "w": "ԝաᴡ", "x": "х", "y": "уү", "z": "ᴢ",
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹᏟⲤ", "D": "Ꭰ", "E": "ЕΕᎬ", "F": "Ϝ", "G": "ԌᏀ", "H": "НΗᎻⲎ", "I": "ІΙӀⲒ", "J": "ЈͿᎫ", "K": "КΚᏦⲔ", "L": "Ꮮ", "M": "МΜϺᎷⲘ", "N": "ΝⲚ", "O": "ОΟՕⲞ", "P": "РΡᏢⲢ", "Q": "Ԛ", "R": "Ꮢ", "S": "ЅՏᏚ", "T": "ТΤᎢⲦ", "U": "Ս", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ХΧⲬ", "Y": "ҮΥⲨ", "Z": "ΖᏃ",
    "æ": "ӕ", "Æ": "Ӕ", "ə": "ә", "ë": "ё", "Ë": "Ё", "ï": "ї", "Ï": "Ї",
    "-": "‐‑", ":": "∶", "·": "‧∙⋅", "’": "ʼ",
}


def _ranges(cps: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for cp in cps:
        if out and out[-1][1] == cp - 1:
            out[-1][1] = cp
        else:
            out.append([cp, cp])
    return [(a, b) for a, b in out]


def _inkless(cp: int) -> bool:
    if any(a <= cp <= b for a, b in INKLESS_OTHERS):
        return True
    ch = chr(cp)
    cat = unicodedata.category(ch)
    return (cat == "Cf" and cp not in INKED_FORMATS) or (cat == "Cc" and ch not in "\t\n\r\f\v")


def _folds(cp: int) -> bool:
    d = unicodedata.decomposition(chr(cp))
    if d.startswith(SAME_LOOK_TAGS):
        return True
    return d.startswith("<") and any(a <= cp <= b for a, b in SAME_LOOK_RANGES)


@lru_cache(1)
def classes() -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Code point ranges that fail the quick check: on their own, and as marks that may combine."""
    alone, marks = [], []
    for cp in range(0x80, 0x30000):
        if 0xD800 <= cp < 0xE000 or 0x4E00 <= cp <= 0x9FFF or 0xAC00 <= cp <= 0xD7A3 or 0x20000 <= cp < 0x2F800:
            continue
        ch = chr(cp)
        if unicodedata.combining(ch) or 0x1161 <= cp <= 0x11C2 or cp in (0xFF9E, 0xFF9F):
            marks.append(cp)
        elif not unicodedata.is_normalized("NFC", ch) or _inkless(cp) or _folds(cp) or unicodedata.category(ch) == "Zs":
            alone.append(cp)
    alone += range(0xE0001, 0xE0080)
    alone += range(0xE0100, 0xE01F0)
    alone += [*range(0, 9), *range(14, 32), 9, 13, 127]
    return _ranges(sorted(set(alone))), _ranges(marks)


def java_class(ranges: list[tuple[int, int]]) -> str:
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)


def _py_class(ranges: list[tuple[int, int]]) -> str:
    return "".join(f"\\U{a:08X}" if a == b else f"\\U{a:08X}-\\U{b:08X}" for a, b in ranges)


def unstable_pattern() -> str:
    """Java regex: a text with a match may fail the quick check. Names the long stable ranges only, which keeps
    the class short; a stable character outside them sends its text through the exact check."""
    alone, marks = classes()
    bad = sorted([*alone, *marks])
    gaps = [(0x20, 0x7E), (0x0A, 0x0A)] + [(b + 1, c - 1) for (_, b), (c, _) in zip(bad, bad[1:]) if c - b > 40 and b > 0x7F]
    return f"[^{java_class(gaps)}]"


def segment_pattern() -> str:
    """Python regex of an unstable segment with its boundary context: the stable character before it, if marks follow it,
    also over characters without ink."""
    alone, marks = (_py_class(x) for x in classes())
    return f"[^{alone}{marks}]?[{alone}]*[{marks}][{alone}{marks}]*|[{alone}][{alone}{marks}]*"


@lru_cache(1 << 16)
def canonical_segment(seg: str) -> str:
    """The one form of an unstable segment."""
    out = []
    for ch in seg.replace("\r\n", "\n"):
        cp = ord(ch)
        if _inkless(cp):
            continue
        if cp in (0xFF9E, 0xFF9F):
            out.append("゙" if cp == 0xFF9E else "゚")
        elif ch == "\r":
            out.append("\n")
        elif ch == "\t" or unicodedata.category(ch) == "Zs":
            out.append(" ")
        elif _folds(cp):
            out.append(unicodedata.normalize("NFKC", ch))
        else:
            out.append(ch)
    return unicodedata.normalize("NFC", "".join(out))


def _by_segment(text: Column, found: str, pattern: str, form) -> Column:
    """Text with form() applied to the segments of a Python pattern; only texts with a match of the Java regex go
    through Python."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rx = re.compile(pattern)
        for s in batches:
            yield s.map(lambda t: None if t is None else rx.sub(lambda m: form(m.group()), t))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    udf = F.pandas_udf(run, "string")
    return F.coalesce(udf(F.when(text.rlike(found), text)), text)


def stable_form(text: Column) -> Column:
    """Text in stable form; only texts that fail the quick check go through Python."""
    return _by_segment(text, unstable_pattern(), segment_pattern(), canonical_segment)


def _look_table() -> dict[int, str]:
    return {ord(c): k for k, v in LOOKALIKES.items() for c in v}


@lru_cache(1 << 16)
def look_segment(seg: str) -> str:
    """The look key of letters with their marks: decomposed, look-alikes put as one, composed."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", seg).translate(_look_table()))


@lru_cache(1)
def composed() -> tuple[dict[str, str], str]:
    """Letters with marks whose base letter is a look-alike: those whose key is one character, with that, and the others."""
    one, others, table = {}, "", _look_table()
    for cp in range(0x80, 0x30000):
        ch = chr(cp)
        if 0xD800 <= cp < 0xE000 or cp in table or not unicodedata.decomposition(ch) or not unicodedata.is_normalized("NFC", ch):
            continue
        key = look_segment(ch)
        if key != ch and len(key) == 1:
            one[ch] = key
        elif key != ch:
            others += ch
    return one, others


def look_key(stable: Column) -> Column:
    """The stable form with each look-alike put as the one character that stands for its shape, with or without marks.
    Only texts with marks that stand alone, or with letters whose key has such, go through Python."""
    one, others = composed()
    src = "".join(v for v in LOOKALIKES.values()) + "".join(one)
    dst = "".join(k * len(v) for k, v in LOOKALIKES.items()) + "".join(one.values())
    marks = classes()[1]
    found = f"[{java_class(marks)}{java_class(_ranges(sorted(map(ord, others))))}]"
    return _by_segment(F.translate(stable, src, dst), found, f"[^{_py_class(marks)}]?[{_py_class(marks)}]+|[{others}]", look_segment)


def readable(key: Column) -> Column:
    """A canonical text for reading, a function of the key alone: in a word with letters that only Cyrillic
    or Greek has, the shapes shared with Latin go back to that script."""
    cyr = {k: next(c for c in v if "Ѐ" <= c <= "ԯ") for k, v in LOOKALIKES.items() if any("Ѐ" <= c <= "ԯ" for c in v)}
    gre = {k: next(c for c in v if "Ͱ" <= c <= "Ͽ") for k, v in LOOKALIKES.items() if any("Ͱ" <= c <= "Ͽ" for c in v)}
    for c, k in composed()[0].items():
        if "Ѐ" <= c <= "ԯ":
            cyr.setdefault(k, c)
        elif "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "\u1fff":
            gre.setdefault(k, c)
    # Latin letters that have no twin tell a Latin word
    words = F.split(key, r"(?<=[^\p{L}])(?=\p{L})|(?<=\p{L})(?=[^\p{L}])")
    back = lambda w, m: F.translate(w, "".join(m), "".join(m.values()))
    mostly_cyr = F.length(F.regexp_replace(key, r"[^\p{IsCyrillic}]", "")) > F.length(F.regexp_replace(key, r"[^A-Za-z]", ""))

    def word(w: Column) -> Column:
        shared = "".join(k for k in {**LOOKALIKES, **cyr} if k.isalpha()) + "\u0300-\u036f"
        return (
            F.when(w.rlike(r"\p{IsCyrillic}"), back(w, cyr))
            .when(w.rlike(r"\p{IsGreek}") & (F.length(w) > 1), back(w, gre))
            .when(mostly_cyr & w.rlike(f"\\A[{shared}]+\\z"), back(w, cyr))
            .otherwise(w)
        )

    marks = classes()[1]
    back_text = F.array_join(F.transform(words, word), "")
    return _by_segment(back_text, f"[{java_class(marks)}]", f"[^{_py_class(marks)}]?[{_py_class(marks)}]+", lambda x: unicodedata.normalize("NFC", x))


def canonical_texts(texts: DataFrame) -> DataFrame:
    """field, id, text -> field, id, text, key (equal exactly for texts of one look), canonical."""
    st = texts.withColumn("key", look_key(stable_form(F.col("text"))))
    return st.withColumn("canonical", readable(F.col("key")))


def p1_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """field, id, canonical, n_forms: each text in its one form, and how many spellings that form has."""
    t = canonical_texts(field_texts(spark, sf, "register")).select("field", "id", text_hash("text").alias("form"), text_hash("key").alias("kh"), "canonical").distinct()
    n = t.groupBy("field", "kh", "form").agg(F.lit(1).alias("one")).groupBy("field", "kh").agg(F.count("*").alias("n_forms"))
    return t.join(n, ["field", "kh"]).select("field", "id", "canonical", "n_forms")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of ids whose texts look the same but are not the same string.

    Rows carry hashes only. Forms of one look are paired first, and each pair of forms then with the ids that have them,
    so that copies of one form never meet each other: the work follows the result. Skewed forms are split by adaptive
    joins. Texts equal as strings never pair.
    """
    t = (
        field_texts(spark, sf, "register")
        .select("field", "id", text_hash("text").alias("form"), text_hash(look_key(stable_form(F.col("text")))).alias("kh"))
        .distinct()
    )
    t = stored(t)
    forms = t.select("field", "kh", "form").distinct()
    several = forms.groupBy("field", "kh").agg(F.count("*").alias("n")).filter("n > 1").select("field", "kh")
    forms = forms.join(several, ["field", "kh"], "left_semi")
    both = forms.withColumnRenamed("form", "fa").join(forms.withColumnRenamed("form", "fb"), ["field", "kh"]).filter("fa < fb").drop("kh")
    a, b = t.select("field", F.col("form").alias("fa"), F.col("id").alias("a")), t.select("field", F.col("form").alias("fb"), F.col("id").alias("b"))
    pairs = both.join(a, ["field", "fa"]).join(b, ["field", "fb"]).filter("a <> b")
    return pairs.select("field", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()
