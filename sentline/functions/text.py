"""Scalar text functions as Column expressions: normalisation, white space, contractions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import classes as K

# Look-alikes of typographic characters in ASCII, one to one and one to many.
FOLD_ONE = {"‒": "-", "–": "-", "—": "-", "―": "-", "‖": "|", "‗": "_", "‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "•": "*"}
FOLD_MANY = {"€": "EUR", "…": "...", "Œ": "OE", "œ": "oe", "™": "TM", "Ĳ": "IJ", "ĳ": "ij"}
# What the bytes 0x80 to 0x9F of Windows-1252 look like in ASCII, where they stand as C1 characters.
C1_ONE = {0x82: "'", 0x83: "f", 0x84: '"', 0x86: "+", 0x87: "+", 0x88: "^", 0x8A: "S", 0x8B: "<", 0x8E: "Z", 0x91: "'", 0x92: "'", 0x93: '"', 0x94: '"', 0x95: "*", 0x96: "-", 0x97: "-", 0x98: "~", 0x9A: "s", 0x9B: ">", 0x9E: "z", 0x9F: "Y"}
C1_MANY = {0x80: "EUR", 0x85: "...", 0x8C: "OE", 0x99: "TM", 0x9C: "oe"}


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def sub(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def normalize_eol(c: Column) -> Column:
    """Every line end as one newline."""
    return sub(c, K.EOL, "\n")


def strip_bom(c: Column) -> Column:
    return sub(c, r"^\x{FEFF}")


def strip_blanks(c: Column) -> Column:
    return sub(c, r"^[ \t\n]+|[ \t\n]+\z")


def ascii_fold(c: Column) -> Column:
    """Typographic characters as their ASCII look-alikes."""
    c = F.translate(c, "".join(FOLD_ONE), "".join(FOLD_ONE.values()))
    for k, v in FOLD_MANY.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def ascii_fold_c1(c: Column) -> Column:
    """As ascii_fold for text whose Windows-1252 characters stand in the C1 range; only U+20xx marks fold beside them."""
    one = {chr(k): v for k, v in C1_ONE.items()} | FOLD_ONE
    c = F.translate(c, "".join(one), "".join(one.values()))
    for k, v in C1_MANY.items():
        c = F.replace(c, F.lit(chr(k)), F.lit(v))
    return c


def control_chars(c: Column) -> Column:
    """Controls other than white space become '*'."""
    return sub(c, r"[\x01-\x08\x0E-\x1F]", "*")


def regularize_ws(c: Column) -> Column:
    """Runs of flat space become one blank, none at line ends, runs of newlines one newline."""
    c = sub(c, f"[{K.FLAT_SPACE}]+", " ")
    c = sub(c, r" ?\n[ \n]*", "\n")
    return sub(c, r"^[ \n]+|[ \n]+\z")


def formfeed(c: Column) -> Column:
    """In a run of white space a form feed, else a vertical tab, prevails and stays with the newline."""
    c = sub(c, r"[ \t\n\x0B]*\f[ \t\n\x0B\f]*", "\f\n")
    return sub(c, r"[ \t\n]*\x0B[ \t\n\x0B]*", "\x0b\n")


def unify_apostrophe(c: Column) -> Column:
    """Quotation marks inside a word become the ASCII apostrophe."""
    return sub(c, rf"([\p{{L}}\p{{N}}])[{K.QUOTE}]([\p{{L}}\p{{N}}])", "$1'$2")


def split_dashes(c: Column) -> Column:
    """Runs of two or more hyphens stand alone."""
    return F.trim(sub(c, r"(--+)", " $1 "))


def contractions(c: Column) -> Column:
    """English contractions of one word, split by '|'. The order is that of the rules; each looks at what is left of the first split."""
    rules = [
        (r"(?i)^(wha)(t)(cha)\z", "$1|$2|$3"), (r"(?i)^(wha)(dd)(ya)\z", "$1|$2|$3"), (r"(?i)^(can)(not)\z", "$1|$2"), (r"(?i)^(gim)(me)\z", "$1|$2"), (r"(?i)^(gon)(na)\z", "$1|$2"),
        (r"(?i)^(got)(ta)\z", "$1|$2"), (r"(?i)^(lem)(me)\z", "$1|$2"), (r"(?i)^(wan)(na)\z", "$1|$2"), (r"(?i)^('?t)(is|was)\z", "$1|$2"), (r"(?i)^(d')(ye)\z", "$1|$2"), (r"(?i)^(more)('n)\z", "$1|$2"),
        (r"(?i)^([^|]+)('ll|'ve|'re|n't)\z", "$1|$2"), (r"(?i)^([^|]+)('s|'m|'d)\z", "$1|$2"), (r"^([^|]+[^|'])'\z", "$1|'"),
    ]
    for pat, to in rules:
        c = sub(c, pat, to)
    return c


def noise(line: Column) -> Column:
    """Share of characters of a line that are neither letters, digits, blanks nor common marks; 0 for an empty line."""
    n = F.length(line)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.length(sub(line, r"[\p{L}\p{N} .,;:!?'\"()\-]+")).cast("double") / n)


def eol_style(c: Column) -> Column:
    """The first line end of a text: its characters, or an empty text if it has none."""
    return F.regexp_extract(c, r"(\r\n|\n\r|\n|\r)", 1)
