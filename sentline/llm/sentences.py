"""Problem 4: sentence units in every language and script.

All work is done in SQL expressions. A text is cut at blank lines; in each paragraph the marks that do
not end a sentence (in decimals, addresses, initials, abbreviations, brackets and quotations) are masked
with private-use placeholders of the same length, the rest is split by terminator rules of the scripts,
and positions come from the lengths of the pieces, so that the unit is the untouched text between them.
Brackets and quotations may be of any length. Characters without ink are left out of the copy that is
masked, and positions in it are led back to the text.

Null texts give no rows, empty texts and texts of blanks neither. Repeated rows give equal units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from ..session import table
from .common import field_texts, within

# Kinds of blank, and characters without ink that may stand inside a word.
BLANKS = "\t\n\v\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
INKLESS = r"[\x{AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}]"
MARK, MARK_STANDIN, DOT, STOP, OPENING = "\ue0ff", "\ue0fe", "\ue000", "\ue001", "\ue002"
# Abbreviations of the languages in use that a dictionary may lack. They never end a sentence.
EXTRA_ABBREVIATIONS = ("Mr.", "Ms.", "Jr.", "Nos.", "Figs.", "Eq.", "Ref.", "Ing.", "Mme.", "Mlle.", "Bd.", "Kap.", "Tab.", "Abb.", "bl.a.", "Tlf.", "им.", "стр.", "гл.", "тел.")
# Words before a German or Danish day or rank number, and the months after one.
BEFORE_RANK = "am|im|vom|zum|zur|den|dem|der|des|die|das|bis|nach|seit|ab|beim|det|kong|könig|kapitel"
MONTHS = "Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
MAX_DICTIONARY = 20_000


def dictionary(abbreviations: DataFrame) -> list[str]:
    """The abbreviations that never end a sentence. A dictionary is configuration and must be small.

    Entries that may end one need no entry here: their dot counts by what follows. Of contradictory
    entries the one that names a language wins.
    """
    d = abbreviations.select(F.trim("abbr").alias("abbr"), "expect_cap", "lang").filter("abbr <> ''")
    d = d.groupBy("abbr").agg(
        F.coalesce(F.min(F.when(F.col("lang").isNotNull(), F.col("expect_cap").cast("int"))), F.min(F.col("expect_cap").cast("int")), F.lit(0)).alias("cap")
    )
    rows = d.filter("cap = 0").limit(MAX_DICTIONARY + 1).collect()
    if len(rows) > MAX_DICTIONARY:
        raise ValueError(f"a dictionary may hold {MAX_DICTIONARY} abbreviations")
    return sorted({r.abbr for r in rows} | set(EXTRA_ABBREVIATIONS))


def _abbreviation_pattern(entries: list[str]) -> str:
    """Regex of everything up to the last dot of any entry, as a tree of common beginnings; a blank may stand
    before each dot. Its length is bounded by the longest entry, so that it can look behind."""
    tree: dict = {}
    for e in entries:
        body = e[:-1] if e.endswith(".") else e
        for b in {body, body[:1].upper() + body[1:]}:
            node = tree
            for ch in b:
                node = node.setdefault(ch, {})
            node[""] = {}

    def atom(ch: str) -> str:
        return r" ?[.\x{E000}]" if ch == "." else " ?" if ch == " " else ("\\" + ch if ch in r"\^$|?*+()[]{}" else ch)

    def regex(node: dict) -> str:
        alts = ["" if ch == "" else atom(ch) + regex(below) for ch, below in sorted(node.items(), reverse=True)]
        return alts[0] if len(alts) == 1 else "(?:" + "|".join(alts) + ")"

    return regex(tree)


PLAIN_BLANKS = r"[\t\x0B\f\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}" + MARK + "]"


def _r(c: Column, pat: str, to: str) -> Column:
    return F.regexp_replace(c, F.lit(pat), F.lit(to))


def _where(c: Column, mark: str, fn) -> Column:
    """fn(c) for texts that hold a mark; the others skip its regex."""
    return let(c, lambda x: F.when(x.contains(mark), fn(x)).otherwise(x))


def plain(p: Column) -> Column:
    """A paragraph in which every blank is a plain one, of the same length."""
    m = F.replace(p, F.lit("\n"), F.lit(" "))
    return let(m, lambda x: F.when(x.rlike(PLAIN_BLANKS), F.translate(x, BLANKS + MARK, " " * len(BLANKS) + MARK_STANDIN)).otherwise(x))


def mask(p: Column, entries: list[str]) -> Column:
    """A plain paragraph without inkless characters in which each mark that ends no sentence is a placeholder of the same length.

    Patterns for dots start with the mark itself and look behind from there, so that a text costs by its marks; those for
    brackets and quotations take the stretch as a whole.
    """
    no_word = r"(?<![\p{L}\p{M}\p{Nd}'’])"

    def dots(m: Column) -> Column:
        # decimals, addresses, inner dots
        m = _r(m, r"\.(?<=[\p{L}\p{M}\p{Nd}]\.)(?=[\p{L}\p{Nd}])", DOT)
        # scripts in which the dot is an abbreviation mark only; the dictionary; other single letters; days before months
        behind = "|".join(
            (
                r"[\x{900}-\x{963}\x{966}-\x{97F}\x{E00}-\x{E7F}]",
                rf"(?<![\p{{L}}\p{{M}}\p{{Nd}}.\x{{E000}}])(?:{_abbreviation_pattern(entries)})",
                r"(?<![\p{L}\p{M}\p{Nd}'’%°\x{E000}])(?<![paт] ?[.\x{E000}] )(?!г)\p{L}",
                rf"(?<![\p{{Nd}}.,\x{{E000}}])[0-9]{{1,2}}(?= ?\. *(?:{MONTHS})\b)",
            )
        )
        m = _r(m, rf"\.(?= *\S)(?<=(?:{behind}) ?\.)", DOT)
        # initials with any number of accents; rank numbers after any number of blanks
        m = _r(m, rf"({no_word}\p{{Lu}}\p{{M}}* ?)\.(?= *\S)", "$1" + DOT)
        rank = lambda c: _r(c, rf"((?<!\p{{L}})(?i:{BEFORE_RANK}) +[0-9]{{1,2}} ?)\.(?= *\S)", "$1" + DOT)
        return let(m, lambda x: F.when(x.rlike(r"[0-9] ?\."), rank(x)).otherwise(x))

    m = _where(p, ".", dots)
    m = _where(m, "=", lambda c: _r(c, r"[?!](?<=\S[?!])(?=[\p{L}\p{Nd}]+=)", STOP))
    # inside brackets: all but the last mark
    m = _where(m, "(", lambda c: within(c, r"\([^()]*\)", lambda x: _r(x, r"[.!?;。！？](?! ?\))", STOP)))
    m = _where(m, "（", lambda c: within(c, r"（[^（）]*）", lambda x: _r(x, r"[.!?;。！？]", STOP)))
    m = _where(m, "[", lambda c: within(c, r"\[[^\[\]]*\]", lambda x: _r(x, r"[.!?;。！？](?! ?\])", STOP)))
    # inside quotations: all but the last mark; an opening mark doesn't follow a word or mark directly
    pre = r"(?<![\p{IsLatin}\p{IsCyrillic}\p{IsGreek}\p{IsArabic}\p{IsDevanagari}\p{Nd}.,!?؟।;…\x{E001}])"
    for o, c in (("“", "”"), ("„", "“”"), ("«", "»"), ("»(?! )", "«"), ("‘", "’"), ("「", "」"), ("『", "』"), ("‹", "›")):
        inner = rf"[.!?;…。！？؟।](?! ?[.!?…。！？]* ?[{c}])"
        m = _where(m, o[0], lambda x, o=o, c=c, inner=inner: within(x, rf"{pre}{o}[^{o[0]}{c}]*[{c}]", lambda y: _r(y, inner, STOP)))
    m = _where(m, '"', lambda c: within(c, r"(?<=^|[ :(])\"[^\"]*\"", lambda x: _r(x, r"[.!?…](?! ?\")", STOP)))
    # the last mark in a quotation that opens a unit and is followed by caseless reporting words
    for o, c in (("“", "”"), ("«", "»"), ("「", "」"), ("『", "』"), ("‘", "’")):
        opens = rf"((?:^|(?<=[.!?…。！？؟।”」』»]))[ ”」』»]*){o}"
        reported = lambda x, o=o, c=c: within(x, rf"{OPENING}[^{o}{c}{OPENING}]*{c}(?= *[\p{{Lo}}\p{{M}}])", lambda y: _r(y, rf"[.!?…。！？؟।](?= ?{c}\z)", STOP))
        m = _where(m, o, lambda x, o=o, opens=opens, reported=reported: F.translate(reported(_r(x, opens, "$1" + OPENING)), OPENING, o))
    return _where(m, "」", lambda c: _r(c, r"[.!?…。！？؟।](?=[」』] *(?:と|って|という|など))", STOP))


def mark(m: Column) -> Column:
    """The boundary mark put after each unit of a masked paragraph."""
    closers = r"(?:«(?![\p{L}\p{Nd}])| ?[»”’“›\"')\]」』）]+(?![\p{L}\p{Nd}]))*"
    start = r"(?:»(?=[\p{L}\p{Nd}¿¡])|[^\p{Ll}\s,;:.!?…—–\-»”)\]])"
    # the question mark of Greek is put as another one
    greek = lambda c: _r(c, r"(\p{IsGreek}\p{M}* ?)[;\x{37E}]", "$1؟")
    m = let(m, lambda x: F.when(x.rlike(r"\p{IsGreek}\p{M}* ?[;\x{37E}]"), greek(x)).otherwise(x))
    # scripts with blanks between words: the next character must not go on in lower case or with a mark
    m = _r(m, rf"([.!?…؟।](?: ?[.!?…؟])*{closers})(?= +{start})", "$1" + MARK)
    m = _where(m, "।", lambda c: _r(c, r"(।)(?=[^\s”’»\"'])", "$1" + MARK))
    # scripts without blanks
    cjk = lambda c: _r(c, r"([。！？｡][。！？｡!?]*(?: ?[”’」』）»]+)*)(?=[^”’」』）»。！？｡\s]|\s+[^\s”」』）])", "$1" + MARK)
    m = let(m, lambda x: F.when(x.rlike("[。！？｡]"), cjk(x)).otherwise(x))
    # Thai: a blank between two Thai words
    thai = lambda c: _r(c, r"(?<=[ก-๛])( +)(?=[ก-๛])", MARK + "$1")
    return let(m, lambda x: F.when(x.rlike("[ก-๛] +[ก-๛]"), thai(x)).otherwise(x))


def _starts(lens: Column) -> Column:
    """Offsets of pieces from their lengths."""
    return F.aggregate(lens, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def _with_offsets(parts: Column) -> Column:
    """Array of struct(piece, off) of the pieces of a text."""
    return F.arrays_zip(parts.alias("piece"), F.slice(_starts(F.transform(parts, lambda x: F.length(x))), 1, F.size(parts)).alias("off"))


def _spans(marked: Column) -> Column:
    """Array of struct(a, z): where the units of a marked paragraph begin and end, blanks at their ends left out."""
    units = let(F.split(marked, MARK), _with_offsets)
    lead = lambda x: F.length(x["piece"]) - F.length(F.ltrim(x["piece"]))
    spans = F.transform(units, lambda x: F.struct((x["off"] + lead(x)).alias("a"), (x["off"] + lead(x) + F.length(F.trim(x["piece"]))).alias("z")))
    return F.filter(spans, lambda x: x["a"] < x["z"])


def _led_back(spans: Column, p: Column) -> Column:
    """Spans in a paragraph without its inkless characters as spans in the paragraph. Such characters belong to the unit
    that they touch, between two units to the later one."""
    chars = F.transform(F.split(p, ""), lambda c, i: F.struct(i.alias("i"), c.alias("c")))
    seen = F.filter(chars, lambda x: (x["c"] != "") & ~x["c"].rlike(INKLESS))

    def back(x: Column, s: Column) -> Column:
        before, at = F.try_element_at(s, x["a"]), F.try_element_at(s, x["z"] + 1)
        begin = F.when(x["a"] == 0, 0).otherwise(before["i"] + 1)
        end = F.when(at.isNull(), F.length(p)).when(at["c"] == " ", at["i"]).otherwise(F.try_element_at(s, x["z"])["i"] + 1)
        return F.struct(begin.alias("a"), end.alias("z"))

    return let(seen, lambda s: F.transform(spans, lambda x: back(x, s)))


def sentence_units(texts: DataFrame, entries: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """text plus the columns to keep -> those columns, start_pos, end_pos, unit: one row per sentence unit."""
    cols = [F.col(c) for c in keep]
    t = texts.filter("text IS NOT NULL AND text <> ''")
    paras = F.split("text", r"(?=\n[ \t\r\x{A0}\x{3000}]*\n)")
    t = t.select(*cols, F.explode(_with_offsets(paras)).alias("x")).select(*cols, F.col("x.piece").alias("para"), F.col("x.off").alias("para_off"))
    t = t.select(*cols, "para_off", "para", plain(F.col("para")).alias("p"))
    hidden = F.col("p").rlike(INKLESS)
    t = t.select(*cols, "para_off", "para", "p", hidden.alias("hidden"), F.when(hidden, F.regexp_replace("p", INKLESS, "")).otherwise(F.col("p")).alias("v"))
    t = t.select(*cols, "para_off", "para", "p", "hidden", mask(F.col("v"), entries).alias("k")).select(*cols, "para_off", "para", "p", "hidden", mark(F.col("k")).alias("m"))
    spans = let(_spans(F.col("m")), lambda x: F.when(F.col("hidden"), _led_back(x, F.col("p"))).otherwise(x))
    t = t.select(*cols, "para_off", "para", F.inline(spans))
    return t.select(*cols, (F.col("para_off") + F.col("a")).cast("bigint").alias("start_pos"), (F.col("para_off") + F.col("z")).cast("bigint").alias("end_pos"), F.expr("substring(para, a + 1, z - a)").alias("unit"))


def p4_units(spark: SparkSession, sf: str) -> DataFrame:
    """field, rec_id, start_pos, end_pos, unit over prose files and the runs over them."""
    entries = dictionary(table(spark, sf, "abbreviations"))
    t = field_texts(spark, sf, "prose").withColumnRenamed("id", "rec_id")
    return sentence_units(t, entries, ("field", "rec_id")).distinct()


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """One row per sentence unit: field, rec_id, start_pos, end_pos."""
    entries = dictionary(table(spark, sf, "abbreviations"))
    t = field_texts(spark, sf, "prose").withColumnRenamed("id", "rec_id")
    return sentence_units(t, entries, ("field", "rec_id")).select("field", "rec_id", "start_pos", "end_pos").distinct()
