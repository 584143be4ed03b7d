"""Problem 5: text of scanned pages.

Words are grouped by a skeleton in which glyphs that scanners confuse are one; the frequent form of a
group stands for its rare members where the neighbouring words allow it, place by place. Running headers are
found by keys with masked digits and folded glyphs; words cut at line ends are joined with the next text
line, over blank lines, headers and page breaks; the text is reflowed with SQL windows.

Null texts give no rows. Lines are split at newlines only and count from 1. Repeated deliveries of a
file count once; an empty text gives no defects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import let
from ..session import broadcast_if_small, stored
from .common import source_texts, text_hash

# Glyph groups that scanners confuse, longest first, and the form that stands for each.
STROKES = (("'l'", "t"), ("'", ""), ("\\/", "v"), ("w", "vv"), ("m", "rn"), ("n", "ii"), ("u", "ii"), ("ü", "ii"), ("ñ", "ri"), ("h", "li"), ("d", "cl"))
GLYPHS = {"i": "|!", "l": "1", "o": "0ø", "s": "5$", "6": "béßö", "q": "9g", "a": "@", "t": "fſ", "c": "e", "&": "å"}
ODD = r"[0-9@$|!&\\/ſ']"
CUT_MARKS = "-\u2010\xad\xac"
# Words after which or before which an open hyphen is no cut.
CONJUNCTIONS = ("and", "or", "og", "eller", "und", "oder", "bzw.", "sowie", "y", "e", "o", "u", "et", "ou", "i", "и", "или", "to", "bis", "nor", "als")
RATIO, RATIO_IN_CONTEXT = 20, 4


def skeleton(c: Column) -> Column:
    """A word in lower case with confusable glyphs folded."""
    c = F.lower(c)
    for a, b in STROKES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.translate(c, "".join(GLYPHS.values()), "".join(k * len(v) for k, v in GLYPHS.items()))


def _header_key(c: Column) -> Column:
    """Letters of a line, glyphs folded and digits masked, without a page number at either end."""
    c = F.regexp_replace(c, r"^\s*[0-9]{1,4}\s{2,}|\s{2,}[0-9]{1,4}\s*$", "")
    c = F.regexp_replace(c, r"(?<!\p{L})[0-9OlI|!S$]{2,4}(?!\p{L})", "#")
    return F.regexp_replace(skeleton(c), r"[^\p{L}#6]+", "")


PAGE_STYLES = r"(?i)^\s*(?:[-—–·(\[] ?[0-9ivxlc]{1,6} ?[-—–·)\]]|(?:p\.|pp\.|s\.|seite|page|side|pág\.|página|стр\.|с\.) ?[0-9ivxlc|!OSo]{1,5}|[0-9]{1,4} ?/ ?[0-9]{1,4})\s*$"
BARE = r"^\s*([0-9]{1,4})\s*$"
ROMAN = r"^\s*(?=[ivxlc])(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})\s*$"


def _close(a: Column, b: Column) -> Column:
    """Whether two keys differ by an eighth of their characters at most; lengths are looked at first."""
    most = F.greatest(F.length(b) / 8, F.lit(1))
    return (F.abs(F.length(a) - F.length(b)) <= most) & (F.levenshtein(a, b) <= most)


def classified_lines(texts: DataFrame) -> DataFrame:
    """file_id, text -> file_id, h, line_no, line, kind (text, title, blank, header, pageno, headno) and, of text lines and titles,
    next_no, cut, joins (what goes on in the next text line), from_cut, words and the words next to them.

    The texts move once, to count repeated deliveries once; their lines are stored, and move a second time for the
    windows of a text, which share one partitioning.
    """
    t = texts.select("file_id", "text").filter("text IS NOT NULL").withColumn("h", text_hash("text"))
    t = t.groupBy("file_id", "h").agg(F.first("text").alias("text"))
    ln = t.select("file_id", "h", F.posexplode(F.split("text", "\n")).alias("p", "raw")).withColumn("line_no", (F.col("p") + 1).cast("bigint")).drop("p")
    ln = ln.select("file_id", "h", "line_no", F.trim(F.regexp_replace("raw", "[\f\r]", "")).alias("line"), F.col("raw").contains("\f").alias("ff"))
    c = F.col("line")
    w = W.partitionBy("file_id", "h")
    wo = w.orderBy("line_no")
    gap = c.contains("   ") | c.contains("\t")  # room between a header and its number
    ln = ln.withColumns(
        {
            "blank": c == "",
            "styled": (F.length(c) > 0) & (F.length(c) < 40) & (c.rlike(PAGE_STYLES) | c.rlike(ROMAN)),
            "bare": F.when(c.rlike(BARE), F.regexp_extract(c, BARE, 1).cast("int")),
            "key": _header_key(c),
            "attached": gap & c.rlike(r"^[0-9]{1,4}\s{3,}\S*\p{L}|\p{L}\S*\s{3,}[0-9]{1,4}$|[0-9]\s{4,}[0-9]{1,4}$"),
            "capitals": ~F.regexp_replace(c, r"\bp\. ?[0-9]+", "").rlike(r"\p{Ll}") & c.rlike(r"\p{Lu}(?:[^\p{Lu}]*\p{Lu}){3}") & ~c.rlike(r"[.!?;,]\s*$"),
        }
    )
    # the head of the text: the first lines that are neither blank nor page numbers
    cand = ~F.col("blank") & ~F.col("styled") & F.col("bare").isNull()
    ln = ln.withColumn("nth", F.sum(cand.cast("int")).over(wo.rowsBetween(W.unboundedPreceding, 0)))
    first = lambda n, x: F.max(F.when(cand & (F.col("nth") == n), x)).over(w)
    ln = ln.withColumns({"k1": first(1, F.col("key")), "k2": first(2, F.col("key")), "deco1": first(1, F.col("capitals") | F.col("attached") | c.rlike(r"\s[—–-]\s+\p{Lu}\S+(?:\s{2,}[0-9]+)?$"))})
    head_first = F.coalesce(F.col("deco1"), F.lit(False)) | (F.length("k1") > 3) & F.coalesce(_close(F.col("k1"), F.col("k2")), F.lit(False)) | (F.length("k2") > 5) & F.coalesce(F.col("k1").startswith(F.col("k2")), F.lit(False))
    ln = ln.withColumn("head_first", head_first)
    ln = ln.withColumns({"title_key": F.when(F.col("head_first"), F.col("k2")).otherwise(F.col("k1")), "title_nth": F.when(F.col("head_first"), 2).otherwise(1)})
    is_title = cand & (F.col("nth") == F.col("title_nth"))
    tk, k = F.col("title_key"), F.col("key")
    like_title = (F.length(tk) > 3) & (_close(k, tk) | c.rlike(r"\s[—–-]\s+\S+(?:\s{2,}\S+)?$") & _close(F.substring(k, F.lit(1), F.length(tk)), tk))
    titled = c.rlike(r"^(?:[0-9]{1,4}\s{2,})?\p{Lu}") & ~c.rlike(r"[.!?;,:]\s*$") & (F.length(k) >= 4)
    header = cand & ~is_title & (like_title | F.col("capitals") | (F.col("head_first") & (F.col("nth") == 1)) | (titled & F.col("attached")))
    flags = {"is_title": is_title, "header": F.coalesce(header, F.lit(False)), "titled": F.coalesce(titled & cand & ~is_title, F.lit(False))}
    ln = stored(ln.withColumns(flags).select("file_id", "h", "line_no", "line", "ff", "blank", "styled", "bare", F.when(F.col("titled") | F.col("is_title") | F.col("header"), F.col("key")).alias("key"), "attached", *flags))
    # headings that run on the pages in between may be the titles of other texts
    titles = ln.filter("is_title AND length(key) >= 6").select("key").distinct()
    other = ln.filter("titled AND NOT header AND length(key) >= 6").select("file_id", "h", "line_no", "key").join(titles, "key", "left_semi")
    known = other.groupBy("file_id", "h").agg(F.collect_set("line_no").alias("known"))
    ln = ln.join(known, ["file_id", "h"], "left").withColumn("header", F.col("header") | F.coalesce(F.array_contains("known", F.col("line_no")), F.lit(False))).drop("known")
    # a short heading that comes again on other pages
    plain = F.col("titled") & ~c.rlike(r"[.,!?:;]")
    again = F.count(F.when(plain, 1)).over(W.partitionBy("file_id", "h", "key")) >= 2
    narrow = F.length("line") < 0.75 * F.max(F.length("line")).over(w)
    ln = ln.withColumn("header", F.col("header") | (plain & again & narrow))
    # a number alone on its line counts pages if it stands at a page edge or goes on elsewhere; after a year line it is text
    prev_line, next_line = F.lag("line").over(wo), F.lead("line").over(wo)
    edge = (
        F.coalesce(F.lag("header").over(wo), F.lit(True)) | F.coalesce(F.lead("header").over(wo), F.lit(True)) | F.col("ff") | F.coalesce(F.lead("ff").over(wo), F.lit(True))
        | (F.col("line_no") == 1) | F.coalesce(F.lead("is_title").over(wo), F.lit(False))
    )
    numbers = F.collect_set("bare").over(w)
    year = r"^\s*(?:1[5-9]|20)[0-9]{2}\s*$"
    after_year = F.coalesce(prev_line.rlike(year), F.lit(False))
    before_number = F.coalesce(next_line.rlike(BARE), F.lit(False))
    goes_on = F.array_contains(numbers, F.col("bare") + 1) | F.array_contains(numbers, F.col("bare") - 1)
    ln = ln.withColumn("pageno", F.col("styled") | F.coalesce(F.col("bare").isNotNull() & ~after_year & ~(c.rlike(year) & before_number) & (edge | goes_on) & ~c.rlike(year), F.lit(False)))
    kind = (
        F.when(F.col("blank"), "blank").when(F.col("header") & F.col("attached"), "headno").when(F.col("header"), "header").when(F.col("pageno"), "pageno").when(F.col("is_title"), "title").otherwise("text")
    )
    ln = ln.select("file_id", "h", "line_no", "line", kind.alias("kind"))
    # words cut at the end of a text line, which go on in the next text line
    ln = ln.withColumn("running", F.col("kind").isin("text", "title"))
    wt = W.partitionBy("file_id", "h", "running").orderBy("line_no")
    ln = ln.withColumns({"next_line": F.lead("line").over(wt), "next_no": F.lead("line_no").over(wt)})
    nxt = F.regexp_extract("next_line", r"^(\S+)", 1)
    cut = (
        c.rlike(rf"\p{{L}}\S*[{CUT_MARKS}]$")
        & F.coalesce(F.col("next_line").rlike(r"^[\p{L}0-9@$|!\\&'ſ]"), F.lit(False))
        & ~F.regexp_replace(F.lower(nxt), r"[.,;:]+$", "").isin(*CONJUNCTIONS)
        & (F.col("kind") == "text")
    )
    ln = ln.withColumn("cut", F.coalesce(cut, F.lit(False)))
    ln = ln.withColumns({"from_cut": F.coalesce(F.lag("cut").over(wt), F.lit(False)), "joins": F.when(F.col("cut"), nxt)})
    ln = ln.withColumn("words", F.when(F.col("running"), _words(c, F.col("from_cut"), F.col("joins"))))
    ln = ln.withColumn("cut_at", F.when(F.col("cut"), F.length(F.regexp_replace(F.regexp_replace(F.regexp_extract(c, r"(\S+)$", 1), rf"[{CUT_MARKS}]+$", ""), LEAD, ""))))
    ln = ln.withColumns({"word_before": F.lag(F.try_element_at("words", F.lit(-1))).over(wt), "word_after": F.lead(F.try_element_at("words", F.lit(1))).over(wt)})
    return ln.select("file_id", "h", "line_no", "line", "kind", "cut", "joins", "from_cut", "next_no", "words", "cut_at", "word_before", "word_after")


MARKS = r"\-.,;:?\"“”„«»()‘’—–…\[\]·"
LEAD, TAIL = rf"^[{MARKS}¿¡]+", rf"[{MARKS}!]+$"
EDGES = f"{LEAD}|{TAIL}"


def _words(line: Column, from_cut: Column, joins: Column) -> Column:
    """Array of the words with a letter of a trimmed line, in lower case, without marks at their edges. The first word of a
    line belongs to the line before it when that one ends in a cut; a word that is cut here is whole, as the last one."""
    c = F.translate(line, "\xa0", " ")
    c = F.when(from_cut, F.regexp_replace(c, r"^\S+\s*", "")).otherwise(c)
    # a line of one word that begins and ends in cuts has no word of its own
    c = F.when(joins.isNull() | (c == ""), c).otherwise(F.concat(F.regexp_replace(c, rf"[{CUT_MARKS}]+$", ""), F.regexp_replace(joins, EDGES, "")))
    c = F.regexp_replace(c, rf"(?<!\S)[{MARKS}¿¡]+|[{MARKS}!]+(?!\S)", "")
    c = F.regexp_replace(c, r"(?<!\S)[^\p{L}\s]+(?!\S)", "")
    return F.array_remove(F.split(F.lower(c), r"\s+"), "")


def tokens(lines: DataFrame) -> DataFrame:
    """One row per word: file_id, h, line_no, word_no, word, before, after (words next to it, over line ends), cut_at,
    second_no (line of the second part of a cut word)."""
    t = lines.filter(F.size("words") > 0).select("*", F.posexplode("words").alias("word_no", "word"))
    last = (F.col("word_no") == F.size("words") - 1) & F.col("cut_at").isNotNull()
    return t.select(
        "file_id", "h", "line_no", "word_no", "word",
        F.when(F.col("word_no") == 0, F.col("word_before")).otherwise(F.try_element_at("words", F.col("word_no"))).alias("before"),
        F.coalesce(F.try_element_at("words", F.col("word_no") + 2), F.col("word_after")).alias("after"),
        F.when(last, F.col("cut_at")).alias("cut_at"), F.when(last, F.col("next_no")).alias("second_no"),
    )


def misread_words(toks: DataFrame) -> DataFrame:
    """word, form, sure: rare words and the frequent form of the same skeleton that may stand for them."""
    v = toks.groupBy("word").agg(F.count("*").alias("n")).withColumn("skel", skeleton(F.col("word")))
    odd = F.col("word").rlike(ODD) & ~F.col("word").rlike(r"^[\p{L}]{1,6}['’][\p{L}-]{2,}$") | F.col("word").rlike(r"[rt]'(?:\p{L}|$)")
    v = v.withColumn("odd", odd)
    top = v.filter(~F.col("word").rlike(ODD) | F.col("word").rlike(r"^[\p{L}]{1,6}'[\p{L}-]{2,}$") & ~F.col("odd")).groupBy("skel").agg(F.max_by("word", F.struct("n", "word")).alias("form"), F.max("n").alias("top_n"))
    c = v.join(top, "skel").filter("word <> form AND length(word) >= 2 AND length(form) >= 2")
    # forms that differ by an accent only are different words, unless a glyph is odd
    bare = lambda x: F.translate(x, "øöåéßüñ", "ooaesun")
    c = c.filter(F.col("odd") | (bare(F.col("word")) != bare(F.col("form"))))
    sure = F.when(F.col("odd"), F.col("top_n") >= F.col("n")).otherwise(F.col("top_n") >= RATIO * F.col("n"))
    maybe = (F.col("top_n") >= RATIO_IN_CONTEXT * F.col("n")) & (F.length("word") >= 3)
    return c.select("word", "form", sure.alias("sure"), maybe.alias("maybe")).filter("sure OR maybe").drop("maybe")


def misread_places(toks: DataFrame) -> DataFrame:
    """Misread words at their places: file_id, h, line_no, word_no, word, form, second_no, cut_at.

    Each place is judged by its neighbours: how often the form, and how often the word as written, stands beside the same
    word elsewhere. The form must be seen at least as often as the word; where counts of the words alone don't decide, the
    form must be seen twice. Neighbours that nobody has seen beside either leave it to the counts of the words.
    """
    hit = stored(toks.join(broadcast_if_small(stored(misread_words(toks))), "word"))
    at = ["file_id", "h", "line_no", "word_no"]
    pair = lambda a, b, role: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.lit(role).alias("role"))
    asked = hit.select(*at, F.inline(F.array(pair("before", "form", 0), pair("form", "after", 1), pair("before", "word", 2), pair("word", "after", 3)))).filter("a IS NOT NULL AND b IS NOT NULL")
    wanted = asked.select("a", "b").distinct()
    seen = toks.filter("before IS NOT NULL").select(F.col("before").alias("a"), F.col("word").alias("b"))
    seen = seen.join(broadcast_if_small(stored(wanted)), ["a", "b"], "left_semi").groupBy("a", "b").agg(F.count("*").alias("n"))
    by = asked.join(seen, ["a", "b"]).groupBy(*at).agg(
        F.max(F.when(F.col("role") < 2, F.col("n"))).alias("for_form"), F.max(F.when(F.col("role") >= 2, F.col("n") - 1)).alias("for_word")
    )
    hit = hit.join(by, at, "left")
    form_n, word_n = F.coalesce("for_form", F.lit(0)), F.coalesce("for_word", F.lit(0))
    return hit.filter((form_n >= word_n) & (F.col("sure") | (form_n >= 2))).select(*at, "word", "form", "second_no", "cut_at")


def defects(texts: DataFrame) -> DataFrame:
    """file_id, line_no, defect."""
    lines = stored(classified_lines(texts))
    hit = misread_places(tokens(lines))
    # a cut word is misread in the part that differs from the form
    a, b = F.substr("word", F.lit(1), F.col("cut_at")), F.substr("word", F.col("cut_at") + 1)
    both = F.array("line_no", "second_no")
    places = F.when(F.col("second_no").isNull(), F.array("line_no")).when(F.col("form").startswith(a), F.array("second_no")).when(F.col("form").endswith(b), F.array("line_no")).otherwise(both)
    # one pass over the lines for all that a line tells by itself
    of_line = F.array_compact(F.array(F.when(F.col("cut"), "hyphen"), F.when(F.col("kind").isin("header", "headno"), "header"), F.when(F.col("kind").isin("pageno", "headno"), "pageno")))
    found = lines.select("file_id", "line_no", F.explode(of_line).alias("defect"))
    return found.unionByName(hit.select("file_id", F.explode(places).alias("line_no"), F.lit("char").alias("defect"))).distinct()


def _repaired(tok: Column, form: Column) -> Column:
    """A token with its word put as the form, marks at its edges and capitals kept."""
    a, z = F.regexp_extract(tok, f"({LEAD})", 1), F.regexp_extract(tok, f"({TAIL})", 1)
    core = F.regexp_replace(tok, EDGES, "")
    shown = F.when((F.length(core) > 1) & core.rlike(r"\p{Lu}") & ~core.rlike(r"\p{Ll}"), F.upper(form)).when(core.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(form, 1, 1)), F.substr(form, F.lit(2)))).otherwise(form)
    return F.concat(a, shown, z)


def paragraphs(texts: DataFrame) -> DataFrame:
    """file_id, para_no, text: running paragraphs without headers and page numbers, cut words joined and misread
    words put right, each at its own place. A blank line parts paragraphs unless it stands inside a sentence at a page break."""
    lines = stored(classified_lines(texts))
    toks = tokens(lines)
    fixes = misread_places(toks).groupBy("file_id", "h", "line_no").agg(F.map_from_entries(F.collect_list(F.struct("word_no", "form"))).alias("fixes"))
    # a compound keeps its hyphen where its whole form occurs with one
    known = toks.filter("word LIKE '%-%' AND cut_at IS NULL").select(F.col("word").alias("hyphenated")).distinct()
    first, second = F.substr("word", F.lit(1), F.col("cut_at")), F.substr("word", F.col("cut_at") + 1)
    cuts = toks.filter("cut_at IS NOT NULL").select("file_id", "h", "line_no", F.concat(first, F.lit("-"), second).alias("hyphenated"))
    compound = cuts.join(known, "hyphenated", "left_semi").select("file_id", "h", "line_no", F.lit(True).alias("keep")).distinct()
    t = lines.filter("kind IN ('text', 'title')").join(fixes, ["file_id", "h", "line_no"], "left").join(compound, ["file_id", "h", "line_no"], "left")
    c = F.trim(F.regexp_replace("line", r"[\s\x{A0}]+", " "))
    c = F.when(F.col("from_cut"), F.regexp_replace(c, r"^\S+ ?", "")).otherwise(c)
    fixed_cut = F.coalesce(F.map_contains_key("fixes", F.size("words") - 1), F.lit(False))
    stem = F.when(F.coalesce("keep", F.lit(False)) & ~fixed_cut, F.regexp_replace(c, rf"[{CUT_MARKS}]+$", "-")).otherwise(F.regexp_replace(c, rf"[{CUT_MARKS}]+$", ""))
    t = t.withColumn("c", F.when(F.col("joins").isNull() | (c == ""), c).otherwise(F.concat(stem, F.col("joins"))))
    # each token with the number of its word, if it has one; only lines with a fix are taken apart
    parts = F.split("c", " ")
    has_word = F.transform(parts, lambda x: F.when(F.regexp_replace(x, EDGES, "").rlike(r"\p{L}"), 1).otherwise(0))
    number = lambda h, i: F.aggregate(F.slice(h, 1, i), F.lit(0), lambda a, x: a + x)
    put = lambda h: F.transform(parts, lambda x, i: let(F.when(F.element_at(h, i + 1) == 1, F.try_element_at("fixes", number(h, i))), lambda form: F.when(form.isNull(), x).otherwise(_repaired(x, form))))
    t = t.withColumn("out", F.when(F.col("fixes").isNull(), F.col("c")).otherwise(F.array_join(let(has_word, put), " ")))
    w = W.partitionBy("file_id", "h").orderBy("line_no")
    t = t.withColumns({"prev_no": F.lag("line_no").over(w), "prev_out": F.lag("out").over(w), "prev_kind": F.lag("kind").over(w)})
    gap = F.col("line_no") - F.col("prev_no") > 1
    new = F.col("prev_no").isNull() | (F.col("prev_kind") == "title") | (gap & F.col("prev_out").rlike(r"[.!?…:][\"'”’»)\]]*$"))
    t = t.withColumn("para_no", F.sum(new.cast("int")).over(w).cast("bigint"))
    # one paragraph of one file is the largest unit that a task holds
    para = t.filter("out <> ''").groupBy("file_id", "h", "para_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "out"))).alias("x"))
    return para.select("file_id", "para_no", F.array_join(F.transform("x", lambda y: y["out"]), " ").alias("text"))


def p5_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """file_id, para_no, text of scanned files."""
    return paragraphs(source_texts(spark, sf, "scanned"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """file_id, line_no, defect of scanned files."""
    return defects(source_texts(spark, sf, "scanned"))
