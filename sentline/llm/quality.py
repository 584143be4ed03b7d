"""Problem 8: statistics of a text's quality, and from them prose, list, table or junk.

The common words of each language are counted over all documents: those that half of its documents hold. Statistics
are SQL expressions. For each language a mergeable KLL sketch of every statistic is built over all documents; the sketch
gives the median and the spread on the side of prose, by which values become robust z-scores, and percentiles. What a
document is follows from the tails that it is in: rows of numbers make a table, items a list, and symbols, letter
sequences, words that nobody else uses or one word over and over junk. A language of few documents is judged by the
sketch of all.

A null or empty text has a row with null statistics and no kind. Ties and repeated rows count as often as they come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from ..session import stored, table
from .common import spread

# Function words of the languages in use; for scripts without blanks, function characters.
COMMON_WORDS = (
    "the of and to in is a an that it on for with as by at be are was were which from or this not have has had its can may one said between such wherein "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war zur bis oder "
    "le la les de des et en un une du est que dans qui par pour au sur se ne pas plus ce il avec sont ou cette comme être a à aux son l d "
    "el los las y un una del que se por con para su al lo como más o pero sus ya entre está sin sobre de en la es esta este "
    "og i at det en den til er som på de med han af for ikke der var et fra men har om sig ved "
    "и в не на с что по как это к из у за от о для же бы до при или так его где а то при которой "
    "ο η το και να του της με που από για στο στη τα των"
)
CJK_COMMON = "的是在和了有不一之其所以于与及或该中上为被而且对可のはがをにでとしたれるものすてい"
STATS = ("mean_word_len", "symbol_ratio", "punct_line_ratio", "common_ratio", "numeric_ratio", "unique_ratio")
# Statistics by which kinds are told, and the least spread of each: differences below it say nothing, be a
# language ever so uniform.
SPREADS = {
    "row_ratio": 0.17, "numeric_ratio": 0.11, "item_ratio": 0.17, "item_share": 0.14, "symbol_ratio": 0.07, "sequence_ratio": 0.085, "long_token_ratio": 0.14,
    "punct_line_ratio": 0.07, "common_log": 0.55, "variety_log": 0.6, "mean_word_len": 1.0, "common_ratio": 0.01, "unique_ratio": 0.01,
}
LOW_TAIL = ("punct_line_ratio", "common_log", "variety_log", "common_ratio", "unique_ratio")  # prose is on the high side of these
Z_TAIL = 3.5
RUNNING = r"(?s)(?:\p{Ll}{2}[.!?]\s+\p{Lu}|[。！？]\S).*(?:\p{Ll}{2}[.!?]\s+\p{Lu}|[。！？]\S)"  # two sentence ends inside: no item of a list
LONG_TOKEN = r"[\x21-\x7E]{30}"
GRID = 200  # quantiles kept of each sketch
LEAST_GROUP = 50  # documents of a language below which all languages are the reference
COMMON_SHARE = 0.5  # share of a language's documents that hold a common word
MAX_COMMON = 50_000  # common words of all languages; by their definition at most twice the mean number of words of a document, a language


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def _kept(c: Column, drop: str) -> Column:
    """Number of characters left when those of a pattern are taken out."""
    return F.length(F.regexp_replace(c, F.lit(drop), F.lit("")))


def _matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def _tokens(t: Column) -> Column:
    """Array of the tokens of a text, what stands between blanks; blanks at its ends give empty ones."""
    return F.split(t, "[ \n\t\r\f]+")


def common_words(df: DataFrame, share: float = COMMON_SHARE) -> list[str]:
    """Words that at least a share of the documents of their language hold, by counts over all documents(text, language)."""
    # an empty word in each document counts the documents, so that the texts are read once
    words = F.array_distinct(F.array_append(_tokens(F.lower(F.col("text"))), ""))
    w = df.select("language", F.explode(words).alias("word")).groupBy("language", "word").agg(F.count("*").alias("n")).filter("n > 1 OR word = ''")
    w = stored(w)  # without the words of one document, which are most
    n = w.filter("word = ''").select("language", F.col("n").alias("docs"))  # one row per language
    often = w.filter("n > 1").join(F.broadcast(n), "language").filter(F.col("n") >= share * F.col("docs"))
    rows = often.filter(F.col("word").rlike(r"\A[\p{L}\p{M}]+\z")).select("word").distinct().limit(MAX_COMMON + 1).collect()
    if len(rows) > MAX_COMMON:
        raise ValueError(f"more than {MAX_COMMON} common words")
    return sorted(r.word for r in rows)


def text_statistics(df: DataFrame, text: str = "text", common: list[str] | None = None) -> DataFrame:
    """The columns of df plus the statistics of a text column. Common words are those given, else the listed ones."""
    t = F.col(text)
    words = common if common is not None else list(dict.fromkeys(COMMON_WORDS.split()))
    c = F.col
    # Parts that several statistics share are made once, and lists of words and lines are bound inside the expression:
    # as columns they would be copied from step to step. Whole texts are scanned as seldom as can be.
    df = df.withColumn("_len", F.length(t))  # counted once; a text is stored in bytes
    wide = F.octet_length(t) > c("_len")  # characters outside ASCII are looked for only where there are any
    joined = lambda xs: F.length(F.array_join(xs, ""))

    def of_tokens(ts: Column) -> Column:
        # tokens that are empty, may be a delimiter alone, or are long: few, so that the others are looked at once
        def of_odd(odd: Column) -> Column:
            lone = F.filter(odd, lambda x: x.isin("|", ";", ","))
            long = F.filter(odd, lambda x: (F.octet_length(x) >= 30) & x.rlike(LONG_TOKEN))
            empty = F.size(F.filter(odd, lambda x: x == ""))
            return F.struct((F.size(ts) - empty).alias("n"), joined(ts).alias("ink"), F.size(lone).alias("lone"), joined(long).alias("long"))

        return let(F.filter(ts, lambda x: ~F.octet_length(x).between(2, 29)), of_odd)

    def of_words(ws: Column) -> Column:
        sequence = lambda ds: joined(F.filter(ds, lambda w: (F.octet_length(w) >= 6) & w.rlike(r"\A[acgtun]{6,}\z")))
        known = F.size(F.filter(ws, lambda w: w.isin(words))) if words else F.lit(0)
        return let(F.array_distinct(ws), lambda ds: F.struct(F.size(ws).alias("n"), joined(ws).alias("letters"), known.alias("common"), F.size(ds).alias("distinct"), sequence(ds).alias("sequence")))

    # lines of tables and lists don't end like sentences; how a line ends is looked at once
    stops, quotes, closed = ".!?。！？:;…", "\"'»”’)」", ".!?。！？:"
    lines_of = lambda xs: F.filter(F.transform(xs, lambda x: let(F.rtrim(x), lambda r: F.struct(x.alias("x"), F.right(r, F.lit(2)).alias("z")))), lambda y: y["z"] != "")
    end = lambda y, n=1: F.substring(y["z"], -n, 1)

    def of_lines(ls: Column) -> Column:
        # a row: cells of numbers and codes only, after the name that it begins with
        rows = F.filter(ls, lambda y: ~end(y).isin(*closed) & y["x"].rlike(r"\A[^\t;,|]*?(?:(?:\t|;|,| *\| *| {2,})(?:[-+]?[0-9][0-9.]*|n/a|-|[a-z][0-9]+/\S+|))+\s*\z"))
        ended = F.filter(ls, lambda y: end(y).isin(*stops) | (end(y).isin(*quotes) & end(y, 2).isin(*stops)))
        items = F.when(t.contains(";"), lines_of(F.split(t, r"[\n;]"))).otherwise(ls)
        listed = lambda y: ~end(y).isin(*closed) & y["x"].rlike(r"\A\s*(?:[-*•·–]|\[[0-9]+\]|\(?[0-9]{1,3}[a-z]?[.)]?|[A-Z][0-9]{1,4})\s+\S") & ~y["x"].rlike(r"(?:[0-9.]+[\s,|]+){3,}") & ~y["x"].rlike(RUNNING)
        item = lambda xs: F.transform(F.filter(xs, listed), lambda y: y["x"])
        shape = let(items, lambda xs: let(item(xs), lambda it: F.struct(F.size(xs).alias("of"), F.size(it).alias("n"), joined(it).alias("chars"))))
        return F.struct(F.size(ls).alias("n"), F.size(rows).alias("rows"), F.size(ended).alias("ended"), shape.alias("items"))

    base = df.withColumns(
        {
            "_tok": let(_tokens(t), of_tokens),
            "_low": let(F.regexp_extract_all(F.lower(t), F.lit(r"([\p{L}\p{M}]+)"), 1), of_words),
            "_line": let(lines_of(F.split(t, "\n")), of_lines),
            "_blanks": F.when(wide, _matches(t, "[\\x{A0}\\x{3000}]")).otherwise(F.lit(0)),
            # cells: words and what delimiters part inside of them, without delimiters that stand alone
            "_parted": _matches(t, r"[,;|]+(?=[^\s,;|])"),
            # a number that is a cell: nothing but digits, dots and one sign between blanks or delimiters
            "_numbers": _matches(t, r"[-+0-9](?<![^\s,;|].)(?:(?<=[0-9])[0-9.]*|(?<=[-+])(?:[0-9][0-9.]*|-|n/a)|(?<=-))(?![^\s,;|])") + F.when(t.contains("n/a"), _matches(t, r"(?<![^\s,;|])n/a(?![^\s,;|])")).otherwise(F.lit(0)),
            # digits and ASCII marks are one bit class; the other marks are looked for where there can be any
            "_marks": c("_len") - F.when(wide, _kept(t, r"[-.,;:!?'\"()0-9\x{AB}\x{BB}\x{2019}-\x{201D}\x{3001}-\x{300D}\x{FF01}-\x{FF1F}]+")).otherwise(_kept(t, r"[-.,;:!?'\"()0123456789]+")),
        }
    )
    # an ideograph takes two bytes more than a character: texts with fewer such bytes than letters can't be mostly ideographs
    n_low, ink, cells, lines = c("_low.n"), c("_tok.ink") - c("_blanks"), c("_tok.n") - c("_tok.lone") + c("_parted"), c("_line.n")
    base = base.withColumn("_cjk", F.when(F.octet_length(t) - c("_len") > c("_low.letters"), _kept(t, r"[^\x{3040}-\x{30FF}\x{3400}-\x{9FFF}]+")).otherwise(F.lit(0)))
    mostly_cjk = c("_cjk") * 2 > c("_low.letters")
    base = base.withColumns(
        {
            "n_chars": c("_len").cast("bigint"),
            "word_count": c("_tok.n").cast("bigint"),
            "line_count": lines.cast("bigint"),
            "mean_word_len": _share(ink, c("_tok.n")),
            "symbol_ratio": _share(F.greatest(ink - c("_low.letters") - c("_marks"), F.lit(0)), ink),
            "punct_line_ratio": _share(c("_line.ended"), lines),
            "common_ratio": F.when(mostly_cjk, _share(_kept(t, f"[^{CJK_COMMON}]+"), c("_cjk"))).otherwise(_share(c("_low.common"), n_low)),
            "numeric_ratio": _share(c("_numbers"), cells),
            "unique_ratio": F.when(mostly_cjk, F.lit(0.5)).otherwise(_share(c("_low.distinct"), n_low)),
            "item_ratio": _share(c("_line.items.n"), c("_line.items.of")),
            "item_share": _share(c("_line.items.chars"), c("_len")),
            "row_ratio": _share(c("_line.rows"), lines),
            "sequence_ratio": _share(c("_low.sequence"), c("_low.letters")),
            "long_token_ratio": _share(c("_tok.long"), ink),
            # distinct words grow with the root of the length; nothing is known of that where words aren't parted
            "variety_log": F.when(~mostly_cjk & (n_low > 0), F.log(c("_low.distinct") / F.sqrt(n_low))),
        }
    )
    base = base.drop("_len", "_tok", "_low", "_line", "_blanks", "_parted", "_numbers", "_marks", "_cjk")
    return base.withColumn("common_log", F.log(c("common_ratio") + 0.01))


def language(lang: Column) -> Column:
    """Declared language in lower case; null, blank and undetermined are one group."""
    low = F.lower(F.trim(lang))
    return F.when(low.isNull() | low.isin("", "und"), "und").otherwise(low)


def sketches(stats: DataFrame) -> DataFrame:
    """Per language one KLL sketch of each statistic, its quantiles in an even grid (q_), and those of the reference (r_):
    of the language, or of all documents where it has few. Sketches merge, so partial aggregation happens before the
    shuffle, whatever the size of a language."""
    k = stored(stats.groupBy("language").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(s).alias(f"sk_{s}") for s in SPREADS]))
    grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    quantiles = lambda s, a: F.when(F.kll_sketch_get_n_double(f"sk_{s}") > 0, F.kll_sketch_get_quantile_double(f"sk_{s}", grid)).alias(f"{a}_{s}")
    # the sketch of all documents is that of the languages, merged
    whole = k.agg(*[F.kll_merge_agg_double(f"sk_{s}").alias(f"sk_{s}") for s in SPREADS]).select(*[quantiles(s, "a") for s in SPREADS])
    k = k.select("language", "n", *[quantiles(s, "q") for s in SPREADS])
    few = F.col("n") < LEAST_GROUP
    # one row of quantiles beside one row per language
    return k.join(F.broadcast(whole), F.lit(True)).select("language", *[f"q_{s}" for s in SPREADS], *[F.coalesce(F.when(few, F.col(f"a_{s}")), F.col(f"q_{s}"), F.col(f"a_{s}")).alias(f"r_{s}") for s in SPREADS])


def _at_most(value: Column):
    return lambda x: x <= value


def _quantile(s: str, p: float) -> Column:
    return F.element_at(f"r_{s}", int(p * GRID) + 1)


def _spread(s: str) -> Column:
    """Standard deviation by the half on the side of prose, which other kinds don't widen."""
    low, high = _quantile(s, 0.5) - _quantile(s, 0.25), _quantile(s, 0.75) - _quantile(s, 0.5)
    half = F.least(low, high) if s == "mean_word_len" else high if s in LOW_TAIL else low
    return F.greatest(half * 2 / 1.349, F.lit(SPREADS[s]))


def graded(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text, lang) -> statistics, robust z-scores, percentiles and kind."""
    d = documents.select("doc_id", "text", language(F.col("lang")).alias("language"))
    base = spread(d.filter("text IS NOT NULL AND text <> ''"))
    st = stored(text_statistics(base, common=common_words(base)).drop("text"))  # small rows; the texts are read twice
    # one row per language, a bounded set of codes, goes to each task
    st = st.join(F.broadcast(sketches(st)), "language")
    z = {f"z_{s}": (F.col(s) - _quantile(s, 0.5)) / _spread(s) for s in SPREADS}
    pct = {f"pct_{s}": F.size(F.filter(f"q_{s}", _at_most(F.col(s)))) / F.lit(GRID + 1.0) for s in STATS}
    st = st.withColumns(z | pct)
    tail = [F.col(f"z_{s}") <= -Z_TAIL if s in LOW_TAIL else F.col(f"z_{s}") >= Z_TAIL for s in SPREADS]
    st = st.withColumn("in_tail", F.exists(F.array(*[F.coalesce(x, F.lit(False)) for x in tail]), lambda x: x)).withColumn("kind", kind())
    st = st.drop(*[f"{x}_{s}" for s in SPREADS for x in "qr"])
    none = d.filter("text IS NULL OR text = ''").select("doc_id", "language")
    return st.unionByName(none, allowMissingColumns=True)


def kind() -> Column:
    """What a document is, by the tails that it is in."""
    high = lambda s: F.coalesce(F.col(f"z_{s}") >= Z_TAIL, F.lit(False))
    low = lambda s: F.coalesce(F.col(f"z_{s}") <= -Z_TAIL, F.lit(False))
    table_ = high("row_ratio") & high("numeric_ratio")
    list_ = high("item_ratio") & high("item_share") & ~high("symbol_ratio") & ~high("sequence_ratio")
    some = lambda n: F.col("word_count") >= n
    junk = high("long_token_ratio") | high("sequence_ratio") | high("symbol_ratio") | (low("common_log") & some(5) & low("punct_line_ratio")) | (low("variety_log") & some(20))
    return F.when(table_, "table").when(list_, "list").when(junk, "junk").otherwise("prose")


def p8_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its statistics, percentiles within its language, and kind."""
    g = graded(table(spark, sf, "documents"))
    return g.select("doc_id", "language", "word_count", *STATS, *[F.round(f"pct_{s}", 6).alias(f"pct_{s}") for s in STATS], "in_tail", "kind")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, kind of documents that as a whole are no natural prose."""
    return graded(table(spark, sf, "documents")).filter("kind <> 'prose'").select("doc_id", "kind").distinct()
