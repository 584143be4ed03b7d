"""Registered queries of the core operators and the SQL that each is checked against.

Spark works inside the row wherever it can; the SQL explodes and uses windows, so that the two are
independent. Positions and counts are BIGINT on both sides and start at 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classes as K
from ..functions import text as T
from ..operators import dictionaries as D
from ..operators import lines as L
from ..operators import markup as M
from ..operators import segment as S
from ..session import SPREAD_FROM, spread, table
from ..sources import readers as R
from ..sources import rtf, sinks
from .pipeline import run_text
from ..options import Options, split_option_line

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"), SPREAD_FROM)


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries of source files, by their unique delivery_id."""
    return spread(table(spark, sf, "source_files").select(F.col("delivery_id").alias("doc_id"), F.col("sourcefile").alias("text")), SPREAD_FROM)


# SQL building blocks -------------------------------------------------------------------------------------------------

DOCS = "SELECT doc_id, text FROM documents WHERE text IS NOT NULL"
SRC = "SELECT delivery_id AS doc_id, sourcefile AS text FROM source_files WHERE sourcefile IS NOT NULL"
NORM = r"regexp_replace({0}, '\r\n|\n\r|\r', chr(10), 'g')"
STRIP = r"regexp_replace({0}, '^[ \t\n]+|[ \t\n]+\z', '', 'g')"


def q(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def lines_sql(src: str) -> str:
    return f"ln AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM (SELECT doc_id, string_split({NORM.format('text')}, chr(10)) AS ls FROM ({src})))"


def paras_sql(src: str) -> str:
    split = rf"regexp_split_to_array({NORM.format('text')}, '\n[ \t]*(?:\n[ \t]*)+')"
    return (
        f"pa AS (SELECT doc_id, unnest(ps) AS para, unnest(range(len(ps))) AS para_no FROM "
        f"(SELECT doc_id, list_filter(list_transform({split}, lambda x: {STRIP.format('x')}), lambda x: x <> '') AS ps FROM ({src})))"
    )


def chunks_sql(src: str) -> str:
    return paras_sql(src) + (
        r", ch0 AS (SELECT doc_id, para_no, unnest(cs) AS chunk, unnest(range(len(cs))) AS chunk_no FROM (SELECT doc_id, para_no, regexp_split_to_array(para, '[ \t\n]+') AS cs FROM pa))"
        ", ch AS (SELECT *, lead(chunk) OVER (PARTITION BY doc_id, para_no ORDER BY chunk_no) AS next_chunk FROM ch0)"
    )


# The SQL keeps its own copy of the classes, written down from the description of the rules, so that a slip in the
# engine's shows. Fixed values.
SEP_Q = r""".,;:!?()\[\]{}<>"''/\\|\x{A0}-\x{BF}\x{2B9}-\x{2BD}\x{2012}-\x{2027}"""
QUOTE_Q = r""""''\x{AB}\x{BB}\x{2018}-\x{201F}\x{2B9}-\x{2BD}"""
QUANTITY_Q = r"\x{24}%\x{20AC}\x{192}\x{2030}\x{A2}\x{A3}\x{A5}"
BRACKETS_Q = (r"(\[{", r")\]}")


def affix_sql(source: str = "ch", name: str = "af") -> str:
    """CTEs that part separators from words, one per rule, over a table with a column chunk. Letters of kept: the rules that moved."""
    rq = rf"'^([0-9].*?)([{QUANTITY_Q}]+)\z'"
    left, right = BRACKETS_Q
    # place in a list of the first or last character that the word holds
    places = "list_filter(range(1, len({0}) + 1), lambda i: contains({1}, {0}[i]))"
    tail_hit = "list_max(" + places.format("regexp_extract_all(run, '.')", "inner_core") + ")"
    head_hit = "list_min(" + places.format("regexp_extract_all(head, '.')", "core") + ")"
    return rf"""{name}0 AS (SELECT *, regexp_extract(chunk, '^([{SEP_Q}]*)', 1) AS h, CASE WHEN regexp_full_match(chunk, '[{SEP_Q}]*') THEN '' ELSE regexp_extract(chunk, '([{SEP_Q}]*)\z', 1) END AS t FROM {source}),
    {name}1 AS (SELECT * EXCLUDE (h, t), h AS head, t AS tail, substr(chunk, length(h) + 1, length(chunk) - length(h) - length(t)) AS core, '' AS kept FROM {name}0),
    {name}2 AS (SELECT *, core <> '' AND regexp_matches(tail, '^[{QUOTE_Q}]') AND NOT regexp_matches(head, '[{QUOTE_Q}]') AS qt, CASE WHEN core <> '' THEN regexp_extract(tail, '^(.*[{right}])', 1) ELSE '' END AS upto FROM {name}1),
    {name}3 AS (SELECT * EXCLUDE (qt, upto, core, tail, kept), CASE WHEN qt THEN core || left(tail, 1) WHEN br THEN core || upto ELSE core END AS core, CASE WHEN qt THEN substr(tail, 2) WHEN br THEN substr(tail, length(upto) + 1) ELSE tail END AS tail,
        CASE WHEN qt THEN 'a' WHEN br THEN 'b' ELSE '' END AS kept FROM (SELECT * EXCLUDE (br0), NOT qt AND br0 AS br FROM (SELECT *, upto <> '' AND regexp_matches(core || upto, '[{left}]') AS br0 FROM {name}2))),
    {name}4 AS (SELECT * EXCLUDE (br, core, tail, kept), CASE WHEN qu <> '' THEN regexp_extract(core, {rq}, 1) ELSE core END AS core, qu || tail AS tail, kept || CASE WHEN qu <> '' THEN 'q' ELSE '' END AS kept
        FROM (SELECT *, regexp_extract(core, {rq}, 2) AS qu FROM {name}3)),
    {name}5 AS (SELECT * EXCLUDE (qu), regexp_replace(tail, '\.\z', '') AS body, left(core, greatest(length(core) - 1, 0)) AS inner_core FROM {name}4),
    {name}6 AS (SELECT *, length(body) - length(run) + {tail_hit} AS take FROM (SELECT *, regexp_extract(body, '([^.]*)\z', 1) AS run FROM {name}5)),
    {name}7 AS (SELECT * EXCLUDE (body, inner_core, run, take, core, tail, kept), CASE WHEN take IS NULL THEN core ELSE core || left(body, take) END AS core, CASE WHEN take IS NULL THEN tail ELSE substr(tail, take + 1) END AS tail, kept || CASE WHEN take IS NULL THEN '' ELSE 'u' END AS kept FROM {name}6),
    {name}8 AS (SELECT * EXCLUDE (from_, core, head, kept), CASE WHEN from_ IS NULL OR core = '' THEN core ELSE substr(head, from_) || core END AS core, CASE WHEN from_ IS NULL OR core = '' THEN head ELSE left(head, from_ - 1) END AS head, kept || CASE WHEN from_ IS NULL OR core = '' THEN '' ELSE 'u' END AS kept
        FROM (SELECT *, {head_hit} AS from_ FROM {name}7)),
    {name} AS (SELECT * EXCLUDE (core, tail, kept, g), CASE WHEN g THEN core || ';' ELSE core END AS core, CASE WHEN g THEN substr(tail, 2) ELSE tail END AS tail, kept || CASE WHEN g THEN 'e' ELSE '' END AS kept
        FROM (SELECT *, core <> '' AND left(tail, 1) = ';' AND contains(core, '&') AS g FROM {name}8))"""


DICT = "dict AS (SELECT lower(trim(abbr)) AS abbr, coalesce(bool_or(expect_cap), false) AS expect_cap FROM abbreviations WHERE trim(abbr) <> '' GROUP BY 1)"


def class_sql(with_dictionary: bool = False) -> str:
    d = "WHEN dot AND cap THEN 'ABBR_CAP' WHEN dot AND cap IS NOT NULL THEN 'ABBR_DICT'" if with_dictionary else ""
    src = "(SELECT af.*, dict.expect_cap AS cap FROM af LEFT JOIN dict ON dict.abbr = lower(af.core || '.'))" if with_dictionary else "af"
    return rf"""cl AS (SELECT * EXCLUDE (dot), CASE WHEN contains(kept, 'e') AND tail = '' THEN 'ENTITY'
        WHEN dot AND ((NOT contains(kept, 'u') AND regexp_matches(core, '[0-9]')) OR (length(core) = 1 AND NOT regexp_matches(core, '^\p{{Lu}}\z'))) THEN 'NUM_DOT'
        WHEN dot AND length(core) = 1 THEN 'INITIAL'
        WHEN dot AND ((NOT contains(kept, 'u') AND contains(core, '.')) OR head <> '') THEN 'ABBR' {d}
        WHEN right(chunk, 1) IN ('.', ';', '?', '!') THEN 'HARD' ELSE 'NONE' END AS end_class,
        coalesce(regexp_matches(next_chunk, '^\p{{Ll}}'), false) AS next_is_lower FROM (SELECT *, tail = '.' AND core <> '' AS dot FROM {src})),
    bo AS (SELECT *, next_chunk IS NULL OR end_class = 'HARD' OR (end_class IN ('NUM_DOT', 'ABBR_CAP') AND NOT next_is_lower) AS boundary FROM cl)"""


def sentences_sql(src: str, with_dictionary: bool = False) -> str:
    d = DICT + ", " if with_dictionary else ""
    return f"""{d}{chunks_sql(src)}, {affix_sql()}, {class_sql(with_dictionary)},
    nu AS (SELECT *, coalesce(sum(boundary::INT) OVER (PARTITION BY doc_id ORDER BY para_no, chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sent_no FROM bo),
    se AS (SELECT doc_id, min(para_no) AS para_no, sent_no, string_agg(chunk, ' ' ORDER BY chunk_no) AS sentence, count(*) AS n_chunks FROM nu GROUP BY doc_id, sent_no)"""


# Sentences -----------------------------------------------------------------------------------------------------------


@register("q_sentences", f"WITH {sentences_sql(DOCS, True)} SELECT doc_id, para_no, sent_no, sentence, n_chunks FROM se")
def q_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return S.sentences(documents(spark, sf), "doc_id", S.dictionary_map(table(spark, sf, "abbreviations")))


@register("q_sentences_plain", f"WITH {sentences_sql(SRC)} SELECT doc_id, para_no, sent_no, sentence, n_chunks FROM se")
def q_sentences_plain(spark: SparkSession, sf: str) -> DataFrame:
    return S.sentences(sources(spark, sf), "doc_id")


@register("q_chunks", f"WITH {chunks_sql(DOCS)} SELECT doc_id, para_no, chunk_no, chunk FROM ch")
def q_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return S.chunks(documents(spark, sf), "doc_id", following=False)


@register("q_paragraphs", f"WITH {paras_sql(SRC)} SELECT doc_id, para_no, para FROM pa")
def q_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return S.paragraphs(sources(spark, sf), "doc_id")


@register("q_unwrap_lines", rf"WITH {paras_sql(SRC)} SELECT doc_id, para_no, regexp_replace(para, '[ \t]*\n[ \t]*', ' ', 'g') AS para FROM pa")
def q_unwrap_lines(spark: SparkSession, sf: str) -> DataFrame:
    return S.paragraphs(sources(spark, sf), "doc_id").withColumn("para", S.unwrapped(F.col("para")))


@register("q_paragraph_breaks", f"WITH {sentences_sql(SRC)} SELECT doc_id, sent_no, coalesce(lead(para_no) OVER (PARTITION BY doc_id ORDER BY sent_no) = para_no, false) AS same_paragraph FROM se")
def q_paragraph_breaks(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the next sentence is in the same paragraph; within the row by the sizes of the paragraphs' arrays."""
    per = F.transform(S.paragraphs_of(F.col("text")), lambda p: T.let(F.size(S.sentences_of(p)), lambda n: F.transform(F.sequence(F.lit(1), n), lambda i: i < n)))
    x = sources(spark, sf).select("doc_id", F.posexplode(F.flatten(per)).alias("sent_no", "same_paragraph"))
    return x.select("doc_id", F.col("sent_no").cast("bigint").alias("sent_no"), "same_paragraph")


@register("q_end_class", f"WITH {DICT}, {chunks_sql(DOCS)}, {affix_sql()}, {class_sql(True)} SELECT end_class, count(*) AS n_chunks FROM cl GROUP BY 1")
def q_end_class(spark: SparkSession, sf: str) -> DataFrame:
    a = S.analysed(documents(spark, sf), "doc_id", S.dictionary_map(table(spark, sf, "abbreviations")))
    return a.groupBy("end_class").agg(F.count("*").alias("n_chunks"))


def _boundary_sql(where: str, src: str = DOCS) -> str:
    return f"WITH {chunks_sql(src)}, {affix_sql()}, {class_sql()} SELECT doc_id, para_no, chunk_no, chunk, next_is_lower, boundary FROM bo WHERE {where}"


def _boundary(where: str, df: Callable[[SparkSession, str], DataFrame] = documents) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: S.analysed(df(spark, sf), "doc_id", ending=".").filter(where).select("doc_id", "para_no", "chunk_no", "chunk", "next_is_lower", "boundary")


# documents hold no initials, so that these are looked for in the source files
register("q_initials", _boundary_sql("end_class = 'INITIAL'", SRC))(_boundary("end_class = 'INITIAL'", sources))
for _name, _where in (("q_number_dot", "end_class = 'NUM_DOT'"), ("q_abbreviation_flag", "end_class = 'ABBR'")):
    register(_name, _boundary_sql(_where))(_boundary(_where))


def token_sql(src: str, with_dictionary: bool, contractions: bool = False) -> str:
    """Tokens: chunks cut at runs of hyphens, parted, and put together again by sentence (relation tk)."""
    d = "WHEN ab AND e.expect_cap IS NOT NULL THEN true" if with_dictionary else ""
    join = "LEFT JOIN dict e ON e.abbr = lower(p.core || '.')" if with_dictionary else ""
    # the dot that stays is put on before the words are split, and does not take part in the rules for contractions
    words = "[CASE WHEN glued THEN core || '.' ELSE core END]"
    if contractions:
        split = f"list_filter(string_split({contracted_sql('core')}, '|'), lambda x: x <> '')"
        words = f"CASE WHEN contains(kept, 'u') OR contains(core, '|') THEN {words} WHEN glued THEN list_concat(({split})[1:-2], [({split})[-1] || '.']) ELSE {split} END"
    runs = "list_transform(list_filter(range(1, length(r) + 1), lambda i: i = 1 OR r[i] <> r[i - 1]), lambda i: r[i] || coalesce(array_to_string(list_filter(range(i + 1, length(r) + 1), lambda j: len(list_filter(range(i, j + 1), lambda k: r[k] <> r[i])) = 0).list_transform(lambda j: r[j]), ''), ''))"
    return rf"""{sentences_sql(src, with_dictionary)},
    pc AS (SELECT doc_id, sent_no, chunk_no, unnest(ps) AS chunk, unnest(range(len(ps))) AS part_no FROM (SELECT doc_id, sent_no, chunk_no, string_split(trim(regexp_replace(regexp_replace(chunk, '(--+)', ' \1 ', 'g'), ' +', ' ', 'g'), ' '), ' ') AS ps FROM nu)),
    pn AS (SELECT *, lead(chunk) OVER (PARTITION BY doc_id, sent_no ORDER BY chunk_no, part_no) AS next_part FROM pc), {affix_sql('pn', 'pa_')},
    gl AS (SELECT p.*, CASE WHEN core = '' OR left(tail, 1) <> '.' THEN false WHEN (NOT contains(kept, 'u') AND regexp_matches(core, '[0-9]')) OR (length(core) = 1 AND NOT regexp_matches(core, '^\p{{Lu}}\z')) THEN tail = '.' AND coalesce(regexp_matches(next_part, '^\p{{Ll}}'), false)
        WHEN length(core) = 1 OR head <> '' OR (NOT contains(kept, 'u') AND contains(core, '.')) THEN true {d} ELSE false END AS glued FROM (SELECT *, core <> '' AND left(tail, 1) = '.' AS ab FROM pa_) p {join}),
    rs AS (SELECT *, CASE WHEN glued THEN substr(tail, 2) ELSE tail END AS r FROM gl),
    tk AS (SELECT doc_id, sent_no, chunk_no, part_no, CASE WHEN core = '' THEN [chunk] ELSE list_concat(regexp_extract_all(head, '(?s).'), {words}, {runs}) END AS ts FROM rs)"""


TOKENS_SQL = f"""WITH {token_sql(DOCS, True)}, fl AS (SELECT doc_id, sent_no, flatten(list(ts ORDER BY chunk_no, part_no)) AS ts FROM tk GROUP BY doc_id, sent_no)
    SELECT doc_id, sent_no, unnest(range(len(ts))) AS token_no, unnest(ts) AS token FROM fl"""


@register("q_tokens", TOKENS_SQL)
def q_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return S.tokens(documents(spark, sf), "doc_id", dictionary=S.dictionary_map(table(spark, sf, "abbreviations")))


# chunks that the rules are about, and what has to come out, worked out by hand from the description of the rules
PLANTED = {
    "Hello,": "Hello·,", "(see)": "(·see·)", "Wait...!!": "Wait·...·!!", "((a": "(·(·a", "e.g.,": "e.g.·,", "U.S.,": "U.S.·,", "(Ref.)": "(·Ref.·)", "f(x,)": "f(x,)", "f(x')": "f(x'·)", "sort(a)": "sort(a)", "a)(": "a·)·(",
    "http://a.b/c/)": "http://a.b/c/·)", "http://a.b/c/.": "http://a.b/c/·.", "[../a.b": "[·../a.b", "end»»»": "end»·»»", "so……": "so·……", "one--two": "one·--·two", "a---b.": "a·---·b.", "12€.": "12·€·.", "50%,": "50·%·,", "rock'n'": "rock'n'",
    "o'": "o'", "'o'": "'·o·'", "R&amp;D": "R&amp;D", "x&lt;": "x&lt;", "1999.,": "1999·.·,", "J.": "J.", "J.,": "J.·,", "!?": "!?", "--": "--", "etc.": "etc.",
}


@register("q_planted_tokens", "SELECT unnest(range(" + str(len(PLANTED)) + ")) AS id, unnest([" + ", ".join(q(x) for x in PLANTED.values()) + "]) AS tokens")
def q_planted_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of planted chunks, with the word 'next' after each."""
    d = spark.createDataFrame([(i, c) for i, c in enumerate(PLANTED)], "id bigint, c string")
    toks = S.sentence_tokens(F.concat("c", F.lit(" next")), False, S.Dictionary((), ("etc.",)))
    return d.select("id", F.array_join(F.slice(toks, 1, F.size(toks) - 1), "·").alias("tokens"))


# Affix rules ---------------------------------------------------------------------------------------------------------

SAMPLES = ("rock'", "sort(s)", "75%", "8$", "http://example.org/a/", "..<mail/out.txt/", "R&amp;", "&lt;", "&amp;more", "'won't", "left--right", "x---y", "((z", "Stop...!!", "(look)", "30€.", "y's”", "https://a.b/c/.", "f(x,)", "f(x')", "http://a.b/c/)", "»»»", "so……", "e.g.,")
SAMPLES_SQL = "SELECT unnest([" + ", ".join(q(s) for s in SAMPLES) + "]) AS chunk"
ALL_CHUNKS_SQL = f"{chunks_sql(SRC)}, di AS (SELECT chunk FROM ch WHERE chunk <> '' UNION {SAMPLES_SQL}), {affix_sql('di')}"


def distinct_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Every chunk of the source files, and samples of the rules that they hold no case of, once each."""
    c = S.chunks(sources(spark, sf), "doc_id", following=False).select("chunk").filter("chunk <> ''")
    return c.union(spark.createDataFrame([(s,) for s in SAMPLES], "chunk string")).distinct()


def _kept(rule: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        a = distinct_chunks(spark, sf).select(S.affixes(F.col("chunk")).alias("a")).select("a.*")
        return a.filter(F.col("kept").contains(rule)).select("chunk", "head", "core", "tail")

    return run


for _name, _rule in (("q_apostrophe_keep", "a"), ("q_bracket_keep", "b"), ("q_quantity_split", "q"), ("q_url_tail", "u"), ("q_entity_keep", "e")):
    register(_name, f"WITH {ALL_CHUNKS_SQL} SELECT chunk, head, core, tail FROM af WHERE contains(kept, '{_rule}')")(_kept(_rule))


@register("q_url_head", f"WITH {ALL_CHUNKS_SQL} SELECT chunk, core, tail FROM af WHERE contains(kept, 'u') AND regexp_matches(core, '^[{SEP_Q}]')")
def q_url_head(spark: SparkSession, sf: str) -> DataFrame:
    a = distinct_chunks(spark, sf).select(S.affixes(F.col("chunk")).alias("a")).select("a.*")
    return a.filter(F.col("is_url") & F.col("core").rlike(f"^[{K.SEP}]")).select("chunk", "core", "tail")


@register("q_affixes", f"WITH {chunks_sql(DOCS)}, {affix_sql()} SELECT doc_id, para_no, chunk_no, head, core, tail FROM af")
def q_affixes(spark: SparkSession, sf: str) -> DataFrame:
    return S.analysed(documents(spark, sf), "doc_id").select("doc_id", "para_no", "chunk_no", "head", "core", "tail")


@register(
    "q_trailing_runs",
    f"WITH {ALL_CHUNKS_SQL}, cs AS (SELECT chunk, unnest(regexp_extract_all(tail, '(?s).')) AS c, unnest(range(length(tail))) AS i FROM af WHERE tail <> ''),"
    " g0 AS (SELECT *, coalesce(c <> lag(c) OVER (PARTITION BY chunk ORDER BY i), true) AS new FROM cs), g1 AS (SELECT *, sum(new::INT) OVER (PARTITION BY chunk ORDER BY i) AS g FROM g0),"
    " g2 AS (SELECT chunk, g, string_agg(c, '' ORDER BY i) AS run FROM g1 GROUP BY chunk, g) SELECT chunk, string_agg(run, ' ' ORDER BY g) AS runs FROM g2 GROUP BY chunk",
)
def q_trailing_runs(spark: SparkSession, sf: str) -> DataFrame:
    a = distinct_chunks(spark, sf).select(S.affixes(F.col("chunk")).alias("a")).filter("a.tail <> ''")
    return a.select("a.chunk", F.array_join(S.trailing_runs(F.col("a.tail")), " ").alias("runs"))


@register("q_core_flags", f"WITH {chunks_sql(DOCS)}, {affix_sql()} SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (WHERE NOT contains(kept, 'u') AND contains(substr(core, 2), '.')) AS n_inner_dot, count(*) FILTER (WHERE regexp_matches(core, '[0-9]')) AS n_digit, count(*) FILTER (WHERE contains(kept, 'u')) AS n_url, count(*) FILTER (WHERE core = '') AS n_separators FROM af GROUP BY doc_id")
def q_core_flags(spark: SparkSession, sf: str) -> DataFrame:
    a = S.analysed(documents(spark, sf), "doc_id")
    return a.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.count_if("has_inner_dot").alias("n_inner_dot"), F.count_if("has_digit").alias("n_digit"), F.count_if("is_url").alias("n_url"), F.count_if(F.col("core") == "").alias("n_separators"))


def _chunk_function(fn: Callable[[Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: distinct_chunks(spark, sf).select("chunk", fn(F.col("chunk")).alias("text")).filter("chunk <> text")


ALL_DISTINCT_SQL = f"{chunks_sql(SRC)}, di AS (SELECT chunk FROM ch WHERE chunk <> '' UNION {SAMPLES_SQL})"
register("q_split_dashes", f"WITH {ALL_DISTINCT_SQL} SELECT * FROM (SELECT chunk, trim(regexp_replace(chunk, '(--+)', ' \\1 ', 'g'), ' ') AS text FROM di) WHERE chunk <> text")(_chunk_function(T.split_dashes))
register("q_unify_apostrophe", f"WITH {ALL_DISTINCT_SQL} SELECT * FROM (SELECT chunk, regexp_replace(chunk, '([\\p{{L}}\\p{{N}}])[{QUOTE_Q}]([\\p{{L}}\\p{{N}}])', '\\1''\\2', 'g') AS text FROM di) WHERE chunk <> text")(_chunk_function(T.unify_apostrophe))

CONTRACTED = ("don't", "John's", "I'm", "we'll", "dogs'", "cannot", "gimme", "gonna", "gotta", "lemme", "wanna", "more'n", "d'ye", "tis", "twas", "whatcha", "whaddya", "CAN'T", "they've", "you're", "he'd")
CONTRACTIONS_SQL = (
    (r"(?i)^(wha)(t|dd)(cha|ya)\z", r"\1|\2|\3"), (r"(?i)^(can|gim|gon|got|lem|wan)(not|me|na|ta)\z", r"\1|\2"), (r"(?i)^('?t)(is|was)\z", r"\1|\2"), (r"(?i)^(d')(ye)\z", r"\1|\2"), (r"(?i)^(more)('n)\z", r"\1|\2"),
    (r"(?i)^([^|]+)('ll|'ve|'re|n't|'s|'m|'d)\z", r"\1|\2"), (r"^([^|]+[^|'])'\z", r"\1|'"),
)


def contracted_sql(word: str) -> str:
    """A word split by '|' where it is a contraction."""
    word = f"regexp_replace({word}, '([\\p{{L}}\\p{{N}}])[{QUOTE_Q}]([\\p{{L}}\\p{{N}}])', '\\1''\\2', 'g')"
    for pat, to in CONTRACTIONS_SQL:
        word = f"regexp_replace({word}, {q(pat)}, {q(to)})"
    return word


@register(
    "q_ptb_contractions",
    "WITH "
    + f"{chunks_sql(DOCS)}, {affix_sql()}, w AS (SELECT regexp_replace(regexp_replace(core, '([\\p{{L}}\\p{{N}}])[{QUOTE_Q}]([\\p{{L}}\\p{{N}}])', '\\1''\\2', 'g'), '[{QUOTE_Q}]\\z', '''') AS word FROM af WHERE NOT contains(kept, 'u') AND core <> '' AND NOT contains(core, '|') UNION SELECT unnest(["
    + ", ".join(q(x) for x in CONTRACTED)
    + "])), r7 AS (SELECT word, "
    + contracted_sql("word")
    + " AS t FROM w)"
    + " SELECT word, t AS tokens FROM r7 WHERE word <> t",
)
def q_ptb_contractions(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of the texts, separators parted and apostrophes unified, that the rules split."""
    a = S.chunks(documents(spark, sf), "doc_id", following=False).select("chunk").distinct().select(F.explode(F.array(S.affixes(F.col("chunk")))).alias("a"))
    word = T.sub(T.unify_apostrophe(F.col("a.core")), rf"[{K.QUOTE}]\z", "'")
    w = a.filter("NOT a.is_url AND a.core <> '' AND NOT contains(a.core, '|')").select(word.alias("word"))
    w = w.union(spark.createDataFrame([(x,) for x in CONTRACTED], "word string")).distinct()
    return w.select("word", T.contractions(F.col("word")).alias("tokens")).filter("word <> tokens")


# Dictionaries --------------------------------------------------------------------------------------------------------

_DOTTED = f"{DICT}, {chunks_sql(DOCS)}, {affix_sql()}, ab AS (SELECT *, lower(core || '.') AS abbr FROM af WHERE tail = '.' AND core <> '')"


@register("q_abbrev_join", f"WITH {_DOTTED} SELECT doc_id, para_no, chunk_no, abbr, expect_cap FROM ab JOIN dict USING (abbr)")
def q_abbrev_join(spark: SparkSession, sf: str) -> DataFrame:
    return D.abbreviation_hits(documents(spark, sf), "doc_id", table(spark, sf, "abbreviations")).select("doc_id", "para_no", "chunk_no", "abbr", "expect_cap")


@register("q_abbrev_semi", f"WITH {_DOTTED} SELECT doc_id, para_no, chunk_no, abbr FROM ab WHERE abbr IN (SELECT abbr FROM dict)")
def q_abbrev_semi(spark: SparkSession, sf: str) -> DataFrame:
    return D.abbreviation_hits(documents(spark, sf), "doc_id", table(spark, sf, "abbreviations"), "left_semi").select("doc_id", "para_no", "chunk_no", "abbr")


@register("q_abbrev_anti", f"WITH {_DOTTED} SELECT doc_id, para_no, chunk_no, abbr FROM ab WHERE abbr NOT IN (SELECT abbr FROM dict)")
def q_abbrev_anti(spark: SparkSession, sf: str) -> DataFrame:
    return D.abbreviation_hits(documents(spark, sf), "doc_id", table(spark, sf, "abbreviations"), "left_anti").select("doc_id", "para_no", "chunk_no", "abbr")


@register("q_abbrev_cap", f"WITH {DICT}, {chunks_sql(SRC)}, {affix_sql()}, {class_sql(True)} SELECT doc_id, para_no, chunk_no, chunk, end_class, boundary FROM bo WHERE end_class IN ('ABBR_CAP', 'ABBR_DICT')")
def q_abbrev_cap(spark: SparkSession, sf: str) -> DataFrame:
    a = S.analysed(sources(spark, sf), "doc_id", S.dictionary_map(table(spark, sf, "abbreviations")))
    return a.filter(F.col("end_class").isin("ABBR_CAP", "ABBR_DICT")).select("doc_id", "para_no", "chunk_no", "chunk", "end_class", "boundary")


_PH = r"ph AS (SELECT DISTINCT trim(regexp_replace(phrase, '[ \t]+', ' ', 'g')) AS phrase FROM phrases WHERE trim(phrase) <> ''), pl AS (SELECT phrase, len(string_split(phrase, ' '))::BIGINT AS n_words FROM ph)"
_CAND = f"""{_PH}, {sentences_sql(SRC)}, sz AS (SELECT DISTINCT n_words AS n FROM pl), sw AS (SELECT doc_id, sent_no, string_split(sentence, ' ') AS w FROM se),
    gr AS (SELECT doc_id, sent_no, i - 1 AS start, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT doc_id, sent_no, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sw, sz WHERE len(w) >= n)),
    ca AS (SELECT doc_id, sent_no, start, phrase, n_words FROM gr JOIN pl USING (phrase))"""


@register("q_mwu_candidates", f"WITH {_CAND} SELECT doc_id, sent_no, start, phrase, n_words FROM ca")
def q_mwu_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return D.phrase_candidates(sources(spark, sf), "doc_id", table(spark, sf, "phrases"))


@register("q_mwu_join", f"WITH {_CAND} SELECT doc_id, sent_no, start, phrase, n_words FROM ca QUALIFY row_number() OVER (PARTITION BY doc_id, sent_no, start ORDER BY n_words DESC) = 1")
def q_mwu_join(spark: SparkSession, sf: str) -> DataFrame:
    return D.longest_phrases(D.phrase_candidates(sources(spark, sf), "doc_id", table(spark, sf, "phrases")), "doc_id")


_MWU = rf"""{_PH}, {sentences_sql(SRC)}, rx AS (SELECT '( )(' || string_agg(replace(regexp_escape(phrase), '\ ', '  '), '|' ORDER BY length(phrase) DESC, phrase) || ')( )' AS r FROM ph),
    mk AS (SELECT doc_id, sent_no, string_split(regexp_replace('  ' || replace(sentence, ' ', '  ') || '  ', r, '\1' || chr(2) || '\2' || chr(3) || '\3', 'g'), chr(2)) AS ps FROM se, rx)"""
register(
    "q_mwu_text",
    f"WITH {_MWU} SELECT doc_id, sent_no, trim(replace(array_to_string(list_transform(ps, lambda x: CASE WHEN contains(x, chr(3)) THEN replace(split_part(x, chr(3), 1), '  ', '_') || split_part(x, chr(3), 2) ELSE x END), ''), '  ', ' '), ' ') AS sentence FROM mk",
)(lambda spark, sf: D.multi_word_text(sources(spark, sf), "doc_id", table(spark, sf, "phrases")))


# Lines ---------------------------------------------------------------------------------------------------------------


@register("q_lines", f"WITH {lines_sql(SRC)} SELECT doc_id, line_no, line FROM ln")
def q_lines(spark: SparkSession, sf: str) -> DataFrame:
    return L.lines(sources(spark, sf), "doc_id")


@register("q_look_ahead", rf"WITH {lines_sql(SRC)} SELECT doc_id, line_no, length(regexp_replace(line, '[ \t\x0B\f\x{{A0}}]+\z', ''))::BIGINT AS ink_end FROM ln")
def q_look_ahead(spark: SparkSession, sf: str) -> DataFrame:
    return L.look_ahead(sources(spark, sf), "doc_id")


def _text_query(name: str, sql: str, fn: Callable[[Column], Column], src: str = SRC, df: Callable[[SparkSession, str], DataFrame] = sources) -> None:
    """A function of a whole text, over all texts."""
    register(name, f"SELECT doc_id, {sql} AS text FROM ({src})")(lambda spark, sf: df(spark, sf).filter("text IS NOT NULL").select("doc_id", fn(F.col("text")).alias("text")))


def _translate_sql(one: dict[str, str], many: dict[str, str], col: str = "text") -> str:
    e = f"translate({col}, {q(''.join(one))}, {q(''.join(one.values()))})"
    for k, v in many.items():
        e = f"replace({e}, {q(k)}, {q(v)})"
    return e


# texts of the files with line ends of old systems and typographic marks put in, the same on both sides
CRLF_SQL = f"SELECT doc_id, replace(replace(text, chr(10) || chr(10), chr(13)), chr(10), chr(13) || chr(10)) AS text FROM ({SRC})"
CTRL_SQL = f"SELECT doc_id, replace(replace(replace(text, '. ', chr(1) || '. '), ' t', ' ' || chr(12) || ' t'), ', ', chr(11) || ' ') AS text FROM ({SRC})"
C1_SQL = f"SELECT doc_id, replace(replace(replace(text, '“', chr(147)), '”', chr(148)), 'e ', chr(128) || chr(133) || ' ') AS text FROM ({SRC})"
BOM_SQL = f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN chr(65279) || text ELSE text END AS text FROM ({SRC})"


def _changed(expr: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: sources(spark, sf).select("doc_id", F.expr(expr).alias("text"))


crlf = _changed(r"replace(replace(text, '\n\n', '\r'), '\n', '\r\n')")
ctrl = _changed(r"replace(replace(replace(text, '. ', concat(chr(1), '. ')), ' t', concat(' ', chr(12), ' t')), ', ', concat(chr(11), ' '))")
c1 = _changed("replace(replace(replace(text, '“', '\\u0093'), '”', '\\u0094'), 'e ', '\\u0080\\u0085 ')")
bom = _changed("CASE WHEN doc_id % 2 = 0 THEN concat('\\uFEFF', text) ELSE text END")

_text_query("q_normalize_eol", NORM.format("text"), T.normalize_eol, CRLF_SQL, crlf)
_text_query("q_eol_style", r"regexp_extract(text, '(\r\n|\n\r|\n|\r)', 1)", T.eol_style, CRLF_SQL, crlf)
_text_query("q_strip_bom", r"regexp_replace(text, '^\x{FEFF}', '')", T.strip_bom, BOM_SQL, bom)
_text_query("q_control_chars", r"regexp_replace(text, '[\x01-\x08\x0E-\x1F]', '*', 'g')", T.control_chars, CTRL_SQL, ctrl)
_text_query("q_ascii_fold", _translate_sql(T.FOLD_ONE, T.FOLD_MANY), T.ascii_fold)
_text_query("q_ascii_fold_c1", _translate_sql({chr(k): v for k, v in T.C1_ONE.items()} | T.FOLD_ONE, {chr(k): v for k, v in T.C1_MANY.items()}), T.ascii_fold_c1, C1_SQL, c1)
WS_SQL = rf"regexp_replace(regexp_replace(regexp_replace(@@, '[{K.FLAT_SPACE}]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+\z', '', 'g')"
_text_query("q_regularize_ws", WS_SQL.replace("@@", "text"), T.regularize_ws, CTRL_SQL, ctrl)
_text_query("q_formfeed", r"regexp_replace(regexp_replace(text, '[ \t\n\x0B]*\f[ \t\n\x0B\f]*', chr(12) || chr(10), 'g'), '[ \t\n]*\x0B[ \t\n\x0B]*', chr(11) || chr(10), 'g')", T.formfeed, CTRL_SQL, ctrl)
TAG_SQL = K.TAG.replace("'", "''")
_text_query("q_strip_tags", WS_SQL.replace("@@", f"regexp_replace(text, '{TAG_SQL}', ' ', 'g')"), M.strip_tags)
_text_query("q_tag_split", WS_SQL.replace("@@", f"regexp_replace(text, '({TAG_SQL})', ' \\1 ', 'g')"), M.split_around_tags)
_ENT = "text"
for _k, _v in M.ENTITIES.items():
    _ENT = f"replace({_ENT}, {q(_k)}, {q(_v)})"
_text_query("q_entities", _ENT, M.decode_entities)


@register("q_tags", rf"SELECT doc_id, unnest(range(len(ts))) AS tag_no, regexp_replace(unnest(ts), '[ \t\n\x0B\f\r\x{{A0}}]+', ' ', 'g') AS tag FROM (SELECT doc_id, regexp_extract_all(text, '{TAG_SQL}') AS ts FROM ({SRC}))")
def q_tags(spark: SparkSession, sf: str) -> DataFrame:
    return M.tags(sources(spark, sf), "doc_id")


_NOISE = r"CASE WHEN length(line) = 0 THEN 0.0 ELSE length(regexp_replace(line, '[\p{L}\p{N} .,;:!?''\"()\-]+', '', 'g'))::DOUBLE / length(line) END".replace(r"\"", '"')


@register("q_noise_score", f"WITH {lines_sql(DOCS)} SELECT doc_id, line_no, {_NOISE} AS noise FROM ln")
def q_noise_score(spark: SparkSession, sf: str) -> DataFrame:
    return L.lines(documents(spark, sf), "doc_id").select("doc_id", "line_no", T.noise(F.col("line")).alias("noise"))


@register("q_noise_filter", f"WITH {lines_sql(DOCS)} SELECT doc_id, string_agg(CASE WHEN {_NOISE} < 0.44 THEN line ELSE '' END, chr(10) ORDER BY line_no) AS text FROM ln GROUP BY doc_id")
def q_noise_filter(spark: SparkSession, sf: str) -> DataFrame:
    return L.noise_filtered(documents(spark, sf).filter("text IS NOT NULL"), "doc_id")


_BUL = r"'^[ \t]*([-*\x{2022}\x{2023}\x{25E6}\x01-\x07\x0E-\x1F]+)[ \t]+(.*)$'"
_BL = f"{lines_sql(SRC)}, bl AS (SELECT doc_id, line_no, line, regexp_matches(line, {_BUL}) AS is_bullet, regexp_extract(line, {_BUL}, 1) AS bullet, regexp_extract(line, {_BUL}, 2) AS content FROM ln)"


@register("q_is_bullet", f"WITH {_BL} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE is_bullet) AS n_bullets FROM bl GROUP BY doc_id")
def q_is_bullet(spark: SparkSession, sf: str) -> DataFrame:
    ls = F.split(T.normalize_eol(F.col("text")), "\n")
    return sources(spark, sf).filter("text IS NOT NULL").select("doc_id", F.size(ls).cast("bigint").alias("n_lines"), F.size(F.filter(ls, lambda x: x.rlike(L.BULLET))).cast("bigint").alias("n_bullets"))


@register("q_bullet_lines", f"WITH {_BL} SELECT doc_id, line_no, is_bullet, bullet, CASE WHEN is_bullet THEN content ELSE line END AS content FROM bl")
def q_bullet_lines(spark: SparkSession, sf: str) -> DataFrame:
    return L.bullet_lines(sources(spark, sf), "doc_id")


_RUNS = f"{_BL}, ru AS (SELECT *, sum((NOT is_bullet)::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)::BIGINT AS run_no, coalesce(lag(bullet) OVER w = bullet, false) OR coalesce(lead(bullet) OVER w = bullet, false) AS confirmed FROM bl WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))"


@register("q_bullet_runs", f"WITH {_RUNS} SELECT doc_id, line_no, run_no, row_number() OVER (PARTITION BY doc_id, run_no ORDER BY line_no) AS in_run FROM ru WHERE is_bullet")
def q_bullet_runs(spark: SparkSession, sf: str) -> DataFrame:
    return L.bullet_runs(sources(spark, sf), "doc_id").drop("confirmed")


@register("q_bullet_confirmed", f"WITH {_RUNS} SELECT doc_id, line_no, confirmed FROM ru WHERE is_bullet")
def q_bullet_confirmed(spark: SparkSession, sf: str) -> DataFrame:
    return L.bullet_runs(sources(spark, sf), "doc_id").select("doc_id", "line_no", "confirmed")


@register("q_bullet_replace", f"WITH {_BL} SELECT doc_id, string_agg(CASE WHEN is_bullet THEN '> ' || content ELSE line END, chr(10) ORDER BY line_no) AS text FROM bl GROUP BY doc_id")
def q_bullet_replace(spark: SparkSession, sf: str) -> DataFrame:
    return L.bullets_emitted(sources(spark, sf).filter("text IS NOT NULL"), "doc_id", "replace", ">")


@register(
    "q_bullet_separate",
    f"WITH {_RUNS}, ir AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run_no, is_bullet ORDER BY line_no) AS k FROM ru) "
    "SELECT doc_id, string_agg(CASE WHEN is_bullet AND k <= 5 THEN chr(10) || content || chr(10) WHEN is_bullet THEN content ELSE line END, chr(10) ORDER BY line_no) AS text FROM ir GROUP BY doc_id",
)
def q_bullet_separate(spark: SparkSession, sf: str) -> DataFrame:
    return L.bullets_emitted(sources(spark, sf).filter("text IS NOT NULL"), "doc_id", "drop", separate=True)


_lv, _uv = "".join(x for x in K.VOWELS if x.islower()), "".join(x for x in K.VOWELS if x.isupper())
_ll = rf"(?:^|[^\p{{L}}\p{{N}}-])(?:\p{{L}}[\p{{Ll}}-]*[{_lv}][\p{{Ll}}-]*|[{K.VOWELS}][\p{{Ll}}-]*)-[ \t]*\z"
_ul = rf"(?:^|[^\p{{L}}\p{{N}}-])(?:\p{{L}}[\p{{Lu}}-]*[{_uv}][\p{{Lu}}-]*|[{_uv}][\p{{Lu}}-]*)-[ \t]*\z"


def dehyphenate_sql(src: str) -> str:
    """CTEs that end in dh(doc_id, text)."""
    return rf"""{lines_sql(src)}, nx AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS nl0 FROM ln), n2 AS (SELECT *, ltrim(nl0, ' ' || chr(9)) AS nl FROM nx),
    jo AS (SELECT *, CASE WHEN nl0 IS NULL OR nl = '' THEN 'keep'
        WHEN regexp_matches(line, '{_ll}') AND regexp_matches(nl, '^(?:\p{{Ll}}{{2}}|\p{{Ll}}[.!?])') AND regexp_matches(nl, '^\p{{Ll}}*[{_lv}]') THEN 'join'
        WHEN regexp_matches(line, '{_ul}') AND regexp_matches(nl, '^(?:\p{{Lu}}{{2}}|\p{{Lu}}[.!?])') AND regexp_matches(nl, '^\p{{Lu}}*[{_uv}]') THEN 'join'
        WHEN regexp_matches(line, '(?:^|[^-])-[ \t]*\z') AND regexp_matches(nl, '^(?:\p{{L}}{{2}}|\p{{L}}[.!?])') THEN 'hyphen' ELSE 'keep' END AS how FROM n2),
    st AS (SELECT *, coalesce(lag(how) OVER (PARTITION BY doc_id ORDER BY line_no), 'keep') AS before FROM jo),
    pi AS (SELECT doc_id, line_no, how, CASE WHEN before = 'keep' THEN line ELSE ltrim(line, ' ' || chr(9)) END AS line FROM st),
    dh AS (SELECT doc_id, string_agg(CASE WHEN how = 'join' THEN regexp_replace(line, '-[ \t]*\z', '') WHEN how = 'hyphen' THEN regexp_replace(line, '-[ \t]*\z', '-') WHEN line_no = last THEN line ELSE line || chr(10) END, '' ORDER BY line_no) AS text
    FROM (SELECT *, max(line_no) OVER (PARTITION BY doc_id) AS last FROM pi) GROUP BY doc_id)"""


@register("q_dehyphenate", f"WITH {dehyphenate_sql(SRC)} SELECT doc_id, text FROM dh")
def q_dehyphenate(spark: SparkSession, sf: str) -> DataFrame:
    return sources(spark, sf).filter("text IS NOT NULL").select("doc_id", L.dehyphenated(F.col("text")).alias("text"))


@register("q_headings", rf"""WITH {paras_sql(SRC)}, h AS (SELECT doc_id, para_no, regexp_replace(para, '[ \t]*\n[ \t]*', ' ', 'g') AS line FROM pa WHERE NOT contains(para, chr(10)) AND NOT regexp_matches(para, '[.,;:?!]\z')),
    w AS (SELECT doc_id, para_no, line, list_filter(regexp_split_to_array(line, '[ \t]+'), lambda x: regexp_matches(x, '^\p{{L}}')) AS ws FROM h)
    SELECT doc_id, para_no, line FROM w WHERE len(ws) > 0 AND 2 * len(list_filter(ws, lambda x: regexp_matches(x, '^\p{{Lu}}'))) > len(ws)""")
def q_headings(spark: SparkSession, sf: str) -> DataFrame:
    """One-line paragraphs without a final mark most of whose words are capitalised."""
    p = S.paragraphs(sources(spark, sf), "doc_id").filter(~F.col("para").contains("\n") & ~F.col("para").rlike(r"[.,;:?!]\z"))
    ws = F.filter(F.split("para", "[ \t]+"), lambda x: x.rlike(r"^\p{L}"))
    return p.filter((F.size(ws) > 0) & (2 * F.size(F.filter(ws, lambda x: x.rlike(r"^\p{Lu}"))) > F.size(ws))).select("doc_id", "para_no", F.col("para").alias("line"))


# Sinks and sources ---------------------------------------------------------------------------------------------------


@register("q_document_text", f"WITH {sentences_sql(SRC)}, pt AS (SELECT doc_id, para_no, string_agg(sentence, chr(10) ORDER BY sent_no) AS t FROM se GROUP BY ALL) SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY para_no) || chr(10) AS text FROM pt GROUP BY doc_id")
def q_document_text(spark: SparkSession, sf: str) -> DataFrame:
    """Row-wise: the run's own output of each document."""
    paras = F.transform(S.paragraphs_of(F.col("text")), lambda p: F.array_join(S.sentences_of(p), "\n"))
    return sources(spark, sf).select("doc_id", F.concat(F.array_join(paras, "\n\n"), F.lit("\n")).alias("text")).filter("text <> '\n'")


@register("q_document_text_grouped", ORACLE["q_document_text"])
def q_document_text_grouped(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.document_text(S.sentences(sources(spark, sf), "doc_id"), "doc_id")


@register("q_blank_after", f"WITH {sentences_sql(SRC)}, x AS (SELECT doc_id, sent_no, unnest(CASE WHEN right(sentence, 1) IN ('.', ';', '?', '!') THEN [sentence] ELSE [sentence, ''] END) AS line FROM se) SELECT doc_id, sent_no, line FROM x")
def q_blank_after(spark: SparkSession, sf: str) -> DataFrame:
    s = S.sentences(sources(spark, sf), "doc_id")
    return s.select("doc_id", "sent_no", F.explode(F.when(F.col("sentence").rlike(r"[.;?!]\z"), F.array("sentence")).otherwise(F.array("sentence", F.lit("")))).alias("line"))


FORMATS = ("{\\rtf1 x}", "abc", "", "{\\rt", " {\\rtf1")


@register("q_detect_format", "SELECT doc_id, CASE WHEN starts_with(text, '{\\rtf') THEN 'rtf' ELSE 'text' END AS format FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '{\\rtf1 ' || text ELSE text END AS text FROM (" + SRC + "))")
def q_detect_format(spark: SparkSession, sf: str) -> DataFrame:
    t = sources(spark, sf).filter("text IS NOT NULL").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("{\\rtf1 "), "text")).otherwise(F.col("text")))
    return t.select("doc_id", R.format_of(F.col("text")).alias("format"))


@register("q_read_list", rf"""WITH l AS (SELECT doc_id, string_split(replace(text, chr(13), ''), chr(10)) AS ls FROM ({SRC})), e AS (SELECT doc_id, list_filter(list_transform(ls[1:len(ls) - 1], lambda x: {{'entry': regexp_replace(x, '^[ \t]+', ''), 'flagged': regexp_matches(x, '^[ \t]')}}), lambda r: r.entry <> '') AS rs FROM l)
    SELECT doc_id, unnest(range(len(rs))) AS entry_no, unnest(rs).entry AS entry, unnest(rs).flagged AS flagged FROM e""")
def q_read_list(spark: SparkSession, sf: str) -> DataFrame:
    x = sources(spark, sf).filter("text IS NOT NULL").select("doc_id", F.posexplode(R.list_entries(F.col("text"))).alias("entry_no", "r"))
    return x.select("doc_id", F.col("entry_no").cast("bigint").alias("entry_no"), "r.entry", "r.flagged")


OPTION_LINES = ("-x +", "; comment", '-a "my file.txt" ; note', "-t", "", "-m'list.txt'", "-o utf-8 ; out", "no option", '-B "a" b', " -e  ")


@register(
    "q_parse_options",
    "WITH o AS (SELECT unnest(range(10)) AS line_no, unnest([" + ", ".join(q(x) for x in OPTION_LINES) + r"""]) AS line), r AS (SELECT line_no, regexp_extract(line, '^[ \t]*-([A-Za-z])[ \t]*(.*?)[ \t]*\z', 1) AS letter, regexp_extract(line, '^[ \t]*-([A-Za-z])[ \t]*(.*?)[ \t]*\z', 2) AS v FROM o WHERE regexp_matches(line, '^[ \t]*-([A-Za-z])'))
    SELECT line_no, letter, CASE WHEN regexp_matches(v, '^["'']([^"'']*)["''][ \t]*(?:;.*)?\z') THEN regexp_extract(v, '^["'']([^"'']*)["''][ \t]*(?:;.*)?\z', 1) ELSE regexp_replace(v, '[ \t]*;.*\z', '') END AS value FROM r""",
)
def q_parse_options(spark: SparkSession, sf: str) -> DataFrame:
    found = [(i, *x) for i, x in ((i, split_option_line(line)) for i, line in enumerate(OPTION_LINES)) if x is not None]
    return spark.createDataFrame(found, "line_no bigint, letter string, value string")


@register("q_decode_bytes", f"SELECT doc_id, text FROM ({SRC})")
def q_decode_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Texts written in the encoding that fits them, with and without byte order marks, and read back."""
    t = sources(spark, sf).filter("text IS NOT NULL")
    k = F.col("doc_id") % 4
    latin = F.col("text").rlike(r"^[\x{00}-\x{FF}]*\z") & F.col("text").rlike(r"[\x{A0}-\x{FF}](?![\x{80}-\x{BF}])") & ~F.col("text").rlike(r"[\x{C2}-\x{F4}][\x{80}-\x{BF}]")
    content = (
        F.when(k == 0, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).when(k == 1, F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE")))
        .when((k == 2) & latin, F.encode("text", "ISO-8859-1")).otherwise(F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))
    )
    return t.select("doc_id", R.decoded(content).alias("text"))


_UNIT = "substr(printf('%04X', {0}), 3, 2) || substr(printf('%04X', {0}), 1, 2)"
_PAIR = f"CASE WHEN u < 65536 THEN {_UNIT.format('u')} ELSE {_UNIT.format('(55296 + ((u - 65536) >> 10))')} || {_UNIT.format('(56320 + ((u - 65536) & 1023))')} END"


@register("q_encode_utf16", f"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(t, '(?s).')) AS ch, unnest(range(length(t))) AS i FROM (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(10), chr(13) || chr(10)) AS t FROM ({SRC}))),
    h AS (SELECT doc_id, string_agg({_PAIR}, '' ORDER BY i) AS content FROM (SELECT doc_id, i, unicode(ch) AS u FROM c) GROUP BY doc_id)
    SELECT s.doc_id AS doc_id, 'FFFE' || coalesce(content, '') AS content FROM ({SRC}) s LEFT JOIN h USING (doc_id)""")
def q_encode_utf16(spark: SparkSession, sf: str) -> DataFrame:
    return sources(spark, sf).filter("text IS NOT NULL").select("doc_id", F.hex(sinks.encoded(F.col("text"), "utf-16")).alias("content"))


def _as_rtf(text: Column) -> Column:
    """A text as RTF: braces and backslashes escaped, other characters as they are, paragraphs by control words."""
    t = F.regexp_replace(text, r"([\\{}])", r"\\$1")
    t = F.regexp_replace(F.regexp_replace(t, r"\n\s*\n", r"\\par "), r"\n", r"\\line ")
    return F.concat(F.lit(r"{\rtf1\ansi{\fonttbl{\f0\fcharset0 Roman;}}{\info{\title t}}\f0 "), t, F.lit("}"))


_PY_BLANK = r"\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


@register("q_rtf_text", rf"SELECT doc_id, regexp_replace(replace(regexp_replace(text, '\n[ \t\n\x0B\f\r]*\n', chr(10) || chr(10), 'g'), chr(13), ''), '^[{_PY_BLANK}]+|[{_PY_BLANK}]+\z', '', 'g') AS text FROM ({SRC})")
def q_rtf_text(spark: SparkSession, sf: str) -> DataFrame:
    return sources(spark, sf).filter("text IS NOT NULL").select("doc_id", rtf.rtf_text(_as_rtf(F.col("text"))).alias("text"))


U = "\\" + "u"  # the control word of a code unit
RTF_UNICODE = (
    "{\\rtf1 " + U + "55357 " + U + "56911 }", "{\\rtf1 " + U + "55357" + U + "56911}", "{\\rtf1\\uc0 " + U + "228 x}", "{\\rtf1 " + U + "228?x}",
    "{\\rtf1{\\uc2 " + U + "8364??}!}", "{\\rtf1\\ansi\\ansicpg1251 \\'cf\\'f0}", "plain",
)


@register(
    "q_rtf_unicode",
    "SELECT unnest([0, 1, 2, 3, 4, 5, 6]::BIGINT[]) AS id, unnest(['\U0001F64F', '\U0001F64F', 'äx', 'äx', '€!', 'Пр', 'plain']) AS text",
)
def q_rtf_unicode(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "feeds")  # sends the package to the executors
    d = spark.createDataFrame(list(enumerate(RTF_UNICODE)), "id bigint, x string")
    return d.select("id", rtf.rtf_text(F.col("x")).alias("text"))


_RUN_LINE = WS_SQL.replace("@@", _translate_sql(
    {"‒": "-", "–": "-", "—": "-", "―": "-", "‖": "|", "‗": "_", "‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "•": "*"},
    {"€": "EUR", "…": "...", "Œ": "OE", "œ": "oe", "™": "TM", "Ĳ": "IJ", "ĳ": "ij"}, "array_to_string(ts, ' ')",
))
_FF_SQL = r"regexp_replace(regexp_replace({0}, '[ \t\n\x0B]*\f[ \t\n\x0B\f]*', chr(12) || chr(10), 'g'), '[ \t\n]*\x0B[ \t\n\x0B]*', chr(11) || chr(10), 'g')"
_RUN_SQL = f"""WITH nm AS (SELECT doc_id, regexp_replace({NORM.format('text')}, '{TAG_SQL}', ' ', 'g') AS text FROM ({SRC})), {dehyphenate_sql('SELECT doc_id, text FROM nm')},
    pr AS (SELECT doc_id, {_FF_SQL.format(r"regexp_replace(text, '[\x01-\x08\x0E-\x1F]', '*', 'g')")} AS text FROM dh),
    {token_sql('SELECT doc_id, text FROM pr', True, True)}, fl AS (SELECT doc_id, sent_no, flatten(list(ts ORDER BY chunk_no, part_no)) AS ts FROM tk GROUP BY doc_id, sent_no),
    li AS (SELECT doc_id, para_no, sent_no, {_RUN_LINE} || chr(10) AS line FROM fl JOIN se USING (doc_id, sent_no)),
    pt AS (SELECT doc_id, para_no, string_agg(line, '' ORDER BY sent_no) AS t FROM li GROUP BY doc_id, para_no),
    tx AS (SELECT doc_id, regexp_replace(string_agg(t, chr(10) ORDER BY para_no), '\\n{{3,}}', chr(10) || chr(10), 'g') AS text FROM pt GROUP BY doc_id)
    SELECT delivery_id AS doc_id, CASE WHEN sourcefile IS NOT NULL THEN coalesce(text, '') END AS text FROM source_files LEFT JOIN tx ON doc_id = delivery_id"""


@register("q_run_text", _RUN_SQL)
def q_run_text(spark: SparkSession, sf: str) -> DataFrame:
    """The whole run with tokenisation, contractions and folding, one output text per document."""
    table(spark, sf, "feeds")
    o = Options(tokenize=True, penn_treebank=True, ascii_fold=True, suppress_markup=True, blank_at_paragraph_end=True)
    return run_text(sources(spark, sf), "doc_id", o, table(spark, sf, "abbreviations")).select("doc_id", "text")
