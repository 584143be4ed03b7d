"""Paragraphs, chunks, affixes, sentence boundaries and tokens.

Everything up to the token works inside the row, by higher-order functions over the sentences and chunks of a
paragraph: there is no shuffle and no window, so that the same plan serves streams. Only what may need a rule is
looked at by it: pieces of a paragraph that end in a mark, and chunks that hold a separator. Rows with a null
text give nothing. Keys of the caller are kept as they are; names of the result that clash with them
are an error of the caller's.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classes as K
from ..functions.text import contractions, let, normalize_eol, split_dashes, strip_blanks, sub, unify_apostrophe

MAX_DICTIONARY = 20_000
END = "\n"  # parts sentences while they are still one text; their own newlines have become blanks
TAG_OPEN, TAG_CLOSE = "\ue0e1", "\ue0e2"  # a tag that is to be kept whole stands between them


def paragraphs_of(text: Column) -> Column:
    """Array of the paragraphs of a text that hold more than white space, line ends unified."""
    return F.filter(F.transform(F.split(normalize_eol(text), K.BLANK_LINE), strip_blanks), lambda p: p != "")


def unwrapped(para: Column) -> Column:
    """A paragraph in one line: a single newline is a blank."""
    return sub(para, r"[ \t]*\n[ \t]*", " ")


def chunks_of(para: Column) -> Column:
    """Array of the chunks of a paragraph: what stands between blanks, tabs and newlines."""
    return F.split(para, r"[ \t\n]+")


def affixes(chunk: Column) -> Column:
    """struct(chunk, head, core, tail, is_url, is_entity, kept): separators parted from the word, by rules in fixed order.

    A chunk of separators only is all head. kept names the rules that moved separators back into the word. A chunk
    that no rule can part is its own core at once.
    """
    no = F.lit(False)
    whole = F.struct(chunk.alias("chunk"), F.lit("").alias("head"), chunk.alias("core"), F.lit("").alias("tail"), no.alias("is_url"), no.alias("is_entity"), F.lit("").alias("kept"))
    return F.when(ruled(chunk), _parted(chunk)).otherwise(whole)


def ruled(chunk: Column) -> Column:
    """Whether a chunk has a separator, or signs of quantity after a number."""
    return chunk.rlike(f"[{K.SEP}]|^[0-9].*[{K.QUANTITY}]\\z")


def _parted(chunk: Column) -> Column:
    head = F.regexp_extract(chunk, f"^([{K.SEP}]*)", 1)

    def base(h: Column) -> Column:
        t = F.when(F.length(h) == F.length(chunk), "").otherwise(F.regexp_extract(chunk, f"([{K.SEP}]*)\\z", 1))
        return let(t, lambda t: F.struct(h.alias("head"), F.substr(chunk, F.length(h) + 1, F.length(chunk) - F.length(h) - F.length(t)).alias("core"), t.alias("tail"), F.lit("").alias("kept")))

    s = let(head, base)
    # all but the quantity rule put separators back that stand before or after a word
    moved = s
    for step in (_quote_or_bracket, _quantity, _url_tail, _url_head, _entity):
        moved = let(moved, step)
    return let(
        moved,
        lambda x: F.struct(
            chunk.alias("chunk"), x["head"].alias("head"), x["core"].alias("core"), x["tail"].alias("tail"), x["kept"].contains("u").alias("is_url"), x["kept"].contains("e").alias("is_entity"), x["kept"].alias("kept")
        ),
    )


def _step(x: Column, cond: Column, head: Column, core: Column, tail: Column, mark: str) -> Column:
    out = F.struct(head.alias("head"), core.alias("core"), tail.alias("tail"), F.concat(x["kept"], F.lit(mark)).alias("kept"))
    return F.when((x["core"] != "") & cond, out).otherwise(x)


def _first(c: Column) -> Column:
    return F.substring(c, 1, 1)


def _rest(c: Column, n: Column | int = 1) -> Column:
    return F.substr(c, (F.lit(n) if isinstance(n, int) else n) + 1)


def _quote_or_bracket(x: Column) -> Column:
    """A quote next to the word stays with it if no quote leads. Else everything up to the outermost closing bracket
    stays, if a bracket opens before it in the word or after."""
    head, core, tail = x["head"], x["core"], x["tail"]
    quote = tail.rlike(f"^[{K.QUOTE}]") & ~head.rlike(f"[{K.QUOTE}]")
    body = F.regexp_extract(tail, f"^(.*[{K.RBRACKET}])", 1)
    bracket = (body != "") & F.concat(core, body).rlike(f"[{K.LBRACKET}]")
    kept = _step(x, quote, head, F.concat(core, _first(tail)), _rest(tail), "a")
    return F.when(tail == "", x).when(quote, kept).otherwise(_step(x, bracket, head, F.concat(core, body), _rest(tail, F.length(body)), "b"))


def _quantity(x: Column) -> Column:
    """Trailing signs of quantity part from a number."""
    rx = f"^([0-9].*?)([{K.QUANTITY}]+)\\z"
    q = F.regexp_extract(x["core"], rx, 2)
    return _step(x, x["core"].rlike(rx), x["head"], F.regexp_extract(x["core"], rx, 1), F.concat(q, x["tail"]), "q")


def _inside(word: Column) -> Callable[[Column], Column]:
    return lambda c: F.instr(word, c) > 0


def _url_tail(x: Column) -> Column:
    """The outermost trailing separator that also occurs inside the word stays with it, and what stands between; a final
    dot is passed over, and the search ends at any other dot."""
    core = x["core"]
    body = sub(x["tail"], r"\.\z")
    run = F.regexp_extract(body, r"([^.]*)\z", 1)
    inner = F.substr(core, F.lit(1), F.length(core) - 1)
    last = F.array_max(F.transform(F.filter(F.transform(F.split(run, ""), lambda c, i: F.struct((i + 1).alias("i"), c.alias("c"))), lambda y: (y["c"] != "") & _inside(inner)(y["c"])), lambda y: y["i"]))

    def kept(n: Column) -> Column:
        size = F.length(body) - F.length(run) + n
        return _step(x, n.isNotNull(), x["head"], F.concat(core, F.substr(body, F.lit(1), size)), _rest(x["tail"], size), "u")

    return F.when((x["tail"] != "") & inner.rlike(f"[{K.SEP}]"), let(last, kept)).otherwise(x)


def _url_head(x: Column) -> Column:
    """The outermost leading separator that also occurs in the word stays with it, and what stands between."""
    first = F.array_min(F.transform(F.filter(F.transform(F.split(x["head"], ""), lambda c, i: F.struct((i + 1).alias("i"), c.alias("c"))), lambda y: (y["c"] != "") & _inside(x["core"])(y["c"])), lambda y: y["i"]))
    kept = lambda n: _step(x, n.isNotNull(), F.substr(x["head"], F.lit(1), n - 1), F.concat(_rest(x["head"], n - 1), x["core"]), x["tail"], "u")
    return F.when((x["head"] != "") & x["core"].rlike(f"[{K.SEP}]"), let(first, kept)).otherwise(x)


def _entity(x: Column) -> Column:
    """The ';' of an entity stays with it."""
    return _step(x, x["tail"].startswith(";") & x["core"].contains("&"), x["head"], F.concat(x["core"], F.lit(";")), _rest(x["tail"]), "e")


def dictionary_rows(abbreviations: DataFrame) -> DataFrame:
    """abbr (lower case, trimmed), expect_cap: one row per entry, contradictory ones merged to the one that may end a sentence."""
    d = abbreviations.select(F.lower(F.trim("abbr")).alias("abbr"), "expect_cap").filter("abbr <> ''")
    return d.groupBy("abbr").agg(F.coalesce(F.max("expect_cap"), F.lit(False)).alias("expect_cap"))


@dataclass(frozen=True)
class Dictionary:
    """Abbreviations as sets of the plan: those that may end a sentence, and those that don't. Looked up by hash."""

    may_end: tuple[str, ...]
    never_end: tuple[str, ...]

    def class_of(self, word: Column) -> Column:
        """ABBR_CAP, ABBR_DICT or null of a word with its dot."""
        low = F.lower(word)
        c = F.lit(None).cast("string")
        for name, entries in (("ABBR_DICT", self.never_end), ("ABBR_CAP", self.may_end)):
            if entries:
                c = F.when(low.isin(*entries), name).otherwise(c)
        return c


def dictionary_map(abbreviations: DataFrame | None) -> Dictionary | None:
    """The dictionary as constants of the plan. It is configuration, as an option file is, and must be small."""
    if abbreviations is None:
        return None
    rows = dictionary_rows(abbreviations).limit(MAX_DICTIONARY + 1).collect()
    if len(rows) > MAX_DICTIONARY:
        raise ValueError(f"a dictionary may hold {MAX_DICTIONARY} abbreviations")
    return Dictionary(tuple(sorted(r.abbr for r in rows if r.expect_cap)), tuple(sorted(r.abbr for r in rows if not r.expect_cap))) if rows else None


def dot_class(a: Column, dictionary: Dictionary | None = None) -> Column:
    """What the dot right after a word makes of it: NUM_DOT, INITIAL, ABBR, ABBR_CAP, ABBR_DICT, or null if it is a full stop."""
    core = a["core"]
    single, upper = F.length(core) == 1, core.rlike(r"^\p{Lu}\z")
    c = F.when((~a["is_url"] & core.rlike("[0-9]")) | (single & ~upper), "NUM_DOT").when(single, "INITIAL").when((~a["is_url"] & core.contains(".")) | (a["head"] != ""), "ABBR")
    return c.otherwise(dictionary.class_of(F.concat(core, F.lit("."))) if dictionary else F.lit(None).cast("string"))


def end_class(a: Column, dictionary: Dictionary | None = None) -> Column:
    """ENTITY, NUM_DOT, INITIAL, ABBR, ABBR_CAP, ABBR_DICT, HARD or NONE of a chunk with its affixes."""
    chunk = a["chunk"]
    hard = F.when(chunk.rlike(r"[.;?!]\z"), "HARD").otherwise("NONE")
    return F.when(a["is_entity"] & (a["tail"] == ""), "ENTITY").when((a["tail"] == ".") & (a["core"] != ""), F.coalesce(dot_class(a, dictionary), hard)).otherwise(hard)


def breaks(cls: Column, next_is_lower: Column) -> Column:
    """Whether a sentence ends after a chunk of a class inside a paragraph."""
    return (cls == "HARD") | (cls.isin("NUM_DOT", "ABBR_CAP") & ~next_is_lower)


def with_next(chunks: Column) -> Column:
    """Array of struct(a: chunk, b: the chunk after it or null at the paragraph's end)."""
    nxt = F.concat(F.slice(chunks, 2, F.size(chunks)), F.array(F.lit(None).cast("string")))
    return F.zip_with(chunks, nxt, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _ends(chunk: Column, following: Column, dictionary: Dictionary | None) -> Column:
    """Whether a sentence ends after a chunk that ends in a mark, by the cheapest test that tells."""
    lower = following.rlike(r"^\p{Ll}")
    plain_dot = chunk.rlike(rf"^[^{K.SEP}0-9]{{2,}}\.\z")
    of_plain = F.lit(True)
    if dictionary:
        of_plain = let(dictionary.class_of(chunk), lambda c: c.isNull() | ((c == "ABBR_CAP") & ~lower))
    full = let(end_class(affixes(chunk), dictionary), lambda c: breaks(c, lower))
    return F.when(chunk.rlike(r"[?!]\z"), F.lit(True)).when(plain_dot, of_plain).when(chunk.endswith(";") & ~chunk.contains("&"), F.lit(True)).otherwise(full)


def sentences_of(para: Column, dictionary: Dictionary | None = None, tags: bool = False) -> Column:
    """Array of the sentences of a paragraph, single blanks between chunks.

    The paragraph is cut after every chunk that ends in a mark; the pieces then meet again where the mark ends no
    sentence. With tags, those between TAG_OPEN and TAG_CLOSE are no part of the chunk that they follow.
    """
    flat = sub(para, r"[ \t\n]+", " ")
    tag = f"(?:{TAG_OPEN}[^{TAG_CLOSE}]*{TAG_CLOSE})*"
    pieces = F.split(sub(flat, rf"([.;?!]{tag}) ", "$1\n"), "\n") if tags else F.split(flat, r"(?<=[.;?!]) ")
    shown = (lambda c: sub(c, f"{TAG_OPEN}[^{TAG_CLOSE}]*{TAG_CLOSE}")) if tags else (lambda c: c)

    def glued(x: Column) -> Column:
        last = F.substring_index(x["a"], " ", -1)
        end = let(shown(last), lambda c: _ends(c, shown(x["b"]), dictionary))
        return F.when(x["b"].isNull(), x["a"]).otherwise(F.concat(x["a"], F.when(end, END).otherwise(" ")))

    return F.split(F.array_join(F.transform(with_next(pieces), glued), ""), END)


def paragraphs(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, para_no, para."""
    p = df.select(key, F.posexplode(paragraphs_of(F.col(text))).alias("para_no", "para"))
    return p.select(key, F.col("para_no").cast("bigint").alias("para_no"), "para")


def chunks(df: DataFrame, key: str, text: str = "text", ending: str | None = None, following: bool = True) -> DataFrame:
    """key, para_no, chunk_no, chunk and, if asked for, next_chunk (null at the end of a paragraph); with ending, only
    chunks that end so."""
    p = paragraphs(df, key, text)
    if not following and ending is None:
        c = p.select(key, "para_no", F.posexplode(chunks_of(F.col("para"))).alias("chunk_no", "chunk"))
        return c.select(key, "para_no", F.col("chunk_no").cast("bigint").alias("chunk_no"), "chunk")
    cs = F.transform(with_next(chunks_of(F.col("para"))), lambda x, i: F.struct(i.cast("bigint").alias("chunk_no"), x["a"].alias("chunk"), x["b"].alias("next_chunk")))
    return p.select(key, "para_no", F.inline(cs if ending is None else F.filter(cs, lambda x: x["chunk"].endswith(ending))))


def analysed(df: DataFrame, key: str, dictionary: Dictionary | None = None, text: str = "text", ending: str | None = None) -> DataFrame:
    """Chunks (with ending: those that end so) with affixes, end class and whether a sentence ends after them."""
    # a column that comes out of a generator is computed once, whatever filters follow
    once = lambda d, c, name: d.select("*", F.explode(F.array(c)).alias(name))
    c = once(chunks(df, key, text, ending), affixes(F.col("chunk")), "a")
    c = once(c, end_class(F.col("a"), dictionary), "end_class")
    lower = F.coalesce(F.col("next_chunk").rlike(r"^\p{Ll}"), F.lit(False))
    c = c.withColumns({"next_is_lower": lower, "boundary": F.col("next_chunk").isNull() | breaks(F.col("end_class"), lower)})
    fields = [F.col(f"a.{f}").alias(f) for f in ("head", "core", "tail", "is_url", "is_entity", "kept")]
    inner = [(~F.col("a.is_url") & F.substring("a.core", 2, 1 << 30).contains(".")).alias("has_inner_dot"), F.col("a.core").rlike("[0-9]").alias("has_digit")]
    return c.select(key, "para_no", "chunk_no", "chunk", "next_chunk", *fields, *inner, "end_class", "next_is_lower", "boundary")


def sentences(df: DataFrame, key: str, dictionary: Dictionary | None = None, text: str = "text") -> DataFrame:
    """key, para_no, sent_no (through the text), sentence, n_chunks, in one row-wise pass."""
    per_para = F.transform(paragraphs_of(F.col(text)), lambda p, i: F.transform(sentences_of(p, dictionary), lambda s: F.struct(i.cast("bigint").alias("para_no"), s.alias("sentence"))))
    s = df.select(key, F.posexplode(F.flatten(per_para)).alias("sent_no", "x"))
    return s.select(key, F.col("x.para_no").alias("para_no"), F.col("sent_no").cast("bigint").alias("sent_no"), F.col("x.sentence").alias("sentence"), (F.length("x.sentence") - F.length(F.replace("x.sentence", F.lit(" "), F.lit(""))) + 1).cast("bigint").alias("n_chunks"))


def trailing_runs(tail: Column) -> Column:
    """Array of trailing separators; a run of one character is one token."""
    return F.regexp_extract_all(tail, F.lit(r"(?s)((.)\2*)"), 1)


CONTRACTED = r"(?i)^(?:cannot|gimme|gonna|gotta|lemme|wanna|tis|twas|whatcha|whaddya)\z"


def _words(a: Column, penn_treebank: bool) -> Column:
    """Array of the words of a core."""
    core = a["core"]
    if not penn_treebank:
        return F.array(core)
    split = F.filter(F.split(contractions(unify_apostrophe(core)), r"\|"), lambda w: w != "")
    return F.when(~a["is_url"] & ~core.contains("|") & (core.rlike(f"[{K.QUOTE}]") | core.rlike(CONTRACTED)), split).otherwise(F.array(core))


def tokens_of(a: Column, following: Column, penn_treebank: bool = False, dictionary: Dictionary | None = None) -> Column:
    """Array of the tokens of a chunk with its affixes. The dot of an abbreviation stays on it, whatever follows; that of a
    number only if the next chunk of the sentence goes on in lower case."""
    core, tail = a["core"], a["tail"]
    words = _words(a, penn_treebank)
    rest = F.substring(tail, 2, 1 << 30)
    dotted = F.concat(F.slice(words, 1, F.size(words) - 1), F.array(F.concat(F.element_at(words, -1), F.lit("."))), trailing_runs(rest))
    number_goes_on = (tail == ".") & F.coalesce(following.rlike(r"^\p{Ll}"), F.lit(False))
    glued = let(dot_class(a, dictionary), lambda c: c.isin("INITIAL", "ABBR", "ABBR_CAP", "ABBR_DICT") | ((c == "NUM_DOT") & number_goes_on))
    after = F.when(tail == "", words).when(tail.startswith(".") & F.coalesce(glued, F.lit(False)), dotted).otherwise(F.concat(words, trailing_runs(tail)))
    heads = F.filter(F.split(a["head"], ""), lambda x: x != "")
    return F.when(core == "", F.array(a["chunk"])).when(a["head"] == "", after).otherwise(F.concat(heads, after))


def sentence_tokens(sentence: Column, penn_treebank: bool = False, dictionary: Dictionary | None = None) -> Column:
    """Array of the tokens of a sentence; runs of two or more hyphens are tokens of their own."""
    dashed = F.when(sentence.contains("--"), F.split(split_dashes(sentence), " +")).otherwise(F.split(sentence, " "))

    def of(x: Column) -> Column:
        closer = let(affixes(x["a"]), lambda a: tokens_of(a, x["b"], penn_treebank, dictionary))
        simple = F.array(x["a"])
        return F.when(ruled(x["a"]) | x["a"].rlike(CONTRACTED), closer).otherwise(simple) if penn_treebank else F.when(ruled(x["a"]), closer).otherwise(simple)

    return F.flatten(F.transform(with_next(dashed), of))


def tokens(df: DataFrame, key: str, penn_treebank: bool = False, text: str = "text", dictionary: Dictionary | None = None) -> DataFrame:
    """key, sent_no, token_no (in the sentence), token. Row-wise: the tokens of a sentence are one array."""
    s = sentences(df, key, dictionary, text).select(key, "sent_no", "sentence")
    t = s.select(key, "sent_no", F.posexplode(sentence_tokens(F.col("sentence"), penn_treebank, dictionary)).alias("token_no", "token"))
    return t.select(key, "sent_no", F.col("token_no").cast("bigint").alias("token_no"), "token")
