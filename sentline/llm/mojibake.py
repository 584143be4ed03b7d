"""Problem 2: texts decoded with the wrong character encoding.

Tokens with characters outside ASCII are counted over all files. A rare token is joined with its clean
near-twin, the frequent token that is the same once such characters are stripped, and the runs of
stripped characters are aligned; a transformation (bytes of one encoding read as another, maybe more
than once) that explains an aligned pair gains support. Scripts without ASCII letters have nothing left
when stripped; there the twin is the frequent token that a hypothesis yields, or one that shares runs of characters
with it. Only transformations that aligned pairs support are learned. They are then applied to all other tokens, with the
counts of tokens and characters of the corpus as the judge; what only an unsupported one would restore is listed as
undecided. One that is spread widely is taken whatever the ratio of a token and its twin, if it makes likelier pairs of
characters.

A token of a script without blanks may hold a garbled sentence next to a clean one. Besides the whole, its
pieces count as tokens: cut at sentence marks of such scripts and where they meet other characters outside ASCII.

Null and empty texts give no rows. Numeric character references count as the characters they name.
Replacement characters and C1 controls are traces that can't be restored. Repeated deliveries count once.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small, stored
from .common import source_texts, spread, text_hash

# Encodings that texts are read as by mistake, and encodings that texts are written in.
READ_AS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8_r", "cp866", "mac_cyrillic", "iso8859_5", "cp1253", "iso8859_7", "iso8859_2", "cp1254", "cp1257", "cp852", "cp737", "cp1255", "cp1256", "cp874", "gbk", "big5", "shift_jis", "euc_jp", "euc_kr")
WRITTEN_IN = ("utf_8", "cp1252", "mac_roman", "cp437", "cp850", "koi8_r", "cp1251", "cp866", "mac_cyrillic", "iso8859_5", "cp1253", "iso8859_7", "cp1250", "iso8859_2", "cp852", "cp737", "shift_jis", "gbk", "big5", "euc_jp", "euc_kr")
MULTI = ("utf_8", "shift_jis", "gbk", "big5", "euc_jp", "euc_kr", "utf_8*2", "utf_8*3")
RATIO = 3  # a clean twin is at least so many times as frequent as what is restored to it
LEAST = 3  # and occurs in at least so many files
COMMON_CHAR = 5  # a character of a restored text occurs in at least so many tokens' files
RUN = 5  # characters that a restored text shares with a clean one, where neither has ASCII letters, to count as aligned
MIN_SUPPORT = 2  # distinct aligned pairs that a transformation must explain
WIDE_SUPPORT = 10  # distinct tokens with a more frequent twin that a one-byte transformation needs to be taken whatever the ratio
LIKELIER = 1.5  # pairs of characters of what is then restored are so many times as frequent as those of the token
BROKEN = "[\\x{80}-\\x{84}\\x{86}-\\x{9F}\\x{FFFD}]"
REFERENCE = "&#[0-9]{2,6};"
EDGE = r"^[\x21-\x25\x27-\x2F\x3A\x3C-\x40\x5B-\x60\x7B-\x7E]+|[\x21-\x2F\x3A\x3C-\x40\x5B-\x60\x7B-\x7E]+$"

# Scripts without blanks with their marks and width forms (also Hangul), as a class in Java and in Python.
UNBROKEN = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0xD7FF), (0xF900, 0xFAFF), (0xFE30, 0xFE4F), (0xFF00, 0xFFEF), (0x20000, 0x3FFFF))
WIDE = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in UNBROKEN)
WIDE_PY = "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in UNBROKEN)
SENTENCE_END = "。！？．"
QUOTE_EDGE = "“”‘’…—–·"  # marks of clean text, and bytes of garbled text
LEAST_PREFIX = 10  # bytes that must decode in a piece of which only the first part is garbled


@lru_cache(None)
def _table(codec: str) -> tuple[dict[str, int], str]:
    """Both ways of a one-byte encoding; a byte without a character counts as the control of its number."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            chars.append(chr(b))
    enc = {}
    for b in range(255, -1, -1):
        enc[chars[b]] = b
    if codec == "cp1252":  # readers of Latin-1 keep the C1 range
        enc.update({chr(b): b for b in range(128, 160)})
    return enc, "".join(chars)


def to_bytes(s: str, codec: str) -> bytes | None:
    if codec in MULTI:
        try:
            return s.encode(codec)
        except UnicodeEncodeError:
            return None
    enc = _table(codec)[0]
    try:
        return bytes([enc[c] for c in s])
    except KeyError:
        return None


def from_bytes(b: bytes, codec: str) -> str | None:
    if codec in MULTI:
        try:
            return b.decode(codec)
        except UnicodeDecodeError:
            return None
    t = _table(codec)[1]
    return "".join([t[x] for x in b])


def undo(s: str, chain: str) -> str | None:
    """What was written, if s is it in one encoding read as another: 'read>written', '*n' for n times."""
    read, written = chain.split(">")
    written, _, times = written.partition("*")
    for _ in range(int(times or 1)):
        b = to_bytes(s, read)
        c = None if b is None else from_bytes(b, written)
        if c is None and b is not None and written == "utf_8" and not times:
            head, rest = undo_prefix(s, b, read)
            c = head and head + rest
        s = c
        if s is None:
            return None
    return s


def undo_prefix(s: str, b: bytes, read: str) -> tuple[str | None, str]:
    """(restored part, rest as it is) of a text whose first part alone is UTF-8 read in an encoding of a script without
    blanks; (None, "") if there is no such part."""
    if read not in (*MULTI, "cp874"):
        return None, ""
    try:
        b.decode("utf_8")
    except UnicodeDecodeError as e:
        head = b[: e.start]
        while len(head) >= LEAST_PREFIX and not head.isascii():
            rest = from_bytes(b[len(head) :], read)
            if rest is not None and s.endswith(rest):
                c = head.decode("utf_8")
                return (c, rest) if len(c.encode("ascii", "ignore")) * 2 < len(c) else (None, "")
            # a character of the text holds bytes of both parts: it goes with the rest
            head = head[:-1]
            while head and (head[-1] & 0xC0) == 0x80 and not _whole(head):
                head = head[:-1]
            if head and head[-1] >= 0xC0:
                head = head[:-1]
    return None, ""


def _whole(b: bytes) -> bool:
    try:
        b.decode("utf_8")
    except UnicodeDecodeError:
        return False
    return True


def pieces_of(token: str) -> list[str]:
    """Where a token of a script without blanks may change between clean and garbled; joined they are the token."""
    return re.findall(f"[{WIDE_PY}]+(?:[\x00-\x7f]+[{WIDE_PY}]+)*|[^{WIDE_PY}]+", token)


def undo_pieces(token: str, chain: str) -> str | None:
    """undo() on those pieces of a token that allow it; None if none does."""
    whole = undo(token, chain)
    if whole is not None or not re.search(f"[{WIDE_PY}]", token):
        return whole
    out = []
    for piece in pieces_of(token):
        for part in re.findall(f"[^{SENTENCE_END}]+[{SENTENCE_END}]*|[{SENTENCE_END}]+", piece):
            lead, core, tail = re.fullmatch(f"([{QUOTE_EDGE}]*)(.*?)([{QUOTE_EDGE}]*)", part, re.S).groups()
            r = undo(part, chain) if not part.isascii() else None
            c = undo(core, chain) if r is None and core and not core.isascii() else None
            out.append(r if r is not None else part if c is None else lead + c + tail)
    joined = "".join(out)
    return None if joined == token else joined


def hypotheses(token: str, one_byte: bool = True) -> Iterator[tuple[str, str]]:
    """(chain, restored) of every transformation that a token allows; without one_byte only those into encodings of several bytes."""
    s = html.unescape(token) if "&#" in token else token
    for read in READ_AS:
        b = to_bytes(s, read)
        if b is None:
            continue
        seen = {s}
        for written in WRITTEN_IN:
            if written == read or (read in MULTI and written != "utf_8") or not (one_byte or written in MULTI):
                continue
            c = from_bytes(b, written)
            if c is None and written == "utf_8":
                c, _ = undo_prefix(s, b, read)  # judged by what was garbled
                if c is not None:
                    yield f"{read}>utf_8", c
                continue
            if c is None or c in seen or any("\x7f" <= x <= "\x9f" or x == "�" for x in c if written != "utf_8"):
                continue
            if written == "utf_8":
                times = 1
                while True:
                    yield f"{read}>utf_8" + (f"*{times}" if times > 1 else ""), c
                    b2 = to_bytes(c, read) if times < 3 and not c.isascii() else None
                    c2 = from_bytes(b2, "utf_8") if b2 is not None else None
                    if c2 is None or c2 == c:
                        break
                    c, times = c2, times + 1
                continue
            seen.add(c)
            yield f"{read}>{written}", c


def _pieces(t):
    """The pieces of a token that holds characters of scripts without blanks, also without marks at their edges."""
    narrow = F.regexp_extract_all(t, F.lit(f"([^{WIDE}]+)"), 1)
    bare = F.transform(narrow, lambda x: F.regexp_replace(x, f"^[{QUOTE_EDGE}]+|[{QUOTE_EDGE}]+$", ""))
    wide = F.regexp_extract_all(t, F.lit(f"([{WIDE}\\x00-\\x7F&&[^{SENTENCE_END}]]+[{SENTENCE_END}]*)"), 1)
    # one or two characters at a cut prove nothing: their few bytes are valid in many an encoding
    wide = F.filter(wide, lambda x: F.length(F.regexp_replace(x, r"[^\p{L}\p{M}]|[A-Za-z]", "")) >= 3)
    all_ = F.filter(F.concat(narrow, bare, wide), lambda x: x.rlike(r"[^\x00-\x7F]|&#") & (x != t))
    return F.when(t.rlike(f"[{WIDE}]"), all_).otherwise(F.array().cast("array<string>"))


def file_tokens(texts: DataFrame) -> DataFrame:
    """file_id, tok, whole: distinct tokens with characters outside ASCII, digits masked; pieces of them are not whole."""
    mask = lambda t: F.when(t.contains("&#"), t).otherwise(F.regexp_replace(F.regexp_replace(t, EDGE, ""), "[0-9]+", "0"))
    # characters outside ASCII take more than a byte; that is told without a pattern
    toks = F.array_distinct(F.filter(F.split("text", r"\s+"), lambda x: (F.octet_length(x) > F.length(x)) | (x.contains("&#") & x.rlike(REFERENCE))))
    per = spread(texts.filter("text IS NOT NULL")).select("file_id", toks.alias("toks"))
    both = F.concat(F.transform("toks", lambda t: F.struct(mask(t).alias("tok"), F.lit(1).alias("whole"))), F.transform(F.flatten(F.transform("toks", _pieces)), lambda t: F.struct(mask(t).alias("tok"), F.lit(0).alias("whole"))))
    return per.select("file_id", F.inline(F.array_distinct(both))).filter("tok <> ''").groupBy("file_id", "tok").agg(F.max("whole").alias("whole"))


def _skeleton(c):
    return F.regexp_replace(c, r"[^\x00-\x7F]+|&#[0-9]+;", "")


def vocabulary(toks: DataFrame) -> DataFrame:
    """tok, n: files that hold it, whole: those that hold it as a whole token, skel: what is left when characters outside
    ASCII are stripped."""
    return toks.groupBy("tok").agg(F.count("*").alias("n"), F.sum("whole").alias("whole")).withColumn("skel", _skeleton(F.col("tok")))


def candidates(vocab: DataFrame) -> DataFrame:
    """g, n, chain, c over all tokens and transformations that they allow."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(g, n, chain, re.sub("[0-9]+", "0", c)) for g, n, one in zip(b.tok, b.n, b.one_byte) for chain, c in hypotheses(g, one)]
            yield pd.DataFrame(rows, columns=["g", "n", "chain", "c"])

    # one-byte transformations keep ASCII, so that a word's twin has its skeleton: words that are alone with theirs need no trial
    several = vocab.filter("length(skel) >= 2").groupBy("skel").agg(F.count("*").alias("k")).filter("k > 1")
    worded = F.col("skel").rlike("[A-Za-z]") & (F.length("skel") >= 2)
    word, rest = vocab.filter(worded), vocab.filter(~worded).withColumn("one_byte", F.lit(True))
    word = word.join(several, "skel", "left").withColumn("one_byte", F.col("k").isNotNull()).drop("k")
    return word.unionByName(rest).select("tok", "n", "one_byte").mapInPandas(run, "g string, n bigint, chain string, c string")


def _runs(c):
    """Array of the runs of RUN letters outside ASCII of a text."""
    def of(x):
        chars = F.split(x, "")
        chars = F.filter(chars, lambda y: y != "")
        return F.when(F.size(chars) >= RUN, F.transform(F.sequence(F.lit(1), F.size(chars) - RUN + 1), lambda i: F.array_join(F.slice(chars, i, RUN), ""))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(c, F.lit(rf"([\p{{L}}\p{{M}}&&[^\x00-\x7F]]{{{RUN},}})"), 1), of)))


def aligned_runs(valid: DataFrame, vocab: DataFrame) -> DataFrame:
    """chain, g, c: runs of characters that a restored text shares with clean tokens of at least LEAST files."""
    asked = valid.select("chain", "g", F.explode(_runs(F.col("c"))).alias("c"))
    known = vocab.filter("whole > 0").select("n", F.explode(_runs(F.col("tok"))).alias("c"))
    known = known.join(broadcast_if_small(asked.select("c").distinct()), "c", "left_semi").groupBy("c").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)
    return asked.join(known.select("c"), "c", "left_semi").select("chain", "g", "c")


def aligned(vocab: DataFrame) -> DataFrame:
    """Near-twins on stripped text: each rare token with the most frequent token of its skeleton, and the
    transformations by which their aligned runs agree."""
    top = vocab.filter("length(skel) >= 2").groupBy("skel").agg(F.max_by("tok", F.struct("n", "tok")).alias("clean"), F.max("n").alias("top_n"))
    pairs = vocab.join(top, "skel").filter(f"tok <> clean AND top_n >= {LEAST} AND top_n >= {RATIO} * n").select("tok", "clean")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rx = re.compile(r"[^\x00-\x7f]+")
        for b in batches:
            rows = []
            for g, c in zip(b.tok, b.clean):
                g = html.unescape(g)
                gr, cr = rx.findall(g), rx.findall(c)
                if len(gr) != len(cr) or rx.split(g) != rx.split(c):
                    continue
                chains = None
                for x, y in zip(gr, cr):
                    own = {chain for chain, r in hypotheses(x) if r == y}
                    chains = own if chains is None else chains & own
                rows += [(chain, x, y) for chain in chains or () for x, y in zip(gr, cr)]
            yield pd.DataFrame(rows, columns=["chain", "garbled", "clean"])

    return pairs.mapInPandas(run, "chain string, garbled string, clean string")


def _judge(cand: DataFrame, vocab: DataFrame, common: DataFrame) -> DataFrame:
    """Candidates that the corpus supports: g, chain, c, score, twin."""
    twin = vocab.select(F.col("tok").alias("c"), F.col("n").alias("c_n"))
    c = cand.join(twin, "c", "left").withColumn("multi", F.split("chain", ">")[1].isin(*MULTI))
    letters = F.regexp_replace("g", r"[^\p{L}\p{M}]", "")
    long_enough = F.when(F.col("g").rlike("[A-Za-z0-9]"), F.length("g") >= 2).otherwise(F.length(letters) >= 3)
    by_twin = F.col("c_n").isNotNull() & (F.col("c_n") >= LEAST) & (F.col("c_n") >= RATIO * F.col("n")) & (long_enough | F.col("multi"))
    c = c.withColumn("twin", F.coalesce(by_twin, F.lit(False)))
    # a restored text in an encoding of several bytes, in characters that the corpus uses
    need = c.filter("multi AND NOT twin")
    ch = need.select("g", "chain", F.explode(F.array_distinct(F.split(F.regexp_replace("c", r"[\x00-\x7F]+", ""), ""))).alias("ch")).filter("ch <> ''")
    ok = ch.join(common, "ch", "left").groupBy("g", "chain").agg(F.min(F.coalesce("ch_n", F.lit(0))).alias("least"), F.count("*").alias("kinds"))
    shorter = F.length("g") > F.length("c")
    utf8 = F.col("chain").contains(">utf_8")
    far = F.col("c").rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]{3}") & ~F.col("g").rlike(r"[\p{IsHiragana}\p{IsKatakana}]")
    from_wide = F.col("chain").rlike("^(gbk|big5|shift_jis|euc_jp|euc_kr)>")
    valid = need.join(ok, ["g", "chain"]).filter((F.col("least") >= COMMON_CHAR) & ((utf8 & ~from_wide & shorter) | (utf8 & from_wide & (F.col("kinds") >= 3)) | (~utf8 & far & (F.col("kinds") >= 4))))
    cols = ["g", "n", "chain", "c"]
    # a twin that is more frequent, but not by the ratio, only tells how widely a one-byte transformation is spread
    near = ~F.col("twin") & ~F.col("multi") & (F.length(letters) >= 3) & (F.coalesce("c_n", F.lit(0)) >= LEAST) & (F.col("c_n") > F.col("n"))
    by = c.withColumn("near", F.coalesce(near, F.lit(False))).filter("twin OR near")
    return by.select(*cols, F.col("c_n").alias("score"), "twin", "near").unionByName(valid.select(*cols, F.col("least").alias("score"), F.lit(False).alias("twin"), F.lit(False).alias("near")))


def _couples(c):
    """Pairs of neighbouring characters, word edges included, with one outside ASCII."""
    t = F.concat(F.lit(" "), c, F.lit(" "))
    return F.filter(F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2))), lambda x: x.rlike(r"[^\x00-\x7F]"))


def spread_widely(vocab: DataFrame, chains: list[str]) -> DataFrame:
    """g, chain, c, score of tokens that a widely supported one-byte transformation turns into likelier ones, whatever
    the ratio of the two: judged by the pairs of characters of the corpus."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for g in b.tok:
                for chain in chains:
                    c = undo(html.unescape(g) if "&#" in g else g, chain)
                    if c is not None and c != g and not any("\x7f" <= x <= "\x9f" or x == "\ufffd" for x in c):
                        rows.append((g, chain, re.sub("[0-9]+", "0", c)))
            yield pd.DataFrame(rows, columns=["g", "chain", "c"])

    known = vocab.filter("whole > 0").select(F.explode(_couples(F.col("tok"))).alias("two"), "whole").groupBy("two").agg(F.sum("whole").alias("two_n"))
    known = broadcast_if_small(stored(known))  # pairs of characters in use
    letters = F.length(F.regexp_replace("g", r"[^\p{L}\p{M}]", ""))
    cand = vocab.select("tok").mapInPandas(run, "g string, chain string, c string")
    cand = stored(cand.filter(F.length(F.regexp_replace("c", r"[^\p{L}]", "")) >= 3).filter((letters >= 3) | F.col("g").rlike("[A-Za-z]{2}")))

    def rated(of: str) -> DataFrame:
        e = cand.select("g", "chain", "c", F.explode(_couples(F.col(of))).alias("two")).join(known, "two", "left")
        return e.groupBy("g", "chain", "c").agg(F.avg(F.log(F.coalesce("two_n", F.lit(0)) + 1)).alias(f"like_{of}"), F.min(F.coalesce("two_n", F.lit(0))).alias(f"least_{of}"))

    r = rated("c").join(rated("g").drop("least_g"), ["g", "chain", "c"]).join(vocab.select(F.col("tok").alias("c"), F.col("n").alias("c_n")), "c", "left")
    # one accent in a word fits many languages, so a word that nowhere else occurs must be all in letters outside ASCII
    seen = F.col("c_n").isNotNull() | F.col("c").rlike(r"\A\p{IsCyrillic}{4,}\z|\A\p{IsGreek}{4,}\z")
    return r.filter((F.col("least_c") >= COMMON_CHAR) & (F.col("like_c") - F.col("like_g") >= F.log(F.lit(LIKELIER))) & seen).select("g", "chain", "c", F.coalesce("c_n", F.lit(0)).alias("score"))


def learn(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The files' tokens, the learned transformations (chain, support), the garbled tokens (g, chain, c), and those that only
    a transformation without support would restore."""
    toks = stored(file_tokens(texts))
    vocab = stored(vocabulary(toks))
    common = vocab.select(F.explode(F.array_distinct(F.split(F.regexp_replace("tok", r"[\x00-\x7F]+", ""), ""))).alias("ch"), "whole").filter("ch <> ''").groupBy("ch").agg(F.sum("whole").alias("ch_n"))
    pairs = aligned(vocab)
    multi = F.split("chain", ">")[1].isin(*MULTI)
    # trials are made once and read several times
    common = broadcast_if_small(stored(common))  # characters in use
    evidence = stored(_judge(stored(candidates(vocab.filter(F.col("tok").rlike(r"[^\x00-\x7F]|&#")))), vocab, common))
    judged = evidence.filter("NOT near").drop("near")
    # at most as many rows as there are pairs of encodings
    wide = evidence.filter((F.col("twin") | F.col("near")) & ~multi).groupBy("chain").agg(F.count_distinct("g").alias("s")).filter(F.col("s") >= WIDE_SUPPORT)
    wide_s = {r.chain: r.s for r in wide.collect()}
    # a pair is a garbled token and its clean twin: of one skeleton, or, where stripping leaves no letter, the known token
    # that the transformation itself yields; tokens that only look right after a transformation are no evidence for it
    support = (
        pairs.select("chain", F.col("garbled").alias("g"), F.col("clean").alias("c"))
        .unionByName(judged.filter("twin").filter(~F.col("g").rlike("[A-Za-z]")).select("chain", "g", "c"))
        .unionByName(aligned_runs(judged.filter("NOT twin"), vocab))
        .distinct().groupBy("chain").agg(F.count("*").alias("support"))
    )
    learned = support.filter(F.col("support") >= MIN_SUPPORT)
    hits = judged.join(learned, "chain").select("g", "chain", "c", "twin", "score", "support")
    if wide_s:
        # support of this kind holds for tokens judged by pairs of characters only
        by_wide = texts.sparkSession.createDataFrame(list(wide_s.items()), "chain string, support bigint")
        found = spread_widely(vocab, sorted(wide_s)).join(hits.select("g").distinct(), "g", "left_anti")
        hits = hits.unionByName(found.join(F.broadcast(by_wide), "chain").withColumn("twin", F.lit(False)))
        learned = learned.unionByName(by_wide).groupBy("chain").agg(F.max("support").alias("support"))
    # the one-byte readings of a token that more tokens share come first
    g = hits.groupBy("g").agg(F.max_by(F.struct("chain", "c"), F.struct("twin", "score", "support", "chain")).alias("best"))
    undecided = judged.select("g", "chain", "c").join(learned, "chain", "left_anti").join(g.select("g"), "g", "left_anti")
    return toks, learned, g.select("g", "best.chain", "best.c"), undecided


def garbled_files(texts: DataFrame) -> DataFrame:
    """file_id of files with a garbled token or a trace that can't be restored."""
    toks, _, g, _ = learn(texts)
    # a token of one or two letters alone proves little: it takes a second one in the file
    letters = F.length(F.regexp_replace("c", r"[^\p{L}]", ""))
    strong = F.split("chain", ">")[1].isin(*MULTI) | (letters >= 3) | F.col("c").rlike(r"^0[–—−-]0$|[“”‘’«»„]\p{L}{2}|\p{L}{2}[.!?,]?[“”‘’«»„]")
    hits = toks.join(g.select(F.col("g").alias("tok"), strong.cast("int").alias("strong")), "tok")
    restored = hits.groupBy("file_id").agg(F.max("strong").alias("s"), F.count("*").alias("k")).filter("s = 1 OR k >= 2").select("file_id")
    broken = texts.filter(F.col("text").rlike(BROKEN)).select("file_id")
    return restored.unionByName(broken).distinct()


def restored_texts(texts: DataFrame) -> DataFrame:
    """file_id, restored, chains, complete: garbled files with the original text as far as it can be had.

    In each sentence that holds a garbled token, the transformation of most of its garbled tokens is
    applied to all tokens that it can decode.
    """
    toks, _, g, _ = learn(texts)
    per = toks.join(g.withColumnRenamed("g", "tok"), "tok").groupBy("file_id").agg(F.collect_set(F.struct("tok", "chain")).alias("found"))
    broken = F.col("text").rlike(BROKEN)
    t = texts.filter("text IS NOT NULL").withColumn("h", text_hash("text")).dropDuplicates(["file_id", "h"]).join(per, "file_id", "left").filter(F.col("found").isNotNull() | broken)

    def keys_of(p: str) -> Iterator[str]:
        if not re.search(f"[{WIDE_PY}]", p):
            return
        mask = lambda x: x if "&#" in x else re.sub("[0-9]+", "0", re.sub(EDGE, "", x))
        for x in re.findall(f"[^{WIDE_PY}]+", p):
            yield mask(x)
            yield mask(x.strip(QUOTE_EDGE))
        for x in re.findall(f"[{WIDE_PY}\x00-\x7f]+", p):
            for y in re.findall(f"[^{SENTENCE_END}]+[{SENTENCE_END}]*", x):
                yield mask(y)

    def fix(text: str, chain_of: dict[str, str]) -> str:
        out = []
        for part in re.split(r"((?<=[.!?。！？])\s+|\n+)", text):
            marks: dict[str, int] = {}
            pieces = re.split(r"(\s+)", part)
            for p in pieces:
                key = p if "&#" in p else re.sub("[0-9]+", "0", re.sub(EDGE, "", p))
                if key not in chain_of:
                    key = next((k for k in keys_of(p) if k in chain_of), key)
                if key in chain_of:
                    marks[chain_of[key]] = marks.get(chain_of[key], 0) + 1
            if marks:
                chain = max(marks, key=lambda k: (marks[k], k))
                fixed = []
                for p in pieces:
                    r = undo_pieces(html.unescape(p) if "&#" in p else p, chain) if not p.isascii() or "&#" in p else None
                    fixed.append(p if r is None else r)
                part = "".join(fixed)
            out.append(part)
        return "".join(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for f, text, found in zip(b.file_id, b.text, b.found):
                chain_of = {} if found is None else {x["tok"]: x["chain"] for x in found}
                r = fix(text, chain_of)
                rows.append((f, r, ",".join(sorted(set(chain_of.values()))), not re.search("[\x80-\x84\x86-\x9f�]", r)))
            yield pd.DataFrame(rows, columns=["file_id", "restored", "chains", "complete"])

    return t.select("file_id", "text", "found").mapInPandas(run, "file_id bigint, restored string, chains string, complete boolean")


def p2_restored(spark: SparkSession, sf: str) -> DataFrame:
    return restored_texts(source_texts(spark, sf).select("file_id", "text"))


def p2_mappings(spark: SparkSession, sf: str) -> DataFrame:
    """chain, support of the learned transformations."""
    return learn(source_texts(spark, sf).select("file_id", "text"))[1]


def p2_undecided(spark: SparkSession, sf: str) -> DataFrame:
    """token, chain, restored: what a transformation would make of a token, but no aligned pair supports it."""
    return learn(source_texts(spark, sf).select("file_id", "text"))[3].select(F.col("g").alias("token"), "chain", F.col("c").alias("restored")).distinct()


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """file_id of source files with text garbled by a wrong decoding."""
    return garbled_files(source_texts(spark, sf).select("file_id", "text"))
