"""Golden cases of the segmentation rules."""

import pytest
from pyspark.sql import functions as F

from sentline.functions import text as T
from sentline.operators import dictionaries as D
from sentline.operators import lines as L
from sentline.operators import markup as M
from sentline.operators import segment as S

SENTENCES = [
    ("Hello, world. Next.", ["Hello, world.", "Next."]),
    ("in 1999. Next month", ["in 1999.", "Next month"]),
    ("Skema 1. Affald fra husholdninger", ["Skema 1.", "Affald fra husholdninger"]),
    ("den 3. juni", ["den 3. juni"]),
    ("costs 3.4. Then", ["costs 3.4.", "Then"]),
    ("by J. Smith", ["by J. Smith"]),
    ("e.g. This", ["e.g. This"]),
    ("on www.a.b. Then", ["on www.a.b. Then"]),
    ("(Ref. Smith)", ["(Ref. Smith)"]),
    ('"Yes. Then', ['"Yes. Then']),
    ("etc. Next", ["etc.", "Next"]),
    ('he said "stop." Then', ['he said "stop." Then']),
    ("a; b", ["a;", "b"]),
    ("a: b", ["a: b"]),
    ("Wait... Now", ["Wait...", "Now"]),
    ("end . Next", ["end .", "Next"]),
    ("R&lt; C", ["R&lt; C"]),
    ("line one\nline two", ["line one line two"]),
    ("Title\n\nBody.", ["Title", "Body."]),
    ("One.\tTwo?  Three!\nFour", ["One.", "Two?", "Three!", "Four"]),
    ("E0ff \ue0ff stays. So", ["E0ff \ue0ff stays.", "So"]),
    ("in 1999.", ["in 1999."]),
    ("", []),
    (None, []),
    (" \n\n \t\n", []),
]


def sentences(spark, cases, dictionary=None):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id bigint, text string")
    out = {}
    for r in S.sentences(df, "doc_id", dictionary).orderBy("doc_id", "sent_no").collect():
        out.setdefault(r.doc_id, []).append(r.sentence)
    return [out.get(i, []) for i in range(len(cases))]


def test_sentences(spark):
    assert sentences(spark, [t for t, _ in SENTENCES]) == [s for _, s in SENTENCES]


@pytest.mark.parametrize("entry, text, want", [(False, "etc. Next", 1), (True, "etc. Next", 2), (True, "etc. next", 1), (False, "etc.\n\nNext", 2)])
def test_dictionary(spark, entry, text, want):
    m = S.dictionary_map(spark.createDataFrame([(" etc. ", entry, "en"), ("", True, None), (None, True, None)], "abbr string, expect_cap boolean, lang string"))
    assert len(sentences(spark, [text], m)[0]) == want


TOKENS = [
    ("Hello, world.", "Hello·,·world·."), ("(see)", "(·see·)"), ("Wait...!!", "Wait·...·!!"), ("((a", "(·(·a"), ("rock'", "rock'"), ("sort(s)", "sort(s)"), ("75%", "75·%"),
    ("http://example.org/a/", "http://example.org/a/"), ("..<mail/out.txt/", "..<mail/out.txt/"), ("R&amp;", "R&amp;"), ("&lt;", "&lt;"),
    ("e.g., this", "e.g.·,·this"), ("U.S., and", "U.S.·,·and"), ("(Ref.) x", "(·Ref.·)·x"), ("f(x,)", "f(x,)"), ("f(x')", "f(x'·)"), ("http://a.b/c/)", "http://a.b/c/·)"), ("http://a.b/c/.", "http://a.b/c/·."),
    ("end»»»", "end»·»»"), ("so……", "so·……"), ("a--b---c", "a·--·b·---·c"), ("x (1999.), y", "x·(·1999·.·)·,·y"), ("1999.,", "1999·.·,"), ("'o'", "'·o·'"), ("a)(", "a·)·("), ("in 1999. Next", "in·1999·.·Next"), ("den 3. juni", "den·3.·juni"),
]


def test_tokens(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TOKENS)], "doc_id bigint, text string")
    rows = S.tokens(df, "doc_id").orderBy("doc_id", "sent_no", "token_no").collect()
    got = ["·".join(r.token for r in rows if r.doc_id == i) for i in range(len(TOKENS))]
    assert got == [w for _, w in TOKENS]


def test_tokens_with_dictionary(spark):
    m = S.dictionary_map(spark.createDataFrame([("etc.", False), ("approx.", False), ("no.", True)], "abbr string, expect_cap boolean"))
    df = spark.createDataFrame([(1, "approx. five, etc., no. It is. No. five")], "doc_id bigint, text string")
    rows = S.tokens(df, "doc_id", dictionary=m).orderBy("sent_no", "token_no").collect()
    got = ["·".join(r.token for r in rows if r.sent_no == i) for i in range(rows[-1].sent_no + 1)]
    assert got == ["approx.·five·,·etc.·,·no.", "It·is·.", "No.·five"]


def test_contractions_of_words_beside_marks(spark):
    df = spark.createDataFrame([(1, "(don’t) cannot, a|b they’re.")], "doc_id bigint, text string")
    assert "·".join(r.token for r in S.tokens(df, "doc_id", True).orderBy("token_no").collect()) == "(·do·n't·)·can·not·,·a|b·they·'re·."


def test_tokens_keep_every_character(spark):
    texts = [t for t, _ in SENTENCES if t]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    rows = S.tokens(df, "doc_id").orderBy("doc_id", "sent_no", "token_no").collect()
    for i, t in enumerate(texts):
        assert "".join(r.token for r in rows if r.doc_id == i) == "".join(t.split())


CONTRACTIONS = {
    "don't": "do|n't", "John's": "John|'s", "I'm": "I|'m", "we'll": "we|'ll", "dogs'": "dogs|'", "cannot": "can|not", "gimme": "gim|me", "gonna": "gon|na", "gotta": "got|ta", "lemme": "lem|me", "wanna": "wan|na",
    "more'n": "more|'n", "d'ye": "d'|ye", "tis": "t|is", "twas": "t|was", "whatcha": "wha|t|cha", "whaddya": "wha|dd|ya", "CAN'T": "CA|N'T",
}


def test_contractions(spark):
    df = spark.createDataFrame([(k,) for k in CONTRACTIONS], "w string").select("w", T.contractions(F.col("w")).alias("t"))
    assert {r.w: r.t for r in df.collect()} == CONTRACTIONS


HYPHENS = {
    "ab-\nces": "abces", "AB-\nCES": "ABCES", "Da-\nvid": "David", "ab-\nCes": "ab-Ces", "AB-\nCes": "AB-Ces", "b-\nces": "b-ces", "ab-\nc x": "ab-\nc x", "ab-\nc3": "ab-\nc3",
    "ab-\nces.": "abces.", "x3-\nces": "x3-ces", "-\nces": "-ces", "ab-\n\nces": "ab-\n\nces", "ab-ces": "ab-ces", "ab- ces": "ab- ces",
}


def test_dehyphenation(spark):
    df = spark.createDataFrame([(k,) for k in HYPHENS], "w string").select("w", L.dehyphenated(F.col("w")).alias("t"))
    assert {r.w: r.t for r in df.collect()} == HYPHENS


def one(spark, fn, text):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("o")).first().o


@pytest.mark.parametrize(
    "fn, text, want",
    [
        (T.regularize_ws, "  a   b \n\n\n c ", "a b\nc"),
        (T.formfeed, "a \f\nb", "a\f\nb"),
        (T.control_chars, "a\x01b", "a*b"),
        (T.ascii_fold, "“a”–b…€5", '"a"-b...EUR5'),
        (T.ascii_fold, "Œuvre œ Ĳ ĳ ™ •", "OEuvre oe IJ ij TM *"),
        (T.split_dashes, "word--word", "word -- word"),
        (M.strip_tags, "a<b>c</b>d", "a c d"),
        (M.strip_tags, "a < 5 and b > 3", "a < 5 and b > 3"),
        (T.strip_bom, "﻿x", "x"),
    ],
)
def test_text_functions(spark, fn, text, want):
    assert one(spark, fn, text) == want


def test_white_space_is_idempotent(spark):
    t = " a \t\n\n \x0b b  c\n"
    once = one(spark, T.regularize_ws, t)
    assert one(spark, T.regularize_ws, once) == once


def test_nulls_stay_null(spark):
    for fn in (T.regularize_ws, T.ascii_fold, T.control_chars, M.strip_tags, L.dehyphenated, T.noise):
        assert one(spark, fn, None) is None


def test_phrases(spark):
    df = spark.createDataFrame([(1, "in New York . New York City ."), (2, "New Yorker"), (3, None)], "doc_id bigint, text string")
    ph = spark.createDataFrame([("New York", 2, "en"), ("New York City", 3, None), ("New York", 2, "en"), ("", 0, None), (None, None, None)], "phrase string, n_words bigint, lang string")
    rows = D.multi_word_text(df, "doc_id", ph).orderBy("doc_id", "sent_no").collect()
    assert [r.sentence for r in rows] == ["in New_York .", "New_York_City .", "New Yorker"]


def test_bullets(spark):
    df = spark.createDataFrame([(1, "- a\n- b\ntext\n* c"), (2, ""), (3, None)], "doc_id bigint, text string")
    runs = L.bullet_runs(df, "doc_id").orderBy("line_no").collect()
    assert [(r.line_no, r.in_run, r.confirmed) for r in runs] == [(0, 1, True), (1, 2, True), (3, 1, False)]
    kept = {r.doc_id: r.text for r in L.bullets_emitted(df, "doc_id", "replace", ">").collect()}
    assert kept == {1: "> a\n> b\ntext\n> c", 2: "", 3: None}


def test_control_characters_are_bullets_and_five_are_separated(spark):
    df = spark.createDataFrame([(1, "\n".join(f"\x07 b{i}" for i in range(7)))], "doc_id bigint, text string")
    assert L.bullet_lines(df, "doc_id").filter("is_bullet").count() == 7
    got = L.bullets_emitted(df, "doc_id", "drop", separate=True).first().text
    assert got == "\n".join(f"\nb{i}\n" if i < 5 else f"b{i}" for i in range(7))


def test_look_ahead(spark):
    df = spark.createDataFrame([(1, "ab  \n  \nc")], "doc_id bigint, text string")
    assert [r.ink_end for r in L.look_ahead(df, "doc_id").orderBy("line_no").collect()] == [2, 0, 1]


def test_long_text_and_extra_columns(spark):
    long = "word " * 60_000 + "end. Next."
    df = spark.createDataFrame([(1, long, "x", "y")], "doc_id bigint, text string, sentence string, para_no string")
    got = S.sentences(df, "doc_id").orderBy("sent_no").collect()
    assert [r.n_chunks for r in got] == [60_001, 1]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    for out in (S.sentences(df, "doc_id"), S.tokens(df, "doc_id"), L.lines(df, "doc_id"), M.tags(df, "doc_id"), L.bullet_runs(df, "doc_id")):
        assert out.count() == 0
