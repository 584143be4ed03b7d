import random

from sentline.llm import quality as L

PROSE = "The invention relates to a device in which the housing is connected to the rotor. It is an object of the invention to keep the cost low. In one embodiment, the wall has a thickness of 3 mm and the rotor is made of steel."


def corpus():
    rnd = random.Random(5)
    rows = [(k, PROSE + f" The pump number {k} was tested by the keeper of the mill, and it is not known why.", "en") for k in range(80)]
    kinds = {
        200: ("table", "sample\tc0/mm\tc1/K\n" + "\n".join(f"A{i}\t{rnd.random() * 90:.2f}\t{rnd.randrange(900)}" for i in range(20))),
        201: ("table", "\n".join(f"No {i} | {rnd.randrange(90)} |  | n/a | 3.5" for i in range(12))),
        202: ("list", "LIST OF REFERENCE NUMERALS\n" + "\n".join(f"{i} drive shaft" for i in range(10, 40, 2))),
        203: ("list", "\n".join(f"[{i}] Velquist, A., Battery modules 19{i + 50}" for i in range(1, 20))),
        204: ("list", "; ".join(f"J{i} pressure chamber" for i in range(100, 130))),
        205: ("junk", " ".join(["next"] * 60)),
        206: ("junk", "\n".join("".join(rnd.choice("abcXYZ0189+/") for _ in range(76)) for _ in range(8))),
        207: ("junk", "\n".join(f" {60 * i} " + " ".join("".join(rnd.choice("acgt") for _ in range(10)) for _ in range(6)) for i in range(1, 9))),
        208: ("junk", "".join(rnd.choice("%&{}[]<>|~^*+=#@! ") for _ in range(400))),
    }
    rows += [(k, t, "en") for k, (_, t) in kinds.items()] + [(300, None, "en"), (301, "", None), (302, PROSE + "\n10 rotor\n12 housing", "EN")]
    return rows, {k: v for k, (v, _) in kinds.items()}


def test_kinds(spark):
    rows, want = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    g = L.graded(df)
    assert {r.doc_id: r.kind for r in g.filter("kind <> 'prose'").collect()} == want


def test_statistics(spark):
    df = spark.createDataFrame([("One two, three.\nFour: % five",)], "text string")
    r = L.text_statistics(df).first()
    assert (r.word_count, r.line_count) == (6, 2)
    assert r.mean_word_len == 23 / 6 and r.punct_line_ratio == 0.5 and r.symbol_ratio == 1 / 23


def own_words(k, n):
    """n words that no other document holds."""
    letters = lambda x: "".join(chr(97 + int(d)) for d in str(x))
    return " ".join(f"z{letters(k)}y{letters(j)}" for j in range(n))


def test_percentiles_follow_the_exact_rank(spark):
    rows = [(i, "the " * i + own_words(i, 100 - i), "en") for i in range(1, 100)]
    g = L.graded(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).select("doc_id", "pct_common_ratio").collect()
    assert all(abs(r.pct_common_ratio - r.doc_id / 99) < 0.05 for r in g)


def test_common_words_are_those_of_half_the_documents(spark):
    rows = [(i, ("La ruota gira. " if i % 3 else "Ruota e vento. ") + own_words(i, 3), "it") for i in range(10)]
    assert L.common_words(spark.createDataFrame(rows, "doc_id bigint, text string, language string")) == ["la", "ruota"]


def test_mixed_scripts_count_ideographs(spark):
    # twelve ideographs among blanks and digits, the only letters: two bytes a character at most on the whole
    t = "的是在和了有不一之其所以 1234567890 12345678 "
    r = L.text_statistics(spark.createDataFrame([(t * 40,)], "text string")).first()
    assert r.common_ratio == 1.0 and r.unique_ratio == 0.5 and r.variety_log is None


def test_kinds_hang_on_the_sketches(spark):
    """In a language whose prose is full of numbered lines, a document with as many is no list; alone it is one."""
    numbered = lambda k, n: "\n".join([f"{j} the pump {own_words(k, 2)} of it" for j in range(n)] + ["It is the end of the story."] * (10 - n))
    usual = [(k, numbered(k, 5 + k % 3), "xx") for k in range(120)]
    plain = [(1000 + k, PROSE + f" Number {k}.", "en") for k in range(120)]
    of = lambda rows: {r.doc_id: r.kind for r in L.graded(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).filter("doc_id = 900").collect()}
    assert of([*usual, *plain, (900, numbered(900, 8), "xx")]) == {900: "prose"}
    assert of([*plain, (900, numbered(900, 8), "en")]) == {900: "list"}


def test_null_and_empty_texts_keep_their_rows(spark):
    rows, _ = corpus()
    g = L.graded(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert [(r.doc_id, r.word_count, r.kind) for r in g.filter("doc_id IN (300, 301)").orderBy("doc_id").collect()] == [(300, None, None), (301, None, None)]


def test_long_items_are_items(spark):
    long = "\n".join(f"({k}) " + f"a wheel {own_words(k, 60)}" for k in range(12))
    rows = [(k, PROSE, "en") for k in range(60)] + [(900, long, "en")]
    g = L.graded(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert {r.doc_id: r.kind for r in g.filter("kind <> 'prose'").collect()} == {900: "list"}


def test_empty_table(spark):
    assert L.graded(spark.createDataFrame([], "doc_id bigint, text string, lang string")).count() == 0


def test_a_third_of_a_language_is_no_prose(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("bcdfghklmnprstvz") for _ in range(rnd.randrange(3, 9)))
    forms = {
        "list": lambda: "\n".join(f"{i} drive {word()} with the {word()}" for i in range(10, 40, 2)),
        "table": lambda: "\n".join(f"No {i} | {rnd.randrange(90)} | {rnd.randrange(9)} | n/a | 3.5" for i in range(12)),
        "junk": lambda: "\n".join(" ".join(word() for _ in range(8)) for _ in range(6)),
    }
    rows, want = [], {}
    for lang, (kind, text) in zip(("en", "de", "fr"), forms.items()):
        for k in range(120):
            n = len(rows)
            if k % 3 == 0:
                want[n] = kind
            rows.append((n, text() if k % 3 == 0 else PROSE + f" The pump number {k} was tested by the keeper of the mill.", lang))
    g = L.graded(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert {r.doc_id: r.kind for r in g.filter("kind <> 'prose'").collect()} == want


def test_language_of_one_document(spark):
    rows, kinds = corpus()
    alone = {"it": 202, "nl": 201, "sv": 206, "pl": 205}
    texts = {k: t for k, t, _ in rows}
    more = [(400 + i, texts[k], lang) for i, (lang, k) in enumerate(alone.items())] + [(410, PROSE, "cs")]
    g = L.graded(spark.createDataFrame(rows + more, "doc_id bigint, text string, lang string"))
    got = {r.doc_id: r.kind for r in g.filter("doc_id >= 400").collect()}
    assert got == {400 + i: kinds[k] for i, k in enumerate(alone.values())} | {410: "prose"}
