import pytest

from sentline.llm import markup as L

MARKED = [
    ("<p>x</p>", {"html"}), ("a &nbsp; b", {"html"}), ("a <!-- c --> b", {"html"}), ("&#233;t", {"html"}),
    ("# Title", {"markdown"}), ("Title\n=====", {"markdown"}), ("a **b** c", {"markdown"}), ("a [b](http://x.y) c", {"markdown"}), ("a [b][ref-2] c", {"markdown"}), ("say `code` here", {"markdown"}), ("~~gone~~", {"markdown"}), ("| a | b |\n|---|--:|\n| 1 | 2 |", {"markdown"}), ("```\nx\n```", {"markdown"}),
    ("== Title ==", {"wiki"}), ("a [[Page|b]] c", {"wiki"}), ("the ''room'' is", {"wiki"}), ("x {{note|1}} y", {"wiki"}), ("{| class=\"x\"\n|-\n| a || b\n|}", {"wiki"}), ("# [[One]]\n# [[Two]]", {"wiki"}),
    ("a \\emph{b} c", {"latex"}), ("open \\emph{b c", {"latex"}), ("\\begin{itemize}", {"latex"}), ("$x_{1}^2$", {"latex"}), ("{\\bf b}", {"latex"}), ("a & 1 & 2 \\\\", {"latex"}),
    ("<b>x</b> and **y**", {"html", "markdown"}),
]
PLAIN = [
    "- a\n- b", "1. One\n2. Two", "    total[k] += step_size", "    while (on && level >= 3) {\n        level--;\n    }", "The limit is a < 5 and b > 3 for all.", "Item #12 costs $5, item #14 costs $7 * 2.", "5 * 3 * 2 = 30, and 2 ** 3 is not.",
    "Use C:\\feed\\new or A&B.", "See note [7] of a_b_c.txt.", "Rows 1 | 2 | 3 were sold - row 4 was not.", "End ------", "~30 pieces, see (a) and {b}.", "He wrote 'as is' and \"by hand\"", "The * after a name marks a note.", "a\t1\t2", "", "x",
]


@pytest.fixture(scope="module")
def found(spark):
    texts = [t for t, _ in MARKED] + PLAIN + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "file_id bigint, text string")
    out = {}
    for r in L.marked_blocks(df, ("file_id",)).collect():
        out.setdefault(r.file_id, set()).update(r.notations)
    return [out.get(i, set()) for i in range(len(texts))]


@pytest.mark.parametrize("i", range(len(MARKED)), ids=[repr(t)[:30] for t, _ in MARKED])
def test_marked(found, i):
    assert found[i] == MARKED[i][1]


@pytest.mark.parametrize("i", range(len(PLAIN)), ids=[repr(t)[:30] for t in PLAIN])
def test_plain(found, i):
    assert found[len(MARKED) + i] == set()


def test_clean(spark):
    texts = [
        (1, "<h1>Head</h1>\n<p>One <b>two</b> &amp; &#233;.</p>\n\n<ul><li>a</li><li>b</li></ul>\n\n<pre><code>x = 1</code></pre>"),
        (2, "# Head\n\nOne **two** [three](http://x.y) `four`.\n\n| a | b |\n|---|---|\n| 1 | 2 |"),
        (3, "== Head ==\n\n'''One''' [[Page|two]]{{note|1}}.\n\n* [[a]]\n* b\n\n: ''x''"),
        (4, "\\section{Head}\n\nOne \\emph{two}~\\cite{r}.\n\n\\begin{itemize}\n  \\item a\n\\end{itemize}\n\n\\[ x^{2} \\]"),
        (5, "Plain - text."),
    ]
    got = {r.file_id: (r.clean, r.markup) for r in L.clean_documents(spark.createDataFrame(texts, "file_id bigint, text string"), ("file_id",)).collect()}
    assert got[1] == ("# Head\n\nOne two & é.\n\n- a\n\n- b\n\n```\nx = 1\n```", "html")
    assert got[2] == ("# Head\n\nOne two three four.\n\na\tb\n1\t2", "markdown")
    assert got[3][0].split("\n\n") == ["# Head", "One two.", "- a\n- b", "$ x $"]
    assert got[4][0].split("\n\n") == ["# Head", "One two .", "- a", "$ x^{2} $"]
    assert got[5] == ("Plain - text.", "")


def test_second_pass_takes_the_neighbours_label(spark):
    df = spark.createDataFrame([(1, "[[A|b]] and {{c}}\n\n# one\n# two\n\nshort"), (2, "**a** text\n\n| x | y |")], "file_id bigint, text string")
    got = {}
    for r in L.marked_blocks(df, ("file_id",)).collect():
        got.setdefault(r.file_id, {})[r.block_no] = set(r.notations)
    assert got[1][1] == {"wiki"} and got[2][1] == {"markdown"}


CLEAN = [
    ("```python\ndef __init__(self):\n    return *b* or ~~y~~\n\n    # a comment & <b>\n```", "```\ndef __init__(self):\n    return *b* or ~~y~~\n\n    # a comment & <b>\n```"),
    ("<pre>if (a &lt; b)\n\n  x ** y;</pre>", "```\nif (a < b)\n\n  x ** y;\n```"),
    ("\\begin{verbatim}\n\\emph{x} & y\n\n_z_\n\\end{verbatim}", "```\n\\emph{x} & y\n\n_z_\n```"),
    ("{{code}}\n[[a]] \'\'b\'\'\n{{endcode}}", "```\n[[a]] \'\'b\'\'\n```"),
    ("See [[One|one]].\n: another remark\n: ''E'' = ''mc''", "See one.\nanother remark\n$ E = mc $"),
    ("<p>&Delta; &Iacute; &zeta; &nosuch; &#916;</p>", "Δ Í ζ &nosuch; Δ"),
    ("Use `a*b*c` and **bold** with $x_{1}^2 * y_{2}$ here.", "Use a*b*c and bold with $x_{1}^2 * y_{2}$ here."),
    ("\\[\n a_{1} \\cdot b\n\\]", "$ a_{1} \\cdot b $"),
    ("a **" + "very long word " * 40 + "end** b", "a " + "very long word " * 40 + "end b"),
    ("a ''" + "very long word " * 40 + "end'' and [[" + "Page " * 80 + "x]] b", "a " + "very long word " * 40 + "end and " + "Page " * 80 + "x b"),
]


def test_clean_keeps_code_formulas_and_long_spans(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CLEAN)], "file_id bigint, text string")
    got = {r.file_id: r.clean for r in L.clean_documents(df, ("file_id",)).collect()}
    assert [got[i] for i in range(len(CLEAN))] == [w for _, w in CLEAN]


def notations(spark, text, stop=None):
    df = spark.createDataFrame([(1, text)], "file_id bigint, text string")
    return {r.block_no: set(r.notations) for r in L.marked_blocks(df, ("file_id",), stop).collect()}


PRODUCTS = "q1 *r2 k3* t4 b5 v6 w7 x8 f9 z0 " * 6  # long, without a stop word: no running text
PROSE = "the lamp of the house is in the hall and it is *not* for the guests of the house, as they have the one that was in the room of the old man before " * 2


def test_first_pass_decides_what_ambiguous_marks_are(spark):
    assert notations(spark, PROSE) == {0: {"markdown"}}
    assert notations(spark, PRODUCTS) == {0: set()}
    # without stop words nothing tells the two apart
    assert notations(spark, PROSE, []) == {0: set()}


def test_second_pass_hands_labels_to_short_and_ambiguous_blocks(spark):
    assert notations(spark, PRODUCTS + "\n\na *b* c") == {0: set(), 1: set()}
    assert notations(spark, PROSE + "\n\na *b* c") == {0: {"markdown"}, 1: {"markdown"}}
    assert notations(spark, "see **this** one\n\n" + PRODUCTS) == {0: {"markdown"}, 1: {"markdown"}}


def test_link_density_makes_boilerplate(spark):
    text = "[Home](/a) [News](/b) [About](/c)\n\nshort\n\n" + PROSE
    df = spark.createDataFrame([(1, text)], "file_id bigint, text string")
    assert [r.final_quality for r in L.marked_blocks(df, ("file_id",)).orderBy("block_no").collect()] == ["bad", "bad", "good"]
    assert L.clean_documents(df, ("file_id",)).first().n_boilerplate == 2
