from sentline.llm import scans as L

BODY = "The old keeper carried the lantern back to the harbour before noon and\nnobody remembered the furnace that stood beside the modern pump here.\nThey drew two- and three-storey sheds and the lantern in the harbour.\nAnything oil-stained was put aside by the keeper before the storm and\n"


def text(k):
    t = f"The lantern and the harbour\n- {2 * k + 1} -\nThe lantern and the harbour\n\n{BODY}the keeper remem-\nbered the mill in {1950 + k}.\n"
    return t + f"\nTHE LANTERN AND THE HARBOUR\n- {2 * k + 2} -\n{BODY}It ended two-\nand three-storey. Then oil-\nThe lantern and the harbour\n- {2 * k + 3} -\nstained sheds stood.\n"


def frame(spark, rows):
    return spark.createDataFrame(rows, "file_id bigint, text string")


def test_defects(spark):
    rows = [(k, text(k)) for k in range(8)]
    bad = "The lantern and the harbour\n\nThe o1d keeper carricd the laiitern back to the fu-\nmace and fhe pump.\n1964\n397\nNobody here\n"
    rows += [(100, bad), (101, ""), (102, None), (0, text(0))]
    got = {}
    for r in L.defects(frame(spark, rows)).collect():
        got.setdefault(r.file_id, set()).add((r.line_no, r.defect))
    one = got[0]
    assert {(1, "header"), (2, "pageno"), (12, "header"), (13, "pageno"), (20, "header"), (21, "pageno")} <= one
    assert {n for n, d in one if d == "header"} == {1, 12, 20}
    assert {n for n, d in one if d == "hyphen"} == {9, 19}
    assert not any(d == "char" for _, d in one)
    assert got[100] == {(3, "char"), (3, "hyphen"), (4, "char")}
    assert 101 not in got and 102 not in got


def test_paragraphs(spark):
    rows = [(k, text(k)) for k in range(8)]
    got = [r.text for r in L.paragraphs(frame(spark, rows)).filter("file_id = 0").orderBy("para_no").collect()]
    assert got[0] == "The lantern and the harbour"
    assert "the keeper remembered the mill in 1950." in got[1]
    assert "two- and three-storey. Then oil-stained sheds stood." in got[-1]


def test_skeleton_groups(spark):
    from pyspark.sql import functions as F

    pairs = [("furnace", "fumace"), ("that", "tliat"), ("under", "iinder"), ("painted", "paintecl"), ("about", "@b0ut"), ("been", "6een"), ("moved", "mo\\/ed"), ("list", "lis'l'"), ("geöffnet", "ge6ffnet")]
    df = spark.createDataFrame(pairs, "a string, b string").select(L.skeleton(F.col("a")).alias("a"), L.skeleton(F.col("b")).alias("b"))
    assert all(r.a == r.b for r in df.collect())


def test_empty_table(spark):
    assert L.defects(frame(spark, [])).count() == 0


def repaired(spark, *texts):
    rows = L.paragraphs(spark.createDataFrame(list(enumerate(texts)), "file_id bigint, text string")).orderBy("file_id", "para_no").collect()
    return [r.text for r in rows if r.file_id == 0]


def test_a_misread_word_is_put_right_at_its_place_only(spark):
    body = ["here I am now, and there I am too, so I am glad."] * 12
    got = repaired(spark, "Title Of It\n\nWe learn what was learnt, warn all, and there I arn too.\nLearn it.", *body)
    assert got == ["Title Of It", "We learn what was learnt, warn all, and there I am too. Learn it."]


def test_context_speaks_for_the_word_as_written(spark):
    # 'arn' is rarer than 'am' by far, but always beside the same words, which 'am' never is
    body = ["here I am now, and there I am too, so I am glad."] * 12 + ["the river arn flows by the mill."] * 2
    got = repaired(spark, "Title Of It\n\nBoats on the river arn flows slow.", *body)
    assert got == ["Title Of It", "Boats on the river arn flows slow."]


def test_capitals_marks_and_cut_words(spark):
    body = ["the garden was open and the modern garden was large."] * 25
    got = repaired(spark, "Title Of It\n\n(Garclen!) was open and the mod-\nern GARCLEN, two-\nparted, stayed.", *body, "it is a two-parted thing")
    assert got == ["Title Of It", "(Garden!) was open and the modern GARDEN, two-parted, stayed."]


def test_clashing_and_empty(spark):
    df = spark.createDataFrame([(0, None, "x"), (1, "", "y"), (2, "\n\n", "z")], "file_id bigint, text string, line string")
    assert L.paragraphs(df).count() == 0 and L.defects(df).count() == 0
