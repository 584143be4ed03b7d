"""Files, encodings, RTF, options, streams and the whole run."""

import pytest
from pyspark.sql import functions as F

from sentline.options import Options, parse_arguments, parse_option_lines
from sentline.plans.pipeline import run, run_files, run_text
from sentline.sources import readers as R
from sentline.sources import rtf, sinks
from sentline.streaming import stream

U = "\\" + "u"


@pytest.mark.parametrize(
    "data, want",
    [("ä b".encode("utf-8"), "ä b"), (b"\xef\xbb\xbfx", "x"), (b"\xff\xfe" + "ä€".encode("utf-16-le"), "ä€"), (b"\xfe\xff" + "ä€".encode("utf-16-be"), "ä€"), (b"\xe4b", "äb"), (b"abc", "abc"), (b"", ""), (b"\xff\xfea\x00b", "a")],
)
def test_decode(spark, data, want):
    assert spark.createDataFrame([(bytearray(data),)], "c binary").select(R.decoded(F.col("c")).alias("t")).first().t == want


def test_encode_round_trip(spark):
    df = spark.createDataFrame([("ä€\U0001f64f\nx",)], "t string")
    assert bytes(df.select(sinks.encoded(F.col("t"), "utf-16").alias("c")).first().c) == b"\xff\xfe" + "ä€\U0001f64f\r\nx".encode("utf-16-le")
    assert bytes(df.select(sinks.encoded(F.col("t"), "iso-8859-1").alias("c")).first().c) == b"\xe4??\nx"


def test_list(spark):
    df = spark.createDataFrame([("etc.\n hr.\r\n\nlast",)], "t string")
    assert [tuple(r) for r in df.select(R.list_entries(F.col("t")).alias("e")).first().e] == [("etc.", False), ("hr.", True)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("{\\rtf1 " + U + "55357 " + U + "56911 }", "\U0001f64f"), ("{\\rtf1 " + U + "55357" + U + "56911}", "\U0001f64f"), ("{\\rtf1 a\\par b\\line c}", "a\n\nb\nc"), ("{\\rtf1{\\fonttbl{\\f0 Roman;}}x}", "x"),
        ("{\\rtf1{\\*\\generator z}x\\{y\\}}", "x{y}"), ("{\\rtf1\\ansicpg1251 \\'cf\\'f0}", "Пр"), ("{\\rtf1\\uc2 " + U + "228??x}", "äx"), ("plain", "plain"), (None, None), ("", ""), ("{\\rtf1", ""),
        ("{\\rtf1{\\fonttbl{\\f1\\fcharset161 Greek;}}\\f1 \\'e1}", "α"),
        ("{\\rtf1 {\\b Head}\\line Text\\line more}", "Head\n\nText\nmore"), ("{\\rtf1 \\b\\fs36 Head\\pard\\line Text}", "Head\n\nText"), ("{\\rtf1 \\b A\\line B}", "A\nB"),
        ("{\\rtf1 {\\field{\\*\\fldinst HYP}{\\fldrslt Link}}\\line next\\line x}", "Link\n\nnext\nx"), ("{\\rtf1 see {\\field{\\*\\fldinst HYP}{\\fldrslt Link}}\\line next}", "see Link\nnext"),
        ("{\\rtf1 a\\bin5 {{}}xb}", "ab"),
    ],
)
def test_rtf(text, want):
    assert rtf.parse(text) == want


def test_read_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Grüße.\n".encode("iso-8859-1"))
    (tmp_path / "b.rtf").write_bytes(b"{\\rtf1 One.\\par Two.}")
    got = {r.path.rsplit("/", 1)[-1]: r.text for r in R.read_texts(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "Grüße.\n", "b.rtf": "One.\n\nTwo."}


def test_options():
    o = parse_option_lines(["; all", '-B ">" ; mark', "-t", "-A", "-D"])
    assert (o.bullet_mode, o.bullet_char, o.tokenize, o.ascii_fold, o.token_split) == ("replace", ">", True, True, "\x7f")
    assert parse_option_lines(["-t", "-t-"]).tokenize is False
    for bad in ("-q", "-B", "-t x", "word"):
        with pytest.raises(ValueError):
            parse_option_lines([bad])
    assert parse_arguments(["--tokenize", "--noise-limit", "0.5"]) == Options(tokenize=True, noise_limit=0.5)


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_split_character_can_be_undone(spark):
    df = docs(spark, "He said (why?) it isn't 100%. Next one.", "a, b; c")
    marked = run(df, options=Options(tokenize=True, token_split="\x7f")).orderBy("doc_id", "sent_no").collect()
    plain = run(df).orderBy("doc_id", "sent_no").collect()
    assert [r.sentence.replace("\x7f", "") for r in marked] == [r.sentence.replace(" ", "") for r in plain]


def test_run_text(spark):
    df = docs(spark, "Title\n\nOne two-\nthree. Four", "{\\rtf1 A.\\par B.}", None, "")
    got = {r.doc_id: r.text for r in run_text(df, options=Options(blank_at_paragraph_end=True)).collect()}
    assert got == {0: "Title\n\nOne twothree.\nFour\n", 1: "A.\n\nB.\n", 2: None, 3: ""}
    more = run_text(docs(spark, "A\r\nb. C"), options=Options(keep_eol=True, trailing_space=True)).first().text
    assert more == "A b. \r\nC \r\n"


def test_stream_equals_batch(spark, tmp_path):
    df = docs(spark, "One. Two.", "Three? Four", None)
    df.write.parquet(str(tmp_path / "in"))
    s = stream.sentence_stream(stream.text_stream(spark, str(tmp_path / "in"), df.schema))
    seen = []
    q = stream.write_batches(s, lambda b, n: seen.extend(tuple(r) for r in b.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(seen) == sorted(tuple(r) for r in run(df).collect())


def test_write_lines(spark, tmp_path):
    sinks.write_lines(run(docs(spark, "One. Two.")), "doc_id", str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["One.", "Two."]


def lines_of(df):
    return [r.sentence for r in df.orderBy("doc_id", "sent_no").collect()]


def test_tags_pass_whole(spark):
    df = docs(spark, 'One <a href="x. y; z">two. Three</a> four.</b> Five--six.', "No tag < 5. And > 3")
    assert lines_of(run(df, options=Options(markup="html"))) == ['One <a href="x. y; z">two.', "Three</a> four.</b>", "Five -- six.", "No tag < 5.", "And > 3"]
    toks = lines_of(run(df, options=Options(markup="html", tokenize=True)))
    assert toks[:3] == ['One <a href="x. y; z"> two .', "Three </a> four .", "</b> Five -- six ."]
    gone = lines_of(run(df, options=Options(suppress_markup=True)))
    assert gone[:3] == ["One two.", "Three four.", "Five -- six."]


def test_xml_mode(spark):
    df = docs(spark, "A <!-- no. B> end. --> c. <![CDATA[x. Y]]> D")
    assert lines_of(run(df, options=Options(markup="xml"))) == ["A <!-- no. B> end. --> c.", "<![CDATA[x. Y]]> D"]


def test_phrases_and_dictionary_in_the_run(spark):
    ph = spark.createDataFrame([("New York",), ("New York City",)], "phrase string")
    ab = spark.createDataFrame([("approx.", False)], "abbr string, expect_cap boolean")
    df = docs(spark, "In New York City, approx. Five. New Yorkers in New York.")
    assert lines_of(run(df, options=Options(tokenize=True), abbreviations=ab, phrases=ph)) == ["In New_York_City , approx. Five .", "New Yorkers in New_York ."]


def test_c1_characters_fold_in_rtf_only(spark):
    df = docs(spark, "a\x93b\x94", "{\\rtf1 a" + U + "147?b}")
    assert lines_of(run(df, options=Options(ascii_fold=True))) == ["a\x93b\x94", 'a"b']


def test_command_line(spark, tmp_path):
    o = parse_arguments(["-t", "/B", ">", "-a", "abbr.lst", "-m", "mwu.lst", "--", "-in.txt"])
    assert (o.tokenize, o.bullet_char, o.bullet_mode, o.abbreviation_file, o.phrase_file, o.input_path) == (True, ">", "replace", "abbr.lst", "mwu.lst", "-in.txt")
    assert parse_arguments(["-w-", "text.txt"]) == Options(unwrap_words=False, input_path="text.txt")
    assert parse_arguments(["--no-unwrap-words", "--markup=xml"]) == Options(unwrap_words=False, markup="xml")
    for bad in (["-q"], ["-B"], ["--nothing"], ["-t", "-a"]):
        with pytest.raises(ValueError):
            parse_arguments(bad)
    (tmp_path / "a.txt").write_text("See approx. Five in New York.\n")
    (tmp_path / "ab.lst").write_text("approx.\n")
    (tmp_path / "mw.lst").write_text("New York\n")
    o = parse_arguments(["-a", str(tmp_path / "ab.lst"), "-m", str(tmp_path / "mw.lst"), "-t", str(tmp_path / "a.txt")])
    assert run_files(spark, o).first().text == "See approx. Five in New_York .\n"


def test_no_checkpoint_folder_of_one_machine_on_a_cluster(spark, monkeypatch):
    from sentline import session

    class Context:
        master = "spark://host:7077"
        getConf = lambda self: {}

        class _jsc:  # noqa: N801
            sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = {}

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Session())


def test_stored_and_measured(spark):
    from sentline import session

    df = spark.range(100).selectExpr("id", "cast(null as string) AS s")
    assert sorted(session.stored(df).collect()) == sorted(df.collect())
    assert session.measured_bytes(df) < 2000 < session.measured_bytes(spark.range(5000))
    assert session.measured_bytes(df.filter("id < 0")) == 0
