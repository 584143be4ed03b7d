import pytest

from sentline.llm import sentences as L

ABBR = [("etc.", True, "en"), ("Fig.", False, "en"), ("approx.", False, "en"), ("approx.", True, None), ("z. B.", False, "de"), ("ул.", False, "ru"), ("Nr.", None, None), (None, None, None), (" ", True, "en")]
CASES = [
    ("He came. She left.", ["He came.", "She left."]),
    ("See Fig. 3 and approx. Ten.", ["See Fig. 3 and approx. Ten."]),
    ("Pumps, etc. Then more.", ["Pumps, etc.", "Then more."]),
    ("Pumps, etc. and more.", ["Pumps, etc. and more."]),
    ("It ended at 11 a.m. The end.", ["It ended at 11 a.m.", "The end."]),
    ("By F. V. Lind in 3.5 parts.", ["By F. V. Lind in 3.5 parts."]),
    ("“Stop!” he said. ‘Is it?’ asked she.", ["“Stop!” he said.", "‘Is it?’ asked she."]),
    ('He said: "It is. Now go." Then he went.', ['He said: "It is. Now go."', "Then he went."]),
    ("The man (who was cold. and ill) left. Next.", ["The man (who was cold. and ill) left.", "Next."]),
    ("Am 5. Juni war z. B. Karl da. Ende.", ["Am 5. Juni war z. B. Karl da.", "Ende."]),
    ("»Wo?« fragte er. »Hier.« Er ging.", ["»Wo?« fragte er.", "»Hier.«", "Er ging."]),
    ("« Où ? » demanda-t-il. « Ici ! » Il part.", ["« Où ? » demanda-t-il.", "« Ici ! »", "Il part."]),
    ("Адрес: ул. Вязовая. Дом.", ["Адрес: ул. Вязовая.", "Дом."]),
    ("他说：“坏了！快去。”没有人知道……后来。“哪里？”他问。完", ["他说：“坏了！快去。”", "没有人知道……后来。", "“哪里？”他问。", "完"]),
    ("彼は「壊れた。来て。」と言いました。型（港。予備）です。", ["彼は「壊れた。来て。」と言いました。", "型（港。予備）です。"]),
    ("यह है। डॉ. राम आए? हाँ।", ["यह है।", "डॉ. राम आए?", "हाँ।"]),
    ("قال د. سالم نعم. «أين؟» سأل الكاتب. انتهى.", ["قال د. سالم نعم.", "«أين؟» سأل الكاتب.", "انتهى."]),
    ("ช่างไม้ซ่อม ดร. Ruv ซ่อมแล้ว คนสวน", ["ช่างไม้ซ่อม", "ดร. Ruv ซ่อมแล้ว", "คนสวน"]),
    ("Πού είναι; Εδώ.", ["Πού είναι;", "Εδώ."]),
    ("one; two. Three", ["one; two.", "Three"]),
    ("Title\n\nA line\nbroken here. Next\n \nLast", ["Title", "A line\nbroken here.", "Next", "Last"]),
    ("Tokenised z . B . Text , Nr . 5 . Ende .", ["Tokenised z . B . Text , Nr . 5 .", "Ende ."]),
    ("Who ... and why?! Well ... yes.", ["Who ... and why?!", "Well ... yes."]),
    ("S‍ee Fi­g. 3. Ne​xt.", ["S‍ee Fi­g. 3.", "Ne​xt."]),
    ("", []), (None, []), (" \n\n ", []), ("\ue0ff It. Be", ["\ue0ff It.", "Be"]),
]


@pytest.fixture(scope="module")
def units(spark):
    entries = L.dictionary(spark.createDataFrame(ABBR, "abbr string, expect_cap boolean, lang string"))
    df = spark.createDataFrame([(i, t, 1) for i, (t, _) in enumerate(CASES)], "id bigint, text string, unit int")
    return L.sentence_units(df, entries, ("id",)).orderBy("id", "start_pos").collect()


@pytest.mark.parametrize("i", range(len(CASES)), ids=[repr(t)[:30] for t, _ in CASES])
def test_units(units, i):
    text, want = CASES[i]
    mine = [r for r in units if r.id == i]
    assert [text[r.start_pos : r.end_pos] for r in mine] == want
    assert [r.unit for r in mine] == want


def test_long_text(spark):
    text = "This is one. " * 5000
    df = spark.createDataFrame([(1, text)], "id bigint, text string")
    assert L.sentence_units(df, [], ("id",)).count() == 5000


def test_dictionary_of_nothing(spark):
    assert L.dictionary(spark.createDataFrame([], "abbr string, expect_cap boolean, lang string")) == sorted(L.EXTRA_ABBREVIATIONS)


def cut_up(spark, text):
    df = spark.createDataFrame([(1, text)], "id bigint, text string")
    rows = L.sentence_units(df, ["Dr."], ("id",)).orderBy("start_pos").collect()
    assert all(r.unit == text[r.start_pos : r.end_pos] for r in rows)
    return [r.unit for r in rows]


def test_quotation_and_bracket_of_any_length(spark):
    said = "One more thing happened then. " * 400
    for o, c in ("“”", "«»", "()", "「」", '""'):
        text = f"Start here. He said: {o}{said}End{c} and left. Last one."
        assert cut_up(spark, text) == ["Start here.", f"He said: {o}{said}End{c} and left.", "Last one."]


def test_any_number_of_blanks_and_inkless_characters(spark):
    z = "​"
    for n in (1, 4, 9):
        assert cut_up(spark, f"He met Dr{z * n}. Brown.{z * n} Then{z * n} he left.") == [f"He met Dr{z * n}. Brown.{z * n}", f"Then{z * n} he left."]
    blanks = " " * 40
    assert cut_up(spark, f"Er kam am{blanks}3. Mai.{blanks}Dann ging er.") == [f"Er kam am{blanks}3. Mai.", "Dann ging er."]
    assert cut_up(spark, f"สวัสดีครับ{blanks}ผมมาแล้ว") == ["สวัสดีครับ", "ผมมาแล้ว"]
    assert cut_up(spark, "Ẹ̤́̂. Brown came. He left.") == ["Ẹ̤́̂. Brown came.", "He left."]


def test_private_use_characters_stay(spark):
    text = "One \ue0fe here\ue0ff. Two \ue000\ue001. \ue002Three."
    assert cut_up(spark, text) == ["One \ue0fe here\ue0ff.", "Two \ue000\ue001.", "\ue002Three."]
