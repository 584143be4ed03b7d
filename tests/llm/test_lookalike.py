import itertools

import pytest
from pyspark.sql import functions as F

from sentline.llm import lookalike as L

SAME = ["Ångström fi 5 µ", "Ångström ﬁ 5 µ", "Ａ̊ngström fi ５ μ", "Ångström f​i 5 μ", "Å­ngstrоm fi 5 µ".replace("оm", "öm")]
OTHER = ["Angström fi 5 µ", "ångström fi 5 µ", "Ångström fi ⁵ µ", "Ångström fi 5 µ\n", "Ångström  fi 5 µ", "Ångström fi — 5 µ"]


@pytest.fixture(scope="module")
def keys(spark):
    texts = [*SAME, *OTHER, None, "", "​", "ｶﾞﾌﾟ", "ガプ", "ガプ", "сор", "cop", "Ⅳ", "IV", "a‐b", "a-b", "a–b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, text string")
    return dict(zip(texts, [r.key for r in df.select("id", L.look_key(L.stable_form(F.col("text"))).alias("key")).orderBy("id").collect()]))


def test_same_look_same_key(keys):
    assert len({keys[t] for t in SAME}) == 1
    assert keys["ｶﾞﾌﾟ"] == keys["ガプ"] == keys["ガプ"]
    assert keys["сор"] == keys["cop"] and keys["Ⅳ"] == keys["IV"] and keys["a‐b"] == keys["a-b"]


def test_other_look_other_key(keys):
    assert len({keys[t] for t in [SAME[0], *OTHER]}) == 1 + len(OTHER)
    assert keys["a–b"] != keys["a-b"]


def test_null_empty_inkless(keys):
    assert keys[None] is None and keys[""] == "" and keys["​"] == ""


def test_quick_check_covers_the_exact_one():
    alone, marks = L.classes()
    inside = lambda ch: any(a <= ord(ch) <= b for a, b in alone + marks)
    assert not inside("é") and not inside("漢")
    assert all(inside(ch) for ch in "\u00a0\u0301\ufb01\uff21\u212b\u200b\uff9e")


def test_pairs_against_brute_force(spark, tmp_path):
    texts = {1: "ab c", 2: "аb c", 3: "ab c", 4: "ab c", 5: "AB c", 6: None, 7: "ab​ c"}
    src = [(i * 10, i, 1, "p", "register", "en", "text", 1, t) for i, t in texts.items()] + [(999, 1, 1, "p", "register", "en", "text", 1, "ab c"), (998, 8, 1, "p", "prose", "en", "text", 1, "аb c")]
    spark.createDataFrame(src, "delivery_id bigint, file_id bigint, feed_id int, path string, intake string, lang string, format string, n_chars bigint, sourcefile string").write.parquet(f"{tmp_path}/source_files.parquet")
    runs = [(100 + i, i, t) for i, t in texts.items()] + [(101, 1, "ab c"), (200, 8, "ab c")]
    spark.createDataFrame(runs, "run_id bigint, file_id bigint, targetfile string").write.parquet(f"{tmp_path}/target_files.parquet")
    got = {tuple(r) for r in L.p1_found(spark, str(tmp_path)).collect()}
    look = lambda t: t.replace("а", "a").replace(" ", " ").replace("​", "")
    want = set()
    for field, off in (("sourcefile", 0), ("targetfile", 100)):
        for a, b in itertools.combinations([i for i, t in texts.items() if t], 2):
            if texts[a] != texts[b] and look(texts[a]) == look(texts[b]):
                want.add((field, a + off, b + off))
    assert got == want


def test_accented_letters_of_other_scripts(spark):
    groups = [["café", "cafе́", "саfе́"], ["Ångström", "А̊ngstrӧm", "Angström".replace("A", "Α̊")], ["ó", "ό", "о́"], ["y̆", "ў", "ў"], ["cafe"], ["cafè"], ["й", "й"]]
    rows = [(g, t) for g, ts in enumerate(groups) for t in ts]
    got = spark.createDataFrame(rows, "g int, text string").select("g", L.look_key(L.stable_form(F.col("text"))).alias("key")).collect()
    assert len({(r.g, r.key) for r in got}) == len({r.key for r in got}) == len(groups)
    words = ["Ελληνικό νερό", "Быў дождж", "Это новый ӧвтас", "Ελληνικό νερό", "Быў дождж".replace("ў", "y̆")]
    out = [r.canonical for r in L.canonical_texts(spark.createDataFrame(list(enumerate(words)), "id int, text string").selectExpr("'f' AS field", "id", "text")).orderBy("id").collect()]
    assert out == [*words[:3], words[0], words[1]]


def key_of(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [r.key for r in df.select("id", L.look_key(L.stable_form(F.col("text"))).alias("key")).orderBy("id").collect()]


@pytest.mark.parametrize("z", ["\u200b", "\u00ad", "\u034f", "\u200b\u2060\u00ad"])
def test_mark_after_inkless_characters(spark, z):
    assert len(set(key_of(spark, "caf\u00e9", f"cafe{z}\u0301", f"caf\u0435{z}\u0301", f"cafe\u0301{z}"))) == 1


def test_letters_of_many_scripts(spark):
    assert len(set(key_of(spark, "Ak uvi", "\u13aa\u03ba \u03c5\u0475\u03b9", "\u0410k \u057dv\u0456"))) == 1


def test_copies_of_one_form_do_not_meet(spark, tmp_path):
    rows = [(i, i, "register", "en", "ab c") for i in range(300)] + [(900, 900, "register", "en", "ab\u00a0c")]
    spark.createDataFrame(rows, "delivery_id bigint, file_id bigint, intake string, lang string, sourcefile string").write.parquet(f"{tmp_path}/source_files.parquet")
    spark.createDataFrame([], "run_id bigint, file_id bigint, targetfile string").write.parquet(f"{tmp_path}/target_files.parquet")
    got = {tuple(r) for r in L.p1_found(spark, str(tmp_path)).collect()}
    assert got == {("sourcefile", i, 900) for i in range(300)}
