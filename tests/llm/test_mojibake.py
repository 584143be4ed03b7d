import pytest

from sentline.llm import mojibake as L

CLEAN = [
    "Später wurde die Tür am Güterbahnhof geöffnet und schließlich gemessen.", "Der Wärter hat Stück gezählt, während die Brücke größer war.", "Il a été mesuré après l'été près du château, côté forêt.",
    "Затем насос снова проверили, хотя работа шла рано утром.", "Никто не знал, почему журнал оказался здесь.", "«Wort» – so heißt es für die Überlegung.",
]
GARBLES = [("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("cp1252", "cp437"), ("koi8_r", "cp1251"), ("utf-8", "cp1251"), ("cp1251", "koi8_r")]


def garble(t, written, read):
    b = t.encode(written, "ignore")
    enc, chars = L._table(read)
    return "".join(chars[x] for x in b)


def corpus():
    texts, bad = [], {}
    n = 0
    for k in range(12):
        for t in CLEAN:
            texts.append((n, f"{t} Nr {k}."))
            n += 1
    for t in CLEAN:
        for w, r in GARBLES:
            try:
                t.encode(w)
            except UnicodeEncodeError:
                continue
            g = garble(t, w, r)
            if g != t and g.isprintable():
                texts.append((n, "Only plain words first. " + g))
                bad[n] = "Only plain words first. " + t
                n += 1
    decoys = ["Marks: © ® ™ § ¶ † ‡ • · « » ° ¹ ² ³.", "┌──┬──┐\n│ Å/mm │ ½ µm │", "The key shows Ä Ö Ü ß é è ê ñ ¿ ¡.", "SÃO BRÁS DA MARÉ e PROIBIÇÃO", "Реле РС ПЪ", "ascii only", "", None]
    for t in decoys:
        texts.append((n, t))
        n += 1
    texts.append((n, "k\ufffdnnte"))
    bad[n] = None
    return texts, bad


@pytest.fixture(scope="module")
def data(spark):
    texts, bad = corpus()
    return spark.createDataFrame(texts, "file_id bigint, text string").union(spark.createDataFrame(texts[:3], "file_id bigint, text string")), bad


def test_found(data):
    df, bad = data
    assert {r.file_id for r in L.garbled_files(df).collect()} == set(bad)


def test_restored(data):
    df, bad = data
    got = {r.file_id: (r.restored, r.complete) for r in L.restored_texts(df).collect()}
    assert set(got) == set(bad)
    right = sum(got[k][0] == v for k, v in bad.items() if v)
    assert right >= 0.9 * len(bad)
    assert not got[max(bad)][1]


@pytest.mark.parametrize("written, read", [("utf_8", "cp1252"), ("utf_8", "cp437"), ("koi8_r", "cp1252"), ("cp1251", "cp866")])
def test_round_trip(written, read):
    t = "Привет" if written != "utf_8" else "Grüße"
    g = garble(t, written, read)
    assert L.undo(g, f"{read}>{written}") == t
    assert t in [c for chain, c in L.hypotheses(g)]


def test_twice():
    t = "señal"
    g = garble(garble(t, "utf-8", "cp1252"), "utf-8", "cp1252")
    assert ("cp1252>utf_8*2", t) in list(L.hypotheses(g))


def test_empty_table(spark):
    assert L.garbled_files(spark.createDataFrame([], "file_id bigint, text string")).count() == 0


def test_one_garbled_sentence_in_a_line_without_blanks(spark):
    zh = ["我们在河边测量了桥的高度。", "他们昨天在城里看了新的机器。"]
    ja = ["私たちは昨日この機械を調べました。", "彼は町で新しい橋を見ました。"]
    texts = [(n, a + b) for n, (a, b) in enumerate([zh, zh[::-1], ja, ja[::-1]] * 4)]
    bad = {}
    cases = [(zh, "gbk", "cp1252"), (ja, "euc_jp", "cp1252"), (zh, "utf-8", "cp1252"), (zh, "utf-8", "gbk"), (ja, "euc_jp", "mac_roman")]
    for (a, b), w, r in cases:
        g = a.encode(w).decode("gbk", "ignore") if r == "gbk" else garble(a, w, r)
        for text, clean in ((g + b, a + b), (b + g, b + a), (b + "“" + g + "”" + b, b + "“" + a + "”" + b)):
            if r == "gbk" and "“" in text or any("\x80" <= x <= "\x9f" for x in text):
                continue
            n = 100 + len(bad)
            texts.append((n, text))
            bad[n] = clean if r != "gbk" else None
    df = spark.createDataFrame(texts, "file_id bigint, text string")
    assert len(bad) > 6 and {r.file_id for r in L.garbled_files(df).collect()} == set(bad)
    got = {r.file_id: r.restored for r in L.restored_texts(df).collect()}
    assert {k: got[k] for k, v in bad.items() if v} == {k: v for k, v in bad.items() if v}


def test_single_character_at_a_cut_is_no_case(spark):
    texts = [(n, "Η γέφυρα και η αντλία η μία") for n in range(6)] + [(9, "他说：“快去灯塔。”管\n理员问道。")]
    assert L.garbled_files(spark.createDataFrame(texts, "file_id bigint, text string")).count() == 0


@pytest.mark.parametrize("written, read", [("koi8_r", "cp1251"), ("cp1252", "cp437")])
def test_a_third_of_the_files_garbled_by_one_chain(spark, written, read):
    ru = ["Затем насос снова проверили, хотя работа шла рано утром.", "Никто не знал, почему журнал оказался здесь.", "Старый мастер долго чинил мельницу возле реки."]
    de = ["Später wurde die Tür am Güterbahnhof geöffnet.", "Der Wärter hat Stücke gezählt, während die Brücke größer war.", "Über die Mühle führte früher eine schöne Straße."]
    texts, bad = [], set()
    for n in range(36):
        t = (ru if written == "koi8_r" else de)[n // 3 % 3]
        if n % 3 == 0:
            bad.add(n)
            t = garble(t, written, read)
        texts.append((n, t))
    df = spark.createDataFrame(texts, "file_id bigint, text string")
    assert {r.file_id for r in L.garbled_files(df).collect()} == bad


def test_long_token(spark):
    a, b = "我们在河边测量了桥的高度，", "他们昨天在城里看了新的机器，"
    texts = [(n, a + b) for n in range(6)] + [(9, garble((a + b) * 200, "gbk", "cp1252"))]
    assert [r.file_id for r in L.garbled_files(spark.createDataFrame(texts, "file_id bigint, text string")).collect()] == [9]


def test_a_transformation_needs_aligned_pairs(spark):
    """A text that only looks right after a transformation proves nothing; one that shares runs with clean texts does."""
    clean = ["我们在河边测量了桥的高度。", "他们昨天在城里看了新的机器。"]
    other = "那位老人坐船去了远方的海岛！"
    letters = "".join(clean + [other])
    # the characters of the third text are known one by one, never two in a row
    apart = [(50 + i, " ".join(letters)) for i in range(6)]
    near = [(i, clean[i % 2]) for i in range(8)]
    lone = (90, garble(other, "utf-8", "cp1252"))
    learned = lambda rows: {r.chain for r in L.learn(spark.createDataFrame(rows, "file_id bigint, text string"))[1].collect()}
    assert learned([*apart, *near, lone]) == set()
    undecided = L.learn(spark.createDataFrame([*apart, *near, lone], "file_id bigint, text string"))[3].collect()
    assert other in {r.c for r in undecided}
    twin = (91, garble("他们昨天在城里看了那位老人。", "utf-8", "cp1252"))
    assert "cp1252>utf_8" in learned([*apart, *near, lone, twin])
    assert {r.file_id for r in L.garbled_files(spark.createDataFrame([*apart, *near, (92, lone[1]), twin], "file_id bigint, text string")).collect()} >= {91, 92}


def test_words_alone_with_their_skeleton_need_no_one_byte_trial():
    assert all(chain.split(">")[1].partition("*")[0] in L.MULTI for chain, _ in L.hypotheses("sp„ter", False))
