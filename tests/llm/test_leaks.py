import random

import regex

from sentline.llm import leaks as L


def brute(docs, items, n):
    rx = regex.compile(L.WORD)
    out = set()
    for d, t in docs:
        w = rx.findall((t or "").lower())
        have = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for k, x in items:
            v = rx.findall((x or "").lower())
            if any(tuple(v[i : i + n]) in have for i in range(len(v) - n + 1)):
                out.add((d, k))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(3)
    vocab = ["alpha", "beta", "gamma", "delta", "eps"]
    items = [(k, " ".join(rnd.choice(vocab) + str(rnd.randrange(9)) for _ in range(40))) for k in range(6)] + [(90, None), (91, ""), (92, "short one"), (93, "same " * 30)]
    docs = []
    for d in range(60):
        base = [rnd.choice(vocab) + str(rnd.randrange(9)) for _ in range(50)]
        k = rnd.randrange(6)
        n = rnd.choice((0, 13, 14, 15, 16, 30, 40))
        at = rnd.randrange(0, 41 - n) if n else 0
        passage = [w.upper() + rnd.choice(("", ",", "...", "\n")) for w in items[k][1].split()[at : at + n]]
        docs.append((d, " ".join(base[:25] + passage + base[25:])))
    docs += [(100, None), (101, ""), (102, docs[5][1]), (103, "x " + "Same, " * 16), (104, "same " * 14)]
    got = L.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == brute(docs, items, 15)


def test_reordered_passages():
    item = [f"w{i}" for i in range(40)]
    doc = ["x"] * 5 + item[20:40] + ["y"] * 3 + item[0:20]
    ts = L.tiles(doc, item, 8)
    assert sorted(ts) == [(0, 28, 20), (20, 5, 20)]
    assert L.tiles(doc, item, 21) == [] and L.tiles([], item, 8) == []


def test_empty_tables(spark):
    e = spark.createDataFrame([], "doc_id bigint, text string")
    i = spark.createDataFrame([], "item_id bigint, text string")
    assert L.leaks(e, i).count() == 0


def test_long_repeats_on_both_sides():
    assert L.tiles(["a"] * 4000, ["a"] * 600, 15) == [(0, 0, 600)]
    assert sum(n for _, _, n in L.tiles(["a", "b"] * 50 + ["c"], ["a", "b"] * 30, 8)) == 60


def test_many_seeds_are_joined(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_SEEDS", 5)
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "x " + text), (2, "nothing of it"), (3, None)], "doc_id bigint, text string")
    got = L.leaks(docs, spark.createDataFrame([(7, text)], "item_id bigint, text string")).collect()
    assert [(r.doc_id, r.item_id, r.longest, r.coverage) for r in got] == [(1, 7, 40, 1.0)]
