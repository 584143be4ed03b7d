import os

import pytest

from sentline.llm import mixing as L

TARGETS = [("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 2), ("none", 0.1, 2)]


def frame(spark):
    docs = [(i, "a", 50 + i % 37) for i in range(3000)] + [(10_000 + i, "b", 80 + i % 11) for i in range(300)] + [(20_000 + i, "c", 60) for i in range(900)]
    docs += [(30_000, None, 5), (30_001, "other", 5), (30_002, "a", 0), (30_003, "a", None)]
    return spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint"), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def test_shares(spark):
    docs, targets = frame(spark)
    chosen, report = L.mix(docs, targets)
    rep = {r.source: r for r in report.collect()}
    for s, share, most in TARGETS[:3]:
        assert abs(rep[s].actual_share - share) < 0.005
        assert rep[s].most_copies <= most
    assert rep["none"].tokens == 0 and "other" not in rep
    rows = chosen.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and all(r.copies >= 1 for r in rows)


def test_copies_differ_by_one_at_most(spark):
    docs, targets = frame(spark)
    copies = [r.copies for r in L.mix(docs, targets)[0].filter("source = 'b'").collect()]
    assert max(copies) - min(copies) <= 1


def test_same_again(spark):
    docs, targets = frame(spark)
    a, b = (sorted(map(tuple, L.mix(docs, targets)[0].collect())) for _ in range(2))
    assert a == b


def test_total(spark):
    docs, targets = frame(spark)
    got = {r.source: r.tokens for r in L.mix(docs, targets, total_tokens=10_000)[1].collect()}
    assert abs(got["a"] - 5000) < 90 and abs(got["b"] - 3000) < 95 and abs(got["c"] - 2000) < 65


def test_empty(spark):
    _, targets = frame(spark)
    e = spark.createDataFrame([], "doc_id bigint, source string, n_tokens bigint")
    chosen, report = L.mix(e, targets)
    assert chosen.count() == 0 and all(r.tokens == 0 for r in report.collect())


@pytest.mark.skipif(not os.path.exists(L.TOKENIZER), reason="no tokenizer file")
def test_tokens(spark):
    df = L.with_tokens(spark.createDataFrame([("Hello world",), ("",), ("<|endoftext|>",)], "text string"))
    n = [r.n_tokens for r in df.collect()]
    assert n[0] == 2 and n[1] == 0 and n[2] > 1


def test_choice_does_not_hang_on_the_cluster(spark):
    """Other partitions of the same documents and another number of cores leave the chosen rows as they are."""
    docs, targets = frame(spark)
    a = sorted(map(tuple, L.mix(docs.repartition(1), targets)[0].collect()))
    b = sorted(map(tuple, L.mix(docs.repartition(13), targets)[0].collect()))
    assert a == b


def test_levels_of_the_tree(spark, monkeypatch):
    monkeypatch.setattr(L, "DOCS_PER_TASK", 50)  # 84 tasks, then three, then one
    docs, targets = frame(spark)
    chosen, report = L.mix(docs, targets)
    rep = {r.source: r for r in report.collect()}
    assert all(abs(rep[s].actual_share - share) < 0.005 and rep[s].most_copies <= most for s, share, most in TARGETS[:3])
    assert chosen.count() == chosen.select("doc_id").distinct().count()


def test_pattern_is_not_guessed(monkeypatch):
    monkeypatch.setitem(__import__("sys").modules, "public_tokenizers", None)
    monkeypatch.setattr(L, "PATTERN", None)
    with pytest.raises(ValueError):
        L.token_pattern()
