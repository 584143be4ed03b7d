"""Problem 6: passages of held-out items inside documents, by greedy string tiling.

Items and documents become word streams (maximal runs of letters and digits, lower case), made once, by the JVM.
Hashes of every run of SEED words of the items are joined with those of the documents; only documents that share a seed
leave the scan, and only (document, item) pairs that share seeds go on. For each pair, tiles are marked greedily: the longest match that runs over
unmarked words of both sides first, found by extending Karp-Rabin seed hits, until no match of
at least `min_words` is left. Coverage of the item by tiles catches reordered passages.

Null and empty texts hold no words and give no rows. Repeated documents each give their row; equal
rows are returned once.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small, stored, table
from .common import spread

SEED = 8
MIN_WORDS = 15
COVERAGE = 0.15  # share of an item from which tiles shorter than a passage count
MAX_SEEDS = 50_000  # seeds of the items up to which each document is held against all of them at once; more are joined
WORD = r"[\p{L}\p{N}]+"


def words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)


def seeds(df: DataFrame, key: str, text: str, n: int = SEED) -> DataFrame:
    """key, h: the distinct hashes of all runs of n words, made in the JVM."""
    return with_words(df.select(key, text), text, n).select(key, F.explode(F.array_distinct(_grams(n))).alias("h"))


def with_words(df: DataFrame, text: str, least: int) -> DataFrame:
    """The other columns of df and w, the words of a text column; texts of fewer words are left out. The words come out of a
    generator, so that the filter is not pushed before it, where it would make them a second time."""
    return df.select(*[c for c in df.columns if c != text], F.explode(F.array(words(text))).alias("w")).filter(F.size("w") >= least)


def _grams(n: int) -> Column:
    """Hashes of all runs of n words of the column w."""
    return F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.xxhash64(F.slice(F.col("w"), i, n)))


def tiles(doc: list[str], item: list[str], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (item position, document position, words), longest first, nothing marked twice."""
    if len(doc) < least or len(item) < least:
        return []
    mod, base = (1 << 61) - 1, 1_000_003
    code = {w: i + 1 for i, w in enumerate(dict.fromkeys(item))}
    d, p = [code.get(w, 0) for w in doc], [code[w] for w in item]
    top = pow(base, least, mod)

    def rolling(x: list[int]) -> list[int]:
        h, out = 0, []
        for i, v in enumerate(x):
            h = (h * base + v) % mod
            if i >= least:
                h = (h - x[i - least] * top) % mod
            if i >= least - 1:
                out.append(h)
        return out

    hd, hp = rolling(d), rolling(p)
    wanted = set(hp)
    at = defaultdict(list)
    for i, h in enumerate(hd):
        if h in wanted:
            at[h].append(i)
    found = []
    for j, h in enumerate(hp):
        for i in at.get(h, ()):
            if i and j and d[i - 1] == p[j - 1]:
                continue  # inside a match that began earlier
            n = 0
            while i + n < len(d) and j + n < len(p) and d[i + n] == p[j + n]:
                n += 1
            if n >= least:
                found.append((n, j, i))
    # longest first: a match that meets marked words is cut and goes back, to be taken at its new length
    heap = [(-n, j, i) for n, j, i in found]
    heapq.heapify(heap)
    used_d, used_p, out = bytearray(len(d)), bytearray(len(p)), []
    while heap:
        n, j, i = heapq.heappop(heap)
        n = -n
        free = [not (used_p[j + k] or used_d[i + k]) for k in range(n)]
        if all(free):
            out.append((j, i, n))
            for k in range(n):
                used_p[j + k] = used_d[i + k] = 1
            continue
        start = None
        for k in range(n + 1):
            if k < n and free[k]:
                start = k if start is None else start
            elif start is not None:
                if k - start >= least:
                    heapq.heappush(heap, (-(k - start), j + start, i + start))
                start = None
    return out


def leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, min_coverage: float = 0.0, seed: int = SEED) -> DataFrame:
    """documents(doc_id, text), items(item_id, text) -> doc_id, item_id, n_tiles, longest, matched, coverage."""
    seed = min(seed, min_words)
    docs = with_words(spread(documents.select("doc_id", "text").filter("text IS NOT NULL")), "text", min_words)
    its = stored(items.select("item_id", "text").filter("text IS NOT NULL").select("item_id", words("text").alias("item_words")))
    # a passage of min_words holds min_words - seed + 1 seeds in a row, so that every so many seeds of an item are enough
    step = min_words - seed + 1
    starts = F.sequence(F.lit(1), F.size("w") - seed + 1, F.lit(step))
    item_seeds = stored(its.withColumnRenamed("item_words", "w").filter(F.size("w") >= min_words).select("item_id", F.explode(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(F.col("w"), i, seed))))).alias("h")))
    if item_seeds.select("h").distinct().count() <= MAX_SEEDS:
        # one row of at most MAX_SEEDS numbers. Documents without a seed leave nothing behind; the words of the others are kept
        all_seeds = item_seeds.agg(F.collect_set("h").alias("seeds"))
        shared = F.array_intersect(_grams(seed), F.col("seeds"))
        hits = docs.join(F.broadcast(all_seeds), F.lit(True)).select("doc_id", "w", F.explode(F.array(shared)).alias("hs")).filter(F.size("hs") > 0)
    else:
        ids = docs.select("doc_id", F.explode(F.array_distinct(_grams(seed))).alias("h")).join(broadcast_if_small(item_seeds.select("h").distinct()), "h", "left_semi")
        hits = docs.join(broadcast_if_small(stored(ids.groupBy("doc_id").agg(F.collect_set("h").alias("hs")))), "doc_id")
    hits = stored(hits)
    pairs = hits.select("doc_id", F.explode("hs").alias("h")).join(broadcast_if_small(item_seeds), "h").select("doc_id", "item_id").distinct()
    pairs = hits.select("doc_id", "w").join(pairs, "doc_id").join(broadcast_if_small(its), "item_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, i, w, x in zip(b.doc_id, b.item_id, b.w, b.item_words):
                ts = tiles(list(w), list(x), min_words)
                if ts:
                    m = sum(n for _, _, n in ts)
                    rows.append((d, i, len(ts), max(n for _, _, n in ts), m, m / len(x)))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_tiles", "longest", "matched", "coverage"])

    out = pairs.select("doc_id", "item_id", "w", "item_words").mapInPandas(run, "doc_id bigint, item_id bigint, n_tiles bigint, longest bigint, matched bigint, coverage double")
    return out.filter((F.col("coverage") >= min_coverage) | (F.col("longest") >= MIN_WORDS)).distinct()


def p6_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Leaks with their tiles and the share of the item that they cover. Tiles of eight words catch reordered passages, where they
    cover COVERAGE of the item; a passage of MIN_WORDS counts whatever it covers."""
    return leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"), min_words=SEED, min_coverage=COVERAGE)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, item_id of documents that hold at least 15 consecutive words of an item."""
    return leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "item_id").distinct()
