"""Problem 7: sources combined to target weights by pivotal rounding.

Every document of a source gets the same expected number of copies; the whole part is taken at once, the
fraction is rounded by pivotal sampling: two fractions meet, mass in tokens moves at random from one to
the other until one of them is 0 or 1, and the rest meets the next. Expected copies of each document
and the tokens of each source are kept but for one last residual. Partitions do this in a stream with
one residual per source, and the residuals meet in a tree of shuffles.

Documents without text or source, and sources without a target, take no part. A target source without
documents has nothing to give; the shares of the others keep their proportions.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored, table
from .common import spread

# a vocabulary file of a public tokenizer, on the driver, and the pattern that it was made with, if the module of its files has none
TOKENIZER = os.environ.get("SENTLINE_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
PATTERN = os.environ.get("SENTLINE_TOKEN_PATTERN")
DOCS_PER_TASK = 16_384  # documents that one task of the first level rounds; by the data, not the cluster, so that the choice is the same on any
FAN_IN = 32  # residual sets that meet in one task of the next level


def token_pattern() -> str:
    """The pattern that cuts texts before the vocabulary applies. Sizes hang on it, so that none is guessed."""
    if PATTERN:
        return PATTERN
    try:
        from public_tokenizers import PATTERN as pattern
    except ImportError as e:
        raise ValueError("name the pattern of the tokenizer in SENTLINE_TOKEN_PATTERN") from e
    return pattern


def with_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, pattern: str | None = None) -> DataFrame:
    """The columns of docs plus n_tokens of text, by a public byte-level BPE vocabulary (ranks in base64 per line). The file
    goes from the driver to the executors."""
    from pyspark import SparkFiles

    docs.sparkSession.sparkContext.addFile(tokenizer)
    name, pattern = os.path.basename(tokenizer), pattern or token_pattern()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for s in batches:
            yield pd.Series([len(x) for x in enc.encode_ordinary_batch(s.tolist(), num_threads=1)], dtype="int64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn("n_tokens", F.pandas_udf(run, "bigint")("text"))


def _draw(*key: object) -> float:
    """A number in [0, 1) that depends on its key only, so that a task that runs again draws the same."""
    return int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=7).digest(), "big") / (1 << 56)


def pivotal(seed: int, level: int, last: bool):
    """A streaming pivotal pass over rows (doc_id, source, n_tokens, whole, p); rows with p in (0, 1) are open.

    Rows leave as soon as they are decided; at the end of the partition each source has one open row at
    most, which goes on to the next level, or is drawn if this is the last.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple] = {}
        cols = ["doc_id", "source", "n_tokens", "whole", "p"]
        for b in batches:
            out = []
            for d, s, n, whole, p in zip(b.doc_id, b.source, b.n_tokens, b.whole, b.p):
                if not 0 < p < 1:
                    out.append((d, s, n, whole, p))
                    continue
                if s not in held:
                    held[s] = (d, n, whole, p)
                    continue
                e, m, ewhole, q = held.pop(s)
                # tokens that can move to d, and to e, before one of the two is settled
                to_d, to_e = min((1 - p) * n, q * m), min((1 - q) * m, p * n)
                if _draw(seed, level, d, e) * (to_d + to_e) < to_e:
                    p, q = _snap(p + to_d / n), _snap(q - to_d / m)
                else:
                    p, q = _snap(p - to_e / n), _snap(q + to_e / m)
                if 0 < p < 1:
                    held[s] = (d, n, whole, p)
                    out.append((e, s, m, ewhole, q))
                elif 0 < q < 1:
                    held[s] = (e, m, ewhole, q)
                    out.append((d, s, n, whole, p))
                else:
                    out += [(d, s, n, whole, p), (e, s, m, ewhole, q)]
            yield pd.DataFrame(out, columns=cols)
        rest = [(d, s, n, whole, float(_draw(seed, "last", d) < p) if last else p) for s, (d, n, whole, p) in held.items()]
        yield pd.DataFrame(rest, columns=cols)

    return run


def _snap(p: float) -> float:
    return 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, source, n_tokens), targets(source, target_share, max_repeats) -> (chosen rows with copies, report).

    Without a total, the largest one that every source with documents can serve within its repeats.
    """
    docs = stored(docs.filter("n_tokens > 0 AND source IS NOT NULL").select("doc_id", "source", "n_tokens"))
    have = docs.groupBy("source").agg(F.sum("n_tokens").alias("have"), F.count("*").alias("n_docs"))
    t = targets.filter("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    plan = t.join(have, "source", "left").fillna(0, ["have", "n_docs"])
    served = plan.filter("have > 0").agg(F.min(F.col("have") * F.col("max_repeats") / F.col("target_share")).alias("total"))
    total = float(total_tokens) if total_tokens is not None else (served.first()["total"] or 0.0)  # one number
    plan = plan.withColumn("want", F.least(F.lit(total) * F.col("target_share"), F.col("have") * F.col("max_repeats")))
    rate = plan.filter("have > 0").select("source", (F.col("want") / F.col("have")).alias("rate"))
    # one row per target source
    rows = docs.join(F.broadcast(rate), "source").select("doc_id", "source", "n_tokens", F.floor(F.col("rate") + F.lit(1e-12)).cast("bigint").alias("whole"), F.greatest(F.col("rate") - F.floor(F.col("rate") + F.lit(1e-12)), F.lit(0.0)).alias("p"))
    schema = "doc_id bigint, source string, n_tokens bigint, whole bigint, p double"
    # a source that holds most rows is spread by the hash of its rows, and partitions are sorted to be the same when run again
    n = max(1, -(-int(plan.agg(F.sum("n_docs")).first()[0] or 0) // DOCS_PER_TASK))
    out = None
    level = 0
    while True:
        part = rows.repartition(n, F.xxhash64("doc_id", F.lit(seed))) if n > 1 else rows.repartition(1)
        part = part.sortWithinPartitions("source", F.xxhash64("doc_id", F.lit(seed), F.lit(level)), "doc_id")
        done = stored(part.mapInPandas(pivotal(seed, level, n == 1), schema))
        settled = done.filter("p <= 0 OR p >= 1")
        out = settled if out is None else out.unionByName(settled)
        if n == 1:
            break
        rows, n, level = done.filter("p > 0 AND p < 1"), -(-n // FAN_IN), level + 1
    chosen = out.select("doc_id", "source", "n_tokens", (F.col("whole") + F.col("p").cast("bigint")).alias("copies")).filter("copies > 0")
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"))
    rep = plan.join(got, "source", "left").fillna(0, ["tokens", "copies", "most_copies"])
    whole = rep.agg(F.sum("tokens").alias("all_tokens"))
    rep = rep.withColumn("k", F.lit(1)).join(F.broadcast(whole.withColumn("k", F.lit(1))), "k").drop("k")
    report = rep.select("source", "target_share", "max_repeats", "n_docs", F.col("have").alias("source_tokens"), "tokens", "copies", "most_copies", F.when(F.col("all_tokens") > 0, F.col("tokens") / F.col("all_tokens")).alias("actual_share"))
    return chosen, report


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf, "mix_targets")
    docs = table(spark, sf, "documents").filter("text IS NOT NULL AND text <> ''").select("doc_id", "source", "text")
    docs = docs.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")
    return mix(with_tokens(spread(docs)), targets)


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, source, n_tokens, copies of the chosen documents."""
    return _mix(spark, sf)[0]


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual share of each source."""
    return _mix(spark, sf)[1]


def p7_kept(spark: SparkSession, sf: str) -> DataFrame:
    """source, share_kept, repeats_kept: whether the actual share is the target's, among sources that have documents, but for less
    than a document, and no document comes more often than allowed."""
    rep = _mix(spark, sf)[1]
    there = rep.filter("n_docs > 0").agg(F.sum("target_share").alias("there"), F.max(F.col("source_tokens") / F.col("n_docs")).alias("doc"), F.sum("tokens").alias("all"))
    # one row beside one row per source
    rep = rep.join(F.broadcast(there), F.lit(True))
    wanted = F.when(F.col("n_docs") > 0, F.col("target_share") / F.col("there")).otherwise(0.0)
    off = F.abs(F.coalesce("actual_share", F.lit(0.0)) - wanted)
    return rep.select("source", (off <= 20 * F.col("doc") / F.col("all")).alias("share_kept"), (F.col("most_copies") <= F.col("max_repeats")).alias("repeats_kept"))
