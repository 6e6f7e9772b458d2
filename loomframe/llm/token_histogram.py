"""Exact histogram of encoded lengths, and what its suffix sums answer."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Encoder, stream, text_bytes, tokenizer_path, written

#: Lengths per block of the two-level suffix sums.
BLOCK = 64


def token_lengths(docs: DataFrame, text_col: str = "text", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """n_tokens of each row of docs, in no order. A null text is empty and has 0 tokens; repeated rows count each."""

    def step(cols, state):
        _, ends = Encoder.of(tokenizer_path(tokenizer)).encode(text_bytes(cols[0]))
        return [np.diff(ends)]

    return stream(docs, step, [F.col(text_col).cast("string").alias("text")], "n_tokens long")


def length_histogram(docs: DataFrame, text_col: str = "text", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """One row per encoded length that occurs, with suffix sums that answer every context limit.

    n_tokens: the length; n_docs: documents of it; docs_ge, tokens_ge: documents of this length or more, and their
    tokens; truncated_tokens: tokens left of all documents when each is cut to this length. Documents are counted
    before any shuffle, so a hot length costs one row a task. The suffix sums take two levels, blocks of BLOCK lengths
    and lengths in a block, so no task sees all lengths. The histogram, a row a length, is written once and read by both
    levels, so texts are encoded once. An empty table gives no rows.
    """
    hist = token_lengths(docs, text_col, tokenizer).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
    return with_suffix_sums(written(hist, "lengths"))


def with_suffix_sums(hist: DataFrame) -> DataFrame:
    """Suffix sums of a histogram (n_tokens, n_docs)."""
    hist = hist.select("n_tokens", "n_docs", F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    tokens = F.col("n_tokens") * F.col("n_docs")
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    # one row per BLOCK lengths: as many rows as the longest document has blocks
    down = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.select(
        "block",
        (F.sum("d").over(down) - F.col("d")).alias("docs_after"),
        (F.sum("t").over(down) - F.col("t")).alias("tokens_after"),
        F.sum("t").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("tokens_to"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = hist.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        (F.col("docs_after") + F.sum("n_docs").over(inside)).alias("docs_ge"),
        (F.col("tokens_after") + F.sum(tokens).over(inside)).alias("tokens_ge"),
        (F.col("tokens_to") + F.col("tokens_after")).alias("total"),
    )
    return summed.select(
        "n_tokens",
        "n_docs",
        "docs_ge",
        "tokens_ge",
        (F.col("total") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_tokens"),
    )


def answers(suffix: DataFrame, limits: Sequence[int] = (), quantiles: Sequence[float] = ()) -> DataFrame:
    """One row of answers from the suffix sums: n_docs, n_tokens, for each limit c docs_over_c and tokens_at_c (documents
    longer than c, and tokens left when all are cut to c), and for each q length_q<percent> (the smallest length that
    at least a share q of documents do not exceed). Over no documents counts are 0 and quantiles null."""
    total = F.coalesce(F.max("docs_ge"), F.lit(0))
    tokens = F.coalesce(F.max("tokens_ge"), F.lit(0))
    out = [total.alias("n_docs"), tokens.alias("n_tokens")]
    for c in limits:
        above = F.col("n_tokens") > c
        over, rest = F.coalesce(F.max(F.when(above, F.col("docs_ge"))), F.lit(0)), F.coalesce(F.max(F.when(above, F.col("tokens_ge"))), F.lit(0))
        out += [over.alias(f"docs_over_{c}"), (tokens - rest + over * c).alias(f"tokens_at_{c}")]
    one = suffix.agg(*out)
    for q in quantiles:
        need = F.col("n_tokens_of").isNotNull() & (F.col("docs") - F.col("docs_ge") + F.col("n_docs_of") >= F.ceil(F.col("docs") * F.lit(float(q))))
        named = suffix.select("docs_ge", F.col("n_tokens").alias("n_tokens_of"), F.col("n_docs").alias("n_docs_of"))
        got = named.crossJoin(F.broadcast(one.select(F.col("n_docs").alias("docs")))).agg(  # one row on that side
            F.min(F.when(need, F.col("n_tokens_of"))).alias(f"length_q{round(q * 100)}")
        )
        one = one.crossJoin(got)  # one row on each side
    return one
