"""F4 over a label table — the first label, in list order, that occurs in a text.

A CASE chain is fine for some dozens of labels. Beyond, the names go into an
Aho-Corasick automaton, which finds all of them in one pass over the text whatever
their number. Names are collected in blocks of at most ``BLOCK_CHARS``
characters; each block makes one automaton, broadcast once, and the least label of
all blocks counts. So a table beyond one block costs more passes, not more memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_CHARS = 16 << 20      # characters of names in one automaton


def name_blocks(labels: DataFrame, block_chars: int) -> Iterator[list[tuple[str, int]]]:
    """(name, label) in blocks, streamed from the table a partition at a time."""
    block, size = [], 0
    for row in labels.toLocalIterator():
        if block and size + len(row.name) > block_chars:
            yield block
            block, size = [], 0
        block.append((row.name, row.label))
        size += len(row.name)
    if block:
        yield block


def least_label_udf(spark, block: list[tuple[str, int]]):
    """Text -> least label of the block's names in it, or null."""
    shared, state = spark.sparkContext.broadcast(block), {}

    @F.pandas_udf("bigint")
    def least(texts: pd.Series) -> pd.Series:
        if "automaton" not in state:
            import ahocorasick
            found: dict[str, int] = {}
            for name, label in shared.value:
                found[name] = min(label, found.get(name, label))
            automaton = ahocorasick.Automaton()
            for name, label in found.items():
                automaton.add_word(name, label)
            automaton.make_automaton()
            state["automaton"] = automaton
        hits = state["automaton"].iter
        return texts.map(lambda t: None if t is None else min((label for _, label in hits(t)), default=None)).astype("Int64")

    return least


def first_label(df: DataFrame, text_col: str, labels: DataFrame, out: str = "pred", missing: int = -1,
                block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Adds ``out``: the least ``label`` whose ``name`` (from ``labels``) occurs
    in the text, or ``missing``. Null and empty names are no names; a null text has
    no label."""
    names = labels.select(F.col("name").cast("string").alias("name"), F.col("label").cast("bigint").alias("label")) \
        .where("name != '' and label is not null")
    found = [least_label_udf(df.sparkSession, block)(F.col(text_col)) for block in name_blocks(names, block_chars)]
    best = F.least(*found) if len(found) > 1 else found[0] if found else F.lit(None).cast("bigint")
    return df.withColumn(out, F.coalesce(best, F.lit(missing).cast("bigint")))
