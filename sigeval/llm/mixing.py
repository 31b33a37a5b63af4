"""Mixing documents to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic). The cells' token weights
are raked: in turn, the weights of each source, language and topic are scaled to
the target share of that value, until all marginals fit together. A cell's
ratio of raked to present weight, times the budget, is how many times its
documents are to be drawn on average: its whole part for certain, and once more
with the rest as probability. Cells whose targets ask for more than they hold are
so repeated, and the expected tokens meet the targets and the budget together.
The draw compares the rest with a uniform number from the document's id and
text, so it is the same in every run.

Cells are counted once; raking and probabilities work on the cell table
(one row per cell that occurs) in DataFrame operations, checkpointed between
rounds of sweeps, until every marginal is within ``TOLERANCE`` of its target. Targets
that no weights of the cells can meet are told by a warning with the distance that is left.
Documents meet their cell in one join with that small table, which Spark
broadcasts only below its size threshold.

Edge cases: null source and language are values of their own, null text counts
as no tokens; documents without tokens are drawn as often as their cell's others,
those of cells without any tokens at the budget's rate;
targets of values that don't occur are ignored and the others scaled up;
repeated rows are drawn alike; an empty table gives no rows.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

DIMS = ("source", "lang", "topic")
TEMPERATURE = 0.7         # default targets: present shares to this power
SWEEPS_AT_ONCE = 4        # between checkpoints
TOLERANCE = 1e-6          # of a marginal, relative to its target
PROGRESS = 0.98           # a round that leaves more than this share of the distance is the last
BUDGET = 0.6              # of all tokens
CHARS_PER_TOKEN = 4
SEED = 20


def topic(text: Column) -> Column:
    """A coarse topic from surface features (native expressions)."""
    return (F.when(text.rlike(r"(?i)licen[sc]e|rights reserved"), "legal")
            .when(text.rlike(r"[\w.]+@\w+\.\w|\+?\d[\d -]{7,}\d"), "contact")
            .when(text.rlike(r"[{}<>|#*]{2}|https?://"), "markup").otherwise("prose"))


def draw(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """Uniform in [0, 1) from the id and the text."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(text.cast("binary"))))
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("bigint") / float(1 << 52)


def measured(docs: DataFrame) -> dict[str, Column]:
    """Expressions for a document's cell, tokens and draw."""
    text = text_or_empty()
    return {"source": F.coalesce(F.col("source").cast("string"), F.lit("")),
            "lang": F.coalesce(F.col("lang").cast("string"), F.lit("")),
            "topic": topic(text), "tokens": F.ceil(F.length(text) / CHARS_PER_TOKEN).cast("bigint"),
            "draw": draw(F.col("doc_id"), text)}


def farthest(cells: DataFrame) -> float:
    """The largest distance of a marginal of ``weight`` from its target, relative to that."""
    misses = [F.when(F.col(f"_goal_{d}") > 0, F.abs(F.sum("weight").over(Window.partitionBy(d)) / F.col(f"_goal_{d}") - 1))
              .otherwise(0.0) for d in DIMS]
    return cells.select(F.greatest(*misses).alias("miss")).agg(F.max("miss")).first()[0] or 0.0


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, temperature: float = TEMPERATURE,
         tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (the dimensions and ``tokens``) with ``weight``, which sums to 1
    and has the target marginals within ``tolerance``; warns where they can't be met."""
    targets = targets or {}
    for d in DIMS:
        present = F.sum("tokens").over(Window.partitionBy(d))
        if d in targets:
            pairs = [x for v, share in targets[d].items() for x in (F.lit(v), F.lit(float(share)))]
            goal = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(d)), F.lit(0.0))
        else:
            goal = F.pow(present.cast("double"), F.lit(temperature))
        cells = cells.withColumn(f"_goal_{d}", goal)
    cells = materialize(cells, "cells")
    # one share per value: divide by the sum over values
    for d in DIMS:
        total = cells.groupBy(d).agg(F.max(f"_goal_{d}").alias("g")).agg(F.sum("g")).first()[0] or 1.0
        cells = cells.withColumn(f"_goal_{d}", F.col(f"_goal_{d}") / F.lit(float(total)))
    everything = cells.agg(F.sum("tokens")).first()[0] or 1
    cells = cells.withColumn("weight", F.col("tokens") / F.lit(float(everything)))
    miss = float("inf")
    while miss > tolerance:
        for _ in range(SWEEPS_AT_ONCE):
            for d in DIMS:
                held = F.sum("weight").over(Window.partitionBy(d))
                cells = cells.withColumn("weight", F.when(held > 0, F.col("weight") * F.col(f"_goal_{d}") / held).otherwise(0.0))
        cells = materialize(cells, "raked")
        before, miss = miss, farthest(cells)
        if miss > max(tolerance, PROGRESS * before):
            warnings.warn(f"the target weights can't be met together: a marginal is off by {miss:.2%} of its target", stacklevel=2)
            break
    total = cells.agg(F.sum("weight")).first()[0] or 1.0
    return cells.select(*DIMS, "tokens", (F.col("weight") / F.lit(float(total))).alias("weight"),
                        F.lit(float(everything)).alias("_all"))


def calibrated(raked: DataFrame, budget: float = BUDGET) -> DataFrame:
    """``raked`` with the cells' ``probability``: how many times a document is
    drawn on average, above 1 where the target exceeds what the cell holds."""
    ratio = F.when(F.col("tokens") > 0, F.col("weight") * F.col("_all") / F.col("tokens")).otherwise(1.0)
    return raked.select(*DIMS, "weight", (F.lit(budget) * ratio).alias("probability"))


def copies() -> Column:
    """How many times a document is drawn, from ``probability`` and ``draw``."""
    whole = F.floor("probability")
    return (whole + F.when(F.col("draw") < F.col("probability") - whole, 1).otherwise(0)).cast("bigint")


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET,
           temperature: float = TEMPERATURE) -> DataFrame:
    """Every document's cell, tokens, probability, whether it is drawn and how
    many times: ``doc_id, source, lang, topic, tokens, weight, probability, kept,
    copies``."""
    rows = materialize(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                                   *(c.alias(n) for n, c in measured(docs).items())), "measured")
    cells = rows.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens"))
    odds = materialize(calibrated(rake(cells, targets, temperature), budget), "odds")
    return (rows.join(odds, list(DIMS)).select("doc_id", *DIMS, "tokens", "weight", "probability",
                                               (copies() > 0).alias("kept"), copies().alias("copies")))


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET,
          temperature: float = TEMPERATURE) -> DataFrame:
    """The rows of ``docs`` that are drawn, as many times as they are, with all
    their columns."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    rows = docs.select(whole, *(c.alias(n) for n, c in measured(docs).items()))
    cells = rows.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens"))
    odds = materialize(calibrated(rake(cells, targets, temperature), budget), "odds")
    drawn = rows.join(odds, list(DIMS)).withColumn("_copies", copies()).where("_copies > 0")
    return drawn.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))).select("_row.*")
