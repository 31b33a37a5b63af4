"""I — the experiment grid on real completions: shots x regime x model.

One prompt per (model, shots, test row) is completed through the reply log and
stored; the regimes are views of the same replies, so no prompt is paid for
twice. All reports are grouped aggregates over the stored replies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from . import parse as P
from . import render as R
from .metrics import ratio
from .reply_log import complete_logged, logged_replies

GRID = [(n, shots, ood, model) for n, (shots, ood, model) in enumerate(
    (s, o, m) for s in K.SHOT_GRID for o in (False, True) for m in ("base", "tuned"))]


def in_ranges(ranges, label: str = "label", peaks: str = "total_peaks") -> Column:
    cond = F.lit(False)
    for c, lo, hi in ranges:
        cond = cond | ((F.col(label) == c) & F.col(peaks).between(lo, hi))
    return cond


def regimes() -> Column:
    """ARRAY<BOOLEAN>: false if the row lies in the in-distribution range of its
    label, true if in the shifted one; a row may lie in both."""
    return F.filter(F.array(F.when(in_ranges(K.IN_RANGES), F.lit(False)), F.when(in_ranges(K.OOD_RANGES), F.lit(True))),
                    lambda x: x.isNotNull())


def grid_prompts(test: DataFrame, examples: DataFrame, shots=K.SHOT_GRID, system_prompt: str = K.TUNED_SYSTEM_PROMPT
                 ) -> DataFrame:
    """``(run, id, messages)``: every test row of a regime under every model and
    number of shots. ``examples``: (id, sequence, label, shuffle_key,
    class_rank), of which each block takes the first of every class."""
    system = R.load_prompt("regular", "system_prompt")
    zero, few = (R.load_prompt("regular", f"user_prompt_{t}_shot") for t in ("zero", "few"))
    seq, prompts = F.col("sequence"), []
    for n in shots:
        chosen = examples.where(F.col("class_rank") < n)
        block = R.block_text(chosen) if n else None
        tuned = R.block_text(chosen, R.tuned_block) if n else None
        base = R.messages(None, system, R.user_prompt(seq, zero, few, block))
        prompts.append(F.struct(F.lit(f"base-{n}").alias("run"), base.alias("messages")))
        content = R.tuned_user_content(seq, system_prompt, tuned)
        prompts.append(F.struct(F.lit(f"tuned-{n}").alias("run"), F.array(
            F.struct(F.lit("user").alias("role"), content.alias("content"))).alias("messages")))
    return (test.where(F.size(regimes()) > 0).select("id", F.explode(F.array(*prompts)).alias("p"))
            .select("p.run", "id", "p.messages"))


def run_grid(test: DataFrame, examples: DataFrame, clients: dict, log_path: str, **options) -> DataFrame:
    """Completes the grid (``clients``: model -> client factory) and scores it:
    one row per run and test row ``(run, n_per_class, ood, model, id, label,
    correct)``. The base model's replies are read by keyword, the tuned one's as
    embedded JSON."""
    prompts = grid_prompts(test, examples)
    for model, factory in clients.items():
        complete_logged(prompts.where(F.col("run").startswith(f"{model}-")), factory, log_path, **options)
    replies = (logged_replies(test.sparkSession, log_path).where("error is null")
               .select("run", "id", F.col("raw_response").alias("reply")))
    model = F.split("run", "-")[0]
    shots = F.split("run", "-")[1].cast("bigint")
    label = F.col("label")
    correct = F.when(model == "base", P.correct_icl(F.coalesce(P.parse_keyword("reply"), F.lit(K.UNKNOWN)), label)) \
        .otherwise(P.correct_tuned(P.parse_embedded_json("reply"), label))
    truth = test.select(F.col("id").alias("_id"), "label", regimes().alias("_regimes"))
    scored = replies.join(truth, replies["id"] == truth["_id"]).select(
        model.alias("model"), shots.alias("n_per_class"), "id", "label", correct.alias("correct"),
        F.explode("_regimes").alias("ood"))
    # the number of a run in the grid
    at = (F.array_position(F.array(*map(F.lit, K.SHOT_GRID)), F.col("n_per_class").cast("int")) - 1) * 4
    number = at + F.when(F.col("ood"), 2).otherwise(0) + F.when(F.col("model") == "tuned", 1).otherwise(0)
    return scored.select(number.cast("bigint").alias("run"), "n_per_class", "ood", "model", "id", "label", "correct")


def per_run(scored: DataFrame) -> DataFrame:
    return scored.groupBy("run", "n_per_class", "ood", "model").agg(
        F.count_if("correct").cast("bigint").alias("correct"), F.count(F.lit(1)).cast("bigint").alias("total"))


def model_compare(scored: DataFrame, n_per_class: int) -> DataFrame:
    """I4 — base against tuned on the same in-distribution rows at
    one number of shots, per class and overall."""
    rows = scored.where((F.col("n_per_class") == n_per_class) & ~F.col("ood"))
    hit = lambda m: F.count_if((F.col("model") == m) & F.col("correct")).cast("bigint")
    return (rows.rollup("label").agg(F.count_if(F.col("model") == "base").cast("bigint").alias("n"),
                                     hit("base").alias("base_correct"), hit("tuned").alias("tuned_correct"))
            .select(F.coalesce("label", F.lit("ALL")).alias("label"), "n", "base_correct", "tuned_correct",
                    ratio(F.col("base_correct"), F.col("n")).alias("base_accuracy"),
                    ratio(F.col("tuned_correct"), F.col("n")).alias("tuned_accuracy")))
