"""End-to-end runs composed from the operators: the four things a user of the
studied pipeline does — build the datasets, evaluate with few-shot prompts,
evaluate a tuned model, and build training records.

Each run is a handful of DataFrame transformations plus one completion step.
Replies are stored once, in a checkpoint (``persist_completions``) or, where a
``reply_log`` is named, in a log that a restarted run goes on with (see
:mod:`sigeval.operators.reply_log`); parsing, metrics and every sink read the
stored replies and never call the model again.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import constants as K
from .functions import features as X
from .operators import metrics as M
from .operators import parse as P
from .operators import render as R
from .operators import sampling as G
from .operators.augment import augment_noise
from .operators.complete import complete_batch, persist_completions
from .operators.encode import encode_sequences
from .operators.reply_log import complete_logged
from .plans.tables import split_of
from .sources import io


def _ood_flag() -> F.Column:
    cond = None
    for c, lo, hi in K.OOD_RANGES:
        x = (F.col("label") == c) & F.col("total_peaks").between(lo, hi)
        cond = x if cond is None else (cond | x)
    return cond


# ---------------------------------------------------------------- dataset build
def sizes_by_split() -> dict:
    """Counts of the labelled table by split (H15), observed while it is written."""
    of = lambda cond: F.count_if(cond).cast("bigint")
    split = F.col("split")
    return {"sequence_length": F.max(F.length("sequence")).cast("bigint"), "n_train_pool": of(split == "train"),
            "icl_total": of(split == "icl"), "test_total": of(split == "test"),
            "test_ood_total": of((split == "test") & _ood_flag())}


def label_sequences(seqs: DataFrame) -> DataFrame:
    """Adds split, counted peaks and the threshold label."""
    tp = X.total_peaks("sequence")
    return seqs.select("*", split_of(F.col("id")).alias("split"), tp.alias("total_peaks"),
                       X.label_by_threshold(tp).alias("label"))


def balanced_split(rows: DataFrame, seed: int = 42, shifted: bool = False) -> DataFrame:
    """As many rows of every class as the smallest one has, in class order; with
    ``shifted`` under the noise and artifact rates of the shifted regime, which
    leave the peaks and so the labels as they are."""
    out = G.balanced_dataset(rows, None, seed)
    if not shifted:
        return out
    return out.withColumn("sequence", augment_noise(F.col("sequence"), F.col("id"), K.OOD_NOISE_PROB, K.OOD_ARTIFACT_PROB))


def build_datasets(events: DataFrame, out_dir: str | None = None, seed: int = 42,
                   n_train_per_class: int | None = None, balanced: bool = False) -> dict[str, DataFrame]:
    """events -> labelled splits (train balanced per class, icl, test, shifted
    test), chat training records and a manifest; written under ``out_dir``
    (metadata CSVs, chat JSONL, manifest JSON) when given. With ``balanced`` the
    other splits are balanced too, and the shifted test rows carry the noise of
    the shifted regime (:func:`balanced_split`)."""
    # read by four branches below: written once to the shared folder, and counted
    # while it is written
    rng = lambda rs: ", ".join(f"{c} {lo}-{hi}" for c, lo, hi in rs)
    lab, sizes = io.write_observed(label_sequences(encode_sequences(events)), "labelled", sizes_by_split())
    train = G.balanced_dataset(lab.where(F.col("split") == "train"), n_train_per_class, seed)
    icl = lab.where(F.col("split") == "icl")
    test = lab.where(F.col("split") == "test")
    ood = test.where(_ood_flag())
    if balanced:
        icl_pos, test_pos, ood_pos = (balanced_split(rows, seed, shifted) for rows, shifted in
                                      ((icl, False), (test, False), (ood, True)))
    else:
        icl_pos, test_pos, ood_pos = (G.shuffle(rows, seed, pos_col="dataset_pos") for rows in (icl, test, ood))
    manifest = events.sparkSession.createDataFrame(
        [(*sizes.values(), rng(K.IN_RANGES), rng(K.OOD_RANGES), K.TUNED_SYSTEM_PROMPT)],
        ", ".join(f"{k} bigint" for k in sizes)
        + ", in_distribution string, out_of_distribution string, finetune_system_prompt string")
    out = {"train": train, "icl": icl_pos, "test": test_pos, "test_ood": ood_pos, "manifest": manifest}
    if out_dir:
        io.write_metadata_csv(train, os.path.join(out_dir, "train", "metadata.csv"), "train")
        io.write_metadata_csv(icl_pos, os.path.join(out_dir, "icl", "metadata.csv"), "icl")
        io.write_metadata_csv(test_pos, os.path.join(out_dir, "test", "test_metadata.csv"), "test")
        io.write_metadata_csv(ood_pos, os.path.join(out_dir, "test", "test_ood_metadata.csv"), "test_ood")
        io.write_chat_jsonl(train, os.path.join(out_dir, "train", "finetune_messages.jsonl"))
        io.write_manifest(manifest, os.path.join(out_dir, "config.json"))
    return out


def _replies(msgs: DataFrame, client_factory, reply_log: str | None, run: str, **options) -> DataFrame:
    if reply_log:
        return complete_logged(msgs, client_factory, reply_log, run, **options).drop("run")
    return persist_completions(complete_batch(msgs, client_factory, **options))


# ---------------------------------------------------------------- few-shot evaluation
def evaluate_icl(examples: DataFrame | None, test: DataFrame, client_factory, *, task: int = 1,
                 n_shots: int = 4, approach: str = "regular", ood: bool = False,
                 model_name: str = "local-model", seed: int = 42, prompts_dir: str | None = None,
                 out_dir: str | None = None, run_ts: str | None = None,
                 num_slots: int | None = None, threads_per_task: int = 1, retries: int = 0,
                 reply_log: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Few-shot evaluation: ``n_shots`` examples per class, one message list
    per test row, batch completion, parsing, scoring. Returns
    ``(predictions, metrics_long)``; writes them under ``out_dir`` partitioned
    by task / model / n_shots / ood when given. With ``reply_log`` the
    replies are kept there under a run named by the same four."""
    R.check_task(task)
    R.check_approach(approach)
    system = R.load_prompt(approach, "system_prompt", task, prompts_dir)
    zero = R.load_prompt(approach, "user_prompt_zero_shot", task, prompts_dir)
    block = None
    few = zero
    if n_shots > 0:
        if examples is None:
            raise ValueError("examples are required when n_shots > 0")
        few = R.load_prompt(approach, "user_prompt_few_shot", task, prompts_dir)
        block = R.block_text(G.load_examples(examples, n_shots, seed), R.few_shot_block, approach)
    msgs = test.select("id", R.messages(test, system, R.user_prompt(F.col("sequence"), zero, few, block))
                       .alias("messages"))
    replies = _replies(msgs, client_factory, reply_log, f"task{task}-{approach}-{model_name}-{n_shots}-{'ood' if ood else 'in'}",
                       num_slots=num_slots, threads_per_task=threads_per_task, retries=retries)
    rows = test.select("id", "sequence", F.col("label").alias("true_class")).join(replies, "id", "left")
    parsed = (P.parse_keyword("raw_response") if approach == "regular"
              else P.parse_fenced_json("raw_response"))
    pred = F.coalesce(parsed, F.lit(K.UNKNOWN))
    predictions = rows.select("id", "sequence", "true_class", pred.alias("predicted_class"),
                              P.correct_icl(pred, F.col("true_class")).alias("correct"),
                              "raw_response", "error")
    metrics = M.metrics_long(predictions, task, n_shots, approach, ood, model_name, run_ts,
                             label_col="true_class")
    if out_dir:
        tag = dict(task=task, model=model_name, n_shots=n_shots, ood=ood)
        part = [F.lit(v).alias(k) for k, v in tag.items()]
        io.write_partitioned(predictions.select("*", *part), os.path.join(out_dir, "predictions"),
                             by=tuple(tag))
        io.write_partitioned(metrics.select("*", *part), os.path.join(out_dir, "metrics"), by=tuple(tag))
    return predictions, metrics


# ---------------------------------------------------------------- tuned evaluation
def evaluate_tuned(test: DataFrame, client_factory, *, system_prompt: str = K.TUNED_SYSTEM_PROMPT,
                   examples: DataFrame | None = None, n_shots: int = 0, max_samples: int | None = None,
                   seed: int = 42, num_slots: int | None = None, threads_per_task: int = 1,
                   retries: int = 0, out_dir: str | None = None, reply_log: str | None = None,
                   run: str = "tuned", **meta) -> tuple[DataFrame, DataFrame]:
    """Tuned-model evaluation: ``system\\n\\nSequence: s`` prompts (optionally
    with numbered example pairs), embedded-JSON parsing, tuned-form scoring.
    Returns ``(predictions, summary)``; with ``out_dir`` writes the
    predictions as CSV and the summary as JSON, with ``reply_log`` keeps the replies
    there under ``run``."""
    rows = G.head_n(test, max_samples)
    block = None
    if n_shots > 0 and examples is not None:
        block = R.block_text(G.load_examples(examples, n_shots, seed), R.tuned_block)
    user = R.tuned_user_content(F.col("sequence"), system_prompt, block)
    msgs = rows.select("id", F.array(F.struct(F.lit("user").alias("role"), user.alias("content")))
                       .alias("messages"))
    replies = _replies(msgs, client_factory, reply_log, run, num_slots=num_slots,
                       threads_per_task=threads_per_task, retries=retries)
    j = rows.select("id", "sequence", F.col("label").alias("true_label")).join(replies, "id", "left")
    pred = P.parse_embedded_json("raw_response")
    predictions = j.select("id", "sequence", "true_label", pred.alias("pred_label"),
                           P.correct_tuned(pred, F.col("true_label")).alias("correct"),
                           F.substring("raw_response", 1, 200).alias("raw_response"), "error")
    summary = M.run_summary(predictions, label_col="true_label", n_shots=n_shots,
                            system_prompt_used=system_prompt, **meta)
    if out_dir:
        io.write_predictions_csv(predictions, os.path.join(out_dir, "predictions.csv"))
        io.write_summary_json(summary, os.path.join(out_dir, "summary.json"))
    return predictions, summary


# ---------------------------------------------------------------- training records
def training_records(train: DataFrame, *, system_prompt: str = K.TUNED_SYSTEM_PROMPT,
                     seed: int = 42, batch: int = 1, accum: int = 4, epochs: int = 3,
                     warmup_ratio: float = 0.1, model_name: str | None = None,
                     out_dir: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Shuffled prompt/completion pairs and a one-row training plan (model name,
    step budget, prompt and answer format); with ``out_dir`` the pairs are written
    as JSON lines and the plan as the training config that
    :func:`sigeval.sources.io.read_training_config` reads."""
    shuffled = G.shuffle(train, seed)
    pairs = shuffled.select("id", "pos", R.tuned_prompt(F.col("sequence"), system_prompt).alias("prompt"),
                            X.target_json("sequence", F.col("label")).alias("completion"))
    plan = train.agg(F.count(F.lit(1)).cast("bigint").alias("num_train_samples")).select(
        "num_train_samples", *M.step_budget(F.col("num_train_samples"), batch, accum, epochs, warmup_ratio),
        F.lit(system_prompt).alias("system_prompt"), F.lit(K.TUNED_USER_TEMPLATE).alias("user_template"),
        F.lit(K.TUNED_RESPONSE_FORMAT).alias("response_format"),
        *([F.lit(model_name).alias("model_name")] if model_name else []))
    if out_dir:
        pairs.select("prompt", "completion").write.mode("overwrite").json(os.path.join(out_dir, "train.jsonl"))
        io.write_manifest(plan, os.path.join(out_dir, "training_config.json"))
    return pairs, plan
