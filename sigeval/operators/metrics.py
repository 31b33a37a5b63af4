"""H / I — correctness metrics, dataset statistics and experiment comparisons.

Every metric is a grouped aggregate with map-side partial aggregation, so a
class (or run) holding most of the rows costs one partial row per map task,
not one task holding all its rows. Ratios use ``try_divide`` (0 when empty,
as in the studied pipeline) and are rounded to 6 places so sums do not depend
on the order partitions finish in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import features as X
from .arrays import TOKEN_PATTERN

RATIO_DIGITS = 6


SCALE = 10.0 ** RATIO_DIGITS


def ratio(num, den) -> Column:
    """``num / den`` rounded half-up to 6 places, 0 when ``den`` is 0.

    The quotient is scaled before rounding (``round(num * 1e6 / den) / 1e6``):
    a tie is then an exactly representable ``x.5``, so every engine rounds it
    the same way (rounding ``num / den`` at the 6th decimal would depend on
    how each engine reads the binary value)."""
    q = F.try_divide(num.cast("double") * F.lit(SCALE), den.cast("double"))
    return F.coalesce(F.round(q, 0) / F.lit(SCALE), F.lit(0.0))


# ---------------------------------------------------------------- H1
def accuracy(pred: DataFrame, correct_col: str = "correct") -> DataFrame:
    """One row: correct, total, accuracy (0 when empty)."""
    return pred.agg(
        F.count_if(F.col(correct_col)).cast("bigint").alias("correct"),
        F.count(F.lit(1)).cast("bigint").alias("total"),
    ).withColumn("accuracy", ratio(F.col("correct"), F.col("total")))


# ---------------------------------------------------------------- H2 / H3
def per_class_fixed(pred: DataFrame, label_col: str = "label", correct_col: str = "correct",
                    classes=K.CLASSES) -> DataFrame:
    """Per class over the fixed classes; empty classes kept with zeros;
    unknown true labels are not counted here (they are in :func:`accuracy`).
    One conditional aggregate (a single partial row per map task), then the
    one-row result is unpivoted to one row per class."""
    lab, ok = F.col(label_col), F.col(correct_col)
    counters = []
    for i, c in enumerate(classes):
        counters += [F.count_if((lab == c) & ok).cast("bigint").alias(f"tp{i}"),
                     F.count_if(lab == c).cast("bigint").alias(f"n{i}")]
    one = pred.agg(*counters)
    rows = F.array(*[F.struct(F.lit(i).cast("bigint").alias("ord"), F.lit(c).alias("label"),
                              F.col(f"tp{i}").alias("tp"), F.col(f"n{i}").alias("total"))
                     for i, c in enumerate(classes)])
    return one.select(F.inline(rows)).withColumn("accuracy", ratio(F.col("tp"), F.col("total")))


def per_class_observed(pred: DataFrame, label_col: str = "label",
                       correct_col: str = "correct") -> DataFrame:
    """Per observed true label, sorted by label (the sort runs on the
    aggregated rows, one per label)."""
    return (pred.groupBy(label_col)
                .agg(F.count_if(F.col(correct_col)).cast("bigint").alias("correct"),
                     F.count(F.lit(1)).cast("bigint").alias("total"))
                .withColumn("accuracy", ratio(F.col("correct"), F.col("total")))
                .orderBy(label_col))


# ---------------------------------------------------------------- H4
def metrics_long(pred: DataFrame, task: int, n_shots: int, approach: str, ood: bool,
                 model: str, run_ts: str | None = None, label_col: str = "label",
                 correct_col: str = "correct", classes=K.CLASSES) -> DataFrame:
    """Long ``(ord, metric, value)`` table: run rows then 3 rows per class,
    all values as strings (Python ``str`` spelling for booleans). The
    timestamp row is only added when ``run_ts`` is given."""
    # one pass: overall and per-class counters in a single aggregate
    lab, ok = F.col(label_col), F.col(correct_col)
    counters = [F.count_if(ok).cast("bigint").alias("correct"),
                F.count(F.lit(1)).cast("bigint").alias("total")]
    for c in classes:
        counters += [F.count_if((lab == c) & ok).cast("bigint").alias(f"{c}_tp"),
                     F.count_if(lab == c).cast("bigint").alias(f"{c}_tot")]
    both = pred.agg(*counters).select(
        "*", ratio(F.col("correct"), F.col("total")).alias("accuracy"),
        *[ratio(F.col(f"{c}_tp"), F.col(f"{c}_tot")).alias(f"{c}_acc") for c in classes])
    rows = [
        (K.RUN_METRICS[0], F.col("accuracy").cast("string")),
        (K.RUN_METRICS[1], F.col("correct").cast("string")),
        (K.RUN_METRICS[2], F.col("total").cast("string")),
        (K.RUN_METRICS[3], F.lit(str(task))),
        (K.RUN_METRICS[4], F.lit(str(n_shots))),
        (K.RUN_METRICS[5], F.lit(approach)),
        (K.RUN_METRICS[6], F.lit(str(bool(ood)))),
        (K.RUN_METRICS[7], F.lit(model)),
    ]
    if run_ts is not None:
        rows.append(("Timestamp", F.lit(run_ts)))
    for c in classes:
        names = [m.format(cls=c) for m in K.CLASS_METRICS]
        rows += [(names[0], F.col(f"{c}_acc").cast("string")),
                 (names[1], F.col(f"{c}_tp").cast("string")),
                 (names[2], F.col(f"{c}_tot").cast("string"))]
    arr = F.array(*[F.struct(F.lit(i).cast("bigint").alias("ord"), F.lit(m).alias("metric"),
                             v.alias("value")) for i, (m, v) in enumerate(rows)])
    return both.select(F.inline(arr))


# ---------------------------------------------------------------- H5
def run_summary(pred: DataFrame, label_col: str = "label", correct_col: str = "correct",
                **meta) -> DataFrame:
    """One row: run metadata, totals and a ``per_class`` map keyed by label.
    Totals are summed from the (small) per-class table, so the predictions
    are read once."""
    per = per_class_observed(pred, label_col, correct_col)
    out = per.agg(
        F.sum("total").cast("bigint").alias("total_samples"),
        F.sum("correct").cast("bigint").alias("correct"),
        F.map_from_entries(F.collect_list(F.struct(
            F.col(label_col), F.struct("correct", "total", "accuracy")))).alias("per_class"))
    metas = [F.lit(v).alias(k) for k, v in meta.items()]
    return out.select(*metas, F.coalesce("total_samples", F.lit(0)).alias("total_samples"),
                      F.coalesce("correct", F.lit(0)).alias("correct"),
                      ratio(F.col("correct"), F.col("total_samples")).alias("accuracy"), "per_class")


# ---------------------------------------------------------------- H7
def weighted_f1(pred: DataFrame, true_col: str = "label", pred_col: str = "pred") -> DataFrame:
    """Accuracy and F1 weighted by true support over the union of true and
    predicted labels (a label never predicted or never right scores 0).

    The data is read once into a confusion table (one row per (true,
    predicted) pair, combined map-side). Each cell then counts once for its
    true label (support, hits) and once for its predicted label, through a
    two-element explode and one grouped sum — no join."""
    conf = pred.groupBy(F.col(true_col).alias("y"), F.col(pred_col).alias("p")).agg(
        F.count(F.lit(1)).alias("c"))
    hit = F.when(F.col("y") == F.col("p"), F.col("c")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    roles = F.array(
        F.struct(F.col("y").alias("lab"), F.col("c").alias("support"), hit.cast("bigint").alias("tp"),
                 zero.alias("n_pred")),
        F.struct(F.col("p").alias("lab"), zero.alias("support"), zero.alias("tp"),
                 F.col("c").alias("n_pred")))
    per_label = (conf.select(F.inline(roles)).groupBy("lab")
                     .agg(F.sum("support").alias("support"), F.sum("tp").alias("tp"),
                          F.sum("n_pred").alias("n_pred")))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("n_pred")), F.lit(0.0))
    return per_label.agg(
        F.coalesce(F.sum("support"), F.lit(0)).cast("bigint").alias("total"),
        F.coalesce(F.sum("tp"), F.lit(0)).cast("bigint").alias("correct"),
        F.sum(F.col("support") * f1).alias("_wf1"),
    ).select("total", "correct", ratio(F.col("correct"), F.col("total")).alias("accuracy"),
             ratio(F.col("_wf1"), F.col("total")).alias("weighted_f1"))


# ---------------------------------------------------------------- H8–H11
def class_distribution(df: DataFrame, label_col: str = "label", classes=K.CLASSES) -> DataFrame:
    """Rows per fixed class and percent of all rows (0 when empty), from one
    conditional aggregate."""
    lab = F.col(label_col)
    one = df.agg(F.count(F.lit(1)).cast("bigint").alias("_all"),
                 *[F.count_if(lab == c).cast("bigint").alias(f"n{i}") for i, c in enumerate(classes)])
    rows = F.array(*[F.struct(F.lit(i).cast("bigint").alias("ord"), F.lit(c).alias("label"),
                              F.col(f"n{i}").alias("n")) for i, c in enumerate(classes)])
    return one.select("_all", F.inline(rows)).select(
        "ord", "label", "n",
        ratio(F.col("n") * 100, F.col("_all")).alias("pct"))


def length_stats(df: DataFrame, seq_col: str = "sequence") -> DataFrame:
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                  F.sum(F.length(seq_col)).cast("bigint").alias("n_chars"),
                  ratio(F.sum(F.length(seq_col)), F.count(F.lit(1))).alias("avg_length"))


SYMBOL_NAMES = (("narrow", K.NARROW), ("wide", K.WIDE), ("baseline", K.BASELINE),
                ("noise", K.NOISE), ("artifact", K.ARTIFACT))


def symbol_histogram(df: DataFrame, seq_col: str = "sequence") -> DataFrame:
    """Corpus symbol counts and share of all characters, one row per symbol."""
    sums = df.agg(F.sum(F.length(seq_col)).cast("bigint").alias("_chars"),
                  *[F.sum(X.count_symbol(seq_col, s)).cast("bigint").alias(n) for n, s in SYMBOL_NAMES])
    arr = F.array(*[F.struct(F.lit(i).cast("bigint").alias("ord"), F.lit(n).alias("symbol_name"),
                             F.lit(s).alias("symbol"), F.coalesce(F.col(n), F.lit(0)).alias("n"))
                    for i, (n, s) in enumerate(SYMBOL_NAMES)])
    out = sums.select("_chars", F.inline(arr))
    return out.select("ord", "symbol_name", "symbol", "n",
                      ratio(F.col("n") * 100, F.col("_chars")).alias("pct"))


def peak_stats(df: DataFrame, ranges: DataFrame, regime: str = "in",
               label_col: str = "label", peaks_col: str = "total_peaks") -> DataFrame:
    """Min / max / mean peaks per label next to the expected range."""
    agg = df.groupBy(label_col).agg(F.min(peaks_col).cast("bigint").alias("min_peaks"),
                                    F.max(peaks_col).cast("bigint").alias("max_peaks"),
                                    ratio(F.sum(peaks_col), F.count(peaks_col)).alias("mean_peaks"),
                                    F.count(F.lit(1)).cast("bigint").alias("n"))
    r = ranges.where(F.col("regime") == regime).select(F.col("label").alias("_l"), "lo", "hi")
    j = agg.join(F.broadcast(r), agg[label_col] == r["_l"], "left")
    return j.select(label_col, "n", "min_peaks", "max_peaks", "mean_peaks",
                    F.col("lo").alias("expected_lo"), F.col("hi").alias("expected_hi"),
                    ((F.col("min_peaks") >= F.col("lo")) & (F.col("max_peaks") <= F.col("hi")))
                    .alias("within_range"))


def label_mismatches(df: DataFrame, label_col: str = "label", seq_col: str = "sequence") -> DataFrame:
    """H16 — rows per stored label, and those whose label is not the threshold label
    of the peaks recounted in the sequence."""
    recounted = X.label_by_threshold(X.total_peaks(seq_col))
    return df.groupBy(F.col(label_col).alias("label")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.count_if(~recounted.eqNullSafe(F.col(label_col))).cast("bigint").alias("n_mismatch"))


# ---------------------------------------------------------------- H12–H14
def balance_check(head: DataFrame, label_col: str = "label",
                  min_per_class: int = K.BALANCE_MIN_PER_CLASS) -> DataFrame:
    """Counts per present class in a (bounded) head, and whether the smallest
    present class reaches ``min_per_class``. The min runs over the grouped
    counts (one row per class), not over the rows."""
    counts = head.groupBy(label_col).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    smallest = F.min("n").over(Window.partitionBy(F.lit(0)))
    return counts.select(label_col, "n", (smallest >= min_per_class).alias("balanced"))


def token_count(text, pattern: str = TOKEN_PATTERN) -> Column:
    """Default tokenizer stand-in: words and single punctuation marks."""
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(t, F.lit(pattern)), F.lit(0)).cast("bigint")


def token_share(df: DataFrame, prompt_col: str = "prompt", completion_col: str = "completion",
                counter=token_count) -> DataFrame:
    """Per row prompt / completion token counts and the completion share (%)."""
    p = counter(prompt_col)
    c = counter(completion_col)
    return df.select("*", p.alias("prompt_tokens"), c.alias("completion_tokens")).withColumn(
        "completion_share", ratio(F.col("completion_tokens") * 100,
                                  F.col("prompt_tokens") + F.col("completion_tokens")))


def token_share_total(rows: DataFrame) -> DataFrame:
    """Overall prompt / completion token totals and completion share (%),
    from the per-row counts of :func:`token_share` (one aggregate)."""
    return rows.agg(F.sum("prompt_tokens").cast("bigint").alias("prompt_tokens"),
                    F.sum("completion_tokens").cast("bigint").alias("completion_tokens")).select(
        "prompt_tokens", "completion_tokens",
        ratio(F.col("completion_tokens") * 100, F.col("prompt_tokens") + F.col("completion_tokens"))
        .alias("completion_share"))


def step_budget(n_rows: Column, batch: int, accum: int, epochs: int, warmup_ratio: float) -> list[Column]:
    """Optimizer steps and warm-up steps from a row count (integer arithmetic)."""
    steps = F.floor(F.floor(n_rows / batch) * epochs / accum).cast("bigint")
    warm = F.floor(steps.cast("double") * F.lit(float(warmup_ratio))).cast("bigint")
    return [steps.alias("total_steps"), warm.alias("warmup_steps")]


# ---------------------------------------------------------------- I2 / I3
def ood_drop(per_run: DataFrame, keys=("model", "n_per_class")) -> DataFrame:
    """In-distribution vs OOD accuracy per key and the drop between them,
    from per-run correct/total counts."""
    return (per_run.groupBy(*keys).agg(
        F.sum(F.when(~F.col("ood"), F.col("correct"))).alias("_ci"),
        F.sum(F.when(~F.col("ood"), F.col("total"))).alias("_ti"),
        F.sum(F.when(F.col("ood"), F.col("correct"))).alias("_co"),
        F.sum(F.when(F.col("ood"), F.col("total"))).alias("_to"))
        .select(*keys, ratio(F.col("_ci"), F.col("_ti")).alias("acc_in"),
                ratio(F.col("_co"), F.col("_to")).alias("acc_ood"))
        .withColumn("drop", F.round(F.col("acc_in") - F.col("acc_ood"), RATIO_DIGITS)))


def hypothesis_verdict(drops: DataFrame) -> DataFrame:
    """Criteria per shot count: base model in-distribution accuracy above the
    bar, OOD drop above the bar, against random and target accuracy, and
    whether the tuned model's OOD accuracy beats the base model's."""
    base = drops.where(F.col("model") == "base").select(
        "n_per_class", F.col("acc_in").alias("base_acc_in"), F.col("acc_ood").alias("base_acc_ood"),
        F.col("drop").alias("base_drop"))
    tuned = drops.where(F.col("model") == "tuned").select(
        "n_per_class", F.col("acc_ood").alias("tuned_acc_ood"))
    j = base.join(tuned, "n_per_class", "left")
    return j.select(
        "n_per_class", "base_acc_in", "base_acc_ood", "base_drop", "tuned_acc_ood",
        (F.col("base_acc_in") > K.IN_DISTRIBUTION_MIN_ACCURACY).alias("in_dist_ok"),
        (F.col("base_drop") > K.OOD_MIN_DROP).alias("ood_degrades"),
        (F.col("base_acc_in") > K.RANDOM_GUESS_ACCURACY).alias("beats_random"),
        (F.col("base_acc_in") >= K.TARGET_ACCURACY).alias("meets_target"),
        F.coalesce(F.col("tuned_acc_ood") > F.col("base_acc_ood"), F.lit(False)).alias("tuned_recovers"))
