"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Every document gets a few counts; each rule compares two of them with a cutoff.
The cutoffs of all rules form one sequence from loose to strict, and step ``t``
rejects what any cutoff up to ``t`` rejects, so the steps' rejections are nested.
A step is *safe* in a stratum (language) if the labelled good documents prove, at
the chosen confidence, that it wrongly rejects at most a share ``risk`` of them:
with ``n`` good documents of which ``k`` are rejected, the exact binomial tail
``P(Bin(n, risk) <= k)`` must not exceed ``error / strata``. The steps are tested
in order until one fails, each at that whole level: as the sequence is fixed
beforehand, this needs no correction for the number of steps, while the strata are
corrected by Bonferroni. The least step that rejects most labelled bad documents
among the safe ones is used; a stratum without one keeps all that the base rule
keeps. With probability ``1 - error`` all strata together keep a share of at least
``1 - risk`` of their good documents (beyond the fixed base rule). With four
strata, a stratum can act from 436 labelled good documents.

Two passes: the counts of all documents are written once (a few numbers per
document) and read for the thresholds and for the verdicts. The thresholds have
one row per stratum.

Edge cases: null text has no words; null language is a stratum of its own; a
label of a document that is repeated counts as its lowest value, null labels
and labels of unknown documents not at all; repeated and null ids give one row
per input row; without labels only the base rule rejects; an empty table gives
no rows; a ``labels`` table may hold other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SPACE, materialize, text_or_empty

RISK = 0.01
ERROR = 0.05
# rule: condition for rejection in terms of the counts, cutoffs from loose to strict
RULES = (
    ("symbols", "1000 * n_symbols > {c} * word_chars", (300, 200, 150, 100, 70, 50, 30, 20, 10)),
    ("dup_lines", "1000 * n_dup_lines > {c} * n_lines", (600, 500, 400, 300, 200, 100, 50)),
    ("repeats", "1000 * n_repeat_words > {c} * n_words", (450, 400, 350, 300, 250, 200, 150, 100)),
    ("long_words", "10 * word_chars > {c} * n_words", (200, 150, 120, 100, 90, 80, 70)),
    ("short_words", "10 * word_chars < {c} * n_words", (20, 25, 30, 35, 40, 45)),
)
# fixed values: the base rule
BASE_RULE = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("bigint")


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts of :data:`COUNTS` and ``n_lines`` (lines with a
    word). Arrays stay inside their row; nothing is shuffled."""
    keep = docs.columns
    bare = text_or_empty(text_col)
    for s in SYMBOLS:
        bare = F.replace(bare, F.lit(s), F.lit(""))
    text = text_or_empty(text_col)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(*keep,
                     F.array_remove(F.split(text, WORD_SPACE), "").alias("_words"),
                     (F.length(text) - F.length(bare)).cast("bigint").alias("n_symbols"),
                     lines.alias("_lines"))
    # the hash of the three words that start at each place
    n = F.size("_words")
    triples = F.when(n >= 3, F.transform(
        F.slice("_words", F.lit(1), n - 2),
        lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2))))
    df = df.select(*keep, "n_symbols", n.cast("bigint").alias("n_words"),
                   F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
                   F.size("_lines").cast("bigint").alias("n_lines"),
                   (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
                   triples.alias("_h"))
    base = [*keep, "n_symbols", "n_words", "word_chars", "n_lines", "n_dup_lines"]
    # places sorted by hash: equal triples become neighbours
    df = df.select(*base, F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(
        F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"))
    twice = F.filter("_s", lambda x, j: (x["h"] == F.get("_s", j - 1)["h"]) | (x["h"] == F.get("_s", j + 1)["h"]))
    df = df.select(*base, F.sort_array(F.transform(twice, lambda x: x["i"])).alias("_at"))
    covered = F.aggregate(F.transform("_at", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("_at", j + 1) - p, F.lit(3)))),
                          F.lit(0), lambda a, b: a + b)
    return df.select(*base, _zero(covered).alias("n_repeat_words"))


def _critical(n: Column, rate: float, level: Column) -> Column:
    """Largest ``k`` with ``P(Bin(n, rate) <= k) <= level``, -1 if none. It
    lies below the mean ``n * rate``, so the sum needs no more terms."""
    step = F.log(F.lit(rate / (1 - rate)))
    zero = F.struct((n * F.log(F.lit(1 - rate))).cast("double").alias("term"), F.lit(0.0).alias("sum"),
                    F.lit(-1).cast("bigint").alias("best"))

    def add(state, k):
        total = state["sum"] + F.exp(state["term"])
        return F.struct(
            (state["term"] + F.log(F.greatest((n - k).cast("double"), F.lit(1e-300))) - F.log((k + 1).cast("double"))
             + step).cast("double").alias("term"),
            total.alias("sum"), F.when(total <= level, k).otherwise(state["best"]).alias("best"))

    return F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.ceil(n * rate).cast("bigint")), zero, add,
                       lambda s: s["best"])


def _measured(docs: DataFrame, stratum_col: str, with_row: bool) -> DataFrame:
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")] if with_row else []
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                         F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("_stratum"),
                         F.col("text").alias("_text"), *row)
    measured = counts(source, "_text").drop("_text").withColumn("base_failed", F.expr(BASE_RULE))
    return materialize(measured, "quality-counts")


def sequence(rules=RULES) -> list[tuple[str, int]]:
    """(condition, cutoff) of all rules from loose to strict: by their place
    within their rule, then by rule."""
    order = sorted(((i + 1) / len(cuts), r, i) for r, (_, _, cuts) in enumerate(rules) for i in range(len(cuts)))
    return [(rules[r][1], rules[r][2][i]) for _, r, i in order]


def first_step(rules=RULES) -> Column:
    """The step of the sequence at which a document is first rejected, null if
    never."""
    return F.array_min(F.array(*(F.when(F.expr(rule.format(c=c)), n)
                                 for n, (rule, c) in enumerate(sequence(rules)))))


def last_safe_step(measured: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR,
                   rules=RULES) -> DataFrame:
    """One row per stratum, with the step ``_cut`` up to which the combined
    sequence rejects (null: nothing). ``measured`` has ``doc_id``, ``_stratum``,
    ``base_failed`` and ``_step`` (:func:`first_step`).

    What a step rejects holds all that the steps before reject, so the safe steps
    are those before the first failure."""
    truth = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
             .groupBy(F.col("doc_id").alias("_id")).agg((F.min("quality") >= 1).alias("_good")))
    held = measured.where(~F.col("base_failed")).join(truth, F.col("doc_id") == F.col("_id"))
    good, steps = F.col("_good"), range(sum(len(cuts) for _, _, cuts in rules))
    sums = [F.sum(F.when((F.col("_step") <= t) & (good if kind == "good" else ~good), 1).otherwise(0)).alias(f"{kind}_{t}")
            for t in steps for kind in ("good", "bad")]
    found = held.groupBy("_stratum").agg(F.sum(F.when(good, 1).otherwise(0)).alias("_n"), *sums)
    # one row per stratum, so this window is as small at every size of the corpus
    found = (found.withColumn("_strata", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
             .withColumn("_k", _critical(F.col("_n"), risk, F.lit(error) / F.col("_strata"))))
    # the least step of those that reject most bad documents
    safe = F.array_compact(F.array(*(
        F.when((F.col(f"good_{t}") <= F.col("_k")) & (F.col(f"bad_{t}") > 0),
               F.struct(F.col(f"bad_{t}").alias("bad"), F.lit(-t).alias("loose"))) for t in steps)))
    return found.select("_stratum", "_n", "_k", (-F.array_max(safe)["loose"]).alias("_cut"))


def judge(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", with_row: bool = False,
          risk: float = RISK, error: float = ERROR, rules=RULES) -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` of every row of
    ``docs``; ``with_row`` adds the whole input row as struct ``_row``."""
    measured = _measured(docs, stratum_col, with_row).withColumn("_step", first_step(rules))
    cuts = materialize(last_safe_step(measured, labels, risk, error, rules), "quality-cutoffs")
    rejected = F.col("base_failed") | F.coalesce(F.col("_step") <= F.col("_cut"), F.lit(False))
    return (measured.join(cuts, "_stratum", "left")
            .select("doc_id", *COUNTS, "base_failed", (~rejected).alias("kept"), *(["_row"] if with_row else [])))


def kept_documents(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang",
                   risk: float = RISK, error: float = ERROR, rules=RULES) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with all their columns."""
    return judge(docs, labels, stratum_col, True, risk, error, rules).where("kept").select("_row.*")


def oracle(risk: float = RISK, error: float = ERROR, rules=RULES) -> str:
    """DuckDB SQL of :func:`judge` over ``documents`` and ``labels``."""
    steps = ", ".join(f"case when {rule.format(c=c)} then {n} end" for n, (rule, c) in enumerate(sequence(rules)))
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t, coalesce(lang, '') as s from documents),
a as (select r, doc_id, s, t,
        list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from d),
places as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
           from (select r, w, unnest(range(1, len(w) - 1)) as i from a)),
twice as (select r, i from (select r, i, count(*) over (partition by r, g) as n from places) where n > 1),
covered as (select r, sum(least(3, coalesce(nxt - i, 3))) as n from
            (select r, i, lead(i) over (partition by r order by i) as nxt from twice) group by r),
m as (select a.r, doc_id, s, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, len(l) as n_lines,
        len(l) - len(list_distinct(l)) as n_dup_lines, cast(coalesce(covered.n, 0) as bigint) as n_repeat_words
      from a left join covered on covered.r = a.r),
base as (select *, ({BASE_RULE}) as base_failed, least({steps}) as step from m),
truth as (select doc_id, min(quality) >= 1 as good from labels where quality is not null group by doc_id),
held as (select base.*, good from base join truth on truth.doc_id = base.doc_id where not base_failed),
sizes as (select s, count(*) filter (good) as n, count(*) over () as strata from held group by s),
terms as (select s, n, strata, i, n * ln(1 - {risk}) + coalesce(sum(ln(n - i + 1) - ln(i) + ln({risk} / (1 - {risk})))
            filter (i > 0) over (partition by s order by i), 0) as term
          from (select s, n, strata, unnest(range(0, cast(ceil(n * {risk}) as bigint) + 1)) as i from sizes)),
tails as (select s, strata, i, sum(exp(term)) over (partition by s order by i) as p from terms),
crit as (select sizes.s, coalesce(max(i) filter (p <= {error} / tails.strata), -1) as k
         from sizes left join tails on tails.s = sizes.s group by sizes.s),
hits as (select s, step, count(*) filter (good) as g, count(*) filter (not good) as b
         from held where step is not null group by s, step),
trial as (select s, step, sum(g) over (partition by s order by step) as g, sum(b) over (partition by s order by step) as b
          from hits),
chosen as (select s, step as cut from (select trial.*, row_number() over (partition by trial.s order by b desc, step) as o
           from trial join crit on crit.s = trial.s where g <= k and b > 0) where o = 1)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars,
  cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or coalesce(step <= cut, false)) as kept
from base left join chosen on chosen.s = base.s"""
