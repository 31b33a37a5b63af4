"""Per-row features of a symbol sequence, as native Column expressions.

Everything here is a Catalyst expression (string functions and higher-order
array functions), so it runs inside whole-stage codegen with no Python worker
and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .util import as_col, json_bool, json_string


# ---------------------------------------------------------------- C1 counts
def count_symbol(seq, symbol: str) -> Column:
    s = as_col(seq)
    return (F.length(s) - F.length(F.translate(s, symbol, ""))).cast("bigint")


def narrow_peaks(seq) -> Column:
    return count_symbol(seq, K.NARROW)


def wide_peaks(seq) -> Column:
    return count_symbol(seq, K.WIDE)


def total_peaks(seq) -> Column:
    s = as_col(seq)
    return (F.length(s) - F.length(F.translate(s, K.NARROW + K.WIDE, ""))).cast("bigint")


# ---------------------------------------------------------------- C2 noise %
def noise_pct(seq) -> Column:
    """(noise + artifact) / length * 100, 2 decimals; null for an empty string."""
    s = as_col(seq)
    n = count_symbol(s, K.NOISE) + count_symbol(s, K.ARTIFACT)
    return F.round(F.try_divide(n.cast("double") * F.lit(100.0), F.length(s).cast("double")), 2)


# ---------------------------------------------------------------- C4 artifact flag
def artifact_flag(seq) -> Column:
    """Artifact share > 0.05, strict, in integers: n * 20 > length."""
    s = as_col(seq)
    return (count_symbol(s, K.ARTIFACT) * K.ARTIFACT_SHARE_DENOM) > F.length(s)


# ---------------------------------------------------------------- C6 / C7 labels
def label_by_threshold(total) -> Column:
    t = as_col(total)
    return (F.when(t <= K.BRADY_MAX_PEAKS, F.lit(K.CLASSES[0]))
            .when(t <= K.NORMAL_MAX_PEAKS, F.lit(K.CLASSES[1]))
            .when(t.isNotNull(), F.lit(K.CLASSES[2])))


def class_index(label) -> Column:
    """0, 1, 2 for the three classes; null otherwise."""
    lab = as_col(label)
    out = None
    for i, c in enumerate(K.CLASSES):
        out = (F.when(lab == c, F.lit(i)) if out is None else out.when(lab == c, F.lit(i)))
    return out


def next_class(label) -> Column:
    """The following class in class order (the last wraps to the first)."""
    lab = as_col(label)
    n = len(K.CLASSES)
    out = None
    for i, c in enumerate(K.CLASSES):
        nxt = F.lit(K.CLASSES[(i + 1) % n])
        out = F.when(lab == c, nxt) if out is None else out.when(lab == c, nxt)
    return out


# ---------------------------------------------------------------- C10 peaks
def peak_index(seq) -> Column:
    """ARRAY<INT> of 0-based positions of ``|`` and ``:`` (empty for '')."""
    s = as_col(seq)
    idx = F.filter(F.sequence(F.lit(0), F.greatest(F.length(s) - 1, F.lit(0))),
                   lambda i: F.substring(s, i + 1, 1).isin(K.NARROW, K.WIDE))
    # sequence(0, -1) is [0, -1], so the empty string is guarded
    return F.when(F.length(s) > 0, idx).otherwise(F.array().cast("array<int>"))


def peak_positions(seq) -> Column:
    """ARRAY<STRUCT<pos BIGINT, kind STRING>> of 0-based peak positions."""
    s = as_col(seq)
    return F.transform(peak_index(s), lambda i: F.struct(
        i.cast("bigint").alias("pos"), F.substring(s, i + 1, 1).alias("kind")))


# ---------------------------------------------------------------- C11 intervals
def intervals_from_index(pos) -> Column:
    """Distances between consecutive positions, ARRAY<BIGINT> (unclamped)."""
    p = as_col(pos)
    k = F.greatest(F.size(p) - 1, F.lit(0))
    iv = F.zip_with(F.slice(p, 2, k), F.slice(p, 1, k), lambda b, a: (b - a).cast("bigint"))
    return F.when(F.size(p) >= 2, iv).otherwise(F.array().cast("array<bigint>"))


def peak_intervals(seq) -> Column:
    return intervals_from_index(peak_index(seq))


def rr_from_intervals(iv, clamp: bool = True) -> Column:
    lo, hi = K.RR_CLAMP
    d = F.transform(as_col(iv), lambda x: x.cast("double"))
    if clamp:
        d = F.transform(d, lambda x: F.greatest(F.lit(float(lo)), F.least(x, F.lit(float(hi)))))
    return F.when(F.size(as_col(iv)) >= 1, d).otherwise(F.array(F.lit(K.RR_SINGLE)))


def rr_intervals(seq, clamp: bool = True) -> Column:
    """ARRAY<DOUBLE> of intervals, clamped to [5, 50]; [1.0] for < 2 peaks."""
    return rr_from_intervals(peak_intervals(seq), clamp)


# ---------------------------------------------------------------- C3 irregularity
def irregularity_from_index(pos) -> Column:
    """Population std / mean of the intervals between positions, 3 decimals;
    0 when fewer than 2 intervals. One pass over the positions accumulates
    n, sum and sum of squares of the gaps in integers, so every engine gets
    the same double: sqrt(n*sum(x^2) - sum(x)^2) / sum(x)."""
    big = lambda v: F.lit(v).cast("bigint")
    zero = F.struct(big(-1).alias("prev"), big(0).alias("n"), big(0).alias("s1"), big(0).alias("s2"))

    def step(a, x):
        gap = x.cast("bigint") - a["prev"]
        first = F.struct(x.cast("bigint").alias("prev"), big(0).alias("n"), big(0).alias("s1"),
                         big(0).alias("s2"))
        more = F.struct(x.cast("bigint").alias("prev"), (a["n"] + 1).alias("n"),
                        (a["s1"] + gap).alias("s1"), (a["s2"] + gap * gap).alias("s2"))
        return F.when(a["prev"] < 0, first).otherwise(more)

    def finish(a):
        val = F.sqrt((a["n"] * a["s2"] - a["s1"] * a["s1"]).cast("double")) / a["s1"].cast("double")
        return F.when((a["n"] >= 2) & (a["s1"] > 0), F.round(val, 3)).otherwise(F.lit(0.0))

    return F.aggregate(as_col(pos), zero, step, finish)


def rr_irregularity(seq) -> Column:
    return irregularity_from_index(peak_index(seq))


# ---------------------------------------------------------------- C5 concepts
def concepts(seq, irregularity=None) -> Column:
    """Five-field concept struct. ``irregularity`` defaults to the measured
    interval irregularity; pass ``F.lit(0.05)`` for the sequence-only form,
    or ``irregularity_from_intervals(col)`` after :func:`with_peak_columns`."""
    s = as_col(seq)
    irr = rr_irregularity(s) if irregularity is None else as_col(irregularity)
    return F.struct(
        narrow_peaks(s).alias(K.CONCEPT_KEYS[0]),
        wide_peaks(s).alias(K.CONCEPT_KEYS[1]),
        noise_pct(s).alias(K.CONCEPT_KEYS[2]),
        irr.cast("double").alias(K.CONCEPT_KEYS[3]),
        artifact_flag(s).alias(K.CONCEPT_KEYS[4]),
    )


def concepts_or_stored(df_columns, seq="sequence", stored="concepts") -> Column:
    """Reuse a stored concept struct when the column exists and is set;
    otherwise derive it from the sequence with the default irregularity."""
    derived = concepts(seq, F.lit(K.DEFAULT_IRREGULARITY))
    if stored in df_columns:
        return F.coalesce(F.col(stored), derived)
    return derived


def concepts_json(c, indent: int = 2) -> Column:
    """Concept struct as JSON text with ``indent`` spaces (field order kept);
    a null struct renders as ``{}``."""
    c = as_col(c)
    pad = " " * indent
    body = F.concat(
        F.lit("{\n"),
        F.concat_ws(
            ",\n",
            *[F.concat(F.lit(f'{pad}"{k}": '),
                       json_bool(c[k]) if k == K.CONCEPT_KEYS[4] else c[k].cast("string"))
              for k in K.CONCEPT_KEYS],
        ),
        F.lit("\n}"),
    )
    return F.when(c.isNull(), F.lit("{}")).otherwise(body)


# ---------------------------------------------------------------- C13 target JSON
def target_json(seq, label, indent: int | None = None) -> Column:
    """Peak-summary answer, spaced like Python ``json.dumps``:
    ``{"Narrow_peaks": 3, "Wide_peaks": 5, "Total_peaks": 8, "Label": "Normal"}``;
    with ``indent`` one key per line."""
    s = as_col(seq)
    vals = [narrow_peaks(s).cast("string"), wide_peaks(s).cast("string"),
            total_peaks(s).cast("string"),
            F.coalesce(json_string(label), F.lit("null"))]
    pairs = [F.concat(F.lit(f'"{k}": '), v) for k, v in zip(K.TARGET_KEYS, vals)]
    if indent is None:
        return F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))
    pad = " " * indent
    return F.concat(F.lit("{\n" + pad), F.concat_ws(",\n" + pad, *pairs), F.lit("\n}"))
