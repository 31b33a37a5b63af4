"""G — seeded sampling, shuffling, splitting and limits.

Randomness is an ``md5(seed:id)`` sort key, so results are independent of the
partition layout and identical on task retry. Per-class limits with a literal
``n`` are planned by Spark as a partial ``WindowGroupLimit`` before the shuffle,
so each map task ships at most ``n`` rows per class even when one class holds
most of the table. Data-dependent limits use the skew-safe numbering.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.features import class_index
from ..functions.hashing import seeded_key
from .ordering import global_index, hash_bucket, ranged_index, row_number_by_key

SHUFFLE_KEY = "shuffle_key"
LARGE_SAMPLE = 100_000      # rows of a class that one task ranks at most


def with_shuffle_key(df: DataFrame, seed: int | str = 42, id_col: str = "id") -> DataFrame:
    return df.withColumn(SHUFFLE_KEY, seeded_key(str(seed), F.col(id_col)))


def known_classes(df: DataFrame, label_col: str = "label",
                  classes=K.CLASSES) -> DataFrame:
    """B2 — keep rows whose label is one of the classes (others dropped)."""
    return df.where(F.col(label_col).isin(*classes))


def sample_balanced(df: DataFrame, n_per_class: int, seed: int | str = 42,
                    label_col: str = "label", id_col: str = "id",
                    classes=K.CLASSES, rank_col: str = "class_rank") -> DataFrame:
    """G1 — up to ``n_per_class`` rows of each class (all rows of a class that
    has fewer), picked by the seeded key. Adds ``class_rank`` (0-based)."""
    if n_per_class is None or n_per_class < 0:
        raise ValueError("n_per_class must be a non-negative integer")
    keyed = with_shuffle_key(known_classes(df, label_col, classes), seed, id_col)
    if n_per_class > LARGE_SAMPLE:      # too many for one task per class: the same ranks by buckets
        ranked = row_number_by_key(keyed, [label_col], [SHUFFLE_KEY, id_col], hash_bucket(SHUFFLE_KEY), out=rank_col)
        return ranked.where(F.col(rank_col) < n_per_class)
    w = Window.partitionBy(label_col).orderBy(SHUFFLE_KEY, id_col)
    # filter on the bare row_number so Spark plans a partial WindowGroupLimit
    # (top-n per class per map task) before the shuffle
    return (keyed.withColumn("_rn", F.row_number().over(w))
                 .where(F.col("_rn") <= n_per_class)
                 .withColumn(rank_col, (F.col("_rn") - 1).cast("bigint")).drop("_rn"))


def load_examples(df: DataFrame, n_shots: int | None, seed: int | str = 42,
                  label_col: str = "label", id_col: str = "id") -> DataFrame:
    """G2 — ``None``: all rows unfiltered; ``<= 0``: none (zero-shot);
    otherwise a balanced sample of ``n_shots`` per class."""
    if n_shots is None:
        return with_shuffle_key(df, seed, id_col).withColumn("class_rank", F.lit(None).cast("bigint"))
    if n_shots <= 0:
        return with_shuffle_key(df, seed, id_col).withColumn(
            "class_rank", F.lit(None).cast("bigint")).limit(0)
    return sample_balanced(df, n_shots, seed, label_col, id_col)


def shuffle(df: DataFrame, seed: int | str = 42, id_col: str = "id",
            pos_col: str = "pos") -> DataFrame:
    """G3 — the whole table in seeded order, with its 0-based position."""
    keyed = with_shuffle_key(df, seed, id_col)
    return global_index(keyed, [SHUFFLE_KEY, id_col], hash_bucket(SHUFFLE_KEY), out=pos_col)


def with_row_id(df: DataFrame, id_col: str = "id", order: list[str] | None = None) -> DataFrame:
    """B6 — row id fallback: the ``id`` column when present and set, else the
    row's 0-based position in ``order``, as a string. Without ``order`` that is the
    place in the files, by path, block and record, if ``df`` reads files, else the
    order of its partitions. No task sees more than a range of the rows."""
    if order is None:
        base = df.withColumn("_read_pos", F.monotonically_increasing_id())
        try:
            base = base.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"))
            pos = global_index(base, ["_path", "_block", "_read_pos"], [F.col("_path"), F.col("_block")], out="_row_pos")
        except AnalysisException:       # no file source
            pos = global_index(base, ["_read_pos"], F.shiftright("_read_pos", 33), out="_row_pos")
    else:
        pos = ranged_index(df, order, out="_row_pos")
    fallback = F.col("_row_pos").cast("string")
    rid = F.coalesce(F.col(id_col).cast("string"), fallback) if id_col in df.columns else fallback
    return pos.withColumn(id_col, rid).drop("_row_pos", "_read_pos", "_path", "_block")


def sample_n(df: DataFrame, n: int, seed: int | str = 42, id_col: str = "id") -> DataFrame:
    """G4/G6 — seeded sample of at most ``n`` rows (a top-k on the seeded key)."""
    keyed = with_shuffle_key(df, seed, id_col)
    return keyed.orderBy(SHUFFLE_KEY, id_col).limit(int(n))


def head_n(df: DataFrame, n: int | None, order: str = "id") -> DataFrame:
    """G7 — first ``n`` rows in ``order``; ``None``/0 keeps all rows."""
    if not n:
        return df
    return df.orderBy(order).limit(int(n))


def split_sizes(total, train_size, val_size):
    """Exact sizes like a seeded train/test split: ints are row counts,
    floats are shares (train rounds down, validation rounds up)."""
    def size(v, up):
        if isinstance(v, float):
            x = F.lit(v) * total
            return (F.ceil(x) if up else F.floor(x)).cast("bigint")
        return F.lit(int(v)).cast("bigint")
    return size(train_size, False), size(val_size, True)


def train_val_split(df: DataFrame, train_size=0.8, val_size=0.2, seed: int | str = 42,
                    id_col: str = "id", split_col: str = "split") -> DataFrame:
    """G5 — disjoint seeded split with exact sizes; rows beyond both are dropped."""
    pos = global_index(with_shuffle_key(df, seed, id_col), [SHUFFLE_KEY, id_col],
                       hash_bucket(SHUFFLE_KEY), out="_pos", total="_total")
    n_train, n_val = split_sizes(F.col("_total"), train_size, val_size)
    lab = (F.when(F.col("_pos") < n_train, F.lit("train"))
           .when(F.col("_pos") < n_train + n_val, F.lit("validation")))
    return pos.withColumn(split_col, lab).where(F.col(split_col).isNotNull()).drop("_total")


def first_per_class(df: DataFrame, seed: int | str = 42, label_col: str = "label",
                    id_col: str = "id") -> DataFrame:
    """G8 — the first row of each class in seeded order (partial aggregation,
    one row per class and map task crosses the shuffle)."""
    keyed = with_shuffle_key(df, seed, id_col)
    others = [c for c in keyed.columns if c != label_col]
    first = F.min_by(F.struct(*others), F.struct(SHUFFLE_KEY, id_col))
    return keyed.groupBy(label_col).agg(first.alias("_r")).select(label_col, "_r.*")


def balanced_dataset(df: DataFrame, n_per_class: int | None = None, seed: int | str = 42,
                     label_col: str = "label", id_col: str = "id",
                     classes=K.CLASSES) -> DataFrame:
    """G9 — ``n_per_class`` rows of every class, ordered by class then seeded
    rank. ``None`` takes the size of the smallest class, so every class is
    complete. Ranks come from the skew-safe numbering (a class may hold most
    rows); ``dataset_pos`` is the row's place in the assembled dataset."""
    keyed = with_shuffle_key(known_classes(df, label_col, classes), seed, id_col)
    if n_per_class is None:
        ranked = row_number_by_key(keyed, [label_col], [SHUFFLE_KEY, id_col], hash_bucket(SHUFFLE_KEY),
                                   out="class_rank")
        counts = keyed.groupBy(label_col).count()
        n = counts.select(F.min("count")).scalar()
    else:
        n = F.lit(int(n_per_class))
        # a literal limit: each map task ships at most n rows per class
        first = F.row_number().over(Window.partitionBy(label_col).orderBy(SHUFFLE_KEY, id_col))
        ranked = (keyed.withColumn("_rn", first).where(F.col("_rn") <= int(n_per_class))
                  .withColumn("class_rank", (F.col("_rn") - 1).cast("bigint")).drop("_rn"))
    out = ranked.where(F.col("class_rank") < n)
    return out.withColumn("dataset_pos",
                          (class_index(F.col(label_col)).cast("bigint") * n + F.col("class_rank")))


def examples_by_class(df: DataFrame, label_col: str = "label", classes=K.CLASSES) -> DataFrame:
    """G10 — rows per class for the fixed classes, empty classes kept (counts,
    never the collected rows: a class can be a third of the table)."""
    spark = df.sparkSession
    cls = spark.createDataFrame([(i, c) for i, c in enumerate(classes)], "ord bigint, label string")
    counts = df.where(F.col(label_col).isin(*classes)).groupBy(label_col).agg(
        F.count(F.lit(1)).alias("n_examples"))
    return (cls.join(counts, cls["label"] == counts[label_col], "left")
               .select(cls["ord"], cls["label"], F.coalesce("n_examples", F.lit(0)).alias("n_examples")))
