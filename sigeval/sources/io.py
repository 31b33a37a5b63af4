"""A — sources and sinks.

Parquet is the default sink; CSV / TSV / JSON Lines are kept for the file
formats of the studied pipeline. Readers match CSV headers by name, check the
required columns and fail with the column names, as the pipeline does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import features as X
from ..functions.hashing import seeded_bucket
from ..functions.util import path_exists, strip
from ..session import scratch_path
from ..operators import render as R
from .quoted_csv import file_positions, read_quoted_csv

REQUIRED_EXAMPLE_COLUMNS = ("sequence", "label")
# white space at the ends of a value is part of it
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_observed(df: DataFrame, name: str, aggregates: dict) -> tuple[DataFrame, dict]:
    """Writes ``df`` once to the shared folder and returns it read back, with the
    values of ``aggregates`` (name -> aggregate column) over the written rows: they
    are observed by the write itself, so nothing is scanned twice."""
    spark = df.sparkSession
    seen, path = Observation(name), scratch_path(spark, name)
    df.observe(seen, *[c.alias(n) for n, c in aggregates.items()]).write.parquet(path)
    found = seen.get
    return spark.read.schema(df.schema).parquet(path), {n: found[n] for n in aggregates}


# ---------------------------------------------------------------- A1
def read_examples_csv(spark: SparkSession, path: str, required=REQUIRED_EXAMPLE_COLUMNS) -> DataFrame:
    """Labelled CSV read by header name (all strings, no positional schema);
    absent file -> FileNotFoundError; missing required column -> ValueError.
    ``file_pos`` keeps the file order; ``total_picos`` is cast when present. A
    large file is read by many tasks, newlines in quoted fields included."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no example table at {path}")
    df = read_quoted_csv(spark, path)
    if absent := set(required).difference(df.columns):
        raise ValueError(f"{path} lacks {', '.join(sorted(absent))}")
    df = file_positions(df).drop("_file", "_record")
    if "total_picos" in df.columns:
        df = df.withColumn("total_picos", F.col("total_picos").try_cast("int"))
    return df


# ---------------------------------------------------------------- A2
def select_split(df: DataFrame, split: str, split_col: str = "split") -> DataFrame:
    """One split of a table partitioned by ``split`` (partition pruning on a
    partitioned parquet source)."""
    if split not in ("icl", "train", "test", "test_ood", "validation"):
        raise ValueError(f"unknown split {split}")
    return df.where(F.col(split_col) == split)


def write_partitioned(df: DataFrame, path: str, by=("split",)) -> None:
    """A13/A14 — replace only the partitions present in ``df``."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(*by).parquet(path))


# ---------------------------------------------------------------- A3
def metadata_frame(df: DataFrame, name: str, order_col: str = "dataset_pos") -> DataFrame:
    """``id = name_%04d`` by position (no truncation above 9999), sequence,
    label, total peaks counted from the string."""
    return df.select(F.format_string("%s_%04d", F.lit(name), F.col(order_col)).alias("id"),
                     "sequence", "label", X.total_peaks("sequence").cast("int").alias("total_picos"))


def write_metadata_csv(df: DataFrame, path: str, name: str, order_col: str = "dataset_pos") -> None:
    metadata_frame(df, name, order_col).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


# ---------------------------------------------------------------- A4
def write_tsv(df: DataFrame, path: str, seq_col: str = "sequence", label_col: str = "label") -> None:
    df.select(seq_col, label_col).write.mode("overwrite").option("sep", "\t").csv(path)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``sequence<TAB>class`` lines; blank lines skipped; any other field
    count raises at run time."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("line")).where(F.col("line") != "")
    parts = F.split(F.col("line"), "\t")
    checked = F.when(F.size(parts) == 2, parts).otherwise(
        F.raise_error(F.concat(F.lit("expected 2 tab-separated fields: "), F.col("line"))))
    return lines.select(checked.alias("p")).select(F.col("p")[0].alias("sequence"),
                                                   F.col("p")[1].alias("fc_class"))


# ---------------------------------------------------------------- A5
CONCEPTS_TYPE = T.StructType([
    T.StructField(K.CONCEPT_KEYS[0], T.LongType()),
    T.StructField(K.CONCEPT_KEYS[1], T.LongType()),
    T.StructField(K.CONCEPT_KEYS[2], T.DoubleType()),
    T.StructField(K.CONCEPT_KEYS[3], T.DoubleType()),
    T.StructField(K.CONCEPT_KEYS[4], T.BooleanType()),
])
SAMPLE_SCHEMA_RAW = T.StructType([
    T.StructField("sequence", T.StringType()),
    T.StructField("concepts", CONCEPTS_TYPE),
    T.StructField("fc_class", T.StringType()),
    T.StructField("rr_intervals", T.ArrayType(T.DoubleType())),
    T.StructField("metadata", T.StructType([
        T.StructField("target_fc_class", T.StringType()),
        T.StructField("actual_fc_class", T.StringType()),
        T.StructField("actual_total_peaks", T.LongType()),
        T.StructField("narrow_peaks", T.LongType()),
        T.StructField("wide_peaks", T.LongType()),
        T.StructField("noise_prob", T.DoubleType()),
        T.StructField("artifact_prob", T.DoubleType()),
        T.StructField("is_irregular", T.BooleanType()),
        T.StructField("irregularity_std", T.DoubleType()),
        # [[12, "|"], ...]: pairs of unlike types
        T.StructField("peak_positions", T.ArrayType(T.VariantType())),
    ])),
])


def read_samples_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Full samples; ``metadata.peak_positions`` becomes
    ``ARRAY<STRUCT<pos BIGINT, kind STRING>>``."""
    df = spark.read.schema(SAMPLE_SCHEMA_RAW).json(path)
    pairs = F.transform("metadata.peak_positions", lambda p: F.struct(
        F.try_variant_get(p, "$[0]", "bigint").alias("pos"), F.try_variant_get(p, "$[1]", "string").alias("kind")))
    return df.withColumn("metadata", F.col("metadata").withField("peak_positions", pairs))


def write_samples_jsonl(df: DataFrame, path: str) -> None:
    """Pairs are written back as two-element JSON arrays, positions as numbers."""
    pairs = F.transform("metadata.peak_positions", lambda p: F.array(p["pos"].cast("variant"), p["kind"].cast("variant")))
    out = df.withColumn("metadata", F.col("metadata").withField("peak_positions", pairs))
    out.write.mode("overwrite").json(path)


# ---------------------------------------------------------------- A6
def write_chat_jsonl(df: DataFrame, path: str, system_text: str = K.TUNED_SYSTEM_PROMPT) -> None:
    """One ``{"messages": [system, user, assistant]}`` per row."""
    df.select(R.chat_record(F.col("sequence"), F.col("label"), system_text).alias("messages")) \
        .write.mode("overwrite").json(path)


# ---------------------------------------------------------------- D7 rendered chats
CHAT_FOLDERS = 16
CHAT_SCHEMA = "conv_id bigint, part bigint, n_turns bigint, text string"


def write_chats(parts: DataFrame, path: str, folders: int = CHAT_FOLDERS) -> None:
    """Rendered chats as JSON lines, dealt to ``folders`` by a hash of the
    conversation and, inside a folder, sorted by (conversation, part). Rows are
    dealt to tasks by ranges of all three, so a conversation with very many parts is
    written by several tasks, into several files that follow each other."""
    dealt = parts.withColumn("folder", seeded_bucket("chat", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), folders))
    (dealt.repartitionByRange("folder", "conv_id", "part").sortWithinPartitions("folder", "conv_id", "part")
     .write.mode("overwrite").partitionBy("folder").json(path))


def read_chats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHAT_SCHEMA + ", folder bigint").json(path)


def chat_index(chats: DataFrame) -> DataFrame:
    """One record per conversation of :func:`read_chats`: its folder, parts,
    turns, bytes, and the SHA-256 of its parts' SHA-256 lines in order. A part's
    hash is taken where the part is; only the hashes meet."""
    digest = chats.select("folder", "conv_id", "part", "n_turns", F.octet_length("text").alias("bytes"),
                          F.sha2("text", 256).alias("sha"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "sha"))), lambda x: x["sha"]), "\n")
    return (digest.groupBy("folder", "conv_id")
            .agg(F.count(F.lit(1)).alias("n_parts"), F.sum("n_turns").alias("n_turns"),
                 F.sum("bytes").cast("bigint").alias("bytes"), F.sha2(lines, 256).alias("sha256"))
            .select(F.concat(F.lit("folder="), F.col("folder").cast("string")).alias("path"), "conv_id", "n_parts", "n_turns",
                    "bytes", "sha256"))


# ---------------------------------------------------------------- A7 / A8 / A9
PREDICTION_SCHEMA = "id string, sequence string, true_class string, predicted_class string, " \
                    "correct boolean, raw_response string"


TUNED_PREDICTION_SCHEMA = "id string, sequence string, true_label string, pred_label string, " \
                          "correct boolean, raw_response string, error string"


def write_predictions_csv(df: DataFrame, path: str) -> None:
    """Replies with quotes and newlines survive: doubled-quote escaping."""
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def read_predictions_csv(spark: SparkSession, path: str, schema: str = PREDICTION_SCHEMA) -> DataFrame:
    """Predictions in any number of tasks, newlines in replies included."""
    return read_quoted_csv(spark, path, T.StructType.fromDDL(schema)).drop("_file", "_record")


def write_metrics_csv(metrics_long: DataFrame, path: str) -> None:
    metrics_long.orderBy("ord").select("metric", "value").coalesce(1) \
        .write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def write_summary_json(summary: DataFrame, path: str) -> None:
    summary.coalesce(1).write.mode("overwrite").json(path)


# ---------------------------------------------------------------- A10
def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.coalesce(1).write.mode("overwrite").json(path)


def read_training_config(spark: SparkSession, path: str,
                         default_prompt: str = K.TUNED_SYSTEM_PROMPT) -> DataFrame:
    """One-row config; ``system_prompt`` falls back to ``default_prompt`` when
    the file is absent, the key is missing, or the value is null."""
    if not path_exists(spark, path):
        return spark.createDataFrame([(default_prompt,)], "system_prompt string")
    df = spark.read.json(path)
    if "system_prompt" not in df.columns:
        return df.withColumn("system_prompt", F.lit(default_prompt))
    return df.withColumn("system_prompt", F.coalesce(F.col("system_prompt"), F.lit(default_prompt)))


# ---------------------------------------------------------------- A11
def read_templates(spark: SparkSession, prompts_dir: str) -> DataFrame:
    """All templates under ``task*/<approach>/<type>.txt`` as a table
    ``(task, approach, prompt_type, text)`` (whole-file reads)."""
    raw = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true") \
        .text(prompts_dir).select(F.input_file_name().alias("path"), "value")
    pat = r"task(\d+)/([^/]+)/([^/]+)\.txt$"
    return raw.select(F.regexp_extract("path", pat, 1).cast("int").alias("task"),
                      F.regexp_extract("path", pat, 2).alias("approach"),
                      F.regexp_extract("path", pat, 3).alias("prompt_type"),
                      strip(F.col("value")).alias("text"))


# ---------------------------------------------------------------- A12
def read_image_folder(spark: SparkSession, root: str) -> DataFrame:
    """``root/<class>/<file>`` images -> (path, image BINARY, class_name,
    label INT) with labels numbered densely in class-name order. The class
    table (one row per folder) is ranked on its own; the join strategy is
    left to Spark, which broadcasts it only under its size threshold."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.select("path", F.col("content").alias("image"),
                         F.element_at(F.split("path", "/"), -2).alias("class_name"))
    names = files.select("class_name").distinct()
    ranked = names.withColumn("label", (F.dense_rank().over(Window.orderBy("class_name")) - 1).cast("int"))
    return files.join(ranked, "class_name")
