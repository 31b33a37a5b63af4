"""Registered queries: one per operator of the inventory.

Each takes ``(spark, sf_dir)``, reads the driver's tables (``events``,
``conversations``, ``embeddings``, ``labels``) and returns a DataFrame whose
column names match the DuckDB oracle in :mod:`sigeval.plans.oracles`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from .. import runs
from ..functions import features as X
from ..functions.hashing import seeded_bucket
from ..operators import arrays as J
from ..operators import experiment as I
from ..operators import metrics as M
from ..operators import parse as P
from ..operators import render as R
from ..operators import sampling as G
from ..operators.augment import augment_noise
from ..operators.complete import ExampleClient, RuleClient, complete_batch
from ..operators.label_search import first_label
from ..operators.labels import range_labels
from ..operators.ordering import hash_bucket, pin, row_number_by_key
from ..operators.ranges import range_join
from ..operators.reply_log import complete_logged, log_rows
from ..session import read_table, scratch_path
from ..sources import io
from ..sources.snapshot import read_snapshot, write_snapshot
from ..streaming import corrections
from . import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# parameters of the registered queries
FEW_SHOT_N = 4          # examples per class in the few-shot block
MESSAGES_N = 2          # examples per class in the message lists
TUNED_N = 1             # examples per class in the tuned few-shot prompt
SAMPLE_N = 50           # seeded sample size (tuned eval subset)
HEAD_N = 50             # head size
SEED = 42
CHAT_PART_TURNS = 4
LABEL_CHARS = 40        # opening characters of an item that name it
WINDOW_LENGTH = 64      # ids per training window
IMAGE_SLOTS = 2         # image ids after the first id of a record
GRID_ROWS_PER_TASK = 2000   # prompts per task of the bundled clients, which answer at once


def q(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _lab(spark, d) -> DataFrame:
    return T.labelled(spark, d)


def _shared_lab(spark, d) -> DataFrame:
    """The labelled table written once (reliable checkpoint in the shared
    folder) for queries that read it in more than one branch, so the
    events -> sequences shuffle runs once instead of once per branch."""
    return pin(T.labelled(spark, d))


def _split(lab: DataFrame, name) -> DataFrame:
    return lab.where(F.col("split") == name)


def _predictions(lab: DataFrame, seed="resp") -> DataFrame:
    """Test rows with the deterministic reply of ``seed``."""
    return T.with_replies(_split(lab, "test"), seed)


def _range_flag(regime_ranges, label="label", peaks="total_peaks"):
    cond = None
    for c, lo, hi in regime_ranges:
        x = (F.col(label) == c) & F.col(peaks).between(lo, hi)
        cond = x if cond is None else (cond | x)
    return cond


# ================================================================ A sources/sinks
@q
def split_select(spark, d):
    """A2/B1 — the test split projected to (id, sequence, fc_class)."""
    return _split(_lab(spark, d), "test").select("id", "sequence", F.col("label").alias("fc_class"))


@q
def metadata_rows(spark, d):
    """A3/C12 — ``<split>_%04d`` ids in dataset order (class, seeded rank),
    total peaks counted from the string."""
    lab = G.with_shuffle_key(_lab(spark, d), SEED).withColumn("_ord", X.class_index(F.col("label")))
    ranked = row_number_by_key(lab, ["split"], ["_ord", G.SHUFFLE_KEY, "id"],
                               [F.col("_ord"), hash_bucket(G.SHUFFLE_KEY)], out="_i")
    return ranked.select(F.format_string("%s_%04d", "split", "_i").alias("id"),
                         F.col("id").alias("source_id"), "sequence", "label",
                         X.total_peaks("sequence").alias("total_picos"))


@q
def manifest(spark, d):
    """A10/H15 — one-row run manifest: sizes per split, ranges, prompt."""
    lab = _lab(spark, d)
    ood = _range_flag(K.OOD_RANGES)
    rng = lambda rs: ", ".join(f"{c} {lo}-{hi}" for c, lo, hi in rs)
    return lab.agg(
        F.max(F.length("sequence")).cast("bigint").alias("sequence_length"),
        F.count_if(F.col("split") == "icl").cast("bigint").alias("n_icl"),
        F.count_if(F.col("split") == "train").cast("bigint").alias("n_train"),
        F.count_if(F.col("split") == "test").cast("bigint").alias("n_test"),
        F.count_if((F.col("split") == "test") & ood).cast("bigint").alias("n_test_ood"),
    ).select("*", F.lit(rng(K.IN_RANGES)).alias("in_ranges"),
             F.lit(rng(K.OOD_RANGES)).alias("ood_ranges"),
             F.lit(K.TUNED_SYSTEM_PROMPT).alias("system_prompt"))


# ================================================================ B predicates
@q
def known_classes(spark, d):
    """B2 — keyword predictions restricted to the known classes."""
    p = _predictions(_lab(spark, d)).select("id", P.parse_keyword("raw_response").alias("label"))
    return G.known_classes(p)


@q
def correctness_icl(spark, d):
    """B4 — few-shot form: missing prediction -> Unknown, then compare."""
    p = _predictions(_lab(spark, d))
    pred = F.coalesce(P.parse_keyword("raw_response"), F.lit(K.UNKNOWN))
    return p.select("id", F.col("label").alias("true_class"), pred.alias("predicted_class"),
                    P.correct_icl(pred, F.col("label")).alias("correct"))


@q
def correctness_ft(spark, d):
    """B5/B6/C14 — tuned form: null/empty prediction is wrong; reply cut at 200."""
    p = _predictions(_lab(spark, d))
    pred = P.parse_embedded_json("raw_response")
    return p.select("id", F.col("label").alias("true_label"), pred.alias("pred_label"),
                    P.correct_tuned(pred, F.col("label")).alias("correct"),
                    F.substring("raw_response", 1, 200).alias("raw_response"))


@q
def row_ids(spark, d):
    """B6 — the id where a row has one, else its position in the order of sequence."""
    rows = _split(_lab(spark, d), "test").select(F.when(F.col("chunk") % 2 == 0, F.col("id")).alias("id"), "sequence",
                                                 F.col("id").alias("source_id"))
    return G.with_row_id(rows, order=["sequence", "source_id"]).select("id", "source_id")


# ================================================================ C features
@q
def encode_sequences(spark, d):
    """C8 — events -> fixed-length symbol sequences (flagship)."""
    return T.seqs(spark, d)


@q
def symbol_counts(spark, d):
    s = F.col("sequence")
    return T.seqs(spark, d).select(
        "id", X.narrow_peaks(s).alias("narrow"), X.wide_peaks(s).alias("wide"),
        X.count_symbol(s, K.BASELINE).alias("baseline"), X.count_symbol(s, K.NOISE).alias("noise"),
        X.count_symbol(s, K.ARTIFACT).alias("artifact"), X.total_peaks(s).alias("total_peaks"))


@q
def noise_pct(spark, d):
    return T.seqs(spark, d).select("id", X.noise_pct("sequence").alias("noise_pct"))


@q
def rr_irregularity(spark, d):
    return T.seqs(spark, d).select("id", X.rr_irregularity("sequence").alias("irregularity"))


@q
def artifact_flag(spark, d):
    return T.seqs(spark, d).select(
        "id", X.count_symbol("sequence", K.ARTIFACT).alias("n_artifacts"),
        F.length("sequence").cast("bigint").alias("length"),
        X.artifact_flag("sequence").alias("artifact_flag"))


@q
def concepts(spark, d):
    c = X.concepts(F.col("sequence"))
    return T.seqs(spark, d).select("id", c.alias("c")).select("id", "c.*")


@q
def stored_concepts(spark, d):
    """C5, second form — stored concepts where a row has them, else derived with
    the default irregularity."""
    s = T.seqs(spark, d)
    kept = F.when(F.col("chunk") % 2 == 0, X.concepts(F.col("sequence")))
    rows = s.select("id", "sequence", kept.alias("concepts"))
    return rows.select("id", X.concepts_or_stored(rows.columns).alias("c")).select("id", "c.*")


@q
def label_by_threshold(spark, d):
    return _lab(spark, d).select("id", "total_peaks", "label")


@q
def label_by_range(spark, d):
    """C7 — range join against the 6-row range table (broadcast; a row may
    match both regimes)."""
    lab = _lab(spark, d).select("id", "total_peaks")
    return range_labels(lab, T.label_ranges(spark)).select("id", "total_peaks", "regime", "label")


@q
def range_matches(spark, d):
    """C7 with a range table that grows with the data: each part spans as many
    keys as its size; line items per part in whose span their part lies."""
    spans = read_table(spark, d, "part").select("p_partkey", F.col("p_partkey").alias("lo"),
                                                (F.col("p_partkey") + F.col("p_size") * F.col("p_size")).alias("hi"))
    items = read_table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return range_join(items, spans, "l_partkey").groupBy("p_partkey").agg(
        F.count(F.lit(1)).alias("n_keys"), F.sum("n").alias("n_items"))


@q
def observed_sizes(spark, d):
    """A10/H15 — sizes by split, observed while the labelled table is written."""
    _, sizes = io.write_observed(_lab(spark, d), "sizes", runs.sizes_by_split())
    return spark.createDataFrame([tuple(sizes.values())], ", ".join(f"{k} bigint" for k in sizes))


@q
def snapshot_results(spark, d):
    """A13/A14 — predictions committed by split; a second run replaces one."""
    path = scratch_path(spark, "snapshots")
    lab = _shared_lab(spark, d).select("id", "split", "label")
    write_snapshot(lab.withColumn("version", F.lit(1)), path, by=("split",))
    write_snapshot(_split(lab, "icl").withColumn("version", F.lit(2)), path, by=("split",))
    return read_snapshot(spark, path).groupBy("split", "version", "label").agg(F.count(F.lit(1)).alias("n"))


@q
def augment_noise_q(spark, d):
    return T.seqs(spark, d).select("id", augment_noise(F.col("sequence"), F.col("id")).alias("augmented"))


@q
def peak_positions(spark, d):
    return T.seqs(spark, d).select("id", F.inline(X.peak_positions("sequence")))


@q
def rr_intervals(spark, d):
    return T.seqs(spark, d).select("id", F.posexplode(X.rr_intervals("sequence")).alias("idx", "interval")) \
        .select("id", F.col("idx").cast("bigint").alias("idx"), "interval")


@q
def target_json(spark, d):
    lab = _lab(spark, d)
    return lab.select("id", X.target_json("sequence", F.col("label")).alias("target"),
                      X.target_json("sequence", F.col("label"), indent=2).alias("target_pretty"))


@q
def response_preview(spark, d):
    r = F.col("raw_response")
    return _predictions(_lab(spark, d)).select(
        "id", F.substring(r, 1, 200).alias("head_200"), F.substring(r, 1, 30).alias("head_30"),
        F.substring(r, 1, 50).alias("head_50"), F.substring(r, 1, 500).alias("head_500"),
        F.right(r, F.lit(200)).alias("tail_200"))


@q
def label_names(spark, d):
    """C15/C16 — int label -> name and alternate spelling."""
    emb = read_table(spark, d, "embeddings")
    name = T.choice_name(F.col("label"))
    return emb.select("vec_id", F.col("label").cast("bigint").alias("label"), name.alias("name"),
                      T.alt_name(name).alias("alt"))


# ================================================================ D rendering
def _icl_examples(lab: DataFrame, n):
    return G.sample_balanced(_split(lab, "icl"), n, SEED)


@q
def example_regular(spark, d):
    return _lab(spark, d).select("id", R.example_regular("sequence", "label", F.col("chunk") + 1)
                                 .alias("example"))


@q
def example_cbm(spark, d):
    lab = _lab(spark, d)
    return lab.select("id", R.example_cbm("sequence", X.concepts(F.col("sequence")), "label",
                                          F.col("chunk") + 1).alias("example"))


@q
def few_shot_block(spark, d):
    return R.few_shot_block(_icl_examples(_lab(spark, d), FEW_SHOT_N), "regular")


@q
def prompt_zero_shot(spark, d):
    tz = R.load_prompt("regular", "user_prompt_zero_shot")
    return _split(_lab(spark, d), "test").select("id", R.fill_template(tz, sequence=F.col("sequence"))
                                           .alias("prompt"))


@q
def prompt_few_shot(spark, d):
    tz = R.load_prompt("regular", "user_prompt_zero_shot")
    tf = R.load_prompt("regular", "user_prompt_few_shot")
    lab = _shared_lab(spark, d)
    block = R.block_text(_icl_examples(lab, FEW_SHOT_N))
    return _split(lab, "test").select("id", R.user_prompt(F.col("sequence"), tz, tf, block)
                                           .alias("prompt"))


@q
def messages(spark, d):
    system = R.load_prompt("regular", "system_prompt")
    tz = R.load_prompt("regular", "user_prompt_zero_shot")
    tf = R.load_prompt("regular", "user_prompt_few_shot")
    lab = _shared_lab(spark, d)
    block = R.block_text(_icl_examples(lab, MESSAGES_N))
    test = _split(lab, "test")
    m = test.select("id", R.messages(test, system, R.user_prompt(F.col("sequence"), tz, tf, block))
                    .alias("messages"))
    return R.explode_messages(m, ["id"])


@q
def merge_system(spark, d):
    return R.merge_system(read_table(spark, d, "conversations"))


@q
def chat_template(spark, d):
    return R.chat_turn_pieces(read_table(spark, d, "conversations"))


@q
def rendered_chats(spark, d):
    """D7 — whole chats written to files and read back: one record per
    conversation. Parts of four turns, so that chats of several parts occur."""
    path = scratch_path(spark, "chats")
    io.write_chats(R.chat_parts(read_table(spark, d, "conversations"), part_turns=CHAT_PART_TURNS), path)
    return io.chat_index(io.read_chats(spark, path))


@q
def prompt_finetuned(spark, d):
    """D8 — tuned prompt with one example per class."""
    lab = _shared_lab(spark, d)
    block = R.block_text(_icl_examples(lab, TUNED_N), R.tuned_block)
    return _split(lab, "test").select(
        "id", R.tuned_prompt(F.col("sequence"), K.TUNED_SYSTEM_PROMPT, block).alias("prompt"))


def _prompt_completion(lab: DataFrame):
    train = _split(lab, "train")
    return train.select("id", "label",
                        R.tuned_prompt(F.col("sequence"), K.TUNED_SYSTEM_PROMPT).alias("prompt"),
                        X.target_json("sequence", F.col("label")).alias("completion"))


@q
def prompt_completion(spark, d):
    """D9 — zero-shot prompt through the chat template + JSON completion."""
    return _prompt_completion(_lab(spark, d)).select("id", "prompt", "completion")


@q
def chat_records(spark, d):
    train = _split(_lab(spark, d), "train")
    m = train.select("id", R.chat_record(F.col("sequence"), F.col("label"), K.TUNED_SYSTEM_PROMPT)
                     .alias("messages"))
    return R.explode_messages(m, ["id"])


@q
def appended_turns(spark, d):
    """D10 — the zero-shot messages with the answer appended as a model turn."""
    rows = _lab(spark, d)
    user = F.array(F.struct(F.lit("user").alias("role"), R.tuned_user_content(
        F.col("sequence"), K.TUNED_SYSTEM_PROMPT).alias("content")))
    m = _split(rows, "train").select("id", R.append_turn(user, "model", X.target_json("sequence", F.col("label")))
                                     .alias("messages"))
    return R.explode_messages(m, ["id"])


def _choice_prompt_col():
    return R.choice_question(F.array(*[F.lit(n) for n in K.CHOICE_NAMES]))


@q
def multimodal_messages(spark, d):
    """D12 — train rows get [user(image, text), assistant(name)], test rows
    (``h('mm', vec_id) % 10 == 0``) only the user turn."""
    emb = read_table(spark, d, "embeddings")
    is_test = seeded_bucket("mm", F.col("vec_id"), 10) == 0
    prompt = _choice_prompt_col()
    msgs = F.when(is_test, R.multimodal_messages(prompt, None)) \
        .otherwise(R.multimodal_messages(prompt, T.choice_name(F.col("label"))))
    m = emb.select("vec_id", F.posexplode(msgs).alias("msg_idx", "m"))
    return m.select("vec_id", F.col("msg_idx").cast("bigint").alias("msg_idx"),
                    F.col("m.role").alias("role"),
                    F.posexplode("m.content").alias("part_idx", "p")) \
        .select("vec_id", "msg_idx", "role", F.col("part_idx").cast("bigint").alias("part_idx"),
                F.col("p.type").alias("type"), F.col("p.text").alias("text"))


@q
def choice_prompt(spark, d):
    """D13 — multiple-choice question over the labels present in the data."""
    emb = read_table(spark, d, "embeddings")
    labels = emb.select(F.col("label").cast("bigint").alias("label")).distinct()
    named = labels.select(F.struct("label", T.choice_name(F.col("label")).alias("name")).alias("e"))
    agg = named.agg(F.array_sort(F.collect_list("e")).alias("es"))
    return agg.select(F.size("es").cast("bigint").alias("n_options"),
                      R.choice_question(F.transform("es", lambda e: e["name"])).alias("prompt"))


# ================================================================ E completion
@q
def join_responses(spark, d):
    """E2 — score offline replies: test rows left-join the stored replies
    (empty replies were never stored); missing -> Unknown."""
    lab = _shared_lab(spark, d)
    test = _split(lab, "test")
    stored = T.with_replies(lab, "resp").where(F.col("raw_response") != "") \
        .select(F.col("id").alias("_rid"), "raw_response")
    j = test.join(stored, test["id"] == stored["_rid"], "left")
    pred = F.coalesce(P.parse_keyword("raw_response"), F.lit(K.UNKNOWN))
    return j.select("id", F.col("label").alias("true_class"), "raw_response",
                    pred.alias("predicted_class"), P.correct_icl(pred, F.col("label")).alias("correct"))


def _zero_shot_messages(lab):
    system = R.load_prompt("regular", "system_prompt")
    tz = R.load_prompt("regular", "user_prompt_zero_shot")
    test = _split(lab, "test")
    return test.select("id", R.messages(test, system, R.user_prompt(F.col("sequence"), tz, tz, None)).alias("messages"))


@q
def late_replies(spark, d):
    """E2 — replies that come in three files, repeated and out of order, scored as
    a stream; the counters of the last reply per id."""
    base = scratch_path(spark, "late-replies")
    lab = pin(_split(_lab(spark, d), "test").select("id", "sequence", "label"))
    for minute, seed in ((2, "late2"), (1, "late1"), (3, "late3")):
        rows = T.with_replies(lab, seed).where(seeded_bucket(seed, F.col("id"), 4) != 0)
        (rows.select("id", F.timestamp_seconds(F.lit(minute * 60)).alias("ts"), "raw_response")
         .coalesce(1).write.parquet(f"{base}/in/{minute}"))
    stream = corrections.start_corrections(spark, f"{base}/in/*", lab, f"{base}/out", base.rsplit("/", 1)[1], files_per_batch=1)
    stream.awaitTermination()
    return corrections.corrected_metrics(spark, f"{base}/out")


@q
def complete_batch_q(spark, d):
    """E1 — zero-shot message lists sent through the local rule client."""
    return complete_batch(_zero_shot_messages(_lab(spark, d)), RuleClient)


# ================================================================ F parsing
@q
def parse_keyword(spark, d):
    return _predictions(_lab(spark, d)).select("id", P.parse_keyword("raw_response").alias("pred"))


@q
def parse_fenced_json(spark, d):
    return _predictions(_lab(spark, d)).select("id", P.parse_fenced_json("raw_response").alias("pred"))


@q
def parse_embedded_json(spark, d):
    return _predictions(_lab(spark, d)).select("id", P.parse_embedded_json("raw_response").alias("pred"))


def _choice(spark, d, seed="choice"):
    return T.choice_replies(read_table(spark, d, "embeddings"), seed)


@q
def parse_choice(spark, d):
    return _choice(spark, d).select("vec_id", "label", P.parse_choice("raw").alias("pred"))


@q
def parse_exact(spark, d):
    return _choice(spark, d).select("vec_id", "label", P.parse_exact("raw").alias("pred"))


@q
def completion_labels(spark, d):
    pc = _prompt_completion(_lab(spark, d))
    return pc.select("id", "label", P.completion_label("completion").alias("completion_label"))


@q
def parsed_concepts(spark, d):
    """F6 — typed concepts of the fenced replies, numbers as numbers."""
    p = _predictions(_lab(spark, d)).select("id", P.parse_fenced_json("raw_response").alias("fc_class"),
                                            P.concept_values("raw_response").alias("c"))
    return p.where("c is not null").select("id", "fc_class", *[F.col(f"c.{k}").alias(k) for k in K.CONCEPT_KEYS[:2]],
                                           F.to_json("c.payload").alias("payload"))


@q
def label_search(spark, d):
    """F4 over a label table — the first benchmark item whose opening words stand in
    a document, over whole texts."""
    items = read_table(spark, d, "benchmark").select(F.col("item_id").alias("label"),
                                                     F.substring("text", 1, LABEL_CHARS).alias("name"))
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    return first_label(docs, "text", items).select("doc_id", "pred")


# ================================================================ G sampling
@q
def sample_balanced(spark, d):
    return _icl_examples(_lab(spark, d), FEW_SHOT_N).select("id", "label", "class_rank")


@q
def shuffle(spark, d):
    return G.shuffle(_lab(spark, d).select("id"), SEED).select("id", "pos")


@q
def sample_n(spark, d):
    return G.sample_n(_split(_lab(spark, d), "test"), SAMPLE_N, SEED).select("id")


@q
def train_val_split(spark, d):
    return G.train_val_split(_split(_lab(spark, d), "train").select("id"), 0.8, 0.2, SEED) \
        .select("id", "split")


@q
def head_n(spark, d):
    return G.head_n(_lab(spark, d).select("id", "sequence"), HEAD_N)


@q
def first_per_class(spark, d):
    return G.first_per_class(_split(_lab(spark, d), "train").select("id", "label"), SEED) \
        .select("label", "id")


@q
def balanced_dataset(spark, d):
    return G.balanced_dataset(_split(_lab(spark, d), "train").select("id", "label"), None, SEED) \
        .select("id", "label", "class_rank", "dataset_pos")


@q
def examples_by_class(spark, d):
    return G.examples_by_class(_split(_lab(spark, d), "icl"))


@q
def shifted_dataset(spark, d):
    """G9 — the balanced shifted test set under the shifted noise."""
    test = _split(_lab(spark, d), "test").where(I.in_ranges(K.OOD_RANGES)).select("id", "label", "sequence")
    return runs.balanced_split(test, SEED, shifted=True).select("id", "label", "sequence", "dataset_pos")


# ================================================================ H metrics
def _icl_pred(lab: DataFrame, seed="resp"):
    p = _predictions(lab, seed)
    pred = F.coalesce(P.parse_keyword("raw_response"), F.lit(K.UNKNOWN))
    return p.select("id", "label", pred.alias("pred"), P.correct_icl(pred, F.col("label")).alias("correct"))


def _ft_pred(lab: DataFrame, seed="resp"):
    p = _predictions(lab, seed)
    pred = P.parse_embedded_json("raw_response")
    return p.select("id", "label", pred.alias("pred"), P.correct_tuned(pred, F.col("label")).alias("correct"))


@q
def accuracy(spark, d):
    return M.accuracy(_icl_pred(_lab(spark, d)))


@q
def metrics_fixed(spark, d):
    return M.per_class_fixed(_icl_pred(_lab(spark, d)))


@q
def metrics_dynamic(spark, d):
    return M.per_class_observed(_ft_pred(_lab(spark, d)))


@q
def metrics_long(spark, d):
    return M.metrics_long(_icl_pred(_lab(spark, d)), task=1, n_shots=FEW_SHOT_N, approach="regular",
                          ood=False, model="rule-replies")


@q
def run_summary(spark, d):
    s = M.run_summary(_ft_pred(_lab(spark, d)), task=1, n_shots=0, ood=False)
    e = s.select("task", "n_shots", "ood", "total_samples", F.col("correct").alias("all_correct"),
                 F.col("accuracy").alias("all_accuracy"), F.explode("per_class").alias("label", "c"))
    return e.select("task", "n_shots", "ood", "total_samples", "all_correct", "all_accuracy", "label",
                    F.col("c.correct").alias("correct"), F.col("c.total").alias("total"),
                    F.col("c.accuracy").alias("accuracy"))


@q
def weighted_f1(spark, d):
    """H6/H7 — multi-class (choice replies) and binary (quality labels)."""
    ch = _choice(spark, d).select("label", P.parse_choice("raw").alias("pred"))
    lb = read_table(spark, d, "labels").select(
        F.col("quality").cast("bigint").alias("label"), (1 - F.col("toxic")).cast("bigint").alias("pred"))
    a = M.weighted_f1(ch).select(F.lit("choice").alias("dataset"), "*")
    b = M.weighted_f1(lb).select(F.lit("quality").alias("dataset"), "*")
    return a.unionByName(b)


@q
def class_distribution(spark, d):
    return M.class_distribution(_lab(spark, d))


@q
def length_stats(spark, d):
    return M.length_stats(_lab(spark, d))


@q
def symbol_histogram(spark, d):
    return M.symbol_histogram(_lab(spark, d))


@q
def peak_stats(spark, d):
    return M.peak_stats(_lab(spark, d), T.label_ranges(spark))


@q
def balance_check(spark, d):
    head = G.sample_n(_split(_lab(spark, d), "train"), K.BALANCE_WINDOW, SEED)
    return M.balance_check(head)


@q
def token_share(spark, d):
    return M.token_share(_prompt_completion(_lab(spark, d))).select(
        "id", "prompt_tokens", "completion_tokens", "completion_share")


@q
def token_share_total(spark, d):
    """H13 — the share over all rows."""
    return M.token_share_total(M.token_share(_prompt_completion(_lab(spark, d))))


@q
def step_budget(spark, d):
    n = F.count(F.lit(1))
    return _split(_lab(spark, d), "train").agg(n.cast("bigint").alias("n_rows")).select(
        "n_rows", *M.step_budget(F.col("n_rows"), batch=1, accum=4, epochs=3, warmup_ratio=0.1))


@q
def label_consistency(spark, d):
    """H16 — per threshold label, rows whose counted peaks fall outside the
    label's in-distribution range."""
    lab = _lab(spark, d)
    inside = _range_flag(K.IN_RANGES)
    return lab.groupBy("label").agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                    F.count_if(~inside).cast("bigint").alias("n_outside_range"))


@q
def label_recount(spark, d):
    """H16 — the stored labels against the peaks recounted after augmentation."""
    lab = _lab(spark, d).select("label", augment_noise(F.col("sequence"), F.col("id")).alias("sequence"))
    return M.label_mismatches(lab)


# ================================================================ I experiment
def _grid(spark, d) -> DataFrame:
    """Every test row of a regime completed under every model and number of
    shots, and scored (:mod:`sigeval.operators.experiment`)."""
    lab = _shared_lab(spark, d)
    examples = pin(_icl_examples(lab, max(K.SHOT_GRID)))
    return I.run_grid(_split(lab, "test"), examples, {"base": ExampleClient, "tuned": RuleClient},
                      scratch_path(spark, "grid-replies"), rows_per_task=GRID_ROWS_PER_TASK)


@q
def sweep(spark, d):
    return I.per_run(_grid(spark, d)).withColumn("accuracy", M.ratio(F.col("correct"), F.col("total")))


@q
def ood_drop(spark, d):
    return M.ood_drop(I.per_run(_grid(spark, d)))


@q
def hypothesis_verdict(spark, d):
    return M.hypothesis_verdict(M.ood_drop(I.per_run(_grid(spark, d))))


@q
def model_compare(spark, d):
    """I4 — base (four shots) against tuned on the same test rows."""
    return I.model_compare(_grid(spark, d), FEW_SHOT_N)


# ================================================================ end to end
@q
def evaluate_icl(spark, d):
    """Sample, prompt, complete, parse, score: the predictions of a few-shot run."""
    lab = _shared_lab(spark, d)
    predictions, _ = runs.evaluate_icl(_split(lab, "icl"), _split(lab, "test"), ExampleClient, n_shots=FEW_SHOT_N,
                                       reply_log=scratch_path(spark, "replies"))
    return predictions


@q
def evaluate_icl_metrics(spark, d):
    """The metric table of the same run on the shifted test rows."""
    lab = _shared_lab(spark, d)
    shifted = _split(lab, "test").where(I.in_ranges(K.OOD_RANGES))
    _, metrics = runs.evaluate_icl(_split(lab, "icl"), shifted, ExampleClient, n_shots=FEW_SHOT_N, ood=True,
                                   model_name="examples", reply_log=scratch_path(spark, "replies"))
    return metrics


@q
def evaluate_tuned(spark, d):
    """The tuned run end to end, written and read back: CSV predictions."""
    out = scratch_path(spark, "tuned-run")
    lab = _shared_lab(spark, d)
    runs.evaluate_tuned(_split(lab, "test"), RuleClient, examples=_split(lab, "icl"), n_shots=TUNED_N, out_dir=out,
                        reply_log=scratch_path(spark, "replies"), task=1, ood=False)
    return io.read_predictions_csv(spark, out + "/predictions.csv", io.TUNED_PREDICTION_SCHEMA)


@q
def resume_completion(spark, d):
    """E1 — a run that stopped after some prompts and is taken up again: each
    reply once, with the number of rows that the log holds for it."""
    log = scratch_path(spark, "replies")
    m = pin(_zero_shot_messages(_shared_lab(spark, d)))
    stopped = m.where(seeded_bucket("stopped", F.col("id"), 3) == 0)
    complete_logged(stopped, RuleClient, log, "zero-shot", rows_per_task=GRID_ROWS_PER_TASK)
    replies = complete_logged(m, RuleClient, log, "zero-shot", rows_per_task=GRID_ROWS_PER_TASK)
    asked = log_rows(spark, log).groupBy("run", "id").agg(
        F.count(F.lit(1)).cast("bigint").alias("times_asked"), F.min("attempt").cast("bigint").alias("attempt"))
    return replies.join(asked, ["run", "id"]).select("run", "id", "raw_response", "error", "times_asked", "attempt")


# ================================================================ J arrays
@q
def mask_labels(spark, d):
    """J1/J2 — BOS + prompt ids + completion ids; labels masked on pad/image
    ids and on the prompt positions. One array of (token, part) per row is
    exploded once, so each id is one scalar expression on one row."""
    pc = _prompt_completion(_lab(spark, d))
    toks = lambda c: F.regexp_extract_all(F.col(c), F.lit(J.TOKEN_PATTERN), 0)
    item = lambda tok, part: F.struct(tok.alias("tok"), F.lit(part).alias("part"))
    items = F.concat(F.array(item(F.lit(None).cast("string"), "bos")),
                     F.transform(toks("prompt"), lambda t: item(t, "prompt")),
                     F.transform(toks("completion"), lambda t: item(t, "completion")))
    rows = pc.select("id", F.posexplode(items).alias("pos", "it"))
    tid = (F.pmod(F.conv(F.substring(F.md5(F.col("it.tok")), 1, 6), 16, 10).cast("bigint"),
                  F.lit(J.VOCAB)) + J.RESERVED)
    input_id = F.when(F.col("it.part") == "bos", F.lit(J.BOS_ID)).otherwise(tid).cast("bigint")
    out = rows.select("id", F.col("pos").cast("bigint").alias("pos"), input_id.alias("input_id"),
                      F.col("it.part").alias("_part"))
    label = (F.when(F.col("_part") != "completion", F.lit(K.MASK_ID))
             .when(F.col("input_id").isin(J.PAD_ID, J.IMAGE_ID), F.lit(K.MASK_ID))
             .otherwise(F.col("input_id")).cast("bigint"))
    return out.select("id", "pos", "input_id", label.alias("label"))


@q
def loss_masks(spark, d):
    """J1/J2 — fixed-length windows of real ids (a vocabulary fitted to the
    pairs) with image and pad ids; loss on whole completion tokens only, where
    one token crosses the border between prompt and completion."""
    pc = pin(_prompt_completion(_lab(spark, d)).select(
        "id", F.concat("prompt", "completion").alias("text"), F.length("prompt").alias("border")))
    tokens = pin(J.tokens(pc, "text", "border"))
    ids = J.encode(tokens, J.fit_vocabulary(tokens))
    windows = J.windows(ids, WINDOW_LENGTH, image_slots=IMAGE_SLOTS)
    labels = J.window_labels(F.col("ids"), F.col("n_masked"), F.col("window"), WINDOW_LENGTH)
    return (windows.select("id", "window", F.posexplode(F.arrays_zip(F.col("ids"), labels.alias("labels"))).alias("pos", "z"))
            .select("id", "window", F.col("pos").cast("bigint").alias("pos"), F.col("z.ids").alias("input_id"),
                    F.col("z.labels").alias("label")))


# keys that differ from the Python function names
QUERIES["augment_noise"] = QUERIES.pop("augment_noise_q")
QUERIES["complete_batch"] = QUERIES.pop("complete_batch_q")
