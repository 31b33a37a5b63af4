"""Domain constants.

FIXED VALUES — these must equal the studied pipeline's values for identical
results (symbol alphabet, class names and order, class thresholds, peak ranges,
concept / answer key names, metric names, example and record line formats).
They are listed plainly, in natural order, in one place.
"""

from __future__ import annotations

# --- fixed values: symbol alphabet -------------------------------------------
NARROW = "|"      # narrow peak
WIDE = ":"        # wide peak
BASELINE = "."    # flat baseline
ARTIFACT = "_"    # artifact
NOISE = "~"       # noise
SYMBOLS = (NARROW, WIDE, BASELINE, NOISE, ARTIFACT)

# --- fixed values: classes ---------------------------------------------------
CLASSES = ("Brady", "Normal", "Tachy")
UNKNOWN = "Unknown"
BRADY_MAX_PEAKS = 7      # peaks <= 7  -> Brady
NORMAL_MAX_PEAKS = 11    # peaks <= 11 -> Normal, otherwise Tachy

# inclusive peak ranges per regime
IN_RANGES = (("Brady", 4, 7), ("Normal", 8, 11), ("Tachy", 12, 16))
OOD_RANGES = (("Brady", 2, 5), ("Normal", 9, 10), ("Tachy", 14, 20))

# noise / artifact probability ranges per regime
IN_NOISE_PROB = (0.05, 0.25)
IN_ARTIFACT_PROB = (0.02, 0.10)
OOD_NOISE_PROB = (0.20, 0.40)
OOD_ARTIFACT_PROB = (0.08, 0.18)

# --- fixed values: features --------------------------------------------------
ARTIFACT_SHARE = 0.05           # significant when share > 0.05 (strict)
ARTIFACT_SHARE_DENOM = 20       # integer form: n_artifacts * 20 > length
DEFAULT_IRREGULARITY = 0.05     # used when concepts are derived without intervals
RR_CLAMP = (5, 50)              # interval clamp
RR_SINGLE = 1.0                 # interval list for fewer than two peaks

CONCEPT_KEYS = (
    "C1_picos_estrechos",
    "C2_picos_anchos",
    "C3_pct_ruido",
    "C4_irregularidad",
    "C5_artefactos_significativos",
)
TARGET_KEYS = ("Narrow_peaks", "Wide_peaks", "Total_peaks", "Label")
CBM_CONCEPTS_KEY = "conceptos"
CBM_CLASS_KEY = "fc_clase"

# --- fixed values: rendering formats -----------------------------------------
# Regular few-shot example (one example, lines joined by "\n").
EXAMPLE_REGULAR_LINES = (
    "Example {n}:",
    "Sequence: {sequence}",
    "Narrow peaks (|): {narrow}",
    "Wide peaks (:): {wide}",
    "Total peaks: {total}",
    "Classification: {label}",
)
# Concept few-shot example.
EXAMPLE_CBM_LINES = (
    "Example {n}:",
    "Sequence: {sequence}",
    "Concepts:",
    "{concepts_json}",
    "Classification: {label}",
)
EXAMPLE_SEPARATOR = "\n\n"
# Tuned-model prompt: zero-shot "{system}\n\nSequence: {sequence}"; few-shot
# inserts "\nExample {i}:\nSequence: {seq}\nResponse: {json}\n" per example.
TUNED_USER_ZERO_SHOT = "{system}\n\nSequence: {sequence}"
TUNED_EXAMPLE = "\nExample {n}:\nSequence: {sequence}\nResponse: {response}\n"
TUNED_USER_FEW_SHOT = "{system}\n{examples}\nSequence: {sequence}"
CHAT_USER_SEQUENCE = "Sequence: {sequence}"
SYSTEM_MERGE_SEPARATOR = "\n\n"

# --- fixed values: metric table (long form, in order) ------------------------
RUN_METRICS = (
    "Overall Accuracy",
    "Correct Predictions",
    "Total Predictions",
    "Task",
    "N-shots",
    "Approach",
    "OOD",
    "Model",
)
CLASS_METRICS = ("{cls} Accuracy", "{cls} TP", "{cls} Total")

# --- fixed values: experiment criteria ---------------------------------------
RANDOM_GUESS_ACCURACY = 0.33
TARGET_ACCURACY = 0.80
IN_DISTRIBUTION_MIN_ACCURACY = 0.70
OOD_MIN_DROP = 0.15
SHOT_GRID = (0, 1, 2, 4, 8)
TASK_MODALITY = {1: "text", 2: "vision", 3: "vision"}
APPROACHES = ("regular", "cbm")

# --- fixed values: training arithmetic ---------------------------------------
BALANCE_WINDOW = 30       # rows inspected by the balance check
BALANCE_MIN_PER_CLASS = 5
MASK_ID = -100

# --- this repo's own choices (not reference values) --------------------------
# Event type -> symbol used to encode the driver's `events` table.
EVENT_SYMBOLS = (
    ("click", NARROW),
    ("error", WIDE),
    ("purchase", BASELINE),
    ("signup", ARTIFACT),
    ("view", NOISE),
)
CHUNK_LENGTH = 25
# Split of encoded sequences by h('split', id) % 10.
SPLIT_BUCKETS = (("icl", 0, 0), ("train", 1, 6), ("test", 7, 9))
# Neutral label dictionary for the multiple-choice task (labels 0..9).
CHOICE_NAMES = (
    "A: alpha", "B: beta", "C: gamma", "D: delta", "E: epsilon",
    "F: zeta", "G: eta", "H: theta", "I: iota", "J: kappa",
)
CHOICE_QUESTION = "Which class best describes this item?"
# System prompt of the tuned-model records (this repo's own wording).
TUNED_SYSTEM_PROMPT = (
    "You read heart-rhythm strips written as text. "
    "Count the '|' characters (narrow peaks) and the ':' characters (wide peaks), "
    "add them up, and classify: Brady up to 7, Normal 8 to 11, Tachy 12 or more."
)
TUNED_USER_TEMPLATE = "Sequence: {sequence}"
TUNED_RESPONSE_FORMAT = "Narrow_peaks, Wide_peaks, Total_peaks, Label"
