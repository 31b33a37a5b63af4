"""J — training-record arrays: token ids and loss masks.

Ids come from a vocabulary fitted to the rows (:func:`fit_vocabulary`,
:func:`encode`), from a user's tokenizer with character offsets
(:func:`token_spans_udf`), or from a deterministic stand-in that hashes
tokens (:func:`hashed_token_ids`).

The loss of a prompt/completion pair falls on the completion. The text is
tokenised as a whole, as the model sees it, so a token may cross the border; it
counts as prompt unless ``crossing="keep"``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.util import as_col
from .ordering import global_index

TOKEN_PATTERN = r"\w+|[^\w\s]"
# every character belongs to a token; white space goes with what follows it
SPAN_PATTERN = r"\s?\w+|\s?[^\w\s]|\s"
PAD_ID = 0
BOS_ID = 1
IMAGE_ID = 2
VOCAB = 32000
RESERVED = 3


def hashed_token_ids(text, pattern: str = TOKEN_PATTERN, vocab: int = VOCAB) -> Column:
    """ARRAY<BIGINT>: each regex token mapped to ``md5`` bucket + reserved ids."""
    toks = F.regexp_extract_all(as_col(text), F.lit(pattern), 0)
    return F.transform(toks, lambda t: F.pmod(
        F.conv(F.substring(F.md5(t), 1, 6), 16, 10).cast("bigint"), F.lit(vocab)) + RESERVED)


def mask_ids(ids, masked=(PAD_ID, IMAGE_ID), mask_id: int = K.MASK_ID) -> Column:
    """J1 — copy ids to labels; ids in ``masked`` become ``mask_id``."""
    return F.transform(as_col(ids), lambda x: F.when(x.isin(*masked), F.lit(mask_id)).otherwise(x))


def mask_prefix(labels, prefix_len, mask_id: int = K.MASK_ID) -> Column:
    """J2 — loss on the completion only: positions before ``prefix_len`` masked."""
    return F.transform(as_col(labels), lambda x, i: F.when(i < as_col(prefix_len), F.lit(mask_id))
                       .otherwise(x))


def pad_to(ids, length, pad_id: int = PAD_ID) -> Column:
    """Right-pad an id array to ``length`` with ``pad_id``."""
    a = as_col(ids)
    fill = F.array_repeat(F.lit(pad_id).cast("bigint"), F.greatest(as_col(length) - F.size(a), F.lit(0)))
    return F.concat(a, fill)


# ---------------------------------------------------------------- borders by offsets
def masked_tokens(tokens, border, crossing: str = "mask") -> Column:
    """How many leading tokens lie in the first ``border`` characters of the
    text that ``tokens`` (all its tokens, no character left out) spell: one pass
    over the lengths. The token that crosses the border counts with
    ``crossing="mask"``, and not with ``"keep"``."""
    if crossing not in ("mask", "keep"):
        raise ValueError(f"crossing is mask or keep, not {crossing}")
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"))

    def step(acc, t):
        end = acc["at"] + F.length(t)
        inside = (acc["at"] < border) if crossing == "mask" else (end <= border)
        return F.struct(end.alias("at"), (acc["n"] + inside.cast("int")).alias("n"))

    return F.aggregate(as_col(tokens), zero, step, lambda acc: acc["n"])


def masked_spans(spans, border, crossing: str = "mask") -> Column:
    """The same for spans ``ARRAY<STRUCT<id, start, end>>`` of a tokenizer that
    may leave characters out."""
    inside = (lambda s: s["start"] < border) if crossing == "mask" else (lambda s: s["end"] <= border)
    return F.size(F.filter(as_col(spans), inside))


def tokens(df: DataFrame, text_col: str, border_col: str, pattern: str = SPAN_PATTERN, crossing: str = "mask") -> DataFrame:
    """(id, tokens, n_masked) of each text."""
    toks = F.regexp_extract_all(F.col(text_col), F.lit(pattern), 0)
    return df.select("id", toks.alias("tokens"), F.col(border_col).alias("_b")).select(
        "id", "tokens", masked_tokens("tokens", F.col("_b"), crossing).alias("n_masked"))


def fit_vocabulary(tokenised: DataFrame) -> DataFrame:
    """(token, token_id): distinct tokens numbered in code-point order after the
    reserved ids. Numbered by first characters, never in one task."""
    words = tokenised.select(F.explode("tokens").alias("token")).distinct()
    return global_index(words, ["token"], F.substring("token", 1, 2), out="_n").select(
        "token", (F.col("_n") + RESERVED).cast("bigint").alias("token_id"))


def encode(tokenised: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, n_masked, pos, token_id) of every token. The vocabulary is broadcast
    only if Spark measures it under its threshold; beyond, frequent tokens are
    split by the adaptive skew join."""
    rows = tokenised.select("id", "n_masked", F.posexplode("tokens").alias("pos", "token"))
    return rows.join(vocabulary, "token").select("id", "n_masked", "pos", "token_id")


def windows(ids: DataFrame, length: int, image_slots: int = 0) -> DataFrame:
    """(id, window, ids, n_masked): each record is a first id, ``image_slots``
    image ids and its tokens, cut into windows of ``length`` ids; the last one is
    padded. ``n_masked`` counts the leading ids too. No group exceeds ``length``."""
    lead = [BOS_ID] + [IMAGE_ID] * image_slots
    at = F.col("pos") + len(lead)
    placed = ids.select("id", (F.col("n_masked") + len(lead)).alias("n_masked"), at.alias("at"), "token_id")
    first = ids.where("pos = 0").select("id", (F.col("n_masked") + len(lead)).alias("n_masked"), F.posexplode(
        F.array(*[F.lit(i).cast("bigint") for i in lead])).alias("at", "token_id"))
    window = F.floor(F.col("at") / length).cast("bigint")
    return (placed.unionByName(first).groupBy("id", "n_masked", window.alias("window"))
            .agg(F.array_sort(F.collect_list(F.struct("at", "token_id"))).alias("_ids"))
            .select("id", "window", pad_to(F.transform("_ids", lambda x: x["token_id"]), F.lit(length)).alias("ids"), "n_masked"))


def window_labels(ids, n_masked, window, length: int) -> Column:
    """Labels of a window: pad, image and prompt ids are masked."""
    inside = F.greatest(as_col(n_masked) - as_col(window) * length, F.lit(0))
    return mask_prefix(mask_ids(ids), inside)


def token_spans_udf(tokenizer_factory):
    """Wrap a tokenizer (``str -> [(id, start, end)]`` by characters) as an
    Arrow-batched UDF; the factory runs once per Python worker."""
    state = {}

    @F.pandas_udf("array<struct<id:bigint,start:int,end:int>>")
    def _spans(s: pd.Series) -> pd.Series:
        if "tok" not in state:
            state["tok"] = tokenizer_factory()
        return s.map(lambda x: None if x is None else [{"id": i, "start": a, "end": b} for i, a, b in state["tok"](x)])

    return _spans


def token_ids_udf(tokenizer_factory):
    """Wrap a user tokenizer (``str -> list[int]``) as an Arrow-batched UDF;
    the factory runs once per Python worker."""
    state = {}

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def _ids(s: pd.Series) -> pd.Series:
        tok = state.get("tok")
        if tok is None:
            tok = state["tok"] = tokenizer_factory()
        return s.map(lambda x: None if x is None else [int(v) for v in tok(x)])

    return _ids
