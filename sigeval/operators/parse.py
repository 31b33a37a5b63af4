"""F — reply parsing as column expressions (no Python workers).

JSON strictness: Spark's JSON readers stop after the first value and would
accept ``{..}{..}`` or ``{..} trailing``, which Python's ``json.loads``
rejects. :func:`json_object` therefore finds where the first top-level value
closes with a one-pass character scan (strings and escapes respected) and
only parses text that ends there; single quotes and unquoted names are off.
``strict_json_valid`` is an optional
Arrow-batched ``json.loads`` check.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.util import as_col, strip

JSON_OPTIONS = {"allowSingleQuotes": "false", "allowUnquotedFieldNames": "false",
                "mode": "PERMISSIVE"}
# the first object with at most one nested level; possessive, so that a reply
# with very many braces neither backtracks nor recurses
EMBEDDED_OBJECT = r"(?s)\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\}"


def first_value_end(text) -> Column:
    """0-based position where the first top-level JSON object or array of
    ``text`` closes (-1 if it never does). One pass over the characters that
    tracks nesting depth, string state and escapes, so braces inside strings
    do not count."""
    t = as_col(text)
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(False).alias("in_str"),
                    F.lit(False).alias("esc"), F.lit(-1).alias("end"))

    def step(st, c):
        done = st["end"] >= 0
        opens = ~st["in_str"] & c.isin("{", "[")
        closes = ~st["in_str"] & c.isin("}", "]")
        depth = (F.when(done, st["depth"]).when(opens, st["depth"] + 1)
                 .when(closes, st["depth"] - 1).otherwise(st["depth"]))
        in_str = (F.when(done, st["in_str"])
                  .when(st["in_str"], F.when(st["esc"], F.lit(True)).otherwise(c != '"'))
                  .otherwise(c == '"'))
        esc = F.when(done, F.lit(False)).otherwise(st["in_str"] & ~st["esc"] & (c == "\\"))
        end = F.when(~done & closes & (st["depth"] == 1), st["i"]).otherwise(st["end"])
        return F.struct((st["i"] + 1).alias("i"), depth.alias("depth"), in_str.alias("in_str"),
                        esc.alias("esc"), end.alias("end"))

    return F.aggregate(F.split(t, ""), zero, step, lambda st: st["end"])


def json_object(text) -> Column:
    """``map<string,string>`` of a text that is exactly one JSON object; null
    otherwise. Nested values come back as their JSON text. Spark's JSON
    readers stop after the first value, so text after the object's closing
    brace (``{..}{..}``, ``{..} x``) is rejected here explicitly, as
    ``json.loads`` does."""
    t = strip(text)
    end = first_value_end(t)
    single = t.startswith("{") & (end == F.length(t) - 1)
    return F.when(single, F.from_json(t, T.MapType(T.StringType(), T.StringType()), JSON_OPTIONS))


def last_value(m: Column, key: str) -> Column:
    """The value of a key that may occur repeatedly: the last one counts."""
    return F.try_element_at(F.filter(F.map_entries(m), lambda e: e["key"] == key), F.lit(-1))["value"]


# ---------------------------------------------------------------- F1 keyword
def parse_keyword(reply, classes=K.CLASSES) -> Column:
    """First class (in class order, not text order) whose lower-case name is
    a substring of the lower-cased reply; null if none."""
    low = F.lower(strip(reply))
    out = None
    for c in classes:
        hit = F.contains(low, F.lit(c.lower()))
        out = F.when(hit, F.lit(c)) if out is None else out.when(hit, F.lit(c))
    return out


def parse_keyword_lower(reply, classes=K.CLASSES) -> Column:
    """Keyword fallback of the tuned parser: same search, result capitalised
    (``brady`` -> ``Brady``)."""
    low = F.lower(as_col(reply))
    out = None
    for c in classes:
        word = c.lower()
        hit = F.contains(low, F.lit(word))
        out = (F.when(hit, F.lit(word.capitalize())) if out is None
               else out.when(hit, F.lit(word.capitalize())))
    return out


# ---------------------------------------------------------------- F2 fenced JSON
def fenced_body(reply) -> Column:
    """Body of a ```json fence (first tag to the next fence), else of a plain
    fence (first to last fence), else the whole stripped reply. An unclosed
    fence gives null."""
    s = strip(reply)
    tag = F.instr(s, "```json")
    t_start = tag + 7
    rel = F.instr(F.substring(s, t_start, F.length(s)), "```")
    tagged = F.when(rel > 0, strip(F.substring(s, t_start, rel - 1)))
    first = F.instr(s, "```")
    p_start = first + 3
    last = F.length(s) - F.instr(F.reverse(s), "```") - 1
    plain = F.when(last > first, strip(F.substring(s, p_start, last - p_start))).otherwise(F.lit(""))
    return F.when(tag > 0, tagged).when(first > 0, plain).otherwise(s)


def parse_fenced_json(reply) -> Column:
    """Concept-mode reply: the object must hold ``conceptos`` and ``fc_clase``;
    returns ``fc_clase`` (unvalidated) or null."""
    m = json_object(fenced_body(reply))
    ok = F.map_contains_key(m, K.CBM_CONCEPTS_KEY) & F.map_contains_key(m, K.CBM_CLASS_KEY)
    return F.when(ok, last_value(m, K.CBM_CLASS_KEY))


def parse_fenced_concepts(reply) -> Column:
    m = json_object(fenced_body(reply))
    ok = F.map_contains_key(m, K.CBM_CONCEPTS_KEY) & F.map_contains_key(m, K.CBM_CLASS_KEY)
    return F.when(ok, last_value(m, K.CBM_CONCEPTS_KEY))


# types of the concepts in a reply, by key
CONCEPT_TYPES = dict(zip(K.CONCEPT_KEYS, ("bigint", "bigint", "double", "double", "boolean")))


def concept_values(reply) -> Column:
    """F6 — the concepts of a reply with their types: a struct with one field per
    key, null where the reply lacks it or holds another type, and ``payload``,
    the whole object as VARIANT. Numbers stay numbers. Null for a reply that
    :func:`parse_fenced_json` would not read."""
    v = F.try_parse_json(parse_fenced_concepts(reply))
    fields = [F.try_variant_get(v, f"$.{k}", t).alias(k) for k, t in CONCEPT_TYPES.items()]
    return F.when(v.isNotNull(), F.struct(*fields, v.alias("payload")))


# ---------------------------------------------------------------- F3 embedded JSON
def parse_embedded_json(reply) -> Column:
    """Tuned-model reply: the first embedded object; its ``Label`` when it
    parses and has that key (value may be null), else the capitalised keyword
    fallback over the whole reply, else null."""
    r = as_col(reply)
    obj = F.regexp_extract(r, EMBEDDED_OBJECT, 0)
    m = F.when(obj != "", json_object(obj))
    has = F.coalesce(F.map_contains_key(m, "Label"), F.lit(False))
    return F.when(has, last_value(m, "Label")).otherwise(parse_keyword_lower(r))


# ---------------------------------------------------------------- F4 / F5 choices
def parse_choice(reply, names=K.CHOICE_NAMES) -> Column:
    """First label in list order whose ``X: name`` or ``(X) name`` occurs in
    the reply; -1 when none. The label list is a small fixed parameter, so
    this is a CASE chain, not a join."""
    r = as_col(reply)
    out = None
    for i, name in enumerate(names):
        alt = "(" + name.replace(": ", ") ")
        hit = F.contains(r, F.lit(name)) | F.contains(r, F.lit(alt))
        out = F.when(hit, F.lit(i)) if out is None else out.when(hit, F.lit(i))
    return F.coalesce(out, F.lit(-1)).cast("bigint")


def parse_exact(reply, names=K.CHOICE_NAMES) -> Column:
    """Label whose name equals the whole reply; -1 when none."""
    m = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    return F.coalesce(F.try_element_at(m, as_col(reply)), F.lit(-1)).cast("bigint")


# ---------------------------------------------------------------- F7
def completion_label(completion) -> Column:
    return F.get_json_object(as_col(completion), "$.Label")


# ---------------------------------------------------------------- B4 / B5
def correct_icl(pred, label) -> Column:
    """ICL form: a missing prediction becomes ``Unknown`` before comparing."""
    return F.coalesce(as_col(pred), F.lit(K.UNKNOWN)).eqNullSafe(as_col(label))


def correct_tuned(pred, label) -> Column:
    """Tuned form: null or empty prediction is wrong."""
    p = as_col(pred)
    return F.coalesce((p != "") & (p == as_col(label)), F.lit(False))


# ---------------------------------------------------------------- strict check
@F.pandas_udf(T.BooleanType())
def strict_json_valid(s: pd.Series) -> pd.Series:
    """Optional exact ``json.loads`` check (Arrow-batched)."""
    def ok(x):
        if x is None:
            return None
        try:
            json.loads(x)
            return True
        except ValueError:
            return False
    return s.map(ok)
