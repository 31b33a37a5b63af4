"""D — prompt and training-record rendering as native string expressions.

Templates are split on the driver into literal pieces and placeholders
(``string.Formatter`` rules: ``{{``/``}}`` are literal braces), then compiled
to ``concat(lit, col, lit, ...)``. Values are inserted once and never
re-scanned, so a sequence holding ``{examples}`` is inserted unchanged.

The few-shot block depends only on the sampled examples (at most
``3 * n_per_class`` rows), so it is built once as a one-row DataFrame and
attached to every test row as a scalar subquery — no per-row re-rendering and
no join.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import features as X
from ..functions.util import as_col

TEMPLATE_DIR = Path(__file__).resolve().parent.parent / "templates"
PROMPT_TYPES = ("system_prompt", "user_prompt_zero_shot", "user_prompt_few_shot")


# ---------------------------------------------------------------- B7 / A11
def check_task(task: int) -> str:
    if task not in K.TASK_MODALITY:
        raise ValueError(f"no task {task}; there are {sorted(K.TASK_MODALITY)}")
    return K.TASK_MODALITY[task]


def check_approach(approach: str) -> str:
    if approach not in K.APPROACHES:
        raise ValueError(f"no approach {approach}; there are {sorted(K.APPROACHES)}")
    return approach


def load_prompt(approach: str, prompt_type: str, task: int = 1,
                prompts_dir: str | Path | None = None) -> str:
    """A11 — template text for (task, approach, type), stripped; a missing
    file is an error."""
    check_task(task)
    base = Path(prompts_dir) if prompts_dir else TEMPLATE_DIR
    path = base / f"task{task}" / approach / f"{prompt_type}.txt"
    if not path.exists():
        raise FileNotFoundError(f"no template at {path}")
    return path.read_text(encoding="utf-8").strip()


# ---------------------------------------------------------------- D4 templates
def fill_template(template: str, **values) -> Column:
    """``template.format(**values)`` as a Column. Values are Columns or
    Python strings; every placeholder must be supplied."""
    parts: list[Column] = []
    for literal, field, spec, conv in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is None:
            continue
        if field not in values:
            raise KeyError(field)
        if spec or conv:
            raise ValueError(f"format spec not supported for {{{field}}}")
        v = values[field]
        parts.append(F.lit(v) if isinstance(v, str) else v.cast("string"))
    if not parts:
        return F.lit("")
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _lines(lines, **values) -> Column:
    return fill_template("\n".join(lines), **values)


# ---------------------------------------------------------------- D1 / D2 examples
def example_regular(seq, label, n) -> Column:
    """Six-line example; counts come from the string, class from the label."""
    s = as_col(seq)
    return _lines(K.EXAMPLE_REGULAR_LINES, n=as_col(n), sequence=s,
                  narrow=X.narrow_peaks(s), wide=X.wide_peaks(s), total=X.total_peaks(s),
                  label=as_col(label))


def example_cbm(seq, concepts, label, n) -> Column:
    """Concept example: the concept struct as indented JSON (``{}`` if null)."""
    return _lines(K.EXAMPLE_CBM_LINES, n=as_col(n), sequence=as_col(seq),
                  concepts_json=X.concepts_json(as_col(concepts)), label=as_col(label))


def render_example(approach: str, seq, label, n, concepts=None) -> Column:
    check_approach(approach)
    if approach == "regular":
        return example_regular(seq, label, n)
    c = concepts if concepts is not None else X.concepts(as_col(seq))
    return example_cbm(seq, c, label, n)


# ---------------------------------------------------------------- D3 few-shot block
def few_shot_block(examples: DataFrame, approach: str = "regular",
                   order: tuple[str, ...] = ("shuffle_key", "id"),
                   seq_col: str = "sequence", label_col: str = "label",
                   renderer=None) -> DataFrame:
    """One row ``(n_examples, examples)``: examples numbered from 1 in
    ``order`` and joined by a blank line. ``examples`` is a bounded sample."""
    check_approach(approach)
    render = renderer or (lambda e, i: render_example(approach, e[seq_col], e[label_col], i))
    keyed = examples.select(F.struct(*[F.col(c) for c in order],
                                     F.col(seq_col), F.col(label_col)).alias("e"))
    agg = keyed.agg(F.array_sort(F.collect_list("e")).alias("es"))
    return agg.select(
        F.size("es").cast("bigint").alias("n_examples"),
        F.array_join(F.transform("es", lambda e, i: render(e, i + 1)), K.EXAMPLE_SEPARATOR)
        .alias("examples"))


MAX_BLOCK_EXAMPLES = 10_000     # a block is part of every prompt, so it must be small


def block_text(examples: DataFrame, build=None, *args) -> str:
    """The block of ``examples`` as a string for the plan, so that the
    prompts are plain expressions. More examples than fit any prompt are an
    error, not a collected table."""
    if len(examples.select("id").take(MAX_BLOCK_EXAMPLES + 1)) > MAX_BLOCK_EXAMPLES:
        raise ValueError(f"more than {MAX_BLOCK_EXAMPLES} examples for one prompt")
    return (build or few_shot_block)(examples, *args).first().examples


# ---------------------------------------------------------------- D5 messages
def user_prompt(sequence, template_zero: str, template_few: str, block: Column | str | None) -> Column:
    """Zero-shot when ``block`` is None; otherwise the few-shot template, and a
    zero-shot fallback when the block is empty. A block given as text is
    decided on at once."""
    zero = fill_template(template_zero, sequence=as_col(sequence))
    if block is None or (isinstance(block, str) and not block):
        return zero
    if isinstance(block, str):
        return fill_template(template_few, sequence=as_col(sequence), examples=block)
    few = fill_template(template_few, sequence=as_col(sequence), examples=block)
    return F.when(F.coalesce(block, F.lit("")) == "", zero).otherwise(few)


def messages(test: DataFrame | None, system_text: str, user: Column) -> Column:
    """[system, user] message array. The system text is sent verbatim."""
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system_text).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )


def explode_messages(df: DataFrame, keys: list[str], col: str = "messages") -> DataFrame:
    return df.select(*keys, F.posexplode(col).alias("msg_idx", "m")).select(
        *keys, F.col("msg_idx").cast("bigint").alias("msg_idx"),
        F.col("m.role").alias("role"), F.col("m.content").alias("content"))


# ---------------------------------------------------------------- D6 / D7 chat
@dataclass(frozen=True)
class ChatTemplate:
    """Turn-based chat markup; all tokens are parameters. The defaults follow
    a common start-of-turn / end-of-turn markup (assistant turns are called
    ``model``)."""
    bos: str = "<bos>"
    turn_open: str = "<start_of_turn>"
    turn_close: str = "<end_of_turn>\n"
    assistant_role: str = "model"

    def role(self, role: Column) -> Column:
        return F.when(role == "assistant", F.lit(self.assistant_role)).otherwise(role)

    def turn(self, role: Column, content: Column) -> Column:
        return F.concat(F.lit(self.turn_open), self.role(role), F.lit("\n"), content,
                        F.lit(self.turn_close))

    @property
    def generation_header(self) -> str:
        return f"{self.turn_open}{self.assistant_role}\n"

    def render(self, msgs: Column, add_generation_prompt: bool) -> Column:
        body = F.array_join(F.transform(msgs, lambda m: self.turn(m["role"], m["content"])), "")
        head = F.lit(self.bos)
        tail = F.lit(self.generation_header if add_generation_prompt else "")
        return F.concat(head, body, tail)


TURN_TEMPLATE = ChatTemplate()


def merge_system(conv: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """D6 on a long message table: a leading system message (turn 0) is
    merged into the next message (the least later turn of the conversation) as
    ``system + "\\n\\n" + text`` with role ``user``; all other messages are kept,
    null turns and roles included. A system message that nothing follows stays.

    ``(conversation, turn)`` names a message: of repeated leading system rows the
    one of least text counts, and each row of the next turn takes it. A null
    text on either side merges as empty; null conversation ids are one
    conversation. Leading messages are joined by conversation *and* turn, one row
    per conversation, so that a huge conversation does not skew the join."""
    cols = [conv_col, turn_col, role_col, text_col]
    is_sys = F.coalesce((F.col(turn_col) == 0) & (F.col(role_col) == "system"), F.lit(False))
    heads = (conv.groupBy(F.col(conv_col).alias("_c"))
                 .agg(F.max(is_sys).alias("_any"), F.coalesce(F.min(F.when(is_sys, F.col(text_col))), F.lit("")).alias("_sys"),
                      F.min(F.when(F.col(turn_col) > 0, F.col(turn_col))).alias("_next"))
                 .where("_any"))
    joined = F.concat(F.col("_sys"), F.lit(K.SYSTEM_MERGE_SEPARATOR), F.coalesce(F.col(text_col), F.lit("")))
    follows = F.col("_sys").isNotNull()
    kept = (conv.where(~is_sys).select(*cols)
                .join(heads.where("_next is not null"),
                      F.col(conv_col).eqNullSafe(F.col("_c")) & (F.col(turn_col) == F.col("_next")), "left")
                .select(conv_col, turn_col, F.when(follows, F.lit("user")).otherwise(F.col(role_col)).alias(role_col),
                        F.when(follows, joined).otherwise(F.col(text_col)).alias(text_col)))
    alone = heads.where("_next is null").select(
        F.col("_c").alias(conv_col), F.lit(0).cast(conv.schema[turn_col].dataType).alias(turn_col),
        F.lit("system").alias(role_col), F.col("_sys").alias(text_col))
    return kept.unionByName(alone)


def chat_turn_pieces(conv: DataFrame, template: ChatTemplate = TURN_TEMPLATE,
                     add_generation_prompt: bool = True, conv_col: str = "conv_id",
                     turn_col: str = "turn", role_col: str = "role",
                     text_col: str = "text") -> DataFrame:
    """D7 distributed: the rendered chat of a conversation is the
    concatenation, in ``seq`` order, of one piece per message plus a leading
    BOS piece and (optionally) a trailing generation header. No conversation
    is ever collected into one value here; :func:`assemble_chat` does that
    for conversations known to be small."""
    body = conv.select(conv_col, F.col(turn_col).cast("bigint").alias("seq"),
                       template.turn(F.col(role_col), F.col(text_col)).alias("piece"))
    ids = conv.select(conv_col).distinct()
    bos = ids.select(conv_col, F.lit(-1).cast("bigint").alias("seq"), F.lit(template.bos).alias("piece"))
    out = bos.unionByName(body)
    if add_generation_prompt:
        last = conv.groupBy(conv_col).agg((F.max(turn_col) + 1).cast("bigint").alias("seq"))
        out = out.unionByName(last.select(conv_col, "seq",
                                          F.lit(template.generation_header).alias("piece")))
    return out


def assemble_chat(pieces: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Concatenate pieces per conversation (use only when conversations are
    bounded in size)."""
    return (pieces.groupBy(conv_col)
                  .agg(F.array_sort(F.collect_list(F.struct("seq", "piece"))).alias("_p"))
                  .select(conv_col, F.array_join(F.transform("_p", lambda p: p["piece"]), "")
                          .alias("chat")))


PART_TURNS = 1024       # turns of a conversation rendered as one value


def chat_parts(conv: DataFrame, template: ChatTemplate = TURN_TEMPLATE, add_generation_prompt: bool = True,
               part_turns: int = PART_TURNS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
               text_col: str = "text") -> DataFrame:
    """D7 — rendered chats ``(conv_id, part, n_turns, text)``: the chat of a
    conversation is the text of its parts in order. A part holds ``part_turns``
    consecutive turn numbers, so a conversation with a third of all rows is
    rendered by as many tasks as it has parts; small conversations have one part.

    The first part starts with the opening token, the last one ends with the
    generation header; both are found by an aggregate over (conversation, part)
    and joined on both, so no join is keyed by the conversation alone. Null
    turns come first, rows of one turn stand in the order of role and text, null
    texts and roles are empty, null ids are one conversation."""
    part = F.floor(F.coalesce(F.col(turn_col), F.lit(0)) / part_turns).cast("bigint")
    role = F.coalesce(F.col(role_col), F.lit(""))
    rows = conv.select(F.col(conv_col).alias("conv_id"), part.alias("part"), F.struct(
        F.col(turn_col).cast("bigint").alias("turn"), role.alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("m"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda m: template.turn(m["role"], m["text"])), "")
    parts = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n_turns"), body.alias("body"))
    ends = (conv.groupBy(F.col(conv_col).alias("conv_id")).agg(F.min(part).alias("lo"), F.max(part).alias("hi"))
            .select("conv_id", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("part"), "lo", "hi")
            .select("conv_id", "part", (F.col("part") == F.col("lo")).alias("opens"), (F.col("part") == F.col("hi")).alias("closes")))
    p, e = parts.alias("p"), ends.alias("e")
    joined = p.join(e, F.col("p.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("p.part") == F.col("e.part")), "left")
    tail = template.generation_header if add_generation_prompt else ""
    return joined.select("p.conv_id", "p.part", "p.n_turns", F.concat(
        F.when(F.col("e.opens"), F.lit(template.bos)).otherwise(F.lit("")), "p.body",
        F.when(F.col("e.closes"), F.lit(tail)).otherwise(F.lit(""))).alias("text"))


# ---------------------------------------------------------------- D8 / D9 / D11
def tuned_example(seq, label, n) -> Column:
    s = as_col(seq)
    return fill_template(K.TUNED_EXAMPLE, n=as_col(n), sequence=s,
                         response=X.target_json(s, as_col(label)))


def tuned_user_content(sequence, system_text: str, block: Column | None = None) -> Column:
    """D8 user content: zero-shot ``system\\n\\nSequence: s``; with examples the
    numbered ``Sequence/Response`` pairs sit between system text and sequence."""
    zero = fill_template(K.TUNED_USER_ZERO_SHOT, system=system_text, sequence=as_col(sequence))
    if block is None or (isinstance(block, str) and not block):
        return zero
    few = fill_template(K.TUNED_USER_FEW_SHOT, system=system_text, examples=block,
                        sequence=as_col(sequence))
    if isinstance(block, str):
        return few
    return F.when(F.coalesce(block, F.lit("")) == "", zero).otherwise(few)


def tuned_block(examples: DataFrame, order=("shuffle_key", "id")) -> DataFrame:
    """Few-shot block for the tuned prompt (examples concatenated, no separator)."""
    keyed = examples.select(F.struct(*[F.col(c) for c in order],
                                     F.col("sequence"), F.col("label")).alias("e"))
    agg = keyed.agg(F.array_sort(F.collect_list("e")).alias("es"))
    return agg.select(
        F.size("es").cast("bigint").alias("n_examples"),
        F.array_join(F.transform("es", lambda e, i: tuned_example(e["sequence"], e["label"], i + 1)),
                     "").alias("examples"))


def tuned_prompt(sequence, system_text: str, block: Column | None = None,
                 template: ChatTemplate = TURN_TEMPLATE) -> Column:
    """D8 — one user turn through the chat template with generation header."""
    user = tuned_user_content(sequence, system_text, block)
    # a single turn is rendered directly (no higher-order function), so the
    # few-shot block may be a scalar subquery
    return F.concat(F.lit(template.bos), template.turn(F.lit("user"), user),
                    F.lit(template.generation_header))


def chat_record(sequence, label, system_text: str) -> Column:
    """D11 — [system, user ``Sequence: s``, assistant answer JSON]."""
    s = as_col(sequence)
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system_text).alias("content")),
        F.struct(F.lit("user").alias("role"),
                 fill_template(K.CHAT_USER_SEQUENCE, sequence=s).alias("content")),
        F.struct(F.lit("assistant").alias("role"), X.target_json(s, as_col(label)).alias("content")),
    )


def append_turn(msgs, role: str, content) -> Column:
    """D10 — add a turn at the end of a message array."""
    return F.array_append(as_col(msgs), F.struct(F.lit(role).alias("role"),
                                                 as_col(content).alias("content")))


# ---------------------------------------------------------------- D12 / D13
def choice_question(names_sorted: Column, question: str = K.CHOICE_QUESTION) -> Column:
    """D13 — question followed by one option per line."""
    return F.concat(F.lit(question + "\n"), F.array_join(names_sorted, "\n"))


def multimodal_messages(prompt: Column, answer: Column | None) -> Column:
    """D12 — user turn [image, text]; with ``answer`` an assistant text turn."""
    part = "struct<type:string,text:string>"
    user = F.struct(F.lit("user").alias("role"), F.array(
        F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")),
        F.struct(F.lit("text").alias("type"), prompt.alias("text"))).alias("content"))
    if answer is None:
        return F.array(user)
    asst = F.struct(F.lit("assistant").alias("role"), F.array(
        F.struct(F.lit("text").alias("type"), answer.alias("text")).cast(part)).alias("content"))
    return F.array(user, asst)
