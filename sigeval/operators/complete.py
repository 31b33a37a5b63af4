"""E1 — batch completion through a user-supplied client (the one Python step).

``complete_batch`` runs ``mapInPandas``: the client factory is called once per
partition, rows are sent in Arrow batches, and failures are recorded per row
in an ``error`` column instead of aborting the run (``fail_fast=True`` keeps
the abort-on-first-error behaviour). ``num_slots`` bounds concurrent calls by
repartitioning first. The output should be persisted (``persist_completions``)
before parsing so that no later action calls the model again.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..session import checkpoint_dir

OUTPUT_SCHEMA = "id string, raw_response string, error string"


class RuleClient:
    """Local stand-in model: counts the peaks of the last ``Strip:``/
    ``Sequence:`` line of the user message and answers with the JSON summary
    (or, when the prompt asks for concepts, a fenced concept JSON). No
    network."""

    _line = re.compile(r"(?:Strip|Sequence|Sample): *([^\n]*)")

    def predict(self, messages: list[dict], max_tokens: int = 500) -> str:
        user = [m["content"] for m in messages if m["role"] == "user"]
        found = self._line.findall(user[-1]) if user else []
        if not found:
            raise ValueError("no sequence in prompt")
        seq = found[-1].strip()
        narrow, wide = seq.count(K.NARROW), seq.count(K.WIDE)
        total = narrow + wide
        label = (K.CLASSES[0] if total <= K.BRADY_MAX_PEAKS
                 else K.CLASSES[1] if total <= K.NORMAL_MAX_PEAKS else K.CLASSES[2])
        if any(K.CBM_CLASS_KEY in m["content"] for m in messages):
            out = (f'```json\n{{"{K.CBM_CONCEPTS_KEY}": {{"{K.CONCEPT_KEYS[0]}": {narrow}, '
                   f'"{K.CONCEPT_KEYS[1]}": {wide}}}, "{K.CBM_CLASS_KEY}": "{label}"}}\n```')
        else:
            out = (f'{{"Narrow_peaks": {narrow}, "Wide_peaks": {wide}, '
                   f'"Total_peaks": {total}, "Label": "{label}"}}')
        return out


class ExampleClient:
    """Local stand-in that learns only from its prompt: the class of the labelled
    example whose peak count is nearest (the first of equal ones), or the
    middle class when the prompt has none. No network."""

    _example = re.compile(r"Sequence: *([^\n]*)\n(?:[^\n]*\n)*?Classification: *([^\n]*)")
    _question = re.compile(r"Strip: *([^\n]*)")

    def predict(self, messages: list[dict], max_tokens: int = 500) -> str:
        prompt = messages[-1]["content"]
        question = self._question.findall(prompt)
        if not question:
            raise ValueError("no strip in prompt")
        peaks = lambda s: s.count(K.NARROW) + s.count(K.WIDE)
        here = peaks(question[-1])
        near = min(self._example.findall(prompt), key=lambda e: abs(peaks(e[0]) - here), default=None)
        return f"This looks like {near[1].strip() if near else K.CLASSES[1]}."


def complete_batch(df: DataFrame, client_factory: Callable[[], object], id_col: str = "id",
                   messages_col: str = "messages", max_tokens: int = 500,
                   fail_fast: bool = False, num_slots: int | None = None,
                   threads_per_task: int = 1, retries: int = 0,
                   retry_wait_s: float = 0.5) -> DataFrame:
    """(id, messages ARRAY<STRUCT<role, content>>) -> (id, raw_response, error).

    ``threads_per_task`` sends that many requests at once from each task (calls
    are I/O-bound; results keep row order); ``retries`` re-sends a failed
    request with a growing wait before the error is recorded. Total
    concurrency is tasks x threads, bounded by ``num_slots`` when given."""
    src = df.select(F.col(id_col).cast("string").alias("id"), F.col(messages_col).alias("messages"))
    if num_slots:
        src = src.repartition(int(num_slots))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = client_factory()

        def call(msgs):
            for attempt in range(retries + 1):
                try:
                    conv = [{"role": m["role"], "content": m["content"]} for m in msgs]
                    return str(client.predict(conv, max_tokens=max_tokens)).strip(), None
                except Exception as exc:  # noqa: BLE001 - recorded per row
                    if attempt < retries:
                        time.sleep(retry_wait_s * (2 ** attempt))
                        continue
                    if fail_fast:
                        raise
                    return None, f"{type(exc).__name__}: {exc}"

        pool = ThreadPoolExecutor(threads_per_task) if threads_per_task > 1 else None
        try:
            for pdf in batches:
                msgs = list(pdf["messages"])
                out = list(pool.map(call, msgs)) if pool else [call(m) for m in msgs]
                yield pd.DataFrame({"id": pdf["id"], "raw_response": [o[0] for o in out],
                                    "error": [o[1] for o in out]})
        finally:
            if pool:
                pool.shutdown(wait=True)

    return src.mapInPandas(run, OUTPUT_SCHEMA)


def persist_completions(df: DataFrame) -> DataFrame:
    """Write completions once (reliable checkpoint in the shared checkpoint
    folder) so parsing and metrics never re-run the model."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
