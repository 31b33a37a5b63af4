"""Secret scan with multipart credential linking.

Strong parts are reported wherever they stand: ``assign`` (a named secret with
its value), ``access`` (an access key identifier) and ``hex`` (a long
hexadecimal run). Weak candidates mean little alone: ``ident`` (a user or
client identifier), ``opaque`` (a long mixed run) and ``endpoint`` (a URL).
Each part plays a role, identifier, secret or endpoint, and a weak candidate is
reported only where its complements stand in the same scope:

* an identifier needs a secret, a secret needs an identifier,
* an endpoint needs both.

Scopes are blocks of a text between blank lines, of any length. The link is an
interval join along the sorted starts of one document's parts: per role it keeps
the furthest end before and the nearest start after each part in its scope, so the
work is linear in the parts and no pairs are formed. Distance only scores a link:
``widest_gap`` is the largest gap, in code points, between a reported weak span and
the nearest part of a role that it needs (0 where they touch or overlap, null without
such spans). An optional ``reach`` bounds the gap. A scope never crosses a document,
so documents need no shuffle.

Edge cases: null text is empty (no spans, the digest of the empty string);
repeated and null ids give one row per input row; offsets are code points; an
empty table gives no rows; other columns are ignored by :func:`scan` and kept
by :func:`redact`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record_batch, slices, text_or_empty

# fixed values: the strong patterns, in the order in which kinds are listed
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")     # maximal runs, as long ones only are kept
ASSIGN_VALUE, ACCESS_LENGTH = 6, 20
KINDS = ("assign", "access", "hex", "ident", "opaque", "endpoint")
BASE = KINDS[:3]
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret",
        "ident": "identifier", "opaque": "secret", "endpoint": "endpoint"}
NEEDS = {"identifier": ("secret",), "secret": ("identifier",), "endpoint": ("identifier", "secret")}
IDENT = re.compile(r"""\b(?:user(?:name|_?id)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""",
                   re.I | re.A)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{32,}", re.A)
ENDPOINT = re.compile(r"""https?://[^\s"'<>()]{4,}""")
BLANK = re.compile(r"\n[\x20\t\r]*\n")

Span = tuple[int, int, str]


def strong_parts(text: str) -> list[Span]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def weak_parts(text: str, strong: list[Span]) -> list[Span]:
    """Weak candidates: endpoints, which may hold strong parts, and identifiers and
    opaque runs outside every strong part."""
    found = [(m.start(), m.end(), k) for k, p in (("ident", IDENT), ("opaque", OPAQUE), ("endpoint", ENDPOINT))
             for m in p.finditer(text)]
    if not found:
        return []
    # both lists by start; strong ends only grow in effect, so one sweep does
    out, ends, at, todo = [], 0, 0, sorted(strong)
    for span in sorted(found):
        while at < len(todo) and todo[at][0] <= span[0]:
            ends = max(ends, todo[at][1])
            at += 1
        if span[2] == "endpoint" or ends <= span[0] and not (at < len(todo) and todo[at][0] < span[1]):
            out.append(span)
    return out


def linked(text: str, parts: list[Span], reach: int | None = None) -> list[tuple[int, Span]]:
    """The weak parts whose complements stand in their scope, each with the largest
    of the gaps to the nearest part of each role that it needs."""
    breaks = [m.start() for m in BLANK.finditer(text)] + [len(text) + 1]
    scoped, b = [], 0
    for p in sorted(parts):
        while breaks[b] < p[0]:
            b += 1
        scoped.append((b, p))
    near: list[dict[str, int]] = [{} for _ in scoped]
    last: dict[str, tuple[int, int]] = {}
    for i, (scope, (start, end, kind)) in enumerate(scoped):
        near[i] = {r: max(0, start - e) for r, (s, e) in last.items() if s == scope}
        before = last.get(ROLE[kind], (-1, 0))
        last[ROLE[kind]] = (scope, max(end, before[1]) if before[0] == scope else end)
    after: dict[str, tuple[int, int]] = {}
    for i in range(len(scoped) - 1, -1, -1):
        scope, (start, end, kind) = scoped[i]
        for r, (s, a) in after.items():
            if s == scope:
                near[i][r] = min(near[i].get(r, len(text)), max(0, a - end))
        after[ROLE[kind]] = (scope, start)
    out = []
    for (_, p), gaps in zip(scoped, near):
        needs = NEEDS[ROLE[p[2]]]
        if p[2] not in BASE and all(r in gaps for r in needs):
            gap = max(gaps[r] for r in needs)
            if reach is None or gap <= reach:
                out.append((gap, p))
    return out


def _order(p: Span) -> tuple[int, int, int]:
    return p[0], KINDS.index(p[2]), p[1]


def scored_spans(text: str, reach: int | None = None) -> tuple[list[Span], list[tuple[int, Span]]]:
    """Strong spans by start and then kind, and the linked weak ones with their gaps."""
    strong = strong_parts(text)
    weak = weak_parts(text, strong)
    return sorted(strong, key=_order), linked(text, strong + weak, reach) if weak else []


def find_spans(text: str, reach: int | None = None) -> tuple[list[Span], list[Span]]:
    """Strong spans, and all reported spans, by start and then kind."""
    strong, weak = scored_spans(text, reach)
    return strong, sorted(strong + [p for _, p in weak], key=_order)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


OUT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
                 ("base_sha256", pa.string()), ("spans", pa.string()), ("n_linked", pa.int64()),
                 ("widest_gap", pa.int64())])


def scan(docs: DataFrame, reach: int | None = None) -> DataFrame:
    """One row per document: counts, digest of the strong spans, all spans, the
    number of linked weak ones and their widest gap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                base, weak = scored_spans(text, reach)
                spans = sorted(base + [p for _, p in weak], key=_order)
                n = {k: sum(p[2] == k for p in base) for k in BASE}
                rows.append((doc_id, n["assign"], n["access"], n["hex"],
                             hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans),
                             len(weak), max((gap for gap, _ in weak), default=None)))
            yield record_batch(OUT, dict(zip(OUT.names, map(list, zip(*rows)))))

    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
            .mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
                        "n_linked long, widest_gap long"))


def redacted(text: str, reach: int | None = None) -> str:
    """The text with every reported span replaced by ``[kind]``; overlapping
    spans are replaced together under the kind of the first."""
    out, at = [], 0
    for start, end, kind in find_spans(text, reach)[1]:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", reach: int | None = None) -> DataFrame:
    """``docs`` with secrets masked in ``text_col`` (null stays null) and all
    other columns as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            texts = [t if t is None else redacted(t, reach) for t in b.column(text_col).to_pylist()]
            i = b.schema.get_field_index(text_col)
            yield pa.RecordBatch.from_arrays([pa.array(texts, b.schema.field(j).type) if j == i else b.column(j)
                                              for j in range(b.num_columns)], schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
