"""DuckDB oracle SQL, one statement per registered query.

Written independently of the Spark code path: window functions, ``unnest``
and ``string_agg`` where the Spark side uses higher-order functions and the
skew-safe numbering. Only the fixed values (constants, template texts) are
shared.
"""

from __future__ import annotations

import string

from .. import constants as K
from ..operators import render as R
from ..operators.experiment import GRID

NL = "chr(10)"


def lit(s: str) -> str:
    """SQL string literal (newlines kept inside the literal)."""
    return "'" + s.replace("'", "''") + "'"


def dbl(x: float) -> str:
    return f"CAST({lit(repr(float(x)))} AS DOUBLE)"


def cat(*parts: str) -> str:
    return "concat(" + ", ".join(parts) + ")"


def tmpl(template: str, **exprs: str) -> str:
    parts = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(lit(literal))
        if field is not None:
            parts.append(f"CAST({exprs[field]} AS VARCHAR)")
    return cat(*parts) if len(parts) > 1 else parts[0]


def cnt(s: str, ch: str) -> str:
    return f"CAST(length({s}) - length(replace({s}, {lit(ch)}, '')) AS BIGINT)"


def tp(s: str) -> str:
    return f"CAST(length({s}) - length(replace(replace({s}, '|', ''), ':', '')) AS BIGINT)"


def thr(t: str) -> str:
    return (f"CASE WHEN {t} <= {K.BRADY_MAX_PEAKS} THEN 'Brady' WHEN {t} <= {K.NORMAL_MAX_PEAKS} "
            f"THEN 'Normal' WHEN {t} IS NOT NULL THEN 'Tachy' END")


def h(seed_expr: str, idx: str) -> str:
    """First 8 hex digits of md5(seed:id) as BIGINT; ``seed_expr`` is SQL."""
    return (f"CAST(('0x' || substr(md5(concat({seed_expr}, ':', CAST({idx} AS VARCHAR))), 1, 8)) "
            f"AS BIGINT)")


def key(seed, idx: str) -> str:
    return f"md5(concat({lit(str(seed) + ':')}, CAST({idx} AS VARCHAR)))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def ratio(a: str, b: str) -> str:
    return (f"coalesce(round(CAST({a} AS DOUBLE) * CAST(1000000 AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0), 0)"
            f" / CAST(1000000 AS DOUBLE), 0.0)")


def nxt(label: str) -> str:
    n = len(K.CLASSES)
    return "CASE " + " ".join(
        f"WHEN {label} = {lit(c)} THEN {lit(K.CLASSES[(i + 1) % n])}" for i, c in enumerate(K.CLASSES)) + " END"


def tjson(s: str, label: str, indent: int | None = None) -> str:
    lab = f"coalesce('\"' || {label} || '\"', 'null')"
    vals = [cnt(s, "|"), cnt(s, ":"), tp(s), lab]
    if indent is None:
        parts = ["'{'"]
        for i, (k, v) in enumerate(zip(K.TARGET_KEYS, vals)):
            parts += [lit((", " if i else "") + f'"{k}": '), f"CAST({v} AS VARCHAR)"]
        parts.append("'}'")
        return cat(*parts)
    pad = " " * indent
    parts = [lit("{\n" + pad)]
    for i, (k, v) in enumerate(zip(K.TARGET_KEYS, vals)):
        parts += [lit((",\n" + pad if i else "") + f'"{k}": '), f"CAST({v} AS VARCHAR)"]
    parts.append(lit("\n}"))
    return cat(*parts)


def range_flag(ranges, label="label", peaks="total_peaks") -> str:
    return "(" + " OR ".join(f"({label} = {lit(c)} AND {peaks} BETWEEN {lo} AND {hi})"
                             for c, lo, hi in ranges) + ")"


# ---------------------------------------------------------------- features
def noise_pct(s):
    return f"round(CAST({cnt(s, '~')} + {cnt(s, '_')} AS DOUBLE) * 100.0 / NULLIF(CAST(length({s}) AS DOUBLE), 0), 2)"


def art_flag(s):
    return f"({cnt(s, '_')} * {K.ARTIFACT_SHARE_DENOM} > length({s}))"


def kw(r):
    low = f"lower({strip(r)})"
    return "CASE " + " ".join(f"WHEN contains({low}, {lit(c.lower())}) THEN {lit(c)}" for c in K.CLASSES) + " END"


def kw_lower(r):
    low = f"lower({r})"
    return "CASE " + " ".join(f"WHEN contains({low}, {lit(c.lower())}) THEN {lit(c.lower().capitalize())}"
                              for c in K.CLASSES) + " END"


def whole_obj(x):
    return f"(prefix({x}, '{{') AND suffix({x}, '}}') AND json_valid({x}))"


def fenced_body(r):
    s = strip(r)
    tag = f"instr({s}, '```json')"
    rest = f"substr({s}, {tag} + 7)"
    rel = f"instr({rest}, '```')"
    tagged = f"CASE WHEN {rel} > 0 THEN {strip(f'substr({s}, {tag} + 7, {rel} - 1)')} END"
    first = f"instr({s}, '```')"
    last = f"(length({s}) - instr(reverse({s}), '```') - 1)"
    plain = f"CASE WHEN {last} > {first} THEN {strip(f'substr({s}, {first} + 3, {last} - {first} - 3)')} ELSE '' END"
    return f"CASE WHEN {tag} > 0 THEN {tagged} WHEN {first} > 0 THEN {plain} ELSE {s} END"


def parse_fenced(r):
    b = fenced_body(r)
    return (f"CASE WHEN {whole_obj(b)} AND json_exists({b}, '$.conceptos') AND "
            f"json_exists({b}, '$.fc_clase') THEN json_extract_string({b}, '$.fc_clase') END")


EMB_RE = r"(?s)\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"


def parse_embedded(r):
    o = f"regexp_extract({r}, {lit(EMB_RE)}, 0)"
    return (f"CASE WHEN {o} <> '' AND {whole_obj(o)} AND json_exists({o}, '$.Label') "
            f"THEN json_extract_string({o}, '$.Label') ELSE {kw_lower(r)} END")


def reply(style, s, label):
    payload = cat("'{\"conceptos\": {\"C1_picos_estrechos\": '", f"CAST({cnt(s, '|')} AS VARCHAR)",
                  "', \"C2_picos_anchos\": '", f"CAST({cnt(s, ':')} AS VARCHAR)",
                  "'}, \"fc_clase\": \"'", label, "'\"}'")
    broken = cat(lit('{"Narrow_peaks": '), f"CAST({cnt(s, '|')} AS VARCHAR)", lit(', "Label": '))
    return (f"CASE {style} "
            f"WHEN 0 THEN {tjson(s, label)} "
            f"WHEN 1 THEN {cat(lit('Counting the peaks first.'), NL, lit('```json'), NL, payload, NL, lit('```'))} "
            f"WHEN 2 THEN {cat(lit('```'), NL, payload, NL, lit('```'))} "
            f"WHEN 3 THEN {cat(lit('This strip looks '), f'lower({label})', lit(' to me.'))} "
            f"WHEN 4 THEN {tjson(s, nxt(label))} "
            f"WHEN 5 THEN {cat(lit('Either '), label, lit(' or '), nxt(label), lit('.'))} "
            f"WHEN 6 THEN {broken} "
            f"ELSE '' END")


# ---------------------------------------------------------------- base CTEs
EVENT_CASE = "CASE event_type " + " ".join(f"WHEN {lit(n)} THEN {lit(s)}" for n, s in K.EVENT_SYMBOLS) + " END"
EVENT_NAMES = ", ".join(lit(n) for n, _ in K.EVENT_SYMBOLS)
SPLIT_CASE = "CASE " + " ".join(f"WHEN b BETWEEN {lo} AND {hi} THEN {lit(n)}" for n, lo, hi in K.SPLIT_BUCKETS) + " END"

BASE = f"""_ev AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn,
         {EVENT_CASE} AS sym
  FROM events),
_ch AS (SELECT user_id, rn // {K.CHUNK_LENGTH} AS chunk, string_agg(sym, '' ORDER BY rn) AS sequence,
               count(*) AS n FROM _ev GROUP BY user_id, rn // {K.CHUNK_LENGTH}),
seqs AS (SELECT concat('u', user_id, '_', chunk) AS id, user_id, CAST(chunk AS BIGINT) AS chunk, sequence
         FROM _ch),
_lb AS (SELECT *, {h("'split'", 'id')} % 10 AS b FROM seqs),
lab AS (SELECT id, user_id, chunk, sequence, {SPLIT_CASE} AS split, {tp('sequence')} AS total_peaks,
               {thr(tp('sequence'))} AS label FROM _lb),
resp AS (SELECT *, {reply(h("'resp'", 'id') + ' % 8', 'sequence', 'label')} AS raw_response FROM lab)"""


def with_base(*ctes: str, select: str) -> str:
    body = ",\n".join((BASE,) + ctes)
    return f"WITH {body}\n{select}"


CLASSES_VALUES = "(VALUES " + ", ".join(f"({i}, {lit(c)})" for i, c in enumerate(K.CLASSES)) + ") AS cls(ord, label)"
RANGES_VALUES = "(VALUES " + ", ".join(
    [f"('in', {lit(c)}, {lo}, {hi})" for c, lo, hi in K.IN_RANGES] +
    [f"('ood', {lit(c)}, {lo}, {hi})" for c, lo, hi in K.OOD_RANGES]) + ") AS rg(regime, label, lo, hi)"
NAMES_LIST = "[" + ", ".join(lit(n) for n in K.CHOICE_NAMES) + "]"
ICL_PRED = f"""icl_pred AS (SELECT id, label, coalesce({kw('raw_response')}, 'Unknown') AS pred FROM resp WHERE split = 'test'),
icl_eval AS (SELECT id, label, pred, (pred = label) AS correct FROM icl_pred)"""
FT_PRED = f"""ft_pred AS (SELECT id, label, raw_response, {parse_embedded('raw_response')} AS pred FROM resp WHERE split = 'test'),
ft_eval AS (SELECT id, label, pred, coalesce(pred <> '' AND pred = label, false) AS correct, raw_response FROM ft_pred)"""


def example_regular_sql(n, s, label):
    return cat(lit("Example "), f"CAST({n} AS VARCHAR)", lit(":\nSequence: "), s,
               lit("\nNarrow peaks (|): "), f"CAST({cnt(s, '|')} AS VARCHAR)",
               lit("\nWide peaks (:): "), f"CAST({cnt(s, ':')} AS VARCHAR)",
               lit("\nTotal peaks: "), f"CAST({tp(s)} AS VARCHAR)", lit("\nClassification: "), label)


def irregularity_cte(src="seqs"):
    return f"""_pos AS (SELECT id, i - 1 AS pos FROM (SELECT id, sequence, unnest(generate_series(1, length(sequence))) AS i FROM {src})
              WHERE substr(sequence, i, 1) IN ('|', ':')),
_iv AS (SELECT id, pos - lag(pos) OVER (PARTITION BY id ORDER BY pos) AS x FROM _pos),
_ivs AS (SELECT id, count(x) AS n, sum(x) AS s1, sum(x * x) AS s2 FROM _iv WHERE x IS NOT NULL GROUP BY id),
irr AS (SELECT s.id, CASE WHEN i.n >= 2 AND i.s1 > 0
          THEN round(sqrt(CAST(i.n * i.s2 - i.s1 * i.s1 AS DOUBLE)) / CAST(i.s1 AS DOUBLE), 3) ELSE 0.0 END AS irregularity
        FROM {src} s LEFT JOIN _ivs i ON s.id = i.id)"""


def icl_sample_cte(n, name="icl_ex"):
    return f"""{name} AS (SELECT * FROM (
    SELECT id, sequence, label, {key(42, 'id')} AS k,
           row_number() OVER (PARTITION BY label ORDER BY {key(42, 'id')}, id) - 1 AS class_rank
    FROM lab WHERE split = 'icl' AND label IN ({", ".join(lit(c) for c in K.CLASSES)})) WHERE class_rank < {n})"""


def block_cte(n, name="block"):
    return f"""{icl_sample_cte(n, name + '_ex')},
{name}_num AS (SELECT *, row_number() OVER (ORDER BY k, id) AS n FROM {name}_ex),
{name} AS (SELECT count(*) AS n_examples, coalesce(string_agg({example_regular_sql('n', 'sequence', 'label')}, {lit(K.EXAMPLE_SEPARATOR)} ORDER BY n), '') AS examples FROM {name}_num)"""


def user_prompt_sql(seq, block_name=None):
    tz = R.load_prompt("regular", "user_prompt_zero_shot")
    zero = tmpl(tz, sequence=seq)
    if block_name is None:
        return zero
    tf = R.load_prompt("regular", "user_prompt_few_shot")
    blk = f"(SELECT examples FROM {block_name})"
    few = tmpl(tf, sequence=seq, examples=blk)
    return f"CASE WHEN coalesce({blk}, '') = '' THEN {zero} ELSE {few} END"


def chat_prompt(user):
    return cat(lit("<bos><start_of_turn>user\n"), user, lit("<end_of_turn>\n<start_of_turn>model\n"))


def pc_cte():
    user = tmpl(K.TUNED_USER_ZERO_SHOT, system=lit(K.TUNED_SYSTEM_PROMPT), sequence="sequence")
    return f"""pc AS (SELECT id, label, {chat_prompt(user)} AS prompt, {tjson('sequence', 'label')} AS completion
        FROM lab WHERE split = 'train')"""


def choice_cte():
    style = f"{h(lit('choice'), 'vec_id')} % 5"
    name = f"{NAMES_LIST}[label + 1]"
    nx = f"{NAMES_LIST}[((label + 1) % {len(K.CHOICE_NAMES)}) + 1]"
    alt = f"concat('(', replace({name}, ': ', ') '))"
    return f"""ch AS (SELECT vec_id, CAST(label AS BIGINT) AS label,
   CASE {style} WHEN 0 THEN {name} WHEN 1 THEN {alt} WHEN 2 THEN {nx}
        WHEN 3 THEN concat({nx}, ' or ', {name}) ELSE 'No idea.' END AS raw FROM embeddings)"""


def parse_choice_sql(r):
    out = "CASE"
    for i, n in enumerate(K.CHOICE_NAMES):
        alt = "(" + n.replace(": ", ") ")
        out += f" WHEN contains({r}, {lit(n)}) OR contains({r}, {lit(alt)}) THEN {i}"
    return f"CAST({out} ELSE -1 END AS BIGINT)"


def parse_exact_sql(r):
    return "CAST(CASE " + " ".join(f"WHEN {r} = {lit(n)} THEN {i}" for i, n in enumerate(K.CHOICE_NAMES)) + " ELSE -1 END AS BIGINT)"


def wf1_sql(src):
    return f"""(WITH t AS (SELECT label AS y, pred AS p FROM {src}),
 bt AS (SELECT y, count(*) AS support, count(*) FILTER (WHERE y = p) AS tp FROM t GROUP BY y),
 bp AS (SELECT p, count(*) AS n_pred FROM t GROUP BY p),
 lb AS (SELECT coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(n_pred, 0) AS n_pred
        FROM bt FULL OUTER JOIN bp ON bt.y = bp.p)
 SELECT CAST(sum(support) AS BIGINT) AS total, CAST(sum(tp) AS BIGINT) AS correct,
        {ratio('sum(tp)', 'sum(support)')} AS accuracy,
        {ratio('sum(support * coalesce(CAST(2 AS DOUBLE) * tp / NULLIF(CAST(support + n_pred AS DOUBLE), 0), 0.0))', 'sum(support)')} AS weighted_f1 FROM lb)"""


def runs_values():
    return "(VALUES " + ", ".join(f"({r}, {n}, {'true' if o else 'false'}, {lit(m)})"
                                  for r, n, o, m in GRID) + ") AS runs(run, n_per_class, ood, model)"


def nearest_example(shots: str, examples: str, test: str, name: str = "near") -> str:
    """Class of the nearest example by peaks (the first of equal ones) for each
    row of ``test`` and each number of shots; the middle class without examples."""
    return f"""{name}_ex AS (SELECT label, class_rank, {tp('sequence')} AS peaks, row_number() OVER (ORDER BY k, id) AS n FROM {examples}),
{name}_s AS (SELECT unnest([{shots}]) AS n_per_class),
{name} AS (SELECT t.id, s.n_per_class, coalesce(arg_min(e.label, (abs(e.peaks - t.total_peaks), e.n)), {lit(K.CLASSES[1])}) AS pred
   FROM {test} t CROSS JOIN {name}_s s LEFT JOIN {name}_ex e ON e.class_rank < s.n_per_class GROUP BY t.id, s.n_per_class)"""


def run_eval_cte():
    """The bundled base client answers by its examples, the tuned one by counting."""
    return f"""{icl_sample_cte(max(K.SHOT_GRID))},
tst AS (SELECT id, sequence, label, total_peaks, {range_flag(K.IN_RANGES)} AS f_in, {range_flag(K.OOD_RANGES)} AS f_ood
        FROM lab WHERE split = 'test'),
{nearest_example(', '.join(map(str, K.SHOT_GRID)), 'icl_ex', 'tst')},
fev AS (SELECT runs.*, t.id, t.label, CASE WHEN runs.model = 'base' THEN near.pred = t.label
          ELSE {thr('t.total_peaks')} = t.label END AS correct
     FROM tst t JOIN {runs_values()} ON (CASE WHEN runs.ood THEN t.f_ood ELSE t.f_in END)
     JOIN near ON near.id = t.id AND near.n_per_class = runs.n_per_class),
per_run AS (SELECT CAST(run AS BIGINT) AS run, CAST(n_per_class AS BIGINT) AS n_per_class, ood, model,
     CAST(count(*) FILTER (WHERE correct) AS BIGINT) AS correct, CAST(count(*) AS BIGINT) AS total
     FROM fev GROUP BY run, n_per_class, ood, model),
drops AS (SELECT model, n_per_class,
     {ratio('sum(correct) FILTER (WHERE NOT ood)', 'sum(total) FILTER (WHERE NOT ood)')} AS acc_in,
     {ratio('sum(correct) FILTER (WHERE ood)', 'sum(total) FILTER (WHERE ood)')} AS acc_ood
     FROM per_run GROUP BY model, n_per_class)"""


def icl_run_cte(where: str = "true"):
    """Predictions of the few-shot run with four examples per class."""
    return f"""{icl_sample_cte(4)},
tst AS (SELECT * FROM lab WHERE split = 'test' AND {where}),
{nearest_example('4', 'icl_ex', 'tst')},
icl_run AS (SELECT t.id, t.sequence, t.label, near.pred, near.pred = t.label AS correct,
            concat('This looks like ', near.pred, '.') AS raw_response FROM tst t JOIN near ON near.id = t.id)"""


def metric_rows(src: str, rows: list, cte: str) -> str:
    """The long metric table of ``src`` (label, correct)."""
    for c in K.CLASSES:
        rows = rows + [(f"{c} Accuracy", f"CAST({c}_acc AS VARCHAR)"), (f"{c} TP", f"CAST({c}_tp AS VARCHAR)"),
                       (f"{c} Total", f"CAST({c}_tot AS VARCHAR)")]
    agg_cols = ", ".join(["count(*) FILTER (WHERE correct) AS c", "count(*) AS t"] +
                         [f"count(*) FILTER (WHERE label = {lit(c)} AND correct) AS {c}_tp, count(*) FILTER (WHERE label = {lit(c)}) AS {c}_tot"
                          for c in K.CLASSES])
    accs = ", ".join([f"{ratio('c', 't')} AS acc"] + [f"{ratio(f'{c}_tp', f'{c}_tot')} AS {c}_acc" for c in K.CLASSES])
    union = "\nUNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS ord, {lit(m)} AS metric, {v} AS value FROM w"
                                for i, (m, v) in enumerate(rows))
    return with_base(cte, f"_a AS (SELECT {agg_cols} FROM {src})", f"w AS (SELECT *, {accs} FROM _a)", select=union)


def _oracles() -> dict[str, str]:
    o: dict[str, str] = {}
    sysp = R.load_prompt("regular", "system_prompt")
    test = "SELECT * FROM lab WHERE split = 'test'"

    o["encode_sequences"] = with_base(select="SELECT id, user_id, chunk, sequence FROM seqs")
    o["split_select"] = with_base(select="SELECT id, sequence, label AS fc_class FROM lab WHERE split = 'test'")
    cidx = "CASE label " + " ".join(f"WHEN {lit(c)} THEN {i}" for i, c in enumerate(K.CLASSES)) + " END"
    o["metadata_rows"] = with_base(select=f"""SELECT printf('%s_%04d', split, row_number() OVER (PARTITION BY split ORDER BY {cidx} NULLS FIRST, {key(42, 'id')}, id) - 1) AS id,
        id AS source_id, sequence, label, {tp('sequence')} AS total_picos FROM lab""")
    rng = lambda rs: ", ".join(f"{c} {lo}-{hi}" for c, lo, hi in rs)
    o["manifest"] = with_base(select=f"""SELECT CAST(max(length(sequence)) AS BIGINT) AS sequence_length,
        CAST(count(*) FILTER (WHERE split = 'icl') AS BIGINT) AS n_icl,
        CAST(count(*) FILTER (WHERE split = 'train') AS BIGINT) AS n_train,
        CAST(count(*) FILTER (WHERE split = 'test') AS BIGINT) AS n_test,
        CAST(count(*) FILTER (WHERE split = 'test' AND {range_flag(K.OOD_RANGES)}) AS BIGINT) AS n_test_ood,
        {lit(rng(K.IN_RANGES))} AS in_ranges, {lit(rng(K.OOD_RANGES))} AS ood_ranges,
        {lit(K.TUNED_SYSTEM_PROMPT)} AS system_prompt FROM lab""")
    o["known_classes"] = with_base(select=f"""SELECT id, label FROM (SELECT id, {kw('raw_response')} AS label
        FROM resp WHERE split = 'test') WHERE label IN ({", ".join(lit(c) for c in K.CLASSES)})""")
    o["correctness_icl"] = with_base(ICL_PRED, select="SELECT id, label AS true_class, pred AS predicted_class, correct FROM icl_eval")
    o["correctness_ft"] = with_base(FT_PRED, select="""SELECT id, label AS true_label, pred AS pred_label, correct,
        substr(raw_response, 1, 200) AS raw_response FROM ft_eval""")

    s = "sequence"
    o["symbol_counts"] = with_base(select=f"""SELECT id, {cnt(s, '|')} AS narrow, {cnt(s, ':')} AS wide,
        {cnt(s, '.')} AS baseline, {cnt(s, '~')} AS noise, {cnt(s, '_')} AS artifact, {tp(s)} AS total_peaks FROM seqs""")
    o["noise_pct"] = with_base(select=f"SELECT id, {noise_pct(s)} AS noise_pct FROM seqs")
    o["rr_irregularity"] = with_base(irregularity_cte(), select="SELECT id, irregularity FROM irr")
    o["artifact_flag"] = with_base(select=f"""SELECT id, {cnt(s, '_')} AS n_artifacts, CAST(length(sequence) AS BIGINT) AS length,
        {art_flag(s)} AS artifact_flag FROM seqs""")
    conc = f"""SELECT s.id, {cnt('s.sequence', '|')} AS C1_picos_estrechos, {cnt('s.sequence', ':')} AS C2_picos_anchos,
        {noise_pct('s.sequence')} AS C3_pct_ruido, irr.irregularity AS C4_irregularidad,
        {art_flag('s.sequence')} AS C5_artefactos_significativos"""
    o["concepts"] = with_base(irregularity_cte(), select=f"{conc} FROM seqs s JOIN irr ON s.id = irr.id")
    o["label_by_threshold"] = with_base(select="SELECT id, total_peaks, label FROM lab")
    o["label_by_range"] = with_base(select=f"""SELECT id, total_peaks, rg.regime, rg.label FROM lab
        JOIN {RANGES_VALUES} ON lab.total_peaks BETWEEN rg.lo AND rg.hi""")

    def u(seed, *parts):
        inner = cat(lit(seed + ":"), *[p for i, x in enumerate(parts) for p in ((lit(":"),) if i else ()) + (f"CAST({x} AS VARCHAR)",)])
        return f"(CAST(CAST(('0x' || substr(md5({inner}), 1, 8)) AS BIGINT) AS DOUBLE) / CAST(4294967296 AS DOUBLE))"

    alo, ahi = K.IN_ARTIFACT_PROB
    nlo, nhi = K.IN_NOISE_PROB
    pa = f"({dbl(alo)} + {u('aug-pa', 'id')} * {dbl(float(ahi) - float(alo))})"
    pn = f"({dbl(nlo)} + {u('aug-pn', 'id')} * {dbl(float(nhi) - float(nlo))})"
    o["augment_noise"] = with_base(f"""_chars AS (SELECT id, i, substr(sequence, i, 1) AS c, {u('aug', 'id', 'i')} AS u, {pa} AS pa, {pn} AS pn
        FROM (SELECT id, sequence, unnest(generate_series(1, length(sequence))) AS i FROM seqs))""",
        select="""SELECT id, string_agg(CASE WHEN c = '.' THEN (CASE WHEN u < pa THEN '_' WHEN u < pa + pn THEN '~' ELSE c END) ELSE c END, '' ORDER BY i) AS augmented
        FROM _chars GROUP BY id""")
    o["peak_positions"] = with_base(select="""SELECT id, CAST(i - 1 AS BIGINT) AS pos, substr(sequence, i, 1) AS kind
        FROM (SELECT id, sequence, unnest(generate_series(1, length(sequence))) AS i FROM seqs) WHERE substr(sequence, i, 1) IN ('|', ':')""")
    lo, hi = K.RR_CLAMP
    o["rr_intervals"] = with_base(
        """_pos AS (SELECT id, i - 1 AS pos FROM (SELECT id, sequence, unnest(generate_series(1, length(sequence))) AS i FROM seqs)
              WHERE substr(sequence, i, 1) IN ('|', ':'))""",
        f"""_iv AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) - 2 AS idx,
              pos - lag(pos) OVER (PARTITION BY id ORDER BY pos) AS x FROM _pos)""",
        select=f"""SELECT id, CAST(idx AS BIGINT) AS idx, greatest(CAST({lo} AS DOUBLE), least(CAST(x AS DOUBLE), CAST({hi} AS DOUBLE))) AS interval
        FROM _iv WHERE idx >= 0
        UNION ALL SELECT id, CAST(0 AS BIGINT) AS idx, CAST({K.RR_SINGLE} AS DOUBLE) AS interval FROM seqs
        WHERE {tp('sequence')} < 2""")
    o["complete_batch"] = with_base(select=f"""SELECT id, {tjson(s, 'label')} AS raw_response,
        CAST(NULL AS VARCHAR) AS error FROM lab WHERE split = 'test'""")
    o["target_json"] = with_base(select=f"SELECT id, {tjson(s, 'label')} AS target, {tjson(s, 'label', 2)} AS target_pretty FROM lab")
    # the bundled rule client answers with the true class and measured concepts
    o["complete_batch"] = with_base(select=f"""SELECT id, {tjson(s, 'label')} AS raw_response, CAST(NULL AS VARCHAR) AS error
        FROM lab WHERE split = 'test'""")
    r = "raw_response"
    o["response_preview"] = with_base(select=f"""SELECT id, substr({r}, 1, 200) AS head_200, substr({r}, 1, 30) AS head_30,
        substr({r}, 1, 50) AS head_50, substr({r}, 1, 500) AS head_500, right({r}, 200) AS tail_200 FROM resp WHERE split = 'test'""")
    o["label_names"] = f"""SELECT vec_id, CAST(label AS BIGINT) AS label, {NAMES_LIST}[label + 1] AS name,
        concat('(', replace({NAMES_LIST}[label + 1], ': ', ') ')) AS alt FROM embeddings"""

    # ---- rendering
    o["example_regular"] = with_base(select=f"SELECT id, {example_regular_sql('chunk + 1', s, 'label')} AS example FROM lab")
    cj = cat(lit('{\n  "C1_picos_estrechos": '), f"CAST({cnt('l.sequence', '|')} AS VARCHAR)",
             lit(',\n  "C2_picos_anchos": '), f"CAST({cnt('l.sequence', ':')} AS VARCHAR)",
             lit(',\n  "C3_pct_ruido": '), f"CAST({noise_pct('l.sequence')} AS VARCHAR)",
             lit(',\n  "C4_irregularidad": '), "CAST(irr.irregularity AS VARCHAR)",
             lit(',\n  "C5_artefactos_significativos": '),
             f"CASE WHEN {art_flag('l.sequence')} THEN 'true' ELSE 'false' END", lit("\n}"))
    ex_cbm = cat(lit("Example "), "CAST(l.chunk + 1 AS VARCHAR)", lit(":\nSequence: "), "l.sequence",
                 lit("\nConcepts:\n"), cj, lit("\nClassification: "), "l.label")
    o["example_cbm"] = with_base(irregularity_cte("lab"), select=f"SELECT l.id, {ex_cbm} AS example FROM lab l JOIN irr ON l.id = irr.id")
    o["few_shot_block"] = with_base(block_cte(4), select="SELECT CAST(n_examples AS BIGINT) AS n_examples, examples FROM block")
    o["prompt_zero_shot"] = with_base(select=f"SELECT id, {user_prompt_sql('sequence')} AS prompt FROM lab WHERE split = 'test'")
    o["prompt_few_shot"] = with_base(block_cte(4), select=f"SELECT id, {user_prompt_sql('sequence', 'block')} AS prompt FROM lab WHERE split = 'test'")
    o["messages"] = with_base(block_cte(2), select=f"""SELECT id, CAST(0 AS BIGINT) AS msg_idx, 'system' AS role, {lit(sysp)} AS content FROM lab WHERE split = 'test'
        UNION ALL SELECT id, CAST(1 AS BIGINT), 'user', {user_prompt_sql('sequence', 'block')} FROM lab WHERE split = 'test'""")
    o["merge_system"] = """WITH head AS (SELECT conv_id, coalesce(min(text) FILTER (WHERE turn = 0 AND role = 'system'), '') AS st,
    min(turn) FILTER (WHERE turn > 0) AS nt FROM conversations GROUP BY conv_id
    HAVING count(*) FILTER (WHERE turn = 0 AND role = 'system') > 0)
SELECT c.conv_id, c.turn, CASE WHEN h.st IS NOT NULL THEN 'user' ELSE c.role END AS role,
       CASE WHEN h.st IS NOT NULL THEN concat(h.st, chr(10), chr(10), c.text) ELSE c.text END AS text
FROM conversations c LEFT JOIN head h ON c.conv_id IS NOT DISTINCT FROM h.conv_id AND c.turn = h.nt
WHERE NOT coalesce(c.turn = 0 AND c.role = 'system', false)
UNION ALL SELECT conv_id, 0, 'system', st FROM head WHERE nt IS NULL"""
    o["chat_template"] = """SELECT DISTINCT conv_id, CAST(-1 AS BIGINT) AS seq, '<bos>' AS piece FROM conversations
UNION ALL SELECT conv_id, CAST(turn AS BIGINT), concat('<start_of_turn>', CASE WHEN role = 'assistant' THEN 'model' ELSE role END,
       chr(10), text, '<end_of_turn>', chr(10)) FROM conversations
UNION ALL SELECT conv_id, CAST(max(turn) + 1 AS BIGINT), concat('<start_of_turn>model', chr(10)) FROM conversations GROUP BY conv_id"""
    tex = tmpl(K.TUNED_EXAMPLE, n="n", sequence="sequence", response=tjson("sequence", "label"))
    few_user = tmpl(K.TUNED_USER_FEW_SHOT, system=lit(K.TUNED_SYSTEM_PROMPT), examples="(SELECT examples FROM tb)",
                    sequence="sequence")
    zero_user = tmpl(K.TUNED_USER_ZERO_SHOT, system=lit(K.TUNED_SYSTEM_PROMPT), sequence="sequence")
    o["prompt_finetuned"] = with_base(
        icl_sample_cte(1, "tb_ex"),
        "tb_num AS (SELECT *, row_number() OVER (ORDER BY k, id) AS n FROM tb_ex)",
        f"tb AS (SELECT coalesce(string_agg({tex}, '' ORDER BY n), '') AS examples FROM tb_num)",
        select=f"""SELECT id, {chat_prompt(f"CASE WHEN (SELECT examples FROM tb) = '' THEN {zero_user} ELSE {few_user} END")} AS prompt
        FROM lab WHERE split = 'test'""")
    o["prompt_completion"] = with_base(pc_cte(), select="SELECT id, prompt, completion FROM pc")
    o["chat_records"] = with_base(select=f"""SELECT id, CAST(0 AS BIGINT) AS msg_idx, 'system' AS role, {lit(K.TUNED_SYSTEM_PROMPT)} AS content FROM lab WHERE split = 'train'
        UNION ALL SELECT id, CAST(1 AS BIGINT), 'user', concat('Sequence: ', sequence) FROM lab WHERE split = 'train'
        UNION ALL SELECT id, CAST(2 AS BIGINT), 'assistant', {tjson(s, 'label')} FROM lab WHERE split = 'train'""")
    q_text = lit(K.CHOICE_QUESTION + "\n" + "\n".join(K.CHOICE_NAMES))
    mm_test = f"({h(lit('mm'), 'vec_id')} % 10 = 0)"
    o["multimodal_messages"] = f"""SELECT vec_id, CAST(0 AS BIGINT) AS msg_idx, 'user' AS role, CAST(0 AS BIGINT) AS part_idx, 'image' AS type, CAST(NULL AS VARCHAR) AS text FROM embeddings
UNION ALL SELECT vec_id, 0, 'user', 1, 'text', {q_text} FROM embeddings
UNION ALL SELECT vec_id, 1, 'assistant', 0, 'text', {NAMES_LIST}[label + 1] FROM embeddings WHERE NOT {mm_test}"""
    o["choice_prompt"] = f"""SELECT CAST(count(*) AS BIGINT) AS n_options,
        concat({lit(K.CHOICE_QUESTION + chr(10))}, coalesce(string_agg(name, chr(10) ORDER BY label), '')) AS prompt
        FROM (SELECT DISTINCT label, {NAMES_LIST}[label + 1] AS name FROM embeddings)"""

    # ---- completion / parsing
    o["join_responses"] = with_base(f"""stored AS (SELECT id AS rid, raw_response FROM resp WHERE raw_response <> '')""",
        select=f"""SELECT t.id, t.label AS true_class, s.raw_response, coalesce({kw('s.raw_response')}, 'Unknown') AS predicted_class,
        coalesce({kw('s.raw_response')}, 'Unknown') = t.label AS correct FROM lab t LEFT JOIN stored s ON t.id = s.rid WHERE t.split = 'test'""")
    o["parse_keyword"] = with_base(select=f"SELECT id, {kw('raw_response')} AS pred FROM resp WHERE split = 'test'")
    o["parse_fenced_json"] = with_base(select=f"SELECT id, {parse_fenced('raw_response')} AS pred FROM resp WHERE split = 'test'")
    o["parse_embedded_json"] = with_base(select=f"SELECT id, {parse_embedded('raw_response')} AS pred FROM resp WHERE split = 'test'")
    o["parse_choice"] = f"WITH {choice_cte()} SELECT vec_id, label, {parse_choice_sql('raw')} AS pred FROM ch"
    o["parse_exact"] = f"WITH {choice_cte()} SELECT vec_id, label, {parse_exact_sql('raw')} AS pred FROM ch"
    o["completion_labels"] = with_base(pc_cte(), select="SELECT id, label, json_extract_string(completion, '$.Label') AS completion_label FROM pc")

    # ---- sampling
    o["sample_balanced"] = with_base(icl_sample_cte(4), select="SELECT id, label, CAST(class_rank AS BIGINT) AS class_rank FROM icl_ex")
    o["shuffle"] = with_base(select=f"SELECT id, CAST(row_number() OVER (ORDER BY {key(42, 'id')}, id) - 1 AS BIGINT) AS pos FROM lab")
    o["sample_n"] = with_base(select=f"SELECT id FROM lab WHERE split = 'test' ORDER BY {key(42, 'id')}, id LIMIT 50")
    o["train_val_split"] = with_base(f"""_tp AS (SELECT id, row_number() OVER (ORDER BY {key(42, 'id')}, id) - 1 AS pos,
        count(*) OVER () AS total FROM lab WHERE split = 'train')""",
        select=f"""SELECT id, CASE WHEN pos < floor({dbl(0.8)} * total) THEN 'train'
        WHEN pos < floor({dbl(0.8)} * total) + ceil({dbl(0.2)} * total) THEN 'validation' END AS split FROM _tp
        WHERE pos < floor({dbl(0.8)} * total) + ceil({dbl(0.2)} * total)""")
    o["head_n"] = with_base(select="SELECT id, sequence FROM lab ORDER BY id LIMIT 50")
    o["first_per_class"] = with_base(select=f"""SELECT label, id FROM (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY {key(42, 'id')}, id) AS r
        FROM lab WHERE split = 'train') WHERE r = 1""")
    o["balanced_dataset"] = with_base(f"""_tr AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {key(42, 'id')}, id) - 1 AS class_rank
        FROM lab WHERE split = 'train' AND label IN ({", ".join(lit(c) for c in K.CLASSES)})),
        _n AS (SELECT min(c) AS n FROM (SELECT label, count(*) AS c FROM _tr GROUP BY label))""",
        select=f"""SELECT id, label, CAST(class_rank AS BIGINT) AS class_rank, CAST(({cidx}) * (SELECT n FROM _n) + class_rank AS BIGINT) AS dataset_pos
        FROM _tr WHERE class_rank < (SELECT n FROM _n)""")
    o["examples_by_class"] = with_base(select=f"""SELECT CAST(cls.ord AS BIGINT) AS ord, cls.label, CAST(coalesce(c.n, 0) AS BIGINT) AS n_examples
        FROM {CLASSES_VALUES} LEFT JOIN (SELECT label, count(*) AS n FROM lab WHERE split = 'icl' GROUP BY label) c ON cls.label = c.label""")

    # ---- metrics
    o["accuracy"] = with_base(ICL_PRED, select=f"""SELECT CAST(count(*) FILTER (WHERE correct) AS BIGINT) AS correct, CAST(count(*) AS BIGINT) AS total,
        {ratio('count(*) FILTER (WHERE correct)', 'count(*)')} AS accuracy FROM icl_eval""")
    o["metrics_fixed"] = with_base(ICL_PRED, select=f"""SELECT CAST(cls.ord AS BIGINT) AS ord, cls.label, CAST(coalesce(a.tp, 0) AS BIGINT) AS tp,
        CAST(coalesce(a.total, 0) AS BIGINT) AS total, {ratio('coalesce(a.tp, 0)', 'coalesce(a.total, 0)')} AS accuracy
        FROM {CLASSES_VALUES} LEFT JOIN (SELECT label, count(*) FILTER (WHERE correct) AS tp, count(*) AS total FROM icl_eval GROUP BY label) a
        ON cls.label = a.label""")
    o["metrics_dynamic"] = with_base(FT_PRED, select=f"""SELECT label, CAST(count(*) FILTER (WHERE correct) AS BIGINT) AS correct,
        CAST(count(*) AS BIGINT) AS total, {ratio('count(*) FILTER (WHERE correct)', 'count(*)')} AS accuracy FROM ft_eval GROUP BY label""")
    rows = [("Overall Accuracy", "CAST(acc AS VARCHAR)"), ("Correct Predictions", "CAST(c AS VARCHAR)"),
            ("Total Predictions", "CAST(t AS VARCHAR)"), ("Task", "'1'"), ("N-shots", "'4'"),
            ("Approach", "'regular'"), ("OOD", "'False'"), ("Model", "'rule-replies'")]
    for c in K.CLASSES:
        rows += [(f"{c} Accuracy", f"CAST({c}_acc AS VARCHAR)"), (f"{c} TP", f"CAST({c}_tp AS VARCHAR)"),
                 (f"{c} Total", f"CAST({c}_tot AS VARCHAR)")]
    agg_cols = ", ".join([f"count(*) FILTER (WHERE correct) AS c", "count(*) AS t"] +
                         [f"count(*) FILTER (WHERE label = {lit(c)} AND correct) AS {c}_tp, count(*) FILTER (WHERE label = {lit(c)}) AS {c}_tot"
                          for c in K.CLASSES])
    accs = ", ".join([f"{ratio('c', 't')} AS acc"] + [f"{ratio(f'{c}_tp', f'{c}_tot')} AS {c}_acc" for c in K.CLASSES])
    union = "\nUNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS ord, {lit(m)} AS metric, {v} AS value FROM w"
                                for i, (m, v) in enumerate(rows))
    o["metrics_long"] = with_base(ICL_PRED, f"_a AS (SELECT {agg_cols} FROM icl_eval)", f"w AS (SELECT *, {accs} FROM _a)",
                                  select=union)
    o["run_summary"] = with_base(FT_PRED, select=f"""SELECT 1 AS task, 0 AS n_shots, false AS ood,
        CAST((SELECT count(*) FROM ft_eval) AS BIGINT) AS total_samples,
        CAST((SELECT count(*) FILTER (WHERE correct) FROM ft_eval) AS BIGINT) AS all_correct,
        (SELECT {ratio('count(*) FILTER (WHERE correct)', 'count(*)')} FROM ft_eval) AS all_accuracy,
        label, CAST(count(*) FILTER (WHERE correct) AS BIGINT) AS correct, CAST(count(*) AS BIGINT) AS total,
        {ratio('count(*) FILTER (WHERE correct)', 'count(*)')} AS accuracy FROM ft_eval GROUP BY label""")
    o["weighted_f1"] = f"""WITH {choice_cte()},
cp AS (SELECT label, {parse_choice_sql('raw')} AS pred FROM ch),
lp AS (SELECT CAST(quality AS BIGINT) AS label, CAST(1 - toxic AS BIGINT) AS pred FROM labels)
SELECT 'choice' AS dataset, * FROM {wf1_sql('cp')}
UNION ALL SELECT 'quality' AS dataset, * FROM {wf1_sql('lp')}"""
    o["class_distribution"] = with_base(select=f"""SELECT CAST(cls.ord AS BIGINT) AS ord, cls.label, CAST(coalesce(c.n, 0) AS BIGINT) AS n,
        {ratio('coalesce(c.n, 0) * 100', '(SELECT count(*) FROM lab)')} AS pct
        FROM {CLASSES_VALUES} LEFT JOIN (SELECT label, count(*) AS n FROM lab GROUP BY label) c ON cls.label = c.label""")
    o["length_stats"] = with_base(select=f"""SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(length(sequence)) AS BIGINT) AS n_chars,
        {ratio('sum(length(sequence))', 'count(*)')} AS avg_length FROM lab""")
    from ..operators.metrics import SYMBOL_NAMES
    def sym_row(i, n, sy):
        total = f"coalesce(sum({cnt('sequence', sy)}), 0)"
        return (f"SELECT CAST({i} AS BIGINT) AS ord, {lit(n)} AS symbol_name, {lit(sy)} AS symbol, "
                f"CAST({total} AS BIGINT) AS n, {ratio(total + ' * 100', 'sum(length(sequence))')} AS pct FROM lab")
    sym_union = "\nUNION ALL ".join(sym_row(i, n, sy) for i, (n, sy) in enumerate(SYMBOL_NAMES))
    o["symbol_histogram"] = with_base(select=sym_union)
    o["peak_stats"] = with_base(select=f"""SELECT a.label, a.n, a.min_peaks, a.max_peaks, a.mean_peaks, CAST(rg.lo AS BIGINT) AS expected_lo,
        CAST(rg.hi AS BIGINT) AS expected_hi, (a.min_peaks >= rg.lo AND a.max_peaks <= rg.hi) AS within_range
        FROM (SELECT label, CAST(count(*) AS BIGINT) AS n, CAST(min(total_peaks) AS BIGINT) AS min_peaks, CAST(max(total_peaks) AS BIGINT) AS max_peaks,
              {ratio('sum(total_peaks)', 'count(total_peaks)')} AS mean_peaks FROM lab GROUP BY label) a
        LEFT JOIN (SELECT * FROM {RANGES_VALUES} WHERE regime = 'in') rg ON a.label = rg.label""")
    o["balance_check"] = with_base(f"""_h AS (SELECT * FROM lab WHERE split = 'train' ORDER BY {key(42, 'id')}, id LIMIT {K.BALANCE_WINDOW}),
        _c AS (SELECT label, CAST(count(*) AS BIGINT) AS n FROM _h GROUP BY label)""",
        select=f"SELECT label, n, (SELECT min(n) FROM _c) >= {K.BALANCE_MIN_PER_CLASS} AS balanced FROM _c")
    tok = r"'\w+|[^\w\s]'"
    o["token_share"] = with_base(pc_cte(), f"""_t AS (SELECT id, CAST(len(regexp_extract_all(prompt, {tok})) AS BIGINT) AS prompt_tokens,
        CAST(len(regexp_extract_all(completion, {tok})) AS BIGINT) AS completion_tokens FROM pc)""",
        select=f"""SELECT id, prompt_tokens, completion_tokens,
        {ratio('completion_tokens * 100', 'prompt_tokens + completion_tokens')} AS completion_share FROM _t""")
    o["token_share_total"] = with_base(pc_cte(), f"""_t AS (SELECT CAST(sum(len(regexp_extract_all(prompt, {tok}))) AS BIGINT) AS prompt_tokens,
        CAST(sum(len(regexp_extract_all(completion, {tok}))) AS BIGINT) AS completion_tokens FROM pc)""",
        select=f"""SELECT prompt_tokens, completion_tokens,
        {ratio('completion_tokens * 100', 'prompt_tokens + completion_tokens')} AS completion_share FROM _t""")
    o["step_budget"] = with_base("_n AS (SELECT CAST(count(*) AS BIGINT) AS n_rows FROM lab WHERE split = 'train')",
        select=f"""SELECT n_rows, CAST((n_rows // 1) * 3 // 4 AS BIGINT) AS total_steps,
        CAST(floor(CAST((n_rows // 1) * 3 // 4 AS DOUBLE) * {dbl(0.1)}) AS BIGINT) AS warmup_steps FROM _n""")
    o["label_consistency"] = with_base(select=f"""SELECT label, CAST(count(*) AS BIGINT) AS n,
        CAST(count(*) FILTER (WHERE NOT {range_flag(K.IN_RANGES)}) AS BIGINT) AS n_outside_range FROM lab GROUP BY label""")

    # ---- experiment
    o["sweep"] = with_base(run_eval_cte(), select=f"SELECT *, {ratio('correct', 'total')} AS accuracy FROM per_run")
    o["ood_drop"] = with_base(run_eval_cte(), select="SELECT model, n_per_class, acc_in, acc_ood, round(acc_in - acc_ood, 6) AS drop FROM drops")
    o["hypothesis_verdict"] = with_base(run_eval_cte(), select=f"""SELECT b.n_per_class, b.acc_in AS base_acc_in, b.acc_ood AS base_acc_ood,
        round(b.acc_in - b.acc_ood, 6) AS base_drop, t.acc_ood AS tuned_acc_ood,
        b.acc_in > {K.IN_DISTRIBUTION_MIN_ACCURACY} AS in_dist_ok, round(b.acc_in - b.acc_ood, 6) > {K.OOD_MIN_DROP} AS ood_degrades,
        b.acc_in > {K.RANDOM_GUESS_ACCURACY} AS beats_random, b.acc_in >= {K.TARGET_ACCURACY} AS meets_target,
        coalesce(t.acc_ood > b.acc_ood, false) AS tuned_recovers
        FROM (SELECT * FROM drops WHERE model = 'base') b LEFT JOIN (SELECT * FROM drops WHERE model = 'tuned') t
        ON b.n_per_class = t.n_per_class""")
    o["model_compare"] = with_base(run_eval_cte(), f"""_g AS (SELECT label, CAST(count(*) FILTER (WHERE model = 'base') AS BIGINT) AS n,
               CAST(count(*) FILTER (WHERE model = 'base' AND correct) AS BIGINT) AS base_correct,
               CAST(count(*) FILTER (WHERE model = 'tuned' AND correct) AS BIGINT) AS tuned_correct
               FROM fev WHERE n_per_class = 4 AND NOT ood GROUP BY ROLLUP (label))""",
        select=f"""SELECT coalesce(label, 'ALL') AS label, n, base_correct, tuned_correct,
        {ratio('base_correct', 'n')} AS base_accuracy, {ratio('tuned_correct', 'n')} AS tuned_accuracy FROM _g""")

    o["rendered_chats"] = f"""WITH _p AS (SELECT conv_id, turn // 4 AS part, count(*) AS n_turns,
        string_agg(concat('<start_of_turn>', CASE WHEN role = 'assistant' THEN 'model' ELSE role END, chr(10), text,
                          '<end_of_turn>', chr(10)), '' ORDER BY turn, role, text) AS body FROM conversations GROUP BY 1, 2),
        _t AS (SELECT *, concat(CASE WHEN part = min(part) OVER w THEN '<bos>' ELSE '' END, body,
                 CASE WHEN part = max(part) OVER w THEN concat('<start_of_turn>model', chr(10)) ELSE '' END) AS text
               FROM _p WINDOW w AS (PARTITION BY conv_id))
        SELECT concat('folder=', {h("'chat'", 'conv_id')} % 16) AS path, conv_id, CAST(count(*) AS BIGINT) AS n_parts,
               CAST(sum(n_turns) AS BIGINT) AS n_turns, CAST(sum(strlen(text)) AS BIGINT) AS bytes,
               sha256(string_agg(sha256(text), chr(10) ORDER BY part)) AS sha256 FROM _t GROUP BY conv_id"""
    span = r"'\s?\w+|\s?[^\w\s]|\s'"
    o["loss_masks"] = with_base(pc_cte(), f"""_x AS (SELECT id, length(prompt) AS border, regexp_extract_all(concat(prompt, completion), {span}) AS t FROM pc),
        _w AS (SELECT id, border, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM _x),
        _s AS (SELECT *, sum(length(token)) OVER (PARTITION BY id ORDER BY i) - length(token) AS start FROM _w),
        _v AS (SELECT token, row_number() OVER (ORDER BY token) + 2 AS token_id FROM (SELECT DISTINCT token FROM _w)),
        _n AS (SELECT id, count(*) AS n FROM _s GROUP BY id),
        _a AS (SELECT id, i + 2 AS place, token_id, CASE WHEN start < border THEN {K.MASK_ID} ELSE token_id END AS label FROM _s JOIN _v USING (token)
               UNION ALL SELECT id, unnest([0, 1, 2]), unnest([1, 2, 2]), {K.MASK_ID} FROM _n
               UNION ALL SELECT id, unnest(generate_series(n + 3, ((n + 2) // 64 + 1) * 64 - 1)), 0, {K.MASK_ID} FROM _n)""",
        select="""SELECT id, CAST(place // 64 AS BIGINT) AS "window", CAST(place % 64 AS BIGINT) AS pos, CAST(token_id AS BIGINT) AS input_id,
        CAST(label AS BIGINT) AS label FROM _a""")

    ck = K.CONCEPT_KEYS
    body = f"json_extract({fenced_body('raw_response')}, '$.conceptos')"
    o["parsed_concepts"] = with_base(f"""_f AS (SELECT id, {parse_fenced('raw_response')} AS fc_class,
        CASE WHEN {whole_obj(fenced_body('raw_response'))} THEN {body} END AS c FROM resp WHERE split = 'test')""",
        select=f"""SELECT id, fc_class, CAST(json_extract(c, '$.{ck[0]}') AS BIGINT) AS {ck[0]}, CAST(json_extract(c, '$.{ck[1]}') AS BIGINT) AS {ck[1]},
        replace(replace(CAST(c AS VARCHAR), ': ', ':'), ', ', ',') AS payload
        FROM _f WHERE fc_class IS NOT NULL""")
    o["label_search"] = """SELECT d.doc_id, CAST(coalesce(min(b.item_id), -1) AS BIGINT) AS pred FROM documents d
        LEFT JOIN (SELECT item_id, substr(text, 1, 40) AS name FROM benchmark) b ON contains(d.text, b.name) GROUP BY d.doc_id"""
    o["range_matches"] = """SELECT p.p_partkey, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_items
        FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) l
        JOIN part p ON l.l_partkey BETWEEN p.p_partkey AND p.p_partkey + p.p_size * p.p_size GROUP BY 1"""
    o["observed_sizes"] = with_base(select=f"""SELECT CAST(max(length(sequence)) AS BIGINT) AS sequence_length,
        count(*) FILTER (WHERE split = 'train') AS n_train_pool, count(*) FILTER (WHERE split = 'icl') AS icl_total,
        count(*) FILTER (WHERE split = 'test') AS test_total,
        count(*) FILTER (WHERE split = 'test' AND {range_flag(K.OOD_RANGES)}) AS test_ood_total FROM lab""")
    o["snapshot_results"] = with_base(select="""SELECT split, CAST(CASE WHEN split = 'icl' THEN 2 ELSE 1 END AS INTEGER) AS version, label,
        count(*) AS n FROM lab GROUP BY split, label""")

    o["label_recount"] = with_base(select="SELECT label, count(*) AS n, CAST(0 AS BIGINT) AS n_mismatch FROM lab GROUP BY label")
    o["stored_concepts"] = with_base(irregularity_cte(), select=conc.replace(
        "irr.irregularity", f"CASE WHEN s.chunk % 2 = 0 THEN irr.irregularity ELSE {dbl(K.DEFAULT_IRREGULARITY)} END")
        + " FROM seqs s JOIN irr ON s.id = irr.id")
    o["appended_turns"] = with_base(select=f"""SELECT id, CAST(0 AS BIGINT) AS msg_idx, 'user' AS role, {zero_user} AS content FROM lab WHERE split = 'train'
        UNION ALL SELECT id, CAST(1 AS BIGINT), 'model', {tjson(s, 'label')} FROM lab WHERE split = 'train'""")
    o["row_ids"] = with_base(select="""SELECT CASE WHEN chunk % 2 = 0 THEN id ELSE CAST(row_number() OVER (ORDER BY sequence, id) - 1 AS VARCHAR) END AS id,
        id AS source_id FROM lab WHERE split = 'test'""")
    opa = f"({dbl(K.OOD_ARTIFACT_PROB[0])} + {u('aug-pa', 'id')} * {dbl(float(K.OOD_ARTIFACT_PROB[1]) - float(K.OOD_ARTIFACT_PROB[0]))})"
    opn = f"({dbl(K.OOD_NOISE_PROB[0])} + {u('aug-pn', 'id')} * {dbl(float(K.OOD_NOISE_PROB[1]) - float(K.OOD_NOISE_PROB[0]))})"
    o["shifted_dataset"] = with_base(f"""_tr AS (SELECT id, label, sequence, row_number() OVER (PARTITION BY label ORDER BY {key(42, 'id')}, id) - 1 AS class_rank
        FROM lab WHERE split = 'test' AND {range_flag(K.OOD_RANGES)}),
        _n AS (SELECT min(c) AS n FROM (SELECT label, count(*) AS c FROM _tr GROUP BY label)),
        _k AS (SELECT *, ({cidx}) * (SELECT n FROM _n) + class_rank AS dataset_pos FROM _tr WHERE class_rank < (SELECT n FROM _n)),
        _chars AS (SELECT id, label, dataset_pos, i, substr(sequence, i, 1) AS c, {u('aug', 'id', 'i')} AS u, {opa} AS pa, {opn} AS pn
        FROM (SELECT *, unnest(generate_series(1, length(sequence))) AS i FROM _k))""",
        select="""SELECT id, label, string_agg(CASE WHEN c = '.' THEN (CASE WHEN u < pa THEN '_' WHEN u < pa + pn THEN '~' ELSE c END) ELSE c END, '' ORDER BY i) AS sequence,
        CAST(dataset_pos AS BIGINT) AS dataset_pos FROM _chars GROUP BY id, label, dataset_pos""")
    late = "\nUNION ALL ".join(f"""SELECT id, label, {m} AS minute, {reply(h(lit(f'late{m}'), 'id') + ' % 8', 'sequence', 'label')} AS r
        FROM lab WHERE split = 'test' AND {h(lit(f'late{m}'), 'id')} % 4 <> 0""" for m in (1, 2, 3))
    o["late_replies"] = with_base(f"_l AS ({late})", "_b AS (SELECT id, label, arg_max(r, minute) AS r FROM _l GROUP BY id, label)",
        select=f"""SELECT label, CAST(count(*) FILTER (WHERE coalesce({kw('r')}, 'Unknown') = label) AS BIGINT) AS correct,
        count(*) AS total FROM _b GROUP BY label""")

    # ---- end to end
    o["evaluate_icl"] = with_base(icl_run_cte(), select="""SELECT id, sequence, label AS true_class, pred AS predicted_class, correct,
        raw_response, CAST(NULL AS VARCHAR) AS error FROM icl_run""")
    o["evaluate_icl_metrics"] = metric_rows("icl_run", [
        ("Overall Accuracy", "CAST(acc AS VARCHAR)"), ("Correct Predictions", "CAST(c AS VARCHAR)"),
        ("Total Predictions", "CAST(t AS VARCHAR)"), ("Task", "'1'"), ("N-shots", "'4'"), ("Approach", "'regular'"),
        ("OOD", "'True'"), ("Model", "'examples'")], icl_run_cte(range_flag(K.OOD_RANGES)))
    o["evaluate_tuned"] = with_base(select=f"""SELECT id, sequence, label AS true_label, {thr('total_peaks')} AS pred_label,
        {thr('total_peaks')} = label AS correct, substr({tjson(s, 'label')}, 1, 200) AS raw_response, CAST(NULL AS VARCHAR) AS error
        FROM lab WHERE split = 'test'""")
    o["resume_completion"] = with_base(select=f"""SELECT 'zero-shot' AS run, id, {tjson(s, 'label')} AS raw_response, CAST(NULL AS VARCHAR) AS error,
        CAST(1 AS BIGINT) AS times_asked, CAST(CASE WHEN {h("'stopped'", 'id')} % 3 = 0 THEN 1 ELSE 2 END AS BIGINT) AS attempt
        FROM lab WHERE split = 'test'""")
    tid = "lambda t: (CAST(('0x' || substr(md5(t), 1, 6)) AS BIGINT) % 32000) + 3"
    o["mask_labels"] = with_base(pc_cte(), f"""_tk AS (SELECT id, list_concat([CAST(1 AS BIGINT)], list_transform(regexp_extract_all(prompt, {tok}), {tid})) AS p_ids,
        list_transform(regexp_extract_all(completion, {tok}), {tid}) AS c_ids FROM pc),
        _z AS (SELECT id, len(p_ids) AS plen, list_concat(p_ids, c_ids) AS ids FROM _tk)""",
        select=f"""SELECT id, CAST(i - 1 AS BIGINT) AS pos, CAST(ids[i] AS BIGINT) AS input_id,
        CAST(CASE WHEN i - 1 < plen OR ids[i] IN (0, 2) THEN {K.MASK_ID} ELSE ids[i] END AS BIGINT) AS label
        FROM (SELECT id, plen, ids, unnest(generate_series(1, len(ids))) AS i FROM _z)""")
    return o


ORACLES = _oracles()
