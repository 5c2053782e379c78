"""DuckDB SQL builders for the correctness oracle.

Each builder returns SQL text over the pre-registered views (``customer``,
``documents``, ``events`` ...).  The SQL is written independently of the
Spark code path: it states the same semantics with DuckDB's own list
lambdas, ``list_reduce`` and RE2 regexes.
"""

from __future__ import annotations

import hashlib

from cloakline import constants as C
from cloakline.sources.corpus import MONTHS

DEMO_SECRET = hashlib.sha256(b"cloakline-demo-key").hexdigest().upper()


def q(s: str | None) -> str:
    if s is None:
        return "NULL::VARCHAR"
    return "'" + s.replace("'", "''") + "'"


def lp(x: str, n: int) -> str:
    return f"lpad(CAST({x} AS VARCHAR), {n}, '0')"


def v(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


MONTH_LIST = "[" + ", ".join(q(m) for m in MONTHS) + "]"

NOTE_PARTS = f"""
note_parts AS (
  SELECT c_custkey AS k, c_name AS name,
    {lp('c_custkey % 1000', 3)} || '-' || {lp('c_custkey % 97', 2)} || '-' || {lp('c_custkey % 10000', 4)} AS ssn,
    {lp('200 + c_custkey % 800', 3)} || '-' || {lp('100 + c_custkey % 900', 3)} || '-' || {lp('c_custkey % 10000', 4)} AS phone_dash,
    {lp('200 + c_custkey % 800', 3)} || '.' || {lp('100 + c_custkey % 900', 3)} || '.' || {lp('c_custkey % 10000', 4)} AS phone_dot,
    '(' || {lp('200 + c_custkey % 800', 3)} || ') ' || {lp('100 + c_custkey % 900', 3)} || '-' || {lp('c_custkey % 10000', 4)} AS phone_par,
    'user' || {v('c_custkey')} || '@example.com' AS email,
    {v('1 + c_custkey % 12')} || '/' || {v('1 + c_custkey % 28')} || '/' || {v('1940 + c_custkey % 80')} AS date_slash,
    {v('1 + c_custkey % 12')} || '-' || {v('1 + c_custkey % 28')} || '-' || {v('1940 + c_custkey % 80')} AS date_dash,
    {MONTH_LIST}[1 + c_custkey % 12] || ' ' || {v('1 + c_custkey % 28')} || ', ' || {v('1940 + c_custkey % 80')} AS date_name,
    {v('10 + c_custkey % 90')} || '-year-old' AS age_old,
    {v('10 + c_custkey % 90')} || ' years of age' AS age_years,
    'MRN ' || {lp('c_custkey % 100000', 5)} AS mrn,
    'Patient ID ' || {lp('c_custkey', 7)} AS pid,
    '4' || {lp('c_custkey % 1000', 3)} || ' ' || {lp('c_custkey % 10000', 4)} || ' ' || {lp('(c_custkey * 7) % 10000', 4)} || ' ' || {lp('(c_custkey * 13) % 10000', 4)} AS card_sp,
    {lp('c_custkey % 100000', 5)} AS zip,
    {lp('10000 + c_custkey % 90000', 5)} AS qty
  FROM customer
)"""


def _sp(x: str, t: str) -> str:
    return f"{{'span': {x}, 'phi_type': '{t}'}}"


NOTES = NOTE_PARTS + f""",
notes AS (
  SELECT k AS doc_id, k AS seq, 'notes' AS dataset,
    CASE k % 4
      WHEN 0 THEN name || ' (SSN ' || ssn || ') was seen on ' || date_slash || '; call ' || phone_dash || ' or ' || phone_dash || ' again.'
      WHEN 1 THEN name || ', a ' || age_old || ', email ' || email || ', phone ' || phone_dot || ', ' || mrn || ', ordered ' || qty || ' units.'
      WHEN 2 THEN name || ' and his wife visited on ' || date_name || '; ' || pid || '; card ' || card_sp || '; phone ' || phone_par || '.'
      ELSE name || ', ' || age_years || ', her son born ' || date_dash || ', ZIP ' || zip || ', card ' || replace(card_sp, ' ', '') || '.'
    END AS text,
    CASE k % 4
      WHEN 0 THEN [{_sp('name', 'PERSON')}, {_sp('ssn', 'SSN')}, {_sp('date_slash', 'DATE')}, {_sp('phone_dash', 'PHONE')}]
      WHEN 1 THEN [{_sp('name', 'PERSON')}, {_sp('age_old', 'AGE')}, {_sp('email', 'EMAIL')}, {_sp('phone_dot', 'PHONE')}, {_sp('mrn', 'ID_NUMBER')}]
      WHEN 2 THEN [{_sp('name', 'PERSON')}, {_sp("'wife'", 'RELATIONSHIP')}, {_sp('date_name', 'DATE')}, {_sp('pid', 'ID_NUMBER')}, {_sp('card_sp', 'CREDIT_CARD')}, {_sp('phone_par', 'PHONE')}]
      ELSE [{_sp('name', 'PERSON')}, {_sp('age_years', 'AGE')}, {_sp("'son'", 'RELATIONSHIP')}, {_sp('date_dash', 'DATE')}, {_sp('zip', 'LOCATION')}, {_sp("replace(card_sp, ' ', '')", 'CREDIT_CARD')}]
    END AS phi_spans
  FROM note_parts
)"""

# documents as samples: Python-style strip, blanks dropped
WS = (r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+")


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}|{WS}$', '', 'g')"  # independent of the Spark trim


DOCS = f"""
docs AS (
  SELECT doc_id, doc_id AS seq, 'documents' AS dataset, {strip_sql('text')} AS text
  FROM documents WHERE {strip_sql('text')} <> ''
)"""


def seed_rows(min_conf: float | None = 0.75):
    out = []
    for label, rx, t, role in C.SEED_PATTERNS:
        if min_conf is not None and C.SEED_CONFIDENCE < min_conf:
            continue
        out.append((len(out) + 1, label, rx, t, role))
    return out


def hits_sql(text: str, rows=None) -> str:
    rows = rows if rows is not None else seed_rows()
    parts = []
    for rank, label, rx, t, role in rows:
        parts.append(
            f"list_transform(regexp_extract_all({text}, {q(rx)}), lambda m: "
            f"{{'pattern_rank': {rank}, 'label': {q(label)}, 'span': m, 'phi_type': {q(t)}, "
            f"'abstraction_role': {q(role)}, 'promoted': true, 'confidence': 0.96::DOUBLE}})"
        )
    return "flatten([" + ", ".join(parts) + "])"


def offsets_sql(text: str, rows=None) -> str:
    """All hits with 0-based start/end from split gaps."""
    rows = rows if rows is not None else seed_rows()
    parts = []
    for rank, label, rx, t, role in rows:
        ms = f"regexp_extract_all({text}, {q(rx)})"
        gaps = f"regexp_split_to_array({text}, {q(rx)})"
        start = (f"(list_sum(list_transform(list_slice({gaps}, 1, i), lambda g: length(g))) + "
                 f"coalesce(list_sum(list_transform(list_slice({ms}, 1, i - 1), lambda y: length(y))), 0))")
        parts.append(
            f"list_transform({ms}, lambda m, i: {{'pattern_rank': {rank}, 'label': {q(label)}, 'span': m, "
            f"'phi_type': {q(t)}, 'start': {start}::INTEGER, 'end': ({start} + length(m))::INTEGER}})"
        )
    return "flatten([" + ", ".join(parts) + "])"


def dedup_sql(spans: str) -> str:
    return (f"list_filter({spans}, lambda s, i: "
            f"list_position(list_transform({spans}, lambda z: z.span), s.span) = i)")


def token_sql(doc_id: str, idx: str, span: str, secret: str = DEMO_SECRET) -> str:
    return (f"substr(sha256(concat_ws('|', '{secret}', CAST({doc_id} AS VARCHAR), "
            f"CAST({idx} AS VARCHAR), {span})), 1, 16)")


ENC_LIST = "[" + ", ".join(q(t) for t in C.ENCRYPT_TYPES) + "]"


def route_sql(t: str) -> str:
    return f"CASE WHEN list_contains({ENC_LIST}, upper({t})) THEN 'encrypt' ELSE 'abstract' END"


def mask_fold_sql(text: str, merged: str, doc_id: str, phrase: str | None = None) -> str:
    """MK-1 in DuckDB: order by first position desc (stable), fold replacing first live occurrence.

    ``merged`` elements need fields span, phi_type, abstraction_role, label.
    Returns a struct {text, applied} where applied is a list of {span, action, replacement, label}.
    """
    keyed = (f"list_sort(list_filter(list_transform({merged}, lambda s, i: "
             f"{{'k': -(strpos({text}, s.span) - 1), 'i': i, 'idx': strpos({text}, s.span) - 1, 'span': s.span, "
             f"'phi_type': s.phi_type, 'role': s.abstraction_role, 'label': s.label}}), lambda x: x.idx >= 0))")
    ph = phrase if phrase else "NULL::VARCHAR"
    items = (f"list_transform({keyed}, lambda x: {{'span': x.span, 'label': x.label, 'phi_type': x.phi_type, 'action': {route_sql('x.phi_type')}, "
             f"'replacement': CASE WHEN {route_sql('x.phi_type')} = 'encrypt' THEN '{C.ENCRYPT_MARKER}' || "
             f"{token_sql(doc_id, 'x.idx', 'x.span')} || '{C.ENCRYPT_END}' "
             f"ELSE coalesce(nullif(x.role, ''), {ph.replace('SPAN', 'x.span')}, '{C.REDACTED}') END}})")
    init = (f"{{'text': {text}, 'applied': list_filter([{{'span': ''::VARCHAR, 'label': ''::VARCHAR, "
            f"'phi_type': ''::VARCHAR, 'action': ''::VARCHAR, 'replacement': ''::VARCHAR}}], lambda z: false)}}")
    step = ("lambda acc, x: CASE WHEN strpos(acc.text, x.span) > 0 THEN "
            "{'text': substr(acc.text, 1, strpos(acc.text, x.span) - 1) || x.replacement || "
            "substr(acc.text, strpos(acc.text, x.span) + length(x.span)), "
            "'applied': list_append(acc.applied, {'span': x.span, 'label': x.label, 'phi_type': x.phi_type, 'action': x.action, "
            "'replacement': x.replacement})} ELSE acc END")
    return f"list_reduce({items}, {step}, {init})"


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes if c.strip()) + "\n"


def tokens_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '{WS}'), lambda t: t <> '')"


def tokset_sql(x: str) -> str:
    return f"list_distinct({tokens_sql(x)})"


def overlap_test_sql(p: str, g: str) -> str:
    return (f"(len(list_intersect({tokset_sql(p)}, {tokset_sql(g)})) > 0 OR contains({g}, {p}) "
            f"OR contains({p}, {g}))")


def utility_sql(o: str, m: str) -> str:
    return (f"CASE WHEN len({tokset_sql(o)}) = 0 THEN 1.0::DOUBLE ELSE "
            f"len(list_intersect({tokset_sql(o)}, {tokset_sql(m)}))::DOUBLE / len({tokset_sql(o)}) END")


def quasi_sql(o: str, m: str) -> str:
    return (f"CASE WHEN len({tokens_sql(o)}) = 0 THEN 0.0::DOUBLE ELSE "
            f"len(list_filter({tokens_sql(o)}, lambda t: list_contains({tokset_sql(m)}, t)))::DOUBLE "
            f"/ len({tokens_sql(o)}) END")


def leakage_sql(m: str, gt: str) -> str:
    return f"CASE WHEN len(list_filter({gt}, lambda g: g <> '' AND contains({m}, g))) > 0 THEN 1 ELSE 0 END"


def greedy_tp_sql(gt: str, pred: str) -> str:
    free = (f"list_filter(range(len({pred})), lambda j: NOT list_contains(used, j) AND "
            f"{overlap_test_sql(f'({pred})[j + 1]', 'g')})")
    return (f"len(list_reduce({gt}, lambda used, g: CASE WHEN len({free}) > 0 THEN list_append(used, ({free})[1]) "
            f"ELSE used END, []::BIGINT[]))")


def overlap_record_sql(gt: str, pred: str) -> str:
    """struct tp, fp, fn, precision, recall, f1 with the SC-11 edge cases."""
    ng, np_ = f"len({gt})", f"len({pred})"
    tp = greedy_tp_sql(gt, pred)
    return f"""(SELECT {{'tp': tp, 'fp': fp, 'fn': fn,
      'precision': CASE WHEN ng = 0 AND np = 0 THEN 1.0 WHEN np = 0 THEN 0.0 WHEN ng = 0 THEN 0.0
                        WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END::DOUBLE,
      'recall': CASE WHEN ng = 0 AND np = 0 THEN 1.0 WHEN np = 0 THEN 0.0 WHEN ng = 0 THEN 1.0
                     WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END::DOUBLE,
      'f1': CASE WHEN ng = 0 AND np = 0 THEN 1.0 WHEN np = 0 THEN 0.0 WHEN ng = 0 THEN 0.0
                 WHEN tp > 0 THEN 2 * (tp::DOUBLE / (tp + fp)) * (tp::DOUBLE / (tp + fn))
                      / ((tp::DOUBLE / (tp + fp)) + (tp::DOUBLE / (tp + fn))) ELSE 0.0 END::DOUBLE}}
    FROM (SELECT CASE WHEN ng = 0 OR np = 0 THEN 0 ELSE tp0 END AS tp,
                 CASE WHEN ng = 0 AND np = 0 THEN 0 WHEN np = 0 THEN 0 WHEN ng = 0 THEN np ELSE np - tp0 END AS fp,
                 CASE WHEN ng = 0 AND np = 0 THEN 0 WHEN np = 0 THEN ng WHEN ng = 0 THEN 0 ELSE ng - tp0 END AS fn,
                 ng, np
          FROM (SELECT {ng} AS ng, {np_} AS np, CASE WHEN {np_} = 0 THEN 0 ELSE {tp} END AS tp0)))"""


def strip_fences_sql(x: str) -> str:
    return strip_sql(f"regexp_replace({x}, '```json|```', '', 'g')")


def repair_detect_sql(x: str) -> str:
    return f"regexp_replace({strip_fences_sql(x)}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')"


def repair_critic_sql(x: str) -> str:
    y = f"regexp_replace({strip_fences_sql(x)}, '[\\x00-\\x1f\\x7f]', ' ', 'g')"
    return f"regexp_replace({y}, '\\\\([^\"\\\\/bfnrtu]|$)', '\\\\\\\\\\1', 'g')"


def first_array_sql(x: str) -> str:
    return (f"CASE WHEN regexp_extract({x}, '(?s)(\\[.*?\\])', 1) <> '' "
            f"THEN regexp_extract({x}, '(?s)(\\[.*?\\])', 1) ELSE {x} END")


def json_or_null(x: str, shape: str) -> str:
    return f"CASE WHEN json_valid({x}) THEN from_json({x}, '{shape}') END"


DETECT_SHAPE = '[{"span":"VARCHAR","phi_type":"VARCHAR","confidence":"DOUBLE","has_pattern":"BOOLEAN"}]'
LEAK_SHAPE = '{"leaked_spans":["VARCHAR"],"is_clean":"BOOLEAN","confidence":"DOUBLE"}'
FLU_SHAPE = '{"is_fluent":"BOOLEAN","fluency_score":"DOUBLE","reason":"VARCHAR"}'
OVER_SHAPE = '{"over_encrypted":["VARCHAR"],"is_accurate":"BOOLEAN"}'


def detect_raw_sql() -> str:
    """Same composition as ``replies.detect_raw`` over the notes CTE."""
    val = ("CASE doc_id % 4 WHEN 0 THEN phi_spans[2].span WHEN 1 THEN phi_spans[3].span "
           "WHEN 2 THEN 'wife' ELSE phi_spans[5].span END")
    typ = "CASE doc_id % 4 WHEN 0 THEN 'ssn' WHEN 1 THEN 'email' WHEN 2 THEN 'relationship' ELSE 'location' END"
    items = ("'[{\"span\": \"' || phi_spans[1].span || '\", \"phi_type\": \"person\", \"confidence\": 0.9, \"has_pattern\": ' "
             "|| CASE WHEN doc_id % 3 = 0 THEN 'true' ELSE 'false' END || '}, ' || "
             f"'{{\"span\": \"' || ({val}) || '\", \"phi_type\": \"' || ({typ}) || '\", \"confidence\": 0.8}}, ' || "
             "'{\"span\": \"Nobody Here\", \"phi_type\": \"PERSON\", \"confidence\": 0.95}, ' || "
             "'{\"span\": \"Customer\", \"phi_type\": \"org\", \"confidence\": 0.3}, ' || "
             "'{\"span\": \"Customer\", \"phi_type\": \"org\"}, ' || "
             "'{\"span\": \"' || phi_spans[1].span || '\", \"confidence\": 0.99}]'")
    return f"""detect AS (
  SELECT doc_id, seq, text, phi_spans, CASE doc_id % 5
    WHEN 0 THEN '```json' || chr(10) || ({items}) || chr(10) || '```'
    WHEN 1 THEN '[' || chr(1) || substr(({items}), 2)
    WHEN 2 THEN substr(({items}), 1, length(({items})) - 1)
    ELSE ({items}) END AS raw
  FROM notes)"""


def detections_sql(text: str, raw: str) -> str:
    fixed = repair_detect_sql(raw)
    parsed = f"CASE WHEN starts_with({fixed}, '[') THEN {json_or_null(fixed, DETECT_SHAPE)} END"
    return (f"list_transform(list_filter(coalesce({parsed}, []), lambda s: s IS NOT NULL AND s.span IS NOT NULL "
            f"AND s.phi_type IS NOT NULL AND contains({text}, s.span) AND coalesce(s.confidence, 0.5::DOUBLE) >= "
            f"(1.0::DOUBLE - 0.7::DOUBLE)), lambda s: {{'span': s.span, 'phi_type': upper(s.phi_type), "
            f"'abstraction_role': NULL::VARCHAR, 'label': NULL::VARCHAR, 'confidence': coalesce(s.confidence, 0.5::DOUBLE), "
            f"'has_pattern': coalesce(s.has_pattern, false)}})")


def hit_spans_sql(hits: str) -> str:
    return (f"list_transform({hits}, lambda h: {{'span': h.span, 'phi_type': h.phi_type, "
            f"'abstraction_role': h.abstraction_role, 'label': h.label, 'confidence': h.confidence, 'has_pattern': false}})")


def critic_raw_sql() -> str:
    leak = ("CASE doc_id % 5 WHEN 0 THEN '{\"leaked_spans\": [], \"is_clean\": true, \"confidence\": 0.9}' "
            "WHEN 1 THEN '{\"leaked_spans\": [\"' || phi_spans[1].span || '\"], \"is_clean\": false, \"confidence\": 0.8}' "
            "WHEN 2 THEN '```json' || chr(10) || '{\"leaked_spans\": [\"' || phi_spans[1].span || '\", \"Nobody\"], \"is_clean\": false}' || chr(10) || '```' "
            "WHEN 3 THEN 'not json at all' "
            "ELSE '{\"leaked_spans\": [], \"is_clean\": true, \"confidence\": 0.7, \"note\": \"C:\\data' || chr(10) || 'x\"}' END")
    flu = ("CASE doc_id % 3 WHEN 0 THEN '{\"is_fluent\": true, \"fluency_score\": 0.9, \"reason\": \"ok\"}' "
           "WHEN 1 THEN '{\"is_fluent\": false, \"fluency_score\": 0.3, \"reason\": \"odd\"}' ELSE '' END")
    over = ("CASE WHEN doc_id % 6 = 0 THEN '{\"over_encrypted\": [\"' || phi_spans[2].span || '\"], \"is_accurate\": false}' "
            "ELSE '{\"over_encrypted\": [], \"is_accurate\": true}' END")
    return f"critic AS (SELECT doc_id, {leak} AS leakage, {flu} AS fluency, {over} AS overencryption FROM notes)"


def validation_sql(docs: str) -> str:
    """MK-14 + SC-22 + AG-15 over ``docs`` (doc_id, cache_hits, encrypted LIST) joined to ``critic``."""
    lk = json_or_null(repair_critic_sql("c.leakage"), LEAK_SHAPE)
    fl = json_or_null(repair_critic_sql("c.fluency"), FLU_SHAPE)
    oe = json_or_null(repair_critic_sql("c.overencryption"), OVER_SHAPE)
    return f"""val0 AS (
  SELECT d.doc_id, d.cache_hits, len(d.encrypted) = 0 AS none_enc, {lk} AS lk, {fl} AS fl, {oe} AS oe
  FROM {docs} d LEFT JOIN critic c ON c.doc_id = d.doc_id),
val1 AS (
  SELECT doc_id, cache_hits,
    coalesce(lk.is_clean, true) AS is_clean, coalesce(fl.is_fluent, true) AS is_fluent,
    CASE WHEN none_enc THEN true ELSE coalesce(oe.is_accurate, true) END AS is_accurate,
    coalesce(lk.leaked_spans, []::VARCHAR[]) AS leaked_spans,
    CASE WHEN none_enc THEN []::VARCHAR[] ELSE coalesce(oe.over_encrypted, []::VARCHAR[]) END AS over_encrypted,
    coalesce(fl.fluency_score, 0.5::DOUBLE) AS fluency_score, coalesce(lk.confidence, 0.5::DOUBLE) AS leakage_confidence
  FROM val0),
val AS (
  SELECT *,
    CASE WHEN is_clean THEN 1.0::DOUBLE END AS r_correct_redaction,
    CASE WHEN NOT is_clean THEN -1.0::DOUBLE * len(leaked_spans) END AS r_missed_phi,
    CASE WHEN NOT is_accurate THEN -0.5::DOUBLE * len(over_encrypted) END AS r_over_encryption,
    CASE WHEN cache_hits > 0 THEN 0.3::DOUBLE * cache_hits END AS r_cache_hit_bonus,
    CASE WHEN is_fluent THEN 0.5::DOUBLE END AS r_utility_preserved
  FROM val1),
valr AS (
  SELECT *, round(((((0.0::DOUBLE + coalesce(r_correct_redaction, 0.0)) + coalesce(r_missed_phi, 0.0))
      + coalesce(r_over_encryption, 0.0)) + coalesce(r_cache_hit_bonus, 0.0)) + coalesce(r_utility_preserved, 0.0), 3)
      AS total_reward
  FROM val)"""
