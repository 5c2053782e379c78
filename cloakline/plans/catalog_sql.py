"""DuckDB twins of the registered queries (see ``catalog``)."""

from __future__ import annotations

from cloakline import constants as C
from cloakline.plans.oracle import (DOCS, NOTES, q, dedup_sql, hits_sql, mask_fold_sql, offsets_sql, route_sql,
                                    with_ctes)

SQL: dict[str, str] = {}


def _mask_report(src_cte: str, src: str, all_occ: bool = False) -> str:
    fold = mask_fold_sql("text", dedup_sql("hits"), "doc_id")
    if all_occ:
        fold = fold.replace(
            "{'text': substr(acc.text, 1, strpos(acc.text, x.span) - 1) || x.replacement || "
            "substr(acc.text, strpos(acc.text, x.span) + length(x.span)), ",
            "{'text': replace(acc.text, x.span, x.replacement), ",
        )
    return with_ctes(src_cte, f"""
scanned AS (SELECT doc_id, text, {hits_sql('text')} AS hits FROM {src}),
folded AS (SELECT doc_id, len(hits) AS cache_hits, {fold} AS f FROM scanned)""") + """
SELECT doc_id, f.text AS masked, cache_hits,
  len(f.applied) AS span_count,
  len(list_filter(f.applied, lambda a: a.action = 'encrypt')) AS encrypted_count,
  len(list_filter(f.applied, lambda a: a.action = 'abstract')) AS abstracted_count
FROM folded"""


SQL["pattern_scan"] = with_ctes(DOCS, f"scanned AS (SELECT doc_id, {hits_sql('text')} AS hits FROM docs)") + """
SELECT doc_id, (i - 1) AS hit_pos, hits[i].label AS label, hits[i].span AS span, hits[i].phi_type AS phi_type
FROM scanned, range(1, len(hits) + 1) t(i)"""

SQL["pattern_offsets"] = with_ctes(DOCS, f"scanned AS (SELECT doc_id, {offsets_sql('text')} AS hits FROM docs)") + """
SELECT doc_id, (i - 1) AS hit_pos, hits[i].label AS label, hits[i].span AS span,
  hits[i].start AS start, hits[i]."end" AS "end"
FROM scanned, range(1, len(hits) + 1) t(i)"""

SQL["pattern_scan_notes"] = with_ctes(NOTES, f"scanned AS (SELECT doc_id, {offsets_sql('text')} AS hits FROM notes)") + """
SELECT doc_id, (i - 1) AS hit_pos, hits[i].label AS label, hits[i].span AS span,
  hits[i].start AS start, hits[i]."end" AS "end"
FROM scanned, range(1, len(hits) + 1) t(i)"""

SQL["span_dedup"] = with_ctes(NOTES, f"""
scanned AS (SELECT doc_id, {hits_sql('text')} AS hits FROM notes),
merged AS (SELECT doc_id, len(hits) AS cache_hits, {dedup_sql('hits')} AS m FROM scanned)""") + """
SELECT doc_id, cache_hits, len(m) AS n_distinct,
  array_to_string(list_transform(m, lambda s: s.span), '|') AS spans,
  array_to_string(list_transform(m, lambda s: s.label), '|') AS labels
FROM merged"""

SQL["span_route"] = with_ctes(NOTES, f"""
scanned AS (SELECT doc_id, {hits_sql('text')} AS hits FROM notes),
merged AS (SELECT doc_id, {dedup_sql('hits')} AS m FROM scanned)""") + f"""
SELECT doc_id, (i - 1) AS pos, m[i].span AS span, m[i].phi_type AS phi_type, {route_sql('m[i].phi_type')} AS action
FROM merged, range(1, len(m) + 1) t(i)"""

SQL["mask_routed"] = _mask_report(NOTES, "notes")
SQL["mask_documents"] = _mask_report(DOCS, "docs")
SQL["mask_all"] = _mask_report(NOTES, "notes", all_occ=True)


# ====================================================================== shared CTEs
from cloakline.plans.oracle import (critic_raw_sql, detect_raw_sql, detections_sql, hit_spans_sql,  # noqa: E402
                                    leakage_sql, overlap_record_sql, quasi_sql, seed_rows, strip_sql,
                                    token_sql, tokens_sql, utility_sql, validation_sql, WS)

TOK = lambda d, i, s: "'<<ENC:' || " + token_sql(d, i, s) + " || ':ENC>>'"

DET = detect_raw_sql() + f""",
det AS (SELECT doc_id, seq, text, phi_spans, {hits_sql('text')} AS hits, {detections_sql('text', 'raw')} AS dets FROM detect)"""

LABEL_CASE = ("CASE WHEN system <> 'ner' THEN entity_type ELSE CASE entity_type WHEN 'PERSON' THEN 'PERSON' WHEN 'ORG' THEN 'ORG' WHEN 'GPE' THEN 'LOCATION' "
              "WHEN 'LOC' THEN 'LOCATION' WHEN 'DATE' THEN 'DATE' WHEN 'TIME' THEN 'DATE' WHEN 'CARDINAL' THEN 'AGE' "
              "WHEN 'MONEY' THEN 'CREDIT_CARD' ELSE entity_type END END")

ENTITIES = """
ent0 AS (
  SELECT doc_id, text, phi_spans,
    [{'s': 0, 'e': length(phi_spans[1].span), 't': 'PERSON'},
     CASE doc_id % 4
       WHEN 0 THEN {'s': strpos(text, phi_spans[3].span) - 1, 'e': strpos(text, phi_spans[3].span) - 1 + length(phi_spans[3].span), 't': 'DATE'}
       WHEN 1 THEN {'s': strpos(text, phi_spans[2].span) - 1, 'e': strpos(text, phi_spans[2].span) - 1 + length(CAST(10 + doc_id % 90 AS VARCHAR)), 't': 'CARDINAL'}
       WHEN 2 THEN {'s': strpos(text, 'wife') - 1, 'e': strpos(text, 'wife') - 1 + 4, 't': 'NORP'}
       ELSE {'s': strpos(text, phi_spans[5].span) - 1, 'e': strpos(text, phi_spans[5].span) - 1 + 5, 't': 'GPE'}
     END,
     CASE doc_id % 3 WHEN 0 THEN {'s': 2, 'e': length(phi_spans[1].span) + 3, 't': 'ORG'}
       WHEN 1 THEN {'s': 1, 'e': length(phi_spans[1].span) - 1, 't': 'ORG'} END] AS ents
  FROM notes WHERE doc_id % 11 <> 5),
entities AS (
  SELECT s.system, doc_id, ents[i].s::INTEGER AS start, ents[i].e::INTEGER AS "end", ents[i].t AS entity_type
  FROM ent0, range(1, 4) r(i), (VALUES ('ner'), ('pii')) s(system) WHERE ents[i] IS NOT NULL)"""

COLD = f"""
scanned AS (SELECT doc_id, seq, text, phi_spans, {hits_sql('text')} AS hits FROM notes),
cold AS (
  SELECT 'cold' AS system, doc_id, seq, text, phi_spans, f.text AS masked,
    list_transform(f.applied, lambda a: {{'span': a.span, 'phi_type': a.phi_type}}) AS pred,
    len(hits) AS cache_hits, f.applied AS applied
  FROM (SELECT *, {mask_fold_sql('text', dedup_sql('hits'), 'doc_id')} AS f FROM scanned))"""

REGEX = f"""
rx0 AS (SELECT doc_id, seq, text, phi_spans, {offsets_sql('text', seed_rows(None))} AS hoff FROM notes),
rx1 AS (SELECT *, list_sort(list_transform(hoff, lambda h, i: {{'k': -h.start, 'i': i, 'span': h.span}})) AS keyed FROM rx0),
rx2 AS (SELECT *, list_filter(keyed, lambda x, i: list_position(list_transform(keyed, lambda z: z.span), x.span) = i) AS dist FROM rx1),
regex AS (
  SELECT 'regex' AS system, doc_id, seq, text, phi_spans,
    list_reduce(dist, lambda acc, x: CASE WHEN strpos(acc, x.span) > 0 THEN substr(acc, 1, strpos(acc, x.span) - 1)
        || {TOK('doc_id', 'strpos(text, x.span) - 1', 'x.span')} || substr(acc, strpos(acc, x.span) + length(x.span))
        ELSE acc END, text) AS masked,
    list_transform(hoff, lambda h: {{'span': h.span, 'phi_type': h.phi_type}}) AS pred, 0 AS cache_hits
  FROM rx2)"""

FULLENC = f"""
fe0 AS (SELECT *, list_sort(list_transform(list_filter(list_distinct(list_transform(phi_spans, lambda s: s.span)),
          lambda g: g <> '' AND contains(text, g)), lambda g: {{'idx': strpos(text, g) - 1, 'span': g}}), 'DESC') AS srt
        FROM notes),
full_encryption AS (
  SELECT 'full_encryption' AS system, doc_id, seq, text, phi_spans,
    list_reduce(srt, lambda acc, x: substr(acc, 1, x.idx) || {TOK('doc_id', 'x.idx', 'x.span')}
        || substr(acc, x.idx + length(x.span) + 1), text) AS masked,
    list_transform(srt, lambda x: {{'span': x.span, 'phi_type': 'UNKNOWN'}}) AS pred, 0 AS cache_hits
  FROM fe0)"""

NER = ENTITIES + f""",
typed AS (SELECT system, doc_id, start AS s, "end" AS e, {LABEL_CASE} AS phi_type FROM entities),
-- an entity goes if a longer one, or an equally long one further left, overlaps it and is itself kept
lost1 AS (SELECT DISTINCT a.system, a.doc_id, a.s, a.e, a.phi_type FROM typed a JOIN typed b USING (system, doc_id)
          WHERE a.s < b.e AND b.s < a.e AND (b.e - b.s > a.e - a.s OR (b.e - b.s = a.e - a.s AND b.s < a.s))),
ner0 AS (
  SELECT system, doc_id, list_sort(list({{'k': -s, 's': s, 'e': e, 'phi_type': phi_type}})) AS ents
  FROM (SELECT * FROM typed EXCEPT SELECT * FROM lost1) GROUP BY system, doc_id),
offs AS (
  SELECT g.system, n.doc_id, n.seq, n.text, n.phi_spans,
    list_reduce(coalesce(ents, []), lambda acc, x: substr(acc, 1, x.s) || {TOK('n.doc_id', 'x.s', 'substr(n.text, x.s + 1, x.e - x.s)')}
        || substr(acc, x.e + 1), n.text) AS masked,
    coalesce(list_transform(ents, lambda x: {{'span': substr(n.text, x.s + 1, x.e - x.s), 'phi_type': x.phi_type}}), []) AS pred,
    0 AS cache_hits
  FROM notes n CROSS JOIN (VALUES ('ner'), ('pii')) g(system) LEFT JOIN ner0 ON ner0.doc_id = n.doc_id AND ner0.system = g.system),
ner AS (SELECT * FROM offs WHERE system = 'ner')"""

# the whole pipeline: detector spans after the hits (``det`` has the same hits as ``scanned``)
COLD_FULL = DET + f""",
cold AS (
  SELECT 'cold' AS system, doc_id, seq, text, phi_spans, f.text AS masked,
    list_transform(f.applied, lambda a: {{'span': a.span, 'phi_type': a.phi_type}}) AS pred, len(hits) AS cache_hits,
    len(list_filter(dets, lambda d: NOT list_contains(list_transform(hits, lambda h: h.span), d.span))) AS cache_misses
  FROM (SELECT *, {mask_fold_sql('text', dedup_sql(f"list_concat({hit_spans_sql('hits')}, dets)"), 'doc_id')} AS f FROM det))"""

OUTPUTS = COLD_FULL + "," + REGEX + "," + FULLENC + "," + NER + """,
outputs AS (
  SELECT system, doc_id, seq, text, phi_spans, masked, pred, cache_hits FROM cold
  UNION ALL SELECT system, doc_id, seq, text, phi_spans, masked, pred, cache_hits FROM regex
  UNION ALL SELECT system, doc_id, seq, text, phi_spans, masked, pred, cache_hits FROM full_encryption
  UNION ALL SELECT system, doc_id, seq, text, phi_spans, masked, pred, cache_hits FROM ner)"""

RECORDS = f"""
rec0 AS (SELECT *, list_transform(phi_spans, lambda s: s.span) AS gt, list_transform(pred, lambda s: s.span) AS pt
         FROM outputs),
records AS (
  SELECT system, doc_id, seq, cache_hits, m.tp AS tp, m.fp AS fp, m.fn AS fn, m.precision AS precision,
    m.recall AS recall, m.f1 AS f1, {leakage_sql('masked', 'gt')} AS leakage, {quasi_sql('text', 'masked')} AS quasi_risk,
    {utility_sql('text', 'masked')} AS utility
  FROM (SELECT *, {overlap_record_sql('gt', 'pt')} AS m FROM rec0))"""


def R(x: str, n: int = 6) -> str:
    return f"round({x}, {n})"


# ====================================================================== detector side
SQL["detector_parse"] = with_ctes(NOTES, DET) + """
SELECT doc_id, (i - 1) AS pos, dets[i].span AS span, dets[i].phi_type AS phi_type,
  dets[i].confidence AS confidence, dets[i].has_pattern AS has_pattern
FROM det, range(1, len(dets) + 1) t(i)"""

SQL["cache_misses"] = with_ctes(NOTES, DET) + """
SELECT doc_id, len(hits) AS cache_hits,
  len(list_filter(dets, lambda d: NOT list_contains(list_transform(hits, lambda h: h.span), d.span))) AS cache_misses,
  len(list_filter(dets, lambda d: NOT list_contains(list_transform(hits, lambda h: h.span), d.span) AND d.has_pattern)) AS n_learnable
FROM det"""

SQL["reply_rejects"] = with_ctes(NOTES, detect_raw_sql(), """
told AS (SELECT doc_id, raw FROM detect UNION ALL SELECT doc_id, raw || ' ' FROM detect WHERE doc_id % 10 = 0
         UNION ALL SELECT doc_id, raw FROM detect WHERE doc_id % 15 = 0)""") + """
SELECT doc_id, 'detect' AS kind, raw FROM told QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY raw DESC) > 1"""

SQL["skip_gate"] = with_ctes(NOTES, f"s AS (SELECT doc_id, {hits_sql('text')} AS hits FROM notes)") + """
SELECT doc_id, len(list_filter(hits, lambda h: h.promoted)) AS promoted_hits,
  len(list_filter(hits, lambda h: h.promoted)) >= 2 AS skip_detector
FROM s"""

_PHRASE = ("CASE WHEN doc_id % 3 = 0 AND SPAN = phi_spans[1].span THEN "
           "CASE WHEN len(list_filter(regexp_split_to_array(" + strip_sql("'  the  patient on record in this file '") +
           ", '" + WS + "'), lambda w: w <> '')) > 6 THEN array_to_string(list_filter(regexp_split_to_array(" +
           strip_sql("'  the  patient on record in this file '") + ", '" + WS + "'), lambda w: w <> '')[1:6], ' ') "
           "ELSE " + strip_sql("'  the  patient on record in this file '") + " END END")

SQL["mask_with_detector"] = with_ctes(NOTES, DET, f"""
m AS (SELECT doc_id, len(hits) AS cache_hits,
        len(list_filter(dets, lambda d: NOT list_contains(list_transform(hits, lambda h: h.span), d.span))) AS cache_misses,
        {mask_fold_sql('text', dedup_sql(f"list_concat({hit_spans_sql('hits')}, dets)"), 'doc_id', _PHRASE)} AS f
      FROM det)""") + """
SELECT doc_id, f.text AS masked, cache_hits, cache_misses, len(f.applied) AS span_count,
  len(list_filter(f.applied, lambda a: a.action = 'encrypt')) AS encrypted_count,
  len(list_filter(f.applied, lambda a: a.action = 'abstract')) AS abstracted_count
FROM m"""

# ====================================================================== other maskers
SQL["mask_regex_baseline"] = with_ctes(NOTES, REGEX) + "SELECT doc_id, masked, len(pred) AS n_pred FROM regex"
SQL["mask_full_encryption"] = with_ctes(NOTES, FULLENC) + "SELECT doc_id, masked, len(pred) AS n_pred FROM full_encryption"
SQL["mask_offsets"] = with_ctes(NOTES, NER) + """
SELECT system, doc_id, masked, array_to_string(list_transform(pred, lambda p: concat_ws(':', p.phi_type, p.span)), '|') AS pred
FROM offs"""

SQL["mask_sequential"] = with_ctes(NOTES, f"""
sq AS (SELECT doc_id, list_reduce(list_transform(phi_spans, lambda s, i: {{'span': s.span, 'i': i - 1}}),
    lambda acc, x: CASE WHEN strpos(acc.t, x.span) > 0 THEN {{'t': substr(acc.t, 1, strpos(acc.t, x.span) - 1)
      || {TOK('doc_id', 'x.i', 'x.span')} || substr(acc.t, strpos(acc.t, x.span) + length(x.span)), 'n': acc.n + 1}}
      ELSE acc END, {{'t': text, 'n': 0}}) AS f FROM notes)""") + """
SELECT doc_id, f.t AS masked, f.n AS n_applied FROM sq"""

SQL["label_map"] = with_ctes(NOTES, ENTITIES) + f"""
SELECT system, doc_id, start, "end", entity_type, {LABEL_CASE} AS phi_type FROM entities"""

SQL["corpus_load"] = with_ctes(NOTES, f"""
raw AS (
  SELECT doc_id AS row_id,
    CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '   ' ELSE text END AS source_text,
    CASE doc_id % 5 WHEN 2 THEN NULL WHEN 3 THEN 'ignored' ELSE text END AS text,
    list_concat(list_transform(phi_spans, lambda s, i: {{
        'value': CASE WHEN (i - 1) % 3 = 0 THEN s.span END,
        'text': CASE WHEN (i - 1) % 3 = 1 THEN s.span WHEN i - 1 = 2 THEN '' END,
        'span': CASE WHEN (i - 1) % 3 = 2 THEN s.span END,
        'label': CASE WHEN (doc_id + i - 1) % 7 <> 0 THEN s.phi_type END}}),
      [{{'value': 'not in text', 'text': NULL::VARCHAR, 'span': NULL::VARCHAR, 'label': 'PERSON'}}]) AS privacy_mask
  FROM notes),
ld AS (
  SELECT row_id, coalesce(nullif(source_text, ''), nullif(text, ''), '') AS t, privacy_mask FROM raw),
ld2 AS (
  SELECT row_id AS doc_id, t AS text,
    list_transform(list_filter(privacy_mask, lambda m: coalesce(nullif(m.value, ''), nullif(m.text, ''), coalesce(m.span, '')) <> ''
        AND contains(t, coalesce(nullif(m.value, ''), nullif(m.text, ''), coalesce(m.span, '')))),
      lambda m: {{'span': coalesce(nullif(m.value, ''), nullif(m.text, ''), coalesce(m.span, '')),
                 'phi_type': coalesce(m.label, 'UNKNOWN')}}) AS spans
  FROM ld WHERE {strip_sql('t')} <> '')""") + """
SELECT doc_id, text, len(spans) AS n_spans,
  array_to_string(list_transform(spans, lambda s: concat_ws(':', s.phi_type, s.span)), '|') AS spans
FROM ld2"""

# ====================================================================== vault
SQL["vault_roundtrip"] = with_ctes(NOTES, COLD) + """
SELECT doc_id,
  list_reduce(list_filter(applied, lambda a: a.action = 'encrypt'), lambda acc, a: replace(acc, a.replacement, a.span), masked) AS restored,
  len(list_distinct(regexp_extract_all(masked, '<<ENC:([^:]+):ENC>>', 1))) AS n_tokens,
  len(list_distinct(regexp_extract_all(masked, '<<ENC:([^:]+):ENC>>', 1))) AS n_restored
FROM cold"""

SQL["vault_unmatched"] = with_ctes(NOTES, COLD) + """
SELECT doc_id, unnest(list_distinct(regexp_extract_all(masked, '<<ENC:([^:]+):ENC>>', 1))) AS token_id
FROM cold WHERE doc_id % 7 = 3 OR doc_id % 11 = 4"""

_ALLOCC_FOLD = mask_fold_sql("text", dedup_sql("hits"), "doc_id").replace(
    "{'text': substr(acc.text, 1, strpos(acc.text, x.span) - 1) || x.replacement || "
    "substr(acc.text, strpos(acc.text, x.span) + length(x.span)), ",
    "{'text': replace(acc.text, x.span, x.replacement), ")

SQL["vault_import"] = with_ctes(NOTES, f"""
scanned AS (SELECT doc_id, text, {hits_sql('text')} AS hits FROM notes),
items AS (
  SELECT doc_id, list_filter(list_transform(list_filter({dedup_sql('hits')}, lambda s: strpos(text, s.span) > 0),
      lambda s: {{'token_id': {token_sql('doc_id', 'strpos(text, s.span) - 1', 's.span')}, 'span': s.span,
                 'action': {route_sql('s.phi_type')}}}), lambda x: x.action = 'encrypt') AS v1,
    list_transform(list_filter(({_ALLOCC_FOLD}).applied, lambda a: a.action = 'encrypt'),
      lambda a: {{'token_id': regexp_extract(a.replacement, '<<ENC:([^:]+):ENC>>', 1), 'span': a.span}}) AS v2
  FROM scanned),
u AS (
  SELECT doc_id, v1[i].token_id AS token_id, length(v1[i].span) AS original_len, 1 AS version
  FROM items, range(1, len(v1) + 1) t(i)
  UNION ALL
  SELECT doc_id, v2[i].token_id AS token_id, length(v2[i].span) AS original_len, 2 AS version
  FROM items, range(1, len(v2) + 1) t(i))""") + """
SELECT doc_id, token_id, original_len, version FROM u
QUALIFY row_number() OVER (PARTITION BY doc_id, token_id ORDER BY version DESC) = 1"""

# ====================================================================== metrics
SQL["exact_metrics"] = with_ctes(NOTES, COLD, """
e0 AS (SELECT doc_id, text, masked, list_distinct(list_transform(phi_spans, lambda s: s.span)) AS g,
         list_distinct(list_transform(pred, lambda s: s.span)) AS p FROM cold),
e1 AS (SELECT doc_id, text, masked, len(list_intersect(g, p)) AS tp,
         len(list_filter(p, lambda x: NOT list_contains(g, x))) AS fp,
         len(list_filter(g, lambda x: NOT list_contains(p, x))) AS fn FROM e0),
e2 AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 1.0::DOUBLE END AS precision,
         CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 1.0::DOUBLE END AS recall FROM e1)""") + f"""
SELECT doc_id, tp, fp, fn, {R('precision')} AS precision, {R('recall')} AS recall,
  {R('CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END')} AS f1,
  {R(utility_sql('text', 'masked'))} AS utility
FROM e2"""

SQL["overlap_metrics"] = with_ctes(NOTES, OUTPUTS, RECORDS) + f"""
SELECT system, doc_id, tp, fp, fn, {R('precision')} AS precision, {R('recall')} AS recall, {R('f1')} AS f1,
  leakage, {R('quasi_risk')} AS quasi_risk, {R('utility')} AS utility
FROM records"""

SQL["per_type_exact"] = with_ctes(NOTES, COLD, """
t AS (SELECT DISTINCT doc_id, coalesce(s.phi_type, 'UNKNOWN') AS phi_type, s.span AS span, true AS in_gt
      FROM (SELECT doc_id, unnest(phi_spans) AS s FROM cold)),
p AS (SELECT DISTINCT doc_id, coalesce(s.phi_type, 'UNKNOWN') AS phi_type, s.span AS span, true AS in_pred
      FROM (SELECT doc_id, unnest(pred) AS s FROM cold)),
j AS (SELECT coalesce(t.phi_type, p.phi_type) AS phi_type, in_gt, in_pred
      FROM t FULL OUTER JOIN p ON t.doc_id = p.doc_id AND t.phi_type = p.phi_type AND t.span = p.span),
a AS (SELECT phi_type, count_if(coalesce(in_gt AND in_pred, false)) AS tp,
        count_if(coalesce(in_pred AND in_gt IS NULL, false)) AS fp,
        count_if(coalesce(in_gt AND in_pred IS NULL, false)) AS fn FROM j GROUP BY phi_type),
b AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS precision,
        CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END AS recall FROM a)""") + f"""
SELECT phi_type, tp, fp, fn, {R('precision')} AS precision, {R('recall')} AS recall,
  {R('CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END')} AS f1,
  tp + fn AS support
FROM b"""

_BY_TYPE = """
gl AS (SELECT o.system, o.doc_id, coalesce(s.phi_type, 'UNKNOWN') AS phi_type, list(s.span ORDER BY i) AS gt
       FROM outputs o, range(1, len(o.phi_spans) + 1) r(i), LATERAL (SELECT o.phi_spans[i] AS s)
       GROUP BY ALL),
pl AS (SELECT o.system, o.doc_id, coalesce(s.phi_type, 'UNKNOWN') AS phi_type, list(s.span ORDER BY i) AS pred
       FROM outputs o, range(1, len(o.pred) + 1) r(i), LATERAL (SELECT o.pred[i] AS s)
       GROUP BY ALL),
j AS (SELECT coalesce(gl.system, pl.system) AS system, coalesce(gl.phi_type, pl.phi_type) AS phi_type,
        coalesce(gt, []::VARCHAR[]) AS gt, coalesce(pred, []::VARCHAR[]) AS pred
      FROM gl FULL OUTER JOIN pl ON gl.system = pl.system AND gl.doc_id = pl.doc_id AND gl.phi_type = pl.phi_type),
m AS (SELECT system, phi_type, """ + overlap_record_sql("gt", "pred") + """ AS m FROM j),
a AS (SELECT system, phi_type, sum(m.tp) AS tp, sum(m.fp) AS fp, sum(m.fn) AS fn FROM m GROUP BY system, phi_type),
b AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS precision,
        CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END AS recall FROM a)"""
_BY_TYPE_ROWS = f"""
SELECT system, phi_type, tp, fp, fn, {R('precision')} AS precision, {R('recall')} AS recall,
  {R('CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END')} AS f1
FROM b"""

SQL["per_type_overlap"] = with_ctes(NOTES, OUTPUTS, _BY_TYPE) + _BY_TYPE_ROWS

SQL["security_by_system"] = with_ctes(NOTES, OUTPUTS, RECORDS) + f"""
SELECT system, {R('avg(leakage)')} AS exact_leakage, {R('avg(quasi_risk)')} AS quasi_id_risk,
  {R('avg(utility)')} AS utility_score, count(*) AS n
FROM records GROUP BY system"""

SQL["detection_by_system"] = with_ctes(NOTES, OUTPUTS, RECORDS) + f"""
SELECT system, {R('avg(precision)')} AS precision, {R('avg(recall)')} AS recall, {R('avg(f1)')} AS f1
FROM records GROUP BY system"""

SQL["latency_stats"] = """
WITH e AS (SELECT event_type, value AS latency_ms, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_type, """ + f"""{R('avg(latency_ms)')} AS mean_ms, {R('quantile_cont(latency_ms, 0.5)')} AS median_ms,
  {R('quantile_cont(latency_ms, 0.95)')} AS p95_ms, {R('min(latency_ms)')} AS min_ms,
  {R('coalesce(avg(latency_ms) FILTER (WHERE k % 3 > 0), 0.0)')} AS cache_hit_mean_ms,
  {R('coalesce(avg(latency_ms) FILTER (WHERE k % 2 > 0), 0.0)')} AS cache_miss_mean_ms, count(*) AS n
FROM e GROUP BY event_type"""

# ====================================================================== critic and control
CRITIC_DOCS = """
cdocs AS (SELECT doc_id, cache_hits,
  list_transform(list_filter(applied, lambda a: a.action = 'encrypt'), lambda a: a.span) AS encrypted FROM cold)"""

SQL["critic_reward"] = with_ctes(NOTES, COLD, CRITIC_DOCS, critic_raw_sql(), validation_sql("cdocs")) + f"""
SELECT doc_id, is_clean, is_fluent, is_accurate, len(leaked_spans) AS n_leaked, len(over_encrypted) AS n_over,
  {R('fluency_score')} AS fluency_score, {R('leakage_confidence')} AS leakage_confidence,
  {R('r_correct_redaction')} AS r_correct_redaction, {R('r_missed_phi')} AS r_missed_phi,
  {R('r_over_encryption')} AS r_over_encryption, {R('r_cache_hit_bonus')} AS r_cache_hit_bonus,
  {R('r_utility_preserved')} AS r_utility_preserved, {R('total_reward')} AS total_reward
FROM valr"""

SQL["micro_macro"] = with_ctes(NOTES, COLD, CRITIC_DOCS, critic_raw_sql(), validation_sql("cdocs"), """
e0 AS (SELECT doc_id, text, masked, cache_hits, list_distinct(list_transform(phi_spans, lambda s: s.span)) AS g,
         list_distinct(list_transform(pred, lambda s: s.span)) AS p FROM cold),
e1 AS (SELECT *, len(list_intersect(g, p)) AS tp, len(list_filter(p, lambda x: NOT list_contains(g, x))) AS fp,
         len(list_filter(g, lambda x: NOT list_contains(p, x))) AS fn FROM e0),
e2 AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 1.0::DOUBLE END AS precision,
         CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 1.0::DOUBLE END AS recall FROM e1),
e3 AS (SELECT e2.*, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
         """ + utility_sql("text", "masked") + """ AS utility, coalesce(v.total_reward, 0.0) AS total_reward
       FROM e2 LEFT JOIN valr v USING (doc_id)),
a AS (SELECT count(*) AS n_samples, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg(precision) AS macro_precision,
        avg(recall) AS macro_recall, avg(f1) AS macro_f1, avg(utility) AS avg_utility_score,
        avg(total_reward) AS avg_reward, avg(CASE WHEN cache_hits > 0 THEN 1.0 ELSE 0.0 END) AS cache_hit_rate FROM e3),
b AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS mp,
        CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END AS mr FROM a)""") + f"""
SELECT n_samples, tp, fp, fn, {R('macro_precision')} AS macro_precision, {R('macro_recall')} AS macro_recall,
  {R('macro_f1')} AS macro_f1, {R('mp')} AS micro_precision, {R('mr')} AS micro_recall,
  {R('CASE WHEN mp + mr > 0 THEN 2 * mp * mr / (mp + mr) ELSE 0.0 END')} AS micro_f1,
  {R('CASE WHEN tp + fn > 0 THEN fn::DOUBLE / (tp + fn) ELSE 0.0 END')} AS miss_rate,
  {R('avg_utility_score')} AS avg_utility_score, {R('avg_reward')} AS avg_reward, {R('cache_hit_rate')} AS cache_hit_rate
FROM b"""

SQL["evaluation_records"] = with_ctes(NOTES, COLD, CRITIC_DOCS, critic_raw_sql(), validation_sql("cdocs"), """
e0 AS (SELECT *, list_distinct(list_transform(phi_spans, lambda s: s.span)) AS g,
         list_distinct(list_transform(pred, lambda s: s.span)) AS p FROM cold),
e1 AS (SELECT *, len(list_intersect(g, p)) AS tp, len(list_filter(p, lambda x: NOT list_contains(g, x))) AS fp,
         len(list_filter(g, lambda x: NOT list_contains(p, x))) AS fn FROM e0),
e2 AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 1.0::DOUBLE END AS precision,
         CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 1.0::DOUBLE END AS recall FROM e1)""") + f"""
SELECT e.doc_id, e.seq, length(text) AS text_len, len(phi_spans) AS gt_count, len(applied) AS span_count,
  len(list_filter(applied, lambda a: a.action = 'encrypt')) AS encrypted_count,
  len(list_filter(applied, lambda a: a.action = 'abstract')) AS abstracted_count, tp, fp, fn,
  {R('precision')} AS precision, {R('recall')} AS recall,
  {R('CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END')} AS f1,
  {R(utility_sql("text", "masked"))} AS utility, e.cache_hits, 0 AS cache_misses, v.is_clean,
  {R('coalesce(v.total_reward, 0.0)')} AS total_reward, masked,
  CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty text' END AS error
FROM e2 e LEFT JOIN valr v USING (doc_id)"""

SQL["system_latency"] = with_ctes(NOTES, COLD, REGEX) + f"""
SELECT system, {R('avg(l)')} AS mean_ms, {R('quantile_cont(l, 0.5)')} AS median_ms, {R('quantile_cont(l, 0.95)')} AS p95_ms, {R('min(l)')} AS min_ms, count(*) AS n
FROM (SELECT system, coalesce(e.value, 0.0) AS l FROM (SELECT system, doc_id FROM cold UNION ALL SELECT system, doc_id FROM regex) s
      LEFT JOIN events e ON e.event_id = s.doc_id) GROUP BY system"""

SQL["mean_latencies"] = with_ctes(NOTES, critic_raw_sql()) + f"""
SELECT count(*) AS n, {R('avg(l)')} AS avg_latency_ms, count_if(seen) AS n_validated, {R('avg(l) FILTER (WHERE seen)')} AS avg_validated_ms
FROM (SELECT coalesce(e.value, 0.0) AS l, n.doc_id IN (SELECT doc_id FROM critic WHERE starts_with(leakage, '{{')) AS seen
      FROM notes n LEFT JOIN events e ON e.event_id = n.doc_id)"""

SQL["report_by_type"] = f"""
SELECT row_number() OVER (ORDER BY support DESC, phi_type) AS place, phi_type, round(precision, 3) AS precision,
  round(recall, 3) AS recall, round(f1, 3) AS f1, support FROM ({SQL["per_type_exact"]})"""

EVENT_VAL = """
ev AS (
  SELECT event_id AS seq, event_id AS doc_id, event_type <> 'error' AS is_clean,
    CASE WHEN event_type = 'error' AND value > 50 THEN [props, CAST(user_id AS VARCHAR)]
         WHEN event_type = 'error' AND value > 10 THEN [props] ELSE []::VARCHAR[] END AS leaked_spans,
    NOT (event_type = 'purchase' AND value > 100) AS is_accurate,
    CASE WHEN event_type = 'purchase' AND value > 100 THEN [CAST(user_id AS VARCHAR)] ELSE []::VARCHAR[] END AS over_encrypted,
    event_type, props, user_id
  FROM events)"""

SQL["param_control"] = "WITH RECURSIVE " + EVENT_VAL.strip() + """,
st AS (
  SELECT seq, (NOT is_clean AND len(leaked_spans) > 0) AS leak, (NOT is_accurate AND len(over_encrypted) > 0) AS over,
    (is_clean AND len(over_encrypted) = 0) AS loosen FROM ev),
r(seq, s, m) AS (
  SELECT -1::BIGINT, 700::BIGINT, 750::BIGINT
  UNION ALL
  SELECT st.seq,
    CASE WHEN st.over THEN greatest(300, CASE WHEN st.leak THEN least(1000, r.s + 50) ELSE r.s END - 50)
         ELSE CASE WHEN st.leak THEN least(1000, r.s + 50) ELSE r.s END END,
    CASE WHEN st.loosen THEN greatest(500, CASE WHEN st.over THEN least(950, r.m + 20) ELSE r.m END - 10)
         ELSE CASE WHEN st.over THEN least(950, r.m + 20) ELSE r.m END END
  FROM r JOIN st ON st.seq = r.seq + 1)
SELECT seq, round(s::DOUBLE / 1000.0::DOUBLE, 6) AS sensitivity, round(m::DOUBLE / 1000.0::DOUBLE, 6) AS min_confidence
FROM r WHERE seq >= 0"""

SQL["focus_list"] = with_ctes(EVENT_VAL, """
isl AS (SELECT seq, is_clean, leaked_spans,
          sum(CASE WHEN is_clean THEN 1 ELSE 0 END) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
        FROM ev),
spans AS (
  SELECT event_id AS doc_id, 0 AS pos, props AS span, upper(event_type) AS phi_type FROM events
  UNION ALL SELECT event_id, 1, CAST(user_id AS VARCHAR), 'USER' FROM events),
typed AS (
  SELECT i.island, s.phi_type, i.seq, s.pos FROM isl i JOIN spans s ON s.doc_id = i.seq
  WHERE NOT i.is_clean AND len(i.leaked_spans) > 0 AND list_contains(i.leaked_spans, s.span)
    AND s.phi_type IS NOT NULL AND s.phi_type <> ''),
first AS (SELECT island, phi_type, min({'seq': seq, 'pos': pos}) AS f FROM typed GROUP BY island, phi_type),
lists AS (
  SELECT i.seq, string_agg(f.phi_type, ',' ORDER BY f.f.seq, f.f.pos) AS l
  FROM isl i JOIN first f ON f.island = i.island AND f.f.seq <= i.seq
  WHERE NOT i.is_clean GROUP BY i.seq)""") + """
SELECT isl.seq, coalesce(lists.l, '') AS phi_types_focus FROM isl LEFT JOIN lists USING (seq)"""


def _feedback_sql(per_user: bool) -> str:
    label = "event_type || '_' || CAST(user_id AS VARCHAR)" if per_user else "event_type"
    thr = "30.0" if per_user else "10.0"
    return f"""
fb AS (SELECT event_id AS seq, {label} AS label, value >= {thr} AS correct FROM events),
run AS (
  SELECT *, sum(CASE WHEN correct THEN 1 ELSE 0 END) OVER w AS h, sum(CASE WHEN correct THEN 0 ELSE 1 END) OVER w AS m
  FROM fb WINDOW w AS (PARTITION BY label ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
lab AS (
  SELECT label, min(seq) AS first_seq, sum(CASE WHEN correct THEN 1 ELSE 0 END) AS hits,
    sum(CASE WHEN correct THEN 0 ELSE 1 END) AS misses,
    bool_or(h >= 20 AND h::DOUBLE / (h + m) > 0.75) AS promoted,
    min(CASE WHEN h >= 20 AND h::DOUBLE / (h + m) > 0.75 THEN seq END) AS promoted_at
  FROM run GROUP BY label),
fbk AS (SELECT *, CASE WHEN hits + misses > 0 THEN hits::DOUBLE / (hits + misses) ELSE 0.5 END AS confidence FROM lab)"""


SQL["pattern_feedback"] = with_ctes(_feedback_sql(False)) + f"""
SELECT label, hits, misses, {R('confidence')} AS confidence, promoted FROM fbk"""

SQL["pattern_promote"] = with_ctes(_feedback_sql(True)) + """
SELECT label, promoted_at, hits, misses FROM fbk"""

SQL["pattern_prune_cap"] = with_ctes(_feedback_sql(True), """
pr AS (SELECT * FROM fbk WHERE NOT (confidence < 0.40 AND hits + misses > 10)),
rk AS (SELECT *, count(*) OVER () AS total,
         row_number() OVER (PARTITION BY promoted ORDER BY confidence, first_seq) AS rnk FROM pr)""") + f"""
SELECT label, hits, misses, {R('confidence')} AS confidence, promoted FROM rk
WHERE promoted OR rnk > greatest(total - 200, 0)"""

# ====================================================================== pattern memory
LEARN = """
lrn0 AS (SELECT seq, list_filter(dets, lambda d: NOT list_contains(list_transform(hits, lambda h: h.span), d.span)
           AND d.has_pattern) AS l FROM det),
lrn AS (SELECT seq, i - 1 AS pos, l[i].span AS span, l[i].phi_type AS phi_type FROM lrn0, range(1, len(l) + 1) t(i)),
shaped AS (
  SELECT *, (CASE WHEN regexp_matches(span, '^[\\dA-Za-z]') THEN '\\b' ELSE '' END) ||
    array_to_string(list_transform(regexp_extract_all(span, '\\d+|[A-Za-z]+|\\s+|[^\\dA-Za-z\\s]'), lambda p:
      CASE WHEN regexp_full_match(p, '\\d+') THEN '\\d{' || CAST(length(p) AS VARCHAR) || '}'
           WHEN regexp_full_match(p, '[A-Za-z]+') THEN '[A-Za-z]{' || CAST(length(p) AS VARCHAR) || '}'
           WHEN regexp_full_match(p, '\\s+') THEN '\\s+' ELSE '\\' || p END), '') ||
    (CASE WHEN regexp_matches(span, '[\\dA-Za-z]$') THEN '\\b' ELSE '' END) AS regex
  FROM lrn),
grp AS (
  SELECT phi_type, regex, count(*) AS support, arg_min(span, {'seq': seq, 'pos': pos}) AS first_span,
    min({'seq': seq, 'pos': pos}) AS first_at
  FROM shaped GROUP BY phi_type, regex HAVING count(*) >= 2),
learned AS (
  SELECT phi_type || '_' || replace(substr(first_span, 1, 8), ' ', '_') AS label, regex, phi_type, support, first_at
  FROM grp QUALIFY row_number() OVER (PARTITION BY phi_type || '_' || replace(substr(first_span, 1, 8), ' ', '_')
                                      ORDER BY first_at) = 1),
learned2 AS (SELECT *, row_number() OVER (ORDER BY first_at) - 1 AS pattern_seq FROM learned)"""

SQL["pattern_learn"] = with_ctes(NOTES, DET, LEARN) + """
SELECT label, regex, phi_type, support, 0.5::DOUBLE AS confidence, false AS promoted FROM learned2"""

SQL["pattern_stats"] = with_ctes(NOTES, DET, LEARN) + f"""
SELECT 17 + count(*) AS total, 17 AS promoted, {R('(17 * 0.96::DOUBLE + count(*) * 0.5::DOUBLE) / (17 + count(*))')} AS avg_confidence
FROM learned2"""

_SEEDS_VALUES = ", ".join(f"({i}, {q(lbl)}, {q(t)})" for i, (lbl, _rx, t, _r) in enumerate(C.SEED_PATTERNS))

SQL["seed_merge"] = with_ctes(NOTES, DET, LEARN, f"""
seeds(i, label, phi_type) AS (VALUES {_SEEDS_VALUES}),
fresh AS (SELECT * FROM seeds WHERE label NOT IN (SELECT label FROM learned2))""") + """
SELECT label, CAST(pattern_seq AS INTEGER) AS pattern_seq, phi_type, 0::BIGINT AS hits, 0::BIGINT AS misses,
  0.5::DOUBLE AS confidence, false AS promoted FROM learned2
UNION ALL
SELECT label, CAST((SELECT coalesce(max(pattern_seq), -1) FROM learned2) + row_number() OVER (ORDER BY i, label) AS INTEGER),
  phi_type, 48::BIGINT, 2::BIGINT, 0.96::DOUBLE, true FROM fresh"""

SQL["pattern_state"] = with_ctes(NOTES, DET, LEARN, _feedback_sql(True), f"""
seeds(i, label, phi_type) AS (VALUES {_SEEDS_VALUES}),
table0 AS (SELECT label, 48 AS hits, 2 AS misses, 0.96::DOUBLE AS confidence, true AS promoted, 0 AS part, i AS place FROM seeds
  UNION ALL SELECT label, 0, 0, 0.5, false, 1, pattern_seq FROM learned2 WHERE label NOT IN (SELECT label FROM seeds)
  UNION ALL SELECT label, hits, misses, confidence, promoted, 2, first_seq FROM fbk),
pr AS (SELECT * FROM table0 WHERE NOT (confidence < 0.40 AND hits + misses > 10)),
rk AS (SELECT *, count(*) OVER () AS total,
         row_number() OVER (PARTITION BY promoted ORDER BY confidence, part, place) AS rnk FROM pr)""") + f"""
SELECT label, hits::BIGINT AS hits, misses::BIGINT AS misses, {R('confidence')} AS confidence, promoted FROM rk
WHERE promoted OR rnk > greatest(total - 200, 0)"""

# every event of every label, one after the other: 1 a sighting, 3 feedback; a pattern marked bad at a sentence goes
# with the next one (after what that one sees, before what is said of it)
_MEMORY = """
told AS (SELECT event_type || '_' || (user_id % 8) AS label, event_id AS seq, event_type, value, value >= 20 + 25 * (user_id % 8) AS correct FROM events),
evs AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY seq, kind) AS k FROM (
  SELECT label, seq, 1 AS kind, NULL::BOOLEAN AS correct FROM told WHERE value >= 40
  UNION ALL SELECT label, seq, 3, correct FROM told)),
life AS (
  SELECT DISTINCT label, 0::BIGINT AS k, -1::BIGINT AS seq, event_type = 'view' AS alive, -1::BIGINT AS since, 0::BIGINT AS h, 0::BIGINT AS m,
    0.5::DOUBLE AS conf, false AS promo, NULL::BIGINT AS doomed, NULL::BIGINT AS gone_at, -1::BIGINT AS gone_since, false AS told FROM told
  UNION ALL
  SELECT label, k, seq, up OR fresh, CASE WHEN fresh THEN seq ELSE since END, h1, m1,
    CASE WHEN fresh THEN 0.5 WHEN fed THEN h1::DOUBLE / (h1 + m1) ELSE conf END,
    CASE WHEN fresh THEN false WHEN fed THEN promo OR (h1 >= 20 AND h1::DOUBLE / (h1 + m1) > 0.75) ELSE promo END,
    CASE WHEN fed THEN CASE WHEN h1::DOUBLE / (h1 + m1) < 0.4 AND h1 + m1 > 10 THEN seq + 1 END WHEN gone THEN NULL ELSE doomed END,
    CASE WHEN gone THEN doomed END, CASE WHEN gone THEN since END, fed
  FROM (SELECT *, CASE WHEN fresh THEN 0 ELSE h + CASE WHEN fed AND correct THEN 1 ELSE 0 END END AS h1,
          CASE WHEN fresh THEN 0 ELSE m + CASE WHEN fed AND NOT correct THEN 1 ELSE 0 END END AS m1
        FROM (SELECT *, kind = 1 AND NOT up AS fresh, kind = 3 AND up AS fed
              FROM (SELECT *, alive AND NOT gone AS up
                    FROM (SELECT l.* EXCLUDE (k, seq, gone_at, gone_since, told), e.k, e.seq, e.kind, e.correct,
                            l.alive AND l.doomed IS NOT NULL AND (e.seq > l.doomed OR (e.seq = l.doomed AND e.kind > 2)) AS gone
                          FROM life l JOIN evs e ON e.label = l.label AND e.k = l.k + 1)))))"""

SQL["memory_growth"] = "WITH RECURSIVE " + _MEMORY.strip() + """,
steps AS (SELECT range AS b FROM range(0, (SELECT max(seq) FROM told) // 50 + 1)),
found AS (
  SELECT s.b, l.label, arg_max({'alive': l.alive AND NOT coalesce(l.doomed <= s.b * 50, false), 'conf': l.conf, 'promo': l.promo}, l.k) AS x
  FROM steps s JOIN life l ON l.seq <= s.b * 50 GROUP BY s.b, l.label)""" + f"""
SELECT b * 50 AS step, count_if(x.alive) AS total, count_if(x.alive AND x.promo) AS promoted,
  {R('coalesce(avg(x.conf) FILTER (WHERE x.alive), 0.0)')} AS avg_conf
FROM found GROUP BY b"""

SQL["pattern_history"] = "WITH RECURSIVE " + _MEMORY.strip() + """,
ends AS (SELECT label, gone_since AS since, gone_at FROM life WHERE gone_at IS NOT NULL
         UNION ALL SELECT label, since, doomed FROM (SELECT *, max(k) OVER (PARTITION BY label) AS last FROM life)
         WHERE k = last AND alive AND doomed <= (SELECT max(seq) FROM told)),
lives AS (SELECT label, since, min(seq) FILTER (WHERE promo) AS promoted_at, count_if(told) AS observations FROM life
          WHERE told OR (alive AND since = seq) GROUP BY label, since)
SELECT label, since AS inserted_at, gone_at AS pruned_at, promoted_at, observations FROM lives LEFT JOIN ends USING (label, since)"""

# ====================================================================== audit and counters
from cloakline.plans.oracle import first_array_sql, repair_critic_sql, tokset_sql  # noqa: E402

_GUESS = r"[0-9][0-9.()/-]*[0-9]|[A-Za-z0-9.]+@[A-Za-z0-9.]+"

SQL["attack_rate"] = with_ctes(NOTES, OUTPUTS, f"""
gs AS (SELECT *, regexp_extract_all(masked, '{_GUESS}') AS vals FROM outputs),
gr AS (SELECT *, 'Here is my list: ' || CASE WHEN len(vals) = 0 THEN '[]' ELSE '["' || array_to_string(vals, '", "') || '"]' END
         || ' and more [x]' AS raw FROM gs),
gp AS (SELECT system, doc_id,
         list_filter(list_transform(phi_spans, lambda s: s.span), lambda x: x IS NOT NULL AND x <> '') AS gt,
         list_filter(coalesce(CASE WHEN json_valid({first_array_sql(repair_critic_sql('raw'))})
           THEN from_json({first_array_sql(repair_critic_sql('raw'))}, '["VARCHAR"]') END, []::VARCHAR[]),
           lambda x: x IS NOT NULL AND x <> '') AS g
       FROM gr),
per AS (SELECT system, len(gt) AS total_gt,
          len(list_filter(gt, lambda t: len(list_filter(g, lambda q: len(list_intersect({tokset_sql('q')}, {tokset_sql('t')})) > 0)) > 0)) AS rec
        FROM gp),
a AS (SELECT system, sum(total_gt) AS total_spans, sum(rec) AS recovered_spans FROM per GROUP BY system)""") + f"""
SELECT system, {R('CASE WHEN total_spans > 0 THEN recovered_spans::DOUBLE / total_spans ELSE 0.0 END')} AS attack_success_rate,
  total_spans, recovered_spans FROM a"""

SQL["run_counters"] = with_ctes(NOTES, DET, f"""
mk AS (SELECT doc_id, len(hits) AS cache_hits,
        len(list_filter(dets, lambda d: NOT list_contains(list_transform(hits, lambda h: h.span), d.span))) AS cache_misses,
        {mask_fold_sql('text', dedup_sql(f"list_concat({hit_spans_sql('hits')}, dets)"), 'doc_id')} AS f
      FROM det),
mdocs AS (SELECT doc_id, cache_hits, cache_misses, f.applied AS applied,
  list_transform(list_filter(f.applied, lambda a: a.action = 'encrypt'), lambda a: a.span) AS encrypted FROM mk)""",
  critic_raw_sql(), validation_sql("mdocs")) + f"""
SELECT count(*) AS total_sentences, sum(len(m.applied)) AS total_spans,
  sum(len(list_filter(m.applied, lambda a: a.action = 'encrypt'))) AS total_encrypted,
  sum(len(list_filter(m.applied, lambda a: a.action = 'abstract'))) AS total_abstracted,
  sum(m.cache_hits) AS total_cache_hits, sum(m.cache_misses) AS total_cache_misses,
  {R('sum(v.total_reward)')} AS total_reward, sum(len(v.leaked_spans)) AS missed_phi_count
FROM mdocs m LEFT JOIN valr v USING (doc_id)"""

SQL["span_feedback"] = with_ctes(NOTES, COLD, CRITIC_DOCS, critic_raw_sql(), validation_sql("cdocs"), f"""
sp AS (SELECT c.doc_id, c.applied[i] AS a, v.leaked_spans, v.over_encrypted
       FROM cold c JOIN valr v USING (doc_id), range(1, len(c.applied) + 1) t(i)),
fb AS (SELECT a.label AS label, NOT coalesce(list_contains(leaked_spans, a.span), false)
              AND NOT coalesce(list_contains(over_encrypted, a.span), false) AS correct
       FROM sp WHERE a.label IS NOT NULL AND a.label <> ''),
agg AS (SELECT label, count_if(correct) AS h, count_if(NOT correct) AS m FROM fb GROUP BY label),
seeds(label) AS (VALUES {", ".join("(" + q(lbl) + ")" for lbl, _r, _t, _o in C.SEED_PATTERNS)})""") + f"""
SELECT s.label, 48 + coalesce(h, 0) AS hits, 2 + coalesce(m, 0) AS misses,
  {R('CASE WHEN h IS NULL THEN 0.96::DOUBLE ELSE (48 + h)::DOUBLE / (50 + h + m) END')} AS confidence,
  true AS promoted
FROM seeds s LEFT JOIN agg USING (label)"""

SQL["system_fallback"] = with_ctes(NOTES, NER) + """
SELECT system, doc_id, masked, len(pred) AS n_pred, false AS fallback FROM ner WHERE doc_id % 5 <> 2
UNION ALL SELECT 'ner', doc_id, text, 0, true FROM notes WHERE doc_id % 5 = 2
UNION ALL SELECT 'absent_system', doc_id, text, 0, true FROM notes"""

# ====================================================================== one integer type on both sides
_BIGINT_COLS = {
    "pattern_offsets": ["start", "end"], "pattern_scan_notes": ["start", "end"], "mask_sequential": ["n_applied"],
    "label_map": ["start", "end"], "vault_import": ["version"], "overlap_metrics": ["leakage"],
    "per_type_exact": ["tp", "fp", "fn", "support"], "per_type_overlap": ["tp", "fp", "fn"],
    "micro_macro": ["tp", "fp", "fn"], "pattern_feedback": ["hits", "misses"], "pattern_promote": ["hits", "misses"],
    "pattern_prune_cap": ["hits", "misses"], "pattern_stats": ["promoted"], "seed_merge": ["pattern_seq"],
    "memory_growth": ["promoted"], "attack_rate": ["total_spans", "recovered_spans"],
    "run_counters": ["total_spans", "total_encrypted", "total_abstracted", "total_cache_hits",
                     "total_cache_misses", "missed_phi_count"],
    "span_feedback": ["hits", "misses"],
}
for _name, _cols in _BIGINT_COLS.items():
    _rep = ", ".join(f'CAST("{c}" AS BIGINT) AS "{c}"' for c in _cols)
    SQL[_name] = f"SELECT * REPLACE ({_rep}) FROM (\n{SQL[_name]}\n)"

_DOC_MASK = with_ctes(DOCS, f"""
scanned AS (SELECT doc_id, text, {hits_sql('text')} AS hits FROM docs),
folded AS (SELECT doc_id, text, ({mask_fold_sql('text', dedup_sql('hits'), 'doc_id')}).text AS masked FROM scanned)""")

SQL["utility"] = _DOC_MASK + f"SELECT doc_id, {R(utility_sql('text', 'masked'))} AS utility FROM folded"
SQL["quasi_risk"] = _DOC_MASK.rstrip() + f""",
ot AS (SELECT doc_id, unnest({tokens_sql('text')}) AS t FROM folded),
ms AS (SELECT DISTINCT doc_id, unnest({tokens_sql('masked')}) AS t FROM folded),
cnt AS (SELECT ot.doc_id, count(*) AS n_all, count(ms.t) AS n_in
        FROM ot LEFT JOIN ms ON ms.doc_id = ot.doc_id AND ms.t = ot.t GROUP BY ot.doc_id)
SELECT f.doc_id, {R('CASE WHEN coalesce(n_all, 0) = 0 THEN 0.0 ELSE n_in::DOUBLE / n_all END')} AS quasi_risk
FROM folded f LEFT JOIN cnt USING (doc_id)"""
SQL["exact_leakage"] = with_ctes(NOTES, COLD, REGEX, """
outputs AS (SELECT system, doc_id, phi_spans, masked FROM cold
            UNION ALL SELECT system, doc_id, phi_spans, masked FROM regex)""") + f"""
SELECT system, doc_id, CAST({leakage_sql('masked', 'list_transform(phi_spans, lambda s: s.span)')} AS BIGINT) AS leakage
FROM outputs"""

_WARM_MERGED = f"""
lh0 AS (SELECT n.doc_id, l.pattern_seq,
          list_transform(regexp_extract_all(n.text, l.regex), lambda m: {{'pattern_rank': 0, 'label': l.label, 'span': m,
            'phi_type': l.phi_type, 'abstraction_role': NULL::VARCHAR, 'promoted': false, 'confidence': 0.5::DOUBLE}}) AS hs
        FROM notes n, learned2 l),
lh AS (SELECT doc_id, flatten(list(hs ORDER BY pattern_seq)) AS lhits FROM lh0 GROUP BY doc_id),
wscan AS (SELECT n.doc_id, n.seq, n.text, n.phi_spans,
            list_concat({hits_sql('n.text')}, coalesce(lh.lhits, [])) AS hits
          FROM notes n LEFT JOIN lh USING (doc_id)),
warm AS (
  SELECT 'warm' AS system, doc_id, seq, text, phi_spans, f.text AS masked,
    list_transform(f.applied, lambda a: {{'span': a.span, 'phi_type': a.phi_type}}) AS pred, len(hits) AS cache_hits
  FROM (SELECT *, {mask_fold_sql('text', dedup_sql('hits'), 'doc_id')} AS f FROM wscan))"""

# the table as each note found it: a learned shape is there from the note after its first sighting on, at confidence 1
# (promoted, and then ahead of the seeds, from the note after its twentieth), and the doubted seed fires until its
# misses bring it below the threshold; two notes after they bring it below 0.4 it is gone, which changes nothing more
_WARM = f"""
sight AS (SELECT l.label, s.seq FROM shaped s JOIN learned2 l USING (phi_type, regex)),
known AS (SELECT n.doc_id, l.pattern_seq, l.label, l.regex, l.phi_type, min(s.seq) AS since, count(s.seq) AS seen
          FROM notes n, learned2 l JOIN sight s USING (label) WHERE s.seq < n.seq GROUP BY ALL),
lh0 AS (SELECT k.doc_id, k.since, k.pattern_seq, k.seen >= 20 AS ahead,
          list_transform(regexp_extract_all(n.text, k.regex), lambda m: {{'pattern_rank': 0, 'label': k.label, 'span': m,
            'phi_type': k.phi_type, 'abstraction_role': NULL::VARCHAR, 'promoted': k.seen >= 20, 'confidence': 1.0::DOUBLE}}) AS hs
        FROM notes n JOIN known k USING (doc_id)),
lh AS (SELECT doc_id, flatten(list(hs ORDER BY since, pattern_seq) FILTER (WHERE ahead)) AS lfirst,
         flatten(list(hs ORDER BY since, pattern_seq) FILTER (WHERE NOT ahead)) AS llast FROM lh0 GROUP BY doc_id),
doubt AS (SELECT doc_id, (count(*) OVER (ORDER BY seq) - 1) AS wrong FROM notes),
wscan AS (SELECT doc_id, seq, text, phi_spans, dets, list_concat(list_concat(list_concat(coalesce(lh.lfirst, []),
            list_filter(hits, lambda h: h.label <> {q(C.DOUBTED_SEED)} OR wrong = 0)),
            list_filter(hits, lambda h: h.label = {q(C.DOUBTED_SEED)} AND wrong > 0 AND 48::DOUBLE / (50 + wrong) >= 0.75)),
            coalesce(lh.llast, [])) AS hits
          FROM det JOIN doubt USING (doc_id) LEFT JOIN lh USING (doc_id)),
warm AS (
  SELECT 'warm' AS system, doc_id, seq, text, phi_spans, f.text AS masked,
    list_transform(f.applied, lambda a: {{'span': a.span, 'phi_type': a.phi_type}}) AS pred, len(hits) AS cache_hits,
    len(list_filter(dets, lambda d: NOT list_contains(list_transform(hits, lambda h: h.span), d.span))) AS cache_misses
  FROM (SELECT *, {mask_fold_sql('text', dedup_sql(f"list_concat({hit_spans_sql('hits')}, dets)"), 'doc_id')} AS f FROM wscan))"""

SQL["scale_windows"] = with_ctes(NOTES, COLD_FULL, LEARN, _WARM, """
outputs AS (SELECT system, doc_id, seq, text, phi_spans, masked, pred, cache_hits FROM cold
            UNION ALL SELECT system, doc_id, seq, text, phi_spans, masked, pred, cache_hits FROM warm)""", RECORDS, """
rl AS (SELECT r.*, coalesce(e.value, 0.0) AS latency_ms FROM records r LEFT JOIN events e ON e.event_id = r.doc_id),
rl2 AS (SELECT *, row_number() OVER (PARTITION BY system ORDER BY seq) - 1 AS place FROM rl),
w AS (SELECT system, place // 100 AS bucket, count(*) AS n, avg(f1) AS f1, avg(latency_ms) AS latency_ms,
        avg(CASE WHEN cache_hits > 0 THEN 1.0 ELSE 0.0 END) AS cache_hit_rate FROM rl2 GROUP BY ALL)""") + f"""
SELECT system, CAST((bucket + 1) * 100 AS BIGINT) AS step, {R('f1')} AS f1, {R('latency_ms')} AS latency_ms,
  {R('cache_hit_rate')} AS cache_hit_rate
FROM w WHERE n = 100"""

SQL["cold_warm_detection"] = with_ctes(NOTES, COLD_FULL, LEARN, _WARM, """
outputs AS (SELECT system, doc_id, seq, text, phi_spans, masked, pred, cache_hits, cache_misses FROM cold
            UNION ALL SELECT system, doc_id, seq, text, phi_spans, masked, pred, cache_hits, cache_misses FROM warm),
counted AS (SELECT system, CAST(sum(cache_hits) AS BIGINT) AS cache_hits, CAST(sum(cache_misses) AS BIGINT) AS cache_misses
            FROM outputs GROUP BY system)""",
                                       RECORDS) + f"""
SELECT system, {R('avg(precision)')} AS precision, {R('avg(recall)')} AS recall, {R('avg(f1)')} AS f1,
  CAST(sum(tp) AS BIGINT) AS tp, {R('avg(utility)')} AS utility, count(*) AS n,
  any_value(c.cache_hits) AS cache_hits, any_value(c.cache_misses) AS cache_misses
FROM records JOIN counted c USING (system) GROUP BY system"""

_LOADED = SQL["corpus_load"].split("\nSELECT doc_id, text, len(spans)")[0]


def _over(cte: str, source: str, mark: str) -> str:
    """The cold and regex tables of another source, under names of their own."""
    for name in ("scanned", "cold", "rx0", "rx1", "rx2", "regex"):
        cte = cte.replace(f"{name} AS (", f"{name}{mark} AS (").replace(f"FROM {name}", f"FROM {name}{mark}")
    return cte.replace("FROM notes", f"FROM {source}")


def _digits(source: str, dataset: str) -> str:
    masked = "regexp_replace(text, '[0-9]{3,}', '[REDACTED]', 'g')"
    pred = "list_transform(regexp_extract_all(text, '[0-9]{3,}'), lambda x: {'span': x, 'phi_type': 'UNKNOWN'})"
    return (f"SELECT '{dataset}/digits' AS system, doc_id, seq, text, phi_spans, {masked} AS masked, {pred} AS pred, 0 AS cache_hits FROM {source}\n"
            f"UNION ALL SELECT '{dataset}/absent', doc_id, seq, text, phi_spans, text, [], 0 FROM {source}")


_DATASETS = _LOADED + ",\n" + ",\n".join([
    "annot AS (SELECT doc_id, doc_id AS seq, text, spans AS phi_spans FROM ld2)", COLD.strip(), REGEX.strip(),
    _over(COLD.strip(), "annot", "_a"), _over(REGEX.strip(), "annot", "_a"), "outputs AS (" + " UNION ALL ".join(
        [f"SELECT '{d}/' || system AS system, doc_id, seq, text, phi_spans, masked, pred, cache_hits FROM {t}{m}"
         for d, m in (("notes", ""), ("annotated", "_a")) for t in ("cold", "regex")] + [_digits("notes", "notes"), _digits("annot", "annotated")]) + ")"])

SQL["benchmark_detection"] = _DATASETS + ",\n" + RECORDS.strip() + f"""
SELECT split_part(system, '/', 1) AS dataset, split_part(system, '/', 2) AS system, {R('avg(precision)')} AS precision,
  {R('avg(recall)')} AS recall, {R('avg(f1)')} AS f1, count(*) AS n, count_if(ends_with(system, '/absent')) AS n_fallback
FROM records GROUP BY records.system"""

SQL["benchmark_per_type"] = f"""SELECT split_part(system, '/', 1) AS dataset, * REPLACE (split_part(system, '/', 2) AS system,
  CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn) FROM (
{_DATASETS},
{_BY_TYPE.strip()} {_BY_TYPE_ROWS})"""

_WARM_PH = _WARM_MERGED.replace(
    "warm AS (", "warm_ph AS (").replace(
    mask_fold_sql('text', dedup_sql('hits'), 'doc_id'), mask_fold_sql('text', dedup_sql('hits'), 'doc_id', _PHRASE)).replace(
    "list_transform(f.applied, lambda a: {'span': a.span, 'phi_type': a.phi_type}) AS pred, len(hits) AS cache_hits",
    "f.applied AS applied")

_SEED_ROLES = ", ".join(f"({i}, {q(lbl)}, {q(t)}, {q(role)})" for i, (lbl, _rx, t, role) in enumerate(C.SEED_PATTERNS))

SQL["role_writeback"] = with_ctes(NOTES, DET, LEARN, _WARM_PH, f"""
seedr(i, label, phi_type, role) AS (VALUES {_SEED_ROLES}),
pats AS (SELECT label, phi_type, role FROM seedr
         UNION ALL SELECT label, phi_type, NULL::VARCHAR FROM learned2 WHERE label NOT IN (SELECT label FROM seedr)),
ph AS (SELECT w.seq, w.i, a.label AS label, a.replacement AS phrase
       FROM (SELECT seq, unnest(applied) AS a, unnest(range(len(applied))) AS i FROM warm_ph) w
       WHERE a.label IS NOT NULL AND a.action = 'abstract'
         AND a.label IN (SELECT label FROM pats WHERE role IS NULL)),
latest AS (SELECT label, arg_min(phrase, seq * 1000000 + i) AS new_role FROM ph GROUP BY label)""") + """
SELECT p.label, p.phi_type, coalesce(nullif(p.role, ''), l.new_role) AS abstraction_role
FROM pats p LEFT JOIN latest l USING (label)"""

SQL["negative_control"] = with_ctes(f"""
cv AS (SELECT (conv_id << 32) + turn AS doc_id, conv_id, turn, text, {hits_sql('text')} AS hits
       FROM conversations WHERE text IS NOT NULL),
f AS (SELECT conv_id, turn, text, len(hits) AS cache_hits, {mask_fold_sql('text', dedup_sql('hits'), 'doc_id')} AS f FROM cv)""") + """
SELECT conv_id, turn, cache_hits, len(f.applied) AS span_count,
  len(list_filter(f.applied, lambda a: a.action = 'encrypt')) AS encrypted_count,
  len(list_filter(f.applied, lambda a: a.action = 'abstract')) AS abstracted_count,
  f.text = text AS unchanged
FROM f"""
