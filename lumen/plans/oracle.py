"""DuckDB oracle SQL, one statement per registered query (same column names)."""

from __future__ import annotations

from lumen.functions.text import CLASSIFY_PROMPT, SYSTEM_PROMPT
from lumen.operators.probes import DEFAULT_CONDITIONS
from lumen.plans.oracle_fixtures import with_fixtures

STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _strip(x: str) -> str:
    return STRIP.format(x=x)


# Fixed values of the answer parser: its pattern and its two word lists.
FINAL_RE = r"final\s*answer\s*:\s*([^\n\r.;,]+)"
_POS = ["yes", "present", "positive", "consistent with", "suggests", "shows", "seen"]
_NEG = ["no", "absent", "negative", "not present", "no evidence", "unremarkable", "without"]


def _any(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


# Verdict as SQL over a relation with a lower-cased stripped text column ``t``.
VERDICT_SQL = f"""
CASE WHEN t = '' THEN -1
     WHEN has_final AND starts_with(ans, 'yes') THEN 1
     WHEN has_final AND starts_with(ans, 'no') THEN 0
     WHEN has_final AND ans IN ('a', '1', 'positive', 'present') THEN 1
     WHEN has_final AND ans IN ('b', '0', 'negative', 'absent') THEN 0
     WHEN contains(t, 'final answer') AND contains(split_part(t, 'final answer', -1), 'yes') THEN 1
     WHEN contains(t, 'final answer') AND contains(split_part(t, 'final answer', -1), 'no') THEN 0
     WHEN starts_with(t, 'yes') THEN 1
     WHEN starts_with(t, 'no') THEN 0
     WHEN {_any('t', _POS)} AND NOT {_any('t', _NEG)} THEN 1
     WHEN {_any('t', _NEG)} AND NOT {_any('t', _POS)} THEN 0
     ELSE -1 END"""

STAGE_SQL = f"""
CASE WHEN t = '' THEN 0
     WHEN has_final AND (starts_with(ans, 'yes') OR starts_with(ans, 'no')
          OR ans IN ('a', '1', 'positive', 'present', 'b', '0', 'negative', 'absent')) THEN 1
     WHEN contains(t, 'final answer') AND (contains(split_part(t, 'final answer', -1), 'yes')
          OR contains(split_part(t, 'final answer', -1), 'no')) THEN 2
     ELSE 3 END"""


def _verdict_cte(src: str = "v_verdicts") -> str:
    ans = _strip(f"regexp_replace({_strip(f"regexp_extract(t, '{FINAL_RE}', 1)")}, '[^a-z0-9\\s]', '', 'g')")
    return f"""
vt AS (SELECT *, lower({_strip("coalesce(raw, '')")}) AS t FROM {src}),
va AS (SELECT *, regexp_matches(t, '{FINAL_RE}') AS has_final, {ans} AS ans FROM vt),
vp AS (SELECT item_id, condition_id, gt, {VERDICT_SQL} AS verdict, {STAGE_SQL} AS stage FROM va)"""


_CONFUSION = """
CAST(count(*) FILTER (WHERE {k}) AS BIGINT) AS n_rows,
CAST(count(*) FILTER (WHERE {k} AND gt = 1 AND {p} = 1) AS BIGINT) AS tp,
CAST(count(*) FILTER (WHERE {k} AND gt <> 1 AND {p} = 1) AS BIGINT) AS fp,
CAST(count(*) FILTER (WHERE {k} AND gt = 1 AND {p} <> 1) AS BIGINT) AS fn,
CAST(count(*) FILTER (WHERE {k} AND gt = 1) AS BIGINT) AS gt_pos,
CAST(count(*) FILTER (WHERE {k} AND {p} = 1) AS BIGINT) AS pred_pos"""


def _f1(tp="tp", fp="fp", fn="fn") -> str:
    return f"CASE WHEN 2*{tp}+{fp}+{fn} = 0 THEN 0.0 ELSE 2.0*{tp} / (2*{tp}+{fp}+{fn}) END"


_POLICY_ROWS = f"""
amb AS (SELECT DISTINCT item_id FROM vp WHERE verdict = -1),
drop_rows AS (SELECT 'drop_ambiguous' AS policy, condition_id, gt, verdict AS pred FROM vp
              WHERE item_id NOT IN (SELECT item_id FROM amb)),
neg_rows AS (SELECT 'ambiguous_to_negative' AS policy, condition_id, gt,
                    CASE WHEN verdict = -1 THEN 0 ELSE verdict END AS pred FROM vp),
pol AS (SELECT * FROM drop_rows UNION ALL SELECT * FROM neg_rows),
pc AS (SELECT policy, condition_id, {_CONFUSION.format(k='TRUE', p='pred')} FROM pol GROUP BY policy, condition_id)"""


ORACLE_SQL: dict[str, str] = {
    "verdict_parse": with_fixtures(["v_verdicts"], f"""
WITH {_verdict_cte()}
SELECT item_id, condition_id, gt, verdict, stage FROM vp"""),

    "cls_f1": with_fixtures(["v_verdicts"], f"""
WITH {_verdict_cte()},
c AS (SELECT condition_id, {_CONFUSION.format(k='TRUE', p='(CASE WHEN verdict = -1 THEN 0 ELSE verdict END)')}
      FROM vp GROUP BY condition_id)
SELECT condition_id, n_rows, tp, fp, fn, gt_pos, pred_pos, round({_f1()}, 6) AS f1 FROM c"""),

    "cls_policies": with_fixtures(["v_verdicts"], f"""
WITH {_verdict_cte()}, {_POLICY_ROWS}
SELECT policy, condition_id, n_rows, tp, fp, fn, gt_pos, pred_pos, round({_f1()}, 6) AS f1
FROM pc WHERE n_rows > 0"""),

    "cls_macro_f1": with_fixtures(["v_verdicts"], f"""
WITH {_verdict_cte()}, {_POLICY_ROWS},
policies AS (SELECT * FROM (VALUES ('drop_ambiguous'), ('ambiguous_to_negative')) AS p(policy))
SELECT p.policy,
       round(coalesce(avg(CASE WHEN pc.n_rows > 0 THEN {_f1('pc.tp', 'pc.fp', 'pc.fn')} END), 0.0), 6) AS macro_f1,
       CAST(count(CASE WHEN pc.n_rows > 0 THEN 1 END) AS BIGINT) AS n_conditions,
       CAST(coalesce(max(pc.n_rows), 0) AS BIGINT) AS n_items
FROM policies p LEFT JOIN pc ON pc.policy = p.policy GROUP BY p.policy"""),
}


# ----------------------------------------------------------------- shared pieces


_S = _strip


def _studies_cte() -> str:
    return f"""
sn AS (SELECT study_id, subject_id, dicom_id, local_image_path,
              {_S("coalesce(findings, '')")} AS findings, {_S("coalesce(impression, '')")} AS impression,
              {_S("coalesce(indication, '')")} AS indication FROM v_studies),
sf AS (SELECT *, {_S("findings || ' ' || impression")} AS full_gt,
              CASE WHEN indication = '' THEN 'Chest x-ray' ELSE indication END || ' findings:' AS prompt
       FROM sn WHERE length(findings) > 0 OR length(impression) > 0)"""


_STUDY_COLS = "study_id, subject_id, dicom_id, local_image_path, findings, impression, indication, full_gt, prompt"

_PN = "TRY_CAST(NULLIF(regexp_extract(path, 'patient(\\d+)', 1), '') AS BIGINT)"
_SHORT_A = "NULLIF(regexp_extract(path, '(patient.*)', 1), '')"
_SHORT_B = "regexp_replace(path, '^(?:[^/]+/){2}', '')"

_CXR_CONDS = ["atelectasis", "cardiomegaly", "consolidation", "edema", "single_class"]


def _uz(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR isnan({x}) OR {x} = -1 THEN 0 ELSE CAST(trunc({x}) AS INTEGER) END"


def _unpivot_nulls(src: str, keys: str, conds) -> str:
    # DuckDB's UNPIVOT drops NULL values unless told otherwise.
    cols = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in conds)
    return (f"(SELECT {keys}, condition, raw_label, {_uz('raw_label')} AS y FROM "
            f"(SELECT {keys}, {cols} FROM {src}) "
            f"UNPIVOT INCLUDE NULLS (raw_label FOR condition IN ({', '.join(conds)})))")


def _auc_sql(src: str, group: str, label: str = "y", score: str = "score") -> str:
    """Exact tie-corrected AUC per group: one row per (group, distinct score)."""
    return f"""
ac AS (SELECT {group}, CAST({score} AS DOUBLE) AS s,
              count(*) FILTER (WHERE {label} = 1) AS p, count(*) FILTER (WHERE {label} = 0) AS q
       FROM {src} WHERE {score} IS NOT NULL GROUP BY ALL),
aw AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY {group} ORDER BY s
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cq FROM ac),
auc AS (SELECT {group}, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(q) AS BIGINT) AS n_neg,
               CASE WHEN sum(p) > 0 AND sum(q) > 0
                    THEN CAST(sum(p * (2 * cq + q)) AS DOUBLE) / (2.0 * sum(p) * sum(q)) END AS auc
        FROM aw GROUP BY {group})"""


_LABELS_B = f"lb AS (SELECT *, {_SHORT_B} AS path_short FROM v_cxr_labels)"
_JOIN_B = "v_cxr c JOIN lb l ON c.path_short = l.path_short"


def _probe_ctes() -> str:
    """Centroid probes over v_cxr: per-dim scaler, class means, folded scores."""
    return f"""
lab AS {_unpivot_nulls('v_cxr', 'vec_id', _CXR_CONDS)},
dims AS (SELECT e.vec_id, g.i, CAST(e.embedding[g.i] AS DOUBLE) AS x
         FROM v_cxr e JOIN (SELECT unnest(range(1, 1 + (SELECT max(len(embedding)) FROM v_cxr))) AS i) g
         ON g.i <= len(e.embedding)),
st AS (SELECT i, avg(x) AS mu, CASE WHEN stddev_pop(x) = 0 THEN 1.0 ELSE stddev_pop(x) END AS sc FROM dims GROUP BY i),
z AS (SELECT d.vec_id, d.i, (d.x - st.mu) / st.sc AS xs FROM dims d JOIN st USING (i)),
cent AS (SELECT l.condition, l.y, z.i, avg(z.xs) AS m, count(*) AS cnt FROM lab l JOIN z USING (vec_id)
         WHERE l.y IN (0, 1) GROUP BY l.condition, l.y, z.i),
wt AS (SELECT p.condition, p.i, p.m - n.m AS w, p.m + n.m AS mid, p.cnt + n.cnt AS n_train
       FROM cent p JOIN cent n ON p.condition = n.condition AND p.i = n.i AND p.y = 1 AND n.y = 0),
bias AS (SELECT condition, -0.5 * sum(w * mid) AS b, max(n_train) AS n_train FROM wt GROUP BY condition),
zz AS (SELECT z.vec_id, wt.condition, sum(z.xs * wt.w) AS dotp FROM z JOIN wt ON z.i = wt.i GROUP BY ALL),
probs AS (SELECT zz.vec_id, zz.condition, 1.0 / (1.0 + exp(-(zz.dotp + bias.b))) AS prob,
                 bias.condition || '_' || CAST(bias.n_train AS VARCHAR) AS model_name
          FROM zz JOIN bias USING (condition))"""


def _names_cte() -> str:
    return """
nm AS (SELECT model_id, model_name,
              coalesce(NULLIF(meta_condition, ''), regexp_replace(model_name, '_[^_]*$', '')) AS condition,
              coalesce(meta_size, CASE WHEN contains(model_name, '_')
                   THEN TRY_CAST(trim(regexp_extract(model_name, '_([^_]*)$', 1)) AS INTEGER) END) AS training_set_size
       FROM v_names)"""


_Q = CLASSIFY_PROMPT.replace("'", "''")
_CONDS_VALUES = ", ".join(f"('{c}')" for c in DEFAULT_CONDITIONS)
_CHAT_HEAD = ('[{"role":"system","content":[{"type":"text","text":"' + SYSTEM_PROMPT + '"}]},'
              '{"role":"user","content":[{"type":"image"},{"type":"text","text":')
_CHAT_TAIL = "}]}]"

_ITEMS = f"""
pi AS (SELECT doc_id, path, {_PN} AS patient_num, {_SHORT_A} AS path_short FROM v_paths),
it AS (SELECT * FROM pi WHERE patient_num BETWEEN 1 AND 8528),
fl AS (SELECT it.*, CASE WHEN l.path IS NULL THEN 'file_not_found' WHEN l.decodable = 0 THEN 'image_open_error' END AS reason
       FROM it LEFT JOIN v_listing l ON it.path = l.path),
ff AS (SELECT *, CASE WHEN reason IS NULL THEN 'ok' ELSE 'failed' END AS status FROM fl)"""

_PLAN = f"""
lg AS {_unpivot_nulls('v_cxr', 'vec_id', _CXR_CONDS)},
cnt AS (SELECT condition, count(*) AS n, count(*) FILTER (WHERE y = 1) AS c1, count(*) FILTER (WHERE y = 0) AS c0
        FROM lg GROUP BY condition),
req AS (SELECT * FROM (VALUES (64), (512), (4096)) r(s)),
valid AS (SELECT c.condition, c.n, CAST(r.s AS BIGINT) AS s FROM cnt c JOIN req r ON r.s > 0 AND r.s <= c.n),
lastv AS (SELECT condition, max(s) AS last FROM valid GROUP BY condition),
plan AS (SELECT condition, n, s FROM valid
         UNION ALL
         SELECT c.condition, c.n, c.n FROM cnt c LEFT JOIN lastv l USING (condition)
         WHERE l.last IS NULL OR (c.n >= l.last * 1.5 AND c.n <> l.last)),
pl AS (SELECT condition, n, CAST(row_number() OVER (PARTITION BY condition ORDER BY s) - 1 AS INTEGER) AS size_ordinal,
              s AS sample_size, s = n AS is_full FROM plan)"""

ORACLE_SQL.update({
    "studies_clean": with_fixtures(["v_studies"], f"WITH {_studies_cte()}\nSELECT {_STUDY_COLS} FROM sf"),
    "studies_first_n": with_fixtures(["v_studies"],
                                     f"WITH {_studies_cte()}\nSELECT {_STUDY_COLS} FROM sf ORDER BY study_id LIMIT 100"),
    "prompts_by_condition": with_fixtures(["v_studies"], f"""
WITH {_studies_cte()}
SELECT sf.study_id, c.condition,
       replace('{_Q}', '{{condition}}', lower(c.condition)) AS prompt
FROM sf CROSS JOIN (VALUES {_CONDS_VALUES}) AS c(condition)"""),
    "chat_messages": with_fixtures(["v_studies"], f"""
WITH {_studies_cte()}
SELECT study_id, 2 AS n_messages, '{_CHAT_HEAD}' || to_json(prompt) || '{_CHAT_TAIL}' AS chat_json,
       {_S("'<start_of_image>' || chr(10) || prompt")} AS plain_prompt
FROM sf"""),
    "gen_text_clean": with_fixtures(["v_pairs"], f"""
WITH g AS (SELECT sample_id,
  {_S(r"regexp_replace(coalesce(findings_gen, ''), '\*\*(Findings|Impression|Report):\*\*\s*', '', 'g')")} AS findings_gen,
  {_S(r"regexp_replace(coalesce(impression_gen, ''), '\*\*(Findings|Impression|Report):\*\*\s*', '', 'g')")} AS impression_gen,
  {_S("coalesce(findings_gt, '')")} AS findings_gt, {_S("coalesce(impression_gt, '')")} AS impression_gt FROM v_pairs)
SELECT *, {_S("findings_gen || ' ' || impression_gen")} AS full_gen, {_S("findings_gt || ' ' || impression_gt")} AS full_gt
FROM g"""),
    "path_keys": with_fixtures(["v_paths"], f"""
SELECT doc_id, path, {_PN} AS patient_num, {_SHORT_A} AS path_short, {_SHORT_B} AS path_short_b,
       CASE WHEN starts_with(path, '/') THEN path ELSE '/data/images/' || path END AS resolved_path
FROM v_paths"""),
    "patient_range": with_fixtures(["v_paths"], f"""
WITH p AS (SELECT {_PN} AS patient_num FROM v_paths)
SELECT 1 AS lower, 150 AS upper,
       count(*) FILTER (WHERE patient_num BETWEEN 1 AND 150) AS n_rows_in_range,
       count(DISTINCT patient_num) FILTER (WHERE patient_num BETWEEN 1 AND 150) AS n_patients_in_range,
       count(*) AS n_rows_total, count(DISTINCT patient_num) AS n_patients_total
FROM p"""),
    "file_failures": with_fixtures(["v_paths", "v_listing"], f"""
WITH {_ITEMS}
SELECT doc_id, path, patient_num, path_short, status, reason FROM ff"""),
    "failure_manifest": with_fixtures(["v_paths", "v_listing"], f"""
WITH {_ITEMS}
SELECT status, reason, count(*) AS n_images, count(DISTINCT patient_num) AS n_patients FROM ff GROUP BY status, reason"""),
    "u_zero_labels": with_fixtures(["v_cxr"], f"""
WITH l AS {_unpivot_nulls('v_cxr', 'vec_id', _CXR_CONDS)},
a AS (SELECT condition, count(*) AS n_rows, count(*) FILTER (WHERE y = 1) AS n_pos,
             count(*) FILTER (WHERE y = 0) AS n_neg, count(*) FILTER (WHERE raw_label IS NULL) AS n_raw_null,
             count(*) FILTER (WHERE raw_label = -1) AS n_raw_uncertain FROM l GROUP BY condition)
SELECT *, CASE WHEN n_pos > 0 THEN n_pos >= 2 AND (n_neg >= 2 OR n_neg = 0) ELSE FALSE END AS can_stratify FROM a"""),
    "best_key_join": with_fixtures(["v_cxr", "v_cxr_labels"], f"""
WITH {_LABELS_B}
SELECT c.vec_id, c.path, c.path_short, l.path AS path_label, c.atelectasis, l.atelectasis AS atelectasis_label,
       l.only_in_labels, 'path_short' AS embedding_join_key, count(*) OVER () AS matched_rows
FROM {_JOIN_B}"""),
    "best_key_counts": with_fixtures(["v_cxr", "v_cxr_labels"], f"""
WITH {_LABELS_B}
SELECT 0 AS ordinal, 'path' AS embedding_join_key, 'path' AS label_join_key, count(*) AS matched_rows
FROM v_cxr c JOIN lb l ON c.path IS NOT DISTINCT FROM l.path
UNION ALL
SELECT 2, 'path_short', 'path_short', count(*) FROM {_JOIN_B}"""),
    "hot_key_join": """
WITH l AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'p/hot' WHEN event_id % 7 = 1 THEN NULL
                                 ELSE 'p/' || CAST(user_id AS VARCHAR) END AS path FROM events),
r AS (SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN 'p/hot' WHEN c_custkey % 200 = 1 THEN NULL
                             ELSE 'p/' || CAST(c_custkey AS VARCHAR) END AS path FROM customer),
j AS (SELECT l.path, event_id, c_custkey FROM l JOIN r ON l.path IS NOT DISTINCT FROM r.path)
SELECT path, count(*) AS n_rows, CAST(sum(event_id) AS BIGINT) AS sum_event, CAST(sum(c_custkey) AS BIGINT) AS sum_customer,
       (SELECT count(*) FROM j) AS matched_rows, (SELECT count(*) FROM j WHERE path IS NULL) AS null_key_rows
FROM j GROUP BY path""",
    "auc_exact": with_fixtures(["v_scores"], f"""
WITH {_auc_sql('v_scores', 'model_id')}
SELECT model_id, n_pos, n_neg, round(auc, 6) AS auc FROM auc"""),
    "target_sizes": with_fixtures(["v_cxr"], f"""
WITH {_PLAN}
SELECT condition, n, size_ordinal, sample_size, is_full FROM pl"""),
    "stratified_sample_counts": with_fixtures(["v_cxr"], f"""
WITH {_PLAN},
q AS (SELECT pl.condition, pl.sample_size, cnt.n, cnt.c1, cnt.c0,
             cnt.c1 >= 2 AND (cnt.c0 >= 2 OR cnt.c0 = 0) AND cnt.c1 > 0 AS strat,
             (pl.sample_size * cnt.c1) // cnt.n AS f1, (pl.sample_size * cnt.c0) // cnt.n AS f0,
             (pl.sample_size * cnt.c1) % cnt.n AS r1, (pl.sample_size * cnt.c0) % cnt.n AS r0
      FROM pl JOIN cnt USING (condition)),
qq AS (SELECT *, sample_size - f1 - f0 AS deficit,
              CASE WHEN r1 > r0 OR (r1 = r0 AND c1 > c0) THEN 1 ELSE 0 END AS first_is_pos FROM q)
SELECT condition, sample_size, sample_size AS n_sampled,
       CAST(CASE WHEN strat THEN f1 + CASE WHEN deficit >= 1 AND first_is_pos = 1 THEN 1
                                           WHEN deficit >= 2 THEN 1 ELSE 0 END
                 WHEN c1 = 0 THEN 0 WHEN c0 = 0 THEN sample_size END AS BIGINT) AS n_pos,
       CAST(CASE WHEN strat THEN f0 + CASE WHEN deficit >= 1 AND first_is_pos = 0 THEN 1
                                           WHEN deficit >= 2 THEN 1 ELSE 0 END
                 WHEN c1 = 0 THEN sample_size WHEN c0 = 0 THEN 0 END AS BIGINT) AS n_neg,
       sample_size AS n_distinct
FROM qq"""),
    "probe_grid": with_fixtures(["v_cxr", "v_cxr_labels"], f"""
WITH {_PLAN}, {_LABELS_B},
jn AS (SELECT c.vec_id, c.atelectasis, c.cardiomegaly, c.consolidation, c.edema, c.single_class FROM {_JOIN_B}),
vl AS (SELECT condition, count(*) FILTER (WHERE y = 1) AS n_val_pos, count(*) FILTER (WHERE y = 0) AS n_val_neg
       FROM {_unpivot_nulls('jn', 'vec_id', _CXR_CONDS)} GROUP BY condition),
q AS (SELECT pl.*, c1, c0, c1 >= 2 AND (c0 >= 2 OR c0 = 0) AS strat,
             (sample_size * c1) // cnt.n AS f1, (sample_size * c0) // cnt.n AS f0,
             (sample_size * c1) % cnt.n AS r1, (sample_size * c0) % cnt.n AS r0
      FROM pl JOIN cnt USING (condition)),
s AS (SELECT *, CASE WHEN strat AND sample_size - f1 - f0 >= 1 AND (r1 > r0 OR (r1 = r0 AND c1 > c0)) THEN f1 + 1
                     WHEN strat THEN f1 WHEN c1 = 0 THEN 0 END AS n_pos FROM q),
cells AS (SELECT condition, size_ordinal, sample_size, s.n AS n_available, CAST(n_pos AS BIGINT) AS n_pos,
                 CAST(sample_size - n_pos AS BIGINT) AS n_neg, n_val_pos, n_val_neg,
                 CASE WHEN n_pos = 0 OR n_pos = sample_size THEN 'skipped_one_class'
                      WHEN n_val_pos = 0 OR n_val_neg = 0 THEN 'skipped_auc_undefined' ELSE 'ok' END AS status
          FROM s LEFT JOIN vl USING (condition))
SELECT * FROM cells
UNION ALL
SELECT 'pneumonia', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'skipped_missing_condition_column'"""),
    "scaler_stats": """
WITH g AS (SELECT unnest(range(1, 1 + (SELECT max(len(embedding)) FROM embeddings))) AS i)
SELECT CAST(g.i - 1 AS INTEGER) AS dim, round(avg(CAST(e.embedding[g.i] AS DOUBLE)), 6) AS mean,
       round(stddev_pop(CAST(e.embedding[g.i] AS DOUBLE)), 6) AS std
FROM embeddings e JOIN g ON g.i <= len(e.embedding) GROUP BY g.i""",
    "l2_norms": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3.0) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nb FROM v),
u AS (SELECT vec_id, nb, list_transform(v, lambda x: x / greatest(nb, 1e-12)) AS u FROM n)
SELECT vec_id, round(nb, 6) AS norm_before, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) AS norm_after,
       round(u[1], 6) AS u_first FROM u""",
    "wide_long": """
SELECT vec_id, embedding[1] AS emb_0000, embedding[64] AS emb_0063, CAST(len(embedding) AS INTEGER) AS n_dims,
       round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS emb_sum FROM embeddings""",
    "probe_score": with_fixtures(["v_cxr"], f"""
WITH {_probe_ctes()}
SELECT p.vec_id, p.condition, l.y, round(p.prob, 6) AS prob FROM probs p JOIN lab l USING (vec_id, condition)"""),
    "probe_eval": with_fixtures(["v_cxr", "v_cxr_labels"], f"""
WITH {_probe_ctes()}, {_LABELS_B},
ev AS (SELECT c.vec_id FROM {_JOIN_B}),
sc AS (SELECT p.model_name, p.condition, l.y, p.prob FROM ev JOIN probs p USING (vec_id) JOIN lab l USING (vec_id, condition)),
{_auc_sql('sc', 'model_name, condition', 'y', 'prob')},
cnt AS (SELECT model_name, count(*) AS num_test_samples FROM sc GROUP BY model_name)
SELECT a.model_name, a.condition, round(a.auc, 6) AS auc, c.num_test_samples,
       a.n_pos AS num_positive_test_samples, a.n_neg AS num_negative_test_samples,
       CASE WHEN a.auc IS NULL THEN 'auc_undefined_single_class' ELSE 'ok' END AS status
FROM auc a JOIN cnt c USING (model_name)"""),
    "model_name_parse": with_fixtures(["v_names"], f"""
WITH {_names_cte()}
SELECT model_id, model_name, condition, training_set_size FROM nm"""),
    "probe_eval_status": with_fixtures(["v_names", "v_cxr", "v_cxr_labels"], f"""
WITH {_names_cte()}, {_LABELS_B},
jn AS (SELECT c.vec_id, c.atelectasis, c.cardiomegaly, c.consolidation, c.edema, c.single_class,
              l.atelectasis AS atelectasis_label, l.only_in_labels FROM {_JOIN_B}),
tl AS {_unpivot_nulls('jn', 'vec_id', _CXR_CONDS + ['atelectasis_label', 'only_in_labels'])},
tc AS (SELECT condition, count(*) AS n, count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg
       FROM tl GROUP BY condition)
SELECT nm.model_id, nm.model_name, nm.condition, nm.training_set_size,
       CASE WHEN tc.n IS NULL THEN 'skipped_missing_condition_column' ELSE 'ok' END AS status,
       CAST(coalesce(tc.n, 0) AS BIGINT) AS num_test_samples,
       tc.n_pos AS num_positive_test_samples, tc.n_neg AS num_negative_test_samples
FROM nm LEFT JOIN tc USING (condition)"""),
    "best_c": with_fixtures(["v_grid_scores"], f"""
WITH {_auc_sql('v_grid_scores', 'model_id, c_ordinal, c')},
r AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY auc DESC, c_ordinal) AS rn
      FROM auc WHERE auc IS NOT NULL AND NOT isnan(auc))
SELECT model_id, c_ordinal, c, round(auc, 6) AS val_auc FROM r WHERE rn = 1"""),
    "set_f1": with_fixtures(["v_entities"], """
WITH e AS (SELECT sample_id, side = 'hyp' AS h, token, label, relation FROM v_entities),
k AS (SELECT sample_id, h, 'simple' AS level, token || '|' || label AS key FROM e
      UNION ALL SELECT sample_id, h, 'partial', token || '|' || label || '|' || CAST(relation IS NOT NULL AS VARCHAR) FROM e
      UNION ALL SELECT sample_id, h, 'complete', token || '|' || label || '|' || coalesce(relation, '<none>') FROM e),
fl AS (SELECT sample_id, level, key, max(CAST(h AS INTEGER)) AS inh, max(CAST(NOT h AS INTEGER)) AS inr
       FROM k GROUP BY ALL),
sz AS (SELECT sample_id, level, sum(inh) AS nh, sum(inr) AS nr, sum(inh * inr) AS nb FROM fl GROUP BY ALL),
f AS (SELECT level, CASE WHEN nh = 0 OR nr = 0 THEN 0.0 ELSE 2.0 * nb / (nh + nr) END AS f1 FROM sz)
SELECT level, CASE level WHEN 'simple' THEN 'rg_e' WHEN 'partial' THEN 'rg_er' ELSE 'rg_er_bar' END AS metric,
       count(*) AS n_samples, round(avg(f1), 6) AS mean_f1 FROM f GROUP BY level"""),
    "embed_retry": """
WITH v AS (SELECT doc_id, list_transform(range(1, 9), lambda j: CAST((doc_id * j) % 13 AS DOUBLE)) AS v FROM documents),
n AS (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nv FROM v)
SELECT doc_id, CASE WHEN doc_id % 23 = 0 THEN 'failed' ELSE 'ok' END AS status,
       CASE WHEN doc_id % 23 = 0 THEN 'embedding_error' END AS reason,
       CASE WHEN doc_id % 23 <> 0 THEN CAST(list_transform(v, lambda x: x / greatest(nv, 1e-12)) AS FLOAT[]) END AS embedding
FROM n""",
    "generate_stub": with_fixtures(["v_studies"], f"""
WITH {_studies_cte()}
SELECT study_id, prompt,
       CASE WHEN (length(prompt) + study_id) % 2 = 0 THEN 'Final Answer: Yes' ELSE 'Final Answer: No' END AS generated,
       CASE WHEN (length(prompt) + study_id) % 2 = 0 THEN 1 ELSE 0 END AS verdict
FROM sf"""),
    "upsert_evaluation": """
SELECT d.doc_id AS run_id, d.source AS task, l.quality, l.toxic
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
})
ORACLE_SQL["auc_bucketed"] = ORACLE_SQL["auc_exact"]


_CLS4 = ["atelectasis", "cardiomegaly", "consolidation", "edema"]

ORACLE_SQL.update({
    "report_scores": with_fixtures(["v_pairs"], f"""
WITH g AS (SELECT sample_id,
  {_S(r"regexp_replace(coalesce(findings_gen, ''), '\*\*(Findings|Impression|Report):\*\*\s*', '', 'g')")} AS fg,
  {_S(r"regexp_replace(coalesce(impression_gen, ''), '\*\*(Findings|Impression|Report):\*\*\s*', '', 'g')")} AS ig,
  {_S("coalesce(findings_gt, '')")} AS fr, {_S("coalesce(impression_gt, '')")} AS ir FROM v_pairs),
t AS (SELECT sample_id, 'findings' AS section, 'hyp' AS side, fg AS text FROM g
      UNION ALL SELECT sample_id, 'findings', 'ref', fr FROM g
      UNION ALL SELECT sample_id, 'impression', 'hyp', ig FROM g
      UNION ALL SELECT sample_id, 'impression', 'ref', ir FROM g
      UNION ALL SELECT sample_id, 'full_report', 'hyp', {_S("fg || ' ' || ig")} FROM g
      UNION ALL SELECT sample_id, 'full_report', 'ref', {_S("fr || ' ' || ir")} FROM g),
tok AS (SELECT sample_id, section, side, unnest(string_split_regex(text, '\\s+')) AS token FROM t),
e AS (SELECT DISTINCT sample_id, section, side = 'hyp' AS h,
             token || '|' || CASE WHEN length(token) % 2 = 0 THEN 'EVEN' ELSE 'ODD' END AS key
      FROM tok WHERE token <> ''),
fl AS (SELECT section, sample_id, key, max(CAST(h AS INTEGER)) AS inh, max(CAST(NOT h AS INTEGER)) AS inr
       FROM e GROUP BY ALL),
sz AS (SELECT section, sample_id, sum(inh) AS nh, sum(inr) AS nr, sum(inh * inr) AS nb FROM fl GROUP BY ALL),
s AS (SELECT DISTINCT section, sample_id FROM t),
f AS (SELECT s.section, CASE WHEN coalesce(nh, 0) = 0 OR coalesce(nr, 0) = 0 THEN 0.0
                             ELSE 2.0 * nb / (nh + nr) END AS f1
      FROM s LEFT JOIN sz USING (section, sample_id)),
lv AS (SELECT * FROM (VALUES ('simple', 'rg_e'), ('partial', 'rg_er'), ('complete', 'rg_er_bar')) AS l(level, metric))
SELECT f.section, lv.level, lv.metric, count(*) AS n_samples, round(avg(f1), 6) AS mean_f1
FROM f CROSS JOIN lv GROUP BY f.section, lv.level, lv.metric"""),
    "cls_end_to_end": with_fixtures(["v_cxr"], f"""
WITH c AS (SELECT v.vec_id, k.condition_id, k.condition,
                  {_uz("CASE k.condition_id " + " ".join(f"WHEN {i} THEN v.{c}" for i, c in enumerate(_CLS4)) + " END")} AS gt,
                  replace('{_Q}', '{{condition}}', k.condition) AS prompt
           FROM v_cxr v CROSS JOIN (VALUES {", ".join(f"({i}, '{c}')" for i, c in enumerate(_CLS4))}) AS k(condition_id, condition)),
vp AS (SELECT vec_id AS item_id, condition_id, gt,
              CASE (length(prompt) + vec_id) % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE -1 END AS verdict FROM c),
{_POLICY_ROWS}
SELECT policy, condition_id, n_rows, tp, fp, fn, gt_pos, pred_pos, round({_f1()}, 6) AS f1
FROM pc WHERE n_rows > 0"""),
})


_EXACT = """SELECT event_id, CAST(s * CASE WHEN v = 0 THEN 0 ELSE (q + CASE WHEN 2 * r > u OR (2 * r = u AND q % 2 = 1) THEN 1 ELSE 0 END) / 100.0 END AS DOUBLE) AS v
FROM (SELECT *, (m * 100) // u AS q, (m * 100) % u AS r FROM (SELECT event_id, v, s, CAST(v * pow(2, k) AS HUGEINT) AS m, CAST(pow(2, k) AS HUGEINT) AS u
FROM (SELECT event_id, v, s, 54 - CAST(floor(log2(CASE WHEN v = 0 THEN 1 ELSE v END)) AS INTEGER) AS k FROM ({src}))))"""
_X16 = "SELECT event_id, CAST(event_id % 2000 AS DOUBLE) / 16.0 AS v, 1 AS s FROM events"
_Y5 = "SELECT event_id, CAST((event_id % 5000) * 5 AS DOUBLE) / 1000.0 AS v, {s} AS s FROM events"
_ANSWER = "CASE ({n}) % 3 WHEN 0 THEN 'Final Answer: Yes' WHEN 1 THEN 'Final Answer: No' ELSE 'Unclear.' END"
_CLS_ROWS = f"""c AS (SELECT v.vec_id, v.path, k.condition_id, k.condition,
    {_uz("CASE k.condition_id " + " ".join(f"WHEN {i} THEN v.{c}" for i, c in enumerate(_CLS4)) + " END")} AS gt,
    length(replace('{_Q}', '{{condition}}', k.condition)) + v.vec_id AS n
  FROM v_cxr v CROSS JOIN (VALUES {", ".join(f"({i}, '{c}')" for i, c in enumerate(_CLS4))}) AS k(condition_id, condition))"""

ORACLE_SQL.update({
    "report_images": with_fixtures(["v_studies"], f"""
WITH {_studies_cte()},
im AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE octet_length(encode(text)) END AS n FROM documents WHERE doc_id % 4 <> 3),
s AS (SELECT sf.study_id, '/img/' || CAST(sf.study_id AS VARCHAR) || '.jpg' AS local_image_path, sf.indication, sf.prompt, im.n,
             CASE WHEN im.n IS NULL THEN 'file_not_found' WHEN im.n = 0 THEN 'image_open_error'
                  WHEN im.n % 17 = 0 THEN 'generation_error' END AS reason
      FROM sf LEFT JOIN im ON im.doc_id = sf.study_id)
SELECT study_id, local_image_path, indication, prompt AS prompt_used,
       CASE WHEN reason IS NULL THEN CASE WHEN (length(prompt) + n) % 2 = 0 THEN 'Final Answer: Yes' ELSE 'Final Answer: No' END END AS full_gen,
       CASE WHEN reason IS NULL THEN 'ok' ELSE 'failed' END AS status, reason FROM s"""),
    "cls_images": with_fixtures(["v_cxr"], f"""
WITH {_CLS_ROWS},
g AS (SELECT *, CASE WHEN vec_id % 9 = 4 THEN 'file_not_found' WHEN vec_id % 8 = 0 THEN 'image_open_error' END AS reason FROM c)
SELECT path, length(CAST(vec_id AS VARCHAR)) || 'x1' AS image_size, 'ok' AS status, reason, condition, gt,
       CASE n % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE -1 END AS pred, {_ANSWER.format(n='n')} AS raw FROM g WHERE reason IS NULL
UNION ALL
SELECT path, NULL, 'failed', reason, NULL, NULL, NULL, NULL FROM g WHERE reason IS NOT NULL AND condition_id = 0"""),
    "cls_first_rows": with_fixtures(["v_cxr"], f"""
SELECT vec_id, path, {", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in _CLS4)} FROM v_cxr ORDER BY vec_id LIMIT 120"""),
    "report_run": with_fixtures(["v_studies"], f"""
WITH {_studies_cte()},
t AS (SELECT study_id, 'ref' AS side, full_gt AS text FROM sf
      UNION ALL SELECT study_id, 'hyp', CASE WHEN (length(prompt) + study_id) % 2 = 0 THEN 'Final Answer: Yes' ELSE 'Final Answer: No' END FROM sf),
k AS (SELECT DISTINCT study_id, side, unnest(string_split_regex(text, '\\s+')) AS token FROM t),
fl AS (SELECT study_id, token, max(CAST(side = 'hyp' AS INTEGER)) AS h, max(CAST(side = 'ref' AS INTEGER)) AS r FROM k WHERE token <> '' GROUP BY ALL),
sz AS (SELECT study_id, sum(h) AS nh, sum(r) AS nr, sum(h * r) AS nb FROM fl GROUP BY ALL),
f AS (SELECT CASE WHEN coalesce(nh, 0) = 0 OR coalesce(nr, 0) = 0 THEN 0.0 ELSE 2.0 * nb / (nh + nr) END AS f1 FROM sf LEFT JOIN sz USING (study_id)),
lv AS (SELECT * FROM (VALUES ('simple', 'rg_e'), ('partial', 'rg_er'), ('complete', 'rg_er_bar')) AS l(level, metric))
SELECT 'full_report' AS section, level, metric, count(*) AS n_samples, round(avg(f1), 6) AS mean_f1,
       count(*) AS rows_written, count(*) AS rows_ok FROM f CROSS JOIN lv GROUP BY level, metric"""),
    "cls_run": with_fixtures(["v_cxr"], f"""
WITH {_CLS_ROWS},
vp AS (SELECT vec_id AS item_id, condition_id, gt, CASE n % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE -1 END AS verdict FROM c),
{_POLICY_ROWS},
f AS (SELECT policy, condition_id, n_rows, {_f1()} AS f1 FROM pc WHERE n_rows > 0),
m AS (SELECT policy, avg(f1) AS macro_f1 FROM f GROUP BY policy),
t AS (SELECT count(DISTINCT item_id) AS n FROM vp),
a AS (SELECT count(*) AS n FROM (SELECT item_id FROM vp GROUP BY item_id HAVING min(verdict) > -1))
SELECT f.policy, k.condition, t.n AS n_total_rows, a.n AS n_rows_no_ambiguous, t.n AS rows_written, round(f1, 6) AS f1, round(macro_f1, 6) AS macro_f1
FROM f JOIN m USING (policy) JOIN (SELECT DISTINCT condition_id, condition FROM c) k USING (condition_id), t, a"""),
    "models_with_metadata": with_fixtures(["v_cxr"], f"""
WITH l AS {_unpivot_nulls('v_cxr', 'vec_id', _CXR_CONDS)},
n AS (SELECT condition AS c, count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg FROM l GROUP BY condition)
SELECT c || '_' || CAST(n_pos + n_neg AS VARCHAR) AS model_name, CASE WHEN c = 'edema' THEN 'Edema' ELSE c END AS condition,
       CAST(CASE WHEN c IN ('atelectasis', 'edema') THEN 64 ELSE n_pos + n_neg END AS INTEGER) AS training_set_size,
       CAST(CASE WHEN c IN ('atelectasis', 'edema') THEN 0.1 END AS DOUBLE) AS best_hyperparameter_C, n_pos, n_neg
FROM n WHERE n_pos > 0 AND n_neg > 0"""),
    "python_rounding": f"""
SELECT a.event_id, a.v AS x, b.v AS y, c.v AS minus_y FROM ({_EXACT.format(src=_X16)}) a
JOIN ({_EXACT.format(src=_Y5.format(s=1))}) b USING (event_id) JOIN ({_EXACT.format(src=_Y5.format(s=-1))}) c USING (event_id)""",
})
