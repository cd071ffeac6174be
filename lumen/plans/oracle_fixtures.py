"""DuckDB text of the fixture views (mirrors ``lumen.plans.fixtures``) for the SQL oracle."""

from __future__ import annotations

FIXTURE_SQL: dict[str, str] = {
    "v_studies": r"""
SELECT doc_id AS study_id, doc_id % 97 AS subject_id,
       'd' || CAST(doc_id AS VARCHAR) AS dicom_id,
       '/img/' || CAST(doc_id AS VARCHAR) || '.jpg' AS local_image_path,
       CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN '   '
            ELSE chr(9) || source || ' shows ' || lang || chr(10) END AS findings,
       CASE WHEN doc_id % 3 = 0 THEN NULL ELSE ' chars ' || CAST(n_chars AS VARCHAR) || ' ' END AS impression,
       CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 9 = 0 THEN '  '
            ELSE 'Evaluate ' || source END AS indication
FROM documents""",
    "v_paths": r"""
SELECT doc_id,
       CASE WHEN doc_id % 8 = 1 THEN 'valid/patient' || CAST(1 + doc_id % 200 AS VARCHAR) || '/study1/v.jpg'
            WHEN doc_id % 8 = 2 THEN 'a/b/nothing.jpg'
            WHEN doc_id % 8 = 3 THEN 'patients/patient' || lpad(CAST(1 + doc_id % 200 AS VARCHAR), 5, '0') || '/s/v.jpg'
            WHEN doc_id % 8 = 4 THEN NULL
            ELSE 'Set-v1.0/valid/patient' || lpad(CAST(1 + doc_id % 200 AS VARCHAR), 5, '0')
                 || '/study' || CAST(1 + doc_id % 3 AS VARCHAR) || '/view' || CAST(doc_id AS VARCHAR) || '.jpg'
       END AS path
FROM documents""",
    "v_listing": r"""
SELECT DISTINCT path, CASE WHEN doc_id % 17 = 0 THEN 0 ELSE 1 END AS decodable
FROM v_paths WHERE path IS NOT NULL AND doc_id % 8 >= 5 AND doc_id % 10 <> 3""",
    "v_cxr": r"""
SELECT vec_id, embedding,
       'Set-v1.0/valid/patient' || lpad(CAST(vec_id AS VARCHAR), 5, '0') || '/study1/v.jpg' AS path,
       'patient' || lpad(CAST(vec_id AS VARCHAR), 5, '0') || '/study1/v.jpg' AS path_short,
       CAST(CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 13 = 0 THEN -1 WHEN label = 0 THEN 1 ELSE 0 END AS DOUBLE) AS atelectasis,
       CAST(CASE WHEN vec_id % 11 = 1 THEN NULL WHEN vec_id % 13 = 1 THEN -1 WHEN label = 1 THEN 1 ELSE 0 END AS DOUBLE) AS cardiomegaly,
       CAST(CASE WHEN vec_id % 11 = 2 THEN NULL WHEN vec_id % 13 = 2 THEN -1 WHEN label = 2 THEN 1 ELSE 0 END AS DOUBLE) AS consolidation,
       CAST(CASE WHEN vec_id % 11 = 3 THEN NULL WHEN vec_id % 13 = 3 THEN -1 WHEN label = 3 THEN 1 ELSE 0 END AS DOUBLE) AS edema,
       CAST(0 AS DOUBLE) AS single_class
FROM embeddings""",
    "v_cxr_labels": r"""
SELECT CASE WHEN vec_id % 10 = 0 THEN 'Set-test/other/unmatched' WHEN vec_id % 2 = 0 THEN 'Set-v1.0' ELSE 'Set-small' END
         || '/valid/patient' || lpad(CAST(vec_id AS VARCHAR), 5, '0') || '/study1/v.jpg' AS path,
       CAST(vec_id % 2 AS DOUBLE) AS atelectasis, CAST(vec_id % 3 AS DOUBLE) AS only_in_labels
FROM embeddings
UNION ALL
SELECT 'Set-small/valid/patient' || lpad(CAST(vec_id AS VARCHAR), 5, '0') || '/study1/v.jpg' AS path,
       CAST(1 AS DOUBLE) AS atelectasis, CAST(0 AS DOUBLE) AS only_in_labels
FROM embeddings WHERE vec_id % 50 = 1""",
    "v_scores": r"""
SELECT m.k AS model_id, e.vec_id, CASE WHEN e.label = m.k THEN 1 ELSE 0 END AS y,
       CAST(floor(CAST(e.embedding[1 + m.k] AS DOUBLE) * 100) AS INTEGER) AS score
FROM embeddings e CROSS JOIN (VALUES (0), (1), (2), (3), (4), (10)) AS m(k)""",
    "v_grid_scores": r"""
SELECT m.k AS model_id, g.j AS c_ordinal, g.c, e.vec_id, CASE WHEN e.label = m.k THEN 1 ELSE 0 END AS y,
       CAST(floor(CAST(e.embedding[1 + m.k] AS DOUBLE) * g.res) AS INTEGER) AS score
FROM embeddings e CROSS JOIN (VALUES (0), (1), (2), (3), (4), (10)) AS m(k)
CROSS JOIN (VALUES (0, 0.001::DOUBLE, 1), (1, 0.01::DOUBLE, 10), (2, 0.1::DOUBLE, 100),
                   (3, 1.0::DOUBLE, 100), (4, 10.0::DOUBLE, 1000)) AS g(j, c, res)""",
    "v_verdicts": r"""
SELECT c.conv_id * 100 + c.turn AS item_id, m.k AS condition_id,
       CASE WHEN (c.conv_id + m.k) % 3 = 0 THEN 1 ELSE 0 END AS gt,
       CASE (c.conv_id + c.turn * 3 + m.k) % 12
            WHEN 0 THEN 'The heart is large. Final Answer: Yes'
            WHEN 1 THEN '**Final Answer**: no'
            WHEN 2 THEN 'Final  answer : A.'
            WHEN 3 THEN 'Final Answer:' || chr(10) || ' **Yes**'
            WHEN 4 THEN 'final answer: unclear; yes perhaps'
            WHEN 5 THEN ''
            WHEN 6 THEN NULL
            WHEN 7 THEN 'Yes, ' || c.role
            WHEN 8 THEN 'Lungs clear'
            WHEN 9 THEN 'Opacity is seen'
            WHEN 10 THEN 'Final Answer: normal'
            ELSE c.text END AS raw
FROM conversations c CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS m(k)""",
    "v_pairs": r"""
SELECT conv_id * 100 + turn AS sample_id,
       CASE WHEN turn % 4 = 3 THEN NULL ELSE ' ' || role || ' stable ' END AS findings_gt,
       '**Findings:** ' || role || ' stable' AS findings_gen,
       'no change ' || CAST(turn AS VARCHAR) AS impression_gt,
       CASE WHEN turn % 3 = 2 THEN NULL
            ELSE '**Impression:**' || chr(10) || 'no change **findings:** ' || CAST(turn AS VARCHAR) END AS impression_gen
FROM conversations""",
    "v_entities": r"""
SELECT d.doc_id AS sample_id, s.side,
       'w' || CAST((d.doc_id * s.mul + t.t) % 12 AS VARCHAR) AS token,
       CASE WHEN t.t % 3 = 0 THEN 'OBS-DP' WHEN t.t % 3 = 1 THEN 'OBS-DA' ELSE 'ANAT-DP' END AS label,
       CASE WHEN t.t % 2 = 0 THEN 'modify:w' || CAST((d.doc_id + t.t) % 5 AS VARCHAR) END AS relation
FROM documents d
CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) AS t(t)
CROSS JOIN (VALUES ('hyp', 1), ('ref', 2)) AS s(side, mul)
WHERE NOT (d.doc_id % 20 = 0 AND s.side = 'hyp')""",
    "v_names": r"""
SELECT doc_id AS model_id,
       CASE doc_id % 6 WHEN 0 THEN 'Pleural Effusion_' || CAST(n_chars AS VARCHAR)
                       WHEN 1 THEN lang || '_' || source || '_' || CAST(doc_id AS VARCHAR)
                       WHEN 2 THEN source
                       WHEN 3 THEN lang || '_x' || CAST(doc_id AS VARCHAR)
                       WHEN 4 THEN 'atelectasis_' || CAST(doc_id % 3 * 64 AS VARCHAR)
                       ELSE 'edema_' || CAST(doc_id AS VARCHAR) END AS model_name,
       CASE WHEN doc_id % 5 = 1 THEN '' WHEN doc_id % 5 = 2 THEN 'cardiomegaly' END AS meta_condition,
       CAST(CASE WHEN doc_id % 7 = 0 THEN 128 END AS INTEGER) AS meta_size
FROM documents""",
}

# Views that read other views.
FIXTURE_DEPS = {"v_listing": ["v_paths"]}


def with_fixtures(names, body: str) -> str:
    """Prefix ``body`` with a WITH clause defining the named fixture views (deps first)."""
    order: list[str] = []

    def add(n):
        for d in FIXTURE_DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({FIXTURE_SQL[n]}\n)" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
