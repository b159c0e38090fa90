"""DuckDB SQL for the queries of more.py, written apart from them."""

from __future__ import annotations

from .oracle import BLIND, CONSENSUS, FINDINGS, INSIGHTS, LABELLED, LINES, PROBLEMS, UNITS, WS, _cleaned, rate, review_ctes

_ALL_REVIEWS = f"{UNITS}, src AS (SELECT evidence_id AS blinded_item_id, unit_text AS txt FROM units),{review_ctes('src')}"
_ANSWERS = f"""{_ALL_REVIEWS},
ans AS (SELECT reviewer_id, mechanism_label, CASE WHEN reviewer_id = 'c' THEN 'none' ELSE abstain_reason END AS abstain_reason, reviewer_id = 'a' AND left(sha256(blinded_item_id), 1) = '0' AS cut FROM reviews)"""
_LEVEL = "CASE WHEN mech_a = mech_b AND mech_b = mech_c THEN 'unanimous' WHEN mech_a = mech_b OR mech_b = mech_c OR mech_a = mech_c THEN 'majority' ELSE 'disputed' END"
_SAMPLE_TEXTS = f"{BLIND}, item AS (SELECT b.*, u.unit_text, u.doc_id, u.source FROM blind b JOIN units u USING (evidence_id))"


def more_sql() -> dict[str, str]:
    return {
        "csv_round_trip": "SELECT doc_id, source, sha256(coalesce(text, '')) AS text_sha256, '' AS absent FROM documents",
        "jsonl_round_trip": "SELECT conv_id, turn, role, sha256(coalesce(text, '')) AS text_sha256 FROM conversations",
        "appended_run": f"WITH {PROBLEMS} SELECT reviewer_id, mechanism_label, count(*) AS n, count(DISTINCT blinded_item_id) AS items FROM judged WHERE problems = '' GROUP BY ALL",
        "parent_context": "SELECT c.conv_id, c.turn, length(coalesce(f.text, ''))::INT AS context_length, CASE WHEN coalesce(f.text, '') <> '' THEN 'yes' ELSE 'no' END AS context_available FROM conversations c LEFT JOIN (SELECT conv_id, max(text) AS text FROM conversations WHERE turn = 0 GROUP BY 1) f USING (conv_id)",
        "public_sample": f"WITH {_SAMPLE_TEXTS} SELECT blinded_item_id, unit_text AS public_evidence_text, sha256(coalesce(d.text, '')) AS context_sha256, CASE WHEN coalesce(d.text, '') <> '' THEN 'yes' ELSE 'no' END AS context_available FROM item LEFT JOIN documents d USING (doc_id)",
        "private_key": f"WITH {_SAMPLE_TEXTS} SELECT blinded_item_id, evidence_id AS source_id, source AS platform_source, CASE WHEN is_retest THEN 'true' ELSE 'false' END AS is_retest, retest_group_id, original_main_blinded_id FROM item",
        "leak_checks": f"WITH {_SAMPLE_TEXTS} SELECT 'header' AS \"check\", 1::BIGINT AS hits UNION ALL SELECT 'text', count(*) FILTER (WHERE contains(lower(unit_text), 'src1') OR contains(lower(unit_text), 'idiot')) FROM item UNION ALL SELECT 'result_type', 0",
        "item_sources": "SELECT l.doc_id, CASE WHEN d.source IN ('src0', 'src1') THEN 'private-' || d.source WHEN d.source = 'src2' THEN '' ELSE coalesce(d.source, '') END AS source, CASE WHEN d.source IN ('src0', 'src1', 'src2') THEN '' ELSE coalesce(d.lang, '') END AS lang FROM labels l LEFT JOIN documents d USING (doc_id)",
        "source_texts": f"WITH {_SAMPLE_TEXTS} SELECT evidence_id AS source_id, max(unit_text) AS public_evidence_text FROM item GROUP BY 1",
        "repeated_reviews": f"WITH {CONSENSUS}, w AS (SELECT blinded_item_id, 'uncertain' AS mech_a, mech_b, mech_c, bound_a, bound_b, bound_c FROM wide JOIN blind USING (blinded_item_id) WHERE NOT is_retest) SELECT blinded_item_id, mech_a, mech_b, mech_c, CASE WHEN 'not_evidence' IN (bound_a, bound_b, bound_c) AND NOT (bound_a = bound_b AND bound_b = bound_c) AND {_LEVEL} <> 'unanimous' THEN 'boundary_disputed' ELSE {_LEVEL} END AS agreement_level, CASE WHEN mech_a = mech_b OR mech_a = mech_c THEN mech_a WHEN mech_b = mech_c THEN mech_b ELSE '' END AS consensus_mechanism FROM w",
        "repeated_parents": f"WITH s AS (SELECT count(*) AS n, count(*) FILTER (WHERE o.o_orderkey IS NULL) AS orphans, 0::BIGINT AS mismatches, 0::BIGINT AS located FROM lineitem LEFT JOIN (SELECT DISTINCT o_orderkey FROM orders) o ON o.o_orderkey = l_orderkey) SELECT *, {rate('located', 'n', 6, '1.0')} AS match_rate FROM s",
        "parsed_answers": f"WITH {_ANSWERS} SELECT reviewer_id, mechanism_label, abstain_reason, '' AS confidence_band, '2024-01-01T00:00:00' AS created_at, count(*) AS n FROM ans WHERE NOT cut GROUP BY ALL UNION ALL SELECT reviewer_id, '(rejected)', '', '', '', count(*) FROM ans WHERE cut GROUP BY ALL",
        "fenced_texts": f"SELECT item_id, trim(coalesce(text, ''), {WS}) AS text FROM benchmark",
        "cjk_texts": "SELECT regexp_matches(coalesce(text, ''), '[一-鿿]') AS has_cjk, count(*) AS n FROM (SELECT text FROM documents UNION ALL VALUES ('中文'), ('かな'), (NULL)) GROUP BY 1",
        "script_lines": f"WITH {LINES.replace('coalesce(text', chr(39) + '# 注释' + chr(39) + ' || chr(10) || ' + chr(39) + 'plain 中' + chr(39) + ' || chr(10) || ' + chr(39) + 's = ' + chr(34) + '中' + chr(34) + chr(39) + ' || chr(10) || coalesce(text')} SELECT file_path, line_number, raw FROM lines WHERE regexp_matches(raw, '[一-鿿]') AND (starts_with(trim(raw, {WS}), '#') OR contains(raw, chr(34)) OR contains(raw, chr(39)))",
        "exempt_findings": f"WITH {FINDINGS} SELECT issue_type, count(*) AS n FROM findings WHERE issue_type IN ('template_phrase', 'long_sentence', 'internal_process_language') AND (issue_type = 'internal_process_language' OR file_path % 2 = 1 OR file_path >= 200) GROUP BY 1",
        "lint_files": f"WITH {FINDINGS} SELECT file_path, count(*) AS n, count(*) FILTER (WHERE priority = 'P0') AS p0, count(*) FILTER (WHERE priority = 'P1') AS p1, count(*) FILTER (WHERE priority = 'P2') AS p2 FROM findings GROUP BY 1 ORDER BY n DESC, file_path LIMIT 10",
        "lint_markers": "WITH k AS (SELECT coalesce(sum((length(text) - length(replace(text, 'License', ''))) // 7), 0)::BIGINT AS k FROM documents) SELECT 'P1' AS level, 0::BIGINT AS blocking, 0::BIGINT AS long_sentences, CASE WHEN k > 1 THEN 'marker_repeated' ELSE '' END AS reasons, k <= 1 AS passed, k AS marker_count FROM k",
        "insight_links": f"WITH {INSIGHTS} SELECT i.insight_id, g.evidence_id FROM g JOIN ins i USING (surface_topic, mechanism_label)",
        "topic_bars": f"WITH {LABELLED}, k AS (SELECT surface_topic AS key, count(*) AS n FROM labelled GROUP BY 1), t AS (SELECT sum(n)::BIGINT AS total FROM k) SELECT key, CASE key WHEN 'noise' THEN 'Noise' WHEN 'water' THEN 'Water' ELSE key END AS name, n, ((n * 2000 + total) // (total * 2)) // 10 || '.' || ((n * 2000 + total) // (total * 2)) % 10 || '%' AS share FROM k, t ORDER BY n DESC, key LIMIT 8",
        "capped_items": f"WITH {UNITS} SELECT 'b' AS reviewer_id, evidence_id AS blinded_item_id FROM units ORDER BY evidence_id LIMIT 20",
        "counter_entries": "SELECT n_nationkey, 'a' AS key, n_nationkey::BIGINT AS n FROM nation",
        "label_entropy": f"WITH {LABELLED}, c AS (SELECT source, mechanism_label, count(*) AS n FROM labelled GROUP BY ALL), t AS (SELECT source, sum(n) AS total FROM c GROUP BY 1) SELECT source, round(round(sum(-(n / total) * log2(n / total)), 4), 2) + 0.0 AS entropy FROM c JOIN t USING (source) GROUP BY source",
        "cleaned_lengths": f"SELECT source, count(*) AS n, sum(length(t))::BIGINT AS chars FROM (SELECT source, {_cleaned('text')} AS t FROM documents) WHERE length(t) >= 1 GROUP BY source",
        "inclusion_states": "SELECT CASE WHEN quality = 0 OR toxic = 1 THEN 'no' WHEN quality = 1 AND toxic = 0 THEN 'yes' ELSE 'uncertain' END AS inclusion, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
        "rater_view": "SELECT doc_id::VARCHAR AS doc_id, coalesce(lang, '') AS lang, '' AS window_tag FROM documents",
        "empty_dates": f"SELECT n, empty, {rate('empty', 'n')} AS empty_rate FROM (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'P') AS empty FROM orders)",
        "masked_texts": "SELECT n_nationkey, 'add [MESSENGER] or [HANDLE]' AS masked FROM nation",
        "json_rows": "SELECT n_nationkey, to_json({'n_name': n_name, 'n_nationkey': n_nationkey})::VARCHAR AS json FROM nation",
        "adjudication_queue": f"WITH {CONSENSUS} SELECT blinded_item_id, source_id, agreement_level FROM cons2 WHERE needs_adjudication",
        "normalised_tables": f"WITH {LABELLED} SELECT 'samples' AS counter, (SELECT count(*) FROM documents) AS n UNION ALL SELECT 'evidence', count(*) FROM labelled UNION ALL SELECT 'topics_filled', count(*) FROM labelled WHERE surface_topic = 'other_uncertain'",
        "dispute_pairs_top8": f"WITH {CONSENSUS} SELECT first, second, count(*) AS n FROM pairs GROUP BY ALL ORDER BY n DESC, min(blinded_item_id), first, second LIMIT 8",
    }
