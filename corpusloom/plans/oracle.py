"""DuckDB SQL for the catalogue, written apart from the Spark code: the same results from the same tables."""

from __future__ import annotations

# What the SQL reads is written out here, apart from the Spark code.
WHITESPACE = "".join(map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))
TOPICS = [("noise", ["###", "%%%"]), ("relation", ["with", "for "]), ("craft", ["sch"]), ("action", ["ción"]), ("water", ["eau"]), ("reference", ["this"])]
TOPIC_NAMES = ["noise", "relation", "craft", "action", "water", "reference", "other_uncertain"]
MECHANISMS = [("safety", ["worthless", "idiot", "scum"]), ("trust", ["sch"]), ("fairness", ["ción"]), ("belonging", ["with", "for "]), ("competence", ["eau", "tion"])]
LABELS = ["safety", "trust", "fairness", "belonging", "competence", "uncertain"]
BOUNDARIES = ["complete", "needs_parent_context", "over_segmented", "under_segmented", "not_evidence"]
CONFIDENCES = ["high", "medium", "low"]
ABSTENTIONS = ["none", "insufficient_context", "multiple_mechanisms", "unclear_topic", "unclear_boundary", "other"]
DIMS = ["source", "lang", "surface_topic", "mechanism_label", "length_bucket"]
SAMPLE, RETESTS, QUOTA, SEED = 300, 30, 5, "20260720"
ISSUES = {
    "template_phrase": ("P0", "rewrite"), "negative_framing": ("P1", "rewrite"), "not_this_but_that": ("P0", "rewrite"), "internal_process_language": ("P1", "move_to_issue"),
    "repeated_status": ("P1", "move_to_method_doc"), "long_sentence": ("P2", "rewrite"), "technical_term_overload": ("P2", "rewrite"),
}
REQUIRED = ["run_id", "reviewer_id", "blinded_item_id", "evidence_text", "mechanism_label", "surface_topic", "boundary_status", "abstain_reason", "confidence_band", "evidence_phrase"]
THRESHOLDS = [
    ("sample_id_unique_rate", 1, None, "block"), ("evidence_id_unique_rate", 1, None, "block"), ("parent_reference_rate", 1, None, "block"), ("platform_match_rate", 1, None, "block"),
    ("public_url_hit_count", None, 0, "block"), ("sample_duplicate_group_count", None, 0, "warn"), ("explicit_topic_rate", 0.4, None, "warn"), ("assigned_mechanism_rate", 0.4, None, "warn"),
    ("samples_without_evidence_rate", None, 0.05, "warn"), ("insight_support_resolution_rate", 1, None, "block"), ("action_to_insight_linkage_rate", 1, None, "block"),
    ("action_to_evidence_linkage_rate", 1, None, "block"), ("evidence_text_match_rate", 1, None, "block"), ("invalid_label_rate", None, 0, "block"), ("uncertain_share", None, 0.5, "warn"),
    ("flagged_share", None, 0.2, "warn"), ("absent_metric", 0.5, None, "block"),
]
_PRIVATE = {
    "URL": r"[Hh][Tt][Tt][Pp][Ss]?://[^ \t\n\r]+", "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", "PHONE": r"\+?[0-9][0-9() -]{7,}[0-9]",
    "MESSENGER": r"(?i:qq|vx|wx|wechat|telegram|whatsapp)[ ]?[:=][ ]?[A-Za-z0-9_-]{5,}", "HANDLE": r"@[A-Za-z0-9_]{2,}",
}


COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}


class LINT:
    banned, discouraged, internal, status, terms = ["worthless", "idiot"], ["trash", "clown"], ["token ="], ["license", "License"], ["tion", "ing", "th"]
    not_but, explained_by, max_sentence, max_terms, max_status = ("with", "for"), [":", "："], 60, 3, 3


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WS = q(WHITESPACE)


def rate(a: str, b: str, digits: int = 6, default: str = "0.0") -> str:
    return f"CASE WHEN ({b}) > 0 THEN CAST((2 * ({a})::BIGINT * {10**digits} + ({b})::BIGINT) // (2 * ({b})::BIGINT) AS DOUBLE) / {10**digits} ELSE CAST({default} AS DOUBLE) END"


def words(column: str, listed: list[str], join: str = " OR ") -> str:
    return "(" + join.join(f"contains({column}, {q(w)})" for w in listed) + ")"


def case(column: str, rules: list[tuple[str, list[str]]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {words(column, w)} THEN {q(label)}" for label, w in rules) + f" ELSE {q(default)} END"


def squash(column: str) -> str:
    return f"translate(coalesce({column}, ''), {WS}, '')"


UNITS = f"""
listed AS (
  SELECT doc_id, source, lang, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[。！？；\\n]+|[.!?;]+'), lambda x: trim(x, {WS})), lambda x: length(x) >= 6) AS u
  FROM documents
),
units AS (
  SELECT doc_id, source, lang, unit_index, unit_text, printf('%s_U%02d', doc_id::VARCHAR, unit_index) AS evidence_id
  FROM (SELECT doc_id, source, lang, generate_subscripts(u, 1) AS unit_index, unnest(u) AS unit_text FROM listed)
)"""
LABELLED = f"""{UNITS},
labelled AS (
  SELECT *, {case('lower(unit_text)', TOPICS, 'other_uncertain')} AS surface_topic, {case('lower(unit_text)', MECHANISMS, 'uncertain')} AS mechanism_label,
         CASE WHEN length(trim(unit_text, {WS})) <= 15 THEN 'short' WHEN length(trim(unit_text, {WS})) <= 40 THEN 'medium' ELSE 'long' END AS length_bucket
  FROM units
)"""
ASSIGNED = "mechanism_label NOT IN ('', 'uncertain', 'unassigned')"
SPECIFIC = "surface_topic NOT IN ('', 'other_uncertain')"


def seeded(seed: str, *parts: str) -> str:
    return "sha256(" + " || '|' || ".join([q(seed), *(f"({p})::VARCHAR" for p in parts)]) + ")"


_PICKS = " UNION ALL ".join(
    f"SELECT evidence_id AS id, 0 AS phase, {i} AS dim, v, lpad(n::VARCHAR, 6, '0') AS n FROM (SELECT evidence_id, {d} AS v, row_number() OVER (PARTITION BY {d} ORDER BY {seeded(f'{SEED}|{d}', 'evidence_id')}, evidence_id) AS n FROM labelled) WHERE n <= 2"
    for i, d in enumerate(DIMS)
)
SAMPLED = f"""{LABELLED},
fill AS (SELECT evidence_id AS id, 1 AS phase, 0 AS dim, {seeded(f'{SEED}|fill', 'evidence_id')} AS v, '' AS n FROM labelled ORDER BY v, id LIMIT {SAMPLE}),
picks AS ({_PICKS} UNION ALL SELECT * FROM fill),
firsts AS (SELECT * FROM picks QUALIFY row_number() OVER (PARTITION BY id ORDER BY phase, dim, v, n) = 1),
drawn AS (SELECT id AS evidence_id, row_number() OVER (ORDER BY phase, dim, v, n, id) AS pick FROM firsts QUALIFY row_number() OVER (ORDER BY phase, dim, v, n, id) <= {SAMPLE})"""
BLIND = f"""{SAMPLED},
again AS (SELECT evidence_id FROM drawn ORDER BY {seeded(f'{SEED}|retest', 'evidence_id')}, evidence_id LIMIT {RETESTS}),
grouped AS (SELECT evidence_id, printf('G%03d', row_number() OVER (ORDER BY evidence_id)) AS retest_group_id FROM again),
two AS (
  SELECT evidence_id, retest_group_id, false AS is_retest FROM drawn LEFT JOIN grouped USING (evidence_id)
  UNION ALL SELECT evidence_id, retest_group_id, true FROM grouped
),
named AS (SELECT *, printf('CAL_%04d', row_number() OVER (ORDER BY {seeded(f'{SEED}|blind', 'evidence_id', "CASE WHEN is_retest THEN 'true' ELSE 'false' END")}, evidence_id, is_retest)) AS blinded_item_id FROM two),
blind AS (
  SELECT n.blinded_item_id, n.evidence_id, n.is_retest, coalesce(n.retest_group_id, '') AS retest_group_id, CASE WHEN n.is_retest THEN m.blinded_item_id ELSE '' END AS original_main_blinded_id
  FROM named n LEFT JOIN named m ON m.retest_group_id = n.retest_group_id AND NOT m.is_retest
)"""


def review_ctes(source: str) -> str:
    """reviews of a table with blinded_item_id and txt."""
    hits = "[" + ", ".join(f"CASE WHEN {words('lower(txt)', w)} THEN {q(label)} END" for label, w in MECHANISMS) + "]"
    digest = "sha256(r || blinded_item_id || txt)"
    total = f"list_sum(list_transform(string_split({digest}, ''), lambda x: ('0x' || x)::INT))"
    return f"""
hit AS (SELECT blinded_item_id, txt, list_filter({hits}, lambda x: x IS NOT NULL) AS hits, {case('lower(txt)', TOPICS, 'other_uncertain')} AS topic, length(trim(txt, {WS})) < 12 AS brief, unnest(['a', 'b', 'c']) AS r FROM {source}),
dig AS (SELECT *, coalesce(hits[1], 'uncertain') AS base, {total} % 3 AS m3, right({digest}, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') AS even FROM hit),
mec AS (SELECT *, CASE WHEN r = 'a' THEN CASE WHEN brief OR (m3 = 0 AND even) THEN 'uncertain' ELSE base END WHEN r = 'c' AND len(hits) > 1 AND m3 = 0 THEN hits[2] ELSE base END AS mechanism_label FROM dig),
reviews AS (
  SELECT r AS reviewer_id, blinded_item_id, txt AS evidence_text, mechanism_label, CASE WHEN mechanism_label = 'uncertain' THEN 'other_uncertain' ELSE topic END AS surface_topic,
         CASE WHEN mechanism_label = 'uncertain' AND brief THEN 'needs_parent_context' ELSE 'complete' END AS boundary_status,
         CASE WHEN mechanism_label = 'uncertain' THEN CASE WHEN brief THEN 'insufficient_context' ELSE 'multiple_mechanisms' END ELSE 'none' END AS abstain_reason,
         CASE WHEN mechanism_label = 'uncertain' THEN 'low' WHEN len(hits) = 1 THEN 'high' ELSE 'medium' END AS confidence_band, substring(txt, 1, 12) AS evidence_phrase
  FROM mec
)"""


REVIEWS = f"{BLIND},\nitems AS (SELECT b.blinded_item_id, u.unit_text AS txt FROM blind b JOIN units u USING (evidence_id)),{review_ctes('items')}"
_PIVOT = ", ".join(f"max(CASE WHEN reviewer_id = '{r}' THEN {c} END) AS {s}_{r}" for r in "abc" for s, c in (("mech", "mechanism_label"), ("topic", "surface_topic"), ("bound", "boundary_status")))


def _level(x: str) -> str:
    a, b, c = (f"{x}_{r}" for r in "abc")
    return f"CASE WHEN {a} = {b} AND {b} = {c} THEN 'unanimous' WHEN {a} = {b} OR {b} = {c} OR {a} = {c} THEN 'majority' ELSE 'disputed' END"


def _major(x: str) -> str:
    a, b, c = (f"{x}_{r}" for r in "abc")
    return f"CASE WHEN {a} = {b} OR {a} = {c} THEN {a} WHEN {b} = {c} THEN {b} ELSE '' END"


def _entropy(x: str) -> str:
    return f"CASE {_level(x)} WHEN 'unanimous' THEN 0.0::DOUBLE WHEN 'majority' THEN 0.9183::DOUBLE ELSE 1.585::DOUBLE END"


CONSENSUS = f"""{REVIEWS},
wide AS (SELECT blinded_item_id, {_PIVOT} FROM reviews GROUP BY blinded_item_id),
cons AS (
  SELECT w.blinded_item_id, b.evidence_id AS source_id, topic_a, topic_b, topic_c, mech_a, mech_b, mech_c, {_major('topic')} AS consensus_topic, {_major('mech')} AS consensus_mechanism,
         CASE WHEN 'not_evidence' IN (bound_a, bound_b, bound_c) AND NOT (bound_a = bound_b AND bound_b = bound_c) AND {_level('mech')} <> 'unanimous' THEN 'boundary_disputed' ELSE {_level('mech')} END AS agreement_level,
         {_entropy('topic')} AS topic_entropy, {_entropy('mech')} AS mechanism_entropy, CASE WHEN bound_a = bound_b AND bound_b = bound_c THEN 'agree' ELSE 'disagree' END AS boundary_agreement
  FROM wide w JOIN blind b USING (blinded_item_id) WHERE NOT b.is_retest
),
cons2 AS (SELECT *, agreement_level <> 'unanimous' AS needs_adjudication FROM cons),
cur AS (SELECT evidence_id AS source_id, mechanism_label AS current_label FROM labelled WHERE source <> 'src5'),
cc AS (SELECT c.*, cur.current_label, CASE WHEN consensus_mechanism = '' THEN 'no_consensus' ELSE consensus_mechanism END AS consensus FROM cons2 c JOIN cur USING (source_id)),
pairs AS (SELECT DISTINCT c.blinded_item_id, c.source_id, x.l AS first, y.l AS second FROM cons2 c, unnest([mech_a, mech_b, mech_c]) x(l), unnest([mech_a, mech_b, mech_c]) y(l) WHERE x.l < y.l)"""


def _distribution(sql: str, column: str) -> str:
    return f"WITH k AS (SELECT CASE WHEN trim(coalesce({column}::VARCHAR, ''), {WS}) = '' THEN '(empty)' ELSE {column}::VARCHAR END AS key, count(*) AS n FROM {sql} GROUP BY 1), t AS (SELECT coalesce(sum(n), 0)::BIGINT AS total FROM k) SELECT key, n, total, {rate('n', 'total')} AS rate FROM k, t"


def _stats(ctes: str, sql: str) -> str:
    return f"""WITH {ctes} v AS ({sql}), s AS (SELECT count(*) AS n, coalesce(sum(v), 0)::BIGINT AS s FROM v), r AS (SELECT v, row_number() OVER (ORDER BY v) AS i FROM v)
SELECT n, coalesce((SELECT min(v) FROM v), 0)::BIGINT AS min, coalesce(((SELECT v FROM r WHERE i = (n + 1) // 2) + (SELECT v FROM r WHERE i = (n + 2) // 2)) / 2.0, 0)::DOUBLE AS median,
       {rate('s', 'n', 2)} AS mean, coalesce((SELECT v FROM r WHERE i = round_even((n - 1) * 0.9, 0)::BIGINT + 1), 0)::BIGINT AS p90, coalesce((SELECT max(v) FROM v), 0)::BIGINT AS max FROM s"""


CROSS = f"{LABELLED}, x AS (SELECT surface_topic, mechanism_label, count(*) AS n FROM labelled GROUP BY ALL), t AS (SELECT sum(n)::BIGINT AS total FROM x), cells AS (SELECT x.*, total, {rate('n', 'total')} AS rate FROM x, t)"


def _listed(x: str) -> str:
    return f"{x}_l AS (SELECT source, string_agg({x} || ':' || n, ',' ORDER BY n DESC, {x}) AS {x}_counts FROM (SELECT source, {x}, count(*) AS n FROM labelled GROUP BY ALL) GROUP BY source)"


INSIGHTS = f"""{LABELLED},
g AS (SELECT * FROM labelled WHERE {ASSIGNED} AND surface_topic <> ''),
ranked AS (SELECT *, row_number() OVER (PARTITION BY surface_topic, mechanism_label ORDER BY doc_id, unit_index) AS i FROM g),
ins AS (
  SELECT printf('INSIGHT_%03d', row_number() OVER (ORDER BY count(*) DESC, surface_topic, mechanism_label)) AS insight_id, surface_topic, mechanism_label, count(*) AS evidence_count,
         (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT unnest(list(DISTINCT source)) AS s)) AS platforms,
         CASE WHEN count(*) >= 100 THEN 'high_support' ELSE 'low_support' END AS support_level, count(DISTINCT source) <= 1 AS single_platform,
         string_agg(CASE WHEN i <= 3 THEN evidence_id END, ',' ORDER BY i) AS first_ids
  FROM ranked GROUP BY surface_topic, mechanism_label
),
acts AS (SELECT printf('ACTION_%03d', row_number() OVER (ORDER BY regexp_extract(insight_id, '[0-9]+$')::BIGINT)) AS action_id, insight_id, surface_topic || ' / ' || mechanism_label AS title, first_ids AS source_evidence_ids, 'share of such feedback falls' AS expected_effect, 'compare shares before and after' AS validation_method FROM ins WHERE support_level = 'high_support')"""
EVALUATION = f"""{INSIGHTS},
one AS (SELECT count(*) AS n, count(DISTINCT evidence_id) AS ids, count(*) FILTER (WHERE mechanism_label NOT IN ('', 'unassigned', {', '.join(map(q, LABELS))})) AS invalid FROM labelled),
loc AS (SELECT count(*) FILTER (WHERE contains(lower({squash('d.text')}), lower({squash('l.unit_text')})) AND {squash('l.unit_text')} <> '') AS located FROM labelled l LEFT JOIN documents d USING (doc_id)),
ni AS (SELECT count(*) AS n_insights FROM ins), na AS (SELECT count(*) AS n_actions FROM acts),
rates AS (
  SELECT n, {rate('ids', 'n', 4, '1.0')} AS evidence_id_unique_rate, {rate('located', 'n', 4, '1.0')} AS evidence_text_match_rate, {rate('invalid', 'n', 4, '1.0')} AS invalid_label_rate,
         1.0::DOUBLE AS insight_support_resolution_rate, 1.0::DOUBLE AS action_to_insight_linkage_rate, 1.0::DOUBLE AS action_to_evidence_linkage_rate
  FROM one, loc, ni, na
),
ev AS (
  SELECT *, concat_ws(',', CASE WHEN evidence_text_match_rate < 0.98 THEN 'text_match' END, CASE WHEN invalid_label_rate > 0 THEN 'invalid_label' END) AS blockers FROM rates
)"""
SHARES = f"SELECT count(*) AS n, count(*) FILTER (WHERE mechanism_label = 'uncertain') AS uncertain, count(*) FILTER (WHERE surface_topic = 'other_uncertain') AS other_uncertain, count(*) FILTER (WHERE mechanism_label = 'uncertain' AND length_bucket = 'short') AS flagged, count(*) FILTER (WHERE {ASSIGNED}) AS assigned, count(*) FILTER (WHERE {SPECIFIC}) AS specific, count(*) FILTER (WHERE {ASSIGNED} AND {SPECIFIC}) AS both FROM labelled"
_LIMITS = ", ".join(f"({q(m)}, {'NULL' if lo is None else lo}::DOUBLE, {'NULL' if hi is None else hi}::DOUBLE, {q(lv)})" for m, lo, hi, lv in THRESHOLDS)



def _pii() -> str:
    inner, cols = "coalesce(text, '')", []
    for kind, p in _PRIVATE.items():
        cols.append(f"len(regexp_extract_all({inner}, {q(p)}))::BIGINT AS n_{kind.lower()}")
        inner = f"regexp_replace({inner}, {q(p)}, '[{kind}]', 'g')"
    return f"SELECT doc_id, {', '.join(cols)}, sha256({inner}) AS masked_sha256 FROM documents"


_MARKUP = [r"`+[^`]*`+", r"!?\[[^\]]*\]\([^)]*\)", r"</?[A-Za-z!][^>]*>", r"https?://[!-~]+", r"[-#>*_|]"]
_CLEAN = "raw"
for _p in _MARKUP:
    _CLEAN = f"regexp_replace({_CLEAN}, {q(_p)}, ' ', 'g')"
LINES = f"""
raw AS (SELECT doc_id AS file_path, generate_subscripts(l, 1) AS line_number, unnest(l) AS raw FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\r\n|\n|\r') AS l FROM documents)),
lines AS (SELECT *, {_CLEAN} AS clean FROM raw)"""


def _issue(issue: str, shown: str, detail: str) -> str:
    priority, action = ISSUES[issue]
    return f"file_path, line_number, substring({shown}, 1, 60) AS original_text, '{issue}' AS issue_type, {detail} AS detail, '{action}' AS action, '{priority}' AS priority"


def _phrases(issue: str, column: str, listed: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT {_issue(issue, f'trim(raw, {WS})', q(p))} FROM lines WHERE contains({column}, {q(p)})" for p in listed)


_STATUS = " + ".join(f"(length(clean) - length(replace(clean, {q(t)}, ''))) // {len(t)}" for t in LINT.status)
_TERMS = " + ".join(f"contains(s, {q(t)})::INT" for t in LINT.terms)
FINDINGS = f"""{LINES},
sentences AS (SELECT file_path, line_number, trim(s, {WS}) AS s FROM (SELECT file_path, line_number, unnest(regexp_split_to_array(clean, '[。！？；\\n]')) AS s FROM lines) WHERE trim(s, {WS}) <> ''),
findings AS (
  {_phrases('internal_process_language', 'raw', LINT.internal)}
  UNION ALL SELECT {_issue('not_this_but_that', f'trim(raw, {WS})', "''")} FROM lines WHERE regexp_matches(clean, {q(f'{LINT.not_but[0]}[^,.;!?，。；！？]{{0,40}}{LINT.not_but[1]}')})
  UNION ALL {_phrases('template_phrase', 'clean', LINT.banned)}
  UNION ALL {_phrases('negative_framing', 'clean', LINT.discouraged)}
  UNION ALL SELECT {_issue('repeated_status', "''", 'k::VARCHAR')} FROM (SELECT file_path, 0 AS line_number, sum({_STATUS})::BIGINT AS k FROM lines GROUP BY file_path) WHERE k > {LINT.max_status}
  UNION ALL SELECT {_issue('long_sentence', 's', "''")} FROM sentences WHERE length({squash('s')}) > {LINT.max_sentence}
  UNION ALL SELECT {_issue('technical_term_overload', 's', "''")} FROM sentences WHERE {_TERMS} >= {LINT.max_terms} AND NOT {words('s', LINT.explained_by)}
)"""


def _gate(level: str, place: int) -> str:
    strict = place <= 1
    return f"""SELECT '{level}' AS level, blocking, long_sentences, concat_ws(',', CASE WHEN blocking > 0 THEN 'findings' END, CASE WHEN {strict} AND long_sentences > 10 THEN 'long_sentences' END) AS reasons, blocking = 0 AND NOT ({strict} AND long_sentences > 10) AS passed
FROM (SELECT count(*) FILTER (WHERE right(priority, 1)::INT <= {place}) AS blocking, count(*) FILTER (WHERE issue_type = 'long_sentence') AS long_sentences FROM findings)"""


_SPOIL = f"""{UNITS}, src AS (SELECT evidence_id AS blinded_item_id, unit_text AS txt FROM units),{review_ctes('src')},
spoiled0 AS (SELECT *, 'rules' AS run_id, left(sha256(blinded_item_id || reviewer_id), 1) AS k FROM reviews),
spoiled AS (
  SELECT run_id, reviewer_id, blinded_item_id, evidence_text, CASE WHEN k = '0' THEN 'bogus' ELSE mechanism_label END AS mechanism_label, CASE WHEN k = '1' THEN '' ELSE boundary_status END AS boundary_status,
         CASE WHEN k = '2' THEN 'sure' ELSE confidence_band END AS confidence_band, CASE WHEN k = '3' THEN 'not in the text' ELSE evidence_phrase END AS evidence_phrase,
         CASE WHEN k = '4' THEN 'nowhere' ELSE surface_topic END AS surface_topic, CASE WHEN k = '5' THEN 'none' ELSE abstain_reason END AS abstain_reason
  FROM spoiled0
)"""
_REQ = ", ".join(f"CASE WHEN {c} = '' THEN '{c}' END" for c in REQUIRED if c not in ("surface_topic", "evidence_phrase"))
_ENUM = ", ".join(f"CASE WHEN {c} NOT IN ({', '.join(map(q, v))}) THEN '{c}:invalid' END" for c, v in (("mechanism_label", LABELS), ("boundary_status", BOUNDARIES), ("confidence_band", CONFIDENCES), ("abstain_reason", ABSTENTIONS)))
PROBLEMS = f"""{_SPOIL},
judged AS (
  SELECT *, concat_ws(',', {_REQ}, {_ENUM}, CASE WHEN surface_topic <> '' AND surface_topic NOT IN ({', '.join(map(q, TOPIC_NAMES))}) THEN 'surface_topic:invalid' END,
    CASE WHEN trim(evidence_phrase, {WS}) <> '' AND NOT contains(evidence_text, trim(evidence_phrase, {WS})) THEN 'evidence_phrase:not_in_text' END,
    CASE WHEN mechanism_label = 'uncertain' AND abstain_reason = 'none' THEN 'abstain_reason:required_for_uncertain' END) AS problems
  FROM spoiled
)"""


_ACCEPTED = "count(*) FILTER (WHERE problems = '')"


def _rows(metrics: dict[str, str], sql: str = "cons2") -> str:
    parts = " UNION ALL ".join(f"SELECT '{m}' AS metric, count(*) FILTER (WHERE {c}) AS numerator, count(*) AS denominator FROM {sql}" for m, c in metrics.items())
    return f"SELECT *, {rate('numerator', 'denominator', 4, 'NULL')} AS rate FROM ({parts})"


_PE = " + ".join(f"pow(sum((mech_a = {q(c)})::INT + (mech_b = {q(c)})::INT + (mech_c = {q(c)})::INT) / (count(*) * 3.0), 2)" for c in LABELS)
_PI = " + ".join(f"pow((mech_a = {q(c)})::INT + (mech_b = {q(c)})::INT + (mech_c = {q(c)})::INT, 2)" for c in LABELS)


_SQUASHED = squash("text")
_SOME = "sh.n"
_METRICS = f"""bare AS (SELECT count(*) FILTER (WHERE len(u) = 0) AS bare, count(*) AS samples FROM listed),
dup AS (SELECT count(*) AS groups FROM (SELECT 1 FROM documents WHERE {_SQUASHED} <> '' GROUP BY {_SQUASHED} HAVING count(*) > 1)),
hit AS (SELECT count(*) FILTER (WHERE regexp_matches(coalesce(text, ''), '(?i)https?://')) AS hits, {rate('count(DISTINCT doc_id)', 'count(*)', 4, '1.0')} AS uniq FROM documents),
lost AS (SELECT count(*) FILTER (WHERE d.doc_id IS NULL) AS orphans, count(*) FILTER (WHERE l.source <> d.source) AS mismatches FROM labelled l LEFT JOIN documents d USING (doc_id)),
every AS (SELECT ev.*, sh.* EXCLUDE (n), bare.*, dup.*, hit.*, lost.* FROM ev, sh, bare, dup, hit, lost),
m AS (
  SELECT 'sample_id_unique_rate' AS metric, uniq AS value FROM every UNION ALL SELECT 'evidence_id_unique_rate', evidence_id_unique_rate FROM every
  UNION ALL SELECT 'parent_reference_rate', {rate('n - orphans', 'n', 6, '1.0')} FROM every UNION ALL SELECT 'platform_match_rate', {rate('n - orphans - mismatches', 'n', 6, '1.0')} FROM every
  UNION ALL SELECT 'evidence_text_match_rate', evidence_text_match_rate FROM every UNION ALL SELECT 'public_url_hit_count', hits::DOUBLE FROM every
  UNION ALL SELECT 'sample_duplicate_group_count', groups::DOUBLE FROM every UNION ALL SELECT 'invalid_label_rate', invalid_label_rate FROM every
  UNION ALL SELECT 'explicit_topic_rate', {rate('specific', 'n', 6, '1.0')} FROM every UNION ALL SELECT 'assigned_mechanism_rate', {rate('assigned', 'n', 6, '1.0')} FROM every
  UNION ALL SELECT 'uncertain_share', {rate('uncertain', 'n')} FROM every UNION ALL SELECT 'flagged_share', {rate('flagged', 'n')} FROM every
  UNION ALL SELECT 'samples_without_evidence_rate', {rate('bare', 'samples', 6, '1.0')} FROM every UNION ALL SELECT 'insight_support_resolution_rate', insight_support_resolution_rate FROM every
  UNION ALL SELECT 'action_to_insight_linkage_rate', action_to_insight_linkage_rate FROM every UNION ALL SELECT 'action_to_evidence_linkage_rate', action_to_evidence_linkage_rate FROM every
)"""


def _cleaned(column: str) -> str:
    out = f"regexp_replace(coalesce({column}, ''), '(?im)^[ \\t\\n\\r\\v\\f]*(re|reply to|回复)[ \\t\\n\\r\\v\\f]*[@:：][^\\n]*$', ' ', 'g')"
    out = f"regexp_replace({out}, '(?m)^[ \\t\\n\\r\\v\\f]*>+[^\\n]*$', ' ', 'g')"
    out = f"regexp_replace({out}, '(?i)\\[(image|img|图片|表情)\\]', ' ', 'g')"
    return f"trim(regexp_replace({out}, {q('[' + WHITESPACE + ']+')}, ' ', 'g'), {WS})"


def _blank(name: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS table_name, '{c}' AS \"column\", count(*) FILTER (WHERE trim(coalesce({c}::VARCHAR, ''), {WS}) = '') AS blanks, count(*) AS n FROM {name}" for c in columns)


def _unique(name: str, key: str) -> str:
    return f"SELECT '{name}' AS table_name, count(*) AS n, count(DISTINCT {key}) AS distinct_keys, count(*) = count(DISTINCT {key}) AS is_unique, {rate(f'count(DISTINCT {key})', 'count(*)', 4, '1.0')} AS unique_rate FROM {name}"


def _url(name: str, column: str) -> str:
    return f"SELECT '{name}' AS table_name, '{column}' AS \"column\", count(*) AS n, count(*) FILTER (WHERE regexp_matches(coalesce({column}, ''), '(?i)https?://')) AS hits FROM {name}"


def oracle_sql() -> dict[str, str]:
    out = {
        "segment_units": f"WITH {UNITS} SELECT evidence_id, doc_id, unit_index, unit_text FROM units",
        "length_buckets": f"WITH {LABELLED}, k AS (SELECT length_bucket AS key, count(*) AS n FROM labelled GROUP BY 1), t AS (SELECT sum(n)::BIGINT AS total FROM k) SELECT key, n, total, {rate('n', 'total')} AS rate FROM k, t",
        "label_crosstab": f"WITH {CROSS} SELECT * FROM cells",
        "label_crosstab_specific": f"WITH {CROSS} SELECT * FROM cells WHERE {ASSIGNED} AND {SPECIFIC}",
        "top_combinations": f"WITH {CROSS} SELECT * FROM cells WHERE {ASSIGNED} AND {SPECIFIC} ORDER BY n DESC, surface_topic, mechanism_label LIMIT 10",
        "text_length_stats": _stats("", "SELECT length(coalesce(text, '')) AS v FROM documents"),
        "unit_length_stats": _stats(f"{UNITS},", "SELECT length(unit_text) AS v FROM units"),
        "unit_density_stats": _stats(f"{UNITS},", "SELECT len(u) AS v FROM listed"),
        "order_line_density": _stats("", "SELECT coalesce(k, 0) AS v FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"),
        "platform_breakdown": f"WITH {LABELLED}, {_listed('surface_topic')}, {_listed('mechanism_label')}, {_listed('length_bucket')}, d AS (SELECT coalesce(source, '') AS source, count(*) AS samples FROM documents GROUP BY 1), u AS (SELECT source, count(*) AS units FROM labelled GROUP BY 1) SELECT source, samples, coalesce(units, 0) AS units, {rate('coalesce(units, 0)', 'samples', 3)} AS units_per_sample, coalesce(surface_topic_counts, '') AS surface_topic_counts, coalesce(mechanism_label_counts, '') AS mechanism_label_counts, coalesce(length_bucket_counts, '') AS length_bucket_counts FROM d LEFT JOIN u USING (source) LEFT JOIN surface_topic_l USING (source) LEFT JOIN mechanism_label_l USING (source) LEFT JOIN length_bucket_l USING (source)",
        "platform_topk": f"WITH {LABELLED}, t AS (SELECT source, 'topic' AS axis, surface_topic AS label, count(*) AS n FROM labelled WHERE {SPECIFIC} GROUP BY ALL), m AS (SELECT source, 'mechanism' AS axis, mechanism_label AS label, count(*) AS n FROM labelled WHERE {ASSIGNED} GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY source, axis ORDER BY n DESC, label) AS rank FROM (SELECT * FROM t UNION ALL SELECT * FROM m)) SELECT * FROM b WHERE rank <= CASE axis WHEN 'topic' THEN 3 ELSE 2 END",
        "label_shares": f"WITH {LABELLED} SELECT *, {rate('uncertain', 'n')} AS uncertain_rate, {rate('flagged', 'n')} AS flagged_rate FROM ({SHARES})",
        "orphan_children": f"WITH o AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')), a AS (SELECT (SELECT count(*) FROM lineitem) AS n_children, (SELECT count(*) FROM o) AS n_orphans, (SELECT coalesce(string_agg(l_orderkey::VARCHAR, ',' ORDER BY l_orderkey, l_linenumber), '') FROM (SELECT * FROM o ORDER BY l_orderkey, l_linenumber LIMIT 10)) AS examples) SELECT n_children, n_orphans, {rate('n_orphans', 'n_children')} AS orphan_rate, examples FROM a",
        "childless_parents": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
        "locatable_units": f"WITH {UNITS}, s AS (SELECT count(*) AS n, count(*) FILTER (WHERE p.doc_id IS NULL) AS orphans, count(*) FILTER (WHERE p.doc_id IS NOT NULL AND u.source <> p.source) AS mismatches, count(*) FILTER (WHERE u.source = p.source AND contains({squash('p.text')}, {squash('u.unit_text')})) AS located FROM units u LEFT JOIN documents p USING (doc_id)) SELECT *, {rate('located', 'n', 6, '1.0')} AS match_rate FROM s",
        "benchmark_containment": f"SELECT item_id, doc_id FROM documents d, benchmark b WHERE {squash('b.text')} <> '' AND contains(lower({squash('d.text')}), lower({squash('b.text')}))",
        "duplicate_groups": f"SELECT min(doc_id) AS first_id, count(*) AS size, array_to_string(list_slice(list(doc_id ORDER BY doc_id), 1, 5), ',') AS ids FROM documents WHERE {squash('text')} <> '' GROUP BY {squash('text')} HAVING count(*) > 1",
        "duplicate_summary": f"SELECT count(*) AS groups, coalesce(sum(size), 0)::BIGINT AS rows, coalesce(max(size), 1)::BIGINT AS largest FROM (SELECT count(*) AS size FROM documents WHERE {squash('text')} <> '' GROUP BY {squash('text')} HAVING count(*) > 1)",
        "dedup_canonical": f"SELECT doc_id, min(doc_id) OVER w AS canonical_id, doc_id = min(doc_id) OVER w AS is_canonical FROM documents WINDOW w AS (PARTITION BY CASE WHEN {squash('text')} = '' THEN '#' || doc_id ELSE '=' || {squash('text')} END)",
        "blank_profile": " UNION ALL ".join(_blank(t, c) for t, c in COLUMNS.items()),
        "key_uniqueness": " UNION ALL ".join(_unique(t, k) for t, k in {"documents": "doc_id", "orders": "o_orderkey", "labels": "doc_id", "lineitem": "l_orderkey", "conversations": "conv_id", "pages": "page_id", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "nation": "n_nationkey", "region": "r_regionkey"}.items()),
        "url_hits": " UNION ALL ".join([_url("pages", "url"), _url("pages", "html"), _url("documents", "text")]),
        "insights": f"WITH {INSIGHTS} SELECT * FROM ins",
        "actions": f"WITH {INSIGHTS} SELECT * FROM acts",
        "evaluation_status": f"WITH {EVALUATION} SELECT *, CASE WHEN blockers = '' THEN 'PASS' ELSE 'BLOCKED' END AS status FROM ev",
        "metric_gate": f"WITH {EVALUATION}, sh AS ({SHARES}), {_METRICS}, lim(metric, lo, hi, level) AS (VALUES {_LIMITS}) SELECT lim.metric, value, level, CASE WHEN value IS NOT NULL AND (lo IS NULL OR value >= lo) AND (hi IS NULL OR value <= hi) THEN 'PASS' WHEN level = 'block' THEN 'BLOCKED' ELSE 'WARN' END AS status FROM lim LEFT JOIN m ON m.metric = lim.metric",
        "stratified_sample": f"WITH {SAMPLED}, s AS (SELECT d.evidence_id, d.pick, {', '.join('l.' + x for x in DIMS)}, {" || '|' || ".join('coalesce(l.' + x + ", '')" for x in DIMS)} AS k FROM drawn d JOIN labelled l USING (evidence_id)), c AS (SELECT k, printf('S%03d', row_number() OVER (ORDER BY min(pick))) AS stratum_code FROM s GROUP BY k) SELECT evidence_id, pick, stratum_code, {', '.join(DIMS)} FROM s JOIN c USING (k)",
        "sample_coverage": f"WITH {SAMPLED}, s AS (SELECT l.* FROM drawn d JOIN labelled l USING (evidence_id)) " + " UNION ALL ".join(f"SELECT '{d}' AS dim, {d} AS value, count(*) AS n FROM s GROUP BY {d}" for d in DIMS),
        "blind_sample": f"WITH {BLIND} SELECT * FROM blind",
        "balanced_quota": f"SELECT * FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {seeded(f'{SEED}|quota', 'doc_id')}, doc_id) AS place FROM documents) WHERE place <= {QUOTA}",
        "mock_reviews": f"WITH {UNITS}, src AS (SELECT evidence_id AS blinded_item_id, unit_text AS txt FROM units),{review_ctes('src')} SELECT * EXCLUDE (evidence_text) FROM reviews",
        "consensus_rows": f"WITH {CONSENSUS} SELECT * FROM cons2",
        "agreement_summary": f"WITH {CONSENSUS} " + _rows({"three_way_agreement": "agreement_level = 'unanimous'", "majority_agreement": "agreement_level IN ('unanimous', 'majority')", "mechanism_dispute": "agreement_level IN ('disputed', 'boundary_disputed')", "topic_dispute": "topic_a <> topic_b OR topic_b <> topic_c", "boundary_dispute": "boundary_agreement = 'disagree'", "needs_adjudication": "needs_adjudication"}),
        "pairwise_agreement": f"WITH {CONSENSUS} " + _rows({f"{x}_{y}": f"mech_{x} = mech_{y}" for x, y in (("a", "b"), ("a", "c"), ("b", "c"))}),
        "fleiss_kappa": f"WITH {CONSENSUS}, k AS (SELECT count(*) AS n, sum({_PI} - 3) / (count(*) * 6.0) AS po, {_PE} AS pe FROM cons2) SELECT n, CASE WHEN n = 0 THEN NULL WHEN abs(1 - pe) < 1e-12 THEN 1.0 ELSE round((po - pe) / (1 - pe), 4) + 0.0 END::DOUBLE AS kappa FROM k",
        "per_label_unanimity": f"WITH {CONSENSUS}, l(label) AS (VALUES {', '.join(f'({q(c)})' for c in LABELS)}), c AS (SELECT consensus_mechanism AS label, count(*) AS k, count(*) FILTER (WHERE agreement_level = 'unanimous') AS u FROM cons2 GROUP BY 1) SELECT label, coalesce(k, 0) AS consensus_count, {rate('u', 'k', 4, 'NULL')} AS unanimous_rate FROM l LEFT JOIN c USING (label)",
        "label_confusion": f"WITH {CONSENSUS} SELECT current_label, consensus, count(*) AS n FROM cc GROUP BY ALL",
        "label_transitions": f"WITH {CONSENSUS}, s AS (SELECT count(*) FILTER (WHERE current_label = 'uncertain') AS current_uncertain_count, count(*) FILTER (WHERE current_label = 'uncertain' AND consensus NOT IN ('uncertain', 'no_consensus')) AS uncertain_to_concrete, count(*) FILTER (WHERE current_label = 'uncertain' AND consensus = 'no_consensus') AS uncertain_no_consensus, count(*) FILTER (WHERE current_label <> 'uncertain') AS current_concrete_count, count(*) FILTER (WHERE current_label <> 'uncertain' AND consensus = 'uncertain') AS concrete_to_uncertain FROM cc) SELECT *, {rate('current_uncertain_count - uncertain_to_concrete', 'current_uncertain_count', 4, 'NULL')} AS uncertain_retained_rate, {rate('uncertain_to_concrete', 'current_uncertain_count', 4, 'NULL')} AS uncertain_to_concrete_rate, {rate('concrete_to_uncertain', 'current_concrete_count', 4, 'NULL')} AS concrete_to_uncertain_rate FROM s",
        "retest_consistency": f"WITH {REVIEWS}, p AS (SELECT min(mechanism_label) AS lo, max(mechanism_label) AS hi FROM reviews JOIN blind USING (blinded_item_id) WHERE retest_group_id <> '' GROUP BY retest_group_id, reviewer_id HAVING count(*) = 2), s AS (SELECT count(*) FILTER (WHERE lo = hi) AS numerator, count(*) AS denominator FROM p) SELECT *, {rate('numerator', 'denominator', 4, 'NULL')} AS rate FROM s",
        "krippendorff_alpha": f"WITH {REVIEWS}, c AS (SELECT blinded_item_id, mechanism_label, count(*) AS k FROM reviews GROUP BY ALL), i AS (SELECT blinded_item_id, sum(k) AS m, sum(k * (k - 1)) AS same FROM c GROUP BY 1 HAVING sum(k) > 1), t AS (SELECT sum(m)::BIGINT AS n, sum((m * (m - 1) - same) / (m - 1)) AS d FROM i), l AS (SELECT sum(k * k) AS sq FROM (SELECT mechanism_label, sum(k) AS k FROM c JOIN i USING (blinded_item_id) GROUP BY 1)) SELECT n, round(1 - d / ((n * n - sq) / (n - 1)), 4)::DOUBLE AS alpha FROM t, l",
        "dispute_pairs": f"WITH {CONSENSUS} SELECT first, second, count(*) AS n FROM pairs GROUP BY ALL ORDER BY n DESC, min(blinded_item_id), first, second LIMIT 5",
        "boundary_proposals": f"WITH {CONSENSUS}, m AS (SELECT 'trust vs belonging' AS label_pair, source_id FROM pairs WHERE first = 'belonging' AND second = 'trust' UNION ALL SELECT 'belonging vs competence', source_id FROM pairs WHERE first = 'belonging' AND second = 'competence' UNION ALL SELECT DISTINCT 'concrete_label vs uncertain', source_id FROM pairs WHERE first = 'uncertain' OR second = 'uncertain'), p(label_pair) AS (VALUES ('trust vs belonging'), ('belonging vs competence'), ('concrete_label vs uncertain')) SELECT label_pair, count(source_id) AS sample_count, coalesce(array_to_string(list_slice(list(source_id ORDER BY source_id) FILTER (WHERE source_id IS NOT NULL), 1, 2), ','), '') AS examples, CASE WHEN count(source_id) >= 5 THEN 'high' ELSE 'medium' END AS review_priority FROM p LEFT JOIN m USING (label_pair) GROUP BY label_pair",
        "validation_problems": f"WITH {PROBLEMS} SELECT reviewer_id, problems, count(*) AS n FROM judged GROUP BY ALL",
        "run_reports": f"WITH {PROBLEMS} SELECT run_id, reviewer_id, count(*) AS attempted, count(*) FILTER (WHERE problems = '') AS accepted, count(*) FILTER (WHERE problems <> '') AS rejected, {rate(_ACCEPTED, 'count(*)', 4)} AS parse_success_rate FROM judged GROUP BY run_id, reviewer_id",
        "resume_remaining": f"WITH {BLIND} SELECT blinded_item_id FROM blind WHERE blinded_item_id > 'CAL_0100'",
        "lint_findings": f"WITH {FINDINGS} SELECT * FROM findings",
        "lint_rollup": f"WITH {FINDINGS} SELECT issue_type, priority, count(*) AS n, count(DISTINCT file_path) AS files FROM findings GROUP BY ALL",
        "lint_gate": f"WITH {FINDINGS} " + " UNION ALL ".join(_gate(lv, i) for i, lv in enumerate(("P0", "P1", "P2"))),
        "html_visible_lines": "WITH l AS (SELECT page_id AS file_path, generate_subscripts(x, 1) AS line_number, unnest(x) AS raw FROM (SELECT page_id, regexp_split_to_array(replace(coalesce(html, ''), '<', chr(10) || '<'), '\r\n|\n|\r') AS x FROM pages)), s AS (SELECT *, contains(lower(raw), '</script>') OR contains(lower(raw), '</style>') AS c, regexp_matches(lower(raw), '<(script|style)\\b') AS o FROM l), w AS (SELECT *, coalesce(last_value(CASE WHEN c THEN 0 WHEN o THEN 1 END IGNORE NULLS) OVER (PARTITION BY file_path ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside FROM s) SELECT file_path, line_number, raw FROM w WHERE inside = 0 AND NOT o",
        "pii_mask_counts": _pii(),
        "normalised_labels": f"WITH {LABELLED} SELECT surface_topic, count(*) AS n, count(*) FILTER (WHERE surface_topic = 'other_uncertain') AS filled FROM labelled GROUP BY 1",
        "merged_counters": "WITH d AS (SELECT source AS key, count(*) AS n FROM documents GROUP BY 1) SELECT key, max(n)::BIGINT AS n FROM (SELECT * FROM d UNION ALL SELECT key, n - length(key) FROM d UNION ALL VALUES ('src0', 50), ('other', 7)) GROUP BY key",
        "source_shift": f"WITH {LABELLED}, c AS (SELECT source, mechanism_label, count(*) AS k FROM labelled GROUP BY ALL), t AS (SELECT source, sum(k)::BIGINT AS n FROM c GROUP BY 1) SELECT source, n, mechanism_label AS top_label, {rate('k', 'n', 4)} AS top_share FROM c JOIN t USING (source) QUALIFY row_number() OVER (PARTITION BY source ORDER BY k DESC, mechanism_label DESC) = 1",
        "field_completion": " UNION ALL ".join(f"SELECT '{c}_completion' AS metric, {rate('k', 'n', 4, '1.0')} AS value FROM (SELECT count(*) AS n, count(*) FILTER (WHERE trim(coalesce({c}::VARCHAR, ''), {WS}) <> '') AS k FROM documents)" for c in ("text", "lang", "source")),
        "single_platform_support": f"WITH {LABELLED} SELECT surface_topic, mechanism_label, count(DISTINCT source) AS platforms, count(DISTINCT lang) AS langs, count(DISTINCT source) = 1 AS single FROM labelled WHERE {ASSIGNED} AND surface_topic <> '' GROUP BY ALL",
        "audit_short_texts": f"SELECT source, count(*) AS n, count(*) FILTER (WHERE length({_cleaned('text')}) < 8) AS short FROM documents GROUP BY source",
        "digest_classes": "SELECT (list_sum(list_transform(string_split(sha256(doc_id::VARCHAR), ''), lambda x: ('0x' || x)::INT)) % 3)::INT AS remainder, count(*) AS n FROM documents GROUP BY 1",
        "candidate_register": "SELECT printf('CAND_%04d', i + 1) AS candidate_id, ['alpha', 'beta', 'gamma'][i // 4 + 1] AS platform, ['price', 'trust'][(i // 2) % 2 + 1] AS keyword, 'placeholder ' || (i % 2 + 1) AS title, '' AS notes FROM range(12) t(i)",
    }
    from .more_sql import more_sql

    out |= more_sql()
    out |= {f"rated_distribution_{c}": _distribution(t, c) for t, c in (("documents", "source"), ("events", "event_type"), ("conversations", "role"))}
    return out
