"""SQL that gives the catalogue's results, written from the operators' definitions and not from their plans."""

from __future__ import annotations

from lodestream import config

NOW = "TIMESTAMPTZ '2025-06-01 00:00:00+00'"
_SIGNALS = """
  SELECT dedupe_key, company_id, min(regexp_replace(trim(lower(event_type)), '[ _-]+', '_', 'g')) AS full_type, min(observed_at) AS observed_at,
         max(CASE WHEN confidence > 1 THEN confidence / 100 ELSE confidence END) AS confidence
  FROM signal_event WHERE trim(event_type) <> '' GROUP BY dedupe_key, company_id
"""
_WEIGHTS = (
    ("concept_first_seen", 15), ("competitor_touch", 14), ("role_first_seen", 18), ("tech_first_seen", 10), ("product_launch", 18), ("exec_departure", 16), ("funding_round", 30), ("concept_spike", 20),
    ("gov_contract", 20), ("hiring_surge", 14), ("news_mention", 10), ("tech_dropped", 12), ("acquisition", 20), ("partnership", 10), ("social_post", 8), ("job_change", 15), ("role_spike", 14),
    ("engagement", 12), ("exec_hire", 18), ("expansion", 12), ("layoffs", 16),
)
_KNOWN = "|".join(k for k, _ in _WEIGHTS)
_HEAT = f"""
  SELECT company_id, event_type, (CASE event_type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in _WEIGHTS)} ELSE 10 END)
         * exp(-floor((epoch_us({NOW}) - epoch_us(observed_at)) / 86400000000.0) / 30.0) * coalesce(confidence, 1.0) AS contribution
  FROM (SELECT *, coalesce(nullif(regexp_extract(full_type, '^({_KNOWN})', 1), ''), full_type) AS event_type FROM ({_SIGNALS}))
"""
_RESULTS = "SELECT DISTINCT id, company_id, captured_at, hiring_count, hiring_roles, tech_stack FROM company_signal_result"
_PAIRED = f"""
  SELECT *, lag(id) OVER w AS prev_id, lag(hiring_count) OVER w AS prev_count, lag(hiring_roles) OVER w AS prev_roles, lag(tech_stack) OVER w AS prev_tech
  FROM ({_RESULTS}) WINDOW w AS (PARTITION BY company_id ORDER BY captured_at, id)
"""
_POSTS = "SELECT DISTINCT id, company_id, title, role_family, concepts, first_seen_at, closed_at FROM discovery_job_post"
_WATCH = "SELECT DISTINCT org_id, discovery_company_id AS id FROM company WHERE deleted_at IS NULL AND discovery_company_id IS NOT NULL"
_RANKED = f"""
  SELECT * FROM (
    SELECT w.org_id, w.id, c.updated_at, row_number() OVER (PARTITION BY w.org_id ORDER BY c.updated_at ASC NULLS FIRST, w.id) AS org_rank
    FROM ({_WATCH}) w JOIN (SELECT id, max(updated_at) AS updated_at FROM discovery_company GROUP BY id) c ON w.id = c.id
    WHERE c.updated_at IS NULL OR c.updated_at < {NOW} - INTERVAL 20 HOUR)
  WHERE org_rank <= 5
"""
_SEEN = "SELECT id, max(last_seen_at) AS last_seen_at FROM discovery_company GROUP BY id"
_FAMILY = lambda t: "CASE " + " ".join(f"WHEN contains(lower(coalesce({t}, '')), '{n}') THEN '{f}'" for n, f in config.ROLE_RULES) + " ELSE 'other' END"
_FILLED = ("domain", "industry", "headquarters", "hq_city", "hq_region", "hq_country", "funding", "employee_range")
_STATES = ", ".join(f"('{k}', '{v}')" for k, v in config.STATE_CODES.items())

ORACLES: dict[str, str] = {
    "pending_scan": """
SELECT DISTINCT id, name, created_at FROM discovery_company
WHERE signal_enrichment_status = 'pending' AND domain IS NOT NULL AND domain_resolved ORDER BY created_at, id LIMIT 50
""",
    "claim_transition": """
SELECT DISTINCT id, CASE WHEN signal_enrichment_status IN ('pending', 'processing') THEN 'processing' ELSE signal_enrichment_status END AS status,
       CAST(signal_attempt_count + CASE WHEN signal_enrichment_status IN ('pending', 'processing') THEN 1 ELSE 0 END AS INTEGER) AS attempts
FROM discovery_company
""",
    "scheduler_metrics": """
WITH c AS (SELECT DISTINCT id, signal_enrichment_status AS st, headcount, domain, created_at FROM discovery_company)
SELECT (SELECT count(*) FROM c WHERE st = 'pending') AS n_pending, (SELECT count(*) FROM c WHERE st = 'processing') AS n_processing,
       (SELECT count(*) FROM c WHERE st = 'enriched') AS n_enriched, (SELECT count(*) FROM c WHERE st = 'failed') AS n_failed,
       (SELECT count(*) FROM c WHERE headcount IS NULL OR headcount = 0) AS n_no_headcount,
       (SELECT max(created_at) FROM c) AS last_created, (SELECT max(created_at) FROM c WHERE st = 'enriched') AS last_enriched_created
""",
    "reconcile_backlog": f"""
SELECT id, status, attempts FROM (
  SELECT DISTINCT id, signal_enrichment_status AS status, signal_attempt_count AS attempts, created_at FROM discovery_company
  WHERE signal_enrichment_status IN ('failed', 'pending', 'partial') AND signal_attempt_count < 3
    AND (created_at IS NULL OR epoch_us({NOW}) - epoch_us(created_at) > power(2.0, least(coalesce(signal_attempt_count, 0), 4)) * 60000000))
ORDER BY CASE status WHEN 'failed' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END, created_at NULLS FIRST, id LIMIT 50
""",
    "stuck_count": f"""
SELECT count(*) AS n_stuck FROM (
  SELECT id, signal_enrichment_status AS st, max(updated_at) AS u FROM discovery_company GROUP BY ALL)
WHERE st = 'pending' AND (u IS NULL OR u < {NOW} - INTERVAL 60 DAY)
""",
    "keyset_page": "SELECT id, min(name) AS name FROM tracked_company WHERE id > 'tc_000000100' GROUP BY id ORDER BY id LIMIT 100",
    "head_count_missing": """
SELECT id, updated_at FROM (SELECT id, headcount, max(updated_at) AS updated_at FROM discovery_company GROUP BY id, headcount)
WHERE coalesce(headcount, 0) = 0 ORDER BY updated_at DESC, id LIMIT 100
""",
    "head_office_strings": """
SELECT DISTINCT trim(headquarters) AS headquarters FROM discovery_company WHERE trim(headquarters) <> '' AND hq_city IS NULL ORDER BY 1 LIMIT 200
""",
    "count_distinct_head_offices": "SELECT count(DISTINCT headquarters) AS n_distinct, count(*) AS n_rows FROM discovery_company",
    "fill_rates": " UNION ALL ".join(
        f"SELECT '{c}' AS field, count(*) AS n_rows, count(*) FILTER (trim({c}) <> '') AS n_filled, round(count(*) FILTER (trim({c}) <> '') / greatest(count(*), 1), 6) AS filled_share FROM discovery_company" for c in _FILLED
    )
    + " UNION ALL SELECT 'headcount', count(*), count(*) FILTER (headcount > 0), round(count(*) FILTER (headcount > 0) / greatest(count(*), 1), 6) FROM discovery_company",
    "status_histogram": "SELECT signal_enrichment_status, count(DISTINCT id) AS n FROM discovery_company GROUP BY 1",
    "language_histogram": "SELECT lower(split_part(coalesce(lang, '?'), '-', 1)) AS lang, count(*) AS n, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS n_chars FROM documents GROUP BY 1",
    "funnel_status": """
SELECT status, count(*) AS n FROM (
  SELECT CASE WHEN funding_stage IS NOT NULL THEN 'enriched' WHEN coalesce(hiring_count, 0) > 0 OR coalesce(len(tech_stack), 0) > 0 THEN 'partial' ELSE 'failed' END AS status
  FROM (SELECT DISTINCT id, hiring_count, tech_stack, funding_stage FROM company_signal_result)) GROUP BY 1
""",
    "watched_stale_ranked": f"SELECT org_id, CAST(org_rank AS INTEGER) AS org_rank, id, updated_at FROM ({_RANKED})",
    "fair_share_select": f"""
SELECT org_id, CAST(org_rank AS INTEGER) AS org_rank, id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY org_rank, org_id) AS k FROM ({_RANKED}))
WHERE k = 1 ORDER BY org_rank, org_id, id LIMIT 60
""",
    "cold_index": f"""
SELECT id, last_seen_at FROM ({_SEEN}) c WHERE NOT EXISTS (SELECT 1 FROM ({_WATCH}) w WHERE w.id = c.id)
  AND NOT (last_seen_at > {NOW} - INTERVAL 90 DAY) ORDER BY last_seen_at, id LIMIT 100
""",
    "recently_seen_index": f"""
SELECT id, last_seen_at FROM ({_SEEN}) c WHERE NOT EXISTS (SELECT 1 FROM ({_WATCH}) w WHERE w.id = c.id)
  AND last_seen_at > {NOW} - INTERVAL 90 DAY ORDER BY last_seen_at DESC NULLS LAST, id LIMIT 100
""",
    "watched_distinct": f"SELECT DISTINCT c.id, c.name FROM discovery_company c JOIN ({_WATCH}) w ON w.id = c.id",
    "latest_snapshot": f"""
SELECT company_id, id, captured_at, hiring_count FROM (
  SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY captured_at DESC, id DESC) AS k FROM ({_RESULTS})) WHERE k = 1
""",
    "hiring_surges": f"""
SELECT company_id, captured_at, CAST(prev_count AS BIGINT) AS prev_count, CAST(hiring_count AS BIGINT) AS curr_count,
       CAST(round((hiring_count - prev_count) / prev_count * 100, 0) AS BIGINT) AS percent
FROM ({_PAIRED}) WHERE coalesce(prev_count, 0) > 0 AND coalesce(hiring_count, 0) >= prev_count * 1.5
""",
    "role_families_first_seen": f"""
WITH p AS ({_PAIRED}),
cur AS (SELECT DISTINCT company_id, captured_at, id, {_FAMILY('r')} AS role_family FROM (SELECT company_id, captured_at, id, unnest(hiring_roles) AS r FROM p WHERE prev_id IS NOT NULL)),
old AS (SELECT DISTINCT id, {_FAMILY('r')} AS role_family FROM (SELECT id, unnest(prev_roles) AS r FROM p WHERE prev_id IS NOT NULL))
SELECT company_id, captured_at, role_family FROM cur WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.id = cur.id AND old.role_family = cur.role_family)
""",
    "tech_adopt_drop": f"""
WITH p AS (SELECT * FROM ({_PAIRED}) WHERE prev_id IS NOT NULL),
cur AS (SELECT DISTINCT company_id, captured_at, id, unnest(tech_stack) AS item FROM p),
old AS (SELECT DISTINCT company_id, captured_at, id, unnest(prev_tech) AS item FROM p)
SELECT company_id, captured_at, item, 'first_seen' AS change FROM cur WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.id = cur.id AND old.item = cur.item)
UNION ALL
SELECT company_id, captured_at, item, 'dropped' FROM old WHERE NOT EXISTS (SELECT 1 FROM cur WHERE old.id = cur.id AND old.item = cur.item)
""",
    "role_spikes": f"""
SELECT company_id, role_family, count(*) AS open_posts FROM ({_POSTS}) WHERE closed_at IS NULL AND role_family IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3
""",
    "concept_spikes": f"""
SELECT company_id, lower(c) AS concept, count(*) AS n_posts FROM (
  SELECT company_id, unnest(concepts) AS c FROM ({_POSTS}) WHERE closed_at IS NULL AND first_seen_at > TIMESTAMPTZ '2025-04-01 00:00:00+00' - INTERVAL 120 DAY)
GROUP BY 1, 2 HAVING count(*) >= 2
""",
    "concepts_first_seen": f"""
WITH e AS (SELECT company_id, first_seen_at, closed_at, lower(unnest(concepts)) AS concept FROM ({_POSTS}))
SELECT DISTINCT company_id, concept FROM e
WHERE first_seen_at > TIMESTAMPTZ '2025-04-01 00:00:00+00' - INTERVAL 60 DAY AND closed_at IS NULL AND concept IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM e o WHERE o.company_id IS NOT DISTINCT FROM e.company_id AND e.company_id IS NOT NULL
                  AND o.first_seen_at < TIMESTAMPTZ '2025-04-01 00:00:00+00' - INTERVAL 60 DAY AND (o.concept IS NULL OR o.concept = e.concept))
""",
    "role_family_histogram": f"SELECT {_FAMILY('title')} AS family, count(*) AS n FROM ({_POSTS}) GROUP BY 1",
    "keyed_merge": """
WITH a AS (SELECT user_id, event_type, max(ts) AS l, min(ts) AS f, max(value) AS v FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1, 2),
b AS (SELECT user_id, event_type, max(ts) AS l, min(ts) AS f, max(value) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1, 2)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, coalesce(greatest(a.l, b.l), a.l, b.l) AS last_seen,
       coalesce(a.f, b.f) AS first_seen, round(coalesce(greatest(a.v, b.v), a.v, b.v), 6) AS top_value
FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type
""",
    "close_missing": """
WITH s AS (SELECT DISTINCT snapshot_on, company_id, lower(trim(external_id)) AS external_id FROM job_post_snapshot WHERE trim(external_id) <> '' AND snapshot_on IS NOT NULL),
l AS (SELECT company_id, external_id, max(snapshot_on) AS last_on FROM s GROUP BY 1, 2)
SELECT company_id, external_id, (SELECT min(snapshot_on) FROM s WHERE s.company_id = l.company_id AND s.snapshot_on > l.last_on) AS closed_on FROM l
""",
    "json_patch": """
SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'patched' ELSE json_extract_string(props, '$.k') END AS k, CASE WHEN event_type = 'purchase' THEN 'yes' END AS seen FROM events
""",
    "insert_ignore": """
SELECT dedupe_key, id FROM (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY observed_at, id) AS k FROM signal_event WHERE observed_at >= TIMESTAMPTZ '2025-01-01 00:00:00+00')
WHERE k = 1 AND dedupe_key NOT IN (SELECT dedupe_key FROM signal_event WHERE observed_at < TIMESTAMPTZ '2025-01-01 00:00:00+00')
""",
    "heat_scores": f"SELECT company_id, round(sum(contribution), 4) AS raw_heat, CAST(least(100, round_even(round(sum(contribution), 4), 0)) AS INTEGER) AS heat FROM ({_HEAT}) GROUP BY 1",
    "heat_reasons": f"""
SELECT company_id, event_type, contribution, CAST(place AS INTEGER) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY contribution DESC, event_type) AS place FROM (
    SELECT company_id, event_type, round(sum(contribution), 4) AS contribution FROM ({_HEAT}) GROUP BY 1, 2) WHERE contribution > 0) WHERE place <= 3
""",
    "story_cluster": f"""
WITH t AS (SELECT dedupe_key, company_id, min(payload->>'$.key') AS key FROM signal_event WHERE trim(event_type) <> '' GROUP BY 1, 2)
SELECT company_id, full_type, story, count(*) AS n_reports, round(least(0.95, first(confidence ORDER BY observed_at, dedupe_key) + 0.05 * (count(*) - 1)), 6) AS confidence
FROM (SELECT s.*, coalesce(key, strftime(observed_at AT TIME ZONE 'UTC', '%Y-%m')) AS story FROM ({_SIGNALS}) s JOIN t USING (dedupe_key, company_id)) GROUP BY 1, 2, 3
""",
    "recent_event_counts": f"""
SELECT full_type, count(*) FILTER (observed_at > {NOW} - INTERVAL 7 DAY) AS n_7d, count(*) FILTER (observed_at > {NOW} - INTERVAL 30 DAY) AS n_30d,
       count(*) FILTER (observed_at > {NOW} - INTERVAL 90 DAY) AS n_90d, count(*) AS n FROM ({_SIGNALS}) GROUP BY 1
""",
    "funding_grounding": r"""
WITH r AS (SELECT DISTINCT id, company_id, funding_stage, total_raised FROM company_signal_result),
e AS (SELECT id AS company_id, min(funding) AS funding FROM discovery_company GROUP BY 1),
j AS (SELECT r.*, lower(coalesce(funding, '')) AS t, trim(lower(coalesce(funding_stage, ''))) AS said FROM r LEFT JOIN e USING (company_id)),
f AS (SELECT *, trim(t) <> '' AND (said = '' OR contains(t, said)) AS fine FROM j)
SELECT id, CASE WHEN fine THEN 'raised $5m;new office' ELSE 'new office' END AS signals, CASE WHEN fine THEN 60 ELSE 35 END AS score,
       CASE WHEN fine THEN funding_stage END AS funding_stage, CASE WHEN fine THEN total_raised END AS total_raised FROM f
""",
    "state_codes": f"""
WITH s AS (SELECT DISTINCT state, trim(lower(state)) AS v FROM tracked_company),
codes(name, code) AS (VALUES {_STATES})
SELECT state, CASE
  WHEN length(v) = 2 AND v IN (SELECT code FROM codes) THEN v
  WHEN v IN (SELECT name FROM codes) THEN (SELECT code FROM codes WHERE name = v)
  WHEN EXISTS (SELECT 1 FROM codes WHERE regexp_matches(v, '\\b' || name || '\\b')) THEN
    (SELECT first(code ORDER BY name) FROM codes WHERE regexp_matches(v, '\\b' || name || '\\b'))
  WHEN regexp_extract(v, '\\b([a-z]{{2}})\\b\\s*\\d{{0,5}}\\s*$', 1) IN (SELECT code FROM codes) THEN regexp_extract(v, '\\b([a-z]{{2}})\\b\\s*\\d{{0,5}}\\s*$', 1) END AS code
FROM s
""".replace("\\\\", "\\"),
    "page_fingerprints": r"""
SELECT doc_id, CASE WHEN length(t) < 100 THEN '' ELSE substr(sha1(lower(regexp_replace(t, b, ' ', 'g'))), 1, 16) END AS fingerprint
FROM (SELECT doc_id, b, regexp_replace(regexp_replace(coalesce(text, ''), '^' || b, ''), b || '$', '') AS t
      FROM documents, (SELECT '[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+' AS b))
""",
    "inverted_index": r"""
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (
  SELECT doc_id, unnest(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\pL\pM\pN]+', ' ', 'g')), ' ')) AS term FROM documents) WHERE term <> '' GROUP BY 1
""",
    "rounded_head_counts": """
WITH c AS (SELECT DISTINCT id, headcount AS n FROM discovery_company),
s AS (SELECT *, CASE WHEN n < 100 THEN 10 WHEN n < 1000 THEN 50 ELSE 100 END AS step FROM c),
h AS (SELECT *, n // step AS q, n % step AS r FROM s),
k AS (SELECT *, step * CASE WHEN r * 2 > step OR (r * 2 = step AND q % 2 = 1) THEN q + 1 ELSE q END AS near FROM h)
SELECT id, CAST(CASE WHEN n <= 0 THEN 0 WHEN n < 100 THEN greatest(10, near) ELSE near END AS BIGINT) AS rounded,
       CASE WHEN n > 0 AND NOT (n BETWEEN 1900 AND 2026) THEN n END AS sane FROM k
""",
    "formatted_amounts": """
SELECT o_orderkey, CASE WHEN n >= 1000000 THEN replace(format('${:.1f}M', n / 1000000), '.0M', 'M') WHEN n >= 1000 THEN format('${:.0f}K', n / 1000) ELSE format('${:.0f}', n) END AS amount,
       CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS DOUBLE) AS parsed
FROM (SELECT *, round(o_totalprice) * 1000 + 1 AS n FROM orders)
""",
    "parsed_dates": """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (0, 1) THEN date_trunc('second', o_orderdate) ELSE date_trunc('day', o_orderdate) END AT TIME ZONE 'UTC' AS parsed FROM orders
""",
    "url_parts": r"""
SELECT draft_id, host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS root, nullif(regexp_extract(url, '^https?://[^/]+(?:/.*)?/([^/?#]+)/?$', 1), '') AS slug
FROM (SELECT DISTINCT draft_id, evidence_url AS url, regexp_replace(lower(regexp_extract(evidence_url, '^https?://([^/]+)', 1)), '^www\.', '') AS host FROM signal_event_draft WHERE evidence_url IS NOT NULL)
""",
    "vendor_edges": """
SELECT DISTINCT src_id, 'uses_vendor' AS edge_type, slug AS dst_id FROM (
  SELECT company_id AS src_id, trim(regexp_replace(lower(trim(unnest(list_slice(tech_stack, 1, 40)))), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM company_signal_result) WHERE length(slug) >= 1
""",
    "two_hops": """
SELECT o_custkey, count(DISTINCT s_nationkey) AS n_nations, count(*) AS n_suppliers FROM (
  SELECT DISTINCT o_custkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1
""",
    "reachable": """
WITH RECURSIVE e AS (SELECT DISTINCT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
w AS (SELECT src AS start, dst AS end_, 1 AS h FROM e UNION SELECT w.start, e.dst, w.h + 1 FROM w JOIN e ON w.end_ = e.src WHERE w.h < 3)
SELECT start, end_ AS "end", CAST(min(h) AS INTEGER) AS n_hops FROM w GROUP BY 1, 2
""",
    "pricing_summary": """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
       round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY 1, 2
""",
    "regional_revenue": """
SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2
""",
    "top_orders": """
SELECT l_orderkey, revenue, o_orderdate FROM (SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY 1)
JOIN orders ON l_orderkey = o_orderkey ORDER BY revenue DESC, l_orderkey LIMIT 20
""",
    "grouped_rollup": "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ROLLUP (event_type, CAST(ts AS DATE))",
    "session_lengths": """
WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AT TIME ZONE 'UTC' AS started, count(*) AS n FROM s GROUP BY user_id, k
""",
    "window_budget": "SELECT date_trunc('hour', ts) AT TIME ZONE 'UTC' AS window_start, count(*) AS n_calls, least(count(*), 13) AS n_admitted FROM events GROUP BY 1",
    "daily_cap": """
SELECT event_id, day, CAST(place AS INTEGER) AS place FROM (SELECT event_id, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS place FROM events) WHERE place <= 25
""",
    "rolling_yield": """
SELECT user_id, day, n, CAST(sum(n) OVER w AS BIGINT) AS last_sum, count(*) OVER w AS last_n
FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2) WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
""",
    "semantic_top_k": """
SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM (
  SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 4) AS score
  FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0) WHERE score >= 0) WHERE k <= 10
""",
    "page_tech": r"""
WITH d AS (SELECT doc_id, left(text, 600000) AS t, 'https://pages.example/' || coalesce(source, '') AS u FROM documents),
f AS (SELECT doc_id, 'sql' AS tech FROM d WHERE regexp_matches(t, '(?i)SELECT') UNION ALL SELECT doc_id, 'heading' FROM d WHERE regexp_matches(t, '(?i)<h2')
      UNION ALL SELECT doc_id, 'letter' FROM d WHERE regexp_matches(t, '(?i)Subscribe to') UNION ALL SELECT doc_id, 'news' FROM d WHERE regexp_matches(u, '(?i)news')
      UNION ALL SELECT doc_id, 'pages' FROM d WHERE regexp_matches(u, '(?i)pages')),
i AS (SELECT * FROM f UNION SELECT doc_id, 'markup' FROM f WHERE tech = 'heading'),
r AS (SELECT * FROM i WHERE tech <> 'letter' OR EXISTS (SELECT 1 FROM i x WHERE x.doc_id = i.doc_id AND x.tech = 'heading'))
SELECT doc_id, tech FROM r WHERE tech <> 'pages' OR NOT EXISTS (SELECT 1 FROM r x WHERE x.doc_id = r.doc_id AND x.tech = 'news')
""",
    "directory_keys": None,
}
ORACLES["multi_query_best"] = f"SELECT id, max(score) AS score, first(query_id ORDER BY score DESC, query_id) AS query_id FROM ({ORACLES['semantic_top_k']}) GROUP BY id"
ORACLES["centroid_rerank"] = """
WITH m AS (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2),
c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY 1)
SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), list_transform(list_zip(CAST(embedding AS DOUBLE[]), c), lambda z: z[1] * 0.7 + z[2] * 0.3)), 4) AS score
FROM embeddings JOIN c USING (label)
"""


def _directory_keys() -> str:
    """The suffixes are taken off one after the other, so the SQL is a chain of steps."""
    steps, last = ["b0 AS (SELECT DISTINCT id, name, domain, trim(lower(coalesce(name, ''))) AS b FROM tracked_company)"], "b0"
    for i, s in enumerate(config.DIRECTORY_SUFFIXES, 1):
        steps.append(f"b{i} AS (SELECT id, name, domain, CASE WHEN ends_with(b, '{s}') THEN trim(left(b, length(b) - {len(s)})) ELSE b END AS b FROM {last})")
        last = f"b{i}"
    stem = "split_part(replace(lower(domain), 'www.', ''), '.', 1)"
    return f"WITH {', '.join(steps)} SELECT id, name, regexp_replace(b, '[^a-z0-9]+', '', 'g') AS name_key, CASE WHEN length({stem}) >= 2 THEN {stem} END AS stem FROM {last}"


ORACLES["directory_keys"] = _directory_keys()


def _slug_directory() -> str:
    """Name keys of both tables by the same chain of suffix steps as above."""
    def chain(p: str, source: str) -> tuple[list[str], str]:
        steps, last = [f"{p}0 AS ({source})"], f"{p}0"
        for i, x in enumerate(config.DIRECTORY_SUFFIXES, 1):
            steps.append(f"{p}{i} AS (SELECT * EXCLUDE (b), CASE WHEN ends_with(b, '{x}') THEN trim(left(b, length(b) - {len(x)})) ELSE b END AS b FROM {last})")
            last = f"{p}{i}"
        return steps, last

    stem = "CASE WHEN length(split_part(replace(lower(domain), 'www.', ''), '.', 1)) >= 2 THEN split_part(replace(lower(domain), 'www.', ''), '.', 1) END"
    rows, r = chain("r", f"SELECT DISTINCT list_extract(['lever', 'greenhouse', 'ashby', 'workable'], length(name) % 4 + 1) AS board, {stem} AS slug, trim(lower(coalesce(name, ''))) AS b FROM tracked_company WHERE {stem} IS NOT NULL")
    asks, a = chain("a", f"SELECT DISTINCT id, {stem} AS stem, trim(lower(coalesce(name, ''))) AS b FROM discovery_company")
    order = "list_position([" + ", ".join(f"'{b}'" for b in config.BOARD_ORDER) + "], board)"
    return f"""WITH {', '.join(rows)}, {', '.join(asks)},
d AS (SELECT board, slug, regexp_replace(b, '[^a-z0-9]+', '', 'g') AS k, {order} AS o FROM {r} WHERE {order} > 0), q AS (SELECT id, stem, regexp_replace(b, '[^a-z0-9]+', '', 'g') AS k FROM {a}),
h AS (SELECT id, board, slug, 0 AS way, o FROM q JOIN d ON q.stem = d.slug UNION ALL SELECT id, board, slug, 1, o FROM q JOIN d ON q.k = d.k AND q.k <> '')
SELECT id AS company_id, board, slug FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY way, o, slug, board) AS n FROM h) WHERE n = 1"""


ORACLES["slug_directory"] = _slug_directory()
ORACLES["relevance_filter"] = r"""
WITH c AS (SELECT id AS company_id, min(name) AS name FROM discovery_company GROUP BY id),
j AS (SELECT d.*, name, list_filter(string_split(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 2) AS tok, lower(title) AS t,
             ' ' || regexp_replace(lower(title), '[^a-z0-9_]+', ' ', 'g') || ' ' AS padded, source IN ('company_feed', 'sec_edgar', 'sec_8k', 'usaspending', 'warn_notice', 'github', 'npm') AS trusted
      FROM (SELECT DISTINCT draft_id, company_id, title, source, confidence FROM signal_event_draft) d JOIN c USING (company_id)),
k AS (SELECT *, CASE WHEN len(tok) = 0 OR (len(tok) = 1 AND length(tok[1]) <= 4) THEN 0.5
        WHEN list_has_any(tok, string_split('scale ramp notion apollo stripe square circle linear beam flow wave spark pulse core base path bridge cloud data tech labs ai io', ' ')) THEN 0.6 ELSE 1.0 END AS m,
      CASE WHEN len(tok) >= 2 THEN len(list_filter(tok, lambda x: length(x) >= 4 AND contains(padded, ' ' || x || ' '))) > 0
        WHEN length(tok[1]) <= 4 THEN contains(t, tok[1]) AND length(t) < 80 ELSE contains(padded, ' ' || tok[1] || ' ') END AS said FROM j)
SELECT draft_id, CASE WHEN trusted OR m >= 1 THEN confidence ELSE CAST(round_even(CAST(coalesce(confidence, 0.85) * m AS DOUBLE), 3) AS DOUBLE) END AS confidence
FROM k WHERE trusted OR (len(tok) > 0 AND length(title) > 0 AND coalesce(said, false))
"""


def _sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_LEGAL_END = r"(?i)[\s,]+(?:holdings|incorporated|inc|llc|l\.l\.c|ltd|limited|corporation|corp|company|co|plc|gmbh|ag|sas|sa|sl|ab|pty|pvt)\.?$"


def _cleaned(x: str) -> str:
    bare = f"regexp_replace(regexp_replace(trim(coalesce({x}, '')), '{_LEGAL_END}', ''), '{_LEGAL_END}', '')"
    return f"trim(regexp_replace(lower(replace({bare}, '&', ' and ')), '[^a-z0-9]+', ' ', 'g'))"


def _name_keys(c: str) -> str:
    """The keys of a cleaned name, strictest first."""
    words, tokens = "|".join(config.NAME_DESCRIPTORS), f"string_split({c}, ' ')"
    tail = rf"regexp_replace(array_to_string(list_slice({tokens}, 3, 1000), ' '), '(?:^|\s+)(?:(?:{words})(?:\s+|$))+$', '')"
    core = f"list_sort(list_distinct(list_filter({tokens}, lambda t: NOT list_contains({_sql_list(config.NAME_DESCRIPTORS)}, t))))"
    return f"list_filter([{c}, 'c:' || replace({c}, ' ', ''), 't:' || trim(array_to_string(list_slice({tokens}, 1, 2), ' ') || ' ' || trim({tail})), CASE WHEN len({core}) >= 2 THEN 'k:' || array_to_string({core}, ' ') END], lambda k: k IS NOT NULL)"


def _weak(c: str) -> str:
    vague, common = _sql_list(dict.fromkeys((*config.GENERIC_TOKENS, *config.NAME_DESCRIPTORS))), _sql_list(config.COMMON_WORDS)
    compound = f"(length({c}) >= 6 AND len(list_filter(range(3, length({c}) - 2), lambda i: list_contains({common}, left({c}, i)) AND list_contains({common}, substr({c}, i + 1)))) > 0)"
    return (
        f"CASE WHEN {c} = '' THEN true WHEN NOT contains({c}, ' ') THEN length({c}) <= 3 OR list_contains({vague}, {c}) OR list_contains({common}, {c}) OR {compound} "
        f"ELSE len(list_filter(string_split({c}, ' '), lambda t: NOT (list_contains({vague}, t) OR length(t) <= 2))) = 0 END"
    )


ORACLES["weak_names"] = f"SELECT cleaned, {_weak('cleaned')} AS weak, array_to_string({_name_keys('cleaned')}, '|') AS keys FROM (SELECT DISTINCT {_cleaned('name')} AS cleaned FROM tracked_company)"
_CODES = ORACLES["state_codes"].replace("SELECT DISTINCT state, trim(lower(state)) AS v FROM tracked_company", "SELECT DISTINCT state, trim(lower(state)) AS v FROM (SELECT state FROM tracked_company UNION SELECT hq_region FROM discovery_company)")
ORACLES["entity_match"] = f"""
WITH sc AS ({_CODES}),
c AS (SELECT DISTINCT id, code AS state, unnest([{_cleaned('name')}, {_cleaned('apollo_org_name')}]) AS cleaned FROM discovery_company LEFT JOIN sc ON hq_region = sc.state),
ck AS (SELECT DISTINCT id AS company_id, state, unnest({_name_keys('cleaned')}) AS key FROM c WHERE cleaned <> ''),
p AS (SELECT id AS probe_id, code AS ps, {_cleaned('name')} AS cleaned FROM (SELECT id, min(name) AS name, min(state) AS state FROM tracked_company GROUP BY id) t LEFT JOIN sc ON t.state = sc.state),
w AS (SELECT probe_id, ps, {_weak('cleaned')} AS weak, {_name_keys('cleaned')} AS k FROM p WHERE cleaned <> ''),
a AS (SELECT probe_id, ps, weak, unnest(k) AS key, generate_subscripts(k, 1) - 1 AS pos FROM (SELECT probe_id, ps, weak, CASE WHEN weak THEN list_slice(k, 1, 2) ELSE k END AS k FROM w)),
h AS (SELECT probe_id, ps, weak, pos, count(DISTINCT company_id) AS n, min(company_id) AS one, max(state) AS one_state, count(DISTINCT company_id) FILTER (state = ps) AS n_state, min(company_id) FILTER (state = ps) AS state_one
      FROM a JOIN ck USING (key) GROUP BY 1, 2, 3, 4),
f AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY pos) AS r FROM h),
m AS (SELECT *, CASE WHEN n > 1 THEN CASE WHEN n_state = 1 THEN state_one END WHEN weak THEN CASE WHEN one_state = ps THEN one END WHEN one_state <> ps AND pos > 0 THEN NULL ELSE one END AS company_id FROM f WHERE r = 1)
SELECT probe_id, company_id, CAST(CASE WHEN pos = 0 THEN 100 ELSE 95 END AS INTEGER) AS score, ['exact', 'compact', 'trimmed', 'core'][pos + 1] AS reason FROM m WHERE company_id IS NOT NULL
"""
