"""DuckDB SQL for the derived profiles and everything computed from them.

Written over flat tables with joins, grouping and regular expressions, so that
it shares the fixed values with the engine but none of its expressions.
"""

from __future__ import annotations

import re

from profilerank import vocabulary as v
from profilerank.plans import derived as d

EDGE = r"[^\p{L}\p{N}_]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def arr(values) -> str:
    return "[" + ", ".join(q(x) for x in values) + "]"


def pick(values, index: str) -> str:
    shown = arr(values) if isinstance(values[0], str) else "[" + ", ".join(map(str, values)) + "]"
    return f"{shown}[(({index}) % {len(values)}) + 1]"


def rx(term: str) -> str:
    return re.sub(r"([.\\+*?\[^\]$(){}|/])", r"\\\1", term)


def word(term: str, col: str) -> str:
    if re.fullmatch(r"\w+", term):
        return f"regexp_matches({col}, {q(f'(?:^|{EDGE}){rx(term)}(?:{EDGE}|$)')})"
    return f"regexp_matches({col}, {q(chr(92) + 'b' + rx(term) + chr(92) + 'b')})"


def exact(term: str, col: str) -> str:
    if " " in term or "-" in term or term.startswith("<"):
        return f"contains({col}, {q(term)})"
    return word(term, col)


def sub(term: str, col: str) -> str:
    return f"contains({col}, {q(term)})"


def any_of(terms, col: str, test=sub) -> str:
    return "(" + " OR ".join(test(t, col) for t in terms) + ")"


def count_of(terms, col: str, test=sub) -> str:
    terms = list(dict.fromkeys(terms))
    return "(" + " + ".join(f"({test(t, col)})::INT" for t in terms) + ")"


def occurrences(words, col: str) -> str:
    plain = [w for w in words if " " not in w]
    rest = [w for w in words if " " in w]
    parts = [f"len(list_filter(regexp_extract_all({col}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: w IN ({', '.join(map(q, plain))})))"]
    parts += [f"len(regexp_extract_all({col}, {q(chr(92) + 'b' + rx(w) + chr(92) + 'b')}))" for w in rest]
    return "(" + " + ".join(parts) + ")"


def r(value: str, digits: int) -> str:
    return f"CAST(printf('%.{digits}f', {value}) AS DOUBLE)"


def total(items) -> str:
    """Compensated sum of a list of doubles."""
    pairs = ", ".join(f"{{'s': ({x})::DOUBLE, 'c': 0.0::DOUBLE}}" for x in items)
    return total_list(f"[{pairs}]")


def total_list(pairs: str) -> str:
    step = ("lambda a, x: {'s': a.s + x.s, 'c': a.c + CASE WHEN abs(a.s) >= abs(x.s) "
            "THEN (a.s - (a.s + x.s)) + x.s ELSE (x.s - (a.s + x.s)) + a.s END}")
    return f"(list_reduce({pairs}, {step}).s + list_reduce({pairs}, {step}).c)"


IR = tuple(dict.fromkeys(v.IR_BASE + v.RECOMMENDER + v.LEARNING_TO_RANK))
TODAY = "DATE '2026-06-15'"


def iso(col: str) -> str:
    return f"CASE WHEN regexp_full_match({col}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN TRY_CAST({col} AS DATE) END"


PROFILES = f"""
p_jobs AS (
  SELECT o_custkey AS id, pos, (pos - 1)::BIGINT AS idx,
    {pick(d.TITLES, 'o_orderkey')} AS title,
    rtrim({pick(d.WORK, 'o_orderkey')} || ' ' || {pick(d.EXTRA, 'o_orderkey * 7 + o_custkey')}) AS description,
    {pick(d.COMPANIES, 'o_orderkey')} AS company,
    {pick(d.INDUSTRIES, 'o_orderkey')} AS industry,
    {pick(d.SIZES, 'o_orderkey + o_custkey')} AS company_size,
    CASE WHEN o_orderkey % 37 = 0 THEN '15-06-2020' WHEN o_orderkey % 41 = 0 THEN ''
         ELSE CAST(began AS VARCHAR) END AS start_s,
    CASE WHEN pos = 1 THEN '' WHEN o_orderkey % 43 = 0 THEN 'unknown'
         ELSE CAST(ended AS VARCHAR) END AS end_s,
    CASE WHEN o_orderkey % 23 <> 0 THEN o_orderkey % 40 ELSE 0 END AS months,
    (pos = 1 OR (pos = 2 AND o_orderkey % 17 = 0)) AS is_current
  FROM (
    SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) + {d.DATE_SHIFT} AS began,
      row_number() OVER w AS pos, lag(CAST(o_orderdate AS DATE) + {d.DATE_SHIFT}) OVER w AS ended
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)
  )
),
p_skills AS (
  SELECT id, pos, name, level, months, endorsements,
    max(own_score) OVER (PARTITION BY id, name) AS test_score
  FROM (
    SELECT s.o_custkey AS id, s.pos,
      CASE WHEN s.l_partkey % 3 = 1 THEN p_name ELSE {pick(d.SKILLS, 's.l_partkey')} END AS name,
      CASE WHEN s.l_partkey % 7 <> 0 THEN {pick(d.LEVELS, 's.l_partkey')} END AS level,
      CASE WHEN s.l_partkey % 3 <> 0 THEN p_size ELSE 0 END AS months,
      CASE WHEN s.l_partkey % 3 <> 0 THEN CAST(l_quantity AS INT) ELSE 0 END AS endorsements,
      CASE WHEN s.l_partkey % 5 <> 0 THEN CAST((s.l_partkey * 13) % 101 AS DOUBLE) END AS own_score
    FROM (
      SELECT o_custkey, l_partkey, l_quantity, row_number() OVER (PARTITION BY o_custkey
        ORDER BY l_orderkey DESC, l_linenumber, l_partkey, l_suppkey, l_quantity) AS pos
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    ) s JOIN part ON p_partkey = s.l_partkey
  )
),
p_events AS (
  SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS n_purchase,
    count(*) FILTER (event_type = 'signup') AS n_signup, max(ts) AS last_ts
  FROM events GROUP BY user_id
),
p_base AS (
  SELECT c_custkey AS id, 'C' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS candidate_id,
    coalesce(text, '') AS summary,
    {pick(d.HEADLINES, 'c_custkey')} || ' ' || lower(c_mktsegment) AS headline,
    CASE WHEN c_custkey % 29 <> 0 THEN (SELECT title FROM p_jobs WHERE p_jobs.id = c_custkey AND pos = 1) END AS current_title,
    CASE WHEN c_nationkey % 5 = 0 THEN n_name WHEN c_nationkey % 5 = 1 THEN 'IN' ELSE 'India' END AS country,
    {pick(d.CITIES, 'c_custkey')} AS location,
    (c_custkey * 7 % 160) / 10.0::DOUBLE AS years,
    {"[" + ", ".join(q(' '.join(c)) for c in d.CERTIFICATES) + "]"}[(c_custkey % {len(d.CERTIFICATES)}) + 1] AS certs,
    CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 4 <> 1 END AS relocate,
    c_custkey % 3 <> 0 AS open_to_work,
    CASE WHEN c_custkey % 31 = 0 THEN '15-06-2026' WHEN c_custkey % 37 = 0 THEN ''
      WHEN last_ts IS NOT NULL THEN CAST(CAST(last_ts AS DATE) + {d.ACTIVITY_SHIFT} AS VARCHAR)
      ELSE CAST({TODAY} - CAST(c_custkey % 400 AS INT) AS VARCHAR) END AS last_active,
    CASE WHEN c_custkey % 13 <> 0 THEN CAST(DATE '2024-01-01' + CAST(c_custkey * 7 % 900 AS INT) AS VARCHAR) ELSE '' END AS signup,
    CASE WHEN c_custkey % 11 <> 0 THEN {pick(d.NOTICE, 'c_custkey')} ELSE 90 END AS notice_days,
    CASE WHEN n IS NOT NULL THEN n_purchase::DOUBLE / n WHEN c_custkey % 3 <> 0 THEN (c_custkey % 101)::DOUBLE / 100 ELSE 0 END AS response_rate,
    CASE WHEN n IS NOT NULL THEN n_signup::DOUBLE / n WHEN c_custkey % 7 <> 0 THEN (c_custkey * 3 % 101)::DOUBLE / 100 ELSE 0 END AS completion_rate,
    CASE WHEN c_custkey % 9 <> 0 THEN (c_custkey * 3 % 120 - 20)::DOUBLE ELSE -1 END AS github,
    (c_custkey % 2 = 0 OR (c_custkey % 5 <> 0 AND c_custkey % 3 = 0)) AS verified,
    c_custkey % 40 AS salary_min, c_custkey * 3 % 45 AS salary_max
  FROM (
    SELECT coalesce(c_custkey, doc_id) AS c_custkey, c_nationkey, coalesce(c_mktsegment, 'none') AS c_mktsegment, text
    FROM customer FULL JOIN documents ON doc_id = c_custkey
  ) LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN p_events ON user_id = c_custkey
)"""

TEXTS = f"""
j AS (
  SELECT *, lower(title) AS t, lower(description) AS de, lower(company) AS co, lower(industry) AS ind,
    {any_of(v.VISION_TITLES + v.UNRELATED_TITLES, 'lower(title)')} AS contra,
    {any_of(IR, 'lower(description)', exact)} AS ir,
    {any_of(v.SERVICE_FIRMS, 'lower(company)')} AS service
  FROM p_jobs
),
jt AS (
  SELECT id, lower(string_agg(description || ' ' || title, ' ' ORDER BY pos)) AS career,
    string_agg(de, ' ' ORDER BY pos) FILTER (NOT contra) AS trust
  FROM j GROUP BY id
),
st AS (SELECT id, lower(string_agg(name, ' ' ORDER BY pos)) AS skills FROM p_skills GROUP BY id),
x AS (
  SELECT p_base.*, coalesce(career, '') AS career, coalesce(trust, '') AS trust, coalesce(skills, '') AS skills,
    lower(concat_ws(' ', summary, headline, career, skills, certs)) AS full_t
  FROM p_base LEFT JOIN jt USING (id) LEFT JOIN st USING (id)
)"""

EVIDENCE = f"""
e AS (
  SELECT x.id, coalesce(bool_or(ir), false) AS found, coalesce(bool_or(ir AND NOT contra), false) AS trusted,
    coalesce(max(pos) FILTER (ir AND NOT contra AND is_current), min(pos) FILTER (ir AND NOT contra), min(pos) FILTER (ir)) AS ev_pos,
    any_value({any_of(IR, 'x.full_t', exact)}) AS anywhere
  FROM x LEFT JOIN j ON j.id = x.id GROUP BY x.id
),
er AS (
  SELECT e.*, j.end_s AS ev_end, j.is_current AS ev_current,
    CASE WHEN j.is_current OR j.end_s = '' THEN 1.0
      WHEN ({iso('substr(j.end_s, 1, 10)')}) IS NULL THEN 0.7
      WHEN date_diff('day', {iso('substr(j.end_s, 1, 10)')}, {TODAY}) / 365.25 <= 3 THEN 0.9
      WHEN date_diff('day', {iso('substr(j.end_s, 1, 10)')}, {TODAY}) / 365.25 <= 6 THEN 0.7 ELSE 0.5 END::DOUBLE AS recency
  FROM e LEFT JOIN j ON j.id = e.id AND j.pos = e.ev_pos
)"""


def tier(col: str) -> str:
    cases = " ".join(f"WHEN {any_of(words, col)} THEN {level}" for level, words in v.TITLE_TIERS)
    return f"CASE {cases} ELSE {v.DEFAULT_TIER} END"


ML_ROLE_TEST = lambda col: f"({any_of(v.ML_ROLE, col)} OR {word('ml', col)})"
PERCENT_TIMES = r"[0-9]\s*%|[0-9]x\s"
LOOSE = r"[0-9]+\s*%|[0-9]+x\s|improved|reduced|increased"
VERBS, METRICS, NOUNS = "|".join(v.OUTCOME_VERBS), "|".join(v.OUTCOME_METRICS), "|".join(v.OUTCOME_NOUNS)
STRICT = (rf"[0-9]+\s*%|[0-9]+x\s|[+-]?[0-9]+(?:\.[0-9]+)?\s*pp\b|(?:{VERBS})\s+[\w\-\s]{{0,30}}?(?:{METRICS})"
          rf"|(?:{METRICS})[\w\-\s]{{0,30}}?(?:{VERBS}|went from|from [0-9])")

CAREER = f"""
cj AS (
  SELECT id, pos, start_s, {tier('t')} AS tier,
    coalesce({iso('substr(start_s, 1, 10)')} <= {TODAY}, false)
      AND (CASE WHEN end_s = '' THEN {TODAY} ELSE coalesce({iso('substr(end_s, 1, 10)')}, {TODAY}) END) >= {TODAY} - 540
      AND ({any_of(v.CODING_TITLES, 't')} OR ({any_of(v.LEAD_TITLES, 't')} AND {any_of(v.BUILDER_VERBS, 'de', word)})) AS recent,
    ({ML_ROLE_TEST('t')} OR {ML_ROLE_TEST('de')}) AS ml
  FROM j
),
climb AS (
  SELECT id, bool_or(up) AS climbs, string_agg(CAST(tier AS VARCHAR), ',' ORDER BY start_s, pos) AS tiers FROM (
    SELECT *, coalesce(tier > lag(tier) OVER (PARTITION BY id ORDER BY start_s, pos), false) AS up FROM cj
  ) GROUP BY id
),
jc AS (
  SELECT j.id, count(*) AS n_jobs, bool_and(service) AS all_service,
    avg(months) FILTER (NOT is_current) AS tenure,
    bool_or(recent) AS recent, min(j.start_s) FILTER (ml) AS first_ml
  FROM j JOIN cj ON cj.id = j.id AND cj.pos = j.pos GROUP BY j.id
),
gap AS (
  SELECT id, least(1.0, sum(CASE WHEN test_score < ex - 15 THEN (ex - test_score - 15) / ex * 0.15::DOUBLE ELSE 0.0 END ORDER BY pos))::DOUBLE AS gap
  FROM (SELECT *, CASE WHEN level IS NULL THEN 65 WHEN level = 'beginner' THEN 40 WHEN level = 'intermediate' THEN 65
          WHEN level = 'advanced' THEN 80 WHEN level = 'expert' THEN 90 ELSE 65 END AS ex FROM p_skills)
  WHERE test_score IS NOT NULL GROUP BY id
),
c AS (
  SELECT er.*, x.candidate_id, n_jobs, coalesce(tenure, 0) AS tenure, coalesce(tiers, '') AS tiers, first_ml,
    ({any_of(v.PYTHON_IN_CAREER, 'career')} OR EXISTS (SELECT 1 FROM p_skills s WHERE s.id = x.id AND contains(lower(s.name), 'python'))) AS has_python,
    coalesce(recent, false) AS recent,
    coalesce(all_service, false) AS service_only,
    {any_of(v.OWNERSHIP_WORDS, 'career', word)} AS ownership_word,
    ({any_of(v.RESEARCH, 'career')} AND NOT {any_of(v.RESEARCH_PRODUCTION, 'career')}) AS research_only,
    {any_of(v.DISCLAIMERS, 'career')} AS disclaimed,
    regexp_matches(career, {q(LOOSE)}) AS outcome,
    coalesce(tenure < 18, false) AS short_tenure,
    coalesce(n_jobs >= 2 AND tenure < 18 AND climbs, false) AS chaser,
    coalesce(first_ml > '2023-01-01', false) AND NOT trusted AND {count_of(v.GENAI, 'full_t')} >= 3
      AND NOT {any_of(v.VECTOR_OR_EVAL, 'full_t')} AS wrapper,
    coalesce(gap.gap, 0.0) AS gap,
    {occurrences(v.BUILDER_VERBS, 'career')} AS builder,
    {occurrences(v.LEADER_VERBS, 'career')} AS leader,
    {occurrences(v.PASSIVE_VERBS, 'career')} AS passive
  FROM x JOIN er USING (id) LEFT JOIN jc USING (id) LEFT JOIN climb USING (id) LEFT JOIN gap USING (id)
)"""


def lim(count: str, each: int, most: int) -> str:
    return f"least({most}, {count} * {each})"


def pts(flag: str, value) -> str:
    return f"(CASE WHEN {flag} THEN {value} ELSE 0 END)"


SCORES = f"""
kt AS (
  SELECT id, {count_of(v.STRONG_TERMS, 'trust')} AS strong, {count_of(v.RECOMMENDER, 'trust')} AS rec,
    {count_of(v.LEARNING_TO_RANK, 'trust')} AS ltr, {count_of(v.MEDIUM_TERMS, 'trust')} AS medium,
    {any_of(v.DISCLAIMERS, 'trust')} AS t_disclaimed, {any_of(v.DEPLOY, 'trust')} AS deploy,
    {any_of(v.DEPLOY_OR_SHIPPED, 'trust')} AS shipped, {any_of(v.RELEVANCE_EVAL, 'trust')} AS eval,
    regexp_matches(trust, {q(STRICT)}) AS t_outcome, {any_of(v.OWNERSHIP_VERBS, 'trust')} AS owned,
    {count_of(v.ARCHITECTURE, 'trust', exact)} AS arch
  FROM x
),
pj AS (
  SELECT id,
    sum(CASE WHEN ({any_of([t for t in v.ML_CONTEXT if t != 'ml'], 'de')} OR {word('ml', 'de')}) AND {any_of(v.BUILD_WORDS, 'de')}
        THEN least(4, {count_of(v.PRODUCTION_TERMS, 'de', exact)}) ELSE 0 END) AS prod,
    sum({count_of(v.PRE_LLM, 'de', exact)}) AS classic,
    bool_or(start_s <= '2023-01-01' AND ({any_of(['model', 'machine learning', 'neural', 'prediction'], 'de')} OR {word('ml', 'de')})) AS early
  FROM j WHERE NOT {any_of(v.SKIPPED_TITLES, 't')} GROUP BY id
),
env AS (
  SELECT id, bool_or({any_of(v.PRODUCT_INDUSTRIES, 'ind')}) AS product, bool_or(company_size IN ('1-10', '11-50', '51-200')) AS startup
  FROM j WHERE NOT service GROUP BY id
),
small AS (SELECT id, count(*) FILTER (company_size IN ('1-10', '11-50')) AS n_small FROM j GROUP BY id),
k AS (
  SELECT x.id, x.candidate_id,
    CASE WHEN trusted THEN least(100.0, (
        least(35.0, {lim('strong', 25, 70)} + {lim('rec', 20, 50)} + {lim('ltr', 30, 50)} + {lim('medium', 10, 20)})::DOUBLE
          * (CASE WHEN t_disclaimed THEN 0.5 ELSE 1 END)
        + CASE WHEN strong + rec + ltr > 0 THEN {pts('deploy', 20)} + {pts('eval', 20)} + {pts('t_outcome', 10)}
            + {pts('deploy AND eval', 10)} + {pts('owned', 15)} ELSE 0 END) * recency) ELSE 0 END::DOUBLE AS relevance_ownership,
    CASE WHEN trusted AND rec > 0 THEN least(100, {lim('rec', 20, 60)} + {pts('shipped', 20)} + {pts('t_outcome', 20)}) ELSE 0 END::DOUBLE AS recommendation_ownership,
    least(100, {lim('coalesce(prod, 0)', 12, 50)} + {lim('coalesce(classic, 0)', 15, 30)} + {pts('early', 20)})::DOUBLE AS production_ml,
    least(100.0, {count_of(v.EVAL_TERMS, 'trust', exact)} * 25.0::DOUBLE
      + ({' + '.join(f"({exact(t, 'skills')} AND NOT {exact(t, 'trust')})::INT" for t in v.EVAL_TERMS)}) * 25.0::DOUBLE * 0.3::DOUBLE)::DOUBLE AS evaluation_rigor,
    least(100, {lim(count_of(v.OWNERSHIP_VERBS, 'career', exact), 8, 30)} + {lim(count_of(v.PLATFORM_TERMS, 'career', exact), 8, 20)}
      + {pts('c.outcome', 20)} + {lim(count_of(v.BUSINESS_METRICS, 'career', exact), 15, 30)})::DOUBLE AS product_ownership,
    CASE WHEN arch > 0 THEN least(100, {lim('arch', 15, 50)} + {pts(any_of(v.ARCHITECTURE_OWNED, 'trust'), 25)}
      + {pts(any_of(v.ARCHITECTURE_LIVE, 'trust'), 25)}) ELSE 0 END::DOUBLE AS retrieval_architecture,
    CASE WHEN env.id IS NULL THEN 20 WHEN product AND startup THEN 95 WHEN product THEN 80 ELSE 60 END::DOUBLE AS career_environment,
    least(100, {count_of(v.SCALE_TERMS, 'career')} * 20)::DOUBLE AS production_scale,
    least(100, {lim(count_of(v.VECTOR_STORES, 'career', exact), 15, 40)} + {lim(count_of(v.EMBEDDING_OPS, 'career', exact), 30, 60)})::DOUBLE AS search_infra,
    least(100, {lim(count_of(v.FOUNDING, 'career'), 15, 60)} + {lim('coalesce(n_small, 0)', 20, 40)})::DOUBLE AS founding_team_fit,
    least(100, {count_of(v.PYTHON_TOOLS, 'full_t')} * 15 + {count_of(v.PYTHON_DEPTH, 'full_t')} * 10)::DOUBLE AS python_depth,
    least(100, {count_of(v.DISTRIBUTED, 'full_t')} * 12)::DOUBLE AS distributed_systems,
    least(100, CASE WHEN github >= 50 THEN 60 WHEN github >= 20 THEN 30 WHEN github >= 0 THEN 10 ELSE 0 END
      + {lim(count_of(v.EXTERNAL, 'full_t'), 15, 40)})::DOUBLE AS external_validation,
    CASE WHEN NOT open_to_work THEN 0 WHEN notice_days <= 30 THEN 100 WHEN notice_days <= 60 THEN 60 WHEN notice_days <= 90 THEN 30 ELSE 10 END::DOUBLE AS availability_timeline,
    response_rate * 50 + completion_rate * 50 AS pipeline_friction
  FROM x JOIN c USING (id) JOIN kt USING (id) LEFT JOIN pj USING (id) LEFT JOIN env USING (id) LEFT JOIN small USING (id)
),
ki AS (
  SELECT *, {r('''greatest(0.50::DOUBLE * relevance_ownership + 0.30::DOUBLE * evaluation_rigor + 0.20::DOUBLE * retrieval_architecture,
      0.55::DOUBLE * relevance_ownership + 0.45::DOUBLE * recommendation_ownership)''', 1)} AS cri
  FROM k
)"""


def group_total(weights: dict) -> str:
    whole = sum(weights.values())
    items = [f"{name} * {weight}::DOUBLE / 100::DOUBLE" for name, weight in weights.items()]
    return f"({total(items)} / {whole}::DOUBLE * {whole}::DOUBLE)"


def fit_sql() -> str:
    from profilerank import rules as u

    subs = " ".join(f", {r(n, 1)} AS b_{n}" for n in u.TECHNICAL_WEIGHTS)
    return f"""
fw AS (
  SELECT *, {group_total(u.TECHNICAL_WEIGHTS)} AS tech, {group_total(u.CULTURE_WEIGHTS)} AS culture,
    {group_total(u.HIRE_WEIGHTS)} AS hire FROM ki
),
f AS (
  SELECT id, candidate_id, cri, relevance_ownership, career_environment,
    {r('tech + culture + hire', 2)} AS raw_fit, {r('tech', 1)} AS technical_fit,
    {r('culture', 1)} AS engineering_culture, {r('hire', 1)} AS hireability{subs}
  FROM fw
),
fc AS (
  SELECT *, least(raw_fit, CASE WHEN cri < 40 THEN 50 WHEN cri < 60 THEN 70 WHEN cri < 80 THEN 90 ELSE 100 END)::DOUBLE AS capped_fit FROM f
)"""


GATES = f"""
g0 AS (
  SELECT x.id, x.candidate_id, country, location, open_to_work, lower(country) IN ('india', 'in') AS home, fc.cri,
    coalesce(date_diff('day', {iso('last_active')}, {TODAY}), 999) AS idle,
    (NOT {any_of(v.HUBS, 'lower(location)')} AND NOT coalesce(relocate, false)) AS stays,
    has_python, recent, anywhere, full_t, wrapper, research_only, service_only, ownership_word,
    ({any_of(v.RECOMMENDER + v.RESCUE_TERMS, 'career')} AND relevance_ownership > 40
      AND (({any_of(v.DEPLOY_OR_SHIPPED, 'career')} AND NOT disclaimed) OR outcome)) AS rescue
  FROM x JOIN c USING (id) JOIN fc USING (id)
),
g1 AS (
  SELECT *, CASE WHEN (home AND stays) OR NOT has_python OR NOT recent THEN 'hard_reject'
      WHEN NOT anywhere OR cri < 25 OR (cri < 35 AND NOT rescue) THEN 'alternate_pipeline' ELSE 'pass' END AS route,
    NOT ((home AND stays) OR NOT has_python OR NOT recent OR NOT anywhere) AS going_on,
    {count_of(v.DATA_INFRA, 'full_t')} AS data_n, {count_of(v.VISION_AUDIO, 'full_t')} AS vision_n
  FROM g0
),
g AS (
  SELECT id, candidate_id, route, going_on, cri,
    concat_ws('|', CASE WHEN NOT home THEN '{v.FLAG_VISA} (' || location || ', ' || country || ')' END,
      CASE WHEN NOT open_to_work AND idle > 180 THEN '{v.FLAG_PASSIVE}' END,
      CASE WHEN route = 'pass' AND cri < 35 THEN '{v.FLAG_RESCUED}' END) AS flags,
    CASE WHEN route = 'pass' THEN 'None' WHEN wrapper THEN '{v.TRACK_WRAPPER}' WHEN research_only THEN '{v.TRACK_RESEARCH}'
      WHEN service_only AND NOT ownership_word THEN '{v.TRACK_SERVICE}'
      WHEN vision_n > data_n AND vision_n >= 2 THEN '{v.TRACK_VISION}'
      WHEN data_n >= 2 THEN '{v.TRACK_DATA}' ELSE '{v.TRACK_GENERAL}' END AS track
  FROM g1
)"""

FINAL = f"""
cal AS (
  SELECT fc.id, fc.candidate_id, {r('''fc.capped_fit * (CASE WHEN chaser THEN 0.9 ELSE 1 END)::DOUBLE
      * (CASE WHEN service_only AND NOT ownership_word THEN 0.85 ELSE 1 END)::DOUBLE
      * (CASE WHEN wrapper THEN 0.9 ELSE 1 END)::DOUBLE
      * (CASE WHEN gap > 0 THEN 1::DOUBLE - gap ELSE 1 END)::DOUBLE
      * (CASE WHEN research_only THEN 0.8 ELSE 1 END)::DOUBLE
      * (CASE WHEN short_tenure AND NOT chaser THEN 0.95 ELSE 1 END)::DOUBLE
      * (CASE WHEN career_environment >= 95 THEN 1.05 WHEN career_environment >= 80 THEN 1.03 ELSE 1 END)::DOUBLE''', 2)} AS calibrated,
    concat_ws('|', CASE WHEN chaser THEN '{v.FLAG_CHASER}' END,
      CASE WHEN service_only AND NOT ownership_word THEN '{v.FLAG_SERVICE}' END,
      CASE WHEN wrapper THEN '{v.FLAG_WRAPPER}' END,
      CASE WHEN gap > 0.05 THEN '{v.FLAG_INFLATION}: -' || printf('%.1f', gap * 100) || '%' END,
      CASE WHEN research_only THEN '{v.FLAG_RESEARCH}' END,
      CASE WHEN short_tenure AND NOT chaser THEN '{v.FLAG_TENURE}' END) AS penalties
  FROM fc JOIN c USING (id)
),
odd AS (
  SELECT x.id, x.candidate_id,
    coalesce((SELECT count(*) FILTER (TRY_CAST(substr(start_s, 1, 4) AS INT) IS NOT NULL
        AND months > (2026 - TRY_CAST(substr(start_s, 1, 4) AS INT)) * 12 + 6) FROM j WHERE j.id = x.id), 0) AS impossible_jobs,
    coalesce((SELECT count(*) FILTER (level IN ('advanced', 'expert') AND months = 0 AND endorsements = 0) FROM p_skills s WHERE s.id = x.id), 0) >= 5 AS idle_experts,
    (salary_min > salary_max AND salary_max > 0) AS inverted_salary,
    (signup <> '' AND last_active <> '' AND signup > last_active) AS active_before_signup,
    ({any_of(v.NON_TECH_TITLES, "lower(coalesce(current_title, ''))")} AND {count_of(IR, 'skills', exact)} >= 4) AS stuffed_skills
  FROM x
),
an AS (
  SELECT *, greatest(0.0, 1.0::DOUBLE - (
      (CASE impossible_jobs WHEN 0 THEN 0 WHEN 1 THEN 0.3::DOUBLE WHEN 2 THEN 0.3::DOUBLE + 0.3::DOUBLE
        WHEN 3 THEN 0.3::DOUBLE + 0.3::DOUBLE + 0.3::DOUBLE ELSE 0.3::DOUBLE + 0.3::DOUBLE + 0.3::DOUBLE + 0.3::DOUBLE END)::DOUBLE
      + (CASE WHEN idle_experts THEN 0.4 ELSE 0 END)::DOUBLE + (CASE WHEN inverted_salary THEN 0.15 ELSE 0 END)::DOUBLE
      + (CASE WHEN active_before_signup THEN 0.25 ELSE 0 END)::DOUBLE + (CASE WHEN stuffed_skills THEN 0.2 ELSE 0 END)::DOUBLE))::DOUBLE AS factor
  FROM odd
),
cf0 AS (
  SELECT x.id, x.candidate_id, (builder + leader + passive) AS verbs,
    (has_python::INT + {any_of(v.COVERED_PRODUCTION, 'career')}::INT + trusted::INT
      + {any_of(v.COVERED_EVAL, 'full_t', exact)}::INT
      + coalesce(date_diff('day', {iso('substr(last_active, 1, 10)')}, {TODAY}) <= 90, false)::INT
      + verified::INT + outcome::INT) AS covered,
    list_filter([
      CASE WHEN contains(career, 'python') THEN 1.0 WHEN contains(skills, 'python') THEN 0.5 END,
      CASE WHEN {any_of(v.RELIABLE_PRODUCTION, 'career')} THEN 1.0 END,
      CASE WHEN trusted THEN 1.0 WHEN anywhere THEN 0.5 END,
      CASE WHEN {any_of(v.RELIABLE_EVAL, 'career')} THEN 1.0 WHEN {any_of(v.SKILL_EVAL, 'skills')} THEN 0.5 END,
      CASE WHEN github > 20 THEN 0.9 END, CASE WHEN verified THEN 1.0 END,
      CASE WHEN regexp_matches(career, {q(PERCENT_TIMES)}) THEN 1.0 END]::DOUBLE[], lambda s: s IS NOT NULL) AS sources,
    greatest(0.0, 1.0::DOUBLE - (CASE WHEN anywhere AND NOT trusted THEN 0.3 ELSE 0 END)::DOUBLE
      - (CASE WHEN gap > 0.05 THEN 0.2 ELSE 0 END)::DOUBLE)::DOUBLE AS consistency
  FROM x JOIN c USING (id)
),
cf1 AS (
  SELECT *, covered::DOUBLE / 7 AS coverage,
    CASE WHEN len(sources) > 0 THEN {total_list("list_transform(sources, lambda s: {'s': s, 'c': 0.0::DOUBLE})")} / len(sources) ELSE 0.3 END::DOUBLE AS reliability
  FROM cf0
),
cf2 AS (
  SELECT *, {r('(0.4::DOUBLE * coverage + 0.4::DOUBLE * reliability + 0.2::DOUBLE * consistency) * 100::DOUBLE', 1)} AS conf FROM cf1
),
cf AS (
  SELECT *, CASE WHEN verbs < 10 THEN greatest(0.0, conf - 10) ELSE conf END::DOUBLE AS confidence FROM cf2
),
z0 AS (
  SELECT g.id, g.candidate_id, route, flags, going_on, track, g.cri, raw_fit, technical_fit, engineering_culture, hireability,
    calibrated, penalties, factor, confidence,
    CASE WHEN builder + leader + passive = 0 THEN 0.0 ELSE {r('(builder + 0.5::DOUBLE * leader) / (builder + leader + passive)', 3)} END AS velocity,
    (CASE WHEN route = 'alternate_pipeline' THEN least(calibrated * factor, 30.0::DOUBLE) ELSE calibrated * factor END)
      * (0.80::DOUBLE + 0.20::DOUBLE * (confidence / 100.0::DOUBLE)) AS s
  FROM g JOIN fc USING (id) JOIN cal USING (id) JOIN an USING (id) JOIN cf USING (id) JOIN c USING (id)
),
z AS (
  SELECT id, candidate_id, route, flags, going_on, track, cri,
    CASE WHEN going_on THEN {r('s', 2)} ELSE 0 END::DOUBLE AS final_score,
    CASE WHEN going_on THEN raw_fit ELSE 0 END::DOUBLE AS raw_fit_score,
    CASE WHEN going_on THEN velocity ELSE 0 END::DOUBLE AS shipping_velocity,
    CASE WHEN going_on THEN confidence ELSE 0 END::DOUBLE AS confidence,
    CASE WHEN going_on THEN technical_fit END::DOUBLE AS technical_fit,
    CASE WHEN going_on THEN engineering_culture END::DOUBLE AS engineering_culture,
    CASE WHEN going_on THEN hireability END::DOUBLE AS hireability,
    CASE WHEN going_on THEN penalties ELSE '' END AS penalties,
    CASE WHEN going_on THEN {r('factor', 3)} ELSE factor END::DOUBLE AS honeypot_multiplier
  FROM z0
)"""

CHAIN = [PROFILES, TEXTS, EVIDENCE, CAREER, SCORES, fit_sql(), GATES, FINAL]


def with_chain(select: str, depth: int = len(CHAIN), extra: str = "") -> str:
    parts = CHAIN[:depth] + ([extra] if extra else [])
    return "WITH " + ",".join(parts) + "\n" + select
