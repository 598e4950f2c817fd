"""DuckDB SQL per registered query."""

from __future__ import annotations

from oracle.base import (
    IR, NOUNS, STRICT, VERBS, any_of, count_of, exact, occurrences, q, r, tier, with_chain, word,
)
from oracle.tables import table_sql
from profilerank import vocabulary as v
from profilerank.rules import Rules
from profilerank.plans.queries import CORE, DOCUMENT_TERMS, MARKUP_TERMS, OTHER, TURN_TERMS

TEXT, EVID, CAR, SCO, FIT, GATE, FIN = 2, 3, 4, 5, 6, 7, 8


def any_in(terms, col):
    tests = ([any_of(terms.fragments, col)] if terms.fragments else []) + (
        [any_of(terms.words, col, word)] if terms.words else [])
    return "(" + " OR ".join(tests) + ")"


def count_in(terms, col):
    return f"({count_of(terms.fragments, col)} + {count_of(terms.words, col, word)})"


def occurs(term, col):
    return f"((length({col}) - length(replace({col}, {q(term)}, ''))) // {len(term)})"


def occurrences_in(terms, col):
    return "(" + " + ".join(occurs(t, col) for t in terms.fragments) + f" + {occurrences(terms.words, col)})"


def hits_in(terms, table, keys, text):
    """Unpivot by a list of (term, mode, n) per row."""
    items = [f"{{'term': {q(t)}, 'mode': 'substring', 'n': {occurs(t, 't')}::BIGINT}}" for t in terms.fragments]
    items += [f"{{'term': {q(t)}, 'mode': 'word', 'n': {occurrences([t], 't')}::BIGINT}}" for t in terms.words]
    return (f"SELECT {keys}, h.term AS term, h.mode AS mode, h.n AS n FROM (SELECT {keys}, unnest([{', '.join(items)}]) AS h "
            f"FROM (SELECT {keys}, lower({text}) AS t FROM {table})) WHERE h.n > 0")


DOCS = "(SELECT doc_id, lang, source, lower(text) AS t FROM documents)"

FILLERS = "|".join(v.OUTCOME_FILLERS)
VERB_FORM = rf"({VERBS})\s+([\w\-\s]{{0,40}}?)\s*(?:by\s*)?([0-9]+(?:\.[0-9]+)?)\s*%"
NOUN_FORM = rf"([\w\-\s]{{0,40}}?)\s*(?:{NOUNS})\s+(?:of|in)?\s*([0-9]+(?:\.[0-9]+)?)\s*%"


def ex(pattern, group):
    return f"regexp_extract_all(trust, {q(pattern)}, {group})"


OUTCOMES = f"""
o0 AS (
  SELECT id, candidate_id, unnest(list_concat(
    list_transform(range(1, len({ex(VERB_FORM, 1)}) + 1), lambda i: {{'pos': i - 1,
      'verb': {ex(VERB_FORM, 1)}[i], 'metric': trim({ex(VERB_FORM, 2)}[i]), 'amount': {ex(VERB_FORM, 3)}[i]}}),
    list_transform(range(1, len({ex(NOUN_FORM, 1)}) + 1), lambda i: {{'pos': len({ex(VERB_FORM, 1)}) + i - 1,
      'verb': 'reported',
      'metric': trim(regexp_replace(trim({ex(NOUN_FORM, 1)}[i]), '^(?:(?:{FILLERS})\\s+){{1,3}}', '')),
      'amount': {ex(NOUN_FORM, 2)}[i]}})), recursive := true) FROM x
),
o AS (
  SELECT id, candidate_id, pos, verb, CASE WHEN metric = '' THEN '{v.UNNAMED_METRIC}' ELSE metric END AS metric,
    amount, CAST(amount AS DOUBLE) AS value FROM o0
),
ob AS (
  SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY id ORDER BY value DESC, pos) = 1
),
fx AS (
  SELECT id, arg_max(f, (CAST(f AS DOUBLE), -i)) AS factor FROM (
    SELECT id, unnest(fs) AS f, generate_subscripts(fs, 1) AS i FROM (
      SELECT id, regexp_extract_all(trust, '([0-9]+(?:\\.[0-9]+)?)\\s*x\\s', 1) AS fs FROM x)) GROUP BY id
)"""


def compared(needle: str) -> str:
    before = (f"substr(trust, greatest(1, instr(trust, {q(needle)}) - {v.COMPARATIVE_WINDOW}), "
              f"least({v.COMPARATIVE_WINDOW}, instr(trust, {q(needle)}) - 1))")
    return f"(contains(trust, {q(needle)}) AND {any_of(v.COMPARATIVE_MARKERS, before)})"


PHRASE = "CASE " + " ".join(
    f"WHEN contains(trust, {q(n)}) AND NOT {compared(n)} THEN {q(said)}" for n, said in v.EVIDENCE_PHRASES) + " END"
TOPIC = "CASE " + " ".join(
    f"WHEN {any_of(needles, 'trust')} THEN CASE WHEN {any_of(v.DISCLAIMERS, 'trust')} THEN {q(less)} ELSE {q(said)} END"
    for needles, said, less in v.EVIDENCE_TOPICS) + f" ELSE {q(v.EVIDENCE_CONFIRMED)} END"

EVIDENCE_TEXT = OUTCOMES + f""",
cur AS (SELECT id, arg_min(t, pos) AS held FROM j WHERE is_current GROUP BY id),
ph AS (
  SELECT x.id, x.candidate_id, {PHRASE} AS phrase, {TOPIC} AS topic,
    coalesce(' (' || ob.verb || ' ' || ob.metric || ' by ' || ob.amount || '%)', ' (a ' || factor || 'x improvement)',
      CASE WHEN {any_of(v.FORMAL_EVAL, 'trust')} THEN ' ({v.SUFFIX_EVAL})'
           WHEN {any_of(v.SCALE_WORDS, 'trust')} THEN ' ({v.SUFFIX_SCALE})' ELSE '' END) AS suffix
  FROM x LEFT JOIN ob USING (id) LEFT JOIN fx USING (id)
),
et AS (
  SELECT ph.id, ph.candidate_id, CASE
    WHEN trusted THEN coalesce(phrase || suffix, topic)
    WHEN found THEN CASE WHEN {any_of(v.VISION_TITLES, "coalesce(held, '')")} THEN {q(v.EVIDENCE_MISMATCH_VISION)} ELSE {q(v.EVIDENCE_MISMATCH)} END
    WHEN {any_of(v.VISION_TITLES, "coalesce(held, '')")} THEN {q(v.EVIDENCE_VISION)}
    WHEN career_environment >= 95 AND ({any_of([t for t in v.ML_SIGNAL if t != 'ml'], 'career')} OR {word('ml', 'career')})
      AND NOT {any_of(v.DISCLAIMERS + v.ML_DISCLAIMERS, 'career')} THEN {q(v.EVIDENCE_FOUNDING)}
    WHEN {any_of(v.DEPLOY, 'career')} THEN CASE WHEN {any_of(v.DISCLAIMERS, 'career')} THEN {q(v.EVIDENCE_DEPLOY_DISCLAIMED)} ELSE {q(v.EVIDENCE_DEPLOY)} END
    WHEN {any_of(v.DATA_SIGNAL, 'career')} THEN {q(v.EVIDENCE_DATA)} ELSE {q(v.EVIDENCE_NONE)} END AS evidence
  FROM ph JOIN x USING (id) JOIN e USING (id) JOIN k USING (id) LEFT JOIN cur USING (id)
)"""

CORE_SKILLS = (
    f"SELECT candidate_id, x.id, count(s.id) FILTER ({any_of(IR, 'lower(s.name)', exact)} OR {any_of(v.AI_CORE, 'lower(s.name)')}) "
    "AS core_skills FROM x LEFT JOIN p_skills s ON s.id = x.id GROUP BY candidate_id, x.id")

REASONING = EVIDENCE_TEXT + f""",
cs AS ({CORE_SKILLS}),
re AS (
  SELECT z.id, z.candidate_id, z.final_score,
    coalesce(current_title, 'Candidate') || ' with ' || printf('%.1f', years) || ' yrs; ' || core_skills
    || ' AI core skills; response rate ' || printf('%.2f', response_rate) || '.' ||
    CASE WHEN z.route = 'alternate_pipeline' THEN ' {v.FILLER_HEAD} (' || CASE WHEN z.cri < 10 THEN '{v.FILLER_NONE}'
        WHEN z.cri < 25 THEN 'CRI ' || printf('%.0f', z.cri) || '/100 - {v.FILLER_LOW}'
        ELSE 'CRI ' || printf('%.0f', z.cri) || '/100 - {v.FILLER_ADJACENT}' END || '). {v.FILLER_TAIL}'
    ELSE ' Evidence: ' || evidence || '.' || coalesce(' Concern: ' || CASE
        WHEN z.cri > 0 AND z.cri < 60 THEN 'CRI only ' || printf('%.0f', z.cri) || '/100 -- {v.CONCERN_CRI}'
        WHEN contains(penalties, '{v.FLAG_INFLATION}') THEN '{v.CONCERN_SKILLS}'
        WHEN notice_days > 60 THEN notice_days || '{v.CONCERN_NOTICE}'
        WHEN NOT coalesce(relocate, true) AND NOT contains(lower(location), 'pune') AND NOT contains(lower(location), 'noida')
          THEN '{v.CONCERN_RELOCATION}' END || '.', '') END AS reasoning
  FROM z JOIN x USING (id) JOIN et USING (id) JOIN cs USING (id)
)"""

TOP = "top AS (SELECT *, row_number() OVER (ORDER BY final_score DESC, candidate_id) AS rank FROM z QUALIFY rank <= 100)"

RECORD = """SELECT candidate_id, (route = 'pass')::BIGINT AS passed_gates, route, flags, final_score, raw_fit_score, cri,
  shipping_velocity, CAST(printf('%.4f', confidence) AS DOUBLE) AS confidence, track, technical_fit, engineering_culture,
  hireability, penalties, CAST(printf('%.4f', honeypot_multiplier) AS DOUBLE) AS honeypot_multiplier FROM z"""


def b(*names: str) -> str:
    return ", ".join(f"({n.split('=')[-1]})::BIGINT AS {n.split('=')[0]}" for n in names)


def oracle_sql() -> dict[str, str]:
    sql = {
        "term_any_docs": f"SELECT doc_id, {any_in(DOCUMENT_TERMS, 't')}::BIGINT AS term_any FROM {DOCS}",
        "term_count_docs": f"SELECT doc_id, {count_in(DOCUMENT_TERMS, 't')}::BIGINT AS term_count FROM {DOCS}",
        "term_occurrences_docs":
            f"SELECT doc_id, {occurrences_in(DOCUMENT_TERMS, 't')}::BIGINT AS term_occurrences FROM {DOCS}",
        "relevance_terms_docs": f"SELECT lang, count(*) AS docs, count(*) FILTER (n > 0) AS hit_docs, sum(n)::BIGINT AS hits "
                                f"FROM (SELECT lang, {count_of(IR, 't', exact)} AS n FROM {DOCS}) GROUP BY lang",
        "term_hits_by_lang": "SELECT lang, term, mode, count(*) AS docs, sum(n)::BIGINT AS hits FROM ("
                             + hits_in(DOCUMENT_TERMS, "documents", "doc_id, lang", "text") + ") GROUP BY lang, term, mode",
        "term_hits_pages": hits_in(MARKUP_TERMS, "pages", "page_id", "html"),
        "term_hits_by_label": f"SELECT quality, toxic, count(*) AS docs, sum({count_in(DOCUMENT_TERMS, 't')})::BIGINT AS terms, "
                              f"sum({occurrences_in(DOCUMENT_TERMS, 't')})::BIGINT AS hits FROM labels JOIN {DOCS} USING (doc_id) "
                              "GROUP BY quality, toxic",
        "terms_by_role": f"""SELECT conv_id, count(*) AS turns, count(*) FILTER (ok) AS trusted_turns,
            coalesce(sum(length(text)) FILTER (ok), 0)::BIGINT AS trusted_chars,
            coalesce(sum(n) FILTER (ok), 0)::BIGINT AS trusted_terms, min(turn) FILTER (ok AND n > 0) AS first_hit,
            max(turn) FILTER (ok AND n > 0) AS last_hit FROM (
              SELECT *, role <> 'assistant' AS ok, {count_in(TURN_TERMS, 'lower(text)')} AS n FROM conversations) GROUP BY conv_id""",
        "profile_text": with_chain(
            "SELECT candidate_id, length(full_t)::BIGINT AS full_chars, md5(full_t) AS full_md5, md5(career) AS career_md5, "
            "md5(skills) AS skills_md5, md5(trust) AS trust_md5 FROM x", TEXT),
        "title_checks": with_chain(
            f"SELECT candidate_id, idx AS pos, contra::BIGINT AS contradicts, {any_of(v.VISION_TITLES, 't')}::BIGINT AS vision_only, "
            f"{any_of(v.RELEVANT_TITLES, 't')}::BIGINT AS relevant, ({tier('t')})::BIGINT AS tier FROM j JOIN p_base USING (id)", TEXT),
        "evidence_pick": with_chain(
            f"SELECT candidate_id, {b('evidence_found=found', 'evidence_trusted=trusted', 'ir_anywhere=anywhere')}, "
            "coalesce(ev_pos - 1, -1)::BIGINT AS job, CASE WHEN ev_pos IS NULL THEN 0 ELSE recency END::DOUBLE AS recency "
            "FROM er JOIN x USING (id)", EVID),
        "recent_activity": with_chain(f"SELECT candidate_id, {b('has_python', 'recent_code=recent')} FROM c", CAR),
        "title_tiers": with_chain("SELECT candidate_id, tiers FROM c", CAR),
        "title_chaser": with_chain(f"SELECT candidate_id, {b('title_chaser=chaser')} FROM c", CAR),
        "tenure_stability": with_chain(f"SELECT candidate_id, {r('tenure', 4)} AS tenure, {b('short_tenure')} FROM c", CAR),
        "all_at_listed_firms": with_chain(f"SELECT candidate_id, {b('service_only', 'ownership_word')} FROM c", CAR),
        "first_matching_job": with_chain(
            f"SELECT candidate_id, coalesce(first_ml, 'none') AS first_ml, {b('genai_wrapper=wrapper')} FROM c", CAR),
        "research_only": with_chain(f"SELECT candidate_id, {b('research_only')} FROM c", CAR),
        "career_flags": with_chain(f"SELECT candidate_id, {b('career_disclaimed=disclaimed', 'career_outcome=outcome')} FROM c", CAR),
        "verb_counts": with_chain(
            f"SELECT candidate_id, {b('builder_verbs=builder', 'leader_verbs=leader', 'passive_verbs=passive', 'all_verbs=builder + leader + passive')}, "
            f"CASE WHEN builder + leader + passive = 0 THEN 0 ELSE {r('(builder + 0.5::DOUBLE * leader) / (builder + leader + passive)', 3)} END::DOUBLE "
            "AS shipping_velocity FROM c", CAR),
        "skill_gap": with_chain(f"SELECT candidate_id, {r('gap', 6)} AS skill_gap FROM c", CAR),
        "core_skills": with_chain(f"SELECT candidate_id, core_skills FROM ({CORE_SKILLS})", TEXT),
        "all_outcomes": with_chain("SELECT candidate_id, pos::BIGINT AS pos, verb, metric, value FROM o", TEXT, OUTCOMES),
        "best_outcome": with_chain("SELECT candidate_id, verb, metric, amount, value FROM ob", TEXT, OUTCOMES),
        "outcome_factor": with_chain(
            "SELECT candidate_id, coalesce(factor, 'none') AS factor FROM x LEFT JOIN fx USING (id)", TEXT, OUTCOMES),
        "comparisons": with_chain(
            "SELECT candidate_id, " + " || ".join(f"({compared(n)})::INT::VARCHAR" for n, _ in v.EVIDENCE_PHRASES)
            + f" AS comparisons, coalesce({PHRASE}, 'none') AS phrase FROM x", TEXT),
        "score_hiring_friction": with_chain(f"SELECT candidate_id, {r('pipeline_friction', 4)} AS hiring_friction FROM k", SCO),
        "relevance_index": with_chain("SELECT candidate_id, cri FROM ki", SCO),
        "raw_fit": with_chain(
            "SELECT candidate_id, raw_fit, technical_fit, engineering_culture, hireability, COLUMNS('b_.*') FROM f", FIT),
        "relevance_ceiling": with_chain("SELECT candidate_id, cri, capped_fit FROM fc", FIT),
        "gate_route": with_chain(
            f"SELECT candidate_id, route, (route = 'pass')::BIGINT AS passed_gates, {b('continue_scoring=going_on')} FROM g", GATE),
        "gate_flags": with_chain("SELECT candidate_id, flags FROM g", GATE),
        "alternate_track": with_chain("SELECT candidate_id, track FROM g", GATE),
        "calibrated": with_chain("SELECT candidate_id, calibrated, penalties FROM cal", FIN),
        "anomaly": with_chain(
            f"SELECT candidate_id, {b('impossible_jobs', 'idle_experts', 'inverted_salary', 'active_before_signup', 'stuffed_skills')}, "
            f"{r('factor', 4)} AS factor FROM an", FIN),
        "confidence": with_chain(
            f"SELECT candidate_id, {r('coverage', 6)} AS coverage, {r('reliability', 6)} AS reliability, "
            f"{r('consistency', 6)} AS consistency, {r('confidence', 4)} AS confidence FROM cf", FIN),
        "final_score": with_chain("SELECT candidate_id, route, final_score FROM z", FIN),
        "score_record": with_chain(RECORD, FIN),
        "top_n": with_chain("SELECT rank, candidate_id, final_score, route FROM top", FIN, TOP),
        "rank_order_check": with_chain(
            "SELECT count(*) AS ranks, count(*) FILTER (final_score > before) AS violations FROM "
            "(SELECT final_score, lag(final_score) OVER (ORDER BY rank) AS before FROM top)", FIN, TOP),
        "explained_top_n": with_chain(
            "SELECT candidate_id, row_number() OVER (ORDER BY final_score DESC, candidate_id) AS rank, "
            "printf('%.4f', final_score / 100.0::DOUBLE) AS score, reasoning FROM re QUALIFY rank <= 100", FIN, REASONING),
        "explained_profiles": with_chain("SELECT candidate_id, reasoning FROM re", FIN, REASONING),
        "evidence_text": with_chain("SELECT candidate_id, evidence FROM et", SCO, EVIDENCE_TEXT),
        "run_summary": with_chain(
            "SELECT count(*) AS scored, count(*) FILTER (route = 'pass') AS passing, least(count(*), 100) AS ranked FROM z", FIN),
        "route_report": with_chain(
            "SELECT route, track, count(*) AS profiles, count(*) FILTER (final_score > 0) AS scored, max(final_score) AS best, "
            "sum(round(final_score * 100)::BIGINT)::BIGINT AS hundredths FROM z GROUP BY route, track", FIN),
        "score_histogram": with_chain(
            "SELECT route, floor(final_score / 5) * 5 AS bin, count(*) AS profiles FROM z GROUP BY ALL", FIN),
        "leading_rows": with_chain(
            "SELECT rank, candidate_id, final_score, raw_fit_score, cri, route, flags FROM top WHERE rank <= 20", FIN, TOP),
        "order_topk": "SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderkey, o_custkey, "
                      "o_totalprice FROM orders QUALIFY rank <= 100",
        "event_recency_score": """SELECT user_id, count(*) AS events, sum(w)::BIGINT AS tenths,
            coalesce(sum(w) FILTER (event_type = 'purchase'), 0)::BIGINT AS purchase_tenths FROM (
              SELECT *, CASE WHEN d <= 7 THEN 10 WHEN d <= 14 THEN 9 WHEN d <= 21 THEN 7 ELSE 5 END AS w FROM (
                SELECT *, date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') AS d FROM events)) GROUP BY user_id""",
    }
    sql["json_round_trip"] = sql["final_score"]
    sql["read_report"] = """SELECT good + bad AS lines, good AS accepted, bad AS rejected, 0 AS partly_read, complete FROM
        (SELECT count(*) AS good FROM customer FULL JOIN documents ON doc_id = c_custkey), (SELECT count(*) AS bad FROM conversations),
        (SELECT count(DISTINCT o_custkey) AS complete FROM orders JOIN lineitem ON l_orderkey = o_orderkey
          JOIN part ON p_partkey = l_partkey JOIN customer ON c_custkey = o_custkey)"""
    sql["run_report"] = sql["read_report"]
    sql["decisions_from_table"] = with_chain(
        f"SELECT candidate_id, route, (route = 'pass')::BIGINT AS passed_gates, {b('continue_scoring=going_on')}, track, "
        f"{r('factor', 4)} AS factor FROM g JOIN an USING (candidate_id)", FIN)
    sql["title_checks_from_table"], sql["title_tiers_from_table"] = sql["title_checks"], sql["title_tiers"]
    sql["scores_round_trip"] = sql["score_record"]
    sql["ranked_csv_round_trip"] = sql["explained_top_n"]
    sql["stream_top_n"] = sql["stream_last_wins_top_n"] = sql["top_n"]
    sql["newest_order_per_customer"] = """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""
    sql.update(table_sql())
    sql["evidence_from_table"] = sql["evidence_text"]
    sql["strict_outcomes_from_table"] = with_chain(
        f"SELECT candidate_id, regexp_matches(trust, {q(STRICT)})::BIGINT AS strict FROM x", TEXT)
    sql["ceiling_from_table"] = sql["relevance_ceiling"]
    sql["rank_all"] = with_chain(
        "SELECT row_number() OVER (ORDER BY final_score DESC, candidate_id) AS rank, candidate_id, final_score FROM z", FIN)
    sql["rank_all_check"] = with_chain("SELECT count(*) AS ranks, 0 AS violations FROM z", FIN)
    names = [n for group in Rules().weights.values() for n in group]
    points = " + ".join(f"round({n} * 10000)::BIGINT * ((s_suppkey * 7 + {13 * i}) % 21) * 10000" for i, n in enumerate(names))
    sql["scorecards_top_n"] = with_chain(
        f"SELECT s_suppkey AS scorecard, row_number() OVER (PARTITION BY s_suppkey ORDER BY points DESC, candidate_id) AS rank, "
        f"candidate_id, points, points / 1e10::DOUBLE AS total FROM (SELECT s_suppkey, candidate_id, ({points})::BIGINT AS points "
        "FROM k, supplier) QUALIFY rank <= 10", SCO)
    for name in CORE + OTHER:
        sql[f"score_{name}"] = with_chain(f"SELECT candidate_id, {name} FROM k", SCO)
    return sql
