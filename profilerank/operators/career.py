"""What the list of jobs says: evidence, recency, titles, tenure, employers."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F

from profilerank import vocabulary as v
from profilerank.functions.dates import days_before, iso_date_prefix
from profilerank.functions.numbers import round_exact
from profilerank.functions.outcomes import has_loose_outcome
from profilerank.functions.text import any_sql, any_term, count_occurrences, count_sql, words_sql
from profilerank.operators.texts import CAREER, DESC, FULL, TITLE
from profilerank.rules import DEFAULT_EXPECTED, DEFAULT_LEVEL, Rules


def with_evidence(df: DataFrame, rules: Rules) -> DataFrame:
    """Pick the job that carries relevance evidence.

    Among the jobs whose description has a relevance term and whose title does
    not speak against it, the last current one wins, else the first one.
    Without such a job the first contradicted one is kept, as untrusted.
    """
    ir = rules.terms.ir
    df = df.withColumn("_hits", F.expr(f"""
        transform(filter(job_terms, j -> {any_sql(ir, *DESC)}),
          j -> named_struct('pos', j.pos, 'end_date', j.end_date, 'is_current', j.is_current,
                            'contradicted', j.contradicted))"""))
    df = df.withColumn("_trusted_hits", F.expr("filter(_hits, j -> not j.contradicted)"))
    return df.withColumns({
        "evidence_found": F.size("_hits") > 0,
        "evidence_trusted": F.size("_trusted_hits") > 0,
        "evidence_job": F.expr("""coalesce(
            try_element_at(filter(_trusted_hits, j -> j.is_current), -1),
            try_element_at(_trusted_hits, 1), try_element_at(_hits, 1))"""),
    }).withColumns({
        # A hit in a description is a hit in the full text, which contains it.
        "ir_anywhere": F.col("evidence_found") | any_term(ir, *FULL),
    }).drop("_hits", "_trusted_hits")


def recency_factor(job: Column, rules: Rules) -> Column:
    """1 for a current job, less the longer ago it ended."""
    end = iso_date_prefix(job["end_date"])
    years = days_before(rules.today, end) / F.lit(365.25)
    return (F.when(job["is_current"] | (job["end_date"] == ""), 1.0)
            .when(end.isNull(), 0.7)
            .when(years <= 3, 0.9).when(years <= 6, 0.7).otherwise(0.5))


def has_recent_code(rules: Rules) -> Column:
    """A coding job overlapping the last months before today.

    A lead title counts as coding only with a verb of building beside it.  An
    unreadable start skips the job, an unreadable end counts as ongoing.
    """
    t = rules.terms
    cutoff = F.lit(rules.today - timedelta(days=30 * rules.recent_code_months))
    today = F.lit(rules.today)
    coding = F.expr(f"""
        filter(job_terms, j -> {any_sql(t.coding_titles, *TITLE)}
          or ({any_sql(t.lead_titles, *TITLE)} and {any_sql(t.builder_verbs, *DESC)}))""")

    def recent(j):
        end = F.coalesce(iso_date_prefix(j["end_date"]), today)
        return F.coalesce(iso_date_prefix(j["start_date"]) <= today, F.lit(False)) & (end >= cutoff)

    return F.exists(coding, recent)


def title_tier_sql(title: str, found: str | None = None) -> str:
    cases = " ".join(f"when {any_sql(v.fragments(words), title, found=found)} then {level}" for level, words in v.TITLE_TIERS)
    return f"case {cases} else {v.DEFAULT_TIER} end"


def title_tiers() -> Column:
    """Tiers of the titles by start date; equal dates keep their given order."""
    return F.expr(f"""array_sort(transform(job_terms, j -> named_struct(
        'start', j.start_date, 'pos', j.pos, 'tier', {title_tier_sql('j.title', 'j.title_found')}))).tier""")


def past_tenure() -> Column:
    """Mean months of the jobs that are over; null without one."""
    return F.expr("""aggregate(
        filter(jobs, j -> not j.is_current), named_struct('n', 0L, 'total', 0L),
        (acc, j) -> named_struct('n', acc.n + 1L, 'total', acc.total + j.months),
        acc -> if(acc.n > 0, acc.total / acc.n, null))""")


def with_career_features(df: DataFrame, rules: Rules) -> DataFrame:
    t = rules.terms
    ml_job = f"{any_sql(t.ml_role, *TITLE)} or {any_sql(t.ml_role, *DESC)}"
    short = f"coalesce(tenure < {rules.short_tenure_months}, false)"
    df = df.withColumns({
        "has_python": F.expr(f"{any_sql(t.python_in_career, *CAREER)} or contains(skills_text, 'python')"),
        "recent_code": has_recent_code(rules),
        "tiers": title_tiers(),
        "tenure": past_tenure(),
        "service_only": F.expr(f"size(jobs) > 0 and forall(jobs, j -> {any_sql(t.service_firms, 'j.company')})"),
        "ownership_word": any_term(t.ownership_words, *CAREER),
        # Start of the earliest job with machine learning in title or description
        "first_ml": F.expr(f"array_min(filter(job_terms, j -> {ml_job}).start_date)"),
        "research_only": any_term(t.research, *CAREER) & ~any_term(t.research_production, *CAREER),
        "career_disclaimed": any_term(t.disclaimers, *CAREER),
        "career_outcome": has_loose_outcome(*CAREER),
    })
    return df.withColumns({
        "short_tenure": F.expr(short),
        # Some title, by start date, lies above the one before it.
        "title_chaser": F.expr(f"""size(jobs) >= 2 and {short} and exists(
            zip_with(tiers, slice(tiers, 2, greatest(size(tiers), 1)), (a, b) -> coalesce(b > a, false)), up -> up)"""),
        "genai_wrapper": F.expr(f"coalesce(first_ml > '{rules.early_ml_until}', false) and not evidence_trusted")
        & F.expr(f"{count_sql(t.genai, *FULL)} >= 3 and not {any_sql(t.vector_or_eval, *FULL)}"),
    })


def with_verbs(df: DataFrame, rules: Rules, needed: Column | None = None) -> DataFrame:
    """Counts of verbs of building, leading and taking part, and the share of
    building among them (leading counts half).

    Where ``needed`` is false nothing is counted.
    """
    t = rules.terms

    def count(terms):
        n = count_occurrences(terms, "career_text", "career_words")
        return n if needed is None else F.when(needed, n).otherwise(0)

    df = df.withColumns({
        "builder_verbs": count(t.builder_verbs),
        "leader_verbs": count(t.leader_verbs),
        "passive_verbs": count(t.passive_verbs),
    }).withColumn("all_verbs", F.expr("builder_verbs + leader_verbs + passive_verbs"))
    velocity = (F.col("builder_verbs") + 0.5 * F.col("leader_verbs")) / F.col("all_verbs")
    return df.withColumn(
        "shipping_velocity", F.when(F.col("all_verbs") == 0, 0.0).otherwise(round_exact(velocity, 3)))


def with_skill_gap(df: DataFrame, rules: Rules) -> DataFrame:
    """Penalty for skills that test below their claimed level; at most 1.

    Skills without a test score do not take part, and a good score in one
    skill does not make up for another.
    """
    levels = " ".join(f"when s.proficiency = '{k}' then {x}" for k, x in rules.expected_by_level.items())
    return df.withColumn("skill_gap", F.expr(f"""
        if(assessed is null, 0D, least(1D, aggregate(
          filter(
            transform(skills, s -> named_struct(
              'expected', case when s.proficiency is null then {rules.expected_by_level[DEFAULT_LEVEL]} {levels}
                               else {DEFAULT_EXPECTED} end,
              'actual', try_element_at(assessed, s.name))),
            s -> s.actual < s.expected - 15),
          0D,
          (acc, s) -> acc + (s.expected - s.actual - 15) / s.expected * 0.15D)))"""))


def core_skills(rules: Rules) -> Column:
    """Skills whose name is a relevance term or another core machine learning term."""
    ir = rules.terms.ir
    return F.expr(f"""size(filter(
        transform(skills, s -> named_struct('name', lower(s.name), 'words', {words_sql('lower(s.name)', ir.words)})),
        s -> {any_sql(ir, 's.name', 's.words')} or {any_sql(rules.terms.ai_core, 's.name')}))""")
