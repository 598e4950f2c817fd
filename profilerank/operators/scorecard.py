"""The fifteen scores (0 to 100), the relevance index and the weighted total."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from profilerank import vocabulary as v
from profilerank.functions.numbers import capped, compensated_sum, points, round_exact
from profilerank.functions.outcomes import has_strict_outcome
from profilerank.functions.text import any_sql, any_term, count_other_terms, count_sql, count_terms
from profilerank.operators.career import recency_factor
from profilerank.operators.texts import CAREER, DESC, FULL, SKILLS, TITLE, TRUST
from profilerank.rules import Rules


def _limited(count: Column, each: int, most: int) -> Column:
    """``each`` points per hit, ``most`` at best."""
    return F.least(F.lit(most), count * each)


def with_relevance(df: DataFrame, rules: Rules) -> DataFrame:
    """Relevance and recommendation ownership, from the trustworthy text.

    Both are 0 without a trustworthy evidence job.  Naming things earns at
    most 35 points (half if ownership is disclaimed); the rest needs signs of
    deployment, evaluation, outcome or ownership next to a named system.
    """
    t, text = rules.terms, TRUST[0]
    trusted = F.col("evidence_trusted")
    facts = {
        "_strong": count_terms(t.strong, *TRUST),
        "_rec": count_terms(t.recommender, *TRUST),
        "_ltr": count_terms(t.learning_to_rank, *TRUST),
        "_medium": count_terms(t.medium, *TRUST),
        "_disclaimed": any_term(t.disclaimers, *TRUST),
        "_deploy": any_term(t.deploy, *TRUST),
        "_shipped": any_term(t.deploy_or_shipped, *TRUST),
        "_eval": any_term(t.relevance_eval, *TRUST),
        "_outcome": has_strict_outcome(text),
        "_owned": any_term(t.ownership_fragments, *TRUST),
    }
    # Most profiles have no trustworthy evidence; their texts need no search.
    df = df.withColumns({name: F.when(trusted, fact) for name, fact in facts.items()})
    named = F.least(F.lit(35.0), _limited(F.col("_strong"), 25, 70) + _limited(F.col("_rec"), 20, 50)
                    + _limited(F.col("_ltr"), 30, 50) + _limited(F.col("_medium"), 10, 20))
    named = F.when(F.col("_disclaimed"), named * 0.5).otherwise(named)
    system = F.col("_strong") + F.col("_rec") + F.col("_ltr") > 0
    substance = F.when(
        system,
        points(F.col("_deploy"), 20) + points(F.col("_eval"), 20) + points(F.col("_outcome"), 10)
        + points(F.col("_deploy") & F.col("_eval"), 10) + points(F.col("_owned"), 15),
    ).otherwise(0)
    relevance = capped((named + substance) * recency_factor(F.col("evidence_job"), rules))
    recommendation = capped((
        _limited(F.col("_rec"), 20, 60) + points(F.col("_shipped"), 20) + points(F.col("_outcome"), 20)
    ).cast("double"))
    return df.withColumns({
        "relevance_ownership": F.when(trusted, relevance).otherwise(0.0),
        "recommendation_ownership": F.when(trusted & (F.col("_rec") > 0), recommendation).otherwise(0.0),
    }).drop("_strong", "_rec", "_ltr", "_medium", "_disclaimed", "_deploy", "_shipped", "_eval",
            "_outcome", "_owned")


def production_ml(rules: Rules) -> Column:
    """Production and classic machine learning terms, job by job.

    Production terms count only beside machine learning and a word of
    building, and at most four per job; unrelated titles do not count at all.
    """
    t = rules.terms
    return F.expr(f"""
        aggregate(
          transform(filter(job_terms, j -> not {any_sql(t.skipped_titles, *TITLE)}), j -> named_struct(
            'production', if({any_sql(t.ml_context, *DESC)} and {any_sql(t.build_words, *DESC)},
                             least(4, {count_sql(t.production, *DESC)}), 0),
            'classic', {count_sql(t.pre_llm, *DESC)},
            'early', j.start_date <= '{rules.early_ml_until}' and {any_sql(t.early_ml, *DESC)})),
          named_struct('production', 0, 'classic', 0, 'early', false),
          (acc, f) -> named_struct('production', acc.production + f.production,
                                   'classic', acc.classic + f.classic, 'early', acc.early or f.early),
          acc -> cast(least(100, least(50, acc.production * 12) + least(30, acc.classic * 15)
                                 + if(acc.early, 20, 0)) as double))""")


def evaluation_rigor(rules: Rules) -> Column:
    terms = rules.terms.evaluation
    in_career = count_terms(terms, *TRUST)
    in_skills_only = count_other_terms(terms, *SKILLS[:2], *TRUST[:2], SKILLS[2], TRUST[2])
    return capped(in_career * 25.0 + in_skills_only * 25.0 * 0.3)


def product_ownership(rules: Rules) -> Column:
    t = rules.terms
    return capped((
        _limited(count_terms(t.ownership_verbs, *CAREER), 8, 30)
        + _limited(count_terms(t.platform, *CAREER), 8, 20)
        + points(F.col("career_outcome"), 20)
        + _limited(count_terms(t.business_metrics, *CAREER), 15, 30)).cast("double"))


def retrieval_architecture(rules: Rules) -> Column:
    t = rules.terms
    count = count_terms(t.architecture, *TRUST)
    return F.when(count > 0, capped((
        _limited(count, 15, 50)
        + points(any_term(t.architecture_owned, *TRUST), 25)
        + points(any_term(t.architecture_live, *TRUST), 25)).cast("double"))).otherwise(0.0)


def career_environment(rules: Rules) -> Column:
    """What kind of companies, service firms left aside."""
    t = rules.terms
    sizes = ", ".join(f"'{size}'" for size in v.STARTUP_SIZES)
    own = F.expr(f"""
        transform(filter(jobs, j -> not {any_sql(t.service_firms, 'j.company')}), j -> named_struct(
          'product', {any_sql(t.product_industries, 'j.industry')}, 'startup', j.company_size in ({sizes})))""")
    return F.transform(
        F.array(own),
        lambda jobs: F.when(F.size(jobs) == 0, 20.0)
        .when(~F.exists(jobs, lambda j: j["product"]), 60.0)
        .when(F.exists(jobs, lambda j: j["startup"]), 95.0).otherwise(80.0))[0]


def search_infra(rules: Rules) -> Column:
    t = rules.terms
    return capped((
        _limited(count_terms(t.vector_stores, *CAREER), 15, 40)
        + _limited(count_terms(t.embedding_ops, *CAREER), 30, 60)).cast("double"))


def founding_team_fit(rules: Rules) -> Column:
    sizes = ", ".join(f"'{size}'" for size in v.FOUNDING_SIZES)
    small = F.expr(f"size(filter(jobs, j -> j.company_size in ({sizes})))")
    return capped((_limited(count_terms(rules.terms.founding, *CAREER), 15, 60)
                   + _limited(small, 20, 40)).cast("double"))


def python_depth(rules: Rules) -> Column:
    return capped((count_terms(rules.terms.python_tools, *FULL) * 15
                   + count_terms(rules.terms.python_depth, *FULL) * 10).cast("double"))


def external_validation(rules: Rules) -> Column:
    github = F.col("github")
    code = F.when(github >= 50, 60).when(github >= 20, 30).when(github >= 0, 10).otherwise(0)
    return capped((
        code + _limited(count_terms(rules.terms.external, *FULL), 15, 40)).cast("double"))


def availability_timeline() -> Column:
    notice = F.col("notice_days")
    tier = F.when(notice <= 30, 100.0).when(notice <= 60, 60.0).when(notice <= 90, 30.0).otherwise(10.0)
    return F.when(F.col("open_to_work"), tier).otherwise(0.0)


def with_core_scores(df: DataFrame, rules: Rules) -> DataFrame:
    """The four scores that the relevance index, and with it the gates, need."""
    return with_relevance(df, rules).withColumns({
        "evaluation_rigor": evaluation_rigor(rules),
        "retrieval_architecture": retrieval_architecture(rules),
    })


def with_other_scores(df: DataFrame, rules: Rules, needed: Column | None = None) -> DataFrame:
    """The remaining scores; null where ``needed`` is false, without being computed."""
    t = rules.terms
    scores = {
        "production_ml": production_ml(rules),
        "product_ownership": product_ownership(rules),
        "production_scale": capped(count_terms(t.scale, *CAREER) * 20.0),
        "search_infra": search_infra(rules),
        "founding_team_fit": founding_team_fit(rules),
        "python_depth": python_depth(rules),
        "distributed_systems": capped(count_terms(t.distributed, *FULL) * 12.0),
        "external_validation": external_validation(rules),
        "availability_timeline": availability_timeline(),
        "pipeline_friction": F.col("response_rate") * 50 + F.col("completion_rate") * 50,
    }
    if needed is not None:
        scores = {name: F.when(needed, score) for name, score in scores.items()}
    # The explanation needs the environment of every ranked row.
    scores["career_environment"] = career_environment(rules)
    return df.withColumns(scores)


def with_relevance_index(df: DataFrame, rules: Rules) -> DataFrame:
    """The best of the ways to show core relevance, to one decimal."""
    ways = [reduce(lambda a, b: a + b, [F.lit(share) * F.col(name) for name, share in mix.items()])
            for mix in rules.relevance_mix]
    best = F.greatest(*ways) if len(ways) > 1 else ways[0]
    return df.withColumn("cri", round_exact(best, 1))


def _group_score(weights: dict, points: float) -> Column:
    """Weighted mean of the scores, as a share of the group's points."""
    weighted = F.array(*[F.col(name) * float(weight) / 100 for name, weight in weights.items()])
    return compensated_sum(weighted) / sum(weights.values()) * points


def with_raw_fit(df: DataFrame, rules: Rules) -> DataFrame:
    """Weighted total (two decimals) and its breakdown (one decimal)."""
    groups = {name: _group_score(weights, rules.group_points[name]) for name, weights in rules.weights.items()}
    df = df.withColumns({f"_{name}": score for name, score in groups.items()})
    total = F.col("_technical_fit") + F.col("_engineering_culture") + F.col("_hireability")
    return df.withColumns({
        "raw_fit": round_exact(total, 2),
        "technical_fit": round_exact(F.col("_technical_fit"), 1),
        "engineering_culture": round_exact(F.col("_engineering_culture"), 1),
        "hireability": round_exact(F.col("_hireability"), 1),
        "tech_sub_scores": F.create_map(*[
            part for name in rules.technical_weights
            for part in (F.lit(name), round_exact(F.col(name), 1))]),
    }).drop("_technical_fit", "_engineering_culture", "_hireability")


def ceiling(cri: Column, rules: Rules) -> Column:
    chain = None
    for below, limit in rules.ceilings:
        chain = F.when(cri < below, float(limit)) if chain is None else chain.when(cri < below, float(limit))
    return chain.otherwise(float(rules.top_ceiling))


def with_ceiling(df: DataFrame, rules: Rules) -> DataFrame:
    return df.withColumn("capped_fit", F.least(F.col("raw_fit"), ceiling(F.col("cri"), rules)))
