"""A sentence per ranked row that says why it is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from profilerank import vocabulary as v
from profilerank.functions.numbers import fixed_text
from profilerank.functions.outcomes import best_factor, best_outcome, outcomes
from profilerank.functions.text import any_sql, any_term, bind, quoted
from profilerank.operators.career import core_skills
from profilerank.operators.phrase_tables import with_claims
from profilerank.rules import Rules


def comparison_sql(needle: str, text: str, rules: Rules) -> str:
    """The first mention of the needle only serves to play the work down."""
    at = f"locate({quoted(needle)}, {text})"
    before = f"substr({text}, greatest(1, {at} - {v.COMPARATIVE_WINDOW}), least({v.COMPARATIVE_WINDOW}, greatest(0, {at} - 1)))"
    return any_sql(rules.terms.comparative, before)


def named_phrase(text: str, rules: Rules) -> Column:
    """Sentence part of the strongest phrase that is a genuine claim, else null."""
    cases = " ".join(
        f"when contains({text}, {quoted(needle)}) and not {comparison_sql(needle, text, rules)} then {quoted(said)}"
        for needle, said in v.EVIDENCE_PHRASES)
    return F.expr(f"case {cases} end")


def outcome_suffix(text: str, rules: Rules) -> Column:
    def said(best, factor):
        return (
            F.when(best.isNotNull(), F.concat(
                F.lit(" ("), best["verb"], F.lit(" "), best["metric"], F.lit(" by "), best["amount"], F.lit("%)")))
            .when(factor.isNotNull(), F.concat(F.lit(" (a "), factor, F.lit("x improvement)")))
            .when(any_term(rules.terms.formal_eval, text), F.lit(f" ({v.SUFFIX_EVAL})"))
            .when(any_term(rules.terms.scale_words, text), F.lit(f" ({v.SUFFIX_SCALE})"))
            .otherwise(F.lit("")))

    return bind(best_outcome(outcomes(F.col(text))), lambda best: bind(best_factor(F.col(text)), lambda factor: said(best, factor)))


def topic_phrase(text: str, rules: Rules) -> Column:
    disclaimed = any_term(rules.terms.disclaimers, text)
    return F.coalesce(*[
        F.when(any_term(v.fragments(needles), text),
               F.when(disclaimed, F.lit(said_less)).otherwise(F.lit(said)))
        for needles, said, said_less in v.EVIDENCE_TOPICS], F.lit(v.EVIDENCE_CONFIRMED))


def with_evidence_text(df: DataFrame, rules: Rules, phrases: DataFrame | None = None) -> DataFrame:
    """The strongest evidence of a profile in words.

    ``phrases`` may replace the phrases and topics of the vocabulary by a table of any size.
    """
    t, text, career = rules.terms, "trust_text", "career_text"
    phrase, topic = named_phrase(text, rules), topic_phrase(text, rules)
    names = df.columns
    if phrases is not None:
        df = with_claims(df, text, phrases)
        said = F.when(any_term(t.disclaimers, text), F.col("_topic_less")).otherwise(F.col("_topic"))
        phrase, topic = F.col("_claim"), F.coalesce(said, F.lit(v.EVIDENCE_CONFIRMED))
    df = df.withColumns({
        "_held": F.expr("coalesce(try_element_at(filter(jobs, j -> j.is_current), 1).title, '')"),
        "_phrase": phrase,
    })
    vision = any_term(t.vision_titles, "_held")
    trusted = F.when(
        F.col("_phrase").isNotNull(), F.concat(F.col("_phrase"), outcome_suffix(text, rules))
    ).otherwise(topic)
    technical = any_term(t.ml_signal, career, "career_words") & ~any_term(t.ml_disclaimers, career)
    evidence = (
        F.when(F.col("evidence_trusted"), trusted)
        .when(F.col("evidence_found") & vision, v.EVIDENCE_MISMATCH_VISION)
        .when(F.col("evidence_found"), v.EVIDENCE_MISMATCH)
        .when(vision, v.EVIDENCE_VISION)
        .when((F.col("career_environment") >= 95) & technical, v.EVIDENCE_FOUNDING)
        .when(any_term(t.deploy, career),
              F.when(F.col("career_disclaimed"), v.EVIDENCE_DEPLOY_DISCLAIMED).otherwise(v.EVIDENCE_DEPLOY))
        .when(any_term(t.data_signal, career), v.EVIDENCE_DATA)
        .otherwise(v.EVIDENCE_NONE))
    return df.withColumn("evidence", evidence).select(*names, "evidence")


def filler_text(cri: Column) -> Column:
    rounded = F.concat(F.lit("CRI "), fixed_text(cri, 0), F.lit("/100 - "))
    reason = (F.when(cri < 10, F.lit(v.FILLER_NONE))
              .when(cri < 25, F.concat(rounded, F.lit(v.FILLER_LOW)))
              .otherwise(F.concat(rounded, F.lit(v.FILLER_ADJACENT))))
    return F.concat(F.lit(f" {v.FILLER_HEAD} ("), reason, F.lit(f"). {v.FILLER_TAIL}"))


def first_concern(df: DataFrame) -> Column:
    """The most important concern, technical ones first; null if none."""
    cri, location = F.col("cri"), F.lower("location")
    stays = ~F.coalesce(F.col("relocate"), F.lit(True))
    for place in v.RELOCATION_EXEMPT:
        stays = stays & ~location.contains(place)
    inflated = F.col("continue_scoring") & F.exists("penalty_flags", lambda f: f.startswith(v.FLAG_INFLATION))
    return F.coalesce(
        F.when((cri > 0) & (cri < 60),
               F.concat(F.lit("CRI only "), fixed_text(cri, 0), F.lit(f"/100 -- {v.CONCERN_CRI}"))),
        F.when(inflated, F.lit(v.CONCERN_SKILLS)),
        F.when(F.col("notice_days") > 60,
               F.concat(F.col("notice_days").cast("string"), F.lit(v.CONCERN_NOTICE))),
        F.when(stays, F.lit(v.CONCERN_RELOCATION)))


def with_reasoning(df: DataFrame, rules: Rules, phrases: DataFrame | None = None) -> DataFrame:
    """The whole sentence.  Meant for the ranked rows, not for the whole input."""
    df = with_evidence_text(df, rules, phrases).withColumn("core_skills", core_skills(rules))
    opening = F.concat(
        F.coalesce("current_title", F.lit("Candidate")), F.lit(" with "), fixed_text(F.col("years"), 1),
        F.lit(" yrs; "), F.col("core_skills").cast("string"), F.lit(" AI core skills; response rate "),
        fixed_text(F.col("response_rate"), 2), F.lit("."))
    concern = F.coalesce(F.concat(F.lit(" Concern: "), first_concern(df), F.lit(".")), F.lit(""))
    return df.withColumn("reasoning", F.concat(
        opening,
        F.when(F.col("route") == v.ROUTE_ALTERNATE, filler_text(F.col("cri")))
        .otherwise(F.concat(F.lit(" Evidence: "), F.col("evidence"), F.lit("."), concern))))
