"""From profiles to scores, and from scores to an explained top N.

All steps up to the top N are projections of one row, so they run where the
row was read: no shuffle, no state, and no Python but the search for fragments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from profilerank.operators.calibration import with_calibration
from profilerank.operators.career import with_career_features, with_evidence, with_skill_gap, with_verbs
from profilerank.operators.confidence import with_confidence
from profilerank.operators.explanation import with_reasoning
from profilerank.operators.gates import with_alternate_track, with_gates
from profilerank.operators.quality import with_anomalies
from profilerank.operators.ranking import formatted_score, score_record, top_n, with_final_score, with_keys
from profilerank.operators.scorecard import (
    with_ceiling, with_core_scores, with_other_scores, with_raw_fit, with_relevance_index,
)
from profilerank.operators.texts import with_texts
from profilerank.rules import Rules
from profilerank.session import written
from profilerank.sources import (
    accepted, keep_last, normalise, observed, read_profiles, read_scores, write_ranked, write_scores,
)


def with_features(profiles: DataFrame, rules: Rules) -> DataFrame:
    """Texts and career features of normalised profiles."""
    return (profiles
            .transform(with_texts, rules)
            .transform(with_evidence, rules)
            .transform(with_career_features, rules)
            .transform(with_skill_gap, rules))


def scored(profiles: DataFrame, rules: Rules | None = None) -> DataFrame:
    """All columns of the scoring, features included.

    The gates come right after the scores they look at, so that everything
    later is computed only for records whose scoring goes on.
    """
    rules = rules or Rules()
    going_on = F.col("continue_scoring")
    return (profiles
            .transform(with_features, rules)
            .transform(with_core_scores, rules)
            .transform(with_relevance_index, rules)
            .transform(with_gates, rules)
            .transform(with_alternate_track, rules)
            .transform(with_other_scores, rules, going_on)
            .transform(with_raw_fit, rules)
            .transform(with_ceiling, rules)
            .transform(with_calibration, rules)
            .transform(with_anomalies, rules)
            .transform(with_verbs, rules, going_on)
            .transform(with_confidence, rules)
            .transform(with_final_score, rules))


def score_table(profiles: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The score record of every profile."""
    return score_record(scored(profiles, rules))


def ranked(profiles: DataFrame, n: int = 100, rules: Rules | None = None,
           scores: DataFrame | None = None) -> DataFrame:
    """The explained top n: (candidate_id, rank, score, reasoning).

    The sentence is written after the cut, on n rows.  ``scores`` may hold the
    (candidate_id, final_score) of all profiles, if they were scored before.
    """
    rules = rules or Rules()
    return (scored(profiles, rules)
            .transform(top_n, n, scores=scores, rows=lambda best: scored(with_keys(profiles, best), rules))
            .transform(with_reasoning, rules)
            .select("candidate_id", "rank", formatted_score(F.col("final_score")).alias("score"), "reasoning"))


def run(spark: SparkSession, source: str, ranked_path: str, n: int = 100, rules: Rules | None = None,
        signals_field: str = "signals", scores_path: str | None = None, last_by: list[str] | None = None) -> dict[str, int]:
    """Read profiles, write the ranked CSV and, if asked for, the score table; gives the line counts of ``reject_report``.

    Profiles are scored once, into the score table or a table of (id, score), and ranked from it; the counts are
    taken in that pass.  ``last_by`` names columns of the source by which the last record of each id is kept.
    """
    raw, counts = read_profiles(spark, source, signals_field), Observation()

    def profiles(rows: DataFrame) -> DataFrame:
        kept = accepted(rows)
        return normalise(keep_last(kept, last_by) if last_by else kept, signals_field)

    if scores_path:
        write_scores(score_table(profiles(observed(raw, counts)), rules), scores_path)
        scores = read_scores(spark, scores_path).select("candidate_id", "final_score")
    else:
        scores = written(scored(profiles(observed(raw, counts)), rules).select("candidate_id", "final_score"), "scores")
    write_ranked(ranked(profiles(raw), n, rules, scores), ranked_path)
    return dict(counts.get)
