"""The registered queries: every operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from profilerank.functions.numbers import round_exact
from profilerank.functions.outcomes import best_factor
from profilerank.operators import outcomes as outcome_ops
from profilerank.operators import ranking, reports, terms as term_ops
from profilerank.operators.outcome_tables import outcome_table, strict_outcomes
from profilerank.operators.phrase_tables import phrase_table
from profilerank.operators.scorecards import top_by_scorecard
from profilerank.operators.term_tables import term_table_hits
from profilerank.operators.tiers import with_tier
from profilerank.operators.title_tables import code, title_table, with_title_codes
from profilerank.operators.calibration import with_calibration
from profilerank.operators.career import core_skills as core_skills_of, recency_factor, title_tier_sql, with_verbs
from profilerank.operators.confidence import with_confidence
from profilerank.operators.decisions import decision_table
from profilerank.operators.explanation import (
    comparison_sql, named_phrase, with_evidence_text, with_reasoning,
)
from profilerank.operators.gates import with_alternate_track, with_gates
from profilerank.operators.quality import with_anomalies
from profilerank.operators.scorecard import (
    with_ceiling, with_core_scores, with_other_scores, with_raw_fit, with_relevance_index,
)
from profilerank.operators.texts import (
    contradicts_sql, suits_relevance_role_sql, vision_only_sql, with_texts,
)
from profilerank.plans import derived
from profilerank.plans.scoring import ranked, run, score_table, scored, with_features
from profilerank.rules import Rules
from profilerank.session import scratch_dir, written
from profilerank.sources import (
    accepted, keep_last, normalise, read_profiles, read_scores, reject_report, stream_profiles,
    write_ranked, write_scores,
)
from profilerank.streaming import read_board, read_newest_board, start_board, start_newest_board
from profilerank.vocabulary import DEFAULT_TIER, EVIDENCE_PHRASES, TermList

Query = Callable[[SparkSession, str], DataFrame]
RULES = Rules()
TOP = 100

# Words that do occur in the documents, in both modes and more than one script.
DOCUMENT_TERMS = TermList(
    fragments=("here", "licensed", "ann", "the ", "und ", "été", "tion"),
    words=("the", "of", "here", "ann", "de", "la", "und", "der"),
)
MARKUP_TERMS = TermList(fragments=("<p", "href=", "script"), words=("div", "span", "html", "nav"))
TURN_TERMS = TermList(fragments=("ing ", "?"), words=("the", "a", "how", "what"))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise(derived.profiles(spark, sf_dir))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_features(base(spark, sf_dir), RULES)


def all_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every score of every profile, wherever its scoring would stop."""
    return (features(spark, sf_dir).transform(with_core_scores, RULES)
            .transform(with_relevance_index, RULES).transform(with_other_scores, RULES))


def whole(name: str, value: Column | None = None) -> Column:
    """A flag or count as a plain whole number."""
    return (F.col(name) if value is None else value).cast("bigint").alias(name)


def joined(name: str, array: str) -> Column:
    return F.concat_ws("|", array).alias(name)


# -- terms -----------------------------------------------------------------

def term_features_docs(spark, sf_dir):
    docs = derived.table(spark, sf_dir, "documents").select("doc_id", "text")
    return term_ops.with_term_features(docs, "text", DOCUMENT_TERMS)


def term_any_docs(spark, sf_dir):
    return term_features_docs(spark, sf_dir).select("doc_id", whole("term_any"))


def term_count_docs(spark, sf_dir):
    return term_features_docs(spark, sf_dir).select("doc_id", whole("term_count"))


def term_occurrences_docs(spark, sf_dir):
    return term_features_docs(spark, sf_dir).select("doc_id", whole("term_occurrences"))


def relevance_terms_docs(spark, sf_dir):
    docs = derived.table(spark, sf_dir, "documents").select("lang", "source", "text")
    found = term_ops.with_term_features(docs, "text", RULES.terms.ir)
    return found.groupBy("lang").agg(
        F.count("*").alias("docs"), F.count_if("term_any").alias("hit_docs"),
        F.sum("term_count").alias("hits"))


def term_hits_by_lang(spark, sf_dir):
    docs = derived.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    hits = term_ops.term_hits(docs, ["doc_id", "lang"], "text", DOCUMENT_TERMS)
    return hits.groupBy("lang", "term", "mode").agg(F.count("*").alias("docs"), F.sum("n").alias("hits"))


def term_hits_pages(spark, sf_dir):
    pages = derived.table(spark, sf_dir, "pages").select("page_id", "html")
    return term_ops.term_hits(pages, ["page_id"], "html", MARKUP_TERMS)


def benchmark_terms(spark, sf_dir):
    """A term table from the benchmark texts: words, phrases, and pieces of both."""
    texts = derived.table(spark, sf_dir, "benchmark").select(F.lower("text").alias("t"))
    words = (texts.select(F.expr(r"regexp_extract_all(t, '[\\p{L}\\p{N}_]+', 0)").alias("w"))
             .select(F.explode(F.expr("transform(w, (a, i) -> struct(a, get(w, i + 1) AS b))")).alias("w")).select("w.*"))
    one = lambda mode, term: F.struct(F.lit(mode).alias("mode"), F.expr(term).alias("term"))
    found = words.select(F.explode(F.array(
        one("word", "a"), one("word", "a || ' ' || b"), one("word", "a || ', ' || b"),
        one("substring", "if(length(a) > 4, substr(a, 2, 4), null)"),
        one("substring", "right(a, 2) || ' ' || left(b, 2)"), one("substring", "right(a, 2) || '. ' || left(b, 1)"))).alias("x"))
    return found.select("x.term", "x.mode")


def term_table_hits_docs(spark, sf_dir):
    """Every term of the table in every document."""
    docs = derived.table(spark, sf_dir, "documents").select("doc_id", "text")
    return term_table_hits(docs, ["doc_id"], "text", benchmark_terms(spark, sf_dir))


def term_hits_by_label(spark, sf_dir):
    """Term hits of labelled documents by label; the labels join on the document id."""
    docs = derived.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = derived.table(spark, sf_dir, "labels")
    found = (term_ops.with_term_features(docs, "text", DOCUMENT_TERMS)
             .select("doc_id", "term_count", "term_occurrences"))
    return labels.join(found, "doc_id").groupBy("quality", "toxic").agg(
        F.count("*").alias("docs"), F.sum("term_count").alias("terms"),
        F.sum("term_occurrences").alias("hits"))


def terms_by_role(spark, sf_dir):
    """Conversation turns the way jobs are seen: the role plays the title, and
    what the assistant says is not trusted."""
    turns = derived.table(spark, sf_dir, "conversations")
    found = term_ops.with_term_features(turns, "text", TURN_TERMS)
    trusted = F.col("role") != "assistant"
    return found.groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.count_if(trusted).alias("trusted_turns"),
        F.sum(F.when(trusted, F.length("text")).otherwise(0)).alias("trusted_chars"),
        F.sum(F.when(trusted, F.col("term_count")).otherwise(0)).alias("trusted_terms"),
        F.min(F.when(trusted & F.col("term_any"), F.col("turn"))).alias("first_hit"),
        F.max(F.when(trusted & F.col("term_any"), F.col("turn"))).alias("last_hit"))


# -- texts and jobs ----------------------------------------------------------

def profile_text(spark, sf_dir):
    return with_texts(base(spark, sf_dir), RULES).select(
        "candidate_id", F.length("full_text").cast("bigint").alias("full_chars"),
        *[F.md5(f"{n}_text").alias(f"{n}_md5") for n in ("full", "career", "skills", "trust")])


def title_checks(spark, sf_dir):
    one = (base(spark, sf_dir).select("candidate_id", F.explode("jobs").alias("j"))
           .select("candidate_id", F.col("j.pos").alias("pos"), F.lower("j.title").alias("title")))
    return one.select(
        "candidate_id", whole("pos"), whole("contradicts", F.expr(contradicts_sql("title", RULES))),
        whole("vision_only", F.expr(vision_only_sql("title", RULES))),
        whole("relevant", F.expr(suits_relevance_role_sql("title", RULES))),
        whole("tier", F.expr(title_tier_sql("title"))))


def evidence_pick(spark, sf_dir):
    return features(spark, sf_dir).select(
        "candidate_id", whole("evidence_found"), whole("evidence_trusted"), whole("ir_anywhere"),
        F.coalesce(F.col("evidence_job.pos"), F.lit(-1)).cast("bigint").alias("job"),
        F.when(F.col("evidence_found"), recency_factor(F.col("evidence_job"), RULES)).otherwise(0.0).alias("recency"))


def recent_activity(spark, sf_dir):
    return features(spark, sf_dir).select("candidate_id", whole("has_python"), whole("recent_code"))


def title_tiers(spark, sf_dir):
    return features(spark, sf_dir).select(
        "candidate_id", F.array_join(F.col("tiers").cast("array<string>"), ",").alias("tiers"))


def title_chaser(spark, sf_dir):
    return features(spark, sf_dir).select("candidate_id", whole("title_chaser"))


def tenure_stability(spark, sf_dir):
    return features(spark, sf_dir).select(
        "candidate_id", round_exact(F.coalesce("tenure", F.lit(0.0)), 4).alias("tenure"), whole("short_tenure"))


def all_at_listed_firms(spark, sf_dir):
    return features(spark, sf_dir).select("candidate_id", whole("service_only"), whole("ownership_word"))


def first_matching_job(spark, sf_dir):
    return features(spark, sf_dir).select(
        "candidate_id", F.coalesce("first_ml", F.lit("none")).alias("first_ml"), whole("genai_wrapper"))


def research_only(spark, sf_dir):
    return features(spark, sf_dir).select("candidate_id", whole("research_only"))


def career_flags(spark, sf_dir):
    return features(spark, sf_dir).select("candidate_id", whole("career_disclaimed"), whole("career_outcome"))


def verb_counts(spark, sf_dir):
    return with_verbs(features(spark, sf_dir), RULES).select(
        "candidate_id", *[whole(c) for c in ("builder_verbs", "leader_verbs", "passive_verbs", "all_verbs")],
        "shipping_velocity")


def skill_gap(spark, sf_dir):
    return features(spark, sf_dir).select("candidate_id", round_exact(F.col("skill_gap"), 6).alias("skill_gap"))


def core_skills(spark, sf_dir):
    return base(spark, sf_dir).select(
        "candidate_id", whole("core_skills", core_skills_of(RULES)))


def all_outcomes(spark, sf_dir):
    return (with_texts(base(spark, sf_dir), RULES)
            .transform(outcome_ops.extract_outcomes, ["candidate_id"], "trust_text")
            .select("candidate_id", whole("pos"), "verb", "metric", "value"))


def best_outcome(spark, sf_dir):
    return (with_texts(base(spark, sf_dir), RULES)
            .transform(outcome_ops.best_outcomes, ["candidate_id"], "trust_text")
            .select("candidate_id", "verb", "metric", "amount", "value"))


def outcome_factor(spark, sf_dir):
    texts = with_texts(base(spark, sf_dir), RULES)
    return texts.select("candidate_id", F.coalesce(best_factor(F.col("trust_text")), F.lit("none")).alias("factor"))


def comparisons(spark, sf_dir):
    text = "trust_text"
    flags = [F.expr(comparison_sql(needle, text, RULES)) & F.col(text).contains(needle)
             for needle, _ in EVIDENCE_PHRASES]
    return with_texts(base(spark, sf_dir), RULES).select(
        "candidate_id",
        F.concat(*[f.cast("int").cast("string") for f in flags]).alias("comparisons"),
        F.coalesce(named_phrase(text, RULES), F.lit("none")).alias("phrase"))


# -- scores ------------------------------------------------------------------

CORE = ("relevance_ownership", "recommendation_ownership", "evaluation_rigor", "retrieval_architecture")
OTHER = ("production_ml", "product_ownership", "career_environment", "production_scale", "search_infra",
         "founding_team_fit", "python_depth", "distributed_systems", "external_validation",
         "availability_timeline")


def score_query(name: str) -> Query:
    def query(spark, sf_dir):
        return all_scores(spark, sf_dir).select("candidate_id", name)
    return query


def score_hiring_friction(spark, sf_dir):
    return all_scores(spark, sf_dir).select(
        "candidate_id", round_exact(F.col("pipeline_friction"), 4).alias("hiring_friction"))


def relevance_index(spark, sf_dir):
    return all_scores(spark, sf_dir).select("candidate_id", "cri")


def fit(spark, sf_dir):
    return with_raw_fit(all_scores(spark, sf_dir), RULES)


def raw_fit(spark, sf_dir):
    return fit(spark, sf_dir).select(
        "candidate_id", "raw_fit", "technical_fit", "engineering_culture", "hireability",
        *[F.try_element_at("tech_sub_scores", F.lit(n)).alias(f"b_{n}") for n in RULES.technical_weights])


def relevance_ceiling(spark, sf_dir):
    return with_ceiling(fit(spark, sf_dir), RULES).select("candidate_id", "cri", "capped_fit")


# -- gates, calibration, confidence --------------------------------------------

def gated(spark, sf_dir):
    return (features(spark, sf_dir).transform(with_core_scores, RULES)
            .transform(with_relevance_index, RULES).transform(with_gates, RULES)
            .transform(with_alternate_track, RULES))


def gate_route(spark, sf_dir):
    return gated(spark, sf_dir).select(
        "candidate_id", "route", whole("passed_gates"), whole("continue_scoring"))


def gate_flags(spark, sf_dir):
    return gated(spark, sf_dir).select("candidate_id", joined("flags", "flags"))


def alternate_track(spark, sf_dir):
    return gated(spark, sf_dir).select("candidate_id", F.col("alternate_pipeline").alias("track"))


def calibrated(spark, sf_dir):
    return (with_ceiling(fit(spark, sf_dir), RULES).transform(with_calibration, RULES)
            .select("candidate_id", "calibrated", joined("penalties", "penalty_flags")))


def anomaly(spark, sf_dir):
    rules = ("impossible_jobs", "idle_experts", "inverted_salary", "active_before_signup", "stuffed_skills")
    return (with_texts(base(spark, sf_dir), RULES).transform(with_anomalies, RULES)
            .select("candidate_id", *[whole(r) for r in rules],
                    round_exact(F.col("anomaly_factor"), 4).alias("factor")))


def confidence(spark, sf_dir):
    return (features(spark, sf_dir).transform(with_verbs, RULES).transform(with_confidence, RULES)
            .select("candidate_id", round_exact(F.col("coverage"), 6).alias("coverage"),
                    round_exact(F.col("reliability"), 6).alias("reliability"),
                    round_exact(F.col("consistency"), 6).alias("consistency"),
                    round_exact(F.col("confidence"), 4).alias("confidence")))


def final_score(spark, sf_dir):
    return scored(base(spark, sf_dir), RULES).select("candidate_id", "route", "final_score")


def flat_record(scores: DataFrame) -> DataFrame:
    return scores.select(
        "candidate_id", whole("passed_gates"), "route", joined("flags", "flags"), "final_score",
        "raw_fit_score", "cri", "shipping_velocity", round_exact(F.col("confidence"), 4).alias("confidence"),
        F.col("alternate_pipeline").alias("track"), F.col("breakdown.technical_fit").alias("technical_fit"),
        F.col("breakdown.engineering_culture").alias("engineering_culture"),
        F.col("breakdown.hireability").alias("hireability"), joined("penalties", "penalty_flags"),
        round_exact(F.col("honeypot_multiplier"), 4).alias("honeypot_multiplier"))


def score_record(spark, sf_dir):
    return flat_record(score_table(base(spark, sf_dir), RULES))


# -- ranking -----------------------------------------------------------------

def top_rows(spark, sf_dir):
    """The first records of the score table, which is written once and ranked from there."""
    return written(score_table(base(spark, sf_dir), RULES), "scores").transform(ranking.top_n, TOP)


def top_n(spark, sf_dir):
    return top_rows(spark, sf_dir).select(whole("rank"), "candidate_id", "final_score", "route")


def rank_order_check(spark, sf_dir):
    return ranking.order_violations(top_rows(spark, sf_dir))


def explained_top_n(spark, sf_dir):
    return ranked(base(spark, sf_dir), TOP, RULES).select("candidate_id", whole("rank"), "score", "reasoning")


def explained_profiles(spark, sf_dir):
    """The sentence of every profile, which brings up every branch of it."""
    return (scored(base(spark, sf_dir), RULES).transform(with_reasoning, RULES)
            .select("candidate_id", "reasoning"))


def evidence_text(spark, sf_dir):
    return (all_scores(spark, sf_dir).transform(with_evidence_text, RULES)
            .select("candidate_id", "evidence"))


def run_summary(spark, sf_dir):
    return reports.run_summary(score_table(base(spark, sf_dir), RULES), TOP)


def route_report(spark, sf_dir):
    return (reports.route_report(score_table(base(spark, sf_dir), RULES))
            .withColumnRenamed("alternate_pipeline", "track"))


def score_histogram(spark, sf_dir):
    return reports.score_histogram(score_table(base(spark, sf_dir), RULES))


def leading_rows(spark, sf_dir):
    return reports.leading_rows(top_rows(spark, sf_dir), 20).select(
        whole("rank"), "candidate_id", "final_score", "raw_fit_score", "cri", "route", joined("flags", "flags"))


# -- rules that come as tables --------------------------------------------------

def evidence_from_table(spark, sf_dir):
    """The evidence in words, its phrases and topics looked up in a table."""
    return (with_evidence_text(all_scores(spark, sf_dir), RULES, phrase_table(spark))
            .select("candidate_id", "evidence"))


def strict_outcomes_from_table(spark, sf_dir):
    """Whether a profile tells a strict outcome, by the table of verbs and metrics."""
    texts = with_texts(base(spark, sf_dir), RULES).select("candidate_id", "trust_text")
    found = strict_outcomes(texts, ["candidate_id"], "trust_text", outcome_table(spark))
    return found.select("candidate_id", whole("strict"))


def titled_jobs(spark, sf_dir):
    """The jobs of every profile, one row each, and a row without a job for profiles that have none."""
    jobs = base(spark, sf_dir).select("candidate_id", F.explode_outer("jobs").alias("j")).select(
        "candidate_id", "j.pos", F.col("j.start_date").alias("start"), F.col("j.title").alias("title"))
    return with_title_codes(jobs, "title", title_table(spark, RULES))


def title_checks_from_table(spark, sf_dir):
    """The title tests of every job, from a table of rules."""
    return titled_jobs(spark, sf_dir).filter(F.col("pos").isNotNull()).select(
        "candidate_id", whole("pos"), *[whole(rule, code("codes", rule)) for rule in ("contradicts", "vision_only", "relevant")],
        whole("tier", code("codes", "tier", DEFAULT_TIER)))


def title_tiers_from_table(spark, sf_dir):
    """The tiers of every profile by start date, from a table of rules."""
    place = F.when(F.col("pos").isNotNull(), F.struct("start", "pos", code("codes", "tier", DEFAULT_TIER).alias("tier")))
    tiers = F.array_sort(F.collect_list(place))["tier"]  # of one profile
    return titled_jobs(spark, sf_dir).groupBy("candidate_id").agg(
        F.array_join(tiers.cast("array<string>"), ",").alias("tiers"))


def decisions_from_table(spark, sf_dir):
    """Route, track and anomaly factor of every profile by the rules of a decision table."""
    table = decision_table(spark, RULES)
    return (features(spark, sf_dir).transform(with_core_scores, RULES).transform(with_relevance_index, RULES)
            .transform(with_gates, RULES, table).transform(with_alternate_track, RULES, table).transform(with_anomalies, RULES, table)
            .select("candidate_id", "route", whole("passed_gates"), whole("continue_scoring"),
                    F.col("alternate_pipeline").alias("track"), round_exact(F.col("anomaly_factor"), 4).alias("factor")))


SCORECARD_TOP = 10


def scorecard_weights(spark, sf_dir):
    """A scorecard of every supplier: the weights go by its key."""
    names = [n for group in RULES.weights.values() for n in group]
    suppliers = derived.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("scorecard"))
    each = F.array(*[F.struct(F.lit(n).alias("score"), ((F.col("scorecard") * 7 + 13 * i) % 21).cast("double").alias("weight"))
                     for i, n in enumerate(names)])
    return suppliers.select("scorecard", F.explode(each).alias("w")).select("scorecard", "w.*")


def scorecards_top_n(spark, sf_dir):
    """The best profiles of every scorecard."""
    names = [n for group in RULES.weights.values() for n in group]
    best = top_by_scorecard(all_scores(spark, sf_dir).select("candidate_id", *names), "candidate_id", names,
                            scorecard_weights(spark, sf_dir), SCORECARD_TOP)
    return best.select("scorecard", whole("rank"), "candidate_id", "points", "total")


def ceiling_tiers(spark):
    """The ceilings as a table (lower, upper, limit)."""
    bounds = [None, *[below for below, _ in RULES.ceilings], None]
    limits = [*[limit for _, limit in RULES.ceilings], RULES.top_ceiling]
    rows = [(a if a is None else float(a), b if b is None else float(b), float(limit)) for a, b, limit in zip(bounds, bounds[1:], limits)]
    return spark.createDataFrame(rows, "lower double, upper double, limit double")


def ceiling_from_table(spark, sf_dir):
    scores = with_tier(fit(spark, sf_dir).select("candidate_id", "cri", "raw_fit"), "cri", ceiling_tiers(spark), "limit", "limit")
    return scores.select("candidate_id", "cri", F.least("raw_fit", "limit").alias("capped_fit"))


def order_price_tiers(spark, sf_dir):
    """Orders by the price tier of a table of one tier for each part price: tiers by ranges of the value."""
    prices = derived.table(spark, sf_dir, "part").select(((F.col("p_retailprice") - 899) * 5000).alias("lower")).distinct()
    upper = F.lead("lower").over(Window.partitionBy(F.lit(0)).orderBy("lower"))
    tiers = prices.select("lower", upper.alias("upper"), F.col("lower").alias("tier"))
    orders = derived.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"))
    return with_tier(orders, "price", tiers, "tier", "tier").select("o_orderkey", "tier")


def rank_all(spark, sf_dir):
    """The rank of every profile."""
    scores = scored(base(spark, sf_dir), RULES).select("candidate_id", "final_score")
    return ranking.ranked_all(scores).select(whole("rank"), "candidate_id", "final_score")


def rank_all_check(spark, sf_dir):
    return ranking.order_violations_of_all(rank_all(spark, sf_dir))


# -- sources, sinks and streams ----------------------------------------------

def json_round_trip(spark, sf_dir):
    """Profiles written as gzipped JSON lines, read back and scored."""
    path = scratch_dir(spark, "json") + "/profiles"
    derived.profiles(spark, sf_dir).write.option("compression", "gzip").json(path)
    profiles = normalise(accepted(read_profiles(spark, path)))
    return scored(profiles, RULES).select("candidate_id", "route", "final_score")


def mixed_lines(spark: SparkSession, sf_dir: str, path: str) -> str:
    """Write good and bad JSON lines, compressed: a profile repeats the names of its fields many times.

    Conversation texts are no JSON objects; every one of them is a bad line.  Files of this codec are read
    where they lie, those of gzip would be spread.
    """
    good = derived.profiles(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value"))
    bad = derived.table(spark, sf_dir, "conversations").select(
        F.regexp_replace(F.concat(F.lit("not json: "), "text"), "[\\r\\n]", " ").alias("value"))
    good.unionByName(bad).write.option("compression", "deflate").text(path)
    return path


def read_report(spark, sf_dir):
    """Line counts of a JSON source that holds good and bad lines."""
    lines = mixed_lines(spark, sf_dir, scratch_dir(spark, "mixed") + "/lines")
    return reject_report(read_profiles(spark, lines, fmt="json"))


def run_report(spark, sf_dir):
    """The line counts that a run reports from the pass that scores."""
    path = scratch_dir(spark, "mixed")
    counts = run(spark, mixed_lines(spark, sf_dir, f"{path}/lines.json"), f"{path}/ranked", TOP, RULES)
    return spark.createDataFrame([counts], ", ".join(f"{c} long" for c in counts))


def scores_round_trip(spark, sf_dir):
    """The score table written by route and read back."""
    path = scratch_dir(spark, "scores") + "/scores"
    write_scores(score_table(base(spark, sf_dir), RULES), path)
    return flat_record(read_scores(spark, path))


def ranked_csv_round_trip(spark, sf_dir):
    """The ranked CSV file, read back."""
    path = scratch_dir(spark, "ranked") + "/ranked"
    write_ranked(ranked(base(spark, sf_dir), TOP, RULES), path)
    back = (spark.read.option("header", True).option("escape", '"').option("lineSep", "\r\n")
            .schema("candidate_id string, rank bigint, score string, reasoning string").csv(path))
    return back.select("candidate_id", "rank", "score", "reasoning")


def newest_order_per_customer(spark, sf_dir):
    """The last record per key, by date and then key."""
    orders = derived.table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return keep_last(orders, ["o_orderdate", "o_orderkey"], key="o_custkey").select(
        "o_custkey", "o_orderkey", "o_totalprice")


BATCHES = 3
FEWEST = 50  # profiles that are worth a file of their own


PARTS = "spark.sql.files.minPartitionNum"


@contextmanager
def small_parts(spark: SparkSession):
    """Files are read in four parts for every core, also by streams that start here: scoring takes long, and a part is a task."""
    before = spark.conf.get(PARTS, None)
    spark.conf.set(PARTS, 4 * spark.sparkContext.defaultParallelism)
    try:
        yield
    finally:
        spark.conf.set(PARTS, before) if before else spark.conf.unset(PARTS)


def arriving(profiles: DataFrame, path: str, *keys: str) -> int:
    """Write profiles as files that arrive at a stream; gives the number of files of a micro-batch, a file for every core.

    Profiles read from files are dealt to the micro-batches by a hash of their keys and written where they lie; only if they
    come from fewer files than there are cores are they shuffled.  A file has a quarter of a core's share of a micro-batch at most.
    """
    spark = profiles.sparkSession
    files = max(2, spark.sparkContext.defaultParallelism)
    if len(profiles.inputFiles()) < files:
        profiles = profiles.repartition(files, *keys)
    most = max(FEWEST, ceil(profiles.count() / (4 * files * BATCHES)))
    with small_parts(spark):
        for number in range(BATCHES):
            part = profiles.filter(F.pmod(F.xxhash64(*keys), F.lit(BATCHES)) == number)
            part.write.mode("append").option("maxRecordsPerFile", most).parquet(path)
    return ceil(len(spark.read.parquet(path).inputFiles()) / BATCHES)


def stream_top_n(spark, sf_dir):
    """The board after all profiles have streamed in, in a few micro-batches."""
    path = scratch_dir(spark, "stream")
    profiles = written(derived.profiles(spark, sf_dir), "profiles")
    files = arriving(profiles, f"{path}/profiles.parquet", "candidate_id")
    raw = stream_profiles(spark, f"{path}/profiles.parquet", files_per_batch=files)
    with small_parts(spark):
        start_board(raw, f"{path}/board", f"{path}/checkpoint", TOP, RULES).awaitTermination()
    return read_board(spark, f"{path}/board").select(whole("rank"), "candidate_id", "final_score", "route")


def neighbour(candidate_id: str) -> Column:
    """The id whose number differs in the last bit."""
    key = F.substring(candidate_id, 2, 8).cast("long")
    return F.concat(F.lit("C"), F.lpad((key + F.when(key % 2 == 0, 1).otherwise(-1)).cast("string"), 8, "0"))


def paired(spark, sf_dir):
    """(c_custkey, paired): the profiles whose neighbour is a profile, too."""
    ids = derived.ids(spark, sf_dir)
    return (ids.withColumn("candidate_id", neighbour("candidate_id")).join(ids.select("candidate_id"), "candidate_id", "left_semi")
            .select("c_custkey", F.lit(True).alias("paired")))


def twice(newest: DataFrame) -> DataFrame:
    """Profiles as version 2, and the ``paired`` ones also as version 1 under the id of their neighbour."""
    versions = F.when(F.col("paired"), F.array(F.lit(2), F.lit(1))).otherwise(F.array(F.lit(2)))
    return (newest.withColumn("version", F.explode(versions)).drop("paired")
            .withColumn("candidate_id", F.when(F.col("version") == 2, F.col("candidate_id")).otherwise(neighbour("candidate_id"))))


def stream_last_wins_top_n(spark, sf_dir):
    """The board of profiles that arrive twice, the earlier version with a neighbour's content, in no order."""
    path = scratch_dir(spark, "stream")
    # neighbours are told by their keys, so that no profile is shuffled again
    newest = written(derived.profiles(spark, sf_dir, marks=paired(spark, sf_dir)), "newest")
    files = arriving(twice(newest), f"{path}/profiles.parquet", "candidate_id", "version")
    raw = stream_profiles(spark, f"{path}/profiles.parquet", files_per_batch=files, extra="version int")
    with small_parts(spark):
        start_newest_board(raw, f"{path}/board", f"{path}/checkpoint", ["version"], TOP, RULES).awaitTermination()
    return read_newest_board(spark, f"{path}/board", TOP).select(whole("rank"), "candidate_id", "final_score", "route")


# -- the same primitives on the plain tables -----------------------------------

def order_topk(spark, sf_dir):
    orders = derived.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return ranking.top_n(orders, TOP, score="o_totalprice", key="o_orderkey").select(
        whole("rank"), "o_orderkey", "o_custkey", "o_totalprice")


def event_recency_score(spark, sf_dir):
    """Users by the recency tiers of their events; sums are of whole tenths."""
    events = derived.table(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    days = F.datediff(F.lit("2024-01-31").cast("date"), F.col("ts").cast("date"))
    tenths = F.when(days <= 7, 10).when(days <= 14, 9).when(days <= 21, 7).otherwise(5)
    return events.groupBy("user_id").agg(
        F.count("*").alias("events"), F.sum(tenths).alias("tenths"),
        F.sum(F.when(F.col("event_type") == "purchase", tenths).otherwise(0)).alias("purchase_tenths"))


def queries() -> dict[str, Query]:
    plain = (
        term_any_docs, term_count_docs, term_occurrences_docs, relevance_terms_docs, term_hits_by_lang,
        term_hits_pages, term_hits_by_label, terms_by_role, term_table_hits_docs,
        profile_text, title_checks, evidence_pick, recent_activity, title_tiers, title_chaser,
        tenure_stability, all_at_listed_firms, first_matching_job, research_only, career_flags,
        verb_counts, skill_gap, core_skills, all_outcomes, best_outcome, outcome_factor, comparisons,
        score_hiring_friction, relevance_index, raw_fit, relevance_ceiling,
        gate_route, gate_flags, alternate_track, calibrated, anomaly, confidence, final_score, score_record,
        top_n, rank_order_check, explained_top_n, explained_profiles, evidence_text,
        run_summary, route_report, score_histogram, leading_rows,
        evidence_from_table, strict_outcomes_from_table, title_checks_from_table, title_tiers_from_table, decisions_from_table, scorecards_top_n, ceiling_from_table, order_price_tiers, rank_all, rank_all_check,
        json_round_trip, read_report, run_report, scores_round_trip, ranked_csv_round_trip, newest_order_per_customer,
        stream_top_n, stream_last_wins_top_n, order_topk, event_recency_score,
    )
    named = {query.__name__: query for query in plain}
    named.update({f"score_{name}": score_query(name) for name in CORE + OTHER})
    return named
