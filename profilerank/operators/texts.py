"""Text assembly: full, career, skills and trustworthy text of a profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from profilerank import vocabulary as v
from profilerank.functions.fragments import PARTS, TEXTS, fragments_of_texts
from profilerank.functions.text import any_sql, words_sql
from profilerank.rules import Rules


# Each text as the term tests take it: itself, its vocabulary words, its vocabulary fragments.
FULL, CAREER, SKILLS, TRUST = ((f"{name}_text", f"{name}_words", f"{name}_found") for name in TEXTS)
DESC, TITLE = (tuple(f"j.{name}{form}" for form in ("", "_words", "_found")) for name in PARTS)  # of one of ``job_terms``


def contradicts_sql(title: str, rules: Rules) -> str:
    """A (lower-case) job title that speaks against relevance work under it."""
    return any_sql(rules.terms.contradicting_titles, title)


def vision_only_sql(title: str, rules: Rules) -> str:
    return any_sql(rules.terms.vision_titles, title)


def suits_relevance_role_sql(title: str, rules: Rules) -> str:
    """Optional feature: a (lower-case) title that itself suggests relevance work."""
    return any_sql(rules.terms.relevant_titles, title)


def with_jobs(df: DataFrame, rules: Rules) -> DataFrame:
    """Bring each job's texts into matching form, once."""
    known = rules.terms.all_words
    return df.withColumn("jobs", F.expr(f"""
        transform(
          transform(jobs, j -> named_struct(
            'pos', j.pos, 'company_size', j.company_size, 'start_date', j.start_date, 'end_date', j.end_date,
            'months', j.months, 'is_current', j.is_current,
            'company', lower(j.company), 'industry', lower(j.industry),
            'title', lower(j.title), 'desc', lower(j.description))),
          j -> named_struct(
            'pos', j.pos, 'company_size', j.company_size, 'start_date', j.start_date, 'end_date', j.end_date,
            'months', j.months, 'is_current', j.is_current, 'company', j.company, 'industry', j.industry,
            'title', j.title, 'title_words', {words_sql('j.title', known)},
            'desc', j.desc, 'desc_words', {words_sql('j.desc', known)},
            'contradicted', {contradicts_sql('j.title', rules)}))"""))


def with_texts(df: DataFrame, rules: Rules) -> DataFrame:
    """Add the four texts and, for each, its vocabulary words and fragments; ``job_terms`` are the jobs with those of theirs.

    Texts are joined by single blanks; a list without entries adds nothing.
    """
    known = rules.terms.all_words
    none = "cast(array() as array<string>)"
    df = with_jobs(df, rules).withColumns({
        "_head": F.lower(F.concat_ws(" ", "summary", "headline")),
        "_certs": F.lower(F.array_join("certificates", " ")),
        "skills_text": F.lower(F.array_join(F.col("skills.name"), " ")),
        "career_text": F.expr("array_join(transform(jobs, j -> concat(j.desc, ' ', j.title)), ' ')"),
        "career_words": F.expr("flatten(transform(jobs, j -> concat(j.desc_words, j.title_words)))"),
        "_trusted": F.expr("filter(jobs, j -> not j.contradicted)"),
    })
    df = df.withColumn("skills_words", F.expr(words_sql("skills_text", known)))
    df = df.withColumns({
        "full_text": F.expr(f"""array_join(concat(array(_head),
            if(size(jobs) > 0, array(career_text), {none}), if(size(skills) > 0, array(skills_text), {none}),
            if(size(certificates) > 0, array(_certs), {none})), ' ')"""),
        "full_words": F.expr(f"""concat({words_sql('_head', known)}, career_words, skills_words,
            {words_sql('_certs', known)})"""),
        "trust_text": F.expr("array_join(_trusted.desc, ' ')"),
        "trust_words": F.expr("flatten(_trusted.desc_words)"),
    })
    fragments = rules.terms.all_fragments.union(v.OUTCOME_WORDS, *[words for _, words in v.TITLE_TIERS])
    df = df.withColumn("_found", fragments_of_texts(fragments))
    return df.withColumns({
        **{f"{name}_found": F.col(f"_found.{name}") for name in TEXTS},
        "job_terms": F.expr("""zip_with(jobs, _found.jobs, (j, f) -> named_struct(
            'pos', j.pos, 'company_size', j.company_size, 'start_date', j.start_date, 'end_date', j.end_date,
            'months', j.months, 'is_current', j.is_current, 'company', j.company, 'industry', j.industry,
            'title', j.title, 'title_words', j.title_words, 'title_found', f.title,
            'desc', j.desc, 'desc_words', j.desc_words, 'desc_found', f.desc, 'contradicted', j.contradicted))"""),
    }).drop("_head", "_certs", "_trusted", "_found")
