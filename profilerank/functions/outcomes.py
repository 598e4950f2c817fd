"""Patterns that recognise quantified outcomes in lower-case text."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, functions as F

from profilerank import vocabulary as v
from profilerank.functions.text import any_term, bind

_VERBS = "|".join(v.OUTCOME_VERBS)
_NOUNS = "|".join(v.OUTCOME_NOUNS)
_METRICS = "|".join(v.OUTCOME_METRICS)
_FILLERS = "|".join(v.OUTCOME_FILLERS)

# Outcome patterns.  (?U) gives \w, \d and \s their Unicode meaning.
PERCENT_OR_TIMES = r"(?U)\d\s*%|\dx\s"
POINTS_OR_METRIC_CHANGE = (
    r"(?U)\d\s*pp\b"
    rf"|(?:{_VERBS})\s+[\w\-\s]{{0,30}}?(?:{_METRICS})"
    rf"|(?:{_METRICS})[\w\-\s]{{0,30}}?(?:{_VERBS}|went from|from \d)"
)
VERB_OUTCOME = rf"(?U)({_VERBS})\s+([\w\-\s]{{0,40}}?)\s*(?:by\s*)?(\d+(?:\.\d+)?)\s*%"
NOUN_ENDING = rf"(?U)(?:{_NOUNS})\s+(?:of|in)?\s*(\d+(?:\.\d+)?)\s*%"
NOUN_OUTCOME = rf"(?U)([\w\-\s]{{0,40}}?)\s*{NOUN_ENDING.removeprefix('(?U)')}"
BEFORE_NOUN_PHRASE = rf"(?Us)\A.*[^\w\-\s](?=[\w\-\s]*{NOUN_ENDING.removeprefix('(?U)')}\z)"
TIMES_OUTCOME = r"(?U)(\d+(?:\.\d+)?)\s*x\s"
LEADING_FILLERS = rf"(?U)\A(?:(?:{_FILLERS})\s+){{1,3}}"
_BLANKS = r"(?U)\A\s+|\s+\z"
_DIGITS = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]


def number(written: Column) -> Column:
    """The value of a number written in the decimal digits of any script; null if it is none."""
    plain = F.translate(written, "".join(_DIGITS), "".join(str(unicodedata.decimal(c)) for c in _DIGITS))
    return F.when(written.rlike(r"^[0-9.]*$"), written).otherwise(plain).try_cast("double")


def has_percent_or_times(text: str) -> Column:
    """A percentage or an ``Nx`` factor."""
    return F.col(text).rlike(PERCENT_OR_TIMES)


def has_loose_outcome(text: str, words: str | None = None, found: str | None = None) -> Column:
    """A percentage, an ``Nx`` factor, or a bare verb of improvement."""
    return any_term(v.fragments(v.OUTCOME_WORDS), text, words, found) | has_percent_or_times(text)


def has_strict_outcome(text: str) -> Column:
    """A number, or a verb of change within reach of a metric it changes."""
    return has_percent_or_times(text) | F.col(text).rlike(POINTS_OR_METRIC_CHANGE)


def strip_blanks(text: Column) -> Column:
    return F.regexp_replace(text, _BLANKS, "")


def outcomes(text: Column) -> Column:
    """All percentage outcomes as ``array<struct<verb, metric, amount, value>>``.

    ``amount`` is the number as written, ``value`` the number itself.  Verb
    forms ("improved x by 5%") come before noun forms ("x gain of 5%").

    An outcome ends at a percent sign and holds no other one.  So the text is
    cut there, and only the pieces that end like an outcome are looked into;
    searching the whole text would try the patterns at every position.
    """
    def outcome(verb, metric, amount):
        metric = F.when(metric == "", F.lit(v.UNNAMED_METRIC)).otherwise(metric)
        return F.struct(verb.alias("verb"), metric.alias("metric"), amount.alias("amount"),
                        number(amount).alias("value"))

    def verb_form(ended):
        return F.transform(F.filter(ended, lambda piece: piece.rlike(VERB_OUTCOME)), lambda piece: outcome(
            F.regexp_extract(piece, VERB_OUTCOME, 1),
            strip_blanks(F.regexp_extract(piece, VERB_OUTCOME, 2)),
            F.regexp_extract(piece, VERB_OUTCOME, 3)))

    def noun_form(ended):
        # The phrase before the noun is one run of words; what lies before it is cut off.
        phrases = F.transform(F.filter(ended, lambda piece: piece.rlike(NOUN_ENDING)),
                              lambda piece: F.regexp_replace(piece, BEFORE_NOUN_PHRASE, ""))
        return F.transform(phrases, lambda phrase: outcome(
            F.lit("reported"),
            strip_blanks(F.regexp_replace(
                strip_blanks(F.regexp_extract(phrase, NOUN_OUTCOME, 1)), LEADING_FILLERS, "")),
            F.regexp_extract(phrase, NOUN_OUTCOME, 2)))

    ended = bind(F.split(text, "%"), lambda pieces: F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1), lambda piece: F.concat(piece, F.lit("%"))))
    return bind(ended, lambda some: F.concat(verb_form(some), noun_form(some)))


def best_outcome(all_outcomes: Column) -> Column:
    """The outcome with the largest value; the first of equals."""
    return bind(all_outcomes, lambda some: F.aggregate(
        F.slice(some, 2, F.greatest(F.size(some), F.lit(1))),
        F.try_element_at(some, F.lit(1)),
        lambda best, one: F.when(one["value"] > best["value"], one).otherwise(best)))


def best_factor(text: Column) -> Column:
    """The largest ``Nx`` factor as written; the first of equals; null if none."""
    return bind(F.regexp_extract_all(text, F.lit(TIMES_OUTCOME), F.lit(1)), lambda factors: F.aggregate(
        F.slice(factors, 2, F.greatest(F.size(factors), F.lit(1))),
        F.try_element_at(factors, F.lit(1)),
        lambda best, one: F.when(number(one) > number(best), one).otherwise(best)))
