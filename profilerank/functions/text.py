"""Term tests on text columns.

A text is looked at in two forms: the lower-case text itself for terms that
may occur anywhere, and ``words``, the array of those of its words that are
in the vocabulary at all, in order and with repeats.  The array is made once
per source text with a single regular expression and is short, so that every
whole-word test afterwards is a set operation on a few strings; the words of
a joined text are the joined arrays.

Terms are literals of the plan.  The tests are built as SQL text (``*_sql``)
because most of them sit inside lambdas over jobs or skills; the functions
without the suffix wrap the same text as a column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from profilerank.vocabulary import TermList

# What counts as part of a word (letters and digits of any script; those of ASCII
# are named as well because they are tested first, and faster)
WORD_CHAR = r"[A-Za-z0-9_\p{L}\p{N}]"


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def list_sql(values) -> str:
    """Array literal; folded into one constant by the optimizer."""
    return f"array({', '.join(map(quoted, values))})"


def words_sql(raw: str, keep) -> str:
    """The words of a text that are among ``keep``, with repeats."""
    known = ", ".join(map(quoted, sorted(keep)))
    if not known:
        return "cast(array() as array<string>)"
    return f"filter(regexp_extract_all({raw}, {quoted(WORD_CHAR + '+')}, 0), w -> w in ({known}))"


def literal_pattern(term: str) -> str:
    """Pattern for a whole-word term with other characters in it.

    A boundary lies between a word character and a non-word character, so at
    an edge such as the ``@`` of ``precision@`` a word character must follow.
    """
    def is_word(ch: str) -> bool:
        return ch.isalnum() or ch == "_"

    before = "(?<!%s)" if is_word(term[0]) else "(?<=%s)"
    after = "(?!%s)" if is_word(term[-1]) else "(?=%s)"
    return before % WORD_CHAR + r"\Q" + term + r"\E" + after % WORD_CHAR


def _bounded_sql(term: str, raw: str) -> str:
    return f"(contains({raw}, {quoted(term)}) and {raw} rlike {quoted(literal_pattern(term))})"


def _words_for(terms: TermList, raw: str, words: str | None) -> str | None:
    """The word array that a list needs; made on the spot where the caller has none."""
    return words_sql(raw, terms.words) if words is None and terms.words else words


def any_sql(terms: TermList, raw: str, words: str | None = None, found: str | None = None) -> str:
    """True if at least one term occurs; ``found`` may hold the fragments that occur."""
    words = _words_for(terms, raw, words)
    tests = []
    if terms.words:
        tests.append(f"arrays_overlap({words}, {list_sql(terms.words)})")
    if terms.fragments:
        tests.append(f"arrays_overlap({found}, {list_sql(terms.fragments)})" if found else
                     f"exists({list_sql(terms.fragments)}, t -> contains({raw}, t))")
    tests += [_bounded_sql(t, raw) for t in terms.bounded]
    return f"({' or '.join(tests)})" if tests else "false"


def count_sql(terms: TermList, raw: str, words: str | None = None, found: str | None = None) -> str:
    """How many distinct terms occur; each counts once."""
    words = _words_for(terms, raw, words)
    parts = []
    if terms.fragments:
        parts.append(f"size(array_intersect({found}, {list_sql(terms.fragments)}))" if found else
                     f"size(filter({list_sql(terms.fragments)}, t -> contains({raw}, t)))")
    if terms.words:
        parts.append(f"size(array_intersect({words}, {list_sql(terms.words)}))")
    parts += [f"cast({_bounded_sql(t, raw)} as int)" for t in terms.bounded]
    return f"({' + '.join(parts)})" if parts else "0"


def count_other_sql(terms: TermList, raw: str, words: str, other_raw: str, other_words: str,
                    found: str | None = None, other_found: str | None = None) -> str:
    """Distinct terms that occur in the first text but not in the second."""
    parts = []
    if terms.fragments:
        parts.append(f"size(array_except(array_intersect({found}, {list_sql(terms.fragments)}), {other_found}))" if found else
                     f"size(filter({list_sql(terms.fragments)}, t -> contains({raw}, t) and not contains({other_raw}, t)))")
    if terms.words:
        parts.append(f"size(array_except(array_intersect({words}, {list_sql(terms.words)}), {other_words}))")
    parts += [f"cast({_bounded_sql(t, raw)} and not {_bounded_sql(t, other_raw)} as int)" for t in terms.bounded]
    return f"({' + '.join(parts)})" if parts else "0"


def occurrences_sql(terms: TermList, raw: str, words: str) -> str:
    """How often the terms occur in total."""
    parts = [
        f"cast((length({raw}) - length(replace({raw}, {quoted(t)}, ''))) / {len(t)} as int)"
        for t in terms.fragments
    ]
    if terms.words:
        parts.append(f"size(filter({words}, w -> w in ({', '.join(map(quoted, terms.words))})))")
    parts += [
        f"if(contains({raw}, {quoted(t)}), regexp_count({raw}, {quoted(literal_pattern(t))}), 0)"
        for t in terms.bounded
    ]
    return f"({' + '.join(parts)})" if parts else "0"


def hits_sql(terms: TermList, raw: str, words: str) -> str:
    """Array of (term, mode, n) of the terms that occur."""
    hits = []
    if terms.fragments:
        hits.append(
            f"transform(filter({list_sql(terms.fragments)}, t -> contains({raw}, t)), "
            "t -> named_struct('term', t, 'mode', 'substring', 'n', "
            f"cast((length({raw}) - length(replace({raw}, t, ''))) / length(t) as bigint)))")
    if terms.words:
        hits.append(
            f"transform(array_intersect({words}, {list_sql(terms.words)}), "
            "t -> named_struct('term', t, 'mode', 'word', 'n', "
            f"cast(size(filter({words}, w -> w = t)) as bigint)))")
    hits += [
        f"filter(array(named_struct('term', {quoted(t)}, 'mode', 'word', 'n', cast(if(contains({raw}, {quoted(t)}), "
        f"regexp_count({raw}, {quoted(literal_pattern(t))}), 0) as bigint))), h -> h.n > 0)"
        for t in terms.bounded
    ]
    return f"concat({', '.join(hits)})"


def once(raw: str, test: str, name: str = "x") -> Column:
    """``test``, written over ``name``, with the text bound to that name.

    A column that is used only once is merged into its user by the optimizer.
    Inside a lambda over a term list that would assemble the text again for
    every term; bound to a lambda variable it is assembled once.
    """
    return F.expr(f"transform(array({raw}), {name} -> {test})[0]")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used there."""
    return F.transform(F.array(value), use)[0]


def any_term(terms: TermList, raw: str, words: str | None = None, found: str | None = None) -> Column:
    if found and not terms.bounded:  # the text itself is not looked at
        return F.expr(any_sql(terms, raw, words, found))
    return once(raw, any_sql(terms, "x", words, found))


def count_terms(terms: TermList, raw: str, words: str | None = None, found: str | None = None) -> Column:
    if found and not terms.bounded:
        return F.expr(count_sql(terms, raw, words, found))
    return once(raw, count_sql(terms, "x", words, found))


def count_other_terms(terms: TermList, raw: str, words: str, other_raw: str, other_words: str,
                      found: str | None = None, other_found: str | None = None) -> Column:
    return once(f"named_struct('a', {raw}, 'b', {other_raw})",
                count_other_sql(terms, "x.a", words, "x.b", other_words, found, other_found))


def count_occurrences(terms: TermList, raw: str, words: str) -> Column:
    return once(raw, occurrences_sql(terms, "x", words))
