"""Term matching against a term table of any size.

``operators/terms.py`` writes its terms into the plan, which suits some hundreds.  Here the terms
are rows, and meet the texts by joins:

1. The words of all texts are counted once: the vocabulary, small beside the texts.
2. A term is keyed by one of its words, the rarest in the vocabulary; a term with a word that
   no text has is done with.  Where no word of a fragment is whole, its longest one is looked for
   inside the words of the vocabulary, by the rarest of its grams of three letters.
3. A term of several words is keyed by a seam instead: two neighbouring words with what stands between
   them.  The seams of all texts are counted like words.  Where a fragment begins or ends inside a word, seams that hold
   its own are looked for by the letters beside the gap.
4. The words and seams of the texts join the keys.  Terms that are one word, one seam or one piece of either are
   counted from that alone; of all others the whole term is looked for in the few texts that have the key.

Frequent words and seams are salted: a word of a third of all texts is dealt to many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from profilerank.functions.text import WORD_CHAR, bind
from profilerank.session import written

GRAM = 3
HOT_TEXTS = 20_000  # texts of a word that one task takes
FEW_TERMS = 256  # fragments of a table that texts are searched for without a join
_WORDS = f"{WORD_CHAR}+"
_TOKENS = rf"{WORD_CHAR}+|[^\p{{L}}\p{{N}}_\s]"  # words, and every other sign by itself
_SEAM = rf"^{WORD_CHAR}+[^\p{{L}}\p{{N}}_]"  # tells seams from words and signs


def _found(text: str | Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _seams(text: str | Column) -> Column:
    """Every two neighbouring words of a text, with what stands between them."""
    between = F.split(text, F.lit(_WORDS), -1)  # what stands before the first word is the first one
    return bind(_found(text, _WORDS), lambda words: bind(between, lambda gaps: F.transform(
        F.slice(words, 2, F.size(words)), lambda second, i: F.concat(F.get(words, i), F.get(gaps, i + 1), second))))


def _counted(items: Column) -> Column:
    """(word, times) of the distinct ones of an array."""
    def runs(x: Column) -> Column:
        places = F.transform(x, lambda item, i: F.when((i == 0) | (item != F.get(x, i - 1)), i))
        return bind(F.filter(places, lambda i: i.isNotNull()), lambda begins: F.transform(begins, lambda i, number: F.struct(
            F.get(x, i).alias("word"), (F.coalesce(F.get(begins, number + 1), F.size(x)) - i).cast("long").alias("times"))))

    return bind(F.sort_array(items), runs)


def _is_word(letter: Column) -> Column:
    return letter.rlike(f"^{WORD_CHAR}$")


def _quoted(term: str) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(F.col(term), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def bounded_pattern(term: str) -> Column:
    """The pattern of a whole-word term: a boundary lies where a word character meets another one."""
    first, last = F.substring(term, 1, 1), F.expr(f"right({term}, 1)")
    return F.concat(F.when(_is_word(first), F.lit(f"(?<!{WORD_CHAR})")).otherwise(F.lit(f"(?<={WORD_CHAR})")),
                    _quoted(term),
                    F.when(_is_word(last), F.lit(f"(?!{WORD_CHAR})")).otherwise(F.lit(f"(?={WORD_CHAR})")))


def count_inside(text: str, part: str | Column) -> Column:
    """How often a part occurs in a text, without overlaps."""
    part = F.col(part) if isinstance(part, str) else part
    return ((F.length(text) - F.length(F.replace(F.col(text), part, F.lit("")))) / F.length(part)).cast("long")


def prepared(terms: DataFrame) -> DataFrame:
    """(term, mode, pieces, plain, whole, seams, open_start, open_end) of the distinct terms of a (term, mode) table.

    Terms are in lower case; null and blank ones, and other modes than ``word`` and
    ``substring``, are left out.  ``pieces`` are the words of a term (its first sign, if it has none), ``whole`` those
    of them that a text must have as words of its own, and ``plain`` says that the term is one piece, or two and what is
    between them.  ``open_start`` and ``open_end`` say that the term may begin or end inside a word.
    """
    rows = (terms.select(F.lower("term").alias("term"), "mode")
            .filter(F.col("mode").isin("word", "substring") & (F.regexp_replace("term", r"(?U)\s", "") != "")).distinct())
    words, signs = _found("term", _WORDS), _found("term", _TOKENS)
    pieces = F.when(F.size(words) > 0, words).otherwise(F.slice(signs, 1, 1))
    rows = rows.withColumn("pieces", pieces).filter(F.size("pieces") > 0)
    n = F.size("pieces")
    open_start = (F.col("mode") == "substring") & _is_word(F.substring("term", 1, 1))
    open_end = (F.col("mode") == "substring") & _is_word(F.expr("right(term, 1)"))
    begin = F.when(open_start, 2).otherwise(1)
    inner = F.slice("pieces", begin, F.greatest(F.lit(0), n - begin + 1 - F.when(open_end, 1).otherwise(0)))
    one = (n == 1) & (F.col("pieces")[0] == F.col("term")) & ((F.col("mode") == "substring") | (F.size(words) > 0))
    seam = (F.size(words) == 2) & _is_word(F.substring("term", 1, 1)) & _is_word(F.expr("right(term, 1)"))
    return (rows.withColumn("plain", one | seam)
            .withColumn("whole", inner).withColumn("seams", _seams("term"))
            .withColumn("open_start", open_start).withColumn("open_end", open_end))


def _grams(text: str, size: Column) -> Column:
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - size + 1))
    return F.array_distinct(F.transform(places, lambda i: F.substring(F.col(text), i, size)))


def _holders(pieces: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(piece, word): the words of the vocabulary that hold each piece."""
    size = F.least(F.lit(GRAM), F.length("piece")).cast("int")
    sizes = F.explode(F.sequence(F.lit(1), F.least(F.lit(GRAM), F.length("word"))))
    grams = written(vocabulary.select("word", sizes.alias("size")).select("word", F.explode(_grams("word", F.col("size"))).alias("gram")), "grams")
    counts = grams.groupBy("gram").agg(F.count("*").alias("words"))
    keyed = (pieces.select("piece", F.explode(_grams("piece", size)).alias("gram")).join(counts, "gram")
             .groupBy("piece").agg(F.min_by("gram", F.struct("words", "gram")).alias("gram")))
    return keyed.join(grams, "gram").filter(F.contains("word", "piece")).select("piece", "word")


def _rarest(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, term, mode, plain): the rarest of ``whole`` of the terms that have some, if the vocabulary has them all."""
    return (rows.filter(F.size("whole") > 0)
            .select("term", "mode", "plain", F.size(F.array_distinct("whole")).alias("needed"), F.explode(F.array_distinct("whole")).alias("word"))
            .join(vocabulary, "word").groupBy("term", "mode", "plain", "needed")
            .agg(F.count("*").alias("there"), F.min_by("word", F.struct("texts", "word")).alias("word"))
            .filter(F.col("there") == F.col("needed")).select("word", "term", "mode", "plain"))


def _with_ends(df: DataFrame, seam: str) -> DataFrame:
    """``df`` with the lengths ``before`` and ``after`` of the words of a seam."""
    return (df.withColumn("before", F.length(F.regexp_extract(seam, f"^{_WORDS}", 0)))
            .withColumn("after", F.length(F.regexp_extract(F.reverse(F.col(seam)), f"^{_WORDS}", 0))))


def _beside(seam: str, left: str, right: str) -> Column:
    """The gap of a seam with so many letters before and after it."""
    size = F.length(seam) - F.col("before") - F.col("after") + F.col(left) + F.col(right)
    return F.substring(F.col(seam), F.col("before") - F.col(left) + 1, size)


def seam_keys(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, term, mode, plain, shared): the seams of texts under which each of the ``prepared`` terms of several words is looked for.

    ``vocabulary`` has (word, texts) of the seams.  Where no seam of a term must be whole in a text, the longer one of its
    two, or its only one, is looked for in those with the same letters beside the same gap.  ``shared`` says that a plain term
    may begin again within its own end there, which a text counts once.
    """
    n = F.size("seams")
    begin = F.when(F.col("open_start"), 2).otherwise(1)
    rows = rows.withColumn("whole", F.slice("seams", begin, F.greatest(F.lit(0), n - begin + 1 - F.when(F.col("open_end"), 1).otherwise(0))))
    second = F.coalesce(F.length(F.try_element_at("seams", F.lit(2))) > F.length(F.col("seams")[0]), F.lit(False))
    opened = (rows.filter(F.size("whole") == 0)
              .withColumn("piece", F.when(second, F.col("seams")[1]).otherwise(F.col("seams")[0]))
              .withColumn("_first", second | ~F.col("open_start")).withColumn("_last", (~second & (n > 1)) | ~F.col("open_end")))
    asked = (_with_ends(opened, "piece").withColumn("left", F.least(F.lit(GRAM), "before")).withColumn("right", F.least(F.lit(GRAM), "after"))
             .select("piece", "_first", "_last", "term", "mode", "plain", "left", "right", _beside("piece", "left", "right").alias("gram")))
    asked = written(asked, "seams")
    sizes = asked.agg(F.collect_set(F.struct("left", "right")).alias("sizes"))  # GRAM * GRAM of them at most
    known = _with_ends(vocabulary.select("word"), "word").crossJoin(F.broadcast(sizes))
    fits = F.filter("sizes", lambda x: (x["left"] <= F.col("before")) & (x["right"] <= F.col("after")))
    known = known.select("word", "before", "after", F.inline(fits)).select("word", _beside("word", "left", "right").alias("gram"))
    inside = (known.join(asked, "gram").filter(
        F.contains("word", "piece") & (~F.col("_first") | F.startswith("word", "piece")) & (~F.col("_last") | F.endswith("word", "piece")))
        .select("word", "term", "mode", "plain"))
    keys = _rarest(rows, vocabulary).unionByName(inside)
    begin, end = _found("term", _WORDS)[0], F.try_element_at(_found("term", _WORDS), F.lit(2))
    after = F.regexp_extract(F.col("word"), f"{_WORDS}$", 0)
    again = F.endswith(F.col("word"), begin) & ((F.col("mode") == "substring") | (begin == end))
    return written(keys.withColumn("shared", F.col("plain") & again & (F.length(after) < F.length(begin) + F.length(end))), "keys")


def term_keys(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, term, mode, plain): the words of texts under which each term is looked for.

    ``vocabulary`` has (word, texts).  Terms that occur in no text may have no row.
    """
    rows = written(prepared(terms), "terms")
    rarest = _rarest(rows, vocabulary)
    # a fragment of one or two pieces; where it goes on beside a piece, the word begins or ends there
    second = F.length(F.try_element_at("pieces", F.lit(2)))
    last = F.coalesce(second > F.length(F.col("pieces")[0]), F.lit(False))
    begins, ends = _is_word(F.substring("term", 1, 1)), _is_word(F.expr("right(term, 1)"))
    by_piece = rows.filter(F.size("whole") == 0).select(
        "*", F.when(last, F.col("pieces")[1]).otherwise(F.col("pieces")[0]).alias("piece"),
        (last | ~begins).alias("_first"), (~last & ((F.size("pieces") > 1) | ~ends)).alias("_last"))
    holders = _holders(by_piece.select("piece").distinct(), vocabulary)
    inside = (by_piece.join(holders, "piece")
              .filter((~F.col("_first") | F.startswith("word", "piece")) & (~F.col("_last") | F.endswith("word", "piece")))
              .select("word", "term", "mode", "plain"))
    return written(rarest.unionByName(inside), "keys")


def _lowered(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, _text, _row) of the rows with a text; equal rows have the same ``_row``."""
    base = df.select(*key, F.lower(F.col(text).cast("string")).alias("_text")).filter(F.col("_text").isNotNull())
    return base.withColumn("_row", F.xxhash64(*key, "_text"))


def _dealt(base: DataFrame) -> DataFrame:
    """``base`` written in even parts: its texts are read several times, and a file may be one task however large it is."""
    parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(base.repartition(parts), "texts")


def _met(base: DataFrame, key: list[str], terms: DataFrame) -> DataFrame:
    """(key, _row, word, _times, term, mode, plain, shared): where the word or seam that a term is keyed by occurs."""
    rows = written(prepared(terms), "terms")
    one, several = rows.filter(F.size("seams") == 0), rows.filter(F.size("seams") > 0)
    with_seams = not several.isEmpty()
    items = _found("_text", _TOKENS)
    items = F.concat(items, _seams("_text")) if with_seams else items
    seen = base.select(F.explode(F.array_distinct(items)).alias("word")).groupBy("word").agg(F.count("*").alias("texts"))
    vocabulary = written(seen.withColumn("seam", F.col("word").rlike(_SEAM)), "vocabulary")
    keys = term_keys(one.select("term", "mode"), vocabulary.filter(~F.col("seam")).drop("seam")).withColumn("shared", F.lit(False))
    if with_seams:
        keys = keys.unionByName(seam_keys(several, vocabulary.filter("seam").drop("seam")))

    # of frequent words there are fewer than tokens / HOT_TEXTS
    hot = vocabulary.filter(F.col("texts") > HOT_TEXTS).select("word", F.ceil(F.col("texts") / HOT_TEXTS).cast("int").alias("_salts"))
    tokens = (base.select(*key, "_row", F.explode(_counted(items)).alias("_item"))
              .select(*key, "_row", "_item.word", F.col("_item.times").alias("_times"))
              .join(F.broadcast(hot), "word", "left")
              .withColumn("_salt", F.pmod(F.col("_row"), F.coalesce("_salts", F.lit(1))).cast("int")))
    dealt = (keys.join(F.broadcast(hot), "word", "left")
             .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts"))
    return written(tokens.join(dealt, ["word", "_salt"]).select(*key, "_row", "word", "_times", "term", "mode", "plain", "shared"), "met")


def few_rows(table: DataFrame, columns: list[str]) -> Column | None:
    """The distinct rows of a table as an array of structs with a ``term``, blank terms aside; null if there are more than ``FEW_TERMS``."""
    named = table.filter(F.regexp_replace("term", r"(?U)\s", "") != "").select(*columns).distinct()
    rows = named.limit(FEW_TERMS + 1).collect()
    if len(rows) > FEW_TERMS:
        return None
    kind = T.ArrayType(named.schema)
    return F.array(*[F.struct(*[F.lit(r[c]).cast(named.schema[c].dataType).alias(c) for c in columns]) for r in rows]).cast(kind)


def held_fragments(df: DataFrame, key: list[str], text: str, table: DataFrame, columns: list[str]) -> DataFrame:
    """(key, _row, _text, _held): the texts, in lower case, with an array of those rows of a table whose ``term`` they hold.

    Each row of ``df`` with such a term is a row, its text once.  A table of up to ``FEW_TERMS`` rows goes to the texts; a
    larger one meets them by joins.
    """
    few = few_rows(table, columns)
    if few is None:
        base = _dealt(_lowered(df, key, text))
        terms = table.select("term", F.lit("substring").alias("mode"))
        named = (_met(base, key, terms).select("_row", "term").distinct().join(table.select(*columns).distinct(), "term")
                 .groupBy("_row").agg(F.collect_list(F.struct(*columns)).alias("_few")))
        base = base.join(named, "_row")
    else:
        base = _lowered(df, key, text).withColumn("_few", few)
    held = F.filter("_few", lambda x: F.contains("_text", x["term"]))
    return base.select(*key, "_row", "_text", held.alias("_held")).filter(F.size("_held") > 0)


def found_fragments(df: DataFrame, key: list[str], text: str, fragments: DataFrame) -> DataFrame:
    """(key, _row, _text, term): a row for each fragment of a table of any size (column ``term``) that a text holds.

    Rows of the same key and text give the same rows, each its own.
    """
    held = held_fragments(df, key, text, fragments.select(F.lower("term").alias("term")), ["term"])
    return held.select(*key, "_row", "_text", F.explode("_held.term").alias("term"))


def term_table_hits(df: DataFrame, key: list[str], text: str, terms: DataFrame) -> DataFrame:
    """One row per (key, term, mode) that occurs in the texts of the key, with its number of occurrences.

    ``terms`` has (term, mode) and any number of rows; repeated terms count once.  Texts are compared in
    lower case; ``word`` terms are whole words, or phrases that end at word boundaries, ``substring``
    terms lie anywhere.  Null texts have no hits; rows of one key are added up; null keys are a key.
    """
    base = _dealt(_lowered(df, key, text))
    met = _met(base, key, terms)
    each = F.when(F.col("mode") == "word", F.lit(1)).otherwise(count_inside("word", "term"))
    pattern = F.when(F.col("mode") == "word", bounded_pattern("term"))
    plain = met.filter("plain").select(*key, "term", "mode", (F.col("_times") * each).alias("n"))
    again = F.when(F.col("plain"), F.concat(F.lit("(?="), F.coalesce(pattern, _quoted("term")), F.lit(")")))  # every place, also within the one before
    named = (met.filter(~F.col("plain") | F.col("shared")).groupBy("_row")
             .agg(F.collect_set(F.struct("term", "mode", pattern.alias("pattern"), again.alias("again"))).alias("_terms")))
    # counted inside the array: no text is copied for a term; of plain ones it is what the seams have too many
    held = F.filter("_terms", lambda t: F.contains("_text", t["term"]))
    apart = lambda t: F.when(t["pattern"].isNotNull(), F.regexp_count("_text", t["pattern"])).otherwise(count_inside("_text", t["term"]))
    n = lambda t: apart(t) - F.when(t["again"].isNotNull(), F.regexp_count("_text", t["again"])).otherwise(0)
    rest = (base.join(named, "_row").select(*key, F.explode(F.transform(held, lambda t: F.struct(
        t["term"].alias("term"), t["mode"].alias("mode"), n(t).cast("long").alias("n")))).alias("_one")).select(*key, "_one.*"))
    return (plain.unionByName(rest).groupBy(*key, "term", "mode").agg(F.sum("n").alias("n")).filter(F.col("n") > 0))
