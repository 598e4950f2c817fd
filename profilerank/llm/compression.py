"""Classifiers that compare compressed lengths under zstandard dictionaries."""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame, functions as F

from profilerank.llm.common import LETTER, in_slices, stored, text_bytes
from profilerank.llm.hashing import RangeHashes, gram_hashes

HELD_OUT_REMAINDER = 2
SAMPLE_PER_CLASS = {"lang": 512, "label": 512}  # bounds of the fits; every row is scored
SAMPLE_TOTAL = {"lang": 16_384, "label": 4096}  # with many classes each has a smaller share
SAMPLE_CHARS = 20_000  # longer texts serve no fit


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from learning; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == HELD_OUT_REMAINDER, F.lit(False))


def bounded_sample(classes: DataFrame, docs: DataFrame, per_class: int, total: int) -> list[tuple]:
    """(class, text) of at most ``per_class`` documents of each class and ``total`` of all, spread by a hash of the id.

    ``classes`` has (id, class), ``docs`` (id, text).  The smallest hash of each of so many
    ranges is picked, so counts combine before the shuffle, the result has a
    fixed bound, and no text is shuffled but those picked.  Of more classes than ``total`` the largest are learned.
    """
    hashed = F.xxhash64("id")
    fit = docs.filter(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS)).select("id")
    usable = classes.filter(F.col("class").isNotNull() & F.col("id").isNotNull()).join(fit, "id")
    largest = stored(usable.groupBy("class").count().orderBy(F.desc("count"), "class").limit(total), "classes")
    each = max(1, min(per_class, total // max(1, largest.count())))
    picked = (usable.join(F.broadcast(largest.select("class")), "class")  # ``total`` rows at most
              .groupBy("class", F.pmod(hashed, F.lit(each)).alias("range"))
              .agg(F.min(F.struct(hashed.alias("h"), "id")).alias("best"))
              .select("class", F.col("best.id").alias("id")))
    picked = stored(picked, "sample")
    texts = docs.filter(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    found = texts.join(F.broadcast(picked), "id").select("class", "id", "text").dropDuplicates(["class", "id"]).collect()
    return [(r[0], r[2]) for r in sorted(found, key=lambda r: (str(r[0]), r[1]))]


def raw_compressor(content: bytes, level: int):
    """A function from bytes to their length under a raw-content dictionary."""
    options = dict(level=level, write_content_size=False, write_checksum=False, write_dict_id=False)
    if not content:
        return zstd.ZstdCompressor(**options).compress
    table = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    table.precompute_compress(level=level)
    return zstd.ZstdCompressor(dict_data=table, **options).compress


def pieces(data: bytes, size: int, step: int) -> Iterator[bytes]:
    """Windows that cover the whole text; a short text is one window."""
    for at in range(0, max(1, len(data) - size + step), step):
        yield data[at:at + size]


# Language ----------------------------------------------------------------------------------

LANGUAGE_LEVEL, LANGUAGE_WINDOW, LANGUAGE_CONTENT = 9, 768, 1 << 16
UNDETERMINED = "und"


class LanguageModel:
    """One raw-content dictionary for each language; the smallest total length wins."""

    def __init__(self, contents: dict[str, bytes]):
        self.contents = contents
        self._compressors = None

    @classmethod
    def fit(cls, sample: list[tuple[str, str]]) -> LanguageModel:
        """Even shares of every sampled text, shuffled, up to 64 KB of each language."""
        texts: dict[str, list[bytes]] = {}
        for lang, text in sample:
            texts.setdefault(lang, []).append(text_bytes(text))
        contents = {}
        for lang, some in sorted(texts.items()):
            chosen, order = random.Random(7), []
            for data in some:
                at = chosen.randrange(max(1, len(data) - 256))
                order.append(data[at:at + 256])
            chosen.shuffle(order)
            contents[lang] = b" ".join(order)[:LANGUAGE_CONTENT]
        return cls(contents)

    def __getstate__(self):
        return {"contents": self.contents, "_compressors": None}

    def lengths(self, data: bytes) -> dict[str, int]:
        if self._compressors is None:
            self._compressors = {k: raw_compressor(v, LANGUAGE_LEVEL) for k, v in self.contents.items()}
        parts = list(pieces(data, LANGUAGE_WINDOW, LANGUAGE_WINDOW))
        return {k: sum(len(f(p)) for p in parts) for k, f in self._compressors.items()}

    def predict(self, text: str | None, min_margin: float = 0.0) -> tuple[str, float]:
        """(language, score): the score is 1/2 at a tie and grows with the margin in bytes."""
        if text is None or not self.contents or not LETTER.search(text):
            return UNDETERMINED, 0.0
        ranked = sorted((n, lang) for lang, n in self.lengths(text_bytes(text)).items())
        if len(ranked) == 1:
            return ranked[0][1], 1.0
        best, second = ranked[0][0], ranked[1][0]
        score = 1.0 / (1.0 + 2.0 ** -min(50.0, second - best))
        margin = (second - best) / second
        return (ranked[0][1] if margin >= min_margin else UNDETERMINED), score


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  lang_col: str = "lang") -> LanguageModel:
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    classes = docs.filter(~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(lang_col).alias("class"))
    return LanguageModel.fit(bounded_sample(classes, texts, SAMPLE_PER_CLASS["lang"], SAMPLE_TOTAL["lang"]))


def language_ids(docs: DataFrame, model: LanguageModel, min_margin: float = 0.0,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score.

    A prediction sees the text alone.  It is ``und``, with score 0, for null texts and
    texts without a letter, and where nothing was learned; and ``und`` where the best two
    lengths differ by a share under ``min_margin``.  Equal lengths: the first name.
    Whole texts are compressed, window by window.  Null and repeated ids are carried along.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py(), min_margin) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()),
                 pa.array([x[1] for x in found], pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"),
                       F.col(text_col).cast("string").alias("text"))
    return (rows.mapInArrow(run, "id long, held_out boolean, lang_pred string, score double")
            .withColumnRenamed("id", id_col))


# Toxicity ----------------------------------------------------------------------------------

TOXIC_LEVEL, TOXIC_WINDOW, TOXIC_CONTENT = 9, 64, 1 << 16
GRAMS, GRAM_Z, GRAM_RATIO, GRAM_SHARE = (5, 8, 11), 5.0, 4, 0.04
GRAM_LEAST, WORD_RATIO = 3, 8
FEW_TOXIC = 30
TOXIC_THRESHOLD = 0.3
_SIGNS = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c.,;:!?\"'()", np.uint8))
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def keyed(data: bytes) -> bytes:
    """Lower-case words, each letter changed by a hash of the letters before it in its word.

    Two words then have as many bytes in common as letters of their beginning, and none
    elsewhere.  A compressor finds a stem where it begins a word, and not where the same
    letters stand inside others.
    """
    letters = _LOWER[np.frombuffer(data, np.uint8)]
    if not len(letters):
        return b""
    sign = _SIGNS[letters]
    kept = ~(sign & np.r_[False, sign[:-1]])  # of neighbouring signs the first
    letters, sign = letters[kept], sign[kept]
    place = np.arange(len(letters))
    begin = np.maximum.accumulate(np.where(np.r_[True, sign[:-1]], place, 0))
    before = RangeHashes(letters).of(begin, place).view(np.uint64)
    return np.where(sign, np.uint8(32), letters ^ (before >> np.uint64(56)).astype(np.uint8)).tobytes()


def _words(data: bytes) -> list[bytes]:
    return [w for w in (x.strip(b".,;:!?\"'()") for x in data.lower().split()) if w]


def _folded(data: bytes) -> bytes:
    return b" " + b" ".join(data.lower().split()) + b" "


def _grams(data: bytes, size: int) -> np.ndarray:
    """Hashes of the grams at every place."""
    starts = np.arange(max(0, len(data) - size + 1))
    return RangeHashes(data).of(starts, starts + size)


def _shares(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, sorted, and the number of texts that hold each."""
    found = [np.unique(_grams(_folded(t), size)) for t in texts]
    return np.unique(np.concatenate(found), return_counts=True)


def _marks(toxic: list[bytes], ordinary: list[bytes], size: int) -> np.ndarray:
    """Grams of a larger share of toxic documents than of ordinary ones, sorted."""
    grams, a = _shares(toxic, size)
    others, counts = _shares(ordinary, size)
    at = np.minimum(np.searchsorted(others, grams), len(others) - 1) if len(others) else np.zeros(len(grams), np.int64)
    b = np.where(others[at] == grams, counts[at], 0) if len(others) else np.zeros(len(grams), np.int64)
    n, m = len(toxic), len(ordinary)
    share = (a + b) / (n + m)
    z = (a / n - b / m) / np.sqrt(share * (1 - share) * (1 / n + 1 / m) + 1e-9)
    return grams[(a >= max(GRAM_LEAST, GRAM_SHARE * n)) & (a * m >= GRAM_RATIO * b * n) & (z >= GRAM_Z)]


def marked_words(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Words that set toxic text apart, the most frequent ones first.

    Byte grams are tested for a larger share of toxic documents than of ordinary ones (a
    z value of at least GRAM_Z, and a share that counts), as toxic stems take many endings; of the
    words that hold such a gram those stay that are rare in ordinary documents.
    """
    in_toxic, in_ordinary = (Counter(w for d in side for w in set(_words(d))) for side in (toxic, ordinary))
    words = sorted(in_toxic)
    joined = b" " + b" ".join(words) + b" "
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    begins = np.cumsum(sizes + 1) - sizes - 1  # of the blank before each word
    marked = np.zeros(len(words), bool)
    for size in GRAMS:
        hits = np.flatnonzero(np.isin(_grams(joined, size), _marks(toxic, ordinary, size)))
        of = np.searchsorted(begins, hits, "right") - 1
        inside = hits + size <= begins[of] + sizes[of] + 2
        marked[of[inside]] = True
    n, m = len(toxic), len(ordinary)
    found = [w for w, is_marked in zip(words, marked.tolist()) if is_marked and in_toxic[w] * m >= WORD_RATIO * in_ordinary[w] * n]
    return sorted(found, key=lambda w: (-in_toxic[w], w))


def _groups(words: list[bytes], size: int = 10) -> Iterator[list[bytes]]:
    for at in range(0, len(words), size):
        yield words[at:at + size]


def _parts(words: list[bytes], size: int) -> Iterator[bytes]:
    """The words, keyed, in pieces of at most ``size`` bytes (or one word)."""
    held: list[bytes] = []
    for word in words:
        if held and sum(map(len, held)) + len(held) + len(word) + 2 > size:
            yield keyed(b" " + b" ".join(held) + b" ")
            held = []
        held.append(word)
    if held:
        yield keyed(b" " + b" ".join(held) + b" ")


def unlike(texts: list[bytes], sketch: int = 64, most: float = 0.3) -> list[bytes]:
    """The texts without near copies of earlier ones: a copied document would mark all of its words."""
    seen: set[int] = set()
    kept = []
    for data in texts:
        words = data.split()
        least = np.unique(gram_hashes(words, 3) if len(words) > 3 else gram_hashes([data], 1))[:sketch].tolist()
        if sum(h in seen for h in least) <= most * len(least):
            kept.append(data)
            seen.update(least)
    return kept


class ToxicityModel:
    """Dictionaries of equal length, and a logistic curve over window differences.

    The ordinary dictionary is ordinary text.  A toxic one begins with pieces of toxic text, its marked words,
    and goes on with the same ordinary text at the same place: a window without toxic
    content has the same length under both, so the difference is the toxic part alone.  More
    marked words than half a dictionary holds make several toxic ones; the shortest length counts.
    Texts and dictionaries are keyed, see ``keyed``.
    """

    def __init__(self, toxic: list[bytes] | None = None, ordinary: bytes = b"", weights: list[float] | None = None):
        self.toxic, self.ordinary, self.weights = toxic or [], ordinary, weights
        self._compressors = None

    def __getstate__(self):
        return self.__dict__ | {"_compressors": None}

    def features(self, data: bytes) -> list[float]:
        """Largest, mean of the three largest and mean of the lengths saved, share of windows that save."""
        data = keyed(data)
        if not data or not self.toxic:
            return [0.0, 0.0, 0.0, 0.0]
        if self._compressors is None:
            self._compressors = [raw_compressor(content, TOXIC_LEVEL) for content in (self.ordinary, *self.toxic)]
        plain, *toxic = self._compressors
        saved = np.array([len(plain(w)) - min(len(f(w)) for f in toxic) for w in pieces(data, TOXIC_WINDOW, TOXIC_WINDOW // 2)])
        top = np.sort(saved)[-3:]
        return [float(top[-1]), float(top.mean()), float(saved.mean()), float((saved >= 3).mean())]

    def score(self, text: str | None) -> float:
        if not self.weights:
            return 0.0
        x = np.array([1.0, *self.features(text_bytes(text))])
        return float(1.0 / (1.0 + np.exp(-np.clip(x @ np.array(self.weights), -50, 50))))

    @classmethod
    def fit(cls, sample: list[tuple[tuple[int, str], str]], sizes: dict[tuple[int, str], int]) -> ToxicityModel:
        """Dictionaries from three documents in four, the curve from the rest.

        A sampled document has the class (label, language), and ``sizes`` says how many documents a class has.
        Words are marked in each language by itself, so that a rare one has its share; where one has too few
        toxic documents for a test, in all together as well.
        """
        classes: dict[tuple[int, str], list[bytes]] = {}
        for key, text in sample:
            classes.setdefault(key, []).append(text_bytes(text))
        classes = {key: unlike(texts) for key, texts in classes.items()}
        if not all(sum(len(x) for (label, _), x in classes.items() if label == k) >= 2 for k in (0, 1)):
            return cls()
        shown = {key: [d for i, d in enumerate(x) if i % 4 != 1] for key, x in classes.items()}
        languages = sorted({language for _, language in classes})
        sides = [tuple(shown.get((label, language), []) for label in (1, 0)) for language in languages]
        if len(languages) > 1 and any(len(toxic) < FEW_TOXIC for toxic, _ in sides):
            sides.append(tuple([d for side in sides for d in side[k]] for k in (0, 1)))
        words = list(dict.fromkeys(w for toxic, plain in sides if toxic and plain for w in marked_words(toxic, plain)))
        marked = set(words)
        cuts = [keyed(b" ".join(some)) for language in languages for d in shown.get((0, language), [])
                for some in _groups(_words(d)) if marked.isdisjoint(some)]
        random.Random(7).shuffle(cuts)
        ordinary = b" ".join(cuts)[:TOXIC_CONTENT]
        model = cls([head + ordinary[len(head):] for head in _parts(words, TOXIC_CONTENT // 2)], ordinary)
        rest = [(key, d) for key in sorted(classes) for d in classes[key][1::4]]
        if not rest or len({key[0] for key, _ in rest}) < 2:
            return cls()
        x = np.array([[1.0, *model.features(d)] for _, d in rest])
        y = np.array([float(key[0]) for key, _ in rest])
        drawn = Counter(key for key, _ in rest)
        model.weights = _logistic(x, y, np.array([sizes[key] / drawn[key] for key, _ in rest]))
        return model


def _logistic(x: np.ndarray, y: np.ndarray, importance: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Weighted logistic regression by Newton steps on standardised columns, with a ridge."""
    centre, spread = x.mean(0), x.std(0) + 1e-9
    centre[0], spread[0] = 0.0, 1.0
    z, w = (x - centre) / spread, np.zeros(x.shape[1])
    importance = importance / importance.sum() * len(y)
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (importance * (p - y)) + penalty @ w
        hessian = (z * (importance * p * (1 - p))[:, None]).T @ z + penalty
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    w = w / spread
    w[0] -= float((w[1:] * centre[1:]).sum())
    return w.tolist()


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "toxic", lang_col: str = "lang") -> ToxicityModel:
    """Learns from labelled rows that are not held out; a bounded sample of each label and language.

    The language, if ``docs`` has it, only steers which documents are learned from; scores see the text alone.
    """
    known = (labels.filter(~held_out(id_col) & F.col(label_col).isin(0, 1))
             .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label")))
    language = F.coalesce(F.col(lang_col).cast("string"), F.lit("")) if lang_col in docs.columns else F.lit("")
    spoken = docs.select(F.col(id_col).alias("id"), language.alias("language"))
    classes = known.join(spoken.groupBy("id").agg(F.min("language").alias("language")), "id").select(
        "id", F.struct("label", "language").alias("class"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    drawn = [((c.label, c.language), t) for c, t in
             bounded_sample(classes, texts, SAMPLE_PER_CLASS["label"], SAMPLE_TOTAL["label"])]
    asked = classes.groupBy("class").count().orderBy(F.desc("count"), "class").limit(SAMPLE_TOTAL["label"])
    return ToxicityModel.fit(drawn, {(r[0].label, r[0].language): r[1] for r in asked.collect()})


def toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = TOXIC_THRESHOLD,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted (score >= threshold).

    A score sees the text alone, the whole of it.  Null and empty texts get the score of a
    text without toxic windows; without a fitted model every score is 0.  Null and
    repeated ids are carried along; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([model.score(t.as_py()) for t in batch.column(2)], np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores),
                 pa.array((scores >= threshold).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"),
                       F.col(text_col).cast("string").alias("text"))
    return (rows.mapInArrow(run, "id long, held_out boolean, score double, predicted int")
            .withColumnRenamed("id", id_col))


def not_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = TOXIC_THRESHOLD,
              text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, whose score is under the threshold.

    Null and empty texts are scored as by ``toxicity``.
    """
    names = docs.columns
    numbered = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(t.as_py()) < threshold for t in batch.column(at)], pa.bool_()))

    return numbered.mapInArrow(in_slices(run), numbered.schema).toDF(*names)
