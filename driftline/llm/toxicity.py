"""Toxicity: a weighted lexicon learned from labels, matched by Aho-Corasick in folded text."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spread import durable, tasks

#: Labelled texts that a model is fitted on, at most, of each class. They are distinct texts, picked by a hash.
TOXIC_SAMPLE, CLEAN_SAMPLE = 4000, 12000
#: Letters of a stem: a beginning of a word, or a whole word of any length.
SHORTEST, LONGEST = 3, 14
#: Toxic texts that must hold a stem.
SUPPORT = 4
#: How many times as often as in clean texts a stem must be, for each word, as a logarithm.
LEAST_WEIGHT = 2.5
#: Added to a text's words, and to its weight for each word.
FEW_WORDS, FLOOR = 10, 0.002
#: Powers of the length that may divide the weight; the fit takes the likeliest.
POWERS = (1.0, 0.75, 0.5, 0.25)

# Characters that look like Latin letters, and digits and signs that stand for letters.
HOMOGLYPHS = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n", "α": "a", "ο": "o", "ν": "v", "ρ": "p", "τ": "t", "ι": "i", "κ": "k", "υ": "u", "χ": "x"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
SIGNS = {"@": "a", "$": "s"}

_LETTERS, _DIGITS = str.maketrans(HOMOGLYPHS), str.maketrans(DIGITS)
_SIGN = re.compile(r"(?<=\w)[@$](?=\w)")
_GAP = re.compile(r"[\W_]+")
_WITH_DIGIT = re.compile(r"[^\W_]*\d[^\W_]*")
_MARKS = re.compile("[\u0300-\u036f]+")
_ASIDE = re.compile("[­​-‍⁠﻿]")


def fold(text: str | None) -> str:
    """Lower-case words between single spaces, a space at both ends, lookalikes and substitutions undone.

    Letters lose their accents and widths. Digits stand for letters only in words that have letters, so numbers stay.
    """
    text = (text or "").lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", _ASIDE.sub("", text))).translate(_LETTERS)
    if "@" in text or "$" in text:
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    text = _WITH_DIGIT.sub(lambda m: m[0] if m[0].isdigit() else m[0].translate(_DIGITS), text)
    return f" {_GAP.sub(' ', text).strip()} "


@dataclass
class ToxicityModel:
    """Weights of word stems, phrases that do not count, and the line that turns weight for length into a probability."""

    stems: dict[str, float]
    exceptions: frozenset[str]
    slope: float = 1.0
    offset: float = -5.0
    power: float = 1.0

    def __post_init__(self) -> None:
        self.automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"automaton": None}

    def weight(self, text: str) -> float:
        """The summed weight of the stems in a folded text; of stems that begin one word the heaviest counts."""
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for stem, weight in self.stems.items():
                self.automaton.add_word(f" {stem}", (len(stem) + 1, weight))
            for phrase in self.exceptions:
                self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, None))
            self.automaton.make_automaton()
        if not len(self.automaton):
            return 0.0
        found, spared = {}, []
        for end, (length, weight) in self.automaton.iter(text):
            start = end - length + 1
            if weight is None:
                spared.append((start, end))
            elif weight > found.get(start, 0.0):
                found[start] = weight
        if not found:
            return 0.0
        for i, j in spared:
            for start in [x for x in found if i <= x < j]:
                del found[start]
        return sum(found.values())

    def score(self, text: str | None) -> float:
        text = fold(text)
        x = self.slope * _feature(self.weight(text), text.count(" "), self.power) + self.offset
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def _feature(weight: float, words: int, power: float) -> float:
    """The weight over a power of the text's length, as a logarithm."""
    return math.log(FLOOR + weight / (words + FEW_WORDS) ** power)


def stems_in(word: str) -> list[str]:
    """The beginnings of a word that may be stems, and the word itself."""
    out = [word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1)]
    return out + [word] if len(word) > LONGEST else out


def _train_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct labelled texts outside the held-out fifth, a bounded number of each class."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull() & (held_out(id_col) == F.lit(False))).groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    # ids are picked first, so that few texts move; twice as many as needed, since some texts are repeated
    picked = None
    for label, most in ((1, TOXIC_SAMPLE), (0, CLEAN_SAMPLE)):
        own = known.where(F.col("toxic") == label).orderBy(F.xxhash64(id_col), id_col).limit(2 * most)
        picked = own if picked is None else picked.unionByName(own)
    texts = docs.select(id_col, text_col).join(F.broadcast(picked), id_col).withColumn("_hash", F.xxhash64(text_col))
    return texts.groupBy("_hash", "toxic").agg(F.first(text_col).alias(text_col)).select("toxic", F.col(text_col).alias("text"))


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """A model from labelled texts whose crc32 of the id, modulo 5, is not 0.

    It reads at most twice ``TOXIC_SAMPLE`` toxic and ``CLEAN_SAMPLE`` clean labelled rows, and so has one
    cost at every size. Stems are counted by Spark; the driver gets the counts of those that ``SUPPORT`` toxic texts of
    the sample hold and, for these texts, the chosen stems in each. With no toxic label every score is low; so is
    it with an empty table. Repeated texts count once.
    """
    rows = durable(_train_rows(docs, labels, id_col, text_col).repartition(tasks(docs, TOXIC_SAMPLE + CLEAN_SAMPLE, 500)))
    toxic, clean = (rows.where(F.col("toxic") == x).select("text") for x in (1, 0))
    counts = "stem string, texts long, uses long"
    toxic_words, clean_words = (x.select(F.coalesce(F.sum(F.size(F.split(F.col("text"), r"\s+"))), F.lit(0))).first()[0] + 1 for x in (toxic, clean))
    totals = [F.sum("texts").alias("texts"), F.sum("uses").alias("uses")]
    common = toxic.mapInArrow(_count_stems, counts).groupBy("stem").agg(*totals).where(F.col("texts") >= SUPPORT)
    support = {r.stem: (r.texts, r.uses) for r in common.collect()}
    context = toxic.sparkSession.sparkContext
    wanted = context.broadcast(frozenset(support))
    against = {r.stem: r.uses for r in clean.mapInArrow(lambda it: _count_uses(it, wanted.value), "stem string, uses long").groupBy("stem").agg(F.sum("uses").alias("uses")).collect()}
    weights = {s: math.log((uses + 0.5) / toxic_words) - math.log((against.get(s, 0) + 0.5) / clean_words) for s, (_, uses) in support.items()}
    strong = frozenset(s for s, w in weights.items() if w >= LEAST_WEIGHT)
    spread = context.broadcast(strong)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted({s for w in set(fold(x).split()) for s in stems_in(w) if s in spread.value}) for x in batch.column(0).to_pylist()], pa.list_(pa.string()))], names=["stems"])

    held = [r.stems for r in toxic.mapInArrow(kept, "stems array<string>").collect()]
    stems = {s: weights[s] for s in _choose(held, weights)}
    # phrases of a stem's word and its neighbour that only clean texts hold
    model = ToxicityModel(stems, frozenset(_phrases(rows, stems)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folded = [fold(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.weight(x) for x in folded], pa.float64()), pa.array([x.count(" ") for x in folded], pa.int64())], names=["toxic", "w", "words"])

    pairs = rows.select("toxic", "text").mapInArrow(weigh, "toxic int, w double, words long").collect()
    pairs.sort()  # a bounded sample; a fixed order gives one model
    y = np.array([r.toxic for r in pairs])
    fits = [(*_logistic(np.array([_feature(r.w, r.words, power) for r in pairs]), y), power) for power in POWERS]
    model.slope, model.offset, _, model.power = min(fits, key=lambda f: f[2])
    return model


def _count_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts each stem begins a word, and how many words it begins."""
    texts: Counter[str] = Counter()
    uses: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            words = Counter(fold(text).split())
            for word, n in words.items():
                for stem in stems_in(word):
                    uses[stem] += n
            texts.update({stem for word in words for stem in stems_in(word)})
            if len(texts) > 1_000_000:
                yield _counted(texts, uses)
                texts.clear()
                uses.clear()
    yield _counted(texts, uses)


def _counted(texts: Counter[str], uses: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(texts), pa.string()), pa.array(list(texts.values()), pa.int64()), pa.array([uses[s] for s in texts], pa.int64())], names=["stem", "texts", "uses"])


def _count_uses(batches: Iterator[pa.RecordBatch], wanted: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """How many words each wanted stem begins; stems are cut from each distinct word once."""
    for batch in batches:
        words: Counter[str] = Counter()
        for text in batch.column(0).to_pylist():
            words.update(fold(text).split())
        uses: Counter[str] = Counter()
        for word, n in words.items():
            for stem in stems_in(word):
                if stem in wanted:
                    uses[stem] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(uses), pa.string()), pa.array(list(uses.values()), pa.int64())], names=["stem", "uses"])


def _choose(held: list[list[str]], weights: dict[str, float]) -> list[str]:
    """Stems that explain toxic texts: again and again the heaviest in most texts not yet explained, then other frequent ones.

    Of stems that do equally well the longest is taken, since it says most.
    """
    by = defaultdict(set)
    for i, stems in enumerate(held):
        for s in stems:
            by[s].add(i)
    open_, chosen = set(range(len(held))), []
    left = {s: len(x) for s, x in by.items()}
    while left:
        stem = max(left, key=lambda s: (round(left[s] * weights[s], 6), len(s), s))
        if left[stem] < SUPPORT:
            left.pop(stem)
            continue
        chosen.append(stem)
        gone = by[stem] & open_
        open_ -= gone
        for i in gone:
            for s in held[i]:
                left[s] = left.get(s, 0) - 1
        left = {s: n for s, n in left.items() if n > 0}
    many = max(20, 0.03 * len(held))
    frequent = sorted((s for s in by if len(by[s]) >= many), key=lambda s: (-round(len(by[s]) * weights[s], 6), -len(s), s))
    for s in frequent:
        if not any(s.startswith(c) or c.startswith(s) for c in chosen):
            chosen.append(s)
    return chosen


def _phrases(rows: DataFrame, stems: dict[str, float]) -> list[str]:
    """Two-word phrases around a matched word that at least three clean texts and no toxic text hold."""
    model = ToxicityModel(stems, frozenset())

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = tuple(stems)
        for batch in batches:
            toxic, out = [], []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folded = fold(text)
                if not model.weight(folded):
                    continue
                words = folded.split()
                near = {f"{words[i + d]} {words[i + d + 1]}" for i, w in enumerate(words) if w.startswith(starts) for d in (-1, 0) if 0 <= i + d < len(words) - 1}
                out += near
                toxic += [label] * len(near)
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(out, pa.string())], names=["toxic", "phrase"])

    counts = rows.select("toxic", "text").mapInArrow(around, "toxic int, phrase string").groupBy("phrase").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    return [r.phrase for r in counts.where("bad = 0 and good >= 3").collect()]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Slope, offset and loss of a logistic fit to ``x`` by Newton steps, with a weak pull to a slope of 4 that is even half-way between the classes' typical values."""
    hits = x[(y == 1) & (x > math.log(FLOOR))] if len(x) else x
    if not len(hits):
        return 1.0, -5.0, 0.0
    a = 4.0
    b = -a * (np.percentile(hits, 10) + math.log(FLOOR)) / 2
    start = np.array([a, b])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -500, 500)))
        r, v = p - y, p * (1 - p)
        grad = np.array([(r * x).sum(), r.sum()]) + 0.1 * (np.array([a, b]) - start)
        hess = np.array([[(v * x * x).sum(), (v * x).sum()], [(v * x).sum(), v.sum()]]) + 0.1 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    if a <= 0:
        a, b = start
    z = np.where(y == 1, 1, -1) * (a * x + b)
    return float(a), float(b), float(np.logaddexp(0, -z).sum())


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) per row.

    Empty and null texts get the score of a text without matches. Repeated rows and ids stay repeated and get one
    score, a row without an id is not held out, and an empty table gives an empty result.
    """
    spread = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [spread.value.score(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=[id_col, "score"])

    scored = docs.select(id_col, text_col).mapInArrow(run, schema)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under 0.5, all columns; null and empty texts stay, repeated rows go or stay together."""
    spread = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([spread.value.score(x.as_py()) < 0.5 for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
