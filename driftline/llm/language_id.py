"""Language identification: first the family, then one-versus-one linear support vector machines between the languages of the family."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spread import durable
from .tokens import slices

#: Labelled rows that a model is fitted on, at most, of each language. They are picked by a hash of the id.
PER_LANGUAGE = 500
#: Numbers that groups of three bytes are hashed to.
FEATURES = 4096
#: Weight of the squared norm of a machine's weights against the mean loss.
PENALTY = 1e-3
#: Text that is worked on at once, in bytes, and texts.
TEXT_BYTES, TEXTS = 2 << 20, 512
UNKNOWN = "und"

# The family of a language code. A code that is not here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt ug uz",
    "indic": "as bn gu hi mr ne or pa sd si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt ti",
    "malayic": "id jv ms su",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_FOLDED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)).lower()


def family_of(lang: str) -> str:
    """The family of a code, whatever its case and region."""
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], lang)


def features(texts: pa.Array) -> np.ndarray:
    """Square roots of the shares of hashed groups of three bytes in each text, so that rows have length 1; 0 for a text without any.

    ASCII letters are lower-cased; other ASCII characters count as a space, and several spaces as one. Each text has a
    space at both ends. No group reaches over the end of a text.
    """
    texts = pc.fill_null(texts, "")
    raw = np.frombuffer("".join(f"\x00{t} " for t in texts.to_pylist()).encode().translate(_FOLDED), np.uint8)
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    starts = np.cumsum(sizes) - sizes
    kept = raw != 32
    kept[1:] |= kept[:-1]  # and the space after a word
    kept[starts] = True
    folded, text = raw[kept].astype(np.uint32), np.repeat(np.arange(len(sizes)), np.add.reduceat(kept, starts, dtype=np.int64))
    codes = folded[:-2] * np.uint32(2654435761) + folded[1:-1] * np.uint32(2246822519) + folded[2:] * np.uint32(3266489917)
    codes = (codes ^ (codes >> np.uint32(15))) * np.uint32(739982445)
    inside = text[:-2] == text[2:]
    at = text[:-2][inside] * FEATURES + codes[inside] % np.uint32(FEATURES)
    counts = np.bincount(at, minlength=len(texts) * FEATURES).reshape(len(texts), FEATURES)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Weights and offset of a linear support vector machine with squared loss between y = -1 and 1.

    Newton steps over the rows within the margin, in the space of rows, whose number is bounded; the two classes weigh alike.
    """
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    gram, inside = x @ x.T, np.ones(len(x), bool)
    for _ in range(50):
        own = np.flatnonzero(inside)
        dual = np.linalg.solve(gram[np.ix_(own, own)] + np.diag(penalty / weight[own]), y[own])
        now = y * (gram[:, own] @ dual) < 1
        if (now == inside).all() or not now.any():
            break
        inside = now
    return dual @ x[own]


@dataclass
class LanguageModel:
    """Machines between families and between the languages of each family; a machine is (first, second, weights and offset), positive for the first."""

    languages: list[str]
    machines: dict[str, list[tuple[str, str, np.ndarray]]] = field(default_factory=dict)

    def _choose(self, x: np.ndarray, group: str, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The winner among names by votes, then by summed margins, and a probability from its closest contest."""
        place = {n: i for i, n in enumerate(names)}
        votes, sums, least = np.zeros((len(x), len(names))), np.zeros((len(x), len(names))), np.full((len(x), len(names)), np.inf)
        for first, second, w in self.machines.get(group, []):
            margin = x @ w[:-1] + w[-1]
            for name, m in ((first, margin), (second, -margin)):
                i = place[name]
                votes[:, i] += m > 0
                sums[:, i] += m
                least[:, i] = np.minimum(least[:, i], m)
        best = np.argmax(votes + 0.49 * sums / (1 + np.abs(sums)), axis=1)
        return best, 1 / (1 + np.exp(-2 * least[np.arange(len(x)), best]))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position of the language in ``languages``, score) of each row of features."""
        families = sorted({family_of(n) for n in self.languages})
        family, score = self._choose(x, "", families)
        out = np.zeros(len(x), np.int64)
        for i, name in enumerate(families):
            own = np.flatnonzero(family == i)
            names = [n for n in self.languages if family_of(n) == name]
            best, sure = self._choose(x[own], name, names)
            out[own] = np.array([self.languages.index(n) for n in names])[best]
            score[own] *= sure
        return out, score


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def _has_letter(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def training_rows(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, text) of at most ``per_language`` rows of each language that are not held out and have a language and letters.

    Ids and languages are counted first; then few more rows than needed, by a hash of the id, carry their texts to the final choice.
    """
    known = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col) & _has_letter(text_col)).select(F.col(lang_col).alias("lang"), F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    share = known.groupBy("lang").agg(F.count("*").alias("_n")).select("lang", F.least(F.lit(1.0), (1.2 * per_language + 50) / F.col("_n")).alias("_share"))
    drawn = F.xxhash64("_id", F.lit("language"))
    some = known.withColumn("_drawn", drawn).join(F.broadcast(share), "lang").where(F.pmod("_drawn", F.lit(1 << 20)) < F.col("_share") * (1 << 20))
    order = Window.partitionBy("lang").orderBy("_drawn", F.xxhash64("text"))
    return some.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_language).select("lang", "text", "_drawn")


def _pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, column, TEXT_BYTES):
            for i in range(0, len(part), TEXTS):
                yield part.slice(i, TEXTS)


def fit_languages(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", per_language: int = PER_LANGUAGE) -> LanguageModel:
    """A model from texts whose crc32 of the id, modulo 5, is not 0; it never sees source or other columns.

    A machine is fitted by one task on the rows of its two sides: at most ``per_language`` rows of a language, or of
    a family. The driver gets the weights, ``FEATURES`` numbers for each pair of families and of languages of one family.
    """
    schema = pa.schema([("lang", pa.string()), ("_drawn", pa.int64()), ("x", pa.list_(pa.float32()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _pieces(batches, 2):
            x = features(some.column(2)).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * FEATURES, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), lists], schema=schema)

    rows = training_rows(docs, id_col, lang_col, text_col, per_language).select("lang", "_drawn", "text")
    counted = durable(rows.mapInArrow(count, "lang string, _drawn long, x array<float>"))
    languages = sorted(r.lang for r in counted.select("lang").distinct().collect())
    model = LanguageModel(languages)
    contests = [("", a, b) for a, b in _pairs(sorted({family_of(n) for n in languages}))]
    contests += [(f, a, b) for f in sorted({family_of(n) for n in languages}) for a, b in _pairs([n for n in languages if family_of(n) == f])]
    if not contests:
        return model
    sides = [(i, n, s) for i, (group, a, b) in enumerate(contests) for n in languages for s in (1, -1) if (family_of(n) if not group else n) == (a if s > 0 else b)]
    side = docs.sparkSession.createDataFrame(sides, "contest int, lang string, side int")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_drawn").groupby("side").head(per_language)
        x = np.stack(pdf["x"].to_numpy()).astype(float)
        return pd.DataFrame({"contest": [int(pdf["contest"].iloc[0])], "w": [fit_svm(x, pdf["side"].to_numpy(float)).tolist()]})

    fitted = counted.join(F.broadcast(side), "lang").groupBy("contest").applyInPandas(fit, "contest int, w array<double>").collect()
    for r in sorted(fitted, key=lambda r: r.contest):
        group, a, b = contests[r.contest]
        model.machines.setdefault(group, []).append((a, b, np.array(r.w)))
    return model


def _pairs(names: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) of every row, from its whole text alone.

    A null or empty text, or one without any letter, is ``und`` with score 0; so is every text if no row had a
    language to learn. If one language was learned, it is every other text's, with score 1. Repeated rows get equal results. Rows without an id
    are predicted and never learned from. Other columns are not read.
    """
    out = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _pieces(batches, 1):
            known = some.column(1).is_valid().to_numpy(zero_copy_only=False) & bool(model.languages)
            lang, score = np.zeros(len(some), np.int64), np.zeros(len(some))
            if known.any():
                lang[known], score[known] = model.predict(features(some.column(1).filter(pa.array(known))))
            names = pa.array([*model.languages, UNKNOWN]).take(pa.array(np.where(known, lang, len(model.languages))))
            yield pa.RecordBatch.from_arrays([some.column(0), names, pa.array(score)], names=out.names)

    found = docs.select(F.col(id_col).alias("_id"), F.when(_has_letter(text_col), F.col(text_col)).alias("text")).mapInArrow(predict, out)
    return found.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), "lang_pred", "score")
