"""Language identification against plain counting and a plain vote, and on languages held out."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from driftline.llm import language_id as lid

SYLLABLES = {"en": "th er on ing ed re the of and wh sh ly", "de": "sch ein ung der und ü ich ten ver zu ß heit", "nl": "ij een het van aa oe sch en ge oor lijk", "fr": "eau que é tion le oui è ment aux", "es": "ción os el ñ que la ar ó dad ado", "xx-Cyrl": "пре на ст ов ени ра го"}
SCHEMA = "doc_id long, text string, lang string, source string, _id string, score string, x int"


def sentence(lang, seed):
    rng = np.random.default_rng(seed)
    own = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(own, int(rng.integers(1, 4)))) for _ in range(int(rng.integers(4, 30)))).capitalize() + "."


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", "i", "s", 1) for i, t, lang in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    langs = list(SYLLABLES)
    return [(i, sentence(langs[i % 6], i), langs[i % 6]) for i in range(900)]


@pytest.fixture(scope="module")
def model(spark, rows):
    return lid.fit_languages(frame(spark, rows), per_language=60)


def test_held_out_languages_are_found(spark, rows, model):
    truth = {i: lang for i, _, lang in rows}
    found = lid.identify_languages(frame(spark, rows), model).collect()
    assert len(found) == 900
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 < r.score < 1 for r in found)


def test_a_machine_for_each_pair_of_families_and_of_languages_within_one(model):
    assert sorted((g, a, b) for g, own in model.machines.items() for a, b, _ in own) == [("", "germanic", "romance"), ("", "germanic", "xx-Cyrl"), ("", "romance", "xx-Cyrl"), ("germanic", "de", "en"), ("germanic", "de", "nl"), ("germanic", "en", "nl"), ("romance", "es", "fr")]


def plain_groups(text):
    """Groups of three bytes of the text, folded by a regular expression."""
    folded = b" " + re.sub(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]+", b" ", text.encode()).lstrip(b" ")
    folded = folded if folded.endswith(b" ") else folded + b" "
    folded = re.sub(rb"[A-Z]", lambda m: m[0].lower(), folded)
    return Counter(folded[i : i + 3] for i in range(len(folded) - 2))


def code(group):
    h = sum(b * m for b, m in zip(group, (2654435761, 2246822519, 3266489917), strict=True)) % 2**32
    return (h ^ (h >> 15)) * 739982445 % 2**32 % lid.FEATURES


def test_features_equal_plain_counting():
    texts = ["The THE the-end", None, "", "  a", "é", "12 ß!!x  y", "über\n\tAlles  ", "日本 語", "?", sentence("de", 3) * 50]
    x = lid.features(pa.array(["left out", *texts]).slice(1))
    for text, row in zip(texts, x, strict=True):
        expected = np.zeros(lid.FEATURES)
        groups = plain_groups(text or "")
        for g, n in groups.items():
            expected[code(g)] += n
        assert np.allclose(row, np.sqrt(expected / max(1, sum(groups.values()))))


def test_predictions_equal_a_plain_vote(spark, rows, model):
    def winner(x, group, names):
        votes, sums, least = Counter(), Counter(), {n: np.inf for n in names}
        for a, b, w in model.machines.get(group, []):
            m = float(x @ w[:-1] + w[-1])
            votes[a if m > 0 else b] += 1
            for n, v in ((a, m), (b, -m)):
                sums[n] += v
                least[n] = min(least[n], v)
        best = max(names, key=lambda n: (votes[n], sums[n]))
        return best, 1 / (1 + np.exp(-2 * least[best]))

    found = {r.doc_id: r for r in lid.identify_languages(frame(spark, rows), model).collect()}
    for i, text, _ in rows[:200]:
        x = lid.features(pa.array([text]))[0]
        family, p = winner(x, "", sorted({lid.family_of(n) for n in model.languages}))
        lang, q = winner(x, family, [n for n in model.languages if lid.family_of(n) == family])
        assert found[i].lang_pred == lang and abs(found[i].score - p * q) < 1e-9


def test_svm_is_at_its_optimum():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(80, 5)), np.where(rng.random(80) < 0.3, 1.0, -1.0)
    x[:, 0] += y
    w = lid.fit_svm(x, y)
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    full = np.column_stack([x, np.ones(80)])
    slack = np.maximum(0, 1 - y * (full @ w))
    assert np.abs(lid.PENALTY * w - full.T @ (weight * slack * y)).max() < 1e-9


def test_odd_texts(spark, rows, model):
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, " 12 ?! \n", "de"), (1003, "a", None), (1003, "a", None), (None, rows[0][1], "en"), (1004, "<|x|>" + sentence("fr", 7) * 4000, "fr"), (-5, "٣٤", None)]
    found = sorted(((r.doc_id, r.held_out, r.lang_pred, r.score) for r in lid.identify_languages(frame(spark, odd), model).collect()), key=repr)
    by = {f[0]: f for f in found}
    assert all(by[i][2:] == ("und", 0.0) for i in (1000, 1001, 1002, -5))
    assert len(found) == 8 and by[1004][2] == "fr" and by[None][1:3] == (False, "en")
    assert [f for f in found if f[0] == 1003][0] == [f for f in found if f[0] == 1003][1]


def test_one_language_none_and_no_row(spark, rows):
    only = [r for r in rows if r[2] == "fr"][:40]
    found = lid.identify_languages(frame(spark, rows[:20]), lid.fit_languages(frame(spark, only))).collect()
    assert {(r.lang_pred, r.score) for r in found} == {("fr", 1.0)}
    none = lid.fit_languages(frame(spark, [(i, t, None) for i, t, _ in only]))
    assert {(r.lang_pred, r.score) for r in lid.identify_languages(frame(spark, only), none).collect()} == {("und", 0.0)}
    assert lid.identify_languages(frame(spark, []), lid.fit_languages(frame(spark, []))).count() == 0


def test_a_sample_is_bounded_and_leaves_out_held_out_rows(spark, rows):
    many = rows * 2 + [(2000, "123", "en"), (2001, None, "en")]
    found = lid.training_rows(frame(spark, many), per_language=70).collect()
    assert Counter(r.lang for r in found) == {lang: 70 for lang in SYLLABLES}
    held = {t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert not held & {r.text for r in found}
