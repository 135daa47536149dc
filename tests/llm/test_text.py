import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftline.llm import license_scan, ngram_lm, sharding, span_hash, toxicity


def test_license_scan(docs, rows, nothing):
    known = license_scan.prepared(license_scan.TEMPLATES, license_scan.THRESHOLD)
    want = Counter()
    for i, t in rows:
        clean = re.sub(r"[^\w\n]+|_", " ", (t or "").lower())
        units = clean.split("\n") + ([clean.replace("\n", " ")] if "\n" in clean else [])
        found = []
        for unit in units:
            words = [w for w in unit.split(" ") if w]
            grams = Counter(map(" ".join, zip(words, words[1:], strict=False)))
            n = len(words) - 1
            scores = [(2 * sum((grams & k["grams"]).values()) / (n + k["size"]), -j) for j, k in enumerate(known) if n > 0]
            if scores and max(scores)[0] >= license_scan.THRESHOLD:
                found.append(max(scores))
        best = max(found, default=None)
        want[i, known[-best[1]]["name"] if best else None, best[0] if best else None, len(found)] += 1
    assert Counter(map(tuple, license_scan.scan_licenses(docs).collect())) == want
    assert license_scan.scan_licenses(nothing).count() == 0
    plan = license_scan.scan_licenses(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_every_template_finds_itself(spark):
    df = spark.createDataFrame(list(enumerate(t for _, t in license_scan.TEMPLATES)), "doc_id long, text string")
    assert [(r.license_id, r.dice) for r in license_scan.scan_licenses(df).orderBy("doc_id").collect()] == [(n, 1.0) for n, _ in license_scan.TEMPLATES]


def test_licences_inside_texts(spark):
    def wrapped(text, width=9):
        w = text.split()
        return "\n".join(" * " + " ".join(w[i : i + width]) for i in range(0, len(w), width))

    full = {n: t for n, t in license_scan.TEMPLATES if len(t.split()) > 150}
    assert {"Apache-2.0", "MIT", "BSD-3-Clause", "MPL-2.0", "GPL-2.0", "GPL-3.0"} <= set(full)
    mpl = next(t for n, t in license_scan.TEMPLATES if n == "MPL-2.0")
    code = "int main() {\n" + "return fun(of, the, value);\n" * 300 + "}\n"
    texts = [
        ("CC-BY-4.0", "Copyright 2024 Example. Licensed under CC BY 4.0."),
        ("Apache-2.0", '# Licensed under the Apache License, Version 2.0 (the "License"); you may'),
        ("MPL-2.0", code + wrapped(mpl) + "\n" + code),
        ("MIT", code + "Released under the MIT License.\n" + code),
        ("MIT", code + wrapped(full["MIT"].replace("sublicense, and/or sell", "and sell")) + code),
        ("BSD-2-Clause", code + wrapped(full["BSD-2-Clause"]) + code),
        ("Apache-2.0", wrapped(full["Apache-2.0"]) + "\nthe end"),
        ("GPL-2.0", wrapped(full["GPL-2.0"])),
        (None, code + "licensed under no terms of the GNU kind, version 3\n"),
        # the words of a notice, but never together
        (None, ("Licensed under " + "x " * 40 + "under CC " + "x " * 40 + "CC BY " + "x " * 40 + "BY 4.0 ") * 3),
    ]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    found = license_scan.scan_licenses(df).orderBy("doc_id").collect()
    assert [r.license_id for r in found] == [n for n, _ in texts]
    assert [r.matches > 0 for r in found] == [n is not None for n, _ in texts]
    assert [found[i].dice for i in (0, 1, 2, 3, 5, 7)] == [1.0] * 6 and 0.9 < found[4].dice < 1


@given(st.lists(st.sampled_from("abcd"), min_size=2, max_size=14), st.lists(st.sampled_from("abcde"), max_size=30))
@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_best_span(spark, template, words):
    threshold = 0.6
    known = license_scan.prepared([("x", " ".join(template))], threshold)[0]

    def dice(w):
        return 2 * sum((Counter(map(" ".join, zip(w, w[1:], strict=False))) & known["grams"]).values()) / (len(w) - 1 + known["size"])

    best = max((dice(words[i:j]) for i in range(len(words)) for j in range(i + 2, len(words) + 1)), default=0)
    whole = dice(words) if len(words) > 1 else 0
    want = whole if whole >= threshold else best if best >= threshold else None
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    row = license_scan.scan_licenses(df, templates=[("x", " ".join(template))], threshold=threshold).first()
    assert (row.dice, row.matches) == (want, int(want is not None))


def test_sharding(docs, nothing):
    names = [f"s{i}" for i in range(10)]
    table = sharding.lookup_table(names, 1009)
    sizes = Counter(table)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(table) == set(range(10))
    less = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, less, strict=True) if a != 9)
    assert moved < 0.15 * 1009
    out = sharding.assign_shards(docs, F.col("doc_id").cast("string"), names, 1009)
    assert out.columns == [*docs.columns, "slot", "shard"]
    assert all(table[r.slot] == r.shard and r.slot == int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:8], 16) % 1009 for r in out.collect())
    assert sharding.assign_shards(docs, F.lit(None).cast("string"), names, 1009).select("shard").distinct().count() == 1
    assert sharding.assign_shards(nothing, F.col("text"), names, 1009).count() == 0
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 1009)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 1000)


def _window_hashes(text):
    """By the definition: a polynomial over code points, modulo a prime, for every window."""
    p, base = span_hash.PRIMES[0], span_hash.BASES[0]
    width = min(5, len(text))
    return [sum((ord(c) + 1) * pow(base, k, p) for k, c in enumerate(text[i : i + width])) % p for i in range(len(text) - width + 1) if width]


def _spark_hashes(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return {r.t: r.h for r in df.select("t", F.xxhash64("t").alias("h")).collect()}


def test_fingerprints(spark, docs, rows, nothing):
    found = span_hash.fingerprint_documents(docs).collect()
    by_hash = _spark_hashes(spark, {t or "" for _, t in rows})
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0], by_hash[r[1]]))
    want = Counter()

    def sketch(t):
        return np.unique(span_hash.mixed(np.array(_window_hashes(t), np.uint64)) >> np.uint64(32))[:160]

    def text_of(t):
        whole = [sum((ord(c) + 1) * pow(b, k, p) for k, c in enumerate(t)) % p for p, b in zip(span_hash.PRIMES, span_hash.BASES, strict=True)]
        return f"{whole[0]:08x}{whole[1]:08x}" + sketch(t).astype(">u4").tobytes().hex()

    for k, (i, t) in enumerate(order):
        after, half = order[(k + 1) % len(order)][1], len(t) // 2
        if len(t) > 20_000:  # the definition takes too long
            continue
        edited = t[: len(t) - half] + after[:half]
        common = next((j for j, (a, b) in enumerate(zip(t, after, strict=False)) if a != b), min(len(t), len(after)))
        near = [_near(sketch(t), sketch(x)) for x in (edited, after)] if len(after) <= 20_000 else [None, None]
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text_of(t), text_of(edited), common, *near] += 1
    long = {i for i, t in order if len(t) > 20_000} | {order[k - 1][0] for k, (i, t) in enumerate(order) if len(t) > 20_000}
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.common_prefix_next, r.near_edited, r.near_next) for r in found)
    assert sum(got.values()) == len(rows)
    assert {k: n for k, n in got.items() if k[0] not in long} == {k: n for k, n in want.items() if k[0] not in long}
    assert span_hash.fingerprint_documents(nothing).count() == 0
    assert span_hash.fingerprint_documents(docs.where("doc_id = 3")).count() == 1
    no_id = span_hash.fingerprint_documents(docs.withColumn("doc_id", F.lit(None).cast("long")))
    assert Counter(r.fingerprint for r in no_id.collect()) == Counter(r.fingerprint for r in found)


def _near(a, b):
    both = np.union1d(a, b)[:160]
    return sum(x in set(a.tolist()) and x in set(b.tolist()) for x in both.tolist()) / len(both) if len(both) else 1.0


def test_likeness_is_the_share_of_windows_at_every_length(spark):
    """Texts of random letters, each followed by a short one, around lengths where windows are few."""
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n))
    texts = [t for n in [*range(20, 170, 3), 79, 80, 81, 300, 1000] for t in (word(n), word(int(rng.integers(3, 9))))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in span_hash.fingerprint_documents(df).collect():
        own, after = texts[r.doc_id], texts[(r.doc_id + 1) % len(texts)]
        edited = own[: len(own) - len(own) // 2] + after[: len(own) // 2]
        for near, other in ((r.near_edited, edited), (r.near_next, after)):
            a, b = (set(t[i : i + 5] for i in range(len(t) - 4)) or {t} for t in (own, other))
            assert abs(near - len(a & b) / len(a | b)) < (0.01 if len(own) < 140 else 0.12)


def test_rows_of_one_id_are_dealt_over_parts(spark):
    rows = [(7, f"text number {i}") for i in range(400)] + [(i, f"other {i}") for i in range(60)] + [(None, f"none {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    dealt = span_hash.in_turn(df, "doc_id", "text").withColumn("task", F.spark_partition_id()).where("NOT look").collect()
    assert Counter((r.id, r.text) for r in dealt) == Counter(rows) and len({r.task for r in dealt}) >= 4
    assert max(Counter(r.task for r in dealt).values()) < 500
    by_hash = _spark_hashes(spark, {t for _, t in rows})
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, by_hash[r[1]]))
    after = {t: order[(k + 1) % len(order)][1] for k, (_, t) in enumerate(order)}
    want = Counter(hashlib.sha256((t[: len(t) - len(t) // 2] + after[t][: len(t) // 2]).encode()).hexdigest() for _, t in rows)
    assert Counter(r.edited_sha256 for r in span_hash.fingerprint_documents(df).collect()) == want


def test_likeness_follows_shared_text():
    rng = np.random.default_rng(3)
    for n in (12, 40, 300, 5000):
        a, b = ("".join(rng.choice(list("abcdefghijklmnop "), n)) for _ in range(2))
        own = span_hash.Fingerprint(a)
        text, sketch, whole = own.edited(span_hash.Fingerprint(b))
        assert text == a[: n - n // 2] + b[: n // 2] and whole == span_hash.Prefixes(text).whole()
        near = span_hash.likeness(own.sketch, sketch)
        assert 0.1 < near < 0.6 and span_hash.likeness(own.sketch, span_hash.Fingerprint(b).sketch) < 0.1
        assert span_hash.likeness(own.sketch, own.sketch) == 1


@given(st.text(max_size=60), st.text(max_size=60), st.data())
@settings(max_examples=60, deadline=None)
def test_spans(a, b, data):
    b = a[: len(a) // 2] + b
    p, q = span_hash.Prefixes(a), span_hash.Prefixes(b)
    i, j = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    n = 0
    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
        n += 1
    assert span_hash.common_extension(p, i, q, j) == n
    k = data.draw(st.integers(0, min(len(a) - i, len(b) - j)))
    assert span_hash.same_span(p, i, q, j, k) == (a[i : i + k] == b[j : j + k])


def test_likeness():
    a = np.arange(1000, dtype=np.uint64)
    assert span_hash.likeness(a[:64], a[:64]) == 1 and span_hash.likeness(a[:64], a[100:164]) == 0 and span_hash.likeness(a[:0], a[:0]) == 1


def test_lm_scores(docs, rows, nothing):
    def tokens(t):
        return re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + [""]

    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    words, pairs, triples = Counter(), Counter(), Counter()
    for i, t in rows:
        if not held[i]:
            w = tokens(t)
            words.update(w)
            pairs.update(zip(["", *w[:-1]], w, strict=True))
            triples.update(zip(["", *w[:-2]], w[:-1], w[1:], strict=False))
    m2, m3 = ((sum(n == 1 for n in c.values()) + 1) / (2 * sum(n == 2 for n in c.values()) + 1) for c in (pairs, triples))
    total, distinct = sum(words.values()), len(words)
    want = []
    for i, t in rows:
        w = tokens(t)
        p = [(words[x] + 1) / (total + distinct + 1) for x in w]
        model = [(pairs[h, x] + m2 * q) / (words[h] + m2) for h, x, q in zip(["", *w[:-1]], w, p, strict=True)]
        model[1:] = [(triples[g, h, x] + m3 * q) / (pairs[g, h] + m3) for g, h, x, q in zip(["", *w[:-2]], w[:-1], w[1:], model[1:], strict=False)]
        want.append((i, held[i], len(w), sum(words[x] > 0 for x in w), total, sum(map(math.log10, p)), sum(map(math.log10, model))))
    found = ngram_lm.score_documents(docs).collect()
    assert len(found) == len(want)
    for got, ok in zip(sorted(map(tuple, found)), sorted(want), strict=True):
        assert got[:5] == ok[:5] and np.allclose(got[5:], ok[5:])
    assert ngram_lm.score_documents(nothing).count() == 0


def test_lm_probabilities_add_up():
    """After every context, over all words of the training texts and the share of unknown ones."""
    texts = [[1, 2, 1, 3, 0], [2, 2, 3, 0], [0]]
    hashes = np.array([70, 10, 40, 20, 90], np.uint64) << np.uint64(40)  # 4: a word that no text has
    trained = ngram_lm.Block(np.concatenate(texts), np.array([5, 4, 1]), hashes)
    sums = [dict(zip(g[2].tolist(), c.tolist(), strict=True)) for g, c in zip(trained.grams, trained.counts(np.ones(3, bool)), strict=True)]
    for context in ([], [1], [1, 2], [2, 2], [3, 3], [4, 1]):
        tried = [[*context, w] for w in range(5)]
        if not context:
            tried[0] = [0]
        block = ngram_lm.Block(np.concatenate(tried), np.array([len(t) for t in tried]), hashes)
        counts = [np.array([s.get(h, 0) for h in g[2].tolist()]) for g, s in zip(block.grams, sums, strict=True)]
        score = block.scores(counts, 10, 4, (1.5, 2.5))[2]
        prefix = ngram_lm.Block(np.array(context, np.int64), np.array([len(context)]), hashes)
        before = [np.array([s.get(h, 0) for h in g[2].tolist()]) for g, s in zip(prefix.grams, sums, strict=True)]
        start = prefix.scores(before, 10, 4, (1.5, 2.5))[2][0] if context else 0.0
        assert math.isclose(sum(10 ** (score - start)), 1), context


def test_toxicity(spark, nothing):
    bad = ["vilestuff", "nastyone", "gruntos"]
    calm = "the quick brown fox jumps over a lazy dog while small owls watch from an old oak tree".split()
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(600):
        words = list(rng.choice(calm, 30)) + [f"w{i}"]
        toxic = i % 4 == 0
        if toxic:
            word = bad[i // 4 % 3]
            words.insert(int(rng.integers(0, 30)), word.replace("i", "1").replace("a", "а") if i % 3 == 0 else word.upper())
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    rows += [(700, None, None, None, None), (701, "", None, None, None), (702, " ".join(calm * 3000), None, None, None), (0, rows[0][1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, known)
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == len(rows)
    truth = {i: t for i, _, t in labels}
    assert all(r.predicted == truth.get(r.doc_id, 0) and 0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == 450 + 3
    empty = toxicity.fit_toxicity(docs, known.limit(0))
    assert toxicity.score_toxicity(docs, empty).where("predicted = 1").count() == 0
    none = nothing.select("doc_id", "text")
    assert toxicity.score_toxicity(none, toxicity.fit_toxicity(none, known)).count() == 0


def _naive_weight(model, folded):
    """The heaviest stem of each word outside exception phrases, by looking at every place."""
    words, total, at = folded.split(), 0.0, 0
    spared = set()
    for phrase in model.exceptions:
        want = phrase.split()
        for i in range(len(words) - len(want) + 1):
            if words[i : i + len(want)] == want:
                spared |= set(range(i, i + len(want)))
    for at, word in enumerate(words):
        if at not in spared:
            total += max((w for s, w in model.stems.items() if word.startswith(s)), default=0.0)
    return total


@given(st.lists(st.sampled_from(["kill", "killer", "kills", "switch", "the", "ki11", "skill", "idiotic", "idiot", "1d1ot", "an"]), max_size=25))
@settings(max_examples=200, deadline=None)
def test_weights_against_a_naive_matcher(words):
    model = toxicity.ToxicityModel({"kill": 5.0, "killer": 7.5, "idiot": 3.0}, frozenset(["kill switch", "the killer", "an idiot"]))
    folded = toxicity.fold(" ".join(words))
    weight = model.weight(folded)
    assert math.isclose(weight, _naive_weight(model, folded))
    x = model.slope * math.log(toxicity.FLOOR + weight / (folded.count(" ") + toxicity.FEW_WORDS) ** model.power) + model.offset
    assert math.isclose(model.score(" ".join(words)), 1 / (1 + math.exp(-x)))


def test_folding():
    assert toxicity.fold("In 2013, 1057 of them") == " in 2013 1057 of them "
    assert toxicity.fold("k1ll kíll ｋｉｌｌ K-I-L-L кill") == " kill kill kill k i l l kill "
    long = "x" * 30
    assert toxicity.stems_in(long) == [long[:k] for k in range(3, 15)] + [long]


def test_exceptions_spare_their_words():
    model = toxicity.ToxicityModel({"kill": 5.0}, frozenset(["kill switch"]))
    assert model.weight(toxicity.fold("They k1ll!")) == 5.0
    assert model.weight(toxicity.fold("the kill switch")) == 0.0
    assert model.weight(toxicity.fold("the kill switch kills")) == 5.0
    assert toxicity.fold("Іdіot STаR $tu ca$h") == " idiot star tu cash "
