import hashlib
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from driftline.llm import components, exact_dedup, simhash


def test_exact_groups(docs, rows, nothing):
    found = exact_dedup.exact_groups(docs).collect()
    by = {}
    for i, t in rows:
        by.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    want = Counter()
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        want[i, min(by[norm])[1], len(by[norm]), hashlib.sha256(norm.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == want
    assert sum(r.kept for r in found) == len(by)
    assert exact_dedup.exact_groups(nothing).count() == 0


def test_texts_that_share_a_hash_are_told_apart(docs):
    weak = exact_dedup.exact_groups(docs, digest=lambda c: F.substring(F.md5(c), 1, 1))
    strong = exact_dedup.exact_groups(docs)
    assert sorted(map(tuple, weak.drop("kept").collect())) == sorted(map(tuple, strong.drop("kept").collect()))


def test_drop_exact_copies(docs, rows, nothing):
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows})
    assert exact_dedup.drop_exact_copies(nothing).count() == 0
    no_id = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert exact_dedup.drop_exact_copies(no_id).count() == kept.count()


def _print(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(numbers, radius):
    x = np.array(numbers, np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None]) <= radius
    label = np.arange(len(x))
    while True:
        new = np.where(near, label[None], len(x)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def test_simhash_groups(docs, rows, nothing):
    found = simhash.simhash_groups(docs).collect()
    prints = [_print(t) for _, t in rows]
    label = _components(prints, 3)
    least = {}
    for (i, _), c in zip(rows, label, strict=True):
        least[c] = min(i, least.get(c, i))
    want = Counter((i, f"{p:016x}", least[c]) for (i, _), p, c in zip(rows, prints, label, strict=True))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found) == want
    assert simhash.simhash_groups(nothing).count() == 0
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))
    assert simhash.simhash_groups(docs.withColumn("doc_id", F.lit(None).cast("long"))).count() == len(rows)


def test_near_copies_are_told_apart_by_row(spark):
    """One id on two texts, repeated rows, rows without an id, null and empty texts."""
    a, b, c = ("alpha beta gamma delta epsilon zeta eta theta " * 4, "one two three four five six seven eight nine ten " * 5, "red green blue white black brown grey pink " * 6)
    rows = [(3, a), (5, a), (5, b), (5, b), (8, None), (8, ""), (None, c), (None, c), (None, a), (9, c + " end"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = Counter((r.doc_id, r.text or "") for r in simhash.drop_near_copies(df).collect())
    near_c = bin(_print(c) ^ _print(c + " end")).count("1") <= 3
    assert kept == Counter([(3, a), (5, b), (8, ""), (9, c + " end")] + ([] if near_c else [(None, c)]))
    groups = simhash.simhash_groups(df).collect()
    assert len(groups) == len(rows) and sum(r.kept for r in groups) == sum(kept.values())
    exact = Counter((r.doc_id, r.text or "") for r in exact_dedup.drop_exact_copies(df).collect())
    assert exact == Counter([(3, a), (5, b), (8, ""), (None, c), (9, c + " end")])
    assert simhash.drop_near_copies(df.limit(0)).count() == exact_dedup.drop_exact_copies(df.limit(0)).count() == 0


def test_tiles_find_every_link(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    numbers = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(30)], base[:5, None].repeat(40, 1).ravel() ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64))]))
    df = spark.createDataFrame([(int(v),) for v in numbers.view(np.int64)], "fp long")
    for tile in (4, 2048):
        roots = {r.node: r.root for r in components.connected_components(simhash.near_links(df, 3, tile=tile)).collect()}
        label = _components(numbers, 3)
        got = [roots.get(int(v), int(v)) for v in numbers.view(np.int64)]
        assert len(set(zip(got, label.tolist(), strict=True))) == len(set(got)) == len(set(label.tolist()))


def test_masks_cover_every_difference():
    for n in (10, 10**8, 10**11, 10**13):
        masks = simhash.shared_bits(n, 3)
        rng = np.random.default_rng(n % 97)
        for _ in range(200):
            flipped = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
            assert any(m & flipped == 0 for m in masks)


def test_components_of_a_long_path(spark):
    links = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    roots = components.connected_components(links.unionByName(spark.createDataFrame([(500, 501)], "a long, b long")))
    assert {(r.node, r.root) for r in roots.collect()} == {(i, 0) for i in range(200)} | {(500, 500), (501, 500)}
