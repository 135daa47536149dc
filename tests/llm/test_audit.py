"""The source audit against plain counting."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from driftline.llm import divergence_audit as audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_docs, top):
    """Rows (text, lang, source) audited by loops over all kept terms."""
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = TERM.findall((text or "").translate(LOWER))
        count[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        own = {s: count[lang, s] for l, s in groups if l == lang}
        whole = sum(own.values(), Counter())

        def price(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        prices, q = {s: price(c) for s, c in own.items()}, price(whole)
        for s, p in prices.items():
            value = lambda a, b: (a - b) ** 2 // (a + b)
            pairs = [(sum(value(p[t], o[t]) for t in kept), other) for other, o in prices.items() if other != s]
            terms = [(value(p[t], q[t]), t) for t in kept if own[s][t] and p[t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, r + 1) for r, (v, item) in enumerate(found[:most])]
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def texts(n, sources):
    """Words whose frequency falls steeply, other ones frequent in each source; a third of all rows in one source."""
    rng = np.random.default_rng(5)
    words = ["the", "Of", "à", "ÉTÉ", "naïve", "rare", "x1y", "don't", "日本", "z"] + [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)]
    out = []
    for i in range(n):
        s = 0 if i % 3 == 0 else int(rng.integers(sources))
        weight = 1 / (1 + (np.arange(len(words)) * (s + 3)) % len(words))
        out.append((" ".join(rng.choice(words, int(rng.integers(0, 40)), p=weight / weight.sum())), "en" if i % 4 else "fr", f"s{s}"))
    return out


ODD = [(None, None, None), ("", "en", "s1"), ("alone alone", "xx", "only"), ("12 --", "yy", "a"), ("the", "yy", "b"), ("the of", None, "s2"), ("Über die Brücke", "de", None), ("über", "de", ""), ("Über über", "de", "é"), ("the " * 30000, "en", "s0")]


@pytest.mark.parametrize("min_docs, source_block", [(1, 64), (3, 2), (2, 3)])
def test_audit_equals_plain_counting(spark, min_docs, source_block):
    rows = texts(150, 7) + ODD + ODD[:4]
    docs = spark.createDataFrame([(i, *r, "t") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string").repartition(3)
    assert rows_of(audit.audit_sources(docs, min_docs=min_docs, top_terms=4, source_block=source_block)) == plain(rows, min_docs, 4)


def test_empty_table_gives_no_row(spark, nothing):
    assert audit.audit_sources(nothing).count() == 0


def test_no_kept_term_gives_pairs_of_value_0(spark):
    docs = spark.createDataFrame([("a b", "en", "s1"), ("c", "en", "s2")], "text string, lang string, source string")
    assert rows_of(audit.audit_sources(docs)) == [("en", "s1", "pair", "s2", 0, 1), ("en", "s2", "pair", "s1", 0, 1)]


def test_terms_keep_to_their_texts():
    found = pa.array(["ab", None, "Cd  é1é", "", "...", "x"]).slice(0)
    terms, text = audit.terms_of(found)
    assert (terms.to_pylist(), text.tolist()) == (["ab", "cd", "é", "é", "x"], [0, 2, 2, 2, 5])
    terms, text = audit.terms_of(found.slice(2))
    assert (terms.to_pylist(), text.tolist()) == (["cd", "é", "é", "x"], [0, 0, 0, 3])


def test_products_are_the_same_in_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    term, group = (x.ravel() for x in np.mgrid[:300, :9])
    level = rng.zipf(1.6, len(term)) % 1000
    some = level > 0
    term, group, level = term[some], group[some], level[some]
    p, p0 = 1 + level * 1000 // (group + 1), 1 + group
    whole = audit.joint_value(term, group, level, p, p0, 9)
    monkeypatch.setattr(audit, "COLUMNS", 40)
    assert (whole == audit.joint_value(term, group, level, p, p0, 9)).all()
