import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from driftline.llm import queries, toxicity

from .conftest import SCHEMA, prose
from .test_dedup import _components, _print
from .test_text import _naive_weight
from .test_tokens import _check_places, _plain_best_fit

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_operator_is_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_only_absent_modules_leave_queries_out(monkeypatch):
    import builtins

    real = builtins.__import__

    def without(name):
        def load(wanted, *args, **kwargs):
            if wanted == name:
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)
            return real(wanted, *args, **kwargs)

        return load

    monkeypatch.setattr(builtins, "__import__", without("corpus_pipeline"))
    assert entry._corpus() is None
    monkeypatch.setattr(builtins, "__import__", real)
    import sys

    monkeypatch.delitem(sys.modules, "corpus_pipeline")
    monkeypatch.setattr(builtins, "__import__", without("public_tokenizers"))
    with pytest.raises(ModuleNotFoundError):
        entry._corpus()


@pytest.fixture(scope="module")
def corpus():
    """Clean, toxic, equal and nearly equal documents; nulls, repeated rows, rows without an id. And their labels."""
    rows = [(i, prose(i, 40 + i % 17) + f" item {i}") for i in range(160)]
    labels = [(i, 1, 0) for i in range(160)]
    for i in range(200, 248):
        words = prose(i, 30).split()
        words.insert(i % 30, ["vilestuff", "NASTYone", "gr1ntos", "v1lestuff"][i % 4])
        rows.append((i, " ".join(words)))
        labels.append((i, 0, 1))
    rows += [(300, rows[3][1].replace(" ", "  ")), (301, rows[3][1].replace(" ", "")), (302, rows[200][1]), (303, prose(7, 900)), (304, prose(7, 900) + " end"), (305, prose(5, 3000))]
    rows += [(400, None), (401, ""), (402, " \n"), (5, rows[5][1]), (5, "another text of this id"), (None, rows[6][1]), (None, "no id at all"), (None, "no id at all"), (None, None)]
    return rows, labels


def _write(spark, folder, rows, labels):
    spark.createDataFrame([(i, t, "en", "s", 1, "r", "h", "f") for i, t in rows], SCHEMA).select(*COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def _order(row):
    return row[0] is None, row[0] or 0


def test_pipeline_against_plain_versions(spark, corpus, tmp_path):
    rows, labels = corpus
    _write(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))

    def plain_toxic(kept):
        def score(text):
            folded = toxicity.fold(text)
            x = model.slope * np.log(toxicity.FLOOR + _naive_weight(model, folded) / (folded.count(" ") + toxicity.FEW_WORDS) ** model.power) + model.offset
            return 1 / (1 + np.exp(-x))

        return [r for r in kept if score(r[1]) < 0.5]

    def plain_exact(kept):
        by = {}
        for r in kept:
            by.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append(r)
        return [min(x, key=lambda r: (-len(r[1] or ""), _order(r))) for x in by.values()]

    def plain_near(kept):
        label = _components([_print(t) for _, t in kept], 3)
        by = {}
        for r, c in zip(kept, label.tolist(), strict=True):
            by.setdefault(c, []).append(r)
        return [min(x, key=_order) for x in by.values()]

    kept = rows
    for (name, stage), plain in zip(corpus_pipeline.STAGES[:-1], (plain_toxic, plain_exact, plain_near), strict=True):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == COLUMNS, name
        found = docs.collect()
        before, kept = kept, plain(kept)
        # of null and empty texts, and of equal rows, any one may stay
        assert Counter((r.doc_id, r.text or "") for r in found) == Counter((i, t or "") for i, t in kept), name
        assert 0 < len(kept) < len(before), name
        docs = spark.createDataFrame(found, docs.schema)
    assert {i for i, _ in kept} & set(range(200, 248)) == set() and set(range(160)) - {i for i, _ in kept} <= {3, 6}

    library, want = Tokenizer.from_file(P.path("word_bpe_49k.json")), Counter()
    for i, t in kept:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, s in enumerate(range(0, len(ids), 2048)):
            want[i, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())] += 1
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    assert _check_places(packed) <= 1 + _plain_best_fit([k[3] for k, n in want.items() for _ in range(n)], 2048)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    _write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
