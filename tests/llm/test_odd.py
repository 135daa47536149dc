"""Cases that other tests leave out: rows without ids, columns of the operators' own names, texts longer than what is worked on at once."""

from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftline.llm import bpe_replay, license_scan, ngram_lm, packing, sharding, token_output, tokens, toxicity

from .conftest import SCHEMA, prose


@pytest.fixture(scope="module")
def no_ids(spark):
    """Two of three rows have no id; some rows are repeated."""
    texts = [prose(i, 20 + i) for i in range(24)] + ["Licensed under the MIT License.", "", None]
    rows = [(i if i % 3 == 0 else None, t) for i, t in enumerate(texts)] * 2
    return spark.createDataFrame([(i, t, None, None, None, "r", "h", "f") for i, t in rows], SCHEMA).repartition(3)


def test_rows_without_ids(spark, no_ids):
    n = no_ids.count()
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(27)], "doc_id long, quality int, toxic int")
    assert license_scan.scan_licenses(no_ids).where("doc_id IS NULL").count() == n - 18
    scored = toxicity.score_toxicity(no_ids, toxicity.fit_toxicity(no_ids, labels)).collect()
    assert len(scored) == n and not any(r.held_out for r in scored if r.doc_id is None)
    packed = packing.pack_documents(no_ids, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert len(packed) == n and sum(r.doc_id is None for r in packed) == n - 18  # no text is longer than a sequence
    replayed = bpe_replay.bpe_round_trip(no_ids, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert len(replayed) == n and max(Counter((r.doc_id, r.ids_sha256) for r in replayed).values()) == 4  # a null and an empty text are alike
    lm = ngram_lm.score_documents(no_ids).collect()
    assert len(lm) == n and sum(r.doc_id is None for r in lm) == n - 18


def test_columns_named_slot_and_shard_are_replaced(spark):
    docs = spark.createDataFrame([(i, "old", "old", "kept") for i in range(40)], "doc_id long, slot string, shard string, other string")
    plain = {(r.doc_id, r.slot, r.shard) for r in sharding.assign_shards(docs.select("doc_id"), F.col("doc_id").cast("string"), ["a", "b", "c"]).collect()}
    found = sharding.assign_shards(docs, F.col("doc_id").cast("string"), ["a", "b", "c"])
    assert found.columns == ["doc_id", "other", "slot", "shard"] and {(r.doc_id, r.slot, r.shard) for r in found.collect()} == plain


def test_a_text_longer_than_a_piece_is_a_piece():
    batch = pa.record_batch({"id": list(range(6)), "text": ["a" * 10, "b" * 500, None, "", "c" * 40, "d" * 40]})
    parts = list(tokens.slices(batch, 1, 64))
    assert [p.column(0).to_pylist() for p in parts] == [[0], [1], [2, 3, 4], [5]]


def test_a_text_longer_than_a_batch_of_the_tokenizer():
    path, text = public_tokenizers.path("byte_bpe_50k.json"), " ".join(prose(k, 4000) for k in range(3))
    whole, n = tokens.byte_bpe_ids(pa.array([text, "x", text]), path)
    parts = [tokens.byte_bpe_ids(p.column(0), path)[0] for p in tokens.slices(pa.record_batch({"t": [text, "x", text]}), 0, 100)]
    assert len(parts) == 3 and (np.concatenate(parts) == whole).all() and n[0] == n[2]


def test_ids_that_the_coder_has_no_room_for_are_an_error(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer
    from tokenizers.models import WordLevel
    from tokenizers.pre_tokenizers import Whitespace

    words = {f"w{i}": i for i in range(70_001)} | {"<|endoftext|>": 70_001}
    large = Tokenizer(WordLevel(words, unk_token="w0"))
    large.add_special_tokens(["<|endoftext|>"])
    large.pre_tokenizer = Whitespace()
    path = str(tmp_path / "large.json")
    large.save(path)
    docs = spark.createDataFrame([(1, "w5 w70000")], "doc_id long, text string")
    with pytest.raises(Exception, match="the coder takes ids below 50304, and the tokenizer gave 70000"):
        token_output.write_tokens(docs, path, str(tmp_path / "out"))
