import base64
import bisect
import functools
import hashlib
import lzma
import math
import os
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftline.llm import bpe_replay, packed, packing, range_coder, strand_coder, token_output, tokens

DATA = os.environ.get("DRIFTLINE_TEST_DATA", "/root/testdata/sf0.001")


def _library(name):
    found = Tokenizer.from_file(P.path(name))
    return lambda t: found.encode(t or "", add_special_tokens=False).ids


@given(st.lists(st.lists(st.integers(0, range_coder.VOCABULARY - 1) | st.integers(0, 3), max_size=300), max_size=6))
@settings(max_examples=15, deadline=None)
def test_range_coder_round_trip(blocks):
    code = range_coder.encode_blocks([np.array(b, np.int64) for b in blocks])
    assert [x.tolist() for x in range_coder.decode_blocks(code)] == blocks
    assert all(range_coder.decode_blocks([c])[0].tolist() == b for c, b in zip(code, blocks, strict=True))


def _adaptive_order_0(ids):
    """Bytes that exact adaptive frequencies of a block's ids would need, with a uniform prior for new ids."""
    seen, bits = Counter(), 0.0
    for i, x in enumerate(ids):
        bits -= math.log2(seen[x] / (i + len(seen))) if x in seen else math.log2((len(seen) / (i + len(seen)) if i else 1) / range_coder.VOCABULARY)
        seen[x] += 1
    return bits / 8


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_blocks_are_smaller_than_simpler_models_make_them():
    texts = pq.read_table(f"{DATA}/documents.parquet", columns=["text"])["text"].combine_chunks()
    ids, _ = tokens.byte_bpe_ids(texts, P.path("byte_bpe_50k.json"))
    blocks = [ids[i : i + range_coder.BLOCK] for i in range(0, 12 * range_coder.BLOCK, range_coder.BLOCK)]
    code = range_coder.encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(blocks, range_coder.decode_blocks(code), strict=True))
    own, raw = sum(map(len, code)), [b.astype("<u2").tobytes() for b in blocks]
    assert own < 0.99 * sum(map(_adaptive_order_0, (b.tolist() for b in blocks)))
    assert own < sum(len(lzma.compress(b)) for b in raw) and own < sum(len(zlib.compress(b, 9)) for b in raw)


def test_order_2_pays_where_text_repeats():
    rng = np.random.default_rng(5)
    block = np.tile(rng.integers(0, range_coder.VOCABULARY, 64), 64)
    assert len(range_coder.encode_blocks([block])[0]) < 0.2 * _adaptive_order_0(block.tolist())


def test_blocks_keep_their_bytes():
    """Files that an earlier coder of this format wrote can still be read."""
    blocks = [np.arange(3000) * 7919 % range_coder.VOCABULARY, np.tile(np.arange(64) * 331, 64), np.arange(2000) ** 2 % 97, np.zeros(0, np.int64)]
    assert zlib.crc32(b"".join(range_coder.encode_blocks(blocks))) == 1454189121


def test_altered_blocks_are_refused():
    code = range_coder.encode_blocks([np.arange(500)])[0]
    for bad in (code[:-2], code[:40] + bytes([code[40] ^ 1]) + code[41:], b"", b"x" * 20):
        with pytest.raises(ValueError):
            range_coder.decode_blocks([bad])
    for bad in (np.array([range_coder.VOCABULARY]), np.zeros(range_coder.BLOCK + 1, np.int64)):
        with pytest.raises(ValueError):
            range_coder.encode_blocks([bad])


@given(st.lists(st.lists(st.integers(0, strand_coder.VOCABULARY - 1) | st.integers(0, 3), max_size=300), max_size=6))
@settings(max_examples=15, deadline=None)
def test_strand_coder_round_trip(blocks):
    code = strand_coder.encode_blocks([np.array(b, np.int64) for b in blocks])
    assert [x.tolist() for x in strand_coder.decode_blocks(code)] == blocks
    for c, b in zip(code, blocks, strict=True):
        assert strand_coder.encode_blocks([np.array(b, np.int64)]) == [c] and strand_coder.decode_blocks([c])[0].tolist() == b


def test_strands_of_long_and_short_blocks_and_of_the_earlier_coder():
    rng, n = np.random.default_rng(9), strand_coder.BLOCK
    blocks = [rng.integers(0, strand_coder.VOCABULARY, n), np.zeros(n, np.int64), np.arange(n) * 7919 % strand_coder.VOCABULARY, rng.zipf(1.3, n) % 50_000, np.full(n - 1, strand_coder.VOCABULARY - 1), np.tile(rng.integers(0, 50_000, 700), 11), *(rng.integers(0, 99, k) for k in (0, 1, 15, 16, 17, 4000)), *rng.integers(0, 9, (140, 20))]
    code = strand_coder.encode_blocks(blocks)
    assert code[4:9] == strand_coder.encode_blocks(blocks[4:9])
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, strand_coder.decode_blocks(code), strict=True))
    code[5:8] = range_coder.encode_blocks(blocks[5:8])
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, strand_coder.decode_blocks(code), strict=True))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_strands_are_smaller_than_simpler_models_make_them_and_fast():
    """Token files took 1.0 times the earlier coder's time, as that wrote them."""
    texts = pq.read_table(f"{DATA}/documents.parquet", columns=["text"])["text"].combine_chunks()
    ids, _ = tokens.byte_bpe_ids(texts, P.path("byte_bpe_50k.json"))
    blocks = [ids[i : i + strand_coder.BLOCK] for i in range(0, 12 * strand_coder.BLOCK, strand_coder.BLOCK)]
    code = strand_coder.encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(blocks, strand_coder.decode_blocks(code), strict=True))
    own, raw = sum(map(len, code)), [b.astype("<u2").tobytes() for b in blocks]
    assert own < 0.99 * sum(map(_adaptive_order_0, (b.tolist() for b in blocks)))
    assert own < sum(len(lzma.compress(b)) for b in raw) and own < sum(len(zlib.compress(b, 9)) for b in raw)

    def seconds(encode, decode):
        t = time.process_time()
        decode(encode(blocks * 8))
        return time.process_time() - t

    used = seconds(token_output.encode_blocks, token_output.decode_blocks)
    assert used < 0.6 * seconds(range_coder.encode_blocks, range_coder.decode_blocks)


def test_strands_adapt_to_text_that_repeats():
    rng = np.random.default_rng(5)
    block = np.tile(rng.integers(0, strand_coder.VOCABULARY, 61), 67)
    assert len(strand_coder.encode_blocks([block])[0]) < 0.2 * _adaptive_order_0(block.tolist())


def test_altered_strands_are_refused():
    code = strand_coder.encode_blocks([np.arange(500)])[0]
    for bad in (code[:-2], code + b"xx", b"", b"x" * 100, code[:300] + bytes([code[300] ^ 1]) + code[301:]):
        with pytest.raises(ValueError):
            strand_coder.decode_blocks([bad])
    for at in range(0, len(code), 7):  # a bit of a strand's last word may be free
        try:
            assert strand_coder.decode_blocks([code[:at] + bytes([code[at] ^ 128]) + code[at + 1 :]])[0].tolist() == list(range(500))
        except ValueError:
            pass
    for bad in (np.array([strand_coder.VOCABULARY]), np.zeros(strand_coder.BLOCK + 1, np.int64)):
        with pytest.raises(ValueError):
            strand_coder.encode_blocks([bad])


def test_checksums_join():
    a, b = b"some bytes", bytes(range(200))
    assert token_output.crc_of_both(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert token_output.crc_of_both(zlib.crc32(a), 0, 0) == zlib.crc32(a)


def test_token_files(docs, rows, nothing):
    found = token_output.token_round_trip(docs, P.path("byte_bpe_50k.json")).collect()
    encode, start, want = _library("byte_bpe_50k.json"), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0], (r[1] or "").encode())):
        ids = np.array([*encode(t), 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, found)) == sorted(want)
    assert token_output.token_round_trip(nothing, P.path("byte_bpe_50k.json")).count() == 0
    no_id = token_output.token_round_trip(docs.withColumn("doc_id", F.lit(None).cast("long")), P.path("byte_bpe_50k.json")).collect()
    assert len(no_id) == len(rows) and sorted(r.n_tokens for r in no_id) == sorted(r.n_tokens for r in found)


@pytest.mark.parametrize("name, ids", [("byte_bpe_50k.json", tokens.byte_bpe_ids), ("word_bpe_49k.json", tokens.word_bpe_ids)])
def test_special_tokens_in_texts(name, ids):
    """As the library's plain call gives them."""
    library = Tokenizer.from_file(P.path(name))
    texts = ["a<|endoftext|>b", "One <|endoftext|> two", "x  <|startoftext|>\n<|ENDOFTEXT|> Y", "<|endoftext|>", "no <| token |> here", "plain Text", None, "<|endoftext|><|endoftext|> end ", "plain  text"]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    flat, sizes = ids(pa.array(texts), P.path(name))
    ends = np.cumsum(sizes)
    assert [flat[e - n : e].tolist() for e, n in zip(ends, sizes, strict=True)] == want
    assert library.token_to_id("<|endoftext|>") in want[0]


def test_pieces_that_a_worker_keeps(monkeypatch):
    """Known, new and half-known pieces over batches, with room for all, for few and for none."""
    path, library = P.path("byte_bpe_50k.json"), _library("byte_bpe_50k.json")
    batches = [["the cat, the cat; sat", "", None, "été x9y the, end.", "a\nb  c"], ["the cat, (the) dogs' été; sat.", "the<|endoftext|>cat", "日本 the cat"], [""], ["new words only", "the cat, the cat; sat", "a\nb  c x9y"]]
    for most, parts in ((600_000, 50_000), (5, 2), (0, 0)):
        monkeypatch.setattr(tokens, "_stores", {})
        monkeypatch.setattr(tokens, "PARTS", parts)
        monkeypatch.setattr(tokens._stored, "__defaults__", (most,))
        for texts in batches:
            flat, sizes = tokens.byte_bpe_ids(pa.array(texts, pa.string()), path)
            ends = np.cumsum(sizes)
            assert [flat[e - n : e].tolist() for e, n in zip(ends, sizes, strict=True)] == [library(t) for t in texts]
            assert most == 0 or len(tokens._stores[path].texts) <= most


def test_merge_replay(docs, rows, nothing):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe_replay.bpe_round_trip(docs, path, P.PATTERN).collect())) == want
    assert bpe_replay.bpe_round_trip(nothing, path, P.PATTERN).count() == 0


@given(st.lists(st.text(max_size=30), max_size=8))
@settings(max_examples=30, deadline=None)
def test_replay_of_any_words(words):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    model = bpe_replay.replay(path)
    library = tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=model.ranks, special_tokens={})
    raw = [w.encode("utf-8", "ignore") for w in words]
    got = model.encode(raw)
    assert got == [library.encode_ordinary(w.decode()) for w in raw]
    assert [model.decode(g) for g in got] == raw


@given(st.lists(st.integers(0, 2**20) | st.integers(250, 260), max_size=40), st.lists(st.binary(max_size=9), max_size=20))
@settings(max_examples=60, deadline=None)
def test_packed_arrays(numbers, words):
    x = np.array(numbers, np.int64)
    assert packed.unpacked_ranks(packed.packed_ranks(x)).tolist() == numbers
    assert packed.unpacked(packed.packed(x.astype(np.uint32)), np.uint32).tolist() == numbers
    assert packed.unpacked_words(packed.packed_words(words)) == words


def test_replay_where_a_merge_makes_a_lower_rank():
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 300, b"ab": 500, b"bc": 700, b"abcab": 310, b"aa": 900, b"aaa": 320}
    library = tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
    words = [b"abc", b"abcabc", b"aaaa", b"aaaaaaa", b"xabab", b"", b"bcab"]
    assert bpe_replay.MergeReplay(ranks).encode(words) == [library.encode_ordinary(w.decode()) if w else [] for w in words]


def _check_places(found):
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    return len(by)


def test_packing(docs, rows, nothing):
    found = packing.pack_documents(docs, P.path("word_bpe_49k.json")).collect()
    encode, want = _library("word_bpe_49k.json"), Counter()
    for i, t in rows:
        ids = np.array([*encode(t), 0], "<u4")
        for k, s in enumerate(range(0, len(ids), 2048)):
            want[i, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    assert _check_places(found) == -(-sum(k[3] * n for k, n in want.items()) // 2048)
    assert packing.pack_documents(nothing, P.path("word_bpe_49k.json")).count() == 0


@given(st.lists(st.tuples(st.integers(1, 30), st.booleans(), st.integers(1, 9)), max_size=30))
@settings(max_examples=200, deadline=None)
def test_sweep(rows):
    """Every match fits; no document that waits fits in a gap that is left; each gap gets the largest that waits below it."""
    runs = sorted((size, int(gap), n) for size, gap, n in rows)
    taken = Counter()
    for m in packing.sweep(runs):
        gap, doc = runs[m.gap_run], runs[m.doc_run]
        assert gap[1] == packing.GAP and doc[1] == packing.DOC and m.per * doc[0] <= gap[0]
        assert m.gap == taken[m.gap_run] and m.doc == taken[m.doc_run]
        assert all(taken[k] == runs[k][2] for k in range(m.doc_run + 1, m.gap_run) if runs[k][1] == packing.DOC)
        taken[m.gap_run] += m.gaps
        taken[m.doc_run] += m.gaps * m.per
    left = [(size, kind) for k, (size, kind, n) in enumerate(runs) if taken[k] < n]
    assert all(taken[k] <= n for k, (_, _, n) in enumerate(runs))
    assert not any(d[1] == packing.DOC and g[1] == packing.GAP and d[0] <= g[0] for d in left for g in left)


def _plain_best_fit(sizes, capacity):
    """Longest first, each into the fullest sequence that holds it."""
    gaps = []
    for size in sorted(sizes, reverse=True):
        at = bisect.bisect_left(gaps, size)
        bisect.insort(gaps, (gaps.pop(at) if at < len(gaps) else capacity) - size)
    return len(gaps)


@pytest.mark.parametrize("seed, low, high, n", [(1, 1, 64, 900), (2, 20, 40, 500), (3, 33, 64, 200), (4, 1, 4, 700), (5, 21, 21, 100)])
def test_places_against_plain_best_fit(spark, seed, low, high, n):
    sizes = np.random.default_rng(seed).integers(low, high + 1, n).tolist()
    docs = spark.createDataFrame(list(enumerate(sizes)), "id long, size long").repartition(3)
    found = packing.place(docs, 64).collect()
    assert sorted(r.id for r in found) == list(range(n))
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, sizes[r.id]))
    for places in by.values():
        end = 0
        for offset, size in sorted(places):
            assert offset == end
            end += size
        assert end <= 64
    assert len(by) <= 1.04 * _plain_best_fit(sizes, 64) + 1
    with pytest.raises(ValueError):
        packing.place(docs, 3 if high > 3 else 2)


def test_pack_carries_columns(spark):
    df = spark.createDataFrame([(i % 7 + 1, None, "x", 3) for i in range(100)], "length long, _row string, _part string, sequence_id int").repartition(2)
    found = packing.pack(df)
    assert found.columns == ["length", "_row", "_part", "sequence_id", "offset"]
    assert _check_places(found.collect()) == 1


@pytest.mark.parametrize("name, ids", [("byte_bpe_50k.json", tokens.byte_bpe_ids), ("word_bpe_49k.json", tokens.word_bpe_ids)])
def test_words_beside_signs_are_asked_for_once(monkeypatch, name, ids):
    """Words take the short way to the tokenizer's model, whatever signs follow them; only signs go to the library."""
    asked, library = [], tokens._library
    monkeypatch.setattr(tokens, "_library", lambda path, pieces: asked.extend(pieces) or library(path, pieces))
    monkeypatch.setattr(tokens, "_caches", {})
    words = ["sign" + "".join(chr(97 + i // 26**k % 26) for k in range(3)) + "é" for i in range(900)]
    texts = [f"One {w}, two {w}. {w.title()}\n{w}; ({w}) {w}!" for w in words]
    flat, sizes = ids(pa.array(texts), P.path(name))
    encode = _shared(name)
    assert flat.tolist() == [x for t in texts for x in encode(t)] and len(sizes) == 900
    assert len(asked) < 20 and not any(c.isalpha() for x in asked for c in x)


@pytest.mark.parametrize("name, ids", [("byte_bpe_50k.json", tokens.byte_bpe_ids), ("word_bpe_49k.json", tokens.word_bpe_ids)])
@given(st.lists(st.text(st.sampled_from("aZéÉßÿ×ªñ́İσΣ中19².,-'s\n\t \xa0%<|(_/\rĠ")), max_size=20))
@settings(max_examples=60, deadline=None)
def test_ids_of_texts_cut_at_signs(name, ids, texts):
    flat, sizes = ids(pa.array(texts, pa.string()), P.path(name))
    encode = _shared(name)
    want = [encode(t) for t in texts]
    assert sizes.tolist() == list(map(len, want)) and flat.tolist() == [x for w in want for x in w]


@functools.cache
def _shared(name):
    return _library(name)
