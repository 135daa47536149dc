"""Token ids of whole texts in Arrow batches: each distinct piece of a batch is encoded once by the tokenizers library."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once.
TEXT_BYTES = 8 << 20
#: A white-space character before a space: such texts are not cut at their spaces.
_RUNS = "[\\s\x0b\x1c-\x1f\u0085   -     　] "


def slices(batch: pa.RecordBatch, column: int, most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most ``most`` bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = 0
    while at < len(sizes):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most, side="right")))
        yield batch.slice(at, n)
        at += n
        pa.default_memory_pool().release_unused()  # workers are used again, beside others


#: Pieces whose ids a Python worker keeps for its next batches, at most.
CACHED = 200_000
_caches: dict[str, dict[str, bytes]] = {}
_MARK = "<|endoftext|>"
#: All special tokens begin so. A text with this is one piece as it is, since the library looks for them in the whole text.
_SPECIAL = "<|"


@lru_cache(maxsize=8)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


def _library(path: str, pieces: list[str]) -> list[bytes]:
    """The ids of each piece as 32-bit numbers. Pieces go to the library in long texts, an end mark between them; those that may have special tokens go one by one."""
    out: list[bytes] = []
    tokenizer = _tokenizer(path)
    mark = tokenizer.token_to_id(_MARK)
    for i in range(0, len(pieces), 1000):
        some = pieces[i : i + 1000]
        if any(_SPECIAL in x for x in some):
            out += [np.array(x.ids, np.uint32).tobytes() for x in tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            continue
        ids = np.array(tokenizer.encode_batch_fast([_MARK.join(some)], add_special_tokens=False)[0].ids, np.uint32)
        ends = (np.flatnonzero(ids == mark) * 4).tolist()
        raw = ids.tobytes()
        out += [raw[a:b] for a, b in zip([0, *(e + 4 for e in ends)], [*ends, len(raw)], strict=True)]
    return out


#: Letters that are one code point in every normal form, and signs that no contraction begins with.
_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", "0-9.,;:!?()%&*#$/_\\-"
_WORD = f"^ ?[{_LETTERS}]+$"
#: A piece of these alone, without white space that a split could share out in another way.
_PLAIN = f"^ ?[{_LETTERS}{_SIGNS}]+(?:\\n[{_LETTERS}{_SIGNS}]+)*\\n?$"
_PARTS = re.compile(f" ?[{_LETTERS}]+| ?[^{_LETTERS} ]+").findall


class _Words(NamedTuple):
    """A tokenizer's model for words of ``_LETTERS`` alone; whether their case is folded first; bytes of each id's text."""

    model: Any
    folded: bool
    lengths: np.ndarray


@lru_cache(maxsize=8)
def _words(path: str) -> _Words | None:
    """None where the tokenizer does not set such words apart."""
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = _tokenizer(path)
    letters, signs = ("".join(c for c in map(chr, range(256)) if re.fullmatch(f"[{x}]", c)) for x in (_LETTERS, _SIGNS))
    normal = tokenizer.normalizer.normalize_str if tokenizer.normalizer else str
    folded = normal(letters) == letters.lower()
    letters = letters.lower() if folded else letters
    cut = tokenizer.pre_tokenizer.pre_tokenize_str if tokenizer.pre_tokenizer else list
    model = Tokenizer(tokenizer.model)
    model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit("\n"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None) or ""
    lengths = np.zeros(model.get_vocab_size() + 1, np.int64)
    for text, i in model.get_vocab().items():
        lengths[i] = len(text.removesuffix(suffix))  # one sign for each byte
    same = all(tokenizer.encode(x, add_special_tokens=False).ids == model.encode(x, add_special_tokens=False).ids and lengths[model.encode(x).ids].sum() == len(x.encode()) for x in (letters, *letters))
    apart = same and normal(signs) == signs and all(len(cut(f"a{x}b")) == 3 for x in signs) and len(cut("a\nb")) > 1 and len(cut(letters)) == 1
    return _Words(model, folded, lengths) if apart else None


def _word_ids(words: _Words, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words behind one another, and the number of each, from the bytes that each id stands for."""
    found = [np.zeros(0, np.uint32)]
    for i in range(0, len(pieces), 200):  # longer texts take longer for each word
        found.append(np.array(words.model.encode_batch_fast(["\n".join(pieces[i : i + 200])], add_special_tokens=False)[0].ids, np.uint32))
    flat = np.concatenate(found)
    ends = np.searchsorted(np.cumsum(words.lengths[flat]), np.cumsum(pc.binary_length(pa.array(pieces, pa.string())).to_numpy().astype(np.int64))) + 1
    if len(ends) and ends[-1] != len(flat):
        raise ValueError("the words' ids do not make up the words")
    return flat, np.diff(ends, prepend=0)


def _parts(pieces: pa.Array, words: _Words | None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """What the library is asked for, distinct; which of these each piece is made of, piece by piece; and of how many.

    Plain pieces are cut between letters and signs, as the tokenizer itself cuts them first.
    """
    if words is None:
        return pieces, np.arange(len(pieces)), np.ones(len(pieces), np.int64)
    plain = pc.match_substring_regex(pieces, _PLAIN)
    if words.folded:
        pieces = pc.if_else(plain, pc.utf8_lower(pieces), pieces)
    mixed = np.flatnonzero(pc.and_not(plain, pc.match_substring_regex(pieces, _WORD)).to_numpy(zero_copy_only=False))
    cut = list(map(_PARTS, pieces.take(pa.array(mixed)).to_pylist()))
    whole = np.ones(len(pieces), bool)
    whole[mixed] = False
    sizes = np.ones(len(pieces), np.int64)
    sizes[mixed] = np.fromiter(map(len, cut), np.int64, len(cut))
    coded = pa.concat_arrays([pieces.filter(pa.array(whole)), pa.array(chain.from_iterable(cut), pa.string())]).dictionary_encode()
    index, of = coded.indices.to_numpy().astype(np.int64), np.repeat(whole, sizes)
    use = np.empty(len(index), np.int64)
    use[of], use[~of] = index[: whole.sum()], index[whole.sum() :]
    return coded.dictionary, use, sizes


def _cached(path: str, pieces: pa.Array, counts: np.ndarray, most: int = CACHED) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces behind one another, and the number of each. Parts that occur more than once are kept for later batches.

    Words go to the tokenizer's model past its normal forms and splits, which leave them as they are; all else goes
    to the library as it is.
    """
    cache, words = _caches.setdefault(path, {}), _words(path)
    parts, use, made_of = _parts(pieces, words)
    uses = np.bincount(use, np.repeat(counts, made_of), len(parts))
    texts = parts.to_pylist()
    found = list(map(cache.get, texts))
    known = np.fromiter((x is not None for x in found), bool, len(found))
    word = ~known & pc.match_substring_regex(parts, _WORD).to_numpy(zero_copy_only=False) if words else np.zeros(len(parts), bool)
    rest = np.flatnonzero(~known & ~word).tolist()
    for i, x in zip(rest, _library(path, [texts[i] for i in rest]), strict=True):
        found[i] = x
    at = np.flatnonzero(word)
    own, n = _word_ids(words, [texts[i] for i in at.tolist()]) if words else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    ends = np.cumsum(n)
    keep = np.flatnonzero(uses[at] > 1)[: most - len(cache)] if len(cache) < most else at[:0]
    raw = memoryview(own.tobytes())
    for i, a, b in zip(at[keep].tolist(), (ends - n)[keep].tolist(), ends[keep].tolist(), strict=True):
        cache[texts[i]] = bytes(raw[4 * a : 4 * b])
    for i in rest:
        if uses[i] > 1 and len(cache) < most:
            cache[texts[i]] = found[i]
    others = [x for x in found if x is not None]
    sizes = np.zeros(len(parts), np.int64)
    sizes[at], sizes[~word] = n, np.fromiter(map(len, others), np.int64, len(others)) // 4
    starts = np.zeros(len(parts), np.int64)
    starts[at] = ends - n
    starts[~word] = len(own) + np.cumsum(sizes[~word]) - sizes[~word]
    flat = np.concatenate([own, np.frombuffer(b"".join(others), np.uint32)])
    before = np.concatenate([[0], np.cumsum(sizes[use])])
    last = np.cumsum(made_of)
    return gather(flat, starts, sizes, use), before[last] - before[last - made_of]


#: Pieces that a Python worker keeps in columns, at most; those that occur once in a batch fill half of it.
STORED = 600_000
#: Of these, how many a part of a new piece is sought among: the earliest, which are the common ones.
PARTS = 50_000


class _Store(NamedTuple):
    """Distinct pieces, their ids behind one another, and where those of each piece end."""

    texts: pa.Array
    flat: np.ndarray
    ends: np.ndarray


_stores: dict[str, _Store] = {}


def _stored(path: str, pieces: pa.Array, counts: np.ndarray, most: int = STORED) -> tuple[np.ndarray, np.ndarray]:
    """As ``_cached``, for many distinct pieces: known ones are looked up and new ones are kept all at once."""
    store, words = _stores.get(path) or _Store(pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)), _words(path)
    at = pc.fill_null(pc.index_in(pieces, options=pc.SetLookupOptions(value_set=store.texts)), -1).to_numpy()
    fresh = at < 0
    parts, use, made_of = _parts(pieces.filter(pa.array(fresh)), words)
    part_at = pc.fill_null(pc.index_in(parts, options=pc.SetLookupOptions(value_set=store.texts[:PARTS])), -1).to_numpy()
    asked = part_at < 0
    word = asked & pc.match_substring_regex(parts, _WORD).to_numpy(zero_copy_only=False) if words else np.zeros(len(parts), bool)
    rest = asked & ~word
    own, n = _word_ids(words, parts.filter(pa.array(word)).to_pylist()) if words else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    others = _library(path, parts.filter(pa.array(rest)).to_pylist())
    # the store's ids, then those of words, then those of the rest
    flat = np.concatenate([store.flat, own, np.frombuffer(b"".join(others), np.uint32)])
    known = np.diff(store.ends, prepend=0)
    sizes = np.zeros(len(parts), np.int64)
    sizes[~asked], sizes[word], sizes[rest] = known[part_at[~asked]], n, np.fromiter(map(len, others), np.int64, len(others)) // 4
    starts = np.zeros(len(parts), np.int64)
    starts[~asked] = store.ends[part_at[~asked]] - sizes[~asked]
    starts[word] = len(store.flat) + np.cumsum(n) - n
    starts[rest] = len(store.flat) + len(own) + np.cumsum(sizes[rest]) - sizes[rest]
    # the new pieces' ids, behind the store's own
    before, last = np.concatenate([[0], np.cumsum(sizes[use])]), np.cumsum(made_of)
    new_sizes = before[last] - before[last - made_of]
    flat = np.concatenate([store.flat, gather(flat, starts, sizes, use)])
    new_ends = len(store.flat) + np.cumsum(new_sizes)
    out_sizes, out_starts = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
    out_sizes[~fresh], out_sizes[fresh] = known[at[~fresh]], new_sizes
    out_starts[~fresh], out_starts[fresh] = store.ends[at[~fresh]] - out_sizes[~fresh], new_ends - new_sizes
    again = counts[fresh] > 1
    keep = np.concatenate([np.flatnonzero(again)[: max(0, most - len(store.texts))], np.flatnonzero(~again)[: max(0, most // 2 - len(store.texts) - again.sum())]])
    if len(keep):
        kept = pieces.filter(pa.array(fresh)).take(pa.array(keep))
        _stores[path] = _Store(pa.concat_arrays([store.texts, kept]), np.concatenate([store.flat, gather(flat, new_ends - new_sizes, new_sizes, keep)]), np.concatenate([store.ends, len(store.flat) + np.cumsum(new_sizes[keep])]))
    return gather(flat, out_starts, out_sizes, np.arange(len(pieces))), out_sizes


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, use: np.ndarray) -> np.ndarray:
    """The stretches ``use`` of ``flat`` behind one another."""
    n = sizes[use]
    ends = np.cumsum(n)
    at = np.repeat(starts[use] - ends + n, n)
    at += np.arange(len(at))
    return flat[at]


def encode_by_pieces(texts: pa.Array, encode: Callable[[pa.Array, np.ndarray], tuple[np.ndarray, np.ndarray]], keep_spaces: bool, special: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts behind one another, and the number of each; a null text has none.

    No token of these vocabularies reaches over the space before a word, so a text is cut there and
    each distinct piece of the batch is encoded once; a text with ``special`` is one piece. ``keep_spaces``: the space belongs to the piece that
    it precedes; a text with longer white space is then one piece. Else spaces between pieces mean nothing.
    """
    texts = pc.fill_null(texts, "")
    whole = pc.match_substring(texts, special) if special else pa.array(np.zeros(len(texts), bool))
    if not keep_spaces:
        cut = pc.ascii_split_whitespace(texts)
    else:
        whole = pc.or_(whole, pc.match_substring_regex(texts, _RUNS))
        cut = pc.split_pattern(texts, " ")
    if pc.any(whole).as_py():
        cut = pa.array([[t] if w else c for t, w, c in zip(texts.to_pylist(), whole.to_pylist(), cut.to_pylist(), strict=True)], pa.list_(pa.string()))
    bounds = cut.offsets.to_numpy().astype(np.int64)
    words = cut.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    bounds -= bounds[0]
    index, pieces = words.indices.to_numpy(), words.dictionary
    if keep_spaces:
        index = index * 2 + 1  # odd: with the space before it
        index[bounds[:-1]] -= 1
        counts = np.bincount(index, minlength=2 * len(pieces))
        used = np.flatnonzero(counts)
        counts = counts[used]
        place = np.zeros(2 * len(pieces), np.int32)
        place[used] = np.arange(len(used))
        index = place[index]
        pieces = pc.binary_join_element_wise(pa.array(["", " "]).take(pa.array(used % 2)), pieces.take(pa.array(used // 2)), "")
    else:
        counts = np.bincount(index, minlength=len(pieces))
    flat, sizes = encode(pieces, counts)
    starts = np.cumsum(sizes) - sizes
    before = np.concatenate([[0], np.cumsum(sizes[index])])
    return gather(flat, starts, sizes, index), before[bounds[1:]] - before[bounds[:-1]]


def byte_bpe_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """For a tokenizer whose tokens may begin with a space."""
    return encode_by_pieces(texts, lambda pieces, counts: _stored(path, pieces, counts), keep_spaces=True, special=_SPECIAL)


def word_bpe_ids(texts: pa.Array, path: str, cached: int = CACHED) -> tuple[np.ndarray, np.ndarray]:
    """For a tokenizer that drops white space and case. A worker keeps the ids of ``cached`` pieces, which costs no result."""
    texts = pc.if_else(pc.match_substring(texts, _SPECIAL), texts, pc.ascii_lower(texts))  # special tokens have a case
    return encode_by_pieces(texts, lambda pieces, counts: _cached(path, pieces, counts, cached), keep_spaces=False, special=_SPECIAL)
