"""A context-mixing range coder for token ids whose model adapts in rounds, for many strands of many blocks abreast.

A block is coded from nothing but its own ids, so it can be decoded by itself. Its ids are cut into ``STRANDS`` strands
of equal length, each with a code of its own, and one model that all strands of the block share. Each step handles the
next id of every strand of every block with numpy.

Predictions are mixed as weighted frequencies on one line:

* order 2 and order 1: the id that last followed the same two ids or one id in the block, and how sure that is; learned
  after each step. Where both orders name one id, it has one weight;
* order 0: how often each id was used in the block so far, counted anew in each round;
* the end of the line stands for ids not counted yet. These are coded by a fixed prior, which falls with the id, as low
  ids are frequent ones, and lie at the head of their strand.

Weights adapt in each round, for each pair of confidences, to how often the predictions came true. A round ends after
each half more ids. The coder's range has up to 48 bits and puts out 16-bit words, all whole numbers in double
precision; carries are added at the end.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from . import range_coder
from .range_coder import BLOCK, VOCABULARY

#: Strands of a block, slots of each order's contexts.
STRANDS, SLOTS = 16, 4096
#: Blocks that are coded abreast; each takes about 0.7 MB.
ABREAST = 256
#: Head of a block: magic, ids, crc32 of the ids as little-endian 32-bit numbers. Then for each strand its new ids and its words.
HEAD = struct.Struct("<4sII")
SIZES = struct.Struct(f"<{2 * STRANDS}H")
MAGIC = b"DLT3"

_SURE = 3  # the highest confidence
_CONTEXTS = 2 * (_SURE + 1) ** 2
_ONE = 1 << 13  # about the weight of all of order 0
_MOST = 1 << 15  # the most that both predictions weigh
_FADE, _FADE_NEW = 0.8, 0.3  # how fast weights and the share of new ids forget, in each round
_ABREAST_STEPS = 16  # steps whose stretches are reckoned at once
_FULL, _LEAST, _WORD = 2.0**48, 2.0**32, 2.0**16
#: The prior's classes: first id of each, weight of one id as a shift, where they begin on the line.
_FIRST = np.array([0, 600, 1800, 4200, 9000, 18600, 37800, VOCABULARY])
_SHIFT = np.arange(6, -1, -1)
_BEGIN = np.concatenate([[0], np.cumsum(np.diff(_FIRST) << _SHIFT)])


def _rounds(steps: int) -> list[tuple[int, int]]:
    bounds, at = [0], 1
    while at < steps:
        bounds.append(at)
        at += max(1, at // 2)
    return list(zip(bounds, [*bounds[1:], steps], strict=True))


class _Model:
    """What both coder and decoder know of all blocks; lanes are the strands of one block after those of another."""

    def __init__(self, blocks: int):
        self.blocks, self.block = blocks, np.repeat(np.arange(blocks), STRANDS)
        self.tables = np.stack([self.block * SLOTS, (blocks + self.block) * SLOTS]).astype(np.int32)
        # an entry holds the predicted id and, in its lowest two bits, the confidence
        self.guess = np.zeros(2 * blocks * SLOTS, np.int32)
        self.right = np.tile([0.3, 0.2, 1.0], (blocks, _CONTEXTS, 1))
        self.new, self.old = np.ones(blocks), np.ones(blocks)

    def places(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Where the contexts' entries are, those of order 2 first."""
        at = np.empty((2, len(one)), np.int32)
        np.multiply(one, 40503, out=at[1])
        np.multiply(two, 36061, out=at[0])
        at[0] += at[1]
        at >>= 4
        at &= SLOTS - 1
        at += self.tables
        return at.astype(np.int64)

    def learn(self, at: np.ndarray, e: np.ndarray, p: np.ndarray, sure: np.ndarray, ids: np.ndarray) -> None:
        hit = e + 1
        np.minimum(hit, e | _SURE, out=hit)
        self.guess[at] = np.where(p == ids, hit, np.where(sure > 1, e - sure + 1, ids << 2))

    def begin_round(self, n: int) -> None:
        """The weights for the next ids, of which ``n`` in each block are counted."""
        self.shift = (_ONE // n).bit_length() - 1 if n else 0
        self.all = n << self.shift
        # order 0 and the end of the line, block by block
        self.escape = np.clip(self.all * self.new / self.old, 1, _ONE).astype(np.int64)
        rest = (self.all + self.escape)[:, None, None]
        w = self.right[:, :, :2] * (rest / np.maximum(self.right[:, :, 2:], 0.02))
        w *= np.minimum(1.0, (_MOST - 2) / np.maximum(w.sum(axis=2, keepdims=True), 1.0))
        w = w.astype(np.int64) + 1
        w[:, _CONTEXTS // 2 :, 1] = 0  # both orders name one id
        self.weights = (w[:, :, 0] << 16 | w[:, :, 1]).ravel()

    def end_round(self, context: np.ndarray, kind: np.ndarray) -> None:
        """``context`` counts from the first block's on; ``kind``: predicted by order 2, by order 1, counted, new."""
        found = np.bincount((context << 2 | kind).ravel(), minlength=self.blocks * _CONTEXTS * 4).reshape(self.blocks, _CONTEXTS, 4)
        self.right *= _FADE
        self.right[:, :, :2] += found[:, :, :2]
        self.right[:, :, 2] += found[:, :, 2] + found[:, :, 3]
        of_kind = found.sum(axis=1)
        self.new = self.new * _FADE_NEW + of_kind[:, 3]
        self.old = self.old * _FADE_NEW + np.maximum(of_kind[:, 2], 0.05)

    def contexts(self, p: np.ndarray, sure: np.ndarray) -> np.ndarray:
        context = sure[0] << 2
        context |= sure[1]
        context |= (p[0] == p[1]).astype(np.int32) << 4
        return context + self.block * _CONTEXTS


def _counted(done: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ids so far, one row for each block: the sorted ids; where another id begins; how many are equal from there."""
    flat = np.sort(done, axis=1, kind="stable").ravel()  # by digits, as these are 16 bits
    begins = np.ones(len(flat), bool)
    np.not_equal(flat[1:], flat[:-1], out=begins[1:])
    begins[:: done.shape[1]] = True
    at = np.flatnonzero(begins)
    return flat, at, np.diff(at, append=len(flat))


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """A block of bytes for each array of ids (below ``VOCABULARY``, ``BLOCK`` at most)."""
    if any(len(b) > BLOCK or len(b) and (b.min() < 0 or b.max() >= VOCABULARY) for b in blocks):
        raise ValueError(f"a block has {BLOCK} ids at most, from 0 to {VOCABULARY - 1}")
    out: list[bytes] = [b""] * len(blocks)
    order = sorted(range(len(blocks)), key=lambda k: -len(blocks[k]))
    for at in range(0, len(order), ABREAST):
        some = order[at : at + ABREAST]
        for k, code in zip(some, _encode([blocks[k] for k in some]), strict=True):
            out[k] = code
    return out


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Longer blocks come first. Strands are filled up with zeros; what is behind a block's own steps is not coded."""
    own = [-(-len(b) // STRANDS) for b in blocks]
    steps, lanes = own[0], len(blocks) * STRANDS
    ids = np.zeros((len(blocks), STRANDS, steps), np.uint16)
    for k, b in enumerate(blocks):
        padded = np.zeros(own[k] * STRANDS, np.uint16)
        padded[: len(b)] = b
        ids[k, :, : own[k]] = padded.reshape(STRANDS, own[k])
    x = np.ascontiguousarray(ids.reshape(lanes, steps).T).astype(np.int32)
    begin, length, total, kind = _lines(ids, x, steps)
    live = STRANDS * np.searchsorted(-np.array(own), -np.arange(steps), side="left")  # lanes with ids left, at each step

    kind[np.arange(steps)[:, None] >= np.repeat(own, STRANDS)] = 0
    n_new = (kind == 3).sum(axis=0)
    order = np.argsort(-n_new, kind="stable")
    row, lane = np.nonzero(kind.T == 3)[::-1]
    new = np.zeros((n_new.max(initial=0), lanes), np.int64)
    new[np.arange(len(row)) - (np.cumsum(n_new) - n_new)[lane], lane] = x[row, lane]
    new = new[:, order]
    of = np.searchsorted(_FIRST, new, side="right") - 1
    new_begin, new_length = (_BEGIN[of] + (new - _FIRST[of] << _SHIFT[of])).astype(float), (1 << _SHIFT[of]).astype(float)

    width = int(n_new.max(initial=0)) * 2 + steps + 2
    words = np.zeros(lanes * width, np.int32)
    low, wide, at = np.zeros(lanes), np.full(lanes, _FULL), order * width

    def put(low: np.ndarray, wide: np.ndarray, at: np.ndarray) -> None:
        word = np.floor(low * (1 / _LEAST))
        words[at] = word
        short = wide < _LEAST
        low -= word * (short * _LEAST)
        scale = short * (_WORD - 1)
        scale += 1
        low *= scale
        wide *= scale
        at += short

    for j, k in enumerate(np.searchsorted(-n_new[order], -np.arange(len(new)), side="left").tolist()):
        part = np.floor(wide[:k] / float(_BEGIN[-1]))
        low[:k] += part * new_begin[j, :k]
        wide[:k] = part * new_length[j, :k]
        put(low[:k], wide[:k], at[:k])
        put(low[:k], wide[:k], at[:k])
    back = np.argsort(order)
    low, wide, at = low[back], wide[back], at[back]
    for t, k in enumerate(live.tolist()):
        part = np.floor(wide[:k] / total[t, :k])
        low[:k] += part * begin[t, :k]
        np.multiply(part, length[t, :k], out=wide[:k])
        put(low[:k], wide[:k], at[:k])
    words[at] = np.ceil(low / _LEAST)
    sizes = at - np.arange(lanes) * width + 1
    words = words.reshape(lanes, width)[:, : sizes.max(initial=0)]
    words = np.where(np.arange(words.shape[1]) < sizes[:, None], words, 0)
    while (carried := words >> 16).any():  # belongs to the word before
        words &= 0xFFFF
        words[:, :-1] += carried[:, 1:]
    words = words.astype(">u2")
    codes = [words[k, :size].tobytes() for k, size in enumerate(sizes.tolist())]
    heads = np.stack([n_new, sizes], axis=1).reshape(len(blocks), -1).tolist()
    return [HEAD.pack(MAGIC, len(b), zlib.crc32(np.asarray(b).astype("<u4").tobytes())) + SIZES.pack(*heads[k]) + b"".join(codes[k * STRANDS : (k + 1) * STRANDS]) for k, b in enumerate(blocks)]


def _lines(ids: np.ndarray, x: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each step and lane: begin and length of the id's stretch, the line's length, and what kind of stretch it is."""
    model, lanes = _Model(len(ids)), x.shape[1]
    known = model.block * VOCABULARY
    # of each id the place of its first copy among the sorted ids so far, and its count in the lowest 14 bits
    found = np.zeros(len(ids) * VOCABULARY, np.int32)
    begin, length, total, kind = (np.zeros((steps, lanes), np.int32) for _ in range(4))
    one, two = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
    for a, b in _rounds(steps):
        if a:
            flat, at, n = _counted(ids[:, :, :a].reshape(len(ids), -1))
            in_block = at // (STRANDS * a)
            found[in_block * VOCABULARY + flat[at]] = (at - in_block * (STRANDS * a) << 14) + n
        model.begin_round(STRANDS * a)
        contexts, escape = np.empty((b - a, lanes), np.int64), model.escape[model.block].astype(np.int32)
        for c in range(a, b, _ABREAST_STEPS):
            d = min(b, c + _ABREAST_STEPS)
            es = np.empty((2, d - c, lanes), np.int32)
            for t in range(c, d):
                at = model.places(one, two)
                e = es[:, t - c] = model.guess.take(at, mode="clip")
                model.learn(at, e, e >> 2, e & _SURE, x[t])
                one, two = x[t], one
            now, p, sure = x[c:d], es >> 2, es & _SURE
            context = contexts[c - a : d - a] = model.contexts(p, sure)
            w = model.weights.take(context, mode="clip").astype(np.int32)  # below 2^31
            own = found.take(known + now, mode="clip")
            second, first = w >> 16, w & 0xFFFF
            both, seen, hit = second + first, own > 0, p == now
            k = kind[c:d]
            k[:] = 3
            k -= seen
            begin[c:d] = both + np.where(seen, own >> 14 << model.shift, model.all)
            length[c:d] = np.where(seen, (own & 0x3FFF) << model.shift, escape)
            for is_own, name, start, size in ((hit[1], 1, second, first), (hit[0], 0, 0, second)):
                np.copyto(k, name, where=is_own)
                np.copyto(begin[c:d], start, where=is_own)
                np.copyto(length[c:d], size, where=is_own)
            np.add(both, escape + model.all, out=total[c:d], casting="unsafe")
        model.end_round(contexts, kind[a:b])
    return begin, length, total, kind


def decode_blocks(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block, also of those that ``range_coder`` wrote; an altered or torn block raises ValueError."""
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(blocks)
    earlier = [b[:4] == range_coder.MAGIC for b in blocks]
    for own, most, decode in ((True, range_coder.LANES, range_coder.decode_blocks), (False, ABREAST, _decode)):
        order = [k for k, x in enumerate(earlier) if x == own]
        for at in range(0, len(order), most):
            some = order[at : at + most]
            for k, ids in zip(some, decode([blocks[k] for k in some]), strict=True):
                out[k] = ids
    return out


def _decode(blocks: list[bytes]) -> list[np.ndarray]:
    start = HEAD.size + SIZES.size
    if any(len(b) < start for b in blocks):
        raise ValueError("not a block, or torn")
    heads = [HEAD.unpack_from(b) for b in blocks]
    n_new, sizes = np.array([SIZES.unpack_from(b, HEAD.size) for b in blocks], np.int64).reshape(-1, 2).T
    own = [-(-h[1] // STRANDS) for h in heads]
    lanes, steps = len(blocks) * STRANDS, max(own, default=0)
    sums = sizes.reshape(-1, STRANDS).sum(axis=1).tolist()
    if any(h[0] != MAGIC or h[1] > BLOCK or len(b) != start + 2 * s for h, b, s in zip(heads, blocks, sums, strict=True)) or (n_new > np.repeat(own, STRANDS)).any():
        raise ValueError("not a block, or torn")
    width = int(sizes.max(initial=0)) + 4
    words = np.zeros((lanes, width), np.uint16)
    words[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(b[start:] for b in blocks), ">u2")
    far, wide = words[:, 0] * _LEAST + words[:, 1] * _WORD + words[:, 2], np.full(lanes, _FULL)  # how far the code lies above the range's low end
    words, next_word = words.ravel(), np.arange(lanes) * width + 3

    def get(far: np.ndarray, wide: np.ndarray, at: np.ndarray) -> None:
        short = wide < _LEAST
        scale = short * (_WORD - 1)
        scale += 1
        wide *= scale
        far *= scale
        far += words.take(at, mode="clip") * short
        at += short

    order = np.argsort(-n_new, kind="stable")
    new = np.zeros((int(n_new.max(initial=0)) + 1, lanes), np.int32)
    far, wide, next_word = far[order], wide[order], next_word[order]
    for j, k in enumerate(np.searchsorted(-n_new[order], -np.arange(len(new) - 1), side="left").tolist()):
        part = np.floor(wide[:k] / float(_BEGIN[-1]))
        v = np.minimum(far[:k] / part, _BEGIN[-1] - 1).astype(np.int64)
        of = np.searchsorted(_BEGIN, v, side="right") - 1
        shift = _SHIFT[of]
        new[j, order[:k]] = _FIRST[of] + (v - _BEGIN[of] >> shift)
        far[:k] -= part * (v >> shift << shift)
        wide[:k] = part * (1 << shift)
        get(far[:k], wide[:k], next_word[:k])
        get(far[:k], wide[:k], next_word[:k])
    back = np.argsort(order)
    far, wide, next_word = far[back], wide[back], next_word[back]

    model, lane = _Model(len(blocks)), np.arange(lanes)
    new, next_new = new.ravel(), lane.copy()
    ids = np.zeros((steps, lanes), np.uint16)
    one, two = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
    begins, lengths, named = np.zeros((4, lanes)), np.zeros((4, lanes)), np.zeros((4, lanes), np.int32)
    for a, b in _rounds(steps):
        n = STRANDS * a
        slots = np.zeros(len(blocks), np.int64)
        if a:
            # of each place among the sorted ids the id, where its copies begin, and their number
            flat, at, count = _counted(ids[:a].reshape(a, len(blocks), STRANDS).swapaxes(0, 1).reshape(len(blocks), n))
            slots = np.repeat(flat[at].astype(np.int64) << 32 | at % n << 16 | count, count)
        model.begin_round(n)
        first, shift, last = model.block * max(n, 1), model.shift, max(n, 1) - 1
        escape = model.escape[model.block]
        rest = escape + model.all
        lengths[3] = escape
        contexts, kinds = np.empty((b - a, lanes), np.int64), np.empty((b - a, lanes), np.int64)
        for t in range(a, b):
            at = model.places(one, two)
            e = model.guess.take(at, mode="clip")
            p, sure = e >> 2, e & _SURE
            context = contexts[t - a] = model.contexts(p, sure)
            w = model.weights.take(context, mode="clip")
            second = w >> 16
            w &= 0xFFFF
            both = second + w
            total = both + rest
            part = np.floor(wide / total)
            v = np.minimum(far / part, total - 1).astype(np.int64)
            v -= both
            kind = kinds[t - a]
            np.add(v >= -w, v >= 0, out=kind, dtype=np.int64)
            kind += v >= model.all
            v >>= shift
            slot = slots.take(first + np.clip(v, 0, last, out=v), mode="clip")
            begins[1], lengths[0], lengths[1] = second, second, w
            np.add(both, (slot >> 16 & 0xFFFF) << shift, out=begins[2])
            np.add(both, model.all, out=begins[3])
            lengths[2] = (slot & 0xFFFF) << shift
            named[:2], named[2], named[3] = p, slot >> 32, new.take(next_new, mode="clip")
            chosen = kind * lanes
            chosen += lane
            far -= part * begins.take(chosen)
            np.multiply(part, lengths.take(chosen), out=wide)
            get(far, wide, next_word)
            ids[t] = now = named.take(chosen)
            next_new += (kind == 3) * lanes
            model.learn(at, e, p, sure, now)
            one, two = now, one
        model.end_round(contexts, kinds)
    out = []
    for k, h in enumerate(heads):
        out.append(ids[: own[k], k * STRANDS : (k + 1) * STRANDS].T.ravel()[: h[1]].astype(np.uint32))
    if any(zlib.crc32(i.astype("<u4").tobytes()) != h[2] for i, h in zip(out, heads, strict=True)):
        raise ValueError("a block's ids do not match its checksum")
    return out
