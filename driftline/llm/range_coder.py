"""An adaptive context-mixing range coder for token ids, many independent blocks abreast.

A block is coded from nothing but its own ids, so it can be decoded by itself. Blocks are coded in step: each
step handles the next id of every block with numpy, so the work of one id is shared by hundreds of blocks.

Predictions are mixed as weighted frequencies on one line, on which every id has one stretch:

* order 0: how often each id was used in the block so far, counted anew after each fifth more ids;
* order 1 and order 2: the id that last followed the same one or two ids, and how often in a row it did.

The id that order 1 or 2 predicts gets its weight on top of its order-0 frequency. Weights adapt, for each pair of
confidences, to how often the predictions came true. The end of the line stands for ids not counted yet; these
are coded by a fixed prior, which falls with the id, as low ids are frequent ones. A 64-bit range coder puts out
32-bit words; carries are added at the end.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Ids of a block, ids that are known, contexts kept for each order.
BLOCK, VOCABULARY, SLOTS = 8192, 50304, 4096
#: Blocks that are coded abreast; each takes about 0.4 MB.
LANES = 512
#: Head of a block: magic, ids, crc32 of the ids as little-endian 32-bit numbers, bytes of code.
HEAD = struct.Struct("<4sIII")
MAGIC = b"DLT2"

_U = np.uint64
_LOW = _U(1 << 32)
_SURE = 7  # the highest confidence
_CONTEXTS = (_SURE + 1) * (_SURE + 2)
_ONE = 1 << 14  # about the weight of all of order 0
_FADE, _FADE_NEW = 0.98, 0.996  # how fast weights and the share of new ids forget
_FIRST = 16  # ids before the first count


def _prior() -> np.ndarray:
    """Cumulated frequencies of ids that are not counted yet."""
    weights = 1 + (1 << 22) // (np.arange(VOCABULARY, dtype=np.int64) + 600)
    return np.concatenate([[0], np.cumsum(weights)])


_PRIOR = _prior()


class _Model:
    """The state of all lanes; coder and decoder take the same steps. Where an array has two rows, the first is of order 2, the second of order 1."""

    def __init__(self, lanes: int):
        self.lanes = np.arange(lanes)
        self.known = self.lanes * VOCABULARY
        self.contexts = np.arange(3 * lanes).reshape(3, lanes) * _CONTEXTS
        self.rows = np.stack([self.lanes * SLOTS, (lanes + self.lanes) * SLOTS])
        # an entry holds the predicted id and, in its lowest three bits, the confidence
        self.guess = np.zeros(2 * lanes * SLOTS, np.int32)
        # how often order 2, order 1 and neither was right
        self.right = np.repeat([0.3, 0.2, 1.0], lanes * _CONTEXTS)
        # of each id the place of its first copy among the sorted ids so far, and its count in the lowest 14 bits
        self.places = np.zeros(lanes * VOCABULARY, np.int32)
        self.sorted, self.counted, self.shift, self.all = np.zeros(lanes, np.uint16), 0, 0, 0
        self.unseen, self.begins = np.array([[0], [1]], np.int32), self.lanes
        self.new, self.old = np.full(lanes, 1.0), np.full(lanes, 1.0)
        self.one, self.two, self.at = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), np.zeros((2, lanes), np.int64)

    def count(self, done: np.ndarray) -> None:
        """Order 0 from the ids so far, one row for each lane."""
        n = self.counted = done.shape[1]
        self.shift = (_ONE // n).bit_length() - 1
        self.all = n << self.shift
        self.unseen, self.begins = np.array([[self.all], [self.all + 1]], np.int32), self.lanes * n
        self.sorted = flat = np.sort(done, axis=1, kind="stable").ravel()  # by digits, as these are 16 bits
        begins = np.ones(len(flat), bool)
        begins[1:] = flat[1:] != flat[:-1]
        begins[::n] = True
        at = np.flatnonzero(begins)
        lane = at // n
        self.places[lane * VOCABULARY + flat[at]] = (at - lane * n << 14) + np.diff(at, append=len(flat))

    def predict(self) -> np.ndarray:
        """The length of the line."""
        one, at = self.one * 40503, self.at
        np.add(one, self.two * 60493, out=at[0])
        np.right_shift(one, 1, out=at[1])
        at >>= 3
        at &= SLOTS - 1
        at += self.rows
        self.e = self.guess.take(at)
        self.p, self.sure = self.e >> 3, self.e & _SURE
        apart = self.p[0] != self.p[1]
        self.context = self.contexts + (self.sure[0] * (_SURE + 2) + np.where(apart, self.sure[1], _SURE + 1))
        self.f = self.right.take(self.context)
        self.w = (self.f[:2] * (_ONE / self.f[2])).astype(np.int64)
        self.w += 1
        self.w[1] *= apart
        # where the predicted ids' order-0 stretches begin on the line
        found = self.places.take(self.known + self.p)
        self.k = np.where(found > 0, found >> 14 << self.shift, self.unseen)
        self.escape = (_ONE * self.new / self.old).astype(np.int64)
        self.escape += 1
        return self.w[0] + self.w[1] + self.escape + self.all

    def stretch(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and length of the ids' stretches; which ids are new (theirs is the end of the line)."""
        self.came = self.p == ids
        self.hit = self.came.copy()
        self.hit[1] &= ~self.hit[0]
        self.other = ~(self.hit[0] | self.hit[1])
        found = self.places.take(self.known + ids)
        seen = found > 0
        # ids not counted are behind all others, those predicted by order 2 and order 1 first
        place = np.where(seen, found >> 14 << self.shift, self.all + 2 - 2 * self.hit[0] - self.hit[1])
        self.is_new = self.other > seen
        before, own = self.w * (self.k < place), self.w * self.hit
        begin = np.minimum(place, self.all) + before[0]
        begin += before[1]
        return begin, np.where(self.is_new, self.escape, ((found & 16383) << self.shift) + own[0] + own[1]), self.is_new

    def find(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids whose stretches hold the places ``at`` of the line; which places are at its end, that of new ids."""
        swap = self.k[1] < self.k[0]
        a, b = np.where(swap, self.w[1], self.w[0]), np.where(swap, self.w[0], self.w[1])
        begin = np.minimum(self.k, self.all)
        far = at - np.minimum(begin[0], begin[1])
        in_a = (far >= 0) & (far < a)
        at = at - np.minimum(np.maximum(far, 0), a)
        far = at - np.maximum(begin[0], begin[1])
        in_b = ((far >= 0) & (far < b)) > in_a
        at = at - np.minimum(np.maximum(far, 0), b)
        ids = self.sorted.take(self.begins + np.minimum(at >> self.shift, max(self.counted - 1, 0))).astype(np.int64)
        np.copyto(ids, self.p[1], where=np.where(swap, in_a, in_b))
        np.copyto(ids, self.p[0], where=np.where(swap, in_b, in_a))
        return ids, (at >= self.all) > (in_a | in_b)

    def learn(self, ids: np.ndarray) -> None:
        f = self.f
        f *= _FADE
        f[:2] += self.hit
        f[2] += self.other
        np.maximum(f[2], 0.02, out=f[2])
        self.right[self.context] = f
        self.new = self.new * _FADE_NEW + self.is_new
        self.old = self.old * _FADE_NEW + (self.other > self.is_new)
        np.maximum(self.old, 0.05, out=self.old)
        fresh = (ids << 3).astype(np.int32)
        e, sure = self.e, self.sure
        self.guess[self.at] = np.where(self.came, e + (sure < _SURE), np.where(sure > 1, e - (sure + 1 >> 1), fresh))
        self.two, self.one = self.one, ids


def _counts(n: int) -> set[int]:
    """After how many ids order 0 is counted anew."""
    out, at = set(), _FIRST
    while at < n:
        out.add(at)
        at += max(_FIRST, at // 5)
    return out


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """A block of bytes for each array of ids (below ``VOCABULARY``, ``BLOCK`` at most)."""
    out: list[bytes] = []
    for at in range(0, len(blocks), LANES):
        out += _encode(blocks[at : at + LANES])
    return out


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Shorter blocks are filled up with zeros, which their decoder never reaches."""
    sizes = [len(b) for b in blocks]
    n, lanes = max(sizes, default=0), len(blocks)
    if n > BLOCK or any(len(b) and (b.min() < 0 or b.max() >= VOCABULARY) for b in blocks):
        raise ValueError(f"a block has {BLOCK} ids at most, from 0 to {VOCABULARY - 1}")
    ids = np.zeros((lanes, n), np.uint16)
    for k, b in enumerate(blocks):
        ids[k, : len(b)] = b
    steps = np.ascontiguousarray(ids.T)
    model, counts = _Model(lanes), _counts(n)
    low, wide = np.zeros(lanes, _U), np.full(lanes, 2**64 - 1, _U)
    words, carried, filled = np.zeros((lanes, 2 * n + 4), ">u4"), np.zeros((lanes, 2 * n + 4), ">u4"), np.zeros(lanes, np.int64)

    def narrow(at: np.ndarray | slice, begin: np.ndarray, length: np.ndarray, whole: np.ndarray | int) -> None:
        part = wide[at] // np.asarray(whole, _U)
        before = low[at]
        after = before + part * begin.astype(_U)
        over = after < before
        if over.any():
            lane = model.lanes[at][over]
            carried[lane, filled[lane]] += 1
        low[at], wide[at] = after, part * length.astype(_U)
        short = np.flatnonzero(wide < _LOW)
        if len(short):
            words[short, filled[short]] = low[short] >> _U(32)
            filled[short] += 1
            low[short] <<= _U(32)
            wide[short] <<= _U(32)

    for t in range(n):
        if t in counts:
            model.count(ids[:, :t])
        now = steps[t].astype(np.int64)
        whole = model.predict()
        begin, length, new = model.stretch(now)
        narrow(slice(None), begin, length, whole)
        new = np.flatnonzero(new)
        if len(new):
            own = now[new]
            narrow(new, _PRIOR[own], _PRIOR[own + 1] - _PRIOR[own], _PRIOR[-1])
        model.learn(now)
    for _ in range(2):
        words[model.lanes, filled] = low >> _U(32)
        filled += 1
        low <<= _U(32)
    out = []
    for k, b in enumerate(blocks):
        size = int(filled[k])
        # a carry at a place belongs to the word before it
        total = int.from_bytes(words[k, :size].tobytes(), "big") + (int.from_bytes(carried[k, :size].tobytes(), "big") << 32)
        code = total.to_bytes(4 * size, "big")
        out.append(HEAD.pack(MAGIC, len(b), zlib.crc32(np.asarray(b).astype("<u4").tobytes()), len(code)) + code)
    return out


def decode_blocks(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; an altered or torn block raises ValueError."""
    out: list[np.ndarray] = []
    for at in range(0, len(blocks), LANES):
        out += _decode(blocks[at : at + LANES])
    return out


def _decode(blocks: list[bytes]) -> list[np.ndarray]:
    heads = [HEAD.unpack_from(b) if len(b) >= HEAD.size else (b"", 0, 0, -1) for b in blocks]
    if any(h[0] != MAGIC or len(b) != HEAD.size + h[3] or h[3] % 4 or h[1] > BLOCK for h, b in zip(heads, blocks, strict=True)):
        raise ValueError("not a block, or torn")
    n, lanes = max((h[1] for h in heads), default=0), len(blocks)
    words = np.zeros((lanes, max((h[3] // 4 for h in heads), default=0) + 2 * n + 4), _U)
    for k, b in enumerate(blocks):
        own = np.frombuffer(b, ">u4", offset=HEAD.size)
        words[k, : len(own)] = own
    model, counts = _Model(lanes), _counts(n)
    far, wide = words[:, 0] << _U(32) | words[:, 1], np.full(lanes, 2**64 - 1, _U)  # how far the code lies above the range's low end
    filled = np.full(lanes, 2, np.int64)
    ids = np.zeros((lanes, n), np.uint16)

    def narrow(at: np.ndarray | slice, begin: np.ndarray, length: np.ndarray, part: np.ndarray) -> None:
        far[at] -= part * begin.astype(_U)
        wide[at] = part * length.astype(_U)
        short = np.flatnonzero(wide < _LOW)
        if len(short):
            far[short] = far[short] << _U(32) | words[short, filled[short]]
            filled[short] += 1
            wide[short] <<= _U(32)

    for t in range(n):
        if t in counts:
            model.count(ids[:, :t])
        whole = model.predict()
        part = wide // whole.astype(_U)
        now, new = model.find(np.minimum((far // part).astype(np.int64), whole - 1))
        new = np.flatnonzero(new)
        if len(new):
            # the escape's stretch is the end of the line
            end = whole[new]
            narrow_new = wide[new] // end.astype(_U)
            begin = end - model.escape[new]
            inner, span = far[new] - narrow_new * begin.astype(_U), narrow_new * model.escape[new].astype(_U)
            lane, at = new, np.flatnonzero(span < _LOW)
            inner[at] = inner[at] << _U(32) | words[lane[at], filled[lane[at]]]
            span[at] <<= _U(32)
            own = np.minimum((inner // (span // _U(_PRIOR[-1]))).astype(np.int64), _PRIOR[-1] - 1)
            now[new] = np.searchsorted(_PRIOR, own, side="right") - 1
        begin, length, is_new = model.stretch(now)
        narrow(slice(None), begin, length, part)
        if len(new):
            own = now[new]
            narrow(new, _PRIOR[own], _PRIOR[own + 1] - _PRIOR[own], wide[new] // _U(_PRIOR[-1]))
        ids[:, t] = now
        model.learn(now)
    out = [ids[k, : h[1]].astype(np.uint32) for k, h in enumerate(heads)]
    if any(zlib.crc32(x.astype("<u4").tobytes()) != h[2] for x, h in zip(out, heads, strict=True)):
        raise ValueError("a block's ids do not match its checksum")
    return out
