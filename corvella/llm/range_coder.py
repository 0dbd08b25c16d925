"""Adaptive context-mixing range coder for token ids, in blocks that are reset and checksummed.

An id is first coded as one of four events: it is the id last seen after the same two ids (order 2), the one
last seen after the same id (order 1), another id of the block so far (order 0), or none of these. The mixture of
the four is learned per confidence of the two context predictions. An order-0 id is coded by its share of the
block up to the last snapshot; any other by a fixed curve that falls with the id, as vocabularies number
frequent ids first. All of it drives a 48-bit range coder with 16-bit output. A block holds up to ``BLOCK`` ids
and starts from an empty model, so any block can be decoded alone.

Blocks are coded in lockstep, one lane each: every array operation advances all lanes by one id, and encoder and
decoder share the model. A snapshot is the sorted list of a lane's ids: a drawn place in it names
the id, and the id's first place and number of places are its interval, so that nothing is searched
in decoding and no table is as wide as the alphabet.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 1024
LANES = 4096
SLOT_BITS = 10
WEIGHT_BITS = 12
ADAPT = 5
SNAPSHOTS = (16, 32, 64, 128, 256, 512)  # then each half as many again
CURVE_BITS = 20
HEADER = struct.Struct("<III")  # ids, payload bytes, crc32 of the ids as little-endian unsigned 32-bit integers
BITS = 48  # doubles hold all values exactly
WHOLE, BOTTOM = np.uint64((1 << BITS) - 1), np.uint64(1 << (BITS - 16))
UNDER = BOTTOM - np.uint64(1)
S16, TOP, OVER, SW, SC = (np.uint64(k) for k in (16, BITS - 16, BITS, WEIGHT_BITS, CURVE_BITS))
LOW16, MOD_WEIGHTS = np.uint64(0xFFFF), np.uint64((1 << WEIGHT_BITS) - 1)
HEAD_WORDS = BITS // 16


def fixed_curve(alphabet: int) -> np.ndarray:
    """Cumulative counts of ids 0..alphabet-1 that fall as 1 / (id + 64); at least 1 each, ``1 << CURVE_BITS`` in all."""
    total = (1 << CURVE_BITS) - alphabet
    falling = np.cumsum(1.0 / (np.arange(alphabet) + 64))
    return np.concatenate([[0], np.floor(falling / falling[-1] * total).astype(np.int64) + np.arange(1, alphabet + 1)]).astype(np.uint32)


# What an event's weights move towards: cumulative counts of the four events, each keeping at least 16 of 4096.
# Steps of a 32nd of the way, rounded down, never bring two of them closer than 16.
# Four 16-bit weights travel as one 64-bit number, so that a lane's are read and written at once.
_GOALS = np.array([[16 * k + ((1 << WEIGHT_BITS) - 64) * (k > e) for k in range(4)] for e in range(4)], dtype=np.int16).view(np.uint64).ravel()
_SURER = np.array([1, 2, 3, 3], dtype=np.uint32) << 16  # a right prediction's next confidence
_SPREAD1, _SPREAD2, _ONE, _TO_SLOT = (np.uint32(k) for k in (2654435761, 2246822519, 1, 32 - SLOT_BITS))
_START = np.array([k << (WEIGHT_BITS - 2) for k in range(4)], dtype=np.int16).view(np.uint64)


class Model:
    """State of ``lanes`` blocks; ids are below 65,536."""

    def __init__(self, lanes: int):
        self.row = np.arange(lanes, dtype=np.int64)
        self.slots = self.row << SLOT_BITS
        self.order2 = np.zeros(lanes << SLOT_BITS, dtype=np.uint32)  # id + (confidence << 16)
        self.order1 = np.zeros(lanes << SLOT_BITS, dtype=np.uint32)
        self.weights = np.repeat(_START, lanes * 32)
        self.contexts = self.row << 5
        self.key1 = np.zeros(lanes, dtype=np.uint32)  # the last id, spread
        self.key2 = np.zeros(lanes, dtype=np.uint32)
        self.seen, self.width, self.due = 0, 0, SNAPSHOTS[0]
        self.active = lanes

    def predict(self) -> None:
        if self.seen == self.due:
            self._snapshot()
        n = self.active
        k1 = self.key1[:n]
        self.at1 = (k1 >> _TO_SLOT) + self.slots[:n]
        self.at2 = ((k1 ^ self.key2[:n]) >> _TO_SLOT) + self.slots[:n]
        e1, e2 = self.order1.take(self.at1), self.order2.take(self.at2)
        self.id1, self.id2 = e1 & 0xFFFF, e2 & 0xFFFF
        self.conf1, self.conf2 = e1 >> 16, e2 >> 16
        self.context = (self.conf2 << 3) + (self.conf1 << 1) + (self.id1 == self.id2) + self.contexts[:n]
        self.packed = self.weights.take(self.context)
        self.w = self.packed.view(np.int16).reshape(-1, 4)  # the same memory

    def _snapshot(self) -> None:
        self.width = self.seen
        self.due = next((s for s in SNAPSHOTS if s > self.seen), self.seen + self.seen // 2)
        self.take_snapshot()

    def update(self, ids: np.ndarray, event: np.ndarray) -> None:
        """``ids`` are uint32."""
        n = self.active
        self.w += (_GOALS.take(event).view(np.int16).reshape(-1, 4) - self.w) >> ADAPT
        self.weights[self.context] = self.packed  # lanes are distinct rows
        self.order1[self.at1] = ids | (_SURER.take(self.conf1) * (self.id1 == ids))
        self.order2[self.at2] = ids | (_SURER.take(self.conf2) * (self.id2 == ids))
        self.key2[:n] = self.key1[:n] * _SPREAD2 + _ONE
        self.key1[:n] = (ids + _ONE) * _SPREAD1
        self.seen += 1

    def interval(self, event: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cumulative weight and weight of each lane's event."""
        part = self.packed >> (event << 4).astype(np.uint64)  # the event's cumulative weight comes first, the next event's after it
        return part & LOW16, ((part >> S16) - part) & MOD_WEIGHTS  # after the last there is 0, which is all of the weight by that modulus


class DecoderModel(Model):
    """Snapshots as sorted ids: a place names its id, that id's first place and how many places it has."""

    def __init__(self, lanes: int, longest: int):
        super().__init__(lanes)
        self.history = np.zeros((longest, lanes), dtype=np.uint16)

    def take_snapshot(self) -> None:
        t, n = self.width, self.active
        h = np.sort(self.history[:t, :n].T.copy(), axis=1, kind="stable")  # a radix sort
        starts = np.ones((n, t), dtype=bool)
        np.not_equal(h[:, 1:], h[:, :-1], out=starts[:, 1:])
        flat = np.flatnonzero(starts)
        size = np.diff(flat, append=n * t).astype(np.uint16)
        self.first, self.count, self.sorted = np.repeat((flat % t).astype(np.uint16), size), np.repeat(size, size), h.reshape(-1)

    def update(self, ids: np.ndarray, event: np.ndarray) -> None:
        self.history[self.seen, : self.active] = ids
        super().update(ids, event)


class EncoderModel(Model):
    """The same snapshots by counts: ids are ranked within their lane, so first places are sums of counts by rank."""

    def __init__(self, grid: np.ndarray):
        super().__init__(grid.shape[1])
        ids = np.ascontiguousarray(grid.T.astype(np.uint16))
        order = np.argsort(ids, axis=1, kind="stable")
        ids = np.take_along_axis(ids, order, axis=1)
        rank = np.zeros(ids.shape, dtype=np.uint16)
        np.cumsum(ids[:, 1:] != ids[:, :-1], axis=1, dtype=np.uint16, out=rank[:, 1:])
        self.wide = int(rank.max(initial=0)) + 1
        np.put_along_axis(ids, order, rank, axis=1)
        self.ranks = ids.T.copy()
        self.counts = np.zeros(len(self.row) * self.wide, dtype=np.uint16)
        self.base = self.row * self.wide
        self.first = self.count = np.zeros_like(self.counts)  # no snapshot yet

    def take_snapshot(self) -> None:
        n = self.active * self.wide
        self.count = self.counts[:n].copy()
        self.first = (np.cumsum(self.count.reshape(-1, self.wide), axis=1, dtype=np.uint16).reshape(-1)) - self.count

    def places(self, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first place, count) of the next id of each lane, count 0 if it is not in the snapshot."""
        at = self.base[lanes] + self.ranks[self.seen].take(lanes)
        return self.first.take(at).astype(np.uint64), self.count.take(at).astype(np.uint64)

    def update(self, ids: np.ndarray, event: np.ndarray) -> None:
        self.counts[self.base[: self.active] + self.ranks[self.seen, : self.active]] += np.uint16(1)  # lanes are distinct rows
        super().update(ids, event)


class _Out:
    def __init__(self, lanes: int, longest: int):
        self.low = np.zeros(lanes, dtype=np.uint64)
        self.range = np.full(lanes, WHOLE, dtype=np.uint64)
        self.words = np.zeros((lanes, 2 * longest + 8), dtype=np.uint32)
        self.flat = self.words.reshape(-1)
        self.at = np.arange(lanes, dtype=np.int64) * self.words.shape[1]

    def put(self, n: int, low: np.ndarray, rng: np.ndarray) -> None:
        """New state of the first ``n`` lanes; ``low`` may have run over, and up to two words are due."""
        over = (low > WHOLE).nonzero()[0]
        if len(over):
            self.flat[self.at[over] - 1] += 1
            low &= WHOLE
        who = (rng < BOTTOM).nonzero()[0]
        while len(who):
            part, to = low[who], self.at[who]
            self.flat[to] = part >> TOP
            self.at[who] = to + 1
            low[who] = (part & UNDER) << S16
            rng[who] <<= S16
            who = who[rng[who] < BOTTOM]
        self.low[:n], self.range[:n] = low, rng

    def finish(self) -> list[bytes]:
        for _ in range(HEAD_WORDS):
            self.flat[self.at] = self.low >> TOP
            self.low = (self.low & UNDER) << S16
            self.at += 1
        size = self.at - np.arange(len(self.low), dtype=np.int64) * self.words.shape[1]
        words = self.words[:, : int(size.max())]
        while True:  # carries that were added to words already written
            carry = words >> 16
            if not carry.any():
                break
            words &= 0xFFFF
            words[:, :-1] += carry[:, 1:]
        return [words[i, : int(n)].astype("<u2").tobytes() for i, n in enumerate(size)]


def _lanes_at(sizes: list[int]) -> np.ndarray:
    """How many lanes (longest first) still have an id at each step."""
    return len(sizes) - np.searchsorted(np.sort(np.asarray(sizes)), np.arange(max(sizes, default=0)), side="right")


def encode_blocks(blocks: list[np.ndarray], alphabet: int) -> list[bytes]:
    """Each block of ids (at most ``BLOCK``) as header and payload."""
    if not blocks:
        return []
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    sizes = [len(blocks[i]) for i in order]
    grid = np.zeros((sizes[0], len(blocks)), dtype=np.uint32)
    for lane, i in enumerate(order):
        grid[: sizes[lane], lane] = blocks[i]
    curve = fixed_curve(alphabet)
    model, out = EncoderModel(grid), _Out(len(blocks), sizes[0])
    for t, n in enumerate(_lanes_at(sizes).tolist()):
        model.active, ids = n, grid[t, :n]
        model.predict()
        event = np.where(model.id2 == ids, 0, np.where(model.id1 == ids, 1, 3))
        miss = (event == 3).nonzero()[0]
        first, count = model.places(miss)
        found = count > 0
        old, new = miss[found], miss[~found]
        event[old] = 2
        cum, freq = model.interval(event)
        r = out.range[:n] >> SW
        low, rng = out.low[:n] + r * cum, r * freq
        if len(old):
            r = rng[old] // np.uint64(model.width)
            low[old] += r * first[found]
            rng[old] = r * count[found]
        if len(new):
            r, lo = rng[new] >> SC, curve[ids[new]]
            low[new] += r * lo
            rng[new] = r * (curve[ids[new] + 1] - lo)
        out.put(n, low, rng)
        model.update(ids, event)
    made = [b""] * len(blocks)
    for lane, (i, payload) in enumerate(zip(order, out.finish(), strict=True)):
        made[i] = HEADER.pack(sizes[lane], len(payload), zlib.crc32(np.asarray(blocks[i], dtype="<u4").tobytes())) + payload
    return made


def decode_blocks(blocks: list[bytes], alphabet: int) -> list[np.ndarray]:
    """The ids of each block (little-endian unsigned 32-bit); ValueError if one does not match its checksum."""
    if not blocks:
        return []
    heads = [HEADER.unpack_from(b) for b in blocks]
    order = sorted(range(len(blocks)), key=lambda i: -heads[i][0])
    sizes = [heads[i][0] for i in order]
    longest = max(heads[i][1] for i in order) // 2 + 8
    words = np.zeros((len(blocks), longest), dtype=np.uint16)
    for lane, i in enumerate(order):
        got = np.frombuffer(blocks[i], dtype="<u2", offset=HEADER.size, count=heads[i][1] // 2)
        words[lane, : len(got)] = got
    flat, start = words.reshape(-1), np.arange(len(blocks), dtype=np.int64) * longest
    last, at = start + longest - 1, start + HEAD_WORDS
    code_all = np.zeros(len(blocks), dtype=np.uint64)
    for k in range(HEAD_WORDS):
        code_all = (code_all << S16) | words[:, k]
    range_all = np.full(len(blocks), WHOLE, dtype=np.uint64)
    curve = fixed_curve(alphabet)
    grid = np.zeros((sizes[0], len(blocks)), dtype=np.uint32)
    model = DecoderModel(len(blocks), sizes[0])
    for t, n in enumerate(_lanes_at(sizes).tolist()):
        model.active = n
        model.predict()
        r, w = range_all[:n] >> SW, model.w
        value = np.minimum(_quotient(code_all[:n], r), (1 << WEIGHT_BITS) - 1).astype(np.int16)
        event = (value >= w[:, 1]).astype(np.int64)
        event += value >= w[:, 2]
        event += value >= w[:, 3]
        if model.width == 0:
            event[event == 2] = 3  # only in a damaged block
        cum, freq = model.interval(event)
        code, rng = code_all[:n] - r * cum, r * freq
        ids = np.where(event == 0, model.id2, model.id1)
        old, new = (event == 2).nonzero()[0], (event == 3).nonzero()[0]
        if len(old):
            part, r = code[old], rng[old] // np.uint64(model.width)
            place = np.minimum(_quotient(part, r), model.width - 1).astype(np.int64) + old * model.width
            code[old] = part - r * model.first.take(place)
            rng[old] = r * model.count.take(place)
            ids[old] = model.sorted.take(place)
        if len(new):
            part, r = code[new], rng[new] >> SC
            found = np.searchsorted(curve, np.minimum(_quotient(part, r), (1 << CURVE_BITS) - 1).astype(np.uint32), side="right") - 1
            lo = curve[found]
            code[new] = part - r * lo
            rng[new] = r * (curve[found + 1] - lo)
            ids[new] = found
        who = (rng < BOTTOM).nonzero()[0]
        while len(who):
            to = at[who]
            code[who] = (code[who] << S16) | flat[to]
            at[who] = np.minimum(to + 1, last[who])  # a damaged block runs out of words, not of its lane
            rng[who] = np.maximum(rng[who], 1) << S16
            who = who[rng[who] < BOTTOM]
        code_all[:n], range_all[:n] = code, rng
        grid[t, :n] = ids
        model.update(ids, event)
    made: list = [None] * len(blocks)
    for lane, i in enumerate(order):
        ids = np.ascontiguousarray(grid[: sizes[lane], lane]).astype("<u4")
        if zlib.crc32(ids.tobytes()) != heads[i][2]:
            raise ValueError("a block does not match its checksum")
        made[i] = ids
    return made


def _quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """floor(a / b) below 2 ** 21 for integers below 2 ** 48 (b above 0, as ranges never fall below ``BOTTOM``): doubles are exact enough, and faster than integer division."""
    return np.floor(a.astype(np.float64) / b.astype(np.float64))
