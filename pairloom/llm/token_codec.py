"""Token-id files coded by an adaptive context-mixing range coder.

Ids go in blocks of BLOCK; each block starts from the same base and has its own checksum, so blocks are coded alone and
a damaged one is found. Three orders predict the next id:

- order 2 and order 1 predict what last followed the two ids, or the one id, before; each counts how often it was right
  in a row, and has an adaptive probability for each such count;
- order 0 knows how often ids are used. It has an adaptive probability that a predicted id comes, by the id's class of
  frequency, and codes the ids that no other order predicts: ids are in groups whose frequencies adapt in the block;
  the frequencies inside a group, and those that a block starts from, are the base, which stands once before up to LANES
  blocks.

Logistic mixing with weights that learn joins the three probabilities into the chance of order 2's id (order 1's, if
order 2 knows none), and those of order 1 and order 0 into the chance of order 1's id where it is another one. These
chances and order 0's frequencies divide the range, in which one step of the range coder codes the id. Probabilities,
weights and frequencies learn after 16, 32, 64 and so on ids and then every SPAN ids, so NumPy computes them for whole
spans. All arithmetic is on integers, or on doubles that are exact, so any machine decodes what another one wrote.

NumPy runs many blocks in step: element j of each array is the state of block j.

A file: MAGIC, groups, a footer (an Arrow stream with doc_id and n_tokens, another one with the groups' places), the
footer's two lengths and MAGIC. A group: the base (ids in it, bytes, crc32, then an Arrow stream of ids and their
counts), then its blocks (ids, bytes, crc32 of the ids as little-endian unsigned 32-bit integers, then the payload);
numbers before payloads are little-endian unsigned 32-bit integers. Ids may be any unsigned 32-bit numbers.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MAGIC = b"PLTOKS02"
BLOCK = 4096
#: Blocks coded in step: 4 million ids.
LANES = 1024
SPAN = 512

_T1, _T2 = 1024, 4096
#: The coder's range stays from 2**40 up to 2**56 between ids; output is in words of 16 bits, first byte first.
_LOW, _TOP = 1 << 40, 56
#: A step divides the range into 2**31 parts, of which the chances of predicted ids take whole 4096ths, at most 127/128.
_PARTS, _MOST = 31, 4064
#: Groups of ids, the sum of their frequencies, the sum of the frequencies inside a group.
_GROUPS, _SUM, _INNER = 64, 1024, 8192

#: Logistic mixing: the log-odds, in 256ths, of p / 4096, and back.
_STRETCH = np.array([round(256 * math.log((max(p, 1)) / (4096 - max(p, 1)))) for p in range(4096)], "int64")
_SQUASH = np.array([min(_MOST, max(16, round(4096 / (1 + math.exp(-z / 256))))) for z in range(-2048, 2048)], "int64")


class Base:
    """What every block of a group starts from: its ids in order, their groups, and frequencies."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        self.ids, n = ids, len(ids)
        counts = counts.astype("int64")
        total = int(counts.sum())
        # Groups of about equal use, of at most a quarter of _INNER ids.
        share = (np.cumsum(counts) - counts) * _GROUPS // total
        cut = np.flatnonzero(np.diff(share, prepend=-1))
        width = _INNER // 4
        begins = [b for a, z in zip(cut, np.append(cut[1:], n), strict=True) for b in range(int(a), int(z), width)]
        self.begins = np.array([*begins, n])
        self.groups = len(begins)
        self.group = np.repeat(np.arange(self.groups), np.diff(self.begins))
        # Very many groups need finer frequencies, and so a larger share of the range.
        times = -(-4 * self.groups // _SUM)
        self.sum, self.most = times * _SUM, 4096 - times * (4096 - _MOST)
        self.use = np.add.reduceat(counts, self.begins[:-1])
        # Inside a group: 1 for each id, the rest by the counts, what rounding leaves to the most frequent one.
        size = np.diff(self.begins)[self.group]
        self.freq = 1 + counts * (_INNER - size) // self.use[self.group]
        top = self.begins[:-1] + [int(counts[a:z].argmax()) for a, z in zip(self.begins[:-1], self.begins[1:], strict=True)]
        self.freq[top] += _INNER - np.add.reduceat(self.freq, self.begins[:-1])
        self.start = np.cumsum(self.freq) - self.freq - self.group * _INNER
        # Classes of ids by their frequency.
        kind = np.digitize(counts * 4096 // total, [2, 12, 60])
        #: An id as the model's tables hold it: its place, its class, and two bits for times right in a row.
        self.tags = (np.arange(n) << 4 | kind << 2).astype("int32" if n < 1 << 27 else "int64")


def _softer(h: np.ndarray, n: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Probabilities in 4096ths after h of n, from `first`, which counts as 8."""
    return np.clip((h * 4096 + first * 8) // (n + 8), 16, _MOST)


class _Lanes:
    """The model's state for n blocks, the same in coder and decoder."""

    #: Probabilities that a block starts with, by times right in a row (0, 1, 2 and more; 3: no prediction), and by class.
    first2 = np.array([1200, 1600, 2400, 400], "int64")
    first1 = np.array([600, 1000, 1600, 16, 300, 500, 800, 16], "int64")
    first0 = np.array([400, 400, 400, 600], "int64")
    #: A second prediction's, by order 1's times right and by class.
    other1 = np.array([16, 16, 16, 16, 300, 500, 800, 16], "int64")

    def __init__(self, n: int, base: Base):
        ar = np.arange(n, dtype="int64")
        self.n, self.base = n, base
        self.t1, self.t2 = np.full(n * _T1, -1, base.tags.dtype), np.full(n * _T2, -1, base.tags.dtype)
        self.b1, self.b2, self.b128, self.b32 = ar * _T1, ar * _T2, ar * 128, ar * 32
        self.bg = ar * base.groups
        self.a, self.b = np.zeros(n, "int64"), np.zeros(n, "int64")
        self.w = np.full((3, n, 4), 22000, "int64")  # by order and by what order 2 knows
        self.v = np.full((2, n), 30000, "int64")
        self.h, self.c = np.zeros((n, 4, 4, 8), "int64"), np.zeros((n, 4, 4, 8), "int64")  # class, order 2, order 1
        self.ho, self.co = np.zeros((n, 4, 8), "int64"), np.zeros((n, 4, 8), "int64")
        self.uses = np.repeat((base.use * 600 // base.use.sum())[None], n, axis=0)
        self.noted: list[tuple] = []
        self.mix()
        self.divide()

    def shrink(self, n: int) -> None:
        """The last blocks have ended."""
        for k in ("b1", "b2", "b128", "b32", "bg", "a", "b"):
            setattr(self, k, getattr(self, k)[:n])
        self.n = n

    def predict(self) -> None:
        """The predicted ids x and y (-1: none) and the places of their chances."""
        self.i1 = self.b1 + (self.a & (_T1 - 1))
        self.i2 = self.b2 + (self.a * 40503 + self.b * 30011 >> 3 & (_T2 - 1))
        self.e1, self.e2 = e1, e2 = self.t1.take(self.i1), self.t2.take(self.i2)
        e = np.where(e2 >= 0, e2, e1)
        self.x, self.y = e >> 4, e1 >> 4
        s1 = (e1 & 3) + ((self.x != self.y).view("int8") << 2)
        self.at = self.b128 + (((e & 12) + (e2 & 3) << 3) + s1)
        self.to = self.b32 + (((e1 & 12) << 1) + s1)

    def follow(self, sym: np.ndarray, tag: np.ndarray) -> None:
        """Order 1 and order 2 learn the id that came."""
        most = tag + 2
        for e, table, at in ((self.e1, self.t1, self.i1), (self.e2, self.t2, self.i2)):
            table[at] = np.where(e >> 2 == tag >> 2, np.minimum(e + 1, most), tag)
        self.b, self.a = self.a, sym

    def note(self, at: np.ndarray, to: np.ndarray, kinds: np.ndarray, place: np.ndarray) -> None:
        """What some steps showed: places of the chances, which prediction came true (2: none) and the ids' groups."""
        miss = kinds > 0
        self.noted.append((at.ravel(), at[~miss], to[miss], to[kinds == 1], place[kinds == 2]))

    def learn(self) -> None:
        n = len(self.h)
        at, hit, to, hit_other, groups = (np.concatenate(x) for x in zip(*self.noted, strict=True))
        self.noted = []
        for kept, seen, shape in ((self.c, at, 128), (self.h, hit, 128), (self.co, to, 32), (self.ho, hit_other, 32)):
            new = np.bincount(seen, minlength=n * shape).reshape(kept.shape)
            kept += new
            if kept is self.c:
                tried = new
            elif kept is self.h:
                self._weigh(self.w, self.terms, new * 4096 - tried * self.p)
            elif kept is self.co:
                tried = new
            else:
                self._weigh_other(new * 4096 - tried * self.q)
        self.uses += np.bincount(groups, minlength=n * self.base.groups).reshape(n, -1)
        self.mix()
        self.divide()

    def _weigh(self, w: np.ndarray, terms: tuple, error: np.ndarray) -> None:
        s2, s1, s0 = terms
        w[0] += s2 * error.sum(axis=(1, 3)) >> 13
        w[1] += (s1[:, None, :] * error.sum(axis=1)).sum(axis=2) >> 13
        w[2] += (s0[:, :, None] * error.sum(axis=3)).sum(axis=1) >> 13
        np.clip(w, -65536, 3 * 65536, out=w)

    def _weigh_other(self, error: np.ndarray) -> None:
        s1, s0 = self.other_terms
        self.v[0] += (s1 * error.sum(axis=1)).sum(axis=1) >> 13
        self.v[1] += (s0 * error.sum(axis=2)).sum(axis=1) >> 13
        np.clip(self.v, -65536, 3 * 65536, out=self.v)

    def mix(self) -> None:
        """The chances of all combinations of what the orders know, in 4096ths."""
        s2, s1, s0 = (
            _STRETCH[_softer(self.h.sum(axis=axes), self.c.sum(axis=axes), first)]
            for axes, first in (((1, 3), self.first2), ((1, 2), self.first1), ((2, 3), self.first0))
        )
        self.terms = s2, s1, s0
        w2, w1, w0 = self.w
        z = (w2 * s2)[:, None, :, None] + w1[:, None, :, None] * s1[:, None, None, :] + w0[:, None, :, None] * s0[:, :, None, None]
        self.p = np.minimum(_SQUASH[np.clip(z >> 16, -2048, 2047) + 2048], self.base.most)
        self.p[:, :, 3, 3] = 0  # no order predicts
        t1, t0 = (
            _STRETCH[_softer(self.ho.sum(axis=axis), self.co.sum(axis=axis), first)]
            for axis, first in ((1, self.other1), (2, self.first0))
        )
        self.other_terms = t1, t0
        z = (self.v[0][:, None] * t1)[:, None, :] + (self.v[1][:, None] * t0)[:, :, None]
        self.q = _SQUASH[np.clip(z >> 16, -2048, 2047) + 2048]
        self.q[:, :, :4] = 0  # order 1 predicts nothing else
        self.q[:, :, 7] = 0
        self.flat_p, self.flat_q = self.p.ravel(), self.q.ravel()

    def chances(self, at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the two predicted ids, in 4096ths; the second one's is of what the first one leaves, up to the base's most in all."""
        p = self.flat_p.take(at)
        return p, (self.base.most - p) * self.flat_q.take(to) >> 12

    def divide(self) -> None:
        """Order 0's frequencies of the groups: 1 each, the rest by use; the most used one takes what rounding leaves."""
        base = self.base
        self.gfreq = 1 + self.uses * (base.sum - base.groups) // self.uses.sum(axis=1, keepdims=True)
        self.gfreq[np.arange(len(self.uses)), self.uses.argmax(axis=1)] += base.sum - self.gfreq.sum(axis=1)
        self.gstart = np.cumsum(self.gfreq, axis=1) - self.gfreq
        self.flat_gfreq, self.flat_gstart = self.gfreq.ravel(), self.gstart.ravel()

    def cells(self) -> np.ndarray:
        """For each block and each unit of the groups' frequencies, its group."""
        groups = np.arange(self.base.groups, dtype="uint8" if self.base.groups <= 256 else "uint32")
        return np.repeat(np.tile(groups, len(self.gfreq)), self.flat_gfreq)


def _spans(lengths: np.ndarray) -> Iterator[tuple[int, int, int, bool]]:
    """(first step, last step, blocks that still have ids, whether the model learns then); lengths must not rise."""
    most = int(lengths[0])
    learns = {16 << k for k in range(8) if 16 << k < SPAN} | set(range(SPAN, most + 1, SPAN))
    cuts = sorted({0, most} | {t for t in learns if t < most} | set(map(int, lengths)))
    for a, z in zip(cuts, cuts[1:], strict=False):
        yield a, z, int(np.searchsorted(-lengths, -a, side="left")), z in learns and z < most


def encode_blocks(ids: np.ndarray, base: Base, block: int = BLOCK) -> list[bytes]:
    """Payloads of the blocks that ids, as places in the base, are cut into."""
    if not len(ids):
        return []
    n = -(-len(ids) // block)
    grid = np.zeros(n * block, "int32")
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(n, block).T)
    lengths = np.full(n, block)
    lengths[-1] = len(ids) - (n - 1) * block
    model = _Lanes(n, base)
    cap = 2 * block + 16
    out, pos = np.zeros(n * cap, "uint16"), np.arange(n, dtype="int64") * cap
    low, rng = np.zeros(n, "int64"), np.full(n, 1 << _TOP, "int64")

    def put(at: np.ndarray) -> None:
        word = low[at] >> 40
        where = pos[at]
        out[where] = word & 0xFFFF
        pos[at] = where + 1
        low[at] = (low[at] & (_LOW - 1)) << 16
        up = where[word > 0xFFFF] - 1
        while len(up):  # a carry goes back until a word takes it
            out[up] += 1
            up = up[out[up] == 0] - 1

    def end(at: np.ndarray) -> None:
        """32 bits that lie in the range whatever follows them."""
        low[at] = low[at] + (1 << 24) - 1 >> 24 << 24
        put(at), put(at)

    group, freq, start = base.group, base.freq, base.start
    for first, last, now, learns in _spans(lengths):
        if now < model.n:
            end(np.arange(now, model.n))
            low, rng = low[:now], rng[:now]
            model.shrink(now)
        steps = last - first
        at, to, kinds = np.empty((steps, now), "int64"), np.empty((steps, now), "int64"), np.empty((steps, now), "int8")
        tags = base.tags[grid[first:last, :now]]
        for t in range(steps):
            sym = grid[first + t, :now]
            model.predict()
            at[t], to[t] = model.at, model.to
            kinds[t] = np.where(model.x == sym, 0, np.where(model.y == sym, 1, 2))
            model.follow(sym.astype("int64"), tags[t])
        sym = grid[first:last, :now]
        p, q = model.chances(at, to)
        kinds[(kinds == 1) & (q == 0)] = 2
        own = group[sym]
        place = model.bg + own
        left = (4096 - p - q) << (_PARTS - 12)
        unit = left // base.sum
        inner = unit * model.flat_gfreq.take(place) // _INNER
        begin = ((p + q) << (_PARTS - 12)) + unit * model.flat_gstart.take(place) + inner * start[sym]
        size = inner * freq[sym]
        for k, (b, s) in enumerate(((0, p), (p, q))):
            begin = np.where(kinds == k, b << (_PARTS - 12) if k else 0, begin)
            size = np.where(kinds == k, s << (_PARTS - 12), size)
        for t in range(steps):
            r = rng >> _PARTS
            low += r * begin[t]
            rng = r * size[t]
            small = np.flatnonzero(rng < _LOW)
            while len(small):
                put(small)
                rng[small] <<= 16
                small = small[rng[small] < _LOW]
        model.note(at, to, kinds, place)
        if learns:
            model.learn()
    end(np.arange(len(low)))
    return [out[i * cap : pos[i]].astype(">u2").tobytes() for i in range(n)]


def decode_blocks(payloads: list[bytes], lengths: list[int], base: Base) -> list[np.ndarray]:
    """The ids of each block, as places in the base; lengths must not rise."""
    if not payloads:
        return []
    n, sizes = len(payloads), np.array(lengths)
    data = b"".join([*payloads, b"\0" * 65])
    at = np.concatenate(([0], np.cumsum([len(p) for p in payloads])[:-1])).astype("int64")
    first = np.frombuffer(data, "u1")
    code = np.zeros(n, "int64")
    for k in range(_TOP // 8):
        code = code << 8 | first[at + k]
    words, pos = np.frombuffer(data[1 : len(data) - (len(data) + 1) % 2], ">u2").astype("int64"), at // 2 + 3
    rng = np.full(n, 1 << _TOP, "int64")
    model, inside = _Lanes(n, base), np.repeat(np.arange(len(base.ids), dtype="int32"), base.freq)
    cells = model.cells()
    units = np.arange(n, dtype="int64") * base.sum
    freq, start, shift = base.freq, base.start, _PARTS - 12
    grid = np.zeros((int(sizes[0]), n), "int32")
    for begun, last, now, learns in _spans(sizes):
        if now < model.n:
            code, rng, pos, units = code[:now], rng[:now], pos[:now], units[:now]
            model.shrink(now)
        shape = (last - begun, now)
        chance, other, kinds, groups = np.empty(shape, "int64"), np.empty(shape, "int64"), np.empty(shape, "int8"), np.empty(shape, "int64")
        for t in range(last - begun):
            model.predict()
            p, q = model.chances(model.at, model.to)
            r = rng >> _PARTS
            v = code // r
            both = p + q
            unit = ((4096 - both) << shift) // base.sum
            # Places of ids that no prediction has; for the others these are some valid places, not used.
            rest = np.maximum(v - (both << shift), 0)
            slot = np.minimum((rest / unit).astype("int64"), base.sum - 1)
            group = cells.take(units + slot).astype("int64")
            place = model.bg + group
            inner = unit * model.flat_gfreq.take(place) // _INNER
            begin = unit * model.flat_gstart.take(place)
            slot = np.minimum((np.maximum(rest - begin, 0) / inner).astype("int64"), _INNER - 1)
            sym = inside.take(group * _INNER + slot).astype("int64")
            begin += (both << shift) + inner * start.take(sym)
            size = inner * freq.take(sym)
            kind = (v >= p << shift).view("int8") + (v >= both << shift).view("int8")
            hit = np.flatnonzero(kind < 2)
            if len(hit):
                is_first = kind[hit] == 0
                sym[hit] = np.where(is_first, model.x[hit], model.y[hit])
                begin[hit] = np.where(is_first, 0, p[hit] << shift)
                size[hit] = np.where(is_first, p[hit], q[hit]) << shift
            code -= r * begin
            rng = r * size
            small = np.flatnonzero(rng < _LOW)
            while len(small):
                where = pos[small]
                code[small] = (code[small] << 16) | words[where]
                pos[small] = where + 1
                rng[small] <<= 16
                small = small[rng[small] < _LOW]
            grid[begun + t, :now] = sym
            chance[t], other[t], kinds[t], groups[t] = model.at, model.to, kind, place
            model.follow(sym, base.tags.take(sym))
        model.note(chance, other, kinds, groups)
        if learns:
            model.learn()
            cells = model.cells()
    grid = np.ascontiguousarray(grid.T)
    return [grid[i, : sizes[i]] for i in range(n)]


def _ipc(table: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(table)
    return sink.getvalue().to_pybytes()


def counted(ids: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The stored base of ids, its ids and their counts, and the ids as places in it."""
    if int(ids.max()) < 1 << 22:
        counts = np.bincount(ids)
        known = np.flatnonzero(counts)
        where = np.cumsum(counts > 0) - 1
        counts, places = counts[known], where.astype("int32")[ids]
    else:
        known, places, counts = np.unique(ids, return_inverse=True, return_counts=True)
    # Half a per cent of a frequency is enough; small counts are whole.
    keep = np.maximum(np.frexp(counts.astype("float64"))[1] - 8, 0)
    counts = (counts >> keep) << keep
    step = np.diff(known, prepend=0)
    stored = _ipc(pa.RecordBatch.from_arrays([pa.array(step.astype("uint32")), pa.array(counts.astype("uint32"))], names=["step", "count"]))
    return stored, known.astype("uint32"), counts, places


def base_of(ids: np.ndarray) -> tuple[bytes, Base, np.ndarray]:
    """The stored base of ids, the base, and the ids as places in it."""
    stored, known, counts, places = counted(ids)
    return stored, Base(known, counts), places


def stored_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ids and counts of a stored base."""
    table = pa.ipc.open_stream(data).read_all()
    return np.cumsum(table["step"].to_numpy().astype("int64")).astype("uint32"), table["count"].to_numpy()


def stored_base(data: bytes) -> Base:
    return Base(*stored_counts(data))


def framed(n: int, data: bytes, crc: int) -> bytes:
    """A base or a block as it stands in a file."""
    return struct.pack("<III", n, len(data), crc) + data


def groups_of(docs: Iterator[tuple[object, bytes]], names: list, sizes: list[int], group: int = 4 * BLOCK * LANES) -> Iterator[bytes]:
    """The ids of all documents in pieces of `group` bytes; names and sizes get each document's id and number of ids."""
    held: list[bytes] = []
    held_bytes = 0
    for name, ids in docs:
        names.append(name)
        sizes.append(len(ids) // 4)
        held.append(ids)
        held_bytes += len(ids)
        if held_bytes >= group:
            data = memoryview(b"".join(held))
            for a in range(0, len(data) - group + 1, group):
                yield bytes(data[a : a + group])
            held = [bytes(data[len(data) // group * group :])]
            held_bytes = len(held[0])
    if held_bytes:
        yield b"".join(held)


def docs_part(names: list, sizes: list[int], id_type: pa.DataType) -> bytes:
    """The footer's stream of documents."""
    return _ipc(pa.RecordBatch.from_arrays([pa.array(names, id_type), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"]))


def footer(docs: bytes, places: list[tuple[int, int, int]]) -> bytes:
    """What follows the groups; places: offset, ids and blocks of each."""
    b = _ipc(pa.RecordBatch.from_arrays([pa.array([p[i] for p in places], pa.int64()) for i in range(3)], names=["offset", "n_tokens", "n_blocks"]))
    return docs + b + struct.pack("<QQ", len(docs), len(b)) + MAGIC


def file_chunks(docs: Iterator[tuple[object, bytes]], id_type: pa.DataType, counts: dict, block: int = BLOCK, lanes: int = LANES) -> Iterator[bytes]:
    """The bytes of a file for (doc_id, ids as little-endian unsigned 32-bit bytes); counts gets n_docs and n_tokens."""
    yield MAGIC
    at, names, sizes, places = len(MAGIC), [], [], []
    for data in groups_of(docs, names, sizes, 4 * block * lanes):
        stored, base, own = base_of(np.frombuffer(data, "<u4"))
        parts = [framed(len(base.ids), stored, zlib.crc32(stored))]
        for i, payload in enumerate(encode_blocks(own, base, block)):
            piece = data[4 * i * block : 4 * (i + 1) * block]
            parts.append(framed(len(piece) // 4, payload, zlib.crc32(piece)))
        places.append((at, len(data) // 4, len(parts) - 1))
        at += sum(map(len, parts))
        yield from parts
    counts |= {"n_docs": len(names), "n_tokens": sum(sizes)}
    yield footer(docs_part(names, sizes, id_type), places)


def read_group(data: bytes, n_blocks: int) -> bytes:
    """The ids of a group's blocks, as little-endian unsigned 32-bit integers."""
    at, parts = 0, []
    for _ in range(n_blocks + 1):
        n, size, crc = struct.unpack_from("<III", data, at)
        parts.append((n, data[at + 12 : at + 12 + size], crc))
        at += 12 + size
    _, stored, crc = parts.pop(0)
    if zlib.crc32(stored) != crc:
        raise ValueError("a base is damaged")
    base, ids = stored_base(stored), []
    # Only a group's last block may be shorter.
    for i, places in enumerate(decode_blocks([p for _, p, _ in parts], [n for n, _, _ in parts], base)):
        ids.append(base.ids[places].astype("<u4").tobytes())
        if zlib.crc32(ids[-1]) != parts[i][2]:
            raise ValueError(f"block {i} of a group is damaged")
    return b"".join(ids)


def read_footer(reader) -> tuple[bytes, list[tuple[int, int, int]]]:
    """The footer's stream of documents; offset, bytes and blocks of each group."""
    tail = 16 + len(MAGIC)
    a, b, end = struct.unpack(f"<QQ{len(MAGIC)}s", reader.read(reader.size - tail, tail))
    if end != MAGIC or reader.read(0, len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    stop = reader.size - tail - b - a
    places = pa.ipc.open_stream(reader.read(stop + a, b)).read_all()
    offsets, blocks = [*places["offset"].to_pylist(), stop], places["n_blocks"].to_pylist()
    return reader.read(stop, a), [(o, z - o, n) for o, z, n in zip(offsets, offsets[1:], blocks, strict=False)]


def split_group(data: bytes, n_blocks: int, most: int) -> tuple[bytes, list[bytes]]:
    """The stored base of a group, checked, and its blocks as they stand there, in pieces of at most `most` blocks."""
    n, size, crc = struct.unpack_from("<III", data)
    stored, at, pieces = data[12 : 12 + size], 12 + size, []
    if zlib.crc32(stored) != crc:
        raise ValueError("a base is damaged")
    while n_blocks:
        begin = at
        for _ in range(min(most, n_blocks)):
            at += 12 + struct.unpack_from("<I", data, at + 4)[0]
            n_blocks -= 1
        pieces.append(data[begin:at])
    return stored, pieces


def documents_of(docs: bytes, source: Iterator[bytes]) -> Iterator[tuple[object, bytes]]:
    """(doc_id, ids) of each document in the footer's stream; source gives the ids of all in pieces."""
    docs = pa.ipc.open_stream(docs).read_all()
    held, at = b"", 0
    for name, n in zip(docs["doc_id"].to_pylist(), docs["n_tokens"].to_pylist(), strict=True):
        need = 4 * n
        parts = []
        while need > len(held) - at:
            parts.append(held[at:])
            need -= len(held) - at
            held, at = next(source), 0
        parts.append(held[at : at + need])
        at += need
        yield name, b"".join(parts)


def read_file(reader) -> Iterator[tuple[object, bytes]]:
    """(doc_id, ids as little-endian unsigned 32-bit bytes) of each document of an open file; checks each block."""
    docs, groups = read_footer(reader)
    yield from documents_of(docs, (read_group(reader.read(o, size), n) for o, size, n in groups))
