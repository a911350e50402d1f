"""Sampled SentencePiece segmentations by forward filtering and backward sampling, and lossless decoding.

The lattice of a text has an edge for every vocabulary piece that matches a stretch of it; a segmentation is a path,
with probability proportional to the product of its pieces' probabilities to the power ``alpha``.  Forward filtering
sums the weight of all paths up to each place, backward sampling walks from the end and draws each last piece by its
share.  No piece has a space or line break after another character, so the lattice falls apart at those places into
short segments whose tables are shared by all their occurrences.  Work goes on in blocks of CHUNK bytes that are cut
between segments, also within a text, so a task holds as much for one very long text as for many short ones; tables
of segments that come again are held from block to block, up to HELD_EDGES.

A draw depends on the seed, the row key, the segment's number in the text and the step, and on nothing else: a
repeated task, another partitioning or another cluster gives the same segmentation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.common import short_batches

#: Where the vocabularies of public tokenizers lie on this box; a caller elsewhere gives its own path.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes that are worked on at once: it bounds the arrays of a task whatever its batch holds.
CHUNK = 1 << 18
#: A stretch without a space or line break is cut after this many bytes (less what keeps a character whole), so one is no longer than a block.
LONGEST = 1 << 16
#: Lattice edges (13 bytes each) of repeated segments that are held between blocks.
HELD_EDGES = 1 << 20
#: Ids or texts decoded at once.
CHUNK_IDS = 1 << 18
#: Log-probability of a character without a piece, which is spelt in bytes.
SPELT = -20.0


def vocabulary(model: str = MODEL) -> tuple[list[tuple[str, int, float]], dict[int, bytes], list[int]]:
    """Pieces (text with plain spaces, id, log-probability), the bytes of every id, and the ids of the 256 byte pieces.

    The model ranks its pieces and gives no probabilities; they are taken as 1 / (rank + 10), the usual law of ranks.
    The file is read on the driver and its pieces travel with the job: a vocabulary's size is fixed.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    every = range(sp.get_piece_size())
    bytes_of = {i: bytes([int(sp.id_to_piece(i)[1:-1], 16)]) for i in every if sp.is_byte(i)}
    own = [i for i in every if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    own.sort(key=lambda i: (-sp.get_score(i), i))
    weights = [1 / (rank + 10) for rank in range(len(own))]
    total = math.log(sum(weights))
    texts = [sp.id_to_piece(i).replace("▁", " ") for i in own]
    spelling = [0] * 256
    for i, b in bytes_of.items():
        spelling[b[0]] = i
    bytes_of |= {i: t.encode() for i, t in zip(own, texts)}
    return [(t, i, math.log(w) - total) for t, i, w in zip(texts, own, weights)], bytes_of, spelling


class Trie:
    """The vocabulary as arrays, so that one step from very many nodes is a few array operations."""

    EMPTY = np.int64(-1)

    def __init__(self, pieces: list[tuple[str, int, float]]):
        step: dict[int, int] = {}
        piece = [-1]
        for n, (text, _, _) in enumerate(pieces):
            node = 0
            for c in text:
                node = step.setdefault(node << 21 | ord(c), len(piece))
                if node == len(piece):
                    piece.append(-1)
            piece[node] = n
        self.piece = np.array(piece)  # number of the piece that ends at a node
        self.bits = max(4, (4 * len(step)).bit_length())
        self.key, self.to = np.full(1 << self.bits, self.EMPTY), np.full(1 << self.bits, -1)
        keys = np.fromiter(step, dtype=np.int64, count=len(step))
        for slot, (k, v) in zip(self.slot(keys).tolist(), step.items()):
            while self.key[slot] != self.EMPTY:
                slot = (slot + 1) % len(self.key)
            self.key[slot], self.to[slot] = k, v

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Next node of each, -1 where there is none."""
        key = node << 21 | char
        slot = self.slot(key)
        out = np.where(self.key[slot] == key, self.to[slot], -1)
        open_ = np.flatnonzero((self.key[slot] != key) & (self.key[slot] != self.EMPTY))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % len(self.key)
            at = slot[open_]
            same = self.key[at] == key[open_]
            out[open_[same]] = self.to[at[same]]
            open_ = open_[~same & (self.key[at] != self.EMPTY)]
        return out


class Lattice:
    """Backward-sampling tables of segments: for every place of a segment, the pieces that may end there and their shares."""

    def __init__(self, pieces: list[tuple[str, int, float]], spelling: list[int], alpha: float):
        self.trie = Trie(pieces)
        self.id = np.array([i for _, i, _ in pieces])
        self.weight = np.exp(alpha * np.array([w for _, _, w in pieces]))
        self.single = np.array([len(t) == 1 for t, _, _ in pieces])
        self.spelt_weight = math.exp(alpha * SPELT)
        self.spelling = spelling
        self._forget()

    def tables(self, segments: list[str] | pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row of place 0 of each segment (place e has row + e), the first edge of each row (and the end of the last),
        and for all rows after one another, sorted by row, the edges that end there: running share, places that the
        edge goes back, id.

        Running shares are counted in 2^-53 within their row, so they are the same whatever else is in the batch.  A character without a piece is one edge whose id is -1 - its code point.  Sums are kept as shares of the sum
        before, so a long segment doesn't run out of small numbers.
        """
        segments = pa.array(segments, pa.string()) if isinstance(segments, list) else segments
        sizes = pc.utf8_length(segments).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.frombuffer(segments.buffers()[1], dtype=np.int32)[segments.offset : segments.offset + len(segments) + 1]
        spelt = segments.buffers()[2][int(offsets[0]) : int(offsets[-1])].to_pybytes() if len(segments) else b""
        char = np.frombuffer(spelt.decode().encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        first = np.cumsum(sizes) - sizes
        row0 = first + np.arange(len(sizes))
        own = np.repeat(np.arange(len(sizes)), sizes)
        local, left = np.arange(len(char)) - first[own], (first + sizes)[own] - np.arange(len(char))
        at, node = np.arange(len(char)), np.zeros(len(char), dtype=np.int64)
        known = np.zeros(len(char), dtype=bool)
        start, size, piece = [], [], []
        for k in range(len(char)):
            node = self.trie.step(node, char[at + k])
            some = node >= 0
            at, node = at[some], node[some]
            ends = self.trie.piece[node]
            hit = ends >= 0
            start.append(at[hit])
            size.append(np.full(int(hit.sum()), k + 1))
            piece.append(ends[hit])
            if k == 0:
                known[at[hit]] = True
            more = left[at] > k + 1
            at, node = at[more], node[more]
            if not len(at):
                break
        odd = np.flatnonzero(~known)
        start, size, piece = (np.concatenate([*x, y]) for x, y in ((start, odd), (size, np.ones(len(odd), dtype=np.int64)), (piece, np.full(len(odd), -1))))
        weight = np.where(piece >= 0, self.weight[piece], self.spelt_weight)
        ids = np.where(piece >= 0, self.id[piece], -1 - char[start])
        into, source = row0[own[start]] + local[start] + size, row0[own[start]] + local[start]
        order = np.argsort(into * 64 + np.minimum(size, 63), kind="stable")  # by place, shorter pieces first
        start, size, weight, ids, into, source = (x[order] for x in (start, size, weight, ids, into, source))
        share = self.forward(into, source, size, weight, local[start] + size, len(char) + len(sizes))
        first_edge = np.concatenate([[0], np.cumsum(np.bincount(into, minlength=len(char) + len(sizes)))])
        begin = np.flatnonzero(np.concatenate([[True], into[1:] != into[:-1]])) if len(into) else np.zeros(0, dtype=np.int64)
        width = np.diff(np.append(begin, len(into)))
        units = (share * 2.0**53).astype(np.uint64)
        run = np.cumsum(units)  # may wrap around, which the difference undoes
        run = np.minimum(run - np.repeat(run[begin] - units[begin], width), np.uint64(1 << 53))
        run[begin + width - 1] = 1 << 53
        return row0, first_edge, run, size, ids

    @staticmethod
    def forward(into: np.ndarray, source: np.ndarray, size: np.ndarray, weight: np.ndarray, end: np.ndarray, rows: int) -> np.ndarray:
        """Share of each edge in the weight of all paths to its end; places are filled from the left, all segments at once."""
        total, scale = np.zeros(rows), np.zeros(rows)  # weight of the paths to a row is total * exp(scale)
        total[:] = 1.0
        share = np.zeros(len(into))
        by_end = np.argsort(end.astype(np.uint16) if end.max(initial=0) < 1 << 16 else end, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(end[by_end])) + 1, [len(by_end)]])
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            e = by_end[lo:hi]
            if not len(e):
                continue
            begin = np.flatnonzero(np.concatenate([[True], into[e[1:]] != into[e[:-1]]]))
            width = np.diff(np.append(begin, len(e)))
            near = scale[source[e]]
            top = np.maximum.reduceat(near, begin)
            value = total[source[e]] * weight[e] * np.exp(near - np.repeat(top, width))
            sums = np.add.reduceat(value, begin)
            share[e] = value / np.repeat(sums, width)
            scale[into[e[begin]]] = top + np.log(sums)
        return share

    def sample(self, texts: list[str | None], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts after one another, and where each text's ids end."""
        return self.sample_array(pa.array([" " + t if t else "" for t in texts], pa.string()), keys)

    def sample_array(self, text: pa.StringArray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts that begin with the space that stands before every text; an empty one has no ids."""
        offsets = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, dtype=np.int64)
        held, flat, counts, done = text.buffers()[2], [], np.zeros(len(text), dtype=np.int64), (-1, 0)
        data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, dtype=np.uint8)
        a, end, base = int(offsets[0]), int(offsets[-1]), keys.view(np.uint64)
        while a < end:
            starts, z = _starts(data, offsets, a, min(end, a + CHUNK), end)
            own = np.searchsorted(offsets, starts, side="right") - 1
            fresh = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            number = np.arange(len(own)) - np.repeat(fresh, np.diff(np.append(fresh, len(own))))
            if own[0] == done[0]:  # a text that goes on
                number[own == own[0]] += done[1]
            done = int(own[-1]), int(number[-1]) + 1
            segments = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, z).astype(np.int32)), held)
            ids, drawn = self._drawn(segments, _mixed(base[own] ^ _mixed(number.astype(np.uint64))))
            flat.append(ids)
            counts += np.bincount(own, weights=drawn, minlength=len(counts)).astype(np.int64)
            a = z
        return np.concatenate(flat) if flat else np.zeros(0, dtype=np.int32), np.cumsum(counts)

    def _looked_up(self, segments: pa.StringArray, counts: np.ndarray) -> np.ndarray:
        """Row of place 0 of each of these different segments in the held tables; new ones are added, repeated ones to stay."""
        if self.edges >= HELD_EDGES:
            self._forget()
        rows = np.full(len(segments), -1, dtype=np.int64)
        if len(self.names):
            known = pc.index_in(segments, value_set=self.names).fill_null(-1).to_numpy(zero_copy_only=False)
            rows[known >= 0] = self.row0[known[known >= 0]]
        new = np.flatnonzero(rows < 0)
        if len(new):
            new = new[np.argsort(-np.minimum(counts[new], 2), kind="stable")]  # those to stay come first
            taken = segments.take(pa.array(new))
            row0, first_edge, run, back, ids = self.tables(taken)
            r, e = self.rows, self.edges
            self.first_edge, self.run = _put(self.first_edge, r, first_edge + e), _put(self.run, e, run)
            self.back, self.ids = _put(self.back, e, back.astype(np.int32)), _put(self.ids, e, ids.astype(np.int32))
            rows[new] = row0 + r
            stay = int((counts[new] > 1).sum())
            last = int(row0[stay]) if stay < len(new) else len(first_edge) - 1
            self.rows, self.edges = r + last, e + int(first_edge[last])
            self.names = pa.concat_arrays([self.names, taken[:stay]])
            self.row0 = np.concatenate([self.row0, row0[:stay] + r])
        return rows

    def _forget(self) -> None:
        self.names, self.row0, self.rows, self.edges = pa.array([], pa.string()), np.zeros(0, dtype=np.int64), 0, 0
        self.first_edge, self.run, self.back, self.ids = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)

    def _drawn(self, segments: pa.StringArray, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments after one another, and how many each has."""
        coded = segments.dictionary_encode()
        which, different = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        row = self._looked_up(different, np.bincount(which, minlength=len(different)))[which]
        pos = pc.utf8_length(different).to_numpy(zero_copy_only=False).astype(np.int64)[which]
        at, steps, step = np.arange(len(row)), [], 0
        drawn = np.zeros(len(row), dtype=np.int64)
        place, left, own = row + pos, pos, stream
        while len(at):
            hit = drawn_edges(self.first_edge, self.run, place, _mixed(own + np.uint64(step)) >> np.uint64(11))
            steps.append((at, self.ids[hit]))
            gone = self.back[hit]
            drawn[at] += 1
            left = left - gone
            more = np.flatnonzero(left > 0)
            at, left, place, own = at[more], left[more], (place - gone)[more], own[more]
            step += 1
        ends = np.cumsum(drawn)
        flat = np.zeros(int(ends[-1]), dtype=np.int32)
        for k, (i, piece) in enumerate(steps):
            flat[ends[i] - 1 - k] = piece
        odd = np.flatnonzero(flat < 0)
        if len(odd):  # spell the characters without a piece
            spelt = {c: [self.spelling[b] for b in chr(-1 - c).encode()] for c in np.unique(flat[odd]).tolist()}
            width = np.ones(len(flat), dtype=np.int64)
            width[odd] = [len(spelt[c]) for c in flat[odd].tolist()]
            after = np.cumsum(width)
            wide = np.repeat(flat, width)
            for k in range(4):
                far = odd[width[odd] > k]
                wide[after[far] - width[far] + k] = [spelt[c][k] for c in flat[far].tolist()]
            drawn = np.diff(np.concatenate([[0], after])[np.concatenate([[0], ends])])
            flat = wide
        return flat, drawn


def _put(array: np.ndarray, at: int, new: np.ndarray) -> np.ndarray:
    """``array`` with ``new`` from ``at`` on; it grows by half again when it is full and is written in place otherwise."""
    if at + len(new) > len(array):
        wider = np.zeros((at + len(new)) * 3 // 2, dtype=array.dtype)
        wider[:at] = array[:at]
        array = wider
    array[at : at + len(new)] = new
    return array


def _starts(data: np.ndarray, offsets: np.ndarray, a: int, z: int, end: int) -> tuple[np.ndarray, int]:
    """Places in a..z (bytes) where segments begin, the first at ``a``, and the end of the last whole one.

    A segment is a line break, spaces and the word after them, or spaces before a line break or the end.  It doesn't
    matter where a block ends: a long stretch is cut by its distance to the cut before.
    """
    b = data[a:z]
    before = np.concatenate([[10], b[:-1]])
    first = (b == 10) | (before == 10) | ((b == 32) & (before != 32))
    texts = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, z)]
    first[texts - a] = True
    starts = np.flatnonzero(first) + a
    long_ = np.flatnonzero(np.diff(np.append(starts, z)) > LONGEST)
    if len(long_):
        more, stops = [], np.append(starts, z)
        for k in long_.tolist():
            at = int(stops[k])
            while stops[k + 1] - at > LONGEST:
                at += LONGEST
                while data[at] & 0xC0 == 0x80:
                    at -= 1
                more.append(at)
        starts = np.sort(np.append(starts, more))
    return (starts, z) if z == end else (starts[:-1], int(starts[-1]))


def drawn_edges(first_edge: np.ndarray, run: np.ndarray, row: np.ndarray, u: np.ndarray) -> np.ndarray:
    """First edge of each row whose running share is above ``u`` (counted in 2^-53), by halving the row's own edges."""
    low, high = first_edge[row], first_edge[row + 1] - 1
    for _ in range(int((high - low).max(initial=0)).bit_length()):
        mid = (low + high) >> 1
        above = run[mid] > u
        low, high = np.where(above, low, mid + 1), np.where(above, mid, high)
    return low


def _mixed(x: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit numbers: neighbouring inputs give unrelated outputs."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chunks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows (first, after last) with about ``most`` units each."""
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)])


#: Lattices of a worker by model and alpha: a worker serves many tasks.
_LATTICES: dict[tuple[str, float], Lattice] = {}


def sampler(model: str = MODEL, alpha: float = 0.5):
    """Column function (text, key): ids of one sampled segmentation, null for a null text and none for an empty one."""
    pieces, _, spelling = vocabulary(model)

    @F.arrow_udf("array<int>")
    def ids(text: pa.Array, key: pa.Array) -> pa.Array:
        if (model, alpha) not in _LATTICES:
            _LATTICES[model, alpha] = Lattice(pieces, spelling, alpha)
        if not len(text):
            return pa.array([], pa.list_(pa.int32()))
        missing = text.is_null().to_numpy(zero_copy_only=False)
        flat, upto = _LATTICES[model, alpha].sample_array(pc.fill_null(text.cast(pa.string()), ""), key.to_numpy(zero_copy_only=False).astype(np.int64))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], upto]).astype(np.int32), mask=np.append(missing, False)), pa.array(flat))

    spread = ids.asNondeterministic()  # else Spark runs it again below each function of its result
    return lambda text, key: spread(F.when(F.col(text) != "", F.concat(F.lit(" "), text)).otherwise(F.col(text)), key)


def decoder(model: str = MODEL):
    """Column function (ids): the text they spell, exactly as it was encoded."""
    _, bytes_of, _ = vocabulary(model)
    size = np.zeros(max(bytes_of) + 1, dtype=np.int64)
    size[list(bytes_of)] = [len(b) for b in bytes_of.values()]
    spelt = np.frombuffer(b"".join(bytes_of[i] for i in sorted(bytes_of)), dtype=np.uint8)
    begin = np.cumsum(size) - size

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        if not len(ids):
            return pa.array([], pa.string())
        counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, out = pc.list_flatten(ids).to_numpy(zero_copy_only=False), []
        upto = np.concatenate([[0], np.cumsum(counts)])
        for a, z in _chunks(counts, CHUNK_IDS):
            part = flat[upto[a] : upto[z]]
            width = size[part]
            after = np.concatenate([[0], np.cumsum(width)])
            data = spelt[np.repeat(begin[part] - after[:-1], width) + np.arange(after[-1])]
            ends = after[upto[a : z + 1] - upto[a]]
            full = np.diff(ends) > 0
            data = np.delete(data, ends[:-1][full])  # the space that stands before every text
            ends = np.concatenate([[0], ends[1:] - np.cumsum(full)]).astype(np.int32)
            made = pa.StringArray.from_buffers(z - a, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))
            out.append(pc.if_else(ids[a:z].is_null(), pa.scalar(None, pa.string()), made))
        return pa.concat_arrays(out)

    return text


def row_key(doc_id: Column, seed: int) -> Column:
    return F.xxhash64(doc_id, F.lit(seed))


def encode(docs: DataFrame, seed: int = 0, alpha: float = 0.5, model: str = MODEL, into: str = "piece_ids") -> DataFrame:
    """``docs`` with ``into``, one sampled segmentation of ``text`` seeded by ``doc_id``.

    A null text has null ids, an empty one no ids; repeated rows get the same segmentation, a null doc_id is one more
    key; an empty table stays empty.  A text may be as long as a row can be: it is worked on in blocks, and a stretch
    of over LONGEST bytes without space or line break is cut, so no piece spans such a cut.  Characters without a
    piece, and a literal U+2581, are spelt in byte pieces.  Columns are kept, but for one named ``into``, which is
    replaced.
    """
    short_batches(docs.sparkSession)
    return docs.withColumn(into, sampler(model, alpha)("text", row_key(F.col("doc_id"), seed)))


def decode(coded: DataFrame, model: str = MODEL, into: str = "decoded", ids: str = "piece_ids") -> DataFrame:
    """``coded`` with column ``into``, the text of ``ids``; equal to the text that was encoded.

    Null ids give null, no ids the empty text.  Columns are kept, but for one named ``into``, which is replaced.
    """
    short_batches(coded.sparkSession)
    return coded.withColumn(into, decoder(model)(ids))
