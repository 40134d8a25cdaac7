"""SentencePiece BPE encoding with seeded merge dropout, and lossless decoding.

The vocabulary is read from a model file; nothing is trained. A text gets a
space in front, spaces become the model's space mark, and characters outside the
vocabulary become byte pieces. A unit is a run of spaces with the characters
that follow it, up to the next space or line feed; no piece of the vocabulary
reaches over the end of a unit (the loader checks that), so units are segmented
on their own.

In a unit's agenda the adjacent pairs that form a piece wait in order of the
piece's score, ties from the left. A candidate merge is skipped for good if a
keyed hash of the seed, the document, the unit, the candidate's place and its
piece falls below ``dropout``. The same unit thus has the same segmentation
within a document, and others in other documents; reruns agree. With dropout 0
the ids equal the library's.

Units of many documents are processed together, one array operation for a step
of all their agendas; units of over 64 characters take a heap instead. Every
segmentation decodes to the text, byte for byte: pieces are joined, the mark
becomes a space again, and the space in front goes. A mark that stands in the
text is written as three byte pieces, so that it comes back as itself. Bytes
that are not UTF-8 are byte pieces.

A null text is the empty text, with no pieces. Null ids hash as the empty text.
Empty tables give empty results, repeated rows repeated results.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoengine.llm.common import utf8

MARK = "▁"
UNIT = re.compile(" +[^ \n▁]*|[^ \n▁]+|\n|▁")
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a unit that arrays hold, and characters of units segmented together.
WIDE, GROUP = 64, 1 << 20
NEVER = np.int32(2**31 - 1)


#: Odd multipliers that tell a unit's characters and their order apart.
POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, WIDE + 1)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer of 64-bit hashes, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Model:
    """Pieces and merges of a SentencePiece BPE model file."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        special = [m.is_control(i) or m.is_unknown(i) or m.is_unused(i) for i in range(n)]
        byte = [m.is_byte(i) for i in range(n)]
        pieces = [m.id_to_piece(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(pieces) if not special[i] and not byte[i]}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(pieces) if byte[i]}
        if len(self.bytes) != 256 or any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            raise ValueError("the model needs all byte pieces, and none that reaches over a space or line feed")
        scores = np.array([m.get_score(i) for i in range(n)])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        raw = [bytes([int(p[3:5], 16)]) if byte[i] else b"" if special[i] else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(x) for x in raw])
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.char[32] = self.ids[MARK]
        pairs = [(self.ids[p[:k]], self.ids[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        self._table(np.array(pairs, np.int64).reshape(-1, 3))

    def _table(self, pairs: np.ndarray) -> None:
        """Open addressing: pair (a, b) to piece, probed a fixed number of times."""
        key = pairs[:, 0] << 32 | pairs[:, 1]
        self.bits = max(4, int(4 * len(key)).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        slot, left, self.probes = self._slot(key), np.arange(len(key)), 0
        while left.size:
            at = (slot[left] + self.probes) & size - 1
            first = np.unique(at, return_index=True)[1]
            put = first[self.keys[at[first]] == -1]
            self.keys[at[put]], self.values[at[put]] = key[left[put]], pairs[left[put], 2]
            left = np.delete(left, put)
            self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that a and b form, or -1."""
        key = a.astype(np.int64) << 32 | b.astype(np.int64) & 0xFFFFFFFF
        slot, out = self._slot(key), np.full(key.shape, -1, np.int32)
        left = np.flatnonzero((a.ravel() >= 0) & (b.ravel() >= 0))
        key, slot, flat = key.ravel(), slot.ravel(), out.ravel()
        for n in range(self.probes):
            at = (slot[left] + n) & (1 << self.bits) - 1
            found = self.keys[at]
            hit = found == key[left]
            flat[left[hit]] = self.values[at[hit]]
            left = left[~hit & (found != -1)]
            if not left.size:
                break
        return flat.reshape(out.shape)

    def candidates(self, a: np.ndarray, b: np.ndarray, place: np.ndarray, key: np.ndarray, drop: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """(piece, rank in the agenda) of pairs; those that form none or are skipped never come up."""
        piece = self.merged(a, b)
        rank = np.where(piece >= 0, self.rank[piece], NEVER)
        if drop:
            h = mix(key + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + piece.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            rank[h < drop] = NEVER
        return piece, rank

    def segment(self, symbols: np.ndarray, keys: np.ndarray, drop: np.uint64) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Merge rows of equally many symbols to the end: (rows, their symbols, their places), by rows that end together."""
        done, rows, s = [], np.arange(len(symbols)), symbols
        place = np.broadcast_to(np.arange(s.shape[1], dtype=np.int32), s.shape)
        piece, rank = self.candidates(s[:, :-1], s[:, 1:], place[:, :-1], keys[:, None], drop)
        while True:
            if s.shape[1] == 1:
                done.append((rows, s, place))
                break
            j = rank.argmin(axis=1)
            live = np.take_along_axis(rank, j[:, None], 1)[:, 0] != NEVER
            if not live.all():
                done.append((rows[~live], s[~live], place[~live]))
                rows, s, place, piece, rank, keys, j = rows[live], s[live], place[live], piece[live], rank[live], keys[live], j[live]
            if not rows.size:
                break
            n, width = np.arange(rows.size), s.shape[1]
            new = piece[n, j]
            cols = np.arange(width - 1)[None, :] + (np.arange(width - 1)[None, :] > j[:, None])
            s, place = np.take_along_axis(s, cols, 1), np.take_along_axis(place, cols, 1)
            s[n, j] = new
            if width == 2:
                continue
            cols = np.arange(width - 2)[None, :] + (np.arange(width - 2)[None, :] >= j[:, None])
            piece, rank = np.take_along_axis(piece, cols, 1), np.take_along_axis(rank, cols, 1)
            r, c = np.r_[n[j > 0], n[j < width - 2]], np.r_[(j - 1)[j > 0], j[j < width - 2]]
            piece[r, c], rank[r, c] = self.candidates(s[r, c], s[r, c + 1], place[r, c], keys[r], drop)
        return done

    def heap(self, symbols: list[int], key: int, drop: np.uint64) -> list[tuple[int, int]]:
        """One unit of any length: (symbol, place) with an agenda in a heap."""
        n = len(symbols)
        symbol, before, after, size = list(symbols), list(range(-1, n - 1)), list(range(1, n + 1)), [1] * n
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(left: np.ndarray) -> None:
            if left.size:
                right = np.array([after[x] for x in left.tolist()])
                piece, rank = self.candidates(np.array([symbol[x] for x in left.tolist()]), np.array([symbol[x] for x in right.tolist()]), left, np.full(left.size, key, np.uint64), drop)
                for x, y, p, r in zip(left.tolist(), right.tolist(), piece.tolist(), rank.tolist()):
                    if r != NEVER:
                        heapq.heappush(agenda, (r, x, p, size[x], size[y]))

        offer(np.arange(n - 1))
        while agenda:
            _, x, p, a, b = heapq.heappop(agenda)
            y = after[x] if size[x] else n
            if not size[x] or size[x] != a or y >= n or size[y] != b:
                continue  # one of the two has been merged since
            symbol[x], size[x], size[y] = p, a + b, 0
            after[x] = after[y]
            if after[x] < n:
                before[after[x]] = x
            offer(np.array([z for z in (before[x], x) if z >= 0 and after[z] < n], dtype=np.int64))
        return [(symbol[x], x) for x in range(n) if size[x]]

    def units(self, units: list[str], docs: np.ndarray, drop: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units one after the other, and how many each has. docs: the key of each unit's document."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.cumsum(sizes) - sizes
        symbols = self.char[points]
        # a mark in the text is no space: it gets byte pieces
        symbols[points == ord(MARK)] = -1
        order, out_unit, out_place, out_id = np.argsort(sizes, kind="stable"), [], [], []
        bounds = np.flatnonzero(np.diff(sizes[order])) + 1
        for group in np.split(order, bounds) if len(units) else ():
            width = int(sizes[group[0]])
            if width <= WIDE:
                chars = starts[group][:, None] + np.arange(width)
                keys = mix(docs[group] ^ (points[chars] * POWERS[:width]).sum(axis=1, dtype=np.uint64)) if drop else docs[group]
                for rows, s, place in self.segment(symbols[chars], keys, drop):
                    out_unit.append(np.repeat(group[rows], s.shape[1]))
                    out_place.append((starts[group[rows]][:, None] + place).ravel())
                    out_id.append(s.ravel())
            else:
                for u in group.tolist():
                    got = self.heap(symbols[starts[u] : starts[u] + width].tolist(), int(mix(docs[u : u + 1] ^ np.uint64(xxhash.xxh64_intdigest(points[starts[u] : starts[u] + width].tobytes())))[0]), drop)
                    out_unit.append(np.full(len(got), u))
                    out_place.append(np.array([starts[u] + p for _, p in got]))
                    out_id.append(np.array([i for i, _ in got], np.int32))
        if not out_id:
            return np.zeros(0, np.int32), np.zeros(len(units), np.int64)
        unit, place, ids = np.concatenate(out_unit), np.concatenate(out_place), np.concatenate(out_id)
        # back in the order of the units' characters
        at = np.full(points.size, -2, np.int32)
        owner = np.zeros(points.size, np.int64)
        at[place], owner[place] = ids, unit
        there = np.flatnonzero(at != -2)
        ids, unit = at[there], owner[there]
        unknown = np.flatnonzero(ids == -1)
        if unknown.size:
            spelled = [[self.bytes[x] for x in chr(points[there[k]]).encode("utf-8", "surrogateescape")] for k in unknown.tolist()]
            times = np.ones(ids.size, np.int64)
            times[unknown] = [len(x) for x in spelled]
            ids, unit = np.repeat(ids, times), np.repeat(unit, times)
            ids[ids == -1] = np.concatenate(spelled)
        return ids, np.bincount(unit, minlength=len(units))

    def encode(self, texts: list[bytes], keys: list[int], dropout: float) -> list[np.ndarray]:
        """Ids of each text. keys: a number for each text that its choices depend on."""
        drop = np.uint64(min(int(dropout * 2**64), 2**64 - 1))
        out: list[np.ndarray] = []
        units: list[str] = []
        counts: list[int] = []
        waiting: list[np.ndarray] = []

        def flush() -> None:
            own_keys = np.array(keys[len(out) : len(out) + len(counts)], np.uint64)
            ids, sizes = self.units(units, np.repeat(own_keys, counts), drop)
            starts = np.cumsum(sizes) - sizes
            first = 0
            for n, index in zip(counts, waiting):
                own = index + first
                out.append(gathered(ids, starts[own], sizes[own]))
                first += n
            units.clear(), counts.clear(), waiting.clear()

        size = 0
        for text in texts:
            words = UNIT.findall(" " + text.decode("utf-8", "surrogateescape")) if text else []
            numbers = dict(zip(dict.fromkeys(words), range(len(words))))
            waiting.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
            units.extend(numbers)
            counts.append(len(numbers))
            size += len(text)
            if size >= GROUP:
                flush()
                size = 0
        flush()
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of a sequence of ids."""
        data = gathered(self.raw, self.raw_start[ids], self.raw_size[ids]).tobytes()
        return data[1:] if data.startswith(b" ") else data


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices of ``flat`` one after the other."""
    total = int(sizes.sum())
    before = np.cumsum(sizes) - sizes
    return flat[np.repeat(starts - before, sizes) + np.arange(total)]


@cache
def load(path: str) -> Model:
    return Model(path)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", dropout: float = 0.1, seed: int = 11, model: str = MODEL, name: str = "ids", check: bool = False) -> DataFrame:
    """``df`` with ids (array<int>) of each text; with ``check`` also lossless: whether they decode to the text's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for b in batches:
            n = b.num_columns - 2
            texts = [t.as_buffer().to_pybytes() for t in b.column(n)]
            keys = [xxhash.xxh64_intdigest(str("" if k is None else k), seed) for k in b.column(n + 1).to_pylist()]
            for k in range(0, max(1, len(texts)), 1024):
                part = texts[k : k + 1024]
                ids = m.encode(part, keys[k : k + 1024], dropout)
                offsets = np.r_[0, np.cumsum([x.size for x in ids])].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))
                extra = [pa.array([m.decode(x) == t for x, t in zip(ids, part)], pa.bool_())] if check else []
                yield pa.RecordBatch.from_arrays([*(c.slice(k, len(part)) for c in b.columns[:n]), lists, *extra], names=[f"c{i}" for i in range(n)] + ["ids"] + ["lossless"] * check)

    inner = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)], utf8(text_col).alias("__t"), F.col(id_col).alias("__k"))
    schema = ", ".join([f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(df.schema.fields)] + ["ids array<int>"] + ["lossless boolean"] * check)
    return inner.mapInArrow(run, schema).toDF(*df.columns, name, *["lossless"] * check)


def decode(df: DataFrame, ids_col: str = "ids", model: str = MODEL, name: str = "decoded") -> DataFrame:
    """``df`` with the text of each array of ids; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for b in batches:
            n = b.num_columns - 1
            texts = [m.decode(x.values.to_numpy().astype(np.int64)).decode("utf-8", "replace") if x.is_valid else None for x in b.column(n)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(texts, pa.string())], names=[f"c{i}" for i in range(n)] + ["text"])

    inner = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)], F.col(ids_col).alias("__ids"))
    schema = ", ".join([f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(df.schema.fields)] + ["text string"])
    return inner.mapInArrow(run, schema).toDF(*df.columns, name)
