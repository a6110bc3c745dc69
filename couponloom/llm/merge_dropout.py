"""SentencePiece encoding with seeded merge-dropout, and its lossless decoding.

A text is encoded as the model's own byte-pair encoder does it: spaces become U+2581, one is
put in front, and an agenda of adjacent pairs merges the best scored piece first, the
leftmost of equals. With dropout, a candidate taken from the agenda is skipped when a keyed
hash of (seed, text, place of the unit, its two ends) falls below the rate, and is not offered
again. Rate 0 gives the model's plain encoding. A unit is what merges can never leave: it ends
where two characters follow each other that no piece holds together. Every occurrence draws
for itself, so a word is segmented in as many ways as its candidates allow, and the same seed
gives the same ids on any cluster. What follows from the same skipped candidates of a unit is
merged once and remembered; draws and merges of many units are made at once in numpy.

Decoding joins the pieces: U+2581 becomes a space, byte pieces become bytes, the space put in
front is dropped. A U+2581 of the text itself is always encoded by byte pieces, so decoding
gives every text back exactly.

Contract: null texts are encoded as empty ones and decode to empty texts; empty texts have no
ids. Rows that repeat are encoded alike.
Rows keep all their columns in the struct `row`.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from couponloom.llm.text import appended, ragged

SPACE = "▁"
_RAW = SPACE.encode()
_MASK = (1 << 64) - 1
_ODD = 0x9E3779B97F4A7C15
_MIX = 0xBF58476D1CE4E5B9
#: Outcomes of units remembered by a task.
MEMORY = 250_000


_NEVER = float("inf")
_SHORT = 128
#: Bytes from which a unit is merged anew for each occurrence: its outcomes hardly repeat.
_LONG = 32
#: Occurrences whose draws are made at once.
_AT_ONCE = 1 << 16


def _mark(start: int, end: int) -> int:
    """A candidate by its two ends."""
    return start << 32 | end


def _draw(key: int, mark: int) -> int:
    """The keyed hash of a candidate; the key is a hash itself."""
    x = (key ^ mark) * _ODD & _MASK
    return (x ^ x >> 32) * _MIX & _MASK


def _draws(keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The same for many."""
    x = (keys ^ marks) * np.uint64(_ODD)
    x ^= x >> np.uint64(32)
    x *= np.uint64(_MIX)
    return x


def _limit(rate: float) -> int:
    """Candidates whose hash is below it are skipped."""
    return int(rate * (_MASK + 1))


class PieceModel:
    """Pieces, scores and bytes of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        pieces = [model.id_to_piece(i) for i in ids]
        self.bytes = {int(pieces[i][3:-1], 16): i for i in ids if model.is_byte(i)}
        usual = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if len(self.bytes) < 256:
            raise ValueError("the model has no byte pieces")
        if model.vocab_size() > 1 << 16:
            raise ValueError("ids of more than 65,536 pieces do not fit into 16 bits")
        self.ids = {pieces[i]: i for i in usual}
        #: Place of a piece on the agenda: the best score is the smallest.
        self.ranks = {pieces[i]: -model.get_score(i) for i in usual}
        self.output = [b""] * model.vocab_size()
        for value, i in self.bytes.items():
            self.output[i] = bytes([value])
        for i in usual:
            self.output[i] = pieces[i].replace(SPACE, " ").encode()
        self.joins = self._pairs_that_join()
        self._tables()

    def _pairs_that_join(self) -> np.ndarray:
        """For two bytes of a text, at first << 8 | second, whether any piece holds both together.

        A space stands for U+2581. All bytes of other characters count as one; where two
        characters never are neighbours in a piece, no merge crosses them.
        """
        pairs = np.zeros((256, 256), dtype=bool)
        pairs[0x80:, 0x80:] = True

        def bytes_of(c: str) -> slice:
            first = 0x20 if c == SPACE else ord(c)
            return slice(first, first + 1) if first < 0x80 else slice(0x80, 256)

        for piece in self.ids:
            for one, two in zip(piece, piece[1:]):
                pairs[bytes_of(one), bytes_of(two)] = True
        return pairs.ravel()

    def _tables(self) -> None:
        """Merges of two symbols in arrays; a symbol is a piece's id, or vocabulary + byte for one that is no piece."""
        size = len(self.output)
        number = {chr(b): size + b for b in range(128)} | self.ids
        #: Symbol of each character of a text; -1 for those whose bytes are no single piece.
        self._first = np.full(0x110000, -1, dtype=np.int64)
        for c, i in number.items():
            if len(c) == 1:
                self._first[ord(c)] = i
        self._first[[0x20, ord(SPACE)]] = self.ids.get(SPACE, -1), -1
        self._single = frozenset(map(chr, np.flatnonzero(self._first >= 0).tolist()))
        merges = sorted(
            (number[p[:k]] << 32 | number[p[k:]], i)
            for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number
        )
        self._pairs = np.array([pair for pair, _ in merges] + [1 << 62], dtype=np.int64)
        self._merged = np.array([i for _, i in merges] + [0], dtype=np.int64)
        self._ranks = np.full(size, _NEVER)
        self._ranks[list(self.ids.values())] = [self.ranks[p] for p in self.ids]
        self._stored = np.concatenate([np.arange(size), [self.bytes[b] for b in range(128)]])

    def _offered(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and number of the pieces that two symbols give; -1 is no symbol."""
        pair = left << 32 | right
        place = np.searchsorted(self._pairs, pair)
        merged = self._merged[place]
        return np.where((self._pairs[place] == pair) & (left >= 0) & (right >= 0), self._ranks[merged], _NEVER), merged

    def together(self, unit: bytes) -> bool:
        """Whether `outcomes` takes the unit."""
        return len(unit) < _LONG and (unit.isascii() and SPACE in self.ids or self._single.issuperset(unit.decode()))

    def outcomes(self, origin: list[tuple[bytes, tuple[int, ...]]]) -> tuple[np.ndarray, ...]:
        """`outcome` of many units that it takes: ids, how many each has, candidates, how many each has."""
        units = [unit.decode() for unit, _ in origin]
        lengths = np.array([len(unit) for unit in units])
        n, width = len(units), int(lengths.max())
        joined = np.frombuffer("".join(units).encode("utf-32-le"), "<u4")
        at = np.arange(width + 2)
        symbols = np.full((n, width + 2), -1, dtype=np.int64)
        symbols[at[None] < lengths[:, None]] = self._first[joined]
        after = np.minimum(at[None] + 1, lengths[:, None])
        before = np.repeat(at[None] - 1, n, axis=0)
        n_skipped = np.array([len(s) for _, s in origin])
        skips = np.full((n, max(1, int(n_skipped.max()))), -1, dtype=np.int64)
        skips[np.arange(skips.shape[1])[None] < n_skipped[:, None]] = [m for _, s in origin for m in s]
        ranks, merged = np.full(symbols.shape, _NEVER), np.zeros(symbols.shape, dtype=np.int64)
        ranks[:, :-1], merged[:, :-1] = self._offered(symbols[:, :-1], symbols[:, 1:])
        passed, own, taken = np.zeros(n, dtype=np.int64), np.arange(n), []
        while len(own):
            i = ranks[own].argmin(axis=1)
            going = ranks[own, i] < _NEVER
            own, i = own[going], i[going]
            j = after[own, i]
            end = after[own, j]
            mark = i << 32 | end
            skip = (skips[own] == mark[:, None]).any(axis=1)
            open_ = ~skip & (passed[own] == n_skipped[own])
            taken.append((own[open_], mark[open_]))
            passed[own] += skip
            ranks[own[skip], i[skip]] = _NEVER
            u, i, j, end = own[~skip], i[~skip], j[~skip], end[~skip]
            symbols[u, i] = merged[u, i]
            symbols[u, j], ranks[u, j] = -1, _NEVER
            after[u, i], before[u, end] = end, i
            ranks[u, i], merged[u, i] = self._offered(symbols[u, i], symbols[u, end])
            ahead = i > 0
            u, i = u[ahead], i[ahead]
            b = before[u, i]
            ranks[u, b], merged[u, b] = self._offered(symbols[u, b], symbols[u, i])
        whose, marks = (np.concatenate(x) for x in zip(*taken, strict=True)) if taken else (own, own)
        kept = symbols >= 0
        return (self._stored[symbols[kept]], kept.sum(axis=1), marks[np.argsort(whose, kind="stable")],
                np.bincount(whose, minlength=n))

    def encode_unit(self, unit: str, rate: float, key: int) -> list[int]:
        """Ids of a unit; `key` is the hash of seed, text and place."""
        limit = _limit(rate)
        if len(unit) > _SHORT:
            return self._ids_of(self._merge_long(unit, limit, key))
        return self._ids_of(self._merge(unit, (lambda mark: _draw(key, mark) < limit) if limit else None)[0])

    def outcome(self, unit: bytes, skipped: tuple[int, ...]) -> tuple[list[int], list[int]]:
        """Ids of a unit of which these candidates are skipped, and those taken after the last of them."""
        if unit == _RAW:
            return self.encode_bytes(unit, 0.0, 0), []
        symbols, taken = self._merge(unit.decode().replace(" ", SPACE), skipped.__contains__ if skipped else None)
        return self._ids_of(symbols), taken[taken.index(skipped[-1]) + 1 :] if skipped else taken

    def _ids_of(self, symbols: list[str]) -> list[int]:
        out = []
        for symbol in symbols:
            i = self.ids.get(symbol)
            if i is not None:
                out.append(i)
            else:
                out += [self.bytes[b] for b in symbol.encode()]
        return out

    def _merge(self, unit: str, skips: Callable[[int], bool] | None) -> tuple[list[str], list[int]]:
        """Symbols after the merges and the candidates taken; the agenda has a rank for each pair of neighbours."""
        rank, symbols, place, taken = self.ranks.get, list(unit), list(range(len(unit) + 1)), []
        agenda = [rank(a + b, _NEVER) for a, b in zip(symbols, symbols[1:])]
        while agenda:
            best = min(agenda)
            if best == _NEVER:
                break
            i = agenda.index(best)
            taken.append(_mark(place[i], place[i + 2]))
            if skips and skips(taken[-1]):
                agenda[i] = _NEVER
                continue
            symbols[i] += symbols.pop(i + 1)
            del place[i + 1], agenda[i]
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + symbols[i], _NEVER)
            if i < len(agenda):
                agenda[i] = rank(symbols[i] + symbols[i + 1], _NEVER)
        return symbols, taken

    def _merge_long(self, unit: str, limit: int, key: int) -> list[str]:
        """The same with the agenda in a heap, for units where a scan of it would be long."""
        symbols: list[str | None] = list(unit)
        n = len(symbols)
        after, before, agenda = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < n:
                piece = symbols[left] + symbols[right]
                if (rank := self.ranks.get(piece)) is not None:
                    heapq.heappush(agenda, (rank, left, right, piece))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, left, right, piece = heapq.heappop(agenda)
            a, b = symbols[left], symbols[right]
            if a is None or b is None or len(a) + len(b) != len(piece) or after[left] != right:
                continue
            if limit and _draw(key, _mark(left, right + len(b))) < limit:
                continue
            symbols[left], symbols[right] = piece, None
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [s for s in symbols if s is not None]

    def encode_bytes(self, unit: bytes, rate: float, key: int) -> list[int]:
        """Ids of a unit of a text, where a space is a space."""
        if unit == _RAW:
            return [self.bytes[b] for b in unit]
        return self.encode_unit(unit.decode().replace(" ", SPACE), rate, key)

    def decode(self, ids: np.ndarray) -> bytes:
        """Text of the ids."""
        joined = b"".join(map(self.output.__getitem__, ids.tolist()))
        return joined[1:] if joined[:1] == b" " else joined


def unit_starts(content: bytes, texts: np.ndarray, joins: np.ndarray) -> np.ndarray:
    """First bytes of the units of texts, each with a space in front, one after the other."""
    buffer = np.frombuffer(content, np.uint8)
    start = np.ones(len(buffer), dtype=bool)
    np.logical_not(joins[buffer[:-1].astype(np.uint16) << np.uint16(8) | buffer[1:]], out=start[1:])
    start[texts] = True
    if _RAW in content:
        raw = np.flatnonzero((buffer[:-2] == _RAW[0]) & (buffer[1:-1] == _RAW[1]) & (buffer[2:] == _RAW[2]))
        start[raw] = True
        start[raw[raw + 3 < len(buffer)] + 3] = True
    return np.flatnonzero(start)


class Growing:
    """An array that values are added to; its room doubles."""

    def __init__(self, kind: type):
        self._room, self.size = np.zeros(1024, dtype=kind), 0

    @property
    def held(self) -> np.ndarray:
        """The values so far, which may be written to."""
        return self._room[: self.size]

    def add(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self._room):
            room = np.zeros(max(end, 2 * len(self._room)), dtype=self._room.dtype)
            room[: self.size] = self.held
            self._room = room
        self._room[self.size : end] = values
        self.size = end


class Encoder:
    """Encodes texts, remembering the outcomes of units.

    The outcomes of a unit are a tree: its root is the plain encoding, a child is what follows
    when one candidate of its parent is skipped and none before it. An occurrence goes down
    by its own draws until it skips nothing more.
    """

    def __init__(self, path: str, rate: float, seed: int, memory: int = MEMORY):
        self.model, self.rate = _model(path), rate
        self._limit, self._seed, self._memory = _limit(rate), seed, memory
        self._forget()

    def _forget(self) -> None:
        self._roots: dict[bytes, int] = {}
        #: Of each outcome: its unit and skipped candidates, its ids, the candidates it can still skip.
        self._from: list[tuple[bytes, tuple[int, ...]]] = []
        self._ids = Growing(np.uint16)
        self._starts, self._lengths = Growing(np.int64), Growing(np.int64)
        self._marks, self._children = Growing(np.uint64), Growing(np.int64)
        self._firsts, self._counts = Growing(np.int64), Growing(np.int64)

    def _add(self, origin: list, ids: np.ndarray, lengths: np.ndarray, marks: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Numbers of new outcomes."""
        number = len(self._from) + np.arange(len(origin))
        self._from += origin
        self._starts.add(self._ids.size + np.cumsum(lengths) - lengths)
        self._lengths.add(lengths)
        self._ids.add(ids)
        self._firsts.add(self._marks.size + np.cumsum(counts) - counts)
        self._counts.add(counts)
        self._marks.add(marks)
        self._children.add(np.full(len(marks), -1))
        return number

    def _add_each(self, origin: list, found: list[tuple[list[int], list[int]]]) -> np.ndarray:
        """The same for ids and candidates one by one."""
        return self._add(
            origin, np.array([i for ids, _ in found for i in ids], dtype=np.int64),
            np.array([len(ids) for ids, _ in found], dtype=np.int64),
            np.array([m for _, marks in found for m in marks], dtype=np.int64),
            np.array([len(marks) for _, marks in found], dtype=np.int64),
        )

    def _learn(self, origin: list[tuple[bytes, tuple[int, ...]]]) -> np.ndarray:
        """Numbers of new outcomes of units and skipped candidates."""
        number = np.empty(len(origin), dtype=np.int64)
        together = np.fromiter((self.model.together(unit) for unit, _ in origin), bool, len(origin))
        places = np.flatnonzero(together)
        for at in range(0, len(places), _AT_ONCE):
            part = places[at : at + _AT_ONCE]
            own = [origin[k] for k in part.tolist()]
            number[part] = self._add(own, *self.model.outcomes(own))
        others = np.flatnonzero(~together)
        own = [origin[k] for k in others.tolist()]
        number[others] = self._add_each(own, [self.model.outcome(*x) if self._shared(x[0]) else ([], []) for x in own])
        return number

    def _plain(self, names: list[bytes]) -> np.ndarray:
        """Roots of the units."""
        if len(self._from) > self._memory:
            self._forget()
        new = [name for name in names if name not in self._roots]
        self._roots.update(zip(new, self._learn([(name, ()) for name in new]).tolist(), strict=True))
        return np.fromiter(map(self._roots.__getitem__, names), np.int64, len(names))

    def _shared(self, unit: bytes) -> bool:
        return not self._limit or len(unit) < _LONG

    def _keys(self, texts: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Key of each unit, from seed, text and place in the text."""
        state = np.array([xxhash.xxh3_64_intdigest(t, self._seed & _MASK) for t in texts], dtype=np.uint64)
        place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        x = np.repeat(state, counts) + place.astype(np.uint64) * np.uint64(_ODD)
        return (x ^ x >> np.uint64(29)) * np.uint64(_MIX)

    def _skip(self, nodes: np.ndarray, keys: np.ndarray) -> None:
        """Put the outcomes that the keys draw in place of the roots."""
        asked = np.arange(len(nodes))
        while len(asked):
            own = nodes[asked]
            counts = self._counts.held[own]
            place, asker = ragged(self._firsts.held[own], counts), np.repeat(asked, counts)
            skipped = np.ones(len(place), dtype=bool)
            if self._limit <= _MASK:
                skipped = _draws(keys[asker], self._marks.held[place]) < np.uint64(self._limit)
            place, asker = place[skipped], asker[skipped]
            first = np.ones(len(asker), dtype=bool)
            first[1:] = asker[1:] != asker[:-1]
            place, asked = place[first], asker[first]
            new = np.unique(place[self._children.held[place] < 0])
            if len(new):
                parents = (np.searchsorted(self._firsts.held, new, side="right") - 1).tolist()
                origin = [
                    (self._from[parent][0], (*self._from[parent][1], mark))
                    for parent, mark in zip(parents, self._marks.held[new].tolist(), strict=True)
                ]
                found = self._learn(origin)
                self._children.held[new] = found
            nodes[asked] = self._children.held[place]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 16-bit integers."""
        full = [t for t in texts if t]
        if not full:
            return [b""] * len(texts)
        content = b" " + b" ".join(full)
        sizes = np.array([len(t) + 1 for t in full], dtype=np.int64)
        firsts = np.cumsum(sizes) - sizes
        starts = unit_starts(content, firsts, self.model.joins)
        counts = np.diff(np.append(np.searchsorted(starts, firsts), len(starts)))
        offsets = np.append(starts, len(content)).astype(np.int64)
        units = pa.Array.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(content)]
        ).dictionary_encode()
        names = units.dictionary.to_pylist()
        unit = units.indices.to_numpy(zero_copy_only=False)
        own = self._plain(names)[unit]
        if self._limit:
            keys = self._keys(full, counts)
            for at in range(0, len(own), _AT_ONCE):
                self._skip(own[at : at + _AT_ONCE], keys[at : at + _AT_ONCE])
            alone = np.flatnonzero(~np.fromiter(map(self._shared, names), bool, len(names))[unit])
            origin = [(names[k], ()) for k in unit[alone].tolist()]
            found = [
                (self.model.encode_bytes(name, self.rate, key), [])
                for (name, _), key in zip(origin, keys[alone].tolist(), strict=True)
            ]
            own[alone] = self._add_each(origin, found)
        lengths = self._lengths.held[own]
        ids = self._ids.held[ragged(self._starts.held[own], lengths)].astype("<u2").tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(counts)] * 2
        done = iter([ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)])
        return [next(done) if t else b"" for t in texts]


@cache
def _model(path: str) -> PieceModel:
    return PieceModel(path)


def _texts(found: list[str | None]) -> pa.Array:
    return pa.array(found, pa.large_binary()).cast(pa.large_string()).cast(pa.string())


def encode(
    docs: DataFrame, model: str, text: str = "text", rate: float = 0.1, seed: int = 1, with_text: bool = False
) -> DataFrame:
    """Each row of docs with `ids`: u16 little-endian piece ids of its whole text.

    `with_text` adds `decoded`, the text of those ids, as `decode` does, but in the same map.
    """

    def make():
        # One for each task: what it remembers goes with the task.
        encoder, pieces = Encoder(model, rate, seed), _model(model)

        def compute(texts: list[bytes]) -> list[pa.Array]:
            ids = encoder.encode(texts)
            columns = [pa.array(ids, pa.binary())]
            return [*columns, _texts([pieces.decode(np.frombuffer(x, "<u2")) for x in ids])] if with_text else columns

        return compute

    return appended(docs, text, make, "ids binary, decoded string" if with_text else "ids binary")


def decode(rows: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """All columns of rows with `decoded`: the text of their ids."""

    def run(batches):
        pieces = _model(model)
        for batch in batches:
            found = [
                None if x is None else pieces.decode(np.frombuffer(x, "<u2")) for x in batch.column(ids).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, _texts(found)], names=[*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))


def digest(coded: DataFrame) -> DataFrame:
    """Ids counted and summed up as they are stored, and the text they decode to held against the text."""
    source = F.coalesce(F.col("row.text"), F.lit(""))
    return coded.select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        (F.octet_length("ids") / 2).cast("long").alias("n_ids"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        (F.col("decoded") == source).alias("lossless"),
    )


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all `documents` with merge-dropout of 0.1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = piece_model()
    return digest(encode(docs, model, with_text=True))
