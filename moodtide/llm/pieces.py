"""SentencePiece BPE encoding and decoding by vectorised merge rounds over flat symbol arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import plain_text, slices

#: The mark that stands for a space inside pieces (fixed by the model format).
MARK = "▁"
#: A text is cut before each run of marks and around line feeds; no piece reaches across (checked when the model is read).
_SEGMENT = re.compile(rf"\n|{MARK}*[^{MARK}\n]*")
#: Characters handled at once, so that neither long texts nor large batches grow the arrays.
SLICE = 1 << 20
#: Bytes of text whose ids are sent on at once beside the other columns.
PART = 1 << 18
#: Segments remembered between the batches of a task.
REMEMBERED = 125_000
_NONE = np.int32(2**31 - 1)


def _gathered(values: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``values`` between the offsets ``at`` that ``which`` names, one after the other, and where each ends."""
    start = at[which]
    size = at[which + 1] - start
    ends = np.cumsum(size)
    return values[np.arange(ends[-1] if ends.size else 0) + np.repeat(start - (ends - size), size)], ends


def _room(values: np.ndarray, size: int) -> np.ndarray:
    """The array with room for ``size`` values."""
    if size <= values.size:
        return values
    return np.concatenate([values, np.zeros(max(values.size, size - values.size), values.dtype)])


class PieceCoder:
    """Encodes and decodes as the library does with the same model file: byte fallback, identity normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = np.zeros(256, np.int64)
        normal = {}
        for i, piece in enumerate(pieces):
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i)):
                normal[piece] = i
                if model.is_unused(i):
                    raise ValueError("unused pieces are not supported")
        if any(MARK in p.lstrip(MARK) or ("\n" in p and p != "\n") for p in normal):
            raise ValueError("a piece reaches across a word boundary")
        self._symbols(normal)
        self._pairs(normal, {i: model.get_score(i) for i in normal.values()})
        self._surfaces(pieces, normal)
        self.remembered = REMEMBERED
        self.forget()

    def _symbols(self, normal: dict[str, int]) -> None:
        """Code point to symbol: its piece id; ids above the vocabulary for characters that only occur inside pieces."""
        self.of_char = np.full(0x110000, -1, np.int32)
        self.char_of: dict[int, str] = {}
        above = max(normal.values()) + 1
        for char in sorted({c for piece in normal for c in piece}):
            symbol = normal.get(char, above)
            if symbol == above:
                above += 1
                self.char_of[symbol] = char
            self.of_char[ord(char)] = symbol
        self.vocabulary, self.width = max(normal.values()) + 1, above

    def _pairs(self, normal: dict[str, int], scores: dict[int, float]) -> None:
        """A hash table from two symbols to the piece they join to; ranks are dense, equal for equal scores."""
        order = {score: rank for rank, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = np.zeros(self.width, np.int32)
        for i, score in scores.items():
            self.rank[i] = order[score]
        symbol = dict(normal)
        symbol.update({char: s for s, char in self.char_of.items()})
        keys, joined = [], []
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                a, b = symbol.get(piece[:cut]), symbol.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.width + b)
                    joined.append(i)
        self.bits = 22
        self.slots, self.joined, self.probes = np.full((1 << self.bits) + 64, -1, np.int64), np.full((1 << self.bits) + 64, -1, np.int32), 1
        for key, i, at in zip(keys, joined, self._slot(np.array(keys, np.int64)).tolist()):
            step = 0
            while self.slots[at + step] >= 0:
                step += 1
            self.slots[at + step], self.joined[at + step] = key, i
            self.probes = max(self.probes, step + 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _surfaces(self, pieces: list[str], normal: dict[str, int]) -> None:
        """The bytes of every id, flat with offsets."""
        raw = [b""] * len(pieces)
        for piece, i in normal.items():
            raw[i] = piece.replace(MARK, " ").encode()
        for byte, i in enumerate(self.byte_ids.tolist()):
            raw[i] = bytes([byte])
        self.surface = np.frombuffer(b"".join(raw), np.uint8)
        self.surface_at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        listed = [f",{i}".encode() for i in range(len(pieces))]
        self.decimal = np.frombuffer(b"".join(listed), np.uint8)
        self.decimal_at = np.concatenate([[0], np.cumsum([len(r) for r in listed])])

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols joins to, -1 for none."""
        keys = left.astype(np.int64) * self.width + right
        at = self._slot(keys)
        out = np.where(self.slots[at] == keys, self.joined[at], np.int32(-1))
        for step in range(1, self.probes):
            out = np.where(self.slots[at + step] == keys, self.joined[at + step], out)
        return np.where((left < 0) | (right < 0), np.int32(-1), out)

    def merged(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over flat symbols and their (ascending) word numbers until no pair joins.

        A round takes the least rank among each word's pairs and merges all its places at once, from the left
        and without overlap. Where a merge makes a pair of the same or a lesser rank, which one place at a time
        would take before the next place, only the leftmost place of that word is merged. Finished words leave.
        """
        done: list[tuple[np.ndarray, np.ndarray]] = []
        joins = self._beside(symbols, word)
        while symbols.size:
            ranks = np.where(joins >= 0, self.rank[joins], _NONE)
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(starts, word.size))
            least = np.minimum.reduceat(ranks, starts)
            if (least == _NONE).any():
                open_ = np.repeat(least != _NONE, sizes)
                done.append((word[~open_], symbols[~open_]))
                symbols, word, joins, ranks = symbols[open_], word[open_], joins[open_], ranks[open_]
                if not symbols.size:
                    break
                starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                sizes = np.diff(np.append(starts, word.size))
                least = least[least != _NONE]
            place = ranks == np.repeat(least, sizes)
            place = self._apart(place)
            place = self._safe(place, symbols, joins, ranks, word, starts)
            at = np.flatnonzero(place)
            symbols = symbols.copy()
            symbols[at] = joins[at]
            keep = np.ones(symbols.size, bool)
            keep[at + 1] = False
            changed = np.zeros(symbols.size, bool)
            changed[at] = True
            symbols, word, joins, changed = symbols[keep], word[keep], joins[keep], changed[keep]
            stale = changed.copy()
            stale[:-1] |= changed[1:]
            fresh = np.flatnonzero(stale)
            joins = joins.copy()
            joins[fresh] = self._beside(symbols, word, fresh)
        if not done:
            return symbols, word
        word = np.concatenate([w for w, _ in done])
        symbols = np.concatenate([s for _, s in done])
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def _beside(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """What the symbols at the given places join to with their right neighbour in the same word, -1 for nothing."""
        at = np.arange(symbols.size) if at is None else at
        after = np.minimum(at + 1, symbols.size - 1)
        out = self.join(symbols[at], symbols[after])
        return np.where((after > at) & (word[after] == word[at]), out, np.int32(-1))

    @staticmethod
    def _apart(place: np.ndarray) -> np.ndarray:
        """Of places next to each other, every second one from the left."""
        if not (place[1:] & place[:-1]).any():
            return place
        at = np.flatnonzero(place)
        first = np.concatenate([[True], at[1:] != at[:-1] + 1])
        start = np.maximum.accumulate(np.where(first, np.arange(at.size), 0))
        out = np.zeros_like(place)
        out[at[(np.arange(at.size) - start) % 2 == 0]] = True
        return out

    def _safe(self, place, symbols, joins, ranks, word, starts) -> np.ndarray:
        """The places without those that must wait, see ``merged``."""
        at = np.flatnonzero(place)
        of = word[at]
        several = np.zeros(at.size, bool)
        several[1:] |= of[1:] == of[:-1]
        several[:-1] |= of[1:] == of[:-1]
        if not several.any():
            return place
        at = at[several]
        made, last = joins[at], symbols.size - 1
        right = np.minimum(at + 2, last)
        after = np.where((right == at + 2) & (word[right] == word[at]), self.join(made, symbols[right]), -1)
        before = np.maximum(at - 1, 0)
        twice = (at >= 2) & place[np.maximum(at - 2, 0)]
        neighbour = np.where(twice, joins[np.maximum(at - 2, 0)], symbols[before])
        ahead = np.where((at >= 1) & (word[before] == word[at]), self.join(neighbour, made), -1)
        limit = ranks[at]
        bad = ((after >= 0) & (self.rank[after] <= limit)) | ((ahead >= 0) & (self.rank[ahead] <= limit))
        if not bad.any():
            return place
        words = np.unique(word[at[bad]])
        all_at = np.flatnonzero(place)
        first = np.concatenate([[True], word[all_at[1:]] != word[all_at[:-1]]])
        out = place.copy()
        out[all_at[np.isin(word[all_at], words) & ~first]] = False
        return out

    def encode_segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of segments (marks for spaces, none empty) and the offset of each segment."""
        codes = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        word = np.repeat(np.arange(len(segments)), [len(s) for s in segments])
        symbols = self.of_char[codes]
        odd = symbols < 0
        symbols = np.where(odd, -1 - codes.astype(np.int32), symbols)
        symbols, word = self.merged(symbols, word)
        ids = symbols.astype(np.int64)
        odd = (ids < 0) | (ids >= self.vocabulary)
        if odd.any():
            expanded = [self.byte_ids[np.frombuffer(self._char(int(s)).encode(), np.uint8)] for s in ids[odd]]
            counts = np.ones(ids.size, np.int64)
            counts[odd] = [e.size for e in expanded]
            ids, word = np.repeat(ids, counts), np.repeat(word, counts)
            ids[np.repeat(odd, counts)] = np.concatenate(expanded)
        return ids, np.searchsorted(word, np.arange(len(segments) + 1))

    def _char(self, symbol: int) -> str:
        return chr(-1 - symbol) if symbol < 0 else self.char_of[symbol]

    def decode_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of flat ids before they are read as text, and the end of each id's bytes."""
        return _gathered(self.surface, self.surface_at, ids)

    def parts(self, text: str) -> Iterator[list[str]]:
        """The segments of a text, in lists of about ``SLICE`` characters."""
        if not text:
            return
        at, first = 0, MARK
        while at < len(text):
            end = at + SLICE
            while end < len(text):  # cut before a space that follows another character
                end = text.find(" ", end)
                if end < 0 or text[end - 1] not in " " + MARK:
                    break
                end += 1
            end = len(text) if end < 0 or end > len(text) else end
            found = _SEGMENT.findall(first + text[at:end].replace(" ", MARK))
            found.pop()  # the empty match at the end
            yield found
            at, first = end, ""

    def learn(self, segments: set[str]) -> None:
        """Encode the segments not seen before and keep their ids in the pool; a full pool starts anew."""
        if len(self.index) > self.remembered:
            self.forget()
        index = self.index
        fresh = [s for s in segments if s not in index]
        for low, high in slices(fresh, [len(s) for s in fresh], SLICE):
            ids, at = self.encode_segments(fresh[low:high])
            n, used = len(index), self.pool_at[len(index)]
            self.pool, self.pool_at = _room(self.pool, used + ids.size), _room(self.pool_at, n + at.size)
            self.pool[used:used + ids.size] = ids
            self.pool_at[n + 1:n + at.size] = used + at[1:]
            index.update(zip(fresh[low:high], range(n, n + at.size - 1)))

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.pool, self.pool_at = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)

    def _ids(self, segments: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.index.__getitem__, segments), np.int64, len(segments))
        return _gathered(self.pool, self.pool_at, at)[0]

    def encoded(self, texts: list[str]) -> Iterator[Iterator[np.ndarray]]:
        """For each text the ids of its parts, to be used in turn.

        The segments of many short texts are learnt together; a text above ``SLICE`` goes part by part.
        """
        for low, high in slices(texts, [len(t) for t in texts], SLICE):
            if high - low == 1 and len(texts[low]) > SLICE:
                yield self._long(texts[low])
                continue
            cut = [next(self.parts(text), []) for text in texts[low:high]]
            self.learn(set().union(*cut))
            yield from (iter([self._ids(own)] if own else []) for own in cut)

    def _long(self, text: str) -> Iterator[np.ndarray]:
        for segments in self.parts(text):
            self.learn(set(segments))
            yield self._ids(segments)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text."""
        return [np.concatenate([np.zeros(0, np.int32), *parts]) for parts in self.encoded(texts)]

    def listed(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, a comma before each."""
        return _gathered(self.decimal, self.decimal_at, ids)[0].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: without the space put before the first word; bytes that are no text become U+FFFD.

        Runs of byte ids are read apart from other pieces, as the library does.
        """
        ids = np.asarray(ids, np.int64)
        surface, _ = self.decode_bytes(ids)
        return _as_text(surface.tobytes(), bool(ids.size) and ids[0] not in self.byte_ids)


def _as_text(raw: bytes, first: bool) -> str:
    raw = raw[1:] if first and raw[:1] == b" " else raw
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return _lossy(raw)


def _lossy(raw: bytes) -> str:
    """One U+FFFD for every byte that is not part of a valid character."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as problem:
            out.append(raw[at:at + problem.start].decode() + "�")
            at += problem.start + 1
    return "".join(out)


@lru_cache(maxsize=2)
def coder(path: str) -> PieceCoder:
    """One coder per worker process and model file."""
    return PieceCoder(path)


@contextmanager
def task_coder(path: str) -> Iterator[PieceCoder]:
    """The worker's coder for one task: what it has remembered goes when the task ends, since workers outlive tasks."""
    own = coder(path)
    try:
        yield own
    finally:
        own.forget()
        pa.default_memory_pool().release_unused()


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row's whole text (null: empty).

    Texts are encoded in parts of bounded size, whatever their length; hashes are fed part by part. Repeated
    rows give repeated rows. ``model`` must be readable at the same path on every executor.
    """
    path = model or default_model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with task_coder(path) as own:
            for batch in batches:
                rows = []
                for parts in own.encoded(batch["_text"].tolist()):
                    ids, back, n, first = sha256(), sha256(), 0, True
                    for found in parts:
                        listed, raw = own.listed(found), own.decode_bytes(found)[0].tobytes()
                        ids.update(listed[1:] if first else listed)
                        back.update(raw[1:] if first and raw[:1] == b" " else raw)
                        n, first = n + found.size, False
                    rows.append((n, ids.hexdigest(), back.hexdigest()))
                out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
                out.insert(0, "doc_id", batch["doc_id"])
                yield out

    texts = docs.select("doc_id", plain_text().alias("_text"))
    return exact_ids(texts, run, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def exact_ids(texts: DataFrame, run, schema: str) -> DataFrame:
    """mapInPandas with doc_id carried as text, so that a null does not turn ids into floats."""
    kind = dict(texts.dtypes)["doc_id"]
    held = texts.withColumn("doc_id", F.col("doc_id").cast("string"))
    return held.mapInPandas(run, f"doc_id string, {schema}").withColumn("doc_id", F.col("doc_id").cast(kind))


def tokenised(docs: DataFrame, model: str | None = None) -> DataFrame:
    """The documents with ``ids``, the token ids of the text as an array; other columns are kept.

    A column ``ids`` of the input is replaced. Texts are encoded in slices of about ``PART`` bytes, each sent on as
    flat ids with their ends.
    """
    path = model or default_model()
    kept = [c for c in docs.columns if c != "ids"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_coder(path) as own:
            for batch in batches:
                sizes = pc.binary_length(batch["__text"]).to_pylist()
                for low, high in slices(sizes, sizes, PART):
                    part = batch.slice(low, high - low)
                    ids = own.encode(part["__text"].to_pylist())
                    ends = np.cumsum([0, *(found.size for found in ids)])
                    flat = np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32)
                    listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), listed], [*kept, "ids"])

    layout = T.StructType([*(docs.schema[c] for c in kept), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(*kept, plain_text().alias("__text")).mapInArrow(encode, layout)


def detokenised(encoded: DataFrame, model: str | None = None, column: str = "ids") -> DataFrame:
    """The rows with ``decoded``, the text of their ids (null: empty)."""
    path = model or default_model()

    @F.pandas_udf("string")
    def decode(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = coder(path)
        for batch in ids:
            yield pd.Series([own.decode(np.asarray(x, np.int64)) for x in batch], dtype=object)

    return encoded.withColumn("decoded", decode(F.coalesce(F.col(column), F.array().cast("array<int>"))))
