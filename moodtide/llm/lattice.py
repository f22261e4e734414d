"""LM scoring: the marginal probability of a text over all segmentations into the pieces of an existing vocabulary."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import id_remainder, plain_text, slices, written
from .pieces import MARK, default_model

#: Words the scan knows by heart, and bytes up to which a word is its own key (a longer one travels as a digest):
#: together they bound what is sent to every executor, whatever the words are.
FREQUENT = 65_536
FREQUENT_BYTES = 64
#: Rounds of expected counts, and the weight that the vocabulary's own scores keep in them (as a share of the pieces).
ROUNDS = 2
PRIOR = 1e-4
#: Different words counted before a task hands them on, bytes taken through the lattice at once.
HELD_WORDS = 300_000
SLICE = 1 << 18

_P = np.uint64(0x9E3779B97F4A7C15)


class Lattice:
    """Pieces as byte strings: the 256 single bytes first, then all others; a word starts with the space before it."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        longer: dict[bytes, float] = {}
        own = np.full(256, -np.inf)
        for i in range(model.get_piece_size()):
            if model.is_byte(i) or model.is_control(i) or model.is_unknown(i):
                continue
            piece = model.id_to_piece(i).replace(MARK, " ").encode()
            # a merge list scores pieces by rank: the r-th weighs 1 / (r + 10), as frequencies fall with rank
            weight = -np.log(10.0 - min(max(model.get_score(i), -1e6), 0.0))
            if len(piece) == 1:
                own[piece[0]] = weight
            elif b" " not in piece[1:]:
                longer[piece] = weight
        self.size = 256 + len(longer)
        self.initial = np.concatenate([np.maximum(own, own[own > -np.inf].min() - np.log(256)), list(longer.values())])
        lengths = np.array([1] * 256 + [len(p) for p in longer])
        self.longest = int(lengths.max())
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        hashes = np.array([self._hash(p) for p in longer], np.uint64)
        for length in sorted(set(lengths[256:].tolist())):
            ids = 256 + np.flatnonzero(lengths[256:] == length)
            order = np.argsort(hashes[ids - 256])
            self.by_length[length] = hashes[ids - 256][order], ids[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(hashes * _P) >> np.uint64(44)] = True

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for byte in piece:
            h = (h * int(_P) + byte + 1) & (2**64 - 1)
        return h

    def edges(self, words: list[bytes]) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
        """For words of any lengths, padded: bytes, and per piece length the word, start and id of each piece found."""
        lengths = np.array([len(w) for w in words])
        width = int(lengths.max())
        flat = np.frombuffer(b"".join(words), np.uint8)
        row = np.repeat(np.arange(len(words)), lengths)
        at = np.arange(flat.size) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        raw = np.zeros((len(words), width), np.uint8)
        raw[row, at] = flat
        powers = np.cumprod(np.full(self.longest + 1, _P, np.uint64))
        prefix = np.zeros((len(words), width + 1), np.uint64)
        for i in range(width):
            prefix[:, i + 1] = prefix[:, i] * _P + raw[:, i] + np.uint64(1)
        found = [(1, row, at, flat.astype(np.int64))]
        for length, (hashes, ids) in self.by_length.items():
            if length > width:
                break
            h = prefix[:, length:] - prefix[:, :-length] * powers[length - 1]
            word, start = np.nonzero(self.seen[(h * _P) >> np.uint64(44)])
            inside = start + length <= lengths[word]
            word, start = word[inside], start[inside]
            key = h[word, start]
            place = np.minimum(np.searchsorted(hashes, key), hashes.size - 1)
            good = hashes[place] == key
            found.append((length, word[good], start[good], ids[place[good]]))
        return lengths, found, raw

    @staticmethod
    def _sums(lengths: np.ndarray, found: list, weights: np.ndarray, backward: bool) -> np.ndarray:
        """Log-space recursion: log weight of all ways from the start to each byte (or from each byte to the end).

        Position by position, for all words at once: the terms of the pieces that end (or start) there are summed
        in log space by word.
        """
        n, width = lengths.size, int(lengths.max())
        out = np.full((n, width + 1), -np.inf)
        out[np.arange(n), lengths if backward else 0] = 0
        length = np.concatenate([np.full(w.size, k) for k, w, _, _ in found])
        word = np.concatenate([w for _, w, _, _ in found])
        start = np.concatenate([s for _, _, s, _ in found])
        piece = np.concatenate([weights[i] for _, _, _, i in found])
        to, from_ = (start, start + length) if backward else (start + length, start)
        order = np.lexsort((word, to))
        to, from_, word, piece = to[order], from_[order], word[order], piece[order]
        bounds = np.searchsorted(to, np.arange(width + 2))
        for position in range(width, -1, -1) if backward else range(width + 1):
            low, high = bounds[position], bounds[position + 1]
            if low == high:
                continue
            terms = out[word[low:high], from_[low:high]] + piece[low:high]
            at = np.flatnonzero(np.concatenate([[True], word[low + 1:high] != word[low:high - 1]]))
            top = np.maximum.reduceat(terms, at)
            top = np.where(np.isfinite(top), top, 0)
            size = np.diff(np.append(at, terms.size))
            with np.errstate(divide="ignore"):
                out[word[low:high][at], position] = top + np.log(np.add.reduceat(np.exp(terms - np.repeat(top, size)), at))
        return out

    def _in_parts(self, words: list[bytes]) -> Iterator[np.ndarray]:
        """Indices of the words in parts of about equal lengths and bounded size."""
        lengths = np.array([len(w) for w in words])
        order = np.argsort(lengths, kind="stable")
        widest = 0
        start = 0
        for i, k in enumerate(order):
            widest = int(lengths[k])
            if i > start and (widest + 1) * (i - start + 1) > SLICE:
                yield order[start:i]
                start = i
        if start < order.size:
            yield order[start:]

    def log_weights(self, words: list[bytes], *weights: np.ndarray) -> np.ndarray:
        """Natural log of the summed weight of all segmentations of each word, a row for each set of weights."""
        out = np.zeros((len(weights), len(words)))
        for part in self._in_parts(words):
            lengths, found, _ = self.edges([words[i] for i in part])
            for k, each in enumerate(weights):
                out[k, part] = self._sums(lengths, found, each, False)[np.arange(part.size), lengths]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the words, over all their segmentations by weight."""
        total = np.zeros(self.size)
        for part in self._in_parts(words):
            lengths, found, _ = self.edges([words[i] for i in part])
            ahead = self._sums(lengths, found, weights, False)
            behind = self._sums(lengths, found, weights, True)
            whole = ahead[np.arange(part.size), lengths]
            for length, word, start, ids in found:
                share = np.exp(ahead[word, start] + weights[ids] + behind[word, start + length] - whole[word])
                total += np.bincount(ids, share * counts[part][word], self.size)
        return total


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    """One lattice per worker process and vocabulary file."""
    return Lattice(path)


def _key(word: bytes) -> bytes:
    """What a word is known by; no word holds a space, so digests meet no word."""
    return word if len(word) <= FREQUENT_BYTES else b"  " + hashlib.sha256(word).digest()


def key_of(word: Column) -> Column:
    """``_key`` of a binary column."""
    digest = F.concat(F.lit(b"  "), F.unhex(F.sha2(word, 256)))
    return F.when(F.length(word) <= FREQUENT_BYTES, word).otherwise(digest)


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def counted(docs: DataFrame, modulus: int = 7, held: int = 2) -> DataFrame:
    """word, c: every word of the corpus with its count in the training documents (0 if only elsewhere)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        train, other = Counter(), set()

        def rows():
            rest = list(other - train.keys())
            if train or rest:
                yield pd.DataFrame({"word": [*train, *rest], "c": np.array([*train.values(), *([0] * len(rest))], np.int64)})
            train.clear()
            other.clear()

        for batch in batches:
            for text, held_out in zip(batch["_text"], batch["_held"]):
                if held_out:
                    other.update(_words(text))
                else:
                    train.update(_words(text))
                if len(train) + len(other) > HELD_WORDS:
                    yield from rows()
        yield from rows()

    texts = docs.select(plain_text().alias("_text"), (id_remainder(modulus) == held).alias("_held"))
    return texts.mapInPandas(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary_weights(path: str) -> np.ndarray:
    """Natural log weights of the pieces by the vocabulary's own scores; they sum to one."""
    start = lattice(path).initial
    return start - start.max() - np.log(np.exp(start - start.max()).sum())


def trained(words: DataFrame, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Natural log weights of the pieces, learnt from the different words of the training documents.

    The vocabulary is given; its own scores are the start. Each round replaces the weights by the expected counts
    of the pieces over all segmentations of the words, summed per task and then over tasks, so that what reaches
    the driver has the size of the vocabulary. They sum to one, which makes the marginals of all words (a piece
    with a space, then pieces without) sum to one.
    """
    weights = vocabulary_weights(path)
    base = np.exp(weights)
    for _ in range(rounds):
        def run(batches: Iterator[pd.DataFrame], weights: np.ndarray = weights) -> Iterator[pd.DataFrame]:
            own = lattice(path)
            total = np.zeros(own.size)
            for batch in batches:
                spelt = [b" " + w for w in batch["word"]]
                for low, high in slices(spelt, [len(w) for w in spelt], SLICE):
                    total += own.expected(spelt[low:high], np.ones(high - low), weights)
            at = np.flatnonzero(total)
            yield pd.DataFrame({"piece": at, "n": total[at]})

        sums = words.filter("c > 0").mapInPandas(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        found = np.zeros(base.size)
        found[sums["piece"].to_numpy(int)] = sums["n"].to_numpy()
        found += (PRIOR * found.sum() + 1) * base
        weights = np.log(found / found.sum())
    return weights


def scored(docs: DataFrame, path: str | None = None, modulus: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and lattice_score of every row (null text: empty).

    Documents whose crc32(id as text) mod ``modulus`` is ``held`` teach nothing (a null id teaches). ``score`` is the
    log10 probability of the text's words and its end: no piece reaches across a space, so it is the sum of the
    words' marginals over all segmentations. The units of a word's lattice are the vocabulary's pieces and, if the
    training documents hold the word, the word itself: its count less a discount, over all tokens. What the
    discounts set free (estimated from words seen once and twice) is the weight of the piece lattice. Any byte
    can be spelt, so every text has a probability; the probabilities of all texts sum to one. ``lattice_score`` is the
    log10 marginal of the words by the vocabulary's own scores alone: nothing of it is learnt, and an empty text has 0.
    Words are counted and put through the lattice once each, wherever they stand. The frequent ones (a bounded
    list) are then known to the scan of the documents; only the others travel, once per document and word, to
    their scores, so that no word is a hot key. Repeated rows give repeated rows.
    """
    path = path or default_model()
    spark = docs.sparkSession
    counts = written(counted(docs, modulus, held), "lm-counts")
    ends = docs.filter(id_remainder(modulus) != held).count()
    n, v, once, twice = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)),
        F.count(F.when(F.col("c") > 0, 1)),
        F.count(F.when(F.col("c") == 1, 1)),
        F.count(F.when(F.col("c") == 2, 1)),
    ).first()
    off = once / (once + 2 * twice) if once and twice else 0.5
    spelt, whole, n = np.log(off * v + 1), np.log(n + ends + 2), n + ends  # one more text, and one more word of unknown spelling
    v += ends > 0
    weights = trained(counts, path)
    end = float(np.log10(ends + 1) - whole / np.log(10))
    under = float(np.log10(n + v + 1))
    shared = spark.sparkContext.broadcast(weights)

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = lattice(path)
        for batch in batches:
            learnt, given = own.log_weights([b" " + w for w in batch["word"]], shared.value, vocabulary_weights(path))
            pieces = learnt + spelt
            with np.errstate(divide="ignore"):
                word = np.log(np.maximum(batch["c"].to_numpy(np.float64) - off, 0))
            marginal = (np.logaddexp(word, pieces) - whole) / np.log(10)
            yield pd.DataFrame({"word": batch["word"], "c": batch["c"], "own": marginal, "given": given / np.log(10)})

    rated = written(counts.mapInPandas(rate, "word binary, c long, own double, given double"), "lm-words")
    rated = rated.withColumn("word", key_of(F.col("word")))
    top = rated.filter(F.col("c") > 1).orderBy(F.desc("c"), "word").limit(FREQUENT).toPandas()
    known = {bytes(w): (float(np.log10(c + 1)), s, g) for w, c, s, g in zip(top["word"], top["c"], top["own"], top["given"])}
    known = spark.sparkContext.broadcast(known)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = known.value
        for batch in batches:
            rows, heads = [], []
            for key, id_, text in zip(batch["_key"].tolist(), batch["doc_id"], batch["_text"]):
                found = Counter(_words(text))
                tokens, seen, base, own, given = 0, 0, 0.0, 0.0, 0.0
                for word, times in found.items():
                    tokens += times
                    known_by = _key(word)
                    rate_ = often.get(known_by)
                    if rate_ is None:
                        rows.append((key, known_by, times))
                    else:
                        seen += times
                        base += times * rate_[0]
                        own += times * rate_[1]
                        given += times * rate_[2]
                heads.append((key, id_, tokens, seen, base, own, given))
            heads = pd.DataFrame(heads, columns=["_key", "doc_id", "n", "seen", "base", "own", "given"])
            heads["word"] = [b" %d" % key for key in heads["_key"]]  # one space and digits: neither a word nor a digest, it meets nothing in the join
            rare = pd.DataFrame(rows, columns=["_key", "word", "times"])
            yield pd.concat([heads, rare])[["_key", "doc_id", "word", "times", "n", "seen", "base", "own", "given"]]

    kind = dict(docs.dtypes)["doc_id"]
    numbered = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.monotonically_increasing_id().alias("_key"), plain_text().alias("_text"))
    schema = "_key long, doc_id string, word binary, times double, n double, seen double, base double, own double, given double"
    parts = numbered.mapInPandas(read, schema)
    rare = rated.select("word", "c", F.col("own").alias("marginal"), F.col("given").alias("spelling"))
    of_word = parts.join(rare, "word", "left")
    times = F.coalesce("times", F.lit(0.0))
    sums = of_word.groupBy("_key").agg(
        F.max("doc_id").cast(kind).alias("doc_id"),
        F.sum("n").alias("n"),
        (F.sum("seen") + F.sum(F.when(F.col("c") > 0, times).otherwise(F.lit(0.0)))).alias("seen"),
        (F.sum("base") + F.sum(times * F.coalesce(F.log10(F.col("c") + 1), F.lit(0.0)))).alias("base"),
        (F.sum("own") + F.sum(times * F.coalesce("marginal", F.lit(0.0)))).alias("own"),
        (F.sum("given") + F.sum(times * F.coalesce("spelling", F.lit(0.0)))).alias("given"),
    )
    tokens = F.col("n") + 1
    return sums.select(
        "doc_id",
        (id_remainder(modulus) == held).alias("held_out"),
        tokens.cast("long").alias("n_tokens"),
        (F.col("seen") + F.lit(1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + float(np.log10(ends + 1)) - tokens * under).alias("base_score"),
        (F.col("own") + end).alias("score"),
        F.col("given").alias("lattice_score"),
    )
