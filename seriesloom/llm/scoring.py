"""Document probability under a unigram model of subwords, summed over all segmentations.

The vocabulary is an existing one, with its own scores. The corpus re-estimates them by expectation-maximisation over
its distinct words and counts. A word's pieces form a lattice, whose forward recursion
in log space sums over all paths; as no piece spans words, a document's probability is the product of its words' and the
end's, and each distinct word is computed once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .hashing import joined, word_hashes, word_table

#: At most so many words, the most frequent ones, are looked up by hash in tasks; all others are joined by a shuffle.
HEAD = 1 << 17
#: Expectation-maximisation ends when a round would gain less than this (nats a word, judged by the round before), after so many rounds at most.
GAIN, ROUNDS = 0.05, 3
# The bytes between words, and where words begin.
WORDS = word_table([32, *range(9, 14)])
_SMALL = bytes(i + 32 if 65 <= i < 91 else i for i in range(256))
_BASE, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 20


@dataclass
class Pieces:
    """A vocabulary as bytes, a blank standing for a word's begin: sorted hashes, their pieces' numbers, and log probabilities.

    Numbers 0 to 255 are the single bytes, by which any word can be written; the last one is the end of a text.
    """

    keys: np.ndarray
    numbers: np.ndarray
    longest: int
    logp: np.ndarray

    def __post_init__(self) -> None:
        self.maybe = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.maybe[(self.keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    @property
    def end(self) -> float:
        return float(self.logp[-1])


def _hash(piece: bytes) -> int:
    h = 0
    for b in piece:
        h = (h * int(_BASE) + b + 1) & (1 << 64) - 1
    return h * int(_MIX) & (1 << 64) - 1


def vocabulary(path: str | None = None) -> Pieces:
    """The pieces of a sentencepiece model with the model's own scores.

    A unigram model's are log probabilities. A merge model's are whole numbers, the negated places of its merges, and
    stand for probabilities that fall with the place by Zipf's law. Bytes come last.
    """
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, int] = {}
    scores: list[float] = []
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            piece = model.id_to_piece(i).replace("▁", " ").encode()
            if piece and b" " not in piece[1:] and piece not in found:
                found[piece] = 256 + len(found)
                scores.append(model.get_score(i))
    keys = np.array([_hash(p) for p in found], dtype=np.uint64)
    order = np.argsort(keys)
    own = np.array(scores)
    own = 1 / (10 - own) if (own == np.round(own)).all() else np.exp(own)
    weight = np.concatenate([np.full(256, own.min(initial=1)), own, [0.01]])
    return Pieces(keys[order], np.array(list(found.values()))[order], max(map(len, found), default=1), np.log(weight / weight.sum()))


def _lattice(words: list[bytes], pieces: Pieces) -> tuple[np.ndarray, ...]:
    """All edges of the words' lattices: start and end node, piece; and each word's first node and length."""
    length = np.array([len(w) + 1 for w in words], dtype=np.int64)
    data = np.frombuffer(b"".join(b" " + w for w in words), dtype=np.uint8)
    first = np.cumsum(length) - length
    within = np.arange(len(data)) - np.repeat(first, length)
    node = first + np.arange(len(words))  # a word of n bytes has n + 1 nodes
    at = np.repeat(node, length) + within  # the node before each byte
    starts, ends, numbers = [at], [at + 1], [data.astype(np.int64)]
    h = np.zeros(len(data), dtype=np.uint64)
    for n in range(1, pieces.longest + 1):
        if len(h) < 1:
            break
        h = h[: len(data) - n + 1] * _BASE + data[n - 1 :] + np.uint64(1)
        key = h * _MIX
        fits = within[n - 1 :] == within[: len(h)] + n - 1
        own = np.nonzero(fits & pieces.maybe[(key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])[0]
        place = np.minimum(np.searchsorted(pieces.keys, key[own]), len(pieces.keys) - 1)
        hit = pieces.keys[place] == key[own] if len(pieces.keys) else np.zeros(0, dtype=bool)
        own = own[hit]
        starts.append(at[own])
        ends.append(at[own] + n)
        numbers.append(pieces.numbers[place[hit]])
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(numbers), node, length


def _recursion(source: np.ndarray, target: np.ndarray, weight: np.ndarray, step: np.ndarray, values: np.ndarray) -> None:
    """values[target] = log of the sum over edges of exp(values[source] + weight), for all edges of a step, step after step."""
    order = np.lexsort((target, step))
    source, target, weight, step = source[order], target[order], weight[order], step[order]
    new = np.concatenate([[True], (target[1:] != target[:-1])]) if len(target) else np.zeros(0, dtype=bool)
    heads = np.nonzero(new)[0]
    bounds = np.searchsorted(step[heads], np.arange(step.max(initial=0) + 2))
    for a, z in zip(bounds[:-1], bounds[1:], strict=True):
        if a == z:
            continue
        lo, hi = heads[a], heads[z] if z < len(heads) else len(target)
        v = values[source[lo:hi]] + weight[lo:hi]
        cut_at = heads[a:z] - lo
        top = np.maximum.reduceat(v, cut_at)
        total = np.add.reduceat(np.exp(v - np.repeat(top, np.diff(np.append(cut_at, hi - lo)))), cut_at)
        values[target[heads[a:z]]] = top + np.log(total)


def word_logp(words: list[bytes], pieces: Pieces, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log probability of each word over all segmentations; with counts, also how often each piece is expected in them."""
    if not words:
        return np.zeros(0), None if counts is None else np.zeros(len(pieces.logp))
    start, end, number, node, length = _lattice(words, pieces)
    weight = pieces.logp[number]
    total_nodes = int(node[-1] + length[-1] + 1)
    base = np.repeat(node, length + 1)
    forward = np.zeros(total_nodes)
    _recursion(start, end, weight, end - base[end], forward)
    total = forward[node + length]
    if counts is None:
        return total, None
    backward = np.zeros(total_nodes)
    last = np.repeat(node + length, length + 1)
    _recursion(end, start, weight, last[start] - start, backward)
    of = np.repeat(np.arange(len(words)), length + 1)[start]
    share = np.exp(forward[start] + weight + backward[end] - total[of])
    return total, np.bincount(number, share * counts[of], len(pieces.logp))


def _groups(words: list[bytes], most: int = 1 << 18) -> Iterator[slice]:
    a = size = 0
    for i, w in enumerate(words):
        if size and size + len(w) > most:
            yield slice(a, i)
            a, size = i, 0
        size += len(w) + 1
    if words:
        yield slice(a, len(words))


def _split(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    ends, a = np.cumsum(sizes + 1), 0
    while a < len(sizes):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, z
        a = z


def word_counts(docs: DataFrame, learns: Column, text_col: str = "text") -> DataFrame:
    """word, c, its count in the texts to learn from (0 for words of other texts only), and t, its count in all texts."""
    told = docs.select(F.col(text_col).alias("text"), learns.alias("learns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.binary_length(b.column("text")).fill_null(0).to_numpy()
            for a, z in _split(sizes, 8 << 20):
                data, start = joined(b.column("text")[a:z].to_pylist())
                h, of, first, length = word_hashes(data, start, WORDS)
                _, one, number, t = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                c = np.bincount(number, b.column("learns")[a:z].to_numpy(zero_copy_only=False)[of].astype(float), len(one)).astype(np.int64)
                text = data.tobytes().translate(_SMALL)
                words = [text[x:y] for x, y in zip(first[one].tolist(), (first[one] + length[one]).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(c), pa.array(t)], ["word", "c", "t"])

    return told.mapInArrow(run, "word string, c long, t long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))


def learn(words: DataFrame, pieces: Pieces, texts: int) -> tuple[Pieces, float]:
    """Pieces with probabilities by their expected counts in all words, and the words' log probability before; a partition tells one sum for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(pieces.logp))
        for b in batches:
            words, counts = b.column("word").cast(pa.binary()).to_pylist(), b.column("c").to_numpy().astype(float)
            for s in _groups(words):
                logp, found = word_logp(words[s], pieces, counts[s])
                total[:-1] += found[:-1]
                total[-1] += logp @ counts[s]  # at the end's place, which no word holds
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["piece", "n"])

    sums = words.where("c > 0").select("word", "c").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
    expected = np.zeros(len(pieces.logp))
    for r in sums.collect():  # a row for each piece of the vocabulary
        expected[r["piece"]] = r["n"]
    logp, expected[-1] = float(expected[-1]), texts
    expected += 0.01
    return Pieces(pieces.keys, pieces.numbers, pieces.longest, np.log(expected / expected.sum())), logp


def frequent(words: DataFrame, most: int) -> int:
    """The least count t of which there are at most so many words, from a histogram of counts, eight bars to a doubling."""
    bars = words.groupBy(F.floor(8 * F.log2("t")).alias("bar")).agg(F.count("*").alias("n"), F.min("t").alias("least")).collect()
    least, n = 1 << 62, 0
    for r in sorted(bars, key=lambda r: -r["bar"]):
        n += r["n"]
        if n > most:
            break
        least = r["least"]
    return least


def score(docs: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, learns, n_tokens, n_known, train_tokens, base_score and score, log10 probabilities.

    The base is that of whole words, with counts increased by 0.5. Words are grouped and joined by themselves; only the
    most frequent ones, HEAD at most, and the vocabulary are sent to tasks. A word left for the join is not in more than
    a HEAD-th of all tokens, or nearly.

    Null text: like the empty one, whose only token is the end. Rows whose `learns` is null are not learned from. Repeated rows are learned from and scored each.
    An empty table gives no rows. Other columns are ignored.
    """
    text, learns = F.col(text_col), F.coalesce(learns, F.lit(False))
    words = cut(word_counts(docs, learns, text_col))
    sums = words.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    texts = docs.where(learns).count()
    total, distinct = (sums[0] or 0) + texts, sums[1] + (texts > 0)
    scale = total + 0.5 * (distinct + 1)
    pieces, told = vocabulary(path), []
    for _ in range(ROUNDS):
        pieces, logp = learn(words, pieces, texts)
        told.append(logp / max(1, total))
        if len(told) > 1 and told[-1] - told[-2] < GAIN:
            break

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, c = b.column("word").cast(pa.binary()).to_pylist(), b.column("c").to_numpy()
            logp = np.concatenate([word_logp(own[s], pieces)[0] for s in _groups(own)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("c"), b.column("t"), pa.array(np.log10((c + 0.5) / scale)), pa.array(logp / math.log(10))], ["word", "c", "t", "base", "lattice"])

    weighed = cut(words.mapInArrow(weigh, "word string, c long, t long, base double, lattice double"))
    least = frequent(weighed, HEAD)
    top = weighed.where(F.col("t") >= least).toArrow()
    data, start = joined(top.column("word").to_pylist())
    h = word_hashes(data, start, WORDS)[0]
    order = np.argsort(h)
    head = [h[order]] + [top.column(k).to_numpy()[order] for k in ("c", "base", "lattice")]
    end = (math.log10((texts + 0.5) / scale), pieces.end / math.log(10))

    told = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), learns.alias("learns"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.binary_length(b.column("text")).fill_null(0).to_numpy()
            for a, z in _split(sizes, 4 << 20):
                data, start = joined(b.column("text")[a:z].to_pylist())
                h, of, first, length = word_hashes(data, start, WORDS)
                m = z - a
                place = np.minimum(np.searchsorted(head[0], h), max(0, len(head[0]) - 1))
                hit = head[0][place] == h if len(head[0]) else np.zeros(len(h), dtype=bool)
                place, own = place[hit], of[hit]
                known = np.bincount(own, (head[1][place] > 0).astype(float), m).astype(np.int64) + (texts > 0)
                base, lattice = (np.bincount(own, x[place], m) + e for x, e in zip(head[2:], end, strict=True))
                small, rest = data.tobytes().translate(_SMALL), ~hit
                tail = [small[x:y] for x, y in zip(first[rest].tolist(), (first[rest] + length[rest]).tolist(), strict=True)]
                offsets = np.concatenate([[0], np.cumsum(np.bincount(of[rest], minlength=m))])
                yield pa.RecordBatch.from_arrays(
                    [b.column("rid")[a:z], b.column("doc_id")[a:z], b.column("learns")[a:z], pa.array(np.bincount(of, minlength=m) + 1), pa.array(known), pa.array(base), pa.array(lattice),
                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tail, pa.string()))],
                    ["rid", "doc_id", "learns", "n", "known", "base", "lattice", "tail"],
                )

    kind = dict(told.dtypes)["doc_id"]
    partly = cut(told.mapInArrow(run, f"rid long, doc_id {kind}, learns boolean, n long, known long, base double, lattice double, tail array<string>"))
    rare = weighed.where(F.col("t") < least)
    rest = partly.select("rid", F.explode("tail").alias("word")).join(rare, "word").groupBy("rid").agg(
        F.count_if(F.col("c") > 0).alias("k2"), F.sum("base").alias("b2"), F.sum("lattice").alias("l2")
    )
    zero = F.lit(0)
    return partly.join(rest, "rid", "left").select(
        "doc_id", "learns", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("k2", zero)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b2", zero)).alias("base_score"), (F.col("lattice") + F.coalesce("l2", zero)).alias("score"),
    )
