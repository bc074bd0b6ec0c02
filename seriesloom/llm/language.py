"""Language identification: averaged hashed subword embeddings with a linear softmax and calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the labelled sample a model is fitted on, nearly: documents and bytes in all; most bytes of one.
SAMPLE_DOCS, SAMPLE_BYTES, LONGEST = 4000, 8 << 20, 1 << 18
#: Groups of languages left out in turn; the share of texts taken to be in no learned language; the share of right predictions that may be rejected.
FOLDS, UNSEEN, FALSE_REJECTS = 4, 0.05, 0.002
BUCKET_BITS, DIM, ORDERS = 16, 12, (2, 3, 4)
NO_LANGUAGE = "und"

# Bytes 65 to 90 become small; digits, white space and ASCII signs become one blank.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*range(65), *range(91, 97), *range(123, 128)]] = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


def subwords(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashed byte n-grams of each range of data that do not span words, and the range each belongs to.

    An n-gram may begin or end with the blank beside its word, but has none within.
    """
    data = _FOLD[data]
    blank = data == 32
    of = np.repeat(np.arange(len(start), dtype=np.int32), length)
    h, buckets, owners = data.astype(np.uint64), [], []
    n_at = len(data)
    inner = np.concatenate([[0], np.cumsum(blank)])
    for n in range(2, max(ORDERS) + 1):
        h = (h[: n_at - n + 1] * np.uint64(257) + data[n - 1 :]) if n_at >= n else h[:0]
        if n not in ORDERS or not len(h):
            continue
        m = len(h)
        ok = of[:m] == of[n - 1 : n - 1 + m]
        ok &= inner[n - 1 : n - 1 + m] == inner[1 : m + 1]  # no blank from the second to the last but one
        ok &= ~(blank[:m] & blank[n - 1 : n - 1 + m])
        buckets.append((((h[ok] + np.uint64(n)) * _MIX) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
        owners.append(of[:m][ok])
    if not buckets:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)
    return np.concatenate(buckets), np.concatenate(owners)


def _ranges(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as bytes, each between blanks."""
    own = [b" " + t.encode() + b" " for t in texts]
    length = np.array([len(x) for x in own], dtype=np.int64)
    return np.frombuffer(b"".join(own), dtype=np.uint8), np.cumsum(length) - length, length


@dataclass
class Model:
    """langs; scores[bucket, lang], the embedding times the softmax weights; bias; trust, the calibration; bar, the least score kept.

    trust: weights of 1, of the margin between the two best logits and of the log of the number of subwords, which give
    the chance that a prediction is right; None where nothing could be left out to learn it from.
    """

    langs: list[str]
    scores: np.ndarray
    bias: np.ndarray
    trust: np.ndarray | None = None
    bar: float = 0.0

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The logits of each text and its number of subwords."""
        data, start, length = _ranges(texts)
        bucket, owner = subwords(data, start, length)
        n = np.bincount(owner, minlength=len(texts))
        sums = [np.bincount(owner, self.scores[bucket, j], len(texts)) / np.maximum(n, 1) for j in range(len(self.langs))]
        return np.stack(sums, axis=1) + self.bias, n

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The place in langs of each text's language, and the calibrated chance that it is right."""
        z, n = self.logits(texts)
        if self.trust is None:
            return z.argmax(axis=1), _softmax(z).max(axis=1)
        return z.argmax(axis=1), _sigmoid(_signs(z, n) @ self.trust)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _signs(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What a prediction is trusted by: 1, the margin between the two best logits, the log of the number of subwords."""
    best = np.sort(z, axis=1)
    return np.stack([np.ones(len(z)), best[:, -1] - best[:, -2], np.log1p(n)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Logistic weights by Newton's method, with a small ridge."""
    w, ridge = np.zeros(x.shape[1]), 1e-3 * np.eye(x.shape[1]) * weight.sum()
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        w = w + np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ w)
    return w


def _low(score: np.ndarray, share: float, tail: float = 0.1, least: int = 10) -> float:
    """A score that a share of new ones will fall under: the quantile, of n scores where n * share is 1 or more.

    Of fewer the least says nothing of rarer ones, so the lowest tenth's log odds are taken to fall off exponentially,
    and are carried on to the share. Where even that tenth is under `least` scores there is no bar: 0.
    """
    if len(score) * share >= 1:
        return float(np.quantile(score, share, method="lower"))
    odds = np.sort(np.log(score) - np.log1p(-score))
    k = int(len(odds) * tail)
    if k < least:
        return 0.0
    at = odds[k] - (odds[k] - odds[:k]).mean() * np.log(tail / share)
    return float(_sigmoid(np.minimum(at, odds[0])))


def _descend(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rows: np.ndarray, langs: list[str], epochs: int, rate: float, batch: int, seed: int) -> Model:
    """Stochastic gradient descent on the given rows: embeddings averaged over a text's subwords, then a linear softmax."""
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIM))
    weight, bias = rng.normal(0, 0.3, (DIM, len(langs))), np.zeros(len(langs))
    steps, at = max(1, epochs * -(-len(rows) // batch)), 0
    for _ in range(epochs):
        mixed = rng.permutation(rows)
        for a in range(0, len(rows), batch):
            own = mixed[a : a + batch]
            pace, at = rate * (1 - at / steps), at + 1
            mean = np.stack([w @ embedding[b] if len(b) else np.zeros(DIM) for b, w in (bags[i] for i in own)])
            g = _softmax(mean @ weight + bias)
            g[np.arange(len(own)), y[own]] -= 1
            back = g @ weight.T
            weight -= pace * mean.T @ g / len(own)
            bias -= 0.1 * pace * g.mean(axis=0)
            for i, gi in zip(own, back, strict=True):
                b, w = bags[i]
                embedding[b] -= (pace * w)[:, None] * gi
    return Model(langs, embedding @ weight, bias)


def fit(texts: list[str], labels: list[str], epochs: int = 5, rate: float = 4.0, batch: int = 32, seed: int = 7) -> Model:
    """A model fitted to three quarters of the sample; the other quarter calibrates it.

    For calibration the languages are left out in turn, in FOLDS groups, and a model of the others is asked for them:
    so it is known how predictions look that can't be right. With these, as a share UNSEEN of all, and the model's own
    predictions of the held quarter, a logistic regression on _signs gives the chance that a prediction is right. The bar
    rejects a share FALSE_REJECTS of the right predictions there at most (see _low), and is no higher than needed to reject
    99 in 100 of the left-out ones. Where the quarter has fewer right predictions than 1 / FALSE_REJECTS, the other quarters
    are held out in turn too. Of fewer than three languages none can be left out: scores are the softmax's and none is
    rejected.
    """
    langs = sorted(set(labels)) or [NO_LANGUAGE]
    place = {x: i for i, x in enumerate(langs)}
    y = np.array([place[x] for x in labels], dtype=np.int64)
    order = np.random.default_rng(seed).permutation(len(texts))
    quarters = [order[k * len(order) // 4 : (k + 1) * len(order) // 4] for k in range(4)]
    held, train = quarters[0], np.concatenate(quarters[1:])
    bags = []
    for t in texts:
        bucket, _ = subwords(*_ranges([t]))
        found, count = np.unique(bucket, return_counts=True)
        bags.append((found, (count / max(1, count.sum())).astype(np.float32)))
    model = _descend(bags, y, train, langs, epochs, rate, batch, seed)
    if len(langs) < 3 or not len(held):
        return model
    signs, right = [], []
    for k, own in enumerate(quarters):
        if k and sum(r.sum() for r in right) * FALSE_REJECTS >= 1:
            break
        other = _descend(bags, y, np.concatenate(quarters[:k] + quarters[k + 1 :]), langs, epochs, rate, batch, seed) if k else model
        z, n = other.logits([texts[i] for i in own])
        signs.append(_signs(z, n))
        right.append(z.argmax(axis=1) == y[own])
    asked_known = sum(map(len, right))
    for f in range(min(FOLDS, len(langs) - 1)):
        out = np.arange(len(langs)) % min(FOLDS, len(langs) - 1) == f
        known = np.nonzero(~out)[0]
        asked = held[out[y[held]]]
        if len(known) < 2 or not len(asked):
            continue
        other = _descend(bags, np.searchsorted(known, y), train[~out[y[train]]], [langs[i] for i in known], epochs, rate, batch, seed + 1 + f)
        signs.append(_signs(*other.logits([texts[i] for i in asked])))
        right.append(np.zeros(len(asked), dtype=bool))
    x, good = np.concatenate(signs), np.concatenate(right)
    unseen = np.arange(len(x)) >= asked_known
    weight = np.where(unseen, UNSEEN / max(1, unseen.sum()), (1 - UNSEEN) / asked_known)
    model.trust = _logistic(x, good.astype(float), weight * len(x))
    score = _sigmoid(x @ model.trust)
    model.bar = _low(score[good], FALSE_REJECTS)
    if unseen.any():
        model.bar = min(model.bar, float(np.quantile(score[unseen], 0.99)))
    return model


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def sample(docs: DataFrame, may_learn: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """t and l, whole texts and languages, of about SAMPLE_DOCS labelled rows with a letter and about SAMPLE_BYTES, each language having an equal share.

    Rows are taken by a hash of id and text, below a bound that the language's totals give, so nothing is sorted and what
    is taken is as much on any number of rows. Texts of more than LONGEST bytes are not learned from; rows repeated count once.
    """
    t, l = F.col(text_col), F.col(lang_col)
    rows = docs.where(may_learn & l.isNotNull() & has_letter(t) & (F.octet_length(t) <= LONGEST)).select(
        F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), t, F.lit(7)).alias("k"), t.alias("t"), l.alias("l")
    )
    totals = rows.groupBy("l").agg(F.count("*").alias("n"), F.sum(F.octet_length("t")).alias("b")).collect()  # a row for each language
    share = [(r["l"], min(1.0, SAMPLE_DOCS / len(totals) / r["n"], SAMPLE_BYTES / len(totals) / r["b"])) for r in totals]
    limits = docs.sparkSession.createDataFrame(share, "l string, share double")
    # the hash as a fraction
    taken = rows.join(F.broadcast(limits), "l").where(F.col("k") / F.lit(2.0**64) + 0.5 <= F.col("share"))
    return taken.select("k", "l", "t").dropDuplicates(["k", "l", "t"])


def train(docs: DataFrame, may_learn: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """A model of a bounded sample of the labelled rows; see sample()."""
    rows = sorted((r["k"], r["l"], r["t"]) for r in sample(docs, may_learn, text_col, lang_col, id_col).collect())
    return fit([t for _, _, t in rows], [l for _, l, _ in rows])


def identify(docs: DataFrame, model: Model, text_col: str = "text", into: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """docs with the predicted language of each whole text, the calibrated chance that it is right and whether it is rejected.

    Null texts and texts without a letter: `und`, 0, rejected. A text with letters always has a learned language, and is
    rejected if its score is under the model's bar. Equal texts get equal results. An empty table gives none; if
    docs has columns of the names in `into`, these are replaced. The text is the only input.
    """
    kept = [c for c in docs.columns if c not in into]
    told = docs.select(*kept, has_letter(F.col(text_col)).alias("_letter"))
    names = [c for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, letter = b.column(names.index(text_col)), b.column(len(names)).to_numpy(zero_copy_only=False)
            size = pc.binary_length(texts).fill_null(0).to_numpy()
            best, score, a = np.zeros(b.num_rows, dtype=np.int64), np.zeros(b.num_rows), 0
            while a < b.num_rows:
                z = max(a + 1, int(np.searchsorted(np.cumsum(size[a:]), 1 << 19)) + a)
                best[a:z], score[a:z] = model.predict([t or "" for t in texts[a:z].to_pylist()])
                a = z
            lang = np.where(letter, np.array(model.langs, dtype=object)[best], NO_LANGUAGE)
            score = np.where(letter, score, 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score), pa.array(~letter | (score < model.bar))], [*names, *into])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), f"{into[0]} string, {into[1]} double, {into[2]} boolean"])
    return told.mapInArrow(run, schema)
