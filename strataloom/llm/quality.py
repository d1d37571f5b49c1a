"""A quality classifier learnt from trusted positives and unlabelled text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import cut, shingle_hashes, text_slices, word_hashes, words_of

#: Folds by crc32 of the key's digits; fold 0 is held out and teaches nothing.
FOLDS = 5
#: Bounds on the rows, of each kind, that the classifier is fitted to.
TRAIN_ROWS = 20_000

_MARKS = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
_GROUPS = np.zeros((256, len(_MARKS) + 6), np.float64)
_GROUPS[_MARKS, np.arange(len(_MARKS))] = 1
for _column, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), [32, 9, 11, 12, 13], [10], range(128, 256))):
    _GROUPS[list(_bytes), len(_MARKS) + _column] = 1


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of figures for each text: rates of byte kinds, and of word shapes and repeats."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(row * 256 + data, minlength=256 * n).reshape(n, 256) @ _GROUPS
    size = np.diff(offsets)[:, None]
    rates = kinds / np.maximum(size, 1)
    starts, ends, _ = words_of(data, offsets)
    hashes, first = word_hashes(data, offsets, lower=True)
    words = np.diff(first)
    owner = np.repeat(np.arange(n), words)
    lengths = (ends - starts).astype(np.float64)
    per_word = lambda x: np.bincount(owner, x, n) / np.maximum(words, 1)
    mean = per_word(lengths)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    upper_start = (data[starts] >= 65) & (data[starts] <= 90) if len(starts) else np.zeros(0, bool)
    letter_end = ((data[ends - 1] | 32) >= 97) & ((data[ends - 1] | 32) <= 122) if len(ends) else np.zeros(0, bool)
    distinct, windows = np.zeros(n), np.zeros(n)
    for i in range(n):
        if own := words[i]:
            mine = hashes[first[i] : first[i + 1]]
            distinct[i] = len(np.unique(mine)) / own
            triples = shingle_hashes(mine, 3)
            windows[i] = len(np.unique(triples)) / len(triples)
    shape = [np.log1p(words), mean, np.sqrt(np.maximum(per_word(lengths**2) - mean**2, 0)), per_word(again), per_word(upper_start), per_word(letter_end), distinct, windows]
    return np.column_stack([np.log1p(100 * rates), *shape]).astype(np.float32)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [text_features(data, offsets) for _, data, offsets in text_slices(batch.column(1))]
        if found:
            x = np.concatenate(found)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.record_batch([batch.column(0), *batch.columns[2:], lists], ["id", *batch.schema.names[2:], "x"])


@dataclass
class Network:
    """One hidden layer over standardised features; its output's logistic is the score."""

    centre: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -8, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return 1 / (1 + np.exp(-np.clip(np.maximum(self.inputs(x) @ a + b, 0) @ c + d, -30, 30)))


def fit_positive_unlabelled(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 24, least_steps: int = 1200, batch: int = 512, seed: int = 1) -> Network:
    """Minimises the non-negative unbiased risk with logistic loss by Adam.

    The risk of calling positives negative, taken off the unlabelled rows' risk, may not
    fall below zero; when a batch's does, the step raises it instead.
    """
    both = np.concatenate([positive, unlabelled]).astype(np.float64)
    random = np.random.Generator(np.random.PCG64(seed))
    width = both.shape[1]
    net = Network(both.mean(0), both.std(0) + 0.05, [random.normal(0, (2 / width) ** 0.5, (width, hidden)), np.zeros(hidden), random.normal(0, (1 / hidden) ** 0.5, hidden), np.array(0.0)])
    xp, xu = net.inputs(positive.astype(np.float64)), net.inputs(unlabelled.astype(np.float64))
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.layers]
    steps = max(1, -(-max(len(xp), len(xu)) // batch))
    passes = max(20, -(-least_steps // steps))
    t = 0
    for at in range(passes):
        rate = 3e-3 * (1 - at / passes)
        order_p, order_u = random.permutation(len(xp)), random.permutation(len(xu))
        for k in range(steps):
            p = xp[np.take(order_p, np.arange(k * batch, (k + 1) * batch), mode="wrap")]
            u = xu[np.take(order_u, np.arange(k * batch, (k + 1) * batch), mode="wrap")]
            x = np.concatenate([p, u])
            a, b, c, d = net.layers
            h = np.maximum(x @ a + b, 0)
            g = np.clip(h @ c + d, -30, 30)
            s = 1 / (1 + np.exp(-g))
            loss_negative = np.logaddexp(0, g)
            negative = loss_negative[batch:].mean() - prior * loss_negative[:batch].mean()
            slope = np.empty_like(g)
            if negative >= 0:
                slope[:batch], slope[batch:] = -prior / batch, s[batch:] / batch
            else:
                slope[:batch], slope[batch:] = prior * s[:batch] / batch, -s[batch:] / batch
            back = np.outer(slope, c) * (h > 0)
            grads = [x.T @ back + 1e-4 * a, back.sum(0), h.T @ slope + 1e-4 * c, slope.sum()]
            t += 1
            for i, (w, grad) in enumerate(zip(net.layers, grads, strict=True)):
                m, v = moments[i]
                m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
                moments[i] = (m, v)
                net.layers[i] = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


def fold(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string")), F.lit(FOLDS))


def _sample(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """At most ``TRAIN_ROWS`` of ``n`` rows, those with the least hashes of the key, so reruns agree."""
    share = min(1.0, 1.05 * TRAIN_ROWS / max(n, 1))
    draw = F.xxhash64(F.lit(seed), "id")
    return rows.where(F.pmod(draw, F.lit(1_000_000)) < int(share * 1_000_000)).orderBy(draw, *rows.columns).limit(TRAIN_ROWS)


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.3, row: str | None = None) -> DataFrame:
    """(key, held_out, score, predicted) for every document, and ``row`` if a column is named that tells rows apart.

    Only labels outside fold 0 are used: positives teach, and the share of positives
    among them estimates the class prior.  All documents are the unlabelled rows.  Both
    kinds are sampled down to ``TRAIN_ROWS``.  Scores come from the text alone; an empty
    or null text has figures of zero and a score like any other.  Without positives, all
    scores are 0.5.  Repeated rows score alike; a null key is scored and not held out.
    """
    kind = docs.schema[key].dataType.simpleString()
    own, own_kind = ([row], f"{row} {docs.schema[row].dataType.simpleString()}, ") if row else ([], "")
    rows = cut(docs.select(F.col(key).alias("id"), F.col(text).alias("text"), *own).mapInArrow(_features, f"id {kind}, {own_kind}x array<float>"))
    known = labels.select(F.col(key).alias("id"), F.col(label).alias("label")).where(fold(F.col("id")) != 0).where("label is not null")
    n_known, n_positive, n_rows = *known.agg(F.count("*"), F.coalesce(F.sum((F.col("label") == 1).cast("int")), F.lit(0))).first(), rows.count()
    net = None
    if n_positive:
        trusted = _sample(known.where("label = 1").select("id"), n_positive, 1)
        positive = _sample(rows.join(F.broadcast(trusted), "id", "left_semi"), 1, 3).toPandas()
        unlabelled = _sample(rows, n_rows, 2).toPandas()
        if len(positive) and len(unlabelled):
            prior = (n_positive + 1) / (n_known + 2)
            order = lambda x: np.stack(x.sort_values("id", kind="stable")["x"])
            net = fit_positive_unlabelled(order(positive), order(unlabelled), prior)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(batch.num_columns - 1).flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
            s = np.full(batch.num_rows, 0.5) if net is None else net.score(x.astype(np.float64))
            yield pa.record_batch([*batch.columns[:-1], pa.array(s)], [*batch.schema.names[:-1], "score"])

    scored = rows.mapInArrow(score, f"id {kind}, {own_kind}score double")
    return scored.select(*own, F.col("id").alias(key), F.coalesce(fold(F.col("id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
