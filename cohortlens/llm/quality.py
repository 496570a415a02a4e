"""Quality scores: random Fourier features, ridge by summed normal equations, isotonic fit."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.language import is_held_out
from cohortlens.llm.stage import staged
from cohortlens.llm.words import MULTIPLIER, NOT_SPACE, Words, hashed, mixed, words_of

#: Cosines that approximate the Gaussian kernel.
COSINES = 200
#: Parts of the training rows; each is scored by a fit on the others for calibration.
FOLDS = 3
RIDGES = (1e-4, 1e-3, 1e-2, 1e-1)
#: Bins of raw scores for the isotonic fit, over -1 to 2.
BINS = 1024
#: Tasks that add up the sums of the partitions, and rows that reach the driver.
ADDERS = 16
KEEP_FROM = 0.3

#: Byte classes: upper, lower, digit, end mark, comma, other punctuation, symbol, bar,
#: space, newline, other white space, beyond ASCII, control.
_CLASS = np.full(256, 12)
for _k, _s in enumerate(
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".!?", ",", "'\"();:-", "#$%&*+/<=>@[\\]^_`{}~", "|", " ", "\n", "\t\r\v\f")
):
    _CLASS[np.frombuffer(_s.encode(), np.uint8)] = _k
_CLASS[128:] = 11
_LINE = np.arange(256) != 10


def _grouped(rows: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row its distinct keys and the count of its most frequent key."""
    order = np.lexsort((keys, rows))
    r, k = rows[order], keys[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(r)))
    top = np.zeros(n)
    np.maximum.at(top, r[at], runs)
    return np.bincount(r[at], minlength=n), top


def statistics(w: Words, lines: Words) -> np.ndarray:
    """Statistics of whole texts, a row each. An empty text has zeros."""
    n = len(w.counts)
    size = np.diff(w.offsets)
    byte_row = np.repeat(np.arange(n), size)
    share = lambda x, of: x / np.maximum(of, 1)
    classes = np.bincount(byte_row * 13 + _CLASS[w.data], minlength=n * 13).reshape(n, 13)
    freq = np.bincount(byte_row * 256 + w.data, minlength=n * 256).reshape(n, 256) / np.maximum(size, 1)[:, None]
    entropy = -(freq * np.log2(np.where(freq > 0, freq, 1))).sum(axis=1)
    rows, length, h = np.repeat(np.arange(n), w.counts), w.ends - w.starts, hashed(w.data, w.starts, w.ends)
    add = lambda v: np.bincount(rows, weights=v, minlength=n)
    mean = share(add(length), w.counts)
    spread = np.sqrt(np.maximum(0, share(add(length.astype(float) ** 2), w.counts) - mean**2))
    distinct, top = _grouped(rows, h, n)
    pair_in = rows[1:] == rows[:-1]
    pairs = mixed(h[:-1][pair_in] * MULTIPLIER ^ h[1:][pair_in])
    pair_distinct, pair_top = _grouped(rows[1:][pair_in], pairs, n)
    n_pairs = np.maximum(0, w.counts - 1)
    kinds = _CLASS[w.data]
    first, last = (kinds[w.starts], kinds[w.ends - 1]) if len(w.starts) else (rows, rows)
    line_rows, line_hash = np.repeat(np.arange(n), lines.counts), hashed(lines.data, lines.starts, lines.ends)
    line_distinct, _ = _grouped(line_rows, line_hash, n)
    ended = np.bincount(line_rows, weights=(kinds[lines.ends - 1] == 3) if len(lines.ends) else None, minlength=n)
    shares = [share(classes[:, k], size) for k in range(13)]
    return np.column_stack([
        np.log1p(size), np.log1p(w.counts), mean, spread, share(distinct, w.counts), share(top, w.counts),
        share(pair_distinct, n_pairs), share(pair_top, n_pairs), *shares, entropy,
        share(add(first == 0), w.counts), share(add((first == 0) & (last == 0) & (length > 1)), w.counts),
        share(add(last == 3), w.counts), share(add(last >= 5), w.counts), share(add(length <= 3), w.counts),
        share(add(length > 15), w.counts), np.log1p(share(size, lines.counts)),
        share(line_distinct, lines.counts), share(ended, lines.counts),
    ])


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, x``: the statistics of each document as bytes."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for w, lines in zip(words_of(texts, NOT_SPACE), words_of(texts, _LINE)):
                x = statistics(w, lines)
                yield pa.record_batch(
                    [ids.slice(w.first, len(x)), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"]
                )

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, x binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array([np.frombuffer(v, np.float64) for v in column.to_pylist()])


def summed(rows: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
    """The sum of an array over all batches: in each partition, then in a few tasks."""

    def total(arrays: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        out = None
        for x in arrays:
            out = x.astype(np.float64) if out is None else out + x
        if out is not None:
            yield pa.record_batch([pa.array([out.tobytes()], pa.binary())], ["part"])

    parts = rows.mapInArrow(lambda batches: total(of(b) for b in batches if b.num_rows), "part binary")
    read = lambda b: (np.frombuffer(v, np.float64) for v in b.column("part").to_pylist())
    few = parts.repartition(ADDERS).mapInArrow(lambda batches: total(v for b in batches for v in read(b)), "part binary")
    found = [np.frombuffer(r["part"], np.float64) for r in few.collect()]
    return sum(found[1:], found[0]) if found else None


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    at: np.ndarray  # raw scores, and what they mean after calibration
    means: np.ndarray


def cosines(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, waves: np.ndarray, phases: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    return np.hstack((np.sqrt(2 / len(phases)) * np.cos(z @ waves + phases), np.ones((len(z), 1))))


def rising(means: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The closest rising sequence, by pooling neighbours that fall."""
    pools: list[list[float]] = []
    for m, c in zip(means, counts):
        pools.append([m, c, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])


def trained(rows: DataFrame) -> Model | float:
    """A model of ``rows`` (doc_id, x, y); the mean label where there is nothing to tell.

    Three passes, each summed over partitions: moments of the statistics; normal equations
    of each fold; counts and labels by binned score, each row scored by the fit on the
    other folds. What reaches the driver has the same size for any input.
    """
    first = summed(
        rows,
        lambda b: np.concatenate(
            ([b.num_rows, np.sum(b.column("y").to_numpy())], (m := _matrix(b.column("x"))).sum(axis=0), (m**2).sum(axis=0))
        ),
    )
    if first is None:
        return 0.5
    n, positive = first[0], first[1]
    if positive in (0, n):
        return float(positive / n)
    half = (len(first) - 2) // 2
    mean = first[2 : 2 + half] / n
    scale = np.sqrt(np.maximum(first[2 + half :] / n - mean**2, 0))
    scale = np.where(scale > 1e-9, scale, 1)
    drawn = np.random.default_rng(5)
    waves, phases = drawn.normal(size=(half, COSINES)) / np.sqrt(half), drawn.uniform(0, 2 * np.pi, COSINES)
    size = COSINES + 1

    def equations(b: pa.RecordBatch) -> np.ndarray:
        z, y = cosines(_matrix(b.column("x")), mean, scale, waves, phases), b.column("y").to_numpy().astype(float)
        fold, out = b.column("fold").to_numpy(), []
        for k in range(FOLDS):
            zk, yk = z[fold == k], y[fold == k]
            out += [(zk.T @ zk).ravel(), zk.T @ yk, [len(yk), yk @ yk]]
        return np.concatenate(out)

    parts = summed(rows, equations).reshape(FOLDS, -1)
    gram, moment, count = parts[:, : size * size].reshape(FOLDS, size, size), parts[:, size * size : -2], parts[:, -2]

    def solved(a: np.ndarray, b: np.ndarray, n: float, ridge: float) -> np.ndarray:
        return np.linalg.solve(a + ridge * max(n, 1) / size * np.eye(size), b)

    def fits(ridge: float) -> list[np.ndarray]:
        return [solved(gram.sum(0) - gram[k], moment.sum(0) - moment[k], n - count[k], ridge) for k in range(FOLDS)]

    def loss(ridge: float) -> float:
        return sum(w @ gram[k] @ w - 2 * w @ moment[k] for k, w in enumerate(fits(ridge)))

    ridge = min(RIDGES, key=loss)
    others = np.array(fits(ridge))

    def binned(b: pa.RecordBatch) -> np.ndarray:
        z, y = cosines(_matrix(b.column("x")), mean, scale, waves, phases), b.column("y").to_numpy()
        raw = (z * others[b.column("fold").to_numpy()]).sum(axis=1)
        at = np.clip(((raw + 1) / 3 * BINS).astype(int), 0, BINS - 1)
        return np.concatenate((np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS), np.bincount(at, weights=raw, minlength=BINS)))

    counts, labels, raws = summed(rows, binned).reshape(3, BINS)
    used = counts > 0
    means = rising(labels[used] / counts[used], counts[used])
    at = raws[used] / counts[used]
    return Model(mean, scale, waves, phases, solved(gram.sum(0), moment.sum(0), n, ridge), at, means)


def scored(rows: DataFrame, model: Model | float) -> DataFrame:
    """``doc_id, score`` of rows (doc_id, x)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            if isinstance(model, float):
                score = np.full(b.num_rows, model)
            else:
                raw = cosines(_matrix(b.column("x")), *model[:4]) @ model.weights
                score = np.clip(np.interp(raw, model.at, model.means), 0, 1)
            yield pa.record_batch([b.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(of, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each document.

    Fitted on labels (0 or 1) of documents whose crc32(doc_id) mod 5 isn't 0; a document
    with several labels counts once for each. Scores use the text's statistics alone; null
    counts as empty. Without labels every score is 0.5, with labels of one kind that kind.
    """
    rows = staged(measured(docs), "statistics")
    known = labels.filter("quality in (0, 1)").select("doc_id", F.col("quality").cast("long").alias("y"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).alias("fold")
    train = rows.filter("doc_id is not null").filter(~is_held_out(F.col("doc_id"), 5, 0)).join(known, "doc_id").select("doc_id", "x", "y", fold)
    return scored(rows, trained(staged(train, "training"))).select(
        "doc_id",
        is_held_out(F.col("doc_id"), 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"),
    )
