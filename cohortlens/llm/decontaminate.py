"""Benchmark decontamination: an FM-index over each shard, searched for the test phrases."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.stage import lean, staged
from cohortlens.llm.words import ALNUM, hashed, words_of

#: Benchmark text given to the tasks at once. More is searched block after block.
BLOCK_CHARS = 16 << 20
#: Bytes of a row in which windows come from the task that makes them.
PART_BYTES = 8 << 20
#: Every so many-th text position of an index keeps its place; others walk to one.
SAMPLE = 8
#: Words of document text that one index covers (or one document, where that is longer).
SHARD_WORDS = 1 << 18


class Phrases(NamedTuple):
    """The windows of a block of benchmark items, over numbered words."""

    hashes: np.ndarray  # sorted hashes of the distinct words; a word's number is its place + 1
    grams: np.ndarray  # sorted codes of the word pairs that follow each other in an item
    windows: np.ndarray  # distinct windows by length and words, padded with 0
    lengths: np.ndarray
    owners: np.ndarray  # items of each window, one after the other
    bounds: np.ndarray  # of each window in owners, and the end
    item_ids: list


def phrases(items: pa.Table, size: int) -> Phrases:
    """Windows of ``size`` words; a shorter item is one window, one without words none."""
    ids, texts = items.column("item_id").to_pylist(), items.column("text").combine_chunks()
    texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
    rows: list[np.ndarray] = []
    for w in words_of(texts, ALNUM):
        h, bounds = hashed(w.data, w.starts, w.ends), w.bounds()
        rows += [h[a:b] for a, b in zip(bounds, bounds[1:])]
    hashes = np.unique(np.concatenate([np.zeros(0, np.uint64), *rows]))
    found: dict[bytes, set] = {}
    grams = [np.zeros(0, np.int64)]
    for item, row in zip(ids, rows):
        number = (np.searchsorted(hashes, row) + 1).astype(np.int64)
        grams.append(number[:-1] * (len(hashes) + 1) + number[1:])
        for a in range(max(1, len(number) - size + 1) if len(number) else 0):
            found.setdefault(number[a : a + size].tobytes(), set()).add(item)
    order = sorted(found)
    windows = np.zeros((len(order), size), np.int64)
    for k, x in enumerate(order):
        one = np.frombuffer(x, np.int64)
        windows[k, : len(one)] = one
    names = sorted({i for s in found.values() for i in s if i is not None}, key=str)
    place = {i: k for k, i in enumerate(names)}
    owners = [sorted(place[i] for i in found[x] if i is not None) for x in order]
    return Phrases(
        hashes, np.unique(np.concatenate(grams)), windows,
        np.array([len(x) // 8 for x in order], np.int64),
        np.array([k for o in owners for k in o], np.int64),
        np.concatenate(([0], np.cumsum([len(o) for o in owners]))).astype(np.int64), names,
    )


class WaveletMatrix:
    """Ranks of a symbol before a position, by the bits of the symbol from the highest."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for k in range(bits - 1, -1, -1):
            bit = (values >> k) & 1
            ones = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(values) - int(ones[-1]))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol comes before each position."""
        low = np.zeros_like(at)
        for k, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros):
            one = ((symbols >> k) & 1).astype(bool)
            low = np.where(one, zeros + ones[low], low - ones[low])
            at = np.where(one, zeros + ones[at], at - ones[at])
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros):
            one = ones[at + 1] > ones[at]
            out = out * 2 + one
            at = np.where(one, zeros + ones[at], at - ones[at])
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling. The text ends with its only 0."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, step = len(text), 1
    while True:
        key = rank * (n + 1)
        key[:-step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Backward search and location over one text of numbers from 1 to ``top``.

    Runs are parted by ``top + 1`` and the text is closed by 0.
    """

    def __init__(self, text: np.ndarray, top: int):
        order = suffix_array(text)
        last = text[order - 1]
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 2))))
        self.tree = WaveletMatrix(last, int(top + 1).bit_length())
        kept = order % SAMPLE == 0
        self.kept = np.concatenate(([0], np.cumsum(kept)))
        self.places = order[kept]
        self.size = len(text)

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range of each window; all windows go backward together while they match."""
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), self.size, np.int64)
        for back in range(1, windows.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            if not len(live):
                break
            c = windows[live, lengths[live] - back]
            low[live] = self.before[c] + self.tree.rank(c, low[live])
            high[live] = self.before[c] + self.tree.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: step to the one before until a sampled one is met."""
        out, steps = np.full(len(rows), -1, np.int64), 0
        at, todo = rows.copy(), np.arange(len(rows))
        while len(todo):
            met = self.kept[at + 1] > self.kept[at]
            out[todo[met]] = self.places[self.kept[at[met]]] + steps
            at, todo = at[~met], todo[~met]
            if len(todo):
                c = self.tree.access(at)
                at = self.before[c] + self.tree.rank(c, at)
            steps += 1
        return out


def hits(numbers: np.ndarray, rows: np.ndarray, n_rows: int, p: Phrases) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Merged spans ``start, end`` in the words of a shard, and the items met in each row.

    ``numbers``: of every word, 0 where no item has it. ``rows``: of every word.
    Only runs of words that a window could lie in go to the index: each neighbouring pair
    follows each other in an item too, and the run is as long as the shortest window.
    """
    none = np.zeros(0, np.int64)
    items: list[list[int]] = [[] for _ in range(n_rows)]
    if not len(p.windows) or not len(numbers):
        return none, none, items
    top = len(p.hashes)
    codes = numbers[:-1] * (top + 1) + numbers[1:]
    at = np.minimum(np.searchsorted(p.grams, codes), max(0, len(p.grams) - 1))
    tied = np.zeros(len(numbers) + 1, bool)  # to the word before
    if len(p.grams):
        tied[1:-1] = (numbers[:-1] > 0) & (numbers[1:] > 0) & (p.grams[at] == codes) & (rows[1:] == rows[:-1])
    heads = np.flatnonzero(~tied[:-1])
    tails = np.flatnonzero(~tied[1:]) + 1
    keep = (tails - heads >= p.lengths.min()) & (numbers[heads] > 0)
    heads, tails = heads[keep], tails[keep]
    if not len(heads):
        return none, none, items
    sizes = tails - heads
    first = np.cumsum(sizes + 1) - sizes - 1  # of each run in the index's text
    text = np.full(int((sizes + 1).sum()) + 1, top + 1, np.int64)
    text[-1] = 0
    inside = np.repeat(heads - first, sizes) + (places := np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum()))
    text[places] = numbers[inside]
    index = FMIndex(text, top)
    present = np.bincount(text, minlength=top + 2) > 0
    present[0] = True
    asked = np.flatnonzero(present[p.windows].all(axis=1))
    low, high = index.search(p.windows[asked], p.lengths[asked])
    count = high - low
    met = np.repeat(np.arange(len(asked)), count)
    spot = index.locate(np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum()))
    run = np.searchsorted(first, spot, "right") - 1
    start = heads[run] + spot - first[run]
    end = start + p.lengths[asked][met]
    pair = np.unique(rows[start] * len(p.windows) + asked[met])
    for x in pair.tolist():
        row, window = divmod(x, len(p.windows))
        items[row] += p.owners[p.bounds[window] : p.bounds[window + 1]].tolist()
    order = np.lexsort((end, start))
    start, end = start[order], end[order]
    if not len(start):
        return none, none, items
    reach = np.maximum.accumulate(end)
    new = np.concatenate(([True], (start[1:] > reach[:-1]) | (rows[start[1:]] != rows[start[:-1]])))
    return start[new], reach[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(start) - 1]))], items


FOUND = "array<struct<start: long, end: long>>"


def _searched(docs: DataFrame, p: Phrases) -> DataFrame:
    """``docs`` (text, row, n_words, spans, item_ids) with this block's findings added."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old_spans, old_items = batch.column("spans").to_pylist(), batch.column("item_ids").to_pylist()
            counts, spans, items = [], [], []
            for w in words_of(batch.column("text"), ALNUM, 8 * SHARD_WORDS):
                h = hashed(w.data, w.starts, w.ends)
                at = np.minimum(np.searchsorted(p.hashes, h), max(0, len(p.hashes) - 1))
                numbers = np.where(p.hashes[at] == h, at + 1, 0) if len(p.hashes) else np.zeros(len(h), np.int64)
                rows, bounds = np.repeat(np.arange(len(w.counts)), w.counts), w.bounds()
                start, end, met = hits(numbers, rows, len(w.counts), p)
                own = rows[start] if len(start) else start
                cut = np.searchsorted(own, np.arange(len(w.counts) + 1))
                for k in range(len(w.counts)):
                    mine = [(int(a - bounds[k]), int(b - bounds[k])) for a, b in zip(start[cut[k] : cut[k + 1]], end[cut[k] : cut[k + 1]])]
                    i = w.first + k
                    spans.append(merged([*((x["start"], x["end"]) for x in old_spans[i]), *mine]))
                    items.append(sorted({*old_items[i], *(str(p.item_ids[x]) for x in met[k])}))
                counts += w.counts.tolist()
            out = {
                "n_words": pa.array(counts, pa.int64()),
                "spans": pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "item_ids": pa.array(items, pa.list_(pa.string())),
            }
            yield pa.record_batch([out.get(n, batch.column(n)) for n in batch.schema.names], batch.schema.names)

    return docs.mapInArrow(lean(of), docs.schema)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with ``n_words, spans, item_ids`` (columns of these names are replaced).

    Words: A-Z lower-cased, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A window is ``size``
    consecutive words of an item, or the whole of a shorter one. ``spans``: the merged word
    ranges (from, to) that occurrences of windows cover; ``item_ids``: the items that have
    an occurring window, sorted as strings.

    Each task cuts its documents into shards of whole documents and builds an FM-index for
    each: suffix array by prefix doubling, its last column in a wavelet matrix, every
    eighth position sampled. All windows search it together.

    The benchmark is taken in blocks of at most ``block_chars`` characters (one item, if it
    is longer), dealt by a hash of the item. A task makes the windows of a block, which go
    to all tasks, and the documents pass once for each block; between two blocks they are
    written with what was found, so no more than one block is held anywhere. Null texts have
    no words; the windows of an item with a null id are searched too, but it is not listed.
    No benchmark or no documents: no spans, or no rows.
    """
    items = benchmark.filter("text is not null").select("item_id", "text")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n_blocks = max(1, -(-total // max(1, block_chars // 2))) if total > block_chars else 1
    names = [c for c in docs.columns if c not in ("n_words", "spans", "item_ids")]
    out = docs.select(
        *names, F.lit(0).cast("long").alias("n_words"), F.array().cast(FOUND).alias("spans"),
        F.array().cast("array<string>").alias("item_ids"),
    )
    for k in range(n_blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k) if n_blocks > 1 else items
        if k:
            out = staged(out, "found")
        out = _searched(out, block_phrases(part, size))
    return out


def block_phrases(items: DataFrame, size: int) -> Phrases:
    """``phrases`` of a block of items, made by one task: at most ``BLOCK_CHARS`` and an item."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = list(batches)
        held = pa.Table.from_batches(given) if given else schema.empty_table()
        raw = pickle.dumps(phrases(held, size))
        parts = [raw[k : k + PART_BYTES] for k in range(0, len(raw), PART_BYTES)]
        for k, part in enumerate(parts):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.binary())], ["k", "part"])

    schema = pa.schema([("item_id", pa.string()), ("text", pa.string())])
    texts = items.select(F.col("item_id").cast("string").alias("item_id"), "text").coalesce(1)
    found = texts.mapInArrow(of, "k int, part binary").collect()
    if not found:
        return phrases(schema.empty_table(), size)
    return pickle.loads(b"".join(bytes(r["part"]) for r in sorted(found, key=lambda r: r["k"])))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of each document."""
    found = contaminated_spans(docs.select("doc_id", "text"), benchmark, size)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark."""
    extra = [c for c in ("n_words", "spans", "item_ids") if c in docs.columns]
    held = docs.withColumnsRenamed({c: f"own {c}" for c in extra})
    found = contaminated_spans(held, benchmark, size).filter(F.size("spans") == 0).drop("n_words", "spans", "item_ids")
    return found.withColumnsRenamed({f"own {c}": c for c in extra}).select(*docs.columns)
