"""Best-fit packing of token sequences: large pieces are matched in pairs, small ones fill the gaps.

What decides a packing is how many pieces there are of each length, at most one number for
each length up to the capacity. So the packing is worked out for whole groups of equal
sequences and equal pieces, and the pieces then look up their places by their length and
their number among the pieces of it, in parallel.
"""

from __future__ import annotations

import bisect
import json
import os
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.byte_bpe import byte_of_character, split_pattern, vocabulary
from cohortlens.llm.chunks import Chunks, Column
from cohortlens.llm.stage import LEAST_FILES, lean, staged
from cohortlens.llm.words import byte_rows, slices

#: Tokens of a sequence, and the token that ends a document.
CAPACITY, END = 1024, 2
SLICE_TEXT_BYTES = 1 << 22
#: Estimated bytes of chunks that a task keeps.
KEPT_BYTES = 96 << 20
#: Counts by task and length that are broadcast at most; more are joined by shuffle.
BROADCAST_COUNTS = 1 << 17
#: Characters below this one have been in Unicode for long, so every pattern reads them alike.
PLAIN_BELOW = "\u0370"


class Tokens(Chunks):
    """Token ids of texts by a ``tokenizers`` file, without special tokens added."""

    def __init__(self, vocab: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_str(vocab)
        self.pattern = regex.compile(pattern)
        # the model alone, on pieces in its alphabet with a space between them
        self.by_piece = Tokenizer(self.tokenizer.model)
        self.by_piece.pre_tokenizer = WhitespaceSplit()
        spec, back = json.loads(vocab), byte_of_character()
        special = {t["id"]: t["content"] for t in spec["added_tokens"]}
        sizes = {i: len(t) for t, i in spec["model"]["vocab"].items()} | {i: len(t.encode()) for i, t in special.items()}
        self.sizes = np.array([sizes.get(i, 0) for i in range(max(sizes) + 1)], np.int64)
        if not all(c in back for t, i in spec["model"]["vocab"].items() if i not in special for c in t):
            raise ValueError("this is no byte-level vocabulary")
        # no text has a byte 255; it stands between pieces
        self.characters = {b: c for c, b in back.items()} | {255: " "}
        self.special = tuple(special.values())
        self.found = Column(np.uint32)
        super().__init__(KEPT_BYTES)

    def forget(self, n: int) -> None:
        self.found.cut(n)

    def sorted(self, chunks: Iterable[str]) -> Iterable[str]:
        return sorted(chunks, key=lambda c: not c.isascii() and max(c) >= PLAIN_BELOW)

    def learn(self, run: list[str]) -> int:
        """Latin text is cut by the pattern here, and its pieces go to the model in one call;
        other text, and names of special tokens, go to the whole tokenizer."""
        text = "".join(run)
        if (text.isascii() or max(text) < PLAIN_BELOW) and not any(s in text for s in self.special):
            apart = "\udcff".join(self.pattern.findall(text)).encode("utf-8", "surrogateescape")
            pieces = apart.decode("latin-1").translate(self.characters)
            ids = np.array(self.by_piece.encode_batch_fast([pieces], add_special_tokens=False)[0].ids, np.int64)
        else:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int64)
        cuts = np.cumsum(list(map(len, run)) if text.isascii() else [len(c.encode()) for c in run])
        self.found.add(ids, np.searchsorted(np.cumsum(self.sizes[ids]), cuts, "right"))
        return len(ids)

    def ids(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of texts (bytes and their bounds), end to end, and each text's bounds."""
        numbers, bounds = self.numbers(data, off)
        ids, ends = self.found.gathered(numbers)
        return ids, ends[bounds]


@lru_cache(maxsize=2)
def _tokens(vocab: str, pattern: str) -> Tokens:
    return Tokens(vocab, pattern)


def cut(size: int, capacity: int) -> list[int]:
    """Where the pieces of a document of ``size`` tokens start; only the first may be short."""
    first = size % capacity
    return [0, *range(first, size, capacity)] if first else list(range(0, size, capacity))


def pieces(docs: DataFrame, vocab: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, part, nth`` of every document's pieces.

    ``nth`` counts the pieces of a length within the task ``part``. A document's tokens are
    those of its whole text (null: empty) and ``end``. With ``keep_ids`` also ``ids``, the
    tokens as little-endian unsigned 32-bit integers.
    """
    pattern = split_pattern()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"] + ["ids"] * keep_ids

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part, seen = _tokens(vocab, pattern), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            doc_ids, (data, off) = batch.column(0).to_pylist(), byte_rows(batch.column(1))
            for a, b in slices(off, SLICE_TEXT_BYTES):
                rows = []
                ids, bounds = model.ids(data, off[a : b + 1])
                ids = ids.astype("<u4")
                for doc_id, s, e in zip(doc_ids[a:b], bounds, bounds[1:]):
                    raw, size = ids[s:e].tobytes() + last, int(e - s) + 1
                    starts = cut(size, capacity)
                    for k, (s, e) in enumerate(zip(starts, [*starts[1:], size])):
                        own = raw[4 * s : 4 * e]
                        rows.append((doc_id, k, s, e - s, zlib.crc32(own), part, int(seen[e - s]), *[own] * keep_ids))
                        seen[e - s] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow)], names)

    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("doc_id", id_type), T.StructField("piece", T.IntegerType())]
        + [T.StructField(n, T.LongType()) for n in names[2:5]] + [T.StructField("part", T.IntegerType()), T.StructField("nth", T.LongType())]
        + [T.StructField("ids", T.BinaryType())] * keep_ids
    )
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(f.dataType) for f in schema]
    return docs.select("doc_id", F.col("text").alias("text")).mapInArrow(lean(of), schema)


class Plan(NamedTuple):
    """Places of the pieces of each length, as runs of equal ones, by length and number.

    The pieces ``first``, ``first + 1``, ... of ``length`` go to the sequences from ``bin``
    on, ``per`` in each, the first of them at ``offset``.
    """

    length: np.ndarray
    first: np.ndarray
    per: np.ndarray
    bin: np.ndarray
    offset: np.ndarray
    sequences: int


class _Packer:
    """Sequences in groups of equal free space: ``gaps[space]`` is a list of [first, count]."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = {s: n for s, n in sorted(counts.items()) if n}
        self.capacity, self.rows, self.given = capacity, [], dict.fromkeys(self.left, 0)
        self.gaps: dict[int, list[tuple[int, int]]] = {}
        self.spaces: list[int] = []  # keys of gaps, rising
        self.n_bins = 0

    def put(self, size: int, first: int, bins: int, per: int, space: int) -> None:
        """``per`` pieces of a size into each of ``bins`` sequences that have ``space``."""
        if bins:
            self.rows.append((size, self.given[size], per, first, self.capacity - space))
            self.given[size] += bins * per
            self.left[size] -= bins * per
            self.free(first, bins, space - per * size)

    def free(self, first: int, bins: int, space: int) -> None:
        if bins and space:
            if space not in self.gaps:
                bisect.insort(self.spaces, space)
            self.gaps.setdefault(space, []).append((first, bins))

    def taken(self, space: int) -> tuple[int, int]:
        out = self.gaps[space].pop()
        if not self.gaps[space]:
            del self.gaps[space]
            self.spaces.remove(space)
        return out

    def opened(self, bins: int) -> int:
        self.n_bins += bins
        return self.n_bins - bins

    def match_large(self) -> None:
        """Pieces over a third: the largest is paired with the largest that still fits."""
        large = [s for s in self.left if 3 * s > self.capacity]
        while large:
            a = large.pop()
            while self.left[a]:
                fits = bisect.bisect_right(large, self.capacity - a)
                while fits and not self.left[large[fits - 1]]:
                    fits -= 1
                b = a if 2 * a <= self.capacity and self.left[a] > 1 else large[fits - 1] if fits else 0
                if a == b:
                    n = self.left[a] // 2
                    self.put(a, self.opened(n), n, 2, self.capacity)
                else:
                    n = min(self.left[a], self.left[b]) if b else self.left[a]
                    first = self.opened(n)
                    if b:
                        self.rows += [(a, self.given[a], 1, first, 0), (b, self.given[b], 1, first, a)]
                        for s in (a, b):
                            self.given[s] += n
                            self.left[s] -= n
                        self.free(first, n, self.capacity - a - b)
                    else:
                        self.put(a, first, n, 1, self.capacity)

    def fit_small(self) -> None:
        """The others, longest first, each into the smallest gap that holds it.

        A sequence that took a piece has the smallest such gap again while it holds one more,
        so each of a group of equal gaps takes all it can before the next one does.
        """
        for s in sorted((s for s in self.left if 3 * s <= self.capacity), reverse=True):
            while self.left[s]:
                at = bisect.bisect_left(self.spaces, s)
                if at < len(self.spaces):
                    space = self.spaces[at]
                    first, bins = self.taken(space)
                else:
                    space, bins = self.capacity, -(-self.left[s] // (self.capacity // s))
                    first = self.opened(bins)
                per = space // s
                full = min(bins, self.left[s] // per)
                self.put(s, first, full, per, space)
                rest = self.left[s] if full < bins else 0
                if rest:
                    self.put(s, first + full, 1, rest, space)
                self.free(first + full + bool(rest), bins - full - bool(rest), space)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Best fit, longest first, of ``counts[length]`` pieces into sequences of ``capacity``.

    Optimal for pieces over a third of the capacity alone. The work and the size of the plan
    depend on the number of different lengths, not on the number of pieces.
    """
    packer = _Packer(counts, capacity)
    packer.match_large()
    packer.fit_small()
    rows = np.array(sorted(packer.rows), np.int64).reshape(-1, 5)
    return Plan(*rows.T, packer.n_bins)


def placed(rows: DataFrame, found: Plan) -> DataFrame:
    """``rows`` (``length`` and ``number``, the place among its length) with their places."""
    key = (found.length << 44) + found.first

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, number = (batch.column(n).to_numpy() for n in ("length", "number"))
            row = np.searchsorted(key, (size << 44) + number, "right") - 1
            later = number - found.first[row]
            sequence = found.bin[row] + later // found.per[row]
            offset = found.offset[row] + later % found.per[row] * size
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(offset)], [*batch.schema.names, "sequence_id", "offset"])

    schema = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return rows.mapInArrow(of, schema)


def with_number(found: DataFrame, counts: DataFrame, few: bool) -> DataFrame:
    """``found`` with ``number``, a piece's place among all of its length, for ``part`` and ``nth``.

    With ``few`` counts the pieces stay where they are, so the result has no more files than
    they have. Else nothing is broadcast: the counts' files are far smaller than their rows,
    so Spark would take them for a small table.
    """
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    earlier = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = found.join(earlier.hint("broadcast" if few else "merge"), ["part", "length"])
    return numbered.withColumn("number", F.col("before") + F.col("nth")).drop("before", "nth", "part")


def packed(docs: DataFrame, vocab: str | None = None, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece.

    Documents of more than ``capacity`` tokens (``end`` included) are cut into pieces of it,
    the first one shorter if need be; no other is. Null and empty texts are the token
    ``end``. Rows that repeat an id or a text are documents of their own; a null id stays
    null; other columns are not read. An empty table gives no rows. With ``keep_ids`` also
    ``ids``, see ``sequences``.

    Pieces are counted by task and length; the counts before a task's give each piece its
    number among all of its length. Only the sum for each length, and how many counts it
    has, comes to the driver, and the plan goes back to the tasks.
    """
    found = staged(pieces(docs, vocab or vocabulary(), capacity, end, keep_ids), "pieces")
    counts = staged(found.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths", LEAST_FILES)
    sums = counts.groupBy("length").agg(F.sum("n").alias("n"), F.count("*").alias("parts")).collect()
    places = plan({r["length"]: r["n"] for r in sums}, capacity)
    numbered = with_number(found, counts, sum(r["parts"] for r in sums) <= BROADCAST_COUNTS)
    return placed(numbered, places).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * keep_ids)


def sequences(rows: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids`` of rows packed with ``keep_ids``: the filled sequences.

    A group is one sequence, so it never holds more than its capacity.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    joined = F.unhex(F.array_join(F.transform(parts, lambda p: p["ids"]), ""))
    return rows.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
