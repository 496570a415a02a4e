"""Alignment of two tokenizers over the same texts, by the bytes at which tokens of both end."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.byte_bpe import byte_of_character, vocabulary
from cohortlens.llm.chunks import Chunks, Column
from cohortlens.llm.stage import staged
from cohortlens.llm.words import byte_rows, slices

SLICE_TEXT_BYTES = 1 << 22
SPACE = "▁"


def piece_model(path: str | None = None) -> bytes:
    """A ``sentencepiece`` file; by default the public 32k one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def byte_vocabulary(vocab: str) -> list[bytes]:
    """The bytes of each token of a byte-level ``tokenizers`` file."""
    spec, back = json.loads(vocab), byte_of_character()
    tokens = {i: bytes(back[c] for c in t) for t, i in spec["model"]["vocab"].items() if i not in {x["id"] for x in spec["added_tokens"]}}
    tokens |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return [tokens.get(i, b"") for i in range(max(tokens) + 1)]


def piece_vocabulary(processor) -> list[bytes]:
    """The bytes of each piece; control pieces stand for none in a text."""
    out = []
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if processor.is_byte(i) else piece.replace(SPACE, " ").encode())
        if " " in out[-1].decode("latin-1").lstrip(" ") or b"\n" in out[-1] and not processor.is_byte(i):
            raise ValueError(f"the piece {piece!r} reaches over a space or line end")
    return out


def possible_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Sorted codes (A id << 32) + B id of all pairs that can end at the same byte of a text.

    The shorter token's bytes are then the end of the longer one's. So the pairs are bounded
    by the vocabularies, whatever the corpus.
    """
    ids_of: list[dict[bytes, list[int]]] = [{}, {}]
    for found, tokens in zip(ids_of, (a, b)):
        for i, t in enumerate(tokens):
            if t:
                found.setdefault(t, []).append(i)
    pairs = {(i << 32) + j for i, t in enumerate(a) for k in range(len(t)) for j in ids_of[1].get(t[k:], ())}
    pairs |= {(i << 32) + j for j, t in enumerate(b) for k in range(1, len(t)) for i in ids_of[0].get(t[k:], ())}
    return np.array(sorted(pairs), np.int64)


def refined_ends(starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends of tokens from coarse spans, in bytes, and the decoded bytes of each token.

    A span that is as long as the token's bytes is a cut. One of a part of a character, or of
    a byte token, is not; there the decoded bytes since the last cut are counted.
    """
    whole = ends - starts == sizes
    total = np.cumsum(sizes)
    last = np.maximum.accumulate(np.where(whole, np.arange(len(sizes)), -1))
    since = np.where(last >= 0, total - total[last], total)
    return np.where(whole, ends, np.where(last >= 0, ends[last], 0) + since)


class Aligner(Chunks):
    """What both tokenizers make of texts; a chunk starts and ends with tokens of both."""

    def __init__(self, vocab: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocab)
        self.tokenizer.encode_special_tokens = True
        self.processor = SentencePieceProcessor(model_proto=model)
        self.tokens = byte_vocabulary(vocab), piece_vocabulary(self.processor)
        self.sizes = [np.array([len(t) for t in v], np.int64) for v in self.tokens]
        self.pairs = possible_pairs(*self.tokens)
        self.links = Column(np.int32)
        self.sums = np.zeros((1 << 12, 3), np.int64)  # A tokens, B tokens, whether the bytes differ
        self.groups: list[str] = []
        super().__init__()

    def forget(self, n: int) -> None:
        self.links.cut(n)
        del self.groups[n:]

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
        """A ids and byte ends, B ids and byte ends of a text that starts with a space or line
        end, and whether both have exactly its bytes."""
        raw = text.encode()
        place = np.flatnonzero(np.append(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80, True))  # byte of each character
        found = self.tokenizer.encode(text, add_special_tokens=False)
        a, coarse = np.array(found.ids, np.int64), place[np.array(found.offsets, np.int64).reshape(-1, 2)]
        a_ends = refined_ends(coarse[:, 0], coarse[:, 1], self.sizes[0][a])
        # the processor puts a space before its input: the text's own, or one that goes again
        shift = 1 if text[0] == " " else 0
        if text == " ":  # of nothing it makes nothing, without that space
            return a, a_ends, np.array([self.processor.piece_to_id(SPACE)]), np.ones(1, np.int64), True
        pieces = self.processor.encode(text[shift:], return_type="proto").pieces
        b = np.array([p.id for p in pieces], np.int64)
        starts, ends = (np.array([getattr(p, n) for p in pieces], np.int64) + shift for n in ("begin", "end"))
        if shift:
            starts[0:1] = 0
        else:
            b, starts, ends = b[1:], starts[1:], ends[1:]
        b_ends = refined_ends(starts, ends, self.sizes[1][b])
        same = b"".join(map(self.tokens[0].__getitem__, a)) == raw == b"".join(map(self.tokens[1].__getitem__, b))
        return a, a_ends, b, b_ends, same

    def learn(self, run: list[str]) -> int:
        a, a_ends, b, b_ends, same = self.spans("".join(run))
        if not same and len(run) > 1:
            return sum(self.learn([chunk]) for chunk in run)
        self.sums = self.sums if self.links.n + len(run) <= len(self.sums) else np.concatenate((self.sums, np.zeros((max(len(self.sums), len(run)), 3), np.int64)))
        n = self.links.n
        if not same:
            self.sums[n] = 0, 0, 1
            self.links.add(np.zeros(0, np.int32), np.zeros(1, np.int64))
            self.groups.append("")
            return 0
        cuts = np.cumsum([len(c.encode()) for c in run])
        both, at_a, at_b = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
        self.links.add(np.searchsorted(self.pairs, (a[at_a] << 32) + b[at_b]).astype(np.int32), np.searchsorted(both, cuts, "right"))
        for k, ends in enumerate((a_ends, b_ends)):
            upto = np.searchsorted(ends, cuts, "right")
            self.sums[n : n + len(run), k] = np.diff(upto, prepend=0)
        self.sums[n : n + len(run), 2] = 0
        a_text, b_text = list(map(str, a.tolist())), list(map(str, b.tolist()))
        x = y = 0
        own: list[str] = []
        stops = iter(cuts.tolist())
        stop = next(stops)
        for end, p, q in zip(both.tolist(), at_a.tolist(), at_b.tolist()):
            own.append(",".join(a_text[x : p + 1]) + "|" + ",".join(b_text[y : q + 1]))
            x, y = p + 1, q + 1
            if end == stop:
                self.groups.append(";".join(own))
                own, stop = [], next(stops, -1)
        return 4 * (len(a) + len(b))


@lru_cache(maxsize=1)
def _aligner(vocab: str, model: bytes) -> Aligner:
    return Aligner(vocab, model)


def aligned(docs: DataFrame, vocab: str | None = None, model: bytes | None = None, keep_groups: bool = False) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, groups_sha256, links`` of every whole text.

    A: tokens of a space and the text by a ``tokenizers`` file, names of special tokens read
    as text. B: pieces of the text by a ``sentencepiece`` file, which puts the space itself.
    A group ends where tokens of both end; such a place links the two tokens. ``links`` are
    their numbers in ``possible_pairs``, little-endian 32-bit. Groups are written as ids
    ``a1,a2|b1;a3|b2,b3``; with ``keep_groups`` the column ``groups`` holds that text.

    A null or empty text, or one whose A or B bytes differ from it, has no tokens: zeros, no
    links, and '' for both columns of groups. Rows that repeat an id give a row each; an
    empty table gives none; columns other than ``doc_id`` and ``text`` are not read.
    """
    vocab, model = vocab or vocabulary(), model or piece_model()
    new = ["n_a", "n_b", "n_groups"]
    texts = ["groups_sha256"] + ["groups"] * keep_groups

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(vocab, model)
        for batch in batches:
            data, off = byte_rows(batch.column(1))
            for i, j in slices(off, SLICE_TEXT_BYTES):
                numbers, bounds = aligner.numbers(data, off[i : j + 1])
                totals = np.concatenate((np.zeros((1, 3), np.int64), np.cumsum(aligner.sums[numbers], axis=0)))
                totals = np.diff(totals[bounds], axis=0)
                links, ends = aligner.links.gathered(numbers)
                at = ends[bounds]
                good = (totals[:, 2] == 0) & (np.diff(off[i : j + 1]) > 0)
                numbers = numbers.tolist()
                groups = [";".join(map(aligner.groups.__getitem__, numbers[s:e])) if g else "" for g, s, e in zip(good, bounds, bounds[1:])]
                kept = [links[s:e].astype("<i4").tobytes() if g else b"" for g, s, e in zip(good, at, at[1:])]
                counts = [np.where(good, x, 0) for x in (totals[:, 0], totals[:, 1], np.diff(at))]
                digests = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in groups]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *map(pa.array, counts), pa.array(digests, pa.string()), *[pa.array(groups, pa.string())] * keep_groups, pa.array(kept, pa.binary())],
                    ["doc_id", *new, *texts, "links"],
                )

    schema = T.StructType(
        [docs.schema["doc_id"]] + [T.StructField(n, T.LongType()) for n in new]
        + [T.StructField(n, T.StringType()) for n in texts] + [T.StructField("links", T.BinaryType())]
    )
    spaced = F.when(F.octet_length("text") > 0, F.concat(F.lit(" "), F.col("text"))).alias("text")
    return docs.select("doc_id", spaced).mapInArrow(of, schema)


def pair_counts(links: DataFrame, n_pairs: int) -> DataFrame:
    """``pair, n``: links of each pair in the corpus. A task sends at most one row a pair."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n_pairs, np.int64)
        for batch in batches:
            for links in chain(batch.column(0)):
                found, n = np.unique(np.frombuffer(links.as_buffer(), "<i4"), return_counts=True)
                sums[found] += n
        pair = np.flatnonzero(sums)
        for k in range(0, len(pair), 1 << 16):
            part = pair[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(sums[part])], ["pair", "n"])

    return links.select("links").mapInArrow(of, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def alignment(docs: DataFrame, vocab: str | None = None, model: bytes | None = None) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every text.

    ``n_best``: links whose pair no other A token outnumbers in the corpus for their B token;
    ``count_sum``: corpus counts of the pairs of all links. See ``aligned`` for the rest.

    Pairs are counted once over the whole corpus and go to the tasks as two arrays with a
    number for each possible pair, which the two vocabularies bound.
    """
    vocab, model = vocab or vocabulary(), model or piece_model()
    rows = staged(aligned(docs, vocab, model), "aligned")
    pairs = _aligner(vocab, model).pairs
    _aligner.cache_clear()  # the driver encodes nothing
    counted = pair_counts(rows, len(pairs)).toArrow()
    counts = np.zeros(len(pairs), np.int64)
    counts[counted.column("pair").to_numpy()] = counted.column("n").to_numpy()
    piece = pairs & 0xFFFFFFFF
    highest = np.zeros(int(piece.max()) + 1, np.int64)
    np.maximum.at(highest, piece, counts)
    sent = docs.sparkSession.sparkContext.broadcast((counts, counts == highest[piece]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = sent.value
        for batch in batches:
            own = [np.frombuffer(x.as_buffer(), "<i4") for x in batch.column("links")]
            sums = [pa.array([int(x[links].sum()) for links in own], pa.int64()) for x in (best, count)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("doc_id", "n_a", "n_b", "n_groups")), batch.column("n_groups"), *sums, batch.column("groups_sha256")],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )

    longs = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    schema = T.StructType([docs.schema["doc_id"]] + [T.StructField(n, T.LongType()) for n in longs] + [T.StructField("groups_sha256", T.StringType())])
    return rows.mapInArrow(of, schema)
