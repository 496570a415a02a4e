"""Byte-level BPE over Arrow batches, with offsets, and the way back."""

from __future__ import annotations

import codecs
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.stage import field, in_struct, lean, staged, with_fields
from cohortlens.llm.words import byte_rows, slices

#: Text bytes encoded, or token ids decoded, at once.
ENCODE_BYTES = 1 << 21
DECODE_IDS = 1 << 18
#: Estimated bytes of the words, and of the pieces of words, whose ids a task keeps, and the
#: longest of them; longer ones are encoded each time.
KEPT_BYTES, KEPT_CHARS = 24 << 20, 64
VISIBLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def vocabulary(path: str | None = None) -> str:
    """The text of a ``tokenizers`` file; by default the public 50k byte-level one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable Latin-1 stands for itself; the other bytes, in order, for U+0100 and on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Apart(Exception):
    """A part of a text that can't be encoded without what stands around it."""


class _Parts(dict):
    """Ids, as bytes, of short texts met before; the later half of ``KEPT_BYTES`` goes when all is taken."""

    def __init__(self, encode):
        self.encode = encode
        self.n_bytes = 0

    def __missing__(self, part: str) -> bytes:
        ids = self.encode(part)
        if len(part) > KEPT_CHARS:
            return ids
        self[part] = ids
        self.n_bytes += self._size(part, ids)
        if self.n_bytes > KEPT_BYTES:
            while self.n_bytes > KEPT_BYTES // 2:
                self.n_bytes -= self._size(*self.popitem())
        return ids

    def clear(self) -> None:
        super().clear()
        self.n_bytes = 0

    @staticmethod
    def _size(part: str, ids: bytes) -> int:
        """Of both objects and their place in the dictionary."""
        return 150 + 2 * len(part) + len(ids)


class TokenBytes:
    """The bytes of a tokenizer file's tokens: arrays of 1 MB, without the model that encodes."""

    def __init__(self, vocab: str):
        spec = json.loads(vocab)
        special = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        back = byte_of_character()
        tokens = {i: bytes(back[c] for c in t) for t, i in spec["model"]["vocab"].items() if i not in special} | special
        parts = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.places = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        self.flat = np.frombuffer(b"".join(parts), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        """Numbers outside the vocabulary stand for no byte."""
        out = []
        for at in range(0, len(ids), DECODE_IDS):
            part = ids[at : at + DECODE_IDS].astype(np.int64)
            part = part[part < len(self.sizes)]
            size = self.sizes[part]
            shift = self.places[part] - (np.cumsum(size) - size)
            out.append(self.flat[np.repeat(shift, size) + np.arange(size.sum())].tobytes())
        return b"".join(out)


class ByteBPE(TokenBytes):
    """A tokenizer file's model over the pieces of its pattern, and the bytes of its tokens."""

    def __init__(self, vocab: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        super().__init__(vocab)
        self.model = Tokenizer.from_str(vocab).model
        self.pattern = regex.compile(pattern)
        self.characters = {b: c for c, b in byte_of_character().items()}
        self.pieces_seen = _Parts(self._piece)
        self.words_seen = _Parts(self._word)

    def _piece(self, piece: str) -> bytes:
        mapped = piece.encode().decode("latin-1").translate(self.characters)
        return np.array([t.id for t in self.model.tokenize(mapped)], np.uint32).tobytes()

    def _run(self, text: str) -> bytes:
        return b"".join(map(self.pieces_seen.__getitem__, self.pattern.findall(text)))

    def _word(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Apart
        return self._run(" " + word)

    def ids(self, text: str) -> np.ndarray:
        """No match of the pattern reaches over a space between two visible characters.

        So the words between such spaces, each with the space before it, are encoded one by
        one and kept; a text with other white space round its spaces is cut only there.
        """
        first, *words = text.split(" ")
        try:
            if words and (not first or first[-1].isspace()):
                raise _Apart
            raw = self._run(first) + b"".join(map(self.words_seen.__getitem__, words))
        except _Apart:
            first, *words = VISIBLE_SPACE.split(text)
            raw = self._run(first) + b"".join(self.words_seen[w] if not w[-1].isspace() else self._run(" " + w) for w in words)
        return np.frombuffer(raw, np.uint32)

    def offsets(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points from and to which each token reaches.

        A token that holds a part of a character reaches over the whole of it.
        """
        ends = np.cumsum(self.sizes[ids])
        lead = np.concatenate((np.frombuffer(text, np.uint8) & 0xC0 != 0x80, [True]))
        character = np.cumsum(lead) - 1
        return character[ends - self.sizes[ids]], np.where(lead[ends], character[ends], character[ends] + 1)

    def pieces(self, ids: list[int]) -> list[str]:
        """The text that each token completes: a split character goes to its last token."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        out = [decoder.decode(self.bytes_of(np.array([i]))) for i in ids]
        if out:
            out[-1] += decoder.decode(b"", True)
        return out


@lru_cache(maxsize=2)
def _model(vocab: str, pattern: str) -> ByteBPE:
    return ByteBPE(vocab, pattern)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encoded(df: DataFrame, vocab: str, pattern: str, text: str = "text", ids: str = "ids", offsets: bool = False) -> DataFrame:
    """``df`` with ``ids``: the token numbers as little-endian unsigned 32-bit integers.

    With ``offsets`` also ``starts`` and ``ends``, the code points that each token covers.
    Null text counts as empty; a special token's name in a text is ordinary text. Columns
    of the new names are replaced. Whole texts are encoded; a task holds one slice of about
    2 MB of text, or one text, at a time.
    """
    names = [ids, *["starts", "ends"] * offsets]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(vocab, pattern)
        for batch in batches:
            data, off = byte_rows(field(batch, text))
            for a, b in slices(off, ENCODE_BYTES):
                raw = [data[off[k] : off[k + 1]].tobytes() for k in range(a, b)]
                found = [model.ids(x.decode()) for x in raw]
                columns = [batch.column("row").slice(a, b - a), pa.array([x.tobytes() for x in found], pa.binary())]
                if offsets:
                    both = [model.offsets(x, i) for x, i in zip(raw, found)]
                    columns += [pa.array([x[k] for x in both], pa.list_(pa.int32())) for k in (0, 1)]
                yield pa.record_batch(columns, ["row", "ids", *names[1:]])
        model.words_seen.clear()
        model.pieces_seen.clear()

    kept = [c for c in df.columns if c not in names]
    carried = in_struct(df, kept, **({} if text in kept else {text: df[text]}))
    kinds = {"ids": T.BinaryType()} | {n: T.ArrayType(T.IntegerType()) for n in names[1:]}
    return carried.mapInArrow(lean(of), with_fields(carried, "row", **kinds)).select("row.*", F.col("ids").alias(ids), *names[1:])


def decoded(df: DataFrame, vocab: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with the bytes (column ``into``) that the token numbers stand for.

    Null stays null. The bytes of a text's tokens are joined before they are read as
    characters, so a character split between tokens comes back whole. A task holds the
    tokens' bytes, not the model that encodes, so ``pattern`` isn't read.
    """
    kept = [c for c in df.columns if c != into]
    tokens = TokenBytes(vocab)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = field(batch, ids)
            sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in column], np.int64)
            for a, b in slices(np.concatenate(([0], np.cumsum(sizes))), 4 * DECODE_IDS):
                back = [
                    tokens.bytes_of(np.frombuffer(x.as_buffer(), np.uint32)) if x.is_valid else None
                    for x in column.slice(a, b - a)
                ]
                yield pa.record_batch([batch.column("row").slice(a, b - a), pa.array(back, pa.binary())], ["row", "bytes"])

    carried = in_struct(df, kept, **({} if ids in kept else {ids: df[ids]}))
    return carried.mapInArrow(lean(of), with_fields(carried, "row", bytes=T.BinaryType())).select("row.*", F.col("bytes").alias(into))


def round_trip(docs: DataFrame, vocab: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each document.

    The ids are staged, so that no task runs the Python that encodes beside the one that decodes.
    """
    ids = staged(encoded(docs.select("doc_id", "text"), vocab, pattern).select("doc_id", "ids"), "ids")
    both = decoded(ids, vocab, pattern)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
