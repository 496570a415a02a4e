"""Texts cut into chunks that tokenizers never join, so that each distinct chunk is encoded once."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa

#: Estimated bytes of chunks that a task keeps; what is over is forgotten between slices.
KEPT_BYTES = 128 << 20
#: Bytes of a kept chunk beside its characters and tokens, and bytes of each token.
CHUNK_BYTES, TOKEN_BYTES = 180, 4
#: Characters of chunks that are encoded in one call.
CALL_CHARS = 1 << 18

_BLANK = np.zeros(256, bool)
_BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True


def chunk_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the chunks of texts (their UTF-8 bytes end to end, ``off`` their bounds) start.

    A text is cut before each space or line end that follows a visible character. No token
    reaches over such a place, in byte-level vocabularies with a pattern as in
    ``public_tokenizers.PATTERN`` and in piece vocabularies in which no piece holds a space
    behind another character and none a line end.
    """
    cut = (data == 0x20) | (data == 0x0A)
    cut[:3] = False
    cut[1:] &= ~_BLANK[data[:-1]]
    at = np.flatnonzero(cut)
    at = at[data[at - 1] >= 0x80]
    one, two, three = data[at - 1], data[at - 2], data[at - 3]
    # white space beyond ASCII: U+0085 U+00A0 U+1680 U+2000-200A U+2028 U+2029 U+202F U+205F U+3000
    wide = (two == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (three == 0xE1) & (two == 0x9A) & (one == 0x80)
    general = (one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF)
    wide |= (three == 0xE2) & ((two == 0x80) & general | (two == 0x81) & (one == 0x9F)) | (three == 0xE3) & (two == 0x80) & (one == 0x80)
    cut[at[wide]] = False
    cut[off[:-1][np.diff(off) > 0]] = True
    return np.flatnonzero(cut)


class Chunks:
    """Numbers the distinct chunks met; a subclass keeps what it learns of each.

    The chunks met first are kept until they take half of ``kept_bytes``, later ones until
    all is taken. Chunks are given to ``learn`` in runs that can be encoded as one text: each
    starts with a space or line end and ends with a visible character. Others come alone.
    """

    def __init__(self, kept_bytes: int = KEPT_BYTES):
        self.kept_bytes = kept_bytes
        self.number: dict[str, int] = {}
        self.n_bytes = self.n_first_bytes = 0
        self.later: list[str] = []

    def learn(self, run: list[str]) -> int:
        """Keep what the chunks hold, in order; the number of their tokens."""
        raise NotImplementedError

    def sorted(self, chunks: Iterable[str]) -> Iterable[str]:
        """The chunks in the order they are learnt."""
        return chunks

    def forget(self, n: int) -> None:
        """Forget all but the first ``n`` chunks."""
        raise NotImplementedError

    def numbers(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the texts' chunks and each text's bounds in them; valid until the next call."""
        known = self.number
        if self.n_bytes > self.kept_bytes:
            for chunk in self.later:
                del known[chunk]
            self.forget(len(known))
            self.n_bytes, self.later = self.n_first_bytes, []
        data, off = np.ascontiguousarray(data[off[0] : off[-1]]), off - off[0]
        starts = chunk_starts(data, off)
        bounds = np.searchsorted(starts, off)
        chunks = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, off[-1]).astype(np.int64)), pa.py_buffer(data))
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        run, length = [], 0
        for chunk in self.sorted(c for c in distinct if c not in known):
            if chunk[0] in " \n" and not chunk[-1].isspace() and len(chunk) < CALL_CHARS:
                if length + len(chunk) > CALL_CHARS:
                    self._add(run)
                    run, length = [], 0
                run.append(chunk)
                length += len(chunk)
            else:
                self._add([chunk])
        if run:
            self._add(run)
        numbers = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))
        return numbers[coded.indices.to_numpy()], bounds

    def _add(self, run: list[str]) -> None:
        self.n_bytes += 2 * sum(map(len, run)) + CHUNK_BYTES * len(run) + TOKEN_BYTES * self.learn(run)
        self.number.update(zip(run, range(len(self.number), len(self.number) + len(run))))
        if self.n_bytes <= self.kept_bytes // 2 and not self.later:
            self.n_first_bytes = self.n_bytes
        else:
            self.later += run


class Column:
    """Arrays of different lengths, kept end to end, that grow by runs."""

    def __init__(self, kind: type):
        self.flat, self.bounds, self.n = np.zeros(1 << 16, kind), np.zeros(1 << 12, np.int64), 0

    def add(self, values: np.ndarray, ends: np.ndarray) -> None:
        """Rows of ``values`` that end where ``ends`` says."""
        at = self.bounds[self.n]
        self.flat = _grown(self.flat, at + len(values))
        self.bounds = _grown(self.bounds, self.n + len(ends) + 1)
        self.flat[at : at + len(values)] = values
        self.bounds[self.n + 1 : self.n + len(ends) + 1] = at + ends
        self.n += len(ends)

    def cut(self, n: int) -> None:
        """Drop all rows but the first ``n``."""
        self.flat, self.bounds, self.n = self.flat[: self.bounds[n]].copy(), self.bounds[: n + 1].copy(), n

    def gathered(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows' values, one row after the other, and where each row starts, and the end."""
        start = self.bounds[rows]
        size = self.bounds[rows + 1] - start
        ends = np.concatenate(([0], np.cumsum(size)))
        return self.flat[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])], ends


def _grown(x: np.ndarray, size: int) -> np.ndarray:
    return x if size <= len(x) else np.concatenate((x, np.zeros(max(size - len(x), len(x)), x.dtype)))
