"""Words of texts as numbers, for operators that work on chunks of documents.

A task deals the documents it reads to chunks of a bounded number of words and documents. Inside a chunk every distinct word
has a code, so what follows is arithmetic on arrays. A chunk is named by its partition and its place there: read again, a
partition gives the same chunks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa

_UPPER = range(0x41, 0x5B)
#: Bytes outside letters, digits and what is not ASCII.
_NO_TERM = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
#: ``bytes.split`` parts at 0x20 and 0x09 to 0x0D, which is what parts words; these tables lower-case A-Z besides.
BY_SPACE = bytes(c + 32 if c in _UPPER else c for c in range(256))
BY_SIGNS = bytes(c + 32 if c in _UPPER else 0x20 if c in _NO_TERM else c for c in range(256))

_ROWS = 512


class Chunk:
    """Documents of a partition that are handled together."""

    def __init__(self, number: int) -> None:
        self.number = number
        self.codes: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.words: list[np.ndarray] = []
        self.columns: list[pa.Table] = []
        self.n_words = self.n_docs = 0

    def add(self, texts: list[str | None], columns: pa.Table, fold: bytes) -> None:
        code = self.codes.__getitem__
        for text in texts:
            words = text.encode("utf-8", "surrogatepass").translate(fold).split() if text else []
            self.words.append(np.fromiter(map(code, words), dtype=np.int32, count=len(words)))
            self.n_words += len(words)
        self.columns.append(columns)
        self.n_docs += len(texts)

    def table(self) -> pa.Table:
        """The documents' other columns."""
        return pa.concat_tables(self.columns).combine_chunks()

    def lengths(self) -> np.ndarray:
        return np.fromiter(map(len, self.words), dtype=np.int64, count=len(self.words))

    def vocabulary(self) -> pa.Array:
        """The word of each code."""
        return pa.array(self.codes.keys(), pa.binary()).cast(pa.string())


def chunks(batches: Iterator[pa.RecordBatch], text_col: str, fold: bytes, max_words: int, max_docs: int) -> Iterator[Chunk]:
    """Chunks of whole documents; one ends when it has ``max_words`` words or ``max_docs`` documents at least."""
    from pyspark import TaskContext

    first = TaskContext.get().partitionId() << 24
    number, now = 0, Chunk(first)
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        others = rows.drop_columns([text_col])
        for at in range(0, rows.num_rows, _ROWS):
            now.add(rows.column(text_col).slice(at, _ROWS).to_pylist(), others.slice(at, _ROWS), fold)
            if now.n_words >= max_words or now.n_docs >= max_docs:
                yield now
                number += 1
                now = Chunk(first + number)
    if now.n_docs:
        yield now
