"""Packing documents into token sequences by minimum bin slack.

Each document becomes its token ids and an end id. Full windows are cut off first; what remains of each
document (fewer ids than a window) goes to a pool. A window is opened with the longest remainder, and a
subset-sum over bitsets picks the multiset of the other remainders' lengths that brings it closest to its
capacity; the counts come from tracing the bitsets back. Slack that no multiset closes is closed by a
piece cut from another remainder. What is left when a partition ends is less than a window; it is cut
into powers of two, which need no padding.

Each task packs the documents of its own partition in one pass with a pool of bounded size: there is no
shuffle, no group, and a lost task is simply run again.

Defined results: a null or empty text is the end id alone. Documents with one id, a null one among them, are packed as separate
documents. Of remainders of equal length the one that came last is taken first. A text of any length is cut over as many
windows as it needs. Empty input gives an empty result. Columns beyond id and text are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frees
from .tokens import token_ids

CAPACITY = 1024
#: Remainders that a task holds, at most: 4,096 windows' worth of ids are 16 MB.
POOL = 4096
END_ID = 0
#: Bytes of ids in one Arrow batch handed back to Spark.
FLUSH_BYTES = 8_000_000

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
    + [(n, pa.int64()) for n in ("doc_tokens", "sequence_id", "offset")]
)


def closest_multiset(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length to take so that their sum comes closest to `capacity` from below.

    Bit s of a bitset says that the sum s can be reached. Each length's copies are added in groups of
    1, 2, 4, ... and the bitset before each group is kept, so that the way back gives the counts.
    """
    full = (1 << (capacity + 1)) - 1
    reached, steps = 1, []
    for length in sorted((x for x, n in counts.items() if n and 0 < x <= capacity), reverse=True):
        left, group = min(counts[length], capacity // length), 1
        while left:
            take = min(group, left)
            before = reached
            reached |= (reached << (take * length)) & full
            if reached != before:
                steps.append((before, length, take))
            left -= take
            group *= 2
        if reached >> capacity & 1:
            break
    rest, chosen = reached.bit_length() - 1, defaultdict(int)
    for before, length, take in reversed(steps):
        if not before >> rest & 1:
            rest -= take * length
            chosen[length] += take
    return dict(chosen)


class _Packer:
    """The pool of one task and the sequences it makes."""

    def __init__(self, capacity: int, pool: int, first_sequence: int):
        self.capacity, self.most, self.sequence = capacity, pool, first_sequence
        self.pool: dict[int, list[tuple]] = defaultdict(list)  # by length: (doc_id, start, doc_tokens, ids)
        self.held = self.tokens = 0
        self.rows: list[tuple] = []
        self.bytes = 0

    def put(self, doc_id: int | None, start: int, total: int, ids: np.ndarray) -> None:
        self.pool[len(ids)].append((doc_id, start, total, ids))
        self.held += 1
        self.tokens += len(ids)

    def take(self, length: int) -> tuple:
        piece = self.pool[length].pop()
        if not self.pool[length]:
            del self.pool[length]
        self.held -= 1
        self.tokens -= length
        return piece

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, total, ids in pieces:
            self.rows.append((doc_id, start, len(ids), ids.tobytes(), total, self.sequence, offset))
            offset += len(ids)
        self.bytes += 4 * offset
        self.sequence += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        cut = len(ids) - len(ids) % self.capacity
        for start in range(0, cut, self.capacity):
            self.emit([(doc_id, start, len(ids), ids[start : start + self.capacity])])
        if cut < len(ids):
            self.put(doc_id, cut, len(ids), ids[cut:].copy())

    def window(self) -> None:
        """Fill one window from a pool that holds at least a window of ids."""
        longest = max(self.pool)
        pieces = [self.take(longest)]
        rest = self.capacity - longest
        for length, n in closest_multiset({k: len(v) for k, v in self.pool.items()}, rest).items():
            for _ in range(n):
                pieces.append(self.take(length))
                rest -= length
        if rest:
            longer = min((k for k in self.pool if k > rest), default=None)
            if longer is not None:
                doc_id, start, total, ids = self.take(longer)
                pieces.append((doc_id, start, total, ids[:rest]))
                self.put(doc_id, start + rest, total, ids[rest:])
        self.emit(pieces)

    def shrink(self, most: int) -> None:
        while self.held > most and self.tokens >= self.capacity:
            self.window()

    def finish(self) -> None:
        while self.tokens >= self.capacity:
            self.window()
        left = self.tokens
        pieces = [self.take(length) for length in sorted(self.pool, reverse=True) for _ in list(self.pool[length])]
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            own = []
            while size:
                doc_id, start, total, ids = pieces.pop(0)
                own.append((doc_id, start, total, ids[:size]))
                if len(ids) > size:
                    pieces.insert(0, (doc_id, start + size, total, ids[size:]))
                size -= min(size, len(ids))
            self.emit(own)

    def batch(self) -> pa.RecordBatch:
        rows, self.rows, self.bytes = self.rows, [], 0
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW
        )


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    pool: int = POOL,
    end_id: int = END_ID,
    ranks_path: str | None = None,
) -> DataFrame:
    """A row for each piece of a document in a sequence: where it lies, and its ids (little-endian uint32).

    Sequence ids tell tasks apart by their upper bits. `docs` may have any other columns.
    """

    @frees
    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(capacity, pool, TaskContext.get().partitionId() << 36)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(token_ids(text.as_py(), ranks_path), np.uint32(end_id)).astype("<u4")
                packer.add(doc_id, ids)
                if packer.held >= pool:
                    packer.shrink(pool // 2)
                if packer.bytes >= FLUSH_BYTES:
                    yield packer.batch()
        packer.finish()
        yield packer.batch()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(tasks, SCHEMA)
