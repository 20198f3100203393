"""Packing of token documents into windows by minimum bin slack.

Every document is encoded and closed with an end id, then cut: full windows come out at once, the
remainders of a batch wait in a pool keyed by length. A window is filled around the longest
remainder: subset sums of the pool's lengths, as the bits of one integer, tell which totals can be
met; the best total is backtracked into a count of remainders for each length. A window
that misses capacity is closed by cutting one more remainder. What is left at the end of a task
goes to windows whose sizes are powers of two, which need no padding.

Each task packs the rows it has read, pool by pool: no shuffle, memory bounded by the pool.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm.bpe import WordBpe, load, text_or_empty
from presswork.llm.common import map_texts

WINDOW, END_ID = 4096, 2
#: A pool is packed when it holds so many tokens or documents.
POOL_TOKENS, POOL_DOCS = 2_000_000, 4_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths (how many of each) whose sum comes closest to ``room`` from below.

    Bit s of ``reach`` says that sum s can be met. A length with c copies is added as 1, 2, 4, ...
    copies at a time; each addition keeps the bits from before it, for the way back."""
    reach, full, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        left, times = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            times = min(times, left)
            steps.append((length, times, reach))
            reach |= reach << length * times & full
            left -= times
            times *= 2
        if reach >> room & 1:
            break
    total, taken = reach.bit_length() - 1, defaultdict(int)
    for length, times, before in reversed(steps):
        if not before >> total & 1:
            total -= length * times
            taken[length] += times
    return dict(taken)


class Packer:
    """Gives each token span ``(document, start, length)`` a sequence and an offset in it."""

    def __init__(self, window: int, first: int):
        self.window, self.next_id, self.pool = window, first, defaultdict(list)
        self.placed: list[tuple[int, int, int, int, int]] = []  # document, start, length, sequence, offset

    def add(self, doc: int, n: int) -> None:
        whole = n // self.window * self.window
        for at in range(0, whole, self.window):
            self.placed.append((doc, at, self.window, self.next_id, 0))
            self.next_id += 1
        if n > whole:
            self.pool[n - whole].append((doc, whole))

    def _take(self, length: int) -> tuple[int, int]:
        spans = self.pool[length]
        span = spans.pop()
        if not spans:
            del self.pool[length]
        return span

    def pack(self) -> None:
        """Places everything that waits. All windows but the last of the pool end up full."""
        while self.pool and sum(k * len(v) for k, v in self._some()) >= self.window:
            longest = max(self.pool)
            chosen = [(longest, *self._take(longest))]
            room = self.window - longest
            for length, times in best_fill({k: len(v) for k, v in self.pool.items()}, room).items():
                for _ in range(times):
                    chosen.append((length, *self._take(length)))
                    room -= length
            if room:  # every length that waits is longer than the gap, or the sums miss it: cut one
                length = min((k for k in self.pool if k > room), default=max(self.pool))
                doc, start = self._take(length)
                chosen.append((room, doc, start))
                self.pool[length - room].append((doc, start + room))
            self._place(chosen)
        rest = sorted(((k, d, s) for k, v in self.pool.items() for d, s in v), reverse=True)
        self.pool.clear()
        total = sum(k for k, _, _ in rest)
        size = self.window
        while rest:
            while size > total:
                size //= 2
            chosen, room = [], size
            while room:
                length, doc, start = rest.pop()
                used = min(length, room)
                chosen.append((used, doc, start))
                if used < length:
                    rest.append((length - used, doc, start + used))
                room -= used
            total -= size
            self._place(chosen)

    def _some(self):
        """Enough of the pool to see whether a window can be filled."""
        seen = 0
        for k, v in self.pool.items():
            yield k, v
            seen += k * len(v)
            if seen >= self.window:
                return

    def _place(self, chosen: list[tuple[int, int, int]]) -> None:
        at = 0
        for length, doc, start in chosen:
            self.placed.append((doc, start, length, self.next_id, at))
            at += length
        self.next_id += 1


def _whole(bpe: WordBpe, texts: list[str]) -> Iterator[bytes]:
    """The ids of each text, one text at a time."""
    at, parts = 0, []
    for k, raw in bpe.encoded(texts):
        while at < k:
            yield b"".join(parts)
            at, parts = at + 1, []
        parts.append(raw)
    while at < len(texts):
        yield b"".join(parts)
        at, parts = at + 1, []


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Null text is empty and gives the end id alone; null keys pass through; repeated rows are
    packed as often as they come; an empty table gives no rows. ``window`` is a power of two. Sequence ids are unique:
    the task's number in the high bits. A retried task reads the same rows and so gives the same
    pieces, provided that the input is a table or file (not a shuffle with rows in free order)."""
    if window < 1 or window & window - 1:
        raise ValueError("window must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        end = np.array([end_id], "<u4").tobytes()
        packer = Packer(window, TaskContext.get().partitionId() << 36)
        keys: list[int | None] = []
        ids: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            packer.pack()
            doc, start, length, seq, at = (np.array(c, np.int64) for c in zip(*packer.placed, strict=True))
            crc = [zlib.crc32(ids[d][4 * s : 4 * (s + n)]) for d, s, n, _, _ in packer.placed]
            out = pa.RecordBatch.from_arrays([pa.array([keys[d] for d in doc], pa.int64()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.array([len(ids[d]) // 4 for d in doc], np.int64)), pa.array(seq), pa.array(at)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            packer.placed.clear()
            keys.clear()
            ids.clear()
            held = 0
            return out

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), text_or_empty(batch)
            for name, raw in zip(names, _whole(bpe, texts), strict=True):
                raw += end
                packer.add(len(keys), len(raw) // 4)
                keys.append(name)
                ids.append(raw)
                held += len(raw) // 4
                if held >= POOL_TOKENS or len(keys) >= POOL_DOCS:
                    yield flush()
        if keys:
            yield flush()

    some = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_texts(some, run, SCHEMA, "bpe")
