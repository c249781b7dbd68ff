"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

Every document is tokenized and closed with an end id. Whole windows are cut off first and stand alone; what is left
is pooled and balanced over windows of the pool: differencing starts with one partial partition per piece and keeps
merging the two with the largest imbalance, the largest window of one with the smallest of the other, until one
partition is left. If a window exceeds the capacity, the pool is balanced again over one window more. A pool closes
when it nearly fills ``pool`` windows (the document that reaches that point is cut there), so its cost is bounded, and
a ``share`` of its tokens is cut into crumbs of ``crumb`` tokens, with which differencing can even out the windows.
Each task packs its own documents and no row is shuffled.

A null text is empty and gives the end id alone. Repeated rows and ids are packed as they come. No rows in, no rows
out. Tokens are those of the given byte-level BPE file. Its vocabulary and ranks are read from that file and run by the
faster of two libraries, which gives the same ids; a text that may hold a special token is left to the other one.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024
POOL = 64
CRUMB = 16
SHARE = 0.06
SLACK = 4
END_ID = 0

SCHEMA = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


# Fixed value: how this vocabulary's pre-tokenizer splits text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Token ids of a text as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        special = set(self.tokenizer.get_added_tokens_decoder())
        byte = _byte_letters()
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if i not in special}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if "<|" in text:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def differencing(sizes: list[int], windows: int) -> tuple[np.ndarray, list[list[int]]]:
    """Karmarkar-Karp: (total of each window, the items in it), totals ascending."""
    heap, parts = [], {}
    for i, size in enumerate(sizes):
        totals = np.zeros(windows, np.int64)
        totals[-1] = size
        parts[i] = (totals, [[] for _ in range(windows - 1)] + [[i]])
        heap.append((-size, i))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        (high, own), (low, other) = parts.pop(a), parts[b]
        totals = high + low[::-1]
        order = np.argsort(totals, kind="stable")
        merged = [own[i] + other[windows - 1 - i] for i in order.tolist()]
        totals = totals[order]
        parts[b] = (totals, merged)
        heapq.heappush(heap, (int(totals[0] - totals[-1]), b))
    return parts[heap[0][1]]


def balanced(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items of each window; one window more as long as any exceeds the capacity."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        totals, items = differencing(sizes, windows)
        if totals[-1] <= capacity:
            return [w for w in items if w]
        windows += 1


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    pool: int = POOL,
    crumb: int = CRUMB,
    share: float = SHARE,
    slack: int = SLACK,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids on request."""
    kind = dict(docs.dtypes)[id_col]
    schema = SCHEMA.format(id=kind) + (", ids array<int>" if with_ids else "")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        sequence = TaskContext.get().partitionId() << 33
        waiting: list[tuple] = []
        full = pool * max(1, capacity - slack)
        held, crumbs, rows = 0, 0, []

        def place(doc, start: int, ids: bytes, total: int, offset: int) -> None:
            row = (doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset)
            rows.append((*row, np.frombuffer(ids, "<u4").astype(np.int32)) if with_ids else row)

        def close() -> None:
            nonlocal sequence, held, crumbs
            for window in balanced([len(w[2]) // 4 for w in waiting], capacity):
                offset = 0
                for i in window:
                    doc, start, ids, total = waiting[i]
                    place(doc, start, ids, total, offset)
                    offset += len(ids) // 4
                sequence += 1
            waiting.clear()
            held = crumbs = 0

        def wait(doc, start: int, ids: bytes, total: int) -> None:
            """Put a piece into the pool, as crumbs if those are short; the pool closes where it is full."""
            nonlocal held, crumbs
            while ids:
                part, ids = ids[: 4 * (full - held)], ids[4 * (full - held) :]
                n = len(part) // 4
                step = n if crumbs >= share * held else crumb
                for at in range(0, n, step):
                    waiting.append((doc, start + at, part[4 * at : 4 * (at + step)], total))
                held, crumbs, start = held + n, crumbs + (step < n) * n, start + n
                if held == full:
                    close()

        def flush() -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
        types: list = []
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            types = [batch.schema.field(0).type] + [pa.int64()] * 6 + [pa.list_(pa.int32())] * with_ids
            for at in range(0, len(batch), 200):
                few = batch.slice(at, 200)
                texts = [t or "" for t in few.column(1).to_pylist()]
                for doc, body in zip(few.column(0).to_pylist(), map(encoder.encode, texts)):
                    ids = body + end
                    total = len(ids) // 4
                    whole = total // capacity * capacity
                    for start in range(0, whole, capacity):
                        place(doc, start, ids[4 * start : 4 * (start + capacity)], total, 0)
                        sequence += 1
                    wait(doc, whole, ids[4 * whole :], total)
                if len(rows) >= 10_000:
                    yield flush()
        if waiting:
            close()
        if rows:
            yield flush()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(packed, schema)
