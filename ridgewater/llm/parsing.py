"""Repeated byte strings by prefix-free parsing.

Runs around repeated anchors (see ``repeats``) are parsed in blocks of whole groups. A rolling hash of 16 bytes triggers
the end of a phrase; a phrase includes the trigger that ends it, so no suffix of a phrase (longer than a trigger) is the
beginning of another. The suffixes of the distinct phrases, the dictionary, are ranked by doubling, as are the suffixes
of the sequence of phrases, the parse. A suffix of the corpus is then placed by the rank of the rest of its phrase and,
where that is equal, by the rank of the parse that follows: repetitive text is sorted once per phrase and not once
per copy. Neighbours in that order share the longest common prefix; where it reaches ``length`` bytes (compared byte by
byte) and they are different places, the string also starts elsewhere and its bytes are removed.

A null text is empty; texts shorter than ``length`` lose nothing; matches never cross documents. No rows in, no rows out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ridgewater.llm.repeats import Symbols, by_id, covered, mask, shown_id, with_ranges
from ridgewater.llm.words import byte_windows, buffers

LENGTH = 200
KMER = 32
TRIGGER = 16
EVERY = 64
BLOCK = 1 << 20


def _doubled(symbols: np.ndarray, rest: np.ndarray, longest: int) -> np.ndarray:
    """Ranks of the first ``longest`` symbols (from 1 on) from every place; ``rest`` is how many belong to it.

    The first sort takes as many symbols as fit a word. Doubling then goes on only for places that still share their
    rank with another one and have symbols left.
    """
    n = len(symbols)
    bits = max(1, int(symbols.max(initial=0)).bit_length())
    have = 63 // bits
    key = np.zeros(n, np.int64)
    for i in range(have):
        key <<= bits
        inside = np.flatnonzero(rest > i)
        key[inside] |= symbols[inside + i]
    ranks = np.zeros(n, np.int64)
    active = np.arange(n)
    while True:
        order = np.argsort(key, kind="stable")
        sorted_key, active = key[order], active[order]
        head = np.ones(len(active), bool)
        head[1:] = sorted_key[1:] != sorted_key[:-1]
        own = np.flatnonzero(head)
        first = np.repeat(own, np.diff(np.append(own, len(active))))
        # A rank is one more than the number of places before it; within an old rank it moves up by those before it there.
        old = ranks[active]
        group = np.ones(len(active), bool)
        group[1:] = old[1:] != old[:-1]
        begun = np.maximum.accumulate(np.where(group, np.arange(len(active)), 0))
        ranks[active] = np.maximum(old, 1) + first - begun
        single = head & np.append(head[1:], True)
        active = active[~single]
        active = active[rest[active] > have]
        if have >= longest or not len(active):
            return ranks
        key = ranks[active] * (n + 2) + ranks[active + have]
        have *= 2


def corpus_order(data: np.ndarray, bounds: np.ndarray, length: int) -> np.ndarray:
    """Places of ``data`` from which ``length`` bytes lie in one segment, in the order of those bytes."""
    n = len(data)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    starts = np.repeat(bounds[:-1], np.diff(bounds))
    place = np.arange(n)
    trigger = np.zeros(n, bool)
    hashes = byte_windows(data, TRIGGER)
    trigger[: len(hashes)] = hashes % np.uint64(EVERY) == 0
    trigger &= place + TRIGGER <= ends
    trigger |= place == starts
    first = np.flatnonzero(trigger)
    phrase_of = np.cumsum(trigger) - 1
    follows = np.append(first[1:], n)
    inner = follows < ends[first]
    stop = np.where(inner, np.minimum(follows + TRIGGER, ends[first]), ends[first])
    # The dictionary: one copy of each phrase.
    size = stop - first
    total = np.zeros(n + 1, np.uint64)
    weights = np.random.default_rng(11).integers(0, 2**64, 257, dtype=np.uint64)
    grown = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, 0x9E3779B97F4A7C15, np.uint64)]))
    back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, pow(0x9E3779B97F4A7C15, -1, 2**64), np.uint64)]))
    np.cumsum(weights[data] * grown[:n], out=total[1:])
    names = (total[stop] - total[first]) * back[first] + size.astype(np.uint64) * weights[256]
    _, chosen, phrase = np.unique(names, return_index=True, return_inverse=True)
    lengths = size[chosen]
    begins = np.concatenate([[0], np.cumsum(lengths)])
    at = np.repeat(first[chosen] - begins[:-1], lengths) + np.arange(begins[-1])
    rest = np.repeat(begins[1:], lengths) - np.arange(begins[-1])
    suffix = _doubled(data[at].astype(np.int64) + 1, rest, length)
    # The parse: phrases by their rank, each segment on its own.
    ranked = suffix[begins[:-1]][phrase]
    segment = np.searchsorted(bounds, first, side="right") - 1
    last = np.searchsorted(segment, segment, side="right")
    parse = _doubled(ranked, last - np.arange(len(first)), length)
    after = np.append(parse, 0)[np.arange(1, len(first) + 1)] * inner
    valid = np.flatnonzero(place + length <= ends)
    own = phrase_of[valid]
    key = suffix[begins[phrase[own]] + valid - first[own]] * (int(parse.max()) + 1) + after[own]
    return valid[np.argsort(key, kind="stable")]


def repeated_places(data: np.ndarray, bounds: np.ndarray, names: np.ndarray, length: int) -> np.ndarray:
    """Places whose ``length`` bytes also start at a place of another name; sorted."""
    order = corpus_order(data, bounds, length)
    if len(order) < 2:
        return order[:0]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (len(data), 8), (1, 1)).copy().view(np.uint64)[:, 0]
    alike = np.arange(len(order) - 1)
    steps = [*range(0, length - 7, 8)] + ([length - 8] if length % 8 else [])
    for step in steps:
        same = eight[order[alike] + step] == eight[order[alike + 1] + step]
        alike = alike[same]
    joined = np.zeros(len(order), bool)
    joined[alike + 1] = True
    heads = np.flatnonzero(~joined)
    own = names[order]
    several = np.minimum.reduceat(own, heads) != np.maximum.reduceat(own, heads)
    return np.sort(order[np.repeat(several, np.diff(np.append(heads, len(order))))])


def _judge(length: int):
    def block(rows: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
        sizes = np.array([len(r[3]) for r in rows], np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        docs, parts, begins = [np.array([r[i] for r in rows], np.int64) for i in range(3)]
        numbers: dict[tuple[int, int], int] = {}
        number = np.array([numbers.setdefault((r[0], r[1]), len(numbers)) for r in rows], np.int64)
        at = np.arange(len(data)) - np.repeat(bounds[:-1], sizes) + np.repeat(begins, sizes)
        found = repeated_places(data, bounds, (np.repeat(number, sizes) << 40) + at, length)
        row = np.searchsorted(bounds, found, side="right") - 1
        new = np.ones(len(found), bool)
        new[1:] = (row[1:] != row[:-1]) | (found[1:] > found[:-1] + length)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(found)) - 1 if len(heads) else heads
        columns = [docs[row[heads]], parts[row[heads]], at[found[heads]], at[found[tails]] + length]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "part", "start", "stop"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size, group = 0, None
        for batch in batches:
            for kind, key, doc, part, start, run in zip(*[c.to_pylist() for c in batch.columns]):
                if (kind, key) != group and size >= BLOCK:
                    yield from block(held)
                    held, size = [], 0
                group = (kind, key)
                held.append((doc, part, start, run))
                size += len(run)
        if held:
            yield from block(held)

    return lambda runs: runs.mapInArrow(parse, "doc long, part long, start long, stop long")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_bytes: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes on request) of every row."""
    docs = by_id(docs, id_col, text_col)
    ranges = covered(docs, Symbols("byte", length, min(KMER, length)), _judge(length), keep_first=False)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                few = batch.slice(at, 200)
                data, offsets = buffers(few.column(1))
                rows = []
                for own, a, b in zip(few.column(2), offsets[:-1].tolist(), offsets[1:].tolist()):
                    gone = mask(own, b - a)
                    kept = data[a:b][~gone].tobytes()
                    rows.append((b - a, int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
                kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
                columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds[: len(names) - 1])]
                yield pa.RecordBatch.from_arrays([few.column(0), *columns], names)

    names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_bytes
    schema = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    out = with_ranges(docs, ranges).mapInArrow(finish, schema)
    return out.select(shown_id().alias("id"), *names[1:])
