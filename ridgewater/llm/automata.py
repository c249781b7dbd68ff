"""Repeated word passages by suffix automata of reference shards.

A shard is one group of ``repeats``: the reference text is what no earlier document of the shard has. Documents stream
through the shard's automaton in order of their ids; the matching statistics tell, at every word, the longest ending
here that the reference holds. Where it reaches ``length`` words the passage also starts earlier, and its words are
removed; all other words are added to the automaton, with the words before them as context, before the next word is
read, so that a document also matches its own earlier text. Sending every automaton to every task would take work with
the square of the corpus; here it is sent to, and built by, the tasks whose documents share an anchor with it.

Words are maximal runs of non-space characters, unchanged; null text has none. A document of fewer than ``length``
words loses nothing. No rows in, no rows out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ridgewater.llm.repeats import Symbols, by_id, covered, mask, shown_id, with_ranges
from ridgewater.llm.words import words_of

LENGTH = 20
KMER = 5


class Automaton:
    """Suffix automaton of several texts, extended word by word."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.size = [0]

    def _copy(self, p: int, q: int, word) -> int:
        """Split off the part of state q that follows p directly."""
        made = len(self.size)
        self.next.append(self.next[q].copy())
        self.link.append(self.link[q])
        self.size.append(self.size[p] + 1)
        self.link[q] = made
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = made
            p = self.link[p]
        return made

    def extend(self, last: int, word) -> int:
        """The state of the text of ``last`` followed by ``word``."""
        q = self.next[last].get(word)
        if q is not None:
            return q if self.size[q] == self.size[last] + 1 else self._copy(last, q, word)
        made = len(self.size)
        self.next.append({})
        self.link.append(0)
        self.size.append(self.size[last] + 1)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = made
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[made] = q if self.size[q] == self.size[p] + 1 else self._copy(p, q, word)
        return made

    def stream(self, words: list, length: int) -> Iterator[tuple[int, int]]:
        """Ranges of words covered by passages the automaton holds; the rest is added to it."""
        after, link, size = self.next, self.link, self.size
        state = matched = last = 0
        attached = False
        start = stop = -1
        for i, word in enumerate(words):
            while matched and matched <= size[link[state]]:
                state = link[state]
            to = after[state].get(word)
            while to is None and state:
                state = link[state]
                matched = size[state]
                to = after[state].get(word)
            if to is not None:
                state = to
                matched += 1
            if matched >= length:
                attached = False
                if i - length + 1 > stop:
                    if stop > start:
                        yield start, stop
                    start = i - length + 1
                stop = i + 1
            else:
                if not attached:
                    last = 0
                    for word_before in words[max(0, i - length + 1) : i]:
                        last = self.extend(last, word_before)
                    attached = True
                last = self.extend(last, word)
        if stop > start:
            yield start, stop


def _judge(length: int):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, shard_key, place = Automaton(), None, None
        for batch in batches:
            docs, parts, starts, stops = [], [], [], []
            for kind, key, doc, part, begin, run in zip(*[c.to_pylist() for c in batch.columns]):
                if (kind, key) != shard_key:
                    shard, shard_key, place = Automaton(), (kind, key), None
                if (doc, part, begin) == place:
                    continue
                place = (doc, part, begin)
                for start, stop in shard.stream(run.split(b" "), length):
                    docs.append(doc)
                    parts.append(part)
                    starts.append(begin + start)
                    stops.append(begin + stop)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (docs, parts, starts, stops)], ["doc", "part", "start", "stop"])

    return lambda runs: runs.mapInArrow(stream, "doc long, part long, start long, stop long")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 (and the kept text on request) of every row."""
    docs = by_id(docs, id_col, text_col)
    ranges = covered(docs, Symbols("word", length, min(KMER, length)), _judge(length), keep_first=True)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                few = batch.slice(at, 200)
                counts, removed, kept = [], [], []
                owns = iter(few.column(2))
                for part in words_of(few.column(1)):
                    data = part.data.tobytes()
                    for a, b in zip(part.first[:-1].tolist(), part.first[1:].tolist()):
                        gone = mask(next(owns), b - a)
                        stay = ~gone
                        spans = zip(part.starts[a:b][stay].tolist(), part.ends[a:b][stay].tolist())
                        kept.append(b" ".join([data[s:e] for s, e in spans]))
                        counts.append(b - a)
                        removed.append(int(gone.sum()))
                columns = [few.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())]
                columns.append(pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string()))
                if with_text:
                    columns.append(pa.array([t.decode() for t in kept], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text
    schema = "doc long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    out = with_ranges(docs, ranges).mapInArrow(finish, schema)
    return out.select(shown_id().alias("id"), *names[1:])
