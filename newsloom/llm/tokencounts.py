"""Token counts: rank-synchronous merging of ragged arrays.

The new words of a batch of texts lie end to end in one array, beside the merge rank of each symbol with the one behind it. At each step every word
looks for the lowest of its ranks, and all words merge their own pair at once, wherever it stands in them (from left to right where occurrences overlap); words
without a mergeable pair leave the array. What is left of a word is its count, which the task keeps for later texts. A pair whose merged symbol takes
part in a merge of lower rank is merged at its first place only, so that counts are those of merging one pair at a time. Words of more than LONG bytes go through the
heap of the encoder, as each step would pass over all of their bytes.

Cuts, special tokens and pair ranks are the encoder's. Defined results: null or empty text has no bytes and no tokens. Null ids keep their rows, rows repeat as given.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import KEPT, NONE, Encoder, Words
from .common import chunks, small_batches, text_bytes

#: Words of more bytes use the heap.
LONG = 2048


class Counter(Encoder):
    def __init__(self, path: str):
        super().__init__(path)
        # the lowest rank of the merges that a symbol takes part in
        first = np.full(len(self.pieces), NONE, np.int32)
        used = self.ranks != NONE
        for part in (self.keys[used] >> 20, self.keys[used] & 0xFFFFF):
            np.minimum.at(first, part, self.ranks[used])
        self.together = first[self.merged] > np.arange(len(self.merged))

    def forget(self) -> None:
        self.words, self.count = Words(), np.zeros(0, np.int64)

    def survivors(self, words: list[bytes]) -> np.ndarray:
        """The number of symbols that each word, one byte at least, is left with."""
        size = np.array([len(w) for w in words])
        left = size.copy()
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(size) - size
        parts = self.byte_id[data]
        parts[begin + size - 1] = self.last_id[data[begin + size - 1]]
        for w in np.flatnonzero(size > LONG):
            left[w] = len(self._long(parts[begin[w] : begin[w] + size[w]].tolist()))
        word = np.flatnonzero((size > 1) & (size <= LONG))
        row = np.repeat(np.arange(len(size)), size)
        here = (size[row] > 1) & (size[row] <= LONG)
        parts, size = parts[here], size[word]
        row = np.repeat(np.arange(len(word)), size)  # the place in `word` of each symbol
        ranks = np.full(len(parts), NONE, np.int32)
        inner = np.flatnonzero(row[:-1] == row[1:])
        ranks[inner] = self.rank(parts[inner], parts[inner + 1])
        while len(word):
            low = np.minimum.reduceat(ranks, np.cumsum(size) - size)
            done = low == NONE
            if done.any():
                left[word[done]] = size[done]
                stays = ~done[row]
                parts, ranks = parts[stays], ranks[stays]
                word, size, low = word[~done], size[~done], low[~done]
                row = np.repeat(np.arange(len(word)), size)
                if not len(word):
                    break
            at = np.flatnonzero(ranks == low[row])
            n = np.arange(len(at))
            run = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) == 1, 0, n))
            at = at[(n - run) % 2 == 0]  # of occurrences that overlap every other one
            mine = row[at]
            one = ~self.together[low[mine]] & (np.diff(mine, prepend=-1) == 0)
            at, mine = at[~one], mine[~one]
            parts[at] = self.merged[low[mine]]
            keep = np.ones(len(parts), bool)
            keep[at + 1] = False
            parts, ranks, row = parts[keep], ranks[keep], row[keep]
            size = size - np.bincount(mine, minlength=len(size))
            at = at - np.arange(len(at))  # each merge before takes one place
            behind = np.append(row[1:], -1)[at] == mine
            ranks[at] = NONE
            ranks[at[behind]] = self.rank(parts[at[behind]], parts[at[behind] + 1])
            before = at[(at > 0) & (row[at - 1] == mine)]
            ranks[before - 1] = self.rank(parts[before - 1], parts[before])
        return left

    def count_batch(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        if len(self.words) > KEPT:
            self.forget()
        known = len(self.words)
        marks: list[int] = []
        sizes, special = [], []
        for text in texts:
            n = len(marks)
            spans = self.split.split(text) if self.split is not None and "<|" in text else [text]
            for span in spans:
                marks += map(self.words.__getitem__, self._cut(span))
            sizes.append(len(marks) - n)
            special.append(len(spans) - 1)
        if len(self.words) > known:
            self.count = np.concatenate([self.count, self.survivors([w.encode() for w in itertools.islice(self.words, known, None)])])
        total = np.concatenate(([0], np.cumsum(self.count[np.array(marks, np.int64)])))
        ends = np.cumsum(sizes, dtype=np.int64)
        return total[ends] - total[ends - sizes] + special


@functools.lru_cache(4)
def counter(path: str) -> Counter:
    """The counter of a file, once for each Python worker."""
    return Counter(path)


def counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """n_bytes, n_tokens and whether these are over the limit, for every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = batch.column("text")
            n = counter(path).count_batch([t or "" for t in texts.to_pylist()])
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(text_bytes(texts)[1])), pa.array(n, pa.int64()), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
        counter(path).forget()

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
