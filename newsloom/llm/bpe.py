"""BPE encoding and decoding with the vocabulary files of public tokenizers.

Texts are cut into words by the file's pattern; a task encodes each new word once. A word is a contiguous array of parts (token ids)
beside the ranks of its adjacent pairs. Words of one length are merged together: each step scans every row for its
lowest rank, deletes that boundary and looks up the two ranks beside it; a row without a mergeable pair is done. Words of more
than LONG bytes keep their pairs in a heap instead, so that a text without spaces costs n log n.

Two kinds of file are read: byte-level BPE, and BPE with word ends whose texts are normalised (NFC, white space, lower case) first.
Special tokens in a text become their ids, as the files ask.

Defined results: null or empty text has no tokens and decodes to the empty text. Null ids keep their rows, rows repeat as given.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, small_batches

#: Words longer than this use the heap; a task forgets its words beyond KEPT.
LONG, KEPT = 64, 200_000
NONE = np.int32(2**31 - 1)
#: The cut of byte-level texts where a file names no pattern of its own (a fixed value of these vocabularies).
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_characters() -> list[str]:
    """The character that stands for each byte in the files: printable ones for themselves, the others from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    more = iter(range(256, 512))
    return [chr(b if b in plain else next(more)) for b in range(256)]


class Words(dict):
    """Numbers words in the order of their first use."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        characters = byte_characters()
        self.normalised = spec["normalizer"] is not None
        cut = next((p["pattern"]["Regex"] for p in (spec["pre_tokenizer"].get("pretokenizers") or []) if "pattern" in p), BYTE_LEVEL)
        self.find = regex.compile(cut).findall
        # the same cut of ASCII texts, for the standard library's faster engine
        ascii_cut = cut.replace("[\\p{L}]", "[A-Za-z]").replace("[\\p{N}]", "[0-9]").replace("\\p{L}", "A-Za-z").replace("\\p{N}", "0-9").replace(" ?A-Za-z+", " ?[A-Za-z]+").replace(" ?0-9+", " ?[0-9]+")
        self.find_ascii = re.compile(ascii_cut.replace("[^\\s", "[^\\t-\\r ").replace("\\s+", "[\\t-\\r ]+").replace("\\S", "[^\\t-\\r ]")).findall
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.byte_id = np.array([vocab[c] for c in characters], np.int32)
        self.last_id = np.array([vocab[c + end] for c in characters], np.int32)
        # pairs by a hash table of open addresses
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.bits = max(4, (8 * len(pairs)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        wanted = (left << 20) | right
        slot, todo = self._slot(wanted), np.arange(len(wanted))
        while len(todo):
            free = todo[self.keys[slot[todo]] == -1]
            _, first = np.unique(slot[free], return_index=True)
            self.keys[slot[free[first]]] = wanted[free[first]]
            self.ranks[slot[free[first]]] = free[first]
            todo = todo[self.keys[slot[todo]] != wanted[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        # bytes of each id
        back = {c: b for b, c in enumerate(characters)}
        size = max([*vocab.values(), *self.special.values()]) + 1
        pieces = [b""] * size
        for token, i in vocab.items():
            pieces[i] = bytes(back[c] for c in token.removesuffix(end)) + (b" " if end and token.endswith(end) else b"")
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.pieces = pieces
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.piece_at = np.concatenate(([0], np.cumsum([len(p) for p in pieces])))
        self.forget()

    def forget(self) -> None:
        """Frees the words of the task; the worker may serve other jobs next."""
        self.words, self.flat, self.count = Words(), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, NONE if it isn't one."""
        key = (left.astype(np.int64) << 20) | right
        slot = self._slot(key)
        seen = self.keys[slot]
        out = np.where(seen == key, self.ranks[slot], NONE)
        todo = np.flatnonzero((seen != key) & (seen != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slot[todo]]
            hit = seen == key[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (seen != -1)]
        return out

    def _short(self, parts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows of words of one length, one part for each byte: (row numbers, their final parts) by the step at which they are done."""
        rows = np.arange(len(parts))
        done = []
        ranks = self.rank(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(len(parts), -1)
        while ranks.shape[1]:
            at = ranks.argmin(axis=1)
            low = ranks[np.arange(len(rows)), at]
            over = low == NONE
            if over.any():
                done.append((rows[over], parts[over]))
                rows, parts, ranks, at, low = (x[~over] for x in (rows, parts, ranks, at, low))
                if not len(rows):
                    return done
            n, width = parts.shape
            i = np.arange(n)
            # the boundary behind part `at` goes
            keep = np.ones(parts.shape, bool)
            keep[i, at + 1] = False
            parts = parts[keep].reshape(n, width - 1)
            parts[i, at] = self.merged[low]
            keep = np.ones(ranks.shape, bool)
            keep[i, at] = False
            ranks = ranks[keep].reshape(n, width - 2)
            has = np.flatnonzero(at > 0)
            ranks[has, at[has] - 1] = self.rank(parts[has, at[has] - 1], parts[has, at[has]])
            has = np.flatnonzero(at < width - 2)
            ranks[has, at[has]] = self.rank(parts[has, at[has]], parts[has, at[has] + 1])
        done.append((rows, parts))
        return done

    def _long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        follows, before = [*range(1, n), -1], [-1, *range(n - 1)]
        alive = [True] * n
        first = self.rank(np.array(parts[:-1]), np.array(parts[1:])).tolist()
        heap = [(r, i, parts[i], parts[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        one = functools.lru_cache(100_000)(lambda a, b: int(self.rank(np.array([a]), np.array([b]))[0]))
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = follows[i]
            if not alive[i] or j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j] = int(self.merged[r]), False
            follows[i] = k = follows[j]
            if k >= 0:
                before[k] = i
                if (x := one(parts[i], parts[k])) != NONE:
                    heapq.heappush(heap, (x, i, parts[i], parts[k]))
            h = before[i]
            if h >= 0 and (x := one(parts[h], parts[i])) != NONE:
                heapq.heappush(heap, (x, h, parts[h], parts[i]))
        return [p for p, a in zip(parts, alive, strict=True) if a]

    def _learn(self, new: list[str]) -> None:
        """Encodes words and puts their ids behind those of the words before."""
        raw = [w.encode() for w in new]
        length = np.array([len(r) for r in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        begin = np.cumsum(length) - length
        count = np.zeros(len(raw), np.int64)
        pieces = []  # (row numbers, parts), of equal widths
        for n in np.unique(length):
            rows = np.flatnonzero(length == n)
            if n > LONG:
                for r in rows:
                    b = data[begin[r] : begin[r] + n]
                    pieces.append((np.array([r]), np.array([self._long([*self.byte_id[b[:-1]].tolist(), int(self.last_id[b[-1]])])], np.int32)))
                continue
            b = data[begin[rows][:, None] + np.arange(n)]
            parts = self.byte_id[b]
            parts[:, -1] = self.last_id[b[:, -1]]
            pieces += [(rows[r], p) for r, p in (self._short(parts) if n > 1 else [(np.arange(len(rows)), parts)])]
        for rows, parts in pieces:
            count[rows] = parts.shape[1]
        at = np.cumsum(count) - count
        flat = np.zeros(int(count.sum()), np.int32)
        for rows, parts in pieces:
            flat[at[rows][:, None] + np.arange(parts.shape[1])] = parts
        self.flat, self.count = np.concatenate([self.flat, flat]), np.concatenate([self.count, count])

    def _cut(self, text: str) -> list[str]:
        if self.normalised:
            if not text.isascii():
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # letter by letter: no final sigma
            text = text.lower()
        return self.find_ascii(text) if text.isascii() else self.find(text)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's begin and end."""
        if len(self.words) > KEPT:
            self.forget()
        known = len(self.words)
        number = self.words.__getitem__
        marks: list[int] = []  # words by number; special tokens as -1 - id
        sizes = []
        for text in texts:
            n = len(marks)
            if self.split is not None and "<|" in text and self.split.search(text):
                at = 0
                for m in self.split.finditer(text):
                    marks += map(number, self._cut(text[at : m.start()]))
                    marks.append(-1 - self.special[m[0]])
                    at = m.end()
                marks += map(number, self._cut(text[at:]))
            else:
                marks += map(number, self._cut(text))
            sizes.append(len(marks) - n)
        if len(self.words) > known:
            self._learn(list(itertools.islice(self.words, known, None)))
        mark = np.array(marks, np.int64)
        at = np.cumsum(self.count) - self.count
        special = mark < 0
        word = np.where(special, 0, mark)
        n = np.where(special, 1, self.count[word] if len(self.count) else 1)
        total = np.concatenate(([0], np.cumsum(n)))
        source = np.repeat(np.where(special, 0, at[word] if len(at) else 0) - total[:-1], n) + np.arange(total[-1])
        out = self.flat[source] if len(self.flat) else np.zeros(total[-1], np.int32)
        out[total[:-1][special]] = -1 - mark[special]
        return out.astype(np.uint32), total[np.concatenate(([0], np.cumsum(sizes)))]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids' pieces, end to end."""
        n = self.piece_at[ids.astype(np.int64) + 1] - self.piece_at[ids]
        end = np.cumsum(n)
        return self.piece_bytes[np.repeat(self.piece_at[ids] - (end - n), n) + np.arange(end[-1] if len(end) else 0)].tobytes()

    def decode(self, ids: np.ndarray | list[int]) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")


@functools.lru_cache(4)
def encoder(path: str) -> Encoder:
    """The encoder of a file, once for each Python worker."""
    return Encoder(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded (the text that they stand for) of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            e = encoder(path)
            ids, at = e.encode_batch([t or "" for t in batch.column("text").to_pylist()])
            texts = [e.decode(ids[a:b]) for a, b in itertools.pairwise(at)]
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.record_batch([batch.column("doc_id"), lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])
        encoder(path).forget()

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """n_tokens and the digests of ids (little-endian, 32 bits each) and of the decoded text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            e = encoder(path)
            ids, at = e.encode_batch([t or "" for t in batch.column("text").to_pylist()])
            raw, spans = ids.astype("<u4"), list(itertools.pairwise(at))
            ids_sha = [hashlib.sha256(raw[a:b].tobytes()).hexdigest() for a, b in spans]
            text_sha = [hashlib.sha256(e.decode(ids[a:b]).encode()).hexdigest() for a, b in spans]
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        encoder(path).forget()

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
