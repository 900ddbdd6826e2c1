"""Documents that contain passages of held-out items, by SimHash windows and Hamming blocks.

The items looked for are passages of ``window`` words, the least that counts as a leak; each passage of
every item and each window of that size in the documents gets a 64-bit SimHash. The
fingerprint is cut into four blocks of 16 bits; two fingerprints within ``radius`` agree in at
least 4 - radius blocks, so looking up the blocks finds every item fingerprint within the radius
of a document's. Candidates are then verified by the exact similarity of the windows' weighted
shingles (five adjacent words, weighted by how rare the words are among the items); a stricter rule,
such as the same words in the same order, may follow.

Documents are read where they lie: the only thing sent is the index of the items. It is broadcast
only while it is under a checked bound. A larger item set is taken in blocks of that size, one
after the other, over words that are decoded and written once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligature.llm.mail import segments
from ligature.runtime import cut, spread

WORD = re.compile(r"[^\W_]+")
BLOCKS = 4
#: Words of items that are indexed and broadcast at once (about 60 bytes each, and 4 MB for the tables of blocks).
INDEX_WORDS = 300_000
#: Adjacent words of a shingle.
SHINGLE = 5
#: Words of documents that are fingerprinted at once, and spellings kept between documents.
CHUNK_WORDS, KEPT_SPELLINGS = 60_000, 400_000


class Spellings(dict):
    """64-bit hash of each word, computed when it first comes."""

    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def words_of(text: str) -> list[str]:
    """Runs of letters and digits in lower case."""
    return WORD.findall(text.lower())


def fingerprints(hashes: np.ndarray, window: int) -> np.ndarray:
    """SimHash of each window of word hashes: bit k is set if most of the words have it."""
    if len(hashes) < window:
        return np.empty(0, np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.cumsum(bits, axis=0, dtype=np.int32)
    sums[window:] = sums[window:] - sums[:-window]
    return np.packbits(sums[window - 1 :] * 2 > window, axis=1).view(np.uint64).ravel()


class Index:
    """Fingerprints of the items' passages, by block, with their words for verification."""

    def __init__(self, items: list[tuple[int, str]], window: int, radius: int, similarity: float):
        self.window, self.radius, self.similarity = window, radius, similarity
        spell = Spellings()
        ids, rows, starts, at = [], [], [], 0
        for item, text in items:
            h = np.array([spell[w] for w in words_of(text or "")], np.uint64)
            if len(h) >= window:
                rows.append(h)
                starts.append(np.arange(at, at + len(h) - window + 1))
                ids.append(np.full(len(starts[-1]), item, np.int64))
                at += len(h)
        self.words = np.concatenate(rows) if rows else np.empty(0, np.uint64)
        self.start = np.concatenate(starts) if rows else np.empty(0, np.int64)
        self.items = np.concatenate(ids) if rows else np.empty(0, np.int64)
        self.prints = np.concatenate([fingerprints(h, window) for h in rows]) if rows else np.empty(0, np.uint64)
        word, n = np.unique(self.words, return_counts=True)
        self.weight = dict(zip(word.tolist(), (1 / np.log(2.0 + n)).tolist()))
        blocks = self.prints.view(np.uint16).reshape(-1, BLOCKS)
        self.order = [np.argsort(blocks[:, k], kind="stable").astype(np.int32) for k in range(BLOCKS)]
        self.sorted = [blocks[o, k] for k, o in enumerate(self.order)]
        self.starts = [np.searchsorted(s, np.arange(1 << 16)).astype(np.int64) for s in self.sorted]
        self.counts = [np.bincount(s, minlength=1 << 16) for s in self.sorted]

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (document window, item window) within the radius."""
        blocks = prints.view(np.uint16).reshape(-1, BLOCKS)
        hits = np.zeros(len(prints), np.int8)
        for k in range(BLOCKS):
            hits += self.counts[k][blocks[:, k]] > 0
        near = np.flatnonzero(hits >= BLOCKS - self.radius)
        left, right = [], []
        for k in range(self.radius + 1):  # one of any radius + 1 blocks agrees
            values = blocks[near, k]
            n = self.counts[k][values]
            at = np.repeat(near, n)
            offsets = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            other = self.order[k][np.repeat(self.starts[k][values], n) + offsets]
            close = np.bitwise_count(prints[at] ^ self.prints[other]) <= self.radius
            left.append(at[close])
            right.append(other[close])
        return np.concatenate(left), np.concatenate(right)

    def passages(self, at: np.ndarray) -> np.ndarray:
        """The words of the item windows ``at``, a row each."""
        return self.words[self.start[at][:, None] + np.arange(self.window)]

    def similar(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether the weighted Jaccard similarity of the windows' shingles reaches the threshold."""
        size = min(SHINGLE, self.window)
        shingles: tuple[dict, dict] = ({}, {})
        for own, x in zip(shingles, (a.tolist(), b.tolist())):
            weights = [self.weight.get(w, 1.5) for w in x]
            for k in range(len(x) - size + 1):
                s = tuple(x[k : k + size])
                own[s] = own.get(s, 0.0) + sum(weights[k : k + size])
        keys = shingles[0].keys() | shingles[1].keys()
        least = sum(min(shingles[0].get(k, 0), shingles[1].get(k, 0)) for k in keys)
        most = sum(max(shingles[0].get(k, 0), shingles[1].get(k, 0)) for k in keys)
        return least >= self.similarity * most


def word_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """``(doc_id, hashes of the words)`` of every segment of batches of ``(doc_id, text)``."""
    spell = Spellings()
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for piece in segments(text):
                own = words_of(piece)
                yield doc, np.fromiter(map(spell.__getitem__, own), np.uint64, len(own))
            if len(spell) > KEPT_SPELLINGS:
                spell.clear()


def stored_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """The same from batches of ``(doc_id, words)``."""
    for batch in batches:
        for doc, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield doc, np.frombuffer(words, np.uint64)


def store(window: int):
    """A map that writes the segments' words; those too short for a window are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, words, held = [], [], 0
        for doc, own in word_hashes(batches):
            if len(own) >= window:
                docs.append(doc)
                words.append(own.tobytes())
                held += len(own)
            if held > CHUNK_WORDS:
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(words, pa.binary())], names=["doc_id", "words"])
                docs, words, held = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(words, pa.binary())], names=["doc_id", "words"])

    return run


def find(index: Index, same_words: bool, stored: bool):
    """A map over batches of ``(doc_id, text)``, or of stored words, to the distinct ``(doc_id, item_id)`` of each document."""
    window = index.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values: list[np.ndarray] = []
        docs: list[int] = []
        held = 0

        def flush() -> pa.RecordBatch:
            found: set[tuple[int, int]] = set()
            h = np.concatenate(values) if values else np.empty(0, np.uint64)
            owner = np.repeat(np.arange(len(docs)), [len(v) for v in values])
            # A very long document is taken in slices that overlap by all but one word of a window.
            for start in range(0, len(h) - window + 1, CHUNK_WORDS):
                part, of = h[start : start + CHUNK_WORDS + window - 1], owner[start : start + CHUNK_WORDS + window - 1]
                at = np.flatnonzero(of[: len(part) - window + 1] == of[window - 1 :])
                left, right = index.candidates(fingerprints(part, window)[at])
                equal = (part[at[left][:, None] + np.arange(window)] == index.passages(right)).all(axis=1) if len(left) else np.empty(0, bool)
                for a, b, same in zip(at[left].tolist(), right.tolist(), equal.tolist()):
                    pair = (docs[of[a]], int(index.items[b]))
                    # Equal windows have similarity 1.
                    if pair not in found and (same or index.similar(part[a : a + window], index.passages(np.array([b]))[0])) and (same or not same_words):
                        found.add(pair)
            cols = list(zip(*found)) or [(), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id"])

        for doc, own in (stored_hashes if stored else word_hashes)(batches):
            if len(own) >= window:
                values.append(own)
                docs.append(doc)
                held += len(own)
            if held > CHUNK_WORDS:
                yield flush()
                values, docs, held = [], [], 0
        yield flush()

    return run


def leaked(docs: DataFrame, items: DataFrame, window: int = 10, radius: int = 3, similarity: float = 0.8, same_words: bool = True, index_words: int = INDEX_WORDS) -> DataFrame:
    """Distinct ``(doc_id, item_id)``: the document holds a passage of ``window`` words of the item.

    Words are runs of letters and digits in lower case, of the mail's header and of each text part,
    decoded; a window lies within one of them. Candidates lie within ``radius`` (at most 3) bits and reach
    ``similarity`` on their weighted shingles; with ``same_words`` the verified windows must also have the same
    words in the same order. Null and empty texts and items of fewer words contain nothing; a null id takes no
    part; an empty table on either side gives no rows. Whole texts are read, however long. ``index_words`` decides
    how many items are looked for at once.
    """
    spark = docs.sparkSession
    items = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (6 * index_words)))
    source = spread(docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    schema = "doc_id long, item_id long"
    if blocks > 1:
        source = cut(source.mapInArrow(store(window), "doc_id long, words binary"))
    found = None
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks).cast("long")) == b)
        index = spark.sparkContext.broadcast(Index([(r.item_id, r.text) for r in own.collect()], window, radius, similarity))
        part = source.mapInArrow(lambda it, index=index: find(index.value, same_words, blocks > 1)(it), schema)
        if blocks > 1:  # one index at a time, on the driver and on every worker
            part = cut(part)
            index.destroy()
        found = part if found is None else found.unionByName(part)
    return found.distinct()
