"""Encoding of a corpus with a public byte-level BPE through a global distinct-word shuffle.

Texts are split where they lie. The texts read together form a block; their pre-tokens are exploded in
the order of their positions, as the number of a distinct word of the block at each position. A distinct word
of a block is a row; it goes to the partition of its word, where every distinct word is encoded once however
many blocks hold it; the ids come back to their block, are joined to the positions by number and put into
place. Decoding joins each id with the table of token bytes and reassembles by position.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligature.runtime import cut, estimated_bytes

#: Folder of the vocabulary files; a parameter, never copied into the repository.
TOKENIZERS = os.environ.get("LIGATURE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern for a faster engine; the two agree on texts without the characters below.
FAST_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Outside of the blocks where the engines' classes are alike (numbers that aren't digits, separators, rarer scripts).
UNLIKE = "[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u0386-\u03ce\u0400-\u0481\u048a-\u052f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u2190-\u23ff\u2500-\u2767\u3001\u3002\u3008-\u3011\u3041-\u3096\u30a0-\u30ff\u4e00-\u9fef]"
#: Characters that are split together, rows of words that may share a partition, and bytes of input a partition is meant for.
BLOCK_CHARS = 6_000_000
WORD_BLOCKS = 10_000
PART_BYTES, MANY_PARTS, LARGE_PART_BYTES = 4 << 20, 20_000, 128 << 20
UNKNOWN = 1 << 60
WORDS, CODED = "block long, code int, word binary", "block long, code int, ids binary"
#: Code of the row that holds a block's documents and positions.
HEAD = -1


@lru_cache(1)
def splitters():
    import regex

    return re.compile(UNLIKE).search, re.compile(FAST_PATTERN).findall, regex.compile(PATTERN).findall


def pre_tokens(text: str) -> list[str]:
    """The pieces that are encoded on their own; joined, they are the text."""
    unlike, fast, full = splitters()
    return full(text) if unlike(text) else fast(text)


@lru_cache(2)
def encoder(path: str):
    """The encoding function of a rank file; special tokens are ordinary text."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Codes(dict):
    """Number of each word, given when it first comes."""

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        return code


def head_of(ids: list[int | None], counts: list[int], codes: np.ndarray) -> bytes:
    """A block's documents, null or not, id and number of pre-tokens, and the code at each position."""
    docs = np.array([[i is None, i or 0, n] for i, n in zip(ids, counts)], "<i8").tobytes()
    return np.array([len(ids)], "<i8").tobytes() + docs + pa.compress(codes.astype("<i4").tobytes(), "zstd", asbytes=True)


def documents_of(head: bytes) -> tuple[np.ndarray, np.ndarray]:
    """``(documents, codes)`` of :func:`head_of`."""
    n = int(np.frombuffer(head, "<i8", 1)[0])
    docs = np.frombuffer(head, "<i8", 3 * n, 8).reshape(-1, 3)
    size = 4 * int(docs[:, 2].sum())
    return docs, np.frombuffer(pa.decompress(head[8 + 24 * n :], size, "zstd", asbytes=True), "<i4")


def ragged(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(offsets, bytes)`` of a binary column without nulls."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = pa.concat_arrays(values.chunks) if isinstance(values, pa.ChunkedArray) else values
    raw = values.buffers()
    offsets = np.frombuffer(raw[1], np.int32 if values.type == pa.binary() else np.int64)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.empty(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def exploded(block_chars: int):
    """Batches of ``(doc_id, text)`` to each block's distinct pre-tokens, numbered, and its row of positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # Input comes in the same order whenever a task is run again, so its blocks are the same.
        block = TaskContext.get().partitionId() << 32
        words, codes, ids, counts, chars = Codes(), [], [], [], 0

        def emit() -> pa.RecordBatch:
            n = len(words) + 1
            rows = [head_of(ids, counts, np.concatenate(codes)), *(w.encode("utf-8") for w in words)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.arange(HEAD, n - 1, dtype=np.int32)), pa.array(rows, pa.binary())], names=["block", "code", "word"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pieces = pre_tokens(text)
                codes.append(np.fromiter(map(words.__getitem__, pieces), np.int32, len(pieces)))
                ids.append(doc)
                counts.append(len(pieces))
                chars += len(text)
                if chars >= block_chars:
                    yield emit()
                    block += 1
                    words, codes, ids, counts, chars = Codes(), [], [], [], 0
        if ids:
            yield emit()

    return run


def encode_words(path: str):
    """Batches of ``(block, code, word)`` ordered by word; each word is encoded when it first comes, into 32-bit integers. Rows of positions pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last, ids = encoder(path), None, b""
        for batch in batches:
            out = []
            for code, word in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if code == HEAD:
                    out.append(word)
                    continue
                if word != last:
                    last, ids = word, np.array(encode(word.decode("utf-8")), "<i4").tobytes()
                out.append(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["block", "code", "ids"])

    return run


def reassemble(rows: pa.Table) -> pa.Table:
    """One block: the ids joined to the positions by code, and cut into documents."""
    is_head = pc.equal(rows.column("code"), HEAD)
    docs, codes = documents_of(rows.filter(is_head).column("ids")[0].as_py())
    words = rows.filter(pc.invert(is_head))
    offsets, raw = ragged(words.column("ids"))
    row_of = np.empty(words.num_rows, np.int64)
    row_of[words.column("code").to_numpy()] = np.arange(words.num_rows)
    at = row_of[codes]
    length = (np.diff(offsets) // 4)[at]
    ends = np.cumsum(length)
    values = raw.view("<i4")[np.repeat(offsets[at] // 4 - (ends - length), length) + np.arange(ends[-1])]
    # Lists of 32-bit offsets: a block's ids are far fewer than 2**31.
    bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(docs[:, 2])])]
    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32()))
    return pa.table({"doc_id": pa.array(docs[:, 1], mask=docs[:, 0] == 1), "ids": lists})


def settled(texts: DataFrame) -> DataFrame:
    """``texts`` in splits that come in the same order whenever they are read, dealt out over the cores if they are few.

    A scan of files is that already. Anything behind a shuffle is written first; a small input is dealt out and ordered.
    """
    cores = texts.sparkSession.sparkContext.defaultParallelism
    if "AdaptiveSparkPlan" in texts._jdf.queryExecution().executedPlan().nodeName():
        return cut(texts)
    return texts if texts.rdd.getNumPartitions() >= cores else texts.repartition(cores).sortWithinPartitions("doc_id", "text")


def partitions(spark, size: int) -> int:
    """Partitions for ``size`` bytes of input: small ones as long as they are not too many, then larger ones."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // PART_BYTES, MANY_PARTS), size // LARGE_PART_BYTES)


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(doc_id, ids)`` of every row of ``docs``, without special tokens.

    Null and empty texts give the empty list. Text that looks like a special token is ordinary
    text. Rows keep their number: a repeated id is encoded as often as it comes. A null id is
    encoded like any other. An empty table gives no rows; other columns are ignored.
    """
    both = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blank = F.coalesce(F.col("text"), F.lit("")) == ""
    texts = settled(both.where(~blank))
    size = estimated_bytes(docs)
    if size >= UNKNOWN:  # not read from files: characters, as if compressed five to one
        size = (texts.agg(F.sum(F.length("text"))).first()[0] or 0) // 5
    n = partitions(docs.sparkSession, size)
    rows = texts.mapInArrow(exploded(block_chars), WORDS)
    # A word of all blocks is dealt out by block; blocks are at least as large as block_chars bytes, so their number is bounded by the size (compressed about five to one).
    salts = max(1, 5 * size // block_chars // WORD_BLOCKS)
    head = F.col("code") == HEAD
    salt = F.when(head, F.col("block")).otherwise(F.pmod(F.xxhash64("block"), F.lit(salts).cast("long")))
    coded = rows.repartition(n, F.when(~head, F.col("word")), salt).sortWithinPartitions("word").mapInArrow(encode_words(f"{folder}/{VOCABULARY}"), CODED)
    ids = coded.repartition(n, "block").groupBy("block").applyInArrow(reassemble, "doc_id long, ids array<int>")
    return ids.unionByName(both.where(blank).select("doc_id", F.array().cast("array<int>").alias("ids")))


def token_table(spark, path: str) -> DataFrame:
    """``(id, bytes)`` of every token; its size is that of the vocabulary."""
    rows = [(int(b), base64.b64decode(a)) for a, b in map(bytes.split, open(path, "rb"))]
    return spark.createDataFrame(pa.table({"id": pa.array([i for i, _ in rows], pa.int32()), "bytes": pa.array([b for _, b in rows], pa.binary())}))


def joined_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``(row, doc_id, position, bytes)`` in order to ``(doc_id, text)``; the open text goes on in the next batch."""
    open_row, open_doc, parts, due = None, None, [], 0

    def closed() -> tuple:
        return open_doc, b"".join(parts).decode("utf-8", "replace")

    for batch in batches:
        if not batch.num_rows:
            continue
        row, position = batch.column(0).to_numpy(), batch.column(2).fill_null(0).to_numpy(zero_copy_only=False)
        offsets, data = ragged(batch.column(3).fill_null(b""))
        raw, docs, done = data.tobytes(), batch.column(1), []
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(row)]):
            if row[s] != open_row:
                if open_row is not None:
                    done.append(closed())
                open_row, open_doc, parts, due = row[s], docs[s].as_py(), [], 0
            if position[s] != due or position[e - 1] != due + e - s - 1:
                raise RuntimeError("positions out of order")
            due += e - s
            parts.append(raw[offsets[s] : offsets[e]])
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.string()))], names=["doc_id", "text"])
    if open_row is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(closed(), (pa.int64(), pa.string()))], names=["doc_id", "text"])


def decode_corpus(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", folder: str = TOKENIZERS) -> DataFrame:
    """``(doc_id, text)`` of ``(doc_id, ids)``: each id with its position is joined to its bytes, which are put together by position.

    The table is bounded by the vocabulary, so it is broadcast and nothing is shuffled: the ids of a row stay
    in order, which is checked where they are put together. Null and empty lists give the empty text, ids outside
    the vocabulary an error; rows keep their number.
    """
    table = token_table(encoded.sparkSession, f"{folder}/{VOCABULARY}")
    rows = encoded.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    tokens = rows.select("row", "doc_id", F.posexplode_outer("ids").alias("position", "id")).join(F.broadcast(table), "id", "left")
    known = F.when(F.col("id").isNotNull() & F.col("bytes").isNull(), F.raise_error(F.concat(F.lit("id "), F.col("id").cast("string"), F.lit(" outside the vocabulary")))).otherwise(F.col("bytes"))
    return tokens.select("row", "doc_id", "position", known.alias("bytes")).mapInArrow(joined_texts, "doc_id long, text string")
