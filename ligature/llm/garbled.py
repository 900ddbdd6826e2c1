"""Text decoded with the wrong character encoding: found and restored by noisy-channel decoding.

The unit is the chunk, a run of characters without ASCII white space that holds a character outside
ASCII; a very long one is cut where ASCII characters stand. Every distinct chunk of the corpus is judged once. A
channel says which encoding the bytes were written in and which they were read in; channels may follow one another. Under a channel a chunk is a byte lattice: an edge
keeps a character as it is or turns the bytes behind one or more characters into the character they
stood for; a lost byte (U+FFFD, or a question mark or the space after the chunk where a byte must be) is a
wildcard. Viterbi search finds the likeliest original under character frequencies of the
corpus; the candidates of all channels then compete with the chunk itself under the corpus'
word frequencies, which are joined, never sent around as a whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligature.runtime import cut, spread

#: How bytes were read (outer) and what they were written in (inner).
READ_AS = ("cp1252", "cp437", "cp850", "mac_roman", "cp1251", "koi8-r", "cp866", "iso8859-5", "cp1250", "iso8859-15", "cp1253", "cp1254", "mac_cyrillic", "iso8859-2", "iso8859-7", "cp1257")
SINGLE = ("cp1252", "cp1251", "koi8-r", "cp866", "iso8859-5", "mac_roman", "cp437", "cp850", "cp1250", "iso8859-2", "mac_cyrillic", "cp1253")
MULTI = ("utf-8", "cp932", "euc_jp", "gb18030", "euc_kr", "big5")
LOST = "�"
#: A chunk: the ASCII characters before the first other one, so many characters after it, and what is left of the run of other ones then; what follows is the next chunk.
CHUNK = r"(?:(?<![^\x00-\x20])|\G)[\x21-\x7f]*+[^\x00-\x7f][^\x00-\x20]{0,150}[^\x00-\x7f]{0,2000}"
#: Of a long chunk so many ASCII characters are kept before the first other one; they can't have changed.
LEAD, LEAD_FROM = r"^[\x21-\x7f]*(?=[\x21-\x7f]{60}[^\x00-\x7f])", 220
#: Cost of leaving or entering the damaged state within a chunk, and of a wildcard byte.
SWITCH, WILD = 3.0, 2.5
#: What an explanation must gain (natural logarithm): characters alone for multi-byte encodings, words for single-byte ones.
GAIN = {"utf-8": 6.5, "eastern": 10.0}
WORD_GAIN, WORD_LENGTH, WORD_TEXTS = 3.5, 3, 3
CHUNKS_PER_TASK = 2000


@lru_cache(None)
def byte_of(read_as: str) -> dict[str, int]:
    """Byte behind each character outside ASCII; control characters stand for themselves where the encoding has a gap."""
    table = {chr(b): b for b in range(0x80, 0xA0)} if read_as.startswith("cp125") or read_as.startswith("iso") else {}
    for b in range(0x80, 0x100):
        try:
            table[bytes([b]).decode(read_as)] = b
        except UnicodeError:
            pass
    return table


@lru_cache(None)
def char_of(written_in: str) -> dict[int, str]:
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[b] = bytes([b]).decode(written_in)
        except UnicodeError:
            pass
    return out


@lru_cache(200_000)
def multi(written_in: str, raw: bytes) -> str | None:
    """The one character of ``raw`` in a multi-byte encoding, or None."""
    try:
        text = raw.decode(written_in)
    except UnicodeError:
        return None
    return text if len(text) == 1 and text > "\x7f" else None


def kind(ch: str) -> str:
    """Class of a character: a small alphabet for transitions."""
    o = ord(ch)
    if o < 0x80:
        return "a" if ch.isalpha() else "d" if ch.isdigit() else "p"
    if o < 0xA0:
        return "x"
    if o < 0x250:
        return ("l" if ch.islower() else "L") if ch.isalpha() and ch not in "ªº" else "s"
    if 0x370 <= o < 0x400:
        return "g"
    if 0x400 <= o < 0x530:
        return "c" if ch.islower() else "C"
    if 0x3040 <= o < 0x3100:
        return "k"
    if 0x3400 <= o < 0xA000:
        return "h"
    if 0x2500 <= o < 0x25A0:
        return "b"
    if 0xFF61 <= o < 0xFFA0:
        return "w"
    if 0x2010 <= o < 0x2030 or 0x3000 <= o < 0x3040:
        return "q"
    return "o" if ch.isalpha() else "s"


@lru_cache(20_000)
def pool(ch: str) -> str:
    """What an unseen character may be mistaken for: its class, or any code point that stands for nothing."""
    return "u" if unicodedata.category(ch) in ("Cn", "Co", "Cs") else kind(ch)


class Characters:
    """Log-probabilities of characters and of class transitions in the corpus' chunks.

    The tables are bounded by the number of code points and of pairs of classes.
    """

    def __init__(self, chars: dict[str, float], pairs: dict[str, float]):
        total = sum(chars.values()) + 1.0
        # The share of what the corpus doesn't hold is divided among all code points of a class.
        self.floor = {p: log(0.05 / total / n) for p, n in Counter(pool.__wrapped__(chr(o)) for o in range(0x80, 0x110000)).items()}
        self.char = {c: log(n / total) for c, n in chars.items()}
        sums: dict[str, float] = {}
        for p, n in pairs.items():
            sums[p[0]] = sums.get(p[0], 0.0) + n
        self.pair = {p: log((n + 0.1) / (sums[p[0]] + 10)) for p, n in pairs.items()}
        self.unseen = {k: log(0.1 / (n + 10)) for k, n in sums.items()}
        self.seen = {c for c in chars if c > "\x9f" and c != LOST}
        # The commonest character behind each pattern of known and lost bytes (None).
        self.wild: dict[tuple[int | None, ...], str] = {}
        for c in sorted(self.seen, key=lambda c: (-chars[c], c)):
            raw = c.encode("utf-8", "ignore")
            for lost in range(1, (1 << len(raw)) - 1):
                self.wild.setdefault(tuple(None if lost >> k & 1 else b for k, b in enumerate(raw)), c)

    def one(self, ch: str) -> float:
        if ch <= "\x7f":
            return -3.2
        return self.char[ch] if ch in self.char else self.floor[pool(ch)]

    def step(self, a: str, b: str) -> float:
        p = a + b
        return self.pair[p] if p in self.pair else self.unseen.get(a, -2.0)

    def score(self, text: str) -> float:
        """Log-probability of a text under both tables."""
        last, total = "p", 0.0
        for ch in text:
            k = kind(ch)
            total += self.one(ch) + self.step(last, k)
            last = k
        return total


def lattice(chunk: str, read_as: str, written_in: str) -> list[list[tuple[int, str, float]]]:
    """Edges ``(to, original characters, cost)`` that start at each position and undo the channel; wildcards as original None."""
    table = byte_of(read_as)
    raw = [table.get(c, ord(c) if c < "\x80" else -1) for c in chunk]
    edges: list[list[tuple[int, str, float]]] = [[] for _ in chunk]
    if written_in in SINGLE:
        back = char_of(written_in)
        for i, b in enumerate(raw):
            if b >= 0x80 and b in back and back[b] > "\x7f":
                edges[i].append((i + 1, back[b], 0.0))
        return edges
    longest = 4 if written_in in ("utf-8", "gb18030") else 3 if written_in == "euc_jp" else 2
    for i, b in enumerate(raw):
        if b < 0x80:
            continue
        for n in range(1, longest + 1):
            part = raw[i : i + n]
            if len(part) < n or -1 in part:
                break
            if (d := multi(written_in, bytes(part))) is not None:
                edges[i].append((i + n, d, 0.0))
    return edges


def wildcards(chunk: str, read_as: str, chars: Characters) -> list[tuple[int, int, str, int]]:
    """Edges ``(from, to, character, bytes lost)`` of UTF-8 sequences of which some, but not all bytes are lost."""
    table = byte_of(read_as)
    out = []
    if chunk and 0xC2 <= table.get(chunk[-1], 0) < 0xE0:  # at the end: a no-break space that was stored as a space
        d = multi("utf-8", bytes([table[chunk[-1]], 0xA0]))
        out += [(len(chunk) - 1, len(chunk), d, 1)] if d in chars.seen else []
    if LOST not in chunk and "?" not in chunk:
        return out
    for i in range(len(chunk)):
        for n in (2, 3, 4):
            part = chunk[i : i + n]
            if len(part) < n:
                break
            pattern = tuple(None if x == LOST or (x == "?" and k) else table.get(x, -1) for k, x in enumerate(part))
            if None in pattern and (d := chars.wild.get(pattern)) is not None:
                out.append((i, i + n, d, pattern.count(None)))
    return out


def viterbi(chunk: str, edges: list[list[tuple[int, str, float]]], chars: Characters) -> tuple[str, float]:
    """Likeliest original of the chunk and its log-probability, over paths that keep or undo characters."""
    n = len(chunk)
    # best[i]: state (class of the last character, damaged so far here) -> (score, back pointer)
    best: list[dict[tuple[str, bool], tuple[float, tuple | None]]] = [{} for _ in range(n + 1)]
    best[0]["p", True] = (0.0, None)
    for i in range(n):
        if not best[i]:
            continue
        own = [(i + 1, chunk[i], 0.0, False)] + [(j, d, cost, True) for j, d, cost in edges[i]]
        for (last, undone), (score, back) in best[i].items():
            for j, d, cost, undo in own:
                k = kind(d)
                ascii_char = d < "\x80"
                state = undone if ascii_char else undo
                s = score + chars.one(d) + chars.step(last, k) - cost - (SWITCH if state != undone and not ascii_char else 0.0)
                if (k, state) not in best[j] or best[j][k, state][0] < s:
                    best[j][k, state] = (s, (d, back))
    score, back = max(best[n].values(), key=lambda x: x[0])
    out = []
    while back is not None:
        out.append(back[0])
        back = back[1]
    return "".join(reversed(out)), score


@lru_cache(None)
def lead_pattern(read_as: str) -> re.Pattern:
    """A quick test for UTF-8 sequences read as ``read_as``."""
    table = byte_of(read_as)
    lead = "".join(re.escape(c) for c, b in table.items() if 0xC2 <= b < 0xF5)
    more = "".join(re.escape(c) for c, b in table.items() if 0x80 <= b < 0xC0)
    return re.compile(f"[{lead}](?:[{more}{LOST}]|\\?)|{LOST}[{more}]")


def undo_all(chunk: str, edges: list[list[tuple[int, str, float]]]) -> tuple[str, int]:
    """The chunk with every sequence that ``edges`` undo undone, likely or not, and how many characters outside ASCII stay as they are."""
    out, i, kept = [], 0, 0
    while i < len(chunk):
        j, d, _ = max(edges[i], default=(i + 1, chunk[i], 0.0), key=lambda e: e[0])
        kept += not edges[i] and chunk[i] > "\x7f"
        out.append(d)
        i = j
    return "".join(out), kept


def unread(chunk: str, read_as: str) -> str | None:
    """UTF-8 behind text that was read in a multi-byte encoding; what can't be read is lost, and has to be far less than what can."""
    try:
        text = b"\xff".join(part.encode(read_as) for part in chunk.split(LOST)).decode("utf-8", "replace")
    except UnicodeError:
        return None
    lost, kept = text.count(LOST), sum(c > "\x7f" for c in text)
    return text if text != chunk and (kept - lost) >= 3 * lost and kept > lost else None


def eastern(original: str, chunk: str, written_in: str) -> bool:
    """Whether an original is East Asian text: no other characters, and not a lone one behind a frame or a letter."""
    new = [c for c in original if c > "\x7f"]
    kinds = {kind(c) for c in new}
    if not new or kinds - set("khq" if written_in in ("cp932", "euc_jp") else "hoq"):
        return False
    old = {kind(c) for c in chunk if c > "\x7f"}
    return "k" in kinds or (not old & set("bcCg") and len(new) * 3 >= len(chunk) - len(chunk.encode("ascii", "ignore")))


def candidates(chunk: str, chars: Characters) -> list[tuple[str, str, str, float]]:
    """``(encoding written in, channel, original, gain in log-probability)`` of all explanations that gain, best first.

    None is left out here: for single-byte encodings only the corpus' words can tell which is right. UTF-8 may have been
    misread any number of times, in any order of encodings: each time undone leaves fewer characters, so this ends.
    Other encodings are undone once.
    """
    plain = chars.score(chunk)
    foreign = {c for c in chunk if c > "\x7f"} - {LOST}
    found: dict[tuple[str, str], tuple[str, float]] = {}

    def add(written_in: str, channel: str, original: str, gain: float) -> None:
        if original != chunk and gain > 0 and ((written_in, original) not in found or found[written_in, original][1] < gain):
            found[written_in, original] = (channel, gain)

    texts, open_ = {chunk}, [(chunk, ())]
    while open_:
        text, path = open_.pop()
        below = []
        for read_as in READ_AS:
            if not lead_pattern(read_as).search(text):
                continue
            plainly = lattice(text, read_as, "utf-8")
            edges = [list(e) for e in plainly]
            for i, j, d, lost in wildcards(text, read_as, chars):
                edges[i].append((j, d, WILD * lost))
            if not any(edges):
                continue
            channel = "utf-8 read as " + ", again as ".join((*path, read_as))
            original, score = viterbi(text, edges, chars)
            add("utf-8", channel, original, score - plain)
            undone, kept = undo_all(text, plainly)
            add("utf-8", channel, undone, chars.score(undone) - plain)
            if len(undone) < len(text) and undone not in texts:
                texts.add(undone)
                below.append((kept > 0, undone, (*path, read_as)))
        # Where a channel explains all of the text, those that explain a part of it aren't followed further.
        part = min((b[0] for b in below), default=False)
        open_ += [(undone, way) for only_part, undone, way in below if only_part == part]
    for read_as in MULTI[1:]:
        if (original := unread(chunk, read_as)) is not None:
            add("utf-8", f"utf-8 read as {read_as}", original, chars.score(original) - plain)
    for read_as in READ_AS:
        table = byte_of(read_as)
        inside = sum(c in table for c in foreign)
        if not inside:
            continue
        if inside < len(foreign):
            continue
        for written_in in (*MULTI[1:], *SINGLE):
            if written_in == read_as:
                continue
            edges = lattice(chunk, read_as, written_in)
            if not any(edges):
                continue
            original, score = viterbi(chunk, edges, chars)
            if written_in in SINGLE or eastern(original, chunk, written_in):
                add("eastern" if written_in in MULTI else "single", f"{written_in} read as {read_as}", original, score - plain)
    return sorted(((w, c, o, g) for (w, o), (c, g) in found.items()), key=lambda x: -x[3])


WORD = re.compile(r"[^\W\d_]+")
SCRIPTS = ("alL", "cC", "g", "kh")


def words_of(text: str) -> list[str]:
    """Words with a letter outside ASCII, in lower case."""
    return [w for w in WORD.findall(text.lower()) if not w.isascii()]


def mixed(word: str) -> bool:
    """Whether a word mixes scripts, as few real ones do."""
    kinds = {kind(c) for c in word}
    return sum(bool(kinds & set(s)) for s in SCRIPTS) > 1


def count_characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``(chunk, n)`` to sums per character and per pair of classes."""
    sums: dict[tuple[str, str], int] = {}
    for batch in batches:
        for chunk, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            last = "p"
            for c in chunk:
                k = kind(c)
                sums["pair", last + k] = sums.get(("pair", last + k), 0) + n
                last = k
                if c > "\x7f":
                    sums["char", c] = sums.get(("char", c), 0) + n
    rows = [(a, b, n) for (a, b), n in sums.items()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [(), (), ()], (pa.string(), pa.string(), pa.int64()))], names=["what", "key", "n"])


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(w, n) for chunk, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in words_of(chunk)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [(), ()], (pa.string(), pa.int64()))], names=["word", "n"])


def explain(chars: Characters):
    """Batches of ``(chunk, n)`` to one row per chunk, explanation and word (side 0: the chunk's, 1: the original's, -1: none)."""
    names = ["chunk", "written_in", "channel", "original", "gain", "side", "word", "share"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for chunk in batch.column(0).to_pylist():
                found = candidates(chunk, chars)
                if LOST in chunk:  # whatever becomes of the others
                    found.append(("lost", "bytes lost", chunk, 0.0))
                for written_in, channel, original, gain in found:
                    head = (chunk, written_in, channel, original, gain)
                    rows.append((*head, -1, None, 1.0))
                    rows += [(*head, side, w, 0.05 if mixed(w) else 1.0) for side, text in ((0, chunk), (1, original)) for w in words_of(text)]
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 8, kinds)], names=names)

    return run


def document_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Distinct ``(doc_id, chunk)`` of the chunks with characters outside ASCII."""
    whole = F.regexp_extract_all(F.col(text_col), F.lit(CHUNK), F.lit(0))
    found = F.array_distinct(F.transform(whole, lambda c: F.when(F.length(c) > LEAD_FROM, F.regexp_replace(c, LEAD, "")).otherwise(c)))
    return spread(docs.where(F.col(id_col).isNotNull() & F.col(text_col).rlike(r"[^\x00-\x7f]"))).select(F.col(id_col).cast("long").alias("doc_id"), F.explode(found).alias("chunk"))


def verdicts(chunks: DataFrame) -> DataFrame:
    """``(chunk, written_in, channel, original)`` of the garbled chunks among ``(doc_id, chunk)``; original keeps what is lost."""
    spark = chunks.sparkSession
    counted = cut(chunks.groupBy("chunk").agg(F.count("*").alias("n")))
    # One row per code point and per pair of classes: bounded by the character set, whatever the corpus.
    table = counted.mapInArrow(count_characters, "what string, key string, n long").groupBy("what", "key").agg(F.sum("n").alias("n")).collect()
    chars = Characters({r.key: r.n for r in table if r.what == "char"}, {r.key: r.n for r in table if r.what == "pair"})
    shared = spark.sparkContext.broadcast(chars)
    vocabulary = counted.mapInArrow(count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    schema = "chunk string, written_in string, channel string, original string, gain double, side int, word string, share double"
    # A chunk is little to move and much to judge: the number of tasks follows the number of chunks, not their bytes.
    tasks = max(spark.sparkContext.defaultParallelism, -(-counted.count() // CHUNKS_PER_TASK))
    spread = counted.repartition(tasks, "chunk").mapInArrow(lambda it: explain(shared.value)(it), schema)
    n = F.coalesce("n", F.lit(0))
    term = F.log(n * F.col("share") + 0.02)
    known = (F.col("side") == 1) & (F.length("word") >= WORD_LENGTH) & (n >= WORD_TEXTS)
    scored = (
        spread.join(vocabulary, "word", "left")
        .groupBy("chunk", "written_in", "channel", "original", "gain")
        .agg(
            F.sum(F.when(F.col("side") == 1, term).when(F.col("side") == 0, -term).otherwise(0.0)).alias("words"),
            F.sum(F.when(F.col("side") == 1, 1).when(F.col("side") == 0, -1).otherwise(0)).alias("more"),
            F.max(known.cast("int")).alias("known"),
        )
    )
    # Each word is measured against the number of chunks; the original has as many factors as words.
    total = float(max(1, counted.agg(F.sum("n")).first()[0] or 1))
    word_gain = F.col("words") - F.col("more") * log(total)
    need = F.when(F.col("written_in") == "lost", True)
    for written_in, gain in GAIN.items():
        need = need.when(F.col("written_in") == written_in, F.col("gain") >= gain)
    need = need.otherwise((word_gain >= WORD_GAIN) & (F.col("known") == 1))
    rank = F.struct((F.col("written_in") != "lost").alias("read"), (F.col("gain") + word_gain).alias("score"), "written_in", "channel", "original")
    return scored.where(need).groupBy("chunk").agg(F.max(rank).alias("_v")).select("chunk", "_v.written_in", "_v.channel", "_v.original")


def garbled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(doc_id, chunk, original, channel)`` of every garbled chunk, and the documents' chunks.

    Null and empty texts and texts of ASCII characters hold none; a null id takes no part; repeated
    rows are found once each; an empty table gives no rows. Whole texts are judged, header and body.
    """
    chunks = cut(document_chunks(docs, id_col, text_col))
    return chunks.join(verdicts(chunks), "chunk").select("doc_id", "chunk", "original", "channel").distinct(), chunks


def lost_words(fixes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Originals for chunks with lost characters: the commonest chunk of the corpus that agrees in all others.

    Each lost character stands for one character outside ASCII. Chunks are joined on what is left of them.
    """
    mask = lambda c: F.regexp_replace(c, r"[^\x00-\x7f]", LOST)
    whole = chunks.where(~F.col("chunk").contains(LOST)).groupBy("chunk").agg(F.count("*").alias("n")).groupBy(mask(F.col("chunk")).alias("mask")).agg(F.max(F.struct("n", "chunk")).alias("_b")).select("mask", F.col("_b.chunk").alias("guess"))
    return fixes.join(whole, mask(F.col("original")) == F.col("mask"), "left").select("doc_id", "chunk", F.when(F.col("original").contains(LOST), F.coalesce("guess", "original")).otherwise(F.col("original")).alias("original"), "channel")


def put_back(text: str, originals: dict[str, str]) -> str:
    """The text with its chunks, where they stand, replaced by their originals."""
    out, at = [], 0
    for m in chunk_pattern().finditer(text):
        piece, begin = m[0], m.start()
        if len(piece) > LEAD_FROM:
            short = lead_start().sub("", piece)
            begin += len(piece) - len(short)
            piece = short
        if piece in originals:
            out += [text[at:begin], originals[piece]]
            at = m.end()
    return "".join([*out, text[at:]])


@lru_cache(None)
def chunk_pattern():
    import regex

    return regex.compile(CHUNK)


@lru_cache(None)
def lead_start():
    return re.compile(LEAD)


def put_all_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``(doc_id, text, chunks, originals)`` to ``(doc_id, text)``."""
    for batch in batches:
        texts = [put_back(t, dict(zip(c, o))) if t else t for t, c, o in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def restored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` of the garbled documents with their chunks restored, each where it stands, as far as possible."""
    fixes, chunks = garbled(docs, id_col, text_col)
    own = lost_words(fixes, chunks).groupBy("doc_id").agg(F.collect_list(F.struct("chunk", "original")).alias("fixes"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = texts.join(own, "doc_id").select("doc_id", "text", F.col("fixes.chunk").alias("chunks"), F.col("fixes.original").alias("originals"))
    return rows.mapInArrow(put_all_back, "doc_id long, text string")
