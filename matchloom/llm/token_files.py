"""Token-id files in Simple-8b: 64-bit words whose selector says how many ids of how many bits follow.

A file part is a Parquet table of frames (Spark's committer makes the write atomic and safe
to repeat); a frame is a self-contained binary block of whole documents in ascending doc_id
order::

    header   magic, version, words a block, documents, documents without id, ids, words of each stream
    offsets  for every block of BLOCK_WORDS words of the id stream, the ids before it (uint32); the high
             bit tells that the block's first word is raw and belongs to the block before
    streams  doc_id differences (zigzag), document lengths, token ids; Simple-8b words (uint64)

The four high bits of a word select (ids, bits). Selector 1 is 120 zeros, selector 0 an escape:
the next word is one raw 64-bit value. Offsets let any run of blocks be decoded on its own (``frame_ids``).
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchloom.llm.bytesops import BASE, row_bytes, slices, span_hashes

# Fixed values: (ids, bits) of selectors 1 to 15; selector 0 is the escape.
LAYOUT = ((120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
MAGIC, VERSION, BLOCK_WORDS = b"MLS8", 2, 128
HEADER = struct.Struct("<4sHHIIQIII")
#: A frame closes after the document with which it reaches so many ids.
FRAME_IDS = 1 << 16
#: Distinct text chunks of a generation; a worker remembers two, and takes from the older one what it meets again.
CACHE = 800_000
U = np.uint64


def pack(values: np.ndarray) -> np.ndarray:
    """Simple-8b words of unsigned 64-bit values; each word takes as many as fit."""
    values = np.ascontiguousarray(values, U)
    n = len(values)
    if not n:
        return np.zeros(0, U)
    # Index of the least layout width that holds each value.
    limits = [1 << bits for bits in (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)]
    top = int(values.max())
    small = values.astype(np.uint32) if top < 1 << 32 else values
    most = np.zeros(n, np.uint8)
    for limit in limits:
        if limit <= top:
            most += small >= small.dtype.type(limit)
    place = {bits: k for k, (_, bits) in enumerate(sorted(LAYOUT, key=lambda x: x[1]))}
    # A word of more ids of fewer bits fits only where one of fewer ids fits too, so the number
    # of layouts that fit tells the best one. Window maxima grow with the number of ids.
    fitting, at = np.zeros(n, np.uint8), 1
    for count, bits in reversed(LAYOUT):
        if count > n:
            break
        while at < count:
            step = min(count - at, at)
            np.maximum(most[: n - step], most[step:], out=most[: n - step])
            at += step
        fits = most[: n - count + 1] <= place[bits]
        if not fits.any():
            break
        fitting[: n - count + 1] += fits
    choice = np.where(fitting > 0, len(LAYOUT) + 1 - fitting.astype(np.int64), 0)
    counts = np.array([1, *(c for c, _ in LAYOUT)])
    steps, starts, i = counts[choice].tolist(), [], 0
    while i < n:
        starts.append(i)
        i += steps[i]
    start = np.array(starts)
    selector = choice[start]
    words = np.zeros(len(start), U)
    for k, (count, bits) in enumerate(LAYOUT, 1):
        own = np.flatnonzero(selector == k)
        if len(own):
            word = np.full(len(own), U(k << 60))
            if bits:
                for j in range(count):
                    word |= values[start[own] + j] << U(j * bits)
            words[own] = word
    raw = np.flatnonzero(selector == 0)
    return np.insert(words, raw + 1, values[start[raw]]) if len(raw) else words


def _counts(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values in each word, its selector, and whether it is the raw word of an escape."""
    selector = (words >> U(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(selector == 0).tolist():  # a raw word is no selector word, whatever its high bits say
        if not raw[i] and i + 1 < len(words):
            raw[i + 1] = True
    counts = np.array([0, *(c for c, _ in LAYOUT)])[selector]
    counts[raw] = 1
    return counts, selector, raw


def unpack(words: np.ndarray) -> np.ndarray:
    """The values of Simple-8b words, one vectorised step for each selector."""
    if not len(words):
        return np.zeros(0, U)
    counts, selector, raw = _counts(words)
    ends = np.cumsum(counts)
    starts = ends - counts
    out = np.zeros(int(ends[-1]), U)
    for k, (count, bits) in enumerate(LAYOUT, 1):
        own = np.flatnonzero((selector == k) & ~raw)
        if len(own) and bits:
            shift = (np.arange(count) * bits).astype(U)
            out[starts[own][:, None] + np.arange(count)] = (words[own][:, None] >> shift) & U((1 << bits) - 1)
    out[starts[raw]] = words[raw]
    return out


RAW_FIRST = np.uint32(1 << 31)


def block_offsets(words: np.ndarray) -> np.ndarray:
    """Ids before each block of BLOCK_WORDS words of a stream, with RAW_FIRST where an escape ends the block before.

    The raw word of such an escape counts as the block's before it, and so does its id.
    """
    counts, _, raw = _counts(words)
    before = np.concatenate(([0], np.cumsum(counts)))[: len(words)]
    first = np.arange(0, len(words), BLOCK_WORDS)
    return (before[first] + raw[first]).astype(np.uint32) | raw[first].astype(np.uint32) * RAW_FIRST


def unpack_blocks(words: np.ndarray, offsets: np.ndarray, first: int, last: int) -> np.ndarray:
    """Values of the blocks ``first`` to ``last`` - 1, from their own words only."""
    raw = (offsets & RAW_FIRST).astype(bool)
    end = last * BLOCK_WORDS + raw[last] if last < len(offsets) else len(words)
    return unpack(words[first * BLOCK_WORDS + raw[first] : end])


def frame(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """Binary frame of documents; those without doc_id come first."""
    nulls = sum(d is None for d in doc_ids)
    key = np.array([d for d in doc_ids if d is not None], np.int64)
    delta = np.diff(key, prepend=np.int64(0))
    zigzag = (delta.astype(U) << U(1)) ^ (delta >> np.int64(63)).astype(U)
    lengths = np.array([len(x) for x in ids], U)
    tokens = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    streams = [pack(zigzag), pack(lengths), pack(tokens)]
    head = HEADER.pack(MAGIC, VERSION, BLOCK_WORDS, len(ids), nulls, len(tokens), *map(len, streams))
    return head + block_offsets(streams[2]).astype("<u4").tobytes() + b"".join(s.astype("<u8").tobytes() for s in streams)


def _open_frame(data: bytes):
    """Documents without id, number of ids, block offsets and the words of each stream."""
    magic, version, block, _, nulls, n_ids, *sizes = HEADER.unpack_from(data)
    if magic != MAGIC or version != VERSION or block != BLOCK_WORDS:
        raise ValueError("not a token-id frame of this version")
    blocks = -(-sizes[2] // block)
    offsets, at, streams = np.frombuffer(data, "<u4", blocks, HEADER.size), HEADER.size + 4 * blocks, []
    for size in sizes:
        streams.append(np.frombuffer(data, "<u8", size, at))
        at += 8 * size
    return nulls, n_ids, offsets, streams


def read_frame(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, document lengths and all token ids of a frame."""
    nulls, n_ids, _, streams = _open_frame(data)
    zigzag, lengths, tokens = (unpack(s.astype(U)) for s in streams)
    delta = ((zigzag >> U(1)) ^ (U(0) - (zigzag & U(1)))).view(np.int64)
    if len(tokens) != n_ids:
        raise ValueError("frame is damaged: number of ids")
    return [*[None] * nulls, *np.cumsum(delta).tolist()], lengths.astype(np.int64), tokens


def frame_ids(data: bytes, start: int, stop: int) -> np.ndarray:
    """Token ids ``start`` to ``stop`` - 1 of a frame; only the blocks that hold them are decoded."""
    _, n_ids, offsets, streams = _open_frame(data)
    start, stop = max(0, start), min(stop, n_ids)
    if start >= stop:
        return np.zeros(0, U)
    before = (offsets & ~RAW_FIRST).astype(np.int64)
    first, last = np.searchsorted(before, start, "right") - 1, np.searchsorted(before, stop, "left")
    got = unpack_blocks(streams[2], offsets, int(first), int(last)).astype(U)
    return got[start - before[first] : stop - before[first]]


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of the runs (start, size), one after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class ChunkStore:
    """Known chunks: bytes and ids in flat pools, found by hash and compared byte by byte."""

    def __init__(self):
        self.hash, self.at = np.zeros(0, U), np.zeros(0, np.int32)  # in order of the hashes
        self.bytes, self.ids = np.zeros(0, np.uint8), np.zeros(0, "<u4")
        # Starts and sizes in the two pools; ``kind`` 1 is a run of marks, 2 and 3 mean that the chunk has white space.
        self.byte_at, self.id_at = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.size, self.count, self.kind = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int8)

    def find(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Number of each chunk, -1 where it is not known."""
        if not len(self.hash):
            return np.full(len(hashes), -1)
        k = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        got = self.at[k].astype(np.int64)
        rows = np.flatnonzero((self.hash[k] == hashes) & (self.size[got] == size) & (self.kind[got] & 1 == kind))
        other = data[_ragged(start[rows], size[rows])] != self.bytes[_ragged(self.byte_at[got[rows]], size[rows])]
        out = np.full(len(hashes), -1)
        out[rows] = got[rows]
        if other.any():
            out[rows[np.repeat(np.arange(len(rows)), size[rows])[other]]] = -1
        return out

    def add(self, hashes, raw, size, ids, count, kind) -> np.ndarray:
        """Append chunks given by pools in their order; returns their numbers."""
        first = len(self.size)
        self.byte_at = np.append(self.byte_at, len(self.bytes) + np.cumsum(size) - size)
        self.id_at = np.append(self.id_at, len(self.ids) + np.cumsum(count) - count)
        self.bytes, self.ids = np.append(self.bytes, raw), np.append(self.ids, ids)
        self.size, self.count = np.append(self.size, size.astype(np.int32)), np.append(self.count, count.astype(np.int32))
        self.kind = np.append(self.kind, kind.astype(np.int8))
        numbers = np.arange(first, len(self.size))
        order = np.argsort(hashes)
        place = np.searchsorted(self.hash, hashes[order])
        self.hash, self.at = np.insert(self.hash, place, hashes[order]), np.insert(self.at, place, numbers[order].astype(np.int32))
        return numbers

    def copied(self, other: ChunkStore, hashes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Append chunks of another store."""
        size, count = other.size[numbers].astype(np.int64), other.count[numbers].astype(np.int64)
        raw, ids = other.bytes[_ragged(other.byte_at[numbers], size)], other.ids[_ragged(other.id_at[numbers], count)]
        return self.add(hashes, raw, size, ids, count, other.kind[numbers])


class ChunkEncoder:
    """The tokenizers library over whole texts, each distinct chunk once.

    The pre-tokenizer never joins a character that isn't white space with the space or line end
    after it, nor a single line end with what follows, so a text cut in front of such spaces and
    line ends has the same ids as its chunks one after the other. A chunk is known by its
    characters, a leading space left out; a text with runs of white space is cut by ``CUT`` instead.
    Nor does it join a letter with a mark after it (but for an apostrophe), so the marks after a chunk of letters
    are a chunk of their own, without the space.
    """

    CUT = re.compile(r"(?<=\S)(?= )")
    GROUP = 256
    # ASCII marks without the apostrophe; ASCII letters.
    MARK = np.array([33 <= k < 127 and not chr(k).isalnum() and k != 39 for k in range(256)])
    LETTER = np.array([k < 128 and chr(k).isalpha() for k in range(256)])

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known, self.older = ChunkStore(), ChunkStore()
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        # Byte-level names of a space and a line end: with one of them every chunk begins, and no other token of it.
        self.begins = np.array([t[:1] in ("\u0120", "\u010a") for t in names])

    def _bytes(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _spans(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        """Starts, ends and kinds of the chunks with their marks parted, and the number of the first span of each chunk."""
        cut = end.copy()
        look = np.flatnonzero(start < end)
        while len(look):
            look = look[self.MARK[data[cut[look] - 1]]]
            cut[look] -= 1
            look = look[cut[look] > start[look]]
        # U+00C0 to U+00FF in UTF-8, without the two signs among them, are letters too.
        lead = data[:-1] == 0xC3
        tail = lead & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        letter = self.LETTER[data]
        letter[:-1] |= tail
        letter[1:] |= tail
        other = np.concatenate(([0], np.cumsum(~letter)))
        word = start + (data[np.minimum(start, len(data) - 1)] == 10)
        parted = (cut < end) & (cut > word) & (other[cut] == other[np.minimum(word, cut)])
        cut = np.where(parted, cut, end)
        first = np.arange(len(start)) + np.cumsum(parted) - parted
        n = len(start) + int(parted.sum())
        starts, ends, kind = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int8)
        starts[first], ends[first] = start, cut
        marks = first[parted] + 1
        starts[marks], ends[marks], kind[marks] = cut[parted], end[parted], 1
        return starts, ends, kind, np.append(first, n)

    def encode_batch(self, texts: list[str], end_id: int | None = None) -> list[np.ndarray]:
        """Ids (uint32) of each text, with ``end_id`` after them if given.

        Chunks are told apart by 64-bit hashes inside the batch and by all their bytes beyond it; ids are
        gathered from those of the distinct chunks.
        """
        if not texts:
            return []
        if len(self.known.size) > CACHE:
            self.known, self.older = ChunkStore(), self.known
        # A line end in front of each text makes its first chunk one like the others; its id is dropped again.
        parts = [("\n" + t).encode() for t in texts]
        data = np.frombuffer(b"".join(parts), np.uint8)
        row_start = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        line, gap = data == 10, data == 32
        start = np.flatnonzero(line | np.concatenate(([False], gap[:-1])))
        end = np.concatenate((start[1:], [len(data)]))
        end = np.maximum(start, end - gap[end - 1])  # may be empty: two spaces, a space before a line end
        blank = np.flatnonzero(gap[row_start[1:] - 1])  # a space at the end of a text
        starts, ends, kind, span_of = self._spans(data, start, end)
        hashes, first, which = np.unique(span_hashes(data, starts, ends) ^ (kind.astype(U) * BASE), return_index=True, return_inverse=True)
        starts, size, kind = starts[first], (ends - starts)[first], kind[first]
        number = self.known.find(hashes, data, starts, size, kind)
        new = np.flatnonzero(number < 0)
        if len(new):
            old = self.older.find(hashes[new], data, starts[new], size[new], kind[new])
            again = old >= 0
            if again.any():
                number[new[again]] = self.known.copied(self.older, hashes[new[again]], old[again])
            new = new[~again]
            raw = data[_ragged(starts[new], size[new])]
            text, stops = raw.tobytes(), np.cumsum(size[new]).tolist()
            names = [text[a:b].decode() for a, b in zip([0, *stops], stops, strict=False)]
            ids, count, odd = self._learn(names, kind[new])
            number[new] = self.known.add(hashes[new], raw, size[new], ids, count, kind[new] + 2 * odd)
        count = self.known.count[number].astype(np.int64)[which]
        stops = np.cumsum(count)
        ids = np.append(self.known.ids[_ragged(self.known.id_at[number][which], count)], np.zeros(1, np.uint32))
        at = np.concatenate(([0], stops))[span_of[np.searchsorted(start, row_start)]]
        more = end_id is not None
        if more:  # takes the place of the next text's line end
            ids[at[1:]] = end_id
        out = [ids[a + 1 : b + more] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        odd = np.flatnonzero((self.known.kind[number] > 1)[which])
        rows = np.searchsorted(row_start, start[np.searchsorted(span_of, odd, "right") - 1], "right") - 1
        for k in np.unique(np.concatenate((rows, blank))).tolist():  # runs of white space
            got = b"".join(self._bytes(c) for c in self.CUT.split(texts[k])) if texts[k] else b""
            out[k] = np.append(np.frombuffer(got, "<u4"), np.array([end_id] * more, np.uint32))
        return out

    def _learn(self, names: list[str], kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pool of ids, number of ids of each name, and whether the name has white space that keeps it from having ids of its own."""
        out: list[bytes] = [b""] * len(names)
        odd = np.zeros(len(names), np.int8)
        todo = []
        for i, (x, marks) in enumerate(zip(names, kind.tolist(), strict=True)):
            if marks:
                out[i] = self._bytes(x)
            elif not x or x[-1].isspace() or (x[0] == "\n" and x[1].isspace()):
                odd[i] = 1
            else:
                todo.append(i)
        whole = [x if x[:1] == "\n" else " " + x for x in names]
        groups = [todo[a : a + self.GROUP] for a in range(0, len(todo), self.GROUP)]
        joined = ["".join([whole[i] for i in g]) for g in groups]
        for group, got in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(got.ids, "<u4")
            first = np.flatnonzero(self.begins[ids])
            if len(first) == len(group):
                raw, ends = ids.tobytes(), [*(4 * first).tolist(), 4 * len(ids)]
                for i, a, b in zip(group, ends, ends[1:], strict=False):
                    out[i] = raw[a:b]
            else:
                for i in group:
                    out[i] = self._bytes(whole[i])
        return np.frombuffer(b"".join(out), "<u4"), np.array([len(x) // 4 for x in out], np.int64), odd


_ENCODERS: dict[str, ChunkEncoder] = {}


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2) -> None:
    """Encode every whole text (null: empty), append ``end_id`` and write frames to ``folder``.

    Documents go in ascending doc_id order (rows without doc_id first; rows that repeat a
    doc_id by the hash of their text, then text). ``folder`` must not exist. An empty table
    writes no frame. Other columns are not read.
    """

    def run(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        coder = _ENCODERS.get(tokenizer_path) or _ENCODERS.setdefault(tokenizer_path, ChunkEncoder(tokenizer_path))
        keys: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def flush():
            nonlocal number, size
            row = {"part": [part], "frame": [number], "n_docs": [len(keys)], "n_ids": [size], "data": [frame(keys, held)]}
            number, size = number + 1, 0
            keys.clear()
            held.clear()
            return pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("frame", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())]))

        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in slices(row_bytes(batch.column("text"))[1]):
                for key, got in zip(ids[a:b], coder.encode_batch([t or "" for t in texts[a:b]], end_id), strict=True):
                    keys.append(key)
                    held.append(got)
                    size += len(got)
                    if size >= FRAME_IDS:
                        yield flush()
        if keys:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    ordered.mapInArrow(run, "part int, frame int, n_docs long, n_ids long, data binary").write.parquet(folder)


def read_token_files(spark, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document in ``folder``."""
    frames = spark.read.schema("part int, frame int, n_docs long, n_ids long, data binary").parquet(folder)

    def run(batches):
        for batch in batches:
            for part, number, data in zip(*(batch.column(c).to_pylist() for c in ("part", "frame", "data")), strict=True):
                keys, lengths, ids = read_frame(data)
                raw = ids.astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(keys), pa.int32()), pa.array([number] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                    ["part", "frame", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    docs = frames.select("part", "frame", "data").mapInArrow(run, "part int, frame int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    # Ids before each part (one row a part), then before each frame of its part.
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = frames.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).withColumn("base", before(W.orderBy("part"))).select("part", "base")
    inner = frames.select("part", "frame", before(W.partitionBy("part").orderBy("frame")).alias("offset"))
    places = inner.join(parts, "part").select("part", "frame", (F.col("base") + F.col("offset")).alias("base"))
    return docs.join(places, ["part", "frame"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def read_token_ids(spark, folder: str) -> DataFrame:
    """doc_id and ids array<long> of every document in ``folder``."""

    def run(batches):
        for batch in batches:
            for data in batch.column("data").to_pylist():
                keys, lengths, ids = read_frame(data)
                ends = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int64)))], ["doc_id", "ids"])

    return spark.read.schema("data binary").parquet(folder).mapInArrow(run, "doc_id long, ids array<long>")
