"""Unigram pieces: Viterbi over a double-array trie of pieces with log scores, byte fallback, decoding.

The piece list is read from a public model file; nothing is trained. A text is escaped first
(one space in front, spaces become the marker), then cut where no piece can reach across: in
front of a marker that follows another character. Each distinct cut is solved once per worker
and kept in a bounded cache; the cuts still to be solved go through one vectorised Viterbi.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "▁"
NO_CUT = r"(?!)"
#: A character without a piece scores this much less than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Cuts that a worker remembers; beyond that it begins anew.
CACHE = 800_000
#: Characters solved at a time.
BLOCK = 1 << 19


@dataclass
class Model:
    """Double-array trie over dense character codes; terminal states carry a piece id."""

    codes: np.ndarray  # of code points below len(codes); 0: in no piece
    base: np.ndarray
    check: np.ndarray
    terminal: np.ndarray  # piece id or -1
    scores: np.ndarray
    byte_ids: np.ndarray  # of the 256 byte pieces
    pieces: list[bytes]  # what each id decodes to
    unknown: float
    longest: int
    cuts: str  # pattern of the positions no piece reaches across


def load_model(path: str) -> Model:
    """Pieces and scores of a model file with byte fallback, as a double-array trie."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    normal = [(sp.id_to_piece(i), i) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    bytes_ = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
    decoded = [b"" if sp.is_control(i) else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
    for value, i in bytes_.items():
        decoded[i] = bytes([value])
    return build_model(normal, np.array([sp.get_score(i) for i in range(n)]), np.array([bytes_[b] for b in range(256)], np.int32), decoded)


def build_model(normal: list[tuple[str, int]], scores: np.ndarray, byte_ids: np.ndarray, decoded: list[bytes]) -> Model:
    chars = sorted({c for p, _ in normal for c in p})
    codes = np.zeros(max(map(ord, chars), default=0) + 1, np.int32)
    codes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
    tree: dict = {}
    for piece, i in normal:
        node = tree
        for c in piece:
            node = node.setdefault(int(codes[ord(c)]), {})
        node[0] = i
    size = 8192 + 4 * (sum(len(p) for p, _ in normal) + len(chars))
    base, check, terminal = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    check[0], free = 0, 1
    todo = [(0, tree)]
    while todo:
        state, node = todo.pop()
        terminal[state] = node.get(0, -1)
        kids = np.array(sorted(k for k in node if k), np.int64)
        if not len(kids):
            continue
        at = _place(check, kids, free)
        while check[free] >= 0:
            free += 1
        base[state] = at
        check[at + kids] = state
        todo += [(at + int(k), node[int(k)]) for k in kids]
    used = int(np.flatnonzero(check >= 0)[-1]) + len(chars) + 2
    inner = any(MARK in p.lstrip(MARK) for p, _ in normal)
    ids = [i for _, i in normal]
    return Model(codes, base[:used], check[:used], terminal[:used], scores, byte_ids, decoded, float(scores[ids].min()) - UNKNOWN_PENALTY if ids else -UNKNOWN_PENALTY, max((len(p) for p, _ in normal), default=1), NO_CUT if inner else f"(?<=[^{MARK}])(?={MARK})")


def _place(check: np.ndarray, kids: np.ndarray, free: int) -> int:
    """Least offset from ``free`` on at which the slots of all ``kids`` are free."""
    first = max(1, free - int(kids[0]))
    while True:
        spot = np.arange(first, first + 4096)
        spot = spot[check[spot + kids[0]] < 0]
        for k in kids[1:]:
            spot = spot[check[spot + k] < 0]
        if len(spot):
            return int(spot[0])
        first += 4096


def viterbi(model: Model, texts: list[str]) -> list[bytes]:
    """Piece ids (little-endian, 32 bits) of each escaped text with the greatest sum of scores; of equal sums the longest last piece."""
    length = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate(([0], np.cumsum(length)))
    n = int(first[-1])
    point = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(point < len(model.codes), model.codes[np.minimum(point, len(model.codes) - 1)], 0)
    left = np.repeat(first[1:], length) - np.arange(n)  # characters up to the text's end
    at, state = np.arange(n), np.zeros(n, np.int64)
    starts, widths, ids = [], [], []
    single = np.zeros(n, bool)
    for d in range(model.longest):
        ok = left[at] > d
        at, state = at[ok], state[ok]
        c = code[at + d]
        nxt = model.base[state] + c
        ok = (c > 0) & (model.check[nxt] == state) & (nxt > 0)
        at, state = at[ok], nxt[ok].astype(np.int64)
        if not len(at):
            break
        hit = model.terminal[state] >= 0
        starts.append(at[hit])
        widths.append(np.full(int(hit.sum()), d + 1))
        ids.append(model.terminal[state[hit]])
        if d == 0:
            single[at[hit]] = True
    bare = np.flatnonzero(~single)
    start = np.concatenate([*starts, bare])
    width = np.concatenate([*widths, np.ones(len(bare), np.int64)])
    piece = np.concatenate([*ids, np.full(len(bare), -1)])
    gain = np.where(piece >= 0, model.scores[piece], model.unknown)
    # Edges by the place of their end inside the text, so that all texts advance together.
    base = np.repeat(first[:-1], length)
    end = start + width
    place = end - base[start]
    # Boundary positions: one more than characters in each text.
    shift = np.repeat(np.arange(len(texts)), length)
    source, target = start + shift[start], end + shift[start]
    order = np.lexsort((width, place))
    source, target, piece, gain, place = source[order], target[order], piece[order], gain[order], place[order]
    best = np.full(n + len(texts), -np.inf)
    best[first[:-1] + np.arange(len(texts))] = 0.0
    back = np.full(n + len(texts), -1, np.int64)
    steps = np.searchsorted(place, np.arange(1, int(length.max(initial=0)) + 2))
    for a, b in zip(steps[:-1], steps[1:], strict=True):
        if a == b:
            continue
        total = best[source[a:b]] + gain[a:b]
        np.maximum.at(best, target[a:b], total)
        won = np.flatnonzero(total == best[target[a:b]]) + a
        back[target[won]] = won
    here = first[1:] + np.arange(len(texts))
    origin = first[:-1] + np.arange(len(texts))
    live = np.flatnonzero(here > origin)
    trail: list[tuple[np.ndarray, np.ndarray]] = []
    while len(live):
        edge = back[here[live]]
        trail.append((live, edge))
        here[live] = source[edge]
        live = live[here[live] > origin[live]]
    if not trail:
        return [b""] * len(texts)
    owner, edge = (np.concatenate(x) for x in zip(*trail, strict=True))
    order = np.lexsort((source[edge], owner))
    owner, edge = owner[order], edge[order]
    ids = piece[edge]
    unknown = np.flatnonzero(ids < 0)
    if len(unknown):  # each goes as the bytes of its character
        chars = [chr(c).encode("utf-8", "surrogatepass") for c in point[source[edge[unknown]] - owner[unknown]].tolist()]
        size = np.ones(len(ids), np.int64)
        size[unknown] = [len(c) for c in chars]
        at = np.cumsum(size) - size
        spread = np.repeat(ids, size)
        spots = np.repeat(at[unknown], size[unknown]) + np.arange(int(size[unknown].sum())) - np.repeat(np.cumsum(size[unknown]) - size[unknown], size[unknown])
        spread[spots] = model.byte_ids[np.frombuffer(b"".join(chars), np.uint8)]
        ids, owner = spread, np.repeat(owner, size)
    raw = ids.astype("<u4").tobytes()
    ends = (4 * np.searchsorted(owner, np.arange(len(texts) + 1))).tolist()
    return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


class Encoder:
    """Encodes and decodes whole texts; remembers the cuts it has solved.

    Words between single spaces are known by their characters, the marker in front left out; a
    word after a line end (which no piece may contain) begins with that line end instead.
    """

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, bytes | None] = {}
        self.cut = re.compile(model.cuts)
        newline = ord("\n")
        self.plain = model.cuts != NO_CUT and (newline >= len(model.codes) or not model.codes[newline])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; an empty text has none."""
        if len(self.known) > CACHE:
            self.known = {}
        if not self.plain:
            return self._whole(texts)
        rows = [t.replace("\n", " \n").split(" ") for t in texts]
        self._learn(set().union(*rows).difference(self.known))
        look = self.known.__getitem__
        out: list[bytes | None] = []
        for row in rows:
            try:
                out.append(b"".join(map(look, row)))
            except TypeError:  # markers side by side
                out.append(None)
        odd = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(odd, self._whole([texts[i] for i in odd]), strict=True):
            out[i] = x
        return out

    def _learn(self, new: set[str]) -> None:
        self.known.update((x, None) for x in new if not x or x[-1] == MARK)
        block: list[str] = []
        size = 0
        for x in new:
            if x and x[-1] != MARK:
                block.append(x)
                size += len(x) + 1
                if size >= BLOCK:
                    self._solve(block)
                    block, size = [], 0
        self._solve(block)

    def _solve(self, block: list[str]) -> None:
        if block:
            self.known.update(zip(block, viterbi(self.model, [x if x[0] == "\n" else MARK + x for x in block]), strict=True))

    def _whole(self, texts: list[str]) -> list[bytes]:
        """Any texts: cut at the markers that follow another character."""
        rows = [self.cut.split(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        cuts = list({c for row in rows for c in row})
        solved: dict[str, bytes] = {}
        first, size = 0, 0
        for i, c in enumerate(cuts):
            size += len(c)
            if size >= BLOCK or i + 1 == len(cuts):
                part = cuts[first : i + 1]
                solved.update(zip(part, viterbi(self.model, part), strict=True))
                first, size = i + 1, 0
        return [b"".join(map(solved.__getitem__, row)) for row in rows]

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; bytes that aren't UTF-8 become U+FFFD."""
        text = b"".join([self.model.pieces[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_ENCODERS: dict[str, Encoder] = {}


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """All columns of ``docs`` and piece_ids array<int>, n_pieces long, decoded string.

    Whole texts are encoded and decoded again. A null or empty text has no pieces and decodes
    to an empty text. A marker character inside a text decodes to a space, as in every coder of
    this family; other texts come back unchanged. Clashing columns are replaced.
    """
    from pyspark.sql import types as T

    docs = docs.drop("piece_ids", "n_pieces", "decoded")
    shared, key = _broadcast(docs.sparkSession, model_path), model_path
    schema = T.StructType([*docs.schema.fields, T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("decoded", T.StringType())])

    def run(batches):
        coder = _ENCODERS.get(key) or _ENCODERS.setdefault(key, Encoder(shared.value))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").cast(pa.string()).to_pylist()]
            for a in range(0, len(texts), 512):
                part = batch.slice(a, 512)
                ids = [np.frombuffer(x, "<u4") for x in coder.encode_batch(texts[a : a + 512])]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32))),
                        pa.array(np.diff(ends).astype(np.int64)),
                        pa.array([coder.decode(x) for x in ids], pa.string()),
                    ],
                    [*part.schema.names, "piece_ids", "n_pieces", "decoded"],
                )

    return docs.mapInArrow(run, schema)


def _broadcast(spark: SparkSession, path: str):
    """The model; its size is that of the vocabulary, a few MB, and no table changes it."""
    return spark.sparkContext.broadcast(load_model(path))


def piece_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian 32-bit integers), decoded_sha256 and round_trip."""
    shared, key = _broadcast(docs.sparkSession, model_path), model_path

    def run(batches):
        coder = _ENCODERS.get(key) or _ENCODERS.setdefault(key, Encoder(shared.value))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a in range(0, len(texts), 512):
                part = texts[a : a + 512]
                raw = coder.encode_batch(part)
                decoded = [coder.decode(np.frombuffer(x, "<u4")) for x in raw]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, 512), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                        pa.array([hashlib.sha256(x.encode("utf-8", "replace")).hexdigest() for x in decoded], pa.string()), pa.array([x == t for x, t in zip(decoded, part, strict=True)], pa.bool_()),
                    ],
                    ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "round_trip"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
