"""SentencePiece encoding and decoding for merge-type (BPE) models with byte fallback.

Exact encoding without a merge queue, by backtracking: Aho-Corasick finds the longest piece at every
position; a piece may follow another only if re-merging the two pieces' text gives back just these two;
a dead end marks its position in a field of failed positions, takes back the last piece and tries its
next shorter prefix. A sequence whose neighbours are all compatible is the one that merging by score
gives, so the result is the library's.

Texts are cut first where no piece of the model reaches across: before the spaces that begin a word
and around line ends. Chunks repeat a lot, so their ids are kept in a bounded table.

The model's path is a parameter; the driver reads the file and broadcasts its bytes (half a megabyte for
32,000 pieces), and each Python worker makes its automaton once.

Scale: one pass over the documents, no shuffle. Memory is bounded by the tables' limits and a slice of
rows. Defined results: a null text counts as empty, and an empty text gives the begin and end ids alone;
ids of documents pass through unchanged, null ones too; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.runtime import ship_package

SPACE = "▁"
#: Entries that a worker keeps for chunks, and for pairs of pieces.
KEEP_CHUNKS, KEEP_PAIRS = 300_000, 1_000_000
ROWS = 256
#: Chunks longer than this are not kept.
KEEP_LENGTH = 64

_NORMAL, _CONTROL, _BYTE = 1, 3, 6


def _fields(blob: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = blob[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(blob):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else varint(at)
            value, at = blob[at : at + size], at + size
        yield key >> 3, value


class Model:
    """A merge-type SentencePiece model."""

    def __init__(self, source: str | bytes) -> None:
        """`source`: the model file's path or its bytes."""
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.begin, self.end, self.prefix = 1, 2, True
        squeeze, charsmap, model_type = True, b"", 1
        for number, value in _fields(read_bytes(source) if isinstance(source, str) else source):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, _NORMAL))
            elif number == 2:
                spec = dict(_fields(value))
                model_type, self.begin, self.end = spec.get(3, 1), spec.get(41, 1), spec.get(42, 2)
            elif number == 3:
                spec = dict(_fields(value))
                charsmap, self.prefix, squeeze = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if model_type != 2 or charsmap or squeeze:
            raise ValueError("only BPE models without normalisation rules are supported")
        if any(k not in (_NORMAL, 2, _CONTROL, _BYTE) for k in self.kinds):
            raise ValueError("user-defined pieces are not supported")
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == _NORMAL}
        self.bytes = [0] * 256
        for i, p in enumerate(self.pieces):
            if self.kinds[i] == _BYTE:
                self.bytes[int(p[3:5], 16)] = i
        if any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1) for p in self.ids):
            raise ValueError("pieces that reach across words are not supported")
        self._byte_of = {i: b for b, i in enumerate(self.bytes)}
        self._pairs: dict[int, bool] = {}
        self._chunks: dict[str, bytes] = {}
        self._texts: dict[str, str] = {}
        #: What ordinary pieces decode to.
        self._plain = {i: p.replace(SPACE, " ") for p, i in self.ids.items()}
        # Pieces that merging can reach; others never come out.
        self.live = {p: i for p, i in self.ids.items() if len(p) == 1 or self.merge(p) == [p]}
        self.size = {i: len(p) for p, i in self.live.items()}
        self.shorter = {i: next((self.live[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.live), -1) for p, i in self.live.items()}
        self.machine = ahocorasick.Automaton()
        for p, i in self.live.items():
            self.machine.add_word(p, (len(p), i))
        self.machine.make_automaton()

    def merge(self, text: str) -> list[str]:
        """The definition: join the neighbours whose piece has the highest score, leftmost first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fit(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a: re-merging their text gives the two again."""
        key = a << 20 | b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= KEEP_PAIRS:
                self._pairs.clear()
            p, q = self.pieces[a], self.pieces[b]
            known = self._pairs[key] = self.merge(p + q) == [p, q]
        return known

    def chunk_ids(self, text: str) -> list[int]:
        """The ids of a chunk in which a space stands at the beginning only, already as U+2581."""
        n = len(text)
        longest = [-1] * (n + 1)
        for end, (size, i) in self.machine.iter(text):
            longest[end - size + 1] = i  # ends grow, so the longest comes last
        failed = bytearray(n + 1)
        out: list[int] = []
        starts: list[int] = []  # where the pieces of `out` begin; -1: bytes, which nothing merges with
        at, size_of, shorter, fit, pairs = 0, self.size, self.shorter, self._fit, self._pairs
        bars = [0]  # positions that backtracking doesn't go behind
        token = longest[0] if n else -1
        while at < n:
            if token < 0 and longest[at] < 0:
                for byte in text[at].encode("utf-8", "surrogatepass"):
                    out.append(self.bytes[byte])
                    starts.append(-1)
                at += 1
                bars.append(at)
                token = longest[at]
                continue
            last = out[-1] if at > bars[-1] else -1
            while True:
                end = at + size_of[token]
                good = last < 0 or pairs.get(last << 20 | token)
                if good is None:
                    good = fit(last, token)
                if good and not failed[end]:
                    out.append(token)
                    starts.append(at)
                    at = end
                    token = longest[at]
                    break
                token = shorter[token]
                if token < 0:
                    if last < 0:
                        raise AssertionError("no encoding found")
                    failed[at] = 1
                    token, at = out.pop(), starts.pop()
                    break
        return out

    _cut = re.compile("\n| *[^ \n]+| +")

    def _made(self, chunk: str) -> tuple[bytes, str]:
        """A chunk's ids, packed, and the text that they decode to."""
        i = self.live.get(chunk.replace(" ", SPACE))
        ids = self.chunk_ids(chunk.replace(" ", SPACE)) if i is None else [i]
        packed = struct.pack(f"<{len(ids)}I", *ids)
        try:
            return packed, "".join([self._plain[i] for i in ids])
        except KeyError:  # byte pieces
            return packed, self._spelled(packed)

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """Ids with begin and end as little-endian 32-bit numbers, and the text decoded from them."""
        cut = self._cut.findall((" " if self.prefix else "") + text.replace(SPACE, " ")) if text else []
        chunks, texts = self._chunks, self._texts
        if len(chunks) > KEEP_CHUNKS:
            chunks.clear()
            texts.clear()
        long = {}
        for chunk in cut:
            if chunk in chunks or chunk in long:
                continue
            if len(chunk) <= KEEP_LENGTH:
                chunks[chunk], texts[chunk] = self._made(chunk)
            else:
                long[chunk] = self._made(chunk)
        if long:
            packed = [long[c][0] if c in long else chunks[c] for c in cut]
            decoded = "".join([long[c][1] if c in long else texts[c] for c in cut])
        else:
            packed, decoded = list(map(chunks.__getitem__, cut)), "".join(map(texts.__getitem__, cut))
        if self.prefix and decoded.startswith(" "):
            decoded = decoded[1:]
        return struct.pack("<I", self.begin) + b"".join(packed) + struct.pack("<I", self.end), decoded

    def _spelled(self, packed: bytes) -> str:
        """The text of ids, the begin's space included; bytes that are no UTF-8 become U+FFFD."""
        out: list[str] = []
        run = bytearray()
        for i in struct.unpack(f"<{len(packed) // 4}I", packed):
            byte = self._byte_of.get(i)
            if byte is not None:
                run.append(byte)
                continue
            if run:
                out.append(_utf8(run))
                run = bytearray()
            kind = self.kinds[i]
            out.append("" if kind == _CONTROL else " ⁇ " if kind == 2 else self.pieces[i].replace(SPACE, " "))
        if run:
            out.append(_utf8(run))
        return "".join(out)

    def decode(self, packed: bytes) -> str:
        """The library's decode(ids) for little-endian 32-bit ids."""
        text = self._spelled(packed)
        return text[1:] if self.prefix and text.startswith(" ") else text


def _utf8(run: bytearray) -> str:
    """One U+FFFD for each byte that begins no valid character."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for size in (1, 2, 3, 4):
                try:
                    out.append(bytes(run[at : at + size]).decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


_MADE: dict[tuple[type, bytes], object] = {}


def read_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def once[T](make: Callable[[bytes], T], blob: bytes) -> T:
    """What `make` makes of a model's bytes; the worker's one copy."""
    key = (make, hashlib.sha256(blob).digest())
    if key not in _MADE:
        _MADE[key] = make(blob)
    return _MADE[key]


def model(path: str) -> Model:
    return once(Model, read_bytes(path))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, ids (binary, little-endian unsigned 32-bit), decoded (string)."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_bytes(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = once(Model, shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                done = [m.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids binary, decoded string").withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of what `encode` returns."""
    return encoded.select(
        id_col,
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
