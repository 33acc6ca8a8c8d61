"""Cost-balanced packing of token ids into sequences of fixed length.

A piece of n tokens costs ``linear * n + quadratic * n * n``. Full sequences are cut off long documents first; the remainders are handled in
blocks of bounded size inside each task: in descending length each goes to the lowest-cost sequence with enough remaining capacity, and what fits
nowhere whole is cut over the emptiest sequences. A block of t tokens gets ceil(t / length) sequences, so it pads less than one sequence.

Cases: a null or empty text is its end token alone; texts of any length are cut; repeated rows are packed like any others; ties go by order of
reading; an empty table gives no pieces; other columns are not read. Sequence numbers are unique over the data set, not gapless.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.llm.common import as_bytes, row_batches

LENGTH = 2048
END_ID = 1
BLOCK_TOKENS = 1 << 21
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
CACHED_CHUNKS = 600_000
LONGEST_CACHED = 64
# Fixed value: how the tokenizer's own file cuts text, white space apart.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class Bounded(dict):
    """Values made on demand, at most ``most`` of them kept. When it is full the half that came last goes: frequent keys come early and stay."""

    def __init__(self, most: int, make: Callable[[str], bytes]):
        super().__init__()
        self.most, self.make = max(2, most), make

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= LONGEST_CACHED:
            if len(self) >= self.most:
                first = list(islice(self.items(), self.most // 2))
                self.clear()
                self.update(first)
            self[key] = value
        return value


class ChunkEncoder:
    """Token ids as little-endian uint32 bytes, with bounded caches.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of its white-space separated chunks in order. It
    then cuts a lower-cased chunk into runs of letters, single digits and runs of marks, and encodes each alone; for chunks of Latin letters
    that cut is made here, so that case and punctuation do not make a word new.
    """

    def __init__(self, path: str, most: int = CACHED_CHUNKS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces, self.chunks = Bounded(most, self.plainly), Bounded(most, self.cut)

    def plainly(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def cut(self, chunk: str) -> bytes:
        latin = (chunk.isascii() or max(chunk) < "\u0250" and "\u0130" not in chunk) and "<|" not in chunk
        return b"".join(map(self.pieces.__getitem__, PIECES.findall(chunk.lower()))) if latin else self.plainly(chunk)

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))


def place(lengths: np.ndarray, length: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int]]:
    """(item, start, size, sequence) pieces for items no longer than ``length``; sequences 0 to ceil(total / length) - 1."""
    total = int(lengths.sum())
    n = -(-total // length)
    cost, room, out = np.zeros(n), np.full(n, length, np.int64), []

    def put(item: int, start: int, size: int, at: int) -> None:
        cost[at] += linear * size + quadratic * size * size
        room[at] -= size
        out.append((item, start, size, at))

    for item in np.argsort(-lengths, kind="stable"):
        size, start = int(lengths[item]), 0
        at = int(np.argmin(np.where(room >= size, cost, np.inf)))
        if room[at] >= size:
            put(int(item), 0, size, at)
            continue
        while start < size:
            at = int(np.argmax(room))
            part = min(size - start, int(room[at]))
            put(int(item), start, part, at)
            start += part
    return out


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One per worker, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    A narrow map: tokens are never shuffled. Each task holds one block of ids at a time, whatever its input.
    """
    end = np.array([end_id], "<u4").tobytes()
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        next_sequence = TaskContext.get().partitionId() << 33
        pieces: list[tuple] = []
        block: list[tuple] = []
        held = 0

        def emitted() -> pa.RecordBatch:
            columns = list(zip(*pieces, strict=True))
            kinds = [None, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            pieces.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k or key_type) for c, k in zip(columns, kinds, strict=True)], names)

        def flush() -> None:
            nonlocal next_sequence, held
            lengths = np.array([size for _, _, _, size, _ in block], np.int64)
            used: dict[int, int] = {}
            for item, start, size, at in place(lengths, length):
                doc_id, ids, base, _, whole = block[item]
                offset = used.get(at, 0)
                pieces.append((doc_id, base + start, size, ids[4 * start:4 * (start + size)], whole, next_sequence + at, offset))
                used[at] = offset + size
            next_sequence += -(-int(lengths.sum()) // length) if len(lengths) else 0
            block.clear()
            held = 0

        names = ["doc_id", *[f.split()[0] for f in SCHEMA.split(", ")]]
        for batch in row_batches(batches, 64):
            key_type = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text.decode("utf-8", "replace")) + end
                whole = len(ids) // 4
                start = whole - whole % length
                for at in range(0, start, length):
                    pieces.append((doc_id, at, length, ids[4 * at:4 * (at + length)], whole, next_sequence, 0))
                    next_sequence += 1
                if start < whole:
                    block.append((doc_id, ids[4 * start:], start, whole - start, whole))
                    held += whole - start
                if held >= block_tokens:
                    flush()
            if pieces:
                yield emitted()
        flush()
        if pieces:
            yield emitted()

    return docs.select("doc_id", as_bytes("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, {SCHEMA}")


def ids_crc32(ids: str = "ids") -> F.Column:
    return F.crc32(ids)
