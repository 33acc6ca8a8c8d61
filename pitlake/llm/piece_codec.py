"""Encoding and decoding with merge-type piece vocabularies, each Arrow batch checked against the sentencepiece library.

Encoding starts from single characters. All adjacent pairs that are pieces wait in an agenda ordered by score (higher first, then further left); the
best pair is joined, its new neighbours enter the agenda, and pairs whose halves have changed since are passed over. Characters that are no piece
become their UTF-8 bytes. Two neighbouring characters that no piece holds side by side are never joined, so a text is cut there first; every island
has its own agenda, and the ids of frequent words are kept in a bounded table.

Cases: a null or empty text is the end id alone and decodes to the empty text; texts of any length are read whole; a literal U+2581 is a space, as in
the library; malformed UTF-8 is read with U+FFFD in its place; repeated rows are coded like any others, null ids too; an empty table gives no rows;
other columns are not read. A vocabulary that needs more than this (another model type or normalisation, user-defined or unused pieces) is refused.

Checks are on by default and fail the job, naming the documents. A word is checked against the library in the Arrow batch that codes it first: as words
are cut where the vocabulary can join nothing, a document's ids are those of its words. ``check="documents"`` has the library encode whole documents
instead. Decoded documents are compared whole with what the library makes of the same ids.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.llm.common import as_bytes, row_batches

SPACE = "▁"
CACHED_WORDS = 800_000
BATCH_ROWS = 64
# Fixed values of the file format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MERGE_MODEL = 2
LETTER = regex.compile(r"\p{L}")
WORDS = regex.compile(rf"{SPACE}*\p{{L}}+|{SPACE}*[^{SPACE}\p{{L}}]+|{SPACE}+")
LONG_WORD, LONG_ISLAND = 64, 32
NEVER = float("-inf")


class Recent(dict):
    """Values made on demand. The last ``most / 2`` keys asked for, and those of the round before that were asked for again, are kept."""

    def __init__(self, most: int, make: Callable[[str], bytes]):
        super().__init__()
        self.half, self.make, self.older = max(1, most // 2), make, {}

    def __missing__(self, key: str) -> bytes:
        if (value := self.older.get(key)) is None:
            value = self.make(key)
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class PieceCodec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules = model.normalizer_spec
        if model.trainer_spec.model_type != MERGE_MODEL:
            raise ValueError(f"{path}: not a merge-type vocabulary")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: its normalisation is not supported")
        if others := {p.type for p in model.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path}: pieces of kinds {sorted(others)} are not supported")
        self.library = SentencePieceProcessor(model_file=path)
        self.prefixed = rules.add_dummy_prefix
        self.end_id, self.unknown_id = self.library.eos_id(), self.library.unk_id()
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.kinds = [p.type for p in model.pieces]
        self.plain = np.array([k in (NORMAL, BYTE) for k in self.kinds])
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.fallback = bool(model.trainer_spec.byte_fallback) and len(self.byte_ids) == 256
        self.joined = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.words_are_apart = not any(a != SPACE and (b == SPACE or bool(LETTER.match(a)) != bool(LETTER.match(b))) for a, b in self.joined)
        self.surface = [self.surface_of(i, p.piece, model.trainer_spec.unk_surface) for i, p in enumerate(model.pieces)]
        # A character that nothing joins with opens the text when the library is asked for a word alone.
        self.opening = "" if any("\n" in pair for pair in self.joined) or not self.words_are_apart else "\n"
        self.opening_ids = self.library.encode(self.opening)
        self.fresh: list[tuple[str, bytes]] = []
        self.words = Recent(cached, self.word_ids)

    def surface_of(self, at: int, piece: str, unknown: str) -> bytes:
        kind = self.kinds[at]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return b"" if kind == CONTROL else (unknown if kind == UNKNOWN else piece.replace(SPACE, " ")).encode()

    # --- encoding ------------------------------------------------------------------------------------------------------------------

    def islands(self, word: str) -> Iterator[str]:
        """The word cut between characters that no piece holds side by side."""
        start = 0
        for i in range(1, len(word)):
            if word[i - 1:i + 1] not in self.joined:
                yield word[start:i]
                start = i
        yield word[start:]

    def merged_short(self, island: str) -> list[str]:
        """As :meth:`merged`; the agenda of a short island is the list of its pairs' scores, and the best and leftmost is looked for."""
        score_of = self.scores.get
        parts = list(island)
        agenda = [score_of(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while agenda and (best := max(agenda)) > NEVER:
            i = agenda.index(best)
            whole = parts[i] + parts.pop(i + 1)
            parts[i] = whole
            del agenda[i]
            if i < len(agenda):
                agenda[i] = score_of(whole + parts[i + 1], NEVER)
            if i:
                agenda[i - 1] = score_of(parts[i - 1] + whole, NEVER)
        return parts

    def merged(self, island: str) -> list[str]:
        """Pieces of an island by its agenda of adjacent pairs."""
        score_of = self.scores.get
        parts = list(island)
        last = len(parts) - 1
        before, after = list(range(-1, last)), list(range(1, last + 2))
        agenda = [(-score, i, i + 1, 2) for i, pair in enumerate(zip(parts, parts[1:])) if (score := score_of(pair[0] + pair[1])) is not None]
        heapify(agenda)
        while agenda:
            _, left, right, size = heappop(agenda)
            whole = parts[left] + parts[right]
            if len(whole) != size or not parts[left] or not parts[right]:
                continue
            parts[left], parts[right] = whole, ""
            after[left] = following = after[right]
            if following <= last:
                before[following] = left
                if (score := score_of(pair := whole + parts[following])) is not None:
                    heappush(agenda, (-score, left, following, len(pair)))
            if (leading := before[left]) >= 0 and (score := score_of(pair := parts[leading] + whole)) is not None:
                heappush(agenda, (-score, leading, left, len(pair)))
        return [p for p in parts if p]

    def fallback_ids(self, piece: str) -> list[int]:
        return [self.byte_ids[b] for b in piece.encode()] if self.fallback else [self.unknown_id]

    def word_ids(self, word: str) -> bytes:
        found: list[int] = []
        id_of = self.ids.get
        for island in self.islands(word) if len(word) > LONG_WORD else (word,):
            pieces = self.merged_short(island) if len(island) <= LONG_ISLAND else self.merged(island)
            known = [id_of(p) for p in pieces]
            if None in known:
                for piece, at in zip(pieces, known, strict=True):
                    found += self.fallback_ids(piece) if at is None else [at]
            else:
                found += known
        coded = array("i", found).tobytes()
        self.fresh.append((word, coded))
        return coded

    def unlike_the_library(self) -> list[str]:
        """Words coded since the last call that the library codes otherwise."""
        fresh, skip = self.fresh, len(self.opening_ids)
        self.fresh = []
        known = self.library.encode([self.opening + word for word, _ in fresh], num_threads=1) if fresh else []
        return [word for (word, coded), ids in zip(fresh, known, strict=True) if array("i", ids[skip:]).tobytes() != coded]

    def encode(self, text: str) -> bytes:
        """Little-endian int32 ids of the text, without an end id."""
        if not text:
            return b""
        escaped = (SPACE if self.prefixed else "") + text.replace(" ", SPACE)
        if not self.words_are_apart:
            return self.word_ids(escaped)
        return b"".join(map(self.words.__getitem__, WORDS.findall(escaped)))

    # --- decoding ------------------------------------------------------------------------------------------------------------------

    def regular(self, ids: np.ndarray) -> bool:
        """Only normal and byte pieces before the last id, which may be a control."""
        return len(ids) > 0 and bool(self.plain[ids[:-1]].all()) and self.kinds[ids[-1]] != UNKNOWN

    def decode(self, ids: Sequence[int], regular: bool = False) -> str:
        """The text of the ids. The prefix space goes, runs of byte pieces are read as UTF-8, each byte that fits nowhere is U+FFFD."""
        kinds, surface = self.kinds, self.surface
        if regular:
            whole = b"".join(map(surface.__getitem__, ids))
            try:
                return (whole.removeprefix(b" ") if self.prefixed and kinds[ids[0]] == NORMAL else whole).decode()
            except UnicodeDecodeError:  # some byte pieces are no character
                pass
        out: list[bytes] = []
        raw = bytearray()
        leading = self.prefixed
        for i in ids:
            if kinds[i] == BYTE:
                raw += surface[i]
                leading = False
                continue
            if raw:
                out.append(readable(raw))
                raw.clear()
            piece = surface[i]
            if leading and piece:
                piece, leading = piece.removeprefix(b" ") if kinds[i] == NORMAL else piece, False
            out.append(piece)
        out.append(readable(raw))
        return b"".join(out).decode()


def readable(raw: bytes | bytearray) -> bytes:
    """Valid UTF-8 as it is; in place of each byte that begins no valid character, U+FFFD."""
    try:
        raw.decode()
        return bytes(raw)
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at:at + size].decode().encode())
            except UnicodeDecodeError:
                continue
            at += size
            break
        else:
            out.append("�".encode())
            at += 1
    return b"".join(out)


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One per worker, kept between tasks."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def differing(keys: Sequence[object], ours: Iterable[object], theirs: Iterable[object]) -> list[object]:
    return [k for k, a, b in zip(keys, ours, theirs, strict=True) if a != b]


def encode(docs: DataFrame, model_path: str, end: bool = True, check: str | None = "words") -> DataFrame:
    """doc_id and ids (array<int>) of every document; ``end`` appends the vocabulary's end id. ``check``: words, documents or None."""
    key = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model_path)
        coder.fresh.clear()
        tail = np.array([coder.end_id] if end else [], "<i4").tobytes()
        for batch in row_batches(batches, BATCH_ROWS):
            texts = [t.decode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            coded = [np.frombuffer(coder.encode(t) + tail, "<i4") for t in texts]
            if check == "words" and coder.opening:
                if wrong := coder.unlike_the_library():
                    raise ValueError(f"ids of {wrong} differ from the library's, in documents of {batch.column(0).to_pylist()}")
            elif check:
                known = coder.library.encode(texts, num_threads=1, add_eos=end)
                if differ := differing(batch.column(0).to_pylist(), [c.tolist() for c in coded], known):
                    raise ValueError(f"ids differ from the library's in documents {differ}")
            coder.fresh.clear()
            ends = np.cumsum([0] + [len(c) for c in coded], dtype=np.int64)
            flat = np.concatenate(coded) if coded else np.empty(0, "<i4")
            lists = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    return docs.select("doc_id", as_bytes("text")).mapInArrow(run, f"doc_id {key.simpleString()}, ids array<int>")


def decode(coded: DataFrame, model_path: str, check: bool = True) -> DataFrame:
    """doc_id, ids and their text for rows of (doc_id, ids); null ids are no ids. Ids outside the vocabulary fail."""
    key = coded.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model_path)
        for batch in row_batches(batches, BATCH_ROWS):
            arrays = [np.asarray(ids.values) if ids.is_valid else np.empty(0, np.int32) for ids in batch.column(1)]
            lists = [a.tolist() for a in arrays]
            texts = [coder.decode(ids, coder.regular(a)) for ids, a in zip(lists, arrays, strict=True)]
            if check and lists and (wrong := differing(batch.column(0).to_pylist(), texts, coder.library.decode(lists, num_threads=1))):
                raise ValueError(f"texts differ from the library's in documents {wrong}")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, f"doc_id {key.simpleString()}, ids array<int>, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by a space) and decoded_sha256 of decoded rows."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
