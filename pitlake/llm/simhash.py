"""SimHash near-dedup by tiled exact comparison.

Fingerprints are grouped into tiles of equal segment population counts. Two fingerprints within the radius have segment counts that differ by no
more than the radius in sum, so all other tile pairs are skipped; the rest are compared whole with numpy exclusive-or and bit counts.

Cases: a null or wordless text has fingerprint zero and is linked like any other; a text of one or two words is one shingle. Equal fingerprints
are one point, however many documents share them. A null doc_id takes part but is never a component's name unless all are null. Repeated rows get
equal results. Empty tables give empty results, other columns are carried through.

``near_dedup`` is the form for filtering a corpus: it links texts that share at least 0.8 of their distinct five-word shingles, and keeps one row per
group: the smallest doc_id, of rows that share it the first in the written row order. Fingerprints of 512 bits only name the candidates, with a limit four
deviations above the distance that similarity gives; each link is then decided by the exact share of common shingle hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.llm.common import as_bytes, fresh, numbered, row_batches
from pitlake.session import stage

RADIUS = 2
SHINGLE = 3
SEED = 42
TILE_ROWS = 1024
FIELD_BITS = 5  # room for a segment's population count in a tile's key


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False)) if len(words) > shingle else iter([b" ".join(words)])
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, 65536):
        part = hashes[start:start + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(rows: DataFrame) -> DataFrame:
    """``fp`` (the fingerprint's bits as a long) beside every other column; the texts themselves go no further."""
    others = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches):
            found = np.array([fingerprint(t) for t in batch.column(len(others)).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], [*others, "fp"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.select(*others, as_bytes("text")).mapInArrow(run, f"{kinds}, fp long")


def hex_fingerprint(fp: str) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def segments_for(points: int) -> int:
    """Finer tiles for more points: about TILE_ROWS points in the fullest tile, none skipped wrongly at any choice."""
    return 4 if points < 4_000_000 else 8


def tile_key(segments: int) -> F.Column:
    width = 64 // segments
    mask = (1 << width) - 1
    key = F.lit(0).cast("long")
    for i in range(segments):
        count = F.bit_count(F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit(mask).cast("long"))).cast("long")
        key = key + F.shiftleft(count, i * FIELD_BITS)
    return key


def half_neighbours(segments: int, radius: int) -> list[int]:
    """Key differences of tiles within the radius, one of each opposite pair, first the tile itself."""
    near, out = range(-radius, radius + 1), []

    def grow(prefix: tuple[int, ...], left: int) -> None:
        if len(prefix) == segments:
            out.append(prefix)
            return
        for d in near:
            if abs(d) <= left:
                grow((*prefix, d), left - abs(d))

    grow((), radius)
    zero = (0,) * segments
    return [sum(d << (i * FIELD_BITS) for i, d in enumerate(v)) for v in sorted(v for v in out if v >= zero)]


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same connections with fewer links: every linked point to the smallest one reachable here."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a):]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    off = label != np.arange(len(ids))
    return ids[off], ids[label[off]]


def tile_links(radius: int):
    def listed(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        return column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()  # bits of signed numbers are counted without sign

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (left, lo), (right, ro), found = listed(batch.column(0)), listed(batch.column(1)), []
            for i in range(batch.num_rows):
                a, b = left[lo[i]:lo[i + 1]], right[ro[i]:ro[i + 1]]
                x, y = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
                x, y = a[x], b[y]
                x, y = x[x != y], y[x != y]
                if len(x):
                    found.append(spanning(x, y))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in zip(*found, strict=True)], ["u", "v"])

    return run


def links(points: DataFrame, n: int, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (u, v), u > v, that connect what lies within the radius. ``points``: distinct fp values, ``n`` of them."""
    segments = segments_for(n)
    keyed = points.select("fp", tile_key(segments).alias("key"))
    sizes = keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / tile_rows).alias("parts"))
    tiles = keyed.join(sizes, "key").groupBy("key", F.pmod(F.xxhash64("fp"), "parts").alias("part")).agg(F.collect_list("fp").alias("fps"))
    tiles = stage(tiles, "tiles")
    steps = F.array(*[F.lit(d).cast("long") for d in half_neighbours(segments, radius)])
    left = tiles.select(F.col("fps").alias("a"), F.col("key").alias("own"), F.col("part").alias("at"), F.explode(steps).alias("step"))
    right = tiles.select(F.col("fps").alias("b"), "key", "part")
    pairs = left.join(right, F.col("own") + F.col("step") == F.col("key")).where("step <> 0 or at <= part").select("a", "b")
    return pairs.mapInArrow(tile_links(radius), "u long, v long")


def stars(edges: DataFrame) -> DataFrame:
    """Connected components: (u, v) rows, each linked point to the smallest of its component (alternating large and small stars)."""
    edges = stage(edges.distinct(), "links")
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges
        before = now
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = stage(large.where("u <> v"), "large")
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).union(low.select("u", "low"))
        edges = stage(small.where("u <> v").distinct(), "small")


def components(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Per distinct fp of ``rows`` (doc_id, fp): ``label`` (one per component) and ``component_id`` (its smallest doc_id)."""
    points = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "points")
    linked = stars(links(points.select("fp"), points.count(), radius))
    labelled = stage(points.join(linked.select(F.col("u").alias("fp"), "v"), "fp", "left").select("fp", "least_id", F.coalesce("v", "fp").alias("label"), F.col("v").isNotNull().alias("far")), "labelled")
    joined = labelled.where("far").select("label").distinct()
    grouped = labelled.join(joined, "label", "left_semi").groupBy("label").agg(F.min("least_id").alias("component_id"))
    return labelled.join(grouped, "label", "left").select("fp", "label", F.when(F.col("component_id").isNull(), F.col("least_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    rows = stage(fingerprints(docs.select("doc_id", "text")), "fingerprints")
    return rows.join(components(rows, radius), "fp").select("doc_id", hex_fingerprint("fp").alias("fingerprint"), "component_id")


# --- near copies by shingle similarity: the pipeline's stage -----------------------------------------------------------------------

WIDE_WORDS = 8  # a wide fingerprint has 512 bits
WIDE_SHINGLE = 5
SIMILARITY = 0.8
DEVIATIONS = 4
WIDE_TILE_ROWS = 1 << 14
BLOCK_ROWS = 64
EXACT_TILE_ROWS = 256
# Odd multipliers that turn one hash into several.
MIXERS = [(0x9E3779B97F4A7C15 * (2 * k + 1)) & ((1 << 64) - 1) for k in range(1, WIDE_WORDS + 1)]


def shingle_hashes(text: bytes) -> np.ndarray:
    """Sorted hashes of the distinct five-word shingles of a text; a shorter text is one shingle, one without words has none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*[words[i:] for i in range(WIDE_SHINGLE)], strict=False)) if len(words) > WIDE_SHINGLE else iter([b" ".join(words)])
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, max(1, len(words) - WIDE_SHINGLE + 1)))


def wide_fingerprint(text: bytes) -> tuple[bytes, int]:
    """SimHash of WIDE_WORDS * 64 bits over the distinct five-word shingles of a text, and their number."""
    hashes = shingle_hashes(text)
    return wide_of(hashes), len(hashes)


def wide_of(hashes: np.ndarray) -> bytes:
    if not len(hashes):
        return bytes(8 * WIDE_WORDS)
    ones = np.zeros(64 * WIDE_WORDS, np.int64)
    for start in range(0, len(hashes), 4096):
        part = hashes[start:start + 4096]
        mixed = np.stack([(part ^ (part >> np.uint64(29))) * np.uint64(m) for m in MIXERS], axis=1)
        mixed ^= mixed >> np.uint64(32)
        ones += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes()


def differing(common: int, left: int, right: int) -> float:
    """Chance that a bit differs between two sets with ``common`` shingles and ``left`` and ``right`` ones of their own."""
    chances = [[math.comb(n, k) / 2**n for k in range(n + 1)] for n in (common, left, right)]
    out = 0.0
    for k, p in enumerate(chances[0]):
        a, b = (sum(q for i, q in enumerate(chances[j]) if 2 * (k + i) > common + own) for j, own in ((1, left), (2, right)))
        out += p * (a * (1 - b) + b * (1 - a))
    return out


@cache
def wide_limit(similarity: float = SIMILARITY) -> int:
    """Largest distance of wide fingerprints of candidates: DEVIATIONS above the mean of the least favourable pair of this Jaccard similarity.

    That is a pair of small sets, whose ties count as zero, or else one of equally long texts.
    """
    worst, bits = math.acos(2 * similarity / (1 + similarity)) / math.pi, 64 * WIDE_WORDS
    for common in range(1, 33):
        apart = int(common / similarity + 1e-9) - common
        worst = max(worst, *[differing(common, a, apart - a) for a in range(apart // 2 + 1)], 0.0)
    return int(bits * worst + DEVIATIONS * math.sqrt(bits * worst * (1 - worst)))


def leading_words(limit: int) -> int:
    """Words of a wide fingerprint after which most unlike texts are already beyond the limit, so that the rest need not be compared."""
    return next((k for k in range(1, WIDE_WORDS) if 32 * k - 8 * math.sqrt(k) >= limit), WIDE_WORDS)


def wide_links(limit: int):
    lead = leading_words(limit)

    def listed(tiles: pa.ListArray, i: int) -> tuple[np.ndarray, np.ndarray]:
        rows = tiles.values.slice(tiles.offsets[i].as_py(), tiles.offsets[i + 1].as_py() - tiles.offsets[i].as_py())
        return rows.field("node").to_numpy(), np.frombuffer(b"".join(rows.field("wide").to_pylist()), np.uint64).reshape(-1, WIDE_WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (a, wa), (b, wb), found = listed(batch.column(0), i), listed(batch.column(1), i), []
                ones_a, ones_b = (np.bitwise_count(w).sum(axis=1, dtype=np.int64) for w in (wa, wb))
                if ones_a.min() - ones_b.max() > limit or ones_b.min() - ones_a.max() > limit:
                    continue
                columns = np.ascontiguousarray(wb[:, :lead].T)
                for start in range(0, len(a), BLOCK_ROWS):
                    block = wa[start:start + BLOCK_ROWS]
                    total = np.zeros((len(block), len(b)), np.uint16)
                    for k in range(lead):
                        total += np.bitwise_count(block[:, k, None] ^ columns[k])
                    x, y = np.nonzero(total <= limit)
                    apart = a[start + x] != b[y]
                    x, y = x[apart], y[apart]
                    close = np.bitwise_count(block[x] ^ wb[y]).sum(axis=1, dtype=np.int64) <= limit
                    if close.any():
                        found.append(spanning(a[start + x[close]], b[y[close]]))
                if found:
                    u, v = spanning(*[np.concatenate(c) for c in zip(*found, strict=True)])
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return run


def similar_links(points: DataFrame, similarity: float = SIMILARITY, tile_rows: int = WIDE_TILE_ROWS) -> DataFrame:
    """Links (u, v), u > v, that connect candidates for similar texts. ``points``: node, wide, shingles.

    Texts of this similarity have shingle counts within a factor of 1 / similarity, so tiles hold one band of counts and meet only those of their own
    and the next band; tile pairs whose population counts differ beyond the limit are skipped; the rest are compared whole.
    """
    band = F.floor(F.log(F.greatest("shingles", F.lit(1))) / F.lit(-math.log(similarity)) + F.lit(1e-9))
    keyed = points.select("node", "wide", band.alias("band"))
    sizes = keyed.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / tile_rows).alias("parts"))
    tiles = stage(keyed.join(F.broadcast(sizes), "band").groupBy("band", F.pmod(F.xxhash64("node"), "parts").alias("part")).agg(F.collect_list(F.struct("node", "wide")).alias("rows")), "tiles")
    left = tiles.select(F.col("rows").alias("a"), F.col("band").alias("own"), F.col("part").alias("at"), F.explode(F.array(F.lit(0), F.lit(1))).alias("step"))
    pairs = left.join(tiles, F.col("own") + F.col("step") == F.col("band")).where("step <> 0 or at <= part")
    return pairs.select("a", F.col("rows").alias("b")).mapInArrow(wide_links(wide_limit(similarity)), "u long, v long")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common values of two sorted arrays of distinct values."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def exact_links(limit: int, similarity: float):
    """Of two tiles (node, wide, hashes) the links that the exact similarity confirms; pairs that confirmed links connect already are not read again."""

    def listed(tiles: pa.ListArray, i: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        rows = tiles.values.slice(tiles.offsets[i].as_py(), tiles.offsets[i + 1].as_py() - tiles.offsets[i].as_py())
        return (rows.field("node").to_numpy(), np.frombuffer(b"".join(rows.field("wide").to_pylist()), np.uint64).reshape(-1, WIDE_WORDS),
                [np.frombuffer(h, np.uint64) for h in rows.field("hashes").to_pylist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (a, wa, ha), (b, wb, hb), found = listed(batch.column(0), i), listed(batch.column(1), i), []
                ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
                label, x, y = np.arange(len(ids)), flat[: len(a)], flat[len(a):]
                sizes = np.array([len(h) for h in hb])
                for row in range(len(a)):
                    near = np.bitwise_count(wb ^ wa[row]).sum(axis=1, dtype=np.int64) <= limit
                    fits = (sizes >= similarity * len(ha[row]) - 1e-6) & (similarity * sizes <= len(ha[row]) + 1e-6)
                    for other in np.nonzero(near & fits & (label[y] != label[x[row]]))[0]:
                        one, two = label[x[row]], label[y[other]]
                        if one != two and jaccard(ha[row], hb[other]) >= similarity:
                            label[label == max(one, two)] = min(one, two)
                            found.append((max(a[row], b[other]), min(a[row], b[other])))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["u", "v"])

    return run


def confirmed_links(candidates: DataFrame, texts: DataFrame, points: DataFrame, similarity: float, tile_rows: int = EXACT_TILE_ROWS) -> DataFrame:
    """Links (u, v), u > v, of exactly similar texts. ``candidates``: (u, v) from each linked node to its group's name; ``texts``: node, text.

    Confirmed links never leave a group of candidates, so only texts of one group meet; a large group is cut into tiles that meet pairwise.
    """
    members = stage(candidates.select(F.col("u").alias("node"), F.col("v").alias("label")).union(candidates.select("v", "v").distinct()), "members")
    large = members.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / tile_rows).alias("parts")).where("parts > 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_hashes(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["node", "hashes"])

    hashes = texts.join(members.select("node"), "node", "left_semi").select("node", as_bytes("text")).mapInArrow(run, "node long, hashes binary")
    placed = members.join(stage(large, "large"), "label", "left").select("node", "label", F.coalesce("parts", F.lit(1)).alias("parts"))
    rows = placed.join(hashes, "node").join(points.select("node", "wide"), "node")
    part = F.pmod(F.xxhash64("node"), "parts").alias("part")
    tiles = stage(rows.groupBy("label", part).agg(F.max("parts").alias("parts"), F.collect_list(F.struct("node", "wide", "hashes")).alias("rows")), "groups")
    left = tiles.select(F.col("rows").alias("a"), "label", F.explode(F.sequence("part", F.col("parts") - 1)).alias("part"))
    pairs = left.join(tiles.select("label", "part", F.col("rows").alias("b")), ["label", "part"]).select("a", "b")
    return pairs.mapInArrow(exact_links(wide_limit(similarity), similarity), "u long, v long")


def near_dedup(docs: DataFrame, similarity: float = SIMILARITY, tile_rows: int = WIDE_TILE_ROWS) -> DataFrame:
    """One document of each group of near copies, with all its columns.

    Near copies share at least ``similarity`` of their distinct five-word shingles; groups are what links connect.
    """
    (uid,) = fresh(docs.columns, "uid")
    rows = numbered(docs, [F.col("*")], [uid], "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches):
            found = [shingle_hashes(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([wide_of(h) for h in found], pa.binary()), pa.array([len(h) for h in found], pa.int64()),
                                              pa.array([xxhash.xxh64_intdigest(h.tobytes()) for h in found], pa.uint64()).view(pa.int64())], ["uid", "doc_id", "wide", "shingles", "same"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    marks = stage(rows.select(F.col(uid).alias("uid"), "doc_id", as_bytes("text")).mapInArrow(run, f"uid long, doc_id {kind}, wide binary, shingles long, same long"), "wide")
    points = stage(marks.groupBy("wide", "shingles", "same").agg(F.min("uid").alias("node"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("best")), "points")
    candidates = stars(similar_links(points, similarity, tile_rows))
    linked = stars(confirmed_links(candidates, rows.select(F.col(uid).alias("node"), "text"), points, similarity, min(tile_rows, EXACT_TILE_ROWS)))
    labelled = points.select("node", "best").join(linked.withColumnRenamed("u", "node"), "node", "left")
    stays = labelled.groupBy(F.coalesce("v", "node").alias("label")).agg(F.min("best").alias("best")).select(F.col("best.uid").alias("uid"))
    # those that leave are the shorter list: while it is small enough to broadcast, texts are not shuffled
    leave = stage(marks.select("uid").join(stays, "uid", "left_anti").select(F.col("uid").alias(uid)), "leave")
    return rows.join(leave, uid, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
