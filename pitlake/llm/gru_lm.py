"""Language-model scoring with a small gated recurrent network, trained in numpy inside Spark tasks.

Counts of all training words come first (a shuffle with partial sums). The most frequent words form the network's vocabulary in classes of equal
size; every other word belongs to a suffix class, inside which its probability is its smoothed count. The softmax is factored: class from the
state, then word from class and state. Each task trains on its own documents by truncated backpropagation, starting from the common parameters,
and the parameters are averaged by tokens seen, in two rounds that together take every training document once. Scoring streams documents through
lanes; a lane carries its state across windows until its document ends, so the log-likelihood is that of the whole text.

Words beyond the ``HEAD_WORDS`` most frequent ones, which alone are broadcast, get their counts by a join.

Cases: a null or empty text is its end token; texts of any length stream through; words are split at ASCII white space after lower-casing A-Z;
a null doc_id is text of no bytes to the checksum; repeated rows are scored alike and all train; without training rows the scores are those of a
uniform start; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.llm.common import as_bytes, numbered, row_batches
from pitlake.session import stage

HEAD_WORDS = 250_000
FLUSH_WORDS = 200_000
CLASSES, CLASS_WORDS, SUFFIXES = 32, 32, 32
HIDDEN = 16
LANES, STEPS = 256, 32
RATE = 0.004
FIRST_ROUND = 4  # one document in so many trains in the first round, the others in the second
CHUNK = 4096
FAN_IN = 64
END = b""  # words are never empty


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def is_held_out(doc_id: str) -> F.Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7 == 2


# --- corpus counts -----------------------------------------------------------------------------------------------------------------


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over the one binary column of ``texts``, one end token per text. Task memory is bounded by ``FLUSH_WORDS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in row_batches(batches):
            for text in batch.column(0).to_pylist():
                counts.update(words_of(text))
            counts[END] += batch.num_rows
            if len(counts) >= FLUSH_WORDS:
                yield rows(counts)
                counts = Counter()
        if counts:
            yield rows(counts)

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def suffix_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % SUFFIXES


@dataclass
class Lexicon:
    """What every task knows: frequent words, the network's ids, and totals of the suffix classes."""

    head: dict[bytes, int]  # word -> rank by count
    net_id: np.ndarray  # network id by rank
    log_count: np.ndarray  # log10(count + 1) by rank
    tail_log: np.ndarray  # log10 of the denominator of each suffix class
    start: np.ndarray  # log-probabilities of classes, then of words in classes, from counts
    total: int
    distinct: int

    @property
    def vocabulary(self) -> int:
        return CLASSES * CLASS_WORDS


def lexicon(counts: DataFrame, head_words: int = HEAD_WORDS) -> Lexicon:
    """Read from the staged counts what fits a fixed size: totals, and the words above a count that ``head_words`` words reach at most."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    step = F.floor(F.log2("n") * 16)
    steps = sorted(((r["step"], r["words"]) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    reached, floor = 0, None
    for at, words in steps:
        if reached + words > head_words:
            break
        reached, floor = reached + words, at
    found = [] if floor is None else [(bytes(r["word"]), r["n"]) for r in counts.where(step >= floor).collect()]
    found.sort(key=lambda x: (x[0] != END, -x[1], x[0]))  # the end token is always the first id
    size = CLASSES * CLASS_WORDS
    of_class = np.zeros((2, SUFFIXES), np.int64)
    for r in counts.groupBy((F.crc32(F.substring("word", -2, 2)) % SUFFIXES).alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        of_class[:, r["c"]] = r["n"], r["v"]
    inner = np.ones(size)
    for i, (word, n) in enumerate(found[:size]):
        of_class[:, suffix_class(word)] -= n, 1
        inner[i] = n + 1
    mass = inner.reshape(CLASSES, CLASS_WORDS)
    outer = np.concatenate([mass.sum(axis=1), of_class[0] + 1.0])
    start = np.concatenate([np.log(outer / outer.sum()), np.log(mass / mass.sum(axis=1, keepdims=True)).ravel()])
    net_id = np.array([i if i < size else size + suffix_class(w) for i, (w, _) in enumerate(found)] + [0], np.int64)  # the last one is for rank -1
    return Lexicon({w: i for i, (w, _) in enumerate(found)}, net_id, np.log10(np.array([n for _, n in found], np.float64) + 1), np.log10(of_class.sum(axis=0) + 1.0), start, total, distinct)


def token_ids(words: list[bytes], lex: Lexicon) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(network ids with the end token last, ranks or -1, words that are not frequent). Appends the end token to ``words``."""
    get = lex.head.get
    words.append(END)
    ranks = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
    ids = lex.net_id[ranks]
    rare = np.nonzero(ranks < 0)[0]
    unknown = [words[i] for i in rare.tolist()]
    ids[rare] = [lex.vocabulary + suffix_class(w) for w in unknown]
    return ids, ranks, unknown


# --- network -----------------------------------------------------------------------------------------------------------------------


def shapes(hidden: int = HIDDEN) -> dict[str, tuple[int, ...]]:
    """Input rows, recurrent weights, class weights and word weights by class; the last row of the output weights meets a state of one."""
    inputs = CLASSES * CLASS_WORDS + SUFFIXES
    return {"x": (inputs, 3 * hidden), "w": (hidden, 3 * hidden), "c": (hidden + 1, CLASSES + SUFFIXES), "o": (CLASSES, hidden + 1, CLASS_WORDS)}


def initial(start: np.ndarray, hidden: int = HIDDEN, seed: int = 5) -> dict[str, np.ndarray]:
    """Small random input and recurrent weights; the output starts at the word frequencies."""
    rng, out = np.random.default_rng(seed), {}
    for name, shape in shapes(hidden).items():
        out[name] = rng.normal(0, 0.3 if name == "x" else hidden ** -0.5, shape).astype(np.float32) if name in "xw" else np.zeros(shape, np.float32)
    out["c"][-1] = start[:CLASSES + SUFFIXES]
    out["o"][:, -1] = start[CLASSES + SUFFIXES:].reshape(CLASSES, CLASS_WORDS)
    return out


def flat(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([params[name].ravel() for name in shapes()])


def unflat(vector: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes().items():
        size = math.prod(shape)
        out[name] = np.ascontiguousarray(vector[at:at + size].reshape(shape), np.float32)
        at += size
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def exponentials(weights: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
    """exp(weights.T @ states - shift) and the shift, by column. States lie in [-1, 1], so small weights need no shift at all."""
    out, shift = weights.T @ states, 0.0
    if float(np.abs(weights).sum(axis=0).max()) > 60:
        shift = out.max(axis=0)
        out -= shift
    return np.exp(out, out=out), shift


class Network:
    """GRU over windows of ``steps`` x lanes tokens; the state of every lane goes on from window to window.

    Inside, lanes are the last axis, so that gates are contiguous slices.
    """

    def __init__(self, params: dict[str, np.ndarray], lanes: int):
        self.p, self.hidden = params, params["w"].shape[0]
        self.state = np.zeros((self.hidden, lanes), np.float32)
        self.moments: dict[str, list[np.ndarray]] | None = None
        self.updates = 0

    def keep(self, lanes: np.ndarray) -> None:
        if len(lanes) < self.state.shape[1]:
            self.state = self.state[:, lanes]

    def forward(self, inputs: np.ndarray, fresh: np.ndarray, keep: bool) -> tuple:
        """States (hidden and a row of ones, tokens) after each input. ``fresh``: a document starts here, so the state starts at zero."""
        steps, lanes = inputs.shape
        n, h, turned = self.hidden, self.state, np.ascontiguousarray(self.p["w"].T)
        given = np.ascontiguousarray(self.p["x"][inputs].transpose(0, 2, 1))
        out = np.ones((steps, n + 1, lanes), h.dtype)
        before, inner = (np.empty((steps, n, lanes), h.dtype) for _ in range(2)) if keep else (None, None)
        any_fresh = fresh.any(axis=1)
        for t in range(steps):
            if any_fresh[t]:
                h = h * ~fresh[t]
            a, gate = turned @ h, given[t]
            gate[:2 * n] += a[:2 * n]
            zr = sigmoid(gate[:2 * n])
            new = gate[2 * n:]
            new += zr[n:] * a[2 * n:]
            np.tanh(new, out=new)
            if keep:
                before[t], inner[t] = h, a[2 * n:]
            h = h - new
            h *= zr[:n]
            h += new
            out[t, :n] = h
        self.state = h
        return out.transpose(1, 0, 2).reshape(n + 1, -1), before, given, inner

    def outputs(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Log-probability of each target given the states (hidden and a row of ones, tokens)."""
        group, order, edges, word = self.grouped(targets)
        tokens = np.arange(len(targets))
        said = self.logs(self.p["c"], states, group, tokens)
        own, told = states[:, order], np.empty(len(order))
        for c in range(CLASSES):
            at = slice(edges[c], edges[c + 1])
            if at.start < at.stop:
                told[at] = self.logs(self.p["o"][c], own[:, at], word[at], tokens[: at.stop - at.start])
        said[order] += told
        return said

    @staticmethod
    def logs(weights: np.ndarray, states: np.ndarray, picked: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        out, shift = exponentials(weights, states)
        return np.einsum("ij,ij->j", weights[:, picked], states).astype(np.float64) - shift - np.log(out.sum(axis=0))

    @staticmethod
    def grouped(targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Class of each target; the targets that are words of the network sorted by class, where classes begin, and their words."""
        inside = targets < CLASSES * CLASS_WORDS
        group = np.where(inside, targets // CLASS_WORDS, targets - CLASSES * CLASS_WORDS + CLASSES)
        order = np.argsort(np.where(inside, group, CLASSES).astype(np.int8), kind="stable")[: int(inside.sum())]
        return group, order, np.searchsorted(group[order], np.arange(CLASSES + 1)), targets[order] % CLASS_WORDS

    def slopes(self, states: np.ndarray, targets: np.ndarray, weight: np.ndarray, grads: dict[str, np.ndarray]) -> np.ndarray:
        """Gradient of the weighted cross-entropy by the states; those of the output weights are put into ``grads``."""
        group, order, edges, word = self.grouped(targets)
        tokens = np.arange(len(targets))

        def one(weights: np.ndarray, here: np.ndarray, picked: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            out, _ = exponentials(weights, here)
            out *= share / out.sum(axis=0)
            out[picked, tokens[: len(picked)]] -= share
            return here @ out.T, weights[:-1] @ out

        grads["c"], back = one(self.p["c"], states, group, weight)
        grads["o"], own, near, share = np.zeros_like(self.p["o"]), states[:, order], np.empty((self.hidden, len(order)), states.dtype), weight[order]
        for c in range(CLASSES):
            at = slice(edges[c], edges[c + 1])
            if at.start < at.stop:
                grads["o"][c], near[:, at] = one(self.p["o"][c], own[:, at], word[at], share[at])
        back[:, order] += near
        return back

    def learn(self, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, mask: np.ndarray, rate: float) -> None:
        """One truncated backpropagation over a window, then an Adam step."""
        n = self.hidden
        steps, lanes = inputs.shape
        states, before, gates, inner = self.forward(inputs, fresh, True)
        grads: dict[str, np.ndarray] = {}
        weight = (mask.ravel() / max(1.0, mask.sum())).astype(states.dtype)
        back = self.slopes(states, targets.ravel(), weight, grads)
        back = np.ascontiguousarray(back.reshape(n, steps, lanes).transpose(1, 0, 2))
        into, through = np.empty((steps, 3 * n, lanes), states.dtype), np.empty((steps, 3 * n, lanes), states.dtype)
        onward = np.zeros((n, lanes), states.dtype)
        any_fresh = fresh.any(axis=1)
        for t in range(steps - 1, -1, -1):
            d = back[t]
            d += onward
            zr, new = gates[t, :2 * n], gates[t, 2 * n:]
            z, r, given, passed = zr[:n], zr[n:], into[t], through[t]
            d_new = new * new
            np.subtract(1, d_new, out=d_new)
            onward = d * z
            d_new *= d - onward
            given[2 * n:] = d_new
            np.multiply(d, before[t] - new, out=given[:n])
            np.multiply(d_new, inner[t], out=given[n:2 * n])
            given[:2 * n] *= zr * (1 - zr)
            passed[:2 * n] = given[:2 * n]
            np.multiply(d_new, r, out=passed[2 * n:])
            onward += self.p["w"] @ passed
            if any_fresh[t]:
                onward *= ~fresh[t]
        grads["w"] = before.transpose(1, 0, 2).reshape(n, -1) @ through.transpose(1, 0, 2).reshape(3 * n, -1).T
        ids = inputs.ravel()
        order = np.argsort(ids.astype(np.int16), kind="stable")
        used, first = np.unique(ids[order], return_index=True)
        grads["x"] = np.zeros_like(self.p["x"])
        grads["x"][used] = np.add.reduceat(into.transpose(0, 2, 1).reshape(-1, 3 * n)[order], first, axis=0)
        self.adam(grads, rate)

    def adam(self, grads: dict[str, np.ndarray], rate: float, slow: float = 0.9, slower: float = 0.99) -> None:
        if self.moments is None:
            self.moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        self.updates += 1
        step = rate * math.sqrt(1 - slower ** self.updates) / (1 - slow ** self.updates)
        for name, g in grads.items():
            m, v = self.moments[name]
            m += (1 - slow) * (g - m)
            v += (1 - slower) * (g * g - v)
            self.p[name] -= step * m / (np.sqrt(v) + 1e-8)


class Lanes:
    """Documents dealt to lanes as lanes become free, cut into windows; (key, ids) pairs come from an iterator and are held one per lane."""

    def __init__(self, documents: Iterator[tuple[int, np.ndarray]], lanes: int, steps: int):
        self.documents, self.steps = documents, steps
        self.key = np.full(lanes, -1, np.int64)
        self.at = np.zeros(lanes, np.int64)
        self.ids: list[np.ndarray | None] = [None] * lanes

    def __iter__(self) -> Iterator[tuple]:
        lanes, steps = len(self.ids), self.steps
        while True:
            targets, inputs = np.zeros((lanes, steps), np.int64), np.zeros((lanes, steps), np.int64)
            fresh, mask = np.zeros((lanes, steps), bool), np.zeros((lanes, steps), bool)
            keys = np.full((lanes, steps), -1, np.int64)
            for lane in range(lanes):
                t = 0
                while t < steps:
                    if self.ids[lane] is None:
                        taken = next(self.documents, None)
                        if taken is None:
                            break
                        self.key[lane], self.ids[lane], self.at[lane] = taken[0], taken[1], 0
                    ids, at = self.ids[lane], self.at[lane]
                    size = min(steps - t, len(ids) - at)
                    targets[lane, t:t + size] = ids[at:at + size]
                    if at:
                        inputs[lane, t:t + size] = ids[at - 1:at + size - 1]
                    else:
                        inputs[lane, t + 1:t + size] = ids[:size - 1]  # the first input is the end token, id 0
                        fresh[lane, t] = True
                    mask[lane, t:t + size], keys[lane, t:t + size] = True, self.key[lane]
                    t += size
                    self.at[lane] = at + size
                    if at + size == len(ids):
                        self.ids[lane] = None
            busy = np.nonzero(mask.any(axis=1))[0]
            if not len(busy):
                return
            if len(busy) < lanes:  # the documents run out: lanes without one are given up
                self.key, self.at, self.ids = self.key[busy], self.at[busy], [self.ids[lane] for lane in busy]
                lanes = len(busy)
            yield busy, *[np.ascontiguousarray(a[busy].T) for a in (inputs, targets, fresh, mask, keys)]


# --- training ----------------------------------------------------------------------------------------------------------------------


def id_arrays(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b, np.int16) for b in column.to_pylist()]


def train_round(encoded: DataFrame, params, rate: float) -> DataFrame:
    """One model per task: (chunk, part, weight, vector). ``params`` is a broadcast of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        documents = ((0, ids) for batch in row_batches(batches) for ids in id_arrays(batch.column(0)))
        net = Network(unflat(params.value.copy()), LANES)
        for lanes, inputs, targets, fresh, mask, _ in Lanes(documents, LANES, STEPS):
            net.keep(lanes)
            net.learn(inputs, targets, fresh, mask, rate * min(1.0, (net.updates + 1) / 10))
            seen += int(mask.sum())
        if seen:
            vector = flat(net.p)
            pieces = [vector[i:i + CHUNK].tobytes() for i in range(0, len(vector), CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int64()), pa.array([part] * len(pieces), pa.int64()), pa.array([float(seen)] * len(pieces)), pa.array(pieces, pa.binary())], ["chunk", "part", "weight", "vector"])

    return encoded.select("ids").mapInArrow(run, "chunk long, part long, weight double, vector binary")


def averaged(models: DataFrame, parts: int) -> list[bytes]:
    """Token-weighted mean of the tasks' parameters by chunks, in levels of ``FAN_IN``; one model comes to the driver."""

    def mean(rows: pa.Table) -> pa.Table:
        weights = rows.column("weight").to_numpy()
        whole = sum(w * np.frombuffer(v, np.float32).astype(np.float64) for w, v in zip(weights, rows.column("vector").to_pylist(), strict=True)) / weights.sum()
        return pa.table({"chunk": rows.column("chunk")[:1], "part": rows.column("part")[:1], "weight": pa.array([float(weights.sum())]), "vector": pa.array([whole.astype(np.float32).tobytes()], pa.binary())})

    while True:
        models = models.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("chunk", "part").applyInArrow(mean, "chunk long, part long, weight double, vector binary")
        parts = -(-parts // FAN_IN)
        if parts <= 1:
            return [bytes(r["vector"]) for r in models.orderBy("chunk").collect()]


def train(encoded: DataFrame, start: np.ndarray) -> np.ndarray:
    """Parameters after both rounds over ``encoded`` (uid, ids), training documents only."""
    spark = encoded.sparkSession
    vector = flat(initial(start))
    pick = F.pmod(F.xxhash64("uid"), F.lit(FIRST_ROUND)) == 0
    for own, rate in ((encoded.where(pick), RATE), (encoded.where(~pick), RATE / 2)):
        params = spark.sparkContext.broadcast(vector)
        # a model per task: written once, so that a lost executor does not train again what others have averaged
        models = stage(train_round(own, params, rate), "models")
        last = models.agg(F.max("part")).first()[0]
        params.unpersist()
        if last is not None:
            vector = np.frombuffer(b"".join(averaged(models, last + 1)), np.float32)
    return vector


# --- scoring -----------------------------------------------------------------------------------------------------------------------

PART = "doc_id {kind}, held_out boolean, n_tokens long, n_frequent long, frequent_log double, tail_log double, rare array<binary>, rare_n array<long>, ids binary"


def encode(docs: DataFrame, lex) -> DataFrame:
    """Per document what its own text and the broadcast lexicon tell: sums over frequent words, ``rare`` words that still need their counts, and
    the network's ids as 16-bit numbers, so that training and scoring do not split texts again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lex.value
        names = [f.split()[0] for f in PART.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary()]
        for batch in row_batches(batches):
            out = []
            for text in batch.column(2).to_pylist():
                ids, ranks, rare = token_ids(words_of(text), known)
                frequent, counts = ranks[ranks >= 0], Counter(rare)
                tail = ids[ids >= known.vocabulary] - known.vocabulary
                inner = known.log_count[frequent[frequent >= known.vocabulary]].sum() - known.tail_log[tail].sum()
                out.append((len(ids), len(frequent), float(known.log_count[frequent].sum()), float(inner), list(counts), list(counts.values()), ids.astype(np.int16).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]], names)

    return docs.select("doc_id", is_held_out("doc_id").alias("held_out"), as_bytes("text")).mapInArrow(run, PART.format(kind=docs.schema["doc_id"].dataType.simpleString()))


def network_scores(encoded: DataFrame, params) -> DataFrame:
    """(uid, network_log): log10 probability of every document's classes, and of its words inside the network's classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, float] = {}

        def documents() -> Iterator[tuple[int, np.ndarray]]:
            for batch in row_batches(batches):
                for uid, ids in zip(batch.column(0).to_pylist(), id_arrays(batch.column(1)), strict=True):
                    sums[uid] = 0.0
                    yield uid, ids

        net, source = Network(unflat(params.value.copy()), LANES), Lanes(documents(), LANES, STEPS)
        for lanes, inputs, targets, fresh, mask, keys in source:
            net.keep(lanes)
            said = net.outputs(net.forward(inputs, fresh, False)[0], targets.ravel())
            real = mask.ravel()
            uids, at = np.unique(keys.ravel()[real], return_inverse=True)
            for uid, value in zip(uids.tolist(), np.bincount(at, said[real]).tolist(), strict=True):
                sums[uid] += value / math.log(10)
            reading = {int(k) for k, ids in zip(source.key, source.ids, strict=True) if ids is not None}
            done = [k for k in uids.tolist() if k not in reading]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64()), pa.array([sums.pop(k) for k in done])], ["uid", "network_log"])

    return encoded.select("uid", "ids").mapInArrow(run, "uid long, network_log double")


def score(docs: DataFrame, head_words: int = HEAD_WORDS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    context = docs.sparkSession.sparkContext
    counts = stage(word_counts(docs.where(~is_held_out("doc_id")).select(as_bytes("text"))), "counts")
    found = lexicon(counts, head_words)
    encoded = numbered(encode(docs, context.broadcast(found)), [F.col("*")], ["uid"], "encoded")
    params = context.broadcast(train(encoded.where("not held_out").select("uid", "ids"), found.start))
    network = stage(network_scores(encoded, params), "network")
    rare = encoded.select("uid", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select("uid", F.col("r.rare").alias("word"), F.col("r.rare_n").alias("k"))
    counted = rare.join(counts, "word").groupBy("uid").agg(F.sum("k").alias("rare_known"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("rare_log"))
    each = math.log10(found.total + found.distinct + 1)
    rare_known, rare_log = F.coalesce("rare_known", F.lit(0)), F.coalesce("rare_log", F.lit(0.0))
    return encoded.drop("rare", "rare_n", "ids").join(network, "uid").join(counted, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_frequent") + rare_known).alias("n_known"), F.lit(found.total).cast("long").alias("train_tokens"),
        (F.col("frequent_log") + rare_log - F.col("n_tokens") * F.lit(each)).alias("base_score"), (F.col("network_log") + F.col("tail_log") + rare_log).alias("score"))
