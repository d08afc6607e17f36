"""Language-model scores by a log-bilinear model (Mnih and Hinton, 2007) with noise-contrastive estimation.

Outcomes are the end of a text, the most frequent words, as many as can be broadcast (LOOKUP; all of a small
corpus), and ENDINGS classes of the other words by their last two bytes; within a class a word has its smoothed
frequency, so every word counted has a probability, and a word never seen that of its class's one unseen slot.
The context is the word before: its own embedding and that of its ending, which also speaks for words without one.
So there are as many contexts as outcomes, and every normaliser is computed once, by batched matrix products:
scores are normalised exactly.

As in maximum-entropy models that are trained with neural ones (Mikolov et al., 2011), pairs of outcomes that occur
together have direct connections besides: the most frequent PAIRS of them hold their discounted share of the
context, and what is left of the context goes by the embeddings.

Counts, of words and of pairs, cover all training documents. The neural part starts from a short fit on whole texts
of FIRST_TOKENS tokens and then takes one pass over every training document: documents are dealt to groups of about
GROUP_TOKENS tokens by a hash, each group trains a copy in the order of that hash, and each row of the parameters
is averaged over the copies that met it, by how often they did (parameter mixing, McDonald et al., 2010). The
groups depend on the documents alone, so the model does not depend on partitions.

Words beyond a bounded head never reach a driver or a broadcast: they are looked up by a join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, repeat
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, give_back, id_fraction, id_remainder, materialize, words

ENDINGS, DIM = 256, 24
#: Words whose counts and embeddings are broadcast, pairs with direct connections (some 25 MB), and the discount of these.
LOOKUP, PAIRS, DISCOUNT = 1 << 17, 1 << 21, 0.75
#: Tokens of the first fit, whose last text is whole, and of a group of the pass over all documents.
FIRST_TOKENS, GROUP_TOKENS = 400_000, 8_000_000
#: Tokens of a minibatch and its noise words; AdaGrad: rate, and the sum of squares it starts from.
BATCH, NOISE, RATE, STATE = 1024, 96, 0.07, 1.0
HELD_MODULUS, HELD_REMAINDER = 7, 2
#: Distinct words a task counts before it passes them on.
COUNTED = 400_000
#: Parts of the parameters and of the pairs; groups whose results a task puts together; tasks that groups are dealt to.
BLOCKS, BUCKETS, FAN, TASKS = 16, 256, 64, 20_000
#: Tokens that are scored at once; pairs a task holds before it counts them; contexts and outcomes of one matrix product.
SCORED, CODES, ROWS, COLUMNS = 1 << 16, 1 << 21, 512, 1 << 14
#: The end of a text, as a token: no word is empty. It is outcome 0.
END = b""


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


@dataclass
class Lookup:
    """The head of the vocabulary. Outcome i < len(counts) is a word (0: END), the rest are endings; the context after
    those is the start of a text."""

    index: dict[bytes, int]
    counts: np.ndarray
    endings: np.ndarray  # of the words
    unigram: np.ndarray  # of outcomes, in training tokens
    within: np.ndarray  # log10 of the size of each ending: count + distinct + 1
    total: int
    distinct: int

    @property
    def words(self) -> int:
        return len(self.counts)

    @property
    def outcomes(self) -> int:
        return len(self.counts) + ENDINGS

    def outcomes_of(self, w: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.index.get, w, repeat(-1)), np.int64, len(w))
        for i in np.flatnonzero(out < 0).tolist():
            out[i] = self.words + ending(w[i])
        return out

    def ending_of_contexts(self) -> np.ndarray:
        """For each context, the ending that it has or is; ENDINGS for the start of a text."""
        return np.concatenate((self.endings, np.arange(ENDINGS + 1)))


def count_words(docs: DataFrame) -> DataFrame:
    """docs(text) of training documents -> (word binary, c long), END included once per document."""
    batches(docs.sparkSession)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["word", "c"])
        for b in frames:
            for t in b.column(0).to_pylist():
                n.update(words(t))
                n[END] += 1
                if len(n) > COUNTED:
                    yield out()
                    n.clear()
        if n:
            yield out()
            n.clear()
        give_back()

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "word binary, c long")
    return rows.groupBy("word").agg(F.sum("c").alias("c"))


def lookup(counts: DataFrame, limit: int = LOOKUP) -> tuple[Lookup, int]:
    """The words of the highest counts, at most `limit` and whole levels of counts only; and the least of those counts."""
    # Eighths of an octave: a bounded histogram of the counts, whatever the vocabulary.
    level = F.floor(F.log2("c") * 8).cast("int")
    by = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min("c").alias("least"), F.sum("c").alias("tokens")).orderBy(F.desc("level")).collect()
    total, distinct, room, least = sum(r["tokens"] for r in by), sum(r["n"] for r in by), limit, 1 << 62
    for r in by:
        if (room := room - r["n"]) < 0:
            break
        least = r["least"]
    rows = [(bytes(r["word"]), r["c"]) for r in counts.where((F.col("c") >= least) & (F.col("word") != F.lit(END))).toLocalIterator()]
    rows.sort(key=lambda r: (-r[1], r[0]))
    end = counts.where(F.col("word") == F.lit(END)).first()
    rows.insert(0, (END, end["c"] if end else 0))
    # Sizes of the endings, over every word that is no outcome of its own.
    e = F.pmod(F.crc32(F.when(F.length("word") > 2, F.substring("word", -2, 2)).otherwise(F.col("word"))), F.lit(ENDINGS))
    size, kinds = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in counts.where((F.col("c") < least) & (F.col("word") != F.lit(END))).groupBy(e.alias("e")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        size[r["e"]], kinds[r["e"]] = r["c"], r["n"]
    c = np.array([c for _, c in rows], np.int64)
    return Lookup({w: i for i, (w, _) in enumerate(rows)}, c, np.array([ending(w) for w, _ in rows], np.int64), np.concatenate((c, size)), np.log10(size + kinds + 1), total, distinct), least


def start(v: Lookup, seed: int = 3) -> list[np.ndarray]:
    """Embeddings of contexts, of their endings, of outcomes; biases of outcomes."""
    rng = np.random.default_rng(seed)
    r = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    return [np.zeros((v.outcomes + 1, DIM), np.float32), r(ENDINGS + 1, DIM), r(v.outcomes, DIM), np.log(noise_of(v)).astype(np.float32)]


def noise_of(v: Lookup) -> np.ndarray:
    return (v.unigram + 0.5) / (v.unigram + 0.5).sum()


def before(out: np.ndarray, start: int) -> np.ndarray:
    """Contexts of the outcomes of one text."""
    return np.concatenate(([start], out[:-1]))


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of `at`, where its runs of equal values begin in that order, and those values."""
    # Values and places in one number, which sorts faster than a stable argsort and in the same order.
    bits = len(at).bit_length()
    s = np.sort((at << bits) | np.arange(len(at)))
    order, s = s & ((1 << bits) - 1), s >> bits
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    return order, first, s[first]


def _step(into: np.ndarray, state: np.ndarray, rows: np.ndarray, g: np.ndarray) -> None:
    """AdaGrad ascent on distinct rows; one step size a row."""
    new = state.take(rows) + (np.einsum("ij,ij->i", g, g) / g.shape[1] if g.ndim > 1 else g * g)
    state[rows] = new
    step = RATE / np.sqrt(new)
    into[rows] = into.take(rows, 0) + (step[:, None] * g if g.ndim > 1 else step * g)


def ascend(params: list[np.ndarray], batches_: Iterator[tuple], v: Lookup, seed: int) -> None:
    """Noise-contrastive estimation over minibatches (before, outcome), in place.

    The noise words of a minibatch are shared by its tokens, so that scores and gradients are matrix products.
    """
    r, c, t, b = params
    rng, p, kinds = np.random.default_rng(seed), noise_of(v), v.ending_of_contexts()
    cdf, log_kp = np.cumsum(p), np.log(NOISE * p).astype(np.float32)
    states = [np.full(len(x), STATE, np.float32) for x in params]
    for ctx, out in batches_:
        noise = np.minimum(np.searchsorted(cdf, rng.random(NOISE)), len(p) - 1)
        # take() gathers rows faster than indexing does.
        q, pos, neg = r.take(ctx, 0) + c.take(kinds.take(ctx), 0), t.take(out, 0), t.take(noise, 0)
        s = np.einsum("ij,ij->i", q, pos) + b.take(out) - log_kp.take(out)
        g = 1 / (1 + np.exp(np.clip(s, -30, 30)))
        h = q @ -neg.T
        h += log_kp[noise] - b[noise]
        np.clip(h, -30, 30, out=h)
        np.exp(h, out=h)
        h += 1
        np.divide(-1, h, out=h)
        dq = g[:, None] * pos + h @ neg
        # Gradients of the same row add up; those of an ending are the sums of its contexts'.
        order, first, rows = _runs(np.concatenate((out, noise)))
        _step(t, states[2], rows, np.add.reduceat(np.concatenate((g[:, None] * q, h.T @ q)).take(order, 0), first))
        _step(b, states[3], rows, np.add.reduceat(np.concatenate((g, h.sum(0))).take(order), first))
        order, first, rows = _runs(ctx)
        dr = np.add.reduceat(dq.take(order, 0), first)
        _step(r, states[0], rows, dr)
        order, first, ends = _runs(kinds.take(rows))
        _step(c, states[1], ends, np.add.reduceat(dr.take(order, 0), first))


def minibatches(outs: Iterator[np.ndarray], start: int) -> Iterator[tuple]:
    """Outcomes of text after text -> (before, outcome) in pieces of BATCH tokens and a last one."""
    held, n = [], 0
    for out in outs:
        held.append((before(out, start), out))
        n += len(out)
        if n >= BATCH:
            whole = [np.concatenate(x) for x in zip(*held)]
            for i in range(0, n - n % BATCH, BATCH):
                yield tuple(x[i : i + BATCH] for x in whole)
            held, n = [tuple(x[n - n % BATCH :] for x in whole)], n % BATCH
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held))


def first_texts(training: DataFrame, total: int, seed: str) -> list[str | None]:
    """Whole texts of training(doc_id, text) in the order of a hash of both, up to the one that reaches FIRST_TOKENS.

    total: the tokens of all of training.
    """
    place = id_fraction(F.struct("doc_id", "text"), seed)
    # A share that holds about twice as many tokens; the rest is never sorted.
    few = training.where(place < min(1.0, 2 * FIRST_TOKENS / max(1, total))).orderBy(place, "text").select("text")
    texts, n = [], 0
    for r in few.toLocalIterator():
        texts.append(r["text"])
        n += len(words(r["text"])) + 1
        if n >= FIRST_TOKENS:
            break
    return texts


@dataclass
class Model:
    """query (contexts, DIM) and target (outcomes, DIM), bias and normaliser of each; direct connections as sorted
    codes (context * outcomes + outcome) with their shares, and what they leave of each context."""

    query: np.ndarray
    target: np.ndarray
    bias: np.ndarray
    normaliser: np.ndarray
    codes: np.ndarray
    shares: np.ndarray
    left: np.ndarray

    def probabilities(self, ctx: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Of each outcome in its context."""
        s = np.empty(len(out), np.float32)
        for i in range(0, len(out), 1 << 15):
            j = slice(i, i + (1 << 15))
            s[j] = np.einsum("ij,ij->i", self.query.take(ctx[j], 0), self.target.take(out[j], 0))
        p = np.exp((s + self.bias[out]).astype(np.float64) - self.normaliser[ctx]) * self.left[ctx]
        if len(self.codes):
            code = ctx * len(self.target) + out
            # Codes in order are found several times faster than codes at random places.
            order = code.argsort()
            code = code.take(order)
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            p[order] += np.where(self.codes.take(at) == code, self.shares.take(at), 0.0)
        return p


#: What groups pass on: parts of the parameters (kind 0) or of the counts of pairs (kind 1).
PASSED = "kind int, part int, g long, n binary, x binary"
_PASSED = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("g", pa.int64()), ("n", pa.binary()), ("x", pa.binary())])


def _passed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _PASSED)], schema=_PASSED)


def _count(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the sums of their times."""
    order = codes.argsort(kind="stable")
    codes, times = codes[order], times[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.empty(0, np.int64)
    return codes[first], np.add.reduceat(times, first) if len(first) else times


def _parts(n: int) -> list[slice]:
    per = -(-n // BLOCKS)
    return [slice(i * per, min(n, (i + 1) * per)) for i in range(BLOCKS) if i * per < n]


def train(training: DataFrame, v: Lookup, params: list[np.ndarray]) -> tuple[DataFrame, Broadcast]:
    """One pass over all of training(doc_id, text) -> PASSED: what each group adds to the rows of the parameters that it
    met (float16) and how often it met them; counts of its pairs of outcomes. And the broadcast that it rests on."""
    spark = training.sparkSession
    batches(spark)
    got, groups, n_out = spark.sparkContext.broadcast((v, params)), 1 + v.total // GROUP_TOKENS, v.outcomes

    def encode(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = got.value[0]
        for b in frames:
            outs = [look.outcomes_of([*words(t), END]).astype(np.uint32).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(outs, pa.binary())], names=["h", "outs"])
        give_back()

    def group(g: int, texts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        look, first = got.value
        own = [p.copy() for p in first]
        # How often: contexts as such, outcomes as what follows, endings with their contexts.
        met, out_met = np.zeros(n_out + 1, np.int64), np.zeros(n_out, np.int64)
        held, pairs = [], []

        def count():
            codes = np.concatenate(held)
            held.clear()
            codes, times = _distinct(codes)
            # Sums of whole numbers, exact in doubles.
            met[:] += np.bincount(codes // n_out, times, n_out + 1).astype(np.int64)
            out_met[:] += np.bincount(codes % n_out, times, n_out).astype(np.int64)
            bucket = (codes // n_out % BUCKETS).astype(np.min_scalar_type(BUCKETS - 1))
            order = bucket.argsort(kind="stable")
            at = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
            which = [order[i:j] for i, j in zip(at, at[1:])]
            pairs.append(_passed([(1, k, g, _squeezed(times[w]), _packed(codes[w])) for k, w in enumerate(which) if len(w)]))

        def seen() -> Iterator[tuple]:
            for n, b in enumerate(minibatches(texts, n_out), 1):
                yield b
                held.append(b[0] * n_out + b[1])
                if n % (CODES // BATCH) == 0:
                    count()

        ascend(own, seen(), look, 1000 + g)
        if held:
            count()
        yield from pairs
        end_met = np.bincount(look.ending_of_contexts(), met, ENDINGS + 1).astype(np.int64)
        for k, (a, b, often) in enumerate(zip(own, first, (met, end_met, out_met, out_met))):
            for i, part in enumerate(_parts(len(a))):
                at = np.flatnonzero(often[part])
                if len(at):
                    yield _passed([(0, k * BLOCKS + i, g, np.stack((at, often[part][at])).tobytes(), (a[part][at] - b[part][at]).astype(np.float16).tobytes())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((g, np.frombuffer(o, np.uint32).astype(np.int64)) for b in frames for g, o in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for g, texts in groupby(rows, key=itemgetter(0)):
            yield from group(g, (o for _, o in texts))
            give_back()

    rows = training.select(F.xxhash64(F.lit("group"), "doc_id", "text").alias("h"), "text").mapInArrow(encode, "h long, outs binary")
    # A task for each group, or for some where there are very many.
    tasks = min(groups, TASKS)
    rows = rows.withColumn("g", F.pmod("h", F.lit(groups))).repartitionById(tasks, F.pmod("g", F.lit(tasks)).cast("int")).sortWithinPartitions("g", "h", "outs")
    return rows.select("g", "outs").mapInArrow(run, PASSED), got


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order and how often each occurs. Sorts codes in place."""
    codes.sort()
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.diff(first, append=len(codes))


def _squeezed(x: np.ndarray) -> bytes:
    """Whole numbers, their bytes by place: most are zero."""
    return zlib.compress(np.ascontiguousarray(x, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _spread(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _packed(codes: np.ndarray) -> bytes:
    """Codes in order, as differences."""
    return _squeezed(np.diff(codes, prepend=0))


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(_spread(raw))


def _sum_parameters(rows: Iterator[tuple[bytes, bytes]], dim: int) -> tuple[bytes, bytes]:
    """Rows of one part from several groups, in order -> rows met by any, with the mean by how often."""
    often, total = np.zeros(0, np.int64), np.zeros((0, dim))
    for n, x in rows:
        at, w = np.frombuffer(n, np.int64).reshape(2, -1)
        if (most := int(at[-1]) + 1) > len(often):
            often, total = np.pad(often, (0, most - len(often))), np.pad(total, ((0, most - len(total)), (0, 0)))
        often[at] += w
        total[at] += np.frombuffer(x, np.float16).reshape(-1, dim) * w[:, None].astype(np.float64)
    at = np.flatnonzero(often)
    return np.stack((at, often[at])).tobytes(), (total[at] / often[at][:, None]).astype(np.float16).tobytes()


def _sum_pairs(rows: Iterator[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
    codes, times, held, waiting = np.empty(0, np.int64), np.empty(0, np.int64), [], 0
    for n, x in rows:
        held.append((_unpacked(x), _spread(n)))
        if (waiting := waiting + len(held[-1][0])) >= CODES:
            codes, times = _count(*(np.concatenate((a, *b)) for a, b in zip((codes, times), zip(*held))))
            held, waiting = [], 0
    if held:
        codes, times = _count(*(np.concatenate((a, *b)) for a, b in zip((codes, times), zip(*held))))
    return _squeezed(times), _packed(codes)


def put_together(passed: DataFrame, groups: int) -> DataFrame:
    """PASSED of all groups -> one row for each kind and part: FAN groups at a time, in their order."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in frames for r in zip(*(c.to_pylist() for c in b.columns)))
        for (kind, part, to), own in groupby(rows, key=itemgetter(0, 1, 2)):
            both = ((n, x) for *_, n, x in own)
            n, x = _sum_pairs(both) if kind else _sum_parameters(both, 1 if part // BLOCKS == 3 else DIM)
            yield _passed([(kind, part, to, n, x)])
        give_back()

    while True:
        to = passed.withColumn("to", F.floor(F.col("g") / FAN)).repartition("kind", "part", "to").sortWithinPartitions("kind", "part", "to", "g")
        passed, groups = to.select("kind", "part", "to", "n", "x").mapInArrow(run, PASSED), -(-groups // FAN)
        if groups <= 1:
            return passed
        passed = materialize(passed, "together")


def normalisers(spark, query: np.ndarray, target: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """log of the sum over outcomes of exp(score), for every context."""
    got = spark.sparkContext.broadcast((query, target, bias))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, t, b = got.value
        one = lambda x: np.ones((len(x), 1), np.float32)
        # No score exceeds |q| |t| + b; less that bound, but for 60, no sum overflows, and none that counts vanishes.
        less = np.maximum(0, np.linalg.norm(q, axis=1) * np.linalg.norm(t, axis=1).max() + b.max() - 60)[:, None]
        # Bias and bound are part of the product.
        left, right = np.hstack((q, one(q), -less.astype(np.float32))), np.hstack((t, b[:, None], one(t))).T
        for f in frames:
            for k in f["id"].tolist():
                at = slice(k * ROWS, (k + 1) * ROWS)
                z = np.zeros(len(q[at]))
                for i in range(0, len(t), COLUMNS):
                    s = left[at] @ right[:, i : i + COLUMNS]
                    np.exp(s, out=s)
                    z += s.sum(1)
                yield pd.DataFrame({"k": [k], "z": [(np.log(z) + less[at, 0]).tobytes()]})
        del left, right
        give_back()

    n = -(-len(query) // ROWS)
    rows = spark.range(0, n, 1, min(n, int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInPandas(run, "k long, z binary").collect()
    got.destroy()
    return np.concatenate([np.frombuffer(r["z"], np.float64) for r in sorted(rows, key=itemgetter("k"))])


def connections(pairs: DataFrame, v: Lookup, most: int = PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pairs of put_together() -> codes in order, shares, what is left of each context. The pairs of the highest counts,
    at most `most` and whole counts only."""

    def histogram(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for n in f["n"]:
                c, k = np.unique(np.minimum(_spread(n), 1 << 16), return_counts=True)
                yield pd.DataFrame({"c": c, "k": k})

    by = pairs.select("n").mapInPandas(histogram, "c long, k long").groupBy("c").agg(F.sum("k").alias("k")).orderBy(F.desc("c")).collect()
    least, room = 1 << 62, most
    for r in by:
        if (room := room - r["k"]) < 0:
            break
        least = r["c"]

    def kept(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for n, x in zip(f["n"], f["x"]):
                c = _spread(n)
                if (c >= least).any():
                    yield pd.DataFrame({"n": [_squeezed(c[c >= least])], "x": [_packed(_unpacked(x)[c >= least])]})

    rows = pairs.select("n", "x").mapInPandas(kept, "n binary, x binary").collect()
    codes = np.concatenate([np.empty(0, np.int64), *(_unpacked(bytes(r["x"])) for r in rows)])
    times = np.concatenate([np.empty(0, np.int64), *(_spread(bytes(r["n"])) for r in rows)])
    order = codes.argsort()
    codes, times = codes[order], times[order]
    # A word is a context as often as it occurs, the start of a text as often as the end; the end is none.
    often, ctx = np.concatenate((v.unigram, [v.unigram[0]])), codes // v.outcomes
    shares = (times - DISCOUNT) / often[ctx]
    return codes, shares.astype(np.float32), 1 - np.bincount(ctx, shares.astype(np.float32), v.outcomes + 1)


def fit(training: DataFrame, v: Lookup, seed: str = "lm") -> Model:
    """The model of all of training(doc_id, text)."""
    spark = training.sparkSession
    params = start(v)
    first = (v.outcomes_of([*words(t), END]) for t in first_texts(training, v.total, seed))
    ascend(params, minibatches(first, v.outcomes), v, 0)
    rows, sent = train(training, v, params)
    passed = materialize(rows, "groups")
    sent.destroy()  # workers that are used again need not hold it
    whole = materialize(put_together(passed, 1 + v.total // GROUP_TOKENS), "model")
    for r in whole.where("kind = 0").toLocalIterator():
        k, i = divmod(r["part"], BLOCKS)
        at = np.frombuffer(r["n"], np.int64).reshape(2, -1)[0] + _parts(len(params[k]))[i].start
        params[k][at] += np.frombuffer(r["x"], np.float16).reshape(len(at), *params[k].shape[1:])
    query = params[0] + params[1][v.ending_of_contexts()]
    return Model(query, params[2], params[3], normalisers(spark, query, params[2], params[3]), *connections(whole.where("kind = 1"), v))


def score(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row per row.

    Learns from documents whose crc32(doc_id as text) mod 7 is not 2 (a null id counts as the empty text).
    Null and empty texts are one token, the end. Without training documents every token has the
    probability 1 under the base and the smoothed one of an untrained model. No rows give no rows; repeated
    rows are trained on and scored as often as they occur.
    """
    spark = docs.sparkSession
    batches(spark)
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    held = id_remainder(F.col("doc_id"), HELD_MODULUS) == HELD_REMAINDER
    training = d.where(~held)
    counts = materialize(count_words(training), "counts")
    v, least = lookup(counts)
    got = spark.sparkContext.broadcast((v, fit(training, v)))
    whole = np.log10(v.total + v.distinct + 1)

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, words array<binary>, times array<int>"
    arrow = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("words", pa.list_(pa.binary())), ("times", pa.list_(pa.int32()))])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, model = got.value
        row = TaskContext.get().partitionId() << 33
        # Of a word without an outcome of its own the counts come later, by a join.
        log_c = np.concatenate((np.log10(look.counts + 1.0), np.zeros(ENDINGS)))
        inside = np.concatenate((np.zeros(look.words), -look.within))
        def scored(texts: list[tuple]) -> Iterator[tuple]:
            """The rows of texts (doc_id, held_out, words, outcomes)."""
            outs = [o for *_, o in texts]
            out, n = np.concatenate(outs), np.array([len(o) for o in outs])
            starts = np.concatenate(([0], np.cumsum(n)[:-1]))
            # A word without an outcome: its ending, then its share of that ending.
            lp = np.log10(np.maximum(model.probabilities(np.concatenate([before(o, look.outcomes) for o in outs]), out), 1e-300)) + inside[out]
            rest = out >= look.words
            known = n - np.add.reduceat(rest.astype(np.int64), starts) - (look.counts[0] == 0)
            base = np.add.reduceat(log_c[out], starts) - n * whole
            cut = np.split(at := np.flatnonzero(rest), np.searchsorted(at, starts[1:]))
            for (doc, out_of, w, _), s, *own, i in zip(texts, starts.tolist(), n.tolist(), known.tolist(), base.tolist(), np.add.reduceat(lp, starts).tolist(), cut):
                rare = Counter(w[k] for k in (i - s).tolist())
                yield doc, out_of, *own, list(rare), list(rare.values())

        def together(rows: Iterator[tuple]) -> Iterator[tuple]:
            held, n = [], 0
            for doc, out_of, text in rows:
                w = [*words(text), END]
                held.append((doc, out_of, w, look.outcomes_of(w)))
                if (n := n + len(w)) >= SCORED:
                    yield from scored(held)
                    held, n = [], 0
            if held:
                yield from scored(held)

        for b in frames:
            rows = [(row + i, *r) for i, r in enumerate(together(zip(*(c.to_pylist() for c in b.columns))))]
            row += len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), arrow)] if rows else [pa.array([], f.type) for f in arrow], schema=arrow)
        give_back()

    parts = materialize(d.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, schema), "parts")
    got.destroy()  # executors that are used again need not hold it
    # Rare words: each has a count under `least`, so no key of the join is heavy.
    seen = counts.where(F.col("c") < least)
    rare = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("t")).select("row", F.col("t.words").alias("word"), F.col("t.times").alias("k"))
    more = rare.join(seen, "word").groupBy("row").agg(F.sum("k").alias("known"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("log_c"))
    r = parts.drop("words", "times").join(more, "row", "left").fillna(0, ["known", "log_c"])
    return r.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("known")).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"), (F.col("base") + F.col("log_c")).alias("base_score"), (F.col("score") + F.col("log_c")).alias("score"))
