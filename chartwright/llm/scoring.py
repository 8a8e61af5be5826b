"""Operator 6: language-model scores by context-tree weighting over bytes.

A text is its bytes, begun by DEPTH zero bytes and ended by one. Each byte is eight binary decisions;
each context (the last 0 to DEPTH bytes) holds, for each of the 255 decisions, how often it went
either way in the training texts, and the Krichevsky-Trofimov estimate of that. Context-tree weighting
mixes, at each context, its own estimate with the product of its extensions' weighted ones; the
posterior weights give the predictive distribution of a byte after any context. Code length per byte
is -log2 of that.

Training counts cover all training texts: every byte n-gram and every word is counted where it is read,
summed over tasks, and written. Every context is a node of its own. The n-grams are dealt to tasks by
the last SHARED bytes of their context, so that a task has all that is below such a node, at most
65,536 n-grams of each. It weights the nodes from there down; the weights' sums over the contexts of
SHARED - 1 bytes, at most 65,536 of them, are mixed on the driver and broadcast, and a second pass goes
down again to the probability of each n-gram that the scored texts have.

N-grams at least as frequent in the scored texts as 1 in GRAMS (at most GRAMS) are looked up where a
text is read; the rarer ones of each text meet the full table in a shuffled join, in which none is frequent.

The base score needs the count of every word. Words at least as frequent as 1 in WORDS (at most WORDS)
are looked up where a text is read; the rarer ones of each text meet the full table of counts in a
shuffled join, in which none is frequent.

Defined results: a null text is an empty one. With no training text N is 0, every word is unknown and
each byte has probability 1/256. Rows that repeat an id are scored each. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartwright.llm.common import crc_bucket, give_back, read, staged

DEPTH, WORDS, GRAMS = 4, 1 << 18, 1 << 20
#: Bytes of context by which n-grams are dealt; n-grams weighted at once.
SHARED, WEIGHTED = 3, 50_000
#: Words held by a task before it passes their counts on; bytes counted at once.
HELD, AT_ONCE = 250_000, 1 << 21


def word_key(word: bytes) -> bytes:
    """A word of up to 16 bytes, or a byte that begins no word and 128 bits of hash."""
    return word if len(word) <= 16 else b"\xff" + xxhash.xxh3_128_digest(word)


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts with their zero bytes, one after another, and where each of them begins."""
    joined = np.frombuffer(b"".join(bytes(DEPTH) + t + b"\0" for t in texts), dtype=np.uint8)
    lengths = np.fromiter((len(t) + DEPTH + 1 for t in texts), np.int64, len(texts))
    return joined, np.concatenate(([0], np.cumsum(lengths)))


def _positions(bounds: np.ndarray, total: int) -> np.ndarray:
    """Which bytes are scored: all but the DEPTH zeros before each text."""
    real = np.ones(total, dtype=bool)
    for k in range(DEPTH):
        real[bounds[:-1] + k] = False
    return np.flatnonzero(real)


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams at all bytes that are scored, text by text, and how many each text has."""
    joined, bounds = windows(texts)
    at = _positions(bounds, len(joined))
    key = np.zeros(len(at), dtype=np.uint64)
    for k in range(DEPTH, -1, -1):
        key = (key << np.uint64(8)) | joined[at - k]
    return key, np.diff(bounds) - DEPTH


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def counted(docs: DataFrame) -> DataFrame:
    """Rows (gram, word, n, m): counts of byte n-grams (DEPTH bytes of context and the next, the next lowest) and of words, n in texts to learn from, m (of n-grams) in texts to be scored. docs: text, and whether to learn and score it (all, if there are no such columns)."""
    flags = [F.col(c) if c in docs.columns else F.lit(True).alias(c) for c in ("learn", "score")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "word", "n", "m"]
        words: Counter = Counter()
        grams, held = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), 0

        def word_rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.nulls(len(words), pa.int64()), pa.array(map(word_key, words), pa.binary()), pa.array(words.values(), pa.int64()), pa.array(np.zeros(len(words), np.int64))], names)

        def add(texts: list[bytes], uses: list[int]) -> None:
            nonlocal grams
            key, lengths = _grams(texts)
            key = (key << np.uint64(2)) | np.repeat(np.array(uses, dtype=np.uint64), lengths)  # whether to learn from it, and to score it
            key.sort()
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            n = np.diff(np.concatenate((first, [len(key)])))
            grams = _summed(np.concatenate((grams[0], key[first])), np.concatenate((grams[1], n)))

        texts: list[bytes] = []
        uses: list[int] = []
        for b in batches:
            for t, learn, scored in zip(b.column("text"), b.column("learn").to_pylist(), b.column("score").to_pylist(), strict=True):
                t = (t.as_py() or "").encode()
                if learn:
                    words.update(t.lower().split())
                    words[b""] += 1
                    if len(words) > HELD:
                        yield word_rows()
                        words.clear()
                texts.append(t)
                uses.append(2 * learn + scored)
                held += len(t)
                if held > AT_ONCE:
                    add(texts, uses)
                    texts, uses, held = [], [], 0
        if texts:
            add(texts, uses)
        if words:
            yield word_rows()
        for k in range(0, len(grams[0]), 100_000):
            key, n = grams[0][k : k + 100_000].astype(np.int64), grams[1][k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(key >> 2), pa.nulls(len(key), pa.binary()), pa.array(n * (key >> 1 & 1)), pa.array(n * (key & 1))], names)
        words, grams = Counter(), (grams[0][:0], grams[1][:0])
        give_back()

    rows = docs.select("text", *flags).mapInArrow(count, "gram long, word binary, n long, m long")
    return rows.groupBy("gram", "word").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    y = x + 8
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _decisions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones of the 255 decisions (in heap order, from 1) of rows of 256 counts."""
    total = np.zeros((len(counts), 512))
    total[:, 256:] = counts
    for i in range(255, 0, -1):
        total[:, i] = total[:, 2 * i] + total[:, 2 * i + 1]
    return total[:, 2:512:2], total[:, 3:512:2]


def _estimate(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the KT estimate of all decisions so far, and the KT probability of a one next."""
    zeros, ones = _decisions(counts)
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1) - np.log(np.pi), (ones + 0.5) / (zeros + ones + 1)


class Tree:
    """child: for each inner context the context with one more byte before it, or -1. table: log10 probabilities of the next byte at each context, for texts that go no deeper."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """levels: for each depth from 0 the sorted contexts (the last byte lowest) and their rows of 256 counts."""
        sizes = [len(c) for c, _ in levels]
        starts = np.concatenate(([0], np.cumsum(sizes)))
        depth = len(levels) - 1
        self.child = np.full((int(starts[depth]) if depth else 1, 256), -1, dtype=np.int32)
        parents = [np.zeros(0, np.int64)]
        for d in range(1, depth + 1):
            contexts = levels[d][0]
            parent = np.searchsorted(levels[d - 1][0], contexts & ((1 << 8 * (d - 1)) - 1))
            parents.append(parent)
            self.child[starts[d - 1] + parent, contexts >> (8 * (d - 1))] = starts[d] + np.arange(len(contexts))
        weights: list[np.ndarray] = [np.zeros(0)] * (depth + 1)
        ones, rest_ones = list(weights), list(weights)
        below = None
        for d in range(depth, -1, -1):
            own, ones[d] = _estimate(levels[d][1])
            if d == depth:
                below, weights[d], rest_ones[d] = own, np.ones_like(own), ones[d]
                continue
            rest, product = levels[d][1].astype(float), np.zeros_like(own)
            np.subtract.at(rest, parents[d + 1], levels[d + 1][1])
            np.add.at(product, parents[d + 1], below)
            other, rest_ones[d] = _estimate(np.maximum(rest, 0))
            both = np.logaddexp(own, other + product) - np.log(2)
            weights[d], below = np.exp(own - np.log(2) - both), both
        tables, mixed, left = [], None, None
        for d in range(depth + 1):
            before = (np.zeros_like(ones[0]), np.ones_like(ones[0])) if d == 0 else (mixed[parents[d]], left[parents[d]])
            mixed, left = before[0] + before[1] * weights[d] * ones[d], before[1] * (1 - weights[d])
            p = np.clip(mixed + left * rest_ones[d], 1e-12, 1 - 1e-12)
            logs = np.zeros((len(p), 512))
            for i in range(1, 256):
                logs[:, 2 * i] = logs[:, i] + np.log10(1 - p[:, i - 1])
                logs[:, 2 * i + 1] = logs[:, i] + np.log10(p[:, i - 1])
            tables.append(logs[:, 256:].astype(np.float32))
        self.table = np.concatenate(tables)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text and its end."""
        joined, bounds = windows(texts)
        out = np.zeros(len(joined))
        at = _positions(bounds, len(joined))
        for k in range(0, len(at), 1 << 20):
            a = at[k : k + (1 << 20)]
            node, open_ = np.zeros(len(a), dtype=np.int32), np.arange(len(a))
            for d in range(1, DEPTH + 1):
                n = node[open_]
                inner = n < len(self.child)
                open_, n = open_[inner], n[inner]
                got = self.child[n, joined[a[open_] - d]]
                open_, got = open_[got >= 0], got[got >= 0]
                node[open_] = got
            out[a] = self.table[node, joined[a]]
        return np.add.reduceat(out, bounds[:-1]) if len(texts) else np.zeros(0)


def tree(counts: DataFrame) -> Tree:
    """The weighted tree of counted n-grams as one table, for corpora of few contexts: all n-grams come to the driver. score() has the same tree as tables of its nodes."""
    found = counts.where("gram IS NOT NULL AND n > 0").select("gram", "n").toArrow()
    grams, n = found.column("gram").to_numpy(), found.column("n").to_numpy()
    levels = []
    for d in range(DEPTH + 1):
        k = grams & ((1 << 8 * (d + 1)) - 1)
        contexts = np.unique(k >> 8) if d else np.zeros(1, dtype=np.int64)
        table = np.zeros((len(contexts), 256), dtype=np.int64)
        np.add.at(table, (np.searchsorted(contexts, k >> 8), k & 255), n)
        levels.append((contexts, table))
    while len(levels) > 1 and not len(levels[-1][0]):
        levels.pop()
    return Tree(levels)


class Nodes:
    """Decisions of contexts at one depth: key (context * 256 + decision, sorted), zeros, ones; then own (log estimate) and p (of a one next)."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> None:
        """Rows that repeat a key are added up; row: where each is now."""
        self.key, self.row = np.unique(key, return_inverse=True)
        self.zeros, self.ones = (np.bincount(self.row, x, len(self.key)).astype(float) for x in (zeros, ones))
        self.own = _log_gamma(self.zeros + 0.5) + _log_gamma(self.ones + 0.5) - _log_gamma(self.zeros + self.ones + 1) - np.log(np.pi)
        self.p = (self.ones + 0.5) / (self.zeros + self.ones + 1)
        self.weighted, self.weight = self.own, np.ones_like(self.own)

    def up(self, depth: int) -> Nodes:
        """Their parents, of depth bytes, weighted with them; row of this object becomes each one's parent."""
        return Nodes((self.key >> 8 & ((1 << 8 * depth) - 1)) << 8 | self.key & 255, self.zeros, self.ones).over(self.weighted)

    def over(self, below: np.ndarray) -> Nodes:
        """Weights it against its children, whose weighted logs are below, in the order of the rows it was made from."""
        product = np.bincount(self.row, below, len(self.key))
        self.weighted = np.logaddexp(self.own, product) - np.log(2)
        self.weight = np.exp(self.own - np.log(2) - self.weighted)
        return self

    def mix(self, mixed: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is mixed and left after these, from what was before each."""
        return mixed + left * self.weight * self.p, left * (1 - self.weight)


def _low(grams: np.ndarray, n: np.ndarray) -> list[Nodes]:
    """The nodes of n-grams from depth DEPTH down to SHARED; the first one's rows are the 8 decisions of all n-grams, one after another."""
    byte, context = grams & 255, grams >> 8
    level = np.arange(8)[:, None]
    decision, bit = (byte | 256) >> (8 - level), byte >> (7 - level) & 1
    nodes = [Nodes((context << 8 | decision).ravel(), (n * (1 - bit)).ravel(), (n * bit).ravel())]
    for d in range(DEPTH - 1, SHARED - 1, -1):
        nodes.append(nodes[-1].up(d))
    return nodes


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns gram, n, m of rows sorted by SHARED bytes of context, in slices that cut no such context apart."""
    held: list[list[np.ndarray]] = []
    size = 0
    for b in batches:
        held.append([b.column(c).to_numpy() for c in ("gram", "n", "m")])
        size += b.num_rows
        if size < WEIGHTED:
            continue
        whole = [np.concatenate(x) for x in zip(*held, strict=True)]
        of = whole[0] >> 8 & ((1 << 8 * SHARED) - 1)
        cut = int(np.searchsorted(of, of[-1]))
        if cut:
            yield [x[:cut] for x in whole]
        held, size = [[x[cut:] for x in whole]], size - cut
    if size:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def weighed(counts: DataFrame) -> DataFrame:
    """Rows (gram, m, lp): log10 of the probability of each counted n-gram that scored texts have. To the driver come the decisions of at most 256^(SHARED - 1) contexts."""
    of = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * SHARED) - 1))
    grams = counts.where(F.col("gram").isNotNull()).select("gram", "n", "m", of.alias("of")).repartition("of").sortWithinPartitions("of").select("gram", "n", "m")

    def upward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, n, _ in _groups(batches):
            x = _low(gram, n)[-1]
            at = Nodes((x.key >> 8 & ((1 << 8 * (SHARED - 1)) - 1)) << 8 | x.key & 255, x.zeros, x.ones)
            yield pa.RecordBatch.from_arrays([pa.array(at.key), pa.array(at.zeros.astype(np.int64)), pa.array(at.ones.astype(np.int64)), pa.array(np.bincount(at.row, x.weighted, len(at.key)))], ["k", "zeros", "ones", "below"])
        give_back()

    found = grams.mapInArrow(upward, "k long, zeros long, ones long, below double").groupBy("k").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below"))).toArrow()
    k, zeros, ones, below = (found.column(c).to_numpy() for c in ("k", "zeros", "ones", "below"))
    nodes = [Nodes(k, zeros, ones).over(below)]
    for d in range(SHARED - 2, -1, -1):
        nodes.append(nodes[-1].up(d))
    mixed, left = nodes[-1].mix(np.zeros(len(nodes[-1].key)), np.ones(len(nodes[-1].key)))
    for x, parent in zip(nodes[-2::-1], nodes[:0:-1], strict=True):
        mixed, left = x.mix(mixed[parent.row], left[parent.row])
    top = counts.sparkSession.sparkContext.broadcast((nodes[0].key, mixed, left))

    def downward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, mixed_top, left_top = top.value
        for gram, n, m in _groups(batches):
            low = _low(gram, n)
            at = np.searchsorted(keys, (low[-1].key >> 8 & ((1 << 8 * (SHARED - 1)) - 1)) << 8 | low[-1].key & 255)
            mixed, left = low[-1].mix(mixed_top[at], left_top[at])
            for x, parent in zip(low[-2::-1], low[:0:-1], strict=True):
                mixed, left = x.mix(mixed[parent.row], left[parent.row])
            p = np.clip(mixed, 1e-12, 1 - 1e-12)[low[0].row].reshape(8, len(gram))
            bit = (gram & 255) >> (7 - np.arange(8)[:, None]) & 1
            lp = np.log10(np.where(bit == 1, p, 1 - p)).sum(axis=0)
            some = m > 0
            yield pa.RecordBatch.from_arrays([pa.array(gram[some]), pa.array(m[some]), pa.array(lp[some])], ["gram", "m", "lp"])
        give_back()

    return grams.mapInArrow(downward, "gram long, m long, lp double")


def text_scores(texts: list[bytes], keys: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """The sum of the logs of each text's n-grams among the sorted keys, and its other n-grams with how often it has them."""
    gram, lengths = _grams(texts)
    both = (gram << np.uint64(24)) | np.repeat(np.arange(len(texts), dtype=np.uint64), lengths)
    both.sort()
    first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
    n = np.diff(np.concatenate((first, [len(both)])))
    gram, row = (both[first] >> np.uint64(24)).astype(np.int64), (both[first] & np.uint64((1 << 24) - 1)).astype(np.int64)
    at = np.minimum(np.searchsorted(keys, gram), max(len(keys) - 1, 0))
    hit = keys[at] == gram if len(keys) else np.zeros(len(gram), dtype=bool)
    sums = np.bincount(row[hit], n[hit] * logs[at[hit]], len(texts)).astype(float)
    missed = np.flatnonzero(~hit)
    missed = missed[np.argsort(row[missed], kind="stable")]
    offsets = np.concatenate(([0], np.cumsum(np.bincount(row[missed], minlength=len(texts)))))
    pairs = pa.StructArray.from_arrays([pa.array(gram[missed]), pa.array(n[missed])], ["gram", "k"])
    return sums, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)


def score(docs: DataFrame, train: DataFrame) -> DataFrame:
    """For rows (doc_id, text): doc_id, n_tokens, n_known, train_tokens, base_score, score. train: rows with text."""
    learnt = train.select("text", F.lit(True).alias("learn"), F.lit(False).alias("score"))
    return scored(docs, learnt.unionByName(docs.select("text", F.lit(False).alias("learn"), F.lit(True).alias("score"))))


def scored(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """score() of docs; texts: each text to learn from or of docs, once, with flags learn and score."""
    spark = docs.sparkSession
    counts = staged(counted(texts), "counts")
    words = counts.where(F.col("word").isNotNull()).select("word", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    floor = total + 0.5 * (distinct + 1)
    frequent = {bytes(r[0]): int(r[1]) for r in words.where(F.col("n") >= F.lit(total / WORDS)).collect()}
    logs = {w: float(np.log10((c + 0.5) / floor)) for w, c in frequent.items()}
    grams = staged(weighed(counts), "grams")
    often = F.lit((grams.agg(F.sum("m")).first()[0] or 0) / GRAMS)
    most = grams.where(F.col("m") >= often).select("gram", "lp").toArrow().sort_by("gram")
    shared = spark.sparkContext.broadcast((most.column("gram").to_numpy(), most.column("lp").to_numpy(), logs))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram_keys, gram_logs, known = shared.value
        for whole in batches:
            for k in range(0, whole.num_rows, 250):
                b = whole.slice(k, 250)
                texts = [(t or "").encode() for t in b.column("text").to_pylist()]
                tokens, hits, base, rare = [], [], [], []
                for t in texts:
                    ws = [w if len(w) <= 16 else word_key(w) for w in t.lower().split()]
                    ws.append(b"")
                    got = [known[w] for w in ws if w in known]
                    tokens.append(len(ws))
                    hits.append(len(got))
                    base.append(sum(got))
                    rare.append([{"word": w, "k": n} for w, n in Counter(w for w in ws if w not in known).items()] if len(got) < len(ws) else [])
                sums, rare_grams = text_scores(texts, gram_keys, gram_logs)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(tokens, pa.int64()), pa.array(hits, pa.int64()), pa.array(base, pa.float64()), pa.array(sums), pa.array(rare, pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int64())]))), rare_grams], ["doc_id", "n_tokens", "hits", "base", "sum", "rare", "rare_grams"])
        give_back()

    schema = "doc_id long, n_tokens long, hits long, base double, sum double, rare array<struct<word:binary,k:long>>, rare_grams array<struct<gram:long,k:long>>"
    rows = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(go, schema).withColumn("row", F.monotonically_increasing_id()), "scores")
    terms = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.k")
    c = F.coalesce(F.col("n"), F.lit(0))
    rarer = words.where(F.col("n") < F.lit(total / WORDS))
    of_words = terms.join(rarer, "word", "left").groupBy("row").agg(F.sum(F.col("k") * F.log10((c + 0.5) / F.lit(floor))).alias("more"), F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("seen"), F.lit(0.0).alias("deep"))
    rest = rows.select("row", F.explode("rare_grams").alias("r")).select("row", "r.gram", "r.k")
    of_grams = rest.join(grams.where(F.col("m") < often).select("gram", "lp"), "gram").groupBy("row").agg(F.lit(0.0).alias("more"), F.lit(0).cast("long").alias("seen"), F.sum(F.col("k") * F.col("lp")).alias("deep"))
    more = of_words.unionByName(of_grams).groupBy("row").agg(*(F.sum(x).alias(x) for x in ("more", "seen", "deep")))
    return rows.join(more, "row", "left").select("doc_id", "n_tokens", (F.col("hits") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("sum") + F.coalesce("deep", F.lit(0.0))).alias("score"))


def op6_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each document under words and under the context tree of the documents whose id's crc32 modulo 5 isn't 1."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = scored(docs, docs.select("text", (crc_bucket(F.col("doc_id"), 5) != 1).alias("learn"), F.lit(True).alias("score")))
    return found.select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def word_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op6_scoring that SQL can express: its counts and base score, to 6 places."""
    return op6_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


#: crc32 of a text in SQL: eight shifts for each byte.
CRC = "xor(list_reduce([4294967295] || list_transform(string_split({text}, ''), lambda ch: ascii(ch)), lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)"
WORD_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {CRC.format(text="CAST(doc_id AS VARCHAR)")} % 5 = 1 AS held_out, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') || [''] AS w FROM documents),
each AS MATERIALIZED (SELECT doc_id, held_out, unnest(w) AS w FROM d),
c AS MATERIALIZED (SELECT w, count(*) AS c FROM each WHERE NOT held_out GROUP BY w), t AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(n AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))), 6) AS base_score
FROM each LEFT JOIN c USING (w), t GROUP BY doc_id, held_out, n
"""
