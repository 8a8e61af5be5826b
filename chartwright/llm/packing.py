"""Operator 10: packing documents into sequences as a cutting-stock problem, by column generation.

Documents longer than a sequence are cut into full pieces and a rest. The rests are items of a
cutting-stock problem: their lengths, rounded up to UNIT tokens, make a histogram, and the linear
program over patterns (how many items of each length share a sequence) is solved by column generation:
the simplex method's prices go into a knapsack dynamic programme that finds the pattern which saves
most, until none saves anything. Whole multiples of the patterns take most items; what rounding leaves
(a few items for each pattern) is packed first-fit by falling length.

The histogram, the patterns and the table that says which ranks of a length go to which pattern have a
size that depends on the sequence's length and UNIT alone. Only they are on the driver. Rests are
ranked in their length by counts for each (length, shard) and a window in the shard, so that no task
holds a length's documents; each then computes its own sequence and place, and a window over each
sequence turns places into offsets. Full pieces need no rank and are numbered where they are read.

Defined results: a null text is an empty one and gives its end token alone. Rows that repeat an id, or
have none, are packed each. Any other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartwright.llm.common import give_back, lean, read, slices, small_batches, staged

LENGTH, UNIT, END = 4096, 16, 2
#: Shards of a size's rests: one for each SHARD_ROWS, within these bounds.
SHARDS, MOST_SHARDS, SHARD_ROWS = 64, 1024, 1_000_000
#: Words of a generation whose ids a task keeps at hand.
KNOWN = 40_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

#: Code points that no normal form composes, and whose lower case doesn't depend on what stands beside them.
BEYOND = re.compile("[\u0300-\U0010ffff]")
#: ASCII punctuation; a run of it is a token run of its own beside letters, unless it begins a contraction.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Texts' bytes that are encoded at once.
SLICE = 512 << 10


def _byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class WordTokens:
    """Ids of whole texts from a tokenizer that treats blanks as bounds and lower-cases, by its ids of blank-separated words.

    A word of letters below U+0300 with punctuation around it is cut into runs as the tokenizer's own
    pattern would, and the runs go to its model; any other word goes through the whole tokenizer. Words
    are kept in two generations: when the young one is full it becomes the old one, and words used again
    move back, so frequent words are encoded once.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.run = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, words: list[str]) -> None:
        """Encodes new words, joined by blanks, and tells them apart by the ids' places in the joined text."""
        for k in range(0, len(words), 2000):
            part = words[k : k + 2000]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(found.ids, dtype="<u4")
            starts = np.fromiter((a for a, _ in found.offsets), np.int64, len(ids))
            lengths = np.fromiter(map(len, part), np.int64, len(part))
            at = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths + 1)))).tolist()
            data = ids.tobytes()
            self.young.update((w, data[4 * at[i] : 4 * at[i + 1]]) for i, w in enumerate(part))

    def part(self, run: str) -> bytes:
        """Ids of a run that the tokenizer's pattern keeps whole, in lower case."""
        got = self.young.get(run)
        if got is None:
            got = self.old.get(run)
            if got is None:
                plain = run if run.isascii() else "".join([self.letters[b] for b in run.encode()])
                got = b"".join([t.id.to_bytes(4, "little") for t in self.run(plain)])
            self.young[run] = got
        return got

    def learn(self, words: set[str]) -> None:
        """Sees to it that the young generation has the words."""
        if len(self.young) > KNOWN:
            self.old, self.young = self.young, {}
        young, old, part, rest = self.young, self.old, self.part, []
        for w in words:
            if w in young:
                continue
            if w in old:
                young[w] = old[w]
                continue
            if "<|" in w or BEYOND.search(w):
                rest.append(w)
                continue
            low = w.lower()
            before = low.rstrip(PUNCTUATION)
            stem = before.lstrip(PUNCTUATION)
            if not stem.isalpha() or "'" in before:
                rest.append(w)
            else:
                young[w] = (part(before[: len(before) - len(stem)]) if len(stem) < len(before) else b"") + part(stem) + (part(low[len(before) :]) if len(before) < len(low) else b"")
        self.whole(rest)

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        # fewer different words; where a special token's string or a mark to compose could be touched, a text stays as it is
        low = [t if "<|" in t or BEYOND.search(t) else t.lower() for t in texts]
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in low]
        self.learn({w for ws in split for w in ws})
        known = self.young
        return [b"".join([known[w] for w in ws]) for ws in split]


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """Rows (PIECES) of each document's ids and its end token, cut into full pieces and a rest."""
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        words = WordTokens(path)
        stop = np.array([end], dtype="<u4").tobytes()
        names = [c.split()[0] for c in PIECES.split(", ")]
        for b in batches:
            for part in slices(b, "text", SLICE):
                rows = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), words.ids([t or "" for t in part.column("text").to_pylist()]), strict=True):
                    ids += stop
                    n = len(ids) // 4
                    for s in range(0, n, length):
                        p = ids[4 * s : 4 * (s + length)]
                        rows.append((doc_id, s, len(p) // 4, zlib.crc32(p), n))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
        del words
        give_back()

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def knapsack(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes 1..len(values) that fits, by dynamic programming over capacities."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        m = min(c, len(values))
        got = best[c - m : c][::-1] + values[:m]
        i = int(np.argmax(got))
        if got[i] > best[c - 1] + 1e-12:
            best[c], last[c] = got[i], i + 1
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(len(values), dtype=np.int64), capacity
    while c > 0:
        if last[c]:
            counts[last[c] - 1] += 1
            c -= int(last[c])
        else:
            c -= 1
    return float(best[capacity]), counts


def inverted(matrix: np.ndarray) -> np.ndarray:
    """The inverse by row elimination with pivots. numpy's own goes to a library that starts threads, which can stall in a process of few cores."""
    n = len(matrix)
    both = np.hstack([matrix.astype(float), np.eye(n)])
    for k in range(n):
        p = k + int(np.argmax(np.abs(both[k:, k])))
        both[[k, p]] = both[[p, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0
        both -= factor[:, None] * both[k][None, :]
    return both[:, n:]


def patterns(demand: np.ndarray, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Columns (patterns of sizes 1..len(demand), capacity len(demand)) and how often the linear program's optimum uses each.

    The primal simplex method on sum of pattern * use = demand over the sizes that occur, from patterns
    of one size; the inverse of the basis is updated at each step, and the knapsack prices the entering
    column. Demands are raised by tiny distinct amounts, so that no step is empty and none repeats. It
    ends after the given rounds at the latest, with a feasible plan.
    """
    capacity, active = len(demand), np.flatnonzero(demand)
    m = len(active)
    most = capacity // (active + 1)
    basis, inverse = np.diag(most.astype(float)), np.diag(1.0 / most)
    wanted = demand[active] + np.random.default_rng(0).uniform(1e-4, 1e-3, m)
    times = lambda m, v: (m * v[None, :]).sum(axis=1)  # noqa: E731  as for inverted()
    use, prices = times(inverse, wanted), np.zeros(capacity)
    for k in range(rounds):
        prices[active] = np.maximum(inverse.sum(axis=0), 0)
        value, counts = knapsack(prices, capacity)
        if value <= 1 + 1e-6:
            break
        column = counts[active]
        if k % 200 == 199:
            inverse = inverted(basis)
            use = np.maximum(times(inverse, wanted), 0)
        d = times(inverse, column)
        ratio = np.where(d > 1e-9, use / np.where(d > 1e-9, d, 1), np.inf)
        out = int(np.argmin(ratio))
        step = ratio[out]
        use = np.maximum(use - step * d, 0)
        use[out] = step
        basis[:, out] = column
        row = inverse[out] / d[out]
        inverse -= d[:, None] * row[None, :]
        inverse[out] = row
    columns = np.zeros((capacity, m), dtype=np.int64)
    columns[active] = np.rint(basis).astype(np.int64)
    return columns, use


def plan(demand: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """Which ranks of a size go where: rows (size, first rank, ranks, items of that size in the pattern, first sequence, first place).

    Rank r of a size is item (r - first) % items + place of sequence first sequence + (r - first) // items.
    """
    columns, use = patterns(demand.astype(float))
    left, taken = demand.astype(np.int64).copy(), np.zeros(len(demand), dtype=np.int64)
    rows, sequence = [], 0
    order = np.argsort(-use, kind="stable")

    def assign(counts: np.ndarray, times: int) -> None:
        nonlocal sequence
        place = 0
        for s in np.flatnonzero(counts)[::-1]:
            rows.append((int(s) + 1, int(taken[s]), int(counts[s]) * times, int(counts[s]), sequence, place))
            taken[s] += counts[s] * times
            left[s] -= counts[s] * times
            place += int(counts[s])
        sequence += times

    for p in order:
        has = columns[:, p] > 0
        if (times := min(int(use[p] + 1e-6), int((left[has] // columns[has, p]).min()))) > 0:
            assign(columns[:, p], times)
    while left.any():  # a few items for each pattern: falling first-fit, one sequence at a time
        counts, room = np.zeros(len(demand), dtype=np.int64), len(demand)
        for s in range(len(demand), 0, -1):
            n = min(int(left[s - 1]), room // s)
            counts[s - 1], room = n, room - n * s
        assign(counts, int((left[counts > 0] // counts[counts > 0]).min()))
    return rows


def packed(cut: DataFrame, length: int = LENGTH, unit: int = UNIT) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces: full pieces are sequences of their own, numbered where they are read, rests are packed by the plan."""
    spark = cut.sparkSession
    sizes, rests = length // unit, cut.where(F.col("length") < length)
    shards = min(MOST_SHARDS, max(SHARDS, rests.count() // SHARD_ROWS))
    keyed = rests.withColumn("size", F.expr(f"(length + {unit - 1}) div {unit}").cast("int")).withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards)).cast("int"))
    counts = keyed.groupBy("size", "shard").agg(F.count("*").alias("n")).collect()  # sizes * shards rows at most
    table = np.zeros((sizes + 1, shards), dtype=np.int64)
    for r in counts:
        table[r["size"], r["shard"]] = r["n"]
    before = np.cumsum(table, axis=1) - table
    rows = plan(table[1:].sum(axis=1)) if table.any() else []
    used = max((r[4] + r[2] // r[3] for r in rows), default=0)
    offsets = spark.createDataFrame([(s, h, int(before[s, h])) for s in range(sizes + 1) for h in range(shards) if table[s, h]] or [(0, 0, 0)], "size int, shard int, ahead long")
    by_size: dict[int, list[tuple]] = {}
    for r in rows:
        by_size.setdefault(r[0], []).append(r)
    bounds = spark.createDataFrame([(s, [x[1] for x in v], [x[3] for x in v], [x[4] for x in v], [x[5] for x in v]) for s, v in by_size.items()], "size int, firsts array<long>, items array<long>, sequences array<long>, places array<long>")
    w = W.partitionBy("size", "shard").orderBy("doc_id", "start", "ids_crc32")
    ranked = keyed.withColumn("in_shard", F.row_number().over(w) - 1).join(F.broadcast(offsets), ["size", "shard"]).withColumn("rank", F.col("in_shard") + F.col("ahead"))
    full = cut.where(F.col("length") == length).select(*cut.columns, (F.monotonically_increasing_id() + F.lit(used)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    at = F.size(F.filter("firsts", lambda x: x <= F.col("rank")))
    placed = ranked.join(F.broadcast(bounds), "size").withColumn("at", at).withColumn("r", F.col("rank") - F.element_at("firsts", F.col("at")))
    placed = placed.select(*cut.columns, (F.element_at("sequences", F.col("at")) + F.expr("r div items[at - 1]")).alias("sequence_id"), (F.element_at("places", F.col("at")) + F.expr("r % items[at - 1]")).alias("place"))
    inside = W.partitionBy("sequence_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)  # length / unit rows at most
    rest = placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).drop("place")
    return full.unionByName(rest.select(*full.columns))


def pack(docs: DataFrame, path: str, length: int = LENGTH, unit: int = UNIT, end: int = END) -> DataFrame:
    """Cuts and packs documents (doc_id, text) with the tokenizer file at path."""
    return packed(staged(pieces(docs, path, length, end), "pieces"), length, unit)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each piece of a document, with the sequence that holds it and its offset there."""
    return pack(read(spark, sf_dir, "documents"), tokenizer_path())
