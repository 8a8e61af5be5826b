"""Operator 4: near-duplicate documents by chosen-path set similarity join.

A document's set is its distinct word shingles; documents are linked if their sets' Jaccard similarity
is at least 0.85 (100 * intersection >= 85 * union), and a class is a connected component.

1. One pass hashes each text's shingles to a digest of the whole set and to COORDS minwise tokens.
   Documents with equal sets become one record before anything is joined.
2. TREES independent trees branch the records: at a node, a record goes to the children of those of
   its minwise tokens whose hash with the node is below 1 / (similarity * COORDS), so that two records
   at the similarity share a child of each common node once on average. A node of at most LEAF
   records is a leaf. A pair at the similarity shares a first-level node of a tree with probability
   0.63, so TREES trees miss one in 10^6 of them, fewer of more alike ones, and only count where no
   other path connects them.
3. In each leaf, all records are compared by their minwise tokens, and a spanning forest leaves it of the
   pairs that may be linked (share of equal tokens at least LOOSE, 4.7 standard deviations below).
4. A larger node's records are compared with PIVOTS of them. Those that may be linked with a pivot are in
   one candidate group with it and need not be compared with each other here: what group a record is in
   is all that the next step wants. As Jaccard distances obey the triangle inequality, a record outside
   that is linked with one inside agrees with its pivot in BAND at least, and in no more than MARGIN less
   than that one does (both leave two standard deviations for each estimate). All such pairs
   are compared, in blocks, where the small buckets of a node's pivots are met together. Records that no
   pivot takes branch on to the next level, and what is left of a large node after DEPTH levels is
   compared in blocks.
5. The forest's components are candidate groups. Records of a group come together with their full sets
   (made anew from the texts) and are compared exactly, except pairs that are connected already. In a
   group of over BLOCK records all are compared exactly with PIVOTS of them; those outside the largest
   class that this gives are compared with all records of similar sizes, in blocks. So a group of very
   many copies takes work in proportion to its size. Components of the confirmed links are the result.

Defined results: a null or blank text has an empty set and is linked with nothing; with fewer words
than a shingle's, all words are one shingle. Rows that repeat an id are told apart by their sets: those
with equal sets are one document and give as many equal rows, others have each the class of its own
set. Rows with a null id are each a class of their own. Any other columns are kept by deduplicated(),
which keeps one row of those that repeat both id and set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartwright.llm.common import OFTEN, connected_components, give_back, joined, lean, read, slices, small_batches, staged, whole_groups

WORDS, SIMILAR = 5, 85
COORDS, TREES, DEPTH, LEAF = 128, 16, 4, 600
LOOSE, BAND, MARGIN, PIVOTS = 0.70, 0.46, 0.27, 8
#: Equal tokens of a bucket in which records near a pivot are kept.
BUCKET = 8
#: Records of a block in the exact comparison, and bytes of their sets.
BLOCK, BLOCK_BYTES = 1000, 8 << 20
#: Bytes of texts hashed at once; records held at once for groups to be compared by tokens, by texts.
SLICE, HELD, HELD_TEXTS = 512 << 10, 4000, 500
#: Entries of pivots up to which nodes are broadcast.
FEW = 20_000

_rng = np.random.default_rng(20_240_601)
_MULTIPLY = (_rng.integers(1, 2**63, COORDS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_TREE = _rng.integers(1, 2**63, TREES, dtype=np.uint64)
_GOLD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    words = (text or "").encode().lower().split()
    h = xxhash.xxh3_64_intdigest
    if 0 < len(words) < n:
        return np.array([h(b" ".join(words))], dtype=np.uint64)
    w = np.fromiter((h(x) for x in words), np.uint64, len(words))
    if not len(w):
        return w
    s = np.zeros(len(w) - n + 1, dtype=np.uint64)
    for k in range(n):
        s = mixed((s + w[k : len(w) - n + 1 + k]) * _GOLD + np.uint64(k))
    return np.unique(s)


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def minwise(s: np.ndarray) -> np.ndarray:
    """For each coordinate the least of the set's hashes under its own hash function, 32 bits of it."""
    out = np.full(COORDS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(s), 4096):
        np.minimum(out, (s[k : k + 4096, None] * _MULTIPLY[None, :]).min(axis=0), out=out)
    return (mixed(out) >> np.uint64(32)).astype(np.uint32)


def children(tokens: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children that records (rows of tokens) go to, from their nodes (a row of nodes for each record): the records' numbers and the children."""
    own = mixed(np.arange(1, COORDS + 1, dtype=np.uint64)[None, :] * _GOLD + tokens.astype(np.uint64))
    at = mixed(own[:, None, :] ^ nodes[:, :, None])
    record, tree, coordinate = np.nonzero(at < np.uint64(int(2**64 / (SIMILAR / 100 * COORDS))))
    return record, mixed(at[record, tree, coordinate] + _GOLD)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of tokens."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, COORDS)


def equal_tokens(tokens: np.ndarray, columns: np.ndarray, i: int, lo: int) -> np.ndarray:
    """How many of its tokens record i has in common with each from lo on; columns is tokens transposed, for many records."""
    if len(tokens) - lo < 100:
        return (tokens[lo:] == tokens[i]).sum(axis=1)
    same = np.zeros(len(tokens) - lo, dtype=np.uint8)
    for c in columns:
        same += c[lo:] == c[i]
    return same


def records(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, h, n_shingles, digest, tokens): h is the text's hash, tokens the minwise tokens' bytes; digest and tokens are null for an empty set."""
    small_batches(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in (part for whole in batches for part in slices(whole, "text", SLICE)):
            sets = [shingles(t) for t in b.column("text").to_pylist()]
            digests = [digest(s) if len(s) else None for s in sets]
            tokens = [minwise(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(map(len, sets), pa.int64()), pa.array(digests, pa.binary()), pa.array(tokens, pa.binary())], ["doc_id", "h", "n_shingles", "digest", "tokens"])
            del sets, digests, tokens
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(make, "doc_id long, h long, n_shingles long, digest binary, tokens binary")


def started(rows: DataFrame) -> DataFrame:
    """Rows (id, node): the first level of all trees for rows (id, tokens)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 128):
                b = whole.slice(k, 128)
                ids = b.column("id").to_numpy(zero_copy_only=False)
                record, got = children(matrix(b.column("tokens")), np.broadcast_to(_TREE, (len(ids), TREES)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[record], pa.int64()), pa.array(got.view(np.int64), pa.int64())], ["id", "node"])

    return rows.mapInArrow(go, "id long, node long")


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def spanning(ids: np.ndarray, tokens: np.ndarray, split: int = 0) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose share of equal tokens is at least LOOSE; with split > 0 only pairs across it."""
    forest, out, n = Forest(len(ids)), [], len(ids)
    least = int(np.ceil(LOOSE * COORDS))
    columns = np.ascontiguousarray(tokens.T) if n > 100 else tokens
    for i in range(split or n):
        lo = split or i + 1
        if lo >= n:
            break
        same = equal_tokens(tokens, columns, i, lo)
        for j in np.flatnonzero(same >= least) + lo:
            if forest.join(i, int(j)):
                out.append((int(ids[i]), int(ids[j])))
    return out


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    at = np.array(found, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1])], ["a", "b"])


def compared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (a, b): of each group of rows (keys, side, id, tokens) a spanning forest of the pairs that may be linked, only of those across sides if there are two. A group is a leaf, or two blocks of that size."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for t, bounds in whole_groups(batches, keys, HELD):
            ids, sides, tokens = t.column("id").to_numpy(), t.column("side").to_numpy(), matrix(t.column("tokens")).astype(np.uint16)
            sizes = np.diff(bounds)
            two = bounds[:-1][sizes == 2]
            near = two[(tokens[two] == tokens[two + 1]).sum(axis=1) >= int(np.ceil(LOOSE * COORDS))]
            found = list(zip(ids[near].tolist(), ids[near + 1].tolist(), strict=True))
            for k in np.flatnonzero(sizes > 2):
                a, e = int(bounds[k]), int(bounds[k + 1])
                split = int((sides[a:e] == 0).sum())
                found += spanning(ids[a:e], tokens[a:e], split if split < e - a else 0)
            yield _pairs(found)
        give_back()

    dealt = rows.select(*keys, "side", "id", "tokens").repartition(*keys).sortWithinPartitions(*keys, "side", "id")
    return dealt.mapInArrow(go, "a long, b long")


PEELED = "kind int, id long, node long, pivot long, other long, near array<struct<pivot: long, other: long>>"
EDGE, INSIDE, NEAR, CHILD, REST = range(5)


def peeled(rows: DataFrame, branch: bool) -> DataFrame:
    """What becomes of rows (node, block, side, id, tokens) of large nodes, side 0 being the pivots.

    Rows (PEELED) by kind: EDGE (id and pivot may be linked), INSIDE (a record that its best pivot takes,
    so that they may be linked; other: how many tokens they share), NEAR (a record that may be linked with
    ones that pivots take; near: all of those pivots, other: likewise), CHILD (a record that no pivot
    takes; node: its next one), or REST instead of CHILD unless branch. A record has one row at most of
    each kind but EDGE and CHILD, and an EDGE only to classes of pivots other than its best one's.
    """
    least, band = int(np.ceil(LOOSE * COORDS)), int(np.ceil(BAND * COORDS))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for t, bounds in whole_groups(batches, ["node", "block"], HELD):
            all_ids, sides, nodes, every = t.column("id").to_numpy(), t.column("side").to_numpy(), t.column("node").to_numpy(), matrix(t.column("tokens"))
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            near: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])

            def add(kind: int, ids: np.ndarray, node: np.ndarray | int, pivot: np.ndarray | int, other: np.ndarray | int, nears: np.ndarray | int = 0, out: list = out) -> None:
                for column, x in zip(out, (kind, ids, node, pivot, other, nears), strict=True):
                    column.append(np.broadcast_to(np.asarray(x, dtype=np.int64), len(ids)))

            for a, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                k = a + int((sides[a:e] == 0).sum())
                pivots, ids, node = all_ids[a:k], all_ids[k:e], nodes[a]
                of, tokens = every[a:k], every[k:e]
                among = (of[:, None, :] == of[None, :, :]).sum(axis=2)
                forest = Forest(len(pivots))
                for i, j in zip(*np.nonzero(np.triu(among >= least, 1)), strict=True):
                    forest.join(int(i), int(j))
                    add(EDGE, pivots[i : i + 1], node, pivots[j], 0)
                label = np.array([forest.root(i) for i in range(len(pivots))])
                same = np.stack([(tokens == p).sum(axis=1) for p in of], axis=1)
                best = same.argmax(axis=1)
                inside = same[np.arange(len(ids)), best] >= least
                mine = inside & ~np.isin(ids, pivots)
                add(INSIDE, ids[mine], node, pivots[best[mine]], same[mine, best[mine]])
                reach = same >= band
                for c in np.unique(label):
                    group = np.flatnonzero(label == c)
                    first = group[same[:, group].argmax(axis=1)]
                    known = same[np.arange(len(ids)), first] >= least
                    told = known & ~(mine & (first == best))
                    add(EDGE, ids[told], node, pivots[first[told]], 0)
                    reach[np.ix_(known, group)] = False
                by, (record, p) = reach.any(axis=1), np.nonzero(reach)
                add(NEAR, ids[by], node, 0, 0, reach[by].sum(axis=1))
                near[0].append(pivots[p])
                near[1].append(same[record, p])
                left = np.flatnonzero(~inside)
                if not branch:
                    add(REST, ids[left], node, 0, 0)
                for s in range(0, len(left) if branch else 0, 128):
                    part = left[s : s + 128]
                    record, got = children(tokens[part], np.full((len(part), 1), node, dtype=np.int64).view(np.uint64))
                    add(CHILD, ids[part][record], got.view(np.int64), 0, 0)
            if out[0]:
                kind, *others, nears = (np.concatenate(x) for x in out)
                pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in near], ["pivot", "other"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(nears)).astype(np.int32)), pairs)
                yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), *map(pa.array, others), lists], ["kind", "id", "node", "pivot", "other", "near"])
        give_back()

    dealt = rows.select("node", "block", "side", "id", "tokens").repartition("node", "block").sortWithinPartitions("node", "block", "side", "id")
    return dealt.mapInArrow(go, PEELED)


def _spot(column: str = "id") -> Column:
    return F.xxhash64(column, F.lit(11))


def _cuts(n: str, most: int) -> Column:
    return F.ceil(F.col(n) / most).cast("int")


def _other(cuts: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(cuts) - 1))


def across(left: DataFrame, right: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Rows (keys, lcut, rcut, side, id): the records of left (keys, id), side 0, and of right, side 1, in blocks of `most` rows, for each pair of blocks. Keys that one side lacks give none."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    sizes = count(left, "ln").join(count(right, "rn"), keys)
    cuts = staged(sizes.select(*keys, _cuts("ln", most).alias("lcuts"), _cuts("rn", most).alias("rcuts")), "cuts")
    one = joined(left.select(*keys, "id"), cuts, keys).select(*keys, F.pmod(_spot(), F.col("lcuts")).cast("int").alias("lcut"), _other("rcuts").alias("rcut"), F.lit(0).alias("side"), "id")
    two = joined(right.select(*keys, "id"), cuts, keys).select(*keys, _other("lcuts").alias("lcut"), F.pmod(_spot(), F.col("rcuts")).cast("int").alias("rcut"), F.lit(1).alias("side"), "id")
    return one.unionByName(two)


def with_pivots(rows: DataFrame, group: str) -> DataFrame:
    """Rows (group, block, side, id) for rows (group, blocks, id): each record in its block, side 1, and PIVOTS of a group's records in each of its blocks, side 0."""
    pivots = rows.groupBy(group, "blocks", F.pmod(_spot(), F.lit(PIVOTS)).alias("part")).agg(F.min(F.struct(_spot().alias("h"), "id")).alias("p"))
    top = pivots.select(group, _other("blocks").alias("block"), F.lit(0).alias("side"), F.col("p.id").alias("id"))
    return top.unionByName(rows.select(group, F.pmod(_spot(), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("side"), "id"))


def parts(taken: DataFrame, most: int) -> DataFrame:
    """Rows (node, pivot, bucket, part) for rows (node, pivot, bucket, id): buckets of a node are one part while those before in it have less than `most` records, so that others meet small buckets together, and once."""
    before = Window.partitionBy("node").orderBy("pivot", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = taken.groupBy("node", "pivot", "bucket").agg(F.count("*").alias("n"))  # PIVOTS * COORDS / BUCKET at most for a node
    return sizes.select("node", "pivot", "bucket", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / most).cast("int").alias("part"))


def candidates(recs: DataFrame) -> DataFrame:
    """Rows (a, b): a spanning forest, for each leaf of the trees, of the records (id, tokens) that may be linked."""
    tokens = recs.select("id", "tokens")
    found, level = None, started(tokens)
    for depth in range(DEPTH):
        level = staged(level, "level")
        sizes = level.groupBy("node").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("members")).where("n > 1")
        sizes = staged(sizes, "sizes")
        leaves = staged(sizes.where(F.col("n") <= LEAF).groupBy("n", "members").agg(F.min("node").alias("node")).select("node"), "leaves")  # leaves of equal members once
        part = compared(joined(level, leaves, "node").withColumn("side", F.lit(0)).join(tokens, "id"), ["node"])
        found = part if found is None else found.unionByName(part)
        big = sizes.where(F.col("n") > LEAF).select("node", _cuts("n", LEAF).alias("blocks"))
        if big.isEmpty():
            break
        members = with_pivots(staged(joined(level, big, "node", most=FEW), "large"), "node")
        of = staged(peeled(members.join(tokens, "id"), depth < DEPTH - 1), "peeled")
        taken = of.where(F.col("kind") == INSIDE).select("node", "pivot", "id", F.expr(f"other div {BUCKET}").cast("int").alias("bucket"))
        # a record near pivots meets only the parts in which they have a bucket within reach, each once
        shares = staged(parts(taken, LEAF), "parts")
        have = staged(shares.groupBy("node").agg(F.collect_list(F.struct("pivot", "bucket", "part")).alias("have")), "have")
        some = joined(of.where(F.col("kind") == NEAR).select("node", "id", "near"), have, "node")
        meets = f"array_distinct(flatten(transform(near, n -> transform(filter(have, x -> x.pivot = n.pivot AND x.bucket <= (n.other + {int(np.ceil(MARGIN * COORDS))}) div {BUCKET}), x -> x.part))))"
        near = staged(some.select("node", "id", F.explode(F.expr(meets)).alias("part")), "near")
        found = found.unionByName(of.where(F.col("kind").isin(EDGE, INSIDE)).select(F.col("id").alias("a"), F.col("pivot").alias("b")))
        if not near.isEmpty():
            edge = across(near, joined(taken, shares, ["node", "pivot", "bucket"]), ["node", "part"], LEAF)
            found = found.unionByName(compared(edge.join(tokens, "id"), ["node", "part", "lcut", "rcut"]))
        if depth == DEPTH - 1:
            rest = of.where(F.col("kind") == REST).select("node", "id")
            found = found.unionByName(compared(across(rest, rest, ["node"], LEAF).join(tokens, "id"), ["node", "lcut", "rcut"]))
        level = of.where(F.col("kind") == CHILD).select("id", "node")
    return found


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct numbers."""
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())


def confirmed(tasks: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (a, b): of each group of rows (keys, side, id) a spanning forest of the links, only of those across sides if there are two; texts: rows (id, digest, tokens, text)."""
    least = int(np.ceil(LOOSE * COORDS))

    def group(ids: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], tokens: np.ndarray) -> list[tuple[int, int]]:
        n = np.array([len(s) for s in sets])
        split = int((sides == 0).sum())
        split = split if split < len(ids) else 0
        columns = np.ascontiguousarray(tokens.T) if len(ids) > 100 else tokens
        forest, out = Forest(len(ids)), []
        for i in range(split or len(ids)):
            lo = split or i + 1
            if lo >= len(ids):
                break
            same = equal_tokens(tokens, columns, i, lo)
            near = np.flatnonzero((same >= least) & (100 * np.minimum(n[lo:], n[i]) >= SIMILAR * np.maximum(n[lo:], n[i])))
            for j in (near[np.argsort(-same[near].astype(int), kind="stable")] + lo).tolist():
                if forest.root(i) == forest.root(j):
                    continue
                both = shared(sets[i], sets[j])
                if 100 * both >= SIMILAR * (n[i] + n[j] - both):
                    forest.join(i, j)
                    out.append((int(ids[i]), int(ids[j])))
        return out

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for t, bounds in whole_groups(batches, keys, HELD_TEXTS):
            ids, sides, tokens = t.column("id").to_numpy(), t.column("side").to_numpy(), matrix(t.column("tokens")).astype(np.uint16)
            found = []
            for a, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                part = t.slice(a, e - a)
                sets, known, at = [], set(), []
                for i, (text, d) in enumerate(zip(part.column("text").to_pylist(), part.column("digest").to_pylist(), strict=True)):
                    if (key := (int(sides[a + i]), int(ids[a + i]))) not in known:
                        s = shingles(text)
                        if digest(s) == d:  # else another text of the same id
                            known.add(key)
                            sets.append(s)
                            at.append(a + i)
                found += group(ids[at], sides[at], sets, tokens[at])
            yield _pairs(found)
        give_back()

    dealt = tasks.join(texts, "id").select(*keys, "side", "id", "digest", "tokens", "text").repartition(*keys).sortWithinPartitions(*keys, "side", "id")
    return dealt.mapInArrow(go, "a long, b long")


def links(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (a, b): confirmed links that connect what is connected, among records of groups (id, component, n)."""
    whole = groups.groupBy("component").agg(F.count("*").alias("all"), (F.sum("n") * 8).alias("bytes"))
    blocks = F.greatest(_cuts("all", BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int"))
    large = staged(whole.where((F.col("all") > BLOCK) | (F.col("bytes") > BLOCK_BYTES)).select("component", blocks.alias("blocks")), "large")
    rows = groups.select("id", "component", "n")
    found = confirmed(joined(rows, large, "component", "left_anti").select("component", F.lit(0).alias("side"), "id"), texts, ["component"])
    if large.isEmpty():
        return found
    mine = staged(joined(rows, large, "component"), "members")
    star = staged(confirmed(with_pivots(mine, "component"), texts, ["component", "block"]), "stars")
    classes_ = connected_components(star).select(F.col("node").alias("id"), F.col("component").alias("sub"))
    tagged = staged(mine.join(classes_, "id", "left").withColumn("sub", F.coalesce("sub", "id")), "tagged")
    counts = tagged.groupBy("component", "sub").agg(F.count("*").alias("k"))
    giant = staged(counts.groupBy("component").agg(F.max(F.struct("k", "sub")).alias("g")).select("component", F.col("g.sub").alias("giant")), "giants")
    outside = staged(joined(tagged, giant, "component").where("sub <> giant").select("id", "component", "n"), "outside")
    found = found.unionByName(star)
    if outside.isEmpty():
        return found
    # sets can be similar only if they are of the same or of neighbouring steps of size
    step = F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / F.log(F.lit(100 / SIMILAR * (1 + 1e-9)))).cast("int")
    near = F.explode(F.array(step - 1, step, step + 1)).alias("step")
    inner = outside.select("component", step.alias("step"), "id")
    return found.unionByName(confirmed(across(inner, mine.select("component", near, "id"), ["component", "step"], BLOCK), texts, ["component", "step", "lcut", "rcut"]))


def labelled(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, h (the text's hash), digest (of its set, null if that is empty), n_shingles, component_id."""
    made = staged(records(docs), "records")
    known = made.where(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    sets = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("tokens").alias("tokens"), F.count("*").alias("copies"))
    recs = staged(sets.withColumn("id", F.monotonically_increasing_id()), "sets")
    forest = connected_components(candidates(recs)).select(F.col("node").alias("id"), "component")
    groups = staged(forest.join(recs.select("id", "doc_id", "n", "digest", "tokens"), "id"), "groups")
    kept = joined(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), groups.select("doc_id"), "doc_id", "left_semi").join(groups.select("doc_id", "id", "digest", "tokens"), "doc_id")
    texts = staged(kept.withColumn("h", F.xxhash64("text")).dropDuplicates(["id", "h"]).drop("doc_id", "h"), "texts")
    found = connected_components(links(groups, texts)).select(F.col("node").alias("id"), "component")
    least = staged(found.join(recs.select("id", "doc_id"), "id").groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    named = recs.select("id", "digest", "doc_id", "copies").join(joined(found, least, "component").select("id", "component_id"), "id", "left")
    # sets that one document alone has need no join; the most frequent ones are broadcast, 1 / OFTEN at most
    several = staged(named.where("copies > 1 OR component_id IS NOT NULL").select("digest", "copies", F.coalesce("component_id", "doc_id").alias("component_id")), "several")
    often = F.col("copies") >= F.lit(max(2.0, OFTEN * made.count()))
    hot, cold = several.where(often).select("digest", "component_id"), several.where(~often).select("digest", "component_id")
    rows = made.select("doc_id", "h", "digest", "n_shingles")
    alone = F.col("doc_id").isNull() | F.col("digest").isNull()
    frequent = rows.where(~alone).join(F.broadcast(hot), "digest")
    others = rows.where(~alone).join(F.broadcast(hot), "digest", "left_anti").join(cold, "digest", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return rows.where(alone).withColumn("component_id", F.col("doc_id")).unionByName(frequent.select(*rows.columns, "component_id")).unionByName(others.select(*rows.columns, "component_id"))


def classes(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept."""
    return labelled(docs).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents of which no other of their class has a smaller id, one row of those that repeat id and set; all their columns."""
    rows = staged(labelled(docs).where(F.col("doc_id").isNotNull() & F.col("digest").isNotNull()).select("doc_id", "h", "digest", "component_id"), "labelled")
    stays = rows.where("doc_id = component_id").groupBy("doc_id", "digest").agg(F.min("h").alias("h"), F.max("h").alias("last"), F.count("*").alias("k")).where("k > 1")
    stays = staged(stays, "repeated")
    a, b = rows.where("doc_id = component_id").alias("a"), stays.where("h <> last").alias("b")
    other = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.digest") == F.col("b.digest")) & (F.col("a.h") != F.col("b.h"))).select("a.doc_id", "a.h")
    gone = staged(rows.where("doc_id <> component_id").select("doc_id", "h").unionByName(other).distinct(), "gone")
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names that no other column has
    of = dict(zip(docs.columns, plain.columns, strict=True))
    keyed = plain.withColumn("doc_id", F.col(of["doc_id"]).cast("long")).withColumn("h", F.xxhash64(of["text"]))
    left = joined(keyed, gone, ["doc_id", "h"], "left_anti")
    if not stays.isEmpty():
        again = staged(stays.select("doc_id", "h"), "again")
        left = joined(left, again, ["doc_id", "h"], "left_anti").unionByName(joined(left, again, ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"]))
    return left.select(*(F.col(of[c]).alias(c) for c in docs.columns))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id and kept."""
    return classes(read(spark, sf_dir, "documents"))


OP4_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS y FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id, least(d.doc_id, coalesce(m.y, d.doc_id)) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.x = d.doc_id
"""
