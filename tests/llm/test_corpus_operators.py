"""Language, near duplicates, scores, decontamination, packing and the pipeline against brute force."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from chartwright.llm import common, decontaminate, fingerprints, language, neardup, packing, quotations, scoring


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def words(seed, n, size=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def near_copies():
    rows = []
    for g in range(8):
        stem = words(g, 120, 5000)
        for k in range(6):
            w, rng = list(stem), random.Random(100 * g + k)
            for _ in range(k % 4):
                w[rng.randrange(len(w))] = f"n{rng.random()}"
            rows.append((g * 10 + k, " ".join(w)))
    return [*rows, (900, None), (901, ""), (902, "a b"), (903, "A  B"), (904, "a b c"), (5, rows[5][1]), (None, rows[0][1])]


def classes(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    of = {i: i for i in sets}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for a, b in itertools.combinations([i for i in sets if i is not None], 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            of[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("local", [200_000, 3])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(common, "LOCAL", local)
    edges = [(1, 2), (2, 3), (3, 1), (7, 7), (9, 5), (5, 9), *((i, i + 1) for i in range(20, 40)), *((100, i) for i in range(101, 130))]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 9: 5, **{i: 20 for i in range(20, 41)}, **{i: 100 for i in range(100, 130)}}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("leaf,block", [(1500, 1000), (3, 4)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(neardup, "LEAF", leaf)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = near_copies()
    got = neardup.classes(docs(spark, rows)).collect()
    want = classes(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_id_with_several_texts(spark):
    a, b, c = (" ".join(words(s, 60, 9000)) for s in (1, 2, 3))
    rows = [(7, a), (7, b), (9, b), (9, a + " more"), (3, c), (3, c), (3, c.upper()), (4, None), (4, None), (None, c), (None, c)]
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in neardup.classes(docs(spark, rows)).collect())
    assert got == sorted([("7", 7, True)] * 2 + [("9", 7, False)] * 2 + [("3", 3, True)] * 3 + [("4", 4, True)] * 2 + [("None", None, True)] * 2)
    extra = docs(spark, rows).withColumn("h", F.lit(1)).withColumn("digest", F.lit("d")).withColumn("component_id", F.lit(0))
    kept = neardup.deduplicated(extra)
    assert kept.columns == extra.columns
    assert sorted((str(r.doc_id), (r.text or "").lower()) for r in kept.collect()) == sorted([("7", a), ("7", b), ("3", c), ("4", ""), ("4", ""), ("None", c), ("None", c)])


def test_large_groups_through_pivots(spark, monkeypatch):
    for name, value in (("LEAF", 12), ("BLOCK", 10), ("PIVOTS", 3)):
        monkeypatch.setattr(neardup, name, value)
    rows = []
    for g in range(3):  # a tight group, a looser one, and one that drifts
        stem = words(g, 150, 5000)
        for k in range(40):
            w, rng = list(stem), random.Random(1000 * g + k)
            for _ in range([1, 4, 0][g]):
                w[rng.randrange(len(w))] = f"n{rng.random()}"
            if g == 2:
                w = w[2 * k : 2 * k + 70]
            rows.append((g * 100 + k, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.classes(docs(spark, rows)).collect()}
    assert got == classes(rows)


def test_records_of_a_large_node_once_by_kind(spark):
    rng = np.random.default_rng(5)
    least, band, none = math.ceil(neardup.LOOSE * neardup.COORDS), math.ceil(neardup.BAND * neardup.COORDS), 2**32

    def changed(tokens, k):
        out = tokens.copy()
        out[rng.choice(neardup.COORDS, k, replace=False)] = rng.integers(0, none, k, dtype=np.uint32)
        return out

    stem = rng.integers(0, none, neardup.COORDS, dtype=np.uint32)
    pivots = {i: changed(stem, 45) for i in range(8)}
    others = {100 + i: changed(stem, 18) for i in range(60)} | {200 + i: changed(pivots[i % 3], 9) for i in range(30)} | {300 + i: changed(stem, 128) for i in range(10)}
    rows = [(-9, 0, 0, i, t.tobytes()) for i, t in pivots.items()] + [(-9, 0, 1, i, t.tobytes()) for i, t in (pivots | others).items()]
    got = neardup.peeled(spark.createDataFrame(rows, "node long, block int, side int, id long, tokens binary"), False).collect()
    same = {(i, p): int((t == of).sum()) for i, t in others.items() for p, of in pivots.items()}
    assert sum(band <= x < least for x in same.values()) == 60 * 8
    assert len(got) <= 2 * len(rows)  # not one row for each record and pivot
    near = {(r.id, n.pivot): n.other for r in got if r.kind == neardup.NEAR and r.id in others for n in r.near}
    assert near == {k: x for k, x in same.items() if band <= x < least}
    inside = {(r.id, r.pivot): r.other for r in got if r.kind == neardup.INSIDE}
    assert inside == {k: x for k, x in same.items() if x >= least} and len(inside) == 30
    assert {r.id for r in got if r.kind == neardup.REST} == set(others) - {i for i, _ in inside}


def test_small_buckets_of_a_node_are_one_part(spark):
    sizes = {(1, 1): {11: 3, 12: 4}, (1, 2): {14: 9, 15: 2}, (1, 3): {13: 30, 16: 1}, (2, 1): {12: 1}}
    taken = [(node, pivot, 1000 * b + i, b) for (node, pivot), of in sizes.items() for b, n in of.items() for i in range(n)]
    got = {(r.node, r.pivot, r.bucket): r.part for r in neardup.parts(spark.createDataFrame(taken, "node long, pivot long, id long, bucket int"), 10).collect()}
    assert got == {(1, 1, 11): 0, (1, 1, 12): 0, (1, 2, 14): 0, (1, 2, 15): 1, (1, 3, 13): 1, (1, 3, 16): 4, (2, 1, 12): 0}


def test_no_documents(spark):
    none = docs(spark, [])
    assert neardup.classes(none).count() == 0 and scoring.score(none, none).count() == 0
    assert packing.pack(none, packing.tokenizer_path()).count() == 0
    assert language.predict(none, language.fit(none), ["doc_id"]).count() == 0
    assert decontaminate.leaks(none, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(0)
    lengths = np.array([4, 0, 1, 3])
    scores = rng.normal(size=(8, 3)).astype(np.float32)
    got = language.viterbi(scores, lengths, 0.7)
    at = 0
    for n in lengths:
        s = scores[at : at + n]
        value = lambda p, s=s: sum(s[i, x] for i, x in enumerate(p)) - 0.7 * sum(a != b for a, b in itertools.pairwise(p))
        if n:
            best = max(value(p) for p in itertools.product(range(3), repeat=int(n)))
            assert abs(value(got[at : at + n]) - best) < 1e-5
        at += n


def test_language_of_mixed_texts(spark):
    rows = [(i, " ".join(random.Random(i).choices(["the", "and", "with", "house", "green"] if i % 2 else ["der", "und", "mit", "haus", "grün"], k=60)), "en" if i % 2 else "de", "clash") for i in range(60)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string, spans string")
    model = language.fit(train)
    test = spark.createDataFrame([(1, "the house and the house with the green and " * 3 + "der und das haus mit grün " * 2), (2, None), (3, "12 34 !"), (4, "und mit")], "doc_id long, text string")
    got = {r.doc_id: r for r in language.predict(test, model, ["doc_id"]).collect()}
    assert got[1].lang_pred == "en" and got[1].spans == "en:0:27,de:27:39" and 0 < got[1].score < 1
    assert got[2].lang_pred == got[3].lang_pred == "und" and got[4].lang_pred == "de"
    kept = language.accepted(test.withColumnRenamed("text", "text").selectExpr("doc_id", "text", "'x' as lang", "1 as score", "2 as spans"), model)
    assert kept.columns == ["doc_id", "text", "lang", "score", "spans"] and sorted(r.doc_id for r in kept.collect()) == [1, 4]


def test_word_scores_against_the_definition(spark):
    rows = [(1, "the house the", "en"), (2, "und haus", "de"), (3, "дом и", "ru"), (4, None, "en"), (5, "x", None)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en", "ru"]

    def grams(word):
        w = f"^{word}$"
        return [w[i : i + n] for n in range(2, language.GRAM + 1) for i in range(len(w) - n + 1)]

    of = {x: [g for _, t, lang in rows if lang == x and t for w in t.split() for g in grams(w)] for x in model.languages}
    alike = lambda a, b: np.array_equal(*(language.grams([x])[0] for x in (a, b)))
    assert not alike("the", "haus")
    for word, kind in (("house", 1), ("дом", 3), ("zzz", 1)):
        p = np.array([[math.log((of[x].count(g) + 0.5) / (len(of[x]) + 0.5 * language.BUCKETS)) for x in model.languages] for g in grams(word)])
        want = (p - p.mean(axis=1, keepdims=True)).sum(axis=0) / (language.GRAM - 1)
        want[[kind not in ([1] if x != "ru" else [3]) for x in model.languages]] = -20
        assert np.allclose(model.words([word])[0], want, atol=1e-4)


def test_letters_ties_and_many_languages(spark):
    assert [language.letters(x) for x in ("½²①", "Straße,", "1a²b", "Σίσυφος")] == ["", "straße", "ab", "σίσυφος"]
    rows = [(i, "aa bb cc", f"l{i % 3}") for i in range(9)] + [(100 + i, chr(0x4E00 + i) * 3, f"x{i:03}") for i in range(200)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    test = spark.createDataFrame([(1, "aa bb"), (2, "½²①"), (3, chr(0x4E00 + 150) * 3), (4, ""), (None, "aa")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(test, model, ["doc_id"]).collect()}
    assert got[1][0] == "l0" and got[2] == ("und", 0) and got[3][0] == "x150" and got[4] == ("und", 0) and got[None][0] == "l0"


def test_held_out_language(spark):
    found = language.op3_language(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found) > 0


def by_recursion(counts, depth, context, byte):
    """Predictive probability of a byte after a context, straight from the definition; unseen contexts of a node are one child."""

    def bits(c, node):
        zero = sum(n for s, n in c.items() if (s | 256) >> (7 - (node.bit_length() - 1)) == 2 * node)
        one = sum(n for s, n in c.items() if (s | 256) >> (7 - (node.bit_length() - 1)) == 2 * node + 1)
        return zero, one

    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(ctx, node):
        own = kt(*bits(counts[ctx], node))
        if len(ctx) == depth:
            return own
        kids = [c for c in counts if len(c) == len(ctx) + 1 and c[1:] == ctx]
        rest = dict(counts[ctx])
        for k in kids:
            for s, n in counts[k].items():
                rest[s] -= n
        return float(np.logaddexp(own, kt(*bits(rest, node)) + sum(weighted(k, node) for k in kids))) - math.log(2)

    def one(ctx, node):
        a, b = bits(counts[ctx], node)
        p = (b + 0.5) / (a + b + 1)
        if len(ctx) == depth:
            return p
        deeper = context[len(context) - len(ctx) - 1 :]
        if deeper in counts:
            q = one(deeper, node)
        else:
            rest = dict(counts[ctx])
            for k in counts:
                if len(k) == len(ctx) + 1 and k[1:] == ctx:
                    for s, n in counts[k].items():
                        rest[s] -= n
            a, b = bits(rest, node)
            q = (b + 0.5) / (a + b + 1)
        w = math.exp(kt(*bits(counts[ctx], node)) - math.log(2) - weighted(ctx, node))
        return w * p + (1 - w) * q

    p, node = 1.0, 1
    for k in range(7, -1, -1):
        b = byte >> k & 1
        p *= one(b"", node) if b else 1 - one(b"", node)
        node = 2 * node + b
    return p


def test_context_tree_against_the_definition(spark):
    texts = [b"abcabc", b"abd"]
    counts = {}
    for t in texts:
        s = bytes(scoring.DEPTH) + t + b"\0"
        for i in range(scoring.DEPTH, len(s)):
            for d in range(scoring.DEPTH + 1):
                c = counts.setdefault(s[i - d : i], {})
                c[s[i]] = c.get(s[i], 0) + 1
    grams = scoring.counted(spark.createDataFrame([(t.decode(),) for t in texts], "text string"))
    tree = scoring.tree(grams)
    text = b"abx"
    s = bytes(scoring.DEPTH) + text + b"\0"
    want = sum(math.log10(by_recursion(counts, scoring.DEPTH, s[i - scoring.DEPTH : i], s[i])) for i in range(scoring.DEPTH, len(s)))
    assert abs(tree.scores([text])[0] - want) < 1e-4
    assert np.allclose((10.0 ** tree.table.astype(float)).sum(axis=1), 1, atol=1e-4)


@pytest.mark.parametrize("grams", [1 << 20, 3])
def test_scores_of_rare_contexts(spark, monkeypatch, grams):
    monkeypatch.setattr(scoring, "GRAMS", grams)  # 3: most n-grams go through the join
    monkeypatch.setattr(scoring, "WEIGHTED", 5)
    train = ["ab" * 6000, "xyzxyw"]  # contexts of the second are rarer than 1 in 8,192
    counts = {}
    for t in train:
        s = bytes(scoring.DEPTH) + t.encode() + b"\0"
        for i in range(scoring.DEPTH, len(s)):
            for d in range(scoring.DEPTH + 1):
                c = counts.setdefault(s[i - d : i], {})
                c[s[i]] = c.get(s[i], 0) + 1
    test = ["xyzxyw", "abab", "xyq", "", "éxyw"]
    frame = lambda texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in scoring.score(frame(test), frame(train)).collect()}
    tree = scoring.tree(scoring.counted(frame(train)))
    for i, t in enumerate(test):
        s = bytes(scoring.DEPTH) + t.encode() + b"\0"
        want = sum(math.log10(by_recursion(counts, scoring.DEPTH, s[k - scoring.DEPTH : k], s[k])) for k in range(scoring.DEPTH, len(s)))
        assert abs(got[i] - want) < 1e-6 and abs(tree.scores([t.encode()])[0] - want) < 1e-3


def test_base_scores(spark, monkeypatch):
    monkeypatch.setattr(scoring, "WORDS", 3)  # most words are rare, and go through the join
    train = [(1, "a b a B"), (2, None), (3, "c " + "z" * 40)]
    test = [*train, (4, "a z q q"), (4, "a z q q"), (None, "")]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    counts = {}
    for _, t in train:
        for w in [*(t or "").lower().split(), "\0"]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    got = scoring.score(frame(test), frame(train)).collect()
    assert len(got) == len(test)
    for r in got:
        t = dict(test)[r.doc_id]
        ws = [*(t or "").lower().split(), "\0"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in counts for w in ws), n)
        assert abs(r.base_score - sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) < 1e-9


def test_frequent_long_words_are_known(spark):
    long, other = "z" * 17, "й" * 9  # keyed by their hashes, and at least as frequent as 1 in WORDS
    train = spark.createDataFrame([(1, f"{long} a {other} {long}")], "doc_id long, text string")
    r = scoring.score(spark.createDataFrame([(2, f"{long.upper()} {other} {long}x")], "doc_id long, text string"), train).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (4, 3, 5)
    assert abs(r.base_score - sum(math.log10((c + 0.5) / (5 + 0.5 * 5)) for c in (2, 1, 0, 1))) < 1e-9


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_leaks_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "SIGNATURE_BROADCAST", limit)
    items = [(i, " ".join(words(50 + i, n))) for i, n in enumerate([3, 5, 9, 20, 40, 0])] + [(9, None)]
    texts = []
    for i, (_, t) in enumerate(items):
        w = (t or "").split()
        texts.append((10 * i, " ".join(words(i, 300) + w + words(i + 1, 200))))
        for cut in (1, 2, 4, 8):
            texts.append((10 * i + cut, " ".join(words(i, 30) + w[:-cut]).upper() + "!"))
    texts += [(998, None), (999, ""), (0, texts[0][1])]

    def shingled(t, n):
        w = decontaminated_words(t)
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}

    def decontaminated_words(t):
        import re

        return re.findall(r"[^\W_]+", (t or "").lower())

    want = set()
    for (d, t), (i, q) in itertools.product(texts, items):
        n = min(5, len(decontaminated_words(q)))
        if n:
            s = shingled(q, n)
            if len(s & shingled(t, n)) >= 0.8 * len(s) - 1e-9:
                want.add((d, i, len(s), len(s & shingled(t, n))))
    got = decontaminate.leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.m, r.shared) for r in got} == want and len(got) == len(want)


def test_packing_is_exact(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    rng = random.Random(4)
    pool = "aAbBjJhHtTwWyY \t\nΣσςİıK'’.,-_()09½²ªº\u0331\u0323\u030c\u0308\u1dcd\xa0\x85\x1c<|>éÉßẞ&%$#한中カ"
    odd = ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 40))) for _ in range(400)] + ["J\u030c", "H\u0331 T\u0308", "<|endoftext|> A<|startoftext|>B", "<|ENDOFTEXT|>", "don't I'LL 'tis we've,'", "\"It's\" ..."]
    texts = [(i, " ".join(words(i, 5 + 37 * (i % 23)))) for i in range(80)] + [(100, None), (101, ""), (102, " ".join(words(1, 5000)) + "\té\n x"), (3, "again"), (None, "no id")] + [(1000 + i, t) for i, t in enumerate(odd)]
    clash = docs(spark, texts).withColumn("length", F.lit("x")).withColumn("sequence_id", F.lit(0))
    got = packing.pack(clash, packing.tokenizer_path()).toPandas()
    ids = {}
    for d, t in texts:
        ids.setdefault(d, []).append([*tok.encode(t or "", add_special_tokens=False).ids, 2])
    crc = lambda x: zlib.crc32(np.array(x, dtype="<u4").tobytes())
    pieces = lambda d, x: [(d, s, len(x[s : s + packing.LENGTH]), crc(x[s : s + packing.LENGTH]), len(x)) for s in range(0, len(x), packing.LENGTH)]
    want = sorted((p for d, xs in ids.items() for x in xs for p in pieces(-1 if d is None else d, x)))
    assert sorted(zip(got.doc_id.fillna(-1).astype(int), got.start, got.length, got.ids_crc32, got.doc_tokens, strict=True)) == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= packing.LENGTH


def test_inverse_without_a_library():
    m = np.random.default_rng(2).integers(0, 9, (40, 40)).astype(float) + np.eye(40) * 3
    assert np.allclose(packing.inverted(m) @ m, np.eye(40), atol=1e-8)


def test_knapsack_and_plan():
    rng = np.random.default_rng(1)
    values = rng.random(12)
    value, counts = packing.knapsack(values, 12)
    assert abs(value - counts @ values) < 1e-9 and (counts * np.arange(1, 13)).sum() <= 12
    best = max(sum(values[s - 1] for s in p) for n in range(5) for p in itertools.combinations_with_replacement(range(1, 13), n) if sum(p) <= 12)
    assert value >= best - 1e-9
    demand = rng.integers(0, 40, 64)
    rows = packing.plan(demand)
    for s in range(1, 65):
        mine = sorted(r for r in rows if r[0] == s)
        assert sum(r[2] for r in mine) == demand[s - 1] and [r[1] for r in mine] == list(np.cumsum([0, *(r[2] for r in mine)])[:-1])[: len(mine)]
    sequences = max(r[4] + r[2] // r[3] for r in rows)
    assert sequences <= packing.patterns(demand.astype(float))[1].sum() * 1.02 + 8  # the linear program's optimum bounds any plan from below


def test_pipeline_of_nothing(spark, tmp_path):
    docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rows = near_copies()[:12] + [(500, "!!! 123"), (501, None), (502, " ".join(words(77, 80))), (503, "my password=abcdefghijkl0123 " + " ".join(words(78, 60, 9000)))]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(words(77, 80)[10:50]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, at, str(tmp_path))
        assert out.columns == at.columns
        out.write.parquet(str(tmp_path / f"s{k}"))
        at = spark.read.parquet(str(tmp_path / f"s{k}"))
        kept.append({r.doc_id for r in at.collect()})
    keep = {i for i, (_, c) in classes(rows[:12]).items() if i == c}
    assert kept[0] == {i for i, _ in rows} - {500, 501} and kept[1] == keep | {502, 503} and kept[2] == keep | {503} == kept[3]
    text = at.where("doc_id = 503").first()
    assert text.text.startswith("my [SECRET] ") and text.n_chars == len(text.text)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept[3]


def test_very_long_texts_nulls_and_clashing_columns(spark):
    long = "word " * 300_000
    rows = [(1, long), (2, long + "x"), (None, "a"), (3, ""), (4, None)]
    extra = ["h", "row", "digest", "component_id", "base", "spans", "lang_pred", "score", "sequence_id", "m", "w", "sh", "item_id"]
    df = docs(spark, rows).select("*", *(F.lit("clash").alias(c) for c in extra))
    assert {(r.doc_id, r.lang_pred) for r in language.predict(df, language.fit(df), ["doc_id"]).collect()} == {(1, "x"), (2, "x"), (None, "x"), (3, "und"), (4, "und")}
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in neardup.classes(df).collect()} == {(1, 1, 1), (2, 2, 2), (None, 1, None), (3, 0, 3), (4, 0, 4)}
    assert {(r.doc_id, r.n_tokens, r.n_known) for r in scoring.score(df, df).collect()} == {(1, 300_001, 300_001), (2, 300_002, 300_002), (None, 2, 2), (3, 1, 1), (4, 1, 1)}
    items = spark.createDataFrame([(7, "Word word, word WORD word word", "clash")], "item_id long, text string, h string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, items).collect()} == {(1, 7), (2, 7)}
    left = decontaminate.decontaminated(df, items)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {None, 3, 4}
    assert packing.pack(df, packing.tokenizer_path()).groupBy("doc_id").agg(F.sum("length").alias("n")).where("doc_id = 1").first().n == 300_001
    talk = spark.createDataFrame([(1, 0, long.strip()), (1, 1, "> " + long.strip() + "\nyes"), (1, 2, None)], "conv_id long, turn long, text string").select("*", F.lit("clash").alias("message"), F.lit(0).alias("depth"))
    assert {(r.turn, r.parent_turn, r.depth) for r in quotations.conversations(talk).collect()} == {(0, None, 0), (1, 0, 1), (2, None, 0)}
    sums = fingerprints.with_fingerprints(df.select("doc_id", "text"), ["text"])
    assert sums.where("doc_id = 1").first().text_sums[-1] == 1
