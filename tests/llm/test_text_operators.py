"""Archives, secrets, fingerprints, personal data and quotations against plain Python."""

import base64
import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from chartwright.llm import archives, fingerprints, privacy, quotations, secrets
from chartwright.llm import spans as S


def test_arc_versions_and_dates():
    body = b"HTTP/1.1 200 OK\r\nX-Record-Key: 7\r\n\r\nhello\nworld"
    one = b"filedesc://a 0.0.0.0 20010203 text/plain 11\n1 0 x\nline\n\nhttp://a b/ 1.2.3.4 20010203040506 text/html %d\n" % len(body) + body + b"\n"
    two = b"filedesc://a 0.0.0.0 20010203 text/plain 200 - - 0 f 6\n2 0 x\n\nhttp://a/ 1.2.3.4 20010203040506 text/html 200 - - 0 f %d\n" % len(body) + body + b"\n"
    for data in (one, two):
        ((_, r),) = archives.parse_arc(data)
        assert r["payload"] == b"hello\nworld" and r["ip"] == "1.2.3.4"
    assert archives.iso_date("20010203040506") == "2001-02-03T04:05:06Z" and archives.iso_date("2001") == "2001-01-01T00:00:00Z"


def test_archives_round_trip(spark, tmp_path):
    pages = [(1, "u", "é<p>"), (2, None, "é<p>"), (3, "u v", None), (4, "w", ""), (5, "x", "y\r\n\r\nWARC/1.1\r\n\r\n"), (None, "z", "é<p>"), (1, "u", "é<p>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("record_id", F.lit("clash")).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((tuple(r) for r in archives.op1_warc(spark, str(tmp_path)).collect()), key=str)
    dig = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [(1, 5, dig("é<p>"), "revisit", 2)] * 2 + [(2, 5, dig("é<p>"), "response", None), (3, 0, dig(""), "revisit", 4), (4, 0, dig(""), "response", None), (5, 17, dig(pages[4][2]), "response", None), (None, 5, dig("é<p>"), "response", None)]
    assert got == sorted(want, key=str)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    for op in (archives.op1_warc, secrets.op2_secrets, fingerprints.op5_fingerprints, privacy.op8_pii, quotations.op9_quotations):
        assert op(spark, str(tmp_path)).count() == 0


TEXTS = [
    None,
    "",
    "é password = 'abcdefghijkl' and secret=token:abcdefghijklmnop",
    "API_KEY:\"0123456789abcdef01\" AKIA0123456789ABCD AKIASHORT deadbeefdeadbeef",
    "key Zk9vQ2x1Wm5Xb3BtR3R5N0hqS2w4 end, id 123e4567-e89b-12d3-a456-426614174000",
    "a@b.c@d.e x a@b.c_d@e.f y Über@host.org +1 (736) 555-2678 +123 1.2.3.4.5 300.1.2.3 001.2.3.255",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 5500005555555559 1",
    "x" * 40_000 + " 9.9.9.9",
]


def base(patterns, text):
    return [(m.start(), m.end(), k) for k, (p, ok) in enumerate(patterns) for m in re.finditer(p, text or "") if ok(m)]


def luhn(s):
    ds = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(ds)) % 10 == 0


def test_secrets_against_python(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, kind string")
    rules = [(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 12), (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), (r"[0-9a-f]+", lambda m: len(m[0]) >= 16)]
    for r in secrets.with_secrets(df).collect():
        assert [(s.start, s.end, s.kind) for s in r.secret_base] == sorted(base(rules, r.text), key=lambda s: (s[0], s[2]))
    found = {r.doc_id: [s.text for s in r.secret_spans if s.kind > 2] for r in secrets.with_secrets(df).collect()}
    assert found[4] == ["Zk9vQ2x1Wm5Xb3BtR3R5N0hqS2w4"] and not found[7]
    clean = {r.doc_id: r.text for r in secrets.redacted(df).collect()}
    assert clean[0] is None and clean[7] == TEXTS[7] and clean[4].startswith("key [SECRET] end") and "AKIASHORT" in clean[3]


def test_window_entropy_by_counts(spark):
    from collections import Counter
    from math import log2

    text = "aaaaaaaaaaaaaaaaaaaaaabcdefghij0123456789zzzzzzzzzzzzzzzzzzzz"
    entropy = lambda s: -sum(c / 20 * log2(c / 20) for c in Counter(s).values())
    high = [i for i in range(len(text) - 19) if entropy(text[i : i + 20]) >= 3.8]
    got = spark.createDataFrame([(text,), ("short",)], "t string").select(secrets.hot_range(F.col("t"), 20, 3.8).alias("r")).collect()
    assert (got[0].r.first, got[0].r.last) == (high[0], high[-1] + 20) and got[1].r.first is None


def test_personal_data_against_python(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    digits = lambda m: len(re.sub("[^0-9]", "", m[0]))
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= digits(m) <= 19 and luhn(m[0])),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= digits(m) <= 15),
    ]
    found = {r.doc_id: r for r in privacy.sanitised(df).collect()}
    for i, t in enumerate(TEXTS):
        assert [(s.start, s.end, s.kind) for s in found[i].base] == sorted(base(rules, t), key=lambda s: (s[2], s[0])), t


def test_disclosing_terms(spark):
    texts = ["write to Quillon at q@x.org today"] * 1 + ["ask Quillon via q@x.org now", "Quillon uses q@x.org daily"] + ["write to them at the office today"] * 200 + ["ask now daily uses via"] * 50
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [s.text for s in r.added] for r in privacy.sanitised(df).collect()}
    assert [found[i] for i in range(3)] == [["quillon"]] * 3 and not any(found[i] for i in range(3, len(texts)))
    row = privacy.sanitised(df).where("doc_id = 0").join(df, "doc_id")
    text = row.select(privacy.clean_text(F.col("text"), F.concat("base", "added"), {"quillon": "a person"}).alias("t")).first().t
    assert text == "write to a person at [EMAIL] today"
    assert row.select(privacy.clean_text(F.col("text"), F.concat("base", "added")).alias("t")).first().t == "write to  at [EMAIL] today"


def test_disclosing_terms_of_whole_documents(spark):
    far = "write to them at the office today " * 20
    texts = [f"Quillon {far} q@x.org, Quillon5@x.org {far}QUILLON", f"q@x.org {far}", *["write to them at the office today"] * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [(s.start, s.end, s.text) for s in r.added] for r in privacy.sanitised(df).collect()}
    assert found[0] == [(0, 7, "quillon"), (len(texts[0]) - 7, len(texts[0]), "quillon")] and not any(found[i] for i in range(1, len(texts)))
    every = spark.createDataFrame([(1, "call q@x.org")], "doc_id long, text string")  # an entity that all hold tells nothing
    assert privacy.sanitised(every).first().added == []


def test_fingerprints_add_and_subtract(spark):
    one, two = "First line. Second one!\nThird\n\nThird", "Third\nAnother. First line."
    df = spark.createDataFrame([(one, two, one + "\n" + two)], "a string, b string, both string")
    sums = fingerprints.with_fingerprints(df, ["a", "b", "both"])
    a, b, both = F.col("a_sums"), F.col("b_sums"), F.col("both_sums")
    row = sums.select((fingerprints.add_fingerprints(a, b) == both).alias("x"), (fingerprints.subtract_fingerprints(both, b) == a).alias("y"), a.alias("a")).first()
    assert row.x and row.y
    want = [0] * fingerprints.WIDTH + [0]
    for p in ["First line.", "Second one!", "Third", "Third"]:
        want[-1] += 1
        for w in range(fingerprints.WORDS):
            h = xxhash.xxh64_intdigest(p.encode(), xxhash.xxh64_intdigest(w.to_bytes(4, "little"), 42))
            for k in range(fingerprints.SHIFTS):
                want[w * fingerprints.SHIFTS + k] += (h >> k) & fingerprints.ONES
    assert row.a == want


def test_fingerprints_of_documents(spark, tmp_path):
    texts = [(1, "One. Two.\nThree. Four."), (2, "Four. Three.\nTwo. One."), (5, None), (9, "é"), (3, "One. Two.\nThree. Four."), (3, "One. Two.\nThree. Four.")]
    spark.createDataFrame([(d, t, 1) for d, t in texts], "doc_id long, text string, h int").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(fingerprints.op5_fingerprints(spark, str(tmp_path)).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == [1, 2, 3, 3, 5, 9]
    assert got[0].fingerprint == got[1].fingerprint == got[2].fingerprint and got[0].near_next == 1 and got[0].near_edited == 1  # its last quarter is the beginning of the next
    order = [texts[0], texts[1], texts[4], texts[2], texts[3]]
    for k, (d, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % 5][1] or ""
        q = len(t) // 4
        assert {r.edited_sha256 for r in got if r.doc_id == d} == {hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()}


def test_quotes(spark):
    first, second = "Shall we meet?\nAt nine.", "Yes, at nine."
    rows = [(1, 0, first), (1, 1, "Ann wrote:\n> SHALL we meet?\n> At nine.\n\n" + second), (1, 2, "> > Shall we meet?\n> > At nine.\n>\n> Yes, at nine.\n\nGood."), (1, 3, "> Nobody said this\nAlone"), (2, 0, None), (2, None, "> x"), (None, 1, "y"), (3, 1, "> Shall we meet? At nine.\nOther thread")]
    got = {(r.conv_id, r.turn): (r.body, r.parent_turn, r.root_turn, r.depth) for r in quotations.conversations(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert got[1, 0] == (first, None, 0, 0) and got[1, 1] == (second, 0, 0, 1) and got[1, 2] == ("Good.", 1, 0, 2)
    assert got[1, 3] == ("Alone", None, 3, 0) and got[2, 0] == ("", None, 0, 0) and got[3, 1] == ("Other thread", None, 1, 0)
    assert quotations.lines_of("a\n> b\n>> c\n > > d") == [(0, "a"), (1, "b"), (2, "c"), (2, "d")]


def test_spans_at_ends(spark):
    got = spark.createDataFrame([("aéa",), (None,)], "t string").select(S.find(F.col("t"), "a", 0).alias("s")).collect()
    assert [(x.start, x.end) for x in got[0].s] == [(0, 1), (2, 3)] and not got[1].s


def test_damaged_archives(spark, tmp_path):
    import gzip

    def record(url, body, length=None):
        return f"{url} 1.2.3.4 20010203040506 text/html {length or len(body)}\n".encode() + body + b"\n"

    head = b"filedesc://a 0.0.0.0 20010203 text/plain 11\n1 0 x\nline\n\n"
    good = b"HTTP/1.1 200 OK\r\nX-Record-Key: 7\r\n\r\nhello"
    data = head + record("http://a/", good) + b"not a head at all\n" + record("http://b/ c", b"x") + b"http://c/ 1.2.3.4 2001x text/html 3\nabc\n" + "http://d/ 1.2.3.4 20010203 text/ä 2\n".encode("latin-1") + b"yz\n" + record("http://e/", b"cut", 999)
    got = [(r["url"], r["payload"]) for _, r in archives.parse_arc(data)]
    assert got == [("http://a/", b"hello"), ("http://b/ c", b"x"), ("http://d/", b"yz")]
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "one.arc").write_bytes(data)
    whole = gzip.compress(head + record("http://f/", b"first"))
    bad = bytearray(gzip.compress(record("http://g/", b"second")))
    bad[15] ^= 0xFF
    (tmp_path / "arc" / "two.arc.gz").write_bytes(whole + bytes(bad) + gzip.compress(record("http://h/", b"third")))
    found = {r.url for r in archives.read_arc(spark, f"file://{tmp_path}/arc").collect()}
    assert {"http://a/", "http://b/ c", "http://d/", "http://f/", "http://h/"} <= found
    skipped = [(r.archive, r.reason) for r in archives.skipped_arc(spark, f"file://{tmp_path}/arc").collect()]
    assert sorted(x for a, x in skipped if a == "one.arc") == ["no head", "no head", "record cut short"] and any("gzip" in x for a, x in skipped if a == "two.arc.gz")
    assert archives.convert(spark, f"file://{tmp_path}/arc", f"file://{tmp_path}/warc").count() >= 5


def test_long_texts_of_many_matches(spark):
    import time

    n = 20_000
    text = "a@b.cd +1 (736) 555-2678 deadbeefdeadbeef " * n
    blob = "".join(chr(97 + (i * 7919 >> 3) % 26) + str(i % 10) + chr(65 + i * 31 % 26) for i in range(40_000))
    df = spark.createDataFrame([(1, text), (2, blob)], "doc_id long, text string")
    began = time.time()
    row = df.where("doc_id = 1").select(F.size(privacy.base_spans(F.col("text"))).alias("n"), F.size(secrets.base_spans(F.col("text"))).alias("k"), privacy.clean_text(F.col("text"), privacy.base_spans(F.col("text"))).alias("t")).first()
    assert (row.n, row.k) == (2 * n, n) and row.t == "[EMAIL] [PHONE] deadbeefdeadbeef " * n
    (span,) = df.where("doc_id = 2").select(secrets.entropy_spans(F.col("text"), 1).alias("s")).first().s
    assert span.start < 100 and span.end > len(blob) - 100
    assert time.time() - began < 120  # seconds where the work is linear, hours where each match copies those before


def test_columns_that_clash(spark):
    rows = [(1, "my password=abcdefghijkl0123 ok", "a", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __base string, __spans string")
    assert [tuple(r) for r in secrets.redacted(df).collect()] == [(1, "my [SECRET] ok", "a", "b")]
    try:
        secrets.with_secrets(df.withColumnRenamed("__base", "secret_base"))
    except ValueError as e:
        assert "secret_base" in str(e)
    else:
        raise AssertionError("a column was overwritten")
    mail = spark.createDataFrame([(1, "q@x.org", 5, "h", "b")], "doc_id long, text string, row long, h string, base string")
    assert [(r.doc_id, len(r.base)) for r in privacy.sanitised(mail).collect()] == [(1, 1)]


def disclosing(rows, share):
    """Terms told of each row, straight from the definition."""
    from math import log2

    pattern = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"]
    held, words, all_words = [], [], []
    for _, t in rows:
        spans = [m.span() for m in re.finditer(pattern[0], t or "")]
        held.append({(t or "")[a:e].lower() for a, e in spans})
        near = {m[0].lower() for m in re.finditer(r"[^\W_]{3,}", t or "") if not any(a <= m.end() and m.start() <= e for a, e in spans)}
        words.append(near)
        all_words.append({m[0].lower() for m in re.finditer(r"[^\W_]{3,}", t or "")})
    n, told = len(rows), [set() for _ in rows]
    for e in set().union(*held):
        docs = [i for i in range(n) if e in held[i]]
        if len(docs) == n:
            continue
        for w in set().union(*(words[i] for i in docs)):
            n_t, n_et = sum(w in x for x in all_words), sum(w in words[i] for i in docs)
            if log2(n * n_et / (len(docs) * max(n_t, n_et))) >= share * log2(n / len(docs)) - 1e-9:
                for i in docs:
                    if w in words[i]:
                        told[i].add(w)
    return told


def test_disclosure_against_the_definition(spark):
    import random

    rng = random.Random(5)
    vocabulary = [f"term{i}" for i in range(40)]
    people = [(f"p{i}@x.org", [f"name{i}", f"firm{i % 3}"]) for i in range(8)]
    rows = []
    for i in range(120):
        ws = rng.choices(vocabulary, k=12)
        for mail, names in rng.sample(people, rng.choice([0, 0, 0, 1, 2])):
            ws += [mail] + (names if rng.random() < 0.9 else [])
        rng.shuffle(ws)
        rows.append((i, " ".join(ws)))
    rows += [(200, "only@once.org unique words here"), (201, None), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for share in (0.9, 0.5):
        got = sorted((r.doc_id, tuple(sorted({s.text for s in r.added}))) for r in privacy.sanitised(df, share).collect())
        assert got == sorted((d, tuple(sorted(t))) for (d, _), t in zip(rows, disclosing(rows, share), strict=True))


def test_likeness_estimates_shared_paragraphs(spark):
    rows = []
    for k, changed in enumerate((0, 10, 50, 100)):
        for j in range(6):
            a = [f"Line {k} {j} {i}." for i in range(100)]
            b = a[changed:] + [f"Other {k} {j} {i}." for i in range(changed)]
            rows.append((1 - changed / 100, "\n".join(a), "\n".join(b)))
    sums = fingerprints.with_fingerprints(spark.createDataFrame(rows, "want double, a string, b string"), ["a", "b"])
    for r in sums.select("want", fingerprints.likeness(F.col("a_sums"), F.col("b_sums")).alias("got")).collect():
        assert abs(r.got - r.want) < 0.3 and (r.want < 1 or r.got == 1)
    mean = sums.groupBy("want").agg(F.avg(fingerprints.likeness(F.col("a_sums"), F.col("b_sums"))).alias("m")).collect()
    assert all(abs(r.m - r.want) < 0.12 for r in mean)


def test_replies_across_ranges(spark):
    turns = [(c, t, f"turn {c} {t}") for c in (1, 2, 3) for t in range(0, 40, 1 + c)] + [(9, 0, "alone"), (None, 1, "x"), (None, 2, "y")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, text string")
    got = {(r.conv_id, r.turn): (r.one, r.two) for r in quotations.with_previous(df).collect()}
    by = {}
    for c, t, x in turns:
        by.setdefault(c, []).append((t, x))
    for c, xs in by.items():
        xs.sort()
        for i, (t, _) in enumerate(xs):
            assert got[c, t] == (xs[i - 1][1] if i else None, xs[i - 2][1] if i > 1 else None)
