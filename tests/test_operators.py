"""Operators on small tables, and the relational closure against the per-sentence one."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartwright import registry
from chartwright.functions import text as X
from chartwright.functions.grammar import load
from chartwright.operators import machines, parsing, ranking, repairing, scoring, typed
from chartwright.plans import relational
from chartwright.sources import readers


def sentences(spark, lines):
    return spark.createDataFrame([(i, x.split()) for i, x in enumerate(lines)], "sid int, tokens array<string>")


def test_relational_closure_equals_the_kernel(spark):
    g = load("START -> START START | a | b c\n")
    lines = [" ".join(w) for n in range(1, 5) for w in itertools.product(["a", "b", "c", "_"], repeat=n)]
    s = sentences(spark, lines)
    joins = {r.sid: int(r.n_trees) for r in relational.roots(relational.chart(s, g, 4), s, g).collect()}
    kernel = {r.sid: int(r.n_trees) for r in parsing.tree_counts(s, g).collect()}
    assert joins == kernel and any(joins.values())


def test_edit_arcs_as_rows(spark):
    from chartwright.functions.chart import edit_arcs, edit_states

    s = sentences(spark, ["a b c"])
    at = edit_states(3, 2)
    kinds = {"EQ": 0, "NE": 1, "ANY": 2}
    got = {((r.i, r.j), (r.i2, r.j2), kinds[r.kind], r.tok) for r in relational.edit_arcs(s, 2).collect()}
    assert got == {(at[p], at[q], k, t) for p, q, k, t in edit_arcs(["a", "b", "c"], 2)}


def test_empty_and_unknown_sentences(spark):
    s = sentences(spark, ["", "zzz", "a"])
    assert [r.accepted for r in parsing.accept(s, load("START -> a")).orderBy("sid").collect()] == [False, False, True]
    assert repairing.completions(sentences(spark, ["_ = ="]), load("START -> EQ\nEQ -> 1 + 1 = 2")).count() == 0
    assert [r.completion for r in repairing.completions(sentences(spark, ["_ + _ = _"]), load("START -> EQ\nEQ -> 1 + 1 = 2")).collect()] == ["1 + 1 = 2".split()]


def test_suffixes_stubs_and_segments(spark):
    g = load("START -> if ( x | if ( y z", False, False)
    got = repairing.suffixes(sentences(spark, ["if ("]), g).orderBy("rank").collect()
    assert [(r.suffix, r.lengths) for r in got] == [(["x"], [1, 2]), (["y", "z"], [1, 2])]
    g = load(registry.EXPRESSIONS)
    got = repairing.stub_strings(sentences(spark, ["<E>"]), g, 4, 3).orderBy("rank").collect()
    assert [" ".join(r.string) for r in got] == ["1", "x", "( 1 )", "( x )"]
    got = parsing.segments(sentences(spark, ["x + 1 ) $"]), g).orderBy("lo").collect()
    assert [(r.lo, r.hi, r.kind) for r in got] == [(0, 3, "parseable"), (3, 4, "unparseable"), (4, 5, "illegal")]


def test_sessions_of_any_length(spark, tmp_path):
    from chartwright.plans import oracle

    said = {1: "view click click click click error error error purchase".split(), 2: "view click click error".split(), 3: "signup click click click click view error error error purchase".split()}
    events = [(u, f"2024-01-01 00:00:{i:02d}", 100 * u + i, t) for u, ts in said.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(events, "user_id long, ts string, event_id long, event_type string")
    df.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "events.parquet"))
    words = oracle.language(load(registry.FUNNEL), 12)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row = row, [i + 1]
            for j, y in enumerate(b):
                row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
        return row[-1]

    got = {r.sid: r.led for r in registry.session_led(spark, str(tmp_path)).collect()}
    led = {u: min(distance(t, w) for w in words) for u, t in said.items()}
    assert got == {f"{u}:2024-01-01": d for u, d in led.items() if d <= 2} and "1:2024-01-01" in got and "3:2024-01-01" in got
    got = registry.session_suffixes(spark, str(tmp_path)).where("sid LIKE '2:%'").orderBy("rank").collect()
    prefix = tuple(said[2])
    ends = sorted((len(w), w) for w in words if w[:4] == prefix and len(w) <= 9)[:5]
    assert [r.suffix for r in got] == [" ".join(w[4:]) for _, w in ends] and ends
    holes = [x if i % 2 == 0 else None for i, x in enumerate(said[1])]
    fits = sorted(w for w in words if len(w) == 9 and all(h in (None, x) for h, x in zip(holes, w, strict=True)))[:29]
    got = registry.session_complete_holes(spark, str(tmp_path)).where("sid LIKE '1:%'").orderBy("rank").collect()
    assert [r.completion.split() for r in got] == [list(w) for w in fits] and fits


def test_text_functions(spark):
    assert X.restitched("CI = A - P (", "NAME = NAME - NAME ( )".split()) == "CI = A - P ( )"
    assert X.signature(X.alignment("a b c".split(), "a x c d".split())) == "E C.x E I.d"
    assert X.labels("a x c".split(), "a b c".split()) == [0, 2, 0] and X.labels("a x b".split(), "a b".split()) == [0, 1, 0] and X.labels(["a"], "b a c".split()) == [0]
    assert X.surrounding("if <B> then", 3, r"<[^\s>]+>") == "<B>" and X.surrounding("if <B> then", 2) == "if" and X.surrounding("if   x", 3) is None
    df = spark.createDataFrame([("x = 1",), ("x =",)], "line string")
    assert [r.line for r in X.compiling(df, "line").collect()] == ["x = 1"] and X.rejections(df, "line").count() == 1
    row = spark.createDataFrame([(["table", "tab", "taco"], "<b>a &lt; b</b>")], "w array<string>, h string").select(X.lcp(F.col("w")).alias("p"), X.plain_text(F.col("h")).alias("h")).first()
    assert (row.p, row.h) == ("ta", "a < b")


def test_fair_merge(spark):
    rows = [(1, b, i) for b in "abc" for i in range(20)]
    got = ranking.fair_merge(spark.createDataFrame(rows, "k int, branch string, place int"), ["k"], "branch", "place", 29)
    assert sorted(r["count"] for r in got.groupBy("branch").count().collect()) == [9, 10, 10]
    got = ranking.fair_merge(spark.createDataFrame([(1, "a", 0), *((1, "b", i) for i in range(9))], "k int, branch string, place int"), ["k"], "branch", "place", 6)
    assert [f"{r.branch}{r.place}" for r in got.orderBy("merged").collect()] == ["a0", "b0", "b1", "b2", "b3", "b4"]


def test_cleaned_completions(spark):
    rows = [(1, i, f"x = {i % 11} NEWLINE") for i in range(12)]
    got = ranking.cleaned_completions(spark.createDataFrame(rows, "k int, place int, line string"), ["k"], "line", "place").collect()
    assert len(got) == 10 and not any("NEWLINE" in r.line for r in got)


def test_typed_expressions(spark):
    values = spark.createDataFrame([("name", "String"), ("count", "Int")], "name string, type string")
    fns = spark.createDataFrame([("hello", [], "String"), ("greet", ["String"], "String"), ("size", ["String"], "Int")], "name string, params array<string>, ret string")
    members = spark.createDataFrame([], "owner string, name string, params array<string>, ret string")
    subtypes = spark.createDataFrame([], "sub string, sup string")
    found = typed.expressions(values, fns, members, subtypes, 6)
    assert [r.text for r in typed.of_type(found, subtypes, "String", 4).collect()] == ["name", "hello()", "greet(name)", "greet(hello())"]
    boxes = spark.createDataFrame([("left", "Box"), ("right", "Box")], "name string, type string")
    members = spark.createDataFrame([("Box", "size", None, "Int")], members.schema)
    found = typed.expressions(boxes, fns.limit(0), members, subtypes, 3)
    assert [r.text for r in typed.of_type(found, subtypes, "Int", 2).collect()] == ["left.size", "right.size"]


def one_machine(program, limit):
    mem, pc, acc, steps, out = list(program) + [0] * (machines.MEMORY - len(program)), 0, 0, 0, []
    while steps < limit:
        word = mem[pc % machines.MEMORY]
        op, arg = word & 7, word >> 3
        if op in (0, 6):
            return steps, acc, out, True
        a = acc
        if op == 1:
            acc = arg & machines.WORD
        elif op == 2:
            acc = (a + mem[arg % machines.MEMORY]) & machines.WORD
        elif op == 3:
            acc = a * mem[arg % machines.MEMORY] & machines.WORD
        elif op == 4:
            mem[arg % machines.MEMORY] = a
        elif op == 7 and len(out) < machines.OUTPUTS:
            out.append(mem[arg % machines.MEMORY])
        pc = arg & machines.WORD if op == 5 and a else (pc + 1) & machines.WORD
        steps += 1
    return steps, acc, out, True


def test_machines_against_one_at_a_time(spark):
    rng = np.random.default_rng(3)
    programs = [[machines.packed(int(o), int(a)) for o, a in zip(rng.integers(0, 8, n), rng.integers(0, 12, n), strict=True)] for n in rng.integers(1, 12, 60)]
    df = spark.createDataFrame(list(enumerate(programs)), "vid long, program array<int>")
    got = {r.vid: (r.steps, r.acc, list(r.out), r.halted) for r in machines.run(df, 300).collect()}
    assert got == {i: one_machine(p, 300) for i, p in enumerate(programs)}


def test_automaton_file_and_scores(spark, tmp_path):
    auto = scoring.bigram_automaton(sentences(spark, ["a b", "a c", "a b"]))
    again = readers.unpack_automaton(readers.pack_automaton(auto))
    assert (again.edges, again.final, again.start) == (auto.edges, auto.final, auto.start)
    assert auto.score("NEWLINE a b NEWLINE".split()) < auto.score("NEWLINE a zzz NEWLINE".split())
    (tmp_path / "g.txt").write_text("a b c d ::: 3\nbroken\n")
    assert [(r.g, r.n) for r in readers.ngram_file(spark, str(tmp_path)).collect()] == [(["a", "b", "c", "d"], 3.0)]


def test_grammar_documents(spark, tmp_path):
    (tmp_path / "one.txt").write_text("START -> a b\n---\na b\n\na _\n")
    got = readers.documents(spark, str(tmp_path)).orderBy("line").collect()
    assert [r.tokens for r in got] == [["a", "b"], ["a", "_"]]
    with pytest.raises(ValueError):
        readers.documents(spark, "../x")
    wrong, why = readers.grammar("A B -> c")
    assert why and readers.grammar("A B -> c")[0] is wrong and not parsing.accept(sentences(spark, ["c"]), wrong).first().accepted


def test_queries_equal_their_sql_on_the_smallest_tables(spark):
    import os

    duckdb = pytest.importorskip("duckdb")
    at, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in os.listdir(at):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{at}/{t}')")
    known, sql = registry.queries(), registry.oracle_sql()
    for name in ("session_accept", "session_repairs_topk", "session_dispatch", "session_plans", "session_distributions", "automaton_cost", "rasp_histogram", "token_ngrams4"):
        df = known[name](spark, at)
        want = con.execute(sql[name])
        names = [d[0] for d in want.description]
        assert sorted(map(str, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(str, want.fetchall())), name


def test_dispatch_of_suffixes_and_names(spark):
    from chartwright.operators import dispatch

    g = load("START -> if ( x | if ( [START] z", False, False)
    s = sentences(spark, ["if (", "if ( x", "if _ x", "( x", "zzz"])
    got = {(r.sid, r.scenario): [] for r in dispatch.outputs(s, g, 1, 0, 9, True, {"[START]": "START"}).collect()}
    for r in dispatch.outputs(s, g, 1, 0, 9, True, {"[START]": "START"}).orderBy("sid", "rank").collect():
        got[r.sid, r.scenario].append(r.output)
    assert got == {(0, "SUFFIX_COMPLETION"): ["if ( x", "if ( START z"], (1, "SUFFIX_COMPLETION"): ["if ( x"], (2, "COMPLETION"): ["if ( x"], (3, "REPAIR"): ["if ( x"]}
    assert {r.scenario for r in dispatch.outputs(s, g, 1, 0, 9).collect()} == {"COMPLETION", "PARSEABLE", "REPAIR"}


def test_epsilons_and_sizes(spark):
    g = load("START -> A B\nA -> a | A a\nB -> b | c B", True, False)
    got = repairing.completions(sentences(spark, ["_ _ _ _ _"]), g, 4).orderBy("rank").collect()
    want = sorted({" ".join(x for x in w) for n in range(1, 6) for w in itertools.product("abc", repeat=n) if parse(" ".join(w))}, key=lambda s: (len(s.split()), s.split()))
    assert [" ".join(r.completion) for r in got] == want[:4]
    lengths = {r.length: (" ".join(r.least), " ".join(r.greatest)) for r in repairing.bounds_by_length(sentences(spark, ["_ _ _ _ _"]), g).collect()}
    assert lengths == {n: (min(x), max(x)) for n in range(2, 6) if (x := [w for w in want if len(w.split()) == n])}
    plain = load("START -> START START | a | b c")
    row = repairing.distances(sentences(spark, ["a b"]), plain, 1).collect()
    assert {(r.dist, r.n_words) for r in row} == {(1, 3)}  # a, a a, a b c
    share = repairing.saturation(sentences(spark, ["a b"]), plain, 1, 0, 2).first().share
    total = int(repairing.root_sizes(sentences(spark, ["a b"]), plain, 1).first().n_derivations)
    assert share == 2 / total and total >= 3


def parse(line):
    import re

    return re.fullmatch(r"a( a)*( c)* b", line) is not None


def test_repaired_lines(spark):
    from chartwright.operators import pylines

    lines = spark.createDataFrame([(1, "x = f ( y"), (2, "x = 1"), (3, None)], "line_id int, line string")
    said = spark.createDataFrame([("NAME = NAME ( NAME )".split(),)] * 50, "tokens array<string>")
    got = {(r.line_id, r.rank): (r.dist, r.fixed) for r in pylines.repaired_lines(lines, load(registry.LINES), scoring.ngrams(said), 1, 0, 3).collect()}
    assert got[1, 1] == (1, "x = f ( y )") and got[2, 1] == (0, "x = 1") and all(compile(f, "", "exec") for _, f in got.values())


def test_stream_of_prompts(spark, tmp_path):
    from chartwright.streaming import prompts

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"editor": 1, "ts": "2024-01-01T00:00:00", "line": "a"}\n{"editor": 1, "ts": "2024-01-01T00:00:01", "line": "a c"}\n')
    stream = spark.readStream.schema("editor int, ts timestamp, line string").json(str(tmp_path / "in"))
    seen = []
    prompts.serve(stream, load("START -> a b"), lambda df, n: seen.extend(df.collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert [(r.line, r.dist, r.repair) for r in seen] == [("a c", 1, ["a", "b"])]


def test_programs_and_rendering(spark):
    from chartwright.functions import programs, render

    text = "fun f0 ( ipt : W ^ 2 ) -> W ^ 1 { ife ipt [ 0 ] { scr [ 3 ] = 1 ; opt [ 7 ] = ipt [ 5 ] * scr [ 3 ] } { hlt } ; whl x { hlt } }"
    want = "fun f0(ipt: W ^ 2) -> W ^ 1 {\n    ife ipt[0] {\n        scr[3] = 1;\n        opt[0] = ipt[1] * scr[3]\n    } {\n        hlt\n    };\n    whl x {\n        hlt\n    }\n}"
    df = spark.createDataFrame([(text,), ("fun f0 ( ipt : W ^ 2 ) -> W ^ 1 { ipt [ 0 ] = 1 }",), ("fun f0 ( ipt : W ^ 2 ) -> W ^ 1 { hlt",), (None,)], "s string")
    assert [r.t for r in df.select(programs.program_text("s").alias("t")).collect()] == [want, None, None, None]
    assert render.latex_rules(load("START -> a_b | START c")).count(r"\mid") == 1 and r"a\_b" in render.latex_rules(load("START -> a_b"))
    cells = parsing.cells(sentences(spark, ["a b"]), load("START -> a b"))
    assert render.latex_chart(cells, ["sid"]).first().latex == "F.a & START \\\\\n & F.b"
    row = spark.createDataFrame([("<a & 'b'>",)], "t string").select(render.html(F.col("t")).alias("h")).first()
    assert row.h == "&lt;a &amp; &#39;b&#39;&gt;"


def test_weighted_frontier():
    from chartwright.functions import chart as C

    t = C.Tables(load("START -> a | b | START START"))
    chart = C.line_chart(t, ["_"] * 6)
    auto = scoring.Automaton(0, 0, 10, {(0, "a"): (0, 0), (0, "b"): (0, 50_000)}, {0: 0})
    got = repairing.frontier(t, chart, 6, 8, 4, automaton=auto, seed=3)
    assert got and got == repairing.frontier(t, chart, 6, 8, 4, automaton=auto, seed=3) and all(len(s) == 6 and set(s) <= {"a", "b"} for s in got)
    assert sum(s.count("a") for s in got) > sum(s.count("b") for s in got)
    assert repairing.parent_weight(None, 3, 10) == 0 and repairing.parent_weight(0, 100, 10) == 65_535 and repairing.parent_weight(10**9, 1, 10) == 1
    assert set(repairing.frontier(t, chart, 6, 10**6, 10**6, seed=1)) == set(chart.best(0, 6, t.ids["START"], 10**6))


def test_reranked_by_weights(spark):
    model = scoring.BagModel({"embedding": np.array([[1.0, 0], [0, 1]]), "output": np.array([1.0, -1]), "bias": np.array([0.5])}, ["a", "b"])
    found = spark.createDataFrame([(1, 0, ["b"]), (1, 1, ["a"])], "sid int, dist int, repair array<string>")
    got = {r.repair[0]: (r["rank"], r.reranked) for r in ranking.searched(found, ["sid"], 5, model=model, vocabulary={"a", "b"}).collect()}
    assert got == {"b": (1, 2), "a": (2, 1)}


def test_posted_repairs(spark, tmp_path):
    import http.server
    import json
    import threading

    from chartwright.streaming import prompts

    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.extend(self.rfile.read(int(self.headers["Content-Length"])).decode().split("\n"))
            self.send_response(204)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    df = spark.createDataFrame([(1, "a c")], "editor int, line string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    prompts.poster(f"http://127.0.0.1:{server.server_port}/")(prompts.answered(df, load("START -> a b")), 0)
    server.shutdown()
    assert [json.loads(x)["repair"] for x in seen] == [["a", "b"]]


def test_cells_merged_and_distributions(spark):
    cells = spark.createDataFrame([(1, 0, 1, "A", False, 2), (1, 0, 1, "A", True, 0), (1, 1, 2, "B", True, 0)], "sid int, q int, q2 int, nt string, has_bin boolean, lit int")
    assert {tuple(r) for r in relational.merged(cells, ["sid", "q", "q2", "nt"]).collect()} == {(1, 0, 1, "A", True, 2), (1, 1, 2, "B", True, 0)}
    g = load("START -> START START | a | b c")
    s = sentences(spark, ["a a b c a", "_ _ _ _"])
    rows = relational.distributions(relational.chart(s, g, 5), g).collect()
    start = list(g.nonterminals).index("START")
    total = {}
    for r in rows:
        total.setdefault((r.sid, r.q, r.q2, r.nt), []).append((r.before, r["size"]))
    sizes = {r.sid: int(r.n_trees) for r in parsing.tree_counts(s, g).collect()}
    for (sid, q, q2, nt), each in total.items():
        each.sort()
        assert [b for b, _ in each] == list(np.cumsum([0, *(n for _, n in each)])[:-1])
        if (q, q2, nt) == (0, len("a a b c a".split()) if sid == 0 else 4, start):
            assert sum(n for _, n in each) == sizes[sid]
