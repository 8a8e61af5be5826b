"""The engine's own queries and their oracles."""

from __future__ import annotations

import base64
import gzip
import json
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartwright.functions import programs as programs_text
from chartwright.functions import randoms, render
from chartwright.functions import text as X
from chartwright.functions.grammar import HOLE, Grammar, load, stages
from chartwright.grammars import EXPRESSIONS, FLAGS, FUNNEL, GRAMMARS, IF, LINES, SESSION, TALK
from chartwright.operators import dispatch, machines, parsing, pylines, ranking, repairing, scoring, typed
from chartwright.plans import answers, relational
from chartwright.plans.oracle import KINDS
from chartwright.plans.shared import shared_dir
from chartwright.sources import readers
from chartwright.streaming import prompts

__all__ = ["EXPRESSIONS", "FUNNEL", "LINES", "SESSION", "oracle_sql", "queries"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ordered_tokens(df: DataFrame, keys: list, order: list, token) -> DataFrame:
    """One row for each key: tokens in order."""
    items = F.array_sort(F.collect_list(F.struct(*order, token.alias("tok"))))
    return df.groupBy(*keys).agg(F.transform(items, lambda s: s["tok"]).alias("tokens"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sid, user_id, day, tokens): the types of a user's events in a day."""
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", "event_type")
    rows = ordered_tokens(e, ["user_id", "day"], ["ts", "event_id"], F.col("event_type"))
    return rows.withColumn("sid", F.concat_ws(":", F.col("user_id").cast("string"), F.col("day").cast("string")))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    return ordered_tokens(li, [F.col("l_orderkey").cast("string").alias("sid")], ["l_linenumber", "l_partkey", "l_suppkey"], F.concat("l_returnflag", "l_linestatus"))


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_tokens(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), [F.col("conv_id").cast("string").alias("sid")], ["turn"], F.col("role"))


def session_accept(spark, sf_dir):
    return parsing.accept(sessions(spark, sf_dir).select("sid", "tokens"), load(SESSION)).select("sid", F.size("tokens").cast("long").alias("n_tokens"), "accepted")


def session_tree_count(spark, sf_dir):
    return parsing.tree_counts(sessions(spark, sf_dir).select("sid", "tokens"), load(SESSION)).select("sid", F.col("n_trees").cast("string").alias("n_trees"))


def session_active_cells(spark, sf_dir):
    cells = parsing.cells(sessions(spark, sf_dir).select("sid", "tokens"), load(SESSION))
    return cells.groupBy("sid", (F.col("q2") - F.col("q")).alias("span")).agg(F.count("*").alias("n_active"))


def session_trees(spark, sf_dir):
    return parsing.trees(sessions(spark, sf_dir).select("sid", "tokens"), load(SESSION)).select("sid", "tree")


def session_segments(spark, sf_dir):
    return parsing.segments(sessions(spark, sf_dir).select("sid", "tokens"), load(FUNNEL)).select("sid", "lo", "hi", "kind")


def session_scenarios(spark, sf_dir):
    found = parsing.scenarios(holed(sessions(spark, sf_dir)), load(FUNNEL))
    return found.groupBy("scenario").agg(F.count("*").alias("n"))


def session_fragments(spark, sf_dir):
    return parsing.max_fragment(sessions(spark, sf_dir).select("sid", "tokens"), load(FUNNEL)).select("sid", "prefix", "suffix")


def session_led(spark, sf_dir):
    return repairing.nearest(sessions(spark, sf_dir).select("sid", "tokens"), load(FUNNEL), 2).select("sid", F.col("led").cast("long").alias("led"))


def session_repairs(spark, sf_dir, k=5):
    return repairing.repairs(sessions(spark, sf_dir).select("sid", "tokens"), load(FUNNEL), 2, 1, k)


def session_repairs_topk(spark, sf_dir):
    return session_repairs(spark, sf_dir).select("sid", F.col("rank").cast("long").alias("rank"), F.col("dist").cast("long").alias("dist"), F.array_join("repair", " ").alias("repair"))


def holed(df: DataFrame) -> DataFrame:
    return df.select("sid", F.transform("tokens", lambda t, i: F.when(i % 2 == 1, HOLE).otherwise(t)).alias("tokens"))


def session_complete_holes(spark, sf_dir):
    found = repairing.completions(holed(sessions(spark, sf_dir)), load(FUNNEL))
    return found.select("sid", F.col("rank").cast("long").alias("rank"), F.array_join("completion", " ").alias("completion"))


def session_suffixes(spark, sf_dir):
    found = repairing.suffixes(sessions(spark, sf_dir).select("sid", "tokens"), load(FUNNEL), 5, 5)
    return found.select("sid", F.col("rank").cast("long").alias("rank"), F.array_join("suffix", " ").alias("suffix"))


def session_plans(spark, sf_dir):
    """Plans for sessions whose last event is typed in part: its first letter."""
    typed_ = sessions(spark, sf_dir).select("sid", F.transform("tokens", lambda t, i: F.when(i == F.size("tokens") - 1, F.substring(t, 1, 1)).otherwise(t)).alias("tokens"))
    return repairing.plans(typed_, load(FUNNEL), 6).select("sid", "expanded", "candidates", "committed", F.array_join("forced", " ").alias("forced"), F.array_join(F.transform("branches", lambda b: b["terminal"]), " ").alias("terminals"))


def session_samples(spark, sf_dir):
    found = repairing.sampled(holed(sessions(spark, sf_dir)), load(FUNNEL), 3, 1)
    return found.select("sid", "nth", F.array_join("word", " ").alias("word"))


def order_flag_accept(spark, sf_dir):
    return parsing.accept(orders(spark, sf_dir), load(FLAGS)).select("sid", F.size("tokens").cast("long").alias("n_tokens"), "accepted")


def order_chart_joins(spark, sf_dir):
    """The same question as order_flag_accept, by the relational closure, with counts of trees."""
    sent, g = orders(spark, sf_dir), load(FLAGS)
    longest = sent.agg(F.max(F.size("tokens"))).first()[0] or 1
    found = relational.roots(relational.chart(sent, g, longest), sent, g)
    return found.select("sid", F.col("n_trees").cast("string").alias("n_trees"))


def dialogue_accept(spark, sf_dir):
    return parsing.accept(dialogues(spark, sf_dir), load(TALK)).select("sid", F.size("tokens").cast("long").alias("n_tokens"), "accepted")


TAG = r"</?(?:div|ul|li|nav|p)\b"


def tag_balance(spark, sf_dir):
    """Opening and closing container tags of each page, and whether none closes before it opens."""
    tags = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(TAG), F.lit(0))
    steps = F.transform(tags, lambda t: F.when(t.startswith("</"), -1).otherwise(1))
    run = F.aggregate(steps, F.struct(F.lit(0).alias("d"), F.lit(0).alias("least"), F.lit(0).alias("opened")), lambda a, s: F.struct((a["d"] + s).alias("d"), F.least(a["least"], a["d"] + s).alias("least"), (a["opened"] + F.when(s > 0, 1).otherwise(0)).alias("opened")))
    pages = table(spark, sf_dir, "pages").select("page_id", run.alias("r"))
    return pages.select("page_id", F.col("r.opened").cast("long").alias("n_open"), F.col("r.d").cast("long").alias("depth_left"), ((F.col("r.d") == 0) & (F.col("r.least") == 0)).alias("balanced"))


def word_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("tokens"))


def token_ngrams4(spark, sf_dir):
    return scoring.ngrams(word_sentences(spark, sf_dir), 4).select(F.array_join("g", " ").alias("gram"), "n")


def ngram_cost(spark, sf_dir):
    sent = sessions(spark, sf_dir).select("sid", "tokens")
    return scoring.ngram_scores(sent, scoring.ngrams(sent), ["sid"])


def automaton_cost(spark, sf_dir):
    found = session_repairs(spark, sf_dir)
    auto = scoring.bigram_automaton(sessions(spark, sf_dir).select("tokens"))
    return scoring.automaton_scores(found, auto).select("sid", "rank", "dist", F.array_join("repair", " ").alias("repair"), "score")


def prefix_sums(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("qty"))
    found = relational.running(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "qty"], "qty")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "qty", F.col("before").cast("long").alias("before"))


def edit_distance(spark, sf_dir):
    """Distance of each session from the same user's one before."""
    s = sessions(spark, sf_dir).withColumn("last", F.lag("tokens").over(W.partitionBy("user_id").orderBy("day"))).where(F.col("last").isNotNull())
    return s.select("sid", X.token_distance(F.col("last"), F.col("tokens"), KINDS).cast("long").alias("dist"))


def edit_signature_dedup(spark, sf_dir):
    found = session_repairs(spark, sf_dir, 10)
    kept = ranking.one_for_signature(found, ["sid"], "tokens", "repair", [F.col("rank")])
    return kept.select("sid", "rank", "dist", F.array_join("repair", " ").alias("repair"), "signature")


def fair_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    placed = e.withColumn("place", F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("event_id")))
    return ranking.fair_merge(placed, ["user_id"], "event_type", "place", 10).select("user_id", "event_type", "event_id", F.col("merged").cast("long").alias("merged"))


def grammar_stats(spark, sf_dir):
    """Sizes of both forms of the grammars, with the number of events that the sessions' grammars are asked about."""
    rows = spark.createDataFrame([(name, *r) for name, g in GRAMMARS.items() for r in stages(g)], "name string, form string, nonterminals long, terminals long, productions long")
    return rows.crossJoin(table(spark, sf_dir, "events").agg(F.count("*").alias("n_events")))  # one row


def grammar_adjacency(spark, sf_dir):
    """Right sides of the order grammar's normal form, with their parents by bit masks, and how many orders begin with a token of the left symbol."""
    g = load(FLAGS)
    names, frames = list(g.nonterminals), g.frames(spark)
    first = orders(spark, sf_dir).select(F.element_at("tokens", 1).alias("tok")).groupBy("tok").agg(F.count("*").alias("k"))
    began = frames["unit"].join(F.broadcast(first), "tok").groupBy(F.col("a").alias("b")).agg(F.sum("k").alias("n_began"))  # an order has few kinds of tokens
    labels = F.array(*(F.lit(x) for x in names))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    own = F.filter(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.col("mask").bitwiseAND(bit(i)) != 0)
    parents = F.array_join(F.array_sort(F.transform(own, lambda i: F.element_at(labels, i + 1))), " ")
    found = relational.left_adjacency(frames["bin"]).join(began, "b", "left")
    return found.select(F.element_at(labels, F.col("b") + 1).alias("left_symbol"), F.element_at(labels, F.col("c") + 1).alias("right_symbol"), parents.alias("parents"), F.coalesce("n_began", F.lit(0)).alias("n_began"))


def session_backs(spark, sf_dir):
    """Back-pointers of each span of each session's chart."""
    found = parsing.back_pointers(sessions(spark, sf_dir).select("sid", "tokens"), load(SESSION))
    return found.groupBy("sid", (F.col("q2") - F.col("q")).alias("span")).agg(F.count("*").alias("n_backs"))


def session_distributions(spark, sf_dir):
    """The expansions of each cell, with the derivations before each, from the relational chart."""
    g, s = load(SESSION), sessions(spark, sf_dir).select("sid", "tokens")
    longest = s.agg(F.max(F.size("tokens"))).first()[0] or 1
    names = F.array(*(F.lit(x) for x in g.nonterminals))
    name = lambda c: F.element_at(names, F.col(c) + 1).alias(c)
    found = relational.distributions(relational.chart(s, g, longest), g)
    number = lambda c: F.col(c).cast("long").alias(c)
    return found.select("sid", number("q"), number("q2"), name("nt"), number("m"), name("b"), name("c"), F.col("size").cast("string").alias("size"), F.col("before").cast("string").alias("before"))


def session_bounds(spark, sf_dir):
    """The least and the greatest way to fill a session's holes, by visible length."""
    found = repairing.bounds_by_length(holed(sessions(spark, sf_dir)), load(FUNNEL))
    return found.select("sid", F.col("length").cast("long").alias("length"), F.array_join("least", " ").alias("least"), F.array_join("greatest", " ").alias("greatest"))


def session_distances(spark, sf_dir):
    """Different strings at each distance from a session."""
    return repairing.distances(sessions(spark, sf_dir).select("sid", "tokens"), load(FUNNEL), 2).select("sid", F.col("dist").cast("long").alias("dist"), "n_words")


def session_subtrees(spark, sf_dir):
    return parsing.maximal_subtrees(sessions(spark, sf_dir).select("sid", "tokens"), load(FUNNEL)).select("sid", "lo", "hi", "label")


def session_leaves(spark, sf_dir):
    """The leaves of one tree of each accepted session, in order, and the root's span."""
    nodes = parsing.tree_nodes(sessions(spark, sf_dir).select("sid", "tokens"), load(SESSION))
    inner = nodes.where(F.col("parent").isNotNull()).select("sid", F.col("parent").alias("node")).distinct()
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("lo", "label"))), lambda x: x["label"])
    leaves = nodes.join(inner, ["sid", "node"], "left_anti").groupBy("sid").agg(F.array_join(ordered, " ").alias("leaves"))
    return leaves.join(nodes.where("parent IS NULL").select("sid", F.col("hi").cast("long").alias("root_end")), "sid")


def session_tree_nodes(spark, sf_dir):
    """The nodes of one tree of each accepted session."""
    return parsing.tree_nodes(sessions(spark, sf_dir).select("sid", "tokens"), load(SESSION)).select("sid", "label", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))


def session_reach(spark, sf_dir):
    """Pairs of states with a path, and states between them, of each session's line automaton."""
    pairs = relational.reach(relational.line_arcs(sessions(spark, sf_dir).select("sid", "tokens")).select("sid", "q", "q2"))
    between = relational.mid_points(pairs).groupBy("sid").agg(F.count("*").alias("n_between"))
    return pairs.groupBy("sid").agg(F.count("*").alias("n_pairs")).join(between, "sid", "left").select("sid", "n_pairs", F.coalesce("n_between", F.lit(0)).alias("n_between"))


def session_alignment(spark, sf_dir):
    """A cheapest alignment of each session with the same user's one before: its cost and both sides."""
    s = sessions(spark, sf_dir).withColumn("last", F.lag("tokens").over(W.partitionBy("user_id").orderBy("day"))).where(F.col("last").isNotNull())
    pairs = s.select("sid", X.aligned("last", "tokens").alias("p"))
    side = lambda name: F.array_join(F.filter(F.transform("p", lambda x: x[name]), lambda x: x.isNotNull()), " ")
    return pairs.select("sid", F.size(F.filter("p", lambda x: ~x["old"].eqNullSafe(x["new"]))).cast("long").alias("cost"), side("old").alias("old"), side("new").alias("new"))


def session_display(spark, sf_dir):
    """The three first repairs in the order of display, and the three first different ones by score (their distance)."""
    found = session_repairs(spark, sf_dir, 100).select("sid", "dist", "repair")
    shown = ranking.top_k(found, ["sid"], ranking.display_order(), 3)
    best = ranking.unique_top_k(found.withColumn("score", F.col("dist")), ["sid"], 3).select("sid", "rank", F.array_join("repair", " ").alias("by_score"))
    return shown.join(best, ["sid", "rank"]).select("sid", F.col("rank").cast("long").alias("rank"), F.array_join("repair", " ").alias("shown"), "by_score")


def mixed_sessions(df: DataFrame) -> DataFrame:
    """Sessions of users with an even id with holes, of others as they are, and one stub for each session of users whose id 50 divides."""
    every = F.when(F.col("user_id") % 2 == 0, F.transform("tokens", lambda t, i: F.when(i % 2 == 1, HOLE).otherwise(t))).otherwise(F.col("tokens"))
    return df.select("sid", F.when(F.col("user_id") % 50 == 0, F.array(F.lit("<Middle>"))).otherwise(every).alias("tokens"))


def session_dispatch(spark, sf_dir):
    """What each session's scenario gives; of a tree only that there is one."""
    found = dispatch.outputs(mixed_sessions(sessions(spark, sf_dir)), load(FUNNEL))
    return found.select("sid", "scenario", F.col("rank").cast("long").alias("rank"), F.when(F.col("scenario") != "PARSEABLE", F.col("output")).alias("output"))


def line_repairs(spark, sf_dir):
    """The best repair of a broken line of Python for each part, a call without its closing bracket: of the nearest ones that compile, the shortest costs least."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("line_id"), F.concat(F.lit("size = f ( "), F.when(F.col("p_size") % 2 == 0, F.lit("width")).otherwise(F.lit("3"))).alias("line"))
    said = spark.createDataFrame([("x = f ( 1 )",), ("x = f ( y )",), ("x = f ( 1 , y )",), ("return x + 1",)], "line string")
    grams = scoring.ngrams(said.select(F.filter(X.lex_classes("line"), lambda t: t != "NEWLINE").alias("tokens")))
    return pylines.repaired_lines(part, load(LINES), grams, 1, 0, 1).select("line_id", F.col("dist").cast("long").alias("dist"), "fixed")


def session_ngram_rank(spark, sf_dir):
    """The two best repairs of each session by distance and the cost of its runs of four types."""
    grams = scoring.ngrams(sessions(spark, sf_dir).select("tokens"))
    found = ranking.searched(session_repairs(spark, sf_dir, 100).select("sid", "dist", "repair"), ["sid"], 2, scoring.ngram_scorer(grams))
    return found.select("sid", F.col("rank").cast("long").alias("rank"), F.array_join("repair", " ").alias("repair"), "score")


def event_draws(spark, sf_dir):
    """A number below 1000 and a mixed one for each event, from its id."""
    e = table(spark, sf_dir, "events").select("event_id", randoms.mixed(F.col("event_id")).alias("mixed"))
    return e.select("event_id", "mixed", randoms.below(F.col("mixed"), 1000).alias("drawn"))


def part_programs(spark, sf_dir):
    """A program for each part, laid out."""
    n = F.col("p_size").cast("string")
    source = F.concat(F.lit("fun f0 ( ipt : W ^ 3 ) -> W ^ 2 { scr [ 0 ] = ipt [ "), n, F.lit(" ] + scr [ 1 ] ; whl scr [ 0 ] { ife x { opt [ "), n, F.lit(" ] = 1 } { hlt } } }"))
    return table(spark, sf_dir, "part").select("p_partkey", programs_text.program_text(source).alias("program"))


def event_invariance(spark, sf_dir):
    """Events by whether their type may stand for a recovery."""
    e = table(spark, sf_dir, "events").select(F.lit("Recover").alias("sym"), F.col("event_type").alias("tok"))
    unit = spark.createDataFrame(list(load(SESSION).unit), "sym string, tok string")
    return ranking.invariant(e, unit, "sym", "tok").groupBy("tok").agg(F.count("*").alias("n"))


def session_lists(spark, sf_dir):
    """Each session's repairs as an HTML list."""
    found = session_repairs(spark, sf_dir).select("sid", "rank", F.array_join("repair", " <> ").alias("text"))
    return render.html_list(found, ["sid"], "rank", "text")


def holed_chart_joins(spark, sf_dir):
    """Derivations of all ways to fill a session's holes, by the relational closure."""
    sent, g = holed(sessions(spark, sf_dir)), load(FUNNEL)
    longest = sent.agg(F.max(F.size("tokens"))).first()[0] or 1
    return relational.roots(relational.chart(sent, g, longest), sent, g).select("sid", F.col("n_trees").cast("string").alias("n_trees"))


def example_stats(spark, sf_dir):
    """Sizes of the worked example's forms with both flags, and with none, for each region."""
    rows = [(flags, *r) for flags in (True, False) for r in stages(IF, flags, flags)]
    made = spark.createDataFrame(rows, "flags boolean, form string, nonterminals long, terminals long, productions long")
    return table(spark, sf_dir, "region").select("r_regionkey").crossJoin(F.broadcast(made))  # four rows


def written(df: DataFrame, name: str) -> str:
    """A column of lines as text files in the shared folder; their path."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.text(path)
    return path


def ngram_file_cost(spark, sf_dir):
    """ngram_cost with the counts written as an n-gram file and read back."""
    sent = sessions(spark, sf_dir).select("sid", "tokens")
    lines = scoring.ngrams(sent).select(F.concat_ws(" ::: ", F.array_join("g", " "), F.col("n").cast("string")).alias("value"))
    return scoring.ngram_scores(sent, readers.ngram_file(spark, written(lines, "ngrams")), ["sid"])


def automaton_file_cost(spark, sf_dir):
    """automaton_cost with the automaton packed, embedded as text, written and read back."""
    packed = base64.b64encode(gzip.compress(readers.pack_automaton(scoring.bigram_automaton(sessions(spark, sf_dir).select("tokens"))))).decode()
    path = written(spark.createDataFrame([(packed,)], "value string"), "automaton")
    auto = readers.unpack_automaton(readers.embedded(spark.read.text(path).first()[0]))
    return scoring.automaton_scores(session_repairs(spark, sf_dir), auto).select("sid", "rank", "dist", F.array_join("repair", " ").alias("repair"), "score")


def order_normal_accept(spark, sf_dir):
    """order_flag_accept with the grammar's normal form written and read as it is."""
    g = load(FLAGS)
    lines = [f"{a} -> {b} {c}" for a, b, c in g.binary] + [f"{a} -> {t}" for a, t in g.unit]
    path = written(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1), "normal")
    return parsing.accept(orders(spark, sf_dir), readers.normal_file(spark, path)).select("sid", F.size("tokens").cast("long").alias("n_tokens"), "accepted")


def dialogue_documents(spark, sf_dir):
    """Whether each different dialogue is accepted, each written as a document of grammar and sentence, and read back."""
    lines = dialogues(spark, sf_dir).select(F.array_join("tokens", " ").alias("sentence")).distinct()
    path = f"{shared_dir(spark)}/dialogues-{uuid.uuid4().hex}"
    lines.select(F.concat(F.lit(TALK.strip() + "\n---\n"), "sentence").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    found = readers.documents(spark, path)
    texts = [r[0] for r in found.select("grammar").distinct().limit(2).collect()]
    grammar, _ = readers.grammar(texts[0] if len(texts) == 1 else "")
    return parsing.accept(found.select("sentence", "tokens"), grammar).select("sentence", "accepted")


def rasp_saved(spark, sf_dir):
    """rasp_histogram of machines' states that were written and read back."""
    path = f"{shared_dir(spark)}/machines-{uuid.uuid4().hex}"
    readers.write_machines(machines.run(programs(spark, sf_dir), 5000), path)
    return machines.histogram(readers.read_machines(spark, path), 5000, 50)


def session_rerank(spark, sf_dir):
    """Each session's five repairs, ranked anew by a model read from a weights file: the mean of the types' places."""
    numbers = {"embedding": (np.arange(len(KINDS), dtype="<f4").reshape(-1, 1)), "output": np.ones(1, "<f4"), "bias": np.zeros(1, "<f4")}
    head, body = {}, b""
    for name, x in numbers.items():
        head[name] = {"dtype": "F32", "shape": list(x.shape), "data_offsets": [len(body), len(body) + x.nbytes]}
        body += x.tobytes()
    text = json.dumps(head).encode()
    model = scoring.BagModel(readers.weights(len(text).to_bytes(8, "little") + text + body), KINDS)
    found = ranking.searched(session_repairs(spark, sf_dir).select("sid", "dist", "repair"), ["sid"], 5, model=model, vocabulary=set(KINDS))
    return found.select("sid", F.col("rank").cast("long").alias("rank"), F.col("reranked").cast("long").alias("reranked"), F.array_join("repair", " ").alias("repair"))


CODES = ["and", "de", "der", "la", "of", "the"]


def document_codes(spark, sf_dir):
    """Each document's tokens as places in a list of terminals, others as holes."""
    tokens = X.without_empty(X.tokenise(F.coalesce("text", F.lit(""))))
    known = table(spark, sf_dir, "documents").select("doc_id", X.code_points(X.abstracted(tokens, CODES), CODES).alias("c"))
    return known.select("doc_id", F.size("c").cast("long").alias("n_tokens"), F.size(F.filter("c", lambda x: x < 0)).cast("long").alias("n_holes"), F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + F.greatest(x, F.lit(0))).alias("code_sum"))


def page_text(spark, sf_dir):
    """The text of each page, as its length and hash, and whether a token looks like a stub."""
    html = F.coalesce("html", F.lit(""))
    text = X.plain_text(html)
    return table(spark, sf_dir, "pages").select("page_id", F.length(text).cast("long").alias("n_chars"), F.md5(text.cast("binary")).alias("md5"), X.has_stub(X.tokenise(html)).alias("has_stub"))


def name_prefixes(spark, sf_dir):
    """The longest common prefix of the names of each brand's parts."""
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array(F.min("p_name"), F.max("p_name")).alias("w")).select("p_brand", X.lcp(F.col("w")).alias("prefix"))


def order_line_errors(spark, sf_dir):
    """How many of the lines written for orders Python rejects, by error."""
    line = F.when(F.col("o_orderstatus") == "O", "x = 1").when(F.col("o_orderstatus") == "F", "x =").otherwise("(x")
    return X.rejections(table(spark, sf_dir, "orders").select(line.alias("line")), "line").select("error", F.col("count").alias("n"))


def event_latest(spark, sf_dir):
    """Each user's last event, as a batch of prompts is conflated."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("editor"), "ts", F.col("event_type").alias("line"))
    return prompts.latest(e).select("editor", "line")


def event_pauses(spark, sf_dir):
    """How many pauses of an hour or more end each user's events, and how many of them a view."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("editor"), "ts", F.col("event_type").alias("line"))
    found = prompts.settled(e, "1 hour")
    return found.groupBy("editor").agg(F.count("*").alias("n_pauses"), F.count_if(F.col("line") == "view").alias("n_view"))


def matrix_square(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    m = li.groupBy((F.col("l_partkey") % 60).alias("r"), (F.col("l_suppkey") % 60).alias("c")).agg(F.count("*").alias("v"))
    return relational.matrix_square(m)


def programs(spark, sf_dir):
    """A countdown for each part, from its size; parts of size 13 don't end before the step limit."""
    m = machines
    word = lambda op, arg: (F.shiftleft(arg, m.OPCODE) + op).cast("int")
    n = F.when(F.col("p_size") == 13, F.lit(1 << 20)).otherwise(F.col("p_size")).cast("int")
    code = F.array(word(m.LOD, n), word(m.STO, F.lit(100)), word(m.PRI, F.lit(100)), word(m.LOD, F.lit(m.WORD)), word(m.ADD, F.lit(100)), word(m.STO, F.lit(100)), word(m.BNZ, F.lit(3)))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vid"), "p_size", code.alias("program"))


def rasp_histogram(spark, sf_dir):
    return machines.histogram(machines.run(programs(spark, sf_dir), 5000), 5000, 50)


def rasp_ends(spark, sf_dir):
    """The parts whose machines run longest, and how many machines halt by themselves."""
    ran = machines.run(programs(spark, sf_dir), 5000)
    return machines.longest(ran, 5).select("vid", "steps").crossJoin(machines.halted_count(ran, 5000))  # one row


def funnel_stubs(spark, sf_dir):
    """For each region the first strings of a stub."""
    s = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("sid"), F.array(F.lit("<Middle>")).alias("tokens"))
    return repairing.stub_strings(s, load(FUNNEL)).select("sid", F.col("rank").cast("long").alias("rank"), F.array_join("string", " ").alias("string"))


def typed_expressions(spark, sf_dir):
    """Expressions over nations and regions as values."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit("Nation").alias("type"))
    values = nation.unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.lit("Region").alias("type")))
    fns = spark.createDataFrame([("now", [], "Date"), ("label", ["Place"], "Text"), ("trade", ["Nation", "Nation"], "Amount")], "name string, params array<string>, ret string")
    members = spark.createDataFrame([("Nation", "region", None, "Region")], "owner string, name string, params array<string>, ret string")
    subtypes = spark.createDataFrame([("Nation", "Place"), ("Region", "Place")], "sub string, sup string")
    return typed.expressions(values, fns, members, subtypes, 6).withColumn("len", F.col("len").cast("long"))


_QUERIES = [session_accept, session_tree_count, session_active_cells, session_trees, session_segments, session_scenarios, session_fragments, session_led, session_repairs_topk, session_complete_holes, session_suffixes, session_plans, session_samples, order_flag_accept, order_chart_joins, dialogue_accept, tag_balance, token_ngrams4, ngram_cost, automaton_cost, prefix_sums, edit_distance, edit_signature_dedup, fair_merge, grammar_stats, grammar_adjacency, session_backs, session_distributions, session_bounds, session_distances, session_subtrees, session_leaves, session_tree_nodes, session_reach, session_alignment, session_display, session_dispatch, line_repairs, session_ngram_rank, event_draws, part_programs, event_invariance, session_lists, holed_chart_joins, example_stats, ngram_file_cost, automaton_file_cost, order_normal_accept, dialogue_documents, rasp_saved, session_rerank, document_codes, page_text, name_prefixes, order_line_errors, event_latest, event_pauses, matrix_square, rasp_histogram, rasp_ends, funnel_stubs, typed_expressions]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return answers.oracle_sql()


def grammar(name: str) -> Grammar:
    return load(GRAMMARS[name])
