"""The DuckDB SQL of each registered query."""

from __future__ import annotations

from chartwright.functions.grammar import load
from chartwright.grammars import FLAGS, FUNNEL, GRAMMARS, IF, SESSION, TALK
from chartwright.plans import oracle

#: Spans of the SQL charts, which write each span out; the test tables' longest sequences at scale 0.1 are 11, 17 and 11. The queries have no such bound.
SPANS = {"sessions": 12, "orders": 18, "dialogues": 12}
#: The k nearest words in order, from near.
RANKED = ", m AS (SELECT *, min(dist) OVER (PARTITION BY sid) AS least FROM near), r AS (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY dist, len, word) AS rank, dist, word AS repair FROM m WHERE dist <= least + 1)"
#: The widest cells of the funnel's own nonterminals, none inside another, from chart.
TOPS = """, own AS MATERIALIZED (SELECT sid, q, q2, min(nt) AS label FROM chart WHERE nt IN ('START', 'Entry', 'Middle', 'Exit') GROUP BY sid, q, q2),
tops AS MATERIALIZED (SELECT * FROM own o WHERE NOT EXISTS (SELECT 1 FROM own p WHERE p.sid = o.sid AND p.q <= o.q AND p.q2 >= o.q2 AND (p.q <> o.q OR p.q2 <> o.q2)))"""
#: Every other token of a sentence as a hole.
HOLES = r"p AS MATERIALIZED (SELECT sid, n, regexp_replace(code, '(.).', '\1_', 'g') AS pat FROM said)"
#: Each session and the same user's one before.
LAST = "l AS (SELECT sid, sentence, code, lag(code) OVER w AS last, lag(sentence) OVER w AS before FROM said WINDOW w AS (PARTITION BY split_part(sid, ':', 1) ORDER BY split_part(sid, ':', 2)))"
#: Strings of Middle of at most 12 tokens.
STUBS = "stubs(w, k) AS (SELECT * FROM (VALUES ('click', 1), ('click click', 2), ('view click', 2)) AS _(w, k) UNION ALL SELECT 'click ' || w || ' error', k + 2 FROM stubs WHERE k + 2 <= 12)"
FRAMED = f"tok AS ({oracle.SESSIONS}), f AS (SELECT sid, ['BOS', 'NEWLINE'] || list(tok ORDER BY q) || ['NEWLINE', 'EOS'] AS w FROM tok GROUP BY sid), r AS (SELECT sid, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) AS g FROM f), c AS (SELECT g, count(*) AS n FROM r GROUP BY g), t AS (SELECT sum(n) AS total FROM c)"


def oracle_sql() -> dict[str, str]:
    session = oracle.chart_ctes(oracle.SESSIONS, load(SESSION), SPANS["sessions"])
    funnel = oracle.chart_ctes(oracle.SESSIONS, load(FUNNEL), SPANS["sessions"])
    near = oracle.near_ctes(2)
    holed = oracle.count_sql(f"SELECT sid, q, CASE WHEN q % 2 = 1 THEN '_' ELSE tok END AS tok FROM ({oracle.SESSIONS})", load(FUNNEL), SPANS["sessions"])
    found = _answers(session, funnel, near)
    return found | {
        "holed_chart_joins": holed,
        # fixed values: the sizes published with the worked example
        "example_stats": oracle.rules_ctes({"if": IF + "\n".join(f"START -> {a}" for a in ("S", "X", "P", "F", "IF", "BF", "O", "I", "N", "B", "BO"))}) + """
SELECT r_regionkey, x.* FROM region, (SELECT true AS flags, 'original' AS form, 12 AS nonterminals, 18 AS terminals, 38 AS productions UNION ALL SELECT true, 'normal', 24, 24, 72
  UNION ALL SELECT false, 'original', nonterminals, terminals, productions FROM counted0 UNION ALL SELECT false, 'normal', nonterminals, terminals, productions FROM counted1) x""",
        "ngram_file_cost": found["ngram_cost"],
        "automaton_file_cost": found["automaton_cost"],
        "order_normal_accept": found["order_flag_accept"],
        "rasp_saved": found["rasp_histogram"],
        "dialogue_documents": found["dialogue_accept"].replace("SELECT s.sid, s.len AS n_tokens, c.n IS NOT NULL AS accepted FROM", "SELECT said.sentence, bool_and(c.n IS NOT NULL) AS accepted FROM") + " JOIN (SELECT sid, string_agg(tok, ' ' ORDER BY q) AS sentence FROM tok GROUP BY sid) said ON said.sid = s.sid GROUP BY said.sentence",
        "session_rerank": near + RANKED + """, k AS (SELECT sid, rank, repair, list_sum(list_transform(string_split(repair, ' '), lambda t: list_position(['click', 'error', 'purchase', 'signup', 'view'], t) - 1)) / len(string_split(repair, ' ')) AS m FROM r WHERE rank <= 5)
SELECT sid, rank, row_number() OVER (PARTITION BY sid ORDER BY m DESC, rank) AS reranked, repair FROM k""",
    }


def _answers(session: str, funnel: str, near: str) -> dict[str, str]:
    return {
        "session_accept": oracle.accept_sql(oracle.SESSIONS, load(SESSION), SPANS["sessions"]),
        "session_tree_count": oracle.count_sql(oracle.SESSIONS, load(SESSION), SPANS["sessions"]),
        "session_active_cells": oracle.cells_sql(oracle.SESSIONS, load(SESSION), SPANS["sessions"]),
        "session_backs": session + "\nSELECT l.sid, r.q2 - l.q AS span, count(*) AS n_backs FROM chart l JOIN chart r ON l.sid = r.sid AND l.q2 = r.q JOIN bin ON b = l.nt AND c = r.nt GROUP BY ALL",
        "session_distributions": session + """
SELECT l.sid, CAST(l.q AS BIGINT) AS q, CAST(r.q2 AS BIGINT) AS q2, a AS nt, CAST(l.q2 AS BIGINT) AS m, b, c, CAST(l.n * r.n AS VARCHAR) AS size,
  CAST(coalesce(sum(l.n * r.n) OVER (PARTITION BY l.sid, l.q, r.q2, a ORDER BY l.q2, CASE b WHEN 'START' THEN '' ELSE b END, CASE c WHEN 'START' THEN '' ELSE c END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS VARCHAR) AS before
FROM chart l JOIN chart r ON l.sid = r.sid AND l.q2 = r.q JOIN bin ON b = l.nt AND c = r.nt""",
        "session_leaves": session + "\nSELECT s.sid, string_agg(t.tok, ' ' ORDER BY t.q) AS leaves, s.len AS root_end FROM sentences s JOIN chart k ON k.sid = s.sid AND k.q = 0 AND k.q2 = s.len AND k.nt = 'START' JOIN tok t ON t.sid = s.sid GROUP BY s.sid, s.len",
        "session_tree_nodes": session.replace("WITH ", "WITH RECURSIVE ", 1) + """, picks AS MATERIALIZED (SELECT * FROM (SELECT l.sid, l.q, r.q2, a, l.q2 AS m, b, c, row_number() OVER (PARTITION BY l.sid, l.q, r.q2, a ORDER BY l.q2, b, c) AS k FROM chart l JOIN chart r ON l.sid = r.sid AND l.q2 = r.q JOIN bin ON b = l.nt AND c = r.nt) WHERE k = 1),
nodes(sid, q, q2, nt) AS (SELECT s.sid, 0, CAST(s.len AS INT), 'START' FROM sentences s JOIN chart k ON k.sid = s.sid AND k.q = 0 AND k.q2 = s.len AND k.nt = 'START'
  UNION ALL SELECT n.sid, CASE side WHEN 0 THEN p.q ELSE p.m END, CASE side WHEN 0 THEN p.m ELSE p.q2 END, CASE side WHEN 0 THEN p.b ELSE p.c END FROM nodes n JOIN picks p ON p.sid = n.sid AND p.q = n.q AND p.q2 = n.q2 AND p.a = n.nt, (VALUES (0), (1)) AS _(side))
SELECT n.sid, CASE WHEN n.q2 = n.q + 1 THEN t.tok ELSE n.nt END AS label, CAST(n.q AS BIGINT) AS lo, CAST(n.q2 AS BIGINT) AS hi FROM nodes n JOIN tok t ON t.sid = n.sid AND t.q = n.q WHERE n.q2 = n.q + 1 OR NOT contains(n.nt, '.')""",
        "session_reach": oracle.said_ctes() + "\nSELECT sid, n * (n + 1) // 2 AS n_pairs, (n + 1) * n * (n - 1) // 6 AS n_between FROM said",
        "session_subtrees": funnel + TOPS + "\nSELECT sid, q AS lo, q2 AS hi, label FROM tops",
        "session_segments": funnel + TOPS + """, marks AS (SELECT t.sid, t.q AS i, max(o.q) AS m FROM tok t JOIN sentences s ON s.sid = t.sid LEFT JOIN tops o ON o.sid = t.sid AND o.q <= t.q AND t.q < o.q2 AND (o.q2 - o.q > 1 OR s.len = 1) GROUP BY ALL),
cuts AS (SELECT *, CASE WHEN i > 0 AND lag(m) OVER (PARTITION BY sid ORDER BY i) IS NOT DISTINCT FROM m THEN 0 ELSE 1 END AS begins FROM marks),
runs AS (SELECT *, sum(begins) OVER (PARTITION BY sid ORDER BY i) AS run FROM cuts)
SELECT sid, CAST(min(i) AS INT) AS lo, CAST(max(i) + 1 AS INT) AS hi, CASE WHEN any_value(m) IS NULL THEN 'unparseable' ELSE 'parseable' END AS kind FROM runs GROUP BY sid, run""",
        "session_scenarios": oracle.funnel_ctes(0) + "\nSELECT CASE WHEN n > 1 THEN 'COMPLETION' WHEN code IN (SELECT code FROM words) THEN 'PARSEABLE' ELSE 'REPAIR' END AS scenario, count(*) AS n FROM said GROUP BY 1",
        "session_fragments": oracle.funnel_ctes(3) + """, k AS (SELECT DISTINCT code FROM said), i AS (SELECT code, unnest(range(1, length(code) + 1)) AS i FROM k),
f AS (SELECT code, max(CASE WHEN EXISTS (SELECT 1 FROM words w WHERE starts_with(w.code, left(x.code, x.i)) AND w.len <= x.i + 3) THEN x.i ELSE 0 END) AS prefix, max(CASE WHEN EXISTS (SELECT 1 FROM words w WHERE ends_with(w.code, right(x.code, x.i)) AND w.len <= x.i + 3) THEN x.i ELSE 0 END) AS suffix FROM i x GROUP BY code)
SELECT sid, CAST(prefix AS INT) AS prefix, CAST(suffix AS INT) AS suffix FROM said JOIN f USING (code)""",
        "session_led": near + "\nSELECT sid, min(dist) AS led FROM near GROUP BY sid",
        "session_distances": near + "\nSELECT sid, dist, count(*) AS n_words FROM near GROUP BY sid, dist",
        "session_repairs_topk": near + RANKED + "\nSELECT * FROM r WHERE rank <= 5",
        "session_display": near + RANKED + """, d AS (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY dist, length(repair), repair) AS rank, repair AS shown FROM r)
SELECT sid, rank, shown, repair AS by_score FROM d JOIN (SELECT sid, rank, repair FROM r) b USING (sid, rank) WHERE rank <= 3""",
        "session_complete_holes": oracle.funnel_ctes(0) + f", {HOLES}, r AS (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY word) AS rank, word AS completion FROM p JOIN words ON len = n AND words.code LIKE pat) SELECT * FROM r WHERE rank <= 29",
        "session_bounds": oracle.funnel_ctes(0) + f", {HOLES} SELECT sid, n AS length, min(word) AS least, max(word) AS greatest FROM p JOIN words ON len = n AND words.code LIKE pat GROUP BY sid, n",
        "session_dispatch": near + rf""", kind AS (SELECT *, CAST(split_part(sid, ':', 1) AS BIGINT) AS u FROM said),
scen AS MATERIALIZED (SELECT *, CASE WHEN u % 50 = 0 THEN 'STUB' WHEN u % 2 = 0 AND n > 1 THEN 'COMPLETION' WHEN code IN (SELECT code FROM words) THEN 'PARSEABLE' ELSE 'REPAIR' END AS scenario FROM kind),
holes AS (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY word) AS rank, word FROM (SELECT sid, n, regexp_replace(code, '(.).', '\1_', 'g') AS pat FROM scen WHERE scenario = 'COMPLETION') p JOIN words ON len = n AND words.code LIKE pat),
least AS (SELECT *, min(dist) OVER (PARTITION BY sid) AS least FROM near WHERE sid IN (SELECT sid FROM scen WHERE scenario = 'REPAIR')),
fixes AS (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY dist, len, word) AS rank, word FROM least WHERE dist <= least + 1),
{STUBS},
firsts AS (SELECT w, row_number() OVER (ORDER BY k, w) AS rank FROM stubs)
SELECT sid, 'COMPLETION' AS scenario, rank, word AS output FROM holes WHERE rank <= 29
UNION ALL SELECT sid, 'REPAIR', rank, word FROM fixes WHERE rank <= 29 UNION ALL SELECT sid, 'PARSEABLE', 1, NULL FROM scen WHERE scenario = 'PARSEABLE'
UNION ALL SELECT sid, 'STUB', rank, w FROM scen, firsts WHERE scenario = 'STUB' AND rank <= 29""",
        "session_suffixes": oracle.funnel_ctes(5) + ", r AS (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY len, word) AS rank, array_to_string(string_split(word, ' ')[CAST(n + 1 AS INT):], ' ') AS suffix FROM said JOIN words ON starts_with(words.code, said.code) AND len BETWEEN n AND n + 5) SELECT * FROM r WHERE rank <= 5",
        "session_plans": oracle.funnel_ctes(6) + """, ends AS MATERIALIZED (SELECT sid, n, word, len FROM said JOIN words ON starts_with(words.code, said.code) AND len BETWEEN n AND n + 6),
shortest AS (SELECT sid, min(len) AS least FROM ends GROUP BY sid), spots AS (SELECT e.sid, e.n, s.least, unnest(range(e.n + 1, s.least + 1)) AS j, word FROM ends e JOIN shortest s USING (sid)),
same AS (SELECT sid, n, j, min(string_split(word, ' ')[CAST(j AS INT)]) AS t, count(DISTINCT string_split(word, ' ')[CAST(j AS INT)]) AS k FROM spots GROUP BY ALL),
lead_ AS (SELECT sid, string_agg(t, ' ' ORDER BY j) AS forced FROM same s WHERE NOT EXISTS (SELECT 1 FROM same b WHERE b.sid = s.sid AND b.j <= s.j AND b.k > 1) GROUP BY sid)
SELECT sid, string_split(sentence, ' ')[-1] AS expanded, CAST(1 AS INT) AS candidates, true AS committed, coalesce(forced, '') AS forced, string_split(sentence, ' ')[-1] AS terminals FROM said JOIN shortest USING (sid) LEFT JOIN lead_ USING (sid)""",
        "automaton_cost": near + RANKED + """, f AS (SELECT ['BOS', 'NEWLINE'] || string_split(sentence, ' ') || ['NEWLINE', 'EOS'] AS w FROM said),
g AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]])) AS g FROM f), c AS (SELECT g[1] AS a, g[2] AS b, count(*) AS n FROM g GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b, CAST(round(-ln(n / sum(n) OVER (PARTITION BY a)) * 10000) AS BIGINT) AS cost FROM c),
k AS MATERIALIZED (SELECT sid, rank, dist, repair, string_split(repair, ' ') AS w FROM r WHERE rank <= 5),
fold(sid, rank, i, q, total) AS (SELECT sid, rank, 1, 'NEWLINE', CAST(0 AS BIGINT) FROM k
  UNION ALL SELECT x.sid, x.rank, x.i + 1, coalesce(e.b, x.q), x.total + coalesce(e.cost, 200000) FROM fold x JOIN k ON k.sid = x.sid AND k.rank = x.rank LEFT JOIN e ON e.a = x.q AND e.b = k.w[x.i] WHERE x.i <= len(k.w))
SELECT k.sid, CAST(k.rank AS INT) AS rank, CAST(k.dist AS INT) AS dist, k.repair, x.total + (k.dist + 1) * 10000000 AS score FROM k JOIN fold x ON x.sid = k.sid AND x.rank = k.rank AND x.i = len(k.w) + 1""",
        "session_ngram_rank": near + RANKED + """, f AS (SELECT ['BOS', 'NEWLINE'] || string_split(sentence, ' ') || ['NEWLINE', 'EOS'] AS w FROM said),
g AS (SELECT unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) AS g FROM f), c AS MATERIALIZED (SELECT g, count(*) AS n FROM g GROUP BY g), t AS MATERIALIZED (SELECT sum(n) AS total FROM c),
v AS (SELECT DISTINCT repair, ['BOS', 'NEWLINE'] || string_split(repair, ' ') || ['NEWLINE', 'EOS'] AS w FROM r), x AS (SELECT repair, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) AS g FROM v),
s AS MATERIALIZED (SELECT repair, CAST(sum(greatest(0, floor(-ln(coalesce(n, 1) / total) * 10000 + 0.5))) AS BIGINT) AS cost FROM x LEFT JOIN c USING (g), t GROUP BY repair),
o AS (SELECT sid, repair, dist * 10000000 + cost AS score, row_number() OVER (PARTITION BY sid ORDER BY dist * 10000000 + cost, dist, length(repair) - length(replace(repair, ' ', '')), repair) AS rank FROM r JOIN s USING (repair))
SELECT sid, rank, repair, score FROM o WHERE rank <= 2""",
        "session_lists": near + RANKED + "\nSELECT sid, '<ol>' || string_agg('<li>' || replace(repair, ' ', ' &lt;&gt; ') || '</li>', '' ORDER BY rank) || '</ol>' AS html FROM r WHERE rank <= 5 GROUP BY sid",
        "event_draws": """WITH a AS (SELECT event_id, (CAST(event_id AS HUGEINT) + 2654435769) % 4294967296 AS z FROM events),
b AS (SELECT event_id, xor(z, z >> 16) * 2246822507 % 4294967296 AS z FROM a), c AS (SELECT event_id, xor(z, z >> 13) * 3266489909 % 4294967296 AS z FROM b), d AS (SELECT event_id, CAST(xor(z, z >> 16) AS BIGINT) AS x FROM c),
p AS (SELECT event_id, x, xor(x, (x << 13) & 4294967295) AS y FROM d), q AS (SELECT event_id, x, xor(y, y >> 17) AS y FROM p), r AS (SELECT event_id, x, xor(y, (y << 5) & 4294967295) AS y FROM q)
SELECT event_id, x AS mixed, y % 1000 AS drawn FROM r WHERE y >= 296""",
        "part_programs": r"""SELECT p_partkey, 'fun f0(ipt: W ^ 3) -> W ^ 2 {' || chr(10) || '    scr[0] = ipt[' || (p_size % 3) || '] + scr[1];' || chr(10) || '    whl scr[0] {' || chr(10) || '        ife x {' || chr(10) || '            opt[' || (p_size % 2) || '] = 1' || chr(10) || '        } {' || chr(10) || '            hlt' || chr(10) || '        }' || chr(10) || '    }' || chr(10) || '}' AS program FROM part""",
        "event_invariance": "SELECT event_type AS tok, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1",
        "order_flag_accept": oracle.accept_sql(oracle.ORDERS, load(FLAGS), SPANS["orders"]),
        "order_chart_joins": oracle.count_sql(oracle.ORDERS, load(FLAGS), SPANS["orders"]),
        "dialogue_accept": oracle.accept_sql(oracle.DIALOGUES, load(TALK), SPANS["dialogues"]),
        "tag_balance": r"""WITH t AS (SELECT page_id, list_transform(regexp_extract_all(coalesce(html, ''), '</?(?:div|ul|li|nav|p)\b'), lambda x: CASE WHEN starts_with(x, '</') THEN -1 ELSE 1 END) AS s FROM pages)
SELECT page_id, CAST(len(list_filter(s, lambda x: x > 0)) AS BIGINT) AS n_open, CAST(coalesce(list_sum(s), 0) AS BIGINT) AS depth_left,
  coalesce(list_sum(s), 0) = 0 AND coalesce(list_min(list_transform(range(1, len(s) + 1), lambda i: list_sum(s[1:i]))), 0) >= 0 AS balanced FROM t""",
        "token_ngrams4": r"""WITH d AS (SELECT list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
f AS (SELECT ['BOS', 'NEWLINE'] || w || ['NEWLINE', 'EOS'] AS w FROM d), r AS (SELECT unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) AS gram FROM f)
SELECT gram, count(*) AS n FROM r GROUP BY gram""",
        "ngram_cost": f"WITH {FRAMED} SELECT sid, CAST(sum(greatest(0, floor(-ln(n / total) * 10000 + 0.5))) AS BIGINT) AS score FROM r JOIN c USING (g), t GROUP BY sid",
        "prefix_sums": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS qty, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM lineitem",
        "edit_distance": oracle.said_ctes() + f", {LAST} SELECT sid, levenshtein(last, code) AS dist FROM l WHERE last IS NOT NULL",
        "session_alignment": oracle.said_ctes() + f", {LAST} SELECT sid, levenshtein(last, code) AS cost, before AS old, sentence AS new FROM l WHERE last IS NOT NULL",
        "fair_merge": "WITH p AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS place FROM events), m AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY place, event_type) AS merged FROM p) SELECT * FROM m WHERE merged <= 10",
        "grammar_stats": oracle.rules_ctes(GRAMMARS) + "\nSELECT name, form, nonterminals, terminals, productions, (SELECT count(*) FROM events) AS n_events FROM (SELECT 'original' AS form, * FROM counted0 UNION ALL SELECT 'normal', * FROM counted1) x",
        "grammar_adjacency": oracle.rules_ctes({"flags": FLAGS}) + f""", tok AS ({oracle.ORDERS}), first_ AS (SELECT tok, count(*) AS k FROM tok WHERE q = 0 GROUP BY tok)
SELECT b.b AS left_symbol, b.c AS right_symbol, string_agg(b.a, ' ' ORDER BY b.a) AS parents, CAST(coalesce((SELECT sum(k) FROM first_ f JOIN unit u ON u.t = f.tok WHERE u.a = b.b), 0) AS BIGINT) AS n_began FROM binary_ b GROUP BY b.b, b.c""",
        "document_codes": r"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '' AND x <> 'ε') AS w FROM documents)
SELECT doc_id, len(w) AS n_tokens, len(list_filter(w, lambda x: NOT (x IN ('and', 'de', 'der', 'la', 'of', 'the')))) AS n_holes,
  CAST(coalesce(list_sum(list_transform(w, lambda x: coalesce(list_position(['and', 'de', 'der', 'la', 'of', 'the'], x), 0))), 0) AS BIGINT) AS code_sum FROM d""",
        "page_text": r"""WITH t AS (SELECT page_id, coalesce(html, '') AS html, replace(replace(replace(replace(replace(regexp_replace(coalesce(html, ''), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS x FROM pages)
SELECT page_id, length(x) AS n_chars, md5(x) AS md5, len(list_filter(string_split_regex(html, '[ \t\n\x0B\f\r]+'), lambda w: regexp_full_match(w, '<[^ \t\n\x0B\f\r]+>'))) > 0 AS has_stub FROM t""",
        "name_prefixes": "WITH b AS (SELECT p_brand, min(p_name) AS a, max(p_name) AS z FROM part GROUP BY p_brand) SELECT p_brand, left(a, (SELECT max(k) FROM range(0, length(a) + 1) t(k) WHERE left(a, k) = left(z, k))) AS prefix FROM b",
        "order_line_errors": "SELECT * FROM (SELECT CASE o_orderstatus WHEN 'O' THEN NULL WHEN 'F' THEN 'SyntaxError: invalid syntax' ELSE 'SyntaxError: ''('' was never closed' END AS error, count(*) AS n FROM orders GROUP BY 1) WHERE error IS NOT NULL",
        "line_repairs": "SELECT p_partkey AS line_id, CAST(1 AS BIGINT) AS dist, 'size = f ( )' AS fixed FROM part",
        "event_latest": "SELECT user_id AS editor, event_type AS line FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) AS k FROM events) WHERE k = 1",
        "event_pauses": "WITH e AS (SELECT user_id, ts, event_type, CASE WHEN lead(ts) OVER w IS NULL OR lead(ts) OVER w >= ts + INTERVAL 1 HOUR THEN 1 ELSE 0 END AS ends FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type)) SELECT user_id AS editor, sum(ends)::BIGINT AS n_pauses, count(*) FILTER (ends = 1 AND event_type = 'view') AS n_view FROM e GROUP BY user_id",
        "matrix_square": "WITH m AS (SELECT l_partkey % 60 AS r, l_suppkey % 60 AS c, count(*) AS v FROM lineitem GROUP BY ALL) SELECT a.r, b.c, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM m a JOIN m b ON a.c = b.r GROUP BY ALL",
        "rasp_histogram": """WITH RECURSIVE size AS (SELECT p_size, CAST(CASE WHEN p_size = 13 THEN 1 << 20 ELSE p_size END AS BIGINT) AS n, count(*) AS k FROM part GROUP BY p_size),
run(p_size, pc, acc, held, steps) AS (SELECT p_size, 0, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0 FROM size
  UNION ALL SELECT r.p_size, CASE WHEN pc = 6 AND acc <> 0 THEN 3 ELSE pc + 1 END, CASE pc WHEN 0 THEN s.n WHEN 3 THEN (1 << 29) - 1 WHEN 4 THEN (acc + held) & ((1 << 29) - 1) ELSE acc END, CASE WHEN pc IN (1, 5) THEN acc ELSE held END, steps + 1
  FROM run r JOIN size s ON s.p_size = r.p_size WHERE pc < 7 AND steps < 5000),
ended AS (SELECT p_size, max(steps) AS steps FROM run GROUP BY p_size)
SELECT CASE WHEN steps >= 5000 THEN 'timed out' ELSE (steps // 50 * 50) || '..' || (steps // 50 * 50 + 49) END AS bucket, CAST(sum(k) AS BIGINT) AS n FROM ended JOIN size USING (p_size) GROUP BY 1""",
        "rasp_ends": "SELECT p_partkey AS vid, CAST(5000 AS BIGINT) AS steps, (SELECT count(*) FROM part WHERE p_size <> 13) AS n_halted FROM part WHERE p_size = 13 ORDER BY p_partkey LIMIT 5",
        "funnel_stubs": f"WITH RECURSIVE {STUBS}, firsts AS (SELECT w AS string, row_number() OVER (ORDER BY k, w) AS rank FROM stubs) SELECT CAST(r_regionkey AS INT) AS sid, rank, string FROM region, firsts WHERE rank <= 50",
        "typed_expressions": """WITH place AS (SELECT n_name AS t, 'Nation' AS k FROM nation UNION SELECT r_name, 'Region' FROM region), n AS (SELECT t FROM place WHERE k = 'Nation'),
every AS (SELECT t AS text, k AS type, 1 AS len FROM place UNION SELECT t || '.region', 'Region', 3 FROM n UNION SELECT 'now()', 'Date', 3 UNION SELECT 'label(' || t || ')', 'Text', 4 FROM place
  UNION SELECT 'label(' || t || '.region)', 'Text', 6 FROM n UNION SELECT 'trade(' || a.t || ', ' || b.t || ')', 'Amount', 6 FROM n a, n b)
SELECT text, type, CAST(min(len) AS BIGINT) AS len FROM every GROUP BY text, type""",
    }
