"""DuckDB SQL of the same questions: closures written out span by span, languages unfolded from their rules by recursion."""

from __future__ import annotations

import itertools

from chartwright.functions.grammar import START, Grammar

#: Sessions of a user's events in a day, and other sequences, as rows (sid, q, tok).
SESSIONS = "SELECT user_id || ':' || CAST(CAST(ts AS DATE) AS VARCHAR) AS sid, CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS INT) AS q, event_type AS tok FROM events"
ORDERS = "SELECT CAST(l_orderkey AS VARCHAR) AS sid, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INT) AS q, l_returnflag || l_linestatus AS tok FROM lineitem"
DIALOGUES = "SELECT CAST(conv_id AS VARCHAR) AS sid, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS q, role AS tok FROM conversations"


def values(rows: list[tuple], names: str) -> str:
    lit = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS _({names})"


def chart_ctes(tokens_sql: str, g: Grammar, max_span: int) -> str:
    """WITH clause whose last table, chart, has (sid, q, q2, nt, n); sentences has (sid, len)."""
    out = [f"tok AS MATERIALIZED ({tokens_sql})", "sentences AS MATERIALIZED (SELECT sid, count(*) AS len FROM tok GROUP BY sid)"]
    out += [f"bin AS (SELECT * FROM {values(list(g.binary), 'a, b, c')})", f"unit AS (SELECT * FROM {values(list(g.unit), 'a, t')})"]
    out.append("s1 AS MATERIALIZED (SELECT sid, q, q + 1 AS q2, a AS nt, CAST(count(*) AS HUGEINT) AS n FROM tok JOIN unit ON tok = t OR tok = '_' GROUP BY ALL)")
    for k in range(2, max_span + 1):
        pairs = " UNION ALL ".join(f"SELECT l.sid, l.q, r.q2, l.nt AS b, r.nt AS c, l.n * r.n AS n FROM s{i} l JOIN s{k - i} r ON l.sid = r.sid AND l.q2 = r.q" for i in range(1, k))
        out.append(f"s{k} AS MATERIALIZED (SELECT sid, q, q2, a AS nt, CAST(sum(n) AS HUGEINT) AS n FROM ({pairs}) p JOIN bin USING (b, c) GROUP BY ALL)")
    out.append("chart AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(1, max_span + 1)) + ")")
    return "WITH " + ",\n".join(out)


def accept_sql(tokens_sql: str, g: Grammar, max_span: int) -> str:
    return chart_ctes(tokens_sql, g, max_span) + f"\nSELECT s.sid, s.len AS n_tokens, c.n IS NOT NULL AS accepted FROM sentences s LEFT JOIN chart c ON c.sid = s.sid AND c.q = 0 AND c.q2 = s.len AND c.nt = '{START}'"


def count_sql(tokens_sql: str, g: Grammar, max_span: int) -> str:
    return chart_ctes(tokens_sql, g, max_span) + f"\nSELECT s.sid, CAST(coalesce(c.n, 0) AS VARCHAR) AS n_trees FROM sentences s LEFT JOIN chart c ON c.sid = s.sid AND c.q = 0 AND c.q2 = s.len AND c.nt = '{START}'"


def cells_sql(tokens_sql: str, g: Grammar, max_span: int) -> str:
    return chart_ctes(tokens_sql, g, max_span) + "\nSELECT sid, q2 - q AS span, count(*) AS n_active FROM chart GROUP BY ALL"


def language(g: Grammar, max_len: int) -> list[tuple[str, ...]]:
    """All strings of a grammar up to a length, by concatenation; tests hold operators against it."""
    by: dict[str, dict[int, set]] = {}
    for a, t in g.unit:
        by.setdefault(a, {}).setdefault(1, set()).add((t,))
    for n in range(2, max_len + 1):
        for a, b, c in g.binary:
            for i in range(1, n):
                for x, y in itertools.product(by.get(b, {}).get(i, ()), by.get(c, {}).get(n - i, ())):
                    by.setdefault(a, {}).setdefault(n, set()).add(x + y)
    return sorted(s for ss in by.get(START, {}).values() for s in ss)


#: Event types in order, one letter each in codes.
KINDS = ["click", "error", "purchase", "signup", "view"]


def coded(text: str) -> str:
    """SQL of a blank-separated token text as one letter a token."""
    for i, k in enumerate(KINDS):
        text = f"replace({text}, '{k}', '{chr(65 + i)}')"
    return f"replace({text}, ' ', '')"


def said_ctes(tokens_sql: str = SESSIONS) -> str:
    """WITH clause whose last table, said, has (sid, sentence, code, n) of all sentences."""
    return f"""WITH RECURSIVE tok AS MATERIALIZED ({tokens_sql}),
spoken AS (SELECT sid, string_agg(tok, ' ' ORDER BY q) AS sentence, count(*) AS n FROM tok GROUP BY sid),
said AS MATERIALIZED (SELECT sid, sentence, {coded("sentence")} AS code, n FROM spoken)"""


def funnel_ctes(more: int, tokens_sql: str = SESSIONS) -> str:
    """said_ctes() and words (word, code, len): the funnel's language, unfolded from its rules up to `more` tokens beyond the longest sentence."""
    return said_ctes(tokens_sql) + f""",
middle(w, k) AS (SELECT * FROM (VALUES ('click', 1), ('click click', 2), ('view click', 2)) AS _(w, k)
  UNION ALL SELECT 'click ' || w || ' error', k + 2 FROM middle WHERE k < (SELECT max(n) + {more} FROM said)),
texts AS (SELECT DISTINCT e || CASE WHEN w <> '' THEN ' ' || w ELSE '' END || ' ' || x AS word FROM (VALUES ('view'), ('signup')) AS a(e), (SELECT w FROM middle UNION ALL SELECT '') m, (VALUES ('purchase'), ('error'), ('click purchase')) AS b(x)),
words AS MATERIALIZED (SELECT word, {coded("word")} AS code, length({coded("word")}) AS len FROM texts)"""


def near_ctes(radius: int) -> str:
    """funnel_ctes() and near (sid, sentence, word, len, dist): all words within the radius of each sentence."""
    return funnel_ctes(radius) + f""",
kinds AS MATERIALIZED (SELECT DISTINCT code FROM said),
pairs AS MATERIALIZED (SELECT k.code, w.word, w.len, levenshtein(k.code, w.code) AS dist FROM kinds k JOIN words w ON abs(length(k.code) - w.len) <= {radius}),
near AS MATERIALIZED (SELECT s.sid, s.sentence, p.word, p.len, p.dist FROM said s JOIN pairs p USING (code) WHERE p.dist <= {radius})"""


def rules_ctes(grammars: dict[str, str]) -> str:
    """WITH clause whose last tables count the original form (counted0) and the normal form (counted1) of grammar texts, each (name, nonterminals, terminals, productions), without flags."""
    lines = values([(name, line) for name, text in grammars.items() for line in text.strip().split("\n")], "name, line")
    return f"""WITH RECURSIVE lines AS (SELECT name, trim(split_part(line, '->', 1)) AS a, unnest(string_split(split_part(line, '->', 2), '|')) AS alt FROM {lines}),
rules AS MATERIALIZED (SELECT DISTINCT name, a, list_filter(string_split(trim(alt), ' '), lambda x: x <> '') AS r FROM lines),
lefts AS (SELECT DISTINCT name, a AS x FROM rules),
symbols AS (SELECT DISTINCT name, unnest(r) AS x FROM rules),
counted0 AS (SELECT name, (SELECT count(*) FROM lefts l WHERE l.name = n.name) AS nonterminals, (SELECT count(*) FROM symbols s WHERE s.name = n.name AND NOT EXISTS (SELECT 1 FROM lefts l WHERE l.name = s.name AND l.x = s.x)) AS terminals, (SELECT count(*) FROM rules r WHERE r.name = n.name) AS productions FROM (SELECT DISTINCT name FROM rules) n),
inner_ AS (SELECT DISTINCT s.name, s.x FROM (SELECT name, unnest(r) AS x FROM rules WHERE len(r) > 1) s JOIN lefts l ON l.name = s.name AND l.x = s.x),
kept AS (SELECT name, x FROM inner_ UNION SELECT DISTINCT name, 'START' FROM rules),
closure(name, a, b) AS (SELECT name, x, x FROM kept UNION SELECT c.name, c.a, r.r[1] FROM closure c JOIN rules r ON r.name = c.name AND r.a = c.b AND len(r.r) = 1 JOIN lefts l ON l.name = r.name AND l.x = r.r[1]),
closed AS (SELECT DISTINCT c.name, c.a, r.r FROM closure c JOIN rules r ON r.name = c.name AND r.a = c.b WHERE len(r.r) > 1 OR NOT EXISTS (SELECT 1 FROM lefts l WHERE l.name = r.name AND l.x = r.r[1])),
parts(name, a, r) AS (SELECT name, a, r FROM closed UNION SELECT name, array_to_string(r[2:], '.'), r[2:] FROM parts WHERE len(r) > 2),
lift AS (SELECT s.name, s.x, CASE WHEN l.x IS NULL THEN 'F.' || s.x ELSE s.x END AS y FROM symbols s LEFT JOIN lefts l ON l.name = s.name AND l.x = s.x),
binary_ AS (SELECT DISTINCT p.name, p.a, b.y AS b, CASE WHEN len(p.r) = 2 THEN c.y ELSE array_to_string(p.r[2:], '.') END AS c FROM parts p JOIN lift b ON b.name = p.name AND b.x = p.r[1] JOIN lift c ON c.name = p.name AND c.x = p.r[2] WHERE len(p.r) > 1),
unit AS (SELECT DISTINCT name, a, r[1] AS t FROM parts WHERE len(r) = 1 UNION SELECT DISTINCT p.name, l.y, l.x FROM (SELECT name, unnest(CASE WHEN len(r) = 2 THEN r ELSE r[1:1] END) AS x FROM parts WHERE len(r) > 1) p JOIN lift l ON l.name = p.name AND l.x = p.x WHERE l.y <> l.x),
names AS (SELECT name, a AS x FROM unit UNION SELECT name, a FROM binary_ UNION SELECT name, b FROM binary_ UNION SELECT name, c FROM binary_),
counted1 AS (SELECT n.name, (SELECT count(*) FROM names x WHERE x.name = n.name) AS nonterminals, (SELECT count(DISTINCT t) FROM unit u WHERE u.name = n.name) AS terminals, (SELECT count(*) FROM binary_ b WHERE b.name = n.name) + (SELECT count(*) FROM unit u WHERE u.name = n.name) AS productions FROM (SELECT DISTINCT name FROM rules) n)"""
