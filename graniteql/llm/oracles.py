"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

#: op9: sets of 4-word shingles, links by counting common shingles, components by following links.
NGRAM_JOIN = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i+3], ' ') FOR i IN generate_series(1, len(w) - 3)]) END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
often AS (SELECT g FROM u GROUP BY g HAVING count(*) > 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c FROM (SELECT * FROM u SEMI JOIN often USING (g)) a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p WHERE 100 * c >= 85 * (nx + ny - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT s.doc_id, CAST(len(any_value(s.s)) AS BIGINT) AS n_shingles, min(r.y) AS component_id FROM s JOIN r ON r.x = s.doc_id GROUP BY s.doc_id
"""

_GENERAL = "'ac', 'asn', 'co', 'com', 'edu', 'firm', 'gen', 'go', 'gob', 'gouv', 'gov', 'gv', 'ind', 'info', 'ltd', 'me', 'mil', 'ne', 'net', 'nhs', 'nom', 'or', 'org', 'plc', 'sch', 'web'"


def _strength(source: str, k: str, n: str, m: str) -> str:
    return f"(SELECT 1 / least(greatest(CASE WHEN sum({m} * (1 - {m}) * ({n} - 1)) > 0 THEN (sum({n} * ({k} / {n} - {m}) ** 2) - sum({m} * (1 - {m}))) / sum({m} * (1 - {m}) * ({n} - 1)) ELSE 0.5 END, 0.001), 0.5) - 1 FROM {source} WHERE {n} > 0)"


#: op6: rules by the longest that fits, then beta-binomial posteriors from suffix to domain to host.
HOST_REPUTATION = f"""
WITH h AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
rules(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
fits AS (SELECT page_id, arg_max(rules.h || rules.p, length(rules.h || rules.p)) AS rule, arg_max(verdict, length(rules.h || rules.p)) AS ruled FROM h JOIN rules ON (h.host = rules.h OR ends_with(h.host, '.' || rules.h)) AND starts_with(h.path, rules.p) GROUP BY page_id),
x AS (SELECT h.*, rule, ruled FROM h LEFT JOIN fits USING (page_id)),
c AS (SELECT host, CAST(count(ruled) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE ruled = 'block') AS DOUBLE) AS k, regexp_replace(host, ':[0-9]*$', '') AS bare, string_split(bare, '.') AS a FROM x GROUP BY host),
d AS (SELECT host, bare, n, k, a, CASE WHEN regexp_full_match(bare, '[0-9.]+') THEN 0 WHEN length(a[-1]) = 2 AND len(a) > 1 AND a[-2] IN ({_GENERAL}) THEN 2 ELSE 1 END AS t FROM c),
e AS (SELECT host, n, k, CASE WHEN t = 0 THEN bare ELSE array_to_string(a[-(t + 1):], '.') END AS domain, CASE t WHEN 0 THEN '' WHEN 1 THEN a[-1] ELSE array_to_string(a[-2:], '.') END AS suffix FROM d),
f AS (SELECT domain, suffix, sum(n) AS dn, sum(k) AS dk FROM e GROUP BY ALL),
g AS (SELECT suffix, sum(dn) AS sn, sum(dk) AS sk FROM f GROUP BY ALL),
t AS (SELECT (coalesce(sum(sk), 0) + 1) / (coalesce(sum(sn), 0) + 2) AS mean FROM g),
gs AS (SELECT g.*, mean FROM g, t),
fs AS (SELECT f.*, sn, sk, mean, (sk + 1) / (sn + 2) AS sraw FROM f JOIN gs USING (suffix)),
es AS (SELECT e.*, dn, dk, sn, sk, mean, (dk + 1) / (dn + 2) AS draw FROM e JOIN fs USING (domain, suffix)),
q AS (SELECT {_strength("gs", "sk", "sn", "mean")} AS ks, {_strength("fs", "dk", "dn", "sraw")} AS kd, {_strength("es", "k", "n", "draw")} AS kh),
m AS (SELECT host, n, kh, (k + kh * dm) / (n + kh) AS hm FROM (SELECT *, (dk + kd * sm) / (dn + kd) AS dm FROM (SELECT es.*, q.*, (sk + ks * mean) / (sn + ks) AS sm FROM es, q)))
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN hm - 1.6448536269514722 * sqrt(hm * (1 - hm) / (n + kh + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict FROM x JOIN m USING (host)
"""


def crc32(text: str) -> str:
    """The unsigned crc32 of an ASCII string: its bytes are put in one by one, each followed by eight shifts."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: list_concat([CAST(ascii(c) AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1])))"
    return f"xor(list_reduce({steps}, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END, CAST(4294967295 AS BIGINT)), 4294967295)"


def _least(*ways: str) -> str:
    return f"list_sort(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))[1]"


def _way(after: str, price: str, edit: str, turn: str | None = None) -> str:
    """A way to go on: price, audit, turns; `after` is what follows it."""
    turns = f"list_prepend({turn}, {after}.turns)" if turn else f"{after}.turns"
    return f"{{'price': {after}.price + {price}, 'audit': '{edit}' || {after}.audit, 'turns': {turns}}}"


def _settled(state: str, keeps: dict[str, str], title: str) -> str:
    """The cheapest way on from a state whose next turn's edit deals with row d."""
    kept = [f"CASE WHEN may AND d.initial = '{i}' THEN {_way(f'v.{to}', 'cut', 'K', 'd.said')} END" for i, to in keeps.items()]
    to = {"user": "u", "assistant": "a"}[title]
    retitled = f"CASE WHEN may THEN {_way(f'v.{to}', '1 + cut', 'R', chr(39) + title + ':' + chr(39) + ' || d.text')} END"
    return _least(_way(f"v.{state}", "2", "D"), *kept, retitled)


_USER, _ASSISTANT = "'user:'", "'assistant:'"

#: op11: damage by a draw, faults, then the cheapest edits from a conversation's end to its start; what may follow a state
#: is held as its price, its audit and its turns.
CONVERSATION_REPAIR = rf"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations),
hurt AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy FROM raw WHERE k <> 0),
numbered AS (SELECT *, role || ':' || text AS said, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM hurt),
faults AS (SELECT *, NOT regexp_matches(text, '[^ 	-
]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][ 	-
]*$') AS open, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM numbered),
d AS (SELECT *, NOT blank AND NOT again AS may, CASE WHEN open THEN 5 ELSE 0 END AS cut FROM faults),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE NOT blank AND again) AS duplicate, count(*) FILTER (WHERE may AND open) AS truncated, count(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM d GROUP BY conv_id),
v AS (
SELECT conv_id, n AS i, {{'price': 0, 'audit': '', 'turns': CAST([] AS VARCHAR[])}} AS o, {{'price': 10, 'audit': 'II', 'turns': [{_USER}, {_ASSISTANT}]}} AS s, {{'price': 5, 'audit': 'I', 'turns': [{_ASSISTANT}]}} AS u, {{'price': 0, 'audit': '', 'turns': CAST([] AS VARCHAR[])}} AS a FROM counts
UNION ALL
SELECT conv_id, i, {_least("o", _way("u", "5", "I", _USER), _way(f"{{'price': a.price + 5, 'audit': 'I' || a.audit, 'turns': list_prepend({_ASSISTANT}, a.turns)}}", "5", "I", _USER))},
{_least("s", _way("u", "5", "I", _USER), _way(f"{{'price': a.price + 5, 'audit': 'I' || a.audit, 'turns': list_prepend({_ASSISTANT}, a.turns)}}", "5", "I", _USER))},
{_least("u", _way("a", "5", "I", _ASSISTANT))}, {_least("a", _way("u", "5", "I", _USER))}
FROM (SELECT v.conv_id, v.i - 1 AS i, {_settled("o", {"s": "s", "u": "u"}, "user")} AS o, {_settled("s", {"u": "u"}, "user")} AS s, {_settled("u", {"a": "a"}, "assistant")} AS u, {_settled("a", {"u": "u"}, "user")} AS a FROM v JOIN d ON v.conv_id IS NOT DISTINCT FROM d.conv_id AND v.i = d.i)
),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(o.price, 0) AS BIGINT) AS cost, coalesce(o.audit, '') AS audit, sha256(coalesce(array_to_string(o.turns, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN counts ON ids.conv_id IS NOT DISTINCT FROM counts.conv_id LEFT JOIN (SELECT * FROM v WHERE i = 0) w ON ids.conv_id IS NOT DISTINCT FROM w.conv_id
"""

#: op12: conversations rebuilt as lists of turns; a node is a list, and what lies above it are its smallest member's lists.
CONVERSATION_TRIE = f"""
WITH t AS (SELECT conv_id AS c, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS said, length(coalesce(text, '')) AS chars, turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(said ORDER BY turn NULLS FIRST, sha256(said)) AS said, list(chars ORDER BY turn NULLS FIRST, sha256(said)) AS chars FROM t GROUP BY c),
h AS (SELECT c, said, chars, c - (c % 100 + 100) % 100 AS base, {crc32("CAST(c AS VARCHAR)")} % 6 AS h FROM own),
whole AS (SELECT h.c, list_concat(coalesce(b.said[1:h.h], []), h.said[h.h + 1:]) AS said, list_concat(coalesce(b.chars[1:h.h], []), h.chars[h.h + 1:]) AS chars FROM h LEFT JOIN own b ON h.base = b.c),
paths AS (SELECT c, d, said[1:d] AS node, said[1:d - 1] AS above, coalesce(chars[d], 0) AS chars, d = len(said) AS ends FROM (SELECT *, unnest(generate_series(0, len(said))) AS d FROM whole)),
nodes AS (SELECT node, any_value(above) AS above, d, min(c) AS conv, count(*) AS n, any_value(chars) AS chars, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends) AS ends FROM paths GROUP BY node, d),
kids AS (SELECT above AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY above),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (node)),
sums AS (SELECT paths.node, count(*) FILTER (WHERE u.n_children = 0) AS n_leaves, sum((u.n - 1) * u.chars) AS saved FROM full_nodes u JOIN paths ON paths.c = u.conv AND paths.d <= u.d GROUP BY paths.node)
SELECT x.conv AS conv_id, CAST(x.d AS BIGINT) AS depth, p.conv AS parent_conv_id, CAST(x.n AS BIGINT) AS n_convs, CAST(x.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(x.ends, '')) AS ends_sha256
FROM full_nodes x JOIN sums USING (node) LEFT JOIN nodes p ON x.d > 0 AND p.node = x.above
"""
