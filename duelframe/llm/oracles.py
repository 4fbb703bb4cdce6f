"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from duelframe.llm import chat_format
from duelframe.llm import url_filter as uf

WORD = r"[^\x20\x09-\x0D]+"


def _share(name: str, rows: str, parents: Sequence[str], child: str, weights: Mapping[str, float], more: str = "") -> str:
    """CTEs that share ``budget`` of each parent among its children in ``rows`` (parents, child, supply, budget)."""
    weight = " ".join(f"WHEN '{k}' THEN {v:.1f}" for k, v in weights.items())
    weight = f"CASE {child} {weight} ELSE 1.0 END" if weight else "1.0"
    by = f"PARTITION BY {', '.join(parents)}" if parents else ""
    order = f"{by} ORDER BY supply / weight, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""
{name}_w AS (SELECT *, CAST({weight} AS DOUBLE) AS weight FROM {rows}),
{name}_l AS (SELECT *, (budget - coalesce(sum(supply) OVER ({order}), 0))
                 / (sum(weight) OVER ({by}) - coalesce(sum(weight) OVER ({order}), 0.0)) AS level FROM {name}_w),
{name} AS (SELECT {', '.join([*parents, child])}{more}, greatest(0.0, CASE WHEN supply <= level * weight THEN CAST(supply AS DOUBLE)
             ELSE max(CASE WHEN supply > level * weight THEN level END) OVER ({by}) * weight END) AS share FROM {name}_l)"""


def mix_sources(weights: Mapping[str, Mapping[str, float]], budget_share: float, epochs: int, seed: int = 17) -> str:
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS language, coalesce(source, '') AS source,
         'web' || CAST(coalesce(TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) AS INTEGER) % 4, 0) AS VARCHAR) AS domain,
         CAST(len(regexp_extract_all(text, '{WORD}')) AS BIGINT) AS n,
         md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS k
  FROM documents),
rows_ AS (SELECT * FROM d WHERE n > 0),
leaves AS (SELECT domain, language, source, CAST(sum(n) AS BIGINT) AS tokens, CAST(floor(sum(n) * {epochs}) AS BIGINT) AS supply
           FROM rows_ GROUP BY ALL),
top AS (SELECT domain, CAST(sum(supply) AS BIGINT) AS supply, any_value(b) AS budget
        FROM leaves, (SELECT CAST(floor(coalesce(sum(tokens), 0) * {budget_share}) AS DOUBLE) AS b FROM leaves) GROUP BY domain),
{_share("by_domain", "top", [], "domain", weights["domain"])},
mid AS (SELECT domain, language, CAST(sum(supply) AS BIGINT) AS supply, any_value(share) AS budget
        FROM leaves JOIN by_domain USING (domain) GROUP BY ALL),
{_share("by_lang", "mid", ["domain"], "language", weights["language"])},
low AS (SELECT domain, language, source, tokens, supply, share AS budget FROM leaves JOIN by_lang USING (domain, language)),
{_share("by_source", "low", ["domain", "language"], "source", weights["source"], ", tokens")},
quotas AS (SELECT domain, language, source, tokens, CAST(floor(share + 1e-6) AS BIGINT) AS quota FROM by_source),
taken AS (
  SELECT doc_id, domain, language, source, n,
         (quota // tokens) * n + least(n, greatest(0, quota - (quota // tokens) * tokens - coalesce(sum(n) OVER (
             PARTITION BY domain, language, source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take
  FROM rows_ JOIN quotas USING (domain, language, source))
SELECT doc_id, domain, language, source, n AS n_tokens, CAST(take // n AS BIGINT) AS epochs, CAST(take AS BIGINT) AS take_tokens
FROM taken WHERE take > 0"""


def judge_urls() -> str:
    k, classes = uf.ORDER, ("na", "nr")
    fits = [
        (r, f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))", h + p)
        for r, h, p in sorted(uf.RULES, key=lambda r: -len(r[1] + r[2]))
    ]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{n}'" for _, f, n in fits) + " END"
    ruled = "CASE " + " ".join(f"WHEN {f} THEN '{r}'" for r, f, _ in fits) + " END"
    total = lambda c: f"CAST(sum({c}) AS DOUBLE)"

    def mixed(n: str, low: str) -> str:
        return f"CASE WHEN s{n} + t{n} > 0 THEN ({n} + t{n} * {low}) / (s{n} + t{n}) ELSE {low} END"

    sums = ", ".join(f"{total('w' + c)} AS {c}" for c in classes)
    context = ", ".join(f"{total(c)} AS s{c}, CAST(count(*) FILTER ({c} > 0) AS DOUBLE) AS t{c}" for c in classes)
    steps = f"""
g0 AS (SELECT right(gram, 1) AS g, {sums} FROM grams GROUP BY 1),
c0 AS (SELECT {context} FROM g0),
p0 AS (SELECT gram, {', '.join(f"{mixed(c, repr(1.0 / uf.ALPHABET))} AS p{c}" for c in classes)}
       FROM grams JOIN g0 ON right(gram, 1) = g, c0)"""
    for n in range(1, k + 1):
        gram, ctx = f"substr(gram, {k + 1 - n}, {n + 1})", f"substr(gram, {k + 1 - n}, {n})"
        steps += f""",
g{n} AS (SELECT {gram} AS g, {sums} FROM grams GROUP BY 1),
c{n} AS (SELECT substr(g, 1, {n}) AS ctx, {context} FROM g{n} GROUP BY 1),
p{n} AS (SELECT gram, {', '.join(f"{mixed(c, 'p' + c)} AS p{c}" for c in classes)}
       FROM p{n - 1} JOIN g{n} ON {gram} = g JOIN c{n} ON {ctx} = ctx)"""
    return rf"""
WITH raw AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
hp AS (SELECT page_id, url,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM raw),
parts AS (SELECT page_id, host, path, {rule} AS rule, {ruled} AS ruled,
            regexp_replace(regexp_replace(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[0-9]+', '0', 'g'), '[^a-z0./_%\-]', '~', 'g') AS text,
            CAST('0x' || substr(md5(coalesce(url, '')), 1, 7) AS BIGINT) % {uf.CALIBRATION_FOLDS} = 0 AS held FROM hp),
texts AS (SELECT text, count(*) FILTER (ruled = 'allow' AND NOT held) AS wna, count(*) FILTER (ruled = 'block' AND NOT held) AS wnr,
            count(*) FILTER (ruled = 'allow' AND held) AS ca, count(*) FILTER (ruled = 'block' AND held) AS cr FROM parts GROUP BY text),
spots AS (SELECT text, wna, wnr, substr(repeat('^', {k}) || text || '$', i, {k + 1}) AS gram
          FROM (SELECT *, unnest(range(1, len(text) + 2)) AS i FROM texts)),
grams AS (SELECT gram, sum(wna) AS wna, sum(wnr) AS wnr FROM spots GROUP BY gram),
{steps},
scored AS (SELECT text, any_value(ca) AS ca, any_value(cr) AS cr,
             round(greatest(-{uf.LIMIT}, least({uf.LIMIT}, sum(ln(pna) - ln(pnr)) / count(*))) * {uf.STEPS}) / {uf.STEPS} + 0.0 AS score
           FROM spots JOIN p{k} USING (gram) JOIN texts USING (text) GROUP BY text),
bins AS (SELECT score, sum(ca) AS a, sum(cr) AS r FROM scored GROUP BY score),
rated AS (SELECT score, (score + coalesce(lag(score) OVER (ORDER BY score), score)) / 2 AS mid, round(1 - coalesce(sum(a) OVER up, 0) / nullif(sum(a) OVER (), 0)
                              + coalesce(sum(r) OVER up, 0) / nullif(sum(r) OVER (), 0), 9) AS good
          FROM bins WHERE a + r > 0 WINDOW up AS (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT coalesce((SELECT mid FROM rated WHERE good IS NOT NULL ORDER BY good DESC, score LIMIT 1), 0.0) AS cut)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score >= cut THEN 'allow' ELSE 'block' END) AS verdict, score
FROM parts LEFT JOIN scored USING (text), cut"""


REACH = """reach(node, root) AS (SELECT id, id FROM nodes UNION SELECT l.b, r.root FROM reach r JOIN links l ON r.node = l.a),
roots AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)"""


def near_text(words: int, percent: int) -> str:
    shingle = " || chr(1) || ".join(f"w[i + {k}]" for k in range(words))
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {words} THEN list_transform(range(1, len(w) - {words - 2}), lambda i: {shingle})
                                          WHEN len(w) > 0 THEN [array_to_string(w, chr(1))] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= {percent} * (x.n + y.n - c)),
nodes AS (SELECT doc_id AS id FROM documents),
{REACH}
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN roots ON doc_id = node"""


def near_vectors(threshold: float) -> str:
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
          WHERE list_dot_product(x.v, y.v) / sqrt(list_dot_product(x.v, x.v) * list_dot_product(y.v, y.v)) >= {threshold}),
nodes AS (SELECT vec_id AS id FROM embeddings),
{REACH}
SELECT vec_id, CAST(coalesce(c, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN (SELECT a, count(*) AS c FROM links GROUP BY a) ON vec_id = a JOIN roots ON vec_id = node"""


def manifest() -> str:
    """Merkle trees level by level, and every proof folded step by step."""

    def leaf(n_chars: str) -> str:
        fields = ("doc_id", "source", "lang", n_chars, "text")
        return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END" for c in fields) + ")"

    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)), lambda v, i: xor(v // 2, (v % 2) * 3988292384))), 4294967295)"""

    def grow(name: str) -> str:
        return f"""SELECT tree, lvl + 1, idx // 2, sha256(string_agg(node, '' ORDER BY idx)), (n + 1) // 2
        FROM {name} WHERE n > 1 GROUP BY tree, lvl, idx // 2, n"""

    def climb(path: str, name: str, goal: str) -> str:
        return f"""SELECT p.doc_id, p.tree, p.lvl + 1, p.idx // 2, p.proof || coalesce(s.node, ''),
        sha256(CASE WHEN s.node IS NULL THEN p.acc WHEN p.idx % 2 = 0 THEN p.acc || s.node ELSE s.node || p.acc END)
        FROM {path} p JOIN {goal} g ON g.tree = p.tree AND p.lvl < g.lvl
        LEFT JOIN {name} s ON s.tree = p.tree AND s.lvl = p.lvl AND s.idx = xor(p.idx, 1)"""

    return f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS tree, {leaf("n_chars")} AS leaf,
         CASE WHEN {crc} % 7 = 0 THEN {leaf("(n_chars + 1)")} ELSE {leaf("n_chars")} END AS seen FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
lay AS (SELECT tree, 0 AS lvl, idx, leaf AS node, n FROM placed UNION ALL {grow("lay")}),
subroots AS (SELECT tree, lvl, node FROM lay WHERE n = 1),
crowns AS (SELECT tree AS name, row_number() OVER (ORDER BY tree) - 1 AS idx, node, count(*) OVER () AS n FROM subroots),
crown AS (SELECT 'top' AS tree, 0 AS lvl, idx, node, n FROM crowns UNION ALL {grow("crown")}),
goal AS (SELECT tree, lvl, node FROM crown WHERE n = 1),
path AS (SELECT doc_id, tree, 0 AS lvl, idx, '' AS proof, seen AS acc FROM placed UNION ALL {climb("path", "lay", "subroots")}),
above AS (SELECT p.doc_id, 'top' AS tree, 0 AS lvl, c.idx, p.proof, p.acc FROM path p JOIN subroots g ON g.tree = p.tree AND g.lvl = p.lvl
            JOIN crowns c ON c.name = p.tree UNION ALL {climb("above", "crown", "goal")})
SELECT a.doc_id, l.leaf, s.node AS subroot, g.node AS root, sha256(a.proof) AS proof_sha256, a.acc AS folded_root, a.acc = g.node AS verified
FROM above a JOIN goal g ON g.lvl = a.lvl JOIN leaves l ON l.doc_id = a.doc_id JOIN subroots s ON s.tree = l.tree
"""


def formatted_chat(control_text: str) -> str:
    """Digests of the given turns, and the length of their formatted form: marks, and a sign for every escape."""
    marks = chat_format.MARKS
    controls = "|".join(re.escape(c) for c in chat_format.CONTROLS)
    own = lambda *names: sum(len(marks[n]) for n in names)

    def escaped(c: str) -> str:
        return f"(length(replace({c}, '\\', '\\\\')) + len(regexp_extract_all({c}, '{controls}')))"

    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '{control_text}'), (-1, 1, 'assistant', '{control_text}')) rows(conv_id, turn, role, text)),
sized AS (SELECT *, CASE role WHEN 'user' THEN {own("user", "user_end") + 2} + {escaped("text")} WHEN 'assistant' THEN {own("eos") + 2} + {escaped("text")}
    WHEN 'system' THEN {own("system", "system_end") + 2} + {escaped("text")}
    ELSE {own("other", "other_end", "eos")} + {escaped("text")} + {escaped("role")} END AS size FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST({own("bos")} + sum(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
