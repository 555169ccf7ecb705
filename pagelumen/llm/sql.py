"""DuckDB SQL for the queries that SQL expresses at full size."""

from __future__ import annotations

from pagelumen.llm import licenses
from pagelumen.llm.url_filters import RULES

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM docs, lengths WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM grams JOIN windows USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hits GROUP BY doc_id)
SELECT docs.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""


def _host(u: str) -> str:
    return "coalesce(" + _LOWER.format(f"regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1)") + ", '')"


def _path(u: str) -> str:
    return f"coalesce(regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"


def _scheme(u: str) -> str:
    return _LOWER.format(f"regexp_extract({u}, '(?s)^(.*?)://', 1)")


def _node(u: str) -> str:
    return f"CASE WHEN contains({u}, '://') THEN {_scheme(u)} || '://' || {_host(u)} || (CASE WHEN {_path(u)} = '' THEN '/' ELSE {_path(u)} END) || regexp_extract({u}, '(?s)^[^?#]*(\\?[^#]*)', 1) END"


def _rule(host: str, path: str) -> tuple[str, str]:
    """The longest rule that fits and its verdict."""
    rows = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    fits = [f"({host} = '{h}' OR suffix({host}, '.{h}')) AND starts_with({path}, '{p}')" for _, h, p in rows]
    name = "CASE " + " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, rows, strict=True)) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{k}'" for f, (k, _, _) in zip(fits, rows, strict=True)) + " END"
    return name, verdict


def _url_filter() -> str:
    name, verdict = _rule("host", "path")
    _, of_node = _rule(_host("node"), _path("node"))
    value = "[\"'']?([^\"''\\s>]+)"
    folder = f"regexp_extract({_path('url')}, '(?s)^(.*/)', 1)"
    origin = f"regexp_extract(url, '(?s)^(.*?)://', 1) || '://' || {_host('url')}"
    return f"""WITH RECURSIVE named AS (
  SELECT url, replace(unnest(
    list_transform(list_filter(regexp_extract_all(coalesce(html, ''), '(?is)<link\\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\\brel\\s*=\\s*["'']?\\s*canonical\\b')), lambda t: regexp_extract(t, '(?is)\\bhref\\s*=\\s*{value}', 1))[1:1]
    || list_transform(list_filter(regexp_extract_all(coalesce(html, ''), '(?is)<meta\\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\\bhttp-equiv\\s*=\\s*["'']?refresh\\b')), lambda t: regexp_extract(t, '(?is)\\bcontent\\s*=\\s*["'']?\\s*[\\d.]+\\s*[;,]\\s*url\\s*=\\s*''?([^"''\\s>]+)', 1))[1:1]), '&amp;', '&') AS target FROM pages),
aimed AS (SELECT {_node('url')} AS a, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target WHEN target LIKE '//%' THEN regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || target
  WHEN target LIKE '/%' THEN {origin} || target WHEN target LIKE '#%' OR regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
  ELSE {origin} || (CASE WHEN {folder} = '' THEN '/' ELSE {folder} END) || target END AS target FROM named WHERE target <> ''),
edges AS (SELECT DISTINCT a, b FROM (SELECT a, {_node('target')} AS b FROM aimed) WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a AS node, a AS member FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.member),
ruled AS (SELECT node AS member, {of_node} AS own FROM (SELECT DISTINCT member AS node FROM reach)),
classes AS (SELECT node, bool_or(own = 'block') AND NOT coalesce(bool_or(own = 'allow'), false) AS blocked FROM reach JOIN ruled USING (member) GROUP BY node),
parts AS (SELECT page_id, {_host('url')} AS host, {_path('url')} AS path, {_node('url')} AS node FROM pages),
judged AS (SELECT page_id, host, path, node, {name} AS rule, {verdict} AS own FROM parts)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN blocked THEN 'block' END, 'allow') AS verdict,
  CASE WHEN own IS NOT NULL THEN 'rule' WHEN blocked THEN 'alias' ELSE 'default' END AS via
FROM judged LEFT JOIN classes USING (node)"""


def _vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Rounds written out; products of integers are exact as doubles."""
    steps = [f"""kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS (SELECT vec_id, label, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS x FROM kept, generate_series(0, {parts - 1}) AS g(p)),
book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM cut QUALIFY e < {entries})"""]
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS (SELECT vec_id, label, p, x, min(struct_pack(d := list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c), e := e)) AS n
  FROM cut JOIN book{r} USING (p) GROUP BY vec_id, label, p, x)""")
        if r < rounds:
            steps.append(f"""mean{r} AS (SELECT p, e, list(floor(total / n) ORDER BY i) AS c FROM (SELECT p, n.e AS e, i, sum(x[i]) AS total, count(*) AS n FROM near{r}, LATERAL (SELECT unnest(generate_series(1, len(x))) AS i) GROUP BY ALL) GROUP BY p, e),
book{r + 1} AS (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m USING (p, e))""")
    return "WITH " + ",\n".join(steps) + f""",
coded AS (SELECT vec_id, label, string_agg(printf('%02x', n.e), '' ORDER BY p) AS code, sum(n.d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT::VARCHAR), ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256 FROM coded"""


HARD_NEGATIVES = """WITH kept AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM kept a JOIN kept b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS positive_rank FROM pairs WHERE same QUALIFY positive_rank <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS rank, other_id AS negative_id, positive_score, score AS negative_score, positive_rank
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score QUALIFY rank <= 3"""

LINE_DEDUP = """WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, """ + _LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))") + """ AS k FROM lines),
judged AS (SELECT *, length(k) >= 10 AND doc_id <> min(doc_id) OVER (PARTITION BY k) AS gone FROM keyed)
SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM judged GROUP BY doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": licenses.scan_sql(), "op6_url_filter": _url_filter(), "op9_decontaminate": DECONTAMINATE, "op11_vector_codes": _vector_codes(), "op12_hard_negatives": HARD_NEGATIVES, "op13_line_dedup": LINE_DEDUP}
