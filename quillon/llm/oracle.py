"""SQL of those queries that SQL can express. Encoding, packing, shards, languages and pseudonyms are held
against brute force in the tests instead."""

from __future__ import annotations


def _rule_values(rules: list[tuple[str, str]]) -> str:
    rows = ", ".join(f"('{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}', '{v}')" for r, v in rules)
    return f"(VALUES {rows}) AS r(rule_host, rule_path, rule, verdict)"


def url_sql(rules: list[tuple[str, str]], otherwise: str) -> str:
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw FROM cut),
split AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substring(coalesce(rest, ''), length(raw) + 1), '^[^?#]*') AS path FROM hosts),
fits AS (SELECT page_id, host, path, rule, verdict, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule) DESC NULLS LAST) AS pos
  FROM split LEFT JOIN {_rule_values(rules)} ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, '{otherwise}') AS verdict FROM fits WHERE pos = 1"""


_REACH = """
reach AS (SELECT id, id AS seen FROM nodes UNION SELECT reach.id, e.b FROM reach JOIN edges e ON e.a = reach.seen),
comp AS (SELECT id, min(seen) AS component_id FROM reach GROUP BY id)"""


def vector_sql(cosine: float) -> str:
    return f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
nodes AS (SELECT id FROM v),
edges AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.id <> y.id WHERE x.n > 0 AND y.n > 0 AND list_inner_product(x.e, y.e) / (x.n * y.n) >= {cosine}),
{_REACH.strip()},
deg AS (SELECT a AS id, count(*) AS n_links FROM edges GROUP BY a)
SELECT id AS vec_id, coalesce(n_links, 0) AS n_links, component_id, id = component_id AS kept FROM comp LEFT JOIN deg USING (id)"""


def near_sql(percent: int, width: int) -> str:
    joined = " || ' ' || ".join(f"w[i + {k}]" for k in range(width))
    return f"""
WITH RECURSIVE t AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT id, s FROM (SELECT id, {joined} AS s FROM (SELECT id, w, unnest(range(1, len(w) - {width - 2})) AS i FROM t WHERE len(w) >= {width}) UNION ALL SELECT id, array_to_string(w, ' ') FROM t WHERE len(w) BETWEEN 1 AND {width - 1})),
sizes AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
shared AS (SELECT x.id AS a, y.id AS b, count(*) AS m FROM sh x JOIN sh y ON x.s = y.s AND x.id <> y.id GROUP BY ALL),
edges AS (SELECT a, b FROM shared JOIN sizes p ON p.id = a JOIN sizes q ON q.id = b WHERE 100 * m >= {percent} * (p.n + q.n - m)),
nodes AS (SELECT id FROM t),
{_REACH.strip()}
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, id = component_id AS kept FROM comp LEFT JOIN sizes USING (id)"""


def top_sql(every: int, k: int, scale: int) -> str:
    return f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding::DOUBLE[], lambda x: floor({scale} * x)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score,
  row_number() OVER (PARTITION BY q.r ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id) AS rank
  FROM v q JOIN v c ON q.vec_id % {every} = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)) WHERE rank <= {k}"""
