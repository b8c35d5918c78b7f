"""The chain of label corrections in SQL, stage by stage, over the rows of ``pair_queries.correction_rows``."""

from __future__ import annotations

from ..functions import vocab
from . import bindings as b
from .bindings import norm

_SUBJECTS = "[" + ", ".join(f"'{w}'" for w in vocab.GUARD_SUBJECTS) + "]"
_GRAMS = "list_distinct(list_transform(range(1, greatest(length({0}) - 1, 2)), lambda i: substring({0}, i::BIGINT, 3)))"
_TEXT = "title || ' ' || category || ' ' || brand || ' ' || attributes"
_SQUEEZED = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


def _part(m: int, n: int) -> str:
    return f"((k // {m}) % {n}) / {n - 1}::DOUBLE"


#: Texts of terms and items once, then the channels by arithmetic on the keys and the guards of each pair.
_ROWS = f"""WITH {b.ITEMS}, {b.TERMS}, {b.CLICKS}, {b.PAIRS},
names AS (SELECT lower(brand) AS brand FROM items GROUP BY 1 HAVING count(*) >= 20 AND NOT contains(lower(brand), ' ') AND length(lower(brand)) >= 4),
title_words AS (SELECT token, count(*) AS df FROM (SELECT item_id, unnest(list_distinct(regexp_split_to_array({norm('title')}, '{vocab.SEPARATORS}'))) AS token FROM items) GROUP BY token),
brands AS (SELECT brand FROM names ANTI JOIN (SELECT token AS brand FROM title_words WHERE df >= 2000) USING (brand)),
words AS (SELECT DISTINCT term_id, brand FROM (SELECT term_id, unnest(regexp_split_to_array({norm('query')}, '{vocab.SEPARATORS}')) AS brand FROM terms) WHERE length(brand) >= 4),
said AS (SELECT term_id, list(brand) AS query_brands FROM words SEMI JOIN brands USING (brand) GROUP BY term_id),
q AS (SELECT term_id, q, {_GRAMS.format('qs')} AS qg, list_distinct(regexp_extract_all(q, '[0-9]+')) AS qn, list_filter({_SUBJECTS}, lambda w: contains(q, w)) AS qsub,
    list_filter(regexp_split_to_array(q, '{vocab.SEPARATORS}'), lambda w: length(w) >= 4) AS qw, coalesce(query_brands, []) AS qb
  FROM (SELECT term_id, {norm('query')} AS q, {_SQUEEZED.format(norm('query'))} AS qs FROM terms) LEFT JOIN said USING (term_id)),
i AS (SELECT item_id, title, t, {_GRAMS.format('ts')} AS tg, list_distinct(regexp_extract_all(t, '[0-9]+')) AS tn, list_filter({_SUBJECTS}, lambda w: contains(t, w)) AS tsub
  FROM (SELECT item_id, {norm('title')} AS title, {_SQUEEZED.format(norm('title'))} AS ts, {norm(_TEXT)} AS t FROM items)),
keyed AS (SELECT *, (term_id * 7919 + item_id * 104729) % 1000003 AS k, (term_id * 104729 + item_id * 7919) % 1000003 AS k2 FROM pairs),
told AS (SELECT term_id, item_id, label = 1 AS y, label = 1 AS anchor, NULL::VARCHAR AS changed_by, title AS title_key,
    {_part(1, 21)} AS cos, {_part(21, 3)} AS recall, {_part(21, 3)} = 1 AS contain, {_part(63, 6)} AS catw, {_part(378, 4)} AS brandw, {_part(1512, 11)} AS top1, {_part(7, 26)} AS tts,
    (k2 % 101) / 100.0::DOUBLE AS p, ((k2 // 101) % 21) / 20.0::DOUBLE AS pdist, k2 % 4 AS twin_density, k2 % 5 AS exp_pos,
    len(list_intersect(qg, tg)) / greatest(len(qg) + len(tg) - len(list_intersect(qg, tg)), 1)::DOUBLE AS alike,
    len(list_filter(qw, lambda w: contains(t, w))) = 0 AS no_word,
    len(list_filter(qn, lambda x: NOT list_contains(tn, x))) = 0 AND (len(qsub) = 0 OR len(tsub) = 0 OR len(list_intersect(qsub, tsub)) > 0)
      AND NOT (contains(q, 'kadın') AND contains(title, 'erkek') AND NOT contains(t, 'kadın')) AND NOT (contains(q, 'erkek') AND contains(title, 'kadın') AND NOT contains(t, 'erkek')) AS fits,
    len(list_filter(qb, lambda x: NOT contains(t, x))) = 0 AS brands_fit
  FROM keyed JOIN q USING (term_id) JOIN i USING (item_id))"""


def _stage(name: str, remove: str = "false", add: str = "false", guard_remove: str = "alike < 0.12", guard_add: str = "fits AND brands_fit", more: str = "") -> tuple[str, str, str]:
    """A stage's columns over the rows before it, and its decisions."""
    return name, more, f"y AND ({remove}) AND ({guard_remove}) AS out_of, NOT y AND ({add}) AND ({guard_add}) AS into_it"


def _best(condition: str, score: str, k: int) -> str:
    """Two steps: the candidates, then their rank in the term."""
    return f"row_number() OVER (PARTITION BY term_id, ({condition}) ORDER BY {score} DESC, item_id) <= {k} AND ({condition})"


_HELD = "sum(y::INT) OVER (PARTITION BY term_id) AS held"
_EARLY = [
    _stage("T1", "cos < 0.45 AND recall = 0 AND catw = 0", "contain AND cos >= 0.80 AND catw >= 0.40"),
    _stage("T2a", "cos < 0.50 AND recall = 0 AND catw <= 0.01 AND brandw <= 0.01", "contain AND cos >= 0.75 AND catw >= 0.30"),
    _stage("T2b", add=_best("held = 0 AND NOT y AND cos >= 0.65 AND (catw >= 0.20 OR contain)", "cos", 2), more=_HELD),
    _stage("T3a", add="tts >= 0.90"),
    _stage("T3b", "mixed AND cos < 0.55", "mixed AND cos >= 0.55", "true", "true", more="count(*) OVER g > 1 AND sum(y::INT) OVER g > 0 AND sum(y::INT) OVER g < count(*) OVER g AS mixed"),
    _stage("T4a", add="tts >= 0.86 AND tts < 0.90 AND catw >= 0.30"),
    _stage("T4b", add="recall = 0 AND cos >= 0.75 AND catw >= 0.30"),
    _stage("T4c", "top1 >= 0.95 AND catw = 0 AND brandw = 0 AND recall < 0.5 AND cos < 0.60", guard_remove="alike < 0.12 AND no_word"),
    _stage("T4d", add="tts >= 0.93 AND cos >= 0.60", guard_add="fits"),
]
_LATE = [
    _stage("T6a", "p <= 0.02 AND anchor"),
    _stage("T6b", add=_best("NOT y AND p >= 0.97 AND catw >= 0.50", "p", 3)),
    _stage("T8", "pdist <= 0.15 AND p <= 0.20", "pdist >= 0.85 AND p >= 0.80", "alike < 0.15"),
    _stage("T9", add=_best("held <= 2 AND twin_density >= 2 AND exp_pos >= ln(16) AND NOT y AND p >= 0.5", "p", 3), more=_HELD),
]


def chain(late: bool) -> str:
    parts, before = [_ROWS], "told"
    for name, more, decided in [*_EARLY, *(_LATE if late else [])]:
        seen = f"(SELECT *, {more} FROM {before} WINDOW g AS (PARTITION BY term_id, title_key))" if more else before
        extra = more.rsplit(" AS ", 1)[1] + ", " if more else ""
        parts.append(f"""after_{name} AS (SELECT * EXCLUDE ({extra}out_of, into_it) REPLACE (CASE WHEN out_of THEN false WHEN into_it THEN true ELSE y END AS y,
    CASE WHEN out_of OR into_it THEN '{name}' ELSE changed_by END AS changed_by) FROM (SELECT *, {decided} FROM {seen}))""")
        before = f"after_{name}"
    return ",\n".join(parts) + f"\nSELECT term_id, item_id, y::INT AS y, changed_by FROM {before}"


SQL = {"correction_chain": chain(False), "correction_chain_full": chain(True)}
