"""DuckDB SQL that gives the rows of the registered queries, built from the same rules and limits."""

from __future__ import annotations

from corpuscle.functions.clean import clean_sql
from corpuscle.functions.stats import chi2_tail_sql
from corpuscle.operators.matrices import CLASSES, class_of
from corpuscle.operators.tagger import DS_CASE, DS_TAGS, POS_CASE, POS_TAGS, TOKEN

_AT = {"w": "w", "n": "nxt", "p": "prv"}
TAGS = {"pos": POS_TAGS, "ds": DS_TAGS}


def tokens_cte(name: str = "tokens", where: str = "true") -> str:
    """CTEs that end in name (doc_id, i, token, pos_tag, ds_tag, pos_id, ds_id) of the documents."""
    return f"""
{name}_corpus AS (SELECT doc_id::VARCHAR AS doc_id, {clean_sql('text')} AS text FROM documents WHERE text IS NOT NULL AND ({where})),
{name}_pieces AS (SELECT doc_id, unnest(p) AS x, unnest(range(len(p))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN}') AS p FROM {name}_corpus)),
{name}_words AS (SELECT *, rtrim(x) AS tok, lower(rtrim(x)) AS w FROM {name}_pieces),
{name}_near AS (SELECT *, lead(w) OVER d AS nxt, lag(w) OVER d AS prv FROM {name}_words WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
{name}_raw AS (SELECT doc_id, i, x, tok, w, prv, {POS_CASE.format(**_AT)} AS pos, {DS_CASE.format(**_AT)} AS ds FROM {name}_near),
{name}_ids AS (
  SELECT *, sum(CASE WHEN regexp_matches(pos, '[0-9][02-9]$') THEN 0 ELSE 1 END) OVER o AS pos_id, sum(CASE WHEN ds LIKE 'B-%' OR ds LIKE 'O-%' THEN 1 ELSE 0 END) OVER o AS ds_id,
    last_value(CASE WHEN NOT regexp_matches(pos, '[0-9][02-9]$') THEN regexp_replace(pos, '[0-9][0-9]$', '') END IGNORE NULLS) OVER d AS base,
    last_value(CASE WHEN ds = 'O-' THEN 'Untagged' WHEN ds LIKE 'B-%' THEN substr(ds, 3) END IGNORE NULLS) OVER d AS label
  FROM {name}_raw WINDOW o AS (ORDER BY doc_id, i), d AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
{name} AS (
  SELECT doc_id, i, x AS token, CASE WHEN regexp_matches(tok, '^[[:punct:]]+$') THEN 'Y' WHEN w = 's' AND prv = 'it' THEN 'GE' ELSE base END AS pos_tag, label AS ds_tag,
    pos_id::BIGINT AS pos_id, ds_id::BIGINT AS ds_id FROM {name}_ids)"""


def counted(layer: str, token: str = "token", tag: str | None = None) -> str:
    tag = tag or f"{layer}_tag"
    return f"{tag} <> 'Y'" if layer == "pos" else f"NOT (regexp_matches({token}, '^[[:punct:] ]+$') AND contains({tag}, 'Untagged'))"


def groups_cte(layer: str, name: str = "g", source: str = "tokens", where: str = "true", by_tag: bool = True) -> str:
    tag = f", {layer}_tag AS tag" if by_tag else ""
    keys = f"doc_id, {layer}_id" + (f", {layer}_tag" if by_tag else "")
    return f"{name} AS (SELECT doc_id, min(i) AS place, string_agg(token, '' ORDER BY i) AS raw, lower(trim(string_agg(token, '' ORDER BY i))) AS token{tag} FROM {source} WHERE {where} GROUP BY {keys})"


def _summary(counts: str, keys: list[str], per: str) -> str:
    k = ", ".join(f'"{x}"' for x in keys)
    return f"""SELECT {k}, sum(n)::BIGINT AS "AF", round(sum(n)::DOUBLE / (SELECT sum(n) FROM {counts}) * {per}, 6) AS "RF",
  round(count(*)::DOUBLE / (SELECT count(DISTINCT doc_id) FROM {counts}) * 100.0::DOUBLE, 6) AS "Range" FROM {counts} GROUP BY {k}"""


def frequency_ctes(layer: str, name: str = "freq", source: str = "tokens") -> str:
    before = counted(layer) if layer == "ds" else "pos_tag <> 'Y'"
    return f"""{groups_cte(layer, f'{name}_g', source, before)},
{name}_counts AS (SELECT doc_id, token AS "Token", tag AS "Tag", count(*) AS n FROM {name}_g GROUP BY ALL),
{name} AS ({_summary(f'{name}_counts', ['Token', 'Tag'], '1000000.0::DOUBLE')})"""


def frequency(layer: str) -> str:
    return f"WITH {tokens_cte()}, {frequency_ctes(layer)} SELECT * FROM freq"


def tags_ctes(layer: str, name: str = "tt", source: str = "tokens") -> str:
    return f"""{name}_counts AS (SELECT doc_id, {layer}_tag AS "Tag", count(DISTINCT {layer}_id) AS n FROM {source} WHERE {counted(layer)} GROUP BY ALL),
{name} AS ({_summary(f'{name}_counts', ['Tag'], '100.0::DOUBLE')})"""


def tags(layer: str) -> str:
    return f"WITH {tokens_cte()}, {tags_ctes(layer)} SELECT * FROM tt"


def dtm_ctes(layer: str) -> str:
    cells = ", ".join(f"""coalesce(sum(n) FILTER (WHERE "Tag" = '{t}'), 0)::BIGINT AS "{t}" """ for t in TAGS[layer])
    return f"{tokens_cte()}, {tags_ctes(layer)}, dtm AS (SELECT doc_id, {cells} FROM tt_counts GROUP BY doc_id)"


def dtm(layer: str) -> str:
    return f"WITH {dtm_ctes(layer)} SELECT * FROM dtm"


def weighted(scheme: str) -> str:
    names = TAGS["pos"]
    total = " + ".join(f'"{t}"' for t in names)
    prop = f"""prop AS (SELECT doc_id, {', '.join(f'"{t}"::DOUBLE / ({total}) AS "{t}"' for t in names)} FROM dtm)"""
    if scheme == "prop":
        out = ", ".join(f'round("{t}", 6) AS "{t}"' for t in names)
        return f"WITH {dtm_ctes('pos')}, {prop} SELECT doc_id, {out} FROM prop"
    if scheme == "scale":
        out = ", ".join(f'round(("{t}" - avg("{t}") OVER ()) / nullif(stddev_samp("{t}") OVER (), 0), 6) AS "{t}"' for t in names)
        return f"WITH {dtm_ctes('pos')}, {prop} SELECT doc_id, {out} FROM prop"
    out = ", ".join(f'round("{t}" * (ln(1 + count(*) OVER () + count(*) FILTER ("{t}" > 0) OVER ()) - ln(1 + count(*) FILTER ("{t}" > 0) OVER ())), 6) AS "{t}"' for t in names)
    return f"WITH {dtm_ctes('pos')}, {prop} SELECT doc_id, {out} FROM prop"


def _classes() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for t in POS_TAGS:
        out.setdefault(class_of(t), []).append(t)
    return out


def simplified() -> str:
    cells = ", ".join("({})::BIGINT AS \"{}\"".format(" + ".join(f'"{t}"' for t in own), c) for c, own in _classes().items())
    return f"WITH {dtm_ctes('pos')} SELECT doc_id, {cells} FROM dtm"


def _class_sql(tag: str) -> str:
    return "CASE " + " ".join(f"WHEN {tag} LIKE '{p}%' THEN '{c[1:]}'" for p, c in CLASSES) + " ELSE 'Other' END"


def freq_simplified() -> str:
    return f"""WITH {tokens_cte()}, {frequency_ctes('pos')} SELECT "Token", {_class_sql('"Tag"')} AS "Tag", "AF", "RF", "Range" FROM freq"""


def tags_simplified() -> str:
    classes = ", ".join(f"('{c}')" for c in _classes())
    return f"""WITH {tokens_cte()}, {tags_ctes('pos')},
cells AS (SELECT doc_id, {_class_sql('"Tag"')} AS c, sum(n) AS n FROM tt_counts GROUP BY ALL), docs AS (SELECT count(DISTINCT doc_id) AS d FROM tt_counts)
SELECT c AS "Tag", coalesce(sum(n), 0)::BIGINT AS "AF", round(coalesce(sum(n), 0) * 100.0::DOUBLE / (SELECT sum(n) FROM cells), 6) AS "RF", round(count(n)::DOUBLE / any_value(d) * 100.0::DOUBLE, 6) AS "Range"
FROM (VALUES {classes}) v(c) LEFT JOIN cells USING (c) CROSS JOIN docs GROUP BY c"""


def coo() -> str:
    columns = ", ".join(f"('{t}', {k})" for k, t in enumerate(POS_TAGS))
    return f"""WITH {tokens_cte()}, {tags_ctes('pos')}, ranks AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS "row" FROM (SELECT DISTINCT doc_id FROM tt_counts))
SELECT "row", c.k::BIGINT AS col, n::DOUBLE AS value FROM tt_counts JOIN ranks USING (doc_id) JOIN (VALUES {columns}) c(t, k) ON t = "Tag" """


def dispersions(layer: str) -> str:
    where = "pos_tag <> 'Y'" if layer == "pos" else "true"
    return f"""WITH {tokens_cte()},
firsts AS (SELECT doc_id, lower(trim(min_by(token, i))) AS "Token", {layer}_tag AS "Tag" FROM tokens WHERE {where} GROUP BY doc_id, {layer}_id, {layer}_tag),
counts AS (SELECT doc_id, "Token", "Tag", count(*)::DOUBLE AS v FROM firsts GROUP BY ALL),
sizes AS (SELECT doc_id, sum(v) AS size FROM counts GROUP BY doc_id),
t AS (SELECT sum(size) AS total, count(*)::DOUBLE AS n, min(size) AS least FROM sizes),
cells AS (SELECT c.*, size / total AS s FROM counts c JOIN sizes USING (doc_id) CROSS JOIN t),
f AS (SELECT "Token", "Tag", sum(v) AS f, sum(v / s) AS r, count(*) AS k FROM cells GROUP BY ALL),
m AS (SELECT "Token", "Tag", f, k, n, total, least, r / n AS rm, f / n AS vm FROM f CROSS JOIN t),
d AS (
  SELECT "Token", "Tag", any_value(f) AS f, any_value(n) AS n, any_value(total) AS total, any_value(least) AS least, any_value(rm) AS rm, any_value(vm) AS vm, any_value(k) AS k,
    sum(v * log2(v)) AS vlog, sum(sqrt(v * s)) AS root, sum(sqrt(v)) AS roots, sum(v * v) AS vsq, sum((v / s - rm) * (v / s - rm)) AS rr, sum(abs(v / f - s)) AS dev, sum(s) AS ss
  FROM cells JOIN m USING ("Token", "Tag") GROUP BY ALL)
SELECT "Token", "Tag", f::BIGINT AS "AF", round(f / total * 1000000.0::DOUBLE, 6) AS "RF", round((log2(f) - vlog / f) / log2(n), 6) + 0.0::DOUBLE AS "Carrolls_D2", round(root * root / f, 6) AS "Rosengrens_S",
  round(1 - (n * vsq - f * f) / (4 * f * f), 6) + 0.0::DOUBLE AS "Lynes_D3", round((roots / n) * (roots / n) / vm, 6) AS "DC",
  round(1 - sqrt((rr + (n - k) * rm * rm) / n) / rm / sqrt(n - 1), 6) + 0.0::DOUBLE AS "Juillands_D", round(0.5 * (dev + 1 - ss), 6) + 0.0::DOUBLE AS "DP", round(0.5 * (dev + 1 - ss) / (1 - least / total), 6) AS "DP_norm" FROM d"""


def _run(span: int, before: int, layer: str) -> str:
    """CTEs g and run: units that count, with those from before positions earlier to span - before - 1 later."""
    shift = lambda c, k: c if k == before else f"lag({c}, {before - k}) OVER o" if k < before else f"lead({c}, {k - before}) OVER o"
    columns = ", ".join(f'{shift("token", k)} AS "Token_{k + 1}", {shift("tag", k)} AS "Tag_{k + 1}"' for k in range(span))
    return f"""{groups_cte(layer, 'all_g')}, g AS (SELECT * FROM all_g WHERE {counted(layer, 'raw', 'tag')}),
run AS (SELECT doc_id, token, tag, {columns} FROM g WINDOW o AS (ORDER BY doc_id, place))"""


def _sequence(span: int, hits: str) -> str:
    keys = ", ".join(f'"{x}_{k + 1}"' for x in ("Token", "Tag") for k in range(span))
    return f"""hits AS (SELECT * FROM run WHERE {hits})
SELECT {keys}, count(*) AS "AF", round(count(*)::DOUBLE / (SELECT count(*) FROM g) * 1000000.0::DOUBLE, 6) AS "RF",
  round(count(DISTINCT doc_id)::DOUBLE / (SELECT count(DISTINCT doc_id) FROM hits) * 100.0::DOUBLE, 6) AS "Range" FROM hits GROUP BY {keys}"""


def ngrams(span: int, layer: str, least: float = 10) -> str:
    return f"""WITH {tokens_cte()}, {_run(span, 0, layer)}, {_sequence(span, f'"Token_{span}" IS NOT NULL')} HAVING count(*)::DOUBLE / (SELECT count(*) FROM g) * 1000000.0::DOUBLE >= {least}"""


def clusters(hit: str, position: int, span: int, layer: str) -> str:
    return f"WITH {tokens_cte()}, {_run(span, position - 1, layer)}, {_sequence(span, hit)}"


def kwic(hit: str) -> str:
    pre = ", ".join(f"coalesce(lag(raw, {k}) OVER o, '')" for k in range(7, 0, -1))
    post = ", ".join(f"coalesce(lead(raw, {k}) OVER o, '')" for k in range(1, 8))
    return f"""WITH {tokens_cte()}, {groups_cte('pos', 'g', by_tag=False)},
run AS (SELECT doc_id, raw, token, concat({pre}) AS pre, concat({post}) AS post FROM g WINDOW o AS (ORDER BY doc_id, place))
SELECT doc_id AS "Doc ID", pre AS "Pre-Node", raw AS "Node", post AS "Post-Node" FROM run WHERE {hit}"""


def collocations(node: str, statistic: str, layer: str, tag: str | None = None, before: int = 4, after: int = 4, retagged: bool = False) -> str:
    t = f" AND starts_with(tag, '{tag}')" if tag else ""
    near = ", ".join(f"{{'t': {f}(token, {k}) OVER o, 'g': {f}(tag, {k}) OVER o}}" for f, n in (("lag", before), ("lead", after)) for k in range(1, n + 1))
    o, w = '"Freq Span"::DOUBLE / total', '("Freq Total"::DOUBLE / total) * (node::DOUBLE / total)'
    pmi = f"(log2({o}) - log2({w}))"
    mi = {"pmi": pmi, "npmi": f"{pmi} / -log2({o})", "pmi2": f"{pmi} + log2({o})", "pmi3": f"{pmi} + 2 * log2({o})"}[statistic]
    other = "CASE WHEN lower(rtrim(token)) = 'that' AND i % 2 = 0 AND pos_tag = 'CST' THEN 'DD1' ELSE pos_tag END" if retagged else "pos_tag"
    return f"""WITH {tokens_cte()}, retagged AS (SELECT * REPLACE ({other} AS pos_tag) FROM tokens), {groups_cte(layer, source='retagged')},
totals AS (SELECT token AS "Token", tag AS "Tag", count(*) AS "Freq Total" FROM g WHERE {counted(layer, 'token', 'tag')} GROUP BY ALL),
sums AS (SELECT sum("Freq Total") AS total, (SELECT count(*) FROM g WHERE token = '{node}'{t} AND {counted(layer, 'token', 'tag')}) AS node FROM totals),
near AS (SELECT token, tag, [{near}] AS x FROM g WHERE regexp_matches(token, '[a-z]') WINDOW o AS (ORDER BY doc_id, place)),
flat AS (SELECT unnest(x) AS x FROM near WHERE token = '{node}'{t}),
span AS (SELECT x.t AS "Token", x.g AS "Tag", count(*) AS "Freq Span" FROM flat GROUP BY ALL)
SELECT "Token", "Tag", "Freq Span", "Freq Total", round({mi}, 6) AS "MI" FROM span JOIN totals USING ("Token", "Tag") CROSS JOIN sums WHERE node > 0"""


def keyness(correct: bool = False, tags_only: bool = False, swap: bool = False, threshold: float = 0.01, target: str = "lang = 'en'") -> str:
    make = tags_ctes if tags_only else frequency_ctes
    keys = '"Tag"' if tags_only else '"Token", "Tag"'
    move = "CASE WHEN abs(d) > 0.25 THEN 0.5 * sign(d) ELSE 0 END" if correct else "0"
    flip = "-" if swap else ""
    return f"""WITH {tokens_cte('tar', target)}, {tokens_cte('ref', f'NOT coalesce({target}, false)')}, {make('pos', 'a_', 'tar')}, {make('pos', 'b_', 'ref')},
sums AS (SELECT (SELECT sum("AF") FROM a_)::DOUBLE AS t, (SELECT sum("AF") FROM b_)::DOUBLE AS r),
j AS (SELECT {keys}, coalesce(x."AF", 0) AS "AF", coalesce(y."AF", 0) AS "AF_Ref", coalesce(x."RF", 0) AS "RF", coalesce(y."RF", 0) AS "RF_Ref", coalesce(x."Range", 0) AS "Range", coalesce(y."Range", 0) AS "Range_Ref"
  FROM a_ x FULL JOIN b_ y USING ({keys})),
e AS (SELECT *, "AF"::DOUBLE AS a, "AF_Ref"::DOUBLE AS b, a - (a + b) * (t / (t + r)) AS d FROM j CROSS JOIN sums),
c AS (SELECT *, a - {move} AS ya, b + {move} AS yb FROM e),
l AS (SELECT *, abs(2 * (CASE WHEN ya > 0 THEN ya * ln(ya / ((ya + b) * (t / (t + r)))) ELSE 0 END + CASE WHEN yb > 0 THEN yb * ln(yb / ((ya + yb) * (r / (t + r)))) ELSE 0 END)) AS ll FROM c),
z AS (SELECT *, sqrt(ll / 2.0e0) AS z, CASE WHEN "RF" > "RF_Ref" THEN ll ELSE -ll END AS signed,
  CASE WHEN b = 0 THEN log2((a / t) / (0.5e0 / r)) WHEN a = 0 THEN -log2((b / r) / (0.5e0 / t)) ELSE log2((a / t) / (b / r)) END AS lr FROM l),
p AS (SELECT *, {chi2_tail_sql('z')} AS pv FROM z)
SELECT {keys}, round({flip}signed, 6) AS "LL", round({flip}lr, 6) AS "LR", round(pv, 9) AS "PV", "RF", "RF_Ref", "AF", "AF_Ref", "Range", "Range_Ref" FROM p WHERE pv < {threshold} AND {flip}signed > 0"""


def cleaned() -> str:
    return f"SELECT doc_id::VARCHAR AS doc_id, {clean_sql('text')} AS text FROM documents"


def tokens() -> str:
    return f"WITH {tokens_cte()} SELECT doc_id, token, pos_tag, ds_tag, pos_id, ds_id FROM tokens"


def ruler(index: int, layer: str) -> str:
    return f"""WITH {tokens_cte()}, d AS (SELECT DISTINCT doc_id FROM tokens ORDER BY doc_id LIMIT 1 OFFSET {index})
SELECT token, {layer}_tag AS tag, {layer}_id AS tag_id FROM tokens JOIN d USING (doc_id)"""


def chunks() -> str:
    return f"SELECT doc_id::VARCHAR AS doc_id, 0 AS chunk_id, trim(x) || ' ' AS text FROM (SELECT doc_id, {clean_sql('text')} AS x FROM documents) WHERE length(x) > 0"


def observed() -> str:
    return f"""WITH {tokens_cte()}, {tags_ctes('pos')} SELECT doc_id, "Tag" AS tag, n::BIGINT AS n FROM tt_counts"""


def coo_docs() -> str:
    return f"""WITH {tokens_cte()}, {tags_ctes('pos')} SELECT (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS "row", doc_id FROM (SELECT DISTINCT doc_id FROM tt_counts)"""


def coo_vocabulary() -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({k}::BIGINT, '{t}')" for k, t in enumerate(POS_TAGS)) + ") v(col, tag)"
