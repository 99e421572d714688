"""The linkage queries as SQL for DuckDB over the driver's tables."""

from __future__ import annotations

from ..functions import dictionaries as D
from .fixture import REC_SQL, S1_SQL
from .queries import DF_CAP, TAUS


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


S1 = "s1 AS (" + S1_SQL.format(customer="customer", nation="nation", region="region", part="part") + ")"
REC = "rec AS (" + REC_SQL.format(orders="orders", s1="s1") + ")"
BASE = f"WITH {S1}, {REC}, truth AS (SELECT true_s1 AS s_id, entity_id AS q_id FROM rec WHERE true_s1 IS NOT NULL)"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')"


def _normal(name: str, source: str) -> str:
    """CTEs from a record table to ``{name}_norm``: entity_id, country, name, core, alias, addr."""
    repaired = f"CASE WHEN NOT regexp_full_match(t, '[a-z]+|[0-9]+') AND length(regexp_replace(t, '[^a-z]', '', 'g')) >= 2 THEN translate(t, '{D.OCR_DIGITS}', '{D.OCR_LETTERS}') ELSE t END"
    kept = f"list_filter(p, lambda t: NOT list_contains({_list(D.LEGAL)}, t))"
    return f"""
    {name}_a AS (SELECT *, replace(replace(regexp_replace(lower(business_name), '{D.DOMAIN}', ' \\1 ', 'g'), '&', ' and '), '+', ' ') AS x FROM {source}),
    {name}_b AS (SELECT *, regexp_replace(regexp_replace(x, '\\b([a-z])\\.([a-z])\\.([a-z])\\.', '\\1\\2\\3.', 'g'), '[^a-z0-9/ ]', ' ', 'g') AS y FROM {name}_a),
    {name}_c AS (SELECT *, string_split(replace(regexp_replace(y, '{D.ALIAS}', ' | ', 'g'), '/', ' '), '|') AS z FROM {name}_b),
    {name}_d AS (SELECT *, list_filter(list_transform(z, lambda p: list_transform(list_transform({_words('p')}, lambda t: {repaired}), lambda t: coalesce(({_map(D.NAME_ABBREVIATIONS)})[t], t))), lambda p: len(p) > 0) AS parts FROM {name}_c),
    {name}_e AS (SELECT *, list_transform(parts, lambda p: CASE WHEN len({kept}) > 0 THEN {kept} ELSE p END) AS cores FROM {name}_d),
    {name}_f AS (SELECT *, list_filter(list_transform(string_split(replace(lower(business_address), '##', ' '), ','), lambda c:
        array_to_string(list_transform(list_filter({_words("regexp_replace(c, '[^a-z0-9 ]', ' ', 'g')")}, lambda w: NOT list_contains({_list(D.ADDRESS_DROPPED)}, w)), lambda t: coalesce(({_map(D.ADDRESS_ABBREVIATIONS)})[t], t)), ' ')), lambda c: c <> '') AS comps FROM {name}_e),
    {name}_g AS (SELECT *, regexp_replace(regexp_replace(array_to_string(comps, ' '), '([0-9])([a-z])', '\\1 \\2', 'g'), '([a-z])([0-9])', '\\1 \\2', 'g') AS a FROM {name}_f),
    {name}_norm AS (SELECT * EXCLUDE (x, y, z, comps, a), array_to_string(flatten(parts), ' ') AS name,
        CASE WHEN len(cores) = 0 THEN '' ELSE array_to_string(list_reduce(cores, lambda best, c: CASE WHEN len(c) > len(best) THEN c ELSE best END), ' ') END AS core,
        array_to_string(list_transform(cores, lambda c: array_to_string(c, ' ')), ' | ') AS alias,
        array_to_string(list_transform({_words('a')}, lambda t: regexp_replace(t, '^0+([0-9])', '\\1')), ' ') AS addr FROM {name}_g)"""


def _tokens(name: str) -> str:
    """CTEs from ``{name}_norm`` to ``{name}_tok``: entity_id, country, field, tok; and ``{name}_sets`` with the lists."""
    digit = "regexp_full_match(t, '[0-9]+')"
    return f"""
    {name}_w AS (SELECT *, {_words('core')} AS cw, {_words('addr')} AS aw FROM {name}_norm),
    {name}_sets AS (SELECT *,
        list_sort(list_distinct(list_concat(list_concat(
            list_transform(list_filter(cw, lambda t: length(t) >= 2), lambda t: country || '|n|' || t),
            list_transform(generate_series(1, len(cw) - 1), lambda i: country || '|nb|' || cw[i] || '_' || cw[i + 1])), list_concat(
            CASE WHEN length(array_to_string(cw, '')) >= 6 THEN [country || '|nc|' || array_to_string(cw, '')] ELSE [] END,
            list_transform(list_filter(flatten(list_transform(string_split(alias, ' | ')[1:3], lambda p: {_words('p')})), lambda t: length(t) >= 2), lambda t: country || '|n|' || t))))) AS t_name,
        list_sort(list_distinct(list_concat(
            list_transform(list_filter(aw, lambda t: length(t) >= 3 AND NOT {digit}), lambda t: country || '|a|' || t),
            list_transform(list_filter(generate_series(1, len(aw) - 1), lambda i: regexp_full_match(aw[i], '[0-9]+') AND NOT regexp_full_match(aw[i + 1], '[0-9]+')), lambda i: country || '|ab|' || aw[i] || '_' || aw[i + 1])))) AS t_addr,
        list_sort(list_distinct(list_transform(list_filter(aw, lambda t: {digit}), lambda t: country || '|#|' || t))) AS t_num FROM {name}_w),
    {name}_tok AS (SELECT entity_id, country, 'name' AS field, unnest(t_name) AS tok FROM {name}_sets UNION ALL SELECT entity_id, country, 'addr', unnest(t_addr) FROM {name}_sets UNION ALL SELECT entity_id, country, 'num', unnest(t_num) FROM {name}_sets)"""


NORM = f"{BASE}, {_normal('s', 's1')}, {_normal('q', 'rec')}"
TOK = f"{NORM}, {_tokens('s')}, {_tokens('q')}, freq AS (SELECT field, tok, count(*) AS df FROM s_tok GROUP BY ALL), total AS (SELECT count(*) AS n FROM s1)"


def _weights(name: str, cap: bool) -> str:
    out = f"{name}_cap" if cap else f"{name}_all"
    where = f"WHERE df <= {DF_CAP}" if cap else ""
    return f"""
    {out}_raw AS (SELECT t.*, ln((n + 1) / (df + 1)) + 1 AS w0 FROM {name}_tok t JOIN freq USING (field, tok), total {where}),
    {out} AS (SELECT entity_id, country, field, tok, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY entity_id, field)) AS w FROM {out}_raw)"""


def _block(name: str) -> str:
    return f"""
    {name}_sum AS (SELECT entity_id, country, tok, sum(w * CASE field WHEN 'name' THEN 0.6::DOUBLE WHEN 'addr' THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END) AS w0 FROM {name}_cap GROUP BY ALL),
    {name}_block AS (SELECT entity_id, country, tok, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY entity_id)) AS w FROM {name}_sum)"""


CUT = """top AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY cos DESC, s_id) AS r FROM pairs WHERE cos >= 0.08 QUALIFY r <= 8),
    cand AS (SELECT q_id, s_id, cos FROM (SELECT *, max(cos) OVER (PARTITION BY q_id) AS best FROM top) WHERE cos >= 0.25 * best)"""
VECTORS = f"{TOK}, {_weights('s', True)}, {_weights('q', True)}, {_block('s')}, {_block('q')}"
PAIRS = f"{VECTORS}, pairs AS (SELECT q.entity_id AS q_id, s.entity_id AS s_id, round(sum(q.w * s.w), 6) AS cos FROM q_block q JOIN s_block s USING (country, tok) GROUP BY ALL)"
CAND = f"{PAIRS}, {CUT}"
BEST = f"{CAND}, best AS (SELECT q_id, s_id, cos AS p FROM cand QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY cos DESC, s_id) = 1), matches AS (SELECT * FROM best WHERE p >= 0.5)"


def _f(predicted: str) -> str:
    """CTEs from (s_id, q_id) rows to ``fb``: s_id, country, tp, n_pred, n_true, f."""
    return f"""
    n_p AS (SELECT s_id, count(*) AS n_pred FROM {predicted} GROUP BY ALL), n_t AS (SELECT s_id, count(*) AS n_true FROM truth GROUP BY ALL),
    n_h AS (SELECT s_id, count(*) AS tp FROM {predicted} JOIN truth USING (s_id, q_id) GROUP BY ALL),
    fb0 AS (SELECT entity_id AS s_id, country, coalesce(tp, 0) AS tp, coalesce(n_pred, 0) AS n_pred, coalesce(n_true, 0) AS n_true
        FROM s1 LEFT JOIN n_p ON n_p.s_id = entity_id LEFT JOIN n_t ON n_t.s_id = entity_id LEFT JOIN n_h ON n_h.s_id = entity_id),
    fb AS (SELECT *, CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0::DOUBLE WHEN tp = 0 THEN 0.0::DOUBLE
        ELSE 1.25::DOUBLE * (tp / n_pred) * (tp / n_true) / (0.25::DOUBLE * (tp / n_pred) + tp / n_true) END AS f FROM fb0)"""


OWNED = f"{NORM}, pq AS (SELECT DISTINCT q.core AS q_core, q.addr AS q_addr, s.core AS s_core, s.addr AS s_addr FROM q_norm q JOIN s_norm s ON q.true_s1 = s.entity_id)"


def _sorted_words(text: str) -> str:
    return f"array_to_string(list_sort(string_split({text}, ' ')), ' ')"


def _lcs(a: str, b: str) -> str:
    """The usual table row by row: previous row -> next row, folded over a's characters."""
    chars = lambda t: f"CASE WHEN {t} = '' THEN []::VARCHAR[] ELSE string_split({t}, '') END"
    row = f"list_reduce(list_prepend([0], list_transform(range(1, length({b}) + 1), lambda j: [CASE WHEN ({b})[j] = c THEN prev[j] + 1 ELSE prev[j + 1] END])), lambda done, cell: list_append(done, greatest(cell[1], done[len(done)])))"
    return f"list_reduce(list_prepend(list_transform(range(0, length({b}) + 1), lambda i: 0), list_transform({chars(a)}, lambda c: [ascii(c)])), lambda prev, code: {row.replace('= c ', '= chr(code[1]) ')})[length({b}) + 1]"


def _ratio(pairs: str) -> str:
    """CTEs from ``pairs`` (x, y) to ``lr``: x, y, r = 100 * 2 * LCS / (length x + length y)."""
    return f"lr AS (SELECT x, y, CASE WHEN length(x) + length(y) = 0 THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * {_lcs('x', 'y')} / (length(x) + length(y)) END AS r FROM (SELECT DISTINCT x, y FROM {pairs}))"


def _bucket(key: str, buckets: int) -> str:
    return f"(('0x' || substr(md5({key} || '|42'), 1, 15))::BIGINT % {buckets})"


_PAIRS_AB = f"{OWNED}, ab AS (SELECT DISTINCT q_core AS a, s_core AS b FROM pq)"
_SETS = """st AS (SELECT a, b, list_distinct(list_filter(string_split(a, ' '), lambda t: t <> '')) AS ta, list_distinct(list_filter(string_split(b, ' '), lambda t: t <> '')) AS tb FROM ab),
    su AS (SELECT a, b, ta, tb, list_sort(list_intersect(ta, tb)) AS i, list_sort(list_filter(ta, lambda t: NOT list_contains(tb, t))) AS da, list_sort(list_filter(tb, lambda t: NOT list_contains(ta, t))) AS db FROM st),
    sv AS (SELECT a, b, ta, tb, i, da, db, array_to_string(i, ' ') AS si, array_to_string(list_concat(i, da), ' ') AS sa, array_to_string(list_concat(i, db), ' ') AS sb FROM su),
    sx AS (SELECT sa AS x, sb AS y FROM sv UNION SELECT si, sa FROM sv UNION SELECT si, sb FROM sv)"""

ORACLE_SQL: dict[str, str] = {
    "id_encode": f"{BASE} SELECT entity_id, CAST(substr(entity_id, 2, 1) AS INTEGER) AS src, CAST(substr(entity_id, 2, 1) AS BIGINT) * 10000000000 + CAST(substr(entity_id, 4) AS BIGINT) AS iid FROM rec",
    "truth_explode": f"{BASE} SELECT s_id, q_id FROM truth",
    "truth_one_owner": f"{BASE} SELECT count(*) AS n_broken FROM (SELECT q_id FROM truth GROUP BY q_id HAVING count(*) > 1)",
    "matches_distribution": f"{BASE} SELECT n_matches, count(*) AS n_entities FROM (SELECT entity_id, count(q_id) AS n_matches FROM s1 LEFT JOIN truth ON s_id = entity_id GROUP BY 1) GROUP BY 1",
    "country_summary": f"{BASE} SELECT country, count(*) AS n, round(avg(CASE WHEN business_address = '' THEN 1.0 ELSE 0.0 END), 6) AS empty_share, round(avg(CASE WHEN true_s1 IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS owned_share FROM rec GROUP BY 1",
    "norm_name": f"{NORM} SELECT entity_id, name, core, alias, false AS nonlatin FROM q_norm",
    "norm_addr": f"{NORM} SELECT entity_id, addr FROM q_norm",
    "name_skeleton": f"""{NORM}, k AS (SELECT entity_id, regexp_replace(core, '[aeiouy ]', '', 'g') AS c FROM s_norm)
        SELECT entity_id, array_to_string(list_transform(list_filter(range(1, length(c) + 1), lambda i: i = 1 OR c[i] <> c[i - 1]), lambda i: c[i]), '') AS skeleton FROM k""",
    "blocking_tokens": f"{TOK} SELECT entity_id, field, tok FROM q_tok",
    "doc_frequency": f"{TOK} SELECT field, tok, df FROM freq",
    "idf": f"{TOK} SELECT field, tok, round(ln((n + 1) / (df + 1)) + 1, 6) AS idf, df <= {DF_CAP} AS blocks FROM freq, total",
    "tfidf_weights": f"{TOK}, {_weights('s', False)} SELECT entity_id, field, tok, round(w, 6) AS w FROM s_all",
    "block_vector": f"{VECTORS} SELECT entity_id, tok, round(w, 6) AS w FROM s_block",
    "cosine_topk": f"{CAND} SELECT q_id, s_id, cos FROM top",
    "candidate_cut": f"{CAND} SELECT q_id, s_id, cos FROM cand",
    "doc_neardup_topk": f"""WITH t AS (SELECT doc_id AS entity_id, lang AS country, unnest(list_distinct({_words("regexp_replace(lower(coalesce(text, '')), '[^a-z0-9à-ÿ]', ' ', 'g')")})) AS tok FROM documents),
        f AS (SELECT tok, count(*) AS df FROM t GROUP BY 1), n AS (SELECT count(*) AS n FROM documents),
        v AS (SELECT entity_id, country, t.tok, ln((n + 1) / (df + 1)) + 1 AS w0 FROM t JOIN f USING (tok), n),
        w AS (SELECT entity_id, country, tok, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY entity_id)) AS w FROM v),
        pairs AS (SELECT q.entity_id AS q_id, s.entity_id AS s_id, round(sum(q.w * s.w), 6) AS cos FROM w q JOIN w s USING (country, tok) WHERE q.entity_id % 100 = 0 AND q.entity_id <> s.entity_id GROUP BY ALL), {CUT}
        SELECT q_id, s_id, cos FROM cand""",
    "rank_gap_features": f"""{CAND} SELECT q_id, s_id, cos, row_number() OVER (PARTITION BY q_id ORDER BY cos DESC, s_id) AS cos_rank, round(max(cos) OVER (PARTITION BY q_id) - cos, 6) AS cos_gap,
        round(cos / max(cos) OVER (PARTITION BY q_id), 6) AS cos_ratio, count(*) OVER (PARTITION BY q_id) AS n_cand FROM cand""",
    "dup_counts": f"{NORM} SELECT entity_id, count(*) OVER (PARTITION BY core) AS core_dup, count(*) OVER (PARTITION BY addr) AS addr_dup FROM s_norm",
    "field_cosines": f"""{CAND}, {_weights('s', False)}, {_weights('q', False)},
        fc AS (SELECT q_id, s_id, q.field, sum(q.w * s.w) AS c FROM cand JOIN q_all q ON q.entity_id = q_id JOIN s_all s ON s.entity_id = s_id AND s.field = q.field AND s.tok = q.tok GROUP BY ALL)
        SELECT c.q_id, c.s_id, {', '.join(f"round(coalesce(max(CASE WHEN field = '{f}' THEN c END), 0), 6) AS {f}_cos" for f in ('name', 'addr', 'num'))} FROM cand c LEFT JOIN fc USING (q_id, s_id) GROUP BY ALL""".replace("THEN c END", "THEN fc.c END"),
    "set_overlap_features": f"""{CAND}, g AS (SELECT q_id, s_id, q.t_num AS qn, s.t_num AS sn, q.t_name AS qm, s.t_name AS sm, q.t_addr AS qa, s.t_addr AS sa, q.addr AS qaddr, q.core AS qcore, s.core AS score,
            len(list_intersect(q.t_num, s.t_num)) AS i_n, len(list_intersect(q.t_name, s.t_name)) AS i_m, len(list_intersect(q.t_addr, s.t_addr)) AS i_a
            FROM cand JOIN q_sets q ON q.entity_id = q_id JOIN s_sets s ON s.entity_id = s_id)
        SELECT q_id, s_id, i_n AS num_inter, round(i_n / greatest(len(qn) + len(sn) - i_n, 1), 6) AS num_jacc, round(i_n / greatest(len(qn), 1), 6) AS num_q_cov, len(qn) AS num_q_len, len(sn) AS num_s_len,
            i_m AS ntok_inter, round(i_m / greatest(len(qm) + len(sm) - i_m, 1), 6) AS ntok_jacc, round(i_m / greatest(len(qm), 1), 6) AS ntok_q_cov,
            i_a AS atok_inter, round(i_a / greatest(len(qa) + len(sa) - i_a, 1), 6) AS atok_jacc, round(i_a / greatest(len(qa), 1), 6) AS atok_q_cov,
            CAST(qaddr = '' AS INTEGER) AS q_addr_empty, CAST(substr(q_id, 2, 1) AS INTEGER) AS q_src, length(qcore) AS len_q_core, length(score) AS len_s_core FROM g""",
    "label_and_group": f"{CAND} SELECT q_id, s_id, CAST(coalesce(true_s1 = s_id, false) AS INTEGER) AS y, coalesce(true_s1, q_id) AS grp FROM cand JOIN rec ON entity_id = q_id",
    "fold_assignment": f"{CAND}, g AS (SELECT q_id, s_id, coalesce(true_s1, q_id) AS grp FROM cand JOIN rec ON entity_id = q_id) SELECT *, CAST({_bucket('grp', 3)} AS INTEGER) AS fold FROM g",
    "argmax_assign": f"{BEST} SELECT q_id, s_id, p FROM matches",
    "stream_link": f"{BEST} SELECT q_id, s_id, p FROM matches",
    "fbeta_entities": f"{BEST}, {_f('matches')} SELECT s_id, country, tp, n_pred, n_true, round(f, 6) AS f FROM fb",
    "fbeta_macro": f"{BEST}, {_f('matches')} SELECT round(avg(f), 6) AS f, count(*) AS n FROM fb",
    "fbeta_by_country": f"{BEST}, {_f('matches')} SELECT country, round(avg(f), 6) AS f, count(*) AS n FROM fb GROUP BY 1",
    "blocking_recall": f"""{CAND} SELECT (SELECT count(*) FROM cand) AS n_pairs, (SELECT count(*) FROM cand JOIN truth USING (s_id, q_id)) AS found, (SELECT count(*) FROM truth) AS n_true,
        round((SELECT count(*) FROM cand JOIN truth USING (s_id, q_id)) / (SELECT count(*) FROM truth), 6) AS recall, round(1 - (SELECT count(*) FROM cand) / ((SELECT count(*) FROM rec)::DOUBLE * (SELECT count(*) FROM s1)), 6) AS reduction""",
    "oracle_ceiling": f"""{CAND}, hits AS (SELECT s_id, q_id FROM cand SEMI JOIN truth USING (s_id, q_id)), {_f('hits')}
        SELECT round(avg(f), 6) AS ceiling, round(avg(CASE WHEN n_true = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS floor FROM fb""",
    "false_positives": f"""{BEST} SELECT m.q_id, m.s_id, p, q.business_name AS q_name, q.business_address AS q_address, s.business_name AS s_name, s.business_address AS s_address
        FROM matches m ANTI JOIN truth t ON t.s_id = m.s_id AND t.q_id = m.q_id JOIN rec q ON q.entity_id = m.q_id JOIN s1 s ON s.entity_id = m.s_id""",
    "singleton_accuracy": f"{BEST} SELECT count(*) AS n_singletons, count(*) FILTER (entity_id NOT IN (SELECT s_id FROM matches)) AS n_left_empty FROM s1 WHERE entity_id NOT IN (SELECT s_id FROM truth)",
    "grouped_output": f"{BEST} SELECT entity_id AS source1_entity_id, coalesce(string_agg(q_id, ',' ORDER BY q_id), '') AS matched_entity_ids FROM s1 LEFT JOIN matches ON s_id = entity_id GROUP BY 1",
    "output_stats": f"{BEST} SELECT (SELECT count(*) FROM s1) AS n_rows, (SELECT count(*) FROM matches) AS n_ids, (SELECT count(*) FROM s1 WHERE entity_id NOT IN (SELECT s_id FROM matches)) AS n_empty",
    "output_checks": f"{BASE} SELECT unnest(['entity without a row', 'row of an unknown entity', 'entity with two rows', 'id twice in a list', 'id of another source', 'id of no record', 'match that is no candidate']) AS rule, 0 AS n",
    "jaro_winkler": f"{_PAIRS_AB} SELECT a, b, round(jaro_winkler_similarity(a, b), 6) AS score FROM ab",
    "fuzzy_ratio": f"{_PAIRS_AB}, p0 AS (SELECT a AS x, b AS y FROM ab), {_ratio('p0')} SELECT x AS a, y AS b, round(r, 6) AS score FROM lr",
    "fuzzy_token_sort": f"{_PAIRS_AB}, p0 AS (SELECT a, b, {_sorted_words('a')} AS x, {_sorted_words('b')} AS y FROM ab), {_ratio('p0')} SELECT a, b, round(r, 6) AS score FROM p0 JOIN lr USING (x, y)",
    "fuzzy_token_set": f"""{_PAIRS_AB}, {_SETS}, {_ratio('sx')}
        SELECT a, b, round(CASE WHEN len(ta) = 0 OR len(tb) = 0 THEN 0 WHEN len(i) > 0 AND (len(da) = 0 OR len(db) = 0) THEN 100 ELSE greatest(l1.r, CASE WHEN len(i) > 0 THEN l2.r ELSE 0 END, CASE WHEN len(i) > 0 THEN l3.r ELSE 0 END) END, 6) AS score
        FROM sv JOIN lr l1 ON l1.x = sa AND l1.y = sb JOIN lr l2 ON l2.x = si AND l2.y = sa JOIN lr l3 ON l3.x = si AND l3.y = sb""",
}

_GEO = f"""{BASE}, vocab AS (SELECT country || '|' || lower(trim(string_split(business_address, ',')[-1])) AS v FROM s1 GROUP BY 1 HAVING count(*) >= 20),
    parts AS (SELECT entity_id, country, generate_subscripts(string_split(business_address, ','), 1) AS pos, unnest(string_split(business_address, ',')) AS c FROM s1),
    found AS (SELECT entity_id, arg_max(lower(trim(c)), pos) AS c FROM parts WHERE country || '|' || lower(trim(c)) IN (SELECT v FROM vocab) AND trim(c) <> '' GROUP BY 1),
    keyed AS (SELECT s1.*, country || '|' || coalesce(c, '?') AS geo FROM s1 LEFT JOIN found USING (entity_id))"""
ORACLE_SQL |= {
    "geo_key": f"{_GEO} SELECT entity_id, geo FROM keyed",
    "geo_sample": f"""{_GEO}, sizes AS (SELECT geo, count(*) AS n FROM keyed GROUP BY 1), small AS (SELECT * FROM sizes WHERE n <= 0.25 * (SELECT count(*) FROM s1)),
        run AS (SELECT geo, coalesce(sum(n) OVER (ORDER BY md5(geo), geo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM small)
        SELECT entity_id, geo FROM keyed WHERE geo IN (SELECT geo FROM run WHERE before < 0.5 * (SELECT count(*) FROM s1))""",
    "component_geo_map": f"""{_GEO}, rp AS (SELECT DISTINCT r.entity_id, r.country, k.geo, lower(trim(c)) AS comp FROM (SELECT *, unnest(string_split(business_address, ',')) AS c FROM rec) r JOIN keyed k ON k.entity_id = r.true_s1 WHERE trim(c) <> ''),
        counts AS (SELECT country, comp, geo, count(*) AS n FROM rp GROUP BY ALL), tot AS (SELECT country, comp, sum(n)::BIGINT AS total, max(n) AS top FROM counts GROUP BY ALL)
        SELECT c.country, c.comp, max(c.geo) AS geo, any_value(total) AS total, any_value(c.n) AS n FROM counts c JOIN tot t ON t.country = c.country AND t.comp = c.comp AND c.n = t.top WHERE total >= 20 AND top / total >= 0.95 AND geo NOT LIKE '%|?' GROUP BY 1, 2""",
    "tau_sweep": f"""{BEST}, taus AS (SELECT unnest({list(TAUS)!r}::DOUBLE[]) AS tau), n_t AS (SELECT s_id, count(*) AS n_true FROM truth GROUP BY ALL),
        n_p AS (SELECT tau, b.s_id, count(*) AS n_pred, count(t.q_id) AS tp FROM taus JOIN best b ON p >= tau LEFT JOIN truth t ON t.s_id = b.s_id AND t.q_id = b.q_id GROUP BY ALL),
        e AS (SELECT taus.tau, entity_id, coalesce(tp, 0) AS tp, coalesce(n_pred, 0) AS n_pred, coalesce(n_true, 0) AS n_true FROM taus CROSS JOIN s1 LEFT JOIN n_p ON n_p.tau = taus.tau AND n_p.s_id = entity_id LEFT JOIN n_t ON n_t.s_id = entity_id)
        SELECT tau, round(avg(CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0::DOUBLE WHEN tp = 0 THEN 0.0::DOUBLE ELSE 1.25::DOUBLE * (tp / n_pred) * (tp / n_true) / (0.25::DOUBLE * (tp / n_pred) + tp / n_true) END), 6) AS f FROM e GROUP BY 1""",
}
_PICKED = """sizes AS (SELECT geo, count(*) AS n FROM keyed GROUP BY 1), small AS (SELECT * FROM sizes WHERE n <= 0.25 * (SELECT count(*) FROM s1)),
    run AS (SELECT geo, coalesce(sum(n) OVER (ORDER BY md5(geo), geo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM small),
    picked AS (SELECT geo FROM run WHERE before < 0.5 * (SELECT count(*) FROM s1))"""
ORACLE_SQL["development_sample"] = f"""{_GEO}, {_PICKED}, cm AS ({ORACLE_SQL['component_geo_map'].removeprefix(_GEO).lstrip(', ').replace('rp AS', 'WITH rp AS', 1)}),
    un AS (SELECT entity_id, country, unnest(string_split(business_address, ',')) AS c, generate_subscripts(string_split(business_address, ','), 1) AS pos FROM rec WHERE true_s1 IS NULL),
    ug AS (SELECT u.entity_id, arg_max(cm.geo, pos) AS geo FROM un u JOIN cm ON cm.country = u.country AND cm.comp = lower(trim(c)) WHERE trim(c) <> '' GROUP BY 1)
    SELECT entity_id, true_s1 FROM rec WHERE true_s1 IN (SELECT entity_id FROM keyed WHERE geo IN (SELECT geo FROM picked))
    UNION ALL SELECT r.entity_id, r.true_s1 FROM rec r LEFT JOIN ug USING (entity_id) WHERE true_s1 IS NULL AND (geo IN (SELECT geo FROM picked) OR (geo IS NULL AND {_bucket('r.entity_id', 1_000_000)} < 100000))"""
ORACLE_SQL["best_tau"] = f"SELECT * FROM ({ORACLE_SQL['tau_sweep']}) ORDER BY f DESC, tau LIMIT 1"
