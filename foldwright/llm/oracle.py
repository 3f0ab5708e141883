"""DuckDB SQL of the text operators that SQL can express."""

from __future__ import annotations

from foldwright.llm import decontaminate as d
from foldwright.llm import divergence as v
from foldwright.llm import phrases as p
from foldwright.llm import secrets as s


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def secret_scans() -> str:
    """A match begins behind all gaps and matches before it; DuckDB splits and extracts with the same pattern."""
    parts = []
    for name, (_, pattern, group, least) in s.RULES.items():
        own = _quoted(pattern)
        parts.append(
            f"SELECT doc_id, '{name}' AS kind, {s.ORDER[name]} AS rank, {least} AS least, regexp_extract_all(t, {own}) AS m, "
            f"regexp_extract_all(t, {own}, {group}) AS g, string_split_regex(t, {own}) AS gaps FROM d"
        )
    spans = "string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank)"
    count = ", ".join(f"count(*) FILTER (kind = '{name}') AS n_{name}" for name in s.BASE)
    base = ", ".join(_quoted(n) for n in s.BASE)
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), k AS ({' UNION ALL '.join(parts)}), "
        "e AS (SELECT doc_id, kind, rank, least, m, g, gaps, unnest(range(1, len(m) + 1)) AS i FROM k WHERE len(m) > 0), "
        "p AS (SELECT doc_id, kind, rank, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + "
        "coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT AS a, length(m[i]) AS n FROM e WHERE length(g[i]) >= least), "
        "f AS (SELECT doc_id, kind, rank, a, a + n AS z FROM p), "
        f"o AS (SELECT doc_id, {count}, sha256(coalesce({spans} FILTER (kind IN ({base})), '')) AS base_sha256, {spans} AS spans FROM f GROUP BY doc_id) "
        f"SELECT d.doc_id, {', '.join(f'coalesce(n_{n}, 0) AS n_{n}' for n in s.BASE)}, coalesce(base_sha256, sha256('')) AS base_sha256, "
        "coalesce(spans, '') AS spans FROM d LEFT JOIN o ON o.doc_id = d.doc_id"
    )


def decontamination() -> str:
    """Without seeds: every word that a text and an item share lies on a diagonal, and a diagonal with enough words that
    agree is looked at from each of them on."""
    words = r"list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')"
    each = "SELECT {key}, {more}w[i] AS w, i FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM {table})"
    return (
        f"WITH t AS (SELECT DISTINCT doc_id, {words} AS w FROM documents), b AS (SELECT DISTINCT item_id, {words} AS w FROM benchmark), "
        f"te AS ({each.format(key='doc_id', more='', table='t')}), "
        f"be AS ({each.format(key='item_id', more=f'least(len(w), {d.WINDOW}) AS words, ', table='b')}), "
        "g AS (SELECT doc_id, item_id, te.i - be.i AS diagonal, any_value(words)::BIGINT AS words, list(be.i) AS spots FROM te JOIN be ON te.w = be.w "
        f"GROUP BY doc_id, item_id, diagonal HAVING count(*) / any_value(words) >= {d.SHARE}), "
        "m AS (SELECT doc_id, item_id, words, list_max(list_transform(spots, lambda a: len(list_filter(spots, lambda x: x >= a AND x < a + words))))::BIGINT "
        "AS matched FROM g) "
        f"SELECT doc_id, item_id, max(words) AS words, max(matched) AS matched, max(matched) / max(words) AS similarity FROM m WHERE matched / words >= {d.SHARE} "
        "GROUP BY doc_id, item_id"
    )


def lm_scoring() -> str:
    from foldwright.llm.lm import CONTEXT, START

    start = f"list_concat([{', '.join([f'chr({START})'] * CONTEXT)}], regexp_extract_all(coalesce(text, ''), '(?s).'))"
    loss = "-ln(CASE WHEN {h} > 0 THEN ({n} + {t} * {p}) / ({h} + {t}) ELSE {p} END)"
    return (
        f"WITH d AS (SELECT doc_id, {start} AS l, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) AS good FROM documents), "
        f"g AS (SELECT doc_id, good, l[i - 3] || l[i - 2] || l[i - 1] AS ctx, l[i] AS c FROM (SELECT *, unnest(range({CONTEXT + 1}, len(l) + 1)) AS i FROM d)), "
        "n AS (SELECT ctx, c, count(*) AS n, count(*) FILTER (good) AS m FROM g GROUP BY ALL), "
        "h AS (SELECT ctx, sum(n) AS hn, sum(m) AS hm, count(*) AS tn, count(*) FILTER (m > 0) AS tm FROM n GROUP BY ctx), "
        "s AS (SELECT count(DISTINCT c) + 1 AS v, sum(n) AS sn, sum(m) AS sm FROM n), "
        "u AS (SELECT c, (sum(n) + 1) / (any_value(sn) + any_value(v)) AS pn, (sum(m) + 1) / (any_value(sm) + any_value(v)) AS pm FROM n, s GROUP BY c), "
        f"w AS (SELECT ctx, c, {loss.format(h='hm', n='m', t='tm', p='pm')} AS lt, {loss.format(h='hn', n='n', t='tn', p='pn')} AS lb "
        "FROM n JOIN h USING (ctx) JOIN u USING (c)), "
        "r AS (SELECT doc_id, count(*) AS k, sum(lt) AS a, sum(lb) AS b FROM g JOIN w USING (ctx, c) GROUP BY doc_id) "
        "SELECT d.doc_id, coalesce(k, 0) AS n_tokens, round(coalesce(a / k, 0), 9) AS loss_target, round(coalesce(b / k, 0), 9) AS loss_background, "
        "round(coalesce((a - b) / k, 0), 9) AS difference FROM d LEFT JOIN r USING (doc_id)"
    )


def source_divergence() -> str:
    """Densely: every source with every kept term of its language."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    share = f"1 + ({v.ONE}::HUGEINT * ({{n}} + {v.SMOOTH})) // ({{total}} + {v.SMOOTH} * terms)"
    return (
        "WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, "
        rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents), "
        "e AS (SELECT k, lang, source, unnest(t) AS term FROM d), "
        f"w AS (SELECT lang, term, count(*) AS every FROM e GROUP BY ALL HAVING count(DISTINCT k) >= {v.LEAST}), "
        "c AS (SELECT lang, source, term, count(*) AS n FROM e SEMI JOIN w USING (lang, term) GROUP BY ALL), "
        "l AS (SELECT lang, count(*) AS terms, sum(every) AS whole FROM w GROUP BY lang), "
        "g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL), "
        f"f AS (SELECT lang, source, term, coalesce(n, 0) AS n, {share.format(n='coalesce(n, 0)', total='total')} AS p, "
        f"{share.format(n='every', total='whole')} AS q FROM g JOIN l USING (lang) JOIN w USING (lang) LEFT JOIN c USING (lang, source, term)), "
        "s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL), "
        "r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang "
        "AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source "
        "UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM f WHERE n > 0 AND p > q) "
        "SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r "
        f"QUALIFY part = 'pair' OR rank <= {v.TOP}"
    )


def phrase_collocations() -> str:
    """All runs of one to four words, counted one by one."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    size = p.DEPTH
    return (
        rf"WITH q AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), "
        r"'[.,;:!?\x0A-\x0D]')) AS piece FROM documents), x AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM q), "
        f"y AS (SELECT lang, w, unnest(range(1, {size + 1})) AS k FROM x), "
        "z AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM y WHERE len(w) >= k), "
        "g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM z GROUP BY ALL), "
        f"c AS (SELECT *, string_split(phrase, ' ') AS w FROM g WHERE a >= {p.LEAST}), "
        "n AS (SELECT lang, sum(a)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang), "
        "i AS (SELECT lang, k, a, w, unnest(range(1, k)) AS m FROM c WHERE k > 2), "
        "h AS (SELECT lang, a, array_to_string(w[s:s + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, k - m + 2)) AS s FROM i) WHERE m > 1), "
        "o AS (SELECT lang, phrase, max(a) AS longer FROM h GROUP BY ALL), "
        f"e AS (SELECT c.* FROM c LEFT JOIN o USING (lang, phrase) WHERE k > 1 AND NOT coalesce(100 * longer::HUGEINT >= {p.SHARE} * a::HUGEINT, false)), "
        "u AS (SELECT lang, phrase, a, k, w, unnest(range(1, k)) AS m FROM e), "
        "t AS (SELECT u.lang, u.phrase, u.a, u.m, b.a AS l, d.a AS r, "
        f"(({p.SCALE} * u.a::HUGEINT) // (b.a + d.a))::BIGINT AS score FROM u JOIN c b ON b.lang = u.lang AND b.phrase = array_to_string(u.w[1:m], ' ') "
        "JOIN c d ON d.lang = u.lang AND d.phrase = array_to_string(u.w[m + 1:], ' ')), "
        "v AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, m) = 1) "
        "SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM v JOIN n USING (lang) "
        f"QUALIFY rank <= {p.TOP}"
    )


ORACLE = {
    "op11_phrase_collocations": phrase_collocations(),
    "op13_source_divergence": source_divergence(),
    "op7_lm_scoring": lm_scoring(),
    "op8_secret_scans": secret_scans(),
    "secret_ledger_two_scans": "SELECT doc_id, CASE WHEN spans = '' THEN 0 ELSE len(string_split(spans, ',')) END AS n_found, spans "
    f"FROM ({secret_scans()})",
    "op9_benchmark_decontamination": decontamination(),
}
