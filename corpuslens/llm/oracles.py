"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

from collections.abc import Sequence

from corpuslens.llm import sharding, urls

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT = f"""
    WITH d AS (SELECT doc_id, sha256({LOWER.format("coalesce(text, '')")}) AS h FROM documents)
    SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
    FROM d"""


def collocations(min_count: int, longest: int, top: int) -> str:
    """Neighbours come from windows over all tokens of a text, breaks between pieces included."""
    later = [f"lead(word, {k}) OVER w AS w{k}" for k in range(1, longest)]
    grams = []
    for m in range(1, longest + 1):
        parts = [f"w{k}" for k in range(m)]
        inside = " AND ".join(f"{p} <> chr(10)" for p in parts)
        grams.append(f"SELECT lang, {m} AS m, concat_ws(' ', {', '.join(parts)}) AS phrase FROM o WHERE {inside}")
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, {LOWER.format("coalesce(text, '')")} AS text FROM documents),
    s AS (SELECT r, lang, string_split_regex(regexp_replace(text, '[.,;:!?\x0A-\x0D]+', ' ' || chr(10) || ' ', 'g'), '[ \t]+') AS parts FROM d),
    e AS (SELECT r, lang, unnest(parts) AS word, generate_subscripts(parts, 1) AS i FROM s),
    o AS (SELECT lang, word AS w0, {", ".join(later)} FROM e WHERE word <> '' WINDOW w AS (PARTITION BY r ORDER BY i)),
    g AS ({" UNION ALL ".join(grams)}),
    f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL HAVING m = 1 OR count(*) >= {min_count}),
    n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
    c AS (SELECT *, string_split(phrase, ' ') AS words FROM f WHERE m > 1 AND f >= {min_count}),
    inside AS (SELECT lang, f, unnest([array_to_string(words[:m - 1], ' '), array_to_string(words[2:], ' ')]) AS phrase FROM c),
    kept AS (SELECT c.* FROM c ANTI JOIN inside i ON c.lang = i.lang AND c.phrase = i.phrase AND c.f = i.f),
    k AS (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM kept),
    cut AS (SELECT k.lang, k.phrase, k.f AS a, h.f AS l, t.f AS r, n.n, k.k,
                   (1000::HUGEINT * k.f * n.n // (h.f::HUGEINT * t.f))::BIGINT AS score
            FROM k JOIN n ON n.lang = k.lang
            JOIN f h ON h.lang = k.lang AND h.m = k.k AND h.phrase = array_to_string(words[:k.k], ' ')
            JOIN f t ON t.lang = k.lang AND t.m = k.m - k.k AND t.phrase = array_to_string(words[k.k + 1:], ' ')),
    low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM low QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {top}"""


# CRC-32 bit by bit, as a recursion over the bits of the decimal id.
_STEP = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
TRIE = f"""
    WITH RECURSIVE ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
    bits(conv_id, word, i, crc) AS (
        SELECT conv_id, conv_id::VARCHAR, 0::BIGINT, 4294967295::BIGINT FROM ids
        UNION ALL
        SELECT conv_id, word, i + 1, {_STEP.format("(CASE WHEN i % 8 = 0 THEN xor(crc, ord(substr(word, i // 8 + 1, 1))::BIGINT) ELSE crc END)")}
        FROM bits WHERE i < 8 * length(word)),
    h AS (SELECT conv_id, xor(crc, 4294967295::BIGINT) % 9 AS h FROM bits WHERE i = 8 * length(word)),
    own AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
                                 ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    built AS (SELECT o.conv_id, list_concat(coalesce(b.turns, [])[:h.h], o.turns[h.h + 1:]) AS turns
              FROM own o JOIN h ON h.conv_id = o.conv_id LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
    p AS (SELECT conv_id, turns, unnest(generate_series(0, len(turns))) AS depth FROM built),
    node AS (SELECT turns[:depth] AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                    sha256(coalesce(string_agg(CASE WHEN len(turns) = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends
             FROM p GROUP BY 1, 2),
    kids AS (SELECT prefix[:depth - 1] AS prefix, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
    whole AS (SELECT node.*, coalesce(kids.n, 0) AS n_children,
                    CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * octet_length(encode(prefix[depth].text)) END AS saved
             FROM node LEFT JOIN kids USING (prefix)),
    up AS (SELECT whole.*, unnest(generate_series(0, depth)) AS d FROM whole),
    sums AS (SELECT prefix[:d] AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY 1)
    SELECT f.conv_id, f.depth, a.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends AS ends_sha256
    FROM whole f JOIN sums s ON s.prefix = f.prefix LEFT JOIN node a ON f.depth > 0 AND a.prefix = f.prefix[:f.depth - 1]"""


def shards(names: Sequence[str]) -> str:
    """The lookup table goes in as one string of two digits per slot."""
    owners = "".join(f"{owner:02d}" for owner in sharding.lookup_table(names).tolist())
    prefix = names[0][:-2]
    return f"""
    WITH t AS (SELECT '{owners}' AS owners),
    d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT % {sharding.SLOTS} AS slot
          FROM documents)
    SELECT doc_id, slot, '{prefix}' || substr(t.owners, CAST(2 * slot + 1 AS BIGINT), 2) AS shard FROM d, t"""


def url_filter(rules: Sequence[tuple[str, str, str]]) -> str:
    fits = [
        (kind, host + path, f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')")
        for kind, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2]))
    ]
    rule = "CASE " + " ".join(f"WHEN {where} THEN '{name}'" for _, name, where in fits) + " END"
    ruled = "CASE " + " ".join(f"WHEN {where} THEN '{kind}'" for kind, _, where in fits) + " END"
    n = urls.ORDER
    levels, below = [], ""
    for k in range(1, n + 1):
        if k == 1:
            p, join = {c: f"{1 / urls.SYMBOLS!r}" for c in (0, 1)}, ""
        else:
            p, join = {c: f"s.p{c}" for c in (0, 1)}, f"JOIN {below} s ON s.gram = substr(l.gram, 2, {k - 1})"
        blend = ", ".join(
            f"CASE WHEN c.all{c} > 0 THEN (l.n{c} + c.kinds{c} * {p[c]}) / (c.all{c} + c.kinds{c})::DOUBLE ELSE {p[c]} END AS p{c}"
            for c in (0, 1)
        )
        levels.append(f"""
    l{k} AS (SELECT substr(gram, {n - k + 1}, {k}) AS gram, sum(n0) AS n0, sum(n1) AS n1 FROM g GROUP BY 1),
    c{k} AS (SELECT substr(gram, 1, {k - 1}) AS context, sum(n0) AS all0, sum(n1) AS all1,
                    count(*) FILTER (n0 > 0) AS kinds0, count(*) FILTER (n1 > 0) AS kinds1 FROM l{k} GROUP BY 1),
    p{k} AS (SELECT l.gram, {blend} FROM l{k} l JOIN c{k} c ON c.context = substr(l.gram, 1, {k - 1}) {join})""")
        below = f"p{k}"
    return f"""
    WITH a AS (SELECT row_number() OVER () AS r, page_id,
                      CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    b AS (SELECT r, page_id, rest, {LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host FROM a),
    h AS (SELECT r, page_id, host, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM b),
    u AS (SELECT *, {rule} AS rule, {ruled} AS ruled,
                 regexp_replace(translate({LOWER.format("host || path")}, '123456789', '000000000'), '[^a-z0./_-]', '~', 'g') AS text
          FROM h),
    k AS (SELECT *, CASE ruled WHEN 'allow' THEN 1 WHEN 'block' THEN 0 END AS label, substr(md5(text), 1, 1) < '4' AS held FROM u),
    i AS (SELECT k.*, unnest(generate_series(1, length(text) + 1)) AS i FROM k),
    w AS (SELECT r, held, label, substr('{"^" * (n - 1)}' || text || '$', i, {n}) AS gram FROM i),
    g AS (SELECT gram, count(*) FILTER (label = 0 AND NOT held) AS n0, count(*) FILTER (label = 1 AND NOT held) AS n1
          FROM w GROUP BY gram),{",".join(levels)},
    s AS (SELECT w.r, avg(ln(p1) - ln(p0)) AS score FROM w JOIN p{n} USING (gram) GROUP BY w.r),
    z AS (SELECT k.*, s.score FROM k JOIN s USING (r)),
    bins AS (SELECT floor(score * {urls.STEPS}) AS step, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1
             FROM z WHERE held AND label IS NOT NULL GROUP BY 1),
    best AS (SELECT step, (coalesce(lag(step) OVER (ORDER BY step) + 1, step) + step) / 2.0::DOUBLE / {float(urls.STEPS)} AS cut,
                    round(1 - coalesce(sum(n1) OVER low, 0) / (SELECT sum(n1) FROM bins)
                                + coalesce(sum(n0) OVER low, 0) / (SELECT sum(n0) FROM bins), 9) AS quality
             FROM bins WHERE (SELECT sum(n1) FROM bins) > 0 AND (SELECT sum(n0) FROM bins) > 0
             WINDOW low AS (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t AS (SELECT coalesce((SELECT cut FROM best ORDER BY quality DESC, step LIMIT 1), 0.0::DOUBLE) AS cut)
    SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score >= cut THEN 'allow' ELSE 'block' END) AS verdict,
           round(score, 6) AS score
    FROM z, t"""
