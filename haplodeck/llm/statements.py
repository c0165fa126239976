"""DuckDB statements for the longer queries of this folder."""

from haplodeck.llm import pii
from haplodeck.llm import quality_rules as qr

_WORD = r"[^\x20\x09-\x0D]+"
_GRID = ", ".join(
    f"('{rule}', {i}, {j}, {cutoff})" for i, (rule, (_, _, grid)) in enumerate(qr.RULES.items())
    for j, cutoff in enumerate(grid))
_RATIOS = " UNION ALL ".join(
    f"SELECT doc_id, stratum, base_failed, '{rule}' AS rule, {over}::DOUBLE / greatest({under}, 1) AS ratio FROM c"
    for rule, (over, under, _) in qr.RULES.items())

QUALITY = rf"""
WITH t AS MATERIALIZED (
    SELECT doc_id, coalesce(lang, '(none)') AS stratum, coalesce(text, '') AS x,
           regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS lines
    FROM documents),
pos AS MATERIALIZED (
    SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)),
twice AS (SELECT doc_id, g FROM pos GROUP BY doc_id, g HAVING count(*) > 1),
rep AS (
    SELECT doc_id, count(DISTINCT i + k) AS n FROM pos JOIN twice USING (doc_id, g)
    CROSS JOIN (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
c AS MATERIALIZED (
    SELECT t.doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
           (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
           (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
           len(lines)::BIGINT AS n_lines, (length(x) - length(regexp_replace(x, '\p{{Lu}}', '', 'g')))::BIGINT AS n_capitals,
           (length(x) - length(replace(x, '!', '')))::BIGINT AS n_exclamations,
           len(w) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(w) AS base_failed
    FROM t LEFT JOIN rep USING (doc_id)),
ratios AS MATERIALIZED ({_RATIOS}),
labelled AS (
    SELECT doc_id, min(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = max(quality)),
grid(rule, rule_no, place, cutoff) AS (VALUES {_GRID}),
sides AS (
    SELECT unnest([stratum, '{qr.POOLED}']) AS stratum, rule, q, ratio FROM ratios JOIN labelled USING (doc_id) WHERE NOT base_failed),
tests AS (
    SELECT stratum, rule, place, cutoff, count(*) FILTER (WHERE q = 1) AS good,
           count(*) FILTER (WHERE q = 1 AND ratio > cutoff) AS lost, count(*) FILTER (WHERE q = 0) AS bad,
           count(*) FILTER (WHERE q = 0 AND ratio > cutoff) AS caught
    FROM sides JOIN grid USING (rule) GROUP BY ALL),
bounded AS (
    SELECT *, lost < good * {qr.RISK / len(qr.RULES)} AND list_sum(list_transform(
        range(0, CASE WHEN lost < good * {qr.RISK / len(qr.RULES)} THEN lost + 1 ELSE 0 END),
        lambda i: exp(lgamma(good + 1) - lgamma(i + 1) - lgamma(good - i + 1)
            + i * ln({qr.RISK / len(qr.RULES)}) + (good - i) * ln(1 - {qr.RISK / len(qr.RULES)}))))
        <= {qr.CONFIDENCE / len(qr.RULES)} / (SELECT count(DISTINCT stratum) FROM tests) AS passed
    FROM tests),
held AS (
    SELECT * FROM (SELECT *, bool_and(coalesce(passed, false)) OVER (PARTITION BY stratum, rule ORDER BY place) AS ok FROM bounded) WHERE ok),
useful AS (
    SELECT *, row_number() OVER (PARTITION BY stratum, rule ORDER BY place) AS rn
    FROM (SELECT *, max(caught) OVER (PARTITION BY stratum, rule) AS most FROM held)
    WHERE caught > 0 AND caught >= {1 - qr.SLACK} * most AND caught * good >= {qr.USEFUL} * lost * bad),
failed AS (
    SELECT r.doc_id, string_agg(r.rule, ',' ORDER BY g.rule_no) AS rules
    FROM ratios r JOIN (SELECT DISTINCT rule, rule_no FROM grid) g USING (rule)
    LEFT JOIN useful o ON o.rule = r.rule AND o.stratum = r.stratum AND o.rn = 1
    LEFT JOIN useful p ON p.rule = r.rule AND p.stratum = '{qr.POOLED}' AND p.rn = 1
    WHERE r.ratio > coalesce(o.cutoff, p.cutoff) GROUP BY r.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rules IS NULL AS kept, coalesce(rules, '') AS failed_rules
FROM c LEFT JOIN failed USING (doc_id)
"""

_B = r"\x20\x09-\x0D"
_TRIM = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
_KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_MATCHES = " UNION ALL ".join(
    f"SELECT doc_id, {k} AS kind, regexp_extract_all(x, '{p}') AS m, string_split_regex(x, '{p}') AS g FROM t"
    for k, p in enumerate(_KINDS.values()))
_DIGITS = r"regexp_replace(value, '[^0-9]', '', 'g')"

PERSONAL_DATA = rf"""
WITH t AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS x FROM documents),
cut AS (SELECT * FROM ({_MATCHES}) WHERE len(m) > 0),
one AS (SELECT doc_id, kind, unnest(range(1, len(m) + 1)) AS i, m, g FROM cut),
placed AS (
    SELECT doc_id, kind, m[i] AS value, (sum(length(g[i]) + length(m[i])) OVER (
        PARTITION BY doc_id, kind ORDER BY i) - length(m[i]))::BIGINT AS s FROM one),
base AS MATERIALIZED (
    SELECT doc_id, kind, value, s, s + length(value) AS e FROM placed
    WHERE CASE kind WHEN 0 THEN true
        WHEN 1 THEN list_bool_and(list_transform(string_split(value, '.'), lambda p: try_cast(p AS HUGEINT) <= 255))
        WHEN 2 THEN length({_DIGITS}) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1),
            lambda i: CASE WHEN (length({_DIGITS}) - i) % 2 = 1
                THEN substr({_DIGITS}, i, 1)::INT * 2 - CASE WHEN substr({_DIGITS}, i, 1)::INT > 4 THEN 9 ELSE 0 END
                ELSE substr({_DIGITS}, i, 1)::INT END)) % 10 = 0
        ELSE length({_DIGITS}) BETWEEN 10 AND 15 END),
near AS (
    SELECT doc_id, kind || ':' || value AS entity, s, e, length(x) AS n,
        substring(x, greatest(s - {pii.NEAR}, 0) + 1, least(s, {pii.NEAR})) AS l, substring(x, e + 1, {pii.NEAR}) AS r
    FROM base JOIN t USING (doc_id)),
around AS (
    SELECT doc_id, entity, unnest(regexp_extract_all(
        CASE WHEN s > {pii.NEAR} THEN regexp_replace(l, '^[^{_B}]+', '') ELSE l END || ' ' ||
        CASE WHEN e + {pii.NEAR} < n THEN regexp_replace(r, '(^|[{_B}])[^{_B}]+$', '\1') ELSE r END, '[^{_B}]+')) AS w
    FROM near),
terms AS MATERIALIZED (
    SELECT DISTINCT doc_id, entity, regexp_replace(lower(w), '{_TRIM}', '', 'g') AS term FROM around),
good AS MATERIALIZED (SELECT * FROM terms WHERE regexp_matches(term, '^[\p{{L}}\p{{M}}''’-]{{3,}}$')),
places AS (SELECT doc_id, entity, string_agg(term, ' ' ORDER BY term) AS place FROM good GROUP BY doc_id, entity),
pairs AS (
    SELECT entity, term, count(*) AS n_both, count(DISTINCT place) AS n_places FROM good JOIN places USING (doc_id, entity)
    GROUP BY entity, term HAVING count(DISTINCT place) >= {pii.SUPPORT}),
words AS MATERIALIZED (
    SELECT doc_id, i, w, s, regexp_replace(w, '{_TRIM}', '', 'g') AS core, length(regexp_extract(w, '^[^\p{{L}}\p{{N}}]*')) AS lead
    FROM (SELECT doc_id, i, w, (sum(length(gap) + length(w)) OVER (PARTITION BY doc_id ORDER BY i) - length(w))::BIGINT AS s
        FROM (SELECT doc_id, unnest(m) AS w, unnest(g[1:len(m)]) AS gap, unnest(range(1, len(m) + 1)) AS i FROM (
            SELECT doc_id, regexp_extract_all(x, '[^{_B}]+') AS m, string_split_regex(x, '[^{_B}]+') AS g FROM t)))),
seen AS (SELECT lower(core) AS term, count(DISTINCT doc_id) AS with_term FROM words WHERE lower(core) IN (SELECT term FROM pairs) GROUP BY 1),
ents AS (SELECT entity, count(DISTINCT doc_id) AS with_entity FROM near GROUP BY 1),
flagged AS (
    SELECT term, max(ln(n * n_both / (with_term * with_entity)) / ln(n / with_entity)) AS share
    FROM pairs JOIN ents USING (entity) JOIN seen USING (term) CROSS JOIN (SELECT count(*)::DOUBLE AS n FROM documents)
    WHERE with_entity < n GROUP BY term HAVING max(ln(n * n_both / (with_term * with_entity)) / ln(n / with_entity)) >= {pii.GENERALISE}),
extra AS (
    SELECT doc_id, CASE WHEN share >= {pii.REMOVE} THEN 5 ELSE 4 END AS kind, s + lead AS s, s + lead + length(core) AS e
    FROM words JOIN flagged ON lower(core) = term
    WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = words.doc_id AND s + lead < b.e AND b.s < s + lead + length(core))),
every AS (SELECT doc_id, kind, s, e FROM base UNION ALL SELECT doc_id, kind, s, e FROM extra),
named AS (SELECT *, {list(pii.ALL_KINDS)}[kind + 1] || ':' || s || ':' || e AS one FROM every),
per AS (
    SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_email, count(*) FILTER (WHERE kind = 1) AS n_ip,
        count(*) FILTER (WHERE kind = 2) AS n_card, count(*) FILTER (WHERE kind = 3) AS n_phone,
        count(*) FILTER (WHERE kind > 3) AS n_terms,
        coalesce(string_agg(one, ',' ORDER BY s, kind, e) FILTER (WHERE kind < 4), '') AS base_text,
        string_agg(one, ',' ORDER BY s, kind, e) AS spans
    FROM named GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
    coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base_text, '')) AS base_sha256, coalesce(spans, '') AS spans,
    coalesce(n_terms, 0) AS n_terms
FROM t LEFT JOIN per USING (doc_id)
"""

COLLOCATIONS = r"""
WITH pieces AS MATERIALIZED (
    SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS w
    FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
rows_of AS (SELECT lang, p, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM pieces),
x AS MATERIALIZED (
    SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4
    FROM rows_of WINDOW o AS (PARTITION BY p ORDER BY i)),
f AS MATERIALIZED (
    SELECT lang, [w1] AS ws, count(*) AS n FROM x GROUP BY ALL
    UNION ALL SELECT lang, [w1, w2], count(*) AS n FROM x WHERE w2 IS NOT NULL GROUP BY ALL HAVING n >= 30
    UNION ALL SELECT lang, [w1, w2, w3], count(*) AS n FROM x WHERE w3 IS NOT NULL GROUP BY ALL HAVING n >= 30
    UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) AS n FROM x WHERE w4 IS NOT NULL GROUP BY ALL HAVING n >= 30),
inside AS (
    SELECT lang, ws[i:i + k - 1] AS ws, max(n) AS longer
    FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS i
          FROM (SELECT *, unnest(range(2, len(ws))) AS k FROM f WHERE len(ws) > 2))
    GROUP BY ALL),
kept AS (
    SELECT f.lang, f.ws, f.n AS a FROM f LEFT JOIN inside USING (lang, ws)
    WHERE len(f.ws) > 1 AND NOT coalesce(100 * inside.longer >= 80 * f.n, false)),
cuts AS (
    SELECT c.lang, c.ws, c.a, c.k, l.n AS l, r.n AS r, (2000000::HUGEINT * c.a) // (l.n + r.n) AS score
    FROM (SELECT *, unnest(range(1, len(ws))) AS k FROM kept) c
    JOIN f l ON l.lang = c.lang AND l.ws = c.ws[1:c.k] JOIN f r ON r.lang = c.lang AND r.ws = c.ws[c.k + 1:len(c.ws)]),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
sizes AS (SELECT lang, count(*) AS n FROM x GROUP BY lang),
spelt AS (SELECT lang, array_to_string(ws, ' ') AS phrase, a, l, r, score FROM lowest)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
       sizes.n, score::BIGINT AS score
FROM spelt JOIN sizes USING (lang) QUALIFY rank <= 2000
"""
