"""One DuckDB statement per query, written against the driver tables only."""

from __future__ import annotations

GENES = ["A", "B", "C", "DRB1", "DQA1", "DQB1", "DPA1", "DPB1"]
NULLS = "('', 'NA', '-', 'nan', 'None', '.', 'na')"
READER_NA = ("('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', "
             "'1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')")
QC = ["alignment_rate_pct", "quality_score", "mrna_pct", "ribosomal_pct", "insert_size"]
CLUSTERS = [("A", 29941260, 29949606), ("B_C", 31268746, 31367067),
            ("DR_DQ", 32577902, 32668383), ("DP", 33064569, 33091655)]

ORACLE: dict[str, str] = {}


def body(c: str) -> str:
    return (f"(CASE WHEN contains(trim({c}), '*') THEN substr(trim({c}), strpos(trim({c}), '*') + 1) "
            f"ELSE trim({c}) END)")


def is_na(c: str) -> str:
    return f"({c} IS NULL OR trim({c}) IN {NULLS})"


def cut2(c: str, n: int = 2, nulls: str | None = None) -> str:
    """n-field key, null for null tokens and shallower calls."""
    test = nulls or is_na(c)
    parts = f"str_split({body(c)}, ':')"
    return (f"(CASE WHEN {test} OR len({parts}) < {n} THEN NULL "
            f"ELSE array_to_string({parts}[1:{n}], ':') END)")


def any_case_na(c: str) -> str:
    return f"({c} IS NULL OR lower(trim({c})) IN ('', 'na', 'nan', 'none', '-', '.'))"


def two(c: str) -> str:
    return cut2(c, 2, any_case_na(c))


def fields(c: str, cut: bool = True) -> str:
    """Non-empty fields as a list, cut before the first "new"; null when nothing is left."""
    lst = f"list_filter(str_split({body(c)}, ':'), lambda f: f <> '')"
    if cut:
        pos = f"list_position(list_transform({lst}, lambda f: lower(trim(f))), 'new')"
        lst = f"(CASE WHEN coalesce({pos}, 0) > 0 THEN ({lst})[1:{pos} - 1] ELSE {lst} END)"
    return f"(CASE WHEN {is_na(c)} OR len({lst}) = 0 THEN NULL ELSE {lst} END)"


def tri(a: str, b: str, level: str) -> str:
    """1 true, 0 false, null not assessable, of two field lists at one level."""
    d = f"least(len({a}), len({b}))"
    return (f"(CASE WHEN {a}[1:least({level}, {d})] <> {b}[1:least({level}, {d})] THEN 0 "
            f"WHEN {level} <= {d} THEN 1 ELSE NULL END)")


def score(a1: str, b1: str, a2: str, b2: str) -> str:
    return " + ".join(
        f"{w} * (coalesce({tri(a1, b1, str(k))}, 0) + coalesce({tri(a2, b2, str(k))}, 0))"
        for k, w in ((1, 1000), (2, 100), (3, 10), (4, 1)))


# ---- views derived from the driver tables ----

GENE_VALUES = ", ".join(f"({i}, '{g}')" for i, g in enumerate(GENES))
BASE = f"""
genes(g, gene) AS (VALUES {GENE_VALUES}),
persons AS (
  SELECT o_orderkey AS person_id, o_custkey AS cust, r_name AS ancestry,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS case_
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
idx AS (
  SELECT person_id, cust, ancestry, case_, g, gene,
         (((person_id*(7+2*g) + cust*(3+g)) % 97) * ((person_id*(7+2*g) + cust*(3+g)) % 97)) % 24 AS i1,
         (((person_id*(11+2*g) + cust*(5+g) + 13) % 97)
          * ((person_id*(11+2*g) + cust*(5+g) + 13) % 97)) % 24 AS i2
  FROM persons CROSS JOIN genes),
hap AS (
  SELECT *, lpad(CAST(1 + i1 // 4 AS VARCHAR), 2, '0') AS f1,
         lpad(CAST(1 + i2 // 4 AS VARCHAR), 2, '0') AS f2,
         lpad(CAST(1 + i1 // 4 AS VARCHAR), 2, '0') || ':'
           || lpad(CAST(1 + i1 % 4 AS VARCHAR), 2, '0') AS h1,
         lpad(CAST(1 + i2 // 4 AS VARCHAR), 2, '0') || ':'
           || lpad(CAST(1 + i2 % 4 AS VARCHAR), 2, '0') AS h2
  FROM idx)"""


def base_calls(q: str) -> tuple[str, str]:
    one = (f"CASE {q} WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN h1 "
           f"ELSE gene || '*' || h1 || ':01' END")
    other = (f"CASE {q} WHEN 3 THEN 'nan' WHEN 4 THEN gene || '*' || f2 "
             f"WHEN 5 THEN gene || '*' || h1 || ':01' WHEN 6 THEN gene || '*' || f2 || ':97' "
             f"ELSE gene || '*' || h2 || ':01' END")
    return one, other


_C1, _C2 = base_calls("(person_id*37 + g*11) % 19")
CALLSET = f"""{BASE},
callset AS (SELECT person_id, ancestry, case_, gene, {_C1} AS a1, {_C2} AS a2 FROM hap)"""

_L1, _L2 = base_calls("(person_id*37 + g*11 + v) % 19")
LOG = f"""{BASE},
log AS (
  SELECT person_id, gene, v, ts, CASE WHEN v % 3 = 0 THEN 'pilot' ELSE 'main' END AS run_label,
    {_L1} AS base_1, {_L2} AS base_2,
    gene || '*' || h2 || CASE WHEN (person_id*31 + g*17 + v) % 20 < 3 THEN '' ELSE ':01' END AS sr_1,
    CASE WHEN (person_id*31 + g*17 + v) % 20 = 7 THEN gene || '*88:01'
         WHEN (person_id*31 + g*17 + v) % 20 IN (5, 6) THEN gene || '*' || f1 || ':99:01'
         ELSE gene || '*' || h1 || ':01' END AS sr_2,
    CASE WHEN (person_id*13 + g*7) % 23 = 0 THEN 'NA' ELSE gene || '*' || h1 || ':01' ||
         CASE WHEN (person_id*13 + g*7) % 23 < 6 THEN ':new'
              WHEN (person_id*13 + g*7) % 23 < 12 THEN ':01' ELSE '' END END AS lr_1,
    CASE WHEN (person_id*13 + g*7) % 23 = 1 THEN '-' ELSE gene || '*' || h2 || ':01:02' END AS lr_2,
    CASE WHEN (person_id*37 + g*11 + v) % 19 <> 7
         THEN CAST(1 AS DOUBLE) - CAST((person_id*17 + g*3) % 100 AS DOUBLE) / CAST(10000 AS DOUBLE)
         END AS id1,
    CAST(1 AS DOUBLE) - CAST((person_id*19 + g*5) % 80 AS DOUBLE) / CAST(10000 AS DOUBLE) AS id2,
    (person_id + g) % 11 = 0 AS tied1, (person_id*3 + g) % 29 = 0 AS tied2
  FROM (SELECT hap.*, l_linenumber AS v, l_shipdate AS ts
        FROM lineitem JOIN hap ON l_orderkey = person_id)),
latest AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT log.*, row_number() OVER (PARTITION BY person_id, gene ORDER BY ts DESC, v DESC) AS rn
    FROM log WHERE run_label = 'main') WHERE rn = 1),
rows_ AS (SELECT latest.*, persons.ancestry FROM latest LEFT JOIN persons USING (person_id))"""

ASM = """
asm AS (
  SELECT person_id, gene,
    CASE z WHEN 1 THEN 'NA' WHEN 2 THEN gene || '*' || f1 || ':new' WHEN 3 THEN gene || '*new'
      ELSE gene || '*' || h1 || ':01:01' END AS asm_1,
    CASE WHEN z IN (1, 4) THEN 'NA' WHEN z = 5 THEN gene || '*' || f2 || ':98:01:01'
      ELSE gene || '*' || h2 || ':01:02' END AS asm_2
  FROM (SELECT *, (person_id*41 + g*13) % 17 AS z FROM hap) WHERE z <> 0)"""

ANNOT = """
annot AS (
  SELECT person_id, gene, h AS hap,
    CASE WHEN (person_id*5 + g + h) % 43 = 0 THEN NULL
         ELSE CAST((person_id*23 + g*h) % 6 AS DOUBLE) END AS dist,
    (person_id*7 + g + h) % 31 = 0 AS warned
  FROM persons CROSS JOIN genes CROSS JOIN (VALUES (1), (2)) AS t(h)
  WHERE (person_id + g*5 + h) % 37 <> 0)"""

EVIDENCE = f"""{LOG}, {ASM}, {ANNOT},
ev AS (
  SELECT r.*, a.asm_1, a.asm_2, w.d, coalesce(w.warn, false) AS warn,
    CASE WHEN id1 IS NULL OR id2 IS NULL THEN NULL ELSE least(id1, id2) END AS worst,
    tied1 OR tied2 AS tied
  FROM rows_ r LEFT JOIN asm a USING (person_id, gene)
  LEFT JOIN (SELECT person_id, gene, max(dist) AS d, bool_or(warned) AS warn FROM annot
             GROUP BY 1, 2) w USING (person_id, gene)),
flags AS (
  SELECT *, coalesce(NOT tied AND worst >= CAST(0.9945 AS DOUBLE), false) AS lr_ok,
    coalesce(NOT warn AND d <= 2, false) AS asm_ok,
    {fields('lr_1')} IS NOT NULL AND {fields('lr_2')} IS NOT NULL AS lr_res,
    {fields('asm_1')} IS NOT NULL AND {fields('asm_2')} IS NOT NULL AS asm_res
  FROM ev)"""


def casc(source: str, keys: str, c1: str, c2: str, t1: str, t2: str, cut: bool) -> str:
    """CTE text `states`: keys, level and the states s1, s2 of both alleles, best pairing."""
    return f"""
lists AS (SELECT {keys}, {fields(c1, cut)} AS x1, {fields(c2, cut)} AS x2,
                 {fields(t1, cut)} AS y1, {fields(t2, cut)} AS y2 FROM {source}),
whole AS (SELECT * FROM lists WHERE x1 IS NOT NULL AND x2 IS NOT NULL
          AND y1 IS NOT NULL AND y2 IS NOT NULL),
paired AS (SELECT *, ({score('x1', 'y2', 'x2', 'y1')}) > ({score('x1', 'y1', 'x2', 'y2')}) AS crossed
           FROM whole),
states AS (SELECT {keys}, lvl,
   CASE WHEN crossed THEN {tri('x1', 'y2', 'lvl')} ELSE {tri('x1', 'y1', 'lvl')} END AS s1,
   CASE WHEN crossed THEN {tri('x2', 'y1', 'lvl')} ELSE {tri('x2', 'y2', 'lvl')} END AS s2
   FROM paired CROSS JOIN (VALUES (1), (2), (3), (4)) AS l(lvl))"""


def methods(source: str, extra: str) -> str:
    return f"""
stacked AS (
  SELECT {extra}, 'base' AS method, base_1 AS c1, base_2 AS c2 FROM {source}
  UNION ALL SELECT {extra}, 'sr', sr_1, sr_2 FROM {source})"""


COUNTS = """CAST(sum(coalesce(s1, 0) + coalesce(s2, 0)) AS BIGINT) AS n_true,
  count(*) FILTER (WHERE s1 = 0) + count(*) FILTER (WHERE s2 = 0) AS n_false,
  count(*) FILTER (WHERE s1 IS NULL) + count(*) FILTER (WHERE s2 IS NULL) AS n_na"""
MATCH = "round(100.0 * n_true / nullif(n_true + n_false, 0), 6) AS match_pct"
NA_PCT = "round(100.0 * n_na / nullif(n_true + n_false + n_na, 0), 6) AS na_pct"


def lr_counts(keys: str) -> str:
    return (f"WITH {LOG}, {methods('rows_', 'gene, ancestry, lr_1, lr_2')}, "
            f"{casc('stacked', 'gene, ancestry, method', 'c1', 'c2', 'lr_1', 'lr_2', False)}, "
            f"counts AS (SELECT {keys}, lvl AS field_level, {COUNTS} FROM states GROUP BY {keys}, lvl)")


ORACLE["cascade_counts"] = f"""{lr_counts('gene, ancestry, method')} SELECT * FROM counts"""
ORACLE["field2_concordance_gene_ancestry"] = f"""{lr_counts('gene, ancestry, method')}
SELECT * EXCLUDE (field_level), {MATCH}, {NA_PCT} FROM counts WHERE field_level = 2"""
ORACLE["cascade_pooled"] = f"""{lr_counts('gene, method')},
depth AS (SELECT method, greatest(max(len({fields('c1', False)})), max(len({fields('c2', False)}))) AS m
          FROM stacked GROUP BY 1)
SELECT counts.*, {MATCH}, {NA_PCT}, CAST(m AS INTEGER) AS max_depth, field_level > m AS structural_cap
FROM counts JOIN depth USING (method)"""
ORACLE["field2_matrix"] = f"""{lr_counts('gene, ancestry, method')}
SELECT gene, method, {', '.join(
    f'''max(round(100.0 * n_true / nullif(n_true + n_false, 0), 6))
        FILTER (WHERE ancestry = '{r}') AS "{r}"'''
    for r in ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'))}
FROM counts WHERE field_level = 2 GROUP BY gene, method"""
ORACLE["method_max_depth"] = f"""WITH {LOG}, s AS (
  SELECT 'base' AS method, unnest([base_1, base_2]) AS c FROM rows_
  UNION ALL SELECT 'sr', unnest([sr_1, sr_2]) FROM rows_
  UNION ALL SELECT 'lr', unnest([lr_1, lr_2]) FROM rows_)
SELECT method, CAST(coalesce(max(len({fields('c')})), 0) AS INTEGER) AS max_depth FROM s GROUP BY 1"""
ORACLE["cascade_vs_assembly"] = f"""WITH {LOG}, {ASM},
src AS (SELECT r.*, asm_1, asm_2 FROM rows_ r JOIN asm USING (person_id, gene)),
{methods('src', 'gene, asm_1, asm_2')},
{casc('stacked', 'gene, method', 'c1', 'c2', 'asm_1', 'asm_2', True)},
counts AS (SELECT gene, method, lvl AS field_level, {COUNTS} FROM states GROUP BY ALL)
SELECT *, {MATCH}, {NA_PCT} FROM counts"""
ORACLE["truth_lookup_misses"] = f"""WITH {LOG}, {ASM}
SELECT r.gene, count(*) AS n_rows, count(*) FILTER (WHERE asm_1 IS NULL) AS n_without_truth
FROM rows_ r LEFT JOIN asm USING (person_id, gene) GROUP BY 1"""

ORACLE["threeway_concordance"] = f"""WITH {LOG},
k AS (SELECT gene, ancestry, id1, id2, tied1, tied2,
  {', '.join(f"{cut2(f'{m}_{h}')} AS {m}{h}" for m in ('base', 'sr', 'lr') for h in (1, 2))} FROM rows_),
s AS (SELECT *, list_sort([base1, base2]) AS a, list_sort([sr1, sr2]) AS b, list_sort([lr1, lr2]) AS c,
  base1 IS NOT NULL AND base2 IS NOT NULL AND sr1 IS NOT NULL AND sr2 IS NOT NULL
    AND lr1 IS NOT NULL AND lr2 IS NOT NULL AS ok,
  NOT tied1 AND NOT tied2 AND coalesce(id1 >= CAST(0.99 AS DOUBLE), false)
    AND id2 >= CAST(0.99 AS DOUBLE) AS sure FROM k)
SELECT gene, ancestry, count(*) AS n, count(*) FILTER (WHERE ok) AS callable_n,
  count(*) FILTER (WHERE ok AND a = b AND b = c) AS agree3,
  count(*) FILTER (WHERE ok AND a = b) AS a_b, count(*) FILTER (WHERE ok AND a = c) AS a_c,
  count(*) FILTER (WHERE ok AND b = c) AS b_c,
  count(*) FILTER (WHERE ok AND b = c AND a <> b) AS a_lone,
  count(*) FILTER (WHERE ok AND a = b AND c <> b) AS c_diverges,
  count(*) FILTER (WHERE ok AND a = b AND c <> b AND sure) AS c_diverges_confident
FROM s GROUP BY 1, 2"""

ORACLE["resolution_tiers"] = f"""WITH {LOG},
k AS (SELECT gene, {', '.join(f"{cut2(f'{m}_{h}')} AS {m}{h}" for m in ('base', 'sr', 'lr') for h in (1, 2))}
      FROM rows_),
ok AS (SELECT * FROM k WHERE base1 IS NOT NULL AND base2 IS NOT NULL AND sr1 IS NOT NULL
       AND sr2 IS NOT NULL AND lr1 IS NOT NULL AND lr2 IS NOT NULL),
st AS (SELECT gene, 'base' AS method, base1 AS c1, base2 AS c2, lr1 AS t1, lr2 AS t2 FROM ok
       UNION ALL SELECT gene, 'sr', sr1, sr2, lr1, lr2 FROM ok),
kind AS (SELECT *, CASE WHEN c1 = t1 THEN 2 WHEN split_part(c1, ':', 1) = split_part(t1, ':', 1) THEN 1 ELSE 0 END AS k11,
  CASE WHEN c2 = t2 THEN 2 WHEN split_part(c2, ':', 1) = split_part(t2, ':', 1) THEN 1 ELSE 0 END AS k22,
  CASE WHEN c1 = t2 THEN 2 WHEN split_part(c1, ':', 1) = split_part(t2, ':', 1) THEN 1 ELSE 0 END AS k12,
  CASE WHEN c2 = t1 THEN 2 WHEN split_part(c2, ':', 1) = split_part(t1, ':', 1) THEN 1 ELSE 0 END AS k21 FROM st),
best AS (SELECT *, ((k12 = 2)::INT + (k21 = 2)::INT) * 10 + (k12 > 0)::INT + (k21 > 0)::INT
  > ((k11 = 2)::INT + (k22 = 2)::INT) * 10 + (k11 > 0)::INT + (k22 > 0)::INT AS crossed FROM kind),
tier AS (SELECT gene, method, CASE WHEN crossed THEN k12 ELSE k11 END AS p,
                CASE WHEN crossed THEN k21 ELSE k22 END AS q FROM best)
SELECT coalesce(gene, 'ALL') AS gene, method, count(*) AS callable_n,
  count(*) FILTER (WHERE p = 2 AND q = 2) AS n_exact,
  count(*) FILTER (WHERE least(p, q) = 1) AS n_close,
  count(*) FILTER (WHERE least(p, q) = 0 AND greatest(p, q) > 0) AS n_partial_miss,
  count(*) FILTER (WHERE greatest(p, q) = 0) AS n_full_miss
FROM tier GROUP BY GROUPING SETS ((gene, method), (method))"""

PAIRS = f"""{LOG}, {ASM},
pairs AS (SELECT p.person_id, p.ancestry, genes.gene, asm_1, asm_2, lr_1, lr_2, id1, id2,
            tied1, tied2, l.person_id IS NOT NULL AS has_log
  FROM persons p CROSS JOIN genes
  LEFT JOIN asm ON asm.person_id = p.person_id AND asm.gene = genes.gene
  LEFT JOIN latest l ON l.person_id = p.person_id AND l.gene = genes.gene)"""
STATUS = ("CASE WHEN s1 = 0 OR s2 = 0 THEN 'discordant' WHEN s1 IS NULL OR s2 IS NULL THEN 'na' "
          "ELSE 'concordant' END")
REASON = f"""CASE WHEN {is_na('asm_1')} AND {is_na('asm_2')} AND {is_na('lr_1')} AND {is_na('lr_2')} THEN 'both_na'
  WHEN {is_na('asm_1')} AND {is_na('asm_2')} THEN 'asm_na_lr_resolved'
  WHEN {is_na('lr_1')} AND {is_na('lr_2')} THEN 'lr_na_asm_resolved'
  WHEN {is_na('asm_1')} <> {is_na('asm_2')} OR {is_na('lr_1')} <> {is_na('lr_2')} THEN 'one_haplotype_na'
  ELSE 'both_resolved' END"""

ORACLE["genotype_status_rollup"] = f"""WITH {PAIRS},
{casc('pairs', 'gene, ancestry', 'asm_1', 'asm_2', 'lr_1', 'lr_2', True)},
c AS (SELECT gene, lvl AS field_level, coalesce(ancestry, 'ALL') AS ancestry,
  count(*) FILTER (WHERE {STATUS} = 'concordant') AS concordant,
  count(*) FILTER (WHERE {STATUS} = 'discordant') AS discordant
  FROM states GROUP BY GROUPING SETS ((gene, lvl, ancestry), (gene, lvl)))
SELECT *, concordant + discordant AS assessable,
  round(100.0 * concordant / nullif(concordant + discordant, 0), 6) AS concordant_pct FROM c"""
ORACLE["unresolved_reasons"] = f"""WITH {PAIRS}, r AS (SELECT gene, {REASON} AS reason FROM pairs)
SELECT reason, coalesce(gene, 'ALL') AS gene, count(*) AS n
FROM r GROUP BY GROUPING SETS ((gene, reason), (reason))"""
ORACLE["concordance_detail"] = f"""WITH {PAIRS},
{casc('pairs', 'person_id, gene', 'asm_1', 'asm_2', 'lr_1', 'lr_2', True)}
SELECT p.person_id, p.ancestry, p.gene, coalesce(asm_1, 'NA') AS asm_1, coalesce(asm_2, 'NA') AS asm_2,
  coalesce(lr_1, 'NA') AS lr_1, coalesce(lr_2, 'NA') AS lr_2,
  CASE WHEN NOT has_log THEN 'no_lr_row' WHEN id1 IS NULL OR id2 IS NULL THEN 'unknown'
    WHEN tied1 OR tied2 THEN 'ambiguous(tied)'
    WHEN least(id1, id2) >= CAST(0.99 AS DOUBLE) THEN 'confident' ELSE 'lower_identity' END AS confidence,
  {REASON} AS reason,
  CASE WHEN {REASON} <> 'both_resolved' THEN '-' WHEN s.lvl IS NULL THEN 'unresolved(allele-level)'
    ELSE {STATUS} END AS field2_status
FROM pairs p LEFT JOIN (SELECT * FROM states WHERE lvl = 2) s
  ON s.person_id = p.person_id AND s.gene = p.gene"""

HAPROWS = """
hrows AS (
  SELECT person_id, gene, ch, g, gene || '*' || CASE WHEN ch = 1 THEN h1 ELSE h2 END || ':01' AS c1,
         gene || '*' || CASE WHEN ch = 1 THEN h1 ELSE h2 END || ':02' AS c2
  FROM hap CROSS JOIN (VALUES (1), (2)) AS t(ch) WHERE NOT (ch = 2 AND (person_id + g) % 29 = 0)),
hpar AS (
  SELECT person_id, gene, ch AS hap,
    CASE (person_id + g*3 + ch) % 7 WHEN 0 THEN c1 WHEN 1 THEN c2 ELSE c1 END AS call,
    (person_id*5 + g) % 9 AS m, c1, c2,
    CAST((person_id + g*ch) % 50 + 10 AS INTEGER) AS reads,
    CAST(CASE (person_id*3 + g + ch) % 4 WHEN 0 THEN 1 WHEN 2 THEN 3 ELSE 2 END AS INTEGER) AS ambig_n,
    CASE WHEN (person_id + ch) % 3 = 0 THEN 'NA' ELSE 'known' END AS step1,
    count(*) OVER (PARTITION BY person_id, gene) AS n
  FROM hrows),
parsed AS (
  SELECT person_id, gene, hap, call,
    CASE WHEN m = 0 THEN NULL WHEN m = 3 AND call = c2 THEN 0.9::DOUBLE WHEN m = 3 THEN NULL
      WHEN m = 1 AND call = c1 THEN 0.995::DOUBLE WHEN m = 1 THEN 0.99::DOUBLE
      WHEN m = 2 AND call = c1 THEN 0.999::DOUBLE WHEN m = 2 THEN 0.98::DOUBLE
      WHEN call = c1 THEN 1.0::DOUBLE ELSE 0.97::DOUBLE END AS identity,
    reads, ambig_n, m = 1 AS tied, step1
  FROM hpar WHERE n >= 2)"""
ORACLE["caller_haplotypes"] = f"""WITH {BASE}, {HAPROWS}
SELECT * REPLACE (CAST(hap AS INTEGER) AS hap) FROM parsed"""
ORACLE["call_matrix"] = f"""WITH {LOG}, {HAPROWS}
SELECT p.person_id, genes.gene, {', '.join(f"coalesce(l.{c}, 'NA') AS {c}" for c in ('base_1', 'base_2', 'sr_1', 'sr_2'))},
  coalesce(x.call, 'NA') AS lr_call_1, coalesce(y.call, 'NA') AS lr_call_2,
  {', '.join(f'x.{e} AS lr_{e}_1, y.{e} AS lr_{e}_2' for e in ('identity', 'reads', 'ambig_n', 'tied', 'step1'))}
FROM persons p CROSS JOIN genes
LEFT JOIN latest l ON l.person_id = p.person_id AND l.gene = genes.gene
LEFT JOIN parsed x ON x.person_id = p.person_id AND x.gene = genes.gene AND x.hap = 1
LEFT JOIN parsed y ON y.person_id = p.person_id AND y.gene = genes.gene AND y.hap = 2"""
ORACLE["call_completeness"] = f"""WITH {CALLSET}
SELECT person_id, CAST(sum((NOT {is_na('a1')})::INT + (NOT {is_na('a2')})::INT) AS BIGINT) AS called_slots,
  count(*) FILTER (WHERE NOT {is_na('a1')} OR NOT {is_na('a2')}) AS called_genes
FROM callset GROUP BY 1"""
ORACLE["latest_calls"] = f"""WITH {LOG} SELECT person_id, gene, v, sr_1, sr_2, ancestry FROM rows_"""
ORACLE["requested_calls"] = f"""WITH {BASE}, {ASM}
SELECT p.person_id, genes.gene, coalesce(asm_1, 'NA') AS asm_1, coalesce(asm_2, 'NA') AS asm_2
FROM persons p CROSS JOIN genes LEFT JOIN asm ON asm.person_id = p.person_id AND asm.gene = genes.gene
WHERE p.person_id % 7 <> 3"""
ORACLE["missing_people"] = f"""WITH {BASE}
SELECT person_id, ancestry FROM persons WHERE person_id NOT IN
  (SELECT l_orderkey FROM lineitem WHERE l_linenumber % 3 = 0)"""
ORACLE["na_slots"] = f"""WITH {BASE}, {ASM},
who AS (SELECT DISTINCT person_id FROM asm)
SELECT genes.gene, CAST(sum(({fields('asm_1')} IS NULL)::INT + ({fields('asm_2')} IS NULL)::INT) AS BIGINT) AS na_slots,
  2 * count(*) AS total_slots,
  round(100.0 * sum(({fields('asm_1')} IS NULL)::INT + ({fields('asm_2')} IS NULL)::INT) / (2 * count(*)), 6) AS na_pct
FROM who CROSS JOIN genes LEFT JOIN asm ON asm.person_id = who.person_id AND asm.gene = genes.gene GROUP BY 1"""
ORACLE["config_comparison"] = f"""WITH {LOG},
per AS (SELECT person_id, gene, run_label, {cut2('sr_1')} AS k1, {cut2('sr_2')} AS k2 FROM (
  SELECT *, row_number() OVER (PARTITION BY person_id, gene, run_label ORDER BY ts DESC, v DESC) AS rn
  FROM log) WHERE rn = 1),
j AS (SELECT a.run_label, a.gene, CASE WHEN a.k1 IS NULL OR a.k2 IS NULL THEN NULL ELSE list_sort([a.k1, a.k2]) END AS x,
  CASE WHEN b.k1 IS NULL OR b.k2 IS NULL THEN NULL ELSE list_sort([b.k1, b.k2]) END AS y
  FROM per a JOIN per b ON a.person_id = b.person_id AND a.gene = b.gene
  WHERE b.run_label = 'main' AND a.run_label <> 'main')
SELECT run_label, gene, count(*) AS n_slots, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS n_compared,
  count(*) FILTER (WHERE x = y) AS n_same,
  round(count(*) FILTER (WHERE x = y) / nullif(count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL), 0)::DOUBLE, 6) AS same_share
FROM j GROUP BY 1, 2"""

# ---- callset ----

MISS = f"(a1 IS NULL OR a1 IN {READER_NA})", f"(a2 IS NULL OR a2 IN {READER_NA})"


def missingness(keys: str) -> str:
    m1, m2 = MISS
    return f"""SELECT {keys}, count(*) AS n_total,
  count(*) FILTER (WHERE {m1} OR {m2}) AS n_missing_either,
  count(*) FILTER (WHERE {m1} AND {m2}) AS n_missing_both,
  count(*) FILTER (WHERE NOT {m1} AND NOT {m2} AND a1 = a2) AS n_homozygous,
  count(*) FILTER (WHERE NOT {m1} AND NOT {m2}) AS n_resolved,
  round(100.0 * count(*) FILTER (WHERE {m1} OR {m2}) / count(*), 6) AS missing_either_pct,
  round(100.0 * count(*) FILTER (WHERE {m1} AND {m2}) / count(*), 6) AS missing_both_pct,
  round(100.0 * count(*) FILTER (WHERE NOT {m1} AND NOT {m2} AND a1 = a2)
    / nullif(count(*) FILTER (WHERE NOT {m1} AND NOT {m2}), 0), 6) AS homozygosity_pct
FROM callset GROUP BY {keys}"""


ORACLE["locus_missingness"] = f"WITH {CALLSET} {missingness('gene')}"
ORACLE["group_missingness"] = f"WITH {CALLSET} {missingness('gene, ancestry')}"
ORACLE["hardest_loci"] = f"""WITH {CALLSET}, m AS (
  SELECT gene, 100.0::DOUBLE * count(*) FILTER (WHERE {MISS[0]} OR {MISS[1]}) / count(*) AS p FROM callset GROUP BY 1)
SELECT round(avg(p) FILTER (WHERE gene IN ('DRB1', 'DPB1')), 6) AS hardest_pct,
  round(avg(p) FILTER (WHERE gene NOT IN ('DRB1', 'DPB1')), 6) AS others_pct,
  avg(p) FILTER (WHERE gene IN ('DRB1', 'DPB1')) > avg(p) FILTER (WHERE gene NOT IN ('DRB1', 'DPB1')) AS hardest_is_worse
FROM m"""
ORACLE["depth_distribution"] = f"""WITH {CALLSET}, s AS (
  SELECT gene, CAST(len(str_split(unnest([a1, a2]), ':')) AS INTEGER) AS depth FROM callset
  WHERE NOT {MISS[0]} AND NOT {MISS[1]})
SELECT gene, depth, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY gene), 6) AS share_pct
FROM s GROUP BY 1, 2"""
ORACLE["fully_resolved"] = f"""WITH {CALLSET}, p AS (
  SELECT person_id, bool_and(NOT {MISS[0]} AND NOT {MISS[1]}) AS ok FROM callset GROUP BY 1)
SELECT count(*) AS n_people, count(*) FILTER (WHERE ok) AS n_fully_resolved,
  round(100.0 * count(*) FILTER (WHERE ok) / count(*), 6) AS fully_resolved_pct FROM p"""
ORACLE["group_composition"] = f"""WITH {BASE}, l AS (
  SELECT CASE WHEN person_id % 9 <> 0 THEN ancestry END AS ancestry FROM persons)
SELECT ancestry, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS n_pct FROM l GROUP BY 1"""
ORACLE["matched_people"] = f"""WITH {BASE}
SELECT count(*) FILTER (WHERE person_id % 9 <> 0) AS n_matched, count(*) AS n_total FROM persons"""
ORACLE["genotypes_wide"] = f"""WITH {CALLSET} SELECT person_id, {', '.join(
    f"max(a{h}) FILTER (WHERE gene = '{g}') AS {g}_{h}" for g in GENES for h in (1, 2))}
FROM callset GROUP BY 1"""
ORACLE["genotypes_unpivot"] = f"WITH {CALLSET} SELECT person_id, gene, a1, a2 FROM callset"

ALLELES = f"""{CALLSET},
two AS (SELECT person_id, gene, ancestry, {two('a1')} AS k1, {two('a2')} AS k2 FROM callset),
ok AS (SELECT * FROM two WHERE k1 IS NOT NULL AND k2 IS NOT NULL),
al AS (SELECT gene, ancestry, unnest([k1, k2]) AS allele FROM ok)"""
FREQ = f"""{ALLELES},
freq AS (SELECT gene, ancestry, allele, count(*) AS n,
  count(*) / sum(count(*)) OVER (PARTITION BY gene, ancestry)::DOUBLE AS freq,
  CAST(sum(count(*)) OVER (PARTITION BY gene, ancestry) // 2 AS BIGINT) AS n_individuals
  FROM al GROUP BY 1, 2, 3)"""
GFREQ = f"""{ALLELES},
freq AS (SELECT gene, allele, count(*) AS n,
  count(*) / sum(count(*)) OVER (PARTITION BY gene)::DOUBLE AS freq,
  CAST(sum(count(*)) OVER (PARTITION BY gene) // 2 AS BIGINT) AS n_individuals FROM al GROUP BY 1, 2)"""
ORACLE["allele_frequency"] = f"WITH {FREQ} SELECT * REPLACE (round(freq, 6) AS freq) FROM freq"
ORACLE["allele_diversity"] = f"""WITH {GFREQ} SELECT gene, max(n_individuals) AS n_callable, count(*) AS n_distinct,
  count(*) FILTER (WHERE freq < CAST(0.01 AS DOUBLE)) AS n_rare,
  round(count(*) FILTER (WHERE freq < CAST(0.01 AS DOUBLE)) / count(*)::DOUBLE, 6) AS rare_share
FROM freq GROUP BY 1"""
ORACLE["hwe_proxy"] = f"""WITH {ALLELES},
g2 AS (SELECT gene, ancestry, k1, k2 FROM ok UNION ALL SELECT gene, 'ALL', k1, k2 FROM ok),
c AS (SELECT gene, ancestry, allele, count(*) AS n FROM (
  SELECT gene, ancestry, unnest([k1, k2]) AS allele FROM g2) GROUP BY 1, 2, 3),
e AS (SELECT gene, ancestry, sum(power(n / t::DOUBLE, 2)) AS exp_hom, count(*) AS n_distinct FROM (
  SELECT *, sum(n) OVER (PARTITION BY gene, ancestry) AS t FROM c) GROUP BY 1, 2),
o AS (SELECT gene, ancestry, count(*) AS n_individuals, avg((k1 = k2)::INT) AS obs_hom FROM g2 GROUP BY 1, 2)
SELECT gene, ancestry, n_individuals, round(obs_hom, 6) AS obs_hom, round(exp_hom, 6) AS exp_hom, n_distinct,
  round(obs_hom / exp_hom, 6) AS obs_over_exp FROM o JOIN e USING (gene, ancestry)"""
ORACLE["top_alleles"] = f"""WITH {GFREQ} SELECT gene, CAST(rank AS INTEGER) AS rank, allele, n, round(freq, 6) AS freq FROM (
  SELECT *, row_number() OVER (PARTITION BY gene ORDER BY n DESC, allele) AS rank FROM freq) WHERE rank <= 5"""
ORACLE["homozygosity_matrix"] = f"""WITH {CALLSET}, m AS ({missingness('gene, ancestry')})
SELECT gene, {', '.join(f"max(homozygosity_pct) FILTER (WHERE ancestry = '{r}') AS \"{r}\""
    for r in ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'))} FROM m GROUP BY 1"""
ORACLE["homozygous_locus_count"] = f"""WITH {CALLSET}
SELECT person_id, count(*) FILTER (WHERE NOT {MISS[0]} AND NOT {MISS[1]} AND a1 = a2) AS n_homozygous
FROM callset GROUP BY 1"""
ORACLE["pca_points"] = """SELECT vec_id, label,
  CASE WHEN vec_id % 7 <> 0 THEN round(CAST(embedding[1] AS DOUBLE), 4) END AS pc1,
  CASE WHEN vec_id % 7 <> 0 THEN round(CAST(embedding[2] AS DOUBLE), 4) END AS pc2 FROM embeddings"""

# ---- confidence ----

LABEL = """CASE WHEN id1 IS NULL OR id2 IS NULL THEN 'unknown' WHEN tied1 OR tied2 THEN 'ambiguous(tied)'
  WHEN least(id1, id2) >= CAST(0.99 AS DOUBLE) THEN 'confident' ELSE 'lower_identity' END"""
ORACLE["confidence_labels"] = f"""WITH {LOG} SELECT gene, {LABEL} AS label, count(*) AS n FROM rows_ GROUP BY 1, 2"""
ORACLE["annotation_summary"] = f"""WITH {BASE}, {ANNOT} SELECT gene, count(dist) AS n_distance,
  round(avg(dist), 6) AS mean_distance, count(*) FILTER (WHERE warned) AS n_warned FROM annot GROUP BY 1"""
VALUES_ID = f"""{LOG}, vals AS (SELECT gene, least(id1, id2) AS value FROM rows_
  WHERE NOT (tied1 OR tied2) AND id1 IS NOT NULL AND id2 IS NOT NULL)"""


def sweep(thresholds, op: str) -> str:
    rows = ", ".join(f"(CAST({t} AS DOUBLE))" for t in thresholds)
    return f"""SELECT gene, count(*) AS n_values, threshold, count(*) FILTER (WHERE value {op} threshold) AS n_excluded,
  round(100.0 * count(*) FILTER (WHERE value {op} threshold) / count(*), 6) AS excluded_pct
FROM vals CROSS JOIN (VALUES {rows}) AS t(threshold) GROUP BY gene, threshold"""


ORACLE["identity_sweep"] = f"WITH {VALUES_ID} {sweep(['0.999', '0.995', '0.99', '0.95', '0.9', '0.8'], '<')}"
ORACLE["distance_sweep"] = f"""WITH {BASE}, {ANNOT}, vals AS (SELECT * FROM (
  SELECT gene, max(dist) AS value FROM annot GROUP BY person_id, gene) WHERE value IS NOT NULL)
{sweep(['0', '1', '2', '3', '5'], '>')}"""
ORACLE["upper_median"] = f"""WITH {VALUES_ID} SELECT gene, count(*) AS n_values,
  round(list_sort(list(value))[count(*) // 2 + 1], 6) AS median FROM vals GROUP BY 1"""
SCORES = f"""{EVIDENCE},
scores AS (
  SELECT person_id, gene, 'lr' AS tool, lr_ok AS passes, worst AS score FROM flags WHERE lr_res
  UNION ALL SELECT person_id, gene, 'asm', asm_ok, -d FROM flags WHERE asm_res),
lim AS (SELECT least(count(*) FILTER (WHERE tool = 'lr'), count(*) FILTER (WHERE tool = 'asm')) AS n
        FROM scores WHERE passes),
ranked AS (SELECT person_id, gene, tool, score,
  row_number() OVER (PARTITION BY tool ORDER BY score DESC, person_id, gene) AS rank FROM scores WHERE passes),
kept AS (SELECT ranked.* FROM ranked CROSS JOIN lim WHERE rank <= n)"""
ORACLE["rank_trim_match"] = f"WITH {SCORES} SELECT * REPLACE (round(score, 6) AS score) FROM kept"
ORACLE["rank_trim_selection"] = f"WITH {SCORES} SELECT person_id, gene, tool, round(score, 6) AS score FROM kept"
ORACLE["retention_stages"] = f"""WITH {SCORES}, s AS (
  SELECT tool, coalesce(x.gene, 'ALL') AS gene, count(*) AS all_resolved,
    count(*) FILTER (WHERE passes) AS after_threshold, count(k.rank) AS after_matching
  FROM scores x LEFT JOIN kept k USING (person_id, gene, tool)
  GROUP BY GROUPING SETS ((tool, x.gene), (tool))), slots AS (SELECT 8 * count(*) AS n FROM persons)
SELECT s.*, {', '.join(f'round(100.0 * {c} / n, 6) AS {c}_slot_pct' for c in ('all_resolved', 'after_threshold', 'after_matching'))}
FROM s CROSS JOIN slots"""


def matched_part(tool: str) -> str:
    return f"""
u{tool} AS (SELECT f.*, k.rank IS NOT NULL AS m FROM flags f
  LEFT JOIN (SELECT * FROM kept WHERE tool = '{tool}') k USING (person_id, gene)),
v{tool} AS (SELECT gene, 'unfiltered' AS scenario, base_1, base_2, sr_1, sr_2, {tool}_1 AS t1, {tool}_2 AS t2 FROM u{tool}
  UNION ALL SELECT gene, 'matched', base_1, base_2, sr_1, sr_2, {tool}_1, {tool}_2 FROM u{tool} WHERE m)"""


ORACLE["confidence_matched_rates"] = f"""WITH {SCORES}, {matched_part('lr')}, {matched_part('asm')},
src AS (SELECT 'lr' AS truth, * FROM vlr UNION ALL SELECT 'asm', * FROM vasm),
{methods('src', 'truth, scenario, gene, t1, t2')},
{casc('stacked', 'truth, scenario, gene, method', 'c1', 'c2', 't1', 't2', True)},
counts AS (SELECT truth, scenario, gene, method, lvl AS field_level, {COUNTS} FROM states WHERE lvl <= 2 GROUP BY ALL)
SELECT *, {MATCH}, {NA_PCT} FROM counts"""
ORACLE["confidence_before_after"] = f"""WITH {EVIDENCE},
{casc('flags', 'gene, lr_ok, asm_ok', 'asm_1', 'asm_2', 'lr_1', 'lr_2', True)},
s AS (SELECT gene, lr_ok, asm_ok, {STATUS} AS st FROM states WHERE lvl = 2),
c AS (SELECT coalesce(gene, 'ALL') AS gene, count(*) AS n_resolved, count(*) FILTER (WHERE lr_ok) AS n_lr_confident,
  count(*) FILTER (WHERE asm_ok) AS n_asm_confident, count(*) FILTER (WHERE lr_ok AND asm_ok) AS n_both_confident,
  count(*) FILTER (WHERE st = 'concordant') AS concordant_before, count(*) FILTER (WHERE st = 'discordant') AS discordant_before,
  count(*) FILTER (WHERE lr_ok AND asm_ok AND st = 'concordant') AS concordant_after,
  count(*) FILTER (WHERE lr_ok AND asm_ok AND st = 'discordant') AS discordant_after
  FROM s GROUP BY GROUPING SETS ((gene), ()))
SELECT *, round(100.0 * concordant_before / nullif(concordant_before + discordant_before, 0), 6) AS pct_before,
  round(100.0 * concordant_after / nullif(concordant_after + discordant_after, 0), 6) AS pct_after FROM c"""

# ---- catalogue ----

CATALOGUE = f"""{CALLSET},
seen AS (SELECT DISTINCT g, gene, unnest([i1, i2]) AS i FROM hap),
cat AS (
  SELECT 'HLA' || lpad(CAST(g*1000 + i*10 + k AS VARCHAR), 5, '0') AS allele_id, gene,
    lpad(CAST(1 + i // 4 AS VARCHAR), 2, '0') || ':'
      || lpad(CAST(1 + i % 4 + CASE WHEN k = 3 THEN 10 ELSE 0 END AS VARCHAR), 2, '0')
      || ':0' || CAST(k AS VARCHAR) || ':01' AS allele_full,
    2000 + (i*7 + k*3 + g) % 16 * 100 AS first_release
  FROM seen CROSS JOIN (VALUES (1), (2), (3)) AS t(k) WHERE (i*5 + g) % 13 <> 0),
obs AS (
  SELECT DISTINCT gene, 2 AS field_level, allele FROM (SELECT gene, unnest([{cut2('a1')}, {cut2('a2')}]) AS allele FROM callset)
  WHERE allele IS NOT NULL
  UNION ALL
  SELECT DISTINCT gene, 3, allele FROM (SELECT gene, unnest([{cut2('a1', 3)}, {cut2('a2', 3)}]) AS allele FROM callset)
  WHERE allele IS NOT NULL),
named AS (
  SELECT DISTINCT gene, 2 AS field_level, array_to_string(str_split(allele_full, ':')[1:2], ':') AS allele FROM cat
  UNION ALL SELECT DISTINCT gene, 3, array_to_string(str_split(allele_full, ':')[1:3], ':') FROM cat)"""
ORACLE["catalogue_coverage"] = f"""WITH {CATALOGUE},
c AS (SELECT gene, field_level, count(*) AS n_catalogued FROM named GROUP BY 1, 2),
o AS (SELECT gene, field_level, count(*) AS n_observed FROM obs GROUP BY 1, 2),
b AS (SELECT gene, field_level, count(*) AS n_common FROM obs JOIN named USING (gene, field_level, allele) GROUP BY 1, 2)
SELECT gene, field_level, n_catalogued, n_observed, coalesce(n_common, 0) AS n_common,
  n_observed - coalesce(n_common, 0) AS n_observed_not_catalogued,
  round(100.0 * coalesce(n_common, 0) / n_catalogued, 6) AS coverage_pct
FROM c JOIN o USING (gene, field_level) LEFT JOIN b USING (gene, field_level)"""
ORACLE["uncatalogued_alleles"] = f"""WITH {CATALOGUE} SELECT * FROM obs WHERE field_level = 2
  AND (gene, allele) NOT IN (SELECT (gene, allele) FROM named WHERE field_level = 2)"""
CARRIERS = f"""
car AS (SELECT DISTINCT person_id, gene, ancestry, unnest([{cut2('a1')}, {cut2('a2')}]) AS group_2field FROM callset),
per AS (SELECT gene, group_2field, ancestry, count(*) AS n FROM car WHERE group_2field IS NOT NULL GROUP BY 1, 2, 3),
carriers AS (SELECT gene, group_2field, CAST(sum(n) AS BIGINT) AS n_individuals,
  list(ancestry ORDER BY n DESC, ancestry)[1] AS dominant_ancestry,
  round(100.0 * max(n) / sum(n), 6) AS dominant_share_pct FROM per GROUP BY 1, 2)"""
ORACLE["allele_tree"] = f"""WITH {CATALOGUE}, {CARRIERS},
kids AS (SELECT gene, array_to_string(str_split(allele, ':')[1:2], ':') AS group_2field,
  count(*) FILTER (WHERE src = 'c') AS c3, count(*) FILTER (WHERE src = 'o') AS o3 FROM (
  SELECT gene, allele, 'c' AS src FROM named WHERE field_level = 3
  UNION ALL SELECT gene, allele, 'o' FROM obs WHERE field_level = 3) GROUP BY 1, 2)
SELECT o.gene, o.allele AS group_2field, coalesce(c3, 0) AS catalogued_3field, coalesce(o3, 0) AS observed_3field,
  n_individuals, dominant_ancestry, dominant_share_pct
FROM obs o LEFT JOIN kids k ON k.gene = o.gene AND k.group_2field = o.allele
LEFT JOIN carriers c ON c.gene = o.gene AND c.group_2field = o.allele WHERE o.field_level = 2"""
ORACLE["tree_summary"] = f"""WITH {CALLSET}, {CARRIERS} SELECT * REPLACE (CAST(rank AS INTEGER) AS rank) FROM (
  SELECT *, row_number() OVER (PARTITION BY gene ORDER BY n_individuals DESC, group_2field) AS rank FROM carriers)
WHERE rank <= 15"""
ORACLE["fold_tail"] = f"""WITH {CALLSET}, {CARRIERS} SELECT gene,
  CASE WHEN rn <= 6 THEN group_2field ELSE 'other' END AS segment, CAST(sum(n_individuals) AS BIGINT) AS n_individuals FROM (
  SELECT *, row_number() OVER (PARTITION BY gene ORDER BY n_individuals DESC, group_2field) AS rn FROM carriers)
GROUP BY 1, 2"""
RELEASES = """
rel AS (SELECT gene, array_to_string(str_split(allele_full, ':')[1:2], ':') AS group_2field,
        CAST(min(first_release) AS INTEGER) AS release FROM cat GROUP BY 1, 2)"""
ORACLE["group_releases"] = f"WITH {CATALOGUE}, {RELEASES} SELECT * FROM rel"
ORACLE["release_lower_bound"] = f"""WITH {CATALOGUE}, {RELEASES}
SELECT max(release) AS release, count(*) AS n_groups,
  CAST(max(release) // 1000 AS VARCHAR) || '.' || lpad(CAST(max(release) % 1000 // 10 AS VARCHAR), 2, '0')
  || '.' || CAST(max(release) % 10 AS VARCHAR) AS release_name
FROM rel JOIN obs ON obs.gene = rel.gene AND obs.allele = rel.group_2field WHERE field_level = 2"""
ORACLE["enriched_dominance"] = f"""WITH {FREQ},
x AS (SELECT *, freq * 2 * n_individuals >= 20 AS enough, sum(freq) OVER (PARTITION BY gene, allele) AS total,
  bool_or(freq * 2 * n_individuals >= 20) OVER (PARTITION BY gene, allele) AS any_ok FROM freq),
y AS (SELECT *, row_number() OVER (PARTITION BY gene, allele ORDER BY freq DESC, ancestry) AS rn
      FROM x WHERE enough OR NOT any_ok)
SELECT gene, allele, ancestry AS dominant_ancestry, round(100 * freq, 6) AS dominant_freq_pct,
  round(100 * freq / total, 6) AS relative_share_pct, NOT any_ok AS low_confidence FROM y WHERE rn = 1"""
ORACLE["relative_prevalence"] = f"""WITH {FREQ},
t AS (SELECT gene, allele, row_number() OVER (PARTITION BY gene ORDER BY round(sum(freq * 2 * n_individuals), 3) DESC, allele) AS rank
      FROM freq GROUP BY 1, 2),
w AS (SELECT f.gene, f.allele, CAST(rank AS INTEGER) AS rank, sum(freq) AS total, {', '.join(
    f'''coalesce(sum(freq) FILTER (WHERE ancestry = '{r}'), 0) AS "{r}"'''
    for r in ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'))}
  FROM freq f JOIN t USING (gene, allele) WHERE rank <= 12 GROUP BY f.gene, f.allele, rank)
SELECT gene, allele, rank, {', '.join(f'round(100 * "{r}" / total, 6) AS "{r}"'
    for r in ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'))} FROM w"""
ORACLE["top_within_group"] = f"""WITH {FREQ} SELECT gene, ancestry, allele, n, round(freq, 6) AS freq, n_individuals,
  CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY gene, ancestry ORDER BY n DESC, allele) AS rank FROM freq) WHERE rank <= 5"""

# ---- manifests ----


def _uri(name: str, mod: int, ending: str) -> str:
    m = f"(part*3 + supp + v*{mod}) % 11"
    stem = "'pooled/' || person_id || '_' || v"
    tail = f"{stem} || '.{name}{ending}'"
    return (f"CASE {m} WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'gs://legacy-fixture/' || {tail} "
            f"WHEN 3 THEN 'gs://other-bucket/' || {tail} WHEN 4 THEN {tail} "
            f"ELSE 'gs://fixture-bucket/' || {tail} END")


COLS = [("main_bam", "main", 1, ".bam"), ("tagged_bam", "tagged", 2, ".bam"), ("hap1_fa", "hap1", 3, ".fa.gz"),
        ("hap2_fa", "hap2", 3, ".FA.gz"), ("hap1_paf", "hap1", 5, ".paf"), ("hap2_paf", "hap2", 6, ".paf")]
MANIFEST = f"""{BASE},
man AS (
  SELECT person_id * 10 + v AS row_id, person_id, v, part, supp, 'C' || (supp % 4) AS center,
    ['revio', 'sequel2e', 'sequel2', 'ont'][part % 4 + 1] AS platform,
    {', '.join(f'{_uri(n, m, e)} AS {c}' for c, n, m, e in COLS)},
    {_uri('main', 1, '.bam.bai')} AS main_bam_index,
    CASE WHEN part % 2 = 0 THEN 'batch ' || supp END AS note
  FROM (SELECT l_orderkey AS person_id, l_linenumber AS v, max(l_partkey) AS part, max(l_suppkey) AS supp
        FROM lineitem GROUP BY 1, 2)),
cells AS ({' UNION ALL '.join(f"SELECT row_id, person_id, {i} AS prio, '{c}' AS source, {c} AS uri FROM man" for i, (c, *_) in enumerate(COLS))}),
listed AS (SELECT DISTINCT regexp_replace(uri, '^gs://fixture-bucket/', '') AS path FROM cells
  WHERE uri <> '' AND (length(uri) + row_id) % 5 <> 0),
found AS (SELECT *, regexp_replace(uri, '^gs://fixture-bucket/', '') AS path FROM cells
  WHERE uri <> '' AND NOT contains(uri, 'legacy-fixture')
  AND NOT starts_with(regexp_replace(uri, '^gs://fixture-bucket/', ''), 'gs://')
  AND regexp_replace(uri, '^gs://fixture-bucket/', '') IN (SELECT path FROM listed)),
usable AS (SELECT m.row_id, m.person_id, m.center, m.platform, f.source, f.path FROM man m LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY prio) AS rn FROM found
                 WHERE source IN ('main_bam', 'tagged_bam')) WHERE rn = 1) f USING (row_id)),
onerow AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY center, platform, row_id) AS rn
           FROM usable WHERE path IS NOT NULL) WHERE rn = 1),
cram AS (SELECT person_id, CASE WHEN person_id % 13 = 0 THEN NULL ELSE 'cram/' || person_id || '.cram' END AS cram_path
         FROM persons WHERE person_id % 7 <> 3),
eligible AS (SELECT o.person_id, p.ancestry, cram_path, o.path AS lr_path, source
  FROM onerow o JOIN cram USING (person_id) JOIN persons p USING (person_id) WHERE cram_path IS NOT NULL)"""
ORACLE["source_counts"] = f"""WITH {MANIFEST} SELECT coalesce(source, 'no_existing_file_found') AS source,
  count(*) AS n_rows FROM usable GROUP BY 1"""
ORACLE["usable_files"] = f"WITH {MANIFEST} SELECT person_id, row_id, source, path FROM onerow"
ORACLE["eligible_people"] = f"WITH {MANIFEST} SELECT * FROM eligible"
ORACLE["cohort_pick"] = f"""WITH {MANIFEST} SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY ancestry ORDER BY person_id) AS rn FROM eligible
  WHERE ancestry IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST')) WHERE rn <= 10"""
ORACLE["cohort_availability"] = f"""WITH {MANIFEST} SELECT w.ancestry, count(e.person_id) AS n_eligible,
  least(count(e.person_id), 1500) AS n_picked, count(e.person_id) < 1500 AS short
FROM (VALUES ('AFRICA'), ('AMERICA'), ('ASIA'), ('EUROPE'), ('MIDDLE EAST'), ('NOWHERE')) AS w(ancestry) LEFT JOIN eligible e USING (ancestry) GROUP BY 1"""
ORACLE["labels_outside"] = f"""WITH {MANIFEST} SELECT DISTINCT ancestry FROM eligible
WHERE ancestry NOT IN ('AFRICA', 'AMERICA', 'ASIA')"""
SETS = f"""{MANIFEST},
memb AS (SELECT person_id, bool_or(s = 's') AS has_srwgs, bool_or(s = 'l') AS has_lrwgs, bool_or(s = 'r') AS has_rnaseq FROM (
  SELECT person_id, 's' AS s FROM cram UNION ALL SELECT person_id, 'l' FROM onerow
  UNION ALL SELECT l_orderkey, 'r' FROM lineitem WHERE l_partkey % 5 <> 0 AND l_partkey % 5 < 4) GROUP BY 1)"""
ORACLE["overlap_flags"] = f"WITH {SETS} SELECT * FROM memb"
ORACLE["venn_regions"] = f"WITH {SETS} SELECT has_srwgs, has_lrwgs, has_rnaseq, count(*) AS n FROM memb GROUP BY 1, 2, 3"
ORACLE["venn_totals"] = f"""WITH {SETS} SELECT count(*) FILTER (WHERE has_srwgs) AS total_srwgs,
  count(*) FILTER (WHERE has_lrwgs) AS total_lrwgs, count(*) FILTER (WHERE has_rnaseq) AS total_rnaseq, count(*) AS total_any,
  count(*) FILTER (WHERE has_rnaseq AND has_lrwgs) AS rnaseq_and_lrwgs,
  count(*) FILTER (WHERE has_rnaseq AND (has_srwgs OR has_lrwgs)) AS rnaseq_and_either FROM memb"""
ORACLE["id_set_difference"] = f"""WITH {BASE}, a AS (SELECT person_id FROM persons WHERE person_id % 7 <> 3),
b AS (SELECT DISTINCT l_orderkey AS person_id FROM lineitem)
SELECT person_id, 'manifest' AS only_in FROM a WHERE person_id NOT IN (SELECT person_id FROM b)
UNION ALL SELECT person_id, 'metadata' FROM b WHERE person_id NOT IN (SELECT person_id FROM a)"""
ORACLE["venn_bitmaps"], ORACLE["difference_bitmaps"] = ORACLE["venn_regions"], ORACLE["id_set_difference"]
PROG = f"""{BASE}, {ASM},
done AS (SELECT person_id FROM asm WHERE gene = 'A'), gone AS (SELECT person_id FROM asm WHERE gene = 'B' AND asm_1 = 'NA')"""
ORACLE["group_progress"] = f"""WITH {PROG} SELECT ancestry, count(*) AS n_total,
  count(*) FILTER (WHERE person_id IN (SELECT person_id FROM done)) AS n_done FROM persons GROUP BY 1"""
ORACLE["run_totals"] = f"""WITH {PROG}, f AS (SELECT person_id IN (SELECT person_id FROM done) AS d,
  person_id IN (SELECT person_id FROM gone) AS g FROM persons)
SELECT count(*) FILTER (WHERE d) AS n_done, count(*) FILTER (WHERE g AND NOT d) AS n_given_up,
  count(*) FILTER (WHERE NOT d AND NOT g) AS n_remaining FROM f"""
ORACLE["resume_worklist"] = f"""WITH {PROG} SELECT person_id, ancestry FROM persons
WHERE person_id NOT IN (SELECT person_id FROM done) AND person_id NOT IN (SELECT person_id FROM gone)"""
ORACLE["upsert_by_key"] = f"""WITH {BASE}, {ASM} SELECT person_id, gene,
  CASE WHEN person_id % 5 = 0 THEN 'updated' ELSE asm_1 END AS asm_1, asm_2 FROM asm"""
ORACLE["compact_fragments"] = f"""WITH {LOG} SELECT person_id, gene, v, sr_1, sr_2 FROM (
  SELECT *, row_number() OVER (PARTITION BY person_id, gene ORDER BY v DESC, sr_1 DESC, sr_2 DESC) AS rn FROM log) WHERE rn = 1"""
TEXTS = ["center", "platform", "main_bam", "tagged_bam", "main_bam_index", "hap1_fa", "hap2_fa", "hap1_paf", "hap2_paf", "note"]
ORACLE["column_report"] = f"""WITH {MANIFEST},
tall AS ({' UNION ALL '.join(f"SELECT '{c}' AS column_, row_id, {c} AS value FROM man WHERE {c} <> ''" for c in TEXTS)}),
k AS (SELECT column_, count(*) AS n_filled, arg_min(value, row_id) AS sample_value,
  count(*) FILTER (WHERE contains(value, '/') AND regexp_matches(lower(value), '[.](bam|fa[.]gz|paf)$')) AS p,
  count(*) FILTER (WHERE contains(value, '/') AND regexp_matches(lower(value), '[.]bai$')) AS x
  FROM tall GROUP BY 1)
SELECT column_ AS "column", n_filled, sample_value,
  CASE WHEN p >= greatest(1, n_filled // 2) THEN 'primary' WHEN x >= greatest(1, n_filled // 2) THEN 'index' END AS kind FROM k"""
PROFILES = f"""{MANIFEST},
prof AS (SELECT m.row_id, m.person_id, m.platform, m.v, coalesce(string_agg(source, '+' ORDER BY source), 'NONE_FOUND') AS profile,
  coalesce(list(source) FILTER (WHERE source IS NOT NULL), []) AS present
  FROM man m LEFT JOIN found f USING (row_id) GROUP BY 1, 2, 3, 4)"""
ORACLE["manifest_profiles"] = f"WITH {PROFILES} SELECT row_id, person_id, profile FROM prof"
ORACLE["profile_distribution"] = f"""WITH {PROFILES} SELECT profile, count(*) AS n,
  round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS n_pct FROM prof GROUP BY 1"""
ORACLE["profile_by_platform"] = f"""WITH {PROFILES}, c AS (SELECT platform, profile, count(*) AS n,
  round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS n_pct FROM prof GROUP BY 1, 2)
SELECT * FROM c ORDER BY n DESC, platform, profile LIMIT 40"""
ORACLE["union_profile"] = f"""WITH {MANIFEST},
u AS (SELECT person_id, string_agg(source, '+' ORDER BY source) AS profile FROM (SELECT DISTINCT person_id, source FROM found) GROUP BY 1)
SELECT m.person_id, count(*) AS n_rows, coalesce(max(u.profile), 'NONE_FOUND') AS profile
FROM man m LEFT JOIN u USING (person_id) GROUP BY 1"""
ORACLE["multi_row_people"] = f"""WITH {MANIFEST} SELECT person_id, count(*) AS n_rows FROM man GROUP BY 1 HAVING count(*) > 1"""
ORACLE["none_found_by_platform"] = f"""WITH {MANIFEST},
l AS (SELECT person_id, list(platform ORDER BY row_id)[1] AS platform FROM man GROUP BY 1)
SELECT platform, count(*) AS n FROM l WHERE person_id NOT IN (SELECT person_id FROM found) GROUP BY 1"""
BEST = f"""{PROFILES},
rowtier AS (SELECT *, CASE WHEN NOT list_has_all(present, ['hap1_fa', 'hap2_fa']) THEN NULL
  WHEN list_has_all(present, ['hap1_paf', 'hap2_paf']) THEN 1 WHEN list_has_all(present, ['main_bam', 'tagged_bam']) THEN 2
  ELSE 3 END AS t FROM prof WHERE platform <> 'ont'),
best AS (SELECT person_id, list(platform ORDER BY row_id)[1] AS platform, count(*) AS n_rows,
  ['paf_region', 'bam_whole_contig', 'self_align_needed'][min(t)] AS trim_tier FROM rowtier GROUP BY 1)"""
ORACLE["seeded_sample"] = f"""WITH {BASE} SELECT person_id, ancestry FROM persons
ORDER BY md5('42:' || person_id), person_id LIMIT 500"""
ORACLE["best_tier"] = f"WITH {BEST} SELECT * FROM best"
ORACLE["tier_group_distribution"] = f"""WITH {BEST}, x AS (SELECT coalesce(CASE WHEN p.person_id % 9 <> 0 THEN ancestry END, 'NA') AS ancestry
  FROM best b LEFT JOIN persons p USING (person_id) WHERE trim_tier = 'self_align_needed')
SELECT ancestry, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS n_pct FROM x GROUP BY 1"""
ORACLE["phase_split"] = f"""WITH {BEST} SELECT CASE WHEN trim_tier = 'self_align_needed' THEN 2 ELSE 1 END AS phase,
  trim_tier, count(*) AS n FROM best GROUP BY 1, 2"""
ORACLE["eligible_head"] = f"""WITH {BEST} SELECT * FROM best WHERE trim_tier IS NOT NULL ORDER BY person_id LIMIT 100"""

# ---- metrics ----

RNA = """rna AS (SELECT l_orderkey AS person_id, l_linenumber AS v,
  CASE WHEN l_partkey % 17 <> 0 THEN l_quantity * 2 END AS alignment_rate_pct,
  CASE WHEN l_partkey % 19 <> 1 THEN l_discount * 100 END AS quality_score,
  CASE WHEN l_suppkey % 11 <> 2 THEN l_tax * 100 + l_partkey % 7 END AS mrna_pct,
  CASE WHEN l_suppkey % 23 <> 3 THEN l_extendedprice END AS ribosomal_pct,
  CASE WHEN l_partkey % 29 <> 4 THEN l_quantity + l_suppkey % 5 END AS insert_size,
  CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_partkey % 5 < 4 THEN 'Pass' ELSE 'Fail' END AS status FROM lineitem)"""
TALL = f"""{RNA}, tall AS ({' UNION ALL '.join(f"SELECT '{c}' AS metric, {c} AS value FROM rna" for c in QC)})"""
ORACLE["qc_missingness"] = f"""WITH {TALL} SELECT metric, count(*) - count(value) AS n_missing, count(*) AS n_rows,
  round(100.0 * (count(*) - count(value)) / count(*), 6) AS missing_pct FROM tall GROUP BY 1"""
ORACLE["qc_value_counts"] = f"WITH {RNA} SELECT status, count(*) AS n FROM rna GROUP BY 1"
ORACLE["qc_describe"] = f"""WITH {TALL} SELECT metric, count(value) AS n, round(avg(value), 6) AS mean,
  round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max,
  round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
  round(quantile_cont(value, 0.75), 6) AS p75 FROM tall GROUP BY 1"""
ORACLE["qc_describe_sketch"] = f"""WITH {TALL} SELECT metric, count(value) AS n, round(min(value), 6) AS min, round(max(value), 6) AS max,
  true AS p25_near, true AS p50_near, true AS p75_near, true AS distinct_near FROM tall GROUP BY 1"""
ORACLE["qc_correlation"] = f"""WITH {RNA} {' UNION ALL '.join(
    f"SELECT '{a}' AS metric_a, '{b}' AS metric_b, round(corr({a}, {b}), 6) AS r FROM rna" for a in QC for b in QC)}"""
ORACLE["qc_target_correlation"] = f"""WITH {RNA}, j AS (SELECT a.insert_size AS t, b.* FROM rna a JOIN rna b
  ON a.person_id = b.person_id AND a.v = b.v)
{' UNION ALL '.join(f"SELECT '{c}' AS metric, round(corr(t, {e}), 6) AS r FROM j" for c, e in
    [(c, c) for c in QC[:4]] + [('mrna_ratio', 'mrna_pct / nullif(ribosomal_pct, 0)')])}"""
ORACLE["qc_histogram"] = f"""WITH {TALL}, r AS (SELECT metric, min(value) AS lo, max(value) AS hi FROM tall GROUP BY 1),
b AS (SELECT metric, CAST(least(floor((value - lo) / (hi - lo) * 40), 39) AS INTEGER) AS bin, lo, hi FROM tall JOIN r USING (metric)
      WHERE value IS NOT NULL)
SELECT metric, bin, round(min(lo) + (min(hi) - min(lo)) * bin / 40, 6) AS bin_start, count(*) AS n FROM b GROUP BY 1, 2"""
TIMING = f"""{BASE}, st AS (
  SELECT person_id, h, (person_id + h) % 23 <> 0 AS a, (person_id + h) % 19 <> 1 AS b, (person_id*h + cust) % 17 <> 2 AS c,
    ((person_id*3 + h) % 50) / CAST(10 AS DOUBLE) AS l, ((person_id*7 + cust) % 300) / CAST(10 AS DOUBLE) AS t,
    ((person_id*11 + cust*3 + h) % 9000) / CAST(10 AS DOUBLE) AS n
  FROM persons CROSS JOIN (VALUES (1), (2)) AS t(h)),
tim AS (SELECT person_id, CASE WHEN a THEN l END AS look, CASE WHEN a AND b THEN t END AS trim_,
  CASE WHEN a AND b AND c THEN n END AS note FROM st)"""
ORACLE["duration_stats"] = f"""WITH {TIMING}, x AS (SELECT 'lookup_seconds' AS metric, look AS value FROM tim
  UNION ALL SELECT 'trim_seconds', trim_ FROM tim UNION ALL SELECT 'annotate_seconds', note FROM tim)
SELECT metric, count(value) AS n, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max,
  count(*) FILTER (WHERE value < 30) AS n_short, round(quantile_cont(value, 0.5), 6) AS median FROM x GROUP BY 1"""
ORACLE["stage_counts"] = f"""WITH {TIMING} SELECT CASE WHEN note IS NOT NULL THEN 'reached_annotation'
  WHEN trim_ IS NOT NULL THEN 'failed_at_trim' WHEN look IS NOT NULL THEN 'failed_after_lookup'
  ELSE 'failed_at_target_finding' END AS stage, count(*) AS n FROM tim GROUP BY 1"""
ORACLE["finished_halves"] = f"""WITH {TIMING} SELECT halves_done, count(*) AS n_people FROM (
  SELECT person_id, count(note) AS halves_done FROM tim GROUP BY 1) GROUP BY 1"""
PROBE = """probe AS (SELECT [4, 8, 16][user_id % 3 + 1] AS concurrency, CAST(user_id % 2 + 1 AS INTEGER) AS threads,
  CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS sec, (event_type = 'error')::INT AS failed, value % 100 AS mem FROM events),
thr AS (SELECT concurrency, threads, CAST(max(sec) - min(sec) AS DOUBLE) AS wall_seconds, count(*) AS n_people,
  CAST(sum(failed) AS BIGINT) AS n_failed, max(mem) AS mem_peak_pct, avg(mem) AS mem_mean_pct FROM probe GROUP BY 1, 2)"""
ORACLE["throughput_summary"] = f"""WITH {PROBE} SELECT * REPLACE (round(mem_peak_pct, 6) AS mem_peak_pct, round(mem_mean_pct, 6) AS mem_mean_pct),
  round(wall_seconds / n_people, 6) AS seconds_per_person, round(n_people * 3600.0 / wall_seconds, 6) AS people_per_hour FROM thr"""
ORACLE["results_migration"] = f"""WITH {PROBE} SELECT concurrency, threads AS threads_per_person, concurrency * threads AS total_cores,
  wall_seconds, round(mem_peak_pct, 6) AS mem_used_peak_pct,
  round(CASE WHEN threads = 1 THEN mem_peak_pct ELSE mem_mean_pct END, 6) AS mem_used_mean_pct FROM thr"""

# ---- intervals ----

PAF = """paf AS (SELECT 'ctg' || (l_orderkey % 1000) AS qname, 200000 AS qlen, (l_partkey*37 + l_suppkey*11) % 90000 AS qstart,
  (l_partkey*37 + l_suppkey*11) % 90000 + CAST(l_quantity AS BIGINT) * 900 AS qend,
  CASE WHEN l_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
  CASE l_partkey % 10 WHEN 0 THEN '6' WHEN 1 THEN 'chr7' ELSE 'chr6' END AS tname,
  29400000 + (l_partkey*2111 + l_suppkey*53) % 4300000 AS tstart,
  29400000 + (l_partkey*2111 + l_suppkey*53) % 4300000 + CAST(l_quantity AS BIGINT) * 900 + l_partkey % 3 AS tend,
  CAST(l_quantity AS BIGINT) * 900 - l_suppkey % 50 * 10 AS matches,
  CAST(l_quantity AS BIGINT) * 900 + l_partkey % 3 AS block_len FROM lineitem)"""
CLUSTER_VALUES = ", ".join(f"('{n}', {s}, {e})" for n, s, e in CLUSTERS)


def islands(source: str, key: str, gap: int) -> str:
    """source has key, s, e."""
    return f"""
isl1 AS (SELECT *, max(e) OVER (PARTITION BY {key} ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
isl2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + {gap} THEN 1 ELSE 0 END)
  OVER (PARTITION BY {key} ORDER BY s, e DESC ROWS UNBOUNDED PRECEDING) AS island FROM isl1)"""


ORACLE["merged_blocks"] = f"""WITH {PAF}, src AS (SELECT tname AS contig, tstart AS s, tstart + matches % 700 + 20 AS e FROM paf),
{islands('src', 'contig', 1)}
SELECT contig, min(s) AS start, max(e) AS "end", count(*) AS n_intervals FROM isl2 GROUP BY contig, island"""
ORACLE["target_names"] = f"""WITH {PAF} SELECT tname, replace(tname, 'chr', '') AS contig, count(*) AS n_blocks FROM paf GROUP BY 1, 2"""
SPANS = f"""{PAF}, spans AS (SELECT qname, min(greatest(0, qstart - 10000)) AS span_start, max(least(qlen, qend + 10000)) AS span_end,
  CAST(max(qlen) AS BIGINT) AS qlen, count(*) AS n_blocks FROM paf
  WHERE tname IN ('6', 'chr6') AND tend > 29500000 AND tstart < 33500000 GROUP BY 1)"""
ORACLE["contig_spans"] = f"""WITH {SPANS} SELECT *, qname || ':' || (span_start + 1) || '-' || span_end AS region FROM spans"""
ORACLE["reduction_report"] = f"""WITH {SPANS} SELECT count(*) AS n_contigs, CAST(sum(qlen) AS BIGINT) AS whole_bp,
  CAST(sum(span_end - span_start) AS BIGINT) AS kept_bp, round(100 - 100.0 * sum(span_end - span_start) / sum(qlen), 6) AS smaller_pct FROM spans"""
ORACLE["clustered_spans"] = f"""WITH {PAF}, src AS (SELECT qname, qstart AS s, qend AS e, block_len FROM paf
  WHERE block_len >= 9000 AND matches >= block_len * CAST(0.985 AS DOUBLE)),
{islands('src', 'qname', 2000)},
c AS (SELECT qname, min(s) AS span_start, max(e) AS span_end, CAST(sum(block_len) AS BIGINT) AS aligned_bp, count(*) AS n_blocks
  FROM isl2 GROUP BY qname, island HAVING sum(block_len) >= 20000)
SELECT *, row_number() OVER (PARTITION BY qname ORDER BY aligned_bp DESC, span_start) = 1 AS is_main FROM c"""
ORACLE["window_overlap"] = f"""WITH {PAF}, w(name, s, e) AS (VALUES {CLUSTER_VALUES})
SELECT name, count(*) AS n_blocks, CAST(sum(least(tend, e + 20000) - greatest(tstart, s - 20000)) AS BIGINT) AS overlap_bp
FROM paf JOIN w ON tname IN ('6', 'chr6') AND tend > s - 20000 AND tstart < e + 20000 GROUP BY 1"""


ORACLE["contig_overlap"] = f"""WITH {PAF},
x AS (SELECT qname, CASE WHEN qstart % 97 = 0 THEN 0 ELSE qstart END AS s, CASE WHEN qstart % 97 = 0 THEN qlen ELSE qend END AS e FROM paf),
y AS (SELECT 'ctg' || (l_partkey % 1000) AS qname, (l_partkey*41 + l_suppkey*13) % 200000 AS s FROM lineitem)
SELECT x.qname, count(*) AS n_pairs, CAST(sum(least(e, y.s + 150) - greatest(x.s, y.s)) AS BIGINT) AS overlap_bp
FROM x JOIN y ON x.qname = y.qname AND e > y.s AND x.s < y.s + 150 GROUP BY 1"""


def interp(ref: str) -> str:
    frac = f"(least(greatest({ref}, tstart), tend) - tstart) / CAST(greatest(1, tend - tstart) AS DOUBLE)"
    return f"(CASE WHEN strand = '+' THEN qstart + {frac} * (qend - qstart) ELSE qend - {frac} * (qend - qstart) END)"


def span_sql(by: str) -> str:
    p, q = interp("greatest(tstart, ws)"), interp("least(tend, we)")
    return f"""SELECT {by} qname, min(greatest(0, CAST(floor(least({p}, {q})) AS BIGINT))) AS span_start,
  max(least(qlen, CAST(round_even(greatest({p}, {q}), 0) AS BIGINT))) AS span_end, CAST(max(qlen) AS BIGINT) AS qlen
FROM paf JOIN win ON tname IN ('6', 'chr6') AND tend > ws AND tstart < we GROUP BY {by} qname"""


ORACLE["window_spans"] = f"""WITH {PAF}, c(name, s, e) AS (VALUES {CLUSTER_VALUES}),
win AS (SELECT greatest(0, s - 5000) AS ws, e + 5000 AS we FROM c) {span_sql('')}"""
ORACLE["config_sweep"] = f"""WITH {PAF}, c(name, s, e) AS (VALUES {CLUSTER_VALUES}),
win AS (SELECT 'pad_100k' AS config, greatest(0, s - 100000) AS ws, e + 100000 AS we FROM c
  UNION ALL SELECT 'pad_5k', greatest(0, s - 5000), e + 5000 FROM c UNION ALL SELECT 'pad_0', s, e FROM c
  UNION ALL SELECT 'infra', (s + e) // 2 - 1000, (s + e) // 2 + 1000 FROM c), sp AS ({span_sql('config,')})
SELECT config, count(*) AS n_contigs, CAST(sum(qlen) AS BIGINT) AS whole_bp, CAST(sum(span_end - span_start) AS BIGINT) AS kept_bp,
  round(100 - 100.0 * sum(span_end - span_start) / sum(qlen), 6) AS smaller_pct FROM sp GROUP BY 1"""


def missing(cond: str) -> str:
    return f"""calls AS (SELECT person_id, list(gene) AS have FROM asm WHERE {cond} GROUP BY 1),
miss AS (SELECT person_id, len(have) AS k, list_filter({['HLA-' + g for g in GENES]}, lambda x: NOT list_contains(have, substr(x, 5))) AS m FROM calls)"""


ORACLE["missing_genes"] = f"""WITH {BASE}, {ASM}, {missing("asm_1 <> 'NA'")}
SELECT person_id, CAST(k AS INTEGER) AS n_expected_found, array_to_string(m, ',') AS missing FROM miss"""
ORACLE["sweep_summary"] = f"""WITH {BASE}, {ASM}, {missing("asm_2 <> 'NA'")}
SELECT 'config_' || (person_id % 4) AS config, count(*) AS n_runs, CAST(sum(person_id % 6) AS BIGINT) AS n_contigs,
  round(avg((person_id * 7 % 400) / CAST(100 AS DOUBLE)), 6) AS mean_trimmed_mb,
  round(avg((person_id * 3 % 900) / CAST(10 AS DOUBLE)), 6) AS mean_seconds,
  CAST(min(k) AS INTEGER) AS min_classical_called, round(avg(k), 6) AS mean_classical_called FROM miss GROUP BY 1"""
READS = f"""c(name, s, e) AS (VALUES {CLUSTER_VALUES}),
rd AS (SELECT 'r' || l_orderkey AS qname, 29900000 + (l_partkey*1607 + l_suppkey*29) % 3300000 AS start FROM lineitem),
cut AS (SELECT * FROM rd WHERE EXISTS (SELECT 1 FROM c WHERE start + 150 > s - 50000 AND start < e + 50000)),
frag AS (SELECT qname, count(*) AS n_reads, min(start) AS first_start FROM cut GROUP BY 1)"""
ORACLE["sliced_reads"] = f"WITH {READS} SELECT * FROM frag"
ORACLE["mate_dropout"] = f"""WITH {READS} SELECT CAST(sum(n_reads) AS BIGINT) AS n_reads, count(*) FILTER (WHERE n_reads = 1) AS n_singletons,
  round(100.0 * count(*) FILTER (WHERE n_reads = 1) / sum(n_reads), 6) AS dropout_pct FROM frag"""
ORACLE["weighted_percentiles"] = """WITH s AS (SELECT CAST(l_quantity AS BIGINT) * 37 + l_partkey % 211 AS size, count(*) AS n FROM lineitem GROUP BY 1),
c AS (SELECT size, sum(n) OVER (ORDER BY size) AS cum, sum(n) OVER () AS total FROM s)
SELECT CAST(max(total) AS BIGINT) AS n_pairs, min(size) FILTER (WHERE cum * 100 >= total * 50) AS p50,
  min(size) FILTER (WHERE cum * 100 >= total * 95) AS p95, min(size) FILTER (WHERE cum * 100 >= total * 99) AS p99,
  max(size) AS max_size FROM c"""

# ---- association ----

MARKERS = [("M1", "DQA1", "01:01"), ("M1", "DQB1", "01:02"), ("M2", "DRB1", "03:02"), ("M3", "A", "05:01"), ("M3", "B", "01:02")]
DOSE = f"""{CALLSET},
two AS (SELECT person_id, gene, {two('a1')} AS k1, {two('a2')} AS k2 FROM callset),
mk(marker, gene, allele) AS (VALUES {', '.join(str(m) for m in MARKERS)}),
dose AS (SELECT person_id, marker, two.gene, allele,
  CASE WHEN k1 IS NULL OR k2 IS NULL THEN NULL ELSE (k1 = allele)::INT + (k2 = allele)::INT END AS dosage
  FROM two JOIN mk USING (gene))"""
MODEL = f"""{CALLSET},
two AS (SELECT person_id, gene, {two('a1')} AS k1, {two('a2')} AS k2 FROM callset),
pop AS (SELECT t.person_id, max(p.case_) AS label FROM two t JOIN persons p USING (person_id) GROUP BY 1
  HAVING count(*) FILTER (WHERE k1 IS NOT NULL AND k2 IS NOT NULL) = {len(GENES)}),
tok AS (SELECT person_id, gene || '*' || unnest([k1, k2]) AS feature FROM two JOIN pop USING (person_id)
  UNION ALL SELECT person_id, 'ancestry_' || ancestry FROM persons JOIN pop USING (person_id) WHERE ancestry IS NOT NULL),
per AS (SELECT person_id, feature, count(*)::DOUBLE AS d FROM tok GROUP BY 1, 2),
names AS (SELECT DISTINCT gene || '*' || k AS feature FROM (SELECT gene, unnest([k1, k2]) AS k FROM two) WHERE k IS NOT NULL
  UNION SELECT 'ancestry_' || ancestry FROM persons WHERE ancestry IS NOT NULL)"""
ORACLE["feature_dosage_totals"] = f"""WITH {MODEL}, n AS (SELECT count(*)::DOUBLE AS n FROM pop)
SELECT feature, count(d) AS n_people, coalesce(sum(d), 0)::BIGINT AS total,
  round(sqrt(greatest(coalesce(sum(d * d), 0) / n - (coalesce(sum(d), 0) / n) ** 2, 0)), 9) AS deviation
FROM names LEFT JOIN per USING (feature) CROSS JOIN n GROUP BY feature, n"""
ORACLE["model_population"] = f"""WITH {MODEL}, f AS (
  SELECT (row_number() OVER (ORDER BY label, person_id) - 1) % 5 AS fold, label FROM pop),
p AS (SELECT fold, count(*) AS n, sum(label) AS c FROM f GROUP BY 1)
SELECT sum(n)::BIGINT AS n_people, sum(c)::BIGINT AS n_cases, count(*) AS n_folds, min(n) AS smallest_fold, max(n) AS largest_fold FROM p"""
ORACLE["l1_optimality"] = f"""WITH {MODEL} SELECT feature, true AS optimal, true AS gradient_bounded FROM names
UNION ALL SELECT '(intercept)', true, true"""
ORACLE["allele_dosage"] = f"WITH {DOSE} SELECT person_id, gene, allele, dosage FROM dose"


def carrier(uncallable: str) -> str:
    keep = "WHERE ok" if uncallable == "exclude" else ""
    return f"""{DOSE},
bym AS (SELECT person_id, marker, bool_and(coalesce(dosage, 0) > 0) AS whole, bool_and(dosage IS NOT NULL) AS known FROM dose GROUP BY 1, 2),
car AS (SELECT person_id, carrier FROM (SELECT person_id, bool_or(whole) AS carrier, bool_and(known) AS ok FROM bym GROUP BY 1) {keep})"""


def contingency(uncallable: str) -> str:
    return f"""WITH {carrier(uncallable)},
t AS (SELECT coalesce(ancestry, 'ALL') AS ancestry, count(*) AS n, count(*) FILTER (WHERE carrier AND case_ = 1) AS a,
  count(*) FILTER (WHERE carrier AND case_ = 0) AS b, count(*) FILTER (WHERE NOT carrier AND case_ = 1) AS c,
  count(*) FILTER (WHERE NOT carrier AND case_ = 0) AS d
  FROM car JOIN persons USING (person_id) GROUP BY GROUPING SETS ((ancestry), ()))
SELECT *, a + c = 0 OR b + d = 0 OR a + b = 0 OR c + d = 0 AS degenerate,
  CASE WHEN a + c = 0 OR b + d = 0 OR a + b = 0 OR c + d = 0 THEN NULL WHEN b * c > 0 THEN round(a * d / CAST(b * c AS DOUBLE), 6)
  WHEN a * d > 0 THEN CAST('inf' AS DOUBLE) END AS odds_ratio FROM t"""


ORACLE["marker_carriers"] = f"WITH {carrier('exclude')} SELECT * FROM car"
ORACLE["contingency_or"] = contingency("exclude")
ORACLE["contingency_noncarrier"] = contingency("noncarrier")
RISK = f"""{BASE}, sc AS (SELECT person_id, ancestry, case_ AS label, ((person_id*13 + cust*7) % 400 + case_*60) / CAST(500 AS DOUBLE) AS score FROM persons)"""
RANKING = f"""{RISK}, u AS (SELECT ancestry, label, score FROM sc UNION ALL SELECT 'ALL', label, score FROM sc),
h AS (SELECT ancestry, score, sum(label) AS pos, sum(1 - label) AS neg FROM u GROUP BY 1, 2),
k AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn FROM h WINDOW w AS (PARTITION BY ancestry ORDER BY score DESC)),
m AS (SELECT ancestry, CAST(sum(pos + neg) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS cases,
  sum(neg * (cp - pos + pos / CAST(2 AS DOUBLE))) / (sum(pos) * sum(neg)) AS auroc,
  sum(pos / CAST(cp + cn AS DOUBLE) * cp) / sum(pos) AS auprc FROM k GROUP BY 1)"""
ORACLE["auroc_by_group"] = f"WITH {RANKING} SELECT ancestry, n, cases, round(auroc, 6) AS auroc FROM m"
ORACLE["average_precision"] = f"WITH {RANKING} SELECT ancestry, n, cases, round(auprc, 6) AS auprc FROM m"
ORACLE["risk_deciles"] = f"""WITH {RISK}, t AS (SELECT label, ntile(10) OVER (ORDER BY score DESC, person_id) AS decile FROM sc)
SELECT CAST(decile AS INTEGER) AS decile, count(*) AS n, CAST(sum(label) AS BIGINT) AS cases, round(avg(label), 6) AS case_rate,
  round(avg(label) / (SELECT avg(label) FROM sc), 6) AS enrichment FROM t GROUP BY 1"""


def thresholds(fractions: list[str], group: str = "") -> str:
    part = f"PARTITION BY {group}" if group else ""
    lead = f"{group}, " if group else ""
    values = ", ".join(f"(CAST({f} AS DOUBLE))" for f in fractions)
    return f"""WITH {RISK}, r AS (SELECT *, row_number() OVER ({part} ORDER BY score DESC, person_id) AS rk, count(*) OVER ({part}) AS size FROM sc),
f AS (SELECT {lead}fraction, label, greatest(1, CAST(round_even(size * fraction, 0) AS BIGINT)) AS k,
  rk <= greatest(1, CAST(round_even(size * fraction, 0) AS BIGINT)) AS flag FROM r CROSS JOIN (VALUES {values}) AS t(fraction)),
q AS (SELECT {lead}fraction, max(k) AS n_flagged, count(*) FILTER (WHERE flag AND label = 1) AS tp, count(*) FILTER (WHERE flag AND label = 0) AS fp,
  count(*) FILTER (WHERE NOT flag AND label = 1) AS fn, count(*) FILTER (WHERE NOT flag AND label = 0) AS tn FROM f GROUP BY {lead}fraction)
SELECT *, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS ppv, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS sensitivity,
  round(tn / nullif(tn + fp, 0)::DOUBLE, 6) AS specificity, round(tn / nullif(tn + fn, 0)::DOUBLE, 6) AS npv FROM q"""


ORACLE["threshold_metrics"] = thresholds(["0.05", "0.10"])
ORACLE["threshold_selection"] = ORACLE["threshold_metrics"]
ORACLE["threshold_metrics_by_group"] = thresholds(["0.10"], "ancestry")
ORACLE["stratified_folds"] = f"""WITH {BASE}, n AS (SELECT sum(case_) AS p, sum(1 - case_) AS q FROM persons)
SELECT CAST(f AS INTEGER) AS fold, label, count(*) AS n FROM (
  SELECT case_ AS label, (row_number() OVER (ORDER BY case_, person_id) - 1) % 5 AS f FROM persons) GROUP BY 1, 2"""

# ---- telemetry ----

BEATS = """inc AS (SELECT user_id % 10 AS run_id, event_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS sec,
  (event_type = 'error')::INT AS f, value % 100 AS disk, CAST(100 AS DOUBLE) - value % 97 AS mem,
  CASE WHEN event_id % 211 = 0 THEN 'complete' WHEN event_id % 307 = 0 THEN 'failed' WHEN event_id % 101 = 0 THEN 'starting'
    ELSE 'running' END AS run_state FROM events),
b AS (SELECT *, CAST(sum(1 - f) OVER w AS BIGINT) AS done, CAST(sum(f) OVER w AS BIGINT) AS failed FROM inc
  WINDOW w AS (PARTITION BY run_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, lag(sec) OVER w AS psec, lag(run_state) OVER w AS pstate, coalesce(lag(done) OVER w, 0) AS pdone,
  coalesce(lag(failed) OVER w, 0) AS pfailed FROM b WINDOW w AS (PARTITION BY run_id ORDER BY sec, event_id)),
roll AS (SELECT *, CASE WHEN done > pdone THEN 100.0::DOUBLE * greatest(failed - pfailed, 0) / (done - pdone)
  WHEN done > 0 THEN 100.0::DOUBLE * failed / done ELSE 0 END AS rfp FROM l),
bad AS (SELECT *, rfp > 15 OR disk > 90 OR mem < 10 AS anomaly FROM roll),
ses AS (SELECT *, sum(CASE WHEN psec IS NULL OR sec - psec > 5400 THEN 1 ELSE 0 END)
  OVER (PARTITION BY run_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING) AS session FROM l)"""
ORACLE["cumulative_beats"] = f"WITH {BEATS} SELECT run_id, event_id, done AS people_done, failed AS people_failed FROM b"
METRICS = f"""{BEATS}, met AS (SELECT *, greatest((sec - min(sec) OVER (PARTITION BY run_id)) / CAST(3600 AS DOUBLE), CAST(1e-9 AS DOUBLE)) AS h,
  greatest(count(*) OVER (PARTITION BY run_id) + 50 - done, 0) AS remaining,
  (sec - min(sec) OVER (PARTITION BY run_id, session)) / CAST(3600 AS DOUBLE) AS sh FROM ses),
met2 AS (SELECT *, CASE WHEN done / h > 0 THEN remaining / (done / h) END AS eta FROM met)"""
ORACLE["telemetry_metrics"] = f"""WITH {METRICS} SELECT run_id, event_id, round(h, 6) AS elapsed_hours, round(done / h, 6) AS rate_per_hour,
  remaining, round(eta, 6) AS eta_hours, round(h * CAST(1.3 AS DOUBLE), 6) AS cost_usd FROM met2"""
ORACLE["cost_projection"] = f"""WITH {METRICS} SELECT run_id, event_id, CAST(session AS BIGINT) AS session, round(sh * CAST(1.3 AS DOUBLE), 6) AS cost_so_far,
  round((sh + eta) * CAST(1.3 AS DOUBLE), 6) AS projected_total, coalesce((sh + eta) * CAST(1.3 AS DOUBLE) > 300, false) AS over_budget FROM met2"""
ORACLE["failure_deltas"] = f"""WITH {BEATS} SELECT run_id, event_id, round(rfp, 6) AS rolling_failure_pct,
  round(100.0 * (failed - pfailed) / nullif(done - pdone + failed - pfailed, 0), 6) AS attempt_failure_pct FROM roll"""
ORACLE["beat_anomalies"] = f"""WITH {BEATS} SELECT run_id, count(*) FILTER (WHERE anomaly) AS n_anomalous, count(*) FILTER (WHERE disk > 90) AS n_disk,
  count(*) FILTER (WHERE mem < 10) AS n_mem, count(*) FILTER (WHERE rfp > 15) AS n_failure FROM bad GROUP BY 1"""
ORACLE["run_sessions"] = f"""WITH {BEATS}, s AS (SELECT run_id, CAST(session AS BIGINT) AS session, min(sec) AS first_sec, max(sec) AS last_sec,
  count(*) AS n_beats, max(done) AS people_done, max(failed) AS people_failed FROM ses GROUP BY 1, 2)
SELECT *, round((last_sec - first_sec) / CAST(3600 AS DOUBLE), 6) AS hours,
  round((last_sec - first_sec) / CAST(3600 AS DOUBLE) * CAST(1.25 AS DOUBLE), 6) AS vm_cost,
  round((last_sec - first_sec) / CAST(3600 AS DOUBLE) * CAST(0.05 AS DOUBLE), 6) AS disk_cost,
  round((last_sec - first_sec) / CAST(3600 AS DOUBLE) * CAST(1.3 AS DOUBLE), 6) AS cost FROM s"""
ALERTS = f"""{BEATS}, z AS (SELECT *, coalesce(lag(anomaly) OVER (PARTITION BY run_id ORDER BY sec, event_id), false) AS pbad,
  coalesce(pstate IN ('complete', 'failed'), false) AS pterm, run_state IN ('complete', 'failed') AS term FROM bad),
al AS (SELECT run_id, 'stale' AS alert, psec + 7200 AS alert_sec FROM z WHERE NOT pterm AND sec - psec > 7200
  UNION ALL SELECT run_id, 'resumed', sec FROM z WHERE NOT pterm AND sec - psec > 7200
  UNION ALL SELECT run_id, 'finished', sec FROM z WHERE run_state = 'complete' AND NOT pterm
  UNION ALL SELECT run_id, 'stopped', sec FROM z WHERE run_state = 'failed' AND NOT pterm
  UNION ALL SELECT run_id, 'anomaly', sec FROM z WHERE anomaly AND NOT pbad
  UNION ALL SELECT run_id, 'cleared', sec FROM z WHERE NOT anomaly AND pbad)"""
ORACLE["alert_transitions"] = f"WITH {ALERTS} SELECT * FROM al"
ORACLE["alert_stream"] = f"""WITH {ALERTS}, lastb AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY sec DESC, event_id DESC) AS rn FROM b) WHERE rn = 1)
SELECT * FROM al UNION ALL SELECT run_id, 'stale', sec + 7200 FROM lastb
WHERE run_state NOT IN ('complete', 'failed') AND sec + 7200 < (SELECT max(sec) FROM b) - 600"""
ORACLE["current_status"] = f"""WITH {BEATS} SELECT run_id, event_id, sec, run_state,
  CASE WHEN run_state = 'complete' THEN 'COMPLETE' WHEN run_state = 'failed' THEN 'STOPPED' WHEN run_state = 'starting' THEN 'STARTING'
    WHEN (SELECT max(sec) FROM b) - sec > 7200 THEN 'STALE' WHEN anomaly THEN 'ANOMALY' ELSE 'RUNNING' END AS status,
  done AS people_done, failed AS people_failed FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY sec DESC, event_id DESC) AS rn FROM bad) WHERE rn = 1"""
ORACLE["session_history"] = f"""WITH {BEATS} SELECT run_id, CAST(session AS BIGINT) AS session, event_id, done AS people_done, round(mem, 6) AS mem_avail_pct FROM (
  SELECT *, max(session) OVER (PARTITION BY run_id) AS cur, row_number() OVER (PARTITION BY run_id ORDER BY sec DESC, event_id DESC) AS rn FROM ses)
WHERE session = cur AND rn <= 500"""
ORACLE["attempt_giveup"] = """SELECT user_id AS person_id, count(*) FILTER (WHERE event_id % 97 <> 0) AS n_failed, bool_or(event_id % 97 = 0) AS done,
  NOT bool_or(event_id % 97 = 0) AND count(*) FILTER (WHERE event_id % 97 <> 0) >= 3 AS given_up FROM events GROUP BY 1"""
ORACLE["tumbling_rollup"] = f"""WITH {BEATS} SELECT run_id, sec // 3600 * 3600 AS bucket_sec, count(*) AS n_beats, max(done) AS people_done,
  max(failed) AS people_failed, round(max(disk), 6) AS max_disk_used_pct, round(min(mem), 6) AS min_mem_avail_pct FROM b GROUP BY 1, 2"""



def _lnc(n: str, k: str) -> str:
    return f"(lgamma(({n}) + 1) - lgamma(({k}) + 1) - lgamma(({n}) - ({k}) + 1))"


_P = f"({_lnc('a + b', 'x')} + {_lnc('c + d', 'a + c - x')} - {_lnc('n', 'a + c')})"
ORACLE["fisher_exact"] = f"""WITH tab AS ({contingency('exclude')}),
cells AS (SELECT *, unnest(generate_series(greatest(0, a + c - (c + d)), least(a + b, a + c))) AS x FROM tab),
p AS (SELECT *, {_P} AS lp, {_P.replace('(x)', '(a)').replace('- x', '- a')} AS seen FROM cells),
s AS (SELECT ancestry, sum(exp(lp)) AS p FROM p WHERE lp <= seen + ln(1 + 1e-7) GROUP BY 1)
SELECT tab.*, CASE WHEN NOT degenerate THEN round(least(p, 1), 6) END AS fisher_p FROM tab JOIN s USING (ancestry)"""
