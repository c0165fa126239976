"""DuckDB statements for the reader queries."""

from checks.oracle import BASE, BEST, CALLSET, CATALOGUE, GENES, MANIFEST, PAF

ORACLE = {
    "read_genotypes": f"""WITH {CALLSET} SELECT person_id, gene, nullif(a1, '') AS a1, nullif(a2, '') AS a2 FROM callset""",
    "read_genotypes_reader_rules": f"""WITH {CALLSET} SELECT person_id, gene, nullif(a1, '') AS a1,
  nullif(nullif(a2, ''), 'nan') AS a2 FROM callset""",
    "read_ancestry": f"""WITH {BASE} SELECT person_id, ancestry, '[' || (person_id % 7) || '; ' || (cust % 5) || ']' AS pca FROM persons""",
    "read_manifest": f"""WITH {MANIFEST} SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, person_id, platform,
  nullif(hap1_fa, '') AS hap1_fa FROM man""",
    "read_catalogue": f"WITH {CATALOGUE} SELECT allele_id, gene, allele_full FROM cat",
    "read_phenotype": f"""WITH {BASE} SELECT person_id, ancestry,
  CAST(CASE WHEN person_id % 5 <> 0 THEN case_ END AS INTEGER) AS "case" FROM persons""",
    "labelled_calls": f"""WITH {CALLSET} SELECT CASE WHEN person_id % 9 <> 0 THEN ancestry END AS ancestry, gene,
  count(*) AS n, count(a1) AS n_a1 FROM callset GROUP BY 1, 2""",
    "read_wide_results": f"""WITH {CALLSET} SELECT person_id, gene,
  CASE WHEN gene = '{GENES[-1]}' THEN 'NA' ELSE nullif(coalesce(a1, 'NA'), '') END AS sr_1,
  CASE WHEN gene = '{GENES[-1]}' THEN 'NA' ELSE nullif(coalesce(a2, 'NA'), '') END AS sr_2 FROM callset""",
    "annotation_attributes": f"""WITH {CALLSET} SELECT person_id, hap, gene, CAST(person_id % 5 AS VARCHAR) AS template_distance,
  'NA' AS template_warning FROM callset CROSS JOIN (VALUES ('hap1'), ('hap2')) AS h(hap)""",
    "annotation_calls": f"""WITH {CALLSET} SELECT person_id, 'id-' || gene AS gene, coalesce(nullif(a1, ''), 'NA') AS asm_1,
  coalesce(nullif(a2, ''), 'NA') AS asm_2 FROM callset WHERE nullif(a1, '') IS NOT NULL OR nullif(a2, '') IS NOT NULL""",
    "annotation_complete": f"""WITH {CALLSET} SELECT person_id FROM callset GROUP BY 1
  HAVING count(nullif(a1, '')) > 0 AND count(nullif(a2, '')) > 0""",
    "parse_paf": f"""WITH {PAF} SELECT tname, strand, count(*) AS n, sum(matches)::BIGINT AS matches,
  sum(tend - tstart)::BIGINT AS span, sum(qend - qstart)::BIGINT AS q_span, 60::BIGINT AS mapq FROM paf GROUP BY 1, 2""",
    "parse_insert_sizes": """SELECT CAST(CAST(l_quantity AS BIGINT) * 37 + l_partkey % 211 AS INTEGER) AS size,
  count(*) AS pairs FROM lineitem GROUP BY 1""",
    "shell_minutes": """SELECT o_orderkey, round((o_orderkey % 50) + (o_orderkey % 600) / 600.0, 6)::DOUBLE AS minutes FROM orders""",
    "worklist": f"""WITH {BEST} SELECT b.person_id, trim_tier,
  coalesce(CASE WHEN p.person_id % 9 <> 0 THEN p.ancestry END, 'NA') AS ancestry FROM best b LEFT JOIN persons p USING (person_id)""",
    "displayed_missingness": f"""WITH {CALLSET} SELECT gene,
  round_even(100.0 * count(*) FILTER (WHERE a1 IS NULL) / count(*), 1) AS missing_pct FROM callset GROUP BY 1""",
}
