"""Every query against its DuckDB statement, on the smallest tables."""

import math
import os

import duckdb
import pytest

from checks.oracle import ORACLE as MAIN_ORACLE
from checks.reader_oracle import ORACLE as READER_ORACLE
from checks.stored_oracle import ORACLE as STORED_ORACLE
from checks.stream_oracle import ORACLE as STREAM_ORACLE
from haplodeck.plans.queries import QUERIES as MAIN_QUERIES
from haplodeck.plans.readers import QUERIES as READER_QUERIES
from haplodeck.plans.stored import QUERIES as STORED_QUERIES
from haplodeck.plans.streams import QUERIES as STREAM_QUERIES

QUERIES = {**MAIN_QUERIES, **READER_QUERIES, **STREAM_QUERIES, **STORED_QUERIES}
ORACLE = {**MAIN_ORACLE, **READER_ORACLE, **STREAM_ORACLE, **STORED_ORACLE}

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
NO_SQL = {"l1_oof_scores", "l1_coefficients", "l1_top_coefficients", "l1_nonzero", "l1_held_out"}
QUICK = [
    "field2_concordance_gene_ancestry", "cascade_pooled", "threeway_concordance", "resolution_tiers",
    "genotype_status_rollup", "concordance_detail", "caller_haplotypes", "call_matrix", "hwe_proxy",
    "top_alleles", "confidence_matched_rates", "retention_stages", "upper_median", "allele_tree",
    "release_lower_bound", "enriched_dominance", "eligible_people", "venn_totals", "column_report",
    "union_profile", "best_tier", "qc_describe", "qc_correlation", "qc_histogram", "merged_blocks",
    "clustered_spans", "config_sweep", "mate_dropout", "weighted_percentiles", "fisher_exact",
    "auroc_by_group", "average_precision", "risk_deciles", "threshold_metrics_by_group",
    "telemetry_metrics", "run_sessions", "alert_transitions", "alert_stream",
]
NAMES = QUICK if os.environ.get("QUICK_QUERIES") else sorted(ORACLE)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_every_query_has_a_statement():
    assert set(QUERIES) - NO_SQL == set(ORACLE)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    mine = ordered(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(ORACLE[name])
    theirs_cols = [c[0] for c in cur.description]
    assert sorted(theirs_cols) == cols
    at = [theirs_cols.index(c) for c in cols]
    theirs = ordered(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    assert mine == theirs
