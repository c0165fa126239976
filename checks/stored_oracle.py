"""DuckDB statements for the queries of `plans/stored.py`."""

from checks.oracle import ASM, BASE
from checks.oracle import ORACLE as MAIN
from checks.reader_oracle import ORACLE as READER

ORACLE: dict[str, str] = {}

ORACLE["bucketed_before_after"] = MAIN["confidence_before_after"]
ORACLE["bucketed_latest"] = f"SELECT person_id, gene, v, sr_1, sr_2 FROM ({MAIN['latest_calls']})"
ORACLE["bucketed_labels"] = READER["labelled_calls"]
ORACLE["bucket_upsert"] = f"""WITH {BASE}, {ASM} SELECT person_id, gene,
  CASE WHEN person_id % 100 = 1 THEN 'updated' ELSE asm_1 END AS asm_1, asm_2 FROM asm"""
ORACLE["bucket_compaction"] = MAIN["compact_fragments"]
