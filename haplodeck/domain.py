"""Fixed domain values. Operators take them as defaults, never as hard-wired literals."""

# The classical loci, in report order.
GENES = ["A", "B", "C", "DRB1", "DQA1", "DQB1", "DPA1", "DPB1"]
HARDEST_LOCI = ["DRB1", "DPB1"]

# Genetic-ancestry group labels, in report order.
GROUPS = ["AFR", "AMR", "EAS", "EUR", "MID", "SAS"]

# Text that stands for "no call".
NULL_TOKENS = ["", "NA", "-", "nan", "None", ".", "na"]
NULL_TOKENS_ANY_CASE = ["", "na", "nan", "none", "-", "."]
TRUE_TOKENS = ["true", "1", "yes"]

# Text a delimited-file reader takes for a missing value by default.
READER_NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# GRCh38 extents of the gene clusters on chr6.
CLUSTER_CONTIG = "chr6"
GENE_CLUSTERS = [
    ("A", 29941260, 29949606),
    ("B_C", 31268746, 31367067),
    ("DR_DQ", 32577902, 32668383),
    ("DP", 33064569, 33091655),
]
DEFAULT_REGION = "chr6:29500000-33500000"

# File-name endings of data files and of their index companions.
PRIMARY_EXTENSIONS = [
    ".bam", ".cram", ".fastq", ".fastq.gz", ".fq.gz",
    ".fa", ".fasta", ".fa.gz", ".fasta.gz",
    ".vcf", ".vcf.gz", ".g.vcf.gz", ".gvcf", ".gvcf.gz",
    ".paf", ".gfa", ".snf",
]
INDEX_EXTENSIONS = [".bai", ".crai", ".tbi", ".csi", ".pbi", ".gzi"]

NO_PROFILE = "NONE_FOUND"

# Trim tiers, best first.
TIERS = ["paf_region", "bam_whole_contig", "self_align_needed"]

# Risk markers; all components of a marker must be carried, any marker suffices.
RISK_MARKERS = {
    "celiac": [
        ("DQ2.5", "DQA1", "05:01"), ("DQ2.5", "DQB1", "02:01"),
        ("DQ8", "DQA1", "03:01"), ("DQ8", "DQB1", "03:02"),
    ],
    "narcolepsy": [("DQB1*06:02", "DQB1", "06:02")],
}

# Thresholds.
RARE_FREQUENCY = 0.01
CONFIDENT_IDENTITY = 0.99
MIN_GROUP_CASES = 10
MIN_CARRIERS_FOR_DOMINANCE = 20
FAILURE_RATE_ANOMALY_PCT = 15.0
DISK_DANGER_PCT = 90.0
MEM_AVAIL_DANGER_PCT = 10.0
SESSION_GAP_MINUTES = 90
CHART_MAX_POINTS = 500
IDENTITY_SWEEP = [0.99, 0.95, 0.90, 0.80]
DISTANCE_SWEEP = [0, 1, 2, 3, 5]
FIELD_LEVELS = [1, 2, 3, 4]
