"""Genomic ranges as tables: windows, overlap, spans per contig, islands, histogram percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haplodeck import domain
from haplodeck.functions.text import pct
from haplodeck.functions.uris import region_text
from haplodeck.operators.prefix import segmented_lag, segmented_running
from haplodeck.operators.rows import first_per_key

BIN = 1 << 20  # island segments, in base pairs
OVERLAP_BIN = 1 << 17
FEW_WINDOWS = 10_000  # up to here one side of an overlap join is broadcast


def cluster_table(spark: SparkSession, clusters: list[tuple] = domain.GENE_CLUSTERS,
                  contig: str = domain.CLUSTER_CONTIG) -> DataFrame:
    """Inline rows, whose size the planner knows."""
    rows = ", ".join(f"('{contig}', '{n}', {s}L, {e}L)" for n, s, e in clusters)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(contig, name, start, end)")


def padded_windows(windows: DataFrame, pad: int, floor: int = 1) -> DataFrame:
    return windows.withColumns({
        "start": F.greatest(F.lit(floor), F.col("start") - pad), "end": F.col("end") + pad,
    })


def truncated_windows(windows: DataFrame, width: int, floor: int = 1) -> DataFrame:
    """Windows of a fixed width on the midpoints, whatever the extent was."""
    mid = F.floor((F.col("start") + F.col("end")) / 2)
    half = width // 2
    return windows.withColumns({"start": F.greatest(F.lit(floor), mid - half), "end": mid + half})


def _islands(df: DataFrame, keys: list[str], gap: int, segment: int) -> DataFrame:
    """Numbers islands of intervals that touch (next start <= furthest end so far + gap). Rows
    must be unique per (keys, start). Each contig is cut into segments, so one contig holding a
    third of all intervals is still spread over many tasks."""
    cut = df.withColumn("_seg", F.floor(F.col("start") / segment))
    cut = segmented_running(cut, keys, ["start"], "_seg", {"end": "_reach"}, "max", inclusive=False)
    fresh = F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + gap)
    cut = cut.withColumn("_new", fresh.cast("long"))
    return segmented_running(cut, keys, ["start"], "_seg", {"_new": "island"}).drop(
        "_seg", "_reach", "_new")


def merge_intervals(df: DataFrame, keys: list[str] = ("contig",), gap: int = 1,
                    segment: int = BIN) -> DataFrame:
    """Union of overlapping or touching intervals per key."""
    keys = list(keys)
    unique = df.groupBy(*keys, "start").agg(F.max("end").alias("end"), F.count("*").alias("n"))
    return _islands(unique, keys, gap, segment).groupBy(*keys, "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n_intervals")
    ).drop("island")


def plain_contig(c: Column | str) -> Column:
    """'chr6' and '6' as one name."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, "^chr", "")


def overlap_join(left: DataFrame, right: DataFrame, left_cols: tuple, right_cols: tuple,
                 bin_size: int = OVERLAP_BIN) -> DataFrame:
    """Pairs of half-open intervals that overlap: left_cols and right_cols are (contig, start,
    end). Both sides are cut into bins and joined by equality on (contig, bin); a pair is kept only
    in the first bin both touch. Up to FEW_WINDOWS rows, checked, the right side is broadcast and the
    left one stays where it is; beyond, adaptive execution splits bins that hold too much."""
    lc, ls, le = left_cols
    rc, rs, re = right_cols

    def binned(df: DataFrame, c: str, s: str, e: str, tag: str) -> DataFrame:
        lo = F.floor(F.col(s) / bin_size)
        hi = F.greatest(lo, F.floor((F.col(e) - 1) / bin_size))
        return df.withColumns({f"_c{tag}": plain_contig(c), f"_lo{tag}": lo}).withColumn(
            f"_b{tag}", F.explode(F.sequence(lo, hi)))

    few = right.limit(FEW_WINDOWS + 1).count() <= FEW_WINDOWS
    a, b = binned(left, lc, ls, le, "l"), binned(right, rc, rs, re, "r")
    b = F.broadcast(b) if few else b
    joined = a.join(b, (F.col("_cl") == F.col("_cr")) & (F.col("_bl") == F.col("_br")))
    return joined.where(
        (F.col(le) > F.col(rs)) & (F.col(ls) < F.col(re))
        & (F.col("_bl") == F.greatest("_lol", "_lor"))
    ).drop("_cl", "_cr", "_lol", "_lor", "_bl", "_br")


def target_names(paf: DataFrame) -> DataFrame:
    """Target names seen, with and without the chr prefix told apart."""
    return paf.groupBy("tname", plain_contig("tname").alias("contig")).agg(
        F.count("*").alias("n_blocks"))


def contig_spans(paf: DataFrame, contig: str, start: int, end: int, pad: int,
                 keys: list[str] = ("qname",)) -> DataFrame:
    """Padded, clamped span of the blocks of each query contig that overlap one region."""
    hit = (
        (plain_contig("tname") == contig.removeprefix("chr"))
        & (F.col("tend") > start) & (F.col("tstart") < end)
    )
    return paf.where(hit).groupBy(*keys).agg(
        F.min(F.greatest(F.lit(0), F.col("qstart") - pad)).alias("span_start"),
        F.max(F.least(F.col("qlen"), F.col("qend") + pad)).alias("span_end"),
        F.max("qlen").alias("qlen"), F.count("*").alias("n_blocks"),
    ).withColumn("region", region_text(keys[-1], "span_start", "span_end"))


def query_position(ref: Column) -> Column:
    """Query coordinate of a reference position, interpolated inside one block."""
    inside = F.least(F.greatest(ref, F.col("tstart")), F.col("tend"))
    frac = (inside - F.col("tstart")) / F.greatest(F.lit(1), F.col("tend") - F.col("tstart"))
    step = frac * (F.col("qend") - F.col("qstart"))
    return F.when(F.col("strand") == "+", F.col("qstart") + step).otherwise(F.col("qend") - step)


def window_spans(paf: DataFrame, windows: DataFrame, keys: list[str] = ("qname",),
                 by: list[str] = ()) -> DataFrame:
    """Span per query contig over all windows it touches, each end interpolated to the window
    border. `by` names window columns to keep apart, such as a configuration."""
    wins = windows.select(*by, F.col("contig").alias("_wc"), F.col("start").alias("_ws"),
                          F.col("end").alias("_we"))
    hits = overlap_join(paf, wins, ("tname", "tstart", "tend"), ("_wc", "_ws", "_we"))
    hits = hits.withColumns({
        "_p": query_position(F.greatest("tstart", "_ws")),
        "_q": query_position(F.least("tend", "_we")),
    })
    lo = F.greatest(F.lit(0), F.least("_p", "_q").cast("long"))
    hi = F.least(F.col("qlen"), F.bround(F.greatest("_p", "_q"), 0).cast("long"))
    return hits.groupBy(*by, *keys).agg(
        F.min(lo).alias("span_start"), F.max(hi).alias("span_end"), F.max("qlen").alias("qlen"))


def reduction_report(spans: DataFrame, by: list[str] = ()) -> DataFrame:
    """Contigs, whole and kept base pairs, and how much smaller the kept part is."""
    out = spans.groupBy(*by).agg(
        F.count("*").alias("n_contigs"), F.sum("qlen").alias("whole_bp"),
        F.sum(F.col("span_end") - F.col("span_start")).alias("kept_bp"))
    return out.withColumn("smaller_pct", F.lit(100.0) - pct(F.col("kept_bp"), F.col("whole_bp")))


def clustered_spans(paf: DataFrame, gap: int, min_block: int, min_identity: float,
                    min_aligned: int = 0, keys: list[str] = ("qname",),
                    segment: int = BIN) -> DataFrame:
    """Blocks that are long and identical enough, joined into clusters by query distance; one
    stray block no longer stretches the span. The longest cluster of a contig is marked."""
    keys = list(keys)
    good = (F.col("block_len") >= min_block) & (
        F.col("matches") >= F.col("block_len") * min_identity)
    unique = paf.where(good).groupBy(*keys, F.col("qstart").alias("start")).agg(
        F.max("qend").alias("end"), F.sum("block_len").alias("aligned"), F.count("*").alias("n"))
    clusters = _islands(unique, keys, gap, segment).groupBy(*keys, "island").agg(
        F.min("start").alias("span_start"), F.max("end").alias("span_end"),
        F.sum("aligned").alias("aligned_bp"), F.sum("n").alias("n_blocks"),
    ).where(F.col("aligned_bp") >= min_aligned)
    main = first_per_key(clusters, keys, [F.col("aligned_bp").desc(), F.col("span_start")]).select(
        *keys, "island", F.lit(True).alias("_m"))
    return clusters.join(main, [*keys, "island"], "left").withColumn(
        "is_main", F.coalesce("_m", F.lit(False))).drop("_m", "island")


def reads_in_windows(reads: DataFrame, windows: DataFrame) -> DataFrame:
    """Reads that overlap any window, each once. Windows are merged first; a read that spans a gap
    between two of them is kept only with the first, that is when it misses the one before."""
    merged = merge_intervals(windows).withColumn("_seg", F.floor(F.col("start") / BIN))
    wins = segmented_lag(merged, ["contig"], ["start"], "_seg", {"end": "_prev_end"}).select(
        F.col("contig").alias("_wc"), F.col("start").alias("_ws"), F.col("end").alias("_we"),
        "_prev_end")
    hits = overlap_join(reads, wins, ("contig", "start", "end"), ("_wc", "_ws", "_we"))
    first = F.col("_prev_end").isNull() | (F.col("start") >= F.col("_prev_end"))
    return hits.where(first).select(*reads.columns)


def mate_dropout(sliced: DataFrame) -> DataFrame:
    """Reads whose mate fell outside the slice, against all reads of the slice."""
    per = sliced.groupBy("qname").agg(F.count("*").alias("n"))
    return per.agg(
        F.sum("n").alias("n_reads"), F.count_if(F.col("n") == 1).alias("n_singletons")
    ).withColumn("dropout_pct", pct(F.col("n_singletons"), F.greatest("n_reads", F.lit(1))))


def weighted_percentiles(hist: DataFrame, targets: list[int] = (50, 95, 99),
                         segment: int = 1024) -> DataFrame:
    """Smallest size at which the cumulative weight reaches each percentage, with total and max.
    Sizes are cut into segments, so the cumulative sum never sits in one task."""
    by_size = hist.groupBy("size").agg(F.sum("pairs").alias("pairs")).withColumn(
        "_seg", F.floor(F.col("size") / segment))
    cum = segmented_running(by_size, [], ["size"], "_seg", {"pairs": "cum"})
    total = by_size.agg(F.sum("pairs").alias("_total"))
    joined = cum.join(F.broadcast(total), F.lit(True))
    return joined.agg(
        F.max("_total").alias("n_pairs"),
        *[F.min(F.when(F.col("cum") * 100 >= F.col("_total") * t, F.col("size"))).alias(f"p{t}")
          for t in targets],
        F.max("size").alias("max_size"),
    )


def missing_labels(found: DataFrame, keys: list[str], label: str, expected: list[str]) -> DataFrame:
    """Expected labels that do not occur per key, as a count and as one text in expected order."""
    want = F.array(*[F.lit(x) for x in expected])
    known = F.when(F.col(label).isin(expected), F.col(label))  # keeps the set within `expected`
    out = found.groupBy(*keys).agg(F.collect_set(known).alias("_s"))
    missing = F.array_except(want, F.col("_s"))
    return out.select(
        *keys, F.size(F.array_intersect(want, "_s")).alias("n_expected_found"),
        F.array_join(missing, ",").alias("missing"))


def config_windows(windows: DataFrame, configs: list[tuple[str, str, int]]) -> DataFrame:
    """Windows of every (name, 'pad' | 'trunc', value) configuration."""
    out = None
    for name, kind, value in configs:
        made = padded_windows(windows, value, 0) if kind == "pad" else truncated_windows(windows, value, 0)
        part = made.withColumn("config", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def sweep_summary(results: DataFrame) -> DataFrame:
    """Per configuration: runs, contigs, megabytes, seconds and genes called."""
    return results.groupBy("config").agg(
        F.count("*").alias("n_runs"), F.sum("n_contigs").alias("n_contigs"),
        F.avg("trimmed_mb").alias("mean_trimmed_mb"), F.avg("total_seconds").alias("mean_seconds"),
        F.min("n_classical_called").alias("min_classical_called"),
        F.avg("n_classical_called").alias("mean_classical_called"))
