"""Genotype-shaped views derived by Spark from the driver tables, by integer arithmetic only.

A person is an order, its ancestry group the customer's region, a call-log version a line item.
Every view grows with the table it is derived from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haplodeck import domain
from haplodeck.functions.text import epoch_seconds
from haplodeck.functions.uris import relative_path
from haplodeck.operators.rows import with_once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: People per partition: a task that makes all genes, haplotypes and versions of so many sorts them in memory.
PEOPLE_PER_PART = 25_000


def view_parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions of the views by person. A fixed number, as adaptive execution would join partitions
    by the size of the narrow rows, which become sixty times longer after it."""
    n = table(spark, sf_dir, "orders").count()  # from the file footers
    return max(spark.sparkContext.defaultParallelism, -(-n // PEOPLE_PER_PART))


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """person_id, cust, ancestry, case. Spread by person while the rows are still narrow: the
    views built on it are eight to sixteen times longer, and every later grouping or join on the
    person then finds its rows in place."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("o_orderkey").alias("person_id"), F.col("o_custkey").alias("cust"),
            F.col("r_name").alias("ancestry"),
            (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("case"),
        )
        .repartition(view_parts(spark, sf_dir), "person_id")
    )


def ancestry_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """person_id, ancestry of everybody; every ninth person has no label."""
    label = F.when(F.col("person_id") % 9 != 0, F.col("ancestry")).alias("ancestry")
    return persons(spark, sf_dir).select("person_id", label)


def _with_genes(df: DataFrame) -> DataFrame:
    genes = F.array(*[
        F.struct(F.lit(i).alias("g"), F.lit(g).alias("gene")) for i, g in enumerate(domain.GENES)
    ])
    return df.withColumn("_g", F.explode(genes)).select(*df.columns, "_g.g", "_g.gene")


def _once(view: DataFrame, keys: list[str]) -> DataFrame:
    """A view whose columns, apart from the plain `keys`, are computed once per row."""
    return with_once(view, {c: F.col(c) for c in view.columns if c not in keys}).select(*view.columns)


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def _haplotypes(df: DataFrame) -> DataFrame:
    """Adds i1, i2 (allele indexes 0..23, skewed), h1, h2 (two fields), f1, f2 (first fields)."""
    p, c, g = F.col("person_id"), F.col("cust"), F.col("g")
    x1 = (p * (g * 2 + 7) + c * (g + 3)) % 97
    x2 = (p * (g * 2 + 11) + c * (g + 5) + 13) % 97
    df = df.withColumns({"_x1": x1, "_x2": x2})
    df = df.withColumns({
        "i1": F.col("_x1") * F.col("_x1") % 24, "i2": F.col("_x2") * F.col("_x2") % 24,
    }).drop("_x1", "_x2")
    df = df.withColumns({
        "f1": _two(F.floor(F.col("i1") / 4) + 1), "f2": _two(F.floor(F.col("i2") / 4) + 1),
    })
    return df.withColumns({
        "h1": F.concat(F.col("f1"), F.lit(":"), _two(F.col("i1") % 4 + 1)),
        "h2": F.concat(F.col("f2"), F.lit(":"), _two(F.col("i2") % 4 + 1)),
    })


def _base_calls(version: Column) -> dict[str, Column]:
    q = (F.col("person_id") * 37 + F.col("g") * 11 + version) % 19
    full = F.concat(F.col("gene"), F.lit("*"))
    return {
        "base_1": F.when(q == 0, None).when(q == 1, "").when(q == 2, F.col("h1"))
        .otherwise(F.concat(full, F.col("h1"), F.lit(":01"))),
        "base_2": F.when(q == 3, "nan").when(q == 4, F.concat(full, F.col("f2")))
        .when(q == 5, F.concat(full, F.col("h1"), F.lit(":01")))
        .when(q == 6, F.concat(full, F.col("f2"), F.lit(":97")))
        .otherwise(F.concat(full, F.col("h2"), F.lit(":01"))),
    }


def callset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (person, gene): person_id, ancestry, case, gene, a1, a2 (null tokens as text)."""
    df = _haplotypes(_with_genes(persons(spark, sf_dir)))
    calls = _base_calls(F.lit(0))
    return with_once(df, {"a1": calls["base_1"], "a2": calls["base_2"]}).select(
        "person_id", "ancestry", "case", "gene", "a1", "a2")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison log's narrow spine: person_id, v, ts, run_label, cust. A version covers all genes
    of its person, so rows of the log can be chosen here, before the wide columns are made."""
    v = F.col("v")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("person_id"), F.col("l_linenumber").alias("v"),
        F.col("l_shipdate").alias("ts")).repartition(view_parts(spark, sf_dir), "person_id")
    return lines.join(persons(spark, sf_dir).select("person_id", "cust"), "person_id").select(
        "person_id", "v", "ts", F.when(v % 3 == 0, "pilot").otherwise("main").alias("run_label"), "cust")


def log_calls(lines: DataFrame) -> DataFrame:
    """The log's rows of the given lines, one per gene; further columns of the lines come last."""
    spine = ["person_id", "v", "ts", "run_label"]
    more = [c for c in lines.columns if c not in (*spine, "cust")]
    df = _haplotypes(_with_genes(lines))
    p, g, v = F.col("person_id"), F.col("g"), F.col("v")
    star = F.concat(F.col("gene"), F.lit("*"))
    e, dp = (p * 31 + g * 17 + v) % 20, (p * 13 + g * 7) % 23
    q = (p * 37 + g * 11 + v) % 19
    base = _base_calls(v)
    tail = F.when(dp < 6, ":new").when(dp < 12, ":01").otherwise("")
    return _once(df.select(
        "person_id", "gene", "v", "ts", "run_label",
        base["base_1"].alias("base_1"), base["base_2"].alias("base_2"),
        F.concat(star, F.col("h2"), F.when(e < 3, "").otherwise(":01")).alias("sr_1"),
        F.when(e == 7, F.concat(star, F.lit("88:01")))
        .when(e.isin(5, 6), F.concat(star, F.col("f1"), F.lit(":99:01")))
        .otherwise(F.concat(star, F.col("h1"), F.lit(":01"))).alias("sr_2"),
        F.when(dp == 0, "NA").otherwise(F.concat(star, F.col("h1"), F.lit(":01"), tail)).alias("lr_1"),
        F.when(dp == 1, "-").otherwise(F.concat(star, F.col("h2"), F.lit(":01:02"))).alias("lr_2"),
        F.when(q != 7, F.lit(1.0) - ((p * 17 + g * 3) % 100) / 10000.0).alias("lr_identity_1"),
        (F.lit(1.0) - ((p * 19 + g * 5) % 80) / 10000.0).alias("lr_identity_2"),
        F.when((p + g) % 11 == 0, "True").otherwise("False").alias("lr_tied_1"),
        F.when((p * 3 + g) % 29 == 0, "yes").otherwise("no").alias("lr_tied_2"),
        *more,
    ), ["person_id", "gene", "v", "ts", "run_label", *more])


def comparison_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only log: several versions of a (person, gene) under two run labels."""
    return log_calls(log_lines(spark, sf_dir))


def assembly_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """person_id, gene (HLA- prefix), asm_1, asm_2 with literal NA and "new" tokens."""
    df = _haplotypes(_with_genes(persons(spark, sf_dir)))
    z = (F.col("person_id") * 41 + F.col("g") * 13) % 17
    star = F.concat(F.col("gene"), F.lit("*"))
    return _once(df.where(z != 0).select(
        "person_id", F.concat(F.lit("HLA-"), F.col("gene")).alias("gene"),
        F.when(z == 1, "NA").when(z == 2, F.concat(star, F.col("f1"), F.lit(":new")))
        .when(z == 3, F.concat(star, F.lit("new")))
        .otherwise(F.concat(star, F.col("h1"), F.lit(":01:01"))).alias("asm_1"),
        F.when(z.isin(1, 4), "NA")
        .when(z == 5, F.concat(star, F.col("f2"), F.lit(":98:01:01")))
        .otherwise(F.concat(star, F.col("h2"), F.lit(":01:02"))).alias("asm_2"),
    ), ["person_id"])


def assembly_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """person_id, gene, hap, template_distance (text), template_warning, as annotation rows."""
    df = _with_genes(persons(spark, sf_dir).select("person_id"))
    df = df.withColumn("hap", F.explode(F.array(F.lit(1), F.lit(2))))
    p, g, h = F.col("person_id"), F.col("g"), F.col("hap")
    return df.where((p + g * 5 + h) % 37 != 0).select(
        "person_id", "gene", "hap",
        F.when((p * 5 + g + h) % 43 == 0, "bad")
        .otherwise(((p * 23 + g * h) % 6).cast("string")).alias("template_distance"),
        F.when((p * 7 + g + h) % 31 == 0, "partial_CDS").otherwise("NA").alias("template_warning"),
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named alleles: allele_id, gene, allele_full, first_release. Derived from the distinct
    haplotype indexes of the persons, with some left out and some never observed added."""
    df = _haplotypes(_with_genes(persons(spark, sf_dir)))
    seen = df.select("g", "gene", F.col("i1").alias("i")).unionByName(
        df.select("g", "gene", F.col("i2").alias("i"))).distinct()
    variants = seen.withColumn("k", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)]))).where(
        (F.col("i") * 5 + F.col("g")) % 13 != 0)
    n = F.col("g") * 1000 + F.col("i") * 10 + F.col("k")
    return variants.select(
        F.concat(F.lit("HLA"), F.lpad(n.cast("string"), 5, "0")).alias("allele_id"), "gene",
        F.concat(
            _two(F.floor(F.col("i") / 4) + 1), F.lit(":"),
            _two(F.col("i") % 4 + 1 + F.when(F.col("k") == 3, 10).otherwise(0)),
            F.lit(":"), _two(F.col("k")), F.lit(":01"),
        ).alias("allele_full"),
        (F.lit(2000) + (F.col("i") * 7 + F.col("k") * 3 + F.col("g")) % 16 * 100).cast("int")
        .alias("first_release"),
    )


def catalogue_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide release history: one column per release code, the name in every release since the
    first one. Releases are every hundredth code from 2000 to 3500."""
    releases = [2000 + 100 * i for i in range(16)]
    named = with_once(catalogue(spark, sf_dir), {
        "first_release": F.col("first_release"),
        "name": F.concat(F.col("gene"), F.lit("*"), F.col("allele_full")),
    })
    return named.select("allele_id", *[
        F.when(F.col("first_release") <= r, F.col("name")).alias(str(r)) for r in releases])


FILE_COLUMNS = ["main_bam", "tagged_bam", "main_bam_index", "hap1_fa", "hap2_fa", "hap1_paf",
                "hap2_paf", "note"]
FA_COLUMNS, PAF_COLUMNS = ["hap1_fa", "hap2_fa"], ["hap1_paf", "hap2_paf"]
BAM_COLUMNS = ["main_bam", "tagged_bam"]
BUCKET = "gs://fixture-bucket/"
REJECTED = "legacy-fixture"


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse file manifest, 0-n rows per person: row_id, person_id, center, platform and URIs.
    The row comes from a line item, the person is its order."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey",
                                                 "l_linenumber", "l_quantity")
    li = li.groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_partkey").alias("part"), F.max("l_suppkey").alias("supp")
    )
    p, v, k, s = F.col("l_orderkey"), F.col("l_linenumber"), F.col("part"), F.col("supp")
    stem = F.concat(F.lit("pooled/"), p.cast("string"), F.lit("_"), v.cast("string"))
    li = li.withColumns({"stem": stem, "m0": k * 3 + s})
    stem, m0 = F.col("stem"), F.col("m0")

    def uri(name: str, mod: int, ending: str) -> Column:
        m = (m0 + v * mod) % 11
        bucket = F.when(m == 2, f"gs://{REJECTED}/").when(m == 3, "gs://other-bucket/").when(
            m == 4, "").otherwise(BUCKET)
        return F.when(m == 0, None).when(m == 1, "").otherwise(
            F.concat(bucket, stem, F.lit(f".{name}{ending}")))

    return _once(li.select(
        (p * 10 + v).alias("row_id"), p.alias("person_id"),
        F.concat(F.lit("C"), (s % 4).cast("string")).alias("center"),
        F.element_at(F.array(*[F.lit(x) for x in ("revio", "sequel2e", "sequel2", "ont")]),
                     (k % 4 + 1).cast("int")).alias("platform"),
        uri("main", 1, ".bam").alias("main_bam"), uri("tagged", 2, ".bam").alias("tagged_bam"),
        uri("main", 1, ".bam.bai").alias("main_bam_index"),
        uri("hap1", 3, ".fa.gz").alias("hap1_fa"), uri("hap2", 3, ".FA.gz").alias("hap2_fa"),
        uri("hap1", 5, ".paf").alias("hap1_paf"), uri("hap2", 6, ".paf").alias("hap2_paf"),
        F.when(k % 2 == 0, F.concat(F.lit("batch "), s.cast("string"))).alias("note"),
    ), ["person_id"])


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket listing: every path of the manifest that exists. A path names its row and column, so none
    comes twice."""
    m = manifest(spark, sf_dir)
    paths = m.select("row_id", F.explode(F.array(
        *[F.col(c) for c in (*BAM_COLUMNS, *FA_COLUMNS, *PAF_COLUMNS)])).alias("u"))
    ok = (F.length("u") + F.col("row_id")) % 5 != 0
    return paths.where(ok).select(relative_path("u", BUCKET).alias("path")).where(F.col("path").isNotNull())


def cram_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("person_id")
    return persons(spark, sf_dir).where(p % 7 != 3).select(
        "person_id",
        F.concat(F.when(p % 13 == 0, f"gs://{REJECTED}/").otherwise(BUCKET), F.lit("cram/"),
                 p.cast("string"), F.lit(".cram")).alias("cram_uri"),
    )


QC_COLUMNS = ["alignment_rate_pct", "quality_score", "mrna_pct", "ribosomal_pct", "insert_size"]


def rna_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-sample metrics; a metric is null where a modulus says so."""
    li = table(spark, sf_dir, "lineitem")
    k, s = F.col("l_partkey"), F.col("l_suppkey")
    return li.select(
        F.col("l_orderkey").alias("person_id"), F.col("l_linenumber").alias("v"),
        F.when(k % 17 != 0, F.col("l_quantity") * 2).alias("alignment_rate_pct"),
        F.when(k % 19 != 1, F.col("l_discount") * 100).alias("quality_score"),
        F.when(s % 11 != 2, F.col("l_tax") * 100 + (k % 7)).alias("mrna_pct"),
        F.when(s % 23 != 3, F.col("l_extendedprice")).alias("ribosomal_pct"),
        F.when(k % 29 != 4, F.col("l_quantity") + (s % 5)).alias("insert_size"),
        F.when(k % 5 == 0, None).when(k % 5 < 4, "Pass").otherwise("Fail").alias("status"),
    )


def paf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment blocks: contig of an order, position from the part, length from the quantity."""
    li = table(spark, sf_dir, "lineitem")
    k, s = F.col("l_partkey"), F.col("l_suppkey")
    tstart = F.lit(29400000) + (k * 2111 + s * 53) % 4300000
    length = F.col("l_quantity").cast("long") * 900
    qstart = (k * 37 + s * 11) % 90000
    return li.select(
        F.concat(F.lit("ctg"), (F.col("l_orderkey") % 1000).cast("string")).alias("qname"),
        F.lit(200000).cast("long").alias("qlen"), qstart.alias("qstart"),
        (qstart + length).alias("qend"),
        F.when(s % 2 == 0, "+").otherwise("-").alias("strand"),
        F.when(k % 10 == 0, "6").when(k % 10 == 1, "chr7").otherwise("chr6").alias("tname"),
        tstart.alias("tstart"), (tstart + length + k % 3).alias("tend"),
        (length - s % 50 * 10).alias("matches"), (length + k % 3).alias("block_len"),
    )


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads: a template name shared by mates, contig and half-open interval."""
    li = table(spark, sf_dir, "lineitem")
    k, s = F.col("l_partkey"), F.col("l_suppkey")
    start = F.lit(29900000) + (k * 1607 + s * 29) % 3300000
    return li.select(
        F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("qname"),
        F.lit("chr6").alias("contig"), start.alias("start"), (start + 150).alias("end"),
    )


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heartbeats with cumulative counters: run = user modulo 10, done and failed counted up over
    the run's events in time order by the event id."""
    ev = table(spark, sf_dir, "events")
    dtype = dict(ev.dtypes)["ts"]
    failed = (F.col("event_type") == "error").cast("long")
    return ev.select(
        (F.col("user_id") % 10).alias("run_id"), "event_id", "ts",
        F.floor(epoch_seconds("ts", dtype)).cast("long").alias("sec"),
        failed.alias("inc_failed"), (1 - failed).alias("inc_done"),
        (F.col("value") % 100).alias("disk_used_pct"),
        (F.lit(100.0) - F.col("value") % 97).alias("mem_avail_pct"),
        F.when(F.col("event_id") % 211 == 0, "complete").when(F.col("event_id") % 307 == 0, "failed")
        .when(F.col("event_id") % 101 == 0, "starting").otherwise("running").alias("run_state"),
    )


def caller_haplotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-haplotype caller rows with the nested candidate and match texts."""
    df = _haplotypes(_with_genes(persons(spark, sf_dir).select("person_id", "cust")))
    df = df.withColumn("ch", F.explode(F.array(F.lit(1), F.lit(2))))
    p, g, ch = F.col("person_id"), F.col("g"), F.col("ch")
    df = df.where(~((ch == 2) & ((p + g) % 29 == 0)))
    stem = F.concat(F.col("gene"), F.lit("*"), F.when(ch == 1, F.col("h1")).otherwise(F.col("h2")))
    df = df.withColumns({"c1": F.concat(stem, F.lit(":01")), "c2": F.concat(stem, F.lit(":02"))})
    c1, c2 = F.col("c1"), F.col("c2")
    n, u, m = (p * 3 + g + ch) % 4, (p + g * 3 + ch) % 7, (p * 5 + g) % 9
    return _once(df.select(
        "person_id", F.concat(F.lit("HLA-"), F.col("gene")).alias("Locus"),
        ch.cast("string").alias("Chromosome"),
        F.when(n == 0, c1).when(n == 1, F.concat_ws(";", c1, c2))
        .when(n == 2, F.concat_ws(";", c1, c2, F.lit("X*1"))).otherwise(F.concat_ws(";;", c1, c2))
        .alias("Genotype"),
        F.when(m == 0, "NA")
        .when(m == 1, F.concat(c1, F.lit("|99|0.995;"), c2, F.lit("|99|0.99")))
        .when(m == 2, F.concat(c1, F.lit("|98.5|0.999;bad|x|y;"), c2, F.lit("|97|0.98")))
        .when(m == 3, F.concat(c2, F.lit("|90|0.9")))
        .otherwise(F.concat(c1, F.lit("|100|1.0;"), c2, F.lit("|99|0.97"))).alias("Match_info"),
        ((p + g * ch) % 50 + 10).cast("string").alias("Reads_num"),
        F.when((p + ch) % 3 == 0, None).otherwise("known").alias("Step1_type"),
        F.when(u == 0, "NA").when(u == 1, c2).otherwise(c1).alias("One_guess"),
    ), ["person_id"])


def stage_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds per stage and haplotype; null where a stage was not reached."""
    df = persons(spark, sf_dir).select("person_id", "cust").withColumn(
        "hap", F.explode(F.array(F.lit(1), F.lit(2))))
    p, c, h = F.col("person_id"), F.col("cust"), F.col("hap")
    look, trim, note = (p + h) % 23 != 0, (p + h) % 19 != 1, (p * h + c) % 17 != 2
    return df.select(
        "person_id", "hap",
        F.when(look, ((p * 3 + h) % 50) / 10.0).alias("lookup_seconds"),
        F.when(look & trim, ((p * 7 + c) % 300) / 10.0).alias("trim_seconds"),
        F.when(look & trim & note, ((p * 11 + c * 3 + h) % 9000) / 10.0).alias("annotate_seconds"),
    )


def probe_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resource samples and outcomes of a scaling probe, one row per event."""
    ev = table(spark, sf_dir, "events")
    dtype = dict(ev.dtypes)["ts"]
    return ev.select(
        F.element_at(F.array(F.lit(4), F.lit(8), F.lit(16)), (F.col("user_id") % 3 + 1).cast("int"))
        .alias("concurrency"),
        (F.col("user_id") % 2 + 1).cast("int").alias("threads"),
        F.floor(epoch_seconds("ts", dtype)).cast("long").alias("sec"),
        (F.col("event_type") == "error").cast("int").alias("failed"),
        (F.col("value") % 100).alias("mem_used_pct"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("person_id"), "event_id", (F.col("event_id") % 97 == 0).alias("ok"))


def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given scores with many ties, for the ranking metrics."""
    p, c = F.col("person_id"), F.col("cust")
    return persons(spark, sf_dir).select(
        "person_id", "ancestry", F.col("case").alias("label"),
        (((p * 13 + c * 7) % 400 + F.col("case") * 60) / 500.0).alias("score"))


def insert_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert-size histogram rows: sizes from the quantity and part, one pair per line item."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_quantity").cast("long") * 37 + F.col("l_partkey") % 211).alias("size"),
        F.lit(1).cast("long").alias("pairs"))
