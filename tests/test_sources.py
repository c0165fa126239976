import gzip
import random

import pytest
from pyspark.sql import functions as F

from haplodeck.operators import intervals as iv
from haplodeck.plans import readers
from haplodeck.sources import alignments, annotations, callers, logs, sinks, tables


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    if path.suffix == ".gz":
        with gzip.open(path, "wt") as f:
            f.write(text)
    else:
        path.write_text(text)
    return str(path)


def test_genotypes_and_ancestry(spark, tmp_path):
    g = write(tmp_path / "g.tsv", "research_id\tA_1\tA_2\tX_1\n10\tA*01:01\tNA\tq\n11\t\tA*02:01\tq\n")
    rows = {tuple(r) for r in tables.read_genotypes(spark, g, allow_missing=True).collect()}
    assert rows == {("10", "A", "A*01:01", "NA"), ("11", "A", None, "A*02:01")}
    assert ("10", "A", "A*01:01", None) in {
        tuple(r) for r in tables.read_genotypes(spark, g, genes=["A"], keep_na=False).collect()}
    with pytest.raises(ValueError):
        tables.read_genotypes(spark, g, id_col="nope")
    a = write(tmp_path / "a.csv", "s,ancestry_pred,pca_features\n10,eur,\"[1.5, -2]\"\n")
    assert tuple(tables.read_ancestry(spark, a).first()) == ("10", "eur", "[1.5, -2]")
    with pytest.raises(ValueError):
        tables.read_ancestry(spark, g)


def test_catalogue_history_phenotype(spark, tmp_path):
    c = write(tmp_path / "c.txt", "# date\nAlleleID,Allele\nH1,A*01:01:01\nH2,MICA*001\nbad\nH3,B*07:02\n")
    assert {tuple(r) for r in tables.read_catalogue(spark, c).collect()} == {
        ("H1", "A", "01:01:01"), ("H3", "B", "07:02")}
    h = write(tmp_path / "h.txt", "# v\nHLA_ID,3650,116\nH1,A*01:01:01,\n")
    assert tables.read_history(spark, h).columns == ["allele_id", "3650", "116"]
    p = write(tmp_path / "p.csv", "person_id,case\n1,0\n")
    assert tuple(tables.read_phenotype(spark, p).first()) == ("1", 0)
    with pytest.raises(ValueError):
        tables.read_phenotype(spark, write(tmp_path / "q.csv", "x,case\n1,0\n"))
    assert tables.exactly_one(spark, str(tmp_path / "p*.csv")).endswith("p.csv")
    with pytest.raises(ValueError):
        tables.exactly_one(spark, str(tmp_path / "*.txt"))


def test_manifest(spark, tmp_path):
    m = write(tmp_path / "m.tsv", "research_id\tbam\tcenter\n1\tgs://b/x.bam\tC\n")
    df = tables.read_manifest(spark, m, ["bam"])
    assert df.columns == ["row_id", "person_id", "bam"]
    with pytest.raises(ValueError, match="fasta"):
        tables.read_manifest(spark, m, ["fasta"])


def test_caller_files(spark, tmp_path):
    for p in ("p1", "p2"):
        write(tmp_path / "sr" / p / "r.txt", f"# v\nSample\tHLA_A_1\tHLA_A_2\n{p}\tA*01:01\t-\n")
        write(tmp_path / "lr" / p / "r.txt",
              "# v\nLocus\tChromosome\tGenotype\tMatch_info\tReads_num\tStep1_type\tOne_guess\n"
              "HLA-A\t1\tA*01:01\tA*01:01|9|0.99\t5\tx\tA*01:01\nHLA-A\t2\tA*02:01\tNA\t6\tx\tNA\n")
        write(tmp_path / "t" / p / "time.txt", "\nreal\t2m30s\nuser\t0m1s\n")
    wide = callers.read_wide_results(spark, str(tmp_path / "sr/*/r.txt"), ["A", "B"])
    assert ("p2", "A", "A*01:01", "-") in {tuple(r) for r in wide.collect()}
    assert ("p1", "B", "NA", "NA") in {tuple(r) for r in wide.collect()}
    haps = callers.read_haplotype_results(spark, str(tmp_path / "lr/*/r.txt"))
    assert {(r.person_id, r.hap, r.call) for r in haps.collect()} == {
        (p, h, c) for p in ("p1", "p2") for h, c in ((1, "A*01:01"), (2, "A*02:01"))}
    assert {tuple(r) for r in callers.read_minutes(spark, str(tmp_path / "t/*/time.txt")).collect()} == {
        ("p1", 2.5), ("p2", 2.5)}


GTF = (
    "# head\n"
    'c\ts\tgene\t1\t2\t.\t+\t.\tgene_id "g1"; gene_name "HLA-A"; template_distance 0; template_warning "NA"\n'
    'c\ts\ttranscript\t1\t2\t.\t+\t.\tgene_id "g1"; consensus "A*01:01:new"; template_distance 5; note "x"\n'
    'c\ts\tgene\t1\t2\t.\t+\t.\tgene_id "g2"; gene_name "HLA-B"; allele "B*07:02"; template_warning "partial_CDS"\n'
    'c\ts\tgene\t1\t2\t.\t+\t.\tgene_id "g2"; gene_name "HLA-C"; note "two; parts"; note last\n'
    'c\ts\ttranscript\t1\t2\t.\t+\t.\tgene_id "g2"; template_distance 7\n'
    "short\tline\n"
)


def test_annotations(spark, tmp_path):
    write(tmp_path / "p1" / "out" / "hap1.gtf.gz", GTF)
    write(tmp_path / "p1" / "out" / "hap2.gtf.gz", "# only comments\n")
    write(tmp_path / "p2" / "out" / "hap1.gtf.gz", GTF)
    write(tmp_path / "p2" / "out" / "hap2.gtf.gz", GTF)
    lines = annotations.read_lines(spark, str(tmp_path / "*/out/*.gtf.gz"))
    parsed = annotations.parse_lines(lines)
    attrs = {(r.person_id, r.hap, r.gene): (r.template_distance, r.template_warning, r.note)
             for r in annotations.gene_attributes(parsed, ["template_distance", "template_warning", "note"]).collect()}
    assert attrs[("p1", "hap1", "A")] == ("0", "NA", "x")
    assert attrs[("p1", "hap1", "B")] == (None, "partial_CDS", None)
    assert attrs[("p1", "hap1", "C")] == ("7", None, "last")  # an id takes its latest name
    calls = {(r.person_id, r.hap, r.gene): r.call for r in annotations.gene_calls(parsed).collect()}
    assert calls[("p1", "hap1", "g1")] == "A*01:01:new" and calls[("p1", "hap1", "HLA-B")] == "B*07:02"
    wide = {(r.person_id, r.gene): (r.asm_1, r.asm_2) for r in annotations.assembly_table(
        annotations.gene_calls(parsed)).collect()}
    assert wide[("p1", "HLA-B")] == ("B*07:02", "NA")
    assert [r.person_id for r in annotations.completed_people(lines).collect()] == ["p2"]


def test_alignments(spark, tmp_path):
    row = "ctg\t1000\t10\t210\t+\t6\t9\t29600000\t29600200\t190\t200\t60\ttag:1"
    write(tmp_path / "p1" / "a.paf.gz", row + "\nshort\t1\n")
    paf = alignments.read_paf(spark, str(tmp_path / "*/a.paf.gz"))
    r = paf.first()
    assert paf.count() == 1 and (r.person_id, r.qstart, r.tend, r.mapq) == ("p1", 10, 29600200, 60)
    span = iv.contig_spans(paf, "chr6", 29500000, 33500000, 50, ["person_id", "qname"]).first()
    assert (span.span_start, span.span_end, span.region) == (0, 260, "ctg:1-260")
    s = write(tmp_path / "stats.txt", "SN\tx\nIS\t100\t5\t1\nIS\t101\t7\nIS\t300\t1\n")
    p = iv.weighted_percentiles(alignments.read_insert_sizes(spark, s)).first()
    assert (p.n_pairs, p.p50, p.p95, p.max_size) == (13, 101, 300, 300)


def test_logs_and_sinks(spark, tmp_path):
    head = ",".join(f"c{i}" for i in range(len(logs.LOG_COLUMNS)))
    cells = ["2026-01-02T03:04:05+00:00", "p1", "main", "A"] + ["x"] * 16
    write(tmp_path / "in" / "p1" / "comparison_log.csv", head + "\n" + ",".join(cells) + "\n")
    log = logs.read_comparison_logs(spark, str(tmp_path / "in/*/comparison_log.csv"))
    assert log.first().ts is not None and log.first().lr_step1_2 == "x"
    out = str(tmp_path / "log")
    sinks.append_log(log, out)
    sinks.append_log(log, out)
    assert spark.read.parquet(out).where("run_label = 'main'").count() == 2
    t = str(tmp_path / "t")
    sinks.write_table(log, t)
    with pytest.raises(Exception, match="exist"):
        sinks.write_table(log, t)
    sinks.write_table(log.limit(1), t, overwrite=True)
    new = log.withColumn("sr_1", F.lit("new"))
    sinks.upsert_table(new, t, str(tmp_path / "t2"), ["person_id"])
    assert [r.sr_1 for r in spark.read.parquet(str(tmp_path / "t2")).collect()] == ["new"]
    md = list(sinks.markdown_table(spark.createDataFrame([("a", 1.0), ("b", None)], "k string, v double")))
    assert "| a | 1.00 |" in md[2:] and "| b |  |" in md[2:]
    assert len(list(sinks.markdown_table(spark.range(300)))) == 302


def test_sql_functions(spark):
    from haplodeck.functions.sql import register
    register(spark)
    r = spark.sql("SELECT two_field('A*01:02:03') AS a, allele_depth('A*01:new') AS b, "
                  "allele_fields('A*01:02') AS c, release_name('3650') AS d").first()
    assert (r.a, r.b, list(r.c), r.d) == ("01:02", 1, ["01", "02"], "3.65.0")


def test_one_expression_per_key_equals_the_attribute_list(spark):
    rng = random.Random(4)
    tokens = ["k", "k", "k2", "a", " ", "  ", ";", '"', '""', "x", '"v;w"', '"v"', 'k "z"', "; k ", "k  y z ", 'k "" ']
    texts = ["".join(rng.choice(tokens) for _ in range(rng.randrange(14))) for _ in range(3000)] + ['k "x";' * 900]
    attrs = annotations.attributes("t")
    of_key = F.filter(attrs, lambda a: a["key"] == "k")
    quoted = F.filter(of_key, lambda a: a["quoted"] & (a["value"] != ""))
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(
        annotations._last("t", "k").alias("last"), F.try_element_at(of_key, F.lit(-1))["value"].alias("last_was"),
        annotations._quoted("t", "k").alias("first"), F.get(quoted, F.lit(0))["value"].alias("first_was")).collect()
    assert all(r.last == r.last_was and r.first == r.first_was for r in got)
    assert sum(r.first is not None for r in got) > 100


def test_plain_searches_equal_the_attribute_list(spark):
    rng = random.Random(5)
    tokens = ["k", "k ", "; k ", ";k ", "k2 ", "é", " ", ";", '"', '""', "x", '"v;w"', '"v"', '; k "z"', '; k "k y"', " ; k  y z "]
    texts = ["".join(rng.choice(tokens) for _ in range(rng.randrange(9))) for _ in range(6000)]
    texts += ['k "x"; ' * 900, 'k "x"; ' + 'a "b;"; ' * 900, "k ", "k 1", 'é "ü"; k "ä;"; z 1', 'é "ü; k "; z 1', 'a "b"; k "c', 'k ; k2 "x"']
    of_key = F.filter(annotations.attributes("t"), lambda a: a["key"] == "k")
    got = annotations.with_last(spark.createDataFrame([(t,) for t in texts], "t string"), "t", {"v": "k"}).select(
        "t", "v", F.try_element_at(of_key, F.lit(-1))["value"].alias("was"), annotations._once("t", "k")[1].alias("unclear")).collect()
    assert [r.t for r in got if r.v != r.was] == []
    assert sum(r.unclear is False and r.was is not None for r in got) > 500 and sum(bool(r.unclear) for r in got) > 500


def test_usual_lines_need_no_patterns(spark, data):
    keys = {n: n for n in ("gene_id", "gene_name", "template_distance", "template_warning")}
    text = annotations.parse_lines(readers._annotation_lines(spark, data)).select("text")
    unclear = [annotations._once("text", k)[1] for k in keys]
    assert text.where(F.coalesce(*[F.nullif(u, F.lit(False)) for u in unclear])).isEmpty()


def test_call_lines_are_not_cut_into_lists(spark):
    lines = spark.createDataFrame([(1, "hap1", 1, "")], "person_id long, hap string, line_no long, value string")
    text = annotations.gene_calls(annotations.parse_lines(lines))._jdf.queryExecution().optimizedPlan().toString()
    assert "AS attrs" not in text
