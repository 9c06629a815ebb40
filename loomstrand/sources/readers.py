"""Sequence and graph files as DataFrames: FASTA, FASTQ (plain or gzip) and GFA."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FASTA = (".fasta", ".fasta.gz", ".fa", ".fa.gz")
FASTQ = (".fastq", ".fastq.gz", ".fq", ".fq.gz")


def file_format(path: str) -> str:
    """'fasta' or 'fastq' by suffix (case counts); ValueError otherwise."""
    for name, suffixes in (("fasta", FASTA), ("fastq", FASTQ)):
        if path.endswith(suffixes):
            return name
    raise ValueError(f"file {path} has unsupported format extension (valid extensions: {', '.join((*FASTA, *FASTQ))})")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(place, name, seq, qual): records are cut at '>' after a line end, so that '>' may stand in a header."""
    text = spark.read.option("lineSep", "\n>").text(path).withColumn("place", F.monotonically_increasing_id())
    record = F.regexp_replace("value", r"^>", "")
    head = F.regexp_extract(record, r"^([^\n]*)", 1)
    rows = text.select("place", F.split(F.trim(F.regexp_replace(head, "\r", "")), r"\s")[0].alias("name"), F.upper(F.regexp_replace(F.regexp_replace(record, r"^[^\n]*", ""), r"\s", "")).alias("seq"), F.lit(None).cast("string").alias("qual"))
    return rows.where("name <> '' or seq <> ''")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(place, name, seq, qual) of records of four lines. Lines are numbered within their partition; partitions begin at
    any line, so a partition's first line number comes from the lines before it. A quality line may begin with '@'."""
    lines = spark.read.text(path).where("value <> ''").select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"), F.regexp_replace("value", "\r$", "").alias("value"))
    counts = lines.groupBy("part").count()
    before = F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    number = F.col("base") + (F.col("place") - F.shiftleft(F.col("part").cast("long"), 33))
    lines = lines.join(F.broadcast(base), "part").select(number.alias("n"), "value")  # one row for each partition
    rows = lines.groupBy(F.floor(F.col("n") / 4).alias("place")).agg(*(F.max(F.when(F.col("n") % 4 == k, F.col("value"))).alias(c) for k, c in ((0, "head"), (1, "seq"), (3, "qual"))))
    return rows.select("place", F.split(F.expr("substring(head, 2)"), r"\s")[0].alias("name"), F.upper("seq").alias("seq"), "qual")


def read_sequences(spark: SparkSession, paths: list[str]) -> DataFrame:
    """reads (read_id, name, seq, qual) of all files, ids 0, 1, ... in the order of files and records. A file without a
    record adds nothing; no record at all is an error."""
    from loomstrand.operators.graph import with_dense_ids

    readers = {"fasta": read_fasta, "fastq": read_fastq}
    kinds = [file_format(p) for p in paths]
    if not paths:
        raise ValueError("no input file")
    rows = reduce(DataFrame.unionByName, [readers[k](spark, p).withColumn("file", F.lit(i)) for i, (k, p) in enumerate(zip(kinds, paths, strict=True))])
    found = with_dense_ids(rows, ["file", "place"], "reads").select(F.col("id").cast("long").alias("read_id"), "name", "seq", "qual")
    if found.isEmpty():
        raise ValueError("no sequences in the input")
    return found


def read_gfa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of S and L lines, both strands made up again. An L line of a segment to itself without overlap
    makes it circular; lines whose segment is missing are left out; of equal names the first counts."""
    from loomstrand.functions.columns import reverse_complement
    from loomstrand.operators.graph import with_dense_ids

    lines = spark.read.text(path).withColumn("place", F.monotonically_increasing_id()).withColumn("f", F.split("value", "\t"))
    s = lines.where(F.col("f")[0] == "S").groupBy(F.col("f")[1].alias("name")).agg(F.min_by(F.struct(F.col("f")[2].alias("seq"), F.regexp_extract("value", r"\tRC:i:(\d+)", 1).alias("rc")), "place").alias("s"), F.min("place").alias("place"))
    s = with_dense_ids(s, ["place"], "gfa-nodes").select((2 * F.col("id")).alias("id"), "name", "s.seq", F.greatest(F.col("s.rc").try_cast("long"), F.lit(1)).alias("count"))
    links = lines.where(F.col("f")[0] == "L").select("place", F.col("f")[1].alias("a"), F.col("f")[2].alias("sa"), F.col("f")[3].alias("b"), F.col("f")[4].alias("sb"), F.regexp_extract(F.col("f")[5], r"^(\d+)M", 1).try_cast("long").alias("overlap"))
    loops = links.where("a = b and overlap = 0").select(F.col("a").alias("name"), F.lit(True).alias("circular")).distinct()
    s = s.join(loops, "name", "left").withColumn("circular", F.coalesce("circular", F.lit(False)))
    both = F.array(F.struct(F.col("id"), F.col("seq")), F.struct((F.col("id") + 1).alias("id"), reverse_complement(F.col("seq")).alias("seq")))
    nodes = s.select("name", "count", "circular", F.explode(both).alias("n")).select("n.id", "name", "n.seq", F.col("count").cast("long").alias("count"), "circular", F.lit(False).alias("unitig"), F.lit(0).cast("long").alias("coverage"), F.array("name").alias("names"), F.array().cast("array<long>").alias("transitive"))
    end = s.select("name", "id", F.length("seq").cast("long").alias("len"))
    e = links.where("not (a = b and overlap = 0)").join(end.select(F.col("name").alias("a"), F.col("id").alias("ia"), F.col("len").alias("la")), "a").join(end.select(F.col("name").alias("b"), F.col("id").alias("ib"), F.col("len").alias("lb")), "b")
    e = with_dense_ids(e, ["place"], "gfa-edges").withColumns({"tail": F.col("ia") + (F.col("sa") == "-").cast("long"), "head": F.col("ib") + (F.col("sb") == "-").cast("long")})
    pair = F.array(F.struct((2 * F.col("id")).alias("id"), F.col("tail"), F.col("head"), (F.col("la") - F.col("overlap")).alias("length")), F.struct((2 * F.col("id") + 1).alias("id"), F.col("head").bitwiseXOR(F.lit(1)).alias("tail"), F.col("tail").bitwiseXOR(F.lit(1)).alias("head"), (F.col("lb") - F.col("overlap")).alias("length")))
    return nodes, e.select(F.explode(pair).alias("e")).select("e.*", F.lit(0.0).alias("weight"))
