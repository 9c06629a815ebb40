"""Exports: FASTA, GFA, CSV and JSON lines, and Parquet checkpoints of an assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstrand.functions.columns import identity, pair_of
from loomstrand.operators.graph import degrees

SIGN = lambda c: F.when(F.col(c) % 2 == 0, "+").otherwise("-")


def fasta_lines(unitigs: DataFrame) -> DataFrame:
    return unitigs.select("id", F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value"))


def listed_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Even nodes but for single reads without an edge."""
    deg = degrees(edges).select(F.col("node").alias("id"), F.lit(True).alias("linked"))
    return nodes.where("id % 2 = 0").join(deg, "id", "left").where("count > 1 or linked")


def _ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    side = lambda k: nodes.select(F.col("id").alias(k), F.col("name").alias(f"{k}_name"), F.col("count").alias(f"{k}_count"), F.length("seq").cast("long").alias(f"{k}_len"))
    return edges.join(side("tail"), "tail").join(side("head"), "head")


def link_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    rows = _ends(edges.where("id % 2 = 0"), nodes)
    return rows.select(F.lit(1).alias("section"), "id", F.concat_ws("\t", F.lit("L"), "tail_name", SIGN("tail"), "head_name", SIGN("head"), F.concat((F.col("tail_len") - F.col("length")).cast("string"), F.lit("M"))).alias("value"))


def gfa_lines(nodes: DataFrame, edges: DataFrame, depth: bool = True) -> DataFrame:
    """(section, id, value): S lines (and a 0M loop after a circular one), then L lines."""
    listed = listed_nodes(nodes, edges)
    tags = [F.concat(F.lit("LN:i:"), F.length("seq").cast("string")), F.concat(F.lit("RC:i:"), F.col("count").cast("string"))] + [F.concat(F.lit("dp:f:"), F.col("coverage").cast("string"))] * depth
    s = F.concat_ws("\t", F.lit("S"), "name", "seq", *tags)
    loop = F.concat_ws("\t", F.lit("L"), "name", F.lit("+"), "name", F.lit("+"), F.lit("0M"))
    rows = listed.select(F.lit(0).alias("section"), "id", F.when(F.col("circular"), F.concat_ws("\n", s, loop)).otherwise(s).alias("value"))
    return rows.unionByName(link_lines(nodes, edges))


def unitig_gfa_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """S lines with a colour and an A line for each read in them, then L lines."""
    listed = listed_nodes(nodes, edges)
    s = F.concat_ws("\t", F.lit("S"), "name", "seq", F.concat(F.lit("LN:i:"), F.length("seq").cast("string")), F.concat(F.lit("RC:i:"), F.col("count").cast("string")), F.lit("CL:z:orange"))
    a = F.array_join(F.transform("names", lambda n: F.concat(F.lit("\nA\t"), n)), "")
    return listed.select(F.lit(0).alias("section"), "id", F.concat(s, a).alias("value")).unionByName(link_lines(nodes, edges))


def csv_lines(nodes: DataFrame, edges: DataFrame, similarity: bool = False, names: bool = False, piles: DataFrame | None = None) -> DataFrame:
    """(section, id, value): node pairs, all edges, circular nodes. The last cell of a node pair has its name and a space
    if `names`, and with `piles` begin and end of the read's valid region (contracted nodes have none); else a dash."""
    label = lambda i, n, c: F.concat(i.cast("string"), F.lit(" ["), (i / 2).cast("long").cast("string"), F.lit("] LN:i:"), n.cast("string"), F.lit(" RC:i:"), c.cast("string"))
    listed, n = listed_nodes(nodes, edges), F.length("seq").cast("long")
    own = label(F.col("id"), n, F.col("count"))
    named = F.concat("name", F.lit(" ")) if names else F.lit("")
    region = F.lit("")
    if piles is not None:
        of_read = F.when((F.col("count") == 1) & ~F.col("unitig"), (F.col("id") / 2).cast("long"))
        listed = listed.withColumn("_read", of_read).join(piles.select(F.col("read_id").alias("_read"), F.concat_ws(" ", "p_begin", "p_end").alias("_region")), "_read", "left")
        region = F.coalesce("_region", F.lit(""))
    last = F.concat(named, region)
    pairs = listed.select(F.lit(0).alias("section"), "id", F.concat_ws(",", own, label(pair_of(F.col("id")), n, F.col("count")), F.lit("0"), F.when(last == "", "-").otherwise(last)).alias("value"))
    rows = _ends(edges, nodes)
    cells = [F.col("id").cast("string"), F.col("length").cast("string"), F.format_string("%.6f", "weight")]
    if similarity:
        text = lambda k: nodes.select(F.col("id").alias(k), F.col("seq").alias(f"{k}_seq"))
        rows = rows.join(text("tail"), "tail").join(text("head"), "head").withColumn("_l", F.expr("substring(tail_seq, length + 1)"))
        cells.append(F.format_string("%.6f", identity(F.col("_l"), F.substring("head_seq", F.lit(1), F.length("_l")))))
    link = rows.select(F.lit(1).alias("section"), "id", F.concat_ws(",", label(F.col("tail"), F.col("tail_len"), F.col("tail_count")), label(F.col("head"), F.col("head_len"), F.col("head_count")), F.lit("1"), F.concat_ws(" ", *cells)).alias("value"))
    loops = listed.where("circular").select(F.lit(2).alias("section"), "id", F.concat_ws(",", own, own, F.lit("1"), F.lit("-")).alias("value"))
    return pairs.unionByName(link).unionByName(loops)


def pile_json(piles: DataFrame) -> DataFrame:
    """One JSON object for each valid pile, keyed by its read."""
    fields = [c for c in piles.columns if c != "read_id"]
    return piles.where("not is_invalid").select("read_id", F.concat(F.lit('{"'), F.col("read_id").cast("string"), F.lit('":'), F.to_json(F.struct(*fields)), F.lit("}")).alias("value"))


def save_lines(lines: DataFrame, path: str) -> None:
    """Lines in order of section and id, as text files of that order."""
    keys = [c for c in ("section", "id", "read_id") if c in lines.columns]
    lines.repartitionByRange(*keys).sortWithinPartitions(*keys).select("value").write.mode("overwrite").text(path)


def save_state(folder: str, stage: int, tables: dict[str, DataFrame]) -> None:
    """A restartable checkpoint: the tables first, the stage marker last."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/stage={stage}/{name}")
    spark.createDataFrame([(stage, sorted(tables))], "stage int, tables array<string>").coalesce(1).write.mode("append").parquet(f"{folder}/stages")


def load_state(spark: SparkSession, folder: str) -> tuple[int, dict[str, DataFrame]] | None:
    """The last complete stage and its tables; None where there is none."""
    from pyspark.errors import AnalysisException

    try:
        last = spark.read.parquet(f"{folder}/stages").orderBy(F.desc("stage")).first()
    except AnalysisException:
        return None
    return (last["stage"], {t: spark.read.parquet(f"{folder}/stage={last['stage']}/{t}") for t in last["tables"]}) if last else None
