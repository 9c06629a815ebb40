"""Inputs of the registered queries, made of the whole given tables: as DataFrames, and as SQL text for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def reads(spark: SparkSession, d: str) -> DataFrame:
    seq = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), LETTERS, BASES)
    return table(spark, d, "documents").select(F.col("doc_id").alias("read_id"), F.format_string("read%d", "doc_id").alias("name"), seq.alias("seq"))


READS = f"reads as (select doc_id read_id, 'read' || doc_id as name, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{BASES}') seq from documents)"


def piles(spark: SparkSession, d: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size").cast("long")
    return table(spark, d, "part").select(
        key.alias("read_id"), (16 * (key % 20)).alias("p_begin"), (16 * (key % 20 + 78 + size)).alias("p_end"), (key % 17 == 0).alias("is_invalid"),
        (key % 5 == 0).alias("maybe_chimeric"), (10 + size).alias("median"),
    )


PILES = "piles as (select p_partkey read_id, 16*(p_partkey%20) p_begin, 16*(p_partkey%20+78+cast(p_size as bigint)) p_end, p_partkey%17=0 is_invalid, p_partkey%5=0 maybe_chimeric, cast(10+p_size as bigint) median from part)"


def overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of line items of one order; an order has few, so the join stays linear."""
    side = lambda s: table(spark, d, "lineitem").select("l_orderkey", *(F.col(f"l_{c}").cast("long").alias(f"{s}_{c}") for c in ("partkey", "suppkey", "linenumber", "quantity")))
    a, b = side("a"), side("b")
    rows = a.join(b, "l_orderkey").where("a_linenumber < b_linenumber and a_partkey <> b_partkey")
    return rows.select(
        F.col("a_partkey").alias("lhs_id"), (F.col("a_quantity") * 12).alias("lhs_begin"), (F.col("a_quantity") * 12 + 700 + F.col("b_quantity") * 20).alias("lhs_end"),
        F.col("b_partkey").alias("rhs_id"), (F.col("b_quantity") * 12).alias("rhs_begin"), (F.col("b_quantity") * 12 + 700 + F.col("b_quantity") * 20 + (F.col("a_linenumber") - F.col("b_linenumber")) * 5).alias("rhs_end"),
        F.col("a_linenumber").alias("score"), ((F.col("a_suppkey") + F.col("b_suppkey")) % 2 == 0).alias("strand"),
    )


OVERLAPS = """ovl as (select a.l_partkey lhs_id, cast(a.l_quantity as bigint)*12 lhs_begin, cast(a.l_quantity as bigint)*12+700+cast(b.l_quantity as bigint)*20 lhs_end,
  b.l_partkey rhs_id, cast(b.l_quantity as bigint)*12 rhs_begin, cast(b.l_quantity as bigint)*12+700+cast(b.l_quantity as bigint)*20+(a.l_linenumber-b.l_linenumber)*5 rhs_end,
  cast(a.l_linenumber as bigint) score, (a.l_suppkey+b.l_suppkey)%2=0 strand
  from lineitem a join lineitem b on a.l_orderkey=b.l_orderkey and a.l_linenumber<b.l_linenumber and a.l_partkey<>b.l_partkey)"""


def intervals(spark: SparkSession, d: str) -> DataFrame:
    bin_ = F.dayofmonth("ts").cast("long") * 24 + F.hour("ts").cast("long")
    return table(spark, d, "events").select(F.col("user_id").alias("read_id"), bin_.alias("bin"), (1 + F.floor(F.col("value") / 20)).cast("long").alias("span"))


INTERVALS = "cov as (select user_id read_id, cast(extract(day from ts) as bigint)*24+cast(extract(hour from ts) as bigint) bin, cast(1+floor(value/20) as bigint) span from events)"


def edges(spark: SparkSession, d: str) -> DataFrame:
    """A line of parts with short jumps ahead, in strand pairs; ids follow tail and head."""
    from loomstrand.operators.graph import with_dense_ids

    hop = F.col("l_suppkey") % 5
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("t"), (F.col("l_partkey") + 1 + hop).alias("h"), (137 * (1 + hop) + (F.col("l_linenumber").cast("long") * 11 + F.col("l_orderkey")) % 15).alias("length"))
    numbered = with_dense_ids(e.groupBy("t", "h").agg(F.min("length").alias("length")), ["t", "h"], "fx-edges")
    pair = F.array(F.struct((2 * F.col("id")).alias("id"), (2 * F.col("t")).alias("tail"), (2 * F.col("h")).alias("head"), F.col("length")), F.struct((2 * F.col("id") + 1).alias("id"), (2 * F.col("h") + 1).alias("tail"), (2 * F.col("t") + 1).alias("head"), (F.col("length") + 3).alias("length")))
    return numbered.select(F.explode(pair).alias("e")).select("e.id", "e.tail", "e.head", "e.length", (F.col("e.length") * 0.5).alias("weight"))


EDGES = """e0 as (select l_partkey t, l_partkey+1+l_suppkey%5 h, min(137*(1+l_suppkey%5)+(l_linenumber*11+l_orderkey)%15) length from lineitem group by 1, 2),
en as (select *, row_number() over (order by t, h) rn from e0),
edges as (select 2*(rn-1) id, 2*t tail, 2*h head, length, length*0.5::double weight from en union all select 2*(rn-1)+1, 2*h+1, 2*t+1, length+3, (length+3)*0.5::double from en)"""


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """A node pair for each end of an edge; names, counts and letters follow the part number."""
    ends = edges(spark, d).select(F.explode(F.array("tail", "head")).alias("id")).distinct()
    part = F.floor(F.col("id") / 2)
    seq = F.substring(F.repeat(F.translate(F.lpad(part.cast("string"), 8, "0"), "0123456789", "ACGTACGTAC"), 200), 1, 1500)
    return ends.select("id", F.concat(F.lit("n"), part.cast("string")).alias("name"), seq.alias("seq"), (1 + part % 7).alias("count"), (part % 11 == 0).alias("circular"), (part % 3).alias("coverage"), F.array(F.concat(F.lit("read"), part.cast("string"))).alias("names"))


NODES = """nodes as (select id, 'n' || (id // 2) as name, substring(repeat(translate(lpad(cast(id // 2 as varchar), 8, '0'), '0123456789', 'ACGTACGTAC'), 200), 1, 1500) seq,
  1 + (id // 2) % 7 as count, (id // 2) % 11 = 0 circular, (id // 2) % 3 coverage from (select tail id from edges union select head from edges))"""
