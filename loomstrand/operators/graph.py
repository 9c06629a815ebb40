"""The string graph as two DataFrames: nodes and edges, both in strand pairs (x and x ^ 1)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstrand.functions.columns import comparable, pair_of, reverse_complement


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        import tempfile

        root = f"file://{tempfile.mkdtemp(prefix='loomstrand-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_copy(df: DataFrame, name: str) -> DataFrame:
    """df, written to the folder that driver and executors share and read again, so that loops neither repeat work nor
    depend on executors that may be lost."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_dense_ids(df: DataFrame, order: list[str], name: str = "dense") -> DataFrame:
    """df with `id`: 0, 1, 2, ... in this order. Rows are dealt by ranges and numbered within them; only the ranges'
    counts meet in one place."""
    dealt = shared_copy(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    ranked = dealt.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    counts = dealt.groupBy("_part").count()
    before = F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_base"))
    return ranked.join(F.broadcast(base), "_part").withColumn("id", F.col("_base") + F.col("_k") - 1).drop("_part", "_k", "_base")


def node_pairs(reads: DataFrame) -> DataFrame:
    """Two nodes of each read (read_id, name, seq): 2 * read_id for the read, one more for its reverse complement."""
    both = F.array(F.struct((2 * F.col("read_id")).alias("id"), F.col("seq").alias("seq")), F.struct((2 * F.col("read_id") + 1).alias("id"), reverse_complement(F.col("seq")).alias("seq")))
    rows = reads.select("read_id", "name", F.explode(both).alias("n"))
    return rows.select(F.col("n.id").alias("id"), "read_id", "name", F.col("n.seq").alias("seq"), F.length("n.seq").cast("long").alias("len"), F.lit(1).cast("long").alias("count"))


def edge_pairs(dovetails: DataFrame) -> DataFrame:
    """(tail, head, length) of finalised overlaps, both strands. tail and head are node ids 2 * read_id (+ 1 on the other
    strand); length is the part of the tail before the head."""
    lhs, rhs = 2 * F.col("lhs_id"), 2 * F.col("rhs_id") + F.when(F.col("strand"), 0).otherwise(1)
    l_rest, r_rest = F.col("lhs_length") - F.col("lhs_end"), F.col("rhs_length") - F.col("rhs_end")
    ahead, behind = F.col("lhs_begin") - F.col("rhs_begin"), F.col("rhs_begin") - F.col("lhs_begin")
    forth = F.when(F.col("score") == 3, F.struct(lhs.alias("tail"), rhs.alias("head"), ahead.alias("length"))).otherwise(F.struct(rhs.alias("tail"), lhs.alias("head"), behind.alias("length")))
    back = F.when(F.col("score") == 3, F.struct(pair_of(rhs).alias("tail"), pair_of(lhs).alias("head"), (r_rest - l_rest).alias("length"))).otherwise(
        F.struct(pair_of(lhs).alias("tail"), pair_of(rhs).alias("head"), (l_rest - r_rest).alias("length"))
    )
    return dovetails.select(F.explode(F.array(forth, back)).alias("e")).select("e.tail", "e.head", "e.length")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, outdegree, indegree) of every node with an edge."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("tail").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("head").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.o").alias("outdegree"), F.sum("e.i").alias("indegree"))


def is_junction() -> Column:
    return (F.col("outdegree") > 1) | (F.col("indegree") > 1)


def is_tip(count: Column) -> Column:
    return (F.col("outdegree") > 0) & (F.col("indegree") == 0) & (count < 6)


def transitive_edges(edges: DataFrame) -> DataFrame:
    """Distinct ids of edges a -> c that a -> b -> c explains within 12 % of length, and of their pairs."""
    e1, e2 = edges.select(F.col("tail").alias("a"), F.col("head").alias("b"), F.col("length").alias("l1")), edges.select(F.col("tail").alias("b"), F.col("head").alias("c"), F.col("length").alias("l2"))
    last = edges.groupBy("tail", "head").agg(F.max_by(F.struct("id", "length"), "id").alias("e")).select(F.col("tail").alias("a"), F.col("head").alias("c"), "e.id", F.col("e.length").alias("l3"))
    found = e1.join(e2, "b").join(last, ["a", "c"]).where(comparable(F.col("l1") + F.col("l2"), F.col("l3")))
    return found.select(F.explode(F.array("id", pair_of(F.col("id")))).alias("id")).distinct()


def remove_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select("id"), "id", "left_anti")


def isolated_nodes(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Ends of removed edges that no edge touches any more."""
    ends = lambda df: df.select(F.explode(F.array("tail", "head")).alias("node")).distinct()
    return ends(edges.join(ids.select("id"), "id", "left_semi")).join(ends(remove_edges(edges, ids)), "node", "left_anti")


def long_edges(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """Distinct ids of edges over twice as heavy as the lightest with their tail, and of their pairs."""
    lightest = F.min(weight).over(Window.partitionBy("tail"))
    return edges.withColumn("_least", lightest).where(F.col(weight) > 2 * F.col("_least")).select(F.explode(F.array("id", pair_of(F.col("id")))).alias("id")).distinct()


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node that each reaches) of the edges (a, b): roots hang on lesser roots, and paths are cut."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        if not apart.any():
            return nodes, nodes[root]
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while ((up := root[root]) != root).any():
            root = up


#: Edges, seen from both ends, up to which a task settles all components; more are settled by rounds of joins.
ONE_TASK = 1 << 18


def connected_components(pairs: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the least node that each node of the pairs (a, b) reaches. Few pairs are settled by one task; of
    others, labels spread along edges and then jump to their label's label; each round is written to the shared folder."""
    both = shared_copy(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null").distinct(), f"{name}-edges")
    if both.count() <= ONE_TASK:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if read := list(batches):
                edges = pa.Table.from_batches(read)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in least_reached(*(edges[c].to_numpy() for c in ("a", "b")))], names=["node", "component"])

        return shared_copy(both.select(F.col("a").cast("long"), F.col("b").cast("long")).coalesce(1).mapInArrow(run, "node long, component long"), name)
    labels = shared_copy(both.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "node"), name)
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near")).withColumnRenamed("a", "node")
        spread = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = shared_copy(spread.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("next", "component")).alias("component")), name)
        labels = new.select("node", "component")
        if new.where("component <> old").isEmpty():
            return labels


def graph_components(edges: DataFrame) -> DataFrame:
    """(node, component) over even node ids; both strands of a node are one."""
    even = lambda c: F.col(c) - F.col(c) % 2
    return connected_components(edges.select(even("tail").alias("a"), even("head").alias("b")), "graph-components")
