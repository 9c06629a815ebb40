"""The assembly as a sequence of DataFrame stages with restartable checkpoints."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstrand.functions.columns import bases, to_bin
from loomstrand.operators import graph as G
from loomstrand.operators import overlaps as O
from loomstrand.operators import piles as P
from loomstrand.operators import prune as R
from loomstrand.operators import sketch as S
from loomstrand.operators import slopes as L
from loomstrand.operators.layout import weighted
from loomstrand.operators.polish import polish_round
from loomstrand.sources import writers as W

log = logging.getLogger("loomstrand")

STAGES = {-5: "start", -4: "piles", -3: "graph", -2: "transitive edges removed", -1: "tips and bubbles removed", 0: "long edges removed"}


@dataclass(frozen=True)
class OverlapConfig:
    k: int = 15
    w: int = 5
    frequency: float = 0.001
    identity: float = 0.0
    max_overlaps: int = 32


@dataclass(frozen=True)
class AlignConfig:
    match: int = 3
    mismatch: int = -5
    gap: int = -4


@dataclass(frozen=True)
class Config:
    overlap: OverlapConfig = OverlapConfig()
    align: AlignConfig = AlignConfig()
    polish_rounds: int = 2
    layout_rounds: int = 16
    min_unitig_size: int = 9999
    break_ties: bool = True
    checkpoints: str | None = None
    resume: bool = False


@dataclass
class Assembly:
    """What the stages hand on."""

    stage: int
    piles: DataFrame
    nodes: DataFrame
    edges: DataFrame

    @property
    def unitigs(self) -> DataFrame:
        return self.nodes.where((F.col("id") % 2 == 0) & F.col("unitig"))


def _keep(name: str, df: DataFrame) -> DataFrame:
    log.info("stage %s", name)
    return G.shared_copy(df, name)


def find_overlaps(reads: DataFrame, config: OverlapConfig = OverlapConfig()) -> DataFrame:
    """Each overlapping pair once, lower read id on the left."""
    return _keep("overlaps", S.overlaps(reads, config.k, config.w, True, config.frequency))


def find_overlaps_and_create_piles(reads: DataFrame, config: OverlapConfig = OverlapConfig()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(overlaps, piles, runs): both views of each overlap cut to the longest per read; coverage counts all of them."""
    once = find_overlaps(reads, config)
    runs = _keep("coverage", P.coverage_runs(P.coverage_intervals(once)))
    piles = reads.select("read_id", to_bin(F.length("seq")).cast("long").alias("bins"))
    return _keep("top-overlaps", O.longest_per_read(O.doubled(once), config.max_overlaps)), piles, runs


def trim_and_annotate_piles(piles: DataFrame, runs: DataFrame, overlaps: DataFrame, coverage: int = 4) -> tuple[DataFrame, DataFrame]:
    """(piles, overlaps): valid regions, medians and chimeric regions; overlaps of invalid reads go."""
    regions = P.valid_regions(runs, coverage).where(P.is_valid(F.col("bins"))).drop("bins")
    valid = piles.join(regions, "read_id")
    notes = L.annotate(valid.withColumn("bins", F.greatest("bins", "end")), runs)
    found = piles.join(regions, "read_id", "left").join(notes, "read_id", "left")
    found = found.select(
        "read_id", "bins", "begin", "end", (F.coalesce("begin", F.lit(0)) * 16).alias("p_begin"), (F.coalesce("end", F.lit(0)) * 16).alias("p_end"), F.col("begin").isNull().alias("is_invalid"),
        "median", "chimeric", (F.coalesce(F.size("chimeric"), F.lit(0)) > 0).alias("maybe_chimeric"), F.lit(False).alias("is_contained"), F.lit(False).alias("is_chimeric"),
    )
    found = _keep("piles", found)
    return found, O.without_reads(overlaps, found.where("is_invalid"))


def _same_extent(clipped: DataFrame) -> DataFrame:
    """Overlaps whose reads contain each other count for the higher id alone."""
    both = clipped.where((F.col("lhs_begin") == F.col("lb")) & (F.col("lhs_end") == F.col("le")) & (F.col("rhs_begin") == F.col("rb")) & (F.col("rhs_end") == F.col("re")))
    return clipped.join(both.where("lhs_id < rhs_id").select("lhs_id", "rhs_id").distinct(), ["lhs_id", "rhs_id"], "left_anti")


def resolve_contained_reads(piles: DataFrame, overlaps: DataFrame, reads: DataFrame | None = None, config: OverlapConfig = OverlapConfig(), break_ties: bool = True) -> tuple[DataFrame, DataFrame]:
    """(piles, overlaps) without reads that lie within another that is not maybe chimeric."""
    clipped = O.clip(overlaps, piles)
    if config.identity > 0 and reads is not None:
        side = lambda s: reads.select(F.col("read_id").alias(f"{s}_id"), F.col("seq").alias(f"{s}_seq"))
        text = clipped.join(side("lhs"), "lhs_id").join(side("rhs"), "rhs_id")
        cut = lambda s: bases(F.col(f"{s}_seq"), F.col(f"{s}_begin").cast("int"), (F.col(f"{s}_end") - F.col(f"{s}_begin")).cast("int"))
        from loomstrand.functions.columns import reverse_complement

        text = text.withColumn("_l", cut("lhs")).withColumn("_r", F.when(F.col("strand"), cut("rhs")).otherwise(reverse_complement(cut("rhs"))))
        clipped = O.similar(text, "_l", "_r", config.identity).drop("_l", "_r", "lhs_seq", "rhs_seq")
    judged = _same_extent(clipped) if break_ties else clipped
    inner = _keep("contained", O.contained_reads(judged, piles))
    left = O.without_reads(clipped.select(*O.COLUMNS), inner)
    return _mark(piles, inner, "is_contained"), _keep("uncontained-overlaps", left)


def _mark(piles: DataFrame, reads: DataFrame, flag: str) -> DataFrame:
    marked = piles.join(reads.select("read_id", F.lit(True).alias("_m")), "read_id", "left")
    return _keep("piles", marked.withColumns({flag: F.col(flag) | F.coalesce("_m", F.lit(False)), "is_invalid": F.col("is_invalid") | F.coalesce("_m", F.lit(False))}).drop("_m"))


def resolve_chimeric_sequences(piles: DataFrame, runs: DataFrame, overlaps: DataFrame, break_ties: bool = True) -> tuple[DataFrame, DataFrame]:
    """(piles, overlaps): chimeric reads cut at the regions that fall under the global median, then containment again."""
    valid = piles.where(~F.col("is_invalid"))
    median = P.upper_median(valid.where("median > 0"), [], "median").first()
    if median is not None and median[0] is not None:
        whole = int(median[0])
        fields = [T.StructField("read_id", T.LongType()), T.StructField("nb", T.LongType()), T.StructField("ne", T.LongType()), T.StructField("bad", T.BooleanType()), T.StructField("cut", T.BooleanType()), T.StructField("left", L.REGION)]

        def each(read_id, cov, begin, end, regions):
            b, e, bad, cut, left = L.cut_chimera(cov, begin, end, [(r["first"], r["last"]) for r in regions], whole)
            return read_id, b, e, bad, cut, L.as_rows(left)

        cut = L.map_histograms(L.with_histograms(valid.where("maybe_chimeric").select("read_id", F.greatest("bins", "end").alias("bins"), "begin", "end", "chimeric"), runs), ["chimeric"], T.StructType(fields), each)
        joined = piles.join(cut, "read_id", "left")
        piles = joined.withColumns({
            "begin": F.coalesce("nb", "begin"), "end": F.coalesce("ne", "end"), "is_invalid": F.col("is_invalid") | F.coalesce("bad", F.lit(False)), "is_chimeric": F.coalesce("cut", F.lit(False)),
            "maybe_chimeric": F.coalesce(F.size("left") > 0, F.col("maybe_chimeric")), "chimeric": F.coalesce("left", "chimeric"),
        }).withColumns({"p_begin": F.coalesce(F.col("begin") * 16, F.col("p_begin")), "p_end": F.coalesce(F.col("end") * 16, F.col("p_end"))}).drop("nb", "ne", "bad", "cut", "left")
        piles = _keep("piles", piles)
    clipped = O.clip(overlaps, piles)
    inner = _keep("contained", O.contained_reads(_same_extent(clipped) if break_ties else clipped))
    return _mark(piles, inner, "is_contained"), O.without_reads(clipped.select(*O.COLUMNS), inner)


def find_overlaps_and_repetitive_regions(reads: DataFrame, piles: DataFrame, config: OverlapConfig = OverlapConfig()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(overlaps, piles, marks): valid reads overlapped anew, dovetails only, the longest of each pair; marks are the
    bins of frequent k-mers that are not of low complexity."""
    valid = reads.join(piles.where("not is_invalid").select("read_id"), "read_id", "left_semi")
    found, places = S.overlaps_and_frequent_places(valid, config.k, config.w, True, config.frequency)
    once = _keep("overlaps", found)
    marks = places.select("read_id", to_bin(F.col("pos")).alias("bin")).distinct()
    clipped = O.classify(O.clip(once, piles))
    inner = _keep("contained", O.contained_reads(clipped))
    dovetails = clipped.where("kind > 2").select(*O.COLUMNS)
    piles = _mark(piles, inner, "is_contained")
    return _keep("dovetails", O.longest_per_pair(O.without_reads(dovetails, inner)).select(*O.COLUMNS)), piles, _keep("marks", marks)


def read_components(overlaps: DataFrame, piles: DataFrame) -> DataFrame:
    """(read_id, component) over dovetail overlaps; valid reads without one are components of their own."""
    kinds = O.classify(O.clip(overlaps, piles)).where("kind > 2")
    found = G.connected_components(kinds.select(F.col("lhs_id").alias("a"), F.col("rhs_id").alias("b")), "read-components")
    return piles.where("not is_invalid").select("read_id").join(found.withColumnRenamed("node", "read_id"), "read_id", "left").select("read_id", F.coalesce("component", "read_id").alias("component"))


def resolve_repeat_induced_overlaps(overlaps: DataFrame, piles: DataFrame, runs: DataFrame, marks: DataFrame) -> DataFrame:
    """Overlaps that do not end within a bridged repeat. Components, their medians and the repeats are found anew until
    nothing goes."""
    order = ["lhs_id", "rhs_id", "lhs_begin", "rhs_begin", "lhs_end", "rhs_end", "strand"]
    numbered = _keep("numbered", G.with_dense_ids(overlaps.select(*O.COLUMNS), order, "numbered").withColumnRenamed("id", "overlap_id"))
    marked = marks.groupBy("read_id").agg(F.collect_list("bin").alias("marked"))
    fields = T.StructType([T.StructField("read_id", T.LongType()), T.StructField("p_begin", T.LongType()), T.StructField("p_end", T.LongType()), T.StructField("regions", L.REGION)])

    def each(read_id, cov, begin, end, median, bins):
        return read_id, begin, end, L.as_rows(L.repetitive_regions(cov, begin, end, median, bins or []))

    while True:
        comps = read_components(numbered, piles)
        medians = P.upper_median(comps.join(piles.select("read_id", "median"), "read_id"), ["component"], "median").withColumnRenamed("median", "whole")
        rows = piles.where("not is_invalid").select("read_id", F.greatest("bins", "end").alias("bins"), "begin", "end").join(comps, "read_id").join(medians, "component").join(marked, "read_id", "left")
        regions = L.map_histograms(L.with_histograms(rows, runs), ["whole", "marked"], fields, each).select("read_id", "p_begin", "p_end", F.explode("regions").alias("r")).select("read_id", "p_begin", "p_end", "r.first", "r.last")
        regions = G.shared_copy(regions, "repeats")
        bad = G.shared_copy(P.repeat_induced(numbered, P.bridged_regions(numbered, regions)), "repeat-induced")
        if bad.isEmpty():
            return numbered.drop("overlap_id")
        numbered = G.shared_copy(numbered.join(bad, "overlap_id", "left_anti"), "numbered")


def construct_assembly_graph(reads: DataFrame, piles: DataFrame, overlaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of valid reads and dovetails."""
    valid = piles.where("not is_invalid").select("read_id", "p_begin", "p_end", "median")
    cut = reads.join(valid, "read_id").select("read_id", "name", bases(F.col("seq"), F.col("p_begin").cast("int"), (F.col("p_end") - F.col("p_begin")).cast("int")).alias("seq"), "median")
    nodes = G.node_pairs(cut).join(valid.select("read_id", F.col("median").alias("coverage")), "read_id")
    nodes = nodes.select("id", "name", "seq", "count", F.lit(False).alias("circular"), F.lit(False).alias("unitig"), F.coalesce("coverage", F.lit(0)).cast("long").alias("coverage"), F.array("name").alias("names"), F.array().cast("array<long>").alias("transitive"))
    dovetails = O.finalize(O.clip(overlaps, piles))
    return nodes, _keep("edges", _paired(G.edge_pairs(dovetails)))


def _paired(edges: DataFrame) -> DataFrame:
    """Edges with ids 2 n and 2 n + 1 by their pair; of edges between the same nodes the shortest stays."""
    even = edges.where((F.col("tail") < F.col("head").bitwiseXOR(F.lit(1))) | ((F.col("tail") == F.col("head").bitwiseXOR(F.lit(1)))))
    numbered = G.with_dense_ids(even.groupBy("tail", "head").agg(F.min("length").alias("length")), ["tail", "head"], "edge-ids")
    twin = edges.groupBy("tail", "head").agg(F.min("length").alias("twin_length")).select(F.col("head").bitwiseXOR(F.lit(1)).alias("tail"), F.col("tail").bitwiseXOR(F.lit(1)).alias("head"), "twin_length")
    both = numbered.join(twin, ["tail", "head"])
    pair = F.array(F.struct((2 * F.col("id")).alias("id"), F.col("tail"), F.col("head"), F.col("length")), F.struct((2 * F.col("id") + 1).alias("id"), F.col("head").bitwiseXOR(F.lit(1)).alias("tail"), F.col("tail").bitwiseXOR(F.lit(1)).alias("head"), F.col("twin_length").alias("length")))
    return both.select(F.explode(pair).alias("e")).select("e.id", "e.tail", "e.head", "e.length", F.lit(0.0).alias("weight"))


def remove_transitive_edges(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): reduced edges; the ends of a removed edge remember each other by even ids."""
    gone = G.shared_copy(G.transitive_edges(edges), "transitive")
    even = lambda c: F.col(c) - F.col(c) % 2
    ends = edges.join(gone, "id", "left_semi").select(F.explode(F.array(F.struct(even("tail").alias("id"), even("head").alias("t")), F.struct(even("head").alias("id"), even("tail").alias("t")))).alias("e"))
    seen = ends.groupBy("e.id").agg(F.sort_array(F.collect_set("e.t")).alias("_t"))
    nodes = nodes.join(seen, "id", "left").withColumn("transitive", F.array_union("transitive", F.coalesce("_t", F.array().cast("array<long>")))).drop("_t")
    return _keep("nodes", nodes), _keep("edges", G.remove_edges(edges, gone))


def _component_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _keep("component-rows", R.component_rows(nodes, edges, G.graph_components(edges)))


def remove_tips_and_bubbles(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Passes over all components until none changes."""
    rows = _component_rows(nodes, edges)
    while True:
        rows = _keep("tips-bubbles", R.tips_and_bubbles(rows))
        if rows.where("changes > 0").isEmpty():
            return R.split(rows)


def remove_long_edges(nodes: DataFrame, edges: DataFrame, rounds: int = 16, min_bases: int = R.MIN_UNITIG_BASES) -> tuple[DataFrame, DataFrame]:
    """Unitigs but for 42 nodes at each end of a path, drawn `rounds` times from different beginnings; after each drawing
    edges over twice as long as a sibling go, and then tips. Without a fork no drawing can mark an edge. Bubbles go last."""
    nodes, edges = R.split(_keep("unitigs-42", R.create_unitigs(_component_rows(nodes, edges), 42, min_bases)))
    for k in range(rounds):
        if edges.groupBy("tail").count().where("count > 1").isEmpty():
            break
        nodes, edges = R.split(_keep("layout", weighted(_component_rows(nodes, edges), k)))
        edges = _keep("edges", G.remove_edges(edges, G.long_edges(edges)))
        nodes, edges = R.split(_keep("tips", R.tips(_component_rows(nodes, edges))))
    return remove_tips_and_bubbles(nodes, edges)


def create_unitigs(nodes: DataFrame, edges: DataFrame, min_bases: int = R.MIN_UNITIG_BASES) -> tuple[DataFrame, DataFrame]:
    return R.split(_keep("unitigs", R.create_unitigs(_component_rows(nodes, edges), 0, min_bases)))


def salvage_plasmids(nodes: DataFrame, config: OverlapConfig = OverlapConfig(), frequency: float = 0.001) -> DataFrame:
    """Circular contigs that overlap neither a unitig nor a longer such contig become unitigs. The most frequent k-mers
    of the contigs, and those of the unitigs, are no seeds."""
    even = nodes.where("id % 2 = 0")
    small, large = even.where("circular and not unitig"), even.where("unitig")
    if small.isEmpty():
        return nodes
    rank = F.row_number().over(Window.orderBy(F.length("seq"), "id"))  # circular contigs are few
    named = small.select("id", "seq").withColumn("read_id", rank.cast("long"))
    top = 1 << 40
    sketch = G.shared_copy(S.minimizers(named.select("read_id", "seq"), config.k, config.w, canonical=True), "plasmid-sketch")
    others = G.shared_copy(S.minimizers(large.select((F.col("id") + top).alias("read_id"), "seq"), config.k, config.w, canonical=True), "unitig-sketch")
    index = S.drop_frequent(sketch, frequency).unionByName(S.drop_frequent(others, frequency))
    hit = S.chain(S.seed_join(sketch, index), config.k).select(F.col("lhs_id").alias("read_id")).distinct()
    good = named.join(hit, "read_id", "left_anti").select(F.explode(F.array("id", F.col("id") + 1)).alias("id"), F.lit(True).alias("_p"))
    return _keep("nodes", nodes.join(good, "id", "left").withColumns({"unitig": F.col("unitig") | F.coalesce("_p", F.lit(False)), "name": F.when(F.col("_p"), F.overlay("name", F.lit("U"), F.lit(1), F.lit(1))).otherwise(F.col("name"))}).drop("_p"))


def polish(nodes: DataFrame, reads: DataFrame, rounds: int = 2, align: AlignConfig = AlignConfig()) -> DataFrame:
    """Unitigs voted by the reads; the other strand follows, and circular ones begin elsewhere in each round."""
    from loomstrand.functions.columns import reverse_complement, rotated

    for _ in range(rounds):
        done = polish_round(nodes.where("id % 2 = 0 and unitig"), reads, align.match, align.mismatch, align.gap).where("votes > 0")
        seq = done.select("id", F.when(F.col("circular"), rotated(F.col("seq"))).otherwise(F.col("seq")).alias("_s"))
        both = seq.unionByName(seq.select((F.col("id") + 1).alias("id"), reverse_complement(F.col("_s")).alias("_s")))
        nodes = _keep("polished", nodes.join(both, "id", "left").withColumn("seq", F.coalesce("_s", "seq")).drop("_s"))
    return nodes


def construct(reads: DataFrame, config: Config = Config()) -> Assembly:
    reads = _keep("reads", reads.select("read_id", "name", "seq"))
    overlaps, piles, runs = find_overlaps_and_create_piles(reads, config.overlap)
    piles, overlaps = trim_and_annotate_piles(piles, runs, overlaps)
    piles, overlaps = resolve_contained_reads(piles, overlaps, reads, config.overlap, config.break_ties)
    piles, _ = resolve_chimeric_sequences(piles, runs, overlaps, config.break_ties)
    overlaps, piles, marks = find_overlaps_and_repetitive_regions(reads, piles, config.overlap)
    overlaps = resolve_repeat_induced_overlaps(overlaps, piles, runs, marks)
    nodes, edges = construct_assembly_graph(reads, piles, overlaps)
    return Assembly(-3, piles, nodes, edges)


def assemble(reads: DataFrame, config: Config = Config()) -> Assembly:
    """All stages; with a checkpoint folder each complete stage is kept, and `resume` goes on after the last."""
    spark, state = reads.sparkSession, None
    if config.resume and config.checkpoints and (found := W.load_state(spark, config.checkpoints)):
        state = Assembly(found[0], **found[1])
    if state is None:
        state = _store(construct(reads, config), config)
    if state.stage == -3:
        state = _store(Assembly(-2, state.piles, *remove_transitive_edges(state.nodes, state.edges)), config)
    if state.stage == -2:
        state = _store(Assembly(-1, state.piles, *remove_tips_and_bubbles(state.nodes, state.edges)), config)
    if state.stage == -1:
        nodes, edges = create_unitigs(*remove_long_edges(state.nodes, state.edges, config.layout_rounds, config.min_unitig_size), config.min_unitig_size)
        state = _store(Assembly(0, state.piles, salvage_plasmids(nodes, config.overlap), edges), config)
    for done in range(state.stage, config.polish_rounds):
        state = _store(Assembly(done + 1, state.piles, polish(state.nodes, reads, 1, config.align), state.edges), config)
    return state


def _store(state: Assembly, config: Config) -> Assembly:
    log.info("reached stage %d (%s)", state.stage, STAGES.get(state.stage, "polished"))
    if not config.checkpoints:
        return state
    W.save_state(config.checkpoints, state.stage, {"piles": state.piles, "nodes": state.nodes, "edges": state.edges})
    return Assembly(state.stage, **W.load_state(state.nodes.sparkSession, config.checkpoints)[1])
