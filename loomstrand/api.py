"""The public surface: one function for each stage, on plain DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomstrand.operators.overlaps import clip, classify, contained_reads, doubled, finalize, longest_per_pair, longest_per_read, reversed_overlaps
from loomstrand.operators.polish import polish_round
from loomstrand.operators.sketch import chain, drop_frequent, minimizers, seed_join
from loomstrand.plans.assembly import (
    AlignConfig,
    Assembly,
    Config,
    OverlapConfig,
    assemble,
    construct,
    construct_assembly_graph,
    create_unitigs,
    find_overlaps,
    find_overlaps_and_create_piles,
    find_overlaps_and_repetitive_regions,
    polish,
    read_components,
    remove_long_edges,
    remove_tips_and_bubbles,
    remove_transitive_edges,
    resolve_chimeric_sequences,
    resolve_contained_reads,
    resolve_repeat_induced_overlaps,
    salvage_plasmids,
    trim_and_annotate_piles,
)
from loomstrand.sources.readers import read_fasta, read_fastq, read_gfa, read_sequences
from loomstrand.sources.writers import csv_lines, fasta_lines, gfa_lines, load_state, pile_json, save_lines, save_state, unitig_gfa_lines


def load_sequences(spark: SparkSession, paths: list[str]) -> DataFrame:
    return read_sequences(spark, paths)


def unitigs_as_fasta(state: Assembly) -> list[str]:
    """One record for each unitig, in order of id; the driver holds the assembled sequences, as a caller asks for."""
    return [r["value"] for r in fasta_lines(state.unitigs).orderBy("id").collect()]


def graph_as_gfa(state: Assembly) -> list[str]:
    return [r["value"] for r in gfa_lines(state.nodes, state.edges, depth=False).orderBy("section", "id").collect()]


def graph_as_csv(state: Assembly) -> list[str]:
    return [r["value"] for r in csv_lines(state.nodes, state.edges).orderBy("section", "id").collect()]


__all__ = [name for name in dir() if not name.startswith("_") and name not in ("annotations", "DataFrame", "SparkSession")]
