"""Command line: assemble read files to unitigs on standard output."""

from __future__ import annotations

import argparse
import logging
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomstrand", description="De novo assembly of long reads on Spark.")
    p.add_argument("sequences", nargs="*", help="FASTA or FASTQ files, plain or gzip")
    p.add_argument("-k", "--kmer-len", type=int, default=15)
    p.add_argument("-w", "--window-len", type=int, default=5)
    p.add_argument("-f", "--frequency", type=float, default=0.001)
    p.add_argument("-i", "--identity", type=float, default=0.0)
    p.add_argument("-o", "--kMaxNumOverlaps", dest="max_overlaps", type=int, default=32)
    p.add_argument("-M", "--use-micromizers", action="store_true", help="accepted; sketches are minimizers either way")
    p.add_argument("-p", "--polishing-rounds", type=int, default=2)
    p.add_argument("-m", "--match", type=int, default=3)
    p.add_argument("-n", "--mismatch", type=int, default=-5)
    p.add_argument("-g", "--gap", type=int, default=-4)
    p.add_argument("-u", "--min-unitig-size", type=int, default=9999)
    p.add_argument("-F", "--graphical-fragment-assembly", metavar="PATH")
    p.add_argument("-U", "--unitig-graphical-fragment-assembly", metavar="PATH")
    p.add_argument("--resume", action="store_true")
    p.add_argument("--disable-checkpoints", action="store_true")
    p.add_argument("--checkpoints", default="loomstrand-checkpoints", metavar="DIR")
    p.add_argument("-t", "--threads", type=int, default=1, help="local threads where no master is configured")
    p.add_argument("--version", action="version", version="0.1.0")
    return p


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if not argv:
        parser().print_help()
        return 0
    a = parser().parse_args(argv)
    if not a.sequences:
        print("error: no input file", file=sys.stderr)
        return 1
    logging.basicConfig(stream=sys.stderr, level=logging.INFO, format="[%(name)s] %(message)s")
    from pyspark.sql import SparkSession

    from loomstrand import api

    builder = SparkSession.builder.appName("loomstrand")
    spark = (builder if SparkSession.getActiveSession() else builder.master(f"local[{a.threads}]")).getOrCreate()
    try:
        reads = api.load_sequences(spark, a.sequences)
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    config = api.Config(
        api.OverlapConfig(a.kmer_len, a.window_len, a.frequency, a.identity, a.max_overlaps), api.AlignConfig(a.match, a.mismatch, a.gap), a.polishing_rounds,
        min_unitig_size=a.min_unitig_size, checkpoints=None if a.disable_checkpoints else a.checkpoints, resume=a.resume,
    )
    state = api.assemble(reads, config)
    if a.graphical_fragment_assembly:
        api.save_lines(api.gfa_lines(state.nodes, state.edges), a.graphical_fragment_assembly)
    if a.unitig_graphical_fragment_assembly:
        api.save_lines(api.unitig_gfa_lines(state.nodes, state.edges), a.unitig_graphical_fragment_assembly)
    for record in api.unitigs_as_fasta(state):
        print(record)
    return 0


if __name__ == "__main__":
    sys.exit(main())
