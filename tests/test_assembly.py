"""End to end on a simulated circular genome, and parts against plain Python models."""

import copy
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstrand.operators import graph, prune, sketch, slopes
from loomstrand.operators.sketch import chain_seeds, minimizer_rows, shrinks
from loomstrand.plans import assembly as A
from loomstrand.sources import writers


def simulate(length=30_000, depth=12, size=5_000, seed=7):
    rng = random.Random(seed)
    genome = "".join(rng.choice("ACGT") for _ in range(length))
    ring, out = genome + genome, []
    for i in range(depth * length // size):
        at = (i * size // depth + rng.randrange(100)) % length
        piece = ring[at : at + size]
        out.append((i, f"r{i}", piece if i % 2 else piece[::-1].translate(str.maketrans("ACGT", "TGCA"))))
    return genome, out


def test_circular_genome_comes_back_as_one_unitig(spark):
    from loomstrand.plans.assembly import Config, assemble

    genome, rows = simulate()
    reads = spark.createDataFrame(rows, "read_id long, name string, seq string")
    found = assemble(reads, Config(polish_rounds=0, layout_rounds=1)).unitigs.collect()
    assert len(found) == 1 and found[0]["circular"]
    seq = found[0]["seq"]
    other = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert abs(len(seq) - len(genome)) <= 64
    assert any(s[:1000] in genome + genome for s in (seq, other))


def test_unitig_size_reaches_the_workers(spark):
    from loomstrand.operators import graph
    from loomstrand.plans.assembly import create_unitigs

    links = [(i, i + 1) for i in range(7)]
    node_rows = [(i, f"n{i >> 1}", "ACGT" * 50, 1, False, False, 3, [f"n{i >> 1}"], []) for i in range(16)]
    edge_rows = [(e.id, e.tail, e.head, e.length, 0.0) for e in edges(*links)]
    node_table = spark.createDataFrame(node_rows, "id long, name string, seq string, count long, circular boolean, unitig boolean, coverage long, names array<string>, transitive array<long>")
    edge_table = spark.createDataFrame(edge_rows, "id long, tail long, head long, length long, weight double")
    for least, want in ((100, True), (9999, False)):
        found = create_unitigs(node_table, edge_table, least)[0].collect()
        assert len(found) == 2 and all(r["unitig"] is want and r["name"].startswith("Utg" if want else "Ctg") for r in found)
    assert graph.graph_components(edge_table).count() == 8


def test_both_ends_of_a_path_keep_their_nodes():
    g = prune.Graph(nodes(12), edges(*((i, i + 1) for i in range(11))))
    assert g.unitigs(2, 1000) == 1
    assert sorted(n for n in g.nodes if n < 1000) == [0, 1, 2, 3, 20, 21, 22, 23] and g.nodes[1000].count == 8
    assert sorted((e.tail, e.head) for e in g.edges.values() if e.tail < 3 or 1000 <= e.tail) == [(0, 2), (2, 1000), (1000, 20), (1001, 3)]


def plain_separation(slopes_, cov, low):
    """The rule as written: of the first two neighbours that overlap, the first is looked at anew; until none do."""
    found = sorted(set(slopes_))
    while True:
        at = next((i for i, (a, b) in enumerate(zip(found, found[1:])) if a[2] > b[0] or a[2] == b[0] and a[1] == 1), None)
        if at is None:
            return found
        (first, kind, last), (begin, _, end) = found[at], found[at + 1]
        marks = []
        if kind:
            stop = min(last, end)
            marks = [j for j in range(first, stop) if low[j] < max(cov[j + 1 : stop + 1])]
            kept = (stop, 1, last)
        else:
            begin = max(first, begin)
            marks = [j for j in range(begin + 1, last + 1) if max(cov[begin:j]) > low[j]]
            kept = (first, 0, begin)
        runs = []
        for j in marks:
            runs = [*runs[:-1], (runs[-1][0], kind, j)] if runs and runs[-1][2] == j - 1 else [*runs, (j, kind, j)]
        found = sorted({*found[:at], kept, *runs, *found[at + 1 :]})


def test_slopes_are_separated_as_the_rule_says():
    rng = np.random.default_rng(5)
    for _ in range(60):
        cov = np.repeat(rng.integers(0, 30, 40), 5) + rng.integers(0, 4, 200)
        for q in (1.42, 1.82):
            low = np.minimum(cov * q, slopes.CAP)
            raw = slopes.raw_slopes(cov, q)
            assert slopes.separated(raw, cov, low) == plain_separation(raw, cov, low)


def test_minimizers_match_a_plain_model():
    rng = random.Random(1)
    seq = "".join(rng.choice("ACGT") for _ in range(400))
    k, w = 7, 4
    want = {min((seq[j : j + k], j) for j in range(i, i + w))[1] for i in range(len(seq) - k + 1 - w + 1)}
    assert set(minimizer_rows(seq.encode(), k, w, False)[0].tolist()) == want


def test_low_complexity():
    assert shrinks("AAAAAAAAAAAAAAA") and shrinks("ACACACACACACACA") and not shrinks("ACGTTGCATGCCAGT")


def test_chain_follows_the_diagonal():
    at = np.arange(0, 2000, 50)
    assert chain_seeds(at, at + 300, True, 15)[:4] == (0, 1965, 300, 2265)
    assert chain_seeds(at, 5000 - at, False, 15)[2:4] == (3050, 5015)
    assert chain_seeds(at[:2], at[:2], True, 15) is None


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(60):
        a, b = ("".join(rng.choice("ACG") for _ in range(rng.randrange(0, 14))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert prune.edit_distance(a, b) == row[-1]


def nodes(n, count=1):
    return [prune.Node(i, f"n{i >> 1}", "ACGT" * 50, count) for i in range(2 * n)]


def edges(*pairs):
    out = []
    for k, (a, b) in enumerate(pairs):
        out += [prune.Edge(2 * k, 2 * a, 2 * b, 50), prune.Edge(2 * k + 1, 2 * b + 1, 2 * a + 1, 50)]
    return out


def test_second_of_two_tips_on_one_head_stays():
    g = prune.Graph(nodes(6), edges((0, 2), (1, 2), (2, 3), (3, 4), (4, 5)))
    assert g.remove_tips() >= 1
    assert (0 in g.nodes) != (2 in g.nodes)


def test_simple_bubble_is_popped():
    g = prune.Graph(nodes(6), edges((0, 1), (1, 2), (1, 3), (2, 4), (3, 4), (4, 5)))
    assert g.remove_bubbles() == 1
    assert (4 in g.nodes) != (6 in g.nodes)


def test_circle_becomes_one_circular_node():
    g = prune.Graph(nodes(6), edges(*((i, (i + 1) % 6) for i in range(6))))
    assert g.unitigs(0, 100) == 1
    new = g.nodes[100]
    assert new.circular and new.count == 6 and len(new.seq) == 300


def test_slopes_of_a_dip():
    cov = np.array([20] * 100 + [3] * 20 + [20] * 100)
    assert slopes.chimeric_regions(cov) and not slopes.chimeric_regions(np.full(200, 20))
    begin, end, bad, cut, left = slopes.cut_chimera(cov, 0, 220, slopes.chimeric_regions(cov), 20)
    assert cut and not bad and end - begin >= 78 and not left


@pytest.mark.parametrize("text,names", [(">a x>y\nAC\nGT\n>b\nTT\n", ["a", "b"])])
def test_fasta_with_marks_in_the_header(spark, tmp_path, text, names):
    from loomstrand.sources.readers import read_sequences

    path = tmp_path / "x.fasta"
    path.write_text(text)
    rows = read_sequences(spark, [str(path)]).orderBy("read_id").collect()
    assert [(r["name"], r["seq"]) for r in rows] == [("a", "ACGT"), ("b", "TT")] and names == ["a", "b"]


def test_fastq_with_at_in_quality_and_bad_suffix(spark, tmp_path):
    from loomstrand.sources.readers import file_format, read_sequences

    path = tmp_path / "x.fq"
    path.write_text("@a\nACGT\n+\n@III\n@b\nGG\n+\nII\n")
    rows = read_sequences(spark, [str(path)]).orderBy("read_id").collect()
    assert [(r["name"], r["seq"], r["qual"]) for r in rows] == [("a", "ACGT", "@III"), ("b", "GG", "II")]
    with pytest.raises(ValueError):
        file_format("reads.txt")


def test_components_of_all_orders_match_union_find(spark):
    from loomstrand.plans.catalogue import QUERIES

    d = "/root/testdata/sf0.001"
    above: dict[int, int] = {}

    def root(x):
        above.setdefault(x, x)
        while above[x] != x:
            x = above[x]
        return x

    for key, a in spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey").collect():
        low, high = sorted((root(a), root(a + 1 + key % 3)))
        above[high] = low
    rows = QUERIES["components_of_all_orders"](spark, d).collect()
    assert {r["node"]: r["component"] for r in rows} == {x: root(x) for x in above} and len(rows) == len(above)
    values: dict[int, list[int]] = {}
    for c, v in spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey", "cast(floor(c_acctbal) as bigint)").collect():
        if c in above:
            values.setdefault(root(c), []).append(v)
    found = {(r["component"], r["size"], r["median"]) for r in QUERIES["component_median_of_all_orders"](spark, d).collect()}
    assert found == {(c, len(v), sorted(v)[len(v) // 2]) for c, v in values.items()}


def reverse(seq):
    return seq[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_plasmids_beside_unitigs_and_longer_copies(spark):
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    whole, long, alone = letters(9000), letters(3000), letters(2500)
    rows = [(0, "Utg0", whole, False, True), (2, "Ctg2", whole[2000:4500], True, False), (4, "Ctg4", long, True, False), (6, "Ctg6", long[200:2700], True, False), (8, "Ctg8", alone, True, False), (10, "Ctg10", letters(2500), False, False)]
    both = [r for i, name, seq, circular, unitig in rows for r in ((i, name, seq, circular, unitig), (i + 1, name, reverse(seq), circular, unitig))]
    nodes = spark.createDataFrame(both, "id long, name string, seq string, circular boolean, unitig boolean")
    found = {r["id"]: r["name"] for r in A.salvage_plasmids(nodes).where("unitig").collect()}
    assert found == {0: "Utg0", 1: "Utg0", 4: "Utg4", 5: "Utg4", 8: "Utg8", 9: "Utg8"}


def test_csv_with_names_and_regions(spark):
    columns = "id long, name string, seq string, count long, circular boolean, unitig boolean"
    nodes = spark.createDataFrame([(0, "r0", "ACGTA", 1, False, False), (1, "r0", "TACGT", 1, False, False), (2, "Utg2", "ACGT", 3, False, True), (3, "Utg2", "ACGT", 3, False, True)], columns)
    edges = spark.createDataFrame([(0, 0, 2, 2, 0.0), (1, 3, 1, 1, 0.0)], "id long, tail long, head long, length long, weight double")
    piles = spark.createDataFrame([(0, 16, 96), (1, 32, 64)], "read_id long, p_begin long, p_end long")
    last = lambda **k: [r["value"].split(",")[3] for r in writers.csv_lines(nodes, edges, **k).where("section = 0").orderBy("id").collect()]
    assert last() == ["-", "-"] and last(names=True) == ["r0 ", "Utg2 "]
    assert last(piles=piles) == ["16 96", "-"] and last(names=True, piles=piles) == ["r0 16 96", "Utg2 "]


def test_equal_empty_regions_stay_apart_and_missing_places_come_last(spark):
    from loomstrand.operators.piles import merge_regions

    rows = [(1, 5, 5), (1, 5, 5), (1, 7, 9), (1, 8, 12), (1, 12, 11), (1, 12, 11), (2, None, None), (2, None, None), (2, 3, None), (2, 3, 6)]
    found = merge_regions(spark.createDataFrame(rows, "read_id long, first long, last long")).collect()
    want = [(1, 5, 5), (1, 5, 5), (1, 7, 12), (1, 12, 11), (1, 12, 11), (2, 3, 6), (2, None, None), (2, None, None)]
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, want))


def test_names_are_compared_once_and_by_several_tasks(spark, tmp_path):
    from loomstrand.plans import catalogue

    customers = [(i, "Customer#1" if i % 2 else f"Supplies#{i % 4}", i % 3) for i in range(60)]
    suppliers = [(i, f"Supplier#{i % 2}", i % 3) for i in range(12)]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey long").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(suppliers, "s_suppkey long, s_name string, s_nationkey long").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    pairs = catalogue._name_pairs(spark, str(tmp_path))
    assert pairs.count() == len({(a[1], b[1], a[2]) for a in customers for b in suppliers if a[2] == b[2]}) and pairs.rdd.getNumPartitions() > 1
    near = catalogue.QUERIES["bubble_similarity"](spark, str(tmp_path)).collect()
    assert sorted((r[0], r[1]) for r in near) == sorted((a[0], b[0]) for a in customers for b in suppliers if a[2] == b[2])
    kept = catalogue.QUERIES["identity_filter"](spark, str(tmp_path)).collect()
    least = [(a[0], b[0]) for a in customers for b in suppliers if a[2] == b[2] and (a[1].startswith("Supplies") or b[1] == "Supplier#1")]
    assert sorted(map(tuple, kept)) == sorted(least)  # Customer#1 is five of ten letters from Supplier#1, six from Supplier#0


def test_blocks_of_reads_have_the_seeds_and_chains_of_a_join(spark, monkeypatch):
    rng = random.Random(11)
    genome = "".join(rng.choice("ACGT") for _ in range(2_000))
    texts = [genome[at : at + 600] for at in range(0, 1_400, 60)] + [None, "", "ACGT", "N" * 40]
    reads = spark.createDataFrame([(7 * k % 31 + 1, t) for k, t in enumerate(texts)], "read_id long, seq string").repartition(3)
    monkeypatch.setattr(sketch, "BLOCK", 500)
    monkeypatch.setattr(sketch, "CHUNK", 1_000)
    blocks = sketch.sketch_blocks(reads, 15, 5, True)
    assert len(blocks.files) > 3
    kept = sketch.drop_frequent(sketch.minimizers(reads, 15, 5, True))
    seeds = sketch.seed_join(kept, kept)
    want = seeds.groupBy("lhs_id", "rhs_id").agg(F.count("*").alias("seeds"), F.sum("lhs_pos"), F.sum("rhs_pos"), F.sum(F.col("lhs_pos") * F.col("rhs_pos")), F.min("lhs_pos"), F.max("lhs_pos"), F.min("rhs_pos"), F.max("rhs_pos"))
    assert sorted(map(tuple, sketch.pair_rows(blocks).collect())) == sorted(map(tuple, want.collect()))
    chains, frequent = sketch.overlaps_and_frequent(reads, 15, 5, True)
    assert sorted(map(tuple, chains.collect())) == sorted(map(tuple, sketch.chain(seeds).collect()))
    every = {r[0] for r in sketch.minimizers(reads, 15, 5, True).select("kmer").collect()}
    assert {r[0] for r in frequent.collect()} == every - {r[0] for r in kept.select("kmer").collect()}


def test_blocks_end_at_the_read_that_fills_them(spark, monkeypatch):
    """A block was closed only after 256 reads, however long they were."""
    rng = random.Random(12)
    reads = spark.createDataFrame([(k, "".join(rng.choice("ACGT") for _ in range(900))) for k in range(40)], "read_id long, seq string").coalesce(1)
    monkeypatch.setattr(sketch, "BLOCK", 500)
    assert len(sketch.sketch_blocks(reads).files) == 20


def test_chains_of_many_pairs_are_those_of_each():
    rng, found = np.random.default_rng(13), 0
    for _ in range(60):
        pairs = []
        for _ in range(int(rng.integers(1, 30))):
            lhs, strand = rng.integers(0, 1_500, int(rng.integers(1, 60))), bool(rng.integers(2))
            rhs = (lhs if strand else 2_000 - lhs) + rng.integers(-300, 300) + rng.choice([0, 1, -40, 700], len(lhs), p=[0.7, 0.1, 0.1, 0.1])
            pairs.append((lhs, rhs, strand))
        want = [(i, *c) for i, (p, q, s) in enumerate(pairs) if (c := chain_seeds(p, q, s, 15))]
        lhs, rhs, strand = zip(*pairs, strict=True)
        which, columns = sketch.chain_groups(np.concatenate(lhs), np.concatenate(rhs), np.array(strand), np.array([len(x) for x in lhs]), 15)
        assert list(zip(which.tolist(), *(c.tolist() for c in columns), strict=True)) == want
        found += len(want)
    assert found > 200


def test_tiles_have_every_two_blocks_once(spark, monkeypatch):
    rng = random.Random(14)
    genome = "".join(rng.choice("ACGT") for _ in range(6_000))
    reads = spark.createDataFrame([(k * 37 % 101, genome[at : at + 700]) for k, at in enumerate(range(0, 5_300, 53))], "read_id long, seq string").repartition(4)
    kept = sketch.drop_frequent(sketch.minimizers(reads, 15, 5, True))
    want = sorted(map(tuple, sketch.chain(sketch.seed_join(kept, kept)).collect()))
    monkeypatch.setattr(sketch, "BLOCK", 700)
    blocks = sketch.sketch_blocks(reads, 15, 5, True)
    assert len(blocks.files) > 24  # sides of three blocks
    assert sorted(map(tuple, sketch.chained(blocks).collect())) == want


def test_reads_are_overlapped_anew_without_a_join_of_seeds(spark, monkeypatch):
    """The second search sent every seed through a shuffle; marks came of three joins with the sketch."""
    rows = [(i, n, s + s[200:900] * 3) for i, n, s in simulate(9_000, 10, 3_000)[1]]
    reads = spark.createDataFrame(rows, "read_id long, name string, seq string")
    piles = reads.select("read_id", F.lit(0).cast("long").alias("p_begin"), F.length("seq").cast("long").alias("p_end"), (F.col("read_id") % 5 == 0).alias("is_invalid"), F.lit(False).alias("is_contained"))
    valid = reads.where("read_id % 5 <> 0")
    minimizers = sketch.minimizers(valid, 15, 5, True).toPandas()
    counts = minimizers.kmer.value_counts()
    cut = counts.iloc[int(np.ceil(0.01 * len(counts))) - 1]
    frequent = {c for c in counts[counts > cut].index if not shrinks("".join("ACGT"[c >> 2 * i & 3] for i in range(14, -1, -1)))}
    assert frequent
    want = {(r, p >> 4) for r, p, c in zip(minimizers.read_id, minimizers.pos, minimizers.kmer, strict=True) if c in frequent}
    monkeypatch.setattr(sketch, "seed_join", None)
    found = A.find_overlaps_and_repetitive_regions(reads, piles, A.OverlapConfig(frequency=0.01))
    assert {tuple(r) for r in found[2].collect()} == want
    assert found[0].count() > 0


@pytest.mark.parametrize("most", [0, 1 << 18])
def test_components_by_one_task_and_by_rounds(spark, monkeypatch, most):
    rng = random.Random(15)
    pairs = [(a, a + 1) for a in rng.sample(range(0, 400), 330)] + [(rng.randrange(500, 900), rng.randrange(500, 900)) for _ in range(250)] + [(1_000, 1_000), (1_001, None), (None, 1_002)]
    monkeypatch.setattr(graph, "ONE_TASK", most)
    copies = []
    kept = graph.shared_copy
    monkeypatch.setattr(graph, "shared_copy", lambda df, name: copies.append(name) or kept(df, name))
    found = dict(map(tuple, graph.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    least = {x: x for p in pairs if None not in p for x in p}
    while any(least[a] != least[b] for a, b in pairs if None not in (a, b)):
        for a, b in pairs:
            if None not in (a, b):
                least[a] = least[b] = min(least[a], least[b])
    assert found == least
    assert (len(copies) == 2) == (most > 0)


def random_component(rng):
    """(nodes, edges) with forks, dead ends, rings and like or unlike letters, under ids in no order."""
    m, dead = rng.randint(3, 14), rng.randint(0, 2)
    pairs = {(i, i + 1) for i in range(m - 1)} | {(a, min(m - 1, a + rng.randint(1, 3))) for a in rng.sample(range(m - 1), rng.randint(0, 2))}
    pairs |= {(m - 1, 0)} if rng.random() < 0.2 else set()
    pairs |= {(m + k, rng.randrange(m)) for k in range(dead)}
    m += dead
    at = rng.sample(range(m), m)
    got = [e for k, (a, b) in enumerate(sorted(pairs)) for e in (prune.Edge(2 * k, 2 * at[a], 2 * at[b], 50), prune.Edge(2 * k + 1, 2 * at[b] + 1, 2 * at[a] + 1, 50))]
    text = lambda: "".join(rng.choice("ACGT") if rng.random() < 0.15 else "ACGT"[j % 4] for j in range(100))
    return [prune.Node(i, f"n{i >> 1}", text(), 1 + at[i >> 1] % 4, transitive={i & ~1, 2 * at[0]}) for i in range(2 * m)], got


def test_passes_on_arrays_match_those_on_objects():
    rng, tips, bubbles = random.Random(11), 0, 0
    for _ in range(400):
        ns, es = random_component(rng)
        plain, seqs = prune.Graph(ns, es), {n.id: n.seq for n in ns}
        lean = prune.Arrays(np.array([n.id for n in ns]), np.array([n.count for n in ns]), np.array([(e.id, e.tail, e.head, e.length) for e in es]), lambda ids, seqs=seqs: {i: seqs[i] for i in ids})
        assert list(plain.chains()) == list(lean.chains())
        found = plain.remove_tips(), plain.remove_bubbles()
        assert found == (lean.remove_tips(), lean.remove_bubbles())
        assert {e.id for e in es} - lean.edges.gone == set(plain.edges) and set(seqs) - lean.nodes.gone == set(plain.nodes)
        tips, bubbles = tips + found[0], bubbles + found[1]
    assert tips > 50 and bubbles > 50


def as_rows(c, g):
    found = [(c, True, n.id, n.name, n.seq, n.count, n.circular, n.unitig, n.coverage, n.names, sorted(n.transitive), None, None, None, None, 0) for n in g.nodes.values()]
    return found + [(c, False, e.id, *[None] * 8, e.tail, e.head, e.length, e.weight, 0) for e in g.edges.values()]


def component_table(spark, components):
    parts = []
    for k, (ns, es) in enumerate(components):
        up = 1000 * k
        moved = [prune.Node(n.id + up, n.name, n.seq, n.count, transitive={t + up for t in n.transitive}) for n in ns]
        parts.append((up, prune.Graph(moved, [prune.Edge(e.id + up, e.tail + up, e.head + up, e.length) for e in es])))
    return parts, spark.createDataFrame([r for c, g in parts for r in as_rows(c, g)], prune.ROWS).drop("changes")


def as_set(rows):
    return sorted(repr(tuple(r)[:-1]) for r in rows)  # but for the changes


def test_no_letters_reach_the_task_of_a_component(spark):
    assert not {"seq", "name", "names", "transitive"} & set(prune.LIGHT)
    rng = random.Random(7)
    components, table = component_table(spark, [random_component(rng) for _ in range(40)])
    got = prune.tips_and_bubbles(table).collect()
    changes = {c: g.remove_tips() + g.remove_bubbles() for c, g in components}
    assert as_set(got) == as_set(r for c, g in components for r in as_rows(c, g))
    assert all(r["changes"] == changes[r["component"]] for r in got) and sum(changes.values()) > 10


def test_letters_of_a_unitig_meet_by_path(spark):
    rng = random.Random(8)
    components, table = component_table(spark, [random_component(rng) for _ in range(40)])
    base = (max(max(*g.nodes, *g.edges) for _, g in components) // 4 + 1) * 4
    assert "seq" not in prune.LIGHT
    for epsilon in (0, 1):
        got = prune.create_unitigs(table, epsilon, 300).collect()
        want = copy.deepcopy(components)
        made = {c: g.unitigs(epsilon, base, 300) for c, g in want}
        assert as_set(got) == as_set(r for c, g in want for r in as_rows(c, g))
        assert all(r["changes"] == made[r["component"]] for r in got) and sum(made.values()) > 10


@pytest.mark.parametrize("join", [1, 4])
def test_joined_blocks_hold_no_kmer_that_occurs_once(spark, monkeypatch, join):
    """Every block was read with all its k-mers, and each two of the small blocks were merged."""
    rng = random.Random(15)
    genome = "".join(rng.choice("ACGT") for _ in range(4_000))
    texts = [genome[at : at + 500] + "".join(rng.choice("ACGT") for _ in range(300)) for at in range(0, 3_500, 40)]
    reads = spark.createDataFrame([(k * 37 % 101, t) for k, t in enumerate(texts)], "read_id long, seq string").repartition(4)
    monkeypatch.setattr(sketch, "BLOCK", 500)
    monkeypatch.setattr(sketch, "JOIN", join)
    blocks = sketch.sketch_blocks(reads, 15, 5, True, 0.02)
    assert len(blocks.files) > 24 and len(blocks.joined) == -(-len(blocks.files) // min(join, len(blocks.files) // 8))
    every = sketch.minimizers(reads, 15, 5, True).toPandas()
    counts = every.kmer.value_counts()
    held = [sketch.read_block(f) for f in blocks.joined]
    assert {x for b in held for x in b.kmer.tolist()} == set(counts[counts > 1].index) - set(blocks.frequent.tolist())
    places = every[every.kmer.isin(blocks.frequent)]
    assert len(places) and sorted(map(tuple, sketch.places_of(blocks, blocks.frequent).collect())) == sorted(zip(places.read_id.tolist(), places.pos.tolist(), strict=True))
    kept = sketch.drop_frequent(sketch.minimizers(reads, 15, 5, True), 0.02)
    seeds = sketch.seed_join(kept, kept)
    want = sorted(map(tuple, seeds.groupBy("lhs_id", "rhs_id").count().collect()))
    assert sorted(map(tuple, sketch.pair_rows(blocks, places=False).collect())) == want
    assert [r[:3] for r in sorted(map(tuple, sketch.pair_rows(blocks).collect()))] == want
    assert sorted(map(tuple, sketch.chained(blocks).collect())) == sorted(map(tuple, sketch.chain(seeds).collect()))


def test_long_kmers_are_ordered_and_matched_as_short_ones_are():
    rng = np.random.default_rng(16)
    for top in (1 << 10, 1 << 30, 1 << 62):
        kmers = rng.integers(0, top, 400_000)
        assert (sketch._order(kmers) == np.argsort(kmers, kind="stable")).all()
        a, b = np.unique(kmers[:300_000]), np.unique(kmers[150_000:])
        one, two = sketch._matches(a, b)
        assert (a[one] == np.intersect1d(a, b)).all() and (b[two] == a[one]).all()
