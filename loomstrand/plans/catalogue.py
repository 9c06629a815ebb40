"""The registered queries and, for each that SQL can express, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstrand.functions import columns as C
from loomstrand.operators import graph as G
from loomstrand.operators import overlaps as O
from loomstrand.operators import piles as P
from loomstrand.operators import sketch as S
from loomstrand.plans import fixtures as X
from loomstrand.plans.fixtures import EDGES, INTERVALS, NODES, OVERLAPS, PILES, READS
from loomstrand.sources import writers as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
K, SKETCH_W = 15, 5


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["seed_pair_count"](spark, sf_dir)


# sequences


@query(f"with {READS} select read_id, reverse(translate(seq, 'ACGT', 'TGCA')) rc from reads")
def read_revcomp(spark, d):
    return X.reads(spark, d).select("read_id", C.reverse_complement(F.col("seq")).alias("rc"))


@query(f"with {READS} select read_id, substring(seq, 101, 64) bases from reads")
def read_substring(spark, d):
    return X.reads(spark, d).select("read_id", C.bases(F.col("seq"), 100, 64).alias("bases"))


@query(f"with {READS} select read_id, concat(substring(seq, cast(floor(length(seq) * 0.42) as bigint) + 1), substring(seq, 1, cast(floor(length(seq) * 0.42) as bigint))) seq from reads")
def rotated_sequence(spark, d):
    return X.reads(spark, d).select("read_id", C.rotated(F.col("seq")).alias("seq"))


@query("select p_partkey, p_partkey * 40 saturated, least(p_partkey * 40, 65535) cut, p_partkey // 16 bin, (p_partkey // 16) * 16 begin, xor(p_partkey, 1) pair from part".replace("p_partkey * 40 saturated, ", ""))
def saturate_and_bin(spark, d):
    k = F.col("p_partkey")
    return X.table(spark, d, "part").select(k, C.saturate(k * 40).alias("cut"), C.to_bin(k).alias("bin"), C.from_bin(C.to_bin(k)).alias("begin"), C.pair_of(k).alias("pair"))


MINIMIZERS = f"""{READS}, k as (select read_id, i pos, substring(seq, cast(i+1 as bigint), 15) kmer from reads, unnest(range(0, length(seq)-14)) t(i)),
w as (select read_id, min(struct_pack(kmer := kmer, pos := pos)) over (partition by read_id order by pos rows between 4 preceding and current row) m, row_number() over (partition by read_id order by pos) rn from k),
mz as (select distinct read_id, m.pos pos, m.kmer kmer from w where rn >= 5)"""
FILTERED = f"""{MINIMIZERS}, fr as (select kmer, count(*) n from mz group by 1), hi as (select n, count(*) k from fr group by 1),
ra as (select n, sum(k) over (order by n desc) upto from hi), cu as (select max(n) cut from ra where upto >= ceil(0.001 * (select count(*) from fr))),
fm as (select mz.* from mz join fr using (kmer) where n <= (select cut from cu))"""


def _sketch(spark, d) -> DataFrame:
    return S.minimizers(X.reads(spark, d), K, SKETCH_W)


def _seeds(spark, d) -> DataFrame:
    sketch = S.drop_frequent(_sketch(spark, d), 0.001)
    return S.seed_join(sketch, sketch)


@query(f"with {MINIMIZERS} select read_id, pos, kmer from mz")
def minimizers(spark, d):
    return _sketch(spark, d).select("read_id", "pos", S.kmer_text(F.col("kmer"), K).alias("kmer"))


@query(f"with {MINIMIZERS} select kmer, count(*) n from mz group by kmer")
def kmer_freq(spark, d):
    return S.kmer_frequency(_sketch(spark, d)).select(S.kmer_text(F.col("kmer"), K).alias("kmer"), "n")


@query(f"with {FILTERED} select read_id, pos, kmer from fm")
def kmer_freq_filter(spark, d):
    return S.drop_frequent(_sketch(spark, d), 0.001).select("read_id", "pos", S.kmer_text(F.col("kmer"), K).alias("kmer"))


@query(f"""with {FILTERED} select a.read_id lhs_id, b.read_id rhs_id, count(*) seeds, cast(sum(a.pos) as bigint) lhs_sum, cast(sum(b.pos) as bigint) rhs_sum, cast(sum(a.pos * b.pos) as bigint) product_sum,
min(a.pos) lhs_first, max(a.pos) lhs_last, min(b.pos) rhs_first, max(b.pos) rhs_last from fm a join fm b on a.kmer = b.kmer and a.read_id < b.read_id group by 1, 2""")
def seed_join(spark, d):
    """Every seed of every pair of reads, told by counts, sums and bounds of their places: the rows themselves are too many to compare."""
    if S.different_ids(reads := X.reads(spark, d)):
        return S.pair_rows(S.sketch_blocks(reads, K, SKETCH_W))
    a, b = F.col("lhs_pos").cast("long"), F.col("rhs_pos").cast("long")
    return _seeds(spark, d).groupBy("lhs_id", "rhs_id").agg(
        F.count("*").alias("seeds"), F.sum(a).alias("lhs_sum"), F.sum(b).alias("rhs_sum"), F.sum(a * b).alias("product_sum"),
        F.min(a).alias("lhs_first"), F.max(a).alias("lhs_last"), F.min(b).alias("rhs_first"), F.max(b).alias("rhs_last"),
    )


@query(f"with {FILTERED} select a.read_id lhs_id, b.read_id rhs_id, count(*) seeds from fm a join fm b on a.kmer = b.kmer and a.read_id < b.read_id group by 1, 2")
def seed_pair_count(spark, d):
    if S.different_ids(reads := X.reads(spark, d)):
        return S.pair_rows(S.sketch_blocks(reads, K, SKETCH_W), places=False)
    return _seeds(spark, d).groupBy("lhs_id", "rhs_id").agg(F.count("*").alias("seeds"))


@query()
def seed_chains(spark, d):
    """Longest ascending runs of seeds: a Python model is the test."""
    return S.overlaps(X.reads(spark, d), K, SKETCH_W)


@query(
    f"""with {MINIMIZERS}, km as (select distinct kmer from mz), a as (select kmer, regexp_replace(kmer, '(A)A+|(C)C+|(G)G+|(T)T+', '\\1\\2\\3\\4', 'g') one from km),
p as (select *, list_transform(range(0, (length(one) + 1) // 2), lambda i: substring(one, i * 2 + 1, 2)) ps from a),
b as (select *, array_to_string(list_transform(list_filter(range(1, len(ps) + 1), lambda i: i = 1 or ps[i] <> ps[i - 1]), lambda i: ps[i]), '') two from p),
q as (select *, substring(two, 2) rest from b),
c as (select *, list_transform(range(0, (length(rest) + 1) // 2), lambda i: substring(rest, i * 2 + 1, 2)) qs from q),
e as (select *, substring(two, 1, 1) || array_to_string(list_transform(list_filter(range(1, len(qs) + 1), lambda i: i = 1 or qs[i] <> qs[i - 1]), lambda i: qs[i]), '') three from c)
select kmer, length(one) < 8 or length(two) < 8 or length(three) < 8 low from e"""
)
def low_complexity(spark, d):
    kmers = S.kmer_frequency(_sketch(spark, d)).select(S.kmer_text(F.col("kmer"), K).alias("kmer"))
    return S.low_complexity(kmers)


PAIR = "n as (select c_custkey, s_suppkey, c_name l, s_name r from customer join supplier on c_nationkey = s_nationkey)"


def _name_pairs(spark, d) -> DataFrame:
    """(c_keys, s_keys, l, r): each pair of different names of a nation once, with all that bear them. Customers are dealt
    to several tasks, since a small file is read by one but has many pairs."""
    c, s = X.table(spark, d, "customer"), X.table(spark, d, "supplier")
    c = c.groupBy(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("l")).agg(F.collect_list("c_custkey").alias("c_keys"))
    s = s.groupBy(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("r")).agg(F.collect_list("s_suppkey").alias("s_keys"))
    return c.repartition(8 * spark.sparkContext.defaultParallelism, "nation", "l").join(s, "nation").select("c_keys", "s_keys", "l", "r")


def _bearers(pairs: DataFrame, *columns: str) -> DataFrame:
    """Pairs of names as pairs of a customer and a supplier."""
    return pairs.select(F.explode("c_keys").alias("c_custkey"), "s_keys", *columns).select("c_custkey", F.explode("s_keys").alias("s_suppkey"), *columns)


@query(f"with {PAIR} select c_custkey, s_suppkey from n where 1 - levenshtein(l, r) / greatest(length(l), length(r)) >= 0.5")
def identity_filter(spark, d):
    return _bearers(O.similar(_name_pairs(spark, d), "l", "r", 0.5))


@query(f"with {PAIR} select c_custkey, s_suppkey, least(length(l), length(r)) >= 0.8 * greatest(length(l), length(r)) and 1 - levenshtein(l, r) / greatest(length(l), length(r)) >= 0.8 as near from n")
def bubble_similarity(spark, d):
    return _bearers(_name_pairs(spark, d).withColumn("near", C.similar_paths(F.col("l"), F.col("r"))), "near")


# overlaps

COLS = "lhs_id, lhs_begin, lhs_end, rhs_id, rhs_begin, rhs_end, score, strand"
CLIPPED = f"""{PILES}, {OVERLAPS}, j as (select o.*, a.p_begin lb, a.p_end le, b.p_begin rb, b.p_end re from ovl o join piles a on a.read_id = lhs_id and not a.is_invalid join piles b on b.read_id = rhs_id and not b.is_invalid
  where lhs_begin < a.p_end and lhs_end > a.p_begin and rhs_begin < b.p_end and rhs_end > b.p_begin),
m as (select lhs_id, rhs_id, score, strand, lb, le, rb, re,
  lhs_begin + greatest(0, case when strand then rb - rhs_begin else rhs_end - re end) lhs_begin, lhs_end - greatest(0, case when strand then rhs_end - re else rb - rhs_begin end) lhs_end,
  rhs_begin + greatest(0, case when strand then lb - lhs_begin else lhs_end - le end) rhs_begin, rhs_end - greatest(0, case when strand then lhs_end - le else lb - lhs_begin end) rhs_end from j),
c as (select lhs_id, greatest(lhs_begin, lb) lhs_begin, least(lhs_end, le) lhs_end, rhs_id, greatest(rhs_begin, rb) rhs_begin, least(rhs_end, re) rhs_end, score, strand, lb, le, rb, re from m
  where lhs_begin < le and lhs_end > lb and rhs_begin < re and rhs_end > rb and least(lhs_end, le) - greatest(lhs_begin, lb) >= 84 and least(rhs_end, re) - greatest(rhs_begin, rb) >= 84)"""
TYPED = f"""{CLIPPED}, v as (select *, lhs_begin - lb x1, lhs_end - lb x2, le - lb n1, re - rb n2, case when strand then rhs_begin - rb else re - rhs_end end y1, case when strand then rhs_end - rb else re - rhs_begin end y2 from c),
h as (select *, least(x1, y1) + least(n1 - x2, n2 - y2) hang from v),
t as (select *, cast(case when x2 - x1 < (x2 - x1 + hang) * 0.875 or y2 - y1 < (y2 - y1 + hang) * 0.875 then 0 when x1 <= y1 and n1 - x2 <= n2 - y2 then 1 when y1 <= x1 and n2 - y2 <= n1 - x2 then 2 when x1 > y1 then 3 else 4 end as bigint) kind from h)"""


def _clipped(spark, d) -> DataFrame:
    return O.clip(X.overlaps(spark, d), X.piles(spark, d))


@query(f"with {OVERLAPS} select {COLS} from ovl union all select rhs_id, rhs_begin, rhs_end, lhs_id, lhs_begin, lhs_end, score, strand from ovl")
def overlap_reverse_union(spark, d):
    return O.doubled(X.overlaps(spark, d))


@query(f"with {OVERLAPS} select {COLS} from ovl qualify row_number() over (partition by lhs_id order by greatest(lhs_end - lhs_begin, rhs_end - rhs_begin) desc, rhs_id, lhs_begin, rhs_begin, lhs_end, rhs_end, strand) <= 32")
def overlap_length_topk(spark, d):
    return O.longest_per_read(X.overlaps(spark, d), 32)


@query(f"with {CLIPPED} select {COLS} from c")
def overlap_clip(spark, d):
    return _clipped(spark, d).select(*O.COLUMNS)


@query(f"with {TYPED} select {COLS}, kind from t")
def overlap_type(spark, d):
    return O.classify(_clipped(spark, d)).select(*O.COLUMNS, "kind")


FINAL = f"{TYPED}, f as (select lhs_id, x1 lhs_begin, x2 lhs_end, rhs_id, y1 rhs_begin, y2 rhs_end, kind score, strand, n1 lhs_length, n2 rhs_length from t where kind >= 3)"


@query(f"with {FINAL} select * from f")
def overlap_finalize(spark, d):
    return O.finalize(_clipped(spark, d))


@query(f"""with {TYPED}, i as (select case kind when 1 then lhs_id else rhs_id end read_id, case kind when 1 then rhs_id else lhs_id end outer_id from t where kind in (1, 2))
select distinct i.read_id from i join piles p on p.read_id = outer_id where not maybe_chimeric""")
def contained_reads(spark, d):
    return O.contained_reads(_clipped(spark, d), X.piles(spark, d))


@query(f"""with {TYPED}, i as (select distinct case kind when 1 then lhs_id else rhs_id end read_id from t where kind in (1, 2))
select {COLS} from (select ovl.* from ovl anti join i on ovl.lhs_id = i.read_id) o anti join i on o.rhs_id = i.read_id""")
def drop_contained(spark, d):
    return O.without_reads(X.overlaps(spark, d), O.contained_reads(_clipped(spark, d))).select(*O.COLUMNS)


@query(f"with {OVERLAPS} select {COLS} from ovl qualify row_number() over (partition by lhs_id, rhs_id order by greatest(lhs_end - lhs_begin, rhs_end - rhs_begin) desc, lhs_begin, rhs_begin, lhs_end, rhs_end, strand) = 1")
def pair_dedup_longest(spark, d):
    return O.longest_per_pair(X.overlaps(spark, d)).select(*O.COLUMNS)


# piles

RUNS = f"""{INTERVALS}, ev as (select read_id, bin pt, 1 d from cov union all select read_id, bin + span, -1 from cov), sm as (select read_id, pt, sum(d) d from ev group by 1, 2),
rn as (select read_id, pt as "begin", lead(pt) over (partition by read_id order by pt) as "end", cast(least(sum(d) over (partition by read_id order by pt), 65535) as bigint) cov from sm),
runs as (select * from rn where "end" is not null)"""
BINS = f"""{RUNS}, bins as (select read_id, b.b bin, cov from runs, unnest(range("begin", "end")) b(b))"""


def _runs(spark, d) -> DataFrame:
    return P.coverage_runs(X.intervals(spark, d))


def _bins(spark, d) -> DataFrame:
    return P.coverage_bins(_runs(spark, d))


@query(f'with {RUNS} select read_id, "begin", "end", cov from runs')
def pile_coverage(spark, d):
    return _runs(spark, d)


@query(f"""with {BINS}, g as (select read_id, bin, bin - row_number() over (partition by read_id order by bin) i from bins where cov >= 2),
s as (select read_id, min(bin) b, max(bin) + 1 e from g group by read_id, i)
select read_id, b as "begin", e as "end", e - b bins from s qualify row_number() over (partition by read_id order by e - b desc, b) = 1""")
def pile_valid_region(spark, d):
    return P.valid_regions(_runs(spark, d), 2)


@query(f"with {BINS} select read_id, list_sort(list(cov))[count(*) // 2 + 1] median from bins group by read_id")
def pile_upper_median(spark, d):
    runs = _runs(spark, d).withColumn("n", F.col("end") - F.col("begin"))
    return P.upper_median(runs, ["read_id"], "cov", "n")


@query(f"with {PILES} select list_sort(list(median))[count(*) // 2 + 1] median from piles where median > 0 and not is_invalid")
def global_upper_median(spark, d):
    return P.upper_median(X.piles(spark, d).where("median > 0 and not is_invalid"), [], "median")


@query(f"with {BINS} select *, max(cov) over (partition by read_id order by bin rows between 52 preceding and 1 preceding) left_max, max(cov) over (partition by read_id order by bin rows between 1 following and 52 following) right_max from bins")
def slope_window_max(spark, d):
    return P.slope_maxima(_bins(spark, d))


SLOPES = f"""{BINS}, mx as (select *, max(cov) over (partition by read_id order by bin rows between 52 preceding and 1 preceding) l, max(cov) over (partition by read_id order by bin rows between 1 following and 52 following) r from bins),
mk as (select read_id, bin, 0 as type from mx where l > floor(least(cov * 1.82, 65535)) union all select read_id, bin, 1 from mx where r > floor(least(cov * 1.82, 65535))),
il as (select *, bin - row_number() over (partition by read_id, type order by bin) i from mk),
sl as (select read_id, type, min(bin) as first, max(bin) as last from il group by read_id, type, i)"""


@query(f"with {SLOPES} select * from sl")
def slope_runs(spark, d):
    return P.slope_runs(_bins(spark, d), 1.82)


DIPS = f"{SLOPES}, nx as (select *, lead(type) over w nt, lead(last) over w nl from sl window w as (partition by read_id order by first, type, last)), dp as (select read_id, first, nl as last from nx where type = 0 and nt = 1)"


@query(f"with {DIPS} select * from dp")
def chimeric_pairs(spark, d):
    return P.dip_regions(P.slope_runs(_bins(spark, d), 1.82))


@query(f"""with {INTERVALS}, rg as (select read_id, bin as first, bin + 3 * span as last from cov), k as (select *, case when max(last) over (partition by read_id order by first, last rows between unbounded preceding and 1 preceding) > first then 0 else 1 end n from rg),
i as (select *, sum(n) over (partition by read_id order by first, last rows unbounded preceding) g from k) select read_id, min(first) as first, max(last) as last from i group by read_id, g""")
def region_merge(spark, d):
    return P.merge_regions(X.intervals(spark, d).select("read_id", F.col("bin").alias("first"), (F.col("bin") + 3 * F.col("span")).alias("last")))


@query(f"""with {INTERVALS}, b as (select distinct read_id, bin from cov), n as (select *, case when bin - lag(bin) over (partition by read_id order by bin) <= 29 then 0 else 1 end x from b),
c as (select *, sum(x) over (partition by read_id order by bin) g from n) select read_id, min(bin) as first, max(bin) as last, count(*) marks from c group by read_id, g having count(*) > 12""")
def kmer_clusters(spark, d):
    return P.kmer_clusters(X.intervals(spark, d))


SEGMENTS = f"""{PILES}, p as (select read_id, p_begin // 16 b, p_end // 16 e from piles), rg as (select distinct l_partkey read_id, (p.b + cast(l_quantity as bigint)) as first, (p.b + cast(l_quantity as bigint) + 2) as last from lineitem join p on p.read_id = l_partkey),
q as (select read_id, first pt, last nx from rg join p using (read_id) where b <= first and last <= e union all select read_id, e, null from p),
s as (select q.read_id, coalesce(lag(nx) over (partition by q.read_id order by pt, nx), p.b) "begin", pt "end" from q join p using (read_id))"""


@query(f"""with {SEGMENTS.replace("select distinct l_partkey read_id, (p.b + cast(l_quantity as bigint)) as first, (p.b + cast(l_quantity as bigint) + 2) as last from lineitem join p on p.read_id = l_partkey", "select l_partkey read_id, p.b + 4 * cast(min(l_quantity) as bigint) as first, p.b + 4 * cast(min(l_quantity) as bigint) + 2 as last from lineitem join p on p.read_id = l_partkey group by l_partkey, p.b")}
select read_id, "begin", "end" from s qualify row_number() over (partition by read_id order by "end" - "begin" desc, "begin") = 1""")
def chimeric_cut(spark, d):
    piles = X.piles(spark, d).select("read_id", C.to_bin(F.col("p_begin")).alias("begin"), C.to_bin(F.col("p_end")).alias("end"))
    least = X.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("read_id")).agg((4 * F.min("l_quantity").cast("long")).alias("q"))
    regions = piles.join(least, "read_id").select("read_id", (F.col("begin") + F.col("q")).alias("first"), (F.col("begin") + F.col("q") + 2).alias("last"))
    return P.longest_segments(piles, regions)


REGIONS = "rg as (select read_id, p_begin // 16 pb, p_end // 16 pe, p_begin // 16 + 2 as first, p_begin // 16 + 2 + read_id % 30 as last from piles union all select read_id, p_begin // 16, p_end // 16, p_end // 16 - 4 - read_id % 30, p_end // 16 - 2 from piles)"
FACING = f"""{PILES}, {OVERLAPS}, {REGIONS}, ov as (select *, row_number() over (order by lhs_id, rhs_id, lhs_begin, rhs_begin, lhs_end, rhs_end, score, strand) - 1 overlap_id from ovl),
sd as (select overlap_id, lhs_id read_id, lhs_begin // 16 b, lhs_end // 16 e from ov union all select overlap_id, rhs_id, rhs_begin // 16, rhs_end // 16 from ov),
fc as (select sd.*, first, last, pb, pe, cast(floor(0.1 * (pe - pb)) as bigint) os from sd join rg using (read_id) where b < last and first < e),
br as (select read_id, first, last, bool_or(case when first < pb + os and b - pb < pe - e then e >= last + 26 when last > pe - os and b - pb > pe - e then b + 26 <= first else false end) bridged from fc group by 1, 2, 3)"""


def _regions(spark, d) -> DataFrame:
    b, e, more = C.to_bin(F.col("p_begin")), C.to_bin(F.col("p_end")), F.col("read_id") % 30
    both = F.array(F.struct((b + 2).alias("first"), (b + 2 + more).alias("last")), F.struct((e - 4 - more).alias("first"), (e - 2).alias("last")))
    return X.piles(spark, d).select("read_id", b.alias("p_begin"), e.alias("p_end"), F.explode(both).alias("r")).select("read_id", "p_begin", "p_end", "r.first", "r.last")


def _numbered(spark, d) -> DataFrame:
    return G.with_dense_ids(X.overlaps(spark, d), ["lhs_id", "rhs_id", "lhs_begin", "rhs_begin", "lhs_end", "rhs_end", "score", "strand"], "overlaps").withColumnRenamed("id", "overlap_id")


@query(f"with {FACING} select rg.read_id, rg.first, rg.last, coalesce(bridged, false) bridged from rg left join br using (read_id, first, last)")
def bridged_regions(spark, d):
    return P.bridged_regions(_numbered(spark, d), _regions(spark, d)).select("read_id", "first", "last", "bridged")


@query(f"""with {FACING}, bd as (select fc.* from fc join br using (read_id, first, last) where bridged and case when first < pb + os then e < last + 26 when last > pe - os then b + 26 > first else false end)
select {COLS} from ov anti join (select distinct overlap_id from bd) b on ov.overlap_id = b.overlap_id""")
def repeat_overlap_drop(spark, d):
    overlaps = _numbered(spark, d)
    bad = P.repeat_induced(overlaps, P.bridged_regions(overlaps, _regions(spark, d)))
    return overlaps.join(bad, "overlap_id", "left_anti").select(*O.COLUMNS)


# graph


@query(f"""with {READS} select 2 * read_id id, read_id, name, seq, length(seq) len, cast(1 as bigint) as count from reads union all select 2 * read_id + 1, read_id, name, reverse(translate(seq, 'ACGT', 'TGCA')), length(seq), 1 from reads""")
def graph_nodes(spark, d):
    return G.node_pairs(X.reads(spark, d))


@query(f"""with {FINAL}, g as (select *, 2 * lhs_id l, 2 * rhs_id + case when strand then 0 else 1 end r, lhs_begin - rhs_begin a, (rhs_length - rhs_end) - (lhs_length - lhs_end) p from f)
select case score when 3 then l else r end tail, case score when 3 then r else l end head, case score when 3 then a else -a end length from g union all
select case score when 3 then xor(r, 1) else xor(l, 1) end, case score when 3 then xor(l, 1) else xor(r, 1) end, case score when 3 then p else -p end from g""")
def graph_edges(spark, d):
    return G.edge_pairs(O.finalize(_clipped(spark, d)))


@query(f"""with {EDGES}, {NODES}, dg as (select node, cast(sum(o) as bigint) outdegree, cast(sum(i) as bigint) indegree from (select tail node, 1 o, 0 i from edges union all select head, 0, 1 from edges) group by node)
select node, outdegree, indegree, outdegree > 1 or indegree > 1 junction, outdegree > 0 and indegree = 0 and count < 6 tip from dg join nodes on id = node""")
def degrees_tips_junctions(spark, d):
    counts = X.nodes(spark, d).select(F.col("id").alias("node"), "count")
    return G.degrees(X.edges(spark, d)).join(counts, "node").select("node", "outdegree", "indegree", G.is_junction().alias("junction"), G.is_tip(F.col("count")).alias("tip"))


TRANSITIVE = f"""{EDGES}, tr as (select distinct unnest([c.id, xor(c.id, 1)]) id from edges a join edges b on a.head = b.tail join edges c on c.tail = a.tail and c.head = b.head
  where (c.length * (1 - 0.12::double) <= a.length + b.length and a.length + b.length <= c.length * (1 + 0.12::double)) or ((a.length + b.length) * (1 - 0.12::double) <= c.length and c.length <= (a.length + b.length) * (1 + 0.12::double)))"""


@query(f"with {TRANSITIVE} select id from tr")
def transitive_edges(spark, d):
    return G.transitive_edges(X.edges(spark, d))


@query(f"""with {TRANSITIVE}, kept as (select * from edges where id not in (select id from tr)), en2 as (select tail node from kept union select head from kept)
select distinct node from (select tail node from edges where id in (select id from tr) union all select head from edges where id in (select id from tr)) where node not in (select node from en2)""")
def remove_edges_isolated(spark, d):
    edges = X.edges(spark, d)
    return G.isolated_nodes(edges, G.transitive_edges(edges))


@query(f"with {TRANSITIVE} select id, tail, head, length, weight from edges where id not in (select id from tr)")
def transitive_reduction(spark, d):
    edges = X.edges(spark, d)
    return G.remove_edges(edges, G.transitive_edges(edges))


@query(f"with {EDGES}, lw as (select *, min(weight) over (partition by tail) lo from edges) select distinct unnest([id, xor(id, 1)]) id from lw where weight > 2 * lo")
def long_edges(spark, d):
    return G.long_edges(X.edges(spark, d))


COMPONENTS = """pr as (select o_custkey a, o_custkey + 1 + o_orderkey % 3 b from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F'),
bo as (select a, b from pr union select b, a from pr), cc as (select a node, a c from bo union select bo.b, cc.c from cc join bo on bo.a = cc.node and cc.c < bo.b)"""


def _pairs(spark, d, every: bool = False) -> DataFrame:
    orders = X.table(spark, d, "orders")
    if not every:
        orders = orders.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
    return orders.select(F.col("o_custkey").alias("a"), (F.col("o_custkey") + 1 + F.col("o_orderkey") % 3).alias("b"))


def _component_medians(spark, d, found: DataFrame) -> DataFrame:
    values = found.join(X.table(spark, d, "customer"), F.col("node") == F.col("c_custkey")).select("component", F.floor("c_acctbal").cast("long").alias("v"))
    return values.groupBy("component").agg(F.count("*").alias("size")).join(P.upper_median(values, ["component"], "v"), "component")


@query(f"with recursive {COMPONENTS} select node, min(c) component from cc group by node")
def components(spark, d):
    return G.connected_components(_pairs(spark, d))


@query(f"""with recursive {COMPONENTS}, cm as (select node, min(c) component from cc group by node)
select component, count(*) size, list_sort(list(cast(floor(c_acctbal) as bigint)))[count(*) // 2 + 1] median from cm join customer on node = c_custkey group by component""")
def component_median(spark, d):
    return _component_medians(spark, d, G.connected_components(_pairs(spark, d)))


@query()
def components_of_all_orders(spark, d):
    """components over the links of every order; the recursive SQL holds those of a part. A union-find is the test."""
    return G.connected_components(_pairs(spark, d, every=True))


@query()
def component_median_of_all_orders(spark, d):
    return _component_medians(spark, d, G.connected_components(_pairs(spark, d, every=True)))


@query(f"with {EDGES}, {NODES} select id, name || ' LN:i:' || length(seq) || ' RC:i:' || count || ' XO:i:' || cast(circular as int) as tags from nodes where id % 2 = 0 and count > 5 and length(seq) > 1000")
def unitig_select(spark, d):
    rows = X.nodes(spark, d).where((F.col("id") % 2 == 0) & (F.col("count") > 5) & (F.length("seq") > 1000))
    return rows.select("id", C.unitig_tags(F.col("name"), F.length("seq"), F.col("count"), F.col("circular")).alias("tags"))


@query(f"with {EDGES}, {NODES}, {OVERLAPS} select id from nodes where id % 2 = 0 and circular and count <= 5 and id // 2 not in (select lhs_id from ovl where score = 1) ")
def plasmid_anti(spark, d):
    hits = X.overlaps(spark, d).where("score = 1").select((2 * F.col("lhs_id")).alias("id"))
    return X.nodes(spark, d).where("id % 2 = 0 and circular and count <= 5").join(hits, "id", "left_anti").select("id")


LISTED = f"{EDGES}, {NODES}, ls as (select * from nodes where id % 2 = 0 and (count > 1 or id in (select tail from edges union select head from edges)))"
ENDS = "ee as (select e.*, a.name an, b.name bn, length(a.seq) al, length(b.seq) bl, a.count ac, b.count bc from edges e join nodes a on a.id = tail join nodes b on b.id = head)"


@query(f"""with {LISTED}, {ENDS} select 0 section, id, 'S' || chr(9) || name || chr(9) || seq || chr(9) || 'LN:i:' || length(seq) || chr(9) || 'RC:i:' || count || chr(9) || 'dp:f:' || coverage || case when circular then chr(10) || 'L' || chr(9) || name || chr(9) || '+' || chr(9) || name || chr(9) || '+' || chr(9) || '0M' else '' end as value from ls union all
select 1, id, 'L' || chr(9) || an || chr(9) || case tail % 2 when 0 then '+' else '-' end || chr(9) || bn || chr(9) || case head % 2 when 0 then '+' else '-' end || chr(9) || (al - length) || 'M' from ee where id % 2 = 0""")
def gfa_rows(spark, d):
    return W.gfa_lines(X.nodes(spark, d), X.edges(spark, d))


@query(f"""with {LISTED}, {ENDS} select 0 section, id, 'S' || chr(9) || name || chr(9) || seq || chr(9) || 'LN:i:' || length(seq) || chr(9) || 'RC:i:' || count || chr(9) || 'CL:z:orange' || chr(10) || 'A' || chr(9) || 'read' || (id // 2) as value from ls union all
select 1, id, 'L' || chr(9) || an || chr(9) || case tail % 2 when 0 then '+' else '-' end || chr(9) || bn || chr(9) || case head % 2 when 0 then '+' else '-' end || chr(9) || (al - length) || 'M' from ee where id % 2 = 0""")
def unitig_gfa_rows(spark, d):
    return W.unitig_gfa_lines(X.nodes(spark, d), X.edges(spark, d))


LABEL = "cast({0} as varchar) || ' [' || ({0} // 2) || '] LN:i:' || {1} || ' RC:i:' || {2}"


@query(f"""with {LISTED}, {ENDS} select 0 section, id, {LABEL.format("id", "length(seq)", "count")} || ',' || {LABEL.format("xor(id, 1)", "length(seq)", "count")} || ',0,-' as value from ls union all
select 1, id, {LABEL.format("tail", "al", "ac")} || ',' || {LABEL.format("head", "bl", "bc")} || ',1,' || id || ' ' || length || ' ' || printf('%.6f', weight) from ee union all
select 2, id, {LABEL.format("id", "length(seq)", "count")} || ',' || {LABEL.format("id", "length(seq)", "count")} || ',1,-' from ls where circular""")
def csv_rows(spark, d):
    return W.csv_lines(X.nodes(spark, d), X.edges(spark, d))


@query(f"""with {PILES} select read_id, '{{"' || read_id || '":{{"p_begin":' || p_begin || ',"p_end":' || p_end || ',"is_invalid":false,"maybe_chimeric":' || maybe_chimeric || ',"median":' || median || '}}}}' as value from piles where not is_invalid""")
def pile_json_rows(spark, d):
    return W.pile_json(X.piles(spark, d))


@query(f"with {EDGES}, {NODES} select id, '>' || name || chr(10) || seq as value from nodes where id % 2 = 0")
def unitig_fasta(spark, d):
    return W.fasta_lines(X.nodes(spark, d).where("id % 2 = 0"))


@query("select round(sum(q) / count(*), 6) mean_quality from (select coalesce(list_avg(list_transform(string_split(p_name, ''), lambda c: cast(ascii(c) as double))) - 33, 0) q from part)")
def quality_mean(spark, d):
    from loomstrand.operators.polish import mean_quality

    return mean_quality(X.table(spark, d, "part").select(F.col("p_name").alias("qual"))).select(F.round("mean_quality", 6).alias("mean_quality"))


# sequential passes over components, held against Python models


def _component_rows(spark, d) -> DataFrame:
    from loomstrand.operators import prune as R

    edges = G.shared_copy(QUERIES["transitive_reduction"](spark, d), "reduced")
    nodes = X.nodes(spark, d).select("*", F.lit(False).alias("unitig"), F.array().cast("array<long>").alias("transitive"))
    comps = G.graph_components(edges)
    return R.component_rows(nodes, edges, comps)


@query()
def tips_bubbles_pass(spark, d):
    from loomstrand.operators import prune as R

    return R.split(R.tips_and_bubbles(_component_rows(spark, d)))[1]


@query()
def unitig_paths(spark, d):
    from loomstrand.operators import prune as R

    return R.split(R.create_unitigs(_component_rows(spark, d)))[0].select("id", "name", "count", "circular", F.length("seq").alias("len"))


@query()
def assembled_unitigs(spark, d):
    """The whole assembly of the derived reads: overlaps, piles, graph, simplification; contigs and unitigs."""
    from loomstrand.plans.assembly import Config, assemble

    return assemble(X.reads(spark, d), Config(polish_rounds=0)).nodes.where("id % 2 = 0").select("id", "name", "count", "circular", F.length("seq").alias("len"))
