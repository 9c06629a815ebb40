"""Operators 5, 6, 8, 9, 10 and the pipeline, against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import ODD, PASSAGE, docs

from loomstrand.llm import decontaminate, ngram_join, packing, substrings, token_records, tokens


def corpus(seed=1, n=60):
    """Random short texts with copies, near copies and shared passages."""
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(40)]
    rows = []
    for i in range(n):
        kind = rng.randrange(5)
        if rows and kind == 0:
            rows.append((i, rows[rng.randrange(len(rows))][1]))
        elif rows and kind == 1:
            text = (rows[rng.randrange(len(rows))][1] or "").split()
            if text:
                text[rng.randrange(len(text))] = "edit"
            rows.append((i, " ".join(text)))
        else:
            text = [rng.choice(words) for _ in range(rng.randrange(0, 60))]
            if kind == 2:
                text[3:3] = PASSAGE.split()[: rng.randrange(10, 40)]
            rows.append((i, " ".join(text)))
    rng.shuffle(rows)
    return rows


def brute_repeats(rows, window=13):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in split:
        if i is not None:
            for k in range(len(w) - window + 1):
                g = tuple(w[k : k + window])
                least[g] = min(least.get(g, i), i)
    out = []
    for i, w in split:
        gone = {k + j for k in range(len(w) - window + 1) if i is not None and least[tuple(w[k : k + window])] < i for j in range(window)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("rows", [ODD, corpus(1), corpus(2), [*corpus(3, 30), (5, "same id other text " * 8), (5, PASSAGE), (4, PASSAGE)], []])
def test_repeats_match_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK_WORDS", 200)
    found = substrings.remove_repeats(docs(spark, rows).repartition(5)).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert Counter(map(tuple, found.collect())) == brute_repeats(rows)


def brute_join(rows):
    table = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(table).split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    owner = list(range(len(rows)))

    def root(x):
        while owner[x] != x:
            x = owner[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                owner[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return Counter((i, len(s), least.get(root(k))) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def family(seed, n, edits, words=200, first=0):
    """Near copies of one text, each with up to `edits` words changed at random."""
    rng = random.Random(seed)
    base, rows = [f"b{i}" for i in range(words)], []
    for i in range(first, first + n):
        text = list(base)
        for _ in range(rng.randrange(0, edits + 1)):
            text[rng.randrange(len(text))] = f"e{i}x{rng.randrange(9)}"
        rows.append((i, " ".join(text)))
    return rows


NAMELESS = [(None, " ".join(f"b{i}" for i in range(60))), (3, " ".join(f"b{i}" for i in range(4, 64))), (2, " ".join(f"b{i}" for i in range(-4, 56))), (None, "alone " * 9), (None, "alone " * 8)]


@pytest.mark.parametrize("rows", [ODD, NAMELESS, corpus(4, 80), family(11, 120, 12, 120), []])
def test_join_matches_brute_force(spark, rows):
    assert Counter(map(tuple, ngram_join.jaccard_join(docs(spark, rows)).collect())) == brute_join(rows)


def test_large_cluster_of_near_copies_is_one_component(spark):
    base = [f"b{i}" for i in range(200)]
    rng = random.Random(6)
    rows = []
    for i in range(300):
        text = list(base)
        for _ in range(rng.randrange(0, 6)):
            text[rng.randrange(len(text))] = f"e{i}x{rng.randrange(9)}"
        rows.append((i, " ".join(text)))
    assert Counter(map(tuple, ngram_join.jaccard_join(docs(spark, rows)).collect())) == brute_join(rows)


@pytest.mark.parametrize("rows", [corpus(7, 60), [*family(12, 60, 14, 100), *corpus(13, 40)]])
def test_small_parts_and_blocks_stay_exact(spark, monkeypatch, rows):
    for name, value in (("BLOCK", 2), ("BROADCAST_ROWS", 0), ("PART_TOKENS", 50), ("BUCKET_CLASSES", 5), ("CHUNK_TOKENS", 100), ("SLICE", 7)):
        monkeypatch.setattr(ngram_join, name, value)
    assert Counter(map(tuple, ngram_join.jaccard_join(docs(spark, rows)).collect())) == brute_join(rows)


def test_sketches_never_differ_by_more_than_the_sets():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 400), dtype=np.uint64))
        b = np.unique(np.concatenate((rng.choice(a, rng.integers(0, len(a) + 1), replace=False), rng.integers(0, 1 << 63, rng.integers(0, 300), dtype=np.uint64))))
        if len(b):
            assert ngram_join.differ(ngram_join.sketch(a), ngram_join.sketch(b)) <= len(np.setxor1d(a, b))


def test_one_of_each_with_clashing_names(spark):
    rows = [*corpus(14, 40), (None, "no id"), (None, "no id")]
    table = docs(spark, rows)
    for name in ("_keep", "component_id", "n", "n_shingles", "rep", "text2"):
        table = table.withColumn(name, table["score"])
    heads = {i for i, _, c in brute_join(rows) if i == c and i is not None}
    kept = ngram_join.one_of_each(table)
    assert kept.columns == table.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted([*map(str, heads), "None", "None"])


def brute_hits(rows, items, n=10):
    words = decontaminate.words_of
    windows = {}
    for item, t in items:
        w = words(t)
        m = min(n, len(w))
        for k in range(len(w) - m + 1) if w else ():
            windows.setdefault(tuple(w[k : k + m]), set()).add(str(item))
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for m in {len(g) for g in windows}:
            for k in range(len(w) - m + 1):
                if (g := tuple(w[k : k + m])) in windows:
                    hit |= set(range(k, k + m))
                    found |= windows[g]
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return Counter(out)


def brute_matches(text, items, n=10):
    """All longest matches of the text's words with items, by comparing every start with every start."""
    w, best = decontaminate.words_of(text), {}
    for item, t in items:
        v = decontaminate.words_of(t)
        for p in range(len(w)):
            for o in range(len(v)):
                k = 0
                while p + k < len(w) and o + k < len(v) and w[p + k] == v[o + k]:
                    k += 1
                if k and k >= min(n, len(v)):
                    best[p] = min(best.get(p, (0, "", 0)), (-k, str(item), o))
    out, reach = [], -1
    for p in sorted(best):
        k, item, o = best[p]
        if p - k > reach:
            reach = p - k
            out.append((p, reach, item, o))
    return out


MATCH_ITEMS = [(1, " ".join(PASSAGE.upper().split()[5:20])), (2, "Two-Words"), (3, None), (4, ""), (5, "W1 W2"), (1, " ".join(PASSAGE.upper().split()[5:20])), (6, "x " + " ".join(PASSAGE.split()[8:31])), (7, " ".join(PASSAGE.split()[8:20]) + " y"), (8, "no id " * 8)]


@pytest.mark.parametrize("block", [32_000_000, 300])
def test_hits_match_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 100)
    rows = [*ODD, *corpus(5, 30)]
    bench = spark.createDataFrame(MATCH_ITEMS, "item_id long, text string")
    found = decontaminate.find_matches(docs(spark, rows).repartition(3), bench, block_chars=block).select("doc_id", "n_words", decontaminate.n_hit().alias("n_hit"), "items", "text", "matches").collect()
    assert Counter((r[0], r[1], r[2], tuple(r[3])) for r in found) == brute_hits(rows, MATCH_ITEMS)
    for r in found:
        if r["doc_id"] != 7:
            assert [tuple(m) for m in r["matches"]] == brute_matches(r["text"], MATCH_ITEMS)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs(spark, rows), empty).count() == len(rows)


@pytest.mark.parametrize("seed", range(12))
def test_longest_matches_match_brute_force(seed):
    rng = random.Random(seed)
    letters = "ab" if seed % 3 else "a"
    some = lambda most: " ".join(rng.choice(letters) for _ in range(rng.randrange(most)))
    items, n = [(str(i), some(40)) for i in range(rng.randrange(1, 8))], rng.choice([2, 4, 7])
    texts = [f"{some(50)} {rng.choice(items)[1]} c {some(50)}" for _ in range(6)]
    tests = decontaminate.Tests(items, n)
    for text in texts:
        numbers = np.array([tests.vocabulary.get(w, 0) for w in decontaminate.words_of(text)] + [0], np.uint32)
        positions, keys = tests.search(numbers)
        got = [(s, e, tests.names[tests.item_of[w]], tests.start_of[w]) for s, e, w in zip(*tests.longest(positions, keys), strict=True)] if len(positions) else []
        assert got == brute_matches(text, items, n)


def test_words_encode_as_whole_texts_do():
    rng = random.Random(5)
    letters = ["a", "B", "é", "ß", "1", ",", ".", "!", "'", "s", "\n", " ", " ", "’", "文", "́", "\t", " ", "<|endoftext|>"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 30))) for _ in range(3000)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        e = tokens.Encoder(tokens.tokenizer_path(name), most=50)
        got = [x for k in range(0, len(texts), 100) for x in e.encode(texts[k : k + 100])]
        assert got == [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_every_letter_before_a_mark_encodes_as_in_whole_texts():
    letters = [c for c in map(chr, range(0x30000)) if c.isalpha()]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        e = tokens.Encoder(tokens.tokenizer_path(name))
        for mark in ".,\n":
            texts = [" ".join(f"a{c}{mark}" for c in letters[k : k + 64]) for k in range(0, len(letters), 64)]
            assert e.encode(texts) == [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def brute_ids(rows, name, end):
    """(id, ids with the end id) of each row by the library alone."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path(name))
    return [(i, [*t.encode(x or "", add_special_tokens=False).ids, end]) for i, x in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


TURKISH = [(20, "İ. İ, Aİ. Bİ, İ.İ"), (21, "DİĞERLERİ. VE İ,\nİ.")]


def test_record_query_matches_the_library(spark, tmp_path):
    for rows in ([r for r in [*ODD, *TURKISH] if r[0] is not None and r[0] != 9], [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]):
        docs(spark, rows).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        want, at = [], 0
        for i, ids in sorted(brute_ids(rows, "word_bpe_49k.json", 1)):
            want.append((i, at, len(ids), crc(ids)))
            at += len(ids)
        got = token_records.op9_token_records(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
        assert sorted(map(tuple, got)) == want


def test_packing_query_matches_the_library(spark, tmp_path):
    rows = [r for r in [*ODD, *TURKISH] if r[0] is not None and r[0] != 9]
    docs(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = packing.op10_best_fit_packing(spark, str(tmp_path)).collect()
    pieces = {(r["doc_id"], r["piece"]): r for r in got}
    assert len(pieces) == len(got)
    for i, ids in brute_ids(rows, "byte_bpe_50k.json", 2):
        mine = [pieces.pop((i, k)) for k in range(max(1, -(-len(ids) // 1024)))]
        assert [r["start"] for r in mine] == [sum(x["length"] for x in mine[:k]) for k in range(len(mine))] and sum(r["length"] for r in mine) == len(ids)
        assert [r["ids_crc32"] for r in mine] == [crc(ids[r["start"] : r["start"] + r["length"]]) for r in mine]
        assert all(r["length"] == 1024 for r in mine[1:])
    assert not pieces


def test_records_round_trip_and_damage(tmp_path):
    for key, ids in ((5, [1, 2, 70_000]), (None, []), ("név", [1])):
        data = token_records.serialize(key, np.array(ids, "<u4").tobytes())
        record = token_records.frame(data)
        assert token_records.unframe(record) == (data, len(record))
        back = token_records.deserialize(data)
        assert back[0] == key and back[1].tolist() == ids
        with pytest.raises(ValueError):
            token_records.unframe(record[:-5] + b"?????")


def test_record_files(spark, tmp_path):
    path = tokens.tokenizer_path("word_bpe_49k.json")
    table = docs(spark, ODD).repartition(4)
    manifest = token_records.write_records(table, f"file://{tmp_path}/r", path, 1)
    rows = token_records.read_records(spark, manifest, table.schema["doc_id"].dataType, with_ids=True).collect()
    rows.sort(key=lambda r: r["start"])
    assert [r["id"] for r in rows] == sorted((i for i, _ in ODD), key=lambda i: (i is not None, i or 0))
    assert all(r["start"] == sum(x["n_tokens"] for x in rows[:k]) and r["ids"][-1] == 1 for k, r in enumerate(rows))
    assert Counter(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows) == Counter(r["ids_crc32"] for r in rows)
    last = manifest[-1]
    assert token_records.read_record(last["path"], last["records"] - 1)[1].tolist() == rows[-1]["ids"]
    assert token_records.write_records(docs(spark, []), f"file://{tmp_path}/e", path, 1) == []
    assert token_records.read_records(spark, [], table.schema["doc_id"].dataType).count() == 0


@pytest.mark.parametrize("lengths", [[], [5], [1024] * 3, [400] * 100 + [324] * 50 + [300] * 77, np.random.default_rng(8).integers(1, 1025, 20_000).tolist(), np.random.default_rng(9).integers(200, 700, 500).tolist()])
def test_plan_holds_every_piece_in_few_sequences(lengths):
    plan = packing.plan_sequences(dict(Counter(lengths)))
    held = Counter()
    for b in plan:
        assert b.count > 0 and sum(b.lengths) <= 1024
        for x in b.lengths:
            held[x] += b.count
    assert held == Counter(lengths)
    least = max(math.ceil(sum(lengths) / 1024), sum(x > 512 for x in lengths))
    assert sum(b.count for b in plan) <= 1.08 * least + 1


def test_packing_on_odd_rows(spark):
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    rows = packing.pack_documents(docs(spark, ODD), path, 2, with_ids=True).collect()
    places = {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in places.values():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:k]) for k in range(len(v))] and sum(n for _, n in v) <= 1024
    whole = sorted((r for r in rows if r["doc_id"] == 7), key=lambda r: r["piece"])
    assert all(r["length"] == 1024 for r in whole[1:]) and [r["start"] for r in whole] == [sum(x["length"] for x in whole[:k]) for k in range(len(whole))]
    assert packing.pack_documents(docs(spark, []), path, 2).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    d = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{d}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    rows = list(texts.items())
    joined = brute_join(rows)
    heads = {i for i, _, c in joined if i == c}
    kept = cp.near_duplicates(spark, table, d)
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} == heads
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    clean = cp.benchmark_decontamination(spark, table, d)
    assert clean.columns == table.columns and {r["doc_id"] for r in clean.collect()} == {i for (i, _, h, _) in brute_hits(rows, items) if h == 0}
    assert cp.pii(spark, table, d).columns == table.columns
    mild = cp.toxicity(spark, table, d)
    assert mild.columns == table.columns and 0.8 * len(rows) < mild.count() < len(rows)
    odd = docs(spark, ODD)
    for stage in (cp.near_duplicates, cp.benchmark_decontamination, cp.pii, cp.toxicity):
        assert stage(spark, odd, d).columns == odd.columns
    assert cp.run(spark, d).count() > 0


def test_removed_spans_are_the_union_of_removed_windows(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(13)) for c in "ab")
    rows = {r["doc_id"]: r for r in substrings.remove_repeats(docs(spark, [(1, one), (2, two), (3, f"{one} {two} end")])).collect()}
    assert [tuple(x) for x in rows[3]["removed_spans"]] == [(0, 26)] and rows[3]["n_removed"] == 26 and not rows[1]["removed_spans"]


def test_columns_encode_without_texts_and_words_stay_bounded():
    rng = random.Random(9)
    texts = [None, "", *(" ".join("".join(rng.choice("abcdé.,\n") for _ in range(1, rng.randrange(2, 9))) for _ in range(40)) for _ in range(300))]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        e = tokens.Encoder(tokens.tokenizer_path(name), most=400)
        column = pa.array(["skipped", *texts]).slice(1)
        want = [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        for k in range(0, len(texts), 50):
            assert e.encode(column.slice(k, 50)) == want[k : k + 50]
            assert len(e.words) + len(e.parts) <= 400
        assert e.encode(column.slice(0, 0)) == []


def test_workers_give_the_encoder_back_to_the_next_stage():
    from loomstrand.llm import common

    tokens.encoder(tokens.tokenizer_path("byte_bpe_50k.json")).encode(["some words"])
    list(ngram_join._slices(iter([])))
    assert tokens.encoder.cache_info().currsize == 0 and tokens.encoder.cache_clear in common.KEPT


def test_stages_begin_with_what_others_held_given_back(spark, monkeypatch):
    import corpus_pipeline as cp

    from loomstrand.llm import common

    common._powers(1 << 16, common.BASE)
    common.release()
    assert common._powers.cache_info().currsize == 0
    asked = []
    monkeypatch.setattr(cp, "give_back", lambda s: (asked.append(s), common.give_back(s)))
    docs = spark.createDataFrame([(1, "some words", "en")], "doc_id long, text string, lang string")
    for name in ("ngram_jaccard_join", "best_fit_packing"):
        assert dict(cp.STAGES)[name](spark, docs, "").count() == 1
    assert asked == [spark, spark]
