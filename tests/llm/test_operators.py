import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import corpus, frame
from transit_spark.llm import language, lines, links, mixing, partenum, piece_table, quality, run_index, sharding, small_world, token_files
from transit_spark.llm.common import components
from transit_spark.llm.queries import vocabulary

ROWS = corpus()


def test_repeated_strings_equal_brute_force(docs, nothing):
    got = sorted(tuple(r)[:5] for r in run_index.repeated_strings(docs).collect())
    rows = [r for r in ROWS if r[0] != 80]
    assert [g for g in got if g[0] != 80] == [w for w in brute.repeated_strings(rows, 100) if w[0] != 80]
    twice = [g for g in got if g[0] == 80]
    assert len(twice) == 2 and all(g[2] == g[1] for g in twice)  # document 2 has the same text
    assert run_index.repeated_strings(nothing).count() == 0


def test_run_index_finds_the_earliest_place():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 99, rng.integers(0, 60)).astype(np.uint8)) for _ in range(150)]
    index = run_index.RunIndex(texts, 9)
    place, first = index.earliest()
    whole, seen = b"\n".join(texts) + b"\n", {}
    for p in sorted(place.tolist()):
        seen.setdefault(whole[p : p + 9], p)
    assert len(place) == sum(max(0, len(t) - 8) for t in texts)
    assert all(seen[whole[p : p + 9]] == f for p, f in zip(place.tolist(), first.tolist()))
    assert len(index.heads) < index.rows


def test_long_texts_are_cut_into_units_without_loss(monkeypatch):
    monkeypatch.setattr(run_index, "UNIT_BYTES", 1000)
    text = bytes(np.random.default_rng(1).integers(0, 256, 5_000).astype(np.uint8))
    owner, first, last, _ = run_index.all_stretches([text, b"short"])
    assert set(owner.tolist()) == {0}
    assert sorted(s for a, b in zip(first, last) for s in range(a, b + 1)) == list(range(len(text) - 99))


def _parts(texts, length):
    """What may be shared of every distinct segment whose anchor has others: (segment, begin, end)."""
    owner, first, last, hashes = run_index.all_stretches(texts, length)
    of_anchor = {}
    for o, f, e, h in zip(owner.tolist(), first.tolist(), last.tolist(), hashes.tolist()):
        of_anchor.setdefault(h, {})[texts[o][f : e + length]] = None
    groups = [(h, list(held)) for h, held in of_anchor.items() if len(held) > 1]
    places = run_index.anchor_places([held[0] for _, held in groups], np.array([h for h, _ in groups], np.uint64), length)
    assert all(p >= 0 for p in places)
    return [(t, *part) for (_, held), p in zip(groups, places) for t, part in zip(held, run_index.shared_parts(held, p, length))]


def test_a_line_in_many_contexts_needs_no_index():
    """The line is shorter than a string, so its 2,000 segments have one anchor and nothing else in common."""
    rng = np.random.default_rng(4)
    line = bytes(rng.integers(97, 123, 70, np.uint8))
    texts = [bytes(rng.integers(97, 123, 60, np.uint8)) + line + bytes(rng.integers(97, 123, 60, np.uint8)) for _ in range(2000)]
    parts = _parts(texts, 100)
    assert len(parts) >= 2000 and all(part[1:] == (0, 0) for part in parts)
    texts.append(texts[7][:40] + b"#" + texts[7][41:])  # its last 149 bytes have been met
    left = [(t, a, b) for t, a, b in _parts(texts, 100) if b]
    assert 2 <= len(left) <= 8


@pytest.mark.parametrize("unit", [1 << 20, 70])
@pytest.mark.parametrize("length", [33, 60, 100])
def test_what_segments_share_stays_in_their_parts(monkeypatch, length, unit):
    monkeypatch.setattr(run_index, "UNIT_BYTES", unit)
    monkeypatch.setattr(run_index, "PLACES", 5)
    rng = np.random.default_rng(length)
    words = [bytes(rng.integers(97, 100, rng.integers(2, 30), np.uint8)) for _ in range(12)] + [b"ab" * 60, b"a" * 150]
    texts = [b"".join(words[k] for k in rng.integers(0, len(words), rng.integers(1, 25))) for _ in range(60)]
    parts = _parts(texts, length)
    holders = {}
    for k, (text, _, _) in enumerate(parts):
        for at in range(len(text) - length + 1):
            holders.setdefault(text[at : at + length], {}).setdefault(k, at)
    shared = [(k, at) for held in holders.values() if len(held) > 1 for k, at in held.items()]
    assert shared and all(parts[k][1] <= at and at + length <= parts[k][2] for k, at in shared)
    assert sum(b - a for _, a, b in parts) < sum(len(t) for t, _, _ in parts)


def test_buckets_are_even():
    """Anchors are the least of 81 hashes; dealt by these as they are, the first of 64 buckets had seven tenths of them."""
    text = bytes(np.random.default_rng(2).integers(0, 256, 400_000).astype(np.uint8))
    hashes = run_index.all_stretches([text])[3]
    sizes = np.bincount(run_index.buckets(hashes, 64), minlength=64)
    assert len(sizes) == 64 and sizes.max() < 1.5 * sizes.mean()


def test_chunks_of_large_inputs_are_large(spark):
    """Every chunk sends a row to every bucket, so an input twice as large must not have twice as many chunks of one size."""
    rows = spark.range(40, numPartitions=1).selectExpr("id as doc_id", "repeat('x', 100000) as text")

    def chunks(n_bytes):
        kind = "chunk long, ids array<long>, lengths array<long>, data binary"
        return [len(r.ids) for r in rows.mapInArrow(lambda b: run_index._chunk(b, n_bytes), kind).select("ids").collect()]

    assert sum(chunks(1 << 20)) == sum(chunks(4 << 20)) == 40
    assert len(chunks(1 << 20)) == 4 and len(chunks(4 << 20)) == 1


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_partenum_equals_brute_force(docs, nothing, n, percent):
    got = {r[0]: (r[1], r[2]) for r in partenum.near_duplicates(docs, n, percent).collect()}
    assert got == brute.near_duplicates(ROWS, n, percent)
    assert partenum.near_duplicates(nothing, n, percent).count() == 0


def test_partenum_null_ids(spark):
    df = frame(spark, [(None, "a b c d e", "en", "s"), (1, "a b c d e", "en", "s"), (None, None, None, None)])
    got = sorted(map(tuple, partenum.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 2, None), (1, 2, 1), (None, 0, None)], key=str)


@pytest.mark.parametrize("percent", [80, 85, 90])
def test_linked_sets_always_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    for k in range(200):
        size = int(rng.integers(1, 90) if k < 150 else rng.integers(90, 3000))
        one = np.unique(rng.integers(0, 1 << 63, size, dtype=np.int64).astype(np.uint64))
        other = one[rng.permutation(len(one))[: max(1, len(one) - int(rng.integers(0, 1 + len(one) // 8)))]]
        other = np.unique(np.r_[other, rng.integers(0, 1 << 63, int(rng.integers(0, 1 + len(one) // 12)), dtype=np.int64).astype(np.uint64)])
        common = len(np.intersect1d(one, other))
        if 100 * common >= percent * (len(one) + len(other) - common):
            keys, owner = partenum.signatures([one, other], percent)
            assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())


def test_packed_token_files(spark, docs, nothing, tmp_path):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    files = token_files.write_token_files(docs, f"{tmp_path}/ids", path)
    got = sorted(map(tuple, token_files.read_token_files(files).collect()))
    ids = [(r[0], tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in sorted(ROWS, key=lambda r: r[0])]
    start, want = 0, []
    for i, own in ids:
        want.append((i, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    assert got == sorted(want)
    assert token_files.read_token_files(token_files.write_token_files(nothing, f"{tmp_path}/none", path)).count() == 0


@pytest.mark.parametrize("width", [1, 3, 8, 15, 16, 17, 20, 32])
def test_packing_round_trip_and_random_access(tmp_path, width):
    rng = np.random.default_rng(width)
    docs = [rng.integers(0, 1 << min(width, 31), n).astype(np.uint32) for n in (0, 1, 70_000, 5, 140_000)]
    writer = token_files.IdWriter(f"{tmp_path}/a.idpk", width, 0)
    for k, ids in enumerate(docs):
        writer.add(k if k else None, ids)
    writer.close()
    reader, whole = token_files.IdReader(f"{tmp_path}/a.idpk"), np.concatenate(docs)
    assert reader.docs == [None, 1, 2, 3, 4]
    for s, n, ids in zip(reader.starts, reader.counts, docs):
        assert (reader.ids(int(s), int(n)) == ids).all()
    assert (reader.ids(65_000, 80_000) == whole[65_000:145_000]).all()


def test_pieces_equal_the_library(docs, nothing):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = []
    for i, t, *_ in ROWS:
        ids = model.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest(), ids))
    got = [(*tuple(r)[:4], r["ids"]) for r in piece_table.encode_pieces(docs, path, with_ids=True).collect()]
    assert sorted(got) == sorted(want)
    assert piece_table.encode_pieces(nothing, path).count() == 0


def test_pieces_of_odd_texts():
    import random

    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    model, table, rng = sentencepiece.SentencePieceProcessor(model_file=path), piece_table.PieceTable(path), random.Random(5)
    odd = [" " * k + w for k in range(0, 36) for w in ("", "the", ".", "\n", "日")] + ["▁▁a", "x▁ ▁y", "a\0b", "😀a", "<s></s><0x41>"]
    odd += ["".join(rng.choice("abcdeth  \n.,éü▁1X") for _ in range(rng.randint(1, 50))) for _ in range(1500)]
    for text in odd:
        ids = model.encode(text)
        assert table.encode(text) == ids and table.decode(ids) == model.decode(ids)


def test_mixing_meets_targets(docs, nothing):
    rows = mixing.mix(docs, F.array("source")).collect()
    assert len(rows) == len(ROWS)
    size, taken, target = {}, {}, {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        s = r["sources"][0]
        size[s] = size.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s] = r["taken_by"][0]["target"]
    names = sorted(size, key=lambda s: (s is None, s or ""))
    assert names[-1] is None
    weights = {s: k % 3 + 1 for k, s in enumerate(names)}
    free = [s for s in names if target[s] < 3 * size[s] - 1e-6]
    assert all(math.isclose(target[s] / weights[s], target[free[0]] / weights[free[0]]) for s in free)
    assert math.isclose(sum(target.values()), sum(size.values())) and all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(5), F.array("source")).collect()))
    assert mixing.mix(nothing, F.array("source")).count() == 0
    assert mixing.mixed_rows(docs).columns == docs.columns


def test_mixing_of_overlapping_sources(spark):
    rows = [(k, "w " * 10, ["a"] if k < 10 else ["a", "b"] if k < 30 else None) for k in range(31)]
    df = spark.createDataFrame(rows, "doc_id long, text string, of array<string>")
    got = mixing.mix(df, F.col("of"), weights=(1, 3)).collect()
    by = {}
    for r in got:
        for t in r["taken_by"]:
            by[t["source"]] = by.get(t["source"], 0) + t["words"]
    want = {t["source"]: t["target"] for r in got for t in r["taken_by"]}
    assert all(abs(by[s] - want[s]) <= 1 for s in want) and [r["taken"] for r in got if not r["sources"]] == [0]


def test_flow_repeats_only_where_it_must():
    flow = mixing.min_cost_flow([100, 50, 30], [[0], [0, 1], [1]], [120, 110])
    assert flow[0, 0] == 100 and flow[1, 0] == 20 and flow[1, 1] + flow[2, 1] == 110
    assert mixing.share_targets([10, 1000, 1000], [3, 1, 1]) == [30.0, 990.0, 990.0]
    assert mixing.share_targets([0, 0], [1, 2]) == [0.0, 0.0] and mixing.share_targets([], []) == []


def test_small_world_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 16))
    near = base[:1] + 0.05 * rng.normal(size=(60, 16))
    vectors = [list(map(float, v)) for v in np.r_[base, near, base[5:6], base[5:6]]]
    vectors += [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] + [0.0] * 14, [1.0, 2.0], [float("inf")] * 16, [1e300] * 16, [1e-300] * 16]
    df = spark.createDataFrame([(k, v, "x") for k, v in enumerate(vectors)], "vec_id long, embedding array<double>, label string")
    good = [k for k, v in enumerate(vectors) if v and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = small_world.unit(np.array([vectors[k] for k in good]))
    union, n = brute.Union(), dict.fromkeys(range(len(vectors)), 0)
    for a in range(len(good)):
        for b in range(a):
            if unit[a] @ unit[b] >= 0.9:
                n[good[a]] += 1
                n[good[b]] += 1
                union.join(good[a], good[b])
    want = sorted((k, n[k], union.find(k), union.find(k) == k) for k in range(len(vectors)))
    assert sorted(map(tuple, small_world.near_vectors(df).collect())) == want
    assert small_world.near_vectors(df.where("false")).count() == 0


def test_quality_rules(docs, nothing):
    for r in quality.quality_rules(docs).collect():
        text = [t for i, t, *_ in ROWS if i == r["doc_id"]][0] or ""
        words = [w for w in text.translate({k: " " for k in range(9, 14)}).split(" ") if w]
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)} if len(words) < 2000 else None
        held = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
        assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words)) and r["n_dup_lines"] == len(held) - len(set(held))
        assert r["n_symbols"] == sum(c in quality.SYMBOLS for c in text)
        if covered is not None:
            assert r["n_repeat_words"] == len(covered)
            assert r["base_failed"] == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
        assert not (r["base_failed"] and r["kept"])
    assert quality.quality_rules(nothing).count() == 0
    plan = quality.quality_rules(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange hashpartitioning" not in plan


def test_language_of_held_out_texts(spark, nothing):
    rng = np.random.default_rng(4)
    stems = {"aa": ["kala", "mira", "sono"], "bb": ["trng", "vlks", "prdt"]}
    rows = [(k, " ".join(rng.choice(stems[lang], 12)), lang, "s") for k in range(200) for lang in [["aa", "bb"][k % 2]]]
    odd = [(500, None, "aa", "s"), (501, "", None, "s"), (502, "123 !", "aa", "s"), (503, "kala mira", None, "s"), (504, "TRNG VLKS", None, "s"), (505, "日本", None, "s")]
    df = frame(spark, rows + odd)
    sample = language.labelled_sample(df)
    assert set(sample) == {"aa", "bb"}
    got = {r["doc_id"]: r for r in language.identify(df, sample).collect()}
    assert all(got[k]["lang_pred"] == lang for k, _, lang, _ in rows)
    assert [got[k]["lang_pred"] for k in (500, 501, 502)] == ["und"] * 3 and [got[k]["lang_pred"] for k in (503, 504)] == ["aa", "bb"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.identify(nothing, language.labelled_sample(nothing)).count() == 0
    assert {r["lang_pred"] for r in language.identify(df, {}).collect()} == {"und"}
    kept = language.identified_rows(df, sample)
    assert kept.columns == df.columns and kept.count() == len(rows) + 3
    held = {k for k, *_ in rows if zlib.crc32(str(k).encode()) % 5 == 0}
    assert {r[0] for r in df.where(language.held_out(F.col("doc_id"))).where("doc_id < 200").select("doc_id").collect()} == held


def test_suffix_automaton_knows_every_substring():
    codes = np.random.default_rng(0).integers(0, 3, 60)
    table = language.suffix_automaton(codes, 3)
    known = {tuple(codes[a:b]) for a in range(60) for b in range(a + 1, min(60, a + 8) + 1)}
    for word in known | {(0, 1, 2, 2, 1, 0, 0), (2, 2, 2, 2, 2, 2)}:
        state = 0
        for c in word:
            state = table[state, c] if state >= 0 else -1
        assert (state >= 0) == (word in known)


def test_fuzzy_lines_equal_brute_force(spark, nothing):
    text = "The quick brown fox jumps over the lazy dog near the old river bank at noon"
    rows = [(1, f"{text}\nother words here entirely\n\n{text}", "en", "s"), (2, text.replace("dog", "cat"), "en", "s"), (3, "short\n \nshort", "en", "s")]
    rows += [(10 + k, f"line number {k} stands alone with {'xyz' * k}\n{text} {k}", "en", "s") for k in range(9)] + [(4, None, None, None), (5, "", "en", "s")]
    df = frame(spark, rows)
    assert {r[0]: r[1] for r in lines.repeated_lines(df).collect()} == brute.repeated_lines(rows)
    out = {r["doc_id"]: r for r in lines.dedup_lines(df).collect()}
    assert out[1]["text"] == f"{text}\nother words here entirely\n" and out[3]["text"] == "short\n " and out[4]["text"] is None
    assert lines.dedup_lines(nothing).count() == 0 and lines.dedup_lines(df).columns == [*df.columns, "__removed"]


def test_fixed_slots(docs, nothing):
    rows = sharding.slotted(docs)
    loads = sharding.slot_loads(rows)
    slot_map = sharding.rebalance(sharding.first_map(docs.sparkSession, shards=3), loads, 3)
    got = sharding.shard_rows(rows, slot_map, loads).collect()
    assert len(got) == len(ROWS) and slot_map.count() == sharding.SLOTS
    for s in range(3):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    by = {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS}
    assert all((r["size"], r["text_crc32"]) == by[r["doc_id"]] for r in got)
    assert sharding.shard_rows(sharding.slotted(nothing), slot_map, loads).count() == 0


def test_rebalancing_edits_the_map(spark, tmp_path):
    loads = spark.range(512).selectExpr("int(id) as virtual_slot", "id % 7 + 1 as bytes", "1L as n_rows")
    maps = str(tmp_path / "maps")
    one = sharding.save_map(sharding.rebalance(sharding.first_map(spark, 512, 8), loads, 8), maps, 1)
    two = sharding.save_map(sharding.rebalance(one, loads, 9), maps, 2)
    sums = [r[0] for r in two.join(loads, "virtual_slot").groupBy("shard").agg(F.sum("bytes")).select("sum(bytes)").collect()]
    assert len(sums) == 9 and max(sums) - min(sums) <= 7
    moved = one.join(two.withColumnRenamed("shard", "now"), "virtual_slot").where("shard <> now").count()
    assert moved <= 0.2 * 512
    assert sharding.load_map(spark, maps, 1).exceptAll(one).count() == 0 and sharding.load_map(spark, maps).exceptAll(two).count() == 0


def test_components_of_chains_hubs_and_none(spark):
    edges = [(k, k + 1) for k in range(0, 30)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{k: 0 for k in range(1, 31)}, **{100 + k: 100 for k in range(1, 40)}, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_with_many_parts_lose_no_link(spark):
    # one large group: nodes are linked when they lie next to each other and share a hundred, so stars find little at first
    nodes = np.array([h * 100 + k for h in range(3) for k in range(25)], np.int64)
    batches = list(links.split_groups(np.zeros(len(nodes), np.uint32), nodes))
    rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("kind", "a", "b", "members")))]
    groups = spark.createDataFrame(rows, links.GROUPS)
    sets = spark.createDataFrame([(n, list(range(n, n + 20))) for n in nodes.tolist()], "node long, elements array<long>")
    got = dict(map(tuple, links.linked_components(groups, lambda pairs: pairs.where("b - a = 1"), lambda nodes: sets.join(nodes, "node"), 85).collect()))
    assert got == {int(n): int(n) // 100 * 100 for n in nodes if n % 100}


def test_tiles_find_the_links_across_labels(spark, monkeypatch):
    monkeypatch.setattr(links, "BLOCK_ELEMENTS", 500)
    monkeypatch.setattr(links, "COLUMNS", 16)
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 62), 1 << 62, 30)
    sets = {n: sorted({int(x) for x in np.r_[rng.choice(base, 26, replace=False), rng.integers(0, 1 << 62, n % 4)]}) for n in range(60)}
    rows = [(key, n, n // 3 * 3, 0) for key in (1, 2) for n in sets if n % 2 < key]
    rows = spark.createDataFrame([(k, n, c, sum(r[0] == k for r in rows)) for k, n, c, _ in rows], "key long, node long, c long, n long")
    held = spark.createDataFrame(list(sets.items()), "node long, elements array<long>")

    def sets_of(nodes):
        return held.join(nodes, "node")

    got = {tuple(r) for r in links._links_across(rows, sets_of, 80).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and a // 3 != b // 3 and 100 * len({*sets[a]} & {*sets[b]}) >= 80 * len({*sets[a]} | {*sets[b]})}
    assert want and got == want
    assert links._links_across(rows.where("false"), sets_of, 80).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_rare_groups_hold_every_linked_pair(spark, monkeypatch, percent):
    monkeypatch.setattr(links, "BUCKET_BYTES", 1 << 10)
    monkeypatch.setattr(links, "TASK_ELEMENTS", 100)
    rng = np.random.default_rng(percent)
    rows = []
    for family in range(6):  # sets of one family differ by up to a fifth, some in size alone; sets 0 and 1 come twice
        base = rng.integers(-(1 << 62), 1 << 62, int(rng.integers(1, 90)))
        for k in range(25):
            cut = int(rng.integers(0, len(base) // 5 + 1))
            more = rng.integers(-(1 << 62), 1 << 62, int(rng.integers(0, len(base) // 8 + 1)))
            rows.append((family * 25 + k, sorted({int(x) for x in np.r_[base[cut:], more]})))
    rows += [rows[0], (rows[1][0], rows[30][1]), (500, [])]
    sets = spark.createDataFrame(rows, "node long, elements array<long>").repartition(3)
    together: dict[int, set] = {}
    for key, node in links._rare_groups(sets, percent).collect():
        together.setdefault(key, set()).add(node)
    met = {(a, b) for group in together.values() for a in group for b in group}
    want = {(a, b) for a, x in rows for b, y in rows if a != b and x and 100 * len({*x} & {*y}) >= percent * len({*x} | {*y})}
    assert len(want) > 100 and want <= met
    assert links._rare_groups(sets.where("false"), percent).count() == 0


def test_near_copies_that_are_not_linked_leave_few_groups(spark, monkeypatch):
    """120 sets share 130 elements and 10 signatures, but only planted pairs are linked: no others are compared in the end."""
    rng = np.random.default_rng(11)
    base = rng.integers(-(1 << 62), 1 << 62, 130)
    sets = {n: {int(x) for x in np.r_[base, rng.integers(-(1 << 62), 1 << 62, 17)]} for n in range(120)}
    for n in (50, 90):
        sets[n + 1] = {*list(sets[n])[2:], n}
    owners = np.concatenate([np.r_[k, np.flatnonzero(rng.random(120) < 0.9)] for k in range(10)])
    keys = np.cumsum(np.r_[0, np.diff(owners) < 0]).astype(np.uint32)
    rows = [r for b in links.split_groups(keys, owners.astype(np.int64)) for r in zip(*(c.to_pylist() for c in b.columns))]
    held = spark.createDataFrame([(n, list(x)) for n, x in sets.items()], "node long, elements array<long>")
    compared, across = [], links._links_across

    def counted(rows, *more):
        compared.append(rows.select("node").distinct().count())
        return across(rows, *more)

    def verify(pairs):
        x, y = (held.select(F.col("node").alias(n), F.col("elements").alias(e)) for n, e in (("a", "x"), ("b", "y")))
        both = F.size(F.array_intersect("x", "y"))
        return pairs.join(x, "a").join(y, "b").where(100 * both >= 85 * (F.size("x") + F.size("y") - both)).select("a", "b")

    monkeypatch.setattr(links, "_links_across", counted)
    found = links.linked_components(spark.createDataFrame(rows, links.COUNTED), verify, lambda nodes: held.join(nodes, "node"), 85)
    assert sorted(map(tuple, found.collect())) == [(51, 50), (91, 90)]
    assert compared == [4]


def test_shingles_of_two_lines_packed():
    rng = np.random.default_rng(5)
    kinds = ["abc é", "abc ☃日本", "".join(chr(0x4E00 + k) for k in range(600)), "ab\U0001f600\ud83d"[:3]]
    for k in range(400):
        letters = kinds[k % 4]
        x = "".join(rng.choice(list(letters), rng.integers(1, 300)))
        at = int(rng.integers(0, len(x)))
        y = x[:at] + letters[0] + x[at + 1 :] if k % 3 else "".join(rng.choice(list(letters), rng.integers(1, 300)))
        a, b = lines.shingles(x), lines.shingles(y)
        sizes = lines.common_shingles(x, y)
        assert sizes[:2] == (len(a), len(b)) and sizes[2] in (len(a & b), 0)
        assert (sizes[2] >= 0.8 * (sizes[0] + sizes[1] - sizes[2])) == (len(a & b) >= 0.8 * len(a | b))


def test_lines_unlike_any_other_are_not_shuffled_again(spark):
    text = "The quick brown fox jumps over the lazy dog near the old river bank at noon"
    rows = [(k, f"{'abcdefghijkl'[k % 12] * 20} {k * 7919} alone{k}\nsame\n{text} {k % 2}\nsame", "en", "s") for k in range(40)]
    rows += [(3, "same\nother words", "en", "s"), (7, rows[7][1], "en", "s"), (-5, "x\nsame", "en", "s")]
    df = frame(spark, rows)
    found = spark.createDataFrame([(lines.node(f"{text} 1"), lines.node(f"{text} 0"))], "node long, component long")
    places = lines.line_places(df.select("doc_id", "text"), found, 16)
    own = places.where("c is not null").collect()
    assert sorted((r.doc_id, r.number) for r in own) == [(0, 2), (1, 2)] and {r.c for r in own} == {lines.node(f"{text} 0")}
    gone = {(r.doc_id, r.number) for r in places.where("c is null").collect()}
    assert gone == {(k, n) for k in range(40) for n in (1, 3)} | {(k, 2) for k in range(2, 40)} | {(3, 0)}
