"""Every operator against a brute-force version over whole small tables."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from compare import differences
from thermalcube.llm import digest, edit_counts, mixing, packing, sharding, simhash, token_store, topk, toxicity, unit_dedup
from thermalcube.llm.queries import ORACLES, QUERIES, sample_edits
from thermalcube.llm.simhash import mixed
from thermalcube.llm.words import tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), ORACLES[name], SF) == ""


def _signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def _brute_shard(doc_id, shards):
    """Spark's XXH64 of two longs is that of the second with the first's hash as its seed."""
    seed = xxhash.xxh64_intdigest(int(doc_id).to_bytes(8, "little", signed=True), 42)
    scores = [xxhash.xxh64_intdigest(s.to_bytes(8, "little"), seed) >> 11 for s in range(shards)]
    return max(range(shards), key=lambda s: (scores[s], -s))


def test_shards_by_brute_force(spark, docs):
    got = QUERIES["op1_rendezvous_shards"](spark, SF).toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    texts = dict(zip(docs.doc_id, docs.text))
    for r in got.itertuples():
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert r.shard == _brute_shard(r.doc_id, 40)
        assert r.grown_shard == _brute_shard(r.doc_id, 41)
        assert r.grown_shard in (r.shard, 40)
    for _, slots in got.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))


def test_weighted_shards_fill_by_weight_and_move_little(spark):
    rows = spark.range(20000).withColumnRenamed("id", "doc_id")
    three = rows.withColumn("s", sharding.rendezvous(F.col("doc_id"), [1, 2, 5])).withColumn(
        "t", sharding.rendezvous(F.col("doc_id"), [1, 2, 5, 2])
    ).toPandas()
    assert np.allclose(three.s.value_counts(normalize=True).sort_index(), [1 / 8, 2 / 8, 5 / 8], atol=0.02)
    assert set(three.t[three.s != three.t]) == {3}


def _brute_prints(texts):
    out = []
    for text in texts:
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return out


def _brute_components(ids, prints, radius):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: low[find(i)] for i, d in enumerate(ids)}


def test_simhash_by_brute_force(spark, docs):
    got = QUERIES["op2_simhash_near_dedup"](spark, SF).toPandas().set_index("doc_id")
    prints = _brute_prints(docs.text)
    assert dict(got.fingerprint) == {d: f"{p:016x}" for d, p in zip(docs.doc_id, prints)}
    assert dict(got.component_id) == _brute_components(list(docs.doc_id), prints, 2)


def test_bit_sliced_comparison_finds_every_pair():
    rng = np.random.default_rng(1)
    for bits, radius in ((64, 2), (64, 0), (64, 1), (256, 44), (128, 7), (1024, 166)):
        base = rng.integers(0, 2**63, (20, bits // 64), dtype=np.uint64)
        rows = base[rng.integers(0, 20, 400)].copy()
        for r in rows:
            for b in rng.integers(0, bits, rng.integers(0, radius + 3)):
                r[b // 64] ^= np.uint64(1 << int(b % 64))
        sizes = [1, 2, 63, 64, 65, 0, 205]
        begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = np.arange(400)
        i, j = simhash.close_pairs(rows, begin, place, radius)
        got = set(zip(i.tolist(), j.tolist()))
        want = {
            (a, b) for a in range(400) for b in range(begin[a], a)
            if int(np.bitwise_count(rows[a] ^ rows[b]).sum()) <= radius
        }
        assert got == want and want


def test_bit_sums():
    rng = np.random.default_rng(12)
    for n in (0, 1, 254, 255, 256, 1000):
        h = rng.integers(0, 2**64, (3, n), dtype=np.uint64, endpoint=False)
        want = [[int((row >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)] for row in h]
        assert simhash.bit_sums(h).tolist() == want


def test_links_of_large_buckets_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 8)
    rng = np.random.default_rng(2)
    values = sorted({int(sum(1 << int(b) for b in rng.integers(0, 12, rng.integers(0, 7)))) for _ in range(150)})
    rows = [(bytearray(v.to_bytes(8, "big")), [7]) for v in values]
    nodes = spark.createDataFrame(rows, "print binary, keys array<long>")
    from thermalcube.llm.components import connected_components

    got = {bytes(r.node): bytes(r.root) for r in connected_components(simhash.links(nodes, simhash.SimHash())).collect()}
    want = _brute_components(values, values, 2)
    full = {v: int.from_bytes(got.get(v.to_bytes(8, "big"), v.to_bytes(8, "big")), "big") for v in values}
    assert full == want


def _linked(spark, monkeypatch, values, how):
    """Number of links and the component of each value, all in one bucket of blocks of some 8 rows."""
    from thermalcube.llm.components import connected_components

    monkeypatch.setattr(simhash, "BUCKET_ROWS", 8)
    size = how.bits // 8
    nodes = spark.createDataFrame([(bytearray(v.to_bytes(size, "big")), [7]) for v in values], "print binary, keys array<long>")
    found = simhash.links(nodes, how).persist()
    got = {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in connected_components(found).collect()}
    return found.count(), {v: got.get(v, v) for v in values}


def test_links_of_a_close_group_grow_with_its_size(spark, monkeypatch):
    """All values within four bits of each other: a link or two of each, not one for each pair of blocks."""
    rng = np.random.default_rng(4)
    for n in (64, 256):
        values = set()
        while len(values) < n:
            values.add(sum({1 << int(b) for b in rng.integers(0, 128, 2)}))
        count, roots = _linked(spark, monkeypatch, sorted(values), simhash.SimHash(bits=128, radius=4))
        assert set(roots.values()) == {min(values)}
        assert count < 2 * n


def test_links_between_two_nodes_of_far_groups_are_found(spark, monkeypatch):
    """Five groups of 40; of each two that follow one another one pair alone is close, but for the last two."""
    rng, groups = np.random.default_rng(6), []
    for g in range(5):
        base = ((1 << 50) - 1) << 50 * g
        groups.append([base ^ sum({1 << int(b) for b in rng.integers(0, 250, 2)}) for _ in range(40)])
    for one, other in zip(groups[:3], groups[1:4]):
        way = [b for b in range(256) if (one[0] ^ other[0]) >> b & 1]
        # A path of values four bits apart, of which only the ends belong to a group.
        value = one[0]
        for k in range(0, len(way), 4):
            value ^= sum(1 << b for b in way[k : k + 4])
            one.append(value)
    values = sorted({v for group in groups for v in group})
    _, roots = _linked(spark, monkeypatch, values, simhash.SimHash(bits=256, radius=4))
    assert roots == _brute_components(values, values, 4)
    assert len(set(roots.values())) == 2


def test_links_of_near_copies_grow_with_their_number(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 8)
    counts, connect = [], simhash.connected_components

    def counted(links):
        counts.append(links.count())
        return connect(links)

    monkeypatch.setattr(simhash, "connected_components", counted)
    base = [f"w{k}" for k in range(200)]
    rows = [(d, " ".join([*base[: d % 199], f"c{d}", *base[d % 199 + 1 :]])) for d in range(240)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), simhash.SimHash.for_similarity())
    assert [r.doc_id for r in kept.collect()] == [0]
    assert sum(counts) < 12 * len(rows)


def test_similarity_mode_finds_near_copies(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(3000)]
    base = [list(rng.choice(words, 300)) for _ in range(20)]
    rows, d = [], 0
    for text in base:
        for edits in (0, 0, 2, 4):
            copy = list(text)
            for k in rng.integers(0, 300, edits):
                copy[k] = "changed"
            rows.append((d, " ".join(copy)))
            d += 1
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.keep_one(frame, simhash.SimHash.for_similarity())
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 80, 4))


def test_components_of_long_paths(spark):
    from thermalcube.llm.components import connected_components

    rows = [(i, i + 1) for i in range(0, 200)] + [(i, i - 1) for i in range(1000, 900, -1)] + [(5, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 900 for i in range(900, 1001)}}


def _brute_targets(sizes, cap=3.0):
    names = sorted((s for s in sizes if s is not None), key=str) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, free, rest = {}, set(names), float(sum(sizes.values()))
    while free:
        level = rest / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > cap * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in free}
        for s in full:
            target[s] = cap * sizes[s]
            rest -= target[s]
        free -= full
    return target


def test_mix_by_brute_force(spark, docs):
    got = QUERIES["op3_source_mix"](spark, SF).toPandas()
    sizes = {d: len(t.encode().split()) for d, t in zip(docs.doc_id, docs.text)}
    assert dict(zip(got.doc_id, got["size"])) == sizes
    by_source = collections.Counter()
    for d, s in zip(docs.doc_id, docs.source):
        by_source[s] += sizes[d]
    want = _brute_targets(by_source)
    for s, rows in got.groupby("source"):
        assert set(rows.source_size) == {by_source[s]}
        assert math.isclose(rows.target.iloc[0], want[s], rel_tol=1e-12)
        whole = int(want[s] // by_source[s])
        sums = {whole * by_source[s]}
        for n in rows["size"]:
            sums |= {x + n for x in sums}
        assert abs(rows.taken.sum() - want[s]) <= min(abs(x - want[s]) for x in sums) + 1
    assert (got.taken <= 3 * got["size"]).all()
    again = mixing.mix_sources(spark.read.parquet(f"{SF}/documents.parquet").repartition(5)).toPandas()
    assert dict(zip(again.doc_id, again.taken)) == dict(zip(got.doc_id, got.taken))


def test_targets_stop_at_the_cap(spark):
    sizes = {"a": 10, "b": 1000, "c": 1, None: 500, "d": 3}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(frame, [1, 2, 3], 3).collect()}
    want = _brute_targets(sizes)
    assert all(math.isclose(got[s], want[s], rel_tol=1e-12) for s in sizes)


@pytest.mark.parametrize("fit_words", [1, 50, 1 << 16])
def test_length_fit_reaches_the_nearest_sum(fit_words):
    rng = np.random.default_rng(4)
    for _ in range(30):
        counts = {int(n): int(c) for n, c in zip(rng.integers(0, 40, 8), rng.integers(1, 6, 8))}
        total = sum(n * c for n, c in counts.items())
        budget = int(rng.integers(0, total + 3))
        taken = mixing.fit_lengths(counts, budget, fit_words=fit_words)
        assert all(0 <= taken.get(n, 0) <= c for n, c in counts.items())
        reached = sum(n * k for n, k in taken.items())
        if fit_words == 1 << 16 or budget >= total:
            base = {n: c * budget // total for n, c in counts.items() if n} if budget < total else {}
            sums = {sum(n * c for n, c in base.items())}
            for n, c in base.items():
                sums = {s + n * k for s in sums for k in range(counts[n] - c + 1)}
            assert abs(reached - budget) == (budget - total if budget >= total else min(abs(s - budget) for s in sums))


def test_token_files_by_round_trip(spark, docs, tokenizer):
    got = QUERIES["op4_bit_plane_tokens"](spark, SF).toPandas().sort_values("doc_id")
    at = 0
    for (doc, text), r in zip(sorted(zip(docs.doc_id, docs.text)), got.itertuples()):
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [1], dtype="<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == len(docs)


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes_round_trip(kind):
    rng = np.random.default_rng(5)
    for n, top in ((1, 0), (1, 1), (7, 2), (1000, 49407), (65536, 2**32 - 1), (9, 2**17)):
        ids = rng.integers(0, top, n, dtype=np.uint32, endpoint=True)
        sizes, data = token_store.to_planes(ids, kind)
        assert (token_store.from_planes(sizes, data, n, kind) == ids).all()


def test_small_blocks_cut_documents_and_join_their_sums(spark, docs, tokenizer, tmp_path):
    frame = spark.createDataFrame(docs[["doc_id", "text"]].head(40))
    for kind in ("bit", "byte"):
        folder = str(tmp_path / kind)
        token_store.write_tokens(frame, folder, tokenizer_path(), 1, kind, block_ids=64)
        got = token_store.read_documents(spark, folder, kind).toPandas().set_index("doc_id")
        for doc, text in zip(docs.doc_id[:40], docs.text[:40]):
            ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [1], dtype="<u4")
            assert got.ids_crc32[doc] == zlib.crc32(ids.tobytes())


def test_joined_sums():
    for a, b in ((b"", b""), (b"x", b""), (b"", b"y"), (b"some", b"thing else" * 99)):
        assert token_store.joined_crc32(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_chunked_encoding_equals_whole_texts(tokenizer, docs):
    from thermalcube.llm.words import ChunkEncoder

    odd = "İstanbul I<|endoftext|>x a... b., don't ́a é ΣΑΣ ǅ ß ﬁ \x1c\x1cq 1234 x y 한국 한."
    letters = "ab.,'!_ \n\tÉé5²s’-<|İ\u0301"
    rng = np.random.default_rng(11)
    mixed = ["".join(rng.choice(list(letters), 60)) for _ in range(300)]
    texts = [*docs.text[:80], *mixed, odd, "µ. ÀÉ, ÿ. ß. İ. x", "<|ENDoftext|> <|endoftext|>.", "", " \n\t ", "a" * 500, "The, the. THE", "x.y.z,"]
    for kept in (50, 1_000_000):
        encoder = ChunkEncoder(tokenizer_path(), kept)
        for text in texts:
            want = tokenizer.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(encoder.ids(text), dtype="<u4").tolist() == want
            assert encoder.count(text) == len(want)
        found = list(ChunkEncoder(tokenizer_path(), kept).runs(pa.array(texts), 2000))
        ends = np.cumsum(np.concatenate([c for _, c in found]))[:-1]
        for text, ids in zip(texts, np.split(np.concatenate([i for i, _ in found]), ends)):
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("kept, run_bytes", [(1 << 20, 8 << 20), (1 << 20, 700), (5, 64), (1 << 20, 1)])
def test_runs_equal_whole_texts(tokenizer, docs, kept, run_bytes):
    from thermalcube.llm.words import ChunkEncoder

    odd = [
        None, "", " ", "\n \n", "a", "Don't stop'", "x" * 200, "ÀÉÎ, ñandú... İstanbul ǅ ß ŉ", "a\tb\rc\x0bd\x85e\u3000f",
        "e\u0301 cafe\u0301! \u0301x", "123 1,5 (a) [b] {c}; A.B. %%% 中文 字 🙂🙂 \x01 \x00", "No. no, NO! nO?" * 40, "word " * 500,
    ]
    texts = odd + docs.text.head(200).tolist() + odd
    found = list(ChunkEncoder(tokenizer_path(), kept).runs(pa.array(texts, pa.string()), run_bytes))
    counts = np.concatenate([c for _, c in found])
    ids = np.split(np.concatenate([i for i, _ in found]), np.cumsum(counts)[:-1])
    assert len(ids) == len(texts)
    for text, got in zip(texts, ids):
        assert got.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_top_k_of_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(-3, 3, 4).astype(float).tolist()) for i in range(300)]
    rows += [(300, None), (350, [1.0, None, 2.0, 3.0]), (400, [1.0, float("nan"), 0.0, 0.0]), (450, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(500, [1.0, 2.0]), (501, [2.0, 2.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(frame, F.col("vec_id") % 50 == 0).collect()
    clean = [r for r in rows if r[0] is not None and (r[0] < 300 or r[0] >= 500)]
    want = set()
    for q, x in clean:
        if q % 50 == 0:
            x = [math.floor(256 * v) for v in x]
            scores = [(-sum(a * math.floor(256 * b) for a, b in zip(x, y)), v) for v, y in clean if v != q and len(y) == len(x)]
            want |= {(q, i + 1, v, -s) for i, (s, v) in enumerate(sorted(scores)[:5])}
    assert {tuple(r) for r in got} == want


def test_early_stop_of_list_reading(monkeypatch):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(10, 32)) * 200
    vectors = np.rint(centres[rng.integers(0, 10, 1000)] + rng.normal(size=(1000, 32)) * 20)
    ids, queries = np.arange(1000), vectors[:20]
    depths = []
    read = topk.SortedLists.bounds
    monkeypatch.setattr(topk.SortedLists, "bounds", lambda self, u, d, depth: depths.append(depth) or read(self, u, d, depth))
    for q, found, scores in topk.top_scores(topk.SortedLists(vectors), ids, queries, np.arange(20), 5):
        all_scores = vectors @ queries[q]
        all_scores[q] = -np.inf
        best = np.lexsort((ids, -all_scores))[:5]
        assert found.tolist() == best.tolist() and scores.tolist() == all_scores[best].tolist()
    assert max(depths) < 1000


def test_entropy_classes_by_brute_force():
    rng = np.random.default_rng(8)
    for data in (rng.integers(97, 110, 300), np.full(200, 32), np.arange(256), rng.integers(0, 256, 64)):
        data = data.astype(np.uint8)
        got = digest.entropy_classes(data)
        for i in range(len(data) - 63):
            p = np.bincount(data[i : i + 64])
            p = p[p > 0] / 64
            assert abs(got[i] - -(p * np.log2(p)).sum() / 6 * 1000) <= 1.1


def test_edited_digests(spark, docs):
    got = QUERIES["op6_improbable_digests"](spark, SF).toPandas().set_index("doc_id")
    rows = sorted(zip(docs.doc_id, docs.text))
    assert len(got) == len(rows)
    for (doc, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got.n_chars[doc] == len(text)
        assert got.edited_sha256[doc] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got.near_next[doc] <= 1 and 0 <= got.near_edited[doc] <= 1
    by_text = collections.defaultdict(set)
    for doc, text in rows:
        by_text[text].add(got.fingerprint[doc])
    assert all(len(prints) == 1 for prints in by_text.values())
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    alone = digest.fingerprints(frame, digest.rarity_ranks(frame)).toPandas().set_index("doc_id")
    assert dict(alone.fingerprint) == dict(got.fingerprint)
    for (doc, text), (other, _) in zip(rows, rows[1:] + rows[:1]):
        a, b = (digest.decoded(got.fingerprint[d]) for d in (doc, other))
        assert math.isclose(got.near_next[doc], digest.likeness(a, b))
    assert got.near_edited.mean() > 0.3 > 0.15 > got.near_next.mean()


def test_digests_of_small_texts():
    ranks = np.arange(digest.CLASSES, dtype=np.uint32)
    texts = [b"", b"", b"a", b"a" * 63, b"a" * 64, b"a" * 5000, b"ab" * 40]
    prints = digest.digests(texts, ranks)
    assert all(p.shape == (1, 256) for p in prints)
    assert digest.likeness(prints[0], prints[1]) == 1 and digest.likeness(prints[0], prints[2]) == 0
    for text, found in zip(texts, prints):
        assert (digest.digests([text], ranks)[0] == found).all()
        assert digest.likeness(found, found) == 1


def test_packs_by_brute_force(spark, docs, tokenizer):
    got = QUERIES["op7_shortest_pack_first"](spark, SF).toPandas()
    ids = {d: np.array(tokenizer.encode(t, add_special_tokens=False).ids + [2], dtype="<u4") for d, t in zip(docs.doc_id, docs.text)}
    for doc, rows in got.groupby("doc_id"):
        at = 0
        for r in rows.sort_values("start").itertuples():
            assert (r.start, r.doc_tokens) == (at, len(ids[doc]))
            assert r.ids_crc32 == zlib.crc32(ids[doc][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[doc])
    assert set(got.doc_id) == set(ids)
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.offset.tolist() == (rows.length.cumsum() - rows.length).tolist() and rows.length.sum() <= 4096
    assert sorted(set(got.sequence_id)) == list(range(got.sequence_id.nunique()))
    assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / 4096) + 3


def test_pack_plan_keeps_counts_and_room():
    rng = np.random.default_rng(9)
    for top, size in ((10, 5), (64, 40), (4096, 3000)):
        histogram = {int(n): int(c) for n, c in zip(rng.integers(1, top + 1, size), rng.integers(1, 2000, size))}
        plan = packing.plan_packs(histogram, top)
        used = collections.Counter()
        for packs, pattern in plan:
            assert sum(n * each for n, each in pattern) <= top
            for n, each in pattern:
                used[n] += packs * each
        assert used == histogram
    assert packing.plan_packs({}, 16) == []


def test_edited_counts_by_full_encoding(spark, docs, tokenizer):
    got = QUERIES["op8_edit_aware_counts"](spark, SF).toPandas().set_index("doc_id")
    for doc, text in zip(docs.doc_id, docs.text):
        edited = text
        for at, removed, added in sample_edits(text):
            at = min(at, len(edited))
            edited = edited[:at] + added + edited[at + removed :]
        whole = [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in (text, edited)]
        assert [got.n_tokens[doc], got.edited_tokens[doc]] == whole
        assert got.edited_chars[doc] == len(edited)
    large = got[got.edited_chars > 8000]
    assert len(large) and (large.encoded_chars < 0.4 * large.edited_chars).all()


def test_count_tree_under_random_edits(tokenizer):
    def count(text):
        return len(tokenizer.encode(text, add_special_tokens=False).ids)

    rng = np.random.default_rng(10)
    letters = "abc é. \n\t'1"
    for leaf in (1, 4, 50):
        text = "".join(rng.choice(list(letters), 400))
        tree = edit_counts.CountTree(text, count, leaf)
        for _ in range(60):
            at, removed = int(rng.integers(0, len(text) + 2)), int(rng.integers(0, 30))
            added = "".join(rng.choice(list(letters), rng.integers(0, 12)))
            tree.edit(at, removed, added)
            at = min(at, len(text))
            text = text[:at] + added + text[at + removed :]
            assert tree.text == text and tree.total == count(text)
        tree.edit(0, len(text), "")
        assert tree.total == 0 and tree.text == ""
        tree.edit(0, 5, "new text")
        assert tree.total == count("new text")


def _byte_hash(byte):
    return int(mixed(np.array([(byte + 1) * 0x9E3779B97F4A7C15 % 2**64], dtype=np.uint64))[0])


BYTE_HASHES = [_byte_hash(b) for b in range(256)]


def _plain_units(raw):
    """[(start, end, words, line)] of a text in lower case: lines, cut after a word whose pair hash is the least of seven."""
    words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    own = [sum(BYTE_HASHES[b] for b in raw[a:z]) % 2**64 for a, z in words]
    pairs = [int(mixed(np.array([(x + 3 * y) % 2**64], dtype=np.uint64))[0]) >> 1 for x, y in zip(own, own[1:])]
    out, unit, line = [], [], 0
    for i, (start, end) in enumerate(words):
        unit.append((start, end))
        last = i == len(words) - 1
        newline = not last and b"\n" in raw[end : words[i + 1][0]]
        least = not last and all(pairs[i] < p for p in pairs[max(0, i - 3) : i]) and all(pairs[i] <= p for p in pairs[i + 1 : i + 4])
        if last or newline or least:
            for k in range(0, len(unit), unit_dedup.LONGEST_UNIT):
                part = unit[k : k + unit_dedup.LONGEST_UNIT]
                out.append((part[0][0], part[-1][1], len(part), line))
            unit = []
        line += newline
    return out


def _brute_repeats(rows, run_words=unit_dedup.RUN_WORDS):
    """Later whole lines go, and runs of later units that hold ``run_words`` words."""
    parts, lines, out = set(), set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        raw = text.encode()
        found = _plain_units(raw.lower())
        again, gone = [], [False] * len(found)
        for a, b, _, _ in found:
            key = b" ".join(raw[a:b].lower().split())
            again.append(key in parts)
            parts.add(key)
        for _, group in itertools.groupby(range(len(found)), key=lambda i: found[i][3]):
            at = list(group)
            key = b" ".join(raw[found[at[0]][0] : found[at[-1]][1]].lower().split())
            if key in lines:
                for i in at:
                    gone[i] = True
            lines.add(key)
        for marked, group in itertools.groupby(range(len(found)), key=lambda i: again[i] or gone[i]):
            at = list(group)
            if marked and sum(found[i][2] for i in at) >= run_words:
                for i in at:
                    gone[i] = True
        spans = []
        for going, group in itertools.groupby(range(len(found)), key=lambda i: gone[i]):
            at = list(group)
            if going:
                spans.append((len(raw[: found[at[0]][0]].decode()), len(raw[: found[at[-1]][1]].decode())))
        left, at = "", 0
        for a, b in spans:
            left, at = left + text[at:a], b
        out[doc] = (left + text[at:], spans)
    return out


def test_repeated_units_by_brute_force(spark, docs):
    got = QUERIES["op9_repeated_units"](spark, SF).collect()
    want = _brute_repeats(list(zip(docs.doc_id, docs.text)))
    assert {r.doc_id: (r.text, [(s.start, s.end) for s in r.removed]) for r in got} == want
    assert any(spans for _, spans in want.values())


def test_passages_within_lines_are_found(spark, docs):
    texts = [t for t in docs.text if 200 < len(t.split()) < 600][:60]
    passage = " ".join(texts[50].split()[:60])
    rows = []
    for i in range(40):
        words = " ".join(texts[i].split())
        cut = words.index(" ", len(words) // 2)
        rows.append((i, words[:cut] + " " + passage + words[cut:] if i % 2 else words))
    got = unit_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    clean = unit_dedup.remove_repeats(spark.createDataFrame([(i, t.replace(passage, "")) for i, t in rows], "doc_id long, text string"))
    before = {r.doc_id: sum(s.end - s.start for s in r.removed) for r in clean.collect()}
    for r in got:
        gone = sum(s.end - s.start for s in r.removed) - before[r.doc_id]
        if r.doc_id % 2 and r.doc_id > 1 and not before[r.doc_id]:
            assert gone > 0.6 * len(passage)
        elif not before[r.doc_id]:
            assert gone == 0


def test_units_cover_all_words():
    for text in ("", " \n ", "one", "a b\nc  d\t\te " * 50, "to " * 500, "é" * 10 + "\r\n" + "x y z. " * 40):
        raw = text.encode()
        starts, ends, counts = unit_dedup.units(raw)
        assert b" ".join(b" ".join(raw[a:b].split()) for a, b in zip(starts, ends)) == b" ".join(raw.split())
        assert sum(counts) == len(raw.split()) and all(counts > 0)


def test_kernel_of_words_by_brute_force():
    """Every pair of three letters in order within seven, weighted by decay, against the landmarks' tables."""
    landmarks, words = ["idiot", "trottel", "gardens"], ["idiot", "idi0tic", "trotteln", "gxarden", "abcabc", "ab", "x" * 30, "anidiotisch"]
    table = toxicity.Landmarks(landmarks)

    def features(word):
        out = collections.Counter()
        for places in itertools.combinations(range(len(word)), 3):
            if places[-1] - places[0] < 7:
                out["".join(word[i] for i in places)] += 0.6 ** (places[-1] - places[0] + 1)
        return out

    def product(a, b):
        return sum(w * b[k] for k, w in a.items())

    for word, got in zip(words, table.kernel([toxicity.normalised(w) for w in words])):
        parts = toxicity.pieces(toxicity.normalised(word))
        assert parts[0][:1] == toxicity.normalised(word)[:1] and "".join(parts).endswith(toxicity.normalised(word)[-1:])
        for landmark, value in zip(landmarks, got):
            mine, best = features(landmark), 0.0
            for part in map(features, parts):
                if part:
                    best = max(best, min(1.0, product(part, mine) / math.sqrt(product(part, part) * product(mine, mine))))
            assert abs(value - best**2) < 1e-5, (word, landmark)


def test_scores_don_t_depend_on_what_a_worker_remembers(docs, monkeypatch):
    texts = docs.text.tolist()
    bad = [f"{t[:200]} you are such an idiot. {t[200:400]}" for t in texts[80:100]]
    model = toxicity.fit(bad + texts[:80], [1] * len(bad) + [0] * 80)
    texts += bad
    want = model.scores(texts)
    assert "idiot" in model.landmarks and (want[-len(bad) :] > 0.5).all()
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 500)
    fresh = toxicity.ToxicityModel.from_json(model.to_json())
    monkeypatch.setattr(toxicity, "TEXTS_AT_ONCE", 5000)
    monkeypatch.setattr(toxicity, "SENTENCES_AT_ONCE", 2)
    assert np.allclose(fresh.scores(texts), want, atol=1e-6)
    assert toxicity.ToxicityModel.from_json(model.to_json()) is fresh
    assert toxicity.ToxicityModel.from_json(toxicity.fit([], []).to_json()).landmarks != model.landmarks
    # Another model has taken its place.
    assert toxicity.ToxicityModel.from_json(model.to_json()) is not fresh


def test_a_worker_remembers_few_words_and_scores_the_same(monkeypatch):
    """Words and parts have bounds of their own: words hold most of the memory, parts most of the work."""
    from thermalcube.llm import toxicity

    landmarks = ["stupid", "garbage"]
    texts = [" ".join(f"w{i * 50 + k:05d}stupid" for k in range(50)) + ". plain words here" for i in range(40)]
    model = toxicity.ToxicityModel(landmarks, [1.0, 1.0], 0.0, 1.0, 0.0)
    whole = model.scores(texts).tolist()
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 300)
    monkeypatch.setattr(toxicity, "KEPT_PARTS", 900)
    monkeypatch.setattr(toxicity, "TEXTS_AT_ONCE", 500)
    small = toxicity.ToxicityModel(landmarks, [1.0, 1.0], 0.0, 1.0, 0.0)
    assert small.scores(texts).tolist() == whole
    assert len(small.known) <= 300 and len(small.parts) < len(model.parts)


def test_a_worker_hands_back_what_toxicity_keeps(spark):
    """Workers go on to later stages: a task there finds none of the words that scoring has kept."""
    import pyarrow as pa

    from thermalcube.llm import simhash, toxicity, unit_dedup
    from thermalcube.llm.common import ready

    model = toxicity.ToxicityModel(["idiot", "stupid"], [1.0, 1.0], 0.0, 1.0, 0.0)
    docs = ready(spark).range(40).selectExpr("id AS doc_id", "concat('you stupid word', id) AS text").repartition(8)
    kept = lambda: toxicity.ToxicityModel.from_json.cache_info().currsize

    def tasks(batches):
        scorer = toxicity.ToxicityModel.from_json(model.to_json())
        scorer.scores(["you stupid word"])
        del scorer
        before = kept()
        rows = pa.record_batch([pa.array([1]), pa.array([2]), pa.array(["some words"])], names=["doc_id", "mark", "text"])
        list(unit_dedup._unit_rows(iter([rows])))
        units = kept()
        toxicity.ToxicityModel.from_json(model.to_json())
        list(simhash._fingerprints(simhash.SimHash(), 2)(iter([rows])))
        for batch in batches:
            yield pa.record_batch([pa.array([before]), pa.array([units]), pa.array([kept()])], names=["before", "units", "prints"])

    assert {tuple(r) for r in docs.mapInArrow(tasks, "before long, units long, prints long").collect()} == {(1, 0, 0)}


def test_a_scored_model_is_dropped_by_the_next_stage(spark):
    """The store is registered where the worker's own tasks look for it, not in a copy sent with a function."""
    import pandas as pd
    import pyarrow as pa

    from thermalcube.llm import toxicity, unit_dedup
    from thermalcube.llm.common import ready

    model = toxicity.ToxicityModel(["idiot", "stupid"], [1.0, 1.0], 0.0, 1.0, 0.0)
    docs = ready(spark).range(40).selectExpr("id AS doc_id", "concat('you stupid word', id) AS text").repartition(8)
    assert toxicity.score_documents(docs, model).count() == 40
    toxicity.score_documents(docs, model).write.format("noop").mode("overwrite").save()

    def tasks(batches):
        rows = pa.record_batch([pa.array([1]), pa.array([2]), pa.array(["some words"])], names=["doc_id", "mark", "text"])
        list(unit_dedup._unit_rows(iter([rows])))
        for batch in batches:
            yield pd.DataFrame({"kept": [toxicity.ToxicityModel.from_json.cache_info().currsize]})

    assert {r.kept for r in docs.mapInPandas(tasks, "kept long").collect()} == {0}


def test_texts_come_in_runs_of_bounded_bytes():
    import pyarrow as pa

    from thermalcube.llm import unit_dedup
    from thermalcube.llm.common import text_runs

    texts = ["a" * n for n in (10, 20, 400, 5, 5)] + [None, "", "b" * 90, "c" * 30]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    runs = list(text_runs(iter([batch, batch.slice(0, 0)]), 1, 100))
    assert len(runs) > 3 and [t for r in runs for t in r.column(1).to_pylist()] == texts
    assert all(sum(map(len, filter(None, r.column(1).to_pylist()[1:]))) <= 100 for r in runs)
    # A passage removed in a text far into a batch: places hang on the text alone, not on the run.
    long = ["one two three four\n" + "x" * 1_500_000, "y" * 1_500_000, "one two three four\nz"]
    rows = [pa.array([0, 1, 2]), pa.array(long), pa.array([None, None, [0]], pa.list_(pa.int32())), pa.array([None, None, [0]], pa.list_(pa.int32()))]
    parts = list(unit_dedup._cut(20, 1)(iter([pa.record_batch(rows, names=["doc_id", "text", "again", "lines"])])))
    assert len(parts) > 1
    assert [t for p in parts for t in p.column("text").to_pylist()] == [*long[:2], "\nz"]
