"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from thermalcube.llm import digest, edit_counts, mixing, packing, sharding, simhash, token_store, topk, toxicity, unit_dedup
from thermalcube.llm.common import rank_in_group
from thermalcube.llm.queries import sample_edits
from thermalcube.llm.words import tokenizer_path

LONG = "One more line of words that goes on and on. " * 30_000
ROWS = [
    (1, "a plain text of words", "en", "s1", 21),
    (1, "a plain text of words", "en", "s1", 21),
    (1, "another text, same id", None, None, None),
    (2, None, "en", "s1", None),
    (3, "", "en", None, 0),
    (4, "", None, "s2", 0),
    (5, LONG, "en", "s2", len(LONG)),
    (6, " \n\t\r\n ", "en", "s2", 6),
    (None, "no id here é İ 한국", "en", "s3", 5),
    (None, None, None, None, None),
    (7, "word " * 3, "en", "s1", 15),
    (8, "word " * 3, "en", "s1", 15),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as further columns of the input.
CLASH = ["shard", "rank", "size", "mark", "digest", "print", "keys", "unit", "length", "score", "key", "n", "low", "tail", "part", "_hash", "_id", "_mark", "_score", "_row", "_copies", "_copy", "row", "print_", "root"]


@pytest.fixture(params=["rows", "empty", "clashing"])
def docs(spark, request):
    frame = spark.createDataFrame(ROWS if request.param != "empty" else [], SCHEMA)
    if request.param == "clashing":
        frame = frame.withColumns({c: F.lit("x") for c in CLASH})
    return frame


def _ids(rows, name="doc_id"):
    return sorted((r[name] for r in rows), key=str)


def _want(docs):
    return _ids(docs.select("doc_id").collect())


def test_shards(docs):
    got = sharding.shard_documents(docs, [1.0] * 3).collect()
    assert _ids(got) == _want(docs)
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in got if r.doc_id == 1}) <= 1
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("doc_id"), [])


def test_simhash(docs):
    got = simhash.near_duplicates(docs).collect()
    assert _ids(got) == _want(docs)
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert not got or (_ids(zero) == _ids([r for r in ROWS if not (r[1] or "").split()], 0) and {r.component_id for r in zero} == {2})
    assert all(r.component_id is None or r.doc_id is None or r.component_id <= r.doc_id for r in got)


def test_simhash_keeps_one(docs):
    got = simhash.keep_one(docs, simhash.SimHash.for_similarity()).collect()
    assert got == [] or collections.Counter(r.text for r in got)["a plain text of words"] == 1
    assert all(r.doc_id != 8 for r in got) and (not got or {1, 5, 7} <= {r.doc_id for r in got})


def test_mix(docs):
    got = mixing.mix_sources(docs).collect()
    assert _ids(got) == _want(docs)
    assert all(0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in got)
    empty = docs.withColumn("text", F.lit(None).cast("string"))
    assert {(r.taken, r.target) for r in mixing.mix_sources(empty).collect()} <= {(0, 0.0)}


def test_tokens(docs, spark, tmp_path):
    token_store.write_tokens(docs, str(tmp_path / "t"), tokenizer_path(), 1)
    got = token_store.read_documents(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert _ids(got) == _want(docs)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    for r in got:
        if r.doc_id in (2, 3, 4, 6):
            assert (r.n_tokens, r.ids_crc32) == (1, zlib.crc32(np.array([1], dtype="<u4").tobytes()))


def test_packs(docs):
    got = packing.pack_documents(docs, tokenizer_path(), 2, length=64).collect()
    assert set(_ids(got)) == set(_want(docs))
    used = collections.defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64


def test_digests(docs):
    got = digest.compare_with_edited(docs, digest.rarity_ranks(docs)).collect()
    assert _ids(got) == _want(docs)
    assert all(r.n_chars == len(dict((d, t) for d, t, *_ in ROWS if d != 1)[r.doc_id] or "") for r in got if r.doc_id not in (1, None))


def test_one_document_is_its_own_next(spark):
    docs = spark.createDataFrame([(9, "abcdef" * 40)], "doc_id long, text string")
    row = digest.compare_with_edited(docs, digest.rarity_ranks(docs)).collect()
    assert len(row) == 1 and row[0].near_next == 1.0


def test_edit_counts(docs):
    got = edit_counts.count_edited(docs, sample_edits, tokenizer_path()).collect()
    assert _ids(got) == _want(docs)
    assert all(r.n_tokens == 0 for r in got if r.doc_id in (2, 3, 4, 6))


def test_repeats(docs):
    rows = unit_dedup.remove_repeats(docs, carry=("lang", "source", "n_chars")).collect()
    assert _ids(rows) == _want(docs)
    by_id = {r.doc_id: r for r in rows}
    if rows:
        assert by_id[2].text is None and by_id[3].text == "" and by_id[6].text == " \n\t\r\n "
        # A later whole line goes at any length, with the words of it but not the white space behind.
        assert len(by_id[5].text) < 0.05 * len(LONG) and by_id[7].text == "word " * 3 and by_id[8].text == " "
        assert [r.text for r in rows].count("a plain text of words") == 2


def test_scores(docs):
    texts = ["what an idiot you are"] * 3 + ["the weather is fine", "nothing to see", "all is well here"]
    model = toxicity.fit([t + str(i) for i, t in enumerate(texts)], [1, 1, 1, 0, 0, 0])
    got = toxicity.score_documents(docs, model).collect()
    assert _ids(got) == _want(docs)
    assert all(0 <= r.score <= 1 for r in got)
    nothing = toxicity.fit([], [])
    assert nothing.score("anything") < 0.5 and toxicity.fit(["one label"], [1]).score("x") < 0.5


def test_top_k_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, score int, rank int")
    assert topk.top_k(empty, F.col("vec_id") % 50 == 0).collect() == []
    few = spark.createDataFrame([(0, [1.0], 1, 1), (1, [1.0], 1, 1), (1, [1.0], 1, 1)], "vec_id long, embedding array<float>, score int, rank int")
    got = [tuple(r) for r in topk.top_k(few, F.col("vec_id") % 50 == 0).collect()]
    assert got == [(0, 1, 1, 65536), (0, 2, 1, 65536)]


@pytest.mark.parametrize("size", [2.0**23, 1e8, 1e30])
def test_top_k_of_large_components(spark, size):
    """Sums beyond what doubles hold are exact; those beyond a long are given as the nearest one."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(size * rng.choice([-1, 1, 0.5]))), float(i % 7), 0.25]) for i in range(120)]
    rows += [(200, [1.0, -1.0, 0.0]), (250, [0.0, 2.0, 0.0])]
    got = collections.defaultdict(list)
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for r in topk.top_k(vectors, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    parts = {i: [min(max(math.floor(256 * float(np.float32(c))), -(2**63)), 2**63 - 1) for c in v] for i, v in rows}
    for query in (0, 50, 100, 200, 250):
        scores = [(min(max(sum(a * b for a, b in zip(parts[query], p)), -(2**63)), 2**63 - 1), i) for i, p in parts.items() if i != query]
        best = sorted(scores, key=lambda x: (-x[0], x[1]))[:5]
        assert [s for _, s in got[query]] == [s for s, _ in best]
        if best[0][0] < 2**63 - 1:
            assert [i for i, _ in got[query]] == [i for _, i in best]


def test_ranks_of_a_hot_group(spark):
    frame = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "hot").alias("g"))
    got = rank_in_group(frame, ["g"], ["id"], "r").collect()
    for g in ("hot", None):
        ranks = sorted(x.r for x in got if x.g == g)
        assert ranks == list(range(len(ranks)))


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, stage, tmp_path):
    labels = [(1, 0, 0), (5, 0, 1), (None, None, None), (99, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = stage(spark, docs, str(tmp_path))
    rows = got.collect()
    if stage is not corpus_pipeline.pack:
        assert got.columns == docs.columns and got.dtypes == docs.dtypes
        assert all(r[c] == "x" for r in rows for c in CLASH if c in got.columns)
    assert docs.isEmpty() == (len(rows) == 0)
