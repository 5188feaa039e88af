"""The operators applied to whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermalcube.llm import (
    digest, edit_counts, lexical_search, mixing, packing, private_data, sharding, simhash, token_store, topk, toxicity,
    unit_dedup, whitening,
)
from thermalcube.llm.common import ready, table
from thermalcube.llm.words import tokenizer_path
from thermalcube.session import scratch_path

SHARDS = [1.0] * 40


def op1_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), simhash.SimHash())


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op4_bit_plane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    token_store.write_tokens(table(spark, sf_dir, "documents"), folder, tokenizer_path(), end_id=1)
    return token_store.read_documents(spark, folder)


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_improbable_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digest.compare_with_edited(docs, digest.rarity_ranks(docs))


def op7_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def sample_edits(text: str) -> list[edit_counts.Edit]:
    """Three edits of a text: 32 characters give way to its first 32, 16 go, its last 16 are put in."""
    n = len(text)
    return [(n // 3, 32, text[:32]), (2 * n // 3, 16, ""), (n // 2, 0, text[-16:])]


def op8_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_counts.count_edited(table(spark, sf_dir, "documents"), sample_edits, tokenizer_path())


def op9_repeated_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op10_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.held_out(F.col("doc_id")).alias("held_out")
    model = toxicity.fit_on(docs, table(spark, sf_dir, "labels").filter(~toxicity.held_out(F.col("doc_id"))))
    scored = toxicity.score_documents(docs, model).select("doc_id", out, "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op11_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_disguised_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and base_sha256 are of the plain spans; spans lists the disguised ones as well."""
    return private_data.find_private(table(spark, sf_dir, "documents"))


def op13_limited_accumulators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


FUNCTIONS = (
    op1_rendezvous_shards, op2_simhash_near_dedup, op3_source_mix, op4_bit_plane_tokens, op5_exact_top_k,
    op6_improbable_digests, op7_shortest_pack_first, op8_edit_aware_counts, op9_repeated_units,
    op10_string_kernel_toxicity, op11_feast_whitening, op12_disguised_private_data, op13_limited_accumulators,
)


def _with_session(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(ready(spark), sf_dir)

    run.__name__, run.__doc__ = function.__name__, function.__doc__
    return run


QUERIES = {f.__name__: _with_session(f) for f in FUNCTIONS}

#: The primes of XXH64.
P1, P2, P3, P4, P5 = (
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261,
)


def _wide(sql: str) -> str:
    """A sum or product of unsigned 64-bit integers, modulo 2**64."""
    return f"CAST(({sql}) % 18446744073709551616::UHUGEINT AS UBIGINT)"


def _times(sql: str, factor: int) -> str:
    return _wide(f"CAST({sql} AS UHUGEINT) * {factor}::UHUGEINT")


def _rotated(sql: str, bits: int) -> str:
    return f"({_times(sql, 1 << bits)} | ({sql} >> {64 - bits}))"


def _xxh64(name: str, source: str, value: str, seed: str, out: str) -> str:
    """Views that add ``out``, the XXH64 of a 64-bit integer with a seed, to the rows of ``source``."""
    steps = [
        f"SELECT *, {_times(f'CAST(CAST({value} AS HUGEINT) & 18446744073709551615::HUGEINT AS UBIGINT)', P2)} AS a FROM {source}",
        f"SELECT * EXCLUDE (a), xor({_wide(f'CAST({seed} AS UHUGEINT) + {P5 + 8}')}, {_times(_rotated('a', 31), P1)}) AS b FROM {name}_0",
        f"SELECT * EXCLUDE (b), {_wide(f'CAST({_times(_rotated("b", 27), P1)} AS UHUGEINT) + {P4}::UHUGEINT')} AS c FROM {name}_1",
        f"SELECT * EXCLUDE (c), {_times('xor(c, c >> 33)', P2)} AS d FROM {name}_2",
        f"SELECT * EXCLUDE (d), {_times('xor(d, d >> 29)', P3)} AS e FROM {name}_3",
    ]
    views = [f"{name}_{i} AS ({sql})" for i, sql in enumerate(steps)]
    return ",\n".join([*views, f"{name} AS (SELECT * EXCLUDE (e), xor(e, e >> 32) AS {out} FROM {name}_4)"])


OP1_SQL = f"""
WITH table_of AS (
    SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]),
            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i))
), bytes AS (
    SELECT doc_id, coalesce(strlen(text), 0) + 16 AS size,
      list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::UBIGINT) AS parts FROM documents
), docs AS (
    SELECT doc_id, size, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, parts),
        lambda acc, b: xor(acc >> 8, t[CAST(xor(acc, b) & 255 AS BIGINT) + 1])), 4294967295::UBIGINT) AS BIGINT) AS text_crc32
    FROM bytes, table_of
), {_xxh64("keyed", "docs", "doc_id", "42", "h")},
{_xxh64("summed", "keyed", "text_crc32", "h", "h2")},
{_xxh64("sized", "summed", "size", "h2", "h3")},
pairs AS (SELECT sized.*, s FROM sized, range(41) r(s)),
{_xxh64("scored", "pairs", "s", "h", "score")},
best AS (
    SELECT doc_id, size, text_crc32, h3 >> 12 AS place,
      arg_max(s, (score >> 11) * 64 + 63 - s) FILTER (WHERE s < 40) AS shard, arg_max(s, (score >> 11) * 64 + 63 - s) AS grown
    FROM scored GROUP BY ALL
)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY place, doc_id, text_crc32, size) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM best
"""

OP5_SQL = """
WITH usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS parts
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.parts, c.parts) AS BIGINT) AS score
    FROM usable q JOIN usable c ON c.vec_id <> q.vec_id AND len(c.parts) = len(q.parts)
    WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""

TERMS_SQL = r"""regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

OP13_SQL = f"""
WITH docs AS (
    SELECT row_number() OVER () AS row, doc_id, {TERMS_SQL.format(text="text")} AS terms FROM documents WHERE text IS NOT NULL
), kept AS (
    SELECT row, doc_id, terms, len(terms) AS n FROM docs WHERE len(terms) > 0
), corpus AS (
    SELECT count(*) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM kept
), asked AS (
    SELECT DISTINCT item_id, unnest({TERMS_SQL.format(text="text")}) AS term FROM benchmark
), postings AS (
    SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM kept)
    WHERE term IN (SELECT term FROM asked) GROUP BY row, term
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * all_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), corpus
), lengths AS (
    SELECT row, doc_id, 100 - 50 + ((50 * n * all_docs) // all_terms) AS m FROM kept, corpus
), scored AS (
    SELECT item_id, doc_id, row, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS score
    FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (row)
    GROUP BY item_id, doc_id, row
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 50
"""

ORACLES = {"op13_limited_accumulators": OP13_SQL, "op1_rendezvous_shards": OP1_SQL, "op5_exact_top_k": OP5_SQL}
