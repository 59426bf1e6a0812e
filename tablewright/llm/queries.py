"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm import (
    bpe,
    exact_dedup,
    lexical,
    merkle,
    near_dedup,
    neighbours,
    packing,
    pii,
    quality,
    secret_scan,
    substring_dedup,
    toxicity,
    url_filter,
)
from tablewright.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add


@query(
    "op1_exact_dedup",
    r"""
    WITH d AS (
        SELECT doc_id, length(coalesce(text, '')) AS size,
            sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
        FROM documents
    ), g AS (
        SELECT doc_id, text_sha256,
            first_value(doc_id) OVER (
                PARTITION BY text_sha256 ORDER BY size DESC, doc_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
            count(*) OVER (PARTITION BY text_sha256) AS group_size
        FROM d
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
    """,
)
def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents"))


@query("op4_bpe")
def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = bpe.vocabulary_path()
    encoded = bpe.encode_texts(table(spark, folder, "documents"), path)
    return bpe.digests(bpe.decode_ids(encoded, path))


@query("op6_packing")
def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), bpe.vocabulary_path())


@query("op2_substring_dedup")
def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.digests(substring_dedup.remove_repeats(table(spark, folder, "documents")))


@query("op7_near_dedup")
def op7_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, folder, "documents"))


@query("op3_quality")
def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op5_url_filter")
def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages"))


@query("op9_neighbours")
def op9_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"))


@query("op10_secret_scan")
def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.digests(secret_scan.find_secrets(table(spark, folder, "documents")))


@query(
    "op11_merkle",
    r"""
    WITH RECURSIVE d AS (
        SELECT doc_id, coalesce('=' || lang, '') AS g,
            list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR],
                lambda v: coalesce(strlen(v) || ':' || v, '-')) AS parts,
            text,
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
            xor(4294967295, list_reduce(
                list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                lambda crc, byte: list_reduce(
                    list_prepend(xor(crc, byte), range(8)),
                    lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))) % 3 = 0 AS tampered
        FROM documents
    ), leaves AS (
        SELECT doc_id, g, tampered,
            sha256(array_to_string(parts, '') || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
            sha256(array_to_string(parts, '') || coalesce(strlen(lowered) || ':' || lowered, '-')) AS changed
        FROM d
    ), base AS (
        SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY g) AS n
        FROM leaves
    ), low AS (
        SELECT g, 0 AS level, i, n, leaf AS digest FROM base
        UNION ALL
        SELECT g, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY i))
        FROM low WHERE n > 1 GROUP BY g, level, i // 8, n
    ), subroots AS (
        SELECT g, digest, level, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n
        FROM low WHERE n = 1
    ), high AS (
        SELECT 0 AS level, i, n, digest FROM subroots
        UNION ALL
        SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY i))
        FROM high WHERE n > 1 GROUP BY level, i // 8, n
    ), runs AS (
        SELECT g, level, i // 8 AS run, list(digest ORDER BY i) AS slots FROM low WHERE n > 1 GROUP BY ALL
        UNION ALL
        SELECT s.g, s.level + h.level, h.i // 8, list(h.digest ORDER BY h.i)
        FROM high h, subroots s WHERE h.n > 1 GROUP BY ALL
    ), way AS (
        SELECT b.doc_id, b.g, 0 AS level, b.i AS place, CASE WHEN tampered THEN changed ELSE leaf END AS node, '' AS proof
        FROM base b
        UNION ALL
        SELECT w.doc_id, w.g, w.level + 1,
            CASE WHEN w.level + 1 = s.level THEN s.i ELSE w.place // 8 END,
            sha256(array_to_string(r.slots[:w.place % 8], '') || w.node || array_to_string(r.slots[w.place % 8 + 2:], '')),
            w.proof || array_to_string(r.slots[:w.place % 8], '') || array_to_string(r.slots[w.place % 8 + 2:], '')
        FROM way w JOIN subroots s USING (g) JOIN runs r ON r.g = w.g AND r.level = w.level AND r.run = w.place // 8
    ), root AS (
        SELECT digest AS root FROM high WHERE n = 1
    )
    SELECT b.doc_id, b.leaf, s.digest AS subroot, root.root, sha256(w.proof) AS proof_sha256,
        w.node AS folded_root, w.node = root.root AS verified
    FROM base b JOIN subroots s USING (g) CROSS JOIN root
    JOIN (SELECT doc_id, max_by(node, level) AS node, max_by(proof, level) AS proof FROM way GROUP BY doc_id) w USING (doc_id)
    """,
)
def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(table(spark, folder, "documents"))


@query(
    "op12_lexical_search",
    r"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
        FROM documents
    ), i AS (
        SELECT item_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark
    ), wanted AS (
        SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL
    ), totals AS (
        SELECT count(*)::BIGINT AS documents, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0
    ), tf AS (
        SELECT doc_id, n, term, count(*) AS tf
        FROM (SELECT doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d) GROUP BY ALL
    ), w AS (
        SELECT term, floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight
        FROM tf, totals GROUP BY term, documents
    ), scored AS (
        SELECT item_id, doc_id,
            sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * documents) // total))))::BIGINT AS score
        FROM wanted JOIN tf USING (term) JOIN w USING (term), totals
        GROUP BY item_id, doc_id
    ), placed AS (
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
        FROM scored WHERE score > 0
    )
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM placed WHERE rank <= 20
    """,
)
def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op13_pii")
def op13_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digests(pii.find_personal_data(table(spark, folder, "documents")))
