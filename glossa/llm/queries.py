"""The registered queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gam
from .common import table
from .divergence import divergence
from .exact_dedup import exact_dedup
from .hard_negatives import hard_negatives
from .licenses import license_scan
from .line_dedup import line_dedup
from .minhash import near_duplicates
from .mixing import mix
from .packing import pack
from .pii import find_personal_data
from .quality_rules import judged
from .sharding import numbered, placed
from .warc import warc_round_trip

Query = Callable[[SparkSession, str], DataFrame]

#: The mixture: domains by source, and the weights in the tree.
WEB = [f"src{i}" for i in range(10)]
BOOKS = [f"src{i}" for i in range(10, 15)]
DOMAIN_WEIGHTS = {"web": 5, "books": 3, "forums": 2}
LANGUAGE_WEIGHTS = {"en": 6, "fr": 2}


def domain_of(source: Column) -> Column:
    return F.when(source.isin(WEB), "web").when(source.isin(BOOKS), "books").otherwise("forums")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def pieces_by_domain(docs: DataFrame) -> DataFrame:
    """Pieces of all documents; the domains' target proportions hold in every window while they have documents."""
    import public_tokenizers

    queued = docs.select("doc_id", "text", domain_of(F.col("source")).alias("source"))
    vocabulary, ranks = map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
    pieces = pack(queued, vocabulary, ranks, weights=DOMAIN_WEIGHTS)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_by_domain(table(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))


def op6_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a host with the same text are one page."""
    return line_dedup(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return gam.score(docs, gam.train(docs, table(spark, sf_dir, "labels")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), domain_of(F.col("source")), DOMAIN_WEIGHTS, LANGUAGE_WEIGHTS)


#: Shards of equal weight, and the same with one more.
SHARDS = dict.fromkeys(range(16), 1)
GROWN = dict.fromkeys(range(17), 1)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each text its size and CRC alone are shuffled."""
    at = placed(table(spark, sf_dir, "documents"), SHARDS, GROWN)
    rows = at.select("doc_id", "size", "text_crc32", "law", "shard", "grown_shard")
    return numbered(rows, "shard", ["doc_id", "size", "text_crc32"], "slot")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_exact_dedup,
        op3_packing,
        op4_minhash,
        op5_quality_rules,
        op6_warc_revisit,
        op7_personal_data,
        op8_line_dedup,
        op9_quality_classifier,
        op10_mixing,
        op11_sharding,
        op12_hard_negatives,
        op13_source_divergence,
    )
}


def _fill(name: str, parent: str, nodes: str) -> str:
    """One level of the budget tree: capped shares by weight, in whole tokens."""
    by = f"PARTITION BY {parent}" if parent else ""
    return f"""
        {name}1 AS (
            SELECT *, cap * sum(weight) OVER ({by} ORDER BY cap / greatest(weight, 1), {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
                   <= weight * (budget - coalesce(sum(cap) OVER ({by} ORDER BY cap / greatest(weight, 1), {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS is_full
            FROM ({nodes})
        ), {name}2 AS (
            SELECT *, CASE WHEN is_full THEN 0 ELSE weight END AS open,
                   budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({by}) AS rest FROM {name}1
        ), {name}3 AS (
            SELECT *, greatest(sum(open) OVER ({by}), 1) AS all_open, sum(open) OVER ({by} ORDER BY {name}) AS upto FROM {name}2
        ), {name}_alloc AS (
            SELECT *, CASE WHEN is_full THEN cap ELSE (rest * upto) // all_open - (rest * (upto - open)) // all_open END AS alloc FROM {name}3
        )"""


def _case(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


MIX_SQL = rf"""
        WITH d AS (
            SELECT *, CASE WHEN source IN ({", ".join(f"'{x}'" for x in WEB)}) THEN 'web' WHEN source IN ({", ".join(f"'{x}'" for x in BOOKS)}) THEN 'books' ELSE 'forums' END AS domain,
                   coalesce(lang, '') AS language, coalesce(source, '') AS leaf,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens
            FROM documents
        ), l AS (
            SELECT domain, language, leaf, sum(n_tokens) AS tokens, 2 * sum(n_tokens) AS cap FROM d GROUP BY ALL
        ), {_fill("domain", "", f"SELECT domain, sum(cap) AS cap, {_case('domain', DOMAIN_WEIGHTS)} AS weight, least((SELECT sum(tokens) FROM l) // 2, sum(sum(cap)) OVER ()) AS budget FROM l GROUP BY domain")},
        {_fill("language", "domain", f"SELECT l.domain, language, sum(l.cap) AS cap, {_case('language', LANGUAGE_WEIGHTS)} AS weight, any_value(alloc) AS budget FROM l JOIN domain_alloc a ON l.domain = a.domain GROUP BY l.domain, language")},
        {_fill("leaf", "domain, language", "SELECT l.domain, l.language, leaf, l.cap, 1 AS weight, alloc AS budget FROM l JOIN language_alloc a ON l.domain = a.domain AND l.language = a.language")},
        p AS (
            SELECT l.domain, l.language, l.leaf, coalesce(alloc // nullif(tokens, 0), 0)::BIGINT AS full_epochs, coalesce(alloc % nullif(tokens, 0), 0)::BIGINT AS part
            FROM l JOIN leaf_alloc a ON l.domain = a.domain AND l.language = a.language AND l.leaf = a.leaf
        ), o AS (
            SELECT d.*, full_epochs, part, sum(n_tokens) OVER (PARTITION BY d.domain, d.language, d.leaf ORDER BY md5(concat_ws(':', '7', full_epochs::VARCHAR, coalesce(doc_id::VARCHAR, '')))) AS got
            FROM d JOIN p ON d.domain = p.domain AND d.language = p.language AND d.leaf = p.leaf
        )
        SELECT doc_id, text, lang, source, n_chars, domain, unnest(range(0, full_epochs + CASE WHEN part > 0 AND got <= part THEN 1 ELSE 0 END)) AS epoch FROM o"""

SQL: dict[str, str] = {
    "op2_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY norm)""",
    "op5_quality_rules": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), m AS (
            SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
                   length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                   length(regexp_replace(t, '[^0-9]', '', 'g')) AS n_digits, len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_letter_words,
                   length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower,
                   list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
                   list_transform(range(1, len(w) - 1), lambda i: {'a': w[i], 'b': w[i + 1], 'c': w[i + 2]}) AS wins
            FROM d
        ), u AS (SELECT doc_id, unnest(wins) AS x, unnest(range(1, len(wins) + 1)) AS i FROM m),
        r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM u) WHERE c > 1),
        rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
        s AS (
            SELECT doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                   coalesce(n, 0)::BIGINT AS n_repeat_words, n_upper, n_lower, n_digits, n_letter_words, len(lines) AS n_lines
            FROM m LEFT JOIN rep USING (doc_id)
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR n_upper > n_lower
                    OR (n_dup_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines)
                    OR 2 * word_chars < 5 * n_words OR word_chars > 12 * n_words
                    OR 10 * n_digits > 3 * word_chars OR 10 * n_letter_words < 6 * n_words) AS kept
        FROM s""",
    "op6_warc_revisit": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        q AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS last FROM p)
        SELECT page_id, payload_bytes,
               list_aggregate(list_transform(range(0, 32), lambda k:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                          (((('0x' || substr(x, (5 * (k // 4) + 1)::INT, 5))::INT >> (15 - 5 * (k % 4))::INT) & 31) + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> last THEN last END AS refers_to
        FROM q""",
    "op8_line_dedup": r"""
        WITH h AS (SELECT DISTINCT coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
        l AS (
            SELECT host, unnest(list_distinct(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> ''))) AS line
            FROM h
        ), bad AS (
            SELECT host, list(line) AS bad
            FROM (SELECT host, line, count(*) AS pages FROM l GROUP BY ALL)
            JOIN (SELECT host, count(*) AS total FROM h GROUP BY ALL) USING (host)
            WHERE pages >= 3 AND pages > 0.05 * total GROUP BY host
        ), s AS (
            SELECT documents.*, string_split(text, chr(10)) AS lines,
                   list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(bad, []), trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) AS good
            FROM documents LEFT JOIN bad ON coalesce(source, '') = host
        )
        SELECT doc_id, CASE WHEN len(good) < len(lines) THEN array_to_string(good, chr(10)) ELSE text END AS text, lang, source, n_chars,
               coalesce(len(lines) - len(good), 0)::BIGINT AS n_lines_dropped
        FROM s""",
    "op10_mixing": MIX_SQL,
    "op11_sharding": r"""
        WITH crc AS (
            SELECT list(c ORDER BY i) AS t FROM (
                SELECT i, list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(0, 256) r(i))
        ), d AS (
            SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce('k' || doc_id::VARCHAR, '-') AS key, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), s AS (
            SELECT doc_id, size::BIGINT AS size,
                   xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, size - 1), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT)),
                       lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32,
                   list_transform(range(0, 17), lambda s: {'draw': substr(md5(s || ':' || key), 1, 13), 'shard': -s}) AS draws
            FROM d, crc
        ), p AS (
            SELECT doc_id, size, text_crc32, 'key' AS law, (-list_max(draws[1:16]).shard)::INT AS shard, (-list_max(draws).shard)::INT AS grown_shard FROM s
        )
        SELECT *, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS LAST, size, text_crc32) - 1 AS slot FROM p""",
    "op12_hard_negatives": """
        WITH v AS (
            SELECT row_number() OVER () AS rk, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.rk, a.vec_id AS anchor_id, b.rk AS other, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
            FROM v a JOIN v b ON a.rk <> b.rk WHERE a.vec_id % 100 = 0
        ), p AS (
            SELECT rk, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY rk ORDER BY score DESC, vec_id, other) AS nth FROM s WHERE same
        ), n AS (
            SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.rk, nth ORDER BY s.score DESC, s.vec_id, other) AS rank
            FROM p JOIN s ON p.rk = s.rk AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score WHERE nth <= 5
        )
        SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
    "op13_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS rk, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), g AS (SELECT DISTINCT lang, source FROM d),
        t AS (SELECT rk, lang, source, unnest(w) AS term FROM d),
        k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT rk) >= 3),
        c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
        l AS (SELECT lang, count(*) AS v, sum(total) AS big FROM k GROUP BY lang),
        s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS sum FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
        p AS (
            SELECT s.lang, s.source, k.term, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (s.sum + v) AS p, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (total + 1)) // (big + v) AS q
            FROM s JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term)
        ), pairs AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), allp AS (
            SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
        ), terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
        r AS (
            SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM allp
            UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM terms) WHERE rank <= 200
        )
        SELECT * FROM r""",
}
