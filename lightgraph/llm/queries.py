"""The contract query of each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare, table
from . import alignment, ann, bpe, brown, conversations, exact, langid, packing, pii, quality, rules, simhash, warc


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(prepare(spark), sf_dir, "documents"))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(prepare(spark), sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op5_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(prepare(spark), sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_grouping_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.sequences(table(prepare(spark), sf_dir, "documents"))


def op7_warc_index_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(prepare(spark), sf_dir, "pages"))


def op8_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(prepare(spark), sf_dir, "documents"))


def op9_brown_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(table(prepare(spark), sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(prepare(spark), sf_dir, "documents"))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digests(table(prepare(spark), sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(conversations.damaged(table(prepare(spark), sf_dir, "conversations")))


def op13_exact_dedup_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.classes(table(prepare(spark), sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_quality_rules, op3_bpe_round_trip, op4_language_id, op5_multi_index_hashing,
        op6_grouping_genetic_packing, op7_warc_index_first, op8_pii_deobfuscation, op9_brown_lm_scoring, op10_simhash_near_dedup,
        op11_cross_tokenizer_alignment, op12_conversation_repair, op13_exact_dedup_tree,
    )
}



def _rules_sql() -> str:
    """The counts and, as the sketches are sums of exact bucket counts, the verdicts too."""
    space = "[ \\t\\n\\x0B\\f\\r]"
    bucket = lambda x: f"CASE WHEN {x} < 32 THEN {x} ELSE 16 * (length(bin({x})) - 5) + ({x} >> (length(bin({x})) - 5)) END"
    value = lambda b: f"CASE WHEN {b} < 32 THEN {b}::DOUBLE ELSE ({b} - 16 * ({b} // 16 - 1)) * pow(2.0, {b} // 16 - 1) END"
    scaled = {"symbols_per_1000": "1000 * n_symbols // n_words", "dup_lines_per_1000": "1000 * n_dup_lines // greatest(n_lines, 1)", "repeats_per_1000": "1000 * n_repeat_words // n_words", "chars_per_100_words": "100 * word_chars // n_words"}
    levels = {"q0": ["lang", "source"], "q1": ["lang"], "q2": []}
    quartiles = ", ".join(
        f"{name} AS (SELECT {''.join(k + ', ' for k in keys)}measure, max(CASE WHEN rn = ceil(total * 0.25) THEN b END) AS b1, max(CASE WHEN rn = ceil(total * 0.75) THEN b END) AS b3, max(total) AS total FROM "
        f"(SELECT *, row_number() OVER (PARTITION BY {''.join(k + ', ' for k in keys)}measure ORDER BY b) AS rn, count(*) OVER (PARTITION BY {''.join(k + ', ' for k in keys)}measure) AS total FROM m WHERE NOT base_failed AND b IS NOT NULL) GROUP BY ALL)"
        for name, keys in levels.items()
    )
    joins = " ".join(f"LEFT JOIN {name} ON {name}.measure = m.measure" + "".join(f" AND {name}.{k} IS NOT DISTINCT FROM m.{k}" for k in keys) for name, keys in levels.items())
    pick = lambda b: f"CASE WHEN q0.total >= {rules.LEAST_DOCS} THEN q0.{b} WHEN q1.total >= {rules.LEAST_DOCS} THEN q1.{b} ELSE q2.{b} END"
    least = " ".join(f"WHEN '{m}' THEN {r}.0" for m, r in rules.LEAST_RANGE.items())
    both = ", ".join(f"'{m}'" for m in rules.TWO_SIDED)
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, list_filter(regexp_split_to_array(text, '{space}+'), lambda x: x <> '') AS w,
                     list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS l FROM d),
        g AS (SELECT r, i, w[i : i + 4] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
        t AS (SELECT r, unnest(range(i, i + 5)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
        c AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM t GROUP BY r),
        b AS (SELECT w.r, doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                     (length(text) - length(translate(text, '{rules.SYMBOLS}', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
                     coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines FROM w LEFT JOIN c USING (r)),
        f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
        x AS (SELECT *, unnest([{", ".join(f"{{'measure': '{n}', 'v': CASE WHEN n_words > 0 THEN ({e})::BIGINT END}}" for n, e in scaled.items())}]) AS u FROM f),
        m AS (SELECT r, lang, source, base_failed, n_words, u.measure AS measure, {bucket("u.v")} AS b FROM x),
        {quartiles},
        v AS (SELECT m.r, m.measure, m.n_words, {value("m.b")} AS x, {value(f"({pick('b1')})")} AS v1, {value(f"({pick('b3')})")} AS v3 FROM m {joins}),
        k AS (SELECT r, bool_and(coalesce(x <= v3 + s, true) AND (measure NOT IN ({both}) OR coalesce(x >= v1 - s, true))) AS ok
              FROM (SELECT *, {rules.FENCE} * greatest(v3 - v1, CASE measure {least} END) * CASE WHEN measure IN ({both}) THEN 1.0::DOUBLE + greatest(0.0::DOUBLE, {rules.FEW}.0::DOUBLE / greatest(n_words, 1) - 1) ELSE 1.0::DOUBLE END AS s FROM v) GROUP BY r)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(ok, false) AS kept
        FROM f LEFT JOIN k USING (r)
    """


#: op2, op7 and op13 are within SQL. The others learn, hash with XXH64 or crc32, tokenize, or track positions, which DuckDB can't follow.
ORACLE_SQL = {
    "op2_quality_rules": _rules_sql(),
    "op7_warc_index_first": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                   sha256(coalesce(html, '')) AS payload_digest
            FROM pages),
        f AS (SELECT payload_digest AS d, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first IS NOT DISTINCT FROM page_id THEN NULL ELSE first END AS refers_to
        FROM p LEFT JOIN f ON d = payload_digest AND payload_bytes >= 100
    """,
    "op13_exact_dedup_tree": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS plain FROM documents),
        g AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY plain) AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size, sha256(plain) AS text_sha256 FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
    """,
}
