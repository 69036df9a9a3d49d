"""Registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqmill.llm import align, audit, decontaminate, html, langid, lines, near, packing, quality, substrings, suffixes, toxicity, urls
from seqmill.llm.common import table


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy version removes, from the ledger of op5."""
    return quality.ablations(quality.ledger(table(spark, sf_dir, "documents"), "text", "doc_id"), *quality.POLICIES)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.digest(table(spark, sf_dir, "documents"))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.digest(table(spark, sf_dir, "documents"))


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The urls that the rules decide are the small labelled table from which the others are judged."""
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.fit(urls.ruled(pages)))


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substrings, op2_decontaminate, op3_language, op4_packing, op5_quality, op6_toxicity, op7_near, op8_suffixes, op9_html, op10_lines, op11_alignment, op12_urls, op13_audit,
        quality_ablations,
    )
}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TRIM = "trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_LEDGER = rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
        l AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE {_TRIM} <> ''),
        ls AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY doc_id),
        k AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 3)),
        r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 2)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM k) WHERE c > 1) GROUP BY doc_id),
        m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
                CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
            FROM d LEFT JOIN ls USING (doc_id) LEFT JOIN r USING (doc_id)),
        f AS (SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END) + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END)
                + (CASE WHEN n_lines > 0 AND 100 * n_dup_lines > 60 * n_lines THEN 8 ELSE 0 END) + (CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END) AS BIGINT) AS failed_bits FROM m)"""

ORACLE_SQL: dict[str, str] = {
    "op1_substrings": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        g AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13),
        k AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM g),
        m AS (SELECT s, min(doc_id) AS first FROM k GROUP BY s),
        gone AS (SELECT DISTINCT doc_id, i + j AS p FROM k JOIN m USING (s), (SELECT unnest(generate_series(0, 12)) AS j) WHERE first < doc_id),
        p AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d WHERE len(w) > 0),
        kept AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.p) FILTER (gone.p IS NULL) AS t, count(gone.p) AS n FROM p LEFT JOIN gone USING (doc_id, p) GROUP BY p.doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op2_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
        v AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
        s AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT *, unnest(generate_series(1, len(w) - n + 1)) AS i FROM v)),
        k AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n)),
        h AS (SELECT doc_id, item_id, i, n FROM k JOIN s USING (n, s)),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM h) GROUP BY doc_id),
        it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op5_quality": f"""{_LEDGER}
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits % 4 > 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM f""",
    "quality_ablations": f"""{_LEDGER},
        v(policy, m) AS (VALUES ('base', 3), ('2024-1', 7), ('2024-2', 31)), x(rule, bit) AS (VALUES ('short', 1), ('repetitive', 2), ('symbol_heavy', 4), ('duplicate_lines', 8), ('word_length', 16)),
        q AS (SELECT policy, rule, m, bit FROM v, x WHERE m & bit > 0)
        SELECT policy, rule, count(*) FILTER (failed_bits & bit > 0) AS n_failed, count(*) FILTER (failed_bits & m = bit) AS n_only, count(*) FILTER (failed_bits & (m - bit) = 0) AS n_kept_without,
            count(*) FILTER (failed_bits & m = 0) AS n_kept, CAST(bit_or(failed_bits) AS BIGINT) AS bits_seen FROM f, q GROUP BY policy, rule""",
    "op7_near": f"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({_FOLD}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 1, 1))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
        pairs AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, x.b FROM reach r JOIN pairs x ON r.b = x.a),
        c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c ON a = doc_id""",
    "op10_lines": f"""
        WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS p FROM documents),
        t AS (SELECT *, {_TRIM} AS bare FROM l),
        b AS (SELECT bare FROM t WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= 10),
        k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) FILTER (b.bare IS NULL) AS left_text, count(b.bare) AS n FROM t LEFT JOIN b USING (bare) GROUP BY doc_id)
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_removed_lines, CAST(length(coalesce(left_text, '')) AS BIGINT) AS n_chars_left, sha256(coalesce(left_text, '')) AS kept_sha256
        FROM documents LEFT JOIN k USING (doc_id)""",
    "op13_audit": f"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
        l AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INTEGER)) AS good, max(CAST(coalesce(toxic = 1, false) AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
        e AS (SELECT *, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
        b AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CAST(len(w) < 50 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INTEGER)
            + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) AS INTEGER) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER)
            + 16 * CAST(coalesce(doc_id > first, false) AS INTEGER) AS bits FROM e LEFT JOIN l USING (doc_id)),
        g AS (SELECT part, bits, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM b GROUP BY part, bits),
        x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
        o AS (SELECT p.f || q.f || r.f || s.f || t.f AS o FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.f, q.f, r.f, s.f, t.f])) = 5),
        s AS (SELECT o, step, 1 << (ascii(o[step]) - 65) AS f, CAST(coalesce(list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(o[k]) - 65))), 0) AS INTEGER) AS bef FROM o, (SELECT unnest(generate_series(1, 5)) AS step)),
        c AS (SELECT part, o, step, sum(CASE WHEN bits & (bef | f) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN bits & f > 0 AND bits & bef = 0 THEN n ELSE 0 END) AS removed,
                sum(CASE WHEN bits & f > 0 AND bits & bef > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN bits = f THEN n ELSE 0 END) AS unique_fails,
                sum(CASE WHEN bits & f > 0 AND bits & bef = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN bits & f > 0 AND bits & bef = 0 THEN toxic ELSE 0 END) AS toxic_lost
            FROM g, s GROUP BY part, o, step)
        SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
            CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, o[step]) AS BIGINT) AS shapley FROM c""",
}
