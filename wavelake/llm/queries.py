"""The queries of this subpackage, one for each operator over its whole tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.llm import chat, context_tree, decontaminate, divergence, filter_audit, nn_descent, pieces, pii, secret_scan, simhash, token_counts, toxicity, warc
from wavelake.llm.common import sql_lower


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trips(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.chat_report(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.fingerprint_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_sentencepiece, op3_token_counts, op4_secret_scan, op5_chat_format, op6_simhash, op7_lm_score, op8_toxicity, op9_nearest_neighbours, op10_warc, op11_pii, op12_source_divergence, op13_filter_audit)
}

WORDS = rf"regexp_extract_all({sql_lower("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def pii_sql() -> str:
    """Matches of the stated patterns; gaps of a split give their offsets and what is around them."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": pii.IBAN,
        "ssn": pii.SSN,
    }
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    doubled = f"[CASE WHEN i % 2 = 1 THEN CAST(reverse({digits})[i] AS INT) WHEN CAST(reverse({digits})[i] AS INT) > 4 THEN 2 * CAST(reverse({digits})[i] AS INT) - 9 ELSE 2 * CAST(reverse({digits})[i] AS INT) END for i in range(1, length({digits}) + 1)]"
    code = "replace(v, ' ', '')"
    values = f"[strpos('{pii.ALPHABET}', x) - 1 for x in string_split(substr({code}, 5) || substr({code}, 1, 4), '')]"
    parts = "[CAST(regexp_replace(x, '^0+', '0') AS HUGEINT) <= 255 for x in string_split(v, '.')]"
    valid = {
        "email": "true",
        "ip": parts.replace("CAST(regexp_replace(x, '^0+', '0') AS HUGEINT) <= 255", "length(ltrim(x, '0')) < 3 OR (length(ltrim(x, '0')) = 3 AND ltrim(x, '0') <= '255')").join(("list_bool_and(", ")")),
        "card": f"length({digits}) BETWEEN 16 AND 19 AND list_sum({doubled}) % 10 = 0",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
        "iban": f"NOT regexp_matches(around, '[A-Za-z0-9]\n|\n[A-Za-z0-9]') AND list_reduce({values}, lambda r, x: (r * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1",
        "ssn": f"NOT regexp_matches(around, '[0-9-]\n|\n[0-9-]') AND NOT regexp_matches(v, '{pii.SSN_INVALID}')",
    }
    near = sql_lower("around")
    steps = []
    for k, kind in enumerate(pii.KINDS):
        score = f"greatest(0, least(100, {pii.SCORES[k]} + CASE WHEN regexp_matches({near}, '{pii.whole_word(pii.WORDS[k])}') THEN {pii.BONUS} ELSE 0 END - CASE WHEN regexp_matches({near}, '{pii.whole_word(pii.AGAINST)}') THEN {pii.BONUS} ELSE 0 END))"
        steps.append(f"""
            SELECT row_, {k} AS k, '{kind}' AS kind, e - length(v) AS s, e, {score} AS score FROM (
                SELECT row_, v, right(gap, {pii.REACH}) || chr(10) || left(after_, {pii.REACH}) AS around, CAST(sum(length(gap) + length(v)) OVER (PARTITION BY row_ ORDER BY i) AS BIGINT) AS e FROM (
                    SELECT row_, i, vs[i] AS v, gaps[i] AS gap, gaps[i + 1] AS after_ FROM (
                        SELECT row_, vs, gaps, unnest(range(1, len(vs) + 1)) AS i FROM (SELECT row_, regexp_extract_all(t, '{patterns[kind]}') AS vs, string_split_regex(t, '{patterns[kind]}') AS gaps FROM d)))
            ) WHERE {valid[kind]}{f" AND {score} >= {pii.LIKELY}" if k >= pii.BASE_KINDS else ""}""")
    listed = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s)"
    counts = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in (*pii.KINDS[: pii.BASE_KINDS], "likely"))
    return f"""
        WITH d AS (SELECT row_number() OVER () AS row_, doc_id, coalesce(text, '') AS t FROM documents),
        m AS ({" UNION ALL ".join(steps)}),
        g AS (SELECT row_, {", ".join(f"count(*) FILTER (k = {k}) AS n_{pii.KINDS[k]}" for k in range(pii.BASE_KINDS))}, {listed} FILTER (k < {pii.BASE_KINDS}) AS base, {listed} AS spans,
                     count(*) FILTER (score >= {pii.LIKELY}) AS n_likely, string_agg(CAST(score AS VARCHAR), ',' ORDER BY k, s) AS scores FROM m GROUP BY row_)
        SELECT doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM d LEFT JOIN g USING (row_)"""


SHARE = "1 + CAST(1000000000 AS HUGEINT) * ({c} + 2) // ({n} + 2 * v)"
APART = "CAST((({a}) - ({b})) * (({a}) - ({b})) // (({a}) + ({b})) AS BIGINT)"
DIVERGENCE = rf"""
    WITH d AS (SELECT row_number() OVER () AS row_, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({sql_lower("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
    g AS (SELECT DISTINCT lang, source FROM d),
    t AS (SELECT row_, lang, source, term, count(*) AS n FROM (SELECT row_, lang, source, unnest(ws) AS term FROM d) GROUP BY ALL),
    k AS (SELECT lang, term, sum(n) AS total FROM t GROUP BY lang, term HAVING count(*) >= {divergence.LEAST_DOCUMENTS}),
    l AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM k GROUP BY lang),
    c AS (SELECT t.lang, t.source, t.term, sum(n) AS c FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
    n AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
    a AS (SELECT n.lang, n.source, k.term, coalesce(c, 0) AS c, {SHARE.format(c="coalesce(c, 0)", n="n")} AS p, {SHARE.format(c="total", n="lang_n")} AS q
          FROM n JOIN l ON n.lang = l.lang JOIN k ON n.lang = k.lang LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
    pairs AS (SELECT n.lang, n.source, o.source AS item FROM n JOIN n o ON n.lang = o.lang AND n.source <> o.source),
    sums AS (SELECT a.lang, a.source, b.source AS item, CAST(sum({APART.format(a="a.p", b="b.p")}) AS BIGINT) AS value FROM a JOIN a b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    terms AS (SELECT lang, source, term AS item, {APART.format(a="p", b="q")} AS value FROM a WHERE c > 0 AND p > q)
    SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY coalesce(value, 0) DESC, item) AS INT) AS rank FROM pairs LEFT JOIN sums USING (lang, source, item)
    UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM terms) WHERE rank <= {divergence.RANKS}"""

LETTERS = "(SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x)"
AUDIT = rf"""
    WITH d AS (SELECT doc_id, coalesce(CAST(source AS VARCHAR), '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least_ FROM d),
    l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
    f AS (SELECT part, CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END
            + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
            + CASE WHEN doc_id > least_ THEN 16 ELSE 0 END AS m, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l USING (doc_id)),
    m AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, m),
    o AS (SELECT a.x || b.x || c.x || e.x || g.x AS filter_order FROM {LETTERS} a, {LETTERS} b, {LETTERS} c, {LETTERS} e, {LETTERS} g WHERE len(list_distinct([a.x, b.x, c.x, e.x, g.x])) = 5),
    s AS (SELECT filter_order, CAST(i AS INT) AS step, 1 << (strpos('ABCDE', filter_order[i]) - 1) AS own, coalesce(list_sum([1 << (strpos('ABCDE', filter_order[j]) - 1) for j in range(1, i)]), 0) AS before FROM o, range(1, 6) AS r(i)),
    r AS (SELECT part, filter_order, step, own, CAST(sum(n) FILTER (m & before = 0 AND m & own = 0) AS BIGINT) AS kept, CAST(sum(n) FILTER (m & before = 0 AND m & own > 0) AS BIGINT) AS removed,
            CAST(sum(n) FILTER (m & before > 0 AND m & own > 0) AS BIGINT) AS redundant, CAST(sum(n) FILTER (m = own) AS BIGINT) AS unique_fails,
            CAST(sum(good) FILTER (m & before = 0 AND m & own > 0) AS BIGINT) AS good_lost, CAST(sum(toxic) FILTER (m & before = 0 AND m & own > 0) AS BIGINT) AS toxic_lost
          FROM (SELECT part, m, n, good, toxic, filter_order, step, own, CAST(before AS BIGINT) AS before FROM m, s) GROUP BY ALL)
    SELECT part, filter_order, step, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
           CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley FROM r"""

ORACLE_SQL: dict[str, str] = {
    "op11_pii": pii_sql(),
    "op12_source_divergence": DIVERGENCE,
    "op13_filter_audit": AUDIT,
    "op1_decontamination": f"""
        WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {WORDS} AS ws FROM benchmark),
        w AS (SELECT DISTINCT item_id, ws[i : i + 9] AS win FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM b WHERE len(ws) > 0)),
        lens AS (SELECT DISTINCT len(win) AS n FROM w),
        g AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS i, ws FROM d, lens WHERE len(ws) >= n),
        hit AS (SELECT g.doc_id, g.i, g.n, w.item_id FROM g JOIN w ON g.ws[g.i : g.i + g.n - 1] = w.win),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op10_warc": """
        WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        g AS (SELECT payload_digest, max(page_id) AS holder FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN holder <> page_id THEN holder END AS refers_to
        FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND payload_bytes >= 1000""",
}
