"""op11 to op13 against their SQL on tables with edge rows, and against plain versions where sizes or limits matter."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from wavelake.llm import divergence, filter_audit, pii, queries

LONG = "lorem Ipsum dolor " * 20_000 + "x" * 50_000 + " +1 555 123 4567 ende"
TEXTS = [None, "", "   \t\n ", LONG, "same same", "same same", "Ünï 4111-1111 1111 1111é a@b.c_d@e.f 999.1.2.3 IP 001.2.3.255.7 +49 (30) 1234567..", "IBAN: DE89 3704 0044 0532 0130 00 XGB82WEST12345698765432 GB82WEST12345698765432 ssn 078-05-1120 1-078-05-1120"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def tables(spark, small):
    """documents with edge rows (repeated, null ids, null sources and languages) under further, clashing names; labels."""
    odd = [(9000 + i, t, "xx" if i % 3 else None, f"s{i % 2}" if i % 4 else None, 0) for i, t in enumerate(TEXTS)]
    odd += [odd[4], odd[4], (None, "same same", None, "s1", 0), (None, "same same", None, "s1", 0), (-5, LONG, "xx", "s1", 0)]
    docs = spark.read.parquet(f"{small}/documents.parquet").unionByName(spark.createDataFrame(odd, SCHEMA))
    clash = docs.withColumns({c: F.lit(1) for c in ("spans", "kept", "term", "part", "words", "A", "n", "digest", "row_")})
    labels = spark.read.parquet(f"{small}/labels.parquet").unionByName(spark.createDataFrame([(9004, 1, 0), (9004, 0, 1), (None, 1, 1), (9001, None, None)], "doc_id bigint, quality int, toxic int"))
    return clash.cache(), labels.cache()


def same_as_sql(found, name, **tables):
    made = duckdb.connect()
    for table, df in tables.items():
        made.register(table, df.toArrow())
    plain = made.sql(queries.ORACLE_SQL[name])
    columns = sorted(plain.columns)
    assert sorted(found.columns) == columns
    at = [plain.columns.index(c) for c in columns]
    assert sorted((tuple(r[k] for k in at) for r in plain.fetchall()), key=repr) == sorted(map(tuple, found.select(*columns).collect()), key=repr)


def test_op11_sql(tables):
    same_as_sql(pii.pii_report(tables[0]), "op11_pii", documents=tables[0])


STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    valid = {
        "email": lambda v: True,
        "ip": lambda v: all(int(p) <= 255 for p in v.split(".")),
        "card": lambda v: 16 <= len(d := re.sub("[ -]", "", v)) <= 19 and luhn(d),
        "phone": lambda v: 8 <= len(re.sub("[^0-9]", "", v)) <= 15,
    }
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in STATED.items() for m in re.finditer(p, text) if valid[k](m[0]))


def test_op11_stated_patterns(spark):
    """Random texts of what the patterns are made of."""
    pick = random.Random(11)
    pieces = ["a", "b.c", "@", ".", "-", "_", "+", "1", "25", "255", "256", "4111111111111111", " ", "(", ")", "é", "%", "0", "+4", "1.2.3.4"]
    texts = ["".join(pick.choices(pieces, k=pick.randint(1, 40))) for _ in range(3000)]
    rows = pii.pii_report(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    for r in rows:
        base = plain_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), (texts[r.doc_id], base, r.spans)
        assert r.spans.startswith(base) and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [base.count(f"{k}:") for k in STATED]


def test_op11_runs_cost_in_proportion(spark):
    n = 200_000
    texts = ["a" * n, "1" * n, "1." * n, "+1" + " " * n, "a@" * n, "a@b" + ".c" * n, "1-" * n, "+1-" * n, "A1" * n]
    began = time.time()
    rows = pii.pii_report(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert len(rows) == len(texts) and time.time() - began < 120


def test_op11_redact(spark, tables):
    text = "mail a@b.co and a@b.co.1.2.3.4 or IBAN DE89370400440532013000."
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string").withColumn("spans", F.lit(7))
    assert [tuple(r) for r in pii.redact(docs).orderBy("doc_id").collect()] == [(1, "mail [EMAIL] and [EMAIL] or IBAN [IBAN].", 7), (2, None, 7), (3, "", 7)]
    assert pii.redact(docs, least=101).first().text == text
    assert pii.pii_report(docs.limit(0)).count() == 0


def test_op12_sql(tables):
    same_as_sql(divergence.divergence(tables[0]), "op12_source_divergence", documents=tables[0])


def plain_divergence(rows, least):
    words = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))) for lang, source, text in rows]
    made = []
    apart = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {w[0] for w in words}:
        seen = Counter(t for own, _, c in words if own == lang for t in c)
        kept = sorted(t for t, n in seen.items() if n >= least)
        counts = defaultdict(Counter)
        for own, source, c in words:
            if own == lang:
                counts[source].update({t: n for t, n in c.items() if seen[t] >= least})
        whole = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        for s in counts:
            pairs = [(-sum(apart(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(-apart(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:10])):
                made += [(lang, s, part, item, -v, k) for k, (v, item) in enumerate(items, 1)]
    return sorted(made)


@pytest.mark.parametrize(("light", "tile", "terms"), [(0, 3, 5), (4, 5, 7), (99, 4, 9)])
def test_op12_tiles(spark, monkeypatch, light, tile, terms):
    """Heavy terms alone, both, light ones alone; many tiles of groups and of terms."""
    for name, value in (("LIGHT", light), ("TILE", tile), ("TERMS", terms), ("LEAST_DOCUMENTS", 3)):
        monkeypatch.setattr(divergence, name, value)
    pick = random.Random(light)
    rows = [(pick.choice(["a", "b"]), f"s{pick.randint(0, 17)}", " ".join(f"w{'xyz'[k % 3]}{chr(97 + min(k, 25))}" for k in (int(pick.expovariate(0.15)) for _ in range(pick.randint(0, 30))))) for _ in range(300)]
    rows += [("a", "empty", ""), ("lonely", "s", "word " * 5), ("none", "s1", "x"), ("none", "s2", None)]
    found = divergence.divergence(spark.createDataFrame(rows, "lang string, source string, text string"))
    assert sorted(map(tuple, found.select("lang", "source", "part", "item", "value", "rank").collect())) == plain_divergence(rows, 3)


def test_op12_edges(spark):
    assert divergence.divergence(spark.createDataFrame([], "lang string, source string, text string")).count() == 0
    many = spark.range(50).selectExpr("cast(null as string) AS lang", "'s' || id % 2 AS source", "'Wide wide W' || repeat('ö', 100) AS text")
    rows = divergence.divergence(many.withColumn("value", F.lit(0))).where("part = 'pair'").collect()
    assert [(r.lang, r.value) for r in rows] == [("", 0), ("", 0)]


def test_op12_large_counts(spark):
    """Counts whose product with a billion is beyond a long."""
    row = spark.range(1).selectExpr("9000000000000 AS c", "20000000000000 AS n", "3 AS v").select(divergence.share("c", "n", "v").alias("p")).first()
    assert row.p == 1 + 10**9 * (9 * 10**12 + 2) // (2 * 10**13 + 6)


def test_op13_sql(tables):
    same_as_sql(filter_audit.audit(*tables), "op13_filter_audit", documents=tables[0], labels=tables[1])


def test_op13_copies(spark):
    """A third of all rows are one text, some of one id; empty tables."""
    docs = spark.range(3000).selectExpr("id % 2900 AS doc_id", "if(id % 3 = 0, 'one and the same', 'text ' || id) AS text", "cast(null as string) AS source")
    labels = spark.createDataFrame([(0, 1, 1), (3, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = {(r.filter_order, r.step): r for r in filter_audit.audit(docs, labels).collect()}
    assert len(rows) == 600 and {r.part for r in rows.values()} == {""}
    texts = [(i % 2900, "one and the same" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    least = {}
    for i, t in texts:
        least[t] = min(i, least.get(t, i))
    fails = sum(i > least[t] for i, t in texts)
    first = rows["EABCD", 1]
    assert (first.removed, first.kept, first.good_lost, first.toxic_lost) == (fails, 3000 - fails, sum(i == 3 for i, t in texts if i > least[t]), 0)
    assert rows["ABCDE", 5].removed == 0 and rows["ABCDE", 5].redundant == fails
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert filter_audit.audit(docs, labels.limit(0)).where("good_lost > 0").count() == 0


def test_op13_cube_has_all_parts(spark):
    """The cube also holds the subsets' survivors over all parts."""
    docs = spark.range(40).selectExpr("id AS doc_id", "if(id % 2 = 0, 'x $', 'Y') AS text", "'p' || id % 3 AS source")
    alive = filter_audit.survivors(filter_audit.tallied(filter_audit.flagged(docs, docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic"))))
    rows = {r.subset: r.n for r in alive.where("all_parts").collect()}
    assert len(rows) == 32 and rows[0] == 40 and rows[8] == 20 and rows[16] == 2 and rows[1] == 0
