"""How far the sources of a language differ in their words: a heavy-light split of all terms, added up exactly.

Each group, a (lang, source), gives each kept term of its language a share p in whole billionths, smoothed; two groups
differ by the sum over all kept terms of f(p, q) = floor((p - q)^2 / (p + q)). Terms that more than LIGHT groups hold are
heavy: groups by terms are cut into tiles of about TILE groups and TERMS terms, and a task compares two tiles' groups in
dense numpy arrays. A group that lacks a term has one share for all such terms, so for two groups g and h, with
z = f(absent, absent), light terms are counted without looking at each:

    sum over all terms = (their number) z + [heavy terms of either](f(p, q) - z)
                         + [light terms of g](f(p, absent) - z) + [light terms of h](f(absent, p) - z)
                         + [light terms of both](f(p, q) - f(p, absent) - f(absent, q) + z)

where the second line needs only how many light terms of a group have each count, and the last one the pairs of the at
most LIGHT groups in a term's posting list. All parts are whole numbers and are added as such, so nothing is rounded.

Words are counted in tasks before they are shuffled, so a source with a third of all rows makes no more rows than its
vocabulary for each task; shares reach the counts by group and a salt. No group's terms nor term's groups meet in one task
but those of a tile.

Null texts, languages and sources are empty strings; texts without terms still make their group appear. Repeated rows are
documents of their own. A language without kept terms has differences of 0, and no terms; one of a single source no pairs.
An empty table gives no rows. Long texts are counted whole. Other columns play no part, ids neither.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelake.llm.common import bounded, save

#: Documents of its language that a kept term is in, and ranks of the list of terms (fixed values).
LEAST_DOCUMENTS, RANKS = 10, 10
#: Groups that a light term is in at most, groups and terms of a tile, salts of a join by group, counted words held in a
#: task, and bytes of text after which it is seen whether they are too many.
LIGHT, TILE, TERMS, SALTS, COUNTED, HELD_BYTES = 8, 128, 512, 64, 300_000, 4 << 20
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def task_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> lang, source, term, tf (occurrences), df (documents), added up until there are more than
    COUNTED; one row of a null term for each group."""
    tf: dict[tuple[str, str], Counter[bytes]] = {}
    df: dict[tuple[str, str], Counter[bytes]] = {}
    read = 0

    def flushed() -> pa.RecordBatch:
        groups = [(group, len(own)) for group, own in tf.items()]
        names = [pa.array([group[i] for group, n in groups for _ in range(n + 1)], pa.string()) for i in (0, 1)]
        terms = pa.array([t for own in tf.values() for t in (None, *own)], pa.binary()).cast(pa.string())
        counts = [pa.array([n for own in held.values() for n in (0, *own.values())], pa.int64()) for held in (tf, {g: {t: df[g][t] for t in own} for g, own in tf.items()})]
        return pa.RecordBatch.from_arrays([*names, terms, *counts], ["lang", "source", "term", "tf", "df"])

    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            words = TERM.findall((text or b"").lower())
            group = (lang or "", source or "")
            tf.setdefault(group, Counter()).update(words)
            df.setdefault(group, Counter()).update(set(words))
            read += len(text or b"")
        if read > HELD_BYTES and (sum(map(len, tf.values())) > COUNTED or sum(len(t) for own in tf.values() for t in own) > 16 * COUNTED):
            yield flushed()
            tf.clear()
            df.clear()
        read = 0 if read > HELD_BYTES else read
    if tf:
        yield flushed()


@bounded
def term_counts(documents: DataFrame) -> DataFrame:
    """lang, source, term, tf, df; a null term's row for each group."""
    parts = documents.select("lang", "source", "text").mapInArrow(task_counts, "lang string, source string, term string, tf bigint, df bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def share(count: str, total: str, terms: str) -> Column:
    """floor(10^9 (count + 2) / (total + 2 terms)) + 1, in decimals wide enough for any count."""
    return F.expr(f"1 + CAST(1000000000 AS DECIMAL(10)) * CAST({count} + 2 AS DECIMAL(20)) div CAST(nullif({total} + 2 * {terms}, 0) AS DECIMAL(20))")


def f(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so the square is a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def with_shares(df: DataFrame, groups: DataFrame) -> DataFrame:
    """df (lang, source, ...) with its group's columns, by group and salt: a group's rows are dealt to SALTS keys."""
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = df.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, ["lang", "source", "salt"]).drop("salt")


def compared(table: pa.Table) -> pa.Table:
    """One pair of tiles: lang, g, h (g < h), value. Rows of a null term are groups, in each tile. A block of heavy terms gives
    what its terms add to z; in block -1, groups say how many terms (m) the language keeps, the other rows how many light
    terms of a group have a share."""
    lang, light, square = table.column("lang")[0].as_py(), table.column("block")[0].as_py() < 0, table.column("i")[0] == table.column("j")[0]
    side, p, absent, m = (table.column(c).to_numpy() for c in ("side", "p", "absent", "m"))
    source, term = (table.column(c).to_pylist() for c in ("source", "term"))
    apart = lambda a, b: (a - b) ** 2 // (a + b)
    head = np.array([t is None for t in term])
    two = 0 if square else 1
    heads = [np.flatnonzero(head & (side == s)) for s in (0, two)]
    names = [[source[k] for k in own] for own in heads]
    zero = [absent[own] for own in heads]
    sums = np.zeros((len(names[0]), len(names[1])), np.int64)
    if not sums.size:
        return pa.table({"lang": pa.array([], pa.string()), "g": pa.array([], pa.string()), "h": pa.array([], pa.string()), "value": pa.array([], pa.int64())})
    bodies = [np.flatnonzero(~head & (side == s)) for s in (0, two)]
    at = [dict(zip(own, range(len(own)), strict=True)) for own in names]
    place = [np.array([where[source[k]] for k in own], int) for where, own in zip(at, bodies, strict=True)]
    z = apart(zero[0][:, None], zero[1][None, :])
    if light:
        sums += int(m[heads[0][0]]) * z
        for k, g in zip(bodies[0].tolist(), place[0].tolist(), strict=True):
            sums[g] += m[k] * (apart(p[k], zero[1]) - z[g])
        for k, h in zip(bodies[1].tolist(), place[1].tolist(), strict=True):
            sums[:, h] += m[k] * (apart(p[k], zero[0]) - z[:, h])
    else:
        columns = {t: k for k, t in enumerate({term[k] for own in bodies for k in own})}
        dense = [np.repeat(x[:, None], len(columns), axis=1) for x in zero]
        for x, own, rows in zip(dense, bodies, place, strict=True):
            x[rows, [columns[term[k]] for k in own]] = p[own]
        for k, row in enumerate(dense[0]):
            sums[k] = apart(row[None, :], dense[1]).sum(axis=1)
        sums -= len(columns) * z
    pairs = [(a, b, int(v)) for a, line in zip(names[0], sums, strict=True) for b, v in zip(names[1], line, strict=True) if not square or a < b]
    g, h = ([pick(x[:2]) for x in pairs] for pick in (min, max))
    return pa.table({"lang": pa.array([lang] * len(pairs), pa.string()), "g": pa.array(g, pa.string()), "h": pa.array(h, pa.string()), "value": pa.array([x[2] for x in pairs], pa.int64())})


def tiles(rows: DataFrame) -> DataFrame:
    """(lang, source, blocks, block, term, p, absent, m) -> a copy of each row for each pair of group tiles that its group is
    in: i and j (i <= j), side."""
    own = rows.withColumn("own", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    return own.select("lang", "block", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "source", "term", "p", "absent", "m")


def paired(df: DataFrame) -> DataFrame:
    return df.groupBy("lang", "block", "i", "j").applyInArrow(compared, "lang string, g string, h string, value long")


def group_table(counts: DataFrame, held: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, n (kept occurrences), terms, lang_n, heavy (terms), blocks (tiles of its language's groups),
    absent (the share of a term that isn't there)."""
    known = counts.where("term IS NULL").select("lang", "source").join(held.groupBy("lang", "source").agg(F.sum("tf").alias("n")), ["lang", "source"], "left")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_n"), F.sum(F.when(F.col("held") > LIGHT, 1).otherwise(0)).alias("heavy"))
    sizes = known.groupBy("lang").agg(F.ceil(F.count("*") / TILE).alias("blocks"))
    made = known.join(sizes, "lang").join(langs, "lang", "left").na.fill(0, ["n", "terms", "lang_n", "heavy"])
    return made.withColumn("absent", F.coalesce(share("0", "n", "terms"), F.lit(1)))


def differences(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """lang, g, h (g < h), value: of all pairs of groups of a language. postings: lang, source, term, p, held, absent, blocks, heavy."""
    none = F.lit(None).cast("string")
    wide = F.greatest(F.lit(1), F.ceil(F.col("heavy") / TERMS)).cast("int")
    of_term = F.pmod(F.xxhash64("term"), wide).cast("int")
    # dense: heavy terms, and in each of their tiles a row for each group
    heads = groups.where("heavy > 0").withColumn("block", F.explode(F.sequence(F.lit(0), wide - 1)))
    heads = heads.select("lang", "source", "blocks", "block", none.alias("term"), "absent", F.col("absent").alias("p"), F.lit(0).cast("long").alias("m"))
    heavy = postings.where(F.col("held") > LIGHT).select("lang", "source", "blocks", of_term.alias("block"), "term", "absent", "p", F.lit(1).cast("long").alias("m"))
    # all terms as if absent, which the tiles above take into account; light: how many terms of a group have each share
    base = groups.select("lang", "source", "blocks", F.lit(-1).alias("block"), none.alias("term"), "absent", F.col("absent").alias("p"), F.col("terms").alias("m"))
    light = postings.where(F.col("held") <= LIGHT)
    alike = light.groupBy("lang", "source", "blocks", "absent", "p").agg(F.count("*").alias("m"))
    alike = alike.select("lang", "source", "blocks", F.lit(-1).alias("block"), F.lit("").alias("term"), "absent", "p", "m")
    sums = paired(tiles(heads.unionByName(heavy).unionByName(base).unionByName(alike)))
    # both groups hold a light term: pairs of a posting list of LIGHT groups at most
    lists = light.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "absent"))).alias("held_by")).where("size(held_by) > 1")
    one = lists.select("lang", "held_by", F.posexplode("held_by").alias("at", "a"))
    both = one.select("lang", "a", F.explode(F.expr("slice(held_by, at + 2, size(held_by))")).alias("b"))
    a, b, a0, b0 = F.col("a.p"), F.col("b.p"), F.col("a.absent"), F.col("b.absent")
    both = both.select("lang", F.col("a.source").alias("g"), F.col("b.source").alias("h"), (f(a, b) - f(a, b0) - f(a0, b) + f(a0, b0)).alias("value"))
    return sums.unionByName(both).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))


def divergence(documents: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` has every other source of the language by how much it differs, part
    `term` the RANKS terms whose shares in the group exceed those in the language the most."""
    counts = save(term_counts(documents), "term-counts")
    kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("df").alias("docs"), F.sum("tf").alias("total"), F.count("*").alias("held")).where(F.col("docs") >= LEAST_DOCUMENTS)
    kept = save(kept.drop("docs"), "kept-terms")
    held = save(counts.where("term IS NOT NULL").join(kept, ["lang", "term"]).select("lang", "source", "term", "tf", "total", "held"), "held-terms")
    groups = save(group_table(counts, held, kept), "groups")
    known = with_shares(held, groups).withColumn("p", share("tf", "n", "terms")).withColumn("q", share("total", "lang_n", "terms"))
    postings = save(known.select("lang", "source", "term", "held", "blocks", "heavy", "absent", "p", "q"), "postings")
    pairs = save(differences(groups, postings), "differences")
    mutual = pairs.select("lang", F.col("g").alias("source"), F.col("h").alias("item"), "value").unionByName(pairs.select("lang", F.col("h").alias("source"), F.col("g").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    listed = mutual.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    above = postings.where("p > q").select("lang", "source", F.col("term").alias("item"), f(F.col("p"), F.col("q")).alias("value"))
    top = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= RANKS).withColumn("part", F.lit("term"))
    return listed.unionByName(top).select("lang", "source", "part", "item", "value", "rank")
