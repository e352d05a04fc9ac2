"""SimHash near-duplicates found with pivot distance tables.

Fingerprints: 64 bits, each set if it is set in over half of the XXH64 values of the word shingles.

fingerprint_links() finds all pairs within a Hamming radius of 2 without loss. Every fingerprint's distances to 16
fixed reference fingerprints are tabulated, whole and restricted to groups of bits. Two fingerprints within 2 bits agree
on at least three of five bit groups; there, by the triangle inequality, their restricted distance tables are the same,
so pairs meet in an equi-join on those coordinates. What meets there is split once more by the other bits, five groups of
them again, so that members of a list agree on all but ten bits or so and no list can be long, however large a family of
near copies is. Pairs of a list are discarded if a coordinate of their whole tables differs by more than the radius, and
the survivors are verified.

near_duplicate_groups() and one_of_each_group() are for word-set similarity (five words, 0.8 by default). At that radius
(a seventh of all bits) distances to fixed fingerprints tell too little to index by: fingerprint links give the first
pairs there, and set_join finds the rest, exactly; its tables hold distances to reference sets instead.

Null texts are empty; texts without words have fingerprint 0 and no shingles; texts of fewer words than a shingle have
one, the whole sequence. Null ids keep their fingerprint and take the component of what they link to. Repeated rows stay
rows. An empty table gives none.
"""

from __future__ import annotations

import random
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelake.llm.common import bounded, save, scratch, texts
from wavelake.llm.components import connected_components
from wavelake.llm.prints import fingerprints_of, runs, shingle_hashes
from wavelake.llm.set_join import candidates, similar_components

RADIUS, PIVOTS, BIT_GROUPS, SLOTS = 2, 16, 5, 1 << 20
_draw = random.Random(64)
REFERENCES = [_draw.getrandbits(64) for _ in range(PIVOTS)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


# ---------------------------------------------------------------- fingerprints


@bounded
def fingerprints(documents: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, text) -> doc_id, f (bigint, 64 bits), a row for each row."""

    def make(batches):
        for batch in batches:
            ids, own = batch.column("doc_id"), texts(batch)
            for a, b in runs([len(x) for x in own], 8 << 20):
                made = fingerprints_of([shingle_hashes(x, size) for x in own[a:b]]).view(np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(made[:, 0].copy())], ["doc_id", "f"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(make, "doc_id bigint, f bigint")


# ---------------------------------------------------------------- pivot tables


def pivot_distances(f: Column, mask: Column | None = None) -> list[Column]:
    """The Hamming distances to the references, in the mask's bits alone if there is one."""
    apart = [f.bitwiseXOR(F.lit(signed(r))) for r in REFERENCES]
    return [F.bit_count(x if mask is None else x.bitwiseAND(mask)) for x in apart]


def agreeing(bits: list[int]) -> list[int]:
    """Two fingerprints that differ in RADIUS of these bits at most agree on one of these masks: unions of BIT_GROUPS - RADIUS groups of them."""
    edges = [len(bits) * k // BIT_GROUPS for k in range(BIT_GROUPS + 1)]
    groups = [sum(1 << x for x in bits[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    return [reduce(int.__or__, x) for x in combinations(groups, BIT_GROUPS - RADIUS)]


def met(rows: DataFrame) -> DataFrame:
    """The rows whose key (of mask and restricted distances) another row has too."""
    return rows.join(rows.groupBy("key").agg(F.count("*").alias("n_")).where("n_ > 1").select("key"), "key", "left_semi")


def keyed(masks: Column) -> Column:
    """For each of the masks, its number and a key of it and of the distances restricted to it."""
    return F.transform(masks, lambda m, t: F.struct(t.alias("t"), F.xxhash64(m, *pivot_distances(F.col("f"), m)).alias("key")))


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """(f bigint, rep bigint), f distinct -> all pairs (a, b) of the reps of fingerprints at 2 or fewer differing bits."""
    first = agreeing(list(range(64)))
    second = [[m | x for x in agreeing([k for k in range(64) if not m >> k & 1])] for m in first]
    literal = lambda masks: F.lit([signed(m) for m in masks])
    table = save(distinct.select("f", "rep", F.array(*pivot_distances(F.col("f"))).cast("array<tinyint>").alias("d")), "pivots")
    rough = met(table.select("f", "rep", F.explode(keyed(literal(first))).alias("k")).select("f", "rep", "k.t", "k.key")).drop("key")
    masks = F.element_at(F.array(*(literal(x) for x in second)), F.col("t") + 1)
    fine = save(met(rough.select("f", "rep", F.explode(keyed(masks)).alias("k")).select("f", "rep", "k.key").distinct()).join(table.select("rep", "d"), "rep"), "met")
    other = fine.select("key", *(F.col(c).alias(f"{c}_") for c in ("f", "rep", "d")))
    pairs = fine.join(other, "key").where(F.col("f") < F.col("f_"))
    kept = pairs.where(F.forall(F.zip_with("d", "d_", lambda x, y: F.abs(x - y)), lambda gap: gap <= RADIUS))
    return kept.where(F.bit_count(F.col("f").bitwiseXOR(F.col("f_"))) <= RADIUS).select(F.col("rep").alias("a"), F.col("rep_").alias("b")).distinct()


def fingerprint_components(documents: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, f (the 64-bit fingerprint), component_id: the smallest doc_id reachable over links of 2 or fewer bits."""
    prints = save(fingerprints(documents, size), "fingerprints")
    distinct = prints.groupBy("f").agg(F.min("doc_id").alias("rep"))
    with scratch(documents.sparkSession):
        distinct = save(distinct, "distinct", outlive=True)
        parts = connected_components(fingerprint_links(distinct.where("rep IS NOT NULL")))
        named = save(distinct.join(parts, distinct.rep == parts.node, "left").select("f", F.coalesce("component", "rep").alias("component_id")), "named", outlive=True)
    return prints.join(named, "f").select("doc_id", "f", "component_id")


# ---------------------------------------------------------------- word-set similarity


def near_duplicate_groups(documents: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, sha, component_id, part: documents with equal word sequences, or linked by similar shingle sets, share the smallest doc_id reachable.

    sha is the digest of the word sequence. Documents without words are copies of each other. Null ids are left out. part
    tells groups apart whose smallest doc_id is the same, where an id has several texts; component_id is only a label.
    """
    own = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    with scratch(documents.sparkSession):
        prints = save(own.select("doc_id", word_digest("text").alias("sha")), "prints")
        # a digest's smallest id stands for it; an id with several texts gets a number of its own for the others
        first = save(prints.groupBy("sha").agg(F.min("doc_id").alias("doc_id")), "first")
        main = first.groupBy("doc_id").agg(F.min("sha").alias("main"))
        node = F.when(F.col("sha") == F.col("main"), F.col("doc_id")).otherwise(F.xxhash64("sha"))
        named = save(first.join(main, "doc_id").select("doc_id", "sha", node.alias("node")), "named")
        with scratch(documents.sparkSession):
            found = save(candidates(own, size, similarity), "candidates", outlive=True)
        sets = save(found.join(named.select("sha", "node"), "sha").drop("sha"), "sets")
        parts = similar_components(sets, print_pairs(sets), similarity)
        placed = save(named.join(parts, named.node == parts.node_, "left").select("sha", "doc_id", F.coalesce("component", "node").alias("part")), "placed")
        least = placed.groupBy("part").agg(F.min("doc_id").alias("component_id"))
        return save(prints.select("doc_id", "sha").join(placed.join(least, "part").select("sha", "component_id", "part"), "sha"), "groups", outlive=True)


def print_pairs(sets: DataFrame) -> DataFrame:
    """(node, f0) -> pairs (a, b): nodes of one fingerprint with the smallest, and those of fingerprints that are linked."""
    by_print = save(sets.groupBy("f0").agg(F.min("node").alias("rep")), "by_print")
    same = sets.select("node", "f0").join(by_print, "f0").where("node > rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    linked = fingerprint_links(by_print.withColumnRenamed("f0", "f"))
    return same.unionByName(linked.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))


def one_of_each_group(documents: DataFrame) -> DataFrame:
    """The rows of the smallest (doc_id, sha) of each near-duplicate group, repeated rows once; rows of null ids stay.

    Texts of one id that aren't near-duplicates are documents of their own: each stays, or goes, with its own group.
    """
    spark = documents.sparkSession
    with scratch(spark):
        dropped, repeated = unwanted(near_duplicate_groups(documents))
    packed = documents.select(F.struct(*documents.columns).alias("kept"), F.col("doc_id").cast("long").alias("doc_id"))
    # at most SLOTS numbers go to all tasks; only rows whose id's number is among them are digested and meet the table of what goes
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).alias("slot")
    hit = dropped.select(slot).distinct().withColumn("hit", F.lit(True))
    marked = packed.select("*", slot).join(F.broadcast(hit), "slot", "left")
    digested = marked.where("hit").select("kept", "doc_id", word_digest(F.coalesce("kept.text", F.lit(""))).alias("sha"))
    # an anti join would be moved below the join with hit, and every text would be shuffled for it
    met_ = digested.join(dropped.withColumn("gone", F.lit(True)), ["doc_id", "sha"], "left").where("gone IS NULL")
    out = marked.where("hit IS NULL").select("kept").unionByName(met_.select("kept"))
    if not repeated.isEmpty():
        out = out.unionByName(digested.join(repeated, ["doc_id", "sha"]).dropDuplicates(["doc_id", "sha"]).select("kept"))
    return out.select("kept.*")


def unwanted(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """near_duplicate_groups() rows -> (doc_id, sha) of the rows that don't stay as they are, and of those of them that stay once."""
    once = groups.groupBy("doc_id", "sha").agg(F.count("*").alias("n"), F.min("part").alias("part"))
    kept = save(once.groupBy("part").agg(F.min(F.struct("doc_id", "sha", "n")).alias("x")).select("x.*"), "kept")
    repeated = save(kept.where("n > 1").select("doc_id", "sha"), "repeated", outlive=True)
    dropped = once.select("doc_id", "sha").join(kept, ["doc_id", "sha"], "left_anti").unionByName(repeated)
    return save(dropped, "dropped", outlive=True), repeated


def word_digest(text: Column | str) -> Column:
    """SHA-256 of the lower-cased words, joined by a space."""
    return F.sha2(F.trim(F.regexp_replace(ascii_lower(text), "[ \\t-\\r]+", " ")), 256)


def ascii_lower(column: Column | str) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(column, upper, upper.lower())
