"""How five quality filters interact: what each removes at each place of each order, what it alone removes, and what is lost.

The filters' failures are flags of a document: A too few words, B too few distinct words, C too many capitals, D a symbol,
E a copy of a document of a smaller id. Documents are counted by part and flags first, with partial sums: at most 32 rows
for each part go on. SQL's CUBE over the five flags and the part then gives every grouping set; in a set's row with all
its grouped flags false stands how many documents survive that subset of filters. A step of an order is a pair of subsets,
with and without its filter, and its counts are the difference of two survivors; Shapley sums weigh the 80 pairs.

Flags come from whole texts and only they travel, with a digest of the text. A document is the first of its copies if its
digest and id are among the (digest, least id) pairs: a join of both columns, so that copies of one text, however many,
spread over all tasks, and nothing is collected by text.

Null texts are empty (and copies of each other), a null part is the empty string. A document of a null id is never a copy
of a smaller one, nor has it labels. Repeated rows are documents of their own, each first if its id is its text's
smallest. Labels of one id are good or toxic if any of its rows is. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.llm.common import save

FILTERS = "ABCDE"
#: Least words, least share of distinct words and most share of capitals in hundredths, and the symbols (fixed values).
LEAST_WORDS, DISTINCT_SHARE, CAPITAL_SHARE, SYMBOLS = 50, 65, 5, r"[#$%&*|]"
WORD, CAPITALS = r"[^\x20\x09-\x0D]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ["n", "good", "toxic"]


def text_flags(text: Column) -> dict[str, Column]:
    """The failures that a text alone decides."""
    capitals = F.char_length(text) - F.char_length(F.translate(text, CAPITALS, ""))
    return {
        "A": F.size("words") < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct("words")) < DISTINCT_SHARE * F.size("words"),
        "C": 100 * capitals.cast("long") > CAPITAL_SHARE * F.char_length(text).cast("long"),
        "D": text.rlike(SYMBOLS),
    }


def flagged(documents: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, A to E (failures), good, toxic and n: how many documents have them. One row for documents that agree in all and
    in id and text."""
    named = documents.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    read = named.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    narrow = read.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *(c.alias(k) for k, c in text_flags(F.col("text")).items()))
    once = save(narrow.groupBy(*narrow.columns).agg(F.count("*").alias("n")), "flags")
    firsts = once.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    judged = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*((F.max(F.coalesce(F.col(c) == 1, F.lit(False)))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    known = once.where("doc_id IS NOT NULL").join(firsts, ["digest", "doc_id"], "left").join(judged, "doc_id", "left")
    known = known.withColumn("E", F.col("first").isNull()).select(*once.columns, "E", "good", "toxic")
    rest = once.where("doc_id IS NULL").withColumns({"E": F.lit(False), "good": F.lit(False), "toxic": F.lit(False)})
    yes = lambda c: F.coalesce(c, F.lit(False))
    return known.unionByName(rest).select("part", *FILTERS, yes(F.col("good")).alias("good"), yes(F.col("toxic")).alias("toxic"), "n")


def tallied(flags: DataFrame) -> DataFrame:
    """part, A to E, and how many documents, good and toxic ones, fail just these. Each part has a row that fails none,
    be it of no documents, so that the cube has all its subsets."""
    sums = [F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")]
    made = save(flags.groupBy("part", *FILTERS).agg(*sums), "tally")
    none = made.select("part").distinct().select("part", *(F.lit(False).alias(k) for k in FILTERS), *(F.lit(0).cast("long").alias(c) for c in COUNTS))
    return made.unionByName(none)


def survivors(tally: DataFrame) -> DataFrame:
    """part (null: all parts), subset (a bit for each filter, A the lowest), n, good, toxic: what passes all filters of the
    subset. These are the cube's rows whose grouped flags are all false."""
    total = [F.sum(c).alias(c) for c in COUNTS]
    grouped = {k: F.grouping(k) == 0 for k in FILTERS}
    subset = sum((F.when(own, 1 << i).otherwise(0) for i, (k, own) in enumerate(grouped.items())), F.lit(0))
    failed = F.greatest(*(F.coalesce(F.col(k), F.lit(False)) for k in FILTERS))
    cube = tally.cube(*FILTERS, "part").agg(*total, subset.alias("subset"), (F.grouping("part") == 1).alias("all_parts"))
    return cube.where(~failed).select("part", "all_parts", "subset", *COUNTS)


def pairs_of(spark: SparkSession) -> DataFrame:
    """letter, before, after (subsets without and with it), weight: how many of all orders apply it right after the subset."""
    n = len(FILTERS)
    rows = [(k, s, s | 1 << i, factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())) for i, k in enumerate(FILTERS) for s in range(1 << n) if not s >> i & 1]
    return spark.createDataFrame(rows, "letter string, before int, after int, weight long")


def orders(spark: SparkSession) -> DataFrame:
    """filter_order, step, letter, before: the 600 steps of all orders."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for step, k in enumerate(order, 1):
            rows.append(("".join(order), step, k, before))
            before |= 1 << FILTERS.index(k)
    return spark.createDataFrame(rows, "filter_order string, step int, letter string, before int")


def audit(documents: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """A row for each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark = documents.sparkSession
    alive = save(survivors(tallied(flagged(documents, labels, part))).where("NOT all_parts").drop("all_parts"), "survivors")
    with_, without = alive.withColumnsRenamed({"subset": "after", "n": "kept", "good": "good_kept", "toxic": "toxic_kept"}), alive.withColumnRenamed("subset", "before")
    gone = F.broadcast(pairs_of(spark)).join(without, "before").join(with_, ["part", "after"])
    gone = save(gone.select("part", "letter", "before", "weight", "kept", (F.col("n") - F.col("kept")).alias("removed"), (F.col("good") - F.col("good_kept")).alias("good_lost"), (F.col("toxic") - F.col("toxic_kept")).alias("toxic_lost")), "steps")
    alone = F.bit_count("before") == len(FILTERS) - 1
    whole = gone.groupBy("part", "letter").agg(F.sum(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"), F.sum(F.when(alone, F.col("removed"))).alias("unique_fails"), F.sum(F.col("weight") * F.col("removed")).alias("shapley"))
    made = gone.join(whole, ["part", "letter"]).join(F.broadcast(orders(spark)), ["letter", "before"])
    return made.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
