"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

Base spans are the assign, access and hex patterns. The method adds spans of kind `owner`: long mixed tokens outside the
base spans, if only one owner has them. Every candidate's hash is counted over all documents by distinct repositories
and owners; a value that at least WIDE owners have is a widely copied example, a value of a single owner looks live.

Nothing is collected by key: (hash, owner, repository) are made distinct first, then counted with partial sums, so a
secret that a third of all documents hold makes one row for each task; its counts go to the documents, not they to it.
Texts don't move; only spans do. Work in a text is in proportion to its length and spans.

Null texts are empty, a null owner is an owner of its own, repeated rows stay rows (and count as one repository).
An empty table gives no rows. Offsets count code points, ends are exclusive. `doc_id` names the repository unless another column is given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelake.llm.common import save

#: Fixed patterns (assign: letters of the names in either case; its value is group 2), and least lengths of values.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"  # runs of 20 or more; shorter runs hold no match
HEX = "[0-9a-f]{24,}"
TOKEN = "[A-Za-z0-9_-]{24,}"
KINDS = ["assign", "access", "hex", "owner"]
LEAST_VALUE, WIDE = 6, 3
#: Values of a block in running sums; hashes that may be sent to all tasks, and the rows that such a hash has at least.
STRIDE, MOST_HEAVY, LEAST_HEAVY = 128, 1 << 14, 64


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, first: int, combine: Callable[[Column, Column], Column]) -> Column:
    """The values combined from the first up to each, for at least one value. Summed up by blocks of STRIDE, so that the
    work stays in proportion to the values."""
    whole = lambda part: F.aggregate(part, F.lit(first), combine)
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STRIDE).cast("int")), lambda k: F.slice(v, k * STRIDE + 1, STRIDE))
    inside = lambda block, before: F.transform(block, lambda _, i: combine(before, whole(F.slice(block, 1, i + 1))))
    placed = lambda blocks, totals: F.flatten(F.transform(blocks, lambda block, k: bound(whole(F.slice(totals, 1, k)), lambda before: inside(block, before))))
    return bound(values, lambda v: bound(cut(v), lambda blocks: bound(F.transform(blocks, whole), lambda totals: placed(blocks, totals))))


def spans_of(text: Column, pattern: str, kind: int, value_group: int = 0) -> Column:
    """All leftmost matches that don't overlap, as (start, kind, end, value). What a split leaves are the gaps between them."""
    lengths = lambda x: F.transform(x, lambda s: F.char_length(s))
    p = F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    values = F.regexp_extract_all(text, p, F.lit(value_group)) if value_group else found
    parts = F.struct(lengths(F.split(text, pattern, -1)).alias("gaps"), lengths(found).alias("n"), values.alias("value"))

    def place(x: Column) -> Column:
        steps = F.zip_with(F.slice(x["gaps"], 1, F.size(x["n"])), x["n"], lambda gap, n: gap + n)
        ends = running(steps, 0, lambda u, v: u + v)
        own = lambda s: F.struct((s["end"] - s["n"]).alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value"))
        return F.transform(F.arrays_zip(ends.alias("end"), x["n"].alias("n"), x["value"].alias("value")), own)

    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), bound(parts, place)).otherwise(none)


def with_spans(documents: DataFrame, text: str = "text") -> DataFrame:
    """Adds base and extra: the base spans in order, and the long mixed tokens."""
    t = F.coalesce(F.col(text), F.lit(""))
    assign = F.filter(spans_of(t, ASSIGN, 0, 2), lambda s: F.char_length(s["value"]) >= LEAST_VALUE)
    made = documents.withColumn("base", F.array_sort(F.concat(assign, spans_of(t, ACCESS, 1), spans_of(t, HEX, 2))))
    mixed = lambda s: s["value"].rlike("[0-9].*[0-9].*[0-9]") & s["value"].rlike("[A-Za-z].*[A-Za-z].*[A-Za-z]")
    return made.withColumn("extra", F.filter(spans_of(t, TOKEN, 3), mixed))


def apart(spans: DataFrame) -> DataFrame:
    """(row_, s) -> without the tokens that meet a base span: base spans come by start, tokens by end, and what base spans
    before it reach is compared with a token's start."""
    base = F.col("s.kind") < 3
    order = [F.when(base, F.col("s.start")).otherwise(F.col("s.end")), base]
    reach = F.max(F.when(base, F.col("s.end"))).over(Window.partitionBy("row_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("reach", reach).where(base | F.col("reach").isNull() | (F.col("reach") <= F.col("s.start"))).drop("reach")


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, owner, repository) rows -> hash, n_owners, n_repositories (both distinct), n (rows)."""
    once = candidates.groupBy("hash", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repository", F.lit("")).alias("repository")).agg(F.count("*").alias("n"))
    by_owner = once.groupBy("hash", "owner").agg(F.count("*").alias("n_repositories"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n_repositories").alias("n_repositories"), F.sum("n").alias("n"))


def with_owners(each: DataFrame) -> DataFrame:
    """Each candidate with its hash's counts. At most MOST_HEAVY hashes can have that share of all rows: these go to every
    task, so no task gets all rows of a widely copied value; all others meet their counts by hash."""
    owned = save(ownership(each), "ownership")
    total = owned.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = owned.where(F.col("n") * MOST_HEAVY >= F.lit(max(total, LEAST_HEAVY * MOST_HEAVY))).drop("n")
    marked = each.join(F.broadcast(heavy), "hash", "left")
    light = marked.where("n_owners IS NULL").drop("n_owners", "n_repositories").join(owned.drop("n"), "hash")
    return marked.where("n_owners IS NOT NULL").unionByName(light)


def scan(documents: DataFrame, owner: str = "source", repository: str = "doc_id", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """kept (a struct of the columns in keep), base and spans (arrays of start, kind, end, value, n_owners, n_repositories, verdict).

    Verdicts: `example` (WIDE or more owners), `live` (one owner), `shared`. spans: base, and the live extra ones.
    Columns of any name can be kept, as they stay inside the struct.
    """
    named = documents.select(F.struct(*keep).alias("kept"), F.col(owner).cast("string").alias("owner_"), F.col(repository).cast("string").alias("repository_"), "text")
    held = save(with_spans(named.withColumn("row_", F.monotonically_increasing_id())).drop("text"), "spans")
    each = held.where("size(base) + size(extra) > 0").select("row_", F.col("owner_").alias("owner"), F.col("repository_").alias("repository"), F.explode(F.concat("base", "extra")).alias("s"))
    each = save(apart(each).withColumn("hash", F.sha2("s.value", 256)), "candidates")
    verdict = F.when(F.col("n_owners") >= WIDE, "example").when(F.col("n_owners") == 1, "live").otherwise("shared")
    judged = with_owners(each).select("row_", F.struct("s.start", "s.kind", "s.end", "s.value", "n_owners", "n_repositories", verdict.alias("verdict")).alias("s"))
    kept = judged.where("s.kind < 3 OR s.verdict = 'live'").groupBy("row_").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    none = F.array().cast(kept.schema["spans"].dataType)
    has = F.expr("size(base) + size(extra) > 0")
    out = held.where(has).join(kept, "row_", "left").select("kept", F.coalesce("spans", none).alias("spans"))
    out = out.unionByName(held.where(~has).select("kept", none.alias("spans")))
    return out.withColumn("base", F.filter("spans", lambda s: s["kind"] < 3))


def listed(spans: str) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: str, field: str, value: int | str) -> Column:
    return F.size(F.filter(spans, lambda s: s[field] == value)).cast("long")


def secret_report(documents: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans, n_live and n_example (of all spans)."""
    found = scan(documents.withColumn("doc_id", F.col("doc_id").cast("long")))
    counts = [count_of("base", "kind", k).alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("kept.doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"), count_of("spans", "verdict", "live").alias("n_live"), count_of("spans", "verdict", "example").alias("n_example"))


def redact(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns; in texts, spans that aren't widely copied examples are replaced by the mark."""
    found = scan(documents, keep=tuple(documents.columns))
    secret, text = F.filter("spans", lambda s: s["verdict"] != "example"), F.col("kept.text")
    before = lambda own: F.concat(F.array(F.lit(0)), running(F.transform(own, lambda s: s["end"]), 0, lambda u, v: F.greatest(u, v)))

    def cut(own: Column) -> Column:
        return bound(before(own), lambda at: F.concat(F.transform(own, lambda s, i: F.when(s["start"] >= F.get(at, i), F.concat(F.substr(text, F.get(at, i) + 1, s["start"] - F.get(at, i)), F.lit(mark))).otherwise("")), F.array(F.substr(text, F.element_at(at, -1) + 1))))

    new = F.when(F.size(secret) > 0, F.array_join(bound(secret, cut), "")).otherwise(text)
    return found.select(*(new.alias("text") if c == "text" else F.col("kept").getField(c).alias(c) for c in documents.columns))
