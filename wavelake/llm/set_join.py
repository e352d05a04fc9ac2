"""Groups of similar shingle sets, exactly: every link of that Jaccard similarity counts, none is left to chance.

A set that shares too few of its shingles with any other text can't be similar to one. All shingles are counted over the
whole corpus (runs of texts send their distinct keys, sorted and delta-coded, to ranges of keys, and get classes of
frequency back), and only texts with enough shared shingles go on. They meet as in a prefix-filtered join: two similar
sets share one of the rarest shingles of either, of which each lists just so many that this must hold.

Lists aren't expanded into pairs. First each text meets one centre, then those of its lists' centres that it isn't linked
to; a list's centre is the member whose shingles are the commonest, so that a family of copies is linked through the
text that it came from. That is linear in the lists, and lists whose members are one component by then are done. In what
is left, members meet across components, if sizes, shared shingles and the tables of distances to REFERENCES reference
sets (which bound the symmetric difference from below) all allow the similarity. Each pair that meets is verified by its
sets. The last step is quadratic only in members of one list that are near the threshold and yet unlinked.
"""

from __future__ import annotations

import hashlib
import io
import math
import secrets

import numpy as np
import pyarrow as pa
import pyarrow.ipc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from wavelake.llm.common import bounded, save, texts
from wavelake.llm.components import connected_components
from wavelake.llm.prints import fingerprints_of, shingle_hashes

#: Bytes of text in a run, keys in a range of keys, disjoint reference sets (by a shingle's lowest bits).
RUN_BYTES, RANGE_KEYS, REFERENCES = 6 << 20, 1 << 20, 64
RUN = pa.schema([("run", pa.int64()), ("texts", pa.binary()), ("shas", pa.list_(pa.string())), ("n", pa.int64())])
#: Up to this many texts with a shingle, each number has a class of its own.
EXACT = 11
TEXTS = pa.schema([("sha", pa.string()), ("words", pa.binary())])
CANDIDATE = pa.schema([("sha", pa.string()), ("f0", pa.int64()), ("n", pa.int32()), ("own", pa.int32()), ("common", pa.float32()), ("prefix", pa.list_(pa.int64())), ("table", pa.list_(pa.int32())), ("hashes", pa.binary())])


def shingle_set(text: bytes, size: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, size), np.uint64))


# ---------------------------------------------------------------- frequencies


@bounded
def packed_runs(documents: DataFrame) -> DataFrame:
    """(text) -> run, texts (packed, each word sequence of the run once, with its digest), shas (the digests), n (words)."""

    def pack(batches):
        seen: dict[str, bytes] = {}
        size = 0
        for batch in batches:
            for text in texts(batch):
                words = b" ".join(text.lower().split())
                if seen and size + len(words) > RUN_BYTES:
                    yield packed(seen)
                    seen, size = {}, 0
                sha = hashlib.sha256(words).hexdigest()
                if words and sha not in seen:
                    seen[sha] = words
                    size += len(words)
        if seen:
            yield packed(seen)

    def packed(seen: dict[str, bytes]) -> pa.RecordBatch:
        out = io.BytesIO()
        with pa.ipc.new_stream(out, TEXTS, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as sink:
            sink.write_batch(pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.binary())], schema=TEXTS))
        return pa.RecordBatch.from_arrays([pa.array([secrets.randbits(62)]), pa.array([out.getvalue()]), pa.array([list(seen)], pa.list_(pa.string())), pa.array([sum(x.count(b" ") + 1 for x in seen.values())])], schema=RUN)

    return documents.select("text").mapInArrow(pack, "run bigint, texts binary, shas array<string>, n bigint")


def unpacked(packed: bytes, size: int) -> tuple[list[str], list[np.ndarray]]:
    """The digests of a run's texts, and their shingle sets."""
    table = pa.ipc.open_stream(packed).read_all()
    return table.column("sha").to_pylist(), [shingle_set(x, size) for x in table.column("words").to_pylist()]


def squeezed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte plane by byte plane."""
    planes = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def expanded(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(planes.T.copy().view(np.uint64)[:, 0], dtype=np.uint64)


def run_keys(sets: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys (first bits of the shingles) of a run, sorted, and in how many of its texts each stands."""
    return np.unique(np.concatenate(sets) >> np.uint64(64 - bits), return_counts=True)


def frequency_classes(runs: DataFrame, size: int, bits: int, ranges: int) -> DataFrame:
    """run, part, classes (a byte for each of the run's keys in that range of keys): 0 for keys that one text has, else the
    more, the more texts have them. A run sends each key once, so a shingle that all texts have makes a row's byte a run."""

    def send(batches):
        for batch in batches:
            for run, packed in zip(batch.column("run").to_pylist(), batch.column("texts"), strict=True):
                keys, counts = run_keys(unpacked(packed.as_buffer(), size)[1], bits)
                edges = np.searchsorted(keys, np.array([(k << bits) // ranges for k in range(1, ranges)], np.uint64))
                rows = [(k, x, c) for k, (x, c) in enumerate(zip(np.split(keys, edges), np.split(counts, edges), strict=True)) if len(x)]
                zipped = [pa.compress(np.minimum(c, 255).astype(np.uint8).tobytes(), "zstd", asbytes=True) for _, _, c in rows]
                yield pa.RecordBatch.from_arrays([pa.array([run] * len(rows)), pa.array([k for k, _, _ in rows], pa.int32()), pa.array([len(x) for _, x, _ in rows], pa.int64()), pa.array([squeezed(x) for _, x, _ in rows]), pa.array(zipped)], ["run", "part", "n", "keys", "counts"])

    def count(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_pylist()
        keys = np.concatenate([expanded(k, n) for k, n in zip(table.column("keys").to_pylist(), sizes, strict=True)])
        counts = np.concatenate([np.frombuffer(pa.decompress(c, n, "zstd", asbytes=True), np.uint8) for c, n in zip(table.column("counts").to_pylist(), sizes, strict=True)])
        _, at = np.unique(keys, return_inverse=True)
        classes = class_of(np.bincount(at, counts))[at]
        zipped = [pa.compress(x.tobytes(), "zstd", asbytes=True) for x in np.split(classes, np.cumsum(sizes)[:-1])]
        return pa.table({"run": table.column("run"), "part": table.column("part"), "n": table.column("n"), "classes": pa.array(zipped)})

    sent = runs.select("run", "texts").mapInArrow(send, "run bigint, part int, n bigint, keys binary, counts binary")
    return sent.groupBy("part").applyInArrow(count, "run bigint, part int, n bigint, classes binary")


def copies(runs: DataFrame) -> DataFrame:
    """run, copies (sha, m, first) of its texts that m runs have, m > 1; first: whether this is the first of them."""
    held = runs.select("run", F.explode("shas").alias("sha"))
    often = held.groupBy("sha").agg(F.count("*").cast("int").alias("m"), F.min("run").alias("least")).where("m > 1")
    own = held.join(often, "sha").select("run", F.struct("sha", "m", (F.col("run") == F.col("least")).alias("first")).alias("c"))
    return own.groupBy("run").agg(F.collect_list("c").alias("copies"))


def class_of(count: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.ceil(8 * np.log2(count))).astype(np.uint8)


def least_shared(n: int, similarity: float) -> int:
    """How many shingles a set of n must share with a set of that similarity."""
    return math.ceil(similarity * n - 1e-9)


def candidates(documents: DataFrame, size: int, similarity: float) -> DataFrame:
    """(text) -> the sets that may have a similar one: sha, f0 (SimHash of the set), n, own (shingles that no other text
    has), common (the mean class of its shingles), prefix (the rarest of the others, as many as a similar set must meet one of), table (distances to the reference
    sets: shingles by class), hashes. Each text comes once."""
    runs = save(packed_runs(documents), "runs")
    total = max(1, runs.agg(F.sum("n")).first()[0] or 0)
    bits, ranges = min(60, max(16, total.bit_length() + 8)), -(-total // RANGE_KEYS)  # a key stands for two shingles in 256 at most
    classes = frequency_classes(runs, size, bits, ranges).unionByName(copies(runs), allowMissingColumns=True)

    def pick(own: pa.Table, replies: pa.Table) -> pa.Table:
        repeated = {c["sha"]: c for x in replies.column("copies").to_pylist() for c in x or ()}
        replies = replies.filter(replies.column("part").is_valid())
        order = np.argsort(replies.column("part").to_numpy())
        parts = zip(replies.column("classes").to_pylist(), replies.column("n").to_pylist(), strict=True)
        kinds = [np.frombuffer(pa.decompress(c, n, "zstd", asbytes=True), np.uint8) for c, n in parts]
        kinds = np.concatenate([kinds[i] for i in order])
        shas, sets = unpacked(own.column("texts")[0].as_buffer(), size)
        keys, _ = run_keys(sets, bits)
        rows = []
        for sha, x in zip(shas, sets, strict=True):
            kind = kinds[np.searchsorted(keys, x >> np.uint64(64 - bits))]
            # a text that m runs have was counted m times: what is counted just as often is its own
            m, first = (repeated[sha]["m"], repeated[sha]["first"]) if sha in repeated else (1, True)
            if not first:
                continue
            alone, most = int(np.count_nonzero(kind == class_of(np.array([m])))) if m <= EXACT else 0, len(x) - least_shared(len(x), similarity)
            if alone <= most:
                rarest = x[np.lexsort((x, kind))][alone : most + 1]
                rows.append((sha, len(x), alone, kind.mean(), rarest.view(np.int64), np.bincount((x & np.uint64(REFERENCES - 1)).astype(np.int64), minlength=REFERENCES), x))
        shas, *rest, own_sets = list(zip(*rows, strict=True)) or [()] * 7
        prints = fingerprints_of(own_sets).view(np.int64)[:, 0].tolist() if rows else []
        columns = (shas, prints, *rest, [x.tobytes() for x in own_sets])
        return pa.table([pa.array(x, f.type) for x, f in zip(columns, CANDIDATE, strict=True)], schema=CANDIDATE)

    return runs.select("run", "texts").groupBy("run").cogroup(classes.groupBy("run")).applyInArrow(pick, from_arrow_schema(CANDIDATE))


# ---------------------------------------------------------------- pairs


def sizes_allow(n: Column, own: Column, m: Column, alone: Column, similarity: float) -> Column:
    """Sets of n and m shingles, own and alone of them in no other text, can share enough."""
    need = (n + m) * (similarity / (1 + similarity)) - 1e-6
    return (n >= m * similarity - 1e-6) & (m >= n * similarity - 1e-6) & (n - own >= need) & (m - alone >= need)


def tables_allow(n: Column, table: Column, m: Column, other: Column, similarity: float) -> Column:
    """The reference sets are disjoint, so the differences of distances add up to no more than the symmetric difference."""
    apart = F.aggregate(F.zip_with(table, other, lambda a, b: F.abs(a - b)), F.lit(0), lambda s, x: s + x)
    return apart <= (n + m) * ((1 - similarity) / (1 + similarity)) + 1e-6


def central_lists(sets: DataFrame) -> DataFrame:
    """key, node, n, own, c (node, n and own of the list's centre): members of the lists that more than one text has."""
    lists = sets.select("node", "n", "own", "common", F.explode("prefix").alias("key"))
    centre = F.min(F.struct((-F.col("common")).alias("rare"), "node", "n", "own")).alias("c")
    met = lists.groupBy("key").agg(F.count("*").alias("members"), centre).where("members > 1").drop("members")
    return save(lists.join(met, "key").drop("common"), "lists")


def first_pairs(shared: DataFrame) -> DataFrame:
    """Each node with one centre: the commonest of its lists'."""
    best = shared.where(F.col("node") != F.col("c.node")).groupBy("node").agg(F.min("c").alias("c"))
    return best.select(F.greatest("node", "c.node").alias("a"), F.least("node", "c.node").alias("b")).distinct()


def central_pairs(shared: DataFrame, parts: DataFrame, similarity: float) -> DataFrame:
    """Each member with its list's centre, where these aren't linked yet and may be similar."""
    able = sizes_allow(F.col("n"), F.col("own"), F.col("c.n"), F.col("c.own"), similarity)
    pairs = shared.where(able).select(F.greatest("node", "c.node").alias("a"), F.least("node", "c.node").alias("b")).where("a > b").distinct()
    part = lambda x: parts.select(F.col("node_").alias(x), F.col("component").alias(f"part_{x}"))
    both = pairs.join(part("a"), "a", "left").join(part("b"), "b", "left")
    return both.where(F.coalesce("part_a", "a") != F.coalesce("part_b", "b")).select("a", "b")


def remaining_pairs(shared: DataFrame, sets: DataFrame, parts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of a list's members in different components that sizes and tables allow to be similar, each in the first
    list that both are in. Members outside the list's largest component meet all; those inside needn't meet each other."""
    held = shared.join(parts, shared.node == parts.node_, "left").select("key", "node", "n", "own", F.coalesce("component", "node").alias("part"))
    by_part = held.groupBy("key", "part").agg(F.count("*").alias("m"), F.min("n").alias("least"))
    open_ = by_part.groupBy("key").agg(F.count("*").alias("parts"), F.min("least").alias("least"), F.max(F.struct("m", "part"))["part"].alias("main")).where("parts > 1")
    need = (F.col("n") + F.greatest(F.col("least"), F.col("n") * similarity)) * (similarity / (1 + similarity)) - 1e-6
    able = save(held.join(open_, "key").where(F.col("n") - F.col("own") >= need).select("key", "node", "n", "own", "part", "main"), "open")
    outside = able.where("part <> main").join(sets.select("node", "prefix", "table"), "node")
    every = able.join(able.where("part <> main").select("key").distinct(), "key", "left_semi").join(sets.select("node", "prefix", "table"), "node")
    every = every.select("key", *(F.col(c).alias(f"{c}_") for c in ("node", "n", "own", "part", "prefix", "table")))
    apart = (F.col("part") != F.col("part_")) & ((F.col("part_") == F.col("main")) | (F.col("node") > F.col("node_")))
    near = sizes_allow(F.col("n"), F.col("own"), F.col("n_"), F.col("own_"), similarity) & tables_allow(F.col("n"), F.col("table"), F.col("n_"), F.col("table_"), similarity)
    once = F.get(F.array_intersect("prefix", "prefix_"), F.lit(0)) == F.col("key")
    return outside.join(every, "key").where(apart & near & once).select(F.greatest("node", "node_").alias("a"), F.least("node", "node_").alias("b"))


@bounded
def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the pairs whose shingle sets have at least that Jaccard similarity."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")

    def compare(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint64) for c in ("x", "y"))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[k] = common >= similarity * (len(x) + len(y) - common) - 1e-9
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint")


def similar_components(sets: DataFrame, first: DataFrame, similarity: float) -> DataFrame:
    """(node, n, own, prefix, table, hashes), and pairs (a, b) to begin with -> (node_, component) over links of that similarity."""
    shared = central_lists(sets)
    links = save(verified(first_pairs(shared).unionByName(first).distinct(), sets, similarity), "links")
    for pairs in (lambda parts: central_pairs(shared, parts, similarity), lambda parts: remaining_pairs(shared, sets, parts, similarity)):
        parts = connected_components(links).withColumnRenamed("node", "node_")
        links = links.unionByName(save(verified(pairs(parts), sets, similarity), "links"))
    return connected_components(links).withColumnRenamed("node", "node_")
