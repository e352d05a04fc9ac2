"""Approximate nearest neighbours by cosine: an NN-descent graph, searched greedily.

Equal vectors are one node of the graph. The first graph comes from brute force within the buckets of CODES random codes
(which of some random orthogonal directions lies nearest, on which side). Each round then joins, for every node, its
neighbours with all its reverse neighbours (a hub's in chunks, each with the whole list of neighbours, so that a hub's long
list is never one group's work; dealt anew in each round): any two of them, of which a link is new, that are nearer to each
other than a present neighbour replace it. The graph holds every row; rounds end when the mean similarity of neighbours
rises by less than GAIN.

A query walks the undirected graph: from its own node and a few entry nodes, the best unexpanded candidates are expanded
again and again until all of its pool are expanded. Entries are nodes of other queries, dealt so that each serves few
queries. Nodes lie in shards of some thousand rows at most, each a row with their vectors and one with their lists; a hop
sends each query's ids to the shards that have them, for lists and then for scores, and none is a hot key. Recall is
measured on up to PROBES queries against all rows; while it is below TARGET, the pool is doubled and the walk goes on from
what it has, up to a pool of all nodes. With exact=True every query is compared with all rows, block by block, instead.
The graph is built on 16-bit floats and walked on 32-bit ones; scores are cosines of the original vectors in double
precision, of all that may be among the nearest.

Vectors that are null, zero, or hold null or non-finite components take no part; shorter ones count as if zeros followed.
Fewer candidates than k: all of them. Ties go to the smaller id. Null ids take no part; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import count, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelake.llm.common import remove, save

#: A bucket has BUCKET rows, or a SHARE-th of a small table, but SMALL at least.
NEIGHBOURS, BUCKET, SMALL, SHARE, CODES, GAIN, CHUNK = 20, 2048, 160, 16, 8, 1e-3, 256
POOL, BEAM, ENTRIES = 400, 160, 16
#: Queries whose recall is measured and what it must reach; rows of a block of queries and of one of candidates.
PROBES, TARGET, QUERY_BLOCK, NODE_BLOCK = 128, 0.92, 1024, 8192
#: Nodes and queries that are worth a task of their own, where a small table's partitions are read by fewer tasks than there are.
TASK_NODES, TASK_QUERIES = 2048, 128
#: Bytes of a shard's vectors; scores of 32-bit floats that are nearer than CLOSE are compared in double precision.
SHARD_BYTES, CLOSE = 2 << 20, 1e-5


def best_of(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """Each key's first n rows; Spark keeps only n rows of a key in each task before it shuffles."""
    return rows.withColumn("r_", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("r_") <= n).drop("r_")


def in_tasks(rows: DataFrame, n: int) -> DataFrame:
    """The partitions of rows, read one after another by n tasks, or one for each core: a key's rows stay together."""
    return rows.coalesce(max(n, rows.sparkSession.sparkContext.defaultParallelism))


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>), norm."""
    plain = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    kept = plain.where("vec_id IS NOT NULL AND v IS NOT NULL").where(finite).withColumn("norm", norm).where("norm > 0")
    return kept


def units(column: pa.Array, length: int) -> np.ndarray:
    """Unit vectors of a column of arrays."""
    x = column.flatten().to_numpy().reshape(-1, length)
    return x / np.linalg.norm(x, axis=1)[:, None]


def binaries(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in x], pa.binary())


def matrix(column: pa.Array, length: int, kind: type = np.float16) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, length).astype(np.float32, copy=False)


def lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A column of arrays that follow each other in values."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(values))


def whole_groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The rows, which stand in order of keys, as tables that cut no group, and where in each its groups end."""
    kept: pa.Table | None = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        table = new if kept is None else pa.concat_tables([kept, new])
        edges = np.flatnonzero(np.any([np.diff(table.column(k).to_numpy()) != 0 for k in keys], axis=0)) + 1
        kept = table.slice(int(edges[-1]) if len(edges) else 0)
        if len(edges):
            yield table.slice(0, int(edges[-1])).combine_chunks(), edges
    if kept is not None and kept.num_rows:
        yield kept.combine_chunks(), np.array([kept.num_rows])


def described(nodes: DataFrame, length: int, buckets: float) -> DataFrame:
    """id, h (the unit vector as 16-bit floats: what travels while the graph is built), codes (CODES codes, of about so many
    values each: products of 2 x `wide` ones)."""
    turns = max(1, math.ceil(math.log(max(2.0, buckets)) / math.log(2 * length)))
    wide = min(length, max(1, round(max(2.0, buckets) ** (1 / turns) / 2)))

    def make(batches):
        rng = np.random.default_rng(9)
        bases = [[np.linalg.qr(rng.standard_normal((length, wide)))[0] for _ in range(turns)] for _ in range(CODES)]
        for batch in batches:
            if not batch.num_rows:
                continue
            h = units(batch.column("v"), length).astype(np.float16)
            x, codes = h.astype(np.float32), np.zeros((len(h), CODES), np.int64)
            for t, turned in enumerate(bases):
                for base in turned:
                    y = x @ base
                    at = np.abs(y).argmax(axis=1)
                    codes[:, t] = codes[:, t] * (2 * wide) + 2 * at + (y[np.arange(len(y)), at] > 0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), binaries(h), lists(codes.ravel(), np.full(len(h), CODES))], ["id", "h", "codes"])

    return nodes.select("id", "v").mapInArrow(make, "id bigint, h binary, codes array<bigint>")


def first_graph(points: DataFrame, length: int, size: int, tasks: int) -> DataFrame:
    """id, nb, sim, fresh: the nearest within buckets; a bucket far above size rows is dealt to several by a hash."""
    coded = points.select("id", "h", F.posexplode("codes").alias("t", "code"))
    sizes = coded.groupBy("t", "code").agg(F.ceil(F.count("*") / (2 * size)).alias("parts"))
    dealt = coded.join(sizes, ["t", "code"]).withColumn("part", F.pmod(F.xxhash64("id", "t"), F.col("parts")))
    neighbours = NEIGHBOURS

    def nearest(table: pa.Table) -> pa.Table:
        ids, x = table.column("id").to_numpy(), matrix(table.column("h"), length)
        k, nbs, sims = min(neighbours, len(ids) - 1), [], []
        for a in range(0, len(ids) if k > 0 else 0, 256):
            far = -(x[a : a + 256] @ x.T)
            far[np.arange(len(far)), np.arange(a, a + len(far))] = 2
            at = np.argpartition(far, k - 1, axis=1)[:, :k]
            nbs.append(ids[at].ravel())
            sims.append(-np.take_along_axis(far, at, 1).ravel())
        lengths = np.full(len(ids), max(k, 0))
        return pa.table({"id": ids, "nbs": lists(np.concatenate([*nbs, ids[:0]]), lengths), "sims": lists(np.concatenate([*sims, x[:0, 0]]), lengths)})

    def best(batches):
        for table, _ in whole_groups(batches, "id"):
            nbs = table.column("nbs").combine_chunks()
            id_, nb = np.repeat(table.column("id").to_numpy(), nbs.value_lengths().to_numpy()), nbs.flatten().to_numpy()
            sim = table.column("sims").combine_chunks().flatten().to_numpy()
            order = np.lexsort((-sim, nb, id_))
            id_, nb, sim = id_[order], nb[order], sim[order]
            once = np.r_[True, (np.diff(id_) != 0) | (np.diff(nb) != 0)][: len(id_)]
            id_, nb, sim = id_[once], nb[once], sim[once]
            order = np.lexsort((nb, -sim, id_))
            id_, nb, sim = id_[order], nb[order], sim[order]
            keep = ranks(id_) < neighbours
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (id_, nb, sim)], ["id", "nb", "sim"])

    found = dealt.groupBy("t", "code", "part").applyInArrow(nearest, "id bigint, nbs array<bigint>, sims array<float>")
    once = in_tasks(found.repartition("id").sortWithinPartitions("id"), tasks).mapInArrow(best, "id bigint, nb bigint, sim float")
    return once.withColumn("fresh", F.lit(True))


def ranks(keys: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of equal keys."""
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return np.arange(len(keys)) - np.repeat(start, np.diff(np.r_[start, len(keys)]))


def trimmed(links: DataFrame) -> DataFrame:
    """Each node's NEIGHBOURS most similar, once each; fresh if no present link says otherwise."""
    once = links.groupBy("id", "nb").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    return best_of(once, "id", [F.desc("sim"), "nb"], NEIGHBOURS)


def local_join(graph: DataFrame, points: DataFrame, length: int, turn: int = 0, tasks: int = 1) -> DataFrame:
    """Pairs of neighbours of a common node that are nearer than one's last neighbour: id, nb, sim. Two whose links are both
    not fresh have met before. A hub's reverse neighbours are dealt to chunks anew in each turn."""
    links = graph if "fresh" in graph.columns else graph.withColumn("fresh", F.lit(True))
    last = graph.groupBy("id").agg(F.when(F.count("*") >= NEIGHBOURS, F.min("sim")).otherwise(-2.0).cast("float").alias("last"))
    own = points.select(F.col("id").alias("u"), "h").join(last.withColumnRenamed("id", "u"), "u")
    hubs = graph.groupBy(F.col("nb").alias("at")).agg(F.floor((F.count("*") - 1) / CHUNK).cast("int").alias("most")).where("most > 0")
    ahead = links.select(F.col("id").alias("at"), F.col("nb").alias("u"), "fresh", F.lit(False).alias("back"))
    back = links.select(F.col("nb").alias("at"), F.col("id").alias("u"), "fresh", F.lit(True).alias("back"))
    both = ahead.unionByName(back).groupBy("at", "u").agg(F.max("fresh").alias("fresh"), F.min("back").alias("back"))
    dealt = F.array(F.pmod(F.xxhash64(F.lit(turn), "u", "at"), F.col("most") + 1).cast("int"))
    chunks = F.when(F.col("most").isNull(), F.array(F.lit(0))).when(F.col("back"), dealt).otherwise(F.sequence(F.lit(0), "most"))
    around = both.join(hubs, "at", "left").select("at", "u", "fresh", F.explode(chunks).alias("chunk")).join(own, "u")
    sorted_ = around.select("at", "chunk", "u", "fresh", "h", "last").repartition("at", "chunk").sortWithinPartitions("at", "chunk")

    def pairs(batches):
        for table, ends in whole_groups(batches, "at", "chunk"):
            yield joined(table, ends)

    def joined(table: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
        u, last_, x = table.column("u").to_numpy(), table.column("last").to_numpy(), matrix(table.column("h"), length)
        fresh = np.array(table.column("fresh").to_pylist(), bool)
        ids, nbs, sims = [u[:0]], [u[:0]], [last_[:0]]
        start = 0
        for end in ends.tolist():
            part = slice(start, end)
            start = end
            new = fresh[part]
            if not new.any():
                continue
            sim = x[part] @ x[part].T
            near = sim > last_[part][:, None]
            if not new.all():
                near &= new[:, None] | new
            i, j = np.nonzero(near)
            keep = i != j
            i, j = i[keep], j[keep]
            ids.append(u[part][i])
            nbs.append(u[part][j])
            sims.append(sim[i, j])
        a, b, s = np.concatenate(ids), np.concatenate(nbs), np.concatenate(sims)
        _, first = np.unique(a.astype(np.int64) * 0x9E3779B1 ^ b, return_index=True)  # repeated pairs of the batch; a clash only delays one
        return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(s[first].astype(np.float32))], ["id", "nb", "sim"])

    return in_tasks(sorted_, tasks).mapInArrow(pairs, "id bigint, nb bigint, sim float")


def build_graph(nodes: DataFrame) -> DataFrame:
    """(id, v), vectors distinct -> id, nb, sim."""
    n, length = nodes.agg(F.count("*"), F.first(F.size("v"))).first()
    if not n:
        return nodes.select("id", F.col("id").alias("nb"), F.lit(0.0).cast("float").alias("sim")).limit(0)
    size = min(BUCKET, max(SMALL, n // SHARE))
    points = save(described(nodes, length, n / size), "points")
    graph, before = save(first_graph(points, length, size, n // TASK_NODES), "graph"), -2.0
    for turn in count():  # a round loses no neighbour but for a nearer one, so the mean rises to a bound
        found = local_join(graph, points, length, turn, n // TASK_NODES).withColumn("fresh", F.lit(True))
        graph = renewed(graph, trimmed(graph.withColumn("fresh", F.lit(False)).unionByName(found)), "graph")
        now = graph.agg(F.avg("sim")).first()[0]
        if now is None or now - before < GAIN:
            return graph.drop("fresh")
        before = now


def renewed(old: DataFrame, new: DataFrame, label: str) -> DataFrame:
    """new, saved; the saved table old, which it came from, goes."""
    made = save(new, label)
    for path in {f.rsplit("/", 1)[0] for f in old.inputFiles()}:
        remove(old.sparkSession, path)
    return made


def cosine(a: Column, b: Column, norms: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / norms


def entries_of(asked: DataFrame, n: int) -> DataFrame:
    """q, c: each of the n query nodes itself and ENTRIES other query nodes. Query nodes stand in rings of about 8 ENTRIES by
    a hash, and those that follow one in its ring are its entries, so each is an entry of ENTRIES queries at most."""
    rings = max(1, n // (8 * ENTRIES))
    ring = Window.partitionBy("ring").orderBy("h")
    dealt = asked.select("q", F.xxhash64("q").alias("h"), F.pmod(F.xxhash64("q", F.lit(1)), F.lit(rings)).alias("ring"))
    placed = dealt.withColumn("at", F.row_number().over(ring)).withColumn("of", F.count("*").over(Window.partitionBy("ring")))
    steps = placed.select("q", "ring", F.explode(F.sequence(F.lit(0), F.least(F.lit(ENTRIES), F.col("of") - 1))).alias("step"), "at", "of")
    others = placed.select("ring", (F.col("at") - 1).alias("to"), F.col("q").alias("c"))
    return steps.withColumn("to", (F.col("at") - 1 + F.col("step")) % F.col("of")).join(others, ["ring", "to"]).select("q", "c")


def sharded(nodes: DataFrame, graph: DataFrame, n: int, length: int) -> tuple[DataFrame, DataFrame, int]:
    """Two tables of shards, and how many there are: vectors (shard, ids in order, x: their unit vectors) and lists (shard,
    ids, ends, nbs: whom the undirected graph links to each). A node's shard is its id modulo that number, a prime."""
    shards = max(1, min(64, n // 64), -(-n * 4 * length // SHARD_BYTES))
    while any(shards % d == 0 for d in range(2, math.isqrt(shards) + 1)):
        shards += 1
    both = graph.select("id", "nb").unionByName(graph.select(F.col("nb").alias("id"), F.col("id").alias("nb"))).distinct()
    around = both.groupBy("id").agg(F.collect_list("nb").alias("nbs"))

    def pack_vectors(batches):
        for table, ends in whole_groups(batches, "shard"):
            x = units(table.column("v").combine_chunks(), length).astype(np.float32)
            for a, b in pairwise([0, *ends.tolist()]):
                rows = [table.column("shard")[a].as_py()], [table.column("id").slice(a, b - a).to_pylist()], [x[a:b].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, (pa.int64(), pa.list_(pa.int64()), pa.binary()), strict=True)], ["shard", "ids", "x"])

    def pack_lists(batches):
        for table, ends in whole_groups(batches, "shard"):
            for a, b in pairwise([0, *ends.tolist()]):
                nbs = table.column("nbs").slice(a, b - a).combine_chunks()
                columns = [[table.column("shard")[a].as_py()], [table.column("id").slice(a, b - a).to_pylist()], [np.cumsum(nbs.value_lengths().to_numpy()).tolist()]]
                kinds = pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                flat = nbs.flatten()
                yield pa.RecordBatch.from_arrays([*arrays, lists(flat.to_numpy(), np.array([len(flat)]))], ["shard", "ids", "ends", "nbs"])

    def of_shards(rows: DataFrame) -> DataFrame:
        return in_tasks(rows.withColumn("shard", F.pmod("id", F.lit(shards))).repartition("shard").sortWithinPartitions("shard", "id"), n // TASK_NODES)

    vectors = of_shards(nodes.select("id", "v")).mapInArrow(pack_vectors, "shard bigint, ids array<bigint>, x binary")
    linked = of_shards(around).mapInArrow(pack_lists, "shard bigint, ids array<bigint>, ends array<bigint>, nbs array<bigint>")
    return save(vectors, "vectors"), save(linked, "lists"), shards


def served(asks: DataFrame, shards: DataFrame, load: Callable, answer: Callable, schema: str, tasks: int) -> DataFrame:
    """asks (shard, q, ids, ...) answered by their shards: answer(load(a shard's row), a batch of asks)."""
    rows = asks.unionByName(shards, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", F.asc_nulls_first("q"))

    def serve(batches):
        shard = None
        for batch in batches:
            edges = np.flatnonzero(np.diff(batch.column("shard").to_numpy())) + 1
            for a, b in pairwise([0, *edges.tolist(), batch.num_rows]):
                part = batch.slice(a, b - a)
                if b > a and not part.column("q")[0].is_valid:
                    shard, part = load(part.slice(0, 1)), part.slice(1)
                if part.num_rows:
                    yield answer(shard, part)

    return in_tasks(rows, tasks).mapInArrow(serve, schema)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The items of a column of arrays, and each one's row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().fill_null(0).to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), lengths)


def linked_to(asks: DataFrame, linked: DataFrame, tasks: int) -> DataFrame:
    """(shard, q, ids) -> q, ids: whom the graph links to each of ids."""

    def load(row: pa.RecordBatch) -> tuple:
        ids, ends, nbs = (row.column(c).flatten().to_numpy() for c in ("ids", "ends", "nbs"))
        return ids, np.r_[0, ends], nbs

    def answer(shard: tuple, part: pa.RecordBatch) -> pa.RecordBatch:
        ids, starts, nbs = shard
        wanted, row = flat(part.column("ids"))
        at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
        has = ids[at] == wanted  # a node without links isn't there
        at, row = at[has], row[has]
        sizes = starts[at + 1] - starts[at]
        items = nbs[np.repeat(starts[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        return pa.RecordBatch.from_arrays([part.column("q"), lists(items, np.bincount(row, sizes, part.num_rows).astype(np.int64))], ["q", "ids"])

    return served(asks, linked, load, answer, "q bigint, ids array<bigint>", tasks)


def similar_to(asks: DataFrame, vectors: DataFrame, length: int, tasks: int) -> DataFrame:
    """(shard, q, x, least, ids) -> q, ids, s: those of ids whose cosine with x is above least."""

    def load(row: pa.RecordBatch) -> tuple:
        return row.column("ids").flatten().to_numpy(), matrix(row.column("x"), length, np.float32)

    def answer(shard: tuple, part: pa.RecordBatch) -> pa.RecordBatch:
        ids, x = shard
        wanted, row = flat(part.column("ids"))
        at, asked, s = np.searchsorted(ids, wanted), matrix(part.column("x"), length, np.float32), np.empty(len(wanted), np.float32)
        for a in range(0, len(wanted), 8192):
            s[a : a + 8192] = np.einsum("ij,ij->i", x[at[a : a + 8192]], asked[row[a : a + 8192]])
        near = s > part.column("least").to_numpy()[row]
        sizes = np.bincount(row[near], minlength=part.num_rows)
        some = sizes > 0
        return pa.RecordBatch.from_arrays([part.column("q").filter(pa.array(some)), lists(wanted[near], sizes[some]), lists(s[near], sizes[some])], ["q", "ids", "s"])

    return served(asks, vectors, load, answer, "q bigint, ids array<bigint>, s array<float>", tasks)


def by_query(state: DataFrame, rows: DataFrame, tasks: int) -> DataFrame:
    """Each query's state and its rows after it."""
    both = state.unionByName(rows, allowMissingColumns=True)
    return in_tasks(both.repartition("q").sortWithinPartitions("q", F.desc_nulls_last("x")), tasks)


def turn_of(done: np.ndarray, row: np.ndarray, size: int) -> np.ndarray:
    """Of rows of candidates in order, which are expanded now: the first BEAM of each row's first `size` that are not done."""
    now = np.zeros(len(done), bool)
    open_ = np.flatnonzero(~done & (ranks(row) < size))
    now[open_[ranks(row[open_]) < BEAM]] = True
    return now


def hop(state: DataFrame, rows: DataFrame, vectors: DataFrame, shards: int, length: int, size: int, kept: int, tasks: int) -> DataFrame:
    """The state after what rows (q, ids) name that is new has been scored, and what was expanded for it is done: of each
    query's candidates the first `kept`, the first `size` of which are its pool."""

    def unseen(batches):
        for table, ends in whole_groups(batches, "q"):
            first = np.r_[0, ends[:-1]]  # the states' rows
            group = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
            ids, row = flat(table.column("ids"))
            known, of = np.isin(row, first), group[row]
            order = np.lexsort((~known, ids, of))
            ids, of, known = ids[order], of[order], known[order]
            new = ~known & np.r_[True, (np.diff(ids) != 0) | (np.diff(of) != 0)][: len(ids)]
            ids, of = ids[new], of[new]
            if not len(ids):
                continue
            shard = ids % shards
            order = np.lexsort((shard, of))
            ids, of, shard = ids[order], of[order], shard[order]
            start = np.flatnonzero(np.r_[True, (np.diff(of) != 0) | (np.diff(shard) != 0)])
            asker = pa.array(first[of[start]])
            columns = [pa.array(shard[start]), table.column("q").take(asker), table.column("x").take(asker), table.column("least").take(asker)]
            arrays = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, lists(ids, np.diff(np.r_[start, len(ids)]))], ["shard", "q", "x", "least", "ids"])

    def merge(batches):
        for table, ends in whole_groups(batches, "q"):
            first = np.r_[0, ends[:-1]]
            group = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
            (ids, row), (s, _), (was, old) = flat(table.column("ids")), flat(table.column("s")), flat(table.column("done"))
            done = np.zeros(len(ids), bool)
            done[np.isin(row, first)] = was.astype(bool) | turn_of(was.astype(bool), old, size)
            of = group[row]
            order = np.lexsort((ids, -s, of))
            order = order[ranks(of[order]) < kept]
            ids, s, done, of = ids[order], s[order], done[order], of[order]
            sizes, waiting = np.bincount(of, minlength=len(ends)), np.bincount(of[~done & (ranks(of) < size)], minlength=len(ends))
            least = np.full(len(ends), -2, np.float32)
            full = sizes >= kept
            least[full] = s[np.cumsum(sizes)[full] - 1]
            same = [table.column(c).take(pa.array(first)).combine_chunks() for c in ("q", "x")]
            yield pa.RecordBatch.from_arrays([*same, lists(ids, sizes), lists(s, sizes), lists(done, sizes), pa.array(least), pa.array(waiting, pa.int64())], STATE_COLUMNS)

    asks = by_query(state.select("q", "x", "least", "ids"), rows, tasks).mapInArrow(unseen, "shard bigint, q bigint, x binary, least float, ids array<bigint>")
    return by_query(state.drop("waiting"), similar_to(asks, vectors, length, tasks), tasks).mapInArrow(merge, STATE)


#: A query's candidates: ids with their scores, the nearest first, whether each is expanded; the score that a new one must
#: exceed; how many of the pool wait to be expanded.
STATE = "q bigint, x binary, ids array<bigint>, s array<float>, done array<boolean>, least float, waiting bigint"
STATE_COLUMNS = [c.split()[0] for c in STATE.split(", ")]


def expanded(state: DataFrame, shards: int, size: int) -> DataFrame:
    """shard, q, ids: what each query expands now."""

    def ask(batches):
        for batch in batches:
            (ids, row), (done, _) = flat(batch.column("ids")), flat(batch.column("done"))
            now = turn_of(done.astype(bool), row, size)
            ids, row = ids[now], row[now]
            shard = ids % shards
            order = np.lexsort((shard, row))
            ids, row, shard = ids[order], row[order], shard[order]
            start = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(shard) != 0)][: len(ids)])
            yield pa.RecordBatch.from_arrays([pa.array(shard[start]), batch.column("q").take(pa.array(row[start])), lists(ids, np.diff(np.r_[start, len(ids)]))], ["shard", "q", "ids"])

    return state.where("waiting > 0").mapInArrow(ask, "shard bigint, q bigint, ids array<bigint>")


def walked(state: DataFrame, n: int, vectors: DataFrame, linked: DataFrame, shards: int, length: int, size: int, kept: int) -> DataFrame:
    """The n queries' state once all of each one's pool are expanded."""
    ended = []
    while open_ := state.where("waiting > 0").count():
        if 2 * open_ < n:  # those whose walk has ended no longer go along
            ended.append(save(state.where("waiting = 0"), "ended"))
            state, n = renewed(state, state.where("waiting > 0"), "pool"), open_
        tasks = open_ // TASK_QUERIES
        rows = linked_to(expanded(state, shards, size), linked, tasks)
        state = renewed(state, hop(state, rows, vectors, shards, length, size, kept, tasks), "pool")
    return reduce(DataFrame.unionByName, ended, state)


def scored(pairs: DataFrame, asked: DataFrame, targets: DataFrame) -> DataFrame:
    return pairs.join(targets, "c").join(asked, "q").select("q", "c", cosine(F.col("v"), F.col("cv"), F.col("norm") * F.col("cn")).alias("s"))


def greedy_search(asked: DataFrame, nodes: DataFrame, graph: DataFrame, k: int, pool_size: int = POOL) -> DataFrame:
    """(q, v, norm: query nodes of the graph) -> q, c, s: the nearest nodes of each query's pool, itself among them. The pool
    grows until the recall of the k nearest, measured on some of the queries, reaches TARGET."""
    n = asked.count()
    n_nodes, length = nodes.agg(F.count("*"), F.first(F.size("v"))).first()
    vectors, linked, shards = sharded(nodes, graph, n_nodes, length or 1)

    def begin(batches):
        for batch in batches:
            none = np.zeros(batch.num_rows, np.int64)
            x = binaries(units(batch.column("v"), length).astype(np.float32))
            arrays = [lists(np.empty(0, kind), none) for kind in (np.int64, np.float32, np.bool_)]
            yield pa.RecordBatch.from_arrays([batch.column("q"), x, *arrays, pa.array(np.full(len(none), -2, np.float32)), pa.array(none)], STATE_COLUMNS)

    size, kept = pool_size, 2 * pool_size
    state = save(asked.select("q", "v").mapInArrow(begin, STATE), "pool")
    entries = entries_of(asked, n).groupBy("q").agg(F.collect_list("c").alias("ids"))
    state = renewed(state, hop(state, entries, vectors, shards, length, size, kept, n // TASK_QUERIES), "pool")
    probes = asked.orderBy(F.xxhash64("q", F.lit(2)), "q").limit(PROBES)
    others = best_of(exact_search(probes, nodes, k + 1).where("q <> c"), "q", [F.desc("s"), "c"], k)
    least = save(others.groupBy("q").agg(F.min("s").alias("low"), F.count("*").alias("n")), "least")
    pool = F.filter(F.arrays_zip(F.col("ids").alias("c"), F.col("s").alias("s")), lambda x: x["c"] != F.col("q"))
    right = F.size(F.filter(F.slice(pool, 1, k), lambda x: x["s"] >= F.col("low") - CLOSE / 10)).alias("right")
    while True:
        state = walked(state, n, vectors, linked, shards, length, size, kept)
        found, of = (x or 0 for x in state.join(least, "q").select(right, "n").agg(F.sum("right"), F.sum("n")).first())
        if size >= n_nodes or found >= TARGET * of:
            break
        size *= 2
        if size > kept:  # what was cut may belong to the pool: all is expanded again
            kept = 2 * size
            state = state.withColumn("done", F.transform("done", lambda x: F.lit(False))).withColumn("least", F.lit(-2.0).cast("float"))
        waiting = F.size(F.filter(F.slice("done", 1, size), lambda x: ~x)).cast("long")
        state = renewed(state, state.withColumn("waiting", waiting), "pool")
    near = F.try_element_at("s", F.lit(k + 1)) - CLOSE
    found = state.select("q", near.alias("near"), F.posexplode(F.arrays_zip(F.col("ids").alias("c"), F.col("s").alias("s"))).alias("at", "x"))
    found = found.where((F.col("at") < 4 * k) | (F.col("x.s") >= F.col("near"))).select("q", "x.c")
    return scored(found, asked, nodes.select(F.col("id").alias("c"), F.col("v").alias("cv"), F.col("norm").alias("cn")))


def packed(rows: DataFrame, key: str, most: int, label: str) -> DataFrame:
    """(key, v, norm) -> ids (array), x (their unit vectors, doubles): blocks of `most` rows at most."""

    def pack(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, most):
                part = batch.slice(a, most)
                unit = np.array(part.column("v").to_pylist()) / part.column("norm").to_numpy()[:, None]
                yield pa.RecordBatch.from_arrays([pa.array([part.column(key).to_pylist()], pa.list_(pa.int64())), pa.array([unit.tobytes()], pa.binary())], ["ids", "x"])

    return save(rows.select(key, "v", "norm").mapInArrow(pack, "ids array<bigint>, x binary"), label)


def exact_search(asked: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """q, c, s: each query node's k best nodes, itself among them, of all. Blocks of queries meet blocks of nodes, each pair
    by one product, and hand on k nodes for each query."""
    ours, theirs = packed(asked, "q", QUERY_BLOCK, "queries"), packed(nodes, "id", NODE_BLOCK, "candidates")

    def compare(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q, c = (np.frombuffer(row[x]).reshape(len(row[i]), -1) for x, i in (("x", "ids"), ("y", "names")))
                s, names = q @ c.T, np.array(row["names"])
                m = min(k, len(names))
                at = np.argpartition(-s, m - 1, axis=1)[:, :m]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(row["ids"], m)), pa.array(names[at].ravel()), pa.array(np.take_along_axis(s, at, 1).ravel())], ["q", "c", "s"])

    pairs = ours.crossJoin(theirs.select(F.col("ids").alias("names"), F.col("x").alias("y")))
    return best_of(pairs.mapInArrow(compare, "q bigint, c bigint, s double"), "q", [F.desc("s"), "c"], k)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, exact: bool = False) -> DataFrame:
    """(vec_id, embedding) -> query_id, rank, vec_id, score: each query row's k nearest other rows found (with exact, of all)."""
    own = valid_vectors(vectors)
    longest = own.agg(F.max(F.size("v"))).first()[0] or 0
    padded = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("v")))
    own = save(own.withColumn("v", padded).withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.lit(1), "v")), "vectors")
    nodes = save(own.groupBy("k1", "k2").agg(F.min_by(F.struct("vec_id", "v", "norm"), "vec_id").alias("x")).select(F.col("x.vec_id").alias("id"), "x.v", "x.norm", "k1", "k2"), "nodes")
    members = save(own.select("vec_id", "k1", "k2").join(nodes.select("id", "k1", "k2"), ["k1", "k2"]).select("vec_id", "id"), "members")
    queries = members.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("id").alias("q"))
    asked = nodes.join(queries.select(F.col("q").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("q"), "v", "norm")
    asked = save(asked, "asked")
    if exact:  # near ties of the last place are scored again below, in the order of the other way's sums
        near = exact_search(asked, nodes, 4 * k).select("q", "c")
        found = scored(near, asked, nodes.select(F.col("id").alias("c"), F.col("v").alias("cv"), F.col("norm").alias("cn")))
    else:
        found = greedy_search(asked, nodes, build_graph(nodes), k)
    few = best_of(members, "id", ["vec_id"], k + 1)
    hits = best_of(found, "q", [F.desc("s"), "c"], 4 * k).join(few, F.col("c") == F.col("id")).select("q", "vec_id", F.col("s").alias("score"))
    hits = best_of(hits, "q", [F.desc("score"), "vec_id"], k + 1)
    answers = queries.join(hits, "q").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
