"""Language-model scoring by context-tree weighting over bytes.

A text is coded as its tokens: A-Z lower-cased words, each followed by a space, and one line feed at the end. A byte is
eight binary decisions; for each decision, every context of 0 to DEPTH preceding bytes has Krichevsky-Trofimov counts
from the training documents, and a node's weighted probability is half its own estimate and half its children's
product. A decision's probability mixes the estimates of all depths with the weights that follow. A text's score is the
log10 probability of all its bytes.

All counts come from all training documents. A task packs the documents that it reads into blocks of BLOCK_BYTES; a block
sends its distinct (DEPTH + 1)-byte strings with counts, these are added up by string, and the trees below each TOP
preceding bytes are weighted independently (a subtree lies in one task whole; its rows are distinct strings, not
occurrences). The levels above are added up from there, and what they mix goes back to the subtrees; the two top levels
have at most 256 * 255 nodes and go to all tasks. Each block, packed, then meets exactly
the log probabilities of its own strings and words, whose number its size bounds: no table of the corpus is broadcast,
however large it grows, and texts move once, packed.

Null texts are empty (one token, the end). A null doc_id counts as '' for the fold, which makes it training.
"""

from __future__ import annotations

import io
import secrets
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.ipc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelake.llm.common import bounded, fold_of, save, texts
from wavelake.llm.prints import runs

DEPTH, TOP = 5, 3
SYMBOL = 8 * DEPTH  # a string's key: the preceding bytes, nearest first, above the byte itself
BLOCK_BYTES, RUN_BYTES = 32 << 20, 1 << 20
#: The most frequent strings and words go to every task with their values (5 MB at most); blocks need not ask for them.
COMMON_STRINGS, COMMON_WORDS = 1 << 18, 1 << 15


def coded(text: bytes | None) -> tuple[list[bytes], bytes]:
    """Words and the bytes that stand for them."""
    words = (text or b"").lower().split()
    return words, (b" ".join(words) + b" \n" if words else b"\n")


def pieces_of(code: bytes) -> Iterator[bytes]:
    """The code in pieces of at most RUN_BYTES, each after the DEPTH bytes before it; before a text stand line feeds."""
    padded = b"\n" * DEPTH + code
    for at in range(0, len(code), RUN_BYTES):
        yield padded[at : at + RUN_BYTES + DEPTH]


def strings_of(pieces: list[bytes]) -> np.ndarray:
    """The key of every byte of the pieces, with the DEPTH bytes before it."""
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    keys = raw.astype(np.int64)
    for d in range(1, DEPTH + 1):
        keys[d:] |= raw[:-d].astype(np.int64) << (8 * (DEPTH - d) + 8)
    inside = np.ones(len(raw), bool)
    starts = np.cumsum([0, *(len(x) for x in pieces[:-1])])
    for d in range(DEPTH):
        inside[starts + d] = False
    return keys[inside]


# ---------------------------------------------------------------- counts


class Tally:
    """The distinct keys of the codes added, sorted, and how often each stands; counted in runs of about RUN_BYTES."""

    def __init__(self):
        self.keys, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)
        self.waiting: list[bytes] = []
        self.size = 0

    def add(self, code: bytes) -> None:
        for piece in pieces_of(code):
            self.waiting.append(piece)
            self.size += len(piece)
            if self.size >= RUN_BYTES:
                self.count()

    def count(self) -> None:
        if not self.waiting:
            return
        own = strings_of(self.waiting)
        self.waiting, self.size = [], 0
        own.sort()
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        n, own = np.diff(first, append=len(own)), own[first]
        at = np.searchsorted(self.keys, own)
        seen = held(self.keys, own, at)
        self.counts[at[seen]] += n[seen]
        self.keys = np.insert(self.keys, at[~seen], own[~seen])
        self.counts = np.insert(self.counts, at[~seen], n[~seen])


def held(keys: np.ndarray, asked: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the asked are among the sorted keys, at being their places."""
    return keys[np.minimum(at, len(keys) - 1)] == asked if len(keys) else np.zeros(len(asked), bool)


PACKED = pa.schema([("block", pa.int64()), ("packed", pa.binary()), ("string", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])
DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("text", pa.binary()), ("train", pa.bool_())])
ROWS = 1 << 17


class Block:
    """Documents, packed as they come, and their distinct strings and words with their counts in training documents
    (0: in others only)."""

    def __init__(self):
        self.size, self.out, self.rows, self.words = 0, io.BytesIO(), [], Counter()
        self.train, self.others = Tally(), Tally()
        self.sink = pa.ipc.new_stream(self.out, DOCUMENTS, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6)))
        self.waiting = 0

    def add(self, doc_id: int | None, text: bytes, train: bool) -> None:
        words, code = coded(text)
        words.append(b"\n")
        self.words.update(words if train else dict.fromkeys(words, 0))
        (self.train if train else self.others).add(code)
        self.rows.append((doc_id, text, train))
        self.size += len(text)
        self.waiting += len(text)
        if self.waiting >= 4 * RUN_BYTES:
            self.pack()

    def pack(self) -> None:
        if self.rows:
            self.sink.write_batch(pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*self.rows, strict=True), DOCUMENTS, strict=True)], schema=DOCUMENTS))
        self.rows, self.waiting = [], 0

    def batches(self) -> Iterator[pa.RecordBatch]:
        self.pack()
        self.sink.close()
        block = secrets.randbits(62)
        yield packed_batch(block, packed=[self.out.getvalue()])
        self.out.close()
        self.train.count()
        self.others.count()
        keys, counts, others = self.train.keys, self.train.counts, self.others.keys
        for at in range(0, len(keys), ROWS):
            yield packed_batch(block, string=keys[at : at + ROWS], n=counts[at : at + ROWS])
        for at in range(0, len(others), ROWS):
            some = others[at : at + ROWS]
            some = some[~held(keys, some, np.searchsorted(keys, some))]
            yield packed_batch(block, string=some, n=np.zeros(len(some), np.int64))
        words = iter(self.words.items())
        while some := list(islice(words, ROWS)):
            yield packed_batch(block, word=[w for w, _ in some], n=[n for _, n in some])


def packed_batch(block: int, **columns) -> pa.RecordBatch:
    rows = len(next(iter(columns.values())))
    arrays = {"block": pa.array(np.full(rows, block)), **{k: pa.array(v, PACKED.field(k).type) for k, v in columns.items()}}
    return pa.RecordBatch.from_arrays([arrays.get(f.name, pa.nulls(rows, f.type)) for f in PACKED], schema=PACKED)


def packed_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = Block()
    for batch in batches:
        for i, text, train in zip(batch.column("doc_id").to_pylist(), texts(batch), batch.column("train").to_pylist(), strict=True):
            if block.words and block.size + len(text) > BLOCK_BYTES:
                yield from block.batches()
                block = Block()
            block.add(i, text, train)
    if block.words:
        yield from block.batches()


# ---------------------------------------------------------------- weighting


def log_gamma_half(n: np.ndarray, half: float) -> np.ndarray:
    """log(Gamma(n + half) / Gamma(half)) for counts n >= 0."""
    small = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1024) + half))])
    x = np.maximum(n, 1024) + half
    large = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) - (0.5 * np.log(np.pi) if half == 0.5 else 0.0)
    return np.where(n <= 1024, small[np.minimum(n, 1024).astype(np.int64)], large)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return log_gamma_half(n0, 0.5) + log_gamma_half(n1, 0.5) - log_gamma_half(n0 + n1, 1.0)


class Level:
    """The nodes of one depth: key = context << 8 | decision (1 to 255: the byte's bits so far after a one), counts, weights."""

    def __init__(self, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray):
        self.keys, self.n0, self.n1, self.kt = keys, n0, n1, log_kt(n0, n1)
        self.lw = self.kt

    def above(self, bits: int = 8) -> Level:
        """The next shorter contexts, whose weighted probability is half their own estimate, half their children's product."""
        parent, at = np.unique(self.keys >> (8 + bits) << 8 | self.keys & 255, return_inverse=True)
        up = Level(parent, *(np.bincount(at, x, len(parent)) for x in (self.n0, self.n1)))
        up.lw = np.logaddexp(up.kt, np.bincount(at, self.lw, len(parent))) - np.log(2)
        return up

    def mixed(self, known: np.ndarray, rest: np.ndarray, last: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The probability of a one as far as mixed down to here, and the weight that deeper contexts still have."""
        own = np.ones(len(self.keys)) if last else np.exp(self.kt - np.log(2) - self.lw)
        return known + rest * own * (self.n1 + 0.5) / (self.n0 + self.n1 + 1), rest * np.maximum(0.0, 1 - own)


def levels(strings: np.ndarray, counts: np.ndarray, k: int) -> list[Level]:
    """The levels of depth DEPTH up to TOP, for the bytes' decision k (0 to 7) alone: a decision's nodes never meet another's."""
    nodes, ones = decision(strings, k)
    keys, at = np.unique(nodes, return_inverse=True)
    out = [Level(keys, np.bincount(at, counts * (1 - ones), len(keys)), np.bincount(at, counts * ones, len(keys)))]
    for _ in range(DEPTH - TOP):
        out.append(out[-1].above())
    return out


def decision(strings: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each string, the node of its byte's decision k below its context, and the bit decided."""
    symbol = strings & 255
    return strings >> 8 << 8 | 1 << k | symbol >> (8 - k), symbol >> (7 - k) & 1


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 1 << 18) -> Iterator[pa.Table]:
    """Tables of about `rows` rows of a sorted stream, none of which cuts a `top` (rows of one context of depth TOP) in two."""
    kept, size, enough = [], 0, rows
    for batch in batches:
        kept.append(batch)
        size += batch.num_rows
        if size >= enough:
            table = pa.Table.from_batches(kept)
            edges = np.flatnonzero(np.diff(table.column("top").to_numpy()))
            end = int(edges[-1]) + 1 if len(edges) else 0
            if end:
                yield table.slice(0, end)
            kept, size = table.slice(end).to_batches(), table.num_rows - end
            enough = max(rows, 2 * size)
    if size:
        yield pa.Table.from_batches(kept)


def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(top, string, n) -> the nodes of depth TOP: node, counts, log weights."""
    for table in whole_groups(batches):
        strings, n = table.column("string").to_numpy(), table.column("n").to_numpy()
        tops = [levels(strings, n, k)[-1] for k in range(8)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([getattr(t, x) for t in tops])) for x in ("keys", "n0", "n1", "lw")], ["node", "n0", "n1", "lw"])


def shorter(node: str) -> Column:
    """The node of the next shorter context."""
    return F.shiftleft(F.shiftright(node, 16), 8).bitwiseOR(F.col(node).bitwiseAND(F.lit(255)))


def summed(nodes: DataFrame) -> DataFrame:
    """The next shorter contexts' nodes: counts, and below, the log weight of all children."""
    return nodes.groupBy(shorter("node").alias("node")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("lw").alias("below"))


def level_of(batch: pa.RecordBatch) -> Level:
    own = Level(*(batch.column(x).to_numpy() for x in ("node", "n0", "n1")))
    own.lw = np.logaddexp(own.kt, batch.column("below").to_numpy()) - np.log(2)
    return own


def weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(level_of(batch).lw)], ["node", "n0", "n1", "below", "lw"])


def top_levels(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """From the sums by (nearest byte, decision), at most 256 * 255 rows: what depths 0 and 1 mix, as dense tables."""
    keys, n0, n1, lw = (np.array([r[i] for r in rows], float) for i in range(4))
    one = Level(keys.astype(np.int64), n0, n1)
    one.lw = np.logaddexp(one.kt, lw) - np.log(2)
    zero = one.above()
    known, rest = np.full((256, 256), 0.5), np.zeros((256, 256))
    k0, r0 = zero.mixed(0.0, 1.0)
    for d, k, r in zip(zero.keys & 255, k0, r0, strict=True):
        known[:, d], rest[:, d] = k + r / 2, 0.0  # contexts never seen predict one half
    at = np.searchsorted(zero.keys & 255, one.keys & 255)
    k1, r1 = one.mixed(k0[at], r0[at])
    known[one.keys >> 8, one.keys & 255], rest[one.keys >> 8, one.keys & 255] = k1, r1
    return known, rest


def log_probabilities(strings: np.ndarray, counts: np.ndarray, nodes: np.ndarray, known: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """log10 of each string's last byte given the bytes before it; nodes: those of depth TOP, sorted, with what shorter
    contexts mix and the weight that is left."""
    out = np.zeros(len(strings))
    for decided in range(8):
        tree = levels(strings, counts, decided)[::-1]
        at = np.searchsorted(nodes, tree[0].keys)
        k, r = known[at], rest[at]
        for d, level in enumerate(tree):
            if d:
                at = np.searchsorted(tree[d - 1].keys, level.keys >> 16 << 8 | level.keys & 255)
                k, r = k[at], r[at]
            k, r = level.mixed(k, r, level is tree[-1])
        nodes_, ones = decision(strings, decided)
        p = k[np.searchsorted(tree[-1].keys, nodes_)]
        out += np.log10(np.where(ones == 1, p, 1 - p))
    return out


def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(top, string, n) and (top, node, known, rest) rows, sorted by top -> string, value: its log10 probability."""
    for table in whole_groups(batches):
        of_string = table.column("string").is_valid()
        own, tops = table.filter(of_string), table.filter(pa.compute.invert(of_string)).sort_by("node")
        s, n = own.column("string").to_numpy(), own.column("n").to_numpy()
        values = log_probabilities(s, n, *(tops.column(x).to_numpy() for x in ("node", "known", "rest")))
        yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(values)], ["string", "value"])


def string_values(strings: DataFrame) -> DataFrame:
    """(string, n) -> string, value. Subtrees below TOP preceding bytes are weighted on their own; what lies above is summed
    up level by level, and only the nodes of one preceding byte and none (256 * 255) pass through the driver."""
    spark = strings.sparkSession
    top = F.shiftright("string", SYMBOL + 8 - 8 * TOP)
    own = strings.select(top.alias("top"), "string", "n")
    level = save(own.repartition("top").sortWithinPartitions("top").mapInArrow(summaries, "node bigint, n0 double, n1 double, lw double"), "nodes")
    two = save(summed(level).mapInArrow(weighted, "node bigint, n0 double, n1 double, below double, lw double"), "nodes")
    tops = summed(two).orderBy("node").collect()
    sent = spark.sparkContext.broadcast(top_levels(tops) if tops else None)

    def mix(batches):
        for batch in batches:
            known, rest = sent.value
            own = level_of(batch)
            k, r = own.mixed(known[own.keys >> 16, own.keys & 255], rest[own.keys >> 16, own.keys & 255])
            yield pa.RecordBatch.from_arrays([pa.array(own.keys), pa.array(k), pa.array(r)], ["above", "known", "rest"])

    mixed = two.select("node", "n0", "n1", "below").mapInArrow(mix, "above bigint, known double, rest double")
    nodes = level.select("node", shorter("node").alias("above")).join(mixed, "above").select(F.shiftright("node", 8).alias("top"), "node", "known", "rest")
    both = own.unionByName(nodes, allowMissingColumns=True).select("top", "string", "n", "node", "known", "rest")
    return both.repartition("top").sortWithinPartitions("top").mapInArrow(weigh, "string bigint, value double")


# ---------------------------------------------------------------- scores


class Values:
    """What a block looks up: the log probabilities of its strings and words."""

    def __init__(self, slices: pa.Table, common: tuple[np.ndarray, np.ndarray, dict[bytes, float]]):
        of_string = pa.compute.is_valid(slices.column("string"))
        strings = np.concatenate([slices.column("string").drop_null().to_numpy(), common[0]])
        order = np.argsort(strings)
        self.strings = strings[order]
        self.values = np.concatenate([slices.column("value").filter(of_string).to_numpy(), common[1]])[order]
        words = slices.select(["word", "value", "known"]).filter(pa.compute.invert(of_string))
        names = words.column("word").to_pylist()
        self.common, self.words = common[2], dict(zip(names, words.column("value").to_pylist(), strict=True))
        self.unknown = {w for w, k in zip(names, words.column("known").to_pylist(), strict=True) if not k}

    def base(self, word: bytes) -> float:
        own = self.words.get(word)
        return self.common[word] if own is None else own

    def totals(self, codes: list[bytes]) -> np.ndarray:
        """Each code's log10 probability; looked up in runs of about RUN_BYTES."""
        pieces, owners = [], []
        for i, code in enumerate(codes):
            for piece in pieces_of(code):
                pieces.append(piece)
                owners.append(i)
        out = np.zeros(len(codes))
        for a, b in runs([len(x) for x in pieces], RUN_BYTES, max(1, len(pieces))):
            keys, at = np.unique(strings_of(pieces[a:b]), return_inverse=True)
            p = self.values[np.searchsorted(self.strings, keys)][at]
            sizes = np.array([len(x) - DEPTH for x in pieces[a:b]])
            np.add.at(out, owners[a:b], np.add.reduceat(p, np.cumsum(sizes) - sizes))
        return out


def score_block(blocks: pa.Table, slices: pa.Table, common: tuple[np.ndarray, np.ndarray, dict[bytes, float]]) -> pa.Table:
    values, parts = Values(slices, common), []
    for batch in pa.ipc.open_stream(blocks.column("packed")[0].as_buffer()):
        split = [coded(text) for text in batch.column("text").to_pylist()]
        words = [[*ws, b"\n"] for ws, _ in split]
        totals, sizes = values.totals([code for _, code in split]), np.array([len(code) for _, code in split])
        parts.append(pa.table({
            "doc_id": batch.column("doc_id"),
            "held_out": pa.compute.invert(batch.column("train")),
            "n_tokens": pa.array([len(ws) for ws in words], pa.int64()),
            "n_known": pa.array([len(ws) - sum(w in values.unknown for w in ws) for ws in words], pa.int64()),
            "base_score": pa.array([sum(map(values.base, ws)) for ws in words], pa.float64()),
            "score": pa.array(totals),
            "bits_per_byte": pa.array(-totals / np.log10(2) / sizes),
        }))
    return pa.concat_tables(parts)


@bounded
def score(documents: DataFrame, held_out: int = 1) -> DataFrame:
    """(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte
    (the code length of the coded text by its bytes).

    Learns from the documents whose fold (crc32 of the id's text, modulo 5) isn't held_out.
    """
    plain = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    marked = plain.withColumn("train", fold_of(F.col("doc_id")) != held_out)
    made = save(marked.mapInArrow(packed_blocks, "block bigint, packed binary, string bigint, word binary, n bigint"), "blocks")
    counts = made.where("packed IS NULL")

    strings = save(counts.where("string IS NOT NULL").groupBy("string").agg(F.sum("n").alias("n")), "strings")
    often = strings.orderBy(F.desc("n"), "string").limit(COMMON_STRINGS).select("string")
    values = save(string_values(strings), "values")
    words = save(counts.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("c")), "words")
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    log_base = F.log10((F.col("c") + 0.5) / F.lit(total[0] + 0.5 * (total[1] + 1)))
    words = words.select("word", "c", log_base.alias("value"), (F.col("c") > 0).cast("int").alias("known"))

    often_words = words.where("c > 0").orderBy(F.desc("c"), "word").limit(COMMON_WORDS)
    first = values.join(F.broadcast(often), "string").toPandas()
    known_words = {bytes(r.word): r.value for r in often_words.select("word", "value").collect()}
    common = documents.sparkSession.sparkContext.broadcast((first["string"].to_numpy(np.int64), first["value"].to_numpy(np.float64), known_words))
    asked = counts.where("string IS NOT NULL").select("block", "string").join(F.broadcast(often), "string", "left_anti")
    asked_words = counts.where("word IS NOT NULL").select("block", "word").join(F.broadcast(often_words.select("word")), "word", "left_anti")
    slices = asked.join(values, "string").select("block", "string", F.lit(None).cast("binary").alias("word"), "value", F.lit(None).cast("int").alias("known"))
    slices = slices.unionByName(asked_words.join(words, "word").select("block", F.lit(None).cast("long").alias("string"), "word", "value", "known"))
    blocks = made.where("packed IS NOT NULL").select(F.col("block").alias("block_"), "packed")
    scored = blocks.groupBy("block_").cogroup(slices.groupBy("block")).applyInArrow(lambda x, y: score_block(x, y, common.value), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, bits_per_byte double")
    return scored.withColumn("train_tokens", F.lit(total[0]).cast("long"))
