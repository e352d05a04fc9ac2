"""Benchmark decontamination with a distributed positional inverted index.

Training documents become index segments, one row each: every term of the segment's documents with the sorted
positions at which it stands. A document lies in one segment whole, so postings are never shuffled and no term,
however common, gathers in one task. Phrases are found as in any positional index: take the posting list of the
phrase's rarest term (rarity over all segments), shift it to the phrase's start, and intersect it with the shifted
lists of the other terms, rarest first. Test phrases go to the tasks in blocks of a bounded number of words, one after
another; what several blocks find is merged by document, so neither driver nor task holds more than one block.

Nulls and texts without words: 0 words, no hits. Rows with a repeated doc_id stay separate rows. An empty benchmark
or an empty table gives no hits or no rows. Only the named columns are read, so further columns don't matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelake.llm.common import bounded, save, scratch, texts

#: Bytes of words stay (a-z, digits, all beyond ASCII), A-Z become lower case, all others become spaces.
WORD_BYTES = bytes(ord(chr(b).lower()) if chr(b).isalnum() and b < 128 else b if b >= 128 else 32 for b in range(256))
#: Words of one index segment, and test words in one block sent to the tasks (8 MB of arrays at most).
SEGMENT_WORDS, BLOCK_WORDS = 1 << 20, 1 << 20
INDEX = "segment string, doc_ids array<{}>, n_words array<int>, terms binary, counts binary, positions binary"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


# ---------------------------------------------------------------- index


def segment(ids: list, lengths: list[int], words: list[bytes]) -> dict:
    """One segment's row; positions are delta-coded over the lists laid end to end."""
    coded = pa.array(words, pa.binary()).dictionary_encode()
    keys = np.sort(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) << 32 | np.arange(len(words)))
    counts = np.bincount(keys >> 32, minlength=len(coded.dictionary)).astype(np.int32)
    at = (keys & 0xFFFFFFFF).astype(np.int32)
    return {"segment": uuid.uuid4().hex, "doc_ids": ids, "n_words": lengths, "terms": b" ".join(coded.dictionary.to_pylist()), "counts": counts.tobytes(), "positions": np.diff(at, prepend=np.int32(0)).astype(np.int32).tobytes()}


def index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, lengths, words, schema = [], [], [], None
    for batch in batches:
        schema = pa.schema([("segment", pa.string()), ("doc_ids", pa.list_(batch.schema.field("doc_id").type)), ("n_words", pa.list_(pa.int32())), ("terms", pa.binary()), ("counts", pa.binary()), ("positions", pa.binary())])
        for i, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
            own = words_of(text)
            if words and len(words) + len(own) > SEGMENT_WORDS:
                yield pa.RecordBatch.from_pylist([segment(ids, lengths, words)], schema)
                ids, lengths, words = [], [], []
            ids.append(i)
            lengths.append(len(own))
            words += own
    if ids:
        yield pa.RecordBatch.from_pylist([segment(ids, lengths, words)], schema)


@bounded
def build_index(documents: DataFrame, id_type: str = "bigint") -> DataFrame:
    """(doc_id, text) -> the index, written to the shared folder: one row for each segment of whole documents."""
    return save(documents.select(F.col("doc_id").cast(id_type), "text").mapInArrow(index_batches, INDEX.format(id_type)), "postings")


class Segment:
    """A segment read back: keys are term << 32 | position, sorted, so one array holds all posting lists."""

    def __init__(self, row: dict):
        self.terms = row["terms"].split(b" ") if row["terms"] else []
        self.counts = np.frombuffer(row["counts"], np.int32)
        at = np.cumsum(np.frombuffer(row["positions"], np.int32), dtype=np.int64)
        self.keys = np.repeat(np.arange(len(self.counts), dtype=np.int64), self.counts) << 32 | at
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.doc_ids, self.lengths = row["doc_ids"], np.array(row["n_words"], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])

    def ids_of(self, vocabulary: pa.Array) -> np.ndarray:
        """The segment's number of each term, -1 if it has none."""
        found = pc.index_in(vocabulary, value_set=pa.array(self.terms, pa.binary()))
        return found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def holds(self, term: np.ndarray, at: np.ndarray) -> np.ndarray:
        key = term << 32 | at
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[place] == key

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1


# ---------------------------------------------------------------- test phrases


class Phrases:
    """A block of distinct phrases: terms laid end to end, each phrase's places in order of rarity, and its items."""

    def __init__(self, phrases: dict[tuple, set]):
        self.vocabulary = list(dict.fromkeys(w for p in phrases for w in p))
        number = {w: i for i, w in enumerate(self.vocabulary)}
        self.length = np.array([len(p) for p in phrases], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.term = np.array([number[w] for p in phrases for w in p], np.int64)
        self.items = [sorted(x) for x in phrases.values()]
        self.order = np.empty(0, np.int64)

    def rank(self, frequency: dict[bytes, int]) -> None:
        """Order each phrase's places by how often their terms stand in all documents, rarest first."""
        often = np.array([frequency.get(w, 0) for w in self.vocabulary])
        phrase = np.repeat(np.arange(len(self.length)), self.length)
        place = np.arange(len(self.term)) - self.first[phrase]
        self.order = place[np.lexsort((place, often[self.term], phrase))]


def windows_of(words: list[bytes], size: int) -> Iterator[tuple]:
    """Every run of size words; fewer words, but not none, are one window."""
    for k in range(max(1, len(words) - size + 1) if words else 0):
        yield tuple(words[k : k + size])


def phrase_blocks(items: DataFrame, size: int) -> Iterator[Phrases]:
    """The windows of all (item_id, text), in blocks of about BLOCK_WORDS words: the driver holds one item at a time."""
    block: dict[tuple, set] = {}
    total = 0
    for row in items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text").toLocalIterator():
        for window in windows_of(words_of((row.text or "").encode()), size):
            total += 0 if window in block else len(window)
            block.setdefault(window, set()).add(row.item_id)
        if total >= BLOCK_WORDS:
            yield Phrases(block)
            block, total = {}, 0
    if block:
        yield Phrases(block)


def frequencies(index: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How often each of the test's terms stands in all documents; only the index's term columns are read."""
    spark = index.sparkSession
    sent = spark.sparkContext.broadcast(sorted(vocabulary))

    def count(batches):
        wanted = pa.array(sent.value, pa.binary())
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                found = pc.index_in(wanted, value_set=pa.array(row["terms"].split(b" ") if row["terms"] else [], pa.binary())).fill_null(-1).to_numpy(zero_copy_only=False)
                total[found >= 0] += np.frombuffer(row["counts"], np.int32)[found[found >= 0]]
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([wanted.take(pa.array(has)), pa.array(total[has])], ["term", "n"])

    rows = index.select("terms", "counts").mapInArrow(count, "term binary, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.term): r.n for r in rows}


# ---------------------------------------------------------------- matching


def phrase_starts(part: Segment, block: Phrases, most: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yields (phrase, start): the shifted list of the rarest term, intersected with those of the others in turn."""
    if not len(part.keys) or not len(block.length):
        return
    own = part.ids_of(pa.array(block.vocabulary, pa.binary()))
    alive = np.flatnonzero(np.minimum.reduceat(own[block.term], block.first) >= 0)
    lists = own[block.term[block.first[alive] + block.order[block.first[alive]]]]
    load = np.cumsum(part.counts[lists])
    for chunk in np.split(np.arange(len(alive)), np.flatnonzero(np.diff(load // most)) + 1) if len(alive) else []:
        phrase, listed = alive[chunk], lists[chunk]
        n = part.counts[listed]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = part.keys[np.repeat(part.first[listed], n) + within] & 0xFFFFFFFF
        phrase = np.repeat(phrase, n)
        start = at - block.order[block.first[phrase]]
        ok = start >= 0
        phrase, start = phrase[ok], start[ok]
        for k in range(1, int(block.length[phrase].max(initial=0))):
            more = block.length[phrase] > k
            place = block.order[np.where(more, block.first[phrase] + k, 0)]
            term = own[block.term[np.where(more, block.first[phrase] + place, 0)]]
            keep = ~more | part.holds(term, start + place)
            phrase, start = phrase[keep], start[keep]
        same = part.document(start) == part.document(start + block.length[phrase] - 1)
        yield phrase[same], start[same]


def block_matches(index: DataFrame, block: Phrases) -> DataFrame:
    """One block's matches, a row for each document: segment, place (in the segment), doc_id, n_words, from_, to (runs of
    hit words, disjoint), items."""
    spark: SparkSession = index.sparkSession
    block.rank(frequencies(index, set(block.vocabulary)))
    sent = spark.sparkContext.broadcast(block)
    numbers, names = pa.list_(pa.int64()), pa.list_(pa.string())
    id_type = index.schema["doc_ids"].dataType.elementType.simpleString()
    ids = {"bigint": pa.int64(), "string": pa.string()}[id_type]
    schema = pa.schema([("segment", pa.string()), ("place", pa.int32()), ("doc_id", ids), ("n_words", pa.int64()), ("from_", numbers), ("to", numbers), ("items", names)])

    def match(batches):
        for batch in batches:
            for row in batch.to_pylist():
                part, phrases = Segment(row), sent.value
                edge = np.zeros(int(part.starts[-1]) + 1, np.int32)
                found: list[set] = [set() for _ in part.doc_ids]
                for phrase, start in phrase_starts(part, phrases):
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + phrases.length[phrase], -1)
                    for d, p in zip(part.document(start).tolist(), phrase.tolist(), strict=True):
                        found[d].update(phrases.items[p])
                hit = np.cumsum(edge) > 0
                runs_ = [hit_runs(hit[a:b]) for a, b in zip(part.starts[:-1].tolist(), part.starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["segment"]] * len(runs_)), pa.array(range(len(runs_)), pa.int32()), pa.array(part.doc_ids, ids), pa.array(part.lengths),
                    pa.array([x[0] for x in runs_], numbers), pa.array([x[1] for x in runs_], numbers), pa.array([sorted(x) for x in found], names)], schema=schema)

    return index.mapInArrow(match, f"segment string, place int, doc_id {id_type}, n_words bigint, from_ array<bigint>, to array<bigint>, items array<string>")


def hit_runs(hit: np.ndarray) -> tuple[list[int], list[int]]:
    """Where runs of true begin and end (exclusive)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return edge[::2].tolist(), edge[1::2].tolist()


def phrase_matches(index: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Exact matches, one row per document: doc_id, n_words, n_hit (words inside any match), items (ids as sorted strings)."""
    blocks = phrase_blocks(items, window)
    found, more = block_matches(index, next(blocks, Phrases({}))), next(blocks, None)
    if more is None:
        return found.select("doc_id", "n_words", covered("from_", "to").alias("n_hit"), "items")
    parts = [save(found, "matches")]
    while more is not None:
        parts.append(save(block_matches(index, more).where("size(items) > 0"), "matches"))
        more = next(blocks, None)
    every = reduce(DataFrame.unionByName, parts)
    runs_ = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("from_", "to"))))
    merged = every.groupBy("segment", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), runs_.alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def step(done: Column, r: Column) -> Column:
        own = F.greatest(F.lit(0).cast("long"), r["to"] - F.greatest(r["from_"], done["end"]))
        return F.struct(F.greatest(done["end"], r["to"]).alias("end"), (done["n"] + own).alias("n"))

    zero = F.lit(0).cast("long")
    n_hit = F.aggregate("r", F.struct(zero.alias("end"), zero.alias("n")), step, lambda done: done["n"])
    return merged.select("doc_id", "n_words", n_hit.alias("n_hit"), "items")


def covered(start: str, end: str) -> Column:
    """The summed lengths of disjoint runs."""
    return F.aggregate(F.zip_with(start, end, lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)


def proximity_matches(index: DataFrame, queries: DataFrame, slop: int = 20) -> DataFrame:
    """(item_id, text) queries, each few words -> (item_id, doc_id, position): places of a query's rarest word, in words
    from the document's start, that have each of its other words at most slop words away in the same document. Item ids
    may be strings or whole numbers; those of documents are of the index's type."""
    spark = index.sparkSession
    wanted = [(r.item_id, list(dict.fromkeys(words_of((r.text or "").encode())))) for r in queries.select("item_id", "text").toLocalIterator()]
    often = frequencies(index, {w for _, ws in wanted for w in ws})
    sent = spark.sparkContext.broadcast([(i, sorted(ws, key=lambda w: (often.get(w, 0), w))) for i, ws in wanted if ws])
    names = {True: "string", False: "bigint"}
    kinds = [names[isinstance(t, T.StringType)] for t in (queries.schema["item_id"].dataType, index.schema["doc_ids"].dataType.elementType)]
    arrow = [pa.string() if k == "string" else pa.int64() for k in kinds] + [pa.int64()]

    def match(batches):
        for batch in batches:
            for row in batch.to_pylist():
                part = Segment(row)
                number = {w: i for i, w in enumerate(part.terms)}
                out = []
                for item, ws in sent.value:
                    if not all(w in number for w in ws):
                        continue
                    lists = [part.keys[part.first[number[w]] : part.first[number[w] + 1]] & 0xFFFFFFFF for w in ws]
                    at = lists[0]
                    for other in lists[1:]:
                        d = part.document(at)
                        low, high = np.maximum(at - slop, part.starts[d]), np.minimum(at + slop, part.starts[d + 1] - 1)
                        at = at[np.searchsorted(other, low) < np.searchsorted(other, high, "right")]
                    d = part.document(at)
                    out += [(item, part.doc_ids[x], int(p)) for x, p in zip(d.tolist(), at - part.starts[d], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(arrow)], ["item_id", "doc_id", "position"])

    return index.mapInArrow(match, f"item_id {kinds[0]}, doc_id {kinds[1]}, position bigint")


def contamination(documents: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Index the documents and match the items' windows: doc_id, n_words, n_hit, items."""
    return phrase_matches(build_index(documents), items, window)


def text_digest() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def contaminated_texts(documents: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """sha (text_digest()) of the texts with a match, written to the shared folder; the index goes."""
    with scratch(documents.sparkSession):
        index = build_index(documents.select(text_digest().alias("doc_id"), "text"), "string")
        found = phrase_matches(index, items, window).where("n_hit > 0")
        return save(found.select(F.col("doc_id").alias("sha")).distinct(), "contaminated", outlive=True)


def clean_rows(documents: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The rows whose own text has no match, whatever their ids: null and repeated ids are judged by row, null texts stay."""
    packed = documents.select(F.struct(*documents.columns).alias("kept"), text_digest().alias("sha"))
    return packed.join(contaminated_texts(documents, items, window), "sha", "left_anti").select("kept.*")
