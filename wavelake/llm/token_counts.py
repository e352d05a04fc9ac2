"""Token counts of whole texts without shuffling a pre-token: a broadcast table of frequent pre-tokens, then worker caches.

The tokenizer's pieces have no white-space marker after another character (checked when it is loaded) and no
normalisation but the marker before a text, so a text's count is the sum of its pre-tokens' counts. A first pass counts
pre-tokens within each task over all documents; only each task's most frequent ones are added up, and the most frequent
TABLE_ENTRIES of them go to every worker with their lengths (about 1 MB). A worker encodes what the table lacks with the
library, once, and keeps it in a bounded cache. Counts are exact whatever the table holds.

Null texts are empty: 0 bytes, 0 tokens. Repeated rows stay rows; an empty table gives none. Texts of any length are
counted whole, and no cache holds pre-tokens over 64 bytes.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelake.llm.common import bounded, texts
from wavelake.llm.pieces import default_model, load_vocabulary, pre_tokens

TABLE_ENTRIES, TASK_ENTRIES, CACHE_ENTRIES, COUNTED, CACHED_BYTES = 1 << 15, 1 << 13, 400_000, 500_000, 64


class Lengths(dict):
    """Pre-token -> number of tokens: the frequent ones always, others of CACHED_BYTES at most as they
    come, until the cache is full. Longer ones are encoded anew each time."""

    def __init__(self, model: bytes, frequent: dict[bytes, int]):
        import sentencepiece

        super().__init__(frequent)
        self.frequent, self.library = frequent, sentencepiece.SentencePieceProcessor(model_proto=model)
        self[b""] = self.frequent[b""] = len(self.library.encode("a ")) - len(self.library.encode("a"))  # a marker alone

    def __missing__(self, word: bytes) -> int:
        n = len(self.library.encode(word.decode()))
        if len(word) > CACHED_BYTES:
            return n
        if len(self) > CACHE_ENTRIES:
            self.clear()
            self.update(self.frequent)
        self[word] = n
        return n


def frequent_pre_tokens(documents: DataFrame, entries: int = TABLE_ENTRIES) -> list[bytes]:
    """The most frequent pre-tokens, judged by what each task finds frequent."""

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in texts(batch):
                seen.update(w for w in pre_tokens(text) if len(w) <= CACHED_BYTES)
                if len(seen) > COUNTED:
                    seen = Counter(dict(seen.most_common(COUNTED // 4)))
        top = seen.most_common(TASK_ENTRIES)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    rows = documents.select("text").mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(entries).collect()
    return [bytes(r.word) for r in rows]


@bounded
def token_counts(documents: DataFrame, model: str | None = None, limit: int = 4096) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit, a row for each row."""
    model = model or default_model()
    load_vocabulary(model)  # refuses a model whose texts can't be cut at markers
    with open(model, "rb") as f:
        proto = f.read()
    lengths = Lengths(proto, {})
    table = {w: lengths[w] for w in frequent_pre_tokens(documents)}
    sent = documents.sparkSession.sparkContext.broadcast((proto, table))

    def count(batches):
        known = Lengths(*sent.value)
        for batch in batches:
            own = texts(batch)
            sizes = pa.array([len(x) for x in own], pa.int64())
            tokens = pa.array([sum(map(known.__getitem__, pre_tokens(x))) for x in own], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, tokens], ["doc_id", "n_bytes", "n_tokens"])

    counted = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
