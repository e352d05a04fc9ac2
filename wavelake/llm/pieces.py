"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces, with byte fallback.

The pieces of a `.model` file are taken with their scores if the file is a unigram model. A BPE file holds merge ranks
in place of log probabilities; there, a piece of rank r gets Zipf's law, -log(r + 1) (`scores="zipf"`), or, on request,
the stored number (`scores="stored"`). Nothing is trained.

As in the library, white space is the marker U+2581 (a literal U+2581 in a text is the same), a marker is put before
every text that isn't empty, and a character that no piece covers costs 10 below the lowest score and becomes its bytes'
tokens. No piece has a marker after another character, so the best path of a text is that of its pre-tokens (markers
and the characters up to the next marker) one after another: each distinct pre-token is encoded once and kept in a
bounded cache of the worker. Decoding reverses this: markers become spaces, byte tokens bytes, the first space goes.

Null texts are empty and have no tokens. Very long texts are encoded whole, and so are very long pre-tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelake.llm.common import bounded, texts, with_field
from wavelake.llm.prints import runs

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Pre-tokens up to this many bytes are encoded in lockstep, longer ones singly; pre-tokens kept by a worker.
LOCKSTEP_BYTES, CACHE_ENTRIES, CACHED_BYTES = 64, 300_000, 64
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE, UNUSED = 1, 2, 3, 4, 6, 5


def pre_tokens(text: bytes) -> list[bytes]:
    """A text's pre-tokens, each without its first marker; markers are spaces. Their number is 0 for an empty text only."""
    text = text.replace(MARK.encode(), b" ")
    if b"  " in text or text.startswith(b" "):
        return [x[1:] for x in re.findall(rb" +[^ ]*", b" " + text)]
    return text.split(b" ") if text else []


class DoubleArray:
    """Trie over bytes: from state s, byte c leads to base[s] + c if check[base[s] + c] == s; value[s] is a piece or -1."""

    def __init__(self, words: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for word, v in words.items():
            node = 0
            for c in word:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][c]
            ends[node] = v
        size = 4 * len(children) + 4096
        self.base, self.check, self.value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        taken = np.zeros(size, bool)
        taken[0], free, queue = True, 1, [(0, 0)]
        for node, state in queue:
            self.value[state] = ends[node]
            if not (own := children[node]):
                continue
            free += int(np.argmin(taken[free:]))
            slots = np.array(list(own))
            base = self.room(taken, slots, max(1, free - int(slots.min())))
            self.base[state] = base
            taken[base + slots] = True
            self.check[base + slots] = state
            queue += [(child, base + c) for c, child in own.items()]
            if taken[free : free + 2048].mean() > 0.95:  # leave the dense part behind
                free += 2048
        end = int(np.flatnonzero(taken)[-1]) + 257
        self.base, self.check, self.value = self.base[:end], self.check[:end], self.value[:end]

    @staticmethod
    def room(taken: np.ndarray, slots: np.ndarray, base: int, window: int = 2048) -> int:
        """The first base from here on whose slots are all free."""
        while base + window + 256 < len(taken):
            free = np.ones(window, bool)
            for c in slots.tolist():
                free &= ~taken[base + c : base + c + window]
            if free.any():
                return base + int(np.argmax(free))
            base += window
        raise ValueError("the double array is full")


class Vocabulary:
    """Pieces with log scores, and the trie over those that texts can match."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.kinds = [k for _, _, k in pieces]
        self.scores = np.array([s for _, s, _ in pieces])
        matched = {p.replace(MARK, " ").encode(): i for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER_DEFINED, UNUSED)}
        if any(b" " in p.lstrip(b" ") for p in matched):
            raise ValueError("a piece has a marker after another character: its texts can't be cut at markers")
        self.trie = DoubleArray(matched)
        self.unknown = next(i for i, k in enumerate(self.kinds) if k == UNKNOWN)
        self.unknown_score = min(self.scores[list(matched.values())]) - UNKNOWN_PENALTY
        self.bytes_at = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.text_of = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode() for p, _, k in pieces]
        self.texts = pa.array(self.text_of, pa.large_binary())
        self.steps = self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist()

    def spelled(self, ids: list[int], lengths: list[int], word: bytes) -> bytes:
        """Piece ids as int32 bytes; a character without a piece becomes its bytes' tokens."""
        if self.unknown in ids and self.bytes_at:
            out, at = [], 0
            for i, n in zip(ids, lengths, strict=True):
                out += [i] if i != self.unknown else [self.bytes_at[c] for c in word[at : at + n]]
                at += n
            ids = out
        return np.array(ids, np.int32).tobytes()

    def best_path(self, word: bytes) -> tuple[list[int], list[int]]:
        """Viterbi over one word: piece ids and the bytes that each covers."""
        base, check, value = self.steps
        n = len(word)
        best, piece, size = [float("-inf")] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            if best[i] == float("-inf"):
                continue
            char = char_bytes(word[i])
            state, single = 0, False
            for j in range(i, n):
                nxt = base[state] + word[j]
                if check[nxt] != state:
                    break
                state = nxt
                if value[state] >= 0:
                    single |= j + 1 - i == char
                    if (s := best[i] + self.scores[value[state]]) > best[j + 1]:
                        best[j + 1], piece[j + 1], size[j + 1] = s, value[state], j + 1 - i
            if not single and (s := best[i] + self.unknown_score) > best[i + char]:
                best[i + char], piece[i + char], size[i + char] = s, self.unknown, char
        ids, lengths, at = [], [], n
        while at:
            ids.append(piece[at])
            lengths.append(size[at])
            at -= size[at]
        return ids[::-1], lengths[::-1]

    def best_paths(self, words: list[bytes]) -> list[bytes]:
        """Viterbi over many words of at most LOCKSTEP_BYTES bytes in lockstep -> each one's ids as int32 bytes."""
        n, length = len(words), np.array([len(w) for w in words])
        width = int(length.max())
        text = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width).astype(np.int64)
        best, piece, size = np.full((n, width + 1), -np.inf), np.zeros((n, width + 1), np.int32), np.zeros((n, width + 1), np.int32)
        best[:, 0] = 0
        char = CHAR_BYTES[text]
        for i in range(width):
            start = np.flatnonzero((length > i) & (best[:, i] > -np.inf))
            row, state = start, np.zeros(len(start), np.int64)
            single = np.zeros(n, bool)
            for j in range(i, width):
                inside = length[row] > j
                row, state = row[inside], state[inside]
                nxt = self.trie.base[state] + text[row, j]
                ok = self.trie.check[nxt] == state
                row, state = row[ok], nxt[ok]
                if not len(row):
                    break
                v = self.trie.value[state]
                hit = np.flatnonzero(v >= 0)
                r, v = row[hit], v[hit]
                single[r] |= char[r, i] == j + 1 - i
                s = best[r, i] + self.scores[v]
                up = s > best[r, j + 1]
                r = r[up]
                best[r, j + 1], piece[r, j + 1], size[r, j + 1] = s[up], v[up], j + 1 - i
            r = start[~single[start]]
            end = i + char[r, i]
            s = best[r, i] + self.unknown_score
            up = s > best[r, end]
            r, end = r[up], end[up]
            best[r, end], piece[r, end], size[r, end] = s[up], self.unknown, char[r, i]
        return self.spelled_back(words, length, piece, size)

    def spelled_back(self, words: list[bytes], length: np.ndarray, piece: np.ndarray, size: np.ndarray) -> list[bytes]:
        """Each word's ids as int32 bytes, from the last piece back to the first, in lockstep."""
        at, row, steps = length.copy(), np.flatnonzero(length), []
        count = np.zeros(len(words), np.int64)
        while len(row):
            steps.append((row, piece[row, at[row]]))
            count[row] += 1
            at[row] -= size[row, at[row]]
            row = row[at[row] > 0]
        ends = np.cumsum(count)
        ids = np.empty(int(count.sum()), np.int32)
        for k, (row, own) in enumerate(steps, 1):
            ids[ends[row] - k] = own
        flat, stops = ids.tobytes(), (ends * 4).tolist()
        made = [flat[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]
        if self.bytes_at:
            for k in np.unique(np.concatenate([row[own == self.unknown] for row, own in steps])).tolist() if steps else []:
                own = np.frombuffer(made[k], np.int32).tolist()
                lengths, end = [], int(length[k])
                while end:
                    lengths.append(int(size[k, end]))
                    end -= lengths[-1]
                made[k] = self.spelled(own, lengths[::-1], words[k])
        return made

    def encode_words(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Yields (word, ids as int32 bytes)."""
        short = sorted((w for w in words if len(w) <= LOCKSTEP_BYTES), key=len)
        for at in range(0, len(short), 8192):
            yield from zip(short[at : at + 8192], self.best_paths(short[at : at + 8192]), strict=True)
        for w in words:
            if len(w) > LOCKSTEP_BYTES:
                yield w, self.spelled(*self.best_path(w), w)

    def decode(self, ids: list[int]) -> str:
        whole = b"".join(map(self.text_of.__getitem__, ids))
        return whole.removeprefix(b" ").decode("utf-8", "replace")

    def decode_lists(self, lists: pa.ListArray) -> pa.Array:
        """decode() of each list, all at once. Null lists decode to the empty string."""
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy())])
        spelled = self.texts.take(lists.flatten())
        _, places, held = spelled.buffers()
        places = np.frombuffer(places or bytes(8), np.int64)[spelled.offset : spelled.offset + len(spelled) + 1][ends]
        whole = np.frombuffer(held or b"", np.uint8)[: places[-1]]
        filled = np.flatnonzero(places[1:] > places[:-1])
        led = filled[whole[places[filled]] == ord(" ")]
        if len(led):
            whole = np.delete(whole, places[led])
            places = places - np.searchsorted(led, np.arange(len(places)))
        made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(np.ascontiguousarray(places)), pa.py_buffer(whole)])
        try:
            return made.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:  # bytes that aren't UTF-8
            return pa.array([x.decode("utf-8", "replace") for x in made.to_pylist()], pa.string())


def char_bytes(first: int) -> int:
    return 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


CHAR_BYTES = np.array([char_bytes(b) for b in range(256)])


@lru_cache(maxsize=4)
def load_vocabulary(model: str, scores: str = "zipf") -> Vocabulary:
    """Read a SentencePiece .model file (a path that the driver can open)."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(model, "rb") as f:
        proto.ParseFromString(f.read())
    unigram = proto.trainer_spec.model_type == pb.TrainerSpec.UNIGRAM
    zipf = scores == "zipf" and not unigram
    return Vocabulary([(p.piece, -float(np.log(max(0.0, -p.score) + 1)) if zipf else p.score, p.type) for p in proto.pieces])


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Cache(dict):
    """Pre-token -> ids, for CACHE_ENTRIES pre-tokens of CACHED_BYTES at most; emptied when full."""

    def coded(self, vocabulary: Vocabulary, lists: list[list[bytes]]) -> list[bytes]:
        """The ids of each list's pre-tokens. Longer pre-tokens are forgotten after the call."""
        if len(self) > CACHE_ENTRIES:
            self.clear()
        new = list({w for words in lists for w in words if w not in self})
        self.update((w[1:], ids) for w, ids in vocabulary.encode_words([b" " + w for w in new]))
        made = [b"".join(map(self.__getitem__, words)) for words in lists]
        for w in new:
            if len(w) > CACHED_BYTES:
                del self[w]
        return made


@bounded
def encode(documents: DataFrame, model: str | None = None, scores: str = "zipf", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows with `text` -> the columns in keep, text, and ids (array<int>): the best path's tokens of the whole text."""
    sent = documents.sparkSession.sparkContext.broadcast(load_vocabulary(model or default_model(), scores))
    plain = documents.select(*keep, "text")
    schema = with_field(plain, "ids", T.ArrayType(T.IntegerType()))

    def make(batches):
        vocabulary, cache = sent.value, Cache()
        for batch in batches:
            own = texts(batch)
            for a, b in runs([len(x) for x in own], 4 << 20):
                coded = cache.coded(vocabulary, [pre_tokens(x) for x in own[a:b]])
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in coded])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), np.int32)))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, ids], [*part.schema.names, "ids"])

    return plain.mapInArrow(make, schema)


@bounded
def decode(coded: DataFrame, model: str | None = None, scores: str = "zipf") -> DataFrame:
    """Rows with `ids` -> the same rows with `decoded` (string). Null ids decode to the empty string."""
    sent = coded.sparkSession.sparkContext.broadcast(load_vocabulary(model or default_model(), scores))

    def make(batches):
        vocabulary = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                made = vocabulary.decode_lists(part.column("ids"))
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, "decoded"])

    return coded.mapInArrow(make, with_field(coded, "decoded", T.StringType()))


def round_trips(documents: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids, comma-joined), decoded_sha256, round_trip: the decoded text is the text.

    A literal marker character in a text decodes to a space, which counts as its own."""
    back = decode(encode(documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), model), model)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.replace("text", F.lit(MARK), F.lit(" "))).alias("round_trip"),
    )
