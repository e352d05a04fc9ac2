"""Pieces of whole batches: lists of ids decode, and paths are spelled, as one by one, at a fraction of the cost."""

import random
import time

import pyarrow as pa
import pytest

from wavelake.llm.pieces import LOCKSTEP_BYTES, default_model, load_vocabulary


@pytest.fixture(scope="module")
def vocabulary():
    return load_vocabulary(default_model())


def test_lists_decode_as_each_does(vocabulary):
    """Any ids, bytes that aren't UTF-8, null and empty lists, spaces in front, and slices."""
    rng = random.Random(3)
    ids = [[rng.randrange(len(vocabulary.text_of)) for _ in range(rng.randrange(7))] if rng.random() > 0.1 else None for _ in range(3000)]
    ids += [[i] for i in [*range(300), *vocabulary.bytes_at.values()]]
    ids += [[vocabulary.bytes_at[b] for b in "  é😀".encode()], [vocabulary.bytes_at[0xFF], vocabulary.bytes_at[0x20]], None, []]
    for lists in (ids, [x for x in ids if b"\xef" not in b"".join(map(vocabulary.text_of.__getitem__, x or []))], [], [None], [[], None]):
        column, want = pa.array(lists, pa.list_(pa.int32())), [vocabulary.decode(x or []) for x in lists]
        assert vocabulary.decode_lists(column).to_pylist() == want
        assert vocabulary.decode_lists(column.slice(5, 90)).to_pylist() == want[5:95]


def test_words_in_lockstep_have_their_own_best_paths(vocabulary):
    rng = random.Random(5)
    words = [(" " + "".join(rng.choice("aбé😀中\x00\x7fxqthe") for _ in range(rng.randrange(16)))).encode() for _ in range(2000)] + [b" "]
    words = [w for w in words if len(w) <= LOCKSTEP_BYTES]
    assert vocabulary.best_paths(words) == [vocabulary.spelled(*vocabulary.best_path(w), w) for w in words]


def test_lists_cost_a_fraction(vocabulary):
    rng = random.Random(7)
    column = pa.array([[rng.randrange(300, len(vocabulary.text_of)) for _ in range(500)] for _ in range(1000)], pa.list_(pa.int32()))
    start = time.process_time()
    made = vocabulary.decode_lists(column)
    batch = time.process_time() - start
    want = [vocabulary.decode(x) for x in column.to_pylist()]
    assert made.to_pylist() == want and batch < 0.25 * (time.process_time() - start - batch)
