import itertools
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from floorledger.llm.packing import CAPACITY, Runs, WordIds, pack_documents, pack_histogram, reduce_instance
from floorledger.llm.queries import vocabulary
from tests.llm.plain import documents


def bins_of(runs):
    bins = {}
    for length, _, count, each, first, offset in runs.rows:
        for n in range(count):
            bins.setdefault(first + n // each, []).append((offset + n % each * length, length))
    for pieces in bins.values():
        pieces.sort()
        ends = [0, *itertools.accumulate(length for _, length in pieces)]
        assert [at for at, _ in pieces] == ends[:-1]
    return bins


def fewest(sizes, capacity):
    best = len(sizes)

    def go(at, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if at == len(sizes):
            best = len(rooms)
            return
        for n in {room: n for n, room in enumerate(rooms) if room >= sizes[at]}.values():
            rooms[n] -= sizes[at]
            go(at + 1, rooms)
            rooms[n] += sizes[at]
        go(at + 1, [*rooms, capacity - sizes[at]])

    go(0, [])
    return best


def test_reduction_keeps_an_optimal_packing():
    chance = random.Random(3)
    for _ in range(400):
        capacity = chance.choice([10, 20, 30])
        sizes = sorted((chance.randint(chance.choice([1, capacity // 4]), capacity) for _ in range(chance.randint(1, 9))), reverse=True)
        histogram = {size: sizes.count(size) for size in sizes}
        runs, rest = Runs(), dict(histogram)
        reduce_instance(rest, runs, capacity)
        left = sorted((size for size, n in rest.items() for _ in range(n)), reverse=True)
        best = fewest(sizes, capacity)
        assert runs.bins + (fewest(left, capacity) if left else 0) == best
        packed = pack_histogram(histogram, capacity)
        filled = bins_of(packed)
        assert packed.bins == len(filled) and best <= packed.bins <= best + 1
        assert sorted((n for pieces in filled.values() for _, n in pieces), reverse=True) == sizes
        assert all(sum(n for _, n in pieces) <= capacity for pieces in filled.values())


def test_packing_work_does_not_grow_with_the_counts():
    few, many = ({n: k for n in range(1, CAPACITY + 1)} for k in (3, 3_000_000))
    assert len(pack_histogram(many).rows) < 3 * len(pack_histogram(few).rows)


@pytest.fixture(scope="module")
def texts():
    return [
        (1, None), (2, ""), (3, "Hello, world. Don't <|ENDOFTEXT|> <|endoftext|> x"), (4, "word " * 5000), (None, "no id"),
        (5, "Élan ﬁne µ ª straße\tÀ e\u0301 ΑΣ İ 漢字 😀 a1b2 --- ,. ._."), (6, "same"), (6, "same"), (7, "other text, same id."), (7, "!"),
        *[(100 + n, "some words, of varying number. " * (n % 40)) for n in range(120)],
    ]


def test_pieces_are_the_tokenizers_and_lie_gapless(spark, texts):
    rows = pack_documents(documents(spark, texts), vocabulary()).collect()
    tokenizer, wanted = Tokenizer.from_file(vocabulary()), []
    for doc_id, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), CAPACITY)):
            own = ids[at : at + CAPACITY]
            wanted.append((doc_id, piece, at, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes())))
    assert sorted((tuple(row)[:5] for row in rows), key=str) == sorted(wanted, key=str)
    sequences = {}
    for row in rows:
        sequences.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= CAPACITY
    total = sum(row.length for row in rows)
    assert len(sequences) <= -(-total // CAPACITY) + 1


def test_no_documents_no_sequences(spark):
    assert pack_documents(documents(spark, []), vocabulary()).collect() == []


def test_marks_after_words_are_encoded_once_and_the_file_read_once():
    words, calls = WordIds(vocabulary()), []
    encode = words.encode
    words.encode = lambda text: calls.append(text) or encode(text)
    text = "One, two, trois, élan. Quatre. five."
    ids = words.of_text(text)
    assert sorted(calls) == [",", "."]
    assert list(np.frombuffer(ids, dtype="<u4")) == words.tokenizer.encode(text, add_special_tokens=False).ids
    assert WordIds(vocabulary()).tokenizer is words.tokenizer
