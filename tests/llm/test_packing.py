"""Ids of long white space against the library that the ids are defined by, and serial packing."""

import pytest

from quarry.llm import packing
from quarry.llm.queries import ranks_file


@pytest.fixture(scope="module")
def both():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.Encoder(ranks_file()), lambda t: whole.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("blank", [" ", "\n", "\t", "\r\n", " \n", " ", "　 "])
@pytest.mark.parametrize("after", ["", "x", "9", "!", "<|endoftext|>", "\x1f", "​"])
def test_runs_of_white_space(both, blank, after):
    encoder, ids = both
    for count in (packing.LONG_RUN - 1, packing.LONG_RUN, packing.LONG_RUN + 1, 30_000):
        text = "word" + blank * count + after + " more  \n text" + blank * (count + 3)
        assert encoder.encode(text) == ids(text), (blank, after, count)


@pytest.mark.parametrize("blank, count", [(" ", 5_000_000), ("\n", 5_000_000), ("\t ", 1_000_000), (" ", 1_000_000)])
def test_millions_of_white_space(both, blank, count):
    encoder, ids = both
    text = f"a{blank * count}b c"
    assert encoder.encode(text) == ids(text)


def test_long_texts_of_other_kinds(both):
    encoder, ids = both
    for part in ("word ", "a", "1", "!?", "é", "漢", "it's ", "\U0001d4b3 ", "<|endoftext|> \n"):
        text = part * 40_000
        assert encoder.encode(text) == ids(text), part


def serial(lengths, capacity):
    """Each piece where the sum of squared counts becomes smallest, by trying every sequence."""
    sequences, out = [], []
    for size in lengths:
        best = None
        for gap in sorted({0, *(capacity - used for used in sequences if used < capacity)}):
            # gap 0: a new sequence
            count = {}
            for used in sequences:
                count[capacity - used] = count.get(capacity - used, 0) + 1
            if gap and gap < size:
                continue
            if gap:
                count[gap] -= 1
            left = (gap or capacity) - size
            count[left] = count.get(left, 0) + 1
            cost = sum(n * n for g, n in count.items() if g)
            rank = (cost, gap == 0, gap)
            if best is None or rank < best:
                best = rank
        gap = best[2]
        out.append(capacity - gap if gap else 0)
        if gap:
            sequences[sequences.index(capacity - gap)] += size
        else:
            sequences.append(size)
    return out, len(sequences)


@pytest.mark.parametrize("seed", range(4))
def test_places_are_those_of_a_serial_search(seed):
    import numpy as np

    lengths = np.random.default_rng(seed).integers(1, 21, 120)
    sequence, offset = packing.place(lengths, 20)
    want, count = serial(lengths.tolist(), 20)
    assert offset.tolist() == want and len(set(sequence.tolist())) == count
