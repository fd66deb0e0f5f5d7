"""Short words are found by their bytes, and become strings only when they are new."""

import random

import numpy as np

from fwlens.llm import pretokens
from fwlens.llm.pretokens import TextEncoder, Words


class Watched(str):
    """A text that counts the words cut out of it."""

    cuts = 0

    def __getitem__(self, key):
        Watched.cuts += 1
        return super().__getitem__(key)


def code(words):
    """Ids by the words' code points, so every word has its own."""
    return np.array([ord(c) for w in words for c in w], np.uint32), np.array([len(w) for w in words], np.int64)


def test_known_short_words_do_not_become_strings():
    words, each = Words(code), ["one", " two", " three", " Ж", " " + "x" * 20]
    text = Watched("".join(each))
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(w) for w in each])
    at, counts = np.append(0, ends[:-1]), np.arange(1, 6)
    first = words.places_in(text, cp, at, ends, counts)
    assert Watched.cuts == 5 and sorted(first.tolist()) == [0, 1, 2, 3, 4]
    assert words.gather(first)[0].tolist() == code(each)[0].tolist()
    assert words.places_in(text, cp, at, ends, counts).tolist() == first.tolist()
    assert Watched.cuts == 7  # only the one beyond Latin-1 and the long one
    assert words.hits[first].tolist() == [2, 4, 6, 8, 10]


def test_places_of_many_words():
    rng = np.random.default_rng(3)
    low, high = np.unique(rng.integers(1, 1 << 63, 300_000).astype(np.uint64)), rng.integers(0, 3, 300_000).astype(np.uint64)
    high = high[: len(low)]
    table = pretokens.Places(low[:10], high[:10], np.arange(10, dtype=np.int32))
    for a in range(10, len(low), 70_000):
        table.add(low[a : a + 70_000], high[a : a + 70_000], np.arange(a, min(a + 70_000, len(low)), dtype=np.int32))
    assert table.find(low, high).tolist() == [*range(len(low))] and 2 * len(low) <= len(table.place)
    assert set(table.find(low, high + np.uint64(3)).tolist()) == {-1}
    assert sorted(table.entries()[2].tolist()) == [*range(len(low))]


def test_ids_stay_right_while_words_are_forgotten():
    rng = random.Random(4)
    encoder = TextEncoder(code)
    encoder.words.most = 60
    common = ["the", "of", "жук", "w" * 30, "a\0b"]
    for _ in range(60):
        texts = [" ".join(rng.choice(common) if rng.random() < 0.6 else "".join(rng.choices("ab\xe9\0Ж", k=rng.randint(1, 18))) for _ in range(rng.randint(0, 30))) for _ in range(6)]
        ids, counts = encoder.encode(texts)
        assert ids.tolist() == [ord(c) for t in texts for c in t] and counts.tolist() == [len(t) for t in texts]
    assert encoder.words.n < 300 and len(encoder.words.place) < 300
