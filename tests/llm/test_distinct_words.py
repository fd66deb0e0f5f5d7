import random

import numpy as np

from fwlens.llm import pretokens


def test_words_are_told_apart():
    """Words of all lengths, with zeros and beyond Latin-1: equal numbers only for equal words, one number for each short one."""
    rng = random.Random(2)
    letters = "ab\0\xe9\u0101\U0001f600"
    words = ["".join(rng.choice("ab\xe9" if rng.random() < 0.7 else letters) for _ in range(rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 30]))) for _ in range(4000)]
    words += ["a" * 8, "a" * 8 + "b", "a" * 16, "a" * 17, "a", "a\0", "b" * 8 + "a" * 8] * 3
    cp = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(w) for w in words])
    at = np.append(0, ends[:-1])
    one, number = pretokens.distinct(cp, at, ends)
    assert [words[k] for k in one[number]] == words
    plain = [w for w in words if len(w) <= 16 and all(0 < ord(c) < 256 for c in w)]
    assert len(one) == len(set(plain)) + len(words) - len(plain) < len(words)
    assert [x.tolist() for x in pretokens.distinct(cp[:0], at[:0], ends[:0])] == [[], []]


def test_counts_of_words_met():
    words = pretokens.Words(lambda new: (np.arange(len(new), dtype=np.uint32), np.ones(len(new), np.int64)))
    words.places(["x", "y"], np.array([5, 1]))
    assert words.places(["x", "z"]).tolist() == [0, 2] and words.hits[:3].tolist() == [6, 1, 1]
