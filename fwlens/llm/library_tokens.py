"""Ids of whole texts as the tokenizers library gives them, with each distinct word encoded once."""

from __future__ import annotations

import functools
import json

import numpy as np
from pyspark import Broadcast
from tokenizers import Tokenizer

from .pretokens import TextEncoder

#: words that go to the library in one text; a longer text costs it more time a word
TOGETHER = 200
# below this code point NFC changes nothing and lower case goes by single code points
PLAIN_BELOW = "İ"


@functools.lru_cache(4)
def library_encoder(content: str) -> TextEncoder:
    """For a byte-level vocabulary (blanks belong to words) or one with word ends (lower case, white space dropped).

    Stretches with code points whose class differs between versions of Unicode go to the library whole."""
    library = Tokenizer.from_str(content)
    library.no_truncation()
    library.no_padding()
    data = json.loads(content)
    bare = data["pre_tokenizer"]["type"] == "Sequence"
    normalizer, special = library.normalizer, {t["content"] for t in data["added_tokens"]}

    def one_by_one(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in library.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([t for x in found for t in x], np.uint32), np.array([len(x) for x in found], np.int64)

    def together(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words with line feeds between them: the library cuts them there, and says of each id which word it is of."""
        text = library.encode("\n".join(words), add_special_tokens=False)
        of, step = np.array(text.word_ids, np.int64), 1 if bare else 2
        if not len(of) or of[-1] != step * (len(words) - 1):
            return one_by_one(words)
        sizes = np.bincount(of, minlength=step * (len(words) - 1) + 1)
        return np.array(text.ids, np.uint32)[of % step == 0], sizes[::step]

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = [k for k, w in enumerate(words) if len(w) < 64 and "\n" not in w and not w.isspace() and w not in special]
        rest = sorted({*range(len(words))}.difference(plain))
        order, found = plain + rest, [one_by_one([words[k] for k in rest])] if rest else []
        groups = [together([words[k] for k in plain[a : a + TOGETHER]]) for a in range(0, len(plain), TOGETHER)]
        ids, sizes = (np.concatenate(x) for x in zip(*groups, *found, strict=True))
        # back to the order of the words
        begin, back = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        begin[order], back[order] = np.cumsum(sizes) - sizes, sizes
        shift = np.repeat(begin - np.cumsum(back) + back, back)
        return ids[shift + np.arange(len(shift))], back

    def normalize(text: str) -> str:
        return text.lower() if text.isascii() or max(text) < PLAIN_BELOW else normalizer.normalize_str(text)

    return TextEncoder(encode, bare=bare, special=sorted(special), normalize=normalize if normalizer else None)


def encoder_of(content: Broadcast) -> TextEncoder:
    return library_encoder(content.value)
