"""Code points that Python's Unicode does not know yet, but the library's may."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fwlens.llm import bpe
from fwlens.llm.library_tokens import library_encoder


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_letters_of_newer_versions(name):
    path = public_tokenizers.path(name)
    texts = ["A\U00013460", "it's \U00013460b 7\U00013461 c", "plain words", "\U000105c0\U000105c1 x͸y", "﷐a"]
    library = Tokenizer.from_file(path)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    ids, counts = library_encoder(bpe.read_vocabulary(path)).encode(texts)
    assert ids.tolist() == sum(want, []) and counts.tolist() == [len(x) for x in want]


def test_letters_of_newer_versions_in_op10():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["A\U00013460", "it's \U00013460b 7\U00013461 c"]
    ids, _ = bpe.coder(bpe.read_vocabulary(path))[1].encode(texts)
    library = Tokenizer.from_file(path)
    assert ids.tolist() == sum((library.encode(t, add_special_tokens=False).ids for t in texts), [])
