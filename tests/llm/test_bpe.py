import hashlib
import random
from array import array

import pytest
from tokenizers import Tokenizer

from chronika.llm import bpe
from tests.llm.cases import none, odd, odd_rows


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_tokenizer_path())


@pytest.fixture(scope="module")
def mine():
    return bpe.ByteBpe(bpe.default_tokenizer_path())


def test_random_texts_equal_the_library(library, mine):
    rng = random.Random(1)
    parts = [*"ab 's\n\t\r\x0b\x1c\x1f\x85　 é中😀12.,<|>'̀\x00​½Ⅷ", "<|endoftext|>", "  ", "'re", "aaaa", "thetion"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == ids
        assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_long_words_take_the_same_merges(library, mine):
    rng = random.Random(2)
    for text in ("a" * 5000, "".join(rng.choice("thenigo") for _ in range(4000)), "é" * 700):
        assert mine.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_decoding_broken_bytes(library, mine):
    for ids in ([220], [447], [447, 220, 50256], list(range(200, 260))):
        assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_frames(spark, library):
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip_digests(odd(spark)).collect())
    want = []
    for i, t, *_ in odd_rows():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i or -1, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.round_trip_digests(none(spark)).count() == 0
    encoded = bpe.encode(odd(spark))
    back = bpe.decode(encoded)
    assert sorted((r.doc_id or -1, r.text) for r in back.collect()) == sorted((i or -1, t or "") for i, t, *_ in odd_rows())
