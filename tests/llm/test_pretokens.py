import random

import pyarrow as pa
import pytest

from lodestone.llm import pretokens

ALPHABET = [
    "'", "s", "t", "re", "ll", "ve", "d", "m", " ", "  ", "\n", "\t", "a", "é", "1", "²", "日", "　", " ", "!", "—", "👩", "\r\n", "x", "S", "'S", "\x1c", "\x85", "\0",
]


def cut(texts):
    out = []
    for _, _, counts, words in pretokens.blocks(pa.array(texts, pa.string())):
        own, k = words.to_pylist(), 0
        for n in counts:
            out.append(own[k : k + n])
            k += n
    return out


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_equal_to_the_pattern(monkeypatch, size):
    import public_tokenizers
    import regex

    monkeypatch.setattr(pretokens, "BLOCK_BYTES", size)
    rng = random.Random(size)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randrange(14))) for _ in range(4000)] + [None, "", "   ", "'", "'s", "x'r", "a" * 100_000]
    pattern = regex.compile(public_tokenizers.PATTERN)
    assert cut(texts) == [pattern.findall(x or "") for x in texts]


def test_sliced_and_empty_arrays():
    own = pa.array(["skip me", "two words", None, "", "end"], pa.string())
    assert cut(own.slice(1)) == [["two", " words"], [], [], ["end"]]
    assert cut([]) == [] and cut([None, ""]) == [[], []]
