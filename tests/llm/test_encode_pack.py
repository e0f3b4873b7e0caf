import base64

import numpy as np
import pytest

from lodestone.llm.corpus_encode import count_tokens, decode_corpus, encode_corpus, tokenizer_path
from lodestone.llm.packing import pack, plan_patterns

TEXTS = [
    "Hello world, it's the   third\n\ntest 12345!",
    "",
    None,
    "   ",
    "Привет, мир! 你好世界 こんにちは",
    "naïve café — “quotes” … 👩‍💻 é  　x",
    "tabs\t\tand\r\nlines\r\n" * 50,
    "<|endoftext|> stays text",
    "Hello world, it's the   third\n\ntest 12345!",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string, word string")


def test_ids_equal_the_public_tokenizer(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    got = {r["doc_id"]: r["ids"] for r in encode_corpus(docs, tokenizer_path("byte_bpe_50k.tiktoken")).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}


def test_round_trip(docs):
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    back = {r["doc_id"]: r["text"] for r in decode_corpus(encode_corpus(docs, path), path).collect()}
    assert back == {i: x or "" for i, x in enumerate(TEXTS)}


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert encode_corpus(none, tokenizer_path("byte_bpe_50k.tiktoken")).count() == 0


def test_bytes_of_vocabulary_are_distinct():
    with open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
        assert len({base64.b64decode(x.split()[0]) for x in f}) == 50256


def test_plan_uses_every_length_once():
    rng = np.random.default_rng(3)
    counts = {int(x): int(n) for x, n in zip(range(1, 101), rng.integers(0, 40, 100))}
    plan = plan_patterns(counts, 100)
    used: dict[int, int] = {}
    for pattern, times in plan:
        assert sum(pattern) <= 100 and times > 0
        for x in pattern:
            used[x] = used.get(x, 0) + times
    assert used == {k: v for k, v in counts.items() if v}
    total = sum(k * v for k, v in counts.items())
    assert sum(t for _, t in plan) <= 1.04 * total / 100


def test_exact_complements_are_found():
    assert plan_patterns({7: 2, 2: 2, 1: 2}, 10) == [((7, 2, 1), 2)]


def test_pack_table(spark):
    rows = [(i, n) for i, n in enumerate([5, 5, 0, None, 3, 7, 25, 10, 2, 2, 2])]
    items = spark.createDataFrame(rows, "k int, size int")
    got = pack(items, 10, "k", "size").collect()
    fill: dict[int, int] = {}
    for r in got:
        fill[r["container"]] = fill.get(r["container"], 0) + r["length"]
    assert all(v <= 10 for v in fill.values())
    assert sum(fill.values()) == 61 and len(fill) == 7
    assert sorted((r["piece"], r["length"]) for r in got if r["k"] == 6) == [(0, 10), (1, 10), (2, 5)]
    assert not {r["k"] for r in got} & {2, 3}


def test_pack_nothing(spark):
    assert pack(spark.createDataFrame([], "k int, size int"), 10, "k", "size").count() == 0


def test_counts_equal_ids(docs, spark):
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    ids = {r["doc_id"]: len(r["ids"]) for r in encode_corpus(docs, path).collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in count_tokens(docs, path).collect()} == ids
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0
    assert {r["k"]: r["n_tokens"] for r in count_tokens(spark.createDataFrame([("a", None), ("b", ""), ("b", "")], "k string, text string"), path, "k").collect()} == {"a": 0, "b": 0}


def test_many_words_take_wide_indexes(spark):
    """A block of more than 65,536 distinct words."""
    text = " ".join(f"w{i:x}z" for i in range(70_000))
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    got = decode_corpus(encode_corpus(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string"), path), path)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: text, 2: "short"}
