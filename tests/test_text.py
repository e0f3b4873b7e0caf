import hashlib

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.functions.stemmer import stem_russian, stemmed
from lodestone.operators.search import path_matches, terms_of


def values(spark, rows, f):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r["o"] for r in df.select("i", f(F.col("t")).alias("o")).orderBy("i").collect()]


def test_tokens(spark):
    cases = {
        "getUserById": ["get", "user", "by", "id"],
        "get_user_by_id": ["get", "user", "by", "id"],
        "получить пользователя": ["получить", "пользователя"],
        "a b c": [],
        "ab cde": ["ab", "cde"],
        "HTTPServer2": ["http", "server"],
        "__init__": ["__", "init", "__"],
        "sha256Sum": ["sha", "256", "sum"],
        "getПользователь1": ["getпользователь1"],
        "İstanbul ΟΔΟΣ": ["istanbul", "οδοσ"],
        "я": ["я"],
        "": [],
        None: [],
    }
    assert values(spark, list(cases), text.tokens) == list(cases.values())


def test_query_terms_keep_their_order(spark):
    assert terms_of(spark, "user getUser Get id") == ["user", "get", "id"]


def test_stemmer(spark):
    assert stem_russian("получить") == "получ"
    assert stem_russian("пользователя") in ("пользовател", "пользователь")
    for word, stem in (("вагонами", "вагон"), ("важнейшие", "важн"), ("валяется", "валя"), ("красивейшая", "красив"), ("крестьянин", "крестьянин"), ("программный", "программн")):
        assert stem_russian(word) == stem
    assert values(spark, ["getUser получить"], lambda c: stemmed(text.tokens(c))) == [["get", "user", "получ"]]


def test_embedding_safe(spark):
    rows = ["", "plain text", "a\0b", "Привет 世界", "\x01\x02\x03ab", "x" * 9 + "\x01", "tab\tand\nline"]
    assert values(spark, rows, text.embedding_safe) == [True, True, False, True, False, True, True]
    assert values(spark, ["ok"], lambda c: text.embedding_safe_bytes(F.unhex(F.lit("ff61")))) == [False]


def test_small_functions(spark):
    assert values(spark, ["привет", ""], lambda c: text.truncate_runes(c, 3)) == ["при", ""]
    assert values(spark, ["привет"], lambda c: text.truncate_runes(c, 0)) == ["привет"]
    assert values(spark, [" a, ,b,"], text.split_comma) == [["a", "b"]]
    assert values(spark, ["/x"], text.data_dir_name) == [hashlib.sha256(b"/x").hexdigest()[:16]]


@pytest.mark.parametrize(
    "kw, want",
    [
        ({}, [True, True, True]),
        ({"contains": "src"}, [True, False, True]),
        ({"extensions": ["go"]}, [True, False, True]),
        ({"extensions": [""]}, [False, False, False]),
        ({"exclude": [""]}, [False, False, False]),
        ({"exclude": ["b/"], "extensions": [".py", "go"]}, [True, False, True]),
    ],
)
def test_path_matches(spark, kw, want):
    assert values(spark, ["src/a.go", "b/c.py", "src/cargo"], lambda c: path_matches(c, **kw)) == want
