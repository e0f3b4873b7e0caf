import dataclasses
import random

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm.line_features import lines_of
from lodestone.llm.stuffed_pages import STATES, TEMPER, Model, count_lines, find_stuffed, fit_on

PROSE = "We measured the cache on 40 files and saw no change. Run the indexer again after you move the folder.\n\nWhy does it load twice? The old reader stays open until the index has moved."
SPAM = {
    "keywords": "\n".join(["best code search", "free code tool", "Best Code Search", "code snippets free"] * 12),
    "separated": " • ".join(["best code search", "free tool", "index engine", "Vector Price"] * 10),
    "links": "\n".join(f"[cheap tool {i}](http://x-{i}.example/p)\nhttps://www.y{i}.test/?ref={i}" for i in range(15)),
    "tags": "Tags: " + ", ".join(["cache", "reader", "writer", "best tool", "index"] * 12),
    "hashtags": " ".join(f"#{w}" for w in ["cache", "reader", "best_tool", "index"] * 12),
    "cities": "; ".join(f"code search {c}" for c in ["Tamblin", "Redfen", "Kirova", "Norwick"] * 8),
    "sentences": "Looking for code search? Our code search is the best code search for index tools. Get code search today and forget index tools. " * 6,
    "offers": "\n".join(f"Loader tool pro {i}.99 in stock: cache, reader, index" for i in range(20)),
}
FINE = {
    "prose": PROSE,
    "log": "\n".join(f"2025-01-01T10:{i:02d}:00Z INFO cache: reader done" for i in range(30)),
    "table": "| a | rows | ms |\n|---|---|---|\n" + "\n".join(f"| x_{i} | {i} | 3.2 |" for i in range(20)),
    "code": "import re\n\nSTOP_WORDS = {\n" + '    "cache", "reader", "index", "writer",\n' * 12 + "}\n\ndef f(a):\n    return a\n",
    "options": "Usage:\n" + "\n".join(f"  --opt-{i}  Sets the size of the cache before it runs." for i in range(12)),
    "described": "\n".join(f"- [tool {i}](http://x.example/{i}): It reads the index and keeps a copy of every file." for i in range(12)),
    "contents": "## Contents\n\n" + "\n".join(f"{i}. [open the cache](#s{i})" for i in range(9)) + "\n\n" + PROSE,
    "one form": "Where is the log of the cache? Where is the log of the reader? Where is the log of the index?",
    "short": "ok",
}


@pytest.fixture(scope="module")
def pages():
    """Invented pages of each sort to fit on, as the rules label them."""
    rng = random.Random(3)
    nouns = "cache reader writer index folder loader frame worker shard ledger parser buffer window ticket planner".split()
    words = lambda k: rng.choices(nouns, k=k)
    prose = lambda: f"We measured the {words(1)[0]} on {rng.randrange(90)} files and it is not in the {words(1)[0]} of the {words(1)[0]}."
    key = lambda: f"{words(1)[0]} {words(1)[0]} tool"

    def pitch():
        k, other = key(), key()
        return f"Looking for {k}? Our {k} is the best {k} for {other}. Get {k} today and forget other {other}. " * rng.randrange(2, 6)

    kinds = [
        lambda: "\n".join(prose() for _ in range(6)),
        lambda: "\n".join(f"https://www.{'-'.join(words(2))}.test/{w}" if i % 2 else w.title() + " Page" for i, w in enumerate(words(20))),
        lambda: "\n".join(f"[{key()}](http://{'-'.join(words(2))}.example/{w})" for w in words(12)),
        lambda: "Tags: " + ", ".join(words(20)) + "\nRelated: " + ", ".join(key() for _ in range(8)),
        lambda: " ".join(f"#{w}" for w in words(20)),
        lambda: " • ".join(key() for _ in range(12)),
        lambda: "\n".join(key() for _ in range(24)),
        lambda: "\n".join(f"{w.title()} pro {i}.99 in stock: {', '.join(words(3))}" for i, w in enumerate(words(12))),
        pitch,
        lambda: "import re\n\n" + "\n".join(f"def {w}(a):\n    return {w}_{i}(a, {i})\n" for i, w in enumerate(words(6))) + "X = {\n" + '    "cache", "reader", "index",\n' * 4 + "}\n",
        lambda: "\n".join(f"2025-01-01T10:{i:02d}:00Z INFO {w}: {words(1)[0]} done" for i, w in enumerate(words(15))),
        lambda: "| a | rows | ms |\n|---|---|---|\n" + "\n".join(f"| {w}_{i} | {i} | 3.2 |" for i, w in enumerate(words(12))),
        lambda: "\n".join(f"- [{w} {i}](http://x.example/{i}): It reads the {words(1)[0]} and keeps a copy of every {words(1)[0]}." for i, w in enumerate(words(8))),
        lambda: "Usage:\n" + "\n".join(f"  --{w}-{i}  Sets the size of the {words(1)[0]} before it runs." for i, w in enumerate(words(8))),
        lambda: "## Contents\n\n" + "\n".join(f"{i}. [open the {w}](#s{i})" for i, w in enumerate(words(6))) + "\n\n" + prose() + "\n\n# A title\n\n" + prose(),
        lambda: f"# {key()}\n\n{prose()}\n\n" + " ".join(f"Where is the log of the {w}?" for w in words(5)),
        lambda: rng.choice(["ok", "done", "fixed", "Fix the " + words(1)[0], "a" * rng.randrange(1, 90)]),
    ]
    often = [1 if 1 <= i <= 8 else 4 for i in range(len(kinds))]
    return [f() for f in [*kinds, *rng.choices(kinds, often, k=600)]]


@pytest.fixture(scope="module")
def model(pages):
    return Model.of_counts(*count_lines(pa.array(pages)))


def share(model, text):
    return sum(float(x) for lines in lines_of(pa.array([text])) for x in model.shares(lines))


@pytest.mark.parametrize("name", SPAM)
def test_spam(model, name):
    assert share(model, SPAM[name]) > 0.5
    assert share(model, "# A title\n\n" + SPAM[name] + "\n\nIt took 4 ms with a warm cache.") > 0.5


@pytest.mark.parametrize("name", FINE)
def test_fine(model, name):
    assert share(model, FINE[name]) <= 0.5


def test_transitions_carry_labels_over(model):
    """Lines that say nothing by themselves take the label of those around them."""
    links = "\n".join(f"https://www.a{i}.test/" for i in range(6))
    text = links + "\nCopper Page\n" + links
    none = dataclasses.replace(model, move=np.zeros_like(model.move), start=np.zeros_like(model.start))
    of = lambda m, t: [STATES[s] for lines in lines_of(pa.array([t])) for s in m.states(lines)]
    line = "A copper page."
    text = text.replace("Copper Page", line)
    assert of(model, text)[6] != of(model, PROSE + "\n" + line)[-1] and of(none, text)[6] == of(none, PROSE + "\n" + line)[-1]


def test_texts_step_together_as_alone(model, pages):
    """All pages at once, in blocks of any size, come out as one by one; a plain Viterbi agrees."""
    alone = [share(model, p) for p in pages[:60]]
    together = np.concatenate([model.shares(lines) for lines in lines_of(pa.array(pages[:60]))])
    assert together == pytest.approx(alone)
    for page in pages[:40]:
        (lines,) = lines_of(pa.array([page]))
        emit = [sum(model.emit[f][v] for f, v in enumerate(row)) * TEMPER * (1 + min(5, w // 12)) for row, w in zip(lines.features, lines.words)]
        score, back = model.start + emit[0], []
        for e in emit[1:]:
            ways = score[:, None] + model.move
            back.append(ways.argmax(0))
            score = ways.max(0) + e
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        assert model.states(lines).tolist() == path[::-1]


def test_lines(model):
    texts = ["\n\r\n \n", None, "", "a b\r\nc\u2028d", "e"]
    (lines,) = lines_of(pa.array(texts, pa.string()))
    assert [bytes(lines.data[a:b]).decode().strip("\r\n\u2028") for a, b in zip(lines.begin, lines.end)] == ["a b", "c", "d", "e"]
    assert lines.text.tolist() == [3, 3, 3, 4] and lines.words.tolist() == [2, 1, 1, 1] and list(lines_of(pa.array([], pa.string()))) == []
    assert sum(len(x.text) for x in lines_of(pa.array([None, ""], pa.string()))) == 0


def test_fit_and_find(spark, pages):
    docs = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "doc_id long, text string")
    fitted = fit_on(docs)
    rows = [(1, SPAM["links"]), (1, SPAM["links"]), (2, PROSE), (3, None), (4, ""), (5, " \n\t"), (6, "a" * 500_000), (7, SPAM["tags"][:80])]
    df = spark.createDataFrame([(*r, 0.9) for r in rows], "doc_id long, text string, share double")
    assert {r["doc_id"] for r in find_stuffed(df, fitted).collect()} == {1, 7}
    assert find_stuffed(df.where("false"), fitted).count() == 0
    empty = fit_on(docs.where("false"))
    assert find_stuffed(df, empty).count() == 0
