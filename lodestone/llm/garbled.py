"""Find text that was decoded with a wrong character encoding, and restore it.

A record's unit is the stretch: the words of one line that hold characters
outside ASCII. A multinomial classifier on hashed byte bigrams is fitted to
stretches of a bounded sample of rows and to synthetically garbled copies of
them, one class for each encoding chain and one for sound text. Every stretch
of every row is then classified; the predicted chain is inverted and must
decode strictly, otherwise the next likelier class is taken.

Defined cases: null or empty text is sound; a replacement character makes a
stretch garbled but not restorable; repeated rows give a result each (queries
drop them); columns besides key and text are ignored; without any stretch in
the sample the classifier knows only its seed sentences.
"""

from __future__ import annotations

import codecs
import functools
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import default_parallelism

#: Rows that the classifier is fitted on at most (documented bound; the least by hash).
SAMPLE_ROWS = 8000
#: Hash buckets of the bigram features, and smoothing.
BUCKETS, ALPHA = 1 << 14, 0.05
SOUND, LOST = "sound", "lost"
#: How a text came to be read: (encoding of its bytes, encoding that read them), in order.
CHAINS: dict[str, tuple[tuple[str, str], ...]] = {
    "utf8>cp1252": (("utf-8", "cp1252*"),),
    "utf8>latin1": (("utf-8", "latin-1"),),
    "utf8>cp1252 twice": (("utf-8", "cp1252*"), ("utf-8", "cp1252*")),
    "utf8>latin1 twice": (("utf-8", "latin-1"), ("utf-8", "latin-1")),
    "utf8>cp1251 twice": (("utf-8", "cp1251*"), ("utf-8", "cp1251*")),
    "utf8>mac": (("utf-8", "mac_roman"),),
    "utf8>cp437": (("utf-8", "cp437"),),
    "utf8>cp850": (("utf-8", "cp850"),),
    "utf8>cp1250": (("utf-8", "cp1250*"),),
    "utf8>cp1251": (("utf-8", "cp1251*"),),
    "utf8>cp866": (("utf-8", "cp866"),),
    "utf8>koi8": (("utf-8", "koi8_r"),),
    "utf8>latin2": (("utf-8", "iso8859_2"),),
    "utf8>latin9": (("utf-8", "iso8859_15"),),
    "utf8>cyrillic": (("utf-8", "iso8859_5"),),
    "utf8>cp1254": (("utf-8", "cp1254*"),),
    "utf8>gbk": (("utf-8", "gb18030"),),
    "utf8>sjis": (("utf-8", "cp932"),),
    "cp1251>cp1252": (("cp1251", "cp1252*"),),
    "cp1251>koi8": (("cp1251", "koi8_r"),),
    "cp1251>cp866": (("cp1251", "cp866"),),
    "koi8>cp1251": (("koi8_r", "cp1251*"),),
    "koi8>cp1252": (("koi8_r", "cp1252*"),),
    "cp866>cp1251": (("cp866", "cp1251*"),),
    "cp866>cp1252": (("cp866", "cp1252*"),),
    "cp1252>cp1251": (("cp1252", "cp1251*"),),
    "cp1252>cp437": (("cp1252", "cp437"),),
    "cp1252>mac": (("cp1252", "mac_roman"),),
    "mac>cp1252": (("mac_roman", "cp1252*"),),
    "sjis>cp1252": (("cp932", "cp1252*"),),
    "eucjp>cp1252": (("euc_jp", "cp1252*"),),
    "gbk>cp1252": (("gb18030", "cp1252*"),),
}
#: Sound sentences that every fit starts from.
SEEDS = (
    "Съешь ещё этих мягких французских булок да выпей чаю",
    "Ошибка при чтении файла, проверьте путь и повторите попытку",
    "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich",
    "Dès Noël où un zéphyr haï me vêt de glaçons würmiens, à côté",
    "À noite, vovô Kowalsky vê o ímã cair no pé do pinguim, não há ligações",
    "OPÇÃO INFORMAÇÃO SITUAÇÃO ÜBERSICHT ÉCOLE ÀÉÈÊ",
    "El pingüino Wenceslao hizo kilómetros bajo exhaustiva lluvia y frío, añoraba",
    "敏捷的棕色狐狸跳过懒狗 请检查文件 重试 配置 更新 删除",
    "いろはにほへと ちりぬるを ファイルを読み込みました 設定 更新",
    "naïve café – “quoted” ‘single’ … 20 °C × 3 µs → ± § € © ® ™",
)
_WORDS = re.compile(r"[^\x00-\x7f]+(?:[\x20-\x7e]?[^\x00-\x7f]+)*")
_LETTERS = re.compile(r"\S*[^\x00-\x7f]\S*", re.ASCII)
_PLAIN = re.compile(r"[\x00-\x40\x5b-\x60\x7b-\x7f]+")


@functools.lru_cache(maxsize=None)
def _loose(name: str) -> tuple[str, object]:
    """A single-byte code page whose undefined bytes stand for themselves, as readers do: to decode and to encode by."""
    there = [bytes([b]).decode(name, "replace") for b in range(256)]
    table = "".join(chr(b) if c == "\ufffd" else c for b, c in enumerate(there))
    return table, codecs.charmap_build(table)


def _read(data: bytes, enc: str) -> str:
    return codecs.charmap_decode(data, "strict", _loose(enc[:-1])[0])[0] if enc.endswith("*") else data.decode(enc)


def _bytes(text: str, enc: str) -> bytes:
    return codecs.charmap_encode(text, "strict", _loose(enc[:-1])[1])[0] if enc.endswith("*") else text.encode(enc)


def garble(text: str, chain: str) -> str | None:
    """``text`` as the chain would have read it, or None where it can't have."""
    try:
        for own, read in CHAINS[chain]:
            text = _read(_bytes(text, own), read)
    except UnicodeError:
        return None
    return text


def invert(text: str, chain: str) -> str | None:
    """The text before the chain, or None where its bytes don't decode strictly."""
    try:
        for own, read in reversed(CHAINS[chain]):
            text = _bytes(text, read).decode(own)
    except UnicodeError:
        return None
    return text


def stretch(line: str) -> str:
    """The words of a line that hold characters outside ASCII."""
    return " ".join(_LETTERS.findall(line))


def _shape(line: str) -> str:
    """A line's stretch with everything ASCII but letters made a space."""
    return " ".join(_PLAIN.sub(" ", stretch(line)).split(" "))


def _core(s: str) -> str:
    return " ".join(_WORDS.findall(s))


#: The seeds as stretches, each counting as five lines.
SEEDED = {_shape(x): 5 for x in SEEDS}


def features(s: str) -> np.ndarray:
    b = np.frombuffer(f" {s} ".encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.int64)
    pair = b[:-1] * 256 + b[1:]
    pair = pair[(pair & 0x8080) != 0]
    return (pair * 40503 >> 2) & (BUCKETS - 1)


#: Classes of the classifier, the sound one first.
CLASSES = [SOUND, *CHAINS]


def trustworthy(s: str) -> bool:
    """A stretch to fit on: nothing lost, and no chain through UTF-8 that its words could have come by."""
    return "\ufffd" not in s and not any(invert(_core(s), c) for c in CHAINS if c.startswith("utf8"))


def count_bigrams(sound: Iterable[tuple[str, int]]) -> np.ndarray:
    """Bigrams of sound stretches with their counts, and of their garblings: a row for each of CLASSES."""
    counts = np.zeros((len(CLASSES), BUCKETS))
    for s, n in sound:
        for k, chain in enumerate(CLASSES):
            text = s if chain == SOUND else garble(s, chain)
            if text is not None and (k == 0 or text != s):
                np.add.at(counts[k], features(text), n)
    return counts


class Classifier:
    """Multinomial over hashed byte bigrams; ``weights`` has a row for each class."""

    def __init__(self, classes: list[str], weights: np.ndarray, prior: np.ndarray):
        self.classes, self.weights, self.prior = classes, weights, prior

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Classifier:
        """From the counts of each class's bigrams (a row for each of CLASSES)."""
        own = counts + ALPHA
        prior = np.full(len(CLASSES), np.log(1e-3))
        prior[0] = 0.0
        return cls(CLASSES, np.log(own / own.sum(1, keepdims=True)).astype(np.float32), prior)

    @classmethod
    def fit(cls, sound: dict[str, int]) -> Classifier:
        return cls.of_counts(count_bigrams(sound.items()))

    @classmethod
    def fit_cleaned(cls, lines: dict[str, int]) -> Classifier:
        """Fit on stretches and their counts, drop what the fit calls garbled, fit again."""
        kept = {x: n for x, n in lines.items() if trustworthy(x)}
        model = cls.fit(kept | SEEDED)
        return cls.fit({x: n for x, n in kept.items() if model.chain(x) == SOUND} | SEEDED)

    def chain(self, s: str) -> str:
        """The likeliest class whose inverse decodes strictly."""
        if "\ufffd" in s:
            return LOST
        core = _core(s)
        scores = self.weights[:, features(s)].sum(1) + self.prior
        for k in np.argsort(-scores, kind="stable"):
            name = self.classes[k]
            if name == SOUND:
                return SOUND
            back = invert(core, name)
            if back is None:
                if self._in_a_run(core, k):
                    return name
            elif back != core and _plausible(back) and (name.startswith("utf8") or self._sounder(back, core)):
                return name
        return SOUND

    def _sounder(self, back: str, core: str) -> bool:
        """Whether the inverse reads sounder than the stretch, a bigram on average; between single-byte pages everything decodes."""
        a, b = self.weights[0, features(back)], self.weights[0, features(core)]
        return len(a) > 0 and (len(b) == 0 or a.mean() > b.mean())

    def _in_a_run(self, core: str, k: int) -> bool:
        """Whether a run of a stretch of class ``k`` that was cut or altered elsewhere decodes, and is of that class by itself."""
        for run in core.split(" "):
            back = invert(run, self.classes[k])
            if back and back != run and _plausible(back):
                own = self.weights[:, features(run)].sum(1) + self.prior
                if own[k] > own[0]:
                    return True
        return False

    def restore(self, line: str, chain: str) -> str | None:
        """The line with each garbled word set right; None where that fails."""
        if chain not in CHAINS:
            return None
        whole = invert(line, chain)
        if whole is not None:
            return whole
        parts = [(m.start(), m.end(), invert(m.group(), chain)) for m in _WORDS.finditer(line)]
        if any(p[2] is None for p in parts):
            return None
        out, at = [], 0
        for a, b, text in parts:
            out += [line[at:a], text]
            at = b
        return "".join([*out, line[at:]])


def _plausible(text: str) -> bool:
    return not any(c < " " and c not in "\t\r\n" or "\x7f" <= c < "\xa0" or c == "\ufffd" for c in text)


def _memo(model: Classifier) -> Callable[[str], str]:
    known: dict[str, str] = {}

    def chain(line: str) -> str:
        s = _shape(line)
        got = known.get(s)
        if got is None:
            if len(known) > 200_000:
                known.clear()
            got = known[s] = model.chain(s)
        return got

    return chain


def fit_on(texts: DataFrame, key: str, text: str) -> Classifier:
    """Fit on the stretches of the SAMPLE_ROWS rows with the least key hashes.

    The bound on the hash is found from the keys alone, so texts of rows
    outside the sample never leave their scan. Stretches are counted and
    garbled on the executors; what reaches the driver is a number for each
    class and bucket, however long the rows are.
    """
    spark = texts.sparkSession
    h = F.xxhash64(key)
    least = texts.select(h.alias("h")).orderBy("h").limit(SAMPLE_ROWS).agg(F.max("h")).first()[0]
    if least is None:
        return Classifier.fit_cleaned({})
    rows = texts.where((h <= least) & F.col(text).rlike(r"[^\x00-\x7f]")).select(text)
    parts = default_parallelism(spark)
    lines = rows.mapInArrow(_stretches, "s string, n long").repartition(parts, "s").groupBy("s").agg(F.sum("n").alias("n"))

    def counted(which: Callable[[str], bool]) -> np.ndarray:
        """Bigrams of the trustworthy stretches that ``which`` takes."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros((len(CLASSES), BUCKETS))
            for batch in batches:
                pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                counts += count_bigrams((s, n) for s, n in pairs if trustworthy(s) and which(s))
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts.reshape(-1)[at])], names=["at", "n"])

        table = lines.mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        total = np.zeros((len(CLASSES), BUCKETS))
        total.reshape(-1)[np.asarray(table["at"])] = np.asarray(table["n"])
        return total

    everything = counted(lambda s: True) + count_bigrams(SEEDED.items())
    first = spark.sparkContext.broadcast(Classifier.of_counts(everything))  # classes x BUCKETS floats, whatever the data
    return Classifier.of_counts(everything - counted(lambda s: first.value.chain(s) != SOUND))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of a batch of texts and how often each is there."""
    for batch in batches:
        seen = Counter(_shape(x) for text in batch.column(0).to_pylist() for x in text.split("\n") if not x.isascii())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["s", "n"])


def find_garbled(texts: DataFrame, model: Classifier, keys: list[str], text: str, restored: bool = False) -> DataFrame:
    """Rows with at least one garbled stretch: ``keys`` and the number of such lines.

    With ``restored`` also the text with every line set right that can be, and
    how many could not.
    """
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(model)  # classes x BUCKETS floats, whatever the data
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = _memo(shared.value)
        for batch in batches:
            at, lines_bad, whole, lost = [], [], [], []
            for i, value in enumerate(batch.column(n).to_pylist()):
                bad, left, out = 0, 0, None
                lines = value.split("\n")
                for j, line in enumerate(lines):
                    if not line.isascii() and (c := chain(line)) != SOUND:
                        bad += 1
                        if restored:
                            good = shared.value.restore(line, c)
                            left += good is None
                            out = out or list(lines)
                            out[j] = line if good is None else good
                if bad:
                    at.append(i)
                    lines_bad.append(bad)
                    lost.append(left)
                    whole.append("\n".join(out) if out else None)
            took = batch.select(list(range(n))).take(pa.array(at, pa.int64()))
            cols = [*took.columns, pa.array(lines_bad, pa.int32())]
            names = [*keys, "garbled_lines"]
            if restored:
                cols += [pa.array(lost, pa.int32()), pa.array(whole, pa.string())]
                names += ["lost_lines", "restored"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kinds = [f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys]
    schema = ", ".join([*kinds, "garbled_lines int", *(["lost_lines int", "restored string"] if restored else [])])
    return texts.where(F.col(text).rlike(r"[^\x00-\x7f]")).select(*keys, text).mapInArrow(run, schema)
