import pytest

from lodestone.llm.garbled import CHAINS, LOST, SEEDS, SOUND, Classifier, find_garbled, fit_on, garble, invert, stretch

GOOD = [
    "Ошибка: файл не найден", "größer als die Länge", "déjà traité, on ignore", "naïve fallback", "wait… it’s ready", "INFORMAÇÃO E OPÇÃO",
    "次の行から計算する", "删除过期的记录", "keep below 40 °C × 2", "Не удалось открыть файл",
]


@pytest.fixture(scope="module")
def model():
    return Classifier.fit_cleaned({s: 20 for s in GOOD})


def test_sound_text_stays(model):
    assert [model.chain(s) for s in GOOD] == [SOUND] * len(GOOD)


@pytest.mark.parametrize("chain", ["utf8>cp1252", "utf8>latin1", "utf8>mac", "utf8>cp1251", "utf8>cp437", "utf8>cp1252 twice"])
def test_chains_are_found_and_undone(model, chain):
    for s in GOOD:
        bad = garble(s, chain)
        if bad and bad != s:
            found = model.chain(bad)
            assert found != SOUND
            assert model.restore(bad, found) == s


def test_single_byte_chains(model):
    for chain in ("cp1251>cp1252", "koi8>cp1251", "cp866>cp1251", "cp1251>koi8"):
        bad = garble("Ошибка: файл не найден", chain)
        assert model.restore(bad, model.chain(bad)) == "Ошибка: файл не найден"


def test_inverse_is_strict():
    assert invert("ÇÃO", "utf8>cp1252") is None
    for chain in CHAINS:
        for s in SEEDS:
            if (bad := garble(s, chain)) is not None:
                assert invert(bad, chain) == s


def test_lost_characters(model):
    assert model.chain("l�scht") == LOST


def test_table(spark, model):
    rows = [(1, "ok\nVÃ©rifie que c'est prÃªt\n"), (2, "fine"), (3, None), (4, ""), (5, "größer\nb�d"), (1, "ok\nVÃ©rifie que c'est prÃªt\n")]
    got = {r["k"]: r for r in find_garbled(spark.createDataFrame(rows, "k int, content string"), model, ["k"], "content", restored=True).collect()}
    assert set(got) == {1, 5}
    assert got[1]["restored"] == "ok\nVérifie que c'est prêt\n" and got[1]["lost_lines"] == 0
    assert got[5]["lost_lines"] == 1


NOUNS = ("registry", "buffer", "session")
SOUND_FORMS = (
    "Получить список и вернуть {}", "СПИСОК: {}", "список {} пуст", "Список файлов для {}", "по списку {}, затем дальше", "Удаляет старые строки из {}",
    "Считаем среднее значение {}", "Если очередь пуста, {} ждёт", "не трогать: {} ещё используется", "проверка границ для {}",
    "löscht überflüssige Zeilen aus {}", "{} darf nicht größer als die Länge sein", "wählt den nächsten Eintrag für {}", "Größe von {} prüfen",
    "ungültiger Wert für {}, bitte ändern", "临时方案,以后重写 {}", "删除过期的 {} 记录", "更新 {} 之前先检查", "计算 {} 的平均值", "找不到 {},请重试",
    "déjà traité, on ignore {}",
)


def test_sound_words_that_happen_to_decode(spark):
    """A sound word whose bytes in another code page are UTF-8 stays sound."""
    assert invert("список", "utf8>cp866") not in (None, "список")
    rows = [(i, "\n".join(f.format(n) for f in SOUND_FORMS for n in NOUNS)) for i in range(20)]
    texts = spark.createDataFrame(rows, "k int, content string")
    fitted = fit_on(texts, "k", "content")
    assert {f: fitted.chain(stretch(f.format("ledger"))) for f in SOUND_FORMS} == dict.fromkeys(SOUND_FORMS, SOUND)
    assert find_garbled(texts, fitted, ["k"], "content").count() == 0


def test_long_lines_count_whole(spark, model):
    """What is garbled only after 500 characters, in a line or in the sample, is seen."""
    tail = garble("Größe von Puffer prüfen", "utf8>cp1252")
    texts = spark.createDataFrame([(1, "x = 1; " * 100 + tail), (2, "x = 1; " * 100 + "Größe")], "k int, content string")
    assert [r["k"] for r in find_garbled(texts, model, ["k"], "content").collect()] == [1]
    own = fit_on(spark.createDataFrame([(1, "слово " * 200)], "k int, content string"), "k", "content")
    assert own.chain("слово") == SOUND


def test_cut_off_run(model):
    """A stretch that lost a byte at its end is found by the runs that still decode."""
    assert model.chain("rÃ©sultat arrÃªtÃ© Ã") in ("utf8>cp1252", "utf8>latin1")


def test_fit_on_nothing(spark):
    fitted = fit_on(spark.createDataFrame([], "k int, content string"), "k", "content")
    assert fitted.chain("Größe") == SOUND
    fitted = fit_on(spark.createDataFrame([(1, None), (2, "")], "k int, content string"), "k", "content")
    assert fitted.chain("Größe") == SOUND
