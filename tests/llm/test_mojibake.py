import pytest

from loam.llm import mojibake as M

SOUND = {
    "de": "Solange die Tür geschlossen war, zeigt der Schlüsselspeicher nur die größere Übersicht für 4681 Einträge.",
    "fr": "Après 4279 essais, le bureau d’études a retrouvé la clé d’accès abîmée à l’été ; “déjà vu” coûte 5 €.",
    "es": "¿Quién movió la página dañada número 7136? El índice rápido no lo registró.",
    "pt": "ATENÇÃO: SEÇÃO 4843 — A cópia NÃO FOI excluída. Ainda há ações.",
    "ru": "Если файл занят, таблица путей будет прочитана на прошлой неделе.",
    "zh": "如果磁盘快满了，索引服务会先截断旅行日志，再通知编写小组。",
}


@pytest.mark.parametrize("text", [*SOUND.values(), "N° 52 · 18 °C ± 2 · §17 · µ = 25 · ½ × ¾", "├── a\n│   └── b", "Łódź, Kraków – żółć", "“Ã©” is what an é turns into", "she wrote “��” there", "", "plain"])
def test_sound_text_is_no_case(text):
    assert M.restore(text) == (text, False)


@pytest.mark.parametrize("language, written, read", [("de", "utf-8", "cp1252"), ("fr", "utf-8", "latin-1"), ("es", "utf-8", "mac_roman"), ("zh", "utf-8", "latin-1"), ("zh", "gbk", "latin-1"), ("zh", "utf-8", "cp437"), ("ru", "utf-8", "cp1251"), ("ru", "cp1251", "latin-1"), ("ru", "koi8_r", "cp1251"), ("ru", "cp1251", "cp866"), ("de", "cp1252", "mac_roman"), ("es", "utf-8", "cp1250")])
def test_restored(language, written, read):
    text = SOUND[language]
    try:
        garbled = text.encode(written).decode(read)
    except UnicodeDecodeError:
        garbled = "".join(bytes([b]).decode(read, "ignore") or chr(b) for b in text.encode(written))
    assert garbled != text
    assert M.restore("Fine first line.\n" + garbled) == ("Fine first line.\n" + text, True)


def test_twice_and_in_places():
    twice = SOUND["fr"].encode().decode("latin-1").encode().decode("latin-1")
    assert M.search(twice)[0] == SOUND["fr"] and M.restore(twice) == (SOUND["fr"], True)
    assert M.restore("The caf\u00c3\u00a9 list is – as we know – long.") == ("The café list is – as we know – long.", True)


def test_lost_characters_are_found_but_stay():
    assert M.restore("Nach der Pr�fung") == ("Nach der Pr�fung", True)


def test_table(spark):
    rows = spark.createDataFrame([(1, "gepr\u00c3\u00bcft", ""), (2, None, ""), (3, "", ""), (4, "ok", ""), (5, "x" * 200_000 + " f\u00c3\u00bcr", "")], "file_id long, content string, found string")
    got = {r.file_id: (r.content, r.found) for r in M.restored(rows).collect()}
    assert got[1] == ("geprüft", True) and got[2] == (None, False) and got[3] == ("", False) and got[4] == ("ok", False) and got[5][0].endswith(" für")
    assert M.restored(rows.limit(0)).count() == 0


PATHS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("cp1251", "latin-1"), ("koi8_r", "cp1251"), ("cp1252", "mac_roman")]


def garbled():
    out = []
    for text in SOUND.values():
        for written, read in PATHS:
            try:
                raw = text.encode(written).decode(read)
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            if raw != text:
                out.append((raw, text))
    return out


def test_share_of_exactly_restored_texts():
    cases = garbled()
    right = sum(M.restore(raw)[0] == text for raw, text in cases)
    assert len(cases) > 20 and right >= 0.95 * len(cases), (right, len(cases))


def test_results_depend_on_the_row_alone(spark):
    texts = [raw for raw, _ in garbled()] * 2
    rows = spark.createDataFrame(list(enumerate(texts)), "file_id long, content string")
    one = {r.file_id: r.content for r in M.restored(rows.coalesce(1).orderBy("file_id")).collect()}
    other = {r.file_id: r.content for r in M.restored(rows.repartition(7).sortWithinPartitions("content")).collect()}
    assert one == other
