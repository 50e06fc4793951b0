import pytest

from textquarry.llm.encoding import map_values, read_bytes, repair, repair_texts

GERMAN = "Für die nächste Übung prüft die Gruppe „größere“ Bücher – schon jetzt."
RUSSIAN = "Почему новый словарь не описывает старые правила? Сборник хранит прежний результат."


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251"])
@pytest.mark.parametrize("text", [GERMAN, RUSSIAN])
def test_round_trip(codec, text):
    damaged = read_bytes(text.encode(), codec)
    hit, fixed, spans, _, lost = repair(damaged)
    assert hit and fixed == text and spans and not lost


def test_twice_garbled():
    damaged = read_bytes(read_bytes(GERMAN.encode(), "cp1252").encode(), "cp1252")
    assert repair(damaged)[1] == GERMAN


@pytest.mark.parametrize(("wrote", "read"), [("cp1251", "latin-1"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r")])
def test_single_byte(wrote, read):
    hit, fixed, *_ = repair(read_bytes(RUSSIAN.encode(wrote), read))
    assert hit and fixed == RUSSIAN


def test_western_letters_become_cyrillic():
    text = "Le modèle préfère des fichiers très légers après la relecture."
    assert repair(read_bytes(text.encode("cp1252"), "cp1251"))[1] == text


def test_mixed_text_is_left_alone_around_the_damage():
    hit, fixed, spans, *_ = repair("Übung macht den Meister. Die GrÃ¶ÃŸe der Bücher stimmt.")
    assert hit and fixed == "Übung macht den Meister. Die Größe der Bücher stimmt." and spans == 2


@pytest.mark.parametrize(
    "text",
    [
        "A reader asked what â€™ means in old mail.", "The guide shows how é turns into Ã© on a bad page.", "The mark � stands for an unknown character.",
        "The tree began with ├── raw and └── clean.", "SÃO PAULO, CHÂTEAU, À LA RELECTURE", "It was kept at 20 °C ± 2 and 5 µm.", "Почему корпус не хранит слова?", "ПОЧЕМУ ТАК", None, "", "plain",
    ],
)
def test_sound_text(text):
    assert repair(text)[:2] == (False, text)


def test_lost_characters():
    hit, _, spans, _, lost = repair("Le r�sultat est l�.")
    assert hit and not spans and lost == 2


def test_values_of_maps(spark):
    df = spark.createDataFrame([(1, {"a": "Ã©tÃ©", "b": None}), (2, None), (3, {"a": "ok"})], "id long, content map<string,string>")
    got = repair_texts(map_values(df, "id", "content"), "_rec", "_value").collect()
    assert [(r.rec_id, r.repaired) for r in got] == [(1, "été")]
