import pytest

from sondar.llm import language as L

TEXTS = {
    "en": "Nobody knows yet why the children went into the garden after lunch.",
    "es": "Nadie sabe todavía por qué los niños fueron al jardín después de comer.",
    "pt": "Ninguém sabe ainda por que as crianças foram ao jardim depois do almoço.",
    "fr": "Personne ne sait encore pourquoi les enfants sont allés dans le jardin après le repas.",
    "de": "Niemand weiß bisher, warum die Kinder nach dem Essen in den Garten gingen.",
    "ru": "Никто пока не знает, почему дети пошли в сад после обеда.",
    "zh": "目前没有人知道孩子们为什么在午饭之后去了花园里玩。",
}


@pytest.fixture(scope="module")
def classifier():
    return L.Classifier(L.seed_dictionaries())


@pytest.mark.parametrize("code", sorted(TEXTS))
def test_seeds_tell_the_languages(classifier, code):
    got = classifier.classify(TEXTS[code])
    assert got and got[0] == code and 0 < got[1] <= 1
    assert classifier.main(TEXTS[code]) == code
    assert classifier.classify(TEXTS[code].upper())[0] == code


@pytest.mark.parametrize("text", ["", "ok thanks", "lol", "1) 2) 3)", "```python\nfor the of and to in is:\n```", "https://a.b/c the of and to", "これは日本語の文です、とても長い文です", "Він не знає, чому діти пішли їсти", "12 34 56 78 90", "中文"])
def test_no_language(classifier, text):
    assert classifier.message(text) == []


def test_segments(classifier):
    mixed = TEXTS["en"] + " " + TEXTS["de"] + "\n- " + TEXTS["es"] + "\n- " + TEXTS["es"] + "\n```\n" + TEXTS["fr"] + "\n```"
    got = classifier.message(mixed)
    assert [(c, n) for c, _, n in got] == [("en", 1), ("de", 1), ("es", 2)]
    assert classifier.message(None) == []


def rows(spark, data):
    df = spark.createDataFrame(data, "conversation_id string, language string, conversation array<struct<role:string,content:string>>")
    return L.rows_of(df.selectExpr("*", "1 AS label", "2 AS segment"), "chat", "conversation_id", "conversation")


def test_found(spark):
    data = [
        ("a", "English", [("user", TEXTS["en"]), ("assistant", TEXTS["fr"] + " " + TEXTS["en"])]),
        ("b", None, [("user", TEXTS["ru"]), ("user", None), ("user", "")]),
        ("c", "pt-BR", [("user", TEXTS["pt"])]),
        ("c", "pt-BR", [("user", TEXTS["pt"])]),
        ("d", "Klingon", [("user", TEXTS["zh"])]),
        (None, "en", [("user", TEXTS["fr"])]),
        ("e", "en", None),
    ]
    got = sorted(map(tuple, L.found(rows(spark, data)).collect()))
    assert got == [("chat", "a", 1, "fr"), ("chat", "b", 0, "ru"), ("chat", "d", 0, "zh")]
    main = {r.record_id: r.language for r in L.dialogues(rows(spark, data)).collect()}
    assert main == {"a": "en", "b": "ru", "c": "pt", "d": "zh"}
    assert L.found(rows(spark, data).where("false")).count() == 0


def test_dictionaries_are_bounded_and_learn():
    labelled = [("es", ["Aquí llamamos Fulano a este conjunto de datos tan raro.", TEXTS["es"], "Se trata de un nuevo proyecto que viene de la oficina."])] * 40
    grown = L.refine(labelled)
    assert all(len(d) <= L.DICTIONARY_BYTES for d in grown.values()) and len(grown["es"]) > len(L.seed_dictionaries()["es"])
    assert L.Classifier(grown).classify("Aquí llamamos Mengano a este conjunto de datos tan raro.")[0] == "es"


def test_long_texts_are_read_whole(classifier):
    long = TEXTS["en"].replace(".", ",") * 300 + ". " + TEXTS["de"]
    assert classifier.message(long)[-1][0] == "de"


OTHERS = {
    "bg": "Учениците отидоха вчера на разходка в планината заедно със своите учители.",
    "sr": "Деца су јуче отишла на излет са својим учитељима и вратила се касно увече.",
    "uk": "Учора діти разом з учителями пішли гуляти в гори і повернулися пізно.",
    "ja": "東京都知事選挙投票率過去最低記録更新",
}


@pytest.mark.parametrize("code", sorted(OTHERS))
def test_languages_outside_the_seven_are_rejected(classifier, code):
    assert classifier.classify(OTHERS[code]) is None and classifier.main(OTHERS[code]) is None


def test_chinese_beside_the_seeds(classifier):
    for text in ("光合作用发生在绿色植物的叶绿体之内，吸收二氧化碳。", "昨天下午我和朋友一起去看了一场电影"):
        assert classifier.classify(text)[0] == "zh"


def test_an_answer_does_not_depend_on_the_texts_before():
    shared = "the shared passage stands in both of them word for word and nothing else does"
    one, other = "um texto do outro lado da rua com muitas palavras. ", "un texto del otro lado de la calle con muchas palabras. "
    held = {"pt": (one + shared).encode(), "es": (other + shared).encode(), "en": b"x y z", "fr": b"x y z", "de": b"x y z"}
    for before in (one, other):
        c = L.Classifier(held)
        c.main(before)
        assert c.main(shared) is None


def test_every_dialogue_has_a_row(spark):
    data = [("a", "en", [("user", TEXTS["en"])]), ("b", "en", None), ("c", "en", [("user", "ok")]), ("c", "en", [("user", "ok")]), (None, "en", None)]
    got = {r.record_id: (r.language, r.confidence > 0, r.languages) for r in L.profiled(rows(spark, data)).collect()}
    assert got == {"a": ("en", True, ["en"]), "b": (None, False, []), "c": (None, False, [])}
