import pytest

from quireline.llm import language as L

TEXT = {
    "en": "The issuer must publish the report before the deadline. The trustee should keep a record of the change. Does the panel expect it? ",
    "de": "Der Emittent muss den Bericht vor Ablauf der Frist vorlegen. Die Verwahrstelle prüft das Verzeichnis der Eigentümer. Wird die Frist verlängert? ",
    "fr": "L'émetteur doit publier le rapport avant l'échéance. Le dépositaire peut retirer la liste des initiés. La commission exige-t-elle cela ? ",
    "es": "El emisor debe publicar el informe antes de la fecha límite. La entidad gestora podrá retirar la lista. ¿El plazo se amplía? ",
    "pt": "O emissor deve publicar o relatório antes do fim do prazo. A empresa não pode alterar a lista atualizada. O prazo será alargado? ",
    "ru": "Эмитент должен опубликовать отчёт до истечения срока. Депозитарий хранит реестр владельцев. Почему срок продлевается? ",
    "ja": "発行者は最新のリストを公表するものとする。監査委員会が回答しない場合、期間は延長される。名簿を提出したのでしょうか？",
    "zh": "发行人应当提交修订后的季度证明。如果收购方未作答复，期限将延长。基金管理公司是否需要补充名单？审计委员会在交易完成之后不得更改名册。",
}
PARA = "para_id bigint, doc_id bigint, side string, text string, lang string"


@pytest.fixture(scope="module")
def model():
    rows = [(lang, t) for lang, text in TEXT.items() for t in [text, text.lower(), " ".join(reversed(text.split(". ")))] * 2]
    return L.fit([t for _, t in rows], [lang for lang, _ in rows])


def test_labels(spark):
    want = {"EN": "en", "eng": "en", "en-CA": "en", "English": "en", "Français": "fr", "fr_CA": "fr", "fra": "fr", "": None, " ": None, "und": None, "XX": None, None: None, "PT": "pt", "日本語": "ja", "Deutsch": "de"}
    df = spark.createDataFrame([(k,) for k in want], "l string")
    from pyspark.sql import functions as F

    assert {r.l: r.c for r in df.select("l", L.label_code(F.col("l")).alias("c")).collect()} == want


def test_classify(model):
    held = {
        "en": "A record of the report was kept by the trustee.", "de": "Die Frist wird nicht verlängert, wenn der Bericht vorliegt.", "fr": "Le rapport doit être publié avant la liste des initiés.",
        "es": "La lista se debe publicar antes del informe.", "pt": "A lista não deve ser alterada antes do relatório.", "ru": "Отчёт должен быть опубликован.", "ja": "期間は公表される。", "zh": "发行人需要提交名单。",
    }
    assert {k: model.classify(t)[0] for k, t in held.items()} == {k: k for k in held}
    assert model.classify("123 — !?") == ("und", 0.0) and model.classify("") == ("und", 0.0)
    assert all(0 <= model.classify(t)[1] <= 1 for t in held.values())


def test_training_is_repeatable_and_cleans_labels():
    rows = [(lang, TEXT[lang] + f"{i} " + TEXT[lang]) for lang in ("en", "fr", "ru") for i in range(6)]
    noisy = rows + [("en", TEXT["fr"]), ("fr", TEXT["en"]), ("en", TEXT["ru"])]
    a = L.fit([t for _, t in noisy], [x for x, _ in noisy])
    b = L.fit([t for _, t in reversed(noisy)], [x for x, _ in reversed(noisy)])
    assert all(a.classify(TEXT[x])[0] == x == b.classify(TEXT[x])[0] for x in ("en", "fr", "ru"))
    assert a.classify(TEXT["fr"]) == b.classify(TEXT["fr"])


def test_documents(spark, model):
    rows = [
        (1, 1, "sgml", TEXT["fr"] * 2, "x"), (1, 1, "sgml", TEXT["fr"] * 2, "x"), (2, 1, "sgml", TEXT["fr"] + "The issuer must publish the report before the deadline. " + TEXT["fr"], "x"),
        (3, 1, "pdf_l4", TEXT["en"] * 9, "x"), (4, 2, "sgml", TEXT["zh"], None), (5, 3, "sgml", None, None), (6, 4, "sgml", "", None), (7, 5, "sgml", "12 34", None),
    ]
    seg = L.filing_segments(spark.createDataFrame(rows, PARA), model)
    mains = L.main_language(seg)
    assert {r.doc_id: r.lang for r in mains.collect()} == {1: "fr", 2: "zh"}
    f = L.certain(L.foreign_segments(seg, mains)).collect()
    assert {(r.para_id, r.lang) for r in f} == {(2, "en")}
    assert all(r.start < r.end for r in f)
    labels = spark.createDataFrame([(1, "FRA"), (2, "EN"), (2, "EN"), (9, None)], "doc_id bigint, lang string")
    hints = spark.createDataFrame([(1, None), (2, "zh-CN")], "doc_id bigint, language_hint string")
    w = L.wrong_labels({"a": (labels, "lang"), "b": (hints, "language_hint")}, mains).collect()
    assert {tuple(r) for r in w} == {("a", 2, "zh"), ("b", 1, "fr")}


def test_short_segments_stay_with_their_confidence(spark, model):
    rows = [(1, 1, "sgml", TEXT["en"] + "公表するもの。" + TEXT["en"] + "Oui.", None)]
    seg = L.filing_segments(spark.createDataFrame(rows, PARA), model)
    mains = L.main_language(seg)
    every = {r.letters: r for r in L.foreign_segments(seg, mains).collect()}
    assert every[6].lang == "ja" and 0 < every[6].confidence < 1
    assert 6 in {r.letters for r in L.certain(L.foreign_segments(seg, mains)).collect()}
    # The fewer letters, the less a text says.
    whole, part = "Le rapport doit paraître", "Le rap"
    assert model.judge(part)[1] < model.judge(whole)[1] and model.judge("Ж")[1] == 0.5 < model.judge("Жить")[1]


def test_many_at_once(model):
    texts = [*TEXT.values(), "", " ", "12", "字", "Ж", "ab", "x" * 5000, *[t[i : i + 9] for t in TEXT.values() for i in range(0, 90, 9)]] * 2
    for one, many in zip(map(model.judge, texts), model.judge_all(texts)):
        assert one[0] == many[0] and one[1] == pytest.approx(many[1], abs=1e-4) and one[2] == many[2]
    assert model.judge_all([]) == []


def test_train_from_a_table(spark):
    rows = [(t + f" {i}", {"en": "English", "fr": "FR"}[lang]) for lang, t in TEXT.items() if lang in ("en", "fr") for i in range(5)] + [(None, "en"), ("x", "fr"), (TEXT["ru"], None)]
    m = L.train(spark.createDataFrame(rows, "text string, lang string"), "text", "lang")
    assert m.members == {"germanic": ["en"], "romance": ["fr"]}
    with pytest.raises(ValueError):
        L.train(spark.createDataFrame([], "text string, lang string"), "text", "lang")
