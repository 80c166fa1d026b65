from quireline.llm import sentences as S


def cut(text):
    ends = S.sentence_ends(text)
    assert ends == sorted(set(ends))
    return [text[a:b].strip() for a, b in zip([0] + ends, ends)]


KEPT = [
    'Ms. Quill of Ilvane Inc. said, "Hold the file. Wait for the panel!" and left.', '"Is it final?" asked Mr. Odd, whereupon all withdrew.', "The fee rose by 0.8 per cent, e.g. for the plan.",
    "See Nos. 60 and 180, vol. 5, pp. 30 ff., for it.", "The rule (cf. Part 10. Transition) leaves it unchanged.", "7.25 per cent objected... yet it passed.", "It holds: (a) one; (b) two; and (c) three.",
    "Mme L. a déclaré : « Attendez l'avis. Ne déposez rien ! » avant la fin.", "Selon l'art. 14.1, il peut agir.", "Le paragr. 14.1 et l'al. 10 visent, c.-à-d. toute somme, p. ex. ici.",
    "Frau Dr. E. sagte: „Warten Sie. Es eilt nicht!“ und ging.", "Am 3. März 2009 erhielt er z. B. Nr. 5, d. h. ca. 7,25 Euro.", "La Sra. M. dijo: «Espere. ¡No firme nada!» y salió.", "O Sr. V. disse: «Espere. Não assine!» e saiu.",
    "Председатель сказал: «Ждите. Ничего не подписывайте!» — и вышел.", "Плата выросла в 2011 г. по ст. 21 и п. 5, т. е. сильно.", "قال د. سامرون: «انتظروا الإشعار. لا توقعوا!» ثم غادر القاعة.",
    'डॉ. वेदांकुर ने कहा, "रुकिए। हस्ताक्षर मत कीजिए।" और चले गए।', "主席说：“请等待通知。不要签字！”随后他离开会场。", "議長は「お待ちください。署名しないでください。」と述べて退席した。", "詳細はNo.45の名簿を参照のこと。", "Page 2 of 3 Notice 18-131",
]


def test_one_sentence_each():
    for t in KEPT:
        assert cut(t) == [t], t


def test_boundaries():
    assert cut("The units were offered by Northwick Timber Co. Nothing changes.") == ["The units were offered by Northwick Timber Co.", "Nothing changes."]
    assert cut("The panel closes at 10 p.m. The issuer left.") == ["The panel closes at 10 p.m.", "The issuer left."]
    assert cut("It ends here. e-filers that wait need not.") == ["It ends here.", "e-filers that wait need not."]
    assert cut("Extend by 45 days.The panel closes.") == ["Extend by 45 days.", "The panel closes."]
    assert cut('He replied: "We have no comment." The end came.') == ['He replied: "We have no comment."', "The end came."]
    assert cut("(See also this.) Next one.") == ["(See also this.)", "Next one."]
    assert cut("Is it bound?! Yes. No final mark") == ["Is it bound?!", "Yes.", "No final mark"]
    assert cut("一二三。四五六？七八九") == ["一二三。", "四五六？", "七八九"]
    assert cut("क ख। ग घ? च") == ["क ख।", "ग घ?", "च"]
    assert cut("Rappel. Selon l'art. 5, oui ? Non.") == ["Rappel.", "Selon l'art. 5, oui ?", "Non."]
    assert cut("SAID, \"HOLD IT. WAIT!\" AND LEFT. THE END CAME.") == ['SAID, "HOLD IT. WAIT!" AND LEFT.', "THE END CAME."]


OTHER_LANGUAGES = ["They chose plan b. Then they left.", "It weighs 10 m. The rest is lost.", "See option d. Next we go.", "The ratio is e. Next we go.", "We met at the par. 3 people left."]


def test_abbreviations_are_those_of_the_language():
    for t in OTHER_LANGUAGES:
        assert len(S.sentence_ends(t, "en")) == 2 == len(S.sentence_ends(t, lambda text: "en")), t
    german = "Das gilt z. B. Nr. 5, d. h. ca. 7 Euro."
    assert len(S.sentence_ends(german, "de")) == 1 == len(S.sentence_ends(german)) and len(S.sentence_ends("Er traf M. Das gilt.", "de")) == 1
    asked = []
    S.sentence_ends("No stop abbreviates here. Nothing is asked! Right?", lambda text: asked.append(text) or "en")
    assert not asked
    # The stored text is asked, not the comparison form.
    S.sentence_ends("Согласно ст. 21 и п. 5, срок продлён.", lambda text: asked.append(text) or "ru")
    assert asked and all(a.startswith("Согласно ст.") for a in asked)


def test_all_terminators():
    for mark in "!?。！？।॥؟۔։።၊៕᠃‼꘎᙮꓿﹖𑁇":
        assert len(S.sentence_ends(f"Ab cd{mark} Ef gh{mark}")) == 2, mark


def test_hidden_signs_and_ends():
    t = "Ρrοf.​ Τarquil left​.​ Next　one"
    assert [t[:e] for e in S.sentence_ends(t)] == ["Ρrοf.​ Τarquil left​.", t]
    assert S.sentence_ends("A b.  ") == [4] and S.sentence_ends("") == [] and S.sentence_ends(" ​ ") == []
    assert S.sentence_ends("x" * 100_000) == [100_000]


def test_unbalanced_signs_hide_nothing():
    assert cut('He said "yes. Then he left. It was over.') == ['He said "yes.', "Then he left.", "It was over."]
    assert cut("A) first. B) second.") == ["A) first.", "B) second."]


def test_frame(spark):
    df = spark.createDataFrame([(1, "One. Two.", 5), (1, "One. Two.", 5), (2, None, 5), (3, "", 5)], "para_id bigint, text string, sent_ends int")
    assert {r.para_id: r.sent_ends for r in S.sentence_bounds(df).collect()} == {1: [4, 9], 2: None, 3: []}
    got = sorted((r.para_id, r.sent_no, r.sent_start, r.sent_end, r.sentence) for r in S.sentences(df).collect())
    assert got == [(1, 0, 0, 4, "One."), (1, 1, 4, 9, "Two.")]
    assert S.sentences(df.limit(0)).count() == 0
    rows = [(i, t, x) for x in ("en", None, "xx") for i, t in enumerate(OTHER_LANGUAGES)]
    said = S.sentence_bounds(spark.createDataFrame(rows, "para_id int, text string, lang string"), lang="lang").collect()
    assert [len(r.sent_ends) for r in said] == [2] * 5 + [1] * 10
    judged = S.sentence_bounds(spark.createDataFrame(rows, "para_id int, text string, lang string"), judge=lambda text: "en").collect()
    assert {len(r.sent_ends) for r in judged} == {2}
