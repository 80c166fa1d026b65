import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quireline.llm import spam as S

PROSE = {
    "en": "The village baker described a pair of walking boots, so we decided to write down the number. Have you ever mended a small copper kettle while it rained? ",
    "de": "Wenn der Treuhänder nicht handelt, so wird die Frist um zehn Tage verlängert. Die Aufsichtsstelle prüft die jährliche Übersicht gemäß der Vereinbarung. ",
    "ru": "Почему эмитент хранит квартальное подтверждение? После завершения сделки управляющая компания намерена дополнить отчёт. ",
    "ja": "議長は「お待ちください。署名しないでください。」と述べて退席した。発行者は最新のリストを公表するものとする。",
    "ar": "يجب على شركة الإدارة حفظ الشهادة الفصلية. إذا لم يرد أمين الحفظ تمدد المهلة عشرة أيام. ",
}
TOWNS = ["Northquay", "Harwick", "Dunmoor", "Tamsey", "Redwell", "Pellby"]
r = random.Random(4)
SPAM = {
    "places": ", ".join(f"roof repair {r.choice(TOWNS)}" for _ in range(60)), "lines": "\n".join(f"buy plum jam {r.choice(['cheap', 'online'])} {r.choice(TOWNS)}" for _ in range(40)),
    "stuffed": " ".join(f"{w} van rental {r.choice(['', 'cheap', 'now'])}" for w in (PROSE["en"] * 3).split()), "tags": " | ".join(r.choice(["steel", "SKU 4411", "size 9", "19.99", "bestseller", "eco", "gift", "plum jam"]) for _ in range(90)),
    "links": "\n".join(f"cheap loan >> http://a.example/{i}" for i in range(20)), "hash": " ".join(f"#{r.choice(['near_me', 'loan', 'steel', 'buy_now'])}" for _ in range(60)),
    "sentences": " ".join(f"Looking for {k}? Our {k} {w} is the {k} you want for {k} {w}." for k, w in [("roof repair", "sale"), ("roof repair", "online"), ("roof repair", "cheap")] * 8),
    "wide": " ".join(r.choice(["口コミ ピアノ教室", "格安 ピアノ教室", "通販"]) for _ in range(50)),
}


FUNCTION = frozenset("the a of so we to you it if not und der die das nach и не".split())


def share(t, function=FUNCTION):
    a, b = S.weigh(t, function)
    return a / (a + b) if a + b else 0.0


def test_prose():
    for t in PROSE.values():
        assert share(t * 6) == 0.0, t


def test_spam():
    for name, t in SPAM.items():
        assert share(t) > 0.9, name
        assert share("Home | News | Contact\nTitle\n" + PROSE["en"] + "\n" + t) > 0.5, name


def test_not_spam():
    menu = "\n".join(["Home", "News", "Help", "Shop", "Archive", "Contact", "Events", "Search"])
    assert share(menu + "\nA title\n" + PROSE["en"] * 2 + "\n© 2019 www.a.example | Home | News") == 0.0
    assert share("\n".join(f"Plums: {PROSE['en']}" for _ in range(12))) == 0.0
    assert share(PROSE["en"] * 12 + "\n" + SPAM["tags"]) < 0.5
    assert share("Sorry, the page you are looking for cannot be found.") == 0.0 and share("") == 0.0
    assert share("\n".join(p + " http://a.example/x" for p in [PROSE["en"]] * 4)) == 0.0


def test_garbled():
    wrong = SPAM["places"].replace("roof", "крыша").encode().decode("cp1251", "replace")
    assert share(wrong) > 0.5
    assert share((PROSE["ru"] * 4).encode().decode("cp1251", "replace")) == 0.0
    assert share((PROSE["ru"] * 4).encode("koi8-r").decode("utf-8", "replace")) < 0.5


def stuffed_wide(text, word):
    """``text`` with ``word`` and a filler after every third sign."""
    pick = random.Random(7)
    return "".join(text[i : i + 3] + word + pick.choice(["", "", "購入", "最安値"]) for i in range(0, len(text), 3))


def test_stuffed_without_blanks():
    prose = "発行者は重要な変更の届出を変更してはならない。受益者に代わって監査委員会は実質所有者の名簿を提出した。手数料は適用される契約に従って期間を延長する。"
    for word in ("通販 マットレス", "購入 時計"):
        t = stuffed_wide(prose, word)
        assert share(t) > 0.9, word
        assert share(t.encode().decode("latin-1")) > 0.9, word
        # A stuffed part of a long line counts as far as it reaches.
        other = "".join(chr(0x4E00 + i) for i in range(2000))
        assert 0.05 < share(other + t) < 0.2, word
    assert share(prose * 5) == 0.0 and S.stuffed_grams((prose * 5).encode().decode("latin-1"), 0) == 0.0
    assert share("\ufffd" * 400) == 0.0 and share("…" * 400) == 0.0


def test_regularity_finds_most(monkeypatch):
    """Without the recurrence test only lists of many different names are left."""
    monkeypatch.setattr(S, "regularity", lambda codes, size: 0.0)
    monkeypatch.setattr(S, "gram_cover", lambda codes, size, gap: 0.0)
    assert {name for name, t in SPAM.items() if share(t) > 0.5} <= {"lines", "tags", "hash", "links"}
    assert all(share(SPAM[name]) == 0.0 for name in ("places", "stuffed", "sentences", "wide"))


def test_regularity_by_brute_force():
    pick = random.Random(9)
    for _ in range(60):
        codes = np.array([pick.choice([-1 - i, 0, 1, 2, 3]) for i in range(40)])
        size = np.array([pick.randint(1, 9) for _ in codes], dtype=float)
        lag = [sum(size[i] for i in range(k, 40) if codes[i] == codes[i - k] and codes[i] >= 0) / sum(size[k:]) for k in range(1, S.MAX_LAG + 1)]
        even = 0.0
        for c in range(4):
            at = [i for i in range(40) if codes[i] == c]
            gaps = [b - a for a, b in zip(at, at[1:])]
            if len(at) >= 4 and np.mean(gaps) <= S.MEAN_GAP and np.std(gaps) <= S.GAP_SPREAD * np.mean(gaps):
                even += sum(size[i] for i in at)
        want = max([a + b for a, b in zip(lag, lag[1:])] + lag + [even / size.sum()])
        got = S.regularity(codes, size)
        assert got == pytest.approx(want)


def test_lists():
    names = "violin lantern gravel kettle oven hedge coin ridge plum tile saddle lens rope anvil cork fern".split()
    assert S.is_list(names * 2, 0, FUNCTION) and not S.is_list(names[:10], 0, FUNCTION)
    assert not S.is_list([f"the {n} of it" for n in names], 0, FUNCTION) and not S.is_list([f"{n} roof" for n in names[:2]] * 20, 0, FUNCTION)
    assert S.terms("See [foo](https://a.example/b), «Bar»!") == [("see", 3), ("foo", 3), (S.LINK, 19), ("bar", 3)]


def test_function_words(spark):
    rows = [(i, f"The word{i} and the kettle", "EN" if i % 2 else "en-CA") for i in range(40)] + [(50, "le mot", "fr"), (51, None, "en"), (52, "the", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    # One page of a language proves nothing.
    assert S.function_words(df) == {"the", "and", "kettle"}
    assert S.function_words(df.limit(0)) == frozenset()


def test_frame(spark):
    rows = [(1, SPAM["tags"], 0.1), (1, SPAM["tags"], 0.1), (2, PROSE["en"], 0.1), (3, None, 0.1), (4, "", 0.1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spam_share double").withColumn("lang", F.lit("en"))
    assert [x.doc_id for x in S.spam_pages(df).collect()] == [1]
    got = {x.doc_id: x.spam_share for x in S.spam_share(df).collect()}
    assert got[2] == 0.0 and got[3] is None and got[4] == 0.0
    assert S.spam_pages(df.limit(0)).count() == 0
