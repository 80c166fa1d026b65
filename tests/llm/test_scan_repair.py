import random

import pytest
from pyspark.sql import functions as F

from quireline.llm import scan_repair as R

COLS = "para_id bigint, doc_id bigint, side string, idx int, page int, text string, noise string"
BODY = [
    "The trustee must deliver the annual report before the applicable deadline and keep", "a record of every transaction. The issuer shall disclose the funding plan to", "the regulator within a reasonable period, unless an exemption has been granted to",
    "the applicant. Comments on the amended prospectus should reach the review panel no", "later than thirty days after publication, in a form acceptable to the regulator.",
]


def filing(doc, damage=True):
    """Two printed pages with running heads and feet, their merged paragraphs and
    the marked-up text."""
    rows, k, idx = [], doc * 1000, 0
    text = " ".join(BODY)
    rows += [(k + i, doc, "sgml", i, None, text, None) for i in range(2)]
    for page in (1, 2):
        lines = [f"Notice 45-1{page}", *BODY, f"Page {page} of 2"] if damage else BODY
        if damage and page == 1:
            lines = [lines[0], lines[1].replace("annual", "annua1"), lines[2], lines[3].replace("regulator", "regu1ator").replace("granted to", "gran-"), "ted to " + lines[4], lines[5], lines[6]]
        for t in lines:
            rows.append((k + 100 + idx, doc, "pdf_l1", idx, page, t, None))
            idx += 1
    return rows, k


def test_confusions():
    assert R.changes("fhe", "the") == 1 and R.changes("the", "fhe") is None
    assert R.changes("irnport@nt", "important") == 2
    assert R.changes("d6pôt", "dépôt") == 1
    # However many signs are wrong, and however long the word is.
    assert R.changes("!nv3stm@nts", "investments") is None and R.changes("!n5t!tut!0n@1!5@t!0n5", "institutionalisations") == 13
    assert R.changes("c" * 100, "e" * 100) == 100 and R.changes("", "") == 0 and R.changes("rn", "m") == 1 and R.changes("rn", "ru") == 1
    assert R.number_of("1O,5OO") == "10,500" and R.number_of("(4S)") == "45" and R.number_of("45") is None and R.number_of("Ol") is None
    assert R.core("«Co-operate,»") == "co-operate" and R.core("$6.15") == "6.15" and R.core("!nstrument.") == "!nstrument"


def test_shapes():
    want = {"- 3 -": "marked number", "[2]": "marked number", "iv": "roman", "Page 2 of 9": "page of", "Custody Fees / 33-188 / 2": "slashes", "2 Regulatory Bulletin 25-208": "number title", "Notice 45-106": "title number", "": "empty"}
    assert {t: R.shape(t) for t in want} == want
    assert R.shape(BODY[0]) == "text" and R.shape("字" * 30) == "text"


def test_model_without_rows():
    m = R.fit_lines([])
    assert m.decode([(("place", 0, 0),)] * 3) == [R.BODY] * 3 and m.borders([m.through([(("place", 0, 0),)])]) == [(R.BODY, R.BODY)]


def test_states_are_carried_over_blocks():
    r = random.Random(5)
    kinds = [[(("a", r.randint(0, 5)), ("b", r.randint(0, 2)), ("c", r.random())) for _ in range(40)] for _ in range(30)]
    states = [[R.HEAD] + [r.choice((R.BODY, R.BREAK, R.ASIDE)) for _ in range(38)] + [R.FOOT] for _ in kinds]
    m = R.fit_lines(list(zip(kinds, states)))
    for feats in kinds:
        feats = [f[:2] for f in feats]
        blocks = [feats[i : i + 7] for i in range(0, 40, 7)]
        ends = m.borders([m.through(b) for b in blocks])
        carried = [s for b, (p, q) in zip(blocks, ends) for s in m.decode(b, R.only(p), R.only(q))]
        assert score(m, feats, carried) == pytest.approx(score(m, feats, m.decode(feats)))


def score(m, feats, states):
    step = sum(m.step[a][b] for a, b in zip(states, states[1:]))
    return m.start[states[0]] + step + m.stop[states[-1]] + sum(m.scores(f)[s] for f, s in zip(feats, states))


def test_pages_are_whole(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_LINES", 10)
    rows = [(i, 1, "pdf_l1", i, p, f"line {i}", None) for i, p in enumerate([1] * 7 + [2] * 7 + [3] * 25 + [4] * 3)]
    got = sorted((r.page, r.block, [x.para_id for x in r.lines], r.first, r.last, r.parts, r.after) for r in R.page_blocks(spark.createDataFrame(rows + rows[:3], COLS)).collect())
    assert [g for g in got if g[0] != 3] == [(1, 0, list(range(7)), 0, 6, 1, None), (2, 0, list(range(7, 14)), 7, 13, 1, None), (4, 3, [39, 40, 41], 39, 41, 1, None)]
    long_ = [g for g in got if g[0] == 3]
    assert [len(g[2]) for g in long_] == [6, 10, 9] and {g[3:6] for g in long_} == {(14, 38, 3)} and [g[6] for g in long_] == ["line 20", "line 30", None]
    # Blocks are read as the whole page would be.
    pages = [[(d * 1000 + i, d, "pdf_l1", i, 1, t, None) for i, t in enumerate(["Notice 45-11", *BODY * 6, "Page 1 of 1"])] for d in range(1, 5)]
    df = spark.createDataFrame([x for p in pages for x in p] + [(d * 1000 + 500, d, "sgml", 0, None, " ".join(BODY), None) for d in range(1, 5)], COLS)
    monkeypatch.setattr(R, "BLOCK_LINES", 400)
    model = R.train_lines(R.page_blocks(df), df)
    states = lambda: {r.doc_id: [s for b in sorted(r.x) for s in b[1]] for r in R.read_blocks(R.page_blocks(df), model, frozenset()).groupBy("doc_id").agg(F.collect_list(F.struct("block", "r.states")).alias("x")).collect()}
    whole = states()
    monkeypatch.setattr(R, "BLOCK_LINES", 10)
    assert states() == whole and whole[1][0] == R.HEAD and whole[1][-1] == R.FOOT and len(whole[1]) == 32


def test_readings_of_any_depth(spark):
    words = spark.createDataFrame([("institutionalisations", 3), ("investment", 5), ("the", 9), ("tbe", 1)], "word string, n bigint")
    forms = spark.createDataFrame([("!n5t!tut!0n@1!5@t!0n5",), ("thc",), ("the",), ("unknown",)], "form string")
    got = {r.form: (r.n, r.fix, r.changes) for r in R.resolve(forms, words).collect()}
    assert got == {"!n5t!tut!0n@1!5@t!0n5": (None, "institutionalisations", 13), "thc": (None, "the", 1), "the": (9, None, None), "unknown": (None, None, None)}


def test_repair(spark):
    rows = []
    for d in range(1, 13):
        rows += filing(d, damage=d % 3 == 0)[0]
    k = 3000
    merged = f"{BODY[0].replace('annual', 'annua1')} {BODY[1]} {BODY[2].replace('regulator', 'regu1ator').replace('granted to', 'gran- ted to')} {BODY[3]} {BODY[4]} Page 1 of 2 Notice 45-12 {BODY[0]}"
    rows.append((k + 500, 3, "pdf_l4", 0, 1, merged, None))
    rows += [rows[-1], (k + 501, 3, "pdf_l4", 1, 2, None, None), (k + 502, 3, "pdf_l4", 2, 2, "", None), (k + 503, None, "pdf_l1", 0, 1, "x", None)]
    df = spark.createDataFrame(rows, COLS)
    done = R.repair(df, filings=100)
    got = {(r.para_id, r.noise, r.repaired) for r in done.findings.collect()}
    of3 = {g for g in got if 3000 <= g[0] < 4000}
    assert {(3101, "misread", "annual"), (3103, "misread", "regulator"), (3103, "hyphen", "granted"), (3500, "misread", "annual"), (3500, "hyphen", "granted"), (3500, "furniture", "")} <= of3
    assert {i for i, n, _ in got if n == "furniture" and i < 3500 and i >= 3000} == {3100, 3106, 3107, 3113}
    assert not [g for g in got if (g[0] // 1000) % 3], "clean filings have no damage"
    fixed = {r.para_id: r.text for r in R.repaired_paragraphs(done).collect()}
    assert fixed[3500] == " ".join([*BODY, BODY[0]]) and fixed[3502] == ""


def test_empty(spark):
    df = spark.createDataFrame([], COLS)
    done = R.repair(df)
    assert done.findings.count() == 0 and R.repaired_paragraphs(done).count() == 0


def test_nothing_marked_up(spark):
    rows = [(i, 1, "pdf_l1", i, 1, t, None) for i, t in enumerate(BODY)]
    assert R.repair(spark.createDataFrame(rows, COLS)).findings.where(F.col("noise") != "hyphen").count() == 0


def test_sentences_without_gap():
    assert R.pieces("risque.Sclon") == ["risque.", "Sclon"] and R.pieces("e.g.") == ["e.g."] and R.pieces("1.5") == ["1.5"] and R.pieces("U.S.") == ["U.S."]
    items = R.token_items([(1, "days.Tbe"), (1, "gran-"), (1, "ted.Next")], frozenset({"days"}))
    assert [(i[1], i[2], i[3], i[5]) for i in items] == [(0, "word", "Tbe", ["tbe"]), (1, "break", "gran-", ["granted", "gran-ted"])]


def test_rows_of_furniture_alone(spark):
    assert R.without_run("Page 1 of 2 Notice 45-12", "a", ["Page 1 of 2", "Notice 45-12"], "b") == ""
    assert R.without_run("Notice 45-12", None, ["Page 1 of 2", "Notice 45-12"], "b") == "" and R.without_run("Notice", "a", ["Notice 45-12"], None) == "Notice"
    rows = []
    for d in range(1, 13):
        rows += filing(d, damage=d % 3 == 0)[0]
    body = " ".join(BODY)
    for i, (page, text) in enumerate([(1, "Notice 45-11"), (1, body), (1, "Page 1 of 2 Notice 45-12"), (2, body), (2, "Page 2 of 2")]):
        rows.append((3500 + i, 3, "pdf_l4", i, page, text, None))
    done = R.repair(spark.createDataFrame(rows, COLS), filings=100)
    assert {r.para_id for r in done.findings.where("noise = 'furniture' AND para_id >= 3500 AND para_id < 4000").collect()} == {3500, 3502, 3504}
    assert {r.para_id: r.text for r in R.repaired_paragraphs(done).collect()} == {3501: body, 3503: body}


def test_runs_pass_pages_without_body(spark):
    block = "struct<lead: array<string>, trail: array<string>, head: string, tail: string, pending: struct<para_id: bigint, raw: string>, first: struct<para_id: bigint, raw: string>>"
    page = lambda k, lead, trail, body: (1, k, 0, (lead, trail, body, body, None, None))
    read = spark.createDataFrame(
        [page(1, ["cover"], [], None), page(2, ["h2"], ["f2"], "x"), page(3, ["h3", "f3"], [], None), page(4, ["h4"], ["f4"], "y")], f"doc_id bigint, page int, block int, r {block}"
    )
    runs = {(r.tail, r.b): (r.pages, r.f) for r in R.furniture_runs(read).collect()}
    assert runs == {(None, "x"): ([1, 2], ["cover", "h2"]), ("x", "y"): ([2, 3, 4], ["f2", "h3", "f3", "h4"]), ("y", None): ([4], ["f4"])}


def test_fixes_between_any_blanks(spark):
    fixes = "array<struct<pos: int, noise: string, repaired: string, raw: string>>"
    rows = [(" The annua1\treport  was gran-\nted thc day", [(1, "misread", "annual", "annua1"), (4, "hyphen", "granted", "gran-"), (6, "misread", "the", "thc")])]
    assert spark.createDataFrame(rows, f"text string, fixes {fixes}").select(R._apply_udf("text", "fixes")).first()[0] == " The annual\treport  was granted the day"


def test_repairs_of_lines_reach_their_paragraphs(spark):
    rows = []
    for d in range(1, 13):
        rows += filing(d, damage=d % 3 == 0)[0]
    got = {}
    for r in R.line_paragraphs(R.repair(spark.createDataFrame(rows, COLS), filings=100)).orderBy("idx").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert {d: " ".join(t) for d, t in got.items()} == {d: " ".join([*BODY, *BODY]) for d in range(1, 13)}
    assert all(t[0].startswith("The trustee") for t in got.values())


def test_fragments_of_blocks():
    line = lambda i, t: {"para_id": i, "idx": i, "text": t}
    fix = lambda pos, noise, repaired, raw, right=None: {"pos": pos, "noise": noise, "repaired": repaired, "raw": raw, "right": right}
    lines = [line(1, "Head"), line(2, "of thc"), line(3, "part gran-"), line(4, "ted."), line(5, "(note)"), line(6, "Next prom-")]
    states = [R.HEAD, R.BODY, R.BREAK, R.BREAK, R.ASIDE, R.BODY]
    fixes = [fix(1, "misread", "the", "thc"), fix(3, "hyphen", "granted", "gran-", "ted."), fix(R.PAST, "hyphen", "promises", "prom-", "ises,")]
    assert R.fragments(lines, states, fixes) == [(2, 2, "of the part granted.", True, False, False), (6, 6, "Next promises,", False, True, False), (5, 5, "(note)", True, False, True)]
