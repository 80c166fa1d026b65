from quireline import queries as Q
from quireline.functions.udf import decoded


def test_headings_in_any_charset(spark, tmp_path):
    h1 = "<h1>{}</h1>"
    rows = [
        (1, None, h1.format("Größe").encode()), (2, "Content-Type: text/html; charset=windows-1251\r\n", h1.format("Сроки").encode("cp1251")),
        (3, None, b'<meta charset="shift_jis">' + h1.format("期限").encode("shift_jis")), (4, "charset=utf-8", h1.format("Délai").encode("latin-1")), (5, None, None),
    ]
    spark.createDataFrame(rows, "doc_id bigint, headers string, raw binary").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.heading for r in Q.QUERIES["t07_all_headings"](spark, str(tmp_path)).collect()}
    assert got == {1: "Größe", 2: "Сроки", 3: "期限", 4: "Délai"}
    assert {r.doc_id for r in Q.QUERIES["t07_headings"](spark, str(tmp_path)).collect()} == {1}
    assert decoded(b"\xe9", "charset=nonsense") == "é" and decoded(b"", None) == ""


def heading_tables(spark, folder):
    rows = [(1, 1, "sgml", 0, "Part Two of it"), (2, 1, "sgml", 1, "Nowhere"), (3, 2, "sgml", 0, "FEES"), (4, 2, "sgml", 1, ""), (5, 1, "pdf_l4", 0, "the part two of it all"), (6, 2, "pdf_l4", 0, "All Fees paid")]
    spark.createDataFrame(rows, "heading_id bigint, doc_id bigint, side string, idx int, text string").write.parquet(f"{folder}/headings.parquet")
    return str(folder)


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_absent_headings_stay_off_the_driver(spark, tmp_path):
    df = Q.QUERIES["j12_absent_headings"](spark, heading_tables(spark, tmp_path))
    assert "SortMergeJoin" in planned(df) and "Broadcast" not in planned(df)
    assert [tuple(r) for r in df.collect()] == [(2, 1)]


def test_lower_cased_stay_off_the_driver(spark, tmp_path):
    from quireline import filings  # noqa: F401  (registers its queries)

    df = Q.QUERIES["j19_lower_cased"](spark, heading_tables(spark, tmp_path))
    assert "SortMergeJoin" in planned(df) and "Broadcast" not in planned(df)
    assert sorted(tuple(r) for r in df.collect()) == [(1, "PART TWO OF IT"), (2, "FEES")]
