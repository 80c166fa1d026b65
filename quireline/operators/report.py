"""Reports: nested records, flat tables, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def report_json(rows: DataFrame, key: str = "doc_id", digits: int = 2) -> DataFrame:
    """``(key, report)``: every other column as one JSON record, doubles rounded."""
    cols = [F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes if c != key]
    return rows.select(key, F.to_json(F.struct(*cols)).alias("report"))


def flat_issues(issues: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, issues, critical)``: number of issues and the critical ones' names
    joined by semicolons, in order."""
    bad = F.array_sort(F.collect_set(F.when(F.col("severity") == "critical", F.col("rule"))))
    return issues.groupBy(key).agg(F.count("*").alias("issues"), F.array_join(bad, "; ").alias("critical"))


def decision_summary(decisions: DataFrame, by: list[Column] | None = None, decision: str = "validator_decision", score: str = "normalised_score", passed: tuple[str, ...] = ("ACCEPT", "ACCEPT_WITH_WARNINGS")) -> DataFrame:
    """Numbers of each decision, pass rate and mean of the scores above 0."""
    d = F.upper(F.col(decision))
    return decisions.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.count_if(d.isin(*passed)).alias("passed"), (F.count_if(d.isin(*passed)) / F.count("*")).alias("pass_rate"),
        F.avg(F.when(F.col(score) > 0, F.col(score))).alias("mean_score"),
    )


def text_summary(title: str, summary: DataFrame) -> DataFrame:
    """One text line for each row of a summary."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in summary.columns]
    return summary.select(F.concat_ws(" ", F.lit(title), *parts).alias("line"))


def write_json(rows: DataFrame, path: str) -> None:
    rows.withColumn("generated_at", F.current_timestamp()).write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Decision records added to a folder of JSON lines."""
    rows.write.mode("append").json(path)


def write_texts(rows: DataFrame, path: str, text: str = "fixed") -> None:
    """Texts written one document a line, escaped as JSON strings."""
    rows.select(F.to_json(F.struct("doc_id", F.col(text).alias("text"))).alias("value")).write.mode("overwrite").text(path)


def xlsx_bytes(rows: list[tuple], names: list[str], sheet: str = "Report") -> bytes:
    """A workbook of one sheet: a header row and the rows, numbers as numbers."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    def column(i: int) -> str:
        out = ""
        while i >= 0:
            out, i = chr(65 + i % 26) + out, i // 26 - 1
        return out

    def cell(value, r: int, c: int) -> str:
        ref = f"{column(c)}{r}"
        if value is None:
            return ""
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return f'<c r="{ref}"><v>{value}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    lines = "".join(f'<row r="{r}">' + "".join(cell(v, r, c) for c, v in enumerate(row)) + "</row>" for r, row in enumerate([tuple(names), *rows], 1))
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    files = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{lines}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    return out.getvalue()


def workbooks(rows: DataFrame, per_file: int = 100_000) -> DataFrame:
    """``(name, content)``: workbooks of at most ``per_file`` rows as bytes, made on the
    executors; any sink that takes binary columns can keep them."""
    names = rows.columns

    def run(batches):
        import uuid

        import pandas as pd

        for b in batches:
            for at in range(0, len(b), per_file):
                part = [tuple(None if v != v else v for v in r) for r in b.iloc[at : at + per_file].itertuples(index=False)]
                yield pd.DataFrame({"name": [f"part-{uuid.uuid4().hex}.xlsx"], "content": [xlsx_bytes(part, names)]})

    return rows.mapInPandas(run, "name string, content binary")


def write_xlsx(rows: DataFrame, folder: str, per_file: int = 100_000) -> DataFrame:
    """``(path)`` of the workbooks written into ``folder``, which driver and executors
    must share as a path (``workbooks`` needs none); the driver sees their names only."""

    def run(batches):
        import os

        os.makedirs(folder, exist_ok=True)
        for b in batches:
            paths = [os.path.join(folder, n) for n in b["name"]]
            for path, content in zip(paths, b["content"]):
                with open(path, "wb") as f:
                    f.write(content)
            yield b.assign(path=paths)[["path"]]

    return workbooks(rows, per_file).mapInPandas(run, "path string")


#: Columns of the flat report, in order.
FLAT = ("file", "decision", "score", "level1", "level2", "level3", "level4", "issues", "critical", "generated")


def flat_report(rows: DataFrame, generated: str | None = None) -> DataFrame:
    """The report's columns, those that ``rows`` lacks empty; ``generated`` is the time
    written into every row (now if none is given)."""
    time = F.lit(generated) if generated else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    have = {**{c: F.col(c) for c in rows.columns}, "generated": time}
    return rows.select(*[have.get(c, F.lit(None).cast("string")).alias(c) for c in FLAT])


def console_lines(rows: DataFrame, issues: DataFrame, first: int = 3, key: str = "doc_id") -> DataFrame:
    """``(key, lines)``: a report for reading: the decision and score of each document and
    its issues, critical ones first, of each severity the ``first`` (as many as a screen
    shows) and how many more there are."""
    rank = F.when(F.lower("severity") == "critical", 0).when(F.lower("severity") == "major", 1).otherwise(2)
    one = issues.groupBy(key, F.lower("severity").alias("severity")).agg(F.min(rank).alias("k"), F.array_sort(F.collect_set("rule")).alias("names"))
    more = F.size("names") - first
    text = F.concat(F.upper("severity"), F.lit(": "), F.array_join(F.slice("names", 1, first), ", "), F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(""))
    packed = one.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("k", text.alias("t")))).alias("l"))
    head = F.concat_ws(" ", F.col("decision"), F.format_number("score", 1))
    return rows.join(packed, key, "left").select(key, F.concat(F.array(head), F.coalesce(F.transform("l", lambda x: x["t"]), F.array().cast("array<string>"))).alias("lines"))


def exit_code(decisions: DataFrame, decision: str = "decision") -> int:
    """What a command ends with: 2 if a document was rejected, 1 if one needs review,
    else 0. One row reaches the driver."""
    up = F.upper(F.col(decision))
    worst = decisions.agg(F.max(F.when(up == "REJECT", 2).when(up == "REVIEW", 1).otherwise(0))).first()[0]
    return int(worst or 0)


def batch_array(reports: DataFrame, path: str, report: str = "report") -> None:
    """All reports as one JSON array in each written file, brackets and commas included;
    rows stay where they are, so a file is an array of its partition's reports."""

    def run(batches):
        first = True
        for b in batches:
            for x in b[report]:
                yield b.iloc[:1].assign(value=("[" if first else ",") + x)[["value"]]
                first = False
            last = b
        if not first:
            yield last.iloc[:1].assign(value="]")[["value"]]

    reports.select(report).mapInPandas(run, "value string").write.mode("overwrite").text(path)


def calibration(rows: DataFrame, expected: str = "expected", got: str = "decision", score: str = "score") -> DataFrame:
    """``(expected, decision, n, mean, low, high)``: how decisions fall on documents whose
    right one is known."""
    return rows.groupBy(F.upper(expected).alias("expected"), F.upper(got).alias("decision")).agg(
        F.count("*").alias("n"), F.avg(score).alias("mean"), F.min(score).alias("low"), F.max(score).alias("high")
    )


def write_fixed(rows: DataFrame, path: str, key: str = "doc_id", text: str = "fixed") -> None:
    """Corrected documents, each in a folder of its own name with its text as it is."""
    rows.select(key, F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).option("lineSep", "\n").text(path)
