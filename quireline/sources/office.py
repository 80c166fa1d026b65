"""Zip archives, workbooks and text documents, from the standard library alone.

``opened`` reads them from any file system that Spark reads, on the executors. The data
sources of the same names read a folder that driver and executors share as a path; each
file is one task there."""

from __future__ import annotations

import glob
import io
import os
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


class FilePartition(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    """Files of a folder or pattern, one partition each."""

    ending = ""

    def __init__(self, options) -> None:
        self.path = options.get("path", "")

    def partitions(self) -> list[FilePartition]:
        p = self.path.removeprefix("file:")
        found = sorted(glob.glob(os.path.join(p, "**", f"*{self.ending}"), recursive=True)) if os.path.isdir(p) else sorted(glob.glob(p))
        return [FilePartition(x) for x in found]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        try:
            yield from self.rows(partition.path)
        except (zipfile.BadZipFile, ET.ParseError, KeyError) as e:
            yield self.failed(partition.path, repr(e))

    def rows(self, path: str) -> Iterator[tuple]:
        raise NotImplementedError

    def failed(self, path: str, error: str) -> tuple:
        raise NotImplementedError


class ZipReader(_Reader):
    ending = ".zip"

    def rows(self, path):
        yield from zip_rows(path, path)

    def failed(self, path, error):
        return path, None, None, error


def zip_rows(file, path: str) -> Iterator[tuple]:
    """Members of an archive with their bytes."""
    with zipfile.ZipFile(file) as z:
        for info in z.infolist():
            if not info.is_dir():
                yield path, info.filename, z.read(info), None


class ZipSource(DataSource):
    """``(path, member, content, error)`` of the files in zip archives."""

    @classmethod
    def name(cls):
        return "zip_members"

    def schema(self):
        return "path string, member string, content binary, error string"

    def reader(self, schema):
        return ZipReader(self.options)


class DocxReader(_Reader):
    ending = ".docx"

    def rows(self, path):
        yield from docx_rows(path, path)

    def failed(self, path, error):
        return path, "error", -1, error


def docx_rows(file, path: str) -> Iterator[tuple]:
    """Paragraphs, table cells (each text once a table) and styled runs of two and
    more words of a text document."""
    with zipfile.ZipFile(file) as z:
        body = ET.fromstring(z.read("word/document.xml"))
    text = lambda e: "".join(t.text or "" for t in e.iter(_W + "t"))
    in_tables = {p for t in body.iter(_W + "tbl") for p in t.iter(_W + "p")}
    k = 0
    for p in body.iter(_W + "p"):
        t = text(p).strip()
        if t and p not in in_tables:
            yield path, "paragraph", k, t
            k += 1
        for r in p.iter(_W + "r"):
            style, s = r.find(_W + "rPr"), text(r).strip()
            if style is not None and len(s.split()) >= 2:
                for tag, kind in (("b", "bold"), ("i", "italic")):
                    mark = style.find(_W + tag)
                    if mark is not None and mark.get(_W + "val", "1") not in ("0", "false"):
                        yield path, kind, k, s
    for n, table in enumerate(body.iter(_W + "tbl")):
        seen = set()
        for c in table.iter(_W + "tc"):
            t = " ".join(text(p).strip() for p in c.iter(_W + "p")).strip()
            if t and t not in seen:
                seen.add(t)
                yield path, "cell", n, t


class DocxSource(DataSource):
    """``(path, kind, ord, text)`` of text documents."""

    @classmethod
    def name(cls):
        return "docx_parts"

    def schema(self):
        return "path string, kind string, ord int, text string"

    def reader(self, schema):
        return DocxReader(self.options)


class XlsxReader(_Reader):
    ending = ".xlsx"

    def rows(self, path):
        yield from xlsx_rows(path, path)

    def failed(self, path, error):
        return path, None, None, None, None, error, None, "error"


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def xlsx_rows(file, path: str) -> Iterator[tuple]:
    """Filled cells of all sheets of a workbook, values only."""
    with zipfile.ZipFile(file) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(_S + "si"):
                shared.append("".join(t.text or "" for t in si.iter(_S + "t")))
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for k, sheet in enumerate(ET.fromstring(z.read("xl/workbook.xml")).iter(_S + "sheet")):
            target = links[sheet.get(_R + "id")].lstrip("/")
            target = target if target.startswith("xl/") else "xl/" + target
            for row in ET.fromstring(z.read(target)).iter(_S + "row"):
                for c in row.iter(_S + "c"):
                    v, kind = c.find(_S + "v"), c.get("t", "n")
                    inline = c.find(_S + "is")
                    value = "".join(t.text or "" for t in inline.iter(_S + "t")) if inline is not None else v.text if v is not None else None
                    if value is None:
                        continue
                    if kind == "s":
                        value = shared[int(value)]
                    number = float(value) if kind == "n" else None
                    yield path, sheet.get("name"), k, int(row.get("r")), _column(c.get("r")), None if kind == "n" else value, number, kind


class XlsxSource(DataSource):
    """``(path, sheet, sheet_ord, row, col, v_str, v_num, cell_type)`` of workbooks."""

    @classmethod
    def name(cls):
        return "xlsx_cells"

    def schema(self):
        return "path string, sheet string, sheet_ord int, row int, col int, v_str string, v_num double, cell_type string"

    def reader(self, schema):
        return XlsxReader(self.options)


#: What each format's files are read by, and one row in place of a file that can't be.
_FORMATS = {"zip_members": (ZipSource, ZipReader, zip_rows), "docx_parts": (DocxSource, DocxReader, docx_rows), "xlsx_cells": (XlsxSource, XlsxReader, xlsx_rows)}


def opened(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of the files below ``path``, as the data source ``kind`` gives them, read
    from any file system; a file that can't be read is one row with its error. A file's
    bytes are in memory while it is read."""
    source, reader, rows = _FORMATS[kind]
    schema = source({}).schema()
    names = [x.split()[0] for x in schema.split(", ")]
    failed, ending = reader({}).failed, reader.ending
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{ending}").load(path).select("path", "content")

    def read(batches):
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                try:
                    got = list(rows(io.BytesIO(content), name))
                except (zipfile.BadZipFile, ET.ParseError, KeyError) as e:
                    got = [failed(name, repr(e))]
                yield pd.DataFrame(got, columns=names)

    return files.mapInPandas(read, schema)


def register(spark: SparkSession) -> None:
    """Make the formats ``zip_members``, ``docx_parts`` and ``xlsx_cells`` known."""
    for source in (ZipSource, DocxSource, XlsxSource):
        spark.dataSource.register(source)


def pair_in_archives(members: DataFrame, target: str = ".sgm", source: str = ".pdf") -> DataFrame:
    """``(path, member, source_member)``: the members with the ending ``target`` and, if
    their archive has one, the member of the same folder and stem with the ending
    ``source``; endings in any case, of several sources the first."""
    has = lambda end: F.endswith(F.lower("member"), F.lit(end))
    stem = lambda end: F.substring("member", F.lit(1), F.length("member") - len(end))
    t = members.where(has(target)).select("path", "member", stem(target).alias("__s"))
    s = members.where(has(source)).groupBy("path", stem(source).alias("__s")).agg(F.min("member").alias("source_member"))
    return t.join(s, ["path", "__s"], "left").drop("__s")
