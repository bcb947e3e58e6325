"""Spreadsheets as a Spark data source: format("sheet"), all cells strings, with the row's number.

The workbook is a zip of XML files and is read with the standard library; one workbook is one task.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def column_number(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def read_sheet(path: str, sheet: str | None = None) -> Iterator[list[str | None]]:
    """The rows of a sheet (the first without a name); missing cells are None, whole numbers lose their '.0'."""
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ET.parse(z.open("xl/sharedStrings.xml")).getroot().iter(f"{NS}si"):
                shared.append("".join(t.text or "" for r in [si, *si.iter(f"{NS}r")] for t in r.findall(f"{NS}t")))
        names = {s.get("name"): s.get(REL) for s in ET.parse(z.open("xl/workbook.xml")).getroot().iter(f"{NS}sheet")}
        targets = {r.get("Id"): r.get("Target") for r in ET.parse(z.open("xl/_rels/workbook.xml.rels")).getroot()}
        target = targets[names[sheet] if sheet else next(iter(names.values()))].lstrip("/")
        for _, row in ET.iterparse(z.open(target if target.startswith("xl/") else f"xl/{target}")):
            if row.tag != f"{NS}row":
                continue
            cells: list[str | None] = []
            for c in row.iter(f"{NS}c"):
                at = column_number(c.get("r")) if c.get("r") else len(cells)
                v, kind = c.find(f"{NS}v"), c.get("t")
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{NS}t"))
                elif v is None or v.text is None:
                    value = None
                elif kind == "s":
                    value = shared[int(v.text)]
                else:
                    value = re.sub(r"^(-?\d+)\.0$", r"\1", v.text)
                cells += [None] * (at - len(cells) + 1)
                cells[at] = value
            yield cells
            row.clear()


class SheetReader(DataSourceReader):
    def __init__(self, path: str, sheet: str | None, header: bool, width: int):
        self.path, self.sheet, self.header, self.width = path, sheet, header, width

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        at = 0
        for i, cells in enumerate(read_sheet(self.path, self.sheet)):
            if i or not self.header:
                yield (at, *(cells + [None] * self.width)[: self.width])
                at += 1


class Sheet(DataSource):
    """Options: path, sheet, header (true: the first row names the columns; unnamed ones are c<number>)."""

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def columns(self) -> list[str]:
        first = next(read_sheet(self.options["path"], self.options.get("sheet")), [])
        named = self.options.get("header", "true").lower() == "true"
        return [(x if named and x else f"c{i}") for i, x in enumerate(first)]

    def schema(self) -> str:
        return "row_index long, " + ", ".join(f"`{c}` string" for c in self.columns())

    def reader(self, schema) -> DataSourceReader:
        return SheetReader(self.options["path"], self.options.get("sheet"), self.options.get("header", "true").lower() == "true", len(schema.fields) - 1)


def read(spark: SparkSession, path: str, sheet: str | None = None, header: bool = True) -> DataFrame:
    spark.dataSource.register(Sheet)
    r = spark.read.format("sheet").option("path", path).option("header", str(header).lower())
    return (r.option("sheet", sheet) if sheet else r).load()
