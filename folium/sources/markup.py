"""Readers of marked-up sources: line-based XML, page streams, dictionaries, authority records, manifests, catalogues.

Each takes rows of raw text (path or id, and the whole text of one file or the
files' lines) and keeps to one pass a file; what continues across lines or
volumes is carried by a window over a file's own rows."""

from __future__ import annotations

import xml.sax
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class _Lines(xml.sax.ContentHandler):
    """Events of one text: lines begin at <lb n= ed=>; lines of another edition are counted only."""

    def __init__(self, edition: str):
        super().__init__()
        self.edition, self.rows, self.foreign = edition, [], 0
        self.kind, self.line, self.note, self.app, self.reading = ["p"], None, 0, [], None

    def _open(self, n: str) -> None:
        self.line = {"locator": n, "kind": self.kind[-1], "content": "", "notes": "", "apparatus": []}
        self.rows.append(self.line)

    def startElement(self, name, attrs):  # noqa: N802
        if name == "lb":
            if attrs.get("ed", self.edition) == self.edition:
                self._open(attrs.get("n", ""))
            else:
                self.foreign += 1
        elif name in ("lg", "head"):
            self.kind.append("verse" if name == "lg" else "head")
            if self.line is not None and not self.line["content"]:
                self.line["kind"] = self.kind[-1]
        elif name == "note":
            self.note += 1
        elif name == "app":
            self.app.append({"lem": "", "rdgs": []})
        elif name in ("lem", "rdg") and self.app:
            self.reading = (name, attrs.get("wit", ""), [])
        elif name == "g" and self.line is not None:
            self._text(attrs.get("ref", ""))

    def endElement(self, name):  # noqa: N802
        if name in ("lg", "head"):
            self.kind.pop()
        elif name == "note":
            self.note -= 1
        elif name in ("lem", "rdg") and self.reading:
            kind, wit, text = self.reading
            self.reading = None
            if kind == "lem":
                self.app[-1]["lem"] = "".join(text)
            else:
                self.app[-1]["rdgs"].append({"text": "".join(text), "wit": wit.split()})
        elif name == "app" and self.app:
            done = self.app.pop()
            if self.line is not None:
                self.line["apparatus"].append(done)

    def _text(self, s: str) -> None:
        if self.reading:
            self.reading[2].append(s)
            if self.reading[0] == "rdg":  # variant readings are no part of the line
                return
        if self.line is not None:
            self.line["notes" if self.note else "content"] += s.replace("\n", "")

    characters = _text


TEI = "path string, ordinal long, locator string, kind string, content string, notes string, apparatus array<struct<lem:string,rdgs:array<struct<text:string,wit:array<string>>>>>, foreign_lines long"


def tei_lines(files: DataFrame, edition: str = "T") -> DataFrame:
    """A row per line of each file (path, text): locator, kind (p, verse, head), content, notes, apparatus.

    A file is one streamed parse; memory grows with the file, not with the partition."""

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, text in zip(frame["path"], frame["text"], strict=True):
                handler = _Lines(edition)
                if text:
                    xml.sax.parseString(text.encode(), handler)
                rows = pd.DataFrame(handler.rows, columns=["locator", "kind", "content", "notes", "apparatus"])
                rows.insert(0, "path", path)
                rows.insert(1, "ordinal", range(len(rows)))
                rows["foreign_lines"] = handler.foreign
                yield rows

    return files.select("path", "text").mapInPandas(parsed, TEI)


def apparatus_variants(lines: DataFrame) -> DataFrame:
    """path, locator, lem, reading, witness: one row per witness of each variant."""
    apps = lines.select("path", "locator", F.explode("apparatus").alias("a")).select("path", "locator", "a.lem", F.explode("a.rdgs").alias("r"))
    return apps.select("path", "locator", "lem", F.col("r.text").alias("reading"), F.explode("r.wit").alias("witness"))


def page_stream(lines: DataFrame) -> DataFrame:
    """volume, line_no, work, page, line, text of a stream with <milestone unit="text" toh=>, <page n=> and <line n=> marks;
    a work or page holds until the next one, across volumes too (volumes are few, a work's lines stay together)."""
    attr = lambda tag, name: F.regexp_extract("value", rf'<{tag}\b[^>]*\b{name}="([^"]*)"', 1)
    held = lambda x, w: F.last(F.when(x != "", x), ignorenulls=True).over(w)
    inside = W.partitionBy("volume").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = lines.withColumn("work", held(attr("milestone", "toh"), inside)).withColumn("page", held(attr("page", "n"), inside)).withColumn("line", held(attr("line", "n"), inside))
    ends = rows.groupBy("volume").agg(F.max_by("work", F.when(F.col("work").isNotNull(), F.col("line_no"))).alias("end"))
    carried = ends.select("volume", F.last("end", ignorenulls=True).over(W.partitionBy().orderBy("volume").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))  # a row a volume
    text = F.trim(F.regexp_replace("value", r"<[^>]*>", ""))
    return rows.join(F.broadcast(carried), "volume").select("volume", "line_no", F.coalesce("work", "carried").alias("work"), "page", "line", text.alias("text")).where("text <> ''")


def volumes_assembled(lines: DataFrame) -> DataFrame:
    """work, volumes, first, last, contiguous, bytes of page_stream's rows: works that span volumes are one."""
    per = lines.groupBy("work").agg(F.count_distinct("volume").alias("volumes"), F.min("volume").alias("first"), F.max("volume").alias("last"), F.sum(F.octet_length("text")).alias("bytes"))
    return per.withColumn("contiguous", F.col("last") - F.col("first") + 1 == F.col("volumes"))


def records(files: DataFrame, tag: str, fields: dict[str, str]) -> DataFrame:
    """One row per <tag xml:id=..> record of each file: id, and each field's first match (a pattern with one group) or null."""
    pattern = rf"(?s)(<{tag}\b.*?</{tag}>)"
    rows = files.select("path", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("record"))
    got = lambda p: F.nullif(F.regexp_extract("record", p, 1), F.lit(""))
    return rows.select("path", got(r'xml:id="([^"]+)"').alias("id"), *[got(p).alias(name) for name, p in fields.items()])


#: Patterns of authority records.
PERSON = {"name": r"<persName[^>]*>([^<]+)<", "born": r'<birth[^>]*when="(\d{4}-\d\d-\d\d)"', "died": r'<death[^>]*when="(\d{4}-\d\d-\d\d)"', "dynasty": r'<note type="dynasty">([^<]+)<'}
PLACE = {"name": r"<placeName[^>]*>([^<]+)<", "lon": r"<geo>\s*(-?[\d.]+)[ ,]", "lat": r"<geo>\s*-?[\d.]+[ ,]+(-?[\d.]+)\s*<", "district": r"<district>([^<]+)<"}
ENTRY = {"headword": r"<orth[^>]*>([^<]+)<", "sense": r"<sense[^>]*>([^<]+)<", "reading": r"<pron[^>]*>([^<]+)<"}


def people(files: DataFrame) -> DataFrame:
    """id, name, born, died (dates), dynasty."""
    r = records(files, "person", PERSON)
    return r.select("id", "name", F.try_to_date("born").alias("born"), F.try_to_date("died").alias("died"), "dynasty")


def places(files: DataFrame) -> DataFrame:
    """id, name, lon, lat, district; coordinates are there whole and on earth, or not at all."""
    r = records(files, "place", PLACE).withColumn("lon", F.expr("try_cast(lon as double)")).withColumn("lat", F.expr("try_cast(lat as double)"))
    good = F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90)
    return r.select("id", "name", F.when(good, F.col("lon")).alias("lon"), F.when(good, F.col("lat")).alias("lat"), F.split("district", "/").alias("district"))


def dictionary(files: DataFrame) -> DataFrame:
    """headword, n (the headword's running number in its file), sense, reading."""
    r = records(files, "entry", ENTRY)
    return r.select("path", "headword", F.row_number().over(W.partitionBy("path", "headword").orderBy("id")).alias("n"), "sense", "reading")


def canvases(manifests: DataFrame) -> DataFrame:
    """volume, label, file of each page image of IIIF manifests (volume, json)."""
    schema = "sequences array<struct<canvases:array<struct<label:string,images:array<struct<resource:struct<`@id`:string>>>>>>>"
    c = manifests.select("volume", F.explode(F.flatten(F.from_json("json", schema)["sequences"]["canvases"])).alias("c"))
    return c.select("volume", "c.label", F.element_at(F.split(F.get("c.images", F.lit(0))["resource"]["@id"], "/"), -1).alias("file"))


def unihan(lines: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """character, attested: all readings that the named fields give a character (lines: U+XXXX, tab, field, tab, readings)."""
    cell = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#")).select(F.get(cell, F.lit(0)).alias("code"), F.get(cell, F.lit(1)).alias("field"), F.get(cell, F.lit(2)).alias("given"))
    spoken = rows.where(F.col("field").isin(*fields)).select("code", F.explode(F.filter(F.split("given", r"[\s,]+"), lambda x: x != "")).alias("reading"))
    glyph = F.decode(F.unhex(F.lpad(F.substring("code", 3, 6), 8, "0")), "UTF-32")
    return spoken.groupBy(glyph.alias("character")).agg(F.sort_array(F.collect_set(F.regexp_replace("reading", r"^[\d.,]+:", ""))).alias("attested"))


def cedict(lines: DataFrame) -> DataFrame:
    """traditional, simplified, reading, senses of lines such as 'T S [r] /sense/sense/'."""
    p = r"^(\S+) (\S+) \[([^\]]+)\] /(.+)/\s*$"
    part = lambda k: F.regexp_extract("value", p, k)
    return lines.where(F.col("value").rlike(p)).select(part(1).alias("traditional"), part(2).alias("simplified"), F.lower(part(3)).alias("reading"), F.split(part(4), "/").alias("senses"))


def work_list(paths: DataFrame) -> DataFrame:
    """canon, work, volumes, paths from names such as T/T09/T09n0262.xml, files in volume order."""
    p = r"([A-Z]+)(\d+)n([A-Za-z]?\d+[a-z]?)(?:_\d+)?\.xml$"
    part = lambda k: F.regexp_extract("path", p, k)
    rows = paths.where(F.col("path").rlike(p)).select("path", part(1).alias("canon"), part(2).cast("int").alias("volume"), part(3).alias("number"))
    grouped = rows.groupBy("canon", F.concat("canon", "number").alias("work")).agg(F.sort_array(F.collect_list(F.struct("volume", "path"))).alias("f"))
    return grouped.select("canon", "work", F.array_distinct(F.col("f.volume")).alias("volumes"), F.col("f.path").alias("paths"))


def running_head_stripped(lines: DataFrame, title: Column) -> DataFrame:
    """lines (file, page, line_no, value) without a page's first line where that is the title and numerals only."""
    first = F.row_number().over(W.partitionBy("file", "page").orderBy("line_no")) == 1
    rest = F.regexp_replace(F.replace("value", title, F.lit("")), r"[\s\d一二三四五六七八九十百〇]+", "")
    return lines.withColumn("_head", first & F.contains("value", title) & (rest == "")).where(~F.col("_head")).drop("_head")
