"""Rows out of stored pages: links by regular expression, tables by a grid parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words in the heads of platform tables by the part that they name, headings of tables that do not
# describe today's platforms, marks of lines, and markup that is no text.
HEADS = {"track": ["番線", "のりば", "ホーム", "乗り場"], "line": ["路線"], "dir": ["方向"], "dest": ["行先", "行き先", "方面", "発着列車"], "type": ["種別"]}
NOT_NOW = "当時|変遷|旧|バス|廃止|歴史|移転|計画|改良工事以前|配線|信号"
MARKS = "[■□◆●○▲△]"
NOISE = [r'<sup[^>]*class="[^"]*reference[^"]*"[^>]*>.*?</sup>', r'<span class="mw-editsection">.*?</span>', r"<(style|script)\b.*?</\1>"]


def links(pages: DataFrame, key: str, html: str, pattern: str = 'href="([^"]*)"') -> DataFrame:
    """(key, ord, link): all matches in order, on the JVM side."""
    return pages.select(key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(pattern), 1)).alias("ord", "link"))


class _Grid(HTMLParser):
    """Cells of all tables with their headings, row and column spans filled in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[int, int, int, str, str]] = []
        self.heads: dict[int, str] = {}
        self.table, self.row, self.col, self.depth = -1, -1, 0, 0
        self.filled: dict[tuple[int, int], bool] = {}
        self.text: list[str] | None = None
        self.heading: int | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "table":
            self.table, self.row, self.filled = self.table + 1, -1, {}
        elif tag == "tr":
            self.row, self.col = self.row + 1, 0
        elif tag in ("td", "th"):
            self._end_cell()
            self.text, self.span = [], tuple(int(a[k]) if (a.get(k) or "").isdigit() else 1 for k in ("rowspan", "colspan"))
        elif len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            self.heading, self.text = int(tag[1]), []

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self._end_cell()
        elif self.heading is not None and tag == f"h{self.heading}":
            self.heads = {k: v for k, v in self.heads.items() if k < self.heading} | {self.heading: "".join(self.text or []).strip()}
            self.heading = self.text = None

    def handle_data(self, data):
        if self.text is not None:
            self.text.append(data)

    def _end_cell(self):
        if self.text is None or self.heading is not None or self.table < 0:
            return
        while (self.row, self.col) in self.filled:
            self.col += 1
        value, where = " ".join("".join(self.text).split()), " / ".join(self.heads[k] for k in sorted(self.heads))
        for i in range(min(self.span[0], 500)):
            for j in range(min(self.span[1], 100)):
                self.filled[self.row + i, self.col + j] = True
                self.rows.append((self.table, self.row + i, self.col + j, value, where))
        self.col += self.span[1]
        self.text = None


def cells(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table, row, col, value, heading): every cell of every table of a page."""
    kind = pages.schema[key].dataType.simpleString()

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for k, text in zip(part[key], part[html]):
                grid = _Grid()
                grid.feed(text or "")
                out += [(k, *r) for r in grid.rows]
            yield pd.DataFrame(out, columns=[key, "table", "row", "col", "value", "heading"])

    return pages.select(key, html).mapInPandas(rows, f"{key} {kind}, table long, row long, col long, value string, heading string")


def fare_bands(grid: DataFrame, today: str, least: int = 3) -> DataFrame:
    """(key, since, km, yen): bands of the newest column in force, where they are rising and at least ``least``.

    grid: cells whose row 0 holds dates from column 1 on, and whose column 0 holds kilometres.
    """
    from pyspark.sql import Window as W

    number = F.regexp_replace("value", "[^0-9]", "").try_cast("int")
    heads = grid.where("row = 0 and col > 0").select("key", "table", "col", F.try_to_date("value").alias("since")).where(F.col("since") <= F.lit(today).cast("date"))
    newest = heads.groupBy("key", "table").agg(F.max_by("col", "since").alias("col"), F.max("since").alias("since"))
    km = grid.where("row > 0 and col = 0").select("key", "table", "row", number.alias("km"))
    yen = grid.where("row > 0").join(newest, ["key", "table", "col"]).select("key", "table", "row", "since", number.alias("yen"))
    bands = km.join(yen, ["key", "table", "row"]).where("km is not null and yen is not null")
    w = W.partitionBy("key", "table")
    fine = bands.withColumn("n", F.count("*").over(w)).withColumn("rise", (F.col("yen") >= F.coalesce(F.lag("yen").over(w.orderBy("km")), F.lit(0))).cast("int")).withColumn("ok", F.min("rise").over(w))
    return fine.where((F.col("n") >= least) & (F.col("ok") == 1)).select("key", "since", "km", "yen")


def clean(text: Column) -> Column:
    """Cell text without marks of lines, with single spaces and none around a middle dot."""
    out = F.regexp_replace(F.replace(text, F.lit(" "), F.lit(" ")), MARKS, "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\s*・\s*", "・"), r"\s+", " "))


def train_details(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, line, origin, type, dest, stops array<struct<s,n,a,d>>) of train pages, on the JVM.

    The title reads '<line> 始発：<origin> <type> <dest>行き'; its parts are null where it does not.  A stop is
    a table row with a linked station name; a and d are clock times or null, s the station's number in its link.
    """
    found = lambda text, pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    head = F.regexp_replace(F.regexp_extract(html, r'(?s)ek-onetrain-title-inner">(.+?)</span>', 1), "<[^>]+>", " ")
    head = F.trim(F.regexp_replace(head, r"\s+", " "))
    title = r"^(.+?)[\s　]+始発[：:](.+?)\s+(.+?)[\s　]+(.+?)行き"
    part = lambda k: F.nullif(F.trim(F.regexp_extract(F.col("head"), title, k)), F.lit(""))
    rows = F.filter(F.regexp_extract_all(html, F.lit(r"(?s)<tr>(.*?)</tr>"), 1), lambda r: r.rlike(r'td-station-name"><a[^>]*>[^<]'))

    def stop(r: Column) -> Column:
        cell = F.regexp_extract(r, r'(?s)td-dep-and-arr-time">(.*?)</td>', 1)
        name = F.trim(F.regexp_extract(r, r'td-station-name"><a[^>]*>([^<]+)', 1))
        return F.struct(found(r, r"/station/(\d+)").alias("s"), name.alias("n"), found(cell, r"(\d+:\d+)着").alias("a"), found(cell, r"(\d+:\d+)発").alias("d"))

    return pages.select(key, head.alias("head"), F.transform(rows, stop).alias("stops")).select(key, part(1).alias("line"), part(2).alias("origin"), part(3).alias("type"), part(4).alias("dest"), "stops")


def train_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, sf, tx, departure, sff, d): trains that boards link to; of links with one tx the first of the smallest key."""
    pattern = r"/timetable/railway/train\?sf=(\d+)&tx=([^&]+)&dw=[^&]*&dt=[^&]*&departure=(\d{4})&SFF=([^&]+)&d=(\d+)"
    each = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(f"({pattern})"), 1)).alias("ord", "link"))
    parts = [F.regexp_extract("link", pattern, k).alias(c) for k, c in enumerate(("sf", "tx", "departure", "sff", "d"), 1)]
    first = each.select(key, "ord", *parts).groupBy("tx").agg(F.min(F.struct(key, "ord", "sf", "departure", "sff", "d")).alias("x"))
    return first.select(f"x.{key}", "x.sf", "tx", "x.departure", "x.sff", "x.d")


def _tables(text: str) -> Iterator[tuple[list[str], list[list[str]]]]:
    """Headings above and rows of cells of each table of a page."""
    grid = _Grid()
    for pattern in NOISE:
        text = re.sub(pattern, "", text, flags=re.S)
    grid.feed(text)
    grid.close()
    tables: dict[int, dict[tuple[int, int], str]] = {}
    above: dict[int, str] = {}
    for table, row, col, value, where in grid.rows:
        tables.setdefault(table, {})[row, col] = value
        above[table] = where
    for table, cells in tables.items():
        rows = [[cells.get((r, c), "") for c in range(1 + max(k for i, k in cells if i == r))] for r in sorted({r for r, _ in cells})]
        yield [h for h in above[table].split(" / ") if h], rows


def _columns(header: list[str]) -> dict[str, int]:
    """Column of each part of a platform table; every column serves one part, the first that it fits."""
    out: dict[str, int] = {}
    for i, head in enumerate(header):
        for part, words in HEADS.items():
            if part not in out and any(w == head if part == "dir" else w in head for w in words):
                out[part] = i
                break
    return out


def _platforms(text: str) -> list[dict[str, str]]:
    out = []
    for chain, rows in _tables(text):
        rows = [[_plain(c) for c in r] for r in rows]
        if len(rows) < 2 or any(re.search(NOT_NOW, h) for h in chain) or any("系統" in h for h in rows[0]):
            continue
        at = _columns(rows[0])
        if "track" not in at or not at.keys() & {"dest", "dir"}:
            continue
        over = [h for h in chain if not any(w in h for w in ("のりば", "乗り場", "ホーム")) and h not in ("駅構造", "駅概要", "構造")]
        operator = over[-1][:30] if over and over[-1] not in ("概要", "歴史", "利用状況", "駅周辺", "隣の駅", "その他") else ""
        for row in rows[1:]:
            track = row[at["track"]] if at["track"] < len(row) else ""
            said = {p: row[c][:80] for p, c in at.items() if p != "track" and c < len(row) and row[c]}
            real = re.search(r"\d", track) and len(track) <= 12 and "階" not in track
            unused = any(w in said.get("dest", "") for w in ("未使用", "降車"))
            divider = said and all(v == track for v in said.values())
            if real and not unused and not divider and said.keys() & {"dest", "dir"}:
                entry = {"track": track, "op": operator, **said}
                if entry not in out:
                    out.append(entry)
    return out


def _plain(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"\s*・\s*", "・", re.sub(MARKS, "", text.replace(" ", " ")))).strip()


def platform_entries(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, ord, track, line, dir, dest, type, op): rows of platform tables, each once a page.

    A platform table has a track column and one for direction or destination.  Tables under headings of other
    times or of buses, rows without a number for the track, unused or arrival-only platforms and divider rows
    are left out.  op: the last heading above that names no platform part of the page.
    """
    kind = pages.schema[key].dataType.simpleString()
    parts = ["track", "line", "dir", "dest", "type", "op"]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(k, i, *(e.get(p) or None for p in parts)) for k, text in zip(frame[key], frame[html]) for i, e in enumerate(_platforms(text or ""))]
            yield pd.DataFrame(out, columns=[key, "ord", *parts])

    return pages.select(key, html).mapInPandas(rows, f"{key} {kind}, ord long, " + ", ".join(f"{p} string" for p in parts))


def article_titles(name: Column, lines: Column, prefecture: Column) -> Column:
    """Titles under which a station's article may stand: listed names that hold it, its name, its name with the prefecture."""
    bare = F.regexp_replace(name, "[（(].*?[)）]$", "")
    base = F.concat(bare, F.lit("駅"))
    listed = F.filter(F.coalesce(lines, F.array().cast("array<string>")), lambda w: w.endswith("駅") & w.contains(bare))
    own = F.when(F.array_contains(listed, base), listed).otherwise(F.concat(listed, F.array(base)))
    return F.when(F.coalesce(prefecture, F.lit("")) != "", F.concat(own, F.array(F.concat(base, F.lit(" ("), prefecture, F.lit(")"))))).otherwise(own)
