"""Word files and workbooks as rows, read member by member as their XML streams by.

A Word file's body is read in its order: paragraphs with their level, weight and list label, tables with
merged cells filled. A workbook is read as three tables (cells, shared texts, merged ranges) that Spark joins: a
sheet is never held in memory, nor are the texts that its cells share.
"""

from __future__ import annotations

import re
import zipfile
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree.ElementTree import Element, ParseError, fromstring, iterparse

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources.listing import opened

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DC = "{http://purl.org/dc/elements/1.1/}"
BODY = "ord int, kind string, nth int, text string, level int, bold boolean, label string, row int, col int, error string"
#: Heading styles of several languages, titles, the deepest level, and characters of a cell.
HEADING = re.compile(r"^(?:heading|título|titre|überschrift|заголовок|عنوان)\s*(\d)$", re.IGNORECASE)
TITLES = ("title", "subtitle", "العنوان", "عنوان رئيسي")
DEEPEST, MOST_COLUMNS = 6, 200
#: Bytes of a member that is parsed at once.
SMALL = 1 << 20
#: Number formats of dates and of times.
DATES, TIMES = (*range(14, 18), 22), (18, 19, 20, 21, 45, 46, 47)


def _whole(z: zipfile.ZipFile, member: str) -> Element | None:
    """The root of a member that is small enough to be held; None for others and for a damaged one, of which there
    may be a sound beginning."""
    if z.NameToInfo[member].file_size > SMALL:
        return None
    try:
        return fromstring(z.read(member))
    except (ParseError, zipfile.BadZipFile, zlib.error, EOFError):
        return None


def _events(z: zipfile.ZipFile, member: str, depth: int) -> Iterator[Element]:
    """Elements of a depth (the root is 1) as they end; what they held is let go after each."""
    if member not in z.NameToInfo:
        return
    if (small := _whole(z, member)) is not None:
        found = [small]
        for _ in range(depth - 1):
            found = [child for e in found for child in e]
        yield from found
        return
    with z.open(member) as f:
        at, above = 0, []
        for event, e in iterparse(f, ("start", "end")):
            if event == "start":
                at += 1
                above.append(e)
                continue
            above.pop()
            if at == depth:
                yield e
                e.clear()
                if above:
                    above[-1].remove(e)
            at -= 1


def _value(e: Element | None, name: str, of: str = "val") -> str | None:
    found = e.find(f"{W}{name}") if e is not None else None
    return found.get(f"{W}{of}") if found is not None else None


class _Styles:
    """What paragraph styles say, each with what it is based on."""

    def __init__(self, z: zipfile.ZipFile):
        self.by = {e.get(f"{W}styleId"): (_value(e, "name") or "", _value(e, "basedOn"), _value(e.find(f"{W}pPr"), "outlineLvl"), _numbered(e.find(f"{W}pPr"))) for e in _events(z, "word/styles.xml", 2) if e.tag == f"{W}style"}

    def chain(self, style: str | None) -> Iterator[tuple]:
        seen = set()
        while style in self.by and style not in seen:
            seen.add(style)
            yield self.by[style]
            style = self.by[style][1]

    def level(self, style: str | None, outline: str | None) -> int | None:
        """A heading's level: by the name of its style, its outline level, or what its style is based on."""
        for i, (name, _, above, _) in enumerate(self.chain(style)):
            m = HEADING.match(name.strip())
            if m or name.strip().lower() in TITLES:
                return min(int(m.group(1)) if m else 1, DEEPEST)
            outline = above if outline is None else outline
            if i == 0 and outline is not None and outline.isdigit() and int(outline) < 9:
                return min(int(outline) + 1, DEEPEST)
        return min(int(outline) + 1, DEEPEST) if outline is not None and outline.isdigit() and int(outline) < 9 else None

    def numbered(self, style: str | None) -> tuple[str | None, str | None]:
        return next((n for *_, n in self.chain(style) if n[0]), (None, None))


def _numbered(about: Element | None) -> tuple[str | None, str | None]:
    n = about.find(f"{W}numPr") if about is not None else None
    return _value(n, "numId"), _value(n, "ilvl")


def _spelled(n: int, form: str) -> str:
    if form in ("lowerLetter", "upperLetter"):
        letter = chr(97 + (n - 1) % 26) * (1 + (n - 1) // 26)
        return letter if form == "lowerLetter" else letter.upper()
    if form in ("lowerRoman", "upperRoman"):
        out = ""
        for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            out, n = out + sign * (n // value), n % value
        return out if form == "lowerRoman" else out.upper()
    return "" if form in ("bullet", "none") else str(n)


class _Lists:
    """Numbers of list paragraphs: a level goes on until a higher one does, then starts again."""

    def __init__(self, z: zipfile.ZipFile):
        forms, self.of, self.counts = {}, {}, {}
        for e in _events(z, "word/numbering.xml", 2):
            if e.tag == f"{W}abstractNum":
                forms[e.get(f"{W}abstractNumId")] = {x.get(f"{W}ilvl"): (int(_value(x, "start") or 1), _value(x, "numFmt") or "decimal", _value(x, "lvlText") or "") for x in e.findall(f"{W}lvl")}
            elif e.tag == f"{W}num":
                levels = dict(forms.get(_value(e, "abstractNumId"), {}))
                for o in e.findall(f"{W}lvlOverride"):
                    start, at = _value(o, "startOverride"), o.get(f"{W}ilvl")
                    if start and at in levels:
                        levels[at] = (int(start), *levels[at][1:])
                self.of[e.get(f"{W}numId")] = levels

    def label(self, number: str | None, level: str | None) -> str | None:
        levels, at = self.of.get(number), int(level or 0)
        if not levels or str(at) not in levels:
            return None
        counts = self.counts.setdefault(number, {})
        counts[at] = counts.get(at, levels[str(at)][0] - 1) + 1
        for deeper in [k for k in counts if k > at]:
            del counts[deeper]
        start = lambda k: counts.get(k, levels.get(str(k), (1,))[0])
        return re.sub(r"%(\d)", lambda m: _spelled(start(int(m.group(1)) - 1), levels.get(str(int(m.group(1)) - 1), (1, "decimal"))[1]), levels[str(at)][2])


def _text(p: Element) -> tuple[str, bool]:
    """A paragraph's text, and whether all of it is bold."""
    out, weights = [], []
    for r in p.iter(f"{W}r"):
        said = "".join(e.text or "" if e.tag == f"{W}t" else "\t" if e.tag == f"{W}tab" else "\n" if e.tag in (f"{W}br", f"{W}cr") else "" for e in r)
        out.append(said)
        if said.strip():
            b = r.find(f"{W}rPr/{W}b")
            weights.append(b is not None and b.get(f"{W}val") not in ("0", "false", "off"))
    return "".join(out).strip(), bool(weights) and all(weights)


def _cells(table: Element) -> Iterator[tuple[int, int, str]]:
    """Row, column and text of a table's cells; one that spans columns or rows says its text in each."""
    above: dict[int, str] = {}
    for r, row in enumerate(table.findall(f"{W}tr")):
        col, now = int(_value(row.find(f"{W}trPr"), "gridBefore") or 0), {}
        for cell in row.findall(f"{W}tc"):
            about = cell.find(f"{W}tcPr")
            span = int(_value(about, "gridSpan") or 1)
            merge = about.find(f"{W}vMerge") if about is not None else None
            goes_on = merge is not None and merge.get(f"{W}val") != "restart"
            text = above.get(col, "") if goes_on else "\n".join(_text(p)[0] for p in cell.findall(f"{W}p")).strip()
            for c in range(col, col + max(1, span)):
                yield r, c, text
                if merge is not None:
                    now[c] = text
            col += max(1, span)
        above = now


def _body(f, path: str) -> Iterator[tuple]:
    with zipfile.ZipFile(f) as z:
        styles, lists = _Styles(z), _Lists(z)
        if "word/document.xml" not in z.NameToInfo:
            raise ValueError("no Word document")
        order = paragraphs = tables = 0
        for e in _events(z, "word/document.xml", 3):
            if e.tag == f"{W}p":
                paragraphs += 1
                about = e.find(f"{W}pPr")
                text, bold = _text(e)
                style = _value(about, "pStyle")
                own, inherited = _numbered(about), styles.numbered(style)
                label = lists.label(own[0] or inherited[0], own[1] or inherited[1]) if own[0] or inherited[0] else None
                if text:
                    order += 1
                    yield order, "paragraph", paragraphs, text, styles.level(style, _value(about, "outlineLvl")), bold, label, None, None, None
            elif e.tag == f"{W}tbl":
                tables += 1
                order += 1
                for r, c, text in _cells(e):
                    yield order, "table", tables, text, None, None, None, r, c, None
        for e in _events(z, "docProps/core.xml", 2):
            if e.tag == f"{DC}title" and e.text:
                yield 0, "title", 0, e.text.strip(), None, None, None, None, None, None


def body(files: DataFrame) -> DataFrame:
    """``path, ord, kind, nth, text, level, bold, label, row, col, error``: the title, paragraphs that say
    something and the cells of tables, in the order of the body. ``nth`` counts all paragraphs, empty ones
    too, and tables; ``level`` is that of a declared heading, ``label`` the number of a list's paragraph. A
    broken file is one row with its error."""
    return opened(files, _body, BODY)


# --- workbooks -----------------------------------------------------------------------------------

CELLS = "sheet string, sheet_no int, row int, col int, shared int, cell string, error string"
SHARED = "shared int, cell string, error string"
MERGED = "sheet_no int, top int, left int, bottom int, right int, error string"
_PLACE = re.compile(r"([A-Z]+)(\d+)")


def place(name: str) -> tuple[int, int]:
    """Row and column, from 0, of a cell's name."""
    m = _PLACE.fullmatch(name.replace("$", ""))
    col = 0
    for c in m.group(1):
        col = 26 * col + ord(c) - 64
    return int(m.group(2)) - 1, col - 1


def _local(e: Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _all_text(e: Element) -> str:
    """A text of one or several runs; how it is pronounced is not part of it."""
    return "".join(t.text or "" for r in e for t in ([r] if _local(r) == "t" else r if _local(r) == "r" else []) if _local(t) == "t")


def _sheets(z: zipfile.ZipFile) -> tuple[list[tuple[str, str]], bool]:
    """Names and members of the sheets in order, and whether days count from 1904."""
    targets = {e.get("Id"): e.get("Target") for e in _events(z, "xl/_rels/workbook.xml.rels", 2)}
    out, late = [], False
    if "xl/workbook.xml" not in z.NameToInfo:
        raise ValueError("no workbook")
    for e in _events(z, "xl/workbook.xml", 2):
        late = late or _local(e) == "workbookPr" and e.get("date1904") in ("1", "true")
        for s in e if _local(e) == "sheets" else ():
            target = targets.get(next((v for k, v in s.attrib.items() if k.endswith("}id")), None), "")
            out.append((s.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out, late


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates."""
    own, out = set(), set()
    for e in _events(z, "xl/styles.xml", 2):
        if _local(e) == "numFmts":
            own |= {int(n.get("numFmtId")) for n in e if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", n.get("formatCode", "")), re.IGNORECASE)}
        elif _local(e) == "cellXfs":
            out |= {i for i, x in enumerate(e) if int(x.get("numFmtId", 0)) in (*DATES, *TIMES) or int(x.get("numFmtId", 0)) in own}
    return out


def _shown(value: str, kind: str, dated: bool, late: bool) -> str:
    """A value as a reader sees it: dates by the calendar, whole numbers without a fraction."""
    if kind == "b":
        return "TRUE" if value == "1" else "FALSE"
    if kind != "n":
        return value
    try:
        number = float(value)
    except ValueError:
        return value
    if dated and 0 <= number < 2_958_466:
        at = datetime(1904, 1, 1) if late else datetime(1899, 12, 30)
        when = at + timedelta(days=number)
        return when.date().isoformat() if number == int(number) else when.isoformat(" ", "seconds")
    return str(int(number)) if number == int(number) and abs(number) < 1e15 else repr(round(number, 4))


def _sheet_rows(f, path: str) -> Iterator[tuple]:
    with zipfile.ZipFile(f) as z:
        (sheets, late), dated = _sheets(z), _date_styles(z)
        for number, (name, member) in enumerate(sheets):
            row = -1
            # rows lie one deeper than sheetData, which is one deeper than the sheet
            for e in _events(z, member, 3):
                if _local(e) != "row":
                    continue
                row = int(e.get("r")) - 1 if e.get("r") else row + 1
                col = -1
                for c in e:
                    col = place(c.get("r"))[1] if c.get("r") else col + 1
                    kind = c.get("t", "n")
                    value = next((v for v in c if _local(v) == ("is" if kind == "inlineStr" else "v")), None)
                    if value is None or col >= MOST_COLUMNS:
                        continue
                    text = _all_text(value) if kind == "inlineStr" else value.text or ""
                    if kind == "s":
                        yield name, number, row, col, int(text), None, None
                    else:
                        yield name, number, row, col, None, _shown(text, kind, int(c.get("s", 0)) in dated, late), None


def _shared(f, path: str) -> Iterator[tuple]:
    with zipfile.ZipFile(f) as z:
        for i, e in enumerate(_events(z, "xl/sharedStrings.xml", 2)):
            yield i, _all_text(e), None


def _merged(f, path: str) -> Iterator[tuple]:
    with zipfile.ZipFile(f) as z:
        for number, (_, member) in enumerate(_sheets(z)[0]):
            for e in _events(z, member, 3):
                if _local(e) == "mergeCell":
                    first, _, last = e.get("ref").partition(":")
                    (top, left), (bottom, right) = place(first), place(last or first)
                    yield number, top, left, bottom, right, None


def cells(files: DataFrame) -> DataFrame:
    """``path, sheet, sheet_no, row, col, cell, error`` of workbooks: cells that hold something, rows and
    columns from 0; a merged range says its first cell's value throughout. A broken file is one row with
    its error.

    Shared texts meet the cells by a join on file and number; merged ranges meet their first cells, and
    are spread out after that."""
    found = opened(files, _sheet_rows, CELLS)
    texts = opened(files, _shared, SHARED).where("error is null").select(F.col("path").alias("p"), F.col("shared").alias("i"), F.col("cell").alias("text"))
    named = found.join(texts, (F.col("path") == F.col("p")) & (F.col("shared") == F.col("i")), "left")
    named = named.select("path", "sheet", "sheet_no", "row", "col", F.coalesce("cell", "text").alias("cell"), "error")
    ranges = opened(files, _merged, MERGED).where("error is null").select(F.col("path").alias("p"), F.col("sheet_no").alias("s"), "top", "left", "bottom", "right")
    met = named.join(ranges, (F.col("path") == F.col("p")) & (F.col("sheet_no") == F.col("s")) & (F.col("row") == F.col("top")) & (F.col("col") == F.col("left")), "left")
    spread = lambda a, b, own: F.explode(F.coalesce(F.sequence(a, b), F.array(own)))
    out = met.withColumn("r", spread(F.col("top"), F.col("bottom"), F.col("row"))).withColumn("c", spread(F.col("left"), F.least("right", F.lit(MOST_COLUMNS - 1)), F.col("col")))
    return out.select("path", "sheet", "sheet_no", F.col("r").alias("row"), F.col("c").alias("col"), "cell", "error")


def regions(cells: DataFrame, keys: list[str], gap: int = 2, axes: tuple[str, ...] = ("row", "col") * 3) -> DataFrame:
    """``cells`` with ``region``: the tables of a sheet. More than ``gap`` empty lines along the first axis
    part them; with more axes, more than ``gap`` empty columns within a part do, and so on in turn.
    Regions are numbered from 0, from the top, then from the left.

    Gaps are sought among the lines that hold something, not among cells: a row for each."""
    out = cells.withColumn("region", F.lit(0).cast("long"))
    whole = Window.partitionBy(*keys)
    for axis in axes:
        w = Window.partitionBy(*keys, "region").orderBy(axis)
        starts = F.coalesce((F.col(axis) - F.lag(axis).over(w) - 1 > gap).cast("int"), F.lit(0))
        lines = out.select(*keys, "region", axis).distinct().withColumn("s", starts)
        lines = lines.withColumn("part", F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("s")
        lines = lines.withColumn("next", F.dense_rank().over(whole.orderBy("region", "part")).cast("long") - 1).drop("part")
        out = out.join(lines, [*keys, "region", axis]).withColumn("region", F.col("next")).drop("next")
    first = out.groupBy(*keys, "region").agg(F.min("row").alias("__r"), F.min("col").alias("__c"))
    first = first.withColumn("__n", F.row_number().over(whole.orderBy("__r", "__c")).cast("long") - 1).drop("__r", "__c")
    return out.join(first, [*keys, "region"]).withColumn("region", F.col("__n")).drop("__n")
