"""Workbooks by the standard library: a sheet is a bounded driver-side table."""

from __future__ import annotations

import math
import posixpath
import re
import tempfile
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from itertools import chain, zip_longest
from pathlib import Path
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import types as T

from tarnwell.errors import SourceUnavailable

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
#: Names written out are found several times as fast as with prefixes.
_CELL, _FORMULA, _VALUE, _TEXT = (f"{{{_NS['m']}}}{x}" for x in "cfvt")
MAX_ROWS = 1_048_576
HEADER_SEARCH = 20


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n - 1


def _letters(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _range(text: str) -> tuple[int, int, int, int]:
    m = re.fullmatch(r"\$?([A-Z]+)\$?(\d+):\$?([A-Z]+)\$?(\d+)", text.upper())
    if not m:
        raise ValueError(f"not a cell range: {text!r}")
    return int(m[2]) - 1, _column(m[1]), int(m[4]) - 1, _column(m[3])


def _ended(part, tag: str, within: str) -> Iterator[ET.Element]:
    """The elements of a tag as they end; none is held once the next is asked for."""
    tag, within = f"{{{_NS['m']}}}{tag}", f"{{{_NS['m']}}}{within}"
    holder = None
    for event, e in ET.iterparse(part, ("start", "end")):
        if event == "start":
            if e.tag == within:
                holder = e
        elif e.tag == tag:
            yield e
            if holder is not None:
                holder.clear()


def sheet_rows(path: str, sheet: str | None = None, formulas: bool = False) -> Iterator[tuple[int, list[object]]]:
    """The place (from 0) and the cells of each row that a sheet has, read as they are asked for."""
    if not Path(path).exists():
        raise SourceUnavailable(f"no workbook at {path}")
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as part:
                shared = ["".join(t.text or "" for t in si.iter(_TEXT)) for si in _ended(part, "si", "sst")]
        dates = _date_styles(z)
        sheets = _sheets(z)
        if sheet is not None and sheet not in sheets:
            raise SourceUnavailable(f"no sheet {sheet!r}; there are {list(sheets)}")
        target = sheets[sheet] if sheet is not None else next(iter(sheets.values()))
        end = 0
        with z.open(target) as part:
            for row in _ended(part, "row", "sheetData"):
                at = int(row.get("r", end + 1)) - 1
                end = max(end, at + 1)
                cells: list[object] = []
                for cell in row.findall(_CELL):
                    m = re.match(r"([A-Z]+)", cell.get("r", ""))
                    k = _column(m[1]) if m else len(cells)
                    cells.extend([None] * (k + 1 - len(cells)))
                    cells[k] = _value(cell, shared, dates, formulas)
                yield at, cells


def _grid(path: str, sheet: str | None, formulas: bool) -> list[list[object]]:
    grid: list[list[object]] = []
    for at, cells in sheet_rows(path, sheet, formulas):
        grid.extend([] for _ in range(at + 1 - len(grid)))
        grid[at] = [a if b is None else b for a, b in zip_longest(grid[at], cells)]
    return grid


def _sheets(z: zipfile.ZipFile) -> dict[str, str]:
    """Sheet names and the parts that hold them, in order."""
    book = ET.fromstring(z.read("xl/workbook.xml"))
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    found = {s.get("name"): targets[s.get(f"{{{_NS['r']}}}id")] for s in book.iter(f"{{{_NS['m']}}}sheet")}
    return {n: t.lstrip("/") if t.startswith("/") else f"xl/{t}" for n, t in found.items()}


def named_range(path: str, name: str) -> tuple[str, str]:
    """The sheet and cells that a defined name stands for."""
    with zipfile.ZipFile(path) as z:
        book = ET.fromstring(z.read("xl/workbook.xml"))
    for d in book.iter(f"{{{_NS['m']}}}definedName"):
        if (d.get("name") or "").lower() == name.lower():
            m = re.fullmatch(r"(?:'((?:[^']|'')+)'|([^!']+))!(\$?[A-Za-z]+\$?\d+(?::\$?[A-Za-z]+\$?\d+)?)", (d.text or "").strip())
            if not m:
                raise SourceUnavailable(f"{name!r} stands for {d.text!r}, which isn't one range")
            cells = m[3] if ":" in m[3] else f"{m[3]}:{m[3]}"
            return (m[1] or m[2]).replace("''", "'"), cells
    raise SourceUnavailable(f"no defined name {name!r} in {path}")


def table_range(path: str, name: str) -> tuple[str, str]:
    """The sheet and cells of a table, header included."""
    with zipfile.ZipFile(path) as z:
        for sheet, part in _sheets(z).items():
            folder, _, file = part.rpartition("/")
            rels = f"{folder}/_rels/{file}.rels"
            if rels not in z.namelist():
                continue
            for r in ET.fromstring(z.read(rels)):
                if not (r.get("Type") or "").endswith("/table"):
                    continue
                target = r.get("Target") or ""
                target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"{folder}/{target}")
                found = ET.fromstring(z.read(target))
                if name.lower() in ((found.get("name") or "").lower(), (found.get("displayName") or "").lower()):
                    return sheet, found.get("ref")
    raise SourceUnavailable(f"no table {name!r} in {path}")


_range_of_name = named_range


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{{{_NS['m']}}}numFmt")}
    xfs = root.find("m:cellXfs", _NS)
    ids = [int(x.get("numFmtId", 0)) for x in xfs] if xfs is not None else []
    return {k for k, i in enumerate(ids) if 14 <= i <= 22 or re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^]]*\]', "", own.get(i, "")), re.I)}


def _value(cell, shared, dates, formulas):
    formula = cell.find(_FORMULA)
    if formulas and formula is not None:
        return "=" + (formula.text or "")
    kind, v = cell.get("t", "n"), cell.find(_VALUE)
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(_TEXT))
    if v is None or v.text is None:
        return None
    match kind:
        case "s":
            return shared[int(v.text)]
        case "b":
            return v.text == "1"
        case "e":
            return None
        case "str":
            return v.text
    x = float(v.text)
    if not math.isfinite(x):
        return None
    if int(cell.get("s", 0)) in dates:
        return datetime(1899, 12, 30) + timedelta(days=x)
    return int(x) if x.is_integer() and "." not in v.text and "e" not in v.text.lower() else x


def read_sheet(
    path: str, sheet: str | None = None, cell_range: str | None = None, header_row: int | None = None, formulas: bool = False,
    named_range: str | None = None, table: str | None = None,
) -> tuple[list[str], list[tuple]]:
    """Column names and rows of a sheet, or of a range, defined name or table of it.

    The header is the given row (from 1) or the first of 20 rows with two or
    more cells that are all text.  A blank header is ``column_<n>``, a repeated
    one gets ``_1``, ``_2``.  Blank rows are skipped; error cells are NULL.
    """
    if named_range or table:
        if not Path(path).exists():
            raise SourceUnavailable(f"no workbook at {path}")
        sheet, cell_range = _range_of_name(path, named_range) if named_range else table_range(path, table)
        header_row = header_row or 1
    grid = _grid(path, sheet, formulas)
    if cell_range:
        top, left, bottom, right = _range(cell_range)
        grid = [(r + [None] * (right + 1 - len(r)))[left : right + 1] for r in grid[top : bottom + 1]]
    if header_row is None:
        header_row = _header(enumerate(grid[:HEADER_SEARCH])) + 1
    if not 1 <= header_row <= len(grid):
        return [], []
    body = [r for r in grid[header_row:] if not _blank(r)]
    width = max([len(grid[header_row - 1]), *map(len, body)])
    names = _names(grid[header_row - 1], width)
    rows = [tuple(r + [None] * (width - len(r))) for r in body]
    kinds = sheet_schema(names, rows)
    return names, [tuple(_as(v, f.dataType) for v, f in zip(r, kinds, strict=True)) for r in rows]


def _header(rows) -> int:
    """The place of the first row with two or more cells that are all text; else 0."""
    return next((at for at, r in rows if len([x for x in r if x is not None]) >= 2 and all(isinstance(x, str) for x in r if x is not None)), 0)


def _blank(row: list[object]) -> bool:
    return all(x in (None, "") for x in row)


def _names(head: list[object], width: int) -> list[str]:
    names, used = [], {}
    for k in range(width):
        cell = head[k] if k < len(head) else None
        name = str(cell).strip() if cell is not None and str(cell).strip() else f"column_{k + 1}"
        used[name] = used.get(name, -1) + 1
        names.append(f"{name}_{used[name]}" if used[name] else name)
    return names


def sheet_records(path: str, sheet: str | None = None) -> tuple[list[str], Iterator[dict[str, object]]]:
    """The header's names and the rows of :func:`read_sheet` as they are in the file, one at a time.

    A row wider than the header has further names, ``column_<n>``.
    """
    rows = sheet_rows(path, sheet)
    first = []
    for at, cells in rows:
        first.append((at, cells))
        if at + 1 >= HEADER_SEARCH:
            break
    header = _header((at, r) for at, r in first if at < HEADER_SEARCH)
    head = next((r for at, r in first if at == header), [])
    names = _names(head, len(head))

    def records():
        wide = names
        for at, r in chain(first, rows):
            if at > header and not _blank(r):
                wide = wide if len(r) <= len(wide) else _names(head, len(r))
                yield dict(zip(wide, r, strict=False))

    return names, records()


def _as(v, kind):
    if v is None:
        return None
    if isinstance(kind, T.DoubleType):
        return float(v)
    if isinstance(kind, T.StringType):
        return v if isinstance(v, str) else str(v)
    return v


def sheet_schema(names: list[str], rows: list[tuple]) -> T.StructType:
    """One kind a column; whole and broken numbers are numbers, any other mix is text."""
    return T.StructType([T.StructField(n, kind_of({type(r[k]) for r in rows if r[k] is not None})) for k, n in enumerate(names)])


def kind_of(seen: set[type]) -> T.DataType:
    kinds = {frozenset({bool}): T.BooleanType(), frozenset({int}): T.LongType(), frozenset({float}): T.DoubleType(), frozenset({int, float}): T.DoubleType(), frozenset({datetime}): T.TimestampNTZType()}
    return kinds.get(frozenset(seen), T.StringType())


def write_sheet(path: str, names: list[str], rows, sheet: str = "Sheet1", append: bool = False) -> int:
    """Write (or append below, after a blank row) a headed block; returns the number of rows."""
    old: list[list[object]] = []
    if append and Path(path).exists():
        old = _grid(path, sheet, formulas=True)
        old.append([])
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    # the lines go to a file first: rows that can't be written leave an older workbook as it is
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", newline="", suffix=".xml") as part:
        part.write(f'{head}<worksheet xmlns="{_NS["m"]}"><sheetData>')
        lines = count = 0

        def line(values) -> None:
            nonlocal lines
            lines += 1
            if lines > MAX_ROWS:
                raise ValueError(f"a sheet holds {MAX_ROWS} rows")
            part.write(f'<row r="{lines}">{"".join(_cell(f"{_letters(k)}{lines}", v) for k, v in enumerate(values))}</row>')

        for values in old:
            line(values)
        line(names)
        for row in rows:
            line(row)
            count += 1
        part.write("</sheetData></worksheet>")
        part.flush()
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
            z.writestr("_rels/.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_NS["m"]}" xmlns:r="{rel}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
            z.write(part.name, "xl/worksheets/sheet1.xml")
    return count


def _cell(ref: str, v) -> str:
    if v is None or (isinstance(v, float) and not math.isfinite(v)):
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)):
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
