"""Small files of the driver: settings, JSON, text and CSV reports, run folders and XLSX sheets."""

from __future__ import annotations

import csv
import dataclasses
import datetime as dt
import json
import math
import os
import re
import tomllib
import zipfile
from collections.abc import Iterable
from pathlib import Path
from typing import Any
from xml.etree import ElementTree

from pyspark.sql import DataFrame

STAGES = ("diagnostic", "development", "locked")


@dataclasses.dataclass(frozen=True)
class Settings:
    primary_min_months: int = 1
    primary_max_months: int = 48
    prior_history_months: int = 24
    min_cell_n: int = 10
    diagnostic_seed: int = 20260618
    locked_seed: int = 20260619
    sample_size: int = 1000
    min_test_rows: int = 1000
    min_test_each_class: int = 100
    min_calibration_each_class: int = 50
    isotonic_each_class: int = 200
    auc_floor: float = 0.70
    max_calibration_gap: float = 0.03
    min_calibration_slope: float = 0.80
    max_calibration_slope: float = 1.20
    bootstrap_replicates: int = 1000


#: What must hold of settings besides their names.
RULES = (
    ("0 < primary_min_months < primary_max_months", lambda s: 0 < s.primary_min_months < s.primary_max_months),
    ("prior_history_months is 24", lambda s: s.prior_history_months == 24),
    ("sample_size is 1000", lambda s: s.sample_size == 1000),
    ("the two seeds differ", lambda s: s.diagnostic_seed != s.locked_seed),
    ("bootstrap_replicates is 100 or more", lambda s: s.bootstrap_replicates >= 100),
)


def load_settings(path: str | Path) -> Settings:
    """Settings of a TOML file; unknown sections and keys, and broken rules, raise."""
    with open(path, "rb") as file:
        raw = tomllib.load(file)
    if unknown := sorted(set(raw) - {"cohort", "pair_sample", "acceptance", "runtime"}):
        raise ValueError(f"unknown section {', '.join(unknown)}")
    if plain := sorted(k for k, v in raw.items() if not isinstance(v, dict)):
        raise ValueError(f"{', '.join(plain)} must be a section")
    flat = {k: v for section in raw.values() for k, v in section.items()}
    if unknown := sorted(set(flat) - {f.name for f in dataclasses.fields(Settings)}):
        raise ValueError(f"unknown setting {', '.join(unknown)}")
    out = Settings(**flat)
    for text, holds in RULES:
        if not holds(out):
            raise ValueError(f"settings: {text}")
    return out


def plain(value: Any) -> Any:
    """A value that JSON can hold: numbers that are none become null, days ISO text, keys text."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [plain(v) for v in (sorted(value) if isinstance(value, (set, frozenset)) else value)]
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    return str(value) if isinstance(value, Path) else value


def write_text(path: str | Path, text: str) -> None:
    """Replace a file in one step, so that a reader sees the old text or the new one."""
    path = Path(path)
    new = path.with_name(f".{path.name}.new")
    new.write_text(text, "utf-8")
    os.replace(new, path)


def write_json(path: str | Path, value: Any) -> None:
    write_text(path, json.dumps(plain(value), indent=2, sort_keys=True, allow_nan=False) + "\n")


def write_csv(df: DataFrame, path: str | Path, marked: bool = False) -> None:
    """A small report as one CSV file; ``marked`` leads it with a byte order mark, as working files have. Large tables go to ``df.write``."""
    rows = df.collect()
    path = Path(path)
    new = path.with_name(f".{path.name}.new")
    with open(new, "w", encoding="utf-8-sig" if marked else "utf-8", newline="") as file:
        out = csv.writer(file, lineterminator="\n")
        out.writerow(df.columns)
        out.writerows([["" if v is None or (isinstance(v, float) and math.isnan(v)) else v for v in row] for row in rows])
    os.replace(new, path)


@dataclasses.dataclass(frozen=True)
class RunPaths:
    root: Path
    results: Path
    working: Path
    models: Path


def create_run(base: str | Path, stage: str, token: str | None = None) -> RunPaths:
    """A new run folder ``<stage>_<token>``; one that is there already raises."""
    if stage not in STAGES:
        raise ValueError(f"a stage is one of {', '.join(STAGES)}")
    root = Path(base) / f"{stage}_{token or dt.datetime.now().strftime('%Y%m%d_%H%M%S_%f')}"
    root.mkdir(parents=True, exist_ok=False)
    out = RunPaths(root, root / "results", root / "working_files", root / "working_files" / "models")
    for folder in (out.results, out.working, out.models):
        folder.mkdir()
    return out


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Cell texts that a spreadsheet reader takes for a missing value.
MISSING = ("", "#N/A", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null", "<NA>", "#NA", "-NaN", "-nan", "1.#IND", "1.#QNAN", "-1.#IND", "-1.#QNAN", "#N/A N/A")


def _column_number(reference: str) -> int:
    out = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        out = out * 26 + ord(letter) - 64
    return out - 1


def read_xlsx(path: str | Path) -> tuple[list[str], list[list[str | None]]]:
    """Headings and rows of a workbook's first sheet as text; cells that read as missing are null."""
    with zipfile.ZipFile(path) as book:
        sheet = next(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        target = links[sheet.get(_LINK)].lstrip("/")
        shared = [] if "xl/sharedStrings.xml" not in book.namelist() else ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
        cells: list[dict[int, str]] = []
        for row in ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_SHEET}row"):
            own: dict[int, str] = {}
            for place, cell in enumerate(row.iter(f"{_SHEET}c")):
                value = cell.find(f"{_SHEET}v")
                text = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t")) if cell.get("t") == "inlineStr" else "" if value is None else value.text or ""
                at = _column_number(cell.get("r")) if cell.get("r") else place
                own[at] = shared[int(text)] if cell.get("t") == "s" and text else text
            cells.append(own)
    if not cells:
        raise ValueError(f"{path}: the first sheet is empty")
    width = max((max(r, default=-1) for r in cells), default=-1) + 1
    rows = [[r.get(i, "") for i in range(width)] for r in cells]
    return rows[0], [[None if v in MISSING else v for v in row] for row in rows[1:] if any(row)]


def write_xlsx(path: str | Path, headings: list[str], rows: Iterable[Iterable[Any]]) -> None:
    """One sheet of inline text; enough for a small file of inputs."""
    from xml.sax.saxutils import escape

    row = lambda values: "<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>' for v in values) + "</row>"
    space = _SHEET[1:-1]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        book.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{space}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/worksheets/sheet1.xml", f'<?xml version="1.0"?><worksheet xmlns="{space}"><sheetData>{row(headings)}{"".join(map(row, rows))}</sheetData></worksheet>')
