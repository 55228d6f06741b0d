"""Report sinks. Tables are written by the executors; only single-file reports, which people read, pass through the driver, up to a row limit."""

from __future__ import annotations

import csv
import io
import json
import re
from pathlib import Path

from pyspark.sql import DataFrame

#: Report names of columns.
NAMES = {"keyword": "Keyword", "source_url": "Source URL", "avg_monthly_searches": "Avg Monthly Searches", "competition": "Competition", "competition_index": "Competition Index", "low_cpc": "Low CPC", "high_cpc": "High CPC", "cpc_currency": "CPC Currency", "months_with_data": "Months With Data", "serp_results": "SERP #results", "serp_top_position": "SERP top position", "serp_top3_domains": "SERP top3 domains", "average_interest": "Average Interest"}
MOST_ROWS = 1_000_000


class UnsafePath(ValueError):
    """A report would be written outside the folder of reports."""


def report_path(path: str, root: str = "outputs") -> Path:
    base, at = Path(root).resolve(), Path(path)
    at = (at if at.is_absolute() else base / at).resolve()
    if at != base and base not in at.parents:
        raise UnsafePath(str(path))
    at.parent.mkdir(parents=True, exist_ok=True)
    return at


def file_suffix(inputs: list[str], most: int = 40) -> str:
    """A slug of the first input, and how many more there are."""
    if not inputs:
        return ""
    slug = re.sub(r"\W+", "_", re.sub(r"^https?://", "", inputs[0].strip())).strip("_")[:most]
    return slug + (f"_plus_{len(inputs) - 1}" if len(inputs) > 1 else "")


def named(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({a: b for a, b in NAMES.items() if a in rows.columns})


def _rows(rows: DataFrame) -> tuple[list[str], list[list]]:
    found = rows.limit(MOST_ROWS + 1).collect()
    if len(found) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows: write_table() has no such limit")
    return rows.columns, [list(r) for r in found]


def csv_bytes(rows: DataFrame) -> bytes:
    """UTF-8 with a mark in front, CRLF."""
    head, found = _rows(rows)
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator="\r\n")
    writer.writerow(head)
    writer.writerows(["" if v is None else v for v in r] for r in found)
    return b"\xef\xbb\xbf" + out.getvalue().encode()


def write_report(rows: DataFrame, path: str, kind: str, root: str = "outputs", text: str | None = None) -> str:
    """One file, csv or json (a list of records) or xlsx where openpyxl is installed; text goes beside it as .seo.txt."""
    at = report_path(path, root)
    if kind == "csv":
        at.write_bytes(csv_bytes(rows))
    elif kind == "json":
        head, found = _rows(rows)
        at.write_text(json.dumps([dict(zip(head, r, strict=True)) for r in found], ensure_ascii=False, default=str, indent=2))
    elif kind == "xlsx":
        write_workbook({"Report": rows}, path, root)
    else:
        raise ValueError(f"unknown kind of report: {kind}")
    if text is not None:
        at.with_suffix(".seo.txt").write_text(text)
    return str(at)


def sheet_name(name: str, taken: set[str]) -> str:
    """31 characters without []:*?/\\, no name twice."""
    base = re.sub(r"[\[\]:*?/\\]", "_", name)[:31] or "Sheet"
    out, k = base, 2
    while out.lower() in taken:
        out = f"{base[: 31 - len(str(k)) - 1]}_{k}"
        k += 1
    taken.add(out.lower())
    return out


def write_workbook(sheets: dict[str, DataFrame], path: str, root: str = "outputs") -> str:
    import openpyxl

    book, taken = openpyxl.Workbook(), set()
    book.remove(book.active)
    for name, rows in sheets.items():
        sheet = book.create_sheet(sheet_name(name, taken))
        head, found = _rows(rows)
        sheet.append(head)
        for r in found:
            sheet.append([", ".join(map(str, v)) if isinstance(v, list) else v for v in r])
    at = report_path(path, root)
    book.save(at)
    return str(at)


def write_table(rows: DataFrame, path: str, kind: str = "parquet") -> str:
    """Any number of rows, one file for each partition."""
    options = {"csv": {"header": True, "lineSep": "\r\n"}}.get(kind, {})
    rows.write.mode("overwrite").format(kind).options(**options).save(path)
    return path


def write_sheets(sheets: dict[str, DataFrame], path: str, kind: str = "parquet") -> list[str]:
    """A folder for each table."""
    taken: set[str] = set()
    return [write_table(rows, f"{path.rstrip('/')}/{sheet_name(name, taken)}", kind) for name, rows in sheets.items()]
