"""Reports as files: an HTML table, and JSON dumps."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def html_table(rows: DataFrame, title: str, most: int = 5_000) -> str:
    """A page with one table. A report of more than ``most`` rows is an error: it is for people."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows for a page")
    cell = lambda v: "–" if v is None or v != v else f"{v:.4f}" if isinstance(v, float) else html.escape(str(v))
    head = "".join(f"<th>{html.escape(c)}</th>" for c in rows.columns)
    body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in found)
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def latency_dump(rows: DataFrame, path: str) -> None:
    """One JSON document for each session: its latency rows in order and their number."""
    each = F.array_sort(F.collect_list(F.struct("phrase_t_start", "phrase_t_end", "latency_s", "label")))
    rows.groupBy("session_id").agg(F.count("*").alias("phrases"), each.alias("rows")).write.mode("overwrite").json(path)
