"""Schemas that drift between files: a list of all changes, and one consistent table.

Every file is profiled by column (types, value sketches), compared with the file before it in its stream,
and fields that went are matched with fields that came: by agreement of the runs both files publish, by
name, and by sketch. The matching is an optimal assignment per file.
"""

from __future__ import annotations

import csv
import difflib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .assignment import assign

_NUMBER = re.compile(r"\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)\s*(%?)(?:\s*[A-Za-zµ/]{1,8})?\s*")
_CELL = "file_name string, run_id string, path string, kind string, num double, text string"
_QUANTILES = [0.1, 0.3, 0.5, 0.7, 0.9]


def number_in(text: str) -> float | None:
    """The number a text states, with a percent sign or a short unit or neither; else None."""
    m = _NUMBER.fullmatch(text)
    return None if not m else float(m[1]) / (100 if m[2] else 1)


def _leaves(value: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    for name, inner in value.items():
        if isinstance(inner, dict) and inner:
            yield from _leaves(inner, f"{prefix}{name}.")
        else:
            yield prefix + name, inner


def _cell(value: object) -> tuple[str, float | None, str | None]:
    if value is None:
        return "null", None, None
    if isinstance(value, bool):
        return "str", float(value), str(value).lower()
    if isinstance(value, (int, float)):
        return "num", float(value), repr(value)
    text = value if isinstance(value, str) else json.dumps(value, sort_keys=True)
    return "str", number_in(text), text


def _csv_cell(text: str) -> tuple[str, float | None, str | None]:
    if not text.strip():
        return "null", None, None
    try:
        number = float(text)
    except ValueError:
        return "str", number_in(text), text
    return ("num" if np.isfinite(number) else "str"), number, text


def parse_line(raw: str | None, header: str | None, is_header: bool) -> list[tuple[str, str, float | None, str | None]]:
    """(path, kind, number, text) of a line's fields; none if the line can't be parsed whole."""
    try:
        if raw is None:
            return []
        if is_header:
            return [(name, "null", None, None) for name in next(csv.reader([raw], strict=True), [])]
        if header is None:
            value = json.loads(raw)
            return [(p, *_cell(v)) for p, v in _leaves(value)] if isinstance(value, dict) else []
        names, cells = next(csv.reader([header], strict=True), []), next(csv.reader([raw], strict=True), [])
        return [(n, *_csv_cell(c)) for n, c in zip(names, cells)] if len(names) == len(cells) else []
    except (ValueError, RecursionError, csv.Error):
        return []


def _parse(run_field: str):
    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for file_name, raw, header, first in zip(*(batch.column(c).to_pylist() for c in ("file_name", "raw", "header", "is_header"))):
                fields = parse_line(raw, header, first)
                run = next((t for p, _, _, t in fields if p == run_field or p.endswith("." + run_field)), None)
                out += [(file_name, run, p, k, n if n is None or np.isfinite(n) else None, t) for p, k, n, t in fields]
            columns = list(zip(*out)) or [()] * 6
            types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["file_name", "run_id", "path", "kind", "num", "text"])

    return parse


def read_cells(lines: DataFrame, run_field: str = "run_id") -> DataFrame:
    """The fields of every parseable line, one row each: ``file_name``, ``run_id``, ``path``, ``kind``, ``num``, ``text``.

    ``lines`` has ``file_name``, ``line_no`` and ``raw``. Names ending in ``.csv`` are CSV with the header in
    line 1, all others one JSON object per line. Lines read twice count once; null, cut-off and other
    unparseable lines give nothing. ``kind`` is ``num``, ``str`` or ``null``.
    """
    once = lines.where(F.col("file_name").isNotNull()).groupBy("file_name", "line_no").agg(F.max("raw").alias("raw"))
    is_csv = F.lower("file_name").endswith(".csv")
    first = once.where(is_csv & (F.col("line_no") == 1)).select(F.col("file_name").alias("__f"), F.col("raw").alias("header"))
    with_header = once.join(first, F.col("file_name") == F.col("__f"), "left").where(~is_csv | F.col("header").isNotNull())
    ready = with_header.select("file_name", "raw", "header", F.coalesce(is_csv & (F.col("line_no") == 1), F.lit(False)).alias("is_header"))
    return ready.mapInArrow(_parse(run_field), _CELL)


def profiles(cells: DataFrame) -> DataFrame:
    """One row per file and field: its type (``num``, ``str`` or null), fill and value sketch."""
    count = lambda kind: F.count_if(F.col("kind") == kind)
    return (
        cells.groupBy("file_name", "path")
        .agg(
            count("num").alias("nums"), count("str").alias("strs"), F.percentile_approx("num", _QUANTILES, 200).alias("deciles"),
            F.avg(F.length("text")).alias("length"), F.approx_count_distinct("text").alias("distinct"),
        )
        .withColumn("type", F.when(F.col("nums") + F.col("strs") == 0, None)
                    .when(F.lower("file_name").endswith(".csv"), F.when(F.col("strs") == 0, "num").otherwise("str"))
                    .otherwise(F.when(F.col("nums") > F.col("strs"), "num").otherwise("str")))
    )


def previous_files(lines: DataFrame) -> DataFrame:
    """``file_name``, ``stream``, ``written_at`` and the file before it in its stream (null for the first)."""
    files = lines.where("file_name is not null").groupBy("file_name").agg(F.min("stream").alias("stream"), F.min("written_at").alias("written_at"))
    return files.withColumn("before", F.lag("file_name").over(Window.partitionBy("stream").orderBy("written_at", "file_name")))


@lru_cache(maxsize=100_000)
def name_similarity(a: str, b: str) -> float:
    """0..1 of two names: equal letters in order, or shared words, whichever is more."""
    a, b = a.lower(), b.lower()
    words, others = (set(re.split(r"[_\W]+", x)) for x in (a, b))
    shared = len(words & others) / max(1, min(len(words), len(others))) * 0.9
    match = difflib.SequenceMatcher(None, a, b)
    # Letters in common bound the ratio: where they can't reach the words' share, they need no alignment.
    return max(match.ratio(), shared) if match.real_quick_ratio() > shared and match.quick_ratio() > shared else shared


def _sketch_similarity(a: dict, b: dict) -> float:
    if a["deciles"] and b["deciles"]:
        x, y = a["deciles"], b["deciles"]
        return 1 - sum(abs(p - q) / (abs(p) + abs(q) + 1e-12) for p, q in zip(x, y)) / len(x)
    if a["length"] is None or b["length"] is None:
        return 0.0
    return (1 - abs(a["length"] - b["length"]) / (a["length"] + b["length"] + 1e-12)) * (0.9 if a["type"] == b["type"] else 0.5)


def match_fields(went: list[dict], came: list[dict], evidence: dict[tuple[str, str], tuple[int, int]]) -> list[tuple[int, int]]:
    """Which removed field is which added one; fields have ``path``, ``type``, ``deciles`` and ``length``.

    Where runs published in both files have values in both fields, at least half of them must agree; without
    such a run, the last names must be equal or alike and the sketches not contradict. Among the possible
    pairs an optimal assignment decides.
    """
    score = np.zeros((len(went), len(came)))
    for i, a in enumerate(went):
        for j, b in enumerate(came):
            compared, agreed = evidence.get((a["path"], b["path"]), (0, 0))
            if compared and agreed * 2 <= compared:
                continue
            name = name_similarity(a["path"].rpartition(".")[2], b["path"].rpartition(".")[2])
            if compared:
                score[i, j] = 2 + agreed / compared + min(agreed, 3) / 3 + name / 2 + _sketch_similarity(a, b) / 4
            elif name >= 0.55:
                sketch = _sketch_similarity(a, b)
                if name >= 0.99 or sketch >= 0.3:
                    score[i, j] = name + sketch / 4
    return [(i, j) for i, j in assign(-score) if score[i, j] > 0] if score.any() else []


def _changes(group: pa.Table) -> pa.Table:
    rows = group.to_pylist()
    file_name = rows[0]["file_name"] if rows else None
    now, old = ({r["path"]: r for r in rows if r["side"] == side} for side in ("now", "old"))
    evidence = {(r["old_path"], r["path"]): (r["compared"], r["agreed"]) for r in rows if r["side"] == "evidence"}
    came, went = ([a[p] for p in sorted(a.keys() - b.keys())] for a, b in ((now, old), (old, now)))
    out: list[tuple[str, str, str]] = []
    same = [(p, old[p]["type"], now[p]["type"]) for p in sorted(now.keys() & old.keys())]
    pairs = match_fields(went, came, evidence)
    for i, j in pairs:
        a, b = went[i]["path"], came[j]["path"]
        out.append((b, a, "moved" if a.rpartition(".")[2] == b.rpartition(".")[2] else "renamed"))
        same.append((b, went[i]["type"], came[j]["type"]))
    out += [(p, p, "retyped") for p, a, b in same if a and b and a != b]
    gone, found = {i for i, _ in pairs}, {j for _, j in pairs}
    out += [(f["path"], "", "added") for k, f in enumerate(came) if k not in found]
    out += [(f["path"], f["path"], "removed") for k, f in enumerate(went) if k not in gone]
    path, before, kind = zip(*out) if out else ((), (), ())
    return pa.table({
        "file_name": pa.array([file_name] * len(out), pa.string()), "field_path": pa.array(path, pa.string()), "old_path": pa.array(before, pa.string()), "change_kind": pa.array(kind, pa.string()),
    })


def _drift(lines: DataFrame, cells: DataFrame) -> DataFrame:
    files = previous_files(lines).select(F.col("file_name").alias("__now"), "before")
    fields = profiles(cells)
    pairs = files.where("before is not null")
    columns = ["path", "type", "deciles", "length"]
    now = fields.join(pairs, F.col("file_name") == F.col("__now")).select("file_name", F.lit("now").alias("side"), *columns)
    old = fields.join(pairs, F.col("file_name") == F.col("before")).select(F.col("__now").alias("file_name"), F.lit("old").alias("side"), *columns)
    # Fields on one side only; of those, what runs published in both files say.
    sides = cut(now.unionByName(old))
    lone = sides.groupBy("file_name", "path").agg(F.min("side").alias("side"), F.count("*").alias("n")).where("n = 1").drop("n")
    runs = cells.where("run_id is not null and kind != 'null'").groupBy("file_name", "run_id", "path").agg(F.min("num").alias("num"), F.min("text").alias("text"))
    came = runs.join(pairs, F.col("file_name") == F.col("__now")).join(lone.where("side = 'now'").drop("side"), ["file_name", "path"])
    went = (
        runs.join(pairs, F.col("file_name") == F.col("before"))
        .select(F.col("__now").alias("file_name"), "run_id", "path", "num", "text")
        .join(lone.where("side = 'old'").drop("side"), ["file_name", "path"])
        .select("file_name", "run_id", F.col("path").alias("old_path"), F.col("num").alias("old_num"), F.col("text").alias("old_text"))
    )
    close = F.abs(F.col("num") - F.col("old_num")) <= 1e-6 + 1e-6 * F.abs("old_num")
    agrees = F.coalesce(F.when(F.col("num").isNotNull() & F.col("old_num").isNotNull(), close).otherwise(F.col("text") == F.col("old_text")), F.lit(False))
    evidence = (
        came.select("file_name", "run_id", "path", "num", "text")
        .join(went, ["file_name", "run_id"])
        .groupBy("file_name", "path", "old_path")
        .agg(F.count("*").alias("compared"), F.count_if(agrees).alias("agreed"))
        .withColumn("side", F.lit("evidence"))
    )
    each = sides.unionByName(evidence, allowMissingColumns=True)
    return each.groupBy("file_name").applyInArrow(_changes, "file_name string, field_path string, old_path string, change_kind string")


def drift_changes(lines: DataFrame, run_field: str = "run_id") -> DataFrame:
    """All changes, file by file: ``file_name``, ``field_path``, ``old_path``, ``change_kind``.

    Kinds are ``added``, ``removed``, ``renamed`` (another last name), ``moved`` (another parent) and
    ``retyped`` (number to string or back). ``lines`` has ``stream``, ``file_name``, ``written_at``,
    ``line_no`` and ``raw``; other columns are ignored. A file is compared with the one before it in its
    stream by ``written_at``, then name; the first has no changes. Rows without a file name are ignored, a
    null stream or time is a stream or the earliest time of its own. A file without a parseable line has no
    fields. An empty table has no changes.
    """
    return _drift(lines, cut(read_cells(lines, run_field)))


def _roots(stream: tuple, steps: pd.DataFrame) -> pd.DataFrame:
    """For each file and field of a stream, the name the field had first."""
    out: list[tuple[str, str, str]] = []
    known: dict[str, str] = {}
    for _, rows in steps.sort_values(["written_at", "file_name"]).groupby(["written_at", "file_name"], sort=True, dropna=False):
        renames = {r.path: r.old_path for r in rows.itertuples() if r.old_path}
        known |= {new: known.get(old, old) for new, old in renames.items()}
        out += [(rows.file_name.iloc[0], r.path, known.get(r.path, r.path)) for r in rows.itertuples() if r.path]
    return pd.DataFrame(out, columns=["file_name", "path", "root"])


def unified_rows(lines: DataFrame, run_field: str = "run_id") -> DataFrame:
    """One consistent table of all runs: ``stream``, ``file_name``, the run and one column per field.

    A field keeps the last name of the first path it had in its stream, through all renames and moves, and
    fields of different streams with the same name share a column. A column is a number where most of its
    values state one. Of a run published in several files, the first file's row counts. Only the list of
    columns and their types comes to the driver, as a table's schema does.
    """
    cells = cut(read_cells(lines, run_field))
    changes = _drift(lines, cells).where("change_kind in ('renamed', 'moved')")
    files = previous_files(lines).drop("before")
    step = cells.select("file_name", "path").distinct().join(
        changes.select("file_name", F.col("field_path").alias("path"), "old_path"), ["file_name", "path"], "left"
    ).join(files, "file_name")
    roots = step.groupBy("stream").applyInPandas(_roots, "file_name string, path string, root string")
    named = cells.where("run_id is not null").join(roots, ["file_name", "path"]).join(files, "file_name")
    named = cut(named.withColumn("field", F.lower(F.element_at(F.split("root", "\\."), -1))).where(F.col("field") != run_field))
    kinds = named.where("kind != 'null'").groupBy("field").agg((F.count("num") * 2 > F.count("*")).alias("is_num"))
    schema = sorted((r.field, r.is_num) for r in named.select("field").distinct().join(kinds, "field", "left").collect())
    first = F.struct("written_at", "file_name")
    home = named.groupBy(F.col("stream").alias("__s"), F.col("run_id").alias("__r")).agg(F.min(first).alias("home"))
    at_home = F.col("stream").eqNullSafe(F.col("__s")) & (F.col("run_id") == F.col("__r")) & (F.col("file_name") == F.col("home.file_name"))
    own = named.join(home, at_home).select("stream", "run_id", "file_name", "field", "num", "text")
    value = lambda field, is_num: F.min(F.when(F.col("field") == field, F.col("num") if is_num else F.col("text"))).alias(field)
    taken = {"stream", "run_id", "file_name"}
    return own.groupBy("stream", "run_id", "file_name").agg(*[value(f, n) for f, n in schema if f not in taken])
