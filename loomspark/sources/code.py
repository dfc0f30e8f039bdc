"""Code as one reversible text, and its units."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dossier(files: DataFrame, group: list[str]) -> DataFrame:
    """group, path, header, text and the place of each file (path, text) in its group's dossier.

    A dossier is its files by path, each after a header line that tells its path and length, so it can be read back.
    """
    header = F.concat(F.lit("=== "), F.col("path"), F.lit(" "), F.length("text").cast("string"), F.lit("\n"))
    rows = files.withColumn("header", header)
    w = Window.partitionBy(*group).orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("header") + F.length("text") + 1).over(w), F.lit(0)) + F.length("header")
    return rows.select(*group, "path", "header", "text", start.cast("long").alias("char_start"), (start + F.length("text")).cast("long").alias("char_end"))


def dossier_text(placed: DataFrame, group: list[str]) -> DataFrame:
    rows = placed.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("char_start", F.concat("header", "text", F.lit("\n")).alias("t")))).alias("p"))
    return rows.select(*group, F.array_join(F.col("p.t"), "").alias("dossier"))


def units(text: str, target: int = 4000) -> list[tuple[str, int, int]]:
    """(name, first line, last line) of a Python text: its preamble, definitions, and classes above target characters cut at their members.

    Neighbouring small definitions are one unit up to target characters. What can't be parsed is one unit.
    """
    lines = text.splitlines(keepends=True)
    size = lambda a, b: sum(map(len, lines[a - 1 : b]))
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError):
        return [("<unparsed>", 1, max(1, len(lines)))]

    def first_line(node) -> int:
        return min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])

    def cut(nodes, lo: int, hi: int, prefix: str) -> list[tuple[str, int, int]]:
        named = [n for n in nodes if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]
        begins = [first_line(n) for n in named]
        if not named:
            return [(f"{prefix}<preamble>", lo, hi)]
        out = [(f"{prefix}<preamble>", lo, begins[0] - 1)] if begins[0] > lo else []
        for n, a, b in zip(named, begins, [*(x - 1 for x in begins[1:]), hi], strict=True):
            if isinstance(n, ast.ClassDef) and size(a, b) > target:
                out += cut(n.body, a, b, f"{prefix}{n.name}.")
            elif out and not out[-1][0].endswith("<preamble>") and size(out[-1][1], b) <= target:
                out[-1] = (f"{out[-1][0]},{prefix}{n.name}", out[-1][1], b)
            else:
                out.append((f"{prefix}{n.name}", a, b))
        return out

    return cut(body, 1, len(lines), "") if lines else []


def code_units(files: DataFrame, target: int = 4000) -> DataFrame:
    """path, unit_no, name, line_start, line_end of every Python file (path, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, i, *u) for p, t in zip(batch["path"], batch["text"], strict=True) if t is not None for i, u in enumerate(units(t, target))]
            yield pd.DataFrame(rows, columns=["path", "unit_no", "name", "line_start", "line_end"])

    return files.select("path", "text").mapInPandas(run, "path string, unit_no long, name string, line_start long, line_end long")
