"""Production rules over labelled edges, compiled to rules over relations.

A production is a line `N a b`: a path of an edge `a` and an edge `b` makes an
edge `N`. `~a` follows an edge backwards. A line with a head alone makes an edge
from every node to itself. `#` starts a comment. Data-flow and points-to
analyses are such grammars.
"""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import datalog


def parse(text: str) -> list[tuple[str, list[tuple[str, bool]]]]:
    """(head, [(symbol, reversed), ..]) for each production."""
    out = []
    for line in text.splitlines():
        words = line.partition("#")[0].split()
        if not words:
            continue
        if words[0].startswith("~") or "~" in words:
            raise ValueError(f"not a production: {line}")
        out.append((words[0], [(w.removeprefix("~"), w.startswith("~")) for w in words[1:]]))
    return out


def rules(productions: list[tuple[str, list[tuple[str, bool]]]], names: dict[str, str]) -> list[str]:
    found = []
    for head, body in productions:
        atoms = [f"{names[s]}(x{i + 1}, x{i})" if back else f"{names[s]}(x{i}, x{i + 1})" for i, (s, back) in enumerate(body)]
        found.append(f"{names[head]}(x0, x{len(body)}) :- {', '.join(atoms) or 'node(x0)'}")
    return found


def run(edges: DataFrame, text: str) -> DataFrame:
    """All edges (src, dst, label) of the grammar's heads, given ones of these labels included, once each."""
    productions = parse(text)
    heads = sorted({h for h, _ in productions})
    symbols = sorted({*heads, *(s for _, body in productions for s, _ in body)})
    names = {s: f"s{i}" for i, s in enumerate(symbols)}
    relations = {names[s]: edges.where(F.col("label") == s).select("src", "dst").toDF("c0", "c1") for s in symbols}
    relations["node"] = edges.select(F.explode(F.array("src", "dst")).alias("c0"))
    made = datalog.run(rules(productions, names), relations)
    return fold(DataFrame.unionByName, [made[names[h]].toDF("src", "dst").withColumn("label", F.lit(h)) for h in heads])
