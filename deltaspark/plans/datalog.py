"""Rules over relations, compiled to joins and run semi-naively.

A rule is text such as `path(a, c) :- path(a, b), edge(b, c), !blocked(c)`.
Constants are whole numbers or quoted words; `!` negates an atom. Rules are
sorted into strata by what they depend on; negation within a recursive stratum
is an error. In a recursive stratum each round joins, for every recursive atom
of a rule, that atom's newest rows with the others' rows so far.

An edge grammar (`N(a, c) :- N(a, b), e(b, c)`; a reversed edge is an atom with
its variables swapped) and points-to analyses are such programs.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce as fold

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut

_ATOM = re.compile(r"\s*(!?)\s*([A-Za-z_]\w*)\s*\(([^)]*)\)\s*")


@dataclass(frozen=True)
class Atom:
    relation: str
    terms: tuple
    negated: bool = False

    @property
    def variables(self) -> set[str]:
        return {t for t in self.terms if isinstance(t, str) and t[0] not in "'_"}


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple


def _term(text: str):
    text = text.strip()
    return int(text) if re.fullmatch(r"-?\d+", text) else text


def parse_rule(text: str) -> Rule:
    left, arrow, right = text.strip().rstrip(".").partition(":-")
    found, at = [], 0
    while at < len(right):
        m = _ATOM.match(right, at)
        if not m:
            raise ValueError(f"not an atom: {right[at:]}")
        found.append(Atom(m[2], tuple(_term(t) for t in m[3].split(",")), bool(m[1])))
        at = m.end()
        if at < len(right):
            if right[at] != ",":
                raise ValueError(f"expected a comma: {right[at:]}")
            at += 1
    head = _ATOM.fullmatch(left)
    if not arrow or not head or not found:
        raise ValueError(f"not a rule: {text}")
    rule = Rule(Atom(head[2], tuple(_term(t) for t in head[3].split(","))), tuple(sorted(found, key=lambda a: a.negated)))
    positive = set().union(*[a.variables for a in rule.body if not a.negated], set())
    for a in (rule.head, *[a for a in rule.body if a.negated]):
        if a.variables - positive:
            raise ValueError(f"{sorted(a.variables - positive)} not bound in {text}")
    return rule


def _bound(df: DataFrame, atom: Atom) -> DataFrame:
    """An atom's rows with its variables as columns."""
    names = [f"c{i}" for i in range(len(atom.terms))]
    df, first = df.toDF(*names), {}
    for name, term in zip(names, atom.terms):
        if isinstance(term, int):
            df = df.where(F.col(name) == term)
        elif term.startswith("'"):
            df = df.where(F.col(name) == term.strip("'"))
        elif term in first:
            df = df.where(F.col(name) == F.col(first[term]))
        elif term != "_":
            first[term] = name
    return df.select(*[F.col(c).alias(v) for v, c in first.items()])


def _fire(rule: Rule, tables: list[DataFrame]) -> DataFrame:
    """The head's rows from one table for each atom of the body."""
    out, bound = None, set()
    for atom, df in zip(rule.body, tables):
        own = _bound(df, atom)
        shared = sorted(bound & atom.variables)
        if atom.negated:
            if not shared:  # it speaks about the relation as a whole: one row of it refutes all
                out, own, shared = out.withColumn("__all", F.lit(1)), own.select(F.lit(1).alias("__all")).limit(1), ["__all"]
            out = out.join(own, shared, "left_anti").drop("__all")
        elif out is None:
            out = own
        elif shared:
            out = out.join(own, shared)
        else:
            raise ValueError(f"{atom.relation} shares no variable with the atoms before it")
        bound |= atom.variables
    columns = [F.col(t) if isinstance(t, str) and t[0] != "'" else F.lit(t if isinstance(t, int) else t.strip("'")) for t in rule.head.terms]
    return out.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)])


def _strata(rules: list[Rule]) -> list[set[str]]:
    """Heads in groups that depend on one another, dependencies first."""
    needs = {}
    for r in rules:
        needs.setdefault(r.head.relation, set()).update(a.relation for a in r.body)
    heads = set(needs)

    def closure(start: str) -> set[str]:
        seen, work = set(), [start]
        while work:
            for x in needs.get(work.pop(), set()) & heads - seen:
                seen.add(x)
                work.append(x)
        return seen

    reach = {h: closure(h) for h in heads}
    groups = {frozenset({h} | {x for x in reach[h] if h in reach[x]}) for h in heads}
    return [set(g) for g in sorted(groups, key=lambda g: (len(set().union(*[reach[h] for h in g]) | g), sorted(g)))]


def run(rules: Iterable[str], relations: Mapping[str, DataFrame], rounds: int = 10_000) -> dict[str, DataFrame]:
    """All derived relations (columns c0, c1, ..), as sets."""
    parsed = [parse_rule(r) for r in rules]
    known = {k: cut(v.distinct()) for k, v in relations.items()}
    for group in _strata(parsed):
        mine = [r for r in parsed if r.head.relation in group]
        if any(a.negated and a.relation in group for r in mine for a in r.body):
            raise ValueError(f"negation within the recursion of {sorted(group)}")
        start: dict[str, list[DataFrame]] = {h: [known[h]] if h in known else [] for h in group}
        for r in mine:
            if not any(a.relation in group for a in r.body):
                start[r.head.relation].append(_fire(r, [known[a.relation] for a in r.body]))
        for h, parts in start.items():
            if not parts:
                shape = next(r for r in mine if r.head.relation == h)
                spark = next(iter(relations.values())).sparkSession
                parts.append(spark.createDataFrame([], ", ".join(f"c{i} long" for i in range(len(shape.head.terms)))))
            known[h] = cut(fold(DataFrame.unionByName, [p.toDF(*[f"c{i}" for i in range(len(p.columns))]) for p in parts]).distinct())
        new = {h: known[h] for h in group}
        recursive = [r for r in mine if any(a.relation in group for a in r.body)]
        for _ in range(rounds if recursive else 0):
            made: dict[str, list[DataFrame]] = {}
            for r in recursive:
                for i, a in enumerate(r.body):
                    if a.relation in group and a.relation in new:
                        tables = [new[x.relation] if j == i else known[x.relation] for j, x in enumerate(r.body)]
                        made.setdefault(r.head.relation, []).append(_fire(r, tables))
            fresh = {h: cut(fold(DataFrame.unionByName, parts).distinct().join(known[h], known[h].columns, "left_anti")) for h, parts in made.items()}
            new = {h: df for h, df in fresh.items() if not df.isEmpty()}
            if not new:
                break
            for h, df in new.items():
                known[h] = cut(known[h].unionByName(df))
        else:
            if recursive:
                raise RuntimeError(f"no fixpoint after {rounds} rounds")
    return {h: known[h] for r in parsed for h in [r.head.relation]}
