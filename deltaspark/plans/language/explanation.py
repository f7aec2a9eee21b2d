"""Explanations: for rows of a program's results, input rows that suffice for them.

The program runs on all its inputs while every round of its loops is kept. Wanted
rows are then traced from the exports to the inputs, each operator turning rows
wanted of its output into rows wanted of its inputs. Within a loop a row is wanted
at the rounds that changed it, up to the round that reads it; rounds are visited
from the last to the first, so each is visited once.

What has been found is tried: the program runs on those input rows alone, and rows
that this run makes and the whole run does not (where something subtracted is now
missing) are traced, too. This goes on until nothing more is wanted; a program that
only adds rows can't make such rows, and is traced once. From then on every wanted row has the same weight in both runs, so the input rows found give
the wanted results with their weights.

Questions are told apart by numbers. The rows found for all of them together
suffice for all; those of one question suffice for it alone if the program does
not subtract.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping
from functools import reduce as fold

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...collection import W
from ...storage import cut
from .parser import parse
from .run import Frames, ProgramError, Values, _plain, _Scoped, fixpoint
from .tree import Node, Scope, sources

#: The number of a question, and of the round that changed a row.
Q, AT = "q", "__at"
#: States of a loop that are compared in one plan.
BLOCK = 16


def _all(frames: list[DataFrame]) -> DataFrame:
    return fold(DataFrame.unionByName, frames)


def _uses(scope: Scope) -> set[tuple[str, str]]:
    """Names and scopes from outside that a scope looks at."""
    nodes = [*scope.lets.values(), *scope.vars.values(), *scope.exports.values()]
    found = set().union(*[_looks(n) for n in nodes], *[_uses(c) for c in scope.children.values()])
    return found - {("name", x) for x in (*scope.lets, *scope.vars)} - {("scope", x) for x in scope.children}


def _looks(node: Node) -> set[tuple[str, str]]:
    own = {("name", node.extra)} if node.op == "name" else {("scope", node.extra[0]), ("name", node.extra[1])} if node.op == "outer" else set()
    return own.union(*[_looks(x) for x in node.inputs])


def _users_first(scope: Scope) -> list[tuple[str, str]]:
    """A scope's lets and child scopes, each before all that it looks at."""
    needs = {("name", x): _looks(n) for x, n in scope.lets.items()} | {("scope", x): _uses(c) for x, c in scope.children.items()}
    done: dict = {}

    def visit(unit: tuple) -> None:
        if unit in needs and unit not in done:
            done[unit] = None
            for x in sorted(needs[unit]):
                visit(x)
            done[unit] = done.pop(unit)  # after what it looks at

    for unit in needs:
        visit(unit)
    return list(done)[::-1]


class _Trace:
    """What is wanted within a scope at one time; runs are the scope's rounds at that time."""

    def __init__(self, scope: Scope, runs: list[_Scoped], parent: _Trace | None, backend, found: dict):
        self.scope, self.runs, self.parent, self.backend, self.found = scope, runs, parent, backend, found
        self.needs: dict[tuple, list[DataFrame]] = defaultdict(list)

    def rows(self, node: Node) -> DataFrame:
        return _all([run.value(node) for run in self.runs])

    def name(self, name: str, wanted: DataFrame) -> None:
        if name in self.scope.vars or name in self.scope.lets:
            self.needs["var" if name in self.scope.vars else "name", name].append(wanted)
        else:
            self.parent.name(name, wanted)

    def outer(self, scope: str, name: str, wanted: DataFrame) -> None:
        if scope in self.scope.children:
            self.needs["scope", scope].append((Node("name", extra=name), wanted))
        else:
            self.parent.outer(scope, name, wanted)

    def back(self, node: Node, wanted: DataFrame) -> None:
        """wanted: key, val, q; rows that a run of the node has made."""
        op, inputs = node.op, node.inputs
        if op == "name":
            self.name(node.extra, wanted)
        elif op == "outer":
            self.outer(*node.extra, wanted)
        elif op in ("input", "import"):
            self.found[node.extra].append(wanted)
        elif op in ("filter", "negate", "arrange", "inspect", "enter_at"):
            self.back(inputs[0], wanted)
        elif op == "concat":
            for x in inputs:
                self.back(x, wanted.join(self.rows(x), ["key", "val"], "left_semi"))
        elif op in ("map", "flatmap"):
            traced = getattr(self.backend, f"traced_{op}")(self.rows(inputs[0]), node.extra)
            self.back(inputs[0], traced.join(wanted, ["key", "val"]).select(F.col("key0").alias("key"), F.col("val0").alias("val"), Q).distinct())
        elif op == "reduce":
            self.back(inputs[0], self.grouped(node, wanted))
        elif op == "join":
            traced = _all([self.backend.traced_join(run.value(inputs[0]), run.value(inputs[1]), node.extra) for run in self.runs])
            met = cut(traced.join(wanted, ["key", "val"]).select("key0", "val0", "val2", Q).distinct())
            for x, val in zip(inputs, ("val0", "val2")):
                self.back(x, met.select(F.col("key0").alias("key"), F.col(val).alias("val"), Q).distinct())
        else:
            raise ProgramError(f"{op} can't be explained")

    def grouped(self, node: Node, wanted: DataFrame) -> DataFrame:
        rows = _all([self.backend._summed(run.value(node.inputs[0])) for run in self.runs])  # what cancels out in a run matters to none
        if node.extra == "min":  # the value itself, and what a run has below it
            return rows.join(wanted.withColumnRenamed("val", "most"), "key").where(F.col("val") <= F.col("most")).select("key", "val", Q).distinct()
        return rows.join(wanted.select("key", Q).distinct(), "key").select("key", "val", Q).distinct()

    def run(self) -> dict[str, DataFrame]:
        """Traces what is wanted of lets and child scopes; returns what that wants of the scope's variables."""
        for kind, name in _users_first(self.scope):
            some = self.needs.pop((kind, name), [])
            if some and kind == "name":
                self.back(self.scope.lets[name], some[0] if len(some) == 1 else cut(_all(some).distinct()))
            elif some:
                _loop(self.scope.children[name], [run.child(name).rounds for run in self.runs], self, self.backend, self.found, some)
        return {name: _all(some).distinct() for (_, name), some in self.needs.items()}


def _changes(backend, name: str, histories: list[list[_Scoped]]) -> DataFrame:
    """key, val, __at of a variable: the rounds whose body gave a row another weight."""
    steps = [(a.state[name], b.state[name], a.now) for h in histories for a, b in zip(h, h[1:])]
    made = [backend._summed(backend.concat(new, backend.negate(old))).select("key", "val", F.lit(now).cast("long").alias(AT)) for old, new, now in steps]
    made = made or [backend.empty.select("key", "val", F.lit(0).cast("long").alias(AT))]
    return _all([cut(_all(made[i : i + BLOCK])) for i in range(0, len(made), BLOCK)]).distinct()


def _loop(scope: Scope, histories: list[list[_Scoped]], parent: _Trace | None, backend, found: dict, wanted: list[tuple[Node, DataFrame]]) -> None:
    """Traces rows wanted of a scope's last round through all its rounds, the last first."""
    trace, now = _Trace(scope, [h[-1] for h in histories], parent, backend, found), None
    for node, rows in wanted:
        trace.back(node, rows)
    changes: dict[str, DataFrame] = {}
    due: dict[str, DataFrame] = {}
    while True:
        for name, rows in trace.run().items():
            if name not in changes:
                changes[name] = _changes(backend, name, histories)
            more = rows.join(changes[name], ["key", "val"]).select("key", "val", Q, AT)
            more = more if now is None else more.where(F.col(AT) < now)
            due[name] = cut(more.unionByName(due[name]).distinct() if name in due else more)
        latest = {name: rows.agg(F.max(AT)).first()[0] for name, rows in due.items()}
        now = max((x for x in latest.values() if x is not None), default=None)
        if now is None:
            return
        trace = _Trace(scope, [next(r for r in reversed(h) if r.now <= now) for h in histories], parent, backend, found)
        for name in [x for x, at in latest.items() if at == now]:
            trace.back(scope.vars[name], due[name].where(F.col(AT) == now).drop(AT))
            due[name] = due[name].where(F.col(AT) < now)


def _only_adds(scope: Scope, given: Mapping[int | str, DataFrame]) -> bool:
    """Whether fewer input rows can only mean fewer rows everywhere: a run on some then makes nothing that the whole one doesn't."""

    def adds(node: Node) -> bool:
        return node.op != "negate" and (node.op != "reduce" or node.extra == "distinct") and all(adds(x) for x in node.inputs)

    def plain(s: Scope) -> bool:
        return all(adds(n) for n in (*s.lets.values(), *s.vars.values(), *s.exports.values())) and all(plain(c) for c in s.children.values())

    return plain(scope) and all(df.where(F.col(W) < 0).isEmpty() for df in given.values())


def explain(program: str | Scope, inputs: Mapping[int | str, DataFrame], wanted: Mapping[str, DataFrame | None]) -> dict[int | str, DataFrame]:
    """For each input or import the rows (key, val, q) that the wanted rows of exports need.

    inputs: as for evaluate(). wanted: for names of exports DataFrames key, val and, where there are several
    questions, q (long), or None for all of an export's rows, as question 0; rows that the program does not give need nothing. A row found stands for all its weight.
    Null keys or values of wanted rows match nothing, repeated ones count once, and empty tables give empty results.
    """
    scope = parse(program) if isinstance(program, str) else program
    used = set().union(*sources(scope))
    missing = (used - set(inputs)) | (set(wanted) - set(scope.exports))
    if missing or not inputs:
        raise ProgramError(f"missing inputs or exports: {sorted(map(str, missing))}")
    spark = next(iter(inputs.values())).sparkSession
    backend = Frames(spark) if _plain(scope) else Values(spark)
    backend.record = True
    given = {x: backend.keep(backend.load(inputs[x])) for x in used}
    whole = fixpoint(scope, backend, None, given)
    asked = {}
    for name, rows in wanted.items():
        if rows is None:
            asked[name] = cut(whole.value(scope.exports[name]).select("key", "val", F.lit(0).cast("long").alias(Q)).distinct())
            continue
        rows = rows.where(F.col("key").isNotNull() & F.col("val").isNotNull()).withColumn(W, F.col(Q).cast("long") if Q in rows.columns else F.lit(0).cast("long"))
        asked[name] = cut(backend.load(rows).withColumnRenamed(W, Q).distinct())
    none = backend.empty.withColumnRenamed(W, Q)
    held, size, adds = dict.fromkeys(used, none), -1, _only_adds(scope, given)
    while True:
        runs = [whole]
        if size > 0:
            runs.append(fixpoint(scope, backend, None, {x: backend.keep(df.join(held[x], ["key", "val"], "left_semi")) for x, df in given.items()}))
        found: dict[int | str, list[DataFrame]] = defaultdict(list)
        start = [(scope.exports[name], rows.join(_all([r.value(scope.exports[name]) for r in runs]), ["key", "val"], "left_semi")) for name, rows in asked.items()]
        _loop(scope, [r.rounds for r in runs], None, backend, found, start)
        held = {x: cut(_all([held[x], *found[x]]).distinct().join(given[x], ["key", "val"], "left_semi")) for x in used}
        before, size = size, sum(df.count() for df in held.values())
        if size in (before, 0) or adds:
            return {x: backend.shown(df) for x, df in held.items()}
