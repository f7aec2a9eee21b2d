"""Evaluates programs.

A scope's variables start empty and are all replaced at once, round by round,
until nothing changes; a child scope starts afresh in each round of its parent.
Rows delayed by enter_at show from their round on, and where nothing changes
but rows are still due, the round number jumps to the next of them.

Programs run on DataFrames, whatever the size of their inputs. Rows are arrays of
integers and all work is Spark's own, unless the program makes tuples, lists or
tagged values: then keys and values are byte strings that sort like what they
encode, joins and reductions work on these, and scalar terms are evaluated in
Arrow batches. Memory holds collections in dicts; it is the plain form that tests
compare the others with, and serves callers that ask for it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ...collection import W
from ...functions.hashing import reference_hash
from ...storage import cut
from .parser import parse
from .tree import Many, Node, Scope, Term, Variant, order, sources

MOST_ROUNDS = 100_000
# Fixed value: where the hash of a sequence of numbers starts.
HASH_START = 0xCBF29CE484222325


class ProgramError(ValueError):
    pass


def delay(value: int) -> int:
    """The round at which a row with this number enters."""
    return 256 * value.bit_length() if value >= 0 else 256 * 64


# -- scalars on values --------------------------------------------------------


def _eval(term: Term, rows: tuple, bound: tuple = ()):
    op, a = term.op, term.args
    go = lambda t: _eval(t, rows, bound)
    if op == "int":
        return a[0]
    if op == "row":
        return rows[a[0]]
    if op == "bound":
        return bound[-1 - a[0]]
    if op == "at":
        whole, i = go(a[0]), go(a[1])
        if not isinstance(whole, tuple) or not 0 <= i < len(whole):
            raise ProgramError(f"no field {i} in {whole}")
        return whole[i]
    if op in ("+", "-", "*"):
        x, y = go(a[0]), go(a[1])
        out = x + y if op == "+" else x - y if op == "-" else x * y
        return (out + (1 << 63)) % (1 << 64) - (1 << 63)
    if op == "neg":
        return (-go(a[0]) + (1 << 63)) % (1 << 64) - (1 << 63)
    if op in ("==", "!=", "<", "<=", ">", ">="):
        x, y = order(go(a[0])), order(go(a[1]))
        return int({"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op])
    if op == "and":
        return int(_true(go(a[0])) and _true(go(a[1])))
    if op == "or":
        return int(any(_true(go(x)) for x in a))
    if op == "not":
        return int(not _true(go(a[0])))
    if op == "if":
        return go(a[1]) if _true(go(a[0])) else go(a[2])
    if op == "tuple":
        return tuple(go(x) for x in a)
    if op == "list":
        return Many(go(x) for x in a)
    if op == "len":
        return len(go(a[0]))
    if op == "inject":
        tag = go(a[0])
        if not isinstance(tag, int):
            raise ProgramError("a tag must be a number")
        return Variant((tag, go(a[1])))
    if op == "istag":
        value = go(a[1])
        return int(isinstance(value, Variant) and value[0] == go(a[0]))
    if op == "case":
        value = go(a[0])
        for tag, arm in a[1]:
            if isinstance(value, Variant) and value[0] == tag:
                return _eval(arm, rows, (*bound, value[1]))
        if a[2] is None:
            raise ProgramError(f"no arm for {value}")
        return go(a[2])
    if op == "fold":
        acc = go(a[1])
        for x in go(a[0]):
            acc = _eval(a[2], rows, (*bound, acc, x))
        return acc
    if op == "hash":
        h = HASH_START
        for x in a[1:]:
            h = reference_hash(h ^ (go(x) & ((1 << 64) - 1)))
        h >>= 1
        limit = go(a[0])
        return h % limit if limit > 0 else h
    raise ProgramError(f"unknown operation {op}")


def _true(value) -> bool:
    return isinstance(value, int) and value != 0


def _made(terms: tuple, rows: tuple) -> tuple:
    out: list = []
    for t in terms:
        if t.op == "row":
            out += rows[t.args[0]]
        else:
            out.append(_eval(t, rows))
    return tuple(out)


class Memory:
    """Collections as dicts from (key, value) to weight."""

    empty: dict = {}
    record = False

    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark

    def export(self, rows: dict) -> DataFrame:
        made = [(_flat(k), _flat(v), w) for (k, v), w in sorted(rows.items(), key=lambda x: order(x[0]))]
        return self.spark.createDataFrame(made, f"key array<long>, val array<long>, {W} long")

    def load(self, df: DataFrame) -> dict:
        out: dict = defaultdict(int)
        for key, value, weight in df.select("key", "val", W).collect():
            out[tuple(key), tuple(value)] += weight
        return self.clean(out)

    def clean(self, rows: Mapping) -> dict:
        return {k: w for k, w in rows.items() if w}

    def linear(self, rows: dict, work: Callable) -> dict:
        out: dict = defaultdict(int)
        for (key, value), w in rows.items():
            for made in work(key, value):
                out[made] += w
        return self.clean(out)

    def map(self, rows, made):
        return self.linear(rows, lambda k, v: [(_made(made[0], (k, v)), _made(made[1], (k, v)))])

    def filter(self, rows, term):
        return self.linear(rows, lambda k, v: [(k, v)] if _true(_eval(term, (k, v))) else [])

    def flatmap(self, rows, term):
        return self.linear(rows, lambda k, v: [(k, (i, x)) for i, x in enumerate(_eval(term, (k, v)))])

    def negate(self, rows):
        return {k: -w for k, w in rows.items()}

    def concat(self, left, right):
        out: dict = defaultdict(int, left)
        for k, w in right.items():
            out[k] += w
        return self.clean(out)

    def join(self, left, right, made):
        index = defaultdict(list)
        for (key, value), w in right.items():
            index[key].append((value, w))
        out: dict = defaultdict(int)
        for (key, value), w in left.items():
            for other, w2 in index.get(key, ()):
                rows = (key, value, other)
                out[_made(made[0], rows), _made(made[1], rows)] += w * w2
        return self.clean(out)

    def reduce(self, rows, kind):
        groups = defaultdict(list)
        for (key, value), w in rows.items():
            groups[key].append((value, w))
        out = {}
        for key, values in groups.items():
            if kind == "min":
                out[key, min((v for v, _ in values), key=order)] = 1
            elif kind == "distinct":
                out[key, ()] = 1
            elif kind == "count":
                total = sum(w for _, w in values)
                if total > 0:
                    out[key, (total,)] = 1
            else:
                many = Many(v for v, w in sorted(values, key=lambda x: order(x[0])) for _ in range(max(w, 0)))
                out[key, (many,)] = 1
        return out

    def entered(self, rows, term, now):
        due = {(k, v): delay(_eval(term, (k, v))) for k, v in rows}
        later = [d for d in due.values() if d > now]
        return {r: w for r, w in rows.items() if due[r] <= now}, min(later, default=None)

    def numbered(self, rows, now):
        return self.linear(rows, lambda k, v: [(k, (*v, now))])

    def keep(self, rows):
        return rows

    def same(self, a, b):
        return a == b


class Frames:
    """Collections as DataFrames key, val (arrays of longs), __w."""

    record = False

    def __init__(self, spark: SparkSession):
        self.empty = spark.createDataFrame([], f"key array<long>, val array<long>, {W} long")

    def load(self, df):
        return df.select("key", "val", W)

    def _scalar(self, term: Term, rows: tuple) -> Column:
        op, a = term.op, term.args
        go = lambda t: self._scalar(t, rows)
        if op == "int":
            return F.lit(a[0]).cast("long")
        if op == "at" and a[0].op == "row" and a[1].op == "int":
            return F.col(rows[a[0].args[0]])[a[1].args[0]]
        if op in ("+", "-", "*"):
            return _wrapped(op, go(a[0]), go(a[1]))
        if op == "neg":
            return _wrapped("-", F.lit(0).cast("long"), go(a[0]))
        if op in ("==", "!=", "<", "<=", ">", ">="):
            x, y = (F.col(rows[t.args[0]]) if t.op == "row" else go(t) for t in a)
            return {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op].cast("long")
        if op == "and":
            return F.when(go(a[0]) != 0, (go(a[1]) != 0).cast("long")).otherwise(0)
        if op == "or":
            out = F.lit(0).cast("long")
            for t in reversed(a):
                out = F.when(go(t) != 0, 1).otherwise(out)
            return out
        if op == "not":
            return (go(a[0]) == 0).cast("long")
        if op == "if":
            return F.when(go(a[0]) != 0, go(a[1])).otherwise(go(a[2]))
        raise ProgramError(f"{op} needs values that arrays of integers can't hold")

    def _made(self, terms: tuple, rows: tuple) -> Column:
        parts = [F.col(rows[t.args[0]]) if t.op == "row" else F.array(self._scalar(t, rows)) for t in terms]
        return F.concat(*parts) if parts else F.array().cast("array<long>")

    def map(self, df, made):
        rows = ("key", "val")
        return df.select(self._made(made[0], rows).alias("key"), self._made(made[1], rows).alias("val"), W)

    def filter(self, df, term):
        return df.where(self._scalar(term, ("key", "val")) != 0)

    def negate(self, df):
        return df.withColumn(W, -F.col(W))

    def concat(self, left, right):
        return left.unionByName(right)

    def _summed(self, df):
        return df.groupBy("key", "val").agg(F.sum(W).alias(W)).where(F.col(W) != 0)

    def join(self, left, right, made):
        met = left.join(right.select("key", F.col("val").alias("val2"), F.col(W).alias("w2")), "key")
        rows = ("key", "val", "val2")
        return met.select(self._made(made[0], rows).alias("key"), self._made(made[1], rows).alias("val"), (F.col(W) * F.col("w2")).alias(W))

    def reduce(self, df, kind):
        one = F.lit(1).cast("long").alias(W)
        nothing = F.array().cast("array<long>").alias("val")
        if kind == "min":
            return self._summed(df).groupBy("key").agg(F.min("val").alias("val")).select("key", "val", one)
        if kind == "distinct":
            return self._summed(df).select("key").distinct().select("key", nothing, one)
        if kind == "count":
            total = df.groupBy("key").agg(F.sum(W).alias("n")).where("n > 0")
            return total.select("key", F.array("n").alias("val"), one)
        raise ProgramError(f"{kind} isn't supported")

    def traced_map(self, df, made):
        """map's rows beside those that they come from: key, val, key0, val0."""
        rows = ("key", "val")
        return df.select(self._made(made[0], rows).alias("key"), self._made(made[1], rows).alias("val"), F.col("key").alias("key0"), F.col("val").alias("val0"))

    def traced_join(self, left, right, made):
        """join's rows beside those that they come from: key, val, key0, val0, val2."""
        met = left.select("key", "val").join(right.select("key", F.col("val").alias("val2")), "key")
        rows = ("key", "val", "val2")
        return met.select(self._made(made[0], rows).alias("key"), self._made(made[1], rows).alias("val"), F.col("key").alias("key0"), F.col("val").alias("val0"), "val2")

    def shown(self, df):
        """Rows of an input as they were given."""
        return df

    def _due(self, df, term):
        number = self._scalar(term, ("key", "val"))
        return df.withColumn("__due", F.when(number < 0, 256 * 64).when(number == 0, 0).otherwise(256 * F.length(F.bin(number))).cast("long"))

    def entered(self, df, term, now):
        marked = self._due(df, term)
        later = marked.where(F.col("__due") > now).agg(F.min("__due")).first()[0]
        return marked.where(F.col("__due") <= now).drop("__due"), later

    def numbered(self, df, now):
        return df.select("key", F.concat("val", F.array(F.lit(now).cast("long"))).alias("val"), W)

    def keep(self, df):
        return cut(self._summed(df))

    def same(self, a, b):
        """Kept collections have each row once, so their number and two sums of hashes tell them apart."""
        return self._mark(a) == self._mark(b)

    def _mark(self, df):
        sums = [F.sum(F.xxhash64("key", "val", W, F.lit(i)).cast("decimal(38,0)")) for i in (1, 2)]
        return tuple(df.agg(F.count(F.lit(1)), *sums).first())

    def export(self, df):
        return self.keep(df)


def _wrapped(op: str, x: Column, y: Column) -> Column:
    """x op y modulo 2**64, as memory has it; plain unless it overflows."""
    plain = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y)
    a, b = x.cast("decimal(19,0)"), y.cast("decimal(19,0)")
    whole = ({"+": a + b, "-": a - b, "*": a * b}[op]).cast("decimal(38,0)")
    half, span = F.lit(str(1 << 63)).cast("decimal(38,0)"), F.lit(str(1 << 64)).cast("decimal(38,0)")
    return F.coalesce(plain, (F.pmod(whole, span) - F.when(F.pmod(whole, span) >= half, span).otherwise(F.lit(0).cast("decimal(38,0)"))).cast("long"))


# -- values as byte strings that sort like them ---------------------------------

_INT, _TUPLE, _VARIANT, _MANY, _END = b"\x01", b"\x02", b"\x03", b"\x04", b"\x00"


def _number(x: int) -> bytes:
    return (x + (1 << 63)).to_bytes(8, "big")


def encode(value) -> bytes:
    """Ordered as order() orders values: integers, tuples, tagged values, lists."""
    if isinstance(value, int):
        return _INT + _number(value)
    if isinstance(value, Variant):
        return _VARIANT + _number(value[0]) + encode(value[1])
    return (_MANY if isinstance(value, Many) else _TUPLE) + encode_row(value) + _END


def encode_row(row: tuple) -> bytes:
    return b"".join(encode(x) for x in row)


def _decode(data: bytes, at: int) -> tuple:
    kind = data[at : at + 1]
    if kind in (_INT, _VARIANT):
        number = int.from_bytes(data[at + 1 : at + 9], "big") - (1 << 63)
        if kind == _INT:
            return number, at + 9
        payload, at = _decode(data, at + 9)
        return Variant((number, payload)), at
    found, at = [], at + 1
    while data[at : at + 1] != _END:
        value, at = _decode(data, at)
        found.append(value)
    return (Many if kind == _MANY else tuple)(found), at + 1


def decode_row(data: bytes) -> tuple:
    found, at = [], 0
    while at < len(data):
        value, at = _decode(data, at)
        found.append(value)
    return tuple(found)


class Values(Frames):
    """Collections as DataFrames key, val (encoded rows), __w; terms are evaluated in Arrow batches."""

    _SCHEMA = f"key binary, val binary, {W} long"
    _TRACED = "key binary, val binary, key0 binary, val0 binary"

    def __init__(self, spark: SparkSession):
        self.empty = spark.createDataFrame([], self._SCHEMA)

    def _each(self, df: DataFrame, work: Callable, schema: str = _SCHEMA) -> DataFrame:
        """work(row as Python values) -> rows; for every row of df."""
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [{"binary": pa.binary(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}[x.split()[1]] for x in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [out for row in zip(*(c.to_pylist() for c in batch.columns)) for out in work(*row)]
                columns = list(zip(*made)) if made else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        return df.mapInArrow(run, schema)

    def load(self, df):
        return self._each(df.select("key", "val", W), lambda k, v, w: [(encode_row(k), encode_row(v), w)])

    def map(self, df, made):
        def work(k, v, w):
            rows = (decode_row(k), decode_row(v))
            return [(encode_row(_made(made[0], rows)), encode_row(_made(made[1], rows)), w)]

        return self._each(df, work)

    def filter(self, df, term):
        return self._each(df, lambda k, v, w: [(k, v, w)] if _true(_eval(term, (decode_row(k), decode_row(v)))) else [])

    def flatmap(self, df, term):
        return self._each(df, lambda k, v, w: [(k, encode_row((i, x)), w) for i, x in enumerate(_eval(term, (decode_row(k), decode_row(v))))])

    def join(self, left, right, made):
        met = left.join(right.select("key", F.col("val").alias("val2"), F.col(W).alias("w2")), "key")

        def work(k, v, v2, w):
            rows = (decode_row(k), decode_row(v), decode_row(v2))
            return [(encode_row(_made(made[0], rows)), encode_row(_made(made[1], rows)), w)]

        return self._each(met.select("key", "val", "val2", (F.col(W) * F.col("w2")).alias(W)), work)

    def reduce(self, df, kind):
        one = F.lit(1).cast("long").alias(W)
        if kind in ("min", "distinct"):
            kept = self._summed(df).groupBy("key").agg(F.min("val").alias("val"))
            return kept.select("key", "val" if kind == "min" else F.lit(b"").alias("val"), one)
        if kind == "count":
            total = df.groupBy("key").agg(F.sum(W).alias("n")).where("n > 0")
            return self._each(total, lambda k, n: [(k, encode(n), 1)])
        if kind == "collect":
            listed = self._summed(df).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("val", W))).alias("all"))
            return self._each(listed, lambda k, some: [(k, _MANY + b"".join((_TUPLE + x["val"] + _END) * max(x[W], 0) for x in some) + _END, 1)])
        raise ProgramError(f"{kind} isn't supported")

    def traced_map(self, df, made):
        def work(k, v):
            rows = (decode_row(k), decode_row(v))
            return [(encode_row(_made(made[0], rows)), encode_row(_made(made[1], rows)), k, v)]

        return self._each(df.select("key", "val"), work, self._TRACED)

    def traced_flatmap(self, df, term):
        return self._each(df.select("key", "val"), lambda k, v: [(k, encode_row((i, x)), k, v) for i, x in enumerate(_eval(term, (decode_row(k), decode_row(v))))], self._TRACED)

    def traced_join(self, left, right, made):
        def work(k, v, v2):
            rows = (decode_row(k), decode_row(v), decode_row(v2))
            return [(encode_row(_made(made[0], rows)), encode_row(_made(made[1], rows)), k, v, v2)]

        met = left.select("key", "val").join(right.select("key", F.col("val").alias("val2")), "key")
        return self._each(met, work, f"{self._TRACED}, val2 binary")

    def shown(self, df):
        return self._each(df, lambda k, v, q: [(_flat(decode_row(k)), _flat(decode_row(v)), q)], "key array<long>, val array<long>, q long")

    def _due(self, df, term):
        return self._each(df, lambda k, v, w: [(k, v, w, delay(_eval(term, (decode_row(k), decode_row(v)))))], f"{self._SCHEMA}, __due long")

    def numbered(self, df, now):
        return df.select("key", F.concat("val", F.lit(encode(now))).alias("val"), W)

    def export(self, df):
        return cut(self._each(self._summed(df), lambda k, v, w: [(_flat(decode_row(k)), _flat(decode_row(v)), w)], f"key array<long>, val array<long>, {W} long"))


def _plain(scope: Scope) -> bool:
    """Whether a program only makes rows of integers, in terms that Frames knows."""

    def term(t) -> bool:
        if t.op == "at":
            return t.args[0].op == "row" and t.args[1].op == "int"
        if t.op in ("==", "!=", "<", "<=", ">", ">="):
            return all(x.op == "row" or term(x) for x in t.args)
        return t.op == "int" or t.op in ("+", "-", "*", "neg", "and", "or", "not", "if") and all(term(x) for x in t.args)

    def node(n: Node) -> bool:
        if n.op == "flatmap" or n.op == "reduce" and n.extra == "collect":
            return False
        if n.op in ("map", "join"):
            own = all(t.op == "row" or term(t) for part in n.extra for t in part)
        else:
            own = n.op not in ("filter", "enter_at") or term(n.extra)
        return own and all(node(x) for x in n.inputs)

    nodes = [*scope.lets.values(), *scope.vars.values(), *scope.exports.values()]
    return all(node(n) for n in nodes) and all(_plain(c) for c in scope.children.values())


class _Scoped:
    """One scope at one round: names are worked out when they are asked for, once."""

    def __init__(self, scope: Scope, backend, parent: _Scoped | None, inputs: Mapping, state: dict, now: int, lifted: dict):
        self.scope, self.backend, self.parent, self.inputs, self.state, self.now = scope, backend, parent, inputs, state, now
        self.lifted = lifted  # for each lift_iter: its input in the last round, and its output so far
        self.known: dict = {}
        self.children: dict[str, _Scoped] = {}
        self.due: list[int] = []
        self.busy: set[str] = set()
        self.rounds: list[_Scoped] = []  # of the scope up to this one, where the backend records them

    def name(self, name: str):
        if name in self.state:
            return self.state[name]
        if name in self.scope.lets:
            return self.let(name)
        if self.parent is None:
            raise ProgramError(f"unknown name {name}")
        return self.parent.name(name)

    def let(self, name: str):
        if name not in self.known:
            if name in self.busy:
                raise ProgramError(f"{name} depends on itself without a variable")
            self.busy.add(name)
            self.known[name] = self.value(self.scope.lets[name])
            self.busy.discard(name)
        return self.known[name]

    def child(self, name: str) -> _Scoped:
        if name in self.scope.children:
            if name not in self.children:
                self.children[name] = fixpoint(self.scope.children[name], self.backend, self, self.inputs)
            return self.children[name]
        if self.parent is None:
            raise ProgramError(f"unknown scope {name}")
        return self.parent.child(name)

    def value(self, node: Node):
        b, op = self.backend, node.op
        if op == "name":
            return self.name(node.extra)
        if op == "outer":
            scope, name = node.extra
            return self.child(scope).name(name)
        if op in ("input", "import"):
            if node.extra not in self.inputs:
                raise ProgramError(f"no {op} {node.extra}")
            return self.inputs[node.extra]
        rows = [self.value(x) for x in node.inputs]
        if op in ("arrange", "inspect"):
            return rows[0]
        if op == "negate":
            return b.negate(rows[0])
        if op == "concat":
            return b.concat(*rows)
        if op == "join":
            return b.join(rows[0], rows[1], node.extra)
        if op == "enter_at":
            shown, due = b.entered(rows[0], node.extra, self.now)
            self.due += [due] if due is not None else []
            return shown
        if op in ("map", "filter", "flatmap", "reduce"):
            return getattr(b, op)(rows[0], node.extra)
        if op == "lift_iter":
            now = b.keep(rows[0])
            before, so_far = self.lifted.get(id(node), (b.empty, b.empty))
            change = b.numbered(b.concat(now, b.negate(before)), self.now)
            self.lifted[id(node)] = now, b.keep(b.concat(so_far, change))
            return self.lifted[id(node)][1]
        raise ProgramError(f"{op} isn't supported")


def _lifts(scope: Scope) -> list[str]:
    """The lets that append round numbers; nothing within their own scope may use them."""

    def inside(node: Node, op: str, extra=None) -> bool:
        return node.op == op and (extra is None or node.extra == extra) or any(inside(x, op, extra) for x in node.inputs)

    out = [name for name, node in scope.lets.items() if inside(node, "lift_iter")]
    users = [*scope.vars.values(), *scope.lets.values()]
    if any(inside(n, "lift_iter") for n in scope.vars.values()) or any(inside(n, "name", x) for n in users for x in out):
        raise ProgramError("lift_iter can only be used outside its scope")
    return out


def fixpoint(scope: Scope, backend, parent: _Scoped | None, inputs: Mapping) -> _Scoped:
    """The scope in the round after which nothing changes any more."""
    state = {name: backend.empty for name in scope.vars}
    lifts = _lifts(scope)
    now, lifted, rounds = 0, {}, []
    for _ in range(MOST_ROUNDS):
        round_ = _Scoped(scope, backend, parent, inputs, state, now, lifted)
        if backend.record:
            rounds.append(round_)
            round_.rounds = rounds
        for name in lifts:  # they see every round
            round_.let(name)
        new = {name: backend.keep(round_.value(node)) for name, node in scope.vars.items()}
        if all(backend.same(new[x], state[x]) for x in state):
            for name in scope.lets:  # delays that only lets look at count, too
                round_.let(name)
            if not round_.due:
                return round_
            now = min(round_.due)
        else:
            now += 1
        state = new
    raise ProgramError("no fixpoint")


def evaluate(program: str | Scope, inputs: Mapping[int | str, DataFrame], memory: bool = False) -> dict[str, DataFrame]:
    """The exports of a program: DataFrames key, val (arrays of longs), __w, consolidated.

    inputs: for each position or imported name a DataFrame of the same kind (see rows()). memory:
    works on dicts in the driver, for small inputs.
    """
    scope = parse(program) if isinstance(program, str) else program
    positions, names = sources(scope)
    missing = (positions | names) - set(inputs)
    if missing:
        raise ProgramError(f"missing inputs: {sorted(map(str, missing))}")
    used = {k: v for k, v in inputs.items() if k in positions | names}
    spark = next(iter(inputs.values())).sparkSession
    backend = Memory(spark) if memory else Frames(spark) if _plain(scope) else Values(spark)
    try:
        loaded = {k: backend.keep(backend.load(df)) for k, df in used.items()}
        root = fixpoint(scope, backend, None, loaded)
        return {name: backend.export(root.value(node)) for name, node in scope.exports.items()}
    except PySparkException as e:
        told = str(e)
        if "ProgramError" in told or "INVALID_ARRAY_INDEX" in told:  # raised by a row, in an executor
            raise ProgramError(next((x for x in told.splitlines() if "ProgramError" in x or "INVALID_ARRAY_INDEX" in x), told)) from e
        raise


def _flat(row: tuple) -> list:
    if not all(isinstance(x, int) for x in row):
        raise ProgramError("an export holds lists or tagged values; take them apart first")
    return list(row)


def rows(df: DataFrame, key: list[str], value: list[str] | None = None) -> DataFrame:
    """Columns of longs as rows (key ; val) of weight 1."""
    array = lambda names: F.array(*[F.col(c).cast("long") for c in names]) if names else F.array().cast("array<long>")
    return df.select(array(key).alias("key"), array(value or []).alias("val"), F.lit(1).cast("long").alias(W))
