"""Sharding by histogram sort.

Rows are put in the order of (hash of the text, doc_id, hash of the other
columns), so equal texts are neighbours, and the order is cut into shards whose bytes are as equal as whole
rows allow. Splitters are found by rounds of probing: for each splitter some
candidate boundaries in its interval, one pass that counts the exact bytes and
rows between neighbouring candidates, and an interval that shrinks to the two
candidates around the target. A round also returns the smallest and largest
key between candidates, so intervals close in on keys that exist; a group of
equal texts that spans a target is cut by doc_id. Once every splitter is
within the tolerance, or its interval holds one key, rows are exchanged once,
straight to the part of the order they belong to. Where the one key of an
interval belongs to several rows, these are equal, and the splitter cuts between
them by their number: they are exchanged as one row with a count.

Each shard is exchanged in several parts, so no task gets a whole shard; a
part's first slot is the exact number of rows below it in its shard.

Defined results: a null text has size ROW_BYTES and the checksum of no bytes;
null doc_ids come first among equal texts; repeated rows get a slot each and may
be dealt over several shards; an empty table gives an empty result; further
columns are kept by shards(). A very long text is one row and never cut, so a
shard that holds it is larger than the others by as much.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _store
from ._text import lean

ROW_BYTES = 8
SHARDS = 24
#: Allowed distance of a splitter from its target, as a share of a part's mean bytes.
TOLERANCE = 0.001
PROBES = 16
LEAST = -(1 << 63)

MOST = (1 << 63) - 1

Key = tuple[int, int, int]
KEY = ["key", "id", "rest"]


def _below(columns: list[np.ndarray], bounds: list[Key]) -> np.ndarray:
    """For each row, how many of the ascending bounds are <= its (key, id, rest)."""
    first = np.array([b[0] for b in bounds], dtype=np.int64)
    lo, out = np.searchsorted(first, columns[0]), np.searchsorted(first, columns[0], side="right")
    same = np.flatnonzero(lo < out)  # rows whose key some bounds have: the other parts decide
    if len(same):
        out[same] = [bisect_right(bounds, k) for k in zip(*(c[same].tolist() for c in columns))]
    return out


def _counted(small: DataFrame, bounds: list[Key]) -> dict[int, tuple]:
    """For each gap between neighbouring bounds that holds rows: bytes, rows, smallest and largest key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _below([np.asarray(c) for c in batch.columns[:3]], bounds)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], [*KEY, "size", "gap"])

    gaps = small.mapInArrow(lean(run), "key long, id long, rest long, size long, gap long").groupBy("gap")
    whole = F.struct(*KEY)
    rows = gaps.agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"), F.min(whole).alias("lo"), F.max(whole).alias("hi")).collect()
    return {r["gap"]: (r["b"], r["n"], tuple(r["lo"]), tuple(r["hi"])) for r in rows}


def _probes(lo: Key, hi: Key) -> list[Key]:
    """Candidates in (lo, hi]: by the first part in which these differ."""
    i = next(i for i in range(3) if lo[i] != hi[i])
    span = hi[i] - lo[i]
    return sorted({(*lo[:i], lo[i] + max(1, span * k // PROBES), *[LEAST] * (2 - i)) for k in range(1, PROBES + 1)})


def _after(key: Key) -> Key:
    """The next key in order."""
    i = next((i for i in (2, 1) if key[i] < MOST), 0)
    return (*key[:i], key[i] + 1, *[LEAST] * (2 - i))


def splitters(small: DataFrame, parts: int, tolerance: float = TOLERANCE) -> list[tuple[Key, int, int, int]]:
    """parts - 1 boundaries (key, rank, bytes below, rows below) that cut the bytes of small evenly.

    A boundary lies before the row with that rank among the rows of its key. small: key, id, rest,
    size; read once for each round.
    """
    whole = _counted(small, [])
    if not whole:
        return []
    total, _, least, most = whole[0]
    targets = [total * i // parts for i in range(1, parts)]
    slack = tolerance * total / parts
    state = {t: (least, most) for t in range(len(targets))}  # keys between which each splitter lies
    done: dict[int, tuple[Key, int, int, int]] = {}
    while state:
        bounds = sorted({p for lo, hi in state.values() for p in [lo, *(_probes(lo, hi) if lo != hi else [])]})
        found = _counted(small, bounds)
        below, b, n = [], 0, 0
        for i in range(len(bounds)):
            b, n = b + found.get(i, (0, 0))[0], n + found.get(i, (0, 0))[1]
            below.append((b, n))
        reached = [b for b, _ in below]
        for t in list(state):
            at = int(np.searchsorted(reached, targets[t], side="right")) - 1
            inside = found.get(at + 1)  # the rows from this bound up to the next
            cuts = [(bounds[at], 0, *below[at])]
            if inside is not None:
                cuts.append((_after(inside[3]), 0, below[at][0] + inside[0], below[at][1] + inside[1]))
                if inside[2] == inside[3] and inside[1] > 1:  # equal rows: as many below as fit best
                    each = inside[0] // inside[1]
                    rank = min(inside[1] - 1, round((targets[t] - below[at][0]) / each))
                    if rank > 0:
                        cuts.append((inside[2], rank, below[at][0] + rank * each, below[at][1] + rank))
            best = min(cuts, key=lambda c: abs(c[2] - targets[t]))
            if abs(best[2] - targets[t]) <= slack or inside is None or inside[2] == inside[3]:
                done[t] = best
                del state[t]
            else:
                state[t] = inside[2:]
    # neighbouring targets may have settled on ties in either order
    return sorted((done[t] for t in range(len(targets))), key=lambda c: (c[3], c[0], c[1]))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _hashed(docs: DataFrame, names: list[str]) -> Column:
    """A hash of all columns but doc_id and text; maps by their text."""
    others = [F.to_json(c) if k.startswith("map") else F.col(c) for c, k in docs.dtypes if c in names]
    return F.xxhash64(*others) if others else F.lit(0).cast("long")


def shards(docs: DataFrame, count: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """The columns of docs, then shard and slot (in place of columns of these names); every row exchanged once."""
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    names = {c.lower() for c in docs.columns}
    own = {c: next(x for x in (c, *(f"{c}_{i}" for i in range(99))) if x not in names) for c in ("_key", "_id", "_rest", "_part", "_n")}
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST))
    rest = _hashed(docs, [c for c in docs.columns if c not in ("doc_id", "text")])
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + ROW_BYTES
    small = _store.cut(docs.select(key.alias("key"), doc_id.alias("id"), rest.alias("rest"), size.alias("size")))
    per_shard = max(1, -(-_store.partitions(spark) // count))
    parts = count * per_shard
    found = splitters(small, parts, tolerance)
    # the cuts between shards are exact splitters; a part of a shard starts where its splitter says
    bounds = [k for k, *_ in found]
    below = [0, *(n for *_, n in found)]
    starts = [below[p] - below[p - p % per_shard] for p in range(len(below))] or [0]
    # keys of equal rows that a splitter cuts apart: the ranks of the cuts, and the parts below
    cut_keys: dict[Key, tuple[int, list[int]]] = {}
    for p, (k, rank, *_) in enumerate(found):
        if rank:
            first, ranks = cut_keys.setdefault(k, (next(i for i, b in enumerate(bounds) if b == k), []))
            ranks.extend([0] * (p - first - len(ranks)) + [rank])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = _below([np.asarray(batch.column(own[c])) for c in ("_key", "_id", "_rest")], bounds)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], [*batch.schema.names, own["_part"]])

    marks = [own["_key"], own["_id"], own["_rest"]]
    marked = docs.select("*", *[c.alias(n) for c, n in zip((key, doc_id, rest), marks)])
    schema = f"{_ddl(marked)}, `{own['_part']}` int"
    if not cut_keys:
        dealt = marked.mapInArrow(lean(run), schema)
    else:
        is_cut = F.struct(*marks).isin([F.struct(*[F.lit(x).cast("long") for x in k]) for k in cut_keys])
        alone = marked.where(is_cut).groupBy(*marks).agg(F.first(F.struct(*docs.columns)).alias("row"), F.count(F.lit(1)).alias(own["_n"]))
        place = F.lit(0)
        for k, (first, ranks) in cut_keys.items():
            # parts below a row: those whose splitter comes before its key, or by a rank up to its own
            passed = F.size(F.filter(F.lit(ranks).cast("array<bigint>"), lambda r: r <= F.col(own["_n"])))
            place = F.when((F.col(marks[0]) == k[0]) & (F.col(marks[1]) == k[1]) & (F.col(marks[2]) == k[2]), F.lit(first) + passed).otherwise(place)
        each = alone.withColumn(own["_n"], F.explode(F.sequence(F.lit(0).cast("long"), F.col(own["_n"]) - 1)))
        each = each.select("row.*", *marks, place.cast("int").alias(own["_part"]))
        dealt = marked.where(~is_cut).mapInArrow(lean(run), schema).unionByName(each)
    dealt = dealt.repartitionById(parts, own["_part"])
    order = Window.partitionBy(own["_part"]).orderBy(*marks)
    first = F.element_at(F.lit(starts).cast("array<bigint>"), F.col(own["_part"]) + 1)
    return dealt.select(
        *docs.columns,
        F.expr(f"{own['_part']} div {per_shard}").cast("int").alias("shard"),
        (first + F.row_number().over(order) - 1).alias("slot"),
    )
