"""Reversible line dedup: sharded cuckoo filters backed by exact reference counts.

A LineIndex keeps, in a folder, the exact references (key, document), one cuckoo
filter for each shard of the key space, and the reference counts of the keys that
several documents hold. Inserted references stream past their shard's filter: a
key that it doesn't know is new for certain, goes into the filter and needs no
lookup; only what the filter may know, a second reference or a false positive, is
looked up among the exact references and counted. Keys that turn out to be false
positives are added to the filter then, so it holds a fingerprint for each key.
Deleting documents counts the keys they held anew and takes out the fingerprints
of those that lose their last reference, which a cuckoo filter allows. So
insertions and deletions can be undone in any order, and the dedup always follows
the exact counts.

A key is a line stripped of ASCII white space with A-Z lower-cased; keys below
MIN_CHARS code points are no keys. Keys are told apart by 128-bit digests.

Defined results: a null or empty text is one empty line; rows that share a
doc_id count as one document; a null doc_id stands for one document that
comes after all others; a line repeated in the smallest document that holds it
stays there as often; an empty table gives an empty result; further columns of the
input are ignored. A very long text is one row, split whole.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _store
from ._text import lean, mix64

MIN_CHARS = 10
LAST = (1 << 63) - 1
WAYS = 4
#: Share of a table's places that are filled before the next one is begun.
LOAD = 0.8
#: Tables of one filter; beyond it all filters are made anew, larger, from the exact references.
MOST_TABLES = 4


#: Rows of a batch that are worked on at once.
ROWS = 1024


def line_key(line: bytes) -> bytes | None:
    """The key of a line whose A-Z are lower-cased already, or None."""
    key = line.strip(b" \t\n\r\x0b\x0c")
    if len(key) >= 4 * MIN_CHARS or len(key) >= MIN_CHARS and len(key.decode("utf-8", "replace")) >= MIN_CHARS:
        return key
    return None


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


class CuckooFilter:
    """A cuckoo filter over keys given as two 64-bit words; it grows by further tables of the same shape.

    A key has the same two rows in all tables. So keys of equal fingerprint and rows can stand
    for one another, and removing one takes out a fingerprint of it wherever it is found.
    """

    def __init__(self, rows: int = 1024, tables: list[np.ndarray] | None = None):
        self.rows, self.tables = rows, tables or []

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        """A filter whose first table has room for so many keys."""
        rows = 64
        while rows * WAYS * LOAD < keys:
            rows *= 2
        return cls(rows)

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        rows = int.from_bytes(data[:8], "little")
        every = np.frombuffer(data, np.uint16, offset=8).reshape(-1, rows, WAYS)
        return cls(rows, [t.copy() for t in every])

    def dump(self) -> bytes:
        return self.rows.to_bytes(8, "little") + b"".join(t.tobytes() for t in self.tables)

    def _places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = (hi % np.uint64(65535)).astype(np.uint16) + np.uint16(1)
        one = lo >> np.uint64(20) & np.uint64(self.rows - 1)
        return mark, one.astype(np.int64), self._other(one, mark)

    def _other(self, row: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return (row.astype(np.uint64) ^ (mix64(mark.astype(np.uint64)) & np.uint64(self.rows - 1))).astype(np.int64)

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(hi, lo)
        found = np.zeros(len(hi), dtype=bool)
        for table in self.tables:
            found |= (table[one] == mark[:, None]).any(axis=1) | (table[two] == mark[:, None]).any(axis=1)
        return found

    def add(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Adds keys, each as often as it is given."""
        mark, one, _ = self._places(hi, lo)
        while len(one):
            room = int(LOAD * self.rows * WAYS) - int(np.count_nonzero(self.tables[-1])) if self.tables else 0
            if room <= 0:
                self.tables.append(np.zeros((self.rows, WAYS), dtype=np.uint16))
                continue
            rows, marks = self._settle(self.tables[-1], one[:room], mark[:room])
            if len(rows):  # some found no place in reach: they begin the next table
                self.tables.append(np.zeros((self.rows, WAYS), dtype=np.uint16))
            one, mark = np.concatenate([rows, one[room:]]), np.concatenate([marks, mark[room:]])

    def _settle(self, table: np.ndarray, one: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Puts fingerprints into a table; returns the row and fingerprint of those that found no place."""
        left = np.arange(len(one))
        for place in (one, self._other(one, mark)):  # all that fit straight away, at once
            order = left[np.argsort(place[left], kind="stable")]
            rows = place[order]
            first = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.empty(0, bool)
            rank = np.arange(len(rows)) - np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
            free_slots = np.sort(np.where(table[rows] == 0, np.arange(WAYS), WAYS), axis=1)
            slot = free_slots[np.arange(len(rows)), np.minimum(rank, WAYS - 1)]
            fits = (rank < WAYS) & (slot < WAYS)
            table[rows[fits], slot[fits]] = mark[order[fits]]
            left = order[~fits]
        homeless = []
        for i in left.tolist():
            row, value = int(one[i]), int(mark[i])
            for kick in range(200):
                empty = np.flatnonzero(table[row] == 0)
                if len(empty):
                    table[row, empty[0]] = value
                    break
                slot = (kick * 7 + value) % WAYS
                table[row, slot], value = value, int(table[row, slot])
                row ^= int(mix64(np.array([value], dtype=np.uint64))[0]) & (self.rows - 1)
            else:
                homeless.append((row, value))
        return np.array([r for r, _ in homeless], dtype=np.int64), np.array([v for _, v in homeless], dtype=np.uint16)

    def remove(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Removes keys that are held."""
        for mark, one, two in zip(*self._places(hi, lo)):
            place = next((t, int(r), s) for t in self.tables for r in (one, two) for s in range(WAYS) if t[int(r), s] == mark)
            place[0][place[1:]] = 0


def references(docs: DataFrame) -> DataFrame:
    """The keys that each document holds, once each: hi, lo, doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                ids, owners, marks = part.column(0), [], []
                for i, text in enumerate(part.column(1)):
                    raw = (text.as_buffer() or b"") if text.is_valid else b""
                    keys = {_digest(k) for x in bytes(raw).lower().split(b"\n") if (k := line_key(x)) is not None}
                    owners += [i] * len(keys)
                    marks += keys
                both = np.frombuffer(b"".join(marks), dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), ids.take(pa.array(owners, pa.int64()))], ["hi", "lo", "doc_id"])

    return docs.select(_id(F.col("doc_id")), "text").mapInArrow(lean(run), "hi long, lo long, doc_id long")


def _id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(LAST)).alias("doc_id")


_STREAM = "shard int, hi long, lo long, n long, data binary"


def _combined(shards: int) -> Callable:
    """References hi, lo as shard, hi, lo, n: a key once for each batch, so a very common one is few rows when it is exchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi, lo = (np.asarray(batch.column(i)) for i in (0, 1))
            if not len(hi):
                continue
            order = np.lexsort((lo, hi))
            hi, lo = hi[order], lo[order]
            first = np.flatnonzero(np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])
            n = np.diff(np.r_[first, len(hi)])
            columns = [pa.array((lo[first] % shards).astype(np.int32)), pa.array(hi[first]), pa.array(lo[first]), pa.array(n)]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(first), pa.binary())], ["shard", "hi", "lo", "n", "data"])

    return run


def _past(keys_of: dict[int, int], remove: bool) -> Callable:
    """Streams counted references past their shards' filters, which come first in each shard.

    Rows with data are filters, the others keys with a number n of references. Returns the new filters, and
    the keys with as many references as the filter may have known; where n is 0, just adds (or removes) the key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, CuckooFilter] = {}
        names = ["shard", "hi", "lo", "n", "data"]
        for batch in batches:
            shards, datas = np.asarray(batch.column(0)), batch.column(4)
            whole = np.asarray(datas.is_valid())
            for i in np.flatnonzero(whole).tolist():
                held[int(shards[i])] = CuckooFilter.load(datas[i].as_py())
            rows = np.flatnonzero(~whole)
            if not len(rows):
                continue
            shards, hi, lo, n = (np.asarray(c.take(pa.array(rows))) for c in batch.columns[:4])
            order = np.lexsort((lo, hi, shards))
            shards, hi, lo, n = shards[order], hi[order].view(np.uint64), lo[order].view(np.uint64), n[order]
            first = np.flatnonzero(np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])
            shards, hi, lo, n = shards[first], hi[first], lo[first], np.add.reduceat(n, first)
            for shard in np.unique(shards).tolist():
                mine = held.setdefault(shard, CuckooFilter.sized(keys_of.get(shard, 0)))
                own = np.flatnonzero((shards == shard) & (n == 0))
                if len(own):
                    (mine.remove if remove else mine.add)(hi[own], lo[own])
                own = np.flatnonzero((shards == shard) & (n > 0))
                new = own[~mine.contains(hi[own], lo[own])]
                mine.add(hi[new], lo[new])
                n[new] -= 1  # the first reference of a new key
            again = np.flatnonzero(n > 0)
            if len(again):
                columns = [shards[again], hi[again].view(np.int64), lo[again].view(np.int64), n[again]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.nulls(len(again), pa.binary())], names)
        for shard, mine in held.items():
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((shard, None, None, None, mine.dump()), kinds)], names)

    return run


class LineIndex:
    """The state of an incremental line dedup, in a folder that all executors share.

    shards: filters that the keys are dealt over; one filter, some 3 bytes a key, has to fit a task's memory.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, shards: int | None = None):
        self.spark = spark
        self.folder = folder or f"{_store.shared_folder(spark)}/lines-{uuid.uuid4().hex}"
        self.shards = shards or max(8, _store.partitions(spark))
        self.steps: list[tuple[str, str]] = []
        self.filters: DataFrame | None = None
        self.rows, self.held = 0, 0
        #: Exact counts hi, lo, n_docs, first of the keys of several documents; and their references.
        self.shared: DataFrame | None = None
        self.references: DataFrame | None = None

    def _write(self, df: DataFrame, kind: str) -> DataFrame:
        path = f"{self.folder}/{len(self.steps):06d}-{kind}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _shard(self) -> Column:
        return F.pmod(F.col("lo"), F.lit(self.shards)).cast("int").alias("shard")

    def _logged(self, kind: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.steps):06d}-{kind}"
        df.write.parquet(path)
        self.steps.append((kind, path))
        return self.spark.read.schema(df.schema).parquet(path)

    def exact(self) -> DataFrame:
        """The exact references: hi, lo, doc_id for each key and document that holds it (a document's rows count apart)."""
        out = None
        for kind, path in self.steps:
            df = self.spark.read.parquet(path)
            if kind == "insert":
                out = df if out is None else out.unionByName(df)
            elif out is not None:
                out = out.join(df, "doc_id", "left_anti")
        return out if out is not None else self.spark.createDataFrame([], "hi long, lo long, doc_id long")

    def _streamed(self, rows: DataFrame, keys_of: dict[int, int], remove: bool = False) -> DataFrame:
        """Lets counted keys pass the filters and keeps the new filters; returns what the filters may have known."""
        if self.filters is not None:
            rows = rows.unionByName(self.filters.select("shard", *[F.lit(None).cast("long").alias(c) for c in ("hi", "lo", "n")], "data"))
            dealt = rows.repartitionById(self.shards, "shard").sortWithinPartitions("shard", F.col("data").isNull())
        else:
            dealt = rows.repartitionById(self.shards, "shard")
        out = self._write(dealt.mapInArrow(lean(_past(keys_of, remove)), _STREAM), "filters")
        self.filters = out.where("data is not null").select("shard", "data")
        return out.where("data is null").select("hi", "lo", "n")

    def _alone(self, keys: DataFrame) -> DataFrame:
        return keys.select(self._shard(), "hi", "lo", F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("data"))

    def insert(self, docs: DataFrame) -> LineIndex:
        new = self._logged("insert", references(docs))
        keys_of = {r["shard"]: r["count"] for r in new.groupBy(self._shard()).count().collect()}  # as many as shards
        self.held += max(keys_of.values(), default=0)
        feed = new
        if self.filters is not None and self.held > self.rows * WAYS * LOAD * MOST_TABLES:
            feed, self.filters = self.exact(), None  # too many tables: larger ones, from all references
            keys_of = {r["shard"]: r["count"] for r in feed.groupBy(self._shard()).count().collect()}
        if self.filters is None:
            most = max(keys_of.values(), default=0)
            keys_of = dict.fromkeys(range(self.shards), most)
            self.rows, self.held = CuckooFilter.sized(most).rows, most
        passed = self._streamed(feed.select("hi", "lo").mapInArrow(lean(_combined(self.shards)), _STREAM), keys_of)
        suspects = self._write(passed.groupBy("hi", "lo").agg(F.sum("n").alias("seen")), "suspects")
        found = self._write(_store.joined(self.exact(), suspects, ["hi", "lo"], "seen").drop("seen"), "looked-up")
        counts = self._write(self._counted(found).join(suspects, ["hi", "lo"]), "counts")
        # a key that the filter took for known at its first reference: all references were let through, and it has no older one
        wrong = counts.where("seen = n_refs")
        if self.shared is not None and feed is new:
            fresh = _store.joined(new, suspects, ["hi", "lo"], "seen").groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("fresh"))
            wrong = wrong.join(fresh, ["hi", "lo"]).where("fresh = n_refs")
        wrong = self._write(wrong.select("hi", "lo"), "missed")
        if not wrong.isEmpty():
            self._streamed(self._alone(wrong), keys_of)
        several = counts.where("n_docs > 1").select("hi", "lo", "n_docs", "first")
        if self.shared is None:
            self.shared, self.references = several, found
        else:
            self.shared = self._write(self.shared.join(suspects.select("hi", "lo"), ["hi", "lo"], "left_anti").unionByName(several), "shared")
            self.references = self._write(self.references.join(suspects.select("hi", "lo"), ["hi", "lo"], "left_anti").unionByName(found), "references")
        return self

    @staticmethod
    def _counted(references: DataFrame) -> DataFrame:
        """hi, lo, n_docs, first, n_refs (rows) of references."""
        each = references.groupBy("hi", "lo", "doc_id").agg(F.count(F.lit(1)).alias("n"))
        return each.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first"), F.sum("n").alias("n_refs"))

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        before = self.exact()
        gone = self._logged("delete", doc_ids.select(_id(F.col("doc_id"))).distinct())
        touched = self._write(before.join(gone, "doc_id", "left_semi").select("hi", "lo").distinct(), "touched")
        counts = self._write(self._counted(self.exact().join(touched, ["hi", "lo"], "left_semi")), "counts")
        lost = touched.join(counts.select("hi", "lo"), ["hi", "lo"], "left_anti")
        if self.filters is not None:
            self._streamed(self._alone(lost), {}, remove=True)
            several = counts.where("n_docs > 1").select("hi", "lo", "n_docs", "first")
            self.shared = self._write(self.shared.join(touched, ["hi", "lo"], "left_anti").unionByName(several), "shared")
            self.references = self._write(self.references.join(gone, "doc_id", "left_anti"), "references")
        return self

    def counts(self) -> DataFrame:
        """Exact reference counts of all keys: hi, lo, n_docs, first (the smallest doc_id)."""
        return self._counted(self.exact()).drop("n_refs")

    def dropped(self) -> DataFrame:
        """For each document that loses lines: doc_id, his and los (its keys that an earlier document has)."""
        if self.shared is None:
            return self.spark.createDataFrame([], "doc_id long, his array<long>, los array<long>")
        lost = _store.joined(self.references, self.shared, ["hi", "lo"], "n_docs").where("doc_id > first")
        return lost.groupBy("doc_id").agg(F.collect_list("hi").alias("his"), F.collect_list("lo").alias("los"))

    def dedup(self, docs: DataFrame, digest: bool = False, drop_emptied: bool = False) -> DataFrame:
        """docs without the lines that an earlier document of the index holds.

        Returns the columns of docs with text replaced, if drop_emptied without the
        rows of which only white space is left; or, with digest, doc_id, n_lines,
        n_dropped and kept_sha256.
        """
        columns = ["doc_id", "text"] if digest else docs.columns
        # other names inside, so that none of the input's clashes with ours
        own = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], _id(F.col("doc_id")).alias("_doc"))
        inner = [f"c{i}" for i in range(len(columns))]
        drops = self.dropped().select(F.col("doc_id").alias("_doc"), F.col("his").alias("_his"), F.col("los").alias("_los"))
        joined = own.join(drops, "_doc", "left").select(*inner, "_his", "_los")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(a, ROWS) for b in batches for a in range(0, b.num_rows, ROWS)):
                texts, lines, drops, kept, stay = batch.column(columns.index("text")), [], [], [], []
                for text, his, los in zip(texts, batch.column("_his"), batch.column("_los")):
                    parts = bytes(text.as_buffer() or b"").split(b"\n") if text.is_valid else [b""]
                    lines.append(len(parts))
                    if his.is_valid:
                        both = np.stack([np.asarray(his.values), np.asarray(los.values)], axis=1).astype("<i8")
                        bad = {x.tobytes() for x in both}
                        rest = [x for x in parts if (k := line_key(x.lower())) is None or _digest(k) not in bad]
                    else:
                        rest = parts
                    drops.append(len(parts) - len(rest))
                    whole = b"\n".join(rest)
                    stay.append(not (drop_emptied and drops[-1] and not whole.strip()))
                    kept.append(hashlib.sha256(whole).hexdigest() if digest else whole.decode("utf-8", "replace") if text.is_valid else None)
                if digest:
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.int64()), pa.array(drops, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])
                else:
                    out = [pa.array(kept, pa.string()) if c == "text" else batch.column(i) for i, c in enumerate(columns)]
                    yield pa.RecordBatch.from_arrays(out, columns).filter(pa.array(stay, pa.bool_()))

        if digest:
            kind = dict(docs.dtypes)["doc_id"]
            return joined.mapInArrow(lean(run), f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string")
        return joined.mapInArrow(lean(run), docs.schema)

