"""Super-k-mers: runs of consecutive windows that share a minimiser.

A window is `width` consecutive units of one text, units being bytes or words.
Its minimiser is its leftmost gram (of `gram` units) with the smallest hash.
Consecutive windows with the same minimiser travel together, as one super-k-mer
of up to width - gram + 1 windows. Equal windows have equal minimisers, so all
places of a window's content meet under one anchor, the minimiser's hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store, _text
from ._text import byte_prefix, lean, ranges, sequence_prefix, slices, span_hash, window_argmin


#: Windows of one super-k-mer, whose number has 8 bits in a place.
MOST_WINDOWS = 255


@dataclass(frozen=True)
class Shape:
    width: int
    gram: int
    words: bool

    def __post_init__(self) -> None:
        if not 0 < self.gram <= self.width or self.width - self.gram + 1 > MOST_WINDOWS:
            raise ValueError(f"a super-k-mer has 1 to {MOST_WINDOWS} windows: width - gram must be 0 to {MOST_WINDOWS - 1}")

    def units(self, part: _text.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of the units, units before each text, and a prefix hash of the units."""
        if self.words:
            starts, ends, before = part.words()
            values = span_hash(byte_prefix(part.data), starts, ends)
            return starts, ends, before, sequence_prefix(values)
        places = np.arange(len(part.data) + 1)
        return places[:-1], places[1:], part.bounds, byte_prefix(part.data)

    def runs(self, before: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The super-k-mers of a slice: first unit, number of windows, anchor, digest of all its units."""
        empty = np.empty(0, dtype=np.int64)
        sizes = np.diff(before) - self.width + 1
        usable = sizes > 0
        if not usable.any():
            return empty, empty, empty, empty
        at = np.arange(len(prefix) - self.gram)
        grams = span_hash(prefix, at, at + self.gram)
        best = window_argmin(grams, self.width - self.gram + 1)
        windows = ranges(before[:-1][usable], sizes[usable])
        best = best[windows]
        first = np.flatnonzero(np.r_[True, (best[1:] != best[:-1])])
        counts = np.diff(np.r_[first, len(best)])
        starts = windows[first]
        digest = span_hash(prefix, starts, starts + counts + self.width - 1)
        return starts, counts, grams[best[first]].view(np.int64), digest.view(np.int64)


LAST = (1 << 63) - 1
#: place = first unit << 32 | repeats << 8 | windows
_MOST_REPEATS = (1 << 24) - 1
#: Different super-k-mers of one anchor that one task compares (some 15 MB); beyond it they are dealt out by window, and equal
#: windows meet by their content.
MOST_CLASSES = 50_000
#: Bytes of super-k-mers that one comparison takes at once.
CHUNK_BYTES = 1 << 20


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """docs with _doc (doc_id; null comes last) and _tid (a hash of the text), which tell rows apart."""
    return docs.select(*columns, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_doc"), F.xxhash64("text").alias("_tid"))


def occurrences(docs: DataFrame, shape: Shape) -> DataFrame:
    """The super-k-mers of all texts: anchor, digest, _doc, _tid, place.

    Consecutive equal ones, as periodic text has them, are one row with a repeat count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_, tids = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            for part in slices(batch.column(0)):
                _, _, before, prefix = shape.units(part)
                starts, counts, anchors, digests = shape.runs(before, prefix)
                if not len(starts):
                    continue
                owner = np.searchsorted(before, starts, side="right") - 1
                change = np.r_[True, (anchors[1:] != anchors[:-1]) | (digests[1:] != digests[:-1]) | (owner[1:] != owner[:-1])]
                change[::_MOST_REPEATS] = True
                first = np.flatnonzero(change)
                repeats = np.diff(np.r_[first, len(starts)])
                owner = owner[first]
                place = (starts[first] - before[owner]) << 32 | repeats << 8 | counts[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchors[first]), pa.array(digests[first]), pa.array(docs_[part.first + owner]), pa.array(tids[part.first + owner]), pa.array(place)],
                    ["anchor", "digest", "_doc", "_tid", "place"],
                )

    return keyed(docs, "text").mapInArrow(lean(run), "anchor long, digest long, _doc long, _tid long, place long")


REPEATS = "((place div 256) & 16777215)"


def shared(docs: DataFrame, shape: Shape, within: bool) -> DataFrame:
    """Occurrences whose anchor occurs elsewhere too, with `multi` (several digests) and `least` (smallest _doc).

    within: whether another place in the same document counts as elsewhere.
    """
    groups = occurrences(docs, shape).groupBy("anchor").agg(
        F.sum(F.expr(REPEATS)).alias("n"), F.count(F.lit(1)).alias("rows"), F.min("digest").alias("d0"), F.max("digest").alias("d1"), F.min("_doc").alias("least"), F.max("_doc").alias("most")
    )
    groups = _store.cut(groups.where("n > 1" if within else "least < most").select("anchor", (F.col("d0") != F.col("d1")).alias("multi"), "least", "rows"))
    return _store.cut(_store.joined(occurrences(docs, shape), groups, ["anchor"], "rows").drop("rows"))


def packed(docs: DataFrame, classes: DataFrame, shape: Shape) -> DataFrame:
    """Adds to classes (anchor, digest, rep: struct of _doc, _tid, place; value) their text and windows' hashes.

    Returns anchor, digest, value, packed (the units of the super-k-mer, words joined by a space).
    """
    wanted = classes.select("rep._doc", "rep._tid", F.struct("anchor", "digest", "value", "rep.place").alias("want"))
    wanted = wanted.groupBy("_doc", "_tid").agg(F.collect_list("want").alias("wants"))
    held = keyed(docs, "text").join(wanted, ["_doc", "_tid"]).select("text", "wants")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wants = batch.column(1)
            flat = wants.flatten()
            bounds = np.asarray(wants.offsets)
            bounds = bounds - bounds[0]
            places = np.asarray(flat.field("place"))
            out = []
            for part in slices(batch.column(0)):
                starts, ends, before, _ = shape.units(part)
                raw = part.data.tobytes()
                for k in range(part.n):
                    for i in range(bounds[part.first + k], bounds[part.first + k + 1]):
                        a = before[k] + (int(places[i]) >> 32)
                        b = a + (int(places[i]) & 255) + shape.width - 1
                        text = raw[starts[a] : ends[b - 1]]
                        out.append(b" ".join(text.split()) if shape.words else text)
            yield pa.RecordBatch.from_arrays([flat.field("anchor"), flat.field("digest"), flat.field("value"), pa.array(out, pa.binary())], ["anchor", "digest", "value", "packed"])

    return held.mapInArrow(lean(run), "anchor long, digest long, value long, packed binary")


def compared(strings: DataFrame, work) -> DataFrame:
    """anchor, digest, marks: work(groups, values, packed) on whole anchors, some at a time.

    work gets a group number, a value and a packed string for each class and returns one
    array of marks for each, a mark for every window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def done() -> pa.RecordBatch:
            anchors = np.array([r[0] for r in held], dtype=np.int64)
            groups = np.cumsum(np.r_[0, anchors[1:] != anchors[:-1]])
            marks = work(groups, np.array([r[2] for r in held], dtype=np.int64), [r[3] for r in held])
            return pa.RecordBatch.from_arrays([pa.array(anchors), pa.array([r[1] for r in held], pa.int64()), pa.array(marks, pa.list_(pa.int64()))], ["anchor", "digest", "marks"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > CHUNK_BYTES and row[0] != held[-1][0]:
                    yield done()
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield done()

    dealt = strings.repartition("anchor").sortWithinPartitions("anchor", "digest")
    return dealt.mapInArrow(lean(run), "anchor long, digest long, marks array<long>")


def compared_by_window(strings: DataFrame, shape: Shape, combine) -> DataFrame:
    """As compared(), for anchors with very many classes: each window is a row with its content, and equal ones meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "digest", "value", "j", "window"]
        for batch in batches:
            for part in slices(_as_text(batch.column("packed"))):
                starts, ends, before, _ = shape.units(part)
                raw = part.data.tobytes()
                sizes = np.diff(before) - shape.width + 1
                at = ranges(before[:-1], sizes)
                rows = pa.array(np.repeat(np.arange(part.n), sizes) + part.first)
                windows = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at + shape.width - 1].tolist())]
                places = pa.array(ranges(np.zeros_like(sizes), sizes), pa.int32())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in names[:3]), places, pa.array(windows, pa.binary())], names)

    exploded = _store.cut(strings.mapInArrow(lean(run), "anchor long, digest long, value long, j int, window binary"))
    found = exploded.groupBy("anchor", "window").agg(combine.alias("mark"))
    marked = exploded.join(found, ["anchor", "window"]).groupBy("anchor", "digest").agg(F.sort_array(F.collect_list(F.struct("j", "mark"))).alias("m"))
    return marked.select("anchor", "digest", F.col("m.mark").alias("marks"))


def _as_text(column: pa.Array) -> pa.Array:
    """Binary values as a string array over the same buffers; slices() only looks at the bytes."""
    column = column.cast(pa.large_binary())
    return pa.Array.from_buffers(pa.large_string(), len(column), column.buffers(), column.null_count, column.offset)


def resolved(docs: DataFrame, hits: DataFrame, shape: Shape, value, work, combine) -> DataFrame:
    """hits, and the marks of their windows."""
    grouped = hits.groupBy("anchor", "digest")
    classes = _store.cut(grouped.agg(F.min(F.struct("_doc", "_tid", "place")).alias("rep"), value.alias("value"), F.count(F.lit(1)).alias("rows")))
    strings = packed(docs, classes, shape)
    hot = classes.groupBy("anchor").count().where(F.col("count") > MOST_CLASSES).select("anchor")
    if hot.isEmpty():
        marks = compared(strings, work)
    else:
        strings, hot = _store.cut(strings), _store.cut(hot)
        marks = compared(strings.join(hot, "anchor", "left_anti"), work)
        marks = marks.unionByName(compared_by_window(strings.join(hot, "anchor", "left_semi"), shape, combine))
    marks = _store.cut(marks.join(classes.select("anchor", "digest", "rows"), ["anchor", "digest"]))
    return _store.joined(hits, marks, ["anchor", "digest"], "rows").drop("rows")


def removed(docs: DataFrame, spans: DataFrame, shape: Shape, schema: str, work) -> DataFrame:
    """Joins each text with its flagged windows and calls work(text bytes, spans) for a row of `schema`.

    spans: _doc, _tid, place, windows (array of flagged windows; null: all). work gets for each
    text the (first, end) runs of covered units, merged and in order, and the units' byte bounds.
    """
    mine = spans.groupBy("_doc", "_tid").agg(F.collect_list(F.struct("place", "windows")).alias("_spans"))
    joined = keyed(docs, "doc_id", "text").join(mine, ["_doc", "_tid"], "left").select("doc_id", "text", "_spans")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(2)
            for part in slices(batch.column(1)):
                starts, ends, before, _ = shape.units(part)
                raw = part.data.tobytes()
                rows = []
                for k in range(part.n):
                    found = lists[part.first + k]
                    covered = _covered(found.values, shape.width) if found.is_valid else []
                    rows.append(work(raw, part.bounds[k], part.bounds[k + 1], starts[before[k] : before[k + 1]], ends[before[k] : before[k + 1]], covered))
                columns = [pa.array(c) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([ids.slice(part.first, part.n), *columns], names)

    return joined.mapInArrow(lean(run), schema)


def _covered(spans: pa.Array, width: int) -> list[tuple[int, int]]:
    """The merged (first, end) runs of units covered by the flagged windows."""
    places, windows = np.asarray(spans.field("place")), spans.field("windows")
    starts, repeats, counts = places >> 32, places >> 8 & _MOST_REPEATS, places & 255
    whole = np.asarray(windows.is_null())
    firsts = [starts[whole]]
    lengths = [(repeats * counts)[whole]]
    for i in np.flatnonzero(~whole).tolist():
        j = np.asarray(windows[i].values)
        steps = np.arange(repeats[i]) * counts[i]
        firsts.append((starts[i] + steps[:, None] + j[None, :]).ravel())
        lengths.append(np.ones(len(j) * len(steps), dtype=np.int64))
    first, length = np.concatenate(firsts), np.concatenate(lengths)
    order = np.argsort(first, kind="stable")
    first = first[order]
    end = np.maximum.accumulate(first + length[order] + width - 1)
    new = np.flatnonzero(np.r_[True, first[1:] > end[:-1]])
    return list(zip(first[new].tolist(), end[np.r_[new[1:] - 1, len(end) - 1]].tolist()))
