"""Substring dedup over word windows by super-k-mer partitioning.

A window is WIDTH consecutive words. Windows with a common minimiser form
super-k-mers, which go to the bucket of their minimiser: places with equal
content by digest, and where a bucket holds several different super-k-mers one
packed string of each, whose windows are sorted to find, for each, the smallest
doc_id that holds it. A word is removed if a window that covers it also starts
in a document with a smaller doc_id; windows are judged on the input.

Windows meet by a 64-bit anchor hash and are told apart in its bucket by
another 64 bits, so two different windows are taken for one with a chance of
about 2**-128 a pair.

Defined results: a null text has no words; rows that share a doc_id are not
smaller than one another; a null doc_id comes after all others; repeated rows
get equal results; an empty table gives an empty result; further columns are
ignored. A very long text is one row, worked on whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _windows
from ._text import ranges, slices, span_hash

WIDTH = 50
GRAM = 10


def first_holders(shape: _windows.Shape):
    """For each class, the smallest value (doc_id) among all classes of its group that hold each window."""

    def work(groups: np.ndarray, values: np.ndarray, strings: list[bytes]) -> list[np.ndarray]:
        hashes, sizes = [], []
        for part in slices(_windows._as_text(pa.array(strings, pa.large_binary()))):
            _, _, before, prefix = shape.units(part)
            own = np.diff(before) - shape.width + 1
            at = ranges(before[:-1], own)
            hashes.append(span_hash(prefix, at, at + shape.width))
            sizes.append(own)
        window, size = np.concatenate(hashes), np.concatenate(sizes)
        group, value = np.repeat(groups, size), np.repeat(values, size)
        order = np.lexsort((value, window, group))
        new = np.r_[True, (window[order][1:] != window[order][:-1]) | (group[order][1:] != group[order][:-1])]
        least = np.empty(len(window), dtype=np.int64)
        least[order] = value[order][np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        return np.split(least, np.cumsum(size)[:-1])

    return work


def spans(docs: DataFrame, shape: _windows.Shape) -> DataFrame:
    """Flagged windows: _doc, _tid, place, windows (null: all of the super-k-mer's)."""
    hits = _windows.shared(docs, shape, within=False)
    plain = hits.where("not multi and _doc > least").select("_doc", "_tid", "place", F.lit(None).cast("array<int>").alias("windows"))
    multi = _windows.resolved(docs, hits.where("multi"), shape, F.min("_doc"), first_holders(shape), F.min("value"))
    flagged = multi.where("_doc > array_min(marks)").select(
        "_doc", "_tid", "place",
        F.expr("CASE WHEN _doc > array_max(marks) THEN NULL ELSE filter(sequence(0, size(marks) - 1), j -> _doc > marks[j]) END").alias("windows"),
    )
    return plain.unionByName(flagged)


def dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space (kept; with digest their sha256)."""
    shape = _windows.Shape(width, gram, True)

    def one(raw, low, high, starts, ends, covered):
        drop = np.zeros(len(starts), dtype=bool)
        for a, b in covered:
            drop[a:b] = True
        keep = np.flatnonzero(~drop)
        kept = b" ".join([raw[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist())])
        return len(starts), int(drop.sum()), hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "replace")

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_words long, n_removed long, " + ("kept_sha256 string" if digest else "kept string")
    return _windows.removed(docs, spans(docs, shape), shape, schema, one)
