"""Suffix-array dedup of repeated byte strings by bucket-pointer refinement.

A byte is removed if a string of WIDTH bytes that covers it also starts
anywhere else, in the same document or in another one.

A suffix array of the whole corpus would need several times its size in
pointers, so suffixes are first dealt to independent parts: a string of WIDTH
bytes belongs to the part of its minimiser, which equal strings share
(_windows). Each different super-k-mer of a part comes once, with its number of
places. Parts are sorted by bucket-pointer refinement: the
suffixes are put into buckets by their first Q bytes; then, from depth h to
2 h, each bucket with more than one suffix is refined by sorting on the bucket
identifiers of the suffixes h bytes later, which earlier rounds have refined
already; suffixes alone in their bucket leave. At depth WIDTH the members of a
bucket are the equal strings, and a bucket of more than one place is a repeat.

Defined results: a null text is empty; a document in several equal rows repeats
itself, so all its strings are repeated; matches never cross documents; an
empty table gives an empty result; further columns are ignored. A very long
text is one row, worked on whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _windows

WIDTH = 200
GRAM = 32
#: Bytes of the initial buckets.
Q = 8


def refine(data: np.ndarray, ends: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Bucket identifiers of the suffixes `wanted` of data at `depth` bytes; equal strings, equal identifier.

    ends: for each byte, where its string ends. No wanted suffix is shorter than depth.
    """
    n = len(data)
    length = np.minimum(ends - np.arange(n), depth)
    padded = np.concatenate([data, np.zeros(Q, dtype=np.uint8)])
    gram = np.zeros(n, dtype=np.uint64)
    for i in range(Q):
        gram = gram << np.uint64(8) | padded[i : i + n]
    # identifiers below n are of buckets, n + place is of a suffix that is alone
    _, pointer = np.unique(gram, return_inverse=True)
    pointer = np.where(length < Q, n + np.arange(n), pointer)
    active, h = np.arange(n), Q
    while h < depth:
        step = min(h, depth - h)
        size = np.bincount(pointer, minlength=2 * n)
        stays = (size[pointer[active]] > 1) & (length[active] >= h + step)
        leaves, active = active[~stays], active[stays]
        key = pointer[active] * (2 * n) + pointer[active + step]
        order = np.argsort(key)
        key = key[order]
        new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.empty(0, dtype=bool)
        fresh = np.cumsum(new) - 1
        pointer[leaves] = n + leaves
        pointer[active[order]] = fresh
        h += step
    return pointer[wanted]


def repeats(width: int):
    """For each class, how many places of its group (weighted by value) hold each window's string."""

    def work(groups: np.ndarray, values: np.ndarray, strings: list[bytes]) -> list[np.ndarray]:
        sizes = np.array([len(s) for s in strings])
        data = np.frombuffer(b"".join(strings), dtype=np.uint8)
        bounds = np.cumsum(sizes)
        windows = sizes - width + 1
        wanted = np.concatenate([np.arange(b - s, b - width + 1) for b, s in zip(bounds, sizes)])
        pointer = refine(data, np.repeat(bounds, sizes), wanted, width)
        total = np.bincount(pointer, weights=np.repeat(values, windows).astype(np.float64))
        return np.split(total[pointer].astype(np.int64), np.cumsum(windows)[:-1])

    return work


def spans(docs: DataFrame, shape: _windows.Shape) -> DataFrame:
    """Repeated windows: _doc, _tid, place, windows (null: all of the super-k-mer's)."""
    hits = _windows.shared(docs, shape, within=True)
    marked = _windows.resolved(docs, hits, shape, F.sum(F.expr(_windows.REPEATS)), repeats(shape.width), F.sum("value"))
    return marked.where("array_max(marks) > 1").select(
        "_doc", "_tid", "place",
        F.expr("CASE WHEN array_min(marks) > 1 THEN NULL ELSE filter(sequence(0, size(marks) - 1), j -> marks[j] > 1) END").alias("windows"),
    )


def dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the remaining bytes (kept; with digest their sha256)."""
    shape = _windows.Shape(width, gram, False)

    def one(raw, low, high, starts, ends, covered):
        at, kept = 0, []
        for a, b in covered:
            kept.append(raw[low + at : low + a])
            at = b
        kept.append(raw[low + at : high])
        rest = b"".join(kept)
        return int(high - low), int(high - low) - len(rest), len(covered), hashlib.sha256(rest).hexdigest() if digest else rest

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digest else "kept binary")
    return _windows.removed(docs, spans(docs, shape), shape, schema, one)
