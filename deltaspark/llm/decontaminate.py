"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are the queries, documents the searched domain. An item with n distinct
shingles is contained in a document that holds at least ceil(threshold * n) of
them. Its sketch is the bottom-k MinHash: the k = n - ceil(threshold * n) + 1
shingles with the smallest hashes. A document that contains the item misses at
most k - 1 of its shingles, so it holds one of the sketch for certain: the
search has no false negatives. k depends on the item's size, and so does the
size below which a document can't contain it, hence items are partitioned by
size; each partition has its own sketch table. On the documents' side only the
MinHashes count that can lie in such a sketch, those up to the largest hash of
the partition's sketches, and documents with fewer shingles than the partition's
smallest item needs are passed over. So this is a prefix filter in the order of
MinHash, in place of estimates by sketches of equal size, which would miss some.
Candidates are verified by their exact shingle overlap.

Documents only stream past the sketches, without a shuffle. Items are taken in
blocks of at most BLOCK_SHINGLES shingles (8 MB), one pass over the documents for
each block: what the driver gathers and ships at once, and what an executor
holds, doesn't grow with the item table.

Shingles are WORDS consecutive words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased,
told apart by 64-bit hashes; an item with fewer words has one shingle, all of
it, and is sought as a run of that many words.

Defined results: null or wordless texts contain nothing and are contained in
nothing; repeated rows give repeated result rows; a null id stays null; empty
tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store
from ._text import byte_prefix, gram_hash, lean, slices, span_hash

WORDS = 5
THRESHOLD = 80  # per cent
#: Shingles of the items of one block, at most (an item is never split).
BLOCK_SHINGLES = 1_000_000


def item_shingles(items: DataFrame, words: int = WORDS) -> DataFrame:
    """item_id, gram (words in a shingle), shingles (distinct, ascending as unsigned)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, grams, sets = [], [], []
            for part in slices(batch.column(1), lower=True):
                starts, ends, before = part.words()
                hashes = span_hash(byte_prefix(part.data), starts, ends)
                for k in range(part.n):
                    own = hashes[before[k] : before[k + 1]]
                    if len(own):
                        owners.append(part.first + k)
                        grams.append(min(words, len(own)))
                        sets.append(np.unique(gram_hash(own, grams[-1])).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int64())), pa.array(grams, pa.int32()), pa.array(sets, pa.list_(pa.int64()))], ["item_id", "gram", "shingles"])

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(lean(run), "item_id long, gram int, shingles array<long>")


class _Partition:
    """The sketch table of the items of one size class and shingle length."""

    def __init__(self, gram: int, members: list[tuple[int, np.ndarray, int]]):
        self.gram, self.members = gram, members
        self.least = min(need for _, _, need in members)
        sketch = [(h, i) for i, (_, own, need) in enumerate(members) for h in own[: len(own) - need + 1].tolist()]
        sketch.sort()
        self.hashes = np.array([h for h, _ in sketch], dtype=np.uint64)
        self.owners = np.array([i for _, i in sketch], dtype=np.int64)
        self.top = self.hashes[-1]


def _partitions(block: list, threshold: int) -> list[_Partition]:
    classes = defaultdict(list)
    for item_id, gram, shingles in block:
        own = np.array(shingles, dtype=np.int64).view(np.uint64)
        classes[gram, len(own).bit_length()].append((item_id, own, -(-threshold * len(own) // 100)))
    return [_Partition(gram, members) for (gram, _), members in sorted(classes.items())]


def _blocks(items: DataFrame, threshold: int, words: int) -> Iterator[list[_Partition]]:
    """The sketch tables of the items, in blocks of bounded size."""
    if not 0 < threshold <= 100:
        raise ValueError("the threshold must lie in 1..100 per cent")
    prepared = _store.cut(item_shingles(items, words))
    total = prepared.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0)).alias("n")).first()["n"]
    blocks = -(-total // BLOCK_SHINGLES)
    numbered = prepared.withColumn("_block", F.pmod(F.xxhash64("item_id", "shingles"), F.lit(max(1, blocks))))
    for b in range(blocks):
        rows = numbered.where(F.col("_block") == b).collect()
        yield _partitions([(r["item_id"], r["gram"], r["shingles"]) for r in rows], threshold)


def contained(docs: DataFrame, items: DataFrame, threshold: int = THRESHOLD, words: int = WORDS) -> DataFrame:
    """Items contained in documents: doc_id, item_id, n_item, n_shared, containment."""
    names = ["doc_id", "item_id", "n_item", "n_shared", "containment"]
    schema = "doc_id long, item_id long, n_item long, n_shared long, containment double"

    def search(parts: list[_Partition]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(_matches(batch.column(1), parts))
                rows, ids, sizes, shared = zip(*found) if found else ((), (), (), ())
                n_item, n_shared = np.array(sizes, dtype=np.int64), np.array(shared, dtype=np.int64)
                owners = batch.column(0).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([owners, pa.array(ids, pa.int64()), pa.array(n_item), pa.array(n_shared), pa.array(n_shared / np.maximum(n_item, 1))], names)

        return run

    own = docs.select(F.col("doc_id").cast("long"), "text")
    out = None
    for parts in _blocks(items, threshold, words):
        found = own.mapInArrow(lean(search(parts)), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, items: DataFrame, threshold: int = THRESHOLD, words: int = WORDS) -> DataFrame:
    """The rows of docs, as they are, that contain no item."""
    at = docs.columns.index("text")

    def search(parts: list[_Partition]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[row for row, *_ in _matches(batch.column(at), parts)]] = False
                yield batch.filter(pa.array(keep))

        return run

    for parts in _blocks(items, threshold, words):
        docs = docs.mapInArrow(lean(search(parts)), docs.schema)
    return docs


def _matches(texts: pa.Array, parts: list[_Partition]) -> Iterator[tuple[int, int | None, int, int]]:
    """Row, item_id, the item's shingles and the shared ones, of each item that a text contains."""
    for piece in slices(texts, lower=True):
        starts, ends, before = piece.words()
        hashes = span_hash(byte_prefix(piece.data), starts, ends)
        grams = {n: gram_hash(hashes, n) for n in {p.gram for p in parts}}
        for p in parts:
            all_grams = grams[p.gram]
            if not len(all_grams):
                continue
            low = np.flatnonzero(all_grams <= p.top)
            hits = low[p.hashes[np.searchsorted(p.hashes, all_grams[low])] == all_grams[low]]
            hits = hits[hits + p.gram <= before[np.searchsorted(before, hits, side="right")]]  # not across two texts
            owner = np.searchsorted(before, hits, side="right") - 1
            for k in np.unique(owner).tolist():
                last = before[k + 1] - p.gram + 1
                if last - before[k] < p.least:
                    continue
                seen = np.unique(all_grams[hits[owner == k]])
                lo, hi = np.searchsorted(p.hashes, seen), np.searchsorted(p.hashes, seen, side="right")
                own = np.unique(all_grams[before[k] : last])
                for i in np.unique(np.concatenate([p.owners[a:b] for a, b in zip(lo, hi)])).tolist():
                    item_id, shingles, need = p.members[i]
                    spot = np.searchsorted(own, shingles)
                    spot[spot == len(own)] = 0
                    shared = int((own[spot] == shingles).sum())
                    if shared >= need:
                        yield piece.first + k, item_id, len(shingles), shared
