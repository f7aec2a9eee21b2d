"""Best-fit packing by minimum bin slack.

The planner never sees documents, only how many pieces there are of each
length, so its input is bounded by the capacity, not by the corpus. For each
bin it fixes the longest length that is left, finds by a bitset subset-sum
dynamic programme over the lengths still available the fullest bin around it,
and removes that combination. While the stock lasts the same combination would
be found again, so it is taken as many times as the stock allows at once; each
such step uses up a length, and the plan stays small whatever the corpus size.

Pieces then find their places by arithmetic: the rank of a piece among those
of its length selects an entry of the plan.

Defined results: a null text is an empty document (one piece holding only the
end id); rows repeated in the input are packed as often as they occur; rows
with null doc_id are packed too; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _store
from ._text import byte_prefix, lean, ranges, slices, span_hash

CAPACITY = 2048
END_ID = 0
#: Words whose ids a worker keeps (some 30 bytes each); beyond it the cache starts anew.
CACHE_WORDS = 1_000_000
#: Bytes of text that are encoded at once.
SLICE = 1 << 20
#: Groups that the pieces of one length are dealt over, at most; it bounds the counts the driver sums.
MOST_SALTS = 256


def fullest(stock: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """The combination of available lengths that fills `room` best; long lengths first among equals.

    stock: (length, count), lengths ascending. Returns (length, times).
    """
    mask = (1 << (room + 1)) - 1
    reach = [1]
    usable = stock[: bisect_right(stock, (room, 1 << 62))]
    for length, count in usable:
        bits, left, step = reach[-1], min(count, room // length), 1
        while left > 0:
            take = min(step, left)
            bits |= (bits << (take * length)) & mask
            left -= take
            step *= 2
        reach.append(bits)
    target = reach[-1].bit_length() - 1
    chosen = []
    for i in range(len(usable), 0, -1):
        length, count = usable[i - 1]
        for times in range(min(count, target // length), -1, -1):
            if reach[i - 1] >> (target - times * length) & 1:
                break
        if times:
            chosen.append((length, times))
            target -= times * length
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Bins for `counts` pieces of each length, as (length, rank_from, bins, first_bin, offset).

    One entry places the pieces of that length with ranks rank_from .. rank_from + bins - 1,
    one in each of the bins first_bin .. first_bin + bins - 1, all at the same offset.
    """
    left = {k: v for k, v in sorted(counts.items()) if v > 0}
    used = dict.fromkeys(left, 0)
    entries, first = [], 0
    while left:
        longest = next(reversed(left))
        stock = [(k, v - (k == longest)) for k, v in left.items() if v > (k == longest)]
        picked = dict(fullest(stock, capacity - longest)) if longest < capacity else {}
        picked[longest] = picked.get(longest, 0) + 1
        bins = min(left[k] // n for k, n in picked.items())
        offset = 0
        for k in sorted(picked, reverse=True):
            for _ in range(picked[k]):
                entries.append((k, used[k], bins, first, offset))
                used[k] += bins
                offset += k
            left[k] -= picked[k] * bins
            if not left[k]:
                del left[k]
        first += bins
    return entries


class Encoder:
    """Token ids of whole texts, with the ids of each word computed once per worker.

    The tokenizer of `path` drops white space and never joins what white space
    separates, so words can be encoded one by one. Words of lower-case ASCII
    letters skip its normaliser, which would leave them as they are.
    """

    _known: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.clear()

    @classmethod
    def get(cls, path: str) -> Encoder:
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def clear(self) -> None:
        # hashes of the known words, ascending, and the number of each; ids of word i lie at offsets[i] .. offsets[i + 1]
        self.keys, self.numbers = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int32)
        self.offsets = np.zeros(1 << 12, dtype=np.int32)
        self.pool = np.zeros(1 << 14, dtype=np.int32)

    def _add(self, keys: np.ndarray, words: list[bytes]) -> None:
        """Learns words by their hashes (ascending), none of which is known."""
        tokenize, found = self.model.tokenize, []
        for word in words:
            if word.isalpha():  # of bytes: ASCII letters only
                found.append([x.id for x in tokenize(word.decode())])
            else:
                found.append(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)
        n, filled = len(self.keys), int(self.offsets[len(self.keys)])
        ends = filled + np.cumsum([len(x) for x in found])
        self.offsets = _room(self.offsets, n + len(words) + 1)
        self.offsets[n + 1 : n + 1 + len(words)] = ends
        self.pool = _room(self.pool, int(ends[-1]))
        self.pool[filled : ends[-1]] = [i for x in found for i in x]
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.numbers = np.insert(self.numbers, at, np.arange(n, n + len(words), dtype=np.int32))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where keys lie among the known ones, and whether they do."""
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        return at, known

    def encode(self, part) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a lower-cased Slice, and the place where each text's ids begin."""
        data = part.data
        starts, ends, before = part.words()
        if not len(starts):
            return np.empty(0, dtype=np.int32), np.zeros(part.n + 1, dtype=np.int64)
        # a run of sentence punctuation after a letter is a unit of its own: fewer different units
        body = ends.copy()
        for _ in range(3):
            cut = (body - starts > 1) & _PUNCTUATION[data[body - 1]]
            if not cut.any():
                break
            body -= cut
        split = (body < ends) & _LETTER[data[body - 1]]
        body = np.where(split, body, ends)
        order = np.cumsum(split + 1) - split - 1
        total = len(starts) + int(split.sum())
        unit_starts, unit_ends = np.empty(total, dtype=np.int64), np.empty(total, dtype=np.int64)
        unit_starts[order], unit_ends[order] = starts, body
        unit_starts[order[split] + 1], unit_ends[order[split] + 1] = body[split], ends[split]
        firsts = np.append(order, total)[before]
        keys, where, inverse = np.unique(span_hash(byte_prefix(data), unit_starts, unit_ends), return_index=True, return_inverse=True)
        at, known = self._places(keys)
        if len(self.keys) + int((~known).sum()) > CACHE_WORDS:
            self.clear()
            known = np.zeros(len(keys), dtype=bool)
        if not known.all():
            raw, places = data.tobytes(), where[~known]
            self._add(keys[~known], [raw[a:b] for a, b in zip(unit_starts[places].tolist(), unit_ends[places].tolist())])
            at, _ = self._places(keys)
        index = self.numbers[at][inverse]
        begins = self.offsets[index].astype(np.int64)
        counts = self.offsets[index + 1] - begins
        ids = self.pool[ranges(begins, counts)]
        return ids, np.concatenate([[0], np.cumsum(counts)])[firsts]


def _room(values: np.ndarray, size: int) -> np.ndarray:
    """values, made longer until `size` of them have room."""
    return np.concatenate([values, np.zeros(max(size, 2 * len(values)) - len(values), dtype=values.dtype)]) if size > len(values) else values


_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[list(b".,!?;:|")] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Token pieces of at most `capacity` ids: doc_id, piece, start, length, ids_crc32 (and ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.get(tokenizer)
        for batch in batches:
            doc_ids = batch.column(0)
            for part in slices(batch.column(1), lower=True, most=SLICE):
                ids, bounds = encoder.encode(part)
                rows, bounds = [], bounds.tolist()
                for k in range(part.n):
                    own = np.append(ids[bounds[k] : bounds[k + 1]], end_id).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        some = own[start : start + capacity]
                        rows.append((part.first + k, piece, start, len(some), zlib.crc32(some.tobytes()), some.astype(np.int32) if with_ids else None))
                own, piece, start, length, crc, values = zip(*rows)
                columns = [doc_ids.take(pa.array(own)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(values, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), _PIECES + (", ids array<int>" if with_ids else ""))


def assign(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows that have doc_id, piece and length.

    `rows` is read twice, so it should be a table. Ranks within a length are
    dealt over salted groups, whose counts are summed first: no task holds all
    the pieces of a common length.
    """
    spark = rows.sparkSession
    salts = min(MOST_SALTS, max(1, _store.partitions(spark)))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n"))
    # of bounded size: at most `capacity` lengths times the salts
    counted = sorted((x["length"], x["_salt"], x["n"]) for x in sizes.collect())
    totals: dict[int, int] = {}
    lengths, salt_ids, befores = [], [], []
    for length, salt, n in counted:
        lengths.append(length)
        salt_ids.append(salt)
        befores.append(totals.get(length, 0))
        totals[length] = befores[-1] + n
    entries = np.array(sorted(plan(totals, capacity)), dtype=np.int64).reshape(-1, 5)
    base = {(a, b): c for a, b, c in zip(lengths, salt_ids, befores)}
    order = entries[:, 0] << 44 | entries[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length = np.asarray(batch.column("length"))
            before = np.fromiter((base[x] for x in zip(length.tolist(), batch.column("_salt").to_pylist())), dtype=np.int64, count=len(length))
            rank = before + np.asarray(batch.column("_rank")) - 1
            at = np.searchsorted(order, length << 44 | rank, side="right") - 1
            names = batch.schema.names[:-2]
            columns = [batch.column(n) for n in names]
            columns += [pa.array(entries[at, 3] + rank - entries[at, 1]), pa.array(entries[at, 4])]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    window = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    ranked = salted.select(*rows.columns, "_salt", F.row_number().over(window).alias("_rank"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return ranked.mapInArrow(lean(place), f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Packs whole documents into sequences of at most `capacity` ids; see the module's text."""
    return assign(_store.cut(pieces(docs, tokenizer, capacity, end_id)), capacity)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids; the pieces in order of their offsets."""
    placed = assign(_store.cut(pieces(docs, tokenizer, capacity, end_id, with_ids=True)), capacity)
    grouped = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return grouped.select("sequence_id", F.flatten("parts.ids").alias("ids"))
