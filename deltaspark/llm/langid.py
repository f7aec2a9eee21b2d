"""Language ID by language-bitmask n-gram filters.

Training counts byte n-grams (N = 2..5, lower-cased ASCII, any run of other
than letters one space) in a bounded sample of labelled rows and keeps, for
each language, the n-grams that are typical of it. The filters of all languages are
one bit-sliced Bloom filter: a table of slots, one bit for each language (a word
for every 64), of which HASHES words are ANDed to give at once the languages that have an
n-gram. Per-language popcounts over a text's n-grams, corrected for the
filters' false positives, decide.

Defined results: a null text, or one without letters, is `und` with score 0; a
text no n-gram of which is known gets the language with most labelled rows and
score 0; of languages with equally many hits the first by name wins; rows
without a label train nothing; repeated rows get equal results; an empty table
gives an empty result, and without any labelled row every prediction is `und`;
further columns are ignored. A very long text is counted block by block, so it
takes memory for its bytes and a block's n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _store
from ._text import lean, mix64, slices

#: Labelled rows to learn from, about, at most.
SAMPLE_ROWS = 4000
#: Languages for which a slot of the table has one word.
WORD = 64
#: n-grams kept for each language and length: with the table's size it sets the false positives (2,000 to 20,000 differ little).
GRAMS = 6000
#: Times that an n-gram must occur in the sample to be kept.
LEAST_TIMES = 5
#: Bytes of folded text whose n-grams are looked up at once.
BLOCK = 1 << 17
SIZES = (2, 3, 4, 5)
HASHES = 3
BITS = 20
UND = "und"

_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_LETTER = regex.compile(r"\p{L}")
#: The bits of each byte.
_BITS_OF = np.arange(256)[:, None] >> np.arange(8) & 1


def _grams(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """n, hashes of the n-grams of folded texts, and the text of each; for every n, block by block."""
    folded = _FOLD[data]
    keep = np.ones(len(folded), dtype=bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32)
    keep[bounds[:-1][bounds[:-1] < len(folded)]] = True
    ends = np.cumsum([np.count_nonzero(keep[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())])
    folded = folded[keep]
    for a in range(0, len(folded), BLOCK):
        value = some = folded[a : a + BLOCK + max(SIZES) - 1].astype(np.uint64)
        owner = np.searchsorted(ends, np.arange(a, a + len(some)), side="right")
        for n in range(2, max(SIZES) + 1):
            if len(some) < n:
                break
            value = value[:-1] << np.uint64(8) | some[n - 1 :]
            if n in SIZES:
                whole = (owner[: len(value)] == owner[n - 1 :])[:BLOCK]
                yield n, mix64(value[:BLOCK][whole] | np.uint64(n) << np.uint64(56)), owner[: len(whole)][whole]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    false_rates: np.ndarray
    default: str

    def _lookup(self, hashes: np.ndarray) -> np.ndarray:
        mask = np.full((len(hashes), self.table.shape[1]), ~np.uint64(0))
        for k in range(HASHES):
            mask &= self.table[_slot(hashes, k)]
        return mask

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language and the score of each text."""
        names, scores = [], np.zeros(len(texts))
        count = len(self.languages)
        for part in slices(texts):
            hits, total = np.zeros((part.n, count)), np.zeros(part.n)
            for _, hashes, owner in _grams(part.data, part.bounds):
                mask = self._lookup(hashes)
                total += np.bincount(owner, minlength=part.n)
                for j in range(0, count, 8):  # texts by byte of the mask, whose bits are then counted
                    byte = (mask[:, j // WORD] >> np.uint64(j % WORD)).astype(np.uint8)
                    seen = np.bincount(owner << 8 | byte, minlength=part.n << 8).reshape(part.n, 256)
                    hits[:, j : j + 8] += seen @ _BITS_OF[:, : count - j]
            # of `total` n-grams, `rate` times those a language lacks are found all the same
            rate = self.false_rates[None, :]
            true = np.maximum(0.0, (hits - rate * total[:, None]) / (1 - rate))
            raw = part.data.tobytes()
            for k in range(part.n):
                whole = raw[part.bounds[k] : part.bounds[k + 1]]
                if not count or not _has_letter(whole):
                    names.append(UND)
                elif not true[k].any():
                    names.append(self.default)
                else:
                    best = int(true[k].argmax())
                    names.append(self.languages[best])
                    scores[part.first + k] = min(1.0, true[k, best] / true[k].sum())
        return names, scores


def _has_letter(raw: bytes) -> bool:
    if any(65 <= c <= 90 or 97 <= c <= 122 for c in raw[:64]):
        return True
    return _LETTER.search(raw.decode("utf-8", "replace")) is not None


def _slot(hashes: np.ndarray, k: int) -> np.ndarray:
    return (hashes >> np.uint64(k * BITS) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learnt from: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from text and lang of labelled; about sample_rows of them, chosen by a hash of the text.

    The driver gets only summed counts: GRAMS n-grams a language and length.
    """
    rows = labelled.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    if not languages:
        return Model([], np.zeros((1 << BITS, 1), dtype=np.uint64), np.zeros(0), UND)
    default, languages = languages[0], sorted(languages)
    each = max(1, sample_rows // len(languages))
    shares = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, each / sizes[lang]))])
    chosen = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < shares[F.col("lang")] * (1 << 30))
    index = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array([index[x] for x in batch.column(1).to_pylist()], dtype=np.int64)
            for part in slices(batch.column(0)):
                for n, hashes, owner in _grams(part.data, part.bounds):
                    own = langs[part.first + owner]
                    for i in np.unique(own).tolist():
                        keys, times = np.unique(hashes[own == i], return_counts=True)
                        columns = [np.full(len(keys), i), np.full(len(keys), n), keys.view(np.int64), times]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["lang", "n", "gram", "times"])

    counts = chosen.select("text", "lang").mapInArrow(lean(count), "lang long, n long, gram long, times long")
    counts = counts.groupBy("n", "gram", "lang").agg(F.sum("times").alias("times"))
    whole = F.sum("times").over(Window.partitionBy("n", "gram"))
    counts = _store.cut(counts.withColumn("whole", whole).where(F.col("whole") >= LEAST_TIMES).drop("whole"))
    # typical n-grams of a language: their share of its n-grams of that length is more than twice that of any other language
    totals = counts.groupBy("lang", "n").agg(F.sum("times").alias("total"))
    shared = counts.join(totals, ["lang", "n"]).groupBy("n", "gram").agg(F.sort_array(F.collect_list(F.struct((F.col("times") / F.col("total")).alias("share"), "lang", "times")), asc=False).alias("by"))
    typical = shared.where(F.col("by")[0]["share"] > 2 * F.coalesce(F.get("by", F.lit(1))["share"], F.lit(0.0))).select("n", "gram", F.col("by")[0]["lang"].alias("lang"), F.col("by")[0]["times"].alias("times"))
    order = Window.partitionBy("lang", "n").orderBy(F.desc("times"), "gram")
    kept = typical.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= GRAMS)
    table = np.zeros((1 << BITS, -(-len(languages) // WORD)), dtype=np.uint64)
    # at most GRAMS for each language and length
    for r in kept.groupBy("lang").agg(F.collect_list("gram").alias("grams")).collect():
        hashes, i = np.array(r["grams"], dtype=np.int64).view(np.uint64), r["lang"]
        for k in range(HASHES):
            table[_slot(hashes, k), i // WORD] |= np.uint64(1) << np.uint64(i % WORD)
    fill = np.array([(table[:, i // WORD] >> np.uint64(i % WORD) & np.uint64(1)).mean() for i in range(len(languages))])
    return Model(languages, table, fill**HASHES, default)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                names, scores = model.predict(batch.column(2))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of docs, then lang_pred and score."""
    names = docs.columns
    new = [next(x for x in (c, *(f"{c}_{i}" for i in range(99))) if x not in names) for c in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found, scores = model.predict(batch.column(names.index("text")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found), pa.array(scores)], [*names, *new])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(lean(run), f"{schema}, `{new[0]}` string, `{new[1]}` double")
