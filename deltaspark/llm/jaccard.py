"""N-gram Jaccard join by T-occurrence search.

Documents with equal shingle sets form a class, found by a digest; classes are
joined. A partner lacks at most n - ceil(s * n) of a set's shingles. So of the
set's shingles whose hashes lie in the lowest part of the hash space, twice as
large a part as that number, it has all but so many, about half; of a small
set, all of which is taken, it has ceil(s * n). (If that asks for none, one of
the first n - ceil(s * n) + 1 shingles in the order of hashes is shared.) Of
these shingles, the candidates, it is counted how many classes hold each, and
a class that shares too few of its own with any can't link with another. Pairs
are listed where few classes hold a shingle, and meet if they share enough of
such shingles; classes that may find all that is needed in longer lists meet
in a prefix of these, rarest first. Classes that meet form families (components
of the meeting graph); no link leaves a family, and each family is searched in
one place. Sharing a few shingles by chance, or a common line, makes no family:
families by any shared shingle would grow together as a corpus grows.

The search is T-occurrence: for a query set, partners are those that occur in
at least T of the inverted lists of its shingles, T being the overlap that the
threshold asks of the smallest partner possible. Short lists are merged in order
of their members (a heap of list heads would pop them one by one; here numpy
merges the runs, or counts where there are more entries than members); then each
partner that can still reach T is looked up in the long lists by binary search
(DivideSkip), or these are merged too where that is cheaper. The overlap is exact
in the end, and links are exact.

A family is split into blocks of at most BLOCK_SHINGLES shingles, whose pairs
are searched in separate tasks; pairs of documents are never listed, only each
class's number of links and a spanning forest leave a task.

Shingles are told apart by 64-bit hashes, classes by 128 bits: 64 of them name a
class, and where the other 64 differ under one name (a few pairs among 10^10
sets) these classes get names of their own. Counts from MOST_COUNTED on are all
the same to the order, which only steers how much is searched.

Defined results: a document without words, or a null text, has no shingles and
no links; a text with fewer words than a shingle has one, all of it; rows with
equal sets (repeated rows too) link with one another; null doc_ids are ignored
when a component's smallest doc_id is taken; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _graph, _store
from ._text import byte_prefix, gram_hash, lean, ranges, runs, sequence_prefix, slices, span_hash
from ._windows import keyed

WORDS = 4
SIMILARITY = 85  # per cent
#: Counts of shared shingles from this number on are all the same to the order.
MOST_COUNTED = 4096
BLOCK_SHINGLES = 2_000_000
#: Sets up to this size meet by all of their shingles: the counted part of so few says little.
SMALL_SET = 128
#: Pairs of classes are listed for shingles of up to so many.
SHORT_LIST = 16
#: Shingles that leave a Python worker at once, about.
FLUSH = 1 << 18
#: The filter of texts to exchange has up to 2 ** MOST_BITS bits (16 MB).
MOST_BITS = 27
#: Inverted lists from this length on may be probed instead of merged.
LONG_LIST = 64


def shingle_sets(texts: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """The row and the distinct shingles (ascending) of each text that has words."""
    for part in slices(texts, lower=True):
        starts, ends, before = part.words()
        hashes = span_hash(byte_prefix(part.data), starts, ends)
        grams = gram_hash(hashes, words)
        for k in range(part.n):
            a, b = before[k], before[k + 1]
            if b - a >= words:
                yield part.first + k, np.unique(grams[a : b - words + 1])
            elif b > a:
                yield part.first + k, gram_hash(hashes[a:b], b - a)


def class_of(own: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """The digest of a set: the name of its class (cut to `bits`, for tests) and 64 more bits."""
    name, check = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), dtype="<i8").tolist()
    return name & ((1 << bits) - 1) if bits < 64 else name, check


def prefix_size(n: int, similarity: int) -> int:
    return n - -(-similarity * n // 100) + 1


def counted_part(own: np.ndarray, similarity: int) -> int:
    """How many of a set's shingles (ascending) lie in the counted part of the hash space."""
    bound = min((1 << 64) - 1, (1 << 64) * 2 * (100 - similarity) // 100)
    return int(np.searchsorted(own, np.uint64(bound)))


def signatures(docs: DataFrame, words: int, similarity: int, bits: int = 64, twins: dict | None = None) -> DataFrame:
    """_doc, _tid, doc_id, class (null without shingles), check, n_shingles, slots of every document.

    slots: the size of the prefix less the shingles in the counted part; twins: names for classes that share one.
    """
    twins = twins or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, checks, sizes, slots = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(4))
            for row, own in shingle_sets(batch.column("text"), words):
                mark = class_of(own, bits)
                classes[row], checks[row], sizes[row] = twins.get(mark, mark[0]), mark[1], len(own)
                slots[row] = prefix_size(len(own), similarity) - counted_part(own, similarity)
            columns = [*(batch.column(c) for c in ("_doc", "_tid", "doc_id")), pa.array(classes, mask=sizes == 0), pa.array(checks), pa.array(sizes), pa.array(slots)]
            yield pa.RecordBatch.from_arrays(columns, ["_doc", "_tid", "doc_id", "class", "check", "n_shingles", "slots"])

    rows = keyed(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(lean(run), "_doc long, _tid long, doc_id long, class long, check long, n_shingles long, slots long")


def _classes(marks: DataFrame) -> DataFrame:
    found = marks.where("class is not null").groupBy("class")
    return _store.cut(
        found.agg(
            F.min(F.struct("_doc", "_tid")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("slots").alias("slots"),
            F.min("check").alias("check0"), F.max("check").alias("check1"),
        )
    )


def _named(docs: DataFrame, words: int, similarity: int, bits: int) -> tuple[DataFrame, DataFrame, dict]:
    """signatures(), the classes, and the names of those that would share one."""
    marks = _store.cut(signatures(docs, words, similarity, bits))
    classes = _classes(marks)
    mixed = classes.where("check0 <> check1").select("class")
    if mixed.isEmpty():
        return marks, classes, {}
    # sets that agree in 64 bits and differ in 64 others: some n^2 / 2^65 of n different sets
    pairs = marks.join(mixed, "class", "left_semi").select("class", "check").distinct().collect()
    twins = {(r["class"], r["check"]): xxhash.xxh3_64_intdigest(np.array(tuple(r), dtype="<i8").tobytes()) - (1 << 63) for r in pairs}
    marks = _store.cut(signatures(docs, words, similarity, bits, twins))
    return marks, _classes(marks), twins


def _candidates(docs: DataFrame, words: int, similarity: int, bits: int, twins: dict) -> DataFrame:
    """shingle, class: of each set the counted part, and the next shingles if that is less than a prefix; all of a small set.

    The last bit of shingle tells rows of small sets (1) from others. Sets that may link with either kind are in both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, classes, seen, size = [], [], set(), 0

            def done() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(classes))], ["shingle", "class"])

            for _, own in shingle_sets(batch.column(0), words):
                mark = class_of(own, bits)
                if mark not in seen:
                    seen.add(mark)
                    parts = []
                    if len(own) > SMALL_SET:
                        parts.append(own[: max(prefix_size(len(own), similarity), counted_part(own, similarity))] & ~np.uint64(1))
                    if len(own) <= 100 * SMALL_SET // similarity:
                        parts.append(own | np.uint64(1))
                    for part in parts:
                        found.append(part)
                        classes.append(np.full(len(part), twins.get(mark, mark[0]), dtype=np.int64))
                        size += len(part)
                    if size >= FLUSH:
                        yield done()
                        found, classes, size = [], [], 0
            if found:
                yield done()

    return docs.select("text").mapInArrow(lean(run), "shingle long, class long")


def _shared(rows: DataFrame) -> DataFrame:
    """shingle, class, n of the shingles that several classes share; n is their number, up to MOST_COUNTED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come by shingle and class; the last shingle's may go on in the next batch
        kept = np.empty((0, 2), dtype=np.int64)
        full = None  # a shingle whose first MOST_COUNTED classes are out already
        schema = ["shingle", "class", "n"]
        for batch in batches:
            some = np.stack([np.asarray(batch.column(0)), np.asarray(batch.column(1))], axis=1)
            some = np.concatenate([kept, some])
            if not len(some):
                continue
            new = np.r_[True, (some[1:] != some[:-1]).any(axis=1)]
            some = some[new]
            if full is not None:
                more = int(np.searchsorted(some[:, 0] != full[0], True))
                rest = some[:more][some[:more, 1] != full[1]]
                if len(rest):
                    full = (full[0], rest[-1, 1])
                    yield _batch(rest, np.full(len(rest), MOST_COUNTED), schema)
                some = some[more:]
                if not len(some):
                    kept = some
                    continue
                full = None
            starts, ends = runs(some[:, 0])
            last = starts[-1]
            counts = (ends - starts)[:-1]
            n = np.repeat(np.minimum(counts, MOST_COUNTED), counts)
            if (n > 1).any():
                yield _batch(some[:last][n > 1], n[n > 1], schema)
            kept = some[last:]
            if len(kept) >= MOST_COUNTED:
                yield _batch(kept, np.full(len(kept), MOST_COUNTED), schema)
                full = tuple(kept[-1])
                kept = kept[:0]
        if len(kept) > 1:
            yield _batch(kept, np.full(len(kept), len(kept)), schema)

    dealt = rows.repartition("shingle").sortWithinPartitions("shingle", "class")
    return dealt.mapInArrow(lean(run), "shingle long, class long, n long")


def _batch(rows: np.ndarray, n: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[:, 0].copy()), pa.array(rows[:, 1].copy()), pa.array(n.astype(np.int64))], names)


def _met(candidates: DataFrame, classes: DataFrame, similarity: int) -> DataFrame:
    """a, b: links between classes, in whose components any two classes that are similar enough meet.

    Such classes share as many candidates as either must (least). Pairs are listed and counted for shingles of up to
    SHORT_LIST classes only; a class that may find all it must share in longer lists goes to the rarest of these,
    as many as a prefix needs, and all that meet there are linked.
    """
    shared = _shared(candidates).join(classes.select("class", "slots", F.col("n").alias("size")), "class")
    long = F.col("n") > SHORT_LIST
    shared = shared.withColumn("small", F.col("shingle").bitwiseAND(F.lit(1)))
    mine = Window.partitionBy("class", "small")
    least = F.when(F.col("small") == 1, F.expr(f"(size * {similarity} + 99) div 100")).otherwise(F.greatest(F.lit(1), 1 - F.col("slots")))
    # no partner without enough shared shingles
    live = shared.withColumn("held", F.count(F.lit(1)).over(mine)).where(F.col("held") >= least)
    live = live.withColumn("need", (least - F.count_if(long).over(mine)).cast("int"))
    live = live.withColumn("rank", F.when(long, F.row_number().over(mine.orderBy(~long, "n", "shingle"))))
    live = _store.cut(live.where(~long | (F.col("rank") <= 1 - F.col("need"))).select("shingle", "class", F.col("size").cast("int").alias("size"), "need", long.alias("long")))

    pairs = _pairs(live.where(~F.col("long")), similarity).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need"))
    there = live.where("long")
    hubs = _store.cut(there.groupBy("shingle").agg(F.min("class").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    stars = _store.joined(there, hubs, ["shingle"], "n").where("hub <> class")
    return pairs.where("n >= need").select("a", "b").unionByName(stars.select(F.col("class").alias("a"), F.col("hub").alias("b")))


def _pairs(rows: DataFrame, similarity: int) -> DataFrame:
    """a, b, need: a row for each shingle that two classes share, if their sizes allow a link; need: the larger of theirs.

    A shingle has up to SHORT_LIST classes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.empty((0, 4), dtype=np.int64)
        for batch in batches:
            kept = np.concatenate([kept, np.stack([np.asarray(c.cast(pa.int64())) for c in batch.columns], axis=1)])
            # the last shingle's may go on in the next batch
            last = int(np.searchsorted(kept[:, 0] == kept[-1, 0], True)) if len(kept) else 0
            yield from paired(kept[:last])
            kept = kept[last:]
        yield from paired(kept)

    def paired(some: np.ndarray) -> Iterator[pa.RecordBatch]:
        for d in range(1, SHORT_LIST):
            a, b = some[:-d], some[d:]
            small, large = np.minimum(a[:, 2], b[:, 2]), np.maximum(a[:, 2], b[:, 2])
            both = np.flatnonzero((a[:, 0] == b[:, 0]) & (a[:, 1] != b[:, 1]) & (100 * small >= similarity * large))
            if len(both):
                need = np.maximum(a[both, 3], b[both, 3]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(a[both, 1]), pa.array(b[both, 1]), pa.array(need)], ["a", "b", "need"])

    dealt = rows.select("shingle", "class", "size", "need").repartition("shingle").sortWithinPartitions("shingle", "class")
    return dealt.mapInArrow(lean(run), "a long, b long, need int")


def _merged(members: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The members of some ascending lists, one after another, each once and in order; and in how many lists each is."""
    if len(members) > size:
        times = np.bincount(members, minlength=size)
        found = np.flatnonzero(times)
        return found, times[found]
    members = np.sort(members, kind="stable")  # merges the runs
    starts, ends = runs(members)
    return members[starts], ends - starts


def divide_skip(keys: np.ndarray, bounds: np.ndarray, lists: np.ndarray, need: int, size: int) -> np.ndarray:
    """How many of the inverted lists `lists` hold each member: exactly for those in `need` or more, at most that for others."""
    times = np.zeros(size, dtype=np.int64)
    found, often = occurrences(keys, bounds, lists, need, size)
    times[found] = often
    return times


def occurrences(keys: np.ndarray, bounds: np.ndarray, lists: np.ndarray, need: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of the inverted lists `lists`, ascending, and how many of these hold each; all that are in `need` or more, exactly.

    keys: list << 32 | member, ascending; bounds: where each list lies; size: the number of members.
    """
    starts, lengths = bounds[lists], bounds[lists + 1] - bounds[lists]
    order = np.argsort(-lengths, kind="stable")
    count = min(int((lengths >= LONG_LIST).sum()), max(0, need - 1) // 2)
    long, short = order[:count], order[count:]
    member = lambda some: keys[ranges(starts[some], lengths[some])] & 0xFFFFFFFF
    found, times = _merged(member(short), size)
    if count:
        likely = times >= need - count
        found, times = found[likely], times[likely]
        if len(found) * count * 8 < lengths[long].sum():
            probes = (lists[long][:, None] << 32 | found[None, :]).ravel()
            at = np.searchsorted(keys, probes)
            at[at == len(keys)] = 0
            times += (keys[at] == probes).reshape(count, -1).sum(axis=0)
        else:
            more, often = _merged(member(long), size)
            at = np.searchsorted(more, found)
            at[at == len(more)] = 0
            times += np.where(more[at] == found, often[at], 0)
    return found, times


def search(sets: list[np.ndarray], blocks: np.ndarray, copies: np.ndarray, similarity: int, cross: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each set, the first set of its component and the number of documents it links with.

    cross: only pairs from different blocks are looked at.
    """
    size = len(sets)
    lengths = np.array([len(s) for s in sets])
    shingles = np.concatenate(sets)
    owners = np.repeat(np.arange(size), lengths)
    _, lists = np.unique(shingles, return_inverse=True)
    keys = np.sort(lists.astype(np.int64) << 32 | owners)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(lists))])
    own_lists = np.split(lists.astype(np.int64), np.cumsum(lengths)[:-1])
    root, links = np.arange(size), np.zeros(size, dtype=np.int64)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for q in range(size):
        n = len(sets[q])
        # the smallest partner has ceil(s * n) shingles, all of which must be shared
        need = -(-similarity * n // 100)
        partners, times = occurrences(keys, bounds, own_lists[q], need, size)
        partners = partners[100 * times >= similarity * (n + lengths[partners] - times)]
        partners = partners[(partners != q) & ((not cross) | (blocks[partners] != blocks[q]))]
        links[q] = copies[partners].sum()
        for p in partners[(partners > q) & (root[partners] != root[q])].tolist():
            a, b = find(q), find(p)
            if a != b:
                root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(size)]), links


def _searched(members: DataFrame, similarity: int) -> DataFrame:
    """class, root, links for each class and cell; members: family, left, right, block, class, copies, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def done() -> pa.RecordBatch:
            sets = [np.frombuffer(r[6], dtype=np.uint64) for r in held]
            copies = np.array([r[5] for r in held], dtype=np.int64)
            classes = np.array([r[4] for r in held], dtype=np.int64)
            roots, links = search(sets, np.array([r[3] for r in held]), copies, similarity, held[0][1] != held[0][2])
            return pa.RecordBatch.from_arrays([pa.array(classes), pa.array(classes[roots]), pa.array(links)], ["class", "root", "links"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[:3] != at:
                    yield done()
                    held = []
                at = row[:3]
                if not held or row[4] != held[-1][4]:  # repeated rows of a document bring its class again
                    held.append(row)
        if held:
            yield done()

    dealt = members.repartition("family", "left", "right").sortWithinPartitions("family", "left", "right", "class")
    return dealt.mapInArrow(lean(run), "class long, root long, links long")


def _likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of a wanted _tid and a few others, so that most texts that a join by _tid drops aren't exchanged for it.

    A filter of one bit for each value of as many bits of _tid as it takes; beyond MOST_BITS it lets more rows pass.
    """
    bits = min(MOST_BITS, max(16, (16 * wanted.count()).bit_length()))
    page = 1 << 16

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages: dict[int, np.ndarray] = {}
        for batch in batches:
            values = np.unique(np.asarray(batch.column(0)))
            starts, ends = runs(values // page)
            for a, b in zip(starts.tolist(), ends.tolist()):
                pages.setdefault(int(values[a]) // page, np.zeros(page, dtype=bool))[values[a:b] % page] = True
        for at, marked in pages.items():
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([np.packbits(marked).tobytes()])], ["page", "bits"])

    place = F.col("_tid").bitwiseAND(F.lit((1 << bits) - 1))
    places = wanted.select(place.alias("place")).repartition(F.shiftright("place", 16))
    marked = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for at, some in places.mapInArrow(lean(build), "page long, bits binary").collect():
        marked[at * page // 8 : (at + 1) * page // 8] |= np.frombuffer(some, dtype=np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(marked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = shared.value
        for batch in batches:
            at = np.asarray(batch.column("_tid")) & ((1 << bits) - 1)
            yield batch.filter(pa.array(((filled[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)))

    return rows.mapInArrow(lean(run), rows.schema)


def _components(docs: DataFrame, words: int, similarity: int, bits: int = 64) -> DataFrame:
    """_doc, _tid, doc_id, n_shingles, label (of its component; null without shingles), n_links of every row."""
    marks, classes, twins = _named(docs, words, similarity, bits)

    families = _graph.components(_met(_candidates(docs, words, similarity, bits, twins), classes, similarity))

    families = families.select(F.col("node").alias("class"), F.col("label").alias("family")).join(classes, "class")
    sizes = families.groupBy("family").agg(F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("members"))
    families = _store.cut(_store.joined(families, sizes, ["family"], "members"))
    split = not families.where("blocks > 1").isEmpty()

    wanted = families.select("rep._doc", "rep._tid", "family", "blocks", "class", "copies")
    held = _likely(keyed(docs, "text"), wanted).join(wanted, ["_doc", "_tid"]).select("text", "family", "blocks", "class", "copies")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ["family", "blocks", "class", "copies", "shingles"]
            rows, found, size = [], [], 0

            def done() -> pa.RecordBatch:
                taken = pa.array(rows, pa.int64())
                return pa.RecordBatch.from_arrays([*(batch.column(c).take(taken) for c in names[:-1]), pa.array(found, pa.binary())], names)

            for row, own in shingle_sets(batch.column(0), words):
                rows.append(row)
                found.append(own.tobytes())
                size += len(own)
                if size >= FLUSH:
                    yield done()
                    rows, found, size = [], [], 0
            if rows:
                yield done()

    members = held.mapInArrow(lean(sets), "family long, blocks int, class long, copies long, shingles binary")
    members = members.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("family", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "class", "copies", "shingles")
    found = _store.cut(_searched(members, similarity))
    if split:
        labels = _graph.components(found.where("class <> root").select(F.col("class").alias("a"), F.col("root").alias("b")))
        labels = labels.select(F.col("node").alias("class"), "label")
    else:
        labels = found.select("class", F.col("root").alias("label"))
    links = found.groupBy("class").agg(F.sum("links").alias("links"))

    about = classes.select("class", "copies").join(labels, "class", "left").join(links, "class", "left")
    about = _store.cut(about.select("class", "copies", F.coalesce("label", "class").alias("label"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    names = ["_doc", "_tid", "doc_id", "n_shingles", "label", "n_links"]
    known = _store.joined(marks.where("class is not null"), about, ["class"], "copies").select(*names)
    wordless = marks.where("class is null").withColumns({"label": F.lit(None).cast("long"), "n_links": F.lit(0).cast("long")})
    return _store.cut(known.unionByName(wordless.select(*names)))


def join(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY, bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row of docs."""
    known = _components(docs, words, similarity, bits)
    named = known.where("label is not null")
    least = _store.cut(named.groupBy("label").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("members")))
    linked = _store.joined(named, least, ["label"], "members").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), "n_links")
    return linked.unionByName(known.where("label is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "n_links"))


def dedup(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of docs, as they are, of which one stays for each component: that with the smallest doc_id.

    Rows without shingles are no copies of anything and stay.
    """
    known = _components(docs, words, similarity)
    first = known.where("label is not null").groupBy("label").agg(F.min(F.struct("_doc", "_tid")).alias("rep"))
    kept = first.select("rep._doc", "rep._tid", F.lit(1).alias("_one"))
    kept = kept.unionByName(known.where("label is null").select("_doc", "_tid", F.lit(0).alias("_one")).distinct())
    # rows travel as a struct: no name of theirs clashes with ours
    rows = keyed(docs, F.struct(*docs.columns).alias("_row"))
    joined = rows.join(_store.cut(kept), ["_doc", "_tid"])
    order = F.row_number().over(Window.partitionBy("_doc", "_tid").orderBy("_one"))
    return joined.withColumn("_order", order).where("_one = 0 or _order = 1").select("_row.*")
