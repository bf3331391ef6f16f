"""Exact n-gram Jaccard self-join of whole texts, up to its connected components.

Texts with equal shingle sets are one class. By the prefix rule, two sets with
a Jaccard similarity of t or more share one of their first
n - ceil(t * n) + 1 shingles in any common order. So all candidates meet in
tiles of (shingle, size band) over these prefixes, in three rounds:

1. In the tiles of the first few shingles of each prefix, each class meets one
   class of the tile. That is linear in the input and joins nearly all near
   copies, however large their groups are.
2. In all tiles that still hold several components, each class meets one
   other; a few likely pairs of any two components are tried.
3. In the tiles that hold several components even now, all pairs of classes
   across components meet whose sizes, places in the two orders and bit
   counts leave room for a link. Large tiles are split over many tasks.

A pair is compared by parity bitmaps of the two sets first, short ones within
the tiles and full ones after them: each set bit
of their exclusive or stands for at least one shingle in only one of them, so
the bit count bounds the overlap from above. Pairs within the bound are
decided by intersecting the sorted shingle arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.durable import release
from . import textkit as tk
from .bitmaps import bitmap_of, hash_bitmap, hash_bitmaps, probe

#: Words in a shingle, and the least similarity of a link in percent.
WIDTH, PERCENT = 5, 80
#: Shingles of each prefix whose tiles round 1 goes through, and pairs that it tries for a class at most; they affect speed only.
LEAD, FIRST_TRIES = 8, 3
#: The most frequent shingles come last in the order of the prefixes: so many at most, of those counted so often in one stretch of texts. They affect speed only.
HEAVY, HEAVY_LOCAL, HEAVY_TOTAL = 1 << 15, 4, 16
#: Shingles between two counts of a task.
STRETCH = 1 << 20
#: 64-bit words of the short bitmaps that go along with the shingles of the tiles.
WORDS = 6
#: Pairs of two components that round 2 tries at most; they affect speed only.
TRIES = 8
#: Holders of a shingle that one task of round 3 takes on one side.
TILE = 1000
#: Edges of a graph that is small enough for one task; it affects speed only.
FEW_EDGES = 200_000
_SHORT = tk.constants(WIDTH, 7)
_CLASS = tk.constants(3, 8)


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text.

    A text of fewer words than WIDTH has its whole sequence as one shingle,
    one without words none.
    """
    for i, _, data, offsets in tk.text_chunks(column):
        words, _, _, first = tk.words_of(data, offsets, tk.NOT_SPACE, tk.FOLDED)
        grams = tk.gram_hashes(words, WIDTH)
        for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            n = b - a
            if n >= WIDTH:
                yield i + k, np.unique(grams[a : b - WIDTH + 1])
            elif n:
                yield i + k, tk.mix(tk.gram_hashes(words[a:b], n) ^ _SHORT[n])
            else:
                yield i + k, np.empty(0, np.uint64)


def class_of(shingles: np.ndarray) -> tuple[int, int]:
    """A 128-bit name of a set, as two signed numbers."""
    n = np.uint64(len(shingles))
    total = np.array([tk.mix(shingles ^ _CLASS[0]).sum(dtype=np.uint64), shingles.sum(dtype=np.uint64)]) * np.array([1, _CLASS[2]], np.uint64) + n
    hi, lo = tk.mix(total ^ _CLASS[1]).view(np.int64).tolist()
    return hi, lo


def full_signature(shingles: np.ndarray) -> bytes:
    """Parities of a hashed bitmap; its size is a power of two, at least 64 bits and at least one a shingle."""
    n_bits = max(64, 1 << (len(shingles) - 1).bit_length())
    return np.packbits((np.bincount((shingles >> np.uint64(8) & np.uint64(n_bits - 1)).astype(np.int64), minlength=n_bits) & 1).astype(bool)).tobytes()


def may_link(n_a: int, sig_a: bytes, n_b: int, sig_b: bytes) -> bool:
    """Whether the bit counts of full signatures leave room for a link. The larger bitmap is folded onto the smaller one."""
    a, b = np.frombuffer(sig_a, np.uint8), np.frombuffer(sig_b, np.uint8)
    if len(a) > len(b):
        a, b = b, a
    b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    apart = int(np.bitwise_count(a ^ b).sum())
    return links((n_a + n_b - apart) // 2, n_a, n_b)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Parities of a hashed bitmap of WORDS 64-bit words, short enough to go along with each shingle of a tile."""
    n_bits = 64 * WORDS
    return np.packbits((np.bincount((shingles >> np.uint64(24) & np.uint64(n_bits - 1)).astype(np.int64), minlength=n_bits) & 1).astype(bool)).view(np.int64)


def links(common: int, n_a: int, n_b: int) -> bool:
    return 100 * common >= PERCENT * (n_a + n_b - common)


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


_SET_ROW = "n long, hi long, lo long, sig binary, token long, count long"


def _scan_sets(documents: DataFrame, id_type: str = "long") -> DataFrame:
    """A row (doc_id, n, hi, lo, sig) for each document, and rows (token, count) of shingles that recur within a stretch of a task's texts."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [{"long": pa.int64(), "string": pa.string()}[id_type], pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        names = ["doc_id", *(x.split()[0] for x in _SET_ROW.split(", "))]
        pending: list[np.ndarray] = []
        size, seen = 0, set()

        def heavy() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if pending:
                token, count = np.unique(np.concatenate(pending), return_counts=True)
                often = count >= HEAVY_LOCAL
                token, count = token[often].view(np.int64), count[often]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(token), k) for k in kinds[:5]), pa.array(token), pa.array(count)], names=names)
            pending.clear()
            seen.clear()
            size = 0

        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for row, shingles in shingle_sets(batch.column(1)):
                if not len(shingles):
                    rows.append((ids[row], 0, None, None, None))
                    continue
                name = class_of(shingles)
                rows.append((ids[row], len(shingles), *name, full_signature(shingles)))
                if name not in seen:
                    seen.add(name)
                    pending.append(shingles)
                    size += len(shingles)
                if size >= STRETCH:
                    yield from heavy()
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds[:5], strict=True)), *(pa.nulls(len(rows), k) for k in kinds[5:])], names=names)
        yield from heavy()

    return documents.select(F.col("doc_id").cast(id_type).alias("doc_id"), "text").mapInArrow(tk.lean(go), f"doc_id {id_type}, {_SET_ROW}")


def _of_classes(documents: DataFrame, classes: DataFrame, id_type: str, emit: Callable, schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """class, schema: emit(shingles) of one text of each of the classes (class, hi, lo, doc_id).

    Two bitmaps, of the doc_ids and of the names, spare most other texts the
    hashing and the way to the join by name.
    """
    context = documents.sparkSession.sparkContext
    own = classes.select("class", "hi", "lo", F.xxhash64("doc_id").alias("place"))
    places, heads = map(context.broadcast, hash_bitmaps(own, ["place", "hi"]))
    names = ["hi", "lo", *(x.split()[0] for x in schema.split(", "))]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, head = np.frombuffer(places.value, np.uint8), np.frombuffer(heads.value, np.uint8)
        for batch in batches:
            batch = batch.filter(pa.array(probe(near, batch.column(0).to_numpy(zero_copy_only=False))))
            rows = []
            for _, shingles in shingle_sets(batch.column(1)):
                if len(shingles):
                    hi, lo = class_of(shingles)
                    if probe(head, np.array([hi]))[0]:
                        rows.append((hi, lo, *emit(shingles)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int64(), *kinds], strict=True)], names=names)

    rows = documents.select(F.xxhash64(F.col("doc_id").cast(id_type)).alias("place"), "text").mapInArrow(tk.lean(go), f"hi long, lo long, {schema}")
    return rows.dropDuplicates(["hi", "lo"]).join(own.drop("place"), ["hi", "lo"]).select("class", *names[2:])


def _prefixes(documents: DataFrame, classes: DataFrame, heavy: list, id_type: str) -> DataFrame:
    """(class, n, tokens, bits): each class's first shingles, in order, and its signature; frequent shingles come last, the rest in the order of their hashes."""
    token = np.array([t for t, _ in heavy], np.int64).view(np.uint64)
    order = np.argsort(token)
    shared = documents.sparkSession.sparkContext.broadcast((token[order], np.array([c for _, c in heavy], np.int64)[order], bitmap_of(token, 20)))

    def emit(shingles: np.ndarray):
        token, count, bits = shared.value
        n = len(shingles)
        p = prefix_length(n)
        at = np.flatnonzero(probe(np.frombuffer(bits, np.uint8), shingles))
        if len(at) and len(token):
            place = np.minimum(np.searchsorted(token, shingles[at]), len(token) - 1)
            found = token[place] == shingles[at]
            if found.any():
                weight = np.zeros(n, np.int64)
                weight[at[found]] = count[place[found]]
                return n, shingles[np.lexsort((shingles, weight))[:p]].view(np.int64), signature(shingles)
        return n, shingles[:p].view(np.int64), signature(shingles)

    return _of_classes(documents, classes, id_type, emit, "n long, tokens array<long>, bits array<long>", [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())])


def _verify(documents: DataFrame, pairs: DataFrame, classes: DataFrame, id_type: str) -> DataFrame:
    """The pairs (a, b) of classes that are links: full bitmaps bound the overlap, then sorted arrays are intersected. pairs may have other columns.

    Only texts of classes within the bound are hashed again, each class's once.
    """
    sigs = classes.select("class", "n", "sig")
    both = (
        pairs.select("a", "b")
        .join(sigs.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a")), "a")
        .join(sigs.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b")), "b")
        .select("a", "b", "n_a", "n_b", "sig_a", "sig_b")
    )

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = [may_link(x, sx, y, sy) for x, y, sx, sy in zip(n_a, n_b, batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    near = tk.durable(both.mapInArrow(tk.lean(bound), "a long, b long"))
    wanted = near.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    ends = tk.durable(classes.select("class", "hi", "lo", "doc_id").join(wanted, "class"))
    release(documents.sparkSession)
    sets = tk.durable(_of_classes(documents, ends, id_type, lambda shingles: (shingles.tobytes(),), "shingles binary", [pa.binary()]))
    arrays = (
        near.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("of_a")), "a")
        .join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("of_b")), "b")
        .select("a", "b", "of_a", "of_b")
    )

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(links(common, len(x), len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return tk.durable(arrays.mapInArrow(tk.lean(exact), "a long, b long"))


def _least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b), and the least node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        now, least = label.copy(), np.minimum(label[x], label[y])
        for end in (x, y, label[x], label[y]):
            np.minimum.at(now, end, least)
        now = now[now]
        if (now == label).all():
            return nodes, nodes[label]
        label = now


def _few_components(edges: DataFrame) -> DataFrame:
    """components() of FEW_EDGES at most, by one task: the rounds over such a graph are many jobs with next to nothing in each task, and the driver holds something of every task."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [[column.to_numpy(zero_copy_only=False) for column in batch.columns] for batch in batches]
        if ends:
            found = _least_reached(*map(np.concatenate, zip(*ends, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["node", "component"])

    return tk.durable(edges.coalesce(1).mapInArrow(tk.lean(go), "node long, component long"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of the edges (a, b) reaches.

    Labels spread over the edges and then over themselves (a label takes its
    own node's label), so long chains need few rounds. Only FEW_EDGES at most
    are gone through by one task.
    """
    ends = tk.durable(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    if ends.count() <= FEW_EDGES:
        return _few_components(ends)
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")
    both = tk.durable(ends.select(ways).select("x.a", "x.b").distinct())
    labels = tk.durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        spread = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        own = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        now = tk.durable(spread.join(own, "component").select("node", "old", F.least("component", "further").alias("component")))
        labels = now.select("node", "component")
        release(edges.sparkSession)
        if now.where("old <> component").isEmpty():
            return labels


def _band(n: Column, shift: float = 0) -> Column:
    """Bands in which the largest set is at most 100 / PERCENT times the smallest; a link's sets lie in one band or in neighbours."""
    return F.floor(F.log(n.cast("double")) / float(np.log(100 / PERCENT)) + (shift + 1e-9)).cast("int")


def _tile(token: str) -> list[Column]:
    """Keys (token, band, shifted) of tiles with one meeting: by the shingle, the bands lie as they are or shifted by half a band, so that groups on a bound between two bands meet as well."""
    shifted = F.pmod(F.xxhash64(token, F.lit(1)), F.lit(2))
    return [F.col(token).alias("token"), F.when(shifted == 0, _band(F.col("n"))).otherwise(_band(F.col("n"), 0.5)).alias("band")]


def _met_pivots(rows: DataFrame, orders: int, more: list[str]) -> DataFrame:
    """Each row (token, class, n, bits, more) with one row of its tile, b, if the bit counts leave room for a link: a, b, n_a, n_b, apart, try, and more of both (_a, _b).

    The one is the first in one of so many orders of the classes, which one
    hangs on the shingle (try); so the classes of a group meet few others.
    """
    tried = F.pmod(F.xxhash64("token"), F.lit(orders)).cast("int")
    own = ["class", "n", "bits", *more]
    tiled = rows.select(*_tile("token"), *own)
    first = F.min(F.struct(F.xxhash64(tried, "class").alias("order"), *own)).alias("p")
    pivots = tiled.groupBy("token", "band").agg(first, F.count(F.lit(1)).alias("held")).where("held > 1")
    pivots = pivots.select("token", "band", F.col("p.class").alias("b"), F.col("p.n").alias("n_b"), *(F.col(f"p.{c}").alias(f"{c}_b") for c in more), *(F.col("p.bits")[i].alias(f"v{i}") for i in range(WORDS)))
    words = [F.col("bits")[i].alias(f"w{i}") for i in range(WORDS)]
    met = tiled.select("token", "band", F.col("class").alias("a"), F.col("n").alias("n_a"), *(F.col(c).alias(f"{c}_a") for c in more), *words).join(pivots, ["token", "band"]).where((F.col("a") != F.col("b")) & _bits_leave_room())
    return met.select("a", "b", "n_a", "n_b", *(f"{c}_{x}" for c in more for x in "ab"), (_bits_apart() / (F.col("n_a") + F.col("n_b"))).alias("apart"), tried.alias("try"))


def _lead_pairs(held: DataFrame) -> DataFrame:
    """Round 1: each class with one class of the tiles of its first shingles; of each order the likeliest pair."""
    rows = held.select("class", "n", "bits", F.explode(F.slice("tokens", 1, LEAD)).alias("token"))
    met = _met_pivots(rows, FIRST_TRIES, [])
    best = met.groupBy("a", "try").agg(F.min_by("b", F.struct("apart", "b")).alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _bits_apart() -> Column:
    return sum((F.bit_count(F.col(f"w{i}").bitwiseXOR(F.col(f"v{i}"))) for i in range(1, WORDS)), F.bit_count(F.col("w0").bitwiseXOR(F.col("v0"))))


def _bits_leave_room() -> Column:
    """Whether the short signatures w and v of sets of n_a and n_b shingles leave room for a link: 9 times the shingles in only one set are at most n_a + n_b."""
    return _bits_apart() * (100 + PERCENT) <= (F.col("n_a") + F.col("n_b")) * (100 - PERCENT)


def _cross_pairs(holders: DataFrame) -> DataFrame:
    """Round 3: pairs across components of classes that hold a common token and may be links; holders: token, held (by how many), place, class, n, component, bits.

    All common shingles come at or after the first common one in both orders,
    so for that one the smaller rest bounds the overlap; at other tokens the
    pair may be passed over. A token of many holders is split: its left side
    over several salts, its right side to each of them.
    """
    salts = F.ceil(F.col("held") / TILE).cast("int")
    words = [F.col("bits")[i].alias(f"w{i}") for i in range(WORDS)]
    left = holders.select("token", F.pmod(F.xxhash64("class"), salts).cast("int").alias("salt"), _band(F.col("n")).alias("band"), F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("component").alias("c_a"), F.col("place").alias("p_a"), *words)
    copies = holders.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    both_bands = F.explode(F.array(_band(F.col("n")), _band(F.col("n")) - 1)).alias("band")
    right = copies.select("token", "salt", both_bands, F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("component").alias("c_b"), F.col("place").alias("p_b"), *(F.col("bits")[i].alias(f"v{i}") for i in range(WORDS)))
    total = F.col("n_a") + F.col("n_b")
    sizes = (F.col("n_a") * 100 >= F.col("n_b") * PERCENT) & ((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b"))))
    places = F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b")) * (100 + PERCENT) >= total * PERCENT
    return left.join(right, ["token", "salt", "band"]).where((F.col("c_a") != F.col("c_b")) & sizes & places & _bits_leave_room()).select("a", "b", "c_a", "c_b").distinct()


def _pivot_pairs(holders: DataFrame) -> DataFrame:
    """Round 2: for each pair of components that meet so, a few pairs of classes whose bit counts leave most room for a link: each holder meets one holder of its tile.

    That is linear in the holders. It merges most of what round 1 left apart
    in large groups, so that few of their pairs meet in _cross_pairs().
    """
    met = _met_pivots(holders, TRIES, ["component"]).where("component_a <> component_b")
    room = F.struct("apart", "a", "b", F.col("component_a").alias("c_a"), F.col("component_b").alias("c_b"))
    best = met.groupBy(F.least("component_a", "component_b").alias("low"), F.greatest("component_a", "component_b").alias("high"), "try").agg(F.min(room).alias("best"))
    return best.select("best.a", "best.b", "best.c_a", "best.c_b").distinct()


def _between(linked: DataFrame, pairs: DataFrame) -> DataFrame:
    """The links (a, b) of classes as links of their components."""
    return linked.join(pairs, ["a", "b"]).select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))


def _renamed(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """rows with the components (node) that were merged under their new names."""
    names = merged.select(F.col("node").alias("component"), F.col("component").alias("_name"))
    return rows.join(names, "component", "left").withColumn("component", F.coalesce("_name", "component")).drop("_name")


def _open_tokens(rows: DataFrame) -> DataFrame:
    """token, held: the tokens of rows (token, component) that several components hold, and how many rows have them."""
    shared = rows.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("held"))
    return shared.where("low <> high").select("token", "held")


def linked_documents(documents: DataFrame, id_type: str = "long") -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Two documents link when 100 * common >= 80 * union over their distinct
    five-word shingles (words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased).
    component_id is the smallest doc_id reachable by links; without words
    (null, empty or blank text) a document links with nothing. Repeated rows
    each get their row; null doc_ids count only where a component has no
    other. Columns other than doc_id and text are not read. id_type is long
    or string, and also the order of the ids.
    """
    scanned = tk.scanned(_scan_sets(documents, id_type))
    docs = scanned.where("n is not null").select("doc_id", "n", "hi", "lo")
    by_name = scanned.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = tk.durable(by_name.withColumn("class", F.monotonically_increasing_id()))  # kept, so the numbers stay
    tokens = scanned.where("token is not null").groupBy("token").agg(F.sum("count").alias("count")).where(F.col("count") >= HEAVY_TOTAL)
    heavy = tokens.orderBy(F.desc("count"), "token").limit(HEAVY).collect()
    prefixes = tk.scanned(_prefixes(documents, classes, heavy, id_type))
    release(documents.sparkSession)

    first = components(_verify(documents, _lead_pairs(prefixes), classes, id_type))
    release(documents.sparkSession)
    held = prefixes.join(first.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class")).select("class", "n", "component", "bits", "tokens")
    open_tokens = tk.durable(_open_tokens(held.select(F.explode("tokens").alias("token"), "component")).select("token"))
    bitmap = documents.sparkSession.sparkContext.broadcast(hash_bitmap(open_tokens, "token"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            column = batch.column(4)
            token = column.flatten().to_numpy(zero_copy_only=False)
            size = np.diff(column.offsets.to_numpy())
            owner, place = np.repeat(np.arange(batch.num_rows), size), np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
            at = np.flatnonzero(probe(bits, token))
            owner = pa.array(owner[at])
            yield pa.RecordBatch.from_arrays([pa.array(token[at]), pa.array(place[at]), *(batch.column(c).take(owner) for c in range(4))], names=["token", "place", "class", "n", "component", "bits"])

    # tokens that only the bitmap lets through are held within one component, so they make no pair
    holders = tk.durable(held.mapInArrow(tk.lean(pick), "token long, place long, class long, n long, component long, bits array<long>"))
    bitmap.destroy()
    release(documents.sparkSession)
    best = tk.durable(_pivot_pairs(holders))
    merged = components(_between(_verify(documents, best, classes, id_type), best))
    release(documents.sparkSession)
    still = _renamed(holders, merged)
    cross = tk.durable(_cross_pairs(still.join(_open_tokens(still), "token")))
    release(documents.sparkSession)
    last = components(_between(_verify(documents, cross, classes, id_type), cross))
    release(documents.sparkSession)
    named = classes.join(first.withColumnRenamed("node", "class"), "class", "left").select("class", "hi", "lo", "doc_id", F.coalesce("component", "class").alias("component"))
    named = tk.durable(_renamed(_renamed(named, merged), last))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    answer = named.join(least, "component").select("hi", "lo", "component_id")
    return docs.join(answer, ["hi", "lo"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_documents(tk.read(spark, sf_dir, "documents"))


SQL = {
    "op10_ngram_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT r, array_to_string(ws[i:i + {WIDTH - 1}], ' ') AS g FROM (SELECT r, ws, unnest(range(1, greatest(2, len(ws) - {WIDTH - 2}))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
reach(r, t) AS (SELECT r, r FROM d UNION SELECT reach.r, e.b FROM reach JOIN e ON e.a = reach.t)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (r)
  JOIN (SELECT reach.r, min(x.doc_id) AS component_id FROM reach JOIN d x ON x.r = reach.t GROUP BY reach.r) m USING (r)
"""
}
QUERIES = {"op10_ngram_jaccard_join": op10_ngram_jaccard_join}
