"""Exact components of the Jaccard join of documents' word shingles by prefix index lists, with connectivity skipping.

Two relations between sets save work. Inside an index list, entries lie in blocks by size and carry their position;
whole blocks are skipped by size, and joined entries too far back to leave the overlap a link needs are left out. And
connectivity takes the place of answers derived from a similar set's: each round compares the sets of a list with a few
of its members, and sets that are then known to be connected are not compared again, so a list of n near copies costs n
comparisons and not n squared. The last round compares all that is left, so no link between components is lost; links
inside a component are not all established, and no pairs are returned.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lexicue.llm.common import materialized
from lexicue.llm.components import components, labels

#: Cells of the count sketch that puts frequent shingles last; only the order depends on it, never the result.
CELLS = 1 << 21
#: Bits of the filter that picks the texts to compare; a false hit only sends a text for nothing.
FILTER_BITS = 1 << 24
#: Members of a list that its other sets are compared with, by round before the last: few for all sets, then many for
#: those that are still outside. Most near copies find their group by then, so the last round has few to compare.
LEADERS = (8, 64)
#: Distinct words a worker keeps hashes of: the first it meets, which has the common ones.
WORDS = 400_000
_MIX = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word)
        if len(self) < WORDS and len(word) < 64:
            self[word] = h
        return h


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles; A-Z in lower case, ASCII blanks between words."""

    def __init__(self, width: int):
        self.width, self.hashes = width, _Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        n = len(words) - self.width + 1
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        if n < 1:  # fewer words than a shingle: the whole sequence is one
            h, n, width = np.append(h, np.uint64(len(words))), 1, len(words) + 1
        else:
            width = self.width
        x = np.zeros(n, np.uint64)
        for i in range(width):
            x = (x ^ (x >> np.uint64(29))) * np.uint64(_MIX[i % 5]) + h[i : i + n]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(_MIX[1])
        return np.unique(x ^ (x >> np.uint64(33)))


def _cell(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(40)).astype(np.int64) & (CELLS - 1)


def _name(x: np.ndarray) -> int:
    """A set's own 64-bit number: equal for equal sets."""
    import hashlib

    return int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True)


def parities(x: np.ndarray) -> bytes:
    """One bit per cell of a set's hashes: whether an odd number falls there; at least two cells for each.

    The bits in which two sets differ are no more than the elements in which they differ.
    """
    cells = max(256, 1 << int(2 * len(x) - 1).bit_length())
    odd = np.bincount((x & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def most_common(a: bytes, b: bytes, na: int, nb: int) -> int:
    """The most elements that two sets of these parities and sizes can share. The longer row is folded to the shorter."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return min(na, nb, (na + nb - int(np.bitwise_count(x ^ y).sum())) // 2)


def describe(docs: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """Every row's key, id, set size, set number and parities, and the sketch of how often each cell's shingles occur.

    Each task sends one sketch, in blocks that are added up by Spark; the driver gets CELLS numbers.
    """
    block = 1 << 15

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, cells = Shingler(width), np.zeros(CELLS, np.uint32)
        names = ["_key", "doc_id", "n", "rec", "bits", "block", "counts"]
        kind = None
        for b in batches:
            kind = b.schema.field(1).type
            sizes, recs, bits = [], [], []
            for t in b.column(2).to_pylist():
                x = shingle(t)
                sizes.append(len(x))
                recs.append(_name(x) if len(x) else None)
                bits.append(parities(x) if len(x) else None)
                np.add.at(cells, _cell(x), 1)
            none = pa.nulls(len(sizes))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(recs, pa.int64()), pa.array(bits, pa.binary()),
                 none.cast(pa.int32()), none.cast(pa.binary())],
                names=names,
            )
        if kind is not None:
            used = [i for i in range(CELLS // block) if cells[i * block : (i + 1) * block].any()]
            none = pa.nulls(len(used))
            yield pa.RecordBatch.from_arrays(
                [none.cast(pa.int64()), none.cast(kind), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), pa.array(used, pa.int32()),
                 pa.array([zlib.compress(cells[i * block : (i + 1) * block].tobytes(), 1) for i in used], pa.binary())],
                names=names,
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, c in zip(*(x.to_pylist() for x in b.columns)):
                sums.setdefault(i, np.zeros(block, np.uint64))
                sums[i] += np.frombuffer(zlib.decompress(c), np.uint32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], names=["block", "counts"]
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = materialized(docs.select("_key", "doc_id", "text").mapInArrow(
        scan, f"_key long, doc_id {kind}, n long, rec long, bits binary, block int, counts binary"
    ))
    parts = out.where("block is not null").select("block", "counts").repartition("block").mapInArrow(add, "block int, counts binary")
    sketch = np.zeros(CELLS, np.uint64)
    for r in parts.collect():
        sketch[r["block"] * block : (r["block"] + 1) * block] = np.frombuffer(zlib.decompress(bytes(r["counts"])), np.uint64)
    return out.where("block is null").drop("block", "counts"), sketch


def prefixes(docs: DataFrame, sketch: np.ndarray, width: int, percent: int) -> DataFrame:
    """Index entries (token, rec, n, pos): the first shingles of each set in an order that puts frequent ones last.

    A link of the least overlap must share one of a set's first n - ceil(n * percent / 100) + 1. What stands out of
    the sketch's noise counts as frequent. A task sends a set that it meets again only once.
    """
    mean = float(sketch.mean())
    level = np.where(sketch > mean + 6 * mean**0.5 + 2, sketch, 0).astype(np.uint64)
    order = docs.sparkSession.sparkContext.broadcast(level)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, frequent, sent = Shingler(width), order.value, set()
        for whole in batches:
            for at in range(0, len(whole), 1024):
                tokens, recs, sizes, places = [], [], [], []
                for t in whole.column(0).slice(at, 1024).to_pylist():
                    x = shingle(t)
                    rec = _name(x) if len(x) else None
                    if rec is None or rec in sent:
                        continue
                    if len(sent) > 1_000_000:
                        sent.clear()
                    sent.add(rec)
                    n = len(x)
                    k = n + (-n * percent // 100) + 1
                    rank = frequent[_cell(x)]
                    # sets are sorted, so a stable sort by frequency leaves ties in the order of their hash
                    x = x[np.argsort(rank, kind="stable")[:k]] if rank.any() else x[:k]
                    tokens.append(x)
                    recs.append(np.full(k, rec, np.int64))
                    sizes.append(np.full(k, n, np.int32))
                    places.append(np.arange(k, dtype=np.int32))
                if tokens:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(c)) for c in ([x.view(np.int64) for x in tokens], recs, sizes, places)],
                        names=["token", "rec", "n", "pos"],
                    )

    return docs.select("text").mapInArrow(scan, "token long, rec long, n int, pos int")


def index_lists(entries: DataFrame, percent: int) -> DataFrame:
    """The lists of two sets or more, stored; ``block`` groups sizes so that links lie in equal or neighbouring blocks."""
    own = W.partitionBy("token")
    shared = entries.repartition("token").withColumns({"_a": F.min("rec").over(own), "_b": F.max("rec").over(own)}).where("_a <> _b")
    size = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(-np.log(percent / 100)))).cast("int")
    return materialized(shared.select("token", "rec", "n", "pos").distinct().withColumn("block", size))


def _candidates(leaders: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of sets from different components that meet in a list and may link.

    A leader looks at its own and the two neighbouring blocks of the list. The overlap can be no more than what is
    left from the first common shingle on, in either set.
    """
    probe = leaders.select(
        F.col("token").alias("t"), F.col("rec").alias("r"), F.col("n").alias("rn"), F.col("pos").alias("rp"), F.col("comp").alias("rc"),
        F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("rb"),
    )
    needed = F.ceil(percent * (F.col("n") + F.col("rn")).cast("long") / (100 + percent))
    on = (
        (F.col("token") == F.col("t")) & (F.col("block") == F.col("rb")) & (F.col("comp") != F.col("rc"))
        & (100 * F.least("n", "rn") >= percent * F.greatest("n", "rn"))
        & (F.least(F.col("n") - F.col("pos"), F.col("rn") - F.col("rp")) >= needed)
    )
    return lists.join(probe, on).select(F.least("rec", "r").alias("a"), F.greatest("rec", "r").alias("b")).distinct()


def _texts(docs: DataFrame, reps: DataFrame, recs: DataFrame) -> DataFrame:
    """(rec, text) of the wanted sets: a filter of fixed size first, then an exact join."""
    wanted = reps.join(recs, "rec")
    bit = F.pmod("_key", F.lit(FILTER_BITS))
    words = wanted.groupBy(F.shiftright(bit, 6).cast("int").alias("i")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))).alias("w")
    ).collect()
    table = np.zeros(FILTER_BITS >> 6, np.uint64)
    for r in words:
        table[r["i"]] = r["w"] & 0xFFFFFFFFFFFFFFFF
    bits = docs.sparkSession.sparkContext.broadcast(table)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(0).to_numpy() % FILTER_BITS
            hit = (bits.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            yield b.filter(pa.array(hit.astype(bool)))

    found = docs.select("_key", "text").mapInArrow(scan, "_key long, text string")
    return found.join(wanted.select("_key", "rec"), "_key").select("rec", "text").dropDuplicates(["rec"])


def _possible(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs that may link by their parities, a small fraction of the texts' size; no pair that links is lost."""
    one = marks.select(F.col("rec").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    two = marks.select(F.col("rec").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, xa, nb, xb in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5))):
                common = most_common(xa, xb, na, nb)
                keep.append(100 * common >= percent * (na + nb - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "xa", "nb", "xb")
    return materialized(both.mapInArrow(test, "a long, b long"))


def _links(docs: DataFrame, reps: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough, counted on the whole texts; stored."""
    recs = pairs.select(F.explode(F.array("a", "b")).alias("rec")).distinct()
    texts = materialized(_texts(docs, reps, recs))
    one = texts.select(F.col("rec").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("rec").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(one, "a").join(two, "b").sortWithinPartitions("b").select("a", "b", "ta", "tb")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, last, known = Shingler(width), None, None
        for batch in batches:
            keep = []
            for b, ta, tb in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if b != last or known is None:
                    last, known = b, shingle(tb)
                x = shingle(ta)
                common = len(np.intersect1d(x, known, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(known) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return materialized(both.mapInArrow(verify, "a long, b long"))


def _labelled(lists: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return lists.withColumn("comp", F.col("rec"))
    return lists.join(roots.withColumnRenamed("node", "rec"), "rec", "left").withColumn("comp", F.coalesce("root", "rec")).drop("root")


def link_components(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Set rows (key, id, size, set number, parities) and (node, root) of the sets that have a link.

    ``docs`` has _key, doc_id and text.
    """
    sets, sketch = describe(docs, width)
    reps = sets.where("rec is not null").groupBy("rec").agg(F.min("_key").alias("_key"))
    marks = materialized(sets.where("rec is not null").select("rec", "n", "bits").dropDuplicates(["rec"]))
    lists = index_lists(prefixes(docs, sketch, width, percent), percent)
    links, roots, tried = None, None, None
    for k in range(len(LEADERS) + 1):
        named = materialized(_labelled(lists, roots)) if k else _labelled(lists, None)
        if k:
            # a list's largest component is not compared with itself; what is outside looks at the list
            per = named.groupBy("token", "comp").agg(F.count("*").alias("c"))
            main = per.groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("_main"), F.count("*").alias("_comps"), F.sum("c").alias("_len"))
            # a list of no more sets than these has been compared whole
            main = main.where((F.col("_comps") > 1) & (F.col("_len") > LEADERS[k - 1] + 1))
            outside = named.join(main, "token").where("comp <> _main").drop("_main", "_comps")
            work = outside.agg(F.sum("_len")).first()[0] or 0
            if not work:
                break
            final = k == len(LEADERS) or work <= 4 * named.count()
        else:
            final = False
        if k and final:
            pairs = _candidates(outside, named, percent)
        else:
            pick = W.partitionBy("token").orderBy(F.xxhash64("rec", F.lit(k)), "rec")
            leaders = named.withColumn("_i", F.row_number().over(pick)).where(F.col("_i") <= LEADERS[k])
            pairs = _candidates(leaders, outside if k else named, percent)
        if tried is not None:  # what was compared in an earlier round has its answer
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialized(pairs)
        tried = pairs if tried is None else tried.union(pairs)
        found = _links(docs, reps, _possible(pairs, marks, percent), width, percent)
        links = found if links is None else links.union(found)
        if k and final:
            break
        # sets of one label are connected; what labels leave apart is only compared again
        roots = materialized(labels(links).withColumnRenamed("label", "root"))
    roots = materialized(components(links))
    return sets, roots


def duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """Per row: id, set size and the smallest id reachable by links; with it ``_key``, the hash of id and text.

    Texts without a word, and null ones, have an empty set and are linked with nothing: their component is their own
    id. Equal sets link. Null ids are never the smallest unless a component has no other; repeated rows are linked
    like other equal texts. An empty table gives no rows.
    """
    rows = docs.select(
        F.xxhash64(F.col(key), F.col(text)).alias("_key"), F.col(key).alias("doc_id"), F.col(text).alias("text")
    )
    sets, roots = link_components(rows, width, percent)
    least = sets.where("rec is not null").groupBy("rec").agg(F.min("doc_id").alias("_least"))
    named = least.join(roots.withColumnRenamed("node", "rec"), "rec", "left").withColumn("root", F.coalesce("root", "rec"))
    smallest = named.groupBy("root").agg(F.min("_least").alias("component_id"))
    by_rec = named.join(smallest, "root").select("rec", "component_id")
    linked = sets.where("rec is not null").join(by_rec, "rec").select("_key", "doc_id", "n", "component_id")
    alone = sets.where("rec is null").select("_key", "doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumnRenamed("n", "n_shingles")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` less all but one of each component: the row of the smallest id stays.

    Rows that share that id and differ in text are told apart by their hash; of wholly equal rows one stays.
    Rows with an empty set all stay.
    """
    found = duplicates(docs, key, text, width, percent)
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "_key")
    keep = found.where("n_shingles > 0").groupBy("component_id").agg(F.min_by("_key", first).alias("_keep")).select("_keep")
    rows = docs.select(
        F.struct("*").alias("_doc"), F.xxhash64(F.col(key), F.col(text)).alias("_key"),
        F.coalesce(F.col(text), F.lit("")).rlike(r"^[\x20\x09-\x0D]*$").alias("_blank"),
    )
    mine = rows.where(~F.col("_blank")).join(keep, F.col("_key") == F.col("_keep"), "left_semi")
    one = mine.withColumn("_copy", F.row_number().over(W.partitionBy("_key").orderBy(F.lit(1)))).where("_copy = 1")
    return one.select("_doc.*").union(rows.where("_blank").select("_doc.*"))
