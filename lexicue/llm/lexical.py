"""Ranked lexical search by scanning the documents with an Aho-Corasick automaton of all the items' terms.

No index of the documents is built. Items go in blocks of bounded size; a block's terms, each with a boundary on either
side, are one automaton that is broadcast. One pass over the texts counts every term of the block; a second one over these
counts turns the automaton's outputs into scores of items, of which every task keeps the best.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from lexicue.llm.common import materialized

#: Fixed: characters of a term, as a Java pattern; only A-Z lose their case.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of terms in one automaton, counted per item: about 20 MB in a worker for each million.
BLOCK = 2_000_000
#: Documents are dealt to so many parts in which the best are found before they meet per item.
PARTS = 64
#: UTF-8 bytes: what is no part of a term becomes a blank, A-Z become small.
_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


def terms_of(text) -> F.Column:
    """Distinct terms of a text column."""
    return F.array_distinct(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"({TERM})"), F.lit(1)))


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, term, block): the distinct terms of each item; rows of one item count together."""
    pairs = items.select(F.col(item).alias("item"), F.explode(terms_of(F.col(text))).alias("term")).distinct()
    chars = pairs.agg(F.coalesce(F.sum(F.octet_length("term") + 1), F.lit(0))).first()[0]
    blocks = -(-chars // BLOCK)
    return materialized(pairs.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(max(blocks, 1))).cast("int")))


class Automaton:
    """Finds terms in texts; sent to the workers once."""

    def __init__(self, terms: list[str]):
        import ahocorasick

        self.found = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            self.found.add_word(f" {t.encode().decode('latin-1')} ", i)
        self.found.make_automaton()

    def count(self, text: str) -> tuple[int, Counter]:
        """Terms of the text, repeats included, and how often each known one occurs."""
        raw = text.encode("utf-8", "surrogatepass").translate(_BYTES)
        # one byte is one character here, so that the automaton sees bytes
        return len(raw.split()), Counter(i for _, i in self.found.iter(f" {raw.decode('latin-1')} "))


def scan(docs: DataFrame, terms: list[str], key: str, text: str) -> DataFrame:
    """(doc_id, n, terms, tf) of every row: its number of terms, and the numbers of those in ``terms`` with their counts."""
    sent = docs.sparkSession.sparkContext.broadcast(Automaton(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = sent.value
        for b in batches:
            counted = [automaton.count(t.as_py() or "") for t in b.column(1)]
            ends = np.cumsum([0, *(len(c) for _, c in counted)]).astype(np.int32)
            lists = [
                pa.ListArray.from_arrays(pa.array(ends), pa.array([x for _, c in counted for x in part(c)], pa.int32()))
                for part in (Counter.keys, Counter.values)
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in counted], pa.int64()), *lists], names=["doc_id", "n", "terms", "tf"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


class Best:
    """The best documents of each item so far, as arrays sorted by item, score and document."""

    def __init__(self, keep: int):
        self.keep, self.rows = keep, [np.zeros(0, np.int64)] * 4

    def add(self, item, score, none, doc) -> None:
        """``none`` is 1 for a document without an id; such come last among equal scores."""
        rows = [np.concatenate(x) for x in zip(self.rows, (item, score, none, doc))]
        order = np.lexsort((rows[3], rows[2], -rows[1], rows[0]))
        item = rows[0][order]
        first = np.searchsorted(item, item)
        self.rows = [x[order][np.arange(len(item)) - first < self.keep] for x in rows]


def best_of(counts: DataFrame, total: int, length: int, weight: np.ndarray, start: np.ndarray, item: np.ndarray, keep: int) -> DataFrame:
    """(item number, score, doc_id) of each task's ``keep`` best documents per item.

    Term t stands in the items ``item[start[t]:start[t + 1]]``. All in 64-bit integers.
    """
    sent = counts.sparkSession.sparkContext.broadcast((weight, start, item))
    items = int(item.max()) + 1 if len(item) else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, start, item = sent.value
        best = Best(keep)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                n, sizes = b.column(1).to_numpy(), np.diff(b.column(2).offsets.to_numpy())
                term, tf = (b.column(i).flatten().to_numpy().astype(np.int64) for i in (2, 3))
                doc = np.repeat(np.arange(b.num_rows), sizes)
                m = 50 + (50 * n * total) // length if length else n
                gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
                fan = start[term + 1] - start[term]
                of = np.repeat(np.arange(len(term)), fan)
                within = np.arange(len(of)) - np.repeat(np.cumsum(fan) - fan, fan)
                pair = item[start[term][of] + within] + items * doc[of]
                order = np.argsort(pair, kind="stable")
                pair, gain = pair[order], gain[of][order]
                if not len(pair):
                    continue
                first = np.flatnonzero(np.diff(pair, prepend=-1))
                score, pair = np.add.reduceat(gain, first), pair[first]
                good = score > 0
                score, pair = score[good], pair[good]
                none = b.column(0).is_null().to_numpy(zero_copy_only=False)
                ids = b.column(0).fill_null(0).to_numpy()
                best.add(pair % items, score, none[pair // items].astype(np.int64), ids[pair // items])
        i, score, none, ids = best.rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(i), pa.array(score), pa.array(ids, pa.int64(), mask=none.astype(bool))], names=["number", "score", "doc_id"]
        )

    return counts.select("doc_id", "n", "terms", "tf").mapInArrow(run, "number long, score long, doc_id long")


def first_of(df: DataFrame, keys: list[str], keep: int, name: str) -> DataFrame:
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= keep)


def search(
    docs: DataFrame, items: DataFrame, keep: int = 50, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Each item's ``keep`` best documents with a score above 0: item, rank from 1, doc_id, score.

    A document with no term, null and blank texts included, is not counted and never found. Repeated rows are documents of their
    own. Equal scores go by ascending id, null ids last; rows of equal id and score stand in any order. Rows of one item
    are one item with the terms of all of them; null is an item like others; an item without terms has no
    rows. Empty tables give no rows. Other columns are not read. Ids of documents are integers.
    """
    spark = docs.sparkSession
    kind = items.schema[item].dataType.simpleString()
    pairs = item_terms(items, item, item_text)
    out = spark.createDataFrame([], f"`{item}` {kind}, rank int, doc_id long, score long")
    blocks = [r[0] for r in pairs.select("block").distinct().orderBy("block").collect()]
    for block in blocks:
        # at most BLOCK characters on average, and one item at least
        rows = pairs.where(F.col("block") == block).groupBy("item").agg(F.collect_set("term")).collect()
        terms = sorted({t for _, ts in rows for t in ts})
        number = {t: i for i, t in enumerate(terms)}
        uses = sorted((number[t], i) for i, (_, ts) in enumerate(rows) for t in ts)
        term, owner = np.array(uses, np.int64).reshape(-1, 2).T
        start = np.searchsorted(term, np.arange(len(terms) + 1))
        counts = materialized(scan(docs, terms, key, text))
        total, length = counts.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        ratio = (F.lit(2.0) * total + 2) / (2 * F.col("df") + 1)
        weight = np.zeros(len(terms), np.int64)
        for r in df.select("term", F.floor(1000 * F.log(ratio)).alias("w")).collect():
            weight[r["term"]] = r["w"]
        found = best_of(counts, total, length, weight, start, owner, keep)
        parted = first_of(found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))), ["number", "part"], keep, "_rank")
        best = first_of(parted.drop("part", "_rank"), ["number"], keep, "rank")
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"number long, `{item}` {kind}")
        out = out.union(materialized(best.join(names, "number").select(item, "rank", "doc_id", "score")))
    return out


#: DuckDB over ``documents`` and ``benchmark`` for the rows of :func:`search` with ``keep`` 50.
SQL = r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, g GROUP BY term, docs),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN d USING (doc_id), g GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50"""
