"""Scoring texts with a gated recurrent language model that is trained here.

Token counts cover every training text. The most frequent words are symbols of the model; the others share slots by
their ending, and within a slot a word has its smoothed share of the counts. The network is trained on every training
text once: texts are dealt by hash to rounds and replicas, replicas of a bounded part each train side by side, and are
averaged after each round by the symbols they saw.
"""

from __future__ import annotations

import itertools
import math
import pickle
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from lexicue.llm import gru
from lexicue.llm.common import materialized

#: Words every worker knows by heart, with their counts; a bound that does not grow. Rarer ones are joined.
KNOWN = 1 << 17
#: Words with a symbol of their own (with the end of text), and slots for the others.
SYMBOLS, SLOTS = 4096, 256
#: Rounds of averaging, and the symbols that a replica of a round trains on, about.
ROUNDS, PART = 3, 2_000_000
#: Distinct words a task counts before it hands them on.
HELD = 300_000
#: Rows and bytes of text whose words are taken at once (one text at least).
ROWS, BYTES = 4096, 1 << 23
END = ""


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ROWS rows and BYTES bytes in column ``text``, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        most = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES, side="right"))
        to = min(max(most, at + 1), at + ROWS)
        yield batch.slice(at, to - at)
        at = to


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts with A-Z in lower case, END after each text's last, and where each text starts and the last ends.

    The only blanks are the six of ASCII. A blank that is added to a text with words splits off one more, empty word.
    """
    texts = pc.ascii_ltrim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    lists = pc.ascii_split_whitespace(pc.binary_join_element_wise(texts, pc.if_else(pc.equal(texts, ""), "", " "), ""))
    return lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))])


def slot(word: bytes) -> int:
    return SYMBOLS + zlib.crc32(word[-3:]) % SLOTS


#: crc32 of each single byte, without its first and last inversion.
_CRC = np.array([zlib.crc32(bytes([i]), 0xFFFFFFFF) ^ 0xFFFFFFFF for i in range(256)], np.uint32)


def slots_of(words: pa.Array) -> np.ndarray:
    """``slot`` of each word."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    sizes, crc = np.diff(offsets), np.full(len(words), 0xFFFFFFFF, np.uint32)
    for back in (3, 2, 1):
        has = np.flatnonzero(sizes >= back)
        x = crc[has]
        crc[has] = _CRC[(x ^ data[offsets[1:][has] - back]) & 255] ^ (x >> 8)
    return SYMBOLS + (~crc % SLOTS).astype(np.int64)


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, slot, n) over all texts; the end of text is the empty word."""

    def merged(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            for part in slices(b, 0):
                found = pc.value_counts(words_of(part.column(0))[0])
                held.append(pa.table({"word": found.field(0), "n": found.field(1)}))
                if sum(map(len, held)) > HELD:
                    held = [merged(held)]
                    if len(held[0]) > HELD // 2:
                        yield from held.pop().to_batches()
        if held:
            yield from merged(held).to_batches()

    counts = docs.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    crc = F.crc32(F.substring(F.col("word").cast("binary"), -3, 3))
    return counts.select("word", (F.lit(SYMBOLS) + crc % SLOTS).cast("int").alias("slot"), "n")


class Vocabulary:
    """The known words in order of frequency: number, count and symbol of each."""

    def __init__(self, words: list[bytes], counts: list[int], slot_mass: np.ndarray):
        self.words = pa.array([w.decode() for w in words], pa.string())
        self.count = np.array([*counts, 0], np.int64)  # the last place is that of an unknown word
        own = SYMBOLS - 1
        self.symbol = np.array([0 if w == b"" else i + 1 if i < own else slot(w) for i, w in enumerate(words)] + [-1], np.int64)
        self.log_slot = slot_mass  # log10 of what the counts of a slot's words are divided by
        self.log_count = np.log10(self.count + 1.0)

    def symbols(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Numbers and symbols of the texts' words and endings, where each text starts and the last ends, and the words
        that are not known by heart."""
        words, ends = words_of(texts)
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False)
        sym = self.symbol[at]
        out = at < 0
        rare = words.filter(pa.array(out))
        sym[out] = slots_of(rare)
        return at, sym, ends, rare


def vocabulary(counts: DataFrame, known: int = KNOWN) -> tuple[Vocabulary, int, int, np.ndarray]:
    """The known words, the number of tokens and of distinct ones, and the symbols' counts.

    Known are the words of the highest counts, down to the step of a logarithmic scale at which they would be more
    than ``known``. The driver gets these, the steps and one row per slot. The end of text always comes first.
    """
    step = F.floor(F.log2("n") * 8).cast("int")
    least, n = None, 1
    for r in counts.where(F.col("word") != END).groupBy(step.alias("s")).agg(F.count("*").alias("k")).orderBy(F.desc("s")).collect():
        n += r["k"]
        if n > known:
            break
        least = r["s"]
    chosen = (F.col("word") == END) | (F.lit(False) if least is None else step >= least)
    table = counts.where(chosen).select("word", "n").toArrow()
    top = sorted(zip(table.column(0).to_pylist(), table.column(1).to_pylist()), key=lambda x: (x[0] != END, -x[1], x[0]))
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    slots = counts.groupBy("slot").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    mass = np.zeros(SYMBOLS + SLOTS)
    types = np.zeros(SYMBOLS + SLOTS)
    for r in slots:
        mass[r["slot"]], types[r["slot"]] = r["n"], r["v"]
    words, n = [w.encode() for w, _ in top], [k for _, k in top]
    if not words or words[0]:
        words, n = [b"", *words], [0, *n]
    for i in range(min(SYMBOLS, len(words))):  # words with a symbol of their own leave their slot
        mass[slot(words[i])] -= n[i]
        types[slot(words[i])] -= n[i] > 0
    frequency = mass.copy()
    frequency[0] = n[0]
    for i in range(1, min(SYMBOLS, len(words))):
        frequency[i] = n[i]
    return Vocabulary(words, n, np.log10(mass + types + 1)), int(sums["n"] or 0), int(sums["v"] or 0), frequency


def replicas(tokens: int) -> int:
    """Replicas of a round that share ``tokens`` training tokens between all rounds: one for each bounded part."""
    return max(1, -(-tokens // (ROUNDS * PART)))


def _averaged(got: Iterable[tuple[int, bytes]]) -> tuple[int, dict]:
    """Symbols seen in all, and the running mean of pickled parameters weighted by the symbols each has seen."""
    total, p = 0, {}
    for n, x in got:
        total += n
        for name, v in pickle.loads(bytes(x)).items():
            p[name] = p[name] + np.float32(n / total) * (v - p[name]) if name in p else v
    return total, p


def fit(
    docs: DataFrame, vocab: Vocabulary, frequency: np.ndarray, tokens: int, key: str = "doc_id", text: str = "text"
) -> tuple[dict, int]:
    """Network parameters, and the symbols they were trained on: those of all texts, each in one round.

    In a round the replicas train alone on a part each, and are averaged. A replica that is repeated reads the same
    texts in the same order, so it gives the same numbers. Replicas are averaged in groups first: the driver holds
    one set of parameters per group, about the square root of the replicas. Where a shuffle makes more partitions than
    asked for, they are put together: each replica sends a whole set of parameters.
    """
    p, trained = gru.fresh(frequency), 0
    spark, n = docs.sparkSession, replicas(tokens)
    # null ids are texts like others: they are dealt by their text
    draw = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.col(text), F.lit("")), F.lit(8))
    words = spark.sparkContext.broadcast(vocab)

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            for part in slices(b, 1):
                _, sym, ends, _ = words.value.symbols(part.column(1))
                yield from (sym[i:j] for i, j in itertools.pairwise(ends.tolist()))

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, mean = _averaged((r["seen"], r["p"]) for b in batches for r in b.to_pylist())
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([pickle.dumps(mean)], pa.binary())], names=["seen", "p"])

    try:
        for k in range(ROUNDS):
            dealt = docs.where(F.pmod(draw, F.lit(ROUNDS)) == k).select(draw.alias("_order"), F.col(text).alias("_text"))
            chosen = dealt.repartition(n, "_order").coalesce(n).sortWithinPartitions("_order")
            start = spark.sparkContext.broadcast(pickle.dumps(p))

            def learn(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
                texts = texts_of(batches)
                first = next(texts, None)
                if first is not None:
                    own, seen = gru.train(pickle.loads(start.value), itertools.chain([first], texts))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(first.sum())], pa.int64()), pa.array([seen], pa.int64()), pa.array([pickle.dumps(own)], pa.binary())],
                        names=["mark", "seen", "p"],
                    )

            own = chosen.mapInArrow(learn, "mark long, seen long, p binary")
            grouped = own.repartition(math.isqrt(n)).sortWithinPartitions("mark", "seen").mapInArrow(average, "seen long, p binary")
            got = sorted(((r["seen"], bytes(r["p"])) for r in grouped.collect()), key=lambda x: x)
            start.destroy()
            if got:
                seen, p = _averaged(got)
                trained += seen
    finally:
        words.unpersist()
    return p, trained


def score(
    docs: DataFrame, counts: DataFrame, vocab: Vocabulary, tokens: int, types: int, p: dict, key: str = "doc_id", text: str = "text",
    held: Column | None = None,
) -> DataFrame:
    """One row per document: tokens, known tokens, the unigram score and the network's, log10 of the whole text.

    A null or empty text is its end alone. Repeated rows are scored alike and returned as often; an empty table gives
    no rows. Words that no worker knows by heart have a share below 1 / KNOWN each, so joining them has no hot key.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((vocab, p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, net = model.value
        for whole in batches:
            for b in slices(whole, 2):
                number, sym, ends, rare = v.symbols(b.column(2))
                starts = ends[:-1]
                logs, of_slot = v.log_count[number], sym >= SYMBOLS
                extra = np.where(of_slot, logs - v.log_slot[sym], 0)
                got = gru.score(net, [sym[i:j] for i, j in itertools.pairwise(ends.tolist())]) / np.log(10) + np.add.reduceat(extra, starts)
                rares = np.concatenate([[0], np.cumsum(number < 0)])[ends]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(np.diff(ends)), pa.array(np.add.reduceat((v.count[number] > 0).astype(np.int64), starts)),
                     pa.array(np.add.reduceat(logs, starts)), pa.array(got), pa.ListArray.from_arrays(pa.array(rares.astype(np.int32)), rare)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare"],
                )

    kind = docs.schema[key].dataType.simpleString()
    held = F.lit(None).cast("boolean") if held is None else held
    partial = docs.select(F.col(key).alias("doc_id"), held.alias("held_out"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<string>"
    )
    stored = materialized(partial.withColumn("_row", F.monotonically_increasing_id()))
    rare = stored.select("_row", F.explode("rare").alias("word")).join(counts.select("word", "n"), "word")
    sums = rare.groupBy("_row").agg(F.count("*").alias("_known"), F.sum(F.log10(F.col("n") + 1.0)).alias("_log"))
    log = F.coalesce(F.col("_log"), F.lit(0.0))
    return stored.drop("rare").join(sums, "_row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + log - F.col("n_tokens") * F.lit(float(np.log10(tokens + types + 1)))).alias("base_score"),
        (F.col("score") + log).alias("score"),
    )


def train_and_score(docs: DataFrame, training: Column, held: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Count and train on the rows where ``training`` holds, then score all."""
    own = docs.where(training)
    counts = materialized(count_words(own, text))
    vocab, tokens, types, frequency = vocabulary(counts)
    p, _ = fit(own, vocab, frequency, tokens, key, text)
    return score(docs, counts, vocab, tokens, types, p, key, text, held)
