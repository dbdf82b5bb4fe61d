"""Best-fit packing by a length histogram.

Documents are cut into pieces no longer than a sequence. Only the number of pieces of each length reaches the
driver, at most one number per length; best-fit decreasing runs over these counts, whole groups of like sequences
at a time. The pieces then take the planned places by their rank within their length.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexicue.llm.common import chunks_for, materialized, ranked, rows_of

CAPACITY = 4096
END = 1
#: Distinct words a worker remembers: the first it meets, which has the common ones.
WORDS = 1_000_000
_PUNCTUATED = re.compile(r"([A-Za-z]+)([!-/:-@\[-`{-~]+)")


class Words(dict):
    """Word -> its token ids as little-endian 32-bit bytes.

    The tokenizer drops blanks and never joins across them, so a text's ids are those of its words in turn. It also
    lowers case and parts letters from marks, so words that differ in these share the work.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)

    def __missing__(self, word: str) -> bytes:
        parts = _PUNCTUATED.fullmatch(word)
        if parts:
            ids = self[parts[1]] + self[parts[2]]
        elif word.isascii() and (low := word.lower()) != word and "<|" not in word:
            ids = self[low]
        else:
            ids = b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(word) < 64 and len(self) < WORDS:
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, re.split("[ \n\r\t]+", text) if text else ()))


def worker_words(path: str) -> Words:
    """This Python worker's table, which outlives the task: Spark keeps its workers, and words repeat from task to task."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_lexicue_words", {})
    if path not in kept:
        kept[path] = Words(path)
    return kept[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's ids and the end id, cut at ``capacity``: piece, start, length and checksum of the ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_words(tokenizer)
        for b in batches:
            which, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                ids = words.ids(t or "") + END.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    which.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Places(NamedTuple):
    """Ranks [rank, end) of a length go to sequences from ``sequence`` on, ``each`` to a sequence, from ``offset`` on."""

    length: int
    rank: int
    end: int
    sequence: int
    each: int
    offset: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Places]:
    """Best-fit decreasing over counts: longest first, each into the fullest sequence that has room.

    Sequences of equal room are kept as ranges of numbers. The best fit of equal pieces is to fill one sequence
    with as many as it holds, then the next, so a whole range is served in one step.
    """
    rooms: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = {}
    opened, out = 0, []

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in groups:
                bisect.insort(rooms, room)
                groups[room] = []
            groups[room].append((first, n))

    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, first = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            each = room // length
            full = min(n, left // each)
            if full:
                out.append(Places(length, rank, rank + full * each, first, each, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < n:
                out.append(Places(length, rank, rank + left, first + full, each, capacity - room))
                put(room - left * length, first + full, 1)
                full, left = full + 1, 0
            put(room, first + full, n - full)
    return out


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", seed: int = 5
) -> DataFrame:
    """One row per piece with its sequence and its place there.

    Null and empty texts are the end id alone. Repeated rows are documents of their own; an empty table gives no
    rows. The pieces, without their ids, are written once, so that ranks and counts agree when a task is repeated.
    """
    cut = materialized(pieces(docs, tokenizer, capacity, key, text))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # a row per length, at most ``capacity``, with the places of that length
    by_length: dict[int, list] = {}
    for p in plan(counts, capacity):
        by_length.setdefault(p.length, []).append(p)
    table = rows_of(
        docs.sparkSession,
        [{"_length": p.length, "_from": p.rank, "_to": p.end, "_seq": p.sequence, "_each": p.each, "_off": p.offset} for v in by_length.values() for p in v],
        "_length bigint, _from bigint, _to bigint, _seq bigint, _each bigint, _off bigint",
    )
    numbered = ranked(cut, ["length"], F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(seed)), "_rank", chunks_for(max(counts.values(), default=0)))
    own = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    i = F.col("_rank") - F.col("_from")
    return numbered.join(F.broadcast(table), own).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_seq") + F.floor(i / F.col("_each"))).alias("sequence_id"),
        (F.col("_off") + i % F.col("_each") * F.col("length")).alias("offset"),
    )
