"""Language identification with hyperdimensional profiles.

Every letter gets a random vector of +1 and -1, drawn from its code point. An n-gram's vector binds (multiplies)
its letters' vectors, each permuted (rolled) by its place. A text's vector bundles (adds) the vectors of all its
n-grams, a language's prototype those of all its training texts; a text gets the language of the nearest
prototype by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

DIMENSIONS = 512
UNKNOWN = "und"
#: Texts are taken together up to this many characters, n-grams up to this many at a time: bounds on memory.
CHARS, BLOCK, CELLS = 400_000, 4096, 6_000_000


def letter_vector(code: int, dims: int = DIMENSIONS) -> np.ndarray:
    return (np.random.default_rng([7, int(code)]).integers(0, 2, dims, dtype=np.int8) * 2 - 1).astype(np.int8)


class Bundler:
    """Bundles texts of a row each; keeps the letters' vectors it has drawn."""

    def __init__(self, dims: int = DIMENSIONS):
        self.dims = dims
        self.alpha = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        self.drawn: dict[int, np.ndarray] = {}

    def _letters(self, codes: np.ndarray) -> np.ndarray:
        if len(self.drawn) > 100_000:
            self.drawn.clear()
        for c in codes.tolist():
            if c not in self.drawn:
                self.drawn[c] = letter_vector(c, self.dims)
        return np.stack([self.drawn[c] for c in codes.tolist()])

    def _grams(self, texts: list[str], rows: list[int]):
        """Trigram triples of letter numbers and the row of each; a run of other characters is one blank."""
        padded = [f" {t.lower()} " for t in texts]
        codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, padded), np.int64, len(padded))
        of = np.repeat(np.arange(len(padded)), sizes)
        letter = self.alpha[codes]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[np.cumsum(sizes) - sizes] = True
        codes, of = np.where(letter, codes, 32)[keep], of[keep]
        whole = of[:-2] == of[2:]
        alphabet = np.flatnonzero(np.bincount(codes))
        place = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 1, np.int64)
        place[alphabet] = np.arange(len(alphabet))
        p = place[codes]
        a = len(alphabet)
        keys = ((p[:-2] * a + p[1:-1]) * a + p[2:])[whole]
        return keys, np.asarray(rows, np.int64)[of[:-2][whole]], alphabet

    def bundle(self, texts: list[str], rows: list[int], n_rows: int) -> np.ndarray:
        """n_rows x dims sums; rows says which sum each text goes to."""
        out = np.zeros((n_rows, self.dims), np.float64)
        if not texts:
            return out
        keys, of, alphabet = self._grams(texts, rows)
        if not len(keys):
            return out
        a = len(alphabet)
        if a**3 <= 1 << 24:
            seen = np.zeros(a**3, bool)
            seen[keys] = True
            grams = np.flatnonzero(seen)
            place = np.zeros(a**3, np.int32)
            place[grams] = np.arange(len(grams), dtype=np.int32)
            column = place[keys]
        else:
            grams, column = np.unique(keys, return_inverse=True)
        base = self._letters(alphabet)
        second, first = np.roll(base, 1, 1), np.roll(base, 2, 1)
        width = max(1, min(BLOCK, CELLS // n_rows))
        order = None
        if len(grams) > width:
            order = np.argsort(column, kind="stable")
            column, of = column[order], of[order]
        for start in range(0, len(grams), width):
            g = grams[start : start + width]
            if order is None:
                c, r = column, of
            else:
                lo, hi = np.searchsorted(column, [start, start + len(g)])
                c, r = column[lo:hi] - start, of[lo:hi]
            counts = np.bincount(r * len(g) + c, minlength=n_rows * len(g)).reshape(n_rows, len(g)).astype(np.float32)
            vectors = (first[g // (a * a)] * second[g // a % a] * base[g % a]).astype(np.float32)
            out += counts @ vectors
        return out


def runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Index ranges of at most CHARS characters, or of one longer text."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > CHARS:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", dims: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Language names in order and their prototypes, from all rows with a text and a language.

    Each task sends one partial bundle per language; bundles are sums of whole numbers, so their order does
    not matter. The driver gets languages x dims numbers, whatever the corpus.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler, names, sums = Bundler(dims), {}, []
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for x in langs:
                if x not in names:
                    names[x] = len(names)
                    sums.append(np.zeros(dims))
            for lo, hi in runs(texts):
                got = bundler.bundle(texts[lo:hi], [names[x] for x in langs[lo:hi]], len(names))
                for i, row in enumerate(got):
                    sums[i] += row
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(names), pa.string()), pa.array([s.tolist() for s in sums], pa.list_(pa.float64()))],
            names=["lang", "bundle"],
        )

    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")
    )
    parts = known.mapInArrow(partial, "lang string, bundle array<double>")
    sums = parts.select("lang", F.posexplode("bundle").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("lang").collect()
    rows = [r for r in rows if any(e["x"] for e in r["v"])]
    return [r["lang"] for r in rows], np.array([[e["x"] for e in r["v"]] for r in rows]).reshape(len(rows), dims)


def predict(
    docs: DataFrame, names: list[str], prototypes: np.ndarray, key: str = "doc_id", text: str = "text", held: Column | None = None
) -> DataFrame:
    """One row per document: the nearest prototype's language and the cosine, 0 where it is negative.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything if nothing was learned.
    Equal cosines go to the first name in order. Repeated rows give repeated rows, an empty table none.
    """
    held = F.lit(None).cast("boolean") if held is None else held
    norms = np.linalg.norm(prototypes, axis=1)
    unit = prototypes / np.where(norms == 0, 1, norms)[:, None]
    dims = prototypes.shape[1]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler = Bundler(dims)
        for b in batches:
            texts = [x or "" for x in b.column(2).to_pylist()]
            langs, scores = [], []
            for lo, hi in runs(texts):
                v = bundler.bundle(texts[lo:hi], list(range(hi - lo)), hi - lo)
                size = np.linalg.norm(v, axis=1)
                cos = (v @ unit.T) / np.where(size == 0, 1, size)[:, None] if len(names) else np.zeros((hi - lo, 1))
                best = cos.argmax(1)
                for i, t in enumerate(texts[lo:hi]):
                    known = len(names) > 0 and size[i] > 0 and any(map(str.isalpha, t))
                    langs.append(names[best[i]] if known else UNKNOWN)
                    scores.append(float(min(1.0, max(0.0, cos[i, best[i]]))) if known else 0.0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), held.alias("held_out"), F.col(text).alias("text")).mapInArrow(
        score, f"doc_id {kind}, held_out boolean, lang_pred string, score double"
    )
