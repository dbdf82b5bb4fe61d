"""Encoding and decoding with a byte-pair vocabulary: speculate, verify, merge what fails.

A word's longest matches from the left are proposed as its tokens. Merges happen in the order of their rank, so a row of
tokens is the right one exactly when no merge across a border of two neighbours would come before the border's sides are
complete. That is a property of the two tokens alone: it is tested for all different pairs of a batch at once, over
arrays. Only words with a failing pair are merged symbol by symbol.

Normal forms and the split into words are those that the vocabulary file states, by the library's own objects.
"""

from __future__ import annotations

import heapq
import json
import re
import string
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters worked on at a time; longer texts are cut between words.
GROUP = 1 << 20
#: Words whose ids a task remembers: the first it meets, which has the common ones.
WORDS = 400_000
#: Stands for the end of a word inside this module; byte-level symbols never are this character.
END = "\0"
#: Words of up to so many symbols are merged by looking at all pairs, longer ones with a heap.
SHORT = 64
#: Characters that end a word and form parts of their own; the apostrophe may start a part with letters.
MARKS = string.punctuation.replace("'", "")
NEVER = np.iinfo(np.int64).max
_BLANKS = re.compile("[ \n\r\t]+")


class Vocabulary:
    """Tokens, merges and special strings of a ``tokenizers`` file of kind BPE with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or model["continuing_subword_prefix"] or spec["decoder"]:
            raise ValueError("the vocabulary must be byte-pair merges with word ends and no decoder")
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in spec["added_tokens"]):
            raise ValueError("special tokens must be plain strings of the raw text")
        library = Tokenizer.from_file(path)
        self._normal, self._split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        ids = model["vocab"]
        self.size = 1 + max([*ids.values(), *self.special.values()])
        self.names = [""] * self.size
        for name, i in [*ids.items(), *self.special.items()]:
            self.names[i] = name
        suffix = model["end_of_word_suffix"]
        pairs = np.array([(ids[a], ids[b], ids[a + b]) for a, b in model["merges"]], np.int64).reshape(-1, 3)
        n = len(pairs)
        self.rank, self.left, self.right = (np.full(self.size, -1, np.int64) for _ in range(3))
        self.rank[pairs[:, 2]], self.left[pairs[:, 2]], self.right[pairs[:, 2]] = np.arange(n), pairs[:, 0], pairs[:, 1]
        if len(set(pairs[:, 2].tolist())) < n or (np.maximum(self.rank[pairs[:, 0]], self.rank[pairs[:, 1]]) >= np.arange(n)).any():
            raise ValueError("every token must come from one merge of earlier tokens")
        keys = pairs[:, 0] * self.size + pairs[:, 1]
        order = np.argsort(keys)
        self._keys, self._ranks, self._token_of = keys[order], order, pairs[:, 2].tolist()
        self.merge_of = dict(zip(keys.tolist(), range(n)))
        spelled = [""] * self.size
        for name, i in ids.items():
            if self.rank[i] < 0:
                spelled[i] = name[: -len(suffix)] + END if name.endswith(suffix) and len(name) > len(suffix) else name
        for a, b, made in pairs.tolist():
            spelled[made] = spelled[a] + spelled[b]
        # a token that other merges would break up is never in a result, and so is not proposed
        stands = np.ones(self.size, bool)
        stands[self._token_of] = ~self.broken(pairs[:, 0], pairs[:, 1], np.arange(n))
        for a, b, made in pairs.tolist():
            stands[made] &= stands[a] & stands[b]
        self.symbols = {spelled[i]: i for i in ids.values() if self.rank[i] < 0}
        self.tokens = {spelled[i]: i for i in ids.values() if stands[i]}
        lengths: dict[str, set[int]] = {}
        for t in self.tokens:
            lengths.setdefault(t[:2], set()).add(len(t))
        # by the first two characters; the last symbol of a word is two long, any other one
        self._lengths = {k: sorted(v if k[-1] == END else v | {1}, reverse=True) for k, v in lengths.items()}
        self._tries: dict[tuple[str, int], tuple[int, ...]] = {}
        self._longest = max(map(len, self.tokens))
        pieces = lambda text: [p for p, _ in self._split(self._normal(text))]
        letters = string.ascii_letters
        #: ASCII words of letters are parts in small letters, and marks after a letter are a part of their own
        self._plain_letters = pieces(letters) == [letters.lower()]
        self._ends: dict[str, bool] = {}
        self._marks = MARKS if pieces("a" + MARKS) == ["a", MARKS] == pieces("A" + MARKS) else ""

    def broken(self, a: np.ndarray, b: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """Whether a merge across the border of tokens ``a`` and ``b`` comes before both are complete.

        The pieces that touch the border are followed back in time, the one made last first. A merge of two pieces
        happens while both are there: before the merge that swallows the left one and not after the one that swallows
        the right one, as equal merges go from left to right. ``below`` bounds the ranks looked at.
        """
        x, y = a.copy(), b.copy()
        until_x = np.full(len(x), NEVER) if below is None else below.copy()
        until_y = until_x - 1 if below is not None else until_x.copy()
        bad = np.zeros(len(x), bool)
        live = np.arange(len(x))
        while len(live):
            u, v = x[live], y[live]
            key = u * self.size + v
            at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            rank = np.where(self._keys[at] == key, self._ranks[at], NEVER)
            bad[live] = (rank < until_x[live]) & (rank <= until_y[live])
            ru, rv = self.rank[u], self.rank[v]
            on = ~bad[live] & ((ru >= 0) | (rv >= 0))
            live, ru, rv = live[on], ru[on], rv[on]
            later = rv >= ru
            i, j = live[later], live[~later]
            until_y[i], y[i] = rv[later], self.left[y[i]]
            until_x[j], x[j] = ru[~later], self.right[x[j]]
        return bad

    def propose(self, word: str) -> list[int]:
        """Longest matches from the left; ``word`` ends with END."""
        whole = self.tokens.get(word)
        if whole is not None:
            return [whole]
        out, at, last, tokens = [], 0, len(word) - 1, self.tokens
        while at < last:
            # END is no symbol by itself, so no match may leave it alone
            left = last - at
            start = word[at : at + 2]
            lengths = self._lengths.get(start)
            if lengths is None:
                tries = (1,)
            else:
                key = start, min(left, self._longest + 1)  # beyond the longest token all are alike
                tries = self._tries.get(key)
                if tries is None:
                    tries = self._tries[key] = tuple(k for k in lengths if k <= left + 1 and k != left)
            for k in tries:
                token = tokens.get(word[at : at + k])
                if token is not None:
                    break
            out.append(token)
            at += k
        return out

    def merge(self, word: str) -> list[int]:
        """The exact tokens: merges by rank, equal ones from left to right."""
        ids = [self.symbols[c] for c in word[:-2]] + [self.symbols[word[-2:]]]
        n = len(ids)
        if n <= SHORT:
            rank_of = self.merge_of.get
            ranks = [rank_of(a * self.size + b, NEVER) for a, b in zip(ids, ids[1:])]
            while ranks and (rank := min(ranks)) != NEVER:
                i = ranks.index(rank)
                ids[i : i + 2] = [self._token_of[rank]]
                del ranks[i]
                if i:
                    ranks[i - 1] = rank_of(ids[i - 1] * self.size + ids[i], NEVER)
                if i < len(ranks):
                    ranks[i] = rank_of(ids[i] * self.size + ids[i + 1], NEVER)
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        size, merge_of, made = self.size, self.merge_of, self._token_of

        def pair(i: int, j: int):
            rank = merge_of.get(ids[i] * size + ids[j])
            if rank is not None:
                heapq.heappush(todo, (rank, i, ids[i], ids[j]))

        todo: list = []
        for i in range(n - 1):
            pair(i, i + 1)
        while todo:
            rank, i, a, b = heapq.heappop(todo)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                pair(i, k)
            if before[i] >= 0:
                pair(before[i], i)
        return [t for t in ids if t >= 0]

    def parts(self, word: str) -> Iterator[str | int]:
        """Words as the vocabulary splits them, each closed by END, and ids of special strings."""
        at = 0
        for m in self._special.finditer(word) if self._special else ():
            yield from self._plain(word[at : m.start()])
            yield self.special[m[0]]
            at = m.end()
        yield from self._plain(word[at:])

    def _plain(self, raw: str) -> Iterator[str]:
        if raw:
            for part, _ in self._split(self._normal(raw)):
                yield part + END

    def tokenize(self, parts: list[str]) -> tuple[list[list[int]], list[int]]:
        """The tokens of each part, and the numbers of the parts whose proposal failed and that were merged."""
        proposed = [self.propose(p) for p in parts]
        flat = np.array([t for p in proposed for t in p], np.int64)
        owner = np.repeat(np.arange(len(parts)), np.array([len(p) for p in proposed], np.int64)) if parts else flat
        same = owner[1:] == owner[:-1]
        pairs, which = np.unique(flat[:-1][same] * self.size + flat[1:][same], return_inverse=True)
        bad = self.broken(pairs // self.size, pairs % self.size)
        failing = np.unique(owner[1:][same][bad[which]]).tolist() if len(pairs) else []
        for i in failing:
            proposed[i] = self.merge(parts[i])
        return proposed, failing

    def split(self, word: str) -> tuple[str, ...]:
        """A word between blanks without the marks at its end, and these; they never share a part."""
        stem = word.rstrip(self._marks)
        if not stem or len(stem) == len(word) or not self._closes(stem[-1]) or (self._special and self._special.search(word)):
            return (word,)
        return stem, word[len(stem) :]

    def _closes(self, letter: str) -> bool:
        """Whether a mark after this character starts a part of its own, whatever comes before."""
        closes = self._ends.get(letter)
        if closes is None:
            closes = letter.isalpha() and [p for p, _ in self._split(self._normal(letter + "!"))][-1] == "!"
            self._ends[letter] = closes
        return closes

    def encode(self, words: Iterable[str], known: dict[str, bytes] | None = None) -> dict[str, bytes]:
        """The ids of each word between blanks, and of its stem, as little-endian unsigned 32-bit numbers; ``known`` ones are left out."""
        known = known or {}
        cut = {w: self.split(w) for w in words}
        fresh = {s for ss in cut.values() for s in ss if s not in known}
        simple = self._plain_letters
        split = {s: [s.lower() + END] if simple and s.isascii() and s.isalpha() else list(self.parts(s)) for s in fresh}
        parts = list({p for ps in split.values() for p in ps if isinstance(p, str)})
        tokens = dict(zip(parts, self.tokenize(parts)[0]))
        out = {s: array("I", [t for p in ps for t in (tokens[p] if isinstance(p, str) else (p,))]).tobytes() for s, ps in split.items()}
        for w, ss in cut.items():
            if len(ss) == 2:
                out[w] = b"".join(out[s] if s in out else known[s] for s in ss)
        return out

    @cached_property
    def spaced(self) -> list[str]:
        return [f" {n}" for n in self.names]

    def decode(self, ids: bytes) -> str:
        """Tokens with a blank between, word ends and byte symbols as written in the vocabulary."""
        return "".join(map(self.spaced.__getitem__, np.frombuffer(ids, "<u4").tolist()))[1:]


def slices(text: str, most: int = GROUP) -> Iterator[str]:
    """The text in parts of about ``most`` characters, cut at blanks, which no token spans."""
    at = 0
    while len(text) - at > most:
        blank = _BLANKS.search(text, at + most)
        if not blank:
            break
        yield text[at : blank.start()]
        at = blank.end()
    yield text[at:]


def encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids``: every whole text's ids, little-endian unsigned 32-bit numbers in a row.

    As the library's ``encode(text, add_special_tokens=False)``: strings of special tokens give their ids. Null,
    empty and blank texts give no ids. Repeated rows, rows with a null key and rows of an empty table keep their number;
    other columns are not read. ``tokenizer`` is a file that has the same path on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(tokenizer)
        kept: dict[str, bytes] = {"": b""}
        todo: list[tuple[list[bytes], list[str]]] = []

        def finish() -> None:
            new = vocabulary.encode({w for _, words in todo for w in words} - kept.keys(), kept)
            kept.update(new)
            for ids, words in todo:
                ids.append(b"".join(map(kept.__getitem__, words)))
            for w in new:
                if len(kept) > WORDS or len(w) >= 64:
                    del kept[w]
            todo.clear()

        for b in batches:
            start, size, ready = 0, 0, []
            for i, t in enumerate(b.column(1)):
                ready.append([])
                for part in slices(t.as_py() or ""):
                    todo.append((ready[-1], _BLANKS.split(part)))
                    size += len(part)
                    if size >= GROUP:
                        finish()
                        size = 0
                if not todo or i + 1 == b.num_rows:
                    finish()
                    ids = pa.array([b"".join(r) for r in ready], pa.binary())
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(ready)), ids], names=[key, "ids"])
                    start, ready = i + 1, []

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids binary")


def decode(encoded: DataFrame, tokenizer: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key``, ``ids`` and ``decoded``: the text of a row of ids as the library's ``decode(ids, skip_special_tokens=False)``.

    The vocabulary has no decoder, so tokens stand as written there, a blank between them. Null or no ids give the empty text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(tokenizer)
        for b in batches:
            start, size, ready = 0, 0, []
            for i, x in enumerate(b.column(1)):
                ready.append(vocabulary.decode(x.as_py() or b""))
                size += len(ready[-1])
                if size >= GROUP or i + 1 == b.num_rows:
                    part = b.slice(start, len(ready))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ready, pa.string())], names=[key, ids, "decoded"])
                    start, size, ready = i + 1, 0, []

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {kind}, `{ids}` binary, decoded string")
