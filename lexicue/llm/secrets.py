"""Secret scan by assignment-aware lexing.

Three fixed patterns give the base spans. On top of them source and configuration syntax is lexed into
(name, expression) pairs; constants are followed from name to name and through concatenations; a literal
is reported when the names it reaches are sensitive and the literal itself looks like a credential.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A maximal run of 32 or more is what the open-ended run pattern leaves after its length test.
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "named")
#: Parts of one value up to which repeated values are repeated; no literal depends on it being reported.
REPEATS = 10_000
LEAST = {"assign": 8, "access": 16, "hex": 32}

#: Weight of each part of a target name; parts that say "this is a number, place or label" count against it.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "key": 0.5, "api": 0.4, "auth": 0.5, "access": 0.4, "private": 0.5,
    "bearer": 0.6, "signing": 0.4, "encryption": 0.4, "master": 0.3, "pin": 0.5, "cookie": 0.5, "session": 0.4,
    "count": -0.8, "length": -0.8, "size": -0.8, "max": -0.6, "min": -0.6, "limit": -0.8, "type": -0.7,
    "name": -0.7, "url": -0.7, "uri": -0.7, "path": -0.7, "file": -0.6, "id": -0.5, "public": -0.6,
}
PLACEHOLDERS = re.compile(
    r"(?i)(change_?me|example|placeholder|your[_-]|dummy|redacted|x{4,}|\*{3,}|<.*>|\$\{.*\}|none|null|true|false|undefined)"
)

_STRING = (
    r"""[rRbBuUfF]{0,2}(?:"{3}(?:[^\\]|\\[\s\S])*?"{3}|'{3}(?:[^\\]|\\[\s\S])*?'{3}"""
    r"""|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
)
TERM = re.compile(rf"(?P<string>{_STRING})|[A-Za-z0-9_/+.=-]*[A-Za-z0-9_/=]", re.A)
PLUS = re.compile(r"[ \t]*\+[ \t]*")
_NAME = r"""(?<![\w.-])(?P<name>[A-Za-z_][\w.-]*(?:\[["'][\w.-]+["']\])?)"""
TARGET = re.compile(rf"""(?:{_NAME}|"(?P<key>[\w.-]+)"|'(?P<quoted>[\w.-]+)')[ \t]*(?::=|=>|=(?!=)|:)[ \t]*""", re.A)
#: A further target of the same value, or the type of the target before it; a colon counts only before a blank.
NEXT = re.compile(rf"{_NAME}[ \t]*(?::=|=>|=(?!=)|:(?=[ \t]))[ \t]*", re.A)
#: Types that are no plain name: with arguments, optional or one of several.
TYPE = re.compile(
    r"[*&]?[A-Za-z_][\w.]*(?:\[[^=\n]*?\]|<[^=\n]*?>)*[?*&]?(?:[ \t]*\|[ \t]*[A-Za-z_][\w.]*(?:\[[^=\n]*?\])?)*[ \t]*=(?![=>])[ \t]*", re.A
)
#: Words after a colon that are a type and not a target.
TYPES = frozenset("str string String bytes int float bool any Any object char text final Final".split())
IDENTIFIER = re.compile(r"[A-Za-z_][\w.]*\Z", re.A)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def name_score(name: str) -> float:
    """How sensitive a target name is, 0 to 1, from its camel, snake or dotted parts."""
    return min(1.0, max(0.0, sum(NAME_WEIGHTS.get(p.lower(), 0.0) for p in _PARTS.findall(name))))


def literal_score(value: str) -> float:
    """How much a literal looks like a credential, 0 to 1: length, entropy and mixture of characters."""
    if len(value) < 8 or PLACEHOLDERS.search(value) or any(c.isspace() for c in value):
        return 0.0
    n = len(value)
    bits = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, bits / 3.5) * (1.0 if kinds >= 2 else 0.4)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, code points, end exclusive."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def _sum(text: str, at: int) -> tuple[list, int]:
    """The parts (start, end, name or None) of the sum that begins at ``at``, and where it ends."""
    parts: list = []
    end = at
    while t := TERM.match(text, at):
        if t["string"]:
            quote = next(i for i in range(t.start(), t.end()) if text[i] in "\"'")
            n = 3 if t.end() - quote >= 6 and text[quote : quote + 3] == text[quote] * 3 else 1
            parts.append((quote + n, t.end() - n, None))
        else:
            parts.append((t.start(), t.end(), t[0] if IDENTIFIER.match(t[0]) else None))
        end = t.end()
        plus = PLUS.match(text, end)
        if not plus:
            break
        at = plus.end()
    return parts, end


def _pairs(text: str) -> Iterator[tuple[str, list, bool]]:
    """(name, parts, True) of each assignment; of ``a = b = value`` and ``a: b = value`` both names have the value.

    A word with digits that is taken for a further target may be a value after all: it is given, with False, to the
    target before it, for which it does not stand from then on.
    """
    at = 0
    while m := TARGET.search(text, at):
        at, names, starts = m.end(), [m["name"] or m["key"] or m["quoted"]], [m.end()]
        typed = text[m.start() : m.end()].rstrip(" \t")[-1] == ":"
        while True:
            if n := NEXT.match(text, at):
                names.append(n["name"])
            elif typed and len(names) == 1 and (n := TYPE.match(text, at)):
                names.append("")
            else:
                break
            at = n.end()
            starts.append(at)
        while starts:
            parts, end = _sum(text, starts[-1])
            if parts:
                break
            starts.pop()
        if not starts:
            continue
        at = end
        for name, start in zip(names, starts[:-1]):
            word = TERM.match(text, start)
            if name and word and not word["string"] and any(c.isdigit() for c in word[0]):
                yield name, [(start, word.end(), None)], False
        for name in names[: len(starts)]:
            if name and not (name in TYPES and len(names) > 1):
                yield name, parts, True


def _leaves(k: int, parts: list, ends: list) -> list[tuple[int, int, str | None]]:
    """The literals and unquoted words that assignment ``k`` comes down to, in the order of the sum.

    ``ends`` has for each part the assignment it stands for, or None. Cycles end where they close. Values that
    are repeated are repeated here, up to REPEATS parts; from there each assignment met is opened once only, so
    none of its literals is missing and the work is bounded by the text.
    """
    out, path, seen, stack, steps = [], {k}, {k}, [(k, 0)], 0
    while stack:
        n, i = stack.pop()
        if i == len(parts[n]):
            path.discard(n)
            continue
        stack.append((n, i + 1))
        steps += 1
        to = ends[n][i]
        if to is None:
            out.append(parts[n][i])
        elif to not in path and (steps <= REPEATS or to not in seen):
            path.add(to)
            seen.add(to)
            stack.append((to, 0))
    return out


def named_spans(text: str, least: float = 0.6) -> list[tuple[int, int, str]]:
    """Literals that flow into a sensitive name.

    Each assignment's expression is a sum of literals and names. A name stands for what it was last given; one
    that is used before it is given takes its first value. Names are followed as far as they lead.
    """
    if ":" not in text and "=" not in text:
        return []
    pairs = list(_pairs(text))
    first: dict[str, int] = {}
    for k, (name, _, lasting) in enumerate(pairs):
        if lasting:
            first.setdefault(name, k)
    given: dict[str, int] = {}
    ends = []
    for k, (name, own, lasting) in enumerate(pairs):
        to = [None if ref is None else given.get(ref, first.get(ref) if ref != name else None) for _, _, ref in own]
        ends.append([None if t == k else t for t in to])
        if lasting:
            given[name] = k
    parts = [own for _, own, _ in pairs]
    found = set()
    for k, (name, _, _) in enumerate(pairs):
        weight = name_score(name)
        if not weight:
            continue
        value = _leaves(k, parts, ends)
        literals = [(a, b) for a, b, ref in value if ref is None]
        if literals and weight * literal_score("".join(text[a:b] for a, b in literals)) >= least:
            found.update(literals)
        for a, b, ref in value:
            # configuration files leave literals unquoted: a word that names nothing is one if it has a digit
            if ref is not None and any(c.isdigit() for c in ref) and weight * literal_score(ref) >= least:
                found.add((a, b))
    return [(a, b, "named") for a, b in found if b > a]


def spans(text: str) -> list[tuple[int, int, str]]:
    """All spans by start, then kind as listed. Named ones inside a base span are left out; base ones stay."""
    base = base_spans(text)
    more = [s for s in named_spans(text) if not any(a <= s[0] and s[1] <= b for a, b, _ in base)]
    return sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _join(found) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts per kind, the base spans' digest and all spans.

    Whole texts are read; null is the empty text, which has no spans. Repeated rows give repeated rows, an
    empty table no rows; other columns are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            out = {"n_assign": [], "n_access": [], "n_hex": [], "n_named": [], "base_sha256": [], "spans": []}
            for x in b.column(1).to_pylist():
                found = spans(x or "")
                for kind in KINDS:
                    out[f"n_{kind}"].append(sum(s[2] == kind for s in found))
                base = _join(s for s in found if s[2] != "named")
                out["base_sha256"].append(hashlib.sha256(base.encode()).hexdigest())
                out["spans"].append(_join(found))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(v, pa.int64() if k[:2] == "n_" else pa.string()) for k, v in out.items())],
                names=["doc_id", *out],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        scan,
        f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_named long, base_sha256 string, spans string",
    )


def redact(docs: DataFrame, text: str = "text", count: str = "n_chars", mark: str = "[secret]") -> DataFrame:
    """The same rows with every span replaced by ``mark``; ``count`` follows the new text where it changed.

    Overlapping spans are replaced as one. Null texts stay null.
    """
    at = docs.columns.index(text)
    counted = docs.columns.index(count) if count in docs.columns else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            cols = list(b.columns)
            sizes = cols[counted].to_pylist() if counted is not None else None
            changed = False
            for i, x in enumerate(texts):
                found = spans(x) if x else []
                if not found:
                    continue
                changed, out, done = True, [], 0
                for a, e, _ in found:
                    if a >= done:
                        out += [x[done:a], mark]
                    done = max(done, e)
                texts[i] = "".join([*out, x[done:]])
                if sizes is not None:
                    sizes[i] = len(texts[i])
            if changed:
                cols[at] = pa.array(texts, b.schema.field(at).type)
                if sizes is not None:
                    cols[counted] = pa.array(sizes, b.schema.field(counted).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(scan, docs.schema)
