"""Hard negatives, ranked search and byte-pair coding against plain Python on odd inputs."""

import heapq
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexicue.llm import bpe, lexical, negatives
from lexicue.llm.jobs import JOBS, tokenizer_path
from tests.conftest import SMALL
from tests.llm import data

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# 11
@pytest.mark.parametrize("shape", [(1, 1, 1), (33, 33, 33), (70, 65, 129), (64, 0, 50), (0, 64, 9), (100, 64, 257)])
def test_strassen_equals_the_plain_product(shape):
    rnd = np.random.default_rng(5)
    a, b = rnd.integers(-(10**6), 10**6, shape[:2]), rnd.integers(-(10**6), 10**6, shape[1:])
    assert (negatives.strassen(a, b) == a @ b).all()


def mined(rows, step=10):
    """All by sorting; rows are told apart by their place in the list."""
    ok = [
        (i, v, [math.floor(256 * float(np.float32(x))) for x in e], label)
        for i, (v, e, label) in enumerate(rows)
        if label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)
    ]
    ok = [(i, v, e, (y + 1) % 10 if v is not None and v % 7 == 0 else y) for i, v, e, y in ok]
    out = []
    for i, v, e, y in ok:
        if v is None or v % step:
            continue
        scored = sorted(
            ((-sum(p * q for p, q in zip(e, f)), (w is None, w or 0), z, w) for j, w, f, z in ok if j != i), key=lambda t: t[:3]
        )
        for ps, _, z, w in [s for s in scored if s[2] == y][:5]:
            fits = [s for s in scored if s[2] != y and 50 * -ps <= 100 * -s[0] <= 95 * -ps][:3]
            out += [(v, w, r + 1, s[3], -ps, -s[0]) for r, s in enumerate(fits)]
    return out


def vectors(n, dim, seed):
    rnd = random.Random(seed)
    some = [[rnd.uniform(-1, 1) for _ in range(dim)] for _ in range(4)]
    rows = [(i, [x + rnd.uniform(-0.4, 0.4) for x in rnd.choice(some)], rnd.randrange(3)) for i in range(n)]
    rows += [(n + i, list(some[0]), i % 3) for i in range(40)]  # a group of copies, many ties
    return rows + [
        (None, list(some[1]), 1), (None, list(some[1]), 2), (30, list(some[2]), 1), (30, list(some[2]), 1), (40, None, 1), (50, list(some[0]), None),
        (60, [None] + some[0][1:], 1), (70, [float("nan")] + some[0][1:], 1), (80, [float("inf")] + some[0][1:], 1), (90, [], 1), (91, some[0][:3], 2), (-100, list(some[3]), -4),
    ]


def mine(df):
    noise = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(df, F.col("id") % 10 == 0, noise=noise)


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("sizes", [(8192, 256, 1024), (7, 3, 5)])
def test_hard_negatives(spark, monkeypatch, sizes):
    for name, size in zip(("BLOCK", "TILE", "ROWS"), sizes):
        monkeypatch.setattr(negatives, name, size)
    rows = vectors(150, 70, 3)
    df = spark.createDataFrame(rows, VECTORS)
    want = sorted(map(repr, mined(rows)))
    assert sorted(repr(tuple(r)) for r in mine(df).collect()) == want and len(want) > 100
    clash = df.select("*", *[F.lit("x").alias(n) for n in ("row", "id", "v", "block", "score", "key", "rank")])
    assert mine(clash).count() == len(want)
    assert mine(df.limit(0)).count() == 0 and mine(df.where("vec_id % 10 <> 0")).count() == 0


def test_hard_negatives_refuse_what_passes_64_bits(spark):
    df = spark.createDataFrame([(0, [1e30, 0.0], 1), (1, [1.0, 1.0], 1)], VECTORS)
    with pytest.raises(ValueError, match="56 bits"):
        negatives.mine(df, F.col("id") == 0)


# 12
def searched(docs, items, keep):
    counted = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    counted = [(i, ts) for i, ts in counted if ts]
    total, length = len(counted), sum(len(ts) for _, ts in counted)
    tf = [{t: ts.count(t) for t in set(ts)} for _, ts in counted]
    df = {}
    for c in tf:
        for t in c:
            df[t] = df.get(t, 0) + 1
    terms: dict = {}
    for i, t in items:
        terms.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, ts in terms.items():
        scored = []
        for (i, words), c in zip(counted, tf):
            m = 50 + 50 * len(words) * total // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if s > 0:
                scored.append((-s, (i is None, i or 0), i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(heapq.nsmallest(keep, scored, key=lambda x: x[:2]))]
    return out


ITEMS = [
    (1, "w1xa W2XB, w3xc!"), (2, "one TWO"), (2, "Two three w9xa"), (3, None), (4, " ,;- "), (None, "w5xb É"), (5, "É É中文 ééé ÉÉ"),
    (6, "absent"), (7, "xy" * 5000), (8, "a_b c-d w7xb@w8xc"), (9, "w1xa W2XB, w3xc!"),
]


@pytest.mark.parametrize("block", [2_000_000, 12])
def test_search(spark, monkeypatch, block):
    monkeypatch.setattr(lexical, "BLOCK", block)
    rows = [(r[0], r[1]) for r in data.rows()] + [(500, "a_b c-d"), (501, "ÉÉ É中文"), (502, "w1xa " * 3000), (503, "x\0y One\x85two"), (504, "xy" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted(map(repr, searched(rows, ITEMS, 6)))
    got = lexical.search(docs, items, keep=6)
    assert sorted(repr(tuple(r)) for r in got.collect()) == want and len(want) > 20
    clash = [x.select("*", *[F.lit("x").alias(n) for n in ("term", "item", "block", "n", "score", "rank")]) for x in (docs, items)]
    assert lexical.search(*clash, keep=6).count() == len(want)
    assert lexical.search(docs.limit(0), items).count() == 0 and lexical.search(docs, items.limit(0)).count() == 0


# 13
@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(tokenizer_path())


def odd_texts():
    rnd = random.Random(2)
    letters = "abcdeéßİΣς'’sтлд中文\U0001f600!?<>|/w_-+=123½̀́\x85\xa0  \n\t\x00A\x1cﬁ"
    return [
        None, "", " \n", "x<|endoftext|>y <|startoftext|><|endoftext|", "</w> !</w> <</ww>>", "a" * 3000, "ab" * 2000 + "c", "!" * 777, "I'm don't CAN'T we'll",
        *("".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(1500)),
        *("".join(rnd.choice("aehinrst") for _ in range(rnd.randrange(40))) for _ in range(1500)),
    ]


@pytest.mark.parametrize("group", [1 << 20, 50])
def test_ids_and_texts_are_the_library_s(spark, library, monkeypatch, group):
    monkeypatch.setattr(bpe, "GROUP", group)
    monkeypatch.setattr(bpe, "WORDS", 3000)
    texts = [r[1] for r in data.rows()] + odd_texts()
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "again"), (7, "again"), (7, "again")], "doc_id long, text string")
    coded = lambda df: bpe.decode(bpe.encode(df, tokenizer_path()), tokenizer_path())
    got = coded(docs).collect()
    assert len(got) == len(texts) + 3
    for r in got:
        text = "again" if r.doc_id is None or (r.doc_id == 7 and bytes(r.ids)[4:] == b"") else texts[r.doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    if group > 50:
        return
    assert coded(docs.limit(0)).count() == 0
    assert coded(docs.select("*", F.lit("x").alias("ids"), F.lit("x").alias("decoded"))).count() == len(got)


def test_both_ways_are_taken_and_agree(vocabulary):
    parts = list({p for t in odd_texts() if t for p in vocabulary.parts(t) if isinstance(p, str)})
    tokens, failing = vocabulary.tokenize(parts)
    assert 100 < len(failing) < len(parts) - 100
    assert [vocabulary.merge(p) for p in parts] == tokens


def test_words_about_as_long_as_the_longest_tokens(vocabulary):
    long = sorted((t.rstrip(bpe.END) for t in vocabulary.tokens), key=len)[-40:]
    parts = [t[:n] + x + bpe.END for x in ("", "a", "ab", "z" * 40) for t in long for n in (len(t) - 1, len(t))]
    for order in (parts, parts[::-1]):
        vocabulary._tries.clear()
        assert vocabulary.tokenize(order)[0] == [vocabulary.merge(p) for p in order]


def test_a_pair_stands_when_merging_its_letters_gives_it(vocabulary):
    rnd = np.random.default_rng(3)
    opens = [i for s, i in vocabulary.tokens.items() if not s.endswith(bpe.END)]
    spelled = {i: s for s, i in vocabulary.tokens.items()}
    a, b = rnd.choice(opens, 3000), rnd.choice(list(spelled), 3000)
    ends = [spelled[y] + ("" if spelled[y].endswith(bpe.END) else "!" + bpe.END) for y in b.tolist()]
    bad = vocabulary.broken(a, b)
    for x, y, end, broken in zip(a.tolist(), b.tolist(), ends, bad.tolist()):
        if end.endswith("!" + bpe.END) and spelled[y] != end:
            continue
        assert (vocabulary.merge(spelled[x] + end) != [x, y]) == broken
    assert 0 < bad.sum() < len(bad)


def test_the_query_s_digests(spark, library):
    import hashlib

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in JOBS["op13_byte_pair_round_trip"][0](spark, SMALL).collect():
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
