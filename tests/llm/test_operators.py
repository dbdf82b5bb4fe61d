"""Each operator against a brute-force version on odd inputs, clashing columns and empty tables."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction
from itertools import islice

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexicue.llm import fingerprints, gru, jaccard, langid, mixing, packing, quality, scoring, secrets, shards, warc
from lexicue.llm.common import id_crc
from lexicue.llm.components import components
from lexicue.llm.jobs import JOBS, tokenizer_path
from tests.llm import data

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return data.documents(spark).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(100 + i, 1, 0) for i in range(0, 90)] + [(14, 0, None), (None, 1, 0)], "doc_id long, quality int, toxic int")


def same_with_more_columns(op, df, *cols):
    assert data.multiset(op(df), *cols) == data.multiset(op(data.clashing(df)), *cols)
    assert op(df.limit(0)).count() == 0


# 1

def test_periods_meet_every_window():
    for weights in ({"a": 7, "b": 2, "c": 1}, {"a": 1, "b": 1}, {"a": 333, "b": 332, "c": 335}, {"x": 1}):
        quota = mixing.quotas(weights, 1000)
        assert sum(quota.values()) == 1000
        seen = collections.Counter()
        for t, s in enumerate(mixing.one_period(quota, 1000)):
            j = seen[s]
            assert j * 1000 // quota[s] <= t < -(-(j + 1) * 1000 // quota[s])
            seen[s] += 1
            for k, q in quota.items():
                assert abs(seen[k] - q * (t + 1) / 1000) < 1
        assert seen == quota


def test_mixture_is_the_sequential_schedule(docs):
    got = mixing.schedule(docs, {"a": 5, "b": 2, "s0": 1}, block=4, period=50).collect()
    assert len(got) == docs.count() and len({r["position"] for r in got}) == len(got)
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    blocks = {r["slot"]: (r["doc"]["source"], r["block"]) for r in got}
    assert sorted(blocks) == list(range(len(blocks)))
    counts = collections.Counter(r["doc"]["source"] for r in got)
    want, done = [], collections.Counter()
    for p in mixing.plan({s: -(-n // 4) for s, n in counts.items()}, {s: {"a": 5, "b": 2}.get(s, 1) for s in counts}, 50):
        order = mixing.one_period(p.quota, p.period)
        for t in range(p.slots):
            s = order[t % p.period]
            want.append((s, done[s]))
            done[s] += 1
    assert [blocks[i] for i in range(len(blocks))] == want
    same_with_more_columns(lambda d: mixing.mixed(d), docs, *docs.columns)
    assert data.multiset(mixing.mixed(docs)) == data.multiset(docs)


@pytest.mark.parametrize("weights", [
    {"a": 7, "b": 2, "c": 1}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 12345**0.5, "b": 678**0.5, "c": 9**0.5},
    {"big": 99, **{f"s{i}": 2 for i in range(99)}}, {"a": 10_007, "b": 1},
])
def test_shares_follow_the_given_weights(weights):
    total = sum(map(Fraction, weights.values()))
    phase = mixing.plan(dict.fromkeys(weights, 20_000), weights)[0]
    assert phase.slots > 19_000
    seen = collections.Counter()
    for t, (s, release, deadline) in enumerate(islice(mixing.slots(phase.quota, phase.period), phase.slots)):
        w = Fraction(weights[s]) / total
        assert (release, deadline) == (math.floor(seen[s] / w), math.ceil((seen[s] + 1) / w)) and release <= t < deadline
        seen[s] += 1
        if t % 97 == 0:
            assert all(abs(seen[k] - Fraction(x) / total * (t + 1)) < 1 for k, x in weights.items())
    assert seen == phase.used


def test_mixture_without_a_short_period(docs):
    weights = {"a": 2**0.5, "b": 3**0.5, "c": 0.7, "s0": 1}
    got = mixing.schedule(docs, weights, block=1).collect()
    names = collections.Counter(r["doc"]["source"] for r in got)
    phases = mixing.plan(dict(names), {s: weights.get(s, 0.7) for s in names})
    want = [s for p in phases for s, _, _ in islice(mixing.slots(p.quota, p.period), p.slots)]
    assert [r["doc"]["source"] for r in sorted(got, key=lambda r: r["position"])] == want
    assert len(got) == docs.count() and all(r["release"] <= r["slot"] < r["deadline"] for r in got)


# 2

def test_fingerprints(docs):
    got = fingerprints.fingerprints(docs)
    rows = got.collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    order = sorted((x for x in data.rows() if x[0] != 12 and x[0] is not None), key=lambda x: x[0])
    for (i, t, *_), (j, u, *_) in zip(order, order[1:]):
        if 12 in range(i, j) or i == 12:
            continue
        t, u = t or "", u or ""
        q = len(t) // 4
        assert by[i][0]["n_chars"] == len(t)
        assert by[i][0]["edited_sha256"] == hashlib.sha256((t[: len(t) - q] + u[:q]).encode()).hexdigest()
    assert len(rows) == docs.count()
    texts = collections.defaultdict(set)
    for r, t in [(r, x[1]) for x in order for r in by[x[0]]]:
        texts[t or ""].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(v) == 1 for v in texts.values())
    assert by[1][0]["near_next"] == 1.0  # the next document has the same text
    own = [r["near_edited"] for r in rows if r["n_chars"] > 200]
    other = [r["near_next"] for r in rows if r["n_chars"] > 200]
    assert np.mean(own) > np.mean(other)
    same_with_more_columns(fingerprints.fingerprints, docs, "doc_id", "edited_sha256", "fingerprint", "near_next")


# 3

def test_shards(docs):
    rows = shards.deal(docs, part_rows=30).collect()
    assert len(rows) == docs.count()
    sizes = collections.Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(8))
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    want = collections.Counter((x[0], len((x[1] or "").encode()) + 1, zlib.crc32((x[1] or "").encode())) for x in data.rows())
    assert want == collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows)
    assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}
    same_with_more_columns(shards.deal, docs, "doc_id", "shard", "slot")


def test_communication_matrix_is_uniform_among_deals():
    parts, ends = [4, 3, 5], [6, 6]
    seen = collections.Counter(tuple(map(tuple, shards.communication_matrix(parts, ends, s))) for s in range(6000))
    total = math.comb(12, 6)
    for m, n in seen.items():
        assert [sum(r) for r in m] == parts and [sum(c) for c in zip(*m)] == ends
        p = math.prod(math.comb(a, r[0]) for a, r in zip(parts, m)) / total
        assert abs(n - 6000 * p) < 6 * math.sqrt(6000 * p) + 6


def test_large_populations_are_drawn_exactly_enough():
    rng = np.random.default_rng(1)
    x = [shards.hypergeometric(rng, 10**9, 7 * 10**9, 10_000) for _ in range(3000)]
    assert abs(np.mean(x) - 1250) < 4 and abs(np.var(x) / 1093.75 - 1) < 0.15


# 4

PAGES = [(1, "u1", "<p>a</p>"), (2, "u2", "<p>a</p>"), (3, None, "<p>a</p>"), (4, "u\r\n4", ""), (5, "u5", None), (6, "u6", "é" * 5000), (None, "n", "<p>a</p>"), (7, "u7", "x\r\n\r\ny")]


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r for r in warc.archive(pages).collect()}
    assert len(got) == len(PAGES)
    last = {h or "": max(x[0] for x in PAGES if (x[2] or "") == (h or "") and x[0] is not None) for _, _, h in PAGES}
    for i, _, h in PAGES:
        b, r = (h or "").encode(), got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        top = last[h or ""]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if top == i else ("revisit", top))
    index = warc.write(pages, str(tmp_path), archive_bytes=100)
    assert index.select("archive").distinct().count() > 1
    one = index.where("page = 6")
    assert warc.read(one, str(tmp_path), payload=True).first()["payload"] == ("é" * 5000).encode()
    for size, gap in ((1, 0), (1 << 20, 1 << 20)):
        covered = warc.ranges(index, size, gap).select("archive", F.explode("records").alias("r")).select("archive", "r.*")
        assert data.multiset(covered) == data.multiset(index, "archive", "offset", "length")
    same_with_more_columns(warc.archive, pages, "page_id", "refers_to")


def test_damaged_records_are_refused():
    data_, _ = warc.record("1", "u", b"abc", None)
    assert warc.parse(data_)["payload"] == b"abc"
    for bad in (data_[:-1], data_.replace(b"abc", b"abd")):
        with pytest.raises(ValueError):
            warc.parse(bad)


# 5

def test_base_spans_are_the_patterns():
    assign = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for t in [x[1] or "" for x in data.rows()] + ["TOKEN:abc token = 'abcdefgh1' aPi_kEy=\"12345678\"", "ſecret=abcdefgh1 toKen=abcdefgh", "AKIA AKIAAKIA0123456789 " + "f" * 31 + " " + "0" * 70]:
        want = [(m.start(), m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 8]
        want += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        want += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
        assert sorted(want) == sorted(secrets.base_spans(t))
        assert set(want) <= set(secrets.spans(t))


@pytest.mark.parametrize("text,found", [
    ('part = "Zk9a"\npassphrase = part + "Lq8xPP01"', ["Zk9a", "Lq8xPP01"]),
    ('k = "qW8rT5yU"; j = k; auth_key = j', ["qW8rT5yU"]),
    ('auth_key = later; later = "qW8rT5yU"', ["qW8rT5yU"]),
    ('cfg["private_key"] = "Zx81kQp02mAAz"', ["Zx81kQp02mAAz"]),
    ("credentials: Zx81kQp02mAAz", ["Zx81kQp02mAAz"]),
    ('token_count = "Zx81kQp02mAAz"', []), ('auth_key = "changeme_now1"', []), ('title = "Zx81kQp02mAAz"', []),
    ("a = b; b = a; auth_key = a", []),
])
def test_named_spans(text, found):
    assert sorted(text[a:b] for a, b, k in secrets.spans(text) if k == "named") == sorted(found)


@pytest.mark.parametrize("text", [
    'db_pwd: str = "Tr0ub4dor&3x!"', 'const dbPassword: string = "Tr0ub4dor&3x!"', 'db_pwd: Optional[str] = "Tr0ub4dor&3x!"',
    'db_pwd: str | None = "Tr0ub4dor&3x!"', 'note: pwd = "Tr0ub4dor&3x!"', 'a = pwd = "Tr0ub4dor&3x!"', 'pwd = a = "Tr0ub4dor&3x!"',
    'pwd\t=\t"Tr0ub4dor&3x!"', 'pwd  =  "Tr0ub4dor&3x!"', 'pwd = """Tr0ub4dor&3x!"""', "pwd = \'\'\'Tr0ub4dor&3x!\'\'\'", 'pwd = b"Tr0ub4dor&3x!"',
    'pwd = "Tr0ub4"+"dor&3x!"', 'p = "Tr0ub4"\npwd = p+"dor&3x!"', 'p = "dor&3x!"\npwd = "Tr0ub4"+p',
])
def test_forms_of_assignment(text):
    got = sorted(s for s in secrets.spans(text) if s[2] == "named")
    assert "".join(text[a:b] for a, b, _ in got) in ("Tr0ub4dor&3x!", "dor&3x!Tr0ub4")


def test_names_are_followed_to_the_end():
    named = lambda t: [t[a:b] for a, b, k in secrets.spans(t) if k == "named"]
    pieces = [f"{chr(65 + i % 26)}{i:02d}" for i in range(70)]
    assert named("p = " + " + ".join(f'"{x}"' for x in pieces) + "\nauth_key = p") == pieces
    assert named('auth_key = a; a = b; b = "qW8rT5yU"') == ["qW8rT5yU"]
    assert named("k = Zx81kQp02mAAz\nj = k\nauth_key = j") == ["Zx81kQp02mAAz"]
    chain = "auth_key = n0\n" + "".join(f"n{i} = n{i + 1}\n" for i in range(3000)) + 'n3000 = "qW8rT5yU"'
    assert named(chain) == ["qW8rT5yU"]
    assert named('a = "Zk9aLq"\nauth_key = a + a') == ["Zk9aLq"]
    doubled = 'n0 = "qW8rT5yU"\n' + "".join(f"n{i + 1} = n{i} + n{i}\n" for i in range(60)) + 'n61 = n60 + "Lq8xPP01"\nauth_key = n61'
    assert named(doubled) == ["qW8rT5yU", "Lq8xPP01"]


@pytest.mark.parametrize("text,found", [
    ("auth_key = Zx81kQ=p02mAAz", ["Zx81kQ=p02mAAz"]), ("auth_key = Zx81kQp02mAAz: note", ["Zx81kQp02mAAz"]),
    ("auth_key: Zx81kQp02mAAz==", ["Zx81kQp02mAAz=="]), ("auth_key = a == b", []), ('title: str = "Zx81kQp02mAAz"', []),
])
def test_values_that_look_like_targets(text, found):
    assert sorted(text[a:b] for a, b, k in secrets.spans(text) if k == "named") == found


def test_secret_rows_and_redaction(docs):
    got = {(r["doc_id"], r["spans"]) for r in secrets.find(docs).collect()}
    assert got == {(x[0], ",".join(f"{k}:{a}:{b}" for a, b, k in secrets.spans(x[1] or ""))) for x in data.rows()}
    same_with_more_columns(secrets.find, docs, "doc_id", "base_sha256", "spans")
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert secrets.find(clean).agg(F.sum("n_assign") + F.sum("n_access") + F.sum("n_hex")).first()[0] == 0
    kept = docs.where("doc_id <> 13 or doc_id is null")
    assert data.multiset(secrets.redact(kept)) == data.multiset(kept)


# 6

def test_bundles_are_sums_of_bound_letters():
    b = langid.Bundler(64)
    v = lambda c, k: np.roll(langid.letter_vector(ord(c), 64), k).astype(float)
    for text in ("Ab, c", "abc中abc", "éa"):
        s = " " + re.sub(r"[^\w]|[\d_]", " ", text.lower()) + " "
        s = re.sub(r" +", " ", s)
        want = sum(v(s[i], 2) * v(s[i + 1], 1) * v(s[i + 2], 0) for i in range(len(s) - 2))
        assert np.array_equal(b.bundle([text], [0], 1)[0], want)
    alone = [b.bundle([t], [0], 1)[0] for t in ("abc", "", "xyz xyz", "...")]
    assert np.array_equal(b.bundle(["abc", "", "xyz xyz", "..."], [0, 1, 2, 3], 4), np.array(alone))


def test_languages(docs, spark):
    names, p = langid.train(docs.where(id_crc("doc_id") % 5 != 0), dims=128)
    got = langid.predict(docs, names, p)
    assert got.count() == docs.count()
    for r in got.where("doc_id in (4, 5, 6)").collect():
        assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert got.where("lang_pred not in ('en', 'fr', 'de', 'und') or score < 0 or score > 1").count() == 0
    same_with_more_columns(lambda d: langid.predict(d, names, p), docs, "doc_id", "lang_pred", "score")
    none, q = langid.train(docs.limit(0), dims=128)
    assert {r["lang_pred"] for r in langid.predict(docs, none, q).collect()} == {"und"}


def test_held_out_accuracy(spark):
    rows = JOBS["op6_hyperdimensional_language"][0](spark, "/root/testdata/sf0.01").where("held_out")
    true = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").where("lang is not null")
    assert rows.join(true, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


# 7

def test_plan_places_every_piece_once():
    rnd = np.random.default_rng(2)
    for cap, n in ((10, 40), (64, 500), (4096, 3000)):
        counts = collections.Counter(int(x) for x in rnd.integers(1, cap + 1, n))
        used = collections.defaultdict(list)
        for p in packing.plan(counts, cap):
            for q in range(p.rank, p.end):
                i = q - p.rank
                used[p.sequence + i // p.each].append((p.offset + i % p.each * p.length, p.length))
        assert collections.Counter(x for v in used.values() for _, x in v) == counts
        for v in used.values():
            end = 0
            for at, x in sorted(v):
                assert at == end
                end += x
            assert end <= cap
        free: list[int] = []  # best-fit decreasing over the pieces themselves
        for x in sorted(counts.elements(), reverse=True):
            fit = [r for r in free if r >= x]
            if fit:
                free.remove(min(fit))
                free.append(min(fit) - x)
            else:
                free.append(cap - x)
        assert len(used) == len(free)


def test_words_give_the_tokenizers_ids():
    from tokenizers import Tokenizer

    path = tokenizer_path()
    words, whole = packing.Words(path), Tokenizer.from_file(path)
    texts = [x[1] or "" for x in data.rows() if len(x[1] or "") < 40_000]
    texts += ["a<|endoftext|>b c <|startoftext|> d", "Σ ΑΣ é x\x1cy\x0bz q  \t\n don't 's", "ẛ̣ 가 1234 x2y #!?"]
    for t in texts:
        assert np.frombuffer(words.ids(t), np.uint32).tolist() == whole.encode(t, add_special_tokens=False).ids


def test_packing(docs):
    rows = packing.pack(docs, tokenizer_path()).collect()
    words = packing.Words(tokenizer_path())
    want = collections.Counter()
    for i, t, *_ in data.rows():
        ids = words.ids(t or "") + (1).to_bytes(4, "little")
        for k, a in enumerate(range(0, len(ids), 4 * 4096)):
            part = ids[a : a + 4 * 4096]
            want[i, k, a // 4, len(part) // 4, zlib.crc32(part)] += 1
    assert want == collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    used = collections.defaultdict(list)
    for r in rows:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in used.values():
        end = 0
        for at, x in sorted(v):
            assert at == end
            end += x
        assert end <= 4096
    assert len(used) <= sum(r["length"] for r in rows) / 4096 * 1.2 + 1
    same_with_more_columns(lambda d: packing.pack(d, tokenizer_path()), docs, "doc_id", "piece", "length", "ids_crc32")


# 8

def test_gradients_and_whole_text_scores(monkeypatch):
    monkeypatch.setattr(gru, "WIDTH", 4)
    rng = np.random.default_rng(0)
    p = {k: v + rng.standard_normal(v.shape) * 0.3 for k, v in gru.fresh(rng.integers(1, 9, 12).astype(float), 5).items()}
    s, t, w, h0 = rng.integers(0, 12, (6, 3)), rng.integers(0, 12, (6, 3)), np.ones((6, 3)), rng.standard_normal((3, 5))
    w[5, 1] = 0
    _, g, (sym, rows), _ = gru.gradients(p, h0, s, t, w)
    g["win"] = np.zeros_like(p["win"])
    np.add.at(g["win"], sym, rows)
    for k in p:
        for _ in range(6):
            i, e = tuple(rng.integers(0, d) for d in p[k].shape), 1e-5
            old = p[k][i]
            p[k][i] = old + e
            up = gru.gradients(p, h0, s, t, w)[0]
            p[k][i] = old - e
            down = gru.gradients(p, h0, s, t, w)[0]
            p[k][i] = old
            assert abs((up - down) / 2 / e - g[k][i]) < 1e-4 * (1 + abs(g[k][i]))
    texts = [np.append(rng.integers(1, 12, n), 0) for n in (0, 5, 70, 33, 1)]
    for text, got in zip(texts, gru.score(p, texts, lanes=2, together=4)):
        h, before, total = np.zeros((1, 5)), 0, 0.0
        for y in text:
            h, _ = gru.step(p, h, np.array([before]))
            total += gru.log_prob(p, h, np.array([y]))[0]
            before = y
        assert abs(total - got) < 1e-3


def test_scores(docs, monkeypatch):
    monkeypatch.setattr(scoring, "KNOWN", 300)  # the other words are joined
    held = id_crc("doc_id") % 7 == 2
    run = lambda d: scoring.train_and_score(d, ~held, held)
    rows = run(docs).collect()
    crc = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    c = collections.Counter(w for x in data.rows() if not crc(x[0]) for w in tokens(x[1]))
    n, v = sum(c.values()), len(c)
    want = collections.Counter(
        (x[0], crc(x[0]), len(t := tokens(x[1])), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 4))
        for x in data.rows()
    )
    assert want == collections.Counter((*r[:5], round(r["base_score"], 4)) for r in rows)
    assert all(r["score"] < 0 for r in rows)
    same_with_more_columns(run, docs, "doc_id", "n_tokens", "n_known")


def test_every_training_text_trains_the_network(docs, monkeypatch):
    own = docs.where(id_crc("doc_id") % 7 != 2)
    counts = scoring.count_words(own).cache()
    vocab, tokens, _, frequency = scoring.vocabulary(counts)
    assert tokens == sum(len((x[1] or "").encode().split()) + 1 for x in own.select("doc_id", "text").collect())
    few, seen = scoring.fit(own, vocab, frequency, tokens)
    assert seen == tokens
    monkeypatch.setattr(scoring, "PART", 300)  # many replicas, averaged in groups
    assert scoring.replicas(tokens) > 16 and scoring.replicas(10 * tokens) > 9 * scoring.replicas(tokens)
    many, seen = scoring.fit(own, vocab, frequency, tokens)
    assert seen == tokens and all(np.isfinite(v).all() and v.shape == few[k].shape for k, v in many.items())


def test_training_works_on_symbols_not_on_ended_lanes(monkeypatch):
    rng, worked, plain = np.random.default_rng(2), [], gru.gradients
    texts = [np.append(rng.integers(1, 256, n), 0) for n in (10,) * 200 + (2000,)]
    monkeypatch.setattr(gru, "gradients", lambda p, h, s, *a: worked.append(s.size) or plain(p, h, s, *a))
    p, seen = gru.train(gru.fresh(np.ones(256)), texts)
    assert seen == sum(map(len, texts)) and all(np.isfinite(v).all() for v in p.values())
    assert sum(worked) < 2 * seen


def test_softmax_has_no_denormal_numbers():
    e = np.array([[0, 90], [-95, 0], [-200, 3]], np.float32)
    top = gru._exp(e)
    assert top.tolist() == [0, 90] and e.min() > 1e-20 and np.allclose(e.sum(0), 1)


def test_a_shuffle_into_more_parts_makes_no_more_replicas(docs, monkeypatch):
    own = docs.where(id_crc("doc_id") % 7 != 2)
    vocab, tokens, _, frequency = scoring.vocabulary(scoring.count_words(own).cache())
    few, seen = scoring.fit(own, vocab, frequency, tokens)
    plain = type(own).repartition
    monkeypatch.setattr(type(own), "repartition", lambda d, n, *by: plain(d, max(n, 23), *by))
    many, again = scoring.fit(own, vocab, frequency, tokens)
    assert seen == again == tokens and all((few[k] == many[k]).all() for k in few)


def test_probabilities_sum_to_one():
    p = gru.fresh(np.arange(1.0, 257.0), 6)
    h = np.random.default_rng(1).standard_normal((1, 6)).astype(np.float32)
    assert abs(np.exp([gru.log_prob(p, h, np.array([i]))[0] for i in range(256)]).sum() - 1) < 1e-3


def _window(seed=5, big=1.0):
    rng = np.random.default_rng(seed)
    p = {k: v + big * rng.standard_normal(v.shape) * 0.3 for k, v in gru.fresh(rng.integers(1, 99, 256).astype(float), 6).items()}
    p = {k: v.astype(np.float64) for k, v in p.items()}
    syms, targets = rng.integers(0, 256, (7, 30)), rng.integers(0, 256, (7, 30))
    return p, rng.uniform(-1, 1, (30, 6)), syms, targets, np.ones((7, 30))


def test_near_logits_need_no_largest(monkeypatch):
    p, h, *window = _window()
    loss, g, win, _ = gru.gradients(p, h, *window)
    texts = [np.append(t[t > 0], 0) for t in window[0]]
    scores = gru.score(p, texts)
    with monkeypatch.context() as m:
        m.setattr(gru, "_exp", lambda e: 1 / 0)
        assert gru.gradients(p, h, *window)[0] == loss and (gru.score(p, texts) == scores).all()
    monkeypatch.setattr(gru, "REACH", -1)  # now every softmax is shifted by its largest logit
    other, shifted, rows, _ = gru.gradients(p, h, *window)
    assert np.isclose(loss, other) and all(np.allclose(g[k], shifted[k]) for k in g) and np.allclose(win[1], rows[1])
    assert np.allclose(gru.score(p, texts), scores)


def test_far_logits_are_shifted():
    p, h, *window = _window(big=2000.0)
    p["win"], p["u"] = p["win"] / 2000, p["u"] / 2000
    loss, g, *_ = gru.gradients(p, h, *window)
    assert np.isfinite(loss) and loss > 0 and all(np.isfinite(v).all() for v in g.values())


def test_each_symbol_gets_one_row_of_gradient():
    p, h, *window = _window()
    _, _, (syms, rows), _ = gru.gradients(p, h, *window)
    assert syms.tolist() == sorted(set(window[0].ravel().tolist())) and rows.shape == (len(syms), 18)


ODD_TEXTS = [None, "", " ", "\n\n", "a", " A  b ", "x\t\x0b\x0c\r y\n", "\x1c a\x85b\xa0\u2003C", "\u0130X \u00e9\u00c9 \u4e2d\u6587 \U0001f600", "\x00 \x00z"]


def test_words_of_texts_and_their_slots():
    plain = [(t or "").encode().lower().split() + [b""] for t in ODD_TEXTS]
    for texts in (pa.array(ODD_TEXTS), pa.array(["first", *ODD_TEXTS, "last"]).slice(1, len(ODD_TEXTS))):
        words, ends = scoring.words_of(texts)
        got = words.cast(pa.binary()).to_pylist()
        assert [got[i:j] for i, j in zip(ends, ends[1:])] == plain
        assert scoring.slots_of(words).tolist() == [scoring.slot(w) for w in got]
        assert scoring.slots_of(words.slice(2, 3)).tolist() == [scoring.slot(w) for w in got[2:5]]
    assert scoring.slots_of(pa.array([], pa.string())).tolist() == []


def test_slices_are_bounded_in_rows_and_bytes(monkeypatch):
    monkeypatch.setattr(scoring, "ROWS", 4)
    monkeypatch.setattr(scoring, "BYTES", 10)
    texts = ["aaaa", "bbbb", None, "c", "d" * 50, *[""] * 9, "eeeeeeeee", "ff"]
    parts = [b.column(0).to_pylist() for b in scoring.slices(pa.record_batch([pa.array(texts)], names=["t"]), 0)]
    assert [t for p in parts for t in p] == texts
    assert all(len(p) <= 4 and (len(p) == 1 or sum(len(t or "") for t in p) <= 10) for p in parts)


def test_counts_of_words_merged_in_a_task(docs, monkeypatch):
    want = collections.Counter(w for x in data.rows() for w in [*(x[1] or "").encode().lower().split(), b""])
    for held in (scoring.HELD, 3):
        monkeypatch.setattr(scoring, "HELD", held)
        rows = scoring.count_words(docs).collect()
        assert {r["word"].encode(): r["n"] for r in rows} == want and len(rows) == len(want)
        assert all(r["slot"] == scoring.slot(r["word"].encode()) for r in rows)


# 9

def brute_components(rows, width, percent):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(r[0], least.get(root(i), r[0]))
    return [(r[0], len(sets[i]), r[0] if not sets[i] else least.get(root(i))) for i, r in enumerate(rows)]


def family(seed, n, words, edits):
    """Copies of one text with some words changed each: many pairs close to the threshold."""
    import random

    rnd, base = random.Random(seed), data.prose(seed, words, 5000).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randrange(edits + 1)):
            w[rnd.randrange(words)] = f"e{rnd.random()}"
        out.append(" ".join(w))
    return out


def test_components_of_links(docs, spark):
    got = jaccard.duplicates(docs).select("doc_id", "n_shingles", "component_id")
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(brute_components(data.rows(), 4, 85))
    rows = [(i, t) for i, t in enumerate(family(1, 60, 100, 5) + family(2, 40, 300, 14) + family(3, 3, 40, 1) + ["short text here"] * 3)]
    many = spark.createDataFrame(rows, "doc_id long, text string")
    for width, percent in ((4, 85), (5, 80)):
        got = jaccard.duplicates(many, width=width, percent=percent).select("doc_id", "n_shingles", "component_id")
        want = brute_components(rows, width, percent)
        assert sorted(map(tuple, got.collect())) == sorted(want)
        kept = {r["doc_id"] for r in jaccard.deduplicated(many, width=width, percent=percent).collect()}
        assert kept == {c for _, _, c in want}
    same_with_more_columns(jaccard.duplicates, docs, "doc_id", "component_id")


def test_parities_bound_the_overlap():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n, m, c = rng.integers(1, 3000), rng.integers(1, 3000), 0
        x, y = (np.unique(rng.integers(0, 1 << 63, k).astype(np.uint64)) for k in (n, m))
        c = int(rng.integers(0, min(len(x), len(y)) + 1))
        y = np.unique(np.concatenate([x[:c], y[c:]]))
        common = len(np.intersect1d(x, y))
        assert common <= jaccard.most_common(jaccard.parities(x), jaccard.parities(y), len(x), len(y)) <= min(len(x), len(y))
    x = np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64))
    y = np.unique(np.concatenate([x[:420], rng.integers(0, 1 << 63, 80).astype(np.uint64)]))
    assert jaccard.most_common(jaccard.parities(x), jaccard.parities(y), 500, 500) < 440  # close enough to rule the pair out


def test_one_row_of_each_group_stays(docs):
    kept = jaccard.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = collections.Counter(r["doc_id"] for r in kept.collect())
    assert ids[1] == 1 and not ids[2] and not ids[3] and ids[4] == ids[5] == ids[6] == 1 and ids[12] == 1
    same_with_more_columns(jaccard.deduplicated, docs, *docs.columns)


def test_connected_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (95, 100), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(path, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 10

def surface(t):
    w = BLANK.findall(t or "")
    c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if BLANK.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(again)


def test_quality_rules(docs, labels):
    model = quality.fit(docs, labels)
    rows = quality.judge(docs, model).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = collections.Counter((x[0], *surface(x[1])) for x in data.rows())
    assert want == collections.Counter((r["doc_id"], *(r[n] for n in names)) for r in rows)
    import xxhash

    bucket = lambda *w: _chain(xxhash, w) % quality.BUCKETS
    means = {}
    for _, t, *_ in data.rows():
        w = [x.lower() for x in BLANK.findall(t or "")]
        f = [bucket(x) for x in w] + [bucket(a, b) for a, b in zip(w, w[1:])]
        means[surface(t), (t or "")[:9]] = sum(model.weights[i] for i in f) / len(f) / quality.SCALE if f else None
    assert collections.Counter(None if m is None else round(m, 9) for m in means.values()).keys() == {
        None if r["score"] is None else round(r["score"], 9) for r in rows
    }
    for r in rows:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["score"] >= model.threshold)
    assert data.multiset(quality.accepted(docs, model), "doc_id") == sorted(repr(r) for r in quality.judge(docs, model).where("kept").select("doc_id").collect())
    same_with_more_columns(lambda d: quality.judge(d, model), docs, "doc_id", "score", "kept")
    assert quality.fit(docs, labels.limit(0)).threshold is None
    assert quality.accepted(data.clashing(docs), model).columns == data.clashing(docs).columns


def _chain(xxhash, words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return seed if seed < 1 << 63 else seed - (1 << 64)


def test_quality_target_takes_every_trusted_document(spark):
    docs = spark.range(24_000).select(F.col("id").alias("doc_id"), F.lit("aa").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    fitted = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(4)) != 0).count()
    share = lambda n: math.log((n + quality.SMOOTHING) / (n + quality.SMOOTHING * quality.BUCKETS))
    assert round(quality.SCALE * (share(fitted) - share(24_000))) in quality.fit(docs, labels).weights


def test_percentiles_are_exact(spark, monkeypatch):
    monkeypatch.setattr(quality, "FEW", 20)
    rnd = random.Random(5)
    values = [rnd.choice((0.5, -0.25, rnd.gauss(0, 1), rnd.gauss(0, 1e-9))) for _ in range(5_000)] + [1e6]
    df = spark.createDataFrame([(v,) for v in values], "score double")
    want = df.agg(F.percentile("score", F.array(F.lit(0.01), F.lit(0.5), F.lit(1.0)))).first()[0]
    assert quality.percentiles(df, [0.01, 0.5, 1.0]) == pytest.approx(want, abs=1e-12)
    assert quality.percentiles(df.limit(0), [0.5]) is None


def test_near_copies_find_their_group_without_being_compared_with_all(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(500):
        words = list(base)
        for at in rng.choice(150, 1 + i % 2, replace=False):
            words[at] = f"x{i}-{at}"
        rows.append((i, " ".join(words)))
    compared, possible = [], jaccard._possible
    monkeypatch.setattr(jaccard, "_possible", lambda pairs, *rest: compared.append(pairs.count()) or possible(pairs, *rest))
    got = jaccard.duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id")
    assert {tuple(r) for r in got.collect()} == set(brute_components(rows, 4, 85))
    assert max(compared) < 25 * len(rows), compared
