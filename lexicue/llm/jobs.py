"""The training-data operators applied to their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexicue.llm import (
    bpe, fingerprints, jaccard, langid, lexical, mixing, negatives, packing, quality, scoring, secrets, shards, warc,
)
from lexicue.llm.common import id_crc, read

#: name -> (function of the session and the folder, SQL that gives the same rows or None)
JOBS: dict = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A vocabulary file of the installed public tokenizers; the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def job(name: str, sql: str | None = None):
    def add(fn):
        JOBS[name] = (fn, sql)
        return fn

    return add


@job("op5_secret_spans")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.find(read(spark, folder, "documents", "doc_id", "text"))


@job("op6_hyperdimensional_language")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text", "lang")
    names, prototypes = langid.train(docs.where(id_crc("doc_id") % 5 != 0))
    return langid.predict(docs, names, prototypes, held=id_crc("doc_id") % 5 == 0)


@job("op10_likelihood_ratio_rules")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text")
    model = quality.fit(docs, read(spark, folder, "labels", "doc_id", "quality", "toxic"))
    return quality.judge(docs, model).drop("text_hash")


@job("op3_hypergeometric_shards")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return shards.deal(read(spark, folder, "documents", "doc_id", "text"))


@job("op1_pfair_mixture")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    mix = mixing.schedule(read(spark, folder, "documents", "doc_id", "source"))
    names = ("block", "slot", "release", "deadline", "position")
    return mix.select("doc.doc_id", "doc.source", *[F.col(n).cast("long").alias(n) for n in names])


@job("op7_histogram_packing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read(spark, folder, "documents", "doc_id", "text"), tokenizer_path())


@job("op4_indexed_warc")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive(read(spark, folder, "pages", "page_id", "url", "html")).drop("url")


@job("op2_imatch_fingerprints")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprints(read(spark, folder, "documents", "doc_id", "text"))


@job("op8_gated_recurrent_scores")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text")
    held = id_crc("doc_id") % 7 == 2
    return scoring.train_and_score(docs, ~held, held)


LINKS = """WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
reach AS (SELECT doc_id AS root, doc_id FROM documents UNION SELECT root, l.b FROM reach JOIN l ON l.a = reach.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(reach.root) AS component_id
FROM documents d JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY ALL"""


@job("op9_set_relation_join", LINKS)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.duplicates(read(spark, folder, "documents", "doc_id", "text")).drop("_key")


@job("op12_lexical_search", lexical.SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(read(spark, folder, "documents", "doc_id", "text"), read(spark, folder, "benchmark", "item_id", "text"))


@job("op13_byte_pair_round_trip")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    path = tokenizer_path()
    coded = bpe.decode(bpe.encode(read(spark, folder, "documents", "doc_id", "text"), path), path)
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@job("op11_strassen_hard_negatives", negatives.SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read(spark, folder, "embeddings", "vec_id", "embedding", "label")
    noise = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors, F.col("id") % 50 == 0, noise=noise)
