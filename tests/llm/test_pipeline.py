"""The pipeline's stages, one after the other, against plain versions on a small table with nulls, repeats and clashing columns."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from clauseloom.llm import bpe, decontaminate

from .conftest import table
from .test_corpus import LOWER, brute_components

ITEM = "the quick brown fox jumps over the lazy dog while seventeen judges watch from the old stone bridge"


def rows_of():
    r = random.Random(31)
    prose = lambda n: " ".join(f"{r.choice('abcdefgh')}{r.randrange(500)}" for _ in range(n))
    shared = "This very line stands in many of the documents of this table."
    rows = [(i, f"{prose(60)}\n{shared}\n{prose(20)}") for i in range(1, 12)]
    rows += [(20 + i, rows[i][1].replace("\n", "\n ")) for i in range(3)]  # near copies
    rows += [rows[4], (4, prose(40)), (None, prose(30)), (None, None), (40, None), (41, ""), (42, "\n\n"), (43, "one"), (44, f"x {ITEM} y"), (45, prose(5000)), (46, shared), (47, f"{prose(9)} ééé 漢字 \U0001f600")]
    return rows


def after_lines(rows):
    rank = lambda i: -(2**63) if i is None else i
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held: dict = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                held.setdefault(key(line), set()).add(rank(i))
    keep = lambda i, line: not (len(held.get(key(line), ())) >= 3 and max(held[key(line)]) != rank(i))
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if keep(i, x))) for i, t in rows]


def same(got, want, null_is_empty=False):
    show = lambda rows: sorted(((i, t or "" if null_is_empty else t) for i, t in rows), key=repr)
    assert show(got) == show(want)


def pairs(df):
    return [(x.doc_id, x.text) for x in df.select("doc_id", "text").collect()]


@pytest.fixture
def folder(spark, tmp_path):
    rows = rows_of()
    docs = table(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en")).withColumn("n_chars", F.lit(None).cast("long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, None), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM, 7), (None, "x", 8), (2, None, 9)], "item_id long, text string, did long").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows


def test_stages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    docs = P.keep_good_documents(spark, docs, path)
    assert docs.columns == columns
    same(pairs(docs), rows)
    docs = P.drop_repeated_lines(spark, docs, path)
    rows = after_lines(rows)
    assert docs.columns == columns
    same(pairs(docs), rows, null_is_empty=True)
    rows = pairs(docs)
    docs = P.keep_one_of_near_duplicates(spark, docs, path)
    classes = brute_components([x for x in rows if x[0] is not None], 5)
    rows = [(i, t) for i, t in rows if i is None or classes.get(i, i) == i]
    assert docs.columns == columns
    same(pairs(docs), rows, null_is_empty=True)
    docs = P.drop_contaminated(spark, docs, path)
    rows = [(i, t) for i, t in rows if f" {decontaminate.normal(ITEM)} " not in f" {decontaminate.normal(t)} "]
    assert docs.columns == columns and all(i != 44 for i, _ in rows)
    same(pairs(docs), rows, null_is_empty=True)
    import public_tokenizers
    import tiktoken

    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.vocabulary_path()), special_tokens={})
    ids = [(i, e.encode_ordinary(t or ""), t or "") for i, t in rows]
    want = sorted(((i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, x, t in ids), key=repr)
    encoded = P.encode(spark, docs, path)
    assert sorted((tuple(x) for x in encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=repr) == want
    whole = P.run(spark, path)
    assert sorted((tuple(x) for x in whole.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=repr) == want


def test_empty_tables(spark, folder, tmp_path):
    path, _ = folder
    empty = f"{tmp_path}/empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert P.run(spark, empty).count() == 0
