"""Byte-level BPE against the library that defines it."""

import base64
import hashlib
import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from factloom.llm import bpe, sstable
from factloom.llm import queries as q

PATH = sstable.path_of("byte_bpe_multi_50k.tiktoken")
PATTERN = bpe.RankEncoder.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.RankEncoder(PATH, PATTERN, 1000)


def odd_texts(n):
    rnd = random.Random(5)
    signs = "abcdefgh  \n\tABCÄäß'stre12390.,!?;: \x1c\x85日本語🙂éñ\r\x0b-_/\\<>​中"
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(60))) for _ in range(n)]
    words = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(2, 40))) for _ in range(n)]
    long = ["a" * k for k in (2, 3, 255, 256, 257, 5000)] + ["ab" * 3000 + " x", "🙂" * 300, "".join(rnd.choice("abcdefgh") for _ in range(4000))]
    return texts + words + long + ["", " ", "  ", "\n\n  x", "<|endoftext|>"]


def test_ids_equal_the_library(encoder, library):
    texts = odd_texts(4000)
    ids, start = encoder.encode_all([t.encode() for t in texts])
    for i, text in enumerate(texts):
        own = ids[start[i] : start[i + 1]]
        assert own.tolist() == library.encode_ordinary(text), text[:50]
        assert encoder.decode(own) == text.encode()


def test_both_trees_agree(encoder):
    rnd = random.Random(6)
    pieces = ["".join(rnd.choice("abcdee t") for _ in range(rnd.randrange(2, 200))).encode() for _ in range(300)]
    for piece in pieces:
        leaves = 1 << (len(piece) - 1).bit_length()
        ids, count = bpe.merged_rows(encoder.ranks, [piece], leaves)
        assert ids.tolist() == bpe.merged_alone(encoder.ranks, piece).tolist() and count.tolist() == [len(ids)]


def test_lowest_rank_and_leftmost_go_first():
    tokens = [bytes([b]) for b in range(256)] + [b"bc", b"ab", b"aa", b"aaaa"]
    ranks = bpe.Ranks(tokens)
    for one in (lambda p: bpe.merged_alone(ranks, p).tolist(), lambda p: bpe.merged_rows(ranks, [p], 1 << (len(p) - 1).bit_length())[0].tolist()):
        assert one(b"abc") == [97, 256]  # bc before ab
        assert one(b"aaa") == [258, 97]  # the leftmost of equal ranks
        assert one(b"aaaaa") == [259, 97]


def test_another_pattern(library):
    own = bpe.RankEncoder(PATH, r"\S+|\s+", 100)
    other = tiktoken.Encoding("other", pat_str=r"\S+|\s+", mergeable_ranks=library._mergeable_ranks, special_tokens={})
    texts = odd_texts(300)
    ids, start = own.encode_all([t.encode() for t in texts])
    assert [ids[a:b].tolist() for a, b in zip(start, start[1:])] == [other.encode_ordinary(t) for t in texts]


def test_bad_ids_and_ranks(encoder):
    import numpy as np

    with pytest.raises(ValueError):
        encoder.decode(np.array([60_000]))
    with pytest.raises(ValueError):
        bpe.Ranks([b"a", b"b"])


def test_nulls_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "alpha beta", "x"), (1, "alpha beta", "x"), (None, "gamma", None), (2, None, None), (3, "", "y"), (4, "wörter " * 200_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("data", F.lit(1)).repartition(3)
    got = bpe.decoded(bpe.encoded(docs, PATH), PATH).collect()
    assert sorted((r.id if r.id is not None else -1, bytes(r.data).decode()) for r in got) == sorted((r[0] if r[0] is not None else -1, r[1] or "") for r in rows)
    assert bpe.encoded(docs.limit(0), PATH).collect() == []
    named = docs.select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("body"))
    assert bpe.encoded(named, PATH, id_col="name", text_col="body").count() == len(rows)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_query_equals_the_library_on_a_whole_table(spark, library, folder):
    got = {r.doc_id: r for r in q.op13_byte_bpe(spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for row in rows:
        ids = library.encode_ordinary(row.text or "")
        one = got[row.doc_id]
        assert one.n_tokens == len(ids)
        assert one.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert one.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()
