import random

import pandas as pd
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from gainflow.llm import bpe

from . import brute

PATH = public_tokenizers.path("byte_bpe_50k.json")
T = Tokenizer.from_file(PATH)
HARD = [
    "", None, "hello  world\n\n  x'll I'VE don't", "<|endoftext|>a<|endoftext|><|endoftext|>b ", "\x1c\x1d\x85 ᠎​﻿  　x\t\t y", "😀😀 Größe ñandú 漢字仮名 ٣٤ ½²",
    "a" * 3000, " " * 2500, "abc" * 1500 + "\n" * 70, "!?" * 400, "<|endoftext", "\x00\x01 \x7f", "é́é İİ", " 's 't''re", "\r\n\r\n \r\n",
]


def check(spark, texts):
    df = spark.createDataFrame(pd.DataFrame({"doc_id": range(len(texts)), "text": texts}), "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.round_trip(df, PATH).collect()}
    for i, t in enumerate(texts):
        ids = T.encode(t or "", add_special_tokens=False).ids
        assert bytes(got[i].ids) == b"".join(x.to_bytes(4, "little") for x in ids), repr(t)[:80]
        assert got[i].n_tokens == len(ids) and got[i].decoded == T.decode(ids, skip_special_tokens=False)


def test_hard_cases(spark):
    check(spark, HARD)


def test_random_bytes(spark):
    r = random.Random(1)
    check(spark, ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(9, 0x300), r.randrange(0x300, 0xD7FF)])) for _ in range(r.randrange(60))) for _ in range(300)])


def test_corpus(spark):
    check(spark, [r["text"] for r in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).to_pylist()])


def test_clash_and_empty(spark):
    df = spark.createDataFrame([("a", 1)], "text string, IDS int")
    assert bpe.encode(df, PATH).columns == ["text", "ids"] and bpe.round_trip(df.limit(0), PATH).count() == 0
    assert brute.sha(b"") and bpe.decode(bpe.encode(df, PATH), PATH).first().decoded == "a"


def test_long_and_repeated_texts(spark):
    r = random.Random(3)
    long = "".join(r.choice("abc défg\n12!") for _ in range(1_500_000))
    check(spark, [long, "x" * 200_000, "same text", "same text"])
