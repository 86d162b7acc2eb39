"""Rows that every operator over documents must bear."""

LONG = ("lorem ipsum dolor sit amet " * 40 + "\n") * 60
TEXTS = [None, "", " ", "\n\n", "word", LONG, LONG, "x" * 70_000, "  two  spaces \t and tabs\r\n", "日本語 😀 ﬁ é é ﻿ ▁ \x00 <|endoftext|> </s> <0x0A>", "a   b", "▁▁ ▁a", "Ünïcödé ẞ İ ΑΣ σς", "12 345", "same", "same", "é" * 200]


def docs(spark, texts=TEXTS, clash=True):
    rows = [(i, t, None if i % 5 == 0 else "en", None, None, 1, 2, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest int, n_tokens long, content string")
    return df if clash else df.drop("digest", "n_tokens", "content")


def empty(spark):
    return docs(spark).limit(0)
