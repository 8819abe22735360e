"""Inputs that every operator has to bear."""

from __future__ import annotations

SF_DIR = "/root/testdata/sf0.001"

PASSAGE = " ".join(f"passage{k}" for k in range(60))


def documents(spark) -> list[tuple[int | None, str | None]]:
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in table.orderBy("doc_id").collect()]
    first = rows[0][1]
    long = " ".join(f"word{k * k % 7919}" for k in range(30000))
    return [
        *rows,
        (9001, None),
        (9002, ""),
        (9003, " \n\t\n "),
        (9004, long),
        (9005, long + " end"),
        (9006, first),
        (9006, first),  # a repeated row
        (9007, f"before it\n{PASSAGE}\nafter it"),
        (9008, f"elsewhere\n{PASSAGE}!\nand more"),
        (9009, f"{PASSAGE[:200]}\n{PASSAGE[200:]}"),
        (9010, "É À naïve ß İstanbul 日本語 x <|endoftext|> don't 'S \\ </s>[INST] \0"),
        (9011, "same same same same same same same same same same same same"),
        (9012, "one two three"),
        (9013, "One Two Three"),
        (9014, "one two three four five six seven\r\none two three four five six seven\n"),
        (None, "no id " + PASSAGE),
    ]


def known(rows):
    """Those with an id, each id once (repeated rows are equal)."""
    return list({i: t for i, t in rows if i is not None}.items())
