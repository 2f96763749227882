"""Small fixtures with every awkward case: nulls, empty and long texts, ties, repeats, clashing columns."""

import random
import re

import pandas as pd

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, target double, _b string, length int"


def words(text):
    return WORD.findall(text or "")


def odd_documents(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = make(90)
    rows = [(i, f"{make(rng.randint(1, 200))}\n{make(rng.randint(1, 60))}") for i in range(40)]
    rows += [(100 + i, rows[3][1]) for i in range(5)] + [(110 + i, make(30) + " " + passage + " " + make(20)) for i in range(6)]
    rows += [(120, passage[: len(passage) // 2]), (121, make(30_000)), (122, ""), (123, None), (None, make(70)), (None, None), (124, " \n\t "), (125, "é ü 日本　x\x00y"), (126, "end <|endoftext|> of text<|endoftext|>")]
    rows += [rows[0], rows[0], rows[50]]
    sources = ["a", "b", None, "", "c"]
    return [(d, t, None if k % 7 == 0 else "en", sources[k % 5] if k % 3 else "a", None, 7, 0.5, "x", 3) for k, (d, t) in enumerate(rows)]


def frame(spark, rows=None):
    return spark.createDataFrame(odd_documents() if rows is None else rows, SCHEMA)


def write_tables(spark, folder, rows=None):
    frame(spark, rows).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)


def texts(sf):
    return pd.read_parquet(f"{sf}/documents.parquet")
