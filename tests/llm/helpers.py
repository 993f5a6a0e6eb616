"""Small tables and plain versions that the operators' results are held against."""

import random
import re

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: The same with columns whose names the operators use inside.
CLASH = DOCS + ", id bigint, key string, size int, row string, k int, sig binary, part int, copies int, label string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def edge_docs():
    """Nulls in every column, empty, wordless and very long texts, exact copies, repeated rows."""
    long = " ".join(f"w{i % 977} x{i % 13}" for i in range(30_000))
    return [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t\n", None, "a", 3), (4, "one two", "en", None, 7), (5, "One TWO", "en", "a", 7),
        (6, long, "en", "b", len(long)), (7, long + " end", "en", "b", 0), (8, "ünï çödé ß 中文 \U0001f600 text", None, "c", 1), (8, "ünï çödé ß 中文 \U0001f600 text", None, "c", 1),
        (None, "no id here but some words", "en", None, 1), (None, None, None, None, None),
    ]


def edge_table(spark):
    """Edge rows with extra columns of clashing names."""
    return spark.createDataFrame([(*r, 7, "k", 9, "r", 3, b"s", 1, 5, "l") for r in edge_docs()], CLASH)


def empty_table(spark):
    return spark.createDataFrame([], CLASH)


def prose(seed, n):
    r = random.Random(seed)
    return [f"{r.choice('bcdfgl')}{r.choice('aeiou')}{r.choice('mnrst')}{r.randrange(60)}" for _ in range(n)]
