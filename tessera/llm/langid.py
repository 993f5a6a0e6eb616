"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks
from .common import Scratch, held_out, small_batches

#: Labelled texts to learn from, about so many for each language, chosen by a hash of id and text.
PER_LANG = 4_000
ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: Bytes of log probabilities that may be broadcast: 1,024 languages. A table with more is refused.
MOST_BYTES = 128 << 20
#: Characters whose n-grams are made at a time: texts in groups of about so many, longer ones in slices.
SLICE = 1 << 17
#: Languages whose counts a task or the driver holds at a time.
TOGETHER = 64
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def ngrams(low: list[str], again: list[int], buckets: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Hashed n-grams of slices of lower-cased texts: for each order the buckets and where each slice's begin; and which slices have a letter.

    Whatever is no letter counts as a space; n-grams do not span slices. ``again`` says with
    how many characters of the one before a slice begins, whose n-grams do not count again.
    """
    size = np.array([len(t) for t in low])
    raw = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[raw]
    code = np.where(is_letter, raw, 32).astype(np.uint32)
    first = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    seen = np.concatenate([np.zeros(1, np.int64), np.cumsum(is_letter)])
    out = []
    h = np.full(len(code), 0x811C9DC5, np.uint32)
    for n in range(1, max(ORDERS) + 1):
        h = (h[: len(code) - n + 1] ^ code[n - 1 :]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if n in ORDERS:
            # The n-grams of a slice end with its characters from the n-th on.
            skip = np.maximum(np.array(again, np.int64), n - 1)
            begin, end = first[:-1] + np.minimum(skip, size) - n + 1, first[1:] - n + 1
            bucket = ((h + np.uint32(n)) * np.uint32(0x85EBCA6B) >> np.uint32(16)).astype(np.int32) & (buckets - 1)
            out.append((bucket, np.stack([begin, np.maximum(begin, end)])))
    return out, seen[first[1:]] > seen[first[:-1]]


def counted(texts: list[str | None], buckets: int):
    """Slice after slice of the texts: the text, its buckets with their counts, and whether it has a letter."""
    again = max(ORDERS) - 1
    slices: list[tuple[int, str, int]] = []
    held = 0
    for k, t in enumerate([*texts, None]):
        low = (t or "").lower()
        for at in range(0, max(len(low), 1), SLICE):
            if slices and (k == len(texts) or held + min(SLICE, len(low) - at) > SLICE):
                grams, lettered = ngrams([s for _, s, _ in slices], [g for *_, g in slices], buckets)
                for j, (owner, _, _) in enumerate(slices):
                    n = np.bincount(np.concatenate([b[a:z] for b, (start, end) in grams for a, z in [(start[j], end[j])]]), minlength=buckets)
                    own = np.flatnonzero(n)
                    yield owner, own, n[own], bool(lettered[j])
                slices, held = [], 0
            slices.append((k, low[max(0, at - again) : at + SLICE], min(again, at)))
            held += min(SLICE, len(low) - at)


@dataclass
class NaiveBayes:
    langs: list[str]
    prior: np.ndarray
    #: log probabilities, a row for each bucket
    logp: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Most likely languages (the first by name of equals) and their posterior probabilities."""
        total, lettered = np.tile(self.prior, (len(texts), 1)), np.zeros(len(texts), bool)
        # A text's counts are a sparse row, whose entries weigh rows of the log-probability matrix.
        for k, own, n, letter in counted(texts, len(self.logp)):
            total[k] += n @ self.logp[own]
            lettered[k] |= letter
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = total.argmax(1)
        score = 1 / np.exp(total - total[np.arange(len(texts)), best][:, None]).sum(1)
        return [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)], np.where(lettered, score, 0.0)


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, buckets: int = BUCKETS) -> NaiveBayes:
    """Count n-grams of labelled texts that are not held out.

    The prior comes from all of them, the counts from about ``per_lang`` of each language,
    picked by a hash of id and text, so that rows with null or repeated ids stand apart;
    rows that repeat both are learned from together or not at all. What reaches the driver is a count for each language and
    bucket, TOGETHER languages at a time. ValueError if the model passes MOST_BYTES: so many
    values of a language column are no languages.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    most = MOST_BYTES // (4 * buckets)
    share = {r.lang: r.n for r in known.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).limit(most + 1).collect()}
    if len(share) > most:
        raise ValueError(f"{lang_col} has more than {most} values")
    langs = sorted(share)
    if not langs:
        return NaiveBayes([], np.zeros(0), np.zeros((buckets, 0), np.float32))
    rate = spark.createDataFrame([(k, min(1.0, per_lang / n)) for k, n in share.items()], "lang string, rate double")
    unit = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    sample = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), unit.alias("unit")).join(F.broadcast(rate), "lang").where("unit < rate")
    sample = sample.select("lang", "text")

    def count(batches):
        seen: dict[str, np.ndarray] = {}

        def out():
            for lang, n in seen.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])
            seen.clear()

        for batch in batches:
            for b in chunks(batch, "text"):
                names = b.column("lang").to_pylist()
                for k, own, n, _ in counted(b.column("text").to_pylist(), buckets):
                    if names[k] not in seen:
                        if len(seen) == TOGETHER:
                            yield from out()
                        seen[names[k]] = np.zeros(buckets, np.int64)
                    seen[names[k]][own] += n
        yield from out()

    counts = scratch.save(small_batches(sample).mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "counts")
    logp = np.zeros((buckets, len(langs)), np.float32)
    for at in range(0, len(langs), TOGETHER):
        part = langs[at : at + TOGETHER]
        rows = counts.where(F.col("lang").isin(part)).toPandas()
        table = np.ones((buckets, len(part)))
        table[rows["bucket"].to_numpy(np.int64), rows["lang"].map({k: i for i, k in enumerate(part)}).to_numpy(np.int64)] += rows["n"].to_numpy(np.float64)
        logp[:, at : at + len(part)] = np.log(table) - np.log(table.sum(0))
    scratch.drop(counts)
    prior = np.log(np.array([share[k] for k in langs]) / sum(share.values()))
    return NaiveBayes(langs, prior, logp)


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> DataFrame:
    """``id, held_out, lang_pred, score`` for every document.

    Null texts and texts without a letter are ``und`` with score 0, as is all if no row has
    a language. Equal posteriors go to the first language by name. Repeated rows get a row
    each. Only the text is an input of a prediction.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, per_lang=per_lang))

    def run(batches):
        for batch in batches:
            for b in chunks(batch, "text"):
                lang, score = model.value.predict(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(lang, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    out = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")
    return out.select("id", held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
