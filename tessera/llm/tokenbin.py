"""Token ids in binary shards: frequency ranks, byte-aligned, control bytes apart."""

from __future__ import annotations

import json
import struct
import zlib
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .arrays import CHUNK, chunks, mix64, per_text, utf8, word_hashes, words
from .common import Scratch, small_batches

MAGIC = b"TSR1"
#: Ids in a shard, about; a shard ends with the document that passes this.
SHARD = 1 << 20
#: Pieces whose ids a task remembers, about 30 bytes each.
REMEMBER = 400_000

# ---- coding ---------------------------------------------------------------------------

#: For each control byte, the lengths of its four values and where each begins.
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + np.uint8(1)
_TOTAL = _LENGTHS.sum(1).astype(np.int64)
_STARTS = np.cumsum(_LENGTHS, 1).astype(np.int64) - _LENGTHS
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode_values(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes (two bits a value, four values a byte) and data bytes (one to four a value, least first)."""
    v = values.astype("<u4")
    size = np.ones(len(v), np.uint8)
    for limit in (1 << 8, 1 << 16, 1 << 24):
        size += v >= limit
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    used = np.arange(4, dtype=np.uint8) < size[:, None]
    return control, v.view(np.uint8).reshape(-1, 4)[used]


def decode_values(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """Look every control byte up in a table of lengths and offsets, and gather."""
    if not n:
        return np.zeros(0, np.uint32)
    base = np.cumsum(_TOTAL[control]) - _TOTAL[control]
    at = (base[:, None] + _STARTS[control]).ravel()[:n]
    padded = np.zeros(len(data) + 4, np.uint8)
    padded[: len(data)] = data
    fours = np.ndarray(len(data) + 1, "<u4", padded, strides=(1,))
    return fours[at] & _MASKS[_LENGTHS[control].ravel()[:n]]


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard: header, ids by falling frequency (then by id), document ids and lengths, control bytes, data bytes."""
    seen = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    used = np.flatnonzero(seen)
    vocab = used[np.lexsort((used, -seen[used]))].astype("<u4")
    rank = np.zeros(len(seen), np.uint32)
    rank[vocab] = np.arange(len(vocab), dtype=np.uint32)
    control, data = encode_values(rank[ids])
    null = np.array([d is None for d in doc_ids], np.uint8)
    docs = np.array([d or 0 for d in doc_ids], "<i8")
    head = struct.pack("<4sIIQQ", MAGIC, len(docs), len(vocab), len(ids), len(data))
    return b"".join((head, vocab.tobytes(), docs.tobytes(), null.tobytes(), lengths.astype("<u4").tobytes(), control.tobytes(), data.tobytes()))


def unpack(shard: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """What ``pack`` was given; ValueError if the bytes are no shard."""
    magic, n_docs, n_vocab, n_ids, n_data = struct.unpack_from("<4sIIQQ", shard)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    at = struct.calcsize("<4sIIQQ")

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(shard, kind, n, at)
        at += out.nbytes
        return out

    vocab, docs, null, lengths = take("<u4", n_vocab), take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs)
    control, data = take("u1", -(-n_ids // 4)), take("u1", n_data)
    return [None if x else int(d) for d, x in zip(docs, null, strict=True)], lengths, vocab[decode_values(control, data, n_ids)]


# ---- tokenizing -----------------------------------------------------------------------

# The parts of a tokenizer's file for which words can be encoded apart.
_NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}

#: Kinds of bytes: space, letter, digit, other; ODD is a word that is left to the tokenizer.
_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)


def _kinds() -> np.ndarray:
    kind = np.full(256, _OTHER, np.uint8)
    kind[[9, 10, 11, 12, 13, 32]] = _SPACE
    kind[[*range(65, 91), *range(97, 123), *range(128, 192), 0xC3]] = _LETTER
    kind[48:58] = _DIGIT
    kind[[*range(9), *range(14, 32), 127, *range(0xC0, 0xC3), *range(0xC4, 256)]] = _ODD
    return kind


_KIND = _kinds()
_BYTE_LEVEL = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or b > 173))}


def can_split(spec: dict) -> bool:
    """Whether a tokenizer's file normalizes and splits text as above, so that white space divides it into words with ids of their own."""
    plain = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and t["content"].startswith("<|") for t in spec["added_tokens"])
    return plain and spec["normalizer"] == _NORMAL and spec["pre_tokenizer"] == _SPLIT and spec["post_processor"] is None and spec["model"]["type"] == "BPE"


def pieces(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and kinds of the pieces of texts, and their bytes with plain words in lower case.

    Words of ASCII and two-byte Latin letters are cut as the tokenizer's pattern cuts them. A
    word with any other byte, or with what may be a special token, is one piece of kind ODD.
    """
    kind = _KIND[data]
    odd = kind == _ODD
    # The two signs among the Latin letters; the beginning of a special token.
    odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)) | (data[:-1] == 60) & (data[1:] == 124)
    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    low[1:][(data[:-1] == 0xC3) & (data[1:] <= 0x9E)] += 32
    if odd.any():
        starts, ends, _ = words(data, off)
        bad = np.add.reduceat(odd, starts) > 0
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts[bad]] += 1
        inside[ends[bad]] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
        kind[inside] = _ODD
        low[inside] = data[inside]
    edge = np.ones(len(data), bool)
    edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    edge[off[:-1][off[:-1] < len(data)]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(data))
    kind = kind[starts]
    # A single apostrophe takes the endings that the pattern names from the letters after it.
    at = np.flatnonzero((kind[:-1] == _OTHER) & (ends[:-1] - starts[:-1] == 1) & (low[starts[:-1]] == 39) & (kind[1:] == _LETTER))
    at = at[~np.isin(starts[at + 1], off)]
    if len(at):
        one, two = low[starts[at + 1]], np.where(ends[at + 1] - starts[at + 1] > 1, low[np.minimum(starts[at + 1] + 1, len(low) - 1)], 0)
        takes = np.select([np.isin(one, list(b"stmd")), np.isin(one.astype(int) << 8 | two, [int.from_bytes(x, "big") for x in (b"re", b"ve", b"ll")])], [1, 2], 0)
        ends[at] += takes
        starts[at + 1] += takes
    keep = (kind != _SPACE) & (starts < ends)
    return starts[keep], ends[keep], kind[keep], low


class Encoder:
    """Token ids of texts. Pieces met before are looked up by a 64-bit hash; a task has one of these and drops it.

    What is remembered is three numbers and the ids of a piece, and is forgotten at ``most`` pieces.
    """

    def __init__(self, path: str, most: int = REMEMBER):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.by_word = can_split(json.load(f))
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, self.dtype)

    def _learn(self, keys: np.ndarray, raw: list[bytes], odd: np.ndarray) -> None:
        model = self.tokenizer.model
        # The model knows a byte that is no ASCII sign by another letter.
        level = lambda r: r.decode() if r.isascii() else r.decode("latin-1").translate(_BYTE_LEVEL)
        ids = [None if o else [t.id for t in model.tokenize(level(r))] for r, o in zip(raw, odd.tolist(), strict=True)]
        left = np.flatnonzero(odd).tolist()
        for k, e in zip(left, self.tokenizer.encode_batch_fast([raw[k].decode() for k in left], add_special_tokens=False), strict=True):
            ids[k] = e.ids
        size = np.array([len(x) for x in ids], np.int64)
        at = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), self.dtype, int(size.sum()))])
        to = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = np.insert(self.keys, to, keys), np.insert(self.at, to, at), np.insert(self.size, to, size)

    def _run(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, kind, low = pieces(data, off)
        key = word_hashes(low, starts, ends, lower=False)
        seen, which = np.unique(key, return_inverse=True)
        if len(self.keys) > self.most:
            self._forget()
        to = np.minimum(np.searchsorted(self.keys, seen), max(len(self.keys) - 1, 0))
        new = self.keys[to] != seen if len(self.keys) else np.ones(len(seen), bool)
        if new.any():
            example = np.empty(len(seen), np.int64)
            example[which] = np.arange(len(key))
            e = example[new]
            self._learn(seen[new], [low[a:z].tobytes() for a, z in zip(starts[e].tolist(), ends[e].tolist(), strict=True)], kind[e] == _ODD)
        to = np.searchsorted(self.keys, seen)[which]
        size = self.size[to]
        out = self.flat[np.repeat(self.at[to] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        return out, per_text(size, np.searchsorted(starts, off))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has; nulls are empty."""
        data, off = utf8(texts)
        if not self.by_word:
            rows = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.array([i for r in rows for i in r], self.dtype), np.array([len(r) for r in rows], np.int64)
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(len(off) - 1, np.int64)
        if len(data) <= 2 * CHUNK:
            return self._run(data, off)
        # Long texts are cut at white space.
        gaps, cuts = np.flatnonzero(_KIND[data] == _SPACE), [0]
        while len(data) - cuts[-1] > CHUNK:
            k = np.searchsorted(gaps, cuts[-1] + CHUNK)
            if k == len(gaps):
                break
            cuts.append(int(gaps[k]))
        cuts.append(len(data))
        ids, total = [], np.zeros(len(off) - 1, np.int64)
        for a, z in pairwise(cuts):
            i, n = self._run(data[a:z], np.clip(off - a, 0, z - a))
            ids.append(i)
            total += n
        return np.concatenate(ids), total


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenize(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """``id, version, salt, n, ids`` of every text, where it lies: ids are two bytes each, or four if the vocabulary needs them.

    version is a hash of the text. A tokenizer whose file says that it splits text as
    described above meets each piece once in a while; any other encodes whole texts.
    """
    path = tokenizer or default_tokenizer()
    kind = docs.schema[id_col].dataType.simpleString()
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"{id_col} is {kind}; shards hold whole numbers")

    def run(batches):
        from pyspark import TaskContext

        encoder, at = Encoder(path), TaskContext.get().partitionId() << 32
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            for b in chunks(batch, "text"):
                ids, sizes = encoder.encode(b.column("text"))
                raw, ends = ids.tobytes(), (np.cumsum(sizes) * encoder.dtype.itemsize).tolist()
                rows = pa.array([raw[a:z] + end for a, z in pairwise([0, *ends])], pa.binary())
                salt = mix64(np.arange(at, at + b.num_rows, dtype=np.uint64)).view(np.int64)
                at += b.num_rows
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("version"), pa.array(salt), pa.array(sizes + 1), rows], ["id", "version", "salt", "n", "ids"])

    rows = small_batches(docs).select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id bigint, version bigint, salt bigint, n bigint, ids binary")


def write_shards(docs: DataFrame, *, shard: int = SHARD, scratch: Scratch | None = None, **kw) -> DataFrame:
    """Encode texts and write shards in ascending order of id; returns the table of files.

    Texts are tokenized where they lie; what is range-partitioned and sorted is the ids, about
    half of the texts' bytes. Each shard ranks ids by their frequency in the shard, so it can
    be read, written again or moved alone. The table has ``part, block, first_doc, n_docs,
    n_ids, shard``; (part, block) is the order. The tokenizer's file is a parameter.

    Null texts count as empty and have the end id alone. Null ids come first. Rows that
    repeat an id are in the order of a hash of their text, equal rows in any order: a number
    of each row lets ranges split an id that very many rows have.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    tokens = scratch.save(tokenize(docs, **kw), "tokens")

    def run(batches):
        from pyspark import TaskContext

        part, block, ids, sizes, names, n = TaskContext.get().partitionId(), 0, [], [], [], 0

        def out():
            nonlocal block, ids, sizes, names, n
            row = pack(names, np.array(sizes), np.concatenate(ids))
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([block], pa.int32()), pa.array([names[0]], pa.int64()), pa.array([len(names)], pa.int64()), pa.array([n], pa.int64()), pa.array([row], pa.binary())], ["part", "block", "first_doc", "n_docs", "n_ids", "shard"])
            block, ids, sizes, names, n = block + 1, [], [], [], 0

        for b in batches:
            for name, size, row in zip(*(b.column(c).to_pylist() for c in ("id", "n", "ids")), strict=True):
                ids.append(np.frombuffer(row, f"<u{len(row) // size}"))
                sizes.append(size)
                names.append(name)
                n += size
                if n >= shard:
                    yield from out()
        if names:
            yield from out()

    order = (F.col("id").asc_nulls_first(), "version", "salt")
    rows = tokens.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "n", "ids")
    shards = scratch.save(rows.mapInArrow(run, "part bigint, block int, first_doc bigint, n_docs bigint, n_ids bigint, shard binary"), "shards")
    scratch.drop(tokens)
    return shards


def with_starts(shards: DataFrame) -> DataFrame:
    """Add ``before``: ids of all shards before each. Parts are summed first, then blocks within a part."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("part_before"))
    blocks = shards.select("part", "block", (F.sum("n_ids").over(W.partitionBy("part").orderBy("block")) - F.col("n_ids")).alias("block_before"))
    at = blocks.join(parts, "part").select("part", "block", (F.col("part_before") + F.col("block_before")).alias("before"))
    return shards.join(at, ["part", "block"])


def read_shards(shards: DataFrame) -> DataFrame:
    """Decode shards: ``part, block, start (in the shard), doc_id, n_tokens, ids_crc32``, a row for each document."""

    def run(batches):
        for b in batches:
            for part, block, shard in zip(*(b.column(c).to_pylist() for c in ("part", "block", "shard")), strict=True):
                names, sizes, ids = unpack(shard)
                flat = memoryview(ids.astype("<u4").tobytes())
                ends = np.cumsum(sizes, dtype=np.int64)
                starts = ends - sizes
                crc = [zlib.crc32(flat[4 * a : 4 * z]) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(names), pa.int64()), pa.array([block] * len(names), pa.int32()), pa.array(starts), pa.array(names, pa.int64()), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())], ["part", "block", "start", "doc_id", "n_tokens", "ids_crc32"])

    return shards.select("part", "block", "shard").mapInArrow(run, "part bigint, block int, start bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint")


def token_table(docs: DataFrame, **kw) -> DataFrame:
    """Write shards, read them back: ``doc_id, start, n_tokens, ids_crc32, part, block`` for each document.

    ``start`` counts the ids of all documents before it. An empty table gives no rows.
    """
    shards = write_shards(docs, **kw)
    before = with_starts(shards.drop("shard")).select("part", "block", "before")
    rows = read_shards(shards).join(before, ["part", "block"])
    return rows.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "part", "block")
