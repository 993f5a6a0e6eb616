"""How far the sources of a language differ in their terms, counted in mergeable radix tries."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .arrays import chunks, utf8
from .common import Scratch, maybe_broadcast, small_batches

#: Documents of a language that a kept term is in, at least, and the unit of shares.
LEAST_DOCS, UNIT = 3, 1_000_000_000
#: Terms of a source that are reported.
MOST_TERMS = 200
#: Rests of terms in a bucket of a trie, tokens whose counts are held one by one, and leaves before a task's tries are sent on.
BUCKET, MOST_TOKENS, MOST_LEAVES = 64, 1 << 20, 400_000
#: Leaves that are merged at a time, terms of a block, and numbers of shares held at a time.
MERGED, BLOCK_TERMS, MOST_CELLS = 20_000, 4096, 1 << 20
#: Bytes of a text that are split into terms at a time.
PIECE = 1 << 20
#: A-Z as a-z, other letters of a term as they are, what separates terms as a space.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _same(a: bytes, b: bytes, at: int = 0) -> int:
    """How many bytes a shares with b from a place on."""
    n, most = 0, min(len(a), len(b) - at)
    while n < most and a[n] == b[at + n]:
        n += 1
    return n


class Trie:
    """A byte radix trie from terms to numbers of leaves.

    An inner node is ``[label, children]``: after the label's bytes the next one leads to a
    child, and -1 to the leaf of the term that ends there. The lowest nodes are buckets of
    rests, which become inner nodes when they are too many.
    """

    def __init__(self):
        self._top: dict = {0: {}}

    def put(self, term: bytes, leaf: int) -> None:
        up, way, at = self._top, 0, 0
        node = up[way]
        while type(node) is list:
            label = node[0]
            if label and not term.startswith(label, at):
                # The label parts from the term: a node for what they share comes between.
                n = _same(label, term, at)
                node[0] = label[n + 1 :]
                node = up[way] = [label[:n], {label[n]: node}]
            at += len(node[0])
            up = node[1]
            if at == len(term):
                up[-1] = leaf
                return
            way = term[at]
            at += 1
            node = up.get(way)
            if node is None:
                node = up[way] = {}
        node[term[at:]] = leaf
        if len(node) > BUCKET:
            least = min(node)
            n = _same(least, max(node))
            children: dict = {}
            for rest, own in node.items():
                if len(rest) == n:
                    children[-1] = own
                else:
                    children.setdefault(rest[n], {})[rest[n + 1 :]] = own
            up[way] = [least[:n], children]

    def walk(self) -> Iterator[tuple[bytes, int]]:
        """Terms and their leaves, in order of the terms' bytes."""
        todo = [(b"", self._top[0])]
        while todo:
            prefix, node = todo.pop()
            if type(node) is dict:
                for rest in sorted(node):
                    yield prefix + rest, node[rest]
            elif type(node) is list:
                prefix, children = prefix + node[0], node[1]
                todo += [(prefix + bytes([c]), children[c]) for c in sorted(children, reverse=True) if c >= 0]
                if -1 in children:
                    yield prefix, children[-1]


class Counts:
    """The terms of a language in a task: a number for each, and how often each source has it."""

    def __init__(self):
        self.number: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.sources: dict[str, int] = {}
        self._tokens: list[np.ndarray] = []
        self._of: list[int] = []
        self._docs: list[np.ndarray] = []
        self.held = 0
        self._keys, self._n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._in_docs = np.zeros(0, np.int64)

    def add(self, source: str, pieces: Iterator[list[bytes]]) -> None:
        """A document's terms, piece by piece."""
        of, seen = self.sources.setdefault(source, len(self.sources)), []
        for found in pieces:
            own = np.fromiter(map(self.number.__getitem__, found), np.int64, len(found))
            self._tokens.append(own)
            self._of.append(of)
            seen.append(np.unique(own))
            self.held += len(own)
            if self.held >= MOST_TOKENS:
                self.settle()
        self._docs.append(seen[0] if len(seen) == 1 else np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int64))

    def settle(self) -> None:
        """Add the tokens held to the counters."""
        if self._tokens:
            keys = np.concatenate(self._tokens) << 32 | np.repeat(np.array(self._of, np.int64), [len(t) for t in self._tokens])
            keys, n = np.unique(keys, return_counts=True)
            both = np.concatenate([self._keys, keys])
            self._keys, at = np.unique(both, return_inverse=True)
            self._n = np.bincount(at, np.concatenate([self._n, n]), len(self._keys)).astype(np.int64)
        if self._docs:
            more = np.bincount(np.concatenate(self._docs), minlength=len(self.number))
            more[: len(self._in_docs)] += self._in_docs
            self._in_docs = more
        self._tokens, self._of, self._docs, self.held = [], [], [], 0

    def leaves(self, lang: str) -> Iterator[pa.RecordBatch]:
        """The leaves of the terms' trie, in order; an empty term has the sources."""
        self.settle()
        names = pa.array(list(self.sources), pa.string())
        zeros = pa.array([0] * len(names), pa.int64())
        yield _leaves([lang], pa.array([b""], pa.binary()), [0], [0, len(names)], names, zeros)
        trie = Trie()
        for term, k in self.number.items():
            trie.put(term, k)
        first = np.searchsorted(self._keys >> 32, np.arange(len(self.number) + 1))
        terms, order = [], []
        for term, k in trie.walk():
            terms.append(term)
            order.append(k)
        for lo in range(0, len(order), 8192):
            own = np.array(order[lo : lo + 8192])
            size = first[own + 1] - first[own]
            at = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
            entry = np.arange(at[-1]) + np.repeat(first[own] - at[:-1], size)
            yield _leaves([lang] * len(own), pa.array(terms[lo : lo + 8192], pa.binary()), self._in_docs[own], at, names.take(pa.array(self._keys[entry] & 0xFFFFFFFF)), pa.array(self._n[entry]))


_LEAF = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def _leaves(lang: list[str], terms: pa.Array, docs, at, sources: pa.Array, counts: pa.Array) -> pa.RecordBatch:
    lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), x) for x in (sources, counts)]
    return pa.RecordBatch.from_arrays([pa.array(lang), terms, pa.array(docs, pa.int64()), *lists], schema=_LEAF)


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in which spaces are all that separates them, some PIECE bytes at a time."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE) if at + PIECE < len(text) else -1
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def count_terms(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """``lang, term, docs, sources, counts``: the leaves of each task's tries. An empty term names the sources of a language."""

    def run(batches):
        langs: defaultdict[str, Counts] = defaultdict(Counts)
        for batch in batches:
            for b in chunks(batch, "text"):
                data, off = utf8(b.column("text"))
                flat, off = data.tobytes().translate(_TERMS), off.tolist()
                for lang, source, a, z in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), off, off[1:], strict=False):
                    langs[lang].add(source, _pieces(flat[a:z]))
                if sum(len(c.number) for c in langs.values()) >= MOST_LEAVES:
                    for lang, c in langs.items():
                        yield from c.leaves(lang)
                    langs.clear()
        for lang, c in langs.items():
            yield from c.leaves(lang)

    texts = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = small_batches(docs).select(texts(lang_col).alias("lang"), texts(source_col).alias("source"), texts(text_col).alias("text"))
    return rows.mapInArrow(run, "lang string, term binary, docs bigint, sources array<string>, counts array<bigint>")


_BLOCK = pa.schema([("lang", pa.string()), ("terms", pa.list_(pa.binary())), ("sources", pa.list_(pa.string())), ("totals", pa.list_(pa.int64())), ("leaf", pa.list_(pa.int32())), ("source", pa.list_(pa.int32())), ("count", pa.list_(pa.int64()))])


def _merged(leaves: pa.Table) -> Iterator[pa.RecordBatch]:
    """Blocks of ordered leaves, of which those of a term are together: its documents and counters added up, rare terms left out."""
    same = np.zeros(len(leaves), bool)
    if len(leaves) > 1:
        equal = [np.asarray(pc.equal(leaves.column(c).slice(1), leaves.column(c).slice(0, len(leaves) - 1))) for c in ("lang", "term")]
        same[1:] = equal[0] & equal[1]
    starts = np.flatnonzero(~same)
    docs = np.add.reduceat(leaves.column("docs").to_numpy(), starts)
    names = np.asarray(pc.equal(leaves.column("term").take(pa.array(starts)), b""))
    keep = (docs >= LEAST_DOCS) | names
    group = np.cumsum(~same) - 1
    mask = keep[group]
    rows, group = leaves.filter(pa.array(mask)), (np.cumsum(keep) - 1)[group[mask]]
    if not len(rows):
        return
    first = np.flatnonzero(np.diff(group, prepend=-1))
    lists = rows.column("sources").combine_chunks()
    codes = lists.flatten().dictionary_encode()
    source_names, code = codes.dictionary.to_pylist(), codes.indices.to_numpy()
    counts = rows.column("counts").combine_chunks().flatten().to_numpy()
    # A counter for each term and source, in order of the terms.
    key, at = np.unique(np.repeat(group, lists.value_lengths().to_numpy()).astype(np.int64) * len(source_names) + code, return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, at, counts)
    owner, place = key // len(source_names), key % len(source_names)
    langs, terms = rows.column("lang").take(pa.array(first)).to_pylist(), rows.column("term").take(pa.array(first)).to_pylist()
    lo = 0
    while lo < len(terms):
        hi = lo + 1
        while terms[lo] and hi < len(terms) and hi - lo < BLOCK_TERMS and langs[hi] == langs[lo] and terms[hi]:
            hi += 1
        own = slice(*np.searchsorted(owner, [lo, hi]))
        used, where = np.unique(place[own], return_inverse=True)
        sums = np.zeros(len(used), np.int64)
        np.add.at(sums, where, total[own])
        named = bool(terms[lo])
        columns = [langs[lo], terms[lo:hi] * named, [source_names[k] for k in used], sums.tolist(), *((owner[own] - lo, where, total[own]) if named else ([], [], []))]
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(columns, _BLOCK, strict=True)], schema=_BLOCK)
        lo = hi


def merge_ranges(leaves: DataFrame) -> DataFrame:
    """Blocks of merged tries: ``lang, terms, sources, totals, leaf, source, count``; without terms, the sources of a language.

    Leaves are dealt out by ranges of language and term and put in order, so the leaves that
    tries have for a term are neighbours in one task, and there is one from each trie.
    """

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= MERGED:
                t = pa.Table.from_batches(held).combine_chunks()
                # The last term's leaves may go on in the next batch.
                last = pc.and_(*(pc.equal(t.column(c), t.column(c)[-1]) for c in ("lang", "term")))
                cut = pc.index(last, True).as_py()
                if cut:
                    yield from _merged(t.slice(0, cut))
                held, size = t.slice(cut).to_batches(), len(t) - cut if cut else 0
        if held and (t := pa.Table.from_batches(held)).num_rows:
            yield from _merged(t.combine_chunks())

    dealt = leaves.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").select(*_LEAF.names)
    return dealt.mapInArrow(run, "lang string, terms array<binary>, sources array<string>, totals array<bigint>, leaf array<int>, source array<int>, count array<bigint>")


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(UNIT * (count + 1) / total)``, exact for numbers to 9e15; by three digits at a time."""
    left, out = count + 1, np.zeros(np.broadcast_shapes(count.shape, total.shape), np.int64)
    out, left = out + left // total, left % total
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // total, left % total
    return out + 1


def _scored(lang: str, terms: list[bytes], counts: np.ndarray, groups: list[dict], v: int, pairs, best) -> None:
    """Add a block's terms to the sums of pairs and to the best terms."""
    total = np.array([g["n"] for g in groups], np.int64)
    p, q = shares(counts, total + v), shares(counts.sum(1), total.sum() + v)
    for s, g in enumerate(groups):
        d = p[:, s : s + 1] - p
        pairs(lang, s, (d * d // p).sum(0))
        up = np.flatnonzero((counts[:, s] > 0) & (p[:, s] > q))
        if len(up):
            d = p[up, s] - q[up]
            f = d * d // q[up]
            # Terms are in order of their bytes, so equal values stay in it.
            first = np.argsort(-f, kind="stable")[:MOST_TERMS]
            best[lang, g["source"]] += [(-int(f[k]), terms[up[k]]) for k in first]
            if len(best[lang, g["source"]]) > 4 * MOST_TERMS:
                best[lang, g["source"]] = sorted(best[lang, g["source"]])[:MOST_TERMS]


_SCORE = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def score(blocks: DataFrame) -> DataFrame:
    """``lang, source, part, item, value`` of blocks with their language's groups: parts of the pairs' sums, and each task's best terms."""

    def rows(values: list[tuple]) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(values), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*values[k : k + 10_000], strict=True), _SCORE, strict=True)], schema=_SCORE)

    def run(batches):
        sums: dict[tuple[str, int], np.ndarray] = {}
        names: dict[str, list[str]] = {}
        best = defaultdict(list)

        def pairs(lang, s, row):
            sums[lang, s] = sums[lang, s] + row if (lang, s) in sums else row

        def summed():
            out = [(lang, names[lang][s], "pair", names[lang][t], x) for (lang, s), row in sums.items() for t, x in enumerate(row.tolist()) if t != s]
            sums.clear()
            return rows(out)

        def ranked():
            out = [(lang, source, "term", term.decode(), -f) for (lang, source), found in best.items() for f, term in sorted(found)[:MOST_TERMS]]
            best.clear()
            return rows(out)

        for b in batches:
            for r in b.to_pylist():
                groups, n = r["groups"], len(r["terms"])
                names[r["lang"]] = [g["source"] for g in groups]
                at = {g["source"]: k for k, g in enumerate(groups)}
                place = np.array([at[s] for s in r["sources"]], np.int64)
                leaf, source, count = (np.array(r[c], np.int64) for c in ("leaf", "source", "count"))
                per = max(1, MOST_CELLS // len(groups))
                for k in range(0, n, per):
                    counts = np.zeros((min(per, n - k), len(groups)), np.int64)
                    own = slice(*np.searchsorted(leaf, [k, k + per]))
                    counts[leaf[own] - k, place[source[own]]] = count[own]
                    _scored(r["lang"], r["terms"][k : k + per], counts, groups, r["v"], pairs, best)
                    if sum(map(len, sums.values())) > MOST_CELLS:
                        yield from summed()
                    if len(best) * MOST_TERMS > MOST_CELLS:
                        yield from ranked()
        yield from summed()
        yield from ranked()

    return small_batches(blocks).mapInArrow(run, "lang string, source string, part string, item string, value bigint")


def divergence(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: how sources differ from each other, and by which terms from their language.

    Terms are runs of Latin letters and of all signs beyond ASCII, with A-Z lower-cased; a
    language keeps those in LEAST_DOCS of its documents. The share of a term, plus one of
    each kept term, is a whole number of UNIT ths. Part ``pair``: item is another source of
    the language and value the sum over all kept terms of ``floor((p - q)^2 / q)``, p and q
    the shares of source and item. Part ``term``: the MOST_TERMS kept terms of the source
    with the greatest ``floor((p - q)^2 / q)`` of those with p above q, the language's
    share. Ties rank by the items' bytes.

    Null texts, languages and sources count as empty ones; repeated rows count each; a
    source without terms takes part with counts of zero; an empty table gives no rows. Other
    columns do not matter. A frequent term has one leaf for each trie of a task, and a task
    holds a range of terms, so no term or source is one task's work. Sums of pairs take the
    square of a language's sources, as their rows do.
    """
    scratch = Scratch(docs.sparkSession)
    leaves = scratch.save(count_terms(docs, text_col, lang_col, source_col), "leaves")
    blocks = scratch.save(merge_ranges(leaves), "tries")
    scratch.drop(leaves)
    totals = blocks.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("t")).groupBy("lang", F.col("t.sources").alias("source")).agg(F.sum("t.totals").alias("n"))
    groups = totals.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("groups"))
    kept = blocks.groupBy("lang").agg(F.sum(F.size("terms")).alias("v"))
    langs = scratch.save(groups.join(kept, "lang"), "languages")

    scored = scratch.save(score(blocks.where(F.size("terms") > 0).join(maybe_broadcast(langs), "lang")), "scores")
    # A language without kept terms has pairs too, of value zero.
    each = langs.select("lang", F.explode("groups.source").alias("source"), "groups").select("lang", "source", F.explode("groups.source").alias("item"), F.lit(0).cast("bigint").alias("value")).where("source <> item")
    pairs = scored.where("part = 'pair'").select("lang", "source", "item", "value").union(each).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = scored.where("part = 'term'").select("lang", "source", "part", "item", "value", F.row_number().over(order).alias("rank")).where(F.col("rank") <= MOST_TERMS)
    return pairs.union(terms)
