"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit distance."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, mix64, utf8, word_hashes, words
from .common import small_batches

#: Edits allowed per hundred words of an item; items below SHORT words allow none.
EDITS_PERCENT, SHORT = 20, 10
#: Random walks, bit samples for each walk, and positions in a sample, at most.
WALKS, SAMPLES, POSITIONS = 4, 64, 3
#: Samples up to which a key takes more positions rather than fewer.
FEW_SAMPLES = 16
#: Share of passages with the most edits that keys should find; the others are found by grams.
TARGET_RECALL = 0.95
#: Items and bytes of their texts in one pass over the documents; more take more passes.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
#: Words of windows that are embedded at a time, and shared grams of single items that are counted at a time, so that memory does not grow with the items' length or number.
MATCH_WORDS = 1 << 18
GRAM = 3
_U = np.uint64
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def fold(data: np.ndarray) -> np.ndarray:
    """Lower-case Latin letters of UTF-8 bytes, A-Z and the two-byte capitals."""
    out = data.copy()
    out[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)] += 0x20
    return out


def text_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of letters and digits, case folded), and the first word of each text."""
    data, off = utf8(texts)
    data = fold(data)
    starts, ends, first = words(data, off, _BETWEEN)
    return word_hashes(data, starts, ends), first


def edits(n: int) -> int:
    return n * EDITS_PERCENT // 100 if n >= SHORT else 0


def grams(h: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A hash at every position of the words from there, 0 where there are fewer than size."""
    out = np.zeros(len(h), _U)
    n = len(h) - size + 1
    if n > 0:
        out[:n] = mix64(sum(mix64(h[k : k + n] + _U(k + 1)) * _U(2 * k + 1) for k in range(size)))
    return out


def embed(x: np.ndarray, walk: int) -> np.ndarray:
    """CGK: copy the symbol under a pointer, which a random bit of step and symbol moves on.

    Two strings that meet after an edit walk on together, so few edits leave few positions
    that differ. ``x`` has a string of n symbols in each row, 0 past its end; the result
    has 2 n steps, after which most pointers have passed the end.
    """
    rows, n = x.shape
    padded = np.concatenate([x, np.zeros((rows, 1), _U)], axis=1)
    at, rise = np.zeros(rows, np.int64), np.arange(rows) * (n + 1)
    out = np.empty((rows, 2 * n), _U)
    flat = padded.ravel()
    for j in range(2 * n):
        symbol = flat[rise + at]
        out[:, j] = symbol
        step = (mix64(symbol ^ _U((walk * 0x9E3779B97F4A7C15 + j * 0xBF58476D1CE4E5B9) & (1 << 64) - 1)) >> _U(17)) & _U(1)
        at = np.minimum(at + step.astype(np.int64), n)
    return out


def stride(k: int) -> int:
    """Words between windows for items with k edits: far fewer than the edits, so that a passage is not much farther from a window than from the item."""
    return max(1, k // 8)


@cache
def scheme_for(n: int, target_recall: float) -> tuple[int, int]:
    """Positions in a sample and samples of each walk for which keys find so many of the passages with the most edits.

    The agreement of embeddings is measured on random strings about as long, their edited
    copies shifted as far as windows lie from a passage. The more of it is lost, the fewer
    positions a key takes; a key of one is weak, but windows have passed the filter of grams.
    """
    n = min(1 << (n - 1).bit_length(), 1 << 12)
    k, rng = edits(n), np.random.default_rng(n)
    if not k:
        return POSITIONS, 1
    rows = max(4, min(32, 8192 // n))
    a, b = rng.integers(1, 1 << 60, (rows, n), dtype=_U), np.zeros((rows, n), _U)
    for row, out in zip(a, b, strict=True):
        edited = []
        for w, kind in zip(row, rng.permutation(np.concatenate([rng.integers(1, 4, k), np.zeros(n - k, np.int64)])), strict=True):
            # 1 replaces a word, 2 puts another before it, 3 leaves it out.
            edited += [rng.integers(1, 1 << 60, dtype=_U)] * (kind in (1, 2)) + [w] * (kind in (0, 2))
        edited = edited[stride(k) // 2 :][:n]
        out[: len(edited)] = edited
    agree = np.stack([(embed(a, w) == embed(b, w)).mean(1) for w in range(WALKS)])
    for positions in range(POSITIONS, 0, -1):
        miss = np.prod(1 - agree**positions, axis=0)
        for samples in range(1, (FEW_SAMPLES if positions > 1 else SAMPLES) + 1):
            if (miss**samples).mean() <= 1 - target_recall:
                return positions, samples
    return 1, SAMPLES


def walk_keys(y: np.ndarray, n: int, walk: int, scheme: tuple[int, int]) -> list[np.ndarray]:
    """A key for each sample of positions of a walk over strings of n words, from its embeddings."""
    positions, samples = scheme
    rng, keys = np.random.default_rng((n, walk)), []
    for s in range(samples):
        h = np.full(len(y), walk * SAMPLES + s + 1, _U)
        for p in rng.integers(0, 2 * n, positions):
            h = mix64(h * _U(0xD6E8FEB86659FD93) ^ y[:, p])
        keys.append(h)
    return keys


def sample_keys(x: np.ndarray, scheme: tuple[int, int]) -> np.ndarray:
    """A key for each row, walk and sample; shape (rows, WALKS * samples)."""
    n = x.shape[1]
    return np.stack([k for walk in range(WALKS) for k in walk_keys(embed(x, walk), n, walk, scheme)], axis=1)


def edit_distances(items: np.ndarray, texts: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edits from rows of items to any run of words in the same rows of texts, and the first place where such a run begins, all rows at once.

    A run may begin within the first ``lead`` words and end anywhere; texts are 0 past their end.
    """
    rows, n = items.shape
    # A number holds the edits and, in its lower half, where the run begins.
    ramp = np.arange(texts.shape[1] + 1, dtype=np.int64)
    one = ramp << 32
    # Before the item's first word, words of the lead are free.
    free = np.minimum(ramp, lead[:, None])
    prev = ((ramp - free) << 32) + free
    for i in range(n):
        cur = prev + (1 << 32)
        cur[:, 1:] = np.minimum(cur[:, 1:], prev[:, :-1] + ((items[:, i : i + 1] != texts).astype(np.int64) << 32))
        # Insertions run along the row: a running minimum of values less their position.
        prev = np.minimum.accumulate(cur - one, axis=1) + one
    least = prev.min(1)
    return least >> 32, least & 0xFFFFFFFF


@dataclass
class Index:
    """The items of a block, by their number of words; those with fewer words than a gram have no keys."""

    ids: dict[int, np.ndarray]
    strings: dict[int, np.ndarray]
    keys: dict[int, tuple[np.ndarray, np.ndarray]]
    grams: dict[int, np.ndarray]
    owners: dict[int, np.ndarray]
    schemes: dict[int, tuple[int, int]]
    #: Hashes of items of fewer words than a gram, in order, and their rows.
    short: dict[int, tuple[np.ndarray, np.ndarray]]
    table: np.ndarray
    #: A number that is no item's id and stands for null.
    null: int

    def has(self, g: np.ndarray) -> np.ndarray:
        return self.table[(g >> _U(20)).astype(np.int64) & (len(self.table) - 1)] & (g != 0)


def build(ids: list[int | None], texts: list[str | None], target_recall: float = TARGET_RECALL) -> Index | None:
    """Index items; None if none has a word."""
    h, first = text_words(pa.array(texts, pa.string()))
    by: dict[int, list[int]] = {}
    for k, n in enumerate(np.diff(first).tolist()):
        if n:
            by.setdefault(n, []).append(k)
    if not by:
        return None
    strings = {n: np.stack([h[first[k] : first[k + 1]] for k in ks]) for n, ks in by.items()}
    own, owners, short = {}, {}, {}
    for n, s in strings.items():
        if n < GRAM:
            g = grams(s.ravel(), n)[::n]
            order = np.argsort(g, kind="stable")
            short[n] = g[order], order
            continue
        own[n], which = np.unique(np.concatenate([grams(row)[: n - GRAM + 1] for row in s]), return_inverse=True)
        # Each gram's items, as gram * items + item.
        owners[n] = np.unique(which * len(s) + np.repeat(np.arange(len(s)), n - GRAM + 1))
    g = np.concatenate([np.zeros(0, _U), *own.values()])
    size = max(1 << 16, 1 << int(64 * len(g) - 1).bit_length())
    table = np.zeros(size, bool)
    table[(g >> _U(20)).astype(np.int64) & (size - 1)] = True
    keys, schemes = {}, {}
    for n in own:
        schemes[n] = scheme_for(n, target_recall)
        k = sample_keys(strings[n], schemes[n])
        order = np.argsort(k.ravel(), kind="stable")
        keys[n] = (k.ravel()[order], order // k.shape[1])
    taken = set(ids)
    null = next(i for i in range(-(1 << 63), 1 << 63) if i not in taken)
    return Index({n: np.array([null if ids[k] is None else ids[k] for k in ks], np.int64) for n, ks in by.items()}, strings, keys, own, owners, schemes, short, table, null)


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Each start and the numbers after it, so many as count says, one run after the other."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _dense(own: np.ndarray, doc: np.ndarray, least: int, span: int) -> np.ndarray:
    """Which of the ordered places lie at most span after one that begins ``least`` places of a text within span."""
    m = len(own) - least + 1
    if m <= 0:
        return np.zeros(len(own), bool)
    begins = (own[least - 1 :] - own[:m] <= span) & (doc[own[least - 1 :]] == doc[own[:m]])
    last = np.maximum.accumulate(np.where(begins, own[:m], -span - 1))
    return own - np.concatenate([last, np.full(least - 1, last[-1])]) <= span


def search(index: Index, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Passages of the texts that are items but for a few edits: text, item, first word, words, distance.

    A run of words within k edits of an item of n words shares at least n - 2 - 3 k runs of
    three words with it, among the n + k words from its start; places with fewer from the
    items of that size are passed over, which loses nothing. Elsewhere windows of n words are
    embedded and looked up, one at every ``stride`` words of a text, and the words around those
    that an item's key finds are verified. Keys miss passages; so wherever a single item
    shares enough runs for fewer edits than its keys have found in the text, the words there
    are verified as well. The result is that of verifying every item in every text.
    """
    h, first = text_words(texts)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = first[1:][doc] if len(doc) else doc
    g = grams(h)
    hit = np.flatnonzero(index.has(g) & (np.arange(len(h)) + GRAM <= end))
    found = []
    for n, (known, rows) in index.short.items():
        at = np.flatnonzero(np.arange(len(h)) + n <= end)
        own = grams(h, n)[at]
        low = np.searchsorted(known, own)
        count = np.searchsorted(known, own, side="right") - low
        at, item = np.repeat(at, count), rows[_ranges(low, count)]
        same = (h[at[:, None] + np.arange(n)] == index.strings[n][item]).all(1)
        at, item = at[same], item[same]
        found.append((at, index.ids[n][item], np.full(len(at), n), np.zeros(len(at), np.int64)))
    windows, places = {}, {}
    for n, known in index.grams.items() if len(hit) else ():
        k = edits(n)
        step = stride(k)
        least = n - GRAM + 1 - GRAM * k
        own = hit[np.isin(g[hit], known)]
        own = own[_dense(own, doc, least, n + k - GRAM)]
        if not len(own):
            continue
        # Places up to n + k words before a shared run, each once: every run adds those after the one before it.
        low = np.maximum(np.maximum(own - (n + k - GRAM), first[doc[own]]), np.concatenate([[-1], own[:-1]]) + 1)
        at = _ranges(low, own - low + 1)
        at = at[(at - first[doc[at]]) % step == 0]
        shared = np.searchsorted(own, np.minimum(at + n + k, end[at]) - GRAM, side="right") - np.searchsorted(own, at)
        windows[n], places[n] = at[shared >= least - (step - 1)], own
    keyed = _match(index, h, windows, first, doc, end)
    for n, own in places.items():
        for at, item, dist in keyed[n] + _missed(index, h, g, own, first, doc, end, n, keyed[n]):
            found.append((at, index.ids[n][item], np.minimum(n, end[at] - at), dist))
    if not found:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty
    at, item, n, dist = (np.concatenate(x) for x in zip(*found, strict=True))
    text = doc[at]
    order = np.lexsort((at, dist, item, text))
    text, item, at, n, dist = text[order], item[order], at[order], n[order], dist[order]
    new = np.concatenate([np.ones(min(1, len(text)), bool), (text[1:] != text[:-1]) | (item[1:] != item[:-1])])
    return text[new], item[new], (at - first[text])[new], n[new], dist[new]


def _match(index: Index, h: np.ndarray, windows: dict[int, np.ndarray], first: np.ndarray, doc: np.ndarray, end: np.ndarray) -> dict[int, list[tuple]]:
    """Verified matches of windows with items, by their number of words: first word, item, distance.

    Windows of about as many words are embedded together: a string's walk is the same
    whatever zeros follow it.
    """
    out = {n: [] for n in windows}
    for most in sorted({1 << (n - 1).bit_length() for n in windows}):
        sizes = [n for n in sorted(windows) if 1 << (n - 1).bit_length() == most]
        all_at, all_n = np.concatenate([windows[n] for n in sizes]), np.repeat(sizes, [len(windows[n]) for n in sizes])
        per = max(1, MATCH_WORDS // most)
        for lo in range(0, len(all_at), per):
            at, size = all_at[lo : lo + per], all_n[lo : lo + per]
            wide = int(size.max())
            cols = at[:, None] + np.arange(wide)
            x = np.where(cols < np.minimum(at + size, end[at])[:, None], h[np.minimum(cols, len(h) - 1)], _U(0))
            rows = {n: slice(*np.searchsorted(size, [n, n + 1])) for n in np.unique(size).tolist()}
            mine = {n: [] for n in rows}
            for walk in range(WALKS):
                y = embed(x, walk)
                for n, own in rows.items():
                    mine[n] += walk_keys(y[own], n, walk, index.schemes[n])
            for n, own in rows.items():
                keys, owner = index.keys[n]
                looked = np.stack(mine[n], axis=1)
                low = np.searchsorted(keys, looked.ravel())
                count = np.searchsorted(keys, looked.ravel(), side="right") - low
                pairs = np.repeat(np.arange(len(count)) // looked.shape[1], count) * len(index.strings[n]) + owner[_ranges(low, count)]
                w, item = np.divmod(np.unique(pairs), len(index.strings[n]))
                begin = at[own][w]
                k = edits(n)
                start = np.maximum(begin - k, first[doc[begin]])
                out[n] += _verify(index, h, start, begin - start + k, end[begin], item, n, n + 3 * k + 1)
    return out


def _verify(index: Index, h: np.ndarray, start: np.ndarray, lead: np.ndarray, end: np.ndarray, item: np.ndarray, n: int, width: int) -> list[tuple]:
    """The runs nearest to items that begin up to ``lead`` words after ``start``, where they are near enough: first word, item, distance."""
    out = []
    per = max(1, MATCH_WORDS // n)
    for a in range(0, len(start), per):
        s, i = start[a : a + per], item[a : a + per]
        cols = s[:, None] + np.arange(width)
        around = np.where(cols < end[a : a + per, None], h[np.minimum(cols, len(h) - 1)], _U(0))
        d, at = edit_distances(index.strings[n][i], around, lead[a : a + per])
        ok = d <= edits(n)
        out.append(((s + at)[ok], i[ok], d[ok]))
    return out


def _missed(index: Index, h: np.ndarray, g: np.ndarray, own: np.ndarray, first: np.ndarray, doc: np.ndarray, end: np.ndarray, n: int, keyed: list[tuple]) -> list[tuple]:
    """Matches with fewer edits than ``keyed`` has for the text and item, wherever an item shares enough grams for them.

    ``own`` are the places of grams from items of n words. The starts to be verified are
    dealt out in tiles of n + k words.
    """
    k, many = edits(n), len(index.strings[n])
    have, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if keyed:
        at, item, best = (np.concatenate(x) for x in zip(*keyed, strict=True))
        have = doc[at] * many + item
        order = np.lexsort((best, have))
        have, at = np.unique(have[order], return_index=True)
        best = best[order][at]
    owners, gram = index.owners[n], np.searchsorted(index.grams[n], g[own])
    total = int((np.searchsorted(owners, (gram + 1) * many) - np.searchsorted(owners, gram * many)).sum())
    parts = 1 if total <= 4 * MATCH_WORDS else min(many, -(-len(own) * many // (4 * MATCH_WORDS)))
    out = []
    for part in range(parts):
        lo = np.searchsorted(owners, gram * many + many * part // parts)
        count = np.searchsorted(owners, gram * many + many * (part + 1) // parts) - lo
        item, at = owners[_ranges(lo, count)] % many, np.repeat(own, count)
        pair = doc[at] * many + item
        known = np.searchsorted(have, pair)
        seen = known < len(have)
        seen[seen] = have[known[seen]] == pair[seen]
        most = np.full(len(pair), k)
        most[seen] = best[known[seen]] - 1
        keep = np.flatnonzero(most >= 0)
        keep = keep[np.argsort(item[keep], kind="stable")]
        item, at, pair, most = item[keep], at[keep], pair[keep], most[keep]
        # The last of as many shared grams as so few edits leave must lie in the same run.
        last = np.arange(len(at)) + n - GRAM - GRAM * most
        begins = np.flatnonzero(last < len(at))
        last = last[begins]
        ok = (pair[last] == pair[begins]) & (at[last] + GRAM - at[begins] <= n + most[begins])
        begins, last = begins[ok], last[ok]
        base = first[doc[at[begins]]]
        low = (np.maximum(at[last] + GRAM - n - most[begins], base) - base) // (n + k)
        count = (at[begins] - base) // (n + k) - low + 1
        tiles = np.stack([np.repeat(base, count) + _ranges(low, count) * (n + k), np.repeat(item[begins], count)], axis=1)
        start, item = np.unique(tiles, axis=0).T
        out += _verify(index, h, start, np.full(len(start), n + k), end[start], item, n, 2 * (n + k) + 1)
    return out


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block: int = BLOCK_ITEMS):
    """Indexes of the items, at most about ``block`` items and BLOCK_BYTES of text in each, so that what is broadcast is bounded."""
    items = benchmark.select(F.col(item_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    all_ = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    n = max(-(-all_.n // block), -(-all_.size // BLOCK_BYTES), 1)
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).orderBy("id", "text").toArrow()
        index = build(rows.column("id").to_pylist(), rows.column("text").to_pylist())
        if index is not None:
            yield benchmark.sparkSession.sparkContext.broadcast(index)


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK_ITEMS) -> DataFrame:
    """``doc_id, item_id, first_word, n_words, distance``: the best window of each document and item that match.

    Words are runs of letters and digits, case folded. An item matches a run of words within
    20 edits of words per hundred; items under ten words must match exactly. Null and wordless
    texts match nothing; items with a null id match as others do and have a null ``item_id``;
    repeated documents get a row each, items that repeat an id one for all. Of equal
    distances the first place is given; it follows from text and item alone, whatever
    other texts lie beside it. No items or documents give no rows. Each block of items is a
    pass over the documents.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, item_id bigint, first_word bigint, n_words bigint, distance bigint"
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = None
    for index in item_blocks(benchmark, item_col, item_text_col, block):

        def run(batches, index=index):
            for batch in batches:
                for b in chunks(batch, "text", 1 << 20):
                    text, item, *rest = search(index.value, b.column("text"))
                    item = pa.array(item, mask=item == index.value.null)
                    yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(text)), item, *map(pa.array, rest)], ["doc_id", "item_id", "first_word", "n_words", "distance"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK_ITEMS) -> DataFrame:
    """The documents without such a passage, columns as they were; texts stay where they lie.

    Nulls, short items, repeated rows and empty tables are as in ``contaminated``. All
    blocks of items are passed in one scan.
    """
    for index in item_blocks(benchmark, item_col, item_text_col, block):

        def run(batches, index=index):
            for batch in batches:
                for b in chunks(batch, text_col, 1 << 20):
                    keep = np.ones(b.num_rows, bool)
                    keep[search(index.value, b.column(text_col))[0]] = False
                    yield b.filter(pa.array(keep))

        docs = small_batches(docs).mapInArrow(run, docs.schema)
    return docs
