"""MinHash near-duplicates with sequential Bayesian verification."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, mix64, utf8, word_hashes, words
from .common import Scratch, maybe_broadcast, small_batches
from .graph import connected_components

#: Words in a shingle, and the similarity (in hundredths) from which documents are linked.
SHINGLE, PERCENT = 5, 75
#: Hashes in a signature: BANDS bands of ROWS. At similarity 0.75 a pair shares no band with probability (1 - 0.75^5)^32 = 1.7e-4.
BANDS, ROWS = 32, 5
#: Signature hashes compared at a time, and the posterior probability of a link below which a pair is dropped.
BATCH, MISS = 32, 1e-4
#: Members of a bucket in a block at least, and how a block grows with the root of the bucket's size: m members make about m^1.5 / GROW rows of blocks that meet in pairs.
BLOCK, GROW = 256, 8
#: Bytes of sets in a block, at least and at most.
BLOCK_BYTES, MOST_BYTES = 4 << 20, 32 << 20
_U = np.uint64

# ---- sets and signatures --------------------------------------------------------------


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct shingles; of its whole word sequence if that is shorter; none without words."""
    data, off = utf8(texts)
    starts, ends, first = words(data, off)
    h = word_hashes(data, starts, ends)
    lanes = [mix64(h + _U(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)) for k in range(SHINGLE)]
    n = max(len(h) - SHINGLE + 1, 0)
    full = mix64(np.add.reduce([lane[k : k + n] * _U(2 * k + 1) for k, lane in enumerate(lanes)])) if n else h[:0]
    out = []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if z - a >= SHINGLE:
            out.append(np.unique(full[a : z - SHINGLE + 1]))
        elif z > a:
            out.append(mix64(np.array([sum(int(lanes[k][a + k]) * (2 * k + 1) for k in range(z - a)) + (z - a) & (1 << 64) - 1], _U)))
        else:
            out.append(h[:0])
    return out


@cache
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    r = mix64(np.arange(1, 2 * BANDS * ROWS + 1, dtype=_U) * _U(0xA24BAED4963EE407))
    r = (r >> _U(32)).astype(np.uint32)
    return r[: BANDS * ROWS] | np.uint32(1), r[BANDS * ROWS :]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each permutation over a set."""
    a, b = _permutations()
    low, high = (shingles & _U(0xFFFFFFFF)).astype(np.uint32), (shingles >> _U(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 256):
        x = low[at : at + 256, None] * a + b
        x ^= x >> np.uint32(15)
        x += high[at : at + 256, None]
        x *= np.uint32(0x9E3779B1)
        np.minimum(out, x.min(0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band."""
    h = np.arange(1, BANDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
    for column in sig.reshape(BANDS, ROWS).T:
        h = mix64(h ^ column.astype(_U) * _U(0xD6E8FEB86659FD93))
    return h.view(np.int64)


def _digest(shingles: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return b"".join(np.add.reduce(mix64(shingles ^ k)).astype("<u8").tobytes() for k in (_U(0x243F6A8885A308D3), _U(0x13198A2E03707344)))


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, version, n_shingles, digest, sig, bands`` of every document; digest and signature are null for an empty set. version is a hash of the text."""

    def run(batches):
        for batch in batches:
            for b in chunks(batch, "text", 1 << 20):
                sets = shingle_sets(b.column("text"))
                sigs = [signature(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([
                    b.column("id"), b.column("version"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([None if s is None else s.tobytes() for s in sigs], pa.binary()), pa.array([None if s is None else band_keys(s) for s in sigs], pa.list_(pa.int64())),
                ], ["id", "version", "n_shingles", "digest", "sig", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, version bigint, n_shingles bigint, digest binary, sig binary, bands array<bigint>")


# ---- Bayesian pruning -----------------------------------------------------------------


@cache
def least_matches() -> np.ndarray:
    """Matches needed after each batch of hashes for P(similarity >= threshold) to reach MISS.

    The prior of the similarity is uniform; given m matches of n hashes the posterior is
    Beta(m + 1, n - m + 1), integrated here on a grid.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(s) + (n - m) * np.log1p(-s)
            p = np.exp(log - log.max())
            if p[s >= PERCENT / 100].sum() / p.sum() >= MISS:
                break
        out.append(m)
    return np.array(out)


def likely(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two arrays of signatures stay, batch after batch."""
    alive, same = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, need in enumerate(least_matches()):
        part = slice(k * BATCH, (k + 1) * BATCH)
        same = same + (a[alive, part] == b[alive, part]).sum(1)
        alive, same = alive[same >= need], same[same >= need]
    return alive


def _sigs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)


def prune(pairs: DataFrame) -> DataFrame:
    """Pairs ``(u, v, n_u, n_v, sig_u, sig_v)`` that may be links: ``(u, v, n_u, n_v)``."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                keep = likely(_sigs(b.column("sig_u")), _sigs(b.column("sig_v")))
                yield b.select(["u", "v", "n_u", "n_v"]).take(pa.array(keep))

    return pairs.mapInArrow(run, pairs.select("u", "v", "n_u", "n_v").schema)


# ---- links ----------------------------------------------------------------------------


def _with_sigs(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    side = lambda k: reps.select(F.col("id").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("sig").alias(f"sig_{k}"))
    j = pairs.join(side("v").hint("merge"), "v").join(side("u").hint("merge"), "u")
    # Sets whose sizes alone rule the similarity out need no comparison.
    return j.where(F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * PERCENT).select("u", "v", "n_u", "n_v", "sig_u", "sig_v")


def set_table(ids: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, scratch: Scratch, most_broadcast: int = 500_000) -> DataFrame:
    """``id, shingles``: the full sets of the classes with these distinct numbers, each from the text of its first document.

    A list up to ``most_broadcast``, if its bytes are few too, goes to the scans; a longer one is joined by a shuffle.
    """
    names = classes.join(ids.hint("merge"), "id", "left_semi").select("id", F.col("first.id").alias("doc"), F.col("first.version").alias("version"), "digest")
    names = maybe_broadcast(scratch.save(names, "ids"), most_broadcast)
    rows = docs.select(F.col(id_col).alias("row_id"), F.xxhash64(text_col).alias("row_version"), F.col(text_col).alias("text"))
    rows = rows.join(names, (F.col("row_version") == F.col("version")) & F.col("row_id").eqNullSafe(F.col("doc"))).select("id", "digest", "text")

    def sets(batches):
        for batch in batches:
            for b in chunks(batch, "text", 1 << 20):
                own = shingle_sets(b.column("text"))
                keep = [k for k, (s, d) in enumerate(zip(own, b.column("digest").to_pylist(), strict=True)) if _digest(s) == d]
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(keep, pa.int64())), pa.array([own[k].astype("<u8").tobytes() for k in keep], pa.binary())], ["id", "shingles"])

    return scratch.save(rows.mapInArrow(sets, "id bigint, shingles binary").dropDuplicates(["id"]), "sets")


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """Pairs whose full shingle sets are similar enough: ``(u, v)``.

    Near copies are about as long as each other, so sending a set along with each pair of a
    hub and a member costs as much as the members' own sets do.
    """
    full = set_table(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), classes, docs, id_col, text_col, scratch)

    def run(batches):
        for b in batches:
            keep = [_similar(np.frombuffer(u, "<u8"), [np.frombuffer(v, "<u8")])[0] for u, v in zip(b.column("set_u").to_pylist(), b.column("set_v").to_pylist(), strict=True)]
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    side = lambda k: full.select(F.col("id").alias(k), F.col("shingles").alias(f"set_{k}")).hint("merge")
    joined = pairs.select("u", "v").join(side("v"), "v").join(side("u"), "u").select("u", "v", "set_u", "set_v")
    links = scratch.save(joined.mapInArrow(run, pairs.select("u", "v").schema).distinct(), "linked", arrow_rows=256)
    scratch.drop(full)
    return links


def _similar(a: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which sorted sets are similar enough to a; exact."""
    sizes = np.array([len(o) for o in others])
    flat = np.concatenate(others)
    both = np.add.reduceat(a[np.minimum(np.searchsorted(a, flat), len(a) - 1)] == flat, np.cumsum(sizes) - sizes)
    return 100 * both >= PERCENT * (len(a) + sizes - both)


def _block_groups(members: DataFrame, extra: list[str]) -> DataFrame:
    """Deal each bucket's members into blocks; every two blocks meet in one place (key, p, q), sorted.

    Each member has a row for every block of its bucket. Blocks grow with the root of the
    bucket's size, so that rows grow with its power 1.5 and not with its square.
    """
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    size, room = F.col("size"), F.col("bytes") / BLOCK_BYTES
    blocks = F.greatest(F.least(size / BLOCK, F.sqrt(size) / GROW), F.least(room, F.sqrt(room)), F.col("bytes") / MOST_BYTES, F.lit(1))
    m = members.withColumn("blocks", F.ceil(blocks).cast("int")).withColumn("own", own)
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.select("key", "band", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "comp", "n", "sig", *extra)
    return m.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "side")


def _each_group(t: pa.Table, last: bool) -> tuple[list[pa.Table], pa.Table | None]:
    """The groups of a sorted table; what may go on in the next batch is left over unless it is the last."""
    if not len(t):
        return [], t
    change = np.zeros(len(t) - 1, bool)
    for c in ("key", "p", "q"):
        change |= np.diff(t.column(c).to_numpy()) != 0
    bounds = [0, *(np.flatnonzero(change) + 1).tolist(), len(t)]
    whole = len(bounds) - 1 if last else len(bounds) - 2
    return [t.slice(a, z - a) for a, z in zip(bounds[:whole], bounds[1 : whole + 1], strict=True)], None if last else t.slice(bounds[-2])


def _in_groups(batches, work, out_names: list[str]):
    """Call work(group) for each group of a task's sorted batches and yield its arrays."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        groups, held = _each_group(t if held is None else pa.concat_tables([held, t]), False)
        yield from (pa.RecordBatch.from_arrays([pa.array(c) for c in cols], out_names) for g in groups if len((cols := work(g))[0]))
    if held is not None:
        groups, _ = _each_group(held, True)
        yield from (pa.RecordBatch.from_arrays([pa.array(c) for c in cols], out_names) for g in groups if len((cols := work(g))[0]))


def _partners(g: pa.Table):
    """For each member of a group, its likely partners of other components: (i, js).

    A pair that shares several buckets counts in that of its first band alone.
    """
    id_, comp, n, side = (g.column(c).to_numpy() for c in ("id", "comp", "n", "side"))
    sig, band = _sigs(g.column("sig").combine_chunks()), g.column("band")[0].as_py()
    one_block = g.column("p")[0] == g.column("q")[0]
    right = np.flatnonzero(side == 1)
    for i in np.flatnonzero(side == 0):
        js = np.arange(i + 1, len(id_)) if one_block else right
        js = js[(comp[js] != comp[i]) & (np.minimum(n[js], n[i]) * 100 >= np.maximum(n[js], n[i]) * PERCENT)]
        js = js[likely(np.broadcast_to(sig[i], (len(js), sig.shape[1])), sig[js])] if len(js) else js
        if len(js):
            js = js[(sig[js] == sig[i]).reshape(len(js), BANDS, ROWS).all(2).argmax(1) == band]
        if len(js):
            yield i, js


def likely_members(members: DataFrame) -> DataFrame:
    """``key, id``: members with a likely partner of another component in their bucket.

    ``members (key, band, id, comp, n, sig, size, bytes)``. Signatures are compared in numpy; no
    list of pairs is made.
    """

    def work(g: pa.Table):
        id_ = g.column("id").to_numpy()
        hit = np.zeros(len(id_), bool)
        for i, js in _partners(g):
            hit[i] = True
            hit[js] = True
        return np.full(hit.sum(), g.column("key")[0].as_py()), id_[hit]

    return _block_groups(members, []).mapInArrow(lambda b: _in_groups(b, work, ["key", "id"]), "key bigint, id bigint").distinct()


def cross_links(members: DataFrame) -> DataFrame:
    """Links between different components, found on full sets: ``u, v``.

    Like ``likely_members`` with ``shingles``. Within a group a link joins its components, so
    later pairs of them are passed over: what comes out of a group is a forest, never more
    rows than members, though each likely pair of what is still apart has been verified.
    """

    def work(g: pa.Table):
        id_, comp = g.column("id").to_numpy(), g.column("comp").to_numpy()
        sets = [np.frombuffer(s, "<u8") for s in g.column("shingles").to_pylist()]
        group = np.unique(comp, return_inverse=True)[1]
        us, vs = [], []
        for i, js in _partners(g):
            js = js[group[js] != group[i]]
            if len(js):
                for j in js[_similar(sets[i], [sets[j] for j in js])]:
                    if group[j] != group[i]:
                        group[group == group[j]] = group[i]
                        us.append(id_[i])
                        vs.append(id_[j])
        return np.array(us, id_.dtype), np.array(vs, id_.dtype)

    return _block_groups(members, ["shingles"]).mapInArrow(lambda b: _in_groups(b, work, ["u", "v"]), "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, version, n_shingles, component_id, kept, chosen`` for every document.

    1. One pass makes signatures; documents of equal sets form classes, which are numbered
       and stand for them from here on.
    2. A bucket's first member is paired with the others. Signatures are compared batch by
       batch; a pair goes when the posterior probability of a link falls below MISS. The
       rest is verified on full sets, and links make components.
    3. Where a bucket's members are still in different components, they are compared in
       blocks: signatures first, then, for those with likely partners, full sets. After
       that, each candidate pair has been judged or lies within one component, where it
       could change nothing. Large groups cost comparisons in numpy, but no row for a pair.

    A component is named by its least id, null if none of its rows has one; ``kept`` is
    whether a row has that id. ``chosen`` is true for the text of that name alone: of
    texts that share it, the one with the least version (a hash of the text); rows that
    repeat both are chosen alike. Null and wordless texts have no set, no links and are
    their own component, kept and chosen. Other columns of ``docs`` do not matter; an
    empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    sketches = scratch.save(sketch(docs, id_col, text_col), "sketches")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "version")).alias("first")
    classes = sketches.where("digest is not null").groupBy("digest").agg(first, *(F.first(c).alias(c) for c in ("n_shingles", "sig", "bands")))
    # Written once, so that the numbers stay.
    classes = scratch.save(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    keyed = classes.select(F.posexplode("bands").alias("band", "key"), "id")
    buckets = scratch.save(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("hub")).where("size > 1"), "buckets")
    members = scratch.save(keyed.join(buckets.hint("merge"), "key").select("key", "band", "id", "size", "hub"), "members")

    star = members.where("id <> hub").select(F.col("hub").alias("u"), F.col("id").alias("v")).distinct()
    hopeful = scratch.save(prune(_with_sigs(star, classes)), "hopeful")
    links = verify(hopeful, classes, docs, id_col, text_col, scratch)
    comps = connected_components(links, scratch)

    at = comps.select(F.col("node").alias("id"), F.col("label").alias("comp"))
    open_ = scratch.save(members.join(at.hint("merge"), "id", "left").select("key", "band", "id", "size", F.coalesce("comp", "id").alias("comp")), "open")
    mixed = open_.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    rest = open_.join(scratch.save(mixed, "mixed").hint("merge"), "key", "left_semi")
    rest = rest.join(classes.select("id", F.col("n_shingles").alias("n"), "sig").hint("merge"), "id")
    hopeful = scratch.save(likely_members(rest.withColumn("bytes", F.lit(0))), "likely")
    if hopeful.limit(1).count():
        sets = set_table(hopeful.select("id").distinct(), classes, docs, id_col, text_col, scratch)
        rest = open_.drop("size").join(hopeful.hint("merge"), ["key", "id"]).join(classes.select("id", F.col("n_shingles").alias("n"), "sig").hint("merge"), "id")
        rest = scratch.save(rest, "rest")
        sizes = scratch.save(rest.groupBy("key").agg(F.count(F.lit(1)).alias("size"), (F.sum("n") * 8).alias("bytes")), "sizes")
        rest = rest.join(sizes.hint("merge"), "key").join(sets.hint("merge"), "id")
        links = links.union(scratch.save(cross_links(rest), "crossed", arrow_rows=256))
        comps = connected_components(links, scratch)

    # Components are named by their members' first documents; a class alone by its own.
    linked = scratch.save(comps.join(classes.select(F.col("id").alias("node"), "first").hint("merge"), "node"), "linked")
    names = scratch.save(linked.groupBy("label").agg(F.min("first").alias("name")), "names")
    named = scratch.save(linked.join(names.hint("merge"), "label").select(F.col("node").alias("id"), "name"), "named")
    classes = scratch.save(classes.join(named.hint("merge"), "id", "left").select(F.col("digest").alias("d"), F.coalesce("name", "first").alias("name")), "named")
    out = sketches.select("id", "version", "n_shingles", "digest").join(classes.hint("merge"), F.col("digest") == F.col("d"), "left")
    own = F.col("digest").isNull()
    out = out.withColumn("component_id", F.when(own, F.col("id")).otherwise(F.col("name.id")))
    chosen = own | (F.col("id").eqNullSafe(F.col("name.id")) & (F.col("version") == F.col("name.version")))
    return out.select("id", "version", "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), chosen.alias("chosen"), own.alias("wordless"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = 1_000_000) -> DataFrame:
    """The documents that stay, columns as they were: one row of each component, and every wordless one.

    Rows that repeat an id and a text count as copies: one of them stays, whichever comes
    first. Rows with a null id take part by their text. An empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession)
    judged = scratch.save(near_duplicates(docs, id_col=id_col, text_col=text_col).where("not wordless").select("id", "version", "chosen"), "judged")

    def listed(rows: DataFrame) -> DataFrame:
        return maybe_broadcast(scratch.save(rows.select(F.col("id").alias("listed_id"), F.col("version").alias("listed_version")), "listed"), most_broadcast)

    is_listed = (F.col("version") == F.col("listed_version")) & F.col("id").eqNullSafe(F.col("listed_id"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"))
    rows = rows.join(listed(judged.where("not chosen").distinct()), is_listed, "left_anti")
    again = listed(judged.where("chosen").groupBy("id", "version").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    if again.limit(1).count():
        one = rows.join(again, is_listed, "left_semi").groupBy("id", "version").agg(F.first("row").alias("row"))
        rows = rows.join(again, is_listed, "left_anti").select("row").union(one.select("row"))
    return rows.select("row.*")
