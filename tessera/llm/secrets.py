"""Secret scans, with ownership frequency over the whole corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# The base patterns, letters of keywords in either case. A pattern's matches
# are those of its contract once short ones are dropped: runs are matched whole.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: What ownership frequency judges besides: long runs of base64 letters.
BLOB = r"[A-Za-z0-9+/_=-]{28,}"
KINDS = ("assign", "access", "hex", "live")
_SPAN = "array<struct<kind:string,start:bigint,stop:bigint,value:string>>"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), which is computed once however often use refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _grouped(items: Column) -> Column:
    """A non-empty array cut into about as many groups as each has items, so that what grows with the square of a group's size stays small."""

    def cut(items: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(items))).cast("int")
        return _once(width, lambda w: F.transform(F.sequence(F.lit(0), F.ceil(F.size(items) / w).cast("int") - 1), lambda k: F.slice(items, k * w + 1, w)))

    return _once(items, cut)


def _begins(lengths: Column) -> Column:
    """Where each match begins, given the lengths of the gap before it and of the match: sums by group, then within each."""
    start = lambda at: F.struct(at.alias("at"), F.array().cast("array<bigint>").alias("out"))
    both = lambda p: p["gap"] + p["hit"]

    def heads(groups: Column) -> Column:
        total = lambda g: F.aggregate(g, F.lit(0).cast("bigint"), lambda acc, p: acc + both(p))
        return F.aggregate(groups, start(F.lit(0).cast("bigint")), lambda acc, g: F.struct((acc["at"] + total(g)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def inside(group: Column, head: Column) -> Column:
        step = lambda acc, p: F.struct((acc["at"] + both(p)).alias("at"), F.concat(acc["out"], F.array(acc["at"] + p["gap"])).alias("out"))
        return F.aggregate(group, start(head), step, lambda acc: acc["out"])

    return _once(_grouped(lengths), lambda groups: F.flatten(F.zip_with(groups, heads(groups), inside)))


def _spans(text: Column, kind: str, pattern: str) -> Column:
    """Leftmost non-overlapping matches with code-point offsets.

    The text between matches and the matches alternate, so running lengths give offsets.
    """
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), F.split(text, pattern, -1).alias("gap"))
    pair = lambda g, h: F.struct(F.length(g).cast("bigint").alias("gap"), F.length(h).cast("bigint").alias("hit"))
    span = lambda h, at: F.struct(F.lit(kind).alias("kind"), at.alias("start"), (at + F.length(h)).alias("stop"), h.alias("value"))
    scanned = _once(found, lambda f: F.zip_with(f["hit"], _begins(F.zip_with(F.slice(f["gap"], 1, F.size(f["hit"])), f["hit"], pair)), span))
    return F.when(F.regexp_like(text, F.lit(pattern)), scanned).otherwise(F.array().cast(_SPAN))


def _apart(blobs: Column, assigns: Column) -> Column:
    """Blobs that no assignment overlaps; assignments are looked through by groups."""
    meets = lambda a, b: (a["start"] < b["stop"]) & (b["start"] < a["stop"])
    first, last = lambda g: F.get(g, F.lit(0)), lambda g: F.element_at(g, -1)
    range_of = lambda g: F.struct(first(g)["start"].alias("start"), last(g)["stop"].alias("stop"), g.alias("items"))
    apart = _once(F.transform(_grouped(assigns), range_of), lambda groups: F.filter(blobs, lambda b: ~F.exists(groups, lambda g: meets(g, b) & F.exists(g["items"], lambda a: meets(a, b)))))
    return F.when((F.size(assigns) > 0) & (F.size(blobs) > 0), apart).otherwise(blobs)


def base_spans(text: Column) -> dict[str, Column]:
    """The three base kinds; an assignment's value must have at least six characters."""
    value = lambda s: F.regexp_extract(s["value"], ASSIGN, 2)
    return {
        "assign": F.filter(_spans(text, "assign", ASSIGN), lambda s: F.length(value(s)) >= 6),
        "access": _spans(text, "access", ACCESS),
        "hex": _spans(text, "hex", HEX),
    }


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then by kind as listed."""
    order = F.transform(spans, lambda s: F.struct(s["start"], F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["stop"], s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(order), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def secret_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", repo: Column | None = None, owner: Column | None = None, max_owners: int = 1, max_repos: int = 2) -> DataFrame:
    """Base spans of each text, and long tokens that only one owner has.

    A candidate is what a base span holds, or a run of base64 letters with a digit, a lower
    and an upper letter that overlaps no base span. Hashes of candidates are counted over the
    whole corpus by distinct repositories and owners. Runs that stay with at most
    ``max_owners`` owners and ``max_repos`` repositories look live and are added as spans of
    kind ``live``; what many owners copy is taken for an example and is not added. Base
    spans always stay; ``live_base`` counts those whose value looks live.

    ``repo`` and ``owner`` default to the source joined with the language, and the source; a
    null counts as one value. Null and empty texts have no spans; rows that repeat an id get a
    row each, with the spans of all texts of that id counted on their own row.
    """
    scratch = Scratch(docs.sparkSession)
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", F.col("source"), F.col("lang")) if repo is None else repo
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("version"), F.coalesce(owner.cast("string"), F.lit("\0")).alias("owner"), F.coalesce(repo.cast("string"), F.lit("\0")).alias("repo"),
        *(c.alias(k) for k, c in base_spans(text).items()), _spans(text, "live", BLOB).alias("blob"),
    )
    # Access keys and hex runs are made of base64 letters, so a run that meets one holds it whole.
    like = lambda s, p: F.regexp_like(s["value"], F.lit(p))
    mixed = F.filter("blob", lambda s: like(s, "[0-9]") & like(s, "[a-z]") & like(s, "[A-Z]") & ~like(s, ACCESS) & ~like(s, HEX))
    found = found.withColumns({"base": F.concat("assign", "access", "hex"), "blob": mixed}).withColumn("blob", _apart(F.col("blob"), F.col("assign")))
    found = scratch.save(found, "spans")

    # The value alone identifies a secret; an assignment's is its second group.
    hashed = lambda s: F.md5(F.when(s["kind"] == "assign", F.regexp_extract(s["value"], ASSIGN, 2)).otherwise(s["value"]))
    some = found.where("size(base) + size(blob) > 0").select("id", "version", "owner", "repo", F.explode(F.concat("base", "blob")).alias("span"))
    some = some.withColumn("hash", hashed(F.col("span")))
    owned = some.select("hash", "owner", "repo").distinct()
    owned = owned.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos")).groupBy("hash").agg(F.sum("repos").alias("repos"), F.count(F.lit(1)).alias("owners"))
    live = scratch.save(owned.where((F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)).select("hash"), "live")

    # One owner may repeat one value in very many rows: distinct pairs come before the join, and both sides are plain scans.
    per_doc = some.join(live.hint("merge"), "hash").groupBy("id", "version").agg(F.collect_set("span").alias("live_spans"))
    per_doc = per_doc.withColumnsRenamed({"id": "lid", "version": "lversion"})
    out = found.join(per_doc, F.col("id").eqNullSafe(F.col("lid")) & (F.col("version") == F.col("lversion")), "left")
    none = F.coalesce("live_spans", F.array().cast(_SPAN))
    out = out.withColumn("live", F.filter(none, lambda s: s["kind"] == "live"))
    return out.select(
        "id", *("assign access hex live".split()), "base",
        F.concat("base", "live").alias("spans"), F.size(F.filter(none, lambda s: s["kind"] != "live")).cast("long").alias("live_base"),
    )


def secret_report(docs: DataFrame, *, id_col: str = "doc_id", **kw) -> DataFrame:
    """Counts, the base spans' digest and all spans of each document."""
    s = secret_spans(docs, id_col=id_col, **kw)
    n = lambda k: F.size(k).cast("long").alias(f"n_{k}")
    return s.select(F.col("id").alias(id_col), n("assign"), n("access"), n("hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), n("live"), "live_base")
