"""Divergence of sources against a plain count, and the trie against sorted lists."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import divergence
from tessera.llm.divergence import Trie

from .helpers import DOCS, edge_docs, edge_table, empty_table, prose


def plain(rows):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)
        groups[lang or ""].add(source or "")
        count[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= 3]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept} if kept else {}
        own, whole = {s: share(count[lang, s]) for s in sources}, share(sum((count[lang, s] for s in sources), Counter()))
        f = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            pairs = sorted(((-sum(f(own[s][t], own[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            terms = sorted((-f(own[s][t], whole[t]), t.encode()) for t in kept if count[lang, s][t] and own[s][t] > whole[t])
            out += [(lang, s, part, i.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", terms[:200])) for k, (v, i) in enumerate(found)]
    return sorted(out)


def letters(found):
    """Words with letters for their digits, which are no part of a term."""
    return ["".join(chr(97 + int(c)) if c.isdigit() else c for c in w) for w in found]


def got(df):
    return sorted(map(tuple, divergence.divergence(df).collect()))


def test_edges_equal_a_plain_count(spark):
    assert got(edge_table(spark).repartition(4)) == plain(edge_docs())
    assert got(empty_table(spark)) == []


def test_sources_equal_a_plain_count(spark):
    """More terms than are reported, ties, a source without terms, a language without kept terms, words beyond ASCII."""
    r, rows = random.Random(1), []
    for k in range(120):
        vocabulary = letters(prose(k % 4, 2000))
        rows.append((k, " ".join(r.choice(vocabulary) for _ in range(300)) + " Ünïcode_中文-x9y", "en", f"s{k % 4}", 1))
    rows += [(200, "12 34 !", "en", "none", 1), (201, "", "xx", "a", 1), (202, "only here", "xx", "b", 1), (203, None, None, None, 1), (204, "a b a b a b", None, "z", 1), *[(205, "tie eit ite", "", "y", 1)] * 3]
    want = plain(rows)
    assert got(spark.createDataFrame(rows, DOCS).repartition(7)) == want
    assert max(x[5] for x in want) == 200


def test_small_blocks_and_tables(spark, monkeypatch):
    """Within one process: tries sent on early, texts in pieces, blocks of few terms and sums sent on early give the same."""
    rows = [(k, " ".join(letters(prose(k % 5, 200))), "en", f"s{k % 3}", 1) for k in range(30)]
    table = spark.createDataFrame(rows, DOCS)
    usual = got(table)
    for name, value in {"BUCKET": 2, "MOST_TOKENS": 50, "MOST_LEAVES": 60, "MERGED": 11, "BLOCK_TERMS": 9, "MOST_CELLS": 8, "PIECE": 40}.items():
        monkeypatch.setattr(divergence, name, value)

    def in_process(self, run, schema):
        # The functions of the tasks, on batches of all rows, where the changed numbers hold.
        batches = self.toArrow().to_batches(7)
        out = [x for b in run(iter(batches)) for x in b.to_pylist()]
        return spark.createDataFrame(out, schema)

    monkeypatch.setattr(type(table), "mapInArrow", in_process)
    assert got(table) == usual == plain(rows)


@pytest.mark.parametrize("bucket", [divergence.BUCKET, 1, 3])
def test_trie_keeps_the_order_of_bytes(monkeypatch, bucket):
    monkeypatch.setattr(divergence, "BUCKET", bucket)
    r, trie, want = random.Random(bucket), Trie(), {}
    for k in range(6000):
        term = r.choice([b"", b"common prefix of many ", b"common pre"]) * r.randrange(2) + bytes(r.choice(b"ab\xc3\xff") for _ in range(r.randrange(7)))
        want[term] = k
        trie.put(term, k)
    assert list(trie.walk()) == sorted(want.items())


def test_counters_equal_plain_ones(monkeypatch):
    monkeypatch.setattr(divergence, "MOST_TOKENS", 37)
    r, counts, docs, found = random.Random(2), divergence.Counts(), Counter(), defaultdict(Counter)
    for _ in range(200):
        source, pieces = r.choice("xyz"), [[r.choice([b"a", b"b", b"cc", b"\xc3\xa9"]) for _ in range(r.randrange(9))] for _ in range(r.randrange(4))]
        counts.add(source, iter(pieces))
        docs.update({t for p in pieces for t in p})
        for p in pieces:
            for t in p:
                found[t][source] += 1
    rows = [x for b in counts.leaves("l") for x in b.to_pylist()]
    assert rows[0]["term"] == b"" and sorted(rows[0]["sources"]) == ["x", "y", "z"]
    assert [(x["term"], x["docs"], dict(zip(x["sources"], x["counts"], strict=True))) for x in rows[1:]] == [(t, docs[t], dict(found[t])) for t in sorted(found)]


def test_shares_are_exact():
    r = random.Random(3)
    for _ in range(500):
        total = r.randrange(1, r.choice([10, 10**6, 9 * 10**15]))
        count = r.randrange(total)
        assert int(divergence.shares(np.array([count]), np.array([total]))[0]) == 1 + 10**9 * (count + 1) // total
