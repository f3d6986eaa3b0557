"""Benchmark decontamination and ranked lexical search against plain Python."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import LONG, empty_documents, odd_documents

from scanloom.llm import decontaminate, lexical, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def plain_words(text):
    return WORD.findall((text or "").translate(UPPER))


def chance_texts(n, seed, longest=60, vocabulary=14):
    r = random.Random(seed)
    known = [f"w{i}" for i in range(vocabulary)] + ["Ünder", "ÉTÉ", "the", "THE", "42"]
    return [r.choice([" ", ", ", "\n", "--"]).join(r.choice(known) for _ in range(r.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("segment", [1, 7, 64, 1 << 20])
def test_word_blocks_find_all_words_once(segment):
    texts = chance_texts(30, 1) + [None, "", "  ", "a", "é" * 50, LONG[:3000]]
    got = [[] for _ in texts]
    seen = [0] * len(texts)
    for block in words.word_blocks(pa.array(texts, pa.string()), overlap=3, segment=segment):
        low = block.low.tobytes()
        found = [low[a:b].decode() for a, b in zip(block.starts.tolist(), block.ends.tolist())]
        again = block.doc[0] if len(found) else 0
        assert found[: block.repeated] == got[again][len(got[again]) - block.repeated :]
        for doc, word in list(zip(block.doc.tolist(), found))[block.repeated :]:
            got[doc].append(word)
            seen[doc] += 1
    assert got == [plain_words(t) for t in texts]


def test_equal_hashes_are_told_apart():
    index = words.HashIndex(np.array([5, 9, 5, 7], np.uint64))
    places, entries = index.find(np.array([5, 1, 7], np.uint64))
    assert sorted(zip(places.tolist(), entries.tolist())) == [(0, 0), (0, 2), (2, 3)]


def test_blocks_hold_every_item_once_within_the_limit(spark):
    rows = [(i, "x" * (20 + i % 7)) for i in range(200)] + [(500, "y" * 5000), (501, "z" * 900), (None, "n"), (502, None)]
    items = spark.createDataFrame(rows, "item long, text string")
    blocks = [b.collect() for b in words.in_blocks(items, "text", ["item"], 600)]
    assert sorted((r.item or -1) for b in blocks for r in b) == sorted((i or -1) for i, _ in rows)
    assert all(sum(16 + len(r.text or "") for r in b) <= 600 or len(b) == 1 for b in blocks)
    assert len(blocks) < 70
    assert len(words.in_blocks(items, "text", ["item"])) == 1
    assert len(words.in_blocks(items.filter("false"), "text", ["item"], 10)) == 1


def brute_overlaps(texts, items, window=10):
    held = collections.defaultdict(set)
    for name, text in items:
        found = plain_words(text)
        size = min(window, len(found))
        for i in range(len(found) - size + 1 if size else 0):
            held[tuple(found[i : i + size])].add("" if name is None else str(name))
    out = []
    for text in texts:
        found, hit, names = plain_words(text), set(), set()
        for size in {len(w) for w in held}:
            for i in range(len(found) - size + 1):
                if tuple(found[i : i + size]) in held:
                    hit.update(range(i, i + size))
                    names |= held[tuple(found[i : i + size])]
        out.append((len(found), len(hit), sorted(names), hit))
    return out


def overlap_cases():
    items = [(i, t) for i, t in enumerate(chance_texts(20, 3, 30))] + [(7, "one word more"), (None, "w1 w2"), (30, ""), (31, None)]
    whole = [t for _, t in items if t and len(plain_words(t)) >= 10]
    r = random.Random(4)
    texts = chance_texts(60, 5, 40, 400)
    for k in range(0, 60, 2):
        texts[k] += " " + r.choice(whole).upper() + " " + texts[k - 1]
    texts += [None, "", whole[0], "x " * 50 + whole[1], "ONE, word; more", LONG + whole[2] + LONG]
    return texts, items


@pytest.mark.parametrize("block_bytes", [words.ITEM_BYTES, 300])
def test_overlaps_equal_brute_force(spark, monkeypatch, block_bytes):
    texts, items = overlap_cases()
    deal = decontaminate.in_blocks
    monkeypatch.setattr(decontaminate, "in_blocks", lambda *a: deal(*a, limit=block_bytes))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find_overlaps(docs, bench).collect()}
    for i, (n, n_hit, names, hit) in enumerate(brute_overlaps(texts, items)):
        assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == (n, n_hit, names)
        assert {w for s in got[i].spans for w in range(s.first, s.after)} == hit


def test_spans_and_documents_are_removed(spark):
    texts, items = overlap_cases()
    docs = spark.createDataFrame([(i, t, "kept", i) for i, t in enumerate(texts)], "doc_id long, text string, items string, _words long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = brute_overlaps(texts, items)
    cut = decontaminate.remove_spans(docs, bench)
    assert cut.columns == docs.columns
    for r in cut.collect():
        words_before = plain_words(texts[r.doc_id])
        assert plain_words(r.text) == [w for i, w in enumerate(words_before) if i not in found[r.doc_id][3]]
        assert found[r.doc_id][1] or r.text == texts[r.doc_id]
        assert (r["items"], r["_words"]) == ("kept", r.doc_id)
    kept = decontaminate.remove_documents(docs, bench).collect()
    assert {r.doc_id for r in kept} == {i for i, f in enumerate(found) if not f[1]}
    some = decontaminate.remove_documents(docs, bench, share=0.5).collect()
    assert {r.doc_id for r in some} == {i for i, f in enumerate(found) if 2 * f[1] <= f[0]}


def test_long_texts_keep_windows_over_cuts(spark, monkeypatch):
    texts, items = overlap_cases()
    monkeypatch.setattr(decontaminate, "word_blocks", lambda t, overlap=0, segment=64: words.word_blocks(t, overlap, segment))
    windows = decontaminate.WindowSet([("" if n is None else str(n), t or "") for n, t in items], 10)
    n, spans, found = decontaminate._scan_texts(pa.array(texts, pa.string()), windows, 10)
    for i, (count, _, names, hit) in enumerate(brute_overlaps(texts, items)):
        assert (n[i], sorted(found[i])) == (count, names)
        assert {w for a, b in spans[i] for w in range(a, b)} == hit


def test_overlaps_of_odd_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again a second line"), (2, None)], "item_id long, text string")
    rows = decontaminate.find_overlaps(odd_documents(spark, extra=True), bench).collect()
    assert sorted((r.doc_id or -1, r.n_hit, len(r["items"])) for r in rows if r.n_hit) == [(-1, 10, 1), (1, 13, 1), (6, 13, 1), (6, 13, 1)]
    none = spark.createDataFrame([], bench.schema)
    assert all(r.n_hit == 0 and r["items"] == [] for r in decontaminate.find_overlaps(odd_documents(spark), none).collect())
    assert decontaminate.find_overlaps(empty_documents(spark), bench).collect() == []
    assert decontaminate.remove_spans(empty_documents(spark), bench).collect() == []


def brute_search(docs, items, k):
    terms = [(i, collections.Counter(plain_words(t))) for i, t in docs]
    terms = [(i, c, sum(c.values())) for i, c in terms if c]
    documents, length = len(terms), sum(n for _, _, n in terms)
    held = collections.Counter(t for _, c, _ in terms for t in c)
    texts = collections.defaultdict(list)
    for item, text in sorted(set(items), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        texts[item] += plain_words(text)
    out = []
    for item, asked in texts.items():
        scored = []
        for i, c, n in terms:
            m = 75 + (25 * n * documents) // length
            score = sum(
                math.floor(1000 * math.log((2 * documents + 2) / (2 * held[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                for t in asked
                if c[t]
            )
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def searched(spark, docs, items, k):
    rows = lexical.search(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
        spark.createDataFrame(items, "item_id long, text string"),
        k,
    ).collect()
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in rows), key=str)


@pytest.mark.parametrize("k, item_bytes, cells", [(3, 1 << 20, 1 << 21), (20, 400, 100), (1000, 1 << 20, 1000)])
def test_search_equals_brute_force(spark, monkeypatch, k, item_bytes, cells):
    monkeypatch.setattr(lexical, "ITEM_BYTES", item_bytes)
    monkeypatch.setattr(lexical, "NODE_CELLS", cells)
    docs = list(enumerate(chance_texts(400, 8, 50, 200)))
    # Copies tie, and fill more places than there are; repeated, null and empty rows.
    docs += [(1000 + i, docs[3][1]) for i in range(40)] + [(5, docs[5][1]), (None, docs[3][1]), (None, None), (2000, ""), (2001, LONG)]
    items = list(enumerate(chance_texts(30, 9, 25, 300))) + [(3, "w5 w5 w7"), (3, "w5 w5 w7"), (None, "the w9"), (77, None), (78, "nowhere")]
    assert searched(spark, docs, items, k) == brute_search(docs, items, k)


def test_walk_leaves_out_most_leaves():
    r = random.Random(11)
    docs = [" ".join(f"t{g}x{r.randint(0, 30)}" for _ in range(30)) for g in range(40) for _ in range(40)]
    items = [(g, " ".join(f"t{g}x{r.randint(0, 30)}" for _ in range(12))) for g in range(40)]
    terms = lexical.Terms(items)
    n, doc, term, times = terms.counted(pa.array(docs))
    given = lexical.shares(times, n[doc], len(docs), int(n.sum()))
    order = lexical.neighbours(doc, term, given, len(docs))
    tree = lexical.DocumentTree(np.argsort(order)[doc], term, given, order.tolist(), len(terms.terms))
    searcher = lexical.Searcher(terms, np.full(len(terms.terms), 1000), 5)
    met = []
    score = searcher.score
    searcher.score = lambda q, d, leaf: (met.append((q, leaf)), score(q, d, leaf))
    searcher.search(tree)
    assert len(met) < 5 / 8 * 50 * 5
    assert all(len(heap) == 5 for heap in searcher.best)


def test_search_of_odd_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "quick fox"), (2, None)], "item_id long, text string")
    found = lexical.search(odd_documents(spark, extra=True), bench).collect()
    assert [(r["rank"], r.doc_id) for r in sorted(found, key=lambda r: r["rank"])] == [(1, None), (2, 1), (3, 6), (4, 6)]
    assert lexical.search(empty_documents(spark), bench).collect() == []
    assert lexical.search(odd_documents(spark), spark.createDataFrame([], bench.schema)).collect() == []
