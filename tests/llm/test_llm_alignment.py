"""Cross-tokenizer alignment against a plain walk over token bytes."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers  # noqa: E402
from llm_cases import LONG, empty_documents, odd_documents  # noqa: E402
from sentencepiece import SentencePieceProcessor  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from scanloom.llm import align, queries  # noqa: E402
from scanloom.llm.bpe import byte_symbols  # noqa: E402

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def token_lists(texts):
    """Ids and bytes of the tokens of each text, from the libraries alone; none where they do not fit."""
    library = Tokenizer.from_file(PATHS[0])
    library.encode_special_tokens = True
    back = {s: b for b, s in enumerate(byte_symbols())}
    pieces = SentencePieceProcessor(model_file=PATHS[1])
    out = []
    for text in texts:
        if not text:
            out.append(([], []))
            continue
        a = library.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(back[c] for c in t)) for i, t in zip(a.ids, a.tokens)]
        b = [
            (i, bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode())
            for i in pieces.encode(text)
            for p in [pieces.id_to_piece(i)]
        ]
        whole = (" " + text).encode()
        fits = all(b"".join(t for _, t in side) == whole for side in (a, b))
        out.append((a, b) if fits else ([], []))
    return out


def brute(texts):
    """Groups and overlaps of every text by walking from token to token."""
    rows, counts = [], collections.Counter()
    for a, b in token_lists(texts):
        links, groups, open_a, open_b = [], [], [], []
        i = j = at_a = at_b = 0
        while i < len(a):
            links.append((a[i][0], b[j][0]))
            end_a, end_b = at_a + len(a[i][1]), at_b + len(b[j][1])
            if end_a <= end_b:
                open_a.append(str(a[i][0]))
                i, at_a = i + 1, end_a
            if end_b <= end_a:
                open_b.append(str(b[j][0]))
                j, at_b = j + 1, end_b
            if end_a == end_b:
                groups.append(",".join(open_a) + "|" + ",".join(open_b))
                open_a, open_b = [], []
        counts.update(links)
        rows.append((len(a), len(b), groups, links))
    most = collections.Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [
        (n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), ";".join(groups))
        for n_a, n_b, groups, links in rows
    ]


def texts_of_chance(n, seed=5):
    r = random.Random(seed)
    parts = ["the ", "wordless", " ", "  ", "\n", "\n\n", "\t", "é", "ü", "<|endoftext|>", "<s>", "</s>", "1234", "…",
             " ", "日本", "\U0001f600", "▁", "\0", ", ", ".\n", "don't", "a", "İ", "é", "\r\n", "<0x0A>"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(n)]


def aligned(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id: tuple(r[c] for c in COLUMNS) for r in align.align(docs, *PATHS, **options).collect()}


@pytest.mark.parametrize("piece, pairs", [(1 << 15, 4_000_000), (7, 40), (1, 1)])
def test_alignment_equals_a_plain_walk(spark, piece, pairs):
    texts = texts_of_chance(60 if pairs > 1 else 3) + [None, "", " ", "plain words here"]
    got = aligned(spark, texts, keep_groups=True, piece=piece, pairs_per_pass=pairs)
    assert got == dict(enumerate(brute(texts)))


def test_very_long_texts_are_many_pieces(spark):
    texts = [LONG, "x" * 3000, LONG[:5000]]
    want = [(*row[:-1], hashlib.sha256(row[-1].encode()).hexdigest()) for row in brute(texts)]
    assert aligned(spark, texts, piece=500) == dict(enumerate(want))
    assert aligned(spark, texts) == dict(enumerate(want))


def test_diagonals_cut_a_merge_into_equal_parts():
    r = np.random.default_rng(3)
    for _ in range(50):
        a, b = (np.unique(r.integers(0, 60, r.integers(1, 40))) for _ in range(2))
        order = sorted([(e, 0) for e in a.tolist()] + [(e, 1) for e in b.tolist()])
        for step in range(len(order) + 1):
            i, j = align.diagonal(a, b, step)
            taken = order[: i + j]
            assert step <= i + j <= step + 1
            assert (i, j) == (sum(s == 0 for _, s in taken), sum(s == 1 for _, s in taken))
            assert not (i and j < len(b) and a[i - 1] == b[j])


def test_odd_and_empty_tables(spark):
    docs = odd_documents(spark, extra=True)
    rows = align.align(docs, *PATHS).collect()
    want = collections.Counter()
    kept = docs.select("doc_id", "text").collect()
    for r, row in zip(kept, brute([r.text for r in kept])):
        want[(r.doc_id, *row[:-1], hashlib.sha256(row[-1].encode()).hexdigest() if row[-1] else "")] += 1
    assert collections.Counter((r.doc_id, *(r[c] for c in COLUMNS)) for r in rows) == want
    assert align.align(empty_documents(spark), *PATHS).collect() == []


def test_registered_query_equals_a_plain_walk(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r, row in zip(docs, brute([r.text for r in docs])):
        want[r.doc_id] = (*row[:-1], hashlib.sha256(row[-1].encode()).hexdigest() if row[-1] else "")
    names = [*COLUMNS[:-1], "groups_sha256"]
    got = queries.QUERIES["op13_alignment"](spark, small).collect()
    assert {r.doc_id: tuple(r[c] for c in names) for r in got} == want
    assert len(got) == len(want)
