"""Operators against brute force, the tokenizers library, round trips and held-out labels."""

from __future__ import annotations

import collections
import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from llm_cases import LONG, ODD_ROWS, empty_documents, near_copies, odd_documents  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from scanloom.llm import ann, bpe, chat, components as star, fingerprints, language, line_dedup, minhash, packing, quality, token_files, tokens  # noqa: E402
from scanloom.llm.components import components  # noqa: E402

WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


def library(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


# ---- near-duplicates -------------------------------------------------------------------------


def brute_components(rows, words, num, den):
    sets, parent = {}, {}
    for i, text in rows:
        parts = (text or "").encode().lower().split()
        size = min(words, len(parts))
        sets.setdefault(i, set()).add(
            frozenset(tuple(parts[j : j + size]) for j in range(len(parts) - size + 1)) if parts else frozenset()
        )
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and any(a and b and den * len(a & b) >= num * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in sets}, sets


@pytest.mark.parametrize("words,num,den", [(3, 85, 100), (5, 80, 100)])
def test_near_duplicates_equal_brute_force(spark, words, num, den):
    rows = near_copies()
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words, num, den).collect()
    want, sets = brute_components(rows, words, num, den)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(next(iter(sets[r.doc_id]))) for r in got)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_blocks_give_the_same_components(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 3)
    monkeypatch.setattr(minhash, "FAMILY_SHINGLES", 150)
    rows = near_copies(seed=5, groups=4, size=14)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows, 3, 85, 100)[0]


def test_agreements_needed_keeps_the_chance_of_a_miss():
    for share in (0.5, 0.8, 0.85, 0.95):
        needed = minhash.agreements_needed(share)
        tail = lambda m: sum(
            math.comb(64, k) * share**k * (1 - share) ** (64 - k) for k in range(m)
        )
        assert tail(needed) <= minhash.MISS < tail(needed + 1)


def test_near_duplicates_of_odd_rows(spark):
    rows = minhash.near_duplicates(odd_documents(spark, extra=True), 3, 85, 100).collect()
    assert len(rows) == len(ODD_ROWS)
    by_id = collections.defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    assert {r.component_id for r in by_id[6]} == {1} and not any(r.kept for r in by_id[6])
    assert [(r.n_shingles, r.component_id) for r in by_id[2]] == [(0, 2)]
    assert not any(r.kept for r in by_id[None])
    assert minhash.near_duplicates(empty_documents(spark)).count() == 0


def test_components_equal_union_find(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 440)] + [(7, 7)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent if find(n) != n}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- line dedup ------------------------------------------------------------------------------


def brute_lines(rows):
    key = lambda line: re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    rank = lambda i: 1 << 63 if i is None else i
    holders = collections.defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(rank(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < 2 or rank(i) == min(holders[key(x)])]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_line_dedup_equals_brute_force(spark):
    rows = [(r[0], r[1]) for r in ODD_ROWS] + [
        (20, "  A SECOND line of TEXT. \nshort\nshort\nÉcole des arts"),
        (21, "a second line of text.\nshort\nécole des arts\nunique line number one\nunique line number one"),
        (22, "Unique Line Number One\r\n\nÉcole des arts\t"),
    ]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(map(tuple, got), key=order) == sorted(brute_lines(rows), key=order)


def test_line_dedup_keeps_other_columns(spark):
    got = line_dedup.dedup_lines(odd_documents(spark, extra=True))
    assert got.count() == len(ODD_ROWS)
    assert {r.key for r in got.select("key").collect()} == {"other"} and got.schema["n_lines"].dataType.typeName() == "long"
    assert line_dedup.dedup_lines(empty_documents(spark)).count() == 0


def test_line_dedup_threshold(spark):
    docs = spark.createDataFrame([(k, "a line held by some\n" + "a line held by all") for k in range(2)] + [(2, "a line held by all")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, min_docs=3).collect()}
    assert got == {0: "a line held by some\na line held by all", 1: "a line held by some", 2: ""}


# ---- token ids, packing, files ---------------------------------------------------------------


def fuzz(n, seed=3):
    r = random.Random(seed)
    parts = ["a", "B", "é", "  ", " ", "\n", ",", ".", "'s", "'", "1", "_", "<|endoftext|>", "ΑΣ", "\t", "\u00a0", "!",
             "\u0301", "²", "foo", "\0", "İ", ")", "日本", "Ǆ", "ﬁ", "ᄀ", "ᅡ"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_text_encoder_equals_the_library(path):
    texts = fuzz(3000) + [r[1] or "" for r in ODD_ROWS]
    got = tokens.TextEncoder(path, 500).encode_many(texts)
    want = [np.array(e.ids, "<u4").tobytes() for e in library(path).encode_batch(texts, add_special_tokens=False)]
    assert got == want


def test_packing_covers_every_id_once(spark):
    docs = odd_documents(spark, extra=True).repartition(3)
    got = [r.asDict() for r in packing.pack_documents(docs, WORD, end_id=2, length=256).collect()]
    want = collections.Counter()
    for i, text, *_ in ODD_ROWS:
        ids = np.array([*library(WORD).encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        want[(i, len(ids) // 4, zlib.crc32(ids))] += 1
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, parts in sequences.items():
        place = 0
        for offset, length in sorted(parts):
            assert offset == place
            place += length
        assert place == 256 or k == max(sequences)
    assert sum(r["length"] for r in got) == sum(n * c for (_, n, _), c in want.items())
    whole = collections.Counter(
        (r["doc_id"], r["doc_tokens"], r["ids_crc32"]) for r in got if r["length"] == r["doc_tokens"]
    )
    assert whole and not whole - want
    assert packing.pack_documents(empty_documents(spark), WORD).count() == 0


def test_last_sequence_is_padded_unless_a_power_of_two(spark):
    docs = spark.createDataFrame([(1, "a a a")], "doc_id long, text string")
    assert packing.pack_documents(docs, WORD, length=16).first().padded_length == 4
    docs = spark.createDataFrame([(1, "a a a a")], "doc_id long, text string")
    assert packing.pack_documents(docs, WORD, length=16).first().padded_length == 16


def test_token_files_round_trip(spark):
    got = [tuple(r) for r in token_files.round_trip(odd_documents(spark, extra=True), BYTE).collect()]
    rows = sorted(((i, t or "") for i, t, *_ in ODD_ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    before, want = 0, []
    for i, text in rows:
        ids = np.array([*library(BYTE).encode(text, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, before, len(ids), zlib.crc32(ids.tobytes())))
        before += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert token_files.round_trip(empty_documents(spark), BYTE).count() == 0


def shard(frame_bytes=64):
    import pyarrow as pa

    file = io.BytesIO()
    writer = token_files.ShardWriter(file, pa.int64(), frame_bytes)
    docs = [np.arange(n, dtype="<u4").tobytes() for n in (3, 0, 100, 5, 64, 1)]
    writer.add(pa.array([10, 11, 12, 13, 14, 15], pa.int64()), docs)
    writer.close()
    return file, docs


def test_shard_reads_only_the_frames_of_wanted_documents():
    file, docs = shard()
    reader = token_files.ShardReader(file)
    assert [b"".join(p) for _, _, _, p in reader.read()] == docs
    reader = token_files.ShardReader(file)
    assert [b"".join(p) for _, _, _, p in reader.read([3])] == [docs[3]] and reader.decompressed <= 2
    import zstandard

    file.seek(0)
    assert zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read() == b"".join(docs)


def test_damaged_frames_are_found():
    file, _ = shard()
    raw = bytearray(file.getvalue())
    raw[20] ^= 1
    with pytest.raises(Exception):  # noqa: B017, PT011
        for _, _, _, pieces in token_files.ShardReader(io.BytesIO(bytes(raw))).read():
            b"".join(pieces)
    with pytest.raises(ValueError, match="seek table"):
        token_files.ShardReader(io.BytesIO(bytes(raw[:-4])))


# ---- chat ------------------------------------------------------------------------------------


def test_chat_reads_back_every_turn(spark):
    turns = [
        (1, 2, "user", "b </s> \\1 [x] <s>"), (1, 1, "user", "a\\"), (1, 3, "assistant", "c"), (1, 3, "assistant", "c"),
        (2, None, None, None), (2, 0, "as]si[st", "[+]"), (None, 0, "assistant", ""), (3, 0, "assistant", LONG),
        (3, 1, "assistant", "\n"), (3, 2, "system", "[INST]"),
    ]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(rows)).collect()}
    for conv in {t[0] for t in turns}:
        own = sorted(
            ((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in turns if t[0] == conv)
        )
        assert [(t.role, t.text) for t in got[conv].turns] == [t[2:] for t in own]
        assert got[conv].loss_text == "".join(t[3] for t in own if t[2] == "assistant")
    assert got[1].formatted == "<s>[user]a\\0[+]b \\1/s> \\01 \\2x\\3 \\1s></s><s>[assistant]c[+]c</s>"
    assert chat.format_conversations(rows.filter("false")).count() == 0


# ---- fingerprints ----------------------------------------------------------------------------


def units_of(text):
    """Lines cut after each word whose hash is the least of nine."""
    units, reach = set(), fingerprints.REACH
    for line in text.split("\n"):
        words = re.findall(r"[^ \t\n\x0b\f\r]+[ \t\x0b\f\r]*", line)
        hashes = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in words]
        hashes = [h - (1 << 64) if h >> 63 else h for h in hashes]
        first = 0
        for i, h in enumerate(hashes):
            if h <= min(hashes[max(0, i - reach) : i + reach + 1]):
                units.add("".join(words[first : i + 1]).rstrip(" "))
                first = i + 1
        if first < len(words):
            units.add("".join(words[first:]).rstrip(" "))
    return units


def test_fingerprints_equal_brute_force(spark):
    rows = [(i, t) for i, t in near_copies(seed=2, groups=5, size=4, words=90)] + [(900, LONG), (901, None), (902, LONG + " end")]
    got = {r.doc_id: r for r in fingerprints.fingerprint_versions(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    down = sorted(((i, t or "") for i, t in rows), reverse=True)
    same = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    prints = collections.defaultdict(set)
    for (i, text), (_, following) in zip(down, down[1:] + down[:1]):
        half = len(text) // 2
        edited, r = text[: len(text) - half] + following[:half], got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(same(units_of(text), units_of(edited)))
        assert r.near_next == pytest.approx(same(units_of(text), units_of(following)))
        prints[text].add(r.fingerprint)
        prints[edited].add(r.edited_fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_peeling_recovers_differences_or_says_so(spark):
    cases = [(list(range(1, 2 * n, 2)), list(range(1 + 2 * k, 2 * n + 2 * k, 2))) for n, k in ((5, 1), (40, 2), (30, 30), (0, 0))]
    df = spark.createDataFrame(cases, "a array<long>, b array<long>")
    spread = lambda c: F.transform(c, lambda x: F.shiftrightunsigned(F.xxhash64(x), 1).bitwiseOR(F.lit(1)))
    df = df.select(spread(F.col("a")).alias("a"), spread(F.col("b")).alias("b"))
    found = fingerprints.peel(fingerprints.subtract(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))))
    for r in df.select("a", "b", found.alias("found")).collect():
        want = {(x, 1) for x in set(r.a) - set(r.b)} | {(x, -1) for x in set(r.b) - set(r.a)}
        assert r.found is None and len(want) > 8 or {tuple(f) for f in r.found} == want


def test_sketches_make_numbers_and_copy_no_states(spark):
    """A transform copies what its body gives, whole states of a sketch too, and a struct for each digest costs more
    than its bits; both made most of the time of a likeness."""
    df = spark.createDataFrame([([1, 3, 5], [3, 5, 7])], "a array<long>, b array<long>")
    bound = df.select(fingerprints.let(F.col("a"), lambda v: F.concat(v, v)).alias("x"))
    assert bound.first().x == [1, 3, 5, 1, 3, 5] and "transform(" not in bound._jdf.queryExecution().toString()
    digests = F.transform("a", lambda d: d)
    plan = df.select(fingerprints.difference(digests, F.col("b"), 4).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("named_struct(") <= 1
    apart = df.select(fingerprints.peel(fingerprints.difference(F.col("a"), F.col("b"), 8), 8).alias("x")).first().x
    assert {tuple(p) for p in apart} == {(1, 1), (7, -1)}


def test_fingerprints_of_odd_rows(spark):
    got = fingerprints.fingerprint_versions(odd_documents(spark, extra=True)).collect()
    assert len(got) == len(ODD_ROWS) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    one = fingerprints.fingerprint_versions(spark.createDataFrame([(5, "ab cd")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"ab ab").hexdigest() and one.near_next == 1.0
    assert fingerprints.fingerprint_versions(empty_documents(spark)).count() == 0


def test_half_kept_texts_score_above_unrelated_ones(spark):
    """Wherever the kept half holds a whole paragraph; few texts of chance words do not."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8)))
    rows = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate(k for k in range(10, 60) for _ in range(4))]
    got = {x.doc_id: x for x in fingerprints.fingerprint_versions(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    down, none = rows[::-1], 0
    for (i, text), (_, following) in zip(down, down[1:] + down[:1]):
        half = len(text) // 2
        holds = units_of(text) & units_of(text[: len(text) - half] + following[:half])
        assert got[i].near_edited > got[i].near_next if holds else got[i].near_edited == 0
        none += not holds
    assert len(got) == len(rows) and none <= len(rows) // 4


def test_a_word_in_front_moves_only_the_cuts_beside_it():
    words = [f"w{i * 7919 % 1009}" for i in range(300)]
    line = " ".join(words)
    one, two, three = (units_of(t) for t in (line, "extra " + line, "\n".join(["other one", line, "end"])))
    assert len(one & two) / len(one | two) > 0.9 and one < three
    assert len(units_of("no " * 30)) == 1 and units_of("") == set()
    assert len(words) / 14 < len(one) < len(words) / 5


def test_few_documents_share_no_paragraph_with_their_edited_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = fingerprints.fingerprint_versions(docs).collect()
    assert sum(r.near_edited == 0 for r in got) <= 0.02 * len(got)
    assert sum(r.near_edited > r.near_next for r in got) >= 0.97 * len(got)


def test_buckets_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 2)
    rows = near_copies(seed=6, groups=4, size=6, words=20)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wide = {r.doc_id: r for r in fingerprints.fingerprint_versions(docs).collect()}
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 10**6)
    assert wide == {r.doc_id: r for r in fingerprints.fingerprint_versions(docs).collect()}


# ---- classifiers -----------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.classify(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    assert len(judged) > 50 and sum(r.predicted == r.quality for r in judged) >= 0.95 * len(judged)
    assert all(0 <= r.score <= 1 for r in judged)


def test_discriminant_equals_the_formula():
    r = np.random.RandomState(1)
    x = [r.normal(size=(80, 16)) * (1 + k) + k for k in (0, 1)]
    totals = [(len(v), v.sum(axis=0), v.T @ v) for v in x]
    model = quality.Discriminant(totals)
    points = r.normal(size=(5, 16))
    logs = []
    for mean, factor, _ in model.classes:
        cov = (factor @ factor.T) * np.outer(model.scale, model.scale)
        gap = points - mean
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap) - 0.5 * np.linalg.slogdet(cov)[1])
    want = 1 / (1 + np.exp(logs[0] - logs[1]))
    assert model.scores(points) == pytest.approx(want, rel=1e-6)


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (5, 0), (6, None), (None, 1), (99, 0)], "doc_id long, quality int")
    got = quality.classify(odd_documents(spark, extra=True), labels).collect()
    assert len(got) == len(ODD_ROWS) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.classify(odd_documents(spark), labels.filter("false")).collect()} == {0.5}
    assert quality.classify(empty_documents(spark), labels).count() == 0


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs, PIECE).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 100 and sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)


def test_rows_without_or_with_one_id_are_drawn_one_by_one(spark):
    for id_of in (lambda i: None, lambda i: 7):
        rows = [(id_of(i), "".join(chr(97 + int(d)) for d in str(i)), "en") for i in range(1000, 1400)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        letters = sum(t for _, _, t in language.piece_counts(docs, PIECE, learned=100))
        every = sum(t for _, _, t in language.piece_counts(docs, PIECE, learned=400))
        assert 0.15 * every < letters < 0.35 * every


def test_forward_sums_all_segmentations():
    pieces = {p: i for i, p in enumerate(["▁", "a", "b", "ab", "▁a", "▁ab", "ba"])}
    chances = np.vstack([np.random.RandomState(0).rand(len(pieces) + 1, 2), np.zeros((1, 2))])

    def total(word):
        if not word:
            return np.ones(2)
        out = np.zeros(2)
        for n in range(1, len(word) + 1):
            k = pieces.get(word[:n], len(pieces) if n == 1 else None)
            if k is not None:
                out += chances[k] * total(word[n:])
        return out

    words = ["▁abab", "▁bazz"]
    assert language.forward(language.lattice(words, pieces), chances)[:, -1] == pytest.approx(np.array([total(w) for w in words]))
    w, piece, share = language.expected_counts(words, pieces)
    sizes = np.array([len(p) for p in pieces] + [1])
    assert [share[w == k] @ sizes[piece[w == k]] for k in (0, 1)] == pytest.approx([5, 5])


def test_pieces_of_every_length_are_used():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    names = map(model.id_to_piece, range(model.get_piece_size()))
    long = [p for p in names if len(p) > 12 and p == p.lower() and p.removeprefix("▁").isalpha()]
    pieces = language.vocabulary(PIECE)
    assert len(long) > 200 and pieces.keys() >= set(long)
    for piece in long:
        assert pieces[piece] in language.lattice([piece], pieces)[0, 0]


def test_language_of_odd_rows(spark):
    got = language.identify(odd_documents(spark, extra=True), PIECE).collect()
    assert len(got) == len(ODD_ROWS)
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (2, 3, 4)} == {("und", 0.0)}
    assert {r.lang_pred for r in language.identify(odd_documents(spark).withColumn("lang", F.lit(None).cast("string")), PIECE).collect()} == {"und"}
    assert language.identify(empty_documents(spark), PIECE).count() == 0


# ---- BPE -------------------------------------------------------------------------------------


def test_bpe_equals_the_library():
    tokenizer, encoder, decoder = library(WORD), bpe.Encoder(WORD, 200), bpe.IncrementalDecoder(WORD)
    r = random.Random(4)
    texts = fuzz(1500, 5) + ["".join(r.choice("aabehinorst") for _ in range(n)) for n in (50, 400, 3000)] + [LONG, "ab" * 4000]
    for text in texts:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        got = list(encoder.encode(text))
        assert got == want
        assert decoder.decode(got) == tokenizer.decode(want, skip_special_tokens=False)


def test_tokens_are_stable_behind_the_lookahead():
    encoder = bpe.Encoder(WORD)
    r = random.Random(9)
    for _ in range(60):
        symbols = [encoder.inner[ord(r.choice("aehinorstl"))] for _ in range(encoder.window + 40)]
        cut = len(symbols) - r.randint(1, 40)
        ends = lambda ids: np.cumsum([encoder.sizes[i] for i in ids])
        part, whole = encoder._merge(symbols[:cut]), encoder._merge(symbols)
        stable = int((ends(part) <= cut - encoder.lookahead).sum())
        assert part[:stable] == whole[:stable]


def test_byte_level_decoding_is_incremental():
    tokenizer, decoder = library(BYTE), bpe.IncrementalDecoder(BYTE)
    for text in ["héllo \U0001f600 日本\n x", "", "<|endoftext|> a"]:
        assert decoder.decode(tokenizer.encode(text).ids) == text
    ids = tokenizer.encode("\U00013000").ids
    assert decoder.decode(ids[:-1]) == tokenizer.decode(ids[:-1], skip_special_tokens=False) == "\ufffd"


def test_bpe_of_odd_rows(spark):
    encoded = bpe.encode_texts(odd_documents(spark, extra=True), WORD)
    got = bpe.decode_ids(encoded, WORD).collect()
    tokenizer = library(WORD)
    want = sorted(tokenizer.encode(t or "", add_special_tokens=False).ids for _, t, *_ in ODD_ROWS)
    assert sorted(r.ids for r in got) == want
    assert all(r.decoded == tokenizer.decode(r.ids, skip_special_tokens=False) for r in got)
    assert bpe.decode_ids(bpe.encode_texts(empty_documents(spark), WORD), WORD).count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bpe.decode_ids(nothing, WORD).first().decoded == ""


# ---- nearest neighbours ----------------------------------------------------------------------


def exact(vectors, k):
    ids = np.array(sorted(vectors))
    matrix = np.array([vectors[i] for i in ids], np.float64)
    out = {}
    for q in ids[ids % 20 == 0]:
        scores = (matrix * np.array(vectors[q], np.float64)).sum(axis=1)
        best = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:k]
        out[int(q)] = [(int(ids[i]), float(scores[i])) for i in best]
    return out


def test_nearest_recall_and_order(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 300)
    monkeypatch.setattr(ann, "QUERY_CHUNK", 40)
    r = np.random.RandomState(2)
    vectors = {i: (r.normal(size=24) * r.uniform(0.5, 2)).astype(np.float32).tolist() for i in range(2000)}
    for i in range(0, 700):  # copies of one vector
        vectors[i + 500] = vectors[500]
    rows = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for x in ann.nearest(rows, lambda i: i % 20 == 0, 20).orderBy("query_id", "rank").collect():
        assert x.rank == len(got[x.query_id]) + 1
        got[x.query_id].append((x.vec_id, x.score))
    want = exact(vectors, 20)
    assert got.keys() == want.keys()
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert found >= 0.95 * 20 * len(want)
    assert got[500] == want[500]


def test_nearest_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0]),
            (7, [2.0, 1.0]), (8, [2.0, 1.0]), (8, [2.0, 1.0]), (20, [-1.0, 0.5]), (None, [1.0, 1.0]), (40, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = [tuple(r) for r in ann.nearest(df, lambda i: i % 20 == 0, 20).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 7, 4.0), (0, 2, 8, 4.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 7, -1.5), (20, 3, 8, -1.5)]
    assert ann.nearest(df.filter("false"), lambda i: i % 20 == 0, 20).count() == 0


def test_rows_that_became_many_are_not_broadcast(spark, tmp_path):
    r = np.random.RandomState(6)
    rows = [(i, 90, str(i).encode(), r.randint(0, 9, 64).tolist(), bytes(128)) for i in range(50)]
    made = spark.createDataFrame(rows, "doc long, n_shingles long, digest binary, minima array<int>, short binary")
    made.write.parquet(str(tmp_path / "classes"))
    spark.createDataFrame([(1, 2), (2, 3)], "a long, b long").write.parquet(str(tmp_path / "edges"))
    classes, edges = spark.read.parquet(str(tmp_path / "classes")), spark.read.parquet(str(tmp_path / "edges"))
    for df in (minhash._posted(classes, 40), star._large_star(edges), star._small_star(edges)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
