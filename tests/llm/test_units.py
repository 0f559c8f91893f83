"""Spark-free parts of the training-data operators against brute force and the public libraries."""

import random

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from tidepanel.llm import (bpe_count, centroid_lang, hamming, simhash_tables, slack_packing,
                           term_topk, vp_dedup)
from tidepanel.llm.shared import Kept, code_points, gram_counts

PIECES = ["a", "B", "é", "É", "ß", "İ", "Σ", " ", "  ", "\n", "\t", "\x1c", "\x85", "　", "'s", "'ll",
          "12", "½", "!", "<|endoftext|>", "<|startoftext|>", "中文", "🙂", "é", "don't", "...",
          "\r\n", "​", "ΑΣ ", "<|", "\x00", "ﬁ"]


def strings(n, seed=3):
    rnd = random.Random(seed)
    out = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 12))) for _ in range(n)]
    return [*out, "", "word " * 5000, "x" * 5000]


def test_token_counts_are_the_librarys():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe_count.MergeCounter(path)
    for t in strings(2000):
        assert own.count(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t)


def test_ids_are_the_librarys():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), slack_packing.IdBytes(path)
    assert own.ranked is not None
    for t in strings(2000):
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own(t), "<u4").tolist() == want, repr(t)
        assert np.frombuffer(own.whole(t), "<u4").tolist() == want


def test_kept_forgets_but_answers():
    calls = []
    kept = Kept(lambda k: calls.append(k) or len(k), 4)
    words = ["a", "bb", "ccc", "a", "dddd", "a", "eeeee", "a"]
    assert kept.all(words) == [len(w) for w in words]
    assert calls.count("a") == 1 and len(kept.young) + len(kept.old) <= 4


def test_fullest_window_is_the_best_subset():
    rnd = random.Random(5)
    for _ in range(200):
        capacity = rnd.randint(5, 30)
        counts = {rnd.randint(1, capacity): rnd.randint(1, 3) for _ in range(rnd.randint(1, 5))}
        picked = slack_packing.fullest(counts, capacity)
        sums = {max(counts)}
        for length, n in counts.items():
            free = n - (length == max(counts))
            sums = {s + k * length for s in sums for k in range(free + 1)}
        assert all(n <= counts[k] for k, n in picked.items())
        assert sum(k * n for k, n in picked.items()) == max(s for s in sums if s <= capacity)


def test_plan_places_each_rank_once():
    histogram = {1: 7, 3: 5, 4: 9, 10: 4, 9: 3}
    taken = {k: [] for k in histogram}
    used = {}
    for length, first, copies, windows, sequence, offset in slack_packing.plan_windows(histogram, 10):
        for w in range(windows):
            for c in range(copies):
                taken[length].append(first + w * copies + c)
                used.setdefault(sequence + w, []).append((offset + c * length, length))
    assert {k: sorted(v) == list(range(histogram[k])) for k, v in taken.items()} == dict.fromkeys(histogram, True)
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 10
    assert slack_packing.plan_windows({}) == []


def test_fingerprint_from_the_definition():
    def slow(text):
        words = text.lower().split() if text.isascii() else text.encode().lower().decode().split()
        shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    for t in ["", "one", "One TWO three", "a b c d", "a b c d e", "x y " * 40, "É é a\tb\x0bc d e f"]:
        assert vp_dedup.fingerprint(t.encode()) == slow(t)
    assert vp_dedup.fingerprint(None) == 0


@pytest.mark.parametrize("words,radius", [(1, 4), (2, 6)])
def test_near_roots_are_the_components(words, radius):
    rng = np.random.default_rng(7)
    rows = rng.integers(0, 1 << 63, (60, words), dtype=np.uint64)
    for _ in range(300):
        row = rows[rng.integers(len(rows))].copy()
        for bit in rng.integers(0, 64 * words, rng.integers(1, 6)):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        rows = np.vstack([rows, row])
    rows = np.unique(rows, axis=0)
    roots = hamming.near_roots(rows, radius)
    near = np.array([hamming.distances(rows, r) <= radius for r in rows])
    label = np.arange(len(rows))
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    assert (roots == label).all() and len(set(label)) < len(rows)


def test_edit_hashes_equal_those_of_the_edited_text():
    rnd = random.Random(2)
    for n in [0, 1, 3, 5, 8, 40, 300]:
        text = " ".join("w" * rnd.randint(1, 5) + str(rnd.randint(0, 50)) for _ in range(n))
        other = "Other words of the next text " * rnd.randint(0, 30)
        changed = simhash_tables.edit(text, other)
        own = simhash_tables.term_hashes(text.encode().lower().split())
        want = simhash_tables.term_hashes(changed.encode().lower().split())
        got = simhash_tables.edited_hashes(own, text, changed)
        assert all((a == b).all() for a, b in zip(got, want))


def test_gram_counts_by_pieces_are_those_of_the_whole():
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abcd é") for _ in range(n)) for n in (0, 1, 2, 3, 50, 1000)]
    parts = [code_points(t) for t in texts]
    whole = gram_counts(parts, (1, 2, 3), 64)
    assert (whole == gram_counts(parts, (1, 2, 3), 64, piece=7)).all()
    assert whole.sum(axis=1).tolist() == [sum(max(0, len(t) - n + 1) for n in (1, 2, 3)) for t in texts]


def test_term_at_a_time_is_the_inner_product():
    rng = np.random.default_rng(1)
    q, c = rng.integers(-64, 64, (7, 9)), rng.integers(-64, 64, (30, 6))
    q[q % 3 == 0] = 0
    assert (term_topk.accumulate(q, c) == q[:, :6] @ c.T).all()
    big = np.full((2, 3), 1 << 30)
    assert (term_topk.accumulate(big, big) == big @ big.T).all()


def test_spherical_means_separate_clusters():
    rng = np.random.default_rng(0)
    axes = np.eye(8, dtype=np.float32)[:3]
    rows = np.repeat(axes, 20, axis=0) + rng.normal(0, 0.05, (60, 8)).astype(np.float32)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    centres = centroid_lang.spherical_means(rows, 3)
    assert sorted((axes @ centres.T).argmax(axis=1).tolist()) == [0, 1, 2]
    assert len(centroid_lang.spherical_means(rows[:2], 4)) == 2
