"""Ranked search, long repeats and tokenizer alignment against brute force, SQL and odd rows."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidepanel.llm import bag_search, queries, recompression, substring_dedup, token_alignment

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Names that the operators use themselves.
CLASH = {"id": 1, "n": 2, "m": 3, "bag": 4, "h": 5, "row": 6, "sha": 7, "at": 8, "no": 9, "body": 10, "rank": 11,
         "score": 12, "term": 13, "anchor": 14, "same": 15, "__text": 16}


def oracle(name, **tables):
    con = duckdb.connect()
    for table, df in tables.items():
        con.register(f"{table}_", df.toArrow())
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM {table}_")
    return con.execute(queries.SQL[name])


def rows_of(df, columns):
    return Counter(map(tuple, df.select(*columns).collect()))


def frame(spark, rows, **more):
    names = ["doc_id bigint", "text string", *[f"`{c}` int" for c in CLASH]]
    return spark.createDataFrame([(*r, *CLASH.values()) for r in rows], ", ".join(names))


# 11 ----------------------------------------------------------------------------------------

RANKED = ["item_id", "rank", "doc_id", "score"]


@pytest.fixture(scope="module")
def shelf(spark):
    rng = random.Random(4)
    words = ["tea", "Tea", "rice", "é́", "x1", "日本", "ß", "and", "of", "salt"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 30)))) for i in range(120)]
    rows += [(500 + i, "rice, tea; TEA & salt!") for i in range(25)]
    rows += [(None, "tea rice salt"), (3, "tea"), (3, "tea"), (700, None), (701, ""), (702, "...;"),
             (703, "tea-rice salt_x1\x7ftea"), (704, "of " * 20000 + "tea")]
    return frame(spark, rows).repartition(5)


def ask(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


def test_search_is_its_sql(spark, shelf):
    items = ask(spark, [(1, "Tea tea and rice"), (2, "salt"), (3, None), (4, "missing"), (5, "日本 ß x1 é́ of"),
                        (6, "and, of"), (6, "tea"), (7, "")])
    for docs in (shelf, spark.read.parquet(f"{SF}/documents.parquet")):
        got = bag_search.search(docs, items)
        assert rows_of(got, RANKED) == Counter(oracle("op11_bag_search", documents=docs, benchmark=items).fetchall())


def test_search_in_blocks_of_items_and_steps(spark, shelf, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = rows_of(bag_search.search(docs, items), RANKED)
    assert whole == Counter(oracle("op11_bag_search", documents=docs, benchmark=items).fetchall())
    for name, value in (("BLOCK_ITEMS", 16), ("STEP", 100), ("SCORE_ROWS", 7)):
        monkeypatch.setattr(bag_search, name, value)
    assert rows_of(bag_search.search(docs, items), RANKED) == whole


def test_search_of_nothing(spark, shelf):
    none = shelf.limit(0)
    for docs, items in ((none, ask(spark, [(1, "tea")])), (shelf, ask(spark, [])), (shelf.where("doc_id = 701"), ask(spark, [(1, "tea")]))):
        got = bag_search.search(docs, items)
        assert got.columns == RANKED and got.count() == 0


# 12 ----------------------------------------------------------------------------------------

REPORT = ["doc_id", "n_words", "n_removed", "kept_sha256"]


def without_repeats(rows):
    """Every window of every text, in plain Python."""
    last, least = float("inf"), {}
    texts = [[w for w in (t or "").encode().split()] for _, t in rows]
    for (key, _), words in zip(rows, texts):
        for p in range(len(words) - 49):
            window = tuple(words[p:p + 50])
            least[window] = min(least.get(window, last), last if key is None else key)
    out = Counter()
    for (key, _), words in zip(rows, texts):
        gone = set()
        for p in range(len(words) - 49):
            if least[tuple(words[p:p + 50])] < (last if key is None else key):
                gone.update(range(p, p + 50))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out[key, len(words), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.fixture(scope="module")
def repeats():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    base = [rng.choice(words) for _ in range(2000)]
    rows = []
    for i in range(100):
        at, size = rng.randrange(1900), rng.choice([30, 49, 50, 51, 60, 90])
        ends = [[rng.choice(words) for _ in range(rng.randrange(40))] for _ in range(2)]
        rows.append((rng.choice([i, i, i, i % 7, None]), " ".join(ends[0] + base[at:at + size] + ends[1])))
    # runs of one word and of short periods leave a window without an interior
    rows += [(500, "a " * 49), (501, "a " * 50), (502, "a " * 51), (503, "a " * 3000), (504, "b " + "a " * 60),
             (505, "a b " * 40), (506, "a b " * 41 + "c"), (507, "b a " * 400), (508, "x y z " * 30),
             (509, "y z x " * 17), (513, "a b " * 55), (513, "a b " * 55), (None, "a " * 70), (None, "a\t" * 70),
             (600, "the the the cat " * 30), (601, "q " + "the the the cat " * 20 + "z"), (602, "the the cat " * 60),
             (510, None), (511, ""), (512, "\t\n"), (None, None), (700, "lone " + " ".join(base[:300])),
             (701, " ".join(base[:300]) + " lone")]
    return rows


@pytest.mark.parametrize("piece", [1 << 17, 64])
def test_repeats_are_removed_as_by_brute_force(spark, repeats, monkeypatch, piece):
    monkeypatch.setattr(substring_dedup, "PIECE", piece)
    got = substring_dedup.remove_repeats(frame(spark, repeats).repartition(5))
    assert rows_of(got, REPORT) == without_repeats(repeats)


def test_repeats_with_every_key_hot_or_none(spark, repeats, monkeypatch):
    for hot in (1, 1 << 40):
        monkeypatch.setattr(substring_dedup, "HOT_KEYS", hot)
        assert rows_of(substring_dedup.remove_repeats(frame(spark, repeats)), REPORT) == without_repeats(repeats)


def test_repeats_are_their_sql(spark, repeats):
    for docs in (frame(spark, repeats), spark.read.parquet(f"{SF}/documents.parquet")):
        assert rows_of(substring_dedup.remove_repeats(docs), REPORT) == Counter(
            oracle("op12_recompression", documents=docs).fetchall())
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    window = rng.integers(0, 6, 50).astype(np.uint64)
    found = set()
    for _ in range(200):
        before, after = (rng.integers(0, 6, rng.integers(0, 60)).astype(np.uint64) for _ in range(2))
        tokens = np.concatenate((before, window, after))
        first = recompression.windows(np.zeros(len(tokens), np.int64))
        at = recompression.anchors(*recompression.recompress(tokens, np.zeros(len(tokens), np.int64), first))
        found.add((at[len(before)], recompression.window_names(tokens)[len(before)]))
    assert len(found) == 1


# 13 ----------------------------------------------------------------------------------------

def overlaps(rows):
    """Groups and links by walking both token lists."""
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {
        chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    out, count = [], Counter()
    for key, text in rows:
        none = (key, 0, 0, 0, [], "")
        if not text:
            out.append(none)
            continue
        a, b = library.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
        left = [bytes(byte_of[c] for c in library.id_to_token(i)) for i in a]
        right = [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()
                 for i in b for p in [pieces.id_to_piece(i)]]
        if not b"".join(left) == b"".join(right) == b" " + text.encode():
            out.append(none)
            continue
        links, groups, i, j = [], [([a[0]], [b[0]])], 0, 0
        end_a, end_b = len(left[0]), len(right[0])
        while True:
            links.append((a[i], b[j]))
            step_a, step_b = end_a <= end_b, end_b <= end_a
            if step_a and step_b:
                if i + 1 == len(a):
                    break
                groups.append(([], []))
            if step_a:
                i += 1
                end_a += len(left[i])
                groups[-1][0].append(a[i])
            if step_b:
                j += 1
                end_b += len(right[j])
                groups[-1][1].append(b[j])
        count.update(links)
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((key, len(a), len(b), len(groups), links, hashlib.sha256(said.encode()).hexdigest()))
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return Counter((k, a, b, g, len(x), sum(count[p] == most[p[1]] for p in x), sum(count[p] for p in x), s)
                   for k, a, b, g, x, s in out)


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_is_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rows += [(9001, None), (9002, ""), (9003, " "), (9004, "<|endoftext|> <s> </s> <0x41> ▁x"), (None, "null id"),
             (9005, "a  b\t\tc\n\n\n"), (9006, "é́ 日本語 🎉🎉 ​ x﻿"), (9006, "é́ 日本語 🎉🎉"),
             (9006, "é́ 日本語 🎉🎉"), (9007, "word " * 20000), (9008, " " * 300), (9010, "\x00\x01ab"), (9011, "ﬁne ① ½")]
    want = overlaps(rows)
    docs = frame(spark, rows).repartition(4)
    for hot in (token_alignment.HOT_PAIRS, 1, 50):
        got = token_alignment.alignment_report(docs, A, B, hot_pairs=hot)
        assert rows_of(got, ALIGNED) == want
    assert token_alignment.alignment_report(docs.limit(0), A, B).count() == 0
