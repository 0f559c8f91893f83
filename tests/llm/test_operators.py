"""Training-data operators on small fixtures: brute force, round trips, odd rows, empty tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidepanel.llm import (bpe_count, centroid_lang, chat_parts, co_training, hamming, queries,
                           shingle_links, simhash_tables, slack_packing, source_mixing, term_topk, vp_dedup, warc)
from tidepanel.llm.graph import components
from tidepanel.llm.shared import DOCUMENT_COLUMNS, unit_hash
from tidepanel.session import scratch_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, label string, fp int, size int"
WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")

LONG = "the quick brown fox jumps over the lazy dog again and " * 3000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, copies, near copies, repeated rows, columns with clashing names."""
    body = "some words that make a text of fair length for shingles to bite on number "
    near = [body + " ".join(f"w{i}" for i in range(300)) + (f" tail{k}" if k else "") for k in range(6)]
    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (3, "...", "en", "b", 3),
            (4, LONG, "en", "a", len(LONG)), (5, "hallo welt", "de", "b", 10), (5, "hallo welt", "de", "b", 10),
            (None, "no id here at all", "en", None, 17), (None, None, None, None, None)]
    rows += [(10 + k, t, "en", "a" if k % 2 else "c", len(t)) for k, t in enumerate(near)]
    rows += [(20, LONG, "en", "c", len(LONG)), (-3, "<|endoftext|> x", "fr", "c", 15)]
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def oracle(name, tables):
    con = duckdb.connect()
    for table, df in tables.items():
        con.register(f"{table}_", df.toArrow())
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM {table}_")
    return con.execute(queries.SQL[name]).df()


def same(got, want):
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)

    def plain(df):
        return Counter(tuple(None if pd.isna(v) else v if isinstance(v, str) else round(float(v), 6) for v in r)
                       for r in df[columns].astype(object).itertuples(index=False))
    assert plain(got) == plain(want)


def within(part, whole):
    """Whether the rows of one frame are among those of another, each as often at most."""
    return not Counter(map(tuple, part.collect())) - Counter(map(tuple, whole.collect()))


# 1 -----------------------------------------------------------------------------------------

def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where("doc_id % 3 != 0")
    got = co_training.score(docs, co_training.fit(docs, train)).join(
        labels.where("doc_id % 3 = 0").select("doc_id", F.col("quality").alias("truth")), "doc_id").toPandas()
    assert (got.kept == (got.truth == 1)).mean() > 0.93
    assert got.kept[got.truth == 1].mean() > 0.95


def test_quality_odd_rows_and_missing_labels(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = co_training.quality_report(odd, none)
    assert got.count() == odd.count() and got.where("kept").count() == odd.count()
    kept = co_training.good_documents(odd, none)
    assert kept.columns == odd.columns and within(kept, odd)
    one_class = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (4, None, 0), (None, 0, 0)], none.schema)
    assert co_training.fit(odd, one_class) is None
    assert co_training.quality_report(empty, none).count() == 0
    small_docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = co_training.fit(small_docs, labels)
    assert co_training.score(odd, model).count() == odd.count()


def test_views_are_refitted_by_plain_numpy(spark):
    """Without rounds the model is naive Bayes, a ridge logistic regression and two calibrations of the labels."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = co_training.fit(docs, labels, rounds=0)
    truth = labels.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    rows = docs.join(truth, "doc_id").select(
        "doc_id", "text", "lang", "source", "y", unit_hash(F.col("doc_id"), salt="calibration").alias("u")).collect()
    held = set()
    for c in (0, 1):
        mine = sorted((r for r in rows if r.y == c), key=lambda r: (r.u, r.doc_id))
        held |= {r.doc_id for r in mine[:max(1, int(co_training.CALIBRATION * len(mine)))]}
    shares = np.stack([np.float16(co_training.content_rows([r.text or ""])[0]).astype(float) for r in rows])
    y, told = np.array([r.y for r in rows]), np.array([r.doc_id not in held for r in rows])
    sums = [shares[told & (y == c)].sum(axis=0) + 1e-3 for c in (0, 1)]
    ratios = np.log(sums[1] / sums[1].sum()) - np.log(sums[0] / sums[0].sum())
    np.testing.assert_allclose(model.content, ratios, atol=1e-5)
    bins = np.array([co_training.metadata_bins(r.text or "", r.lang, r.source) for r in rows])
    one_hot = (bins[:, :, None] == np.arange(co_training.OFFSETS[-1])).any(axis=1).astype(float)
    # at the minimum of the penalised loss its gradient is zero
    x, beta = one_hot[told], model.metadata
    gradient = x.T @ (1 / (1 + np.exp(-x @ beta)) - y[told]) + co_training.RIDGE * beta
    assert np.abs(gradient).max() < 1e-6
    share = y[~told].mean()
    assert model.prior == pytest.approx(np.log(share / (1 - share)))
    odds = np.stack([co_training.EVIDENCE * shares @ ratios, one_hot @ beta]).T * model.scale[:, 0] + model.scale[:, 1]
    p = 1 / (1 + np.exp(-(odds.sum(axis=1) - model.prior)))
    got = {r.doc_id: r.quality for r in co_training.score(docs, model).collect()}
    np.testing.assert_allclose([got[r.doc_id] for r in rows], p, atol=1e-2)


def test_a_rare_class_is_drawn_and_ids_may_be_texts(spark):
    docs = spark.createDataFrame(
        [(f"d{i}", ("good words here " if i % 100 else "bad bad 123 !!! ") * (3 + i % 5), "en", f"s{i % 3}") for i in range(400)],
        "doc_id string, text string, lang string, source string")
    labels = docs.select("doc_id", (~F.col("text").startswith("bad")).cast("int").alias("quality"))
    model = co_training.fit(docs, labels, labelled=20, pool=50)
    got = co_training.score(docs, model).join(labels.withColumnRenamed("quality", "truth"), "doc_id")
    assert got.where("kept <> (truth = 1)").count() == 0
    one = labels.where("quality = 1 OR doc_id = 'd0'")
    assert co_training.fit(docs, one) is None


# 2 -----------------------------------------------------------------------------------------

def test_mix_is_its_sql(odd, small):
    for docs in (small, odd):
        same(source_mixing.mix(docs).toPandas(), oracle("op2_mixing", {"documents": docs}))


def test_mix_meets_its_targets(small):
    got = source_mixing.mix(small).toPandas().merge(small.select("doc_id", "source").toPandas(), on="doc_id")
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert (abs(by.taken - by.target) <= 1).all() and (by.target <= 3 * by["size"] + 1e-6).all()
    assert (got.taken <= 3 * got["size"]).all()
    assert abs(by.target.sum() - by["size"].sum()) < 1e-3


def test_targets_are_the_repeated_sharing(spark):
    sizes = [("a", 10), ("b", 500), ("c", 0), ("d", 7), ("e", 90), (None, 40)]
    got = {r.source: r.target for r in source_mixing.targets(
        spark.createDataFrame(sizes, "source string, source_size bigint")).collect()}
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, (s, _) in enumerate(sizes)}
    left, open_, want = float(sum(n for _, n in sizes)), dict(sizes), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * open_[s]]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 3.0 * open_.pop(s)
            left -= want[s]
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mixed_documents_are_copies(odd, empty):
    got = source_mixing.mixed_documents(odd)
    assert got.columns == odd.columns
    assert within(got.distinct(), odd)
    assert got.groupBy(*odd.columns).count().agg(F.max("count")).first()[0] <= 6  # a row twice there, each 3 times
    assert source_mixing.mix(empty).count() == 0 and source_mixing.mixed_documents(empty).count() == 0


# 3 -----------------------------------------------------------------------------------------

def slow_components(rows):
    prints = [vp_dedup.fingerprint(t.encode() if t else b"") for _, t in rows]
    groups = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= 4 and groups[i] != groups[j]:
                    groups[i] = groups[j] = min(groups[i], groups[j])
                    changed = True
    ids = defaultdict(list)
    for g, (i, _) in zip(groups, rows):
        if i is not None:
            ids[g].append(i)
    return Counter((i, f"{p:016x}", min(ids[g], default=None)) for (i, _), p, g in zip(rows, prints, groups))


def test_near_components(odd, empty, small):
    for docs in (odd, small.limit(150)):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        got = vp_dedup.near_components(docs)
        assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()) == slow_components(rows)
    assert vp_dedup.near_components(empty).count() == 0


def test_large_shards_are_split_without_loss(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-1 << 62, 1 << 62, 40)
    values = {int(b) for b in base}
    for b in base:
        for _ in range(20):
            v = int(b)
            for bit in rng.integers(0, 63, 2):
                v ^= 1 << int(bit)
            values.add(v)
    frame = spark.createDataFrame([(v,) for v in values], "fp bigint")
    found = [sorted(map(tuple, components(vp_dedup.near_links(frame, shard_rows=n)).collect())) for n in (4096, 3)]
    assert found[0] == found[1] and len(found[0]) > 500


def alike_keepers(rows):
    """doc_ids that stay of (doc_id, text) rows: the smallest of each set of texts linked at 0.8."""
    sets = []
    for _, text in rows:
        words = ["".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    least = {}
    for (key, _), at in zip(rows, label):
        least[at] = min(least.get(at, float("inf")), float("inf") if key is None else key)
    return sorted(least.values())


def test_one_document_of_each_component_stays(odd, empty):
    got = vp_dedup.one_per_component(odd)
    assert got.columns == odd.columns
    assert sorted(float("inf") if r.doc_id is None else r.doc_id for r in got.collect()) == alike_keepers(
        [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    assert within(got, odd)
    ids = [r.doc_id for r in got.collect()]
    assert 4 in ids and 20 not in ids and ids.count(5) == 1
    assert vp_dedup.one_per_component(empty).count() == 0


def test_like_texts_are_one_component(spark):
    """The stage links five-word shingle sets from 0.8 on, and no others."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for f in range(12):
        base = list(rng.choice(words, 400))
        for k, changed in enumerate((0, 3, 6, 8, 25, 25, 60)):
            text = list(base)
            for at in rng.choice(400, changed, replace=False):
                text[at] = f"new{f}-{k}-{at}"
            rows.append((100 * f + k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = alike_keepers(rows)
    assert 12 < len(want) < len(rows)
    assert sorted(r.doc_id for r in vp_dedup.one_per_component(docs).collect()) == want


@pytest.mark.parametrize("most", [10_000, 64])
def test_a_family_that_only_its_first_text_ties_together(spark, most):
    """Texts alike to one by 0.8 and to each other by less, in one group and in parts of bands."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(4000)]
    base, rows = list(rng.choice(words, 400)), []
    for k in range(200):
        text = list(base)
        for at in rng.choice(400, 8, replace=False):
            text[at] = f"new{k}-{at}"
        rows.append((k + 1, " ".join(text)))
    rows.append((0, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("__row", F.xxhash64("doc_id"))
    marked = shingle_links.with_sets(docs, "text", ["doc_id", "__row"]).cache()
    labels = shingle_links.set_components(
        marked, docs.select("__row", F.col("text").cast("binary").alias("__body")), group_rows=most)
    assert labels.count() == len(rows) and labels.select("label").distinct().count() == 1
    if most > len(rows):
        group = marked.selectExpr("node", "n", "sketch", "node AS comp", "true AS asks").toArrow()
        own = [shingle_links.shingles(r.text.encode()).tobytes() for r in docs.collect()]
        found = shingle_links.star_links(group.append_column("own", pa.array(own, pa.binary())))
        assert found.num_rows == len(rows) - 1


def test_candidates_are_near_simhashes_in_one_leaf_of_a_tree(spark):
    """The stage searches SimHashes with vantage-point trees; large leaves are cut without loss."""
    rng = np.random.default_rng(8)
    rows = []
    for f in range(40):
        base = list(rng.choice([f"w{i}" for i in range(3000)], 120))
        for k in range(5):
            text = list(base)
            for at in rng.choice(120, 2 * k, replace=False):
                text[at] = f"new{f}-{k}-{at}"
            rows.append((5 * f + k, " ".join(text)))
    docs = spark.createDataFrame([*rows, (900, "one two three four five six seven"), (901, None)],
                                 "doc_id bigint, text string")
    marked = shingle_links.with_sets(docs, "text", ["doc_id"]).cache()
    got = sorted(marked.collect(), key=lambda r: r.doc_id)
    sets = [shingle_links.shingles((r.text or "").encode()) for r in docs.orderBy("doc_id").collect()]
    prints = np.array([r.sketch for r in got], np.int64).view(np.uint64)
    # every shingle has one vote a bit, and over half of them set it
    each = [np.unpackbits(np.array([shingle_links.simhash(own[k:k + 1]) for k in range(len(own))]).view(np.uint8), axis=1)
            if len(own) else np.zeros((1, 512), np.uint8) for own in sets]
    assert (prints == np.array([np.packbits(2 * e.sum(axis=0) > len(e)).view(np.uint64) for e in each])).all()
    bits = np.unpackbits(prints.view(np.uint8), axis=1)[:, :506].reshape(-1, 46, 11)
    points = [[v >> i & 1 for i in range(11)] for v in hamming.VANTAGES]
    away = np.stack([(bits != np.array(v, np.uint8)).sum(axis=2) for v in points], axis=2)
    label = list(range(len(got)))
    for i in range(len(got) - 1):
        assert len(got[i].leaves) == 46
        for j in range(i):
            shared = (away[i] == away[j]).all(axis=1)
            assert (shared == (np.array(got[i].leaves) == np.array(got[j].leaves))).all()
            small, big = sorted((len(sets[i]), len(sets[j])))
            if shared.any() and np.bitwise_count(prints[i] ^ prints[j]).sum() <= 120 and 5 * small >= 4 * big:
                label = [label[j] if x == label[i] else x for x in label]
    assert got[-1].leaves == [] and len(set(label)) < len(label)
    want = {frozenset(got[i].node for i in range(len(got)) if label[i] == x) for x in label}
    for most in (4096, 3):
        found = defaultdict(set)
        for r in components(shingle_links.candidate_links(marked.drop("doc_id"), leaf_rows=most)).collect():
            found[r.label].add(r.node)
        assert {frozenset(x) for x in found.values()} == {x for x in want if len(x) > 1}


def test_stages_keep_columns_of_any_name(spark, odd):
    """Columns with names that the stages use come back as they were."""
    names = ["target", "epochs", "cut", "end_slice", "source_size", "copies", "__size", "score", "rejected", "__text",
             "quality", "kept", "__row", "__body", "node", "label", "held_out", "__doc", "f0", "doc_id"]
    docs = odd.select(*DOCUMENT_COLUMNS, *[F.concat(F.lit(f"{n} "), F.coalesce("text", F.lit(""))).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        assert within(got.distinct(), docs), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.drop("doc_id").withColumn("doc_id", F.lit(1)), SF).count() > 0


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


# 4 -----------------------------------------------------------------------------------------

def pages(spark):
    big = "<p>é</p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n" * 40
    rows = [(1, "http://a/1", big), (2, None, big), (9, "http://a/\r\nX: y", big), (3, "http://b", "short"),
            (4, "http://c", "short"), (5, None, None), (6, "http://d", ""), (None, "http://e", big),
            (-8, "http://f", "é" * 500), (7, "http://g", "é" * 500), (7, "http://g", "é" * 500)]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, record_type string")


def test_warc_round_trip(spark):
    table = pages(spark)
    same(warc.round_trip(table).toPandas(), oracle("op4_warc", {"pages": table}))
    assert warc.round_trip(table.limit(0)).count() == 0


def test_warc_payloads_and_pushed_filters(spark):
    path = scratch_path(spark, "warc-test")
    warc.write_warc(pages(spark), path)
    got = warc.read_warc(spark, path, "full").where("record_type = 'response'")
    assert Counter(hashlib.sha1(r.payload).hexdigest() == r.payload_digest[5:] for r in got.collect()) == {True: 7}
    reader = warc.WarcReader(path, "full")
    from pyspark.sql.datasource import EqualTo, GreaterThan
    back = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("content_length",), 5)]))
    assert [type(f).__name__ for f in back] == ["GreaterThan"]
    rows = [b.num_rows for p in reader.partitions() for b in reader.read(p)]
    assert sum(rows) == 4
    assert warc.read_warc(spark, path).where(F.col("target_uri").startswith("http://a")).count() == 2


# 5 and 6 -----------------------------------------------------------------------------------

def test_token_counts(odd, empty):
    library = Tokenizer.from_file(WORD)
    want = Counter((r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "").ids), n > 2048)
                   for r in odd.collect())
    got = bpe_count.token_counts(odd, WORD)
    assert Counter(map(tuple, got.collect())) == want
    assert bpe_count.token_counts(empty, WORD).count() == 0


def test_packing(odd, empty, small):
    library = Tokenizer.from_file(BYTE)
    for docs in (odd, small):
        pieces = slack_packing.pack(docs, BYTE).toPandas()
        ids = defaultdict(list)
        for r in docs.collect():
            ids[r.doc_id].append(np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4"))
        want = Counter()
        for key, texts in ids.items():
            for t in texts:
                want.update((key, s, min(1024, len(t) - s), zlib.crc32(t[s:s + 1024].tobytes()), len(t))
                            for s in range(0, len(t), 1024))
        got = Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens)
                      for r in pieces.itertuples())
        assert got == want
        pieces = pieces.sort_values(["sequence_id", "offset"])
        before = pieces.groupby("sequence_id").length.cumsum() - pieces.length
        assert (pieces.offset == before).all()
        sums = pieces.groupby("sequence_id").length.sum()
        assert sums.max() <= 1024 and len(sums) <= -(-pieces.length.sum() // 1024) + 2
    assert slack_packing.pack(empty, BYTE).count() == 0


# 7 -----------------------------------------------------------------------------------------

def turns(spark):
    rows = [(1, 0, "user", "a < b \\ c </turn>\n<turn>assistant<text>x"), (1, 1, "assistant", "\\l \\\\l <l"),
            (1, 1, "assistant", "tie"), (1, 1, "assistant", "tie"), (2, None, None, None), (2, 3, "assistant", ""),
            (None, 0, "user<text>", "🙂é"), (3, 0, "assistant", "long " * 20000)]
    return spark.createDataFrame([(*r, "x") for r in rows],
                                 "conv_id bigint, turn bigint, role string, text string, formatted string")


def test_chat_digests(spark):
    table = turns(spark)
    extra = pd.DataFrame({"conv_id": [-7, -7], "turn": [0, 1], "role": ["user", "assistant"],
                          "text": [queries.EXTRA_TEXT] * 2})
    whole = table.select("conv_id", "turn", "role", "text").unionByName(spark.createDataFrame(extra))
    chats = chat_parts.format_chat(whole.withColumn("parts", chat_parts.text_parts(F.col("text"))))
    same(chat_parts.chat_digest(chats).toPandas(), oracle("op7_chat_parts", {"conversations": table}))
    assert chat_parts.format_chat(whole.limit(0).withColumn(
        "parts", chat_parts.text_parts(F.col("text")))).count() == 0


def test_typed_parts(spark):
    part = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    rows = [(1, 0, "user", [("text", "see <image:0>", None, None, None, None, None),
                            ("image", None, "i.png", 57, 28, None, None), ("audio", None, "a.wav", None, None, 1.5, None)]),
            (1, 1, "assistant", [("document", None, "d.pdf", None, None, None, 3), ("odd", "told", None, None, None, None, None)]),
            (1, 2, "user", None), (1, 3, "assistant", [])]
    got = chat_parts.format_chat(spark.createDataFrame(
        rows, f"conv_id bigint, turn bigint, role string, parts array<{part}>")).first()
    assert got.formatted == ("<turn>user<text>see \\limage:0><image:0><audio:1></turn>\n"
                             "<turn>assistant<text><document:2>told</turn>\n<turn>user<text></turn>\n"
                             "<turn>assistant<text></turn>\n")
    assert [tuple(a) for a in got.attachments] == [(0, 0, "image", "i.png", 3), (1, 0, "audio", "a.wav", 38),
                                                   (2, 1, "document", "d.pdf", 768)]
    assert got.attachment_tokens == 809
    assert [got.formatted[s.start:s.start + s.length] for s in got.loss_spans] == ["<document:2>told", ""]


# 8 -----------------------------------------------------------------------------------------

def test_top_k(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [((i * 7 + d * 3) % 19 - 9) / 16 for d in range(6)]) for i in range(120)]
    rows += [(200, None), (220, [1.0, nan, 0.0, 0.0, 0.0, 0.0]), (240, [1.0, inf, 0.0, 0.0, 0.0, 0.0]),
             (260, [None] * 6), (None, [1.0] * 6), (280, [0.0] * 6)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, score int")
    got = term_topk.top_k(table, F.col("vec_id") % 20 == 0)
    same(got.toPandas(), oracle("op8_term_topk", {"embeddings": table}))
    assert term_topk.top_k(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = term_topk.top_k(table.where("vec_id < 3"), F.col("vec_id") % 20 == 0)
    assert few.count() == 2
    ragged = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0]), (2, []), (1, [3.0])], "vec_id bigint, embedding array<float>")
    found = term_topk.top_k(ragged, F.col("vec_id") == 0).collect()
    assert [(r.rank, r.vec_id, r.score) for r in found] == [(1, 1, 12288), (2, 1, 4096), (3, 2, 0)]


def test_top_k_of_repeated_ids_and_sparse_vectors(spark):
    """Rows of one id, also of a query's, are rows each; terms that few candidates have are scattered."""
    rows = [(i % 90, [float((i * 5 + d) % 7 - 3) if (i + d) % 9 == 0 else 0.0 for d in range(12)]) for i in range(150)]
    rows += [(20, [1.0] * 12), (20, [1.0] * 12), (41, [2.0] * 12), (41, [2.0] * 12)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    same(term_topk.top_k(table, F.col("vec_id") % 20 == 0).toPandas(), oracle("op8_term_topk", {"embeddings": table}))


# 9 -----------------------------------------------------------------------------------------

def test_edited_fingerprints(odd, empty, small):
    for docs in (odd.where("doc_id IS NOT NULL"), small):
        rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (-r[0], r[1].encode()))
        want = Counter()
        for k, (i, t) in enumerate(rows):
            following = rows[(k + 1) % len(rows)][1]
            n = len(t) // 3
            changed = t[:len(t) - n] + following[:n]
            marks = [simhash_tables.vote(simhash_tables.term_hashes(x.encode().lower().split()))
                     for x in (t, changed, following)]
            want[(i, len(t), hashlib.sha256(changed.encode()).hexdigest(), marks[0].hex(), marks[1].hex(),
                  round(simhash_tables.likeness(*marks[:2]), 9), round(simhash_tables.likeness(marks[0], marks[2]), 9))] += 1
        got = Counter((*r[:5], round(r[5], 9), round(r[6], 9))
                      for r in simhash_tables.edited_fingerprints(docs).collect())
        assert got == want
    assert simhash_tables.edited_fingerprints(odd).count() == odd.count()
    assert simhash_tables.fingerprint_report(empty).count() == 0
    assert simhash_tables.edited_fingerprints(odd.where("doc_id = 4")).count() == 1


def test_near_classes_are_the_links(small):
    got = simhash_tables.fingerprint_report(small).toPandas()
    prints = [int(f, 16) for f in got.fingerprint]
    label = list(got.doc_id)
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if label[j] < label[i] and (a ^ b).bit_count() <= simhash_tables.RADIUS:
                    label[i], changed = label[j], True
    assert label == list(got.near_class)


# 10 ----------------------------------------------------------------------------------------

def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = centroid_lang.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    out = got[got.held_out]
    assert (out.lang_pred == out.lang).mean() > 0.97 and got.score.between(0, 1).all()
    assert got.rejected.mean() < 0.01
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()


def test_languages_odd_rows(odd, empty):
    got = centroid_lang.language_report(odd).toPandas()
    assert len(got) == odd.count()
    no_letters = got[got.doc_id.isin([1, 2, 3])]
    assert (no_letters.lang_pred == "und").all() and no_letters.rejected.all() and (no_letters.score == 0).all()
    kept = centroid_lang.recognised_documents(odd)
    assert kept.columns == odd.columns and within(kept, odd)
    assert centroid_lang.language_report(empty).count() == 0
    assert (centroid_lang.language_report(odd.withColumn("lang", F.lit(None).cast("string"))).toPandas()
            .lang_pred == "und").all()


# pipeline ----------------------------------------------------------------------------------

def test_pipeline_stages_one_after_the_other(spark, small):
    docs = small
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF)
        path = scratch_path(spark, name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == small.columns
        assert within(docs.distinct(), small)
        if name == "near_duplicates":
            rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
            assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == alike_keepers(rows)
        if name == "quality":
            kept = {r.doc_id for r in docs.select("doc_id").collect()}
            good = labels[labels.quality == 1].doc_id
            assert good.isin(kept).mean() > 0.95
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "mixing", "packing"]


def test_pipeline_takes_odd_rows(spark, odd, empty):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.count() >= 0
