"""Operators over whole tables against plain versions."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

shared = pytest.importorskip("helixloom.llm.shared")
from helixloom.llm import decontaminate, embedding_dedup, line_dedup, lm_score, quality, shard_tree, simhash_dedup  # noqa: E402

DOCS = "doc_id long, text string"


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 160)]
    forest = shared.Forest()
    for a, b in edges:
        forest.union(a, b)
    got = {x.node: x.root for x in shared.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {x: forest.find(x) for e in edges if e[0] != e[1] for x in e}
    assert shared.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_lines(docs, least):
    split = lambda t: [] if t is None else t.split("\n")
    seqs = [[(k, x) for k, x in enumerate(split(t)) if x.strip()] for _, t in docs]
    order = sorted(range(len(docs)), key=lambda r: (docs[r][0] is not None, docs[r][0] or 0, r))
    places, gone = [(o, a) for o in order for a in range(len(seqs[o]))], {r: set() for r in range(len(docs))}
    for x, (o, a) in enumerate(places):
        mine, best = seqs[o], 0
        for p, b in places[:x]:
            n = 0
            while a + n < len(mine) and b + n < len(seqs[p]) and mine[a + n][1] == seqs[p][b + n][1]:
                n += 1
            best = max(best, n)
        if best and sum(len(mine[a + j][1].split()) for j in range(best)) >= least:
            for j in range(a, a + best):
                gone[o].update(range(mine[j][0], mine[j + 1][0] if j + 1 < len(mine) else len(split(docs[o][1]))))
    return [(i, None if t is None else "\n".join(x for k, x in enumerate(split(t)) if k not in gone[r]), len(gone[r])) for r, (i, t) in enumerate(docs)]


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup(spark, seed):
    r = random.Random(seed)
    pool = ["a b", "c", "d e f", "g", " ", "", "h i"]
    base, docs = [r.choice(pool) for _ in range(14)], []
    for i in range(14):
        x = [r.choice(pool) for _ in range(r.randint(0, 9))]
        if r.random() < 0.6:
            x[0:0] = base[r.randint(0, 5) : r.randint(6, 14)]
        docs.append((r.choice([i, i, 3, None]), "\n".join(x) if r.random() < 0.9 else None))
    df = spark.createDataFrame(docs, DOCS).coalesce(1)
    got = [(x.doc_id, x.text, x.n_deleted) for x in line_dedup.dedup_lines(df, min_words=5).collect()]
    assert sorted(got, key=str) == sorted(plain_lines(docs, 5), key=str)


def test_line_dedup_edges(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0
    passage = " ".join(f"w{k}" for k in range(55))
    df = spark.createDataFrame([(1, f"x\n{passage}", "p"), (2, f"{passage}\ny", "q"), (2, f"{passage}\ny", "q")], DOCS + ", _row string")
    got = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(df).collect())
    assert got == [(1, f"x\n{passage}"), (2, ""), (2, "y")]


def test_suffix_array_keeps_classes_together(spark):
    df = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "b\nc\nd\na\nb"), (3, "a\nb\nc")], DOCS).coalesce(1)
    rows = shared.with_row_id(df, "_row")
    levels = line_dedup.doubling(line_dedup.line_table(rows, "_row", "doc_id", "text"))
    ranks = [r.rank_1 for r in line_dedup.suffix_array(levels).collect() if r.rank_1 is not None]
    assert len({k for k, (a, b) in enumerate(zip(ranks, ranks[1:])) if a != b}) == len(set(ranks)) - 1


def plain_components(values, near):
    root = list(range(len(values)))
    for _ in values:
        for i in range(len(values)):
            root[i] = min(root[j] for j in range(len(values)) if near(values[i], values[j]))
    return root


def test_simhash(spark):
    r = random.Random(2)
    base = [" ".join(r.choice("abcdefghij") for _ in range(60)) for _ in range(4)]
    docs = [(k, r.choice(base).replace("a", "A") + r.choice(["", " x", " y z"])) for k in range(40)] + [(50, None), (51, ""), (52, " \n"), (53, "One two")]
    got = sorted((x.doc_id, x.fingerprint, x.component_id) for x in simhash_dedup.simhash_components(spark.createDataFrame(docs, DOCS)).collect())
    fps = [int(f, 16) for _, f, _ in got]
    root = plain_components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    assert [c for _, _, c in got] == [got[k][0] for k in root]
    assert got[-4][1] == got[-3][1] == got[-2][1] == "0" * 16


def test_simhash_blocks_change_nothing(spark):
    r = random.Random(5)
    fps = sorted({(0x0123456789ABCDEF ^ (1 << r.randint(0, 62)) ^ (1 << r.randint(0, 62))) for _ in range(60)} | {r.getrandbits(63) for _ in range(40)})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    root = plain_components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    want = {fps[k]: fps[root[k]] for k in range(len(fps)) if root.count(root[k]) > 1}
    for block in (20_000, 7):
        assert {x.node: x.root for x in shared.connected_components(simhash_dedup.near_links(df, 4, block)).collect()} == want


def test_simhash_keeps_one(spark):
    text = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(7, text), (3, text), (3, text), (None, text), (9, "other words here now and then")], DOCS)
    assert sorted(r.doc_id for r in simhash_dedup.keep_one(df).collect()) == [3, 9]
    assert simhash_dedup.keep_one(df.limit(0)).count() == 0


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(shard_tree, "ROWS", 40)
    docs = [(k, "x" * (k % 50)) for k in range(400)] + [(5, "same")] * 3 + [(None, None)] * 4
    rows = shard_tree.shard_documents(spark.createDataFrame(docs, DOCS), shard_tree.tree(8)).collect()
    assert len(rows) == len(docs)
    for s in range(8):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) > 20
    assert all(r.grown_shard in (r.shard, 8) for r in rows) and any(r.grown_shard == 8 for r in rows)
    assert all(r.size == len(t or "") + 1 and r.text_crc32 == zlib.crc32((t or "").encode()) for r in rows for i, t in docs if i == r.doc_id and i not in (5, None))
    assert shard_tree.shard_documents(spark.createDataFrame([], DOCS), shard_tree.tree(8)).count() == 0


def test_shard_weights_move_rows_only_to_the_heavier_subtree(spark):
    from dataclasses import replace

    ids = spark.range(3000)
    leaves = shard_tree.tree(8)
    heavy = [replace(x, weight=3.0) if x.shard == 0 else x for x in leaves]
    at = ids.select(shard_tree.place(ids["id"], leaves).alias("a"), shard_tree.place(ids["id"], heavy).alias("b")).collect()
    moved = [r for r in at if r.a != r.b]
    assert moved and all(r.b < 4 for r in moved)


def test_embeddings(spark):
    r = np.random.default_rng(4)
    centre = r.normal(size=(5, 16))
    x = np.concatenate([centre[k % 5] + r.normal(size=16) * 0.08 for k in range(60)]).reshape(60, 16)
    rows = [(k, [float(v) for v in x[k]], k % 2) for k in range(60)]
    rows += [(100, rows[0][1], 0), (101, None, 0), (102, [0.0] * 16, 0), (103, [float("nan")] * 16, 0), (104, rows[0][1], None), (105, [None] + [1.0] * 15, 1), (106, [1.0, 2.0], 0), (107, [], 0)]
    got = {v.vec_id: v for v in embedding_dedup.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    good = [(i, np.array(e, np.float32).astype(float), c) for i, e, c in rows if i <= 100]
    near = lambda a, b: a[2] == b[2] and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.98
    links = {a[0]: sum(near(a, b) for b in good) - 1 for a in good}
    assert sum(got[i].n_links for i in links) >= 0.98 * sum(links.values()) and all(got[i].n_links <= n for i, n in links.items())
    root = plain_components(good, near)
    assert [got[g[0]].component_id for g in good] == [good[k][0] for k in root]
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(101, 108))


def test_embedding_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 6)
    rows = [(k, [1.0 + 0.001 * (k % 7), 1.0, 0.5 + 0.0001 * k, 0.2], 1) for k in range(25)]
    got = embedding_dedup.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert all(v.n_links == 24 and v.component_id == 0 for v in got)


def test_decontamination(spark):
    item = "So Tom has 12 kg of rice and Tom gives 3 kg to Mary every day of the long week"
    docs = [(1, f"before it. {item}. after"), (2, item.replace("Tom", "Bob").replace("12", "7").replace("Mary", "Jane")), (3, item.replace("Tom has", "Bob has").replace("Mary", "Jane")), (4, None), (5, ""), (6, "rice and more rice every day"), (6, item)]
    bench = spark.createDataFrame([(9, item), (8, None), (7, "")], "item_id long, text string")
    df = spark.createDataFrame(docs, DOCS)
    got = sorted((r.doc_id, r.contaminated, r.item_ids) for r in decontaminate.flag_documents(df, bench).collect())
    assert got == [(1, True, "9"), (2, True, "9"), (3, False, ""), (4, False, ""), (5, False, ""), (6, False, ""), (6, True, "9")]
    assert sorted(r.doc_id for r in decontaminate.decontaminate(df, bench).collect()) == [3, 4, 5, 6]
    assert decontaminate.decontaminate(df, bench.limit(0)).count() == len(docs)
    assert decontaminate.flag_documents(df.limit(0), bench).count() == 0


def test_lm(spark):
    r = random.Random(6)
    one, two = [f"th{c}an" for c in "abcdefgh"], [f"sch{c}lich" for c in "abcdefgh"]
    docs = [(k, " ".join(r.choice(one if k % 2 else two) for _ in range(r.randint(20, 60)))) for k in range(200)] + [(300, None), (301, ""), (301, "Unseen WORDS only")]
    got = lm_score.score_documents(spark.createDataFrame(docs, DOCS).repartition(3)).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    words = lambda t: [*(t or "").lower().split(), ""]
    c = Counter(w for i, t in docs if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    base = sorted((i, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t)), 6), len(words(t)), sum(c[w] > 0 for w in words(t))) for i, t in docs)
    assert sorted((x.doc_id, round(x.base_score, 6), x.n_tokens, x.n_known) for x in got) == base
    out = [x for x in got if x.held_out and x.doc_id < 300]
    assert sum(x.score for x in out) > sum(x.base_score for x in out)
    assert all(x.held_out == held(x.doc_id) and x.train_tokens == n for x in got)
    assert lm_score.score_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_lm_probabilities_add_to_one():
    w = np.random.default_rng(0).normal(size=(lm_score.FEATURES, lm_score.CLASSES)).astype(np.float32)
    p = np.exp(lm_score.log_softmax(w, lm_score.feature_rows(np.arange(50))))
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)
    assert lm_score.classes_of([b"the", b"", b"unseen"], {b"the": 1}).tolist()[:2] == [1, 0] and lm_score.TOP < lm_score.ending(b"unseen") < lm_score.CLASSES


def test_lm_words_have_weights_of_their_own(spark):
    """Two words of one class are followed by different words, which only a word's own weights can tell."""
    r = random.Random(8)
    a, b = "ringing", "singing"
    assert lm_score.ending(a.encode()) == lm_score.ending(b.encode())
    fill = [f"{x}{y}{z}" for x in "bcdfg" for y in "aeiou" for z in "lmnprst"]
    docs = [(k, " ".join(x for _ in range(30) for x in ((a, "bells") if r.random() < 0.5 else (b, "songs")) + tuple(r.sample(fill, 6)))) for k in range(60)]
    table = lm_score.blocks(spark.createDataFrame(docs, DOCS))
    top = {w.encode(): k for k, w in enumerate(fill[:118], 1)}
    pairs = lm_score.word_pairs(table, top, 3)
    n = np.ones((lm_score.FEATURES, lm_score.CLASSES))
    got = {}
    sent = {(x.block, x.bucket): np.frombuffer(x.h, np.int64) for x in pairs.collect()}
    for x in lm_score.word_weights(pairs, lm_score.shares_after(n), 3).collect():
        cls, weight, at = lm_score.unzipped(x.cls, np.uint8), lm_score.unzipped(x.weights, np.int8) / lm_score.FINE, 0
        for h, size in zip(sent[x.block, x.bucket].tolist(), lm_score.unzipped(x.size, np.int16).tolist(), strict=True):
            got[h] = (cls[at : at + size], weight[at : at + size])
            at += size
    at = lambda w: got[int(np.uint64(lm_score.word_hash(w.encode())).view(np.int64))]
    bells, songs = (lm_score.ending(w) for w in (b"bells", b"songs"))
    one, two = (dict(zip(*(x.tolist() for x in at(w)), strict=True)) for w in (a, b))
    assert one[bells] > 2 and two[songs] > 2 and songs not in one and bells not in two


def test_lm_ids_beside_nulls(spark):
    big = (1 << 60) + 1
    got = lm_score.score_documents(spark.createDataFrame([(big, "a b c"), (None, "a b"), (big + 1, None)], DOCS)).collect()
    assert {x.doc_id for x in got} == {big, big + 1, None}
    assert {x.doc_id: x.held_out for x in got}[big] == (zlib.crc32(str(big).encode()) % 10 == 0)


def test_quality(spark):
    r = random.Random(8)
    good = lambda: " ".join(r.choice(["the", "house", "river", "walks", "green", "and"]) for _ in range(60))
    bad = lambda: " ".join(r.choice(["the", "house", "river"]) + r.choice(["###", "$$$", "%%%"]) for _ in range(60))
    docs = [(k, bad() if k % 4 == 0 else good() + (" idiot moron" if k % 7 == 0 else ""), "en", f"s{k % 3}") for k in range(400)]
    docs += [(1000, None, None, None), (1001, "", "en", "s1")]
    df = spark.createDataFrame(docs, DOCS + ", lang string, source string")
    labels = spark.createDataFrame([(k, int(k % 4 != 0), int(k % 7 == 0 and k % 4 != 0)) for k in range(300)], "doc_id long, quality int, toxic int")
    models = quality.train_models(df, labels)
    got = {x.doc_id: x for x in quality.score_documents(df, models).collect()}
    new = [got[k] for k in range(300, 400)]
    assert sum(x.kept == (x.doc_id % 4 != 0 and x.doc_id % 7 != 0) for x in new) >= 97
    assert len(got) == 402
    none = quality.train_models(df, labels.limit(0))
    assert quality.score_documents(df, none).filter("kept").count() == 402


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(9)
    docs = [(k, "\n".join(" ".join(f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.randint(0, 30)}" for _ in range(20)) for _ in range(4)), "en", "s", 1) for k in range(60)]
    item = " ".join(f"q{k}" for k in range(30))
    docs += [(100, docs[0][1], "en", "s", 1), (101, docs[1][1] + f"\n{item}", "en", "s", 1), (102, None, None, None, None)]
    spark.createDataFrame(docs, DOCS + ", lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == [*range(60), 102]
    assert [name for name, _ in pipeline.STAGES][0] == "quality classifier" and pipeline.ORACLE_SQL is None


ASKED = "Tom has 12 apples in a basket. Tom buys 7 more apples at the shop. Mary takes 3 apples from the basket. How many apples are left for Tom?"


@pytest.mark.parametrize(
    ("text", "bad"),
    [
        ("Bob has 25 apples in a basket. Bob buys 9 more apples at the shop. Jane takes 4 apples from the basket. How many apples are left for Bob?", True),
        ("Well. BOB has 25 apples in a basket. BOB buys 9 more apples at the shop. JANE takes 4 apples from the basket. How many apples are left for BOB?", True),
        ("Some has 12 apples in a basket. Bob buys 7 more apples at the shop. Jane takes 3 apples from the basket. Now many apples are left for Pat?", False),
        ("TOM SELLS 12 PEARS ON THE MARKET. ANN SELLS 7 MORE PEARS ON THE MARKET. HOW MANY PEARS ARE SOLD BY ANN?", False),
        ("All of it. " * 3000 + ASKED, True),
    ],
)
def test_decontamination_reads_openings_and_capitals_as_names(spark, text, bad):
    bench = spark.createDataFrame([(1, ASKED)], "item_id long, text string")
    df = spark.createDataFrame([(1, "a b"), (2, text), (3, "nothing of the kind is in this text")], "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.contaminated for r in decontaminate.flag_documents(df, bench).collect()} == {1: False, 2: bad, 3: False}


@pytest.mark.parametrize("gap", ["\t", "\r", "\x0b", "\f", " \t  "])
def test_line_dedup_counts_words_between_any_whitespace(spark, gap):
    table = "\n".join(gap.join(f"r{i}c{j}" for j in range(10)) for i in range(6))
    df = spark.createDataFrame([(1, f"first\n{table}"), (2, f"second\n{table}\nend")], DOCS)
    assert sorted((r.doc_id, r.n_deleted) for r in line_dedup.dedup_lines(df).collect()) == [(1, 0), (2, 6)]
    assert sorted(r.n_deleted for r in line_dedup.dedup_lines(df, min_words=61).collect()) == [0, 0]


def test_quality_takes_pseudo_labels_from_all_unlabelled_rows(spark, monkeypatch):
    """All unlabelled documents can be marked in each round, until they are."""
    schema = "doc_id long, text string, lang string, source string"
    known = [(k, "vile hate spam" if k % 2 else "calm kind prose", "en", "bad.example" if k % 2 else "good.example") for k in range(200)]
    rest = [(1000 + k, f"vile hate spam rare{k % 7}" if k % 2 else f"calm kind prose plain{k % 7}", "en", "bad.example" if k % 2 else "good.example") for k in range(6000)]
    labels = spark.createDataFrame([(k, 1 - k % 2, k % 2) for k in range(200)], "doc_id long, quality int, toxic int")
    seen, count = [], quality._count
    monkeypatch.setattr(quality, "FIT_ROWS", 150)
    monkeypatch.setattr(quality, "_count", lambda *a: seen.append(count(*a)) or seen[-1])
    models = quality.train_models(spark.createDataFrame(known + rest, schema), labels)
    first = seen[0]
    assert set(first.groupby(["target", "view"])["n"].sum()) == {6000}
    assert len(seen) == quality.ROUNDS and seen[1]["n"].sum() < first["n"].sum()
    scored = quality.score_documents(spark.createDataFrame(rest, schema), models).collect()
    assert all(r.kept == (r.doc_id % 2 == 0) for r in scored)


def test_lm_tells_histories_apart_by_both_classes(spark):
    """A class follows from the class two back; its number differs from another's by 32, and no two histories share a weight."""
    assert lm_score.HISTORIES == 257 * 257 and len({tuple(r) for r in lm_score.feature_rows(np.arange(lm_score.HISTORIES)).tolist()}) == lm_score.HISTORIES
    top = {b"w%d" % k: k + 1 for k in range(lm_score.TOP)}
    text = " ".join(["w0 w5 w9"] * 60 + ["w32 w5 w77"] * 60)
    docs = spark.createDataFrame([(k, text) for k in range(1, 6)], DOCS)
    weights, table, _ = lm_score.train(lm_score.history_counts(lm_score.history_pairs(lm_score.blocks(docs), top)))
    own = {r.history: np.frombuffer(r.own, np.float32) for r in table.collect()}
    one, two = (c1 * 257 + c2 for c1, c2 in ((6, 1), (6, 33)))
    for h, right, wrong in ((one, 10, 78), (two, 78, 10)):
        p = np.exp(lm_score.log_softmax(weights, lm_score.feature_rows(np.array([h])), own[h][None]))[0]
        assert p[right] > 0.8 and p[wrong] < 0.05 and math.isclose(p.sum(), 1, rel_tol=1e-4)
