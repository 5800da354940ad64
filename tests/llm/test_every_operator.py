"""What every operator owes its table: ids beyond 2**53 beside nulls, foreign columns of its own inner names, very long texts, repeated rows."""

import random

import pytest

shared = pytest.importorskip("helixloom.llm.shared")
from helixloom.llm import bpe, decontaminate, embedding_dedup, license_scan, line_dedup, lm_score, merkle, quality, secret_scan, shard_tree, simhash_dedup, whitening  # noqa: E402

BIG = (1 << 53) + 1
#: Names that operators use inside, and of types that are not theirs.
FOREIGN = {"_row": "string", "q": "int", "t": "double", "_h": "binary", "k0": "array<int>", "r0": "string", "m0": "int", "h": "string", "doc": "string", "id": "double", "a": "string", "b": "int", "_n": "string", "_x": "string", "tie": "string", "utf8": "int"}
VALUES = ("r", 7, 0.5, b"x", [1, None], "s", 3, "h", "d", 2.5, "a", 1, "n", "x", "t", 8)


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(9)
    words = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("an", "or", "ell", "ith", "ouse")]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(24)]
    texts += [None, "", " \n ", " ".join(r.choice(words) for _ in range(60_000)), "x" * 400_000, texts[0], texts[0], "token=abcdefghijklmnop\n" * 50]
    rows = [(None if k % 7 == 3 else BIG + k, t, ("en", None, "de")[k % 3], "web", len(t or ""), *VALUES) for k, t in enumerate(texts)]
    rows += rows[:2]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{k} {v}" for k, v in FOREIGN.items())).repartition(5)


def ids(df, name="doc_id"):
    return sorted((r[0] for r in df.select(name).collect()), key=str)


def foreign(df):
    return {tuple(str(v) for v in r) for r in df.select(*FOREIGN).collect()}


def test_columns_and_ids_pass(spark, table):
    labels = spark.createDataFrame([(BIG + k, k % 2, k % 3 % 2) for k in range(20)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "nothing of this kind is in there at all you see")], "item_id long, text string")
    every, others = ids(table), foreign(table)
    made = {
        "op1": line_dedup.dedup_lines(table),
        "op3": license_scan.scan_licences(table),
        "op4": bpe.bpe_columns(table, bpe.default_vocab(), digests=True),
        "op8": quality.score_documents(table, quality.train_models(table, labels)),
        "op9": decontaminate.decontaminate(table, bench),
        "op11": secret_scan.find_secrets(table),
        "op11 masked": secret_scan.mask_secrets(table),
    }
    for name, out in made.items():
        assert ids(out) == every and foreign(out) == others, name
    kept = simhash_dedup.keep_one(table)
    assert set(ids(kept)) <= set(every) and foreign(kept) == others
    assert 20 < kept.count() < table.count()


def test_digest_tables_have_a_row_a_document(spark, table, tmp_path):
    every = ids(table)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    made = {
        "op2": simhash_dedup.simhash_components(table),
        "op5": lm_score.score_documents(table),
        "op6": shard_tree.shard_documents(table, shard_tree.tree(8)),
        "op9": decontaminate.flag_documents(table, spark.createDataFrame([], "item_id long, text string")),
        "op12": merkle.op12_merkle_manifest(spark, str(tmp_path)),
    }
    for name, out in made.items():
        assert ids(out) == every, name


def test_vectors(spark):
    r = random.Random(2)
    rows = [(None if k % 5 == 2 else BIG + k, [r.gauss(0, 1) for _ in range(8)] if k % 4 else None, k % 2, *VALUES) for k in range(40)]
    rows += rows[1:4]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, " + ", ".join(f"{k} {v}" for k, v in FOREIGN.items())).repartition(3)
    assert ids(embedding_dedup.embedding_links(df), "vec_id") == ids(df, "vec_id")
    white = whitening.whiten(df)
    assert ids(white.filter("component = 1"), "vec_id") == ids(df.filter("embedding is not null"), "vec_id")
    assert white.filter("component = 4").count() == white.filter("component = 1").count()
