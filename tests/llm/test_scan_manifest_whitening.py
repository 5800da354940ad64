"""Secret scan, Merkle manifest and whitening against plain versions."""

import hashlib
import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

secret_scan = pytest.importorskip("helixloom.llm.secret_scan")
from helixloom.llm import merkle, queries, whitening  # noqa: E402

SF = "/root/testdata/sf0.001"
BIG = (1 << 53) + 1


# ---- secrets

PLAIN = [
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), lambda m: len(m[2]) >= 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), lambda m: True),
    ("github", re.compile(r"gh[opsur]_[A-Za-z0-9]+"), lambda m: len(m[0]) >= 40),
    ("slack", re.compile(r"xox[abeoprs]-[A-Za-z0-9-]+"), lambda m: len(m[0]) >= 24),
    ("stripe", re.compile(r"[rs]k_(live|test)_[A-Za-z0-9]+"), lambda m: len(m[0]) >= 32),
    ("url", re.compile(r"[a-z]+://[A-Za-z0-9._~%-]+:[A-Za-z0-9._~%!$&*+=-]+@"), lambda m: True),
]
LONG = re.compile(PLAIN[0][1].pattern.replace("]+)", "]{12,})"), re.I | re.A)


def plain_secrets(text):
    kinds = [k for k, _, _ in PLAIN] + ["inner"]
    found = [(k, *m.span()) for k, p, ok in PLAIN for m in p.finditer(text) if ok(m)]
    found += [("inner", *m.span()) for m in LONG.finditer(text) if ("assign", *m.span()) not in found]
    found.sort(key=lambda x: (x[1], kinds.index(x[0]), x[2]))
    return [x for x in found if kinds.index(x[0]) < 3], found


def odd_texts(n, seed=5):
    r = random.Random(seed)
    parts = ["password", "Token", "SECRET", "api_key", "apikey", "passwd", " ", "=", ":", '"', "'", "AKIA", "A", "Z9", "0123456789abcdef", "deadbeef"]
    parts += ["x", "é", "\n", "abcdefghijkl", "token=", "secret: ", "secre", "-", ".", "/", "日", "ſ", "ghp_", "xoxb-", "sk_live_", "abc://u:p@", "s://"]
    parts += ["Q1w2E3r4T5y6U7i8O9p0Q1w2E3r4T5y6U7i8", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "🙂", "\x00", "k"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_secret_scan_equals_regexes():
    scan = secret_scan.scanner()
    for text in [*odd_texts(6000), "", "f" * 100_000, "token: " * 20_000, ("password=" + "a" * 40 + " ") * 3000, "é" * 50_000 + "secret=abcdefghijklmn"]:
        assert scan.scan(text.encode()) == plain_secrets(text), text[:200]


def test_patterns():
    r = random.Random(2)
    for pattern in ["a(b|cd)*e", "(a|ab)(c|bcd)?", "[a-c]{2,}d", "a{3}b?", r"\x61\.+b", "(ab|a)?b+"]:
        node, whole = secret_scan.read_pattern(pattern), re.compile(pattern)
        a, back = secret_scan.compile_rules([node], False), secret_scan.compile_rules([secret_scan.backwards(node)], False)
        for _ in range(400):
            word = "".join(r.choice("abcde.") for _ in range(r.randint(0, 7)))
            for machine, w in ((a, word), (back, word[::-1])):
                s = machine.start
                for b in w.encode():
                    s = machine.step[s + machine.classes[b]]
                assert (s >= machine.ends) == bool(whole.fullmatch(word)), (pattern, word)
    for wrong in ["(a", "a)", r"\d"]:
        with pytest.raises(ValueError):
            secret_scan.read_pattern(wrong)


def test_automaton_is_minimal():
    a = secret_scan.compile_rules([secret_scan.read_pattern("(a|b)*abb")], False)
    assert len(a.step) // (max(a.classes) + 1) == 5  # four states, and the dead one for other bytes


def test_secret_table(spark):
    texts = [None, "", "token=abcdefghijkl", "token=abcdefghijkl", *odd_texts(40, 8)]
    rows = [(None if k == 3 else BIG + k // 2, t, "x", "y", [k], "z") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, utf8 string, k0 array<int>, n_hex string").repartition(3)
    out = secret_scan.find_secrets(df)
    assert out.columns == ["doc_id", "text", "utf8", "k0", "n_assign", "n_access", "n_hex", "base_spans", "spans"]
    for r in out.collect():
        base, every = plain_secrets(r.text or "")
        assert (r.base_spans, r.spans) == (secret_scan.joined(base), secret_scan.joined(every)) and r.utf8 == "y"
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[0] == k for x in base) for k in ("assign", "access", "hex")]
        assert r.doc_id == rows[r.k0[0]][0]
    assert secret_scan.find_secrets(df.limit(0)).count() == 0


def test_masked_texts(spark):
    df = spark.createDataFrame([(1, "é token: abcdefghijkl, 0123456789abcdef.", 1), (2, None, 2), (2, "secret=0123456789abcdef!", 3), (3, "", 4)], "doc_id long, text string, masked int")
    out = secret_scan.mask_secrets(df)
    assert out.columns == df.columns
    assert sorted(tuple(r) for r in out.collect() if r.text is not None) == [(1, "é [assign], [hex].", 1), (2, "[assign]!", 3), (3, "", 4)]


# ---- manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(docs):
    """docs: doc_id, source, lang, n_chars, text."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    trees = {}
    for d in docs:
        told = leaf = h(*map(field, d))
        if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0:
            told = h(*map(field, [*d[:4], None if d[4] is None else "".join(x.lower() if x.isascii() else x for x in d[4])]))
        trees.setdefault(d[2], []).append((d[0], leaf, told))

    def grow(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
        return levels

    def steps(levels, k):
        out = []
        for level in levels[:-1]:
            run, p = level[k - k % 8 :][:8], k % 8
            out.append(("".join(run[:p]), "".join(run[p + 1 :])))
            k //= 8
        return out

    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    rows = {t: sorted(trees[t], key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for t in order}
    grown = {t: grow([x[1] for x in rows[t]]) for t in order}
    top, out = grow([grown[t][-1][0] for t in order]), []
    for k, t in enumerate(order):
        for j, (i, leaf, fold) in enumerate(rows[t]):
            path = steps(grown[t], j) + steps(top, k)
            for left, right in path:
                fold = h(left, fold, right)
            out.append((i, leaf, grown[t][-1][0], top[-1][0], h(*[x for s in path for x in s]), fold, fold == top[-1][0]))
    return out


def write_documents(spark, folder, docs):
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string, _row int, leaf string, told string")
    df.repartition(3).write.mode("overwrite").parquet(f"{folder}/documents.parquet")


@pytest.mark.parametrize("sizes", [{}, {"a": 1}, {None: 1, "": 1}, {"a": 8, "b": 9, None: 64}, {"a": 65, "é": 2, "z": 1, "": 3}, {f"l{k:02}": k % 3 + 1 for k in range(70)}, {"a": 600, "b": 1}, {"a": 512, "b": 513, "c": 511}])
def test_manifest(spark, tmp_path, sizes):
    r = random.Random(len(sizes))
    docs = []
    for lang, n in sizes.items():
        for _ in range(n):
            docs.append((r.choice([None, *range(BIG, BIG + 200)]), r.choice([None, "s", "é"]), lang, r.choice([None, 3, -1]), r.choice([None, "", "Ab É", "x" * 3000])))
    docs += docs[:3] * (2 if len(docs) > 20 else 0)  # repeated rows
    write_documents(spark, tmp_path, [(*d, 1, "l", "t") for d in docs])
    got = [tuple(x) for x in merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(plain_manifest(docs), key=str)


def test_a_missing_child_is_an_error(spark):
    lost = spark.sparkContext.parallelize([(("a", 0), (0, False, "x", None)), (("a", 0), (2, True, "y", None))])
    with pytest.raises(Exception, match="lacks children"):
        merkle.gather(lost, 2).collect()


def test_two_supersteps(spark):
    """A tree of more rows than a vertex holds, by two levels of vertices."""
    digests = [h(str(k)) for k in range(600 * 600 // 2)]
    leaves = spark.sparkContext.parallelize([("t", k, k == len(digests) - 1, d, None) for k, d in enumerate(digests)], 4)
    levels = merkle.rise(leaves, len(digests), 4)
    assert len(levels) == 2
    level = digests
    while len(level) > 1:
        level = [h(*level[k : k + 8]) for k in range(0, len(level), 8)]
    assert merkle.roots_of(levels).collect() == [("t", level[0])]


# ---- whitening


def plain_whitening(vectors, top=4):
    x = [tuple(int(np.floor(np.float64(c) * 256)) for c in v) for v in vectors]
    fit = sorted(set(x))
    n, wide = len(fit), len(fit[0])
    mean = [Fraction(sum(v[k] for v in fit), n) for k in range(wide)]
    v = np.array([[float(sum((r[a] - mean[a]) * (r[b] - mean[b]) for r in fit) / n) for b in range(wide)] for a in range(wide)])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes.T[::-1]
    return n, [sum((n * (c - m)) ** 2 for c, m in zip(r, mean)) for r in x], [[float(sum(float(c - m) * a for c, m, a in zip(r, mean, axes[k]))) / values[k] ** 0.5 for k in range(top)] for r in x], values / np.trace(v)


def test_whitening_equals_fractions(spark):
    r = np.random.default_rng(4)
    vectors = (r.normal(size=(60, 6)) * np.array([5, 3, 2, 1, 0.5, 0.2])).astype(np.float32).tolist()
    vectors += vectors[:20] * 3
    bad = [(None, None), (1, [None] + [0.0] * 5), (2, [float("nan")] + [0.0] * 5), (3, [float("-inf")] + [0.0] * 5), (4, [1.0]), (5, [])]
    rows = [(BIG + k, v, "a", 1) for k, v in enumerate(vectors)] + [(*b, "b", 2) for b in bad] + [(None, vectors[0], "c", 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, _x string, component int").repartition(5)
    got = whitening.whiten(df).collect()
    n, deviation, white, shares = plain_whitening(vectors)
    assert len(got) == 4 * (len(vectors) + 1) and {g.n for g in got} == {n}
    sign = {}
    for g in got:
        k = 0 if g.vec_id is None else g.vec_id - BIG
        want = white[k][g.component - 1]
        assert g.deviation == deviation[k] and g.deviation_digits == str(deviation[k])
        assert abs(abs(g.whitened) - abs(want)) < 1e-9 and abs(g.explained - shares[g.component - 1]) < 1e-12 and g.identity_error < 1e-9
        if abs(want) > 1e-6:
            assert sign.setdefault(g.component, g.whitened * want > 0) == (g.whitened * want > 0)


def test_sums_are_exact():
    r = random.Random(3)
    for bits in (3, 20, 40, 63):
        x = np.array([[r.randrange(-(1 << bits), 1 << bits) for _ in range(3)] for _ in range(50)], dtype=np.int64 if bits < 63 else object)
        x = np.clip(x, -(1 << 63), (1 << 63) - 1).astype(np.int64)
        shift = [int(v) for v in x[0]]
        total, cross = whitening.block_sums(whitening.less(x, shift))
        rows = [[int(v) - s for v, s in zip(row, shift)] for row in x]
        assert list(total) == [sum(c) for c in zip(*rows)]
        assert cross.tolist() == [[sum(row[a] * row[b] for row in rows) for b in range(3)] for a in range(3)]


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<double>"
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    assert make([]) == make([(1, None)]) == make([(1, [])]) == make([(1, [0.5, 1.0]), (2, [0.5, 1.0])]) == []
    two = make([(1, [0.0, 3.0]), (2, [0.0, 5.0]), (2, [0.0, 5.0])])  # one component has variance
    assert sorted((g.vec_id, g.component, g.n, g.deviation, abs(round(g.whitened, 9))) for g in two) == [(1, 1, 2, 512**2, 1.0), (2, 1, 2, 512**2, 1.0), (2, 1, 2, 512**2, 1.0)]
    huge = make([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 0.0])])
    assert all(g.deviation is None and len(g.deviation_digits) > 30 for g in huge if g.vec_id == 1) and len(huge) == 3  # beside 2**126 the other axis has no variance in float64


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["op11_secret_scan", "op12_merkle_manifest"])
def test_query_equals_its_sql(spark, name):
    duck = pytest.importorskip("duckdb").connect()
    duck.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    df = queries.QUERIES[name](spark, SF)
    r = duck.execute(queries.SQL[name])
    at = [[d[0] for d in r.description].index(c) for c in df.columns]
    assert sorted((tuple(x) for x in df.collect()), key=str) == sorted((tuple(x[i] for i in at) for x in r.fetchall()), key=str)
