import pytest
from pyspark.sql import functions as F

from helixloom.functions import register, sequence, space


def value(spark, column, **given):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("s", "kind"),
    [("", "NUCLEIC ACID"), ("ACGT", "NUCLEIC ACID"), ("ACGU", "NUCLEIC ACID"), ("*T*ACG", "NUCLEIC ACID"), ("ACGUT", "UT MISTAKE"), ("A*CG", "* DELIMITER MISTAKE"), ("A**CG", "* DELIMITER MISTAKE"), ("HELLO", "TEXT"), ("acgt", "TEXT"), ("ACG\n", "TEXT")],
)
def test_sequence_type(spark, s, kind):
    assert value(spark, sequence.sequence_type("s"), s=s) == kind


@pytest.mark.parametrize(
    ("s", "five", "three", "middle"),
    [
        ("AAAC", None, None, [("substaple", "AAAC")]),
        ("*TT*AAAC", "TT", None, [("substaple", "AAAC")]),
        ("AAAC*TT*", None, "TT", [("substaple", "AAAC")]),
        ("*T*AA*G*CC*A*", "T", "A", [("substaple", "AA"), ("loopout", "G"), ("substaple", "CC")]),
        ("*TTTT*", "TTTT", None, []),
    ],
)
def test_star_parts(spark, s, five, three, middle):
    got = value(spark, sequence.star_parts("s"), s=s)
    assert (got.dangle5, got.dangle3, [tuple(x) for x in got.middle]) == (five, three, middle)


def test_bases(spark):
    for a in "ACGTUNX*":
        for b in "ACGTUNX*":
            assert value(spark, sequence.pairs("a", "b"), a=a, b=b) == (a + b in ("AT", "TA", "AU", "UA", "CG", "GC"))
    want = {("A", "DNA"): "T", ("A", "RNA"): "U", ("C", "DNA"): "G", ("G", "RNA"): "C", ("T", "DNA"): "A", ("U", "RNA"): "A"}
    for (b, m), p in want.items():
        assert value(spark, sequence.partners("b", m), b=b) == [p]
    assert value(spark, sequence.partners("b", "RNA", watson_crick=False), b="G") == ["C", "U"]
    assert value(spark, sequence.partners("b", "DNA", watson_crick=False), b="U") == ["A", "G"]
    assert value(spark, sequence.reverse_complement("s", "RNA"), s="AACGU") == "ACGUU"


@pytest.mark.parametrize(("i", "n", "circular", "want"), [(0, 5, False, 0), (5, 5, False, -1), (-1, 5, False, -1), (5, 5, True, 0), (-1, 5, True, 4), (-10, 5, True, 0), (13, 5, True, 3)])
def test_wrap(spark, i, n, circular, want):
    assert value(spark, sequence.wrap(F.col("i"), F.col("n"), F.col("c")), i=i, n=n, c=circular) == want


def test_text(spark):
    assert value(spark, sequence.mark_poly_t("s"), s="TTTTACTTTGTTTTTT") == "*TTTT*ACTTTG*TTTTTT*"
    assert value(spark, sequence.truncated("s"), s="A" * 43) == "A" * 43
    assert value(spark, sequence.truncated("s"), s="C" * 20 + "A" * 4 + "G" * 20) == "C" * 20 + "..." + "G" * 20
    assert value(spark, sequence.common_prefix("a", "b"), a="ACGT", b="ACCT") == 2
    assert value(spark, sequence.common_prefix("a", "b"), a="", b="A") == 0
    assert value(spark, sequence.leading_pairs("a", "b"), a="ACGN", b="TGCN") == 3


def test_space(spark):
    a = lambda *x: F.array(*map(F.lit, map(float, x)))
    assert value(spark, space.distance(a(0, 0, 0), a(3, 4, 0))) == 5
    assert value(spark, space.angle(a(1, 0, 0), a(0, 2, 0))) == pytest.approx(90)
    assert value(spark, space.angle(a(1, 0, 0), a(0, 0, 0))) is None
    assert value(spark, space.may_pair(a(0, 0, 0), a(1, 0, 0), a(1, 0, 0), a(-1, 0, 0), 1.0, 5.0))


def test_sql_names(spark):
    register.register(spark)
    assert tuple(spark.sql("select revcomp('AACG'), seq_type('ACGTU'), poly_t('TTTTT'), scaffold_index(-1, 5, true)").first()) == ("CGTT", "UT MISTAKE", "*TTTTT*", 4)
