"""Column functions over nucleic acid sequences; all are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def star_valid(seq: Column | str) -> Column:
    """Whether * delimiters come in pairs, each around at least one letter."""
    s = _col(seq)
    return (F.length(F.regexp_replace(s, r"[^*]", "")) % 2 == 0) & ~F.contains(s, F.lit("**"))


def sequence_type(seq: Column | str) -> Column:
    """* DELIMITER MISTAKE, NUCLEIC ACID, UT MISTAKE or TEXT, tested in this order; an empty text is NUCLEIC ACID."""
    s = _col(seq)
    return (
        F.when(~star_valid(s), "* DELIMITER MISTAKE")
        .when(s.rlike("^([ACGT*]*|[ACGU*]*)$") & ~s.contains("\n"), "NUCLEIC ACID")
        .when(s.rlike("^[ACGUT*]*$") & ~s.contains("\n"), "UT MISTAKE")
        .otherwise("TEXT")
    )


def is_sequence_of(seq: Column | str, material: str) -> Column:
    """Whether all letters are bases of DNA or RNA."""
    return ~_col(seq).rlike("[^ACGT]" if material == "DNA" else "[^ACGU]")


def fold(seq: Column | str) -> Column:
    """U read as T, so that one alphabet serves for matching."""
    return F.translate(_col(seq), "U", "T")


def to_material(seq: Column | str, material: str) -> Column:
    return F.translate(_col(seq), "U", "T") if material == "DNA" else F.translate(_col(seq), "T", "U")


def complement(seq: Column | str, material: str = "DNA") -> Column:
    """Watson-Crick partners letter by letter; letters outside ACGTU stay."""
    return F.translate(_col(seq), "ACGTU", "TGCAA" if material == "DNA" else "UGCAA")


def reverse_complement(seq: Column | str, material: str = "DNA") -> Column:
    return F.reverse(complement(seq, material))


def pairs(a: Column | str, b: Column | str) -> Column:
    """Whether two bases are a Watson-Crick pair of any materials; no GU wobble, unknown letters never pair."""
    return F.concat(fold(a), fold(b)).isin("AT", "TA", "CG", "GC")


def partners(base: Column | str, material: str, watson_crick: bool = True) -> Column:
    """The bases of a staple of a material that pair with a scaffold base; with GU wobbles unless watson_crick."""
    b, u = fold(base), "U" if material == "RNA" else "T"
    out = F.when(b == "A", F.array(F.lit(u))).when(b == "C", F.array(F.lit("G")))
    g = ["C"] if watson_crick else ["C", u]
    t = ["A"] if watson_crick else ["A", "G"]
    return out.when(b == "G", F.array(*map(F.lit, g))).when(b == "T", F.array(*map(F.lit, t)))


def interchangeable(base: Column | str, staple: str, scaffold: str) -> Column:
    """Letters that may stand in a staple for a base of it, which pairs by Watson-Crick rules, if GU wobbles pair as well; null for other letters."""
    b = _col(base)
    out = F.array(b)
    if scaffold == "RNA":
        out = F.when(b == "A", F.array(b, F.lit("G"))).otherwise(out)
    if staple == "RNA":
        out = F.when(b == "C", F.array(b, F.lit("U"))).otherwise(out)
    return F.when(is_sequence_of(b, staple) & (F.length(b) == 1), out)


def mark_poly_t(seq: Column | str, least: int = 4) -> Column:
    """Each longest run of at least so many T between two *."""
    return F.regexp_replace(_col(seq), f"(T{{{least},}})", r"*$1*")


def truncated(seq: Column | str) -> Column:
    """Sequences of more than 43 letters as their first and last 20 around three dots."""
    s = _col(seq)
    return F.when(F.length(s) > 43, F.concat(F.left(s, F.lit(20)), F.lit("..."), F.right(s, F.lit(20)))).otherwise(s)


def gc_fraction(seq: Column | str) -> Column:
    s = _col(seq)
    return (F.length(s) - F.length(F.translate(s, "GC", ""))) / F.nullif(F.length(s), F.lit(0))


def wrap(i: Column | str, n: Column | str, circular: Column | str) -> Column:
    """An index on a scaffold of n bases: modulo n if circular, -1 beyond the ends if not."""
    i, n = _col(i), _col(n)
    return F.when(_col(circular), F.pmod(i, n)).when((i < 0) | (i >= n), F.lit(-1)).otherwise(i)


def star_parts(seq: Column | str) -> Column:
    """Struct of dangle5, dangle3 and middle, an array of (kind, seq) in which substaples and loopouts alternate.

    Text between * pairs at the ends is a dangle. Of a sequence that is one pair of * around all, the first dangle takes
    it and nothing is left for the other.
    """
    s = _col(seq)
    chunks = F.filter(F.split(s, r"\*"), lambda x: F.trim(x) != "")
    first = F.startswith(s, F.lit("*")) & (F.size(chunks) > 0)
    last = F.endswith(s, F.lit("*")) & (F.size(chunks) > F.when(first, 1).otherwise(0))
    a, n = F.when(first, 1).otherwise(0), F.size(chunks)
    middle = F.slice(chunks, a + 1, F.greatest(n - a - F.when(last, 1).otherwise(0), F.lit(0)))
    return F.struct(
        F.when(first, F.trim(F.get(chunks, F.lit(0)))).alias("dangle5"),
        F.when(last, F.trim(F.get(chunks, n - 1))).alias("dangle3"),
        F.transform(middle, lambda x, i: F.struct(F.when(i % 2 == 0, "substaple").otherwise("loopout").alias("kind"), F.trim(x).alias("seq"))).alias("middle"),
    )


def leading_pairs(a: Column | str, b: Column | str) -> Column:
    """How many leading letters of two sequences pair base for base."""
    a, b = fold(a), complement(fold(b))
    a = F.regexp_replace(a, "[^ACGT]", "x")
    b = F.regexp_replace(b, "[^ACGT]", "y")
    return common_prefix(a, b)


def common_prefix(a: Column | str, b: Column | str) -> Column:
    """Length of the longest common prefix; null where either is null."""
    a, b = _col(a), _col(b)
    most = F.least(F.length(a), F.length(b))
    differ = F.filter(F.sequence(F.lit(1), most), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("int")).when(most < 1, 0).otherwise(F.coalesce(F.get(differ, F.lit(0)) - 1, most))


def random_sequence(n: Column | str, seed: Column | str | int, key: Column | str, material: str = "DNA") -> Column:
    """n letters drawn from (seed, key, place) alone, so the same row has the same letters however rows are dealt out.

    Each hexadecimal digit of the MD5 of seed, key and block number is a letter of the block's 32; a sequence of 0 or fewer
    letters is empty, one of null length null.
    """
    n = _col(n)
    blocks = F.sequence(F.lit(0), F.greatest(F.ceil(n / 32).cast("int") - 1, F.lit(0)))
    start = F.lit(seed) if isinstance(seed, int) else _col(seed)
    drawn = F.array_join(F.transform(blocks, lambda b: F.md5(F.concat_ws("/", start.cast("string"), _col(key).cast("string"), b.cast("string")))), "")
    letters = F.translate(drawn, "0123456789abcdef", ("ACGU" if material == "RNA" else "ACGT") * 4)
    return F.when(n.isNotNull(), F.left(letters, F.greatest(n.cast("int"), F.lit(0))))


def neighbours(texts: DataFrame, text: str, alphabet: str) -> DataFrame:
    """a, b, n: how often letter b follows letter a in the texts, which hold only ASCII letters of the alphabet.

    Two different letters cannot overlap with themselves, so what goes when they are taken out counts them. A letter follows
    itself wherever it neither begins the text nor follows another.
    """
    s = _col(text)
    size = F.octet_length
    gone = lambda x: size(s) - size(F.replace(s, F.lit(x), F.lit("")))
    cells = [(a, b) for a in alphabet for b in alphabet if a != b]
    sums = [F.sum((gone(a + b) / 2).cast("long")).alias(a + b) for a, b in cells]
    sums += [F.sum((gone(a) - F.when(F.startswith(s, F.lit(a)), 1).otherwise(0)).cast("long")).alias(a) for a in alphabet]
    own = lambda a: F.col(a) - sum((F.col(b + a) for b in alphabet if b != a), F.lit(0))
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (own(a) if a == b else F.col(a + b)).alias("n")) for a in alphabet for b in alphabet]
    return texts.filter(size(s) > 0).agg(*sums).select(F.explode(F.array(*rows)).alias("x")).select("x.*").filter("n > 0")
