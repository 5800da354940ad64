"""A Merkle manifest of a dataset, by supersteps over key-value RDDs.

Leaves are rows in the order of their tree's key. Eight consecutive nodes are a run, whose parent is the hash of their
digests; each tree ends in one node. All trees are one graph. A vertex is a small subtree of LEVELS levels of parents, over
up to 512 nodes, known by its tree and its number on its level, so that a superstep, which costs a shuffle, passes several
levels of hashes:

    up      nodes send their digests to the vertex above; one that has all its children hashes them and sends on
    down    a vertex sends each child its path: the siblings' digests of every level above, left and right of it

A message is one digest or one path, and a vertex has at most 512 children, so a tree that has most of the rows is spread
like any other. Leaves stay with the vertex above them: the last step down is inside it, and the paths that travel are those
of vertices, not of rows. A tree that has ended passes its root on, so that all end on the same level. Nothing is collected
but the number of rows at both ends of each sorted partition, and the root. Levels are read again from their shuffles' files
on the way down, and made anew where those are lost.

The trees' roots are the leaves of one more tree, in the order of the trees' keys; its root is the dataset's.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import column, documents, drop_table, persist_table, with_row_id

#: Children of a node, levels of parents in a vertex, and nodes below a vertex.
FAN, LEVELS = 8, 3
SPAN = FAN**LEVELS
#: Key of a vertex: its tree, as text in UTF-8 (none: null), and its number on its level.
Key = tuple[str | None, int]


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for a null, else the value's UTF-8 bytes counted, a colon, the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(f) for f in fields]), 256)


def _place(key: Key) -> int:
    return zlib.crc32(f"{'-' if key[0] is None else '+' + key[0]}/{key[1]}".encode("utf-8", "surrogatepass"))


def numbered(rows: DataFrame, tree: str, order: list[str], partitions: int) -> tuple[RDD, int]:
    """The rows as an RDD of (tree, number in the tree, whether it is the tree's last, row), and the largest number of rows of a tree.

    Rows are range-partitioned and sorted by tree and order; a partition's first tree goes on from those before.
    """
    at = rows.repartitionByRange(partitions, tree, *order).sortWithinPartitions(tree, *order).rdd

    def ends(k: int, part: Iterator) -> Iterator:
        first = last = None
        n = n_first = n_last = most = 0
        for row in part:
            if n == 0:
                first = last = row[tree]
            if row[tree] != last:
                last, n_last = row[tree], 0
            n += 1
            n_last += 1
            n_first += last == first
            most = max(most, n_last)
        if n:
            yield k, first, last, n_first, n_last, n == n_first, most

    offset: dict[int, int] = {}
    follows: dict[int, str | None] = {}  # the first tree of the next partition that has rows
    open_tree, count, most, before = None, 0, 0, None
    for k, first, last, n_first, n_last, single, mx in sorted(at.mapPartitionsWithIndex(ends).collect()):
        count = count if before is not None and open_tree == first else 0
        offset[k] = count
        if before is not None:
            follows[before] = (first,)
        most = max(most, mx, count + n_first)
        open_tree, count, before = last, (count + n_first if single else n_last), k

    def number(k: int, part: Iterator) -> Iterator:
        held, n = None, offset.get(k, 0)
        for row in part:
            if held is not None:
                same = held[tree] == row[tree]
                yield held[tree], n, not same, tuple(held)
                n = n + 1 if same else 0
            held = row
        if held is not None:
            yield held[tree], n, follows.get(k) != (held[tree],), tuple(held)

    return at.mapPartitionsWithIndex(number), most


def gather(messages: RDD, partitions: int) -> RDD:
    """A superstep's vertices: what their children sent, (place, last, digest, rest), in order. A child that is missing is an error."""

    def complete(item: tuple) -> tuple:
        (tree, j), sent = item
        children = sorted(sent, key=lambda c: c[0])
        if [c[0] for c in children] != list(range(len(children))) or (len(children) < SPAN and not children[-1][1]):
            raise RuntimeError(f"vertex {j} of tree {tree!r} lacks children")
        return item[0], children

    return messages.groupByKey(partitions, _place).map(complete, preservesPartitioning=True)


def grown(key: Key, children: list) -> list[list[str]]:
    """The levels of digests in a vertex, from its children on: up to one node if the tree ends here, else LEVELS of parents."""
    levels = [[c[2] for c in children]]
    ends = key[1] == 0 and children[-1][1]
    while len(levels[-1]) > 1 if ends else len(levels) <= LEVELS:
        now = levels[-1]
        levels.append([digest(now[k : k + FAN]) for k in range(0, len(now), FAN)])
    return levels


def beside(levels: list[list[str]], p: int) -> tuple[tuple[str, str], ...]:
    """The digests left and right of child p and of its parents in the vertex, level by level."""
    out = []
    for level in levels[:-1]:
        run = level[p - p % FAN :][:FAN]
        out.append(("".join(run[: p % FAN]), "".join(run[p % FAN + 1 :])))
        p //= FAN
    return tuple(out)


def rise(leaves: RDD, most: int, partitions: int) -> list[RDD]:
    """The levels of vertices, from the lowest; leaves are (tree, number, last, digest, rest), at most ``most`` of a tree."""
    messages = leaves.map(lambda x: ((x[0], x[1] // SPAN), (x[1] % SPAN, x[2], x[3], x[4])))

    def send(item: tuple) -> tuple:
        (tree, j), children = item
        return (tree, j // SPAN), (j % SPAN, children[-1][1], grown(*item)[-1][0], None)

    levels = [gather(messages, partitions)]
    while most > SPAN:
        most = -(-most // SPAN)
        levels.append(gather(levels[-1].map(send), partitions))
    return levels


def roots_of(levels: list[RDD]) -> RDD:
    """(tree, digest) of the node in which each tree ends."""
    return levels[-1].map(lambda x: (x[0][0], grown(*x)[-1][0]))


def descend(levels: list[RDD], partitions: int, above: RDD | None = None) -> RDD:
    """(key, children, levels of digests, path) for each vertex of the lowest level.

    A path is a tuple, from below: (left, right) for each level of parents, then what above has for the tree, (tree, tuple).
    """

    def meet(level: RDD, messages: RDD) -> RDD:
        both = level.map(lambda x: (x[0], (0, x[1]))).union(messages.map(lambda x: (x[0], (1, x[1])))).groupByKey(partitions, _place)

        def pair(item: tuple) -> tuple:
            found = dict(item[1])
            return item[0], found[0], found[1]

        return both.map(pair)

    def forward(item: tuple) -> Iterator:
        (tree, j), children, path = item
        inside = grown((tree, j), children)
        for child in children:
            yield (tree, j * SPAN + child[0]), (*beside(inside, child[0]), *path)

    top = levels[-1]
    now = top.map(lambda x: (x[0], x[1], ())) if above is None else meet(top, above.map(lambda x: ((x[0], 0), x[1])))
    for level in levels[-2::-1]:
        now = meet(level, now.flatMap(forward))
    return now.map(lambda x: (x[0], x[1], grown(x[0], x[1]), x[2]))


def manifest(rows: DataFrame, tree: str, order: list[str], leaf: str, told: str, keep: list[str], partitions: int | None = None) -> DataFrame:
    """The columns keep, and leaf, subroot, root, proof_sha256, folded_root, verified of each row.

    Within a tree (a text column; null is a tree of its own, the first) rows ascend by order, nulls first, then by leaf and
    then as they come. ``told`` is the digest that a reader of the row has: it is folded with the original siblings, and
    the row is verified if that gives the root. proof_sha256 hashes the siblings' digests, from the leaf's level to the root.
    Equal rows are leaves of their own. No rows give none.
    """
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = lambda columns, letter: [column(c).alias(f"_{letter}{k}") for k, c in enumerate(columns)]
    base = rows.select(column(tree).alias("_tree"), *named(order, "o"), *named(keep, "k"), column(leaf).alias("_leaf"), column(told).alias("_told"))
    base = with_row_id(base, "_row")
    places = {c: k for k, c in enumerate(base.columns)}
    first_kept, at_leaf, at_told = places["_k0"] if keep else 0, places["_leaf"], places["_told"]
    leaves, most = numbered(base, "_tree", [*[f"_o{k}" for k in range(len(order))], "_leaf", "_row"], n)
    digests = [f"{c} string" for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
    schema = ", ".join([*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep], *digests, "verified boolean"])
    if not most:
        drop_table(base)
        return spark.createDataFrame([], schema)
    kept = len(keep)

    def leaf_of(x: tuple) -> tuple:
        key, number, last, row = x
        have = None if row[at_told] == row[at_leaf] else row[at_told]
        return key, number, last, row[at_leaf], (row[first_kept : first_kept + kept], have)

    levels = rise(leaves.map(leaf_of), most, n)

    roots = persist_table(spark.createDataFrame(roots_of(levels), "tree string, top string", verifySchema=False))
    trees, many = numbered(roots.withColumn("all", F.lit("")), "all", ["tree"], n)
    upper = rise(trees.map(lambda x: (x[0], x[1], x[2], x[3][1], x[3])), many, n)
    ((_, dataset),) = roots_of(upper).collect()

    def to_tree(item: tuple) -> Iterator:
        _, children, inside, path = item
        for p, _, top, (name, *_) in children:
            yield name, ((top, (*beside(inside, p), *path)),)

    def to_rows(item: tuple) -> Iterator:
        _, children, inside, path = item
        (top, outer), inner = path[-1], path[:-1]
        for p, _, own, (values, have) in children:
            steps = [*beside(inside, p), *inner, *outer]
            fold = own if have is None else have
            for left, right in steps:
                fold = digest([left, fold, right])
            yield (*values, own, top, dataset, digest([x for step in steps for x in step]), fold, fold == dataset)

    # what a tree gets from above is its own root and the steps from there to the dataset's
    above = descend(upper, n).flatMap(to_tree)
    return spark.createDataFrame(descend(levels, n, above).flatMap(to_rows), schema, verifySchema=False)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Trees are the languages.

    Where 3 divides the CRC-32 of the decimal id, a reader has the text with A-Z in lower case; null ids are not so.
    """
    docs = documents(spark, sf_dir)
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    other = F.translate("text", capitals, capitals.lower())
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    fields = lambda text: [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    leaf = leaf_digest(fields(F.col("text")))
    rows = docs.select("doc_id", "lang", leaf.alias("leaf"), F.when(tampered, leaf_digest(fields(other))).otherwise(leaf).alias("told"))
    return manifest(rows, "lang", ["doc_id"], "leaf", "told", ["doc_id"])


def _sql() -> str:
    """The manifest in DuckDB: trees level by level, siblings by joins, digests folded step by step. CRC-32 is written out bit by bit."""
    crc = "list_reduce(list_concat([4294967295], flatten([[ascii(c), 0, 0, 0, 0, 0, 0, 0] for c in string_split(doc_id::varchar, '')])), lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)))"
    field = lambda v: f"coalesce(strlen({v}::varchar) || ':' || {v}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def grow(name: str, start: str) -> str:
        return f"""{name} as ({start} union all
          select tree, level + 1, i // {FAN}, sha256(string_agg(h, '' order by i)), any_value((n + {FAN - 1}) // {FAN}) from {name} where n > 1 group by tree, level, i // {FAN})"""

    def beside(name: str, source: str, joins: str) -> str:
        side = lambda test: f"coalesce(string_agg(o.h, '' order by o.i) filter (o.i {test} m.i), '') "
        return f"""{name} as (select m.tree, m.level, m.i, {side('<')} as l, {side('>')} as g from {source} m join {source} o
          on o.tree = m.tree and o.level = m.level and o.i // {FAN} = m.i // {FAN} where m.n > 1 group by m.tree, m.level, m.i)"""

    return f"""
    with recursive
    rows as (select doc_id, coalesce('+' || lang, '-') as tree, {leaf('text')} as leaf,
      case when coalesce(xor({crc}, 4294967295) % 3 = 0, false) then {leaf(lower)} else {leaf('text')} end as told from documents),
    leaves as (select row_number() over () as r, *, row_number() over (partition by tree order by doc_id nulls first, leaf, told) - 1 as i from rows),
    {grow('up', "select tree, 0 as level, i, leaf as h, count(*) over (partition by tree) as n from leaves")},
    subs as (select tree as sub, h as subroot, level as high, row_number() over (order by tree = '-' desc, tree) - 1 as i from up where n = 1),
    {grow('top', "select '' as tree, 0 as level, i, subroot as h, count(*) over () as n from subs")},
    {beside('inner_steps', 'up', '')}, {beside('outer_steps', 'top', '')},
    steps as (
      select r, s.level as k, s.l, s.g from leaves x join inner_steps s on s.tree = x.tree and s.i = x.i // ({FAN} ** s.level)::bigint
      union all
      select r, b.high + s.level, s.l, s.g from leaves x join subs b on b.sub = x.tree join outer_steps s on s.i = b.i // ({FAN} ** s.level)::bigint),
    fold as (select r, 0 as k, told as h from leaves union all select f.r, f.k + 1, sha256(s.l || f.h || s.g) from fold f join steps s on s.r = f.r and s.k = f.k),
    ends as (select r, max_by(h, k) as h from fold group by r),
    proofs as (select r, sha256(coalesce(string_agg(s.l || s.g, '' order by s.k), '')) as proof from leaves left join steps s using (r) group by r)
    select doc_id, leaf, subroot, t.h as root, proof as proof_sha256, e.h as folded_root, e.h = t.h as verified
    from leaves x join subs b on b.sub = x.tree join top t on t.n = 1 join ends e using (r) join proofs using (r)"""


SQL = _sql()
