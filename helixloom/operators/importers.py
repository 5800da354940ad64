"""Contact maps from other design tools: nested strand files and simulated structures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_table
from . import geometry as geo
from .contact_map import ID, ContactMap

#: Reach in simulation units and degrees of a base pair.
CUTOFF, ANGLE = 1.75, 8.75


def sections_of(base_i53: str, n: str, circular: str) -> Column:
    """Section lengths of a staple: cut where just one of two neighbours is free, or they are more than one base apart.

    On a circular scaffold its last and first base are neighbours.
    """
    step = f"""transform(sequence(1, size({base_i53})), p -> if(p = size({base_i53}) or
      (({base_i53}[p - 1] < 0) <> ({base_i53}[p] < 0)) or (abs({base_i53}[p - 1] - {base_i53}[p]) > 1
        and not ({circular} and least({base_i53}[p - 1], {base_i53}[p]) = 0 and greatest({base_i53}[p - 1], {base_i53}[p]) = {n} - 1)), p, 0))"""
    return F.expr(f"transform(filter({step}, x -> x > 0), (x, i) -> x - if(i = 0, 0, filter({step}, y -> y > 0)[i - 1]))")


def grid_places(strands: DataFrame) -> DataFrame:
    """design_id, strand, k (place on the strand from 5'), helix, offset, turn, deleted, inserted, loop for strands (design_id, strands).

    A loopout of m bases gives m rows without helix. turn counts inserted bases at an offset.
    """
    s = strands.select(ID, F.posexplode("strands").alias("strand", "s"))
    d = s.select(ID, "strand", F.coalesce("s.is_scaffold", F.lit(False)).alias("is_scaffold"), "s.sequence", F.posexplode("s.domains").alias("dom", "d"))
    loops = d.filter("d.loopout > 0").select(ID, "strand", "is_scaffold", "sequence", "dom", F.explode(F.expr("sequence(1, d.loopout)")).alias("q"))
    none = F.lit(None).cast("int")
    loops = loops.select(ID, "strand", "is_scaffold", "sequence", "dom", "q", none.alias("helix"), none.alias("offset"), F.lit(0).alias("inserted"), F.lit(False).alias("deleted"))
    runs = d.filter("d.loopout is null and d.end > d.start")
    order = F.expr("if(d.forward, sequence(d.start, d.end - 1), reverse(sequence(d.start, d.end - 1)))")
    runs = runs.select(ID, "strand", "is_scaffold", "sequence", "dom", F.posexplode(order).alias("q", "offset"), F.col("d.helix").alias("helix"), "d.insertions", "d.deletions")
    inserted = F.expr("coalesce(get(filter(insertions, x -> x[0] = offset), 0)[1], 0)")
    runs = runs.select(ID, "strand", "is_scaffold", "sequence", "dom", "q", "helix", "offset", inserted.alias("inserted"), F.coalesce(F.array_contains("deletions", F.col("offset")), F.lit(False)).alias("deleted"))
    return loops.unionByName(runs)


def from_scadnano(strands: DataFrame) -> tuple[ContactMap, DataFrame]:
    """Maps of designs with a scaffold strand, and errors (design_id, message). Scaffolds count as linear.

    Inserted scaffold bases follow their offset; deleted ones do not exist. A staple's inserted bases come before its base
    at the offset. Strands without a sequence read N; staples that pair with nothing are left out.
    """
    at = grid_places(strands)
    chosen = at.filter("is_scaffold").groupBy(ID).agg(F.min("strand").alias("scaffold"))
    at = at.join(chosen, ID)
    sc = at.filter("strand = scaffold")
    gone = sc.filter("deleted").select(ID, "helix", "offset").distinct().withColumn("gone", F.lit(True))
    live = sc.filter("not deleted").withColumn("x", F.explode(F.expr("sequence(0, inserted)")))
    w = Window.partitionBy(ID).orderBy("dom", "q", "x")
    live = live.withColumn("i53", F.row_number().over(w) - 1)
    letters = live.select(ID, "i53", F.when(F.col("sequence").isNull(), "N").otherwise(F.upper(F.substring(F.col("sequence"), F.col("i53") + 1, F.lit(1)))).alias("base_letter"))
    place = live.filter("x = 0 and helix is not null").select(ID, "helix", "offset", "i53", F.col("inserted").alias("more"))
    st = at.filter("not is_scaffold").join(gone, [ID, "helix", "offset"], "left").filter("gone is null").drop("gone").join(place, [ID, "helix", "offset"], "left")
    errors = st.filter("more > 0 and inserted <> more").select(ID, F.lit("a staple lacks an insertion that the scaffold has").alias("message")).distinct()
    st = st.join(errors.select(ID), ID, "left_anti").withColumn("y", F.explode(F.expr("sequence(coalesce(more, 0), 0)")))
    st = st.withColumn("b", F.when(F.col("i53").isNull(), -1).otherwise(F.col("i53") + F.col("y")))
    lists = st.groupBy(ID, "strand").agg(F.expr("transform(sort_array(collect_list(struct(dom, q, -y as y, b))), v -> cast(v.b as int))").alias("base_i53"), F.first("sequence").alias("sequence"))
    lists = lists.filter("exists(base_i53, v -> v >= 0)").join(letters.groupBy(ID).agg(F.count("*").cast("int").alias("n")), ID)
    lists = lists.withColumn("staple_id", (F.row_number().over(Window.partitionBy(ID).orderBy("strand")) - 1).cast("int")).withColumn("circular", F.lit(False))
    staples = lists.select(ID, "staple_id", F.coalesce(F.upper("sequence"), F.repeat(F.lit("N"), F.size("base_i53"))).alias("sequence53"), sections_of("base_i53", "n", "circular").alias("section_lengths"), "base_i53")
    missing = strands.select(ID).join(chosen, ID, "left_anti").select(ID, F.lit("no scaffold strand").alias("message"))
    ok = lambda df: df.join(errors.select(ID), ID, "left_anti")
    return ContactMap(ok(chosen.select(ID, F.lit(False).alias("circular"))), ok(letters), staples), errors.unionByName(missing)


def from_structure(topology: DataFrame, configuration: DataFrame, cutoff: float = CUTOFF, most: float = ANGLE) -> tuple[ContactMap, DataFrame, DataFrame]:
    """Maps, base pairs (design_id, a, b) and design_id, ok, from nucleotides and their positions.

    The longest strand is the scaffold. A design in which a nucleotide has two partners is not ok and has no pairs.
    Strands that pair with nothing are left out, and staples are numbered in the order of strands.
    """
    order = write_table(geo.strand_order(topology))  # read three times
    which = geo.scaffold_strand(order).withColumnRenamed("strand_id", "scaffold")
    at = order.join(which, ID).join(configuration.select(ID, "nucleotide_id", "r", F.col("b")), [ID, "nucleotide_id"])
    sc = at.filter("strand_id = scaffold")
    a = sc.select(ID, F.col("nucleotide_id").alias("a"), F.col("r").alias("ra"), F.col("b").alias("ba"))
    b = at.filter("strand_id <> scaffold").select(ID, F.col("nucleotide_id").alias("b_"), F.col("r").alias("rb"), F.col("b").alias("bb")).withColumnRenamed("b_", "b")
    pairs, ok = geo.base_pairs(a, b, cutoff, most)
    pairs = write_table(pairs)
    letters = sc.select(ID, F.col("k").cast("int").alias("i53"), F.col("base").alias("base_letter"))
    designs = sc.groupBy(ID).agg(F.first("circular").alias("circular"), F.first("n").cast("int").alias("n"))
    hit = pairs.join(sc.select(ID, F.col("nucleotide_id").alias("a"), F.col("k").cast("int").alias("i53")), [ID, "a"]).select(ID, F.col("b").alias("nucleotide_id"), "i53")
    st = order.join(which, ID).filter("strand_id <> scaffold").join(hit, [ID, "nucleotide_id"], "left")
    lists = st.groupBy(ID, "strand_id").agg(F.expr("transform(sort_array(collect_list(struct(k, coalesce(i53, -1) as i))), v -> v.i)").alias("base_i53"), F.array_join(F.expr("transform(sort_array(collect_list(struct(k, base))), v -> v.base)"), "").alias("sequence53"))
    lists = lists.filter("exists(base_i53, v -> v >= 0)").join(designs, ID).withColumn("staple_id", (F.row_number().over(Window.partitionBy(ID).orderBy("strand_id")) - 1).cast("int"))
    staples = lists.select(ID, "staple_id", "sequence53", sections_of("base_i53", "n", "circular").alias("section_lengths"), "base_i53")
    return ContactMap(designs.select(ID, "circular"), letters, staples), pairs, ok
