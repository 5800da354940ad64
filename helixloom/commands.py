"""The commands on contact maps by their short names, as methods of a value that never changes.

Each method that edits gives a new Origami; each that reports gives a DataFrame.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import contact_map as cm
from .operators import graph, profile, schematic, solver
from .operators.contact_map import ID, ContactMap
from .operators.importers import from_scadnano, from_structure
from .session import write_table
from .sources import readers, writers


@dataclass(frozen=True)
class Origami:
    map: ContactMap

    # where maps come from
    @staticmethod
    def read(spark: SparkSession, path: str) -> Origami:
        return Origami(readers.read_contact_map(spark, path)[0])

    @staticmethod
    def star_poly_t(spark: SparkSession, path: str) -> DataFrame:
        """Lines (design_id, part, ord, line) of input files with * around runs of T in their staples; write_files writes them."""
        return readers.auto_star(readers.text_lines(spark, path))

    @staticmethod
    def from_scadnano(spark: SparkSession, path: str) -> Origami:
        return Origami(from_scadnano(readers.read_scadnano(spark, path))[0])

    @staticmethod
    def from_oxdna(spark: SparkSession, topology: str, configuration: str) -> Origami:
        return Origami(from_structure(readers.read_topology(spark, topology), readers.read_configuration(spark, configuration))[0])

    @staticmethod
    def reverse_engineer(spark: SparkSession, path: str, method: str = "full", settings: solver.Settings = solver.Settings()) -> tuple[Origami, DataFrame]:
        """Maps solved from input files, and name, staple_id, status, error of what was not placed."""
        t = readers.read_rev(spark, path)
        keys = t["designs"].select(F.col(ID).alias("name"), F.xxhash64(ID).alias("key"))
        out = solver.solve(t["designs"].join(keys, t["designs"][ID] == keys["name"]).select(F.col("key").alias(ID), "scaffold53", "circular"), t["staples"].join(keys, t["staples"][ID] == keys["name"]).select(F.col("key").alias(ID), "staple_id", "seq53"), method, settings)
        # everything below reads the solver's rows several times
        out = write_table(out.join(keys.withColumnRenamed("key", ID), ID).drop(ID).withColumnRenamed("name", ID))
        solved = t["designs"].join(out.filter("error is not null").select(ID), ID, "left_anti")
        made = cm.build(solved, out.filter("status = 'placed'").select(ID, "staple_id", "section_id", "i53", "runlen"), t["staples"])
        whole = cm.recompose(made, t["loopouts"], t["dangles"])
        return Origami(whole.materialise()), out.filter("status is null or status <> 'placed'").select(ID, "staple_id", "status", "error")

    # edits
    def delete(self, ids: list[int]) -> Origami:
        return Origami(ContactMap(self.map.designs, self.map.scaffold, self.map.staples.filter(~F.col("staple_id").isin(ids))))

    def circ(self) -> Origami:
        return Origami(cm.make_circular(self.map)[0])

    def linear(self, i3: int) -> Origami:
        return Origami(cm.make_linear(self.map, self.map.designs.select(ID, F.lit(i3).alias("i3")))[0])

    def rotate(self, offset: int, scaffold_material: str = "DNA", staple_material: str = "DNA") -> Origami:
        return Origami(cm.rotate(self.map, self.map.designs.select(ID, F.lit(offset).alias("i3")), scaffold_material, staple_material))

    def scaffold(self, sequence: str, scaffold_material: str = "DNA", staple_material: str = "DNA") -> Origami:
        return Origami(cm.change_scaffold(self.map, self.map.designs.select(ID, F.lit(sequence).alias("scaffold53_new")), scaffold_material, staple_material))

    def move(self, base: int, change: int) -> Origami:
        return Origami(graph.move_bases(self.map, self.map.designs.select(ID, F.lit(base).alias("node_id"), F.lit(change).alias("change"))))

    def rna(self) -> Origami:
        return Origami(cm.to_rna(self.map))

    def tlost(self) -> Origami:
        return Origami(cm.poly_t_lost(self.map)[0])

    def tflush(self) -> Origami:
        return Origami(cm.poly_t_all(self.map))

    def del1nt(self) -> Origami:
        return Origami(cm.delete_one_base_domains(self.map)[0])

    def rs1nt(self) -> Origami:
        return Origami(cm.remove_staples_at_one_base_domains(self.map)[0])

    def dangles(self, changes: DataFrame) -> Origami:
        return Origami(cm.add_dangles_by_sequence(self.map, changes))

    # reports
    def verify(self) -> DataFrame:
        return profile.verify(self.map)

    def stats(self) -> DataFrame:
        return profile.statistics(self.map)

    def repeats(self) -> DataFrame:
        d = cm.scaffold_sequences(self.map).join(self.map.designs, ID)
        return profile.kmer_repeats(d)

    def thermo(self) -> DataFrame:
        return cm.rotation_offsets(self.map)

    def checkstaples(self, listed: DataFrame) -> DataFrame:
        return profile.staples_match(self.map.staples.select(ID, F.upper("sequence53").alias("seq")), listed)

    def diff(self, other: Origami) -> DataFrame:
        return profile.difference(self.map, other.map)

    def equivalent(self, other: Origami) -> DataFrame:
        return profile.equivalent(self.map, other.map)

    def hamming(self, other: Origami) -> DataFrame:
        return profile.hamming(self.map, other.map)

    def matrix(self) -> DataFrame:
        return profile.pair_matrix(self.map)

    def fasta(self) -> DataFrame:
        return writers.fasta(self.map)

    def rev(self) -> DataFrame:
        return writers.rev(self.map)

    def csv(self, filename: str = "", made_by: str = "") -> DataFrame:
        return writers.contact_map_csv(self.map, filename, made_by)

    def guides(self) -> tuple[DataFrame, Origami, Origami]:
        """Status of each design, and the maps without staples at one-base domains and without the domains."""
        status, fewer, shorter = cm.guide_maps(self.map)
        return status, Origami(fewer), Origami(shorter)

    def layout(self, dim: int = 2) -> DataFrame:
        """design_id, node_id, coords: where the nodes are drawn. Ids that are not numbers are hashed on the way and named again at the end."""
        names = self.map.designs.select(F.col(ID).alias("name"), F.xxhash64(ID).alias(ID))
        at = schematic.layout(graph.edges(self.map).withColumn(ID, F.xxhash64(ID)), dim)
        return at.join(names, ID).select(F.col("name").alias(ID), "node_id", "coords")

    def schematic(self, dim: int = 2, places: DataFrame | None = None) -> DataFrame:
        """design_id, html, drawn at the places of a saved layout if they are given."""
        names = self.map.designs.select(F.col(ID).alias("name"), F.xxhash64(ID).alias(ID))
        e = write_table(graph.edges(self.map).withColumn(ID, F.xxhash64(ID)))  # nodes, limits, layout and links read it
        at = schematic.layout(e, dim) if places is None else places.withColumn(ID, F.xxhash64(ID))
        page = schematic.pages(schematic.force_graph(e, graph.nodes(e), at, graph.ambiguity(e)))
        return page.join(names, ID).select(F.col("name").alias(ID), "html")

    def tweak(self, places: DataFrame, degrees: float = 0.0, mirror_x: bool = False, mirror_y: bool = False) -> DataFrame:
        """design_id, html: a saved plane layout mirrored, then turned, and drawn again; a design without one has no row."""
        return self.schematic(places=schematic.oriented(places, degrees, mirror_x, mirror_y))
