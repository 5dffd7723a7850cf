"""Fingerprints of molecules by joins of their atoms and bonds.

Atoms and bonds are rows. Neighbourhoods grow by one bond in each join, and so do paths; what is found is
hashed, and a molecule's hashes are folded into a vector of bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scarp.functions.molecules import molecules
from scarp.sources.shared import written

#: Fixed value: bonds of the longest path.
LONGEST_PATH = 7
#: Bonds up to which two atoms form a pair.
FAR = 30


class Structures:
    """The atoms (pos, atom, code, plain) and bonds (pos, atom, other, order; both ways) of compounds (pos, structure).

    code is a hash of an atom's kind, charge, isotope, hydrogens and number of bonds, plain one of its kind alone. Structures that
    cannot be read have no rows. read: pos and key of the others.
    """

    def __init__(self, compounds: DataFrame, chirality: bool = False):
        found = written(molecules(compounds).filter("molecule IS NOT NULL"))
        self.read = found.select("pos", "key")
        bonds = found.select("pos", F.explode("molecule.bonds").alias("x")).select("pos", "x.*")
        self.bonds = bonds.selectExpr("pos", "a AS atom", "b AS other", "order").unionByName(bonds.selectExpr("pos", "b AS atom", "a AS other", "order"))
        atoms = found.select("pos", F.posexplode("molecule.atoms").alias("atom", "x")).select("pos", "atom", "x.*")
        degree = self.bonds.groupBy("pos", "atom").agg(F.count("*").alias("degree"))
        chiral = F.col("chiral") if chirality else F.lit("")
        atoms = atoms.join(degree, ["pos", "atom"], "left").fillna(0, ["degree"])
        self.atoms = atoms.select("pos", "atom", F.xxhash64("symbol", "aromatic", "charge", "isotope", "hydrogens", "degree", chiral).alias("code"), F.xxhash64("symbol", "aromatic").alias("plain"))

    def circular(self, radius: int = 2) -> DataFrame:
        """pos, hash: of the neighbourhood of each atom up to each radius; in every round the hash of an atom that has bonds takes in its neighbours'."""
        now = self.atoms.select("pos", "atom", F.col("code").alias("hash"))
        found = now
        for r in range(1, radius + 1):
            beside = self.bonds.join(now.withColumnRenamed("atom", "other"), ["pos", "other"])
            around = beside.groupBy("pos", "atom").agg(F.array_sort(F.collect_list(F.struct("order", "hash"))).alias("near"))  # an atom's bonds
            now = now.join(around, ["pos", "atom"]).select("pos", "atom", F.xxhash64(F.lit(r), "hash", F.to_json("near")).alias("hash"))
            found = found.unionByName(now)
        return found.select("pos", "hash")

    def _paths(self, bonds: int, code: str):
        """Paths of one bond, two and so on: pos, atoms, codes (of atoms and bonds in turn), last."""
        ends = self.atoms.select("pos", F.col("atom").alias("other"), F.col(code).alias("next"))
        steps = self.bonds.join(ends, ["pos", "other"])
        start = self.atoms.select("pos", F.col("atom").alias("last"), F.array("atom").alias("atoms"), F.array(code).alias("codes"))
        for _ in range(bonds):
            grown = start.join(steps.withColumnRenamed("atom", "last"), ["pos", "last"]).filter(~F.array_contains("atoms", F.col("other")))
            start = grown.select("pos", F.col("other").alias("last"), F.concat("atoms", F.array("other")).alias("atoms"), F.concat("codes", F.array(F.col("order").cast("long"), F.col("next"))).alias("codes"))
            yield start

    @staticmethod
    def _either_way(codes: Column) -> Column:
        return F.xxhash64(F.least(codes, F.reverse(codes)).cast("string"))

    def paths(self, longest: int = LONGEST_PATH) -> DataFrame:
        """pos, hash: of each path of 1 to `longest` bonds that meets no atom twice, read either way."""
        found = None
        for p in self._paths(longest, "plain"):
            own = p.select("pos", self._either_way(F.col("codes")).alias("hash")).distinct()
            found = own if found is None else found.unionByName(own)
        return found

    def torsions(self) -> DataFrame:
        """pos, hash: of each path of four atoms, by their codes."""
        *_, four = self._paths(3, "code")
        return four.select("pos", self._either_way(F.filter("codes", lambda x, i: i % 2 == 0)).alias("hash"))

    def atom_pairs(self, far: int = FAR) -> DataFrame:
        """pos, hash: of each two atoms by their codes and the number of bonds between them, up to `far`.

        Each round takes the pairs one bond further.
        """
        last = self.atoms.select("pos", F.col("atom").alias("one"), F.col("atom"))
        before, found = last.limit(0), None
        for d in range(1, far + 1):
            further = last.join(self.bonds, ["pos", "atom"]).select("pos", "one", F.col("other").alias("atom")).distinct()
            # beside the atoms at one distance are those one bond nearer, as far and one bond further
            met = last.unionByName(before)
            edge = written(further.join(met, ["pos", "one", "atom"], "left_anti"))
            if edge.isEmpty():
                break
            own = edge.withColumn("d", F.lit(d))
            found = own if found is None else found.unionByName(own)
            before, last = last, edge
        if found is None:
            return self.atoms.limit(0).select("pos", F.col("code").alias("hash"))
        one, two = (self.atoms.select("pos", F.col("atom").alias(x), F.col("code").alias(c)) for x, c in (("one", "c1"), ("atom", "c2")))
        both = found.join(one, ["pos", "one"]).join(two, ["pos", "atom"])
        return both.select("pos", F.xxhash64(F.least("c1", "c2"), F.greatest("c1", "c2"), "d").alias("hash"))


#: name -> the hashes of some structures.
FINGERPRINTS = {
    "circular": lambda s, radius=2, **_: s.circular(radius), "path": lambda s, **_: s.paths(), "torsion": lambda s, **_: s.torsions(), "atom_pair_bits": lambda s, **_: s.atom_pairs(),
}


def bits(hashes: DataFrame, read: DataFrame, n_bits: int = 1024) -> DataFrame:
    """pos, embedding: 1.0 where a hash of the compound falls, for all compounds that could be read."""
    on = hashes.select("pos", F.pmod("hash", F.lit(n_bits)).cast("int").alias("bit")).groupBy("pos").agg(F.collect_set("bit").alias("on"))  # n_bits at most
    places = F.sequence(F.lit(0), F.lit(n_bits - 1))
    return read.select("pos").join(on, "pos", "left").select("pos", F.transform(places, lambda i: F.coalesce(F.array_contains("on", i), F.lit(False)).cast("double")).alias("embedding"))


def fingerprint(compounds: DataFrame, kind: str, n_bits: int = 1024, radius: int = 2, chirality: bool = False) -> DataFrame:
    """compounds (pos, structure) with embedding; those whose structure cannot be read are left out. kind: circular, path, torsion or atom_pair_bits."""
    if kind not in FINGERPRINTS:
        raise ValueError(f"unknown fingerprint {kind!r}; known: {', '.join(FINGERPRINTS)}")
    s = Structures(compounds, chirality)
    return compounds.join(bits(FINGERPRINTS[kind](s, radius=radius), s.read, n_bits), "pos")


def with_key(compounds: DataFrame) -> DataFrame:
    """compounds (pos, structure) with compound_id, the key of the molecule; those whose structure cannot be read are left out."""
    return compounds.drop("compound_id").join(molecules(compounds).filter("key IS NOT NULL").select("pos", F.col("key").alias("compound_id")), "pos")
