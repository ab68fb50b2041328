"""Binding-pocket descriptors from a table of atoms.

Atoms are rows (structure, residue_id, residue, atom, element, x, y, z), coordinates in nanometres.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Mean residue volumes in cubic angstrom (Zamyatnin 1972).
VOLUMES = {
    "ALA": 88.6, "ARG": 173.4, "ASN": 114.1, "ASP": 111.1, "CYS": 108.5, "GLN": 143.8, "GLU": 138.4, "GLY": 60.1, "HIS": 153.2, "ILE": 166.7,
    "LEU": 166.7, "LYS": 168.6, "MET": 162.9, "PHE": 189.9, "PRO": 112.7, "SER": 89.0, "THR": 116.1, "TRP": 227.8, "TYR": 193.6, "VAL": 140.0,
}
#: Hydrogen-bond donors and acceptors of side chains.
DONORS = {"ARG": 5, "ASN": 2, "GLN": 2, "HIS": 2, "LYS": 3, "SER": 1, "THR": 1, "TRP": 1, "TYR": 1}
ACCEPTORS = {"ASN": 2, "ASP": 2, "GLN": 2, "GLU": 2, "HIS": 2, "SER": 1, "THR": 1, "TYR": 1}
#: Charge at neutral pH.
CHARGES = {"ARG": 1.0, "ASP": -1.0, "GLU": -1.0, "HIS": 0.5, "LYS": 1.0}
#: Hydrophobic residues.
HYDROPHOBIC = ("ALA", "ILE", "LEU", "MET", "PHE", "PRO", "TRP", "VAL")
WATER = ("HOH", "WAT")


def of(table: dict[str, float], residue: Column) -> Column:
    """A property of a residue, 0 for those not listed."""
    found = F.lit(0.0)
    for name, value in table.items():
        found = F.when(residue == name, F.lit(float(value))).otherwise(found)
    return found


def ligands(atoms: DataFrame) -> DataFrame:
    """(structure, residue_id): of residues that are neither amino acids nor water, the one with the most heavy atoms; the least id of equals."""
    other = atoms.filter(~F.col("residue").isin(*VOLUMES, *WATER) & (F.col("element") != "H"))
    sizes = other.groupBy("structure", "residue_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("structure").orderBy(F.desc("n"), "residue_id")
    return sizes.withColumn("r", F.row_number().over(w)).filter("r = 1").select("structure", "residue_id")


def pocket(atoms: DataFrame, radius: float = 0.5) -> DataFrame:
    """(structure, residue_id, residue) of amino acids with an atom within radius of any ligand atom: an equi-join on structure and grid cells."""
    lig = atoms.join(ligands(atoms), ["structure", "residue_id"], "left_semi")
    cell = lambda a: F.floor(F.col(a) / radius)
    steps = F.transform(F.sequence(F.lit(0), F.lit(26)), lambda i: F.struct((i % 3 - 1).alias("x"), (F.floor(i / 3) % 3 - 1).alias("y"), (F.floor(i / 9) - 1).alias("z")))
    near = lig.select("structure", *(F.col(a).alias(f"l{a}") for a in "xyz"), F.explode(steps).alias("s"), *(cell(a).alias(f"_{a}") for a in "xyz"))
    near = near.select("structure", "lx", "ly", "lz", *((F.col(f"_{a}") + F.col(f"s.{a}")).alias(f"c{a}") for a in "xyz"))
    protein = atoms.filter(F.col("residue").isin(*VOLUMES)).withColumns({f"c{a}": cell(a) for a in "xyz"})
    d2 = sum((F.col(a) - F.col(f"l{a}")) * (F.col(a) - F.col(f"l{a}")) for a in "xyz")
    return protein.join(near, ["structure", "cx", "cy", "cz"]).filter(d2 <= radius * radius).select("structure", "residue_id", "residue").distinct()


def describe(residues: DataFrame) -> DataFrame:
    """Counts and sums of residue properties by structure; polarity is the share that is neither hydrophobic nor glycine."""
    r = F.col("residue")
    polar = ~r.isin(*HYDROPHOBIC) & (r != "GLY")
    return residues.groupBy("structure").agg(
        F.count("*").alias("num_residues"), F.sum(of(VOLUMES, r)).alias("volume_A3"), F.sum(of(DONORS, r)).cast("long").alias("hbond_donors"),
        F.sum(of(ACCEPTORS, r)).cast("long").alias("hbond_acceptors"), F.sum(of(CHARGES, r)).alias("net_charge"), F.avg(polar.cast("int")).alias("polarity_score"),
    )


def hydrophobic_area(residues: DataFrame, area: str) -> DataFrame:
    """Solvent-accessible area of hydrophobic residues; areas come from a provider."""
    return residues.groupBy("structure").agg(F.sum(F.when(F.col("residue").isin(*HYDROPHOBIC), F.col(area)).otherwise(0.0)).alias("hydrophobic_area"))
