"""The pipelines end to end on small tables."""

import pytest
from pyspark.sql import functions as F

from quartzloom.operators import structures
from quartzloom.plans import pipelines as P
from quartzloom.sources.readers import SplitConfig


@pytest.fixture(scope="module")
def raw(spark):
    rows = [(f"C{i}", f"K{i % 9}", f"T{i % 4}", "MKV" if i % 11 else "", f"Target T{i % 4}" + (" A12B" if i % 3 == 0 else ""), f"lig{i}", f">{i + 1}" if i % 2 else None, f"{i * 2 + 1},000" if i % 5 == 0 else None, None, str(i)) for i in range(120)]
    return spark.createDataFrame(rows, "`Ligand SMILES` string, inchi_key string, `UniProt (SwissProt) Primary ID of Target Chain 1` string, `BindingDB Target Chain Sequence 1` string, target_name string, `BindingDB Ligand Name` string, `Ki (nM)` string, `IC50 (nM)` string, `Kd (nM)` string, `EC50 (nM)` string")


def test_lake_and_scaffold_splits(raw):
    lake = P.ligand_lake(raw, lambda c: F.lower(c), lambda c: F.substring(c, 1, 2))
    assert lake.filter("protein_sequence = ''").count() == 0 and dict(lake.dtypes)["Ki (nM)"] == "double"
    rows, summary = P.scaffold_splits(lake, lambda c: F.lower(c), lambda c: F.substring(c, 1, 2), max_ligands=20)
    assert {r["side"] for r in rows.collect()} == {"train", "test"}
    for r in summary.collect():
        assert r["num_train"] + r["num_test"] == r["num_total_molecules"] <= 20


def test_hierarchical_splits(spark, raw):
    lake = P.ligand_lake(raw, lambda c: F.lower(c), lambda c: F.substring(c, 1, 2))
    paths = spark.createDataFrame([("T0", "1;1"), ("T1", "1;2"), ("T2", "2;3"), ("T3", "2;3")], "uniprot_id string, hierarchy_path string")
    pool = P.labelled_pool(lake, paths, 3).cache()
    assert {"k2_cluster", "k3_cluster", "is_active", "pchembl_value"} <= set(pool.columns)
    out = list(P.hierarchical_splits(pool, SplitConfig([2, 3], max_actives_per_target=3, max_test_actives_per_target=2), 3))
    assert [(level, role) for _, level, role, _ in out][:2] == [("k2", "test"), ("k2", "train")] and out[-1][1] == "train"
    test, train = ({r["uniprot_id"] for r in d.collect()} for *_, d in out[:2])
    assert test and train and not test & train


def test_mutant_pairs(spark):
    rows = [("s1", "k1", "P1", "kinase", "10"), ("s1", "k1", "P1", "kinase", "20"), ("s1", "k1", "P1", "kinase T790M", "45"), ("s2", "k2", "P1", "kinase T790M", "5"), ("s1", "k1", "P2", "x A1B", "1")]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], "smiles string, inchi_key string, uniprot_id string, target_name string, `Ki (nM)` string, `IC50 (nM)` string, `Kd (nM)` string, `EC50 (nM)` string")
    assert [r.asDict() for r in P.mutant_pairs(df).collect()] == [{"uniprot_id": "P1", "inchi_key": "k1", "mutation": "T790M", "smiles": "s1", "confers_resistance": 1, "wt_affinity_nm": 15.0, "mutant_affinity_nm": 45.0}]


def test_mutant_pairs_sql(spark):
    make = spark.createDataFrame
    out = P.mutant_pairs_sql(
        make([(2, 1)], "tid long, related_tid long"), make([(10, 7, 5.0), (11, 7, 50.0)], "assay_id long, molregno long, standard_value double"), make([(10, 1, None), (11, 2, 99)], "assay_id long, tid long, variant_id long"),
        make([(7, "KEY", "CCO")], "molregno long, standard_inchi_key string, canonical_smiles string"), make([(1, 3), (2, 3)], "tid long, component_id long"), make([(3, "MKV", "P9")], "component_id long, sequence string, accession string"), make([(99, "MRV")], "variant_id long, sequence string"),
    )
    assert [tuple(r) for r in out.collect()] == [("P9", "K2R", "CCO", 1)]
    vectors, ligands = make([("P9_K2R", [1.0])], "target_id string, vec array<double>"), make([("CCO", [2.0])], "smiles string, vec array<double>")
    assert P.training_table(out, vectors, ligands).select("protein_vec", "ligand_vec").first() == ([1.0], [2.0])


def test_meta_analysis(spark):
    runs = spark.createDataFrame([("a", True, 100, 5), ("a", False, -1, -1), ("b", True, 300, 6), ("c", False, -1, 7), (None, True, 1, 1)], "uniprot_id string, event_detected boolean, event_delay int, initial_generalization_epoch int")
    desc = spark.createDataFrame([("a", "1.0", "5"), ("a", "3.0", "5"), ("b", "8", "5"), ("c", "x", "5")], "uniprot_id string, f string, flat string")
    table, tables = P.meta_analysis(runs, desc, ["f", "flat"])
    rows = {r["uniprot_id"]: r for r in table.collect()}
    assert rows["a"]["event_frequency"] == 0.5 and rows["a"]["average_event_delay"] == 100 and rows["c"]["average_event_delay"] is None and rows["a"]["f_mean"] == 2
    assert {r["feature"] for r in tables["event_frequency"].collect()} == {"f_mean", "f_std"}


def test_run_summary(spark):
    rows = [("P1-lr0.1", i * 100, 1.0, 0.5) for i in range(120)] + [("P2-lr0.1", i * 100, 1.0, 0.9) for i in range(30)]
    out = {r["uniprot_id"]: r for r in P.run_summary(spark.createDataFrame(rows, "run string, epoch int, train double, val double"), spark.createDataFrame([("P1", 4)], "uniprot_id string, num_scaffolds int")).collect()}
    assert out["P1"]["status"] == "success" and out["P1"]["mem"] == 400 and out["P1"]["event"] == -1 and out["P1"]["num_scaffolds"] == 4
    assert out["P2"]["status"] == "too_short" and out["P2"]["mem"] is None


def test_pocket(spark):
    atoms = [("s", 1, "LEU", "CA", "C", 0.0, 0.0, 0.0), ("s", 2, "ARG", "CA", "C", 0.6, 0.0, 0.0), ("s", 3, "GLY", "CA", "C", 3.0, 0.0, 0.0), ("s", 9, "HOH", "O", "O", 0.1, 0.0, 0.0), ("s", 8, "LIG", "C1", "C", 0.3, 0.0, 0.0), ("s", 8, "LIG", "C2", "C", 0.4, 0.1, 0.0), ("s", 7, "ION", "ZN", "Zn", 3.0, 0.1, 0.0)]
    df = spark.createDataFrame(atoms, "structure string, residue_id int, residue string, atom string, element string, x double, y double, z double")
    found = structures.pocket(df)
    assert sorted(r["residue"] for r in found.collect()) == ["ARG", "LEU"]
    d = structures.describe(found).first()
    assert (d["num_residues"], round(d["volume_A3"], 1), d["hbond_donors"], d["net_charge"], d["polarity_score"]) == (2, 340.1, 5, 1.0, 0.5)
    assert structures.hydrophobic_area(found.withColumn("area", F.lit(2.0)), "area").first()["hydrophobic_area"] == 2.0


def test_genomic_variants(spark):
    cds = "ATGAAAACTGCTTATATTGCTAAATAA"  # M K T A Y I A K *
    exons = "array(named_struct('start', 200L, 'end', 220L), named_struct('start', 100L, 'end', 108L))"
    rows = [("K2T", 1), ("K2T", -1), ("A4W", 1), ("K2K", 1), ("G2A", 1), ("M99A", 1), ("bad", 1), ("Y5F", 1), ("*9K", 1)]
    df = spark.createDataFrame(rows, "mutation string, strand int").selectExpr("*", "'MKTAYIAK*' as query", f"'{cds}' as cds", "0 as offset", f"{exons} as exons")
    got = {(r["mutation"], r["strand"]): (r["reason"], r["variant"] and tuple(r["variant"])) for r in P.genomic_variants(df).collect()}
    assert got["K2T", 1] == (None, (104, "A", "C")) or got["K2T", 1] == (None, (103, "AAA", "ACT"))
    assert got["K2T", 1][1][0] - 100 == 220 - got["K2T", -1][1][0]
    assert got["A4W", 1] == (None, (200, "GCT", "TGG")) and got["Y5F", 1] == (None, (204, "A", "T"))
    assert got["K2K", 1][0] == "synonymous or no codon" and got["G2A", 1][0] == "reference differs" and got["bad", 1][0] == "not a point mutation"
    assert got["M99A", 1][1] is None and got["*9K", 1][0] == "not a point mutation"


def test_best_transcripts(spark):
    rows = [("g", "MKT", "t1", 0, 10, "ATGAAAACT"), ("g", "MKT", "t2", 0, 90, "ATGGGGACT"), ("h", "MKT", "t3", 0, 5, "GGGGGGGGG")]
    out = P.best_transcripts(spark.createDataFrame(rows, "gene string, protein string, id string, start long, end long, cds string")).collect()
    assert [(r["gene"], r["id"], r["score"]) for r in out] == [("g", "t1", 15.0)]


def test_worker_helpers(spark):
    from quartzloom.operators.distinct import grouped, missing_only, with_model

    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "k string, x int")
    f = with_model(lambda: 10, lambda m, xs: [m * x for x in xs], "long")
    assert sorted(r[0] for r in df.select(f(F.col("x"))).collect()) == [10, 20, 30, 40]
    assert missing_only(df, df.filter("x < 3"), "k").count() == 2

    def work(pdf):
        if pdf["k"].iloc[0] == "b":
            raise ValueError("no")
        return {"total": int(pdf["x"].sum())} if pdf["k"].iloc[0] == "a" else None

    assert {tuple(r) for r in grouped(df, ["k"], work, "total long").collect()} == {("a", 3, "success"), ("b", None, "error: no"), ("c", None, "empty")}
