"""The five pipelines, from files or tables to results; each is one program over DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzloom.functions import sequences as X
from quartzloom.operators import aggregates as A
from quartzloom.operators import clean as C
from quartzloom.operators import curves, filters, joins, splits
from quartzloom.operators.distinct import map_distinct

AFFINITIES = ["Ki (nM)", "IC50 (nM)", "Kd (nM)", "EC50 (nM)"]
IDS = ["uniprot_id", "UniProt (SwissProt) Primary ID of Target Chain 1"]


def ligand_lake(raw: DataFrame, canonical: Callable[[Column], Column], scaffold: Callable[[Column], Column]) -> DataFrame:
    """Raw text columns to a typed table; structures are canonicalised once for each different text, and rows without one go."""
    names = {"UniProt (SwissProt) Primary ID of Target Chain 1": "uniprot_id", "BindingDB Target Chain Sequence 1": "protein_sequence"}
    df = raw.withColumnsRenamed(names).withColumns({c: C.strip_commas(F.col(f"`{c}`")) for c in AFFINITIES if c in raw.columns})
    df = map_distinct(df, "Ligand SMILES", canonical, "canonical_smiles")
    df = map_distinct(df.filter("canonical_smiles is not null and canonical_smiles <> ''"), "canonical_smiles", scaffold, "scaffold")
    return df.filter("protein_sequence is not null and protein_sequence <> ''")


def scaffold_splits(lake: DataFrame, canonical: Callable[[Column], Column], scaffold: Callable[[Column], Column], targets: DataFrame | None = None, percentile: float = 50, test_size: float = 0.2, max_ligands: int | None = 1000) -> tuple[DataFrame, DataFrame]:
    """Rows with side, and the summary by target: least of Ki, IC50, Kd; median over repeated ligands; label below the target's percentile; cap; split by scaffold."""
    df = lake.withColumn("uniprot_id", C.coalesce_present(lake, IDS)).withColumn("activity", C.row_min(*(C.any_angle(F.col(f"`{c}`").cast("string")) for c in AFFINITIES[:3])))
    df = df.filter("uniprot_id is not null and activity is not null").select("uniprot_id", F.col("Ligand SMILES").alias("raw"), F.col("BindingDB Ligand Name").alias("ligand_name"), "activity")
    if targets is not None:
        df = filters.in_keys(df, targets, "uniprot_id")
    df = map_distinct(df, "raw", canonical, "smiles").filter("smiles is not null")
    df = df.groupBy("uniprot_id", "smiles").agg(F.median("activity").alias("activity"), F.min("ligand_name").alias("ligand_name"))
    df = C.label_by_quantile(df, "uniprot_id", "activity", percentile / 100)
    if max_ligands:
        df = splits.sample_cap(df, ["uniprot_id"], ["uniprot_id", "smiles"], max_ligands)
    out = splits.scaffold_split(map_distinct(df, "smiles", scaffold, "scaffold"), "uniprot_id", "scaffold", ["smiles"], test_size)
    summary = out.groupBy("uniprot_id").agg(F.count("*").alias("num_total_molecules"), F.count_if(F.col("side") == "train").alias("num_train"), F.count_if(F.col("side") == "test").alias("num_test"), F.countDistinct(F.when(F.col("side") != "dropped", F.col("scaffold"))).alias("num_scaffolds"))
    return out, summary


def labelled_pool(lake: DataFrame, hierarchy: DataFrame, depth: int) -> DataFrame:
    """First present affinity above 0, p-scale, label by target median, one row a target and ligand, hierarchy columns."""
    value = C.first_value(*(F.col(f"`{c}`") for c in AFFINITIES))
    df = lake.filter("uniprot_id is not null").withColumn("affinity_nM", value).filter("affinity_nM > 0").withColumn("pchembl_value", C.p_scale(F.col("affinity_nM")))
    df = C.label_by_median(df, "uniprot_id", "pchembl_value").withColumnRenamed("threshold", "activity_threshold")
    df = A.first_by(df, ["uniprot_id", "canonical_smiles"], ["affinity_nM"])
    return df.join(C.path_columns(hierarchy, "hierarchy_path", range(2, depth + 1)), "uniprot_id")


def hierarchical_splits(pool: DataFrame, config, depth: int, seed: int = 42):
    """(split, level, role, rows) for each level that is put out, sampled; and the last training set as level 'train'."""
    most = min(max(config.hierarchy_levels), depth)
    for n in range(1, config.n_stochastic_splits + 1):
        last = None
        for level in splits.culling_split(pool, "uniprot_id", list(range(2, most + 1)), set(config.hierarchy_levels), config.n_folds, seed, n):
            ids = ["uniprot_id", "canonical_smiles"]
            yield n, level.name, "test", splits.balanced_sample(level.test, "uniprot_id", "is_active", ids, config.max_test_actives_per_target, seed)
            last = splits.balanced_sample(level.train, "uniprot_id", "is_active", ids, config.max_actives_per_target, seed, "scaffold")
            yield n, level.name, "train", last
        if last is not None:
            yield n, "train", "train", last


def meta_analysis(runs: DataFrame, descriptors: DataFrame, features: list[str]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """By target: event frequency, mean delay and first generalisation, feature means and spreads; and their correlations.

    runs (uniprot_id, event_detected, event_delay, initial_generalization_epoch), descriptors (uniprot_id, features).
    """
    stats = A.mean_std(descriptors.withColumns({f: C.to_number(F.col(f).cast("string")) for f in features}), ["uniprot_id"], features)
    summary = runs.filter("uniprot_id is not null").groupBy("uniprot_id").agg(A.share_true("event_detected").alias("event_frequency"), A.without_sentinel("event_delay").alias("average_event_delay"), A.without_sentinel("initial_generalization_epoch").alias("average_initial_generalization_epoch"))
    table = summary.join(stats, "uniprot_id")
    cols = filters.varying(table, [c for c in table.columns if "_mean" in c or c.endswith("_std")])
    tables = {
        "event_frequency": A.correlations(table, "event_frequency", cols),
        "average_event_delay": A.correlations(table.filter("event_frequency > 0").dropna(subset=["average_event_delay"]), "average_event_delay", cols),
        "average_initial_generalization_epoch": A.correlations(table.dropna(subset=["average_initial_generalization_epoch"]), "average_initial_generalization_epoch", cols),
    }
    return table, tables


def run_summary(logs: DataFrame, split_summary: DataFrame | None = None, least: int = 100, **options) -> DataFrame:
    """Events of each run (run, epoch, train, val), its target, and the target's number of scaffolds where known."""
    out = curves.analyse(logs, least, **options).withColumn("uniprot_id", C.key_head(F.col("run"), "-"))
    return out if split_summary is None else out.join(split_summary.select("uniprot_id", "num_scaffolds"), "uniprot_id", "left")


def mutant_pairs(raw: DataFrame, threshold: float = 2.0) -> DataFrame:
    """(smiles, target, mutation) with the label by fold change against the wild type's median, aggregated over repeats.

    raw has smiles, inchi_key, uniprot_id, target_name and the affinity columns as text.
    """
    df = raw.dropna(subset=["inchi_key", "uniprot_id"]).withColumn("value", C.row_median(*(C.coerce(F.col(f"`{c}`")) for c in AFFINITIES))).filter("value is not null")
    wild, mutant = filters.split_by(df.withColumn("mutation", X.point_mutations(F.col("target_name"))), F.col("mutation").isNull())
    pairs = joins.mutant_wild_pairs(mutant, wild, ["uniprot_id", "inchi_key"], "value")
    pairs = pairs.withColumn("confers_resistance", C.above(C.fold_change(F.col("wt_value"), F.col("value")), threshold))
    return pairs.groupBy("uniprot_id", "inchi_key", "mutation").agg(F.min("smiles").alias("smiles"), A.mode("confers_resistance").alias("confers_resistance"), F.median("wt_value").alias("wt_affinity_nm"), F.median("value").alias("mutant_affinity_nm"))


def mutant_pairs_sql(relations: DataFrame, activities: DataFrame, assays: DataFrame, structures: DataFrame, components: DataFrame, sequences: DataFrame, variants: DataFrame, threshold: float = 2.0) -> DataFrame:
    """The same from relational tables: mutations by comparing sequences, every wild-type row paired with every mutant row."""
    chain = components.join(sequences, "component_id").select("tid", "sequence", "accession")
    wild = relations.select(F.col("tid").alias("mutant_tid"), F.col("related_tid").alias("wt_tid")).join(chain.withColumnRenamed("tid", "wt_tid"), "wt_tid").withColumnRenamed("sequence", "wt_sequence")
    mutant = relations.select(F.col("tid").alias("mutant_tid")).join(assays.withColumnRenamed("tid", "mutant_tid"), "mutant_tid").filter("variant_id is not null")
    mutant = mutant.join(variants.withColumnRenamed("sequence", "mutant_sequence"), "variant_id").select("mutant_tid", "mutant_sequence").distinct()
    both = wild.join(mutant, "mutant_tid").withColumn("mutation", X.sequence_diff(F.col("wt_sequence"), F.col("mutant_sequence"))).filter("mutation is not null")
    measured = activities.join(assays, "assay_id").join(structures, "molregno").select("tid", "standard_value", F.col("standard_inchi_key").alias("inchi_key"), F.col("canonical_smiles").alias("smiles"))
    wt = both.select("wt_tid", "mutant_tid", "accession", "mutation").join(measured.withColumnRenamed("tid", "wt_tid").drop("smiles").withColumnRenamed("standard_value", "wt_value"), "wt_tid")
    mt = measured.withColumnRenamed("tid", "mutant_tid").withColumnRenamed("standard_value", "value")
    rows = wt.join(mt, ["mutant_tid", "inchi_key"]).withColumn("confers_resistance", C.above(C.fold_change(F.col("wt_value").cast("double"), F.col("value").cast("double")), threshold))
    return rows.groupBy(F.col("accession").alias("uniprot_id"), "mutation", "smiles").agg(A.mode("confers_resistance").alias("confers_resistance"))


def training_table(rows: DataFrame, vectors: DataFrame, ligands: DataFrame) -> DataFrame:
    """Rows with both vectors, joined late by key; rows without one of them go."""
    keyed = rows.withColumn("target_id", C.composite_key(F.col("uniprot_id"), F.col("mutation")))
    return joins.lookup_all(keyed, (vectors.withColumnRenamed("vec", "protein_vec"), "target_id"), (ligands.withColumnRenamed("vec", "ligand_vec"), "smiles"))


def genomic_variants(df: DataFrame) -> DataFrame:
    """df with variant (position, reference_bases, alternate_bases) of a point mutation, or reason why there is none.

    df has mutation (X<n>Y), query (the protein that it is numbered by), cds, offset (of the alignment of query and
    translated cds), strand (1 or -1) and exons (array of struct(start, end)).
    """
    protein = X.strip_unknown(X.translate_codons(F.col("cds")))
    df = df.withColumns({"_p": X.parse_mutation(F.col("mutation")), "_t": protein})
    df = df.withColumn("_at", X.locate_context(F.col("query"), F.col("_t"), F.col("_p.pos") - 1, F.col("offset")))
    inside = (F.col("_at") >= 0) & (F.col("_at") < F.length("_t"))
    df = df.withColumn("_c", F.when(inside, X.codon_change(F.substring("cds", F.col("_at") * 3 + 1, F.lit(3)), F.col("_p.alt"))))
    place = F.col("_at") * 3 + F.col("_c.at")
    walked = F.array_sort("exons")
    walked = F.when(F.col("strand") > 0, walked).otherwise(F.reverse(walked))

    def step(acc: Column, e: Column) -> Column:
        length = (e["end"] - e["start"] + 1).cast("long")
        rest = acc["rest"]
        here = (rest >= 0) & (rest < length) & acc["position"].isNull()
        position = F.when(here, F.when(F.col("strand") > 0, e["start"] + rest).otherwise(e["end"] - rest)).otherwise(acc["position"])
        return F.struct((rest - length).alias("rest"), position.cast("long").alias("position"))

    position = F.aggregate(walked, F.struct(place.cast("long").alias("rest"), F.lit(None).cast("long").alias("position")), step, lambda acc: acc["position"])
    df = df.withColumn("_g", position)
    reason = (
        F.when(F.col("_p").isNull(), "not a point mutation")
        .when(F.col("_at").isNull(), "context not found")
        .when(~inside, "out of bounds")
        .when(F.substring("_t", F.col("_at") + 1, F.lit(1)) != F.col("_p.ref"), "reference differs")
        .when(F.col("_c").isNull(), "synonymous or no codon")
        .when(F.col("_g").isNull(), "beyond the exons")
    )
    variant = F.struct(F.col("_g").alias("position"), F.col("_c.ref").alias("reference_bases"), F.col("_c.alt").alias("alternate_bases"))
    return df.withColumn("reason", reason).withColumn("variant", F.when(F.col("reason").isNull(), variant)).drop("_p", "_t", "_at", "_c", "_g")


def best_transcripts(transcripts: DataFrame, candidates: int = 25, least: float = 0.8) -> DataFrame:
    """For each gene the transcript whose translation aligns best with the protein, if it reaches a share of the best possible score.

    transcripts (gene, protein, id, start, end, cds): the longest candidates only are aligned.
    """
    top = splits.head_per_group(transcripts, ["gene"], candidates, F.desc(F.col("end") - F.col("start")), "id")
    scored = top.withColumn("translated", X.strip_unknown(X.translate_codons(F.col("cds")))).withColumn("a", X.align_udf(F.col("protein"), F.col("translated")))
    scored = scored.withColumns({"score": F.col("a.score"), "offset": F.col("a.offset"), "candidate": F.col("id")}).drop("a")
    return joins.best_match(scored, "gene", "score", F.try_divide(F.col("score"), 5.0 * F.length("protein")), least).drop("candidate")
