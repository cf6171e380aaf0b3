"""Command line: ``build-database``, ``align`` and ``trees``, each one Spark job for all families."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.errors import InputError
from kinfold.operators import landscapes, matrices
from kinfold.plans import family_trees
from kinfold.shared import drop_shared, write_shared
from kinfold.sources import files


def build_database(spark: SparkSession, families: list[str], annotations: list[str], out: str, id_type: str = "gene", id_pattern: str = files.ID_PATTERN, species_pattern: str = files.SPECIES_PATTERN, half: int = landscapes.HALF_WINDOW) -> None:
    """The gene book as Parquet, partitioned by species."""
    genes = files.read_annotations(spark, files.expand(annotations), id_type, id_pattern, species_pattern)
    fams = files.read_families(spark, files.expand(families))
    files.build_database(genes, fams, half).write.partitionBy("species").mode("overwrite").parquet(out)


def _landscapes(spark: SparkSession, families: list[str], book: str, half: int) -> DataFrame:
    """(family, gene_idx, gene, species, chr, pos, left, landscape), landscapes cut to ``half`` neighbours."""
    genes = files.read_families(spark, families)
    entries = files.look_up(spark.read.parquet(book), genes)
    reach = F.array_size("left") - half
    cut = F.when(reach > 0, F.slice("landscape", reach + 1, F.lit(2 * half + 1))).otherwise(F.slice("landscape", F.lit(1), F.array_size("left") + half + 1))
    return entries.select(F.col("name").alias("family"), "gene_idx", "gene", "species", "chr", "pos", F.col("family").alias("number"), "left", cut.alias("landscape"))


def _open_paths(spark: SparkSession, paths: list[str], out: str, suffix: str, overwrite: bool) -> list[str]:
    """The family files to work on: all, or those without an output yet."""
    if overwrite:
        return paths
    sources = spark.createDataFrame([(p, Path(files.output_name(p, "", "")).name) for p in paths], "path string, family string")
    return sorted(r["path"] for r in files.pending(sources, files.written(spark, out, suffix), "family").collect())


def align(spark: SparkSession, families: list[str], book: str, out: str, half: int = landscapes.HALF_WINDOW, overwrite: bool = True) -> None:
    """A synteny matrix ``out/<family>.dist`` for each family."""
    paths = _open_paths(spark, files.expand(families), out, ".dist", overwrite)
    if not paths:
        return
    genes, path = write_shared(_landscapes(spark, paths, book, half), "genes")
    lower = landscapes.threaded_pairs(genes, "family", "gene_idx", "landscape").select("family", F.col("i_gene_idx").alias("i"), F.col("j_gene_idx").alias("j"), F.col("score").cast("double").alias("value"))
    whole = matrices.symmetric(lower, genes, "family", "gene_idx")
    names = genes.select("family", F.col("gene_idx").alias("i"), F.col("gene").alias("name"))
    files.write_named(matrices.to_text(whole, names, "family"), out, ".dist")
    drop_shared(spark, path)


def _matrix_folder(spark: SparkSession, folder: str, genes: DataFrame) -> DataFrame:
    """Matrices of ``folder/<family>.dist`` files."""
    return files.matrix_cells(files.matrix_lines(spark, [folder]), genes.select("family", "gene_idx", "gene"))


def trees(spark: SparkSession, families: list[str], book: str, species_tree: str, synteny: str, divergence: str, out: str, half: int = landscapes.HALF_WINDOW, merge_tandems: bool = False, from_sequence: bool = False, threshold: float | None = None, stages: bool = False, overwrite: bool = True, tracked: tuple[str, ...] = ()) -> None:
    """A tree ``out/<family>.nhx`` for each family; its steps, if asked, as ``out/logs/<family>_<step>.nwk``; the time of each family as CSV in ``out/_timings``.

    What the steps weighed for ``tracked`` genes goes to ``out/_tracked`` as CSV.
    """
    paths = _open_paths(spark, files.expand(families), out, ".nhx", overwrite)
    if not paths:
        return
    species = files.read_species_tree(Path(species_tree).read_text())
    genes = files.with_species(_landscapes(spark, paths, book, half), files.tree_frame(spark, species))
    cells = [_matrix_folder(spark, folder, genes).where("i > j").withColumnRenamed("value", name) for folder, name in ((synteny, "synteny"), (divergence, "divergence"))]
    both = cells[0].join(cells[1], ["family", "i", "j"])
    tandems = None
    if merge_tandems:
        left = F.when(F.array_size("left") > 0, F.element_at("left", -1))
        found = landscapes.tandems(genes.withColumn("before", left == F.col("number")), "family", ["species", "chr", "pos"], "gene_idx", F.when(F.col("before"), F.col("family")))
        tandems = found.select("family", "first", "rest")
    sized = genes.select("family", F.col("gene_idx").alias("idx"), F.col("gene").alias("name"), "species_id", F.array_size("landscape").alias("size"))
    rows = [(n.id, n.parent, n.name) for n in species]
    built, path = write_shared(family_trees.build_trees(sized, both, rows, tandems, from_sequence, threshold, stages, tracked), "trees")
    if tracked:
        family_trees.notes_of(built).write.mode("overwrite").csv(str(Path(out, "_tracked")), header=True)
    texts = built.select("family", "stage", F.lit(0).alias("line"), F.col("newick").alias("text"))
    files.write_named(texts.where("stage = 'final'"), out, ".nhx")
    if stages:
        files.write_named(texts.where("stage <> 'final'").withColumn("family", F.concat_ws("_", "family", "stage")), f"{out}/logs", ".nwk")
    took = built.where("stage = 'final'").select(F.col("family").alias("file"), F.col("seconds").alias("time"))
    files.write_timings(sized.groupBy(F.col("family").alias("file")).agg(F.count("*").alias("size")).join(took, "file"), str(Path(out, "_timings")))
    drop_shared(spark, path)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="kinfold", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("build-database", "align", "trees"):
        p = commands.add_parser(name)
        p.add_argument("--families", nargs="+", required=True)
        p.add_argument("--out", required=True)
        p.add_argument("--window", type=int, default=landscapes.HALF_WINDOW)
        if name == "build-database":
            p.add_argument("--gffs", nargs="+", required=True)
            p.add_argument("--id-type", default="gene")
            p.add_argument("--id-pattern", default=files.ID_PATTERN)
            p.add_argument("--species-pattern", default=files.SPECIES_PATTERN)
            continue
        p.add_argument("--database", required=True)
        p.add_argument("--no-overwrite", action="store_true")
        if name == "trees":
            p.add_argument("--species-tree", required=True)
            p.add_argument("--syntenies", required=True)
            p.add_argument("--divergences", required=True)
            p.add_argument("--merge-tandems", action="store_true")
            p.add_argument("--dups-from-sequence", action="store_true")
            p.add_argument("--synteny-threshold", type=float)
            p.add_argument("--stages", action="store_true")
            p.add_argument("--tracked", nargs="*", default=())
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("kinfold").getOrCreate()
    try:
        if a.command == "build-database":
            build_database(spark, a.families, a.gffs, a.out, a.id_type, a.id_pattern, a.species_pattern, a.window)
        elif a.command == "align":
            align(spark, a.families, a.database, a.out, a.window, not a.no_overwrite)
        else:
            trees(spark, a.families, a.database, a.species_tree, a.syntenies, a.divergences, a.out, a.window, a.merge_tandems, a.dups_from_sequence, a.synteny_threshold, a.stages, not a.no_overwrite, tuple(a.tracked))
    except InputError as e:
        raise SystemExit(str(e)) from e


if __name__ == "__main__":
    main()
