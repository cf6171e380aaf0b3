"""Files of genomes, families, matrices and trees, as DataFrames.

Data files are read by Spark, so any store that it reaches will do; only
path lists and the species tree are read on the driver, from files of a few
kilobytes.
"""

from __future__ import annotations

import re
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.errors import FileMissing, InputError, UnknownGene, UnknownSpecies
from kinfold.functions import newick
from kinfold.operators import landscapes, tiles
from kinfold.shared import bounded, python_ready, tidy, write_counted, write_shared

SPECIES_PATTERN = r"(?P<species>.*)\.(gff3|bed|chrom)"
ID_PATTERN = r"gene:(?P<id>.*)"


def expand(paths: list[str]) -> list[str]:
    """Files, and the files directly in directories, sorted within each; a missing path raises."""
    out = []
    for p in map(Path, paths):
        if p.is_dir():
            out += sorted(str(x) for x in p.iterdir() if x.is_file())
        elif p.exists():
            out.append(str(p))
        else:
            raise FileMissing(str(p))
    return out


def output_name(source: str, out_dir: str | None, suffix: str) -> str:
    """Beside the source or in ``out_dir``, with the suffix in place of the last one."""
    folder, _, name = source.rpartition("/")
    stem_ = name.rpartition(".")[0] or name
    return f"{folder if out_dir is None else out_dir.rstrip('/')}/{stem_}{suffix}"


def pending(sources: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Sources without an output yet."""
    return sources.join(done.select(key).distinct(), key, "left_anti")


def written(spark: SparkSession, out_dir: str, suffix: str) -> DataFrame:
    """(family): families with an output of that suffix in the folder, on any store that Spark reaches."""
    fs, folder = _store(spark, out_dir)
    names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
    return spark.createDataFrame([(n.removesuffix(suffix),) for n in names if n.endswith(suffix)], "family string")


def _store(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop has them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def java_groups(pattern: str) -> str:
    """Named groups as Java writes them."""
    return pattern.replace("(?P<", "(?<")


def group_number(pattern: str, name: str) -> int:
    """A named group's number, for ``regexp_extract``."""
    found = re.compile(pattern).groupindex
    if name not in found:
        raise ValueError(f"the pattern has no group {name}")
    return found[name]


def extract(column: Column, pattern: str, name: str) -> Column:
    """What a named group matches; null without a match."""
    got = F.regexp_extract(column, java_groups(pattern), group_number(pattern, name))
    return F.when(column.rlike(java_groups(pattern)), got)


def first_match(column: Column, pattern: str, name: str) -> Column:
    """As ``extract``, but the pattern runs once."""
    return F.get(F.regexp_extract_all(column, F.lit(java_groups(pattern)), F.lit(group_number(pattern, name))), F.lit(0))


def stem(column: Column) -> Column:
    """A path's file name up to its last suffix."""
    return F.regexp_replace(F.regexp_replace(column, r".*/", ""), r"\.[^.]*$", "")


_NEWICK = r"(?s)^\(.*;$"


def family_lines(texts: DataFrame, family: str = "family", text: str = "value") -> DataFrame:
    """(family, gene_idx, gene) from whole texts: trimmed, a gene a line; or the leaf names of a Newick tree.

    An empty text is one gene with an empty name; carriage returns inside stay.
    """
    kind = texts.schema[family].dataType.simpleString()
    trimmed = texts.select(F.col(family), F.regexp_replace(text, r"^\s+|\s+$", "").alias("t"))
    plain = trimmed.where(~F.col("t").rlike(_NEWICK)).select(family, F.posexplode(F.split("t", "\n")).alias("gene_idx", "gene"))

    def from_trees(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for f, t in zip(frame[family], frame["t"]):
                trees = newick.parse(t)
                if len(trees) != 1:
                    raise InputError(str(f), "more than one family")
                out += [(f, i, n) for i, n in enumerate(newick.leaf_names(trees[0]))]
            yield pd.DataFrame(out, columns=[family, "gene_idx", "gene"])

    nested = trimmed.where(F.col("t").rlike(_NEWICK)).mapInPandas(from_trees, f"{family} {kind}, gene_idx int, gene string")
    return plain.unionByName(nested)


def read_families(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(family, gene_idx, gene): a family a file, named by its stem."""
    texts = spark.read.text(paths, wholetext=True).select(stem(F.input_file_name()).alias("family"), "value")
    return family_lines(texts)


#: Columns, from 0, of each annotation format: chromosome, start, name, and what has to be added for a start from 1.
FORMATS = {"gff3": (0, 3, 8, 0), "bed": (0, 1, 3, 1), "chrom": (1, 3, 0, 0)}


def read_annotations(spark: SparkSession, paths: list[str], id_type: str = "gene", id_pattern: str = ID_PATTERN, species_pattern: str = SPECIES_PATTERN) -> DataFrame:
    """(species, chr, pos, gene) from GFF3, BED and chrom files, plain or gzipped, in one scan.

    A file's format is the last of ``.gff3`` (``.gff``), ``.bed`` and ``.chrom`` in its path; others are
    taken as GFF3.  GFF3 rows count if their type is ``id_type``, and name a gene by the ID attribute; BED rows have
    chromosome, start from 0, end and name; chrom rows have name, chromosome, strand, start from 1 and end.  A GFF3 ID counts
    if the pattern matches; names of the other two are what it matches, or else the whole name.
    Comments, and the ``track`` and ``browser`` lines of BED, are left out, as are rows without a start or a name.
    """
    path = F.col("_metadata.file_path").alias("path")
    found, _, n = write_counted(_annotation_files(spark.read.format("binaryFile").load(paths).select(path), species_pattern), "files")
    lines = spark.read.text(paths, lineSep="\n").select(path, F.rtrim("value", F.lit("\r")).alias("value")).join(bounded(found, n), "path")
    bed, gff = F.col("kind") == "bed", F.col("kind") == "gff3"
    lines = lines.where(~F.startswith("value", F.lit("#")) & ~(bed & F.rlike("value", F.lit(r"^(?:track|browser)(?:\s|$)"))))
    rows = lines.select("species", "kind", "at", F.split("value", "\t").alias("c")).where(~gff | (F.get("c", F.lit(2)) == id_type))
    cell = lambda part: F.get("c", F.col(f"at.{part}"))
    gene = F.when(gff, first_match(F.regexp_extract(cell("name"), r"(?:^|;)ID=([^;]*)", 1), id_pattern, "id")).otherwise(F.coalesce(first_match(cell("name"), id_pattern, "id"), cell("name")))
    # A line gives one gene or none; a filter of its own would take the name apart again.
    one = F.struct("species", cell("chr").alias("chr"), (cell("pos").try_cast("bigint") + F.col("at.more")).alias("pos"), gene.alias("gene"))
    return rows.select(F.inline(F.filter(F.array(one), lambda g: g["pos"].isNotNull() & g["gene"].isNotNull() & (g["gene"] != ""))))


def _annotation_files(paths: DataFrame, species_pattern: str) -> DataFrame:
    """(path, kind, species, at): what a file's path says, once a file instead of once a line; ``at`` as in ``FORMATS``."""
    kind = F.regexp_extract("path", r"(?s).*\.(gff3?|bed|chrom)(?=[./]|$)", 1)
    name = F.regexp_replace(F.regexp_replace("path", r".*/", ""), r"\.gz$", "")
    files = paths.select("path", F.when(kind.isin("bed", "chrom"), kind).otherwise("gff3").alias("kind"), extract(name, species_pattern, "species").alias("species"))
    at = F.coalesce(*[F.when(F.col("kind") == k, F.struct(*[F.lit(x).alias(a) for a, x in zip(("chr", "pos", "name", "more"), columns)])) for k, columns in FORMATS.items()])
    return files.withColumn("at", at)


def build_database(genes: DataFrame, families: DataFrame, half: int = landscapes.HALF_WINDOW) -> DataFrame:
    """The gene book: (gene, species, chr, pos, family, left, landscape).

    Families number by their first appearance in name order, by ranges; genes of no family get
    numbers of their own below zero, so that they match nothing else.
    """
    numbers = tiles.numbered(families.select("family").where("family is not null").distinct(), [], ["family"]).select("family", (F.col("idx") + 1).cast("long").alias("number"))
    named = families.join(numbers, "family").select("gene", "number").dropDuplicates(["gene"])
    full = genes.join(named, "gene", "left").withColumn("family", F.coalesce("number", -1 - F.abs(F.xxhash64("species", "chr", "gene") % F.lit(2**62))))
    book = landscapes.windows(full.drop("number"), ["species", "chr"], ["pos", "gene"], "family", half)
    return landscapes.left_landscapes(book, ["species", "chr"], ["pos", "gene"], "family", half)


def look_up(book: DataFrame, genes: DataFrame) -> DataFrame:
    """Book entries of a family's genes; genes that the book lacks raise."""
    missing = genes.select("gene").join(book.select("gene"), "gene", "left_anti").limit(5).collect()
    if missing:
        raise UnknownGene(", ".join(r["gene"] for r in missing))
    return genes.select(F.col("family").alias("name"), "gene_idx", "gene").join(book, "gene")


def read_species_tree(text: str) -> list[newick.Node]:
    """The nodes of a species tree's text."""
    trees = newick.parse(text)
    if len(trees) != 1:
        raise InputError("species tree", "not one tree")
    return trees[0]


def tree_frame(spark: SparkSession, tree: list[newick.Node]) -> DataFrame:
    return spark.createDataFrame(newick.rows(tree), "node int, parent int, name string, depth int, is_leaf boolean")


def with_species(entries: DataFrame, tree: DataFrame) -> DataFrame:
    """Entries with ``species_id``; species that are no leaf of the tree raise."""
    tips = tree.where("is_leaf").select(F.col("name").alias("species"), F.col("node").alias("species_id"))
    missing = entries.select("species").distinct().join(tips, "species", "left_anti").limit(5).collect()
    if missing:
        raise UnknownSpecies(", ".join(str(r["species"]) for r in missing))
    return entries.join(tips, "species")


def parse_matrices(texts: DataFrame, genes: DataFrame, family: str = "family", text: str = "value") -> DataFrame:
    """``matrix_cells`` of whole texts."""
    lines = texts.select(F.col(family), F.posexplode(F.split(F.regexp_replace(text, r"\s+$", ""), "\n")).alias("at", "line"))
    return matrix_cells(lines, genes, family)


def matrix_cells(lines: DataFrame, genes: DataFrame, family: str = "family") -> DataFrame:
    """(family, i, j, value) from the lines (family, at, line) of matrix texts, ``at`` from 0, both axes in the order of ``genes`` (family, gene_idx, gene).

    A missing or wrong count line and a gene without a row raise.  Of rows with one name the last counts; short rows read as 0.  Lines stay apart: none is joined to
    another.  A row's cells are read side by side, and each then meets the number of its column.
    """
    python_ready(lines.sparkSession)
    heads = lines.where("at = 0").select(family, F.col("line").alias("n"))
    counts = lines.groupBy(family).agg((F.count("*") - 1).alias("rows")).join(heads, family, "left")
    bad = F.col("n").try_cast("int").isNull() | (F.col("n").try_cast("int") != F.col("rows"))
    checked = counts.select(family, "rows", F.when(bad, F.raise_error(F.concat(F.lit("matrix without its count line or of another size: "), F.col(family).cast("string")))).otherwise(F.lit(True)).alias("sound"))
    named = lines.where("at > 0").select(family, (F.col("at") - 1).alias("at"), F.substring_index("line", "\t", 1).alias("gene"), "line")
    order = named.groupBy(family, "gene").agg(F.max("at").alias("last"))
    ids = genes.select(family, F.col("gene_idx"), "gene")
    placed = ids.join(order, [family, "gene"], "left").join(checked, family, "left").where(F.coalesce("sound", F.lit(True)))
    placed = placed.select(family, "gene_idx", "gene", F.when(F.col("last").isNull(), F.raise_error(F.concat(F.lit("matrix without gene "), F.col("gene")))).otherwise(F.col("last")).alias("last"), "rows")
    placed, _, n = write_counted(placed, "columns")
    own = placed.select(family, F.col("last").alias("at"), F.col("gene_idx").alias("i"), F.col("rows").alias("width"))
    rows = named.join(bounded(own, n), [family, "at"]).select(F.col(family).alias("family"), "i", "width", "line")
    columns = placed.select(family, F.col("last").cast("int").alias("column_at"), F.col("gene_idx").alias("j"))
    # Cells that are not plain decimals are for Spark to read.
    cell = lambda x: F.coalesce(x.try_cast("float"), F.lit(0.0).cast("float"))
    texts = F.split("odd", "\t")
    read = F.transform(F.slice(texts, 2, F.size(texts)), cell)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    cells = rows.mapInArrow(tidy(_cells), f"family {kinds['family']}, i {kinds['i']}, `values` array<float>, odd string, width long")
    padded = F.concat(read, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(0), F.col("width") - F.size(read)).cast("int")))
    each = cells.select(F.col("family").alias(family), "i", F.posexplode(F.coalesce("values", padded)).alias("column_at", "value"))
    return each.join(bounded(columns, n), [family, "column_at"]).select(family, "i", "j", "value")


#: Bytes of plain decimals, and of what parts them.
_PLAIN = np.zeros(256, bool)
_PLAIN[list(b"0123456789.-\t")] = True


def _cells(batches):
    """(family, i, values, odd, width) of rows (family, i, width, line): a line's cells, filled up to the width, or itself where a cell is no plain decimal."""
    for batch in batches:
        family, i, width, line = batch.columns
        for start in range(0, batch.num_rows, 64):
            yield _cells_of(family.slice(start, 64), i.slice(start, 64), width.slice(start, 64).cast(pa.int64()), line.slice(start, 64))


def _cells_of(family: pa.Array, i: pa.Array, width: pa.Array, line: pa.Array) -> pa.RecordBatch:
    def batch(values: pa.Array, odd: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([family, i, values, odd, width], ["family", "i", "values", "odd", "width"])

    wide = width.to_numpy()
    cells = pc.list_slice(pc.split_pattern(line, "\t"), 1)
    count = pc.list_value_length(cells).fill_null(0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(cells)
    try:
        values = flat.cast(pa.float32()).to_numpy(zero_copy_only=False) if _plain(flat) else None
    except pa.ArrowInvalid:
        values = None
    if values is not None and not line.null_count:
        if (count >= wide).all():
            starts = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
        else:
            full, ends = np.zeros(int(np.maximum(count, wide).sum()), np.float32), np.cumsum(np.maximum(count, wide))
            starts = np.concatenate(([0], ends)).astype(np.int32)
            at = np.repeat(starts[:-1] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(len(values))
            full[at] = values
            values = full
        return batch(pa.ListArray.from_arrays(pa.array(starts), pa.array(values)), pa.nulls(len(line), pa.string()))
    if len(line) == 1:
        return batch(pa.nulls(1, pa.list_(pa.float32())), line)
    parts = [_cells_of(*(c.slice(k, 1) for c in (family, i, width, line))) for k in range(len(line))]
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _plain(flat: pa.Array) -> bool:
    """Whether the bytes of all texts are those of plain decimals."""
    if not len(flat):
        return True
    offsets = np.frombuffer(flat.buffers()[1], np.int32 if pa.types.is_string(flat.type) else np.int64)[flat.offset : flat.offset + len(flat) + 1]
    return bool(_PLAIN[np.frombuffer(flat.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]].all())


def matrix_lines(spark: SparkSession, paths: list[str], family: Column | None = None, recursive: bool = False) -> DataFrame:
    """(family, at, line) of matrix files, a family a file named by its stem (or ``family`` of the column ``path``); lines in their order.

    A file is split wherever Spark likes; lines are numbered by their block's place in the file and their order in the
    block, range by range.  White space at a file's end is left out.
    """
    raw = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(paths, lineSep="\n")
    raw = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))
    at = tiles.numbered(raw, ["path"], ["block", "n"], "at")
    at, _ = write_shared(at, "lines")
    ends = at.where(F.length(F.regexp_replace("line", r"\s+", "")) > 0).groupBy("path").agg(F.max("at").alias("end"))
    line = F.when(F.col("at") == F.col("end"), F.regexp_replace("line", r"\s+$", "")).otherwise(F.col("line"))
    return at.join(ends, "path").where("at <= end").select((stem(F.col("path")) if family is None else family).alias("family"), "at", line.alias("line"))


def read_matrices(spark: SparkSession, paths: list[str], genes: DataFrame) -> DataFrame:
    """``matrix_cells`` of files; no file is held as one text."""
    return matrix_cells(matrix_lines(spark, paths), genes)


def write_named(lines: DataFrame, out_dir: str, suffix: str, family: str = "family") -> int:
    """(family, line, text) as ``<out_dir>/<family><suffix>``, lines in order; gives the number of files.

    Tasks write into a folder beside them, where a task that is lost or run twice leaves nothing else; once all are done each
    file takes its name in one step.  So a name stands for a whole output, and a run that breaks off leaves the
    former outputs and nothing half.
    """
    spark = lines.sparkSession
    fs, folder = _store(spark, out_dir)
    stage = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out_dir.rstrip('/')}/.kinfold-{uuid.uuid4().hex[:12]}")
    unescape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    fs.mkdirs(folder)
    n = 0
    try:
        lines.select(F.col(family).cast("string").alias("family"), "line", "text").repartition("family").sortWithinPartitions("family", "line").select("family", "text").write.partitionBy("family").text(stage.toString())
        for held in fs.listStatus(stage):
            name = held.getPath().getName()
            if not name.startswith("family="):
                continue
            parts = [x.getPath() for x in fs.listStatus(held.getPath()) if x.getPath().getName().startswith("part-")]
            if len(parts) != 1:
                raise InputError(name, "written in several parts")
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, unescape(name.removeprefix("family=")) + suffix)
            if fs.exists(target):
                fs.delete(target, False)
            if not fs.rename(parts[0], target):
                raise InputError(target.toString(), "cannot take its name")
            n += 1
    finally:
        fs.delete(stage, True)
    return n


def write_timings(timings: DataFrame, path: str) -> None:
    """(file, size, time) as CSV."""
    timings.select("file", "size", "time").write.mode("overwrite").csv(path, header=True)
