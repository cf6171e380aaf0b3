import gzip

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from kinfold.errors import FileMissing, UnknownGene, UnknownSpecies
from kinfold.operators import matrices
from kinfold.sources import files


def test_paths(tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "b.txt").write_text("x")
    (tmp_path / "d" / "a.txt").write_text("x")
    (tmp_path / "d" / "deep").mkdir()
    assert files.expand([str(tmp_path / "d")]) == [str(tmp_path / "d" / n) for n in ("a.txt", "b.txt")]
    with pytest.raises(FileMissing):
        files.expand([str(tmp_path / "none")])
    assert files.output_name("/x/fam.txt", None, ".dist") == "/x/fam.dist"
    assert files.output_name("/x/fam.txt", str(tmp_path / "o" / "p"), ".nhx").endswith("o/p/fam.nhx") and files.output_name("/x/a.b.txt", "s3://b/o/", ".nhx") == "s3://b/o/a.b.nhx"


def test_families_from_lines_trees_and_empty_files(spark, tmp_path):
    for name, text in {"plain": " g1\ng2\r\ng3\n", "nested": "((g1,g2),g3);", "empty": ""}.items():
        (tmp_path / f"{name}.txt").write_bytes(text.encode())
    got = {}
    for r in files.read_families(spark, [str(tmp_path)]).collect():
        got.setdefault(r.family, []).append((r.gene_idx, r.gene))
    assert sorted(got["plain"]) == [(0, "g1"), (1, "g2\r"), (2, "g3")]
    assert sorted(got["nested"]) == [(0, "g1"), (1, "g2"), (2, "g3")]
    assert got.get("empty", [(0, "")]) == [(0, "")]
    one = spark.createDataFrame([("e", "")], "family string, value string")
    assert [(r.gene_idx, r.gene) for r in files.family_lines(one).collect()] == [(0, "")]
    two = spark.createDataFrame([("e", "(a,b);(c,d);")], "family string, value string")
    with pytest.raises(PySparkException, match="more than one family"):
        files.family_lines(two).collect()


def test_database_from_annotations(spark, tmp_path):
    line = lambda c, t, s, i: f"{c}\tx\t{t}\t{s}\t{s + 5}\t.\t+\t.\tID=gene:{i};Name=n\n"
    text = "#gff\n" + line("1", "gene", 30, "c") + line("1", "gene", 10, "a") + line("1", "mRNA", 12, "no") + line("1", "gene", 20, "b")
    with gzip.open(tmp_path / "Homo.gff3.gz", "wt") as f:
        f.write(text)
    genes = files.read_annotations(spark, [str(tmp_path / "Homo.gff3.gz")])
    assert sorted((r.species, r.chr, r.pos, r.gene) for r in genes.collect()) == [("Homo", "1", 10, "a"), ("Homo", "1", 20, "b"), ("Homo", "1", 30, "c")]
    fams = spark.createDataFrame([("F", 0, "a"), ("F", 1, "c")], "family string, gene_idx int, gene string")
    book = {r.gene: r for r in files.build_database(genes, fams).collect()}
    assert book["a"].family == book["c"].family == 1 and book["b"].family < 0
    assert book["c"].left == [1, book["b"].family] and book["b"].landscape == [1, book["b"].family, 1]
    entries = files.look_up(spark.createDataFrame([tuple(r) for r in book.values()], files.build_database(genes, fams).schema), fams)
    assert entries.count() == 2
    with pytest.raises(UnknownGene):
        files.look_up(files.build_database(genes, fams), spark.createDataFrame([("F", 0, "zz")], "family string, gene_idx int, gene string"))
    tree = files.tree_frame(spark, files.read_species_tree("(Homo,Mus);"))
    assert files.with_species(entries, tree).select("species_id").distinct().count() == 1
    with pytest.raises(UnknownSpecies):
        files.with_species(entries.withColumn("species", F.lit("Canis")), tree)


GENES = [("f", 0, "g2"), ("f", 1, "g1")]
KEYS = "family string, gene_idx int, gene string"


def parse(spark, text, genes=GENES):
    rows = files.parse_matrices(spark.createDataFrame([("f", text)], "family string, value string"), spark.createDataFrame(genes, KEYS)).collect()
    return {(r.i, r.j): round(r.value, 5) for r in rows}


def test_matrix_reading(spark):
    assert parse(spark, "2\ng1\t0.0\t0.25\ng2\t0.5\t0.0\n") == {(0, 0): 0, (0, 1): 0.5, (1, 0): 0.25, (1, 1): 0}
    assert parse(spark, "2\ng1\t0.0\ng2\t0.5\t0.0\n")[1, 0] == 0  # a short row
    assert parse(spark, "3\ng1\t9\t9\t9\ng2\t0.5\t0.1\t0.2\ng1\t1\t2\t3\n")[1, 1] == 3  # the last of two rows
    for bad in ("g1\t0\t0\ng2\t0\t0\n", "3\ng1\t0\t0\ng2\t0\t0\n", "1\ng1\t0\n"):
        with pytest.raises(PySparkException):
            parse(spark, bad)


def test_matrix_writing_and_back(spark, tmp_path):
    names = spark.createDataFrame([("f", 0, "g1"), ("f", 1, "g2"), ("f", 2, "g3")], "family string, i int, name string")
    lower = spark.createDataFrame([("f", 1, 0, 0.5), ("f", 2, 0, 0.25), ("f", 2, 1, 0.75)], "family string, i int, j int, value double")
    whole = matrices.symmetric(lower, names.withColumnRenamed("i", "idx"), "family", "idx")
    lines = matrices.to_text(whole, names, "family")
    text = "\n".join(r.text for r in lines.orderBy("line").collect()) + "\n"
    assert text == "3\ng1\t0.00000\t0.50000\t0.25000\ng2\t0.50000\t0.00000\t0.75000\ng3\t0.25000\t0.75000\t0.00000\n"
    assert files.write_named(lines, str(tmp_path / "out"), ".dist") == 1
    assert (tmp_path / "out" / "f.dist").read_text() == text
    assert files.read_matrices(spark, [str(tmp_path / "out")], spark.createDataFrame([], KEYS)).count() == 0
    genes = spark.createDataFrame([("f", 0, "g3"), ("f", 1, "g1"), ("f", 2, "g2")], KEYS)
    assert {(r.i, r.j): round(r.value, 5) for r in files.read_matrices(spark, [str(tmp_path / "out")], genes).collect()}[0, 2] == 0.75


def test_three_formats_of_the_same_genes(spark, tmp_path):
    genes = [(f"c{k % 2}", 10 * k + 1, f"G{k}") for k in range(9)]
    (tmp_path / "A.gff3").write_text("##gff\n" + "".join(f"{c}\tx\tgene\t{p}\t{p + 5}\t.\t+\t.\tID=gene:{g};N=1\n" for c, p, g in genes) + "c0\tx\tgene\t?\t9\t.\t+\t.\tID=gene:bad\n")
    (tmp_path / "B.bed").write_text("browser position c0\ntrack name=x\n# note\n" + "".join(f"{c}\t{p - 1}\t{p + 5}\t{g}\r\n" for c, p, g in genes) + "c0\t7\t9\n")
    with gzip.open(tmp_path / "C.chrom.gz", "wt") as f:
        f.write("".join(f"gene:{g}\t{c}\t+\t{p}\t{p + 5}\n" for c, p, g in genes))
    got = {}
    for r in files.read_annotations(spark, files.expand([str(tmp_path)])).collect():
        got.setdefault(r.species, []).append((r.chr, r.pos, r.gene))
    assert {k: sorted(v) for k, v in got.items()} == {s: sorted(genes) for s in "ABC"}


def test_a_matrix_file_in_many_splits(spark, tmp_path):
    """Lines keep their order and numbers wherever Spark cuts the file; two files, blank lines at an end."""
    n = 300
    text = lambda f: f"{n}\n" + "".join(f"g{i}\t" + "\t".join(f"{(i * f + j) % 97 / 100:.5f}" for j in range(n)) + "\n" for i in range(n))
    (tmp_path / "a.dist").write_text(text(1) + "\n  \n")
    (tmp_path / "b.dist").write_text(text(5))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        genes = spark.createDataFrame([(f, n - 1 - i, f"g{i}") for f in "ab" for i in range(n)], KEYS)
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        got = {(r.family, n - 1 - r.i, n - 1 - r.j): r.value for r in files.read_matrices(spark, [str(tmp_path)], genes).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 2 * n * n
    assert all(abs(v - ((i * (1 if f == "a" else 5) + j) % 97) / 100) < 1e-6 for (f, i, j), v in got.items())
    (tmp_path / "b.dist").write_text(text(5).replace("g7\t", "h7\t"))
    with pytest.raises(PySparkException, match="matrix without gene g7"):
        files.read_matrices(spark, [str(tmp_path)], genes).count()


def test_named_outputs(spark, tmp_path):
    """Names with odd characters; a run that fails leaves what was there and nothing half."""
    lines = spark.createDataFrame([(f, k, f"{f} {k}") for f in ("a b", "x=y", "100%", "ü.z") for k in (2, 0, 1)], "family string, line int, text string")
    out = str(tmp_path / "o" / "p")
    assert files.write_named(lines, out, ".dist") == 4
    assert sorted(p.name for p in (tmp_path / "o" / "p").iterdir() if not p.name.startswith(".")) == sorted(f"{f}.dist" for f in ("a b", "x=y", "100%", "ü.z"))
    assert (tmp_path / "o" / "p" / "x=y.dist").read_text() == "x=y 0\nx=y 1\nx=y 2\n"
    assert sorted(r.family for r in files.written(spark, out, ".dist").collect()) == sorted(["a b", "x=y", "100%", "ü.z"])
    bad = lines.withColumn("text", F.when(F.col("family") == "ü.z", F.raise_error(F.lit("lost"))).otherwise(F.lit("new")))
    with pytest.raises(PySparkException, match="lost"):
        files.write_named(bad, out, ".dist")
    assert (tmp_path / "o" / "p" / "a b.dist").read_text() == "a b 0\na b 1\na b 2\n" and not list((tmp_path / "o" / "p").glob(".kinfold*"))
    assert files.written(spark, str(tmp_path / "none"), ".dist").count() == 0


def test_aggregates_of_nothing(spark):
    got = spark.createDataFrame([], "value double").agg(matrices.floor_max("value"), matrices.open_min("value"), matrices.mean("value")).first()
    assert got[0] == 0 and got[1] == float("inf") and got[2] != got[2]


def test_pending_and_timings(spark, tmp_path):
    todo = files.pending(spark.createDataFrame([("a",), ("b",)], "file string"), spark.createDataFrame([("a",)], "file string"), "file")
    assert [r.file for r in todo.collect()] == ["b"]
    files.write_timings(spark.createDataFrame([("a", 3, 0.5)], "file string, size int, time double"), str(tmp_path / "t"))
    assert "file,size,time" in next((tmp_path / "t").glob("*.csv")).read_text()


def test_paths_are_looked_at_once_a_file(spark, tmp_path):
    (tmp_path / "A.bed").write_text("c\t0\t5\tG\n")
    plan = files.read_annotations(spark, [str(tmp_path / "A.bed")])._jdf.queryExecution().optimizedPlan().toString()
    assert "gff3?|bed|chrom" not in plan and plan.count("gene:(?<id>.*)") == 2  # one for IDs of GFF3, one for names


def test_odd_cells_are_read_as_spark_reads_them(spark):
    """Lines of plain decimals go side by side, others by Spark's cast; a row of either kind may be short or long."""
    cells = [["0.5", "-1.25", "3", "0.00001"], ["NaN", " 1.5 ", "1e3", "1.0f"], ["x", "", "-", "--1"], ["1.2.3", "0.1", "Infinity"], ["7.5"], ["1", "2", "3", "4", "5.0", "x"]]
    n = len(cells)
    text = f"{n}\n" + "".join("\t".join([f"g{k}", *row]) + "\n" for k, row in enumerate(cells))
    flat = [(i, j, x) for i, row in enumerate(cells) for j, x in enumerate(row) if j < n]
    cast = {(r.i, r.j): r.v for r in spark.createDataFrame(flat, "i int, j int, x string").select("i", "j", F.coalesce(F.col("x").try_cast("float"), F.lit(0.0).cast("float")).alias("v")).collect()}
    lines = spark.createDataFrame([("f", k, x) for k, x in enumerate(text.rstrip("\n").split("\n"))], "family string, at int, line string")
    genes = spark.createDataFrame([("f", k, f"g{k}") for k in range(n)], KEYS)
    found = files.matrix_cells(lines, genes)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.i, r.j): repr(r.value) for r in found.collect()}
    assert got == {(i, j): repr(cast.get((i, j), 0.0)) for i in range(n) for j in range(n)}
