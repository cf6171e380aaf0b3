import random

from kinfold import cli
from kinfold.functions import newick


def test_from_annotations_to_trees(spark, tmp_path):
    """A small genome set through all three commands; every gene ends up in its family's tree."""
    r = random.Random(4)
    species = ["Aa", "Bb", "Cc", "Dd"]
    (tmp_path / "gff").mkdir()
    (tmp_path / "fam").mkdir()
    families = {f"F{i}": [] for i in range(6)}
    for s in species:
        order = [f"F{i}" for i in range(6)] + (["F1", "F1"] if s in "AaBb" else [])
        if s == "Dd":
            order.reverse()
        lines = []
        for k, f in enumerate(order):
            gene = f"{s}{k}"
            families[f].append(gene)
            lines.append(f"1\tx\tgene\t{100 * k + 1}\t{100 * k + 50}\t.\t+\t.\tID=gene:{gene}\n")
        (tmp_path / "gff" / f"{s}.gff3").write_text("".join(lines))
    for f, genes in families.items():
        r.shuffle(genes)
        (tmp_path / "fam" / f"{f}.txt").write_text("\n".join(genes) + "\n")
    (tmp_path / "species.nwk").write_text("((Aa,Bb),(Cc,Dd));")
    book, dist, out = (str(tmp_path / n) for n in ("book", "dist", "out"))
    cli.build_database(spark, [str(tmp_path / "fam")], [str(tmp_path / "gff")], book, half=5)
    cli.align(spark, [str(tmp_path / "fam")], book, dist, half=5)
    assert sorted(p.name for p in (tmp_path / "dist").iterdir() if not p.name.startswith(".")) == [f"F{i}.dist" for i in range(6)]
    text = (tmp_path / "dist" / "F1.dist").read_text().splitlines()
    assert text[0] == str(len(families["F1"])) and len(text) == len(families["F1"]) + 1
    run = lambda **k: cli.trees(spark, [str(tmp_path / "fam")], book, str(tmp_path / "species.nwk"), dist, dist, out, half=5, merge_tandems=True, **k)
    run(stages=True, tracked=("Aa0", "Bb7"))
    notes = "".join(p.read_text() for p in (tmp_path / "out" / "_tracked").glob("*.csv"))
    assert notes.startswith("family,number,step,genes,candidate,losses,synteny,divergence,chosen")
    for f, genes in families.items():
        tree = newick.parse((tmp_path / "out" / f"{f}.nhx").read_text())[0]
        assert sorted(n for n in newick.leaf_names(tree) if n) == sorted(genes)
        assert (tmp_path / "out" / "logs" / f"{f}_vanilla.nwk").read_text()
    assert next((tmp_path / "out" / "_timings").glob("*.csv"))
    # What is there already stays, what is missing is made, and nothing else is left behind.
    (tmp_path / "out" / "F2.nhx").write_text("mine")
    (tmp_path / "out" / "F3.nhx").unlink()
    before = (tmp_path / "out" / "F1.nhx").stat().st_mtime_ns
    run(overwrite=False)
    assert (tmp_path / "out" / "F2.nhx").read_text() == "mine" and (tmp_path / "out" / "F3.nhx").read_text() and (tmp_path / "out" / "F1.nhx").stat().st_mtime_ns == before
    assert not list((tmp_path / "out").glob(".kinfold-*"))
    run(overwrite=False)
    (tmp_path / "dist" / "F0.dist").unlink()
    cli.align(spark, [str(tmp_path / "fam")], book, dist, half=5, overwrite=False)
    assert (tmp_path / "dist" / "F0.dist").read_text()
