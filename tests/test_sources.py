"""Readers and writers: the same alignment in three formats, side tables, structures, streams."""

import gzip

import pytest
from pyspark.sql import functions as F

from covarium import catalogue
from covarium.sources import fasta_source, readers, writers
from covarium.streaming import incremental
from tests.conftest import TOY


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


FASTA = "".join(f">s{i}|x>y\n{s[:5].lower()}\n{s[5:]}\n\n" for i, s in enumerate(TOY))
CLUSTAL = "CLUSTAL W\n\n" + "\n".join(f"s{i} {s[:4]}" for i, s in enumerate(TOY)) + "\n   *:. \n\n" + "\n".join(f"s{i} {s[4:].replace('-', '.')}" for i, s in enumerate(TOY)) + "\n"
STOCKHOLM = "# STOCKHOLM 1.0\n#=GF ID x\n" + "\n".join(f"s{i}  {s.lower()}" for i, s in enumerate(TOY)) + "\n//\nafter AAAA\n"


@pytest.mark.parametrize("text,name", [(FASTA, "fasta"), (CLUSTAL, "clustal"), (STOCKHOLM, "stockholm")])
def test_formats(spark, tmp_path, text, name):
    path = tmp_path / "toy.txt"
    path.write_text(text)
    assert readers.detect_format(spark, str(path)) == name
    got = rows(readers.read_alignment(spark, str(path)), "seq_id")
    assert [(i, s) for i, _, s in got] == list(enumerate(TOY))
    assert got[0][1] == ("s0|x>y" if name == "fasta" else "s0")


def test_gzip_and_data_source(spark, tmp_path):
    path = tmp_path / "toy.fasta.gz"
    with gzip.open(path, "wt") as f:
        f.write(FASTA)
    assert readers.read_fasta(spark, str(path)).count() == 6
    fasta_source.register(spark)
    assert [r[2] for r in rows(spark.read.format("fasta").load(str(path)), "seq_id")] == TOY


def test_empty_record_raises(spark, tmp_path):
    path = tmp_path / "bad.fasta"
    path.write_text(">a\nACD\n>b\n>c\nACD\n")
    with pytest.raises(Exception, match="no sequence"):
        readers.read_fasta(spark, str(path)).collect()


def test_round_trip(spark, toy, tmp_path):
    writers.write_fasta(toy, str(tmp_path / "out"))
    assert [r[2] for r in rows(readers.read_fasta(spark, str(tmp_path / "out")), "seq_id")] == TOY
    writers.write_fasta(toy, str(tmp_path / "raw"), ungapped=True, files=1)
    assert "-" not in "".join(r[2] for r in rows(readers.read_fasta(spark, str(tmp_path / "raw")), "seq_id"))
    writers.write_results({"alignment": toy}, str(tmp_path / "db"))
    assert readers.read_results(spark, str(tmp_path / "db"), ["alignment"])["alignment"].count() == 6


def test_side_tables(spark, tmp_path):
    (tmp_path / "w.tsv").write_text("a\t2\nbad line\nb\tx\nc\t1.5\na\t3\n")
    assert rows(readers.read_weights(spark, str(tmp_path / "w.tsv")), "id") == [("a", 3.0), ("c", 1.5)]
    (tmp_path / "keep.txt").write_text("3, 1 # 9\nx 3\n")
    assert rows(readers.read_keep(spark, str(tmp_path / "keep.txt"), 6), "i") == [(0,), (2,)]
    with pytest.raises(ValueError):
        readers.read_keep(spark, str(tmp_path / "keep.txt"), 2)
    (tmp_path / "labels.txt").write_text("16\n\n17A\n")
    assert rows(readers.read_position_labels(spark, str(tmp_path / "labels.txt")), "pos") == [(0, "16"), (1, "17A")]
    (tmp_path / "pfam.txt").write_text("\t".join(["ACC1", "ID1", "x", "x", "x", "descr", "x", "x", "sp", "t1; t2"]) + "\n")
    assert rows(readers.read_annotations(spark, str(tmp_path / "pfam.txt")), "id") == [("ACC1", "ID1", "descr", "sp", "t1; t2")]


def test_structure(spark, tmp_path):
    atom = "ATOM  {:>5} {:<4} {:>3} {}{:>4}{}   {:8.3f}{:8.3f}{:8.3f}\n"
    text = atom.format(1, "CA", "ALA", "A", 16, " ", 0, 0, 0) + atom.format(2, "CB", "ALA", "A", 16, " ", 1, 0, 0) + atom.format(3, "CA", "MSE", "A", 16, "A", 4, 0, 0) + atom.format(4, "CA", "GLY", "B", 1, " ", 9, 9, 9) + "ENDMDL\n" + atom.format(5, "CA", "TRP", "A", 90, " ", 0, 0, 0)
    (tmp_path / "x.pdb").write_text(text)
    residues, atoms = readers.read_structure(spark, str(tmp_path / "x.pdb"))
    assert rows(residues.select("idx", "label", "aa"), "idx") == [(0, "16", "A"), (1, "16A", "X")]
    d = {(a, b): x for a, b, x in rows(readers.residue_distances(residues, atoms), "a", "b")}
    assert d == {("16", "16"): 0.0, ("16", "16A"): 3.0, ("16A", "16"): 3.0, ("16A", "16A"): 0.0}


def test_structure_of_many_residues(spark, tmp_path):
    """Residue numbers of more than four digits, from vec_id as the registered queries write them."""
    ids = [-7, 0, 9_999, 10_000, 10_255, 46_655, 102_564, 615_384, 1_223_055, 1_223_056, 2_436_111]
    fields = [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(ids)], "k long, v long").orderBy("k").select(writers.residue_field(F.col("v"))).collect()]
    assert fields[2:4] == ["9999", "A000"] and fields[-3:] == ["ZZZZ", "a000", "zzzz"] and {len(f) for f in fields} == {4}
    vectors = [(v, [float(v % 7), 1.0, 2.0, float(v % 7), 4.0, 5.0, 6.0], 2) for v in ids[1:]]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert [r[0] for r in rows(catalogue.structure_residues(spark, str(tmp_path)).select("label", "idx"), "idx")] == [str(v) for v in ids[1:]]
    found = {(r["a"], r["b"]) for r in catalogue.structure_contacts(spark, str(tmp_path)).collect()}
    assert found == {(str(v), str(w)) for v in ids[1:] for w in ids[1:] if v % 7 == w % 7}
    with pytest.raises(Exception, match="no residue number"):
        spark.createDataFrame([(2_436_112,)], "v long").select(writers.residue_field(F.col("v"))).collect()


def test_network_and_script(spark):
    c = spark.createDataFrame([(0, 1, 2.0), (0, 2, 0.5), (1, 2, 0.1)], "i int, j int, c double")
    labels = spark.createDataFrame([(0, "10"), (1, "11"), (2, "12")], "pos int, label string")
    assert rows(writers.network_edges(c, labels, 1.0), "value") == [("10 aa 11",), ("11",), ("12",)]
    assert rows(writers.network_edge_attributes(c, labels), "value")[0] == ("10 (aa) 11 = 2.0000",)
    named = spark.createDataFrame([(0, 0, "10"), (0, 1, "11"), (1, 0, "12")], "k int, rank int, label string")
    script = [r[1] for r in rows(writers.structure_script(named), "line")]
    assert script == ["select sector1, chain A and resi 10+11", "color 0xff0000, sector1", "show sticks, sector1", "select sector2, chain A and resi 12", "color 0x00ffff, sector2", "show sticks, sector2"]
    modes = spark.createDataFrame([(p, k, 0.1 * p) for p in range(3) for k in range(3)], "pos int, k int, v double")
    di = spark.createDataFrame([(p, 1.0) for p in range(3)], "pos int, di double")
    nodes = writers.network_nodes(labels, di, spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "pos int, k int"), modes)
    assert rows(nodes.select("label", "sector"), "label") == [("10", 2), ("11", 2), ("12", 0)]


def test_stream_equals_batch(spark, toy, tmp_path):
    folder = str(tmp_path / "in")
    toy.repartition(3).write.parquet(folder)
    stream = incremental.running_counts(spark.readStream.schema("seq_id long, hd string, seq string").option("maxFilesPerTrigger", 1).parquet(folder))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("counts"), "pos", "code") == rows(incremental.running_counts(toy), "pos", "code")
    f = incremental.frequencies(spark.table("counts"))
    assert f.where((F.col("pos") == 1) & (F.col("code") == 2)).first()["f"] == 1.0
