"""The FASTA data source: ranges of bytes, patterns, streams of growing files."""

import gzip
import random

import pytest

from covarium.sources import fasta_source, readers


@pytest.fixture(scope="module")
def records():
    rng = random.Random(1)
    return [(f"r{k}|a>b {k}", "".join(rng.choice("ACDEFG-") for _ in range(rng.randrange(1, 90)))) for k in range(200)]


def text(records, width=17, end="\n"):
    out = []
    for hd, seq in records:
        out += [f">{hd}"] + [seq[k : k + width].lower() for k in range(0, len(seq), width)]
    return end.join(out) + end


@pytest.mark.parametrize("split", [1, 7, 64, 1_000, 1 << 20])
def test_every_record_is_in_one_range(spark, tmp_path, records, split):
    fasta_source.register(spark)
    some = records[:60] if split < 8 else records
    (tmp_path / "a.fasta").write_text(text(some))
    parts = fasta_source.FastaReader({"path": str(tmp_path / "a.fasta"), "splitBytes": str(split)}).partitions()
    assert len(parts) == -(-(tmp_path / "a.fasta").stat().st_size // split)
    found = [r for p in parts for r in fasta_source._rows(p)]
    assert [r[1:] for r in found] == some and [r[0] for r in found] == sorted(r[0] for r in found)


def test_folders_patterns_gzip_and_uris(spark, tmp_path, records):
    fasta_source.register(spark)
    (tmp_path / "b.fasta").write_text(text(records[:50], end="\r\n"))
    with gzip.open(tmp_path / "a.fasta.gz", "wt") as f:
        f.write("\n" + text(records[50:]))
    (tmp_path / "_SUCCESS").write_text("")
    load = lambda path: [tuple(r)[1:] for r in spark.read.format("fasta").option("splitBytes", 500).load(path).orderBy("seq_id").collect()]
    assert load(str(tmp_path)) == load(f"file://{tmp_path}") == records[50:] + records[:50]
    assert load(f"{tmp_path}/*.fasta") == records[:50]
    with pytest.raises(Exception, match="nowhere"):
        load(str(tmp_path / "nowhere"))
    assert sorted((r["hd"], r["seq"]) for r in readers.read_fasta(spark, f"{tmp_path}/b.fasta").collect()) == sorted(records[:50])


def test_stream_of_growing_files(spark, tmp_path, records):
    fasta_source.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.fasta").write_text(text(records[:30]))
    query = spark.readStream.format("fasta").option("splitBytes", 300).load(str(folder)).writeStream.format("memory").queryName("fasta_rows").option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        query.processAllAvailable()
        with open(folder / "a.fasta", "a") as f:
            f.write(text(records[30:45]))
        (folder / "b.fasta").write_text(text(records[45:60]))
        query.processAllAvailable()
    finally:
        query.stop()
    got = spark.sql("SELECT seq_id, hd, seq FROM fasta_rows").collect()
    assert sorted((r["hd"], r["seq"]) for r in got) == sorted(records[:60]) and len({r["seq_id"] for r in got}) == 60
