import gzip
import os

import pytest
from pyspark.sql import functions as F

from loomframe.sources import readers, sinks


@pytest.fixture
def bundle(spark):
    counts = spark.createDataFrame([("c1", "g1", 3.0), ("c1", "g2", 1.0), ("c2", "g2", 5.0)], "cell_id string, gene_id string, count double")
    cells = spark.createDataFrame([("c1", "T"), ("c2", "B"), ("c3", "B")], "cell_id string, kind string")
    genes = spark.createDataFrame([("g1", "MT-A"), ("g2", "B2"), ("g3", "C3")], "gene_id string, gene_name string")
    return counts, cells, genes


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_parquet_and_matrix_round_trips(spark, bundle, tmp_path):
    counts, cells, genes = bundle
    sinks.write_bundle(f"{tmp_path}/b", counts, cells, genes)
    back = readers.read_bundle(spark, f"{tmp_path}/b")
    assert rows(back["counts"]) == rows(counts) and rows(back["cells"]) == rows(cells)
    sinks.write_mtx(counts, cells, genes, f"{tmp_path}/m")
    got = readers.read_mtx(spark, f"{tmp_path}/m")
    assert rows(got.select("cell_id", "gene_id", "count")) == rows(counts)
    sinks.zip_bundle(f"{tmp_path}/m", f"{tmp_path}/m.zip")
    assert os.path.getsize(f"{tmp_path}/m.zip") > 100
    sinks.write_mtx(counts, cells, genes, f"{tmp_path}/s", fraction=0.5, seed=1)


def test_compressed_matrix_with_two_modalities(spark, tmp_path):
    for name, text in (("matrix.mtx", "%%MatrixMarket\n%x\n2 2 3\n1 1 4\n2 1 7\n2 2 2\n"), ("barcodes.tsv", "AAA\nCCC\n"), ("features.tsv", "g1\tA\tGene Expression\ng2\tB\tAntibody Capture\n")):
        with gzip.open(tmp_path / f"{name}.gz", "wt") as f:
            f.write(text)
    assert rows(readers.read_mtx(spark, str(tmp_path)).select("cell_id", "gene_id", "count")) == [("AAA", "g1", 4.0)]
    assert readers.read_mtx(spark, str(tmp_path), None).count() == 3


def test_text_tables(spark, bundle, tmp_path):
    _, cells, _ = bundle
    sinks.write_csv(cells, f"{tmp_path}/c")
    sinks.write_tsv(cells, f"{tmp_path}/t")
    sinks.write_list(cells, "cell_id", f"{tmp_path}/l")
    assert rows(readers.read_table(spark, f"{tmp_path}/c")) == rows(readers.read_table(spark, f"{tmp_path}/t", sep="\t")) == rows(cells)
    assert rows(readers.read_first_column(spark, f"{tmp_path}/c")) == [("c1",), ("c2",), ("c3",)]
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/l").collect()) == ["c1", "c2", "c3"]
    (tmp_path / "wide.tsv").write_text("x\tA\tB\nc1\t0.5\tbad\nc2\t\t1\n")
    assert rows(readers.read_wide(spark, f"{tmp_path}/wide.tsv")) == [("c1", "A", 0.5), ("c1", "B", 0.0), ("c2", "A", 0.0), ("c2", "B", 1.0)]


def test_runs_and_folders(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"run{k}.csv").write_text(f",loss\n0,{k}.5\n1,{k}.25\n")
    got = readers.read_runs(spark, f"{tmp_path}/run*.csv")
    assert sorted((r.params, r.epoch) for r in got.collect()) == [("run1", "0"), ("run1", "1"), ("run2", "0"), ("run2", "1")]
    with pytest.raises(FileNotFoundError):
        readers.read_runs(spark, f"{tmp_path}/none*.csv")
    with pytest.raises(ValueError):
        readers.with_epoch(spark.createDataFrame([(1,)], "x int"))
    for name in ("trial_a", "trial_b", "other"):
        (tmp_path / name).mkdir()
    os.utime(tmp_path / "trial_a", (2e9, 2e9))
    assert readers.newest(spark, str(tmp_path), "trial_").endswith("trial_a")
    found = readers.list_files(spark, str(tmp_path), r"run\d\.csv")
    assert [r.sample_id for r in found.collect()] == ["run1", "run2"]


def test_guard_and_errors(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    path = f"{tmp_path}/x"
    assert readers.load_or_create(spark, path, make).count() == readers.load_or_create(spark, path, make).count() == 3
    assert len(made) == 1
    df = spark.createDataFrame([("a.h5",), ("b.h5ad",)], "p string").select(readers.platform_of(F.col("p")))
    assert [r[0] for r in df.collect()] == ["10X_Chromium", "Parse"]
    with pytest.raises(Exception, match="unknown suffix"):
        spark.createDataFrame([("a.txt",)], "p string").select(readers.platform_of(F.col("p"))).collect()


def test_reports_and_json(spark, tmp_path):
    df = spark.createDataFrame([(float(i), float(2 * i)) for i in range(101)], "o double, r double")
    report = sinks.quantile_report(df, "x", "o", "r")
    sinks.append_report(report, f"{tmp_path}/q")
    sinks.append_report(report, f"{tmp_path}/q")
    assert readers.read_table(spark, f"{tmp_path}/q", sep="\t").count() == 18
    assert [r.observed for r in report.filter("q = 0.25").collect()] == [25.0]
    j = spark.createDataFrame([("a", float("nan")), ("b", None), ("c", 1.5)], "id string, score double").select(sinks.summary_json(["id", "score"]).alias("j"))
    assert [r.j for r in j.collect()] == ['{"id":"a","score":null}', '{"id":"b","score":null}', '{"id":"c","score":1.5}']


def test_mtx_numbers_and_copies(spark, tmp_path):
    """Places of the axes over several partitions, an entry that looks like the header, and copies of what is missing."""
    cells = spark.range(300).selectExpr("format_string('c%03d', id) AS cell_id").repartition(5)
    got = sinks.numbered(cells, "cell_id").collect()
    assert sorted((r._at, r.cell_id) for r in got) == [(i + 1, f"c{i:03d}") for i in range(300)]
    assert sinks.numbered(cells.limit(0), "cell_id").count() == 0
    folder = tmp_path / "m"
    folder.mkdir()
    (folder / "matrix.mtx").write_text("%%MatrixMarket\n2 3 4\n1 1 5\n2 3 4\n2 2 1\n1 3 2\n")
    (folder / "features.tsv").write_text("g1\tA\tGene Expression\ng2\tB\tGene Expression\n")
    (folder / "barcodes.tsv").write_text("x\ny\nz\n")
    got = readers.read_mtx(spark, str(folder)).collect()
    assert sorted((r.cell_id, r.gene_id, r["count"]) for r in got) == [("x", "g1", 5.0), ("y", "g2", 1.0), ("z", "g1", 2.0), ("z", "g2", 4.0)]
    for name in ("s1", "s2", "s3"):
        (tmp_path / "src" / name).mkdir(parents=True)
        (tmp_path / "src" / name / "f.txt").write_text(name)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "sample_id string")
    assert readers.copy_missing(spark, ids("s1", "s2", "s9"), ids("s2"), f"file://{tmp_path}/src", f"file://{tmp_path}/dst") == ["s1"]
    assert (tmp_path / "dst" / "s1" / "f.txt").read_text() == "s1"


def test_pairs(spark, tmp_path):
    (tmp_path / "db.csv").write_text("ligand,receptor,pathway_name\nTgfb1,Tgfbr1_Tgfbr2,TGF\nwnt1,FZD1,WNT\n,X,Y\n")
    got = readers.read_pairs(spark, f"{tmp_path}/db.csv").collect()
    assert sorted(map(tuple, got)) == [("TGFB1", "TGFBR1", "TGF"), ("TGFB1", "TGFBR2", "TGF"), ("WNT1", "FZD1", "WNT")]
