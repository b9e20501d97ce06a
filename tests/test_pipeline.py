import random

from pyspark.sql import functions as F

from lociflow.operators import graph as G
from lociflow.plans import pipeline
from lociflow.streaming.lines import reject_counts, split_stream


def test_from_files_to_report(spark, tmp_path):
    rng = random.Random(1)
    people = [(f"S{i:02d}", i % 2) for i in range(40)]
    sites = [(p, f"G{p}", p % 2) for p in range(1, 13)]
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(s for s, _ in people)
    lines = ["##fileformat=VCFv4.2", head]
    for pos, gene, side in sites:
        calls = ["0/1" if (side == g) == (rng.random() < 0.9) else "0/0" for _, g in people]
        lines.append(f"chr1\t{pos}\t.\tA\tC\t60\tPASS\tGENE={gene};CONSEQUENCE=frameshift_variant\tGT\t" + "\t".join(calls))
    (tmp_path / "v.vcf").write_text("\n".join(lines) + "\n")
    (tmp_path / "p.gmt").write_text("\n".join("\t".join([f"P{s}{h}", "d", *(g for p, g, x in sites if x == s and p % 3 != h)]) for s in (0, 1) for h in (0, 1)) + "\n")
    (tmp_path / "s.csv").write_text("sample_id,planted_subtype\n" + "".join(f"{s},t{g}\n" for s, g in people))
    (tmp_path / "c.yaml").write_text(f"variants: {tmp_path}/v.vcf\npathways: {tmp_path}/p.gmt\nphenotypes: {tmp_path}/s.csv\noutput: {tmp_path}/out\nmax_k: 2\nbootstraps: 1\n")
    report = pipeline.run(spark, pipeline.Config.from_yaml(str(tmp_path / "c.yaml")))
    assert report["samples"] == 40 and report["pathways"] == 4 and report["ari_planted"] > 0.7
    assert (tmp_path / "out/report.md").read_text().startswith("# Subtypes")


def test_components_against_brute_force(spark):
    rng = random.Random(2)
    ids = [f"n{i}" for i in range(120)]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(90)] + [(f"c{i}", f"c{i + 1}") for i in range(60)]
    ids += [f"c{i}" for i in range(61)]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    nodes = spark.createDataFrame([(i, "x") for i in ids], "node_id string, node_type string")
    edges = spark.createDataFrame([(a, b, "x", 1.0) for a, b in pairs], "src string, dst string, edge_type string, weight double")
    assert {r.node_id: r.component for r in G.components(nodes, edges).collect()} == {i: find(i) for i in ids}
    idx = sorted(r.idx for r in G.node_index(nodes).collect())
    assert idx == list(range(len(ids)))


def test_streamed_lines(spark, tmp_path):
    rows = [(1, "constraint", "a\tb\t0.5\t1\t1\t1\tn"), (2, "constraint", "a\tb"), (3, "constraint", "a\tb\tx\t1\t1\t1\tn")]
    df = spark.createDataFrame(rows, "record_id bigint, feed string, line string").withColumn("received_at", F.lit("2024-01-01 05:00:00").cast("timestamp"))
    assert {(r.reason, r.n) for r in reject_counts(df).collect()} == {("column_count", 1), ("pli", 1)}
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    counted = reject_counts(stream).writeStream.format("memory").queryName("rejected").outputMode("complete").trigger(availableNow=True).start()
    counted.awaitTermination(120)
    assert {(r.reason, r.n) for r in spark.table("rejected").collect()} == {("column_count", 1), ("pli", 1)}
    q = split_stream(stream, str(tmp_path / "good"), str(tmp_path / "bad")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1 and spark.read.parquet(str(tmp_path / "bad")).count() == 2
