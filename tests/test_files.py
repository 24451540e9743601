"""Readers and writers, and the command line."""

import pytest
from pyspark.sql import functions as F

from pinweave.cli import main
from pinweave.operators import graph, place
from pinweave.plans import registry
from pinweave.sources import readers, writers
from pinweave.streaming import placement

TEXT = "1 8 4 12\n1 2 3\n1 6 7 8\n\n3 4 5\n6 7\n"


def put(path, text):
    path.write_text(text)
    return str(path)


def pins(hg):
    return sorted((r.net, r.v) for r in hg.pins.collect())


EXPECTED = sorted((n, v) for n, vs in enumerate([[0, 1, 2], [0, 5, 6, 7], [2, 3, 4], [5, 6]]) for v in vs)


def test_both_bases_and_blank_lines(spark, tmp_path):
    assert pins(readers.load(spark, put(tmp_path / "a.hg", TEXT))) == EXPECTED
    assert pins(readers.load(spark, put(tmp_path / "b.hg", "0 8 4 12\n0 1 2\n0 5 6 7\n2 3 4\n5 6"))) == EXPECTED


def test_header_that_is_off(spark, tmp_path):
    hg = readers.load(spark, put(tmp_path / "a.hg", TEXT.replace("8 4 12", "8 9 12")))
    assert hg.nets.count() == 4
    for text in (TEXT.replace("12", "13"), TEXT.replace("8 4", "7 4"), "1 2 3\n1 2"):
        with pytest.raises(ValueError):
            readers.load(spark, put(tmp_path / "b.hg", text))


def test_lines_keep_their_numbers_over_many_splits(spark, tmp_path):
    n = 5000
    path = put(tmp_path / "a.hg", f"0 {n} {n} {2 * n}\n" + "".join(f"{i} {(i + 1) % n}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert pins(readers.load(spark, path)) == sorted((i, v) for i in range(n) for v in (i, (i + 1) % n))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_vertex_major(spark, tmp_path):
    hg = readers.load(spark, put(tmp_path / "a.hg", "3 2 4\n0\n0 1\n1\n"), orientation="vertex")
    assert pins(hg) == [(0, 0), (0, 1), (1, 1), (1, 2)]


def test_round_trips(spark, tmp_path):
    hg = readers.load(spark, put(tmp_path / "a.hg", TEXT))
    for base in (0, 1):
        writers.write_hypergraph(hg, str(tmp_path / f"{base}.hg"), base)
        assert pins(readers.read_hypergraph(spark, str(tmp_path / f"{base}.hg" / "part-*"))) == EXPECTED
    writers.write_cache(hg, str(tmp_path / "cache"))
    assert pins(readers.load(spark, str(tmp_path / "cache"))) == EXPECTED
    nets = readers.default_weights(hg)
    writers.write_weights(nets, str(tmp_path / "a.ws"))
    assert sorted(map(tuple, readers.read_weights(spark, str(tmp_path / "a.ws" / "part-*")).collect())) == sorted(map(tuple, nets.collect()))


def test_parts_in_order(spark, tmp_path):
    parts = spark.createDataFrame([(2, 1), (0, 3), (1, None)], "v long, part int")
    writers.write_parts(parts, str(tmp_path / "p"), single=True)
    (file,) = (tmp_path / "p").glob("part-*")
    assert file.read_text() == "3\n-1\n1\n"


def test_matrix(spark, tmp_path):
    text = "%%MatrixMarket matrix coordinate real symmetric\n% note\n3 3 5\n1 1 5\n2 1 -2\n3 2 0\n3 1 1.5\n3 1 0.5\n"
    side, entries = readers.read_matrix(spark, put(tmp_path / "a.mtx", text))
    assert side == 3
    assert sorted(map(tuple, entries.collect())) == [(0, 1, 2.0), (0, 2, 2.0), (1, 0, 2.0), (2, 0, 2.0)]
    assert readers.read_matrix(spark, str(tmp_path / "a.mtx"), loop=True)[1].count() == 5
    zero = text.replace("1 1 5\n2 1 -2\n3 2 0\n3 1 1.5\n3 1 0.5", "0 0 5\n1 0 -2\n2 1 0\n2 0 1.5\n2 0 0.5")
    assert sorted(map(tuple, readers.read_matrix(spark, put(tmp_path / "a.txt", zero))[1].collect())) == sorted(map(tuple, entries.collect()))
    pattern = "%%MatrixMarket matrix coordinate pattern general\n2 2 2\n1 2\n1 2\n"
    assert readers.read_matrix(spark, put(tmp_path / "b.mtx", pattern))[1].first().w == 2.0
    for bad in (text.replace("3 3 5", "3 4 5"), text.replace("coordinate", "array"), text.replace("real", "complex"), ""):
        with pytest.raises(ValueError):
            readers.read_matrix(spark, put(tmp_path / "c.mtx", bad))


def test_graph(spark, tmp_path):
    side, entries = readers.read_graph(spark, put(tmp_path / "a.graph", "3 2\n2\n1 3\n2\n"))
    assert (side, sorted((r.i, r.j) for r in entries.collect())) == (3, [(0, 1), (1, 0), (1, 2), (2, 1)])
    weighted = readers.read_graph(spark, put(tmp_path / "b.graph", "3 2 11\n9 2 5\n9 1 5 3 7\n9 2 7\n"))[1]
    assert sorted(map(tuple, weighted.collect())) == [(0, 1, 5.0), (1, 0, 5.0), (1, 2, 7.0), (2, 1, 7.0)]
    assert readers.read_graph(spark, put(tmp_path / "c.graph", "3 1\n2\n1\n\n"))[1].count() == 2
    with pytest.raises(ValueError):
        readers.read_graph(spark, put(tmp_path / "d.graph", "2 1 1\n2 -1\n1 -1\n"))


def test_stream_places_as_batches_do(spark, tmp_path):
    hg = readers.load(spark, put(tmp_path / "a.hg", TEXT))
    order = graph.id_order(hg)
    placement.write_arrivals(place.stream_rows(hg, order), str(tmp_path / "in"), 3)
    streamed = placement.place_stream(str(tmp_path / "in"), 8, 2, spark)
    batched = place.place_batches(hg, order, 2, "tv", batch=3)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batched.collect()))


def test_command_line(spark, tmp_path, capsys):
    path = put(tmp_path / "a.hg", TEXT)
    main(["partition", "-f", path, "-k", "2", "-m", "tv", "-r", "-i", "1"], spark)
    out = capsys.readouterr().out
    assert "tv" in out and (tmp_path / "a.hg.parts.2").is_dir()
    mtx = put(tmp_path / "a.mtx", "%%MatrixMarket matrix coordinate pattern symmetric\n3 3 2\n2 1\n3 2\n")
    main(["convert", "-f", mtx, "-o", str(tmp_path / "out.hg")], spark)
    (file,) = (tmp_path / "out.hg").glob("part-*")
    assert file.read_text() == "0 3 3 4\n1\n0 2\n1\n"


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    """Two placers on one folder, and a second call with the files that came since, place as one does."""
    hg = readers.load(spark, put(tmp_path / "a.hg", TEXT))
    order = graph.id_order(hg)
    rows = place.stream_rows(hg, order)
    expected = sorted(map(tuple, place.place_batches(hg, order, 2, "tv", batch=4).collect()))
    state = f"file://{tmp_path}/state"
    for epoch in range(2):
        placer = placement.StreamPlacer(spark, 8, 2, path=state)
        assert placer.last == epoch - 1
        placer(rows.where(f"ord between {4 * epoch} and {4 * epoch + 3}"), epoch)
        placer(rows.where(f"ord between {4 * epoch} and {4 * epoch + 3}"), epoch)
    assert sorted(map(tuple, placement.StreamPlacer(spark, 8, 2, path=state).parts().collect())) == expected
    arrivals, kept = str(tmp_path / "in"), f"file://{tmp_path}/kept"
    placement.write_arrivals(rows.where("ord < 4"), arrivals, 4)
    assert placement.place_stream(arrivals, 8, 2, spark, path=kept).count() == 4
    rows.where("ord >= 4").coalesce(1).write.mode("append").parquet(arrivals)
    assert sorted(map(tuple, placement.place_stream(arrivals, 8, 2, spark, path=kept).collect())) == expected


def test_matrix_that_is_cut_off_or_out_of_range(spark, tmp_path):
    head = "%%MatrixMarket matrix coordinate real general\n3 3 3\n"
    for body in ("1 2 1\n2 3 1\n", "1 2 1\n2 3 1\n3 1 1\n1 3 1\n", "1 2 1\n2 4 1\n3 1 1\n", "0 2 1\n2 3 1\n3 1 1\n", "1 2 1\n2 3\n3 1 1\n"):
        with pytest.raises(ValueError):
            readers.read_matrix(spark, put(tmp_path / "a.mtx", head + body))


def test_weights_and_loops_of_graphs(spark, tmp_path):
    path = put(tmp_path / "a.graph", "3 2 111 2\n7 4 1 2 5\n7 6 1 1 5 3 2 2 9\n7 8 1 2 2\n")
    side, weights, entries = readers.read_weighted_graph(spark, path, loop=False)
    assert (side, sorted(map(tuple, weights.collect()))) == (3, [(0, 4), (1, 6), (2, 8)])
    assert sorted(map(tuple, entries.collect())) == [(0, 1, 5.0), (1, 0, 5.0), (1, 2, 2.0), (2, 1, 2.0)]
    for bad in ("2 1\n2\n1\n1\n", "2 1\n2 2\n1\n", "2 1\n3\n1\n"):
        with pytest.raises(ValueError):
            readers.read_graph(spark, put(tmp_path / "b.graph", bad))
    assert readers.read_graph(spark, put(tmp_path / "c.graph", "2 2\n1 2\n1\n"), loop=True)[1].count() == 3
    writers.write_graph_cache(weights, entries, readers.cache_path(path))
    (tmp_path / "a.graph").write_text("")
    assert sorted(map(tuple, readers.load_graph(spark, path)[1].collect())) == [(0, 4), (1, 6), (2, 8)]


def test_text_of_many_files_keeps_its_order(spark, tmp_path):
    n = 3000
    parts = spark.range(n).select("id", (F.col("id") % 11).cast("int").alias("part")).withColumnRenamed("id", "v").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one file
    try:
        writers.write_parts(parts, str(tmp_path / "p"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "p").glob("part-*"))) > 1
    rows = readers.numbered_lines(spark, str(tmp_path / "p")).collect()
    assert sorted((r.line, r.value) for r in rows) == [(i, str(i % 11)) for i in range(n)]


def test_numbers_are_merged_whatever_the_size_of_their_file(spark, sf_dir, monkeypatch):
    """Numbers in a row make a small file of very many rows, which the driver would hold to broadcast them."""
    monkeypatch.setattr(registry, "settled", lambda hg: hg)
    pins = registry._numbered(spark, sf_dir).pins
    assert pins.count() > 0 and "rightHint=(strategy=merge)" in pins._jdf.queryExecution().optimizedPlan().toString()
    assert "SortMergeJoin" in pins._jdf.queryExecution().executedPlan().toString()
