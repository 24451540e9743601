"""Matrices in array form and of other symmetries, against lists in memory."""

import pytest

from pinweave.sources import readers, writers


def put(path, text):
    path.write_text(text)
    return str(path)


def read(spark, path, **more):
    side, entries = readers.read_matrix(spark, path, **more)
    return side, sorted(map(tuple, entries.collect()))


@pytest.mark.parametrize("symmetry", ["general", "symmetric", "skew-symmetric"])
@pytest.mark.parametrize("side", [1, 2, 7])
def test_places(spark, tmp_path, symmetry, side):
    """Values 1, 2, 3, ... in the order of the form, column by column."""
    lower = {"general": 0, "symmetric": 0, "skew-symmetric": 1}[symmetry]
    places = [(i, j) for j in range(side) for i in range(0 if symmetry == "general" else j + lower, side)]
    text = f"%%MatrixMarket matrix array real {symmetry}\n% remark\n{side} {side}\n" + "".join(f"{-k if k % 2 else k}.0\n" for k in range(1, len(places) + 1))
    expected = {p: float(k) for k, p in enumerate(places, 1)}
    if symmetry != "general":
        expected |= {(j, i): w for (i, j), w in expected.items()}
    path = put(tmp_path / "a.mtx", text)
    assert read(spark, path, loop=True) == (side, sorted((i, j, w) for (i, j), w in expected.items()))
    assert read(spark, path) == (side, sorted((i, j, w) for (i, j), w in expected.items() if i != j))


def test_large_packed_places(spark):
    side = 3_000_001
    for symmetry in ("symmetric", "skew-symmetric"):
        n = readers.packed_size(side, symmetry)
        ids = [0, 1, side - 2, side - 1, side, n // 2, n - 2, n - 1]
        df = spark.createDataFrame([(k,) for k in ids], "id long")
        i, j = readers.packed_place(df.id, side, symmetry)
        for k, i, j in df.select("id", i, j).collect():
            strict = int(symmetry == "skew-symmetric")
            rows = side - strict
            assert j * rows - j * (j - 1) // 2 + (i - j - strict) == k and j + strict <= i < side


def test_complex_and_mirrored_coordinates(spark, tmp_path):
    hermitian = put(tmp_path / "h.mtx", "%%MatrixMarket matrix coordinate complex hermitian\n3 3 3\n1 1 2 0\n2 1 3 -4\n3 2 0 0\n")
    assert read(spark, hermitian, loop=True) == (3, [(0, 0, 2.0), (0, 1, 5.0), (1, 0, 5.0)])
    skew = put(tmp_path / "s.mtx", "%%MatrixMarket matrix coordinate integer skew-symmetric\n3 3 2\n2 1 -3\n3 1 4\n")
    assert read(spark, skew) == (3, [(0, 1, 3.0), (0, 2, 4.0), (1, 0, 3.0), (2, 0, 4.0)])
    array = put(tmp_path / "c.mtx", "%%MatrixMarket matrix array complex hermitian\n2 2\n1 0\n6 8\n1 0\n")
    assert read(spark, array) == (2, [(0, 1, 10.0), (1, 0, 10.0)])


@pytest.mark.parametrize(
    "text",
    [
        "%%MatrixMarket matrix array real general\n2 2\n1\n2\n3\n",
        "%%MatrixMarket matrix array real general\n2 2\n1\n2\n3\n4\n5\n",
        "%%MatrixMarket matrix array real general\n2 2\n1\nx\n3\n4\n",
        "%%MatrixMarket matrix array real general\n2 3\n1\n2\n3\n4\n5\n6\n",
        "%%MatrixMarket matrix array pattern general\n2 2\n",
        "%%MatrixMarket matrix array real hermitian\n1 1\n1\n",
        "%%MatrixMarket matrix coordinate real skew-symmetric\n2 2 1\n1 1 5\n",
        "%%MatrixMarket matrix coordinate complex general\n2 2 1\n2 1 5\n",
    ],
)
def test_faults(spark, tmp_path, text):
    with pytest.raises(ValueError):
        readers.read_matrix(spark, put(tmp_path / "bad.mtx", text))


def test_written_arrays_over_many_files(spark, tmp_path):
    entries = spark.createDataFrame([(0, 1, 2.0), (4, 3, 1.5), (2, 2, 7.0)], "i long, j long, w double")
    writers.write_array(5, entries.repartition(3), str(tmp_path / "w.mtx"))
    assert read(spark, str(tmp_path / "w.mtx"), loop=True) == (5, [(0, 1, 2.0), (2, 2, 7.0), (4, 3, 1.5)])


@pytest.mark.parametrize("symmetry", ["general", "symmetric", "skew-symmetric"])
def test_zeros_take_no_disk(spark, tmp_path, monkeypatch, symmetry):
    """Runs and files that begin and end anywhere; the zeros of 490,000 places are neither shuffled nor kept as text."""
    monkeypatch.setattr(writers, "RUN", 1009)
    monkeypatch.setattr(writers, "PER_FILE", 100_000)
    side, path = 700, tmp_path / "w.mtx"
    cells = {(0, 0), (1, 0), (699, 0), (0, 699), (699, 699), (350, 349), (309, 1), (308, 1), (310, 1), (699, 698)}
    entries = spark.createDataFrame([(i, j, i + 2.0 * j + 1) for i, j in cells], "i int, j int, w double")
    writers.write_array(side, entries, str(path), symmetry)
    own = {(i, j): i + 2.0 * j + 1 for i, j in cells if symmetry == "general" or i > j or i == j and symmetry == "symmetric"}
    if symmetry != "general":
        own |= {(j, i): w for (i, j), w in own.items()}
    assert read(spark, str(path), loop=True) == (side, sorted((i, j, w) for (i, j), w in own.items()))
    assert sum(f.stat().st_size for f in path.iterdir()) < 50_000
    writers.write_array(side, entries, str(tmp_path / "one.mtx"), symmetry, single=True)
    (file,) = (tmp_path / "one.mtx").glob("part-*.txt")
    assert len(file.read_text().splitlines()) == 2 + readers.packed_size(side, symmetry)
