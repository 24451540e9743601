"""Readers of hypergraph, weight, matrix and graph files, all splittable: lines are numbered from the blocks' counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pinweave.model import Hypergraph
from pinweave.store import exists, settle


def numbered_lines(spark: SparkSession, path: str, keep_blank: bool = False, comment: str | None = None) -> DataFrame:
    """(line, value) of a text file, or of a folder's files in the order of their names; lines are counted from 0.

    Blank and comment lines are not counted unless kept. A block of a file is read by one task, which numbers its lines;
    only the number of lines of each block is summed up in one place.
    """
    return _counted_lines(spark, path, keep_blank, comment).select("line", "value")


def _counted_lines(spark: SparkSession, path: str, keep_blank: bool = False, comment: str | None = None) -> DataFrame:
    """(line, value, total): total is the number of all lines that are counted.

    A query reads the file twice, as blocks may be cut otherwise in the next one.
    """
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    if not keep_blank:
        text = text.where("value rlike '\\\\S'")
    if comment:
        text = text.where(~F.trim("value").startswith(comment))
    own = text.select("value", "file", "block", F.monotonically_increasing_id().alias("id"))
    sizes = own.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    up_to = F.sum("n").over(Window.orderBy("file", "block"))
    every = F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = sizes.select("file", "block", "first", (up_to - F.col("n")).alias("before"), every.alias("total"))
    return own.join(F.broadcast(before), ["file", "block"]).select((F.col("before") + F.col("id") - F.col("first")).alias("line"), "value", "total")


def _first_line(spark: SparkSession, path: str) -> str | None:
    """Of the first file that has any, without numbers for the others."""
    text = spark.read.text(path).where("_metadata.file_block_start = 0").select("value", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()).alias("place"))
    return text.agg(F.min_by("value", "place")).first()[0]


def _numbers(lines: DataFrame) -> DataFrame:
    return lines.select("line", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("pos", "token")).where("token <> ''")


def _header(lines: DataFrame) -> list[str]:
    row = lines.where("line = 0").first()
    if row is None:
        raise ValueError("the file has no header")
    return row["value"].split()


def read_hypergraph(spark: SparkSession, path: str) -> Hypergraph:
    """``base nov noe pins``, then a net a line: vertex ids, from 1 unless base is 0. Blank lines are no nets.

    The number of nets in the file holds, whatever the header says; another number of pins, or an id out of range, is an
    error. A net keeps each vertex once.
    """
    lines = numbered_lines(spark, path)
    head = _header(lines)
    if len(head) != 4:
        raise ValueError(f"a header has four numbers, not {len(head)}")
    base, nov, _, n_pins = map(int, head)
    own = lines.where("line > 0")
    raw = _numbers(own).select((F.col("line") - 1).alias("net"), (F.col("token").cast("bigint") - (1 if base else 0)).alias("v"))
    n, bad = raw.agg(F.count(F.lit(1)), F.sum((F.col("v").isNull() | (F.col("v") < 0) | (F.col("v") >= nov)).cast("int"))).first()
    if n != n_pins:
        raise ValueError(f"{n} pins where the header says {n_pins}")
    if bad:
        raise ValueError(f"{bad} ids are not of one of {nov} vertices")
    return Hypergraph.of(raw, spark.range(nov).select(F.col("id").alias("v")), own.select((F.col("line") - 1).alias("net")))


def read_vertex_major(spark: SparkSession, path: str) -> Hypergraph:
    """``nov noe pins``, then a vertex a line: net ids from 0, in exactly these numbers."""
    lines = numbered_lines(spark, path, keep_blank=True)
    nov, noe, n_pins = map(int, _header(lines))
    raw = _numbers(lines.where(f"line between 1 and {nov}")).select(F.col("token").cast("bigint").alias("net"), (F.col("line") - 1).alias("v"))
    n, bad = raw.agg(F.count(F.lit(1)), F.sum((F.col("net").isNull() | (F.col("net") < 0) | (F.col("net") >= noe)).cast("int"))).first()
    if n != n_pins or bad:
        raise ValueError(f"{n} pins, {bad} of them out of range, where the header says {n_pins} in {noe} nets")
    return Hypergraph.of(raw, spark.range(nov).select(F.col("id").alias("v")), spark.range(noe).select(F.col("id").alias("net")))


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """(net, weight, src) from a line ``weight source`` for each net; a source of -1 is none."""
    lines = numbered_lines(spark, path)
    part = F.split(F.trim("value"), r"\s+")
    src = part[1].cast("bigint")
    return lines.select(F.col("line").alias("net"), part[0].cast("int").alias("weight"), F.when(src >= 0, src).alias("src"))


def default_weights(hg: Hypergraph) -> DataFrame:
    """(net, weight 0 to 9, src): a rule in place of random numbers; the source is the lowest pin."""
    return hg.nets.select("net", F.pmod("net", F.lit(10)).cast("int").alias("weight"), "src")


KINDS, SYMMETRIES = ("real", "integer", "pattern", "complex"), ("general", "symmetric", "skew-symmetric", "hermitian")


def packed_size(side: int, symmetry: str) -> int:
    """Values of a matrix in array form: all, the lower triangle, or that without the diagonal."""
    return {"general": side * side, "skew-symmetric": side * (side - 1) // 2}.get(symmetry, side * (side + 1) // 2)


def packed_place(place: Column, side: int, symmetry: str) -> tuple[Column, Column]:
    """Row and column, from 0, of the value at a place of the array form, which goes column by column."""
    if symmetry == "general":
        return place % side, ((place - place % side) / side).cast("bigint")
    strict = symmetry == "skew-symmetric"
    n = side - strict
    before = lambda j: j * n - ((j * (j - 1)) / 2).cast("bigint")  # noqa: E731  values of the columns left of j
    # The root is right but for rounding, which the values before the next columns tell.
    guess = F.floor((2 * n + 1 - F.sqrt(F.greatest(F.lit(0.0), F.lit(float((2 * n + 1) ** 2)) - 8 * place))) / 2).cast("bigint")
    column = guess + (before(guess + 1) <= place).cast("bigint") - (before(guess) > place).cast("bigint")
    return column + int(strict) + place - before(column), column


def place_of(i: Column, j: Column, side: int, symmetry: str) -> Column:
    """The place of a value in the array form, null where the form has none."""
    if symmetry == "general":
        return j * side + i
    strict = int(symmetry == "skew-symmetric")
    n = side - strict
    return F.when(i >= j + strict, j * n - ((j * (j - 1)) / 2).cast("bigint") + i - j - strict)


def read_matrix(spark: SparkSession, path: str, loop: bool = False, zero_based: bool | None = None) -> tuple[int, DataFrame]:
    """Side and entries (i, j, w), from 0, of a square matrix in Matrix Market form, by coordinates or as an array.

    The diagonal is dropped unless ``loop``, as are zeros; weights are absolute, magnitudes of complex ones; symmetric,
    skew-symmetric and Hermitian files are mirrored; repeated entries are added up. A ``.txt`` file counts from 0. Another
    number of entries than the header says, as in a file cut off, is an error, as is a coordinate out of range, or one on
    the diagonal of a skew-symmetric matrix.
    """
    banner = (_first_line(spark, path) or "").lower().split()
    if len(banner) != 5 or banner[0] != "%%matrixmarket" or banner[1] != "matrix" or banner[2] not in ("coordinate", "array") or banner[3] not in KINDS or banner[4] not in SYMMETRIES:
        raise ValueError(f"not a matrix of {KINDS} and {SYMMETRIES}: {' '.join(banner)}")
    form, kind, symmetry = banner[2:]
    if (form, kind) == ("array", "pattern") or symmetry == "hermitian" and kind != "complex" or symmetry == "skew-symmetric" and kind == "pattern":
        raise ValueError(f"no such matrix: {' '.join(banner)}")
    token = F.split(F.trim("value"), r"\s+")
    number = lambda k: F.get(token, F.lit(k)).try_cast("double")
    at = 2 if form == "coordinate" else 0
    weight = F.lit(1.0) if kind == "pattern" else F.hypot(number(at), number(at + 1)) if kind == "complex" else number(at)
    ids = [F.get(token, F.lit(k)).try_cast("bigint").alias(c) for k, c in enumerate("ij")] if form == "coordinate" else []
    is_head = F.col("line") == 0
    parsed = _counted_lines(spark, path, comment="%").select("line", "total", F.when(is_head, F.col("value")).alias("value"), *ids, weight.alias("w"))
    # Written once, without the zeros of an array, as the file may be far larger than what is in it.
    lines = settle(parsed if form == "coordinate" else parsed.where("line = 0 or w is null or w <> 0"))
    size = [int(x) for x in _header(lines)]
    if len(size) != (3 if form == "coordinate" else 2) or size[0] != size[1]:
        raise ValueError(f"a {form} matrix of size {size} is not square, or the numbers are not those of such a matrix")
    rows = size[0]
    if form == "array":
        count = packed_size(rows, symmetry)
        i, j = packed_place(F.col("line") - 1, rows, symmetry)
    else:
        count, base = size[2], 0 if (path.endswith(".txt") if zero_based is None else zero_based) else 1
        i, j = F.col("i") - base, F.col("j") - base
    own = lines.where(F.col("line").between(1, count) if form == "array" else F.col("line") > 0)
    entries = own.select(i.alias("i"), j.alias("j"), "w")
    right = F.col("i").between(0, rows - 1) & F.col("j").between(0, rows - 1) & F.col("w").isNotNull()
    if symmetry == "skew-symmetric":
        right = right & (F.col("i") != F.col("j"))
    bad = entries.agg(F.count_if(~F.coalesce(right, F.lit(False)))).first()[0]
    n = lines.where("line = 0").first()["total"] - 1
    if n != count or bad:
        raise ValueError(f"{n} entries, {bad} of them out of range or not numbers, where the header says {count} in a matrix of side {rows}")
    return rows, clean_entries(entries, symmetry != "general", loop)


def clean_entries(entries: DataFrame, symmetric: bool, loop: bool = False) -> DataFrame:
    """Mirrors, drops diagonal and zeros, takes absolute weights and adds up repeated (i, j)."""
    if symmetric:
        mirrored = entries.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "w")
        entries = entries.unionByName(mirrored)
    if not loop:
        entries = entries.where("i <> j")
    return entries.where("w <> 0").groupBy("i", "j").agg(F.sum(F.abs("w")).alias("w"))


def read_graph(spark: SparkSession, path: str, loop: bool = False) -> tuple[int, DataFrame]:
    """Vertices and entries (i, j, w) of ``nv ne [fmt [ncon]]`` and a line of neighbours, from 1, for each vertex.

    The digits of fmt, from the last: a weight after each neighbour; ncon vertex weights before them; a vertex size
    before these. Loops are dropped unless ``loop``. A negative weight, an id out of range, more lines than vertices or
    more entries than two for each edge are errors.
    """
    side, _, entries = read_weighted_graph(spark, path, loop)
    return side, entries


def read_weighted_graph(spark: SparkSession, path: str, loop: bool = False) -> tuple[int, DataFrame, DataFrame]:
    """As ``read_graph``, with (v, weight) of all vertices between: the first weight of each, 1 where the file has none."""
    lines = numbered_lines(spark, path, keep_blank=True, comment="%")
    head = [int(x) for x in _header(lines)]
    side, edges, fmt = head[0], head[1], head[2] if len(head) > 2 else 0
    sized, own_weights, weighted = fmt // 100 % 10 > 0, fmt // 10 % 10 > 0, fmt % 10 == 1
    skip = sized + ((head[3] if len(head) > 3 else 1) if own_weights else 0)
    tokens = _numbers(lines.where("line > 0"))
    if not lines.where(F.col("line") > side).where("value rlike '\\\\S'").isEmpty():
        raise ValueError(f"the file has lines for more than {side} vertices")
    own = tokens.where(F.col("pos") >= skip).withColumn("pos", F.col("pos") - skip)
    if weighted:
        pair = F.floor(F.col("pos") / 2)
        own = own.groupBy("line", pair.alias("pair")).agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("token"))).alias("token"), F.max(F.when(F.col("pos") % 2 == 1, F.col("token"))).alias("w"))
    entries = own.select((F.col("line") - 1).alias("i"), (F.col("token").cast("bigint") - 1).alias("j"), (F.col("w").cast("double") if weighted else F.lit(1.0)).alias("w"))
    counted = F.lit(True) if loop else F.col("i") != F.col("j")
    n, bad, negative = entries.agg(F.count_if(counted), F.count_if(~F.coalesce(F.col("j").between(0, side - 1) & F.col("w").isNotNull(), F.lit(False))), F.count_if(F.col("w") < 0)).first()
    if negative:
        raise ValueError(f"{negative} edges have a negative weight")
    if n > 2 * edges or bad:
        raise ValueError(f"{n} entries, {bad} of them out of range or not numbers, where the header says {edges} edges of {side} vertices")
    ids = spark.range(side).select(F.col("id").alias("v"))
    first = tokens.where(F.col("pos") == int(sized)).select((F.col("line") - 1).alias("v"), F.col("token").cast("int").alias("weight")) if own_weights else None
    weights = ids.select("v", F.lit(1).alias("weight")) if first is None else ids.join(first, "v", "left").select("v", F.coalesce("weight", F.lit(1)).alias("weight"))
    return side, weights, clean_entries(entries, symmetric=False, loop=loop)


def hypergraph_of(side: int, entries: DataFrame) -> Hypergraph:
    """Rows as nets, columns as vertices."""
    ids = entries.sparkSession.range(side)
    return Hypergraph.of(entries.select(F.col("i").alias("net"), F.col("j").alias("v")), ids.select(F.col("id").alias("v")), ids.select(F.col("id").alias("net")))


def read_cache(spark: SparkSession, path: str) -> Hypergraph:
    """What ``write_cache`` wrote."""
    return Hypergraph(*(spark.read.parquet(f"{path}/{name}") for name in ("pins", "vertices", "nets")))


def read_graph_cache(spark: SparkSession, path: str) -> tuple[int, DataFrame, DataFrame]:
    """What ``write_graph_cache`` wrote."""
    weights, entries = (spark.read.parquet(f"{path}/{name}") for name in ("weights", "entries"))
    return weights.count(), weights, entries


def load_graph(spark: SparkSession, path: str, loop: bool = False) -> tuple[int, DataFrame, DataFrame]:
    """Side, (v, weight) and entries of a matrix or graph file, of its cache beside it if there is one."""
    if not loop and exists(spark, cache_path(path)):
        return read_graph_cache(spark, cache_path(path))
    if path.endswith(".graph"):
        return read_weighted_graph(spark, path, loop)
    side, entries = read_matrix(spark, path, loop)
    return side, spark.range(side).select(F.col("id").alias("v"), F.lit(1).alias("weight")), entries


def cache_path(path: str) -> str:
    """Where the Parquet cache of a file goes, by default beside it."""
    return f"{path}.cache"


def load(spark: SparkSession, path: str, orientation: str = "net") -> Hypergraph:
    """The cache beside a ``.hg`` file if there is one, else by extension: ``.hg``, ``.mtx`` or ``.txt`` matrix, ``.graph``, a Parquet cache."""
    if path.endswith(".hg"):
        if exists(spark, cache_path(path)):
            return read_cache(spark, cache_path(path))
        return read_vertex_major(spark, path) if orientation == "vertex" else read_hypergraph(spark, path)
    if path.endswith((".mtx", ".txt", ".graph")):
        side, _, entries = load_graph(spark, path)
        return hypergraph_of(side, entries)
    return read_cache(spark, path)
