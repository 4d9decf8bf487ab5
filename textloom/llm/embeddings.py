"""Embedding near-duplicates: Euclidean p-stable hashing of unit vectors, then exact cosines."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .graph import components

#: Least cosine of a link.
COSINE = 0.9
#: Width of a quantised projection of a unit vector, the chance that a pair of least cosine shares a table, and how many unrelated vectors a bucket may hold on average.
WIDTH, RECALL, STRANGERS = 2.5, 0.95, 0.1
#: Members of a group that a task compares with each other; larger groups are cut into blocks.
BLOCK = 256
#: Members (about so many) whose mean is the centre of a group of blocks. Any centre gives right results.
SAMPLE = 64
#: Angles that differ by less than this are told apart by the cosine itself.
SLACK = 1e-6


def same_bucket(distance: float) -> float:
    """The chance that two points at this distance share a quantised Gaussian projection."""
    r = WIDTH / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def shape(vectors: int, cosine: float) -> tuple[int, int]:
    """(projections of a key, tables) for so many vectors.

    Keys are long enough that a bucket holds STRANGERS vectors at right angles to its own, and there are as many tables as give a
    pair of least cosine the chance RECALL to meet in one; pairs closer than that meet more surely.
    """
    k = max(1, math.ceil(math.log(max(vectors, 2) / STRANGERS) / -math.log(same_bucket(math.sqrt(2)))))
    return k, math.ceil(math.log(1 - RECALL) / math.log(1 - same_bucket(math.sqrt(2 - 2 * cosine)) ** k))


def with_units(vectors: DataFrame, vec_col: str) -> DataFrame:
    """(id, vec, unit): unit is null for vectors that link with nothing."""
    vec = F.col("vec")
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x))
    biggest = F.array_max(F.transform(vec, lambda x: F.abs(x)))
    sound = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (biggest > 0)
    over = lambda size: F.get(F.transform(F.array(size), lambda n: F.transform(vec, lambda x: x / n)), F.lit(0))  # noqa: E731  n is computed once a vector
    rows = vectors.select(F.col("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.select("id", F.when(sound, over(biggest)).alias("vec"))  # squares neither overflow nor vanish
    return rows.select("id", over(norm).alias("unit"))


def units_of(batch: pa.RecordBatch, column: str = "unit") -> np.ndarray:
    """The vectors of a batch, all of one length, as a matrix."""
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds vectors of one length."""
    for batch in batches:
        lengths = np.diff(batch.column("unit").offsets.to_numpy())
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            yield batch if len(rows) == batch.num_rows else batch.take(pa.array(rows))


def bucket_keys(nodes: DataFrame, k: int, tables: int) -> DataFrame:
    """(group, dim, node): the bucket of each node in each table."""

    def hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                for batch in by_length(iter([whole.slice(at, 1024)])):
                    x, node = units_of(batch), batch.column("node").to_numpy()
                    d = x.shape[1]
                    if d not in drawn:
                        rng = np.random.default_rng([20262, d])
                        drawn[d] = rng.standard_normal((d, k * tables)), rng.random(k * tables)
                    lines, shifts = drawn[d]
                    cells = np.floor(x @ lines / WIDTH + shifts).astype(np.int16).reshape(len(x), tables, k)
                    keys = np.array([[xxhash.xxh64_intdigest(c.tobytes(), t) for t, c in enumerate(row)] for row in cells], dtype=np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.full(keys.size, d, dtype=np.int32)), pa.array(np.repeat(node, tables))], ["group", "dim", "node"])

    return nodes.select("node", "unit").mapInArrow(hash_batches, "group long, dim int, node long")


def centres(big: DataFrame) -> DataFrame:
    """(group, dim, centre): the mean direction of about SAMPLE members, drawn by hash, of each group; its size bounds what a task gathers."""
    drawn = big.filter(F.pmod(F.xxhash64("node", "group"), F.ceil(F.col("size") / SAMPLE)) == 0)

    def mean(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        total = units_of(rows.combine_chunks().to_batches()[0]).sum(axis=0)
        norm = np.linalg.norm(total)
        return pa.table({"group": [key[0].as_py()], "dim": pa.array([key[1].as_py()], pa.int32()), "centre": pa.array([total / norm if norm > 0 else total], pa.list_(pa.float64()))})

    return drawn.select("group", "dim", "unit").groupBy("group", "dim").applyInArrow(mean, "group long, dim int, centre array<double>")


def dealt(members: DataFrame, cosine: float, name: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows of tasks that compare the members (group, dim, node, unit, copies) of each group, and what is known without comparing.

    A group of BLOCK members or fewer is one comparison (role 0). In a larger one let t be the angle of a link: members within t / 2 of the
    centre, the core, are linked with each other for sure, and members beyond 3 t / 2 with no one in the core. So only these
    are compared, in pairs of blocks (i, j) that hold about BLOCK members a side: the rest of the group with itself, and those of
    the rest within 3 t / 2 with the core (roles 1 and 2 for the sides). The second frame has a row for each core:
    (group, dim, node, copies) of its members; it is None if no group is large.
    """
    sizes = members.groupBy("group", "dim").agg(F.count("*").alias("size")).filter("size > 1")
    sized = members.join(sizes, ["group", "dim"])
    nothing = F.lit(0)
    small = sized.filter(F.col("size") <= BLOCK).select("group", "dim", nothing.alias("i"), nothing.alias("j"), nothing.alias("role"), "node", "copies", "unit")
    if sizes.filter(F.col("size") > BLOCK).isEmpty():
        return small, None
    big = materialize(sized.filter(F.col("size") > BLOCK), f"{name}-big")
    dot = F.aggregate(F.zip_with("unit", "centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))
    t = math.acos(cosine)
    placed = big.join(centres(big), ["group", "dim"], "left").withColumn("angle", angle)
    part = F.when(F.col("angle") <= t / 2 - SLACK, "core").when(F.col("angle") <= 1.5 * t + SLACK, "fringe").otherwise("far")
    placed = materialize(placed.select("group", "dim", "node", "copies", "unit", part.alias("part")), f"{name}-placed")
    counts = placed.groupBy("group", "dim").agg(F.count_if(F.col("part") == "core").alias("core"), F.count_if(F.col("part") == "fringe").alias("fringe"), F.count_if(F.col("part") != "core").alias("rest"))
    placed = placed.join(counts, ["group", "dim"])
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    mine = lambda n: F.pmod(F.xxhash64("node"), blocks(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), blocks(n) - 1)
    columns = ["group", "dim", "i", "j", "role", "node", "copies", "unit"]
    rest = placed.filter("part != 'core'").withColumn("own", mine("rest")).withColumn("other", F.explode(upto("rest")))
    rest = rest.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "role": F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)})
    # blocks of the fringe against the core are numbered below zero, apart from those of the rest
    fringe = placed.filter("part = 'fringe' AND core > 0").withColumns({"i": -1 - mine("fringe"), "j": F.explode(upto("core")), "role": F.lit(1)})
    core = placed.filter("part = 'core' AND fringe > 0").withColumns({"j": mine("core"), "i": F.explode(F.transform(upto("fringe"), lambda b: -1 - b)), "role": F.lit(2)})
    return small.union(rest.select(columns)).union(fringe.select(columns)).union(core.select(columns)), placed.filter("part = 'core'").select("group", "dim", "node", "copies")


def compared(rows: DataFrame, cosine: float) -> DataFrame:
    """(node, other, links): for each member of a comparison, the vectors linked with it and a member of its linked class there; rows without links are left out."""

    def links(x: np.ndarray, role: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = x @ x.T >= cosine
        np.fill_diagonal(near, False)
        if role.any():
            near &= role[:, None] != role[None, :]
        label = np.arange(len(x))
        while True:
            least = np.minimum(label, np.where(near, label[None, :], len(x)).min(axis=1))
            if (least == label).all():
                return near @ copies, label
            label = least

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in comparisons(batches):
            n, label = links(units_of(group), group.column("role").to_numpy(), group.column("copies").to_numpy())
            has = n > 0
            node = group.column("node").to_numpy()
            if has.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[has]), pa.array(node[label][has]), pa.array(n[has])], ["node", "other", "links"])

    keys = ["group", "dim", "i", "j"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "node long, other long, links long")


def comparisons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of equal (group, dim, i, j), which are sorted, across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("group", "dim", "i", "j")], axis=1)
        begins = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        for a, b in zip(begins, [*begins[1:], batch.num_rows]):
            if held and tuple(keys[a]) != last:
                yield joined(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = tuple(keys[a])
    if held:
        yield joined(held)


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Links and classes of vectors whose cosine is `cosine` or more.

    Equal directions are one node with a number of copies. Unit vectors at cosine c are sqrt(2 - 2 c) apart; each of `tables` hash
    tables quantises random Gaussian (2-stable) projections of them, and vectors that share a bucket are compared in double
    precision. The number of projections and tables follows from the number of nodes (see `shape`), so unrelated vectors hardly meet
    at any size, and a pair at the least cosine is found with RECALL. What is linked in a bucket joins a component; then
    each component's members are compared with each other, so the number of links counts every pair in a component with enough cosine.
    Both comparisons go by `dealt`: a crowded bucket or component is not paired whole, but only where its centre leaves open
    whether two members are linked. A spread-out component of n members has n * n / 2 comparisons left in the worst case, in blocks that
    tasks share; no pair is ever a row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of different
    lengths with each other. Rows that repeat an id are vectors of their own and link if their vectors do. A null id is larger than any
    other. An empty table gives an empty table. Only id and vector are read, so other columns cannot clash. A long vector is one row.

    Returns id, n_links, component_id (the smallest id reachable), kept.
    """
    rows = with_units(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")), "vec")
    digest = [F.xxhash64("unit"), F.xxhash64(F.lit(7), "unit")]  # 128 bits tell nodes apart
    rows = materialize(rows.select("id", "unit", *(d.alias(f"h{k}") for k, d in enumerate(digest))), "vector-rows")
    nodes = rows.filter("unit IS NOT NULL").groupBy("h0", "h1").agg(F.first("unit").alias("unit"), F.min("id").alias("first"), F.count("*").alias("copies"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    k, tables = shape(nodes.count(), cosine)

    keys = materialize(bucket_keys(nodes, k, tables), "vector-keys")
    shared = keys.groupBy("group", "dim").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    members = materialize(keys.join(shared, ["group", "dim"]).join(nodes.select("node", "copies", "unit"), "node").select("group", "dim", "node", "copies", "unit"), "vector-buckets")
    rest, core = dealt(members, cosine, "vector-buckets")
    edges = compared(rest, cosine).select("node", "other")
    if core is not None:
        edges = edges.union(core.join(core.groupBy("group", "dim").agg(F.min("node").alias("other")), ["group", "dim"]).select("node", "other"))
    label = materialize(components(edges.select(F.col("node").alias("u"), F.col("other").alias("v")), "vectors"), "vector-classes")

    inside = materialize(label.join(nodes, "node").select(F.col("component").alias("group"), F.size("unit").alias("dim"), "node", "copies", "unit"), "vector-classes")
    rest, core = dealt(inside, cosine, "vector-classes")
    links = compared(rest, cosine).select("node", "links")
    if core is not None:
        all_of = core.groupBy("group", "dim").agg(F.sum("copies").alias("all"))
        links = links.union(core.join(all_of, ["group", "dim"]).select("node", (F.col("all") - F.col("copies")).alias("links")))
    links = links.groupBy("node").agg(F.sum("links").alias("links"))

    labelled = nodes.select("node", "h0", "h1", "first", "copies").join(label, "node", "left").withColumn("component", F.coalesce("component", "node")).join(links, "node", "left")
    least = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    told = labelled.join(least, "component").select("h0", "h1", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", F.lit(True).alias("linkable"))
    out = rows.select("id", "h0", "h1", F.col("unit").isNotNull().alias("sound")).join(told, ["h0", "h1"], "left").withColumn("sound", F.col("sound") & F.col("linkable").isNotNull())
    own = F.when(F.col("sound"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.when(F.col("sound"), F.col("n_links")).otherwise(0).alias("n_links"), own.alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))

