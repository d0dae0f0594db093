"""Near-duplicate vectors by product quantisation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import flatfiles
from assayer.llm.common import components, materialize

#: Vectors that the centroids and codes are fitted on, at most; all vectors are indexed.
SAMPLE = 20_000
SUBSPACES = 8
CODES = 64
#: Vectors on either side that one task compares at once, about.
CHUNK = 2_000


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    k = min(k, len(x))
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (np.square(centres).sum(1) - 2 * x @ centres.T).argmin(1)


class Index:
    """Coarse centroids, and codes of what is left of a vector in each subspace."""

    def __init__(self, sample: np.ndarray, n_lists: int):
        self.coarse = _kmeans(sample, n_lists)
        rest = sample - self.coarse[_nearest(sample, self.coarse)]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.books = [_kmeans(rest[:, c], CODES) for c in self.cuts]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, and the distance between each vector and what its codes stand for."""
        lists = _nearest(x, self.coarse)
        rest = x - self.coarse[lists]
        codes = np.stack([_nearest(rest[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], 1).astype(np.uint8)
        lost = sum(np.square(rest[:, c] - b[codes[:, m]]).sum(1) for m, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)))
        return lists, codes, np.sqrt(lost)

    def probes(self, x: np.ndarray, lists: np.ndarray, radius: float) -> np.ndarray:
        """Which lists may hold a vector within the radius: those whose border with the own list is as near.

        A vector of another list lies beyond the plane halfway between both centroids, so lists whose plane is farther
        away than the radius hold none; all others are probed.
        """
        far = np.square(x[:, None, :] - self.coarse[None]).sum(2) if len(self.coarse) < 8 else (
            np.square(x).sum(1)[:, None] + np.square(self.coarse).sum(1) - 2 * x @ self.coarse.T
        )
        own = far[np.arange(len(x)), lists][:, None]
        gap = np.sqrt(np.maximum(np.square(self.coarse).sum(1)[lists][:, None] + np.square(self.coarse).sum(1) - 2 * self.coarse[lists] @ self.coarse.T, 0))
        return far - own <= 2 * radius * gap + 1e-9

    def distances(self, x: np.ndarray, number: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of vectors to coded ones of a list, from a table per subspace."""
        rest = x - self.coarse[number]
        total = np.zeros((len(x), len(codes)), np.float32)
        for m, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            table = np.square(rest[:, None, c] - b[None]).sum(2).astype(np.float32)
            total += table[:, codes[:, m]]
        return total


def _unit(batch, name: str, dim: int) -> np.ndarray:
    flat = batch.column(name)
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    # scaling by the largest component first keeps very large and very small vectors in range
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.square(x).sum(1, keepdims=True))


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, sample: int = SAMPLE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors(vec_id, embedding, label)``.

    Vectors link when their labels are equal and not null and their cosine, in double precision, is at least
    ``threshold``. Equal vectors of a label are compared once, with their number. Centroids and codes are fitted on at
    most ``sample`` vectors, chosen by hash; every vector is put into a list. A vector meets its own list and each that
    can hold a link (see ``Index.probes``), always from the list of lower number, in blocks of about ``CHUNK`` by
    ``CHUNK``, so that hot lists are split. In a block, table distances drop pairs that are farther apart than the
    radius and what the codes lose; the others get their cosine. Each block tells every vector its number of links
    and a smallest linked vector, never pairs, so groups of copies cost their size.

    Vectors of each dimension have an index of their own and link among themselves. Vectors that are null, empty, zero,
    or hold null or non-finite components link with nothing; they get 0 links and their own id. Repeated rows count as
    links of each other. An empty table gives no rows; other columns are left out.
    """
    sound = (F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).__and__(
        F.expr("forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)")
    )
    narrow = vectors.select("vec_id", "embedding", "label")
    valid = narrow.where(F.coalesce(sound, F.lit(False)))
    dims = valid.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").collect()
    out = narrow.where(~F.coalesce(sound, F.lit(False))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    )
    for row in dims:
        out = _linked(valid.where(F.size("embedding") == row["dim"]), row["dim"], threshold, sample).union(out)
    return out


def _linked(valid: DataFrame, dim: int, threshold: float, sample: int) -> DataFrame:
    """The result for sound vectors of one dimension."""
    spark = valid.sparkSession
    reps = materialize(valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vectors")
    n_lists = max(1, min(256, int(reps.count() ** 0.5) // 8))
    fitted = reps.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("embedding").toArrow()
    index = spark.sparkContext.broadcast(Index(_unit(fitted, "embedding", dim), n_lists))
    radius = float(np.sqrt(2 - 2 * threshold)) + 1e-6

    coded_schema = pa.schema(
        [("list", pa.int32()), ("codes", pa.binary()), ("lost", pa.float64()), ("probes", pa.list_(pa.int32()))]
    )

    def code(batches):
        for batch in batches:
            x = _unit(batch, "embedding", dim)
            lists, codes, lost = index.value.encode(x)
            probe = index.value.probes(x, lists, radius) & (np.arange(len(index.value.coarse)) >= lists[:, None])
            probes = [np.flatnonzero(p).astype(np.int32) for p in probe]
            more = flatfiles.table({"list": lists, "codes": [c.tobytes() for c in codes], "lost": lost, "probes": probes}, coded_schema)
            yield pa.RecordBatch.from_arrays([*batch.columns, *more.columns], names=[*batch.schema.names, *coded_schema.names])

    element = "float" if dict(valid.dtypes)["embedding"] == "array<float>" else "double"
    coded = reps.select("rep", "label", "copies", F.col("embedding").cast(f"array<{element}>").alias("embedding")).mapInArrow(
        code,
        f"rep long, label {dict(valid.dtypes)['label']}, copies long, embedding array<{element}>, list int, codes binary, lost double, probes array<int>",
    )
    coded = materialize(coded, "vector-codes")
    there = coded.groupBy("label", "list").agg(F.count("*").alias("nd"))
    asked = coded.select("label", F.explode("probes").alias("list")).groupBy("label", "list").agg(F.count("*").alias("nq"))
    cells = there.join(asked, ["label", "list"]).select(
        "label", "list", F.expr(f"cast(nd div {CHUNK} + 1 as int)").alias("parts"), F.expr(f"cast(nq div {CHUNK} + 1 as int)").alias("shares")
    )
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = coded.join(cells, ["label", "list"]).select(
        "label", "list", F.pmod(F.xxhash64("rep"), "parts").cast("int").alias("part"), spread("shares").alias("share"), "rep", "copies", "embedding", "codes", "lost"
    )
    asking = (
        coded.select("label", F.col("list").alias("own"), F.explode("probes").alias("list"), "rep", "copies", "embedding")
        .join(cells, ["label", "list"])
        .select("label", "list", spread("parts").alias("part"), F.pmod(F.xxhash64("rep"), "shares").cast("int").alias("share"), "own", "rep", "copies", "embedding")
    )
    found_schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return found_schema.empty_table()
        number = left.column("list")[0].as_py()
        x, y = _unit(left, "embedding", dim), _unit(right, "embedding", dim)
        a, b = (t.column("rep").to_numpy() for t in (left, right))
        codes = np.frombuffer(b"".join(right.column("codes").to_pylist()), np.uint8).reshape(len(b), -1)
        reach = (radius + right.column("lost").to_numpy() + 1e-4) ** 2
        inside = left.column("own").to_numpy() == number
        ia, ib = [], []
        for k in range(0, len(a), 256):
            near = index.value.distances(x[k : k + 256], number, codes) <= reach
            # pairs of one list meet from both sides
            near &= ~(inside[k : k + 256, None] & (a[k : k + 256, None] >= b[None]))
            i, j = np.nonzero(near)
            exact = np.einsum("ij,ij->i", x[k + i], y[j]) >= threshold
            ia.append(k + i[exact])
            ib.append(j[exact])
        ia, ib = np.concatenate(ia), np.concatenate(ib)
        if not len(ia):
            return found_schema.empty_table()
        ca, cb = (t.column("copies").to_numpy() for t in (left, right))
        nodes, at = np.unique(np.concatenate([a[ia], b[ib]]), return_inverse=True)
        pa_, pb_ = at[: len(ia)], at[len(ia) :]
        links = np.zeros(len(nodes), np.int64)
        np.add.at(links, pa_, cb[ib])
        np.add.at(links, pb_, ca[ia])
        root = np.arange(len(nodes))
        while True:
            low = root.copy()
            np.minimum.at(low, pa_, root[pb_])
            np.minimum.at(low, pb_, root[pa_])
            low = low[low]
            if (low == root).all():
                break
            root = low
        return flatfiles.table_of({"rep": nodes, "links": links, "root": nodes[root]}, found_schema)

    keys = ["label", "list", "part", "share"]
    # both sides come from one table, so one of them takes columns of its own
    asking = asking.toDF(*(f"q_{c}" for c in asking.columns)).toDF(*asking.columns)
    found = materialize(
        asking.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(compare, "rep long, links long, root long"), "vector-links"
    )
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "vector-components")
    links = found.groupBy("rep").agg(F.sum("links").alias("links")).join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    known = reps.select("label", "embedding", "rep", "copies").join(links, "rep", "left")
    tied = valid.join(known, ["label", "embedding"]).select(
        "vec_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id")
    )
    return tied.withColumn("kept", F.col("vec_id") == F.col("component_id"))
