"""Centroid clustering by delta Lloyd on integer vectors.

Vectors are turned to integers once and written once, packed BLOCK to a row and
bucketed by block. What changes from round to round is written beside them: one
row a block with every vector's owner, its squared distance, and the block's
signed transfers. Both tables have the same buckets, so that a round joins them
without an exchange and no vector moves after the first write.

A round compares a vector with the centroids that changed since the last one;
only where its own owner changed is it compared with all. A vector whose owner
stays where it was is no farther from it than from any other centroid that
stayed, so this is the full assignment. Owners gained and lost are added up as
integers: plus the vector for the new owner, minus it for the old one. The sums
of all clusters are kept and only these transfers, of at most k clusters and d
components a block, are aggregated; sums, counts and centroids are k times d
numbers, whatever the number of vectors.

Distances are exact: in float64 where all intermediate numbers stay below 2^53,
else in 64-bit integers. Vectors with a wrong number of components, or a null,
non-finite or outsized component (an integer beyond 2^26, whose distances need
not fit into 64 bits), are left out, null vectors too. Fewer vectors than k give
fewer centroids; equal first centroids are told apart by number, so the later
ones stay empty and where they are. Ids may repeat or be null: each row is a
vector. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import cut, ensure_checkpoint_dir, lean, partitions, remove_folder, table

K, DIMENSIONS, ROUNDS, SCALE, SEED = 40, 64, 5, 256, "2"
#: Vectors in a packed row, packed rows of a bucket, most buckets.
BLOCK, BUCKET_BLOCKS, MOST_BUCKETS = 1024, 64, 100_000
#: Largest integer component, and the one up to which distances in float64 are exact.
MOST, PLAIN = 1 << 26, 1 << 20


def integers(column: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> Column:
    """The vector as integers floor(scale * x), or null where it is not to be kept."""
    x = F.transform(F.col(column), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) <= MOST))
    return F.when((F.size(x) == dimensions) & fine, F.transform(x, lambda v: F.floor(v * scale).cast("int")))


def first_centroids(vectors: DataFrame, k: int, seed: str = SEED) -> np.ndarray:
    """The k vectors of rows (vec_id, v) with the smallest digests of their ids; of equal ids the smaller vectors first."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    found = vectors.select(digest.alias("digest"), "v").orderBy("digest", "v").limit(k).collect()
    return np.array([r["v"] for r in found], np.int64)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to rows of c, exact (int64)."""
    if not len(x) or not len(c):
        return np.zeros((len(x), len(c)), np.int64)
    if max(np.abs(x).max(), np.abs(c).max()) <= PLAIN:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x.astype(np.int64) - row) ** 2).sum(1) for row in c.astype(np.int64)], axis=1)


def reassigned(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(owners, distances, distances computed): nearest centroids, of equal ones the smaller number. Owner -1: none yet."""
    owner, distance = owner.copy(), distance.copy()
    lost = np.where(owner < 0, True, changed[owner])
    compared = 0
    some = np.flatnonzero(changed)
    for rows, columns, keep in ((np.flatnonzero(~lost), some, True), (np.flatnonzero(lost), np.arange(len(centroids)), False)):
        if not len(rows) or not len(columns):
            continue
        d = distances(x[rows], centroids[columns])
        compared += d.size
        at = d.argmin(1)
        best, who = d[np.arange(len(rows)), at], columns[at]
        if keep:
            better = (best < distance[rows]) | ((best == distance[rows]) & (who < owner[rows]))
            rows, best, who = rows[better], best[better], who[better]
        owner[rows], distance[rows] = who, best
    return owner, distance, compared


def transfers(x: np.ndarray, before: np.ndarray, after: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(clusters, their signed sums: number of vectors and components) of the vectors whose owner is another one."""
    moved = np.flatnonzero(before != after)
    sums = np.zeros((k, x.shape[1] + 1), np.int64)
    rows = np.concatenate((np.ones((len(moved), 1), np.int64), x[moved].astype(np.int64)), axis=1)
    np.add.at(sums, after[moved], rows)
    had = before[moved] >= 0
    np.subtract.at(sums, before[moved][had], rows[had])
    touched = np.union1d(after[moved], before[moved][had])
    return touched, sums[touched]


@dataclass
class Clustering:
    """Rows (vec_id, cluster, distance), the final centroids, and inertia by cluster; compared: distances computed in each assignment."""

    rows: DataFrame
    centroids: np.ndarray
    inertia: dict[int, int]
    compared: list[int] = field(default_factory=list)


class _Tables:
    """Packed tables with equal buckets by block, in the shared folder; each is removed when it is not needed any more."""

    def __init__(self, spark: SparkSession, buckets: int):
        ensure_checkpoint_dir(spark)
        self.spark, self.buckets = spark, buckets
        self.folder, self.tag = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/clusters-{uuid.uuid4().hex}", f"sieveline_{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        (df.write.bucketBy(self.buckets, "block").sortBy("block").option("path", f"{self.folder}/{name}").saveAsTable(f"{self.tag}_{name}"))
        return self.spark.table(f"{self.tag}_{name}")

    def drop(self, name: str) -> None:
        self.spark.sql(f"drop table if exists {self.tag}_{name}")
        remove_folder(self.spark, f"{self.folder}/{name}")

    def close(self, *names: str) -> None:
        for name in names:
            self.drop(name)
        remove_folder(self.spark, self.folder)


def _packed(vectors: DataFrame, dimensions: int) -> DataFrame:
    """Rows (block, ids, vectors) of up to BLOCK vectors from rows (vec_id, v)."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    @lean
    def pack(batches):
        ids, parts, held = [], [], 0

        def row():
            x = np.concatenate(parts)
            out = pa.RecordBatch.from_arrays([pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(ids[0].type)), pa.array([x.tobytes()], pa.binary())], names=["ids", "vectors"])
            ids.clear(), parts.clear()
            return out

        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                ids.append(part.column("vec_id"))
                parts.append(part.column("v").flatten().to_numpy().astype(np.int32).reshape(-1, dimensions))
                held += part.num_rows
                if held >= BLOCK:
                    yield row()
                    held = 0
        if held:
            yield row()

    return vectors.mapInArrow(pack, f"ids array<{kind}>, vectors binary").withColumn("block", F.monotonically_increasing_id())


_STATE = "block long, owner binary, distance binary, touched array<int>, sums array<array<long>>, compared long"


def _assigned(blocks: DataFrame, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
    """The next state of rows (block, vectors[, owner, distance])."""
    k, dimensions = centroids.shape

    @lean
    def run(batches):
        for batch in batches:
            out = []
            names = batch.schema.names
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column("vectors")[i].as_py(), np.int32).reshape(-1, dimensions)
                if "owner" in names:
                    owner, distance = np.frombuffer(batch.column("owner")[i].as_py(), np.int32), np.frombuffer(batch.column("distance")[i].as_py(), np.int64)
                else:
                    owner, distance = np.full(len(x), -1, np.int32), np.zeros(len(x), np.int64)
                new, d, compared = reassigned(x, owner, distance, centroids, changed)
                touched, sums = transfers(x, owner, new, k)
                out.append((batch.column("block")[i].as_py(), new.astype(np.int32).tobytes(), d.tobytes(), touched.tolist(), sums.tolist(), compared))
            types = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int64())), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(types)], names=["block", "owner", "distance", "touched", "sums", "compared"])

    return blocks.mapInArrow(run, _STATE)


def _moved(state: DataFrame, k: int, width: int) -> tuple[np.ndarray, int]:
    """The transfers of all blocks, by cluster, and the distances computed."""
    cells = state.select(F.explode(F.arrays_zip("touched", "sums")).alias("x")).select("x.touched", F.posexplode("x.sums").alias("part", "n"))
    out = np.zeros((k, width), np.int64)
    for row in cells.groupBy("touched", "part").agg(F.sum("n").alias("n")).collect():  # at most k times width rows
        out[row["touched"], row["part"]] = row["n"]
    return out, state.agg(F.sum("compared")).first()[0] or 0


def cluster(vectors: DataFrame, column: str = "embedding", k: int = K, dimensions: int = DIMENSIONS, rounds: int = ROUNDS, scale: int = SCALE, seed: str = SEED) -> Clustering:
    """Lloyd's rounds over rows (vec_id, column), and a last assignment."""
    spark = vectors.sparkSession
    kept = vectors.select("vec_id", integers(column, dimensions, scale).alias("v")).where("v is not null")
    centroids = first_centroids(kept, k, seed)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not len(centroids):
        return Clustering(spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long"), np.zeros((0, dimensions), np.int64), {})
    total = kept.count()
    tables = _Tables(spark, min(MOST_BUCKETS, max(partitions(spark), -(-total // (BLOCK * BUCKET_BLOCKS)))))
    blocks = tables.write(_packed(kept, dimensions).repartition(tables.buckets, "block"), "blocks")
    sums, changed, state, compared = np.zeros((len(centroids), dimensions + 1), np.int64), np.ones(len(centroids), bool), None, []
    for r in range(rounds + 1):
        source = blocks.select("block", "vectors")
        if state is not None:
            source = source.join(state.select("block", "owner", "distance"), "block")
        state = tables.write(_assigned(source, centroids, changed), f"state{r}")
        moved, n = _moved(state, len(centroids), dimensions + 1)
        compared.append(n)
        sums += moved
        if r:
            tables.drop(f"state{r - 1}")
        if r < rounds:
            new = np.where(sums[:, :1] > 0, np.floor_divide(sums[:, 1:], np.maximum(sums[:, :1], 1)), centroids)
            changed, centroids = (new != centroids).any(1), new
    own = blocks.select("block", "ids").join(state.select("block", "owner", "distance"), "block").select("ids", "owner", "distance")

    @lean
    def unpack(batches):
        for batch in batches:
            owner = np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in batch.column("owner")]) if batch.num_rows else np.empty(0, np.int32)
            distance = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in batch.column("distance")]) if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("ids").flatten(), pa.array(owner), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    rows = cut(own.mapInArrow(unpack, f"vec_id {kind}, cluster int, distance long"))
    inertia = {r["cluster"]: r["n"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    tables.close("blocks", f"state{rounds}")
    return Clustering(rows, centroids, inertia, compared)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster(table(spark, sf_dir, "embeddings"))
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    known = [(c, found.inertia[c], sum(found.inertia.values()), digest(found.centroids[c])) for c in sorted(found.inertia)]
    known = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """Each round in turn over all pairs of vectors and centroids."""
    near = "select v.rid, v.vec_id, v.x, arg_min(c.id, (d, c.id)) as cluster, min(d) as distance from v, {c} c, lateral (select list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.c[i]) * (v.x[i] - c.c[i])))::bigint as d) group by v.rid, v.vec_id, v.x"
    parts = [
        "v as materialized (select row_number() over () as rid, vec_id, list_transform(embedding, lambda e: floor(256 * e::double)::bigint) as x from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = 64)",
        "c0 as materialized (select row_number() over (order by sha256('2:' || coalesce(vec_id::varchar, '')), x) - 1 as id, x as c from v order by sha256('2:' || coalesce(vec_id::varchar, '')), x limit 40)",
    ]
    for r in range(ROUNDS):
        parts += [
            f"a{r} as materialized ({near.format(c=f'c{r}')})",
            f"m{r} as materialized (select cluster as id, list(q order by i) as c from (select cluster, i, floor(sum(x[i])::double / count(*))::bigint as q from a{r}, range(1, 65) t(i) group by cluster, i) group by cluster)",
            f"c{r + 1} as materialized (select c{r}.id, coalesce(m{r}.c, c{r}.c) as c from c{r} left join m{r} on m{r}.id = c{r}.id)",
        ]
    return f"with {', '.join(parts)}, a as materialized ({near.format(c=f'c{ROUNDS}')}) select vec_id, cluster::int as cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia, sha256(array_to_string(c.c, ',')) as centroid_sha256 from a join c{ROUNDS} c on c.id = a.cluster"


OP12_SQL = _sql()
