"""Exact nearest neighbours over stored cells: angles to a cell's centre bound the cosine of what is in it.

Each vector is stored in the cell of its nearest centre, with the angle between them. If a query stands at
an angle t from the centre and a vector at an angle a, the angle between query and vector is |t - a| at
least, so its cosine is cos(t - a) at most. A search scores the cells of the best bounds first, and then
only those cells, and in them those vectors, whose bound reaches the k-th score found.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators.nearest import Asked, Best, blocks, columns, matrices
from inkwell.operators.retrieve import top_k
from inkwell.sources.readers import Store, drop_folder, settled

#: Cells, at most, and rounds in which their centres are moved to the mean of what is in them.
CELLS = 256
ROUNDS = 2
#: Cells of each query that are scored first.
FIRST = 4
#: Vectors of a cell, in the order of their angles, that are scored or left out together.
RUN = 256
_SLACK = 1e-5  # scores are rounded to six digits


def _unit(vectors) -> np.ndarray:
    out = np.array([np.asarray(v, np.float64) for v in vectors]).reshape(len(vectors), -1)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


class VectorIndex:
    """Vectors of one number of dimensions in a folder: ``vectors`` by cell, and ``cells`` with each one's centre
    and greatest angle. Vectors that are null, of length 0 or have parts that are no finite number have no
    direction and are not stored."""

    def __init__(self, spark: SparkSession, folder: str, id_type: str = "string", cells: int = CELLS):
        self.spark, self.folder, self.cells, self.store = spark, folder.rstrip("/"), cells, Store(spark, folder)
        self.vectors_of = f"id {id_type}, vector array<float>, angle double, cell int"
        self.cells_of = "cell int, centre array<double>, reach double, n bigint"

    def build(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> None:
        """Store vectors in place of what was there. Centres begin at as many vectors, chosen by a hash of their
        ids, and move with all vectors; what goes to the driver is the centres."""
        finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector_col, lambda x: x != 0)
        rows = vectors.where(F.col(vector_col).isNotNull() & finite).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("vector"))
        first = rows.select("vector", F.xxhash64("id", "vector").alias("h")).orderBy("h").limit(self.cells).collect()
        centres = _unit([r.vector for r in first]) if first else np.zeros((0, 1))
        for _ in range(ROUNDS if first else 0):
            centres = self._moved(rows, centres)
        for table in ("vectors", "cells"):
            drop_folder(self.spark, f"{self.folder}/{table}")
        if not first:
            return

        def assign(frames):
            for frame in frames:
                near = _unit(frame["vector"]) @ centres.T
                cell = near.argmax(axis=1)
                yield frame.assign(angle=np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1)), cell=cell.astype(np.int32))

        rows.mapInPandas(assign, self.vectors_of).repartition("cell").write.partitionBy("cell").parquet(f"{self.folder}/vectors")
        centre = self.spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(centres)], "cell int, centre array<double>")
        reach = self.store.load("vectors", self.vectors_of).groupBy("cell").agg(F.max("angle").alias("reach"), F.count("*").alias("n"))
        reach.join(centre, "cell").select("cell", "centre", "reach", "n").write.parquet(f"{self.folder}/cells")

    def _moved(self, rows: DataFrame, centres: np.ndarray) -> np.ndarray:
        """Centres at the mean directions of their cells; sums are made in each task."""
        size = centres.shape[1]

        def sums(frames):
            total = np.zeros(centres.shape)
            for frame in frames:
                unit = _unit(frame["vector"])
                np.add.at(total, (unit @ centres.T).argmax(axis=1), unit)
            own = np.flatnonzero(np.abs(total).sum(axis=1))
            yield pd.DataFrame({"cell": np.repeat(own, size).astype(np.int32), "part": np.tile(np.arange(size, dtype=np.int32), len(own)), "total": total[own].ravel()})

        got = rows.select("vector").mapInPandas(sums, "cell int, part int, total double").groupBy("cell", "part").agg(F.sum("total").alias("total")).collect()  # cells times dimensions
        moved = np.zeros(centres.shape)
        for r in got:
            moved[r.cell, r.part] = r.total
        norm = np.linalg.norm(moved, axis=1)
        return np.where(norm[:, None] > 1e-9, moved / np.maximum(norm, 1e-9)[:, None], centres)

    def search(self, queries: DataFrame, k: int, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
        """The k nearest of each query by cosine (query_id, id, score, rank), ties by id, and for each query how
        many vectors there are and how many were scored. ``queries`` has query_id and query_vector; those without
        a direction have no rows."""
        vectors = self.store.load("vectors", self.vectors_of)
        cells = sorted(self.store.load("cells", self.cells_of).collect(), key=lambda r: r.cell)  # a bounded number
        asked = settled(queries.where(F.exists("query_vector", lambda x: x != 0)).select("query_id", "query_vector"), "asked")
        hits = looked = None
        for block in blocks(asked, k):
            turn, bound = self._bounds(block, cells)
            nth = np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1, kind="stable")
            best, least = None, np.full(len(block.ids), np.nan)
            for part in (nth < first, nth >= first):
                part = part & ~(bound + _SLACK < least[:, None])
                found = settled(self._scored(vectors, asked, block, k, cells, part, turn, least), "found")
                counts = found.where("scored is not null").select("query_id", "scored")
                looked = counts if looked is None else looked.unionByName(counts)
                found = found.where("scored is null").drop("scored")
                best = found if best is None else best.unionByName(found)
                if not (nth >= first).any():
                    break
                kth = top_k(best, k).where(F.col("rank") == k).select("query_id", "score").toArrow().to_pydict()  # of a block of queries
                kth = dict(zip(kth["query_id"], kth["score"], strict=True))
                least = np.array([np.nan if kth.get(q) is None else kth[q] for q in block.ids.to_pylist()], np.float64)
            best = top_k(best, k)
            hits = best if hits is None else hits.unionByName(best)
        stored = F.lit(sum(r.n for r in cells)).cast("long").alias("vectors")
        return hits, looked.groupBy("query_id").agg(F.sum("scored").alias("scored")).select("query_id", stored, "scored")

    @staticmethod
    def _bounds(asked: Asked, cells: list) -> tuple[np.ndarray, np.ndarray]:
        """Angles of queries and centres, and the greatest cosine that the cell may have; what has no angle is not bounded."""
        turn = np.full((len(asked.ids), len(cells)), np.nan)
        if cells and len(cells[0].centre) in asked.groups:
            at, raw, norm, _ = asked.groups[len(cells[0].centre)]
            with np.errstate(all="ignore"):
                turn[at] = np.arccos(np.clip(raw / norm[:, None] @ _unit([r.centre for r in cells]).T, -1, 1))
        reach = np.array([r.reach for r in cells])
        return turn, np.nan_to_num(np.cos(np.maximum(0.0, turn - reach)), nan=1.0)

    def _scored(self, vectors: DataFrame, queries: DataFrame, asked: Asked, k: int, cells: list, part: np.ndarray, turn: np.ndarray, least: np.ndarray) -> DataFrame:
        """The k best of each task for queries in their ``part`` of the cells, and how many vectors of them were
        scored; runs of vectors of like angles are left out where these bound them below ``least``."""
        number = {r.cell: n for n, r in enumerate(cells)}

        def run(batches):
            best, scored = Best(asked, k), np.zeros(len(asked.ids), np.int64)
            for batch in batches:
                ids, cell, angle = best.ids_of(batch.column("id")), batch.column("cell").to_numpy(), batch.column("angle").to_numpy()
                order = np.lexsort((angle, cell))
                for own in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if len(order) else []:
                    n = number[cell[own[0]]]
                    for lo in range(0, len(own), RUN):
                        some = own[lo : lo + RUN]
                        gap = np.maximum(0.0, np.maximum(angle[some[0]] - turn[:, n], turn[:, n] - angle[some[-1]]))
                        only = part[:, n] & ~(np.cos(gap) + _SLACK < least)
                        if only.any():
                            scored += only * len(some)
                            best.add(ids[some], matrices(batch.column("vector").take(pa.array(some))), only)
            for rows in best.batch():
                yield rows.append_column("scored", pa.nulls(len(rows), pa.int64()))
            met = np.flatnonzero(scored)
            yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(met)), pa.nulls(len(met), best.kind or pa.int64()), pa.nulls(len(met), pa.float64()), pa.array(scored[met])], names=["query_id", "id", "score", "scored"])

        read = vectors.where(F.col("cell").isin([r.cell for n, r in enumerate(cells) if part[:, n].any()])) if part.any() else vectors.where("false")
        return read.mapInArrow(run, columns(queries, vectors.schema["id"], counted=True))
