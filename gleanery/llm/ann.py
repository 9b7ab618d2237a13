"""Nearest neighbours by score-aware (anisotropic) product quantisation, four-bit scans and exact reranking.

Euclidean search is maximum inner product search: |q-x|^2 = |q|^2 - 2 (q.x - |x|^2 / 2), wherever the origin lies; it is put
into the sample's median. With y for what x is coded as and e for the rest, it is |q|^2 - 2 (q.y - (|y|^2 + |e|^2) / 2) - 2 (q-y).e: all but the
last term, which is small near q, is known exactly. The codes are of codebooks of 16 centres per subspace, fitted
and assigned under a loss that weighs the residual's part parallel to the vector ``1 + eta`` times as much as the rest, because that
part is what moves the largest inner products.

Codebooks and the centres of coarse cells are fitted on a bounded sample; what a cell's centre leaves of a valid row is coded, two four-bit
codes to a byte, and written with the cell (inside a cell the centre's part is the same for all). How many cells a query probes follows from the sample: as many as hold ``goal`` of the
neighbours there. Queries are joined to their cells by key: a group is a chunk of a cell's rows and a block of the queries that
probe it, both of bounded size, however many rows share a cell. A byte indexes a table of 256 sums per pair of subspaces. The best
of a group's distinct vectors (a share of them, ``share`` in all, ``rerank`` at least) are measured exactly on the original
components, and a query's merge reads ``k`` rows per group.

What the scan finds is an upper limit of the distance of a query's ``k``-th neighbour. A second pass makes the search exact: it reaches every cell whose
centre and radius allow a row within the limit, bounds each row there from below by what its code stands for and how far that is
from the row (|q-x| >= |q-y| - |e|), and measures those that may lie within. So codes that tell rows badly apart (clusters finer than the
codes, a few rows far outside, queries unlike the sample) cost time and not neighbours.

On data without any clusters a query has to reach most cells: then work is queries times rows, spread over groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

SAMPLE = 8192
CENTRES = 16
CELL_ROWS, CELLS = 8192, 1024  # rows of a cell aimed at; cells at most
CHUNK_ROWS, QUERY_BLOCK, REACH_BLOCK = 8192, 4096, 16384
GOAL, PROBED = 0.98, 256  # share of a sampled query's neighbours that its cells hold; queries tried for that
FAR = 1e15  # components beyond this many deviations are coded as that; they are measured exactly
RESULT = "query_id long, rank int, vec_id long, score double"


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str, dim: int | None = None) -> tuple[DataFrame, int | None]:
    """``vec_id, vec`` of rows that take part, and their dimension (default: the most frequent length).

    Left out: null ids, null vectors, other lengths, null or non-finite components, all-zero vectors. Components keep their
    type if it is float or double, others become double.
    """
    kind = vectors.schema[vector_col].dataType.simpleString()
    vec = F.col(f"`{vector_col}`") if kind in ("array<float>", "array<double>") else F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vec.alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0))
    if dim is None:
        top = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
        dim = top["n"] if top else None
    return rows.where(F.size("vec") == F.lit(dim)), dim


def cells_of(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Centres of coarse cells: k-means from the first rows of the sample."""
    centres = sample[:cells].copy()
    for _ in range(rounds):
        own = nearest_cells(sample, centres, 1)[:, 0]
        count = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def nearest_cells(x: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """The cells nearest to each row, nearest first."""
    out = np.empty((len(x), probes), np.int32)
    half = (centres**2).sum(1) / 2
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = np.argsort(half - x[at : at + 4096] @ centres.T, 1, kind="stable")[:, :probes]
    return out


class Quantiser:
    """Anisotropic product quantiser: ``books[s, c]`` are the 16 centres of subspace ``s``; with the cells, their probes and the origin."""

    def __init__(self, books: np.ndarray, dim: int, eta: float):
        self.books, self.dim, self.eta = books, dim, eta
        self.origin, self.scale = np.zeros(dim), 1.0
        self.cells, self.probes = np.zeros((1, dim)), 1

    def placed(self, vectors: np.ndarray) -> np.ndarray:
        """Original vectors as they are coded: from the origin, by the scale."""
        with np.errstate(over="ignore"):
            return np.clip((vectors.astype(np.float64) - self.origin) / self.scale, -FAR, FAR)

    def blur(self, vectors: np.ndarray) -> np.ndarray:
        """At most so far are placed vectors from where they would be without rounding; infinite for those that are cut off."""
        with np.errstate(over="ignore", invalid="ignore"):
            near = (np.abs(vectors / self.scale) + np.abs(self.origin / self.scale)).sum(1) * 1e-13 + 1e-300
            cut = np.abs((vectors.astype(np.float64) - self.origin) / self.scale).max(1) >= FAR
        return np.where(cut | ~np.isfinite(near), np.inf, near)

    @staticmethod
    def split(x: np.ndarray, parts: int) -> np.ndarray:
        """Rows as (row, subspace, component), zero-padded to an even number of equal subspaces."""
        width = -(-x.shape[1] // parts)
        return np.pad(x, ((0, 0), (0, width * parts - x.shape[1]))).reshape(len(x), parts, width)

    def _directions(self, vectors: np.ndarray) -> np.ndarray:
        x = self.split(vectors.astype(np.float64), len(self.books))
        return x / np.maximum(np.sqrt((x**2).sum((1, 2), keepdims=True)), 1e-300)

    @classmethod
    def fit(cls, sample: np.ndarray, rests: np.ndarray | None = None, width: int = 2, threshold: float = 0.2, rounds: int = 8, seed: int = 7) -> Quantiser:
        """Alternate assignment and weighted least squares for the centres, on a bounded sample.

        ``rests`` (default: the vectors themselves) are coded, what is left of the vectors beside their cells' centres; the
        directions that weigh residuals are those of the vectors.
        """
        rests = sample if rests is None else rests
        dim = sample.shape[1]
        parts = -(-dim // width)
        parts += parts % 2
        x = cls.split(rests.astype(np.float64), parts)
        chance = np.random.default_rng(seed)
        start = x[chance.choice(len(x), CENTRES, replace=len(x) < CENTRES)]
        books = start.transpose(1, 0, 2) + chance.normal(0, 1e-6, (parts, CENTRES, x.shape[2]))
        eta = max(0.0, (dim - 1) * threshold**2 / (1 - threshold**2))
        made = cls(books, dim, eta)
        along = made._directions(sample)
        for turn in range(rounds):
            made.eta = eta if turn >= 2 else 0.0  # plain k-means first
            made._move(x, along, made.codes(sample, rests))
        made.eta = eta
        return made

    def codes(self, vectors: np.ndarray, rests: np.ndarray | None = None, sweeps: int = 2) -> np.ndarray:
        """Codes by coordinate descent on the anisotropic loss, started from the nearest centres."""
        parts = len(self.books)
        x = self.split((vectors if rests is None else rests).astype(np.float64), parts)
        plain = [((x[:, s, None, :] - self.books[s][None]) ** 2).sum(2) for s in range(parts)]
        codes = np.stack([p.argmin(1) for p in plain], 1)
        if not self.eta:
            return codes
        u = self._directions(vectors)
        along = [((x[:, s, None, :] - self.books[s][None]) * u[:, s, None, :]).sum(2) for s in range(parts)]
        row = np.arange(len(x))
        total = sum(along[s][row, codes[:, s]] for s in range(parts))
        for _ in range(sweeps):
            for s in range(parts):
                rest = total - along[s][row, codes[:, s]]
                codes[:, s] = (plain[s] + self.eta * (rest[:, None] + along[s]) ** 2).argmin(1)
                total = rest + along[s][row, codes[:, s]]
        return codes

    def _move(self, x: np.ndarray, u: np.ndarray, codes: np.ndarray) -> None:
        parts, width = len(self.books), x.shape[2]
        residual = x - np.stack([self.books[s][codes[:, s]] for s in range(parts)], 1)
        along = (residual * u).sum(2)
        total = along.sum(1)
        for s in range(parts):
            rest = total - along[:, s]
            pull = x[:, s] + self.eta * u[:, s] * (rest + (x[:, s] * u[:, s]).sum(1))[:, None]
            outer = np.eye(width)[None] + self.eta * u[:, s, :, None] * u[:, s, None, :]
            for c in range(CENTRES):
                own = codes[:, s] == c
                if own.any():
                    self.books[s, c] = np.linalg.solve(outer[own].sum(0), pull[own].sum(0))

    @staticmethod
    def packed(codes: np.ndarray) -> np.ndarray:
        """Two codes to a byte."""
        return (codes[:, 0::2] | codes[:, 1::2] << 4).astype(np.uint8)

    def restored(self, packed: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        codes = np.stack([packed & 15, packed >> 4], 2).reshape(len(packed), -1)
        return self.books[np.arange(codes.shape[1]), codes].reshape(len(codes), -1)[:, : self.dim]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(query, byte position, byte) inner products: sums of the two four-bit tables of a byte."""
        q = self.split(queries.astype(np.float64), len(self.books))
        single = np.einsum("qsw,scw->qsc", q, self.books).astype(np.float32)
        return (single[:, 0::2, None, :] + single[:, 1::2, :, None]).reshape(len(q), -1, CENTRES * CENTRES)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def fitted(sample: np.ndarray, rows: int, goal: float = GOAL, cell_rows: int = CELL_ROWS) -> Quantiser:
    """Codebooks, cells and probes from a sample of original vectors; ``rows`` there are in all."""
    sample = np.unique(sample.astype(np.float64), axis=0)
    sample = sample[np.random.default_rng(3).permutation(len(sample))]
    origin = np.median(sample, 0)
    with np.errstate(over="ignore"):
        spread = np.sort(np.abs(sample - origin).max(1))
    scale = spread[len(spread) // 2] or spread[-1] or 1.0
    if not np.isfinite(scale):
        scale = float(np.finfo(float).max)
    with np.errstate(over="ignore"):
        x = np.clip((sample - origin) / scale, -FAR, FAR)
    cells = max(1, min(CELLS, len(x) // 8, -(-rows // cell_rows)))
    centres = cells_of(x, cells)
    own = nearest_cells(x, centres, 1)[:, 0]
    made = Quantiser.fit(x, x - centres[own])
    made.origin, made.scale, made.cells = origin, scale, centres
    if cells > 1:
        asked = x[:PROBED]
        near = np.argsort((x**2).sum(1) / 2 - asked @ x.T, 1)[:, :11]
        order = nearest_cells(asked, centres, cells)
        place = np.argsort(order, 1)  # of each cell in the query's order
        ranks = np.sort(np.take_along_axis(place, own[near].astype(np.int64), 1)[:, 1:].ravel())
        made.probes = int(ranks[min(len(ranks) - 1, math.ceil(goal * len(ranks)) - 1)]) + 1
    return made


INDEX = "cell int, spot long, vec_id long, vec {kind}, code binary, off double"


def build_index(rows: DataFrame, dim: int, sample: int = SAMPLE, goal: float = GOAL, cell_rows: int = CELL_ROWS) -> tuple[Quantiser, DataFrame]:
    """Fit on the ``sample`` rows that come first in hash order and write all rows with their cells and codes."""
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(sample).toArrow()
    total = some.num_rows if some.num_rows < sample else rows.count()
    coder = fitted(_matrix(some.column("vec").combine_chunks(), dim), total, goal, cell_rows)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        spot = TaskContext.get().partitionId() << 40
        for b in batches:
            if b.num_rows:
                x = coder.placed(_matrix(b.column("vec"), dim))
                cell = nearest_cells(x, coder.cells, 1)[:, 0]
                packed = Quantiser.packed(coder.codes(x, x - coder.cells[cell]))
                off = np.sqrt(((x - coder.cells[cell]) ** 2).sum(1)) + coder.blur(_matrix(b.column("vec"), dim).astype(np.float64))
                columns = [pa.array(cell, pa.int32()), pa.array(np.arange(spot, spot + len(x))), *b.columns, pa.array([p.tobytes() for p in packed], pa.binary()), pa.array(off)]
                yield pa.RecordBatch.from_arrays(columns, ["cell", "spot", "vec_id", "vec", "code", "off"])
                spot += len(x)

    kind = rows.schema["vec"].dataType.simpleString()
    return coder, materialise(rows.select("vec_id", "vec").mapInArrow(coded, INDEX.format(kind=kind)), "ann")


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean, in double precision, also where squares would overflow or vanish."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        gap = x - q
        most = np.abs(gap).max(1)
        dist = np.sqrt((gap**2).sum(1))
        odd = ((most > 1e150) | (most < 1e-150)) & (most > 0) & (most < np.inf)
        if odd.any():
            dist[odd] = most[odd] * np.sqrt(((gap[odd] / most[odd, None]) ** 2).sum(1))
        dist[most == np.inf] = np.inf
    return dist


def _best(ids: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    keep = np.lexsort((ids, dist))[:k]
    return ids[keep], dist[keep]


def _scan(coder, dim: int, k: int, share: float):
    """A chunk's ``k`` nearest of each query of a block."""

    def run(key: tuple, rows: pa.Table, asked: pa.Table) -> pa.Table:
        found: tuple[list, ...] = ([], [], [])
        if rows.num_rows and asked.num_rows:
            own = coder.value
            ids, vec = rows.column("vec_id").to_numpy(), _matrix(rows.column("vec").combine_chunks(), dim)
            code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            query_ids, queries = asked.column("query_id").to_numpy(), _matrix(asked.column("q").combine_chunks(), dim).astype(np.float64)
            # Copies of a vector count once in the scan; of each, the ids that could be among the k are kept.
            order = np.argsort(ids, kind="stable")
            ids, vec, code = ids[order], np.ascontiguousarray(vec[order]) + 0.0, code[order]  # + 0.0: one zero only
            _, first, group = np.unique(vec.view(np.dtype((np.void, vec.dtype.itemsize * dim))).ravel(), return_index=True, return_inverse=True)
            by_group = np.argsort(group, kind="stable")
            starts = np.searchsorted(group[by_group], np.arange(len(first) + 1))
            vec, code = vec[first].astype(np.float64), code[first]
            # What the codes stand for, and exactly how far that is from the vector: near a query little else of the distance is left out.
            stands = own.cells[key[0].as_py()] + own.restored(code)
            half = (stands**2 + (own.placed(vec) - stands) ** 2).sum(1) / 2
            few = min(len(first), math.ceil(share * len(first)) + k + 1)
            for at in range(0, len(query_ids), 64):
                tables = own.tables(own.placed(queries[at : at + 64]))
                score = np.repeat(-half[None].astype(np.float32), len(tables), 0)
                for p in range(code.shape[1]):
                    score += tables[:, p][:, code[:, p]]
                near = np.argpartition(-score, few - 1, 1)[:, :few]
                for i, best in enumerate(near, at):
                    dist = distances(vec[best], queries[i])
                    # k + 1 copies cover the query's own row.
                    members = [ids[by_group[starts[g] : min(starts[g] + k + 1, starts[g + 1])]] for g in best]
                    each = np.concatenate(members)
                    other = each != query_ids[i]
                    top = _best(each[other], np.repeat(dist, [len(m) for m in members])[other], k)
                    for column, value in zip(found, (np.full(len(top[0]), query_ids[i]), *top), strict=True):
                        column.append(value)
        kinds = (np.int64, np.int64, np.float64)
        return pa.table({c: np.concatenate([np.zeros(0, t), *x]) for c, t, x in zip(("query_id", "vec_id", "score"), kinds, found, strict=True)})

    return run


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs of rows, less what rounding may have added."""
    a, b = (x**2).sum(1)[:, None], (y**2).sum(1)[None]
    return np.maximum(a - 2 * (x @ y.T) + b - (1e-13 + 4e-16 * x.shape[1]) * (a + b), 0.0)


def reached(coder: Quantiser, queries: np.ndarray, limits: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """(query, cell): whether a cell of such a radius (negative: empty) may hold a row within the query's limit."""
    gap = np.sqrt(squares(coder.placed(queries), coder.cells)) - coder.blur(queries)[:, None]
    with np.errstate(over="ignore"):
        return (radii >= 0) & (gap * (1 - 1e-9) - radii * (1 + 1e-9) <= (limits / coder.scale)[:, None])


def _measure(coder, dim: int, k: int):
    """A chunk's ``k`` nearest of each query of a block, of the rows that may lie within the query's limit."""

    def run(key: tuple, rows: pa.Table, asked: pa.Table) -> pa.Table:
        found: tuple[list, ...] = ([], [], [])
        if rows.num_rows and asked.num_rows:
            own = coder.value
            centre = own.cells[key[0].as_py()]
            ids, vec = rows.column("vec_id").to_numpy(), _matrix(rows.column("vec").combine_chunks(), dim).astype(np.float64)
            code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            rest, stands = own.placed(vec) - centre, own.restored(code)
            left = np.sqrt(((rest - stands) ** 2).sum(1)) * (1 + 1e-9) + own.blur(vec)
            query_ids, queries = asked.column("query_id").to_numpy(), _matrix(asked.column("q").combine_chunks(), dim).astype(np.float64)
            with np.errstate(over="ignore"):
                limits = asked.column("limit").to_numpy() / own.scale * (1 + 1e-9)
            for at in range(0, len(query_ids), 64):
                some = queries[at : at + 64]
                least = np.sqrt(squares(own.placed(some) - centre, stands)) - left - own.blur(some)[:, None]
                within = least <= limits[at : at + 64, None]
                for i, may in enumerate(within, at):
                    may = np.flatnonzero(may & (ids != query_ids[i]))
                    top = _best(ids[may], distances(vec[may], queries[i]), k) if len(may) else (ids[:0], np.zeros(0))
                    for column, value in zip(found, (np.full(len(top[0]), query_ids[i]), *top), strict=True):
                        column.append(value)
        kinds = (np.int64, np.int64, np.float64)
        return pa.table({c: np.concatenate([np.zeros(0, t), *x]) for c, t, x in zip(("query_id", "vec_id", "score"), kinds, found, strict=True)})

    return run


def nearest(
    vectors: DataFrame,
    queries: DataFrame | None = None,
    k: int = 10,
    rerank: int = 400,
    share: float = 0.01,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 100,
    dim: int | None = None,
    goal: float = GOAL,
    cell_rows: int = CELL_ROWS,
    exact: bool = True,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows, by exact Euclidean distance in double precision.

    ``queries`` (default: rows whose id is divisible by ``every``) are searched against all valid rows but those of their
    own id. Ties go to the smaller id. Fewer than ``k`` candidates give fewer rows; no valid vector gives no
    rows. Rows that take no part: see ``valid_vectors``. Copies of a vector are scanned once a group, so they
    cannot crowd others out. Repeated ids are separate candidates; of queries with one id the smallest vector asks. Extra columns are ignored.

    ``goal`` (1: every cell) and ``share`` (1: every row) say how much the scan probes and measures; with ``exact=False`` what it finds is returned.
    """
    spark = vectors.sparkSession
    rows, dim = valid_vectors(vectors, id_col, vector_col, dim)
    if dim is None:
        return spark.createDataFrame([], RESULT)
    coder, index = build_index(rows, dim, goal=goal, cell_rows=cell_rows)
    asked = index.where(F.col("vec_id") % every == 0) if queries is None else valid_vectors(queries, id_col, vector_col, dim)[0]
    asked = asked.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vec").alias("q"))
    counts = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("asking"), F.max("off").alias("radius")).collect()  # a row per cell
    total = sum(r["n"] for r in counts)
    asking = sum(r["asking"] for r in counts) if queries is None else asked.count()
    probes = len(coder.cells) if goal >= 1 else coder.probes
    blocks = max(1, math.ceil(asking * min(1.0, 2 * probes / len(coder.cells)) / QUERY_BLOCK))
    chunks = [0] * len(coder.cells)
    for r in counts:
        chunks[r["cell"]] = -(-r["n"] // CHUNK_ROWS)
    held, chunks_of = spark.sparkContext.broadcast(coder), F.array(*[F.lit(n) for n in chunks])

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cells = nearest_cells(held.value.placed(_matrix(b.column("q"), dim)), held.value.cells, probes)
                yield b.append_column("cells", pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel()), probes).cast(pa.list_(pa.int32())))

    kind = asked.schema["q"].dataType.simpleString()
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    probed = asked.mapInArrow(probing, f"query_id long, q {kind}, cells array<int>").select("query_id", "q", block.alias("block"), F.explode("cells").alias("cell"))
    several = F.element_at(chunks_of, F.col("cell") + 1)
    probed = probed.where(several > 0).select("query_id", "q", "block", "cell", F.explode(F.sequence(F.lit(0), several - 1)).alias("chunk"))
    chunk = F.pmod(F.xxhash64("spot"), several.cast("long")).cast("int")
    scanned = index.select("vec_id", "vec", "code", "cell", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    key = ["cell", "chunk", "block"]
    budget = min(1.0, max(share, rerank / max(1, total)) * len(coder.cells) / probes)  # of the rows that are probed
    found = scanned.groupBy(*key).cogroup(probed.groupBy(*key)).applyInArrow(_scan(held, dim, k, budget), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    if not exact or goal >= 1 and share >= 1:
        return found
    # With fewer than k found there is no limit.
    limits = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("score")).alias("limit"))
    limited = materialise(asked.join(limits, "query_id", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf")))), "limits")
    radii = np.full(len(coder.cells), -1.0)
    for r in counts:
        radii[r["cell"]] = r["radius"]

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                which = reached(held.value, _matrix(b.column("q"), dim).astype(np.float64), b.column("limit").to_numpy(), radii)
                cells = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], which.sum(1).cumsum()]), pa.int32()), pa.array(np.nonzero(which)[1], pa.int32()))
                yield b.append_column("cells", cells)

    reach = limited.select("query_id", "q", "limit").mapInArrow(reaching, f"query_id long, q {kind}, limit double, cells array<int>").withColumn("cell", F.explode("cells")).drop("cells")
    block_counts = [0] * len(coder.cells)
    for r in reach.groupBy("cell").count().collect():  # a row per cell
        block_counts[r["cell"]] = -(-r["count"] // REACH_BLOCK)
    several_blocks = F.element_at(F.array(*[F.lit(n) for n in block_counts]), F.col("cell") + 1)
    reach = reach.withColumn("block", F.pmod(F.xxhash64("query_id"), several_blocks.cast("long")).cast("int"))
    reach = reach.withColumn("chunk", F.explode(F.sequence(F.lit(0), several - 1)))
    rows = index.where(several_blocks > 0).select("vec_id", "vec", "code", "cell", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), several_blocks - 1)).alias("block"))
    found = rows.groupBy(*key).cogroup(reach.groupBy(*key)).applyInArrow(_measure(held, dim, k), "query_id long, vec_id long, score double")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
