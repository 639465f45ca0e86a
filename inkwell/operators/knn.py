"""Nearest neighbours: exact for a stated set of queries, and by an index of short codes with an exact second look."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Bytes of query vectors that are broadcast at a time.
QUERY_BYTES = 64 << 20
#: Distances that a task holds at a time.
ROOM = 4_000_000
#: Rows on which the steps of the codes are fitted, and the steps of one value.
FIT_ROWS = 20_000
STEPS = 16
DIGITS = 6


def require_width(vectors: DataFrame, vector: str, width: int, what: str = "vector") -> DataFrame:
    """The same rows; an error names the first vector of another width.  Null vectors are no vectors and pass."""
    wrong = vectors.where(F.col(vector).isNotNull() & (F.size(vector) != width)).select(F.size(vector).alias("n")).take(1)
    if wrong:
        raise ValueError(f"{what} has {wrong[0]['n']} values instead of {width}")
    return vectors


def _matrix(values) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in values]) if len(values) else np.empty((0, 0))


def _scores(rows: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Smaller is nearer, for either metric; one matrix product, so nothing is as large as queries x rows x width."""
    dots = queries @ rows.T
    if metric == "l2":
        square = (queries**2).sum(1)[:, None] + (rows**2).sum(1)[None] - 2 * dots
        return np.sqrt(np.maximum(square, 0.0))
    size = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None]
    with np.errstate(invalid="ignore", divide="ignore"):
        return -dots / size


def _by_width(ids, vectors, groups) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(width, ids, matrix, groups) of the vectors of each width."""
    widths = np.array([len(v) for v in vectors], int)
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        yield width, ids[own], _matrix([vectors[i] for i in own]), groups[own]


class Best:
    """The k best of what it has seen for each of some queries; ties go to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = [np.empty(0)] * queries
        self.ids: list[np.ndarray] = [np.empty(0, object)] * queries
        self.last = np.full(queries, np.inf)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        """Only queries for which some score reaches their k-th best are looked at one by one."""
        order = ids.astype(str) if ids.dtype == object else ids
        with np.errstate(invalid="ignore"):
            near = score <= self.last[:, None]
        for q in np.flatnonzero(near.any(axis=1)).tolist():
            hits = np.flatnonzero(near[q])
            if len(hits) > self.k:
                reach = np.partition(score[q, hits], self.k - 1)[self.k - 1]
                hits = hits[score[q, hits] <= reach]
                hits = hits[np.lexsort((order[hits], score[q, hits]))[: self.k]]
            own, names = np.r_[self.score[q], score[q, hits]], np.r_[self.ids[q], ids[hits].astype(object)]
            keys = names.astype(str) if ids.dtype == object else names.astype(np.int64)
            best = np.lexsort((keys, own))[: self.k]
            self.score[q], self.ids[q] = own[best], names[best]
            if len(best) == self.k:
                self.last[q] = own[best[-1]]


def _nearest(batches: Iterator[pd.DataFrame], shared, k: int, metric: str, read=None, grouped: bool = False) -> Iterator[pd.DataFrame]:
    """The k best rows of a whole partition for each query that was sent out."""
    asked = {width: rest for width, *rest in shared.value}
    best = {width: Best(len(ids), k) for width, (ids, _, _) in asked.items()}
    for batch in batches:
        vectors = batch["v"].tolist() if read is None else [read(v) for v in batch["v"]]
        for width, ids, matrix, groups in _by_width(batch["id"].to_numpy(), vectors, batch["g"].to_numpy(object)):
            if width not in asked:
                continue
            asked_ids, asked_matrix, asked_groups = asked[width]
            step = max(1, ROOM // max(1, len(asked_ids)))
            for start in range(0, len(ids), step):
                some = slice(start, start + step)
                score = np.round(_scores(matrix[some], asked_matrix, metric), DIGITS) + 0.0
                if grouped:  # strangers and the query itself are no neighbours
                    score[(asked_groups[:, None] != groups[None, some]) | (asked_ids[:, None] == ids[None, some])] = np.nan
                best[width].add(score, ids[some])
    for width, (ids, _, _) in asked.items():
        for q, (score, names) in enumerate(zip(best[width].score, best[width].ids)):
            if len(score):
                yield pd.DataFrame({"query_id": [ids[q]] * len(score), "id": names, "score": score})


def _sent(asked: DataFrame, query_bytes: int) -> Iterator:
    """The queries in blocks of bounded size, by width; one block unless they are more than is broadcast at a time."""
    n, width = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, -(-n * (width or 1) * 8 // query_bytes))
    for number in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number)
        rows = part.collect()
        ids, groups = np.empty(len(rows), object), np.empty(len(rows), object)
        ids[:], groups[:] = [r["query_id"] for r in rows], [r["g"] for r in rows]
        if rows or not number:
            yield asked.sparkSession.sparkContext.broadcast(list(_by_width(ids, [r["v"] for r in rows], groups)))


def _kind(df: DataFrame, name: str) -> str:
    return "string" if isinstance(df.schema[name].dataType, T.StringType) else "bigint"


def _whole(v: Column) -> Column:
    """Whether a vector has values and none of them is null."""
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull()), F.lit(False))


def _asked(queries: DataFrame, query_id: str, vector: str, group: str | None = None) -> DataFrame:
    own = F.lit(None).cast("string") if group is None else F.col(group)
    return queries.where(F.col(query_id).isNotNull() & _whole(F.col(vector))).select(F.col(query_id).alias("query_id"), F.col(vector).alias("v"), own.alias("g"))


def _ranked(near: DataFrame, k: int, metric: str) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy("score", "id")
    score = F.col("score") if metric == "l2" else -F.col("score") + 0.0
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "id", score.alias("score"), "rank")


def knn(rows: DataFrame, row_id: str, queries: DataFrame, query_id: str, vector: str, k: int, metric: str = "l2", width: int | None = None, query_bytes: int = QUERY_BYTES, group: str | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k nearest rows of each query; ties go to the smaller id.

    ``score`` is the L2 distance or the cosine, rounded.  The rows are read once while the queries fit into
    ``query_bytes``, else once per block of them; each partition keeps its k best per query, and these few meet in
    a window.  A query only meets rows of its own width.  With ``width`` a query of another width is an error.  With
    ``group`` a query only meets rows with its own value there, and not the row with its own id.
    Rows and queries without an id, or whose vector is null, empty, holds a null or (cosine) has no length, have no
    neighbours.
    """
    if width is not None:
        require_width(queries, vector, width, "a query")
    schema = f"query_id {_kind(queries, query_id)}, id {_kind(rows, row_id)}, score double"
    there = _asked(rows, row_id, vector, group).withColumnRenamed("query_id", "id")
    near = None
    for shared in _sent(_asked(queries, query_id, vector, group), query_bytes):
        found = there.mapInPandas(lambda batches, shared=shared: _nearest(batches, shared, k, metric, grouped=group is not None), schema).where(~F.isnan("score"))
        near = found if near is None else near.unionByName(found)
    return _ranked(near, k, metric)


class Codes:
    """Each value of a vector in one of ``STEPS`` steps between a low and a high value, two to a byte."""

    def __init__(self, low: float, high: float):
        self.low, self.step = low, (high - low) / STEPS or 1.0

    def write(self, vector) -> bytes:
        place = np.clip((np.asarray(vector, np.float64) - self.low) // self.step, 0, STEPS - 1).astype(np.uint8)
        pairs = np.append(place, np.uint8(0))[: len(place) + len(place) % 2].reshape(-1, 2)
        return (pairs[:, 0] << 4 | pairs[:, 1]).tobytes()

    def read(self, code: bytes, width: int) -> np.ndarray:
        flat = np.frombuffer(code, np.uint8)
        place = np.stack([flat >> 4, flat & 15], axis=1).reshape(-1)[:width]
        return self.low + (place + 0.5) * self.step


def fit_codes(rows: DataFrame, vector: str, fit_rows: int = FIT_ROWS) -> Codes:
    """Steps between the outer hundredths of the values of about ``fit_rows`` rows, chosen by the hash of their vector."""
    there = rows.where(_whole(F.col(vector))).select(vector)
    share = min(1.0, fit_rows / max(1, there.count()))
    sample = there.where(F.pmod(F.xxhash64(vector), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    low, high = sample.select(F.explode(F.col(vector).cast("array<double>")).alias("x")).agg(F.percentile_approx("x", [0.01, 0.99])).first()[0] or (0.0, 1.0)
    return Codes(low, high)


def index(rows: DataFrame, row_id: str, vector: str, codes: Codes) -> DataFrame:
    """(id, width, code) of every row with a vector: an eighth of the bytes of floats; the table to write."""

    @F.pandas_udf("binary")
    def coded(vectors: pd.Series) -> pd.Series:
        return vectors.map(codes.write)

    there = rows.where(F.col(row_id).isNotNull() & _whole(F.col(vector)))
    return there.select(F.col(row_id).alias("id"), F.size(vector).alias("width"), coded(vector).alias("code"))


def search(indexed: DataFrame, rows: DataFrame, row_id: str, queries: DataFrame, query_id: str, vector: str, codes: Codes, k: int, looked_at: int, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, id, score, rank) by L2 distance: the codes of all rows are read, and the ``looked_at`` nearest by code are measured exactly.

    Only for these few are vectors fetched, by a join on their ids.
    """
    from inkwell.functions.vectors import l2

    schema = f"query_id {_kind(queries, query_id)}, id {_kind(rows, row_id)}, score double"
    asked = _asked(queries, query_id, vector)
    packed = indexed.select("id", F.struct("width", "code").alias("v"), F.lit(None).cast("string").alias("g"))
    near = None
    for shared in _sent(asked, query_bytes):

        def nearest(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            return _nearest(batches, shared, looked_at, "l2", lambda v: codes.read(v["code"], v["width"]))

        found = packed.mapInPandas(nearest, schema)
        near = found if near is None else near.unionByName(found)
    few = _ranked(near, looked_at, "l2").select("query_id", "id")
    vectors = rows.select(F.col(row_id).alias("id"), F.col(vector).alias("v"))
    exact = few.join(vectors, "id").join(asked.select("query_id", F.col("v").alias("q")), "query_id")
    return _ranked(exact.select("query_id", "id", F.round(l2(F.col("v"), F.col("q")), DIGITS).alias("score")), k, "l2")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, recall) of found against exact neighbours; an equally near row counts as found."""
    last = exact.groupBy("query_id").agg(F.max("score").alias("reach"), F.count("*").alias("n"))
    hits = found.join(last, "query_id").groupBy("query_id").agg(F.count(F.when(F.col("score") <= F.col("reach"), 1)).alias("hits"))
    return last.join(hits, "query_id", "left").select("query_id", F.round(F.coalesce("hits", F.lit(0)) / F.col("n"), 6).alias("recall"))
