"""Embedding near-duplicates with an inverted multi-index.

* **Classes.** Equal vectors are one, with a count, so a group of copies costs as much as one vector.  Vectors of each length have
  an index of their own.
* **Grid.** A codebook of ``codes`` centroids for each half of the vectors, learned apart on unit vectors;
  a pair of codes is a cell, so the grid has ``codes**2`` cells.  Their number grows with that of the classes (about
  ``_RESIDENTS`` in a cell, until the sample allows no more codes).  The codebooks are fitted on at most
  ``sample`` classes (the documented bound, those of the smallest hash of their id); every one is indexed.
* **Traversal.** A vector visits the cells nearest to it in the order of the multi-sequence
  algorithm (ascending sum of its halves' distances to the cell's two centroids).  How many is calibrated:
  partners of sampled vectors at exactly the threshold similarity, the hardest case, must be
  in a visited cell with the share ``target_recall``.  Closer pairs are found more often.
* **Verification.** A visitor is compared with all residents of a cell in double precision.  A cell is cut
  into squares of at most ``block`` visitors and residents, one task row each, so no cell is gathered
  whole.  A square returns counts and a spanning forest of its links, never its pairs.
* **Counts.** A link that only one of its two vectors finds counts for both: a square counts it for the
  visitor, and for the resident unless that visits the visitor's own cell, where it is the visitor.

Vectors that are null, zero, or hold null or non-finite components link with nothing; so do rows without an id, and
vectors of different lengths.  Rows that repeat an id are one vector if they are equal, and never partners of their own id
otherwise.  Vectors are told equal by two 64-bit hashes.  Extra columns are not read; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkproof.llm.graph import components
from inkproof.llm.shared import stored


#: Classes in a cell, about, that the number of codes is chosen for; and rows of the sample behind each centroid at least.
_RESIDENTS, _BEHIND = 50, 20
_SAMPLE = 20_000


class Index(NamedTuple):
    first: np.ndarray  # centroids of the first half
    second: np.ndarray
    visits: int  # cells a vector visits

    @property
    def size(self) -> int:
        return self.first.shape[1] + self.second.shape[1]


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = -2 * vectors @ centroids.T
    out += (vectors**2).sum(1)[:, None] + (centroids**2).sum(1)
    return np.maximum(out, 0)


def codebook(vectors: np.ndarray, codes: int, rounds: int = 15) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced rows; a centroid without vectors stays where it is."""
    centroids = vectors[np.linspace(0, len(vectors) - 1, min(codes, len(vectors))).astype(int)].copy()
    for _ in range(rounds):
        nearest = _distances(vectors, centroids).argmin(1)
        many = np.bincount(nearest, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, nearest, vectors)
        centroids = np.where(many[:, None] > 0, total / np.maximum(many, 1)[:, None], centroids)
    return centroids


def traverse(index: Index, vectors: np.ndarray, visits: int) -> np.ndarray:
    """The nearest cells of unit vectors, nearest first.

    Only pairs of the i-th and j-th nearest codes with (i + 1)(j + 1) <= visits can be among them: every
    pair of nearer codes comes first.  This staircase is what the multi-sequence algorithm's queue walks.
    """
    half = index.first.shape[1]
    one, two = _distances(vectors[:, :half], index.first), _distances(vectors[:, half:], index.second)
    order_one, order_two = one.argsort(1, kind="stable")[:, :visits], two.argsort(1, kind="stable")[:, :visits]
    one, two = np.take_along_axis(one, order_one, 1), np.take_along_axis(two, order_two, 1)
    i, j = np.nonzero(np.outer(np.arange(1, one.shape[1] + 1), np.arange(1, two.shape[1] + 1)) <= visits)
    nearest = (one[:, i] + two[:, j]).argsort(1, kind="stable")[:, :visits]
    return np.take_along_axis(order_one, i[nearest], 1) * len(index.second) + np.take_along_axis(order_two, j[nearest], 1)


def _calibrated(index: Index, vectors: np.ndarray, least: float, target_recall: float) -> int:
    """Visits at which partners of exactly the least similarity are found with the target share."""
    noise = np.random.default_rng(7).standard_normal(vectors.shape)
    noise -= (noise * vectors).sum(1)[:, None] * vectors
    partners = least * vectors + np.sqrt(1 - least**2) * unit(noise)
    half = index.first.shape[1]
    home = traverse(index, partners, 1)[:, 0]
    one, two = _distances(vectors[:, :half], index.first), _distances(vectors[:, half:], index.second)
    own = one[np.arange(len(vectors)), home // len(index.second)] + two[np.arange(len(vectors)), home % len(index.second)]
    before = np.array([(a[:, None] + b[None, :] < o).sum() for a, b, o in zip(one, two, own)])
    return int(np.quantile(before, target_recall, method="higher")) + 1


def valid(frame: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that can link."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists("embedding", lambda x: x != 0)
    return frame.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & sound & some)


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, embedding, copies) of each class of equal vectors, named by its smallest id, and (vec_id, class, copies) of its members.

    An id that comes with different vectors is in no class with others: it has one of its own for each vector.
    """
    hashes = [F.xxhash64("embedding").alias("one"), F.xxhash64(F.lit(1), "embedding").alias("two")]
    each = vectors.select("vec_id", "embedding", *hashes)
    ids = stored(each.select("vec_id", "one", "two").distinct(), "vector-ids")
    several = ids.groupBy(F.col("vec_id").alias("of")).count().where("count > 1").select("of")
    own = F.coalesce(F.col("of").cast("string"), F.lit("")).alias("own")
    members = stored(ids.join(several, F.col("vec_id") == F.col("of"), "left").select("vec_id", "one", "two", own), "vector-members")
    groups = members.groupBy("one", "two", "own").agg(F.min("vec_id").alias("class"), F.count("*").alias("copies"))
    groups = stored(groups, "vector-classes")
    kinds = each.groupBy("one", "two").agg(F.first("embedding").alias("embedding"))
    named = groups.join(kinds, ["one", "two"]).select(F.col("class").alias("vec_id"), "embedding", "copies")
    return stored(named, "vectors"), members.join(groups, ["one", "two", "own"]).select("vec_id", "class", "copies")


def grid_codes(many: int, sample: int = _SAMPLE) -> int:
    """Codes for each half, given the number of vectors."""
    return max(4, min(sample // _BEHIND, int(np.ceil(np.sqrt(many / _RESIDENTS)))))


def fit(
    vectors: DataFrame, least: float, codes: int | None = None, sample: int = _SAMPLE, target_recall: float = 0.9, many: int | None = None
) -> Index | None:
    """Codebooks and visits from a bounded sample of valid rows of one length, ``many`` in all; None without any."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()["embedding"].to_pylist()
    if not rows:
        return None
    codes = codes or grid_codes(len(rows) if many is None else many, sample)
    matrix = unit(np.array(rows, np.float64))
    half = (matrix.shape[1] + 1) // 2
    index = Index(codebook(matrix[:, :half], codes), codebook(matrix[:, half:], codes), 1)
    return index._replace(visits=_calibrated(index, matrix[:2000], least, target_recall))


def _visits(vectors: DataFrame, index: Index) -> DataFrame:
    """(vec_id, copies, vector, cell, place, home, visited) of each cell a vector visits; it resides in ``home``, that of place 0, whose row has all cells visited."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                matrix = unit(np.array(part["embedding"].to_pylist(), np.float64).reshape(part.num_rows, index.size))
                cells = traverse(index, matrix, index.visits)
                raw = [row.tobytes() for row in matrix]
                many = cells.shape[1]
                all_cells = [row.tobytes() for row in cells.astype(np.int32)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(part["vec_id"].to_numpy(), many)),
                        pa.array(np.repeat(part["copies"].to_numpy(), many)),
                        pa.array([r for r in raw for _ in range(many)], pa.binary()),
                        pa.array(cells.ravel().astype(np.int32)),
                        pa.array(np.tile(np.arange(many, dtype=np.int32), part.num_rows)),
                        pa.array(np.repeat(cells[:, 0], many).astype(np.int32)),
                        pa.array([r if n == 0 else None for r in all_cells for n in range(many)], pa.binary()),
                    ],
                    ["vec_id", "copies", "vector", "cell", "place", "home", "visited"],
                )

    return vectors.select("vec_id", "embedding", "copies").mapInArrow(visit, "vec_id bigint, copies bigint, vector binary, cell int, place int, home int, visited binary")


def spanning_forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) links that connect whatever a bipartite link matrix connects; each row and column is expanded once."""
    out: list[tuple[int, int]] = []
    rows_left, columns_left = linked.any(1), linked.any(0)
    while rows_left.any():
        rows = np.array([rows_left.argmax()])
        rows_left[rows] = False
        while len(rows):
            reached = linked[rows] & columns_left
            columns = np.flatnonzero(reached.any(0))
            columns_left[columns] = False
            out += zip(rows[reached[:, columns].argmax(0)].tolist(), columns.tolist())
            back = linked[:, columns] & rows_left[:, None]
            rows = np.flatnonzero(back.any(1))
            rows_left[rows] = False
            if len(rows):
                out += zip(rows.tolist(), columns[back[rows].argmax(1)].tolist())
    return out


def _squares(visits: DataFrame, block: int) -> DataFrame:
    """Visits dealt to squares (cell, row, column) of at most about ``block`` visitors and residents."""
    sizes = visits.groupBy("cell").agg(F.count("*").alias("visitors"), F.count_if(F.col("place") == 0).alias("residents"))
    # one row per cell of the grid: bounded by codes ** 2
    dealt = visits.join(F.broadcast(sizes.where("residents > 0")), "cell")
    rows, columns = (F.ceil(F.col(c) / block).cast("int") for c in ("visitors", "residents"))
    spread = lambda n: F.sequence(F.lit(0), n - 1)
    visitor = dealt.select(
        "cell",
        F.pmod(F.xxhash64("vec_id"), rows).cast("int").alias("row"),
        F.explode(spread(columns)).alias("column"),
        F.lit(False).alias("resident"),
        "vec_id",
        "copies",
        "vector",
        "home",
        F.lit(None).cast("binary").alias("visited"),
    )
    resident = dealt.where("place = 0").select(
        "cell",
        F.explode(spread(rows)).alias("row"),
        F.pmod(F.xxhash64("vec_id"), columns).cast("int").alias("column"),
        F.lit(True).alias("resident"),
        "vec_id",
        "copies",
        "vector",
        "home",
        "visited",
    )
    return visitor.unionAll(resident)


def visits_home(homes: np.ndarray, visited: list[bytes]) -> np.ndarray:
    """Whether each resident (column) visits the home of each visitor (row)."""
    cells, place = np.unique(homes, return_inverse=True)
    each = np.frombuffer(b"".join(visited), np.int32)
    who = np.repeat(np.arange(len(visited)), [len(v) // 4 for v in visited])
    known = np.isin(each, cells)
    there = np.zeros((len(cells), len(visited)), bool)
    there[np.searchsorted(cells, each[known]), who[known]] = True
    return there[place]


def links(vectors: DataFrame, index: Index, least: float, block: int = 512) -> DataFrame:
    """(a, b, many): a vector and how many links of a square count for it (b null), or a link of a forest (many null).

    A link to a vector counts as often as it has ``copies`` (once without that column).
    """

    def compare(table: pa.Table) -> pa.Table:
        resident = table["resident"].to_numpy()
        ids = table["vec_id"].to_numpy()
        matrix = np.frombuffer(b"".join(table["vector"].to_pylist()), np.float64).reshape(len(ids), -1)
        visitors, there = np.flatnonzero(~resident), np.flatnonzero(resident)
        linked = matrix[visitors] @ matrix[there].T >= least
        linked &= ids[visitors][:, None] != ids[there][None, :]
        # a resident that visits the visitor's home counts the link there
        visited = table["visited"].take(there).to_pylist()
        unseen = linked & ~visits_home(table["home"].to_numpy()[visitors], visited)
        each, copies = np.concatenate([visitors, there]), table["copies"].to_numpy()
        many = np.concatenate([linked @ copies[there], copies[visitors] @ unseen])
        found = np.flatnonzero(many)
        forest = spanning_forest(linked)
        a = [*ids[each[found]].tolist(), *[int(ids[visitors[i]]) for i, _ in forest]]
        b = [*[None] * len(found), *[int(ids[there[j]]) for _, j in forest]]
        n = [*many[found].tolist(), *[None] * len(forest)]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "many": pa.array(n, pa.int64())})

    weighted = vectors if "copies" in vectors.columns else vectors.withColumn("copies", F.lit(1).cast("long"))
    visits = stored(_visits(weighted, index), "visits")
    return _squares(visits, block).groupBy("cell", "row", "column").applyInArrow(compare, "a bigint, b bigint, many bigint")


def near_duplicates(frame: DataFrame, least: float = 0.95, block: int = 512, **options) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of vectors (vec_id, embedding), one row per row."""
    vectors, members = classes(valid(frame))
    found = frame.sparkSession.createDataFrame([], "a bigint, b bigint, many bigint")
    # a row per length of vectors
    for size, many in sorted(vectors.groupBy(F.size("embedding")).count().collect()):
        if many > 1:
            alike = vectors.where(F.size("embedding") == size)
            found = found.unionAll(links(alike, fit(alike, least, many=many, **options), least, block))
    found = stored(found, "links")
    many = found.where("b is null").groupBy(F.col("a").alias("of")).agg(F.sum("many").alias("many"))
    groups = components(found.where("b is not null").select("a", "b")).withColumnRenamed("id", "in")
    # of an id with several vectors, each class has the same name and the same links
    own = members.select("vec_id", "class", "copies").distinct()
    told = own.join(many, F.col("class") == F.col("of"), "left").join(groups, F.col("class") == F.col("in"), "left")
    told = told.select(
        F.col("vec_id").alias("of_id"),
        (F.coalesce("many", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "class").alias("component_id"),
    )
    out = frame.select("vec_id").join(told, F.col("vec_id") == F.col("of_id"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
