"""Operator 11, multidimensional clustered layout: Morton range decomposition.

Each value becomes a coordinate below 2^bits by the share of rows with a smaller
value; interleaving the coordinates' bits gives a row's cell, and rows sorted by
cell are cut into files.  A row's query box is its own coordinate in some
dimensions and a reach around it in the others.  Rows of a cell share box and
answer, so boxes are answered once for each occupied cell (2^(bits * dimensions)
of them at most, however many rows there are):

* ``files_matching``: the box is split into z-intervals.  From a cell inside the
  box the largest aligned blocks that lie inside are appended; from a cell
  outside, the next cell inside is jumped to.  An interval's first and last
  occupied cell are found by binary search; rows are sorted by cell, so the
  files from the first one's first to the last one's last are those with rows.
* ``files_touched``: every file's bounds are tested against the box.  Files of
  the same bounds are tested together: a file that holds one cell has that
  cell's bounds, and fewer files than cells hold more than one, so there are
  less than twice as many different bounds as cells.

Nothing that grows with the rows passes one task, the driver or a broadcast: the
places of values and rows come from range partitions and their totals; the
driver reads the least value of each coordinate (bits and dimensions bound it).

Edge cases: null is the smallest value of every dimension, a null text has
length -1, a null id a null date; rows that repeat an id are rows of their own,
at neighbouring positions if they share a cell; values with more than a
coordinate's share of the rows leave coordinates empty; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table, spread_join
from .ordering import positions, running_before

BITS, FILE_ROWS = 4, 1000


def interleaved(coordinates: list[Column], bits: int) -> Column:
    """The cell: the highest bit of every coordinate in turn, then the next."""
    n = len(coordinates)
    placed = [
        F.shiftleft(F.shiftright(c.cast("long"), b).bitwiseAND(1), b * n + n - 1 - d)
        for d, c in enumerate(coordinates) for b in range(bits)
    ]
    return reduce(lambda a, b: a + b, placed)


def coordinate_of(cell: Column, d: int, n: int, bits: int) -> Column:
    """Coordinate ``d`` of ``n`` of a cell."""
    return reduce(lambda a, b: a + b, [F.shiftleft(F.shiftright(cell, b * n + n - 1 - d).bitwiseAND(1), b) for b in range(bits)])


def least_values(rows: DataFrame, dims: list[str], bits: int) -> list[list[tuple[int, object]]]:
    """For each dimension, the least value of every coordinate but zero that has one: (coordinate, value) by coordinate.

    All dimensions' distinct values stand in one sorted table; every dimension
    has all rows, so the rows before a value less those of the dimensions before
    it are the rows with a smaller value.
    """
    total = max(rows.count(), 1)
    kinds = dict(rows.dtypes)
    of = [
        F.struct(F.lit(k).alias("dim"), (F.lit(None) if kinds[d] == "string" else F.col(d)).cast("long").alias("number"), (F.col(d) if kinds[d] == "string" else F.lit(None)).cast("string").alias("letters"))
        for k, d in enumerate(dims)
    ]
    values = rows.select(F.explode(F.array(*of)).alias("v")).groupBy("v.dim", "v.number", "v.letters").agg(F.count(F.lit(1)).alias("size"))
    order = [F.col(c).asc_nulls_first() for c in ("dim", "number", "letters")]
    smaller = running_before(values, order, "size", "before").withColumn("before", F.col("before") - F.col("dim") * F.lit(total))
    coordinate = F.expr(f"(before * {1 << bits}) div {total}").alias("coordinate")
    edges = smaller.select("dim", coordinate, "number", "letters").groupBy("dim", "coordinate").agg(F.min(F.struct("number", "letters")).alias("least")).where("coordinate > 0")
    out: list[list[tuple[int, object]]] = [[] for _ in dims]
    for r in edges.collect():  # at most 2^bits rows a dimension
        out[r["dim"]].append((r["coordinate"], r["least"]["letters"] if kinds[dims[r["dim"]]] == "string" else r["least"]["number"]))
    return [sorted(x, key=lambda e: e[0]) for x in out]


def located(value: Column, edges: list[tuple[int, object]]) -> Column:
    """The coordinate of a value, by the least values of coordinates; null is the smallest value and lies at zero."""
    out = F.lit(0)
    for coordinate, least in edges:
        out = F.when(value >= F.lit(least), F.lit(coordinate)).otherwise(out)
    return out


def next_in_box(z: np.ndarray, low: np.ndarray, high: np.ndarray, dims: int, bits: int) -> np.ndarray:
    """The least cell above ``z`` inside the box whose lowest and highest corners are ``low`` and ``high``; -1 where there is none.

    From the highest bit on, a box is halved where its corners differ: if ``z``
    lies in the lower half, the upper half's lowest corner is the answer should
    the lower half have none.
    """
    z, low, high = z.copy(), low.copy(), high.copy()
    answer, open_ = np.full(len(z), -1, np.int64), np.ones(len(z), bool)
    for i in range(dims * bits - 1, -1, -1):
        bit = np.int64(1 << i)
        below = np.int64(sum(1 << j for j in range(i % dims, i, dims)))  # lower bits of the same dimension
        zb, lb, hb = (z & bit) > 0, (low & bit) > 0, (high & bit) > 0
        split = open_ & ~lb & hb
        upper = (low | bit) & ~below
        left, right = split & ~zb, split & zb
        answer = np.where(left, upper, answer)
        high = np.where(left, (high & ~bit) | below, high)
        low = np.where(right, upper, low)
        over = open_ & ~zb & lb & hb  # the whole box lies above
        answer = np.where(over, low, answer)
        open_ &= ~over & ~(zb & ~lb & ~hb)  # or below
    return answer


def spread_bits(values: np.ndarray, d: int, dims: int, bits: int) -> np.ndarray:
    return sum((((values >> b) & 1) << (b * dims + dims - 1 - d) for b in range(bits)), np.zeros(len(values), np.int64))


def gathered_bits(z: np.ndarray, d: int, dims: int, bits: int) -> np.ndarray:
    return sum((((z >> (b * dims + dims - 1 - d)) & 1) << b for b in range(bits)), np.zeros(len(z), np.int64))


def box_intervals(low: np.ndarray, high: np.ndarray, dims: int, bits: int) -> Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The z-intervals of many boxes, each box's in ascending order: rounds of (number of the box, first cell, last cell)."""
    corners = [(gathered_bits(low, d, dims, bits), gathered_bits(high, d, dims, bits)) for d in range(dims)]

    def inside(z: np.ndarray, box: np.ndarray) -> np.ndarray:
        held = z < 1 << dims * bits
        for d, (a, b) in enumerate(corners):
            c = gathered_bits(z, d, dims, bits)
            held &= (a[box] <= c) & (c <= b[box])
        return held

    box, start = np.arange(len(low)), low.copy()
    while len(box):
        end, growing = start.copy(), np.ones(len(box), bool)  # end: the first cell after the interval
        while growing.any():
            g = np.flatnonzero(growing)
            step = np.zeros(len(g), np.int64)
            for k in range(dims * bits, -1, -1):  # an aligned block lies inside if its first and last cell do
                first, last = end[g], end[g] + (1 << k) - 1
                fits = (step == 0) & (first & ((1 << k) - 1) == 0) & inside(first, box[g]) & inside(last, box[g])
                step[fits] = 1 << k
            end[g] += step
            growing[g] = step > 0
        yield box, start, end - 1
        following = next_in_box(end - 1, low[box], high[box], dims, bits)
        more = following >= 0
        box, start = box[more], following[more]


def files_in_boxes(cells: pd.DataFrame, reach: list[int], bits: int) -> np.ndarray:
    """For each occupied cell, how many files hold a row inside the box around it.

    ``cells``: z and the first and last file with rows of it, all the cells that
    any of the boxes may meet.
    """
    dims, most = len(reach), (1 << bits) - 1
    order = np.argsort(cells["z"].to_numpy(), kind="stable")
    z, first, last = (cells[c].to_numpy()[order] for c in ("z", "first_file", "last_file"))
    own = [gathered_bits(z, d, dims, bits) for d in range(dims)]
    low = sum((spread_bits(np.maximum(own[d] - reach[d], 0), d, dims, bits) for d in range(dims)), np.zeros(len(z), np.int64))
    high = sum((spread_bits(np.minimum(own[d] + reach[d], most), d, dims, bits) for d in range(dims)), np.zeros(len(z), np.int64))
    found, seen = np.zeros(len(z), np.int64), np.full(len(z), -1, np.int64)  # seen: the last file counted
    for box, a, b in box_intervals(low, high, dims, bits):
        i, j = np.searchsorted(z, a), np.searchsorted(z, b, "right")
        box, i, j = box[i < j], i[i < j], j[i < j]
        f, t = np.maximum(first[i], seen[box] + 1), last[j - 1]
        found[box] += np.maximum(t - f + 1, 0)
        seen[box] = np.maximum(seen[box], t)
    out = np.zeros(len(z), np.int64)
    out[order] = found
    return out


def clustered(rows: DataFrame, dims: list[str], reach: list[int], id_col: str = "doc_id", bits: int = BITS, file_rows: int = FILE_ROWS, salt: Column | None = None) -> DataFrame:
    """id, z, position, file, files_touched, files_matching, file_bounds and the coordinates of every row.

    ``dims`` are string or number columns, at least one of reach 0: cells that
    agree in the dimensions of reach 0 are matched together.  ``salt`` parts rows
    that share cell and id among range partitions.
    """
    n = len(dims)
    exact = [d for d, r in enumerate(reach) if r == 0]
    if not exact or n * bits > 62:
        raise ValueError("at least one dimension needs reach 0, and a cell 62 bits at most")
    coords = [f"c{d}" for d in range(n)]
    edges = least_values(rows, dims, bits)
    at = rows.select(
        F.col(id_col).alias("_id"), *[located(F.col(d), e).alias(c) for c, d, e in zip(coords, dims, edges, strict=True)], (F.xxhash64(*dims) if salt is None else salt).alias("_salt")
    )
    placed = positions(
        at.select("_id", interleaved([F.col(c) for c in coords], bits).alias("z"), "_salt"),
        [F.col("z"), F.col("_id").asc_nulls_first(), F.col("_salt")],
    ).withColumn("file", F.expr(f"position div {file_rows}"))

    cell_coords = [coordinate_of(F.col("z"), d, n, bits).alias(c) for d, c in enumerate(coords)]
    segments = materialise(placed.groupBy("file", "z").agg(F.count(F.lit(1)).alias("size")), "segments").select("file", "z", *cell_coords)
    bounds = segments.groupBy("file").agg(*[f(c).alias(f"{side}_{c}") for c in coords for side, f in (("low", F.min), ("high", F.max))])
    cells = segments.groupBy("z", *coords).agg(F.min("file").alias("first_file"), F.max("file").alias("last_file"))

    by_exact = [coords[d] for d in exact]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    matched = cells.repartition(tasks, *by_exact).groupBy(*by_exact).applyInPandas(
        lambda group: pd.DataFrame({"z": group["z"], "files_matching": files_in_boxes(group, reach, bits)}), "z long, files_matching long"
    )
    touched = touched_files(cells.select("z", *coords), bounds, coords, reach, bits)
    answers = touched.join(matched.hint("merge"), "z")
    shown = bounds.select("file", F.concat_ws(",", *[F.col(f"{side}_{c}").cast("string") for c in coords for side in ("low", "high")]).alias("file_bounds"))
    # Merge joins throughout: however small a side is now, it grows with the rows and is not broadcast.
    told = spread_join(segments.select("file", "z"), answers.hint("merge"), ["z"], "inner").join(shown.hint("merge"), "file")
    out = placed.join(told.hint("merge"), ["file", "z"])
    return out.select(F.col("_id").alias(id_col), "z", "position", "file", "files_touched", "files_matching", "file_bounds", *cell_coords)


def touched_files(queries: DataFrame, bounds: DataFrame, coords: list[str], reach: list[int], bits: int) -> DataFrame:
    """z and the number of files whose bounds meet the box around it.

    Equal bounds are one row.  All dimensions but the last become equality: a row
    of bounds is repeated for each coordinate whose box it meets there; the last
    dimension is tested.
    """
    most = (1 << bits) - 1
    sides = [f"{side}_{c}" for c in coords for side in ("low", "high")]
    boxes = bounds.groupBy(*sides).agg(F.count(F.lit(1)).alias("files"))
    for c, r in zip(coords[:-1], reach[:-1], strict=True):
        boxes = boxes.withColumn(c, F.explode(F.sequence(F.greatest(F.col(f"low_{c}") - r, F.lit(0)), F.least(F.col(f"high_{c}") + r, F.lit(most)))))
    last, r = coords[-1], reach[-1]
    boxes = boxes.select(*coords[:-1], "files", (F.col(f"low_{last}") - r).alias("_from"), (F.col(f"high_{last}") + r).alias("_to"))
    met = spread_join(queries, boxes.hint("merge"), coords[:-1], "inner").where(F.col(last).between(F.col("_from"), F.col("_to")))
    return met.groupBy("z").agg(F.sum("files").alias("files_touched"))


def document_values(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """source, lang, length in bytes and date of every document, with a hash of its text; a narrow written table, so that texts are read once."""
    return materialise(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.col("source").cast("string"), F.col("lang").cast("string"),
            F.coalesce(F.octet_length(text_col), F.lit(-1)).cast("long").alias("length"),
            (F.crc32(F.col(id_col).cast("long").cast("string")) % 365).alias("date"), F.xxhash64(text_col).alias("_text"),
        ), "values",
    )


def op11_clustered_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(document_values(read_table(spark, sf_dir, "documents")), ["source", "lang", "length", "date"], [0, 0, 2, 2], salt=F.col("_text"))


#: CRC-32 of a string of ASCII digits, bit by bit: a byte is xored in, then eight shifts follow.
CRC_OF = """list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform({bytes}, lambda b: [b::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"""
CRC32_SQL = f"xor({CRC_OF}, 4294967295)"

OP11_SQL = f"""
WITH v AS (
  SELECT doc_id, source, lang, coalesce(strlen(text), -1) AS length,
         {CRC32_SQL.format(bytes="list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch))")} % 365 AS date
  FROM documents
), n AS (SELECT count(*) AS n FROM documents), c AS (
  SELECT doc_id, 16 * (rank() OVER (ORDER BY source NULLS FIRST) - 1) // n AS c0, 16 * (rank() OVER (ORDER BY lang NULLS FIRST) - 1) // n AS c1,
         16 * (rank() OVER (ORDER BY length) - 1) // n AS c2, 16 * (rank() OVER (ORDER BY date NULLS FIRST) - 1) // n AS c3
  FROM v, n
), p AS (
  SELECT *, row_number() OVER (ORDER BY z, doc_id NULLS FIRST) - 1 AS position FROM (
    SELECT *, list_sum(list_transform(range(4), lambda b: (((c0 >> b) & 1) << (4 * b + 3)) + (((c1 >> b) & 1) << (4 * b + 2)) + (((c2 >> b) & 1) << (4 * b + 1)) + (((c3 >> b) & 1) << (4 * b))))::BIGINT AS z FROM c)
), r AS (SELECT *, position // 1000 AS file FROM p), f AS (
  SELECT file, min(c0) AS a0, max(c0) AS b0, min(c1) AS a1, max(c1) AS b1, min(c2) AS a2, max(c2) AS b2, min(c3) AS a3, max(c3) AS b3 FROM r GROUP BY file
), q AS (SELECT DISTINCT z, c0, c1, c2, c3 FROM r), t AS (
  SELECT q.z, count(*) AS files_touched FROM q JOIN f ON q.c0 BETWEEN a0 AND b0 AND q.c1 BETWEEN a1 AND b1 AND a2 <= q.c2 + 2 AND b2 >= q.c2 - 2 AND a3 <= q.c3 + 2 AND b3 >= q.c3 - 2 GROUP BY q.z
), s AS (SELECT DISTINCT file, c0, c1, c2, c3 FROM r), m AS (
  SELECT q.z, count(DISTINCT s.file) AS files_matching
  FROM q JOIN s ON q.c0 = s.c0 AND q.c1 = s.c1 AND abs(q.c2 - s.c2) <= 2 AND abs(q.c3 - s.c3) <= 2 GROUP BY q.z
)
SELECT r.doc_id, r.z, r.position, r.file, t.files_touched::BIGINT AS files_touched, m.files_matching,
       concat_ws(',', a0, b0, a1, b1, a2, b2, a3, b3) AS file_bounds, c0, c1, c2, c3
FROM r JOIN f USING (file) JOIN t USING (z) JOIN m USING (z)
"""
