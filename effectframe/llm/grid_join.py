"""Near-duplicate vectors by an epsilon grid order join.

On unit vectors a cosine of ``threshold`` is a distance of ``eps = sqrt(2 - 2 threshold)``.
Vectors are rotated onto leading principal dimensions and sorted by label and by their
grid cells of side ``eps`` along these; consecutive ones make blocks. A sequence of
blocks is joined with another by halving both again and again; two intervals whose
boxes are farther apart than ``eps`` are skipped with all they hold. Blocks that remain
are compared in full, cosine in double precision, again by halves.

The rotation is fitted on a bounded sample; any rotation gives the same links, a good
one skips more. Equal vectors are folded into one before the join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectframe.llm.components import connected_components
from effectframe.session import cut_lineage

#: Leading dimensions kept for cells and boxes, rows of a block, rows compared at once.
LEADING = 8
BLOCK = 1024
LEAF = 128
#: Vectors on which the rotation is fitted.
SAMPLE = 8192
#: Halvings per step of the recursion.
FAN_BITS = 3


def _units(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(usable, unit vectors as float64) of a list column whose lists have one length."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = values.reshape(len(column), -1)
    peak = np.abs(rows).max(axis=1, initial=0.0)
    scaled = rows / np.where(peak > 0, peak, 1.0)[:, None]
    norm = np.sqrt((scaled * scaled).sum(axis=1))
    return peak > 0, scaled / np.where(norm > 0, norm, 1.0)[:, None]


def _rotations(classes: DataFrame) -> dict[int, np.ndarray]:
    """Leading principal directions per vector length, from ``SAMPLE`` vectors of least hash."""
    chosen = classes.select("dim", "vector").orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).collect()
    by_dim: dict[int, list] = {}
    for row in chosen:
        by_dim.setdefault(row["dim"], []).append(row["vector"])
    out = {}
    for dim, rows in by_dim.items():
        _, unit = _units(pa.array(rows, pa.list_(pa.float64())))
        _, axes = np.linalg.eigh(np.cov(unit, rowvar=False).reshape(dim, dim) if len(unit) > 1 else np.eye(dim))
        out[dim] = axes[:, ::-1][:, :LEADING].copy()
    return out


def _coordinates(unit: np.ndarray, rotations: dict[int, np.ndarray]) -> np.ndarray:
    """Leading coordinates and the length of what they leave: distances never grow."""
    dim = unit.shape[1]
    axes = rotations.get(dim)
    lead = unit @ axes if axes is not None else unit[:, :LEADING]
    rest = np.sqrt(np.maximum(0.0, 1.0 - (lead * lead).sum(axis=1)))
    out = np.zeros((len(unit), LEADING + 1))
    out[:, : lead.shape[1]] = lead
    out[:, LEADING] = rest
    return out


def _gap(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> float:
    apart = np.maximum(0.0, np.maximum(low_a - high_b, low_b - high_a))
    return float((apart * apart).sum())


def _thinned(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of the links in a matrix which connect what all of them connect, breadth first."""
    rows, columns = near.any(axis=1), np.ones(near.shape[1], bool)
    left, right = [], []
    while rows.any():
        queue = [int(rows.argmax())]
        rows[queue[0]] = False
        while queue:
            r = queue.pop()
            found = np.flatnonzero(near[r] & columns)
            if not len(found):
                continue
            columns[found] = False
            left.append(np.full(len(found), r))
            right.append(found)
            reached = np.flatnonzero(near[:, found].any(axis=1) & rows)
            rows[reached] = False
            left.append(reached)
            right.append(found[near[reached][:, found].argmax(axis=1)])
            queue.extend(reached.tolist())
    return np.concatenate(left), np.concatenate(right)


def _join(a: dict, b: dict, threshold: float, far: float, hits: list) -> None:
    """Recursive join of two intervals of sorted rows; ``hits`` gets index pairs into both blocks."""
    if _gap(a["at"].min(0), a["at"].max(0), b["at"].min(0), b["at"].max(0)) > far:
        return
    n, m = len(a["row"]), len(b["row"])
    if n <= LEAF and m <= LEAF:
        near = a["unit"] @ b["unit"].T >= threshold
        if near.any():
            i, j = np.nonzero(near)
            x, y = _thinned(near)
            hits.append((a["row"][i], b["row"][j], a["row"][x], b["row"][y]))
        return
    halves = lambda x, k: [{c: v[:k] for c, v in x.items()}, {c: v[k:] for c, v in x.items()}]
    for left in halves(a, n // 2) if n > LEAF else [a]:
        for right in halves(b, m // 2) if m > LEAF else [b]:
            _join(left, right, threshold, far, hits)


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what ``a[i]``-``b[i]`` connect, at most one per node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            kept.append((x, y))
    return kept


def _compare(threshold: float):
    """Pairs of blocks to (class, links, other): weighted link counts, and a forest of the links."""
    far = 2 - 2 * threshold
    far = far * (1 + 1e-9) + 1e-9

    def block(batch: pa.RecordBatch, k: int, side: str) -> dict:
        get = lambda name: batch.column(f"{side}_{name}")[k].as_py()
        classes = np.frombuffer(get("classes"), np.int64)
        return {
            "classes": classes,
            "counts": np.frombuffer(get("counts"), np.int64),
            "unit": np.frombuffer(get("units"), np.float64).reshape(len(classes), -1),
            "at": np.frombuffer(get("coordinates"), np.float64).reshape(len(classes), -1),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                same = batch.column("same")[k].as_py()
                a = block(batch, k, "a")
                b = a if same else block(batch, k, "b")
                if a["unit"].shape[1] != b["unit"].shape[1]:
                    continue
                hits: list[tuple[np.ndarray, ...]] = []
                side = lambda x: {"row": np.arange(len(x["classes"])), "unit": x["unit"], "at": x["at"]}
                _join(side(a), side(b), threshold, far, hits)
                links_a, links_b = np.zeros(len(a["classes"]), np.int64), np.zeros(len(b["classes"]), np.int64)
                ends = []
                for i, j, x, y in hits:
                    if same:
                        i, j = i[i != j], j[i != j]
                    np.add.at(links_a, i, b["counts"][j])
                    if not same:
                        np.add.at(links_b, j, a["counts"][i])
                    ends += zip(a["classes"][x].tolist(), b["classes"][y].tolist(), strict=True)
                ends = _forest(*np.array(ends, np.int64).reshape(-1, 2).T)
                out = [(c, n, None) for c, n in zip(a["classes"].tolist(), links_a.tolist(), strict=True) if n]
                out += [(c, n, None) for c, n in zip(b["classes"].tolist(), links_b.tolist(), strict=True) if n and not same]
                out += [(x, 0, y) for x, y in ends]
                if out:
                    cls, links, other = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(links, pa.int64()), pa.array(other, pa.int64())], ["cls", "links", "other"])

    return run


def _boxes(blocks: DataFrame, bits: int) -> DataFrame:
    """Box, label range and vector lengths of each interval of ``2 ** bits`` block numbers."""
    sides = [f(F.col(c)[i]).alias(f"{c}{i}") for i in range(LEADING + 1) for c, f in (("low", F.min), ("high", F.max))]
    grouped = blocks.groupBy(F.shiftright("block", bits).alias("node")).agg(F.min("label").alias("label_low"), F.max("label").alias("label_high"), *sides)
    arrays = [F.array(*[F.col(f"{c}{i}") for i in range(LEADING + 1)]).alias(c) for c in ("low", "high")]
    return grouped.select("node", "label_low", "label_high", *arrays)


def _near(far: float) -> Column:
    """Whether the boxes of ``a`` and ``b`` may hold a link."""
    apart = F.zip_with(
        F.zip_with("a_low", "b_high", lambda x, y: x - y), F.zip_with("b_low", "a_high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))
    )
    labels = (F.col("a_label_low") <= F.col("b_label_high")) & (F.col("b_label_low") <= F.col("a_label_high"))
    return labels & (F.aggregate(apart, F.lit(0.0), lambda s, x: s + x * x) <= far)


def _block_pairs(blocks: DataFrame, far: float) -> DataFrame:
    """(a, b), a <= b: block numbers left by the recursion over intervals, from the whole sequence down."""
    spark = blocks.sparkSession
    top = blocks.agg(F.max("block")).first()[0]
    bits = max(0, int(top or 0).bit_length())
    pairs = spark.range(1).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    while bits > 0:
        step = min(FAN_BITS, bits)
        bits -= step
        below = lambda c: F.explode(F.sequence(F.shiftleft(c, step), F.shiftleft(c, step) + ((1 << step) - 1)))  # noqa: B023, E731
        boxes = _boxes(blocks, bits)
        side = lambda s: boxes.select(*[F.col(c).alias(f"{s}_{c}") for c in boxes.columns])  # noqa: B023, E731
        split = pairs.select(below("a").alias("a"), "b").select("a", below("b").alias("b")).filter(F.col("a") <= F.col("b"))
        met = split.join(side("a"), F.col("a") == F.col("a_node")).join(side("b"), F.col("b") == F.col("b_node"))
        pairs = met.filter(_near(far)).select("a", "b")
    return pairs


def _make_blocks(rotations: dict[int, np.ndarray]):
    """Rows of one partition, sorted by (label, cells): packed blocks, numbered inside the partition."""

    def flush(rows: pa.Table, label: int, number: int) -> Iterator[pa.RecordBatch]:
        for s in range(0, rows.num_rows, BLOCK):
            part = rows.slice(s, BLOCK)
            _, unit = _units(part.column("vector").combine_chunks())
            at = _coordinates(unit, rotations)
            out = {
                "number": [number + s // BLOCK],
                "label": [label],
                "classes": [part.column("cls").to_numpy().astype(np.int64).tobytes()],
                "counts": [part.column("copies").to_numpy().astype(np.int64).tobytes()],
                "units": [unit.tobytes()],
                "coordinates": [at.tobytes()],
                "low": [at.min(0).tolist()],
                "high": [at.max(0).tolist()],
            }
            yield pa.RecordBatch.from_pydict(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, number = [], None, 0
        for batch in batches:
            keys = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True))
            s = 0
            while s < len(keys):
                e = s
                while e < len(keys) and keys[e] == keys[s]:
                    e += 1
                part = batch.slice(s, e - s)
                full = sum(h.num_rows for h in held)
                if held and (keys[s] != key or full >= 8 * BLOCK):
                    whole = pa.Table.from_batches(held)
                    # What does not fill a block waits for the rows to come.
                    cut = full if keys[s] != key else full // BLOCK * BLOCK
                    yield from flush(whole.slice(0, cut), key[0], number)
                    number += -(-cut // BLOCK)
                    held = whole.slice(cut).to_batches() if cut < full else []
                held.append(part)
                key = keys[s]
                s = e
        if held:
            yield from flush(pa.Table.from_batches(held), key[0], number)

    return run


def similar_vectors(
    vectors: DataFrame,
    threshold: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(id, n_links, component_id, kept), one row per row.

    Vectors with equal labels (integers) and equal lengths link if their cosine is at
    least ``threshold`` (above 0). A null, empty or zero vector, one with null or non-finite
    components, a null label or a null id link with nothing: no links, the row's own id
    as component, kept. ``n_links`` counts the other rows linked directly, ``component_id``
    is the least id reachable, ``kept`` says it is the row's own. Repeated rows count as
    other vectors. An empty table gives no rows. Runs several jobs.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    far = (2 - 2 * threshold) * (1 + 1e-9) + 1e-9
    eps = max(math.sqrt(2 - 2 * threshold), 1e-3)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).cast("long").alias("label")
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    # Two independent hashes of the vector stand for it as key.
    keyed = rows.withColumn("use", F.coalesce(usable, F.lit(False))).withColumns(
        {"k1": F.when(F.col("use"), F.xxhash64("label", "vector")), "k2": F.when(F.col("use"), F.xxhash64(F.lit(1), F.reverse("vector"), "label"))}
    )
    members = keyed.select("id", "k1", "k2")
    classes = cut_lineage(
        keyed.filter("use")
        .groupBy("k1", "k2")
        .agg(F.min("id").alias("cls"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector"))
        .withColumn("dim", F.size("vector"))
    )
    rotations = _rotations(classes)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cls", "copies", "label", "dim", "vector"]
        for batch in batches:
            columns = {n: batch.column(n) for n in names}
            dims = columns["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                rows_at = pa.array(np.flatnonzero(dims == dim))
                part = [columns[n].take(rows_at) for n in names]
                grid = np.floor(_coordinates(_units(part[4])[1], rotations) / eps).astype(np.int32)
                cell = pa.array(grid.tolist(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part, cell], [*names, "cell"])

    schema = "cls long, copies long, label long, dim int, vector array<double>"
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["label", "dim", "cell", "cls"]
    ordered = classes.select("cls", "copies", "label", "dim", "vector").mapInArrow(cells, f"{schema}, cell array<int>")
    ordered = ordered.repartitionByRange(partitions, *order).sortWithinPartitions(*order).drop("cell")
    packed = ordered.mapInArrow(
        _make_blocks(rotations),
        "number long, label long, classes binary, counts binary, units binary, coordinates binary, low array<double>, high array<double>",
    )
    packed = cut_lineage(packed.withColumn("part", F.spark_partition_id().cast("long")))
    most = packed.agg(F.max("number")).first()[0] or 0
    # Numbers follow the order; the gaps between partitions cost nothing.
    blocks = packed.withColumn("block", F.shiftleft("part", max(1, int(most).bit_length())) + F.col("number"))
    pairs = _block_pairs(blocks.select("block", "label", "low", "high"), far)
    load = ["classes", "counts", "units", "coordinates"]
    of = lambda s: blocks.select(F.col("block").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in load])
    other = of("b").join(pairs, "b")
    empty = F.col("a") == F.col("b")
    compared = (
        of("a")
        .join(other, "a")
        .select(empty.alias("same"), *[f"a_{c}" for c in load], *[F.when(~empty, F.col(f"b_{c}")).alias(f"b_{c}") for c in load])
        .mapInArrow(_compare(threshold), "cls long, links long, other long")
    )
    compared = cut_lineage(compared)
    links = compared.filter("links > 0").groupBy("cls").agg(F.sum("links").alias("links"))
    components = connected_components(compared.filter("other is not null"), "cls", "other")
    found = (
        classes.select("k1", "k2", "cls", "copies")
        .join(links, "cls", "left")
        .join(components.withColumnRenamed("node", "cls"), "cls", "left")
        .select("k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "cls").alias("least"))
    )
    joined = members.join(found, ["k1", "k2"], "left")
    component = F.coalesce("least", "id")
    return joined.select(
        "id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept")
    )
