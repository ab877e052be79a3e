"""Linear candidates of all folds and settings from Gram matrices.

Every row lies in one cell of each repeat (fold and inner fold, or year), and every training
set is a union of cells. One pass sums B'WB over the rows of each cell, where the basis B has
numbers whose gaps are 0, an indicator of each gap and one of each category. What a training
set does to its features (median for a gap, scaling, rare categories in one column) is a
matrix T on that basis, so its normal equations are T'(sum of its cells)T: no training set is
ever built as rows, and a fold more costs a small matrix and no pass over the data.

Ridge takes one eigendecomposition for all penalties; Lasso and Elastic Net run coordinate
descent on the same matrix, all settings of a fold at once. Fitted models are rows of
coefficients on the basis; a second pass scores the inner folds with all of them, a third one
the held-out rows with the chosen ones: it gives their predictions, or only the moments that metrics are made of.

What the driver holds does not grow with the rows: cells and models times the columns of the
basis, of which there may be MOST_COLUMNS. A category that fewer than RARE_CATEGORY rows
have altogether shares a column with the other ones of its field."""

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgerline.operators.keys import join_facts
from ledgerline.operators.preprocess import FeatureSet
from ledgerline.operators.ranks import numbered_by_hash, tile
from ledgerline.settings import FOLDS, INNER_FOLDS, INNER_OFFSETS, OUTER_CUTOFFS, RARE_CATEGORY, REPEATS, SEED, SPACE
from ledgerline.sources.writers import written

MOST_COLUMNS = 4096  # of the basis, as many as a normal-equation solver of Spark takes
STEP_CELLS = 1 << 22  # numbers of a basis matrix made at once
HELD_BYTES = 256 << 20  # matrices that a task holds before it passes them on
GRID = 512  # value ranges in which medians are looked for
MERGED = 64  # partial sums of a cell that are added before the final ones
SWEEPS = 2_000
POLISH = 20
FULL = 10
MOMENTS = ["n", "w", "mean", "around", "low", "high", "off", "squares"]  # of metrics.metrics_of_moments
SMALL_EIGENVALUE = 1e-11  # of the largest one; smaller ones are directions without data

Params = dict[str, float | bool]
#: Grids of the estimation and of the forecast.
LINEAR: dict[str, list[Params]] = {
    "Linear Regression": [{"intercept": True}, {"intercept": False}],
    "Ridge": [{"alpha": a} for a in (0.1, 1.0, 10.0, 100.0)],
    "Lasso": [{"alpha": a} for a in (0.01, 0.1, 1.0, 10.0)],
    "Elastic Net": [{"alpha": a, "ratio": r} for a in (0.01, 0.1, 1.0) for r in (0.2, 0.5, 0.8)],
}
FORECAST_LINEAR: dict[str, list[Params]] = {
    "Linear Regression": [{"intercept": True}],
    "Ridge": [{"alpha": a} for a in (0.1, 1.0, 10.0)],
    "Lasso": [{"alpha": a} for a in (0.01, 0.1, 1.0)],
    "Elastic Net": LINEAR["Elastic Net"],
}


# --- cells and training sets --------------------------------------------------------------


@dataclass(frozen=True)
class Outer:
    """A training set and what it is tested and tuned on, as cells; `scale` holds factors on the weights of cells."""

    labels: dict[str, int | float]
    train: tuple[int, ...]
    test: tuple[int, ...]
    inner: tuple[tuple[tuple[int, ...], tuple[int, ...]], ...] = ()
    scale: tuple[tuple[int, float], ...] = ()

    def sets(self) -> list[tuple[int, ...]]:
        return [self.train, *(a for a, _ in self.inner)]


def grouped_cells(df: DataFrame, group: str, k: int = FOLDS, repeats: int = REPEATS, inner: int = INNER_FOLDS) -> tuple[DataFrame, list[Outer]]:
    """Adds `cells`: one a repeat, of company folds of near-equal size within each group.

    Only space companies have folds; other rows lie in cells that all folds train on. Inner
    folds are hash buckets of the company id."""
    space = df.filter(F.col("population_type") == SPACE).select(group, "company_id").distinct()
    spread = space.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    label = F.concat_ws(":", F.col("company_id").cast("string"), (F.col("repeat") + SEED).cast("string"))
    placed = numbered_by_hash(spread, [group, "repeat"], label)
    fold = tile(F.col("position"), F.col("group_rows"), k).cast("int")  # 1 .. k; 0 is never held out
    folds = placed.groupBy(group, "company_id").agg(F.array_sort(F.collect_list(F.struct("repeat", fold.alias("fold")))).alias("_folds"))
    folds = written(folds, "company-folds")
    bucket = F.pmod(F.xxhash64("company_id", F.lit(SEED)), F.lit(inner)).cast("int")
    none = F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda r: F.struct(r.alias("repeat"), F.lit(0).alias("fold")))
    marked = join_facts(df, folds, [group, "company_id"])
    own = F.when(F.col("population_type") == SPACE, F.col("_folds"))
    cells = F.transform(F.coalesce(own, none), lambda x: ((x["repeat"] * (k + 1) + x["fold"]) * inner + bucket).cast("int"))

    def cell(r: int, f: int, i: int) -> int:
        return (r * (k + 1) + f) * inner + i

    outers = []
    for r in range(repeats):
        for held in range(1, k + 1):
            others = [f for f in range(k + 1) if f != held]
            pairs = []
            for out in range(inner if inner > 1 else 0):
                pairs.append((
                    tuple(cell(r, f, i) for f in others for i in range(inner) if i != out),
                    tuple(cell(r, f, out) for f in others),
                ))
            train = tuple(cell(r, f, i) for f in others for i in range(inner))
            outers.append(Outer({"repeat": r, "fold": held - 1}, train, tuple(cell(r, held, i) for i in range(inner)), tuple(pairs)))
    return marked.withColumn("cells", cells).drop("_folds"), outers


def scaled_added(outers: list[Outer], label: str, factors: list[float], k: int = FOLDS, inner: int = INNER_FOLDS) -> list[Outer]:
    """The training sets of grouped_cells once a factor on the weights of the rows that all folds train on."""
    added = {r * (k + 1) * inner + i for r in range(1 + max(o.labels["repeat"] for o in outers)) for i in range(inner)}
    return [
        replace(o, labels=o.labels | {label: w}, scale=tuple((c, w) for c in o.train if c in added)) for w in factors for o in outers
    ]


def yearly_cells(
    df: DataFrame, year: str = "target_year", cutoffs: list[int] = OUTER_CUTOFFS, offsets: list[int] = INNER_OFFSETS, label: str = "cutoff_year"
) -> tuple[DataFrame, list[Outer]]:
    """Adds `cells`, the row's year; a training set is all years up to a cutoff."""
    ends = df.agg(F.min(year), F.max(year)).first()
    years = range(ends[0], ends[1] + 1) if ends[0] is not None else range(0)

    def between(a: int | None, b: int | None) -> tuple[int, ...]:
        return tuple(y for y in years if (a is None or y > a) and (b is None or y <= b))

    outers = [
        Outer({label: c}, between(None, c), between(c, None), tuple((between(None, c - o), between(c - o, c)) for o in offsets)) for c in cutoffs
    ]
    return df.withColumn("cells", F.array(F.col(year).cast("int"))), [o for o in outers if o.train and o.test]


# --- the basis -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Basis:
    """Columns 1, values and gaps of the numbers, then for each field its categories, all other ones, and the gap
    (of which there are none where a gap has a label of its own)."""

    features: FeatureSet
    categories: dict[str, list[str]]

    @property
    def size(self) -> int:
        return 1 + 2 * len(self.features.numeric) + sum(len(c) + 2 for c in self.categories.values())

    @property
    def names(self) -> list[str]:
        """Of the scaled features, in order."""
        logs = set(self.features.log)
        out = [f"{'log' if c in logs else 'plain'}_numeric__{c}" for c in self.features.numeric]
        for name, labels in self.categories.items():
            out += [f"categorical__{name}_{label}" for label in [*labels, "infrequent"]]
        return out

    @property
    def fields(self) -> list[tuple[str, int, int]]:
        """(field, its first column, its categories)."""
        out, at = [], 1 + 2 * len(self.features.numeric)
        for name, labels in self.categories.items():
            out.append((name, at, len(labels)))
            at += len(labels) + 2
        return out

    def label(self, name: str) -> Column:
        return filled_label(self.features, name)

    def inputs(self) -> list[Column]:
        """Numbers with logs taken, and the number of each row's category column."""
        logs = set(self.features.log)
        cells = [(F.log1p(F.col(c).cast("double")) if c in logs else F.col(c).cast("double")).alias(c) for c in self.features.numeric]
        for name, at, n in self.fields:
            labels = F.array(*[F.lit(v) for v in self.categories[name]]) if n else F.array().cast("array<string>")
            place = F.array_position(labels, self.label(name)).cast("int")
            code = F.when(self.label(name).isNull(), at + n + 1).when(place > 0, at + place - 1).otherwise(at + n)
            cells.append(code.cast("int").alias(name))
        return cells

    def matrix(self, batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((batch.num_rows, self.size))
        out[:, 0] = 1.0
        numbers = len(self.features.numeric)
        for j, c in enumerate(self.features.numeric):
            value = batch.column(c).to_numpy(zero_copy_only=False).astype(float)
            gap = np.isnan(value)
            out[:, 1 + j] = np.where(gap, 0.0, value)
            out[:, 1 + numbers + j] = gap
        row = np.arange(batch.num_rows)
        for name, _, _ in self.fields:
            out[row, batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)] = 1.0
        return out


def filled_label(features: FeatureSet, name: str) -> Column:
    return F.col(name) if features.missing_label is None else F.coalesce(F.col(name), F.lit(features.missing_label))


def basis_of(df: DataFrame, features: FeatureSet) -> Basis:
    """With the categories that RARE_CATEGORY rows or more have, by name."""
    found: dict[str, list[str]] = {c: [] for c in features.categories}
    if features.categories:
        labels = df.select(*[filled_label(features, c).alias(c) for c in features.categories])
        long = labels.unpivot([], features.categories, "field", "label").filter("label is not null")
        frequent = long.groupBy("field", "label").count().filter(F.col("count") >= RARE_CATEGORY)
        for r in frequent.orderBy("field", "label").limit(MOST_COLUMNS + 1).collect():
            found[r["field"]].append(r["label"])
    basis = Basis(features, found)
    if basis.size > MOST_COLUMNS:
        raise ValueError(f"{basis.size} columns; normal equations take up to {MOST_COLUMNS}")
    return basis


# --- sums over cells ---------------------------------------------------------------------------


def _in_steps(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Steps of as many rows as STEP_CELLS allows; small batches are put together, so that a cell has many rows in a step."""
    rows = max(1, STEP_CELLS // max(1, width))
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            if held and sum(b.num_rows for b in held) + part.num_rows > rows:
                yield pa.concat_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_batches(held)


def _pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of every cell of every row."""
    cells = batch.column("cells")
    return pc.list_parent_indices(cells).to_numpy().astype(np.int64), pc.list_flatten(cells).to_numpy().astype(np.int64)


def _by_cell(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(cell, its rows) in order of the cell."""
    row, cell = _pairs(batch)
    order = np.argsort(cell, kind="stable")
    cells, starts = np.unique(cell[order], return_index=True)
    for c, mine in zip(cells.tolist(), np.split(row[order], starts[1:])):
        yield c, mine


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, pa.RecordBatch]]:
    keys = batch.column("grp").dictionary_encode()
    codes = keys.indices.to_numpy(zero_copy_only=False)
    for code, name in enumerate(keys.dictionary.to_pylist()):
        rows = np.flatnonzero(codes == code)
        if len(rows):
            yield name, rows, batch.take(pa.array(rows))


BLOBS = "grp string, cell int, part int, blob binary"


def _blob(name: str, cell: int, part: int, value: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([name]), pa.array([cell], pa.int32()), pa.array([part], pa.int32()), pa.array([value.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["grp", "cell", "part", "blob"])


def summed_by_cell(df: DataFrame, make: Callable[[str, pa.RecordBatch], Iterator[tuple[int, np.ndarray]]], width: int, kind: str) -> DataFrame:
    """Sum of the arrays that `make` gives for a step of rows of one group, by group and cell.

    A task adds its own up, then partial sums meet in two rounds, streamed in order of the
    cell, so that a task holds one array besides those it has made."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() % MERGED
        sums: dict[tuple[str, int], np.ndarray] = {}
        held = 0
        for step in _in_steps(batches, width):
            for name, _, rows in _groups(step):
                for cell, value in make(name, rows):
                    if (name, cell) in sums:
                        sums[name, cell] += value
                    else:
                        sums[name, cell] = value
                        held += value.nbytes
            if held > HELD_BYTES:
                for (name, cell), value in sums.items():
                    yield _blob(name, cell, part, value)
                sums, held = {}, 0
        for (name, cell), value in sums.items():
            yield _blob(name, cell, part, value)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for name, cell, part, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                value = np.frombuffer(blob, kind)
                if (name, cell, part) == now:
                    total += value
                    continue
                if now is not None:
                    yield _blob(*now, total)
                now, total = (name, cell, part), value.copy()
        if now is not None:
            yield _blob(*now, total)

    found = df.mapInArrow(own, BLOBS)
    for last in (False, True):
        if last:
            found = found.withColumn("part", F.lit(0))
        found = found.repartition("grp", "cell", "part").sortWithinPartitions("grp", "cell", "part").mapInArrow(merged, BLOBS)
    return found.drop("part")


def _collected(sums: DataFrame, kind: str, shape: tuple[int, ...]) -> dict[str, dict[int, np.ndarray]]:
    out: dict[str, dict[int, np.ndarray]] = {}
    for r in sums.collect():
        out.setdefault(r["grp"], {})[r["cell"]] = np.frombuffer(r["blob"], kind).reshape(shape)
    return out


# --- medians of all training sets -----------------------------------------------------------------


def _grids(rows: DataFrame, numeric: list[str]) -> dict[str, list[np.ndarray]]:
    """Ends of GRID value ranges of each group and feature."""
    # one literal, split while planning, instead of thousands of expression nodes
    shares = ",".join(str(i / GRID) for i in range(1, GRID))
    cuts = [F.expr(f"percentile_approx(nanvl(`{c}`, null), cast(split('{shares}', ',') as array<double>), {10 * GRID})").alias(c) for c in numeric]
    return {r["grp"]: [np.array(r[c] or [], float) for c in numeric] for r in rows.groupBy("grp").agg(*cuts).collect()}


def _range_counts(grids: dict[str, list[np.ndarray]], numeric: list[str]) -> Callable[[str, pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]:
    """Counts (feature, range) of each cell."""

    def histogram(name: str, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        row, cell = _pairs(batch)
        cells, code = np.unique(cell, return_inverse=True)
        out = np.zeros((len(cells), len(numeric), GRID), np.int64)
        for j, f in enumerate(numeric):
            value = batch.column(f).to_numpy(zero_copy_only=False).astype(float)
            place = np.searchsorted(grids[name][j], value)
            some = ~np.isnan(value)[row]
            out[:, j] = np.bincount(code[some] * GRID + place[row[some]], minlength=len(cells) * GRID).reshape(-1, GRID)
        for c, found in zip(cells.tolist(), out):
            yield c, found.copy()

    return histogram


def set_medians(rows: DataFrame, numeric: list[str], sets: list[tuple[int, ...]]) -> dict[str, np.ndarray]:
    """Exact medians (set, feature) of each group; NaN where a set has no value.

    Values are counted by cell in GRID ranges; what lies in the ranges that hold a set's
    middle is then counted value by value."""
    grids = _grids(rows, numeric)
    counts = _collected(summed_by_cell(rows, _range_counts(grids, numeric), len(numeric) * 2, "int64"), "int64", (len(numeric), GRID))
    return _medians_within(rows, numeric, sets, grids, counts)


def _medians_within(
    rows: DataFrame, numeric: list[str], sets: list[tuple[int, ...]], grids: dict[str, list[np.ndarray]], counts: dict[str, dict[int, np.ndarray]]
) -> dict[str, np.ndarray]:
    """Medians from the counts of each cell and the values of the ranges that hold a middle."""
    wanted: dict[str, dict[tuple[int, int], list[tuple[int, int, int]]]] = {}  # by (feature, range): (set, middle, place in the range)
    sizes: dict[str, np.ndarray] = {}
    for name, own in counts.items():
        sizes[name] = np.zeros((len(sets), len(numeric)), np.int64)
        for s, cells in enumerate(sets):
            total = sum((own[c] for c in cells if c in own), np.zeros((len(numeric), GRID), np.int64))
            upto = np.cumsum(total, axis=1)
            sizes[name][s] = upto[:, -1]
            for j, n in enumerate(upto[:, -1]):
                for middle, place in enumerate(((n - 1) // 2, n // 2) if n else ()):
                    at = int(np.searchsorted(upto[j], place, side="right"))
                    wanted.setdefault(name, {}).setdefault((j, at), []).append((s, middle, int(place - (upto[j, at - 1] if at else 0))))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_steps(batches, len(numeric) * 2):
            for name, _, mine in _groups(batch):
                row, cell = _pairs(mine)
                cells, code = np.unique(cell, return_inverse=True)
                for j, f in enumerate(numeric):
                    ranges = [at for k, at in wanted.get(name, {}) if k == j]
                    value = mine.column(f).to_numpy(zero_copy_only=False).astype(float)
                    some = (~np.isnan(value) & np.isin(np.searchsorted(grids[name][j], value), ranges))[row]
                    # equal values of a cell leave as one row with their number
                    values, place = np.unique(value[row[some]], return_inverse=True)
                    found, n = np.unique(code[some] * max(1, len(values)) + place, return_counts=True)
                    own, at = np.divmod(found, max(1, len(values)))
                    spot = np.searchsorted(grids[name][j], values)
                    columns = [pa.array([name] * len(n), pa.string()), pa.array(np.full(len(n), j, np.int32)), pa.array(spot[at].astype(np.int32))]
                    columns += [pa.array(cells[own].astype(np.int32)), pa.array(values[at]), pa.array(n.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["grp", "feature", "range", "cell", "value", "n"])

    def pick(table: pa.Table) -> pa.Table:
        name, j, at = (table.column(c)[0].as_py() for c in ("grp", "feature", "range"))
        cell, value, n = (table.column(c).to_numpy() for c in ("cell", "value", "n"))
        order = np.argsort(value, kind="stable")
        cell, value, n = cell[order], value[order], n[order]
        found = []
        for s, middle, place in wanted[name][j, at]:
            mine = np.isin(cell, sets[s])
            found.append((s, middle, value[mine][np.searchsorted(np.cumsum(n[mine]), place, side="right")]))
        ids, ends, values = (np.array(x) for x in zip(*found, strict=True))
        return pa.table({"grp": [name] * len(found), "feature": pa.array([j] * len(found), pa.int32()), "id": ids.astype(np.int32), "middle": ends.astype(np.int32), "value": values})

    counted = rows.select("grp", "cells", *numeric).mapInArrow(near, "grp string, feature int, range int, cell int, value double, n bigint")
    counted = counted.groupBy("grp", "feature", "range", "cell", "value").agg(F.sum("n").alias("n"))
    out = {name: np.where(n > 0, 0.0, np.nan) for name, n in sizes.items()}
    for r in counted.groupBy("grp", "feature", "range").applyInArrow(pick, "grp string, feature int, id int, middle int, value double").collect():
        out[r["grp"]][r["id"], r["feature"]] += r["value"] / 2
    return out


# --- solving ----------------------------------------------------------------------------------


def design(basis: Basis, plain: np.ndarray, squares: np.ndarray, medians: np.ndarray) -> np.ndarray:
    """T: basis columns to the scaled features of a training set, given its plain sums of the basis
    columns and of the squared numbers. Features that the set has no value or row of are zero columns."""
    numbers = len(basis.features.numeric)
    fields = basis.fields
    out = np.zeros((basis.size, numbers + sum(n + 1 for _, _, n in fields)))
    rows = plain[0]
    gaps, values = plain[1 + numbers : 1 + 2 * numbers], plain[1 : 1 + numbers]
    for j in np.flatnonzero(~np.isnan(medians)):
        mean = (values[j] + medians[j] * gaps[j]) / rows
        spread = np.sqrt(max((squares[j] + medians[j] ** 2 * gaps[j]) / rows - mean * mean, 0.0))
        scale = spread if spread > 1e-9 * max(1.0, abs(mean)) else 1.0
        out[1 + j, j], out[1 + numbers + j, j], out[0, j] = 1 / scale, medians[j] / scale, -mean / scale
    column = numbers
    for _, at, n in fields:
        seen = plain[at : at + n + 2].copy()
        label = {i: column + i for i in range(n) if seen[i] >= RARE_CATEGORY}
        label |= {i: column + n for i in range(n + 1) if i not in label and seen[i] > 0}  # rare ones share a column
        for i, c in label.items():
            out[at + i, c] = 1.0
        if seen[n + 1] > 0 and label:  # a gap counts as the most frequent category
            out[at + n + 1, label[int(np.argmax(seen[: n + 1]))]] = 1.0
        column += n + 1
    return out


def polished(gram: np.ndarray, cross: np.ndarray, l1: float, l2: float, guess: np.ndarray) -> np.ndarray | None:
    """The minimum itself if `guess` has its signs: one linear system, accepted only if it meets the optimality conditions."""
    active = np.flatnonzero(guess)
    out = np.zeros(len(guess))
    if len(active):
        sign = np.sign(guess[active])
        out[active] = np.linalg.lstsq(gram[np.ix_(active, active)] + l2 * np.eye(len(active)), cross[active] - l1 * sign, rcond=1e-13)[0]
        if (np.sign(out[active]) != sign).any():
            return None
    slope = cross - gram @ out - l2 * out
    size = 1e-9 * max(1.0, np.abs(cross).max(initial=0.0))
    slope[active] -= l1 * np.sign(out[active])
    return out if (np.abs(slope[active]) <= size).all() and (np.abs(np.delete(slope, active)) <= l1 + size).all() else None


def descend(gram: np.ndarray, cross: np.ndarray, l1: np.ndarray, l2: np.ndarray, tolerance: float = 1e-6) -> np.ndarray:
    """Coefficients (problem, column) that minimise x'Gx / 2 - c'x + l1 |x| + l2 x'x / 2, all problems at once.

    Sweeps find the signs, one in FULL over all columns and the others over those in use; every
    POLISH sweeps the problems whose signs are found are solved and leave."""
    out = np.zeros(cross.shape)
    diagonal = np.einsum("kjj->kj", gram) + l2[:, None]
    usable = np.flatnonzero((diagonal > 1e-12).any(axis=0))
    left = cross.copy()  # c - G x
    live = np.arange(len(out))
    for sweep in range(1, SWEEPS + 1):
        moved = np.zeros(len(live))
        full = sweep % FULL == 1
        for j in usable if full else usable[(out[np.ix_(live, usable)] != 0).any(axis=0)]:
            size = np.maximum(diagonal[live, j], 1e-12)
            old = out[live, j]
            pull = left[live, j] + gram[live, j, j] * old
            new = np.where(diagonal[live, j] > 1e-12, np.sign(pull) * np.maximum(np.abs(pull) - l1[live], 0.0) / size, 0.0)
            step = new - old
            if step.any():
                left[live] -= step[:, None] * gram[live, j]
                out[live, j] = new
                moved = np.maximum(moved, np.abs(step) * np.sqrt(size))
        done = (moved <= tolerance) & full
        if sweep % POLISH == 0 or done.any():
            for at, k in enumerate(live):
                if (exact := polished(gram[k], cross[k], l1[k], l2[k], out[k])) is not None:
                    out[k], done[at] = exact, True
        live = live[~done]
        if not len(live):
            break
    return out


def solve(gram: np.ndarray, shape: np.ndarray, models: dict[str, list[Params]], label_at: int) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    """(model, setting, coefficients on the basis, those of the scaled features) of one training set with weighted Gram matrix `gram`, whose
    last row and column are the label's."""
    weight = gram[0, 0]
    x = shape.T @ gram[:label_at, :label_at] @ shape
    y, ones, mean = shape.T @ gram[:label_at, label_at], shape.T @ gram[:label_at, 0], gram[0, label_at] / weight
    centred, cross = x - np.outer(ones, ones) / weight, y - ones * mean
    values, vectors = np.linalg.eigh(centred)
    turned = vectors.T @ cross

    def on_basis(beta: np.ndarray, intercept: bool) -> tuple[np.ndarray, np.ndarray]:
        out = shape @ beta
        if intercept:
            out[0] += mean - ones @ beta / weight
        return out, beta

    def least_norm(matrix_values: np.ndarray, matrix_vectors: np.ndarray, right: np.ndarray) -> np.ndarray:
        good = matrix_values > SMALL_EIGENVALUE * max(matrix_values.max(initial=0.0), 1e-300)
        return matrix_vectors[:, good] @ (right[good] / matrix_values[good])

    out, sparse = [], []
    for name, settings in models.items():
        for i, p in enumerate(settings):
            if name == "Linear Regression" and p["intercept"]:
                out.append((name, i, *on_basis(least_norm(values, vectors, turned), True)))
            elif name == "Linear Regression":
                own_values, own_vectors = np.linalg.eigh(x)
                out.append((name, i, *on_basis(least_norm(own_values, own_vectors, own_vectors.T @ y), False)))
            elif name == "Ridge":
                out.append((name, i, *on_basis(vectors @ (turned / (np.maximum(values, 0.0) + p["alpha"])), True)))
            else:
                ratio = p.get("ratio", 1.0)
                sparse.append((name, i, p["alpha"] * ratio, p["alpha"] * (1 - ratio)))
    if sparse:
        grams = np.broadcast_to(centred / weight, (len(sparse), *centred.shape))
        found = descend(grams, np.tile(cross / weight, (len(sparse), 1)), np.array([s[2] for s in sparse]), np.array([s[3] for s in sparse]))
        out += [(name, i, *on_basis(beta, True)) for (name, i, _, _), beta in zip(sparse, found, strict=True)]
    return out


# --- evaluation --------------------------------------------------------------------------------------


@dataclass
class Fits:
    """Fitted models of a bake-off: coefficient vectors on the basis by group, training set, model and setting."""

    basis: Basis
    outers: list[Outer]
    models: dict[str, list[Params]]
    refits: dict[str, dict[tuple[int, str, int], np.ndarray]] = field(default_factory=dict)  # by (outer, model, setting)
    scaled: dict[str, dict[tuple[int, str, int], np.ndarray]] = field(default_factory=dict)  # the same on scaled features
    tuning: dict[str, dict[tuple[int, int, str, int], np.ndarray]] = field(default_factory=dict)  # and inner fold
    chosen: dict[str, dict[tuple[int, str], int]] = field(default_factory=dict)


def _ready(df: DataFrame, basis: Basis, group: Column, target: str, weight: str | None, keep: list[str]) -> DataFrame:
    own = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    y = F.col(target).cast("double")
    rows = df.select(group.cast("string").alias("grp"), "cells", *basis.inputs(), y.alias("_money"), w.alias("_weight"), *own)
    return rows.filter("grp is not null and _money is not null")


def _fitted_columns(rows: DataFrame, *kept: str) -> DataFrame:
    """Without the kept columns but those named: only these go to the tasks."""
    return rows.select(*[c for c in rows.columns if not c.startswith("keep_") or c in kept])


def _medians_and_grams(rows: DataFrame, basis: Basis, sets: list[tuple[int, ...]]) -> tuple[dict[str, np.ndarray], dict[str, dict[int, np.ndarray]]]:
    """Medians of the training sets, and by cell the weighted Gram matrices (last row and column the label's), with plain sums and
    sums of squares as two more rows. The counts that the medians come from are summed in the same pass."""
    p, numeric = basis.size, basis.features.numeric
    grids = _grids(rows, numeric)
    counted = _range_counts(grids, numeric)

    def make(name: str, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        b = np.hstack([basis.matrix(batch), np.log1p(batch.column("_money").to_numpy(zero_copy_only=False))[:, None]])
        w = batch.column("_weight").to_numpy(zero_copy_only=False)
        counts = dict(counted(name, batch))
        for c, mine in _by_cell(batch):
            own = b[mine]
            out = np.empty((p + 3, p + 1))
            out[: p + 1] = (own * w[mine][:, None]).T @ own
            out[p + 1], out[p + 2] = own.sum(axis=0), np.einsum("ij,ij->j", own, own)
            yield c, np.concatenate([out.ravel(), counts[c].ravel()])  # counts stay whole as doubles

    size = (p + 3) * (p + 1)
    sums = _collected(summed_by_cell(rows, make, p, "float64"), "float64", (size + len(numeric) * GRID,))
    grams = {name: {c: v[:size].reshape(p + 3, p + 1) for c, v in own.items()} for name, own in sums.items()}
    counts = {name: {c: v[size:].astype(np.int64).reshape(len(numeric), GRID) for c, v in own.items()} for name, own in sums.items()}
    return _medians_within(rows, numeric, sets, grids, counts), grams


def set_sums(own: dict[int, np.ndarray], cells: tuple[int, ...], scale: tuple[tuple[int, float], ...], size: int) -> np.ndarray:
    """Gram matrix and plain sums of a training set; the factors are on weights, so plain sums (the last two rows) have none."""
    factors = dict(scale)
    out = np.zeros((size + 3, size + 1))
    for c in cells:
        if c in own:
            out[: size + 1] += own[c][: size + 1] * factors[c] if c in factors else own[c][: size + 1]
            out[size + 1 :] += own[c][size + 1 :]
    return out


def fit_all(rows: DataFrame, basis: Basis, outers: list[Outer], models: dict[str, list[Params]]) -> Fits:
    """Every model and setting on every outer and inner training set of every group. The fits are
    dealt to tasks, one for each group and outer training set."""
    sets = list(dict.fromkeys(s for o in outers for s in o.sets()))
    number = {s: i for i, s in enumerate(sets)}
    medians, grams = _medians_and_grams(_fitted_columns(rows), basis, sets)
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((basis, outers, models, grams, medians, number))
    tuned = max(map(len, models.values())) > 1

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, outers, models, grams, medians, number = shared.value
        p, numbers = basis.size, len(basis.features.numeric)
        for batch in batches:
            for name, o in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = []
                for inner, cells in enumerate(outers[o].sets() if tuned else outers[o].sets()[:1]):
                    total = set_sums(grams[name], cells, outers[o].scale, p)
                    if total[0, 0] <= 0:
                        continue
                    plain, squares = total[p + 1, :p], total[p + 2, 1 : 1 + numbers]
                    shape = design(basis, plain, squares, medians[name][number[cells]])
                    found += [(inner - 1, m, i, beta.tobytes(), own.tobytes()) for m, i, beta, own in solve(total[: p + 1], shape, models, p)]
                if found:
                    inner, model, setting, beta, scaled = zip(*found, strict=True)
                    n = len(found)
                    columns = [pa.array([name] * n), pa.array([o] * n, pa.int32()), pa.array(inner, pa.int32()), pa.array(model), pa.array(setting, pa.int32()), pa.array(beta, pa.binary()), pa.array(scaled, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["grp", "outer", "inner", "model", "setting", "beta", "scaled"])

    work = [(name, o) for name in sorted(grams) for o in range(len(outers))]
    fits = Fits(basis, outers, models)
    if not work:
        return fits
    tasks = spark.createDataFrame(work, "grp string, outer int").repartition(min(len(work), 200))
    for r in tasks.mapInArrow(fit, "grp string, outer int, inner int, model string, setting int, beta binary, scaled binary").collect():
        beta = np.frombuffer(r["beta"])
        if r["inner"] < 0:
            fits.refits.setdefault(r["grp"], {})[r["outer"], r["model"], r["setting"]] = beta
            fits.scaled.setdefault(r["grp"], {})[r["outer"], r["model"], r["setting"]] = np.frombuffer(r["scaled"])
        else:
            fits.tuning.setdefault(r["grp"], {})[r["outer"], r["inner"], r["model"], r["setting"]] = beta
    shared.unpersist()
    return fits


def tune_all(rows: DataFrame, fits: Fits) -> None:
    """Chooses each model's setting of lowest mean absolute error in money over the inner folds, the first one on ties."""
    if not fits.tuning:
        fits.chosen = {name: {(o, m): 0 for o, m, _ in own} for name, own in fits.refits.items()}
        return
    betas: dict[tuple[str, int], list] = {}  # by (group, outer and inner fold)
    for name, own in fits.tuning.items():
        for (o, inner, m, i), beta in own.items():
            betas.setdefault((name, o, inner), []).append((m, i, beta))
    packed = {key: ([(m, i) for m, i, _ in found], np.stack([b for *_, b in found], axis=1)) for key, found in betas.items()}
    shared = rows.sparkSession.sparkContext.broadcast((fits.basis, fits.outers, packed))

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, outers, packed = shared.value
        sums: dict[tuple, np.ndarray] = {}
        tests: dict[int, list[tuple[int, int]]] = {}
        for o, outer in enumerate(outers):
            for inner, (_, test) in enumerate(outer.inner):
                for c in test:
                    tests.setdefault(c, []).append((o, inner))
        for step in _in_steps(batches, basis.size):
            for name, _, mine in _groups(step):
                b, money = basis.matrix(mine), mine.column("_money").to_numpy(zero_copy_only=False)
                for c, rows_of_cell in _by_cell(mine):
                    own, paid = b[rows_of_cell], money[rows_of_cell][:, None]
                    for o, inner in tests.get(c, ()):
                        if (name, o, inner) in packed:
                            with np.errstate(over="ignore", invalid="ignore"):
                                off = np.abs(paid - np.expm1(own @ packed[name, o, inner][1]))
                            total = np.append(off.sum(axis=0), len(rows_of_cell))
                            sums[name, o, inner] = sums.get((name, o, inner), 0) + total
        for (name, o, inner), total in sums.items():
            labels = packed[name, o, inner][0]
            n = len(labels)
            columns = [pa.array([name] * n), pa.array([o] * n, pa.int32()), pa.array([inner] * n, pa.int32()), pa.array([m for m, _ in labels])]
            columns += [pa.array([i for _, i in labels], pa.int32()), pa.array(total[:-1]), pa.array([int(total[-1])] * n)]
            yield pa.RecordBatch.from_arrays(columns, names=["grp", "outer", "inner", "model", "setting", "off", "n"])

    sums = _fitted_columns(rows).drop("_weight").mapInArrow(errors, "grp string, outer int, inner int, model string, setting int, off double, n bigint")
    means = sums.groupBy("grp", "outer", "inner", "model", "setting").agg((F.sum("off") / F.sum("n")).alias("error"))
    found: dict[tuple, float] = {}
    for r in means.groupBy("grp", "outer", "model", "setting").agg(F.avg("error").alias("error")).collect():
        found[r["grp"], r["outer"], r["model"], r["setting"]] = r["error"]
    shared.unpersist()
    for name, own in fits.refits.items():
        for o, m in {(o, m) for o, m, _ in own}:
            scores = [found.get((name, o, m, i), np.inf) for i in range(len(fits.models[m]))]
            scores = [np.inf if np.isnan(s) else s for s in scores]
            fits.chosen.setdefault(name, {})[o, m] = int(np.argmin(scores))


Packed = dict[tuple[str, int], tuple[list[str], np.ndarray]]


def _packed(fits: Fits, selected: dict[str, str] | None = None) -> Packed:
    """(models, coefficients of the chosen settings as columns) by group and outer training set."""
    packed: Packed = {}
    for name, own in fits.chosen.items():
        for o in {o for o, _ in own}:
            names = [m for m in fits.models if (o, m) in own and (selected is None or selected.get(name) == m)]
            if names:
                packed[name, o] = names, np.stack([fits.refits[name][o, m, own[o, m]] for m in names], axis=1)
    return packed


def _tests(outers: list[Outer]) -> dict[int, list[int]]:
    """Outer training sets that a cell is held out from."""
    tests: dict[int, list[int]] = {}
    for o, outer in enumerate(outers):
        for c in outer.test:
            tests.setdefault(c, []).append(o)
    return tests


def score_all(rows: DataFrame, fits: Fits, keep: list[str], selected: dict[str, str] | None = None) -> DataFrame:
    """Every held-out row with the prediction of every model, or of its group's selected one: grp, the kept columns,
    outer, Model, actual, predicted, weight."""
    shared = rows.sparkSession.sparkContext.broadcast((fits.basis, fits.outers, _packed(fits, selected)))

    def held_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, outers, packed = shared.value
        tests = _tests(outers)
        for step in _in_steps(batches, basis.size):
            for name, _, mine in _groups(step):
                b = basis.matrix(mine)
                for c, at in _by_cell(mine):
                    for o in tests.get(c, ()):
                        if (name, o) not in packed:
                            continue
                        names, beta = packed[name, o]
                        with np.errstate(over="ignore"):
                            scores = np.expm1(b[at] @ beta)
                        own = mine.take(pa.array(at))
                        kept = [own.column(own.schema.get_field_index(f"keep_{i}")) for i in range(len(keep))]
                        for m, model in enumerate(names):
                            columns = [own.column("grp"), *kept, pa.array([o] * len(at), pa.int32()), pa.array([model] * len(at)), own.column("_money"), pa.array(scores[:, m]), own.column("_weight")]
                            yield pa.RecordBatch.from_arrays(columns, names=["grp", *keep, "outer", "Model", "actual", "predicted", "weight"])

    kinds = [rows.schema[f"keep_{i}"].dataType.simpleString() for i in range(len(keep))]
    kept = "".join(f"`{c}` {kind}, " for c, kind in zip(keep, kinds, strict=True))
    return rows.mapInArrow(held_out, f"grp string, {kept}outer int, Model string, actual double, predicted double, weight double")


def _met(a: dict, b: dict) -> dict:
    """Moments of two sets of rows together."""
    w, away = a["w"] + b["w"], b["mean"] - a["mean"]
    share = b["w"] / w if w else 0.0
    out = {k: a[k] + b[k] for k in ("n", "w", "off", "squares")}
    out |= {"mean": a["mean"] + away * share, "around": a["around"] + b["around"] + away * away * a["w"] * share}
    return out | {"low": min(a["low"], b["low"]), "high": max(a["high"], b["high"])}


def score_moments(rows: DataFrame, fits: Fits, keep: list[str], keys: list[str]) -> DataFrame:
    """What metrics need of the held-out predictions, summed where they are made, so that none is stored: by grp, the
    kept columns `keys`, outer and Model the rows n, their weight w, mean label and weighted squares `around` it,
    lowest and highest label, and weighted absolute and squared errors `off` and `squares`. A task gives one row a key."""
    shared = rows.sparkSession.sparkContext.broadcast((fits.basis, fits.outers, _packed(fits)))
    places = [keep.index(k) for k in keys]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, outers, packed = shared.value
        tests = _tests(outers)
        sums: dict[tuple, dict] = {}
        for step in _in_steps(batches, basis.size):
            for name, _, mine in _groups(step):
                b, money, weight = basis.matrix(mine), *(mine.column(c).to_numpy(zero_copy_only=False) for c in ("_money", "_weight"))
                code, labels = np.zeros(mine.num_rows, np.int64), [()]
                for i in places:
                    column = mine.column(f"keep_{i}").dictionary_encode(null_encoding="encode")
                    values = column.dictionary.to_pylist()
                    code = code * len(values) + column.indices.to_numpy(zero_copy_only=False)
                    labels = [(*known, v) for known in labels for v in values]
                for c, held in _by_cell(mine):
                    for key in np.unique(code[held]).tolist() if c in tests else ():
                        at = held[code[held] == key]
                        y, w = money[at], weight[at]
                        mean = y[0] + (w @ (y - y[0])) / w.sum() if w.any() else 0.0
                        facts = {"n": len(at), "w": w.sum(), "mean": mean, "around": w @ (y - mean) ** 2, "low": y.min(), "high": y.max()}
                        for o in tests[c]:
                            if (name, o) not in packed:
                                continue
                            with np.errstate(over="ignore", invalid="ignore"):
                                away = y[:, None] - np.expm1(b[at] @ packed[name, o][1])
                                own = facts | {"off": w @ np.abs(away), "squares": w @ (away * away)}
                            to = (name, labels[key], o)
                            sums[to] = _met(sums[to], own) if to in sums else own
        for (name, label, o), own in sums.items():
            names = packed[name, o][0]
            n = len(names)
            columns = [pa.array([name] * n), *(pa.array([v] * n, rows_schema[i]) for i, v in zip(places, label, strict=True))]
            columns += [pa.array([o] * n, pa.int32()), pa.array(names)]
            columns += [pa.array(np.broadcast_to(own[k], n).astype(np.int64 if k == "n" else float)) for k in MOMENTS]
            yield pa.RecordBatch.from_arrays(columns, names=["grp", *keys, "outer", "Model", *MOMENTS])

    rows_schema = [to_arrow_type(rows.schema[f"keep_{i}"].dataType) for i in range(len(keep))]
    kinds = "".join(f"`{k}` {rows.schema[f'keep_{i}'].dataType.simpleString()}, " for k, i in zip(keys, places, strict=True))
    facts = ", ".join(f"{k} {'bigint' if k == 'n' else 'double'}" for k in MOMENTS)
    return _fitted_columns(rows, *[f"keep_{i}" for i in places]).mapInArrow(summed, f"grp string, {kinds}outer int, Model string, {facts}")


def train_companies(df: DataFrame, group: Column, outers: list[Outer]) -> DataFrame:
    """(grp, outer, n_train_companies)."""
    members = [(c, o) for o, outer in enumerate(outers) for c in outer.train]
    wanted = df.sparkSession.createDataFrame(members, "cell int, outer int")
    held = df.select(group.cast("string").alias("grp"), "company_id", F.explode("cells").alias("cell")).distinct()
    found = held.join(F.broadcast(wanted), "cell").select("grp", "outer", "company_id").distinct()
    return found.groupBy("grp", "outer").agg(F.count("*").alias("n_train_companies"))


@dataclass
class BakeOff:
    """Tuned models of all training sets, with the stored rows that they were held out from."""

    rows: DataFrame
    fits: Fits
    keep: list[str]
    final: Fits | None = None  # of all rows, from the same sums

    def settings(self) -> DataFrame:
        """(grp, outer, Model, best_params and the labels of the outer training set)."""
        fits = self.fits
        facts = [(name, o, m, json.dumps(fits.models[m][i]), *fits.outers[o].labels.values()) for name, own in fits.chosen.items() for (o, m), i in own.items()]
        labels = ", ".join(f"`{c}` {'double' if isinstance(v, float) else 'int'}" for c, v in (fits.outers[0].labels if fits.outers else {}).items())
        return self.rows.sparkSession.createDataFrame(facts, f"grp string, outer int, Model string, best_params string{', ' + labels if labels else ''}")

    def _labelled(self, df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(self.settings()), ["grp", "outer", "Model"]).drop("grp", "outer")

    def predictions(self, selected: dict[str, str]) -> DataFrame:
        """Held-out predictions of the selected model of each group."""
        return self._labelled(score_all(self.rows, self.fits, self.keep, selected))

    def moments(self, keys: list[str]) -> DataFrame:
        """`score_moments` with the labels of the training sets, stored; for metrics.metrics_of_moments."""
        return written(self._labelled(score_moments(self.rows, self.fits, self.keep, keys)), "moments")


def bake_off(
    df: DataFrame, outers: list[Outer], models: dict[str, list[Params]], features: FeatureSet, target: str, weight: str | None, keep: list[str], group: Column,
    whole: Outer | None = None,
) -> BakeOff:
    """Every model tuned on every training set of every group; `df` has `cells`. The final fits on `whole`, a training
    set of all rows (whole_of_grouped, whole_of_yearly), are one set more in the same passes."""
    basis = basis_of(df, features)
    rows = written(_ready(df, basis, group, target, weight, keep), "gram-rows")
    fits = fit_all(rows, basis, outers if whole is None else [*outers, whole], models)
    tune_all(rows, fits)
    if whole is None:
        return BakeOff(rows, fits, keep)
    folds, final = _parted(fits)
    return BakeOff(rows, folds, keep, final)


def _parted(fits: Fits) -> tuple[Fits, Fits]:
    """The fits of the folds, and those of the last training set as its only one."""
    last = len(fits.outers) - 1
    folds, final = Fits(fits.basis, fits.outers[:-1], fits.models), Fits(fits.basis, fits.outers[-1:], fits.models)
    for part in ("refits", "scaled", "tuning", "chosen"):
        for name, own in getattr(fits, part).items():
            getattr(folds, part)[name] = {key: v for key, v in own.items() if key[0] != last}
            getattr(final, part)[name] = {(0, *key[1:]): v for key, v in own.items() if key[0] == last}
    return folds, final


def out_of_fold(
    df: DataFrame, outers: list[Outer], models: dict[str, list[Params]], features: FeatureSet, target: str, weight: str | None, keep: list[str], group: Column
) -> DataFrame:
    """Held-out predictions of every tuned model and training set, like estimators.out_of_fold, for all
    groups together, stored; `df` has `cells`. Three passes over its rows besides those for medians and categories."""
    bake = bake_off(df, outers, models, features, target, weight, keep, group)
    table = bake.settings().join(train_companies(df, group, outers), ["grp", "outer"])
    scored = score_all(bake.rows, bake.fits, keep).join(F.broadcast(table), ["grp", "outer", "Model"]).drop("grp", "outer")
    return written(scored, "held-out")  # metrics read it several times


# --- final models ------------------------------------------------------------------------------------


def whole_grouped(df: DataFrame, group: str, inner: int = INNER_FOLDS) -> tuple[DataFrame, list[Outer]]:
    """Cells of a final fit on all rows, tuned on company folds."""
    rows, outers = grouped_cells(df, group, k=1, repeats=1, inner=inner)
    cells = tuple(range(2 * inner))
    pairs = tuple((tuple(c for c in cells if c % inner != out), tuple(c for c in cells if c % inner == out)) for out in range(inner))
    return rows, [Outer({}, cells, (), pairs if inner > 1 else ())]


def whole_of_grouped(k: int = FOLDS, inner: int = INNER_FOLDS) -> Outer:
    """The training set of whole_grouped as cells of grouped_cells: those of its first repeat, which every row has one of."""
    cells = tuple(range((k + 1) * inner))
    pairs = tuple((tuple(c for c in cells if c % inner != out), tuple(c for c in cells if c % inner == out)) for out in range(inner))
    return Outer({}, cells, (), pairs if inner > 1 else ())


def whole_of_yearly(df: DataFrame, year: str = "target_year", offsets: list[int] = INNER_OFFSETS) -> Outer:
    """The training set of whole_yearly, whose cells are the years as in yearly_cells."""
    return whole_yearly(df, year, offsets)[1][0]


def whole_yearly(df: DataFrame, year: str = "target_year", offsets: list[int] = INNER_OFFSETS) -> tuple[DataFrame, list[Outer]]:
    """Cells of a final fit on all rows, tuned on the last years."""
    last = df.agg(F.max(year)).first()[0]
    rows, outers = yearly_cells(df, year, [last - o for o in offsets] if last is not None else [], [])
    cells = tuple(sorted({c for o in outers for c in (*o.train, *o.test)}))
    return rows, [Outer({}, cells, (), tuple((o.train, o.test) for o in outers))]


def fit_final(df: DataFrame, outers: list[Outer], models: dict[str, list[Params]], features: FeatureSet, target: str, weight: str | None, group: Column) -> Fits:
    """Every model of every group tuned and refitted on all rows; `df` has `cells` of whole_grouped or whole_yearly."""
    basis = basis_of(df, features)
    rows = written(_ready(df, basis, group, target, weight, []), "gram-rows")
    fits = fit_all(rows, basis, outers, models)
    tune_all(rows, fits)
    return fits


def predict(df: DataFrame, fits: Fits, selected: dict[str, str], group: Column, keep: list[str], name: str = "predicted") -> DataFrame:
    """The kept columns of every row of a group with a selected model, and that model's prediction."""
    betas = {g: fits.refits[g][0, m, fits.chosen[g][0, m]] for g, m in selected.items() if (0, m) in fits.chosen.get(g, {})}
    rows = df.select(group.cast("string").alias("grp"), *fits.basis.inputs(), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)])
    rows = rows.filter(F.col("grp").isin(list(betas)))
    shared = df.sparkSession.sparkContext.broadcast((fits.basis, betas))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, betas = shared.value
        for step in _in_steps(batches, basis.size):
            for g, _, mine in _groups(step):
                with np.errstate(over="ignore"):
                    scores = np.expm1(basis.matrix(mine) @ betas[g])
                kept = [mine.column(f"keep_{i}") for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(scores)], names=[*keep, name])

    kinds = [rows.schema[f"keep_{i}"].dataType.simpleString() for i in range(len(keep))]
    return rows.mapInArrow(score, "".join(f"`{c}` {kind}, " for c, kind in zip(keep, kinds, strict=True)) + f"`{name}` double")


def feature_weights(fits: Fits, selected: dict[str, str], spark) -> DataFrame:
    """(mission, Model, feature, weight, metric_type, direction) of the selected refitted models."""
    rows = []
    for g, m in selected.items():
        if (0, m) in fits.chosen.get(g, {}):
            weights = fits.scaled[g][0, m, fits.chosen[g][0, m]]
            rows += [(g, m, n, float(w)) for n, w in zip(fits.basis.names, weights, strict=True)]
    table = spark.createDataFrame(rows, "mission string, Model string, feature string, weight double")
    sign = F.when(F.col("weight") > 0, "positive").when(F.col("weight") < 0, "negative").otherwise("zero")
    return table.withColumn("metric_type", F.lit("coefficient")).withColumn("direction", sign)
