"""Exact cosine similarity between item sets (SIM2, SIM3, AGG6 over pairs).

Items are rows ``(dataset, item, embedding)``.  The all-pairs score matrix is
never materialised: both sides are hashed into blocks, each left block meets
each right block in one group (a cogrouped ``applyInArrow``) that keeps the
best ``k`` per (left item, target dataset), and a window merges the groups.
A group holds at most about ``LEFT_MB`` and ``CELL_MB`` of vectors, so the
memory of one task is bounded whatever the table size or the size of the
largest dataset.  It works through its pairs in cells of at most ``cell_rows``
rows per side (by default ``TILE_ROWS`` right rows), which share the running
best ``k``: smaller cells hold less at once, but shuffle no row again and
write no candidate more.  There is one path for every size.

Inside a cell a bound rules pairs out before they are scored.  The cell's
vectors are rotated to the principal axes of a bounded sample of its right
rows; a product over the leading axes plus the product of the remaining norms
bounds a score from above, and only pairs whose bound reaches the floor of
their (item, target) -- the k-th score over a bounded sample of the target's
rows -- are scored.  Where a trial on a few rows shows that too many pairs
would survive to be worth it (vectors without a preferred direction), one
product covers the whole batch, and trials grow rarer.

A target's right rows come by strips of ``TILE_ROWS``.  The candidates of a
strip's cells wait with their single precision scores while the floor rises,
and those near its last value are scored.  A zero vector goes into no product:
its pairs score 0, so those with the smallest keys are entered as they are.

Products and bounds are in single precision and only choose candidates: a
pair within twice the largest possible rounding error of its floor, or of the
k-th score, is scored by a sum in fixed order over the pair's unit vectors in
double precision.  So both ways give the same values.
Equal vectors therefore get equal scores whatever the batch, and ties go to
the smaller (target, match) key.  Scores are reported unrounded; a zero
vector has similarity 0 with everything.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# fixed layout of item tables fed to the kernel
DATASET, ITEM, VECTOR = "dataset", "item", "embedding"

# scores held at once by a cell (~16 MB of float64)
_MAX_SCORES = 2_000_000
# pairs scored again at once
_MAX_PAIRS = 50_000
# far above the rounding of a double precision product of unit vectors, far below any real difference
_MARGIN = 1e-9
# memory budget of the right side of a cell and of the left one (as float64 unit vectors), and a floor on their rows
CELL_MB, LEFT_MB = 64, 16
MIN_CELL_ROWS = 256
# right rows of a cell scored at once
TILE_ROWS = 8192
# right rows of a target whose scores give the floor, and of a cell that give its axes
FLOOR_ROWS, AXES_ROWS = 512, 4096
# leading axes by share of all, tried in this order
LEADING = (0.125, 0.25, 0.5, 0.75)
# rows a side of a product, which then stays in a core's cache
PIECE_ROWS = 512
# left rows of a batch on which the bound is tried first, and the most batches without a trial
_TRIAL_ROWS, _MAX_WAIT = 32, 64
# costs as shares of a batch's product (measured): of scoring every pair alone, and of comparing the bounds
_PAIR_COST, _COMPARE_COST = 100, 0.3


def as_items(df: DataFrame, dataset, item: str, vector: str = "embedding") -> DataFrame:
    """Project a table to the kernel layout; rows without key or vector, or
    whose vector holds a null or NaN element, are dropped (FLT3).

    ``dataset`` is a column name or a Column (e.g. ``F.lit('SR')``).
    """
    ds = F.col(dataset) if isinstance(dataset, str) else dataset
    # the stored element type is kept (float32 halves the shuffled bytes);
    # the cell computes in float64
    bad = F.exists(F.col(VECTOR), lambda x: x.isNull() | F.isnan(x))
    return (df.select(ds.alias(DATASET), F.col(item).alias(ITEM), F.col(vector).alias(VECTOR))
            .dropna(subset=[ITEM, VECTOR]).filter(~bad))


def grid_shape(n_left: int, n_right: int, cell_rows: int, parallelism: int, left_rows: int | None = None) -> tuple[int, int]:
    """Blocks per side: cells never exceed ``cell_rows`` per side (``left_rows``
    on the left, if given), and there are at least ``parallelism`` cells when
    the data allows it."""
    gl = max(1, math.ceil(n_left / (left_rows or cell_rows)))
    gr = max(1, math.ceil(n_right / cell_rows))
    while gl * gr < parallelism and (gl < n_left or gr < n_right):
        if (n_left / gl >= n_right / gr and gl < n_left) or gr >= n_right:
            gl += 1
        else:
            gr += 1
    return gl, gr


def _unit_rows(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of an Arrow list column as unit rows, from the flat value buffer."""
    n = len(column)
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks if len(c)]
    if not n or not flat:
        return np.zeros((n, 0))
    m = np.concatenate(flat).astype(np.float64).reshape(n, -1)
    norms = np.sqrt((m * m).sum(axis=1))
    norms[norms == 0.0] = 1.0
    return m / norms[:, None]


def _rounding(d: int) -> float:
    """Twice the largest error of a single precision product of two unit vectors of ``d`` components."""
    return _MARGIN + 2 * (d + 4) * 2.0 ** -24


def _pair_scores(x: np.ndarray, y: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Scores of single pairs, each summed in the same order whatever the batch."""
    out = np.empty(rows.size)
    for at in range(0, rows.size, _MAX_PAIRS):
        part = slice(at, at + _MAX_PAIRS)
        out[part] = (x[rows[part]] * y[cols[part]]).sum(axis=1)
    return out


def _best_k(scores: np.ndarray, x: np.ndarray, y: np.ndarray, k: int):
    """Exact top-k per row; ties go to the smaller column; -inf is never kept.
    Also the number of pairs scored."""
    n, m = scores.shape
    if k < m:
        kth = np.partition(scores, m - k, axis=1)[:, m - k]
        rows, cols = np.nonzero(scores >= kth[:, None] - scores.dtype.type(_rounding(x.shape[1])))
    else:
        rows, cols = np.nonzero(scores > -np.inf)
    keep = scores[rows, cols] > -np.inf
    rows, cols = rows[keep], cols[keep]
    vals = _pair_scores(x, y, rows, cols)
    return *_first_k(rows, cols, vals, k), rows.size


def _first_k(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, k: int):
    """The k highest values of each row, equal ones by the smaller column."""
    order = np.lexsort((cols, -vals, rows))
    rows, cols, vals = rows[order], cols[order], vals[order]
    sel = np.arange(rows.size) - np.searchsorted(rows, rows, side="left") < k
    return rows[sel], cols[sel], vals[sel]


def _merge(vals: np.ndarray, at: np.ndarray, rows: np.ndarray, cols: np.ndarray, new: np.ndarray, k: int) -> None:
    """Enter candidates into the best ``k`` of their rows (``at``: right row, -1 for none)."""
    if not rows.size:
        return
    touched, r = np.unique(rows, return_inverse=True)
    v, c = vals[touched], at[touched]
    old = np.nonzero(c >= 0)
    r, c_, v_ = _first_k(np.r_[old[0], r], np.r_[c[old], cols], np.r_[v[old], new], k)
    place = np.arange(r.size) - np.searchsorted(r, r, side="left")
    v.fill(-np.inf)
    c.fill(-1)
    v[r, place], c[r, place] = v_, c_
    vals[touched], at[touched] = v, c


class _Bound:
    """Upper bounds of a cell's scores from its leading principal axes.

    ``some`` are sampled right vectors, which give the axes; ``tile`` takes
    the right vectors that follow.  ``always`` uses the bound whatever a trial
    says, with the most leading axes (for measuring it); otherwise it is used
    where it pays: after a trial that fails, 1, 2, 4 ... ``_MAX_WAIT`` batches
    go without one."""

    def __init__(self, x: np.ndarray, some: np.ndarray, n_right: int, always: bool = False):
        self.always, d = always, some.shape[1]
        # the axes cost d^3: where the cell's product is not far above that, take the coordinates by size
        if len(x) * n_right > 20 * d * d:
            axes = np.linalg.eigh(some.T @ some)[1][:, ::-1]
            self.turn = lambda m: (m @ axes).astype(np.float32)
        else:
            order = np.argsort(-(some * some).sum(axis=0), kind="stable")
            self.turn = lambda m: m[:, order].astype(np.float32)
        self.margin = np.float32(_rounding(d))
        self.leads = sorted({h for h in (int(d * s) for s in LEADING) if 0 < h < d})
        if always:
            self.leads = self.leads[-1:]
        self.x = self.turn(x)
        self.rest_x = self._rest(self.x)
        self.of, self.wait, self.left = None, 0, 0

    def due(self) -> bool:
        """Whether the next batch has a trial."""
        self.left -= 1
        return self.always or self.left < 0

    def _rest(self, m: np.ndarray) -> dict[int, np.ndarray]:
        return {h: np.sqrt((m[:, h:] ** 2).sum(axis=1)) for h in self.leads}

    def tile(self, strip: _Strip) -> None:
        if self.of is not strip:
            self.of, self.y = strip, self.turn(strip.y)
            self.rest_y = self._rest(self.y)

    def above(self, rows: np.ndarray, h: int, floor: np.ndarray, cols: slice = slice(None)) -> np.ndarray:
        """Which pairs of ``rows`` and the strip's columns may reach their row's floor."""
        most = self.x[rows, :h] @ self.y[cols, :h].T
        most += self.rest_x[h][rows, None] * self.rest_y[h][None, cols]
        return most >= floor[:, None].astype(np.float32) - self.margin

    def leading(self, rows: np.ndarray, floor: np.ndarray) -> int | None:
        """The number of leading axes that pays for this batch, if any does."""
        if self.always:
            return self.leads[0] if self.leads else None
        some = np.arange(0, rows.size, max(1, rows.size // _TRIAL_ROWS))[:_TRIAL_ROWS]
        best, cost = None, 1.0
        for h in self.leads:
            got = _COMPARE_COST + h / self.y.shape[1] + _PAIR_COST * self.above(rows[some], h, floor[some]).mean()
            if got < cost:
                best, cost = h, got
        self.wait = 0 if best else min(2 * self.wait + (not self.wait), _MAX_WAIT)
        self.left = self.wait
        return best


def _codes(left: pa.Table, right: pa.Table, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the key of every row; rising over ``right``, which is sorted by it."""
    keys = pd.concat([right.select(names).to_pandas(), left.select(names).to_pandas()], ignore_index=True)
    code = keys.groupby(names, sort=False, dropna=False).ngroup().to_numpy()
    return code[right.num_rows:], code[:right.num_rows]


class _Tile:
    """Right rows s..e of a cell as unit vectors."""

    def __init__(self, work: _Cell, s: int, e: int, code: int):
        self.work, self.s, self.e, self.code = work, s, e, code
        self.y = work.unit(s, e)
        self.y32 = self.y.astype(np.float32)

    def parts(self):
        """Batches of left row numbers."""
        w = self.work
        rows = np.flatnonzero(w.l_ds == self.code) if w.within else np.arange(w.left.num_rows)
        step = max(1, min(w.most, _MAX_SCORES // max(self.e - self.s, 1)))
        for at in range(0, rows.size, step):
            yield rows[at:at + step]

    def own(self, part: np.ndarray):
        """Per left row, where among the tile's rows the item itself begins and ends."""
        return None if self.work.same is None else tuple(np.clip(b[part], self.s, self.e) - self.s for b in self.work.same)

    def scores(self, part: np.ndarray, exact: bool = False) -> np.ndarray:
        """Scores of a batch, in double precision if ``exact``; pairs of an item with itself are -inf."""
        scores = self.work.x[part] @ self.y.T if exact else self.work.x32[part] @ self.y32.T
        own = self.own(part)
        if own is not None:
            for i in np.flatnonzero(own[0] < own[1]):
                scores[i, own[0][i]:own[1][i]] = -np.inf
        return scores


class _Cell:
    """The rows of one cell: the left rows as unit vectors, the right rows
    sorted by key and made unit vectors tile by tile, target by target.  A tile
    and a batch of left rows have at most ``most`` rows each."""

    def __init__(self, left: pa.Table, right: pa.Table, per_target: bool, exclude_self: bool, within_dataset: bool, most: int | None = None):
        self.left, self.vectors = left, right.column(VECTOR).combine_chunks()
        keys = right.drop_columns([VECTOR])
        self.order = pc.sort_indices(keys, [(DATASET, "ascending"), (ITEM, "ascending")])
        self.right = keys.take(self.order)
        self.x = _unit_rows(left.column(VECTOR))
        self.x32, self.most = self.x.astype(np.float32), most or TILE_ROWS
        l_ds, r_ds = _codes(left, self.right, [DATASET])
        self.l_ds, self.within = l_ds, within_dataset
        cut = np.flatnonzero(np.r_[True, r_ds[1:] != r_ds[:-1], True]) if per_target or within_dataset else np.array([0, len(r_ds)])
        self.slices = [(s, e, r_ds[s]) for s, e in zip(cut[:-1], cut[1:])]
        if exclude_self:
            l_key, r_key = _codes(left, self.right, [DATASET, ITEM])
            self.same = np.searchsorted(r_key, l_key, "left"), np.searchsorted(r_key, l_key, "right")
        else:
            self.same = None

    def unit(self, s: int, e: int, step: int = 1) -> np.ndarray:
        """Unit vectors of right rows s..e."""
        return _unit_rows(pa.chunked_array([self.vectors.take(self.order[s:e].take(pa.array(np.arange(0, e - s, step))))]))

    def tiles(self, s: int, e: int, code: int):
        for at in range(s, e, self.most):
            yield _Tile(self, at, min(at + self.most, e), code)

    def bound(self, always: bool = False) -> _Bound:
        n = self.right.num_rows
        return _Bound(self.x, self.unit(0, n, max(1, n // AXES_ROWS))[:AXES_ROWS], n, always)


def _at_least(scores: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the scores that reach their row's ``least``; fast where few rows have any."""
    some = np.flatnonzero(scores.max(axis=1, initial=-np.inf) >= least)
    rows, cols = np.divmod(np.flatnonzero(scores[some] >= least[some, None]), max(scores.shape[1], 1))
    return some[rows], cols


def _above(scores: np.ndarray, floor: np.ndarray, k: int, margin: float):
    """Pairs that may be among the ``k`` best of their row, whose k-th so far is ``floor``."""
    kind, m = scores.dtype.type, scores.shape[1]
    floor = floor.astype(kind)
    found = None if k < m and np.isneginf(floor).any() else _at_least(scores, floor - kind(margin))
    if k < m and (found is None or found[0].size > 4 * k * len(scores)):
        kth = np.partition(scores, m - k, axis=1)[:, m - k]
        found = _at_least(scores, np.maximum(floor, kth) - kind(margin))
    rows, cols = found
    real = scores[rows, cols] > -np.inf
    return rows[real], cols[real]


def _kth(vals: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """The k-th of each row's best so far (``vals``, k columns) and the candidates ``scores`` of ``rows``."""
    n, k = vals.shape
    many = np.bincount(rows, minlength=n)
    order = np.argsort(rows.astype(np.int16 if n < 2 ** 15 else np.int64), kind="stable")
    rows, scores, most = rows[order], scores[order], int(many.max(initial=0))
    best = np.full((n, k + most), -np.inf, np.float32)
    best[:, :k] = vals
    best[rows, k + np.arange(rows.size) - (np.cumsum(many) - many)[rows]] = scores
    return np.partition(best, most, axis=1)[:, most]


class _Left:
    """The left rows (numbers ``rows``) that meet a target by a product."""

    def __init__(self, work: _Cell, rows: np.ndarray):
        self.rows, self.x, self.x32 = rows, work.x[rows], work.x32[rows]


class _Strip:
    """Right rows s..e of a target: the unit vectors of those that are not
    zero, which meet batches of left rows in cells of at most ``step`` rows."""

    def __init__(self, work: _Cell, left: _Left, s: int, e: int, k: int):
        y = work.unit(s, e)
        some = y.any(axis=1)
        self.zero = s + np.flatnonzero(~some)
        some &= ~np.isnan(y).any(axis=1)
        self.cols = s + np.flatnonzero(some)
        self.y = y if some.all() else y[some]
        self.y32, self.left, self.k = self.y.astype(np.float32), left, k
        self.margin, self.step = _rounding(y.shape[1]), min(work.most, PIECE_ROWS)
        # where among these columns each left row's own item begins and ends
        self.own = None if work.same is None else [np.searchsorted(self.cols, b[left.rows]) for b in work.same]

    def mine(self, part: slice) -> list[tuple[int, int, int]]:
        """(row of the batch, first column, column behind the last) of the pairs of an item with itself."""
        if self.own is None:
            return []
        low, high = (b[part] for b in self.own)
        return [(i, low[i], high[i]) for i in np.flatnonzero(low < high).tolist()]

    def pieces(self):
        for c in range(0, len(self.cols), self.step):
            yield slice(c, min(c + self.step, len(self.cols)))

    def enter(self, vals: np.ndarray, at: np.ndarray, part: slice, rows: np.ndarray, cols: np.ndarray) -> int:
        """Score candidates and enter them into the best ``k``."""
        score = _pair_scores(self.left.x[part], self.y, rows, cols)
        _merge(vals, at, self.left.rows[part][rows], self.cols[cols], score, self.k)
        return rows.size

    def by_product(self, vals: np.ndarray, at: np.ndarray, part: slice) -> int:
        """One product a piece.  Its candidates wait in single precision; the
        floor rises each time they are ``k`` a row, and those that it leaves
        at the end are scored.  Returns the number of pairs scored."""
        x, mine, known = self.left.x32[part], self.mine(part), vals[self.left.rows[part]]
        floor, scored, fresh, held = known[:, -1], 0, 0, []
        for c in self.pieces():
            scores = x @ self.y32[c].T
            for i, low, high in mine:
                if low < c.stop and high > c.start:
                    scores[i, max(low - c.start, 0):high - c.start] = -np.inf
            rows, cols = _above(scores, floor, self.k, self.margin)
            if not rows.size:
                continue
            held.append((rows, cols + c.start, scores[rows, cols]))
            fresh += rows.size
            if fresh >= self.k * len(x) and c.stop < len(self.cols):
                rows, cols, some = (np.concatenate(h) for h in zip(*held))
                floor, fresh = _kth(known, rows, some), 0
                over = some >= (floor - self.margin)[rows]
                held = [(rows[over], cols[over], some[over])]
                if held[0][0].size > 16 * self.k * len(x):  # many equal scores: the smaller keys decide
                    scored += self.enter(vals, at, part, *held.pop()[:2])
                    known = vals[self.left.rows[part]]
                    floor = known[:, -1]
        if held:
            rows, cols, some = (np.concatenate(h) for h in zip(*held))
            over = some >= (_kth(known, rows, some) - self.margin)[rows]
            scored += self.enter(vals, at, part, rows[over], cols[over])
        return scored

    def leading(self, bound: _Bound, vals: np.ndarray, part: slice):
        """``(leading axes, floor)`` for the batch; no axes where the bound does not pay."""
        rows, m = self.left.rows[part], len(self.cols)
        floor = vals[rows, -1]
        if np.isneginf(floor).any():  # no k-th score yet: that over a sample of the strip
            some = np.arange(0, m, max(1, m // FLOOR_ROWS))[:FLOOR_ROWS]
            if m < 2 * self.k or some.size < self.k:
                return None, floor
            sample = self.left.x32[part] @ self.y32[some].T
            for i, low, high in self.mine(part):
                sample[i, (some >= low) & (some < high)] = -np.inf
            floor = np.maximum(floor, np.partition(sample, some.size - self.k, axis=1)[:, some.size - self.k])
        bound.tile(self)
        return bound.leading(rows, floor), floor

    def by_bound(self, bound: _Bound, h: int, floor: np.ndarray, vals: np.ndarray, at: np.ndarray, part: slice) -> int:
        """As ``by_product`` without a product of all pairs: those that the bound leaves are scored."""
        scored, batch, mine = 0, self.left.rows[part], self.mine(part)
        for c in self.pieces():
            alive = bound.above(batch, h, floor, c)
            for i, low, high in mine:
                if low < c.stop and high > c.start:
                    alive[i, max(low - c.start, 0):high - c.start] = False
            rows, cols = np.divmod(np.flatnonzero(alive), alive.shape[1])
            scored += self.enter(vals, at, part, rows, cols + c.start)
            floor = np.maximum(floor, vals[batch, -1])
        return scored


def _zeros(work: _Cell, vals: np.ndarray, at: np.ndarray, rows: np.ndarray, cols: np.ndarray, k: int) -> int:
    """Enter pairs that score 0, of ``rows`` with the ascending columns
    ``cols``: of each row the first ``k`` that are not the item itself."""
    rows = rows[vals[rows, -1] <= 0.0]
    nth = np.broadcast_to(np.arange(k), (rows.size, k))
    if work.same is not None:
        low, high = (np.searchsorted(cols, b[rows])[:, None] for b in work.same)
        nth = np.where(nth < low, nth, nth + high - low)
    r, place = np.nonzero(nth < cols.size)
    _merge(vals, at, rows[r], cols[nth[r, place]], np.zeros(r.size), k)
    return r.size


def _search(work: _Cell, bound: _Bound, k: int):
    """``(left rows, right rows, scores, pairs, scored)`` of the best ``k``,
    target by target.  A zero vector goes into no product: its scores are known."""
    none, left = np.flatnonzero(~work.x.any(axis=1)), None
    some = work.x.any(axis=1) & ~np.isnan(work.x).any(axis=1)
    for s, e, code in work.slices:
        vals, at = np.full((work.left.num_rows, k), -np.inf), np.full((work.left.num_rows, k), -1, np.int32)
        met = work.l_ds == code if work.within else np.True_
        if work.within or left is None:
            left = _Left(work, np.flatnonzero(some & met))
        scored, zero, real = 0, [], []
        for a in range(s, e, TILE_ROWS):
            strip = _Strip(work, left, a, min(a + TILE_ROWS, e), k)
            step = max(1, min(strip.step, _MAX_SCORES // strip.step))
            for begin in range(0, left.rows.size, step):
                part = slice(begin, min(begin + step, left.rows.size))
                h, floor = strip.leading(bound, vals, part) if bound.due() else (None, None)
                scored += strip.by_product(vals, at, part) if h is None else strip.by_bound(bound, h, floor, vals, at, part)
            zero.append(strip.zero)
            real.append(strip.cols)
        zero, real = np.concatenate(zero), np.concatenate(real)
        scored += _zeros(work, vals, at, left.rows, zero, k)
        scored += _zeros(work, vals, at, none[met[none]] if work.within else none, np.sort(np.r_[zero, real]), k)
        rows, place = np.nonzero(at >= 0)
        n = np.count_nonzero(met) if work.within else work.left.num_rows
        yield rows.astype(np.int32), at[rows, place], vals[rows, place], n * (e - s), scored


def _search_all(work: _Cell, k: int, low: np.ndarray, high: np.ndarray):
    """As ``_search``, ``(left rows, right rows, scores)``, by every score in double
    precision; the range of each left row's scores is entered in ``low`` and ``high``."""
    margin = _rounding(work.x.shape[1])
    for s, e, code in work.slices:
        vals, at = np.full((work.left.num_rows, k), -np.inf), np.full((work.left.num_rows, k), -1, np.int32)
        for tile in work.tiles(s, e, code):
            for part in tile.parts():
                scores = tile.scores(part, True)
                rows, cols = _above(scores, vals[part, -1], k, margin)
                low[part] = np.minimum(low[part], np.where(np.isinf(scores), np.inf, scores).min(axis=1, initial=np.inf))
                high[part] = np.maximum(high[part], scores.max(axis=1, initial=-np.inf))
                _merge(vals, at, part[rows], cols + tile.s, _pair_scores(work.x[part], tile.y, rows, cols), k)
        rows, place = np.nonzero(at >= 0)
        yield rows.astype(np.int32), at[rows, place], vals[rows, place]


def _cell_function(k: int, per_target: bool, exclude_self: bool, within_dataset: bool, with_range: bool, schema: T.StructType, always: bool = False,
                   most: int | None = None):
    empty = to_arrow_schema(schema).empty_table()

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        work = _Cell(left, right, per_target, exclude_self, within_dataset, most)
        found = [(np.zeros(0, np.int32),) * 2 + (np.zeros(0),)]
        # the range needs every score
        low, high = (np.full(left.num_rows, np.inf), np.full(left.num_rows, -np.inf)) if with_range else (None, None)
        found += _search_all(work, k, low, high) if with_range else [f[:3] for f in _search(work, work.bound(always), k)]
        rows, cols, vals = (np.concatenate(f) for f in zip(*found))
        columns = {DATASET: left.column(DATASET).take(rows), ITEM: left.column(ITEM).take(rows),
                   "target": work.right.column(DATASET).take(cols), "match": work.right.column(ITEM).take(cols), "score": vals}
        if with_range:
            columns |= {"_row_min": low[rows], "_row_max": high[rows]}
        return pa.table(columns)
    return cell


def _range_function(exclude_self: bool, most: int | None = None):
    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        low, high = np.inf, -np.inf
        if not left.num_rows or not right.num_rows:
            return pa.table({"min_score": np.zeros(0), "max_score": np.zeros(0)})
        work = _Cell(left, right, False, exclude_self, False, most)
        for piece in work.slices:
            for tile in work.tiles(*piece):
                for part in tile.parts():
                    scores = tile.scores(part, True)
                    low = min(low, np.where(np.isinf(scores), np.inf, scores).min(initial=np.inf))
                    high = max(high, scores.max(initial=-np.inf))
        seen = high > -np.inf
        return pa.table({"min_score": np.array([low] if seen else [], float), "max_score": np.array([high] if seen else [], float)})
    return cell


def _fresh(df: DataFrame) -> DataFrame:
    # new attribute ids, so both cogroup sides may come from one lineage
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _size(df: DataFrame) -> tuple[int, int]:
    """Row count and largest vector length, in one aggregation."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(VECTOR)).alias("d")).first()
    return int(r["n"]), int(r["d"] or 1)


def cell_rows_for(dim: int, cell_mb: float = CELL_MB) -> int:
    """Rows per cell side so one side's float64 vectors fit ``cell_mb``."""
    return max(MIN_CELL_ROWS, int(cell_mb * 2 ** 20 // (8 * max(dim, 1))))


def _blocked(left: DataFrame, right: DataFrame):
    """The cells as cogrouped blocks.  Rows are dealt by the key and the
    vector, so a key that many rows repeat is split as well.  The number of
    shuffle partitions is the session's; a task works its cells one by one.
    A row is shuffled once for each block of the other side."""
    same = left is right
    n_left, d_left = _size(left)
    n_right, d_right = (n_left, d_left) if same else _size(right)
    left, right = _fresh(left), _fresh(right)
    dim = max(d_left, d_right)
    gl, gr = grid_shape(n_left, n_right, cell_rows_for(dim), left.sparkSession.sparkContext.defaultParallelism, cell_rows_for(dim, LEFT_MB))
    block = lambda g: F.pmod(F.xxhash64(DATASET, ITEM, VECTOR), F.lit(g)).cast("int")
    every = lambda g: F.explode(F.sequence(F.lit(0), F.lit(g - 1)))
    lblk = left.withColumn("lb", block(gl)).withColumn("rb", every(gr))
    rblk = right.withColumn("rb", block(gr)).withColumn("lb", every(gl))
    return lblk.groupBy("lb", "rb").cogroup(rblk.groupBy("lb", "rb"))


def _pair_schema(left: DataFrame, right: DataFrame, with_range: bool = False) -> T.StructType:
    fields = [
        T.StructField(DATASET, left.schema[DATASET].dataType),
        T.StructField(ITEM, left.schema[ITEM].dataType),
        T.StructField("target", right.schema[DATASET].dataType),
        T.StructField("match", right.schema[ITEM].dataType),
        T.StructField("score", T.DoubleType()),
    ]
    extra = [T.StructField("_row_min", T.DoubleType()), T.StructField("_row_max", T.DoubleType())]
    return T.StructType(fields + extra * with_range)


def _sides(left: DataFrame, right: DataFrame | None, exclude_self: bool | None):
    if right is None:
        right = left
        exclude_self = True if exclude_self is None else exclude_self
    lsel = left.select(DATASET, ITEM, VECTOR)
    return lsel, lsel if right is left else right.select(DATASET, ITEM, VECTOR), bool(exclude_self)


def _ranked(pairs: DataFrame, k: int, per_target: bool) -> DataFrame:
    keys = [DATASET, ITEM, "target"] if per_target else [DATASET, ITEM]
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("target"), F.asc("match"))
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_matches(left: DataFrame, right: DataFrame | None = None, *, k: int = 3,
                per_target: bool = True, exclude_self: bool | None = None,
                within_dataset: bool = False, cell_rows: int | None = None, always_bound: bool = False) -> DataFrame:
    """Best ``k`` right items for every left item (per target dataset when
    ``per_target``), ranked ``1..k`` by score then smaller key.

    With ``right=None`` the left set is matched against itself (SIM2) and an
    item never matches itself.  ``within_dataset`` compares a left item only
    with right items of its own dataset value (used with dataset = fact name
    for donor search).  A right key that occurs on several rows is a candidate
    by each.  Output: ``dataset, item, target, match, score, rank``.
    ``always_bound`` uses the cell's bound even where it does not pay.
    """
    lsel, rsel, exclude_self = _sides(left, right, exclude_self)
    per_target = per_target or within_dataset
    cells = _blocked(lsel, rsel)
    schema = _pair_schema(lsel, rsel)
    pairs = cells.applyInArrow(_cell_function(k, per_target, exclude_self, within_dataset, False, schema, always_bound, cell_rows), schema=schema)
    return _ranked(pairs, k, per_target)


def scored_pairs(left: DataFrame, right: DataFrame | None = None, *, k: int = 3, per_target: bool = True,
                 exclude_self: bool | None = None, cell_rows: int | None = None, always_bound: bool = False) -> DataFrame:
    """One row ``(pairs, scored)``: all pairs that ``top_matches`` looks at with
    the same arguments, and those that it scores because no bound or
    rounding error rules them out."""
    lsel, rsel, exclude_self = _sides(left, right, exclude_self)

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        pairs = scored = 0
        if left.num_rows and right.num_rows:
            work = _Cell(left, right, per_target, exclude_self, False, cell_rows)
            for *_, of_target, of_scored in _search(work, work.bound(always_bound), k):
                pairs, scored = pairs + of_target, scored + of_scored
        return pa.table({"pairs": [pairs], "scored": [scored]})
    cells = _blocked(lsel, rsel).applyInArrow(cell, schema="pairs long, scored long")
    return cells.agg(F.sum("pairs").alias("pairs"), F.sum("scored").alias("scored"))


def score_range(left: DataFrame, right: DataFrame | None = None, *, exclude_self: bool = False,
                cell_rows: int | None = None) -> DataFrame:
    """One row ``(min_score, max_score)`` over all pairs; each cell reduces
    its pairs to two numbers, so no pair leaves a task."""
    lsel, rsel, _ = _sides(left, right, exclude_self)
    part = _blocked(lsel, rsel).applyInArrow(_range_function(exclude_self, cell_rows), schema="min_score double, max_score double")
    return part.agg(F.min("min_score").alias("min_score"), F.max("max_score").alias("max_score"))


def top_matches_with_range(left: DataFrame, right: DataFrame | None = None, *, k: int = 3,
                           per_target: bool = True, exclude_self: bool | None = None, cell_rows: int | None = None):
    """``top_matches`` plus the lowest and highest score over all scored pairs,
    from the same pass: every row carries its left row's range within the
    cell, the pass is checkpointed once, and one aggregation reads the range.
    Returns ``(top_k, min_score, max_score)``."""
    from ..session import materialize
    lsel, rsel, exclude_self = _sides(left, right, exclude_self)
    cells = _blocked(lsel, rsel)
    schema = _pair_schema(lsel, rsel, True)
    rows = materialize(cells.applyInArrow(_cell_function(k, per_target, exclude_self, False, True, schema, most=cell_rows), schema=schema))
    rng = rows.agg(F.min("_row_min").alias("lo"), F.max("_row_max").alias("hi")).first()
    out = _ranked(rows.drop("_row_min", "_row_max"), k, per_target)
    return out.select(DATASET, ITEM, "target", "match", "score", "rank"), rng["lo"], rng["hi"]


# --- nearest donors of many facts ------------------------------------------------------------

# cells of (row, neighbour, fact) looked at together
_MAX_LOOKUPS = 16_000_000


def _fact_table(column: pa.ChunkedArray, names: pa.Array) -> np.ndarray:
    """(rows, names) booleans of a column of name lists."""
    column = column.combine_chunks()
    out = np.zeros((len(column), len(names)), bool)
    code = pc.index_in(pc.list_flatten(column), names)
    known = code.is_valid().to_numpy(zero_copy_only=False)
    out[pc.list_parent_indices(column).to_numpy()[known], code.drop_null().to_numpy()] = True
    return out


def _donors_of(scores: np.ndarray, need: np.ndarray, has: np.ndarray, k: int, first: int, margin: float, known: np.ndarray):
    """Candidates (row, column, fact) for the ``k`` best columns of every
    needed (row, fact) among the columns that have the fact; ``known`` is the
    k-th score that other columns gave it.  Each row looks at its best
    ``first`` columns; where they do not settle a fact -- fewer than k of them
    have it, and the k-th or known score is no better than a column outside
    the list may be -- the row's list is doubled for the facts still open."""
    n, need, found = scores.shape[1], need.copy(), [(np.zeros(0, np.int64),) * 3]
    rows, m = np.flatnonzero(need.any(axis=1)), min(max(first, 2 * k), n)
    while rows.size:
        m = n if 4 * m > n else m
        step = max(1, _MAX_LOOKUPS // (m * has.shape[1]))
        for at in range(0, rows.size, step):
            part = rows[at:at + step]
            val = scores[part]
            if m < n:
                col = np.argpartition(-val, m - 1, axis=1)[:, :m]
                val = np.take_along_axis(val, col, axis=1)
            else:
                col = np.broadcast_to(np.arange(n), val.shape)
            order = np.argsort(-val, axis=1, kind="stable")
            col, val = np.take_along_axis(col, order, axis=1), np.take_along_axis(val, order, axis=1)
            have = has[col] & need[part][:, None, :]
            count = np.cumsum(have, axis=1, dtype=np.int32)
            enough = count[:, -1] >= k
            floor = np.where(enough, np.take_along_axis(val, np.argmax(count >= k, axis=1), axis=1), -np.inf)
            floor = np.maximum(floor, known[part]) - margin
            settled = need[part] & ((floor > val[:, -1:]) if m < n else True)
            r, j, f = np.nonzero(have & settled[:, None, :] & (val[:, :, None] >= floor[:, None, :]))
            found.append((part[r], col[r, j], f))
            need[part] &= ~settled
        rows, m = rows[need[rows].any(axis=1)], min(2 * m, n)
    return tuple(np.concatenate(x) for x in zip(*found))


def nearest_with_facts(left: DataFrame, right: DataFrame, *, k: int, first: int = 32, cell_rows: int | None = None) -> DataFrame:
    """``(item, fact, donor, score, rank)``: for every fact that a left row
    ``(item, facts, embedding)`` lists, its best ``k`` right rows among those
    that list the fact, ties to the smaller donor.  A pair is scored once
    whatever the number of facts, and a vector is shuffled once per cell.
    ``first`` is the length of the neighbour lists before they are doubled."""
    as_rows = lambda df: df.select(F.lit(0).alias(DATASET), ITEM, VECTOR, "facts")
    left, right = as_rows(left), as_rows(right)
    schema = T.StructType([left.schema[ITEM], T.StructField("fact", T.StringType()), T.StructField("donor", right.schema[ITEM].dataType), T.StructField("score", T.DoubleType())])
    empty = to_arrow_schema(schema).empty_table()

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        work = _Cell(left, right, False, False, False, cell_rows)
        names = pc.unique(pc.list_flatten(left.column("facts").combine_chunks()))
        if not len(names):
            return empty
        need, margin, f = _fact_table(left.column("facts"), names), np.float32(_rounding(work.x.shape[1])), len(names)
        vals, at = np.full((left.num_rows * f, k), -np.inf), np.full((left.num_rows * f, k), -1, np.int32)
        for piece in work.slices:
            for tile in work.tiles(*piece):
                has, m = _fact_table(work.right.column("facts").slice(tile.s, tile.e - tile.s), names), tile.e - tile.s
                for part in tile.parts():
                    known = vals[:, -1].reshape(-1, f)[part].astype(np.float32)
                    rows, cols, facts = _donors_of(tile.scores(part), need[part], has, k, first, margin, known)
                    pair, which = np.unique(rows * m + cols, return_inverse=True)  # a pair may serve several facts
                    score = _pair_scores(work.x[part], tile.y, pair // m, pair % m)[which]
                    _merge(vals, at, part[rows] * f + facts, cols + tile.s, score, k)
        group, place = np.nonzero(at >= 0)
        cols, vals = at[group, place], vals[group, place]
        return pa.table({ITEM: left.column(ITEM).take(group // f), "fact": names.take(pa.array(group % f)), "donor": work.right.column(ITEM).take(cols), "score": vals})
    near = _blocked(left, right).applyInArrow(cell, schema=schema)
    w = Window.partitionBy(ITEM, "fact").orderBy(F.desc("score"), F.asc("donor"))  # k rows a cell
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
