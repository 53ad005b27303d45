"""The fold over slices of ratings (M-07) in workers.

An update (M-06) never mixes two dimensions: dimension ``d`` of a factor depends on the ratings and on
dimension ``d`` of other factors alone.  So the slices, which must be taken one after another, need no
job each: a task holds a few dimensions of all factors and runs every slice over them, and the tasks
share the dimensions.  A task's state is ``width`` numbers per id, and the cells stream past it.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa

# Pickled by value as in ``scoring``: executors need no copy of this package.
try:
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except (ImportError, AttributeError, ValueError):
    pass

# Bytes of the factors one task holds; a single dimension of more ids may take MAPPED_BYTES of
# memory and is kept in a mapped file of the worker's temp folder beyond that.
STATE_BYTES = 64 * 1024 * 1024
MAPPED_BYTES = 256 * 1024 * 1024

# Cells travel in their order as bytes, CELL_ROWS in a row at most: rows of a few numbers each would
# cost the tasks more than the sums.
CELL = np.dtype([("user", "<i8"), ("movie", "<i8"), ("at_movie", "<i4"), ("w_user", "<f8"), ("w_movie", "<f8")])
CELL_ROWS = 128
CELLS = "slice long, cells binary"
# Instead of a slice, of the rows before the cells: an id with its code, and its initial values if it has any.
USERS, MOVIES = -2, -1


def _pieces(batches, key: str):
    """``(key, part of a batch)`` for each run of equal keys in a batch."""
    for batch in batches:
        keys = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo < hi:
                yield keys[lo], batch.slice(lo, hi - lo)


def _runs(batches, key: str):
    """``(key, parts)`` for each run of equal keys, across batches."""
    at, held = None, []
    for now, piece in _pieces(batches, key):
        if held and now != at:
            yield at, held
            held = []
        at = now
        held.append(piece)
    if held:
        yield at, held


def _column(pieces, name: str) -> np.ndarray:
    found = [p.column(name).to_numpy(zero_copy_only=False) for p in pieces]
    return found[0] if len(found) == 1 else np.concatenate(found)


def cells_of(batches):
    """Ratings ``(slice, user, movie, rating)`` sorted by slice, -1 for a missing code, to the cells of
    each slice in the order (user, movie): the place of the movie among the slice's, and the cell's
    weights in the sums of its user (rating times rows of the movie) and of its movie."""
    for at, pieces in _runs(batches, "slice"):
        users, user = np.unique(_column(pieces, "user"), return_inverse=True)
        movies, movie = np.unique(_column(pieces, "movie"), return_inverse=True)
        n_user, n_movie = np.bincount(user), np.bincount(movie)
        full = (users[user] >= 0) & (movies[movie] >= 0)
        cell, of = np.unique(user[full] * len(movies) + movie[full], return_inverse=True)
        if not len(cell):
            continue
        r = np.bincount(of, weights=_column(pieces, "rating")[full])
        user, movie = np.divmod(cell, len(movies))
        out = np.empty(len(cell), CELL)
        out["user"], out["movie"], out["at_movie"] = users[user], movies[movie], np.unique(movie, return_inverse=True)[1]
        out["w_user"], out["w_movie"] = n_movie[movie] * r, n_user[user] * r
        rows = [out[lo:lo + CELL_ROWS].tobytes() for lo in range(0, len(out), CELL_ROWS)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), at, np.int64)), pa.array(rows, pa.binary())], names=["slice", "cells"])


def _cells(piece) -> np.ndarray:
    """The cells of rows, which lie one after another in the rows' buffer."""
    rows = piece.column("cells")
    offsets = np.frombuffer(rows.buffers()[1], np.int32, len(rows) + 1, 4 * rows.offset)
    return np.frombuffer(rows.buffers()[2], CELL, (offsets[-1] - offsets[0]) // CELL.itemsize, int(offsets[0]))


def _state(n: int, width: int) -> np.ndarray:
    """``width`` rows of ``n`` numbers."""
    if n * width * 8 <= MAPPED_BYTES:
        return np.zeros((width, n))
    with tempfile.TemporaryFile() as file:
        return np.memmap(file, np.float64, "w+", shape=(width, n))


def _learn(pieces, users: np.ndarray, known: np.ndarray, movies: np.ndarray, decay: float, lr: float) -> None:
    """M-06 on one slice."""
    cells = np.concatenate([_cells(p) for p in pieces])
    user, movie, at_movie, w_user, w_movie = (np.ascontiguousarray(cells[c]) for c in CELL.names)
    first = np.concatenate(([True], user[1:] != user[:-1]))
    at_user, own_users = np.cumsum(first) - 1, user[first]
    own_movies = np.empty(at_movie.max() + 1, np.int64)
    own_movies[at_movie] = movie
    seen = known[own_users]
    for u, m in zip(users, movies):
        before = m[own_movies]
        s = np.bincount(at_user, weights=w_user * before[at_movie])
        moved = np.where(seen, decay * u[own_users] + lr * s, s)
        u[own_users] = moved
        m[own_movies] = decay * before + lr * np.bincount(at_movie, weights=w_movie * moved[at_user])
    known[own_users] = True


def learner(width: int, n_users: int, n_movies: int, first: int, decay: float, lr: float, out_rows: int = 16384):
    """All slices over ``width`` dimensions, the first of which is ``first``: rows ``(user_id, movie_id,
    first, vec)`` of every user and every movie."""
    def run(batches):
        users, movies, known = _state(n_users, width), _state(n_movies, width), np.zeros(n_users, bool)
        ids, last = {USERS: [], MOVIES: []}, -1
        with np.errstate(over="ignore", invalid="ignore"):       # numbers beyond double are infinite, as in Spark
            for at, pieces in _runs(batches, "slice"):
                if at >= 0:
                    if at <= last:
                        raise RuntimeError(f"slice {at} came after slice {last}")
                    last = at
                    _learn(pieces, users, known, movies, decay, lr)
                    continue
                for piece in pieces:
                    ids[at].append(piece.select(["code", "user_id", "movie_id"]))
                    drawn = piece.filter(piece.column("vec").is_valid())
                    code = drawn.column("code").to_numpy()
                    (users if at == USERS else movies)[:, code] = drawn.column("vec").flatten().to_numpy().reshape(-1, width).T
                    if at == USERS:
                        known[code] = True
        for kind, own in ((USERS, users), (MOVIES, movies)):
            if not ids[kind]:
                continue
            order = pa.array(np.argsort(_column(ids[kind], "code")))
            names = {c: pa.concat_arrays([p.column(c) for p in ids[kind]]).take(order) for c in ("user_id", "movie_id")}
            for lo in range(0, len(order), out_rows):
                n = min(out_rows, len(order) - lo)
                vec = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(own[:, lo:lo + n].T.ravel()))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, n) for c in names.values()), pa.array(np.full(n, first, np.int32)), vec],
                                                 names=[*names, "first", "vec"])

    return run
