"""All pairs of a pool without a table of them: blocks of rows meet in tasks, which keep each row's best, its mean or its rank alone."""

from __future__ import annotations

from collections.abc import Callable
from copy import copy

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import key_table
from ..session import materialize

#: Bytes of rows that one side of a meeting of blocks holds.
BLOCK_BYTES = 32 << 20
#: Rows of the left side that a block has at least, so that a small pool is no crowd of tasks.
LEAST_ROWS = 512
_LEFT_ROWS, _RIGHT_ROWS = 64, 1024
KEYS = np.array([s for _, _, s in key_table()]).reshape(24, 24)


def meet(left: DataFrame, right: DataFrame, left_key: str, right_key: str, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``run`` of each pair of blocks of the two tables, in a task for each pair.

    Blocks have a bounded number of bytes, the left table's are a few for each core
    at least.  Rows of null keys are left out.
    """
    left, right = left.filter(F.col(left_key).isNotNull()), right.filter(F.col(right_key).isNotNull())
    n, m = left.count(), right.count()
    blocks = lambda rows, df: max(-(-rows * 8 * len(df.columns) // BLOCK_BYTES), 1)
    rights = blocks(m, right)
    lefts = max(blocks(n, left), min(4 * left.sparkSession.sparkContext.defaultParallelism // rights, -(-n // LEAST_ROWS)), 1)
    place = lambda key, k: F.pmod(F.xxhash64(key), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    tasks = 2 * lefts * rights
    own = left.select("*", place(left_key, lefts).alias("_a"), every(rights).alias("_b")).repartition(tasks, "_a", "_b")
    others = right.select("*", place(right_key, rights).alias("_b"), every(lefts).alias("_a")).repartition(tasks, "_a", "_b")
    names = [f.split()[0] for f in schema.split(", ")]

    def one(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return run(x, y) if len(x) and len(y) else pd.DataFrame({c: [] for c in names})

    return own.groupBy("_a", "_b").cogroup(others.groupBy("_a", "_b")).applyInPandas(one, schema)


class Kept:
    """The k best (to, score) of each row so far; of equal scores those of the lower index."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.held, self.bound = k, [], np.full(n, -np.inf)

    def add(self, rows: np.ndarray, to: np.ndarray, s: np.ndarray) -> None:
        """A tile's scores; places that don't count are -inf."""
        if s.shape[1] > self.k:
            at = np.flatnonzero(self.bound[rows] == -np.inf)
            if len(at):
                self.bound[rows[at]] = np.partition(s[at], s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
        r, c = np.nonzero((s >= self.bound[rows][:, None]) & np.isfinite(s))
        if len(r):
            self.held.append((rows[r], to[c], s[r, c]))

    def shrink(self) -> None:
        """Keep the best of what is held, and raise the bounds."""
        if not self.held:
            return
        r, to, s = (np.concatenate(p) for p in zip(*self.held, strict=True))
        order = np.lexsort((to, -s, r))
        r, to, s = r[order], to[order], s[order]
        start = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        rank = np.arange(len(r)) - np.repeat(start, np.diff(np.append(start, len(r))))
        last = rank == self.k - 1
        self.bound[r[last]] = s[last]
        self.held = [(r[rank < self.k], to[rank < self.k], s[rank < self.k])]

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.shrink()
        return self.held[0] if self.held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def tiles(n: int, m: int, rows: int = _LEFT_ROWS, width: int = _RIGHT_ROWS):
    """(left slice, right slice) of all places; a stretch of rows meets all others before the next."""
    for lo in range(0, n, rows):
        for at in range(0, m, width):
            yield slice(lo, min(lo + rows, n)), slice(at, min(at + width, m))


def best(score: Callable[[slice, slice], np.ndarray], ids: np.ndarray, others: np.ndarray, k: int, own: bool = False, told: Callable[[slice, slice, np.ndarray], None] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, to, score): the k best others of each row, in order; itself is one of them if ``own``.  ``told``: sees each tile's scores first."""
    out = []
    for lo in range(0, len(ids), _LEFT_ROWS):
        mine = slice(lo, min(lo + _LEFT_ROWS, len(ids)))
        kept, rows = Kept(mine.stop - lo, k), np.arange(mine.stop - lo)
        for n, at in enumerate(range(0, len(others), _RIGHT_ROWS)):
            there = slice(at, min(at + _RIGHT_ROWS, len(others)))
            s = score(mine, there)
            if told is not None:
                told(mine, there, s)
            if not own:
                s[ids[mine][:, None] == others[there][None]] = -np.inf
            kept.add(rows, others[there], s)
            if n % 8 == 7:
                kept.shrink()
        r, to, s = kept.result()
        out.append((r + lo, to, s))
    return tuple(np.concatenate(p) for p in zip(*out, strict=True)) if out else kept_nothing()


def kept_nothing() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)


# --- the transition score ----------------------------------------------------


def _clip(x: np.ndarray) -> np.ndarray:
    return np.minimum(np.maximum(x, 0.0), 1.0)


def end_columns(there: dict) -> list[str]:
    """The columns of a prepared table that a pair's first track needs."""
    from .pairs import STRUCTURE

    names = [f"n_outro_{n}" for n in ("abruptness", "release_time_s", "tail_silence_s")] if there["edge_flow"] else []
    names += [f"n_outro_{e}" for e, _ in STRUCTURE] if there["edge_flow"] or there["structure"] else []
    return ["e_key", *dict.fromkeys(names), *dict.fromkeys(f"e_{n}" for k in ("timbre", "groove", "sentiment") for n in there[k])]


def begin_columns(there: dict) -> list[str]:
    """Of its second track."""
    from .pairs import STRUCTURE

    names = [f"n_intro_{n}" for n in ("attack_time_s", "flux_peak", "rise_slope")] if there["edge_flow"] else []
    names += [f"n_intro_{b}" for _, b in STRUCTURE] if there["edge_flow"] or there["structure"] else []
    return ["b_key", *dict.fromkeys(names), *dict.fromkeys(f"b_{n}" for k in ("timbre", "groove", "sentiment") for n in there[k])]


class Ends:
    """The first tracks of pairs, as arrays."""

    def __init__(self, pdf: pd.DataFrame, there: dict) -> None:
        from .pairs import STRUCTURE

        self.key = pdf["e_key"].to_numpy().astype(np.int64)
        get = lambda n: pdf[f"n_outro_{n}"].to_numpy(np.float64)
        self.flow = self.up = self.down = None
        if there["edge_flow"]:
            tail, release = get("tail_silence_s"), get("release_time_s")
            unready = _clip(1.0 - np.maximum(tail, 0.6 * release))
            self.flow = np.stack([0.28 * get("abruptness") + 0.18 * tail - 0.12 * unready, 0.24 * release, 0.15 * get("downbeat_strength"), 0.15 * get("chroma_stability")], axis=1)
        if there["structure"]:
            scaled = [get(e) / s for (e, _), (_, s) in STRUCTURE.items()]
            self.up, self.down = np.exp(np.stack(scaled)), np.exp(-np.stack(scaled))
        self.close = {k: np.stack([pdf[f"e_{n}"].to_numpy(np.float64) for n in there[k]]) for k in ("timbre", "groove", "sentiment") if there[k]}


class Begins:
    """The second tracks of pairs."""

    def __init__(self, pdf: pd.DataFrame, there: dict) -> None:
        from .pairs import STRUCTURE

        self.key = pdf["b_key"].to_numpy().astype(np.int64)
        get = lambda n: pdf[f"n_intro_{n}"].to_numpy(np.float64)
        self.flow = self.up = self.down = None
        if there["edge_flow"]:
            attack, flux = get("attack_time_s"), get("flux_peak")
            hard = _clip(0.60 * (1.0 - attack) + 0.40 * flux)
            gradual = _clip(0.55 * attack + 0.30 * (1.0 - get("rise_slope")) + 0.15 * (1.0 - flux))
            self.flow = np.stack([hard, gradual, get("downbeat_strength"), get("chroma_stability")])
        if there["structure"]:
            scaled = [get(b) / s for (_, b), (_, s) in STRUCTURE.items()]
            self.up, self.down = np.exp(np.stack(scaled)), np.exp(-np.stack(scaled))
        self.close = {k: np.stack([pdf[f"b_{n}"].to_numpy(np.float64) for n in there[k]]) for k in ("timbre", "groove", "sentiment") if there[k]}

    def take(self, places: np.ndarray) -> Begins:
        out = copy(self)
        out.key = self.key[places]
        out.flow, out.up, out.down = (None if v is None else v[:, places] for v in (self.flow, self.up, self.down))
        out.close = {k: v[:, places] for k, v in self.close.items()}
        return out


def scores(l: Ends, r: Begins, mine, others, digits: int | None = None) -> np.ndarray:  # noqa: E741
    """As :func:`~seguelab.operators.pairs.score_pairs` of the places ``mine`` against ``others``; a track's score to itself isn't set to 0.

    exp(-|a - b|) is the lesser of exp(a - b) and exp(b - a), so that the six terms
    of the structure are products of what each side has made once.
    """
    from .pairs import STRUCTURE, WEIGHTS

    total, weight = None, 0.0

    def add(name: str, part: np.ndarray) -> None:
        nonlocal total, weight
        part *= WEIGHTS[name]
        weight += WEIGHTS[name]
        total = part if total is None else np.add(total, part, out=total)

    if l.flow is not None:
        part = l.flow[mine] @ r.flow[:, others]
        np.maximum(part, 0.0, out=part)
        add("edge_flow", np.minimum(part, 1.0, out=part))
    if l.up is not None:
        part = None
        for k, (w, _) in enumerate(STRUCTURE.values()):
            a = np.multiply.outer(l.up[k, mine], r.down[k, others])
            np.minimum(a, np.multiply.outer(l.down[k, mine], r.up[k, others]), out=a)
            a *= w
            part = a if part is None else np.add(part, a, out=part)
        add("structure", np.minimum(part, 1.0, out=part))
    for name, e in l.close.items():
        b, part = r.close[name], None
        for k in range(len(e)):
            d = np.subtract.outer(e[k, mine], b[k, others])
            np.abs(d, out=d)
            part = d if part is None else np.add(part, d, out=part)
        part /= -float(len(e))
        add(name, np.exp(part, out=part))
    add("tonal", KEYS[l.key[mine]][:, r.key[others]])
    total /= weight
    np.maximum(total, 0.0, out=total)
    np.minimum(total, 1.0, out=total)
    if digits is not None:
        total *= 10.0**digits
        np.rint(total, out=total)
        total /= 10.0**digits
    return total


class PairScores:
    """The scores of all ordered pairs of a prepared pool, made where they are needed and never written."""

    def __init__(self, slim: DataFrame, there: dict, digits: int | None = 9) -> None:
        self.slim, self.there, self.digits = slim, there, digits

    def ends(self) -> DataFrame:
        return self.slim.select("idx", *end_columns(self.there))

    def begins(self) -> DataFrame:
        return self.slim.select("idx", *begin_columns(self.there))

    def without(self, gone: DataFrame) -> PairScores:
        """Of the tracks that aren't in a column ``g``."""
        return PairScores(materialize(self.slim.join(gone, F.col("idx") == F.col("g"), "left_anti"), "tracks"), self.there, self.digits)

    def top(self, k: int) -> DataFrame:
        """(from_idx, to_idx, score): each track's k best edges, lower indexes first among equals."""
        from .pairs import top_edges

        there, digits = self.there, self.digits

        def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            l, r, ids = Ends(x, there), Begins(y, there), x["idx"].to_numpy()  # noqa: E741
            row, to, s = best(lambda a, b: scores(l, r, a, b, digits), ids, y["idx"].to_numpy(), k)
            return pd.DataFrame({"from_idx": ids[row], "to_idx": to, "score": s})

        return top_edges(meet(self.ends(), self.begins(), "idx", "idx", run, "from_idx long, to_idx long, score double"), k)

    def quality(self) -> DataFrame:
        """(from_idx, quality): the mean and three quarters of the maximum of each track's scores, that to itself included."""
        there, digits = self.there, self.digits

        def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            total, most = sums(Ends(x, there), Begins(y, there), x["idx"].to_numpy(), y["idx"].to_numpy(), digits)
            return pd.DataFrame({"from_idx": x["idx"].to_numpy(), "total": total, "most": most, "n": len(y)})

        found = meet(self.ends(), self.begins(), "idx", "idx", run, "from_idx long, total double, most double, n long")
        return found.groupBy("from_idx").agg((F.sum("total") / F.sum("n") + F.lit(0.75) * F.max("most")).alias("quality"))


    def leaders(self, k: int) -> DataFrame:
        """(from_idx, quality, best): :meth:`quality` and, in order, :meth:`top` as an array of (minus, to), by one look at each pair."""
        there, digits = self.there, self.digits

        def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            l, r, ids, others = Ends(x, there), Begins(y, there), x["idx"].to_numpy(), y["idx"].to_numpy()  # noqa: E741
            total, most = np.zeros(len(ids)), np.full(len(ids), -np.inf)

            def told(mine: slice, places: slice, s: np.ndarray) -> None:
                s[ids[mine][:, None] == others[places][None]] = 0.0
                total[mine] += s.sum(axis=1)
                most[mine] = np.maximum(most[mine], s.max(axis=1))

            row, to, s = best(lambda a, b: scores(l, r, a, b, digits), ids, others, k, told=told)
            ends = np.searchsorted(row, np.arange(1, len(ids)))
            return pd.DataFrame({"from_idx": ids, "total": total, "most": most, "n": len(y), "minus": np.split(-s, ends), "to": np.split(to, ends)})

        found = meet(self.ends(), self.begins(), "idx", "idx", run, "from_idx long, total double, most double, n long, minus array<double>, to array<long>")
        every = F.flatten(F.collect_list(F.arrays_zip("minus", "to")))
        return found.groupBy("from_idx").agg((F.sum("total") / F.sum("n") + F.lit(0.75) * F.max("most")).alias("quality"), F.slice(F.array_sort(every), 1, k).alias("best"))


def sums(l: Ends, r: Begins, ids: np.ndarray, others: np.ndarray, digits: int | None) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    """The sum and the maximum of each row's scores, 0 to itself."""
    total, most = np.zeros(len(ids)), np.full(len(ids), -np.inf)
    for mine, there in tiles(len(ids), len(others)):
        s = scores(l, r, mine, there, digits)
        s[ids[mine][:, None] == others[there][None]] = 0.0
        total[mine] += s.sum(axis=1)
        most[mine] = np.maximum(most[mine], s.max(axis=1))
    return total, most


def ranks(x: pd.DataFrame, y: pd.DataFrame, there: dict, digits: int | None) -> np.ndarray:
    """Of each step of ``x`` against the tracks of ``y`` that are free, the chosen one left out: their number, how many are above and equal (before it, all), the best score and its track.

    ``x``: playlist_name, k, chosen, own; ``y``, sorted by ``idx``: the lists that use
    each track, and where first.
    """
    l, r, ids = Ends(x, there), Begins(y, there), y["idx"].to_numpy()  # noqa: E741
    where: dict[str, list[tuple[int, int]]] = {}
    for place, (lists, used) in enumerate(zip(y["lists"], y["used"], strict=True)):
        if lists is not None:
            for name, at in zip(lists, used, strict=True):
                where.setdefault(name, []).append((place, at))
    uses = {name: np.array(v, np.int64).T for name, v in where.items()}
    n, m = len(x), len(y)
    chosen, own, names, k = x["chosen"].to_numpy(), x["own"].to_numpy(), x["playlist_name"].tolist(), x["k"].to_numpy()
    out = np.zeros((n, 6))
    out[:, 4], out[:, 5] = -np.inf, -1
    at = np.searchsorted(ids, chosen)
    for lo in range(0, n, _LEFT_ROWS):
        mine = slice(lo, min(lo + _LEFT_ROWS, n))
        gone = []
        for i in range(mine.start, mine.stop):
            taken = uses[names[i]][0][uses[names[i]][1] <= k[i]] if names[i] in uses else np.zeros(0, np.int64)
            if at[i] < m and ids[at[i]] == chosen[i]:
                taken = np.append(taken, at[i])
            gone.append(np.unique(taken) + (i - lo) * m)
        out[mine, 0] = [m - len(g) for g in gone]
        row, place = np.divmod(np.concatenate(gone), m)
        order = np.argsort(place, kind="stable")
        row, place = row[order], place[order]
        wanted = own[mine][:, None]
        for first in range(0, m, _RIGHT_ROWS):
            there_ = slice(first, min(first + _RIGHT_ROWS, m))
            s = scores(l, r, mine, there_, digits)
            a, b = np.searchsorted(place, [there_.start, there_.stop])
            s[row[a:b], place[a:b] - first] = -np.inf
            out[mine, 1] += (s > wanted).sum(axis=1)
            same = s == wanted
            if same.any():
                out[mine, 2] += (same & (ids[there_][None] < chosen[mine][:, None])).sum(axis=1)
                out[mine, 3] += same.sum(axis=1)
            top = s.argmax(axis=1)
            value = s[np.arange(len(top)), top]
            better = np.flatnonzero(value > out[mine, 4])
            out[lo + better, 4], out[lo + better, 5] = value[better], ids[there_][top[better]]
    return out
