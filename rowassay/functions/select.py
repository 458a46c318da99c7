"""Exact seeded selection of k rows.

Rows are ordered by ``md5(seed ':' row id)``. A selection of k rows is then a *cut*: the place of
the k-th row in that order. Being at or before a cut is a plain predicate, so selecting needs
neither a sort nor a join nor a shuffle, and the choice does not depend on the partitioning.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowassay import ROW_ID

_FIRST_DIGITS = 3  # 4,096 buckets in the first pass: what a task sends on stays small
_MORE_DIGITS = 3
_MAX_TAIL = 10_000  # boundary rows fetched per cut; fuller buckets are divided further


def half_even(x: float) -> int:
    """Number of rows for a fractional count: half to even."""
    return int(round(x))


def row_hash(seed: int, row_id: str = ROW_ID) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")))


@dataclass(frozen=True)
class Cut:
    """All rows up to the k-th in the order of ``seed``. ``hash`` None: k was 0; '': every row."""

    seed: int
    k: int
    hash: str | None
    row_id: int = -1

    def covers(self, hashed: Column | None = None) -> Column:
        if self.hash is None:
            return F.lit(False)
        if self.hash == "":
            return F.lit(True)
        h = row_hash(self.seed) if hashed is None else hashed
        return (h < self.hash) | ((h == self.hash) & (F.col(ROW_ID) <= self.row_id))


class Selection:
    """Cuts over one table for several seeds, found with one small aggregate plus one lookup."""

    def __init__(self, df: DataFrame, seeds: list[int]):
        self._ids = df.select(ROW_ID)
        self._seeds = sorted(set(seeds))
        counts: dict[int, list[tuple[str, int]]] = defaultdict(list)
        bucket = F.substring("_h", 1, _FIRST_DIGITS)
        # At most 16^3 rows per seed come back, however large the table is.
        for r in self._hashed(self._seeds).groupBy("_seed", bucket.alias("_b")).count().collect():
            counts[r["_seed"]].append((r["_b"], r["count"]))
        self._counts = {s: sorted(counts[s]) for s in self._seeds}
        self.n = sum(c for _, c in self._counts[self._seeds[0]])

    def _hashed(self, seeds: list[int]) -> DataFrame:
        return self._ids.select(
            ROW_ID,
            F.explode(F.array(*[F.struct(F.lit(s).alias("_seed"), row_hash(s).alias("_h")) for s in seeds])).alias("_x"),
        ).select(ROW_ID, "_x._seed", "_x._h")

    def cuts(self, wanted: list[tuple[int, int]]) -> dict[tuple[int, int], Cut]:
        """The cut of every (seed, k)."""
        done: dict[tuple[int, int], Cut] = {}
        open_: dict[tuple[int, int], tuple[str, int, int]] = {}  # -> (prefix, rank inside it, rows in it)
        for seed, k in set(wanted):
            if k <= 0:
                done[seed, k] = Cut(seed, k, None)
            elif k >= self.n:
                done[seed, k] = Cut(seed, k, "")
            else:
                open_[seed, k] = _locate(self._counts[seed], k)
        while open_:
            full = {key: at for key, at in open_.items() if at[2] > _MAX_TAIL}
            if not full:
                break
            for key, buckets in self._divide(full).items():
                open_[key] = _locate(buckets, open_[key][1])
        if open_:
            tails = self._tails(open_)
            for (seed, k), (prefix, rank, _) in open_.items():
                h, row_id = sorted(tails[seed, prefix])[rank - 1]
                done[seed, k] = Cut(seed, k, h, row_id)
        return done

    def _inside(self, places) -> DataFrame:
        """Hashed rows whose (seed, prefix) is one of ``places``."""
        places = sorted(set(places))
        hit = F.lit(False)
        for seed, prefix in places:
            hit = hit | ((F.col("_seed") == seed) & F.col("_h").startswith(prefix))
        return self._hashed(sorted({s for s, _ in places})).filter(hit)

    def _divide(self, full: dict) -> dict:
        """Counts of the next digits inside each over-full boundary bucket."""
        places = {(seed, at[0]) for (seed, _), at in full.items()}
        length = len(next(iter(places))[1])
        found: dict[tuple[int, str], list[tuple[str, int]]] = defaultdict(list)
        longer = F.substring("_h", 1, length + _MORE_DIGITS).alias("_b")
        for r in self._inside(places).groupBy("_seed", longer).count().collect():
            found[r["_seed"], r["_b"][:length]].append((r["_b"], r["count"]))
        return {(seed, k): sorted(found[seed, at[0]]) for (seed, k), at in full.items()}

    def _tails(self, open_: dict) -> dict:
        found: dict[tuple[int, str], list[tuple[str, int]]] = defaultdict(list)
        lengths = {(seed, at[0]) for (seed, _), at in open_.items()}
        for r in self._inside(lengths).collect():
            for seed, prefix in lengths:
                if seed == r["_seed"] and r["_h"].startswith(prefix):
                    found[seed, prefix].append((r["_h"], r[ROW_ID]))
        return found


def _locate(buckets: list[tuple[str, int]], rank: int) -> tuple[str, int, int]:
    """The bucket holding the row of this rank: (prefix, rank inside the bucket, rows in it)."""
    for prefix, count in buckets:
        if rank <= count:
            return prefix, rank, count
        rank -= count
    raise ValueError("rank beyond the table")


def select_rows(df: DataFrame, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows (all, when there are fewer), the same ones for the same seed."""
    selection = Selection(df, [seed])
    if selection.n <= n:
        return df
    return df.filter(selection.cuts([(seed, n)])[seed, n].covers())


def cap_rows(df: DataFrame, cap: int | None, seed: int) -> DataFrame:
    """``select_rows`` under a cap; no cap means no sampling."""
    return df if cap is None else select_rows(df, cap, seed)


def preview_rows(df: DataFrame, n: int, seed: int) -> DataFrame:
    """A small sample as a reader sees it: without the row id."""
    return select_rows(df, n, seed).drop(ROW_ID)
