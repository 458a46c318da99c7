"""Inject known errors into exact, seeded sets of rows, with labels saying what was done where.

A *variant* is one corrupted copy of a table: a list of in-place errors on disjoint sets of rows,
plus copies of rows appended at the end. A single-error variant has one part; a mixed one several.
All variants of a table are read off the same scan: every base row is exploded into the variants
that want it, and one projection applies the corruption of the variant it was exploded for.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowassay import ROW_ID
from rowassay.functions.select import Selection, half_even, row_hash
from rowassay.operators.validate import require_row_id

# Error names, malformed tokens, sentinels and offsets.
ERROR_TYPES = (
    "missing_value", "out_of_range", "type_or_format_error", "invalid_category",
    "duplicate_row", "referential_integrity", "cross_column_logic", "distribution_shift",
)
MALFORMED = ("not_a_value", "2024-13-45", "??", "1e999x")
CATEGORY_SENTINEL = 999
RANGE_SPANS = 100.0
SUM_OFFSET = 100.0
#: What a setting is when it is not given.
DEFAULTS: dict[str, dict[str, object]] = {
    "out_of_range": {"mode": "high"},
    "type_or_format_error": {"bad_values": MALFORMED},
    "invalid_category": {"invalid_value": CATEGORY_SENTINEL},
    "cross_column_logic": {"kind": "temporal"},
    "distribution_shift": {"scale": 3.0, "shift": 0.0},
}
MIXED = "mixed"
APPEND_SEED_STEP = 1000

LABEL_COLUMNS = [
    ROW_ID, "column", "error_type", "rate", "seed", "dataset", "original_value", "corrupted_value",
]
LABEL_SCHEMA = (
    f"{ROW_ID} bigint, column string, error_type string, rate double, seed bigint, dataset string, "
    "original_value string, corrupted_value string"
)


@dataclass(frozen=True)
class Injector:
    """An error to inject: its name and settings, without the rate."""

    error_type: str
    options: tuple[tuple[str, object], ...] = ()

    def get(self, name: str):
        """A setting, or its default; None and an empty list count as not given."""
        given = dict(self.options).get(name)
        return DEFAULTS.get(self.error_type, {}).get(name) if given is None or given == () else given

    @property
    def column(self) -> str | None:
        """The column that is changed; None for appended copies."""
        if self.error_type == "duplicate_row":
            return None
        if self.error_type == "cross_column_logic":
            return self.get("end_col") if self.get("kind") == "temporal" else self.get("total_col")
        return self.get("column")


def injector(error_type: str, **options) -> Injector:
    """Check the settings and build an injector."""
    if error_type not in ERROR_TYPES:
        raise ValueError(f"no injector named {error_type!r}")
    if error_type == "cross_column_logic":
        kind = options.get("kind") or DEFAULTS[error_type]["kind"]
        needed = {"temporal": ("start_col", "end_col"), "sum": ("total_col", "component_cols")}.get(kind)
        if needed is None:
            raise ValueError(f"unknown kind {kind!r}")
        if not all(options.get(n) for n in needed):
            raise ValueError(f"kind {kind!r} needs {needed}")
    elif error_type == "out_of_range" and (options.get("mode") or "high") not in ("high", "low"):
        raise ValueError("mode must be 'high' or 'low'")
    elif error_type != "duplicate_row" and not options.get("column"):
        raise ValueError(f"{error_type} needs a column")
    frozen = {k: tuple(v) if isinstance(v, list) else v for k, v in options.items()}
    return Injector(error_type, tuple(sorted(frozen.items())))


@dataclass(frozen=True)
class Part:
    """One injector of a variant, on ``k`` rows of the order of ``seed`` after the first ``skip``."""

    injector: Injector
    rate: float  # what the label reports
    label_seed: int
    order_seed: int
    skip: int
    k: int


@dataclass(frozen=True)
class Variant:
    error_type: str
    rate: float | None
    seed: int
    inplace: tuple[Part, ...] = ()
    appended: tuple[Part, ...] = ()

    @property
    def parts(self) -> tuple[Part, ...]:
        return self.inplace + self.appended


def single(inj: Injector, rate: float, seed: int, n: int) -> Variant:
    """One injector on ``round(n * rate)`` rows."""
    part = Part(inj, rate, seed, seed, 0, half_even(n * rate))
    if inj.column is None:
        return Variant(inj.error_type, rate, seed, appended=(part,))
    return Variant(inj.error_type, rate, seed, inplace=(part,))


def mixed(plan: Iterable[tuple[Injector, float]], seed: int, n: int, rate: float | None = None) -> Variant:
    """Several injectors on disjoint rows: consecutive slices of one order; appended copies last."""
    plan = list(plan)
    inplace, appended, cursor = [], [], 0
    for inj, r in plan:
        if inj.column is not None:
            k = half_even(n * r)
            inplace.append(Part(inj, r, seed + len(inplace) + 1, seed, cursor, k))
            cursor += k
    if cursor > n:
        raise ValueError(f"the mix needs {cursor} rows but the table has {n}")
    for inj, r in plan:
        if inj.column is None:
            s = seed + APPEND_SEED_STEP + len(appended)
            appended.append(Part(inj, r, s, s, 0, half_even(n * r)))
    return Variant(MIXED, rate, seed, tuple(inplace), tuple(appended))


def order_seeds(seeds: Iterable[int], with_mixed: bool = True) -> list[int]:
    """Seeds whose row order the variants of these seeds may use (one appended part per mix)."""
    seeds = list(seeds)
    return seeds + [s + APPEND_SEED_STEP for s in seeds] if with_mixed else seeds


def as_text(c: Column, t: T.DataType) -> Column:
    """A label value: text, NULL when missing."""
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return c.cast("string")


_WIDTHS = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.DoubleType()]


def _type_of_number(value) -> T.DataType:
    """The narrowest of the integer types, or double, that holds a sentinel."""
    if isinstance(value, int) or float(value).is_integer():
        for t, bits in zip(_WIDTHS, (7, 15, 31, 63)):
            if -(2**bits) <= value < 2**bits:
                return t
    return T.DoubleType()


def _wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """A type that holds the values of both: text holds all, double all numbers."""
    if a == b:
        return a
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return max((a, b), key=_WIDTHS.index) if a in _WIDTHS and b in _WIDTHS else T.DoubleType()
    return T.StringType()


class Injection:
    """Variants of one table, ready to be read as rows or as labels.

    What a base row becomes in a variant is one small number, its *fate*: which variant, which
    in-place part hit the row, which appending part copied it. Rows are exploded into fates, and
    everything else (the new value, the label) is looked up by fate, so the generated code stays
    small however many variants there are.
    """

    def __init__(
        self, base: DataFrame, variants: list[Variant], dataset: str = "", selection: Selection | None = None,
        whole: DataFrame | None = None,
    ):
        """``whole`` is the table that ranges and fresh ids come from, if ``base`` is only a part of it."""
        require_row_id(base)
        self.base, self.variants, self.dataset, self.whole = base, variants, dataset, base if whole is None else whole
        parts = [p for v in variants for p in v.parts]
        self.selection = selection or Selection(base, sorted({p.order_seed for p in parts}) or [0])
        self.n = self.selection.n
        self._seeds = sorted({p.order_seed for p in parts})
        self._marks = {
            s: sorted({k for p in parts if p.order_seed == s for k in (p.skip, p.skip + p.k) if k > 0}) for s in self._seeds
        }
        self._cuts = self.selection.cuts([(s, k) for s in self._seeds for k in self._marks[s]])
        self._types = {f.name: f.dataType for f in base.schema}
        self._first_new_id = None
        self._fates, self._offsets = [], []
        for vi, v in enumerate(variants):
            self._offsets.append(len(self._fates))
            self._fates += [(vi, hit, app) for app in range(-1, len(v.appended)) for hit in range(-1, len(v.inplace))]
        self._ranges: dict[tuple[int, int], tuple] = {}
        self._find_ranges()
        self._list_actions()

    # -- which rows --------------------------------------------------------

    def with_places(self, df: DataFrame) -> DataFrame:
        """Add, per order seed, how far down its order a row stands: the number of cuts before it."""
        hashed = df.withColumns({f"_h{s}": row_hash(s) for s in self._seeds})
        return hashed.withColumns({f"_at{s}": self._place(s) for s in self._seeds}).drop(*[f"_h{s}" for s in self._seeds])

    def _place(self, seed: int) -> Column:
        """From the last cut backwards: most rows are past it and need one comparison."""
        h, marks = F.col(f"_h{seed}"), self._marks[seed]
        place = None
        for i in range(len(marks) - 1, -1, -1):
            past = ~self._cuts[seed, marks[i]].covers(h)
            place = F.when(past, i + 1) if place is None else place.when(past, i + 1)
        return F.lit(0) if place is None else place.otherwise(0)

    def takes(self, part: Part) -> Column:
        """The row is among those the part corrupts (over ``with_places``)."""
        if part.k <= 0:
            return F.lit(False)
        at, marks = F.col(f"_at{part.order_seed}"), self._marks[part.order_seed]
        inside = at <= marks.index(part.skip + part.k)
        return inside if part.skip == 0 else inside & (at > marks.index(part.skip))

    def hit(self, variant: Variant) -> Column:
        """Which in-place part takes the row: its position, -1 for none (over ``with_places``)."""
        chosen = None
        for i, part in enumerate(variant.inplace):
            chosen = F.when(self.takes(part), i) if chosen is None else chosen.when(self.takes(part), i)
        return F.lit(-1) if chosen is None else chosen.otherwise(-1)

    # -- what happens to them ------------------------------------------------

    def _find_ranges(self) -> None:
        """Column ranges for the out-of-range parts, each as its injector sees the column.

        In a mix that is after the earlier parts have run. Ranges that do not depend on another
        range share one aggregate; a range behind another one waits for the next round.
        """
        todo = [
            (vi, pi)
            for vi, v in enumerate(self.variants)
            for pi, p in enumerate(v.inplace)
            if p.injector.error_type == "out_of_range"
        ]
        while todo:
            ready = [(vi, pi) for vi, pi in todo if not any(a == vi and b < pi for a, b in todo)]
            wanted, names = {}, {}
            for vi, pi in ready:
                variant, column = self.variants[vi], self.variants[vi].inplace[pi].injector.column
                earlier = [j for j, p in enumerate(variant.inplace[:pi]) if p.injector.column == column]
                names[vi, pi] = f"{column}@{vi}.{pi}" if earlier else column
                seen = F.col(f"`{column}`").cast("double")
                for j in earlier:
                    seen = F.when(self.hit(variant) == j, self._new_value(vi, j).try_cast("double")).otherwise(seen)
                wanted[names[vi, pi]] = seen
            aggregates = []
            for i, seen in enumerate(wanted.values()):
                aggregates += [F.min(seen).alias(f"lo{i}"), F.max(seen).alias(f"hi{i}")]
            row = self.with_places(self.whole).agg(*aggregates).first()
            at = {name: (row[f"lo{i}"], row[f"hi{i}"]) for i, name in enumerate(wanted)}
            for key in ready:
                self._ranges[key] = at[names[key]]
            todo = [t for t in todo if t not in ready]

    def _list_actions(self) -> None:
        """Number the different changes per column; most variants share theirs with others."""
        self._actions: dict[tuple, tuple[int, int]] = {}  # what is done -> an example of a part doing it
        self._action_of: dict[tuple[int, int], int] = {}
        for vi, v in enumerate(self.variants):
            for pi, p in enumerate(v.inplace):
                draws = p.label_seed if p.injector.error_type == "type_or_format_error" else None
                what = (p.injector, self._ranges.get((vi, pi)), draws)
                self._actions.setdefault(what, (vi, pi))
                self._action_of[vi, pi] = list(self._actions).index(what)

    def _new_value(self, vi: int, pi: int) -> Column:
        """The corrupted value of the part's column."""
        part = self.variants[vi].inplace[pi]
        inj = part.injector
        c = F.col(f"`{inj.column}`")
        kind = inj.error_type
        if kind == "missing_value":
            return F.lit(None).cast(self._types[inj.column])
        if kind == "out_of_range":
            low, high = self._ranges[vi, pi]
            if low is None:
                return F.lit(None).cast("double")
            span = (high - low) or 1.0
            far = low - RANGE_SPANS * span if inj.get("mode") == "low" else high + RANGE_SPANS * span
            return F.lit(float(far))
        if kind == "type_or_format_error":
            tokens = inj.get("bad_values")
            draw = F.conv(F.substring(row_hash(part.label_seed + 1), 1, 8), 16, 10).cast("bigint")
            return F.element_at(F.array(*[F.lit(t) for t in tokens]), (draw % len(tokens) + 1).cast("int"))
        if kind == "invalid_category":
            return F.lit(inj.get("invalid_value")).cast(self.type_after(inj))
        if kind == "referential_integrity":
            return (-(F.col(ROW_ID) + 1)).cast(self.type_after(inj))
        if kind == "distribution_shift":
            return c.cast("double") * F.lit(float(inj.get("scale"))) + F.lit(float(inj.get("shift")))
        if inj.get("kind") == "temporal":
            return F.col(f"`{inj.get('start_col')}`") - F.expr("INTERVAL 1 HOUR")
        parts = [F.coalesce(F.col(f"`{p}`").cast("double"), F.lit(0.0)) for p in inj.get("component_cols")]
        return functools.reduce(Column.__add__, parts) + F.lit(SUM_OFFSET)

    def type_after(self, inj: Injector) -> T.DataType:
        """Type of the changed column once the injector has run."""
        before = self._types[inj.column]
        kind = inj.error_type
        if kind in ("out_of_range", "distribution_shift"):
            return T.DoubleType()
        if kind == "type_or_format_error":
            return T.StringType()
        if kind == "invalid_category" and isinstance(inj.get("invalid_value"), str):
            return T.StringType()
        if kind == "invalid_category" and isinstance(before, T.StringType):
            return T.StringType()
        if kind == "invalid_category" and isinstance(before, T.IntegralType):
            return _wider(before, _type_of_number(inj.get("invalid_value")))
        if kind == "referential_integrity" and isinstance(before, (T.IntegerType, T.ShortType, T.ByteType)):
            return T.LongType()
        if kind == "cross_column_logic" and inj.get("kind") == "sum":
            return T.DoubleType()
        return before

    def schema_class(self, vi: int) -> tuple[tuple[str, str], ...]:
        """Columns whose type the variant changes; variants that agree can share one scan."""
        after: dict[str, T.DataType] = {}
        for p in self.variants[vi].inplace:
            c = p.injector.column
            after[c] = _wider(after.get(c, self._types[c]), self.type_after(p.injector))
        return tuple(sorted((c, t.simpleString()) for c, t in after.items() if t != self._types[c]))

    def schema_classes(self) -> dict[tuple, list[int]]:
        classes: dict[tuple, list[int]] = {}
        for vi in range(len(self.variants)):
            classes.setdefault(self.schema_class(vi), []).append(vi)
        return classes

    # -- reading ---------------------------------------------------------------

    def _by_fate(self, value: Callable[[int, int, int], object], kind: str) -> Column:
        """A constant per fate: ``value(variant, hit, append)``."""
        return F.element_at(F.array(*[F.lit(value(*f)) for f in self._fates]).cast(f"array<{kind}>"), F.col("_fate") + 1)

    def _maybe_touched(self, members: list[int]) -> Column:
        """Cheap first test, one comparison per order: the row may come before the last cut."""
        last: dict[int, int] = {}
        for vi in members:
            for p in self.variants[vi].parts:
                last[p.order_seed] = max(last.get(p.order_seed, 0), p.skip + p.k)
        tests = []
        for s, k in sorted(last.items()):
            if k > 0:
                cut = self._cuts[s, k]
                tests.append(F.lit(True) if cut.hash == "" else row_hash(s) <= cut.hash)
        return functools.reduce(Column.__or__, tests, F.lit(False))

    def rows(
        self,
        members: list[int] | None = None,
        changed_only: bool = False,
        keep_old: bool = False,
        within: Column | None = None,
        own_types: bool = False,
    ) -> DataFrame:
        """Rows of the variants ``members`` (which must be of one schema class).

        Columns: ``_fate``, ``_variant``, ``_hit`` (in-place part that changed the row, else -1),
        ``_append`` (appending part the row is a copy of, else -1), the row id, and the table's
        columns. ``changed_only`` leaves out the rows a variant does not touch; ``keep_old`` adds
        the row before the change as struct ``_old`` and the id of the source row as ``_source``;
        ``within`` restricts the base rows that are read (not which of them are corrupted);
        ``own_types`` leaves the values in ``_old`` the types they had.
        """
        members = list(range(len(self.variants))) if members is None else members
        casts = dict(self.schema_class(members[0])) if members else {}
        if any(dict(self.schema_class(vi)) != casts for vi in members):
            raise ValueError("variants with different column types need separate scans")
        columns = [c for c in self.base.columns if c != ROW_ID]
        fates = []
        for vi in members:
            variant, offset = self.variants[vi], self._offsets[vi]
            hit = self.hit(variant)
            if not changed_only:
                fates.append(hit + (offset + 1))
            elif variant.inplace:
                fates.append(F.when(hit >= 0, hit + (offset + 1)))
            step = len(variant.inplace) + 1
            for j, part in enumerate(variant.appended):
                fates.append(F.when(self.takes(part), hit + (offset + (j + 1) * step + 1)))
        source = self.base if within is None else self.base.filter(within)
        placed = self.with_places(source.filter(self._maybe_touched(members)) if changed_only else source)
        # The list is built in a projection of its own, in generated code; only then are the absent
        # fates (NULL) dropped, so that a row is exploded into what it becomes and nothing else.
        listed = placed.select(ROW_ID, *[f"`{c}`" for c in columns], F.array(*fates).alias("_fates"))
        exploded = listed.select(
            ROW_ID, *[f"`{c}`" for c in columns], F.explode(F.array_compact("_fates")).alias("_fate")
        )
        known = exploded.withColumns({
            "_variant": self._by_fate(lambda vi, hit, app: vi, "int"),
            "_hit": self._by_fate(lambda vi, hit, app: hit, "int"),
            "_append": self._by_fate(lambda vi, hit, app: app, "int"),
            "_action": self._by_fate(lambda vi, hit, app: self._action_of.get((vi, hit), -1), "int"),
        })
        wanted = {self._action_of[vi, pi] for vi in members for pi in range(len(self.variants[vi].inplace))}
        changes: dict[str, list[tuple[int, Column]]] = {}
        for number, (vi, pi) in enumerate(self._actions.values()):
            if number in wanted:
                column = self.variants[vi].inplace[pi].injector.column
                changes.setdefault(column, []).append((number, self._new_value(vi, pi)))
        new = []
        for c in columns:
            target = casts.get(c, self._types[c].simpleString())
            value = None
            for number, changed in changes.get(c, []):
                mine, changed = F.col("_action") == number, changed.cast(target)
                value = F.when(mine, changed) if value is None else value.when(mine, changed)
            plain = F.col(f"`{c}`").cast(target)
            new.append((plain if value is None else value.otherwise(plain)).alias(c))
        # Copies get ids past the last one; the n-th appending part starts n tables further on.
        fresh = F.when(F.col("_append") >= 0, (F.col("_append") + 1) * F.lit(self.first_new_id()).cast("bigint") + F.col(ROW_ID))
        head = ["_fate", "_variant", "_hit", "_append", fresh.otherwise(F.col(ROW_ID)).alias(ROW_ID)]
        if keep_old:
            before = {} if own_types else casts
            old = F.struct(*[F.col(f"`{c}`").cast(before.get(c, self._types[c].simpleString())).alias(c) for c in columns])
            head += [F.col(ROW_ID).alias("_source"), old.alias("_old")]
        return known.select(*head, *new)

    def first_new_id(self) -> int:
        if self._first_new_id is None:
            if not any(v.appended for v in self.variants):
                return 0
            top = self.whole.agg(F.max(ROW_ID)).first()[0]
            self._first_new_id = 0 if top is None else top + 1
        return self._first_new_id

    def labels(self, members: list[int] | None = None) -> DataFrame:
        """Label rows, plus ``_variant``."""
        members = list(range(len(self.variants))) if members is None else members
        groups = ([vi for vi in vis if vi in members] for vis in self.schema_classes().values())
        parts = [self._class_labels(g) for g in groups if g]
        if not parts:
            return self.base.sparkSession.createDataFrame([], "_variant int, " + LABEL_SCHEMA)
        return functools.reduce(DataFrame.unionByName, parts)

    def _part(self, vi: int, hit: int, app: int) -> Part | None:
        """The part that explains a fate; a copy is explained by its copying alone."""
        variant = self.variants[vi]
        return variant.appended[app] if app >= 0 else variant.inplace[hit] if hit >= 0 else None

    def _class_labels(self, members: list[int]) -> DataFrame:
        rows = self.rows(members, changed_only=True, keep_old=True, own_types=True)
        types = {f.name: f.dataType for f in rows.schema}

        def told(get):
            return lambda *fate: None if (part := self._part(*fate)) is None else get(part)

        known = rows.withColumns({
            "column": self._by_fate(told(lambda p: p.injector.column), "string"),
            "error_type": self._by_fate(told(lambda p: p.injector.error_type), "string"),
            "rate": self._by_fate(told(lambda p: p.rate), "double"),
            "seed": self._by_fate(told(lambda p: p.label_seed), "bigint"),
        })
        old, new = F.when(F.col("_append") >= 0, F.col("_source").cast("string")), F.when(F.lit(False), F.lit(""))
        for c in sorted({p.injector.column for vi in members for p in self.variants[vi].inplace}):
            mine = F.col("column") == c
            old = old.when(mine, as_text(F.col(f"_old.`{c}`"), self._types[c]))
            new = new.when(mine, as_text(F.col(f"`{c}`"), types[c]))
        return known.select(
            "_variant", ROW_ID, "column", "error_type", "rate", "seed", F.lit(self.dataset).alias("dataset"),
            old.alias("original_value"), new.alias("corrupted_value"),
        )

    def collisions(self, part_column: str, valid_keys: DataFrame) -> int:
        """How many injected foreign keys exist among ``valid_keys`` (one column); must be 0.

        Only rows that a foreign-key injector of this column has changed are looked at.
        """
        key, total = valid_keys.columns[0], 0
        for members in self.schema_classes().values():
            broken = F.array(*[
                F.lit(f"{vi}.{pi}") for vi in members for pi, p in enumerate(self.variants[vi].inplace)
                if p.injector.error_type == "referential_integrity" and p.injector.column == part_column
            ]).cast("array<string>")
            changed = self.rows(members, changed_only=True)
            by = F.concat_ws(".", F.col("_variant").cast("string"), F.col("_hit").cast("string"))
            keys = changed.filter(F.array_contains(broken, by)).select(F.col(f"`{part_column}`").alias(key))
            total += keys.join(valid_keys, key, "left_semi").count()
        return total


def inject(
    df: DataFrame, inj: Injector, rate: float, seed: int, dataset: str = "",
    rows: DataFrame | None = None, valid_keys: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(corrupted table, labels) of one injector.

    ``rows`` names the rows to corrupt by their ids, instead of a share of ``rate``, which the labels
    still report. ``valid_keys`` (one column) are keys that a broken foreign key must not be among.
    """
    require_row_id(df)
    if rows is None:
        selection = Selection(df, [seed])
        injection = Injection(df, [single(inj, rate, seed, selection.n)], dataset, selection)
        result = _read(injection)
    else:
        ids = rows.select(F.col(ROW_ID).alias("_chosen")).distinct()
        same = df[ROW_ID] == F.col("_chosen")
        chosen = df.join(ids, same, "left_semi")
        selection = Selection(chosen, [seed])
        every = Part(inj, rate, seed, seed, 0, selection.n)
        variant = Variant(inj.error_type, rate, seed, *(((), (every,)) if inj.column is None else ((every,), ())))
        injection = Injection(chosen, [variant], dataset, selection, whole=df)
        corrupted, labels = _read(injection)
        rest = df.join(ids, same, "left_anti")
        kept = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in corrupted.schema]
        result = corrupted.unionByName(rest.select(*kept)), labels
    if valid_keys is not None and inj.error_type == "referential_integrity":
        met = injection.collisions(inj.column, valid_keys)
        if met:
            raise ValueError(f"{met} broken keys of {inj.column!r} exist")
    return result


def inject_mixed(
    df: DataFrame, plan: Iterable[tuple[Injector, float]], seed: int, dataset: str = ""
) -> tuple[DataFrame, DataFrame]:
    """(corrupted table, labels) of several injectors on disjoint rows."""
    require_row_id(df)
    plan = list(plan)
    copies = sum(1 for inj, _ in plan if inj.column is None)
    selection = Selection(df, [seed] + [seed + APPEND_SEED_STEP + j for j in range(copies)])
    return _read(Injection(df, [mixed(plan, seed, selection.n)], dataset, selection))


def _read(injection: Injection) -> tuple[DataFrame, DataFrame]:
    corrupted = injection.rows().select(*injection.base.columns)
    return corrupted, injection.labels().select(*LABEL_COLUMNS)
