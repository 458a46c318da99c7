"""Evaluate every suite on the clean table and on every corrupted variant of it.

A variant differs from the clean table in few rows, so it is never written out and re-read:

* one pass over the clean table evaluates the union of all rules of all suites;
* one pass over the *affected* rows of all variants together evaluates the same rules before and
  after the change. Affected are the changed rows, the appended copies, and untouched rows whose
  key became repeated, or stopped being so, because of a change elsewhere.

Counts of a variant are the clean counts plus the differences, which is exact for row and key
rules. Table statistics are merged from the unchanged and the new rows.
"""

from __future__ import annotations

import functools
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowassay import ROW_ID
from rowassay.functions.select import Selection
from rowassay.operators.bind import ROW
from rowassay.operators.inject import MIXED, Injection
from rowassay.operators.metrics import OVERALL
from rowassay.operators.rules import Rule
from rowassay.operators.sets import with_sets
from rowassay.operators.validate import repeated_keys
from rowassay.plans.judge import Judge, Suite, Tally, any_of, detection_facts, fused, merge, ratio_of, state_columns
from rowassay.session import compiled, materialize

CROSS_ROW = ("duplicate_row", MIXED)  # fixed value: never evaluated on a sample


def _total(flag: Column) -> Column:
    """Rows where ``flag`` holds, over counts of rows with the same verdicts."""
    return F.coalesce(F.sum(F.when(flag, F.col("_n"))), F.lit(0))


class _Frame(Judge):
    """The clean table as one group of variants sees it: same column types, same row sample."""

    def __init__(self, injection: Injection, casts: dict[str, str], members: list[int], within: Column | None,
                 rules: list[Rule], suites: list[list[int]]):
        self.injection, self.members, self.within = injection, members, within
        base = injection.base if within is None else injection.base.filter(within)
        base = base.withColumns({c: F.col(f"`{c}`").cast(t) for c, t in casts.items()}) if casts else base
        self.columns = [c for c in base.columns if c != ROW_ID]
        super().__init__(base, rules, suites)
        self.repeated = [self._named(materialize(repeated_keys(self.base, rs[0]).drop("_copies"), "repeated"), key)
                         for key, rs in self.keys]

    # -- keys --------------------------------------------------------------

    @staticmethod
    def _named(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
        return df.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(key)})

    @staticmethod
    def _same(values: list[Column]) -> Column:
        """Null-safe equality with a renamed key; keys without any value never reach a join."""
        if len(values) == 1:
            return values[0] == F.col("_k0")
        return functools.reduce(Column.__and__, [v.eqNullSafe(F.col(f"_k{i}")) for i, v in enumerate(values)])

    def _mark(self, df: DataFrame, j: int, values: list[Column], name: str) -> DataFrame:
        """Add ``name``: is the key repeated in the clean table?"""
        keys = self.repeated[j].withColumn(name, F.lit(True))
        marked = df.join(keys, self._same(values), "left")
        return marked.drop(*[f"_k{i}" for i in range(len(values))]).withColumn(name, F.coalesce(name, F.lit(False)))

    def _touches(self, vi: int, columns: tuple[str, ...]) -> bool:
        return any(p.injector.column in columns for p in self.injection.variants[vi].inplace)

    def _unchanged(self) -> Column:
        """Over (variant, base row) with places: the variant leaves the row as it is."""
        out = F.lit(True)
        for vi in self.members:
            variant = self.injection.variants[vi]
            if variant.inplace:
                out = F.when(F.col("_variant") == vi, self.injection.hit(variant) < 0).otherwise(out)
        return out

    def _flips(self, j: int) -> DataFrame | None:
        """(variant, key, now): keys whose being repeated changes in a variant."""
        key, rules = self.keys[j]
        movers = [
            vi for vi in self.members if self._touches(vi, key) or self.injection.variants[vi].appended
        ]
        if not movers:
            return None
        rows = self._changed(movers)
        new = [F.col(f"`{k}`") for k in key]
        old = [F.col(f"_old.`{k}`") for k in key]
        moved = ~functools.reduce(Column.__and__, [a.eqNullSafe(b) for a, b in zip(new, old)])

        def entry(values, step):
            return F.struct(*[v.alias(f"_k{i}") for i, v in enumerate(values)], F.lit(step).alias("_d"))

        steps = F.array(
            F.when((F.col("_append") >= 0) | moved, entry(new, 1)),
            F.when((F.col("_append") < 0) & moved, entry(old, -1)),
        )
        names = [f"_k{i}" for i in range(len(key))]
        present = any_of([F.col(n).isNotNull() for n in names])
        net = (
            rows.select("_variant", F.inline(steps)).filter(present)
            .groupBy("_variant", *names).agg(F.sum("_d").alias("_net")).filter("_net != 0")
        )
        net = materialize(net, "net")
        values = [F.col(f"`{k}`") for k in key]
        counts = (
            self.base.select(*key).join(net.select(*names), self._same(values), "left_semi")
            .groupBy(*[v.alias(f"_c{i}") for i, v in enumerate(values)]).agg(F.count("*").alias("_n"))
        )
        back = [F.col(n).eqNullSafe(F.col(f"_c{i}")) for i, n in enumerate(names)]
        before = F.coalesce(F.col("_n"), F.lit(0))
        now = (before + F.col("_net")) > 1
        flips = (
            net.join(counts, functools.reduce(Column.__and__, back), "left")
            .filter((before > 1) != now).select(F.col("_variant").alias("_fv"), *names, now.alias("_now"))
        )
        return materialize(flips, "flips")

    # -- the clean pass ------------------------------------------------------

    def clean(self) -> tuple[Tally, dict[int, dict[int, tuple]]]:
        """Counts of the clean table, and table statistics over the rows each variant leaves alone."""
        tally = self._clean_counts()
        apart = [(b, vi) for b in self.tables for vi in self.members if self._touches(vi, b.columns)]
        aggs = []
        for b in self.tables:
            aggs += state_columns(b.state.how, b.state.value, f"t{b.index}", self._is_time(b))
        for b, vi in apart:
            rest = self.injection.hit(self.injection.variants[vi]) < 0
            value = F.when(rest, b.state.value)
            aggs += state_columns(b.state.how, value, f"t{b.index}v{vi}", self._is_time(b))
        df = self.injection.with_places(self.base) if apart else self.base
        row = with_sets(df, self.tables).agg(*aggs).first().asDict() if aggs else {}
        read = lambda name: tuple(row[k] for k in (f"{name}_a", f"{name}_b") if k in row)
        tally.states = {b.index: read(f"t{b.index}") for b in self.tables}
        rest: dict[int, dict[int, tuple]] = defaultdict(dict)
        for b, vi in apart:
            rest[vi][b.index] = read(f"t{b.index}v{vi}")
        return tally, rest

    def _clean_counts(self) -> Tally:
        """Counts of the clean table. Only verdicts, as bits, and keys go through the joins with repeated keys."""
        words = range(self._words())
        named = {f"_n{j}_{i}": F.col(f"`{k}`") for j, (key, _) in enumerate(self.keys) for i, k in enumerate(key)}
        df = with_sets(self.base, self.bound)
        df = df.select(*[c.alias(n) for n, c in {**named, **self._row_bits("_v")}.items()])
        for j, (key, _) in enumerate(self.keys):
            df = self._mark(df, j, [F.col(f"_n{j}_{i}") for i in range(len(key))], f"_rep{j}")
        df = df.select(*[F.col(f"_v{w}").bitwiseOR(self._key_bits(w, "_rep")).alias(f"_v{w}") for w in words])
        counted = df.groupBy(*[f"_v{w}" for w in words]).agg(F.count("*").alias("_n"))
        aggs = [F.coalesce(F.sum("_n"), F.lit(0)).alias("n")]
        aggs += [_total(self._bit("_v", kind, index)).alias(f"{kind}{index}") for kind, index in self._bits()]
        flags = self._flags({b.index: self._bit("_v", "u", b.index) for b in self.flagging})
        row = counted.agg(*aggs, *[_total(flag).alias(f"f{s}") for s, flag in enumerate(flags)]).first().asDict()
        tally = Tally(row["n"])
        for b in self.flagging:
            tally.unexpected[b.index] = row[f"u{b.index}"]
            tally.counted[b.index] = row.get(f"c{b.index}", 0)
        for s in range(len(self.suites)):
            tally.flagged[s] = row[f"f{s}"]
        return tally

    # -- the pass over affected rows -------------------------------------------

    def _changed(self, members: list[int]) -> DataFrame:
        return self.injection.rows(members, changed_only=True, keep_old=True, within=self.within)

    def variants(self, clean: Tally, rest: dict[int, dict[int, tuple]]) -> dict[int, Tally]:
        flips = [self._flips(j) for j in range(len(self.keys))]
        affected = self._changed(self.members).drop("_source", "_fate")
        bystanders = [self._bystanders(f, key) for f, (key, _) in zip(flips, self.keys) if f is not None]
        if bystanders:
            untouched = functools.reduce(DataFrame.unionByName, bystanders)
            if len(bystanders) > 1:
                untouched = untouched.dropDuplicates(["_variant", ROW_ID])
            affected = affected.unionByName(untouched)
        affected = with_sets(affected, self.bound)
        is_new = (F.col("_hit") >= 0) | (F.col("_append") >= 0)
        states = {f"_s{b.index}": F.when(is_new, b.state.value) for b in self.tables}
        named = {f"_n{j}_{i}": F.col(f"`{k}`") for j, (key, _) in enumerate(self.keys) for i, k in enumerate(key)}
        keep = ["_variant", "_hit", "_append"]
        # Both verdicts are bits before the joins on keys, so only these and the keys are shuffled.
        words = range(self._words())
        new = {**states, **named, **self._row_bits("_new")}
        df = affected.select(*keep, "_old", *[c.alias(n) for n, c in new.items()])
        df = with_sets(df.select(*keep, *new, "_old.*"), self.bound)
        old = {n.replace("_n", "_o", 1): c for n, c in named.items()}
        df = df.select(*keep, *new, *[c.alias(n) for n, c in {**old, **self._row_bits("_was")}.items()])
        for j, (key, _) in enumerate(self.keys):
            values = [F.col(f"_n{j}_{i}") for i in range(len(key))]
            df = self._mark(df, j, values, f"_now{j}")
            if flips[j] is not None:
                here = (F.col("_variant") == F.col("_fv")) & self._same(values)
                df = df.join(flips[j], here, "left").drop("_fv", *[f"_k{i}" for i in range(len(key))])
                df = df.withColumn(f"_now{j}", F.coalesce("_now", f"_now{j}")).drop("_now")
            df = df.drop(*[f"_n{j}_{i}" for i in range(len(key))])
        for j, (key, _) in enumerate(self.keys):
            df = self._mark(df, j, [F.col(f"_o{j}_{i}") for i in range(len(key))], f"_then{j}")
        existed = F.col("_append") < 0
        after = [F.col(f"_new{w}").bitwiseOR(self._key_bits(w, "_now")) for w in words]
        before = [F.when(existed, F.col(f"_was{w}").bitwiseOR(self._key_bits(w, "_then"))).otherwise(F.lit(0)) for w in words]
        # Rows with the same verdicts are counted together: one counter, however many rules.
        patterns = [f"_new{w}" for w in words] + [f"_was{w}" for w in words]
        kinds = {b.index: (b.state.how, self._is_time(b)) for b in self.tables}
        first = [F.count("*").alias("_n")]
        for index, (how, is_time) in kinds.items():
            first += state_columns(how, F.col(f"_s{index}"), f"t{index}", is_time)
        df = df.withColumns({**dict(zip(patterns, after + before))}) if patterns else df
        counted = df.groupBy(*keep, *patterns).agg(*first)

        aggs = [F.sum("_n").alias("n")]
        for kind, index in self._bits():
            aggs.append((_total(self._bit("_new", kind, index)) - _total(self._bit("_was", kind, index))).alias(f"{kind}{index}"))
        flag = lambda side: self._flags({b.index: self._bit(side, "u", b.index) for b in self.flagging})
        for s, (new, old) in enumerate(zip(flag("_new"), flag("_was"))):
            aggs += [_total(new).alias(f"hit{s}"), (_total(new) - _total(old)).alias(f"f{s}")]
        for index, (how, _) in kinds.items():
            best = {"min": F.min, "max": F.max}.get(how, F.sum)
            aggs.append(best(f"t{index}_a").alias(f"t{index}_a"))
            if how == "mean":
                aggs.append(F.sum(f"t{index}_b").alias(f"t{index}_b"))
        # One row per variant and part of it.
        return self._assemble(clean, rest, counted.groupBy(*keep).agg(*aggs).collect())

    def _bystanders(self, flips: DataFrame, key: tuple[str, ...]) -> DataFrame:
        """Untouched rows of a variant whose key flipped."""
        rows = self.injection.with_places(self.base).join(flips, self._same([F.col(f"`{k}`") for k in key]), "inner")
        rows = rows.withColumnRenamed("_fv", "_variant").filter(self._unchanged())
        old = F.struct(*[F.col(f"`{c}`") for c in self.columns]).alias("_old")
        return rows.select(
            "_variant", F.lit(-1).alias("_hit"), F.lit(-1).alias("_append"), ROW_ID, old,
            *[f"`{c}`" for c in self.columns],
        )

    def _assemble(self, clean: Tally, rest: dict, groups: list) -> dict[int, Tally]:
        tallies = {vi: clean.copy() for vi in self.members}
        for vi in self.members:
            for b in self.tables:
                if vi in rest and b.index in rest[vi]:
                    tallies[vi].states[b.index] = rest[vi][b.index]
        for row in groups:
            r = row.asDict()
            vi, hit, app = r["_variant"], r["_hit"], r["_append"]
            tally, variant = tallies[vi], self.injection.variants[vi]
            for b in self.flagging:
                tally.unexpected[b.index] += r[f"u{b.index}"]
                tally.counted[b.index] += r.get(f"c{b.index}", 0)
            for s in range(len(self.suites)):
                tally.flagged[s] += r[f"f{s}"]
            if hit < 0 and app < 0:
                continue
            part = variant.appended[app] if app >= 0 else variant.inplace[hit]
            error = part.injector.error_type
            tally.labelled[error] += r["n"]
            tally.n += r["n"] if app >= 0 else 0
            for s in range(len(self.suites)):
                tally.found[error, s] += r[f"hit{s}"]
            for b in self.tables:
                if app >= 0 or self._touches(vi, b.columns):
                    new = tuple(r[k] for k in (f"t{b.index}_a", f"t{b.index}_b") if k in r)
                    tally.states[b.index] = merge(b.state.how, tally.states[b.index], new)
        return tallies

class Grid:
    """All suites on one table and all its variants; ``facts`` is the tidy result."""

    def __init__(self, injection: Injection, suites: list[Suite], table_id: str,
                 cap: int | None = None, cap_seed: int = 0):
        self.injection, self.suites, self.table_id = injection, suites, table_id
        self.rules, self.suite_rules = fused(suites)
        self.within = None
        if cap is not None and injection.n > cap:
            self.within = Selection(injection.base, [cap_seed]).cuts([(cap_seed, cap)])[cap_seed, cap].covers()
        with compiled(injection.base.sparkSession):
            self._evaluate()

    def _evaluate(self) -> None:
        sampled = self.within is not None
        groups: dict[tuple, list[int]] = {((), sampled): []}
        for vi, variant in enumerate(self.injection.variants):
            key = (self.injection.schema_class(vi), sampled and variant.error_type not in CROSS_ROW)
            groups.setdefault(key, []).append(vi)
        self.tallies: dict[int, Tally] = {}
        self.passed: dict[int, dict[int, bool | None]] = {}
        for (casts, capped), members in groups.items():
            frame = _Frame(self.injection, dict(casts), members, self.within if capped else None,
                           self.rules, self.suite_rules)
            clean, rest = frame.clean()
            found = frame.variants(clean, rest) if members else {}
            self.tallies.update(found)
            order = list(found)
            verdicts = frame.verdicts([clean] + [found[vi] for vi in order])
            self.passed.update(zip(order, verdicts[1:]))
            if (casts, capped) == ((), sampled):
                self.clean, self.clean_passed = clean, verdicts[0]

    def clean_facts(self) -> list[dict]:
        facts = []
        for s, suite in enumerate(self.suites):
            numbers = self.suite_rules[s]
            verdicts = [self.clean_passed[i] for i in numbers]
            errors = verdicts.count(None)
            values = {
                "suite_size": len(numbers),
                "redundancy": len(numbers) - len(set(numbers)),
                "fp_rate_rules": ratio_of(verdicts.count(False), len(numbers)),
                "fp_rate_rows": ratio_of(self.clean.flagged[s], self.clean.n),
                "n_runtime_errors": errors,
            }
            if suite.counts is not None:
                total = sum(suite.counts.values())
                values["executability"] = ratio_of(suite.counts.get("valid", 0) - errors, total)
                values["n_rules_total"] = total
                for status in ("valid", "json_error", "unknown_expectation", "invalid_kwargs"):
                    values[f"n_{status}"] = suite.counts.get(status, 0)
                for cost in ("prompt_tokens", "completion_tokens", "latency_s"):
                    values[cost] = suite.costs.get(cost)
            facts += [{**suite.dims(self.table_id), "error_type": OVERALL, "metric": m, "value": v} for m, v in values.items()]
        return facts

    def detection_facts(self) -> list[dict]:
        judged = ((v.error_type, v.rate, v.seed, self.tallies[vi], self.passed[vi]) for vi, v in enumerate(self.injection.variants))
        return detection_facts(self.suites, self.suite_rules, self.table_id, judged)
