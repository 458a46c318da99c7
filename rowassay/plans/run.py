"""Runs over written variants: write any grid, whole or as deltas, and score suites on what a manifest points to."""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowassay import ROW_ID
from rowassay.operators.inject import Injection, Variant
from rowassay.operators.sets import with_sets
from rowassay.plans.judge import Judge, Suite, Tally, detection_facts, facts_frame, fused, merge, state_columns
from rowassay.session import compiled, materialize
from rowassay.sources.scan import STORED_SCHEMA
from rowassay.sources.sinks import manifest_of, write_variants

_VARIANT, _LABEL = "_variant", "_label"
WHOLE, DELTA = "whole", "delta"
_LABEL_COLUMNS = "_row_id bigint, column string, label_type string, label_rate double, label_seed bigint, dataset string, original_value string, corrupted_value string"
_PARTITIONS = "table_id string, error_type string, rate double, seed bigint"


def _identity(injection: Injection, table_id: str) -> list[Column]:
    def pick(values, kind):
        return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col(_VARIANT) + 1)

    variants = injection.variants
    return [
        F.lit(table_id).alias("table_id"), pick([v.error_type for v in variants], "string").alias("variant_type"),
        pick([v.rate for v in variants], "double").alias("variant_rate"), pick([v.seed for v in variants], "bigint").alias("variant_seed"),
    ]


def _counts(variant: Variant, n: int, storage: str) -> tuple[int, int, int]:
    """Rows of a variant of a table of ``n`` rows, rows stored of it, labels: all known before anything is written."""
    added, changed = (sum(min(p.k, n) for p in parts) for parts in (variant.appended, variant.inplace))
    return n + added, n + added if storage == WHOLE else changed + added, changed + added


def write_injections(injections: dict[str, Injection], root: str, storage: str = WHOLE) -> DataFrame:
    """Write all variants and labels of several tables; returns their manifest.

    Labels, and deltas, of variants that change column types alike come from one scan. As ``delta``, each clean table is written once, and of a
    variant only the rows it changes and adds, so what is written grows with the number of corrupted rows. What is under
    ``root`` already stays.
    """
    if storage not in (WHOLE, DELTA):
        raise ValueError(f"storage is {WHOLE!r} or {DELTA!r}, not {storage!r}")
    rows, spark = [], None
    for table_id, injection in injections.items():
        spark, base = injection.base.sparkSession, injection.base
        clean = f"{root}/clean/table_id={table_id}" if storage == DELTA else None
        if clean:
            base.write.mode("overwrite").parquet(clean)
        for members in injection.schema_classes().values():
            keys = _identity(injection, table_id)
            # Whole variants are written one by one: from one scan, each task would sort all variants of its rows to part them.
            parts = [[vi] for vi in members] if storage == WHOLE else [members]
            frames = [injection.rows(part, changed_only=storage == DELTA).select(*keys, *base.columns) for part in parts]
            data = frames[0]
            with compiled(spark):
                write_variants(
                    frames,
                    injection.labels(members).select(*keys, ROW_ID, "column", "error_type", "rate", "seed", "dataset", "original_value", "corrupted_value"),
                    root,
                )
            schema = T.StructType([data.schema[c] for c in base.columns]).json()
            for v in (injection.variants[vi] for vi in members):
                rows.append((table_id, v.error_type, v.rate, v.seed, storage, clean, schema, *_counts(v, injection.n, storage)))
    return manifest_of(spark.createDataFrame(rows, f"{_PARTITIONS}, {STORED_SCHEMA}"), root)


def _name(line) -> str:
    return f"{line['error_type']}|{'' if line['rate'] is None else line['rate']}|{line['seed']}"


def _partitions(spark: SparkSession, paths: list[str], kind: str, schema: T.StructType) -> DataFrame:
    """Partitions of one kind (data or labels), each row with the name of its variant. The manifest has their columns, so no
    file is looked into."""
    whole = T.StructType(schema.fields + T.StructType.fromDDL(_PARTITIONS).fields)
    if not paths:
        return spark.createDataFrame([], T.StructType([T.StructField(_VARIANT, T.StringType()), *schema.fields]))
    base = paths[0].split(f"/{kind}/table_id=")[0] + f"/{kind}"
    df = spark.read.schema(whole).option("basePath", base).parquet(*paths)
    name = F.concat_ws("|", "error_type", F.coalesce(F.col("rate").cast("string"), F.lit("")), F.col("seed").cast("string"))
    return df.select(name.alias(_VARIANT), *[f"`{f.name}`" for f in schema])


def overlay(clean: DataFrame, delta: DataFrame, variants: list[str]) -> DataFrame:
    """All rows of all variants: their own rows, and the clean rows that they do not replace.

    The clean table meets the changed ids once, whatever the number of variants; a row is then exploded into the variants that
    left it alone. A clean row has no label, and the types of the delta.
    """
    changed = delta.groupBy(F.col(ROW_ID).alias("_changed")).agg(F.collect_set(_VARIANT).alias("_by"))  # at most all variants
    met = clean.join(changed, clean[ROW_ID] == F.col("_changed"), "left")
    left = F.array_except(F.lit(variants), F.coalesce("_by", F.array().cast("array<string>")))
    own = [c for c in delta.columns if c not in (_VARIANT, _LABEL)]
    rest = met.select(
        F.explode(left).alias(_VARIANT), *[F.col(f"`{c}`").cast(delta.schema[c].dataType).alias(c) for c in own], F.lit(None).cast("string").alias(_LABEL)
    )
    return delta.unionByName(rest)


def _stored(spark: SparkSession, lines: list[Row]) -> tuple[DataFrame, DataFrame]:
    """What is stored of the variants that ``lines`` list, and the label of each row that has one."""
    if len({(r["table_id"], r["schema"], r["storage"]) for r in lines}) != 1 or lines[0]["schema"] is None:
        raise ValueError("lines of one table, schema and storage are read together; their manifest must have all three")
    schema = T.StructType.fromJson(json.loads(lines[0]["schema"]))
    data = _partitions(spark, [r["data_path"] for r in lines if r["n_stored"]], "data", schema)
    labels = _partitions(spark, [r["labels_path"] for r in lines if r["n_labels"]], "labels", T.StructType.fromDDL(_LABEL_COLUMNS))
    return data, labels.select(_VARIANT, ROW_ID, F.col("label_type").alias(_LABEL))


def read_variants(spark: SparkSession, lines: list[Row]) -> DataFrame:
    """Rows of variants that a manifest lists, which must be of one table, one schema and one kind of storage.

    Besides the table's columns: ``_variant`` (error type, rate and seed) and ``_label``, the type of the error in the row.
    """
    data, labels = _stored(spark, lines)
    told = data.join(labels, [_VARIANT, ROW_ID], "left")
    if lines[0]["storage"] == WHOLE:
        return told
    return overlay(spark.read.parquet(lines[0]["clean_path"]), told, [_name(r) for r in lines])


class _Stored(Judge):
    """Suites on stored variants of one schema: one pass, whatever the number of suites and variants, and a count per key."""

    def __init__(self, data: DataFrame, suites: list[Suite], labels: DataFrame | None = None):
        """``labels`` are those of ``data``, if it does not have them as a column."""
        rules, self.numbers = fused(suites)
        self.data, self.labels = data, labels
        super().__init__(data.drop(_VARIANT, _LABEL), rules, self.numbers)

    def _marked(self, judged: dict[str, Column] | None = None) -> DataFrame:
        """Variant, label and the columns ``judged`` of each row, and for each key whether it is repeated in the variant.

        Keys and labels join what is judged already, so that no other column of all the variants is shuffled.
        """
        own = [_VARIANT, _LABEL if self.labels is None else ROW_ID]
        named = {f"_n{j}_{i}": F.col(f"`{k}`") for j, (key, _) in enumerate(self.keys) for i, k in enumerate(key)}
        df = with_sets(self.data, self.bound).select(*own, *[c.alias(n) for n, c in {**(judged or {}), **named}.items()])
        for j, (key, rules) in enumerate(self.keys):
            copies = self.data.filter(rules[0].counted).groupBy(_VARIANT, *key).agg(F.count("*").alias("_copies")).filter("_copies > 1")
            repeated = copies.select(F.col(_VARIANT).alias("_v"), *[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(key)])
            repeated = materialize(repeated, "repeated").withColumn(f"_key{j}", F.lit(True))  # its exact size decides how it is joined
            same = [F.col(_VARIANT) == F.col("_v")] + [F.col(f"_n{j}_{i}").eqNullSafe(F.col(f"_k{i}")) for i in range(len(key))]
            df = df.join(repeated, functools.reduce(Column.__and__, same), "left")
            df = df.drop("_v", *[f"{k}{i}" for k in ("_k", f"_n{j}_") for i in range(len(key))])
            df = df.withColumn(f"_key{j}", F.coalesce(f"_key{j}", F.lit(False)))
        return df if self.labels is None else df.join(self.labels, [_VARIANT, ROW_ID], "left").drop(ROW_ID)

    def tallies(self) -> dict[str, Tally]:
        words = range(self._words())
        states = {f"_s{b.index}": b.state.value for b in self.tables}
        df = self._marked({**states, **self._row_bits("_w")})
        patterns = [f"_w{w}" for w in words]
        df = df.withColumns({f"_w{w}": F.col(f"_w{w}").bitwiseOR(self._key_bits(w, "_key")) for w in words}) if patterns else df
        kinds = {b.index: (b.state.how, self._is_time(b)) for b in self.tables}
        first = [F.count("*").alias("_n")]
        for index, (how, is_time) in kinds.items():
            first += state_columns(how, F.col(f"_s{index}"), f"t{index}", is_time)
        counted = df.groupBy(_VARIANT, _LABEL, *patterns).agg(*first)

        def total(flag: Column) -> Column:
            return F.coalesce(F.sum(F.when(flag, F.col("_n"))), F.lit(0))

        aggs = [F.sum("_n").alias("n")] + [total(self._bit("_w", kind, index)).alias(f"{kind}{index}") for kind, index in self._bits()]
        flags = self._flags({b.index: self._bit("_w", "u", b.index) for b in self.flagging})
        aggs += [total(flag).alias(f"f{s}") for s, flag in enumerate(flags)]
        for index, (how, _) in kinds.items():
            aggs.append({"min": F.min, "max": F.max}.get(how, F.sum)(f"t{index}_a").alias(f"t{index}_a"))
            if how == "mean":
                aggs.append(F.sum(f"t{index}_b").alias(f"t{index}_b"))
        found: dict[str, Tally] = {}
        for row in counted.groupBy(_VARIANT, _LABEL).agg(*aggs).collect():  # one row a variant and error type
            r = row.asDict()
            tally, label = found.setdefault(r[_VARIANT], Tally()), r[_LABEL]
            tally.n += r["n"]
            for b in self.flagging:
                tally.unexpected[b.index] += r[f"u{b.index}"]
                tally.counted[b.index] += r.get(f"c{b.index}", 0)
            for s in range(len(self.suites)):
                tally.flagged[s] += r[f"f{s}"]
                if label is not None:
                    tally.found[label, s] += r[f"f{s}"]
            if label is not None:
                tally.labelled[label] += r["n"]
            for b in self.tables:
                new = tuple(r[k] for k in (f"t{b.index}_a", f"t{b.index}_b") if k in r)
                tally.states[b.index] = merge(b.state.how, tally.states.get(b.index), new)
        return found


def score_manifest(manifest: DataFrame, suites: dict[str, list[Suite]]) -> DataFrame:
    """Detection facts of suites on written variants, from disk: one row per suite, variant and metric.

    Variants of one table whose columns have the same types are read together, and all suites are judged in that pass.
    """
    spark, facts = manifest.sparkSession, []
    groups: dict[tuple, list[Row]] = {}
    for line in manifest.collect():  # one row a variant
        if line["table_id"] in suites:
            groups.setdefault((line["table_id"], line["schema"], line["storage"]), []).append(line)
    for (table_id, *_), lines in groups.items():
        rows, labels = _stored(spark, lines) if lines[0]["storage"] == WHOLE else (read_variants(spark, lines), None)
        stored = _Stored(rows, suites[table_id], labels)
        with compiled(spark):
            found = stored.tallies()
        empty = Tally(states={b.index: (None,) for b in stored.tables})
        tallies = [found.get(_name(r), empty) for r in lines]
        judged = zip(lines, tallies, stored.verdicts(tallies))
        facts += detection_facts(
            suites[table_id], stored.numbers, table_id, ((r["error_type"], r["rate"], r["seed"], tally, passed) for r, tally, passed in judged)
        )
    return facts_frame(spark, facts)
