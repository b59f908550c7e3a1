"""A cleaning plan: decided once from the data, kept as plain values, applied as a projection.

``fit`` runs a few aggregates and returns what was decided per column. ``apply`` turns any
frame of the same shape into the cleaned one with ordinary columns and, for spelling maps,
small joins; it runs no job, so it also works on a streaming frame (without date filling).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells, dates, names, vocab
from ..functions.counts import cells_where, value_counts
from ..operators import cleaning, dedup, impute, ranking, similarity
from ..operators.profile import missing_profile
from ..session import shared_folder, spread, written

INLINE_ENTRIES = 10_000
MIN_DIGIT_SHARE = 0.5
PLACE = "_source_place"
LOG_SCHEMA = "step string, column string, action string, n_cells bigint, detail string"


@dataclass
class ColumnPlan:
    """What happens to one column. ``kind``: number, date, text, category, boolean, digits, keep."""

    source: str
    kind: str
    whole: bool = False
    formats: list[str] = field(default_factory=list)
    low: float | None = None
    high: float | None = None
    cap_low: float | None = None
    cap_high: float | None = None
    fill: object = None
    mapping: list[list[str]] = field(default_factory=list)
    mapping_path: str | None = None


@dataclass
class CleaningPlan:
    columns: dict[str, ColumnPlan]
    date_parts: dict[str, bool]
    log: list[tuple] = field(default_factory=list)
    missing_dates: dict[str, int] = field(default_factory=dict)

    # -- deciding ---------------------------------------------------------------------------

    @classmethod
    def fit(cls, df: DataFrame, drop: Sequence[str] = (), keep_text: Sequence[str] = (),
            canonical: DataFrame | None = None, fuzzy: bool = True,
            min_currency_share: float = 0.0) -> CleaningPlan:
        """Decide on every column over all rows.

        ``keep_text`` names (cleaned) text columns left as they are, such as codes.
        ``canonical`` is a supplied (column, dirty, canonical) table applied before spelling
        variants are merged. Every decision is a pass over the rows, so they are spread over all cores first.
        """
        return cls._fit(spread(df), drop, keep_text, canonical, fuzzy, min_currency_share)[0]

    @classmethod
    def _fit(cls, df: DataFrame, drop: Sequence[str] = (), keep_text: Sequence[str] = (),
             canonical: DataFrame | None = None, fuzzy: bool = True, min_currency_share: float = 0.0,
             carried: Sequence[str] = ()) -> tuple[CleaningPlan, DataFrame]:
        """The plan, and the rows with typed cells and the ``carried`` columns, which take no part."""
        log: list[tuple] = []
        sources = [c for c in df.columns if c not in {*drop, *carried}]
        log += [("columns", c, "dropped" if c in df.columns else "not found", None, None)
                for c in drop]
        targets = names.standard_names(sources)
        log += [("columns", t, "renamed", None, f"{s} -> {t}")
                for s, t in zip(sources, targets) if s != t]
        raw = cells.without_nan(df.select(*[quoted(s).alias(t) for s, t in zip(sources, targets)], *carried))
        plan = cls({t: ColumnPlan(s, "keep") for s, t in zip(sources, targets)}, {}, log)
        cell_rows = raw.drop(*carried)
        plan._decide_types(cell_rows, set(keep_text), min_currency_share)
        plan._decide_text(cell_rows, set(keep_text), canonical, fuzzy)
        typed = written(plan._typed(raw, carried))  # parsed once, read by every later pass
        plan._decide_values(typed.drop(*carried))
        return plan, typed

    def _decide_types(self, raw: DataFrame, keep: set[str], min_currency_share: float) -> None:
        text = [c for c in names.text_columns(raw) if c not in keep]
        for c in names.date_columns(raw):
            self.columns[c].kind = "date"
        if not text:
            return
        counts = written(value_counts(raw, text))  # each distinct cell is judged once
        swept = _swept_counts(counts, text)
        self.log += [("null markers", c, "set to null", r["n"], None)
                     for c, r in swept.items() if r["n"]]
        open_text = []
        profile = {r["column"]: r for r in cleaning.numbers_of_counts(counts, text).collect()}
        for r in (profile[c] for c in text):
            c, plan = r["column"], self.columns[r["column"]]
            # digits are kept as text, leading zeros included, where most cells hold nothing else
            digits = r["n_values"] - swept[c]["n_lettered"]
            if names.is_digit_identifier(c) and digits >= MIN_DIGIT_SHARE * r["n_values"] > 0:
                plan.kind = "digits"
                n_bad = swept[c]["n_lettered"]
                if n_bad:
                    self.log.append(("ids", c, "corrupted set to null", n_bad, None))
            elif r["n_values"] and (r["to_number"]
                                    or r["n_currency"] > min_currency_share * r["n_values"]):
                plan.kind, plan.whole = "number", r["whole"]
                if r["n_currency"]:
                    self.log.append(("currency", c, "symbols stripped", r["n_currency"], None))
                self.log.append(("types", c, "to whole number" if r["whole"] else "to number",
                                 r["n_numbers"], f"{r['numeric_share']:.0%} parsed"))
            elif r["n_values"]:
                open_text.append(c)
        present = counts.where(~cells.is_null_marker(F.col("value")))
        candidates = cleaning.date_columns_of(present, open_text) if open_text else {}
        for c, formats in candidates.items():
            self.columns[c].kind, self.columns[c].formats = "date", list(formats)
            self.log.append(("types", c, "to date", None, ", ".join(formats[:3])))
        for c in open_text:
            if c not in candidates:
                self.columns[c].kind = "text"

    def _decide_text(self, raw: DataFrame, keep: set[str], canonical: DataFrame | None,
                     fuzzy: bool) -> None:
        text = [c for c, p in self.columns.items()
                if p.kind == "text" and not c.endswith("_month_name")]
        if not text:
            return
        cleaned = raw.select(*[self._rewritten(c).alias(c) for c in text])
        counts = written(value_counts(cleaned, text))  # one row per distinct value
        distinct = {r["column"]: r for r in counts.groupBy("column").agg(
            F.count("*").alias("distinct"), F.sum("count").alias("rows"),
            F.avg(F.col("value").rlike("[0-9]").cast("int")).alias("numbered"),
            F.bool_and(cells.is_boolean_word(F.col("value"))).alias("boolean")).collect()}
        for c in text:
            r, plan = distinct.get(c), self.columns[c]
            if r is None:
                continue
            few = (r["distinct"] <= vocab.CATEGORY_MAX_DISTINCT
                   or r["distinct"] / r["rows"] < vocab.CATEGORY_MAX_RATIO)
            if not few and not names.has_fragment(c, vocab.NAME_LIKE_FRAGMENTS):
                continue
            if r["boolean"]:
                plan.kind = "boolean"
                self.log.append(("booleans", c, "to Yes/No", r["rows"], None))
                continue
            plan.kind = "category"
            # nearly unique numbered texts name different things
            numbered = r["numbered"] > 0.5 and r["distinct"] > 0.5 * r["rows"]
            self._merge_spellings(c, counts, canonical, fuzzy and not numbered)

    def _merge_spellings(self, c: str, counts: DataFrame, canonical: DataFrame | None,
                         fuzzy: bool) -> None:
        """Supplied names first, then title case, then spelling variants, as one map."""
        plan = self.columns[c]
        values = counts.where(F.col("column") == c).select("value", "count")
        target = F.col("value")
        if canonical is not None:
            given = canonical.where(F.col("column") == c).select(
                F.col("dirty").alias("value"), "canonical")
            values = values.join(given, "value", "left")
            target = F.coalesce("canonical", "value")
        named = values.select("value", "count", cells.sweep_nulls(F.initcap(target)).alias("named"))
        if fuzzy and not names.is_identifier_role(c):
            weighted = named.groupBy(F.col("named").alias(c)).agg(F.sum("count").alias("count"))
            merged = similarity.spelling_map_of_counts(
                weighted.na.drop().select(F.col(c).alias("value"), "count"))
            named = named.join(merged.select(F.col("value").alias("named"),
                                             F.col("canonical").alias("final")), "named", "left")
            named = named.withColumn("final", F.coalesce("final", "named"))
        else:
            named = named.withColumn("final", F.col("named"))
        changed = written(named.where(~F.col("final").eqNullSafe(F.initcap("value")))
                          .select("value", F.col("final").alias("canonical"), "count"))
        n = changed.count()
        if n:
            rows = changed.agg(F.sum("count")).first()[0]
            self.log.append(("categories", c, "spellings merged", rows, f"{n} variants"))
        if n <= INLINE_ENTRIES:
            plan.mapping = [[r["value"], r["canonical"]] for r in changed.collect()]
        else:  # too many to carry inside the plan: keep them as a table beside it
            spark = changed.sparkSession
            plan.mapping_path = f"{shared_folder(spark)}/tablewright-map-{uuid.uuid4().hex}"
            changed.select("value", "canonical").write.parquet(plan.mapping_path)

    def _decide_values(self, typed: DataFrame) -> None:
        """Scales, fill values, domain bounds and outlier caps, in the order they are applied."""
        scales = {r["column"]: (r["scale_min"], r["scale_max"])
                  for r in cleaning.rating_scales(typed).collect()}
        self.log += [("scales", c, "inferred", None, f"{lo:g}..{hi:g}")
                     for c, (lo, hi) in scales.items()]
        missing = {r["column"]: r["missing"]
                   for r in missing_profile(typed).where("missing > 0").collect()}
        self.missing_dates = {c: missing[c] for c in names.date_columns(typed) if c in missing}
        for c, value in impute.fill_values(typed, list(missing)).items():
            self.columns[c].fill = value
            self.log.append(("missing", c, "filled", missing[c], str(value)))
        for c, (low, high) in cleaning.domain_bounds(typed, scales).items():
            self.columns[c].low, self.columns[c].high = low, high
        bounded = self._bounded(self._filled(typed))
        for c, (low, high) in cleaning.outlier_bounds(bounded, scales).items():
            self.columns[c].cap_low, self.columns[c].cap_high = low, high
        self._log_limits(typed, bounded)
        self.date_parts = cleaning.date_part_columns(typed)

    def _log_limits(self, typed: DataFrame, bounded: DataFrame) -> None:
        outside = {}
        for c, p in self.columns.items():
            if p.low is not None or p.high is not None:
                outside["bounds", c] = _beyond(c, p.low, p.high)
        before = typed.agg(*[F.count_if(e).alias(f"n{i}")
                             for i, e in enumerate(outside.values())]).first() if outside else []
        capped = {c: _beyond(c, p.cap_low, p.cap_high) for c, p in self.columns.items()
                  if p.cap_low is not None or p.cap_high is not None}
        after = bounded.agg(*[F.count_if(e).alias(f"n{i}")
                              for i, e in enumerate(capped.values())]).first() if capped else []
        self.log += [("bounds", c, "clipped", n, None) for (_, c), n in zip(outside, before) if n]
        self.log += [("outliers", c, "capped", n, None) for c, n in zip(capped, after) if n]

    # -- applying ---------------------------------------------------------------------------

    def apply(self, df: DataFrame, fill: bool = True, order: Sequence[str] | None = None) \
            -> DataFrame:
        """Clean a frame. With an ``order`` key, missing dates are filled from neighbours.

        Key columns that the plan does not know are used for the order only.
        """
        carried = [c for c in (order or []) if c not in self.columns]
        raw = cells.without_nan(df.select(
            *[quoted(p.source).alias(c) for c, p in self.columns.items()], *carried))
        return self._finished(self._typed(raw, carried), carried, fill, order)

    def _finished(self, result: DataFrame, carried: Sequence[str] = (), fill: bool = True,
                  order: Sequence[str] | None = None) -> DataFrame:
        """Fills, limits and date parts of typed rows."""
        if fill:
            result = self._filled(result)
            if order:
                result = impute.fill_dates(result, order)
        result = self._capped(self._bounded(result)).drop(*carried)
        return cleaning.add_date_parts(result, self.date_parts)

    def _rewritten(self, c: str) -> Column:
        """The row-local part for one column, from raw cell to typed cell."""
        plan, cell = self.columns[c], F.col(c)
        swept = cells.sweep_nulls(cell)
        if plan.kind == "number":
            number = cells.parse_number(cell)
            return number.cast("bigint") if plan.whole else number
        if plan.kind == "date":
            return dates.parse_date(swept, tuple(plan.formats)) if plan.formats else F.to_date(cell)
        if plan.kind == "digits":
            return cells.digits_only(cells.trimmed(swept))
        if plan.kind == "text":
            return cells.sweep_nulls(cells.clean_text(swept))
        if plan.kind == "boolean":
            return cells.yes_no(cells.clean_text(swept))
        if plan.kind == "category":
            return cells.clean_text(swept)
        return cell

    def _typed(self, raw: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
        typed = raw.select(*[self._rewritten(c).alias(c) for c in self.columns], *carried)
        for c, p in self.columns.items():
            if p.kind != "category":
                continue
            mapping = self._mapping(raw.sparkSession, p)
            if mapping is None:
                typed = typed.withColumn(c, F.initcap(c))
                continue
            marked = mapping.withColumn("_mapped", F.lit(True)).withColumnRenamed("value", c)
            typed = (typed.join(marked, c, "left").withColumn(
                c, F.when(F.col("_mapped"), F.col("canonical")).otherwise(F.initcap(c)))
                .select(*self.columns, *carried))
        return typed

    @staticmethod
    def _mapping(spark: SparkSession, plan: ColumnPlan) -> DataFrame | None:
        if plan.mapping_path:
            return spark.read.parquet(plan.mapping_path)
        if plan.mapping:
            rows = spark.createDataFrame([tuple(m) for m in plan.mapping],
                                         "value string, canonical string")
            return F.broadcast(rows)  # at most INLINE_ENTRIES rows
        return None

    def _filled(self, df: DataFrame) -> DataFrame:
        return impute.fill_with(df, {c: p.fill for c, p in self.columns.items()
                                     if p.fill is not None})

    def _bounded(self, df: DataFrame) -> DataFrame:
        return cleaning.clip_columns(df, {c: (p.low, p.high) for c, p in self.columns.items()
                                          if p.low is not None or p.high is not None})

    def _capped(self, df: DataFrame) -> DataFrame:
        return cleaning.clip_columns(df, {c: (p.cap_low, p.cap_high)
                                          for c, p in self.columns.items()
                                          if p.cap_low is not None or p.cap_high is not None})

    # -- keeping ----------------------------------------------------------------------------

    def log_frame(self, spark: SparkSession) -> DataFrame:
        """The cleaning log: what was done to which column and to how many cells."""
        return spark.createDataFrame([tuple(r) for r in self.log], LOG_SCHEMA)

    def verdict(self) -> str:
        acted = [r for r in self.log if r[2] != "not found"]
        return f"{len(acted)} changes" if acted else "no cleaning needed"

    def to_json(self) -> str:
        return json.dumps({"columns": {c: asdict(p) for c, p in self.columns.items()},
                           "date_parts": self.date_parts, "log": self.log,
                           "missing_dates": self.missing_dates})

    @classmethod
    def from_json(cls, text: str) -> CleaningPlan:
        kept = json.loads(text)
        return cls({c: ColumnPlan(**p) for c, p in kept["columns"].items()}, kept["date_parts"],
                   [tuple(r) for r in kept["log"]], kept.get("missing_dates", {}))


def quoted(name: str) -> Column:
    """A column by its literal name, whatever characters that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def _beyond(c: str, low: float | None, high: float | None) -> Column:
    below = F.col(c) < low if low is not None else F.lit(False)
    return below | (F.col(c) > high if high is not None else F.lit(False))


def _swept_counts(counts: DataFrame, text: Sequence[str]) -> dict[str, dict[str, int]]:
    """Per text column: null markers, and non-null cells holding more than digits."""
    value = F.col("value")
    lettered = cells.trimmed(cells.sweep_nulls(value)).rlike("[^0-9]")
    found = {r["column"]: r.asDict() for r in counts.groupBy("column").agg(
        cells_where(cells.is_null_marker(value)).alias("n"), cells_where(lettered).alias("n_lettered")).collect()}
    return {c: found.get(c, {"n": 0, "n_lettered": 0}) for c in text}


@dataclass
class Cleaned:
    """Everything one cleaning run yields."""

    rows: DataFrame
    plan: CleaningPlan
    retention: DataFrame
    log: DataFrame


def clean(df: DataFrame, drop: Sequence[str] = (), keep_first: Sequence[str] = (),
          order: Sequence[str] | None = None, impute_with: str = "simple",
          row_id: str | None = None, **options) -> Cleaned:
    """The whole run: null markers, duplicates, types, dates, categories, fills, limits.

    ``keep_first`` orders the rows of a repeated id. Missing dates are taken from the row before
    in ``order``, else the row after; without a key, in the order of the source, which also
    settles which of several rows with one id comes first. ``impute_with`` is "simple" or
    "forest"; the latter needs ``row_id``, a unique column, and leaves dates alone. The de-duplicated
    rows are written once, since every later step reads them.
    """
    if impute_with == "forest" and row_id is None:
        raise ValueError("a forest needs row_id, a unique column")
    sources = [c for c in df.columns if c not in set(drop)]
    named = dict(zip(sources, names.standard_names(sources)))
    target = (lambda c: named.get(c, c))
    place = None if order else PLACE
    placed = ranking.with_source_place(df, place) if place else df
    renamed = placed.select(*[quoted(s).alias(t) for s, t in named.items()], *([place] if place else []))
    swept = cleaning.sweep_nulls(cells.without_nan(renamed))
    unique = written(dedup.deduplicate(spread(swept), [target(c) for c in keep_first], place=place))
    plan, typed = CleaningPlan._fit(unique, carried=[place] if place else [], **options)
    log = [("columns", c, "dropped" if c in df.columns else "not found", None, None) for c in drop]
    plan.log[:0] = log + [("columns", t, "renamed", None, f"{s} -> {t}") for s, t in named.items() if s != t]
    kept_rows = dedup.retention(df, unique.drop(PLACE))
    counts = kept_rows.first()
    plan.log.insert(0, ("duplicates", None, "rows removed", counts["rows_removed"],
                        f"retention {counts['retention_pct']}%"))
    if impute_with == "forest":
        rows = impute.forest_impute(typed.drop(PLACE), target(row_id))  # date parts come after filling
        rows = plan._capped(plan._bounded(rows))
        rows = cleaning.add_date_parts(rows, plan.date_parts)
    else:
        keys = [target(c) for c in order] if order else [PLACE]
        rows = plan._finished(typed, [place] if place else [], order=keys)
        plan.log += [("missing", c, "filled from neighbours", n, "source order" if place else ", ".join(keys))
                     for c, n in plan.missing_dates.items() if c not in keys]
    for s, t in named.items():  # the plan reads raw headers from here on
        plan.columns[t].source = s
    return Cleaned(rows, plan, kept_rows, plan.log_frame(df.sparkSession))
