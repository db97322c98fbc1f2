"""Relational building blocks: live scans, latest and top-n rows, key unions, links by arity, and upserts.

Upserts return the new state of a table; writing it is the caller's choice (overwrite of a partition, a
table format with MERGE, or foreachBatch). Keys are compared null-safe where a key column may be null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def live(df: DataFrame, tenant: int | str | None = None, deleted: bool = False) -> DataFrame:
    """Rows of a tenant (all without one) that are not deleted, or with deleted rows too."""
    out = df if tenant is None or "tenant_id" not in df.columns else df.where(F.col("tenant_id") == tenant)
    return out if deleted or "deleted_at" not in df.columns else out.where(F.col("deleted_at").isNull())


def top_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in a total order. Spark limits groups before the shuffle (WindowGroupLimit)."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def latest_by(df: DataFrame, keys: Sequence[str], newest: Sequence[Column]) -> DataFrame:
    """The one row of each key whose `newest` values are the highest, compared in turn: a map-side aggregate without a sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*(c.alias(f"_{k}") for k, c in enumerate(newest)))).alias("_row")).select(*keys, "_row.*")


def children(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str, columns: Sequence[str]) -> DataFrame:
    """For each key, an array of its first n rows as structs, in order."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n)
    rows = F.array_sort(F.collect_list(F.struct("_rank", *columns)))
    return ranked.groupBy(*keys).agg(rows.alias(name)).withColumn(name, F.transform(name, lambda x: F.struct(*(x[c].alias(c) for c in columns))))


def with_flag(df: DataFrame, other: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """df with a flag: other has a row of that key."""
    return df.join(other.select(*keys).distinct().withColumn(name, F.lit(True)), list(keys), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def with_counts(df: DataFrame, other: DataFrame, keys: Sequence[str], **counts: Column) -> DataFrame:
    """df with aggregates of other's rows of that key, 0 without any."""
    grouped = other.groupBy(*keys).agg(*(c.alias(k) for k, c in counts.items()))
    return df.join(grouped, list(keys), "left").withColumns({k: F.coalesce(k, F.lit(0)) for k in counts})


def counts_by_kind(rows: DataFrame, keys: Sequence[str], kind: str, names: Sequence[str]) -> DataFrame:
    """Number of rows of each kind by key, as columns of the kinds' names: rows of many tables, united, take one shuffle and one join."""
    return rows.groupBy(*keys).agg(*(F.count_if(F.col(kind) == name).alias(name) for name in names))


def key_union(*frames: DataFrame) -> DataFrame:
    """Distinct keys of all frames."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out.distinct()


def link_by_arity(left: DataFrame, right: DataFrame, key: str, right_id: str) -> DataFrame:
    """left with linked_id and link_status: linked for just one match, conflict for more, unmatched for none."""
    matches = right.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("matches"), F.min(right_id).alias("_one"))
    out = left.join(matches, key, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    status = F.when(F.col("matches") == 1, F.lit("linked")).when(F.col("matches") > 1, F.lit("conflict")).otherwise(F.lit("unmatched"))
    return out.withColumn("linked_id", F.when(F.col("matches") == 1, F.col("_one"))).withColumn("link_status", status).drop("_one")


def match_either(left: DataFrame, right: DataFrame, first: str, second: str, left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id, matched_by): the first right_id that agrees in first, else in second. The right side is one row for each value, so no value makes pairs."""
    least = lambda key, name: right.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(right_id).alias(name))
    rows = left.select(left_id, first, second).join(least(first, "_one"), first, "left").join(least(second, "_two"), second, "left")
    rows = rows.select(left_id, F.coalesce("_one", "_two").alias(right_id), F.when(F.col("_one").isNotNull(), F.lit(first)).otherwise(F.lit(second)).alias("matched_by")).where(F.col(right_id).isNotNull())
    return rows.groupBy(left_id).agg(F.min_by(F.struct(right_id, "matched_by"), F.struct(F.col("matched_by") != first, right_id)).alias("_m")).select(left_id, "_m.*")


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 25) -> DataFrame:
    """One page of an ordered list; pages count from 1."""
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def page_info(df: DataFrame, size: int = 25) -> DataFrame:
    """total and last_page, which is 1 at least."""
    return df.agg(F.count("*").alias("total")).withColumn("last_page", F.greatest(F.lit(1), F.ceil(F.col("total") / size)))


def bounded(value, low: int, high: int, default: int) -> int:
    """A whole number from a request, within bounds; the default for anything else."""
    try:
        return min(max(int(str(value)), low), high)
    except ValueError:
        return default


def contains_any(term: str, *columns: str) -> Column:
    """Some column contains the term, whatever the case; nulls count as empty."""
    found = F.lit(False)
    for column in columns:
        found = found | F.contains(F.lower(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(term.lower()))
    return found


def upsert(state: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column], keep_old_when_null: bool = False, keep_first: Sequence[str] = ()) -> DataFrame:
    """state after new rows: per key the last new row by order, else the old one.

    keep_old_when_null: a null of the new row leaves the old value; keep_first: columns that keep theirs.
    """
    last = top_by(new, keys, order)
    both = state.alias("o").join(last.alias("n"), F.expr(" AND ".join(f"o.{k} <=> n.{k}" for k in keys)), "full_outer")
    fresh = F.expr(" OR ".join(f"n.{c} is not null" for c in last.columns))

    def value(c: str) -> Column:
        if c in keys or c in keep_first:
            return F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)
        if keep_old_when_null:
            return F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
        return F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return both.select(*(value(c) for c in state.columns))


def insert_missing(state: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """state and the first new row of each key that it lacks."""
    return state.unionByName(top_by(new, keys, order).join(state.select(*keys), list(keys), "left_anti").select(*state.columns))


def merge_sightings(rows: DataFrame, keys: Sequence[str], at: str, latest: Sequence[str]) -> DataFrame:
    """One row per key: first_seen, last_seen, and the other columns as last seen."""
    return rows.groupBy(*keys).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.max_by(F.struct(*latest), F.struct(at, *latest)).alias("_last")).select(*keys, "first_seen", "last_seen", *(F.col(f"_last.{c}").alias(c) for c in latest))


def soft_delete(df: DataFrame, condition: Column, now: str) -> DataFrame:
    return df.withColumn("deleted_at", F.when(condition & F.col("deleted_at").isNull(), F.lit(now).cast("timestamp")).otherwise(F.col("deleted_at")))


def force_delete(df: DataFrame, condition: Column) -> DataFrame:
    """df without the rows for which the condition holds; unknown is not true."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def set_where(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """A set-based update: columns of the rows for which the condition holds."""
    holds = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(holds, v).otherwise(F.col(c)) for c, v in values.items()})


def restore(df: DataFrame, condition: Column) -> DataFrame:
    return df.withColumn("deleted_at", F.when(~condition, F.col("deleted_at")))


def reject_siblings(df: DataFrame, group: str, row_id: str, accepted: DataFrame, open_: Sequence[str] = ("candidate", "ambiguous")) -> DataFrame:
    """Open rows of the groups of accepted rows are rejected, accepted ones accepted."""
    chosen = accepted.select(F.col(group).alias("_g"), F.col(row_id).alias("_id")).distinct()
    groups = chosen.select(F.col("_g").alias("_gg")).distinct()
    out = df.join(groups, F.col(group) == F.col("_gg"), "left").join(chosen, (F.col(group) == F.col("_g")) & (F.col(row_id) == F.col("_id")), "left")
    status = F.when(F.col("_id").isNotNull(), F.lit("accepted")).when(F.col("_gg").isNotNull() & F.col("status").isin(*open_), F.lit("rejected")).otherwise(F.col("status"))
    return out.withColumn("status", status).drop("_g", "_gg", "_id")


def purge(df: DataFrame, at: str, now: str, days: int) -> DataFrame:
    """Rows not older than days (at least 1)."""
    return df.where(F.col(at) >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(max(1, days))))


def retention_manifest(tables: dict[str, tuple[DataFrame, str]], days: dict[str, int], now: str, protected: Sequence[str] = ("audit", "pii")) -> DataFrame:
    """Per subject: rows, rows past their days, and the cut-off; protected subjects are left out."""
    out = None
    for subject, (df, at) in tables.items():
        if subject in protected or subject not in days:
            continue
        cut = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days[subject]))
        row = df.agg(F.count("*").alias("total_rows"), F.count_if(F.col(at) < cut).alias("expired_rows")).select(F.lit(subject).alias("subject"), "total_rows", "expired_rows", cut.alias("cutoff"))
        out = row if out is None else out.unionByName(row)
    return out


# Days that each subject is kept.
RETENTION_DAYS = {"audit": 2555, "pii": 2555, "source": 3650, "exports": 30, "client_errors": 90}


def deltas(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """before, after and their difference for every key of either."""
    pairs = before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key, "full_outer")
    return pairs.select(key, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("before", "after"))).withColumn("delta", F.col("after") - F.col("before"))


def apply_retention(df: DataFrame, at: str, now: str, days: int, dry_run: bool = True) -> DataFrame:
    """The rows that stay: all in a dry run, else those not older than days."""
    return df if dry_run else df.where(F.col(at) >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def in_range(column: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Between bounds, where a bound that is none or 0 does not count."""
    value = F.col(column) if isinstance(column, str) else column
    out = F.lit(True)
    if low:
        out = out & (value >= low)
    if high:
        out = out & (value <= high)
    return out


def named(df: DataFrame, names: DataFrame, code: str, name: str, default: str | None = None) -> DataFrame:
    """df with the name of a code from a table (code, name) of codes; the default, else the code, where it has none."""
    other = names.select(F.col(code).alias("_code"), F.col(name).alias("_name"))
    fallback = F.lit(default) if default is not None else F.col(code).cast("string")
    return df.join(other, F.col(code) == F.col("_code"), "left").withColumn(name, F.coalesce("_name", fallback)).drop("_code", "_name")


def register_case(cases: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """new with outcome: duplicate where a case of those keys is active, reactivate where one is inactive, else create. Nulls are equal."""
    known = cases.groupBy(*keys).agg(F.bool_or("active").alias("_active"))
    joined = new.alias("n").join(known.alias("k"), F.expr(" AND ".join(f"n.{k} <=> k.{k}" for k in keys)), "left")
    return joined.select("n.*", F.when(F.col("k._active"), F.lit("duplicate")).when(~F.col("k._active"), F.lit("reactivate")).otherwise(F.lit("create")).alias("outcome"))


def product_rows(small: DataFrame, other: DataFrame, most: int = 10_000) -> DataFrame:
    """All pairs of two catalogues, each of which must have at most `most` rows."""
    for df in (small, other):
        if df.limit(most + 1).count() > most:
            raise ValueError(f"a catalogue has more than {most} rows")
    return small.crossJoin(F.broadcast(other))
