"""Loads and mutations as pure functions from old and new rows to the table after the change.

Parquet has no row updates, so each returns the full new state; `replace_part`
and `append` also write. Within one writer a staged state is checked before it
takes the place of the old one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.model import REFERENCES
from lodestone.operators.number import numbered
from lodestone.staging import cut


def _on(keys: list[str], a: str = "o", b: str = "n") -> Column:
    return reduce(Column.__and__, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_if_null: tuple[str, ...] = (), keep: tuple[str, ...] = (), flag: bool = False) -> DataFrame:
    """old updated by new on null-safe keys, unknown keys inserted.

    Columns of new overwrite; those in `keep_if_null` only where new has a
    value; those in `keep` only where the row is new. `flag` adds `inserted`.
    A key that new holds twice is an error.
    """
    one = Window.partitionBy(*keys)
    clash = F.raise_error(F.lit("a key occurs twice in the new rows"))
    new = new.withColumn("_times", F.count("*").over(one)).where(F.when(F.col("_times") > 1, clash).otherwise(F.lit(True))).drop("_times")
    o, n = old.withColumn("_old", F.lit(True)).alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    joined = o.join(n, _on(keys), "full_outer")

    def value(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"o.{c}")
        if c in keys or c in keep:
            return F.when(F.col("o._old"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
        if c in keep_if_null:
            return F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
        return F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    columns = [value(c).alias(c) for c in old.columns]
    return joined.select(*columns, *([F.col("o._old").isNull().alias("inserted")] if flag else []))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and the rows of new whose key it lacks, one per key."""
    fresh = new.select(*old.columns).alias("n").join(old.alias("o"), _on(keys), "left_anti")
    return old.unionByName(fresh.dropDuplicates(keys))


def get_or_create(old: DataFrame, names: DataFrame, key: str, id_col: str = "id") -> DataFrame:
    """old and a row for each new name, ids going on from the largest in the order of the names."""
    fresh = names.select(key).where(F.col(key).isNotNull()).distinct().join(old.select(key), key, "left_anti")
    most = old.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_most"))
    dealt = numbered(fresh, [key], "_place").join(F.broadcast(most)).withColumn(id_col, (F.col("_place") + 1 + F.col("_most")).cast(old.schema[id_col].dataType))
    return old.unionByName(dealt.drop("_most", "_place"), allowMissingColumns=True)


def update_column(old: DataFrame, changes: DataFrame, key: str, column: str, only_null: bool = False) -> DataFrame:
    """old with `column` set from changes where the key matches; `only_null` leaves values that are there."""
    new = changes.select(F.col(key).alias("_key"), F.col(column).alias("_value"), F.lit(True).alias("_hit"))
    joined = old.join(new, F.col(key) == F.col("_key"), "left")
    hit = F.col("_hit") & F.col(column).isNull() if only_null else F.col("_hit")
    value = F.when(F.coalesce(hit, F.lit(False)), F.col("_value")).otherwise(F.col(column))
    return joined.select(*[value.alias(c) if c == column else F.col(c) for c in old.columns])


def delete_where_in(old: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """old without rows whose column is among the keys; a null column never is."""
    return old.join(keys.select(F.col(key).alias("_key")), F.col(column) == F.col("_key"), "left_anti")


def delete_unreferenced(old: DataFrame, condition: Column, references: DataFrame, key: str, reference: str) -> DataFrame:
    """old without the rows of `condition` that nothing refers to."""
    used = references.select(F.col(reference).alias("_key"))
    doomed = old.where(condition).join(used, F.col(key) == F.col("_key"), "left_anti").select(F.col(key).alias("_doomed"))
    return old.join(doomed, F.col(key) == F.col("_doomed"), "left_anti")


#: Most keys that a join broadcasts; more of them are hashed by partition.
BROADCAST_KEYS = 1_000_000


def _hashed(keys: DataFrame) -> DataFrame:
    """keys, written and counted, as the side of a join that is hashed, so that the rows they meet stream past and are not sorted."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys.hint("shuffle_hash")


def fallen(tables: dict[str, DataFrame], doomed: DataFrame, of: str = "symbols") -> dict[str, DataFrame]:
    """(id) per table that others refer to: the rows that go with the rows of `of` in doomed (id).

    A fixpoint over the references of the model that take rows along: every
    round finds the rows that refer to those of the round before and have not
    been found yet, so there are as many rounds as levels, and cycles end.
    Only keys are held by a task; the tables, however large, pass by.
    """
    gone = {of: cut(doomed.select("id").where("id IS NOT NULL").distinct())}
    new = dict(gone)
    targets = {target for refs in REFERENCES.values() for target, falls in refs.values() if falls}
    while new:
        step, asked = {}, {table: _hashed(rows) for table, rows in new.items()}
        for table in targets & tables.keys():
            over = [c for c, (target, falls) in REFERENCES.get(table, {}).items() if falls and target in new and c in tables[table].columns]
            if not over:
                continue
            found = [tables[table].join(asked[REFERENCES[table][c][0]].select(F.col("id").alias("_key")), F.col(c) == F.col("_key"), "left_semi").select("id") for c in over]
            rows = reduce(DataFrame.union, found).distinct()
            rows = cut(rows.join(gone[table], "id", "left_anti") if table in gone else rows)
            if not rows.isEmpty():
                step[table] = rows
        for table, rows in step.items():
            gone[table] = gone[table].union(rows) if table in gone else rows
        new = step
    return gone


def cascade(tables: dict[str, DataFrame], doomed: DataFrame, of: str = "symbols", restrict: bool = False) -> dict[str, DataFrame]:
    """tables without the rows of `of` in doomed (id) and without all that hangs off them, through however many tables.

    References that do not take rows along (an edge's other end, say) are
    deleted too, or, with `restrict`, are an error if the row that holds one
    would stay. A null reference holds nothing; ids that do not exist are
    passed over; tables the model does not know stay as they are.
    """
    gone = {table: _hashed(rows) for table, rows in fallen(tables, doomed, of).items()}
    out = {}
    for table, df in tables.items():
        refs = {c: x for c, x in REFERENCES.get(table, {}).items() if x[0] in gone and c in df.columns}
        left = delete_where_in(df, "id", gone[table], "id") if table in gone else df
        for column, (target, falls) in sorted(refs.items(), key=lambda x: not x[1][1]):
            if falls or not restrict:
                left = delete_where_in(left, column, gone[target], "id")
            else:
                fault = F.raise_error(F.concat(F.lit(f"{table}.{column} still refers to {target} "), F.col(column).cast("string")))
                keys = gone[target].select(F.col("id").alias("_key"))
                left = left.join(keys, F.col(column) == F.col("_key"), "left").where(F.when(F.col("_key").isNotNull(), fault).otherwise(F.lit(True))).drop("_key")
        out[table] = left
    return out


def purge_source(tables: dict[str, DataFrame], source_id: int) -> dict[str, DataFrame]:
    """The graph without the symbols a source contributed."""
    own = tables["symbol_profiles"].where(F.col("source_id") == source_id).select(F.col("symbol_id").alias("id"))
    return cascade(tables, own)


def replace_part(old: DataFrame, new: DataFrame, part: int, column: str = "part_number") -> DataFrame:
    """old with the rows of one part replaced; no rows, or rows of another part, are refused."""
    total, foreign = new.agg(F.count("*"), F.count_if(~F.col(column).eqNullSafe(F.lit(part)))).first()
    if not total:
        raise ValueError(f"no rows for part {part}")
    if foreign:
        raise ValueError(f"{foreign} rows are not of part {part}")
    return old.where(~F.col(column).eqNullSafe(F.lit(part))).unionByName(new)


def write_part(new: DataFrame, path: str, part: int, column: str = "part_number") -> dict[str, int]:
    """Replace one part of a table partitioned by `column`; {deleted, inserted}.

    The rows are written aside and counted first, so a failure leaves the old
    part as it was; then the partition is overwritten.
    """
    spark = new.sparkSession
    replace_part(new.limit(0), new, part, column)
    aside = f"{path.rstrip('/')}_staging_{part}"
    new.write.mode("overwrite").parquet(aside)
    staged = spark.read.schema(new.schema).parquet(aside)
    inserted = staged.count()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    deleted = spark.read.parquet(path).where(F.col(column) == part).count() if files.exists(at) else 0
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
    files.delete(spark._jvm.org.apache.hadoop.fs.Path(aside), True)
    return {"deleted": deleted, "inserted": inserted}


def clear(path: str, df: DataFrame) -> None:
    """Empty a table, keeping its schema."""
    df.limit(0).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def pending_migrations(available: DataFrame, applied: DataFrame) -> DataFrame:
    """(name, checksum) still to apply, by name. A changed checksum or a missing file of an applied one is an error."""
    joined = applied.select("name", F.col("checksum").alias("_was")).join(available.select("name", "checksum"), "name", "full_outer")
    fault = F.when(F.col("checksum").isNull(), F.concat(F.lit("applied migration is missing: "), F.col("name"))).when(
        F.col("_was").isNotNull() & (F.col("_was") != F.col("checksum")), F.concat(F.lit("applied migration has changed: "), F.col("name"))
    )
    checked = joined.where(F.when(fault.isNotNull(), F.raise_error(fault)).otherwise(F.lit(True)))
    return checked.where("_was IS NULL").select("name", "checksum").orderBy("name")


def insert(old: DataFrame, new: DataFrame, order: list[str], id_col: str = "id") -> DataFrame:
    """The new rows with ids that go on from the largest in old, in the given order."""
    most = old.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_most"))
    dealt = numbered(new, [*order], "_place").join(F.broadcast(most))
    return dealt.withColumn(id_col, (F.col("_place") + 1 + F.col("_most")).cast(old.schema[id_col].dataType)).select(*old.columns)


def rewrite(old: DataFrame, new: DataFrame, column: str, value: object, order: list[str], id_col: str = "id") -> DataFrame:
    """old without the rows that hold `value` in `column`, and the new rows with ids that go on from the largest left."""
    kept = old.where(~F.col(column).eqNullSafe(F.lit(value)))
    return kept.unionByName(insert(kept, new, order, id_col))


def record_migrations(applied: DataFrame, pending: DataFrame, at: Column) -> DataFrame:
    """The migrations table after the pending ones ran: each is recorded once, with the time it was applied."""
    return applied.unionByName(pending.select("name", "checksum", at.alias("applied_at")))


def apply_migrations(available: DataFrame, applied: DataFrame, run: Callable[[str], None], at: Column | None = None) -> DataFrame:
    """Run the pending migrations by name, one after the other, and record those that ended; one that fails ends the call.

    There are as many as files in a folder, so the driver goes through them.
    """
    done = applied
    for row in pending_migrations(available, applied).collect():
        run(row["name"])
        one = applied.sparkSession.createDataFrame([(row["name"], row["checksum"])], "name string, checksum string")
        done = record_migrations(done, one, at if at is not None else F.current_timestamp())
    return done
