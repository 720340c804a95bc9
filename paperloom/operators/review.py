"""Changes of stored rows by given rules: patches, transitions, selections. States and rules are parameters; none is built in."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def patched(rows: DataFrame, changes: DataFrame, key: str, nullable: tuple[str, ...] = (), order: str = "ord") -> DataFrame:
    """Rows after patches.

    changes: key, ord, fields map<string,string>. Only fields named in a patch change; a NULL is applied to
    the columns in ``nullable`` and ignored for all others; nested values are given as JSON. Patches of one row apply in order, so the last
    one that counts wins. Patches of unknown rows, and of unknown columns, do nothing.
    """
    each = changes.select(key, order, F.explode("fields").alias("field", "value")).where(F.col("value").isNotNull() | F.col("field").isin(*nullable))
    last = each.groupBy(key, "field").agg(F.max_by(F.struct("value"), order).alias("v"))
    per_row = last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", "v"))).alias("_p"))
    j = rows.join(per_row, key, "left")

    def after(c: str) -> Column:
        kind, new = rows.schema[c].dataType, F.col("_p")[c]["value"]
        value = F.from_json(new, kind) if kind.typeName() in ("array", "struct", "map") else new.cast(kind)
        return F.when(F.coalesce(F.map_contains_key("_p", F.lit(c)), F.lit(False)), value).otherwise(F.col(c)).alias(c)

    return j.select(*(F.col(c) if c == key else after(c) for c in rows.columns))


def transitioned(rows: DataFrame, outcomes: DataFrame, key: str, state: str, steps: Mapping[tuple[str, str], str], dry_run: bool = False) -> DataFrame:
    """Rows after the outcomes of a batch: (state, outcome) gives the next state, any other pair changes nothing.

    outcomes: key, seq, outcome, in order of seq. A dry run changes nothing.
    """
    if dry_run:
        return rows
    table = F.create_map(*(F.lit(x) for (a, o), b in steps.items() for x in (f"{a}\u0001{o}", b)))
    runs = outcomes.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "outcome"))), lambda x: x["outcome"]).alias("_o"))
    after = F.aggregate("_o", F.col(state), lambda s, o: F.coalesce(F.try_element_at(table, F.concat_ws("\u0001", s, o)), s))
    return rows.join(runs, key, "left").withColumn(state, F.when(F.col("_o").isNull(), F.col(state)).otherwise(after)).select(*rows.columns)


def selected(rows: DataFrame, choices: DataFrame, key: str, match: str, decision: str, taken: str, cleared: str) -> DataFrame:
    """A chosen match is stored and decides ``taken``; a withdrawn one (NULL) leaves ``cleared`` only where the decision was ``taken``."""
    j = rows.join(choices.select(key, F.col("match").alias("_m"), F.lit(True).alias("_hit")), key, "left")
    decided = F.when(F.col("_m").isNotNull(), taken).when(F.col(decision) == taken, cleared).otherwise(F.col(decision))
    return j.withColumn(decision, F.when(F.col("_hit"), decided).otherwise(F.col(decision))).withColumn(match, F.when(F.col("_hit"), F.col("_m")).otherwise(F.col(match))).select(*rows.columns)


def closed(rows: DataFrame, orders: DataFrame, key: str, state: str, decision: str, reason: str, at: str, put: tuple[str, str], back: tuple[str, str]) -> DataFrame:
    """Rows taken out with a reason and a time, or put back without.

    orders: key, close boolean, reason, at; ``put`` and ``back`` are (state, decision) after either.
    """
    j = rows.join(orders.select(key, F.col("close").alias("_c"), F.col("reason").alias("_r"), F.col("at").alias("_t")), key, "left")
    either = lambda a, b, old: F.when(F.col("_c"), a).when(~F.col("_c"), b).otherwise(old)
    null = F.lit(None)
    return j.withColumns(
        {
            state: either(F.lit(put[0]), F.lit(back[0]), F.col(state)), decision: either(F.lit(put[1]), F.lit(back[1]), F.col(decision)),
            reason: either(F.col("_r"), null, F.col(reason)), at: either(F.col("_t"), null, F.col(at)),
        }
    ).select(*rows.columns)


def in_states(rows: DataFrame, column: str, states: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows in one of the states, and the rest; NULL is in no state."""
    hit = F.coalesce(F.col(column).isin(*states), F.lit(False))
    return rows.where(hit), rows.where(~hit)


def persisted(stored: DataFrame, candidates: DataFrame, run: Mapping[str, object], next_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """U12/J-14: (run row, inserted candidates, audit events) of an extraction run; stored and repeated labels of a document are skipped."""
    from .linking import new_rows

    spark = candidates.sparkSession
    runs = spark.createDataFrame([{"id": next_id, **run}])
    fresh = new_rows(stored, candidates, ["document_id", "normalized_label"], "candidate_id").withColumn("extraction_run_id", F.lit(next_id))
    events = fresh.select(F.lit("candidate_created").alias("event"), F.col("candidate_id").alias("entity_id"), F.create_map(F.lit("run"), F.lit(str(next_id))).alias("details"))
    return runs, fresh, events


def called(prompts: DataFrame, call: Callable[[str], str], column: str = "prompt") -> DataFrame:
    """Prompts with the answers of a given function, called once per row on the executors; an error becomes a row with its message."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)

    def run(batches):
        for b in batches:
            raw, err = [], []
            for p in b[column]:
                try:
                    raw.append(call(p))
                    err.append(None)
                except Exception as e:  # noqa: BLE001 - a failed call is a row
                    raw.append(None)
                    err.append(str(e))
            yield b.assign(raw=raw, error=err)

    return prompts.mapInPandas(run, f"{fields}, raw string, error string")


def emptied(*tables: DataFrame) -> list[DataFrame]:
    """Tables of the same schema without rows, to overwrite the stored ones with."""
    return [t.sparkSession.createDataFrame([], t.schema) for t in tables]


def counted(rows: DataFrame, **conditions: Column) -> DataFrame:
    """One row with the number of rows for each named condition, and of all."""
    return rows.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(c).alias(k) for k, c in conditions.items()))
