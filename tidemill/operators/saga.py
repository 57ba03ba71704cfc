"""Outcomes of multi-step workflows with compensation, for tables of steps.

Steps are rows (saga_id, step_no, activity, ok). A workflow runs its steps in order; the first that fails ends it, and
the completed ones before it are compensated, last first. Since that depends on the first failure alone, outcomes are
one aggregation. Alternatives (alt_no, alt_step) and branches (branch_no, step_no) are groups within a workflow. Only
where a compensation can refuse, and the workflow then goes forward again, is a fold needed: run_hosts, over each
workflow's few steps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLIP = "struct<completedWorkLogs: array<struct<activityTypeName: string, result: string>>, nextWorkItems: array<struct<activityTypeName: string, arguments: string>>>"


def work_address(activity: Column) -> Column:
    return F.concat(F.lit("sb://./"), activity)


def compensation_address(activity: Column) -> Column:
    return F.concat(F.lit("sb://./"), activity, F.lit("Compensation"))


def _first_failure(steps: DataFrame, keys: list[str], order: str) -> DataFrame:
    return steps.groupBy(*keys).agg(F.count("*").alias("n_steps"), F.min(F.when(~F.col("ok"), F.col(order))).alias("failed_step"), F.min_by("activity", F.when(~F.col("ok"), F.col(order))).alias("failed_activity"), F.sum(F.lit(1)).alias("__n"))


def outcomes(steps: DataFrame) -> DataFrame:
    """(saga_id, n_steps, completed, failed_step, failed_activity, n_done, n_compensated): steps are numbered from 1 without gaps."""
    out = _first_failure(steps, ["saga_id"], "step_no").drop("__n")
    done = F.coalesce(F.col("failed_step") - 1, F.col("n_steps"))
    return out.select("saga_id", "n_steps", F.col("failed_step").isNull().alias("completed"), "failed_step", "failed_activity", done.alias("n_done"), F.when(F.col("failed_step").isNull(), 0).otherwise(done).cast("bigint").alias("n_compensated"))


def compensations(steps: DataFrame) -> DataFrame:
    """(saga_id, compensation_no, step_no, activity): what failed workflows undo, in order, last step first."""
    failed = outcomes(steps).where("not completed").select("saga_id", "failed_step")
    undone = steps.join(failed, "saga_id").where("step_no < failed_step")
    return undone.select("saga_id", (F.col("failed_step") - F.col("step_no")).alias("compensation_no"), "step_no", "activity")


def slips(steps: DataFrame, executed: int) -> DataFrame:
    """Each workflow's slip after so many steps without a failure: (saga_id, is_completed, is_in_progress, progress_uri, compensation_uri)."""
    at = steps.groupBy("saga_id").agg(F.max(F.when(F.col("step_no") > executed, 1).otherwise(0)).alias("more"), F.max_by("activity", F.when(F.col("step_no") <= executed, F.col("step_no"))).alias("last"), F.min_by("activity", F.when(F.col("step_no") > executed, F.col("step_no"))).alias("next"))
    return at.select("saga_id", (F.col("more") == 0).alias("is_completed"), F.col("last").isNotNull().alias("is_in_progress"), work_address(F.col("next")).alias("progress_uri"), compensation_address(F.col("last")).alias("compensation_uri"))


def next_messages(steps: DataFrame) -> DataFrame:
    """(saga_id, step_no, uri): where a host sends the slip after each step that runs: to the next one's address, or after a
    failure to the last completed one's compensation; nowhere if there is none."""
    run = Window.partitionBy("saga_id").orderBy("step_no")
    rows = steps.withColumns({"__next": F.lead("activity").over(run), "__last": F.lag("activity").over(run), "__fails": F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(run.rowsBetween(Window.unboundedPreceding, -1))})
    ran = rows.where("coalesce(__fails, 0) = 0")
    return ran.select("saga_id", "step_no", F.when(F.col("ok"), work_address(F.col("__next"))).otherwise(compensation_address(F.col("__last"))).alias("uri")).where("uri is not null")


def fallback(alternatives: DataFrame) -> DataFrame:
    """(saga_id, succeeded, winner, n_tried, n_compensated): alternatives run in order until all steps of one succeed.

    An alternative that fails undoes its own completed steps. winner is null if all fail.
    """
    by_alt = alternatives.groupBy("saga_id", "alt_no").agg(F.bool_and("ok").alias("ok"), F.coalesce(F.min(F.when(~F.col("ok"), F.col("alt_step"))) - 1, F.lit(0)).alias("undone"))
    winner = F.min(F.when(F.col("ok"), F.col("alt_no")))
    out = by_alt.groupBy("saga_id").agg(winner.alias("winner"), F.array_sort(F.collect_list(F.struct("alt_no", "undone"))).alias("alts"))
    tried = F.filter("alts", lambda a: F.col("winner").isNull() | (a["alt_no"] <= F.col("winner")))
    return out.select("saga_id", F.col("winner").isNotNull().alias("succeeded"), "winner", F.size(tried).cast("bigint").alias("n_tried"), F.aggregate(tried, F.lit(0).cast("bigint"), lambda n, a: n + a["undone"].cast("bigint")).alias("n_compensated"))


def parallel(branches: DataFrame) -> DataFrame:
    """(saga_id, succeeded, n_branches, n_done, n_compensated): all branches run; if one fails, every completed step of every
    branch is undone."""
    place = Window.partitionBy("saga_id", "branch_no").orderBy("step_no")
    numbered = branches.withColumn("__i", F.row_number().over(place))
    by_branch = numbered.groupBy("saga_id", "branch_no").agg(F.bool_and("ok").alias("ok"), F.coalesce(F.min(F.when(~F.col("ok"), F.col("__i"))) - 1, F.count("*")).alias("done"))
    out = by_branch.groupBy("saga_id").agg(F.bool_and("ok").alias("succeeded"), F.count("*").alias("n_branches"), F.sum("done").alias("n_done"))
    return out.withColumn("n_compensated", F.when(F.col("succeeded"), 0).otherwise(F.col("n_done")).cast("bigint"))


def deliveries(messages: DataFrame, activities: DataFrame) -> DataFrame:
    """messages (uri, ...) with the activity that accepts them and the direction; compensation addresses are tried first, and
    messages for nobody are left out. activities: one row per name, of any size."""
    back = activities.select("activity", compensation_address(F.col("activity")).alias("uri"), F.lit("backward").alias("direction"))
    forth = activities.select("activity", work_address(F.col("activity")).alias("uri"), F.lit("forward").alias("direction"))
    table = forth.join(back.select("uri"), "uri", "left_anti").unionByName(back).dropDuplicates(["uri"])
    return messages.join(table, "uri")


def resolver(registrations: DataFrame) -> DataFrame:
    """(name, activity): the last registration of each name; empty names are an error."""
    checked = registrations.withColumn("name", F.when(F.coalesce(F.col("name"), F.lit("")) == "", F.raise_error(F.lit("empty activity name")).cast("string")).otherwise(F.col("name")))
    return checked.groupBy("name").agg(F.max_by("activity", "registered_no").alias("activity"))


def wire_names(registrations: DataFrame, activities: DataFrame) -> DataFrame:
    """(activity, name, registered): the name under which an activity travels, the last one registered for it or else its
    own. One that isn't registered can't be read back."""
    named = registrations.groupBy("activity").agg(F.max_by("name", "registered_no").alias("__name"))
    return activities.join(named, "activity", "left").select("activity", F.coalesce("__name", "activity").alias("name"), F.col("__name").isNotNull().alias("registered"))


def unserializable(names: DataFrame, resolver: DataFrame) -> DataFrame:
    """(saga_id, error): the first part of each slip that can't be written, logs before items; names: (saga_id, part, position,
    activity), part being "work log" or "work item" and position counting from 0; resolver: wire_names. An activity travels
    under its own name if none is registered, so only an empty name fails."""
    named = names.join(resolver.select("activity", "name"), "activity", "left")
    return _first_error(named.where(F.coalesce("name", "activity", F.lit("")) == ""), "serialize", F.lit("activity type not registered"))


def unreadable(slips: DataFrame, registrations: DataFrame, key: str = "saga_id") -> DataFrame:
    """(saga_id, error): the first part of each parsed slip (column slip) whose name no activity is registered for."""
    parts = [slips.select(F.col(key).alias("saga_id"), F.lit(part).alias("part"), F.posexplode(f"slip.{of}").alias("position", "x")).select("saga_id", "part", "position", F.col("x.activityTypeName").alias("name")) for part, of in (("work log", "completedWorkLogs"), ("work item", "nextWorkItems"))]
    missing = parts[0].union(parts[1]).join(registrations.select("name").distinct(), "name", "left_anti")
    return _first_error(missing, "deserialize", F.concat(F.lit("activity type not registered: "), "name"))


def _first_error(parts: DataFrame, action: str, reason: Column) -> DataFrame:
    text = F.concat(F.lit(f"cannot {action} "), "part", F.lit(" "), F.col("position").cast("string"), F.lit(": "), reason)
    place = F.struct((F.col("part") == "work item").alias("later"), "position")
    return parts.groupBy("saga_id").agg(F.min_by(text, place).alias("error"))


def performed(steps: DataFrame, work: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]], arguments: str = "arguments") -> DataFrame:
    """steps with ok and undo_ok from each activity's pair of functions (do_work, compensate), both from the arguments column
    to a boolean one. A null counts as a failure; an activity without functions ends the query."""
    unknown = F.raise_error(F.concat(F.lit("no work for activity "), "activity")).cast("boolean")

    def chosen(k: int) -> Column:
        out = F.when(F.lit(False), F.lit(False))
        for name, functions in work.items():
            out = out.when(F.col("activity") == name, F.coalesce(functions[k](F.col(arguments)), F.lit(False)))
        return out.otherwise(unknown)

    return steps.withColumns({"ok": chosen(0), "undo_ok": chosen(1)})


def run_hosts(steps: DataFrame) -> DataFrame:
    """(saga_id, delivery, direction, activity, result): every delivery of every workflow, with compensations that can refuse.

    steps has undo_ok as well. A failed step is not tried again; a compensation that returns false turns the workflow
    forward to the steps still pending, so deliveries are at most twice the steps. Workflows are folded one by one, with
    their steps in an array.
    """
    one = F.struct("step_no", "activity", F.col("ok").alias("ok"), F.col("undo_ok").alias("undo_ok"))
    flows = steps.groupBy("saga_id").agg(F.array_sort(F.collect_list(one)).alias("steps"))
    start = F.struct(F.lit(True).alias("forward"), F.lit(0).alias("next"), F.array().cast("array<int>").alias("logs"), F.array().cast("array<struct<at: int, forward: boolean, result: boolean>>").alias("trace"))

    def deliver(s: Column, _: Column) -> Column:
        last = F.size(s["logs"]) - 1
        at = F.when(s["forward"], F.when(s["next"] < F.size("steps"), s["next"])).otherwise(F.get(s["logs"], last))
        step = F.get(F.col("steps"), at)
        result = F.when(s["forward"], step["ok"]).otherwise(step["undo_ok"])
        logs = F.when(~s["forward"], F.slice(s["logs"], 1, last)).when(result, F.concat(s["logs"], F.array(at))).otherwise(s["logs"])
        row = F.array(F.struct(at.alias("at"), s["forward"].alias("forward"), result.alias("result")))
        moved = F.struct((s["forward"] == result).alias("forward"), (s["next"] + s["forward"].cast("int")).alias("next"), logs.alias("logs"), F.concat(s["trace"], row).alias("trace"))
        return F.when(at.isNull(), s).otherwise(moved)

    trace = F.aggregate(F.sequence(F.lit(1), 2 * F.size("steps")), start, deliver)["trace"]
    rows = flows.select("saga_id", "steps", F.posexplode(trace).alias("n", "t"))
    return rows.select("saga_id", (F.col("n") + 1).cast("bigint").alias("delivery"), F.when(F.col("t.forward"), "forward").otherwise("backward").alias("direction"), F.get("steps", F.col("t.at"))["activity"].alias("activity"), F.col("t.result").alias("result"))


def folded(events: DataFrame, key: str, order: str, start: Column, apply: Callable[[Column, Column], Column], payload: str = "payload") -> DataFrame:
    """(key, state): the left fold of each key's events in order. A key's events must fit in a row, as an aggregate's do."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(payload).alias("p"))))
    return events.groupBy(key).agg(ordered.alias("__events")).select(key, F.aggregate("__events", start, lambda state, e: apply(state, e["p"])).alias("state"))


def summed(events: DataFrame, key: str, step: Column) -> DataFrame:
    """(key, state): the fold whose steps add up, in any order: partial sums before the shuffle, however many events a key has."""
    return events.groupBy(key).agg(F.sum(step).alias("state"))


# The wire form: objects keep the order of their keys, so they travel as texts.
def _object(entries: Column) -> Column:
    """A JSON object from array<struct<key, value>>, values being JSON texts."""
    quoted = lambda k: F.regexp_extract(F.to_json(F.array(k)), r"^\[(.*)\]$", 1)
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), F.coalesce(e["value"], F.lit("null")))), ","), F.lit("}"))


def _listed(items: Column, name: str) -> Column:
    one = lambda x: F.concat(F.lit('{"activityTypeName":'), F.regexp_extract(F.to_json(F.array(x["activity"])), r"^\[(.*)\]$", 1), F.lit(f',"{name}":'), _object(x["entries"]), F.lit("}"))
    return F.concat(F.lit("["), F.array_join(F.transform(items, one), ","), F.lit("]"))


def slip_json(logs: Column, items: Column) -> Column:
    """A routing slip as JSON. Both are array<struct<activity, entries: array<struct<key, value>>>>."""
    return F.concat(F.lit('{"completedWorkLogs":'), _listed(logs, "result"), F.lit(',"nextWorkItems":'), _listed(items, "arguments"), F.lit("}"))


def parse_slip(text: Column) -> Column:
    """struct<slip, error>: missing and null lists are empty, a null object is {}; a missing name or object is an error."""
    whole = F.try_parse_json(text)
    slip = F.from_json(text, SLIP)
    get = lambda v, p: F.try_variant_get(v, p, "variant")

    def wrong(list_name: str, object_name: str) -> Column:
        found = get(whole, f"$.{list_name}")
        items = F.coalesce(F.try_variant_get(whole, f"$.{list_name}", "array<variant>"), F.array().cast("array<variant>"))
        kind = lambda v: F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
        bad_item = lambda v: F.when(kind(get(v, "$.activityTypeName")) != "STRING", 'field "activityTypeName" is not a string').when(get(v, "$.activityTypeName").isNull(), 'missing field "activityTypeName"').when(get(v, f"$.{object_name}").isNull(), f'missing field "{object_name}"').when(~kind(get(v, f"$.{object_name}")).isin("OBJECT", "VOID"), "expected JSON object")
        return F.when(~kind(found).isin("ARRAY", "VOID"), f'field "{list_name}" is not an array').otherwise(F.get(F.filter(F.transform(items, bad_item), lambda e: e.isNotNull()), 0))

    error = F.when(whole.isNull(), "malformed JSON").when(~F.schema_of_variant(whole).startswith("OBJECT"), "expected JSON object for routing slip").otherwise(F.coalesce(wrong("completedWorkLogs", "result"), wrong("nextWorkItems", "arguments")))
    fill = lambda items, name: F.transform(F.coalesce(items, F.array().cast(f"array<struct<activityTypeName: string, {name}: string>>")), lambda x: F.struct(x["activityTypeName"].alias("activityTypeName"), F.coalesce(x[name], F.lit("{}")).alias(name)))
    full = F.struct(fill(slip["completedWorkLogs"], "result").alias("completedWorkLogs"), fill(slip["nextWorkItems"], "arguments").alias("nextWorkItems"))
    return F.struct(F.when(error.isNull(), full).alias("slip"), error.alias("error"))
