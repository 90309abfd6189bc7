"""User-defined triggers: validation, matching, dispatch to sinks, and the log."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.functions import scalars
from coffer.operators.lineage import cut
from coffer.operators.ranking import newest_per_key
from coffer.operators.store import Store

CREATED = "transaction_created"


class InvalidTrigger(ValueError):
    """A filter or parameters that cannot be read."""


def checked(triggers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Triggers with ``predicates`` and ``settings`` parsed, and those to reject with ``reason``: an unknown predicate, broken JSON, or parameters that are no flat object."""
    reason = F.when(~scalars.filter_is_known(F.col("filter")), "unknown filter").when(scalars.parse_params(F.col("params")).isNull(), "bad parameters")
    marked = triggers.withColumn("reason", reason)
    good = marked.where(F.col("reason").isNull()).drop("reason").withColumns({"predicates": scalars.parse_filter(F.col("filter")), "settings": scalars.parse_params(F.col("params"))})
    return good, marked.where(F.col("reason").isNotNull())


def add_trigger(store: Store, rows: DataFrame) -> DataFrame:
    """Store triggers (event, name, filter, params, user_id, function_id; JSON encoded once). Raises InvalidTrigger if one cannot be read."""
    bad = checked(rows)[1].select("name", "reason").first()
    if bad is not None:
        raise InvalidTrigger(f"{bad['name']}: {bad['reason']}")
    return store.insert("triggers", rows, [F.col("user_id"), F.col("name"), F.col("filter"), F.col("params")])


def matched(transactions: DataFrame, triggers: DataFrame, event: str = CREATED) -> DataFrame:
    """Each transaction with each trigger of its user and the event whose predicates all hold: trigger_id, function_id, settings and the transaction as a struct.

    An equi-join on the user, with the predicates as its condition.
    """
    wanted = checked(triggers)[0].where(F.col("event") == event)
    t = wanted.select(F.col("id").alias("trigger_id"), F.col("user_id").alias("_user"), "function_id", "predicates", "settings")
    rows = transactions.select(F.struct(*transactions.columns).alias("transaction"))
    on = (F.col("transaction.user_id") == F.col("_user")) & scalars.filter_matches(F.col("predicates"), F.col("transaction.account_id"))
    return rows.join(t, on).select("trigger_id", "function_id", "settings", "transaction")


def manual_run(transactions: DataFrame, trigger: DataFrame, n: int = 50) -> DataFrame:
    """What running one trigger by hand covers: the newest ``n`` of each account that its predicates name, and then all predicates. No predicates: nothing. The event does not count."""
    t = checked(trigger)[0].select(F.col("id").alias("trigger_id"), F.col("user_id").alias("_user"), "function_id", "predicates", "settings")
    named = t.select(F.explode("predicates").alias("p")).select(F.explode("p.Account").alias("account_id")).distinct()
    rows = newest_per_key(transactions.join(named, "account_id", "left_semi"), "account_id", "booking_date", n)
    rows = rows.select(F.struct(*transactions.columns).alias("transaction"))
    on = (F.col("transaction.user_id") == F.col("_user")) & scalars.filter_matches(F.col("predicates"), F.col("transaction.account_id"))
    return rows.join(t, on).select("trigger_id", "function_id", "settings", "transaction")


def calls(found: DataFrame, functions: DataFrame) -> DataFrame:
    """Matches with their function's type and source."""
    return found.join(functions.select(F.col("id").alias("function_id"), "function_type", "source"), "function_id")


#: From calls to the same rows with ``status`` and ``console`` (array of text) added.
Sink = Callable[[DataFrame], DataFrame]


def dispatch(store: Store, transactions: DataFrame, sinks: Mapping[str, Sink], event: str = CREATED) -> DataFrame:
    """Run the triggers of new transactions and log each call; returns the log rows.

    A call that the log has as done is not made again, so a batch that is
    repeated after a crash does no harm beyond calls that were under way. Calls
    of a type without a sink are logged as failed. One sink's failure is its rows'
    status, not the batch's.
    """
    found = calls(matched(transactions, store.read("triggers"), event), store.read("functions"))
    payload = F.to_json(F.struct(F.col("trigger_id"), F.col("transaction.account_id").alias("account_id"), F.col("transaction.external_id").alias("external_id")))
    done = store.read("trigger_log").where("status = 'ok'").select("payload").distinct()
    todo = cut(found.withColumn("payload", payload).join(done, "payload", "left_anti"))
    parts = [sink(todo.where(F.col("function_type") == kind)) for kind, sink in sorted(sinks.items())]
    unknown = todo.where(~F.col("function_type").isin(*sinks)) if sinks else todo
    parts.append(unknown.withColumns({"status": F.lit("failed"), "console": F.array(F.concat(F.lit("no sink for "), "function_type"))}))
    rows = None
    for p in parts:
        p = p.select("payload", F.to_json("console").alias("console"), "status", F.col("transaction.user_id").alias("user_id"), "trigger_id")
        rows = p if rows is None else rows.unionByName(p)
    return store.insert("trigger_log", cut(rows), [F.col("trigger_id"), F.col("payload")])
