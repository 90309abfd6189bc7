"""Commands over a store: ``python -m coffer.cli --store DIR COMMAND ...``.

Listings print a table, or JSON lines with ``--json``; nulls print as blanks.
Commands that need a bank, an enrichment service or a sink take the import
path of a client (``module:factory``).
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coffer.functions import currency, scalars
from coffer.operators import accounts, ingest, lookup, merchants, rates, search, triggers
from coffer.operators.lineage import cut
from coffer.operators.store import Store, shown
from coffer.sources import bank, enrichment, sinks

Command = Callable[[SparkSession, Store, argparse.Namespace], DataFrame | None]


def _rows(spark: SparkSession, args: argparse.Namespace, names: str) -> DataFrame:
    """One row of arguments, by their names."""
    given = {n: getattr(args, n) for n in names.split()}
    return spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in given.items()))


def _add(table: str, names: str) -> Command:
    return lambda spark, store, args: store.insert(table, _rows(spark, args, names), [F.lit(0)])


def _list(table: str, order: str = "id") -> Command:
    return lambda spark, store, args: shown(store.read(table), table).orderBy(order)


def _sinks(args: argparse.Namespace) -> dict:
    return {"budget": sinks.client_sink(args.client)} if args.client else {}


def transactions_list(spark: SparkSession, store: Store, args: argparse.Namespace) -> DataFrame:
    rows = store.read("transactions")
    if args.account_id is not None:
        rows = lookup.transactions_of_account(rows, args.account_id)
    rows = search.with_merchant(rows, store.read("merchants"))
    if args.search:
        rows = rows.where(search.mentions(rows, args.search))
    return shown(search.newest_transactions(rows, args.limit), "transactions")


def _accounts(store: Store, args: argparse.Namespace) -> DataFrame:
    held = store.read("accounts")
    if args.account_id is not None:
        lookup.require(held, id=args.account_id)
        held = lookup.find(held, id=args.account_id)
    return accounts.with_source(held, bank.KNOWN_SOURCES)[0]


def _fetch(spark: SparkSession, store: Store, args: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    if args.landed:
        return bank.read_transactions(spark, args.landed, date_to=args.date_to), spark.createDataFrame([], "account_id long, error string")
    held = _accounts(store, args)
    return bank.fetch(spark, held, ingest.lookback(held, store.read("transactions")), args.bank, args.date_to)


def transactions_import(spark: SparkSession, store: Store, args: argparse.Namespace) -> DataFrame:
    wire, errors = _fetch(spark, store, args)
    done = ingest.import_batch(store, wire, errors)

    def finish(rows: DataFrame) -> None:
        known = merchants.enrich(store, rows, enrichment.client_enricher(args.enricher)) if args.enricher else rows
        triggers.dispatch(store, known, _sinks(args))

    ingest.deliver(store, finish)
    return done.status.orderBy("account_id")


def transactions_fetch(spark: SparkSession, store: Store, args: argparse.Namespace) -> DataFrame:
    return ingest.canonical(_fetch(spark, store, args)[0])


def transactions_create_trigger(spark: SparkSession, store: Store, args: argparse.Namespace) -> DataFrame:
    lookup.require(store.read("transactions"), id=args.transaction_id)
    return triggers.dispatch(store, lookup.find(store.read("transactions"), id=args.transaction_id), _sinks(args))


def transactions_enrich(spark: SparkSession, store: Store, args: argparse.Namespace) -> DataFrame:
    rows = lookup.find(store.read("transactions"), id=args.transaction_id)
    return merchants.enrich(store, rows, enrichment.client_enricher(args.enricher))


def assign_merchants(spark: SparkSession, store: Store, args: argparse.Namespace) -> DataFrame:
    return merchants.backfill(store, enrichment.client_enricher(args.enricher), args.limit)


def triggers_add(spark: SparkSession, store: Store, args: argparse.Namespace) -> DataFrame:
    lookup.require(store.read("users"), id=args.user_id)
    lookup.require(store.read("functions"), id=args.function_id)
    return triggers.add_trigger(store, _rows(spark, args, "event name filter params user_id function_id"))


def triggers_run(spark: SparkSession, store: Store, args: argparse.Namespace) -> DataFrame:
    rows = store.read("transactions")
    if args.transaction_id is not None:
        rows = lookup.find(rows, id=args.transaction_id)
    lookup.require(store.read("triggers"), id=args.trigger_id)
    found = triggers.manual_run(rows, lookup.find(store.read("triggers"), id=args.trigger_id), args.limit)
    asked = cut(triggers.calls(found, store.read("functions")).withColumn("payload", F.to_json(F.struct("trigger_id", F.col("transaction.external_id").alias("external_id")))))
    return sinks.client_sink(args.client)(asked).select("payload", "status", scalars.joined(F.col("console"), "; ").alias("console"))


def update_balances(spark: SparkSession, store: Store, args: argparse.Namespace) -> DataFrame:
    answers = bank.fetch_balances(_accounts(store, args), args.bank)[0] if args.bank else bank.read_balances(spark, args.landed)
    return accounts.refresh_balances(store, answers)


def _landed_details(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    held = bank.read_details(spark, args.landed)
    named = held.withColumns({"institution_name": F.lit(args.institution), "user_id": F.lit(args.user_id).cast("long")})
    return named.withColumn("source_id", F.coalesce(F.col("details.resourceId"), F.col("account_id").cast("string")))


def populate_details(spark: SparkSession, store: Store, args: argparse.Namespace) -> None:
    answers = bank.fetch_details(_accounts(store, args), args.bank)[0] if args.bank else bank.read_details(spark, args.landed)
    accounts.populate_details(store, answers)


def accounts_add(spark: SparkSession, store: Store, args: argparse.Namespace) -> DataFrame:
    lookup.require(store.read("users"), id=args.user_id)
    return accounts.add_accounts(store, _landed_details(spark, args), bank.KNOWN_SOURCES[0])


def accounts_relink(spark: SparkSession, store: Store, args: argparse.Namespace) -> DataFrame:
    return accounts.relink(store, _landed_details(spark, args))


def institutions(spark: SparkSession, store: Store, args: argparse.Namespace) -> DataFrame:
    if args.bank:
        rows = bank.fetch_institutions(spark.createDataFrame([(args.country, "{}")], "key string, config string"), args.bank)[0]
        return rows.where(F.col("id") == args.institution) if args.institution else rows
    return bank.read_institutions(spark, args.landed, args.country, args.institution)


def rates_update(spark: SparkSession, store: Store, args: argparse.Namespace) -> None:
    if args.client:
        answers = bank.fetch_rates(spark.createDataFrame([(args.base or currency.DEFAULT, "{}")], "key string, config string"), args.client)[0]
    else:
        answers = bank.read_rates(spark, args.landed, args.base)
    rates.refresh(store, answers)


#: Command words, what they do, and their options.
COMMANDS: dict[str, tuple[Command, str]] = {
    "users list": (_list("users"), ""),
    "users add": (_add("users", "name email"), "name! email!"),
    "accounts list": (_list("accounts"), ""),
    "accounts add": (accounts_add, "landed! institution! user_id#!"),
    "accounts fetch": (transactions_fetch, "account_id# bank landed date_to"),
    "accounts populate-details": (populate_details, "account_id# bank landed"),
    "accounts update-balances": (update_balances, "account_id# bank landed"),
    "accounts relink": (accounts_relink, "landed! institution! user_id#!"),
    "institutions list": (institutions, "bank landed country institution"),
    "functions list": (_list("functions"), ""),
    "functions add": (_add("functions", "name function_type source user_id"), "name! function_type! source! user_id#!"),
    "triggers list": (_list("triggers"), ""),
    "triggers add": (triggers_add, "event! name! filter! params! user_id#! function_id#!"),
    "triggers log": (_list("trigger_log"), ""),
    "triggers run": (triggers_run, "trigger_id#! transaction_id# client! limit=50"),
    "transactions list": (transactions_list, "account_id# search limit=100"),
    "transactions import": (transactions_import, "account_id# bank landed date_to enricher client"),
    "transactions create-trigger": (transactions_create_trigger, "transaction_id#! client"),
    "transactions enrich": (transactions_enrich, "transaction_id#! enricher!"),
    "transactions assign-merchants": (assign_merchants, "enricher! limit=100"),
    "merchants list": (_list("merchants"), ""),
    "rates update": (rates_update, "client landed base"),
    "rates list": (lambda spark, store, args: rates.listed(store.read("exchange_rates")).orderBy("base_code", "code"), ""),
}


def parser() -> argparse.ArgumentParser:
    """``#`` marks a number, ``!`` what must be given, ``=`` a default."""
    top = argparse.ArgumentParser(prog="coffer")
    top.add_argument("--store", required=True)
    top.add_argument("--json", action="store_true")
    top.add_argument("--rows", type=int, default=10_000, help="print so many rows at most; 0: all")
    groups: dict[str, argparse._SubParsersAction] = {}
    first = top.add_subparsers(required=True)
    for words, (run, options) in COMMANDS.items():
        group, name = words.split()
        if group not in groups:
            groups[group] = first.add_parser(group).add_subparsers(required=True)
        command = groups[group].add_parser(name)
        command.set_defaults(run=run)
        for option in options.split():
            word, _, default = option.partition("=")
            number = "#" in word or bool(default)
            command.add_argument("--" + word.rstrip("#!").replace("_", "-"), dest=word.rstrip("#!"), type=int if number else str, required="!" in word, default=int(default) if default else None)
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """Run a command and print its rows; returns the lines."""
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{args.store}/.checkpoints")
    found = args.run(spark, Store(spark, args.store), args)
    if found is None:
        return []
    if args.rows:
        found = found.limit(args.rows)
    if args.json:
        lines = [json.dumps(json.loads(line), ensure_ascii=False) for line in found.toJSON().collect()]
    else:
        texts = found.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in found.columns]).collect()
        lines = [" | ".join(found.columns), *[" | ".join(r) for r in texts]]
    print("\n".join(lines))
    return lines


if __name__ == "__main__":
    main()
