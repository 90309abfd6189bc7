"""Scalar expressions over transactions, accounts, merchants and their JSON columns. All are built-in functions of Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coffer import schemas

#: Rows booked up to this day keep the older identity; changing it would import them twice.
IDENTITY_CUTOVER = "2024-02-20"

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def blank(c: Column) -> Column:
    """The text, or '' for null."""
    return F.coalesce(c, F.lit(""))


def content_id(given: Column, booking_date: Column, amount: Column, currency: Column, remittance: Column, cutover: str = IDENTITY_CUTOVER) -> Column:
    """The bank's id if it gives one, else a SHA-256 of the content.

    Up to the cutover, and without a date, two payments of a day with the same
    text collide; the form is kept so that a new import finds the old rows.
    """
    day, text = blank(F.date_format(booking_date, "yyyy-MM-dd")), blank(remittance)
    old = F.concat(day, F.lit(":"), day, F.lit(":"), text, F.lit(":[object Object]"))
    sum_ = F.when(amount.isNull(), F.lit("0EUR")).otherwise(amount_text(amount, blank(currency)))
    new = F.concat(day, F.lit(":"), sum_, F.lit(":"), text)
    form = F.when(booking_date > F.to_date(F.lit(cutover)), new).otherwise(old)
    return F.coalesce(given, F.sha2(form, 256))


def amount_text(amount: Column, currency: Column) -> Column:
    """Amount followed by currency, nothing between."""
    return F.concat(amount, currency)


def exchange_text(rate: Column, source: Column, target: Column) -> Column:
    """``source -> target rate``; a missing target is blank."""
    return F.concat(source, F.lit(" -> "), blank(target), F.lit(" "), rate)


def party_text(account: Column) -> Column:
    """The first of a party's numbers: IBAN, BBAN, masked card, or ''."""
    return F.coalesce(account["iban"], account["bban"], account["maskedPan"], F.lit(""))


def account_number(details: Column) -> Column:
    """The first of an account's numbers, or ''."""
    return F.coalesce(*[details[k] for k in ("iban", "bban", "bic", "pan", "maskedPan")], F.lit(""))


def description(creditor: Column, debtor: Column, remittance: Column) -> Column:
    """Creditor, debtor and text with one space between, also where one is missing: the blanks are part of what enrichment has always been sent."""
    return F.concat(blank(creditor), F.lit(" "), blank(debtor), F.lit(" "), blank(remittance))


def payee(creditor: Column, debtor: Column) -> Column:
    return F.coalesce(creditor, debtor, F.lit(""))


def parse_number(text: Column, kind: str = "float") -> Column:
    """A plain decimal number as ``kind``, else null: blanks and Java suffixes such as ``1f`` do not count."""
    return F.when(text.rlike(_NUMBER), text.try_cast(kind))


def amount_or_zero(text: Column, kind: str = "float") -> Column:
    return F.coalesce(parse_number(text, kind), F.lit(0.0).cast(kind))


def direction(amount: Column) -> Column:
    """Below zero outgoing; zero counts as incoming."""
    return F.when(amount < 0, "outgoing").otherwise("incoming")


def money(text: Column) -> Column:
    """Decimal value of a money text, null if it is no number."""
    return F.when(text.rlike(_NUMBER), text.try_cast(T.DecimalType(18, 4)))


def address_text(address: Column) -> Column:
    """line1, city, state, postal code and country with a comma and a space between, missing parts blank."""
    parts = [blank(address[k]) for k in ("line1", "city", "state", "postalCode", "country")]
    return F.concat(*[x for p in parts for x in (F.lit(", "), p)][1:])


def host_or_name(website: Column, name: Column) -> Column:
    """A URL's host; the name where there is no URL or it has no scheme."""
    return F.coalesce(F.try_parse_url(website, F.lit("HOST")), name)


def naive_utc(t: Column) -> Column:
    """A point in time as UTC without zone; the session's zone must be UTC."""
    return t.cast("timestamp_ntz")


def lookback_start(newest: Column, days: int = 7) -> Column:
    """First day to ask for again, null for the full history."""
    return F.date_sub(newest, days)


def parse_location(json: Column) -> Column:
    """A location, null if the JSON is absent, ``null``, broken, or has a field of the wrong type."""
    watched = T.StructType([*schemas.LOCATION.fields, T.StructField("_bad", T.StringType())])
    read = F.from_json(json, watched, {"columnNameOfCorruptRecord": "_bad"})
    return F.when(read.isNotNull() & read["_bad"].isNull(), F.struct(*[read[f.name].alias(f.name) for f in schemas.LOCATION.fields]))


def location_json(location: Column) -> Column:
    """Text to store; a missing location is the JSON ``null``."""
    return F.coalesce(F.to_json(location), F.lit("null"))


def parse_filter(json: Column) -> Column:
    return F.from_json(json, schemas.FILTER)


def filter_is_known(json: Column) -> Column:
    """Has every predicate a form that ``filter_matches`` knows, and is the JSON whole?"""
    parsed = parse_filter(json)
    return F.coalesce(parsed.isNotNull() & F.forall(parsed, lambda p: p.isNotNull() & p["Account"].isNotNull() & F.forall(p["Account"], lambda a: a.isNotNull())), F.lit(False))


def filter_matches(parsed: Column, account_id: Column) -> Column:
    """Do all predicates hold? An empty list holds for every row."""
    return F.forall(parsed, lambda p: F.array_contains(p["Account"], account_id))


def parse_params(json: Column) -> Column:
    """A trigger's parameters, null if they are no flat JSON object."""
    return F.from_json(json, schemas.PARAMS)


def parse_console(json: Column) -> Column:
    """A log's lines; broken or missing JSON is an empty list."""
    return F.coalesce(F.from_json(json, schemas.CONSOLE), F.array().cast("array<string>"))


def joined(labels: Column, sep: str = ",") -> Column:
    return F.array_join(labels, sep)


def like_pattern(term: str) -> str:
    """A search term as a LIKE pattern: % and _ are wildcards, a backslash is itself unless it quotes one of them."""
    out, i = [], 0
    while i < len(term):
        if term[i] == "\\":
            quoted = term[i + 1 : i + 2]
            out.append("\\" + quoted if quoted and quoted in "%_\\" else "\\\\")
            i += 2 if quoted and quoted in "%_\\" else 1
        else:
            out.append(term[i])
            i += 1
    return "%" + "".join(out) + "%"
