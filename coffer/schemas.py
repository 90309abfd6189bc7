"""Schemas of stored tables, of wire records and of JSON columns.

Unsigned 32-bit ids are longs, money is kept as the text that the bank sent,
and times are UTC without a zone. Nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "text": T.StringType(), "float": T.FloatType(), "double": T.DoubleType(), "date": T.DateType(), "time": T.TimestampNTZType(), "utc": T.TimestampType(), "map": T.MapType(T.StringType(), T.StringType()), "rates": T.MapType(T.StringType(), T.DoubleType()), "texts": T.ArrayType(T.StringType())}


def struct(spec: str, **nested: T.DataType) -> T.StructType:
    """A schema from ``name:kind`` words; a question mark after the name allows null; kinds not listed come from ``nested``."""
    fields = []
    for word in spec.split():
        name, _, kind = word.partition(":")
        fields.append(T.StructField(name.rstrip("?"), nested.get(kind) or _KINDS[kind], name.endswith("?")))
    return T.StructType(fields)


LOCATION = struct("address?:text city?:text state?:text postcode?:text country?:text latitude?:float longitude?:float google_maps_url?:text apple_maps_url?:text store_number?:float")

ACCOUNT = struct(
    "id:long name:text account_type:text currency:text product?:text cash_account_type?:text status:text details:text balance?:float owner_name?:text icon?:text"
    " institution_name:text source_id:text user_id:long created_at?:time updated_at?:time config?:text number?:text"
)
TRANSACTION = struct(
    "id:long external_id:text creditor_name?:text debtor_name?:text remittance_information?:text booking_date:date booking_datetime?:time transaction_amount:text"
    " transaction_amount_currency:text proprietary_bank_transaction_code?:text currency_exchange_rate?:text currency_exchange_source_currency?:text"
    " currency_exchange_target_currency?:text merchant_id?:long account_id:long user_id:long created_at?:time updated_at?:time"
)
MERCHANT = struct("id:long name:text logo_url?:text location?:text location_structured?:text labels?:texts external_id?:text website?:text created_at?:time")
TRIGGER = struct("id:long event:text name:text filter:text params:text user_id:long function_id:long created_at?:time updated_at?:time")
FUNCTION = struct("id:long name:text function_type:text source:text user_id:long created_at?:time updated_at?:time")
TRIGGER_LOG = struct("id:long payload:text console?:text status:text user_id:long trigger_id:long created_at?:time updated_at?:time")
USER = struct("id:long name:text email:text password?:text created_at?:time updated_at?:time")
EXCHANGE_RATE = struct("base_code:text conversion_rates:rates last_update:time")
#: Up to which transaction triggers have been run.
DELIVERY = struct("id:long created_at?:time")

TABLES = {"accounts": ACCOUNT, "transactions": TRANSACTION, "merchants": MERCHANT, "triggers": TRIGGER, "functions": FUNCTION, "trigger_log": TRIGGER_LOG, "users": USER, "exchange_rates": EXCHANGE_RATE, "deliveries": DELIVERY}
#: Columns that no output to a user shows.
HIDDEN = {"users": ("password",), "accounts": ("source_id", "user_id"), "transactions": ("user_id",)}

# JSON columns.
FILTER = T.ArrayType(T.StructType([T.StructField("Account", T.ArrayType(T.LongType()))]))
PARAMS = T.MapType(T.StringType(), T.StringType())
CONSOLE = T.ArrayType(T.StringType())

# Wire records of the bank source. Keys are the provider's.
_AMOUNT = struct("amount?:text currency?:text")
_PARTY = struct("iban?:text bban?:text maskedPan?:text")
_EXCHANGE = struct("exchangeRate?:text sourceCurrency?:text targetCurrency?:text")
WIRE_TRANSACTION = struct(
    "transactionId?:text debtorName?:text debtorAccount?:party creditorAccount?:party transactionAmount?:amount bankTransactionCode?:text bookingDate?:date bookingDateTime?:utc"
    " valueDate?:date remittanceInformationUnstructured?:text proprietaryBankTransactionCode?:text creditorName?:text currencyExchange?:exchange",
    party=_PARTY,
    amount=_AMOUNT,
    exchange=_EXCHANGE,
)
WIRE_DETAILS = struct("resourceId?:text displayName?:text iban?:text maskedPan?:text pan?:text bic?:text bban?:text currency?:text product?:text cashAccountType?:text ownerName?:text status?:text details?:text")
WIRE_BALANCES = T.ArrayType(struct("balanceAmount?:amount balanceType?:text referenceDate?:date", amount=_AMOUNT))
INSTITUTION = struct("id:text name:text bic?:text transaction_total_days?:text countries?:texts logo?:text")

#: A canonical transaction, as every source gives it.
SOURCE_TRANSACTION = struct(
    "external_id:text creditor_name?:text debtor_name?:text remittance_information?:text booking_date?:date booking_datetime?:time transaction_amount?:text"
    " transaction_amount_currency?:text proprietary_bank_transaction_code?:text currency_exchange_rate?:text currency_exchange_source_currency?:text currency_exchange_target_currency?:text"
)
#: What an enrichment service knows of a merchant.
NEW_MERCHANT = struct("name:text logo_url?:text location?:text location_structured?:location labels?:texts external_id?:text website?:text", location=LOCATION)
