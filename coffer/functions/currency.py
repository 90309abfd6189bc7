"""ISO 4217 currencies: a strict and a lenient reading, and the countries that use one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Active ISO 4217 codes with ISO 3166 codes of the countries that use them, fixed values.
CURRENCIES = """
AED AE;AFN AF;ALL AL;AMD AM;AOA AO;ARS AR;AUD AU KI NR TV;AWG AW;AZN AZ;BAM BA;BBD BB;BDT BD;BGN BG;BHD BH;BIF BI;BMD BM;BND BN;BOB BO;BRL BR;BSD BS;BTN BT;BWP BW;BYN BY;BZD BZ
CAD CA;CDF CD;CHF CH LI;CLP CL;CNY CN;COP CO;CRC CR;CUP CU;CVE CV;CZK CZ;DJF DJ;DKK DK FO GL;DOP DO;DZD DZ;EGP EG;ERN ER;ETB ET
EUR AD AT BE CY DE EE ES FI FR GR HR IE IT LT LU LV MC MT NL PT SI SK SM VA;FJD FJ;FKP FK;GBP GB GG IM JE;GEL GE;GHS GH;GIP GI;GMD GM;GNF GN;GTQ GT;GYD GY
HKD HK;HNL HN;HTG HT;HUF HU;IDR ID;ILS IL PS;INR IN BT;IQD IQ;IRR IR;ISK IS;JMD JM;JOD JO;JPY JP;KES KE;KGS KG;KHR KH;KMF KM;KPW KP;KRW KR;KWD KW;KYD KY;KZT KZ
LAK LA;LBP LB;LKR LK;LRD LR;LSL LS;LYD LY;MAD MA EH;MDL MD;MGA MG;MKD MK;MMK MM;MNT MN;MOP MO;MRU MR;MUR MU;MVR MV;MWK MW;MXN MX;MYR MY;MZN MZ
NAD NA;NGN NG;NIO NI;NOK NO BV SJ;NPR NP;NZD NZ CK NU PN TK;OMR OM;PAB PA;PEN PE;PGK PG;PHP PH;PKR PK;PLN PL;PYG PY;QAR QA;RON RO;RSD RS;RUB RU;RWF RW
SAR SA;SBD SB;SCR SC;SDG SD;SEK SE;SGD SG;SHP SH;SLE SL;SOS SO;SRD SR;SSP SS;STN ST;SVC SV;SYP SY;SZL SZ;THB TH;TJS TJ;TMT TM;TND TN;TOP TO;TRY TR;TTD TT;TWD TW;TZS TZ
UAH UA;UGX UG;USD US AS EC FM GU MH PR PW TL;UYU UY;UZS UZ;VED VE;VES VE;VND VN;VUV VU;WST WS;XAF CM CF CG GA GQ TD;XCD AG DM GD KN LC VC;XOF BJ BF CI GW ML NE SN TG;XPF NC PF WF
YER YE;ZAR ZA;ZMW ZM;ZWG ZW
"""
USED_BY = {code: countries for code, *countries in (entry.split() for entry in CURRENCIES.replace("\n", ";").split(";") if entry)}
DEFAULT = "USD"


def is_currency(code: Column) -> Column:
    """Is this a known code? Null: null."""
    return code.isin(*USED_BY)


def strict_currency(code: Column) -> Column:
    """The code, or null where it is unknown."""
    return F.when(is_currency(code), code)


def currency_or_usd(code: Column) -> Column:
    """The code, or USD where it is unknown; null stays null."""
    return F.when(code.isNotNull(), F.coalesce(strict_currency(code), F.lit(DEFAULT)))


def currency_table(spark: SparkSession) -> DataFrame:
    """code, countries and the first country of each currency; of fixed size, so safe to broadcast."""
    rows = [(code, countries, countries[0] if countries else None) for code, countries in USED_BY.items()]
    return spark.createDataFrame(rows, "code string, countries array<string>, first_country string")


def first_country(code: Column) -> Column:
    """The first country that uses a currency, or null."""
    pairs = [F.lit(x) for code_, countries in USED_BY.items() if countries for x in (code_, countries[0])]
    return F.try_element_at(F.create_map(*pairs), code)
