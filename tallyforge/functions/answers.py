"""The schemas of a model's answers and of requests to it, and defaults for what an answer leaves out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import checked_date, parse_date
from .json import json_of, parse_object
from .schema import Field, Schema
from .text import bound

_TEXT = lambda name, **more: Field(name, "string", **more)
_NUMBER = lambda name, **more: Field(name, "number", **more)
_DAY = ("no date", lambda text: checked_date(text).isNotNull())

#: What answers and requests may hold.
DIRECTIONS = ("credit", "debit", "income", "expense", "transfer")
INSIGHT_TYPES = ("category_trend", "day_pattern", "merchant_insight", "anomaly", "budget_alert", "period_comparison", "savings_opportunity")
SEVERITIES = ("info", "warning", "positive")
SOURCES = ("rule", "ai", "keyword")

CATEGORIZE_ROW = (
    _TEXT("id", shortest=1), _TEXT("description", needed=False), _TEXT("merchant", needed=False), Field("amount", "any", check=("must be a number", lambda text: F.trim(text).rlike(r"^[-+]?(\d+\.?\d*|\.\d+)"))),
    _TEXT("type", one_of=DIRECTIONS), _TEXT("sourceType", needed=False, one_of=("bank", "credit_card")), _TEXT("transactionSubType", needed=False), _TEXT("categoryId", needed=False),
)
CATEGORIZE_REQUEST = Schema((Field("transactions", "array", fields=CATEGORIZE_ROW), _TEXT("provider", needed=False, one_of=("ollama", "lmstudio")), _TEXT("baseUrl", needed=False), _TEXT("model", needed=False, shortest=1)))
CATEGORIZE_RESULT = (_TEXT("id"), _TEXT("category"), _NUMBER("confidence", least=0, most=1), _TEXT("source", one_of=SOURCES))
CATEGORIZE_RESPONSE = Schema((Field("results", "array", fields=CATEGORIZE_RESULT),))
INSIGHT = (_TEXT("type", one_of=INSIGHT_TYPES), _TEXT("title", longest=100), _TEXT("description", longest=500), _TEXT("severity", one_of=SEVERITIES), _TEXT("category", needed=False), Field("data", "object", needed=False))
INSIGHTS_RESPONSE = Schema((Field("insights", "array", fields=INSIGHT),))
_FLOWS = (_NUMBER("income", needed=False), _NUMBER("expenses", needed=False))
_COUNTED = Field("", "object", fields=(_NUMBER("total", needed=False), Field("count", "integer", needed=False, least=0)))
ANALYTICS = (
    Field("totalTransactions", "integer", needed=False, least=0), Field("dateRange", "object", needed=False, fields=(_TEXT("start"), _TEXT("end"))), *[Field(n, "object", needed=False, fields=_FLOWS) for n in ("currentMonth", "previousMonth", "threeMonthAvg")],
    Field("byCategory", "object", needed=False, each=_COUNTED), Field("byDayOfWeek", "object", needed=False, each=_COUNTED), Field("byMonth", "object", needed=False, each=Field("", "object", fields=_FLOWS)),
    Field("byCategoryByMonth", "object", needed=False, each=Field("", "object", each=_NUMBER(""))), Field("topCategories", "array", needed=False, fields=(_TEXT("category"), _NUMBER("total"), _NUMBER("percentage"))),
    Field("topMerchants", "array", needed=False, fields=(_TEXT("name"), _NUMBER("total"), Field("count", "integer", least=0))), Field("anomalies", "array", needed=False, fields=(_TEXT("description"), _NUMBER("amount"), _NUMBER("zScore", needed=False))),
)
INSIGHTS_REQUEST = Schema((Field("analytics", "object", fields=ANALYTICS), _TEXT("provider", needed=False, one_of=("ollama", "lmstudio")), _TEXT("model", needed=False, shortest=1), Field("currency", "object", fields=(_TEXT("code", shortest=3, longest=3), _TEXT("symbol"), _TEXT("name")))))
_MONEY = ("totalDue", "minimumDue", "creditLimit", "availableCredit", "previousBalance", "paymentsReceived", "purchasesAndCharges")
CARD_SUMMARY = Schema(
    (*[_TEXT(n, needed=False, check=_DAY) for n in ("statementDate", "paymentDueDate")], *[_NUMBER(n, needed=False, least=0) for n in _MONEY]),
    (
        ("total due below minimum due", lambda n: n("totalDue") < n("minimumDue")),
        ("available credit beyond the limit", lambda n: n("availableCredit") > n("creditLimit")),
        ("previous balance beyond the limit", lambda n: n("previousBalance") > n("creditLimit")),
    ),
)
BANK_SUMMARY = Schema(tuple(_TEXT(n, needed=False, check=_DAY) for n in ("statementDate", "statementPeriodStart", "statementPeriodEnd")))
#: A row of an extracted statement; days that are no dates are only warned of.
EXTRACTED_ROW = (_TEXT("date", shortest=1), _TEXT("description", needed=False), _NUMBER("amount", above=0), _TEXT("type", needed=False))
EXTRACTED = Schema((Field("transactions", "array", fields=EXTRACTED_ROW),))


def insights(text: Column) -> Column:
    """Insights (type, title, description, severity, category) of an answer; unknown types are trends, unknown severities
    infos, and those without a title or description are left out."""
    found = parse_object(text, "insights array<struct<type:string,title:string,description:string,severity:string,category:string>>")["insights"]
    some = F.filter(F.coalesce(found, F.array().cast("array<struct<type:string,title:string,description:string,severity:string,category:string>>")), lambda x: (F.coalesce(x["title"], F.lit("")) != "") & (F.coalesce(x["description"], F.lit("")) != ""))
    known = lambda x, name, words, put: F.when(x[name].isin(*words), x[name]).otherwise(put).alias(name)
    return F.transform(some, lambda x: F.struct(known(x, "type", INSIGHT_TYPES, "category_trend"), x["title"].alias("title"), x["description"].alias("description"), known(x, "severity", SEVERITIES, "info"), x["category"].alias("category")))


def warned_dates(text: Column) -> Column:
    """Whether a row's day is given and no date in any known way."""
    return bound(text, lambda t: (F.trim(t) != "") & parse_date(t).isNull())


__all__ = ["ANALYTICS", "BANK_SUMMARY", "CARD_SUMMARY", "CATEGORIZE_REQUEST", "CATEGORIZE_RESPONSE", "EXTRACTED", "INSIGHTS_REQUEST", "INSIGHTS_RESPONSE", "insights", "json_of", "warned_dates"]
