"""Text functions as columns: similarities, merchant names and keys, signatures, clean-ups."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Suffixes of company and billing names, removed in this order.
NAME_SUFFIXES = [
    "pvt ltd", "private limited", "ltd", "limited", "inc", "incorporated", "corp", "corporation", "co", "company", "llc", "llp", "gmbh",
    "subscription", "payment", "charge", "billing", "auto", "recurring",
]
#: Pattern in upper case and brand, the first that occurs counts.
BRANDS = [
    ("AMZN", "Amazon"), ("AMZ", "Amazon"), ("AMAZON", "Amazon"), ("NETFLIX", "Netflix"), ("SPOTIFY", "Spotify"), ("GOOGLE", "Google"), ("APPLE", "Apple"),
    ("MICROSOFT", "Microsoft"), ("YOUTUBE", "YouTube"), ("UBER", "Uber"), ("LYFT", "Lyft"), ("GRAB", "Grab"), ("OLA", "Ola"), ("SBUX", "Starbucks"),
    ("STARBUCKS", "Starbucks"), ("WALMART", "Walmart"), ("TARGET", "Target"), ("WHOLE FOODS", "Whole Foods"), ("TRADER JOE", "Trader Joe's"),
    ("SWIGGY", "Swiggy"), ("ZOMATO", "Zomato"), ("FLIPKART", "Flipkart"), ("MYNTRA", "Myntra"), ("PAYTM", "Paytm"), ("PHONEPE", "PhonePe"),
    ("GPAY", "Google Pay"), ("BIGBASKET", "BigBasket"), ("BLINKIT", "Blinkit"), ("ZEPTO", "Zepto"), ("DUNZO", "Dunzo"), ("RAPIDO", "Rapido"),
    ("JIO", "Jio"), ("AIRTEL", "Airtel"), ("VODAFONE", "Vodafone"), ("HDFC", "HDFC"), ("ICICI", "ICICI"), ("SBI", "SBI"), ("AXIS", "Axis Bank"),
    ("TESCO", "Tesco"), ("SAINSBURY", "Sainsbury's"), ("ASDA", "Asda"), ("ALDI", "Aldi"), ("LIDL", "Lidl"), ("DELIVEROO", "Deliveroo"),
    ("SHOPEE", "Shopee"), ("LAZADA", "Lazada"), ("GOJEK", "Gojek"), ("GRABFOOD", "GrabFood"), ("FOODPANDA", "Foodpanda"),
]
#: Words that a question's tokens leave out.
STOP_WORDS = [
    "a", "an", "and", "are", "at", "by", "for", "from", "how", "i", "in", "is", "it", "me", "my", "of", "on", "or", "the", "to", "was", "what",
    "when", "where", "which", "who", "why", "with", "you", "your",
]


#: Words of payment rails before a description; the first of them stand before a mark only.
CODED_RAILS = ["upi", "neft", "imps", "rtgs", "nach"]
NAMED_RAILS = ["ach", "atm", "card", "debit card", "mastercard", "mc", "pos", "tfr", "transfer", "visa", "wire", "xfer"]
#: Words of payments that tell nothing of a merchant, and words that a reference follows.
PAYMENT_WORDS = ["ach", "autopay", "bill payment", "billpay", "imps", "neft", "payment", "payzapp", "rrn", "rtgs", "transfer", "txn", "upi", "utr", "xfer"]
REFERENCE_WORDS = ["approval", "auth", "order", "ref", "reference", "txn", "txnid"]
#: Words of a statement's line beside its description, and currency signs.
DIRECTION_WORDS = ["cr", "credit", "credited", "debit", "debited", "dr"]
NUMBER_LABELS = [r"transaction\s+id", r"utr\s+no\.?", r"ref\.?\s*no\.?"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
SIGNS = "₹$€£¥₺₽₩₪₦₱₫৳฿"


def one_of(words: list[str]) -> str:
    """Any of the words, the longer ones first."""
    return "(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")"


# What is no part of a name, by kind; each is one pattern for all engines with (?i).
_DAY = r"\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}|\d{4}[-/]\d{1,2}[-/]\d{1,2}"
_MONTH = f"{one_of(MONTHS)}[a-z]*"
_NAMED_DAY = rf"\d{{1,2}}[-/\s.]*{_MONTH}[-/\s.,]*\d{{2,4}}|{_MONTH}\s+\d{{1,2}},?\s*\d{{2,4}}"
_CLOCK = r"\d{1,2}:\d{2}(?::\d{2})?(?:\s*[ap]m)?"
_SHORT_DAY = r"\d{1,2}[-/]\d{1,2}"
_MONEY = rf"[{SIGNS}]\s*[\d,]+(?:\.\d+)?|\b[\d,]+\.\d{{2}}\b"
_REFERENCE = rf"\b{one_of(REFERENCE_WORDS)}\b[:#-]?\s*[a-z0-9-]+"
RAIL_BEFORE = rf"(?i)^(?:{one_of(CODED_RAILS)}[-/]|{one_of(NAMED_RAILS)}[-/\s]+)+"
NUMBERS_AFTER = r"(?i)(?:\s*#?\d{6,}|\s*[-/]\s*\d{4,}|\s+\d{2}/\d{2}|\s*\b(?:ref|txn)\b:?\s*\S+)+$"
KEY_NOISE = rf"(?i)\([^)]*\)|{_REFERENCE}|\b{one_of(PAYMENT_WORDS)}\b|\b(?:{_DAY}|{_SHORT_DAY}|{_CLOCK})\b|\b\d{{6,}}\b|[^a-z0-9& ]"
LINE_NOISE = rf"(?i)\b(?:{_NAMED_DAY}|{_DAY})|{_MONEY}|\b{one_of(DIRECTION_WORDS)}\b|\b{one_of(NUMBER_LABELS)}\s*\S+|\b{_CLOCK}"


def bound(col: Column, make) -> Column:
    """``make(x)`` where x is ``col``, computed once however often ``make`` names it."""
    # Within another one, get() would work out the type of all that is made again for every row.
    return F.element_at(F.transform(F.array(col), make), 1)


def _fold(col: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, put in steps:
        col = F.regexp_replace(col, pattern, put)
    return col


def squeeze(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(col), r"\s+", " "))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 for equal texts (trimmed, lower case), 0 if one is empty, else one less the distance over the longer length."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return F.when(x == y, 1.0).when((x == "") | (y == ""), 0.0).otherwise(1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))


def bigrams(col: Column) -> Column:
    return F.when(F.length(col) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(col) - 1), lambda i: F.substring(col, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def dice_similarity(a: Column, b: Column) -> Column:
    """Shared over all distinct letter pairs; 1 for equal texts, 0 below two letters."""
    x, y = bigrams(a), bigrams(b)
    both = F.size(x) + F.size(y)
    return F.when(a == b, 1.0).when((F.length(a) < 2) | (F.length(b) < 2), 0.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / both)


def anomaly_merchant(col: Column) -> Column:
    """First three words without a leading code of two to four letters and a number, in lower case."""
    t = _fold(col, [(r"(?i)^[A-Z]{2,4}\s*\*?\s*", ""), (r"^\d+\s*", "")])
    return F.lower(F.array_join(F.slice(F.split(F.trim(t), r"\s+"), 1, 3), " "))


def recurring_name(col: Column) -> Column:
    """Name for grouping: lower case, without payment words before, signs, and company or billing words after."""
    t = F.regexp_replace(F.lower(F.trim(col)), r"^(payment\s*(to|for)?|purchase\s*(at|from)?|bill\s*payment\s*(to)?|sub\s*)\s*", "")
    t = F.regexp_replace(t, r"[^a-z0-9\s]", " ")
    return F.trim(_fold(t, [*[(rf"\s+{s}\s*$", "") for s in NAME_SUFFIXES], (r"\s+", " ")]))


def merchant_name(col: Column) -> Column:
    """Brand of a description, or the description without rails before it, and dates, numbers and references after it."""
    t = _fold(F.translate(col, "*", ""), [(NUMBERS_AFTER, ""), (RAIL_BEFORE, "")])
    # One pattern of all brands leaves out the rows that name none; the others look for the first of the list.
    def brand(up: Column) -> Column:
        first = F.when(up.contains(BRANDS[0][0]), BRANDS[0][1])
        for pattern, name in BRANDS[1:]:
            first = first.when(up.contains(pattern), name)
        return F.when(up.rlike("|".join(p for p, _ in BRANDS)), first)

    return bound(t, lambda x: F.coalesce(bound(F.upper(x), brand), F.trim(x)))


def merchant_key(col: Column) -> Column:
    """Key of learned rules: the capitals of the merchant's name without brackets, references, payment words, dates, times, long numbers and signs."""
    words = _fold(merchant_name(col), [(KEY_NOISE, " "), (r"\s+", " ")])
    return F.when(F.trim(F.coalesce(col, F.lit(""))) == "", "__unknown__").otherwise(F.upper(F.trim(words)))


def signature(date: Column, amount: Column, description: Column) -> Column:
    """Day, cents and the first 100 letters of the description: the key of an import."""
    cent = F.round(F.abs(amount) * 100, 0).cast("long").cast("string")
    return F.concat_ws("|", F.date_format(date, "yyyy-MM-dd"), cent, F.substring(F.lower(F.trim(F.coalesce(description, F.lit("")))), 1, 100))


def verification_text(col: Column) -> Column:
    return F.trim(_fold(F.lower(col), [(r"[^\w\s.,/-]", ""), (r"\s+", " ")]))


def statement_text(col: Column) -> Column:
    """Line ends, spaces and broken numbers of extracted text put right (after nfkc(), if wanted)."""
    return F.trim(_fold(col, [(r"\r\n?", "\n"), (r"[ \t]+", " "), (r"(\d)\s+,\s*(\d{3})", "$1,$2"), (r"(\d)\s+\.(\d{2})\b", "$1.$2"), (r"-\s+(\d)", "-$1"), (r"\n{3,}", "\n\n")]))


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which Spark has no function for."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def tokens(question: str) -> list[str]:
    """A question's words: letters and digits in lower case, longer than one, no stop words."""
    import re

    return [t for t in re.sub(r"[^a-z0-9]+", " ", question.lower()).split() if len(t) > 1 and t not in STOP_WORDS]


def debit_or_credit(col: Column) -> Column:
    """Direction from a word of the statement; words for debit are looked for first."""
    t = F.lower(F.trim(col))
    has = lambda *words: F.greatest(*[t.contains(w) for w in words])
    return F.when(has("dr", "debit", "withdrawal", "expense"), "debit").when(has("cr", "credit", "deposit", "income"), "credit")


def noise_row(col: Column) -> Column:
    return F.lower(F.trim(col)).rlike(r"^(opening|closing) balance|^balance (b/f|c/f|brought|carried)|^(sub ?)?total\b|^(grand|statement) total|^page \d+|^brought forward|^carried forward")


def quoted(col: Column) -> Column:
    """A CSV field, always in quotes."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(col, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def token_estimate(col: Column) -> Column:
    return F.ceil(F.length(col) / 4).cast("int")


#: Words of cashback, of payments of a card's bill, and issuers (with "card" or "bill").
CASHBACK_WORDS = ["cashback", "valueback", "reward cash", "reward cashback"]
BILL_WORDS = [
    "credit card", "cc payment", "card payment", "hdfc card", "icici card", "axis card", "sbi card", "kotak card", "citi card", "amex card", "idfc card", "tele-transfer", "tele transfer",
    "neft-hdfc", "neft-icici", "neft-axis", "neft-sbi", "neft-kotak", "billdesk*hdfc", "billdesk*icici", "billdesk*axis", "autopay cc",
]
BILL_ISSUERS = ["hdfc", "icici", "axis", "sbi", "kotak", "citi", "amex", "idfc", "au bank", "bob", "canara", "pnb", "hsbc", "standard chartered", "scb", "rbl", "yes bank"]


def clean_description(col: Column) -> Column:
    """The words of a statement's line: without dates, amounts, directions, references and times."""
    t = F.trim(_fold(col, [(LINE_NOISE, ""), (r"\s+", " ")]))
    return bound(t, lambda x: F.when(x == "", "Transaction").otherwise(x))


def credit_suffix(col: Column) -> Column:
    return F.trim(col).rlike(r"(?i)\bcr\.?\s*$")


def is_numeric(col: Column) -> Column:
    """Digits, beside currency signs, spaces, separators, brackets and minus."""
    return F.regexp_replace(col, r"[₹$€£¥₺₽₩₪₦₱₫৳฿\s,.()\-]", "").rlike(r"^\d+$")


def _names_any(col: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(col, w))


def sub_type(kind: Column, source: Column, direction: Column, description: Column) -> Column:
    """The kind of a movement; a card's credit that is called a bill payment without a word of one is a refund."""
    t = F.lower(F.coalesce(description, F.lit("")))
    issuer = _names_any(t, BILL_ISSUERS) & (t.contains("card") | t.contains("bill"))
    doubtful = (source == "credit_card") & (direction == "credit") & (kind == "bill_payment")
    return F.when(doubtful & ~_names_any(t, CASHBACK_WORDS) & ~_names_any(t, BILL_WORDS) & ~issuer, "refund").otherwise(kind)


def statement_kind(col: Column, letters: int = 500) -> Column:
    """credit_card, bank or unknown, by the words of a statement's first and last letters; more words of one kind decide."""
    ends = F.lower(F.concat(F.substring(col, 1, letters), F.lit(" "), F.substring(col, -letters, letters)))
    count = lambda t, words: F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(t, w)))
    card, bank = ["credit card", "minimum amount due", "total amount due", "credit limit", "payment due date"], ["opening balance", "closing balance", "savings account", "current account", "withdrawal", "ifsc"]
    return bound(ends, lambda t: F.when(count(t, card) > count(t, bank), "credit_card").when(count(t, bank) > count(t, card), "bank").otherwise("unknown"))


def loose_number(col: Column) -> Column:
    """The number of a written sum: digits, dots and minus only, up to where they stop being a number; 0 without one."""
    kept = F.regexp_replace(col, r"[^0-9.\-]", "")
    return F.coalesce(F.try_to_number(F.regexp_extract(kept, r"^-?(\d+\.?\d*|\.\d+)", 0), F.lit("S99999999999999.999999")).cast("double"), F.lit(0.0))


def payoff_time(months: Column, most: int = 600) -> Column:
    """Months as years and months in words."""
    y, m = F.floor(months / 12), months % 12
    word = lambda n, w: F.concat(n.cast("string"), F.lit(f" {w}"), F.when(n != 1, "s").otherwise(""))
    both = F.concat_ws(" ", F.when(y > 0, word(y, "year")), F.when((m > 0) | (y == 0), word(m, "month")))
    return F.when(months < 0, "Never (payment too low)").when(months == 0, "Paid off").when(months >= most, "50+ years").otherwise(both)


def rate_label(rate: Column) -> Column:
    return F.when(rate >= 0.9, "Excellent").when(rate >= 0.7, "Good").when(rate >= 0.5, "Fair").otherwise("Needs Improvement")


def preview(col: Column, letters: int = 60) -> Column:
    return F.when(F.length(col) > letters, F.concat(F.substring(col, 1, letters), F.lit("..."))).otherwise(col)


def server_url(col: Column) -> Column:
    """struct(valid, url, remote): a server's address with a scheme and without '/' at its end; http and https only."""
    t = F.trim(col)
    url = F.regexp_replace(F.when(t.startswith("http://") | t.startswith("https://"), t).otherwise(F.concat(F.lit("http://"), t)), "/+$", "")
    host = F.lower(F.regexp_extract(url, r"^https?://(?:[^/?#@]*@)?(\[[0-9a-fA-F:]+\]|[A-Za-z0-9._-]+)(?::\d{1,5})?(?:[/?#]\S*)?$", 1))
    local = host.isin("localhost", "[::1]", "0.0.0.0") | host.startswith("127.")
    return F.struct((host != "").alias("valid"), F.when(host != "", url).otherwise("").alias("url"), ((host != "") & ~local).alias("remote"))
