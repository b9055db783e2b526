"""Currency of a text by scored signs, codes and words; currency signs that extraction garbled."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import grouped
from .text import bound

#: Code, sign, locale, and further patterns beside the code; of equal scores the first counts.
CURRENCIES = [
    ("INR", "₹", "en-IN", ["₹", r"\bRs\.?\s", r"\bRupees?\b"]),
    ("USD", "$", "en-US", [r"\$", r"\bUS\s?Dollar"]),
    ("EUR", "€", "de-DE", ["€", r"\bEuro\b"]),
    ("GBP", "£", "en-GB", ["£", r"\bPound\s?Sterling\b"]),
    ("JPY", "¥", "ja-JP", ["¥", r"\bYen\b"]),
    ("CNY", "¥", "zh-CN", [r"\bRMB\b", r"\bYuan\b"]),
    ("AUD", "A$", "en-AU", [r"A\$"]),
    ("CAD", "C$", "en-CA", [r"C\$"]),
    ("CHF", "Fr", "de-CH", [r"\bFr\.?\s"]),
    ("SEK", "kr", "sv-SE", [r"\bkr\b"]),
    ("NOK", "kr", "nb-NO", []),
    ("DKK", "kr", "da-DK", []),
    ("SGD", "S$", "en-SG", [r"S\$"]),
    ("HKD", "HK$", "en-HK", [r"HK\$"]),
    ("NZD", "NZ$", "en-NZ", [r"NZ\$"]),
    ("ZAR", "R", "en-ZA", [r"\bRand\b"]),
    ("BRL", "R$", "pt-BR", [r"R\$", r"\bReal\b"]),
    ("MXN", "MX$", "es-MX", [r"MX\$"]),
    ("ARS", "AR$", "es-AR", [r"AR\$"]),
    ("CLP", "CL$", "es-CL", [r"CL\$"]),
    ("COP", "COL$", "es-CO", [r"COL\$"]),
    ("MYR", "RM", "ms-MY", [r"\bRM\b", r"\bRinggit\b"]),
    ("THB", "฿", "th-TH", ["฿", r"\bBaht\b"]),
    ("IDR", "Rp", "id-ID", [r"\bRp\.?\s", r"\bRupiah\b"]),
    ("PHP", "₱", "en-PH", ["₱"]),
    ("VND", "₫", "vi-VN", ["₫"]),
    ("KRW", "₩", "ko-KR", ["₩"]),
    ("TWD", "NT$", "zh-TW", [r"NT\$"]),
    ("TRY", "₺", "tr-TR", ["₺", r"\bTL\b"]),
    ("RUB", "₽", "ru-RU", ["₽"]),
    ("PLN", "zł", "pl-PL", ["zł"]),
    ("CZK", "Kč", "cs-CZ", ["Kč"]),
    ("HUF", "Ft", "hu-HU", [r"\bFt\b"]),
    ("RON", "lei", "ro-RO", [r"\blei\b"]),
    ("ILS", "₪", "he-IL", ["₪", r"\bShekel\b"]),
    ("AED", "د.إ", "ar-AE", [r"\bDirham\b", r"د\.إ"]),
    ("SAR", "﷼", "ar-SA", [r"\bRiyal\b", "﷼"]),
    ("QAR", "QR", "ar-QA", []),
    ("KWD", "KD", "ar-KW", [r"\bKD\b"]),
    ("BHD", "BD", "ar-BH", []),
    ("OMR", "OMR", "ar-OM", []),
    ("EGP", "E£", "ar-EG", ["E£"]),
    ("NGN", "₦", "en-NG", ["₦", r"\bNaira\b"]),
    ("KES", "KSh", "en-KE", [r"\bKSh\b"]),
    ("GHS", "GH₵", "en-GH", ["GH₵"]),
    ("PKR", "₨", "en-PK", ["₨"]),
    ("BDT", "৳", "bn-BD", ["৳", r"\bTaka\b"]),
    ("LKR", "Rs", "si-LK", []),
    ("NPR", "Rs", "ne-NP", []),
]
#: Signs that weigh 3; a code of three letters weighs 2, anything else 1.
SIGNS = "₹€£¥₺₽₩₪₦₱₫৳฿"
#: Bytes of a sign that were read in another encoding.
GARBLED = [("â‚¹", "₹"), ("â‚¬", "€"), ("â‚±", "₱"), ("â‚º", "₺"), ("â‚©", "₩"), ("Â£", "£"), ("Â¥", "¥")]
#: Codes before an amount and the signs that they stand for.
CODE_SIGNS = [
    ("INR", "₹"), ("EUR", "€"), ("GBP", "£"), ("JPY", "¥"), ("KRW", "₩"), ("TRY", "₺"), ("THB", "฿"), ("PHP", "₱"), ("USD", "$"), ("AUD", "A$"), ("CAD", "CA$"), ("SGD", "S$"), ("HKD", "HK$"),
    ("MYR", "RM"), ("IDR", "Rp"), ("VND", "₫"), ("CNY", "¥"), ("BDT", "৳"), ("PKR", "₨"), ("NPR", "Rs."), ("LKR", "Rs."),
]
#: Words that tell a document's currency, in order.
CURRENCY_WORDS = [
    ("INR", r"INR|rupee|rupees|paisa|paise|lakh|crore|HDFC|SBI|ICICI|Axis\s+Bank|Kotak|PNB|Canara|NEFT|IMPS|UPI|RBI"),
    ("PHP", "PHP|peso|pesos|centavo|centavos|BDO|BPI|Metrobank|Landbank|GCash|Maya|Philippine|Philippines"),
    ("THB", r"THB|baht|satang|Kasikorn|KBank|SCB|Bangkok\s+Bank|Krungthai|TMB|Thailand|Thai"),
    ("KRW", "KRW|won|jeon|Kookmin|Shinhan|Hana|Woori|IBK|Korea|Korean"),
    ("TRY", "TRY|lira|kurus|Ziraat|Garanti|Akbank|Turkey|Turkish|Turkiye"),
    ("JPY", "JPY|yen|sen|MUFG|Mizuho|SMBC|Sumitomo|Resona|Japan|Japanese"),
    ("EUR", r"EUR|euro|euros|SEPA|IBAN|Deutsche\s+Bank|BNP|Societe|UniCredit|Santander|ING|Rabobank|Commerzbank"),
    ("GBP", "GBP|pound|pounds|sterling|pence|penny|Barclays|Lloyds|NatWest|Halifax|Nationwide|TSB|Monzo|Starling"),
    ("MYR", r"MYR|ringgit|sen|Maybank|CIMB|Public\s+Bank|RHB|Hong\s+Leong|Malaysia|Malaysian"),
    ("IDR", "IDR|rupiah|BCA|Mandiri|BNI|BRI|Indonesia|Indonesian"),
    ("VND", "VND|dong|Vietcombank|VietinBank|Techcombank|Vietnam|Vietnamese"),
    ("CNY", "CNY|RMB|yuan|jiao|fen|ICBC|CCB|BOC|ABC|China|Chinese"),
    ("BDT", "BDT|taka|poisha|Sonali|Janata|Agrani|Bangladesh|Bangladeshi"),
]
#: Ways to write an amount: digits in threes with or without cents, in lakhs, with points for groups.
STYLES = {
    "whole": r"\d{1,3}(?:,\d{3})*",
    "cents": r"\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?",
    "mixed": r"\d{1,3}(?:,\d{2,3})*(?:\.\d{1,2})?",
    "lakhs": r"\d{1,2}(?:,\d{2})+,\d{3}(?:\.\d{1,2})?",
    "points": r"[\d.]+(?:,\d{1,2})?",
}
#: What extraction puts in place of a sign: currency, letter, sign, and the way of the amount behind it.
MISREAD = [("INR", "C", "₹", "mixed"), ("PHP", "P", "₱", "cents"), ("THB", "B", "฿", "cents"), ("KRW", "W", "₩", "whole"), ("TRY", "TL", "₺", "points"), ("JPY", "\\", "¥", "whole"), ("GBP", "#", "£", "cents"), ("CNY", "\\", "¥", "cents")]
#: Words before an amount that are a sign in any document.
SIGN_WORDS = [("Php", "₱"), ("Baht", "฿")]


def before_amount(letters: str, style: str) -> str:
    """Letters before an amount, which is the first group."""
    edge = r"\b" if letters[0].isalpha() else ""
    return rf"{edge}{re.escape(letters)}\s*({STYLES[style]})\b"


def misread() -> list[tuple[str, str, str]]:
    """(currency, pattern, sign) of MISREAD."""
    return [(code, before_amount(letters, style), sign) for code, letters, sign, style in MISREAD]


def patterns() -> list[tuple[int, str, str, int]]:
    """(rank, code, pattern, weight) of every pattern."""
    weight = lambda p: 3 if any(s in p for s in SIGNS) else 2 if re.fullmatch(r"\\b[A-Z]{3}\\b", p) else 1
    return [(rank, code, p, weight(p)) for rank, (code, _, _, more) in enumerate(CURRENCIES) for p in [rf"\b{code}\b", *more]]


def held_letters(pattern: str) -> str:
    """The longest text, in lower case, that every match of a pattern of CURRENCIES holds."""
    fixed = re.sub(r"\\?.\?", "\0", re.sub(r"\\s\??", "\0", pattern.replace("\\b", "")))
    return max(re.sub(r"\\(.)", r"\1", fixed).split("\0"), key=len).lower()


def currency_scores(text: Column) -> Column:
    """array<struct(score, rank, code)> of the currencies that occur; case counts for nothing.

    A pattern is only matched against texts that hold its letters, which few do.
    """

    def scores(low: Column) -> Column:
        per_code: dict[str, Column] = {}
        for _, code, p, weight in patterns():
            points = F.when(low.contains(held_letters(p)), weight * F.regexp_count(text, F.lit(f"(?i){p}"))).otherwise(0)
            per_code[code] = per_code[code] + points if code in per_code else points
        made = [F.struct(per_code[code].alias("score"), F.lit(-rank).alias("rank"), F.lit(code).alias("code")) for rank, (code, *_) in enumerate(CURRENCIES)]
        return F.filter(F.array(*made), lambda x: x["score"] > 0)

    return bound(F.lower(text), scores)


def detect_currency(text: Column, head: int = 5000, tail: int = 2000) -> Column:
    """The best currency of a statement's first and last characters, or null."""
    part = F.when(F.length(text) > head + tail, F.concat(F.substring(text, 1, head), F.lit("\n"), F.substring(text, -tail, tail))).otherwise(text)
    return bound(part, lambda t: F.array_max(currency_scores(t))["code"])


def currency_of_headers(headers: Column) -> Column:
    """The best currency of a table's column names (an array)."""
    return detect_currency(F.array_join(headers, " "))


def plain_currency(text: Column) -> Column:
    """The first of the common codes, else the currency of a sign or name that occurs, else null."""
    out = F.nullif(F.regexp_extract(text, r"\b(INR|USD|EUR|GBP|JPY|AUD|CAD)\b", 1), F.lit(""))
    for code, sign, name in (("INR", "₹", "Rupee"), ("USD", "$", "Dollar"), ("EUR", "€", "Euro"), ("GBP", "£", "Pound")):
        out = F.coalesce(out, F.when(text.contains(sign) | text.contains(name), code))
    return out


def currency_attribute(code: Column, name: str) -> Column:
    """``sign`` (null if unknown) or ``locale`` (else en-US) of a currency code in any case."""
    at = {"sign": 1, "locale": 2}[name]
    pairs = [x for row in CURRENCIES for x in (F.lit(row[0]), F.lit(row[at]))]
    found = F.try_element_at(F.create_map(*pairs), F.upper(code))
    return F.coalesce(found, F.lit("en-US")) if name == "locale" else found


def safe_repairs() -> list[tuple[str, str]]:
    """(pattern, replacement) of repairs that need no context."""
    return [
        *GARBLED,
        *[(rf"\b{code}\s+(\d)", f"{sign.replace('$', '\\$')}$1") for code, sign in CODE_SIGNS],
        (r"\bRs\.\s*", "₹"),
        *[(rf"(?i)\b{word}\s+(\d)", f"{sign}$1") for word, sign in SIGN_WORDS],
        (r"¬\s*(\d)", "€$1"),
        (before_amount("C", "lakhs"), "₹$1"),
    ]


def repair_glyphs(text: Column, currency: str | None = None) -> Column:
    """Currency signs that extraction garbled: first what is wrong in any document, then what stands for the sign of the
    document's own currency (given, or told by its words)."""
    for wrong, right in safe_repairs():
        text = F.regexp_replace(text, wrong, right)

    def in_context(t: Column) -> Column:
        told = F.lit(currency)
        if currency is None:
            told = F.when(t.rlike(rf"(?i)\b({CURRENCY_WORDS[0][1]})\b"), CURRENCY_WORDS[0][0])
            for code, words in CURRENCY_WORDS[1:]:
                told = told.when(t.rlike(rf"(?i)\b({words})\b"), code)
        return bound(told, lambda c: _by_code(c, t))

    def _by_code(c: Column, t: Column) -> Column:
        (first, pattern, put), *others = misread()
        out = F.when(c == first, F.regexp_replace(t, pattern, f"{put}$1"))
        for code, wrong, sign in others:
            out = out.when(c == code, F.regexp_replace(t, wrong, f"{sign}$1"))
        return out.otherwise(t)

    return bound(text, in_context)


#: How locales write money: (mark of groups, mark of the fraction, grouping style, whether the sign comes first).
FORMATS = {
    "en": (",", ".", "western", True), "ja": (",", ".", "western", True), "zh": (",", ".", "western", True), "ko": (",", ".", "western", True), "th": (",", ".", "western", True), "he": (",", ".", "western", False),
    "en-IN": (",", ".", "indian", True), "bn-BD": (",", ".", "indian", True), "ne-NP": (",", ".", "indian", True), "en-PK": (",", ".", "western", True), "en-ZA": ("\u00a0", ",", "western", True),
    "de": (".", ",", "western", False), "es": (".", ",", "western", False), "tr": (".", ",", "western", True), "id": (".", ",", "western", True), "vi": (".", ",", "western", False), "da": (".", ",", "western", False), "ro": (".", ",", "western", False),
    "pt": (".", ",", "western", True), "es-MX": (",", ".", "western", True), "de-CH": ("’", ".", "western", True), "sv": ("\u00a0", ",", "western", False), "nb": ("\u00a0", ",", "western", False), "ru": ("\u00a0", ",", "western", False),
    "pl": ("\u00a0", ",", "western", False), "cs": ("\u00a0", ",", "western", False), "hu": ("\u00a0", ",", "western", False),
}
#: Currencies without a fraction.
WHOLE = ["JPY", "KRW", "VND", "IDR", "CLP"]


def formatted(amount: Column, code: Column, signed: bool = True) -> Column:
    """An amount as its currency's locale writes it: two digits of fraction or, of whole amounts and currencies without one, none.

    Unknown currencies are written as in English after their code; a locale without a format of its own has that of its language, else the
    English one.  Letters after a sign of more than one are kept apart from the digits by a space that does not break.
    """
    size = F.abs(amount).cast("decimal(18,2)")
    whole = code.isin(*WHOLE) | (size == F.floor(size))
    plain = F.when(whole, F.round(size, 0).cast("decimal(18,0)").cast("string")).otherwise(size.cast("string"))

    def written(kind: tuple, sign: str | Column, letters: bool) -> Column:
        mark, point, style, before = kind
        digits, sign = grouped(plain, style, mark, point), F.lit(sign) if isinstance(sign, str) else sign
        return F.concat(sign, F.lit("\u00a0" if letters else ""), digits) if before else F.concat(digits, F.lit("\u00a0"), sign)

    out = None
    for name, sign, locale, _ in CURRENCIES:
        kind = FORMATS.get(locale) or FORMATS.get(locale[:2]) or FORMATS["en"]
        one = written(kind, sign, sign[-1].isalpha() or sign.endswith("."))
        out = F.when(code == name, one) if out is None else out.when(code == name, one)
    out = out.otherwise(written(FORMATS["en"], code, True))
    return F.when(amount < 0, F.concat(F.lit("-"), out)).otherwise(out) if signed else out


def signed_amount(amount: Column, kind: Column, code: Column) -> Column:
    """Money out with a minus, money in without a sign, whatever sign the amount has."""
    return formatted(F.when(kind == "debit", -F.abs(amount)).otherwise(F.abs(amount)), code)
