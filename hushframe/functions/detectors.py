"""Ready-made detectors: a pattern each, and for some a check of what it found."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import SPANS, pattern_spans

# The detectors' patterns, in the order of their names in DETECTORS.
EMAIL = r"[A-Z0-9._%+\-]+@[A-Z0-9\-]+(?:\.[A-Z0-9\-]+)*\.[A-Z]{2,}"
IPV4 = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d.])"
IPV6 = r"(?<![\w:])(?:[0-9A-F]{1,4}:){2,7}[0-9A-F]{1,4}(?![\w:])"
PHONE = r"(?<![\w])\+?\d[\d \t().\-]{6,}\d(?![\w])"
API_KEY = (
    r"AKIA[0-9A-Z]{16}"
    r"|gh[pousr]_[A-Za-z0-9]{30,}"
    r"|github_pat_[A-Za-z0-9_]{40,}"
    r"|sk_(?:live|test)_[A-Za-z0-9]{16,}"
    r"|sk-[A-Za-z0-9_\-]{20,}"
    r"|AIza[0-9A-Za-z_\-]{35}"
    r"|xox[abprs]-[A-Za-z0-9\-]{10,}"
    r"|eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}"
    r"|(?:api[_\-]?key|secret|token|passwd|password)[ \t]*[:=][ \t]*['\"]?[A-Za-z0-9_\-./+]{12,}"
)
CREDIT_CARD = r"(?<![\d])(?:\d[ \-]?){13,19}(?![\d])"
URL = r"\b(?:https?://|www\.)[^\s<>\"']+"
KNOWN_WALLET = r"[0O]x[0-9a-fo]{38,42}|[0O]x[0-9a-f]{2,10}[ \t]?(?:\.{2,4}|…)[ \t]?[0-9a-f]{2,10}|(?:bc|tb|ltc|cosmos|osmo|terra|bnb|addr)1[0-9a-z]{20,90}"
ANY_WALLET = r"[0-9a-z]{3,10}[ \t]?(?:\.{2,4}|…)[ \t]?[0-9a-z]{3,10}|[0-9a-z]{26,64}"
WALLET = rf"(?<![0-9A-Za-z])(?:{KNOWN_WALLET}|{ANY_WALLET})(?![0-9A-Za-z])"
DETECTORS = {"Email": EMAIL, "Ipv4": IPV4, "Ipv6": IPV6, "Phone": PHONE, "ApiKey": API_KEY, "CreditCard": CREDIT_CARD, "Url": URL, "CryptoAddress": WALLET}
DATE = r"(?U)^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}$"
#: What every match holds: texts without it are not searched.
HOLDS = {"Email": "@", "Ipv6": ":"}
RECOMMENDED = ("Email", "Ipv4", "Phone", "ApiKey", "CreditCard", "Url", "CryptoAddress")
# Fixed values end here.

_FLAGS = "(?iU)"


def digits_only(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)\D", "")


def passes_luhn(value: Column) -> Column:
    """13 to 19 digits whose check digit is right."""
    digits = digits_only(value)
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def plausible_phone(value: Column) -> Column:
    """8 to 15 digits, not a date, and fewer than three groups of a single digit."""
    groups = F.split(value, r"(?U)\D+")
    single = F.size(F.filter(groups, lambda g: F.length(g) == 1))
    return F.length(digits_only(value)).between(8, 15) & ~value.rlike(DATE) & (single < 3)


def plausible_wallet(value: Column) -> Column:
    """A known shape; else a shortened form with a digit, or a long token of digits, upper and lower case."""
    digit = value.rlike(r"\p{Nd}")
    shortened = value.contains("..") | value.contains("…")
    mixed = digit & value.rlike(r"\p{Lu}") & value.rlike(r"\p{Ll}")
    return value.rlike(f"{_FLAGS}^(?:{KNOWN_WALLET})$") | F.when(shortened, digit).otherwise(mixed)


_CHECKS = {"Phone": plausible_phone, "CreditCard": passes_luhn, "CryptoAddress": plausible_wallet}


def candidates(text: Column, name: str) -> Column:
    """What the detector's pattern finds, before trimming and checks."""
    found = pattern_spans(text, _FLAGS + DETECTORS[name])
    return F.when(text.contains(HOLDS[name]), found).otherwise(F.array().cast(SPANS)) if name in HOLDS else found


def detector_spans(text: Column, name: str) -> Column:
    """array<struct<start,length,text>> of a detector: trailing . , ; ) cut off, then checked."""
    trimmed = F.transform(candidates(text, name), lambda s: F.struct(s["start"].alias("start"), F.regexp_replace(s["text"], r"[.,;)]+$", "").alias("text")))
    full = F.transform(trimmed, lambda s: F.struct(s["start"].alias("start"), F.length(s["text"]).alias("length"), s["text"].alias("text")))
    check = _CHECKS.get(name)
    return F.filter(full, lambda s: (s["text"] != "") & check(s["text"]) if check else s["text"] != "")
