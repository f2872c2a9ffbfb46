"""Masking of secrets and personal values, and keyed fingerprints of what was masked."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmark.functions.text import digits, entropy, let

MASK = "[REDACTED]"

# Shapes of secrets, in the order in which they are masked.
VALUE_PATTERNS = [
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\b"),
    ("openai_key", r"\bsk-[A-Za-z0-9_-]{20,}\b"),
    ("aws_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("google_key", r"\bAIza[0-9A-Za-z_-]{35}\b"),
    ("slack_token", r"\bxox[baprs]-[0-9A-Za-z-]{10,}\b"),
    ("github_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    ("stripe_key", r"\b[rsp]k_(?:live|test)_[A-Za-z0-9]{16,}\b"),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("card", r"\b(?:\d[ -]?){13,19}\b"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
]
# What stands in every value of a kind; a text without it needs no search for the whole shape.
TELLTALES = {
    "jwt": ["eyJ"], "openai_key": ["sk-"], "aws_key": ["AKIA", "ASIA"], "google_key": ["AIza"], "slack_token": ["xox"], "github_token": ["gh"],
    "stripe_key": ["k_live_", "k_test_"], "private_key": ["-----BEGIN "], "email": ["@"],
}
# Headers that are always masked, and parts of names that mark others.
SENSITIVE_HEADERS = ["authorization", "proxy-authorization", "cookie", "set-cookie", "x-api-key", "x-auth-token", "x-csrf-token", "x-xsrf-token", "api-key"]
SENSITIVE_HEADER_HINTS = ["token", "secret", "apikey", "api-key", "auth", "session"]
# Parts of parameter names that mark their values; those of up to four letters must be a whole word.
SENSITIVE_PARAM_HINTS = [
    "password", "passwd", "pwd", "passcode", "secret", "token", "apikey", "api_key", "access_key", "refresh_token", "id_token", "client_secret",
    "private_key", "session", "sid", "csrf", "auth", "signature", "sig", "code", "otp", "pin", "ssn", "cvv", "cvc", "assertion", "answer", "passphrase",
    "totp", "mfa", "sessid", "nonce", "xsrf", "viewstate", "eventvalidation", "verification", "cookie", "credential", "bearer",
]
# Names that together make up a change of password.
CREDENTIAL_GROUP = ["current", "new", "repeat", "confirm", "old", "retype", "verify", "again", "newpass", "oldpass", "confirmation"]


def is_card(number: Column) -> Column:
    """Luhn's check over 13 to 19 digits; thirteen digits that begin with 1 are a time in milliseconds."""
    n = F.length(number)
    return n.between(13, 19) & ~((n == 13) & number.startswith("1")) & F.coalesce(F.call_function("luhn_check", number), F.lit(False))


def sensitive_header(name: Column) -> Column:
    low = F.lower(name)
    return low.isin(SENSITIVE_HEADERS) | low.rlike("|".join(SENSITIVE_HEADER_HINTS))


def sensitive_param(name: Column) -> Column:
    """camelCase is split into words first, so ``userPin`` is sensitive and ``shipping`` is not."""
    low = F.lower(F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])", "_"))
    short = [h for h in SENSITIVE_PARAM_HINTS if len(h) <= 4]
    words = F.split(low, r"[^a-z0-9]+")
    return low.rlike("|".join(h for h in SENSITIVE_PARAM_HINTS if len(h) > 4)) | F.arrays_overlap(words, F.array(*map(F.lit, short)))


def error_constant(value: Column) -> Column:
    """Constants such as SQLITE_ERROR or ECONNRESET, which are no codes to hide."""
    return value.rlike(r"^(?:E[A-Z]{3,}|[A-Z]+(?:_[A-Z]+)+)$")


def credential_group(names: Column) -> Column:
    """Two or more names of a change of password in one array of names."""
    leaves = F.transform(names, lambda n: F.regexp_replace(F.lower(F.regexp_extract(n, r"([A-Za-z]+)[^A-Za-z]*$", 1)), "(password|pass|pwd)$", ""))
    return F.size(F.array_intersect(leaves, F.array(*map(F.lit, CREDENTIAL_GROUP)))) >= 2


def _holds(text: Column, parts: list[str]) -> Column:
    """Whether a text has any of ``parts``."""
    found = F.contains(text, F.lit(parts[0]))
    for p in parts[1:]:
        found = found | F.contains(text, F.lit(p))
    return found


def may_hold(text: Column, kind: str) -> Column:
    """Whether a text may have a value of that kind: false only if it has none."""
    return _holds(text, TELLTALES[kind]) if kind in TELLTALES else text.rlike(dict(VALUE_PATTERNS)[kind])


def _mask_cards(text: Column) -> Column:
    """Only runs of digits that pass the check are masked; the others stay as they are."""
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit("(" + dict(VALUE_PATTERNS)["card"] + ")"), 1))
    cards = F.filter(runs, lambda r: is_card(digits(r)))
    trimmed = F.transform(cards, lambda r: F.regexp_replace(r, "[ -]+$", ""))
    return F.aggregate(trimmed, text, lambda acc, r: F.replace(acc, r, F.lit("[REDACTED:card]")))


def mask_values(text: Column) -> Column:
    """The text with every value of a secret's shape as ``[REDACTED:kind]``."""

    def masker(kind: str, pattern: str) -> Callable[[Column], Column]:
        masked = _mask_cards if kind == "card" else lambda x: F.regexp_replace(x, pattern, f"[REDACTED:{kind}]")
        return lambda x: F.when(may_hold(x, kind), masked(x)).otherwise(x)

    for kind, pattern in VALUE_PATTERNS:
        text = let(text, masker(kind, pattern))
    return text


def found_values(text: Column) -> Column:
    """array<struct<kind, value>> of the values that ``mask_values`` masks, each kind on its own."""

    def one(text: Column, kind: str, pattern: str) -> Column:
        hits = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
        if kind == "card":
            hits = F.transform(F.filter(hits, lambda r: is_card(digits(r))), digits)
        found = F.transform(hits, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
        return F.when(may_hold(text, kind), found).otherwise(F.array().cast("array<struct<kind: string, value: string>>"))

    return let(text, lambda x: F.when(x.isNotNull(), F.concat(*[one(x, k, p) for k, p in VALUE_PATTERNS])))


def fingerprint(value: Column, key: bytes, kind: Column | None = None) -> Column:
    """struct(kind, hmac_12, length, entropy) of a value, which itself is not kept.

    HMAC-SHA256 from two plain digests: the key's inner and outer pads are constants.
    """
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ p for b in block)) for p in (0x36, 0x5C))
    mac = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))), 256)
    return F.struct(
        (F.lit(None).cast("string") if kind is None else kind).alias("kind"), F.substring(mac, 1, 12).alias("hmac_12"), F.length(value).alias("length"), F.round(entropy(value), 2).alias("entropy")
    )


def mask_headers(headers: Column) -> Column:
    """array<struct<name, value>>: sensitive headers as a whole, others by the shapes of their values."""
    return F.transform(headers, lambda h: F.struct(h["name"].alias("name"), F.when(sensitive_header(h["name"]), MASK).otherwise(mask_values(h["value"])).alias("value")))


def mask_params(params: Column) -> Column:
    """Parameters by their names first, then by the shapes of their values."""
    group = credential_group(F.transform(params, lambda p: p["name"]))

    def one(p: Column) -> Column:
        leaf = F.lower(p["name"])
        hide = (sensitive_param(p["name"]) | (group & leaf.isin(CREDENTIAL_GROUP))) & (p["value"] != "") & ~error_constant(p["value"])
        return F.struct(p["name"].alias("name"), F.when(hide, MASK).otherwise(mask_values(p["value"])).alias("value"))

    return F.transform(params, one)


def mask_named(text: Column) -> Column:
    """Values beside a sensitive name in stored text: k=v, JSON members, header lines, input fields and XML elements.

    The name decides, so the patterns hold the hints; long hints fit anywhere in a name, short ones only as a word.
    """
    long = "|".join(h for h in SENSITIVE_PARAM_HINTS if len(h) > 4)
    short = "|".join(h for h in SENSITIVE_PARAM_HINTS if len(h) <= 4)
    name = rf"(?:[\w.\-\[\]]*(?:{long})[\w.\-\[\]]*|(?:[\w]+[_.\-])?(?:{short})(?:[_.\-][\w]+)?)"
    rules = [
        (rf'(?i)("{name}"\s*:\s*")(?:[^"\\]|\\.)+(")', "$1[REDACTED]$2"),
        (rf'(?i)("{name}"\s*:\s*)(-?\d[\d.]*)', '$1"[REDACTED]"'),
        (rf"(?i)((?:^|[?&;\s]){name}=)[^&;\s\"'<>]+", "$1[REDACTED]"),
        (rf"(?im)^((?:{'|'.join(SENSITIVE_HEADERS)})\s*:\s*)\S[^\r\n]*", "$1[REDACTED]"),
        (rf'(?i)(<input\b[^>]*\bname="{name}"[^>]*\bvalue=")[^"]+(")', "$1[REDACTED]$2"),
        (rf'(?i)(<input\b[^>]*\bvalue=")[^"]+("[^>]*\bname="{name}")', "$1[REDACTED]$2"),
        (rf"(?i)(<({name})>)[^<]+(</\2>)", "$1[REDACTED]$3"),
        (rf"(?im)^(\s*{name}\s*:\s+)[^\s\"'\[{{][^\r\n]*", "$1[REDACTED]"),
        (rf"(?i)(\b{name}\s*=\s*)([\"'])[^\"']+\2", "$1$2[REDACTED]$2"),
    ]
    # What must stand in a text for each rule to change it; all but the header lines also need a hint, and those have one or ``api-key``.
    member, colon, equals = r'"\s*:', ":", "="
    needed = [member, member, equals, colon, "(?i)<input", "(?i)<input", "</", colon, r"=\s*[\"']"]

    def rule(pattern: str, to: str, sign: str) -> Callable[[Column], Column]:
        return lambda x: F.when(x.rlike(sign), F.regexp_replace(x, pattern, to)).otherwise(x)

    def ruled(x: Column) -> Column:
        for (pattern, to), sign in zip(rules, needed, strict=True):
            x = let(x, rule(pattern, to, sign))
        return x

    hinted = let(F.lower(text), lambda low: _holds(low, [*SENSITIVE_PARAM_HINTS, "api-key"]))
    return mask_values(F.when(hinted, ruled(text)).otherwise(text))
