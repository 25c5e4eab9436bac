"""Personal data: masks, scans, tokens. Masks and scans are built-in expressions; tokens use the built-in AES."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import hmac_sha256

# Patterns of a leak scan, of a scan with previews, and of what no feature may begin with.
PATTERNS = {
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b",
    "account_number": r"\bACC_\d{6,}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
}
PREVIEW_PATTERNS = {"ssn": r"\d{3}-\d{2}-\d{4}", "credit_card": r"\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}", "account_number": r"^[A-Z]{2}\d{6,10}$"}
FEATURE_PATTERNS = (r"\d{3}-\d{2}-\d{4}", r"\d{16}", r"[A-Z]{2}\d{7}")


def mask(value: Column, category: str) -> Column:
    """What may be shown of a value: enough to recognise it, not to use it. Null stays null."""
    last = F.right(value, F.lit(4))
    shown = {
        "ssn": (F.length(value) >= 4, F.concat(F.lit("***-**-"), last), "***-**-****"),
        "account_number": (F.length(value) >= 4, F.concat(F.lit("****"), last), "****"),
        "email": (F.instr(value, "@") > 0, F.concat(F.substr(value, F.lit(1), F.least(F.lit(1), F.instr(value, "@") - 1)), F.lit("***@"), F.split_part(value, F.lit("@"), F.lit(2))), "***@***"),
        "phone": (F.length(value) >= 4, F.concat(F.lit("***-***-"), last), "***-***-****"),
        "zip": (F.lit(True), F.concat(F.substring(value, 1, 3), F.lit("**")), "**"),
    }
    rest = (F.length(value) > 4, F.concat(F.substring(value, 1, 1), F.lit("***"), F.right(value, F.lit(2))), "***")
    usable, masked, otherwise = shown.get(category, rest)
    return F.when(value.isNull(), F.lit(None)).when(usable, masked).otherwise(F.lit(otherwise))


def scan(columns: list[str], legacy: bool = False) -> Column:
    """Messages, one for each column and pattern that matches; values that begin with *** are masked already. The
    legacy rule also passes over values of letters and digits alone, and so over a bare card number."""
    found = []
    for c in columns:
        usable = ~F.col(c).startswith("***")
        usable = usable & ~F.col(c).rlike(r"^[\p{L}\p{N}]+$") if legacy else usable
        found += [F.when(usable & F.col(c).rlike(p), F.lit(f"{c} may contain {kind}")) for kind, p in PATTERNS.items()]
    return F.array_compact(F.array(*found))


def scan_with_preview(columns: list[str]) -> Column:
    """Findings with the field, the kind and a preview of four characters."""
    found = [
        F.when(F.col(c).rlike(p), F.struct(F.lit(c).alias("field"), F.lit(kind).alias("pii_type"), F.concat(F.substring(c, 1, 4), F.lit("***")).alias("value_preview")))
        for c in columns
        for kind, p in PREVIEW_PATTERNS.items()
    ]
    return F.array_compact(F.array(*found))


def begins_with_pii(value: Column) -> Column:
    """Whether a feature's text begins with personal data."""
    return F.coalesce(value.rlike("^(?:" + "|".join(FEATURE_PATTERNS) + ")"), F.lit(False))


def url_safe(binary: Column) -> Column:
    return F.translate(F.base64(binary), "+/\r\n", "-_")


def encrypt(value: Column, key: Column) -> Column:
    """AES-GCM with a random nonce: nonce, ciphertext and tag as URL-safe base64. Not repeatable."""
    return url_safe(F.aes_encrypt(value.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT")))


def decrypt(token: Column, key: Column) -> Column:
    """Null for whatever isn't a token of that key."""
    return F.try_aes_decrypt(F.try_to_binary(F.translate(token, "-_", "+/"), F.lit("base64")), key, F.lit("GCM"), F.lit("DEFAULT")).cast("string")


#: Categories whose values keep their form if that is asked for.
WITH_FORMAT = ("account_number", "credit_card")


def tokenize(value: Column, category: str, key: Column, secret: bytes, deterministic: bool = True, preserve_format: bool = False) -> Column:
    """A token that equal values of a category share, so that it can be joined on: the nonce is a keyed hash of category
    and value. Without `deterministic` each token has a random nonce. With `preserve_format` account and card numbers
    have their digits shifted instead, which can't be turned back. Null and empty values are left as they are."""
    if preserve_format and category in WITH_FORMAT:
        return F.when(value != "", shift_digits(value, secret.hex())).otherwise(value)
    if not deterministic:
        return F.when(value != "", encrypt(value, key)).otherwise(value)
    nonce = F.unhex(F.substring(hmac_sha256(F.concat(F.lit(category + ":"), value), secret), 1, 24))
    token = url_safe(F.aes_encrypt(value.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), nonce))
    return F.when(value != "", token).otherwise(value)


def shift_digits(value: Column, key_hex: str) -> Column:
    """Format-preserving, one-way: the i-th digit moves on by the i-th hex digit of SHA-256(key:digits), modulo 10.
    Everything else stays in place."""
    digits = F.regexp_replace(value, r"[^0-9]", "")
    hashed = F.sha2(F.concat(F.lit(key_hex + ":"), digits), 256)
    characters = F.split(value, "")

    def step(state: Column, x: Column) -> Column:
        digit = x.rlike("^[0-9]$")
        move = F.conv(F.substr(hashed, F.pmod(state["i"], F.lit(64)) + 1, F.lit(1)), 16, 10).cast("int")
        moved = ((F.when(digit, x).otherwise("0").cast("int") + F.pmod(move, F.lit(10))) % 10).cast("string")
        return F.struct(F.concat(state["s"], F.when(digit, moved).otherwise(x)).alias("s"), (state["i"] + digit.cast("int")).alias("i"))

    return F.aggregate(characters, F.struct(F.lit("").alias("s"), F.lit(0).alias("i")), step, lambda s: s["s"])


def sanitize(df: DataFrame, direct: list[str], quasi: dict[str, str], key: Column, secret: bytes) -> DataFrame:
    """Direct identifiers become <column>_token, quasi-identifiers are masked by their category."""
    for c in direct:
        df = df.withColumn(f"{c}_token", tokenize(F.col(c), c, key, secret)).drop(c)
    return df.withColumns({c: mask(F.col(c), category) for c, category in quasi.items()})


def tokenize_fields(df: DataFrame, fields: list[str], categories: dict[str, str], key: Column, secret: bytes) -> DataFrame:
    """Tokens in place of the fields that `df` has; category CUSTOM where none is given."""
    return df.withColumns({c: tokenize(F.col(c), categories.get(c, "CUSTOM"), key, secret) for c in fields if c in df.columns})
