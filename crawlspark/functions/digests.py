"""SHA-1 digests in their hexadecimal and base32 spellings, JVM-side only."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlspark.functions.text import present

# Digits that conv() uses for base 32, and the RFC 4648 alphabet.
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

SLICES = 4  # 160 bits = 4 slices of 40 bits = 10 hex digits = 8 base32 digits


def sha1_hex(data: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.upper(F.sha1(data)))


def hex_to_base32(hex_digits: Column) -> Column:
    slices = [
        F.lpad(F.conv(F.substring(hex_digits, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(SLICES)
    ]
    return F.translate(F.concat(*slices), CONV_DIGITS, BASE32_DIGITS)


def base32_to_hex(base32_digits: Column) -> Column:
    plain = F.translate(F.upper(base32_digits), BASE32_DIGITS, CONV_DIGITS)
    return F.concat(
        *[F.lpad(F.conv(F.substring(plain, 1 + 8 * i, 8), 32, 16), 10, "0") for i in range(SLICES)]
    )


def sha1_base32(hex_digits: Column) -> Column:
    """Digest text for a SHA-1 already at hand as 40 hexadecimal digits."""
    return F.concat(F.lit("sha1:"), hex_to_base32(hex_digits))


def digest_hex(digest: Column) -> Column:
    """Upper-case hexadecimal digits of a ``sha1:`` digest in either spelling."""
    body = F.regexp_extract(digest, r"(?i)^sha1:(.*)$", 1)
    return F.when(body.rlike(r"(?i)^[0-9a-f]{40}$"), F.upper(body)).when(
        body.rlike(r"(?i)^[a-z2-7]{32}$"), base32_to_hex(body)
    )


def same_digest(left: Column, right: Column) -> Column:
    return F.coalesce(digest_hex(left) == digest_hex(right), F.lit(False))


def revisit_digest(payload_digest: Column, block_digest: Column) -> Column:
    """The digest that identifies a payload: payload digest, else block digest."""
    return F.coalesce(present(payload_digest), present(block_digest), F.lit(""))


def revisit_key(digest: Column, final_name: Column) -> Column:
    return F.concat(digest, F.lit(":"), final_name)
