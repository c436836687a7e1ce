"""HMAC-SHA256 of binary columns, with built-in functions only, and the codes of a bridge's frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the construction: bytes of a block, and what the two keys are mixed with.
BLOCK, INNER, OUTER = 64, 0x36, 0x5C
#: Fixed: the byte that tells a request from a reply, and that of a reply without a verdict.
REQUEST, REPLY, NO_VERDICT = b"\x01", b"\x02", b"\xff"


def _mixed(hexadecimal: Column, byte: int) -> Column:
    """A block's hexadecimal digits, each byte xored. A digit's xor is a digit for a digit, so a translation of all first and one of all second digits do it."""
    table = lambda k: "".join(f"{i ^ k:X}" for i in range(16))
    digits = "0123456789ABCDEF"
    pairs = F.transform(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda i: F.concat(F.translate(F.substring(hexadecimal, i * 2 + 1, F.lit(1)), digits, table(byte >> 4)), F.translate(F.substring(hexadecimal, i * 2 + 2, F.lit(1)), digits, table(byte & 15))))
    return F.unhex(F.array_join(pairs, ""))


def hmac_sha256(key: Column, message: Column) -> Column:
    """Binary code of a binary message under a binary key; a key over 64 bytes is hashed first. Null for a null key or message."""
    short = F.when(F.octet_length(key) > BLOCK, F.unhex(F.sha2(key, 256))).otherwise(key)
    block = F.rpad(F.hex(short), 2 * BLOCK, "0")
    inside = F.unhex(F.sha2(F.concat(_mixed(block, INNER), message), 256))
    return F.unhex(F.sha2(F.concat(_mixed(block, OUTER), inside), 256))


def little_endian(n: Column) -> Column:
    """The low four bytes of a whole number, least first."""
    h = F.lpad(F.hex(n.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]))


def _sized(text: Column) -> Column:
    raw = F.encode(F.coalesce(text, F.lit("")), "utf-8")
    return F.concat(little_endian(F.octet_length(raw)), raw)


def _nonce(nonce: Column) -> Column:
    """Bytes of a hexadecimal nonce; null where it is empty or no hexadecimal."""
    return F.when((nonce != "") & (F.length(nonce) % 2 == 0) & nonce.rlike("^[0-9A-Fa-f]+$"), F.unhex(nonce))


def request_mac(secret: Column, nonce: Column, number: Column, kind: Column, content: Column) -> Column:
    """Lower-case hexadecimal code of a request: nonce, direction, number, kind and content, each text after its size. Null texts are empty; null without a nonce."""
    framed = F.concat(_nonce(nonce), F.lit(REQUEST), little_endian(number), _sized(kind), _sized(content))
    return F.lower(F.hex(hmac_sha256(F.encode(secret, "utf-8"), framed)))


def reply_mac(secret: Column, nonce: Column, number: Column, kind: Column, blocked: Column, token: Column, error: Column) -> Column:
    """The same of a reply, with its verdict (null: none), the token it hands out and its error."""
    verdict = F.when(blocked, F.lit(b"\x01")).when(~blocked, F.lit(b"\x00")).otherwise(F.lit(NO_VERDICT))
    framed = F.concat(_nonce(nonce), F.lit(REPLY), little_endian(number), _sized(kind), verdict, _sized(token), _sized(error))
    return F.lower(F.hex(hmac_sha256(F.encode(secret, "utf-8"), framed)))
