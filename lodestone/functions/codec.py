"""The EMV payment-code codec: tag-length-value framing, CRC-16, parse, validate and encode.

Framing counts bytes and nests, which built-in functions cannot express; it runs
in Arrow-batched pandas functions. Validation and encoding are expressions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT = ("key", "url", "description", "merchant_name", "city", "amount", "txid")
PAYLOAD = T.StructType([*(T.StructField(n, T.StringType()) for n in _TEXT), T.StructField("dynamic", T.BooleanType()), T.StructField("crc", T.StringType()), T.StructField("crc_valid", T.BooleanType()), T.StructField("error", T.StringType())])
FIELDS = T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("val", T.StringType())]))
#: The scheme's identifier, category, currency and country.
GUI, CATEGORY, CURRENCY, COUNTRY = "br.gov.bcb.pix", "0000", "986", "BR"


def _remainders() -> list[int]:
    """What each byte leaves on division by the polynomial 0x1021."""
    out = []
    for crc in range(0, 1 << 16, 1 << 8):
        for _ in range(8):
            crc = (crc << 1 ^ 0x1021 if crc & 0x8000 else crc << 1) & 0xFFFF
        out.append(crc)
    return out


REMAINDERS = _remainders()


def crc16(data: bytes) -> int:
    """CRC-16 with polynomial 0x1021 and start 0xFFFF, byte by byte."""
    crc = 0xFFFF
    for byte in data:
        crc = (crc << 8 & 0xFFFF) ^ REMAINDERS[crc >> 8 ^ byte]
    return crc


def split_fields(data: bytes) -> list[tuple[str, bytes]]:
    """(id, value) of each field; ValueError if the framing is broken."""
    out, at = [], 0
    while at < len(data):
        head = data[at : at + 4]
        if len(head) < 4 or not head[2:].isdigit():
            raise ValueError(f"no field header at byte {at}")
        size = int(head[2:])
        if at + 4 + size > len(data):
            raise ValueError(f"field {head[:2].decode(errors='replace')} is longer than the code")
        out.append((head[:2].decode(errors="replace"), data[at + 4 : at + 4 + size]))
        at += 4 + size
    return out


def parse_code(code: str | None) -> dict:
    """The payload of one code. Broken framing gives an error; a wrong CRC only crc_valid false."""
    out = dict.fromkeys(("key", "url", "description", "merchant_name", "city", "amount", "txid", "crc"), "") | {"dynamic": False, "crc_valid": False, "error": None}
    raw = (code or "").strip().encode()
    try:
        first = lambda fields, k: next((v for i, v in fields if i == k), b"")
        top = split_fields(raw)
        account, more = split_fields(first(top, "26")), split_fields(first(top, "62"))
    except ValueError as e:
        return out | {"error": str(e)}
    text = lambda b: b.decode(errors="replace")
    out |= {"dynamic": first(top, "01") == b"12", "merchant_name": text(first(top, "59")), "city": text(first(top, "60")), "amount": text(first(top, "54")), "key": text(first(account, "01")), "url": text(first(account, "25")), "description": text(first(account, "02")), "txid": text(first(more, "05")), "crc": text(first(top, "63")).upper()}
    at = len(raw) - 8  # the CRC is the last field; its own digits may read 6304
    return out | {"crc_valid": top[-1:] != [] and top[-1][0] == "63" and raw[at : at + 4] == b"6304" and out["crc"] == f"{crc16(raw[: at + 4]):04X}"}


@F.pandas_udf(PAYLOAD)
def parse(codes: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_code(c) for c in codes], columns=PAYLOAD.names)


@F.pandas_udf(T.StringType())
def checksum(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else f"{crc16(t.encode()):04X}")


@F.pandas_udf(FIELDS)
def fields(codes: pd.Series) -> pd.Series:
    def one(code):
        try:
            return [{"id": i, "val": v.decode(errors="replace")} for i, v in split_fields((code or "").encode())]
        except ValueError:
            return None

    return codes.map(one)


def invalid_reason(p: dict[str, Column]) -> Column:
    """Why a payload (key, url, description, merchant_name, city, amount, txid) cannot be encoded; null if it can."""
    blank = lambda c: F.trim(F.coalesce(p[c], F.lit(""))) == ""
    given = lambda c: F.coalesce(p[c], F.lit("")) != ""
    out = F.when(blank("key") & blank("url"), "a key or a url is required").when(given("key") & given("url"), "key and url exclude each other").when(blank("merchant_name") | blank("city"), "merchant_name and city are required")
    out = out.when(F.octet_length(p["merchant_name"]) > 25, "merchant_name exceeds 25 bytes").when(F.octet_length(p["city"]) > 15, "city exceeds 15 bytes").when(given("amount") & ~p["amount"].rlike("^[0-9]+(\\.[0-9]{1,2})?$"), "amount is not a decimal with up to two places")
    for name in ("key", "url", "description", "merchant_name", "city", "txid"):
        out = out.when(given(name) & ~p[name].rlike("^[ -~]*$"), f"{name} has other characters than printable ASCII")
    return out


def encode(p: dict[str, Column], initiation_point: bool = True) -> Column:
    """The code of a valid payload; null for others and for values over 99 bytes."""
    field = lambda i, v: F.concat(F.lit(i), F.lpad(F.octet_length(v).cast("string"), 2, "0"), v)
    some = lambda c: F.coalesce(p[c], F.lit(""))
    detail = F.when(some("url") != "", field("25", some("url"))).otherwise(F.concat(field("01", some("key")), F.when(some("description") != "", field("02", some("description"))).otherwise("")))
    account, more = F.concat(field("00", F.lit(GUI)), detail), field("05", F.when(some("txid") == "", "***").otherwise(some("txid")))
    point = F.when(some("url") != "", "010212").otherwise("010211" if initiation_point else "")
    body = F.concat(F.lit("000201"), point, field("26", account), field("52", F.lit(CATEGORY)), field("53", F.lit(CURRENCY)), F.when(some("amount") != "", field("54", some("amount"))).otherwise(""), field("58", F.lit(COUNTRY)), field("59", some("merchant_name")), field("60", some("city")), field("62", more), F.lit("6304"))
    fits = (F.octet_length(account) <= 99) & (F.octet_length(more) <= 99)
    return F.when(invalid_reason(p).isNull() & fits, F.concat(body, checksum(body)))


def check_codes(df: DataFrame, column: str = "code") -> DataFrame:
    """``df`` with the parsed payload, and whether framing and CRC are right."""
    out = df.withColumn("payload", parse(column))
    return out.withColumn("valid", F.col("payload.error").isNull() & F.col("payload.crc_valid"))
