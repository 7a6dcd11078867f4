"""Signed session tokens as Columns: base64url(json).base64url(hmac-sha256)."""

from __future__ import annotations

import base64
import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from brevier.functions.text import column


def base64_url(data: Column) -> Column:
    plain = F.regexp_replace(F.base64(data), r"[\r\n=]", "")
    return F.translate(plain, "+/", "-_")


def signature(text: Column, secret: str) -> Column:
    """HMAC-SHA256 in base64url, by an Arrow batch function: Spark has none of its own."""

    @F.pandas_udf("string")
    def sign(values: pd.Series) -> pd.Series:
        def one(v):
            digest = hmac.new(secret.encode(), v.encode(), hashlib.sha256).digest()
            return base64.urlsafe_b64encode(digest).rstrip(b"=").decode()

        return values.map(lambda v: None if v is None else one(v))

    return sign(text)


def sign_token(payload: Column | str, secret: str) -> Column:
    """A token for a JSON payload."""
    head = base64_url(column(payload).cast("binary"))
    return F.concat(head, F.lit("."), signature(head, secret))


def verify_token(token: Column | str, secret: str, now_ms: int) -> Column:
    """The payload of a token of two parts whose signature holds and whose numeric exp is not past; else null."""
    parts = F.split(column(token), r"\.", -1)
    head = F.get(parts, F.lit(0))
    padded = F.rpad(F.translate(head, "-_", "+/"), (F.ceil(F.length(head) / 4) * 4).cast("int"), F.lit("="))
    payload = F.try_to_binary(padded, F.lit("base64")).cast("string")
    expires = F.get_json_object(payload, "$.exp").try_cast("double")
    holds = (F.size(parts) == 2) & (F.get(parts, F.lit(1)) == signature(head, secret)) & (expires >= now_ms)
    return F.when(F.coalesce(holds, F.lit(False)), payload)


def parse_users(text: Column | str) -> Column:
    """name:password pairs, split by commas; the first colon divides, and an empty password drops a pair."""
    pairs = F.transform(F.split(column(text), ","), lambda p: F.trim(p))
    cut = F.transform(
        F.filter(pairs, lambda p: F.contains(p, F.lit(":"))),
        lambda p: F.struct(
            F.trim(F.substring_index(p, ":", 1)).alias("name"), F.regexp_replace(p, r"(?s)^[^:]*:", "").alias("password")
        ),
    )
    return F.filter(cut, lambda u: u["password"] != "")
