"""Row shaping for responses: addresses, JSON, cookies, numbers and layout flags as column expressions."""

from __future__ import annotations

import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the response format.
LONG_HOST, SHORT_HOST = "https://reddit.com/", "https://redd.it/"
WIDTHS = (320, 640, 1280)
FORMATS = {"jpeg": "jpg", "webp": "webp"}
DEFAULT_PREFIX = "https://images.example.org"
DEFAULT_FILENAME = "cover"


def rewrite_source(source: Column) -> Column:
    """The short host for addresses on the long one; null becomes empty text."""
    return F.when(source.startswith(LONG_HOST), F.concat(F.lit(SHORT_HOST), F.substr(source, F.lit(len(LONG_HOST) + 1)))).otherwise(F.coalesce(source, F.lit("")))


def original_url(id_: Column, extension: Column, prefix: str = DEFAULT_PREFIX) -> Column:
    return F.concat(F.lit(f"{prefix}/original/"), id_.cast("string"), F.lit("."), extension)


def resized_urls(id_: Column, kind: str, prefix: str = DEFAULT_PREFIX) -> Column:
    """Struct of one address per width."""
    return F.struct(*[F.concat(F.lit(f"{prefix}/{kind}/{w}/"), id_.cast("string"), F.lit(f".{FORMATS[kind]}")).alias(str(w)) for w in WIDTHS])


def shaped(id_: Column, source: Column, extension: Column, prefix: str = DEFAULT_PREFIX, **optional: Column) -> Column:
    """The response record; optional fields that are null are absent from its JSON."""
    return F.struct(id_.alias("id"), original_url(id_, extension, prefix).alias("url"), rewrite_source(source).alias("source"), *[resized_urls(id_, k, prefix).alias(k) for k in FORMATS], *[c.alias(n) for n, c in optional.items()])


def filename(url: Column) -> Column:
    """Last segment of a path, or the default name."""
    last = F.element_at(F.split(url, "/"), -1)
    return F.when(F.coalesce(F.length(last), F.lit(0)) > 0, last).otherwise(F.lit(DEFAULT_FILENAME))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Share in percent; NaN of nothing."""
    return F.when(whole == 0, F.lit(float("nan"))).otherwise(F.round(part / F.when(whole != 0, whole) * 100, digits))


def wide_cell(index: Column, large: bool) -> Column:
    """Which places of the gallery take two cells: in rows of fifteen on large screens, of seven on medium ones."""
    return (index % 15).isin(1, 9, 10) if large else index % 7 == 3


def shadow(h: Column, s: Column, l: Column) -> Column:  # noqa: E741
    """A CSS colour darker than the given one."""
    n = lambda c: F.round(c, 1).cast("string")
    return F.concat(F.lit("hsla("), n(h), F.lit(", "), n(s), F.lit("%, "), n(l * 0.6), F.lit("%, 1)"))


def encode_cookie(session_id: Column, username: Column) -> Column:
    return F.base64(F.encode(F.to_json(F.struct(session_id.cast("string").alias("sessionId"), username.alias("username"))), "UTF-8"))


def decode_cookie(cookie: Column) -> Column:
    """Struct of sessionId and username; null for what is no such cookie."""
    text = F.decode(F.try_to_binary(cookie, F.lit("base64")), "UTF-8")
    parsed = F.from_json(text, "struct<sessionId:string,username:string>")
    return F.when(parsed["sessionId"].isNotNull() & parsed["username"].isNotNull(), parsed)


def is_uuid(text: Column) -> Column:
    return text.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")


def parse_bool(text: Column) -> Column:
    """true and false by name; null for anything else."""
    return F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False))


def parse_number(text: Column) -> Column:
    return text.try_cast("double")


def token(n_bytes: int = 32) -> str:
    """A random session token in hex."""
    return secrets.token_hex(n_bytes)


def quote_ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def quote_literal(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strip_view_tail(sql: Column) -> Column:
    """A view's text without a closing WITH [NO] DATA and semicolon."""
    return F.regexp_replace(F.regexp_replace(sql, r"(?i)\s+with\s+(no\s+)?data\s*;?\s*$", ""), r";\s*$", "")
