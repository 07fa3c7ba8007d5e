"""Cleaning and taking apart of the feeds' texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.numbers import or_text


def municipality(name: Column) -> Column:
    """Without the building board's suffix, with 'novads' shortened."""
    bare = F.regexp_replace(or_text(name, "Unknown"), r"(?iu)\s+būvvalde$", "")
    return F.trim(F.regexp_replace(bare, r"(?iu)\s+novada$", " nov."))


def ship_parts(ship: Column) -> Column:
    """struct imo, mmsi, name of 'imo / mmsi / name'; a text with fewer parts is all name."""
    parts = F.split(ship, " / ")
    return F.struct(
        F.coalesce(F.get(parts, F.lit(0)), F.lit("")).alias("imo"),
        F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("mmsi"),
        or_text(F.get(parts, F.lit(2)), ship).alias("name"),
    )


# fixed values: letters besides A-Z that a search keeps
LETTERS = "āčēģīķļņōŗšūžĀČĒĢĪĶĻŅŌŖŠŪŽ"


def clean_query(text: Column, more: str = "") -> Column:
    """Word characters, blanks, hyphens and the letters above (and more), trimmed."""
    return F.regexp_replace(F.regexp_replace(text, rf"[^\w\s{LETTERS}\-{more}]", ""), r"^\s+|\s+$", "")


def client_ip(forwarded: Column, client: Column) -> Column:
    """The first forwarded address, else the client's, else 'unknown'."""
    return or_text(F.trim(F.get(F.split(forwarded, ","), F.lit(0))), or_text(client, "unknown"))


def principal(encoded: Column, schema: str = "userDetails string, identityProvider string, userId string") -> Column:
    """The JSON of a base64 header."""
    return F.from_json(F.try_to_binary(encoded, F.lit("base64")).cast("string"), schema)


def has_envelope(markup: Column) -> Column:
    """Whether a document has both an Envelope and a Cube element."""
    return markup.rlike(r"(?i)<\s*(?:\w+:)?Envelope\b") & markup.rlike(r"(?i)<\s*(?:\w+:)?Cube\b")
