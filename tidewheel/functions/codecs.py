"""Text forms of ids, maps, durations and instants."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def encode_map(column: Column) -> Column:
    """A map as sorted, URL-encoded key=value pairs."""
    pairs = F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(e["value"])))
    return F.array_join(pairs, "&")


def decode_map(text: Column) -> Column:
    """The map of an encoded text; the empty text is the empty map."""
    pairs = F.transform(F.filter(F.split(text, "&"), lambda p: p != ""), lambda p: F.struct(F.url_decode(F.substring_index(p, "=", 1)), F.url_decode(F.substr(p, F.length(F.substring_index(p, "=", 1)) + 2))))
    return F.map_from_entries(pairs)


def instant_text(time: Column) -> Column:
    """ISO text of a UTC time; the fraction has none, three or six digits."""
    micros = F.date_format(time, "SSSSSS")
    fraction = F.when(micros == "000000", "").when(micros.endswith("000"), F.concat(F.lit("."), F.substring(micros, 1, 3))).otherwise(F.concat(F.lit("."), micros))
    return F.concat(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))


def duration_ms(text: Column) -> Column:
    """Milliseconds of an ISO duration of days, hours, minutes and seconds."""
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(text, rf"(-?[0-9.]+){unit}", 1), F.lit("")).cast("double"), F.lit(0.0))
    return F.round(1000 * (86400 * part("D") + 3600 * part("H") + 60 * part("M") + part("S"))).cast("long")


def encode_snapshot(column: Column) -> Column:
    """A map as a versioned JSON envelope with a base64url payload without padding."""
    payload = F.rtrim(F.translate(F.base64(F.encode(encode_map(column), "UTF-8")), "+/\r\n", "-_"), F.lit("="))
    return F.concat(F.lit('{"schemaVersion":1,"payload":"'), payload, F.lit('"}'))


def decode_snapshot(text: Column) -> Column:
    """The map of an envelope, or of the plain form from before envelopes; null for another version."""
    payload = F.translate(F.get_json_object(text, "$.payload"), "-_", "+/")
    padded = F.rpad(payload, (F.ceil(F.length(payload) / 4) * 4).cast("int"), F.lit("="))
    inner = F.decode(F.unbase64(padded), "UTF-8")
    known = F.get_json_object(text, "$.schemaVersion") == "1"
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", decode_map(F.lit(""))).when(~F.trim(text).startswith("{"), decode_map(text)).when(known, decode_map(inner))
