"""Station identifiers, composite keys and row hashes."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_SEPARATOR = "\u001f"
_ESCAPE = "\u001e"
_NULL = _ESCAPE + "2"


def positive_station(text: Column) -> Column:
    """The identifier as a whole positive number, or null; also null beyond 64 bits."""
    number = F.trim(text.cast("string")).try_cast("double")
    usable = (number > 0) & ~F.isnan(number) & (number % 1 == 0)
    return F.when(usable, number.try_cast("bigint"))


def opaque_station(text: Column) -> Column:
    """Trimmed identifier kept as text, or null when blank."""
    trimmed = F.trim(text)
    return F.when(trimmed != "", trimmed)


def normalized_station(text: Column) -> Column:
    """Digits lose leading zeros, blank and `nan` become '', everything else is only trimmed."""
    trimmed = F.trim(F.coalesce(text.cast("string"), F.lit("")))
    return (
        F.when(F.lower(trimmed) == "nan", F.lit(""))
        .when(trimmed.rlike("^[0-9]+$"), F.regexp_replace(trimmed, "^0+(?=.)", ""))
        .otherwise(trimmed)
    )


def station_without_decimal(text: Column) -> Column:
    """Trim and drop one trailing `.0`."""
    return F.regexp_replace(F.trim(text.cast("string")), r"\.0$", "")


def normalized_header(name: str) -> str:
    """Header names compared on lower-case letters and digits only."""
    return re.sub(r"[^a-z0-9]+", "", (name or "").strip().lower())


def station_instance(provider: Column, network: Column, station: Column) -> Column:
    return F.concat_ws(":", provider, network, station)


def row_key(*parts: Column) -> Column:
    """One text key; joins inside this library use the columns themselves.

    Null has its own mark and the separator is escaped inside a part, so unlike keys never meet.
    """

    def encoded(part: Column) -> Column:
        text = F.replace(part.cast("string"), F.lit(_ESCAPE), F.lit(_ESCAPE + "0"))
        return F.coalesce(F.replace(text, F.lit(KEY_SEPARATOR), F.lit(_ESCAPE + "1")), F.lit(_NULL))

    return F.concat_ws(KEY_SEPARATOR, *[encoded(p) for p in parts])


def split_row_key(key: Column, names: Iterable[str]) -> list[Column]:
    pieces = F.split(key, KEY_SEPARATOR, -1)

    def decoded(piece: Column) -> Column:
        text = F.replace(piece, F.lit(_ESCAPE + "1"), F.lit(KEY_SEPARATOR))
        return F.when(piece != _NULL, F.replace(text, F.lit(_ESCAPE + "0"), F.lit(_ESCAPE)))

    return [decoded(pieces[i]).alias(name) for i, name in enumerate(names)]


def row_hash(*parts: Column) -> Column:
    """SHA-256 of the |-joined text; a null part is the empty text."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def export_key(station: Column) -> Column:
    """File-system safe name of a station export."""
    return F.sha2(station.cast("string"), 256)


def station_codes(stations: DataFrame, station: str = "station") -> DataFrame:
    """(station, station_code): position of each distinct id in text order, from zero.

    Ranks within sampled ranges of the ids and adds the count of earlier ranges, so no task
    holds all identifiers, however alike they begin.
    """
    from stationflow.operators.sequences import with_global_rank

    distinct = stations.select(F.col(station).cast("string").alias(station)).distinct()
    ranked = with_global_rank(distinct, [station], name="station_code")
    return ranked.withColumn("station_code", F.col("station_code") - 1)
