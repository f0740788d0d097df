"""Numbers, derived demand measures and inventory states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the inventory vocabulary.
NIGHT = "Night (00-05)"
DAY = "Day/evening (06-23)"
FLAGGED_OFF = "Flagged inactive/unavailable"
FLAGGED_ON = "Flagged active/available"
UNKNOWN_FLAGS = "Unknown flags"


def locale_number(text: Column) -> Column:
    """Comma decimals lose their thousands dots; plain text is read as it stands."""
    plain = F.when(
        F.contains(text, F.lit(",")), F.regexp_replace(F.regexp_replace(text, r"\.", ""), ",", ".")
    ).otherwise(text)
    return F.trim(plain).try_cast("double")


def lon_lat_text(text: Column) -> dict[str, Column]:
    """Coordinates from `"lon lat"` text; a comma may be the decimal mark."""
    parts = F.split(F.regexp_replace(F.trim(text), ",", "."), r"\s+")
    lon = F.get(parts, 0).try_cast("double")
    lat = F.get(parts, 1).try_cast("double")
    both = lon.isNotNull() & lat.isNotNull()
    return {"longitude": F.when(both, lon), "latitude": F.when(both, lat)}


def point_text(text: Column) -> dict[str, Column]:
    """Coordinates from GeoJSON-like text: ... coordinates: [lon, lat] ..."""
    pattern = r"coordinates['\"]?\s*:\s*[\[(]\s*(-?[0-9.]+)\s*,\s*(-?[0-9.]+)"
    return {
        "longitude": F.regexp_extract(text, pattern, 1).try_cast("double"),
        "latitude": F.regexp_extract(text, pattern, 2).try_cast("double"),
    }


def within_box(
    latitude: Column,
    longitude: Column,
    lat_range: tuple[float, float] = (-90.0, 90.0),
    lon_range: tuple[float, float] = (-180.0, 180.0),
    closed: bool = True,
) -> Column:
    """Inside a coordinate box; the whole globe by default, `closed=False` excludes the edges."""
    if closed:
        return latitude.between(*lat_range) & longitude.between(*lon_range)
    return (
        (latitude > lat_range[0])
        & (latitude < lat_range[1])
        & (longitude > lon_range[0])
        & (longitude < lon_range[1])
    )


def clip_zero(value: Column) -> Column:
    """Negative values become zero; null stays null (`greatest` alone would hide it)."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))


def percent_change(a: Column, b: Column) -> Column:
    return F.when(b > 0, (a / b - 1) * 100)


def seconds_to_minutes(seconds: Column) -> Column:
    return seconds.try_cast("double") / 60


def demand_measures(departures: Column, arrivals: Column) -> dict[str, Column]:
    return {
        "total_activity": departures + arrivals,
        "net_flow": arrivals - departures,
        "demand": departures,
    }


def day_period(time: Column) -> Column:
    return F.when(F.hour(time) < 6, NIGHT).otherwise(DAY)


def service_state(active: Column, unavailable: Column) -> Column:
    """A null flag never proves a state."""
    off = F.coalesce(active == 0, F.lit(False)) | F.coalesce(unavailable == 1, F.lit(False))
    on = F.coalesce(active == 1, F.lit(False)) & F.coalesce(unavailable == 0, F.lit(False))
    return F.when(off, FLAGGED_OFF).when(on, FLAGGED_ON).otherwise(UNKNOWN_FLAGS)


def occupancy_measures(bikes: Column, capacity: Column) -> dict[str, Column]:
    """Validity, ratio and the four extreme states; an invalid reading is in none of them."""
    valid = F.coalesce((capacity > 0) & (bikes >= 0) & (bikes <= capacity), F.lit(False))
    ratio = F.when(valid, bikes / capacity)
    return {
        "valid": valid,
        "ratio": ratio,
        "empty": valid & (bikes == 0),
        "full": valid & (bikes == capacity),
        "near_empty": valid & (ratio < 0.1),
        "near_full": valid & (ratio > 0.9),
    }


def replay_prediction(y_pred: Column) -> Column:
    """Served prediction: two decimals, never negative."""
    return F.when(y_pred.isNotNull(), F.greatest(F.bround(y_pred, 2), F.lit(0.0)))


def metrics_from_json(text: Column) -> Column:
    return F.from_json(text, "mae double, rmse double, r2 double, rows bigint")
