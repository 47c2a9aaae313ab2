"""Times, numbers, arrays, lookups and codes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import md5_div_modulo, md5_modulo

#: The layouts of times in the tables (dates before months with and without seconds), and of
#: camera metadata.
TIME_LAYOUTS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm")
EXIF_LAYOUTS = ("yyyy:MM:dd HH:mm:ss", "yyyy:MM:dd HH:mm")

#: Offence, section, category, least and greatest severity in years.
OFFENCES = (
    ("Rape", "BNS Section 63", "Women/Children", 3, 7),
    ("Sexual Harassment", "BNS Section 75", "Women/Children", 1, 3),
    ("Stalking", "BNS Section 78", "Women/Children", 1, 4),
    ("Dowry Death", "BNS Section 80", "Women/Children", 4, 10),
    ("Kidnapping of Minor", "BNS Section 137", "Women/Children", 1, 3),
    ("Child Trafficking", "BNS Section 143", "Women/Children", 5, 14),
    ("Murder", "BNS Section 103(1)", "Violent", 5, 12),
    ("Attempt to Murder", "BNS Section 109", "Violent", 2, 6),
    ("Grievous Hurt", "BNS Section 117", "Violent", 1, 5),
    ("Acid Attack", "BNS Section 124", "Violent", 2, 7),
    ("Mob Lynching", "BNS Section 103(2)", "Violent", 3, 9),
    ("Theft", "BNS Section 303", "Property", 1, 2),
    ("Snatching", "BNS Section 304", "Property", 1, 3),
    ("Robbery", "BNS Section 309", "Property", 1, 4),
    ("Dacoity", "BNS Section 310", "Property", 2, 6),
    ("Extortion", "BNS Section 308", "Property", 3, 7),
    ("Criminal Breach of Trust", "BNS Section 316", "Financial", 2, 8),
    ("Cyber Fraud", "BNS Section 318(4)", "Cyber", 2, 8),
    ("Organized Crime Syndicate", "BNS Section 111", "Organized", 7, 15),
    ("Petty Organized Crime", "BNS Section 112", "Organized", 3, 8),
    ("Terrorist Act", "BNS Section 113", "State/Terror", 10, 30),
)
#: Place, latitude, longitude; the first that fits wins.
PLACES = (
    ("thane", 19.2183, 72.9781),
    ("panvel", 18.9894, 73.1175),
    ("belapur", 19.0176, 73.0357),
    ("seawoods", 19.0187, 73.0175),
    ("khandeshwar", 19.0245, 73.0680),
    ("kharghar", 19.0474, 73.0669),
    ("airoli", 19.1550, 72.9986),
    ("kalyan", 19.2437, 73.1355),
    ("nerul", 19.0330, 73.0297),
    ("vashi", 19.0771, 72.9986),
    ("dadar", 19.0184, 72.8425),
    ("andheri", 19.1197, 72.8697),
    ("lower parel", 19.0000, 72.8300),
    ("vashi toll plaza", 19.0700, 72.9990),
    ("khalapur", 18.7906, 73.2907),
    ("urse", 18.7300, 73.5390),
    ("khed toll plaza", 18.0167, 73.3833),
    ("mumbai", 19.0760, 72.8777),
    ("navi mumbai", 19.0330, 73.0297),
)
#: The box in which unknown places are put.
BOX = ((18.90, 19.25), (72.85, 73.15))


def parse_time(c: Column, layouts: tuple[str, ...] = TIME_LAYOUTS) -> Column:
    """The first layout that fits; null for none, never an error."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(x)) for x in layouts])


def micros(ts: Column) -> Column:
    """Microseconds since 1970, of a time with or without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def days_before(ts: Column, n: Column) -> Column:
    return ts - F.make_interval(days=n)


def gap_minutes(a: Column, b: Column) -> Column:
    return F.round((micros(b) - micros(a)) / 60_000_000.0, 1)


def log2_weight(m: float, u: float) -> tuple[float, float]:
    """Fellegi-Sunter weights for agreement and disagreement."""
    import math

    return math.log2(m / u), math.log2((1 - m) / (1 - u))


def clip(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def safe_float(c: Column) -> Column:
    return F.coalesce(c.cast("string").try_cast("double"), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def severity(score: Column) -> Column:
    return F.when(score >= 85, "CRITICAL").when(score >= 70, "HIGH").when(score >= 55, "MEDIUM").otherwise("LOW")


def risk_tier(score: Column) -> Column:
    return F.when(score >= 70, "CRITICAL").when(score >= 40, "HIGH").when(score >= 15, "MEDIUM").otherwise("LOW")


def lookup(c: Column, pairs: dict[str, str], default: str) -> Column:
    """Value of a small fixed table, or the default."""
    if not pairs:
        return F.lit(default)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in pairs.items() for x in p]), c), F.lit(default))


def offence_category(c: Column) -> Column:
    return lookup(c, {o[0]: o[2] for o in OFFENCES}, "Other")


def offence_of_section(c: Column) -> Column:
    """Offence of the section number in a text; of two offences of one number the last."""
    numbers = {"".join(ch for ch in o[1].split("(")[0] if ch.isdigit()): o[0] for o in OFFENCES}
    return lookup(F.coalesce(F.regexp_extract(c, r"\b(\d{1,3})\b", 1), F.lit("")), numbers, "")


def coordinates(c: Column, salt: Column | None = None) -> Column:
    """A place's point: that of the first known place of which one name contains the other, else
    one in the box from the name's MD5; both moved a little by the MD5 of name and salt."""
    key = F.lower(F.trim(F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))))
    (la, lb), (oa, ob) = BOX
    lat = la + md5_modulo(key, 1000) / 1000.0 * (lb - la)
    lon = oa + md5_div_modulo(key, 1000, 1000) / 1000.0 * (ob - oa)
    fits = lambda name: F.contains(key, F.lit(name)) | F.contains(F.lit(name), key)
    first, *rest = PLACES
    known_lat, known_lon = F.when(fits(first[0]), first[1]), F.when(fits(first[0]), first[2])
    for name, a, b in rest:
        known_lat, known_lon = known_lat.when(fits(name), a), known_lon.when(fits(name), b)
    salted = F.concat(key, salt if salt is not None else F.lit(""))
    move = lambda x: (x - 120) / 100000.0 * 5
    return F.struct(
        (F.coalesce(known_lat, lat) + move(md5_modulo(salted, 240))).alias("lat"),
        (F.coalesce(known_lon, lon) + move(md5_div_modulo(salted, 240, 240))).alias("lon"),
    )


def gps(c: Column) -> Column:
    """``'19.06 N, 72.90 E'`` to a struct of degrees; null if it does not fit."""
    p = r"^\s*([\d.]+)\s*N\s*,\s*([\d.]+)\s*E"
    return F.when(
        F.regexp_like(c, F.lit(p)),
        F.struct(F.regexp_extract(c, p, 1).try_cast("double").alias("lat"), F.regexp_extract(c, p, 2).try_cast("double").alias("lon")),
    )


def decimal_degrees(d: Column, m: Column, s: Column, hemisphere: Column) -> Column:
    return F.round(F.when(F.upper(hemisphere).isin("S", "W"), -1.0).otherwise(1.0) * (d + m / 60.0 + s / 3600.0), 6)


def exif_time(c: Column) -> Column:
    return F.concat(F.date_format(parse_time(c, EXIF_LAYOUTS), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def edited_by(c: Column) -> Column:
    return F.coalesce(F.regexp_like(c, F.lit("(?i)photoshop|gimp|lightroom|paint|edit")), F.lit(False))


def vulnerability(age: Column, gender: Column, crime: Column) -> Column:
    return (
        F.when((age < 18) | crime.isin("Kidnapping of Minor", "Child Trafficking"), "Crime Against Child")
        .when((gender == "Female") | crime.isin("Rape", "Sexual Harassment", "Stalking", "Dowry Death"), "Crime Against Women")
        .when(age >= 60, "Crime Against Elderly")
        .otherwise("General Offense")
    )
