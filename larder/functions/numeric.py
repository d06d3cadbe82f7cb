"""Scalar functions over numbers, vectors and probed facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, host_of, lookup

# Factors of the units of a quantity.
UNITS = {"": 1.0, "b": 1.0, "kb": 1024.0, "k": 1024.0, "mb": 1024.0**2, "m": 1024.0**2, "gb": 1024.0**3, "g": 1024.0**3, "s": 1.0, "ms": 0.001, "db": 1.0, "khz": 1000.0, "kbps": 1000.0}
#: Levels: the floor of a level in decibels, a clipping peak, a silent one; and the seconds of an effect and of music.
FLOOR_DB, CLIPPING_DB, SILENT_DB, SFX_SECONDS, MUSIC_SECONDS = -96.0, -0.1, -40.0, 2.0, 30.0
#: Most triangles of a low-poly mesh; most colours of a picture kept without loss; the box of a rendition.
LOW_POLY, LOSSLESS_COLOURS, BOX = 2000, 256, 256


def quantity(c: str | Column) -> Column:
    """A number with a unit as a double: 1mb, 192kbps, -6db, 250ms; null if it is none."""
    text, form = F.trim(_col(c)), r"^(-?[0-9]*\.?[0-9]+)\s*([A-Za-z]*)$"
    factor = F.try_element_at(F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair]), F.lower(F.regexp_extract(text, form, 2)))
    return F.regexp_extract(text, form, 1).try_cast("double") * factor


def to_db(c: str | Column) -> Column:
    """An amplitude ratio in decibels, not below the floor, two places."""
    x = _col(c)
    return F.when(x > 0, F.round(F.greatest(F.lit(FLOOR_DB), 20 * F.log10(x)), 2)).otherwise(F.lit(FLOOR_DB))


def first_positive(*cols: str | Column) -> Column:
    """The first that is neither null nor zero."""
    return F.coalesce(*[F.nullif(_col(c), F.lit(0)) for c in cols])


def hamming(a: str | Column, b: str | Column) -> Column:
    """Differing bits of two 64-bit hashes."""
    return F.bit_count(_col(a).bitwiseXOR(_col(b)))


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product in doubles."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: str | Column) -> Column:
    return F.sqrt(dot(v, v))


def l2(v: str | Column) -> Column:
    """A vector of unit length; a zero vector stays."""
    return F.transform(_col(v), lambda x: x.cast("double") / F.coalesce(F.nullif(norm(v), F.lit(0.0)), F.lit(1.0)))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of two vectors, null if one is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def duration_tag(seconds: str | Column) -> Column:
    """sfx, music or null."""
    x = _col(seconds)
    return F.when(x <= SFX_SECONDS, "sfx").when(x >= MUSIC_SECONDS, "music")


def geometry_tags(triangles: Column, bones: Column, animations: Column) -> Column:
    """Tags of a mesh's facts, in an array."""
    each = [F.when(bones > 0, "rigged"), F.when(animations > 0, "animation"), F.when((triangles > 0) & (triangles <= LOW_POLY), "low-poly")]
    return F.array_compact(F.array(*each))


def rendition(width: Column, height: Column, colours: Column, box: int = BOX) -> Column:
    """struct(skip, width, height, method, lossless) of the picture that fits the box."""
    edge = F.greatest(width, height)
    factor = edge / F.lit(float(box))
    nearest = (F.abs(factor - F.rint(factor)) < 0.01) & (F.rint(factor) > 1)
    fit = lambda side: F.when(edge <= box, side.cast("bigint")).otherwise(F.greatest(F.lit(1), F.rint(side * box / edge)).cast("bigint"))
    return F.struct((edge <= box).alias("skip"), fit(width).alias("width"), fit(height).alias("height"), F.when(edge <= box, "none").when(nearest, "nearest").otherwise("lanczos").alias("method"), (colours <= LOSSLESS_COLOURS).alias("lossless"))


def shape(kind: Column, values: Column, host: Column) -> Column:
    """One line on an item's shape from its kind and a map of its numbers."""
    v = lambda k: F.try_element_at(values, F.lit(k))
    whole = lambda x: F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))
    level = F.rint(v("peak_db")).cast("bigint")
    audio = F.concat_ws(" ", F.concat(F.call_function("format_number", v("duration"), F.lit("0.0")), F.lit("s")), F.when(v("channels") == 1, "mono").when(v("channels") != 0, "stereo"), F.concat(level.cast("string"), F.lit("dB")))
    return F.coalesce(F.when(kind == "reference", host).when(kind == "image", F.concat(whole(v("width")), F.lit("x"), whole(v("height")))).when(kind == "model3d", F.concat(whole(v("triangles")), F.lit(" tris"))).when((kind == "audio") & v("duration").isNotNull(), audio), F.lit(""))


_MEDIA = "streams array<struct<codec_type:string,codec_name:string,duration:string,bit_rate:string,sample_rate:string,channels:int,bits_per_sample:int,bits_per_raw_sample:string>>, format struct<duration:string,bit_rate:string>"


def media_facts(c: str | Column) -> Column:
    """struct of duration, sample_rate, channels, bit_depth, bitrate, codec and error from a media probe's JSON."""
    doc = F.from_json(_col(c), _MEDIA)
    s = F.try_element_at(F.filter(doc["streams"], lambda x: x["codec_type"] == "audio"), F.lit(1))
    number = lambda x, kind: F.nullif(x, F.lit("")).try_cast(kind)
    return F.struct(
        F.when(s.isNotNull(), F.round(F.coalesce(number(s["duration"], "double"), number(doc["format"]["duration"], "double")), 3)).alias("duration"),
        number(s["sample_rate"], "bigint").alias("sample_rate"), s["channels"].cast("bigint").alias("channels"),
        first_positive(s["bits_per_sample"].cast("bigint"), number(s["bits_per_raw_sample"], "bigint")).alias("bit_depth"),
        F.when(s.isNotNull(), F.coalesce(number(s["bit_rate"], "bigint"), number(doc["format"]["bit_rate"], "bigint"))).alias("bitrate"),
        s["codec_name"].alias("codec"), F.when(s.isNull(), "no audio stream").alias("error"),
    )


__all__ = ["cosine", "dot", "duration_tag", "first_positive", "geometry_tags", "hamming", "host_of", "l2", "lookup", "media_facts", "norm", "quantity", "rendition", "shape", "to_db"]


def write_stamp(at: Column | None = None) -> Column:
    """A moment (a UTC timestamp without zone; none: now, the same for a whole query) as text in UTC with microseconds."""
    moment = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz") if at is None else at
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
