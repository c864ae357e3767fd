"""Column functions on media attributes: shapes, kinds, names, places, times and layouts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of each kind of media.
VIDEO = ("mp4", "mov", "m4v", "mkv", "avi", "mts", "insv", "lrv")
IMAGE = ("jpg", "jpeg", "png", "heic", "heif", "dng", "tif", "tiff", "webp", "gif")


def shape(width: Column, height: Column, orientation: Column | None = None) -> Column:
    """square within one pixel, vertical, horizontal, or unknown; orientations 5 to 8 lie on their side."""
    if orientation is not None:
        turned = orientation.between(5, 8)
        width, height = F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)
    usable = width.isNotNull() & height.isNotNull() & (width > 0) & (height > 0)
    return F.when(~usable, "unknown").when(F.abs(width - height) <= 1, "square").when(height > width, "vertical").otherwise("horizontal")


def kind(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1))
    return F.when(extension.isin(*VIDEO), "video").when(extension.isin(*IMAGE), "image")


def origin(path: Column, camera: Column) -> Column:
    return F.when(F.lower(path).endswith(".png"), "screen").when(F.coalesce(camera, F.lit("")) == "", "other").otherwise("camera")


def device_name(url: Column, source: Column, camera: Column, details: Column) -> Column:
    """The folder below the last Originals folder of the path, unless that is the cloud's or the
    item came from there; else the camera; else, where no camera was read, the last of several
    details; else a stand-in."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    parts = F.reverse(F.filter(F.split(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "/"), lambda p: p != ""))
    place = F.array_position(parts, "Originals").cast("int")
    below = F.when(place > 1, F.try_element_at(parts, place - 1))
    cloud = F.coalesce(source, F.lit("")) == "iCloud"
    folder = F.when(~cloud & ~below.isin("iCloud", "iCloud-Photos"), below)
    detail = F.when(camera.isNull() & (F.size(details) > 1), F.element_at(details, -1))
    stand_in = F.when(cloud | F.coalesce(F.array_contains(parts, "iCloud"), F.lit(False)), "iCloud · Device unavailable").otherwise("Unknown device")
    return F.coalesce(folder, F.when(camera != "", camera), detail, stand_in)


def title(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/"), -1)


def subtitle(*parts: Column) -> Column:
    return F.concat_ws(" · ", *parts)


def in_days(captured: Column, start: str, through: str) -> Column:
    return F.coalesce((F.length(captured) >= 8) & F.substring(captured, 1, 8).between(start, through), F.lit(False))


def append_missing(chosen: Column, more: Column) -> Column:
    return F.concat(chosen, F.array_except(more, chosen))


def move(chosen: Column, place: int, by: int) -> Column:
    """The list with the element at ``place`` moved by ``by`` places."""
    to = place + by
    rest = F.concat(F.slice(chosen, 1, place), F.slice(chosen, place + 2, F.size(chosen)))
    return F.concat(F.slice(rest, 1, to), F.slice(chosen, place + 1, 1), F.slice(rest, to + 1, F.size(rest)))


def gps_label(lat: Column, lat_ref: Column, lon: Column, lon_ref: Column, status: Column) -> Column:
    """Degrees with hemisphere; null for a void fix, a missing or unknown hemisphere, negative parts,
    zero-zero and beyond the globe."""
    degrees = lambda dms: dms[0] + dms[1] / 60 + dms[2] / 3600
    a, b, north, east = degrees(lat), degrees(lon), F.upper(lat_ref), F.upper(lon_ref)
    fine = (F.coalesce(F.upper(status), F.lit("A")) != "V") & north.isin("N", "S") & east.isin("E", "W") & (a <= 90) & (b <= 180) & ((a != 0) | (b != 0))
    fine = fine & F.forall(F.concat(lat, lon), lambda x: x >= 0)
    return F.when(fine, F.format_string("%.3f°%s %.3f°%s", a, north, b, east))


def frame_rate(text: Column) -> Column:
    """A fraction or number as a rate; 0 if it can't be read."""
    part = F.split(text, "/")
    number = lambda i: F.try_element_at(part, F.lit(i)).try_cast("double")
    rate = F.when(F.size(part) == 2, F.try_divide(number(1), number(2))).when(F.size(part) == 1, number(1))
    return F.when(rate > 0, rate).otherwise(0.0)


def last_frame_time(seconds: Column, rate: Column) -> Column:
    """Just before the end; a tenth of a second stands for an unknown rate."""
    step = F.when(rate > 0, 1 / rate).otherwise(0.1)
    return F.greatest(F.lit(0.0), seconds - step - 0.001)


def sample_times(seconds: Column, step: float = 1.0) -> Column:
    """Midpoints of steps over [0, seconds); the last step may be shorter, and there is one at least."""
    n = F.greatest(F.lit(1), F.ceil(seconds / step).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.round((i * step + F.least(seconds, (i + 1) * step)) / 2, 6))


def coarse_ordinals(frames: Column, wanted: int = 12) -> Column:
    """Evenly spaced ordinals with the first and the last, halves rounded to even."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(wanted - 1)), lambda i: F.bround(i * (frames - 1) / F.lit(float(wanted - 1)), 0).cast("int"))
    return F.when(frames <= wanted, F.sequence(F.lit(0), frames - 1)).otherwise(F.array_distinct(spread))


def speech_chunks(seconds: Column, has_audio: Column, step: int = 30) -> Column:
    n = F.ceil(seconds / step).cast("int")
    return F.when(has_audio & (n > 0), F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * step)).otherwise(F.array().cast("array<int>"))


def crop_valid(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    return (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= width) & (y + h <= height)


def iou(a: str, b: str) -> Column:
    """Overlap of boxes with columns x1, y1, x2, y2 under two prefixes."""
    c = lambda p, n: F.col(f"{p}{n}")
    width = F.greatest(F.lit(0.0), F.least(c(a, "x2"), c(b, "x2")) - F.greatest(c(a, "x1"), c(b, "x1")))
    height = F.greatest(F.lit(0.0), F.least(c(a, "y2"), c(b, "y2")) - F.greatest(c(a, "y1"), c(b, "y1")))
    area = lambda p: (c(p, "x2") - c(p, "x1")) * (c(p, "y2") - c(p, "y1"))
    shared = width * height
    union = area(a) + area(b) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def face_reference(asset: Column, at: Column, corners: list[Column]) -> Column:
    """The key of a face: its asset, time (or photo) and corners, to six decimals."""
    digits = lambda c: F.format_string("%.6f", F.round(c.cast("double"), 6))
    return F.concat_ws("|", asset, F.when(at.isNull(), "photo").otherwise(digits(at)), F.concat_ws(",", *map(digits, corners)))


def packed_cell(number: Column, frames: Column, per_sheet: int = 32, columns: int = 8, side: int = 256) -> Column:
    """Where a frame of an asset goes: sheet, x and y, and the sheet's width and height. A sheet that
    holds fewer frames than columns is as wide as its frames."""
    sheet, place = F.floor(number / per_sheet).cast("int"), (number % per_sheet).cast("int")
    held = F.least(F.lit(per_sheet), frames - sheet * per_sheet).cast("int")
    wide = F.least(F.lit(columns), held)
    row = F.floor(place / wide).cast("int")
    return F.struct(sheet.alias("sheet"), (place % wide * side).alias("x"), (row * side).alias("y"), (wide * side).alias("width"), (F.ceil(held / wide).cast("int") * side).alias("height"))


def shifted_segments(segments: Column, seconds: Column) -> Column:
    """Segments (start, end, text, words) of a chunk, with their words, in the time of the whole."""
    later = lambda s: s.withField("start", s["start"] + seconds).withField("end", s["end"] + seconds)
    return F.transform(segments, lambda s: later(s).withField("words", F.transform(s["words"], later)))


def display_size(width: Column, height: Column, rotation: Column) -> Column:
    """Width and height as shown: a quarter turn swaps them."""
    turned = F.coalesce(F.abs(rotation) % 180 == 90, F.lit(False))
    return F.struct(F.when(turned, height).otherwise(width).alias("width"), F.when(turned, width).otherwise(height).alias("height"))


def even_size(width: Column, height: Column, side: int) -> Column:
    """Even sides of at most about ``side`` that keep the aspect, never larger than the source's."""
    scale = F.least(F.lit(1.0), F.lit(float(side)) / F.greatest(width, height))
    even = lambda c: F.greatest(F.lit(2), F.bround(c * scale / 2, 0).cast("int") * 2)
    return F.struct(even(width).alias("width"), even(height).alias("height"))


def video_camera(tags: Column) -> Column:
    """The camera in a video's tags (a map): make and model of the phone's own keys, else the plain
    ones, else an encoder that names a known camera; empty if none."""
    tag = lambda name: F.trim(F.coalesce(F.try_element_at(tags, F.lit(name)), F.lit("")))
    pair = lambda prefix: F.trim(F.concat_ws(" ", tag(f"{prefix}make"), tag(f"{prefix}model")))
    encoder = F.coalesce(F.try_element_at(tags, F.lit("encoder")), F.lit(""))
    own, plain = pair("com.apple.quicktime."), pair("")
    found = F.when(own != "", own).when(plain != "", plain).when(encoder.contains("DJI") | encoder.contains("OsmoPocket"), encoder).otherwise("")
    return F.replace(found, F.lit("OsmoPocket4P"), F.lit("Pocket 4P"))


def video_location(tags: Column) -> Column:
    some = lambda name: F.when(F.try_element_at(tags, F.lit(name)) != "", F.try_element_at(tags, F.lit(name)))
    return F.coalesce(some("location"), some("com.apple.quicktime.location.ISO6709"))


def toggled(chosen: Column, group: Column) -> Column:
    """The ordered selection after a click on a group: all of it goes if all is chosen, else what is
    missing is appended."""
    return F.when(F.size(F.array_except(group, chosen)) == 0, F.filter(chosen, lambda x: ~F.array_contains(group, x))).otherwise(append_missing(chosen, group))
