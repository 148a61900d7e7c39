"""Column functions: text, time, geometry and label arithmetic, all evaluated by the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VIDEO_EXTENSIONS = ("mp4", "avi", "mov", "wmv", "flv", "mkv")


def strip_extension(name: Column) -> Column:
    """Without what follows the last dot."""
    return F.regexp_replace(name, r"\.[^.]+$", "")


def base_name(name: Column) -> Column:
    """Up to the first dot."""
    return F.split_part(name, F.lit("."), F.lit(1))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))


def is_video(name: Column) -> Column:
    return extension(name).isin(*VIDEO_EXTENSIONS)


def natural_key(text: Column, width: int = 20) -> Column:
    """A key that sorts runs of digits by value: each run is padded with zeros (runs of up to `width` digits)."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, width, "0")).otherwise(p)), "")


def hex_channel(color: Column, channel: int) -> Column:
    """0-255 value of a channel (0 red, 1 green, 2 blue) of a color written #rrggbb."""
    return F.conv(F.substring(color, 2 + 2 * channel, 2), 16, 10).cast("int")


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def frame_ms(frame: Column, fps_num: int, fps_den: int = 1) -> Column:
    """Whole milliseconds at which a frame starts."""
    return F.floor(frame * (1000 * fps_den) / F.lit(fps_num)).cast("long")


def timestamp_text(ms: Column) -> Column:
    """HH:MM:SS,mmm of whole milliseconds."""
    whole = lambda n: F.floor(ms / n)
    return F.format_string("%02d:%02d:%02d,%03d", whole(3_600_000), whole(60_000) % 60, whole(1000) % 60, ms % 1000)


def turn_angle(cx: Column, cy: Column, px: Column, py: Column) -> Column:
    """Degrees by which to turn so that the point (px, py) lies above the centre."""
    return F.degrees(F.atan2(py - cy, px - cx)) - 90


def padded(low: Column, high: Column, factor: float = 1.05) -> tuple[Column, Column]:
    """A range widened about its middle."""
    middle, half = (low + high) / 2, (high - low) / 2 * factor
    return middle - half, middle + half


def reflected(i: Column, n: Column) -> Column:
    """An index mirrored at both ends into [0, n)."""
    period = F.greatest(2 * (n - 1), F.lit(1))
    m = F.pmod(i, period)
    return F.when(n <= 1, 0).when(m < n, m).otherwise(period - m)


def clamped(i: Column, n: Column) -> Column:
    return F.greatest(F.lit(0), F.least(i, n - 1))


def resized(h: Column, w: Column, long_side: int) -> tuple[Column, Column]:
    """(height, width) scaled so that the longer side is long_side; halves round up."""
    scale = F.lit(float(long_side)) / F.greatest(h, w)
    return F.floor(h * scale + 0.5).cast("int"), F.floor(w * scale + 0.5).cast("int")


def restricted(h: Column, w: Column, longest: int, step: int = 16, align: bool = True) -> tuple[Column, Column]:
    """(height, width) with the longer side at most `longest`, snapped to multiples of step (plus one if align)."""
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(h, w))
    more = 1 if align else 0
    snap = lambda x: (half_even((x * scale - more) / step) * step + more).cast("int")
    return snap(h), snap(w)


def engine_of(object_id: Column, most: int = 10) -> tuple[Column, Column]:
    """(engine number, local id from 1) of an object id from 1."""
    return F.floor((object_id - 1) / most).cast("int"), ((object_id - 1) % most + 1).cast("int")


def palette_channel(index: Column, channel: int) -> Column:
    """A channel of the colour-map entry: bits channel, channel+3, ... of the index, highest first."""
    bits = [F.shiftleft(F.shiftright(index, 3 * k + channel).bitwiseAND(F.lit(1)), 7 - k) for k in range(8)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return total


def logit(p: Column, eps: float = 1e-5) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def one_hot(label: Column, classes: int) -> Column:
    """An array of 0 and 1 with places 0 .. classes."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes)), lambda i: (i == label).cast("int"))


def warmup_rate(step: Column, base: float, warm: int, total: int, power: float = 0.9, least: float = 1e-5) -> Column:
    """A learning rate that rises linearly for `warm` steps and then falls by a polynomial."""
    rising = F.lit(base) * step / warm
    share = (step - warm) / F.lit(float(max(total - warm, 1)))
    return F.when(step < warm, rising).otherwise(F.greatest(F.lit(base) * F.pow(1 - share, power), F.lit(least)))


def seeded(key: Column, n: Column | int, salt: int = 0) -> Column:
    """A number below n that looks random, the same in any engine: key * 2654435761 + salt, modulo a prime, modulo n."""
    mixed = F.pmod(F.pmod(key, F.lit(4_294_967_291)) * F.lit(265_443_576) + F.lit(salt * 40_503 + 12_345), F.lit(4_294_967_291))
    return F.pmod(mixed, n if isinstance(n, Column) else F.lit(n))


def usable_vector(v: Column) -> Column:
    """Whether a vector is there and all its elements are numbers."""
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))


def usable_number(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x)


def mean_of_numbers(x: Column, empty: float | None = 0.0) -> Column:
    """The mean of what is a number; `empty` where nothing is."""
    mean = F.avg(F.when(usable_number(x), x))
    return mean if empty is None else F.coalesce(mean, F.lit(empty))


def mask_name(image: Column) -> Column:
    """The name of an image's mask file."""
    return F.regexp_replace(image, r"(?i)\.jpe?g$", ".png")


def project_name(entered: Column, now: Column) -> Column:
    """What was entered, or a name made of the time."""
    return F.when(F.length(F.coalesce(entered, F.lit(""))) > 0, entered).otherwise(F.date_format(now, "yyyy-MM-dd-HH-mm-ss'-Project'"))


def pts_frame(pts: Column, base_num: Column, base_den: Column, rate_num: Column, rate_den: Column) -> Column:
    """The frame at a presentation time, which is counted in units of a time base; whole numbers throughout."""
    return F.floor(pts * base_num * rate_num / (base_den * rate_den)).cast("long")


def from_pixel(pixel: Column, size: int, low: Column, high: Column) -> Column:
    """The place on an axis from low to high that a pixel of an image of `size` pixels shows."""
    return low + (high - low) * pixel / F.lit(float(size))


def standardised(value: Column, mean: float, spread: float, scale: float = 255.0) -> Column:
    """A channel's value, scaled to one, less its mean and over its spread."""
    return (value / F.lit(scale) - F.lit(mean)) / F.lit(spread)


def softmax(x: Column) -> Column:
    """An array of shares of exp(x); the largest element is taken off first, so nothing overflows."""
    raised = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(raised, lambda v: v / F.aggregate(raised, F.lit(0.0), lambda s, y: s + y))


def attention(scores: Column, k: int) -> Column:
    """Shares of the k largest scores, 0 for the others; of equal ones the first count."""
    placed = F.transform(scores, lambda x, i: F.struct((-x).alias("x"), i.alias("i")))
    top = F.slice(F.array_sort(placed), 1, k)
    shares = softmax(F.transform(top, lambda r: -r["x"]))
    found = F.map_from_arrays(F.transform(top, lambda r: r["i"]), shares)
    return F.transform(scores, lambda x, i: F.coalesce(F.element_at(found, i), F.lit(0.0)))


def upserted(entries: Column, key: Column, value: Column) -> Column:
    """A map with the key set to the value; null counts as an empty map. The new entry comes last."""
    others = F.map_filter(entries, lambda k, _: k != key)
    return F.when(entries.isNull(), F.create_map(key, value)).otherwise(F.map_concat(others, F.create_map(key, value)))


def chunks_of(x: Column) -> Column:
    """The characters of a signed number in the compressed run-length format: five bits each, lowest first, and a sixth that
    says that more follow; the bits end when sign and rest agree."""
    bits = lambda k: F.shiftright(x, 5 * k)
    low = lambda k: bits(k).bitwiseAND(F.lit(31).cast("long"))
    more = lambda k: F.when(low(k) >= 16, bits(k + 1) != -1).otherwise(bits(k + 1) != 0)
    out, going = F.lit(""), F.lit(True)
    for k in range(7):  # counts stay below 2 ** 34
        char = F.char(low(k) + F.when(more(k), 32).otherwise(0) + 48)
        out = F.concat(out, F.when(going, char).otherwise(F.lit("")))
        going = going & more(k)
    return out


def compressed_counts(counts: Column) -> Column:
    """Run-length counts as one string: from the fourth count on, the difference from the one two places before."""
    delta = F.transform(counts, lambda x, i: F.when(i > 2, x - F.get(counts, i - 2)).otherwise(x).cast("long"))
    return F.array_join(F.transform(delta, chunks_of), "")


def shown_mode(mode: Column, image: Column, overlay: Column, mask: Column) -> Column:
    """What a viewer shows: the image, the overlay or the mask; null for other modes."""
    return F.when(mode == "image", image).when(mode == "overlay", overlay).when(mode == "mask", mask)


def without_unused(logit: Column, identity: Column, objects: Column) -> Column:
    """A logit, or one that never wins for identities beyond the number of objects."""
    return F.when(identity > objects, F.lit(-1e10)).otherwise(logit)


def partner(key: Column, n: Column | int, salt: int = 0) -> Column:
    """A number below n that looks random and isn't key, for key below n; key itself where n is 1."""
    size = n if isinstance(n, Column) else F.lit(n)
    return F.pmod(key + 1 + seeded(key, F.greatest(size - 1, F.lit(1)), salt), size)


def shuffled_id(group: Column, object_id: Column, most: int) -> Column:
    """The object's id after a permutation of 1 .. most that its group's key picks, from all of them; the background stays 0."""
    drawn = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda i: F.struct(seeded(group * 1_009 + i, 1 << 30, 1).alias("key"), i.alias("id")))
    return F.when(object_id == 0, F.lit(0)).otherwise(F.element_at(F.array_sort(drawn), object_id.cast("int"))["id"])
