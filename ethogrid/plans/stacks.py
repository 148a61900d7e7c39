"""Queries on written stacks of frames, and features of frames: masks are those of line items, colours a rule of place and frame."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethogrid import sources
from ethogrid.operators import pixels
from ethogrid.session import checkpointing

from .masks import HEIGHT, PIXELS, WIDTH, pixels_of
from .registry import Tables, query

SIDE = 20
CROP = pixels.Preprocess(roi=1, crop=(SIDE, SIDE), remove_background=True)
#: Every pixel of every frame, with its label and colour; a video takes each fourth frame.
GRID = PIXELS + f""", shot AS (SELECT DISTINCT frame FROM px),
    grid AS MATERIALIZED (SELECT s.frame, CAST(s.frame % 4 AS VARCHAR) AS video, s.frame // 4 AS number, ys.y, xs.x, coalesce(px.roi, 0) AS roi, (5 * xs.x + s.frame) % 256 AS r, 7 * ys.y % 256 AS g, 80 * coalesce(px.roi, 0) AS b
    FROM shot s, (SELECT unnest(range(0, {HEIGHT})) AS y) ys, (SELECT unnest(range(0, {WIDTH})) AS x) xs LEFT JOIN px ON px.frame = s.frame AND px.y = ys.y AND px.x = xs.x)
"""


def color(roi: str, channel: int) -> str:
    return f"[{', '.join(str(c[channel]) for c in pixels.PALETTE)}][{roi} + 1]"


def images_of(t: Tables) -> DataFrame:
    """video, frame, height, width, channels, pixels, mask."""
    rows = pixels_of(t).select((F.col("frame") % 4).alias("video"), F.expr("frame div 4").alias("frame"), "roi", "y", "x")
    masks = pixels.rasterised(rows, HEIGHT, WIDTH)

    def draw(batches):
        y, x = np.mgrid[0:HEIGHT, 0:WIDTH]
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                mask = np.frombuffer(r.mask, np.uint8).reshape(HEIGHT, WIDTH)
                image = np.stack([(5 * x + 4 * r.frame + int(r.video)) % 256, 7 * y % 256, 80 * mask.astype(int)], axis=2).astype(np.uint8)
                out.append((r.video, r.frame, HEIGHT, WIDTH, 3, image.tobytes(), r.mask))
            yield pd.DataFrame(out, columns=["video", "frame", "height", "width", "channels", "pixels", "mask"])

    return masks.mapInPandas(draw, "video string, frame long, height int, width int, channels int, pixels binary, mask binary")


def stacked(t: Tables, frames: DataFrame, where: str | None = None, segment: int = 16) -> DataFrame:
    """The frames, or some of them, after they were written as stacks to the shared folder."""
    base = checkpointing(t.spark).sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{base}/stacks-{uuid.uuid4().hex}"
    sources.write_stacks(frames, path, segment)
    return sources.read_stacks(t.spark, path, where)


SUMS = "CAST(sum({0}) AS BIGINT) AS red, CAST(sum({1}) AS BIGINT) AS green, CAST(sum({2}) AS BIGINT) AS blue"


@query(GRID + f"SELECT video, number AS frame, {HEIGHT} AS height, {WIDTH} AS width, CAST(sum(r) AS BIGINT) AS red, CAST(sum(g) AS BIGINT) AS green, CAST(sum(b) AS BIGINT) AS blue FROM grid WHERE video IN ('1', '3') AND number >= 10 AND number < 40 GROUP BY ALL")
def video_scan(t: Tables) -> DataFrame:
    """Frames 10 to 39 of two videos of written stacks; other files aren't opened."""
    return pixels.channel_sums(stacked(t, images_of(t), "video in ('1', '3') and frame >= 10 and frame < 40"))


@query(GRID + f"SELECT video, number AS frame, {HEIGHT} AS height, {WIDTH} AS width, " + SUMS.format(*(color("roi", k) for k in range(3))) + " FROM grid GROUP BY ALL")
def mask_video(t: Tables) -> DataFrame:
    """Masks in their colours, as stacks."""
    return pixels.channel_sums(stacked(t, pixels.rendered(images_of(t), lambda frame, mask: pixels.colourised(mask))))


@query(
    GRID
    + f"SELECT video, number AS frame, {HEIGHT} AS height, {WIDTH} AS width, "
    + SUMS.format(*(f"CASE WHEN roi > 0 THEN floor({c} * 0.5 + {color('roi', k)} * 0.5) ELSE {c} END" for k, c in enumerate("rgb")))
    + " FROM grid GROUP BY ALL"
)
def overlay_video(t: Tables) -> DataFrame:
    """Frames under half-transparent masks, as stacks."""
    return pixels.channel_sums(stacked(t, pixels.rendered(images_of(t), pixels.overlay)))


def _smooth(c: str) -> str:
    """A channel of the source, by the four pixels around the place that a pixel comes from."""
    return f"""round_even(coalesce(a.{c}, 0) * (1 - fv) * (1 - fu) + coalesce(b.{c}, 0) * (1 - fv) * fu + coalesce(c.{c}, 0) * fv * (1 - fu) + coalesce(d.{c}, 0) * fv * fu, 0)"""


CROPPED = GRID + f""", means AS (SELECT frame, {WIDTH // 2} - avg(x) AS dx, {HEIGHT // 2} - avg(y) AS dy FROM px WHERE roi = 1 GROUP BY frame),
    spots AS (SELECT s.frame, ys.y, xs.x, ys.y - dy AS v, xs.x - dx AS u FROM shot s, (SELECT unnest(range({HEIGHT // 2 - SIDE // 2}, {HEIGHT // 2 + SIDE // 2})) AS y) ys,
        (SELECT unnest(range({WIDTH // 2 - SIDE // 2}, {WIDTH // 2 + SIDE // 2})) AS x) xs LEFT JOIN means m ON m.frame = s.frame),
    placed AS (SELECT *, CAST(floor(v) AS BIGINT) AS v0, CAST(floor(u) AS BIGINT) AS u0, v - floor(v) AS fv, u - floor(u) AS fu, CAST(round_even(v, 0) AS BIGINT) AS vn, CAST(round_even(u, 0) AS BIGINT) AS un FROM spots),
    cropped AS (SELECT p.frame, p.v IS NULL OR coalesce(n.roi, 0) = 0 AS white, {_smooth("r")} AS r, {_smooth("g")} AS g, {_smooth("b")} AS b FROM placed p
        LEFT JOIN grid n ON n.frame = p.frame AND n.y = vn AND n.x = un LEFT JOIN grid a ON a.frame = p.frame AND a.y = v0 AND a.x = u0 LEFT JOIN grid b ON b.frame = p.frame AND b.y = v0 AND b.x = u0 + 1
        LEFT JOIN grid c ON c.frame = p.frame AND c.y = v0 + 1 AND c.x = u0 LEFT JOIN grid d ON d.frame = p.frame AND d.y = v0 + 1 AND d.x = u0 + 1)
"""


@query(CROPPED + f"SELECT CAST(frame % 4 AS VARCHAR) AS video, frame // 4 AS frame, {SIDE} AS height, {SIDE} AS width, " + SUMS.format(*(f"CASE WHEN white THEN 255 ELSE {c} END" for c in "rgb")) + " FROM cropped GROUP BY ALL")
def crop_video(t: Tables) -> DataFrame:
    """Frames centred on the first ROI, cropped, without background, as stacks; a white page where the ROI is missing."""
    return pixels.channel_sums(stacked(t, pixels.rendered(images_of(t), pixels.page(CROP))))


@query(GRID + """, f AS (SELECT video, number AS frame, avg(r) FILTER (roi = 1) AS f0, avg(g) FILTER (roi = 1) AS f1, avg(b) FILTER (roi = 1) AS f2, count(*) FILTER (roi = 1) / count(*) AS f3 FROM grid GROUP BY ALL)
    SELECT video, frame, unnest(CASE WHEN f0 IS NULL THEN [NULL] ELSE range(0, 4) END)::INTEGER AS place,
    round(CAST(CAST(unnest(CASE WHEN f0 IS NULL THEN [NULL] ELSE [f0, f1, f2, f3] END) AS FLOAT) AS DOUBLE), 3) AS value FROM f""")  # fmt: skip
def latent_extraction(t: Tables) -> DataFrame:
    """Features of the first ROI of every frame, written as latents and read back; null where the ROI is missing."""
    base = checkpointing(t.spark).sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{base}/latents-{uuid.uuid4().hex}"
    found = pixels.latents(images_of(t), "patch_means", 1, pixels.Preprocess(centre=False)).withColumn("kind", F.lit("plain"))
    sources.write_latents(found, path)
    rows = t.spark.read.schema("frame long, latent array<float>, video string, roi int, kind string").parquet(path)
    return rows.select("video", "frame", F.posexplode_outer("latent").alias("place", "value")).withColumn("value", F.round(F.col("value").cast("double"), 3))


def _shared(t: Tables, what: str) -> str:
    return f"{checkpointing(t.spark).sparkContext._jsc.sc().getCheckpointDir().get()}/{what}-{uuid.uuid4().hex}"


@query(GRID + "SELECT 'v' || video AS video, number AS frame, roi, y, x FROM grid WHERE number % 7 = 2 AND roi > 0")
def label_promotion(t: Tables) -> DataFrame:
    """Tracked masks of some frames as label files, read back; their labelled pixels."""
    images = images_of(t).withColumn("video", F.concat(F.lit("v"), "video"))
    path = _shared(t, "labels")
    sources.write_labels(sources.promoted(images.select("video", "frame", "mask"), images.drop("mask"), images.where("frame % 7 = 2")), path)
    return sources.mask_pixels(sources.read_labels(t.spark, path)).select("video", "frame", "roi", "y", "x")


@query(GRID + "SELECT video, number AS frame, CASE WHEN roi = 0 THEN 0 ELSE 10 * roi + CAST(video AS BIGINT) END AS object, CAST(count(*) AS BIGINT) AS n FROM grid GROUP BY ALL")
def palette_files(t: Tables) -> DataFrame:
    """Masks as indexed images with their objects' own numbers, read back; pixels of each."""
    path = _shared(t, "palette")
    images = images_of(t)
    ids = images.select("video").distinct().select("video", F.explode(F.array(F.lit(1), F.lit(2))).alias("local")).withColumn("object", 10 * F.col("local") + F.col("video").cast("int"))
    sources.write_palette_masks(images, path, np.arange(768).reshape(256, 3) % 256, ids)

    def count(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                video, frame = r.path.removesuffix(".png").split("/")[-2:]
                found, n = np.unique(sources.palette_mask(r.content), return_counts=True)
                out += [(video, int(frame), int(o), int(k)) for o, k in zip(found, n, strict=True)]
            yield pd.DataFrame(out, columns=["video", "frame", "object", "n"])

    return sources.binary_files(t.spark, path, "*.png").select("path", "content").mapInPandas(count, "video string, frame long, object long, n long")
