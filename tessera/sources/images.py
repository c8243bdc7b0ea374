"""JPEG and PNG files by Spark's own image source, which decodes them on the JVM: thumbnails of slides and gray maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The weights of red, green and blue in luminance, of 65,536 parts.
LUMINANCE = (19595, 38470, 7471)


def read_images(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """name, height, width, channels (1, 3 or 4) and data (blue, green, red and alpha of each pixel, row by row) of the image files in a folder; files that can't be decoded are left out."""
    files = spark.read.format("image").option("dropInvalid", "true").option("pathGlobFilter", glob).load(path)
    name = F.element_at(F.split("image.origin", "/"), -1)
    return files.select(name.alias("name"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def codes(data: Column) -> Column:
    """The bytes of a binary as an array of ints."""
    return F.transform(F.split(F.decode(data, "ISO-8859-1"), "(?s)(?<=.)(?=.)"), lambda c: F.ascii(c))


def per_pixel(value: Column, channels: Column, made) -> Column:
    """``made(blue, green, red)`` of each pixel of an array of bytes; one channel is all three."""
    place = lambda k, c: F.get(value, (k * channels + F.when(channels > 1, F.lit(c)).otherwise(F.lit(0))).cast("int"))
    return F.transform(F.sequence(F.lit(0), (F.size(value) / channels).cast("int") - 1), lambda k: made(place(k, 0), place(k, 1), place(k, 2)))


def read_gray_images(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """name, height, width and pixels (luminance from 0 to 1, row by row) of the images in a folder: what a colour image is as a gray one, in whole steps of 255."""
    r, g, b = LUMINANCE
    gray = lambda blue, green, red: F.shiftright(r * red + g * green + b * blue + 32768, 16) / 255
    rows = read_images(spark, path, glob).withColumn("codes", codes(F.col("data")))
    return rows.select("name", "height", "width", per_pixel(F.col("codes"), F.col("channels"), gray).alias("pixels"))


def as_maps(images: DataFrame) -> DataFrame:
    """Gray images as the long maps (tile_id, pix, v) of the overlap operators; the file's name is the tile's id."""
    return images.select(F.col("name").alias("tile_id"), F.posexplode("pixels").alias("pix", "v"))


def thumbnails(slides: DataFrame, path: str, suffix: str = ".jpg") -> DataFrame:
    """slide_id, found, height, width and pixels (red, green, blue, row by row) of each of ``slides`` whose file is ``path``/slide_id + ``suffix``; without one, found is false and the rest null."""
    hexed = lambda c: F.lpad(F.hex(c), 2, "0")
    rgb = per_pixel(F.col("codes"), F.col("channels"), lambda blue, green, red: F.concat(hexed(red), hexed(green), hexed(blue)))
    read = read_images(slides.sparkSession, path, f"*{suffix}").withColumn("codes", codes(F.col("data")))
    read = read.select(F.expr(f"left(name, length(name) - {len(suffix)})").alias("slide_id"), "height", "width", F.unhex(F.array_join(rgb, "")).alias("pixels"))
    return slides.select("slide_id").join(read, "slide_id", "left").select("slide_id", F.col("height").isNotNull().alias("found"), "height", "width", "pixels")
