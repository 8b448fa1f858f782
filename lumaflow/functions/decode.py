"""Table functions over decoded streams: the frames that belong to asked times, in one pass over the bytes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

FRAME = "ts double, frame_index long, height int, width int, gray binary"


def output_height(width: Column | int, source_width: Column, source_height: Column) -> Column:
    """Rows of a frame that is scaled to ``width``: in proportion, half to even, 2 at least, and made even."""
    h = F.greatest(F.lit(2), F.bround(F.lit(width) * source_height / source_width, 0).cast("int"))
    return (h + h % 2).cast("int")


def rate_of(asked: list[float], most: int) -> float:
    """Frames a second that a decoder is asked for: one, or fewer if the span would give more than ``most``."""
    return min(1.0, most / (max(asked) + 1.0))


def _pgm(data: memoryview) -> Iterator[tuple[int, int, memoryview]]:
    """(width, height, pixels) of the binary 8-bit PGM images that stand one after the other."""
    at = 0
    while at < len(data):
        fields: list[bytes] = []
        while len(fields) < 4:
            while at < len(data) and (data[at] <= 32 or data[at] == 35):
                if data[at] == 35:  # a comment goes up to the line's end
                    while at < len(data) and data[at] != 10:
                        at += 1
                at += 1
            begin = at
            while at < len(data) and data[at] > 32:
                at += 1
            if begin == at:
                return  # white space after the last image, or a header cut short: no frame
            fields.append(bytes(data[begin:at]))
        if fields[0] != b"P5" or not 0 < int(fields[3]) < 256:
            raise ValueError("not an 8-bit binary PGM image")
        width, height, at = int(fields[1]), int(fields[2]), at + 1
        if at + width * height > len(data):
            return
        yield width, height, data[at : at + width * height]
        at += width * height


def frames_at(content: bytes | None, width: int | None, height: int | None, asked: list[float] | None, most: int) -> Iterator[tuple]:
    """Rows of FRAME, one for each distinct asked time in order.

    ``content`` is what a decoder gave at ``rate_of``: raw 8-bit frames of this size, or PGM images if width and height
    are null. A time's frame is the nearest one, half to even, the last at most; an incomplete last frame isn't one.
    Without asked times there are no rows; without a frame, or with images of several sizes, it is an error.
    """
    times = sorted({float(t) for t in asked or [] if t is not None})
    if not times:
        return
    rate, data = rate_of(times, most), memoryview(content or b"")
    if width is None or height is None:
        shapes, images = set(), []
        last_asked = round(times[-1] * rate)
        for k, (w, h, pixels) in enumerate(_pgm(data)):
            shapes.add((w, h))
            images.append(pixels)
            if k >= last_asked:
                break
        if len(shapes) > 1:
            raise ValueError("the images of a stream differ in size")
        (width, height), count = (shapes or {(0, 0)}).copy().pop(), len(images)
    else:
        if width < 2 or height < 1:
            raise ValueError("invalid frame size")
        size = width * height
        count = len(data) // size
        images = None
    if not count:
        raise ValueError("no decodable frame")
    for t in times:
        k = min(round(t * rate), count - 1)
        pixels = images[k] if images is not None else data[k * size : (k + 1) * size]
        yield t, k, height, width, bytes(pixels)


@F.udtf(returnType=FRAME)
class SampleFrames:
    """``SELECT v.video_id, s.* FROM videos v, LATERAL sample_frames(v.content, v.width, v.height, v.asked, 240) s``"""

    def eval(self, content: bytes, width: int, height: int, asked: list, most: int) -> Iterator[tuple]:
        yield from frames_at(content, width, height, asked, most)


def register(spark: SparkSession) -> None:
    spark.udtf.register("sample_frames", SampleFrames)
