"""Image screening on grey-scale pixels: block hashes for copied regions, error-level statistics. Pixels come as bytes, row by
row, so no image library is needed; a decoder of your own can make them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from .joins import equal_hash_pairs

FLAT = 50.0  # the variance below which a block is background


def block_size(height: int, width: int) -> int:
    least = min(height, width)
    return 16 if least < 200 else 32 if least < 600 else 48 if least < 1200 else 64


def average_hash(block) -> int:
    """64 bits: which cells of the block, averaged to 8 x 8, are above their mean."""
    import numpy as np

    n = block.shape[0] // 8
    small = block[: n * 8, : n * 8].reshape(8, n, 8, n).mean(axis=(1, 3))
    return int.from_bytes(np.packbits((small > small.mean()).reshape(-1)).tobytes(), "big", signed=True)


def block_hashes(images: DataFrame) -> DataFrame:
    """(image, size, x, y, hash) of the blocks that aren't background. ``images``: image, height, width, pixels."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for r in pdf.itertuples():
                grey = np.frombuffer(r.pixels, dtype=np.uint8).reshape(r.height, r.width).astype(np.float64)
                size = block_size(r.height, r.width)
                held = []
                for y in range(0, r.height - size + 1, size):
                    for x in range(0, r.width - size + 1, size):
                        block = grey[y : y + size, x : x + size]
                        if block.var() >= FLAT:
                            held.append((r.image, size, x, y, average_hash(block)))
                yield pd.DataFrame(held, columns=["image", "size", "x", "y", "hash"])

    return images.select("image", "height", "width", "pixels").mapInPandas(run, "image string, size int, x int, y int, hash long")


def clones(images: DataFrame, size: int) -> DataFrame:
    """Pairs of blocks of ``size`` in one image that look alike."""
    return equal_hash_pairs(block_hashes(images).where(f"size = {size}"), "image", size)


def error_levels(pairs: DataFrame, block: int = 32) -> DataFrame:
    """(image, mean, max, std, regions, suspicious) of an image and its re-encoded self: blocks whose mean difference is more
    than three deviations above the blocks' mean. ``pairs``: image, height, width, pixels, again."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                a, b = (np.frombuffer(x, dtype=np.uint8).reshape(r.height, r.width).astype(np.float64) for x in (r.pixels, r.again))
                diff = np.abs(a - b)
                h, w = r.height // block, r.width // block
                means = diff[: h * block, : w * block].reshape(h, block, w, block).mean(axis=(1, 3)) if h and w else np.zeros((0, 0))
                regions = int((means > means.mean() + 3 * means.std()).sum()) if means.size else 0
                out.append((r.image, diff.mean(), diff.max(), diff.std(), regions, regions >= 2))
            yield pd.DataFrame(out, columns=["image", "mean", "max", "std", "regions", "suspicious"])

    return pairs.select("image", "height", "width", "pixels", "again").mapInPandas(run, "image string, mean double, max double, std double, regions int, suspicious boolean")
