"""Scalar functions over offsets, layouts and stored values."""

from .layout import box_split, coordinates, gcd_block, io_ranks, one_dim, offset, regions
from .quantize import quantized

__all__ = ["box_split", "coordinates", "gcd_block", "io_ranks", "offset", "one_dim", "quantized", "regions"]
