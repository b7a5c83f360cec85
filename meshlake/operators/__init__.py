"""Operators over decompositions and array data, as DataFrame plans."""

from .decomposition import Decomposition
from .rearrange import assign_boxes, assign_subsets, comm_matrix, hole_grid, io_buffer_sizes, max_io_buffer, nd_regions, runs_1d
from .slices import hyperslab, point, upserted

__all__ = [
    "Decomposition", "assign_boxes", "assign_subsets", "comm_matrix", "hole_grid", "hyperslab", "io_buffer_sizes", "max_io_buffer",
    "nd_regions", "point", "runs_1d", "upserted",
]
