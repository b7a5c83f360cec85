"""Datasets and other stored forms: array datasets on Parquet, decomposition files, classic array files, feature tables."""

from .dataset import Dataset

__all__ = ["Dataset"]
