"""Operators for preparing training text: segmentation, normalisation, overlap,
pair defects, packing, mixing and page quality.  Nothing outside this
subpackage imports it."""
