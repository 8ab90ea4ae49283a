"""Chunked n-dimensional arrays as DataFrames: scans with computed coordinates, time series, regions, descriptors."""

from gridloom.operators.describe import grid_info
from gridloom.operators.regions import read_regions
from gridloom.operators.scan import read_array, read_raw
from gridloom.operators.series import read_series
from gridloom.plans.metrics import finished_scan_metrics, last_scan_metrics
from gridloom.sources.cubes import ChunkCube, TableCube, write_cells, write_cube

__all__ = ["ChunkCube", "TableCube", "finished_scan_metrics", "grid_info", "last_scan_metrics", "read_array", "read_raw", "read_regions", "read_series", "write_cells", "write_cube"]
