"""The dialect's calls by name, for tables of sets, vectors and intervals."""

from __future__ import annotations

from cellweave.functions import codes
from cellweave.operators import bands, intervals, metrics, sets

intersects = sets.intersecting_pairs
contains = sets.containing_pairs
distance_le = metrics.pairs_within_distance
cellset_intersect = sets.cellset_intersect
weighted_sum = codes.weighted_sum
temporal_overlap = intervals.overlapping_pairs
height_band = bands.height_band
quantize = codes.quantize

# Other names that the dialect knows its calls by.
intersect = intersects
time_overlap = overlap_time = temporal_overlap
cell_intersect = cellset_intersect
score = weighted_sum
altitude_band = elevation_band = height_band
