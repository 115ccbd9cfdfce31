"""Explicit schemas of the survey tables."""

RASTER = "row int, col int, value double"
TILES = "tile_row int, tile_col int, band short, px array<short>"
GRID = "crs string, a double, b double, c double, d double, e double, f double, width int, height int"
LINES = "line_id string, xs array<double>, ys array<double>"
GAPS = "line_id string, status string, gap_m double, x double, y double"
OBJECTS = "object_id string, line_id string, position_type string, x double, y double, area_m2 double, confidence double, n_parts int"
JOBS = "id string, name string, status string, stage string, progress double, created double, started double, finished double, stage_seconds map<string, int>, error string"
TIMELINE = "pos int, step string, done boolean, date string"
