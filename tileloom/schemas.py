"""Table schemas. A missing measurement is NaN, a missing row is an empty cell."""

from __future__ import annotations

ITEMS = (
    "item_id string, collection string, dt timestamp, minx double, miny double, maxx double, "
    "maxy double, minz double, maxz double, assets map<string,string>, props map<string,string>"
)
TILES = "tile_id string, source string, xmin double, ymin double, xmax double, ymax double"
POINTS = (
    "tile_id string, cloud string, pid bigint, x double, y double, z double, intensity float, "
    "return_number float, number_of_returns float, classification int, hag double"
)
CELLS = "tile_id string, grid string, row int, col int, v double"
PIXELS = (
    "tile_id string, sensor string, image_id string, dt date, band string, row int, col int, v float"
)
EDGES = "tile_id string, k int, src bigint, dst bigint"
STATS = "kind string, band string, mean double, std double, n bigint, n_nan bigint, n_inf bigint"
METRICS = "tile_id string, model string, metric string, v double"
POLYS = "poly_id string, ring_ix int, seg_ix int, x1 double, y1 double, x2 double, y2 double"

# One catalog item as it lies in a file: a GeoJSON feature with a 4- or 6-number box.
ITEM_FILE = (
    "id string, collection string, bbox array<double>, "
    "properties map<string,string>, assets map<string,struct<href:string>>"
)
TILE_FILE = (
    "features array<struct<id:string, properties:map<string,string>, "
    "geometry:struct<type:string, coordinates:array<array<array<double>>>>>>"
)
