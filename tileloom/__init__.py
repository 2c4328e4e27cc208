"""Point-tile analytics on Spark: LiDAR points, grids, images and tiles as DataFrames."""
