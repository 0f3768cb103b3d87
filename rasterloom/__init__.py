"""rasterloom: raster-segmentation analytics expressed as Spark DataFrames."""
