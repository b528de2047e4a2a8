"""Analytics over sparse voxel volumes, boxes, depth maps and meshes as Spark DataFrames."""
