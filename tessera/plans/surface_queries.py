"""Queries of surface extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import surface as s
from tessera.operators import volume as v
from tessera.plans import inputs as i
from tessera.plans.registry import query
from tessera.plans.volume_queries import _DENSE

_CELLS = f"""WITH {_DENSE}, c AS (SELECT vx - x AS vx, vy - y AS vy, vz - z AS vz, 4 * x + 2 * y + z AS k, d FROM vox, (SELECT unnest([0, 1]) AS x), (SELECT unnest([0, 1]) AS y), (SELECT unnest([0, 1]) AS z)),
    cells AS (SELECT vx, vy, vz, list(d ORDER BY k) AS d FROM c GROUP BY ALL HAVING count(*) = 8),
    tets AS (SELECT unnest([[0, 4, 6, 7], [0, 4, 5, 7], [0, 2, 6, 7], [0, 2, 3, 7], [0, 1, 5, 7], [0, 1, 3, 7]]) AS t),
    lows AS (SELECT vx, vy, vz, len(list_filter(t, lambda k: d[k + 1] < 0)) AS n FROM cells, tets)
    SELECT vx, vy, vz, CAST(sum(CASE n WHEN 0 THEN 0 WHEN 4 THEN 0 WHEN 2 THEN 2 ELSE 1 END) AS BIGINT) AS triangles FROM lows GROUP BY ALL HAVING triangles > 0"""


@query("surface_triangles", _CELLS)
def surface_triangles(spark, sf):
    return s.extract(v.smooth(i.voxels(spark, sf))).groupBy("vx", "vy", "vz").agg(F.count("*").alias("triangles"))


@query("surface_indexed")
def surface_indexed(spark, sf):
    """The surface's faces on shared, coloured vertices."""
    smooth = v.smooth(i.voxels(spark, sf))
    f, p = s.indexed(s.extract(smooth))
    p = s.coloured(p, v.fuse_colors(i.observations(spark, sf)))
    return f.join(p.withColumnRenamed("vid", "v0"), "v0").groupBy("r", "g", "b").agg(F.count("*").alias("faces"))


@query("surface_clean")
def surface_clean(spark, sf):
    """The smoothed volume without what lies near small parts of its surface."""
    return s.clean_volume(v.smooth(i.voxels(spark, sf)), 20).select("vx", "vy", "vz")
