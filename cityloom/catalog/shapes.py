"""Shapes for the registered queries, and areas of overlaid shapes in plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators.overlay import BOX, prefixed
from ..sources.layers import layer

WATER_BUFFER = 30.0


def hexagon(prefix: str = ""):
    """Six corners inside a box, with a hole of four corners in the middle."""
    x0, y0, x1, y1 = (F.col(prefix + c) for c in BOX)
    w, h, cx, cy = x1 - x0, y1 - y0, (x0 + x1) / 2, (y0 + y1) / 2
    outer = [(x0, cy), (x0 + w / 4, y0), (x1 - w / 4, y0), (x1, cy), (x1 - w / 4, y1), (x0 + w / 4, y1)]
    hole = [(cx - w / 4, cy), (cx, cy + h / 4), (cx + w / 4, cy), (cx, cy - h / 4)]
    return F.array(*[F.array(*[g.vertex(*p) for p in (*r, r[0])]) for r in (outer, hole)])


def shaped(spark, d, name: str, prefix: str = "", extra=()):
    return prefixed(layer(spark, d, name).select("id", *BOX, *extra).withColumn("rings", hexagon()), prefix)


def hexagon_sql(t: str) -> list[str]:
    """The same rings as lists of corners."""
    w, h, cx, cy = (f"({t}.maxx-{t}.minx)", f"({t}.maxy-{t}.miny)", f"(({t}.minx+{t}.maxx)/2)", f"(({t}.miny+{t}.maxy)/2)")
    outer = [(f"{t}.minx", cy), (f"{t}.minx+{w}/4", f"{t}.miny"), (f"{t}.maxx-{w}/4", f"{t}.miny"), (f"{t}.maxx", cy),
             (f"{t}.maxx-{w}/4", f"{t}.maxy"), (f"{t}.minx+{w}/4", f"{t}.maxy")]
    hole = [(f"{cx}-{w}/4", cy), (cx, f"{cy}+{h}/4"), (f"{cx}+{w}/4", cy), (cx, f"{cy}-{h}/4")]
    return ["[" + ", ".join(f"{{'x': {x}, 'y': {y}}}" for x, y in (*r, r[0])) + "]" for r in (outer, hole)]


def hexagon_area(t: str) -> str:
    return f"(({t}.maxx-{t}.minx)*({t}.maxy-{t}.miny)*0.625e0)"  # 3/4 of the box less 1/8


def rounded_sql(t: str, d: float) -> str:
    """A box grown by ``d`` with arcs of 16 segments, as a list of corners."""
    return (f"list_transform(range(69), lambda i: {{'x': CASE WHEN (i%68)//17 IN (0,3) THEN {t}.maxx ELSE {t}.minx END"
            f"+{d}*cos(((i%68)%17+16*((i%68)//17))*(2*pi()/64)), 'y': CASE WHEN (i%68)//17<2 THEN {t}.maxy ELSE {t}.miny END"
            f"+{d}*sin(((i%68)%17+16*((i%68)//17))*(2*pi()/64))}})")


def both(t: str) -> str:
    return f"unnest([{', '.join(hexagon_sql(t))}])"


#: Areas by one sweep a group, without a grid: from poly (k, layer, p) to sw (k, one, both).
SWEEP = """ed AS (SELECT k, layer, unnest(list_transform(range(1, len(p)), lambda i: {'a': p[i], 'b': p[i+1]})) AS e FROM poly),
 eg AS (SELECT DISTINCT k, layer, least(e.a.x,e.b.x) AS x0, CASE WHEN e.a.x<e.b.x THEN e.a.y ELSE e.b.y END AS y0,
 greatest(e.a.x,e.b.x) AS x1, CASE WHEN e.a.x<e.b.x THEN e.b.y ELSE e.a.y END AS y1, CASE WHEN e.a.x<e.b.x THEN 1 ELSE -1 END AS w,
 row_number() OVER () AS n FROM ed WHERE e.a.x<>e.b.x),
 mt AS (SELECT k, lo, hi, ay0+(lo-ax0)*(ay1-ay0)/(ax1-ax0)-by0-(lo-bx0)*(by1-by0)/(bx1-bx0) AS da,
 ay0+(hi-ax0)*(ay1-ay0)/(ax1-ax0)-by0-(hi-bx0)*(by1-by0)/(bx1-bx0) AS db FROM (SELECT a.k, greatest(a.x0,b.x0) AS lo,
 least(a.x1,b.x1) AS hi, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1
 FROM eg a JOIN eg b ON a.k=b.k AND a.n<b.n AND a.x0<b.x1 AND b.x0<a.x1)),
 ps AS (SELECT DISTINCT k, x FROM (SELECT k, unnest([x0,x1]) AS x FROM eg UNION ALL
 SELECT k, lo+(hi-lo)*(da/(da-db)) FROM mt WHERE da*db<0)),
 sl AS (SELECT k, x AS a, lead(x) OVER (PARTITION BY k ORDER BY x) AS b FROM ps),
 ln AS (SELECT sl.k, a, b, layer, w, y0+((a+b)/2-x0)*(y1-y0)/(x1-x0) AS y FROM sl JOIN eg ON eg.k=sl.k AND x0<=a AND x1>=b WHERE b>a),
 st AS (SELECT k, (b-a)*(lead(y) OVER o-y) AS ar, sum(CASE WHEN layer=0 THEN w ELSE 0 END) OVER u>0 AS i,
 sum(CASE WHEN layer=1 THEN w ELSE 0 END) OVER u>0 AS j FROM ln WINDOW o AS (PARTITION BY k, a ORDER BY y),
 u AS (PARTITION BY k, a ORDER BY y ROWS UNBOUNDED PRECEDING)),
 sw AS (SELECT k, round(sum(ar) FILTER (i),6) AS one, round(sum(ar) FILTER (i AND j),6) AS both FROM st GROUP BY k)"""


def grown_sql(rings: str) -> str:
    """Parts of shapes grown by ``d``, as ``poly`` rows: from ``rings`` (id, d, p) the rings, a strip along each edge
    and a disc of 64 corners at each corner."""
    side = "{{'x': e.{p}.x{s}(e.b.y-e.a.y)*f, 'y': e.{p}.y{t}(e.b.x-e.a.x)*f}}"
    corners = ", ".join(side.format(p=p, s=s, t="-" if s == "+" else "+") for p, s in zip("abbaa", "++--+", strict=True))
    return f"""ge AS (SELECT id, d, unnest(list_transform(range(1, len(p)), lambda i: {{'a': p[i], 'b': p[i+1]}})) AS e FROM {rings}),
 gf AS (SELECT *, d/sqrt(pow(e.b.x-e.a.x,2)+pow(e.b.y-e.a.y,2)) AS f FROM ge),
 poly AS (SELECT id AS k, 0 AS layer, p FROM {rings} UNION ALL SELECT id, 0, [{corners}] FROM gf UNION ALL
 SELECT id, 0, list_transform(range(65), lambda i: {{'x': e.a.x+d*cos((i%64)*(2*pi()/64)), 'y': e.a.y+d*sin((i%64)*(2*pi()/64))}}) FROM gf)"""
