"""City layers derived from the star-schema tables by integer arithmetic.

The tables hold no geometry, so every layer is a projection of one table. Keys are
spread over 10 km tiles, a fixed number of rows per tile: the city grows with the data
and the density stays the same. The expressions are plain SQL that other engines read
alike, so results can be checked elsewhere on the very same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TILE_M = 10000
TILES_PER_ROW = 100


def _tile(key: str, per_tile: int) -> tuple[str, str]:
    t = f"CAST(floor({key}/{per_tile}) AS BIGINT)"
    return (f"{TILE_M}*({t}%{TILES_PER_ROW})",
            f"{TILE_M}*CAST(floor({t}/{TILES_PER_ROW}) AS BIGINT)")


def _d(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


# 50 columns and 40 rows of junctions in a tile.
JUNCTIONS = 2000


def junction_xy(key: str) -> tuple[str, str]:
    """Position of a junction as two expressions."""
    dx, dy = _tile(key, JUNCTIONS)
    return (_d(f"({key}%50)*200+{dx}"),
            _d(f"(CAST(floor({key}/50) AS BIGINT)%40)*200+{dy}"))


def _east(key: str) -> str:
    return f"({key}+CASE WHEN {key}%50<49 THEN 1 ELSE {JUNCTIONS - 49} END)"


def _north(key: str) -> str:
    return f"(CASE WHEN CAST(floor({key}/50) AS BIGINT)%40<39 THEN {key}+50 END)"


def _box(key: str, per_tile: int, mx: int, my: int, w: str, h: str, span: int = 9900):
    tx, ty = _tile(key, per_tile)
    x, y = f"({key}*{mx})%{span}+{tx}", f"({key}*{my})%{span}+{ty}"
    return {"minx": _d(x), "miny": _d(y), "maxx": _d(f"{x}+{w}"), "maxy": _d(f"{y}+{h}")}


def _point(key: str, per_tile: int, mx: int, my: int):
    tx, ty = _tile(key, per_tile)
    return {"x": _d(f"({key}*{mx})%10000+{tx}"), "y": _d(f"({key}*{my})%10000+{ty}")}


_F, _Z, _P, _B = "s_suppkey", "c_custkey", "p_partkey", "o_orderkey"

# layer -> (table, column -> expression)
LAYERS: dict[str, tuple[str, dict[str, str]]] = {
    "facility": ("supplier", {
        "id": _F, **_point(_F, 100, 7919, 104729),
        "type": "CASE s_nationkey%4 WHEN 0 THEN 'hospital' WHEN 1 THEN 'school' "
                "WHEN 2 THEN 'fire_station' ELSE 'clinic' END",
        "name": "s_name",
        "capacity": _d(f"50+({_F}%10)*25"),
        "service_radius": _d(f"500+({_F}%5)*250")}),
    "zone": ("customer", {
        "id": _Z, **_box(_Z, 1500, 6151, 15731, f"20+{_Z}%80", "20+c_nationkey*3"),
        "population": _d("floor(abs(c_acctbal))"),
        "region": "c_nationkey"}),
    "parcel": ("part", {
        "id": _P, **_box(_P, 2000, 3571, 28657, "20+p_size", f"20+{_P}%60"),
        "land_use": "lower(p_type)", "zoning": "p_brand",
        "status": f"CASE {_P}%4 WHEN 0 THEN 'vacant' WHEN 1 THEN 'under_development' "
                  "WHEN 2 THEN 'built' ELSE 'protected' END",
        "slope": f"CASE WHEN {_P}%17=0 THEN NULL ELSE {_d(f'{_P}%20')} END",
        "flood_risk": f"CASE WHEN {_P}%23=0 THEN NULL ELSE {_d(f'{_P}%100')}/100 END"}),
    "building": ("orders", {
        "id": _B, **_box(_B, 15000, 7907, 17389, f"5+{_B}%20", f"5+{_B}%15"),
        "building_type": "lower(o_orderpriority)",
        "height": f"CASE WHEN {_B}%3=0 THEN NULL ELSE {_d(f'3+{_B}%40')} END",
        "population_estimate": _d("floor(o_totalprice/10000)")}),
    "constraint": ("supplier", {
        "id": _F, **_box(_F, 100, 1777, 2399, f"150+{_F}%50", f"100+{_F}%70"),
        "type": f"CASE {_F}%4 WHEN 0 THEN 'heritage' WHEN 1 THEN 'forest' "
                "WHEN 2 THEN 'airport' ELSE 'wetland' END",
        "severity": f"CASE {_F}%5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'medium' "
                    "WHEN 2 THEN 'LOW' WHEN 3 THEN 'MODERATE' ELSE NULL END"}),
    "water": ("supplier", {
        "id": _F, **_box(_F, 100, 3083, 4519, f"40+{_F}%60", f"30+{_F}%40"),
        "type": "'lake'"}),
    "ward": ("supplier", {
        "id": _F,
        "name": "s_name",
        "minx": _d(f"({_F}%10)*1000+{_tile(_F, 100)[0]}"),
        "miny": _d(f"CAST(floor(({_F}%100)/10) AS BIGINT)*1000+{_tile(_F, 100)[1]}"),
        "maxx": _d(f"({_F}%10)*1000+1000+{_tile(_F, 100)[0]}"),
        "maxy": _d(f"CAST(floor(({_F}%100)/10) AS BIGINT)*1000+1000+{_tile(_F, 100)[1]}")}),
    "hazard": ("supplier", {
        "id": _F, **{k: v for k, v in zip(
            ("cx", "cy"), _point(_F, 100, 2477, 3313).values())},
        "hazard_type": f"CASE {_F}%4 WHEN 0 THEN 'fire' WHEN 1 THEN 'flood' "
                       "WHEN 2 THEN 'earthquake' ELSE 'chemical' END",
        "radius_m": _d(f"100+({_F}%5)*60"),
        "intensity": _d("1")}),
    # Streets: in every tile a grid of junctions 200 m apart, one part per junction.
    "junction": ("part", {"id": _P, "x": junction_xy(_P)[0], "y": junction_xy(_P)[1]}),
    "change": ("events", {
        "change_id": "event_id", "scenario_id": "user_id%5",
        "object_type": "'LAND_PARCELS'", "object_id": "user_id",
        "operation": "CASE event_type WHEN 'signup' THEN 'INSERT' "
                     "WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END",
        "parameters": "props"}),
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def layer(spark: SparkSession, folder: str, name: str) -> DataFrame:
    source, columns = LAYERS[name]
    return table(spark, folder, source).selectExpr(
        *[f"{expr} AS {col}" for col, expr in columns.items()])


def layer_sql(name: str) -> str:
    source, columns = LAYERS[name]
    cols = ", ".join(f"{expr} AS {col}" for col, expr in columns.items())
    return f"SELECT {cols} FROM {source}"


def with_layers(*names: str) -> str:
    """``WITH`` prefix defining the named layers."""
    return "WITH " + ", ".join(f"{n} AS ({layer_sql(n)})" for n in names)


def streets(spark: SparkSession, folder: str) -> DataFrame:
    """One straight street per neighbouring junction pair: east, also across the tile's border,
    and north."""
    parts = table(spark, folder, "part")
    # Junction keys are dense: a street exists when its far end does.
    ends = parts.selectExpr("p_partkey AS dst")
    starts = parts.selectExpr(
        "p_partkey AS src", "p_size",
        f"explode(array_compact(array({_east('p_partkey')}, {_north('p_partkey')}))) AS dst")
    (x0, y0), (x1, y1) = junction_xy("src"), junction_xy("dst")
    return starts.join(ends, "dst").selectExpr(
        "CASE WHEN dst=src+50 THEN 2*src+1 ELSE 2*src END AS id", "src", "dst",
        "CAST(20+p_size AS DOUBLE) AS speed",
        "CASE p_size%5 WHEN 0 THEN 'residential' WHEN 1 THEN 'primary' WHEN 2 THEN "
        "'secondary' WHEN 3 THEN 'footway' ELSE 'collector' END AS road_class",
        "src%7=0 AS oneway",
        f"{x0} AS x0", f"{y0} AS y0", f"{x1} AS x1", f"{y1} AS y1")


STREETS_SQL = f"""SELECT CASE WHEN b.p_partkey=a.p_partkey+50 THEN 2*a.p_partkey+1
 ELSE 2*a.p_partkey END AS id, a.p_partkey AS src, b.p_partkey AS dst,
 CAST(20+a.p_size AS DOUBLE) AS speed,
 CASE a.p_size%5 WHEN 0 THEN 'residential' WHEN 1 THEN 'primary' WHEN 2 THEN 'secondary'
 WHEN 3 THEN 'footway' ELSE 'collector' END AS road_class, a.p_partkey%7=0 AS oneway,
 {junction_xy('a.p_partkey')[0]} AS x0, {junction_xy('a.p_partkey')[1]} AS y0,
 {junction_xy('b.p_partkey')[0]} AS x1, {junction_xy('b.p_partkey')[1]} AS y1
 FROM part a JOIN part b ON b.p_partkey={_east('a.p_partkey')} OR b.p_partkey={_north('a.p_partkey')}"""
