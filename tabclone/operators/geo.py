"""Coordinates: one displacement for each site, and new sites around given anchors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import BadAnchors, BadSite, CoordinateAction, CoordinatesAllowed, CoordinatesSuspected, GeoAnchorMissing, GeoConsolidated, GeoUngrouped, GeoUnplaced, UnmaskedCoordinates, warn  # type: ignore[attr-defined]
from ..functions import rng
from ..functions.patterns import COORDINATE_NAME, matches
from ..plans.plan import Plan
from .profile import coordinate_shaped

KM = 111.32
TWO_PI = 6.283185307179586


@dataclass(frozen=True)
class CoordSpec:
    lat: str
    lon: str
    by: str | tuple[str, ...] = "coordinate"  # or "row", or the columns that name a site
    method: str = "donut"
    min_km: float = 5.0
    max_km: float = 20.0
    sd_km: float = 10.0
    max_tries: int = 100


def guard(df: DataFrame, plan: Plan, specs: list[CoordSpec], allow: bool = False) -> None:
    """Refuses kept columns that are named like coordinates and not displaced; warns of those that only look like it."""
    shown = {c for s in specs for c in (s.lat, s.lon)}
    for s in specs:
        for c in (s.lat, s.lon):
            if plan[c].action != "keep":
                raise CoordinateAction(f"{c} is displaced in place, so its action has to be keep", c)
    kept = [c for c in plan.cols(action="keep", kind=("numeric", "integer")) if c not in shown]
    if named := [c for c in kept if matches(c, COORDINATE_NAME)]:
        if not allow:
            raise UnmaskedCoordinates(f"kept columns are named like coordinates: {named}", named)
        warn(CoordinatesAllowed, f"coordinates are kept as asked for: {named}")
    rest = [c for c in kept if c not in named]
    if rest and (like := coordinate_shaped(df.select(*(F.col(f"`{c}`") for c in rest)))):
        warn(CoordinatesSuspected, f"kept columns look like coordinates: {like}")


def site_key(spec: CoordSpec, rid: str | None) -> Column:
    if spec.by == "row":
        return F.col(f"`{rid}`").cast("string")
    cols = (spec.lat, spec.lon) if spec.by == "coordinate" else ((spec.by,) if isinstance(spec.by, str) else spec.by)
    return F.concat_ws("\r", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in cols))


def displaced(seed: str, stream: str, key: Column, lat: Column, lon: Column, spec: CoordSpec, step: Column) -> tuple[Column, Column]:
    """New coordinates of a site: radius and bearing (donut) or two normals' stand-ins; step numbers the tries."""
    at = F.concat_ws("#", key, step.cast("string"))
    u, v = rng.uniform(seed, f"{stream}:radius", at), rng.uniform(seed, f"{stream}:bearing", at)
    if spec.method == "donut":
        r = F.sqrt(F.lit(spec.min_km**2) + u * F.lit(spec.max_km**2 - spec.min_km**2))
    else:
        r = F.lit(spec.sd_km) * F.sqrt(-2 * F.log(1 - u))  # both axes normal with sd_km
    north, east = r * F.cos(v * TWO_PI), r * F.sin(v * TWO_PI)
    return lat + north / KM, lon + east / (KM * F.cos(F.radians(lat)))


def sites(df: DataFrame, spec: CoordSpec, rid: str | None) -> DataFrame:
    """__site, its centre (weighted by rows), how many rows and how many different pairs it has."""
    keyed = df.select(site_key(spec, rid).alias("__site"), F.col(f"`{spec.lat}`").cast("double").alias("lat"), F.col(f"`{spec.lon}`").cast("double").alias("lon")).where("lat IS NOT NULL AND lon IS NOT NULL")
    return keyed.groupBy("__site").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("n"), F.count_distinct("lat", "lon").alias("pairs"))


def geomask(df: DataFrame, spec: CoordSpec, seed: str, rid: str | None = None, on_land: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """df with one displacement for each site, rounded to five decimals; either axis missing makes both missing.

    on_land(lon, lat) gives a condition that a place has to meet: tries are repeated, and a site that is never placed gets nulls.
    """
    if spec.method not in ("donut", "gaussian") or not 0 <= spec.min_km < spec.max_km or spec.max_tries < 1:
        raise BadSite(f"no valid displacement: {spec}")
    if spec.by == "row" and rid is None:
        raise BadSite("displacing rows needs a row id")
    if spec.by == "row":
        warn(GeoUngrouped, "rows of one site are displaced apart: averaging them recovers the site")
    table = sites(df, spec, rid)
    if spec.by not in ("row", "coordinate") and table.where("pairs > 1").limit(1).count():
        warn(GeoConsolidated, "rows of a site with different coordinates are moved to their centre first")
    stream = f"geo:{spec.lat}:{spec.lon}"
    if on_land is None:
        y, x = displaced(seed, stream, F.col("__site"), F.col("lat"), F.col("lon"), spec, F.lit(1))
        placed = table.select("__site", y.alias("__lat"), x.alias("__lon"))
    else:
        tries = table.withColumn("try", F.explode(F.sequence(F.lit(1), F.lit(spec.max_tries))))
        y, x = displaced(seed, stream, F.col("__site"), F.col("lat"), F.col("lon"), spec, F.col("try"))
        fits = tries.select("__site", "try", y.alias("y"), x.alias("x")).where(on_land(F.col("x"), F.col("y")))
        best = fits.groupBy("__site").agg(F.min_by(F.struct("y", "x"), "try").alias("p"))
        placed = table.join(best, "__site", "left").select("__site", F.col("p.y").alias("__lat"), F.col("p.x").alias("__lon"))
        if placed.where("__lat IS NULL").limit(1).count():
            warn(GeoUnplaced, "some sites found no valid place and have no coordinates")
    joined = df.withColumn("__key", site_key(spec, rid)).join(placed, F.col("__key") == F.col("__site"), "left")
    whole = F.col(f"`{spec.lat}`").isNotNull() & F.col(f"`{spec.lon}`").isNotNull()
    new = {spec.lat: F.when(whole, F.round("__lat", 5)), spec.lon: F.when(whole, F.round("__lon", 5))}
    return joined.select(*((new[c].alias(c) if c in new else F.col(f"`{c}`")) for c in df.columns))


def reanchor(synth: DataFrame, original: DataFrame, anchor: str, lat: str, lon: str, centroids: dict[str, tuple[float, float]], rid: str, seed: str, spread: float = 0.6, scatter: float = 0.05) -> DataFrame:
    """synth with coordinates around given centroids: as many sites for each anchor as it really has, rows dealt out in proportion
    to the real sites' rows, and scattered; missing where the original's are."""
    for k, v in centroids.items():
        if len(v) != 2 or not -90 <= v[0] <= 90 or not -180 <= v[1] <= 180:
            raise BadAnchors(f"no valid centroid for {k!r}: {v}", k)
    spark = synth.sparkSession
    spots = original.where(F.col(lat).isNotNull() & F.col(lon).isNotNull() & F.col(anchor).isNotNull()).groupBy(F.col(anchor).cast("string").alias("__anchor"), lat, lon).agg(F.count("*").alias("n"))
    # sites are numbered by size, so that real coordinates leave no trace
    w = Window.partitionBy("__anchor").orderBy(F.desc("n"), lat, lon)
    numbered = spots.select("__anchor", "n", F.row_number().over(w).alias("site"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto"), F.sum("n").over(Window.partitionBy("__anchor")).alias("total"))
    places = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in centroids.items()], "__anchor string, clat double, clon double")
    key = F.concat_ws("#", "__anchor", F.col("site").cast("string"))
    made = numbered.join(places, "__anchor", "left").select("__anchor", ((F.col("upto") - F.col("n")) / F.col("total")).alias("__lo"), (F.col("upto") / F.col("total")).alias("__hi"), (F.col("clat") + (rng.uniform(seed, "anchor-lat", key) * 2 - 1) * spread).alias("__clat"), (F.col("clon") + (rng.uniform(seed, "anchor-lon", key) * 2 - 1) * spread).alias("__clon"))
    if made.where("__clat IS NULL").limit(1).count():
        warn(GeoAnchorMissing, "some anchors have no centroid: their rows have no coordinates")
    r = F.col(f"`{rid}`")
    own = synth.withColumn("__u", rng.uniform(seed, "anchor-pick", r)).alias("l")
    joined = own.join(made.alias("r"), (F.col(f"l.`{anchor}`").cast("string") == F.col("r.__anchor")) & (F.col("__u") >= F.col("__lo")) & (F.col("__u") < F.col("__hi")), "left")
    known = original.select(F.col(f"`{rid}`").alias("__rid"), (F.col(lat).isNotNull() & F.col(lon).isNotNull()).alias("__has"))
    joined = joined.join(known, F.col(f"l.`{rid}`") == F.col("__rid"), "left")
    move = lambda c, s: F.when(F.col("__has"), F.round(F.col(c) + (rng.uniform(seed, s, F.col(f"l.`{rid}`")) * 2 - 1) * scatter, 5))
    new = {lat: move("__clat", "scatter-lat"), lon: move("__clon", "scatter-lon")}
    return joined.select(*((new[c].alias(c) if c in new else F.col(f"l.`{c}`")) for c in synth.columns))
