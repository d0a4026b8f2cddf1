"""Queries over the given tables and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from blackspot.clustering.dbscan import dbscan, dbscan_summary, neighbor_counts
from blackspot.clustering import mixture, seeding
from blackspot.clustering.hierarchical import LINKAGES, hierarchical
from blackspot.clustering.kmeans import MAX_ITER, kmeans, lay_out, lloyd
from blackspot.clustering.points import X_SHIFT, Y_SHIFT, label_rows, place, positions
from blackspot.operators import clean, layers, neighborhood, ranking, rates, regions
from blackspot.plans.hotspots import CLUSTER, ranked_hotspots, urban_rural_hotspots
from blackspot.runtime import cut, scratch_path
from blackspot.sources import laid_out, readers, urls, writers
from blackspot.sources.crash_view import crash_cte, crash_view
from blackspot.sources.schema import CRASH_COLUMNS, CRASH_SCHEMA, centroid_schema

# Parameters of the checks.
BOXES = [regions.Region("r0", 25.89, 25.91, -106.51, -106.49),
         regions.Region("r1", 33.258787, 33.278787, -100.594413, -100.574413),
         regions.Region("r2", 30.227574, 30.247574, -94.678826, -94.658826),
         regions.Region("r3", 27.196361, 27.216361, -101.563239, -101.543239)]
YEAR = 1997
PER_CLUSTER = 250
CELL_E6 = 250_000
RANK, MILES = 3, 50
LAST_RANK = 25
MIN_CRASHES = 40
URBAN_CRASHES = 50
# Side of the cells that stand for regions of their own, and crashes per cluster in them.
REGION_E6, PER_REGION_CLUSTER = 2000, 5
EPS_E6, MIN_SAMPLES = 3000, 100
# Files of the laid-out table.
FILES = 64

COLUMNS = ", ".join(CRASH_COLUMNS)
BASE = crash_cte()
RECURSIVE = BASE.replace("WITH", "WITH RECURSIVE", 1)


def celled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean crashes with a cheap exact cluster label: the number of their grid cell."""
    placed = place(crash_view(spark, sf_dir))
    cell = lambda c: F.floor(F.col(c) / F.lit(CELL_E6))
    return placed.withColumn("cluster", cell("y") * 10000 + cell("x")).drop("x", "y")


CELLED = (f"{BASE}, cl AS (SELECT *, ((lat_e6 + {Y_SHIFT}) // {CELL_E6}) * 10000 + (lon_e6 + {X_SHIFT}) // {CELL_E6} AS cluster FROM pts)")
RATED = f"""{CELLED}, rated AS (
  SELECT cluster, CAST(sum(CAST(Latitude AS DECIMAL(18,9))) AS DOUBLE) / count(*) AS centroid_latitude,
    CAST(sum(CAST(Longitude AS DECIMAL(18,9))) AS DOUBLE) / count(*) AS centroid_longitude,
    CAST(sum(Death_Cnt) AS DOUBLE) / count(Death_Cnt) AS fatality_rate, count(*) AS crashes
  FROM cl GROUP BY cluster)"""
NEAR = f"""{RATED}, focus AS (
  SELECT centroid_latitude AS lat0, centroid_longitude AS lon0 FROM rated
  ORDER BY fatality_rate DESC NULLS LAST, cluster LIMIT 1 OFFSET {RANK - 1}),
near AS (SELECT * FROM (SELECT rated.*, sqrt((centroid_latitude - lat0) * (centroid_latitude - lat0)
    + (centroid_longitude - lon0) * (centroid_longitude - lon0)) * 69.0::DOUBLE AS distance FROM rated, focus) WHERE distance <= {MILES}),
scaled AS (SELECT near.*, (fatality_rate - lo) / nullif(hi - lo, 0) AS color_value
  FROM near, (SELECT min(fatality_rate) AS lo, max(fatality_rate) AS hi FROM near))"""


def hex_sql(value: str) -> str:
    step = f"least(CAST(floor({value} * 256) AS BIGINT), 255)"
    return (f"CASE WHEN {value} IS NULL THEN NULL ELSE printf('#%02x%02x00', {step}, "
            f"CAST(round(128.0::DOUBLE * (1.0::DOUBLE - {step} / 255.0::DOUBLE)) AS BIGINT)) END")


def curve_sql(src: str) -> list[str]:
    """``p0``, the rows of ``src`` with their position, and ``spots``, the different positions with their place ``z`` on the curve."""
    ctes = [f"p0 AS (SELECT {src}.*, lon_e6 + {X_SHIFT} AS x, lat_e6 + {Y_SHIFT} AS y FROM {src})"]
    for i, shift, mask in ((1, 16, 0x0000FFFF0000FFFF), (2, 8, 0x00FF00FF00FF00FF), (3, 4, 0x0F0F0F0F0F0F0F0F),
                           (4, 2, 0x3333333333333333), (5, 1, 0x5555555555555555)):
        sx, sy = ("x", "y") if i == 1 else ("mx", "my")
        drop = "*" if i == 1 else "* EXCLUDE (mx, my)"
        ctes.append(f"p{i} AS (SELECT {drop}, ({sx} | ({sx} << {shift})) & {mask} AS mx, ({sy} | ({sy} << {shift})) & {mask} AS my FROM p{i - 1})")
    ctes.append("spots AS MATERIALIZED (SELECT x, y, count(*) AS w, any_value(mx | (my << 1)) AS z FROM p5 GROUP BY x, y)")
    return ctes


def lloyd_sql(rounds: int, src: str = "pts") -> str:
    """K-means over the rows of ``src`` as plain SQL: every point against every centre, the rounds written out."""
    ctes = curve_sql(src)
    ctes.append("summed AS (SELECT *, CAST(sum(w) OVER (ORDER BY z) AS BIGINT) AS cum FROM spots)")
    ctes.append(f"c0 AS MATERIALIZED (SELECT cum // {PER_CLUSTER} - 1 AS cid, x AS cx, y AS cy FROM summed "
                f"WHERE cum // {PER_CLUSTER} > (cum - w) // {PER_CLUSTER})")
    for i in range(rounds + 1):
        ctes.append(f"""a{i} AS MATERIALIZED (SELECT x, y, any_value(w) AS w, arg_min(cid, CAST(d2 AS HUGEINT) * 1000000 + cid) AS cid FROM (
  SELECT x, y, w, cid, (x - cx) * (x - cx) + (y - cy) * (y - cy) AS d2 FROM spots, c{i}) GROUP BY x, y)""")
        if i < rounds:
            ctes.append(f"""c{i + 1} AS MATERIALIZED (SELECT c{i}.cid, coalesce(mx, cx) AS cx, coalesce(my, cy) AS cy FROM c{i} LEFT JOIN (
  SELECT cid, CAST(sum(w * x) // sum(w) AS BIGINT) AS mx, CAST(sum(w * y) // sum(w) AS BIGINT) AS my FROM a{i} GROUP BY cid) USING (cid))""")
    return ", ".join(ctes)


def drawn_sql() -> str:
    """Oversampled seeds over all positions and candidates, all rounds written out: ``s0``, and ``s{REDUCE_ROUNDS}`` after k-means over the candidates."""
    def hashed(turn: int) -> str:
        text = seeding.HASH_SQL[0].format(turn=turn)
        for step in seeding.HASH_SQL[1:]:
            text = step.replace("h", f"({text})")
        return text
    d2 = lambda a, b: f"({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y)"
    ctes = [f"quota AS (SELECT CAST(greatest(sum(w) // {PER_CLUSTER}, 1) AS BIGINT) AS k, CAST(sum(w) AS BIGINT) AS total FROM spots)",
            f"q0 AS MATERIALIZED (SELECT x, y, z FROM spots ORDER BY {hashed(0)}, z LIMIT 1)"]
    for i in range(1, seeding.DRAWS + 1):
        ctes.append(f"n{i} AS MATERIALIZED (SELECT s.x, s.y, any_value(w) AS w, any_value(s.z) AS z, min({d2('s', 'q')}) AS d2 FROM spots s, q{i - 1} q GROUP BY s.x, s.y)")
        ctes.append(f"""q{i} AS MATERIALIZED (SELECT * FROM q{i - 1} UNION ALL SELECT x, y, z FROM n{i}, quota, (SELECT CAST(sum(CAST(w AS HUGEINT) * d2) AS DOUBLE) AS cost FROM n{i})
  WHERE CAST({hashed(i)} AS DOUBLE) * cost < CAST(w AS DOUBLE) * CAST(d2 AS DOUBLE) * CAST({seeding.OVERSAMPLE} * k * {seeding.PRIME} AS DOUBLE))""")
    near = lambda a, b: f"arg_min({b}.cid, CAST({d2(a, b)} AS HUGEINT) * 1000000 + {b}.cid)"
    ctes.append(f"""cand AS MATERIALIZED (SELECT q.x, q.y, q.z, own.w FROM (SELECT cid, CAST(sum(w) AS BIGINT) AS w FROM (
    SELECT any_value(w) AS w, {near('s', 'q')} AS cid FROM spots s, (SELECT *, row_number() OVER (ORDER BY z) AS cid FROM q{seeding.DRAWS}) q GROUP BY s.x, s.y)
  GROUP BY cid) own JOIN (SELECT *, row_number() OVER (ORDER BY z) AS cid FROM q{seeding.DRAWS}) q USING (cid))""")
    ctes.append("""heaviest AS (SELECT *, row_number() OVER heavy AS i, sum(w) OVER heavy AS upto FROM cand WINDOW heavy AS (ORDER BY w DESC, z ROWS UNBOUNDED PRECEDING)),
outright AS MATERIALIZED (SELECT heaviest.*, i < (SELECT coalesce(min(i), 1e15) FROM heaviest, quota WHERE CAST(w AS HUGEINT) * (k - i + 1) < total - (upto - w)) AS taken FROM heaviest),
share AS (SELECT any_value(k) - count(*) FILTER (taken) AS k, CAST(coalesce(sum(w) FILTER (NOT taken), 0) AS BIGINT) AS rest FROM outright, quota),
passing AS (SELECT *, CAST(sum(w) OVER (ORDER BY z) AS HUGEINT) AS cum FROM outright WHERE NOT taken)""")
    ctes.append("""s0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY z) - 1 AS BIGINT) AS cid, x, y FROM (SELECT x, y, z FROM outright WHERE taken UNION ALL
  SELECT x, y, z FROM passing, share WHERE cum * k // rest > (cum - w) * k // rest))""")
    for i in range(seeding.REDUCE_ROUNDS):
        ctes.append(f"""s{i + 1} AS MATERIALIZED (SELECT s{i}.cid, coalesce(mx, x) AS x, coalesce(my, y) AS y FROM s{i} LEFT JOIN (
  SELECT cid, CAST(sum(w * x) // sum(w) AS BIGINT) AS mx, CAST(sum(w * y) // sum(w) AS BIGINT) AS my FROM (
    SELECT c.x, c.y, any_value(w) AS w, {near('c', 's')} AS cid FROM cand c, s{i} s GROUP BY c.x, c.y) GROUP BY cid) USING (cid))""")
    return ", ".join([*curve_sql("pts"), *ctes])


def regional(spark: SparkSession, sf_dir: str, linkage: str) -> DataFrame:
    """Every grid cell clustered on its own."""
    placed = place(crash_view(spark, sf_dir))
    cell = lambda c: F.expr(f"{c} div {REGION_E6}")
    rows = placed.withColumn("region", cell("y") * 1_000_000 + cell("x")).drop("x", "y")
    return hierarchical(rows, linkage, PER_REGION_CLUSTER, by="region").select("Crash_ID", "region", "hier_cluster")


def regional_sql(linkage: str) -> str:
    """One pair of clusters merged at a time in every cell, all distances between members looked at in every step."""
    d = "sqrt(CAST((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS DOUBLE))"
    height = {"single": f"min({d})", "complete": f"max({d})", "average": f"round(sum(CAST(a.w * b.w AS DOUBLE) * {d}) / sum(a.w * b.w), 3)"}.get(linkage)
    pairs = f"""SELECT a.region, a.c AS lo, b.c AS hi, {height} AS h, any_value(a.quota) AS quota, any_value(a.top) AS top
  FROM walk a JOIN walk b ON a.region = b.region AND a.c < b.c GROUP BY a.region, a.c, b.c"""
    if linkage == "ward":
        centre = "SELECT region, c, sum(w) AS n, sum(w * CAST(x AS DOUBLE)) / sum(w) AS cx, sum(w * CAST(y AS DOUBLE)) / sum(w) AS cy, any_value(quota) AS quota, any_value(top) AS top FROM walk GROUP BY region, c"
        pairs = f"""SELECT a.region, a.c AS lo, b.c AS hi, a.quota, a.top,
  sqrt(2 * CAST(a.n AS DOUBLE) * b.n / (a.n + b.n) * ((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy))) AS h
  FROM ({centre}) a JOIN ({centre}) b ON a.region = b.region AND a.c < b.c"""
    return f"""{RECURSIVE}, {", ".join(curve_sql("pts"))},
pos AS MATERIALIZED (SELECT (y // {REGION_E6}) * 1000000 + x // {REGION_E6} AS region, x, y, w, row_number() OVER (ORDER BY z) AS id FROM spots),
quotas AS (SELECT region, count(*) - greatest(CAST(sum(w) AS BIGINT) // {PER_REGION_CLUSTER}, 1) AS quota FROM pos GROUP BY region),
walk AS (SELECT CAST(0 AS BIGINT) AS step, region, id, x, y, w, id AS c, quota, CAST(NULL AS DOUBLE) AS top FROM pos JOIN quotas USING (region)
  UNION ALL SELECT step + 1, w.region, id, x, y, w.w, CASE WHEN w.c = best.hi THEN best.lo ELSE w.c END, w.quota, best.h
  FROM walk w JOIN (SELECT region, m.h AS h, m.lo AS lo, m.hi AS hi FROM (
    SELECT region, min({{'h': h, 'lo': lo, 'hi': hi}}) AS m FROM ({pairs}) GROUP BY region)) best USING (region)
  WHERE step < w.quota OR (w.quota > 0 AND best.h <= w.top)),
ends AS (SELECT * FROM walk QUALIFY step = max(step) OVER (PARTITION BY region)),
firsts AS (SELECT region, c, min(Crash_ID) AS f FROM ends JOIN p0 USING (x, y) GROUP BY region, c)
SELECT Crash_ID, region, dense_rank() OVER (PARTITION BY region ORDER BY f) AS hier_cluster FROM p0 JOIN ends USING (x, y) JOIN firsts USING (region, c)"""


def mixture_sql() -> str:
    """The mixture as a recursion that ends where the likelihood settles: all positions against all components in every round.

    ``gp`` has every position with the densities ``l`` of the components that matter there, the greatest ``top`` and
    the sum ``mass`` of all relative to it.
    """
    comp = lambda src: f"""SELECT *, ox + mx AS cx, oy + my AS cy, yy / det AS a, xy / det AS b, xx / det AS c,
    ln(r / total) - {mixture.LOG_2PI!r}::DOUBLE - ln(det) / 2.0::DOUBLE AS norm FROM (
  SELECT *, xx * yy - xy * xy AS det FROM (SELECT *, sxx / r - mx * mx + {mixture.FLOOR}::DOUBLE AS xx, syy / r - my * my + {mixture.FLOOR}::DOUBLE AS yy,
    sxy / r - mx * my AS xy FROM (SELECT *, sx / r AS mx, sy / r AS my FROM ({src})))), (SELECT CAST(sum(w) AS DOUBLE) AS total FROM spots)"""
    sums = ("any_value(ox) AS ox, any_value(oy) AS oy, sum(q) AS r, sum(q * (x - ox)) AS sx, sum(q * (y - oy)) AS sy, "
            "sum(q * (x - ox) * (x - ox)) AS sxx, sum(q * (x - ox) * (y - oy)) AS sxy, sum(q * (y - oy) * (y - oy)) AS syy")
    density = "norm - ((x - cx) * (x - cx) * a - 2.0::DOUBLE * ((x - cx) * (y - cy)) * b + (y - cy) * (y - cy) * c) / 2.0::DOUBLE"
    massed = lambda src: f"""SELECT *, list_sum(list_transform(l, lambda e: exp(e.d - top))) AS mass FROM (
    SELECT * EXCLUDE (l), list_filter(l, lambda e: e.d >= top - {mixture.DROP}::DOUBLE) AS l FROM (
      SELECT x, y, any_value(w) AS w, max(d) AS top, list({{'cid': cid, 'cx': cx, 'cy': cy, 'd': d}}) AS l, any_value(step) AS step, any_value(mean) AS mean
      FROM (SELECT x, y, w, step, mean, cid, cx, cy, {density} AS d FROM spots, {src}) GROUP BY x, y))"""
    first = f"""SELECT cid, {sums} FROM (SELECT cid, x, y, CAST(w AS DOUBLE) AS q, CAST(cx AS DOUBLE) AS ox, CAST(cy AS DOUBLE) AS oy
    FROM a0 JOIN c0 USING (cid)) GROUP BY cid"""
    shares = f"""SELECT x, y, step, mean, e.cid AS cid, e.cx AS ox, e.cy AS oy, w * exp(e.d - top) / mass AS q, CASE WHEN i = 1 THEN w * (top + ln(mass)) END AS ll
    FROM (SELECT *, unnest(l) AS e, unnest(range(1, len(l) + 1)) AS i FROM ({massed(f"(SELECT * FROM em WHERE step < {mixture.MAX_ROUNDS})")}))"""
    now = f"""SELECT *, sum(ll) OVER () / (SELECT sum(w) FROM spots) AS now FROM (
    SELECT cid, any_value(step) + 1 AS step, any_value(mean) AS mean, {sums}, sum(ll) AS ll FROM ({shares}) GROUP BY cid)"""
    more = f"SELECT * FROM ({now}) WHERE r > 0 AND (mean IS NULL OR now - mean >= {mixture.GAIN}::DOUBLE)"
    facts = "cid, cx, cy, a, b, c, norm"
    return f"""em AS (SELECT 0 AS step, {facts}, CAST(NULL AS DOUBLE) AS mean FROM ({comp(first)})
  UNION ALL SELECT step, {facts}, now FROM ({comp(more)})),
gp AS MATERIALIZED ({massed("(SELECT * FROM em WHERE step = (SELECT max(step) FROM em))")})"""


RATES_SQL = """CAST(sum(CAST(Latitude AS DECIMAL(18,9))) AS DOUBLE) / count(*) AS centroid_latitude,
  CAST(sum(CAST(Longitude AS DECIMAL(18,9))) AS DOUBLE) / count(*) AS centroid_longitude,
  CAST(sum(Death_Cnt) AS DOUBLE) / count(Death_Cnt) AS fatality_rate, count(*) AS crashes"""
MIXED = f"{RECURSIVE}, {lloyd_sql(0)}, {mixture_sql()}"
CLUSTERED = f"{BASE}, {lloyd_sql(MAX_ITER)}, kc AS (SELECT p0.*, cid AS {CLUSTER} FROM p0 JOIN a{MAX_ITER} USING (x, y))"


def nearest_centroid(spark, sf_dir):
    """Crashes with the nearest seed: the first assignment step of k-means."""
    placed = place(crash_view(spark, sf_dir))
    labels, _, _ = lloyd(positions(placed), PER_CLUSTER, max_iter=0)
    return label_rows(placed, labels, "cid").select("Crash_ID", "cid")


def kmeans_parallel_seeds(spark, sf_dir):
    """Centres that k-means starts from when they are oversampled by distance."""
    return seeding.parallel_start(lay_out(positions(place(crash_view(spark, sf_dir)))), PER_CLUSTER)[0]


def kmeans_lloyd(spark, sf_dir):
    """Clusters of centres that rest, or of the last of ``MAX_ITER`` rounds."""
    return kmeans(crash_view(spark, sf_dir), PER_CLUSTER, tolerance=0.0).select("Crash_ID", CLUSTER)


def hotspot_pipeline(spark, sf_dir):
    return ranked_hotspots(crash_view(spark, sf_dir), per_cluster=PER_CLUSTER, tolerance=0.0)


def gmm_shares(spark, sf_dir):
    """Shares of components in thousandths, one row per crash and component with at least half of one."""
    # Other columns would travel with the rows.
    shared = mixture.shares(crash_view(spark, sf_dir).select("Crash_ID", "Latitude", "Longitude")).select("Crash_ID", F.explode("gmm_shares").alias("s"))
    return (shared.select("Crash_ID", "s.component", F.round(F.col("s.share") * 1000).cast("bigint").alias("share_permille"))
            .filter("share_permille > 0"))


def rated(spark, sf_dir):
    return rates.fatality_rate(celled(spark, sf_dir), "cluster", with_size=True)


def text_coordinates(spark, sf_dir):
    """Coordinates as text, some of them unreadable, cleaned."""
    text = crash_view(spark, sf_dir).withColumns({
        "Latitude": F.when(F.col("Crash_ID") % 41 == 0, F.lit("unknown")).otherwise(F.col("Latitude").cast("string")),
        "Longitude": F.when(F.col("Crash_ID") % 43 == 0, F.lit("NaN")).otherwise(F.col("Longitude").cast("string"))})
    return clean.clean_coordinates(text).select("Crash_ID", "Latitude", "Longitude")


def cm(c: str):
    """Metres as whole centimetres."""
    return F.round(F.col(c) * 100).cast("bigint")


def web_mercator(spark, sf_dir):
    df = clean.web_mercator(clean.clean_coordinates(crash_view(spark, sf_dir)))
    return df.select("Crash_ID", cm("x").alias("x_cm"), cm("y").alias("y_cm"))


MERCATOR = ("6378137.0::DOUBLE * radians({lon})", "6378137.0::DOUBLE * ln(tan(0.7853981633974483::DOUBLE + radians({lat}) / 2.0::DOUBLE))")


def mercator_sql(lat: str, lon: str) -> tuple[str, str]:
    return MERCATOR[0].format(lon=lon), MERCATOR[1].format(lat=lat)


def extent_buffered(spark, sf_dir):
    df = clean.extent(clean.web_mercator(clean.clean_coordinates(crash_view(spark, sf_dir))), layers.BUFFER_RATIO)
    return df.select(*[cm(c).alias(f"{c}_cm") for c in df.columns])


def cluster_layer(spark, sf_dir):
    df = layers.cluster_layer(celled(spark, sf_dir), "cluster")
    return df.select("Crash_ID", cm("x").alias("x_cm"), cm("y").alias("y_cm"), "cluster", "slot")


def centroid_layer(spark, sf_dir):
    df = layers.centroid_layer(rated(spark, sf_dir), "cluster")
    return df.select("cluster", "fatality_rate", "color_value",
                     *[cm(c).alias(f"{c}_cm") for c in ("x", "y", "min_x", "max_x", "min_y", "max_y")])


def page_urls(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")


def uri_split(spark, sf_dir):
    """Addresses as they are, and as keys of a store with blanks, signs and underscores in them; some are none."""
    page = page_urls(spark, sf_dir)
    rest = F.regexp_replace("url", "^[a-z]+://", "")
    made = page.select("page_id", F.explode(F.array(
        F.col("url"), F.concat(F.lit("s3://my_bucket/a b/"), rest, F.lit("#1?v=2.csv")), F.concat(F.lit("S3A://b.c//"), rest), rest)).alias("url"))
    return made.select("page_id", urls.bucket(F.col("url")).alias("bucket"), urls.object_key(F.col("url")).alias("object_key"))


def uri_normalize(spark, sf_dir):
    """Page addresses as object-store addresses, those with a query part already in the new scheme."""
    scheme = F.when(F.col("url").contains("?"), F.lit("s3a://")).otherwise(F.lit("s3://"))
    stored = F.concat(scheme, F.regexp_replace("url", "^[a-z]+://", ""))
    return page_urls(spark, sf_dir).select("page_id", urls.to_s3a(stored).alias("url"))


def csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "centroids")
    writers.write_centroids(rated(spark, sf_dir).drop("crashes"), path)
    return readers.read_csv_directory(spark, path, centroid_schema("cluster"))


def crash_csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "crashes")
    crash_view(spark, sf_dir).write.option("header", True).csv(path)
    return readers.read_crashes(spark, path)


def crash_csv_mixed(spark, sf_dir):
    """Crash files with different orders of columns, with more columns, and with counts written as 1.0."""
    root = scratch_path(spark, "mixed")
    whole = crash_view(spark, sf_dir)
    odd = F.pmod("Crash_ID", F.lit(3))
    counts = [c for c in CRASH_COLUMNS if c.endswith("_Cnt")]
    whole.filter(odd == 0).write.option("header", True).csv(f"{root}/a")
    whole.filter(odd == 1).select(*CRASH_COLUMNS[::-1]).write.option("header", True).csv(f"{root}/b")
    (whole.filter(odd == 2).withColumns({c: F.col(c).cast("double") for c in counts}).withColumn("Agency", F.lit("x, y"))
     .select("Agency", *sorted(CRASH_COLUMNS)).write.option("header", True).csv(f"{root}/c"))
    return readers.read_crashes(spark, [f"{root}/{x}" for x in "abc"])


def crash_csv_typed(spark, sf_dir):
    """Crash files with other columns of all kinds, some of them not in all files, read with the types that fit."""
    root = scratch_path(spark, "typed")
    n = F.col("Crash_ID")
    kinds = {"Speed": F.when(n % 5 != 0, (n % 70).cast("string")), "Zip": (n % 90000 + 10000).cast("string"),
             "Seen": F.when(n % 7 != 0, F.concat((n % 12 + 1).cast("string"), F.lit("/9/2021"))),
             "Note": F.when(n % 2 == 0, (n % 10).cast("string")).otherwise(F.lit("1/2/2020")), "Serial": F.concat(F.lit("9"), F.lpad((n % 1000).cast("string"), 20, "0")),
             "Blank": F.lit(None).cast("string")}
    whole = crash_view(spark, sf_dir).withColumns(kinds)
    odd = F.pmod("Crash_ID", F.lit(3))
    whole.filter(odd == 0).write.option("header", True).csv(f"{root}/a")
    whole.filter(odd == 1).withColumn("Speed", F.concat("Speed", F.lit(".5"))).select(*whole.columns[::-1]).write.option("header", True).csv(f"{root}/b")
    whole.filter(odd == 2).drop("Zip", "Note").write.option("header", True).csv(f"{root}/c")
    read = readers.read_crashes(spark, [f"{root}/{x}" for x in "abc"], all_columns=True)
    kinds = F.lit(" ".join(read.schema[c].dataType.simpleString() for c in kinds))
    return read.select("Crash_ID", "Latitude", "Speed", "Zip", F.date_format("Seen", "yyyy-MM-dd").alias("Seen"), "Note", "Serial", "Blank", kinds.alias("kinds"))


def region_counts_laid_out(spark, sf_dir):
    """Counts of regions from the files of a laid-out table whose boxes they meet."""
    path = scratch_path(spark, "laid_out")
    laid_out.write_laid_out(clean.project_crashes(crash_view(spark, sf_dir)), path, FILES)
    return regions.region_counts(laid_out.read_near_regions(spark, path, BOXES), BOXES)


def multi_file_union(spark, sf_dir):
    """CSV files with different columns in different orders below one directory, as one table."""
    root = scratch_path(spark, "parts")
    whole = rated(spark, sf_dir).drop("crashes")
    writers.write_centroids(whole.filter("fatality_rate > 0"), f"{root}/a/deep")
    writers.write_centroids(whole.filter("fatality_rate = 0").select(*reversed(whole.drop("fatality_rate").columns)), f"{root}/b")
    return readers.read_csv_directory(spark, root, centroid_schema("cluster"))


def region_export(spark, sf_dir):
    path = scratch_path(spark, "regions")
    writers.write_partitioned(regions.tag_regions(clean.project_crashes(crash_view(spark, sf_dir)), BOXES), path, "region", "csv")
    schema = T.StructType([*CRASH_SCHEMA.fields, T.StructField("region", T.StringType())])
    return spark.read.schema(schema).option("header", True).csv(path)


def year_export(spark, sf_dir):
    path = scratch_path(spark, "years")
    dated = clean.parse_dates(crash_view(spark, sf_dir)).withColumn("crash_year", F.year("Crash_Date"))
    writers.write_partitioned(dated, path, "crash_year")
    back = spark.read.parquet(path).filter(F.col("crash_year") == YEAR)
    return back.select("Crash_ID", F.date_format("Crash_Date", "yyyy-MM-dd").alias("Crash_Date"), "Death_Cnt", "crash_year")


QUERIES = {
    "scan_project": lambda s, d: clean.project_crashes(crash_view(s, d)),
    "null_profile": lambda s, d: clean.null_profile(crash_view(s, d)),
    "clean_coords": text_coordinates,
    "region_filter": lambda s, d: regions.filter_region(crash_view(s, d), BOXES[0][1:3], BOXES[0][3:5]),
    "region_counts": lambda s, d: regions.region_counts(crash_view(s, d), BOXES),
    "year_filter": lambda s, d: clean.filter_year(crash_view(s, d), YEAR).withColumn(
        "Crash_Date", F.date_format("Crash_Date", "yyyy-MM-dd")),
    "uri_split": uri_split,
    "uri_normalize": uri_normalize,
    "web_mercator": web_mercator,
    "extent_buffered": extent_buffered,
    "cluster_layer": cluster_layer,
    "centroid_layer": centroid_layer,
    "cluster_count_estimate": lambda s, d: rates.cluster_count(clean.clean_coordinates(crash_view(s, d))),
    "nearest_centroid": nearest_centroid,
    "kmeans_parallel_seeds": kmeans_parallel_seeds,
    "kmeans_lloyd": kmeans_lloyd,
    "hotspot_pipeline": hotspot_pipeline,
    "fatality_rate": rated,
    "rank_clusters": lambda s, d: ranking.rank_clusters(rated(s, d), "cluster"),
    "rank_clusters_min_n": lambda s, d: ranking.rank_clusters(rated(s, d), "cluster", MIN_CRASHES),
    "nth_cluster": lambda s, d: ranking.nth_cluster(rated(s, d), "cluster", RANK),
    "radius_neighbors": lambda s, d: neighborhood.radius_neighbors(rated(s, d), "cluster", RANK, MILES),
    "normalize_rate": lambda s, d: neighborhood.normalize_rate(
        neighborhood.radius_neighbors(rated(s, d), "cluster", RANK, MILES)),
    "normalize_rate_global": lambda s, d: neighborhood.normalize_rate(rated(s, d)).select("cluster", "fatality_rate", "color_value"),
    "color_hex": lambda s, d: neighborhood.with_color(neighborhood.normalize_rate(rated(s, d))).select("cluster", "color_value", "color_hex"),
    "categorical_slot": lambda s, d: layers.categorical_slots(celled(s, d), "cluster"),
    "marker_table": lambda s, d: neighborhood.marker_table(rated(s, d), "cluster", RANK, MILES),
    "marker_table_ranks": lambda s, d: neighborhood.marker_table_ranks(rated(s, d), "cluster", 1, LAST_RANK, MILES),
    "eps_neighbor_counts": lambda s, d: neighbor_counts(crash_view(s, d), EPS_E6 / 1e6).select("Crash_ID", "neighbors"),
    "dbscan": lambda s, d: dbscan(crash_view(s, d), EPS_E6 / 1e6, MIN_SAMPLES).select("Crash_ID", "DBSCAN_cluster"),
    "dbscan_summary": lambda s, d: dbscan_summary(dbscan(crash_view(s, d), EPS_E6 / 1e6, MIN_SAMPLES)),
    "density_split": lambda s, d: regions.density_split(crash_view(s, d), URBAN_CRASHES).select(
        "Crash_ID", "cell_lat", "cell_lon", "area"),
    "urban_areas": lambda s, d: regions.urban_areas(crash_view(s, d), URBAN_CRASHES),
    "region_counts_laid_out": region_counts_laid_out,
    "crash_csv_typed": crash_csv_typed,
    "csv_roundtrip": csv_roundtrip,
    "crash_csv_roundtrip": crash_csv_roundtrip,
    "crash_csv_mixed": crash_csv_mixed,
    "multi_file_union": multi_file_union,
    "region_export": region_export,
    "year_export": year_export,
    **{f"hier_{linkage}": lambda s, d, linkage=linkage: hierarchical(crash_view(s, d), linkage).select("Crash_ID", "hier_cluster")
       for linkage in LINKAGES},
    **{f"hier_region_{linkage}": lambda s, d, linkage=linkage: regional(s, d, linkage) for linkage in LINKAGES},
    "gmm": lambda s, d: mixture.gmm(crash_view(s, d)).select("Crash_ID", "gmm_cluster"),
    "gmm_shares": gmm_shares,
    "urban_rural_hotspots": lambda s, d: urban_rural_hotspots(crash_view(s, d), URBAN_CRASHES, EPS_E6 / 1e6, MIN_SAMPLES, PER_CLUSTER,
                                                              tolerance=0.0),
}


def box_sql(r: regions.Region) -> str:
    e6 = lambda v: round(v * 1e6)
    return f"lat_e6 BETWEEN {e6(r.lat_min)} AND {e6(r.lat_max)} AND lon_e6 BETWEEN {e6(r.lon_min)} AND {e6(r.lon_max)}"


IN_BOXES = " UNION ALL ".join(f"SELECT pts.*, '{r.name}' AS region FROM pts WHERE {box_sql(r)}" for r in BOXES)
PX, PY = mercator_sql("Latitude", "Longitude")
CX, CY = mercator_sql("centroid_latitude", "centroid_longitude")
CM = "CAST(round(({}) * 100) AS BIGINT)"


def extent_sql(x: str, y: str) -> str:
    r = f"{layers.BUFFER_RATIO}::DOUBLE"
    sides = []
    for v, n in ((x, "x"), (y, "y")):
        span = f"(max({v}) - min({v})) * {r}"
        sides += [f"{CM.format(f'min({v}) - {span}')} AS min_{n}_cm", f"{CM.format(f'max({v}) + {span}')} AS max_{n}_cm"]
    return ", ".join(sides)


def pairs_sql(src: str = "pts") -> str:
    """All pairs of neighbours among the rows of ``src``, and their number for each crash."""
    return f"""cells AS (SELECT Crash_ID, lat_e6, lon_e6, lat_e6 // {EPS_E6} AS a, (lon_e6 + {X_SHIFT}) // {EPS_E6} AS b FROM {src}),
wide AS MATERIALIZED (SELECT Crash_ID AS other, lat_e6 AS lat2, lon_e6 AS lon2, a + i AS a, b + j AS b
  FROM cells, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)),
pairs AS MATERIALIZED (SELECT Crash_ID AS p, other AS q FROM cells JOIN wide USING (a, b)
  WHERE (lat_e6 - lat2) * (lat_e6 - lat2) + (lon_e6 - lon2) * (lon_e6 - lon2) <= {EPS_E6 * EPS_E6}),
counts AS MATERIALIZED (SELECT p, count(*) AS neighbors FROM pairs GROUP BY p)"""


def dbscan_sql(src: str = "pts") -> str:
    """Density clusters over all pairs of crashes: the lowest id spreads until nothing changes."""
    return f"""{pairs_sql(src)}, core AS MATERIALIZED (SELECT p FROM counts WHERE neighbors >= {MIN_SAMPLES}),
links AS MATERIALIZED (SELECT pairs.p, q FROM pairs JOIN core ON core.p = pairs.p WHERE q IN (SELECT p FROM core)),
low(p, r) USING KEY (p) AS (SELECT p, p AS r FROM core UNION
  SELECT links.p, min(low.r) AS r FROM links JOIN low ON low.p = q JOIN recurring.low AS now ON now.p = links.p
  GROUP BY links.p, now.r HAVING min(low.r) < now.r),
numbered AS MATERIALIZED (SELECT p, dense_rank() OVER (ORDER BY r) - 1 AS c FROM low),
edge AS (SELECT pairs.p, min(c) AS c FROM pairs JOIN numbered ON numbered.p = q WHERE pairs.p NOT IN (SELECT p FROM core) GROUP BY pairs.p),
dbs AS (SELECT {src}.*, coalesce(numbered.c, edge.c, -1) AS DBSCAN_cluster FROM {src}
  LEFT JOIN numbered ON numbered.p = Crash_ID LEFT JOIN edge ON edge.p = Crash_ID)"""


URBAN_AREAS = f"""{RECURSIVE}, cells AS (SELECT CAST(floor(lat_e6 / 1e5) AS BIGINT) AS a, CAST(floor(lon_e6 / 1e5) AS BIGINT) AS b,
  count(*) AS crashes, CAST(sum(Death_Cnt) AS BIGINT) AS deaths FROM pts GROUP BY 1, 2 HAVING count(*) >= {URBAN_CRASHES}),
nodes AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY a, b) AS id FROM cells),
links AS MATERIALIZED (SELECT n.id AS p, m.id AS q FROM (SELECT id, a + i AS a, b + j AS b FROM nodes,
  (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)) n JOIN nodes m USING (a, b) WHERE n.id <> m.id),
low(p, r) USING KEY (p) AS (SELECT id AS p, id AS r FROM nodes UNION
  SELECT links.p, min(low.r) AS r FROM links JOIN low ON low.p = q JOIN recurring.low AS now ON now.p = links.p
  GROUP BY links.p, now.r HAVING min(low.r) < now.r)
SELECT f.a AS area_lat, f.b AS area_lon, count(*) AS cells, CAST(sum(n.crashes) AS BIGINT) AS crashes, CAST(sum(n.deaths) AS BIGINT) AS deaths,
  CAST(sum(n.deaths) AS DOUBLE) / sum(n.crashes) AS fatality_rate FROM low JOIN nodes n ON n.id = p JOIN nodes f ON f.id = r GROUP BY f.a, f.b"""
DBSCAN = f"{RECURSIVE}, {dbscan_sql()}"
IN_CELL = "floor(lat_e6 / 1e5), floor(lon_e6 / 1e5)"
URBAN_RURAL = f"""{RECURSIVE}, k AS (SELECT *, count(*) OVER (PARTITION BY {IN_CELL}) >= {URBAN_CRASHES} AS urban FROM pts),
upts AS MATERIALIZED (SELECT * EXCLUDE (urban) FROM k WHERE urban), rpts AS MATERIALIZED (SELECT * EXCLUDE (urban) FROM k WHERE NOT urban),
{dbscan_sql("upts")}, {lloyd_sql(MAX_ITER, "rpts")},
both_ AS (SELECT 'urban' AS area, DBSCAN_cluster AS cluster, Latitude, Longitude, Death_Cnt FROM dbs WHERE DBSCAN_cluster >= 0
  UNION ALL SELECT 'rural', cid, Latitude, Longitude, Death_Cnt FROM p0 JOIN a{MAX_ITER} USING (x, y)),
r AS (SELECT area, cluster, {RATES_SQL} FROM both_ GROUP BY area, cluster)
SELECT *, row_number() OVER (ORDER BY fatality_rate DESC NULLS LAST, area, cluster) AS rank FROM r"""
RANKED = "row_number() OVER (ORDER BY fatality_rate DESC NULLS LAST, {}) AS rank"
TYPES = dict((f.name, f.dataType.simpleString()) for f in CRASH_SCHEMA)

ORACLES = {
    **{f"hier_region_{linkage}": regional_sql(linkage) for linkage in LINKAGES},
    "scan_project": f"{BASE} SELECT {COLUMNS} FROM crash",
    "null_profile": BASE + " " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{TYPES[c]}' AS data_type, count({c}) AS non_null FROM crash" for c in CRASH_COLUMNS),
    "clean_coords": f"{BASE} SELECT Crash_ID, Latitude, Longitude FROM pts WHERE Crash_ID % 41 <> 0 AND Crash_ID % 43 <> 0",
    "region_filter": f"{BASE} SELECT {COLUMNS} FROM pts WHERE {box_sql(BOXES[0])}",
    "region_counts": f"{BASE} SELECT region, count(*) AS crashes FROM ({IN_BOXES}) GROUP BY region",
    "year_filter": f"{BASE} SELECT * EXCLUDE (lat_e6, lon_e6) REPLACE (strftime(strptime(Crash_Date, '%m/%d/%Y'), '%Y-%m-%d') AS Crash_Date) "
                   f"FROM crash WHERE Crash_Date LIKE '%/{YEAR}'",
    "uri_split": r"WITH r AS (SELECT page_id, url, regexp_replace(url, '^[a-z]+://', '') AS rest FROM pages) "
                 r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS bucket, "
                 r"regexp_extract(url, '^[a-z]+://[^/?#]*/*([^?#]*)', 1) AS object_key FROM r UNION ALL "
                 r"SELECT page_id, 'my_bucket', 'a b/' || rest || '#1?v=2.csv' FROM r UNION ALL "
                 r"SELECT page_id, 'b.c', ltrim(rest, '/') FROM r UNION ALL SELECT page_id, NULL, NULL FROM r",
    "uri_normalize": "SELECT page_id, 's3a://' || regexp_replace(url, '^[a-z]+://', '') AS url FROM pages",
    "web_mercator": f"{BASE} SELECT Crash_ID, {CM.format(PX)} AS x_cm, {CM.format(PY)} AS y_cm FROM pts",
    "extent_buffered": f"{BASE} SELECT {extent_sql(PX, PY)} FROM pts",
    "cluster_layer": f"{CELLED} SELECT Crash_ID, {CM.format(PX)} AS x_cm, {CM.format(PY)} AS y_cm, cluster, "
                     "CAST((dense_rank() OVER (ORDER BY cluster) - 1) % 10 AS INT) AS slot FROM cl",
    "centroid_layer": f"{RATED} SELECT cluster, fatality_rate, (fatality_rate - lo) / nullif(hi - lo, 0) AS color_value, "
                      f"{CM.format(CX)} AS x_cm, {CM.format(CY)} AS y_cm, min_x_cm, max_x_cm, min_y_cm, max_y_cm FROM rated, "
                      f"(SELECT min(fatality_rate) AS lo, max(fatality_rate) AS hi, {extent_sql(CX, CY)} FROM rated)",
    "cluster_count_estimate": f"{BASE} SELECT count(*) AS crashes, greatest(count(*) // {PER_CLUSTER}, 1) AS clusters FROM pts",
    "nearest_centroid": f"{BASE}, {lloyd_sql(0)} SELECT Crash_ID, cid FROM p0 JOIN a0 USING (x, y)",
    "kmeans_parallel_seeds": f"{BASE}, {drawn_sql()} SELECT cid, x AS cx, y AS cy FROM s{seeding.REDUCE_ROUNDS}",
    "kmeans_lloyd": f"{CLUSTERED} SELECT Crash_ID, {CLUSTER} FROM kc",
    "hotspot_pipeline": f"{CLUSTERED}, rated AS (SELECT {CLUSTER}, {RATES_SQL} FROM kc GROUP BY {CLUSTER}) "
                        f"SELECT *, {RANKED.format(CLUSTER)}, NOT EXISTS (SELECT cid, cx, cy FROM c{MAX_ITER} EXCEPT "
                        f"SELECT cid, cx, cy FROM c{MAX_ITER - 1}) AS converged FROM rated",
    "urban_rural_hotspots": URBAN_RURAL,
    "gmm": f"""{MIXED} SELECT Crash_ID, gmm_cluster
FROM p0 JOIN (SELECT x, y, list_min(list_transform(list_filter(l, lambda e: e.d = top), lambda e: e.cid)) AS gmm_cluster FROM gp) USING (x, y)""",
    "gmm_shares": f"""{MIXED} SELECT Crash_ID, component, share_permille
FROM p0 JOIN (SELECT x, y, e.cid AS component, CAST(round(exp(e.d - top) / mass * 1000) AS BIGINT) AS share_permille
  FROM (SELECT *, unnest(l) AS e FROM gp)) USING (x, y) WHERE share_permille > 0""",
    "fatality_rate": f"{RATED} SELECT * FROM rated",
    "rank_clusters": f"{RATED} SELECT *, {RANKED.format('cluster')} FROM rated",
    "rank_clusters_min_n": f"{RATED} SELECT *, {RANKED.format('cluster')} FROM rated WHERE crashes >= {MIN_CRASHES}",
    "nth_cluster": f"{RATED}, r AS (SELECT *, {RANKED.format('cluster')} FROM rated) "
                   f"SELECT *, round_even(fatality_rate, 2) AS display_rate FROM r WHERE rank = {RANK}",
    "radius_neighbors": f"{NEAR} SELECT * FROM near",
    "normalize_rate": f"{NEAR} SELECT * FROM scaled",
    "normalize_rate_global": f"{RATED} SELECT cluster, fatality_rate, (fatality_rate - lo) / nullif(hi - lo, 0) AS color_value "
                             "FROM rated, (SELECT min(fatality_rate) AS lo, max(fatality_rate) AS hi FROM rated)",
    "color_hex": f"{RATED}, s AS (SELECT cluster, (fatality_rate - lo) / nullif(hi - lo, 0) AS v "
                 "FROM rated, (SELECT min(fatality_rate) AS lo, max(fatality_rate) AS hi FROM rated)) "
                 f"SELECT cluster, v AS color_value, {hex_sql('v')} AS color_hex FROM s",
    "categorical_slot": f"{CELLED} SELECT cluster, CAST((row_number() OVER (ORDER BY cluster) - 1) % 10 AS INT) AS slot "
                        "FROM (SELECT DISTINCT cluster FROM cl)",
    "marker_table": f"{NEAR} SELECT cluster, centroid_latitude, centroid_longitude, fatality_rate, distance, color_value, "
                    f"{hex_sql('color_value')} AS color_hex, 5 AS radius, 0.7::DOUBLE AS fill_opacity, 14 AS zoom FROM scaled",
    "marker_table_ranks": f"""{RATED}, r AS (SELECT *, {RANKED.format('cluster')} FROM rated),
near AS (SELECT f.rank, r.*, sqrt((r.centroid_latitude - f.centroid_latitude) * (r.centroid_latitude - f.centroid_latitude)
    + (r.centroid_longitude - f.centroid_longitude) * (r.centroid_longitude - f.centroid_longitude)) * 69.0::DOUBLE AS distance
  FROM (SELECT * FROM r WHERE rank <= {LAST_RANK}) f, (SELECT * EXCLUDE (rank) FROM r) r),
within AS (SELECT * FROM near WHERE distance <= {MILES}),
scaled AS (SELECT *, (fatality_rate - min(fatality_rate) OVER p) / nullif(max(fatality_rate) OVER p - min(fatality_rate) OVER p, 0) AS color_value
  FROM within WINDOW p AS (PARTITION BY rank))
SELECT rank, cluster, centroid_latitude, centroid_longitude, fatality_rate, distance, color_value, {hex_sql('color_value')} AS color_hex,
  5 AS radius, 0.7::DOUBLE AS fill_opacity, 14 AS zoom FROM scaled""",
    "eps_neighbor_counts": f"{BASE}, {pairs_sql()} SELECT p AS Crash_ID, neighbors FROM counts",
    "dbscan": f"{DBSCAN} SELECT Crash_ID, DBSCAN_cluster FROM dbs",
    "dbscan_summary": f"{DBSCAN} SELECT DBSCAN_cluster, count(*) AS crashes, CAST(sum(Death_Cnt) AS BIGINT) AS deaths FROM dbs GROUP BY DBSCAN_cluster",
    "density_split": f"{BASE}, k AS (SELECT Crash_ID, CAST(floor(lat_e6 / 1e5) AS BIGINT) AS cell_lat, CAST(floor(lon_e6 / 1e5) AS BIGINT) AS cell_lon FROM pts) "
                     f"SELECT *, CASE WHEN count(*) OVER (PARTITION BY cell_lat, cell_lon) >= {URBAN_CRASHES} THEN 'urban' ELSE 'rural' END AS area FROM k",
    "urban_areas": URBAN_AREAS,
    "region_counts_laid_out": f"{BASE} SELECT region, count(*) AS crashes FROM ({IN_BOXES}) GROUP BY region",
    "crash_csv_typed": f"""{BASE} SELECT Crash_ID, Latitude, CASE WHEN Crash_ID % 5 <> 0 THEN Crash_ID % 70 + CASE WHEN Crash_ID % 3 = 1 THEN 0.5 ELSE 0 END END::DOUBLE AS Speed,
  CASE WHEN Crash_ID % 3 <> 2 THEN Crash_ID % 90000 + 10000 END AS Zip, CASE WHEN Crash_ID % 7 <> 0 THEN printf('2021-%02d-09', Crash_ID % 12 + 1) END AS Seen,
  CASE WHEN Crash_ID % 3 = 2 THEN NULL WHEN Crash_ID % 2 = 0 THEN CAST(Crash_ID % 10 AS VARCHAR) ELSE '1/2/2020' END AS Note,
  '9' || lpad(CAST(Crash_ID % 1000 AS VARCHAR), 20, '0') AS Serial, CAST(NULL AS VARCHAR) AS Blank, 'double bigint date string string string' AS kinds FROM crash""",
    "csv_roundtrip": f"{RATED} SELECT * EXCLUDE (crashes) FROM rated",
    "crash_csv_roundtrip": f"{BASE} SELECT {COLUMNS} FROM crash",
    "crash_csv_mixed": f"{BASE} SELECT {COLUMNS} FROM crash",
    "multi_file_union": f"{RATED} SELECT cluster, centroid_latitude, centroid_longitude, CASE WHEN fatality_rate > 0 THEN fatality_rate END AS fatality_rate FROM rated",
    "region_export": f"{BASE} SELECT {COLUMNS}, region FROM ({IN_BOXES})",
    "year_export": f"{BASE} SELECT Crash_ID, strftime(strptime(Crash_Date, '%m/%d/%Y'), '%Y-%m-%d') AS Crash_Date, Death_Cnt, {YEAR} AS crash_year "
                   f"FROM crash WHERE Crash_Date LIKE '%/{YEAR}'",
}
