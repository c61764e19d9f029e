"""Channel statistics, realism rules, transfer, heat-map words, patches and cascades."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as I
from catalog.registry import query
from evenhand.functions import arrays as A
from evenhand.functions import labels as L
from evenhand.operators import ranking, realism
from evenhand.session import new_work_path
from evenhand.sources import image_files, images

ARRAYS = I.ARRAYS_SQL


@query("channel_statistics", ARRAYS + """
SELECT item_id, avg(v) AS mean, stddev_pop(v) AS std, median(v) AS median FROM cells GROUP BY item_id""", doubles="mean std median")
def channel_statistics(spark, sf_dir):
    """Mean, population spread and median of one channel per item."""
    rows = I.arrays_8x8(spark, sf_dir)
    c = F.col("cells")
    return rows.select("item_id", A.mean(c).alias("mean"), A.std_pop(c).alias("std"), A.median(c).alias("median"))


@query("class_colour_profile", ARRAYS + f""",
s AS (SELECT item_id, label, avg(v) AS m, stddev_pop(v) AS s FROM cells GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {I.h('item_id')}, item_id) AS rn FROM s)
SELECT label, count(*) AS n, avg(m) AS mean, avg(s) AS std FROM r WHERE rn <= 30 GROUP BY label""", ints="n", doubles="mean std")
def class_colour_profile(spark, sf_dir):
    """Average of per-item means and per-item spreads over a sample per class."""
    sample = ranking.sample_per_group(I.arrays_8x8(spark, sf_dir), ["label"], "item_id", 30)
    c = F.col("cells")
    stats = sample.select("label", A.mean(c).alias("m"), A.std_pop(c).alias("s"))
    return stats.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("m").alias("mean"), F.avg("s").alias("std"))


# Pseudo channels of the arrays: hue, saturation, value, a and b, as linear maps of a cell.
CHANNELS = {"hue": (25.0, 60.0), "sat": (150.0, 200.0), "val": (60.0, 400.0), "a": (128.0, 300.0), "b": (110.0, 250.0)}
BORDER, CENTRE = A.border_positions(8, 8, 1), A.centre_positions(8, 8, 1)
RULES_SQL = " ".join(
    "WHEN " + " AND ".join(
        ([f"{f} > {lo}"] if lo is not None else []) + ([f"{f} < {hi}"] if hi is not None else [])) + f" THEN '{name}'"
    for name, f, lo, hi in realism.REALISM_RULES)


def _feature_sql() -> str:
    def over(channel, part):
        shift, scale = CHANNELS[channel]
        return f"({shift} + {scale} * v) ) FILTER (WHERE i IN {tuple(BORDER if part == 'border' else CENTRE)})"

    names = {"median": "median", "mean": "avg", "std": "stddev_pop"}
    wanted = dict.fromkeys(f for _, f, _, _ in realism.REALISM_RULES)
    parts = []
    for feature in wanted:
        part, channel, stat = feature.split("_")
        parts.append(f"{names[stat]}({over(channel, 'border' if part == 'border' else 'center')} AS {feature}")
    return ", ".join(parts)


def _channel(cells, shift, scale):
    return F.transform(cells, lambda v: F.lit(shift) + F.lit(scale) * v)


def _features(rows):
    wanted = dict.fromkeys(f for _, f, _, _ in realism.REALISM_RULES)
    how = {"median": A.median, "mean": A.mean, "std": A.std_pop}
    columns = {}
    for feature in wanted:
        part, channel, stat = feature.split("_")
        shift, scale = CHANNELS[channel]
        cells = A.region(F.col("cells"), BORDER if part == "border" else CENTRE)
        columns[feature] = how[stat](_channel(cells, shift, scale))
    return rows.withColumns(columns)


@query("realism_features", ARRAYS + f"""
SELECT item_id, {_feature_sql().replace('border_val_mean', 'val').replace('border_a_std', 'a_std').replace('center_hue_median', 'hue')}
FROM cells GROUP BY item_id""".replace("SELECT item_id, ", "SELECT item_id, val, a_std, hue FROM (SELECT item_id, ", 1) + ")",
       doubles="val a_std hue")
def realism_features(spark, sf_dir):
    """Border and centre statistics of the channels."""
    return _features(I.arrays_8x8(spark, sf_dir)).select(
        "item_id", F.col("border_val_mean").alias("val"), F.col("border_a_std").alias("a_std"),
        F.col("center_hue_median").alias("hue"))


@query("realism_gate", ARRAYS + f""",
f AS (SELECT item_id, {_feature_sql()} FROM cells GROUP BY item_id)
SELECT item_id, CASE {RULES_SQL} ELSE 'ok' END AS reason FROM f""")
def realism_gate(spark, sf_dir):
    """Thirteen rules in order, the first that fires names the reason."""
    reason = realism.realism_reason()
    return _features(I.arrays_8x8(spark, sf_dir)).select("item_id", F.substring_index(reason, "=", 1).alias("reason"))


@query("channel_transfer", ARRAYS + """,
s AS (SELECT item_id, label, avg(v) AS m, stddev_pop(v) AS s FROM cells GROUP BY ALL),
t AS (SELECT label, avg(m) AS m, avg(s) AS s FROM s GROUP BY label),
x AS (SELECT c.item_id, i, least(greatest((v - s.m) * (t.s / greatest(s.s, 1e-6)) + t.m, -0.2), 0.2) AS v
      FROM cells c JOIN s USING (item_id) JOIN t ON t.label = 'c' || ((CAST(substr(c.label, 2) AS INT) + 1) % 10))
SELECT item_id, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS low, max(v) AS high, max(v) FILTER (WHERE i = 17) AS cell17
FROM x GROUP BY item_id""", doubles="mean std low high cell17")
def channel_transfer(spark, sf_dir):
    """Each item moved to the colour profile of the next class."""
    rows = I.arrays_8x8(spark, sf_dir)
    c = F.col("cells")
    stats = rows.withColumns({"sm": A.mean(c), "ss": A.std_pop(c)})
    profile = stats.groupBy("label").agg(F.avg("sm").alias("tm"), F.avg("ss").alias("ts"))
    following = F.concat(F.lit("c"), ((F.substring("label", 2, 2).cast("int") + 1) % 10).cast("string"))
    joined = stats.withColumn("to", following).join(profile.withColumnRenamed("label", "to"), "to")
    moved = joined.withColumn("x", A.transfer_channel(c, *[F.col(k) for k in ("sm", "ss", "tm", "ts")], -0.2, 0.2))
    x = F.col("x")
    return moved.select("item_id", A.mean(x).alias("mean"), A.std_pop(x).alias("std"), F.array_min(x).alias("low"),
                        F.array_max(x).alias("high"), F.get(x, F.lit(17)).alias("cell17"))


@query("multi_reference_transfer", ARRAYS + f""",
s AS (SELECT item_id, label, avg(v) AS m, stddev_pop(v) AS s FROM cells GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {I.h('item_id')}, item_id) AS rn FROM s),
t AS (SELECT label, avg(m) AS m, avg(s) AS s FROM r WHERE rn <= 5 GROUP BY label),
x AS (SELECT c.item_id, least(greatest((v - s.m) * (t.s / CASE WHEN s.s < 1e-6 THEN 1.0 ELSE s.s END) + t.m, -1.0), 1.0) AS v
      FROM cells c JOIN s USING (item_id) JOIN t ON t.label = c.label)
SELECT item_id, avg(v) AS mean, stddev_pop(v) AS std FROM x GROUP BY item_id""", doubles="mean std")
def multi_reference_transfer(spark, sf_dir):
    """Transfer to the averaged statistics of five sampled references."""
    rows = I.arrays_8x8(spark, sf_dir)
    c = F.col("cells")
    refs = ranking.sample_per_group(rows, ["label"], "item_id", 5).select(
        "label", A.mean(c).alias("m"), A.std_pop(c).alias("s"))
    target = refs.groupBy("label").agg(F.avg("m").alias("tm"), F.avg("s").alias("ts"))
    joined = rows.withColumns({"sm": A.mean(c), "ss": A.std_pop(c)}).join(target, "label")
    x = A.transfer_channel(c, *[F.col(k) for k in ("sm", "ss", "tm", "ts")], -1.0, 1.0, guard="one")
    return joined.withColumn("x", x).select("item_id", A.mean(F.col("x")).alias("mean"), A.std_pop(F.col("x")).alias("std"))


HEAT_SQL = ARRAYS + """,
heat AS (SELECT item_id, i, greatest(v, 0) / max(greatest(v, 0)) OVER (PARTITION BY item_id) AS v FROM cells)"""


def _heat(spark, sf_dir):
    positive = F.transform("cells", lambda v: F.greatest(v, F.lit(0.0)))
    rows = I.arrays_8x8(spark, sf_dir).withColumn("_p", positive)
    return rows.select("item_id", A.bind(F.array_max("_p"), lambda m: F.transform("_p", lambda v: v / m)).alias("heat"))


@query("heatmap_region", HEAT_SQL + """,
c AS (SELECT item_id, avg(i // 8) FILTER (WHERE v >= 0.5) / 8 AS cy, avg(i % 8) FILTER (WHERE v >= 0.5) / 8 AS cx FROM heat GROUP BY item_id),
w AS (SELECT item_id, cy, CASE WHEN cy < 0.33 THEN 'upper' WHEN cy > 0.66 THEN 'lower' ELSE 'center' END AS vert,
             CASE WHEN cx < 0.33 THEN 'left' WHEN cx > 0.66 THEN 'right' ELSE 'center' END AS horz FROM c)
SELECT item_id, CASE WHEN cy IS NULL THEN 'diffuse' WHEN vert = 'center' THEN horz WHEN horz = 'center' THEN vert
       ELSE vert || '-' || horz END AS region FROM w""")
def heatmap_region(spark, sf_dir):
    """Word for the centroid of the hot cells."""
    return _heat(spark, sf_dir).select("item_id", A.focus_region(F.col("heat"), 8, 8).alias("region"))


@query("heatmap_intensity", HEAT_SQL + """,
m AS (SELECT item_id, coalesce(avg(v) FILTER (WHERE v > 0.3), 0) AS m FROM heat GROUP BY item_id)
SELECT item_id, CASE WHEN m > 0.7 THEN 'strong' WHEN m > 0.4 THEN 'moderate' ELSE 'weak' END AS intensity FROM m""")
def heatmap_intensity(spark, sf_dir):
    return _heat(spark, sf_dir).select("item_id", A.intensity_word(F.col("heat")).alias("intensity"))


ITA_SQL = I.ARRAYS_SQL + """,
pix AS (SELECT a.item_id, a.i, degrees(atan2((50 + 100 * a.v) - 50, 100 * b.v)) AS ita, a.v > 0.05 AS m
        FROM cells a JOIN cells b ON a.item_id = b.item_id AND b.i = a.i + 32),
masked AS (SELECT item_id, count(*) FILTER (WHERE m) AS pixels, count(*) AS total,
   CASE WHEN count(*) FILTER (WHERE m) >= 10 THEN median(ita) FILTER (WHERE m) END AS ita,
   CASE WHEN count(*) FILTER (WHERE m) >= 10 THEN stddev_pop(ita) FILTER (WHERE m) END AS ita_std,
   median(ita) AS whole FROM pix GROUP BY item_id)"""


def _masked(spark, sf_dir):
    """Angles of the first 32 cells against the last 32, masked by brightness."""
    rows = I.arrays_8x8(spark, sf_dir)
    light, b = F.slice("cells", 1, 32), F.slice("cells", 33, 32)
    rows = rows.withColumns({
        "angles": F.zip_with(light, b, lambda l, y: L.ita_angle(50 + 100 * l, 100 * y)),
        "mask": F.transform(light, lambda v: v > 0.05)})
    rows = rows.withColumn("inside", A.where_mask(F.col("angles"), F.col("mask")))
    enough = F.size("inside") >= 10
    return rows.withColumns({
        "pixels": F.size("inside"), "ita": F.when(enough, A.median(F.col("inside"))),
        "ita_std": F.when(enough, A.std_pop(F.col("inside"))), "whole": A.median(F.col("angles"))})


@query("masked_typology_angle", ITA_SQL + " SELECT item_id, pixels, ita, ita_std FROM masked", ints="pixels", doubles="ita ita_std")
def masked_typology_angle(spark, sf_dir):
    """Median and spread of the angle under a mask, NULL under ten cells."""
    return _masked(spark, sf_dir).select("item_id", "pixels", "ita", "ita_std")


@query("method_cascade", ITA_SQL + """
SELECT item_id, CASE WHEN pixels >= 12 THEN 'ring' WHEN ita IS NOT NULL THEN 'patch' ELSE 'full' END AS method,
       CASE WHEN pixels >= 12 THEN ita WHEN ita IS NOT NULL THEN ita ELSE whole END AS value FROM masked""", doubles="value")
def method_cascade(spark, sf_dir):
    """First method with enough cells and a value, else the fallback."""
    chosen = realism.cascade([
        ("ring", realism.ring_is_large(F.col("pixels"), 12), F.col("ita")),
        ("patch", F.lit(True), F.col("ita"))], ("full", F.col("whole")))
    return _masked(spark, sf_dir).select("item_id", chosen.alias("c")).select("item_id", "c.method", "c.value")


@query("mask_validity", ARRAYS + """,
m AS (SELECT item_id, count(*) FILTER (WHERE v > 0.15)::DOUBLE / 64 AS share, count(*) FILTER (WHERE v > 0.1) AS ring FROM cells GROUP BY item_id)
SELECT item_id, share, share BETWEEN 0.02 AND 0.1 AS valid, ring >= 12 AS large FROM m""", doubles="share")
def mask_validity(spark, sf_dir):
    """Lesion share inside its bounds, ring large enough."""
    rows = I.arrays_8x8(spark, sf_dir).select(
        "item_id", A.share(F.transform("cells", lambda v: v > 0.15)).alias("share"),
        F.size(F.filter("cells", lambda v: v > 0.1)).alias("ring"))
    return rows.select("item_id", "share", realism.mask_is_valid(F.col("share"), 0.02, 0.1).alias("valid"),
                       realism.ring_is_large(F.col("ring"), 12).alias("large"))


@query("dark_border_flag", ARRAYS + """
SELECT item_id, count(*) FILTER (WHERE v <= -0.2)::DOUBLE / 64 AS dark, count(*) FILTER (WHERE v <= -0.2)::DOUBLE / 64 >= 0.06 AS flagged
FROM cells GROUP BY item_id""", doubles="dark")
def dark_border_flag(spark, sf_dir):
    """Share of dark cells and the flag."""
    from evenhand.sources.images import vignette_flag

    rows = I.arrays_8x8(spark, sf_dir).select("item_id", A.share(F.transform("cells", lambda v: v <= -0.2)).alias("dark"))
    return rows.select("item_id", "dark", vignette_flag(F.col("dark"), 0.06).alias("flagged"))


_cross = "abs(a.i // 8 - b.i // 8) + abs(a.i % 8 - b.i % 8) <= 1"
_touch = "abs(a.i // 8 - b.i // 8) <= 1 AND abs(a.i % 8 - b.i % 8) <= 1 AND a.i <> b.i"
_spread = lambda source, how: (
    f"SELECT item_id, crossed.i, {how}(valid) AS valid FROM {source} JOIN crossed ON crossed.j = {source}.i GROUP BY item_id, crossed.i")


def _border_sql(bright: str, items: str = "true") -> str:
    """Border share and flag of masks of the cells that are ``bright``, cell by cell."""
    return ARRAYS.replace("WITH", "WITH RECURSIVE", 1) + f""",
places AS (SELECT unnest(range(64)) AS i),
crossed AS (SELECT a.i, b.i AS j FROM places a JOIN places b ON {_cross}),
touching AS (SELECT a.i, b.i AS j FROM places a JOIN places b ON {_touch}),
bright AS (SELECT item_id, i, {bright} AS valid FROM cells),
shrunk AS ({_spread("bright", "bool_and")}),
open_ AS ({_spread("shrunk", "bool_or")}),
grown AS ({_spread("open_", "bool_or")}),
close_ AS ({_spread("grown", "bool_and")}),
kept AS (SELECT item_id, i FROM close_ WHERE valid),
reach(item_id, i, j) AS (
  SELECT item_id, i, i FROM kept
  UNION SELECT r.item_id, r.i, t.j FROM reach r JOIN touching t ON t.i = r.j JOIN kept k ON k.item_id = r.item_id AND k.i = t.j),
parts AS (SELECT item_id, root, count(*) AS size FROM (SELECT item_id, i, min(j) AS root FROM reach GROUP BY ALL) GROUP BY ALL),
shares AS (SELECT item_id, 1 - coalesce(max(size), 0) / 64.0::DOUBLE AS border_fraction FROM arrays LEFT JOIN parts USING (item_id) WHERE {items} GROUP BY item_id)
SELECT item_id, border_fraction, border_fraction >= 0.3 AS has_border FROM shares"""


@query("cleaned_border_flag", _border_sql("v > -0.1"), doubles="border_fraction")
def cleaned_border_flag(spark, sf_dir):
    """Border share of masks after opening, closing and the cut to the largest component."""
    rows = I.arrays_8x8(spark, sf_dir)
    return image_files.array_border(rows, "item_id", F.transform("cells", lambda v: v > -0.1), 8, 8, 0.3, 3)


GREY_SQL = ARRAYS + """,
grey AS (SELECT item_id, i, greatest(0, least(255, round(128 + 400 * v))) AS g FROM cells WHERE item_id % 97 <> 5),
lab AS (SELECT *, CASE WHEN g / 255 > 0.04045 THEN pow((g / 255 + 0.055) / 1.055, 2.4) ELSE g / 255 / 12.92 END AS y FROM grey),
pixels AS (
  SELECT *, greatest(0, least(255, round(2.55 * CASE WHEN y > 0.008856 THEN 116 * cbrt(y) - 16 ELSE 903.3 * y END))) AS light,
         i // 8 < 2 OR i // 8 >= 6 OR i % 8 < 2 OR i % 8 >= 6 AS ring
  FROM lab)
SELECT item_id, count(*) FILTER (WHERE g <= 18)::DOUBLE / 64 AS dark_fraction, avg(light) AS L_mean, stddev_pop(light) AS L_std,
       avg(g) FILTER (WHERE ring) AS border_val_mean, 0.0 AS center_sat_mean FROM pixels GROUP BY item_id"""


def _grey_images(spark, sf_dir):
    """Folder of one grey PNG per array; the arrays of some items are spoiled, so that their files cannot be decoded."""
    grey = F.transform("cells", lambda v: 128 + 400 * v)
    pixels = F.when(F.col("item_id") % 97 != 5, F.flatten(F.transform(grey, lambda g: F.array(g, g, g))))
    rows = I.arrays_8x8(spark, sf_dir).select("item_id", pixels.alias("pixels"))
    folder = new_work_path(spark, "images")
    image_files.write_files(image_files.encoded_images(rows, "item_id", 8, 8, "pixels"), folder)
    return folder


@query("image_roundtrip_features", GREY_SQL, doubles="dark_fraction L_mean L_std border_val_mean center_sat_mean")
def image_roundtrip_features(spark, sf_dir):
    """Features of images that are written as files, read by the image source and decoded; broken files are skipped."""
    features = images.image_features(images.read_images(spark, _grey_images(spark, sf_dir)))
    item = F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long")
    return features.select(item.alias("item_id"), "dark_fraction", "L_mean", "L_std", "border_val_mean", "center_sat_mean")


@query("image_border_mask", _border_sql("round(128 + 400 * v) > 18", "item_id % 97 <> 5"), doubles="border_fraction")
def image_border_mask(spark, sf_dir):
    """The clean-up of the border mask on image files that were written and decoded."""
    found = image_files.border_mask(images.read_images(spark, _grey_images(spark, sf_dir)), min_fraction=0.3, size=3)
    return found.select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("item_id"), "border_fraction", "has_border")


_linear = lambda c: f"CASE WHEN {c} / 255 > 0.04045 THEN pow(({c} / 255 + 0.055) / 1.055, 2.4) ELSE {c} / 255 / 12.92 END"
_root = lambda t: f"CASE WHEN {t} > 0.008856 THEN cbrt({t}) ELSE 7.787 * ({t}) + 16.0::DOUBLE / 116.0 END"
_level = lambda shift: f"greatest(0, least(255, round(128 + 300 * v + {shift})))"
COLOUR_SQL = ARRAYS + f""",
bgr AS (SELECT item_id, {_level(-30)} AS b, {_level(0)} AS g, {_level(40)} AS r FROM cells),
linear AS (SELECT *, {_linear('b')} AS lb, {_linear('g')} AS lg, {_linear('r')} AS lr FROM bgr),
xyz AS (SELECT *, 0.212671 * lr + 0.715160 * lg + 0.072169 * lb AS y,
               (0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.088754 AS z FROM linear),
lab AS (SELECT *, CASE WHEN y > 0.008856 THEN 116.0 * ({_root('y')}) - 16.0 ELSE 903.3 * y END AS l,
               200.0 * (({_root('y')}) - ({_root('z')})) + 128.0 AS blue FROM xyz),
angles AS (SELECT item_id, degrees(atan2(greatest(0, least(255, round_even(l * 2.55, 0))) / 2.55 - 50.0,
                                         greatest(0, least(255, round_even(blue, 0))) - 128.0)) AS angle,
                  round_even(0.114 * b + 0.587 * g + 0.299 * r, 0) > 18 AS skin FROM lab)
SELECT item_id, median(angle) FILTER (WHERE skin) AS ita, stddev_pop(angle) FILTER (WHERE skin) AS ita_std,
       count(*) FILTER (WHERE NOT skin) / 64.0::DOUBLE AS dark_fraction FROM angles GROUP BY item_id"""


@query("image_typology_angle", COLOUR_SQL, doubles="ita ita_std dark_fraction")
def image_typology_angle(spark, sf_dir):
    """Typology angle of the brighter pixels of colour images that were written as BMP files and decoded."""
    pixels = F.flatten(F.transform("cells", lambda v: F.array(98 + 300 * v, 128 + 300 * v, 168 + 300 * v)))
    rows = I.arrays_8x8(spark, sf_dir).select("item_id", pixels.alias("pixels"))
    folder = new_work_path(spark, "images")
    image_files.write_files(image_files.encoded_images(rows, "item_id", 8, 8, "pixels", "bmp"), folder)
    features = images.image_features(images.read_images(spark, folder))
    item = F.regexp_extract("path", r"(\d+)\.bmp$", 1).cast("long")
    return features.select(item.alias("item_id"), "ita", "ita_std", "dark_fraction")


@query("unreadable_images", """
SELECT count(*) FILTER (WHERE vec_id % 97 <> 5) AS readable, count(*) FILTER (WHERE vec_id % 97 = 5) AS broken FROM embeddings
""", ints="readable broken")
def unreadable_images(spark, sf_dir):
    """Files that the image source cannot decode, kept as a one-pixel placeholder."""
    rows = images.read_images(spark, _grey_images(spark, sf_dir), on_error="placeholder")
    return rows.agg(F.count_if(F.col("height") > 1).alias("readable"), F.count_if(F.col("height") == 1).alias("broken"))


_angles = ", ".join(
    f"({o}, {a})" for o, a in enumerate(range(0, 360, 45)))
PATCH_SQL = I.ARRAYS_SQL + f""",
mask AS (SELECT item_id, i // 8 AS y, i % 8 AS x FROM cells WHERE v > -0.08),
ids AS (SELECT item_id FROM arrays),
edge0(o, y, x) AS (VALUES (0, 1, 1), (1, 1, 3), (2, 1, 5), (3, 3, 1), (4, 3, 5), (5, 5, 1), (6, 5, 3), (7, 5, 5)),
edges AS (SELECT item_id, 'edge' AS kind, o, y, x FROM ids CROSS JOIN edge0),
centre AS (SELECT item_id, trunc(avg(y)) AS cy, trunc(avg(x)) AS cx FROM mask GROUP BY item_id),
angles(o, a) AS (VALUES {_angles}),
circle AS (SELECT item_id, 'circle' AS kind, o,
   greatest(0, least(trunc(cy + 2 * sin(radians(a)))::INT - 1, 6)) AS y,
   greatest(0, least(trunc(cx + 2 * cos(radians(a)))::INT - 1, 6)) AS x FROM centre CROSS JOIN angles),
spots AS (SELECT * FROM edges UNION ALL SELECT * FROM circle),
good AS (SELECT s.item_id, kind, o, s.y, s.x FROM spots s JOIN mask m ON m.item_id = s.item_id AND m.y BETWEEN s.y AND s.y + 1
         AND m.x BETWEEN s.x AND s.x + 1 GROUP BY ALL HAVING count(*) >= 0.95 * 4),
per AS (SELECT ids.item_id, (SELECT string_agg(y || ':' || x, ',' ORDER BY o) FROM good g WHERE g.item_id = ids.item_id AND kind = 'edge') AS e,
   (SELECT string_agg(y || ':' || x, ',' ORDER BY o) FROM good g WHERE g.item_id = ids.item_id AND kind = 'circle') AS c FROM ids)"""


@query("patch_positions", PATCH_SQL + """
SELECT item_id, coalesce(e, c, (SELECT string_agg(y || ':' || x, ',' ORDER BY o) FROM edge0)) AS spots FROM per""")
def patch_positions(spark, sf_dir):
    """Valid edge patches, else valid circle patches, else all edge patches."""
    rows = I.arrays_8x8(spark, sf_dir).select("item_id", F.transform("cells", lambda v: v > -0.08).alias("mask"))
    spots = realism.patch_positions(F.col("mask"), F.lit(8), F.lit(8), patch=2, margin=1)
    text = F.array_join(F.transform(spots, lambda s: F.concat_ws(":", s["y"].cast("string"), s["x"].cast("string"))), ",")
    return rows.select("item_id", text.alias("spots"))


@query("patch_consensus", """
WITH b AS (SELECT user_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY user_id),
f AS (SELECT e.user_id, value, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM events e JOIN b USING (user_id))
SELECT user_id, count(*) AS n, count(*) FILTER (WHERE ok) AS kept, quantile_cont(value, 0.5) FILTER (WHERE ok) AS median,
       stddev_pop(value) FILTER (WHERE ok) AS std FROM f GROUP BY user_id""", ints="n kept", doubles="median std")
def patch_consensus(spark, sf_dir):
    """Median and spread of the values inside the interquartile fence, groups of any size."""
    return realism.robust_consensus(I.table(spark, sf_dir, "events"), ["user_id"], "value")


@query("patch_consensus_of_arrays", ARRAYS + """,
b AS (SELECT item_id, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM cells WHERE i < 9 GROUP BY item_id),
f AS (SELECT c.item_id, v, v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM cells c JOIN b USING (item_id) WHERE i < 9)
SELECT item_id, count(*) AS n, count(*) FILTER (WHERE ok) AS kept, quantile_cont(v, 0.5) FILTER (WHERE ok) AS median,
       stddev_pop(v) FILTER (WHERE ok) AS std FROM f GROUP BY item_id""", ints="n kept", doubles="median std")
def patch_consensus_of_arrays(spark, sf_dir):
    """The same for nine values of one item that are at hand as an array: no shuffle."""
    rows = I.arrays_8x8(spark, sf_dir).select("item_id", realism.array_consensus(F.slice("cells", 1, 9)).alias("c"))
    return rows.select("item_id", "c.*")
