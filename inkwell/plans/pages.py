"""Queries of page layout: boxes and pixels derived from order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.operators import geometry, pixels
from inkwell.plans.registry import query, table


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, i, x_min, y_min, x_max, y_max, text): an order is a page, its distinct lines are boxes; one shuffle, by page."""
    box = F.struct(
        (F.col("l_partkey") % 300).cast("int").alias("x_min"), ((F.col("l_suppkey") * 7 + F.col("l_linenumber") * 31) % 400).cast("int").alias("y_min"),
        F.col("l_quantity").cast("int").alias("w"), F.col("l_linenumber").alias("n"),
    )
    pages = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.sort_array(F.collect_set(box)).alias("lines"))
    rows = pages.select("page", F.posexplode("lines").alias("i", "b")).select("page", "i", "b.*")
    return rows.select("page", "i", "x_min", "y_min", (F.col("x_min") + F.col("w")).alias("x_max"), (F.col("y_min") + 8 + F.col("w") % 5).alias("y_max"), F.concat(F.lit("t"), F.col("n").cast("string")).alias("text"))


_SQL_BOXES = """
raw as (select distinct l_orderkey as page, (l_partkey % 300)::int as x_min, ((l_suppkey * 7 + l_linenumber * 31) % 400)::int as y_min, trunc(l_quantity)::int as w, l_linenumber as n from lineitem),
boxes as (select page, row_number() over (partition by page order by x_min, y_min, w, n) - 1 as i, x_min, y_min, x_min + w as x_max, y_min + 8 + w % 5 as y_max, 't' || n as text from raw)"""


def _sql_step(low: str, high: str, ratio: float) -> str:
    """The growth of one side of a range, rounded half-even before it is added."""
    return f"round_even((({high} - {low}) * {ratio}::double - ({high} - {low})) / 2, 0)::int"


def _sql_grown(ratio_x: float, ratio_y: float) -> str:
    x, y = _sql_step("x_min", "x_max", ratio_x), _sql_step("y_min", "y_max", ratio_y)
    return f"grown as (select page, i, x_min - {x} as x0, x_max + {x} as x1, y_min - {y} as y0, y_max + {y} as y1 from boxes)"


@query(f"""with {_SQL_BOXES}
select page, i, greatest(x_min - {_sql_step('x_min', 'x_max', 1.5)}, 0) as x0, least(x_max + {_sql_step('x_min', 'x_max', 1.5)}, 320) as x1,
 greatest(y_min - 3, 0) as y0, least(y_max + 3, 400) as y1, x_min - {_sql_step('x_min', 'x_max', 2.0)} as free_x0 from boxes""")
def bbox_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes grown within an image, and one end of them grown without one."""
    x = geometry.expanded(F.col("x_min"), F.col("x_max"), ratio=1.5, limit=F.lit(320))
    y = geometry.expanded(F.col("y_min"), F.col("y_max"), pixel=3, limit=F.lit(400))
    free = geometry.expanded(F.col("x_min"), F.col("x_max"), ratio=2)
    return _boxes(spark, sf_dir).select("page", "i", x[0].alias("x0"), x[1].alias("x1"), y[0].alias("y0"), y[1].alias("y1"), free[0].alias("free_x0"))


@query(f"""with {_SQL_BOXES}
select page, i, [[x_min, y_max], [x_min, y_min], [x_max, y_min], [x_max, y_max]]::varchar as poly, (x_max - x_min) / 100.0 as score, 1.3 as expand_ratio,
 greatest(x_min - {_sql_step('x_min', 'x_max', 1.3)}, 0) as x_min, greatest(y_min - {_sql_step('y_min', 'y_max', 1.3)}, 0) as y_min,
 least(x_max + {_sql_step('x_min', 'x_max', 1.3)}, 320) as x_max, least(y_max + {_sql_step('y_min', 'y_max', 1.3)}, 400) as y_max from boxes""")
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops of detections, with the polygon and score of each."""
    rows = _boxes(spark, sf_dir).select("page", "i", geometry.box_poly(*(F.col(c) for c in geometry.BOX)).alias("poly"), ((F.col("x_max") - F.col("x_min")) / 100).alias("score"), F.lit(320).alias("width"), F.lit(400).alias("height"))
    return geometry.crops(rows, 1.3).withColumn("poly", F.regexp_replace(F.to_json("poly"), ",(?=\\S)", ", ")).drop("width", "height")


@query(f"""with {_SQL_BOXES} select page, i, x_min + y_min as corner, [[x_min, y_max], [x_min, y_min], [x_max, y_min], [x_max, y_max]]::varchar as poly from boxes""")
def bbox_poly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box as a polygon; its corner is read back from the polygon."""
    poly = geometry.box_poly(*(F.col(c) for c in geometry.BOX))
    back = geometry.poly_box(poly)
    return _boxes(spark, sf_dir).select("page", "i", (back["x_min"] + back["y_min"]).alias("corner"), F.regexp_replace(F.to_json(poly), ",(?=\\S)", ", ").alias("poly"))


_SQL_PAIRS = "select a.page, a.i as a, b.i as b from grown a join grown b on a.page = b.page and a.i < b.i and a.x0 <= b.x1 and b.x0 <= a.x1 and a.y0 <= b.y1 and b.y0 <= a.y1"


@query(f"with {_SQL_BOXES}, {_sql_grown(1.0, 2.0)} {_SQL_PAIRS}")
def bbox_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.overlapping(_boxes(spark, sf_dir), "page", "i", 1.0, 2.0)


_SQL_COMPONENTS = f"""
{_SQL_BOXES}, {_sql_grown(1.0, 2.0)}, pairs as ({_SQL_PAIRS}),
linked as (select page, a, b from pairs union all select page, b, a from pairs),
reach(page, i, j) as (select page, i, i from boxes union select r.page, r.i, b.b from reach r join linked b on b.page = r.page and b.a = r.j),
comp as (select page, i, min(j) as component from reach group by page, i)"""


@query(f"with recursive {_SQL_COMPONENTS} select page, i, component from comp")
def bbox_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.components(_boxes(spark, sf_dir), "page", "i", 1.0, 2.0)


@query(f"""with recursive {_SQL_COMPONENTS},
m as (select page, component, (y_min + y_max) / 2 as y, (x_min + x_max) / 2 as x, i, text, [[x_min, y_max], [x_min, y_min], [x_max, y_min], [x_max, y_max]]::varchar as poly from boxes join comp using (page, i)),
g as (select page, component, min((y, x, i)) as first, string_agg(text, chr(10) order by y, x, i) as contents, first(poly order by y, x, i) as box, count(*) as counts from m group by all)
select page, row_number() over (partition by page order by first) - 1 as group_no, box, contents, counts from g""")
def group_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised texts of overlapping boxes as groups in reading order, with the box of each group's first member."""
    groups = geometry.reading_groups(_boxes(spark, sf_dir), "page", "i", "text")
    return groups.withColumn("box", F.regexp_replace(F.to_json("box"), ",(?=\\S)", ", "))


@query(f"""with {_SQL_BOXES} select page, i, row_number() over (partition by page order by (y_min + y_max) / 2, (x_min + x_max) / 2, i) - 1 as place from boxes""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("page").orderBy((F.col("y_min") + F.col("y_max")) / 2, (F.col("x_min") + F.col("x_max")) / 2, "i")
    return _boxes(spark, sf_dir).select("page", "i", (F.row_number().over(order) - 1).alias("place"))


@query()
def rect_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy clusters of box corners in order of their means; the order of points decides, which SQL can't say."""
    points = _boxes(spark, sf_dir).select("page", "i", F.col("x_min").alias("x"), F.col("y_min").alias("y"))
    return geometry.greedy_clusters(points, "page", "i", 60, 60, 2)


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("page"), F.col("l_orderkey").alias("x"), F.col("l_linenumber").alias("y"), F.col("l_partkey").alias("p"),
        (F.col("l_partkey") % 256).cast("int").alias("r"), ((F.col("l_partkey") + F.col("l_linenumber") * 3) % 256).cast("int").alias("g"), ((F.col("l_partkey") + F.col("l_orderkey") % 25) % 256).cast("int").alias("b"),
    )
    return rows


_SQL_PIXELS = "px as (select l_suppkey as page, l_orderkey as x, l_linenumber as y, l_partkey as p, (l_partkey % 256)::int as r, ((l_partkey + l_linenumber * 3) % 256)::int as g, ((l_partkey + l_orderkey % 25) % 256)::int as b from lineitem)"
_KEY = ["page", "x", "y", "p"]


def _sql_enhanced(chosen: str, boost: int, scale: float) -> str:
    clip = lambda v: f"trunc(least(greatest({v}, 0.0), 255.0))::int"
    return ", ".join(f"case when {chosen} then {clip(f'{c} + {boost}')} else {clip(f'{c} * {scale}::double')} end as {c}2" for c in "rgb")


@query(f"with {_SQL_PIXELS} select page, x, y, p, {_sql_enhanced('least(r, g, b) >= 200 and greatest(r, g, b) - least(r, g, b) <= 20', 30, 0.3)}, count(*) as n from px group by all")
def pixel_enhance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = pixels.enhanced(F.col("r"), F.col("g"), F.col("b"), "white", 200, 30, 0.3, 20)
    return _pixels(spark, sf_dir).select(*_KEY, c[0].alias("r2"), c[1].alias("g2"), c[2].alias("b2")).groupBy(*_KEY, "r2", "g2", "b2").agg(F.count("*").alias("n"))


@query(f"with {_SQL_PIXELS} select page, x, y, p, 255 - r as r2, 255 - g as g2, 255 - b as b2, count(*) as n from px group by all")
def pixel_invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = pixels.inverted(F.col("r"), F.col("g"), F.col("b"))
    return _pixels(spark, sf_dir).select(*_KEY, c[0].alias("r2"), c[1].alias("g2"), c[2].alias("b2")).groupBy(*_KEY, "r2", "g2", "b2").agg(F.count("*").alias("n"))


@query(f"""with {_SQL_PIXELS} select page, count(*) filter (where greatest(r, g, b) <= 80) as dark, count(*) filter (where least(r, g, b) >= 200) as light,
 count(*) filter (where greatest(r, g, b) - least(r, g, b) <= 20) as gray, count(*) as n from px group by page""")
def pixel_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return _pixels(spark, sf_dir).groupBy("page").agg(
        F.count(F.when(pixels.mask(r, g, b, "black", 80), 1)).alias("dark"), F.count(F.when(pixels.mask(r, g, b, "white", 200), 1)).alias("light"),
        F.count(F.when(pixels.near_gray(r, g, b, 20), 1)).alias("gray"), F.count("*").alias("n"),
    )


@query(f"with {_SQL_PIXELS} select page, round(avg((r + g + b) / 3), 6) as mean, case when round(avg((r + g + b) / 3), 6) >= 128 then 'white' else 'black' end as background from px group by page")
def background_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.background(_pixels(spark, sf_dir), "page")


_SQL_VARIANTS = """
v1 as (select *, case when least(r, g, b) >= 80 and greatest(r, g, b) - least(r, g, b) <= 20 then 1 else 0 end as gray, case when greatest(r, g, b) - least(r, g, b) <= 20 then 1 else 0 end as flat from px),
u as (select *, case when gray = 1 then r else 0 end as r1, case when gray = 1 then g else 0 end as g1, case when gray = 1 then b else 0 end as b1 from v1)"""


def _sql_variant(c: str) -> str:
    grown = f"case when least(r1, g1, b1) >= 200 then least({c}1 + 30, 255) else trunc({c}1 * 0.3::double)::int end"
    return f"""255 - {grown} as gray_{c}, 255 - case when least(r, g, b) >= 200 then {c} else 0 end as white_{c},
 case when flat = 1 or least(r, g, b) = 255 then 255 else 0 end as hand_{c}, case when greatest(r, g, b) >= 200 then 255 else {c} end as print_{c}"""


@query(f"with {_SQL_PIXELS}, {_SQL_VARIANTS} select page, x, y, p, {', '.join(map(_sql_variant, 'rgb'))}, count(*) as n from u group by all")
def pixel_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four variants of a page's pixels that recognition is given."""
    rows, names = _pixels(spark, sf_dir), dict(zip(pixels.VARIANTS, ("gray", "white", "hand", "print")))
    made = [c.alias(f"{names[v]}_{channel}") for v, variant in pixels.VARIANTS.items() for channel, c in zip("rgb", variant(F.col("r"), F.col("g"), F.col("b")))]
    wide = rows.select(*_KEY, *made)
    return wide.groupBy(*wide.columns).agg(F.count("*").alias("n"))


@query(f"with {_SQL_PIXELS} select page, x, y, p, case when r <= 90 and b <= 90 then 1 else r end as r2, case when r <= 90 and b <= 90 then 2 else g end as g2, case when r <= 90 and b <= 90 then 3 else b end as b2, count(*) as n from px group by all")
def pixel_mask_and_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels dark in two chosen channels set to one colour."""
    c = pixels.masked(F.col("r"), F.col("g"), F.col("b"), "black", 90, (1, 2, 3), "RB")
    return _pixels(spark, sf_dir).select(*_KEY, c[0].alias("r2"), c[1].alias("g2"), c[2].alias("b2")).groupBy(*_KEY, "r2", "g2", "b2").agg(F.count("*").alias("n"))
