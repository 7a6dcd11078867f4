"""A cube of the dashboard's filters: the ids behind each combination as bitmaps, so that a click reads no article."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevier.operators.dashboard import PRODUCTS

#: Every subset of the filters that can be set; a category decides whether a row is finance.
SETS = [
    [*scope, *rest]
    for scope, rest in product((["category", "finance"], ["finance"], []), (["product", "favourite"], ["product"], ["favourite"], []))
]
NAMES = ("category", "finance", "product", "favourite")


def facet_cube(rows: DataFrame, id_col: str = "id", category: str = "category", product: str = "product_category", favourite: str = "favourite") -> DataFrame:
    """(category, finance, product, favourite, bucket, ids): null where a filter isn't set; ids is a bitmap of bucket's ids.

    Ids are non-negative numbers, counted once each; a bucket holds the bits of 32,768 of them, so that no row grows with the
    table and partial bitmaps meet in the shuffle instead of ids. Unknown and missing products are other; a missing category
    is one of its own, the empty text.
    """
    known = F.coalesce(F.when(F.col(product).isin(PRODUCTS), F.col(product)), F.lit("other"))
    cells = rows.select(
        F.coalesce(F.col(category), F.lit("")).alias("category"),
        F.col(category).eqNullSafe("finance").alias("finance"),
        known.alias("product"),
        F.coalesce(F.col(favourite), F.lit(False)).alias("favourite"),
        F.bitmap_bucket_number(F.col(id_col)).alias("bucket"),
        F.bitmap_bit_position(F.col(id_col)).alias("bit"),
    )
    sets = [[F.col("bucket"), *map(F.col, names)] for names in SETS]
    return cells.groupingSets(sets, F.col("bucket"), *map(F.col, NAMES)).agg(F.bitmap_construct_agg("bit").alias("ids"))


def keys_of(category: Column, with_finance: Column, product: Column, favourites: Column) -> dict[str, Column]:
    """What a state of the filters asks of each key; `all` sets none, and leaves finance out unless asked."""
    every = category == "all"
    return {
        "category": F.when(~every, category),
        "finance": F.when(~every, category == "finance").when(~with_finance, F.lit(False)),
        "product": F.when(product != "all", product),
        "favourite": F.when(favourites, F.lit(True)),
    }


def click(cube: DataFrame, category: str = "all", with_finance: bool = False, product: str = "all", favourites: bool = False) -> DataFrame:
    """The bitmaps (bucket, ids) of one state of the filters."""
    wanted = keys_of(*map(F.lit, (category, with_finance, product, favourites)))
    for name, key in wanted.items():
        cube = cube.where(F.col(name).eqNullSafe(key))
    return cube.select("bucket", "ids")


def counted(cube: DataFrame, states: DataFrame) -> DataFrame:
    """states (category, with_finance, product, favourites) with cnt, the number of ids of each."""
    columns = ("category", "with_finance", "product", "favourites")
    asked = states.withColumns({f"__{name}": key for name, key in keys_of(*map(F.col, columns)).items()})
    sums = cube.groupBy(*[F.col(name).alias(f"__own_{name}") for name in NAMES]).agg(F.sum(F.bitmap_count("ids")).alias("cnt"))
    on = [F.col(f"__{name}").eqNullSafe(F.col(f"__own_{name}")) for name in NAMES]
    return asked.join(sums, on, "left").select(*columns, F.coalesce("cnt", F.lit(0)).alias("cnt"))


def ids_in(bitmaps: DataFrame) -> DataFrame:
    """(id) of bitmaps (bucket, ids), whose lowest bit of the first byte comes first."""
    pairs = F.regexp_extract_all(F.hex("ids"), F.lit("(..)"))
    each = bitmaps.select("bucket", F.posexplode(pairs).alias("byte", "value")).where("value <> '00'")
    value = F.conv("value", 16, 10).cast("int")
    on = each.select("bucket", "byte", value.alias("value"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit")).where("getbit(value, bit) = 1")
    place = (F.col("bucket") - 1) * 32768 + F.col("byte") * 8 + F.col("bit") + 1
    return on.select(F.when(F.col("bucket") == 0, 0).otherwise(place).cast("long").alias("id"))
