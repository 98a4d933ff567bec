"""Saved responses of the row calls, as a table.

A row call answers in pages: ``<root>/<function>/<page file>`` holds one saved
body each, and the files' names put the pages in order.  The rules are those of
the client that fetches them: a body that is no JSON array gives no rows; an
error body, or one that is no JSON, stops the job and names the function; pages
follow each other until the first that is short of ``chunk`` rows.  (A file of no
bytes holds no body, so it is no page.)

Files are read by Spark (any file system it knows), a page as one value in one
task, and parsed with built-in functions.  Numbers may be given as text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.catalog import DEFAULT_PAGE, DRAIN_GUARD_ROWS

_PRODUCT = ("product_id string, name string, sku string, price double, unit string, category_name string,"
            " photo_thumb_path string, photo_large_path string")
#: The row calls and their result columns.
CALLS = {
    "catalog_get_outlet": "store_name string, distributor_name string, whatsapp_number string",
    "catalog_get_history": f"{_PRODUCT}, order_count bigint, total_qty bigint, last_ordered date",
    "catalog_get_suggestions": f"{_PRODUCT}, outlet_count bigint",
    "catalog_get_products": _PRODUCT,
}
#: A saved error body: an object with these two.
ERROR_FIELDS = ("message", "code")


def read_pages(spark: SparkSession, root: str, function: str, schema: str | None = None, chunk: int = DEFAULT_PAGE,
               guard: bool = False) -> DataFrame:
    """The rows of all pages saved for ``function``, with ``page`` (file name) and ``pos`` (1-based in the page).

    ``guard`` is the client's stop once more than 50 000 rows are held.
    """
    columns = T.StructType.fromDDL(schema or CALLS[function])
    body = F.trim(F.col("value"), F.lit(" \t\r\n"))
    json = F.try_parse_json(body)
    error = F.lit(False)
    for field in ERROR_FIELDS:
        error = error | F.try_variant_get(json, f"$.{field}", "string").isNull()
    stop = (F.when(json.isNull(), F.concat(F.lit(f"{function}: no JSON in "), F.col("page"), F.lit(": "), F.left(body, F.lit(200))))
            .when(~body.startswith("[") & ~error, F.concat(F.lit(f"{function} failed in "), F.col("page"), F.lit(": "), F.left(body, F.lit(1000)))))
    # Every field is read as text and cast, so a number may be given as text.
    loose = T.ArrayType(T.StructType([T.StructField(f.name, T.StringType()) for f in columns.fields]))
    rows = F.when(body.startswith("["), F.from_json(body, loose.simpleString(), {"mode": "FAILFAST"}))
    pages = spark.read.text(f"{root.rstrip('/')}/{function}", wholetext=True).select("value", F.col("_metadata.file_name").alias("page"))
    pages = pages.select("page", F.when(stop.isNotNull(), F.raise_error(stop).cast(loose)).otherwise(rows).alias("rows"))
    each = pages.select("page", F.posexplode("rows").alias("at", "row")).select(
        "page", (F.col("at") + 1).cast("bigint").alias("pos"), *[F.col(f"row.{f.name}").cast(f.dataType).alias(f.name) for f in columns.fields])

    # One row a page: which page is the last that would be asked for.
    sizes = pages.select("page", F.coalesce(F.size("rows"), F.lit(0)).alias("n"))
    last = sizes.filter(F.col("n") < chunk).agg(F.min("page")).scalar()
    each = each.filter(last.isNull() | (F.col("page") <= last))
    if guard:
        most = DRAIN_GUARD_ROWS // chunk + 1
        held = sizes.orderBy("page").limit(most).agg(F.max("page")).scalar()
        each = each.filter(F.col("page") <= held)
    return each
