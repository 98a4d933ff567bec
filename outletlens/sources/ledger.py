"""The sales ledger as typed DataFrames.

A ``Ledger`` bundles the tables every operator reads: outlets (``customers``),
``invoices``, ``invoice_items``, ``products``, ``categories``, ``app_settings``
and the cart change log.  Two loaders exist:

* ``Ledger.from_driver(spark, sf_dir)`` derives the tables from the driver's
  star schema by the fixed column rules of FIXTURES.md section 3.  Every rule is
  a built-in column expression, so the scans keep column pruning and filter
  pushdown, and nothing runs in Python.
* ``Ledger.from_tables(spark, root)`` reads tables already in the ledger schema
  (``<root>/<table>``, parquet).  Columns added later by the schema's additive
  evolution are filled with typed NULLs when absent.

All frames are lazy; no operator materialises a table unless it says so.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Ledger schemas (column name -> Spark type).  Order is the output order.
# ---------------------------------------------------------------------------
CUSTOMERS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("store_name", T.StringType()),
    T.StructField("catalog_token", T.StringType()),
    T.StructField("catalog_token_created_at", T.TimestampType()),
])
INVOICES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("customer_id", T.LongType()),
    T.StructField("invoice_date", T.DateType()),
    T.StructField("status", T.StringType()),
    T.StructField("verification_status", T.StringType()),
])
INVOICE_ITEMS = T.StructType([
    T.StructField("invoice_id", T.LongType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("quantity", T.DoubleType()),
])
PRODUCTS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("sku", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("unit", T.StringType()),
    T.StructField("category_id", T.StringType()),
    T.StructField("is_active", T.BooleanType()),
    T.StructField("stock_quantity", T.DoubleType()),
    T.StructField("photo_thumb_path", T.StringType()),
    T.StructField("photo_large_path", T.StringType()),
])
CATEGORIES = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
])
APP_SETTINGS = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("updated_at", T.TimestampType()),
])
CART_EVENTS = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("outlet_id", T.LongType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("qty", T.LongType()),
    T.StructField("unit", T.StringType()),
])
GRANTS = T.StructType([
    T.StructField("grantee", T.StringType()),
    T.StructField("table_schema", T.StringType()),
    T.StructField("table_name", T.StringType()),
    T.StructField("privilege_type", T.StringType()),
])

SCHEMAS: dict[str, T.StructType] = {
    "customers": CUSTOMERS,
    "invoices": INVOICES,
    "invoice_items": INVOICE_ITEMS,
    "products": PRODUCTS,
    "categories": CATEGORIES,
    "app_settings": APP_SETTINGS,
    "cart_events": CART_EVENTS,
    "grants": GRANTS,
}

# The settings rows the driver mapping uses (FIXTURES.md section 3
# says "literals"; these are our own neutral values).
SETTINGS_ROWS = [
    ("catalog_distributor_name", "NORTHWIND SUPPLY"),
    ("catalog_whatsapp_number", "+62 812-3456-789"),
    ("catalog_base_url", "https://catalog.example.com"),
]


#: Columns that name a row of some table.  Numbers in the driver mapping; a ledger of
#: its own may have text (uuid) instead, which is kept.
ID_COLUMNS = {"customers": ["id"], "invoices": ["id", "customer_id"], "invoice_items": ["invoice_id", "product_id"],
              "products": ["id"], "cart_events": ["outlet_id", "product_id"]}


def with_text_ids(name: str, schema: T.StructType) -> T.StructType:
    """The table's schema with text ids."""
    ids = ID_COLUMNS.get(name, [])
    return T.StructType([T.StructField(f.name, T.StringType()) if f.name in ids else f for f in schema.fields])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns in order, casting, and NULL-fill missing ones.  Text ids stay text."""
    present, ids = set(df.columns), {c for columns in ID_COLUMNS.values() for c in columns}
    cols = []
    for f in schema.fields:
        if f.name in present:
            text_id = f.name in ids and isinstance(df.schema[f.name].dataType, T.StringType)
            cols.append(F.col(f.name) if text_id else F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def settings_frame(spark: SparkSession, rows=SETTINGS_ROWS) -> DataFrame:
    df = spark.createDataFrame(rows, "key string, value string")
    return df.withColumn("updated_at", F.lit(None).cast("timestamp"))


# ---------------------------------------------------------------------------
# Driver-table mapping (FIXTURES.md section 3).  CASE branches in written order.
# Stated as SQL expressions: each table's projection is parsed once on the JVM
# side instead of being assembled from hundreds of client-side column calls.
# ---------------------------------------------------------------------------
CUSTOMER_RULES = [
    "cast(c_custkey AS bigint) AS id",
    "c_name AS name",
    "CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN NULL"
    " ELSE concat('Toko ', cast(c_custkey AS string)) END AS store_name",
    "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE md5(cast(c_custkey AS string)) END AS catalog_token",
    "cast(NULL AS timestamp) AS catalog_token_created_at",
]
INVOICE_RULES = [
    "cast(o_orderkey AS bigint) AS id",
    "cast(o_custkey AS bigint) AS customer_id",
    "cast(o_orderdate AS date) AS invoice_date",
    "CASE WHEN o_orderstatus = 'P' THEN 'cancelled' WHEN o_orderstatus = 'F' THEN 'paid'"
    " ELSE 'unpaid' END AS status",
    "CASE WHEN o_orderpriority = '1-URGENT' THEN 'rejected' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL"
    " ELSE 'approved' END AS verification_status",
]
INVOICE_ITEM_RULES = [
    "cast(l_orderkey AS bigint) AS invoice_id",
    "CASE WHEN l_linenumber = 7 AND l_partkey % 10 = 0 THEN NULL ELSE cast(l_partkey AS bigint) END AS product_id",
    "cast(l_quantity AS bigint) AS quantity",
]
PRODUCT_RULES = [
    "cast(p_partkey AS bigint) AS id",
    "p_name AS name",
    "concat('SKU-', lpad(cast(p_partkey AS string), 6, '0')) AS sku",
    "CASE WHEN p_partkey % 23 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN cast(0.0 AS double)"
    " ELSE cast(p_retailprice AS double) END AS price",
    "CASE WHEN p_partkey % 6 = 0 THEN 'lusin' WHEN p_partkey % 6 = 1 THEN 'box' WHEN p_partkey % 6 = 2 THEN ''"
    " WHEN p_partkey % 6 = 3 THEN NULL ELSE 'pcs' END AS unit",
    "CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_type END AS category_id",
    "CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE p_partkey % 13 <> 0 END AS is_active",
    "CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE cast(p_size - 3 AS bigint) END AS stock_quantity",
    "CASE WHEN p_partkey % 3 = 0 THEN concat(cast(p_partkey AS string), '/1780000000-thumb.webp') END"
    " AS photo_thumb_path",
    "CASE WHEN p_partkey % 3 = 0 THEN concat(cast(p_partkey AS string), '/1780000000-large.webp') END"
    " AS photo_large_path",
]
CATEGORY_RULES = ["id", "concat('Cat ', id) AS name"]
CART_EVENT_RULES = [
    "cast(event_id AS bigint) AS seq",
    "cast(ts AS timestamp) AS ts",
    "cast(user_id AS bigint) AS outlet_id",
    "cast(get_json_object(props, '$.k') AS bigint) AS product_id",
    "CASE WHEN event_type = 'error' THEN cast(0 AS bigint) ELSE cast(floor(value) AS bigint) % 13 END AS qty",
    "CASE WHEN event_type = 'click' THEN 'lusin' ELSE 'base' END AS unit",
]
# Derived link-open log: each event opens its user's link; ``view`` adds a
# trailing slash, ``error`` a bad suffix, ``signup`` a token cut to 12
# characters (too short to resolve); others open the plain link.
LINK_OPEN_RULES = [
    "cast(event_id AS bigint) AS open_id",
    "CASE WHEN event_type = 'view' THEN concat('/t/', md5(cast(user_id AS string)), '/')"
    " WHEN event_type = 'error' THEN concat('/t/', md5(cast(user_id AS string)), '/x')"
    " WHEN event_type = 'signup' THEN concat('/t/', substr(md5(cast(user_id AS string)), 1, 12))"
    " ELSE concat('/t/', md5(cast(user_id AS string))) END AS path",
    "CASE WHEN event_type = 'error' THEN NULL"
    " WHEN event_type = 'signup' THEN substr(md5(cast(user_id AS string)), 1, 12)"
    " ELSE md5(cast(user_id AS string)) END AS token",
]


def map_customers(customer: DataFrame) -> DataFrame:
    return customer.selectExpr(*CUSTOMER_RULES)


def map_invoices(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(*INVOICE_RULES)


def map_invoice_items(lineitem: DataFrame) -> DataFrame:
    return lineitem.selectExpr(*INVOICE_ITEM_RULES)


def map_categories(part: DataFrame) -> DataFrame:
    return part.selectExpr("p_type AS id").distinct().selectExpr(*CATEGORY_RULES)


def map_products(part: DataFrame) -> DataFrame:
    return part.selectExpr(*PRODUCT_RULES)


def map_cart_events(events: DataFrame) -> DataFrame:
    return events.selectExpr(*CART_EVENT_RULES)


def map_link_opens(events: DataFrame) -> DataFrame:
    return events.selectExpr(*LINK_OPEN_RULES)


# Column types of the driver tables (TESTDATA.md), declared so a
# read needs no schema-inference job and prunes to the columns used.
DRIVER_SCHEMAS = {
    "customer": "c_custkey bigint, c_name string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz,"
              " o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double",
    "part": "p_partkey bigint, p_name string, p_type string, p_size int, p_retailprice double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


# The driver tables whose rows a ledger table counts (categories: no more than products).
DRIVER_FILES = {"customers": "customer", "products": "part", "categories": "part", "invoice_items": "lineitem"}


def read_driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = DRIVER_SCHEMAS.get(name)
    return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)


def _files_state(spark: SparkSession, path: str) -> tuple:
    """Time of a table's folder (or file), number and bytes of its files.

    A rewrite makes the folder anew, so its time tells one of equal size too
    (on stores that keep times of folders).
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    summary = fs.getContentSummary(at)
    return fs.getFileStatus(at).getModificationTime(), summary.getFileCount(), summary.getLength()


class Ledger:
    """Lazily loaded ledger tables: a table is read on first use only."""

    def __init__(self, spark: SparkSession, loaders: dict, source: str = "", paths: dict | None = None):
        self.spark = spark
        self.source = source
        self._loaders = dict(loaders)
        self._frames: dict[str, DataFrame] = {}
        # Where tables are read straight from files: their size-check counts are
        # shared within the session (see ``row_count``).
        self._paths = dict(paths or {})

    def __getattr__(self, name: str) -> DataFrame:
        loaders = self.__dict__.get("_loaders", {})
        if name not in loaders:
            raise AttributeError(name)
        frames = self.__dict__["_frames"]
        if name not in frames:
            frames[name] = loaders[name]()
        return frames[name]

    @classmethod
    def from_driver(cls, spark: SparkSession, sf_dir: str) -> "Ledger":
        def read(name: str) -> DataFrame:
            return read_driver_table(spark, sf_dir, name)

        return cls(spark, {
            "customers": lambda: map_customers(read("customer")),
            "invoices": lambda: map_invoices(read("orders")),
            "invoice_items": lambda: map_invoice_items(read("lineitem")),
            "products": lambda: map_products(read("part")),
            "categories": lambda: map_categories(read("part")),
            "app_settings": lambda: settings_frame(spark),
            "cart_events": lambda: map_cart_events(read("events")),
            "grants": lambda: spark.createDataFrame([], GRANTS),
        }, source=f"driver:{sf_dir}", paths={t: f"{sf_dir.rstrip('/')}/{f}.parquet" for t, f in DRIVER_FILES.items()})

    @classmethod
    def from_tables(cls, spark: SparkSession, root: str, fmt: str = "parquet",
                    json_arrays: bool = False, text_ids: bool = False) -> "Ledger":
        """Read ledger-schema tables from ``<root>/<name>``; enforce schemas.

        ``fmt`` is ``parquet`` or ``orc`` (self-describing: filters and column
        pruning reach the scan) or ``json``.  JSON is read with the declared
        schema in FAILFAST mode, so a malformed row stops the job instead of
        becoming NULLs; fields absent from older rows read as NULL; prices,
        quantities and stock may be given as text, and ids are text (uuid)
        with ``text_ids``.  The other formats keep text ids as they are.  With
        ``json_arrays`` each file holds one JSON array of rows (a saved
        response of the reference's row calls) instead of one row per line.
        """
        if fmt not in ("parquet", "orc", "json"):
            raise ValueError(f"unsupported ledger format: {fmt}")

        def read(name: str, path: str, schema: T.StructType) -> DataFrame:
            if fmt == "json":
                # Numbers may be given as text: cast after the read.
                numbers = [f.name for f in schema.fields if isinstance(f.dataType, T.DoubleType)]
                loose = T.StructType([T.StructField(f.name, T.StringType()) if f.name in numbers else f
                                      for f in (with_text_ids(name, schema) if text_ids else schema).fields])
                r = spark.read.schema(loose).option("mode", "FAILFAST")
                return r.option("multiLine", json_arrays).json(path)
            return spark.read.format(fmt).load(path)

        def loader(name: str, schema: T.StructType):
            def load() -> DataFrame:
                path = f"{root.rstrip('/')}/{name}"
                try:
                    df = read(name, path, schema)
                except AnalysisException as e:
                    # An absent optional table is empty; any other failure is one.
                    if name not in ("grants", "cart_events", "app_settings") or e.getCondition() != "PATH_NOT_FOUND":
                        raise
                    df = spark.createDataFrame([], schema)
                return conform(df, schema)
            return load

        return cls(spark, {n: loader(n, sc) for n, sc in SCHEMAS.items()}, source=f"{fmt}:{root}",
                   paths={n: f"{root.rstrip('/')}/{n}" for n in SCHEMAS})

    @classmethod
    def from_frames(cls, spark: SparkSession, **frames: DataFrame) -> "Ledger":
        """Build from in-memory frames (tests); missing tables are empty."""
        def loader(name: str, schema: T.StructType):
            df = frames.get(name)
            return (lambda: conform(df, schema)) if df is not None else (
                lambda: spark.createDataFrame([], schema))

        return cls(spark, {n: loader(n, sc) for n, sc in SCHEMAS.items()}, source="frames")

    def row_count(self, name: str) -> int:
        """Rows of one ledger table for size checks, counted once.

        Ledgers read straight from files (``from_driver``/``from_tables``)
        share the count within a session as long as the files stay as they are
        (see ``_files_state``).  Ledgers made by ``replace`` or from frames count
        their own.
        """
        counts = self.__dict__.setdefault("_counts", {})
        if name not in counts:
            known, key = {}, None
            if name in self._paths:
                known = self.spark.__dict__.setdefault("_outletlens_counts", {})
                key = (self.source, name, _files_state(self.spark, self._paths[name]))
            counts[name] = known[key] if key in known else getattr(self, name).count()
            known[key] = counts[name]
        return counts[name]

    @property
    def product_count(self) -> int:
        """The bound of every product-sized size check (rank tables, one
        outlet's history, product-dimension joins)."""
        return self.row_count("products")

    @property
    def customer_count(self) -> int:
        """The bound of outlet-sized size checks (the token table)."""
        return self.row_count("customers")

    @property
    def category_count(self) -> int:
        """The bound of the category table in the products' category join."""
        return self.row_count("categories")

    @property
    def item_count(self) -> int:
        """The item rows, which bound what a task of the items' join holds."""
        return self.row_count("invoice_items")

    def replace(self, **frames: DataFrame) -> "Ledger":
        loaders = dict(self._loaders)
        for name, df in frames.items():
            loaders[name] = (lambda d=df: d)
        return Ledger(self.spark, loaders, source=self.source)

