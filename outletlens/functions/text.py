"""Display and text helpers as column expressions (no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Short month names of the Indonesian locale, January..December.
MONTHS_ID = ["Jan", "Feb", "Mar", "Apr", "Mei", "Jun", "Jul", "Agu", "Sep", "Okt", "Nov", "Des"]
CURRENCY_PREFIX = "Rp "
DEFAULT_CATEGORY = "Lainnya"
PHOTO_BUCKET = "product-photos"
UNPRICED_LABEL = "harga dikonfirmasi"
MESSAGE_HOST = "https://wa.me/"
# Whitespace removed by a JavaScript trim beyond Java's (?U)\s.
_JS_SPACE = r"[\s\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def js_trim(x) -> Column:
    """Trim all Unicode whitespace at both ends (Spark's trim strips spaces only, T7)."""
    return F.regexp_replace(_c(x), rf"(?U)^{_JS_SPACE}+|{_JS_SPACE}+$", "")


def clean_keyword(x) -> Column:
    return F.lower(js_trim(x))


def blank_to(x, default) -> Column:
    """``x`` unless NULL or empty, else ``default`` (column or literal)."""
    d = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(_c(x), F.lit("")), d)


def store_display_name(store_name="store_name", name="name") -> Column:
    return F.coalesce(F.nullif(_c(store_name), F.lit("")), _c(name))


def category_or_default(x="category_name") -> Column:
    return blank_to(x, DEFAULT_CATEGORY)


def format_currency(amount) -> Column:
    """'Rp ' + half-up rounded integer with '.' thousands groups; NULL/NaN -> 0."""
    x = F.coalesce(_c(amount).cast("double"), F.lit(0.0))
    x = F.when(F.isnan(x), F.lit(0.0)).otherwise(x)
    rounded = F.floor(x + F.lit(0.5))
    return F.concat(F.lit(CURRENCY_PREFIX), F.translate(F.format_number(rounded, 0), ",", "."))


def short_date(d) -> Column:
    """``d MMM yyyy`` with Indonesian month names; NULL -> ''."""
    dt = _c(d).cast("date")
    months = F.array(*[F.lit(m) for m in MONTHS_ID])
    text = F.concat_ws(" ", F.dayofmonth(dt).cast("string"), F.element_at(months, F.month(dt)),
                       F.year(dt).cast("string"))
    return F.when(dt.isNull(), F.lit("")).otherwise(text)


def normalize_phone(raw) -> Column:
    return F.regexp_replace(F.coalesce(_c(raw).cast("string"), F.lit("")), r"[^0-9]", "")


def encode_uri_component(x) -> Column:
    """Percent-encode like JavaScript's encodeURIComponent.

    Java's URLEncoder writes '+' for a space and encodes ``! ~ ' ( )``; every
    literal '+' is already ``%2B``, so the fix-ups below are exact.
    """
    e = F.url_encode(_c(x))
    for enc, dec in (("+", "%20"), ("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        e = F.replace(e, F.lit(enc), F.lit(dec))
    return e


def message_url(phone, text) -> Column:
    return F.concat(F.lit(MESSAGE_HOST), normalize_phone(phone), F.lit("?text="), encode_uri_component(text))


def photo_url(path, base_url) -> Column:
    """Public object URL, or NULL for a NULL/empty path or a missing base URL."""
    base = F.lit(base_url) if isinstance(base_url, str) else base_url
    ok = F.nullif(_c(path), F.lit("")).isNotNull() & F.nullif(base, F.lit("")).isNotNull()
    return F.when(ok, F.concat(base, F.lit("/storage/v1/object/public/"), F.lit(PHOTO_BUCKET),
                               F.lit("/"), _c(path)))


def initial(name="name") -> Column:
    """First character, upper-cased, of the trimmed name; '?' when NULL or ''."""
    n = js_trim(F.coalesce(F.nullif(_c(name), F.lit("")), F.lit("?")))
    return F.upper(F.substring(n, 1, 1))
