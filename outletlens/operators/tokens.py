"""Access-token jobs.

Token writes produce a *new* snapshot of ``customers``; the path being read is
never overwritten.  ``uuid()`` is non-deterministic, so issued tokens are
written once and read back before anyone uses them.  No snapshot whose tokens
are not unique becomes visible (C25 as the constraint it is in the reference).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import store_display_name
from ..sources.ledger import CUSTOMERS, Ledger, conform
from ..sources.sinks import write_snapshot
from ..sources.versions import AuditFailed, Versions

LINK_PREFIX = "/t/"
LINK_LIST_SIZE = 20
# Tokens that a refused write names.
NAMED_CONFLICTS = 5


def new_token() -> Column:
    """32 lower-case hex characters from a random UUID."""
    return F.replace(F.expr("uuid()"), F.lit("-"), F.lit(""))


def with_issued_tokens(customers: DataFrame) -> DataFrame:
    """C23 (plan): fill only NULL tokens; keep existing ones (idempotent)."""
    missing = F.col("catalog_token").isNull()
    return customers.select(
        *[c for c in customers.columns if c not in ("catalog_token", "catalog_token_created_at")],
        F.when(missing, new_token()).otherwise(F.col("catalog_token")).alias("catalog_token"),
        F.when(missing, F.current_timestamp()).otherwise(F.col("catalog_token_created_at"))
        .alias("catalog_token_created_at"),
        missing.alias("token_issued"),
    )


def issue_tokens(ledger: Ledger, out_path: str) -> tuple[DataFrame, int]:
    """Write the new customers snapshot to ``out_path``; return it and the count issued."""
    back = write_snapshot(with_issued_tokens(ledger.customers), out_path, audit=unique_tokens)
    issued = back.filter(F.col("token_issued")).count()
    return conform(back, CUSTOMERS), issued


def with_rotated_tokens(customers: DataFrame, outlet_ids: DataFrame) -> DataFrame:
    """C24 (plan): a new token for each given outlet, others unchanged.

    Adds ``token_rotated`` and keeps the previous token as ``previous_token``.
    """
    ids = outlet_ids.select(F.col("outlet_id").cast(customers.schema["id"].dataType).alias("_rid")).dropDuplicates()
    c = customers.join(ids, F.col("id") == F.col("_rid"), "left")
    hit = F.col("_rid").isNotNull()
    return c.select(
        *[F.col(x) for x in customers.columns if x not in ("catalog_token", "catalog_token_created_at")],
        F.when(hit, new_token()).otherwise(F.col("catalog_token")).alias("catalog_token"),
        F.when(hit, F.current_timestamp()).otherwise(F.col("catalog_token_created_at"))
        .alias("catalog_token_created_at"),
        hit.alias("token_rotated"),
        F.col("catalog_token").alias("previous_token"),
    )


def rotate_tokens(ledger: Ledger, outlet_ids: DataFrame, out_path: str) -> DataFrame:
    """New tokens for the given outlets; their old tokens stop resolving.

    The snapshot is written to ``out_path`` (never the path being read) and
    read back; returns (outlet_id, catalog_token) of the rotated outlets.
    """
    back = write_snapshot(with_rotated_tokens(ledger.customers, outlet_ids).drop("previous_token"), out_path,
                          audit=unique_tokens)
    return back.filter(F.col("token_rotated")).select(F.col("id").alias("outlet_id"), "catalog_token")


def token_uniqueness_check(customers: DataFrame) -> DataFrame:
    """Non-NULL tokens held by more than one outlet (must be empty)."""
    return (customers.filter(F.col("catalog_token").isNotNull()).groupBy("catalog_token")
            .agg(F.count(F.lit(1)).alias("holders")).filter(F.col("holders") > 1))


class TokenConflict(AuditFailed):
    """Some token would be held by more than one outlet."""


def unique_tokens(customers: DataFrame) -> None:
    """C25 as a constraint: raise ``TokenConflict`` unless every non-NULL token has one holder."""
    bad = token_uniqueness_check(customers).orderBy("catalog_token").limit(NAMED_CONFLICTS + 1).collect()
    if bad:
        named = ", ".join(f"{r.catalog_token} ({r.holders} outlets)" for r in bad[:NAMED_CONFLICTS])
        raise TokenConflict(f"catalog_token is not unique: {named}{', ...' if len(bad) > NAMED_CONFLICTS else ''}")


def publish_customers(versions: Versions, customers: DataFrame, number: int | None = None) -> DataFrame:
    """Publish a whole ``customers`` snapshot if its tokens, old and new, are unique.

    Otherwise ``TokenConflict`` names the tokens, and what was visible stays so.
    """
    if number is None:
        latest = versions.latest()
        number = 0 if latest is None else latest + 1
    return versions.publish(customers, number, unique_tokens)


def token_coverage(customers: DataFrame) -> DataFrame:
    """Total outlets, with a token, without one."""
    return customers.agg(
        F.count(F.lit(1)).alias("total_outlets"),
        F.count("catalog_token").alias("with_token"),
        F.count_if(F.col("catalog_token").isNull()).alias("without_token"),
    )


def link_list(ledger: Ledger, limit: int = LINK_LIST_SIZE) -> DataFrame:
    """Display name and link of outlets with a token, by name, first ``limit``."""
    base = ledger.app_settings.filter(F.col("key") == "catalog_base_url").select(F.max("value")).scalar()
    c = ledger.customers.filter(F.col("catalog_token").isNotNull())
    out = c.select(F.col("id").alias("outlet_id"), store_display_name().alias("store_name"),
                   F.concat(F.coalesce(base, F.lit("")), F.lit(LINK_PREFIX), F.col("catalog_token")).alias("link"))
    return out.orderBy(F.col("store_name").asc_nulls_last(), F.col("outlet_id")).limit(limit)
