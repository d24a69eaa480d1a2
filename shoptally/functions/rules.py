"""Scalar business rules: stock signs, cart discounts and quantities, category order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shoptally import constants as K


def signed_quantity(kind: Column, quantity: Column, unknown: str = "out") -> Column:
    """Quantity with the sign of its ledger type; an unknown type counts as out or as 0."""
    inbound = F.when(kind.isin(*K.INBOUND_TYPES), quantity)
    if unknown == "out":
        return inbound.otherwise(-quantity)
    return inbound.when(kind.isin(*K.OUTBOUND_TYPES), -quantity).otherwise(F.lit(0))


def discount_amount(text: Column, price: Column, quantity: Column) -> Column:
    """Amount meant by a discount entry: ``10%``, a bare 1..100 (also percent) or an amount.

    The percent share is cut to whole money per unit. An entry that exceeds the row is void.
    """
    squeezed = F.replace(text, F.lit(" "), F.lit(""))
    bare = text.rlike("^[0-9]+$")
    percent = F.when(
        squeezed.rlike("^[0-9]+%[^%]*$"), F.regexp_extract(squeezed, "^([0-9]+)%", 1)
    ).when(bare & text.try_cast("bigint").between(1, 100), text)
    per_unit = F.floor(percent.try_cast("double") / F.lit(100.0) * price.cast("double"))
    amount = F.coalesce(
        per_unit.cast("bigint") * quantity,
        F.when(bare, text.try_cast("bigint")),
        F.lit(0).cast("bigint"),
    )
    return F.when(quantity * price - amount < 0, F.lit(0).cast("bigint")).otherwise(amount)


def sellable_quantity(quantity: Column, stock: Column, serial: Column) -> Column:
    """A serial sells one piece; other rows no more than the stock."""
    return F.when(serial.isNotNull(), F.lit(1)).otherwise(F.least(quantity, stock))


def category_rank(name: Column) -> Column:
    """Rank of a category in pick lists; ties are listed by name."""
    upper = F.upper(name)
    rank = F.when(name.isNull() | (name == ""), K.OTHER_RANK)
    for prefix, place in K.CATEGORY_RANKS:
        rank = rank.when(upper.startswith(prefix), place)
    return rank.when(upper.rlike(r"^\p{L}"), K.LETTER_RANK).otherwise(K.OTHER_RANK)


def valid_email(email: Column) -> Column:
    return email.rlike("(?i)" + K.EMAIL_PATTERN)


def customer_problem(phone: Column, name: Column, email: Column) -> Column:
    """First rule a new customer breaks, NULL when the entry is fine."""
    cleaned = F.trim(name)
    return (
        F.when(~F.coalesce(phone.rlike("^[0-9]{10}$"), F.lit(False)), "phone")
        .when(F.coalesce(F.length(cleaned) < 2, F.lit(True)) | cleaned.rlike("[0-9]"), "name")
        .when((F.trim(email) != "") & ~valid_email(F.trim(email)), "email")
    )
