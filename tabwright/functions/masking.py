"""Masks for sensitive text: same value, same mask, same length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.columns import key_sql, quoted, text_sql

# What makes a column sensitive by name or by content.
SENSITIVE_WORDS = [
    "姓名", "手机", "电话", "邮箱", "身份证", "银行卡", "订单号", "地址", "账号",
    "phone", "mobile", "email", "id_card", "bank_card", "address",
]
SENSITIVE_PATTERNS = {
    "phone": r"^1[3-9][0-9]{9}$",
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$",
    "id_card": r"^[1-9][0-9]{16}[0-9Xx]$",
    "bank_card": r"^[0-9]{16,19}$",
}


def looks_sensitive_sql(text: str) -> str:
    """True where a text matches one of the personal-data patterns."""
    return "(" + " OR ".join(f"{text} RLIKE {text_sql(p)}" for p in SENSITIVE_PATTERNS.values()) + ")"


def mask_sql(text: str) -> str:
    """Keep the first and last character; NULL and ``""`` stay as they are."""
    n = f"length({text})"
    return (
        f"CASE WHEN {n} <= 0 THEN {text} WHEN {n} = 1 THEN '*' "
        f"WHEN {n} = 2 THEN concat(left({text}, 1), '*') "
        f"ELSE concat(left({text}, 1), repeat('*', {n} - 2), right({text}, 1)) END"
    )


def mask(name: str) -> Column:
    """The mask of a text column."""
    return F.expr(mask_sql(quoted(name)))


def mask_columns(
    df: DataFrame, names: list[str], join_salt: str | None = None
) -> DataFrame:
    """Replace columns by their masks.

    With ``join_salt`` each masked column also gets ``<name>_token``, a salted
    SHA-256 of the original, for joins that must still work on masked data.
    """
    masked, tokens = {}, {}
    for name in names:
        text = f"CASE WHEN {quoted(name)} IS NOT NULL THEN {key_sql(df, name)} END"
        masked[name] = F.expr(mask_sql(text))
        if join_salt is not None:
            tokens[f"{name}_token"] = F.expr(f"sha2(concat({text_sql(join_salt)}, {text}), 256)")
    return df.withColumns({**tokens, **masked})
