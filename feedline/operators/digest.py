"""The digest of a run.

The digest is a top-N report: ``orderBy(...).limit(N)`` plans as
TakeOrderedAndProject (each task keeps N rows), so only N rows ever reach
one place; the text is ``listagg`` over those N rows.  The order is total:
the run that saved a row, its place in that run, its fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Headers are parameters; the defaults are neutral.
POSTING_HEADER = "*Nuevas ofertas:*\n"
LEAD_HEADER = "*Empresas para contacto (extracción semanal):*\n"
# Digest line formats and labels.
HR_LABEL = "✅ RH confirmado"
GENERAL_LABEL = "⚠️ contacto general"
OVERFLOW_FMT = "_...y %d más guardadas en DB_"


def digest_order(df: DataFrame) -> list[str]:
    """The columns of ``df`` that order a digest: oldest run first."""
    return [c for c in ("run_id", "seq", "fingerprint") if c in df.columns]


def digest_slice(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows in digest order."""
    return df.orderBy(*digest_order(df)).limit(n)


def posting_line() -> Column:
    """P27: '• *title* @ company\\n  [source] url\\n'."""
    return F.format_string("• *%s* @ %s\n  [%s] %s\n", "title", "company", "source", "url")


def lead_line() -> Column:
    """P27: '• *name* (label)\\n  email — website\\n'."""
    label = F.when(F.col("email_is_hr_context"), F.lit(HR_LABEL)).otherwise(F.lit(GENERAL_LABEL))
    return F.format_string("• *%s* (%s)\n  %s — %s\n", F.col("name"), label, F.col("email"),
                           F.col("website"))


def overflow_count(total: Column, n: int) -> Column:
    """Rows beyond the digest size."""
    return F.greatest(total - F.lit(n), F.lit(0))


def digest_text(df: DataFrame, n: int, line: Column, header: str, total: int | None = None) -> DataFrame:
    """One row (n_items, n_total, overflow, text); no row when ``df`` is empty.

    ``total``: the number of rows where ``df`` holds only the digest's slice of them.

    text = header + '\\n' + item lines (ordered, '\\n'-joined) + overflow line.
    """
    # Else the total is a scalar subquery (one partial count per task), not a join.
    total = df.select(F.count(F.lit(1))).scalar() if total is None else F.lit(total).cast("bigint")
    top = digest_slice(df, n).select(F.struct(*digest_order(df)).alias("__o"), line.alias("__line"))
    j = top.agg(
        F.count(F.lit(1)).alias("n_items"),
        F.expr("listagg(__line, '\\n') WITHIN GROUP (ORDER BY __o)").alias("__body"),
    ).withColumn("n_total", total)
    over = overflow_count(F.col("n_total"), n)
    text = F.concat(F.lit(header), F.lit("\n"), F.col("__body"),
                    F.when(over > 0, F.concat(F.lit("\n"), F.format_string(OVERFLOW_FMT, over)))
                    .otherwise(F.lit("")))
    return (j.filter(F.col("n_items") > 0)
            .select("n_items", "n_total", over.alias("overflow"), text.alias("text")))
