"""Record fingerprints.

sha256 hex of the lower-cased concatenation, with **no separator**, so
("ab", "c") and ("a", "bc") collide -- that is the contract of the history
table, not an accident we fix.  ``concat`` yields null when any part is null;
callers reject null parts first (they make the record malformed anyway).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fingerprint(title="title", company="company", url="url") -> Column:
    """Posting fingerprint over title+company+url."""
    return F.sha2(F.lower(F.concat(_col(title), _col(company), _col(url))), 256)


def lead_fingerprint(name="name", website="website") -> Column:
    """Lead fingerprint over name+website."""
    return F.sha2(F.lower(F.concat(_col(name), _col(website))), 256)
