"""Vector and scoring functions as column expressions (V1-V5).

All arithmetic is in double precision; stored vectors are 32-bit floats. A NULL
vector, a zero-norm vector or a length mismatch yields a NULL distance and is
excluded by every caller (a note without a usable vector cannot be ranked).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn import schema as S


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_places(c, places: int = 4) -> Column:
    """Half-up rounding as plain IEEE arithmetic: ``floor(x * 10^p + 0.5) / 10^p``.

    Written out (instead of an engine's ``round``) so that any engine doing
    the same double operations yields the same value at a .5 boundary."""
    m = float(10 ** places)
    return F.floor(_c(c) * F.lit(m) + F.lit(0.5)).cast("double") / F.lit(m)


def snap(c) -> Column:
    """Similarity snapped to 12 places: removes summation-order noise
    (~1e-16) so that e.g. a self-match scores exactly 1.0 whichever way the
    dot product was summed."""
    return round_places(c, 12)


def dot(a, b) -> Column:
    """Sum of element-wise products in double precision."""
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def norm(a) -> Column:
    sq = F.transform(_c(a), lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(sq, F.lit(0.0).cast("double"), lambda acc, v: acc + v))


def cosine_distance(a, b) -> Column:
    """V1: ``1 - cos(a, b)``; NULL for NULL, zero-norm or mismatched vectors."""
    na, nb = norm(a), norm(b)
    ok = (F.size(_c(a)) == F.size(_c(b))) & (na > 0) & (nb > 0)
    return F.when(ok, F.lit(1.0) - dot(a, b) / (na * nb))


def dot_similarity(a, b) -> Column:
    """V2: plain dot product (meaningful for unit vectors)."""
    return F.when(F.size(_c(a)) == F.size(_c(b)), dot(a, b))


def days_between(earlier, later) -> Column:
    """Fractional days from ``earlier`` to ``later`` (microsecond exact)."""
    return F.timestamp_diff("MICROSECOND", _c(earlier), _c(later)).cast("double") / 86_400_000_000.0


def recency(updated_at, as_of) -> Column:
    """V3: ``1 / (1 + 0.1 * days)``, days floored at 0. A missing timestamp
    counts as 'now' (days = 0), like the reference's unparsable-text rule."""
    d = F.coalesce(F.greatest(F.lit(0.0), days_between(updated_at, as_of)), F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.lit(S.RECENCY_DECAY_PER_DAY) * d)


def access_score(n) -> Column:
    """V4: ``min(1, n / 10)``."""
    return F.least(F.lit(1.0), _c(n).cast("double") / F.lit(S.ACCESS_SATURATION))


def relevance(similarity, updated_at, access_count, as_of,
              weights: tuple[float, float, float] = S.RELEVANCE_WEIGHTS) -> Column:
    """V5: weighted sum of similarity, recency and access (unrounded)."""
    ws, wr, wa = weights
    return (F.lit(ws) * _c(similarity) + F.lit(wr) * recency(updated_at, as_of)
            + F.lit(wa) * access_score(access_count))
