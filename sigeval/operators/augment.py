"""C9 — noise augmentation as a higher-order string expression.

For every baseline symbol draw ``u``: ``u < pa`` turns it into an artifact,
``u < pa + pn`` into noise; other symbols are untouched. ``pa`` and ``pn`` are
drawn uniformly per row from the regime's ranges. All draws are
``md5(seed:id[:i])`` values in [0, 1), so the result does not depend on
partitioning and is reproduced exactly on retry.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.util import as_col

TWO_32 = 4294967296.0


def unit_draw(seed: str, *parts) -> Column:
    """Uniform double in [0, 1) from ``md5(seed:part1:part2...)``."""
    pieces = [F.lit(f"{seed}:")]
    for i, p in enumerate(parts):
        if i:
            pieces.append(F.lit(":"))
        pieces.append(as_col(p).cast("string"))
    h = F.conv(F.substring(F.md5(F.concat(*pieces)), 1, 8), 16, 10).cast("bigint")
    return h.cast("double") / F.lit(TWO_32)


def uniform(lo: float, hi: float, u: Column) -> Column:
    return F.lit(float(lo)) + u * F.lit(float(hi) - float(lo))


def augment_noise(seq, id_col, noise_range=K.IN_NOISE_PROB, artifact_range=K.IN_ARTIFACT_PROB,
                  seed: str = "aug") -> Column:
    s = as_col(seq)
    rid = as_col(id_col)
    pa = uniform(*artifact_range, unit_draw(f"{seed}-pa", rid))
    pn = uniform(*noise_range, unit_draw(f"{seed}-pn", rid))

    def step(i):
        ch = F.substring(s, i, 1)
        u = unit_draw(seed, rid, i)
        noisy = (F.when(u < pa, F.lit(K.ARTIFACT))
                 .when(u < pa + pn, F.lit(K.NOISE))
                 .otherwise(ch))
        return F.when(ch == K.BASELINE, noisy).otherwise(ch)

    out = F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), step), "")
    return F.when(F.length(s) > 0, out).otherwise(s)
