"""Column functions over probability arrays: one array per question, options in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepline.functions.text import col

MAX_OPTIONS = 255
SUM_TOLERANCE = 0.02
SURE = 0.97  # fixed value: weight of the chosen option in a one-hot answer


def let(value: Column, fn) -> Column:
    """fn(value), with value computed once however often fn uses it."""
    return F.transform(F.array(value), fn)[0]


def extend(items: Column, **fields) -> Column:
    """Every struct of an array with further fields, each a function of the struct.

    A chain of these computes each value once: an expression over a lambda variable is
    never copied into its consumers, as nested plain expressions would be.
    """

    def grown(item: Column) -> Column:
        out = item
        for name, fn in fields.items():
            out = out.withField(name, fn(item))
        return out

    return F.transform(items, grown)


def total(p: Column | str) -> Column:
    return F.aggregate(col(p), F.lit(0.0), lambda acc, x: acc + x)


def argmax_first(p: Column | str) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(col(p), F.array_max(col(p))) - 1).cast("int")


def choice_confidence(p: Column | str) -> Column:
    """How far the best option is above chance, scaled to 1; a single option is certain."""
    k = F.size(col(p))
    return F.when(k == 1, F.lit(1.0)).otherwise((F.array_max(col(p)) - 1.0 / k) / (1.0 - 1.0 / k))


def score_confidence(p: Column | str) -> Column:
    """1 minus the expected distance from the modal level, over the largest distance."""
    mode = argmax_first(p)
    spread = F.aggregate(
        F.transform(col(p), lambda x, i: x * F.abs(i - mode)), F.lit(0.0), lambda acc, x: acc + x
    )
    return F.when(F.size(col(p)) > 1, F.lit(1.0) - spread / F.greatest(F.size(col(p)) - 1, F.lit(1))).otherwise(F.lit(1.0))


def expected_level(p: Column | str) -> Column:
    return F.aggregate(F.transform(col(p), lambda x, i: x * i), F.lit(0.0), lambda acc, x: acc + x)


def softmax(z: Column | str, temperature: Column | float = 1.0) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    weights = let(F.array_max(col(z)), lambda top: F.transform(col(z), lambda x: F.exp((x - top) / t)))
    return let(weights, lambda e: let(total(e), lambda mass: F.transform(e, lambda x: x / mass)))


def log_loss(z: Column | str, gold: Column | str, temperature: float) -> Column:
    """Negative log softmax of the gold option (0-based) at a temperature.

    ``z`` is already shifted so that its largest entry is 0 (see ``shifted``).
    """
    t = F.lit(float(temperature))
    norm = F.aggregate(col(z), F.lit(0.0), lambda acc, x: acc + F.exp(x / t))
    return F.log(norm) - F.element_at(col(z), col(gold) + 1) / t


def shifted(z: Column | str) -> Column:
    """Logits with their maximum at 0: the softmax stays the same and can not overflow."""
    return let(F.array_max(col(z)), lambda top: F.transform(col(z), lambda x: x - top))


def dot_score(a: Column | str, b: Column | str) -> Column:
    """Scaled dot product of two vectors."""
    pairs = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return total(pairs) / F.sqrt(F.size(col(a)).cast("double"))


def brier(p: Column | str, keys: Column | str, gold: Column | str) -> Column:
    """Squared distance from the one-hot gold over the offered options."""
    gaps = F.zip_with(col(p), col(keys), lambda x, k: (x - (k == col(gold)).cast("double")))
    return F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g * g)


def soft_align(keys: Column | str, soft: Column | str) -> Column:
    """A soft-label map in option order, scaled to sum 1; null when nothing is left."""

    def aligned(m: Column) -> Column:
        return F.transform(col(keys), lambda k: F.coalesce(F.try_element_at(m, k), F.lit(0.0)))

    def scaled(raw: Column) -> Column:
        return let(total(raw), lambda mass: F.when(mass > 0, F.transform(raw, lambda x: x / mass)))

    return let(col(soft), lambda m: let(aligned(m), scaled))


def soft_mix(p: Column | str, gold: Column | str, mix: float) -> Column:
    """mix * one-hot(gold index) + (1 - mix) * p."""
    return F.transform(col(p), lambda x, i: (1 - mix) * x + F.when(i == col(gold), mix).otherwise(0.0))


def one_hot_smooth(keys: Column | str, chosen: Column | str) -> Column:
    """Almost all weight on the chosen key, the rest shared; six decimals; certain for a single key."""
    k = F.size(col(keys))
    rest = F.round((1 - SURE) / (k - 1), 6)
    return F.when(k == 1, F.array(F.lit(1.0))).otherwise(
        F.transform(
            col(keys),
            lambda key: F.when(key == col(chosen), F.round(1 - rest * (k - 1), 6)).otherwise(rest),
        )
    )


def bin_floor(confidence: Column | str, bins: int = 10) -> Column:
    """Calibration bin by floor(confidence * bins) after clamping to [0, 1]."""
    c = F.least(F.greatest(col(confidence), F.lit(0.0)), F.lit(1.0))
    return F.least(F.floor(c * bins), F.lit(bins - 1)).cast("int")


def edge_points(bins: int = 10) -> list[float]:
    """Equally spaced bin edges as doubles: step times index, last one exactly 1."""
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]


def bin_edges(confidence: Column | str, bins: int = 10) -> Column:
    """Calibration bin by comparison with the edges; the last bin is closed, outside is null."""
    c, edges = col(confidence), edge_points(bins)
    out = F.when(c < edges[0], F.lit(None).cast("int")).when(c > edges[-1], F.lit(None).cast("int"))
    for j in range(bins - 1, 0, -1):
        out = out.when(c >= edges[j], F.lit(j))
    return out.otherwise(F.lit(0))
