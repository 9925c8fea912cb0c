"""Losses and evaluation metrics on array columns. Each gives a double for each row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions.tensors import let, q_of_logits, total, wdl


def zipped(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, f)


def log_sum_exp(xs: Column) -> Column:
    """Over elements that aren't null."""
    return let(F.array_max(xs), lambda top: top + F.log(F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.coalesce(F.exp(x - top), F.lit(0.0)))))


def cross_entropy(logits: Column, labels: Column) -> Column:
    """Softmax cross-entropy; a masked (null) logit counts only if its label isn't 0, and then without bound."""
    term = lambda norm: lambda x, t: F.when(t == 0, 0.0).when(x.isNull(), float("inf")).otherwise(t * (norm - x))
    return let(logits, lambda xs: let(log_sum_exp(xs), lambda norm: total(zipped(xs, labels, term(norm)))))


def masked(logits: Column, targets: Column) -> Column:
    """Logits with null where the target is negative: an illegal move."""
    return zipped(logits, targets, lambda x, t: F.when(t >= 0, x.cast("double")))


def legal(targets: Column) -> Column:
    return F.transform(targets, lambda t: F.greatest(t.cast("double"), F.lit(0.0)))


def tempered(targets: Column, temperature: float) -> Column:
    """Targets to the power 1 / temperature, of sum one again; a temperature at or under 0 is 1."""
    t = 1.0 if temperature <= 0 else temperature
    if t == 1.0:
        return targets
    raised = F.transform(targets, lambda x: F.pow(x, F.lit(1.0 / t)))
    return let(raised, lambda xs: let(total(xs), lambda whole: F.transform(xs, lambda x: x / F.when(whole > 0, whole).otherwise(1.0))))


def policy_cross_entropy(logits: Column, targets: Column, temperature: float = 1.0, mask: bool = True) -> Column:
    return cross_entropy(masked(logits, targets) if mask else logits, tempered(legal(targets), temperature))


def policy_kl(logits: Column, targets: Column, temperature: float = 1.0, mask: bool = True) -> Column:
    t = tempered(legal(targets), temperature)
    return policy_cross_entropy(logits, targets, temperature, mask) + total(F.transform(t, lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)))


def optimistic_weight(target_q: Column, wdl_logits: Column, error: Column, strength: float, eps: float, alpha: float) -> Column:
    z = (target_q - q_of_logits(wdl_logits)) / (F.sqrt(error) + F.lit(eps))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(z - F.lit(strength)) * F.lit(alpha)))


def value_cross_entropy(wdl_logits: Column, q: Column, d: Column) -> Column:
    return cross_entropy(wdl_logits, wdl(q, d))


def moves_left(prediction: Column, target: Column, scale: float = 20.0, delta: float = 10.0) -> Column:
    """Huber's loss of moves left, both scaled down."""
    x, k = F.abs(prediction - target) / F.lit(scale), delta / scale
    return F.when(x <= k, x * x * 0.5).otherwise(F.lit(k) * (x - F.lit(0.5 * k)))


def value_error(error: Column, wdl_logits: Column, target_q: Column) -> Column:
    return F.pow(error - F.pow(q_of_logits(wdl_logits) - target_q, F.lit(2)), F.lit(2))


def q_bucket(q: Column, buckets: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(buckets - 1), F.floor((q + F.lit(1.0)) / 2 * buckets))).cast("int")


def categorical(logits: Column, q: Column, buckets: int) -> Column:
    return log_sum_exp(logits) - F.get(logits, q_bucket(q, buckets))


def weighted(losses: dict[str, Column], weights: dict[str, float]) -> Column:
    """The sum of weight times loss; each loss must have a weight and each weight a loss."""
    if set(losses) != set(weights):
        raise ValueError(f"losses and weights differ: {sorted(set(losses) ^ set(weights))}")
    out = F.lit(0.0)
    for name, loss in losses.items():
        out = out + F.lit(weights[name]) * loss
    return out


def argmax(xs: Column) -> Column:
    """The 0-based place of the greatest element, the first of equals."""
    return F.array_position(xs, F.array_max(xs)) - 1


def policy_accuracy(logits: Column, targets: Column) -> Column:
    return (argmax(masked(logits, targets)) == argmax(legal(targets))).cast("double")


def policy_entropy(targets: Column) -> Column:
    return -total(F.transform(legal(targets), lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)))


def policy_uniform_loss(targets: Column) -> Column:
    """Cross-entropy of an even guess over the legal moves."""
    return F.log(F.size(F.filter(targets, lambda t: t >= 0)).cast("double"))


def value_mse(q: Column, target_q: Column) -> Column:
    """Squared error on the scale 0 to 1."""
    return F.pow(q - target_q, F.lit(2)) / 4


def value_accuracy(wdl_logits: Column, q: Column, d: Column) -> Column:
    return (argmax(wdl_logits) == argmax(wdl(q, d))).cast("double")


def q_mix(z: Column, q: Column, ratio: float) -> Column:
    return z * F.lit(1.0 - ratio) + q * F.lit(ratio)
