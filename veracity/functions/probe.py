"""Statistics of model outputs held in array columns, by built-in array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(c: Column, f=lambda x: x) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + f(x).cast("double"))


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def softmax(logits: Column) -> Column:
    """Probabilities of one row of logits, shifted by the greatest so nothing overflows."""
    up = let(F.array_max(logits), lambda most: F.transform(logits, lambda x: F.exp(x.cast("double") - most)))
    return let(up, lambda u: let(total(u), lambda s: F.transform(u, lambda x: x / s)))


def log_prob(logits: Column, index: Column) -> Column:
    """The log-softmax of one row at an index."""
    return let(F.array_max(logits).cast("double"), lambda most: F.get(logits, index).cast("double") - most - F.log(total(logits, lambda x: F.exp(x.cast("double") - most))))


def token_log_probs(rows: Column, ids: Column) -> Column:
    """Log-probabilities of the chosen tokens, a row of logits each."""
    return F.transform(rows, lambda row, i: log_prob(row, F.get(ids, i)))


def entropy(p: Column) -> Column:
    return -total(p, lambda x: x * F.log(x + 1e-10))


def top_mass(p: Column, k: int) -> Column:
    return total(F.slice(F.sort_array(p, asc=False), 1, k))


def norm(v: Column) -> Column:
    return F.sqrt(total(v, lambda x: x.cast("double") * x.cast("double")))


def mean(c: Column) -> Column:
    return F.when(F.size(c) > 0, total(c) / F.size(c)).otherwise(0.0)


def sample_std(c: Column) -> Column:
    """0 for fewer than two values."""
    square = let(mean(c), lambda m: total(c, lambda x: (x - m) * (x - m)))
    return F.when(F.size(c) > 1, F.sqrt(square / (F.size(c) - 1))).otherwise(0.0)


def uncertainty(df: DataFrame, rows: str, ids: str) -> DataFrame:
    """Adds the twelve numbers of an answer: of log-probabilities, entropies and the heads of the distributions."""
    staged = df.withColumns({"_lp": token_log_probs(F.col(rows), F.col(ids)), "_p": F.transform(rows, softmax)}).withColumn("_e", F.transform("_p", entropy))
    lp, p, e = map(F.col, ("_lp", "_p", "_e"))
    return staged.withColumns({
        "mean_lp": mean(lp), "min_lp": F.array_min(lp), "max_lp": F.array_max(lp), "std_lp": sample_std(lp), "mean_entropy": mean(e), "max_entropy": F.array_max(e), "std_entropy": sample_std(e),
        "perplexity": F.exp(-mean(lp)), "n_tokens": F.size(lp), "first_lp": F.get(lp, F.lit(0)), "mean_top1": mean(F.transform(p, F.array_max)), "mean_top5": mean(F.transform(p, lambda x: top_mass(x, 5))),
    }).drop("_lp", "_p", "_e")


def layer_summary(prompt: Column, answers: Column) -> dict[str, Column]:
    """Norm of a prompt's hidden state and mean norm of the answer's."""
    return {"prompt_norm": norm(prompt), "answer_norm": mean(F.transform(answers, norm))}


def internal(df: DataFrame, layers: str) -> DataFrame:
    """Adds ``internal`` from an array of layers, each struct<prompt: array, answers: array<array>, lens: array<array>> (the prompt's
    last hidden state, the answer's, and the answer's logits through the output layer): for each layer the prompt's norm, the mean
    norm of the answer and the mean entropy of its logits, then the drop of that entropy from the first to the last layer and its ratio."""
    lens = lambda x: mean(F.transform(x["lens"], lambda row: let(softmax(row), entropy)))
    each = F.transform(layers, lambda x: F.array(norm(x["prompt"]), mean(F.transform(x["answers"], norm)), lens(x)))
    staged = df.withColumn("_l", each)
    first, last = F.get(F.get("_l", F.lit(0)), F.lit(2)), F.get(F.element_at("_l", -1), F.lit(2))
    return staged.withColumn("internal", F.concat(F.flatten("_l"), F.array(first - last, last / (first + 1e-10)))).drop("_l")
