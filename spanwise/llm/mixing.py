"""Operator 6. Mixing sources to target weights by iterative proportional fitting.

Token weights are summed per combination of the marginal columns. The table of
combinations is fitted to the target shares of each margin in turn until all hold,
no combination giving more than it has; the ratio of fitted to present weight is the
probability with which documents of that combination are drawn, independently.
Shares that the bound leaves out of reach are reported.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.functions.columns import named
from spanwise.llm.common import bounded_rows, fresh

#: Combinations of marginal values. They are counts, not documents, and more are refused.
MOST_CELLS = 200_000
ROUNDS = 500
CLOSE = 1e-9
#: Difference of shares wanted and reached from which a warning is given.
APART = 1e-4
#: Share of all token weight that a sample is expected to hold.
KEEP = 0.5
_NONE = "(none)"


@dataclass(frozen=True)
class Mix:
    """Combinations of marginal values, their token weight, and each margin's values with the shares wanted of them."""

    margins: tuple[str, ...]
    cells: list[tuple[str, ...]]
    present: np.ndarray
    codes: list[np.ndarray]
    values: list[list[str]]
    wanted: list[np.ndarray]

    def rates(self, keep: float = KEEP) -> np.ndarray:
        """Probability for each combination, at most 1: `keep` of all weight is expected, in the shares wanted.

        The shares are fitted under the bound that no combination gives more than it holds. Where the bound
        leaves no way to meet them, the values short of weight are taken whole; see `reached`.
        """
        total = self.present.sum()
        if not len(self.cells) or total <= 0 or keep <= 0:
            return np.zeros(len(self.cells))
        fitted = rake(self.present, self.codes, self.wanted, self.present / total / keep)
        rate = np.divide(fitted * keep * total, self.present, out=np.zeros_like(fitted), where=self.present > 0)
        # A combination without weight is worth what its neighbours are at least: it costs nothing to keep.
        rate[self.present <= 0] = rate.max(initial=0.0)
        return np.minimum(1.0, rate)

    def reached(self, keep: float = KEEP) -> list[tuple[str, str, float, float]]:
        """(margin, value, share wanted, share of the weight expected in a sample) of every marginal value."""
        drawn = self.present * self.rates(keep)
        drawn = drawn / max(drawn.sum(), 1e-300)
        found = []
        for name, code, values, share in zip(self.margins, self.codes, self.values, self.wanted, strict=True):
            now = np.bincount(code, drawn, len(values))
            share = np.where(np.bincount(code, self.present, len(values)) > 0, share, 0.0)
            found += [(name, *row) for row in zip(values, (share / max(share.sum(), 1e-300)).tolist(), now.tolist(), strict=True)]
        return found


def _factors(code: np.ndarray, worth: np.ndarray, most: np.ndarray, share: np.ndarray) -> np.ndarray:
    """For each value the factor with which its `worth`, cut at `most`, sums to its share; where all falls short, the one that fills all."""
    room = np.bincount(code, most, len(share))
    full = share >= room * (1 - 1e-12)
    least = np.full(len(share), np.inf)
    np.minimum.at(least, code, np.divide(worth, most, out=np.full_like(worth, np.inf), where=most > 0))
    factor = np.divide(1.0, least, out=np.zeros_like(least), where=least > 0)
    cut = full[code]
    while True:  # the cut ones only become more
        held = np.bincount(code, np.where(cut, most, 0.0), len(share))
        loose = np.bincount(code, np.where(cut, 0.0, worth), len(share))
        factor = np.where(full, factor, np.divide(share - held, loose, out=np.zeros_like(share), where=loose > 0))
        over = ~cut & (worth * factor[code] > most)
        if not over.any():
            return factor
        cut = cut | over


def rake(
    present: np.ndarray, codes: Sequence[np.ndarray], targets: Sequence[np.ndarray], most: np.ndarray | None = None
) -> np.ndarray:
    """Weights with the given margins, nearest to `present` in relative entropy, each at most `most` where given.

    `codes[m][i]` is the value of combination i in margin m, `targets[m]` that margin's shares.
    Shares of values that do not occur are left out and the others raised in proportion; so is
    what a value cannot give under `most`. Margins that could each be met but not all together
    come as near as the rounds bring them.
    """
    wanted = np.all([np.asarray(t, float)[c] > 0 for c, t in zip(codes, targets, strict=True)], axis=0)
    worth = np.where(wanted, present / max(present.sum(), 1e-300), 0.0)  # before it is cut
    most = np.where(worth > 0, np.inf if most is None else most, 0.0)
    total = np.array([min(1.0, most.sum())])
    shares = []
    for code, target in zip(codes, targets, strict=True):
        room = np.bincount(code, most, len(target))
        share = np.where(room > 0, np.asarray(target, float), 0.0)
        shares.append(np.minimum(room, share * _factors(np.zeros(len(share), np.int64), share, room, total)))
    fitted = np.minimum(worth, most)
    for _ in range(ROUNDS):
        off = 0.0
        for code, share in zip(codes, shares, strict=True):
            off = max(off, np.abs(np.bincount(code, fitted, len(share)) - share).max(initial=0))
            worth = np.where(worth > 0, np.clip(worth * _factors(code, worth, most, share)[code], 1e-250, 1e250), 0.0)
            fitted = np.minimum(worth, most)
        if off < CLOSE:
            break
    return fitted


def n_words(text: Column) -> Column:
    """Tokens of a text between blanks, as its weight."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+")), F.lit(0))


def _value(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(_NONE))


def fit_mix(
    docs: DataFrame,
    margins: Mapping[str, Column],
    targets: Mapping[str, Mapping[str, float]] | None = None,
    weight: Column | None = None,
    text_col: str = "text",
    temper: float = 0.5,
) -> Mix:
    """Fit the combinations found in `docs` to target shares.

    `margins` names the columns' expressions (source, language, topic). `targets` gives
    the share of each value per margin; a margin without targets gets shares in
    proportion to its present ones to the power `temper` (0: equal, 1: as they are).
    Values without a target get none. Nulls are the value "(none)". Weights below 0
    and null count as 0. More than `MOST_CELLS` combinations are refused.
    """
    amount = F.greatest(F.coalesce((weight if weight is not None else n_words(named(text_col))).cast("double"), F.lit(0.0)), F.lit(0.0))
    keys = [_value(column).alias(f"m{i}") for i, column in enumerate(margins.values())]
    found = docs.select(*keys, amount.alias("weight")).groupBy(*[f"m{i}" for i in range(len(keys))]).agg(F.sum("weight"))
    rows = sorted(tuple(r) for r in bounded_rows(found, MOST_CELLS, "combinations of marginal values"))
    present = np.array([r[-1] for r in rows], float)
    codes, names, shares = [], [], []
    for i, name in enumerate(margins):
        values = sorted({r[i] for r in rows})
        number = {v: k for k, v in enumerate(values)}
        code = np.array([number[r[i]] for r in rows], np.int64)
        wanted = (targets or {}).get(name)
        if wanted is None:
            now = np.bincount(code, present, len(values))
            share = np.where(now > 0, now ** temper, 0.0)
        else:
            share = np.array([wanted.get(v, 0.0) for v in values], float)
        codes.append(code)
        names.append(values)
        shares.append(share)
    return Mix(tuple(margins), [r[:-1] for r in rows], present, codes, names, shares)


def with_rates(docs: DataFrame, margins: Mapping[str, Column], mix: Mix, keep: float, out_col: str) -> DataFrame:
    """Add the sampling probability of each row's combination; those unknown to `mix` get 0."""
    spark = docs.sparkSession
    apart = [(*row[:2], round(row[2], 5), round(row[3], 5)) for row in mix.reached(keep) if abs(row[2] - row[3]) > APART]
    if apart:
        warnings.warn(f"shares out of reach at keep={keep} (margin, value, wanted, reached): {apart[:40]}, {len(apart)} in all", stacklevel=2)
    base = docs.drop(out_col)
    own = [fresh(base, f"own_{i}") for i in range(len(mix.margins))]
    cell = [fresh(base, f"cell_{i}") for i in range(len(mix.margins))]
    share = fresh(base, "share")
    fields = ", ".join(f"`{c}` string" for c in cell)
    rates = [(*values, float(rate)) for values, rate in zip(mix.cells, mix.rates(keep), strict=True)]
    table = spark.createDataFrame(rates, f"{fields}, `{share}` double")  # at most MOST_CELLS rows
    keyed = base.select(*[named(c) for c in base.columns], *[_value(c).alias(name) for name, c in zip(own, margins.values(), strict=True)])
    same = [F.col(a) == F.col(b) for a, b in zip(own, cell, strict=True)]
    joined = keyed.join(F.broadcast(table), same, "left")
    return joined.select(*[named(c) for c in base.columns], F.coalesce(share, F.lit(0.0)).alias(out_col))


def draw(id_col: str, text_col: str, seed: int = 0) -> Column:
    """Repeatable number in [0, 1) from a row's id and text."""
    return F.pmod(F.xxhash64(F.lit(seed), named(id_col).cast("string"), named(text_col)), F.lit(2**53)) / F.lit(float(2**53))


def sample_mix(
    docs: DataFrame,
    margins: Mapping[str, Column],
    mix: Mix,
    keep: float = KEEP,
    id_col: str = "doc_id",
    text_col: str = "text",
    rate_col: str = "rate",
    seed: int = 0,
) -> DataFrame:
    """Documents drawn with their combination's probability, which is added as `rate_col`, in place of an input column of that name.

    Each row is drawn by its own id and text, so the result does not depend on
    partitions or retries, and rows alike are taken or left together. Null ids and
    texts draw like any other value. An empty table gives none.
    """
    rated = with_rates(docs, margins, mix, keep, rate_col)
    return rated.filter(draw(id_col, text_col, seed) < named(rate_col))
