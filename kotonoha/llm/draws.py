"""Exact discrete draws and index permutations as Columns.

A draw is by inversion: starting from the mode, weights relative to the mode follow from the
ratio of neighbouring probabilities, so that no factorials or logarithms are needed and the
support is walked over twelve standard deviations on either side (less than 1e-30 lies beyond).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Ratio = Callable[[Column], Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, also inside a lambda."""
    return F.transform(F.array(value), body)[0]


def uniform(*keys: Column | int) -> Column:
    """A pseudorandom double inside (0, 1) that depends on ``keys`` alone."""
    h = F.xxhash64(*[k if isinstance(k, Column) else F.lit(k) for k in keys])
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) * (2.0**-53)


def _walk(start: Column, steps: Column, sign: int, ratio: Ratio, first: Column, target: Column | None) -> Column:
    """From ``start``, ``steps`` values in direction ``sign``: the sum of their weights, or the value whose share of the sum holds ``target``."""
    zero = F.struct(first.alias("w"), F.lit(0.0).alias("s"), start.alias("x"))

    def one(acc: Column, i: Column) -> Column:
        k = start + i * sign
        return F.struct(
            (acc["w"] * ratio(k)).alias("w"),
            (acc["s"] + acc["w"]).alias("s"),
            (F.when(acc["s"] <= target, k).otherwise(acc["x"]) if target is not None else acc["x"]).alias("x"),
        )

    walked = F.aggregate(F.filter(F.sequence(F.lit(0).cast("long"), steps), lambda i: i < steps), zero, one)
    return walked["x"] if target is not None else walked["s"]


def _invert(mode: Column, low: Column, high: Column, sd: Column, up: Ratio, down: Ratio, u: Column) -> Column:
    reach = (F.ceil(sd * 12) + 24).cast("long")

    def pick(v: Column) -> Column:
        above, below = F.least(v["high"] - v["mode"], v["reach"]) + 1, F.least(v["mode"] - v["low"], v["reach"])

        def choose(t: Column) -> Column:
            return F.when(t["t"] < t["up"], _walk(v["mode"], above, 1, up, F.lit(1.0), t["t"])).when(below > 0, _walk(v["mode"] - 1, below, -1, down, down(v["mode"]), t["t"] - t["up"])).otherwise(v["mode"])

        sums = F.struct(_walk(v["mode"], above, 1, up, F.lit(1.0), None).alias("up"), F.when(below > 0, _walk(v["mode"] - 1, below, -1, down, down(v["mode"]), None)).otherwise(F.lit(0.0)).alias("down"))
        return let(let(sums, lambda s: F.struct(s["up"].alias("up"), (v["u"] * (s["up"] + s["down"])).alias("t"))), choose)

    return let(F.struct(mode.alias("mode"), low.alias("low"), high.alias("high"), reach.alias("reach"), u.alias("u")), pick)


def hypergeometric(good: Column, total: Column, n: Column, u: Column) -> Column:
    """How many of ``n`` rows drawn without replacement from ``total`` are among the ``good`` ones."""

    def draw(v: Column) -> Column:
        g, t, m = (v[x].cast("double") for x in "gtn")
        low, high = F.greatest(F.lit(0).cast("long"), v["n"] - (v["t"] - v["g"])), F.least(v["n"], v["g"])
        mode = F.greatest(low, F.least(high, F.floor((m + 1) * (g + 1) / (t + 2)).cast("long")))
        sd = F.sqrt(F.greatest(F.lit(0.0), m * (g / t) * (1 - g / t) * (t - m) / F.greatest(t - 1, F.lit(1.0))))
        up = lambda k: (g - k) * (m - k) / ((k + 1.0) * (t - g - m + k + 1))
        down = lambda k: k.cast("double") * (t - g - m + k) / ((g - k + 1) * (m - k + 1))
        return F.when(low >= high, low).otherwise(_invert(mode, low, high, sd, up, down, v["u"]))

    return let(F.struct(good.alias("g"), total.alias("t"), n.alias("n"), u.alias("u")), draw)


def binomial(n: Column, p: Column, u: Column) -> Column:
    """Successes in ``n`` trials that succeed with probability ``p``."""

    def draw(v: Column) -> Column:
        m, q = v["n"].cast("double"), v["p"]
        mode = F.least(v["n"], F.floor((m + 1) * q).cast("long"))
        odds = q / (1 - q)
        up = lambda k: (m - k) / (k + 1.0) * odds
        down = lambda k: k.cast("double") / (m - k + 1) / odds
        return F.when(q <= 0, F.lit(0).cast("long")).when(q >= 1, v["n"]).otherwise(_invert(mode, F.lit(0).cast("long"), v["n"], F.sqrt(m * q * (1 - q)), up, down, v["u"]))

    return let(F.struct(n.alias("n"), p.alias("p"), u.alias("u")), draw)


def permuted(index: Column, size: Column, *key: Column, rounds: int = 6, walk: int = 40) -> Column:
    """The place of ``index`` in a keyed pseudorandom permutation of 0 .. ``size`` - 1.

    A Feistel network over an a x b grid (a about the square root of ``size``) that holds the
    range with under a cells to spare; a value outside is sent through again. The spare cells
    are fewer than ``walk`` for sizes to 1600; beyond, ``walk`` misses in a row have a
    probability under 1e-60.
    """

    def through(v: Column, x: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            mixed = lambda half: F.xxhash64(v["k"], i, half)
            return F.when(i % 2 == 0, F.struct(F.pmod(acc["l"] + F.pmod(mixed(acc["r"]), v["a"]), v["a"]).alias("l"), acc["r"].alias("r"))).otherwise(F.struct(acc["l"].alias("l"), F.pmod(acc["r"] + F.pmod(mixed(acc["l"]), v["b"]), v["b"]).alias("r")))

        zero = F.struct((x % v["a"]).alias("l"), F.floor(x / v["a"]).cast("long").alias("r"))
        out = F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), zero, step)
        return let(out, lambda o: o["r"] * v["a"] + o["l"])

    def within(v: Column) -> Column:
        again = lambda y: F.when(y < v["n"], y).otherwise(through(v, y))
        return let(through(v, v["i"]), lambda first: F.when(first < v["n"], first).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(walk)), first, lambda y, _: again(y))))

    a = F.ceil(F.sqrt(size.cast("double"))).cast("long")
    return let(F.struct(index.cast("long").alias("i"), size.cast("long").alias("n"), a.alias("a"), F.ceil(size / a).cast("long").alias("b"), F.xxhash64(*key).alias("k")), within)
