"""Sampling of the next id from logits: a mask of allowed ids, temperature, nucleus (top-p), and a seeded draw.

Everything is an expression over a row's array of logits: the allowed ones are sorted once, and sums run over the sorted array
in constant state. The nucleus is the smallest set of likeliest ids whose probabilities reach top_p, with ids in order where
these are equal; it holds one id at least. Logits that are null, NaN or infinite count as not allowed; a row without allowed
ids draws null. Temperature 0 takes the likeliest id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessitura.functions.arrays import bound

Allowed = Callable[[Column], Column]


def ranked(logits: Column, temperature: float = 1.0, allowed: Allowed | None = None) -> Column:
    """Structs of w (minus the weight exp((x - max) / temperature)) and id, the likeliest first; weights of 0 are left out."""
    usable = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    named = F.transform(logits.cast("array<double>"), lambda x, i: F.struct(x.alias("x"), i.alias("id")))
    named = F.filter(named, lambda e: usable(e["x"]) & (allowed(e["id"]) if allowed else F.lit(True)))

    def weighed(own: Column) -> Column:
        most = F.array_max(F.transform(own, lambda e: e["x"]))
        if not temperature:
            return F.transform(F.slice(F.sort_array(F.transform(own, lambda e: F.struct((-e["x"]).alias("w"), e["id"].alias("id")))), 1, 1), lambda e: F.struct(F.lit(-1.0).alias("w"), e["id"].alias("id")))
        weights = bound(most, lambda m: F.transform(own, lambda e: F.struct((-F.exp((e["x"] - m) / temperature)).alias("w"), e["id"].alias("id"))))
        return F.sort_array(F.filter(weights, lambda e: e["w"] < 0))

    return bound(named, weighed)


def _nucleus(order: Column, top_p: float) -> Column:
    """The number of ids in the nucleus, and their weight."""
    total = F.aggregate(order, F.lit(0.0), lambda s, e: s - e["w"])
    first = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("mass"))
    more = lambda t: lambda s, e: F.when((s["mass"] < t * top_p) | (s["n"] == 0), F.struct((s["n"] + 1).alias("n"), (s["mass"] - e["w"]).alias("mass"))).otherwise(s)
    return bound(total, lambda t: F.aggregate(order, first, more(t)))


def drawn(logits: Column, u: Column, temperature: float = 1.0, top_p: float = 1.0, allowed: Allowed | None = None) -> Column:
    """A struct of token (the id drawn by u in [0, 1)), p (its probability within the nucleus) and n_kept (the nucleus' size)."""

    def pick(order: Column) -> Column:
        def within(core: Column) -> Column:
            none = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("int").alias("token"), F.lit(0.0).alias("p"))
            step = lambda s, e: F.when(s["token"].isNotNull(), s).otherwise(F.struct((s["sum"] - e["w"]).alias("sum"), F.when(s["sum"] - e["w"] > u * core["mass"], e["id"]).alias("token"), (-e["w"] / core["mass"]).alias("p")))
            found = F.aggregate(F.slice(order, 1, core["n"]), none, step)
            return bound(found, lambda f: F.struct(f["token"].alias("token"), f["p"].alias("p"), core["n"].alias("n_kept")))

        return F.when(F.size(order) > 0, bound(_nucleus(order, top_p), within))

    return bound(ranked(logits, temperature, allowed), pick)
