"""Catalog operators: checks of declarative dimensions, inheritance, indexes, numeric bake."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checkpoints import saved
from .closure import closure


def value_violations(props: DataFrame, slots: DataFrame) -> DataFrame:
    """(owner, slot, value, reason): values of unknown slots, outside a closed vocabulary, or
    a second value of a scalar slot.  ``slots`` is (slot, vocabulary array or null, scalar)."""
    j = props.join(slots, "slot", "left")
    n = props.groupBy("owner", "slot").agg(F.count_distinct("value").alias("n"))
    j = j.join(n, ["owner", "slot"])
    reason = (
        F.when(F.col("scalar").isNull(), "unknown slot")
        .when(F.col("vocabulary").isNotNull() & ~F.array_contains("vocabulary", F.col("value")), "not in vocabulary")
        .when(F.col("scalar") & (F.col("n") > 1), "more than one value")
    )
    return j.select("owner", "slot", "value", reason.alias("reason")).where("reason is not null").distinct()


def missing_parents(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(src, dst) of a child-parent table whose parent is not declared."""
    return edges.where("dst is not null").join(names.select(F.col("name").alias("dst")), "dst", "left_anti").select("src", "dst")


def inherited(own: DataFrame, parents: DataFrame) -> DataFrame:
    """(owner, slot, value, depth): own values, else those of the nearest ancestor (of several
    at one distance the first by name); cycles are harmless."""
    up = closure(parents).select(F.col("src").alias("owner"), F.col("dst").alias("anc"), "depth")
    far = up.join(own.select(F.col("owner").alias("anc"), "slot", "value"), "anc").select("owner", "slot", "value", "depth", "anc")
    near = own.select("owner", "slot", "value", F.lit(0).alias("depth"), F.col("owner").alias("anc"))
    best = far.unionByName(near).groupBy("owner", "slot").agg(F.min_by(F.struct("value", "depth"), F.struct("depth", "anc", "value")).alias("b"))
    return best.select("owner", "slot", "b.value", "b.depth")


def postings(props: DataFrame) -> DataFrame:
    """(slot, value, n, owners): owners of each value, sorted."""
    return props.groupBy("slot", "value").agg(F.count_distinct("owner").alias("n"), F.array_sort(F.collect_set("owner")).alias("owners"))


def all_of(props: DataFrame, wanted: dict[str, str | tuple]) -> DataFrame:
    """(owner): owners that have every wanted slot value (any of several values)."""
    out = props.select("owner").distinct()
    for slot, value in wanted.items():
        values = value if isinstance(value, tuple) else (value,)
        hit = props.where((F.col("slot") == slot) & (F.col("value").isin(*values) if values else F.lit(False)))
        out = out.join(hit.select("owner"), "owner", "left_semi")
    return out


def models_slot(own: DataFrame, types: DataFrame, pervasive: list[str], derivable: list[str]) -> DataFrame:
    """(owner, slot, how): slots an owner declares, that hold for everything, or that rules derive."""
    declared = own.select("owner", "slot").distinct().withColumn("how", F.lit(0))
    owners = types.select("owner").distinct()
    rest = owners.select("owner", F.explode(F.array(*[F.lit(s) for s in (*pervasive, *derivable)])).alias("slot"))
    rest = rest.withColumn("how", F.when(F.col("slot").isin(*pervasive), 1).otherwise(2))
    how = F.array(F.lit("declared"), F.lit("pervasive"), F.lit("derivable"))
    return declared.unionByName(rest).groupBy("owner", "slot").agg(F.get(how, F.min("how")).alias("how"))


def producers(effects: DataFrame) -> DataFrame:
    """(slot, value, verbs): verbs that bring a value about, in order of name."""
    return effects.groupBy("slot", "value").agg(F.array_sort(F.collect_set("verb")).alias("verbs"))


def meaningful(effects: DataFrame, bindings: DataFrame, models: DataFrame) -> DataFrame:
    """Bindings (verb, owner) all of whose effect slots the owner models."""
    need = bindings.join(effects.select("verb", "slot").distinct(), "verb")
    lacking = need.join(models.select("owner", "slot"), ["owner", "slot"], "left_anti").select("verb", "owner").distinct()
    return bindings.join(lacking, ["verb", "owner"], "left_anti")


def mass(length: Column, width: Column, height: Column, density: Column) -> Column:
    """Volume times density times 1000; null where a part is missing or not a number."""
    n = lambda c: c.try_cast("double")
    return n(length) * n(width) * n(height) * n(density) * 1000


def compact_number(c: Column) -> Column:
    """Four significant digits without trailing zeros; null stays null."""
    digits = F.when(c == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(c)))).cast("int")
    scale = F.pow(F.lit(10.0), (F.lit(3) - digits).cast("double"))
    r = F.round(c * scale) / scale
    text = F.format_string("%.6f", r)
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def _join_step(a: str, b: str):
    """Fold step that appends a symbol, or joins it to an ``a`` before it where it is ``b``."""

    def step(acc: Column, x: Column) -> Column:
        joins = (F.get(acc, F.size(acc) - 1) == a) & (x == b)
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.lit(a + b)))).otherwise(F.concat(acc, F.array(x)))

    return step


def bpe_merges(words: DataFrame, rounds: int) -> list[tuple[str, str, int]]:
    """The first merges of byte-pair counting over (symbols array, n): each round counts
    neighbouring pairs by word frequency and joins the commonest (ties by name)."""
    out = []
    w = saved(words.select("symbols", "n"))
    for _ in range(rounds):
        k = F.size("symbols")
        pairs = w.where(k > 1).select("n", F.explode(F.arrays_zip(F.slice("symbols", 1, k - 1).alias("a"), F.slice("symbols", 2, k - 1).alias("b"))).alias("p"))
        top = pairs.groupBy("p.a", "p.b").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a", "b").limit(1).collect()
        if not top:
            break
        a, b, n = top[0]
        out.append((a, b, n))
        merged = F.aggregate("symbols", F.array().cast("array<string>"), _join_step(a, b))
        w = saved(w.select(merged.alias("symbols"), "n"))
    return out
