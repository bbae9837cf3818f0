"""Triple-style facts: cleaning, typing, ordering, pairing and rendering.

All windows are partitioned by entity or by a group key; pairs are made by position in a
hash order inside a group, so no group is crossed with itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sampling import uniform
from ..operators.sequences import numbered
from .text import broken_value, capitalise_first, likely_english

CLAIM = T.StructType([T.StructField("property", T.StringType()), T.StructField("property_id", T.StringType()), T.StructField("value", T.StringType()), T.StructField("value_id", T.StringType()), T.StructField("datatype", T.StringType())])
ENTITY = T.StructType([T.StructField("id", T.StringType()), T.StructField("label", T.StringType()), T.StructField("description", T.StringType()), T.StructField("facts", T.ArrayType(CLAIM))])
#: Ranks of properties in a text; others come last, in stored order.
RANK = {"P1": 0, "P2": 1, "P3": 2, "P14": 3, "P6": 4, "P5": 5, "P8": 6, "P15": 7, "P4": 8, "P7": 9, "P10": 10, "P11": 11}
OTHER_RANK = 99


def partial_date(c: Column) -> Column:
    """``+YYYY-MM-DDT…`` trimmed to the parts that are known (Y, Y-M or Y-M-D)."""
    d = F.regexp_replace(F.regexp_replace(c, r"^\+", ""), "T.*$", "")
    return F.regexp_replace(F.regexp_replace(d, r"-00-[0-9]{2}$", ""), "-00$", "")


def padded_date(c: Column) -> Column:
    """A partial date as a text that compares in time order (missing parts as 00)."""
    parts = F.split(partial_date(c), "-")
    two = lambda i: F.lpad(F.coalesce(F.get(parts, F.lit(i)), F.lit("00")), 2, "0")
    return F.concat_ws("-", F.lpad(F.get(parts, F.lit(0)), 4, "0"), two(1), two(2))


def quantity(c: Column) -> Column:
    """struct(amount double, unit text) of ``+N [unit]``; null amount for a non-number."""
    amount = F.regexp_extract(c, r"^\+?(-?[0-9]+(?:\.[0-9]+)?)(?: |$)", 1).try_cast("double")
    unit = F.nullif(F.regexp_extract(c, r"^\S+ (.*)$", 1), F.lit(""))
    return F.struct(amount.alias("amount"), F.when(amount.isNotNull(), unit).alias("unit"))


def labels(c: Column, *langs: str) -> Column:
    """First label of a map in the order of languages."""
    return F.coalesce(*[F.try_element_at(c, F.lit(x)) for x in langs])


def flatten_claims(df: DataFrame, json_col: str, id_col: str) -> DataFrame:
    """(id, pos, property, …) rows of nested claims: property id -> list of claims."""
    kind = T.MapType(T.StringType(), T.ArrayType(T.StructType([T.StructField("label", T.MapType(T.StringType(), T.StringType())), T.StructField("value", T.StringType()), T.StructField("datatype", T.StringType())])))
    m = df.select(id_col, F.explode(F.from_json(json_col, kind)).alias("property_id", "claims"))
    e = m.select(id_col, "property_id", F.posexplode("claims").alias("pos", "c"))
    return e.select(id_col, "property_id", "pos", labels(F.col("c.label"), "eo").alias("property"), F.col("c.value").alias("value"), F.col("c.datatype").alias("datatype")).where("property is not null")


def usable(claims: DataFrame, entities: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Clean facts: allowed property, a value, not English, not broken, not about itself,
    and the first surviving value of each property of an entity."""
    c = claims.where("property is not null and value is not null and value <> ''")
    if allowed is not None:
        c = c.where(F.col("property_id").isin(*allowed))
    c = c.where(~likely_english(F.col("value")) & ~broken_value(F.col("value")))
    c = c.join(entities.select("entity_id", "label"), "entity_id").where("value <> label")
    w = W.partitionBy("entity_id", "property_id").orderBy("pos", "value")
    return c.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def ranked(facts: DataFrame) -> DataFrame:
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), F.col("property_id")), F.lit(OTHER_RANK))
    w = W.partitionBy("entity_id").orderBy(rank, "pos", "value")
    return facts.withColumn("seq", F.row_number().over(w))


def entity_type(claims: DataFrame, kinds: list[tuple[str, str]], fallback: list[tuple[str, str]]) -> DataFrame:
    """(entity_id, kind): the first class fact that holds an indicator wins, then property sets.

    ``kinds`` is an ordered list of (substring of the class value, kind); ``fallback`` of
    (property id the entity has, kind).
    """
    hit = None
    for i, (mark, _) in enumerate(kinds):
        t = F.lower("value").contains(mark)
        hit = F.when(t, F.lit(i)) if hit is None else hit.when(t, F.lit(i))
    first = claims.where("property_id = 'P1' and value is not null").select("entity_id", "pos", hit.alias("k")).where("k is not null")
    first = first.groupBy("entity_id").agg(F.min_by("k", F.struct("pos", "k")).alias("k"))
    have = claims.groupBy("entity_id").agg(*[F.max((F.col("property_id") == p).cast("int")).alias(f"_h{i}") for i, (p, _) in enumerate(fallback)])
    names = F.array(*[F.lit(k) for _, k in kinds])
    alt = F.lit("other")
    for i, (_, k) in reversed(list(enumerate(fallback))):
        alt = F.when(F.col(f"_h{i}") == 1, F.lit(k)).otherwise(alt)
    return have.join(first, "entity_id", "left").select("entity_id", F.coalesce(F.get(names, F.col("k")), alt).alias("kind"))


def neighbours(df: DataFrame, part: list[str], key: str, draw: str) -> DataFrame:
    """Rows 1 and 2, 3 and 4, … of each part in hash order: (part, a, b) structs.

    Numbers are given in two steps (``sequences.numbered``) and the two rows of a pair meet by
    the pair's number, so a part with a third of all rows is spread over many tasks."""
    cols = [c for c in df.columns if c not in part]
    n = numbered(df, part, F.round(uniform(F.col(key), draw), 9), key, "_rn")
    row = F.struct(*cols)
    both = n.groupBy(*part, F.floor(F.col("_rn") / 2).alias("_pair")).agg(F.first(F.when(F.col("_rn") % 2 == 0, row), ignorenulls=True).alias("a"), F.first(F.when(F.col("_rn") % 2 == 1, row), ignorenulls=True).alias("b"))  # one of each
    return both.where("b is not null").select(*part, "a", "b")


def about_equal(a: Column, b: Column, tolerance: float = 0.05) -> Column:
    top = F.greatest(F.abs(a), F.abs(b))
    return F.when(top == 0, F.lit(True)).otherwise(F.abs(a - b) / top < tolerance)


def superlatives(values: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """(by, n, most, least): labels with the largest and smallest positive value of groups
    of ``least`` members or more."""
    v = values.where("amount > 0")
    g = v.groupBy(*by).agg(F.count("*").alias("n"), F.max_by("label", F.struct("amount", "label")).alias("most"), F.min_by("label", F.struct("amount", "label")).alias("least"))
    return g.where(F.col("n") >= least)


def render(template: Column, **slots: Column) -> Column:
    for name, value in slots.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def question_answers(facts: DataFrame, templates: DataFrame) -> DataFrame:
    """(entity_id, pos, question, answer): one turn per fact whose property has a template."""
    t = templates.select("property_id", "question", "answer")
    j = facts.join(t, "property_id")
    slot = {"subj": F.col("label"), "obj": F.col("value")}
    return j.select("entity_id", "seq", render(F.col("question"), **slot).alias("question"), render(F.col("answer"), **slot).alias("answer"))


def conversations(turns: DataFrame, least: int = 2, most: int = 5) -> DataFrame:
    """(entity_id, n, messages): the first turns of each entity as one conversation."""
    w = W.partitionBy("entity_id").orderBy("seq")
    t = turns.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    m = F.array_sort(F.collect_list(F.struct("rn", "question", "answer")))
    g = t.groupBy("entity_id").agg(m.alias("m")).where(F.size("m") >= least)
    msg = lambda x: F.array(F.struct(F.lit("user").alias("role"), x["question"].alias("content")), F.struct(F.lit("assistant").alias("role"), x["answer"].alias("content")))
    return g.select("entity_id", (F.size("m") * 2).alias("n"), F.flatten(F.transform("m", msg)).alias("messages"))


def paragraph(facts: DataFrame, templates: DataFrame, least: int = 2) -> DataFrame:
    """(entity_id, n, text): opening sentence of the best-ranked fact, then the others in order,
    the subject named once and then by pronoun."""
    j = ranked(facts).join(templates.select("property_id", "answer"), "property_id")
    first = W.partitionBy("entity_id").orderBy("seq")
    j = j.withColumn("k", F.row_number().over(first))
    s = render(F.col("answer"), subj=F.when(F.col("k") == 1, F.col("label")).otherwise(F.lit("ĝi")), obj=F.col("value"))
    j = j.withColumn("s", capitalise_first(s))
    g = j.groupBy("entity_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]), " ").alias("text"))
    return g.where(F.col("n") >= least)


def opening_fact(facts: DataFrame, openers: list[str]) -> DataFrame:
    """(entity_id, property_id, value): the best-ranked fact with an opening template, else the best-ranked."""
    f = ranked(facts)
    has = F.when(F.col("property_id").isin(*openers), 0).otherwise(1) if openers else F.lit(1)
    best = f.groupBy("entity_id").agg(F.min_by(F.struct("property_id", "value"), F.struct(has.alias("h"), F.col("seq"))).alias("b"))
    return best.select("entity_id", "b.property_id", "b.value")


def comparison(facts: DataFrame, by: list[str], draw: str, least: int = 2) -> DataFrame:
    """(by, a, b, text): two entities of a group told apart property by property."""
    s = facts.groupBy("entity_id", "label", *by).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("property", "value")))).alias("m"))
    p = neighbours(s, by, "entity_id", draw)
    shared = F.array_sort(F.array_intersect(F.map_keys("a.m"), F.map_keys("b.m")))
    va, vb = (lambda k: F.try_element_at(F.col("a.m"), k)), (lambda k: F.try_element_at(F.col("b.m"), k))
    line = F.transform("shared", lambda k: F.when(va(k) == vb(k), F.concat(F.lit("Ambaŭ: "), k, F.lit(" – "), va(k), F.lit("."))).otherwise(F.concat(k, F.lit(": "), va(k), F.lit(" kaj "), vb(k), F.lit("."))))
    q = p.withColumn("shared", shared).where(F.size("shared") >= least).withColumn("text", F.array_join(line, " "))
    return q.select(*by, F.col("a.label").alias("a"), F.col("b.label").alias("b"), "text")


def cross_entity(turns: DataFrame, part: str, draw: str, each: int = 2) -> DataFrame:
    """(part, a, b, n, chat): conversations that pass from one entity to another of its part."""
    w = W.partitionBy("entity_id").orderBy("seq")
    t = turns.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= each)
    one = t.groupBy(part, "entity_id").agg(F.array_sort(F.collect_list(F.struct("rn", "question", "answer"))).alias("m"))
    p = neighbours(one, [part], "entity_id", draw)
    text = lambda m: F.transform(m, lambda x: F.concat(x["question"], F.lit(" "), x["answer"]))
    both = F.concat(text(F.col("a.m")), text(F.col("b.m")))
    return p.select(part, F.col("a.entity_id").alias("a"), F.col("b.entity_id").alias("b"), F.size(both).alias("n"), F.array_join(both, "\n").alias("chat"))


# ---------------------------------------------------------------- small tests and forms of facts

# Class names and kinds that decide how a fact is worded.
TRIVIAL_CLASSES = ("homo", "human", "huamn", "persono")
ABSTRACT = (
    "emocio", "humoro", "sento", "koncepto", "ideo", "teorio", "scienco", "studo", "branĉo", "disciplino",
    "movado", "filozofio", "ideologio", "religio", "kutimo", "tradicio", "principo", "valoro",
)
INVENTIONS = (
    "invento", "aparato", "instrumento", "maŝino", "ilo", "programaro",
    "teknologio", "protokolo", "algoritmo", "programlingvo", "retejo",
)
SETTLEMENTS = (
    "urbo", "urbeto", "urbego", "municipo", "komunumo", "vilaĝo", "insulo", "distrikto",
    "provinco", "regiono", "kantono", "departemento", "gubernio", "prefektejo",
)
CLASS_PROPERTY, LONG_CLASS_LABEL, FEW_FACTS = "estas", 5, 5


def holds_any(text: Column, parts: tuple[str, ...]) -> Column:
    """Does the text hold one of the parts, case ignored?"""
    low = F.lower(text)
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in parts]), F.lit(False))


def trivial_class(prop: Column, value: Column, person: Column) -> Column:
    """A class that says nothing: a person is human, or a label of more than five words."""
    long = F.size(F.filter(F.split(F.trim(value), r"\s+"), lambda w: w != "")) > LONG_CLASS_LABEL
    return F.coalesce((prop == CLASS_PROPERTY) & ((person & holds_any(value, TRIVIAL_CLASSES)) | long), F.lit(False))


def class_tests(claims: DataFrame) -> DataFrame:
    """(entity_id, abstract, invention): does one of the classes point to an idea or a device?"""
    c = claims.where(F.col("property") == CLASS_PROPERTY)
    return c.groupBy("entity_id").agg(F.max(holds_any(F.col("value"), ABSTRACT)).alias("abstract"), F.max(holds_any(F.col("value"), INVENTIONS)).alias("invention"))


def strip_language(value: Column) -> Column:
    """The name of a language without the word for language behind it."""
    return F.regexp_replace(value, " [lL]ingvo$", "")


def settlement_kind(claims: DataFrame) -> DataFrame:
    """(entity_id, kind): the first class that is a kind of settlement, else ``loko``."""
    c = claims.where(F.col("property") == CLASS_PROPERTY).withColumn("k", F.lower("value"))
    return c.groupBy("entity_id").agg(F.coalesce(F.min_by(F.when(F.col("k").isin(*SETTLEMENTS), F.col("k")), F.when(F.col("k").isin(*SETTLEMENTS), F.struct("pos", "k"))), F.lit("loko")).alias("kind"))


def variants(counts: DataFrame, n: int = 3) -> DataFrame:
    """(entity_id, variant): one text of an entity with few facts, else ``n`` of them."""
    return counts.select("entity_id", F.explode(F.sequence(F.lit(1), F.when(F.col("n_facts") < FEW_FACTS, 1).otherwise(n))).alias("variant"))


#: Question pattern and answer sentence by category; {} is the answer, \\1 what the pattern caught.
GOLD = {
    "ĉefurbo": (r"ĉefurbo de (\w[\w-]*)", "La ĉefurbo de {x} estas {a}.", "La ĉefurbo estas {a}."),
    "aritmetiko": (r"(?:Kiom|Kio) estas (.+?)\?", "{x} = {a}.", "Estas {a}."),
}


def structured_gold(category: Column, question: Column, answer: Column) -> Column:
    """A sentence that answers the question, by its category; the plain answer sentence for others."""
    fill = lambda form, x: F.replace(F.replace(F.lit(form), F.lit("{x}"), x), F.lit("{a}"), answer)
    out = F.replace(F.lit("La respondo estas {a}."), F.lit("{a}"), answer)
    for name, (pattern, form, bare) in GOLD.items():
        x = F.regexp_extract(question, "(?U)" + pattern, 1)
        out = F.when(category == name, F.when(x != "", fill(form, x)).otherwise(fill(bare, x))).otherwise(out)
    return out


def partners(entities: DataFrame, by: str, key: str) -> DataFrame:
    """(key, partner): the next entity of the same kind, the first one after the last.

    Neighbours are looked for among the entities of a kind whose hashes fall into the same of
    ``BUCKETS`` parts, so a kind with a third of all entities is no single window."""
    bucket = F.floor(F.round(uniform(F.col(key), "partner"), 9) * BUCKETS)
    w = W.partitionBy(by, bucket).orderBy(key)
    every = W.partitionBy(by, bucket)
    return entities.select(key, by, F.coalesce(F.lead(key).over(w), F.min(key).over(every)).alias("partner")).where(F.col(key) != F.col("partner"))


#: Windows over which a kind is spread where partners are looked for.
BUCKETS = 64

