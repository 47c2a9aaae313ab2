"""Mixing sources to target weights.

Every document gets a hash-random key, and each source is dealt into ranges of the key, as many
as its rows ask for, so that sorting one range is a bounded task even for a source with a third of
all rows. Word totals of the ranges give their prefix sums, which say in which range of a source
its budget ends; that range alone is sorted, and prefix sums over it find the cut to the word.
Everything else follows by comparing a document's key with its source's cut, so neither documents
nor their sizes are sorted as a whole. A source whose budget exceeds its size is repeated: whole
epochs first, then the cut of the last epoch.

Rows of one source, id and size are one group, as nothing tells them apart in the order. If the
cut falls among them they are counted off over their partitions, and the budget takes as many
of them as it covers, the next one in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewell.operators.frames import running

from .common import discard, stored

WORD = r"[^\x20\x09-\x0D]++"
RANGE_ROWS = 100_000  # rows of a source in a range of the key
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
KEY_BITS = 60
BROADCAST_SOURCES = 100_000


def with_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``size``, the number of words; it replaces a column of that name. Null and empty texts
    have none; a very long text is counted in one pass; an empty table stays empty."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"))


def random_key(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, KEY_BITS // 4), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """A null source is a group of its own, also in joins."""
    return F.concat(F.when(source.isNull(), "0").otherwise("1"), F.coalesce(source, F.lit("")))


def budgets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size`` to ``source, source_size, weight, target``.

    Sources in code-point order, null last, take the weights in turn. A target is
    ``min(weight * level, most * source_size)`` with the one level at which the targets sum to
    ``share`` of all words: what capping and resharing by weight converge to. The input has
    one row per source, however many; both orders are sorted by ranges.
    """
    by_name = ["source_null", "source"]
    x = running(sizes.withColumn("source_null", F.col("source").isNull()), by_name, {"place": F.lit(1)})
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    x = x.withColumn("weight", pick).withColumn("cap", most * F.col("source_size"))
    x = running(x.withColumn("full_at", F.col("cap") / F.col("weight")), ["full_at", *by_name], {"caps": F.col("cap"), "weights": F.col("weight")})
    whole = x.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights")).first()
    wanted, all_weights = share * (whole["words"] or 0), whole["weights"] or 0.0
    # the level if this source and all that fill later stay below their caps
    level = (wanted - (F.col("caps") - F.col("cap"))) / (all_weights - (F.col("weights") - F.col("weight")))
    top = x.agg(F.max(F.when(level <= F.col("full_at"), level))).first()[0]
    level = F.lit(float("inf") if top is None else top)
    return x.select("source", "source_size", "weight", F.least(F.col("cap"), F.col("weight") * level).alias("target"))


def _place(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c) for c in ("__key", "doc_id", "size")])


def _cuts(rows: DataFrame, weights: tuple, share: float, most: float, range_rows: int) -> DataFrame:
    """One row per source, stored: ``__src, source_size, target, epochs``, and of the group where the last
    epoch ends ``__cut`` (key, id, size; null if no words are left for it), the words left for
    the group ``__left`` and its rows ``__same``. ``rows`` has ``__src, source, __key, doc_id, size``."""
    per = rows.groupBy("__src").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__rows"))
    per = stored(per, "sources", narrow=True)
    plan = per.join(budgets(per.select("source", "source_size"), weights, share, most).select(source_key(F.col("source")).alias("__src"), "target"), "__src")
    ranges = F.greatest(F.ceil(F.col("__rows") / range_rows), F.lit(1))
    plan = plan.withColumn("__width", F.ceil(F.lit(1 << KEY_BITS) / ranges).cast("long"))
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = stored(plan.withColumn("__rest", F.floor("target") - F.col("epochs") * F.col("source_size")).drop("source", "__rows"), "plan", narrow=True)
    few = _few(plan)
    dealt = rows.join(few.select("__src", "__width", "__rest"), "__src").filter("__rest > 0").withColumn("__range", F.expr("__key div __width"))
    totals = dealt.groupBy("__src", "__range", "__rest").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("__src").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    last = totals.filter("__before < __rest and __rest <= __before + words").select("__src", "__range", (F.col("__rest") - F.col("__before")).alias("__in"))
    last = stored(last, "ranges", narrow=True)
    inside = dealt.join(_few(last), ["__src", "__range"]).groupBy("__src", "__in", "__key", "doc_id", "size").agg(F.count(F.lit(1)).alias("__same"))
    along = Window.partitionBy("__src").orderBy("__key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("__start", F.coalesce(F.sum(F.col("size") * F.col("__same")).over(along), F.lit(0)))
    cut = inside.filter("__start < __in and __in <= __start + size * __same")
    cut = cut.select(F.col("__src").alias("__s"), _place().alias("__cut"), (F.col("__in") - F.col("__start")).alias("__left"), "__same")
    out = plan.join(cut, F.col("__src") == F.col("__s"), "left").drop("__s", "__width", "__rest")
    out = stored(out, "cuts", narrow=True)
    discard(per, plan, last)
    return out


def _few(per_source: DataFrame) -> DataFrame:
    """A table of at most a row per source, broadcast if there are few."""
    return F.broadcast(per_source) if per_source.count() <= BROADCAST_SOURCES else per_source


def _counted_off(rows: DataFrame, tag: str) -> DataFrame:
    """``rows`` (stored, with ``tag`` from ``monotonically_increasing_id``) with ``__turn``, their number
    from 0 within ``__src``: within a partition, after the rows of the partitions before."""
    rows = rows.withColumn("__task", F.shiftright(tag, 33))
    before = Window.partitionBy("__src").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("__src", "__task").agg(F.count(F.lit(1)).alias("n"))
    offsets = offsets.select("__src", "__task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__n"))
    turn = F.row_number().over(Window.partitionBy("__src", "__task").orderBy(tag)) - 1
    return rows.withColumn("__turn", turn).join(offsets, ["__src", "__task"]).withColumn("__turn", F.col("__turn") + F.col("__n")).drop("__task", "__n")


def _share(turn: Column) -> Column:
    """Words that the ``turn``-th row of a source's last group gives to the last epoch."""
    return F.greatest(F.lit(0), F.least(F.col("size"), F.col("__left") - turn * F.col("size"))).cast("long")


def mix(
    docs: DataFrame,
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    range_rows: int = RANGE_ROWS,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, source, size`` needed): ``doc_id, size, source_size,
    target, taken, source, epochs, part``.

    ``epochs`` times the whole document and the first ``part`` words of it once more;
    ``taken = epochs * size + part``. A source's ``taken`` sums to its target rounded down.
    The order is that of the first 60 bits of the MD5 of the id, then id, then size: reruns
    agree. Null ids and repeated rows are rows like others: rows of one id and size are
    taken one after the other, which of them first does not show in the result. Null sources are
    one source. A source without words, or an empty table, takes nothing; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col("size"), random_key(F.col(id_col)).alias("__key"))
    rows = rows.withColumn("__src", source_key(F.col("source"))).withColumn("__tag", F.monotonically_increasing_id())
    rows = stored(rows, "sizes")  # texts are read once
    cuts = _cuts(rows, weights, share, most, range_rows)
    placed = rows.join(_few(cuts), "__src")
    there = F.coalesce(_place() == F.col("__cut"), F.lit(False))
    plain = placed.filter(~there).withColumn("part", F.when(_place() < F.col("__cut"), F.col("size")).otherwise(F.lit(0)).cast("long"))
    group = _counted_off(placed.filter(there), "__tag").withColumn("part", _share(F.col("__turn")))
    names = ["doc_id", "size", "source_size", "target", "source", "epochs", "part"]
    out = plain.select(*names).unionByName(group.select(*names))
    return out.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"), "source", "epochs", "part")


def first_words(text: Column, n: Column) -> Column:
    """Text up to the end of its ``n``-th word, white space as it stands."""
    words, gaps = F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.split(text, WORD, -1)
    both = F.zip_with(F.slice(gaps, F.lit(1), n), F.slice(words, F.lit(1), n), lambda g, w: F.concat(g, w))
    return F.array_join(both, "")


def apply_mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``docs`` (its columns; ``doc_id, source, text`` needed) as the mix takes them: each document once
    per epoch and once more before its source's cut; the document at the cut up to its last word
    taken, with ``n_chars`` of what is left of it. Each source's words sum to its target
    rounded down.

    All decisions follow from one row per source, so texts are not shuffled, but for those of the
    one group per source that the cut falls in. Null ids, null sources and null texts, repeated
    rows and very long texts are rows like others, see ``mix``; a text without words is taken
    as often as its place in the order says. An empty table gives none; other columns, ``size``
    and ``n_chars`` among them, stay as they are.
    """
    keyed = with_words(docs.select("doc_id", "source", "text")).select("doc_id", "source", "size", random_key(F.col("doc_id")).alias("__key"))
    sizes = stored(keyed.withColumn("__src", source_key(F.col("source"))), "sizes")
    cuts = _cuts(sizes, weights, share, most, range_rows)
    at = F.struct(random_key(F.col("doc_id")).alias("__key"), F.col("doc_id"))
    own = [F.col(c).alias(f"__c_{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(*own, at.alias("__at"), F.col("text").alias("__text"), source_key(F.col("source")).alias("__src"))
    rows = rows.join(_few(cuts.select("__src", "epochs", "__cut", "__left")), "__src")
    cut_at = F.struct("__cut.__key", "__cut.doc_id")
    # an id has few sizes at the cut, and rows before them in the order of sizes are told apart there
    near = F.coalesce(F.col("__at") == cut_at, F.lit(False))
    extra = F.when(F.col("__at") < cut_at, 1).otherwise(0)
    plain = rows.filter(~near).withColumn("__copies", F.col("epochs") + F.coalesce(extra, F.lit(0))).withColumn("__words", F.lit(None).cast("int"))
    group = rows.filter(near).withColumn("size", F.coalesce(F.regexp_count("__text", F.lit(WORD)), F.lit(0)).cast("long"))
    group = stored(group.withColumn("__tag", F.monotonically_increasing_id()), "group")
    there = F.col("size") == F.col("__cut.size")
    counted = _counted_off(group.filter(there), "__tag").withColumn("part", _share(F.col("__turn"))).drop("__turn")
    part = F.when(F.col("size") < F.col("__cut.size"), F.col("size")).otherwise(F.lit(0)).cast("long")
    group = counted.unionByName(group.filter(~there).withColumn("part", part))
    taken = (F.col("part") > 0) | ((F.col("size") == 0) & (F.col("__cut.size") > 0))
    group = group.withColumn("__copies", F.col("epochs") + F.when(taken, 1).otherwise(0))
    group = group.withColumn("__words", F.when((F.col("part") > 0) & (F.col("part") < F.col("size")), F.col("part").cast("int")))
    out = plain.unionByName(group.select(plain.columns)).filter("__copies > 0")
    out = out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    short = F.col("__words").isNotNull() & (F.col("__copy") == F.col("__copies"))
    text = F.when(short, first_words(F.col("__text"), F.col("__words"))).otherwise(F.col("__text"))
    new = {"text": text, "n_chars": F.when(short, F.length(text)).otherwise(F.col(f"__c_{docs.columns.index('n_chars')}"))} if "n_chars" in docs.columns else {"text": text}
    kinds = {f.name: f.dataType for f in docs.schema}
    return out.select(*[(new[c].cast(kinds[c]) if c in new else F.col(f"__c_{i}")).alias(c) for i, c in enumerate(docs.columns)])
