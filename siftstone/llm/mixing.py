"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source is a random permutation of its documents (by keyed hash), cut into blocks of
equal hash ranges.  A source's target in words becomes an exact number of block draws: all
its blocks for each whole pass, then blocks in permuted order, and within the one block
where the target falls single documents, largest first, while they fit.  The vector of
block quotas is split recursively: each node of a binary tree draws, by sequential
hypergeometric sampling, how many blocks of each source go to its left half.  The leaves, 64 or more at any size,
are output shards; each gets disjoint ranges of its sources' permuted blocks and shuffles
its own rows.  The tree works on one number for each node and source that has draws there, never on rows.  The stage
writes shards to files, in their shuffled order, and packing goes on file by file.

Only DataFrame and SQL expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftstone.llm.common import columns, table
from siftstone.sources.scratch import cut

#: No target is above this many times its source's size.
MAX_REPEATS = 3
#: Documents in a block, about; blocks of a source at most.
BLOCK_DOCS = 256
MAX_BLOCKS = 1 << 20
#: Words in an output file, about; the tree's leaves, the shards, at least and at most.  Small
#: corpora have several shards in a file.
SHARD_WORDS = 4_000_000
MIN_SHARDS, MAX_SHARDS = 64, 1 << 16
#: Sources whose draws are made one after another; more are drawn in groups, groups first.
GROUP = 256
#: Of a source's shards, every so manieth is looked at first.
STRIDE = 256
SEED = 20240

_GAP = r"[\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    parts = F.split(c, _GAP)
    first = F.when(F.element_at(parts, 1) == "", 1).otherwise(0)
    last = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (F.size(parts) - first - last).cast("long")


def _place(*cols) -> Column:
    """Place in a source's permutation, 62 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *cols), 2)


def _source_key(c: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))


def targets(sources: DataFrame) -> DataFrame:
    """Adds ``target`` to (source, source_size): weights 1, 2, 3, repeating, in code-point
    order, null last; a target above three times its size stops there and the excess is
    shared again by weight.  Sorted by the ratio of cap to weight, the sources up to some
    place are capped and the others get one rate: one window finds it, without rounds."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cap = F.col("source_size") * MAX_REPEATS
    ratio = cap.cast("double") / F.col("weight")
    before = Window.orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    rate = (F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0))).cast("double") / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    out = sources.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1).withColumn("rate", rate)
    common = F.max(F.when(F.col("rate") <= ratio, F.col("rate"))).over(every)
    return out.withColumn("target", F.least(common * F.col("weight"), cap.cast("double"))).drop("rate", "weight")


def _ln_factorial(n: str) -> str:
    small = "array(0D,0D,0.6931471805599453D,1.791759469228055D,3.1780538303479458D,4.787491742782046D,6.579251212010101D,8.525161361065415D,10.60460290274525D,12.801827480081469D)"
    return (
        f"(case when {n} < 10 then {small}[cast({n} as int)] else "
        f"({n} + 0.5D) * ln({n}) - {n} + 0.9189385332046727D + 1D / (12D * {n}) - 1D / (360D * {n} * {n} * {n}) end)"
    )


def _hypergeometric(total: str, marked: str, drawn: str, u: str) -> str:
    """SQL for the number of marked items among ``drawn`` of ``total``, by inverting the
    distribution at ``u`` over nine standard deviations on each side."""
    choose = lambda n, k: f"{_ln_factorial(n)} - {_ln_factorial(k)} - {_ln_factorial(f'({n} - {k})')}"
    pmf = f"exp({choose(marked, 'k')} + {choose(f'({total} - {marked})', f'({drawn} - k)')} - ({choose(total, drawn)}))"
    mean = f"({drawn} * ({marked} / cast({total} as double)))"
    sd = f"sqrt(greatest(0D, {mean} * (1 - {marked} / cast({total} as double)) * ({total} - {drawn}) / greatest({total} - 1, 1)))"
    low = f"greatest(0L, {drawn} + {marked} - {total}, cast(floor({mean} - 9 * {sd}) as bigint) - 2)"
    high = f"least({marked}, {drawn}, cast(ceil({mean} + 9 * {sd}) as bigint) + 2)"
    step = f"if(c.sum >= {u}, c, named_struct('sum', c.sum + {pmf}, 'k', k))"
    return (
        f"(case when {total} <= 0 then 0L else "
        f"aggregate(sequence({low}, {high}), named_struct('sum', -1e-300D, 'k', {low}), (c, k) -> {step}, c -> c.k) end)"
    )


def _taken(seed: int) -> str:
    """What of ``quotas`` goes to a node's left child: ``draws`` sequential draws over the sources."""
    u = f"((shiftrightunsigned(xxhash64({int(seed)}, node, s.source_key), 11) + 0.5D) / 9007199254740992D)"
    take = _hypergeometric("a.total", "s.quota", "a.draws", u)
    # a: what is left to draw from and to draw; the take is computed once, in an inner list.
    return (
        "aggregate(quotas, named_struct('total', aggregate(quotas, 0L, (x, s) -> x + s.quota), "
        "'draws', draws, 'taken', cast(array() as array<bigint>)), "
        f"(a, s) -> transform(array({take}), t -> named_struct('total', a.total - s.quota, 'draws', a.draws - t, "
        "'taken', array_append(a.taken, t)))[0], a -> a.taken)"
    )


_SUM = "aggregate(quotas, 0L, (x, s) -> x + s.quota)"


def _group_draws(nodes: DataFrame, seed: int) -> DataFrame:
    """Adds ``draws``: how many of each group of sources go to the left child.  A node's groups
    are drawn as sources are, from their sums."""
    name = F.concat(F.lit("group "), F.col("group").cast("string"))
    sums = nodes.groupBy("node").agg(F.sort_array(F.collect_list(F.struct(name.alias("source_key"), F.expr(_SUM).alias("quota"), "group"))).alias("quotas"))
    drawn = sums.withColumn("draws", F.expr(f"{_SUM} div 2")).withColumn("taken", F.expr(_taken(seed)))
    each = drawn.select("node", F.explode(F.expr("transform(quotas, (s, i) -> struct(s.group as group, taken[i] as draws))")).alias("x"))
    return nodes.join(each.select("node", "x.*"), ["node", "group"])


def shard_quotas(sources: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(source_key, starts, shard_ids): where the ranges of a source's draws start, and in which
    shards, for those that have any.  ``sources`` has (source_key, quota); ``shards`` is a power of two.

    A node holds the sources that have draws left there, in groups of about ``GROUP``, a row
    each, so that neither a list nor a task grows with the sources, and all rows together at most with the draws.
    """
    groups = max(1, sources.count() // GROUP)
    one = F.sort_array(F.collect_list(F.struct("source_key", "quota")))
    group = F.pmod(F.xxhash64("source_key"), F.lit(groups)).cast("int").alias("group")
    nodes = sources.where("quota > 0").select("source_key", F.col("quota").cast("long").alias("quota"), group).groupBy("group").agg(one.alias("quotas"))
    nodes = nodes.select(F.lit(1).cast("long").alias("node"), "group", "quotas")
    for _ in range(shards.bit_length() - 1):
        drawn = nodes.withColumn("draws", F.expr(f"{_SUM} div 2")) if groups == 1 else _group_draws(nodes, seed)
        drawn = drawn.withColumn("taken", F.expr(_taken(seed)))
        left = F.expr("transform(quotas, (s, i) -> named_struct('source_key', s.source_key, 'quota', taken[i]))")
        right = F.expr("transform(quotas, (s, i) -> named_struct('source_key', s.source_key, 'quota', s.quota - taken[i]))")
        some = lambda quotas: F.filter(quotas, lambda s: s["quota"] > 0).alias("quotas")
        both = F.array(F.struct((F.col("node") * 2).alias("node"), some(left)), F.struct((F.col("node") * 2 + 1).alias("node"), some(right)))
        nodes = drawn.select("group", F.explode(both).alias("n")).select("n.node", "group", "n.quotas").where(F.size("quotas") > 0)
        if groups > 1:
            nodes = cut(nodes, "mix-nodes")
    leaf = nodes.select((F.col("node") - shards).cast("int").alias("shard"), F.explode("quotas").alias("s")).select("shard", "s.source_key", "s.quota")
    upto = Window.partitionBy("source_key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = leaf.withColumn("start", F.coalesce(F.sum("quota").over(upto), F.lit(0)))
    ranges = starts.groupBy("source_key").agg(F.sort_array(F.collect_list(F.struct("start", "shard"))).alias("r"))
    return ranges.select("source_key", F.col("r.start").alias("starts"), F.col("r.shard").alias("shard_ids"))


def plan(docs: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame, int]:
    """(rows, sources, shards): ``rows`` has (doc_id, source_key, size, place) of every
    document; ``sources`` one row for each source with all that decides its draws: at most a
    number for each of its draws and shards."""
    text = F.coalesce("text", F.lit(""))
    rows = cut(docs.select("doc_id", "source", word_count(text).alias("size"), _place("doc_id", text).alias("place")), "mix-rows")
    keyed = rows.withColumn("source_key", _source_key())
    by = keyed.groupBy("source_key").agg(
        F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n")
    )
    blocks = F.least(F.lit(MAX_BLOCKS), F.pow(2, F.floor(F.log2(F.greatest(F.lit(1), F.col("n") / BLOCK_DOCS))))).cast("long")
    passes = F.least(F.lit(MAX_REPEATS), F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))).cast("long")
    whole = cut(
        targets(by).withColumn("blocks", blocks).withColumn("passes", passes)
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")),
        "mix-sources",
    )
    block = _block("place", "blocks")
    placed = keyed.where("size > 0").join(whole.select("source_key", "blocks", "rest"), "source_key").withColumn("block", block)
    sums = placed.groupBy("source_key", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("source_key").orderBy("block")
    met = sums.withColumn("upto", F.sum("words").over(upto)).where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
    edge = met.select("source_key", "block", (F.col("rest") - F.col("upto") + F.col("words")).alias("need"))
    # The rows of one place (repeats of a row) go together; one block of each source only.
    units = placed.join(edge, ["source_key", "block"]).groupBy("source_key", "block", "need", "place").agg(F.sum("size").alias("size"))
    filled = units.groupBy("source_key", "block", "need").agg(
        F.sort_array(F.collect_list(F.struct("size", "place")), asc=False).alias("u")
    )
    fit = F.expr(
        "aggregate(u, named_struct('left', need, 'picks', cast(array() as array<bigint>)), (a, x) -> "
        "if(x.size <= a.left, named_struct('left', a.left - x.size, 'picks', array_append(a.picks, x.place)), a))"
    )
    # What is left may be nearer to one more of the smallest documents than to none.
    near = F.expr("filter(u, x -> not array_contains(f.picks, x.place) and x.size < 2 * f.left)")
    chosen = filled.withColumn("f", fit).withColumn("more", near).select(
        "source_key", F.col("block").alias("edge"),
        F.when(F.size("more") > 0, F.array_append("f.picks", F.element_at("more", -1).getField("place"))).otherwise(F.col("f.picks")).alias("picks"),
    )
    drawn = whole.join(chosen, "source_key", "left").withColumn("edge", F.coalesce("edge", F.lit(0)))
    drawn = drawn.withColumn("picks", F.coalesce("picks", F.array().cast("array<bigint>")))
    drawn = cut(drawn.withColumn("quota", F.col("passes") * F.col("blocks") + F.col("edge") + F.when(F.size("picks") > 0, 1).otherwise(0)), "mix-drawn")
    total = whole.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    shards = max(MIN_SHARDS, _files(total))
    starts = shard_quotas(drawn, shards, seed)
    # Every so manieth start is a head: a draw's shard is found in two short scans.
    heads = F.filter("starts", lambda s, i: i % F.lit(STRIDE) == 0)
    sources = cut(drawn.join(starts.withColumn("heads", heads), "source_key", "left"), "mix-plan")
    return keyed, sources, shards


def _files(words: int) -> int:
    return min(MAX_SHARDS, 1 << (words // SHARD_WORDS).bit_length())


def _block(place: str, blocks: str) -> Column:
    """Block of a place: the top bits of its 62, as many as the power of two needs."""
    return F.expr(f"shiftright({place}, 62 - cast(log2({blocks}) as int))").cast("long")


def _draws(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds source_size, target, copies and the shard of each copy.  One row for each
    source is joined, so a hot source is no hot key when that side is broadcast, and is
    split by adaptive execution when it isn't."""
    block = _block("place", "blocks")
    extra = (F.col("block") < F.col("edge")) | ((F.col("block") == F.col("edge")) & F.array_contains("picks", F.col("place")))
    joined = rows.join(sources.drop("source"), "source_key").withColumn("block", block)
    copies = F.col("passes") + F.when(extra, 1).otherwise(0)
    head = "size(filter(heads, s -> s <= e * blocks + block)) - 1"
    within = f"size(filter(slice(starts, h * {STRIDE} + 1, {STRIDE}), s -> s <= e * blocks + block)) - 1"
    found = F.expr(f"transform(sequence(0L, copies - 1), e -> transform(array({head}), h -> shard_ids[h * {STRIDE} + {within}])[0])")
    out = joined.withColumn("copies", copies)
    return out.withColumn("shards", F.when(F.col("copies") > 0, found).otherwise(F.array().cast("array<int>")))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shards) for every row of ``docs``.

    ``taken`` is a whole number of copies of the document, at most three, and ``shards`` says
    where each of them goes, as ``seed`` has it.  Null and empty
    texts have size 0, and nothing is taken of them; a null source is a source, the last;
    a null doc_id is kept.  Texts of any length are counted whole; one that is longer than
    its source's target is left out or taken once, whichever is nearer.  Equal rows get equal results, so a row repeated is taken or
    left as one; where documents of one size compete, their keyed hashes decide.  An empty table gives no rows.  Only doc_id, text
    and source are read.  Reruns agree.
    """
    rows, sources, _ = plan(docs, seed)
    out = _draws(rows, sources)
    return out.select(
        "doc_id", "size", "source_size", "target",
        F.when(F.col("size") > 0, F.col("copies") * F.col("size")).otherwise(F.lit(0)).cast("long").alias("taken"), "shards",
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, seed: int = SEED) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it; a partition, and so a file
    when it is written, is a shard, or as many shards as have its words together, shuffled.  Documents without words (null, empty, blank)
    have no share and go.  Null ids and sources, long texts, repeated rows and empty tables are
    treated as in :func:`mix`; columns of any name stay."""
    _, sources, shards = plan(docs, seed)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.struct(*columns(docs)).alias("row"), _source_key().alias("source_key"), _place("doc_id", text).alias("place"), F.length(F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     "))).alias("n")
    )
    drawn = _draws(rows.where("n > 0"), sources).select("row", "place", F.explode("shards").alias("shard"))
    files = min(shards, _files(sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]))
    named = drawn.withColumn("file", F.expr(f"shard div {shards // files}").cast("int"))
    mixed = named.repartitionById(files, "file").sortWithinPartitions("file", F.xxhash64(F.lit(seed), "shard", "place"))
    return mixed.select("row.*")
