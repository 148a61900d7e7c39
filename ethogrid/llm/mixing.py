"""Mixing sources to target weights, in DataFrame operations only.

Each source's documents, in a pseudorandom order, form one stream of words that is cut into blocks
of `block` words; a document may span blocks. Sources weigh 1, 2, 3, repeating, in the order of
their names, and share all words by weight; a source stops at `most` times its size and the rest
is shared anew (closed form: sources ordered by size over weight fill up first). The output is a
sequence of slots, one block each, in shards of `shard` slots. Every source's slots are dealt over the
output by a pseudorandom permutation of all slots (a Feistel network with cycle walking), which draws
each shard's source counts: multinomial draws under the condition that the totals are the sources'
quotas (multivariate hypergeometric ones), as free draws would drift from the targets. Slot k of a
source with B blocks is block perm(k mod B) of pass k div B, by such a permutation of the source's
block numbers that is keyed by source and pass. Slots join blocks by source and block number. The
last slot of a source is cut, so a source gives its target to within one word; as no pass repeats a
block, no document is taken more than `most` times.

Nothing is keyed by source alone but sums: streams are numbered in bins of documents within a source,
`bins` of them or more, so that they hold about `bin` rows at most; so a source with most of the rows is
spread over tasks. Null and empty texts have size 0 and are taken 0 times. An empty table gives no rows.
Very long texts span many blocks. Only the named columns are read, so others may have any name. The null source comes last. Repeated rows are documents of their own; rows
with equal doc_id are told apart by their texts, and fully equal ones stand next to each other.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ethogrid.session import cut

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Params:
    block: int = 256
    shard: int = 1024
    most: int = 3
    weights: tuple[int, ...] = (1, 2, 3)
    bins: int = 1024
    bin: int = 65_536
    prime: int = 2_147_483_647


def _scatter(x: Column, salt: int, p: Params) -> Column:
    """A number below p.prime that looks random; 64-bit products don't overflow."""
    step = lambda y, a, b: F.pmod(F.pmod(y, F.lit(p.prime)) * F.lit(a) + F.lit(b), F.lit(p.prime))
    once = step(x, 48_271, salt)
    return step(once.bitwiseXOR(F.shiftright(once, 13)), 69_621, 977)


def bins(documents: DataFrame, p: Params) -> Params:
    """The parameters with as many bins as the rows ask for."""
    return replace(p, bins=max(p.bins, -(-documents.count() // p.bin)))


def sized(documents: DataFrame, p: Params = Params(), carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, bin, a text fingerprint for ties, and the columns to carry."""
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long"))
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.pmod(_scatter(number, 1, p), F.lit(p.bins)).alias("bin"),
        F.xxhash64("text").alias("tie"),
        *carry,
    )


def targets(sizes: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per source: its number, size, weight, target and its slots.

    quota = whole * source_size + rest words are taken, in slots slots of which the last gives cut words.
    The windows span the sources, of which there are few, not the documents.
    """
    everything = Window.partitionBy(F.lit(1))
    named = everything.orderBy(F.col("source").isNull(), F.col("source"))
    filled = everything.orderBy(F.col("cap") / F.col("weight"), "number")
    size, blocks = F.col("source_size"), F.col("blocks")
    weights = F.array(*[F.lit(w).cast("long") for w in p.weights])
    level = (F.col("total") - F.col("before")).cast("double") / F.col("after")
    return (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("number", F.row_number().over(named).cast("long") - 1)
        .withColumn("weight", F.element_at(weights, (F.col("number") % len(p.weights) + 1).cast("int")))
        .withColumn("cap", p.most * size)
        .withColumn("before", F.coalesce(F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("after", F.sum("weight").over(filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", level)
        .withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
        # what a unit of weight gets once the full sources have stopped: the level at the first that isn't full
        .withColumn("share", F.max(F.when(~F.col("full"), F.col("level"))).over(everything))
        .withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("share")))
        .withColumn("quota", F.least(F.round("target").cast("long"), F.col("cap")))
        .withColumn("blocks", F.ceil(size / p.block).cast("long"))
        .withColumn("whole", F.when(size > 0, F.expr("quota div source_size")).otherwise(F.lit(0).cast("long")))
        .withColumn("rest", F.col("quota") - F.col("whole") * size)
        .withColumn("tail", F.least(F.ceil(F.col("rest") / p.block).cast("long"), blocks))
        .withColumn("slots", F.col("whole") * blocks + F.col("tail"))
        .withColumn("cut", F.when(F.col("tail") > 0, F.col("rest") - (F.col("tail") - 1) * p.block).otherwise(F.lit(p.block).cast("long")))
        .withColumn("first_slot", F.sum("slots").over(everything.orderBy("number")) - F.col("slots"))
        .withColumn("all_slots", F.sum("slots").over(everything))
        .select("source", "number", "source_size", "weight", "target", "blocks", "slots", "cut", "first_slot", "all_slots")
    )


#: Rounds of a permutation, and steps after which a place has come back into range (as the tests' SQL has them).
ROUNDS, STEPS = 3, 64


def _drawn(x: Column, k: Column, p: Params) -> Column:
    """A number below 2 ** 28 that looks random, for the k-th half of a round."""
    prime = F.lit(p.prime)
    once = F.pmod(F.pmod(x * 31 + F.col("_key") * 7_919 + k * 104_729, prime) * 48_271, prime)
    return F.shiftright(F.pmod(F.shiftright(once, 7) * 69_621 + 977, prime), 3)


def _shuffled(i: Column, p: Params) -> Column:
    """One pass of a Feistel network with the key `_key` over a grid of `_a` * `_b` cells.

    Halves of rounds are folded over a pair (the coordinate to change, the other one), so that the expression has each of them
    once, however many rounds there are.
    """
    start = F.struct(F.pmod(i, F.col("_a")).alias("x"), F.floor(i / F.col("_a")).alias("y"))
    half = lambda s, k: F.struct(s["y"].alias("x"), F.pmod(s["x"] + _drawn(s["y"], k, p), F.when(k % 2 == 1, F.col("_a")).otherwise(F.col("_b"))).alias("y"))
    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(2 * ROUNDS).cast("long")), start, half, lambda s: s["y"] * F.col("_a") + s["x"])


def permuted(rows: DataFrame, name: str, i: Column, n: Column, key: Column, p: Params) -> DataFrame:
    """The rows with a column `name`: the place of i among n, 0 <= i < n, by a pseudorandom permutation keyed by key.

    The grid has less than root n cells beyond n; a place there is shuffled on until it is in range, which takes
    `STEPS` steps for no place of a small n, and for one with a chance under n ** -STEPS/2 of a large one.
    """
    rows = rows.withColumns({"_i": i.cast("long"), "_n": n.cast("long"), "_key": key.cast("long")})
    rows = rows.withColumn("_a", F.ceil(F.sqrt(F.col("_n").cast("double")))).withColumn("_b", F.ceil(F.col("_n") / F.col("_a")))
    rows = rows.withColumn("_to", _shuffled(F.col("_i"), p))
    inside = lambda x: x < F.col("_n")
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.col("_to"), lambda x, _: F.when(inside(x), x).otherwise(_shuffled(x, p)))
    return rows.withColumn(name, F.when(inside(F.col("_to")), F.col("_to")).otherwise(walked)).drop("_i", "_n", "_key", "_a", "_b", "_to")


def slots(goals: DataFrame, p: Params = Params(), chunk: int = 1 << 16) -> DataFrame:
    """The output's slots: shard, slot, number, pass, block, and how many words of the block are taken.

    The slots of a source are made in chunks, so that a large source's slots are made by many tasks.
    """
    k, n = F.col("k"), F.col("blocks")
    full = n - 1  # the last block may be short and is the last of every pass
    rows = (
        goals.where("slots > 0")
        .select("number", "blocks", "slots", "cut", "first_slot", "all_slots", F.explode(F.expr(f"sequence(0L, (slots - 1) div {chunk})")).alias("chunk"))
        .repartition("number", "chunk")
        .select("*", F.explode(F.expr(f"sequence(chunk * {chunk}, least((chunk + 1) * {chunk}, slots) - 1)")).alias("k"))
        .withColumn("pass", F.expr("k div blocks"))
        .withColumn("turn", k % n)
    )
    # the last turn has no other place, so it stands alone in a range of one
    last = F.col("turn") == full
    rows = permuted(rows, "inner", F.when(last, 0).otherwise(F.col("turn")), F.when(last, 1).otherwise(full), F.col("pass") * 1_009 + F.col("number"), p)
    rows = permuted(rows, "slot", F.col("first_slot") + k, F.col("all_slots"), F.lit(-1), p)
    return rows.select(
        F.expr(f"slot div {p.shard}").alias("shard"), "slot", "number", "pass", F.when(last, full).otherwise(F.col("inner")).alias("block"),
        F.when(k == F.col("slots") - 1, F.col("cut")).otherwise(F.lit(p.block).cast("long")).alias("take"),
    )


def shard_counts(goals: DataFrame, p: Params = Params()) -> DataFrame:
    """shard, number and n: the drawn number of slots of each source in each output shard."""
    return slots(goals, p).groupBy("shard", "number").agg(F.count("*").alias("n"))


def placed(rows: DataFrame, sizes: DataFrame, goals: DataFrame, p: Params = Params(), carry: tuple[str, ...] = ()) -> DataFrame:
    """Every row, as sized() gives them, with its place in its source's stream: number, bin, nth and start, in words."""
    ordered = Window.partitionBy("source", "bin").orderBy("doc_id", "tie", "size")
    across = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = sizes.groupBy("source", "bin").agg(F.sum("size").alias("words")).withColumn("bin_start", F.coalesce(F.sum("words").over(across), F.lit(0)))
    g, b = goals.alias("g"), bins.alias("b")
    b = b.join(g, F.col("b.source").eqNullSafe(F.col("g.source"))).select("b.source", "b.bin", "bin_start", "number", "source_size", "target").alias("b")
    inside = F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    d = rows.withColumn("nth", F.row_number().over(ordered).cast("long")).withColumn("inside", F.coalesce(inside, F.lit(0))).alias("d")
    return d.join(b, F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.bin") == F.col("b.bin"))).select(
        "number", "d.bin", "nth", (F.col("bin_start") + F.col("inside")).alias("start"),
        "doc_id", "d.source", "size", "source_size", "target", *[f"d.{c}" for c in carry],
    )


def pieces(stream: DataFrame, p: Params = Params()) -> DataFrame:
    """The parts of documents that lie in each block: block, low and high word in it; none for empty documents."""
    first, last = f"start div {p.block}", f"(start + size - 1) div {p.block}"
    return (
        stream.where("size > 0")
        .select("*", F.explode(F.expr(f"sequence({first}, {last})")).alias("block"))
        .withColumn("low", F.greatest(F.col("start") - F.col("block") * p.block, F.lit(0)))
        .withColumn("high", F.least(F.col("start") + F.col("size") - F.col("block") * p.block, F.lit(p.block).cast("long")))
    )


def mixed_blocks(stream: DataFrame, goals: DataFrame, p: Params = Params()) -> DataFrame:
    """The mix itself: for each shard and slot, the documents' word ranges that fill the block.

    Columns: shard, slot, pass, number, bin, nth (these three tell the document), doc_id, source,
    from_word, n_words.
    """
    parts = pieces(stream.select("number", "bin", "nth", "start", "doc_id", "source", "size"), p)
    words = F.least("high", "take") - F.col("low")
    return (
        parts.join(slots(goals, p).hint("merge"), ["number", "block"])  # slots grow with the input: never broadcast
        .where(words > 0)
        .select(
            "shard", "slot", "pass", "number", "bin", "nth", "doc_id", "source",
            (F.col("block") * p.block + F.col("low") - F.col("start")).alias("from_word"), words.alias("n_words"),
        )
    )


def mix(documents: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row: how many words of it the mix takes."""
    p = bins(documents, p)
    sizes = cut(sized(documents, p))
    goals = cut(targets(sizes, p))
    stream = placed(sizes, sizes, goals, p)
    taken = mixed_blocks(stream, goals, p).groupBy("number", "bin", "nth").agg(F.sum("n_words").alias("taken"))
    return stream.join(taken, ["number", "bin", "nth"], "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed_documents(documents: DataFrame, p: Params = Params()) -> DataFrame:
    """The mixed corpus with the columns of documents: a row for each document and pass that takes words of it.

    A pass that takes a document whole gives its text as it stands; else the taken runs of words,
    each with the white space after it, in the text's order. Documents that no pass takes go.
    """
    p = bins(documents, p)
    sizes = cut(sized(documents, p))
    goals = cut(targets(sizes, p))
    texts = placed(sized(documents, p, ("text", "lang")), sizes, goals, p, ("text", "lang"))
    ranges = (
        mixed_blocks(placed(sizes, sizes, goals, p), goals, p)
        .groupBy("number", "bin", "nth", "pass")
        .agg(F.sum("n_words").alias("words"), F.array_sort(F.collect_list(F.struct("from_word", "n_words"))).alias("ranges"))
    )
    tokens = F.split("text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    # white space before the first word is a token of its own, which goes with the first word
    lead = F.when(F.regexp_like("text", F.lit(r"^[\x20\x09-\x0D]")), 1).otherwise(0)
    partly = F.expr(
        "array_join(transform(ranges, r -> array_join(slice(tokens, cast(if(r.from_word = 0, 1, r.from_word + lead + 1) as int),"
        " cast(r.n_words + if(r.from_word = 0, lead, 0) as int)), '')), '')"
    )
    text = F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(partly)
    return (
        texts.join(ranges, ["number", "bin", "nth"])
        .withColumn("tokens", F.when(F.col("words") < F.col("size"), tokens))
        .withColumn("lead", lead)
        .select("doc_id", text.alias("text"), "lang", "source")
        .withColumn("n_chars", F.length("text").cast("long"))
    )
