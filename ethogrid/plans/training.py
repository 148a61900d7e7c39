"""Queries on training samples: suppliers stand for sequences, orders for frames, parts for objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethogrid import functions as E
from ethogrid.operators import sequences

from .registry import Tables, query


def seeded(key: str, n: str | int, salt: int = 0) -> str:
    """The SQL of functions.seeded."""
    return f"((({key}) % 4294967291 * 265443576 + {salt * 40_503 + 12_345}) % 4294967291 % {n})"


SEEN = "WITH seen AS (SELECT DISTINCT l_suppkey AS sequence, l_orderkey AS frame, l_partkey AS object FROM lineitem)\n"
FRAMES = SEEN + ", fr AS (SELECT l_suppkey AS sequence, l_orderkey AS frame, CAST(sum(l_quantity) AS BIGINT) AS pixels FROM lineitem GROUP BY ALL)\n"


def seen_of(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_suppkey").alias("sequence"), F.col("l_orderkey").alias("frame"), F.col("l_partkey").alias("object")).distinct()


def frames_of(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_suppkey").alias("sequence"), F.col("l_orderkey").alias("frame")).agg(F.sum("l_quantity").cast("long").alias("pixels"))


@query(FRAMES + f"""SELECT sequence, frame, {seeded('sequence + 1', 2, 7)} = 1 AS reversed,
    CASE WHEN {seeded('sequence + 1', 2, 7)} = 1 THEN max(frame) OVER (PARTITION BY sequence) - frame ELSE frame END AS place FROM fr""")
def reverse_sequence(t: Tables) -> DataFrame:
    """Sequences, half of them turned round."""
    return sequences.reversed_half(frames_of(t).select("sequence", "frame"))


@query(FRAMES + f""", k AS (SELECT *, {seeded('sequence * 1009 + frame + 1', 1 << 30, 3)} AS h, pixels > 60 AS good FROM fr)
    SELECT sequence, frame, good FROM k QUALIFY row_number() OVER (PARTITION BY sequence ORDER BY NOT good, CASE WHEN good THEN h ELSE -h END, frame) = 1""")
def reference_index(t: Tables) -> DataFrame:
    """A reference frame of each sequence, with enough foreground where there is one."""
    return sequences.reference_frame(frames_of(t), 60)


_TRY = "coalesce(pixels > 40, false)"
_INSIDE = "rf.frame > sp.first AND rf.frame <= sp.last"
ASSEMBLED = f"""WITH raw AS (SELECT l_suppkey AS sequence, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) - 1 AS frame, 1 + l_partkey % 6 AS object, l_quantity FROM lineitem),
    seen AS (SELECT DISTINCT sequence, frame, object FROM raw), fr AS (SELECT sequence, frame, CAST(sum(l_quantity) AS BIGINT) AS pixels FROM raw GROUP BY ALL),
    t AS (SELECT sequence, n, unnest(range(0, 5)) AS turn FROM (SELECT sequence, count(*) AS n FROM fr GROUP BY sequence)), k AS (SELECT *, sequence * 64 + turn AS key FROM t),
    g AS (SELECT *, {seeded('key + 1', 5, 1)} + 1 AS g1, {seeded('key + 1', 5, 2)} + 1 AS g2, {seeded('key + 1', 5, 3)} + 1 AS g3 FROM k),
    b AS (SELECT *, CASE WHEN n - g1 - g2 - g3 > 0 THEN {seeded('key + 1', 'greatest(n - g1 - g2 - g3, 1)', 99)} ELSE 0 END AS start FROM g),
    e AS (SELECT sequence, turn, n, unnest([0, 1, 2, 3]) AS step, unnest([start, start + g1, start + g1 + g2, start + g1 + g2 + g3]) AS i FROM b),
    c AS (SELECT sequence, turn, step, CASE WHEN n <= 1 THEN 0 WHEN i % (2 * (n - 1)) < n THEN i % (2 * (n - 1)) ELSE 2 * (n - 1) - i % (2 * (n - 1)) END AS idx FROM e),
    sp AS (SELECT sequence, turn, list(idx ORDER BY step) AS clip, max(idx) FILTER (step = 0) AS first, max(idx) FILTER (step > 0) AS last FROM c GROUP BY ALL),
    dr AS (SELECT *, turn * 64 + again AS draw, unnest(range(0, 20)) AS try FROM (SELECT *, unnest(range(0, 6)) AS again FROM t)),
    d2 AS (SELECT *, {seeded('sequence * 7919 + draw * 101 + try + 1', 'greatest(n, 1)', 11)} AS frame FROM dr),
    rf AS (SELECT sequence, turn, again, frame FROM d2 LEFT JOIN fr USING (sequence, frame) QUALIFY row_number() OVER (PARTITION BY sequence, turn, again ORDER BY NOT {_TRY}, CASE WHEN {_TRY} THEN try ELSE -try END) = 1),
    ch AS (SELECT sequence, turn, clip, rf.frame FROM rf JOIN sp USING (sequence, turn) QUALIFY row_number() OVER (PARTITION BY sequence, turn ORDER BY {_INSIDE}, CASE WHEN {_INSIDE} THEN -again ELSE again END) = 1),
    ob AS (SELECT sequence, frame, list(DISTINCT object) AS objects FROM seen GROUP BY ALL),
    al AS (SELECT c.sequence, c.turn, list(DISTINCT object) AS shown FROM c JOIN seen s ON s.sequence = c.sequence AND s.frame = c.idx GROUP BY ALL),
    ju AS (SELECT ch.*, objects, len(list_filter(coalesce(shown, []), lambda o: NOT list_contains(coalesce(objects, []), o))) = 0 AS complete FROM ch LEFT JOIN al USING (sequence, turn) LEFT JOIN ob USING (sequence, frame))
    SELECT sequence, CAST(turn AS INTEGER) AS turn, frame AS reference, array_to_string(clip, ',') AS clip, CAST(coalesce(list_max(objects), 0) AS BIGINT) AS obj_num, complete FROM ju
    QUALIFY row_number() OVER (PARTITION BY sequence ORDER BY NOT complete, CASE WHEN complete THEN turn ELSE -turn END) = 1"""

#: Rows of a partition, whatever their number in all.
ROWS = 1 << 18


@query(ASSEMBLED)
def sample_assembly(t: Tables) -> DataFrame:
    """Clips with reference frames that show all of their objects, drawn five times at most."""
    from pyspark.sql import Window

    parts = max(t.lineitem.sparkSession.sparkContext.defaultParallelism, -(-t.lineitem.count() // ROWS))
    lines = t.lineitem.select(F.col("l_suppkey").alias("sequence"), "l_orderkey", (1 + F.col("l_partkey") % 6).alias("object"), "l_quantity").repartition(parts, "sequence")
    place = F.dense_rank().over(Window.partitionBy("sequence").orderBy("l_orderkey")).cast("long") - 1
    rows = lines.select("sequence", place.alias("frame"), "object", "l_quantity")
    frames = rows.groupBy("sequence", "frame").agg(F.sum("l_quantity").cast("long").alias("pixels"))
    found = sequences.assembled(frames.groupBy("sequence").agg(F.count("*").alias("n_frames")), frames, rows.select("sequence", "frame", "object").distinct(), 3, 5, 40, parts=parts)
    return found.select("sequence", "turn", "reference", F.array_join("clip", ",").alias("clip"), "obj_num", "complete")


@query("""WITH n AS (SELECT n_name AS sequence, row_number() OVER (ORDER BY n_nationkey) - 1 AS number, count(*) OVER () AS n FROM nation)
    SELECT sequence, number, CAST(k AS INTEGER) AS turn, k * n + number AS item FROM n, (SELECT unnest(range(0, 3)) AS k)""")
def repeat_dataset(t: Tables) -> DataFrame:
    """Every sequence three times, at item numbers modulo their number."""
    return sequences.repeated(t.nation.select(F.col("n_name").alias("sequence"), F.col("n_nationkey").cast("long").alias("number")), 3)


@query("SELECT event_id AS frame, event_id // 4 AS step, event_id % 4 AS sample FROM events")
def frame_major_split(t: Tables) -> DataFrame:
    """Stacked frames by step and sample."""
    return sequences.by_step(t.events.select(F.col("event_id").alias("frame")), 4)


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag AS label, l_linestatus AS truth,
    CASE WHEN {seeded('l_orderkey + 1', 100, 5)} < 20 THEN l_linestatus ELSE l_returnflag END AS used FROM lineitem""")
def truth_mixing(t: Tables) -> DataFrame:
    """Predictions, a fifth of the samples replaced by the truth."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("sample"), "l_linenumber", "l_partkey", F.col("l_returnflag").alias("label"), F.col("l_linestatus").alias("truth"))
    return sequences.with_truth(rows).withColumnRenamed("sample", "l_orderkey")


@query(SEEN + f""", o AS (SELECT DISTINCT sequence, object FROM seen)
    SELECT sequence, object, CAST(row_number() OVER (PARTITION BY sequence ORDER BY {seeded('sequence * 1009 + object + 1', 1 << 30, 9)}, object) AS INTEGER) AS place FROM o QUALIFY place <= 3""")
def object_subset(t: Tables) -> DataFrame:
    """Three objects of each sequence, picked by a hash."""
    return sequences.some_objects(seen_of(t).select("sequence", "object").distinct(), 3)


@query("SELECT DISTINCT l_suppkey AS sequence, min(l_orderkey) OVER (PARTITION BY l_suppkey, l_partkey) AS frame FROM lineitem")
def sparse_labels(t: Tables) -> DataFrame:
    """The frames that first show an object, which have labels."""
    lists = t.lineitem.groupBy(F.col("l_suppkey").alias("sequence"), F.col("l_partkey").alias("object")).agg(F.collect_set("l_orderkey").alias("frames"))
    return sequences.sparse_frames(lists)[1]


@query("SELECT DISTINCT l_suppkey AS sequence, l_orderkey AS frame FROM lineitem")
def sparse_sequence_scan(t: Tables) -> DataFrame:
    """The frames that show an object."""
    lists = t.lineitem.groupBy(F.col("l_suppkey").alias("sequence"), F.col("l_partkey").alias("object")).agg(F.collect_set("l_orderkey").alias("frames"))
    return sequences.sparse_frames(lists)[0]


@query(f"WITH n AS (SELECT count(*) AS n FROM nation) SELECT n_nationkey, CAST((n_nationkey + 1 + {seeded('n_nationkey', 'greatest(n - 1, 1)')}) % n AS BIGINT) AS partner FROM nation, n")
def random_partner(t: Tables) -> DataFrame:
    """A partner of each sample that isn't the sample itself."""
    size = t.nation.agg(F.count("*").alias("n")).hint("broadcast")  # one row
    return t.nation.join(size).select("n_nationkey", E.partner(F.col("n_nationkey").cast("long"), F.col("n")).alias("partner"))


@query("""WITH a AS (SELECT l_suppkey AS sequence, l_partkey % 20 AS o FROM lineitem WHERE l_linenumber = 1), b AS (SELECT l_suppkey, l_partkey % 20 FROM lineitem WHERE l_linenumber = 2)
    SELECT sequence, string_agg(o, ',' ORDER BY o) AS objects FROM (SELECT DISTINCT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) AS u(sequence, o)) GROUP BY sequence""")
def object_union(t: Tables) -> DataFrame:
    """The objects of two samples together."""
    listed = lambda k: t.lineitem.where(f"l_linenumber = {k}").groupBy(F.col("l_suppkey").alias("sequence")).agg(F.collect_set(F.col("l_partkey") % 20).alias(f"o{k}"))
    none = F.array().cast("array<bigint>")
    both = F.array_union(F.coalesce("o1", none), F.coalesce("o2", none))
    return listed(1).join(listed(2), "sequence", "full").select("sequence", F.array_join(F.array_sort(both), ",").alias("objects"))


@query("SELECT p_partkey AS id, 'part' AS source, p_size AS size FROM part UNION ALL SELECT s_suppkey, 'supplier', NULL FROM supplier")
def union_datasets(t: Tables) -> DataFrame:
    """Two datasets as one, by column name."""
    a = t.part.select(F.col("p_partkey").alias("id"), F.lit("part").alias("source"), F.col("p_size").alias("size"))
    return a.unionByName(t.supplier.select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("source")), allowMissingColumns=True)


@query(f"""WITH o AS (SELECT DISTINCT l_suppkey AS sample, l_partkey % 11 AS object FROM lineitem), k AS (SELECT sample, i, row_number() OVER (PARTITION BY sample ORDER BY {seeded('(sample + 1) * 1009 + i', 1 << 30, 1)}, i) AS place
        FROM (SELECT DISTINCT sample, unnest(range(1, 11)) AS i FROM o))
    SELECT o.sample, object, CAST(coalesce(i, 0) AS BIGINT) AS shuffled FROM o LEFT JOIN k ON k.sample = o.sample AND k.place = o.object""")
def shuffled_ids(t: Tables) -> DataFrame:
    """Object ids permuted within each sample; the background stays."""
    rows = t.lineitem.select(F.col("l_suppkey").alias("sample"), (F.col("l_partkey") % 11).alias("object")).distinct()
    return rows.select("sample", "object", E.shuffled_id(F.col("sample") + 1, F.col("object"), 10).cast("long").alias("shuffled"))


@query("""WITH o AS (SELECT DISTINCT l_suppkey AS sequence, l_partkey AS object FROM lineitem), n AS (SELECT sequence, count(*) AS objects FROM o GROUP BY sequence)
    SELECT sequence, objects, CAST(ceil(objects / 10.0) AS BIGINT) AS engines, CAST(objects - 10 * (ceil(objects / 10.0) - 1) AS BIGINT) AS in_last FROM n""")
def engine_fanout(t: Tables) -> DataFrame:
    """How many engines of ten objects each sequence takes, and how full the last one is."""
    from pyspark.sql import Window

    objects = seen_of(t).select("sequence", "object").distinct()
    placed = objects.withColumn("number", F.row_number().over(Window.partitionBy("sequence").orderBy("object")))
    engine, local = E.engine_of(F.col("number"))
    by = placed.select("sequence", engine.alias("engine"), local.alias("local")).groupBy("sequence")
    return by.agg(F.count("*").alias("objects"), (F.max("engine") + 1).cast("long").alias("engines"), F.max(F.struct("engine", "local"))["local"].cast("long").alias("in_last"))


@query("SELECT l_suppkey AS sequence, round(coalesce(avg(l_tax) FILTER (l_linenumber <> 3), 0), 9) AS mean, coalesce(avg(l_tax) FILTER (l_linenumber > 90), 0) AS nothing FROM lineitem GROUP BY ALL")
def nan_mean(t: Tables) -> DataFrame:
    """Means over what is a number; 0 where nothing is."""
    x = F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).otherwise(F.col("l_tax"))
    none = F.when(F.col("l_linenumber") <= 90, F.lit(float("nan"))).otherwise(F.col("l_tax"))
    return t.lineitem.groupBy(F.col("l_suppkey").alias("sequence")).agg(F.round(E.mean_of_numbers(x), 9).alias("mean"), E.mean_of_numbers(none).alias("nothing"))


@query("WITH w AS (SELECT l_returnflag AS metric, l_suppkey % 4 AS worker, avg(l_tax) AS mean FROM lineitem GROUP BY ALL) SELECT metric, round(avg(mean), 9) AS mean FROM w GROUP BY metric")
def worker_mean(t: Tables) -> DataFrame:
    """The mean over workers of each worker's mean."""
    by = t.lineitem.groupBy(F.col("l_returnflag").alias("metric"), F.col("l_suppkey") % 4).agg(F.avg("l_tax").alias("mean"))
    return by.groupBy("metric").agg(F.round(F.avg("mean"), 9).alias("mean"))
