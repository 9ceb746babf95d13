"""Prefix trie of conversations with subtree totals by parallel tree contraction.

Sequences of turns become nodes of a trie: a node is a distinct sequence of the first d
turns, found as a chained SHA-256 of the turns' own digests, so texts are read once and never
shuffled. Turns are numbered over ranges of one total order and chained in segments of
`SEGMENT` turns, whose ends alone are chained again, so a conversation may be long.

Subtree totals come from rounds over the table of nodes that are still there:

* Rake: nodes without children are final and give their totals to their parents.
* Compress: of a chain of nodes with one child each, a set without neighbours is spliced
  out. A node is taken if its depth has the round's bit set and its parent is not taken by
  the same rule; every two depths differ in some bit. Its child is hung on its parent and
  keeps what is passed over in between, and a record (node, child, difference) is kept.

Both shrink the tree by a share a round, stars and chains alike. Records are then expanded
from the last round to the first: a spliced node's total is its child's plus the difference.
Every record is joined once to find in which round its child went, and once to that round.

No group is collected: children are summed and counted before the shuffle, the ids that end
at a node are packed into texts of at most `PACKED` ids by ranges of ids, and a node's hash
reads its packs as a stream.

Defined cases: null roles and texts are empty; null turns come first; rows of one turn are in
the order of their digests, repeated rows are turns of their own; rows without a conversation
id belong to none and are left out; an empty table gives no nodes; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnlake.llm.common import map_batches, table
from vulnlake.operators.ordered import with_running
from vulnlake.session import brief_shuffles, scratch_path, write_out

#: Conversations of one family share the beginning of the first, so many turns at most.
FAMILY, SHARED = 100, 5
SEGMENT = 256
PACKED = 4096


def turns_of(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, n, mark, chars): digests of turns, numbered over all conversations in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    size = F.octet_length(role).cast("string")
    mark = F.unhex(F.sha2(F.concat(size, F.lit(":"), role, text).cast("binary"), 256))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), "turn", mark.alias("mark"), F.length(text).cast("long").alias("chars")
    )
    numbered = with_running(turns, ["conv_id", "turn", "mark"], sums={"n": F.lit(1).cast("long")})
    return numbered.select("conv_id", "n", "mark", "chars")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations (conv_id, depth, mark, chars) and their sizes (conv_id, turns).

    Conversation c begins with the first h turns of conversation c - c % `FAMILY`, h being
    crc32(c) % (`SHARED` + 1), and goes on with its own turns after its first h.
    """
    turns = write_out(turns_of(conversations), "turns")
    counts = turns.groupBy("conv_id").agg(F.min("n").alias("low"), F.count("*").alias("had"))
    counts = write_out(counts, "conversations")
    asked = counts.select(
        "*",
        F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(SHARED + 1)).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"),
    )
    bases = counts.select(F.col("conv_id").alias("base"), F.col("had").alias("base_had"))
    plan = asked.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_had", F.lit(0))))
    plan = write_out(plan, "plan")
    placed = turns.join(plan.select("conv_id", "low", "h", "taken"), "conv_id")
    place = F.col("n") - F.col("low")
    own = placed.where(place >= F.col("h")).select(
        "conv_id", (F.col("taken") + place - F.col("h") + 1).alias("depth"), "mark", "chars"
    )
    head = placed.where(place < SHARED).select(F.col("conv_id").alias("base"), place.alias("place"), "mark", "chars")
    head = head.join(plan.where("taken > 0").select("conv_id", "base", "taken"), "base").where("place < taken")
    head = head.select("conv_id", (F.col("place") + 1).alias("depth"), "mark", "chars")
    sizes = plan.select("conv_id", (F.col("taken") + F.greatest(F.col("had") - F.col("h"), F.lit(0))).alias("turns"))
    return head.unionByName(own), sizes


def chained(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, depth, chars, node, parent): digests of the first `depth` turns and of those before."""
    number = F.floor((F.col("depth") - 1) / SEGMENT).cast("long")
    dealt = rows.withColumn("segment", number).repartition("conv_id", "segment").sortWithinPartitions("conv_id", "depth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, link = None, b""
        for batch in batches:
            before, links = [], []
            marks = zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "mark")))
            for conv_id, segment, mark in marks:
                first = (conv_id, segment) != now
                before.append(None if first else link)
                link = hashlib.sha256((b"" if first else link) + mark).digest()
                links.append(link)
                now = conv_id, segment
            columns = [batch.column(c) for c in ("conv_id", "segment", "depth", "chars")]
            columns += [pa.array(links, pa.binary()), pa.array(before, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "segment", "depth", "chars", "link", "before"])

    schema = "conv_id long, segment long, depth long, chars long, link binary, before binary"
    links = write_out(map_batches(dealt.select("conv_id", "segment", "depth", "chars", "mark"), run, schema), "links")
    ends = links.where(F.col("depth") % SEGMENT == 0).select("conv_id", "segment", "link")

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, node = None, b""
        for batch in batches:
            nodes = []
            for conv_id, link in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                node = hashlib.sha256((node if conv_id == now else b"") + link).digest()
                nodes.append(node)
                now = conv_id
            following = [x + 1 for x in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array(following, pa.int64()), pa.array(nodes, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "segment", "start"])

    ends = ends.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    begun = write_out(map_batches(ends, starts, "conv_id long, segment long, start binary"), "segments")
    start = F.coalesce("start", F.lit(b""))
    node = F.unhex(F.sha2(F.concat(start, F.col("link")), 256))
    parent = F.when(F.col("before").isNull(), start).otherwise(F.unhex(F.sha2(F.concat(start, F.col("before")), 256)))
    return links.join(begun, ["conv_id", "segment"], "left").select(
        "conv_id", "depth", "chars", node.alias("node"), parent.alias("parent")
    )


def trie(rows: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, parent, conv_id, depth, n_convs, chars) and ends (node, conv_id)."""
    links = write_out(chained(rows).join(sizes, "conv_id"), "prefixes")
    root = F.lit(b"")
    inner = links.groupBy("node").agg(
        F.min("parent").alias("parent"),
        F.min("conv_id").alias("conv_id"),
        F.min("depth").alias("depth"),
        F.count("*").alias("n_convs"),
        F.min("chars").alias("chars"),
    )
    top = sizes.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        root.alias("node"),
        F.lit(None).cast("binary").alias("parent"),
        "conv_id",
        F.lit(0).cast("long").alias("depth"),
        "n_convs",
        F.lit(0).cast("long").alias("chars"),
    )
    ends = links.where("depth = turns").select("node", "conv_id")
    ends = ends.unionByName(sizes.where("turns = 0").select(root.alias("node"), "conv_id"))
    return write_out(top.unionByName(inner), "nodes"), write_out(ends, "ends")


def _add(rows: DataFrame, root: str, part: int) -> DataFrame:
    """Write one part of a table and read it back."""
    path = f"{root}/part={part}"
    with brief_shuffles(rows.sparkSession):
        rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _parts(like: DataFrame, root: str) -> DataFrame:
    """All parts of a table in one scan, however many there are; `part` is the number of each."""
    schema = T.StructType([*like.schema.fields, T.StructField("part", T.IntegerType())])
    return like.sparkSession.read.schema(schema).parquet(root)


def subtree_totals(nodes: DataFrame, values: list[str]) -> DataFrame:
    """Sums of `values` over the subtree of every node: (node, *values).

    `nodes` has node, parent (null at the root), depth and the values of each node itself.
    Every round reads one part of a table and writes the next one.
    """
    root = scratch_path(nodes.sparkSession, "rounds")
    kids = nodes.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
    # `passed_*` is what a node's parent gets besides the node's own total.
    first = nodes.join(kids, "node", "left").select(
        "node", "parent", "depth", F.coalesce("kids", F.lit(0)).alias("kids"), *values,
        *(F.lit(0).cast("long").alias(f"passed_{v}") for v in values),
        F.lit(None).cast("binary").alias("over"),
        *(F.lit(None).cast("long").alias(f"more_{v}") for v in values),
    )
    live, rounds = _add(first, root, 0), 0
    deepest = nodes.agg(F.max("depth")).first()[0]
    bits = max(int(deepest or 0).bit_length(), 1)
    while not live.isEmpty():
        leaf, stays = F.col("kids") == 0, F.col("kids") > 0
        below = live.groupBy(F.col("parent").alias("node")).agg(
            *(F.coalesce(F.sum(F.when(leaf, F.col(v) + F.col(f"passed_{v}"))), F.lit(0)).alias(f"below_{v}") for v in values),
            F.count_if(stays).alias("left"),
            F.max(F.when(stays, F.col("node"))).alias("child"),
        )
        inner = live.where(stays).join(below, "node").select(
            "node", "parent", "depth", F.col("left").alias("kids"), "child",
            *((F.col(v) + F.col(f"below_{v}")).alias(v) for v in values),
            *(f"passed_{v}" for v in values),
        )
        inner = write_out(inner, "inner")
        bit = F.shiftright("depth", rounds % bits) % 2 == 1
        taken = inner.where((F.col("kids") == 1) & F.col("parent").isNotNull() & bit)
        out = taken.join(taken.select(F.col("child").alias("node")), "node", "left_anti")
        out = write_out(
            out.select(
                F.col("node").alias("over"), F.col("parent").alias("above"), F.col("child").alias("node"),
                *(F.col(v).alias(f"own_{v}") for v in values),
                *(F.col(f"passed_{v}").alias(f"own_passed_{v}") for v in values),
            ),
            "spliced",
        )
        hung = inner.join(out, "node", "left").join(out.select(F.col("over").alias("node")), "node", "left_anti")
        hung = hung.select(
            "node",
            F.when(F.col("over").isNull(), F.col("parent")).otherwise(F.col("above")).alias("parent"),
            "depth", "kids", *values,
            *(
                (F.col(f"passed_{v}") + F.coalesce(F.col(f"own_{v}") + F.col(f"own_passed_{v}"), F.lit(0))).alias(f"passed_{v}")
                for v in values
            ),
            "over",
            # The spliced node's total is this node's total plus its own and what this one passes on.
            *((F.col(f"own_{v}") + F.col(f"passed_{v}")).alias(f"more_{v}") for v in values),
        )
        rounds += 1
        live = _add(hung, root, rounds)
    return _expanded(_parts(live, root), rounds, values)


def _expanded(hung: DataFrame, rounds: int, values: list[str]) -> DataFrame:
    """Totals of all nodes, last round first, from the parts that the rounds began with.

    Nodes without children in a part were raked in the round of its number; nodes it names as
    `over` were spliced in the round before.
    """
    raked = hung.where("kids = 0")
    spliced = hung.where("over IS NOT NULL").withColumn("gone", F.col("part") - 1)
    went = raked.select("node", F.col("part").alias("round")).unionByName(
        spliced.select(F.col("over").alias("node"), F.col("gone").alias("round"))
    )
    totals = raked.select("node", *values)
    records = spliced.select("over", "node", "gone", *(f"more_{v}" for v in values))
    records = write_out(records.join(went, "node"), "records")
    if records.isEmpty():
        return totals
    root, solved = scratch_path(hung.sparkSession, "solved"), None
    for k in reversed(range(1, rounds)):
        # Nodes that went in this round: raked ones, and spliced ones whose child went later.
        known = raked.where(F.col("part") == k).select("node", *values)
        if solved is not None:
            known = known.unionByName(_parts(solved, root).where(F.col("gone") == k).select("node", *values))
        more = records.where(F.col("round") == k).join(known, "node")
        more = more.select(F.col("over").alias("node"), "gone", *((F.col(v) + F.col(f"more_{v}")).alias(v) for v in values))
        solved = _add(more, root, k)
    return totals.unionByName(_parts(solved, root).select("node", *values))


def ends_hashes(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): hash of the decimal ids that end at each node, ascending and comma-joined."""
    dealt = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    packs = [("node", pa.binary()), ("first", pa.int64()), ("ids", pa.string())]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[bytes, int, list[str]]] = []
            for node, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not rows or rows[-1][0] != node or len(rows[-1][2]) == PACKED:
                    rows.append((node, conv_id, []))
                rows[-1][2].append(str(conv_id))
            columns = zip(*((node, first, ",".join(ids)) for node, first, ids in rows))
            arrays = [pa.array(c, t) for c, (_, t) in zip(columns, packs)]
            yield pa.RecordBatch.from_arrays(arrays, [n for n, _ in packs])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running = None, None
        for batch in batches:
            done = []
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if node != now:
                    if running is not None:
                        done.append((now, running.hexdigest()))
                    now, running = node, hashlib.sha256(ids.encode())
                else:
                    running.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.binary(), pa.string()))], ["node", "ends_sha256"])
        if running is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([running.hexdigest()])], ["node", "ends_sha256"])

    packed = write_out(map_batches(dealt.select("node", "conv_id"), pack, "node binary, first long, ids string"), "packs")
    packed = packed.repartition("node").sortWithinPartitions("node", "first")
    return map_batches(packed, digest, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations."""
    nodes, ends = trie(*rebuilt(conversations))
    kids = nodes.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    counted = nodes.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    counted = write_out(counted, "counted")
    own = counted.select(
        "node", "parent", "depth",
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
    )
    totals = subtree_totals(own, ["n_leaves", "saved_tokens"])
    above = counted.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        counted.join(totals, "node")
        .join(ends_hashes(ends), "node", "left")
        .join(above, "parent", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
        )
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: crc32 by bits, then nodes as lists of turn digests; subtrees by way of each node's smallest member.
ORACLE = """
WITH turns AS (
  SELECT conv_id, length(text) AS chars, mark,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, mark) AS place
  FROM (SELECT conv_id, turn, coalesce(text, '') AS text,
               sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS mark
        FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
  SELECT conv_id, count(*) AS had, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
             lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))),
             4294967295::BIGINT) % 6 AS h
  FROM turns GROUP BY conv_id
), plan AS (
  SELECT c.*, least(h, coalesce(b.had, 0)) AS taken FROM convs c LEFT JOIN (SELECT conv_id AS base, had FROM convs) b USING (base)
), rebuilt AS (
  SELECT p.conv_id, place AS depth, mark, chars FROM plan p JOIN turns t ON t.conv_id = p.base AND place <= taken
  UNION ALL
  SELECT conv_id, taken + place - h, mark, chars FROM plan JOIN turns USING (conv_id) WHERE place > h
), prefixes AS (
  SELECT conv_id, depth, chars, string_agg(mark, ',') OVER (PARTITION BY conv_id ORDER BY depth) AS node FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM plan
), nodes AS (
  SELECT node, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, (count(*) - 1) * min(chars) AS saved
  FROM prefixes GROUP BY node
), parents AS (
  SELECT c.node, p.node AS parent, p.conv_id AS parent_conv_id
  FROM nodes c JOIN prefixes x ON x.conv_id = c.conv_id AND x.depth = c.depth - 1 JOIN nodes p ON p.node = x.node
), children AS (
  SELECT parent AS node, count(*) AS n_children FROM parents GROUP BY parent
), totals AS (
  SELECT x.node, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, sum(saved) AS saved_tokens
  FROM nodes d LEFT JOIN children USING (node) JOIN prefixes x ON x.conv_id = d.conv_id AND x.depth <= d.depth
  GROUP BY x.node
), ends AS (
  SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS hash
  FROM (SELECT conv_id, max_by(node, depth) AS node FROM prefixes GROUP BY conv_id) GROUP BY node
)
SELECT n.conv_id, n.depth::BIGINT AS depth, parent_conv_id, n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
       n_leaves, saved_tokens::BIGINT AS saved_tokens, coalesce(hash, sha256('')) AS ends_sha256
FROM nodes n LEFT JOIN parents USING (node) LEFT JOIN children USING (node) JOIN totals USING (node) LEFT JOIN ends USING (node)
"""
