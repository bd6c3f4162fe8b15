"""Conversation prefix trie from burst tries.

A conversation is a row of turn ids, cut into stretches of STRETCH turns; a stretch hangs
under the head that its earlier stretches name, so no row holds a whole long conversation.
Equal stretches under one head are one suffix with a weight. All suffixes of a head start
as one container. A container of more than CONTAINER suffixes bursts: it becomes a node of
the trie head, and its suffixes are dealt anew by their next turn id (past the turns that
all of them share, which are nodes too). The containers left are bounded; each is sorted
and swept once, a stack of open nodes giving all nodes in it. Burst nodes are sums over
the containers below them.

What lies in later stretches counts in earlier ones through the smallest member: each node
belongs to it, so sums over a subtree are sums over its members, and one more sweep adds them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplake.llm.shared import arrow_shape, stored
from shoplake.operators.ordered import ordered_scan

STRETCH = 512                   # turns of a conversation in one row
CONTAINER = 512                 # suffixes swept together
ID_BYTES = 24                   # of a turn: 16 of its MD5, 8 of its text's length
JOIN_TURNS = 4096               # of one conversation that meet one row in a join
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string, turn_md5 binary, size long")
SWEPT = NODE + ", kind int, head string, prefix binary, next string"
IS_NODE, IS_PART, IS_LINK = 0, 1, 2


def turn_ids(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, id binary) of all turns, in order of turn (null first), role and text.

    Null roles and texts are empty; rows without conv_id are left out; equal rows are turns each.
    """
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    digest = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))
    size = F.lpad(F.hex(F.octet_length("text").cast("long")), 16, "0")
    return stored(ordered_scan(rows, ["conv_id"], ["turn", "role", "text"], number="pos")
                  .select("conv_id", "pos", F.unhex(F.concat(digest, size)).alias("id")), "turn-ids")


def spliced(turns: DataFrame, every: int, choices: int) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, id) of rebuilt conversations, and all conv_ids.

    Conversation c is the first h turns of conversation c - c % every, then its own turns
    after its first h; h is the CRC-32 of its decimal id modulo `choices`.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % choices
    base = F.col("conv_id") - F.col("conv_id") % every
    first = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < choices)).groupBy("conv_id") \
        .agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("first")) \
        .select(F.col("conv_id").alias("base"), "first")            # fewer than `choices` turns each
    plans = stored(turns.groupBy("conv_id").agg(F.max("pos").alias("n")).withColumn("base", base)
                   .join(first, "base", "left").select("conv_id", "n", F.coalesce(
                       F.slice("first", 1, h.cast("int")), F.array().cast("array<struct<pos:bigint,id:binary>>")).alias("first")),
                   "splice-plans")
    blocks = plans.select("conv_id", F.size("first").alias("shift"), F.explode(
        F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / JOIN_TURNS))).alias("block"))
    own = turns.where(F.col("pos") > h).withColumn("block", F.floor(F.col("pos") / JOIN_TURNS)) \
        .join(blocks, ["conv_id", "block"]).select("conv_id", (F.col("pos") - h + F.col("shift")).alias("pos"), "id")
    borrowed = plans.select("conv_id", F.explode("first").alias("turn")).select("conv_id", "turn.pos", "turn.id")
    return own.unionByName(borrowed), plans.select("conv_id")


def _stretches(turns: DataFrame, convs: DataFrame, width: int) -> DataFrame:
    """(conv_id, part, packed ids, edge, head, next): `edge` is the size of the turn before the stretch, `head` names
    the stretches before it, `next` these and itself. A conversation that ends with a full stretch has an empty one more."""
    pos, size = F.col("pos"), F.conv(F.hex(F.substring("id", 17, 8)), 16, 10).cast("long")
    turn = F.struct("pos", "id")
    none, zero = F.lit(None).cast("struct<pos:bigint,id:binary>"), F.lit(0).cast("long")

    def cell(part, turn, edge):
        return F.struct(part.alias("part"), turn.alias("turn"), edge.alias("edge"))
    own = cell(F.floor((pos - 1) / width), turn, zero)
    both = F.array(own, cell(F.floor(pos / width), none, size))        # the last turn of a stretch opens the next
    cells = turns.select("conv_id", F.explode(F.when(pos % width == 0, both).otherwise(F.array(own))).alias("cell")) \
        .select("conv_id", "cell.*").unionByName(convs.select("conv_id", zero.alias("part"), none.alias("turn"), zero.alias("edge")))
    packed = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list("turn")), lambda t: F.hex(t["id"])), ""))
    rows = stored(cells.groupBy("conv_id", "part").agg(packed.alias("packed"), F.max("edge").alias("edge")), "stretches")
    full = rows.where(F.length("packed") == width * ID_BYTES)
    if full.isEmpty():
        return rows.withColumns({"head": F.lit(""), "next": F.lit(None).cast("string")})
    # names are sums of 40-bit lanes of digests, so that a running sum gives them, however long the conversation
    whole = F.sha2(F.concat(F.encode(F.col("part").cast("string"), "UTF-8"), "packed"), 256)
    lanes = {f"lane{k}": F.conv(F.substring(whole, 1 + 10 * k, 10), 16, 10).cast("long") for k in range(4)}
    sums = ordered_scan(full.select("conv_id", "part", *[v.alias(c) for c, v in lanes.items()]), ["conv_id"], ["part"],
                        running={f"sum{k}": f"lane{k}" for k in range(4)})
    named = stored(sums.select("conv_id", "part", F.concat_ws("-", F.col("part").cast("string"),
                                                              *[f"sum{k}" for k in range(4)]).alias("next")), "stretch-names")
    before = named.select("conv_id", (F.col("part") + 1).alias("part"), F.col("next").alias("head"))
    return stored(rows.join(named, ["conv_id", "part"], "left").join(before, ["conv_id", "part"], "left")
                  .withColumn("head", F.coalesce("head", F.lit(""))), "named-stretches")


def _ends(rows: DataFrame, width: int) -> DataFrame:
    """(suffix, ends_sha256) of the conversations that end in each stretch; ids stream in order, none are gathered."""
    last = rows.where(F.length("packed") < width * ID_BYTES).select(_suffix().alias("suffix"), "conv_id")

    def run(batches):
        key, digest = None, None
        for batch in batches:
            keys = batch.column(0).to_pylist()
            ids = batch.column(1).cast(pa.string()).to_pylist()
            done: list[tuple[bytes, str]] = []
            begin = 0
            for i in range(1, len(keys) + 1):
                if i < len(keys) and keys[i] == keys[begin]:
                    continue
                if keys[begin] != key:
                    if digest:
                        done.append((key, digest.hexdigest()))
                    key, digest = keys[begin], hashlib.sha256()
                    digest.update(",".join(ids[begin:i]).encode())
                else:
                    digest.update(("," + ",".join(ids[begin:i])).encode())
                begin = i
            if done:
                yield pa.RecordBatch.from_pydict({"suffix": [d[0] for d in done], "ends_sha256": [d[1] for d in done]})
        if digest:
            yield pa.RecordBatch.from_pydict({"suffix": [key], "ends_sha256": [digest.hexdigest()]})
    return last.repartition("suffix").sortWithinPartitions("suffix", "conv_id") \
        .mapInArrow(run, "suffix binary, ends_sha256 string")


def _suffix():
    return F.unhex(F.sha2(F.concat(F.encode("head", "UTF-8"), F.lit(b"/"), "packed"), 256))


def _jumps(over: DataFrame) -> DataFrame:
    """Oversized containers (head, depth, prefix, low, high) with the depth `onward` of the containers they burst into."""
    def run(batches):
        for batch in batches:
            low, high = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            onward = [_shared(a, b, 0) + 1 for a, b in zip(low, high, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(onward, pa.int32())],
                                             names=["head", "depth", "prefix", "onward"])
    return over.mapInArrow(run, "head string, depth int, prefix binary, onward int")


def _shared(a: bytes, b: bytes, start: int) -> int:
    """Number of turns at the begin that two suffixes share, at least `start`."""
    n = start
    most = min(len(a), len(b)) // ID_BYTES
    while n < most and a[n * ID_BYTES:(n + 1) * ID_BYTES] == b[n * ID_BYTES:(n + 1) * ID_BYTES]:
        n += 1
    return n


def _burst(items: DataFrame, container: int) -> DataFrame:
    """`items` with the depth of their containers; those that end at a burst node have its depth and `spent`."""
    prefix = F.substring(F.col("packed"), F.lit(1), F.col("depth") * ID_BYTES)
    waiting = items.withColumn("depth", F.lit(0))
    settled = []
    while True:
        over = stored(waiting.groupBy("head", "depth", prefix.alias("prefix"))
                      .agg(F.count(F.lit(1)).alias("n"), F.min("packed").alias("low"), F.max("packed").alias("high"))
                      .where(F.col("n") > container).select("head", "depth", "prefix", "low", "high"), "oversized")
        if over.isEmpty():
            settled.append(waiting.withColumn("spent", F.lit(False)))
            break
        dealt = waiting.withColumn("prefix", prefix).join(_jumps(over), ["head", "depth", "prefix"], "left").drop("prefix")
        size = F.floor(F.length("packed") / ID_BYTES).cast("int")
        dealt = stored(dealt.withColumn("spent", F.coalesce(size < F.col("onward"), F.lit(False)))
                       .withColumn("depth", F.least(size, F.coalesce("onward", "depth"))), "dealt")
        settled.append(dealt.where(F.col("onward").isNull() | F.col("spent")).drop("onward"))
        waiting = dealt.where(F.col("onward").isNotNull() & ~F.col("spent")).drop("onward", "spent")
    out = settled[0]
    for other in settled[1:]:
        out = out.unionByName(other)
    return out


@dataclass(slots=True)
class _Open:
    """A node on the sweep's stack; `rows` are the places of its children's rows, which wait for its smallest member."""
    depth: int
    turn: bytes
    size: int
    n: int = 0
    least: int = 1 << 63
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: str = NOTHING
    rows: list[int] = field(default_factory=list)


class _Sweep:
    """Nodes of one container (its suffixes sorted), as rows of SWEPT."""

    def __init__(self, head: str, part: int, depth: int, edge: int, width: int):
        self.head, self.base, self.start, self.width, self.edge = head, part * width, depth, width, edge
        self.rows: list[list] = []
        self.stack: list[_Open] = []
        self.before = b""

    def add(self, packed: bytes, n: int, least: int, leaves: int, saved: int, ends: str | None, follows: str | None) -> None:
        size = len(packed) // ID_BYTES
        if self.stack:
            keep = _shared(packed, self.before, self.start)
            while self.stack[-1].depth > keep:
                self._close()
        for d in range(self.stack[-1].depth + 1 if self.stack else self.start, size + 1):
            turn = packed[(d - 1) * ID_BYTES:d * ID_BYTES] if d else b""
            self.stack.append(_Open(d, turn[:16], int.from_bytes(turn[16:]) if d else self.edge))
        self.before = packed
        top = self.stack[-1]
        top.n += n
        top.least = min(top.least, least)
        if size == self.width:              # goes on in the next stretch
            top.leaves, top.saved = leaves, saved
            self._row(top, IS_LINK, follows)
        else:
            top.ends = ends

    def _row(self, node: _Open, kind: int, follows: str | None = None, prefix: bytes | None = None) -> None:
        row = [node.least, self.base + node.depth, None, node.n, node.children, node.leaves, node.saved, node.ends,
               node.turn, node.size, kind, self.head, prefix, follows]
        self.rows.append(row)
        if len(self.stack) > 1:
            self.stack[-2].rows.append(len(self.rows) - 1)
        elif self.start:                    # its parent is a burst node
            row[12] = self.before[:(self.start - 1) * ID_BYTES]

    def _close(self) -> _Open:
        node = self.stack[-1]
        for at in node.rows:
            self.rows[at][2] = node.least
        if node.depth < self.width:
            node.leaves += not node.children
            node.saved += (node.n - 1) * node.size
            self._row(node, IS_NODE)
        self.stack.pop()
        if self.stack:
            up = self.stack[-1]
            up.n += node.n
            up.least = min(up.least, node.least)
            up.children += 1
            up.leaves += node.leaves
            up.saved += node.saved
        return node

    def finish(self) -> list[list]:
        while len(self.stack) > 1:
            self._close()
        top = self._close()
        for d in range(self.start):         # its share in each burst node above
            turn = self.before[(d - 1) * ID_BYTES:d * ID_BYTES] if d else b""
            self.rows.append([top.least, self.base + d, None, top.n, int(d == self.start - 1), top.leaves, top.saved, NOTHING,
                              turn[:16], int.from_bytes(turn[16:]) if d else self.edge, IS_PART, self.head,
                              self.before[:d * ID_BYTES], None])
        return self.rows

    def spent(self, packed: bytes, n: int, least: int, ends: str) -> list[list]:
        """Shares of conversations that end at a burst node."""
        out = []
        for d in range(self.start + 1):
            turn = packed[(d - 1) * ID_BYTES:d * ID_BYTES] if d else b""
            out.append([least, self.base + d, None, n, 0, 0, 0, ends if d == self.start else NOTHING, turn[:16],
                        int.from_bytes(turn[16:]) if d else self.edge, IS_PART, self.head, packed[:d * ID_BYTES], None])
        return out


def _swept(items: DataFrame, width: int) -> DataFrame:
    """Rows of SWEPT: nodes, shares in burst nodes and links to later stretches of all containers."""
    names = [f.split()[0] for f in SWEPT.split(", ")]
    shape = arrow_shape(SWEPT)
    wanted = ["head", "depth", "prefix", "spent", "packed", "part", "edge", "n", "least", "leaves", "saved", "ends_sha256", "next"]

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), schema=shape)

    def run(batches) -> Iterator[pa.RecordBatch]:
        key, sweep, out = None, None, []
        for batch in batches:
            for head, depth, prefix, spent, packed, part, edge, n, least, leaves, saved, ends, follows in zip(
                    *[batch.column(i).to_pylist() for i in range(len(wanted))], strict=True):
                if spent:
                    out += _Sweep(head, part, depth, edge, width).spent(packed, n, least, ends)
                else:
                    if key != (head, depth, prefix):
                        if sweep:
                            out += sweep.finish()
                        key, sweep = (head, depth, prefix), _Sweep(head, part, depth, edge, width)
                    sweep.add(packed, n, least, leaves, saved, ends, follows)
                if len(out) > 4096:
                    yield batch_of(out)
                    out = []
        if sweep:
            out += sweep.finish()
        if out:
            yield batch_of(out)
    rows = items.withColumn("prefix", F.substring(F.col("packed"), F.lit(1), F.col("depth") * ID_BYTES)).select(*wanted)
    return rows.repartition("head", "depth", "prefix").sortWithinPartitions("spent", "head", "depth", "prefix", "packed") \
        .mapInArrow(run, SWEPT)


def _nodes(swept: DataFrame) -> DataFrame:
    """All nodes (columns of NODE): those of containers, and burst nodes from their shares; parents found."""
    parts = swept.where(F.col("kind") == IS_PART)
    links = swept.where((F.col("kind") == IS_LINK)).select(F.col("next").alias("head"), "parent_conv_id",
                                                           F.col("head").alias("from_head"), "prefix")
    inner = swept.where(F.col("kind") == IS_NODE)
    shares = parts.groupBy("head", "prefix").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_tokens"), F.max(F.when(F.col("ends_sha256") != NOTHING, F.col("ends_sha256")))
        .alias("ends_sha256"), F.max("turn_md5").alias("turn_md5"), F.max("size").alias("size"))
    shares = stored(shares, "burst-shares")
    if shares.isEmpty():
        found = inner
    else:
        # a burst node adds to itself and the burst nodes above it, and is a child of the next
        level = F.floor(F.length("prefix") / ID_BYTES).cast("int")
        above = shares.select("head", "prefix", ((F.col("n_convs") - 1) * F.col("size")).alias("saved"), level.alias("level"),
                              F.explode(F.sequence(F.lit(0), level)).alias("at")) \
            .select("head", F.substring(F.col("prefix"), F.lit(1), F.col("at") * ID_BYTES).alias("prefix"), "saved",
                    (F.col("at") == F.col("level") - 1).cast("long").alias("child")) \
            .groupBy("head", "prefix").agg(F.sum("saved").alias("saved"), F.sum("child").alias("child"))
        burst = stored(shares.join(above, ["head", "prefix"]).select(
            "head", "prefix", "conv_id", "depth", "n_convs", (F.col("n_children") + F.col("child")).alias("n_children"),
            "n_leaves", (F.col("saved_tokens") + F.col("saved")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"), "turn_md5", "size"), "burst-nodes")
        up = burst.select("head", F.col("prefix").alias("up"), F.col("conv_id").alias("up_conv"))
        parents = F.coalesce("parent_conv_id", "up_conv")
        inner = inner.withColumnRenamed("prefix", "up").join(up, ["head", "up"], "left").withColumn("parent_conv_id", parents)
        rise = F.when(level > 0, F.substring(F.col("prefix"), F.lit(1), (level - 1) * ID_BYTES))
        tops = burst.withColumn("up", rise).join(up, ["head", "up"], "left").withColumn("parent_conv_id", F.col("up_conv"))
        links = links.withColumnsRenamed({"prefix": "up", "head": "to"}).withColumnRenamed("from_head", "head") \
            .join(up, ["head", "up"], "left").select(F.col("to").alias("head"), parents.alias("parent_conv_id"))
        columns = ["head", *[f.split()[0] for f in NODE.split(", ")]]
        found = inner.select(*columns).unionByName(tops.select(*columns))
    # the first node of a later stretch hangs on the last of the one before
    links = links.groupBy("head").agg(F.min("parent_conv_id").alias("linked"))
    return found.join(links, "head", "left").select(*[
        F.coalesce("parent_conv_id", "linked").alias(c) if c == "parent_conv_id" else F.col(c)
        for c in (f.split()[0] for f in NODE.split(", "))])


def trie_nodes(turns: DataFrame, convs: DataFrame, stretch: int = STRETCH, container: int = CONTAINER) -> DataFrame:
    """One row per distinct prefix of the conversations (conv_id, pos from 1, id as of `turn_ids`), the empty one included.

    (conv_id: smallest member; depth; parent_conv_id: the parent's; n_convs: members; n_children;
    n_leaves, saved_tokens: sums over the subtree; ends_sha256: digest of the ids that end here,
    ascending, joined by commas; turn_md5 and size: of the last turn). `convs` lists all
    conv_ids, once each, those without turns included; none give no rows. Conversations may be of any length.
    """
    rows = _stretches(turns, convs, stretch)
    ends = stored(_ends(rows, stretch), "trie-ends")

    def sweep(extra: DataFrame | None) -> DataFrame:
        weighed = rows.withColumns({"leaves": F.lit(0).cast("long"), "saved": F.lit(0).cast("long")}) if extra is None \
            else rows.join(extra, ["conv_id", "part"], "left")
        items = weighed.groupBy("head", "packed").agg(
            F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.max("part").alias("part"), F.max("edge").alias("edge"),
            F.max("next").alias("next"), F.coalesce(F.sum("leaves"), F.lit(0)).alias("leaves"),
            F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"))
        items = stored(items.withColumn("suffix", _suffix()).join(ends, "suffix", "left").drop("suffix"), "suffixes")
        return stored(_nodes(stored(_swept(_burst(items, container), stretch), "swept")), "trie-nodes")
    nodes = sweep(None)
    later = rows.where(F.col("part") > 0)
    if later.isEmpty():
        return nodes
    # what each conversation is the smallest member of in later stretches, summed from its end
    own = nodes.where(F.col("depth") >= stretch).groupBy("conv_id", F.floor(F.col("depth") / stretch).alias("part")).agg(
        F.sum(((F.col("n_convs") - 1) * F.col("size"))).alias("_saved"), F.sum((F.col("n_children") == 0).cast("long")).alias("_leaves"))
    from_end = later.select("conv_id", "part").join(own, ["conv_id", "part"], "left").select(
        "conv_id", (-F.col("part")).alias("_back"), F.coalesce("_saved", F.lit(0)).alias("_saved"),
        F.coalesce("_leaves", F.lit(0)).alias("_leaves"))
    sums = ordered_scan(from_end, ["conv_id"], ["_back"], running={"saved": "_saved", "leaves": "_leaves"})
    return sweep(stored(sums.select("conv_id", (-F.col("_back") - 1).alias("part"), "saved", "leaves"), "later-stretches"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """`trie_nodes` of conversations (conv_id, turn, role, text) as they are; other columns are ignored."""
    turns = turn_ids(conversations)
    return trie_nodes(turns, turns.select("conv_id").distinct())


TRIE_SQL = """
WITH RECURSIVE t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
         PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
       FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id FROM t),
h AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(flatten([[4294967295], flatten(
         list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: [ascii(d), -1, -1, -1, -1, -1, -1, -1, -1]))]),
         lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 9 AS h FROM c),
n AS (SELECT h.*, (SELECT count(*) FROM t WHERE t.conv_id = h.base AND pos <= h) AS got FROM h),
r AS (SELECT n.conv_id, pos, role, text FROM n JOIN t ON t.conv_id = base AND pos <= h
      UNION ALL SELECT n.conv_id, pos - h + got, role, text FROM n JOIN t ON t.conv_id = n.conv_id AND pos > h),
p AS (SELECT conv_id, CAST(0 AS BIGINT) AS depth, '' AS key, CAST(0 AS BIGINT) AS size FROM c
      UNION ALL SELECT r.conv_id, pos, md5(key || sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text)), strlen(text)
      FROM p JOIN r ON r.conv_id = p.conv_id AND r.pos = p.depth + 1),
v AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size FROM p GROUP BY key, depth),
e AS (SELECT key, depth, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ends
      FROM (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS last FROM p) WHERE depth = last GROUP BY key, depth),
u AS (SELECT v.*, q.key AS up FROM v LEFT JOIN p q ON q.conv_id = v.conv_id AND q.depth = v.depth - 1),
k AS (SELECT up AS key, depth - 1 AS depth, count(*) AS n_children FROM u WHERE depth > 0 GROUP BY ALL),
s AS (SELECT q.key, q.depth, sum((v.n_convs - 1) * v.size) AS saved_tokens, sum(CASE WHEN k.key IS NULL THEN 1 ELSE 0 END) AS n_leaves
      FROM v LEFT JOIN k ON k.key = v.key AND k.depth = v.depth JOIN p q ON q.conv_id = v.conv_id AND q.depth <= v.depth
      GROUP BY q.key, q.depth)
SELECT u.conv_id, u.depth, w.conv_id AS parent_conv_id, u.n_convs, coalesce(k.n_children, 0) AS n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(e.ends, '')) AS ends_sha256
FROM u JOIN s ON s.key = u.key AND s.depth = u.depth LEFT JOIN v w ON w.key = u.up AND w.depth = u.depth - 1
LEFT JOIN k ON k.key = u.key AND k.depth = u.depth LEFT JOIN e ON e.key = u.key AND e.depth = u.depth
"""
