"""Reply trees formatted as conversations, and read back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spill, text_of

#: The template: a turn is HEAD role MID text TAIL. CONTROL is what a backslash escapes inside a text.
HEAD, MID, TAIL = "### ", ":\n", "\n</turn>\n"
CONTROL = r"\\|###|</turn>"
ROLE_CONTROL = rf"{CONTROL}|:|\n"
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:|\n)")
_TURN_END = re.compile(r"\\(?:\\|###|</turn>)|(\n</turn>\n)")
_HEAD = re.compile(r"### ((?:[^\\:]|\\[\s\S])*):\n")


def escaped(text: Column, control: str = CONTROL) -> Column:
    """text with a backslash before each control string; undone by dropping those backslashes from the left."""
    return F.regexp_replace(text, f"({control})", r"\\$1")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def reply_paths(nodes: DataFrame, keep: int = 1, assistant: str = "assistant") -> DataFrame:
    """Root-to-leaf paths of reply trees: (tree, leaf, score, rank, pos, role, text), a row per turn of a chosen path.

    nodes: (tree, node, parent, score, role, text). A self-join doubles each node's reach towards its root until all
    roots are met, after a number of rounds logarithmic in the depth, and adds up scores on the way; branches (leaves)
    are ranked in their tree by that sum, ties by the smaller leaf, and ``keep`` of each tree are chosen (None: all).
    The same steps from the longest to the shortest then enumerate the ancestors of the chosen leaves. A parent that
    the tree does not hold makes a root. Nodes on a cycle and below have no root and no path. Rows that repeat a node
    of a tree stand for one turn, the first by role and text. Null scores count as 0; null trees are one tree.
    """
    first = Window.partitionBy("tree", "node").orderBy("role", "text")
    nodes = nodes.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    nodes = spill(nodes.filter("node IS NOT NULL").withColumn("score", F.coalesce("score", F.lit(0.0)).cast("double")))
    same = lambda a, b: a["tree"].eqNullSafe(b["tree"])
    up = nodes.select("tree", F.col("node").alias("up"))
    reach = nodes.select("tree", "node", F.col("parent").alias("to"), F.lit(1).cast("long").alias("hops"), "score")
    reach = reach.join(up, same(reach, up) & (reach["to"] == up["up"]), "left").select(reach["tree"], "node", F.col("up").alias("to"), "hops", "score")
    columns = ["tree", "node", "to", "hops", "score"]
    steps, rooted, open_before = [], None, None
    while True:  # only nodes that have not met their root go on, by a step to any node, whose reach is theirs too
        reach = spill(reach.select(columns))
        met = reach.filter("to IS NULL")
        rooted = met if rooted is None else rooted.unionByName(met)
        going = reach.filter("to IS NOT NULL")
        steps.append(going)
        still = going.count()
        if still == 0 or still == open_before:
            break
        open_before = still
        far = rooted.unionByName(going).select(*[F.col(c).alias(f"_{c}") for c in columns])
        both = going.join(far, going["tree"].eqNullSafe(far["_tree"]) & (going["to"] == far["_node"]))
        reach = both.select("tree", "node", F.col("_to").alias("to"), (F.col("hops") + F.col("_hops")).alias("hops"), (F.col("score") + F.col("_score")).alias("score"))
    parents = steps[0].select("tree", F.col("to").alias("up")).distinct()
    leaves = rooted.join(parents, same(rooted, parents) & (rooted["node"] == parents["up"]), "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc("score"), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order).cast("long"))
    if keep is not None:
        chosen = chosen.filter(F.col("rank") <= keep)
    chosen = chosen.select("tree", F.col("node").alias("leaf"), "score", "rank", F.col("hops").alias("turns"))
    found = chosen.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("back"))
    for k in range(len(steps) - 1, -1, -1):
        step = steps[k].select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "to")
        further = found.join(step, found["tree"].eqNullSafe(step["_t"]) & (found["node"] == step["_n"]))
        found = spill(found.unionByName(further.select("tree", "leaf", F.col("to").alias("node"), (F.col("back") + 2**k).alias("back"))))
    out = found.join(nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "role", "text"), found["tree"].eqNullSafe(F.col("_t")) & (found["node"] == F.col("_n"))).drop("_t", "_n")
    about = chosen.select(F.col("tree").alias("_t"), F.col("leaf").alias("_l"), "score", "rank", "turns")
    out = out.join(about, out["tree"].eqNullSafe(about["_t"]) & (out["leaf"] == about["_l"]))
    return out.select("tree", "leaf", "score", "rank", (F.col("turns") - 1 - F.col("back")).alias("pos"), "role", "text")


def format_paths(paths: DataFrame, assistant: str = "assistant") -> DataFrame:
    """Each path as one conversation: (tree, leaf, pos, part, loss_start, loss_end).

    A conversation is its parts in the order of pos, joined; loss_start and loss_end, code points from the start of the
    conversation, are the loss mask: the escaped text of each assistant turn, null on others. Parts are rows, so that a
    conversation of any length is written and read in pieces. Null roles and texts are empty.
    """
    role, text = escaped(text_of("role"), ROLE_CONTROL), escaped(text_of("text"))
    p = paths.withColumns({"_head": F.concat(F.lit(HEAD), role, F.lit(MID)), "_body": text, "_on": text_of("role") == assistant})
    p = p.withColumn("part", F.concat("_head", "_body", F.lit(TAIL)))
    before = Window.partitionBy("tree", "leaf").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("part")).over(before), F.lit(0)) + F.length("_head")
    p = p.withColumn("_start", start)
    return p.select("tree", "leaf", "pos", "part", F.when(F.col("_on"), F.col("_start")).alias("loss_start"), F.when(F.col("_on"), F.col("_start") + F.length("_body")).alias("loss_end"))


def conversations(parts: DataFrame) -> DataFrame:
    """(tree, leaf, text, loss) with each conversation as one text and its mask as spans; for conversations that fit a row."""
    whole = F.array_sort(F.collect_list(F.struct("pos", "part", "loss_start", "loss_end")))
    d = parts.groupBy("tree", "leaf").agg(whole.alias("w"))
    spans = F.transform(F.filter("w", lambda x: x["loss_start"].isNotNull()), lambda x: F.struct(x["loss_start"].alias("start"), x["loss_end"].alias("end")))
    return d.select("tree", "leaf", F.array_join(F.transform("w", lambda x: x["part"]), "").alias("text"), spans.alias("loss"))


class Reader:
    """Reads a formatted conversation from pieces of its text, holding one turn at a time."""

    def __init__(self):
        self.left = ""
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, text: str, spans: list[tuple[int, int]]) -> None:
        """text follows what was fed before; spans of the loss mask lie inside text."""
        for lo, hi in spans:
            under = unescape(text[lo - self.chars : hi - self.chars])
            self.loss_chars += len(under)
            self.loss.update(under.encode())
        self.chars += len(text)
        self.left += text
        while True:
            m = next((x for x in _TURN_END.finditer(self.left) if x[1]), None)
            if m is None:
                return
            head = _HEAD.match(self.left)
            role, body = unescape(head[1]), unescape(self.left[head.end() : m.start(1)])
            self.turns += 1
            self.all.update(f"{role}\n{body}\n".encode())
            self.left = self.left[m.end() :]


def read_back(parts: DataFrame) -> DataFrame:
    """Turns and loss of each formatted conversation, from its text alone: (tree, leaf, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        names = ["tree", "leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        key, reader, out = None, None, []

        def close():
            out.append((*key, reader.turns, reader.all.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars))

        def made():
            rows = list(zip(*out, strict=True)) or [[]] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names)

        for batch in batches:
            for tree, leaf, part, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("tree", "leaf", "part", "loss_start", "loss_end")), strict=True):
                if (tree, leaf) != key:
                    if reader:
                        close()
                    key, reader = (tree, leaf), Reader()
                reader.feed(part, [(lo, hi)] if lo is not None else [])
            yield made()
        if reader:
            close()
        yield made()

    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts.repartition(n, "tree", "leaf").sortWithinPartitions("tree", "leaf", "pos").select("tree", "leaf", "part", "loss_start", "loss_end")
    return dealt.mapInArrow(run, "tree long, leaf long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def turns_as_nodes(talks: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as reply trees of one branch: each turn answers the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.row_number().over(order).cast("long") - 1
    made = talks.select(F.col("conv_id").cast("long").alias("tree"), n.alias("node"), "role", "text")
    replied = F.when(F.col("role") == "assistant", 1.0).otherwise(0.0)
    return made.withColumns({"parent": F.when(F.col("node") > 0, F.col("node") - 1), "score": replied})


def op10_chat(spark, sf_dir: str) -> DataFrame:
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    paths = reply_paths(turns_as_nodes(talks.unionByName(extra)))
    return read_back(format_paths(paths)).withColumnRenamed("tree", "conv_id").drop("leaf")


OP10_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) v)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(15 + length(regexp_replace(role, '(\\|###|</turn>|:|\n)', 'x\1', 'g')) + length(regexp_replace(text, '(\\|###|</turn>)', 'x\1', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""
