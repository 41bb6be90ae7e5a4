"""Chat formatting into a prefix tree.

A turn is written as `### role: text</turn>` and a newline; texts and roles have their
control strings escaped, so that the markers part turns wherever they stand. A token is a
byte of the UTF-8 form (ids 0 to 255). Conversations that share their first turns share
a branch of a tree: the shared tokens are emitted once, in depth-first order.

What is emitted are segments, one a distinct conversation: the tokens it doesn't share
with the ones before it. A segment lies at `start` in its sequence (a tree); its first
token has the position id `position`, the next ones follow; its token at x attends to the
intervals of its ancestors and to start..x. So a tree can be of any size: its sequence is
its segments in the order of start, and no task holds it.

Distinct conversations are sorted by their path (the digests of their turns), which is
depth-first order; each task walks its range of paths with the stack of open branches.
Only digests and lengths are sorted. What a range needs of those before it is one stack
a range, added up on the driver as the row counts of partitions are. Texts are shuffled
once, by conversation, and what is shared once more, to those that read it back.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm.common import checkpointed

START, COLON, END = "### ", ": ", "</turn>\n"
LEARNED = "assistant"
#: Control strings and their escapes; the backslash comes first when escaping, last when reading back.
ESCAPES = (("\\", "\\b"), ("</turn>", "\\t"), ("##", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
DIGEST = 16
SALTS = 64
LAYOUT = "owner string, shared_turns int, sequence long, start long, position long, n_tokens long, ancestors array<struct<lo:long,hi:long,owner:string>>, loss array<struct<lo:long,hi:long>>"
COLUMNS = ["owner", "shared_turns", "sequence", "start", "position", "n_tokens", "ancestors", "loss"]


def escape(x: Column, escapes: Iterable[tuple[str, str]] = ESCAPES) -> Column:
    for plain, code in escapes:
        x = F.replace(x, F.lit(plain), F.lit(code))
    return x


def unescape(x: Column, escapes: Iterable[tuple[str, str]] = ESCAPES) -> Column:
    for plain, code in reversed(list(escapes)):
        x = F.replace(x, F.lit(code), F.lit(plain))
    return x


def formatted_turns(conversations: DataFrame) -> DataFrame:
    """A row per turn: _key (of its conversation), conv_id, turn, formatted, digest, n, lo and hi (bytes of the text if it is learned, else null)."""
    role = F.coalesce(F.col("role"), F.lit(""))
    head = F.concat(F.lit(START), escape(role, ROLE_ESCAPES), F.lit(COLON))
    body = escape(F.coalesce(F.col("text"), F.lit("")))
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    rows = conversations.select(key.alias("_key"), "conv_id", "turn", F.concat(head, body, F.lit(END)).alias("formatted"), F.when(role == LEARNED, F.octet_length(head)).alias("lo"))
    n = F.octet_length("formatted")
    return rows.select("_key", "conv_id", "turn", "formatted", F.substring(F.unhex(F.sha2("formatted", 256)), 1, DIGEST).alias("digest"), n.alias("n"), "lo", F.when(F.col("lo").isNotNull(), n - len(END)).alias("hi"))


class Walk:
    """Depth-first walk over sorted paths: where the next token goes, the last path and the pieces it lies in.

    A piece (lo, hi, owner, k, k_end) is the first part of a segment: its tokens, the
    segment's owner, and the turns it holds.
    """

    def __init__(self, offset: int = 0, path: bytes = b"", pieces: tuple = ()) -> None:
        self.offset, self.path, self.pieces = offset, path, list(pieces)

    def shared(self, path: bytes) -> int:
        k = 0
        while (k + 1) * DIGEST <= min(len(path), len(self.path)) and path[k * DIGEST : (k + 1) * DIGEST] == self.path[k * DIGEST : (k + 1) * DIGEST]:
            k += 1
        return k

    def cut(self, k: int, sums: list[int]) -> None:
        """Leaves the first k turns; sums are the tokens before each turn of a path that shares them."""
        while self.pieces and self.pieces[-1][3] >= k:
            self.pieces.pop()
        if self.pieces and self.pieces[-1][4] > k:
            lo, _, owner, first, _ = self.pieces[-1]
            self.pieces[-1] = (lo, lo + sums[k] - sums[first], owner, first, k)

    def step(self, owner: str, path: bytes, lengths: Iterable[int]) -> tuple[int, int, int, int, list]:
        """Shared turns, start, position, n_tokens and ancestors (pieces) of the next conversation's segment."""
        sums = [0, *accumulate(int(n) for n in lengths)]
        k = self.shared(path)
        self.cut(k, sums)
        above, start, n = list(self.pieces), self.offset, sums[-1] - sums[k]
        if n:
            self.pieces.append((start, start + n, owner, k, len(sums) - 1))
        self.offset, self.path = start + n, path
        return k, start, sums[k], n, above

    def follow(self, owner: str, path: bytes, sums: list[int], after: "Walk") -> "Walk":
        """The walk after a range that began with a conversation (owner, path, sums) and, walked from nothing, ended as after."""
        k = self.shared(path)
        shift = self.offset - sums[k]
        new = Walk(self.offset, self.path, self.pieces)
        head = after.pieces[0] if after.pieces[0][2] == owner else None
        stays = head[4] if head else 0
        new.cut(min(k, stays), sums)
        if stays > k:
            new.pieces.append((self.offset, head[1] + shift, owner, k, stays))
        new.pieces += [(p[0] + shift, p[1] + shift, *p[2:]) for p in after.pieces[1 if head else 0 :]]
        new.offset, new.path = after.offset + shift, after.path
        return new


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(batch["pid"], batch["owner"], batch["path"], batch["turns"])


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The number of a range, its first path with sums, and its walk from nothing."""
    walk, first, number = Walk(), None, None
    for pid, owner, path, turns in _rows(batches):
        lengths = [t["n"] for t in turns]
        if first is None:
            number, first = pid, (owner, path, [0, *accumulate(int(n) for n in lengths)])
        walk.step(owner, path, lengths)
    if first is not None:
        yield pd.DataFrame({"pid": [number], "state": [pickle.dumps((*first, walk.offset, walk.path, walk.pieces))]})


def _layout(begins: dict[int, tuple]) -> object:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walk, out = None, []
        for pid, owner, path, turns in _rows(batches):
            walk = walk or Walk(*begins[pid])
            k, start, position, n, above = walk.step(owner, path, [t["n"] for t in turns])
            base = above[0][0] if above else start
            loss, at = [], 0
            for t in turns[k:]:
                if t["lo"] is not None and t["hi"] > t["lo"]:
                    loss.append({"lo": at + t["lo"], "hi": at + t["hi"]})
                at += t["n"]
            out.append((owner, k, base, start - base, position, n, [{"lo": lo - base, "hi": hi - base, "owner": o} for lo, hi, o, *_ in above], loss))
            if len(out) == 2000:
                yield pd.DataFrame(out, columns=COLUMNS)
                out = []
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    return run


def join_salted(many: DataFrame, few: DataFrame, key: str, spread: str) -> DataFrame:
    """Inner join on key, of which few has each value once and many may have one in most of its rows.

    The rows of many are dealt by key and a salt of spread; a row of few is copied to
    those salts only that its key has.
    """
    salted = many.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return salted.join(salted.select(key, "_salt").distinct().join(few, key), [key, "_salt"]).drop("_salt")


class Forest(NamedTuple):
    """layout: owner, sequence, start, position, n_tokens, ancestors (intervals of the
    sequence in order, each the first part of its owner's segment), loss (intervals of
    tokens, counted from the segment's own start), shared_turns. segments: layout and
    tokens (binary, an id a byte). members: key, conv_id, owner: the segment that ends the
    conversation's path; equal conversations have the same.
    """

    layout: DataFrame
    segments: DataFrame
    members: DataFrame


def format_tree(conversations: DataFrame) -> Forest:
    """The trees of conversations (conv_id, turn, role, text).

    Turns are in order of `turn`, null first, those that tie by the digest of what they
    say; repeated rows are turns of their own. Null roles and texts are empty, rows with
    a null conv_id form one conversation. Other columns aren't read; an empty table gives
    empty ones. A conversation is one training example and must fit into a task; the
    conversations that share a turn needn't.
    """
    turns = formatted_turns(conversations)
    slim = turns.groupBy("_key").agg(F.max("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("turn", "digest", "n", "lo", "hi"))).alias("turns"))
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    slim = checkpointed(slim.select("_key", "conv_id", path.alias("path"), F.transform("turns", lambda t: F.struct(t["n"].alias("n"), t["lo"].alias("lo"), t["hi"].alias("hi"))).alias("turns")).withColumn("leaf", F.sha2("path", 256)))
    distinct = slim.groupBy("leaf").agg(F.min("_key").alias("owner"), F.first("path").alias("path"), F.first("turns").alias("turns"))
    ordered = distinct.repartitionByRange("path").sortWithinPartitions("path").withColumn("pid", F.spark_partition_id())
    ordered = checkpointed(ordered.select("pid", "owner", "leaf", "path", "turns"))
    begins, walk = {}, Walk()
    for row in sorted(ordered.mapInPandas(_ends, "pid int, state binary").collect(), key=lambda r: r["pid"]):
        begins[row["pid"]] = (walk.offset, walk.path, tuple(walk.pieces))
        owner, path, sums, *after = pickle.loads(row["state"])
        walk = walk.follow(owner, path, sums, Walk(*after))
    layout = checkpointed(ordered.mapInPandas(_layout(begins), LAYOUT))
    texts = turns.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "formatted"))).alias("_all"))
    own = F.slice("_all", F.col("shared_turns") + 1, F.greatest(F.size("_all") - F.col("shared_turns"), F.lit(0)))
    tokens = F.array_join(F.transform(own, lambda t: t["formatted"]), "").cast("binary")
    segments = texts.join(layout.withColumnRenamed("owner", "_key"), "_key").withColumn("tokens", tokens).drop("_all")
    segments = segments.withColumnRenamed("_key", "owner")
    members = join_salted(slim.select(F.col("_key").alias("key"), "conv_id", "leaf"), ordered.select("leaf", "owner"), "leaf", "key")
    return Forest(layout, segments, members.drop("leaf"))


def _text(tokens: Column, lo: Column, hi: Column) -> Column:
    return F.decode(tokens.substr((lo + 1).cast("int"), (hi - lo).cast("int")), "UTF-8")


def read_back(forest: Forest) -> DataFrame:
    """What the segments hold on the path to each of them: one row per distinct conversation.

    Columns: owner, formatted (text of all tokens on the path), turns (array of role and
    text, parsed from it), learned (the text under the loss mask, unescaped).
    """

    def learned(tokens: Column, loss: Column) -> Column:
        return F.array_join(F.transform(loss, lambda x: unescape(_text(tokens, x["lo"], x["hi"]))), "")

    tokens, length = F.col("tokens"), F.col("n")
    needs = forest.layout.select(F.col("owner").alias("reader"), F.posexplode("ancestors").alias("nth", "piece"))
    needs = needs.select("reader", "nth", F.col("piece.owner").alias("owner"), (F.col("piece.hi") - F.col("piece.lo")).alias("n"))
    segments = forest.segments.select("owner", "tokens", "loss")
    pieces = join_salted(needs, segments, "owner", "reader")
    said = learned(tokens, F.filter("loss", lambda x: x["hi"] <= length))
    pieces = pieces.select("reader", "nth", _text(tokens, F.lit(0), length).alias("part"), said.alias("said"))
    above = pieces.groupBy(F.col("reader").alias("owner")).agg(F.sort_array(F.collect_list(F.struct("nth", "part", "said"))).alias("_above"))
    whole = segments.select("owner", F.decode("tokens", "UTF-8").alias("_own"), learned(tokens, F.col("loss")).alias("_said")).join(above, "owner", "left")

    def joined(part: str, own: str) -> Column:
        return F.concat(F.coalesce(F.array_join(F.transform("_above", lambda x: x[part]), ""), F.lit("")), F.col(own))

    whole = whole.select("owner", joined("part", "_own").alias("formatted"), joined("said", "_said").alias("learned"))
    lines = F.split("formatted", END)

    def turn(line: Column) -> Column:
        head = F.substring_index(line, COLON, 1)
        role = unescape(F.substr(head, F.lit(len(START) + 1)), ROLE_ESCAPES)
        return F.struct(role.alias("role"), unescape(F.substr(line, F.length(head) + len(COLON) + 1)).alias("text"))

    turns = F.transform(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), turn)
    return whole.select("owner", "formatted", turns.alias("turns"), "learned")


def digests(forest: Forest) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, read back from the segments."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read_back(forest).select(
        "owner", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
    return join_salted(forest.members, read, "owner", "key").drop("owner", "key")


def op11_chat_tree(spark, sf_dir: str) -> DataFrame:
    known = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digests(format_tree(known.unionByName(planted)))


OP11_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
clean AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM said),
coded AS (SELECT *, replace(replace(replace(text, '\', '\b'), '</turn>', '\t'), '##', '\h') AS t,
  replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\t'), '##', '\h'), ':', '\c') AS r FROM clean)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('### ' || r || ': ' || t || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM coded GROUP BY conv_id
"""
