"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frostline.llm.common import table
from frostline.llm.encoding import encoder

TURN = "struct<turn:bigint,role:string,text:string>"


def turns_of(conversations: DataFrame) -> DataFrame:
    """One row a conversation: conv_id and its turns in order (ties by role and text; nulls are kept)."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), "role", "text")
    return conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def common_turns(chosen: Column, rejected: Column) -> Column:
    """Number of leading turns that are equal in role and text."""
    same = F.transform(
        F.sequence(F.lit(1), F.least(F.size(chosen), F.size(rejected))),
        lambda i: F.element_at(chosen, i)["role"].eqNullSafe(F.element_at(rejected, i)["role"]) & F.element_at(chosen, i)["text"].eqNullSafe(F.element_at(rejected, i)["text"]),
    )
    first = F.array_position(same, False).cast("int")
    shorter = F.least(F.size(chosen), F.size(rejected))
    return F.when(shorter <= 0, F.lit(0)).when(first == 0, shorter).otherwise(first - 1)


def render(turns: Column) -> Column:
    """Turns as text: a line with the role between marks, then the turn's text (null: empty) and a line end."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("")), F.lit("|>\n"), F.coalesce(t["text"], F.lit("")), F.lit("\n"))), "")


def reply_pairs(conversations: DataFrame, rows_a_group: int = 20_000) -> DataFrame:
    """pair_id, chosen and rejected: each conversation up to its last assistant turn, and the same with
    that turn's text taken from another conversation.

    The other conversation is the next one in a group by hash, the last one's is the group's first; where
    there is no other, or it has the same reply, the rejected reply is empty.  Conversations without an
    assistant turn have no reply to choose and no row.
    """
    turns = turns_of(conversations)
    last = F.size("turns") - F.array_position(F.reverse(F.transform("turns", lambda t: F.coalesce(t["role"] == "assistant", F.lit(False)))), True).cast("int") + 1
    cut = turns.where(F.exists("turns", lambda t: F.coalesce(t["role"] == "assistant", F.lit(False)))).withColumn("chosen", F.slice("turns", 1, last))
    reply = cut.withColumn("reply", F.element_at("chosen", -1)["text"])
    groups = max(1, -(-conversations.select("conv_id").distinct().count() // rows_a_group))
    place = Window.partitionBy("g").orderBy(F.xxhash64("conv_id"), F.col("conv_id"))
    whole = place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    other = reply.withColumn("g", F.pmod(F.xxhash64("conv_id"), F.lit(groups))).withColumn("other", F.coalesce(F.lead("reply").over(place), F.first("reply").over(whole)))
    new = F.when(F.col("other").eqNullSafe(F.col("reply")), F.lit("")).otherwise(F.coalesce("other", F.lit("")))
    swapped = F.concat(F.slice("chosen", 1, F.size("chosen") - 1), F.array(F.element_at("chosen", -1).withField("text", new)))
    return other.select(F.col("conv_id").alias("pair_id"), "chosen", swapped.alias("rejected"))


def other_replies(conversations: DataFrame, rows_a_group: int = 20_000) -> DataFrame:
    """reply and other: each distinct text of assistant turns and the next one by hash, the last one's is the first.

    Null texts count as empty.  Where there is but one text, its other is the empty one.
    """
    texts = conversations.where("role = 'assistant'").select(F.coalesce("text", F.lit("")).alias("reply")).distinct()
    groups = max(1, -(-conversations.where("role = 'assistant'").count() // rows_a_group))
    hashed = texts.withColumn("h", F.xxhash64("reply")).withColumn("g", F.pmod("h", F.lit(groups)))
    every = Window.orderBy("g")  # one row a group
    firsts = hashed.groupBy("g").agg(F.min_by("reply", F.struct("h", "reply")).alias("first"))
    after = firsts.select("g", F.coalesce(F.lead("first").over(every), F.first("first").over(every)).alias("after"))
    led = hashed.withColumn("next", F.lead("reply").over(Window.partitionBy("g").orderBy("h", "reply"))).join(F.broadcast(after), "g")
    return led.select("reply", F.coalesce("next", F.nullif("after", "reply"), F.lit("")).alias("other"))


def with_others(conversations: DataFrame, rows_a_group: int = 20_000) -> DataFrame:
    """(conv_id, turn, role, text, other): each turn; of an assistant's, another reply, the next different one by hash.

    Only assistant turns are joined, so that no null key gathers the others; a reply that very many turns share is
    split by Spark's skew join.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    said = rows.where("role = 'assistant'").withColumn("reply", F.coalesce("text", F.lit("")))
    joined = said.join(other_replies(rows, rows_a_group), "reply").select(*rows.columns, "other")
    return joined.unionByName(rows.where("role is null or role <> 'assistant'").withColumn("other", F.lit(None).cast("string")))


def turn_pairs(conversations: DataFrame, rows_a_group: int = 20_000) -> DataFrame:
    """pair_id, chosen and rejected for every assistant turn of every conversation.

    Chosen is the whole conversation: what follows the turn stays.  Rejected are the turns before it and
    another reply, the next different one by hash.  A conversation without an assistant turn gives one row
    with all its turns on both sides.  pair_id and the number of common turns tell rows apart.  Each row holds its
    conversation; ``turn_preferences`` gives the formatted pairs without that.
    """
    turn = F.struct("turn", "role", "text", "other")
    turns = with_others(conversations, rows_a_group).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    at = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda k: F.coalesce(F.element_at("turns", k)["role"] == "assistant", F.lit(False)))
    each = turns.select("conv_id", F.col("turns"), F.explode_outer(at).alias("at"))
    plain = lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), t["text"].alias("text"))
    reply = F.element_at("turns", F.col("at"))
    swapped = F.concat(F.transform(F.slice("turns", 1, F.col("at") - 1), plain), F.array(F.struct(reply["turn"].alias("turn"), reply["role"].alias("role"), reply["other"].alias("text"))))
    whole = F.transform("turns", plain)
    return each.select(F.col("conv_id").alias("pair_id"), whole.alias("chosen"), F.when(F.col("at").isNull(), whole).otherwise(swapped).alias("rejected"))


def _line(role: str | None) -> str:
    return f"<|{role or ''}|>\n"


def _encoded(enc, parts: list[str]) -> list[bytes]:
    """Ids of parts that end with a line break.  It is an id of its own behind anything but white space, so that the text
    before it is encoded by pieces that are met again."""
    (end,) = enc.encode(["\n"])
    apart = [len(p) > 1 and not p[-2].isspace() for p in parts]
    return [raw + end if a else raw for raw, a in zip(enc.encode([p[:-1] if a else p for p, a in zip(parts, apart)]), apart)]


class Rendered:
    """A conversation's turns as one text and one list of ids, from which pairs are cut; each turn is encoded once."""

    def __init__(self, turns: list[tuple[str | None, str | None, str | None]], ids: list[bytes]):
        self.turns = turns
        parts = [x for role, text, _ in turns for x in (_line(role), f"{text or ''}\n")]
        self.text = "".join(parts)
        self.chars = np.cumsum([0, *(len(a) + len(b) for a, b in zip(parts[::2], parts[1::2]))])
        self.raw, others = ids[: len(parts)], iter(ids[len(parts) :])
        self.others = [next(others) if role == "assistant" else b"" for role, _, _ in turns]
        sizes = np.array([len(x) // 4 for x in self.raw], np.int64)
        learned = np.repeat([int(k and role == "assistant") for role, _, _ in turns for k in (0, 1)], sizes) if len(sizes) else np.zeros(0, np.int64)
        self.ids, self.mask = np.frombuffer(b"".join(self.raw), "<u4").astype(np.int32), learned.astype(np.int8)
        self.at = np.concatenate([[0], np.cumsum(sizes)])[::2]

    @staticmethod
    def parts(turns: list[tuple[str | None, str | None, str | None]]) -> list[str]:
        """What has to be encoded: each turn's line and text, then the other replies."""
        return [x for role, text, _ in turns for x in (_line(role), f"{text or ''}\n")] + [f"{other or ''}\n" for role, _, other in turns if role == "assistant"]

    def pairs(self):
        """n_common, prompt, and text, ids and mask of both sides, for each assistant turn; without one, all is prompt."""
        none = ("", self.ids[:0], self.mask[:0])
        replies = [k for k, (role, _, _) in enumerate(self.turns) if role == "assistant"]
        if not replies:
            yield (len(self.turns), self.text, *none, *none)
        for k in replies:
            role, text, other = self.turns[k]
            # The longest common prefix: the turns before, and the reply itself where there is no other text.
            n = k + (text == other)
            chosen = (self.text[self.chars[n] :], self.ids[self.at[n] :], self.mask[self.at[n] :])
            rejected = none
            if n == k:
                line, body = self.raw[2 * k], self.others[k]
                learned = np.repeat(np.array([0, 1], np.int8), [len(line) // 4, len(body) // 4])
                rejected = (f"{_line(role)}{other or ''}\n", np.frombuffer(line + body, "<u4").astype(np.int32), learned)
            yield (n, self.text[: self.chars[n]], *chosen, *rejected)


def turn_preferences(conversations: DataFrame, vocabulary: str, rows_a_group: int = 20_000, most_chars: int = 1_000_000) -> DataFrame:
    """The formatted pairs (see ``format_preferences``) of every assistant turn, as ``turn_pairs`` makes them.

    Conversations are read in order of turns (ties by role and text), one after another; every turn is encoded
    once, and prompts and completions are cut from that.  Null texts and roles count as empty ones; a null conv_id is
    one conversation; repeated turns are turns; very long texts are rendered whole; other columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    rows = with_others(conversations, rows_a_group)
    numbers = pa.list_(pa.int32()), pa.list_(pa.int8())
    names = ["pair_id", "n_common", "prompt", "chosen", "chosen_ids", "chosen_mask", "rejected", "rejected_ids", "rejected_mask"]
    ints = "array<int>", "array<tinyint>"
    types = ["int", "string", "string", *ints, "string", *ints]
    schema = conversations.select(F.col("conv_id").alias("pair_id"), *[F.lit(None).cast(t).alias(c) for c, t in zip(names[1:], types)]).schema

    def arrays(values: list[np.ndarray], kind):
        ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, kind.value_type.to_pandas_dtype()), *values])))

    def run(batches):
        enc, id_type = encoder(vocabulary, False), None

        def formatted(talks):
            lists = [Rendered.parts(turns) for _, turns in talks]
            ids, at, out, held = _encoded(enc, [x for p in lists for x in p]), 0, [], 0
            for (conv, turns), p in zip(talks, lists):
                for pair in Rendered(turns, ids[at : at + len(p)]).pairs():
                    out.append((conv, *pair))
                    held += len(pair[1]) + len(pair[2]) + len(pair[5])
                    if held >= 4 * most_chars:
                        yield batch_of(out)
                        out, held = [], 0
                at += len(p)
            if out:
                yield batch_of(out)

        def batch_of(out):
            c = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c[0], id_type), pa.array(c[1], pa.int32()), pa.array(c[2], pa.string()), *(x for k in (3, 6) for x in (pa.array(c[k], pa.string()), arrays(c[k + 1], numbers[0]), arrays(c[k + 2], numbers[1])))], names)

        talks, held, open_ = [], 0, False
        for batch in batches:
            id_type = batch.column("conv_id").type
            for conv, role, text, other in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "other"))):
                if not open_ or talks[-1][0] != conv:
                    if held >= most_chars:  # only whole conversations
                        yield from formatted(talks)
                        talks, held = [], 0
                    talks.append((conv, []))
                    open_ = True
                talks[-1][1].append((role, text, other))
                held += len(text or "") + len(other or "")
        if talks:
            yield from formatted(talks)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, schema)


def format_preferences(pairs: DataFrame, vocabulary: str) -> DataFrame:
    """pair_id, n_common, prompt, and for chosen and rejected: text, token ids and loss mask.

    ``pairs``: (pair_id, chosen, rejected), arrays of (turn, role, text).  The longest common prefix of
    whole turns is rendered once, as prompt.  What follows is rendered for each side; its mask is 1 on the
    ids of the texts of assistant turns (and their line end), 0 on other turns and on the role lines.  Null
    conversations have no turns.  Where one side is a prefix of the other its completion is empty; where
    they are equal both are.
    """
    none = F.expr(f"cast(array() as array<{TURN}>)")
    both = pairs.select("pair_id", F.coalesce("chosen", none).alias("chosen"), F.coalesce("rejected", none).alias("rejected")).withColumn("n_common", common_turns(F.col("chosen"), F.col("rejected")))
    rest = lambda side: F.slice(side, F.col("n_common") + 1, F.size(side))
    segments = lambda side: F.transform(rest(side), lambda t: F.struct(F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("")), F.lit("|>\n")).alias("head"), F.concat(F.coalesce(t["text"], F.lit("")), F.lit("\n")).alias("body"), F.coalesce(t["role"] == "assistant", F.lit(False)).alias("learn")))
    shaped = both.select("pair_id", "n_common", render(F.slice("chosen", 1, F.col("n_common"))).alias("prompt"), *[c for s in ("chosen", "rejected") for c in (render(rest(s)).alias(s), segments(s).alias(f"{s}_segments"))])

    def encode(batches):
        enc = encoder(vocabulary, False)
        for batch in batches:
            cols = [batch.column("pair_id"), batch.column("n_common"), batch.column("prompt")]
            for side in ("chosen", "rejected"):
                ids, masks = [], []
                for row in batch.column(f"{side}_segments").to_pylist():
                    parts = _encoded(enc, [x for s in row for x in (s["head"], s["body"])])
                    ids.append(np.frombuffer(b"".join(parts), "<u4").astype(np.int32))
                    masks.append(np.concatenate([np.full(len(p) // 4, int(s["learn"] and k), np.int8) for s, pair in zip(row, zip(parts[::2], parts[1::2])) for k, p in enumerate(pair)] or [np.zeros(0, np.int8)]))
                cols += [batch.column(side), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.int8()))]
            yield pa.RecordBatch.from_arrays(cols, ["pair_id", "n_common", "prompt", "chosen", "chosen_ids", "chosen_mask", "rejected", "rejected_ids", "rejected_mask"])

    return shaped.mapInArrow(encode, "pair_id long, n_common int, prompt string, chosen string, chosen_ids array<int>, chosen_mask array<tinyint>, rejected string, rejected_ids array<int>, rejected_mask array<tinyint>")


def op8_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return turn_preferences(table(spark, sf_dir, "conversations"), public_tokenizers.path("byte_bpe_50k.json"))
