"""Conversations in the order of their replies, linked by what messages quote.

Messages are parsed into their own text and quoted passages with their levels.
Passages and their lines are hashed after normalising and meet the texts,
paragraphs and lines of earlier messages with the same hash. The message that the
shallowest quotation comes from is the one replied to; threads follow those links
to their first message, and each conversation lists thread after thread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.llm.shared import as_text, numbered, stored, trimmed

_MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)(.*)", re.DOTALL)
_ATTRIBUTION = re.compile(r".{0,200}\b(?:wrote|writes|schrieb|a écrit|escribió)\s*:\s*", re.IGNORECASE)


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def hashed(text: str) -> int | None:
    """64 bits of the normalised text; None if it is blank."""
    n = normalised(text)
    return xxhash.xxh3_64_intdigest(n.encode("utf-8", "surrogatepass")) - (1 << 63) if n else None


def parse(text: str | None) -> tuple[str, list[tuple[int, list[str]]]]:
    """The message's own text, and (level, lines) for each quoted passage.

    A passage is what stands under the same number of ``>`` marks without a break.
    A line that only says who wrote what follows goes with the quotation.
    """
    own: list[str] = []
    quoted: list[tuple[int, list[str]]] = []
    last = 0
    for line in (text or "").split("\n"):
        m = _MARKS.fullmatch(line)
        level = m.group(1).count(">") if m else 0
        if level:
            if not last and own and _ATTRIBUTION.fullmatch(own[-1]):
                own.pop()
            if level != last:
                quoted.append((level, []))
            quoted[-1][1].append(m.group(2))
        else:
            own.append(line)
        last = level
    return "\n".join(own).strip(), quoted


def units(lines: list[str]) -> dict[int, int]:
    """Hash and word count of a whole text, its paragraphs and its lines."""
    paragraphs = re.split(r"\n[ \t]*\n", "\n".join(lines))
    found = {}
    for part in ["\n".join(lines), *paragraphs, *lines]:
        if (h := hashed(part)) is not None:
            found[h] = len(part.split())
    return found


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for row, text in zip(batch.drop(columns="text").itertuples(index=False), batch["text"].tolist(), strict=True):
            own, quoted = parse(text)
            said = [(0, -1, h, n) for h, n in units(own.split("\n")).items()]
            quotes = [(level, k, h, n) for k, (level, lines) in enumerate(quoted) for h, n in units(lines).items()]
            rows.append((*row, own, len(quoted), [{"level": a, "passage": k, "hash": b, "words": c} for a, k, b, c in [*said, *quotes]]))
        yield pd.DataFrame(rows, columns=["conv_id", "turn", "role", "body", "n_quoted", "units"])


def link(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parsed, links), both stored.

    parsed: conv_id, turn, role, body, n_quoted, units. links: conv_id, turn,
    reply_to, sources, of messages with a quotation that comes from an earlier
    message of the conversation. sources: (passage, level, source, words) for each
    such passage, counted from 0 as they stand, with the turn of the message that
    most of its words come from, the latest of equals. reply_to is the like for all
    passages of the shallowest level with a source; a source of level k is itself
    k - 1 replies further back than what was answered. Where several messages said
    the same, the latest before counts.
    """
    read = as_text(messages, "conv_id", "turn").mapInPandas(trimmed(_parse), "conv_id string, turn string, role string, body string, n_quoted int, units array<struct<level int, passage int, hash long, words int>>")
    parsed = stored(read.withColumns({c: F.col(c).cast("long") for c in ("conv_id", "turn")}), "quotes-parsed")
    each = parsed.select("conv_id", "turn", F.explode("units").alias("u")).select("conv_id", "turn", "u.*").filter("conv_id is not null and turn is not null").distinct()
    # within a turn quotations stand before what the message says itself
    earlier = Window.partitionBy("conv_id", "hash").orderBy("turn", F.col("level").desc()).rowsBetween(Window.unboundedPreceding, -1)
    quoted = each.filter("level > 0").select("conv_id", "hash").distinct()
    source = F.last(F.when(F.col("level") == 0, F.col("turn")), ignorenulls=True).over(earlier)
    met = each.join(quoted, ["conv_id", "hash"], "left_semi").withColumn("source", source).filter("level > 0 and source is not null")
    # one passage after the other, each with the hashes that no earlier one of its level has
    new = F.row_number().over(Window.partitionBy("conv_id", "turn", "level", "hash").orderBy("passage")) == 1
    per = met.withColumn("new", F.when(new, F.col("words")).otherwise(0)).groupBy("conv_id", "turn", "level", "passage", "source").agg(F.sum("words").alias("words"), F.sum("new").alias("new"))
    per = stored(per, "quotes-met")
    passages = per.groupBy("conv_id", "turn", "level", "passage").agg(F.max(F.struct("words", "source")).alias("best")).groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(F.struct("passage", "level", F.col("best.source").alias("source"), F.col("best.words").alias("words")))).alias("sources"))
    score = per.groupBy("conv_id", "turn", "level", "source").agg(F.sum("new").alias("words"))
    best = score.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "words", "source")).alias("best")).select("conv_id", "turn", F.col("best.source").alias("reply_to"))
    return parsed, stored(best.join(passages, ["conv_id", "turn"]), "quotes-links")


def threads(links: DataFrame, rounds: int = 60) -> DataFrame:
    """conv_id, turn, reply_to, thread: the first turn of each reply's thread.

    Every round doubles the steps that a message has gone back.
    """
    state = links.select("conv_id", "turn", "reply_to", F.col("reply_to").alias("thread"))
    for k in range(rounds):
        up = state.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("next"))
        state = stored(state.join(up, ["conv_id", "thread"], "left").select("conv_id", "turn", "reply_to", F.coalesce("next", "thread").alias("thread"), F.col("next").isNotNull().alias("moved")), f"quotes-threads-{k}")
        if state.filter("moved").isEmpty():
            break
        state = state.drop("moved")
    return state.select("conv_id", "turn", "reply_to", "thread")


def reply_order(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, n_quoted, reply_to, thread, position, sources for each row.

    text is without quotations; reply_to is the turn replied to, null without a
    quotation that is found: the source of the shallowest level that has one. sources
    are those of all quoted passages, see ``link``, null without any; thread is the turn that the thread starts with.
    position counts from 0 in each conversation, by (thread, turn): a reply never
    stands before what it answers. Null and empty texts have an empty text. Rows
    of a null conversation or turn are returned unlinked, in a conversation of
    their own kind (nulls are grouped, and first). Rows that repeat a conversation
    and turn are one message to others; each gets its own position. Empty tables
    give empty results; other columns are ignored.
    """
    kept = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).alias("text"))
    parsed, links = link(kept)
    all_ = parsed.drop("units").join(threads(links).join(links.select("conv_id", "turn", "sources"), ["conv_id", "turn"]), ["conv_id", "turn"], "left").withColumn("thread", F.coalesce("thread", "turn"))
    keyed = stored(all_.withColumn("_conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))), "quotes-keyed")
    placed = numbered(keyed, ["_conv"], ["thread", "turn", "role", "body"], "quotes-placed")
    return placed.select("conv_id", "turn", "role", F.col("body").alias("text"), "n_quoted", "reply_to", "thread", F.col("rank").alias("position"), "sources")
