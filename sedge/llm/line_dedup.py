"""Line deduplication by deletion neighbourhoods, with built-in functions only.

A line is a sequence of words; the bound is one edited word (replaced, added or
left out) for lines of ``FUZZY`` words or more, none for shorter ones. Every line
emits its variants within the bound as hashed keys: itself, and itself without
each word. Lines that share a variant are joined and verified, and of lines within
the bound of each other the earliest stays.

Before that, lines that can't have a partner are left out: an edit of one word
leaves one half of the shorter line whole, so a line meets each partner on the
hash of a half. This drops no pair, and it spares most lines their variants.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sedge.llm.hashing import may_hold, membership
from sedge.llm.shared import SPACE, looked_up, stored

#: Lines with fewer words are judged only if asked for; those with fewer than FUZZY only for equality.
SHORTEST, FUZZY = 3, 8
#: A character of a script that is written without spaces, and where such may stand.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
FAR = r"[\x{0E00}-\x{1FFF}\x{2E80}-\x{10FFFF}]"


def id_of(docs: DataFrame, id_col: str) -> Column:
    """A number, or a struct as it is."""
    return F.col(id_col) if isinstance(docs.schema[id_col].dataType, StructType) else F.col(id_col).cast("long")


def normalised(line: Column, every: bool = False) -> Column:
    """Lower case, words joined by one space. With ``every`` each character of a script
    without spaces is a word. Expressions that cost much run only where they change something."""
    line = F.lower(line)
    if every:
        wide = F.octet_length(line) > F.length(line)
        line = F.when(wide & line.rlike(FAR), F.regexp_replace(line, f"({UNSPACED})", " $1 ")).otherwise(line)
    ragged = reduce(lambda a, b: a | b, [F.contains(line, F.lit(x)) for x in ("  ", "\t", "\r", "\x0b", "\x0c")])
    return F.trim(F.when(ragged, F.regexp_replace(line, f"[{SPACE}]+", " ")).otherwise(line))


def words_in(norm: Column) -> Column:
    return F.octet_length(norm) - F.octet_length(F.replace(norm, F.lit(" "), F.lit(""))) + 1


def lines_of(docs: DataFrame, every: bool = False) -> DataFrame:
    """doc_id, line_no, norm, n for each line of ``SHORTEST`` words or more.

    ``docs``: doc_id, text. With ``every``, each line that isn't blank.
    """
    # normalised inside the generator: a filter on what a projection makes would make it twice
    each = docs.select("doc_id", F.posexplode(F.transform(F.split("text", "\n"), lambda x: normalised(x, every))).alias("line_no", "norm"))
    counted = each.withColumn("n", words_in(F.col("norm")))
    return counted.filter(F.col("norm") != "" if every else F.col("n") >= SHORTEST)


def half(tag: str, side: str) -> Column:
    """Hash of the first half ("a") or of the rest ("b") of a line of ``tag`` words;
    of a line with one word more, what these would be if the word were added after
    or before."""
    words = f"cast(floor(({tag}) / 2) as int)" if side == "a" else f"cast(-(({tag}) - floor(({tag}) / 2)) as int)"
    return F.expr(f"struct({tag} as tag, xxhash64(substring_index(norm, ' ', {words}), {tag}, '{side}') as half)")


def possible(distinct: DataFrame) -> DataFrame:
    """(line, same, fewer, more): lines that share a half with another one of as many
    words, of one word less, or of one more. ``distinct``: line, n, keys."""
    keys = distinct.select("line", "n", F.explode("keys").alias("k")).select("line", "n", "k.tag", "k.half")
    even = F.col("n") == F.col("tag")
    per = keys.groupBy("half").agg(F.count_if(even).alias("_even"), F.count_if(~even).alias("_over"))
    shared = stored(per.filter("_even > 1 or _even > 0 and _over > 0").withColumn("_members", F.col("_even") + F.col("_over")), "lines-halves")
    some = stored(may_hold(keys, "half", membership(shared, "half"), "_near").filter("_near").drop("_near"), "lines-sharing")
    return (
        looked_up(some, shared, ["half"], "_members")
        .filter("_members is not null")
        .select("line", (even & (F.col("_even") > 1)).alias("same"), (~even & (F.col("_even") > 0)).alias("fewer"), (even & (F.col("_over") > 0)).alias("more"))
        .filter("same or fewer or more")
        .groupBy("line")
        .agg(F.max("same").alias("same"), F.max("fewer").alias("fewer"), F.max("more").alias("more"))
    )


def variants(lines: DataFrame) -> DataFrame:
    """(key, line, first, whole): the hashed deletion variants of each line.

    Without word i to meet lines with another word there (hashed with places);
    without any one word, and whole, to meet lines of one word less or more.
    """
    xor = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))
    placed, free = F.col("placed"), F.col("free")
    out = lines.select(
        "line", "first", "same", "fewer", "more", "n",
        F.transform(F.split("norm", " "), lambda w, i: F.xxhash64(w, i)).alias("placed"),
        F.transform(F.split("norm", " "), lambda w: F.xxhash64(w)).alias("free"),
    ).select("*", xor(placed).alias("all_placed"), xor(free).alias("all_free"))
    none = F.array().cast("array<long>")
    replaced = F.when(F.col("same"), F.transform(placed, lambda h, i: F.xxhash64(F.col("all_placed").bitwiseXOR(h), i, "n"))).otherwise(none)
    shorter = F.when(F.col("fewer"), F.array_distinct(F.transform(free, lambda h: F.xxhash64(F.col("all_free").bitwiseXOR(h), F.col("n") - 1)))).otherwise(none)
    whole = F.when(F.col("more"), F.array(F.xxhash64("all_free", "n"))).otherwise(none)
    kinds = F.array(F.struct(F.lit(0).alias("kind"), replaced.alias("keys")), F.struct(F.lit(1).alias("kind"), shorter.alias("keys")), F.struct(F.lit(2).alias("kind"), whole.alias("keys")))
    return out.select("line", "first", F.explode(kinds).alias("k")).select("line", "first", "k.kind", F.explode("k.keys").alias("key"))


def within_one(a: Column, b: Column) -> Column:
    """Whether two arrays of words differ by one edit at most."""
    replaced = F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d)) <= 1

    def longer(x: Column, y: Column) -> Column:
        at = F.array_position(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), True).cast("int")
        return F.concat(F.slice(x, 1, at - 1), F.slice(x, at + 1, F.size(x))) == y

    return F.when(F.size(a) == F.size(b), replaced).when(F.size(a) == F.size(b) + 1, longer(a, b)).when(F.size(b) == F.size(a) + 1, longer(b, a)).otherwise(False)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: bool = False) -> DataFrame:
    """The lines that go: doc_id, line_no, of_doc_id, of_line_no, edits.

    Lines are what newlines part, numbered from 0; their order is (doc_id, line_no).
    A line goes if an earlier one equals it, apart from white space and case, or has
    ``FUZZY`` words or more, as it has itself, and differs by one word; ``of`` is the
    earliest such line and edits says which of the two it is. Lines of under
    ``SHORTEST`` words stay, unless ``every`` line is to be judged: then blank lines
    alone stay, and characters of scripts without spaces count as words. Null and empty texts have no lines. Rows that repeat a
    doc_id count as the same lines; the id may be a struct. Empty tables give empty results; other columns
    are ignored. Lines are told apart by 96 bits of hash.
    """
    text = docs.select(id_of(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))
    here = F.struct("doc_id", "line_no")
    lines = lines_of(text, every)
    keys = F.array(half("n", "a"), half("n", "b"), half("n - 1", "a"), half("n - 1", "b"))
    stood = stored(lines.select("doc_id", "line_no", "n", F.xxhash64("norm").alias("line"), F.hash("norm").alias("line2"), F.when(F.col("n") >= FUZZY, keys).alias("keys")), "lines-every")
    distinct = stored(stood.groupBy("line", "line2").agg(F.min(here).alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys")), "lines-distinct")
    chosen = stored(possible(distinct.filter(F.col("n") >= FUZZY)).join(distinct.select("line", "first"), "line"), "lines-possible")

    # texts are read again, but only chosen lines are normalised: documents without any go first
    wanted = chosen.withColumn("at", F.xxhash64("first.doc_id", "first.line_no")).withColumn("doc", F.xxhash64("first.doc_id"))
    held = may_hold(text.withColumn("doc", F.xxhash64("doc_id")), "doc", membership(wanted, "doc"), "some").filter("some")
    raw = held.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).withColumn("at", F.xxhash64("doc_id", "line_no"))
    near = may_hold(raw, "at", membership(wanted, "at"), "near").filter("near").select("doc_id", "line_no", "at", "raw")
    found = near.join(wanted.drop("doc"), "at").filter("first.doc_id <=> doc_id and first.line_no = line_no")
    same_text = found.select("line", "first", "same", "fewer", "more", F.explode(F.array(normalised(F.col("raw"), every))).alias("norm")).filter(F.xxhash64("norm") == F.col("line"))
    texts = stored(same_text.dropDuplicates(["line"]).select("line", "norm", words_in(F.col("norm")).alias("n"), "first", "same", "fewer", "more"), "lines-texts")

    emitted = stored(variants(texts), "lines-variants")
    # of lines that share all but one place, each needs only the earliest
    placed = emitted.filter("kind = 0").select("key", "line", "first")
    least = placed.groupBy("key").agg(F.min(F.struct("first", "line")).alias("least"), F.count("*").alias("members")).filter("members > 1").select("key", F.col("least.line").alias("other"), "members")
    replaced = looked_up(placed.select("key", "line"), stored(least, "lines-least"), ["key"], "members").filter("other <> line").select("line", "other")
    shorter, whole = emitted.filter("kind = 1").select("key", "line"), emitted.filter("kind = 2").select("key", F.col("line").alias("other"))
    inserted = shorter.join(whole, "key").select("line", "other")
    pairs = replaced.union(inserted).distinct()
    one, two = texts.select("line", F.split("norm", " ").alias("a"), F.col("first").alias("first_a")), texts.select(F.col("line").alias("other"), F.split("norm", " ").alias("b"), F.col("first").alias("first_b"))
    true = pairs.join(one, "line").join(two, "other").filter(within_one(F.col("a"), F.col("b")))
    later = F.when(F.col("first_a") < F.col("first_b"), F.struct(F.col("other").alias("line"), F.col("first_a").alias("near"))).otherwise(F.struct("line", F.col("first_b").alias("near")))
    neighbours = true.select(later.alias("x")).select("x.line", "x.near").groupBy("line").agg(F.min("near").alias("near"))

    verdict = stored(distinct.select("line", "line2", "first", "copies").join(neighbours, "line", "left").filter("copies > 1 or near is not null"), "lines-verdict")
    got = looked_up(stood.select("doc_id", "line_no", "line", "line2"), verdict, ["line", "line2"], "copies").filter("first is not null")
    by_near = F.col("near").isNotNull() & (F.col("near") < F.col("first"))
    of = F.when(by_near, F.col("near")).otherwise(F.col("first"))
    return got.select("doc_id", "line_no", of.alias("of"), by_near.cast("int").alias("edits")).filter("not (of.doc_id <=> doc_id and of.line_no = line_no)").select("doc_id", "line_no", F.col("of.doc_id").alias("of_doc_id"), F.col("of.line_no").alias("of_line_no"), "edits")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: bool = False) -> DataFrame:
    """``docs`` without the lines of ``repeated_lines``, and ``lines_gone``, how many
    each lost. Other columns stay as they are, but one of that name; a text that loses nothing too.

    Documents stand in the order of the id, null last, and of a hash of the text: rows
    that repeat an id are documents of their own. Rows that repeat id and text are the same
    document twice: both lose the same lines and keep what comes first in it.
    """
    place = F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))
    placed = docs.withColumn("_place", place)
    gone = stored(repeated_lines(placed, "_place", text_col, every).groupBy("doc_id").agg(F.collect_set("line_no").alias("_gone")).select(F.col("doc_id").alias("_place"), F.xxhash64("doc_id").alias("_key"), "_gone"), "lines-gone")
    flagged = may_hold(placed.withColumn("_key", F.xxhash64("_place")), "_key", membership(gone, "_key"), "_near")
    touched = flagged.filter("_near").drop("_near")
    touched = touched.join(gone.select(F.col("_key").alias("_of_key"), F.col("_place").alias("_of"), "_gone"), F.expr("_key = _of_key and _place <=> _of"), "left")
    # what stays, by number: a document of many lines is gone through once
    numbers = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    kept = F.element_at(F.transform(F.array(F.split(text_col, "\n")), lambda lines: F.array_join(F.transform(numbers(lines), lambda i: F.element_at(lines, i + 1)), "\n")), 1)
    whole = flagged.filter("not _near").withColumn("lines_gone", F.lit(0))
    changed = touched.withColumn(text_col, F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(kept)).withColumn("lines_gone", F.coalesce(F.size("_gone"), F.lit(0)))
    columns = [c for c in docs.columns if c != "lines_gone"]
    return whole.select(*columns, "lines_gone").unionByName(changed.select(*columns, "lines_gone"))
