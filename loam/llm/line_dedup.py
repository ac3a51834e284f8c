"""Line deduplication by a deletion-neighbourhood join, with DataFrame functions only.

The unit of editing is a word (a field between spaces) and the edit bound is 1: two lines are the
same if one word inserted, deleted or replaced makes them equal.  Lines of few words, among them those
without spaces, are edited by characters.  Every line emits the hash of each variant with
one unit deleted, and of itself.  Equal hashes meet: two lines that give one variant by
deleting at one place differ in that word, a line that equals the other's variant lacks one word.  The
pair with the earliest such line is verified on its texts (if that one is none, the other ones
too), and the later line goes.

Before variants are made, exact copies are folded into one line, and lines are left out that can't
have a partner: after one edit, the first or the last h words still agree (h: a power of two up to
half the line), so a line whose first h words and last h words no other line has is alone.

All joins are sort-merge joins at every size, since each side grows with the corpus; a hot key's rows
are split by AQE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.js import let
from ..session import written
from .shared import told_apart

#: Lines with fewer words are not edited by words: one word is too much of them.
MIN_WORDS = 5
#: Lines with fewer characters are not edited by characters; only their exact copies go.
MIN_CHARS = 5
#: Bits of a variant's key that count.
_MASK = -1


def _hashes(line: Column) -> tuple[Column, Column]:
    return F.xxhash64(line), F.xxhash64(F.lit(1), line)


def _n_words(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


class Places:
    """Lines as places that can be compared: a document's id, then the line's number from 0.

    Where all ids lie within 2 ** 32 of each other a place is packed into one long, which Spark
    aggregates in hash maps; else it is a struct.  No text has 2 ** 31 lines."""

    def __init__(self, ids: DataFrame):
        low, high = ids.agg(F.min("_id"), F.max("_id")).first()
        whole = isinstance(ids.schema["_id"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        self.low, self.packed = low, whole and low is not None and high - low < 1 << 32

    def place(self, d: Column, n: Column) -> Column:
        return F.shiftleft(d.cast("long") - self.low, 31) + n if self.packed else F.struct(d.alias("d"), n.alias("n"))

    def document(self, place: Column) -> Column:
        return F.shiftright(place, 31) + self.low if self.packed else place["d"]

    def number(self, place: Column) -> Column:
        return place.bitwiseAND((1 << 31) - 1).cast("int") if self.packed else place["n"]


def _lines(docs: DataFrame, text: str, places: Places) -> DataFrame:
    """(p, line) of the lines that are judged: those that aren't blank."""
    lines = docs.where("_id is not null").select("_id", F.posexplode(F.split(F.col(text), "\n")).alias("n", "line"))
    return lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select(places.place(F.col("_id"), F.col("n")).alias("p"), "line")


def _units(line: Column, min_words: int) -> Column:
    """The words of a line, or the characters of one of few words, each behind a space, which no word has."""
    characters = F.transform(F.split(line, ""), lambda c: F.concat(F.lit(" "), c))
    return F.when(_n_words(line) >= min_words, F.split(line, " ")).otherwise(characters)


def _ends(line: Column, min_words: int) -> list[Column]:
    """Keys of the first and last h units, for h of the line and, at a power of two, of a line one unit shorter.

    Of lines too short for an edit they are null."""
    by_word = _n_words(line) >= min_words
    n = F.when(by_word, _n_words(line)).when(F.length(line) >= MIN_CHARS, F.length(line))
    h = F.pow(F.lit(2.0), F.floor(F.log2(n / 2))).cast("int")
    keys = []
    for size, there in ((h, F.lit(True)), ((h / 2).cast("int"), (h * 2 == n) & (n > 3))):
        for side, sign in ((0, 1), (1, -1)):
            characters = F.right(line, size) if side else F.left(line, size)
            end = F.when(by_word, F.call_function("substring_index", line, F.lit(" "), size * sign)).otherwise(characters)
            keys.append(F.when(there & n.isNotNull(), F.xxhash64(F.lit(side), size, end)))
    return keys


def _running(values: Column) -> Column:
    """Running XORs of an array: in blocks of its length's square root, so that appending copies little."""
    xor = lambda x, y: x.bitwiseXOR(y)
    last = lambda a: F.element_at(a, -1)
    none = F.lit(0).cast("long")

    def running(part: Column, start: Column) -> Column:
        """start, then start and the running XORs behind it."""
        return F.aggregate(part, F.array(start), lambda a, x: F.array_append(a, xor(last(a), x)))

    def joined(blocks: Column) -> Column:
        before = running(F.transform(blocks, lambda b: F.aggregate(b, none, xor)), none)
        whole = F.zip_with(blocks, F.slice(before, 1, F.size(blocks)), lambda b, start: F.slice(running(b, start), 2, F.size(b)))
        return F.flatten(whole)

    def cut(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int")), lambda b: F.slice(v, b * size + 1, size))

    return let(values, lambda v: let(cut(v), joined))


def _variants(lines: DataFrame, min_words: int) -> DataFrame:
    """(key, at, p) for each variant of (p, line); at: the deleted unit's place, -1 for the line itself.

    A key is the XOR of the hashes of its units with their places.  Without unit i, the units before it keep their places
    and those after it move up by one, so that all variants' keys are running XORs over the line."""
    words = lines.select("p", _units(F.col("line"), min_words).alias("w"))
    placed = words.select("p", F.transform("w", lambda w, j: F.xxhash64(j, w)).alias("own"), F.transform("w", lambda w, j: F.xxhash64(j - 1, w)).alias("moved"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))
    steps = F.zip_with("moved", F.concat(F.array(F.lit(0).cast("long")), F.slice("own", 1, F.size("own") - 1)), lambda x, y: x.bitwiseXOR(y))
    made = placed.select("p", total("own").alias("whole"), total("moved").alias("all"), steps.alias("steps"))
    keys = let(F.col("all"), lambda t: F.transform(_running(F.col("steps")), lambda k: k.bitwiseXOR(t)))
    each = made.select("p", F.posexplode(F.concat(F.array("whole"), keys)).alias("at", "key"))
    return each.select(F.col("key").bitwiseAND(F.lit(_MASK).cast("long")).alias("key"), (F.col("at") - 1).alias("at"), "p")


def _one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays of units are at most one edit apart."""
    shorter, longer = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    low, high = F.size(shorter), F.size(longer)
    differ = F.zip_with(shorter, longer, lambda x, y: ~x.eqNullSafe(y))
    at = F.array_position(differ, True)  # from 1; 0 if the shorter begins the longer
    k = F.when(at == 0, low).otherwise(at - 1).cast("int")
    tail = lambda words, start, size: F.slice(words, start + 1, F.greatest(size - start, F.lit(0)))
    return (high - low <= 1) & ((k >= low) | (tail(longer, k + 1, high) == F.when(high == low, tail(shorter, k + 1, low)).otherwise(tail(shorter, k, low))))


def find_removed(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, removed): places, from 0, of the lines that go from each document; no row for the others.

    A line that isn't blank goes if it equals a line that stands earlier (in a document of smaller id, or
    above it in the same one), or is within one edit of one: of a word, in lines of min_words or more,
    of a character in shorter ones of MIN_CHARS or more.  Whether the earlier line goes itself
    doesn't matter.  Ids must tell different texts apart, as dedup_lines() sees to; equal rows have
    the same places, so none of them is earlier.  Rows of null id or text are left alone.
    """
    own = docs.select(F.col(doc_id).alias("_id"), text)
    places = Places(own)
    lines = _lines(own, text, places)
    h1, h2 = _hashes(F.col("line"))
    names = [f"end{k}" for k in range(4)]
    hashed = lines.select("p", h1.alias("h1"), h2.alias("h2"), *(k.alias(c) for c, k in zip(names, _ends(F.col("line"), min_words), strict=True)))
    folded = hashed.groupBy("h1", "h2").agg(F.min("p").alias("p"), F.max("p").alias("last"), *(F.first(c).alias(c) for c in names))
    folded = written(folded.select("h1", "h2", "p", (F.col("p") < F.col("last")).alias("copied"), *names), "lines")

    ends = folded.select("h1", F.explode(F.array(*names)).alias("end")).where("end is not null")
    shared = written(ends.groupBy("end").agg(F.count("*").alias("c")).where("c > 1").select("end"), "ends")
    near = written(ends.join(shared.hint("merge"), "end").select("h1").distinct(), "near")
    # one copy of each line is enough, but its text is only found beside its copies
    alike = lines.withColumn("h1", h1).join(near.hint("merge"), "h1").groupBy("line").agg(F.min("p").alias("p"))
    texts = written(alike, "near-lines")

    variants = written(_variants(texts, min_words), "variants")  # read twice, made once
    whole = F.when(F.col("at") == -1, F.col("p"))
    by_key = variants.groupBy("key").agg(F.min("p").alias("any_low"), F.max("p").alias("any_high"), F.min(whole).alias("whole_low")).where("any_low < any_high")
    by_key = written(by_key.select("key", "any_low", "whole_low"), "shared-variants")
    met = written(variants.join(by_key.hint("merge"), "key"), "met")
    by_place = met.groupBy("key", "at").agg(F.min("p").alias("low"))
    best = F.when(F.col("at") == -1, F.col("any_low")).otherwise(F.least("low", "whole_low"))
    pairs = met.join(by_place.hint("merge"), ["key", "at"]).withColumn("best", best).where("best < p")
    words = texts.select("p", _units(F.col("line"), min_words).alias("w"))

    def check(pairs: DataFrame) -> DataFrame:
        beside = pairs.join(words.hint("merge"), "p").join(words.select(F.col("p").alias("best"), F.col("w").alias("best_w")).hint("merge"), "best")
        return beside.select("p", _one_edit(F.col("w"), F.col("best_w")).alias("ok"))

    checked = written(check(pairs.groupBy("p").agg(F.min("best").alias("best"))), "checked")
    later, failed = checked.where("ok").select("p"), checked.where("not ok").select("p")
    if not failed.isEmpty():  # keys that coincide: rare, and all that meet such a line are looked at
        own_keys = met.join(failed, "p").select("key", "at", "p")
        more = own_keys.join(met.select("key", F.col("at").alias("other"), F.col("p").alias("best")), "key").where("best < p and (at = other or at = -1 or other = -1)")
        later = later.union(check(more.select("p", "best").distinct()).where("ok").select("p").distinct())
    later = later.withColumn("later", F.lit(True))

    # of a line that goes, every copy goes; of one that stays, all but the first
    gone = folded.join(later.hint("merge"), "p", "left").where("copied or later").select("h1", "h2", F.col("p").alias("first"), "later")
    every = lines.select("p", h1.alias("h1"), h2.alias("h2"))
    removed = every.join(gone.hint("merge"), ["h1", "h2"]).where("later or p > first")
    return removed.groupBy(places.document(F.col("p")).alias(doc_id)).agg(F.array_sort(F.collect_set(places.number(F.col("p")))).alias("removed"))


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the lines of find_removed() taken out of `text`, and n_lines and n_removed.

    Every row stays, with an empty text if all its lines went; a null text stays null, with no
    lines.  Different texts of one id are judged one after the other, in the order of their hashes;
    equal rows are judged alike.  Columns of docs named n_lines or n_removed are replaced.
    """
    base, own = docs.drop("n_lines", "n_removed"), doc_id
    apart = told_apart(base, doc_id, text, "_loam_row")
    if apart is not None:
        base, own = apart, "_loam_row"
    found = find_removed(base, doc_id=own, text=text, min_words=min_words).withColumnRenamed("removed", "_loam_removed")
    joined = base.join(found.hint("merge"), own, "left")
    lines = F.split(F.col(text), "\n")

    def rest(each: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(each) - 1), F.col("_loam_removed"))
        return F.array_join(F.transform(left, lambda k: F.get(each, k)), "\n")

    out = joined.withColumns({
        "n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1).cast("long"),
        "n_removed": F.coalesce(F.size("_loam_removed"), F.lit(0)).cast("long"),
        text: F.when(F.col("_loam_removed").isNull(), F.col(text)).otherwise(let(lines, rest)),
    })
    return out.select(*(c for c in docs.columns if c not in ("n_lines", "n_removed")), "n_lines", "n_removed")
