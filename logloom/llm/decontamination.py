"""Operator 3: benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so that a question asked again with
other values has the same template. Windows of template words are hash-joined
with those of the benchmark; windows at one alignment are held against each other:
one name of the item must be one in the document. Where it isn't, windows over the odd places
don't count, and the others only if they are most of the item. Equal
numbers and units may stand for different things, so they needn't stay equal.
A window has at least WINDOW words and grows until it has LITERALS literal ones, so that items
made of values have windows too. Where values stand close together, windows of their own words are
joined besides, and items too short for a window are looked for whole.
A small bitmap of the benchmark's window hashes, of bounded size, keeps windows that
can't match out of the join; it never loses one that can.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from logloom.llm.common import short_batches, table, without_ids, written

#: Words of a window, the literal words it grows to have, and the words it has at most.
WINDOW, LITERALS, REACH = 5, 3, 16
#: Items of fewer words are only found as whole texts: as a part, a word or two prove nothing.
LEAST_WORDS = 3
#: Share of an item's words that must be found, at alignments whose slots agree.
COVERAGE = 0.5
#: Share that an alignment must have by itself if its names don't agree everywhere: a passage in which a name was
#: changed here and there is still the passage, one whose people are others in every other place is not.
TORN_COVERAGE = 0.75
#: Bits of the window bitmap: as many as give few false hits, up to a bound of 16 MB; bytes of a block of it.
LEAST_BITS, MOST_BITS, BITS_EACH, BLOCK_LOG2 = 1 << 20, 1 << 27, 256, 16
#: Words that are hashed at once, and words that a task remembers.
CHUNK, KNOWN_WORDS = 1 << 15, 1 << 17

# Unit words and number words.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes ml cl l liter liters litre litres gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars euro euros cent cents percent degree degrees watt watts volt volts kmh mph".split()
)
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split()
)
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
#: The commonest of these marks; what they leave is looked through for others only where it needs it.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
STOP = re.compile(r"[.!?][\W_]*$")
NUMBER = re.compile(r"[\d][\d.,:/]*(st|nd|rd|th)?")
MEASURE = re.compile(r"([\d][\d.,]*)([a-z]{1,3})")
LITERAL, NUM, UNIT, NUM_UNIT = 0, 1, 2, 3
#: Flags below the hash of a word: its kind (two bits), title case, end of a sentence.
TITLE, END, FLAGS = 4, 8, 15
WORD_KINDS = dict.fromkeys(UNITS, UNIT) | dict.fromkeys(NUMBER_WORDS, NUM)
PLACEHOLDERS = {NUM: "<num>", UNIT: "<unit>", NUM_UNIT: "<num><unit>"}
NAME = "<name>"


def _hash(text: str) -> int:
    try:
        return xxhash.xxh64_intdigest(text) & ~FLAGS
    except UnicodeEncodeError:
        return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) & ~FLAGS


NAME_CODE = np.uint64(_hash(NAME))


def core(word: str) -> str:
    """The word without marks at its ends; a word of marks only is itself."""
    plain = word.strip(MARKS)
    if plain[:1].isalnum() and plain[-1:].isalnum():
        return plain
    return EDGES.sub("", word) or word


def kind(word: str) -> int:
    return kind_of(core(word).lower())


def kind_of(low: str) -> int:
    """The kind of a word without marks at its ends, in lower case."""
    if low[:1].isdecimal():
        if NUMBER.fullmatch(low):
            return NUM
        return NUM_UNIT if (found := MEASURE.fullmatch(low)) and found[2] in UNITS else LITERAL
    return WORD_KINDS.get(low, LITERAL)


#: Hashes of the placeholders by kind.
PLACEHOLDER_CODES = np.array([_hash(PLACEHOLDERS.get(of, "")) for of in (LITERAL, NUM, UNIT, NUM_UNIT)], np.uint64)


class Codes(dict):
    """Place of a word in a table of the words' hashes with their flags. When it has grown large between chunks,
    the words that were met only once, or less often than KNOWN_WORDS / 2 others, are forgotten."""

    def __init__(self) -> None:
        self.table, self.used = array("Q"), np.zeros(0, np.int64)

    def __missing__(self, word: str) -> int:
        if word.isalpha() and word.islower() and word.isascii():
            low, flags = word, WORD_KINDS.get(word, LITERAL)
        else:
            plain = core(word)
            low = plain.lower()
            flags = kind_of(low)
            if flags == LITERAL and len(plain) > 1 and plain[0].isupper() and plain[1:].islower():
                flags |= TITLE
            if not word[-1].isalnum() and STOP.search(word):
                flags |= END
        self[word] = at = len(self.table)
        self.table.append(_hash(low) | flags)
        return at

    def forget(self) -> None:
        often = np.flatnonzero(self.used > 1)
        if len(often) > KNOWN_WORDS // 2:
            often = np.sort(often[np.argsort(-self.used[often], kind="stable")[: KNOWN_WORDS // 2]])
        words = list(self)
        kept = np.array(self.table, np.uint64)[often]
        self.clear()
        self.update(zip([words[k] for k in often.tolist()], range(len(often)), strict=True))
        self.table, self.used = array("Q", kept.tobytes()), np.zeros(len(often), np.int64)

    def of(self, words: list[str]) -> list[np.ndarray]:
        """Of each word the hash of its literal or placeholder, the hash of the word itself, and flags."""
        if len(self) > KNOWN_WORDS:
            self.forget()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        self.used = np.bincount(at, minlength=len(self)) + np.pad(self.used, (0, len(self) - len(self.used)))
        own = np.array(self.table, np.uint64)[at]
        flags = (own & np.uint64(FLAGS)).astype(np.uint8)
        own &= ~np.uint64(FLAGS)
        of = flags & 3
        return [np.where(of > 0, PLACEHOLDER_CODES[of], own), own, flags]


#: Readings of a window. Whether a title-case word opens a sentence depends on what stands
#: before it, which differs where a passage is quoted: besides the plain reading, a name that is
#: the window's first word is also read as a literal, and a word that opens a sentence also as a
#: name. The last reading takes the words themselves.
PLAIN, FIRST_LITERAL, OPENERS_NAMES, VERBATIM = 0, 1, 2, 3
#: What stands before the value of a slot that is a name only as an opener, and before a verbatim window.
OPENER, QUOTED = "<opener>", "= "
BASE = 0x9E3779B97F4A7C15
STEPS, BACK = (np.cumprod(np.r_[np.uint64(1), np.full(CHUNK + REACH, v, np.uint64)]) for v in (BASE, pow(BASE, -1, 1 << 64)))


class Sums:
    """Running sums of a row of words, from which the hash of any window follows."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.sums = np.r_[np.uint64(0), np.cumsum(hashes * BACK[: len(hashes)])]

    def windows(self, at: np.ndarray, width: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the windows; first is what the hash of each one's first word is to grow by."""
        value = (self.sums[at + width] - self.sums[at]) * STEPS[at]
        value = (value if first is None else value + first) + width.astype(np.uint64)
        value = (value ^ value >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        return value ^ value >> np.uint64(29)


class Chunk:
    """Some words of one or more texts, end to end, with what their windows need."""

    def __init__(self, pieces: list[tuple[int, int, list[str], int, bool, bool]], codes: Codes) -> None:
        """pieces: row, place of the first word in its text, words, how many of them may begin a window,
        whether the first begins a sentence, whether the words are the whole text."""
        self.words = [w for piece in pieces for w in piece[2]]
        sizes = np.array([len(piece[2]) for piece in pieces])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        self.row, self.place = (np.repeat([piece[c] for piece in pieces], sizes) for c in (0, 1))
        self.place = self.place + np.arange(len(self.words)) - np.repeat(starts, sizes)
        self.left = np.repeat(ends, sizes) - np.arange(len(self.words))
        self.begins_window = np.arange(len(self.words)) - np.repeat(starts, sizes) < np.repeat([piece[3] for piece in pieces], sizes)
        self.whole = np.repeat([piece[5] for piece in pieces], sizes)
        self.hashes, self.own, flags = codes.of(self.words)
        begins = np.ones(len(self.words), bool)
        begins[1:] = flags[:-1] & END > 0
        begins[starts] = [piece[4] for piece in pieces]
        title = flags & TITLE > 0
        self.typed, self.names, self.openers = flags & 3 > 0, title & ~begins, title & begins

    def windows(self, widths: set[int]) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(reading, places, widths, hashes) of all windows: growing ones for WINDOW, fixed ones for smaller widths."""
        out = []
        quoted, slots = Sums(self.own), {PLAIN: self.names, OPENERS_NAMES: self.names | self.openers}
        sums, literal = {}, {}
        for reading, slot in slots.items():
            sums[reading] = Sums(np.where(slot, NAME_CODE, self.hashes))
            literal[reading] = np.flatnonzero(~(slot | self.typed))
        opened = np.r_[0, np.cumsum(self.openers)]

        def add(reading: int, at: np.ndarray, width: np.ndarray) -> None:
            if reading == VERBATIM:
                found = quoted.windows(at, width)
            elif reading == FIRST_LITERAL:
                found = sums[PLAIN].windows(at, width, self.hashes[at] - NAME_CODE)
            else:
                if reading == OPENERS_NAMES:
                    some = opened[at + width] > opened[at]
                    at, width = at[some], width[some]
                found = sums[reading].windows(at, width)
            out.append((reading, at, width, found))

        for least in sorted(widths):
            fits = self.begins_window & (self.left >= least)
            if least < LEAST_WORDS:
                at = np.flatnonzero(fits & self.whole & (self.place == 0) & (self.left == least))
                add(VERBATIM, at, np.full(len(at), least))
                continue
            spots = np.flatnonzero(fits)
            for reading in (PLAIN, FIRST_LITERAL, OPENERS_NAMES):
                at = spots[self.names[spots]] if reading == FIRST_LITERAL else spots
                places = literal[PLAIN if reading == FIRST_LITERAL else reading]
                # Where the window has its last needed literal; in FIRST_LITERAL the first word is one.
                nth = np.searchsorted(places, at) + LITERALS - 1 - (reading == FIRST_LITERAL)
                known = nth < len(places)
                at, nth = at[known], nth[known]
                need = places[nth] - at + 1
                width = np.maximum(need, least)
                good = (width <= np.minimum(self.left[at], REACH)) if least == WINDOW else width == least
                add(reading, at[good], width[good])
                if reading == PLAIN:
                    # Where the first words have too few literals, they count as they are.
                    scarce = np.ones(len(self.words), bool)
                    scarce[at[need <= least]] = False
                    rest = spots[scarce[spots]]
                    add(VERBATIM, rest, np.full(len(rest), least))
        return out

    def text(self, reading: int, at: int, width: int) -> tuple[str, list[str], list[int]]:
        """The template of a window in a reading, the values of its slots, each with its placeholder, and their places in it."""
        out, values, places = [], [], []
        for k in range(at, at + width):
            plain = core(self.words[k])
            if reading == VERBATIM:
                out.append(plain.lower())
                continue
            opener = reading == OPENERS_NAMES and self.openers[k]
            named = opener or self.names[k] and not (reading == FIRST_LITERAL and k == at)
            mark = NAME if named else PLACEHOLDERS[kind(self.words[k])] if self.typed[k] else None
            out.append(mark or plain.lower())
            if mark:
                values.append(f"{OPENER if opener else mark}{plain.lower()}")
                places.append(k - at)
        return QUOTED * (reading == VERBATIM) + " ".join(out), values, places


WORDS = re.compile(r"\S+")


def chunks(texts: list[str | None], codes: Codes) -> Iterator[Chunk]:
    """Chunks of about CHUNK words: many short texts, or parts of a long one that overlap by a window."""
    pieces, size = [], 0
    for row, text in enumerate(texts):
        found = iter((text or "").split()) if len(text or "") <= CHUNK else (m[0] for m in WORDS.finditer(text))
        kept, place, begins = [], 0, True
        while True:
            room = max(CHUNK - size - len(kept), 1)
            more = list(islice(found, room))
            words, ended = kept + more, len(more) < room
            free = len(words) if ended else max(len(words) - REACH + 1, 0)
            if free:
                pieces.append((row, place, words, free, begins, ended and place == 0))
                size += len(words)
                begins = bool(STOP.search(words[free - 1]))
            kept, place = words[free:], place + free
            if size >= CHUNK - REACH:
                yield Chunk(pieces, codes)
                pieces, size = [], 0
            if ended:
                break
    if pieces:
        yield Chunk(pieces, codes)


def windows(rows: DataFrame, key: str, widths: set[int] | None, bitmap: np.ndarray | None) -> DataFrame:
    """The template windows of rows(key, text): id, at, width, n_words, hash, template, slots and their places. Without widths,
    of the benchmark's items: WINDOW, or the number of words of a shorter item, and n_words is that of the
    item. With a bitmap, only windows whose bit is set."""
    short_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)
    given = rows.select(F.col(key).alias("id"), "text")
    kinds = {"id": given.schema["id"].dataType, "at": T.LongType(), "width": T.IntegerType(), "n_words": T.LongType(), "hash": T.LongType(), "template": T.StringType(), "slots": T.ArrayType(T.StringType()), "places": T.ArrayType(T.IntegerType())}
    schema = T.StructType([T.StructField(name, of) for name, of in kinds.items()])
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, bits = Codes(), shared.value
        for batch in batches:
            texts = batch["text"].to_pylist()
            totals = [len((t or "").split()) for t in texts] if widths is None else [0] * len(texts)
            for chunk in chunks(texts, codes):
                out = []
                for reading, at, width, hashed in chunk.windows({*range(1, WINDOW + 1)} if widths is None else widths):
                    if widths is None:
                        good = width >= np.minimum(WINDOW, np.array(totals)[chunk.row[at]])
                        at, width, hashed = at[good], width[good], hashed[good]
                    if bits is not None:
                        spot = hashed & np.uint64(8 * len(bits) - 1)
                        hit = bits[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8) & 1 > 0
                        at, width, hashed = at[hit], width[hit], hashed[hit]
                    for k, w, h in zip(at.tolist(), width.tolist(), hashed.view(np.int64).tolist(), strict=True):
                        row = int(chunk.row[k])
                        out.append((row, int(chunk.place[k]), w, totals[row], h, *chunk.text(reading, k, w)))
                if out:
                    row, *columns = zip(*out, strict=True)
                    arrays = [batch["id"].take(pa.array(row)).cast(arrow.field("id").type), *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:], strict=True))]
                    yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return given.mapInArrow(cut, schema)


def window_bitmap(own: DataFrame) -> np.ndarray:
    """The bitmap of the benchmark's window hashes, made in blocks by tasks; at most MOST_BITS bits."""
    bits = LEAST_BITS
    wanted = BITS_EACH * own.count()
    while bits < min(wanted, MOST_BITS):
        bits *= 2
    spot = F.col("hash").bitwiseAND(F.lit(bits - 1))
    parts = own.select(F.shiftrightunsigned(spot, 3).alias("byte"), F.call_function("shiftleft", F.lit(1), spot.bitwiseAND(F.lit(7)).cast("int")).alias("mark"))
    parts = parts.groupBy("byte").agg(F.bit_or("mark").alias("mark")).withColumn("block", F.shiftright("byte", BLOCK_LOG2))

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(1 << BLOCK_LOG2, np.uint8)
        out[rows["byte"].to_numpy() & (1 << BLOCK_LOG2) - 1] = rows["mark"].to_numpy()
        return pd.DataFrame({"block": rows["block"].iloc[:1], "bytes": [out.tobytes()]})

    out = np.zeros(bits // 8, np.uint8)
    for row in parts.groupBy("block").applyInPandas(block, "block long, bytes binary").collect():
        out[row["block"] << BLOCK_LOG2 :][: 1 << BLOCK_LOG2] = np.frombuffer(row["bytes"], np.uint8)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Pairs (doc_id, item_id, matched_words, item_words, coverage) of documents that hold an item.

    coverage is the share of the item's words inside matched windows. At one alignment a name of the item must be one name
    in the document; names that open a sentence are read both ways, numbers and units may differ. If a name is several there,
    places that don't have what most have (none, if nothing is in more than half of them) are torn: windows over
    them don't count, and those that are left only if they cover TORN_COVERAGE of the item at this alignment. Null and empty texts and items match
    nothing; items of fewer than LEAST_WORDS words match texts that are the same and no more;
    texts may be of any length. Rows that share a doc_id (or have none) are taken together;
    repeated items with one id count once; other columns are ignored; empty tables give no pairs.
    """
    own = written(windows(benchmark, "item_id", None, None).distinct(), "benchmark-windows")
    widths = {r["width"] for r in own.select(F.least("width", F.lit(WINDOW)).alias("width")).distinct().collect()}
    theirs = windows(docs, "doc_id", widths, window_bitmap(own))
    item = own.select("hash", "template", "width", F.col("id").alias("item_id"), F.col("at").alias("item_at"), F.col("n_words").alias("item_words"), F.col("slots").alias("item_slots"), "places")
    doc = theirs.select("hash", "template", F.col("id").alias("doc_id"), "at", F.col("slots").alias("doc_slots"))
    hits = doc.join(item, ["hash", "template"]).select(
        "doc_id", "item_id", "item_words", "item_at", "width", (F.col("at") - F.col("item_at")).alias("shift"), "item_slots", "doc_slots", "places"
    )
    hits = written(hits, "window-hits")
    group = ["doc_id", "item_id", "shift"]
    pairs = hits.select(*group, "item_at", F.explode(F.arrays_zip("item_slots", "doc_slots", "places")).alias("pair"))
    pairs = pairs.where(F.startswith("pair.item_slots", F.lit(NAME)))
    value = F.regexp_replace("pair.doc_slots", f"^{OPENER}", NAME)
    # A row for each place of a name at an alignment, however many windows hold it.
    stands = pairs.select(*group, F.col("pair.item_slots").alias("name"), (F.col("item_at") + F.col("pair.places")).alias("spot"), value.alias("value")).distinct()
    told = stands.groupBy(*group, "name", "value").agg(F.collect_list("spot").alias("spots"))  # an item has so many places at most
    names = told.groupBy(*group, "name").agg(F.max(F.struct(F.size("spots"), "spots")).alias("most"), F.sum(F.size("spots")).alias("n"), F.flatten(F.collect_list("spots")).alias("spots"), F.count("*").alias("values"))
    kept = F.when(F.size("most.spots") * 2 > F.col("n"), F.col("most.spots")).otherwise(F.array().cast("array<bigint>"))
    torn = names.where("values > 1").groupBy(*group).agg(F.flatten(F.collect_list(F.array_except("spots", kept))).alias("torn")).select(*[F.col(c).alias(f"of_{c}") for c in group], "torn")
    same = F.lit(True)
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    windows_at = hits.select(*group, "item_words", "item_at", "width", F.expr("filter(zip_with(item_slots, places, (s, p) -> if(startswith(s, '<name>'), item_at + p, null)), x -> x IS NOT NULL)").alias("named"))
    # Alignments with torn places; the others go on as they are.
    spots = F.explode(F.expr("sequence(item_at, item_at + width - 1)")).alias("spot")
    whole = windows_at.join(torn, same, "left_anti").select("doc_id", "item_id", "item_words", spots)
    left = windows_at.join(torn, same).where(~F.arrays_overlap("named", "torn")).select(*group, "item_words", spots).distinct()
    enough = left.groupBy(*group).agg(F.collect_list("spot").alias("spots"), F.max("item_words").alias("item_words")).where(F.size("spots") >= TORN_COVERAGE * F.col("item_words"))
    spots = whole.unionByName(enough.select("doc_id", "item_id", "item_words", F.explode("spots").alias("spot"))).distinct()
    found = spots.groupBy("doc_id", "item_id").agg(F.count("*").alias("matched_words"), F.max("item_words").alias("item_words"))
    share = F.col("matched_words") / F.col("item_words")
    return found.withColumn("coverage", share).where(share >= coverage)


def decontaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs that hold no benchmark item, all columns as they are."""
    return without_ids(docs, contaminated(docs, benchmark, coverage), "contaminated")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
