"""Benchmark items asked again: other numbers, names at the start of a sentence, short items behind a label."""

import random
import re

from logloom.llm import decontamination
from logloom.llm.decontamination import contaminated

FILLER = "plain words that lead into the text and have no bearing on it"
PENS = "He buys 2 pens and 2 books in 2 days and he wants to know what they cost"
OPENS = "Olsen sells many eggs to them. Olsen eats the other ones. Maria then buys what remains."
SHORT = "Which river crosses the town?"


def found(spark, docs, items):
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["coverage"] for r in contaminated(docs, items).collect()}


def test_equal_numbers_may_get_different_values(spark):
    other = PENS.replace("2 pens and 2 books in 2", "3 pens and 4 books in 6")
    edited = PENS.replace("2 books", "5 books")
    got = found(spark, [f"{FILLER} {other} {FILLER}", f"{FILLER} {edited} {FILLER}", FILLER], [PENS])
    assert got == {(0, 0): 1.0, (1, 0): 1.0}


def test_names_that_open_a_sentence(spark):
    got = found(spark, [f"{FILLER}. {OPENS.replace('Olsen', 'Berg').replace('Maria', 'Ida')}", f"{FILLER} {OPENS}"], [OPENS])
    assert got == {(0, 0): 1.0, (1, 0): 1.0}


def test_short_items_wherever_they_stand(spark):
    docs = [f"{FILLER}. {SHORT}", f"{FILLER} Q: {SHORT} {FILLER}", f"{FILLER}\n{SHORT}\n{FILLER}", f"{FILLER}, {SHORT.lower()}"]
    assert found(spark, docs, [SHORT]) == {(k, 0): 1.0 for k in range(4)}


def test_items_made_of_values_are_found_with_other_values(spark):
    item = "If 5 kg cost 10 dollars , 7 kg cost ?"
    other = item.replace("5", "3").replace("10", "12").replace("7", "9")
    got = found(spark, [f"{FILLER} {other} {FILLER}", f"{FILLER} {item}", FILLER, "If 5 kg cost much"], [item])
    assert set(got) == {(0, 0), (1, 0)} and min(got.values()) >= 0.7


def test_items_without_literals_are_found_word_by_word(spark):
    row = "12 15 18 21 24 27 30"
    assert set(found(spark, [f"{FILLER} {row} {FILLER}", f"{FILLER} 12 15 18 22 25 28 31 {FILLER}", row], [row])) == {(0, 0), (2, 0)}


def test_items_of_a_word_or_two_are_found_as_whole_texts_only(spark):
    docs = ["Blue whale.", "A blue whale swims here", "blue Whale", "Oslo", "in Oslo", "3 5", "3 6"]
    assert set(found(spark, docs, ["Blue whale", "Oslo?", "3 5"])) == {(0, 0), (2, 0), (3, 1), (5, 2)}


def test_long_texts_and_chunks(spark, monkeypatch):
    words = [f"w{k % 977}" for k in range(100_000)]
    words[40_000:40_000] = PENS.split()
    words[-3:-3] = SHORT.split()
    assert found(spark, [" ".join(words)], [PENS, SHORT]) == {(0, 0): 1.0, (0, 1): 1.0}
    codes = decontamination.Codes()
    text = " ".join(rng_text(random.Random(5), 400))
    whole = chunk_windows(text, codes)
    for size in (17, 20, 33, 100):
        monkeypatch.setattr(decontamination, "CHUNK", size)
        assert chunk_windows(text, codes) == whole


def chunk_windows(text, codes):
    return sorted(
        (reading, int(chunk.place[k]), w, h, *map(tuple, chunk.text(reading, k, w)))
        for chunk in decontamination.chunks(["so", text, "and on"], codes)
        for reading, at, width, hashed in chunk.windows({3, 4, 5})
        for k, w, h in zip(at.tolist(), width.tolist(), hashed.tolist(), strict=True)
        if chunk.row[k] == 1
    )


NAMES = "Olsen Berg Maria Jonas Ida Carl Nora Emil Anna Lukas Petra Igor".split()
GOODS = "eggs pens books stones lamps coins apples boxes letters shells".split()
UNIT_WORDS = "kg km hours days dollars meters minutes weeks".split()
VERBS = "buys sells carries paints counts mends finds keeps sorts wraps".split()
WORDS = [f"{a}{b}" for a in "ba ke li mo nu ra se ti vo zu".split() for b in "dan fel gor hin jat kul mer nop ris sut".split()]


def rng_text(rng, n):
    pool = [*WORDS, *NAMES, *UNIT_WORDS, "12", "7", "3.5", "the", "of", "and", "Then.", "so.", "five"]
    return [rng.choice(pool) for _ in range(n)]


def parts(rng):
    """An item as literal pieces and slots: ("name", which), ("num",), ("unit",)."""
    out = []
    for _ in range(rng.randrange(2, 5)):
        out += [("name", rng.randrange(2)), rng.choice(VERBS), ("num",), rng.choice([rng.choice(GOODS), ("unit",)]), rng.choice(WORDS), "for", rng.choice(WORDS)]
        out += rng.choice([["in", ("num",), ("unit",)], ["from", "the", rng.choice(WORDS)], ["at", ("num",), ("unit",), "each"]])
        out += rng.choice([["and"], ["while"], ["then"]])
    return [*out, "how", "many", rng.choice(GOODS), rng.choice(WORDS), rng.choice(WORDS), "after", rng.choice(WORDS) + "?"]


def spoken(rng, item):
    names = rng.sample(NAMES, 2)
    return " ".join(p if isinstance(p, str) else names[p[1]] if p[0] == "name" else str(rng.randrange(2, 99)) if p[0] == "num" else rng.choice(UNIT_WORDS) for p in item)


def test_recall_and_precision_on_items_asked_again(spark):
    """Of 200 items asked again with other numbers, names and units, at least 0.9 are found; texts of the
    same words in another order never are, and of other items of the same maker, built alike, few."""
    rng = random.Random(21)
    items = [parts(rng) for _ in range(200)]
    lead = lambda: " ".join(rng_text(rng, rng.randrange(0, 60)))
    again = [f"{lead()} {spoken(rng, item)} {lead()}" for item in items]
    clean = [" ".join(rng.sample((words := spoken(rng, item).split()), len(words))) for item in items] + [f"{lead()} {spoken(rng, parts(rng))}" for _ in range(200)]
    got = found(spark, again + clean, [spoken(rng, item) for item in items])
    hit = sum((k, k) in got for k in range(200))
    wrong = [(d, i) for d, i in got if d != i]
    assert hit >= 180 and len(wrong) <= 0.05 * len(got)
    assert not [d for d, _ in wrong if 200 <= d < 400]
    print(f"recall {hit / 200:.3f}, precision {1 - len(wrong) / len(got):.3f}")


def plain_windows(text, whole_only=True):
    """(place, template, values, places of the values in the text) of all windows, word by word."""
    words = text.split()
    n, base = len(words), min(5, len(words))
    if n == 0:
        return []
    kinds = [decontamination.kind(w) for w in words]
    cores = [decontamination.core(w) for w in words]
    title = [k == 0 and len(c) > 1 and c[0].isupper() and c[1:].islower() for k, c in zip(kinds, cores, strict=True)]
    opens = [k == 0 or bool(re.search(r"[.!?][\W_]*$", words[k - 1])) for k in range(n)]
    marks = {1: "<num>", 2: "<unit>", 3: "<num><unit>"}
    out = []

    def one(at, base, mode):
        if mode == "first" and not (title[at] and not opens[at]):
            return None
        shown, values, spots, literals, k = [], [], [], 0, at
        while k < n and (k - at < base or (base == 5 and literals < 3 and k - at < 16)):
            opener = title[k] and opens[k] and mode == "openers"
            name = opener or (title[k] and not opens[k] and not (mode == "first" and k == at))
            mark = "<name>" if name else marks.get(kinds[k])
            literals += mark is None
            shown.append(mark or cores[k].lower())
            values += [(("<opener>" if opener else mark) + cores[k].lower())] if mark else []
            spots += [k] if mark else []
            k += 1
        if k - at < base or literals < 3 or (mode == "openers" and not any(title[j] and opens[j] for j in range(at, k))):
            return None
        return at, " ".join(shown), tuple(values), tuple(spots)

    for base in [base] if whole_only else [3, 4, 5]:
        for at in range(n - base + 1):
            if base >= 3:
                out += [w for mode in ("plain", "first", "openers") if (w := one(at, base, mode))]
            few = sum(kinds[k] == 0 and not (title[k] and not opens[k]) for k in range(at, at + base)) < 3
            if base < 3 or few:
                out.append((at, "= " + " ".join(c.lower() for c in cores[at : at + base]), (), ()))
    if not whole_only and n < 3:
        out.append((0, "= " + " ".join(c.lower() for c in cores), (), ()))
    return out


def plain_contaminated(docs, items):
    out = {}
    for d, doc in enumerate(docs):
        theirs = {}
        for at, template, values, _ in plain_windows(doc, False):
            theirs.setdefault(template, []).append((at, values))
        for i, item in enumerate(items):
            shifts = {}
            for at, template, values, spots in plain_windows(item):
                for place, other in theirs.get(template, []):
                    shifts.setdefault(place - at, []).append((at, len(template.removeprefix("= ").split()), values, other, spots))
            words = set()
            for hits in shifts.values():
                stands = {}
                for _, _, values, other, spots in hits:
                    for a, b, k in zip(values, other, spots, strict=True):
                        if a.startswith("<name>"):
                            stands.setdefault(a, {})[k] = b.replace("<opener>", "<name>")
                torn = set()
                for places in stands.values():
                    for k, b in places.items():
                        if 2 * sum(x == b for x in places.values()) <= len(places) and len(set(places.values())) > 1:
                            torn.add(k)
                own = set()
                for at, wide, values, _, spots in hits:
                    if not any(k in torn for k, a in zip(spots, values, strict=True) if a.startswith("<name>")):
                        own |= set(range(at, at + wide))
                if not torn or len(own) >= 0.75 * len(item.split()):
                    words |= own
            if words and 2 * len(words) >= len(item.split()):
                out[d, i] = len(words) / len(item.split())
    return out


def test_contaminated_matches_a_plain_version(spark):
    rng = random.Random(9)
    items = [spoken(rng, parts(rng)) for _ in range(15)] + [" ".join(rng_text(rng, n)) for n in (1, 2, 3, 3, 4, 5, 6, 9, 12, 20)] + ["12 15 18 21 24", PENS, OPENS, SHORT, ""]
    docs = []
    for _ in range(60):
        words = rng_text(rng, rng.randrange(0, 50))
        for item in rng.sample(items, 2):
            at = rng.randrange(len(words) + 1)
            words[at:at] = [rng.choice(NAMES) if w in NAMES and rng.random() < 0.5 else w for w in item.split() if rng.random() < 0.95]
        docs.append(" ".join(words))
    docs += items
    expected = plain_contaminated(docs, items)
    assert len(expected) > 40
    assert found(spark, docs, items) == expected


def test_ids_may_be_texts(spark):
    docs = spark.createDataFrame([("a", SHORT)], "doc_id string, text string")
    got = decontamination.contaminated(docs, spark.createDataFrame([("q1", SHORT)], "item_id string, text string")).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [("a", "q1")]


def test_one_changed_name_does_not_hide_a_copy(spark):
    item = "Each morning before school Tom walks along the river and feeds nine ducks there, then in the old boat house Tom repairs two broken oars for his uncle and at night when everybody else is asleep Tom reads about ships until the small lamp goes out"
    first, second, third = item.split("Tom")[0], item.split("Tom")[1], item.split("Tom")[2]
    assert len(item.split()) >= 44
    docs = [item, item.replace("Tom", "Bob", 1), f"{FILLER} {first}Tom{second}Bob{third}Tom{item.split('Tom')[3]} {FILLER}", item.replace("Tom", "Bob"), f"{first}Ann{second}Bob{third}Eva{item.split('Tom')[3]}"]
    got = found(spark, docs, [item])
    assert set(got) >= {(0, 0), (1, 0), (2, 0), (3, 0)} and got[0, 0] == got[3, 0] == 1.0
    assert 0.75 <= got[1, 0] < 1.0 and 0.75 <= got[2, 0] < 1.0


def test_copies_with_one_name_changed_are_found(spark):
    """Of 60 items of three and more uses of a name, copied but for one of these, nine in ten are found."""
    rng = random.Random(33)
    items, docs = [], []
    while len(items) < 60:
        words = spoken(rng, parts(rng)).split()
        name = max(NAMES, key=words.count)
        if words.count(name) < 3:
            continue
        places = [k for k, w in enumerate(words) if w == name]
        at = rng.choice(places)
        items.append(" ".join(words))
        docs.append(" ".join([*FILLER.split(), *words[:at], rng.choice([n for n in NAMES if n not in words]), *words[at + 1 :]]))
    got = found(spark, docs, items)
    hit = sum((k, k) in got for k in range(60))
    print(f"found {hit} of 60")
    assert hit >= 54


def test_words_met_often_are_kept_when_the_table_is_full(monkeypatch):
    monkeypatch.setattr(decontamination, "KNOWN_WORDS", 8)
    words = ["the", "Tom", "5kg", "end."]
    codes = decontamination.Codes()
    first = [c.tolist() for c in codes.of(words * 2 + [f"w{k}" for k in range(30)])]
    again = [c.tolist() for c in codes.of(["new", *words])]
    assert list(codes) == [*words, "new"]
    assert [c[1:] for c in again] == [c[: len(words)] for c in first]
    codes.of([f"v{k}" for k in range(30)])
    # Words that have become rare are forgotten and read anew.
    assert [c.tolist() for c in codes.of(["new", *words])] == again and len(codes) == 5


def test_marks_and_kinds_are_those_of_the_patterns():
    draw = random.Random(7)
    letters = "aA1٣²½ⅫßÉ_'.!?-,٫:/(́​ǅ數kgmstndrh0123456789"
    for word in ["", "seven", "5KG", "10km", "3rd", "---", *("".join(draw.choices(letters, k=draw.randint(1, 7))) for _ in range(20_000))]:
        plain = decontamination.EDGES.sub("", word) or word
        low = plain.lower()
        assert decontamination.core(word) == plain
        measure = decontamination.MEASURE.fullmatch(low)
        number = decontamination.NUMBER.fullmatch(low) or low in decontamination.NUMBER_WORDS
        unit = low in decontamination.UNITS
        of = decontamination.NUM if number else decontamination.UNIT if unit else decontamination.NUM_UNIT if measure and measure[2] in decontamination.UNITS else decontamination.LITERAL
        assert decontamination.kind(word) == of
