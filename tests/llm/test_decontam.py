import re

import pytest
from pyspark.sql import functions as F

from folioflow.llm import decontam

ITEM = "A train leaves Boston station at 9 hours and travels 120 km north before Alice boards, then Alice walks 3 km more along the river to reach the old mill"
OTHER = "completely different words make up this second question about nothing in particular at all today"
BENCH = [(1, ITEM), (2, OTHER), (3, ITEM), (4, "too short"), (5, None), (None, OTHER), (6, "Eight short words make this item up here")]
CASES = [
    (1, f"Prefix words here. {ITEM} and the suffix goes on.", {1, 3}, "verbatim"),
    (2, "x " + ITEM.replace("120", "85").replace("Alice", "Zoe").replace("9", "11"), {1, 3}, "reparameterised"),
    (3, "x " + ITEM.replace("Alice boards", "Zoe boards").replace("Alice walks", "Bob walks"), set(), None),  # one name became two
    (4, OTHER.upper() + "!", {2}, "verbatim"),
    (5, " ".join(OTHER.split()[:6]), set(), None),
    (6, None, set(), None), (7, "", set(), None), (8, "nothing of that kind", set(), None),
    (9, f"{OTHER} {ITEM}", {1, 2, 3}, "verbatim"),
    (10, OTHER.replace(" ", "\n\t ") , {2}, "verbatim"),
    (11, "and Eight short words make this item up here", {6}, "verbatim"), (12, "eight short words make this item.", set(), None),
    (None, OTHER, set(), None),
]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(d, t, 1, "w", 2) for d, t, _, _ in CASES], "doc_id long, text string, item_id int, words string, window int")
    return docs, spark.createDataFrame(BENCH, "item_id long, text string")


def test_cases(tables):
    got = {(r.id, r.item): r.kind for r in decontam.contaminated(*tables).collect()}
    assert set(got) == {(d, i) for d, _, items, _ in CASES for i in items}
    for d, _, items, kind in CASES:
        for i in items:
            assert d == 9 or got[d, i] == kind


def test_each_item_of_a_template_is_tested(spark):
    text = "in the large box there are {} red pens and {} blue pens on the old table of the school"
    bench = spark.createDataFrame([(1, text.format(3, 3)), (2, text.format(3, 4)), (3, text.format(5, 6)), (4, text.format(3, 4))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + text.format(3, 4)), (2, text.format(3, 3)), (3, text.format(9, 9)), (4, text.format(7, 8))], "doc_id long, text string")
    got = {(r.id, r.item): r.kind for r in decontam.contaminated(docs, bench).collect()}
    v, p = "verbatim", "reparameterised"
    assert got == {(1, 2): v, (1, 4): v, (1, 3): p, **{(2, i): p for i in (2, 3, 4)}, (2, 1): v, **{(3, i): p for i in (1, 2, 3, 4)}, **{(4, i): p for i in (2, 3, 4)}}


def test_every_place_is_tested(spark):
    broken = ITEM.replace("Alice boards", "Zoe boards").replace("Alice walks", "Bob walks")
    other = ITEM.replace("Alice", "Zoe")
    split = lambda t: t.replace("before", "well before")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    rows = [(1, f"x {broken} {ITEM}"), (2, f"x {broken} and {other} {broken}"), (3, f"x {broken} {broken}"), (4, f"x {split(broken)} then {split(ITEM)}"), (5, f"x {broken}"), (5, f"some words before {other}"), (6, f"x {other} {ITEM}")]
    got = {r.id: r for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert {d: r.kind for d, r in got.items()} == {1: "verbatim", 2: "reparameterised", 4: "verbatim", 5: "reparameterised", 6: "verbatim"}
    n = len(ITEM.split())
    assert [(got[d].start, got[d].end) for d in (1, 6)] == [(n + 1, 2 * n + 1)] * 2


def letters(n, prefix=""):
    """Words without digits, which would be placeholders."""
    return [prefix + "".join("abcdefghij"[int(d)] for d in f"{i:03d}") for i in range(n)]


def test_scattered_fragments_are_no_copy(spark):
    item = letters(14)
    scattered = " then ".join(" ".join(item[i : i + 5]) for i in range(10))
    docs = spark.createDataFrame([(1, scattered), (2, " ".join(item)), (3, " ".join([*item[:7], "more", *item[7:]]))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {r.id for r in decontam.contaminated(docs, bench).collect()} == {2}
    longer = letters(40)
    bench = spark.createDataFrame([(1, " ".join(longer))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join([*longer[:20], "one", "two", *longer[20:]])), (2, " ".join([*longer[:20], *(["more"] * 30), *longer[20:]]))], "doc_id long, text string")
    assert [(r.id, r.start, r.end, r.matched, r.windows) for r in decontam.contaminated(docs, bench).collect()] == [(1, 0, 42, 32, 36)]


def test_short_items_and_unaligned_slots(spark):
    bench = spark.createDataFrame([(1, "seven tall herons"), (2, "12 kg"), (3, "the train with all of its passengers and freight leaves for the coast of the northern sea on day 4")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "I saw seven tall herons there"), (2, "weighs 13 kg"), (3, "weighs 12 kg now"), (4, "seven tall"), (5, "the train with all of its passengers and freight leaves for the coast of the northern sea on day four"), (6, "the train with all of its passengers and freight leaves for the coast of the northern sea on day 9")], "doc_id long, text string")
    assert {(r.id, r.item): r.kind for r in decontam.contaminated(docs, bench).collect()} == {(1, 1): "verbatim", (3, 2): "verbatim", (5, 3): "partial", (6, 3): "reparameterised"}


def test_rows_without_or_with_repeated_ids(spark):
    bench = spark.createDataFrame([(1, OTHER)], "item_id long, text string")
    rows = [(None, f"x {OTHER}", "a"), (None, "clean text", "b"), (7, OTHER, "c"), (7, "clean as well", "d"), (7, OTHER, "e"), (8, None, "f"), (None, None, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 string")
    assert sorted(r.k1 for r in decontam.without_contaminated(docs, bench).collect()) == ["b", "d", "f", "g"]
    assert decontam.without_contaminated(docs, bench).columns == docs.columns
    assert sorted(((r.id, r.item) for r in decontam.contaminated(docs, bench, null_ids=True).collect()), key=repr) == [(7, 1), (None, 1)]


def test_common_windows_draw_few_rows(spark):
    """Pages of numbers against items of numbers: every place that fits is found, others are not."""
    bench = spark.createDataFrame([(i, " ".join(["7"] * 6 + [key] * 6)) for i, key in enumerate(letters(30, "key"))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "5 " * 400), (2, "5 " * 50 + "8 " * 6 + "keyaad " * 6)], "doc_id long, text string")
    assert [(r.id, r.item, r.kind) for r in decontam.contaminated(docs, bench).collect()] == [(2, 3, "reparameterised")]


def template(text):
    """Template and plain words, and where the slots are, of one text; a plain version."""
    mark = re.compile(r"(?<![0-9])[.,;:!?\"'()]+|(?=[.,;:!?\"'()])[.,;:!?\"'()]+(?![0-9])")
    plain = mark.sub("", text).lower().split()
    named = re.sub(r"(?<=[^\s.!?:;\"'(][ \t])[A-Z][a-z][A-Za-z]*", "<name>", text)
    words = re.sub(r"[0-9]+(?:[.,][0-9]+)*", "<num>", mark.sub("", named).lower())
    words = re.sub(rf"<num>([ \t]?)(?:{'|'.join(decontam.UNITS)})(?![^\W_])", r"<num>\1<unit>", words).split()
    return words, plain


def brute_holds(text, item):
    """Whether a text holds an item as a whole, slots replaced consistently."""
    words, plain = template(text)
    want, own = template(item)
    for at in range(len(words) - len(want) + 1):
        if words[at : at + len(want)] == want:
            values = {}
            if all(values.setdefault((w, o), p) == p for w, o, p in zip(want, own, plain[at:], strict=False) if w in decontam.SLOTS):
                return True
    return False


def test_reparameterised_like_brute_force(spark):
    """Random items with slots in random texts, filled in again consistently or not."""
    import random

    rng = random.Random(6)
    names, vocabulary = ["Anna", "Bert", "Carla", "Dora", "Emil"], [f"w{c}x" for c in "abcdefghijklmnopqrst"]
    fill = lambda shape, values: " ".join(values[w] if isinstance(w, int) else w for w in shape)
    draw = lambda n, like: [rng.choice(names) if isinstance(v, str) and v[0].isalpha() else f"{rng.randint(1, 9)}" for v in like[:n]]
    items, docs = [], []
    for i in range(25):
        values = [rng.choice(names) if rng.random() < 0.5 else f"{rng.randint(1, 9)}" for _ in range(3)]
        shape = [rng.choice(vocabulary), rng.choice(vocabulary)] + [rng.choice([*vocabulary, 0, 1, 2, 0, 1]) for _ in range(rng.randint(12, 24))] + [rng.choice(vocabulary)]
        items.append((i, fill(shape, values)))
        for _ in range(4):
            again = draw(3, values)
            broken = [again[w] if isinstance(w, int) and rng.random() < 0.8 else values[w] if isinstance(w, int) else w for w in shape]
            body = " ".join(broken) if rng.random() < 0.4 else fill(shape, again)
            docs.append((len(docs), f"{' '.join(rng.choices(vocabulary, k=rng.randint(1, 30)))} {body} {' '.join(rng.choices(vocabulary, k=rng.randint(0, 30)))}"))
    want = {(d, i) for d, t in docs for i, q in items if brute_holds(t, q)}
    found = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), coverage=1.0)
    assert {(r.id, r.item) for r in found.collect()} == want and 20 < len(want) < 100


SAM = "Sam has 12 red apples in his old bag. Sam buys 5 green pears at the market near home. Ann gives 3 apples to her brother. How many pieces of fruit does the family have now?"


def test_names_that_begin_sentences(spark):
    bench = spark.createDataFrame([(1, SAM), (2, "Sam has 3 apples in the old basket behind the house and buys more at the fair. How many apples does Sam have now?")], "item_id long, text string")
    tim = SAM.replace("Sam", "Tim").replace("Ann", "Eve").replace("12", "14")
    rows = [
        (1, f"Words before. {SAM.replace('12', '19')} And after."), (2, f"Words before. {tim} And after."), (3, f"and so {tim}"), (4, SAM.lower()),
        (5, tim.replace("Tim buys", "Bob buys")),  # one name became two
        (6, "Well, Tim has 3 apples in the old basket behind the house and buys more at the fair. How many apples does Bob have now?"),
        (7, "Well, Tim has 3 apples in the old basket behind the house and buys more at the fair. How many apples does Tim have now?"),
        (8, "Sam went home. How many roads are there? Ann has none of them and Sam has all."),
    ]
    got = {(r.id, r.item): (r.kind, r.matched, r.windows) for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    n = len(SAM.split()) - 4
    assert {k: v[0] for k, v in got.items() if k != (5, 1)} == {(1, 1): "reparameterised", (2, 1): "reparameterised", (3, 1): "reparameterised", (4, 1): "verbatim", (7, 2): "reparameterised"}
    assert got[1, 1][1:] == got[2, 1][1:] == got[3, 1][1:] == (n, n) and (5, 1) not in got


def test_word_problems_with_other_names(spark):
    """Items of several sentences, made from names that the generator knows, and filled in again: every copy
    with consistent names is found, none where a name within a sentence became two, and no text that merely uses the words."""
    import random

    rng = random.Random(8)
    names, nouns = ["Ida", "Tom", "Lea", "Max", "Zoe", "Ben", "Amy", "Jon"], [f"thing{a}{b}" for a in "abcdefghij" for b in "klmnop"]
    verbs = ["buys", "finds", "keeps", "sells", "paints", "hides"]
    shapes = []
    for _ in range(60):
        noun = lambda: rng.choice(nouns)
        parts = [f"{{0}} {rng.choice(verbs)} {{n0}} {noun()} and a {noun()} for the {noun()} of {{1}}."] + [f"{{{rng.choice((0, 1))}}} {rng.choice(verbs)} {{n{rng.choice((1, 2))}}} {noun()} near the {noun()} with {noun()}." for _ in range(rng.randint(1, 4))] + [f"How many {noun()} does {{0}} share with {{1}} at the {noun()} now?"]
        shapes.append(" ".join(parts))

    def fill(shape, who):
        out = shape
        for i, name in enumerate(who):
            out = out.replace(f"{{{i}}}", name)
        for i in range(3):
            out = out.replace(f"{{n{i}}}", str(rng.randint(2, 99) * 3 + i))
        return out

    items = [(i, fill(s, rng.sample(names[:4], 2))) for i, s in enumerate(shapes)]
    docs, want = [], set()
    for i, s in enumerate(shapes):
        before = " ".join(rng.choices(nouns, k=20)) + ". "
        docs.append((len(docs), before + fill(s, rng.sample(names[4:], 2)) + " The end of it."))
        want.add((len(docs) - 1, i))
        # {0} and {1} stand within sentences twice or more over the whole; the last sentence takes other names.
        head, last = s[: s.rindex("How many")], s[s.rindex("How many") :]
        docs.append((len(docs), before + fill(head, names[4:6]) + fill(last, names[6:8])))
        docs.append((len(docs), " ".join(rng.choice(names) + " " + " ".join(rng.choices(nouns, k=6)) + "." for _ in range(8))))
    found = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.id, r.item) for r in found} == want and all(r.matched == r.windows for r in found)


def test_large_benchmark_takes_the_other_way(tables, monkeypatch):
    want = {tuple(r) for r in decontam.contaminated(*tables).collect()}
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    assert {tuple(r) for r in decontam.contaminated(*tables).collect()} == want


def test_marks_in_texts(spark):
    rows = [("x\x01 \x01 \x02Sam\x02 Sam's dog. O'Brien 5. Miles",)]
    r = spark.createDataFrame(rows, "t string").select(decontam.template_words(F.col("t")).alias("w"), decontam.plain_words(F.col("t")).alias("p")).first()
    assert len(r.w) == len(r.p) == 8 and r.w[4:] == ["dog", "obrien", "<num>", "<unit>"]


def test_templates(spark):
    texts = ["The cost is 3.5 kg or 12km, said Bob Smith.", "In 2020 we had 1,000 apples", "Paris. Paris is in France", "a . b", ""]
    row = spark.createDataFrame([(t,) for t in texts], "t string").select(decontam.template_words(F.col("t")).alias("w"), decontam.plain_words(F.col("t")).alias("p")).collect()
    assert row[0].w == "the cost is <num> <unit> or <num><unit> said <name> <name>".split()
    assert row[1].w == "in <num> we had <num> apples".split()
    assert row[2].w == "paris paris is in <name>".split()
    assert row[3].w == ["a", "b"] and row[4].w == []
    assert all(len(r.w) == len(r.p) for r in row)


def test_empty_tables(tables):
    docs, bench = tables
    assert decontam.contaminated(docs.limit(0), bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_query_like_brute_force(spark, sf_dir):
    """Whole items within documents, letter case, punctuation and white space aside."""
    plain = lambda t: " " + " ".join(re.sub(r"(?<![0-9])[.,;:!?\"'()]+|[.,;:!?\"'()]+(?![0-9])", "", t).lower().split()) + " "
    docs = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, q in items.items() if q in t}
    got = {(r.doc_id, r.item_id) for r in decontam.op7_decontamination(spark, sf_dir).collect()}
    assert want and want == got
