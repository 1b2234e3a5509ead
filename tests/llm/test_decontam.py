"""Decontamination against a plain search and on re-parameterised questions."""

import random
import re

from pyspark.sql import functions as F

from quantloom.llm import decontam

ITEMS = [
    (1, "If Tom has 12 apples and gives 5 apples to his friend Mary, how many apples does Tom have left now?"),
    (2, "The quick brown fox jumps over the lazy dog while seven wizards watch from the old stone bridge"),
    (3, "what is love"),
    (4, None),
    (5, ""),
    (2, "The quick brown fox jumps over the lazy dog while seven wizards watch from the old stone bridge"),
]


def found(spark, texts, items=ITEMS):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = decontam.contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    return {(r.doc_id, r.item_id) for r in rows.collect()}


def test_cases(spark):
    texts = [
        "x y z. " + ITEMS[0][1] + " and then more",
        "see if Anna has 31 apples and gives 7 apples to his friend Zoe, how many apples does Anna have left now?",
        "see if Anna has 31 apples and gives 7 apples to his friend Zoe, how many apples does Karl have left now?",
        ITEMS[1][1].upper().replace(" ", "\n"),
        "tell me what is love, please",
        "the quick brown fox jumps over the lazy cat",
        None,
        "",
        "word " * 30_000 + ITEMS[1][1],
    ]
    got = found(spark, texts)
    assert got >= {(0, 1), (1, 1), (3, 2), (4, 3), (8, 2)}
    assert {d for d, _ in got} & {5, 6, 7} == set()


def test_inconsistent_slots(spark):
    items = [(1, "take 12 and 12 again then add 12 to the sum of 12 and 12 so we get 12 twice over here and 12")]
    same = re.sub("12", "30", items[0][1])
    values = iter(range(50, 99))
    mixed = re.sub("12", lambda m: str(next(values)), items[0][1])
    assert found(spark, [same, mixed], items) == {(0, 1)}


def test_verbatim_against_search(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, sentence(rng.randrange(9, 30))) for i in range(20)]
    texts = [sentence(rng.randrange(0, 80)) + (" " + rng.choice(items)[1] + " " if rng.random() < 0.4 else " ") + sentence(rng.randrange(0, 80)) for _ in range(300)]
    expected = {(d, i) for d, t in enumerate(texts) for i, x in items if f" {x} " in f" {t} "}
    assert found(spark, texts, items) == expected


def test_empty_and_clashing(spark):
    docs = spark.createDataFrame([(1, "a " + ITEMS[1][1], "s", 3), (2, "clean", "t", 4), (2, "clean", "t", 4)], "doc_id long, text string, item string, hash long")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == 2
    assert decontam.drop_contaminated(docs, bench.limit(0)).count() == 3
    assert decontam.contamination(docs.limit(0), bench).count() == 0


def test_names_in_any_case_and_layout(spark):
    items = [ITEMS[0], (7, "we saw Bob and Eve near Rome with Ann from Oslo and Jim with Kim at Nice"), (9, "he ran 12 km and then 7 miles before he took a rest of 20 minutes"), (10, "they told that tom and anna went to paris with karl and zoe from berlin")]
    forms = [str, str.lower, str.upper, str.title, lambda t: t.replace(" ", "\n"), lambda t: t.replace(" ", "  "), lambda t: t.replace(" ", "\u00a0\t ")]
    texts = [form(t) for _, t in items for form in forms] + ["they told that Tom and Anna went to Paris with Karl and Zoe from Berlin"]
    expected = {(k, items[k // len(forms)][0]) for k in range(len(items) * len(forms))} | {(len(texts) - 1, 10)}
    assert found(spark, texts, items) == expected


def test_a_clash_leaves_verbatim_windows(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    items = [(1, " ".join(words[:100]) + " take 12 more " + " ".join(words[100:]) + " and 12 again")]
    one_off = items[0][1].replace("and 12 again", "and 13 again")
    shape_only = "we take 12 and then 12 plus 7 and so 12 again for 12"
    shared = "we take 30 and then 31 plus 7 and so 32 again for 33"
    assert found(spark, [one_off, shared], [*items, (2, shape_only)]) == {(0, 1)}


def brute(texts, items):
    """(doc, item) by plain loops over windows: the rules of the module's first lines, stated again."""

    def words(text):
        text = re.sub(r"\s+", " ", text or "")
        text = re.sub(r"(?<![^\W_])([0-9]+)(?![0-9])", r" 0n\1 ", text)
        text = re.sub(r"(?<=[a-z,;] )([A-Z][a-z]+)", r"0p\1", text)
        return re.sub(r"[\W_]+", " ", text).strip().lower().split()

    slot = lambda w: w[:2] if w[:2] in ("0n", "0p") else w
    bare = lambda w: w.removeprefix("0p")
    found = set()
    for d, text in enumerate(texts):
        ours = words(text)
        for i, item in items:
            theirs, places, lined = words(item), set(), {}
            size = min(8, len(theirs))
            n = max(1, len(theirs) - 7) if theirs else 0
            for p in range(len(ours) - size + 1 if size else 0):
                for q in range(n):
                    a, b = ours[p : p + size], theirs[q : q + size]
                    for x, y in ((a, b), ([bare(w) for w in a], [bare(w) for w in b]), (a, [bare(w) for w in b]), ([bare(w) for w in a], b)):
                        shape = [slot(w) for w in x]
                        if shape != [slot(w) for w in y]:
                            continue
                        some = any(w in ("0n", "0p") for w in shape)
                        if some and any(w not in ("0n", "0p") for w in shape):
                            lined.setdefault(p - q, {})[q] = (a, b)
                        elif x == y:
                            places.add(q)
            for hits in lined.values():
                values, clash = {}, False
                for a, b in hits.values():
                    for x, y in zip(a, b, strict=True):
                        if y[:2] in ("0n", "0p"):
                            clash |= values.setdefault(bare(y), bare(x)) != bare(x)
                places |= {q for q, (a, b) in hits.items() if not clash or [bare(w) for w in a] == [bare(w) for w in b]}
            if n and len(places) >= min(-(-n // 2), 6):
                found.add((d, i))
    return found


def test_number_tables_against_brute_force(spark):
    """Tables of numbers: only the same numbers count, and repeats cost no pairs of positions."""
    rng = random.Random(9)
    line = lambda n: " ".join(str(rng.randrange(10, 99)) for _ in range(n))
    table = line(40)
    items = [(1, table), (2, "0 " * 30), (3, "total of " + line(12) + " units for Anna and Bob in all"), (4, "word " * 50), (5, line(5)), (6, ITEMS[0][1])]
    texts = [line(200), "see " + table + " here", "0 " * 300, "1 " * 300, "total of " + line(12) + " units for Karl and Zoe in all", "word " * 400, table[:30], items[4][1], "a " + items[2][1].lower(), ITEMS[0][1].replace("12", "77"), "", None]
    texts += [line(rng.randrange(0, 60)) + rng.choice([" then ", " "]) + rng.choice(items)[1] + " " + line(9) for _ in range(40)]
    expected = brute(texts, items)
    assert found(spark, texts, items) == expected
    assert {(1, 1), (2, 2), (4, 3), (5, 4), (7, 5), (8, 3), (9, 6)} <= expected and not {(0, 1), (3, 2), (6, 1)} & expected


def test_long_tables_stay_small(spark):
    """50,000 numbers against an item of 5,000: one row for each matching position, not one for each pair."""
    docs = spark.createDataFrame([(1, "7 " * 50_000), (2, " ".join(str(k % 89) for k in range(50_000)))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "7 " * 5000), (2, " ".join(str(k % 83) for k in range(5000)))], "item_id long, text string")
    known = decontam.benchmark_windows(bench, "item_id", "text")
    assert known.count() <= 1 + 83
    assert {(r.doc_id, r.item_id) for r in decontam.contamination(docs, bench).collect()} == {(1, 1), (2, 2)}


def test_windows_are_those_of_whole_words(spark):
    words = ["\U00010428b", "c", "a\U00010428\U00010429", "dd", "\U0002070e", "e", "\U00010428", "f", "gg", "\U00010428h"]
    rows = spark.createDataFrame([(" ".join(words),), ("",), ("one",)], "words string")
    for size in (1, 2, 8, 10):
        got = decontam.windows(rows, F.lit(size)).collect()
        expected = [(k, " ".join(words[k : k + size])) for k in range(len(words) - size + 1)]
        assert sorted((r.pos, r.window) for r in got) == sorted(expected + ([(0, "one")] if size == 1 else []))


def test_placeholders(spark):
    texts = ["He ran 3,5 km.\n\nThen  Mary, Bob; Eve had 1.000,5 Miles 7.", "x, \U00010400\U00010428 a", "no Numbers\there .,", "1,,2 x1.2 7km"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", decontam.valued(F.col("text")).alias("v"))
    assert [r.v for r in rows.orderBy("k").collect()] == [
        "he ran 0n3q5 0ukm then 0pmary 0pbob 0peve had 0n1q000q5 0umiles 0n7", "x 0p\U00010428\U00010428 a", "no 0pnumbers here", "0n1 0n2 x1q2 0n7 0ukm",
    ]
