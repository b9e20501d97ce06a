import random

from lociflow.llm.leaks import find_leaks, without_leaks
from lociflow.llm import leaks
from lociflow.llm.words import readings, words

ITEM = [f"word{chr(97 + i)}" for i in range(20)]
FILL = "some other text that has nothing in common with it at all".split()


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, i) for i, t in enumerate(docs)], "doc_id bigint, text string, item_id int")
    q = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    found = find_leaks(d, q)
    return {(r.doc_id, r.item_id): r.longest_match for r in found.collect()}, without_leaks(d, found)


def test_words():
    assert words("T&#104;e <em>Ca</em>fé, thal-\namic ﬁlter ZERO​width soft\xadhyphen х-ray") == "the cafe thalamic filter zerowidth softhyphen x ray".split()


def test_long_tags_and_hyphens_at_line_ends():
    tag = "<span style='" + "x" * 4000 + "'>"
    assert words(f"one {tag}two</span> p <q three") == "one two p q three".split()
    assert readings("a well-\nknown exam-\nple", {"well", "known", "example"}) == ["a well known example".split()]
    assert readings("some-\nthing", {"some", "thing", "something"}) == [["something"], ["some", "thing"]]


def test_broken_compound_and_another_edit(spark):
    item = "a well known b c d e f g h i j".split()
    text = "q a well-\nknown b c x e f g y i j q"  # the hyphen is none of the two edits
    assert run(spark, [text, text.replace(" b ", " z ")], [" ".join(item)])[0] == {(0, 0): 5}


def test_longest_match_is_full_depth(spark):
    long = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)]
    docs = [" ".join(FILL + long[5:82] + FILL + long[:14]), " ".join(long[40:60] + FILL)]
    got, _ = run(spark, docs, [" ".join(long), " ".join(long[40:60])])
    assert got == {(0, 0): 77, (0, 1): 20, (1, 0): 20, (1, 1): 20}


def test_shards_chunks_and_parts(spark, monkeypatch):
    docs = [" ".join(FILL + ITEM[i % 5 : i % 5 + 12] + FILL) for i in range(60)]
    items = [" ".join(ITEM), " ".join(reversed(ITEM)), " ".join(ITEM[:13])]
    want = run(spark, docs, items)[0]
    assert len(want) >= 60
    for name, small in (("SHARD_WORDS", 50), ("CHUNK", 3), ("ITEM_BYTES", 150)):
        monkeypatch.setattr(leaks, name, small)
    assert run(spark, docs, items)[0] == want


def test_cases(spark):
    w = ITEM
    docs = [
        " ".join(FILL + w[3:15] + FILL),  # twelve words
        " ".join(FILL + w[3:9] + FILL + w[9:15]),  # two halves far apart
        " ".join(w[:4] + ["changed"] + w[5:9] + w[10:13]),  # one changed, one dropped
        " ".join(w[:5] + ["extra"] + w[5:10] + ["more"] + w[10:12]),  # two added
        " ".join(w[:4] + ["x"] + w[5:8] + ["y"] + w[9:10] + ["z"]),  # too little
        "<p>" + " ".join(x.upper() for x in w[:6]) + ",\n\n" + "—".join(w[6:12]) + "</p>",
        None, "", " ".join(w[:7]), " ".join(FILL * 20_000 + w + FILL), " ".join(FILL + w[3:15] + FILL),
    ]
    got, clean = run(spark, docs, [" ".join(w), "too short an item", None, " ".join(w)])
    assert {d for d, _ in got} == {0, 2, 3, 5, 9, 10} and {i for _, i in got} == {0, 3}
    assert got[0, 0] == 12 and got[9, 3] == 20
    assert {r.doc_id for r in clean.collect()} == {1, 4, 6, 7, 8}


def test_empty(spark):
    assert run(spark, [], ["a b"])[0] == {} and run(spark, ["a b"], [])[0] == {}


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"v{chr(97 + i)}" for i in range(14)]
    items = [" ".join(rng.choice(vocab) for _ in range(16)) for _ in range(6)]
    docs = []
    for _ in range(60):
        s = rng.choice(items).split()[(k := rng.randint(0, 6)) : k + rng.randint(8, 12)]
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(s))
            s[i : i + 1] = rng.choice([[], [rng.choice(vocab)], [s[i], "zz"]])
        docs.append(" ".join(rng.choices(["q1x", "q2x"], k=3) + s + ["q3x"]))

    def edit(a, b):  # least edits of a against any stretch of b
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
        return min(row)

    want = {(d, i) for d, t in enumerate(docs) for i, q in enumerate(items) if any(edit(q.split()[s : s + 12], t.split()) <= 2 for s in range(5))}
    assert set(run(spark, docs, items)[0]) == want and want
