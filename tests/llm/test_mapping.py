from lociflow.llm.mapping import match_values

KEYS = [("ABC12", "ABC12", True), ("abc-12L", "XYZ9", True), ("ENSG0001", "ABC12", False), ("kinase 7", "KIN7", False), ("NRP-alpha", "NRP1", True), (None, "X", True), ("", "Y", True), ("LONGNAME77", "LN77", True), ("LONGNAME78", "LN78", True)]


def run(spark, values, keys=KEYS):
    v = spark.createDataFrame([(x, 1) for x in values], "value string, entry_ int").withColumnRenamed("entry_", "plain")
    k = spark.createDataFrame(keys, "key string, entry string, fuzzy boolean")
    return {r.value: (r.entry, r.distance) for r in match_values(spark, v, k).collect()}


def test_forms_typos_and_unmatched(spark):
    got = run(spark, [
        " abc12 ", "ＡＢＣ１２", "АВС12", "gene: ABC-12", "ENSG0001.4", "Kinase 7", "Kinase 8", "NRP-α (human)", "ABC12_HUMAN", "LONGNAEM77", "LONGNME77", "XLONGNAME78", "LNGNAM77",
        "LONGNAME7", "nothing like it", "?", "", "  ", None, "ABC12",
    ])
    for v in (" abc12 ", "ＡＢＣ１２", "АВС12", "gene: ABC-12", "ENSG0001.4", "ABC12_HUMAN", "ABC12"):
        assert got[v] == ("ABC12", 0), v
    assert got["Kinase 7"] == ("KIN7", 0) and got["Kinase 8"] == ("UNMATCHED", None)  # names and identifiers bear no typo
    assert got["NRP-α (human)"] == ("NRP1", 0)
    assert got["LONGNAEM77"] == ("LN77", 1)  # a swap is one edit
    assert got["LONGNME77"] == ("LN77", 1) and got["XLONGNAME78"] == ("LN78", 1) and got["LNGNAM77"] == ("LN77", 2)
    assert got["LONGNAME7"] == ("LN77", 1)  # tie: the smaller entry
    assert got["nothing like it"] == got["?"] == ("UNMATCHED", None)
    assert not {"", "  ", None} & set(got)


def test_repeats_long_values_and_empty_tables(spark):
    long = "A" * 50_000
    assert run(spark, ["abc12"] * 5 + [long] * 2) == {"abc12": ("ABC12", 0), long: ("UNMATCHED", None)}
    assert run(spark, []) == {}
    assert run(spark, ["a"], []) == {"a": ("UNMATCHED", None)}


def test_against_brute_force(spark):
    import random

    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ABCDE") for _ in range(n))
    keys = sorted({word(rng.randint(4, 9)) for _ in range(60)})
    values = sorted({word(rng.randint(3, 10)) for _ in range(200)} | {k[:2] + rng.choice("AXE") + k[3:] for k in keys})
    got = run(spark, values, [(k, k, True) for k in keys])

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    def dist(v, k):
        swaps = {k[:i] + k[i + 1] + k[i] + k[i + 2 :] for i in range(len(k) - 1)}
        d = lev(v, k)
        return 1 if d == 2 and v in swaps else d

    for v in values:
        best = min((dist(v, k), k) for k in keys)
        assert got[v] == ((best[1], best[0]) if best[0] <= 2 else ("UNMATCHED", None)), (v, got[v], best)


def test_long_names_bear_typos_too(spark):
    name = "".join(chr(65 + (i * 7) % 26) for i in range(300))
    assert run(spark, [name[:150] + "9" + name[150:]], [(name, "LONG", True)])[name[:150] + "9" + name[150:]] == ("LONG", 1)
