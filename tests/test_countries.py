"""Countries within one or two edits against all pairs."""

import random

from orgweave.operators import geocode
from orgweave.sources.tables import country_aliases

NAMES = ["France", "Spain", "Portugal", "Switzerland", "Netherlands", "Niger", "Nigeria", "Austria", "Australia", "Iran", "Iraq", "Côte d'Ivoire", "United Kingdom"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_nearest_names_equal_all_pairs(spark):
    r = random.Random(5)
    aliases = country_aliases(spark.createDataFrame([(n, f"Republic of {n}", n[:3].upper(), n[:2].upper(), "c", "u") for n in NAMES], "name_short string, name_official string, ISO3 string, ISO2 string, continent string, UNregion string"))
    asked = {"", "Fr", "FRA", "Frnace ", "Nigera", "Nigeri", "Austrlia", "Irak", "x" * 60, "Republic of Spayn", "republik off spain"}
    for n in NAMES:
        for _ in range(12):
            s = list(n.lower() if r.random() < 0.5 else n)
            for _ in range(r.randint(1, 3)):
                i = r.randrange(len(s))
                s[i : i + 1] = r.choice([[], [s[i], "q"], ["z"]]) or ([] if len(s) > 1 else ["z"])
            asked.add("".join(s))
    known = [(row.key, row.name_short) for row in aliases.collect()]
    expected = {}
    for name in asked:
        a = name.strip().lower()
        allowed = 0 if len(a) < 5 else 2 if 9 <= len(a) <= 40 else 1
        near = [(distance(a, k.lower()), k, short) for k, short in known if allowed and len(k.strip()) >= 3]
        near = [x for x in near if x[0] <= allowed]
        best = [x for x in near if x[0] == min(y[0] for y in near)]
        if best and len({x[2] for x in best}) == 1:
            expected[name] = min(x[1] for x in best)
    got = {row.n: row.key for row in geocode.near_countries(spark.createDataFrame([(n,) for n in asked] + [(None,)], "n string"), aliases).collect()}
    assert got == expected and len(got) > 40


def test_countries_of_a_table(spark):
    aliases = country_aliases(spark.createDataFrame([("France", "French Republic", "FRA", "FR", "Europe", "West"), ("Niger", None, "NER", "NE", "Africa", "West"), ("Nigeria", None, "NGA", "NG", "Africa", "West")], "name_short string, name_official string, ISO3 string, ISO2 string, continent string, UNregion string"))
    rows = [(1, "France"), (2, "france"), (3, "Franse"), (4, "Nigera"), (5, "Atlantis"), (6, None), (7, " "), (8, "Franse")]
    out = geocode.normalise_country(spark.createDataFrame(rows, "id int, country string"), "country", aliases)
    assert {r.id: r.country_short for r in out.collect()} == {1: "France", 2: "France", 3: "France", 4: "Nigera", 5: "Atlantis", 6: None, 7: None, 8: "France"}
    strict = geocode.normalise_country(spark.createDataFrame(rows, "id int, country string"), "country", aliases, fuzzy=False)
    assert {r.id: r.country_code for r in strict.collect()}[3] is None
